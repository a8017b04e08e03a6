"""Transaction log reassembly: what was undone and by what, what was committed, and the store's deltas.

The log is cut into shards of whole transactions, and DuckDB matches each shard by itself: a change is
joined, by the next position (ASOF), to the rollback of its own savepoint level and to the end of its
transaction. The versions that remain are dealt by key and stretch of epochs; there DuckDB joins each
version to the one before it, and the difference of the two is what its epoch adds to the store.

Which transaction or epoch a record belongs to follows from counts of earlier records. These are
taken by blocks of the log (``prior``), so no task holds the log, a stream or a key whole: a hot stream
is many shards, a hot key many stretches. A transaction is matched in one task.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions.ship import ship
from assaykit.llm.common import scratch, table

#: Transactions of one stream that stay together, epochs of one key that do, rows of a shard aimed at.
TRANSACTIONS, EPOCHS, SHARD_ROWS = 256, 4096, 1 << 18
#: No window over blocks holds more rows than this.
WIDTH = 1024
#: Fixed values of the log: how a record's number picks its kind, the number of keys, commits an epoch.
KINDS, KEYS, COMMITS = 23, 300, 4

MATCH = """
with counted as (
  select *, coalesce(sum((kind in ('commit', 'abort'))::int) over (
      partition by stream, segment order by pos, tie rows between unbounded preceding and 1 preceding), 0) as txn,
    case kind when 'savepoint' then 1 when 'rollback' then -1 else 0 end as step
  from log
),
walked as (
  select *, sum(step) over (partition by stream, segment, txn order by pos, tie rows unbounded preceding) as walk
  from counted
),
levelled as (  -- a rollback without a savepoint leaves the level at 0
  select *, walk - least(0, min(walk) over (partition by stream, segment, txn order by pos, tie rows unbounded preceding)) as level
  from walked
),
rollbacks as (
  select stream, segment, txn, pos, before as level from (
    select *, coalesce(lag(level) over (partition by stream, segment, txn order by pos, tie), 0) as before from levelled
  ) where kind = 'rollback'
)
select c.stream, c.pos, c.tie, c.key, c.mark, r.pos as rolled_at, e.pos as ended_at, e.kind as ended_by
from (select * from levelled where kind = 'change') c
asof left join rollbacks r
  on c.stream = r.stream and c.segment = r.segment and c.txn = r.txn and c.level = r.level and c.pos < r.pos
asof left join (select * from levelled where kind in ('commit', 'abort')) e
  on c.stream = e.stream and c.segment = e.segment and c.pos < e.pos
"""

DELTA = """
select v.key, v.epoch, v.pos, v.mark, p.pos as prior_pos, p.mark as prior_mark
from (select * from versions where not seed) v
asof left join versions p on v.key = p.key and v.stretch = p.stretch and v.epoch > p.epoch
"""


def prior(rows: DataFrame, keys: list[str], at: str, value: str, last: bool = False, width: int = WIDTH) -> DataFrame:
    """rows with ``prior``: the sum of value, or its last one, over the lesser ``at`` of the same keys.

    rows are totals, one a key and number ``at`` from 0, their values not null. A window holds at most
    ``width`` of them: of longer rows, stretches are added up and put in order first, round after round.
    """
    top = rows.agg(F.max(at)).first()[0]
    fold: Column = F.last(value) if last else F.sum(value)
    here = lambda *by: fold.over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    if top is None or top < width:
        return rows.withColumn("prior", here(*keys))
    up = f"{at}_up"
    part = rows.withColumn(up, F.floor(F.col(at) / width))
    sums = part.groupBy(*keys, up).agg((F.max_by(value, at) if last else F.sum(value)).alias(value))
    above = prior(sums, keys, up, value, last, width).select(*keys, up, F.col("prior").alias("above"))
    own = here(*keys, up)
    both = F.coalesce(own, "above") if last else F.coalesce(own, F.lit(0)) + F.coalesce("above", F.lit(0))
    return part.join(above.hint("merge"), [*keys, up]).withColumn("prior", both).drop(up, "above")


@functools.cache
def database():
    """One DuckDB a worker, of one thread; beyond its memory it spills."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})


def in_shards(rows: DataFrame, by: list[str], n: int, name: str, sql: str, schema: str) -> DataFrame:
    """sql over table ``name`` in DuckDB, by shards of a hash of ``by``; n: rows in all."""
    ship(rows.sparkSession)
    shards = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // SHARD_ROWS + 1)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(part):
        import pyarrow as pa

        with database().cursor() as con:
            con.register(name, part)
            out = con.sql(sql).to_arrow_table().select(names)
        kinds = {"bigint": pa.int64(), "string": pa.string()}
        return out.cast(pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]))

    return rows.withColumn("shard", F.pmod(F.xxhash64(*by), F.lit(shards))).groupBy("shard").applyInArrow(run, schema)


def match(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, commits) of a log of (pos, stream, kind, key, mark, tie).

    kind is commit, abort, savepoint, rollback or change; stream is a string; mark stands for what a
    change stores, null for a deletion. Records of a stream with one pos must be of one kind; tie puts
    them in order, and records that are equal in everything count each. changes has every change with rolled_at, the rollback that
    undid it, ended_at, the end of its transaction (null: the log's), and ended_by. commits has stream,
    pos and number, from 1 over all streams, of the first commit at a place; ``same``, how many there
    are. Both are written tables.
    """
    log = scratch(log.repartitionByRange("pos", "stream", "tie").withColumn("block", F.spark_partition_id()), "log")
    ends = F.col("kind").isin("commit", "abort").cast("bigint")
    own = Window.partitionBy("block", "stream").orderBy("pos", "tie").rowsBetween(Window.unboundedPreceding, -1)
    totals = prior(log.groupBy("stream", "block").agg(F.sum(ends).alias("ends")), ["stream"], "block", "ends").select("stream", "block", "prior")
    placed = log.withColumn("ended", F.coalesce(F.sum(ends).over(own), F.lit(0))).join(totals.hint("merge"), ["stream", "block"])
    segment = F.floor((F.col("ended") + F.coalesce("prior", F.lit(0))) / TRANSACTIONS)
    placed = placed.select("stream", segment.alias("segment"), "pos", "tie", "kind", "key", "mark")
    changes = in_shards(placed, ["stream", "segment"], log.count(), "log", MATCH, "stream string, pos bigint, tie bigint, key bigint, mark bigint, rolled_at bigint, ended_at bigint, ended_by string")

    found = log.where("kind = 'commit'").groupBy("stream", "pos", "block").agg(F.count("*").alias("same"))
    blocks = prior(found.groupBy("block").agg(F.sum("same").alias("same")).withColumn("all", F.lit(0)), ["all"], "block", "same").select("block", "prior")
    before = F.sum("same").over(Window.partitionBy("block").orderBy("pos", "stream").rowsBetween(Window.unboundedPreceding, -1))
    # equal records may lie on both sides of a block's edge: the first block has the first of them
    numbered = found.withColumn("before", F.coalesce(before, F.lit(0))).join(blocks.hint("merge"), "block")
    number = F.col("before") + F.coalesce("prior", F.lit(0)) + 1
    commits = numbered.groupBy("stream", "pos").agg(F.min(number).alias("number"), F.sum("same").alias("same"))
    return scratch(changes, "changes"), scratch(commits, "commits")


def deltas(changes: DataFrame, commits: DataFrame, every: int = COMMITS) -> tuple[DataFrame, int]:
    """(deltas, epochs): by key and epoch the store's version (pos, mark), the one before it (prior_pos,
    prior_mark), and the number of epochs. An epoch is ``every`` commits, the last the rest."""
    total = commits.agg(F.sum("same")).first()[0] or 0
    kept = changes.where("rolled_at is null and ended_by = 'commit'")
    kept = kept.join(commits.select("stream", F.col("pos").alias("ended_at"), "number").hint("merge"), ["stream", "ended_at"])
    epoch = F.floor((F.col("number") - 1) / every) + 1
    # tie is only unlike 0 where one pos has several records
    versions = kept.groupBy("key", epoch.alias("epoch")).agg(F.max_by(F.struct("pos", "mark"), F.struct("number", "pos", "tie")).alias("v"))
    versions = scratch(versions.select("key", "epoch", F.floor(F.col("epoch") / EPOCHS).alias("stretch"), "v.pos", "v.mark"), "versions")
    lasts = versions.groupBy("key", "stretch").agg(F.max_by(F.struct("epoch", "pos", "mark"), "epoch").alias("v"))
    seeds = prior(lasts, ["key"], "stretch", "v", last=True).where("prior is not null").select("key", "prior.epoch", "stretch", "prior.pos", "prior.mark", F.lit(True).alias("seed"))
    both = versions.withColumn("seed", F.lit(False)).unionByName(seeds)
    found = in_shards(both, ["key", "stretch"], versions.count(), "versions", DELTA, "key bigint, epoch bigint, pos bigint, mark bigint, prior_pos bigint, prior_mark bigint")
    return found, -(-total // every)


def states(found: DataFrame, epochs: int) -> DataFrame:
    """(epoch, n, value): stored keys and the sum of their marks after each epoch, all epochs included."""
    has = lambda c: F.col(c).isNotNull().cast("bigint")
    zero = lambda c: F.coalesce(c, F.lit(0))
    added = found.groupBy("epoch").agg(F.sum(has("mark") - has("prior_mark")).alias("dn"), F.sum(zero("mark") - zero("prior_mark")).alias("dv"))
    rows = found.sparkSession.range(1, epochs + 1).withColumnRenamed("id", "epoch").join(added.hint("merge"), "epoch", "left")
    rows = scratch(rows.select("epoch", zero("dn").alias("dn"), zero("dv").alias("dv"), F.floor(F.col("epoch") / EPOCHS).alias("stretch")), "epochs")
    out = rows
    for c in ("dn", "dv"):
        own = F.sum(c).over(Window.partitionBy("stretch").orderBy("epoch"))
        sums = rows.groupBy("stretch").agg(F.sum(c).alias(c)).withColumn("all", F.lit(0))
        above = prior(sums, ["all"], "stretch", c).select("stretch", F.col("prior").alias(f"above_{c}"))
        out = out.withColumn(f"run_{c}", own).join(above.hint("merge"), "stretch")
    return out.select("epoch", *((F.col(f"run_{c}") + zero(f"above_{c}")).alias(k) for c, k in (("dn", "n"), ("dv", "value"))))


def records(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents as log records by the fixed rule: crc32 of the decimal doc_id picks the kind and the
    key; a change's mark is the crc32 of ``key:text``, null where the text is null or the document toxic.

    A row without a doc_id has no number to place it by and is no record. Of rows with one doc_id in one
    source the greater hash of the text is the later. An empty text is a value. Toxic is what any label
    of the doc_id says; labels without an id say nothing. Columns beyond these are not read.
    """
    toxic = labels.where((F.col("toxic") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("pos")).distinct()
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    code = h % KINDS
    kind = F.when(code <= 1, "commit").when(code == 2, "abort").when(code <= 4, "savepoint").when(code <= 6, "rollback").otherwise("change")
    key = F.floor(h / 100) % KEYS
    change = lambda c: F.when(code > 6, c)
    mark = change(F.crc32(F.concat(key.cast("string"), F.lit(":"), F.col("text")).cast("binary")))
    log = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("pos"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("stream"),
        kind.alias("kind"),
        change(key).alias("key"),
        mark.alias("mark"),
        change(F.xxhash64("text")).alias("tie"),
    )
    log = log.withColumn("tie", F.coalesce("tie", F.lit(0)))
    return log.join(toxic.withColumn("toxic", F.lit(1)).hint("merge"), "pos", "left").withColumn("mark", F.when(F.col("toxic").isNull(), F.col("mark"))).drop("toxic")


def reassemble(log: DataFrame, every: int = COMMITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(undone, deltas, states) of a log as match() takes it; undone has pos, key, by (rollback or abort)
    and undone_at (null: the log's end). An empty log gives empty tables."""
    changes, commits = match(log)
    undone = changes.where("rolled_at is not null or coalesce(ended_by, '') <> 'commit'")
    undone = undone.select("stream", "pos", "key", F.when(F.col("rolled_at").isNotNull(), "rollback").otherwise("abort").alias("by"), F.coalesce("rolled_at", "ended_at").alias("undone_at"))
    found, epochs = deltas(changes, commits, every)
    return undone, found, states(found, epochs)


def replay(spark, sf_dir: str) -> DataFrame:
    """(kind, id, n, value): states of the store by epoch, and each undone change."""
    undone, _, after = reassemble(records(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return after.select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), "n", "value").unionAll(undone.select("by", "pos", "undone_at", "key"))

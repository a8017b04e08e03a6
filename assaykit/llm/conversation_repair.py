"""Conversation structure repair by composition of weighted automata.

Three machines are composed: an acceptor of the conversation's rows, a transducer whose arcs are the
edits (keep, change of role, delete, insert) with their costs, and an acceptor of the roles wanted,
``(s?(ua)+)?``. States of the composition, (rows read, inserts since, grammar state), are made when they
are reached, in their topological order; weights are pairs of cost and label string, ordered by cost, then
by string, so the shortest path has the cheapest edits and, of these, the least string. At most two
inserts stand between rows: a third would come back to a grammar state at a cost.

Rows are dealt by range, so a long conversation lies in many partitions. Of each piece the weights from
every grammar state to every other are found there; pieces are put together by their weights alone, and
each piece's edits then go back to its rows. Only label strings, which are the result, are held whole.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.ship import map_batches
from assaykit.llm.common import scratch, table

BLANKS = " \t\n\x0b\f\r"
#: Costs of the edits, and of a row cut off that stays.
COSTS = {"K": 0, "R": 2, "I": 2, "D": 3}
CUT_OFF = 1
#: The grammar: next state by state and initial. State 0 is the start; 0 and 3 are final.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
#: What is written for an inserted or renamed row.
ROLES = {"u": "user", "a": "assistant"}
#: Inserts between two rows at most, and the label characters that a path may carry before what all
#: paths share is put away.
INSERTS, TAIL = 2, 64


def best(arrivals):
    """{state: weight}, the least of (state, weight) pairs."""
    out: dict = {}
    for q, w in arrivals:
        if q not in out or w < out[q]:
            out[q] = w
    return out


def inserted(weights: dict) -> dict:
    """Weights after up to INSERTS arcs that insert a row, layer by layer."""
    layer, seen = weights, list(weights.items())
    for _ in range(INSERTS):
        layer = best((GRAMMAR[q][x], (c + COSTS["I"], s + "I")) for q, (c, s) in layer.items() for x in ROLES if x in GRAMMAR[q])
        seen += layer.items()
    return best(seen)


def consumed(weights: dict, initial: str, must_go: bool, cut_off: bool) -> dict:
    """Weights after the arcs that read one row."""
    out, stays = [], CUT_OFF * cut_off
    for q, (c, s) in weights.items():
        out.append((q, (c + COSTS["D"], s + "D")))
        if not must_go:
            if initial in GRAMMAR[q]:
                out.append((GRAMMAR[q][initial], (c + COSTS["K"] + stays, s + "K")))
            out += [(GRAMMAR[q][x], (c + COSTS["R"] + stays, s + "R")) for x in ROLES if x in GRAMMAR[q]]
    return best(out)


class Paths:
    """Shortest paths from one grammar state; what all share is put away, as it can't change any more."""

    def __init__(self, enter: int):
        self.weights, self.shared = {enter: (0, "")}, []

    def read(self, initial: str, must_go: bool, cut_off: bool) -> None:
        self.step(consumed(inserted(self.weights), initial, must_go, cut_off))

    def step(self, weights: dict) -> None:
        self.weights = weights
        if len(next(iter(weights.values()))[1]) > TAIL:
            n = len(head := commonprefix([s for _, s in weights.values()]))
            self.shared.append(head)
            self.weights = {q: (c, s[n:]) for q, (c, s) in weights.items()}

    def found(self) -> dict:
        """{state: (cost, labels)}, whole."""
        head = "".join(self.shared)
        return {q: (c, head + s) for q, (c, s) in self.weights.items()}


def ended(weights: dict) -> tuple[int, tuple[int, str]]:
    """(state before the last inserts, weight) of the best way to a final state."""
    ways = []
    for q, w in weights.items():
        ways += [((c, s), q) for end, (c, s) in inserted({q: w}).items() if end in FINAL]
    w, q = min(ways)
    return q, w


def shortest(rows) -> tuple[int, str]:
    """(cost, labels) for rows of (initial, must go, cut off)."""
    paths = Paths(0)
    for r in rows:
        paths.read(*r)
    cost, labels = ended(paths.found())[1]
    return cost, labels


def edits(labels: str, initials: str, q: int):
    """(index of the row read or of the next row, order among its edits, label, role or None) of each label
    from grammar state q; None leaves the row's role."""
    i = sub = 0
    for x in labels:
        role = None
        if x == "K":
            q = GRAMMAR[q][initials[i]]
        elif x in "RI":
            role = next(r for r in ROLES if r in GRAMMAR[q])
            q = GRAMMAR[q][role]
        yield i, sub, x, ROLES.get(role)
        sub += 1
        if x != "I":
            i, sub = i + 1, 0


def with_faults(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faults, rows): rows of (conv_id, turn, role, text) as written, with ``at``, a number of their own,
    and without their texts, with ``fault``, the first of blank, duplicate and truncated that holds, else
    an empty string, and ``place``, a hash of the text."""
    rows = scratch(rows.withColumn("at", F.monotonically_increasing_id()), "turns")
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    seen = F.struct(F.xxhash64("role", "text").alias("h"), F.xxhash64(F.lit(1), "text", "role").alias("k"))
    narrow = rows.select("conv_id", "turn", "role", "at", F.length(F.btrim("text", F.lit(BLANKS))).alias("n"), end.alias("end"), seen.alias("seen"), F.xxhash64("text").alias("place"))
    # reduced before the shuffle: a row that occurs very often is one row a task
    first = narrow.groupBy("conv_id", "seen").agg(F.min(F.struct("turn", "at")).alias("first"))
    both = narrow.alias("x").join(first.alias("y"), F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & (F.col("x.seen") == F.col("y.seen")))
    again = F.struct("x.turn", "x.at") > F.col("y.first")
    fault = F.when(F.col("n") == 0, "blank").when(again, "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated").otherwise("")
    return both.select("x.conv_id", "x.turn", "x.role", "x.at", "x.place", fault.alias("fault")), rows


PIECE = "conv_id {kind}, block int, turns array<bigint>, ats array<bigint>, initials string, n_blank bigint, n_duplicate bigint, n_truncated bigint, n_illegal bigint, weights array<struct<enter:int,leave:int,cost:bigint,labels:string>>"


def pieces(rows: DataFrame, kind: str) -> DataFrame:
    """A row per conversation and partition that holds rows of it, in order of conversation, turn (null
    first), role, hash of the text: counts, and the weights from state to state. ``turns`` has the first
    and last turn there (null: none) and the number of different ones."""
    order = ["conv_id", "turn", "role", "place", "at"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", F.spark_partition_id().alias("block"), "turn", F.substring("role", 1, 1).alias("initial"), "at", "fault")
    names = ("conv_id", "block", "turn", "initial", "at", "fault")

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("conv_id", pa.int64() if kind == "bigint" else pa.string()), ("block", pa.int32()), ("turns", pa.list_(pa.int64())), ("ats", pa.list_(pa.int64())), ("initials", pa.string()), *((f"n_{k}", pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal")), ("weights", pa.list_(pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("labels", pa.string())])))])
        piece, paths, done = None, [], []

        def close():
            piece["initials"] = "".join(piece["initials"])
            piece["weights"] = [{"enter": e, "leave": q, "cost": c, "labels": s} for e, p in paths for q, (c, s) in p.found().items()]
            done.append(piece)

        for batch in batches:
            for c, b, turn, initial, at, fault in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)):
                if piece is None or c != piece["conv_id"]:
                    if piece:
                        close()
                    # only the first of a partition may go on from an earlier one
                    paths = [(e, Paths(e)) for e in (GRAMMAR if piece is None else (0,))]
                    piece = {"conv_id": c, "block": b, "turns": [None, None, 0], "ats": [], "initials": [], **{f"n_{k}": 0 for k in ("blank", "duplicate", "truncated", "illegal")}}
                elif piece["initials"][-1] + initial not in ("su", "ua", "au"):
                    piece["n_illegal"] += 1
                first, last, n = piece["turns"]
                if turn is not None:
                    piece["turns"] = [turn if first is None else first, turn, n + (turn != last)]
                piece["ats"].append(at)
                piece["initials"].append(initial or " ")  # an empty role has no initial of the grammar
                if fault:
                    piece[f"n_{fault}"] += 1
                for _, p in paths:
                    p.read(initial, fault in ("blank", "duplicate"), fault == "truncated")
            if len(done) > 1000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if piece:
            close()
            yield pa.RecordBatch.from_pylist(done, schema)

    return map_batches(dealt, run, PIECE.format(kind=kind))


WHOLE = "conv_id {kind}, block int, enter int, labels string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def put_together(found: DataFrame, kind: str) -> DataFrame:
    """Per piece its grammar state and labels on the best path (block not null), and per conversation its
    counts, cost and audit (block null). What is read holds no rows, only weights."""
    dealt = found.drop("ats").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    fields = [x.split()[0] for x in WHOLE.split(", ")]

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([(n, pa.string() if n in ("labels", "audit") or n == "conv_id" and kind != "bigint" else pa.int32() if n in ("block", "enter") else pa.int64()) for n in fields])
        done, held = [], None

        def close():
            q, (cost, tail) = ended(held["paths"].weights)
            labels = "".join([*held["paths"].shared, tail])
            first, last, n = held["turns"]
            done.append({"conv_id": held["conv_id"], "block": None, "gaps": 0 if first is None else last - first + 1 - n, **held["n"], "cost": cost, "audit": labels})
            # back over the pieces: the state in which each was entered
            way = []
            for block, backs in reversed(held["backs"]):
                e, part = backs[q]
                way.append((block, e, part))
                q = e
            at = 0
            for k, (block, e, size) in enumerate(reversed(way)):
                end = len(labels) if k + 1 == len(way) else at + size  # the last inserts are the last piece's
                done.append({"conv_id": held["conv_id"], "block": block, "enter": e, "labels": labels[at:end]})
                at = end

        for batch in batches:
            for r in batch.to_pylist():
                if held is None or r["conv_id"] != held["conv_id"]:
                    if held:
                        close()
                    held = {"conv_id": r["conv_id"], "paths": Paths(0), "backs": [], "turns": [None, None, 0], "n": dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), "last": None}
                # the joint of two pieces: the least of all ways over a state
                ways: dict = {}
                for w in r["weights"]:
                    if w["enter"] in held["paths"].weights:
                        c, s = held["paths"].weights[w["enter"]]
                        way = ((c + w["cost"], s + w["labels"]), (w["enter"], len(w["labels"])))
                        if w["leave"] not in ways or way < ways[w["leave"]]:
                            ways[w["leave"]] = way
                held["backs"].append((r["block"], {q: x for q, (_, x) in ways.items()}))
                held["paths"].step({q: w for q, (w, _) in ways.items()})
                for k in held["n"]:
                    held["n"][k] += r[f"n_{k}"]
                if held["last"] is not None and held["last"] + r["initials"][0] not in ("su", "ua", "au"):
                    held["n"]["illegal"] += 1
                held["last"] = r["initials"][-1]
                (first, last, n), (a, b, m) = held["turns"], r["turns"]
                if a is not None:
                    held["turns"] = [a if first is None else first, b, n + m - (a == last)]
            if len(done) > 1000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if held:
            close()
            yield pa.RecordBatch.from_pylist(done, schema)

    return map_batches(dealt, run, WHOLE.format(kind=kind))


EDITS = "conv_id {kind}, block int, i int, sub int, at bigint, label string, renamed string"


def edits_of(found: DataFrame, paths: DataFrame, kind: str) -> DataFrame:
    """The edits of each piece with the row (at, null for an insert) that they are made on."""
    p = paths.where("block is not null").select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "enter", "labels")
    both = found.select("conv_id", "block", "ats", "initials").join(p.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64() if kind == "bigint" else pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for r in batch.to_pylist():
                for i, sub, label, role in edits(r["labels"], r["initials"], r["enter"]):
                    for column, v in zip(out, (r["conv_id"], r["block"], i, sub, None if label == "I" else r["ats"][i], label, role)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=[x.split()[0] for x in EDITS.split(", ")])

    return map_batches(both, run, EDITS.format(kind=kind))


def repair(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries, rows) of conversations (conv_id, turn, role, text), other columns unread.

    summaries: per conversation gaps, blank, duplicate, truncated, illegal, cost and audit. rows: each edit
    in order of (block, i, sub) with its label, and the role and text that the row has after it; D stands
    for a row that goes. A conversation is all rows of one conv_id, null being one; rows are in order of
    turn, null first, then of role and a hash of the text. A null role or text is one space. Rows that are
    equal are duplicates of the first. An empty table gives empty tables.
    """
    kind = "bigint" if convs.schema["conv_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    faults, rows = with_faults(convs.select(F.col("conv_id").cast(kind), F.col("turn").cast("bigint"), own("role"), own("text")))
    found = scratch(pieces(faults, kind), "pieces")
    paths = scratch(put_together(found, kind), "paths")
    made = edits_of(found, paths, kind).join(rows.select("at", "role", "text"), "at", "left")
    texts = made.select("conv_id", "block", "i", "sub", "label", F.coalesce("renamed", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return paths.where("block is null").drop("block", "enter", "labels"), texts


def digests(rows: DataFrame, kind: str) -> DataFrame:
    """(conv_id, repaired_sha256) of the lines ``role:text`` that stay, newline-joined.

    A digest is a chain over all bytes of a conversation, which no split can shorten: its rows go through
    one task, sorted, and are hashed as they pass, never held."""
    lines = rows.where("label <> 'D'").select("conv_id", "block", "i", "sub", F.concat("role", F.lit(":"), "text").alias("line"))
    dealt = lines.repartition("conv_id").sortWithinPartitions("conv_id", "block", "i", "sub").select("conv_id", "line")

    def run(batches):
        import hashlib

        import pyarrow as pa

        schema = pa.schema([("conv_id", pa.int64() if kind == "bigint" else pa.string()), ("repaired_sha256", pa.string())])
        now, sha = None, None
        for batch in batches:
            done = []
            for c, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if sha is None or c != now:
                    if sha:
                        done.append((now, sha.hexdigest()))
                    now, sha = c, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(line.encode("utf-8", "surrogatepass"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], schema=schema)
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([now], schema.field(0).type), pa.array([sha.hexdigest()])], schema=schema)

    return map_batches(dealt, run, f"conv_id {kind}, repaired_sha256 string")


def damage(convs: DataFrame) -> DataFrame:
    """conversations with the contract's faults put in by crc32 of ``conv_id:turn``, nulls as one space:
    rows dropped, emptied, robbed of their full stops, repeated, or given to the user."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(own("text"), "[.!?]", "")).otherwise(own("text"))
    role = F.when(h == 4, "user").otherwise(own("role"))
    copies = F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return convs.where(h > 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def repaired_conversations(spark, sf_dir: str) -> DataFrame:
    """The damaged conversations' counts, cost, audit and digest, a row for every original conv_id."""
    convs = table(spark, sf_dir, "conversations")
    summaries, rows = repair(damage(convs))
    kind = summaries.schema["conv_id"].dataType.simpleString()
    ids = convs.select(F.col("conv_id").cast(kind).alias("id")).distinct()
    sums = digests(rows, kind).withColumnRenamed("conv_id", "c")
    both = ids.join(summaries, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(sums, F.col("id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(k, F.lit(0)).alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))

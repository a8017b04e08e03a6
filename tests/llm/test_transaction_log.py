"""The log's outcomes and store against a replay, record by record."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assaykit.llm import transaction_log as t


def replay(log, every=4):
    """(undone, states) of records (pos, stream, kind, key, mark) in order of pos."""
    open_, store, undone, states, commits = {}, {}, [], [], 0
    for pos, stream, kind, key, mark in sorted(log):
        txn = open_.setdefault(stream, [])  # changes, and None for a savepoint
        if kind == "savepoint":
            txn.append(None)
        elif kind == "change":
            txn.append((pos, key, mark))
        elif kind == "rollback":
            while txn and (last := txn.pop()) is not None:
                undone.append((last[0], "rollback", pos, last[1]))
        else:
            for x in open_.pop(stream):
                if x and kind == "abort":
                    undone.append((x[0], "abort", pos, x[1]))
                elif x:
                    store.pop(x[1], None) if x[2] is None else store.update({x[1]: x[2]})
            commits += kind == "commit"
            if kind == "commit" and commits % every == 0:
                states.append((commits // every, len(store), sum(store.values())))
    undone += [(x[0], "abort", None, x[1]) for txn in open_.values() for x in txn if x]
    if commits % every:
        states.append((commits // every + 1, len(store), sum(store.values())))
    return Counter(undone), sorted(states)


def reassembled(spark, log):
    rows = spark.createDataFrame([(*r, 0) for r in log], "pos long, stream string, kind string, key long, mark long, tie long")
    undone, _, states = t.reassemble(rows.repartition(3))
    return Counter((r.pos, r.by, r.undone_at, r.key) for r in undone.collect()), sorted(map(tuple, states.collect()))


def made(n, seed, streams, weights):
    r = random.Random(seed)
    kinds = ("commit", "abort", "savepoint", "rollback", "change")
    return [(i * 3, r.choice(streams), r.choices(kinds, weights)[0], r.randrange(7), r.choice((None, r.randrange(100)))) for i in range(n)]


@pytest.mark.parametrize("seed, weights", [(1, (2, 1, 2, 2, 16)), (2, (1, 1, 20, 25, 40)), (3, (30, 5, 1, 1, 5))])
def test_replay(spark, monkeypatch, seed, weights):
    # a third of the rows in one stream; short segments, stretches and windows, so that all edges occur
    for name, v in (("TRANSACTIONS", 3), ("EPOCHS", 4), ("WIDTH", 2)):
        monkeypatch.setattr(t, name, v)
    log = made(600, seed, ["s1"] * 4 + ["", "s2", "s3", "s4"], weights)
    assert reassembled(spark, log) == replay(log)


def test_nested_savepoints(spark):
    kinds = "change savepoint change savepoint change rollback change rollback change rollback change commit".split()
    log = [(i, "s", k, i, i if k == "change" else None) for i, k in enumerate(kinds)]
    want = replay(log)
    assert reassembled(spark, log) == want
    assert want[0] == Counter([(4, "rollback", 5, 4), (2, "rollback", 7, 2), (6, "rollback", 7, 6), (0, "rollback", 9, 0), (8, "rollback", 9, 8)])


def test_empty_logs(spark):
    assert reassembled(spark, []) == (Counter(), [])
    assert reassembled(spark, [(1, "", "change", 2, 3)]) == (Counter([(1, "abort", None, 2)]), [])
    assert reassembled(spark, [(1, "", "commit", None, None)]) == (Counter(), [(1, 0, 0)])


def test_prior_in_rounds(spark):
    rows = spark.range(50).select(F.lit("k").alias("k"), F.col("id").alias("at"), (F.col("id") + 1).alias("v"))
    summed = {r["at"]: r["prior"] for r in t.prior(rows, ["k"], "at", "v", width=3).collect()}
    assert all((summed[i] or 0) == i * (i + 1) // 2 for i in range(50))
    last = {r["at"]: r["prior"] for r in t.prior(rows, ["k"], "at", "v", last=True, width=3).collect()}
    assert all(last[i] == (i or None) for i in range(50))


def records_of(docs, toxic):
    out = []
    for i, text, source in docs:
        h = zlib.crc32(str(i).encode())
        kind = {0: "commit", 1: "commit", 2: "abort", 3: "savepoint", 4: "savepoint", 5: "rollback", 6: "rollback"}.get(h % 23, "change")
        key = h // 100 % 300
        out.append((i, "" if source is None else f"s{source}", kind, key, None if text is None or i in toxic else zlib.crc32(f"{key}:{text}".encode())))
    return out


def test_documents(spark):
    r = random.Random(5)
    docs = [(i, r.choice([None, "", "é😀", "a" * 200_000, f"text {i}"]), r.choice([None, "", "a", "b"])) for i in range(-20, 400)]
    toxic = {i for i, *_ in docs if r.random() < 0.1}
    odd = [(i, x, s, "x", 1) for i, x, s in docs] + [(None, "no id", "a", "x", 1)]
    df = spark.createDataFrame(odd, "doc_id long, text string, source string, kind string, stream int").repartition(3)
    labels = spark.createDataFrame([(i, 0, 1) for i in toxic] * 2 + [(0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    undone, deltas, states = t.reassemble(t.records(df, labels))
    want = replay(records_of(docs, toxic))
    assert Counter((x.pos, x.by, x.undone_at, x.key) for x in undone.collect()) == want[0]
    assert sorted(map(tuple, states.collect())) == want[1]
    # the deltas of a key form a chain
    by_key = {}
    for x in sorted(deltas.collect(), key=lambda x: x.epoch):
        assert (x.prior_pos, x.prior_mark) == by_key.get(x.key, (None, None))
        by_key[x.key] = (x.pos, x.mark)
    empty = t.records(df.limit(0), labels)
    assert [x.count() for x in t.reassemble(empty)] == [0, 0, 0]


def test_repeated_rows(spark):
    """Equal records count each: two commits are one of the changes and an empty one."""
    commit = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 23 < 2)
    rows = [(commit, "x", "a")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, t.reassemble(t.records(df, labels))[2].collect())) == [(1, 0, 0), (2, 0, 0)]

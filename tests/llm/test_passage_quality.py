"""The bag classifier: its gradients, what it says of documents held out, and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import passage_quality as pq

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_gradients():
    rng = np.random.default_rng(1)
    w = {"embed": (pq.WIDTH, 5), "embed0": (5,), "look": (5, 3), "gate": (5, 3), "attend": (3,), "out": (5,), "out0": (1,)}
    w = {k: rng.normal(0, 0.5, v) for k, v in w.items()}
    sizes, labels = np.array([1, 4, 2]), np.array([1, 0, 1])
    x = rng.normal(0, 1, (7, pq.WIDTH))

    def loss():
        z = pq.forward(w, x, sizes)["logit"]
        return np.mean(np.logaddexp(0, z) - labels * z)

    found = pq.gradients(w, x, sizes, labels)
    for name, g in found.items():
        at = tuple(rng.integers(0, n) for n in w[name].shape)
        was, step = w[name][at], 1e-6
        w[name][at] = was + step
        up = loss()
        w[name][at] = was - step
        down = loss()
        w[name][at] = was
        assert abs((up - down) / (2 * step) - g[at]) < 1e-6, name


def test_attention_finds_the_passage():
    """Bags are bad by one passage of eight; nothing says which."""
    rng = np.random.default_rng(2)
    bags, labels, bad = [], [], []
    for i in range(600):
        bag = rng.normal(0, 1, (8, pq.WIDTH)).astype(np.float32)
        at = int(rng.integers(8))
        if i % 2:
            bag[at, :6] += 4
        bags.append(bag), labels.append(1 - i % 2), bad.append(at)
    net = pq.learn(bags[:400], labels[:400])
    scores, attention = net.read(bags[400:])
    right = (scores >= 0.5) == np.array(labels[400:])
    found = [a.argmax() == b for a, b, y in zip(attention, bad[400:], labels[400:]) if y == 0]
    assert right.mean() >= 0.95 and np.mean(found) >= 0.9


def test_held_out_documents(tables):
    docs, labels = tables
    rows = pq.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    known = {r.doc_id: r.quality for r in labels.collect()}
    got = [(r.score, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    good, bad = ([s for s, q in got if q == k] for k in (1, 0))
    assert len(bad) > 10 and np.mean([g > b for g in good for b in bad]) >= 0.95
    assert np.mean([(s >= 0.7) == q for s, q in got]) >= 0.95


def test_reads_labels_of_its_folds_only(tables):
    """Labels held out, and the other columns, change nothing."""
    docs, labels = tables
    want = {r.doc_id: r.score for r in pq.classify(docs, labels).collect()}
    other = labels.withColumn("quality", F.when(pq.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.lit(0))
    moved = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.col("text")).repartition(7)
    assert {r.doc_id: r.score for r in pq.classify(moved, other).collect()} == pytest.approx(want, abs=1e-9)


def test_encoding_covers_the_whole_text():
    pq._ready()
    words = [f"word{i % 97}" for i in range(100_000)]
    bag = pq.encode(" ".join(words).encode())
    assert len(bag) == round(len(words) / pq.PASSAGE)
    changed = pq.encode(" ".join(words[:-1] + ["###!!!"]).encode())
    assert (bag[:-1] == changed[:-1]).all() and (bag[-1] != changed[-1]).any()
    for text in ("", " \n\t", "x", "\n\nx y", "é😀 \x00 A1", "a" * 10**6):
        assert np.isfinite(pq.encode(text.encode())).all()
    n = len(pq.MARKS) + 6
    assert pq.encode(b"one two two\none two two")[0][n + 3] == pytest.approx(2 / 6)  # words equal to the last
    assert pq.encode(b"one two two\none two two")[0][n + 4] == pytest.approx(1 / 2)  # words on lines seen before


def test_odd_rows(spark, tables):
    docs, labels = tables
    odd = [(None, "some words here", 1.0, 1), (None, None, 2.0, 2), (7, "", 0.0, 3), (7, "", 0.0, 3), (8, None, 0.0, 3), (9, "long " * 300_000, 0.0, 3)]
    rows = spark.createDataFrame(odd, "doc_id long, text string, score double, predicted int")
    both = docs.withColumns({"score": F.lit(0.5), "predicted": F.lit(9)}).unionByName(rows, allowMissingColumns=True)
    mixed = labels.unionByName(spark.createDataFrame([(None, 1, 0), (7, None, 0), (8, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int"))
    got = pq.classify(both, mixed).collect()
    assert len(got) == docs.count() + len(odd)
    assert sum(r.doc_id is None and not r.held_out for r in got) == 2
    empty = {r.score for r in got if r.n_passages == 1 and r.doc_id in (7, 8) and r.top_weight == 1.0}
    assert all(0 <= s <= 1 for s in empty)


def test_nothing_to_learn(spark, tables):
    docs, labels = tables
    assert pq.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in pq.classify(docs.limit(5), labels.limit(0)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1, 0) for i in range(8) if not held(i)], "doc_id long, quality int, toxic int")
    few = docs.where("doc_id < 5")
    n = ones.join(few, "doc_id").count()
    assert {r.score for r in pq.classify(few, ones).collect()} == {(n + 1) / (n + 2)}

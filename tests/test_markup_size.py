"""Checks of markup: work and memory that grow with the tags, not with their pairs or the batch."""

import time

from assaykit.operators import markup


def test_a_page_of_many_labels_and_controls(spark):
    n = 12000
    page = "".join(f'<label for="a{i}">x</label><input id="{"a" if i % 2 else "b"}{i}">\n' for i in range(n))
    files = spark.createDataFrame([("p", page), ("none", None), ("q", '<input id="a1"><label htmlFor="a1"/>')], "path string, text string")
    markup.checks(files.where("path = 'q'")).collect()
    began = time.perf_counter()
    got = {(r.path, r.state): r["n"] for r in markup.checks(files).groupBy("path", "state").count().withColumnRenamed("count", "n").collect()}
    assert got == {("p", "fine"): n // 2, ("p", "hit"): n // 2, ("q", "fine"): 1}
    assert time.perf_counter() - began < 30


def test_texts_are_read_in_bounded_pieces():
    import pyarrow as pa

    texts = ["x" * 1000] * 1000 + [None, "y" * (2 * markup.PIECE_BYTES), ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["key", "text"])
    found = list(markup.pieces(batch))
    assert [k for p in found for k in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(sum(len(t or "") for t in p.column(1).to_pylist()[:-1]) < markup.PIECE_BYTES for p in found)

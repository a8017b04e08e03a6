"""A model in shards gives what a whole one gives."""

import pytest

from assaykit.llm import language_id as lid


def test_any_number_of_shards_is_one_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs = docs.unionAll(spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", None, 0), (9002, "ж" * 500, None, None, 0)], docs.schema))
    one = {(r.doc_id, r.text): r for r in lid.identify(docs).collect()}
    many = lid.identify(docs, max_cells=20_000)
    assert len(lid.train(lid.ngram_counts(docs), 20_000).shards) > 3
    rows = many.collect()
    assert len(rows) == len(one) == 63
    for r in rows:
        w = one[r.doc_id, r.text]
        assert (r.lid_pred, r.lid_rejected, r.lid_symbols) == (w.lid_pred, w.lid_rejected, w.lid_symbols)
        assert r.lid_score == pytest.approx(w.lid_score, abs=1e-5) and r.lid_bits == pytest.approx(w.lid_bits, rel=1e-4)

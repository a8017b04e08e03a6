import tracemalloc
import zlib

import numpy as np
import pytest

from assaykit.llm import language_id as lid

SAMPLE = "/root/testdata/sf0.001/documents.parquet"


def direct_probability(counts, context, symbol, alphabet):
    """Interpolated Kneser-Ney from the definition, over a Counter of 4-symbol tuples."""
    tables = {4: dict(counts)}
    for n in (3, 2, 1):
        t = {}
        for g in tables[n + 1]:
            t[g[1:]] = t.get(g[1:], 0) + 1
        tables[n] = t

    def p(ctx, n):
        if n == 0:
            return 1 / (alphabet + 1)
        t = tables[n]
        once, twice = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
        d = min(max(once / max(once + 2 * twice, 1) if once else 0.5, 0.05), 0.95)
        own = {g: v for g, v in t.items() if g[:-1] == ctx}
        total = sum(own.values())
        if not total:
            return p(ctx[1:], n - 1)
        return max(own.get((*ctx, symbol), 0) - d, 0) / total + d * len(own) / total * p(ctx[1:], n - 1)

    return p(context, 4)


def test_probabilities_match_the_definition():
    from collections import Counter

    raws = [b"abracadabra", b"a cab", b"bad dab"]
    symbols, _, _ = lid._symbols(raws)
    grams = lid._ngrams(symbols)
    grams = grams[grams != 0]
    keys, counts = np.unique(grams, return_counts=True)
    model = lid.Model(["x"], keys, np.zeros(len(keys), np.int64), counts)
    split = lambda g: tuple(int(g) >> 16 * i & 0xFFFF for i in (3, 2, 1, 0))
    table = Counter({split(g): int(n) for g, n in zip(keys, counts)})
    alphabet = len({g[-1] for g in table})
    for text in (b"abra", b"dcba z", b"qq"):
        bits, n, _ = model.entropies([text])
        seen = lid._ngrams(lid._symbols([text])[0])
        want = -sum(np.log2(direct_probability(table, split(g)[:3], split(g)[3], alphabet)) for g in seen[seen != 0]) / n[0]
        assert bits[0, 0] == pytest.approx(want, rel=1e-5)


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet(SAMPLE)
    rows = lid.identify(docs).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.lid_held_out and r.lid_symbols >= 20]
    assert all(r.lid_held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert held and sum(r.lid_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.lid_score <= 1 for r in rows)
    assert sum(r.lid_rejected for r in rows) <= 0.01 * len(rows)


def test_odd_cases(spark):
    train = [(i, t, l, "p") for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30)]
    odd = [(100, None, "en", "p"), (101, "", None, "p"), (102, "123 $$$", "de", "p"), (103, "the dog", None, "p"), (None, "die katze", "fr", None), (103, "the dog", None, "p"), (105, "ж" * 3000, None, "p")]
    df = spark.createDataFrame(train + odd, "doc_id long, text string, lang string, pred string")
    by = {}
    for r in lid.identify(df).where("doc_id is null or doc_id >= 100").collect():
        by.setdefault(r.doc_id, []).append(r)
    assert [by[k][0].lid_pred for k in (100, 101, 102)] == ["und"] * 3 and [by[k][0].lid_score for k in (100, 101, 102)] == [0.0] * 3
    assert [r.lid_pred for r in by[103]] == ["en", "en"] and by[None][0].lid_pred == "de"
    assert by[105][0].lid_rejected and by[102][0].lid_rejected and not by[103][0].lid_rejected
    kept = lid.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == 63
    assert lid.identify(df.limit(0)).count() == 0


def test_memory_of_a_batch_is_bounded():
    """Eight megabytes of texts in one call: the bits of each text alone, held in small pieces."""
    texts = [f"some words of the {i}th text and ".encode() * 1000 for i in range(250)]
    keys, counts = np.unique(lid._ngrams(lid._symbols(texts[:2])[0]), return_counts=True)
    model = lid.Model(["a"], keys[keys != 0], np.zeros(len(keys[keys != 0]), np.int64), counts[keys != 0])
    tracemalloc.start()
    bits, count, letters = model.sums(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    for i in (0, 124, 249):
        alone = model.sums([texts[i]])
        assert (alone[0][0], alone[1][0], alone[2][0]) == (bits[i], count[i], letters[i])

"""The near-duplicate stage of the pipeline against all pairs."""

import random

import corpus_pipeline


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def linked(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def groups(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and linked(sets[i], sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_edited_copies_leave_one(spark):
    rng = random.Random(8)
    texts = ["", None, "a b", "A  b", "a c"]
    for k in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        texts += [" ".join(base), *(" ".join(edited(rng, base, n)) for n in (len(base) // 60, len(base) // 50, len(base) // 20))]
    want = {i for i, r in enumerate(groups(texts)) if r == i}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} == want
    assert len(want) <= len(texts) - 40
    assert corpus_pipeline.drop_near_duplicates(spark, df.limit(0), "").count() == 0


def test_rows_without_or_with_repeated_ids(spark):
    rng = random.Random(9)
    a, b, c, d = ([f"w{rng.randrange(3000)}" for _ in range(100)] for _ in range(4))
    near = " ".join(edited(rng, a, 1))
    a, b, c, d = map(" ".join, (a, b, c, d))
    rows = [(1, a), (1, a), (1, near), (2, b), (2, c), (None, d), (None, d), (None, b), (3, near)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()]
    first = [r for r in got if r[0] == 1]
    assert len(first) == 1 and first[0][1] in (a, near)
    assert sorted((r for r in got if r[0] != 1), key=str) == sorted([(2, b), (2, c), (None, d)], key=str)

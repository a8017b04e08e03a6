import random

import numpy as np
from xxhash import xxh64_intdigest

from assaykit.llm import simhash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [sum(xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute(values):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def flipped(rng, value, n):
    for b in rng.sample(range(64), n):
        value ^= 1 << b
    return value


def test_trie_links_match_all_pairs():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = np.unique(np.array([flipped(rng, rng.choice(base), rng.randint(0, 9)) for _ in range(900)], np.uint64))
    member, root = simhash.trie_links(values, 0)
    got = list(range(len(values)))
    for m, r in zip(member, root):
        got[m] = r
    assert got == brute([int(v) for v in values])


def test_components_of_fingerprints(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(10):  # chains: the ends are far apart
        v = rng.choice(values)
        for _ in range(6):
            v = flipped(rng, v, 4)
            values.append(v)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    for blocks in (5, 6):
        comps = {r.node: r.root for r in simhash.components(simhash.link_stars(fps, len(values), blocks=blocks)).collect()}
        names = [comps.get(v, v) for v in signed]
        want = brute(values)
        assert len(set(names)) == len(set(want)) == len(set(zip(names, want)))


def test_documents_with_odd_cases(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, text), (3, text.upper()), (4, None), (9, ""), (7, " \t\n"), (1, "lone"), (2, "a b c"), (2, "a b c"), (None, text), (8, "Ünï ÜNÏ x y z")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.fp % (1 << 64)) for r in got) == sorted((i or 0, fingerprint(t)) for i, t in rows)
    by = {r.doc_id: r.component_id for r in got}
    assert (by[5], by[3], by[None], by[4], by[9], by[7], by[2], by[1]) == (3, 3, 3, 4, 4, 4, 2, 1)
    assert simhash.near_duplicates(df.limit(0)).count() == 0

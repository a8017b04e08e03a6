"""The near-copy stage takes op8's links first: fingerprints within its budget, by its tries."""

from assaykit.llm import near_copies, simhash


def test_pairs_of_near_fingerprints(spark):
    rows = [(1, 0b0), (2, 0b0), (3, 0b1111), (4, 0b111111110), (5, -1), (6, 0b11111), (7, -1 ^ 0b101)]
    got = {tuple(r) for r in near_copies._by_fingerprint(spark.createDataFrame(rows, "row bigint, fp bigint")).collect()}
    root = {n: n for n, _ in rows}
    for a, b in sorted(got):
        x, y = sorted((root[a], root[b]))
        root = {k: x if v == y else v for k, v in root.items()}
    want = {n: n for n, _ in rows}
    for a, x in rows:
        for b, y in rows:
            if bin((x ^ y) & (2**64 - 1)).count("1") <= simhash.BUDGET:
                u, v = sorted((want[a], want[b]))
                want = {k: u if r == v else r for k, r in want.items()}
    assert root == want and all(a > b for a, b in got)

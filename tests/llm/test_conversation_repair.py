"""Repairs against a recursion over all edits, and conversations that lie in many partitions."""

import hashlib
import random
import sys
from functools import cache

import pytest

from assaykit.llm import conversation_repair as cr

sys.setrecursionlimit(20_000)
BLANK = set(" \t\n\x0b\f\r")


def least(rows):
    """(cost, audit) over rows of (initial, must go, cut off), from the last row on."""

    @cache
    def best(i, state, runs):
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, ""))
        grow = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        if runs < 4:
            c, s = best(i, grow, runs + 1)
            ways.append((c + 2, "I" + s))
        if i < len(rows):
            initial, must, cut = rows[i]
            c, s = best(i + 1, state, 0)
            ways.append((c + 3, "D" + s))
            if not must:
                c, s = best(i + 1, grow, 0)
                ways.append((c + 2 + cut, "R" + s))
                if initial == grow or initial == "s" and state == "":
                    c, s = best(i + 1, initial, 0)
                    ways.append((c + cut, "K" + s))
        return min(ways, default=(10**9, ""))

    return best(0, "", 0)


def brute(rows):
    """The result for one conversation's (turn, role, text)."""
    rows = sorted(([t, " " if r is None else r, " " if x is None else x] for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = [c for c in text if c not in BLANK]
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    cost, audit = least(tuple((r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults)))
    out, state, i = [], "", 0
    for x in audit:
        grow = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        if x == "K":
            state = rows[i][1][0]
            out.append(f"{rows[i][1]}:{rows[i][2]}")
        elif x != "D":
            state = grow
            out.append({"u": "user:", "a": "assistant:"}[grow] + (rows[i][2] if x == "R" else ""))
        i += x != "I"
    turns = [r[0] for r in rows if r[0] is not None]
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def repaired(spark, convs, kind="long", parts=3):
    odd = [(c, t, r, x, 1, "q") for c, t, r, x in convs]
    df = spark.createDataFrame(odd, f"conv_id {kind}, turn long, role string, text string, at int, block string").repartition(parts)
    summaries, rows = cr.repair(df)
    sums = {r.conv_id: r.repaired_sha256 for r in cr.digests(rows, summaries.schema["conv_id"].dataType.simpleString()).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sums.get(r.conv_id, nothing)) for r in summaries.collect()}


def wanted(convs):
    by: dict = {}
    for c, *row in convs:
        by.setdefault(c, []).append(row)
    return {c: brute(rows) for c, rows in by.items()}


def made(seed, n, turns):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", "é😀?", "Why? ", "a" * 50_000 + ".", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    return [(c, r.choice([i, i, i, i + 3, None]), r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"{c} {i}.") for c in range(n) for i in range(r.randrange(1, turns))]


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    convs = made(seed, 60, 9)
    # ties in turn are in an order of their own: keep those out of this test
    seen = set()
    convs = [x for x in convs if (x[0], x[1]) not in seen and not seen.add((x[0], x[1]))]
    convs += [(None, i, "user", "one.") for i in range(4)]
    assert repaired(spark, convs) == wanted(convs)


def test_shortest_paths():
    r = random.Random(3)
    for _ in range(400):
        rows = tuple((r.choice("suax"), r.random() < 0.2, r.random() < 0.2) for _ in range(r.randrange(9)))
        assert cr.shortest(rows) == least(rows)


def test_long_paths_share_their_heads():
    rows = tuple((random.Random(i).choice("suua"), i % 7 == 0, i % 5 == 0) for i in range(300))
    assert cr.shortest(rows) == least(rows)


def test_conversation_in_many_partitions(spark):
    """One conversation holds most rows, and range partitions cut it: its pieces are joined at every state."""
    r = random.Random(4)
    roles = ["user", "assistant", "assistant", "system", "user"]
    convs = [(5, i, r.choice(roles), r.choice(["Same.", f"own {i}.", f"open {i}", " "])) for i in range(300)]
    convs += [(c, i, "user", f"{c} {i}!") for c in (1, 9) for i in range(5)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        faults, _ = cr.with_faults(spark.createDataFrame(convs, "conv_id long, turn long, role string, text string"))
        assert cr.pieces(faults, "bigint").where("conv_id = 5").count() > 1
        assert repaired(spark, convs) == wanted(convs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_rows_ties_and_nulls(spark):
    equal = [(1, 0, "user", "Hello."), (1, 0, "user", "Hello."), (1, None, None, None), (1, 1, "assistant", "Hi."), (2, None, "", "x"), (None, None, "user", None)]
    assert repaired(spark, equal) == wanted(equal)
    tied = [(1, 0, "user", "b."), (1, 0, "assistant", "a."), (1, 0, "user", "b.")]
    assert repaired(spark, tied)[1][:6] == brute([x[1:] for x in tied])[:6]


def test_text_ids_and_empty_table(spark):
    convs = [("x", 0, "user", "A."), ("x", 1, "assistant", "B."), (None, 0, "assistant", "C")]
    assert repaired(spark, convs, "string") == wanted(convs)
    assert repaired(spark, []) == {}


def test_all_rows_go(spark):
    assert repaired(spark, [(1, 0, "user", ""), (1, 1, "assistant", " ")]) == {1: (0, 2, 0, 0, 0, 6, "DD", hashlib.sha256(b"").hexdigest())}

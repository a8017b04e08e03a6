"""Buckets of many near copies: every link in them counts, in one pass and cut into blocks."""

import random

import numpy as np
import pytest

from assaykit.llm import common, near_copies
from tests.llm.test_near_copies import edited, groups


def copies():
    """Copies of one original, each but a few edits from it, most pairs of them just under the similarity;
    and chains from one to the next."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    texts = [" ".join(edited(rng, base, rng.choice((2, 3, 4, 5)))) for _ in range(100)]
    for _ in range(4):
        words = edited(rng, base, 4)
        for _ in range(8):
            words = edited(rng, words, 2)
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("block", [near_copies.BLOCK, 16])
def test_every_link_of_a_large_bucket_counts(spark, block):
    texts = copies()
    want = groups(texts)
    assert 10 < len(set(want)) < len(texts) - 10
    rows = common.scratch(spark.createDataFrame(list(enumerate(texts)), "row bigint, text string"), "rows")
    sets = common.scratch(near_copies._sets(rows, near_copies.SHINGLE), "sets")
    found = {r.node: r.root for r in near_copies.groups(sets, rows, block=block).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == want


def test_there_is_one_pass(spark, monkeypatch):
    """Its jobs do not grow with the rounds that a bucket would need: what links connect is found once."""
    calls = []
    monkeypatch.setattr(near_copies, "components", lambda links, f=near_copies.components: calls.append(1) or f(links))
    rows = spark.createDataFrame(list(enumerate(copies())), "doc_id long, text string")
    near_copies.keep_one(rows).count()
    assert len(calls) == 1


def test_joining_compares_other_sides_only():
    sets = [np.arange(x, x + 20, dtype=np.uint64) for x in (0, 1, 100, 101, 0)]
    root = np.array([0, 1, 2, 3, 4])
    assert near_copies.joining(sets, root, np.zeros(5)) == [(0, 1), (0, 4), (2, 3)]
    assert near_copies.joining(sets, root, np.array([0, 0, 0, 1, 1])) == [(0, 4), (1, 4), (2, 3)]
    assert near_copies.joining(sets, np.array([0, 0, 2, 2, 0]), np.zeros(5)) == []

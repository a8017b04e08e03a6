"""Texts of the near-copy stage that no other text is like are not shuffled, whatever the size of the tables."""

import random

import pytest

from assaykit.llm import common, near_copies
from tests.llm.test_near_copies import edited


def shuffled(spark) -> int:
    """Bytes that the shuffles of the session have written so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(60000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.fixture
def no_small_tables(spark):
    """Joins as on large tables: none is broadcast unless the code says so."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, -1)
    yield
    spark.conf.set(key, old)


def test_only_texts_that_are_compared_are_shuffled(spark, no_small_tables):
    rng = random.Random(4)
    base = [[f"{rng.getrandbits(128):x}" for _ in range(1000)] for _ in range(150)]
    texts = [" ".join(x) for x in base] + [" ".join(edited(rng, base[i], 2)) for i in range(5)]
    size = sum(map(len, texts))
    docs = common.scratch(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "docs")
    before = shuffled(spark)
    got = {r.doc_id for r in near_copies.keep_one(docs).collect()}
    assert got == set(range(150))
    # 10 of 155 texts are compared, and each row has 36 keys; before, all texts went through shuffles twice
    assert shuffled(spark) - before < size // 3


def test_too_many_bitmaps_change_nothing(spark, monkeypatch, no_small_tables):
    monkeypatch.setattr(common, "MAPS", 0)
    rng = random.Random(6)
    base = [[f"w{rng.randrange(3000)}" for _ in range(100)] for _ in range(20)]
    texts = [" ".join(edited(rng, x, n)) for x in base for n in (0, 1, 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in near_copies.keep_one(df).collect()} == set(range(0, 60, 3))


@pytest.mark.parametrize("most", [common.MAPS, 3])
def test_among_is_a_semi_join(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MAPS", most)
    rng = random.Random(5)
    at = [0, 1, 7, 8, 32767, 32768, 32769, 65535, (1 << 33) - 1, 1 << 33, (1 << 33) + 5, (5 << 33) + 32768, *(rng.randrange(1 << 36) for _ in range(50)), *(rng.randrange(1 << 16) for _ in range(300))]
    ids = [x for x in at if rng.random() < 0.5]
    df = spark.createDataFrame([(x, f"t{x}", 1) for x in at], "row long, __at string, __BITS int")
    got = common.among(df, "row", spark.createDataFrame([(x,) for x in ids * 2 + [3]], "id long"))
    assert got.columns == df.columns
    assert sorted(r[0] for r in got.collect()) == sorted(x for x in at if x in set(ids))
    assert common.among(df, "row", spark.createDataFrame([], "id long")).count() == 0

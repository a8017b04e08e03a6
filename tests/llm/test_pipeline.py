"""Each stage of the pipeline on its own input, against plain versions."""

import numpy as np
import pytest

import corpus_pipeline
from assaykit.llm import common, mixing
from tests.llm.test_free_ops import plain
from tests.llm.test_near_copies import groups as brute_groups
from tests.llm.test_passages import brute as brute_passages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = common.table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.scratch(stage(spark, out[-1], SF), name))
    return out


def test_columns_stay_until_the_last(stages):
    assert [d.columns for d in stages[:-1]] == [stages[0].columns] * 5
    assert stages[5].columns[:5] == stages[0].columns and "rate" in stages[5].columns


def test_clean_documents_have_a_language(stages):
    before, after = stages[0].count(), stages[1].count()
    assert 0.98 * before <= after <= before


def test_repeated_lines_go(stages):
    docs = [(r.doc_id, r.text) for r in stages[1].orderBy("doc_id").collect()]
    want = {i: t for (i, old), t in zip(docs, brute_passages(docs).values()) if t == old or t.strip(" ")}
    got = {r.doc_id: (r.text, r.n_chars) for r in stages[2].collect()}
    assert {i: t for i, (t, _) in got.items()} == want and all(len(t) == n for t, n in got.values())


def test_one_of_each_group_stays(stages):
    docs = [(r.doc_id, r.text) for r in stages[2].orderBy("doc_id").collect()]
    assert {r.doc_id for r in stages[3].collect()} == {docs[r][0] for r in set(brute_groups([t for _, t in docs]))}


def test_no_item_is_left(spark, stages):
    items = [plain(r.text) for r in common.table(spark, SF, "benchmark").collect()]
    kept = {r.doc_id for r in stages[4].collect()}
    rows = stages[3].collect()
    assert not any(t in plain(r.text) for r in rows if r.doc_id in kept for t in items)
    gone = [r for r in rows if r.doc_id not in kept]
    assert len(gone) <= 0.1 * len(rows)


def test_the_mix_is_that_of_a_direct_solver(spark, stages):
    labels = mixing.quality_labels(common.table(spark, SF, "labels"))
    rows = mixing.mix(stages[4], labels).collect()
    names = list(mixing.WEIGHTS)
    p = np.array([[r[f"posterior_{k}"] for k in names] for r in rows])
    n = np.array([r.n_tokens for r in rows], float)
    unwanted = [i for i, k in enumerate(names) if not mixing.WEIGHTS[k]]
    out = (p[:, unwanted] >= p.max(1, keepdims=True)).any(1)
    assert all(r.rate == 0 for r, o in zip(rows, out) if o)
    q, m = p[~out], n[~out]
    goal = np.array([mixing.WEIGHTS[k] for k in names])
    brought = mixing.SHARE * (q * m[:, None]).sum(0) * (goal == 0)
    goal = goal * (mixing.SHARE * n.sum() - brought.sum()) / goal.sum() + brought
    a = (q * m[:, None]).T
    w, inverse = np.full(len(m), goal.sum() / m.sum()), np.linalg.pinv(a @ q, rcond=1e-9)
    for _ in range(3000):
        w = np.maximum(0, w - q @ (inverse @ (a @ w - goal)))
    rate = np.array([r.rate for r, o in zip(rows, out) if not o])
    left = lambda x: np.abs(a @ x - goal).sum() / goal.sum()
    assert left(rate) == pytest.approx(rows[0].residual, abs=1e-6) and left(rate) <= left(w) + 0.05


def test_odd_rows_and_names(spark):
    names = "__row __lid_pred __dead __d1 __n_lines __tokens __p __text __cell __rate rate n_tokens posterior_good residual n s first".split()
    long = " ".join(f"the word{i % 977} and" for i in range(60_000))
    line = "This is a line of plain words that is long enough to be told from others by its language"
    base = [(r.doc_id, r.text, r.lang) for r in common.table(spark, SF, "documents").orderBy("doc_id").limit(60).collect()]
    odd = [(None, None, None), (None, "", "en"), (None, line, None), (1001, long, "en"), (1001, long, "en"), (1001, line, "en"), (1002, None, "en"), (1003, "  \n \n\n", None), (None, line, None)]
    rows = [(i, t, None, l, None, *("x" for _ in names)) for i, t, l in base + odd]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        out = common.scratch(stage(spark, df, SF), "odd")
        assert out.columns[: len(df.columns)] == df.columns, name
        got = out.collect()
        texts = [r.text for r in got]
        if name == "simhash_dedup":
            assert texts.count(long) == texts.count(line) == 1 and sum(not (t or "").strip() for t in texts) == 1
            assert any(r.doc_id == 1001 and r.text == line for r in got)
        if name in ("decontaminate", "mixing"):
            assert texts.count(long) == 2 and None in texts and texts.count(line) == 3
        if name == "line_dedup":
            assert texts.count(long) == 2 and None in texts and "" in texts
        none = stage(spark, df.limit(0), SF)
        assert none.columns == out.columns and none.count() == 0, name


def test_run_is_the_stages_in_a_row(spark, stages):
    got = {(r.doc_id, round(r.rate, 6)) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {(r.doc_id, round(r.rate, 6)) for r in stages[5].collect()}

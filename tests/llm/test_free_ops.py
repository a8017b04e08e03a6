"""Decontamination, URL filters, licence scans and mixing against brute-force versions."""

import math
import random

import numpy as np
import pytest

from assaykit.llm import decontaminate, licenses, mixing, url_filter

SF = "/root/testdata/sf0.01"


def least_edits(text, item):
    """Fewest edits of item against any substring of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        prev, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            prev, row[j] = row[j], min(prev + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def plain(t):
    out = "".join(c.lower() if c.isalnum() else " " for c in t)
    return " ".join(out.split())


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("qxz")
        elif kind == 1:
            out.insert(at, rng.choice("qxz"))
        else:
            del out[at]
    return "".join(out)


def test_no_occurrence_is_lost(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 30)))) for i in range(12)] + [(50, None), (51, "tiny")]
    docs = []
    for i, t in items[:12]:
        most = min(int(0.08 * len(t)), (len(t) - 10) // 10)
        for n in (0, most // 2, most, most + 6):
            docs.append(" ".join(word() for _ in range(20)) + " " + edited(rng, t, n).upper() + "! " + " ".join(word() for _ in range(20)))
    docs += [None, "", "tiny", items[0][1] + " -- " + items[0][1]]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(docs)], "doc_id long, text string, item_id long").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in decontaminate.find_leaks(df, bench).collect():
        got.setdefault((r.doc_id, r.item_id), []).append(r)
    want = {}
    for d, t in enumerate(docs):
        for i, x in items[:12]:
            p = plain(x)
            if (e := least_edits(plain(t or ""), p)) <= min(int(0.08 * len(p)), (len(p) - 10) // 10):
                want[d, i] = e
    assert {k: min(r.edits for r in v) for k, v in got.items()} == want
    both = got[len(docs) - 1, 0]
    n = len(items[0][1])
    assert sorted((r.start, r.end) for r in both) == [(0, n), (n + 4, 2 * n + 4)]
    blocks = decontaminate.find_leaks(df, bench, block_chars=300)
    assert blocks.count() == sum(map(len, got.values()))
    clean = decontaminate.drop_leaked(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == set(range(len(docs))) - {d for d, _ in got}
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_verbatim_items_of_the_tables_are_found(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, plain(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in plain(r.text)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} >= want


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    path = path[:end]
    fit = [(len(h) + len(p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fit)[1:]) if fit else (host, path, None, None)


def test_url_rules_and_words(spark):
    urls = [None, "", "no scheme", "http://", "HTTPS://A.ORG", "http://A.ORG/", "x://b.Example.org/es/1?q", "http://example.org/en/12#a/b", "http://myexample.org/es/", "http://de.com/de/x", "http://q.com?x=/de/", "http://ÉA.com/fr/://x", "http://casinowin.net/free/prize", "http://weathermap.net/city/news", "http://a.net/\nb?c"]
    urls += [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(2)
    rows = {r.page_id: r for r in url_filter.judge(df).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_rule(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), u
        assert rows[i].verdict == (verdict or ("block" if rows[i].score > 0.5 else "allow"))
    assert (rows[12].verdict, rows[12].words) == ("block", "casino win free prize")
    assert (rows[13].verdict, rows[13].words) == ("allow", "weather map city news")
    assert url_filter.judge(df.limit(0)).count() == 0


def test_viterbi_is_the_best_split():
    rng = random.Random(2)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(12)}
    cutter = url_filter.Segmenter(words)
    for _ in range(30):
        run = "".join(rng.choice("abc") for _ in range(9))
        best = max(sum(cutter.cost(run[a:b]) for a, b in zip(cuts, cuts[1:])) for m in range(256) for cuts in [[0, *(i + 1 for i in range(8) if m >> i & 1), 9]])
        assert sum(map(cutter.cost, cutter.split(run))) == pytest.approx(best)


def test_patience_alignment():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij").encode() for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = licenses.patience_align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    for _ in range(100):
        v = [rng.randrange(8) for _ in range(9)]
        best = max(sum(m >> i & 1 for i in range(9)) for m in range(512) for s in [[x for i, x in enumerate(v) if m >> i & 1]] if all(x < y for x, y in zip(s, s[1:])))
        assert len(licenses.longest_increasing(v)) == best


def test_license_scan(spark):
    filler = "some words that say nothing of note at all and go on for a while "
    mit, apache = licenses.TEMPLATES["MIT"][1], licenses.TEMPLATES["Apache-2.0"][0]
    docs = [None, "", filler * 300, filler * 200 + apache + filler * 200, mit.replace("charge", "cost").upper(), "licensed to read, version of the apache tale 2 or 0", filler + mit + apache]
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, license string")).collect()}
    assert [rows[i].license for i in range(7)] == [None, None, None, "Apache-2.0", "MIT", None, "MIT"]
    assert (rows[3].first_word, rows[3].last_word) == (15 * 200, 15 * 200 + 7)
    tables = spark.read.parquet(f"{SF}/documents.parquet")
    lines = tuple(t[0] for t in licenses.TEMPLATES.values())
    want = {r.doc_id for r in tables.collect() if any(x in r.text for x in lines)}
    assert {r.doc_id for r in licenses.scan(tables).where("license is not null").collect()} == want


def test_rates_meet_targets_and_match_a_direct_solver(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    n = rng.integers(1, 500, 300)
    df = spark.createDataFrame([(i, int(n[i]), [float(x) for x in p[i]]) for i in range(300)], "doc_id long, __tokens long, __p array<double>")
    a = (p * n[:, None]).T
    for goal in ([20000.0, 5000.0, 1000.0], [30000.0, 0.0, 0.0]):
        rates = mixing.solve_rates(df, goal)
        r = rates.of(n.astype(float), p)[0]
        assert (r >= 0).all() and np.abs(a @ r - goal).sum() / sum(goal) == pytest.approx(rates.history[-1], abs=1e-6)
        w = np.full(300, sum(goal) / n.sum())
        inverse = np.linalg.inv(a @ p)
        for _ in range(2000):
            w = np.maximum(0, w - p @ (inverse @ (a @ w - goal)))
        assert rates.history[-1] <= np.abs(a @ w - goal).sum() / sum(goal) + 0.05


def test_mixing_finds_domains(spark):
    rng = random.Random(7)
    vocabulary = {"good": ["tree", "river", "stone"], "plain": ["zip", "zap", "zop"], "toxic": ["vile", "scum", "filth"]}
    text = lambda k, n: " ".join(rng.choice(vocabulary[k]) for _ in range(n))
    kinds = [rng.choice(list(vocabulary)) for _ in range(200)]
    docs = [(i, text(k, rng.randint(5, 200)), 1.0) for i, k in enumerate(kinds)] + [(500, None, 1.0), (501, "", 1.0), (None, "tree", 1.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, rate double")
    labels = spark.createDataFrame([(i, k) for i, k in enumerate(kinds) if i % 2] + [(1, None), (None, "good"), (3, "other")], "doc_id long, domain string")
    rows = {r.doc_id: r for r in mixing.mix(df, labels).collect()}
    assert len(rows) == 203
    for i, k in enumerate(kinds):
        assert rows[i][f"posterior_{k}"] > 0.9
        assert math.isclose(sum(rows[i][f"posterior_{d}"] for d in vocabulary), 1, rel_tol=1e-9)
    total = sum(r.n_tokens for r in rows.values())
    assert sum(r.rate * r.n_tokens * r.posterior_toxic for r in rows.values()) < 0.02 * total
    assert rows[500].n_tokens == rows[501].n_tokens == 0
    equal = mixing.mix(df, labels.limit(0)).first()
    assert equal.posterior_good == pytest.approx(1 / 3)
    assert mixing.mix(df.limit(0), labels).count() == 0


def test_quality_labels(spark):
    rows = mixing.quality_labels(spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")).collect()
    assert [r.domain for r in rows] == ["good", "plain", "toxic", None]

import random

import pytest
from pyspark.sql import functions as F

from assaykit.functions import text as T
from assaykit.operators import diff, graph, joins, lexer, metrics, ranking, rating, redaction, sets
from assaykit.plans import score as plan
from assaykit.sources import corpus
from assaykit.streaming import windows


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("pattern,path,hit", [("**/a/*.md", "a/b.md", True), ("**/a/*.md", "x/y/a/b.md", True), ("**/a/*.md", "a/c/b.md", False), ("docs/**", "docs/a/b", True), ("*.py", "a/b.py", False), ("a?.(x)", "ab.(x)", True), ("a?.(x)", "a/.(x)", False)])
def test_globs(spark, pattern, path, hit):
    assert one(spark, path, lambda c: c.rlike(T.glob_regex(pattern))) is hit


@pytest.mark.parametrize("token,text,hit", [("eval(", "x = eval (y)", False), ("eval(", "eval(y)", True), ("eval(", "medieval(y)", False), ("except :", "except:", True), ("as any", "asany", False), ("as any", "as  any", True), ("#<0-9>*", "see #12", True), ("get*Name", "getUserName()", True), ("a.b", "axb", False)])
def test_token_language(spark, token, text, hit):
    assert one(spark, text, lambda c: c.rlike(T.token_regex(token))) is hit


def test_paths_and_names(spark):
    assert [one(spark, "a/b/c.test.js", f) for f in (T.base_name, T.parent, T.suffix, T.stem)] == ["c.test.js", "a/b", ".js", "c.test"]
    assert [one(spark, ".env", f) for f in (T.parent, T.suffix, T.stem)] == ["", "", ".env"]
    assert one(spark, "a/b/c", T.ancestors) == ["", "a", "a/b"]
    assert one(spark, "costPerUnit_HTTPCode2", T.name_words) == ["cost", "per", "unit", "http", "code", "2"]
    assert [one(spark, w, T.singular) for w in ("entries", "ledgers", "address", "days")] == ["entry", "ledger", "address", "day"]
    assert one(spark, "Hello, World!", T.slug) == "hello-world"
    assert one(spark, "aabb", T.shannon_bits) == pytest.approx(1.0) and one(spark, "", T.shannon_bits) == 0


def test_rounding_rules(spark):
    assert [one(spark, v, T.half_even, "double") for v in (62.5, 63.5, 62.4)] == [62, 64, 62]
    assert one(spark, 62.5, T.half_up, "double") == 63
    df = spark.createDataFrame([(0.21, 0.2), (0.23, 0.2), (0.0, 0.0), (18.0, 20.0)], "v double, t double")
    assert [r.b for r in df.select(T.within_band(F.col("v"), F.col("t")).alias("b")).collect()] == [True, False, False, True]


def test_orders_without_one_task(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 20), rng.randint(1, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k int, v int").repartition(6)
    got = {r.id: (r["__rank"], r["__running"]) for r in ranking.in_order(df, [F.desc("k"), F.col("id")], F.col("v")).collect()}
    total = 0
    for n, (i, _, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += v
        assert got[i] == (n, total)
    kept = ranking.top_with_ties(df, "k", 10).collect()
    cut = sorted((r[1] for r in rows), reverse=True)[9]
    assert sorted(r.id for r in kept) == sorted(r[0] for r in rows if r[1] >= cut)
    with pytest.raises(ValueError):
        ranking.byte_budget(df, 0)


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6)], "src int, dst int")
    assert sorted(tuple(r) for r in graph.cycles(edges).collect()) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    start = spark.createDataFrame([(1,)], "node int")
    assert sorted(tuple(r) for r in graph.distances(edges, start).collect()) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]


DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,3 +1,3 @@ head
 keep
-def old(): pass
+def new(): pass
 tail
@@ -10 +10,2 @@
-a
+b
+c
diff --git a/m.py b/n.py
similarity index 90%
rename from m.py
rename to n.py
@@ -5 +5 @@
-def moved(): pass
+x = 1
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-def new(): pass"""


def test_diffs(spark):
    rows = diff.parse(spark.createDataFrame([(1, DIFF)], "diff_id int, diff string"))
    got = [(r.path, r.status, r.hunk, r.sign, r.line_no) for r in rows.orderBy("path", "hunk", "line_no", "sign").collect()]
    assert ("x.py", "modified", 1, "-", 2) in got and ("x.py", "modified", 1, "+", 2) in got and ("x.py", "modified", 2, "+", 11) in got
    assert ("n.py", "renamed", 1, "-", 5) in got and ("gone.py", "deleted", 1, "-", 1) in got and len(got) == 10
    assert {(r.path, r.symbol) for r in diff.removed_symbols(rows, r"def (\w+)").collect()} == {("x.py", "old"), ("n.py", "moved")}


def test_lexer(spark):
    code = 'x = "a # b"  # note\ndef f(a):\n    if a and b:\n        return 1\n    for i in a:\n        pass\n\ny = """\nif while\n"""\n'
    assert lexer.blank(code, "python").count("\n") == code.count("\n") and len(lexer.blank(code, "python")) == len(code)
    assert "note" not in lexer.blank(code, "python") and "a # b" in lexer.blank(code, "python", True)
    assert lexer.blank("a /* b\n c */ d // e", "java").split() == ["a", "d"]
    df = lexer.with_code(spark.createDataFrame([("a/b.py", code), ("c.txt", "x"), ("d.go", None)], "path string, text string"))
    assert [(r.path, r.start, r.stop, r.ccn) for r in lexer.functions(df).collect()] == [("a/b.py", 2, 6, 4)]
    files = lexer.with_code(spark.createDataFrame([("p.ts", "import a.b.c\nimport y from './x/util.js'\nz = 1")], "path string, text string"))
    assert {r.name for r in lexer.imported_names(lexer.import_statements(files)).collect()} == {"c", "util"}


def test_redaction(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    text = f"id {key}\npassword = hunter22\nprose about the secret: masked words\n" + "0123456789abcdef" * 3
    df = spark.createDataFrame([("p", text)], "path string, text string")
    out = redaction.redact(df).first().text
    assert key not in out and "hunter22" not in out and "0123456789abcdef0" not in out and "masked words" in out
    hits = {(r.detector, r.line) for r in redaction.scan(df).collect()}
    assert hits == {("aws_access_key_id", 1), ("credential_assignment", 2), ("high_entropy_hex", 4)}


def test_correspondence_within_projects(spark):
    paths = ["a/src/x.py", "a/tests/test_x.py", "b/src/y.py", "a/tests/test_y.py", "b/setup.cfg"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    placed = joins.project_boundary(files, files.where("path like '%setup.cfg'"), ["src", "tests"])
    assert {r.path: r.project for r in placed.collect()} == {"a/src/x.py": "a", "a/tests/test_x.py": "a", "b/src/y.py": "b", "a/tests/test_y.py": "a", "b/setup.cfg": "b"}
    sources = placed.where("path like '%/src/%'")
    expected = joins.expected_tests(sources, {".py": ["test_{stem}.{ext}"]}).join(placed, "path")
    pairs = joins.correspondence(expected, placed.where("path like '%/tests/%'"))
    assert [tuple(r) for r in pairs.collect()] == [("a/src/x.py", "a/tests/test_x.py")]
    assert [r.path for r in joins.uncovered(sources, pairs).collect()] == ["b/src/y.py"]


def test_text_joins_and_prefixes(spark):
    files = spark.createDataFrame([("lib/a.py",), ("lib/b.py",), ("x.py",)], "path string")
    imports = spark.createDataFrame([("x.py", "./lib/"), ("lib/a.py", "lib")], "importer string, prefix string")
    assert sorted(tuple(r) for r in joins.prefix_targets(imports, files).collect()) == [("lib/a.py", "lib/b.py"), ("x.py", "lib/a.py"), ("x.py", "lib/b.py")]
    lines = spark.createDataFrame([("x.py", 1, "use helper now"), ("lib/a.py", 3, "helper")], "path string, line_no int, line string")
    tokens = spark.createDataFrame([("helper", "lib/a.py")], "token string, owner string")
    assert [tuple(r) for r in joins.token_lines(lines, tokens).collect()] == [("x.py", 1, "helper", "lib/a.py")]


def test_abstention_is_never_a_number(spark):
    df = spark.createDataFrame([("a", None, 1.0, True), ("b", 2.0, None, False)], "dimension string, m double, n double, cut boolean")
    got = {(r.dimension, r.metric): (r.value, r.abstain_reason) for r in metrics.long_table(df, {"m": metrics.WHOLE_SET, "n": metrics.LOCAL}, truncated="cut").collect()}
    assert got == {("a", "m"): (None, "truncated_evidence"), ("a", "n"): (1.0, None), ("b", "m"): (2.0, None), ("b", "n"): (None, "no_denominator")}
    assert spark.range(0).agg(metrics.share_of(F.lit(True)).alias("s")).first().s is None


def test_rule_weights_and_reasons(spark):
    total = {}
    for d, _, w, *_ in rating.RULES:
        total[d] = total.get(d, 0) + w
    assert all(w in (100, 200) for w in total.values()) and len(rating.RULES) == 77
    rules = rating.rule_table(spark, [("a", "m", 60, "at_most", 0.0, ""), ("a", "n", 40, "at_least", 1.0, ""), ("b", "m", 70, "at_most", 0.0, ""), ("b", "n", 30, "at_most", 0.0, "")])
    table = spark.createDataFrame([("a", "m", 0.0, None), ("a", "n", 0.5, None), ("b", "n", 0.0, None)], "dimension string, metric string, value double, abstain_reason string")
    packs = spark.createDataFrame([("a", 0.5, 0.5, False, False), ("b", 1.0, 0.5, False, False), ("c", 1.0, 0.5, False, True), ("d", None, 0.1, False, False), ("e", 1.0, 0.1, True, False)], "dimension string, coverage double, floor double, failed boolean, has_docs boolean")
    x = rating.inputs(table, rules)
    r = rating.rate(x, packs)
    assert {k.dimension: (k.value, k.reason_code) for k in r.collect()} == {"a": (60, None), "b": (None, "insufficient_measured_weight"), "c": (None, "documentation_only"), "d": (None, "no_static_rule"), "e": (None, "dimension_failed")}
    assert rating.overall(r).first().value == 60
    assert [tuple(p) for p in rating.plan(x, r).collect()] == [("P1", "a", "n", 40, 40)]
    areas = spark.createDataFrame([("#1",), ("#99",)], "area string")
    assert [a.area for a in rating.areas_without_rule(areas, rating.rule_table(spark)).collect()] == ["#99"]


def test_findings_tell_all_errors(spark):
    f = spark.createDataFrame([("t", "high", None, "a:1-2"), (" ", "sure", "huge", "x")], "title string, confidence string, severity string, evidence_ref string")
    refs = spark.createDataFrame([("a:1-2",)], "evidence_ref string")
    assert sorted(len(r.errors) for r in rating.validate_findings(f, refs).collect()) == [0, 4]


def test_registry_and_overlay(spark):
    text = '[[sinks]]\nvalue = ["eval(", "exec("]\ncitation_url = "https://example.org"\nsource_tag = "curated"\n'
    assert corpus.registry(spark, {"python": text}).count() == 2
    with pytest.raises(ValueError, match="python.sinks"):
        corpus.registry(spark, {"python": "[[sinks]]\nvalue = ['x']\n"})
    with pytest.raises(ValueError):
        corpus.agent_input('{"bogus": 1}')
    base, local = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(tuple(r) for r in sets.overlay(base, local, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_a_directory_is_scored(spark, tmp_path):
    root = tmp_path / "repo"
    for path, text in {"README.md": "# Title\n", "src/a.py": "def f(x):\n    if x:\n        return 1\n# TODO later\n", "tests/test_a.py": "def test_f():\n    assert True\n", "src/b.py": "password = 'hunter22'\n", ".env": "SECRET=1", "node_modules/x.js": "x", "uv.lock": "", "LICENSE": "MIT", ".github/workflows/ci.yml": "on: push", "pyproject.toml": ""}.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    (root / "blob.bin").write_bytes(b"\xff\xfe\x00")
    files = corpus.files(spark, str(root)).cache()
    status = {r.path: (r.read_status, r.text is None) for r in files.collect()}
    assert status[".env"] == ("secret-bearing", True) and status["blob.bin"] == ("not utf-8", True) and "node_modules/x.js" not in status
    result = plan.score(spark, files)
    got = {(r.dimension, r.metric): r.value for r in result.metrics.collect()}
    assert got["code-quality", "max_function_ccn"] == 2 and got["security", "redaction_hits_observed"] == 1
    assert got["test-strategy", "source_files_without_covering_test_share"] == 0.5 and got["security", "lockfile_missing"] == 0
    ratings = {r.dimension: r for r in result.ratings.collect()}
    assert ratings["supply-chain"].value == 44 and ratings["supply-chain"].available == 80 and ratings["solution-fit"].reason_code == "no_static_rule"
    corpus.write_json(result.ratings, str(tmp_path / "out"))
    corpus.write_report("Score", {"ratings": result.ratings}, str(tmp_path / "r.html"))
    with pytest.raises(FileExistsError):
        corpus.write_report("Score", {}, str(tmp_path / "r.html"))


def test_streams_match_tables(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events*.parquet")
    q = windows.tumbling(stream, late="10000 days").writeStream.outputMode("complete").format("memory").queryName("tumbling").start()
    q.processAllAvailable()
    q.stop()
    want = windows.tumbling(events)
    key = lambda r: (str(r.window_start), r.event_type, r.n)
    assert sorted(map(key, spark.table("tumbling").collect())) == sorted(map(key, want.collect()))
    assert windows.sessions(events).count() > 0

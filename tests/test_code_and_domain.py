import pytest
from pyspark.sql import functions as F

from assaykit.operators import code, domain, facts, lexer


def lines(spark, files):
    df = lexer.with_code(spark.createDataFrame(list(files.items()), "path string, text string"))
    return facts.lines_of(df, "path", "code").join(df.select("path", "language"), "path")


def test_kinds_of_files(spark):
    want = {"a/test_x.py": "test", "src/x.py": "source", "tests/src/x.py": "source", "src/tests/x.py": "test", "src/x.spec.ts": "test", "src/test_x.py": "source", "tests/d.json": None, "x_test.py": "test"}
    df = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r.path: r.k for r in df.select("path", code.code_kind(F.col("path")).alias("k")).collect()} == want


def test_layers_and_categories(spark):
    df = spark.createDataFrame([("a/services/x.py",), ("a/models/x.py",), ("b/api/y.ts",), ("z.py",), ("config/.env.prod",), ("tests/auth/x.py",), ("lib/auth.py",), ("requirements-dev.txt",), (".github/workflows/a.yml",)], "path string")
    got = {r.path: (r.a, r.b) for r in df.select("path", code.layer(F.col("path")).alias("a"), code.security_category(F.col("path")).alias("b")).collect()}
    assert [got[p][0] for p in ("a/services/x.py", "a/models/x.py", "b/api/y.ts", "z.py")] == ["service", "data", "api", None]
    assert [got[p][1] for p in ("config/.env.prod", "tests/auth/x.py", "lib/auth.py", "requirements-dev.txt", ".github/workflows/a.yml")] == ["credential material", None, "auth or crypto code", "dependency manifest", "permission, container, or CI configuration"]


def test_iac_by_content(spark):
    texts = ["apiVersion: v1\nkind: Pod\n---\nservices:\n  web: 1\n", "services:\n  a: b\njobs:\n  c: d\n", "Resources:\n  B:\n    Type: AWS::S3::Bucket\n", "name: x\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.k for r in df.orderBy("i").select(code.iac_kinds(F.col("t")).alias("k")).collect()] == [["k8s-manifest", "container-config"], [], ["cloud-template"], []]


def test_sinks_tests_and_cookies(spark):
    src = "import os\nos.system('x')\nmy.eval(1)\nx = eval(y)\n# eval(z)\n"
    tst = "def test_a():\n    assert x\n    assertEqual(1, 1)\n\n@pytest.mark.skip\ndef test_b():\n    pass\n"
    ck = "r.set_cookie(\n  k, secure=True,\n  httponly=True)\nr.set_cookie(k, secure=True, httponly=True, samesite='lax')\nr.set_cookie(\n"
    rows = lines(spark, {"a.py": src, "test_a.py": tst, "c.py": ck})
    assert {tuple(r) for r in code.sink_hits(rows).collect()} == {("a.py", 2, "CWE-78"), ("a.py", 4, "CWE-95")}
    strength = code.test_strength(rows.where("path = 'test_a.py'")).first()
    assert (strength[0], strength[1], strength[2]) == (1.0, 0.5, 0.5)
    cookies = {r.line_no: r.missing for r in code.cookie_statements(rows.where("path = 'c.py'")).collect()}
    assert cookies == {1: ["samesite"], 4: [], 5: None}


def test_reliability_and_migrations(spark):
    src = "for x in y:\n    if x:\n        session.query(x)\nsession.query(z)\nrequests.get(u)\nrequests.get(\n    u, timeout=3)\n"
    sql = "-- up\nDROP TABLE a;\n-- DROP TABLE c\nALTER TABLE a RENAME TO b;\n-- down\nDROP TABLE b;\n"
    rows = lines(spark, {"a.py": src})
    assert {tuple(r) for r in code.reliability(rows).collect()} >= {("a.py", 3, "query_in_loop")}
    assert not [r for r in code.reliability(rows).collect() if r.line_no in (4, 6)]
    raw = facts.lines_of(spark.createDataFrame([("db/migrations/1.sql", sql), ("db/other/1.sql", sql), ("db/migrations/1.down.sql", sql)], "path string, text string"))
    assert [tuple(r) for r in code.destructive_ops(raw).orderBy("line_no").collect()] == [("db/migrations/1.sql", 2), ("db/migrations/1.sql", 4)]


def test_routes(spark):
    rows = spark.createDataFrame([("a.py", 1, '@app.get("/users/:id/posts")'), ("a.py", 2, "router.post('/login', h)"), ("a.py", 3, "x.get('/no')")], "path string, line_no int, line string")
    assert [(r.method, r.prefix) for r in code.routes(rows).orderBy("line_no").collect()] == [("GET", "users"), ("POST", "login")]


@pytest.mark.parametrize("name,money,ledger", [("totalPrice", True, False), ("price_cents", False, False), ("paymentRepository", False, True), ("PaymentMethod", False, False), ("ledger_entries", False, True), ("pageCount", False, False)])
def test_names(spark, name, money, ledger):
    df = spark.createDataFrame([(name,)], "n string").select(domain.is_money_name(F.col("n")).alias("m"), domain.is_ledger_name(F.col("n")).alias("l"))
    assert tuple(df.first()) == (money, ledger)


def test_change_kinds_and_pairs(spark):
    rows = [("a", "feature/x", "feat: y", False), ("a", "feature/x", "Fixes #12", False), ("b", None, "tidy", True), ("c", None, "tidy", False), ("d", "chore/x", "refactor(core): z", False)]
    df = spark.createDataFrame(rows, "scope string, branch string, message string, only_other_files boolean")
    assert {r.scope: r.kind for r in domain.change_kind(df).collect()} == {"a": "bugfix", "b": "chore", "c": "feature", "d": "refactor"}
    s = spark.createDataFrame([("s.py", "p", "compute", 9, True), ("s.py", "p", "alpha", 1, False), ("s.py", "p", "run", 1, True)], "path string, project string, symbol string, line_no int, added boolean")
    t = spark.createDataFrame([("t.py", "p", x, 1, True) for x in ("compute", "alpha", "run")] + [("u.py", "q", "compute", 1, True)], "path string, project string, symbol string, line_no int, added boolean")
    assert [tuple(r) for r in domain.symbol_pairs(s, t).collect()] == [("s.py", "t.py", "compute")]


def test_documents(spark):
    doc = "# Title\n## Requirements\n- a\n- b\n1. c\n## Other\n- d\n| Id | Criterion |\n|---|---|\n| 1 | It works |\n\n| x | y |\n"
    df = spark.createDataFrame([("d.md", doc)], "path string, text string")
    ls = facts.lines_of(df)
    assert [(r.start, r.stop) for r in domain.sections(ls).orderBy("start").collect()] == [(1, 13), (2, 5), (6, 13)]
    assert [tuple(r) for r in domain.requirement_lists(ls).collect()] == [("d.md", 2, 3)]
    assert [tuple(r) for r in domain.criteria(ls).collect()] == [("d.md", 10, "It works")]
    dec = spark.createDataFrame([("a", "# Decision\nX\n# Context\nY"), ("b", "2024-01-02 we decided on Z because it is small"), ("c", "# Decision only")], "path string, text string")
    assert {r.path: r.by for r in domain.decisions(dec).collect()} == {"a": "fields", "b": "entry"}


def test_money(spark):
    money = spark.createDataFrame([("a.ts", 1, "price: number"), ("a.ts", 2, "count: number"), ("a.py", 3, "amount: Optional[float]")], "path string, line_no int, line string")
    assert sorted(r.name for r in domain.float_money(money).collect()) == ["amount", "price"]

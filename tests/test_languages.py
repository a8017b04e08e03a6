"""How nine languages are read: functions, branches, strings that embed expressions, imports."""

import pytest

from assaykit.operators import code, facts, lexer
from assaykit.plans import measures

FILES = {
    "a.java": "class A {\n    public int f(int a)\n    {\n        if (a > 0 && a < 9) {\n            return 1;\n        }\n        return 0;\n    }\n\n    abstract int g(int a);\n    void h() { for (;;) {} }\n}\n",
    "a.cs": "namespace N\n{\n    public class C\n    {\n        public async Task Run(int a)\n        {\n            foreach (var x in y)\n            {\n                if (a == 1 || b) { }\n            }\n        }\n    }\n}\n",
    "a.ts": "const f = async (a) => {\n  return a && b ? 1 : 2\n}\nexport function g(x) {\n  const h = (y) => {\n    if (y) {}\n  }\n  for (;;) {}\n}\nclass K {\n  method(a) {\n    if (a) {}\n  }\n}\n",
    "a.php": "<?php\nfunction f($a)\n{\n    if ($a and $b) {\n    } elseif ($c) {\n    }\n}\n",
    "a.go": "func f(a int) {\n\tif a && b {\n\t}\n\tfor {\n\t}\n}\n\nfunc g() {}\n",
    "a.rs": "fn f(a: char) {\n    if a == '\"' && b {\n    }\n    match a {\n        1 => 2,\n    }\n}\n",
    "a.kt": "fun f(a: Int) {\n    while (a) {}\n    and(or)\n}\n",
    "a.rb": "def f(a)\n  if a and b\n  end\nend\n\n\ndef g\nend\n",
    "a.py": "def f(\n    a,\n):\n    if a or b:\n        def g():\n            while a:\n                pass\n    return 1\n\nx = 1\n",
}
WANTED = {
    "a.java": [(2, 8, 3), (11, 12, 2)],
    "a.cs": [(5, 13, 4)],
    "a.ts": [(1, 3, 2), (4, 9, 2), (5, 7, 2)],
    "a.php": [(2, 7, 4)],
    "a.go": [(1, 6, 4), (8, 8, 1)],
    "a.rs": [(1, 7, 4)],
    "a.kt": [(1, 4, 2)],
    "a.rb": [(1, 3, 3), (4, 4, 1)],
    "a.py": [(1, 8, 3), (5, 7, 2)],
}


def test_functions(spark):
    files = lexer.with_code(spark.createDataFrame([*FILES.items(), ("b.txt", "def f():"), ("b.py", None), ("c.py", "")], "path string, text string"))
    got: dict = {}
    for r in lexer.functions(files).collect():
        got.setdefault(r.path, []).append((r.start, r.stop, r.ccn))
    want = dict(WANTED)
    want["a.rb"] = [(1, 3, 3), (7, 7, 1)]  # the word that ends a method is no bracket
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize(
    "language, text, literals",
    [
        ("js-ts", "f(`a ${g(`b ${c}`)} d`) + '}'", ["`a ${g(`b ${c}`)} d`", "'}'"]),
        ("js-ts", "`${ {a: '`'} }` /* ` */ x", ["`${ {a: '`'} }`", "/* ` */"]),
        ("js-ts", "`\\${a}` `open ${", ["`\\${a}`", "`open ${"]),
        ("kotlin", '"$5 ${a.map { "x" }} $b"', ['"$5 ${a.map { "x" }} $b"']),
        ("kotlin", '"""a\n"b" $c""" + 1', ['"""a\n"b" $c"""']),
        ("ruby", '"a #{b("c")} d" # e', ['"a #{b("c")} d"', "# e"]),
        ("ruby", '"open #{b\nx = 1', ['"open #{b']),
        ("php", '"a {$b["c"]} d"; \'$e\'', ['"a {$b["c"]} d"', "'$e'"]),
        ("rust", "a == '\"' && b // c", ["'\"'", "// c"]),
        ("python", "'''a\n'b' ''' + \"c\\\"d\" # e", ["'''a\n'b' '''", '"c\\"d"', "# e"]),
        ("csharp", '"open\nx = "b"', ['"open', '"b"']),
    ],
)
def test_literals(language, text, literals):
    syntax = lexer.Syntax(*lexer.syntax_data()[language])
    assert [text[a:b] for a, b, *_ in syntax.literals(text)] == literals
    assert len(lexer.blank(text, language)) == len(text)


def test_marks():
    mark = lambda language, text: lexer.MARK in lexer.blank(text, language, mark=True)
    assert mark("js-ts", "`${a}`") and not mark("js-ts", '"${a}"') and not mark("js-ts", "`$a`") and not mark("js-ts", "`\\${a}`")
    assert mark("kotlin", '"$a"') and mark("kotlin", '"${a}"') and not mark("kotlin", '"$5"') and not mark("kotlin", "'$'")
    assert mark("ruby", '"#{a}"') and not mark("ruby", "'#{a}'") and mark("php", '"$a"') and not mark("python", 'f"{a}"')
    assert not mark("js-ts", "// `${a}`")


def test_interpolated_sinks(spark):
    lines = ["db.query(`select ${id}`)", "db.query(`select 1`)", "db.query(", "  `a ${b}`)"]
    files = lexer.with_code(spark.createDataFrame([("a.ts", "\n".join(lines)), ("a.rb", 'U.where("a = #{b}")\nU.where("a")')], "path string, text string"), marked="marked")
    rows = facts.lines_of(files, "path", "marked").withColumn("language", lexer.language(facts.F.col("path")))
    assert {(r.path, r.line_no, r.cwe) for r in code.sink_hits(rows).collect()} == {("a.ts", 1, "CWE-89"), ("a.rb", 1, "CWE-89")}


def test_imports_over_lines(spark):
    text = "import {\n  a, // } \n  b,\n} from './x/util.js'\nconst c = require('./d')\n// import e\n" + "import " + "z" * 600 + "\n"
    files = lexer.with_code(spark.createDataFrame([("a.ts", text), ("b.go", 'import (\n\t"a/b"\n\t"c/d"\n)\n')], "path string, text string"))
    found = lexer.import_statements(files)
    assert {(r.path, r.line_no) for r in found.collect()} == {("a.ts", 1), ("a.ts", 5), ("b.go", 1)}
    assert {r.name for r in lexer.imported_names(found).collect()} == {"util", "d", "b"}


def test_skip_markers(spark):
    text = "\n".join(
        ["@pytest.mark.skip", "@other", "def test_a():", "    pytest.skip('x')", "@pytest.mark.skip", "x = 1", "def test_b(): pytest.skip('y')", "@pytest.mark.skip", "", "def test_c():", "    pass", "pytest.skip('z')"]
    )
    files = lexer.with_code(spark.createDataFrame([("t/test_a.py", text), ("t/a.test.ts", "it('a', f)\nit.skip('b', f)\n  xit('c', f)\n")], "path string, text string"))
    lines = measures.both_lines(files.withColumn("kind", facts.F.lit("test")))
    got = {(r.path, r.line_no): r.own for r in code.skip_markers(lines).collect()}
    assert got == {("t/test_a.py", 1): False, ("t/test_a.py", 4): False, ("t/test_a.py", 5): True, ("t/test_a.py", 7): False, ("t/test_a.py", 8): True, ("t/test_a.py", 12): True, ("t/a.test.ts", 2): True, ("t/a.test.ts", 3): False}
    s = code.test_strength(lines).first()
    assert (s.n, s.skips, s.own) == (4, 8, 4) and s.skipped_test_share == 1.0


LONG = "x" * 600
LONG_FILES = {
    # a head, branches and a last line, each on a line of over 500 characters
    "a.py": f"def f({LONG}):\n    return 1 if {LONG} and b else 2\n\ny = 1\n",
    "b.py": f"def f(a):\n    if a:\n        return 1\n    {LONG} = 2 or 3\n",
    "c.py": f"def f(a):\n    return 1\n{LONG} = 2\n    if b:\n        pass\n",
    "d.ts": "function f(a) {" + "if (a && b) {}" * 1000 + "}\nconst g = (a) => {}\n",
    # white space of any length before a head's next word, and where none comes
    "e.java": "class A {\n    public" + " " * 30_000 + "int" + "\t" * 30_000 + "f (int a) {\n        if (a) {}\n    }\n    public" + " " * 30_000 + "int = 1;\n}\n",
    "f.ts": "const" + " " * 30_000 + "f = (a) => a || 1\nconst" + " " * 30_000 + "g",
}


def test_functions_on_long_lines(spark):
    files = spark.createDataFrame([*LONG_FILES.items()], "path string, code string").withColumn("language", lexer.language(facts.F.col("path")))
    got = sorted(tuple(r) for r in lexer.functions(files).collect())
    assert got == [("a.py", 1, 2, 3), ("b.py", 1, 4, 3), ("c.py", 1, 2, 1), ("d.ts", 1, 1, 2001), ("d.ts", 2, 2, 1), ("e.java", 2, 4, 2), ("f.ts", 1, 1, 2)]


@pytest.mark.parametrize("language", sorted(lexer.patterns("function_start")))
def test_heads_after_runs_of_white_space(language):
    """Heads are found as in the line as it is, whatever the white space in it."""
    import random
    import re

    head, branch = (re.compile(lexer.patterns(f)[language]) for f in ("function_start", "branch_keywords"))
    rng = random.Random(language)
    words = [w for t in lexer.registry.tokens("function_start")[language] for w in t.split()] + ["name", "(", ""]
    for _ in range(3000):
        line = "x" + "".join(rng.choice(words) + rng.choice([" ", "\t", "\xa0", ""]) * rng.choice([0, 1, 2, 3, 4, 5, 9]) for _ in range(rng.randint(1, 8)))
        assert bool(lexer.function_lines(line, head, branch)) == bool(head.search(line)), line

"""Inheritance against a walk up from each node, and the configurations of type checkers."""

import random

from assaykit.operators import settings


def walk(nodes, parents, key, seen=()):
    state = nodes[key]
    if state != "unset":
        return state
    for p in parents.get(key, ()):
        if p not in nodes or p in (*seen, key):
            return "unseen"
        found = walk(nodes, parents, p, (*seen, key))
        if found != "unset":
            return found
    return "unset"


def settled(spark, nodes, parents):
    rows = [(k, i, p) for k, ps in parents.items() for i, p in enumerate(ps)]
    got = settings.inherited(spark.createDataFrame(list(nodes.items()), "key string, state string"), spark.createDataFrame(rows, "key string, place int, parent string"))
    return {r.key: r.state for r in got.collect()}


def test_inherited_trees(spark):
    r = random.Random(1)
    nodes = {f"n{i}": r.choice(["unset"] * 6 + ["strict", "off", "unseen"]) for i in range(120)}
    parents = {f"n{i}": [f"n{r.randrange(i)}" if r.random() < 0.95 else "lost" for _ in range(r.choice([0, 1, 1, 1, 2, 3]))] for i in range(1, 120)}
    assert settled(spark, nodes, parents) == {k: walk(nodes, parents, k) for k in nodes}


def test_long_chains_and_circles(spark):
    nodes = {f"c{i}": "unset" for i in range(40)} | {"c39": "strict", "x": "unset", "y": "unset", "z": "unset", "me": "unset"}
    parents = {f"c{i}": [f"c{i + 1}"] for i in range(39)} | {"x": ["y"], "y": ["z"], "z": ["x"], "me": ["me"]}
    got = settled(spark, nodes, parents)
    assert {got[f"c{i}"] for i in range(40)} == {"strict"} and {got[k] for k in ("x", "y", "z", "me")} == {"unseen"}
    assert settled(spark, {}, {}) == {}


FILES = {
    "tsconfig.json": '{"extends": "./base/a", "files": []}',
    "base/a.json": '{"extends": ["../base/b.json", "./c.json"]}',
    "base/b.json": '{"strict": true}',
    "base/c.json": '{\n  // "strict": false\n}',
    "off/tsconfig.json": '{"strict": true, "strict": false}',
    "lib/tsconfig.app.json": '{"extends": "@scope/base"}',
    "in/tsconfig.json": '{"extends": "../tsconfig.json"}',
    "out/tsconfig.json": '{"extends": "../../x.json"}',
    "pyproject.toml": "[tool.other]\nstrict = true\n[tool.mypy]\n# strict = true\nx = 1\n[tool.mypy.sub]\nstrict = true\n",
    "p/mypy.ini": "[mypy]\nstrict = false\nstrict = True\n",
    "none/setup.cfg": "[metadata]\nstrict = true\n",
}


def test_type_checkers(spark):
    files = spark.createDataFrame([*FILES.items(), ("q/tsconfig.json", None)], "path string, text string")
    got = {(r.language, r.path, r.header): (r.state, r.base) for r in settings.strict_states(files).collect()}
    assert got == {
        ("js-ts", "tsconfig.json", ""): ("strict", True),
        ("js-ts", "off/tsconfig.json", ""): ("off", False),
        ("js-ts", "lib/tsconfig.app.json", ""): ("unseen", False),
        ("js-ts", "in/tsconfig.json", ""): ("strict", False),
        ("js-ts", "out/tsconfig.json", ""): ("unseen", False),
        ("python", "pyproject.toml", "[tool.mypy]"): ("unset", False),
        ("python", "p/mypy.ini", "[mypy]"): ("strict", False),
    }
    assert {r.language: r.state for r in settings.strict_languages(settings.strict_states(files)).collect()} == {"js-ts": "strict", "python": "strict"}
    bare = files.where("path in ('pyproject.toml', 'lib/tsconfig.app.json')")
    assert {r.language: r.state for r in settings.strict_languages(settings.strict_states(bare)).collect()} == {"js-ts": "unseen", "python": "off"}
    assert settings.strict_states(files.limit(0)).count() == 0

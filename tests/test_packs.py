"""Packs, citations and findings against plain versions of the same rules."""

import json
import random

import pytest

from assaykit.operators import packs, redaction

KEY = "AKIA" + "ABCDEFGHIJKLMNOP"


def excerpts(spark, rows):
    return spark.createDataFrame(rows, "unit string, path string, start int, stop int, text string, arrival long").repartition(3)


def plain(rows, limit, changed=(), referenced=()):
    """({unit: [(ref, text)]}, {unit: (truncated, n secrets)}) by reading one excerpt after another."""
    out, told = {}, {}
    for unit in {r[0] for r in rows}:
        mine = sorted((1 if r[1] in changed else 2 if r[1] in referenced else 3, r[5], i) for i, r in enumerate(rows) if r[0] == unit)
        kept, seen, used, cut, secrets = [], set(), 0, False, 0
        for _, _, i in mine:
            _, path, start, stop, text, _ = rows[i]
            text = redaction.redacted(text or "")
            ref = f"{redaction.redacted_path(path)}:{start}-{stop}"
            if ref in seen:
                continue
            seen.add(ref)
            secrets += len(list(redaction.secrets(rows[i][4] or ""))) + len(list(redaction.secrets(path)))
            if used + len(text.encode()) > limit:
                cut = True
                break
            used += len(text.encode())
            kept.append((ref, text))
        out[unit], told[unit] = kept, (cut, secrets, used)
    return out, told


def packed(found):
    out: dict = {}
    for r in sorted(found.excerpts.collect(), key=lambda r: (r.unit, r.position)):
        out.setdefault(r.unit, []).append((r.ref, r.text))
    return out, {r.unit: (r.truncated, r.secrets, r.bytes) for r in found.units.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_packs(spark, seed):
    r = random.Random(seed)
    texts = ["", "short", f"key = '{KEY}'", "é" * 40, "long " * 30, None]
    rows = [("hot" if r.random() < 0.5 else f"u{r.randrange(4)}", f"d/f{r.randrange(12)}.py", a := r.randrange(1, 50), a + r.randrange(9), r.choice(texts), i) for i in range(150)]
    changed, referenced = {"d/f1.py", "d/f2.py"}, {"d/f2.py", "d/f3.py"}
    paths = lambda s: spark.createDataFrame([(p,) for p in sorted(s)] * 2, "path string")
    found = packs.pack(excerpts(spark, rows), 300, paths(changed), paths(referenced))
    kept, told = packed(found)
    want, wanted = plain(rows, 300, changed, referenced)
    assert {k: v for k, v in want.items() if v} == kept and told == wanted
    assert not any(KEY in x for v in kept.values() for _, x in v)


def test_first_rejected_is_still_reported(spark):
    rows = [("u", "a.py", 1, 2, "x" * 50, 1), ("u", "b.py", 10, 12, f"one\nkey = '{KEY}'\n" + "y" * 90, 2), ("u", "c.py", 1, 1, f"'{KEY}'", 3)]
    found = packs.pack(excerpts(spark, rows), 100)
    assert [(r.path, r.line) for r in found.secrets.collect()] == [("b.py", 11)]
    unit = found.units.first()
    assert (unit.admitted, unit.bytes, unit.truncated, unit.omitted, unit.secrets) == (1, 50, True, 1, 1)
    with pytest.raises(ValueError):
        packs.pack(excerpts(spark, rows), 0)
    assert packs.pack(excerpts(spark, rows[:0])).units.count() == 0


def test_cited_lines(spark):
    r = random.Random(4)
    rows = [("u", f"f{r.randrange(3)}", a := r.randrange(1, 900), a + r.choice([0, 5, 63, 300]), "x", i) for i in range(40)]
    found = packs.pack(excerpts(spark, rows), 25)
    kept = [(x.path, x.start, x.stop, x.ref) for x in found.excerpts.collect()]
    asked = [(r.choice("uv"), f"f{r.randrange(4)}", r.randrange(1, 1300)) for _ in range(400)]
    got = packs.cited_lines(spark.createDataFrame([(*a, i) for i, a in enumerate(asked)], "unit string, path string, line int, n int"), found.excerpts).collect()
    assert len(got) == len(asked)
    for x in got:
        over = [(s, e, ref) for p, s, e, ref in kept if x.unit == "u" and p == x.path and s <= x.line <= e]
        assert x.ref == max(over, default=(0, 0, None))[2]
    assert any(x.ref for x in got) and any(x.ref is None for x in got)


def test_findings(spark):
    found = packs.pack(excerpts(spark, [("security", "a:b.py", 1, 9, "x", 1), ("api", "c.py", 2, 3, "y" * 99, 1), ("api", "d.py", 2, 3, "y" * 99, 2)]), 120)
    good = ("security", "t", "d", "a:b.py:1-9", "high", None, None)
    cases = {
        good: [],
        ("api", "t", "d", "d.py:2-3", "low", "s", "high"): ["evidence_ref"],
        ("data", "t", "d", "c.py:2-3", "low", None, None): ["dimension"],
        ("security", "t", "d", "a:b.py:4", "low", None, None): ["evidence_ref"],
        ("security", "", None, "", "sure", None, "bad"): ["title", "detail", "evidence_ref", "confidence", "severity"],
        ("security", "t", "d", "a:b.py:1-8", None, None, None): ["confidence"],
        ("security", "t", "d", "a:b.py:1-8", "low", None, None): ["evidence_ref"],
    }
    df = spark.createDataFrame(list(cases), ", ".join(f"{c} string" for c in packs.FIELDS))
    got = {tuple(r[c] for c in packs.FIELDS): r.errors for r in packs.validate(df, found.excerpts, found.units).collect()}
    assert {k: [e.field for e in v] for k, v in got.items()} == cases
    assert "cut" in got[list(cases)[1]][0].reason and "cut" not in got[list(cases)[6]][0].reason
    odd = packs.validate(df.withColumn("extra", df.title), found.excerpts, found.units).collect()
    assert all(any(e.field == "<unknown>" for e in r.errors) for r in odd)


def test_written_packs_repeat(spark, tmp_path):
    rows = [("u", "a.py", 1, 2, "é\n\"x\"", 1), ("u", "b.py", 1, 1, "z", 2), ("v", "a.py", 1, 2, "q", 1)]
    said = []
    for n in range(2):
        at = str(tmp_path / f"packs{n}")
        packs.write(packs.pack(excerpts(spark, rows)), at)
        said.append({u: [r.value for r in spark.read.text(f"{at}/unit={u}").collect()] for u in "uv"})
        with pytest.raises(Exception, match="(?i)exists"):
            packs.write(packs.pack(excerpts(spark, rows)), at)
    assert said[0] == said[1] and [json.loads(x).get("ref") for x in said[0]["u"]] == [None, "a.py:1-2", "b.py:1-1"]

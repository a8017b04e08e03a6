"""Many strings in many texts, against a search of each in each."""

import random
import re

import pytest

from assaykit.operators import contained


@pytest.mark.parametrize("shard_bytes", [1 << 20, 40])
def test_holders(spark, shard_bytes):
    r = random.Random(1)
    words = ["ab", "abc", "bc", "a-b", "c_d", "d", "é", "x.y", "ab abc", "FR-1", "FR-12"]
    texts = [(i, " ".join(r.choice([*words, "zz", "FR-123", "c_de", "-d"]) for _ in range(r.randrange(8)))) for i in range(60)] + [(99, None), (98, "")]
    names = [(w, whole) for w in words for whole in (True, False)]
    df = spark.createDataFrame(texts, "key int, text string").repartition(4)
    asked = spark.createDataFrame([*names, *names, ("", True), ("none", False)], "name string, whole boolean")
    has = lambda n, whole, t: bool(re.search(rf"(?<![\w-]){re.escape(n)}(?![\w-])", t) if whole else n in t)
    want = {(k, n, w) for k, t in texts for n, w in names if t and has(n, w, t)}
    assert {tuple(x) for x in contained.holders(df, asked, shard_bytes).collect()} == want
    first = {(x.name, x.whole): x.key for x in contained.first_holders(df, asked, shard_bytes).collect()}
    assert first == {(n, w): min(k for k, n2, w2 in want if (n2, w2) == (n, w)) for _, n, w in want}


def test_requirement_items(spark):
    docs = spark.createDataFrame(
        [("a.md", "FR-1 and FR-1, xFR-2\n  Scenario: \"Log in\",\nScenario:\nScenario Outline: Two  words\nNot Scenario: no"), ("b.md", "FR-1 REQ-Ab9 AC-"), ("c.md", None)], "path string, text string"
    )
    items = contained.requirement_items(docs)
    assert sorted(tuple(x) for x in items.collect()) == [("a.md", "id", "FR-1"), ("a.md", "line", "Log in"), ("a.md", "line", "Two  words"), ("b.md", "id", "FR-1"), ("b.md", "id", "REQ-Ab9")]
    files = spark.createDataFrame([("z.py", "# FR-1\n"), ("y.py", "# FR-11 REQ-Ab9-x"), ("t.py", "def test(): 'two\n   WORDS'"), ("s.py", None)], "path string, text string")
    found = {(x.path, x.item): x.found for x in contained.traced_items(items, files).collect()}
    assert found == {("a.md", "FR-1"): "z.py", ("b.md", "FR-1"): "z.py", ("a.md", "Log in"): None, ("a.md", "Two  words"): "t.py", ("b.md", "REQ-Ab9"): None}
    assert contained.traced_items(items.limit(0), files).count() == 0


def test_names_are_sought_only_in_texts_that_may_have_them(spark, monkeypatch):
    """Lines of all lengths, near copies of one long line and a line in every text, over several pieces: the same
    as a search of each in each, and the number of reads of the texts does not grow with the names' bytes."""
    r = random.Random(2)
    monkeypatch.setattr(contained, "PIECE", 50)
    words = ["größe", "x", "lorem", "ipsum", "𝒳y", "dolor", "a-b", "sit", "amet"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    common, base = "this line is in all of the texts there are", say(40)
    near = [base[: (k := r.randrange(1, len(base) - 1))] + f"{i}" + base[k:] for i in range(60)]
    lines = [[common, near[i], *(say(r.randrange(1, 12)) for _ in range(6))] for i in range(60)]
    texts = [(i, "\n".join(x)) for i, x in enumerate(lines)] + [(90, None), (91, ""), (92, base)]
    df = spark.createDataFrame(texts, "key int, text string").repartition(4)
    names = sorted({x for ls in lines for x in ls} | {base, "in no text at all, whatever one does", "no", "not it"})
    asked = spark.createDataFrame([(n, whole) for n in names for whole in (True, False)], "name string, whole boolean")
    has = lambda n, whole, t: bool(re.search(rf"(?<![\w-]){re.escape(n)}(?![\w-])", t) if whole else n in t)
    want = {(k, n, w) for k, t in texts for n in names for w in (True, False) if t and has(n, w, t)}
    reads = []
    seen = contained.map_batches
    monkeypatch.setattr(contained, "map_batches", lambda d, run, schema: reads.append(d.columns == ["key", "text"]) or seen(d, run, schema))
    assert {tuple(x) for x in contained.holders(df, asked, 200).collect()} == want
    assert sum(reads) <= 3  # the first q-grams, those of names whose q-grams are all frequent, and short names
    first = {(x.name, x.whole): x.key for x in contained.first_holders(df, asked, 200).collect()}
    assert first == {(n, w): min(k for k, n2, w2 in want if (n2, w2) == (n, w)) for _, n, w in want}

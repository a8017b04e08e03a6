"""Many items and many texts in one run; item ids of other types."""

from assaykit.llm import decontaminate


def test_many_items_and_texts_lose_nothing():
    word = lambda i: "".join(chr(97 + (i >> 4 * j) % 16) for j in range(5))
    items = [(i, f"q{i} {word(i)} {word(i * 7 + 1)}") for i in range(250_000)]
    texts = [f"other words {i}".encode() for i in range(9500)] + [f"before {items[249_000][1]} after".encode()]
    found = decontaminate.Items(items, decontaminate.Q, 0.0).occurrences(texts)
    assert (9500, 249_000) in {(t, i) for t, i, *_ in found}


def test_item_ids_keep_their_type(spark):
    docs = spark.createDataFrame([(1, "x the one long sentence of the benchmark y"), (2, None)], "doc_id long, text string")
    for kind, key in (("int", 7), ("string", "a"), ("short", 3)):
        items = spark.createDataFrame([(key, "the one long sentence of the benchmark")], f"item_id {kind}, text string")
        rows = decontaminate.find_leaks(docs, items).collect()
        assert [(r.doc_id, r.item_id) for r in rows] == [(1, key)]


def test_shared_openings(monkeypatch):
    """Items that begin alike leave out what they share and still lose no occurrence."""
    import random

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    opening = " ".join(word() for _ in range(9))
    ends = [" ".join(word() for _ in range(rng.choice([4, 12, 40]))) for _ in range(60)]
    items = [(i, f"{opening} {e}") for i, e in enumerate(ends)]

    def edited(text, n):
        text = list(text)
        for _ in range(n):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], ["z"], [text[at], "y"]])
        return "".join(text)

    texts = [f"{word()} {edited(items[i][1], k)} {word()} {opening} {opening}" for i in range(60) for k in (0, 2, len(items[i][1]) // 25)]
    texts += [f"{opening} " * 40, opening, ""]
    raws = [t.encode() for t in texts]
    lean = decontaminate.Items(items, decontaminate.Q, decontaminate.RATE)
    monkeypatch.setattr(decontaminate, "SHARED", 1 << 30)
    full = decontaminate.Items(items, decontaminate.Q, decontaminate.RATE)
    assert len(lean.item) < len(full.item) and (lean.needed > 0).all()
    got = lean.occurrences(raws)
    assert got == full.occurrences(raws) and len(got) >= 120
    # few candidates and matches at a time give the same
    monkeypatch.setattr(decontaminate, "CELLS", 50)
    monkeypatch.setattr(decontaminate, "MATCHES", 100)
    assert lean.occurrences(raws) == got


def test_many_items_with_one_opening_are_quick():
    import random
    import time

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    opening = "the one opening that all of these many items have in common here"
    items = decontaminate.Items([(i, f"{opening} " + " ".join(word() for _ in range(60))) for i in range(2000)], decontaminate.Q, decontaminate.RATE)
    began = time.time()
    assert items.occurrences([(f"{opening} " * 4000).encode()]) == []
    assert time.time() - began < 10


def test_short_items_are_named(spark):
    items = spark.createDataFrame([(1, "short"), (2, "long enough to look for"), (3, None), (4, " .. "), (5, "a b c d e!"), (6, "a b c d e f")], "item_id int, text string")
    assert {r.item_id: r.symbols for r in decontaminate.unsearched(items).collect()} == {1: 5, 3: 0, 4: 0, 5: 9}

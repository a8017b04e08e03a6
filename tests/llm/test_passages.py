"""Passages of 50 words on two lines, which the pipeline's line dedup takes out."""

import random
import re

import corpus_pipeline
from assaykit.llm import line_dedup


def brute(docs):
    """docs: (doc_id, text) in order. The texts less runs of 3 lines, lines of 50 words and pairs of 50."""
    seen, out = set(), {}
    for i, t in docs:
        lines = t.split("\n")
        n = [len(re.findall(r"[^ \t-\r]+", x)) for x in lines]
        units = [(3, p) for p in range(len(lines) - 2) if "".join(lines[p : p + 3]).strip(" ")]
        units += [(1, p) for p in range(len(lines)) if n[p] >= 50]
        units += [(2, p) for p in range(len(lines) - 1) if n[p] + n[p + 1] >= 50]
        dead = set()
        for k, p in units:
            if (k, *lines[p : p + k]) in seen:
                dead.update(range(p, p + k))
            seen.add((k, *lines[p : p + k]))
        out[i] = "\n".join(x for p, x in enumerate(lines) if p not in dead) if dead else t
    return out


def test_a_passage_on_two_lines_goes(spark):
    line = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    a, b, short = line("a", 47), line("b", 38), line("s", 2)
    docs = [(1, f"{a}\n{b}"), (2, f"{a}\n{b}"), (3, f"own\n{a}\n{b}\nmore"), (4, f"{a}\nelse\n{b}"), (5, f"{a}\n{short}"), (6, f"{a}\n{short}\nx"), (7, b), (8, "")]
    rng = random.Random(5)
    pool = [line(f"p{k}_", rng.randint(0, 40)) for k in range(12)]
    docs += [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(9, 90)]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_chars int").repartition(5)
    want = brute(docs)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, pairs=True).collect()}
    assert got == want and (got[2], got[3], got[6]) == ("", "own\nmore", f"{a}\n{short}\nx")
    kept = {r.doc_id: r.text for r in corpus_pipeline.remove_repeated_lines(spark, df, "").collect()}
    assert 2 not in kept and kept[3] == "own\nmore" and kept[4] == docs[3][1]

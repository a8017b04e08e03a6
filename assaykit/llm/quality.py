"""Quality by weak supervision, with DataFrame operations only.

Rules on a document's counts vote for it, against it or abstain. Votes of all documents are
counted by pattern (at most 3 to the number of rules, so the table of patterns is bounded), and
expectation-maximisation over the patterns estimates the accuracy of each rule and the share of
good documents without labels. A document's verdict is its posterior, a sum of the log-odds of the
rules that voted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import let, scratch

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"#*$%&|<>"
#: A word without a letter or a digit.
BARE = r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
THRESHOLD = 0.5
ROUNDS = 50
#: Where the estimation starts: the share of good documents and the log-odds of a vote for and of one
#: against. Most good documents pass most rules, so passing says nothing yet and failing a lot.
START_SHARE, START_ODDS = 0.9, (0.0, -3.0)
#: Share and log-odds stay within these bounds.
MAX_SHARE, MAX_ODDS = 0.99, 6.0
#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = "the and of to in is that it was for on with as at by le la les de des et un une est que dans du qui der die das und den ein eine ist von mit zu nicht el los las en y por con se para es una".split()


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the array, the first included."""

    def covered(windows: Column) -> Column:
        ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s: F.transform(F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1).h == x.h, F.lit(False)) | F.coalesce(F.get(s, j + 1).h == x.h, F.lit(False))), lambda x: x.i)
        width = lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(ranked, lambda s: let(F.array_sort(same(s)), width)))

    # windows are told apart by 64-bit hashes
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, covered)).cast("bigint")


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts that rules use, a row per row of docs; a null text counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, SPACE, -1), "")
    blanks = F.lit(" \t\n\x0b\f\r")
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.btrim(x, blanks)) > 0)
    without = lambda x, marks: F.length(F.translate(x, marks, "")).cast("bigint")
    size = F.length(body).cast("bigint")
    common = lambda w: F.size(F.filter(w, lambda x: F.lower(x).isin(FUNCTION_WORDS)))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words"), common(w).cast("bigint").alias("n_function_words")))
    ended = lambda x: F.rtrim(x).rlike(r"[.!?:;\"')\]]$")
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"), F.size(F.filter(x, ended)).cast("bigint").alias("n_ended_lines")))
    letters = F.regexp_replace(body, r"[^\p{L}]+", "")
    of_letters = let(letters, lambda x: F.struct(F.length(x).cast("bigint").alias("n_letters"), F.length(F.regexp_replace(x, r"[^\p{Lu}]+", "")).cast("bigint").alias("n_capitals")))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        of_words.alias("w"),
        of_lines.alias("l"),
        without(body, " \t\n\x0b\f\r").alias("word_chars"),
        (size - without(body, SYMBOLS)).alias("n_symbols"),
        of_letters.alias("c"),
        (size - without(body, "!")).alias("n_shouts"),
        F.regexp_count(body, F.lit(BARE)).cast("bigint").alias("n_bare_words"),
    ).select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "c.*", "n_shouts", "n_bare_words")


def rules() -> dict[str, tuple[Column, Column]]:
    """(votes for, votes against) by name; where neither holds a rule abstains."""
    c = F.col
    part = lambda x, y: c(x) / F.greatest(c(y), F.lit(1))
    return {
        "long_enough": (c("n_words") >= 2 * MIN_WORDS, c("n_words") < MIN_WORDS),
        "word_length": (part("word_chars", "n_words").between(3, 10), ~part("word_chars", "n_words").between(2, 14)),
        "few_symbols": (part("n_symbols", "n_words") <= 0.02, part("n_symbols", "n_words") > 0.2),
        "mostly_letters": (part("n_letters", "word_chars") >= 0.9, part("n_letters", "word_chars") < 0.75),
        "calm_case": (part("n_capitals", "n_letters") <= 0.15, part("n_capitals", "n_letters") > 0.4),
        "wordy": (F.lit(False), part("n_bare_words", "n_words") > 0.2),
        "calm_marks": (part("n_shouts", "n_words") <= 0.02, part("n_shouts", "n_words") > 0.2),
        "new_lines": (c("n_dup_lines") == 0, part("n_dup_lines", "n_lines") > 0.3),
        "new_phrases": (part("n_repeat_words", "n_words") <= 0.1, part("n_repeat_words", "n_words") > 0.3),
        "ended_lines": (part("n_ended_lines", "n_lines") >= 0.7, part("n_ended_lines", "n_lines") < 0.2),
        "function_words": (part("n_function_words", "n_words") >= 0.05, (c("n_function_words") == 0) & (c("n_words") >= MIN_WORDS)),
    }


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """(share of good documents, log-odds of each rule's vote for and vote against) by
    expectation-maximisation.

    patterns: counts of vote tuples of 1, -1 and 0. Each rule has an accuracy on either class: the
    chance of each vote among good and among bad documents. A vote for never lowers a posterior nor
    does a vote against raise one, so the classes can't change places; abstaining says nothing.
    """
    width = len(next(iter(patterns), ()))
    good, odds = START_SHARE, [START_ODDS] * width
    for _ in range(rounds):
        mass = {True: 1.0, False: 1.0}
        votes = {k: [[0.5, 0.5] for _ in range(width)] for k in mass}
        for p, n in patterns.items():
            x = math.log(good / (1 - good)) + sum(o[v < 0] for v, o in zip(p, odds) if v)
            q = 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))
            for k, m in ((True, n * q), (False, n * (1 - q))):
                mass[k] += m
                for own, v in zip(votes[k], p):
                    if v:
                        own[v < 0] += m
        good = min(MAX_SHARE, max(1 - MAX_SHARE, mass[True] / (mass[True] + mass[False])))
        ratio = lambda i, j: math.log(votes[True][i][j] / mass[True]) - math.log(votes[False][i][j] / mass[False])  # noqa: E731, B023
        odds = [(min(MAX_ODDS, max(0.0, ratio(i, 0))), max(-MAX_ODDS, min(0.0, ratio(i, 1)))) for i in range(width)]
    return good, odds


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """counts() with base_failed, quality (posterior that the document is good) and kept.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows; such rows are
    not kept whatever the votes. Null, empty and wordless texts fail. Repeated rows are judged each;
    an empty table gives an empty result.
    """
    seen = scratch(counts(docs, doc_id, text), "counts")
    votes = {name: F.when(yes, 1).when(no, -1).otherwise(0) for name, (yes, no) in rules().items()}
    table = seen.select(*(v.alias(k) for k, v in votes.items())).groupBy(*votes).count().collect()
    good, weights = estimate({tuple(r[:-1]): r[-1] for r in table})
    odds = F.lit(math.log(good / (1 - good)))
    for vote, (yes, no) in zip(votes.values(), weights):
        odds = odds + F.when(vote > 0, yes).when(vote < 0, no).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    quality = 1 / (1 + F.exp(-odds))
    return seen.withColumns({"base_failed": failed, "quality": quality, "kept": ~failed & (quality >= threshold)})

"""Column helpers: paths, globs, the registry's token language, entropy, names, rounding."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """The last suffix with its dot, empty for none and for names that only start with a dot."""
    return F.regexp_extract(base_name(path), r"[^.](\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=[^.])\.[^.]*$", "")


def ancestors(path: Column) -> Column:
    """Array of all directories above a path, deepest last; the root is an empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def braces(pattern: str) -> list[str]:
    """The globs that a pattern with alternatives stands for, the leftmost braces varying slowest."""
    m = re.search(r"\{([^{}]*)\}", pattern)
    if not m:
        return [pattern]
    return [g for word in m[1].split(",") for g in braces(pattern[: m.start()] + word + pattern[m.end() :])]


def glob_regex(pattern: str) -> str:
    """A whole-path regex of a glob: ``**/`` any directories or none, ``**`` anything, ``*`` and ``?``
    within one segment. Everything else stands for itself."""
    pieces = re.split(r"(\*\*/|\*\*|\*|\?)", pattern)
    known = {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(known.get(p, re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", p)) for p in pieces) + "$"


def any_glob(patterns) -> str:
    """One whole-path regex of many globs. Its only anchors are its ends, so that a path is tried from its start
    alone and not from each of its characters, and directories before many names are read once."""
    deep = "(?:[^/]+/)*"
    bodies = [glob_regex(p)[1:-1] for p in patterns]
    anywhere = [b.removeprefix(deep) for b in bodies if b.startswith(deep)]
    return "^(?:" + "|".join([b for b in bodies if not b.startswith(deep)] + ([f"{deep}(?:{'|'.join(anywhere)})"] if anywhere else [])) + ")$"


def token_regex(token: str) -> str:
    """Java regex of a registry token.

    ``*`` is a run of word characters, ``?`` one of them, ``<...>`` a character class, ``<INTERP>`` the
    mark that the lexer leaves where a string with an expression in it starts, a blank is white space that must be there between word characters. All else stands for itself, so that a
    token can't carry a regex, and ends that are word characters stop at word boundaries.
    """
    out, word = [], r"[A-Za-z0-9_]"
    pieces = re.findall(r"<[A-Za-z0-9-]+>|\*+|\?| +|.", token)
    wordy = lambda p: p != "<INTERP>" and (p[0] in "*?<" or re.fullmatch(word, p[0]) is not None)
    for i, p in enumerate(pieces):
        if p == "<INTERP>":
            out.append(r"\x00")
        elif p[0] == "*":
            out.append(r"\w*")
        elif p == "?":
            out.append(r"\w")
        elif p[0] == "<" and len(p) > 2:
            out.append(f"[{p[1:-1]}]")
        elif p[0] == " ":
            tight = 0 < i < len(pieces) - 1 and wordy(pieces[i - 1]) and wordy(pieces[i + 1])
            out.append(r"\s+" if tight else r"\s*")
        else:
            out.append(re.sub(r"([^A-Za-z0-9_])", r"\\\1", p))
    ends = (r"\b" if pieces and wordy(pieces[0]) else "", r"\b" if pieces and wordy(pieces[-1]) else "")
    return ends[0] + "".join(out) + ends[1]


def any_token(tokens) -> str:
    """One regex for many tokens, the longest first."""
    return "(?:" + "|".join(token_regex(t) for t in sorted(set(tokens), key=lambda t: (-len(t), t))) + ")"


def shannon_bits(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty string. Stays in the JVM."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def fingerprint(secret: Column) -> Column:
    """The first four characters, a mask and twelve hex digits of the SHA-256."""
    return F.concat(F.substring(secret, 1, 4), F.lit("…****:"), F.substring(F.sha2(secret, 256), 1, 12))


def name_words(name: Column) -> Column:
    """Lower-case words of a camelCase or snake_case name."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0)), F.lower)


def singular(word: Column) -> Column:
    return F.when(word.rlike("[^aeiou]ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("[^s]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)


def half_even(value: Column) -> Column:
    """To an integer, ties to even: ratings and means."""
    return F.bround(value.cast("double"), 0).cast("int")


def half_up(value: Column) -> Column:
    """To an integer, ties up, in decimal: blends."""
    return F.round(value.cast("decimal(38,6)"), 0).cast("int")


def blend(rating: Column, score: Column, confidence: Column) -> Column:
    """Rating and an outside score; the score weighs half its confidence, the result stays in 0..100."""
    weight = (F.lit(0.5).cast("decimal(3,2)") * confidence.cast("decimal(10,4)")).cast("decimal(12,6)")
    mixed = rating.cast("decimal(10,0)") * (F.lit(1).cast("decimal(1,0)") - weight) + score.cast("decimal(10,0)") * weight
    return F.greatest(F.lit(0), F.least(F.lit(100), half_up(mixed)))


def within_band(value: Column, threshold: Column) -> Column:
    """Within a tenth of a threshold that is not 0."""
    v, t = value.cast("decimal(28,10)"), threshold.cast("decimal(28,10)")
    return (t != 0) & (F.abs(v - t) <= F.abs(t) * F.lit("0.1").cast("decimal(2,1)"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def decimal_text(value: Column) -> Column:
    """A number as text: without decimals if it is whole, with two if these are exact, else as it is."""
    exact = value.cast("decimal(38,2)")
    whole = exact.cast("decimal(38,0)")
    return F.when(value == whole.cast("double"), whole.cast("string")).when(value == exact.cast("double"), exact.cast("string")).otherwise(value.cast("string"))


def utc_name(at: Column) -> Column:
    """A name for a moment: its UTC date, time and microseconds."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyyMMdd'T'HHmmss-SSSSSS'Z'")


def whole_words(keys: Column) -> Column:
    """A regex of keys as whole words, in which a hyphen is part of a word; the longest first."""
    quoted = F.transform(F.array_sort(keys, lambda a, b: F.length(b) - F.length(a)), lambda k: F.concat(F.lit("\\Q"), k, F.lit("\\E")))
    return F.concat(F.lit("(?<![A-Za-z0-9_-])(?:"), F.array_join(quoted, "|"), F.lit(")(?![A-Za-z0-9_-])"))

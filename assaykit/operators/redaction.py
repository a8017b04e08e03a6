"""Redaction in full: named detectors, three rules on entropy, contexts in which a digest is no secret.

Detectors claim spans; claims are settled in order of rank, so a named detector's span stands and what
overlaps it gives way, and within a rank the earlier, then the longer claim stands. A claim needs the
text around it, so texts go through an Arrow function; each pattern is bounded and runs once a text.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.ship import map_batches
from assaykit.operators.facts import DETECTORS

#: Candidates of the entropy rules with their least bits a character.
LONG, LONG_BITS = r"[A-Za-z0-9+/=_-]{32,512}", 4.0
SEGMENT, SEGMENT_BITS = r"[A-Za-z0-9_-]{12,512}", 3.0
HEX, HEX_BITS = r"\b[0-9a-fA-F]{32,512}\b", 3.2
#: Shapes of names, paths and identifiers that are no key material.
WORD = r"(?:[A-Z]{1,30}|[A-Z]?[a-z]{1,30})"
PIECE = rf"(?:{WORD}|[0-9]{{1,8}}|(?:[a-z]{{1,30}}|[A-Z]{{1,30}})[0-9]{{1,8}})"
NAME = rf"{PIECE}(?:[/_-]{PIECE}){{1,30}}"
LOWER_PATH = r"(?:[a-z]{1,30}[0-9]{0,8}|[0-9]{1,8})(?:[/_-](?:[a-z]{1,30}[0-9]{0,8}|[0-9]{1,8})){1,30}"
IDENTIFIER = rf"{WORD}(?:_{WORD}){{1,30}}"
CONSTANT = rf"_?{WORD}(?:_{WORD}){{0,30}}=_?[A-Z]{{1,30}}(?:_[A-Z]{{1,30}}){{1,30}}"
PATH, FILE_SUFFIX = r"^[~/]|/[a-z]{1,20}/", r"\.[A-Za-z0-9]{1,10}(?![A-Za-z0-9+/=_-])"
URL = r"https?://([^\s/\"'<>`?#()\[\]{}|\\@]{1,255}(?![^\s/]*@)(?:/[^\s\"'<>`?#@()\[\]{}|\\]{0,2000})?)"
LICENCE = r"(?m)(?<![A-Za-z0-9_])(?i:licen[cs]e)[\"']?[ \t]{0,20}[:=][ \t]{0,20}[\"']?([A-Za-z0-9.+-]{1,64})(?=[\"']?[ \t]*(?:[,;)}\]\r\n]|$))"
#: Keys whose line holds a digest, digests by their place, and words that veto both.
DIGEST_KEY = r"(?i)(?<![A-Za-z0-9])(?:sha(?:1|224|256|384|512)?(?:sum)?|shasum|md5(?:sum)?|blake2[bs]?|integrity|hash(?:es)?|narhash|checksum|digest|rev|commit|pinned|resolved_reference)[\"']?(?:[ \t]{0,20}[:=]|[ \t]{1,20}(?=sha(?:1|256|384|512)-))"
DIGESTS = (
    r"(?:\.tgz|\.git|git\+[^\s\"'#]{1,500})#([0-9a-fA-F]{40}|[0-9a-fA-F]{64})(?![0-9A-Za-z])",
    r"(?:(?<![A-Za-z0-9])(?i:commits?)[^0-9A-Za-z\n]{1,20}|raw\.githubusercontent\.com/[^/\s]{1,100}/[^/\s]{1,100}/|/(?:blob|tree)/)([0-9a-f]{40})(?![0-9A-Za-z])",
    r"(?m)^([0-9a-f]{64}|[0-9a-f]{128}) [ *][^\s][^\r\n]{0,500}$",
)
VETO = r"(?i)api[_-]?key|apikey|secret|token|passw(?:or)?d|pwd|access[_-]?key|private[_-]?key|credential|authorization"


def bits(value: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(value)
    return math.log2(n) - sum(c * math.log2(c) for c in Counter(value).values()) / n if n else 0.0


class Spans:
    """Disjoint spans in order, with a quick look for what touches or holds another."""

    def __init__(self, spans=()):
        self.spans: list[tuple[int, int]] = sorted(spans)

    def holds(self, start: int, end: int) -> bool:
        i = bisect_right(self.spans, (start, math.inf)) - 1
        return i >= 0 and self.spans[i][1] >= end

    def touches(self, start: int, end: int) -> bool:
        i = bisect_left(self.spans, (end, -1)) - 1
        return i >= 0 and self.spans[i][1] > start


def _digest_context(text: str) -> Spans:
    """Lines with a digest's key, and digests by their place; a word of secrets on the line vetoes both."""
    ends = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_left(ends, at)
    vetoed = {line(m.start()) for m in re.finditer(VETO, text)}
    keyed = {line(m.start()) for m in re.finditer(DIGEST_KEY, text)}
    whole = [(ends[i - 1] + 1 if i else 0, ends[i] if i < len(ends) else len(text)) for i in keyed - vetoed]
    own = [m.span(1) for p in DIGESTS for m in re.finditer(p, text)]
    return Spans([*whole, *{s for s in own if line(s[0]) not in vetoed | keyed}])


def _suspects(text: str):
    """(start, end, detector) of the entropy rules."""
    context = urls = licences = None
    full = re.fullmatch

    def is_name(m) -> bool:
        nonlocal urls
        if not full(NAME, m[0].rstrip("/")):
            return False
        if re.compile(FILE_SUFFIX).match(text, m.end()):
            return True
        urls = urls or Spans(x.span(1) for x in re.finditer(URL, text))
        return urls.holds(*m.span())

    def plain(m) -> bool:
        v = m[0]
        return bool(re.search(PATH, v)) or is_name(m) or bool("/" in v and full(LOWER_PATH, v)) or bool(full(IDENTIFIER, v)) or bool(full(CONSTANT, v))

    def ordinary(m) -> bool:
        nonlocal licences
        v = m[0]
        if not (re.search("[a-z]", v) and re.search("[A-Z]", v) and re.search("[0-9]", v)) or is_name(m):
            return True
        licences = licences or Spans(x.span(1) for x in re.finditer(LICENCE, text))
        return bool(full(NAME, v)) and licences.holds(*m.span())

    for detector, pattern, least, harmless in (("high_entropy_string", LONG, LONG_BITS, plain), ("key_material_segment", SEGMENT, SEGMENT_BITS, ordinary), ("high_entropy_hex", HEX, HEX_BITS, lambda m: False)):
        for m in re.finditer(pattern, text):
            if bits(m[0]) >= least and not harmless(m):
                context = context or _digest_context(text)
                if not context.holds(*m.span()):
                    yield (*m.span(), detector)


def secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, detector) of what is redacted, in order; no two overlap."""
    named = [(*m.span(group), name) for name, pattern, group in DETECTORS for m in re.finditer(pattern, text)]
    claims = sorted((0, a, -b, name) for a, b, name in named if b > a) + sorted((1, a, -b, name) for a, b, name in _suspects(text))
    taken, out = Spans(), []
    for _, a, b, name in claims:
        if not taken.touches(a, -b):
            insort(taken.spans, (a, -b))
            out.append((a, -b, name))
    return sorted(out)


def fingerprint(value: str) -> str:
    return f"{value[:4]}…****:{hashlib.sha256(value.encode('utf-8', 'surrogatepass')).hexdigest()[:12]}"


def redacted(text: str) -> str:
    out, at = [], 0
    for a, b, _ in secrets(text):
        out += [text[at:a], fingerprint(text[a:b])]
        at = b
    return "".join(out) + text[at:]


def redacted_path(path: str) -> str:
    """A path with each of its segments redacted by itself, so that the others can still be read."""
    return "/".join(map(redacted, path.split("/")))


def scan(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, detector, fingerprint, offset, line) of every span; the value itself never leaves. A null text
    has none."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for a, b, name in secrets(t) if t else ():
                    at.append(i)
                    rows.append((name, fingerprint(t[a:b]), a, t.count("\n", 0, a) + 1))
            cols = [pa.array([r[c] for r in rows], k) for c, k in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *cols], names=["key", "detector", "fingerprint", "offset", "line"])

    found = map_batches(files.select(F.col(key), F.col(text)), run, f"key {kind}, detector string, fingerprint string, offset int, line int")
    return found.withColumnRenamed("key", key)


def redact(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, text) with both redacted; a null stays null."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            paths = [p if p is None else redacted_path(p) for p in batch.column(0).to_pylist()]
            texts = [t if t is None else redacted(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["path", "text"])

    return map_batches(files.select(F.col(path).alias("path"), F.col(text).alias("text")), run, "path string, text string")


def redact_rows(rows: DataFrame, columns: list[str], path: str = "path") -> DataFrame:
    """rows with the named text columns redacted, the others as they are; ``path`` by segments. A null stays
    null."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            done = {c: pa.array([v if v is None else redacted_path(v) if c == path else redacted(v) for v in batch.column(batch.schema.get_field_index(c)).to_pylist()], pa.string()) for c in columns}
            yield pa.RecordBatch.from_arrays([done.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)

    return map_batches(rows, run, rows.schema)

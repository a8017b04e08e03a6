"""Facts in texts: redaction, personal data, references, requirement items, markup, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.text import any_token, shannon_bits

#: Named detectors in order, with the group that holds the secret.
DETECTORS = (
    ("private_key_pem", r"-----BEGIN[ A-Z]{0,40}PRIVATE KEY-----[^-]{0,20000}-----END[ A-Z]{0,40}PRIVATE KEY-----", 0),
    ("aws_access_key_id", r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ABIA|ACCA)[A-Z0-9]{16}\b", 0),
    ("aws_secret_access_key", r"""(?i)aws_secret_access_key["']?\s*[:=]\s*["']?([A-Za-z0-9/+=]{40})""", 1),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{4,2000}\.[A-Za-z0-9_-]{4,2000}\.[A-Za-z0-9_-]{4,2000}", 0),
    ("credential_assignment", r"""(?i)(?<![A-Za-z0-9])(?:api[_-]?key|apikey|secret[_-]?key|secret|token|password|passwd|pwd|access[_-]?key|client[_-]?secret|auth[_-]?token|authorization)["']?\s*[:=]\s*["']?([^\s"',;)}\]]{3,200})(?=["']?[ \t]*(?:[\r\n;,)}\]]|#|//|$))""", 1),
)
HEX_TOKEN, HEX_BITS = r"\b[0-9a-fA-F]{32,512}\b", 3.2
LONG_TOKEN, LONG_BITS = r"[A-Za-z0-9+/=_-]{32,512}", 4.0
#: Shapes of issue references and names that only look like one.
ISSUE_TOKENS = ("#<0-9>*", "GH-<0-9>*", "issues/<0-9>*", "pull/<0-9>*", "merge_requests/<0-9>*", "<A-Z><A-Z><A-Z0-9>*-<0-9>*")
NOT_ISSUES = ("UTF-", "UCS-", "SHA-", "AES-", "RSA-", "ISO-")
DEBT = r"\b(?:TODO|FIXME|HACK|XXX)\b"
TICKET = r"[A-Z][A-Z0-9]+-[0-9]+|#[0-9]+|https?://"


def entropy_tokens(text: Column, pattern: str = HEX_TOKEN, bits: float = HEX_BITS) -> Column:
    """Tokens of a shape whose entropy a character is at least ``bits``."""
    return F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: shannon_bits(t) >= bits)


def issue_references(text: Column) -> Column:
    """Distinct references, sorted; names that only look like one are dropped."""
    found = F.regexp_extract_all(text, F.lit(any_token(ISSUE_TOKENS).replace("\\b\\#", "#")), F.lit(0))
    ok = lambda r: r.rlike("[0-9]$") & ~r.rlike("^(?:" + "|".join(NOT_ISSUES) + ")")
    return F.array_sort(F.array_distinct(F.filter(found, ok)))


def debt_markers(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with a debt marker, and whether they name a ticket."""
    return lines.where(F.col(line).rlike(DEBT)).withColumn("ticket", F.col(line).rlike(TICKET))


def lines_of(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, line_no from 1, line)."""
    return files.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def headings(lines: DataFrame) -> DataFrame:
    """Markdown headings of lines: level and title."""
    found = F.regexp_extract("line", r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", 1)
    return lines.where(F.length(found) > 0).select(*lines.columns, F.length(found).alias("level"), F.regexp_extract("line", r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", 2).alias("title"))


def first_heading(text: Column) -> Column:
    """The first heading's title, or else the first line that is not blank."""
    title = F.regexp_extract(text, r"(?m)^#{1,6}[ \t]+(.*?)[ \t]*#*[ \t]*$", 1)
    plain = F.trim(F.regexp_extract(text, r"(?m)^[ \t]*(\S[^\n]*)$", 1))
    return F.when(F.length(title) > 0, title).otherwise(plain)


def phi_spans(text: Column) -> Column:
    """Array of (kind, value) of social security numbers, record numbers and dates of birth; number
    ranges that are never given out are placeholders."""
    ssn = F.filter(F.regexp_extract_all(text, F.lit(r"\b([0-9]{3}-[0-9]{2}-[0-9]{4})\b"), F.lit(1)), lambda v: ~v.rlike(r"^(?:000|666|9[0-9]{2})-|-00-|-0000$"))
    mrn = F.regexp_extract_all(text, F.lit(r"(?i)\bmrn[ \t]*[:#=]?[ \t]*([0-9]{6,10})\b"), F.lit(1))
    dob = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:dob|date of birth)[ \t]*[:=]?[ \t]*([0-9]{4}-[0-9]{2}-[0-9]{2})\b"), F.lit(1))
    tag = lambda kind, a: F.transform(a, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    return F.concat(tag("ssn", ssn), tag("mrn", mrn), tag("dob", dob))


def tags(html: Column, name: str) -> Column:
    """Start tags of a name, comments blanked."""
    return F.regexp_extract_all(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))


def viewport_state(html: Column) -> Column:
    """missing, zoom_disabled or fine."""
    found = F.filter(tags(html, "meta"), lambda t: t.rlike(r"""(?i)name\s*=\s*["']?viewport"""))
    locked = F.exists(found, lambda t: t.rlike(r"(?i)user-scalable\s*=\s*(?:no|0)|maximum-scale\s*=\s*1(?:\.0)?\b"))
    return F.when(F.size(found) == 0, "missing").when(locked, "zoom_disabled").otherwise("fine")


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), F.lit(1))

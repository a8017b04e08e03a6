"""What files of code are and what stands in them, as columns over paths and blanked lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions import text as T
from assaykit.operators import lexer
from assaykit.operators.metrics import ratio
from assaykit.sources import patterns as P
from assaykit.sources import registry


def by_language(language: Column, field: str, line: Column) -> Column:
    """Whether a line has a token of the field in its language; null for languages without the field."""
    out = F.lit(None).cast("boolean")
    for name, tokens in registry.tokens(field).items():
        out = F.when(language == name, line.rlike(T.any_token(tokens))).otherwise(out)
    return out


def count_by_language(language: Column, field: str, text: Column) -> Column:
    out = F.lit(0)
    for name, tokens in registry.tokens(field).items():
        out = F.when(language == name, F.regexp_count(text, F.lit(T.any_token(tokens)))).otherwise(out)
    return out


def knows(language: Column, field: str) -> Column:
    """Whether the registry has tokens of the field for a language: without any nothing is examined."""
    return F.coalesce(language.isin(*registry.tokens(field)), F.lit(False))


def _name_matches(path: Column, field: str) -> Column:
    globs = [g for tokens in registry.tokens(field).values() for g in tokens]
    return T.base_name(path).rlike("|".join(map(T.glob_regex, globs)))


def directory_says(path: Column) -> Column:
    """test, source or null: the deepest directory that says what is below it."""
    known = F.filter(F.reverse(F.split(F.lower(T.parent(path)), "/")), lambda d: d.isin(*P.TEST_DIRS, *P.SOURCE_DIRS))
    return F.when(F.get(known, F.lit(0)).isin(*P.TEST_DIRS), "test").when(F.size(known) > 0, "source")


def code_kind(path: Column) -> Column:
    """test, source or null. Only files of a language are either: a test by a name that says so
    anywhere, or else by the deepest directory, or else by an ambiguous name."""
    says = directory_says(path)
    test = _name_matches(path, "colocated_names") | F.coalesce(says == "test", _name_matches(path, "test_names"))
    return F.when(lexer.language(path).isNull(), None).when(test, "test").otherwise("source")


def layer(path: Column) -> Column:
    """The first layer whose paths fit, null for none."""
    out = F.lit(None).cast("string")
    for name, globs in reversed(P.LAYERS):
        out = F.when(path.rlike("|".join(map(T.glob_regex, globs))), name).otherwise(out)
    return out


def security_category(path: Column) -> Column:
    """Why a file matters to security, null where it does not."""
    low, name = F.lower(path), F.lower(T.base_name(path))
    parts = F.split(low, "/")
    auth = ~F.arrays_overlap(parts, F.array(*map(F.lit, P.TEST_DIRS))) & F.exists(parts, lambda p: p.rlike("auth|crypt|permission|session|token|password"))
    return (
        F.when(name.rlike(r"^\.env|\.pem$|\.key$|^id_rsa|\.p12$|\.pfx$"), "credential material")
        .when(name.isin("pyproject.toml", "package.json", "go.mod", "cargo.toml", "gemfile", "pom.xml", "composer.json", "uv.lock", "package-lock.json") | name.rlike(r"^requirements.*\.txt$"), "dependency manifest")
        .when(auth, "auth or crypto code")
        .when(name.rlike("^dockerfile") | low.rlike(r"^\.github/workflows/|^\.gitlab-ci\.yml$|^\.circleci/|kubernetes|(?:^|/)k8s/"), "permission, container, or CI configuration")
    )


def iac_kinds(text: Column) -> Column:
    """k8s-manifest, container-config and cloud-template by the top-level keys of YAML documents; keys
    of a CI file rule the container out."""
    docs = F.filter(F.split(text, r"(?m)^---.*$", -1), lambda d: F.trim(d) != "")
    keys = lambda d: F.regexp_extract_all(d, F.lit(r"(?m)^([A-Za-z][A-Za-z0-9_-]*):"), F.lit(1))
    has = lambda d, *names: F.forall(F.array(*map(F.lit, names)), lambda n: F.array_contains(keys(d), n))
    ci = lambda d: F.arrays_overlap(keys(d), F.array(*map(F.lit, ("stages", "jobs", "on", "workflow", "include", "pipelines"))))
    kinds = F.array(
        F.when(F.exists(docs, lambda d: has(d, "apiVersion", "kind")), F.lit("k8s-manifest")),
        F.when(F.exists(docs, lambda d: has(d, "services") & ~ci(d)), F.lit("container-config")),
        F.when(F.exists(docs, lambda d: has(d, "AWSTemplateFormatVersion") | (has(d, "Resources") & d.rlike(r"(?m)Type:\s*['\"]?AWS::"))), F.lit("cloud-template")),
    )
    return F.array_compact(kinds)


def sink_hits(lines: DataFrame) -> DataFrame:
    """(path, line_no, cwe): distinct hits in blanked lines (path, language, line_no, line): a sink's
    token, or a call of one that joins strings whose arguments have a plus sign."""
    def pattern(token: str, tail: str) -> str:
        bare, opens = token.removesuffix(" ?"), token.endswith(" ?")
        # a name that starts a token must not end another; a blank and ? at the end is any first argument
        before = r"(?<![.>$\w])" if T.token_regex(bare).startswith(r"\b") else ""
        return before + T.token_regex(bare) + (r"\s*\w" if opens else "") + tail

    marks = []
    for field, tail in (("sinks", ""), ("concat_sinks", r"[^()\n]*\+")):
        for name, keyed in registry.tokens(field).items():
            by_cwe: dict[str, list[str]] = {}
            for cwe, _, token in (k.partition("=") for k in keyed):
                by_cwe.setdefault(cwe, []).append(pattern(token, tail))
            for cwe, patterns in sorted(by_cwe.items()):
                marks.append(F.when((F.col("language") == name) & F.col("line").rlike("|".join(patterns)), F.lit(cwe)))
    return lines.select("path", "line_no", F.explode(F.array_distinct(F.array_compact(F.array(*marks)))).alias("cwe"))


def _declares(lines: DataFrame) -> Column:
    """Whether a line declares a test. Names of tests are strings, so the line is read as it is written where
    ``raw`` has it."""
    return F.coalesce(by_language(F.col("language"), "test_declarations", F.col("raw" if "raw" in lines.columns else "line")), F.lit(False))


def test_segments(lines: DataFrame) -> DataFrame:
    """(path, start, assertions): each declared test and the assertions before the next one, in blanked lines
    (path, language, line_no, line; raw)."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("start", F.last(F.when(_declares(lines), F.col("line_no")), ignorenulls=True).over(w))
    return marked.where("start is not null").groupBy("path", "start").agg(F.sum(count_by_language(F.col("language"), "assertions", F.col("line"))).alias("assertions"))


def skip_markers(lines: DataFrame) -> DataFrame:
    """(path, line_no, markers, own): lines with markers that skip a test. own: the line stands for a test of
    its own, as nothing binds it to a declared one. It is bound on a declaration's line; above the next one,
    if it starts with a sign and all lines between start with the same; and in a test's body, deeper indented
    than the last declaration above."""
    rows = lines if "raw" in lines.columns else lines.withColumn("raw", F.col("line"))
    order = Window.partitionBy("path").orderBy("line_no")
    above, below = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    here = _declares(rows)
    bare = F.regexp_replace("raw", r"^\s+", "")
    sign, indent = F.substring(bare, 1, 1), F.length("raw") - F.length(bare)
    rows = rows.withColumns({"__here": here, "__sign": sign, "__indent": indent})
    # lines that follow each other with the same sign are one run
    rows = rows.withColumn("__run", F.sum((F.col("__sign") != F.lag("__sign", 1, "").over(order)).cast("int")).over(order))
    before = F.struct(F.coalesce(F.lag("__run").over(order), F.lit(-1)).alias("run"), F.col("line_no").alias("at"))
    rows = rows.withColumn("__before", F.when(F.col("__here"), before))
    rows = rows.withColumns({"__next": F.first("__before", ignorenulls=True).over(below), "__above": F.last(F.when(F.col("__here"), F.col("__indent")), ignorenulls=True).over(above)})
    markers = count_by_language(F.col("language"), "skips", F.col("line"))
    annotates = F.coalesce(F.col("__sign").rlike(r"^\W$") & (F.col("__sign") != "_") & ((F.col("__next.at") == F.col("line_no") + 1) | (F.col("__next.run") == F.col("__run"))), F.lit(False))
    inside = F.coalesce(F.col("__indent") > F.col("__above"), F.lit(False))
    found = rows.select("path", "line_no", markers.alias("markers"), (~F.col("__here") & ~annotates & ~inside).alias("own"))
    return found.where("markers > 0")


def test_strength(lines: DataFrame) -> DataFrame:
    """assertion_density_per_test, tests_without_assertions_share and skipped_test_share of test lines: skipped
    are markers over tests, those included that a marker stands for."""
    tests = test_segments(lines).agg(F.count("*").alias("n"), F.sum("assertions").alias("a"), F.count_if(F.col("assertions") == 0).alias("bare"))
    skips = skip_markers(lines).agg(F.coalesce(F.sum("markers"), F.lit(0)).alias("skips"), F.coalesce(F.sum(F.when(F.col("own"), F.col("markers"))), F.lit(0)).alias("own"))
    both = tests.crossJoin(skips)  # one row each
    return both.select(ratio(F.col("a"), F.col("n")).alias("assertion_density_per_test"), ratio(F.col("bare"), F.col("n")).alias("tests_without_assertions_share"), ratio(F.col("skips"), F.col("n") + F.col("own")).alias("skipped_test_share"), "n", "a", "bare", "skips", "own")


def cookie_statements(lines: DataFrame) -> DataFrame:
    """(path, line_no, missing): cookie calls and the flags that their statement lacks. A statement goes
    on to the line on which its brackets close; one that does not close has missing null."""
    w = Window.partitionBy("path").orderBy("line_no")
    opens = F.regexp_count("line", F.lit(r"\(")) - F.regexp_count("line", F.lit(r"\)"))
    ahead = w.rowsBetween(0, 20)
    seen = lines.withColumns({"__texts": F.collect_list("line").over(ahead), "__opens": F.collect_list(opens).over(ahead)})
    calls = seen.where(F.coalesce(by_language(F.col("language"), "cookie_calls", F.col("line")), F.lit(False)))
    depth = F.transform(F.sequence(F.lit(1), F.size("__opens")), lambda n: F.aggregate(F.slice("__opens", F.lit(1), n), F.lit(0), lambda a, x: a + x.cast("int")))
    end = F.array_position(F.transform(depth, lambda d: d <= 0), F.lit(True)).cast("int")
    calls = calls.withColumn("__end", end).withColumn("__stmt", F.array_join(F.slice("__texts", F.lit(1), F.greatest("__end", F.lit(1))), " "))
    lacks = [F.when(~F.coalesce(by_language(F.col("language"), f"cookie_{f}", F.col("__stmt")), F.lit(False)), F.lit(f)) for f in ("secure", "httponly", "samesite")]
    return calls.select("path", "line_no", F.when(F.col("__end") > 0, F.array_compact(F.array(*lacks))).alias("missing"))


def reliability(lines: DataFrame) -> DataFrame:
    """(path, line_no, finding) in blanked lines: outbound calls without a timeout, queries in loops."""
    lang, line = F.col("language"), F.col("line")
    yes = lambda field: F.coalesce(by_language(lang, field, line), F.lit(False))
    indent = F.length(line) - F.length(F.ltrim(line))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(-40, -1)
    near = Window.partitionBy("path").orderBy("line_no").rowsBetween(0, 2)
    timed = F.max(yes("call_timeouts").cast("int")).over(near) == 1
    loops = F.collect_list(F.when(yes("loops"), F.struct(indent.alias("indent"), F.col("line_no").alias("n")))).over(w)
    text = lines.where(F.trim("line") != "").withColumns({"__indent": indent, "__timed": timed, "__loops": loops, "__low": F.collect_list(F.struct(indent.alias("indent"), F.col("line_no").alias("n"))).over(w)})
    in_loop = F.exists("__loops", lambda p: (p.indent < F.col("__indent")) & ~F.exists("__low", lambda q: (q.n > p.n) & (q.indent <= p.indent)))
    kinds = F.array_compact(F.array(F.when(yes("outbound_calls") & ~F.col("__timed"), F.lit("outbound_without_timeout")), F.when(yes("query_calls") & in_loop, F.lit("query_in_loop"))))
    return text.withColumn("__kinds", kinds).select("path", "line_no", F.explode("__kinds").alias("finding"))


def destructive_ops(lines: DataFrame) -> DataFrame:
    """(path, line_no): destructive statements of migrations that are not below a down or undo mark."""
    path = F.lower(F.col("path"))
    migration = F.array_contains(F.split(path, "/"), "migrations") & ~path.rlike(r"\.down\.|(?:^|/)u[0-9][^/]*$")
    mark = F.when(F.col("line").rlike(r"(?i)^\s*--.*\b(?:down|undo|rollback)\b|^\s*def (?:downgrade|down)\b"), "down").when(F.col("line").rlike(r"(?i)^\s*--.*\bup\b|^\s*def (?:upgrade|up)\b"), "up")
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.where(migration).withColumn("__state", F.last(mark, ignorenulls=True).over(w))
    hit = F.lower(F.col("line")).rlike(T.any_token(P.DESTRUCTIVE_DDL)) | F.lower(F.col("line")).rlike(P.DESTRUCTIVE_API)
    return rows.where((F.coalesce("__state", F.lit("up")) == "up") & hit & ~F.col("line").rlike(r"^\s*(?:--|#)")).select("path", "line_no")


def routes(lines: DataFrame) -> DataFrame:
    """(path, line_no, method, route, prefix): handlers and the static part of their path."""
    call = r"""(?i)(?:@\w+|\bapp|\brouter)\.(get|post|put|patch|delete|route|all)\s*\(\s*["'`]([^"'`]*)["'`]"""
    found = lines.withColumn("route", F.regexp_extract("line", call, 2)).withColumn("method", F.upper(F.regexp_extract("line", call, 1))).where("method <> ''")
    prefix = F.regexp_replace(F.regexp_extract("route", r"^/?((?:[^/:{<*]+(?:/|$))*)", 1), "/+$", "")
    return found.select("path", "line_no", F.when(F.col("method").isin("ROUTE", "ALL"), "ANY").otherwise(F.col("method")).alias("method"), "route", prefix.alias("prefix"))


def swallowed_errors(files: DataFrame) -> DataFrame:
    """(path, line_no): handlers that do nothing, in whole blanked texts (path, language, code), as a
    handler may go over several lines. Texts are split at the hits, so a hit's line is exact wherever
    the same handler stands again."""
    rows = []
    for name, tokens in registry.tokens("swallowed").items():
        gaps = F.split("code", T.any_token(tokens), -1)
        hits = F.regexp_extract_all("code", F.lit(T.any_token(tokens)), F.lit(0))
        newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
        before = F.transform(F.sequence(F.lit(1), F.size(hits)), lambda i: F.aggregate(F.slice(gaps, F.lit(1), i), F.lit(0), lambda a, x: a + newlines(x)) + F.aggregate(F.slice(hits, F.lit(1), i - 1), F.lit(0), lambda a, x: a + newlines(x)))  # noqa: B023
        rows.append(F.when((F.col("language") == name) & (F.size(hits) > 0), F.transform(before, lambda n: n + 1)))
    return files.select("path", F.explode(F.coalesce(*rows)).alias("line_no")) if rows else files.select("path", F.lit(0).alias("line_no")).limit(0)


def retries_without_backoff(lines: DataFrame) -> DataFrame:
    """(path, line_no): retry calls without a delay on their line or the four after it."""
    lang = F.col("language")
    yes = lambda field: F.coalesce(by_language(lang, field, F.col("line")), F.lit(False))
    near = Window.partitionBy("path").orderBy("line_no").rowsBetween(0, 4)
    marked = lines.withColumns({"__retry": yes("retries"), "__delay": F.max(yes("backoff").cast("int")).over(near)})
    return marked.where("__retry and __delay = 0").select("path", "line_no")


def test_network_calls(lines: DataFrame) -> DataFrame:
    """(path, line_no): lines of unit tests that call out; tests below integration and the like are left
    out."""
    unit = ~F.arrays_overlap(F.split(F.lower("path"), "/"), F.array(*map(F.lit, P.NOT_UNIT_DIRS)))
    return lines.where(unit & F.coalesce(by_language(F.col("language"), "network_calls", F.col("line")), F.lit(False))).select("path", "line_no").distinct()


def type_escapes(lines: DataFrame) -> DataFrame:
    """(escapes, lines, per_kloc) of source lines; stubs of types are left out."""
    known = lines.where(knows(F.col("language"), "type_escapes") & ~F.col("path").rlike(r"\.d\.ts$|\.pyi$"))
    return known.agg(F.sum(count_by_language(F.col("language"), "type_escapes", F.col("line"))).alias("escapes"), F.count("*").alias("lines")).select("escapes", "lines", ratio(F.col("escapes") * 1000, F.col("lines")).alias("per_kloc"))


#: Declarations of public names whose tokens end in a class of characters.
_DECLARES = {"python": r"^(?:async\s+def|def|class)\s+([A-Za-z]\w*)", "go": r"^(?:func(?:\s*\([^)]*\))?|type)\s+([A-Z]\w*)"}


def public_symbols(lines: DataFrame) -> DataFrame:
    """(path, symbol): names that lines (path, language, line) declare as public."""
    name = F.lit(None).cast("string")
    for language, tokens in registry.tokens("public").items():
        plain = T.any_token([t for t in tokens if not set("(<") & set(t)])
        name = F.when(F.col("language") == language, F.regexp_extract("line", _DECLARES.get(language, r"^\s*" + plain + r"\s+\*?([A-Za-z_$][\w$]*)"), 1)).otherwise(name)
    return lines.select("path", name.alias("symbol")).where("symbol <> ''").distinct()

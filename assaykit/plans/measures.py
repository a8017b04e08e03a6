"""Every metric of a corpus, each a number or a reason, with what it was read from.

A metric is a number only if something was examined: without a file of a language that has the tokens,
without a pipeline, a route or a commit, it abstains and says why. Families of metrics share a pass: each
is a few aggregates over checkpointed facts, so a family costs a scan or two whatever it gives, and one
that fails abstains with its error and leaves the others alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import text as T
from assaykit.functions.storage import checkpoints
from assaykit.operators import change, code, contained, delivery, diff, domain, facts, graph, joins, lexer, markup, rating, redaction, settings
from assaykit.operators.metrics import LOCAL, WHOLE_SET
from assaykit.sources import patterns as P
from assaykit.sources import registry
from assaykit.sources.roles import ROLES, SOUGHT

SCHEMA = "dimension string, metric string, kind string, value double, abstain_reason string, examined bigint, cited array<string>"
LAYOUT = ("src", "lib", "test", "tests")
#: Roles whose absence is a metric: 0 where the role is filled, else 1.
ABSENCES = {"lint_config_missing": ("lint-config",), "format_config_missing": ("format-config",), "lockfile_missing": ("lockfile",), "test_config_and_ci_missing": ("test-config", "ci-workflow"), "licence_file_missing": ("licence-file",), "codeowners_missing": ("codeowners",), "tool_version_pin_missing": ("tool-version-pin",), "dev_environment_missing": ("dev-environment",)}
#: Metrics of a whole set, which abstain where only a part was read.
WHOLE = frozenset("test_to_source_ratio source_files_without_covering_test assertion_density_per_test redacted_file_share declared_source_coverage mean_excerpt_lines source_file_share functions_over_ccn_10_share top_level_import_cycles layer_direction_violations request_paths max_fan_in_changed high_reach_files_without_test_share high_reach_churn_hotspot_share source_files_without_covering_test_share tests_without_assertions_share skipped_test_share type_escapes_per_kloc todo_without_ticket_share ci_actions_unpinned_share ci_lockfile_install_missing ci_provenance_step_missing".split())
#: Dimensions of the metrics that no rule rates.
UNRATED = {"test_to_source_ratio": "test-strategy", "source_files_without_covering_test": "test-strategy", "assertions_observed": "test-strategy", "redacted_file_share": "security", "excerpts_observed": "code-quality", "declared_source_coverage": "code-quality", "evidence_lines_observed": "code-quality", "mean_excerpt_lines": "code-quality", "source_file_share": "code-quality", "request_paths": "architecture", "requirements_docs_count": "requirement-fidelity", "max_function_ccn": "code-quality"}

Found = dict[str, tuple[float | None, str | None, int, list[str]]]


@dataclass
class Inputs:
    """files: path, text (and what else the source gives); commits: sha, message; commit_files: sha, path;
    diffs: diff_id, diff; excerpts: path, start_line, end_line. What is missing abstains."""

    files: DataFrame
    commits: DataFrame | None = None
    commit_files: DataFrame | None = None
    diffs: DataFrame | None = None
    excerpts: DataFrame | None = None
    truncated: bool = False


def _row(df: DataFrame, **columns: Column) -> dict:
    """One row of aggregates, with ``examined`` rows and the first and last path."""
    more = {"examined": F.count("*"), "low": F.min("path"), "high": F.max("path")} if "path" in df.columns else {"examined": F.count("*")}
    return df.agg(*(c.alias(k) for k, c in {**more, **columns}.items())).first().asDict()


def _told(row: dict, reason: str, **metrics) -> Found:
    """Metrics of a row: values stand if anything was examined."""
    cited = sorted({p for p in (row.get("low"), row.get("high")) if p})
    out = {}
    for name, value in metrics.items():
        known = row["examined"] and value is not None
        out[name] = (float(value) if known else None, None if known else reason, int(row["examined"]), cited if known else [])
    return out


def prepared(spark: SparkSession, files: DataFrame) -> DataFrame:
    """files with language, kind and code (blanked text), checkpointed once for all families."""
    checkpoints(spark)
    known = lexer.with_code(files.where("text is not null").select("path", "text"), marked="marked")
    return known.withColumn("kind", code.code_kind(F.col("path"))).checkpoint()


def _lines(files: DataFrame, column: str = "code") -> DataFrame:
    rows = files.where(F.col(column).isNotNull()).select("path", "language", "kind", F.posexplode(F.split(column, "\n", -1)).alias("line_no", "line"))
    return rows.withColumn("line_no", F.col("line_no") + 1)


def _of_role(files: DataFrame, *roles: str) -> DataFrame:
    return files.where(F.col("path").rlike("|".join(T.glob_regex(g) for r in roles for g in ROLES[r])))


def presence(spark, x: Inputs, files: DataFrame) -> Found:
    filled = {r.role: r.n for r in joins.resolve_roles(x.files, {k: list(v) for k, v in ROLES.items()}).groupBy("role").agg(F.count("*").alias("n")).collect()}
    n = x.files.agg(F.count("*"), F.min("path"), F.max("path")).first()
    row = {"examined": n[0], "low": n[1], "high": n[2]}
    return _told(row, "no_file", **{m: 0 if any(filled.get(r) for r in roles) else 1 for m, roles in ABSENCES.items()})


def documents(spark, x: Inputs, files: DataFrame) -> Found:
    docs = files.where(F.lower(F.col("path")).rlike(r"\.(?:md|rst|adoc|txt)$") & ~F.lower(T.base_name(F.col("path"))).rlike("^change(?:s|log)|^history|^news"))
    row = _row(docs)
    described = described_documents(docs, x.files).count()
    decided = domain.decisions(docs).count()
    lists = domain.requirement_lists(facts.lines_of(docs)).select("path").distinct().count()
    out = _told(row, "no_document", requirements_docs_count=lists)
    some = {**row, "examined": x.files.count()}
    return out | _told(some, "no_file", architecture_description_missing=int(not described), decision_records_missing=int(not decided), requirements_doc_missing=int(not lists))


def described_documents(docs: DataFrame, files: DataFrame, least: int = 3) -> DataFrame:
    """(path, entries): documents with at least so many lines that name a path of the corpus, or a
    directory of it, and say something of it in two words or more."""
    lines = facts.lines_of(docs)
    named = F.regexp_extract_all("line", F.lit(r"[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)*/?"), F.lit(0))
    rest = F.size(F.regexp_extract_all(F.regexp_replace("line", r"[A-Za-z0-9_.-]*[/.][A-Za-z0-9_./-]*", " "), F.lit(r"\p{L}{2,}"), F.lit(0)))
    words = lines.where(rest >= 2).select("path", "line_no", F.explode(F.array_distinct(F.transform(named, lambda w: F.regexp_replace(w, r"/$|\.$", "")))).alias("name")).where(F.col("name").contains("/") | F.col("name").contains("."))
    known = files.select(F.col("path").alias("name")).unionAll(files.select(F.explode(T.ancestors(F.col("path"))).alias("name"))).where("name <> ''").distinct()
    return words.join(known, "name", "left_semi").select("path", "line_no").distinct().groupBy("path").agg(F.count("*").alias("entries")).where(F.col("entries") >= least)


def shape(spark, x: Inputs, files: DataFrame) -> Found:
    every = x.files.withColumn("kind", code.code_kind(F.col("path")))
    row = _row(every, sources=F.count_if(F.col("kind") == "source"), tests=F.count_if(F.col("kind") == "test"))
    n = row["examined"] or 1
    out = _told(row, "no_file", source_file_share=row["sources"] / n)
    out |= _told({**row, "examined": row["sources"]}, "no_source_file", test_to_source_ratio=row["tests"] / (row["sources"] or 1))
    sources = files.where("kind = 'source'")
    functions = lexer.functions(sources)
    f = _row(functions, over=F.count_if(F.col("ccn") > 10), most=F.max("ccn"))
    out |= _told(f, "no_function", functions_over_ccn_10_share=(f["over"] or 0) / (f["examined"] or 1), max_function_ccn=f["most"])
    debt = _row(facts.debt_markers(_lines(files, "text")), bare=F.count_if(~F.col("ticket")))
    out |= _told(debt, "no_marker", todo_without_ticket_share=debt["bare"] / (debt["examined"] or 1))
    known = _lines(sources).where(code.knows(F.col("language"), "type_escapes") & ~F.col("path").rlike(r"\.d\.ts$|\.pyi$"))
    e = _row(known, hits=F.sum(code.count_by_language(F.col("language"), "type_escapes", F.col("line"))))
    return out | _told(e, "no_language_with_tokens", type_escapes_per_kloc=(e["hits"] or 0) * 1000 / (e["examined"] or 1))


def both_lines(files: DataFrame) -> DataFrame:
    """Lines blanked (line) and as written (raw)."""
    pairs = F.arrays_zip(F.split("code", "\n", -1).alias("line"), F.split("text", "\n", -1).alias("raw"))
    rows = files.where("code is not null").select("path", "language", "kind", F.posexplode(pairs).alias("line_no", "both"))
    return rows.select("path", "language", "kind", (F.col("line_no") + 1).alias("line_no"), "both.line", "both.raw")


def tests(spark, x: Inputs, files: DataFrame) -> Found:
    lines = both_lines(files.where("kind = 'test'"))
    known = lines.where(code.knows(F.col("language"), "test_declarations"))
    a = _row(known, hits=F.sum(code.count_by_language(F.col("language"), "assertions", F.col("line"))))
    s = code.test_strength(known).first()
    out = _told(a, "no_test_file", assertions_observed=a["hits"])
    out |= _told({**a, "examined": s["n"]}, "no_test", assertion_density_per_test=(s["a"] or 0) / (s["n"] or 1), tests_without_assertions_share=s["bare"] / (s["n"] or 1))
    out |= _told({**a, "examined": s["n"] + s["own"]}, "no_test", skipped_test_share=s["skips"] / ((s["n"] + s["own"]) or 1))
    calls = lines.where(code.knows(F.col("language"), "network_calls") & ~F.arrays_overlap(F.split(F.lower("path"), "/"), F.array(*map(F.lit, P.NOT_UNIT_DIRS))))
    n = _row(calls)
    out |= _told(n, "no_unit_test", network_calls_in_unit_tests_observed=code.test_network_calls(lines).count())
    pairs = test_pairs(files, x.files)
    sources = files.where("kind = 'source'")
    bare = _row(sources.join(pairs.select("path").distinct().withColumn("there", F.lit(1)), "path", "left"), without=F.count_if(F.col("there").isNull()))
    return out | _told(bare, "no_source_file", source_files_without_covering_test=bare["without"], source_files_without_covering_test_share=bare["without"] / (bare["examined"] or 1))


def test_pairs(files: DataFrame, every: DataFrame) -> DataFrame:
    """(path, test): sources and the tests that their names ask for, within a project."""
    templates: dict[str, list[str]] = {}
    for suffix, language in lexer.SUFFIXES.items():
        if found := registry.tokens("test_candidates").get(language):
            templates[suffix] = list(found)
    known = files.where("kind is not null").select("path", "kind")
    placed = joins.project_boundary(known, _of_role(every, "package-manifest"), list(LAYOUT))
    expected = joins.expected_tests(placed.where("kind = 'source'"), templates).join(placed.select("path", "project"), "path")
    return joins.correspondence(expected, placed.where("kind = 'test'").select("path", "project"))


def security(spark, x: Inputs, files: DataFrame) -> Found:
    hits = redaction.scan(files).groupBy("path").agg(F.count("*").alias("n"))
    r = _row(files.join(hits, "path", "left"), hits=F.sum("n"), flagged=F.count("n"))
    out = _told(r, "no_file", redaction_hits_observed=r["hits"] or 0, redacted_file_share=r["flagged"] / (r["examined"] or 1))
    kept = files.where("kind = 'source'")
    sources = _lines(kept)
    s = _row(sources.where(code.knows(F.col("language"), "sinks")).select("path").distinct())
    out |= _told(s, "no_language_with_tokens", sink_hits_observed=code.sink_hits(_lines(kept, "marked")).distinct().count())
    c = _row(code.cookie_statements(sources).where("missing is not null"), bad=F.count_if(F.size("missing") > 0))
    return out | _told(c, "no_cookie", cookie_flags_missing_observed=c["bad"])


def reliability(spark, x: Inputs, files: DataFrame) -> Found:
    sources = files.where("kind = 'source'")
    lines = _lines(sources)
    per = sources.agg(*(F.count_if(code.knows(F.col("language"), f)).alias(f) for f in ("outbound_calls", "query_calls", "swallowed", "retries")), F.min("path").alias("low"), F.max("path").alias("high")).first().asDict()
    found = {r.finding: r.n for r in code.reliability(lines).groupBy("finding").agg(F.count("*").alias("n")).collect()}
    values = {"outbound_calls_without_timeout_observed": ("outbound_calls", found.get("outbound_without_timeout", 0)), "queries_in_loops_observed": ("query_calls", found.get("query_in_loop", 0)), "swallowed_errors_observed": ("swallowed", code.swallowed_errors(sources).count()), "retries_without_backoff_observed": ("retries", code.retries_without_backoff(lines).count())}
    out: Found = {}
    for name, (field, value) in values.items():
        out |= _told({**per, "examined": per[field]}, "no_language_with_tokens", **{name: value})
    return out


def supply_chain(spark, x: Inputs, files: DataFrame) -> Found:
    ci, release = _of_role(files, "ci-workflow"), _of_role(files, "ci-workflow", "release-config")
    lines = facts.lines_of(ci)
    refs = _row(delivery.references(lines), bad=F.count_if(~F.col("pinned")))
    out = _told(refs, "no_external_reference", ci_actions_unpinned_share=refs["bad"] / (refs["examined"] or 1))
    out |= _told(_row(ci), "no_pipeline", ci_lockfile_install_missing=int(delivery.locked_installs(lines).isEmpty()))
    return out | _told(_row(release), "no_pipeline", ci_provenance_step_missing=int(delivery.provenance_steps(facts.lines_of(release)).isEmpty()))


def interfaces(spark, x: Inputs, files: DataFrame) -> Found:
    sources = files.where("kind = 'source'")
    raw = _lines(sources, "text")
    routes = code.routes(raw).checkpoint()
    r = _row(routes, versioned=F.count_if(delivery.versioned(F.col("route"))))
    specs = _of_role(files, "api-spec")
    s = _row(specs)
    blanked = _lines(sources)
    generators, markers = delivery.token_hits(blanked, "spec_generators").count(), delivery.token_hits(blanked, "version_markers").count()
    any_api = {**r, "examined": r["examined"] + s["examined"]}
    out = _told({**any_api, "examined": any_api["examined"] + generators}, "no_route", api_spec_missing=int(not (s["examined"] or generators)))
    out |= _told(any_api, "no_route", api_version_missing=int(not (r["versioned"] or markers or not delivery.spec_versions(facts.lines_of(specs)).isEmpty())))
    able = sources.join(routes.select("path").distinct(), "path", "left_semi").where(code.knows(F.col("language"), "validation")).count()
    out |= _told({**r, "examined": able}, "no_route", request_validation_missing=int(delivery.token_hits(blanked, "validation").isEmpty()))
    out |= _told(r, "no_route", request_paths=r["examined"])
    text = files.where("kind = 'test'").agg(F.count("*").alias("n")).first()[0]
    words = _lines(files.where("kind = 'test'"), "text").select(F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"[A-Za-z0-9_./-]+"), F.lit(0)))).alias("w")).select(F.explode(F.filter(T.ancestors(F.concat(F.regexp_replace("w", "^/", ""), F.lit("/"))), lambda a: a != "")).alias("prefix")).distinct()
    prefixes = routes.select("path", "line_no", F.regexp_replace("prefix", "^/", "").alias("prefix")).where("prefix <> ''")
    tested = _row(prefixes.join(words.withColumn("there", F.lit(1)), "prefix", "left"), bare=F.count_if(F.col("there").isNull()))
    out |= _told({**tested, "examined": tested["examined"] if text else 0}, "no_route_or_test", routes_without_test_share=tested["bare"] / (tested["examined"] or 1))
    if x.diffs is None:
        return out | _told({"examined": 0}, "no_change", breaking_api_changes_observed=None)
    parsed = diff.parse(x.diffs)
    is_spec = F.col("path").rlike("|".join(map(T.glob_regex, ROLES["api-spec"])))
    read = _row(parsed.where(is_spec | (code.code_kind(F.col("path")) == "source")).select("path").distinct())
    gone = delivery.removed_keys(parsed, is_spec).count() + delivery.removed_routes(parsed.where(code.code_kind(F.col("path")) == "source")).count()
    return out | _told(read, "no_change", breaking_api_changes_observed=gone)


def schemas(spark, x: Inputs, files: DataFrame) -> Found:
    units = _row(delivery.migration_units(files), bare=F.count_if(~F.col("undone")))
    schema = files.where(delivery.is_migration(F.col("path")) | F.col("text").rlike(delivery.CREATES) | F.col("path").rlike("|".join(map(T.glob_regex, ROLES["schema-file"]))))
    s = _row(schema, bound=F.count_if(F.exists(F.split("text", "\n"), lambda line: line.rlike(delivery.CONSTRAINT))))
    out = _told(s, "no_schema", migrations_missing=int(not units["examined"]), schema_constraints_missing=int(not s["bound"]))
    out |= _told(units, "no_migration", migrations_without_rollback_share=round((units["bare"] or 0) / (units["examined"] or 1), 4))
    return out | _told(units, "no_migration", destructive_migration_ops_observed=code.destructive_ops(_lines(files, "text")).count())


def operations(spark, x: Inputs, files: DataFrame) -> Found:
    sources = files.where("kind = 'source'")
    raw, blanked = _lines(sources, "text"), _lines(sources)
    s = _row(sources)
    manifests = _of_role(files, "package-manifest")
    every = [t for tokens in registry.tokens("logging").values() for t in tokens if "." in t or "/" in t or t.islower()]
    logging = not delivery.token_hits(raw, "logging").isEmpty() or not manifests.where(F.col("text").rlike(T.any_token(every))).isEmpty() or not _of_role(x.files, "observability-config").isEmpty()
    out = _told(s, "no_source_file", logging_library_missing=int(not logging), audit_log_writes_missing=int(blanked.where(F.col("line").rlike(delivery.AUDIT)).isEmpty()))
    agents = _of_role(files, "agent-config")
    guarded = F.col("path").rlike(delivery.GUARDRAIL_PATH) | F.col("text").rlike(delivery.GUARDRAILS)
    a = _row(agents, guarded=F.count_if(guarded))
    return out | _told(a, "no_agent_config", agent_guardrails_missing=int(not a["guarded"]), agent_config_secrets_observed=redaction.scan(agents).count())


def infrastructure(spark, x: Inputs, files: DataFrame) -> Found:
    placed = files.withColumn("kinds", F.when(F.lower("path").rlike(r"\.ya?ml$"), code.iac_kinds(F.col("text"))).otherwise(F.array().cast("array<string>")))
    globs = "|".join(T.glob_regex(g) for r in ("terraform-file", "k8s-manifest", "cloud-template") for g in ROLES[r])
    iac = placed.where(F.col("path").rlike(globs) | F.arrays_overlap("kinds", F.array(F.lit("k8s-manifest"), F.lit("cloud-template"))))
    terraform = _of_role(files, "terraform-file")
    found = {r.finding: r.n for r in delivery.infrastructure_hits(facts.lines_of(iac)).groupBy("finding").agg(F.count("*").alias("n")).collect()}
    blocks = {r.fact: r.n for r in delivery.block_facts(terraform).groupBy("fact").agg(F.count("*").alias("n")).collect()}
    i, t = _row(iac), _row(terraform)
    out = _told(i, "no_infrastructure_file", iac_wildcard_iam_observed=found.get("wildcard_iam", 0), iac_open_ingress_observed=found.get("open_ingress", 0), iac_unencrypted_storage_observed=found.get("unencrypted_storage", 0) + blocks.get("encryption_not_set", 0))
    out |= _told(t, "no_terraform_file", terraform_locked_remote_state_missing=int(not blocks.get("locked_backend")), terraform_environment_separation_missing=int(delivery.environment_files(terraform).isEmpty()))
    return out | _told({**t, "examined": blocks.get("database", 0)}, "no_database", database_backup_unconfigured=blocks.get("database_without_backup", 0), database_ha_unconfigured=blocks.get("database_without_ha", 0))


def file_edges(files: DataFrame) -> DataFrame:
    """(src, dst): files and the ones that they import, by the last part of the imported name where one
    file only has it."""
    sources = files.where("kind = 'source'")
    named = lexer.imported_names(lexer.import_statements(sources)).select(F.col("path").alias("src"), "name")
    owners = joins.unique_owners(sources.select(T.stem(F.col("path")).alias("name"), F.col("path").alias("owner")).distinct()).withColumnRenamed("owner", "dst")
    return named.join(owners, "name").where("src <> dst").select("src", "dst").distinct()


def _module(path: Column) -> Column:
    """The first directory of a path below a source root."""
    return F.regexp_extract(F.regexp_replace(path, "^(?:src|lib|app)/", ""), r"^([^/]+)/", 1)


def structure(spark, x: Inputs, files: DataFrame) -> Found:
    sources = files.where("kind = 'source'").select("path")
    edges = file_edges(files).checkpoint()
    s = _row(sources, layered=F.count_if(code.layer(F.col("path")).isNotNull()))
    modules = edges.select(_module(F.col("src")).alias("src"), _module(F.col("dst")).alias("dst")).where("src <> '' and dst <> '' and src <> dst").distinct()
    out = _told(s, "no_source_file", top_level_import_cycles=graph.cycles(modules).select("component").distinct().count())
    ranks = F.create_map(*(F.lit(v) for kv in P.LAYER_RANK.items() for v in kv))
    placed = sources.select(F.col("path").alias("node"), ranks[code.layer(F.col("path"))].alias("rank")).where("rank is not null")
    enough = s["examined"] and s["layered"] / s["examined"] >= 0.5
    out |= _told(s, "too_few_files_in_layers", layer_direction_violations=graph.layer_violations(edges, placed).count() if enough else None)
    high = change.high_reach(edges, s["examined"]).select(F.col("dst").alias("path")) if s["examined"] else sources.limit(0)
    pairs = test_pairs(files, x.files).select("path").distinct().withColumn("there", F.lit(1))
    h = _row(high.join(pairs, "path", "left"), bare=F.count_if(F.col("there").isNull()))
    out |= _told(h, "no_high_reach_file", high_reach_files_without_test_share=h["bare"] / (h["examined"] or 1))
    if x.commit_files is None:
        return out | _told({"examined": 0}, "no_history", high_reach_churn_hotspot_share=None)
    if not change.enough_history(x.commit_files):
        return out | _told({"examined": 0}, "too_few_commits", high_reach_churn_hotspot_share=None)
    hot = change.hotspot_share(high, change.hotspots(x.commit_files)).first()
    return out | _told({**h, "examined": hot["n"]}, "no_high_reach_file", high_reach_churn_hotspot_share=hot["share"])


def history(spark, x: Inputs, files: DataFrame) -> Found:
    out = _told({"examined": 0}, "no_history", code_commits_with_docs_share=None, commits_with_issue_reference_share=None)
    if x.commit_files is not None:
        kinds = x.commit_files.select("sha", (code.code_kind(F.col("path")) == "source").alias("code"), F.lower("path").rlike(r"\.(?:md|rst|adoc)$").alias("doc"))
        c = _row(kinds.groupBy("sha").agg(F.max(F.coalesce("code", F.lit(False))).alias("code"), F.max("doc").alias("doc")).where("code"), both=F.count_if("doc"))
        out |= _told(c, "no_code_commit", code_commits_with_docs_share=c["both"] / (c["examined"] or 1))
    if x.commits is not None:
        m = change.share_of_commits(x.commits, F.size(facts.issue_references(F.col("message"))) > 0).first()
        out |= _told({"examined": m["n"]}, "too_few_commits", commits_with_issue_reference_share=m["share"])
    return out


def changes(spark, x: Inputs, files: DataFrame) -> Found:
    names = ("bugfix_without_regression_test", "new_code_without_test_share", "refactor_tests_deleted", "refactor_uncovered_share", "public_symbols_removed", "destructive_migration_ops", "max_fan_in_changed", "changed_files_in_churn_hotspots_share")
    out = _told({"examined": 0}, "no_change", **dict.fromkeys(names))
    if x.diffs is None:
        return out
    parsed = diff.parse(x.diffs).checkpoint()
    changed = change.changed_files(parsed).checkpoint()
    n = _row(changed)
    pairs = test_pairs(files, x.files)
    now = pairs.join(changed.where("kind = 'test'").select(F.col("path").alias("test")), "test", "left_semi")
    rules = change.kind_rules(changed, now, pairs).first().asDict()
    out |= _told({**n, "examined": rules["sources"]}, "no_changed_source", **{k: rules[k] for k in names[:2]}, refactor_uncovered_share=rules["refactor_uncovered_share"])
    out |= _told(n, "no_change", refactor_tests_deleted=rules["refactor_tests_deleted"])
    sides = parsed.where(code.code_kind(F.col("path")) == "source").select("path", "sign", F.col("text").alias("line"), lexer.language(F.col("path")).alias("language"))
    side = lambda s: code.public_symbols(sides.where(F.col("sign") == s))
    known = _row(sides.where(code.knows(F.col("language"), "public")).select("path").distinct())
    out |= _told(known, "no_changed_source", public_symbols_removed=side("-").join(side("+").select("symbol").distinct(), "symbol", "left_anti").count())
    added = parsed.where("sign = '+'").select("path", "line_no", F.col("text").alias("line"))
    moved = _row(added.where(delivery.is_migration(F.col("path"))).select("path").distinct())
    out |= _told(moved, "no_changed_migration", destructive_migration_ops=code.destructive_ops(added).count())
    fan = _row(joins.fan_in(file_edges(files)).withColumnRenamed("dst", "path").join(changed.select("path"), "path", "left_semi"), most=F.max("fan_in"))
    out |= _told(n, "no_change", max_fan_in_changed=fan["most"] or 0)
    if x.commit_files is not None and not change.enough_history(x.commit_files):
        out |= _told({"examined": 0}, "too_few_commits", changed_files_in_churn_hotspots_share=None)
    elif x.commit_files is not None:
        hot = change.hotspot_share(changed, change.hotspots(x.commit_files)).first()
        out |= _told({**n, "examined": hot["n"]}, "no_change", changed_files_in_churn_hotspots_share=hot["share"])
    return out


def requirements(spark, x: Inputs, files: DataFrame) -> Found:
    docs = files.where(F.lower("path").rlike(r"\.(?:md|rst|adoc|feature)$"))
    written = files.where(F.col("kind").isNotNull()).select("path", "text")
    traced = contained.traced_items(contained.requirement_items(docs), written)
    i = _row(traced, hit=F.count("found"))
    tokens = lambda kind: _lines(files.where(F.col("kind") == kind), "text").select(F.explode(F.regexp_extract_all("line", F.lit(r"[A-Za-z0-9_]+(?:-[A-Za-z0-9_]+)*"), F.lit(0))).alias("key")).distinct()
    source, test = tokens("source").withColumn("s", F.lit(1)), tokens("test").withColumn("t", F.lit(1))
    out = _told(i, "no_requirement", requirement_items_traced_share=i["hit"] / (i["examined"] or 1))
    rows = domain.criteria(facts.lines_of(docs)).select("path", "line_no", F.explode_outer(F.regexp_extract_all("criterion", F.lit(r"[A-Z]{2,5}-[0-9]+|`([^`]+)`"), F.lit(0))).alias("key")).withColumn("key", F.regexp_replace("key", "`", ""))
    traced = rows.join(source, "key", "left").join(test, "key", "left").groupBy("path", "line_no").agg(F.max("s").alias("s"), F.max("t").alias("t"))
    c = _row(traced, s=F.count("s"), t=F.count("t"))
    n = c["examined"] or 1
    return out | _told(c, "no_criterion", acceptance_criteria_traced_to_code_share=c["s"] / n, acceptance_criteria_traced_to_test_share=c["t"] / n)


def strictness(spark, x: Inputs, files: DataFrame) -> Found:
    """Whether every language with a type checker's configuration is checked strictly; one whose state can't
    be known is not judged."""
    states = {r.language: r.state for r in settings.strict_languages(settings.strict_states(files)).collect()}
    judged = [v for v in states.values() if v != settings.UNSEEN]
    reason = "no_configuration_seen" if states else "no_configuration"
    return _told({"examined": len(judged)}, reason, strict_type_config_missing=int(any(v != settings.STRICT for v in judged)))


def healthcare(spark, x: Inputs, files: DataFrame) -> Found:
    data = files.where(F.col("path").rlike(r"(?:^|/)(?:fixtures|testdata|seeds|samples)/|(?:^|/)tests?/.*\.(?:json|csv|sql|ya?ml)$"))
    d = _row(data, hits=F.sum(F.size(facts.phi_spans(F.col("text")))))
    out = _told(d, "no_test_data", phi_values_in_test_data_observed=d["hits"])
    logs = _lines(files.where("kind = 'source'"), "text").where(F.col("line").rlike(r"(?i)\b(?:log(?:ger|ging)?|console)\s*\.\s*\w+\s*\(|\b(?:print|println|printf)\s*\("))
    found = _row(logs, hits=F.sum(F.size(facts.phi_spans(F.col("line")))))
    return out | _told(found, "no_log_statement", phi_values_in_log_statements_observed=found["hits"])


def finance(spark, x: Inputs, files: DataFrame) -> Found:
    sources = files.where("kind = 'source' or lower(path) like '%.sql'")
    lines = _lines(sources, "text")
    fields = lines.withColumn("name", F.regexp_extract("line", r"\b([A-Za-z_]\w*)\s*\??:\s*\S", 1)).where("name <> ''").where(domain.is_money_name(F.col("name")))
    out = _told(_row(fields), "no_money_field", float_money_observed=domain.float_money(lines).count())
    tables = ledger_tables(sources)
    t = _row(tables, bare=F.count_if(~F.col("audited")))
    out |= _told(t, "no_ledger", ledger_tables_without_audit_columns_observed=t["bare"])
    keys = tables.select(F.lower("name").alias("name")).distinct()
    aimed = lines.withColumn("name", F.lower(F.regexp_extract("line", r"(?i)\b(?:update|delete\s+from)\s+[\"`\[]?(\w+)", 1))).where("name <> ''")
    return out | _told(t, "no_ledger", ledger_rows_mutated_observed=aimed.join(keys, "name", "left_semi").count())


def ledger_tables(files: DataFrame) -> DataFrame:
    """(path, name, audited): tables of ledgers, and whether they have a column of who and when."""
    found = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"""(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?["`\[]?\w+["`\]]?\s*\([^;]*"""), F.lit(0))).alias("body"))
    named = found.withColumn("name", F.regexp_extract("body", r"""(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?["`\[]?(\w+)""", 1)).where(domain.is_ledger_name(F.col("name")))
    return named.select("path", "name", F.col("body").rlike(r"(?i)\b(?:created_at|created_by|updated_at|updated_by)\b").alias("audited"))


def accessibility(spark, x: Inputs, files: DataFrame) -> Found:
    """Counts of hits; what can't be told is neither a hit nor examined."""
    pages = markup.markup_files(files)
    told = markup.checks(pages).groupBy("check").agg(F.count_if(F.col("state") == "hit").alias("hits"), F.count_if(F.col("state") != "unknown").alias("examined"), F.min("path").alias("low"), F.max("path").alias("high"))
    by = {r["check"]: r.asDict() for r in told.collect()}
    out: Found = {}
    for check, name in (("image", "images_without_alt_observed"), ("control", "form_controls_without_label_observed"), ("hidden", "aria_hidden_focusable_observed")):
        row = by.get(check, {"examined": 0, "hits": None})
        out |= _told(row, "no_element", **{name: row["hits"]})
    e = _row(markup.viewports(files), bad=F.count_if(F.col("state").isin("missing", "zoom_disabled")))
    out |= _told(e, "no_entry_document", viewport_missing_or_zoom_disabled_observed=e["bad"])
    return out | _told(_row(pages), "no_page", browser_support_declaration_missing=int(markup.browser_support(files).isEmpty()))


def evidence(spark, x: Inputs, files: DataFrame) -> Found:
    names = ("excerpts_observed", "evidence_lines_observed", "mean_excerpt_lines")
    filled = {r.role for r in joins.resolve_roles(x.files, {k: list(v) for k, v in ROLES.items()}).select("role").distinct().collect()}
    sought = sorted({r for rs in SOUGHT.values() for r in rs})
    out = _told({"examined": len(sought)}, "nothing_sought", declared_source_coverage=sum(r in filled for r in sought) / len(sought))
    if x.excerpts is None:
        return out | _told({"examined": 0}, "no_excerpt", **dict.fromkeys(names))
    lines = F.col("end_line") - F.col("start_line") + 1
    e = _row(x.excerpts, total=F.sum(lines), mean=F.avg(lines))
    return out | _told(e, "no_excerpt", excerpts_observed=e["examined"], evidence_lines_observed=e["total"], mean_excerpt_lines=e["mean"])


FAMILIES: tuple[Callable, ...] = (presence, documents, shape, tests, security, reliability, supply_chain, interfaces, schemas, operations, infrastructure, structure, history, changes, requirements, strictness, healthcare, finance, accessibility, evidence)


def dimensions_of(metric: str) -> list[str]:
    rated = sorted({r[0] for r in rating.RULES if r[1] == metric})
    return rated or [UNRATED.get(metric, "code-quality")]


def measure(spark: SparkSession, inputs: Inputs, families: tuple[Callable, ...] = FAMILIES) -> DataFrame:
    """(dimension, metric, kind, value, abstain_reason, examined, cited): all metrics, one row for each
    dimension of a metric. A family that fails gives no number, and a row with its error."""
    files = prepared(spark, inputs.files)
    rows = []
    for family in families:
        try:
            found = family(spark, inputs, files)
        except Exception as error:  # noqa: BLE001  isolation is the point: the row says what failed
            rows.append((family.__name__, "failed", LOCAL, None, f"error: {error!s:.500}", 0, []))
            continue
        for metric, (value, reason, examined, cited) in found.items():
            kind = WHOLE_SET if metric in WHOLE else LOCAL
            cut = inputs.truncated and kind == WHOLE_SET
            for dimension in dimensions_of(metric):
                rows.append((dimension, metric, kind, None if cut else value, "truncated_evidence" if cut else reason, examined, [] if cut else cited))
    return spark.createDataFrame(rows, SCHEMA)

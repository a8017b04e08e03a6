"""The operators on the driver's tables, each with the SQL that says the same.

orders stand for commits and lineitem for the files that a commit touches; documents, pages and
conversations are file texts; customers and suppliers by nation give a small graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import text as T
from assaykit.operators import code, contained, domain, facts, graph, joins, markup, metrics, ranking, rating, sets
from assaykit.sources.corpus import documents_as_files
from assaykit.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- history: commits, churn, co-change ----------------------------------------------------------

COMMITS = 400
LAST = f"last_commits as (select o_orderkey from orders order by o_orderdate desc, o_orderkey limit {COMMITS})"
CHURN = f"with {LAST}, churn as (select l_partkey as path, count(distinct l_orderkey) as commits from lineitem join last_commits on l_orderkey = o_orderkey group by l_partkey)"


def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, commits) over the last commits: the 400 keys are a proven bound, so they are broadcast."""
    last = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(COMMITS).select("o_orderkey")
    touched = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("path")).join(F.broadcast(last), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return touched.distinct().groupBy("path").agg(F.count("*").alias("commits"))


@query(f"{CHURN} select path, commits from churn")
def churn_table(spark, sf_dir):
    return churn(spark, sf_dir)


@query(f"{CHURN} select path, commits from (select *, row_number() over (order by commits desc, path) as rn, count(*) over () as n from churn) where rn <= ceil(n / 10.0)")
def churn_top_decile(spark, sf_dir):
    return ranking.first_share(churn(spark, sf_dir), [F.desc("commits"), F.col("path")]).select("path", "commits")


@query("""
with seeds as (select p_partkey as path from part where p_size = 1),
touched as (select distinct l_orderkey from lineitem where l_partkey in (select path from seeds))
select l_partkey as path, count(distinct l_orderkey) as n from lineitem
where l_orderkey in (select l_orderkey from touched) and l_partkey not in (select path from seeds)
group by l_partkey order by n desc, path limit 15
""")
def co_change_rank(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path"))
    seeds = table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("path"))
    return joins.co_change(files, seeds).orderBy(F.desc("n"), "path").limit(15)


@query("""
with c as (select l_orderkey, count_if(l_partkey % 7 <> 0) > 0 as code, count_if(l_partkey % 7 = 0) > 0 as docs from lineitem group by l_orderkey)
select count_if(code and docs) as both_n, count_if(code) as code_n, count_if(code and docs) / nullif(count_if(code), 0)::double as share from c
""")
def docs_co_change_share(spark, sf_dir):
    is_doc = F.col("l_partkey") % 7 == 0
    commits = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(~is_doc).alias("code"), F.max(is_doc).alias("docs"))
    both, code = F.count_if(F.col("code") & F.col("docs")), F.count_if("code")
    return commits.agg(both.alias("both_n"), code.alias("code_n"), metrics.ratio(both, code).alias("share"))


@query(f"{CHURN} select p_partkey as path, coalesce(commits, 0) as commits, cast(ceil(row_number() over (order by case when p_type like 'PROMO%' then 0 when p_type like 'STANDARD%' then 1 else 2 end, coalesce(commits, 0) desc, p_partkey) / 200.0) as int) as batch from part left join churn on path = p_partkey")
def priority_batches(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.when(F.col("p_type").startswith("PROMO"), 0).when(F.col("p_type").startswith("STANDARD"), 1).otherwise(2).alias("rank"))
    rows = parts.join(churn(spark, sf_dir), "path", "left").withColumn("commits", F.coalesce("commits", F.lit(0)))
    return ranking.batches(rows, [F.col("rank"), F.desc("commits"), F.col("path")]).select("path", "commits", "batch")


# ---- graph ----------------------------------------------------------------------------------------

EDGES = "edges as (select c_nationkey as src, s_nationkey as dst from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey group by all having count(*) >= (select count(*) / 512.0 from lineitem))"


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of nations with enough traffic. Lines are summed by order and supplier nation's key first,
    so that the joins see pre-aggregated rows."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    pairs = line.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    total = table(spark, sf_dir, "lineitem").agg((F.count("*") / 512.0).alias("least"))
    sums = pairs.where("src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("n"))
    return sums.join(F.broadcast(total), F.col("n") >= F.col("least")).select("src", "dst")  # one row on the right


@query(f"""
with recursive {EDGES}, r(a, b) as (select src, dst from edges union select r.a, e.dst from r join edges e on r.b = e.src)
select x.a as node, least(x.a, min(x.b)) as component from r x join r y on x.a = y.b and x.b = y.a where x.a <> x.b group by x.a
""")
def import_cycles(spark, sf_dir):
    return graph.cycles(nation_edges(spark, sf_dir))


@query(f"""
with recursive {EDGES}, r(node, depth) as (select 0, 0 union select dst, depth + 1 from r join edges on node = src where depth < 20)
select node, min(depth) as depth from r group by node
""")
def shortest_path(spark, sf_dir):
    start = spark.range(1).select(F.lit(0).cast("int").alias("node"))
    return graph.distances(nation_edges(spark, sf_dir), start)


@query(f"with {EDGES} select src, dst, a.n_regionkey as src_rank, b.n_regionkey as dst_rank from edges join nation a on src = a.n_nationkey join nation b on dst = b.n_nationkey where a.n_regionkey < b.n_regionkey")
def layer_direction(spark, sf_dir):
    ranks = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("rank"))
    return graph.layer_violations(nation_edges(spark, sf_dir), ranks)


LINKS = "links as (select page_id as src, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1)) as dst from pages)"


@query(f"with {LINKS} select dst, count(distinct src) as fan_in from links group by dst")
def fan_in(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("src"), F.explode(facts.links(F.col("html"))).alias("dst"))
    return joins.fan_in(links)


@query(f"""
with {LINKS}, fan as (select dst, count(distinct src) as fan_in from links group by dst),
r as (select *, row_number() over (order by fan_in desc, dst) as rn, count(*) over () as n from fan where fan_in >= 3)
select dst, fan_in from r where fan_in >= (select fan_in from r where rn = least(greatest(1, ceil((select count(*) from pages) * 10 / 100.0)), n))
""")
def high_reach_ties(spark, sf_dir):
    size = -(-table(spark, sf_dir, "pages").count() * 10 // 100)
    return ranking.top_with_ties(fan_in(spark, sf_dir).where("fan_in >= 3"), "fan_in", size)


@query("with w as (select distinct lang as owner, lower(unnest(string_split(text, ' '))) as name from documents) select name, min(owner) as owner from w group by name having count(*) = 1")
def unique_owners(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(F.col("lang").alias("owner"), F.explode(F.split("text", " ")).alias("name")).select("owner", F.lower("name").alias("name"))
    return joins.unique_owners(names.distinct())


# ---- files, roles, correspondence, budget ---------------------------------------------------------

PATH = "concat_ws('/', source, lang, concat('doc_', doc_id, '.md'))"


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_files(table(spark, sf_dir, "documents"))


@query(f"""
with f as (select {PATH} as path from documents),
h as (select 'readme' as role, path from f where regexp_matches(path, '^(?:[^/]+/)*doc_[^/]*0\\.md$')
 union all select 'schema' as role, path from f where regexp_matches(path, '^src1[^/]/.*$')
 union all select 'tests' as role, path from f where regexp_matches(path, '^(?:[^/]+/)*fr/[^/]*$'))
select role, path from h qualify row_number() over (partition by role order by length(path) - length(replace(path, '/', '')), path) <= 50
""")
def role_resolution(spark, sf_dir):
    roles = {"readme": ["**/doc_*0.md"], "schema": ["src1?/**"], "tests": ["**/fr/*"]}
    return joins.resolve_roles(doc_files(spark, sf_dir), roles)


@query(f"""
with f as (select {PATH} as path, source as project, lang, doc_id from documents),
t as (select {PATH.replace("doc_id", "documents.doc_id").replace("'doc_'", "'test_doc_'")} as path, source as project from documents join labels using (doc_id))
select f.path from f where not exists (select 1 from t where t.project = f.project and regexp_extract(t.path, '([^/]*)$', 1) = concat('test_doc_', f.doc_id, '.md'))
""")
def correspondence_uncovered(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    sources = docs.select(F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.col("source").alias("project"))
    tests = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select(F.concat_ws("/", "source", "lang", F.concat(F.lit("test_doc_"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.col("source").alias("project"))
    expected = joins.expected_tests(sources, {".md": ["test_{stem}.{ext}"]}).join(sources, "path")
    return joins.uncovered(sources, joins.correspondence(expected, tests)).select("path")


BUDGET = 120_000


@query(f"""
with x as (select {PATH} as ref, case lang when 'en' then 1 when 'fr' then 2 else 3 end as tier, doc_id as arrival, strlen(text) as bytes from documents),
r as (select *, sum(bytes) over (order by tier, arrival rows unbounded preceding) as running from x)
select ref, tier, bytes, cast(running as bigint) as running from r where running <= {BUDGET}
""")
def byte_budget_prefix(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("ref"), F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).otherwise(3).alias("tier"), F.col("doc_id").alias("arrival"), F.octet_length("text").cast("bigint").alias("bytes"))
    return ranking.byte_budget(rows, BUDGET).select("ref", "tier", "bytes", F.col("__running").alias("running"))


@query("select text as ref, min(doc_id) as doc_id from documents group by text")
def first_arrivals(spark, sf_dir):
    return ranking.first_arrivals(table(spark, sf_dir, "documents").select(F.col("text").alias("ref"), "doc_id"), "ref", [F.col("doc_id")])


@query("select source, doc_id, omitted from (select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as rn, greatest(count(*) over (partition by source) - 20, 0) as omitted from documents) where rn <= 20")
def example_lists(spark, sf_dir):
    return ranking.examples(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")]).select("source", "doc_id", F.col("__omitted").alias("omitted"))


# ---- facts in texts -------------------------------------------------------------------------------


@query("""
with t as (select distinct doc_id, unnest(regexp_extract_all(text, '\\b[0-9a-fA-F]{32,512}\\b')) as token from documents),
c as (select doc_id, token, unnest(list_distinct(string_split(token, ''))) as ch from t),
e as (select doc_id, token, sum(-(len(token) - len(replace(token, ch, ''))) / len(token) * log2((len(token) - len(replace(token, ch, ''))) / len(token))) as bits from c group by doc_id, token)
select doc_id, token, round(bits, 6) as bits from e where bits >= 3.2
""")
def entropy_hex(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(facts.entropy_tokens(F.col("text")))).alias("token"))
    return rows.select("doc_id", "token", F.round(T.shannon_bits(F.col("token")), 6).alias("bits"))


@query("select doc_id, concat(left(text, 4), '…****:', left(sha256(text), 12)) as fingerprint from documents")
def fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


@query("select source, count_if(n > 0)::double / count(*) as share, cast(sum(n) as bigint) as hits from (select source, len(regexp_extract_all(text, 'AKIA[A-Z0-9]{16}\\b')) as n from documents) group by source")
def redacted_file_share(spark, sf_dir):
    n = F.regexp_count("text", F.lit(r"AKIA[A-Z0-9]{16}\b"))
    return table(spark, sf_dir, "documents").select("source", n.alias("n")).groupBy("source").agg(metrics.share_of(F.col("n") > 0).alias("share"), F.sum("n").cast("bigint").alias("hits"))


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents) select doc_id, count(*) as lines, count_if(trim(line, ' ') = '') as blank, cast(sum(length(line)) as double) / count(*) as mean_length from l group by doc_id")
def line_counts(spark, sf_dir):
    lines = facts.lines_of(table(spark, sf_dir, "documents"), "doc_id")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.trim("line") == "").alias("blank"), metrics.ratio(F.sum(F.length("line")), F.count("*")).alias("mean_length"))


@query("select page_id, case when not regexp_matches(html, '(?is)<meta\\b[^>]*name\\s*=\\s*[\"'']?viewport') then 'missing' when regexp_matches(html, '(?i)user-scalable\\s*=\\s*(?:no|0)|maximum-scale\\s*=\\s*1(?:\\.0)?\\b') then 'zoom_disabled' else 'fine' end as state from pages")
def viewport_missing(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", facts.viewport_state(F.col("html")).alias("state"))


@query("select page_id, case when len(t) > 0 then len(list_filter(t, lambda x: not regexp_matches(x, '(?i)\\balt\\s*='))) end as without_alt, case when len(t) = 0 then 'no_element' end as abstain_reason from (select page_id, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<img\\b[^>]*>') as t from pages)")
def images_without_alt(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    images = markup.checks(pages, "page_id", "html").where("check = 'image'").groupBy("page_id").agg(F.count_if(F.col("state") == "hit").alias("without_alt"))
    return pages.select("page_id").join(images, "page_id", "left").select("page_id", "without_alt", F.when(F.col("without_alt").isNull(), "no_element").alias("abstain_reason"))


@query(r"""
with p as (select page_id, regexp_replace(regexp_replace(html, '<!--[\s\S]*?-->', '', 'g'), '([\p{L}\p{N}_$)\]])<([A-Za-z])', '\1 \2', 'g') as t from pages),
x as (select page_id, unnest(regexp_extract_all(t, '</?[A-Za-z][A-Za-z0-9_.:-]*(?:\s[^<>]*)?>')) as tag from p)
select page_id, regexp_extract(tag, '^</?([A-Za-z0-9_.:-]+)', 1) as name, starts_with(tag, '</') as closing, count(*) as n, count_if(regexp_matches(tag, '\shref='))::bigint as with_href,
  coalesce(max(regexp_extract(tag, 'href="([^"]*)"', 1)) filter (tag like '% href=%'), '') as last_href from x group by all
""")
def page_tags(spark, sf_dir):
    """Tags of all pages; an opening one right after a letter, digit or closing bracket is a comparison."""
    rows = markup.with_tags(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", F.explode("tags").alias("t"))
    href = F.col("t.attributes")["href"]
    return rows.groupBy("page_id", F.col("t.name").alias("name"), F.col("t.closing").alias("closing")).agg(F.count("*").alias("n"), F.count(href).alias("with_href"), F.coalesce(F.max(href.value), F.lit("")).alias("last_href"))


@query("""
with n as (select doc_id, text, unnest(string_split(text, chr(10))) as line from documents where doc_id % 20 = 0),
f as (select distinct doc_id, lower(regexp_replace(trim(line, ' '), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) as item from n where length(trim(line, ' ')) >= 30),
t as (select doc_id, lower(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) as text from documents where text is not null)
select f.doc_id, sha256(item) as item, min(t.doc_id) as first_doc from f left join t on contains(t.text, item) group by f.doc_id, item
""")
def lines_found_again(spark, sf_dir):
    """Lines of 30 characters or more of every twentieth document, looked for in all documents."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.where("doc_id % 20 = 0").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    asked = lines.where(F.length(F.trim("line")) >= 30).select("doc_id", contained.flat(F.trim("line")).alias("item")).distinct()
    found = contained.first_holders(docs.select(F.col("doc_id").alias("key"), contained.flat(F.col("text")).alias("text")), asked.select(F.col("item").alias("name"), F.lit(False).alias("whole")))
    return asked.join(found.select(F.col("name").alias("item"), F.col("key").alias("first_doc")), "item", "left").select("doc_id", F.sha2("item", 256).alias("item"), "first_doc")


@query("""
with items as (select distinct item_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]{9,}'))) as key from benchmark),
words as (select distinct doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]{9,}'))) as key from documents)
select item_id, count(distinct doc_id) as docs from items join words using (key) group by item_id
""")
def requirement_traces(spark, sf_dir):
    pattern = "[A-Za-z]{9,}"
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.lower)).alias("key")).distinct()
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.lower))).alias("key"))
    # the keys cut the words before they are dealt: semi-joined on the small side's keys
    return words.join(items, "key").groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"))


@query("select page_id, len(list_distinct(list_filter(h, lambda x: regexp_matches(x, '^/[A-Za-z]+$')))) as routes, len(list_filter(h, lambda x: not regexp_matches(x, '^/'))) as outside from (select page_id, regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1) as h from pages)")
def page_routes(spark, sf_dir):
    h = facts.links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.array_distinct(F.filter(h, lambda x: x.rlike("^/[A-Za-z]+$")))).cast("bigint").alias("routes"), F.size(F.filter(h, lambda x: ~x.rlike("^/"))).cast("bigint").alias("outside"))


@query("select p_partkey, list_transform(regexp_extract_all(p_name, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)) as words from part")
def name_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.name_words(F.col("p_name")).alias("words"))


# ---- ordered state --------------------------------------------------------------------------------


@query("""
select event_id, last_value(case when event_type in ('purchase', 'signup') then event_type end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as state,
  last_value(case when event_type in ('purchase', 'signup') then event_type end ignore nulls) over (partition by user_id order by ts, event_id rows between 14 preceding and current row) as near
from events
""")
def section_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.struct("ts", "event_id").alias("pos"))
    mark = F.when(F.col("event_type").isin("purchase", "signup"), F.col("event_type"))
    return ranking.last_above(ranking.last_above(e, "user_id", "pos", mark, "state"), "user_id", "pos", mark, "near", 14).select("event_id", "state", "near")


@query("select event_id, cast(sum(case when value > 50 then 1 else 0 end - case when value < 10 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as depth from events")
def block_depth(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.struct("ts", "event_id").alias("pos"))
    return ranking.depth(e, "user_id", "pos", (F.col("value") > 50).cast("int"), (F.col("value") < 10).cast("int")).select("event_id", "depth")


@query("""
with s as (select user_id, cast(floor(epoch(ts) / 3600) as bigint) - 1 as lo, cast(floor(epoch(ts) / 3600) as bigint) + 1 as hi from events),
m as (select *, case when lo <= max(hi) over (partition by user_id order by lo, hi rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end as fresh from s),
i as (select *, sum(fresh) over (partition by user_id order by lo, hi rows unbounded preceding) as island from m)
select user_id, min(lo) as lo, max(hi) as hi from i group by user_id, island
""")
def evidence_islands(spark, sf_dir):
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3600e6)).cast("bigint")
    spans = table(spark, sf_dir, "events").select("user_id", (hour - 1).alias("lo"), (hour + 1).alias("hi"))
    return ranking.islands(spans, "user_id", "lo", "hi")


# ---- metrics, ratings, plan -----------------------------------------------------------------------

DOC_RULES = (("en", "short_share", 30, "at_most", 0.2), ("en", "toxic_share", 50, "at_most", 0.05), ("en", "mean_kchars", 20, "at_least", 1.0), ("fr", "short_share", 40, "at_most", 0.2), ("fr", "toxic_share", 60, "at_most", 0.5), ("de", "short_share", 30, "at_most", 0.01), ("de", "missing_metric", 70, "at_most", 0.0))
DOC_FLOORS = (("en", 0.25), ("fr", 0.99), ("de", 0.1), ("es", 0.1))
METRIC_SQL = """
m0 as (select lang as dimension, count_if(n_chars < 500)::double / count(*) as short_share, sum(toxic)::double / nullif(count(toxic), 0) as toxic_share, sum(n_chars)::double / count(*) / 1000 as mean_kchars from documents left join labels using (doc_id) group by lang),
m as (select dimension, 'short_share' as metric, 'whole_set' as kind, short_share as value from m0 union all select dimension, 'toxic_share', 'whole_set', toxic_share from m0 union all select dimension, 'mean_kchars', 'evidence_local', mean_kchars from m0)
"""
RULE_SQL = f"rules(dimension, metric, weight, comparison, threshold) as (values {', '.join(map(str, DOC_RULES))}), floors(dimension, floor) as (values {', '.join(map(str, DOC_FLOORS))})"
INPUT_SQL = f"""
with {METRIC_SQL}, {RULE_SQL},
i as (select rules.*, value, case when value is not null then case when comparison = 'at_least' then value >= threshold else value <= threshold end end as passed from rules left join m using (dimension, metric)),
s as (select dimension, sum(case when passed then weight else 0 end) as earned, sum(case when value is not null then weight else 0 end) as available, sum(weight) as declared from i group by dimension),
c as (select lang as dimension, count(labels.doc_id)::double / count(*) as coverage from documents left join labels using (doc_id) group by lang),
r0 as (select dimension, coalesce(earned, 0) as earned, coalesce(available, 0) as available, coalesce(declared, 0) as declared,
  case when coalesce(declared, 0) = 0 then 'no_static_rule' when coverage is null then 'coverage_not_applicable' when coverage < floor then 'below_coverage_floor' when coalesce(available, 0) = 0 then 'all_metrics_abstained' when available / declared < 0.5 then 'insufficient_measured_weight' end as reason_code
  from c join floors using (dimension) left join s using (dimension)),
r as (select dimension, case when reason_code is null then cast(round_even(100.0::double * earned / available, 0) as int) end as value, reason_code, cast(earned as bigint) as earned, cast(available as bigint) as available, cast(declared as bigint) as declared from r0)
"""


def doc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    sums = docs.groupBy(F.col("lang").alias("dimension")).agg(
        metrics.share_of(F.col("n_chars") < 500).alias("short_share"),
        metrics.ratio(F.sum("toxic"), F.count("toxic")).alias("toxic_share"),
        (metrics.ratio(F.sum("n_chars"), F.count("*")) / 1000).alias("mean_kchars"),
    )
    return metrics.long_table(sums, {"short_share": metrics.WHOLE_SET, "toxic_share": metrics.WHOLE_SET, "mean_kchars": metrics.LOCAL})


def doc_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating.inputs(doc_metrics(spark, sf_dir), rating.rule_table(spark, [(*r, "") for r in DOC_RULES]))


def doc_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("there")), "doc_id", "left")
    floors = spark.createDataFrame(list(DOC_FLOORS), "dimension string, floor double")
    packs = docs.groupBy(F.col("lang").alias("dimension")).agg(metrics.ratio(F.count("there"), F.count("*")).alias("coverage"))
    packs = packs.join(F.broadcast(floors), "dimension").withColumns({"failed": F.lit(False), "has_docs": F.lit(False)})
    return rating.rate(doc_inputs(spark, sf_dir), packs)


@query(f"with {METRIC_SQL} select dimension, metric, kind, value, case when value is null then 'no_denominator' end as abstain_reason from m")
def metric_table(spark, sf_dir):
    return doc_metrics(spark, sf_dir)


@query(f"{INPUT_SQL} select * from r")
def ratings(spark, sf_dir):
    return doc_ratings(spark, sf_dir)


@query(f"{INPUT_SQL} select cast(round_even(avg(value), 0) as int) as value, case when count(value) = 0 then 'no_dimension_rated' end as reason_code, count(value) as n from r where dimension <> 'change-risk'")
def overall_rating(spark, sf_dir):
    return rating.overall(doc_ratings(spark, sf_dir))


@query(f"{INPUT_SQL}, near as (select distinct dimension from i where threshold <> 0 and abs(value::decimal(28,10) - threshold::decimal(28,10)) <= 0.1 * abs(threshold::decimal(28,10))) select dimension, case when reason_code = 'no_static_rule' then reason_code else 'borderline' end as gate from r where reason_code = 'no_static_rule' or dimension in (select dimension from near)")
def gate_requests(spark, sf_dir):
    return rating.gates(doc_inputs(spark, sf_dir), doc_ratings(spark, sf_dir))


@query(f"""{INPUT_SQL},
x as (select i.*, r.value as rating, r.earned as e, r.available as a from i join r using (dimension) where r.value is not null and not coalesce(passed, false)),
y as (select *, threshold <> 0 and abs(value::decimal(28,10) - threshold::decimal(28,10)) <= 0.1 * abs(threshold::decimal(28,10)) as near from x)
select case when value is null then 'P2' when near then 'P0' else 'P1' end as priority, dimension, metric,
  cast(case when value is null then round_even(100.0::double * e / (a + weight), 0) else round_even(100.0::double * (e + weight) / a, 0) end as int) - rating as gain_low,
  cast(case when value is null then round_even(100.0::double * (e + weight) / (a + weight), 0) else round_even(100.0::double * (e + weight) / a, 0) end as int) - rating as gain_high
from y
""")
def improvement_plan(spark, sf_dir):
    return rating.plan(doc_inputs(spark, sf_dir), doc_ratings(spark, sf_dir))


@query(f"""{INPUT_SQL}, ev(dimension, score, confidence) as (values ('en', 65, 0.9), ('es', 40, 0.5)),
b as (select r.dimension, r.value, score, (0.5 * confidence)::decimal(12,6) as w from r left join ev using (dimension))
select dimension, cast(case when score is null then value when value is null then score else greatest(0, least(100, round((value::decimal(10,0) * (1 - w) + score::decimal(10,0) * w)::decimal(38,6), 0))) end as int) as final,
  case when score is null then 'rules' when value is null then 'evaluation_only' else 'blended' end as label from b
""")
def blended_ratings(spark, sf_dir):
    ev = spark.createDataFrame([("en", 65, 0.9), ("es", 40, 0.5)], "dimension string, score int, confidence double")
    return rating.blended(doc_ratings(spark, sf_dir), ev).select("dimension", "final", "label")


FINDINGS = "f as (select case when conv_id % 3 = 0 then 'en' when conv_id % 3 = 1 then 'fr' else 'es' end as dimension, case when length(text) % 4 = 0 then 'low' when length(text) % 4 = 1 then 'medium' when length(text) % 4 = 2 then 'high' end as severity, case when turn % 2 = 0 then 'low' else 'high' end as confidence from conversations)"
ASSESS = "s as (select dimension, greatest(0, 100 - cast(round_even(sum((case coalesce(severity, 'medium') when 'low' then 5 when 'medium' then 15 else 30 end) * (case confidence when 'low' then 25 when 'medium' then 60 else 100 end)) / 100.0::double, 0) as int)) as value, count(*) as n from f group by dimension)"


def turn_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text") % 4
    return table(spark, sf_dir, "conversations").select(
        F.when(F.col("conv_id") % 3 == 0, "en").when(F.col("conv_id") % 3 == 1, "fr").otherwise("es").alias("dimension"),
        F.when(n == 0, "low").when(n == 1, "medium").when(n == 2, "high").alias("severity"),
        F.when(F.col("turn") % 2 == 0, "low").otherwise("high").alias("confidence"),
    )


@query(f"with {FINDINGS}, {ASSESS} select * from s")
def assessments(spark, sf_dir):
    return rating.assess(turn_findings(spark, sf_dir))


@query(INPUT_SQL + f", {FINDINGS}, {ASSESS.replace('s as (', 'v as (', 1)}, d as (select coalesce(r.dimension, v.dimension) as dimension, r.value as rating, v.value as assessment from r full join v using (dimension)) select *, assessment - rating as divergence, case when assessment < rating then 'agent_harsher' when assessment > rating then 'agent_kinder' when assessment = rating then 'equal' end as direction from d")
def divergence(spark, sf_dir):
    return rating.compare(doc_ratings(spark, sf_dir), rating.assess(turn_findings(spark, sf_dir)))


@query("with p as (select source as dimension, count(*) as sought, count(labels.doc_id) as found, source = 'src0' as failed from documents left join labels using (doc_id) group by source) select sum(case when not failed then found end)::double / nullif(sum(case when not failed then sought end), 0) as coverage, string_agg(case when failed then dimension end, ',') as failed from p")
def pooled_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("there")), "doc_id", "left")
    packs = docs.groupBy(F.col("source").alias("dimension")).agg(F.count("*").alias("sought"), F.count("there").alias("found")).withColumn("failed", F.col("dimension") == "src0")
    return rating.pooled_coverage(packs)


ANSWERS = "a as (select lang, coalesce(n_chars % 1000 / 1000.0::double, 0) as confidence, coalesce(quality, 0) = 1 as correct from documents left join labels using (doc_id))"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.select("lang", (F.col("n_chars") % 1000 / F.lit(1000.0)).alias("confidence"), (F.col("quality") == 1).alias("correct"))


@query(f"with {ANSWERS}, b as (select lang, least(floor(confidence * 10), 9) as bin, count(*) as n, count_if(correct) as hits, sum(confidence) as mass from a group by all) select lang, round(sum(abs(hits - mass)) / sum(n), 9) as ece, cast(sum(n) as bigint) as n from b group by lang")
def calibration_error(spark, sf_dir):
    return metrics.calibration(answers(spark, sf_dir), "lang").select("lang", F.round("ece", 9).alias("ece"), "n")


@query("select lang, quantile_disc(n_chars, 0.5) as p50, quantile_disc(n_chars, 0.95) as p95 from documents group by lang")
def nearest_ranks(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(metrics.nearest_rank("n_chars", 0.5).alias("p50"), metrics.nearest_rank("n_chars", 0.95).alias("p95"))


@query("select coalesce(source, 'overall') as grp, count(*) as n, count(quality) as answered, count_if(quality = 1)::double / nullif(count(quality), 0) as accuracy from documents left join labels using (doc_id) group by grouping sets ((), (source))")
def rollup_overall(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.rollup("source").agg(F.count("*").alias("n"), F.count("quality").alias("answered"), metrics.ratio(F.count_if(F.col("quality") == 1), F.count("quality")).alias("accuracy")).select(F.coalesce("source", F.lit("overall")).alias("grp"), "n", "answered", "accuracy")


# ---- sets -----------------------------------------------------------------------------------------


@query("select p_partkey as source, case when p_size <= 25 then 'not found' else 'not examined' end as reason from part where p_partkey not in (select l_partkey from lineitem where l_quantity >= 49)")
def sources_missing(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), "p_size")
    found = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("source"))
    return sets.missing(part.select("source"), found, part.where("p_size <= 25"))


@query("select distinct l_partkey, l_suppkey from lineitem where l_returnflag = 'R' except select l_partkey, l_suppkey from lineitem where l_returnflag <> 'R'")
def removed_symbols(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    return sets.removed(line.where("l_returnflag = 'R'"), line.where("l_returnflag <> 'R'"), ["l_partkey", "l_suppkey"])


@query("select c_nationkey as k, coalesce(s.v, c.v) as v, case when s.v is null then 'base' else 'local' end as layer from (select c_nationkey, max(c_mktsegment) as v from customer group by 1) c left join (select s_nationkey, max(s_name) as v from supplier where s_nationkey % 2 = 0 group by 1) s on c_nationkey = s_nationkey union all select s_nationkey, max(s_name), 'local' from supplier where s_nationkey % 2 = 0 and s_nationkey not in (select c_nationkey from customer) group by 1")
def registry_overlay(spark, sf_dir):
    base = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_mktsegment").alias("v")).withColumn("layer", F.lit("base"))
    local = table(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_name").alias("v")).withColumn("layer", F.lit("local"))
    return sets.overlay(base, local, ["k"])


# ---- code, changes, windows -----------------------------------------------------------------------

CODE_PATH = "concat(source, '/', case lang when 'en' then 'tests' when 'fr' then 'src' else 'etc' end, '/', case doc_id % 4 when 0 then 'x.spec.ts' when 1 then 'test_x.py' when 2 then 'x.py' else 'x.md' end)"


@query(f"""
select doc_id, case when path like '%.md' then null when path like '%.spec.ts' then 'test' when path like '%/tests/%' then 'test' when path like '%/src/%' then 'source' when path like '%/test\\_x.py' escape '\\' then 'test' else 'source' end as kind
from (select doc_id, {CODE_PATH} as path from documents)
""")
def code_kinds(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", code.code_kind(F.expr(CODE_PATH)).alias("kind"))


MESSAGE = "case substr(o_orderpriority, 1, 1) when '1' then 'fix: a' when '2' then 'feat(x): b' when '3' then 'refactor: c' when '4' then 'closes #7' else 'tidy' end"


@query(f"""
with c as (select o_custkey as scope, {MESSAGE} as message, o_orderstatus = 'P' as other from orders),
k as (select scope, max(case when message in ('fix: a', 'closes #7') then 1 else 0 end) as bugfix, max(case when message = 'feat(x): b' then 1 else 0 end) as feature, max(case when message = 'refactor: c' then 1 else 0 end) as refactor, min(case when other then 1 else 0 end) as chore from c group by scope)
select scope, case when bugfix = 1 then 'bugfix' when feature = 1 then 'feature' when refactor = 1 then 'refactor' when chore = 1 then 'chore' else 'feature' end as kind from k
""")
def change_kinds(spark, sf_dir):
    commits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope"), F.lit(None).cast("string").alias("branch"), F.expr(MESSAGE).alias("message"), (F.col("o_orderstatus") == "P").alias("only_other_files"))
    return domain.change_kind(commits).select("scope", "kind")


@query("""
with t as (select distinct unnest(regexp_extract_all(text, '[A-Za-z]{12,}')) as token from benchmark),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from documents),
w as (select distinct doc_id, line_no, unnest(regexp_extract_all(line, '[A-Za-z]+')) as token from l)
select doc_id, line_no, token from w join t using (token)
""")
def reference_lines(spark, sf_dir):
    tokens = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{12,}"), F.lit(0))).alias("token")).distinct().withColumn("owner", F.lit("benchmark"))
    lines = facts.lines_of(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"))
    return joins.token_lines(lines, tokens, "[A-Za-z]+").select(F.col("path").cast("bigint").alias("doc_id"), "line_no", "token")


@query("""
with f as (select distinct concat(source, '/', case when doc_id % 3 = 0 then 'src' else 'pkg' end, '/', lang, '/f') as path from documents),
m as (select distinct concat(source, '/pkg') as dir from documents where source < 'src2')
select f.path, case when f.path like '%/src/%' then string_split(f.path, '/')[1] when m.dir is not null then m.dir else '' end as project
from f left join m on f.path like concat(m.dir, '/%')
""")
def project_boundaries(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.concat_ws("/", "source", F.when(F.col("doc_id") % 3 == 0, "src").otherwise("pkg"), "lang", F.lit("f")).alias("path")).distinct()
    manifests = docs.where("source < 'src2'").select(F.concat("source", F.lit("/pkg/setup.cfg")).alias("path")).distinct()
    return joins.project_boundary(files, manifests, ["src"]).select("path", "project")


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def tumbling_windows(spark, sf_dir):
    rows = windows.tumbling(table(spark, sf_dir, "events"))
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""
with e as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 30 minute then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from e)
select user_id, min(ts) as session_start, count(*) as n from s group by user_id, session
""")
def event_sessions(spark, sf_dir):
    rows = windows.sessions(table(spark, sf_dir, "events"))
    return rows.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("select distinct a.l_partkey as source, b.l_partkey as test, min(a.l_orderkey) as commit_key from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey where a.l_quantity = 1 and b.l_quantity = 2 group by all")
def changed_together(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    a = line.where("l_quantity = 1").select("l_orderkey", F.col("l_partkey").alias("source"))
    b = line.where("l_quantity = 2").select("l_orderkey", F.col("l_partkey").alias("test"))
    return a.join(b, "l_orderkey").where("source < test").groupBy("source", "test").agg(F.min("l_orderkey").alias("commit_key"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts to metrics to ratings, in one plan."""
    return doc_ratings(spark, sf_dir)

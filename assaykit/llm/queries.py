"""The thin queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import conversation_repair, decontaminate, language_id, licenses, line_dedup, mixing, passage_quality, quality, secrets, simhash, suffix_dedup, transaction_log, url_filter
from assaykit.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed_lines").alias("n_removed_lines"), F.col("__n_runs").alias("n_runs"), F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = f"""
with l as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
w as (
  select doc_id, i - 1 as pos, {line_dedup.WINDOW} as size, ls[i:i + {line_dedup.WINDOW} - 1] as part
  from l, unnest(range(1, len(ls) - {line_dedup.WINDOW} + 2)) u(i)
  where trim(array_to_string(ls[i:i + {line_dedup.WINDOW} - 1], ''), ' ') <> ''
  union all
  select doc_id, i - 1, 1, ls[i:i] from l, unnest(range(1, len(ls) + 1)) u(i)
  where len(regexp_extract_all(ls[i], '[^ \t-\r]+')) >= {line_dedup.LONG_WORDS}
),
later as (
  select doc_id, pos, size from w
  qualify row_number() over (partition by size, part order by doc_id, pos) > 1
),
dead as (select distinct doc_id, pos + j as line from later, unnest(range(0, size)) u(j)),
d as (select doc_id, list(line) as dead from dead group by doc_id),
r as (
  select doc_id, count(*) as n_runs from (
    select doc_id, line, lag(line) over (partition by doc_id order by line) as prev from dead
  ) where prev is null or prev < line - 1 group by doc_id
)
select l.doc_id, coalesce(len(ls), 0) as n_lines, coalesce(len(dead), 0) as n_removed_lines,
  coalesce(n_runs, 0) as n_runs,
  sha256(case when dead is null then text else array_to_string(list_filter(ls, lambda x, i: not list_contains(dead, i - 1)), chr(10)) end) as kept_sha256
from l left join d using (doc_id) left join r using (doc_id)
"""


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = secrets.fit(secrets.labelled_samples(spark))
    found = secrets.scan(table(spark, sf_dir, "documents"), weights)
    base = F.col("base")
    counts = [secrets.count_of(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("found")).alias("spans"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", "score", "words")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mix(docs, mixing.quality_labels(table(spark, sf_dir, "labels")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", F.col("lid_held_out").alias("held_out"), F.col("lid_pred").alias("lang_pred"), F.col("lid_score").alias("score"), F.col("lid_rejected").alias("rejected"))


def op11_transaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transaction_log.replay(spark, sf_dir)


#: The CRC-32 of a text's bytes, from a table that the polynomial makes: DuckDB has no function for it.
CRC_SQL = """
crc_table as materialized (
  select list(v order by b) as t from (select b, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end, b::bigint) as v from range(256) r(b))
)"""


def crc_sql(text: str) -> str:
    raw = f"hex(encode({text}))"
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr({raw}, 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce({octets}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::bigint), 4294967295::bigint)"


OP11_SQL = f"""
with {CRC_SQL},
h as (select doc_id, text, source is null as nosource, coalesce(source, '') as source, {crc_sql("doc_id::varchar")} as h from documents, crc_table where doc_id is not null),
log as (
  select *, h % 23 as code, (h // 100) % 300 as key, sum((h % 23 <= 2)::int) over (partition by nosource, source order by doc_id rows between unbounded preceding and 1 preceding) as txn,
    case when h % 23 in (3, 4) then 1 when h % 23 in (5, 6) then -1 else 0 end as step from h
),
walked as (select *, coalesce(txn, 0) as tx, sum(step) over (partition by nosource, source, coalesce(txn, 0) order by doc_id rows unbounded preceding) as walk from log),
levelled as (select *, walk - least(0, min(walk) over (partition by nosource, source, tx order by doc_id rows unbounded preceding)) as level from walked),
stepped as (select *, case when code in (5, 6) then coalesce(lag(level) over (partition by nosource, source, tx order by doc_id), 0) else level end as lv from levelled),
ended as (
  select *, min(case when code in (5, 6) then doc_id end) over (partition by nosource, source, tx, lv order by doc_id rows between 1 following and unbounded following) as rolled_at,
    max(case when code <= 2 then doc_id end) over (partition by nosource, source, tx) as ended_at, min(case when code <= 2 then code end) over (partition by nosource, source, tx) as ended_code from stepped
),
commits as (select doc_id, (row_number() over (order by doc_id) - 1) // 4 + 1 as epoch from log where code <= 1),
applied as (
  select c.epoch, e.key, e.ended_at, e.doc_id, text, exists (select 1 from labels l where l.doc_id = e.doc_id and toxic = 1) as toxic
  from ended e join commits c on c.doc_id = e.ended_at where code > 6 and rolled_at is null and ended_code <= 1
),
versions as (
  select epoch, key, ended_at, doc_id, case when text is not null and not toxic then {crc_sql("key::varchar || ':' || text")} end as mark from applied, crc_table
),
deltas as (
  select epoch, (mark is not null)::int - (lag(mark) over w is not null)::int as dn, coalesce(mark, 0) - coalesce(lag(mark) over w, 0) as dv
  from versions window w as (partition by key order by ended_at, doc_id)
)
select 'state' as kind, e.epoch as id, (sum(coalesce(sum(dn), 0)) over (order by e.epoch))::bigint as n, (sum(coalesce(sum(dv), 0)) over (order by e.epoch))::bigint as value
from (select distinct epoch from commits) e left join deltas using (epoch) group by e.epoch
union all
select case when rolled_at is not null then 'rollback' else 'abort' end, doc_id, coalesce(rolled_at, ended_at), key
from ended where code > 6 and (rolled_at is not null or ended_code is null or ended_code = 2)
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired_conversations(spark, sf_dir)


def _arc(w: str, label: str, cost: str) -> str:
    return f"{{'c': {w}.c + {cost}, 's': {w}.s || '{label}'}}"


def op12_sql() -> str:
    """The four grammar states' weights, folded over each conversation's rows, with a step of inserts before
    each row; then the edits, folded into the repaired text."""
    insert = lambda w: _arc(w, "I", "2")
    one2 = f"least({insert('a.w0')}, {insert('a.w1')}, {insert('a.w3')})"
    w2 = f"least(a.w2, {one2}, {_arc(insert('a.w2'), 'I', '2')})"
    w3 = f"least(a.w3, {insert('a.w2')}, {_arc(one2, 'I', '2')})"
    goes = lambda w: _arc(w, "D", "3")
    never = "{'c': 1000000000::bigint, 's': ''}"
    keep = lambda w, i: f"case when not x.must and x.initial = '{i}' then {_arc(w, 'K', 'x.cut')} else {never} end"
    name = lambda w: f"case when not x.must then {_arc(w, 'R', '2 + x.cut')} else {never} end"
    r2 = ", ".join(f(w) for w in ("a.w0", "a.w1", "a.w3") for f in (lambda w: keep(w, "u"), name))
    row = lambda *w: "{'step': x.step, 'initial': x.initial, 'must': x.must, 'cut': x.cut, " + ", ".join(f"'w{i}': {v}" for i, v in enumerate(w)) + "}"
    fold = f"case when x.step = 'insert' then {row('a.w0', 'a.w1', w2, w3)} else {row(goes('a.w0'), f'least({goes("a.w1")}, {keep("a.w0", "s")})', f'least({goes("a.w2")}, {r2})', f'least({goes("a.w3")}, {keep("a.w2", "a")}, {name("a.w2")})')} end"
    blank = "{'step': 'insert', 'initial': '', 'must': false, 'cut': 0::bigint, 'w0': %s, 'w1': %s, 'w2': %s, 'w3': %s}"
    dummy = blank % ((never,) * 4)
    start = blank % ("{'c': 0::bigint, 's': ''}", never, never, never)
    item = f"{{'step': 'row', 'initial': role[1:1], 'must': fault in ('blank', 'duplicate'), 'cut': (fault = 'truncated')::bigint, 'w0': {never}, 'w1': {never}, 'w2': {never}, 'w3': {never}}}"
    # the next role that a state takes is a after u, else u
    to = "case when a.q = 2 then 'assistant' else 'user' end"
    line = "case e.x when 'I' then {to} || ':' when 'R' then {to} || ':' || rows[a.i].text when 'K' then rows[a.i].role || ':' || rows[a.i].text end".replace("{to}", to)
    apply = f"{{'x': e.x, 'i': a.i + (e.x <> 'I')::bigint, 'q': case when e.x = 'D' then a.q when e.x = 'K' and rows[a.i].role[1:1] = 's' then 1 when a.q = 2 then 3 else 2 end, 'out': a.out || case when e.x = 'D' then '' else case when a.out = '' then '' else chr(10) end || {line} end}}"
    return f"""
with {CRC_SQL},
h as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as h from conversations, crc_table),
damaged as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role, case h when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, copy
  from h, unnest(range(case h when 0 then 0 when 3 then 2 else 1 end)) u(copy)
),
ranked as (
  select *, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as k, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as last from damaged
),
faulty as (
  select *, case when last = '' then 'blank' when k > 1 then 'duplicate' when last not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(role[1:1]) over (partition by conv_id order by i) || role[1:1] as pair from ranked
),
listed as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, list({{'role': role, 'text': text}} order by i) as rows,
    flatten(list([{dummy}, {item}] order by i)) || [{dummy}] as steps from faulty group by conv_id
),
walked as (select *, list_reduce(steps, lambda a, x: {fold}, {start}) as z from listed),
solved as (select *, least(z.w0, z.w3) as best from walked),
rebuilt as (
  select *, list_reduce(list_transform(string_split(best.s, ''), lambda c: {{'x': c, 'i': 1::bigint, 'q': 0, 'out': ''}}), lambda a, e: {apply}, {{'x': '', 'i': 1::bigint, 'q': 0, 'out': ''}}) as t from solved
)
select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(best.c, 0) as cost, coalesce(best.s, '') as audit, sha256(coalesce(t.out, '')) as repaired_sha256
from (select distinct conv_id as id from conversations) left join rebuilt on conv_id is not distinct from id
"""


def op13_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_quality.passage_quality(spark, sf_dir)


# What SQL can say of op3, op5 and op9: their patterns, rules and counts, by the operators' own functions.


def llm_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = secrets.base_spans(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", base.alias("base")).select("doc_id", *(secrets.count_of(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")))


SECRET_SQL = f"""
select doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '{secrets.ASSIGN.replace("'", "''")}', 2), lambda x: length(x) >= {secrets.MIN_ASSIGN})) as n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '{secrets.ACCESS}'), lambda x: length(x) >= {secrets.MIN_ACCESS})) as n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) as n_hex
from documents
"""


def llm_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.counts(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


QUALITY_SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g') <> '') as ls from d),
g as (select doc_id, i, ws[i:i + 2] as gram from w, unnest(range(1, len(ws) - 1)) u(i)),
r as (select doc_id, i from g qualify count(*) over (partition by doc_id, gram) > 1),
c as (select doc_id, count(distinct i + j) as n from r, (values (0), (1), (2)) o(j) group by doc_id)
select w.doc_id, len(ws) as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
  len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n, 0) as n_repeat_words
from w left join c using (doc_id)
"""


def llm_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    return pages.select("*", url_filter.rule_of(F.col("host"), F.col("path"))[0].alias("rule"))


URL_SQL = f"""
with p as (select page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') as raw, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
h as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from p),
rules(h, p) as (values {", ".join(f"('{h}', '{p}')" for _, h, p in url_filter.RULES)})
select page_id, host, path, (select r.h || r.p from rules r where (host = r.h or ends_with(host, '.' || r.h)) and starts_with(path, r.p) order by length(r.h || r.p) desc limit 1) as rule from h
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_suffix_dedup, op2_line_dedup, op3_secrets, op4_decontaminate, op5_url_filter, op6_licenses, op7_mixing, op8_simhash, op9_quality, op10_language_id, op11_transaction_log, op12_conversation_repair, op13_passage_quality, llm_secret_counts, llm_quality_counts, llm_url_rules)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op11_transaction_log": OP11_SQL, "op12_conversation_repair": op12_sql(), "llm_secret_counts": SECRET_SQL, "llm_quality_counts": QUALITY_SQL, "llm_url_rules": URL_SQL}

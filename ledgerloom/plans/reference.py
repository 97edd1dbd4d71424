"""Queries of the fact pipeline's operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import periods, text, values
from ledgerloom.operators import canon, grounding, ingest, ingest_run, pairing, reconcile, views
from ledgerloom.session import Scratch, table
from ledgerloom.sources import sinks, texts
from ledgerloom.streaming import arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def put(f: Callable) -> Callable:
        names = f.__code__.co_varnames[:f.__code__.co_argcount]
        QUERIES[f.__name__] = lambda spark, d: f(*[spark if n == "spark" else d if n == "d" else table(spark, d, n) for n in names])
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


_EDGE = r"^[ \t\r\n\f]+|[ \t\r\n\f]+$"
_COLLAPSE = r"trim(regexp_replace({0}, '[\s\p{{Z}}]+', ' ', 'g'))"


def _blocks_of(src: str, key: str = "doc_id") -> str:
    return (f"select {key}, cast((i - 1) // 40 + 1 as int) as page_no, cast((i - 1) % 40 as int) as block_index, text from ("
            f"select {key}, i, regexp_replace(l[i], '{_EDGE}', '', 'g') as text from (select {key}, string_split(text, chr(10)) as l from {src}) s, "
            "unnest(range(1, len(l) + 1)) as t(i)) where text <> ''")


@query(_blocks_of("(select * from documents where text is not null)"))
def block_scan(documents: DataFrame) -> DataFrame:
    return texts.text_blocks(documents)


_VISIBLE = r"regexp_replace(text, '<(script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', ' ', 'gis')"
_VISIBLE = rf"regexp_replace({_VISIBLE}, '</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article)[^>]*>', chr(10), 'gi')"
_VISIBLE = rf"regexp_replace({_VISIBLE}, '<[a-zA-Z/][^>]*>', '', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _VISIBLE = f"replace({_VISIBLE}, '{_a}', '{_b}')"


@query(_blocks_of(f"(select doc_id, {_VISIBLE} as text from documents where text is not null)"))
def html_block_scan(documents: DataFrame) -> DataFrame:
    return texts.html_blocks(documents, "doc_id", "text")


@query("select doc_id, coalesce(sha256(text) = sha256, false) as same from documents where text is not null")
def content_hash_check(documents: DataFrame) -> DataFrame:
    return documents.where("text is not null").select("doc_id", F.coalesce(texts.content_hash(F.col("text")) == F.col("sha256"), F.lit(False)).alias("same"))


@query("select sha256, min(doc_id) as doc_id, count(*) as uploads from documents where sha256 is not null group by 1")
def document_insert_or_get(documents: DataFrame) -> DataFrame:
    return sinks.insert_or_get(documents)


_KEY = "lower(" + _COLLAPSE.format(r"regexp_replace(text, '\p{Nd}+', '#', 'g')") + ")"


@query(f"with b as (select id, doc_id, page_no, {_KEY} as key from blocks), o as (select doc_id, key from b where key <> '' group by 1, 2 having count(distinct page_no) >= 4) "
       "select id, doc_id, exists(select 1 from o where o.doc_id = b.doc_id and o.key = b.key) as is_boilerplate from b")
def boilerplate_blocks(blocks: DataFrame) -> DataFrame:
    return ingest.flag_boilerplate(blocks)


_GAPS = ("select s.doc_id, s.page_no, case when coalesce(c.chars, 0) = 0 then 'no extractable text; page is likely image-only' "
         "else 'only ' || c.chars || ' characters extracted; likely scanned or graphical' end as reason from "
         "(select doc_id, cast(p as int) as page_no from documents, unnest(range(1, page_count + 1)) as t(p) where page_count >= 1) s left join "
         "(select doc_id, page_no, cast(sum(length(text)) as bigint) as chars from blocks group by 1, 2) c on c.doc_id = s.doc_id and c.page_no = s.page_no "
         "where coalesce(c.chars, 0) < 120")


@query(_GAPS)
def page_gaps(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    return ingest.page_gaps(documents, blocks)


_N, _U, _P = (f"len(regexp_extract_all(lower(text), '{p}'))" for p in (text.DENSE_NUMBER, text.DENSE_UNIT, text.DENSE_PERIOD))


@query(f"select id, cast({_N} as int) as numbers, cast({_U} as int) as units, cast({_P} as int) as periods, "
       f"round(({_N} + 2 * {_U} + 2 * {_P}) / greatest(length(text) / 200.0, 1.0), 6) as density from blocks where text is not null")
def block_density(blocks: DataFrame) -> DataFrame:
    n, u, p = text.density_counts(F.col("text"))
    return blocks.where("text is not null").select("id", n.alias("numbers"), u.alias("units"), p.alias("periods"), F.round(text.density(F.col("text")), 6).alias("density"))


_LEN = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"
# the fold as a recursion over the blocks of all documents in step
_WINDOWS = f"""
with recursive b as (
  select doc_id, text, row_number() over (partition by doc_id order by page_no, block_index, id) as i, count(*) over (partition by doc_id) as last
  from blocks where doc_id is not null and text is not null and not coalesce(is_boilerplate, false)
),
r as (
  select doc_id, cast(0 as bigint) as i, cast([] as varchar[]) as open, cast(null as varchar[]) as done, cast(-1 as bigint) as n, any_value(last) as last from b group by 1
  union all
  select doc_id, i, case when full_ then list_append(kept, text) else list_append(open, text) end, case when full_ then open end, n + cast(full_ as int), last
  from (
    select *, case when full_ then list_filter(open, lambda t, k: {_LEN.format("open[k + 1:]")} < 1200) end as kept
    from (select r.doc_id, b.i, b.text, r.open, r.n, r.last, len(r.open) > 0 and {_LEN.format("r.open")} + length(b.text) > 12000 as full_ from r join b on b.doc_id = r.doc_id and b.i = r.i + 1)
  )
),
w as (select doc_id, n as window_index, done as parts from r where done is not null union all select doc_id, n + 1, open from r where i = last),
t as (select doc_id, window_index, len(parts) as n_blocks, array_to_string(parts, chr(10)) as text from w)
select doc_id, cast(window_index as int) as window_index, cast(n_blocks as int) as n_blocks, cast(length(text) as int) as n_chars,
  round(({_N} + 2 * {_U} + 2 * {_P}) / greatest(length(text) / 200.0, 1.0), 6) as density from t
"""


@query(_WINDOWS)
def text_windows(blocks: DataFrame) -> DataFrame:
    return ingest.build_windows(blocks).select("doc_id", "window_index", F.size("block_ids").alias("n_blocks"), F.length("text").alias("n_chars"), F.round("density", 6).alias("density"))


@query("select doc_id, window_index, density from (select *, row_number() over (partition by doc_id order by density desc, window_index) as r from windows) where r <= 2")
def densest_windows(windows: DataFrame) -> DataFrame:
    return ingest.densest(windows, 2).select("doc_id", "window_index", "density")


@query("with h as (select id as window_id, window_index * 10 as window_index, text, block_spans[1:len(block_spans) // 2] as sp from windows where len(block_spans) >= 2 and text is not null "
       "union all select id, window_index * 10 + 1, text, block_spans[len(block_spans) // 2 + 1:] from windows where len(block_spans) >= 2 and text is not null) "
       "select window_id, window_index, substring(text, sp[1].s + 1, sp[-1].e - sp[1].s) as text, cast(len(sp) as int) as n_blocks from h")
def window_halves(windows: DataFrame) -> DataFrame:
    return ingest.halves(windows).select("window_id", "window_index", "text", F.size("block_ids").alias("n_blocks"))


@query("select id as window_id, array_to_string(list_transform(list_filter(range(1, len(block_spans) + 1), "
       "lambda i: length(text) // 4 < block_spans[i].e and length(text) // 2 > block_spans[i].s), lambda i: block_ids[i]), ',') as block_ids from windows where block_spans is not null")
def span_blocks(windows: DataFrame) -> DataFrame:
    s = ingest.span_blocks(windows, "length(text) div 4", "length(text) div 2")
    return s.select("window_id", F.array_join(F.transform("block_ids", lambda x: x.cast("string")), ",").alias("block_ids"))


_QUOTED = ("q as (select e.id as evidence_id, e.fact_id, e.quote, t.text from evidence e left join (select evidence_id, string_agg(t, chr(10) order by bid) as text from "
           "(select distinct x.evidence_id, x.bid, b.text as t from (select id as evidence_id, unnest(block_ids) as bid from evidence) x join blocks b on b.id = x.bid) group by 1) t on t.evidence_id = e.id)")
_LOOSE = (r"array_to_string(list_transform(string_split(" + _COLLAPSE.format("quote") + r", ' '), lambda w: regexp_escape(w)), '[\s\p{Z}]+')")
_LOCATED = (f"g as (select *, case when length({_COLLAPSE.format('quote')}) = 0 then null when strpos(text, quote) > 0 then quote "
            f"else nullif(regexp_extract(text, {_LOOSE}), '') end as hit from q)")


@query(f"with {_QUOTED}, {_LOCATED} select evidence_id, fact_id, cast(strpos(text, hit) - 1 as int) as start, cast(strpos(text, hit) - 1 + length(hit) as int) as \"end\" from g where hit is not null and text is not null")
def ground_quotes(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    return grounding.ground(grounding.quoted_texts(evidence, blocks))


_REJECTED = (f"with {_QUOTED}, {_LOCATED} select evidence_id, fact_id, reason from (select evidence_id, g.fact_id, case when hit is null or text is null then '{grounding.NOT_FOUND}' "
             f"when coalesce(subject, '') = '' or coalesce(metric, '') = '' then '{grounding.MISSING}' end as reason from g join facts f on f.id = g.fact_id) where reason is not null")


@query(_REJECTED)
def rejected_proposals(evidence: DataFrame, blocks: DataFrame, facts: DataFrame) -> DataFrame:
    return grounding.rejected(grounding.quoted_texts(evidence, blocks), facts)


@query("with e as (select fact_id, min(quote) as quote from evidence group by 1), k as (select f.id, f.doc_id, coalesce(confidence, 0) as confidence, lower(trim(coalesce(subject, ''))) as s, "
       "lower(trim(coalesce(metric, ''))) as m, trim(coalesce(value_raw, '')) as v, trim(coalesce(period_raw, '')) as p, lower(" + _COLLAPSE.format("coalesce(quote, '')") + ") as q "
       "from facts f left join e on e.fact_id = f.id) select first(id order by confidence desc, id) as fact_id, max(confidence) as confidence, count(*) as copies from k group by doc_id, s, m, v, p, q")
def dedupe_facts(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    return grounding.dedupe_facts(facts, evidence)


@query("with j as (select distinct x.evidence_id, b.* from (select id as evidence_id, unnest(block_ids) as bid from evidence) x join blocks b on b.id = x.bid), "
       "p as (select evidence_id, arg_min(page_no, id) as page_no from j where page_no is not null group by 1) "
       "select j.evidence_id, j.page_no, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from j join p on p.evidence_id = j.evidence_id and p.page_no = j.page_no group by 1, 2")
def evidence_boxes(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    return grounding.evidence_boxes(evidence, blocks)


_TOK = rf"trim(regexp_replace(regexp_extract(translate({{0}}, '{values.DIGITS[0]}', '{values.DIGITS[1]}'), '{values.NUMBER}'), '[\s\p{{{{Z}}}}]+', ' ', 'g'))".replace("{{Z}}", "{Z}")


def _number(col: str) -> str:
    tok = _TOK.replace("{0}", col)
    bare = f"trim(replace(trim({tok}, '()'), ',', ''))"
    num = f"case when regexp_matches({bare}, '^-?[0-9]*\\.?[0-9]+$') then try_cast({bare} as double) end"
    return f"(case when {tok} like '(%' and {tok} like '%)' then -({num}) else {num} end)"


@query(f"select id, {_number('value_raw')} as number from facts")
def parse_numbers(facts: DataFrame) -> DataFrame:
    return facts.select("id", values.parse_number(F.col("value_raw")).alias("number"))


_BLOB = "lower(coalesce(value_raw, '') || ' ' || coalesce(unit_raw, ''))"
_SCALE = "case " + " ".join(f"when regexp_matches({_BLOB}, '{values.whole(w)}') then {f:.1f}" for w, f in values.SCALE_ORDER) + " else 1.0 end"
_DROP = "(^|[^a-z0-9_])(?:(?:" + "|".join(w for w, _ in values.SCALE_ORDER) + ")s?|in)($|[^a-z0-9_])"
_RESIDUE = rf"regexp_replace(regexp_replace(regexp_replace(' ' || lower(coalesce(unit_raw, '')) || ' ', '{_DROP}', '\1 \2', 'g'), '{_DROP}', '\1 \2', 'g'), '[^a-z]+', '', 'g')"
_VALUES = (f"select id, case when unit = 'PERCENT' then n else n * scale end as canon_value, unit as canon_unit from (select *, case when n is null then null when regexp_matches(blob, '{values.PERCENT}') then 'PERCENT' "
           f"when regexp_matches(blob, '{values.whole('ton|tonne|mt')}') then 'TONNE' when regexp_matches(blob, '{values.whole('day')}') then 'DAYS' when regexp_matches(blob, '{values.INR}') then 'INR' "
           f"when regexp_matches(blob, '{values.USD}') then 'USD' when regexp_matches(lower(coalesce(unit_raw, '')), '{values.MANGLED}') then 'INR' when regexp_matches(ctx, '{values.INR}') then 'INR' "
           f"when regexp_matches(ctx, '{values.USD}') then 'USD' when residue = '' then 'UNKNOWN' else 'COUNT' end as unit from (select f.id, unit_raw, {_number('value_raw')} as n, cast({_SCALE} as double) as scale, {_BLOB} as blob, "
           f"{_RESIDUE} as residue, lower(coalesce(e.quote, '')) as ctx from facts f left join (select fact_id, min(quote) as quote from evidence group by 1) e on e.fact_id = f.id))")


@query(_VALUES)
def normalize_values(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    e = evidence.where("fact_id is not null").groupBy("fact_id").agg(F.min("quote").alias("quote"))
    f = facts.select("id", "value_raw", "unit_raw").join(e.withColumnRenamed("fact_id", "id"), "id", "left")
    return values.with_canonical_pair(f, "value_raw", "unit_raw", "quote").select("id", "canon_value", "canon_unit")


def _printed_sql() -> str:
    t = "lower(" + _COLLAPSE.format("period_raw") + ")"
    x = lambda p, i: f"try_cast(regexp_extract(t, '{p.replace(chr(39), chr(39) * 2)}', {i}) as int)"
    has = lambda p: f"regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}')"
    ex = lambda y: f"(case when {y} > 100 then {y} else 2000 + {y} end)"
    mon = lambda p: "list_position([" + ",".join(f"'{m}'" for m in periods.MONTHS) + f"], regexp_extract(t, '{p}', 1))"
    day = lambda y, m, d: f"strftime(try_cast(printf('%04d-%02d-%02d', {y}, {m}, {d}) as date), '%Y-%m-%d')"
    last = lambda y, m: f"strftime(last_day(try_cast(printf('%04d-%02d-01', {y}, {m}) as date)), '%Y-%m-%d')"
    fy = lambda y: (day(f"({y}) - 1", 4, 1), day(y, 3, 31), "'fiscal_year'")
    q, qy = x(periods.QUARTER, 1), ex(x(periods.QUARTER, 2))
    yq, mq = f"(case when {q} = 4 then {qy} else {qy} - 1 end)", f"(case when {q} = 4 then 1 else 3 * {q} + 1 end)"
    tail, am, em, ey = x(periods.FY_PAIR, 2), mon(periods.AS_ON), mon(periods.ENDED), x(periods.ENDED, 3)
    on = day(x(periods.AS_ON, 3), am, x(periods.AS_ON, 2))
    cy = f"coalesce({x(periods.CALENDAR, 2)}, case when regexp_matches(t, '^20[0-9]{{2}}$') then try_cast(t as int) end)"
    rules = [(has(periods.QUARTER), (day(yq, mq, 1), last(yq, f"{mq} + 2"), "'quarter'")), (has(periods.FY_PAIR), fy(f"case when {tail} < 100 then {ex(tail)} else {tail} end")),
             (has(periods.FY), fy(ex(x(periods.FY, 1)))), (has(periods.PAIR), fy(ex(x(periods.PAIR, 3)))),
             (f"{has(periods.AS_ON)} and {am} between 1 and 12", (on, on, f"case when {on} is not null then 'instant' end")), (f"{has(periods.ENDED)} and {em} = 3", fy(ey)),
             (f"{has(periods.ENDED)} and {em} between 1 and 12", (day(f"{ey} - 1", em, 1), last(ey, em), "'part_year'")), (f"{cy} is not null", (day(cy, 1, 1), day(cy, 12, 31), "'calendar_year'"))]
    cols = [" ".join(["case", *[f"when {c} then {r[k]}" for c, r in rules], "end"]) for k in range(3)]
    return f"select id, {cols[0]} as period_start, {cols[1]} as period_end, {cols[2]} as period_kind from (select id, {t} as t from facts)"


@query(_printed_sql())
def printed_periods(facts: DataFrame) -> DataFrame:
    return periods.with_printed_period(facts.select("id", "period_raw"), "period_raw").drop("period_raw")


def _figures(c: str) -> str:
    dg = f"regexp_replace(translate({c}, '{values.DIGITS[0]}', '{values.DIGITS[1]}'), '[^0-9.]', '', 'g')"
    return (f"cast(case when {c} is null or not regexp_matches({dg}, '[0-9]') then null when {dg} like '%.%' then nullif(length(ltrim(replace({dg}, '.', ''), '0')), 0) else greatest(length(trim({dg}, '0')), 1) end as int)")


@query(f"select id, {_figures('value_raw')} as figures from facts")
def significant_figures(facts: DataFrame) -> DataFrame:
    return facts.select("id", values.significant_figures(F.col("value_raw")).alias("figures"))


def _agree(a: str, b: str) -> str:
    fa, fb, va, vb = _figures(a + ".value_raw"), _figures(b + ".value_raw"), f"{a}.canon_value", f"{b}.canon_value"
    # scientific notation rounds the exact binary value to so many figures
    r = lambda v: f"case when {v} = 0 then '0' else format('{{:.' || (least({fa}, {fb}) - 1) || 'e}}', {v}) end"
    return (f"coalesce({va} = {vb} or abs({va} - {vb}) <= 0.001 * greatest(abs({va}), abs({vb})) "
            f"or ({fa} is not null and {fb} is not null and {r(va)} = {r(vb)}), false)")


@query(f"select r.id, {_agree('a', 'b')} as agree from relations r join facts a on a.id = r.fact_a join facts b on b.id = r.fact_b")
def values_agree(relations: DataFrame, facts: DataFrame) -> DataFrame:
    return reconcile.classify(relations.select("id", "fact_a", "fact_b"), facts).select("id", "agree")


_SLUG = "coalesce(nullif(trim(regexp_replace(lower(raw), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unnamed')"


@query("with t as (select distinct 'subject' as kind, subject as raw from facts where subject is not null union all select distinct 'metric', metric from facts where metric is not null), "
       "k as (select kind, raw, min(canon_id) as canon_id from canon_terms group by 1, 2) "
       f"select t.kind, t.raw, coalesce(k.canon_id, {_SLUG.replace('raw', 't.raw')}) as canon_id, k.canon_id is null as is_new from t left join k on k.kind = t.kind and k.raw = t.raw")
def canonical_terms(facts: DataFrame, canon_terms: DataFrame) -> DataFrame:
    return canon.canonical_terms(facts, canon_terms)


@query("select f.id, s.canon_id as entity_id, m.canon_id as metric_id from facts f left join canon_terms s on s.kind = 'subject' and s.raw = f.subject left join canon_terms m on m.kind = 'metric' and m.raw = f.metric")
def canonical_ids(facts: DataFrame, canon_terms: DataFrame) -> DataFrame:
    return canon.with_ids(facts, canon_terms)


_COMPAT = "coalesce(nullif(nullif({0}, ''), 'UNKNOWN') = nullif(nullif({1}, ''), 'UNKNOWN'), true)"


@query("with f as (select id, metric_id, canon_unit from facts where metric_id is not null and metric_id <> ''), n as (select metric_id, count(*) as facts from f group by 1), "
       f"p as (select a.metric_id, count(*) as pairs from f a join f b on a.metric_id = b.metric_id and a.id < b.id where {_COMPAT.format('a.canon_unit', 'b.canon_unit')} group by 1) "
       "select n.metric_id, n.facts, coalesce(p.pairs, 0) as pairs from n left join p on p.metric_id = n.metric_id")
def pairs_by_metric(facts: DataFrame) -> DataFrame:
    return pairing.metric_pair_counts(facts)


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_SETS = ("s as (select distinct list_sort(list_distinct(list_filter(regexp_extract_all(lower(metric), '[a-z0-9]+'), lambda w: length(w) > 2 and not list_contains([" + _STOP + "], w)))) as toks from facts where metric is not null), "
         "c as (select array_to_string(toks, ' ') as key, toks from s where len(toks) > 0)")
_SIMILAR = ("select a.key as key_a, b.key as key_b, cast(len(list_intersect(a.toks, b.toks)) as int) as common, cast(len(list_distinct(list_concat(a.toks, b.toks))) as int) as total "
            "from c a join c b on a.key < b.key where len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))) >= 0.6")


@query(f"with {_SETS} {_SIMILAR}")
def pairs_by_tokens(facts: DataFrame) -> DataFrame:
    return pairing.similar_sets(pairing.token_sets(facts))


@query(f"with {_SETS}, t as ({_SIMILAR}), m as (select distinct array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(metric), '[a-z0-9]+'), lambda w: length(w) > 2 and not list_contains([{_STOP}], w)))), ' ') as key, "
       "metric_id from facts where metric_id <> '' and metric is not null), x as (select key_a, key_b, common / total as score from t union all select a.key, b.key, 1.0 from m a join m b on a.metric_id = b.metric_id and a.key < b.key where a.key <> '' and b.key <> '') "
       "select key_a, key_b, round(max(score), 6) as score from x group by 1, 2")
def pairs_scored(facts: DataFrame) -> DataFrame:
    return pairing.scored_sets(facts)


@query("with r as (select id, metric_id, coalesce(canon_unit, '') as unit, (row_number() over (partition by metric_id, coalesce(canon_unit, '') order by id) - 1) // 7 as run from facts where metric_id is not null and metric_id <> '') "
       "select a.id as fact_a, b.id as fact_b from r a join r b on a.metric_id = b.metric_id and a.unit = b.unit and a.run = b.run and a.id < b.id")
def pairs_capped_uniform(facts: DataFrame) -> DataFrame:
    return pairing.capped_uniform(facts)


# greedy choice as a recursion over the facts of all metrics in step: at step i every metric's i-th fact meets its open facts
_CAPPED = f"""
with recursive f as (
  select id, metric_id, nullif(nullif(canon_unit, ''), 'UNKNOWN') as unit, row_number() over (partition by metric_id order by id) as i
  from facts where metric_id is not null and metric_id <> ''
),
r as (
  select metric_id, cast(0 as bigint) as i, cast([] as struct(id bigint, unit varchar, room int)[]) as op, cast(null as bigint) as id, cast([] as bigint[]) as hit
  from f where i = 1
  union all
  select metric_id, i, list_filter(list_concat(list_transform(op, lambda o: struct_pack(id := o.id, unit := o.unit, room := o.room - case when list_contains(hit, o.id) then 1 else 0 end)),
           [struct_pack(id := id, unit := unit, room := cast(6 - len(hit) as int))]), lambda o: o.room > 0), id, hit
  from (
    select r.metric_id, f.i, r.op, f.id, f.unit, list_transform(list_filter(r.op, lambda o: f.unit is null or o.unit is null or o.unit = f.unit), lambda o: o.id)[1:6] as hit
    from r join f on f.metric_id = r.metric_id and f.i = r.i + 1
  )
)
select unnest(hit) as fact_a, id as fact_b from r where len(hit) > 0
"""


@query(_CAPPED)
def pairs_capped(facts: DataFrame) -> DataFrame:
    return pairing.capped_by_metric(facts)


_TOKENS = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(metric, '')), '[a-z0-9]+'), lambda w: length(w) > 2 and not list_contains([{_STOP}], w))))"
# score 1: a recursion over the facts of all groups of names in step; lower scores: one over the pairs of all components in step
_CANDIDATES = f"""
with recursive n as (
  select id, {_TOKENS} as toks, nullif(metric_id, '') as mid, metric_id as raw, nullif(entity_id, '') as ent, nullif(nullif(canon_unit, ''), 'UNKNOWN') as unit from facts
),
nd as (select *, array_to_string(toks, ' ') as key, coalesce('m:' || mid, 't:' || array_to_string(toks, ' ')) as node from n where mid is not null or len(toks) > 0),
lk as (select distinct 'm:' || mid as a, 't:' || key as b from nd where mid is not null and len(toks) > 0),
ed as (select a, b from lk union select b, a from lk),
cc as (select a as v, a as g from ed union select ed.b, cc.g from cc join ed on ed.a = cc.v),
gr as (select v, min(g) as g from cc group by 1),
f as (
  select nd.*, coalesce(gr.g, node) as g, row_number() over (partition by coalesce(gr.g, node) order by id) as i, count(*) over (partition by coalesce(gr.g, node)) as last
  from nd left join gr on gr.v = nd.node
),
r as (
  select g, cast(0 as bigint) as i, any_value(last) as last, cast([] as struct(id bigint, unit varchar, mid varchar, raw varchar, key varchar, ent varchar, room int)[]) as op, cast(null as bigint) as id, cast([] as bigint[]) as hit
  from f group by 1
  union all
  select g, i, last, list_filter(list_concat(
      list_transform(op, lambda o: struct_pack(id := o.id, unit := o.unit, mid := o.mid, raw := o.raw, key := o.key, ent := o.ent, room := o.room - case when list_contains(hit, o.id) then 1 else 0 end)),
      [struct_pack(id := id, unit := unit, mid := mid, raw := raw, key := key, ent := ent, room := cast(6 - len(hit) as int))]), lambda o: o.room > 0), id, hit
  from (
    select r.g, f.i, r.last, r.op, f.id, f.unit, f.mid, f.raw, f.key, f.ent, list_transform(list_filter(r.op, lambda o:
        (f.unit is null or o.unit is null or o.unit = f.unit) and (coalesce(f.mid = o.mid, false) or (f.key <> '' and f.key = o.key
         and not (coalesce(f.ent <> o.ent, false) and f.raw is distinct from o.raw)))), lambda o: o.id)[1:6] as hit
    from r join f on f.g = r.g and f.i = r.i + 1
  )
),
lf as (select f.*, o.room from (select unnest(op) as o from r where i = last) join f on f.id = o.id where f.key <> ''),
ks as (select distinct key, toks from lf),
sm as (
  select a.key as ka, b.key as kb, len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))) as score
  from ks a join ks b on a.key < b.key where len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))) >= 0.6
),
se as (select ka as a, kb as b from sm union select kb, ka from sm),
sc as (select a as v, a as g from se union select se.b, sc.g from sc join se on se.a = sc.v),
sg as (select v, min(g) as g from sc group by 1),
e as (
  select sg.g, sm.score, least(x.id, y.id) as fact_a, greatest(x.id, y.id) as fact_b, case when x.id < y.id then x.room else y.room end as room_a, case when x.id < y.id then y.room else x.room end as room_b
  from sm join lf x on x.key = sm.ka join lf y on y.key = sm.kb join sg on sg.v = sm.ka
  where (x.unit is null or y.unit is null or x.unit = y.unit) and not coalesce(x.mid = y.mid, false) and not (coalesce(x.ent <> y.ent, false) and x.raw is distinct from y.raw)
),
q as (select *, row_number() over (partition by g order by score desc, fact_a, fact_b) as k from e),
t as (
  select g, cast(0 as bigint) as k, cast([] as bigint[]) as used, cast(null as bigint) as a, cast(null as bigint) as b, cast(null as double) as score, false as ok from q group by 1
  union all
  select g, k, case when ok then list_concat(used, [a, b]) else used end, a, b, score, ok from (
    select t.g, q.k, t.used, q.fact_a as a, q.fact_b as b, q.score, len(list_filter(t.used, lambda u: u = q.fact_a)) < q.room_a and len(list_filter(t.used, lambda u: u = q.fact_b)) < q.room_b as ok
    from t join q on q.g = t.g and q.k = t.k + 1)
)
select unnest(hit) as fact_a, id as fact_b, cast(1 as double) as score from r where len(hit) > 0
union all select a, b, score from t where ok
"""


@query(_CANDIDATES)
def candidate_pairs(facts: DataFrame) -> DataFrame:
    return pairing.candidate_pairs(facts)


_FULL = "nullif({0}.entity_id, '')"
_DIFF = ("list_sort(list_distinct(list_concat(list_filter(coalesce(map_keys(a.qualifiers), []), lambda k: coalesce(map_extract(a.qualifiers, k)[1] <> map_extract(b.qualifiers, k)[1], false)), "
         f"case when {_FULL.format('a')} <> {_FULL.format('b')} then ['subject'] else [] end, "
         "case when a.period_start is distinct from b.period_start or a.period_end is distinct from b.period_end then ['period'] else [] end, "
         f"case when not {_COMPAT.format('a.canon_unit', 'b.canon_unit')} then ['unit'] else [] end)))")
_PROV = ", ".join(f"'{p}'" for p in reconcile.PROVENANCE)
_CLASSIFIED = (f"d as (select r.id, r.fact_a, r.fact_b, r.model_verdict, r.reason_code, a, b, {_DIFF} as diff, {_agree('a', 'b')} as agree from relations r join facts a on a.id = r.fact_a join facts b on b.id = r.fact_b), "
               f"m as (select *, list_filter(diff, lambda k: not list_contains([{_PROV}], k)) as mat from d), "
               "v as (select *, case when coalesce(a.claim_type = 'attribute', false) or coalesce(b.claim_type = 'attribute', false) or a.canon_value is null or b.canon_value is null then 'needs_model' "
               f"when not {_COMPAT.format('a.canon_unit', 'b.canon_unit')} then 'unrelated' when agree and len(diff) = 0 then 'corroborates' when agree then 'corroborates_with_caveat' "
               "when a.period_start is null or b.period_start is null then 'insufficient_context' when mat = ['period'] then 'different_period' when len(mat) = 1 then 'reconcilable' "
               "when len(mat) = 0 then 'contradiction_candidate' else 'needs_model' end as rule from m)")


@query(f"with {_CLASSIFIED} select id, array_to_string(diff, ',') as diff, array_to_string(mat, ',') as material from v")
def qualifier_diff(relations: DataFrame, facts: DataFrame) -> DataFrame:
    c = reconcile.classify(relations.select("id", "fact_a", "fact_b"), facts)
    return c.select("id", F.array_join("diff", ",").alias("diff"), F.array_join(reconcile.material(F.col("diff")), ",").alias("material"))


@query(f"with {_CLASSIFIED} select id, rule as rule_verdict from v")
def rule_verdicts(relations: DataFrame, facts: DataFrame) -> DataFrame:
    return reconcile.classify(relations.select("id", "fact_a", "fact_b"), facts).select("id", "rule_verdict")


_FINAL = ("case when rule in ('corroborates', 'corroborates_with_caveat') then 'corroborates' when rule = 'unrelated' then 'unrelated' when rule = 'different_period' then 'reconciled_by_context' "
          "when rule = 'contradiction_candidate' then 'contradicts' else 'insufficient_context' end")


@query(f"with {_CLASSIFIED} select id, rule as rule_verdict, {_FINAL} as final_verdict, case when rule = 'different_period' then 'different_period' when rule = 'contradiction_candidate' then 'genuine_disagreement' end as reason_code from v")
def relations_rules_only(relations: DataFrame, facts: DataFrame) -> DataFrame:
    c = reconcile.classify(relations.select("id", "fact_a", "fact_b"), facts)
    final, reason, _ = reconcile.rules_only(F.col("rule_verdict"))
    return c.select("id", "rule_verdict", final.alias("final_verdict"), reason.alias("reason_code"))


_KIND = "coalesce(nullif(regexp_extract(reason_code, '(scale|basis|vintage|period|scope|segment)', 1), ''), 'none')"


def _side(p: str) -> str:
    return (f"case k when 'subject' then {p}.entity_id when 'unit' then {p}.canon_unit when 'period' then case when {p}.period_start is not null or {p}.period_end is not null "
            f"then coalesce({p}.period_start, '') || '/' || coalesce({p}.period_end, '') end else map_extract({p}.qualifiers, k)[1] end")


_CLOSE = "coalesce({0} = {1} or abs({0} - {1}) <= 0.001 * greatest(abs({0}), abs({1})), false)"
_BUDGET = 2000
_ADJUDICATED = f"""
with latest as (
  select * from (select *, row_number() over (partition by fact_a, fact_b order by id desc) as n from relations where fact_a is not null and fact_b is not null) where n = 1
),
{_CLASSIFIED.replace("from relations r join", "from latest r join").replace("r.reason_code,", "r.reason_code, r.confidence,")},
w as (
  select *, '{{' || array_to_string(list_transform(diff, lambda k: '"' || k || '":{{' || concat_ws(',', '"a":"' || ({_side('a')}) || '"', '"b":"' || ({_side('b')}) || '"') || '}}'), ',') || '}}' as qualifier_diff,
    coalesce(a.confidence, 0) + coalesce(b.confidence, 0) as total,
    case when coalesce(model_verdict, 'unrelated') in ('corroborates', 'contradicts', 'reconciled_by_context') then model_verdict else 'unrelated' end as mv, {_KIND} as kind
  from v
),
k as (
  select fact_a, fact_b, row_number() over (order by case when a.doc_id = b.doc_id then 1 else 0 end, case rule when 'contradiction_candidate' then 0 when 'reconcilable' then 1 when 'needs_model' then 2 else 9 end,
    total desc, fact_a, fact_b) as call_rank
  from w where rule in ('contradiction_candidate', 'reconcilable', 'needs_model')
),
x as (
  select w.*, coalesce(call_rank <= {_BUDGET}, false) as called,
    case kind when 'none' then true when 'scale' then {_CLOSE.format("a.canon_value * 100", "b.canon_value")} or {_CLOSE.format("a.canon_value", "b.canon_value * 100")}
      when 'period' then a.period_start is distinct from b.period_start or a.period_end is distinct from b.period_end
      else map_extract(a.qualifiers, kind)[1] is distinct from map_extract(b.qualifiers, kind)[1] end as ok
  from w left join k on k.fact_a = w.fact_a and k.fact_b = w.fact_b
),
y as (
  select *, called and mv = 'reconciled_by_context' and not ok as unproved, called and mv = 'contradicts' and len(mat) > 0 as apart, called and mv = 'corroborates' as vain,
    case when kind = 'scale' and (a.canon_value is null or b.canon_value is null) then 'missing canonical values'
      when kind = 'scale' then 'values do not reconcile under a factor of 100: ' || format('{{:g}}', a.canon_value) || ' vs ' || format('{{:g}}', b.canon_value)
      else kind || ' was claimed to differ but both facts agree on it' end as note
  from x
)
select fact_a, fact_b, rule as rule_verdict, case when called then mv end as model_verdict,
  case when not called then {_FINAL} when unproved or apart or vain then 'needs_review' else mv end as final_verdict,
  case when called then coalesce(reason_code, '') when rule = 'different_period' then 'different_period' when rule = 'contradiction_candidate' then 'genuine_disagreement' end as reason_code,
  case when unproved then ' [unverified: ' || note || ']' when apart then ' [held: ' || array_to_string(mat, ', ') || ' differs, so the two may not be comparable]' when called then ''
    when rule = 'different_period' then 'The two facts cover different periods, so their values are not in conflict.'
    when rule = 'contradiction_candidate' then 'Same metric, period and unit; the values differ and no recorded qualifier distinguishes them. Decided by rule alone; no model review.'
    when rule in ('reconcilable', 'needs_model') then 'no adjudication available for this pair' end as explanation,
  qualifier_diff, case when called then '{{"kind":"' || kind || '","factor":"100"}}' end as claimed_transform,
  case when called and mv = 'reconciled_by_context' then not unproved end as verified, case when called then not (unproved or apart or vain) end as agreed,
  case when called then coalesce(confidence, 0) end as confidence
from y
"""


@query(_ADJUDICATED)
def adjudicated_relations(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """The stored pairs judged again: answers from the stored model verdicts, a budget that ends before all pairs are asked."""
    kept = relations.where("fact_a is not null and fact_b is not null").select("fact_a", "fact_b", "id", "model_verdict", "reason_code", "confidence")
    pairs = sinks.keep_latest(kept, ["fact_a", "fact_b"], F.col("id"))
    answers = pairs.select("fact_a", "fact_b", F.coalesce("model_verdict", F.lit("unrelated")).alias("verdict"), "reason_code", F.expr(_KIND).alias("kind"), F.lit("100").alias("factor"), "confidence")
    return reconcile.adjudicate(reconcile.classify(pairs.select("fact_a", "fact_b"), facts), facts, answers, _BUDGET)


@query()
def relations_built(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts to relations end to end; answers where the stored relations have a model verdict."""
    stored = sinks.keep_latest(relations.where("fact_a is not null and fact_b is not null").select("fact_a", "fact_b", "id", "model_verdict"), ["fact_a", "fact_b"], F.col("id"))
    answers = stored.where("model_verdict is not null").select("fact_a", "fact_b", F.col("model_verdict").alias("verdict"))
    return reconcile.build_relations(facts, answers)


@query("select fact_a, fact_b, max(id) as id, arg_max(coalesce(final_verdict, ''), id) as final_verdict from relations group by 1, 2")
def relation_upsert(relations: DataFrame) -> DataFrame:
    return sinks.keep_latest(relations.select("fact_a", "fact_b", "id", F.coalesce("final_verdict", F.lit("")).alias("final_verdict")), ["fact_a", "fact_b"], F.col("id"))


@query("select d.doc_id, d.filename, (select count(*) from facts f where f.doc_id = d.doc_id) as fact_count, coalesce(g.n, 0) as gap_count, coalesce(r.n, 0) as rejected_count from documents d "
       f"left join (select doc_id, count(*) as n from ({_GAPS}) group by 1) g on g.doc_id = d.doc_id left join (select f.doc_id, count(*) as n from ({_REJECTED}) x join facts f on f.id = x.fact_id group by 1) r on r.doc_id = d.doc_id")
def document_listing(documents: DataFrame, facts: DataFrame, blocks: DataFrame, evidence: DataFrame) -> DataFrame:
    rej = grounding.rejected(grounding.quoted_texts(evidence, blocks), facts).join(facts.select(F.col("id").alias("fact_id"), "doc_id"), "fact_id")
    return views.document_listing(documents, facts, ingest.page_gaps(documents, blocks), rej)


_ONE = "(select fact_id, min(id) as evidence_id, arg_min(coalesce(quote, chr(0)), id) as quote, min(id) as first_id from evidence where fact_id is not null group by 1)"
_QUOTE = "nullif(e.quote, chr(0))"


@query(f"select f.id, f.subject, f.metric, f.value_raw, d.filename, {_QUOTE} as quote from facts f join documents d on d.doc_id = f.doc_id left join {_ONE} e on e.fact_id = f.id "
       "where f.subject ilike '%margin%' or f.metric ilike '%margin%' or e.quote ilike '%margin%'")
def facts_search(facts: DataFrame, documents: DataFrame, evidence: DataFrame) -> DataFrame:
    return views.facts_search(facts, documents, evidence, q="margin", limit=None).select("id", "subject", "metric", "value_raw", "filename", "quote")


@query(f"select f.id, f.subject, f.metric, d.filename, e.evidence_id, {_QUOTE} as quote, cast(coalesce(r.n, 0) as int) as n_relations, r.ids as relation_ids from facts f join documents d on d.doc_id = f.doc_id "
       f"left join {_ONE} e on e.fact_id = f.id left join (select fact, count(distinct id) as n, string_agg(distinct id, ',' order by id) as ids from "
       "(select fact_a as fact, id from relations union select fact_b, id from relations) where fact is not null group by 1) r on r.fact = f.id")
def fact_detail(facts: DataFrame, documents: DataFrame, evidence: DataFrame, relations: DataFrame) -> DataFrame:
    d = views.fact_detail(facts, documents, evidence, relations)
    ids = F.array_join(F.transform("relations", lambda x: x["id"].cast("string")), ",")
    return d.select("id", "subject", "metric", "filename", F.col("evidence.id").alias("evidence_id"), F.col("evidence.quote").alias("quote"), F.size("relations").alias("n_relations"), F.nullif(ids, F.lit("")).alias("relation_ids"))


_SIDES = ", ".join(f"{p}.{c} as {p}_{n}" for p in "ab" for c, n in (("subject", "subject"), ("metric", "metric"), ("value_raw", "value"), ("unit_raw", "unit"), ("period_raw", "period")))


@query(f"select r.id, r.fact_a, r.fact_b, r.final_verdict, {_SIDES}, da.filename as a_doc, db.filename as b_doc from relations r join facts a on a.id = r.fact_a join facts b on b.id = r.fact_b "
       "join documents da on da.doc_id = a.doc_id join documents db on db.doc_id = b.doc_id where r.final_verdict = 'contradicts'")
def relations_listing(relations: DataFrame, facts: DataFrame, documents: DataFrame) -> DataFrame:
    return views.relations_listing(relations, facts, documents, "contradicts")


@query("select r.id, r.fact_a, r.fact_b, r.final_verdict, r.reason_code, cast(coalesce(len(json_keys(r.qualifier_diff)), 0) as int) as n_differs, a.value_raw as a_value_raw, a.canon_unit as a_canon_unit, b.value_raw as b_value_raw, "
       "b.canon_unit as b_canon_unit, a.subject as a_subject, a.metric as a_metric, da.filename as a_filename, nullif(ea.quote, chr(0)) as a_quote, b.subject as b_subject, b.metric as b_metric, db.filename as b_filename, nullif(eb.quote, chr(0)) as b_quote from relations r join facts a on a.id = r.fact_a join facts b on b.id = r.fact_b "
       f"join documents da on da.doc_id = a.doc_id join documents db on db.doc_id = b.doc_id left join {_ONE} ea on ea.fact_id = a.id left join {_ONE} eb on eb.fact_id = b.id")
def relation_detail(relations: DataFrame, facts: DataFrame, documents: DataFrame, evidence: DataFrame) -> DataFrame:
    d = views.relation_detail(relations, facts, documents, evidence)
    sides = [F.col(f"{p}.{c}").alias(f"{p}_{c.split('.')[-1]}") for p in "ab" for c in ("subject", "metric", "filename", "evidence.quote", "value_raw", "canon_unit")]
    return d.select("id", "fact_a", "fact_b", "final_verdict", "reason_code", F.size("qualifier_diff").alias("n_differs"), *sides)


@query(f"select (select count(*) from documents) as documents, (select count(*) from facts) as facts, (select count(period_start) from facts) as with_period, "
       f"(select count(page_no) from evidence) as grounded_facts, (select count(*) from relations) as relations, (select count(*) from ({_GAPS})) as gaps, (select count(*) from ({_REJECTED})) as rejected")
def stats(documents: DataFrame, facts: DataFrame, evidence: DataFrame, relations: DataFrame, blocks: DataFrame) -> DataFrame:
    rej = grounding.rejected(grounding.quoted_texts(evidence, blocks), facts)
    return views.stats(documents, facts, evidence, relations, ingest.page_gaps(documents, blocks), rej)


@query(f"select (select count(*) from ({_REJECTED}) where reason like '%not found%') as ungrounded, (select count(*) from ({_REJECTED}) where reason like '%no cached%') as unread, "
       "(select count(*) from relations where final_verdict = 'needs_review') as disputed, (select count(*) from relations where final_verdict = 'insufficient_context') as undecided")
def case_report(evidence: DataFrame, blocks: DataFrame, facts: DataFrame, relations: DataFrame) -> DataFrame:
    return views.case_report(relations, grounding.rejected(grounding.quoted_texts(evidence, blocks), facts))


@query("select id, k as name, json_extract_string(qualifier_diff, '$.\"' || k || '\".a') as a, json_extract_string(qualifier_diff, '$.\"' || k || '\".b') as b from "
       "(select id, qualifier_diff, unnest(json_keys(qualifier_diff)) as k from relations where qualifier_diff is not null)")
def relation_differences(relations: DataFrame) -> DataFrame:
    return views.decoded(relations).select("id", F.explode("qualifier_diff").alias("name", "d")).select("id", "name", "d.a", "d.b")


@query("select coalesce(final_verdict, 'unclassified') as verdict, count(*) as n from relations group by 1")
def verdict_counts(relations: DataFrame) -> DataFrame:
    return views.verdict_counts(relations)


@query(f"select case when reason like '%no cached%' then 'unread' else 'ungrounded' end as kind, count(*) as n from ({_REJECTED}) group by 1")
def rejected_kinds(evidence: DataFrame, blocks: DataFrame, facts: DataFrame) -> DataFrame:
    return views.rejected_kinds(grounding.rejected(grounding.quoted_texts(evidence, blocks), facts))


@query(f"select g.doc_id, g.page_no, g.reason, d.filename from ({_GAPS}) g join documents d on d.doc_id = g.doc_id")
def gaps_page(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    return views.gaps_page(ingest.page_gaps(documents, blocks), documents)


@query("with e as (select e.id as evidence_id, e.fact_id, f.doc_id, e.page_no, e.block_ids, " + _COLLAPSE.format("quote") + " as needle from evidence e join facts f on f.id = e.fact_id), "
       "p as (select doc_id, page_no, " + _COLLAPSE.format("string_agg(text, ' ' order by block_index, id)") + " as page_text from blocks group by 1, 2), "
       "n as (select evidence_id, " + _COLLAPSE.format("string_agg(t, ' ' order by bid)") + " as named_text from (select distinct x.evidence_id, x.bid, b.text as t from (select id as evidence_id, unnest(block_ids) as bid from evidence) x join blocks b on b.id = x.bid) group by 1) "
       "select e.fact_id, e.evidence_id, case when e.page_no is null then 'unplaced' when contains(page_text, needle) then 'checked' when contains(named_text, needle) then 'straddling' else 'failure' end as status "
       "from e left join p on p.doc_id = e.doc_id and p.page_no = e.page_no left join n on n.evidence_id = e.evidence_id")
def grounding_audit(evidence: DataFrame, blocks: DataFrame, facts: DataFrame) -> DataFrame:
    return grounding.audit(evidence, blocks, facts)


@query("with r as (select r.id, r.final_verdict, a.doc_id <> b.doc_id as is_cross, coalesce(r.confidence, 0) as confidence from relations r join facts a on a.id = r.fact_a join facts b on b.id = r.fact_b where r.final_verdict is not null), "
       "k as (select *, row_number() over (partition by final_verdict order by is_cross desc, confidence desc, id) as rank, bool_or(is_cross) over (partition by final_verdict) as any_cross from r) "
       "select final_verdict, cast(rank as int) as rank, id, is_cross, confidence from k where rank <= 3 and (is_cross or not any_cross)")
def four_cases(relations: DataFrame, facts: DataFrame) -> DataFrame:
    return views.four_cases(relations, facts, 3)


@query(f"select d.doc_id, cast(sum(coalesce(w.n, 0)) as bigint) as windows, cast(sum(coalesce(page_count, 0)) as bigint) as pages, cast(sum(coalesce(g.n, 0)) as bigint) as gaps, count(*) as documents, cast(sum(coalesce(w.n, 0)) + 2 as bigint) as calls "
       f"from documents d left join (select doc_id, count(*) as n from windows group by 1) w on w.doc_id = d.doc_id left join (select doc_id, count(*) as n from ({_GAPS}) group by 1) g on g.doc_id = d.doc_id group by rollup (d.doc_id)")
def dry_run_cost(windows: DataFrame, documents: DataFrame, blocks: DataFrame) -> DataFrame:
    return ingest.dry_run(windows, ingest.page_gaps(documents, blocks), documents)


@query(_blocks_of("(select sha256(text) as sha256, min(text) as text from documents where text is not null group by 1)", "sha256"))
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Documents run through the stream into a store of their own; the store's blocks by content."""
    store = Scratch(spark).folder
    docs = table(spark, d, "documents")
    arrivals.ingest_stream(spark, f"{d}/documents.parque[t]", docs.schema, store, f"{store}/progress").awaitTermination()
    keep = spark.read.parquet(f"{store}/documents").select("doc_id", "sha256")
    return spark.read.parquet(f"{store}/blocks").drop("epoch").join(keep, "doc_id").drop("doc_id")


@query("select id, replace(coalesce(final_verdict, 'unclassified'), '_', ' ') as verdict, printf('%.2f', round(confidence, 2)) as confidence from relations")
def display_relations(relations: DataFrame) -> DataFrame:
    return views.display(relations)


def _full(c: str) -> str:
    return f"nullif({_COLLAPSE.format(c)}, '')"


@query(f"select id, concat_ws(' | ', {_full('subject')}, {_full('metric')}, nullif(concat_ws(' ', {_full('value_raw')}, {_full('unit_raw')}), ''), 'period ' || {_full('period_raw')}, "
       "case when cardinality(qualifiers) > 0 then '{' || array_to_string(list_transform(list_sort(map_keys(qualifiers)), lambda k: '\"' || k || '\":\"' || map_extract(qualifiers, k)[1] || '\"'), ',') || '}' end) as summary from facts")
def fact_summaries(facts: DataFrame) -> DataFrame:
    return grounding.summary(facts)


def _cache(windows: DataFrame) -> DataFrame:
    """Responses for the windows: usable for the first of a document, broken for the second, none for later ones."""
    from ledgerloom.functions.text import cache_key

    one = lambda t: F.to_json(F.struct(F.array(F.struct(F.substring(t, 1, 20).alias("subject"), F.lit("length").alias("metric"), F.length(t).alias("value_raw"), F.substring(t, 1, 60).alias("evidence_quote"), F.lit(0.5).alias("confidence"))).alias("facts")))
    key = lambda t: cache_key(F.lit("model-b"), F.lit("extract-v1"), t)
    good = windows.where("window_index = 0").select(key(F.col("text")).alias("key"), one(F.col("text")).alias("response"))
    bad = windows.where("window_index = 1").select(key(F.col("text")).alias("key"), F.lit('{"facts": [{').alias("response"))
    parts = ingest.halves(windows.where("window_index = 1")).select(key(F.col("text")).alias("key"), F.concat(F.lit("Here: "), one(F.col("text"))).alias("response"))
    return good.unionByName(bad).unionByName(parts).groupBy("key").agg(F.max("response").alias("response"))


@query("with h as (select id, doc_id, text, block_spans[1:len(block_spans) // 2] as sp, 0 as half from windows where window_index = 1 and len(block_spans) >= 2 union all "
       "select id, doc_id, text, block_spans[len(block_spans) // 2 + 1:], 1 from windows where window_index = 1 and len(block_spans) >= 2) "
       "select doc_id, id as window_id, -1 as half, cast(length(text) as varchar) as value_raw from windows where window_index = 0 "
       "union all select doc_id, id, half, cast(sp[-1].e - sp[1].s as varchar) from h")
def extract_with_recovery(windows: DataFrame) -> DataFrame:
    done, _ = grounding.extract(windows, _cache(windows), ["model-a", "model-b"])
    return done.select("doc_id", "window_id", "half", "value_raw")


@query("select doc_id, id as window_id, case when window_index = 1 then 'unusable model output' else 'no cached response and no API key' end as reason from windows "
       "where window_index > 1 or (window_index = 1 and coalesce(len(block_spans), 0) < 2)")
def extract_rejected(windows: DataFrame) -> DataFrame:
    _, lost = grounding.extract(windows, _cache(windows), ["model-a", "model-b"])
    return lost.select("doc_id", "window_id", "reason")


@query(f"select d.doc_id, coalesce(f.n, 0) as facts, coalesce(f.dated, 0) as dated, round(100.0 * coalesce(f.dated, 0) / greatest(coalesce(f.n, 0), 1), 4) as percent_dated, coalesce(r.n, 0) as rejected, coalesce(g.n, 0) as gaps "
       f"from documents d left join (select doc_id, count(*) as n, count(period_start) as dated from facts group by 1) f on f.doc_id = d.doc_id left join (select f.doc_id, count(*) as n from ({_REJECTED}) x join facts f on f.id = x.fact_id group by 1) r on r.doc_id = d.doc_id "
       f"left join (select doc_id, count(*) as n from ({_GAPS}) group by 1) g on g.doc_id = d.doc_id")
def document_quality(documents: DataFrame, facts: DataFrame, blocks: DataFrame, evidence: DataFrame) -> DataFrame:
    rej = grounding.rejected(grounding.quoted_texts(evidence, blocks), facts).join(facts.select(F.col("id").alias("fact_id"), "doc_id"), "fact_id")
    return views.document_quality(documents, facts, rej, ingest.page_gaps(documents, blocks))


@query("select id, fact_a, fact_b, final_verdict from relations order by id desc limit 5")
def latest_relations(relations: DataFrame) -> DataFrame:
    return views.latest(relations.select("id", "fact_a", "fact_b", "final_verdict"), "id")


@query(f"select f.id, f.subject, d.filename, {_QUOTE} as quote from facts f join documents d on d.doc_id = f.doc_id left join {_ONE} e on e.fact_id = f.id order by f.id limit 200 offset 200")
def facts_page(facts: DataFrame, documents: DataFrame, evidence: DataFrame) -> DataFrame:
    return views.facts_search(facts, documents, evidence, offset=200).select("id", "subject", "filename", "quote")


@query(f"select f.id, f.subject, f.metric, d.filename, {_QUOTE} as quote from facts f join documents d on d.doc_id = f.doc_id left join {_ONE} e on e.fact_id = f.id "
       "where f.metric_id = 'operating_margin' and f.period_start = '2023-04-01'")
def facts_filtered(facts: DataFrame, documents: DataFrame, evidence: DataFrame) -> DataFrame:
    return views.facts_search(facts, documents, evidence, metric="operating_margin", period="2023-04-01", limit=None).select("id", "subject", "metric", "filename", "quote")


@query("select doc_id, filename, lang from documents where doc_id = (select min(doc_id) from documents where filename is not null)")
def document_lookup(documents: DataFrame) -> DataFrame:
    one = documents.where("filename is not null").agg(F.min("doc_id")).first()[0]
    return views.by_id(documents, "doc_id", one).select("doc_id", "filename", "lang")


@query(f"select evidence_id, x.doc_id, reason, d.filename from (select r.evidence_id, f.doc_id, r.reason from ({_REJECTED}) r join facts f on f.id = r.fact_id where r.reason like '%not found%' order by r.evidence_id limit 200) x "
       "join documents d on d.doc_id = x.doc_id")
def rejected_page(evidence: DataFrame, blocks: DataFrame, facts: DataFrame, documents: DataFrame) -> DataFrame:
    rej = grounding.rejected(grounding.quoted_texts(evidence, blocks), facts).join(facts.select(F.col("id").alias("fact_id"), "doc_id"), "fact_id")
    return views.rejected_page(rej, documents).select("evidence_id", "doc_id", "reason", "filename")


@query("select doc_id, coalesce(starts_with(text, '%PDF'), false) as is_pdf from documents")
def magic_bytes(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", texts.is_pdf(F.encode("text", "UTF-8")).alias("is_pdf"))


@query("select kind, raw, arg_max(canon_id, canon_id || chr(1) || coalesce(label, '')) as canon_id from canon_terms group by 1, 2")
def terms_loaded(canon_terms: DataFrame) -> DataFrame:
    return texts.load_if_empty(canon_terms.where("false"), canon_terms, ["kind", "raw"]).select("kind", "raw", "canon_id")


@query()
def files_found(spark: SparkSession, d: str) -> DataFrame:
    """Files of the data folder by name, with size and content hash."""
    return texts.discover(spark, d, "*.parquet").select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "length", "sha256")


def _write_cache(windows: DataFrame) -> DataFrame:
    """Responses with a claim twice, an invented quote and a nameless one; the second window of a document has a broken one and is read in halves."""
    from ledgerloom.functions.text import cache_key

    def reply(t):
        fact = lambda subject, metric, quote, confidence: F.struct(subject.alias("subject"), F.lit(metric).alias("metric"), F.length(t).alias("value_raw"), quote.alias("evidence_quote"), F.lit(confidence).alias("confidence"))
        name, quote = F.substring(t, 1, 20), F.substring(t, 1, 60)
        return F.to_json(F.struct(F.array(fact(name, "length", quote, 0.5), fact(name, "Length ", quote, 0.9), fact(name, "length", F.lit("no such quote at all"), 0.9), fact(F.lit(""), "length", quote, 0.9)).alias("facts")))

    key = lambda t: cache_key(F.lit("model-b"), F.lit("extract-v1"), t)
    text = F.col("text")
    good = windows.where("window_index = 0").select(key(text).alias("key"), reply(text).alias("response"))
    bad = windows.where("window_index = 1").select(key(text).alias("key"), F.lit("{broken").alias("response"))
    parts = ingest.halves(windows.where("window_index = 1")).select(key(text).alias("key"), reply(text).alias("response"))
    return good.unionByName(bad).unionByName(parts).groupBy("key").agg(F.max("response").alias("response"))


_READ = """
h as (
  select id, doc_id, window_index, density, -1 as half, text, block_ids, block_spans from windows where window_index = 0
  union all
  select id, doc_id, window_index, density, half, substring(text, sp[1].s + 1, sp[-1].e - sp[1].s), ids, list_transform(sp, lambda x: struct_pack(s := x.s - sp[1].s, e := x.e - sp[1].s)) from (
    select *, 0 as half, block_spans[1:len(block_spans) // 2] as sp, block_ids[1:len(block_spans) // 2] as ids from windows where window_index = 1 and len(block_spans) >= 2
    union all
    select *, 1, block_spans[len(block_spans) // 2 + 1:], block_ids[len(block_spans) // 2 + 1:] from windows where window_index = 1 and len(block_spans) >= 2)
),
c as (select *, substring(text, 1, 20) as subject, substring(text, 1, 60) as quote, cast(length(text) as varchar) as value_raw from h),
d as (
  select *, row_number() over (partition by doc_id, lower(trim(subject)), value_raw, lower(""" + _COLLAPSE.format("quote") + """) order by density desc, window_index, half) as r from c
),
f as (select *, (doc_id << 28) + row_number() over (partition by doc_id order by density desc, window_index, half) - 1 as fact_id from d where r = 1)
"""


@query(f"with {_READ} select fact_id as id, doc_id, subject, 'Length ' as metric, value_raw, cast(0.9 as double) as confidence from f")
def facts_written(windows: DataFrame, blocks: DataFrame, canon_terms: DataFrame) -> DataFrame:
    out = ingest_run.read_windows(windows, blocks, _write_cache(windows), ["model-a", "model-b"], canon_terms)
    return out["facts"].select("id", "doc_id", "subject", "metric", "value_raw", "confidence")


@query(f"""with {_READ},
e as (select fact_id, quote, list_transform(list_filter(range(1, len(coalesce(block_spans, [])) + 1), lambda i: block_spans[i].s < length(quote) and block_spans[i].e > 0), lambda i: block_ids[i]) as ids from f),
j as (select e.fact_id, b.* from (select fact_id, unnest(ids) as bid from e) e join blocks b on b.id = e.bid),
p as (select fact_id, arg_min(page_no, id) as page_no from j group by 1),
x as (select j.fact_id, p.page_no, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from j join p on p.fact_id = j.fact_id and p.page_no = j.page_no group by 1, 2)
select e.fact_id, quote, x.page_no, 0 as char_start, cast(length(quote) as int) as char_end, array_to_string(ids, ',') as block_ids, x0, y0, x1, y1 from e left join x on x.fact_id = e.fact_id""")
def evidence_written(windows: DataFrame, blocks: DataFrame, canon_terms: DataFrame) -> DataFrame:
    out = ingest_run.read_windows(windows, blocks, _write_cache(windows), ["model-a", "model-b"], canon_terms)
    return out["evidence"].withColumn("block_ids", F.array_join(F.transform("block_ids", lambda x: x.cast("string")), ","))


@query(f"""with {_READ}
select doc_id, reason, count(*) as n from (
  select doc_id, 'evidence_quote not found in source window' as reason from c union all select doc_id, 'missing subject or metric' from c
  union all select doc_id, 'no cached response and no API key' from windows where window_index > 1
  union all select doc_id, 'unusable model output' from windows where window_index = 1 and coalesce(len(block_spans), 0) < 2) group by 1, 2""")
def rejected_written(windows: DataFrame, blocks: DataFrame, canon_terms: DataFrame) -> DataFrame:
    out = ingest_run.read_windows(windows, blocks, _write_cache(windows), ["model-a", "model-b"], canon_terms)
    return out["rejected"].groupBy("doc_id", "reason").agg(F.count("*").alias("n"))


@query("select kind, raw, canon_id, case when canon_id like 'c%' then upper(label) else label end as label from canon_terms")
def terms_upserted(canon_terms: DataFrame) -> DataFrame:
    new = canon_terms.where("canon_id like 'c%'").withColumn("label", F.upper("label"))
    return sinks.upsert(canon_terms, new, ["kind", "raw"]).select("kind", "raw", "canon_id", "label")


@query("select sha256('model-b' || chr(0) || 'extract-v1' || chr(0) || text) as key, max(case when window_index = 1 then 'second' else 'first' end) as response from windows where window_index < 2 group by 1")
def cache_upserted(windows: DataFrame) -> DataFrame:
    from ledgerloom.functions.text import cache_key

    key = cache_key(F.lit("model-b"), F.lit("extract-v1"), F.col("text")).alias("key")
    old = windows.where("window_index < 2").select(key, F.lit("first").alias("response")).distinct()
    again = windows.where("window_index = 1").select(key, F.lit("second").alias("response"), "id")
    return sinks.upsert(old, sinks.keep_latest(again, ["key"], F.col("id")).drop("id"), ["key"])


_GONE = "(select doc_id from documents where not ingest_complete)"
_GONE_FACTS = f"(select id from facts where doc_id in {_GONE})"


@query(f"""
select 'facts' as name, count(*) as n from facts where doc_id is null or doc_id not in {_GONE} union all
select 'evidence', count(*) from evidence where fact_id is null or fact_id not in {_GONE_FACTS} union all
select 'relations', count(*) from relations where coalesce(fact_a not in {_GONE_FACTS}, true) and coalesce(fact_b not in {_GONE_FACTS}, true) union all
select 'blocks', count(*) from blocks where doc_id is null or doc_id not in {_GONE} union all
select 'gaps', count(*) from ({_GAPS}) where doc_id not in {_GONE}""")
def documents_cleared(documents: DataFrame, facts: DataFrame, evidence: DataFrame, relations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows left in each table after the documents that are not complete are cleared."""
    left = sinks.cascade_delete(documents.where("not ingest_complete").select("doc_id"), facts, evidence, relations, blocks, ingest.page_gaps(documents, blocks))
    n = [v.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, v in left.items()]
    out = n[0]
    for x in n[1:]:
        out = out.unionByName(x)
    return out

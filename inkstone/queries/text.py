"""Queries of sections B and H: projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import names as N
from inkstone.queries.bindings import bind
from inkstone.queries.registry import query

RULES = [("AND", "(?i)\\band\\b"), ("DER", "(?i)\\bder\\b"), ("LES", "(?i)\\bles\\b"), ("LIC", "(?i)licen[sc]e")]
_FIRST = "case when regexp_matches(original, '(?i)\\band\\b') then 'AND' when regexp_matches(original, '(?i)\\bder\\b') then 'DER' when regexp_matches(original, '(?i)\\bles\\b') then 'LES' when regexp_matches(original, '(?i)licen[sc]e') then 'LIC' else 'GEN' end"
_BUCKET = "case when length(original) <= 300 then 'short' when length(original) <= 1500 then 'mid' when length(original) <= 4000 then 'long' else 'xlong' end"


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return bind(spark, sf, "corpus")


@query("b2_status_filter", "select id, status from job where status in ('SUCCEEDED', 'DEAD')", "job")
def b2(spark, sf):
    return bind(spark, sf, "job").where(F.col("status").isin("SUCCEEDED", "DEAD")).select("id", "status")


def optional_predicates(jobs: DataFrame, batch: str | None = None, prompt_version: str | None = None, model: str | None = None) -> DataFrame:
    """Add only the predicates that are given; fake models never count, a missing model does."""
    out = jobs.where(F.col("model_used").isNull() | ~F.col("model_used").like("fake-%"))
    for column, value in (("batch_id", batch), ("prompt_version", prompt_version), ("model_used", model)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


@query("b3_optional_predicates", "select id, batch_id from job where (model_used is null or model_used not like 'fake-%') and prompt_version = 'v1'", "job")
def b3(spark, sf):
    return optional_predicates(bind(spark, sf, "job"), prompt_version="v1").select("id", "batch_id")


@query("b4_membership_filter", "select id from job where normalized_hash in (select cast(c_custkey as varchar) from customer where c_mktsegment = 'BUILDING')", "job")
def b4(spark, sf):
    keys = bind(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("normalized_hash"))
    return bind(spark, sf, "job").join(keys, "normalized_hash", "left_semi").select("id")


@query("b5_any_pattern", "select seq, regexp_matches(original, '(?i)\\band\\b|\\bder\\b|\\bles\\b') as formulaic from corpus", "corpus")
def b5(spark, sf):
    return _corpus(spark, sf).select("seq", T.matches(F.col("original"), "(?i)\\band\\b|\\bder\\b|\\bles\\b").alias("formulaic"))


@query("b6_first_pattern_label", f"select seq, {_FIRST} as label from corpus", "corpus")
def b6(spark, sf):
    return _corpus(spark, sf).select("seq", T.first_label(F.col("original"), RULES, "GEN").alias("label"))


@query(
    "b7_all_matching_phrases",
    r"""select seq, concat_ws(',', case when regexp_matches(original, '(?i)\band\b') then 'AND' end, case when regexp_matches(original, '(?i)\bder\b') then 'DER' end,
    case when regexp_matches(original, '(?i)\bles\b') then 'LES' end, case when regexp_matches(original, '(?i)licen[sc]e') then 'LIC' end) as labels from corpus""",
    "corpus",
)
def b7(spark, sf):
    return _corpus(spark, sf).select("seq", F.array_join(T.all_labels(F.col("original"), RULES), ",").alias("labels"))


@query("b8_length_bucket", f"select seq, {_BUCKET} as bucket from corpus", "corpus")
def b8(spark, sf):
    return _corpus(spark, sf).select("seq", T.length_bucket(F.col("original"), (300, 1500, 4000), ("short", "mid", "long", "xlong")).alias("bucket"))


@query("b9_stratum_key", f"select seq, {_FIRST} || ' / ' || {_BUCKET} as stratum from corpus", "corpus")
def b9(spark, sf):
    text = F.col("original")
    return _corpus(spark, sf).select("seq", F.concat_ws(" / ", T.first_label(text, RULES, "GEN"), T.length_bucket(text, (300, 1500, 4000), ("short", "mid", "long", "xlong"))).alias("stratum"))


def slice_without(corpus: DataFrame, held_out: DataFrame, excluded: DataFrame, dates: tuple[str, ...] = ()) -> DataFrame:
    """Rows outside the evaluation ids and their dates and outside the excluded ids, optionally of some dates."""
    out = corpus.where(F.col("date").isin(*dates)) if dates else corpus
    return out.join(held_out.select("id"), "id", "left_anti").join(held_out.select("date").distinct(), "date", "left_anti").join(excluded.select("id"), "id", "left_anti")


@query(
    "b10_leakage_slice",
    """select seq from corpus where id not in (select id from corpus where seq % 97 = 0) and date not in (select date from corpus where seq % 97 = 0)
    and id not in (select id from corpus where seq % 5 = 0)""",
    "corpus",
)
def b10(spark, sf):
    c = _corpus(spark, sf)
    return slice_without(c, c.where("seq % 97 = 0"), c.where("seq % 5 = 0")).select("seq")


def assert_no_leak(chosen: DataFrame, held_out: DataFrame) -> DataFrame:
    """The number of chosen rows that are held out; an action on it fails unless that is 0."""
    n = chosen.join(held_out.select("id"), "id", "left_semi").agg(F.count("*").alias("n_leaked"))
    return n.select(F.when(F.assert_true(F.col("n_leaked") == 0, "held-out rows in the slice").isNull(), F.col("n_leaked")).alias("n_leaked"))


@query("b11_no_leak_assertion", "select cast(0 as bigint) as n_leaked")
def b11(spark, sf):
    c = _corpus(spark, sf)
    held = c.where("seq % 97 = 0")
    return assert_no_leak(slice_without(c, held, c.where("seq % 5 = 0")), held)


def is_bad(hypothesis, reference, original):
    """A hypothesis that is missing, failed, mostly of the wrong script or too short."""
    upper, lower = T.count_class(hypothesis, "A-Z"), T.count_class(hypothesis, "a-z")
    short = (F.length(hypothesis) < 0.3 * F.length(reference)) | (F.length(hypothesis) < 0.3 * F.length(original))
    return hypothesis.isNull() | hypothesis.contains("FAILED") | ((upper > 0.3 * lower) & (upper > 3)) | short


@query(
    "b12_bad_hypothesis",
    """select seq, (translation is null or contains(translation, 'FAILED') or (length(regexp_replace(translation, '[^A-Z]', '', 'g')) > 0.3 * length(regexp_replace(translation, '[^a-z]', '', 'g'))
    and length(regexp_replace(translation, '[^A-Z]', '', 'g')) > 3) or length(translation) < 0.3 * length(original)) as bad from pairs""",
    "pairs",
)
def b12(spark, sf):
    return bind(spark, sf, "pairs").select("seq", is_bad(F.col("translation"), F.col("original"), F.col("original")).alias("bad"))


#: Labels of weak outputs, not exclusive: name and condition.
WEAK = [
    ("empty", "length(translation) < 20"),
    ("short", "length(translation) < 0.5 * length(original)"),
    ("long", "length(translation) > 3 * length(original)"),
    ("shouting", "length(regexp_replace(translation, '[^A-Z]', '')) > 0.3 * length(translation)"),
    ("symbols", "translation rlike '[*$%&]{3}'"),
    ("echo", "translation = original"),
]


@query(
    "b13_weak_output_labels",
    """select seq, label from (select seq, unnest(case when len(labels) = 0 then ['other'] else labels end) as label from (select seq, list_filter([case when length(translation) < 20 then 'empty' end,
    case when length(translation) < 0.5 * length(original) then 'short' end, case when length(translation) > 3 * length(original) then 'long' end,
    case when length(regexp_replace(translation, '[^A-Z]', '', 'g')) > 0.3 * length(translation) then 'shouting' end,
    case when regexp_matches(translation, '[*$%&]{3}') then 'symbols' end, case when translation = original then 'echo' end], lambda x: x is not null) as labels from pairs))""",
    "pairs",
)
def b13(spark, sf):
    labels = F.filter(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in WEAK]), lambda x: x.isNotNull())
    return bind(spark, sf, "pairs").select("seq", F.explode(F.when(F.size(labels) == 0, F.array(F.lit("other"))).otherwise(labels)).alias("label"))


@query("b17_ownership_filter", "select id, case when tenant_id = '3' then status end as status, tenant_id = '3' as found from job", "job")
def b17(spark, sf):
    mine = F.col("tenant_id") == "3"
    return bind(spark, sf, "job").select("id", F.when(mine, F.col("status")).alias("status"), mine.alias("found"))


@query("b18_sample_quality_filter", "select seq from pairs where length(translation) between 20 and 150 and length(regexp_replace(translation, '[^A-Z]', '', 'g')) / length(translation) < 0.1", "pairs")
def b18(spark, sf):
    t = F.col("translation")
    return bind(spark, sf, "pairs").where(F.length(t).between(20, 150) & (F.try_divide(T.count_class(t, "A-Z"), F.length(t)) < 0.1)).select("seq")


@query("h1_normalized_hash", r"select seq, sha256(regexp_replace(nfc_normalize(original), '[ \t\n\x0B\f\r]+', '', 'g')) as normalized_hash from corpus", "corpus")
def h1(spark, sf):
    return _corpus(spark, sf).select("seq", T.normalized_hash(F.col("original")).alias("normalized_hash"))


@query("h2_checksum8", "select seq, substring(sha256(id || date), 1, 8) as version from corpus", "corpus")
def h2(spark, sf):
    return _corpus(spark, sf).select("seq", T.checksum8(F.col("id"), F.col("date")).alias("version"))


@query("h3_sequential_replace", "select seq, replace(replace(replace(original, 'the', '<1>'), 'in', '<2>'), '<1>a', '<3>') as replaced from corpus", "corpus")
def h3(spark, sf):
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("the", "<1>"), ("in", "<2>"), ("<1>a", "<3>"))])
    return _corpus(spark, sf).select("seq", T.replace_in_order(F.col("original"), pairs).alias("replaced"))


@query("h4_position_functions", "select seq, contains(original, 'tion') as has, instr(original, 'tion') as hit, substring(original, 3, 4) = 'tion' as third from corpus", "corpus")
def h4(spark, sf):
    t = F.col("original")
    return _corpus(spark, sf).select("seq", t.contains("tion").alias("has"), F.instr(t, "tion").cast("bigint").alias("hit"), (F.substring(t, 3, 4) == "tion").alias("third"))


_OFFICE = "o_orderpriority || ' (' || o_orderstatus || ') (x)'"


@query("h5_strip_parens", f"select o_orderkey, trim(regexp_replace({_OFFICE}, '\\(.*?\\)', '', 'g')) as office from orders")
def h5(spark, sf):
    return bind(spark, sf, "orders").select("o_orderkey", T.strip_parens(F.expr(_OFFICE)).alias("office"))


@query("h6_first_paren", "select o_orderkey, case when trim(regexp_extract(o, '\\((.*?)\\)', 1)) <> '' then regexp_extract(o, '\\((.*?)\\)', 1) end as hanja from (select o_orderkey, case when o_orderkey % 3 = 0 then o_orderpriority when o_orderkey % 3 = 1 then '( ) (y)' else o_orderpriority || ' (' || o_orderstatus || ') (x)' end as o from orders)")
def h6(spark, sf):
    office = F.expr("case when o_orderkey % 3 = 0 then o_orderpriority when o_orderkey % 3 = 1 then '( ) (y)' else o_orderpriority || ' (' || o_orderstatus || ') (x)' end")
    return bind(spark, sf, "orders").select("o_orderkey", T.first_paren(office).alias("hanja"))


@query(
    "h7_hypothesis_cleaner",
    r"""select seq, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('<thought>x' || chr(10) || 'y</thought> ○ ' || original || '○(漢字)', '(?s)<thought>.*?</thought>', '', 'g'),
    '^[ \t\n\x0B\f\r]*○[ \t\n\x0B\f\r]*', ''), '○', ' ', 'g'), '\([一-鿿]+\)', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) as cleaned from corpus""",
    "corpus",
)
def h7(spark, sf):
    return _corpus(spark, sf).select("seq", T.clean_hypothesis(F.concat(F.lit("<thought>x\ny</thought> ○ "), "original", F.lit("○(漢字)"))).alias("cleaned"))


@query("h8_outer_json", "select event_id, cast(json_extract_string(regexp_extract('```json' || chr(10) || props || ' ```', '(?s)\\{.*\\}'), '$.k') as bigint) as k from events")
def h8(spark, sf):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit(" ```"))
    return bind(spark, sf, "events").select("event_id", F.from_json(T.outer_json(fenced), "k bigint")["k"].alias("k"))


@query("h9_script_ratio", "select seq, length(regexp_replace(original, '[^a-z]', '', 'g')) as n_lower, length(regexp_replace(original, '[^À-ÿ]', '', 'g')) / nullif(length(original), 0) as share from corpus", "corpus")
def h9(spark, sf):
    t = F.col("original")
    return _corpus(spark, sf).select("seq", T.count_class(t, "a-z").cast("bigint").alias("n_lower"), F.try_divide(T.count_class(t, "À-ÿ"), F.length(t)).alias("share"))


@query("h10_final_consonant", "select n_nationkey, (unicode(right(w, 1)) - 44032) % 28 <> 0 and unicode(right(w, 1)) between 44032 and 55203 as closed from (select n_nationkey, n_name || chr(cast(44032 + n_nationkey * 7 as int)) as w from nation)")
def h10(spark, sf):
    word = F.concat("n_name", T.syllable((F.lit(44032) + F.col("n_nationkey") * 7).cast("bigint")))
    return bind(spark, sf, "nation").select("n_nationkey", T.has_final_consonant(word).alias("closed"))


@query("h14_span_normaliser", "select seq, case when length(s) between 2 and 4 then s else right(s, 3) end as span from (select seq, regexp_replace(regexp_replace(original, '[^A-Z]', '', 'g'), '^TH', '') as s from corpus)", "corpus")
def h14(spark, sf):
    s = F.regexp_replace(F.regexp_replace("original", "[^A-Z]", ""), "^TH", "")
    return _corpus(spark, sf).select("seq", F.when(F.length(s).between(2, 4), s).otherwise(F.right(s, F.lit(3))).alias("span"))


@query("h16_name_tokens", "with w as (select distinct seq, unnest(regexp_extract_all(original, '[A-Z][a-z]+')) as word from corpus) select distinct seq, n, substring(word, 1, n) as token from w, (select unnest([1, 4, 5]) as n) where n >= 2 and length(word) >= n and (length(word) = n or (regexp_matches(substring(word, n + 1), '^(s|ed|ing)') and substring(word, 1, n + 1) not in (select upper(substring(n_name, 1, 1)) || lower(substring(n_name, 2, 4)) from nation union all select distinct word from w where length(word) = 5)))", "corpus")
def h16(spark, sf):
    """Tokens of four and five letters; a word of five letters is a longer known name, and names of one letter give none."""
    rows = _corpus(spark, sf).select("seq", F.col("original").alias("translation"))
    five = rows.select(F.explode(F.regexp_extract_all("translation", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("name")).where("length(name) = 5").distinct()
    nations = bind(spark, sf, "nation").select(F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.substring("n_name", 2, 4))).alias("name"))
    return N.name_tokens(rows, (1, 4, 5), five.unionAll(nations), run="[A-Z][a-z]+", particles=("s", "ed", "ing"))


@query(
    "h17_snippet",
    r"""select seq, case when place > 0 then case when length(cut) > 100 then substring(cut, 1, 100) || '…' else cut end end as snippet
    from (select seq, place, trim(substring(original, greatest(place - 15, 1), least(place - 1, 15) + 4 + 80)) as cut from (select seq, original, instr(original, 'tion') as place from corpus))""",
    "corpus",
)
def h17(spark, sf):
    return _corpus(spark, sf).select("seq", T.snippet(F.col("original"), F.lit("tion")).alias("snippet"))


_MESSAGE = "case event_id % 11 when 0 then 'Could not parse JSON' when 1 then 'HTTP 429 quota per day' when 2 then '429 RESOURCE_EXHAUSTED: spending cap' when 3 then 'got 429, retry in 3.5s' when 4 then '401 bad api key' when 5 then 'model NOT_FOUND' when 6 then '503 service' when 7 then 'request timed out' when 8 then 'SAFETY stop' when 9 then 'code 14290 odd' else 'NER service down' end"


@query(
    "h19_error_classes",
    f"""select event_id, case when regexp_matches(m, 'parse|json|deserial') then 'PARSE' when regexp_matches(m, 'ner (service|server|unavailable)') then 'NER_UNAVAILABLE'
    when regexp_matches(m, '(\\b429\\b|resource_exhausted).*spending cap') then 'SPEND_CAP' when regexp_matches(m, '(\\b429\\b|resource_exhausted).*per ?day') then 'QUOTA_DAILY'
    when regexp_matches(m, '\\b429\\b|resource_exhausted') then 'RATE_LIMIT' when regexp_matches(m, '\\b401\\b|\\b403\\b|api key|permission') then 'AUTH' when regexp_matches(m, '\\b404\\b|not_found') then 'MODEL_NOT_FOUND'
    when regexp_matches(m, '\\b503\\b|unavailable|\\b500\\b|internal') then 'UNAVAILABLE' when regexp_matches(m, 'time ?d? ?out') then 'TIMEOUT' when regexp_matches(m, 'safety|blocked') then 'SAFETY' else 'UNKNOWN' end as error_class
    from (select event_id, lower({_MESSAGE}) as m from events)""",
)
def h19(spark, sf):
    return bind(spark, sf, "events").select("event_id", T.classify_error(F.expr(_MESSAGE)).alias("error_class"))


@query("h20_retry_hint", f"select event_id, case when ms > 300000 then 300000 else ms end as wait_ms from (select event_id, cast(round(try_cast(nullif(regexp_extract(lower({_MESSAGE}), 'retry in ([0-9.]+) ?s', 1), '') as double) * 1000) as bigint) as ms from events)")
def h20(spark, sf):
    return bind(spark, sf, "events").select("event_id", T.retry_hint_ms(F.expr(_MESSAGE)).alias("wait_ms"))


#: HTTP status, code and retry-after seconds of an error class.
HTTP = {"RATE_LIMIT": (429, "rate_limited"), "QUOTA_DAILY": (429, "quota_exhausted"), "SPEND_CAP": (402, "spend_cap"), "AUTH": (502, "upstream_auth"), "TIMEOUT": (504, "upstream_timeout"), "UNAVAILABLE": (503, "upstream_unavailable")}


@query(
    "h21_http_status",
    "select status, error, case e when 'RATE_LIMIT' then 429 when 'QUOTA_DAILY' then 429 when 'SPEND_CAP' then 402 when 'AUTH' then case when own then 401 else 502 end when 'TIMEOUT' then 504 when 'UNAVAILABLE' then 503 else 500 end as http, case when e = 'RATE_LIMIT' then cast(ceil(seq % 7000 / 1000.0) as bigint) end as retry_after_s, seq from (select seq, status, status as error, seq % 2 = 0 as own, case seq % 7 when 0 then 'RATE_LIMIT' when 1 then 'QUOTA_DAILY' when 2 then 'SPEND_CAP' when 3 then 'AUTH' when 4 then 'TIMEOUT' when 5 then 'UNAVAILABLE' else 'UNKNOWN' end as e from job)",
    "job",
)
def h21(spark, sf):
    e = F.element_at(F.array(*map(F.lit, ("RATE_LIMIT", "QUOTA_DAILY", "SPEND_CAP", "AUTH", "TIMEOUT", "UNAVAILABLE", "UNKNOWN"))), (F.col("seq") % 7 + 1).cast("int"))
    http = F.lit(500)
    for name, (status, _) in HTTP.items():
        http = F.when(F.col("e") == name, F.when((F.col("e") == "AUTH") & (F.col("seq") % 2 == 0), F.lit(401)).otherwise(F.lit(status))).otherwise(http)
    wait = F.when(F.col("e") == "RATE_LIMIT", F.ceil((F.col("seq") % 7000) / 1000).cast("bigint"))
    return bind(spark, sf, "job").withColumn("e", e).select("seq", "status", F.col("status").alias("error"), http.alias("http"), wait.alias("retry_after_s"))


@query("h24_token_estimate", "select seq, cast(ceil(length(original) * 0.65::double) as bigint) as tokens from corpus", "corpus")
def h24(spark, sf):
    return _corpus(spark, sf).select("seq", T.token_estimate(F.col("original")).alias("tokens"))


@query("h25_brief_error", "select seq, substring(regexp_replace('api_key=abc' || cast(seq as varchar) || ' ' || original, '(?i)(api[_-]?key|token|secret)([ \\t\\n\\x0B\\f\\r]*[=:][ \\t\\n\\x0B\\f\\r]*)[^ \\t\\n\\x0B\\f\\r]+', '\\1\\2***', 'g'), 1, 200) as message from corpus", "corpus")
def h25(spark, sf):
    return _corpus(spark, sf).select("seq", T.brief(F.concat(F.lit("api_key=abc"), F.col("seq").cast("string"), F.lit(" "), "original")).alias("message"))


@query(
    "h26_features",
    r"""select seq, least(length(original) / 350.0::double, 1.0) as f_length, cast(regexp_matches(original, '\band\b') as int) as f_and, cast(regexp_matches(original, '\bder\b') as int) as f_der,
    len(regexp_extract_all(original, '[.]')) / greatest(length(original), 1) as f_stops, len(list_distinct(string_split(original, ''))) / greatest(length(original), 1) as f_distinct from corpus where length(original) > 0""",
    "corpus",
)
def h26(spark, sf):
    t, n = F.col("original"), F.greatest(F.length("original"), F.lit(1))
    return _corpus(spark, sf).where(F.length("original") > 0).select(
        "seq",
        F.least(F.length(t) / 350.0, F.lit(1.0)).alias("f_length"),
        t.rlike(r"\band\b").cast("int").alias("f_and"),
        t.rlike(r"\bder\b").cast("int").alias("f_der"),
        (T.count_class(t, ".") / n).alias("f_stops"),
        (F.size(F.array_distinct(F.split(t, ""))) / n).alias("f_distinct"),
    )


@query("h28_name_without_surname", "select c_custkey, case when length(c_name) >= 3 then substring(c_name, 2) end as given from customer")
def h28(spark, sf):
    return bind(spark, sf, "customer").select("c_custkey", T.without_surname(F.col("c_name")).alias("given"))


@query("h29_catalogue_year", "select seq, case when substring(i, 5, 1) = 'A' then try_cast(substring(i, 6, 2) as int) + 1622 end as year from (select seq, case when seq % 9 = 0 then 'DIA-B12' when seq % 10 = 0 then 'DIA-Axy' else id end as i from corpus)", "corpus")
def h29(spark, sf):
    i = F.when(F.col("seq") % 9 == 0, F.lit("DIA-B12")).when(F.col("seq") % 10 == 0, F.lit("DIA-Axy")).otherwise(F.col("id"))
    return _corpus(spark, sf).select("seq", T.catalogue_year(i).alias("year"))


@query("h30_daily_bucket", "select tenant_id, model, cast(ts as date) as day, count(*) as calls from rate_event group by all", "rate_event")
def h30(spark, sf):
    return bind(spark, sf, "rate_event").groupBy("tenant_id", "model", F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"))


@query("h39_latency_total", "select event_id, cast(list_sum(map_values(map {'ner': event_id % 30, 'link': event_id % 3, 'llm': event_id % 5000})) as bigint) as total_ms from events")
def h39(spark, sf):
    stages = F.create_map(*[x for n, m in (("ner", 30), ("link", 3), ("llm", 5000)) for x in (F.lit(n), F.col("event_id") % m)])
    return bind(spark, sf, "events").select("event_id", F.aggregate(F.map_values(stages), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total_ms"))


@query("h40_json_access", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def h40(spark, sf):
    return bind(spark, sf, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("a21_chunked_output", "select seq, i, substring(original, cast((i - 1) * 6 + 1 as bigint), 6) as chunk from corpus, unnest(range(1, cast(ceil(length(original) / 6.0) as bigint) + 1)) t(i)", "corpus")
def a21(spark, sf):
    out = _corpus(spark, sf).select("seq", F.posexplode(T.chunks(F.col("original"))).alias("i", "chunk"))
    return out.select("seq", (F.col("i") + 1).cast("bigint").alias("i"), "chunk")

"""Queries of the stateful operators, the remaining sources and the name operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import names as N
from inkstone.queries import kb as K
from inkstone.queries.bindings import bind
from inkstone.queries.registry import query
from inkstone.session import shared_folder
from inkstone.sources import readers
from inkstone.streaming import jobs as J
from inkstone.streaming import limiters as L


def scratch(spark) -> str:
    """A new folder in the shared storage that the session names."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


def rate_events(spark, sf):
    op = F.when(F.col("event_type") == "error", "throttle").when(F.col("event_type") == "purchase", "success").otherwise("acquire")
    e = bind(spark, sf, "rate_event")
    return e.select("event_id", F.concat("tenant_id", F.lit(":"), "model").alias("bucket"), op.alias("op"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.when(F.col("event_id") % 6 == 0, F.lit(90_000)).when(F.col("event_id") % 6 == 3, F.lit(-5_000)).cast("bigint").alias("hint_ms"))


# the sequential machine itself: one step an event in every bucket; a null rate or time is a bucket not yet met
_EVENTS = """ev as materialized (select *, row_number() over (partition by bucket order by ts_ms, event_id) as k from (select event_id, tenant_id || ':' || model as bucket, case event_type when 'error' then 'throttle' when 'purchase' then 'success' else 'acquire' end as op,
    epoch_us(ts) // 1000 as ts_ms, case event_id % 6 when 0 then 90000 when 3 then -5000 end as hint from rate_event))"""
_BUCKET = f"""with {_EVENTS},
b as (with recursive s as (select distinct bucket, 0::bigint as k, null::double as rpm, null::double as tokens, null::bigint as at_ms, 0::bigint as until, 0 as streak, null::bigint as event_id, false as granted, 0::bigint as wait_ms from ev
    union all select bucket, k, case op when 'throttle' then cut when 'success' then case when streak + 1 >= 5 then least(60.0::double, rate + 1) else rate end else rate end,
        case when op = 'throttle' then 0 when op = 'success' then tokens when given then held - 1 else held end, case op when 'throttle' then block when 'success' then at_ms else greatest(since, ts_ms) end, case when op = 'throttle' then block else until end,
        case op when 'throttle' then 0 when 'success' then case when streak + 1 >= 5 then 0 else streak + 1 end else streak end, event_id, given,
        case when op <> 'acquire' or given then 0 when ts_ms < until then until - ts_ms else cast(ceil((1 - held) * 60000 / rate - 1e-9::double) as bigint) end
    from (select *, op = 'acquire' and ts_ms >= until and held >= 1 as given, ts_ms + case when hint > 0 then hint else cast(ceil(60000 / cut) as bigint) end as block
      from (select *, case when tokens is null then room when gained > 0 then least(room, tokens + gained) else tokens end as held
        from (select *, greatest(2.0::double, floor(rate * 0.5::double)) as cut, greatest(1.0::double, rate * 10 / 60) as room, greatest(0, ts_ms - since) * rate / 60000 as gained
          from (select s.bucket, e.k, e.event_id, e.op, e.ts_ms, e.hint, s.tokens, s.at_ms, s.until, s.streak, coalesce(s.at_ms, e.ts_ms) as since, least(60.0::double, greatest(2.0::double, coalesce(s.rpm, 20.0::double))) as rate
            from s join ev e on e.bucket = s.bucket and e.k = s.k + 1)))))
    select * from s where event_id is not null)"""


@query("i4_token_bucket", f"{_BUCKET} select event_id, granted, wait_ms from b", "rate_event")
def i4(spark, sf):
    return L.token_bucket(rate_events(spark, sf)).select("event_id", "granted", "wait_ms")


@query("i5_aimd_feedback", f"{_BUCKET} select event_id, rpm, streak from b", "rate_event")
def i5(spark, sf):
    return L.token_bucket(rate_events(spark, sf)).select("event_id", "rpm", "streak")


@query(
    "i6_measured_bounds",
    f"""with {_EVENTS}, per as (select bucket, m, r, count(*) filter (where op = 'throttle') as cuts from (select *, case when bucket like '%model-3' then null else 7.0::double * cast(right(bucket, 1) as int) end as m, greatest(2.0::double, 7.0::double * cast(right(bucket, 1) as int)) as r from ev) where k = 1 group by all)
    select bucket, case when cuts > 0 then greatest(2.0::double, floor(case when m is null then 20.0::double else r end * 0.5::double)) else case when m is null then 20.0::double else r end end as first_rpm, case when m is null then 60.0::double else r end as cap from per""",
    "rate_event",
)
def i6(spark, sf):
    """Each model's measured rate, from a registry, is where its buckets start and what they never exceed."""
    events = rate_events(spark, sf)
    registry = spark.createDataFrame([("model-0", 0.0), ("model-1", 7.0), ("model-2", 14.0), ("model-3", None)], "model string, rpm double")
    measured = events.join(registry, F.substring_index("bucket", ":", -1) == F.col("model"), "left").drop("model").withColumnRenamed("rpm", "measured")
    out = L.token_bucket(measured, measured="measured").join(measured.select(F.col("event_id").alias("e"), "bucket", "ts_ms"), F.col("event_id") == F.col("e"))
    return out.groupBy("bucket").agg(F.min_by("rpm", F.struct("ts_ms", "event_id")).alias("first_rpm"), F.max("cap").alias("cap"))


@query(
    "i7_sliding_log",
    """with ev as materialized (select event_id, model, epoch_us(ts) // 1000 as t, row_number() over (partition by model order by epoch_us(ts) // 1000, event_id) as k from rate_event),
    b as (with recursive s as (select distinct model, 0::bigint as k, -1::bigint as day, 0::bigint as today, []::bigint[] as recent, null::bigint as event_id, null::varchar as verdict from ev
        union all select model, k, t // 86400000, case when v = 'ok' then n + 1 else n end, case when v = 'ok' then list_append(live, t) else live end, event_id, v
        from (select *, case when n >= 400 then 'day' when len(live) >= 3 then 'minute' else 'ok' end as v
            from (select s.model, e.k, e.t, e.event_id, case when e.t // 86400000 = s.day then s.today else 0 end as n, list_filter(s.recent, lambda x: x > e.t - 60000) as live from s join ev e on e.model = s.model and e.k = s.k + 1)))
        select * from s where event_id is not null)
    select event_id, verdict from b""",
    "rate_event",
)
def i7(spark, sf):
    e = rate_events(spark, sf).withColumn("model", F.substring_index("bucket", ":", -1))
    return L.sliding_log(e, "model", rpm=3, per_day=400)


@query("e15_success_streak", f"{_BUCKET} select streak, count(*) as n from b where streak > 0 group by streak", "rate_event")
def e15(spark, sf):
    return L.token_bucket(rate_events(spark, sf)).where("streak > 0").groupBy("streak").agg(F.count("*").alias("n"))


@query("i14_wait_slices", "select event_id, case when value * 1000 > 120000 then null else cast(ceil(value) as bigint) end as slices from events")
def i14(spark, sf):
    wait = F.col("value") * 1000
    return bind(spark, sf, "events").select("event_id", F.when(wait <= 120_000, F.ceil(wait / 1000)).alias("slices"))


_JOBS = "id string, status string, completed_at timestamp"


def _stream(spark, sf, path):
    bind(spark, sf, "job").select("id", "status", F.col("completed_at").cast("timestamp").alias("completed_at")).write.parquet(path)
    return J.job_stream(spark, path, _JOBS, files_per_batch=4)


@query("a13_stream_source", "select status, count(*) as n from job group by status", "job")
def a13(spark, sf):
    home = scratch(spark)
    J.run_available(_stream(spark, sf, f"{home}/in"), f"{home}/cp", J.idempotent_sink(f"{home}/out", "id"))
    return spark.read.parquet(f"{home}/out").groupBy("status").agg(F.count("*").alias("n"))


@query("i1_consumer_group", "select id from job", "job")
def i1(spark, sf):
    home = scratch(spark)
    sink = J.idempotent_sink(f"{home}/out", "id")
    J.run_available(_stream(spark, sf, f"{home}/in"), f"{home}/cp", sink)
    J.run_available(J.job_stream(spark, f"{home}/in", _JOBS), f"{home}/cp", sink)  # a restart finds nothing new
    return spark.read.parquet(f"{home}/out").select("id")


@query("i2_stale_claim", "select id, deliveries + 1 as deliveries from (select id, seq % 5 as deliveries, seq % 1000 * 100 as delivered_ms from job) where 100000 - delivered_ms > 30000 order by delivered_ms, id limit 50", "job")
def i2(spark, sf):
    pending = bind(spark, sf, "job").select("id", (F.col("seq") % 5).alias("deliveries"), (F.col("seq") % 1000 * 100).alias("delivered_ms"))
    return J.stale(pending, 100_000).select("id", "deliveries")


@query("i3_idempotent_processing", "select distinct id from job where status not in ('SUCCEEDED', 'DEAD')", "job")
def i3(spark, sf):
    j = bind(spark, sf, "job")
    return J.to_process(j.select("id").unionAll(j.select("id")), j).select("id")


@query("a6_xml_scan", "select doc_id, trim(regexp_replace(text, '[<>&\n]', ' ', 'g')) as translation from documents")
def a6(spark, sf):
    body = F.trim(F.regexp_replace("text", "[<>&\n]", " "))
    home = scratch(spark)
    bind(spark, sf, "documents").select(F.concat(F.lit('<article id="'), "doc_id", F.lit('"><translation>'), body, F.lit("</translation></article>")).alias("v")).write.text(home)
    out = readers.xml_articles(spark, home)
    return out.select(F.col("id").cast("bigint").alias("doc_id"), F.coalesce(F.trim("translation"), F.lit("")).alias("translation"))


@query("a8_pattern_list", "select cast(row_number() over (order by n_nationkey) - 1 as int) as place, '(?i)' || lower(n_name) as pattern, case when n_regionkey < 2 then 'R' || cast(n_regionkey as varchar) end as label from nation")
def a8(spark, sf):
    """A list with labels and a list without, from files with comments, blank lines and space around rows; file order stays."""
    home = scratch(spark)
    n = bind(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("(?i)"), F.lower("n_name")).alias("p"), "n_regionkey")
    two = n.select("n_nationkey", F.concat(F.lit("  "), "p", F.lit("\tR"), F.col("n_regionkey").cast("string"), F.lit(" ")).alias("v"))
    for name, column in (("two", "v"), ("one", "p")):
        rows = two if name == "two" else n
        text = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", column))), lambda r: r[column]), "\n# a comment\n\n").alias("value"))  # one small file
        text.write.text(f"{home}/{name}")
    labelled, plain = readers.pattern_list(spark, f"{home}/two"), readers.pattern_list(spark, f"{home}/one", columns=1)
    label = F.when(F.col("label").isin("R0", "R1"), F.col("label")).alias("label")
    return plain.drop("label").join(labelled, ["place", "pattern"]).select("place", "pattern", label)


@query("a16_resumable_stage", "select distinct original, length(original) as n from corpus", "corpus")
def a16(spark, sf):
    c = bind(spark, sf, "corpus").select("original")
    home = scratch(spark)
    stage = lambda df: df.select("original", F.length("original").cast("bigint").alias("n"))
    first = readers.resumable(c.where("length(original) % 2 = 0"), None, "original", stage, home)
    return readers.resumable(c, first, "original", stage, home)


_KEYS = ["tion", "the", "then", "ient"]


@query("c10_dictionary_scan", "select seq, k as key, cast(i - 1 as int) as start from (select seq, original, k, unnest(range(1, length(original) - length(k) + 2)) i from corpus, (select unnest(['tion', 'the', 'then', 'ient']) k) where contains(original, k)) where substring(original, i, length(k)) = k", "corpus")
def c10(spark, sf):
    keys = spark.createDataFrame([(k,) for k in _KEYS], "key string")
    return N.dictionary_hits(bind(spark, sf, "corpus"), keys).select("seq", "key", "start")


# keys of one length never overlap the ones before them in a scan from the left, and what they took is gone for the shorter
_TAKEN = "(select seq, regexp_extract_all(original, 'tion|then|ient') as four, regexp_extract_all(regexp_replace(original, 'tion|then|ient', '~', 'g'), 'the') as three from corpus)"


@query("c10b_longest_disjoint", f"select seq, cast(len(four) + len(three) as int) as n, list_aggregate(list_sort(four || three), 'string_agg', ',') as keys from {_TAKEN} where len(four) + len(three) > 0", "corpus")
def c10b(spark, sf):
    keys = spark.createDataFrame([(k,) for k in _KEYS], "key string")
    spans = N.dictionary_scan(bind(spark, sf, "corpus"), keys)
    return spans.select("seq", F.size("spans").alias("n"), F.array_join(F.array_sort(F.transform("spans", lambda x: x["key"])), ",").alias("keys"))


_RULES = ["(?:and|the) ([A-Za-z]{3,5}) of", "([A-Z][a-z]{5,7})(?=[,.])"]


_AT = "list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0))"
_SPANS = r"""with r1 as (select seq, '(?:and|the) [A-Za-z]{3,5} of' as rx, 4 as skip, 3 as tail, original from corpus), r2 as (select seq, '[A-Z][a-z]{5,7}[,.]', 0, 1, original from corpus),
m as (select *, row_number() over () as rule from (select seq, 1 as prio, skip, tail, regexp_extract_all(original, rx) m, regexp_split_to_array(original, rx) p from r1 union all select seq, 2, 0, 1, regexp_extract_all(original, '[A-Z][a-z]{5,7}[,.]'), regexp_split_to_array(original, '[A-Z][a-z]{5,7}[,.]') from r2)),
s as (select seq, prio, cast(at_ + skip as int) as start, cast(at_ + length(w) - tail as int) as "end", w[skip + 1 : length(w) - tail] as surface from (select seq, prio, skip, tail, unnest(m) w, unnest(AT) at_ from m where len(m) > 0))""".replace("AT)", _AT + ")")


@query("l5_rule_ner", _SPANS + ' select seq, surface, start, "end", 0.5::double as score from s where prio = 1 union all select seq, surface, start, "end", 0.5 from s where prio = 2 and not exists (select 1 from s t where t.seq = s.seq and t.prio = 1 and s.start < t."end" and t.start < s."end")', "corpus")
def l5(spark, sf):
    return N.rule_ner(bind(spark, sf, "corpus").select("seq", "original"), "original", _RULES).select("seq", F.explode("spans").alias("s")).select("seq", "s.*")


@query("l7_extended_slotting", K.sql("sentence", "select seq, template from filled", K.EXTENDED))
def l7(spark, sf):
    return K.extended(spark, sf)


# Hangul names from the corpus: each letter up to w stands for a syllable, so that onsets and final consonants vary.
_LETTERS = "abcdefghijklmnopqrstuvw"
_CODE = "44032 + (unicode({0}) - 97) % 19 * 588 + unicode({0}) * 7 % 21 * 28 + unicode({0}) % 2"
_SYLLABLE = f"chr(cast({_CODE} as int))"
_WORDS = f"words as materialized (select w, array_to_string([case when c between 'a' and 'w' then {_SYLLABLE.format('c')} else c end for c in string_split(w, '')], '') as base from (select distinct lower(substring(surface, 1, 3)) as w from mention))"
_INDEX = "(unicode({0}) - 44032)"
_NEW = f"case when {_INDEX} // 588 = 5 and {_INDEX} % 588 // 28 in (2, 3, 6, 7, 12, 17, 20) then 11 when {_INDEX} // 588 = 5 then 2 when {_INDEX} // 588 = 2 and {_INDEX} % 588 // 28 in (2, 3, 6, 7, 12, 17, 20) then 11 else {_INDEX} // 588 end"
_SOUND = f"case when {_INDEX} between 0 and 11171 then chr(cast({_NEW} * 588 + {_INDEX} % 588 + 44032 as int)) || substring({{0}}, 2) else {{0}} end"


def _syllable_of(letter: str) -> str:
    n = ord(letter)
    return chr(44032 + (n - 97) % 19 * 588 + n * 7 % 21 * 28 + n % 2)


def hangul(spark, sf):
    """Distinct short words of the corpus and the Hangul names that stand for them."""
    w = K.mentions(spark, sf).select(F.lower(F.substring("surface", 1, 3)).alias("w")).distinct()
    return w.withColumn("base", F.translate("w", _LETTERS, "".join(map(_syllable_of, _LETTERS))))


_FOLLOWS = ["이", "가", "을", "를", "은", "는", "과", "와", "이라", "라", "한", ""]
_OPEN = "(unicode(right(base, 1)) between 44032 and 55203 and (unicode(right(base, 1)) - 44032) % 28 <> 0)"


@query("h11_particle_correction", K.sql("mention", "select w, follows, case " + " ".join(f"when follows in ('{a}', '{b}') then case when {_OPEN} then '{a}' else '{b}' end" for a, b in [*T.PARTICLES]) + f" when follows = '이라' then case when {_OPEN} then '이라' else '라' end else follows end as particle from words, (select unnest({_FOLLOWS}) as follows)", ", " + _WORDS))
def h11(spark, sf):
    rows = hangul(spark, sf).withColumn("follows", F.explode(F.array(*map(F.lit, _FOLLOWS))))
    return rows.select("w", "follows", T.particle(F.col("base"), F.col("follows")).alias("particle"))


@query("h12_initial_sound", K.sql("mention", f"select w, {_SOUND.format('base')} as word from words", ", " + _WORDS))
def h12(spark, sf):
    return hangul(spark, sf).select("w", T.initial_sound(F.col("base")).alias("word"))


@query("h13_surrogate_entities", "select n_nationkey, '𠀀 & ' || n_name as decoded from nation")
def h13(spark, sf):
    return bind(spark, sf, "nation").select("n_nationkey", N.unescape_entities(F.concat(F.lit("&#55360;&#56320; &amp; "), "n_name")).alias("decoded"))


_OWN = "case when length(w) >= 2 and w[1] in ('f', 'h', 's') then case w[1] when 'f' then '려' when 'h' then '심' else '노' end || substring(base, 2) end"


@query("h15_reading_candidates", K.sql("mention", f"select w, case when base <> w then array_to_string([x for x, i in l if list_position(l, x) = i], ',') else '' end as readings from (select w, base, [x for x in list_concat([base, own], [{_SOUND.format('base')}, case when own is not null then {_SOUND.format('own')} end]) if x is not null] as l from (select w, base, {_OWN} as own from words))", ", " + _WORDS))
def h15(spark, sf):
    table = spark.createDataFrame([(c, _syllable_of(c)) for c in _LETTERS], "char string, reading string")
    surnames = spark.createDataFrame([("f", "려"), ("h", "심"), ("s", "노")], "char string, fixed string")
    found = N.readings(hangul(spark, sf).select(F.col("w").alias("name")), table, surnames)
    return found.select(F.col("name").alias("w"), F.array_join("readings", ",").alias("readings"))


# the first two names of the original are what its translation should say; their library reading is its first word of that length and initial
_REPAIRED = "[{'i': i, 'c': substring({0}, i, length({1}))} for i in range(1, length({0}) + 1) if {0}[i] = {1}[1] and length(substring({0}, i, length({1}))) = length({1}) and substring({0}, i, length({1})) <> {1} and regexp_full_match(substring({0}, i, length({1})), '[A-Za-z]+')]"


def _step(text: str, gold: str, library: str, before: str, after: str) -> str:
    wrong = _REPAIRED.replace("{0}", text).replace("{1}", gold)
    x = f"case when len(w_) = 1 then w_[1] else list_filter(w_, lambda y: y.c = {library})[1] end"
    return f"""{after}w as (select *, {wrong} as w_ from {before}), {after} as (select * exclude (w_, x_), case when {gold} is null then null when contains({text}, {gold}) then 'already' when length({gold}) >= 2 and x_ is not null then 'fixed' else 'unfixable' end as {after}_state,
        case when {gold} is not null and not contains({text}, {gold}) and length({gold}) >= 2 and x_ is not null then substring({text}, 1, x_.i - 1) || {gold} || substring({text}, x_.i + length({gold})) else {text} end as {after}_text from (select *, {x} as x_ from {after}w))"""


_FIXED = (
    "with names as (select seq, translation as t0, regexp_extract_all(original, '[A-Z][a-z]{2,4}') as e from pairs), g as (select seq, t0, e[1] as g1, e[2] as g2, substring(t0, instr(t0, e[1][1]), length(e[1])) as l1, substring(t0, instr(t0, e[2][1]), length(e[2])) as l2 from names), "
    + _step("t0", "g1", "l1", "g", "one") + ", " + _step("one_text", "g2", "l2", "one", "two")
)


def repairs(spark, sf):
    p = bind(spark, sf, "pairs").withColumn("e", F.slice(F.regexp_extract_all("original", F.lit("[A-Z][a-z]{2,4}"), F.lit(0)), 1, 2))
    library = lambda g: F.substring(F.col("translation"), F.instr(F.col("translation"), F.substring(g, 1, 1)), F.length(g))
    p = p.withColumn("e", F.transform("e", lambda g: F.struct(g.alias("gold"), library(g).alias("library"))))
    return p.select("seq", N.repair_all(F.col("translation"), F.col("e"), "A-Za-z").alias("r")).select("seq", "r.*")


@query("h18_reading_repair", f"{_FIXED} select seq, two_text as repaired from two", "pairs")
def h18(spark, sf):
    return repairs(spark, sf).select("seq", F.col("text").alias("repaired"))


@query("l34_repair_accounting", f"{_FIXED} select state, count(*) as n from (select one_state as state from two union all select two_state from two) where state is not null group by state", "pairs")
def l34(spark, sf):
    """Names already there, repaired, and beyond repair; each repair is seen by the next."""
    return repairs(spark, sf).select(F.explode("states").alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query("h23_prompt_assembly", "select seq, 'G' || chr(10) || '[등장 인물 한자→한글]' || chr(10) || '  · ' || lang || ' → ' || source || case when seq % 2 = 0 then '  (관직: x)' else '' end || chr(10) || '  · y → 동명이인 후보 중 문맥으로 판단: p / q' || chr(10) || original as prompt from corpus", "corpus")
def h23(spark, sf):
    none = F.lit(None).cast("string")
    one = F.struct(F.col("lang").alias("surface"), F.col("source").alias("name"), F.when(F.col("seq") % 2 == 0, F.lit("x")).alias("office"), F.lit(True).alias("resolved"), F.array().cast("array<string>").alias("others"))
    two = F.struct(F.lit("y").alias("surface"), none.alias("name"), none.alias("office"), F.lit(False).alias("resolved"), F.array(F.lit("p"), F.lit("q")).alias("others"))
    return bind(spark, sf, "corpus").select("seq", N.prompt(F.lit("G"), F.array(one, two), F.col("original")).alias("prompt"))


@query("d20_percent_format", "select batch_id, case when count(*) filter (where status = 'DEAD') = 0 then '—' else printf('%.2f', 100.0 * count(*) filter (where quality_grade = 'VERIFIED') / count(*)) end as pct from job group by batch_id", "job")
def d20(spark, sf):
    g = bind(spark, sf, "job").groupBy("batch_id").agg(F.count(F.when(F.col("quality_grade") == "VERIFIED", 1)).alias("v"), F.count(F.when(F.col("status") == "DEAD", 1)).alias("d"), F.count("*").alias("n"))
    return g.select("batch_id", F.when(F.col("d") == 0, "—").otherwise(F.format_string("%.2f", 100.0 * F.col("v") / F.col("n"))).alias("pct"))


@query("l25_gold_resolution", "select o_custkey as id, arg_min(o_orderpriority, (case when o_orderstatus = 'F' then 0 when o_orderstatus = 'O' then 1 else 2 end, o_orderkey)) as gold, arg_min(o_orderstatus, (case when o_orderstatus = 'F' then 0 when o_orderstatus = 'O' then 1 else 2 end, o_orderkey)) as status from orders group by 1")
def l25(spark, sf):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    c = bind(spark, sf, "orders").select(F.col("o_custkey").alias("id"), rank.alias("rank"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("reading"), F.col("o_orderstatus").alias("status"))
    return N.resolve_gold(c)


@query("l28_weighted_selection", "select user_id from (select user_id, count(*) w from events group by 1) order by -ln((('0x' || substring(md5('42-' || cast(user_id as varchar)), 1, 8))::bigint + 1) / (4294967297.0::double)) / w, user_id limit 20")
def l28(spark, sf):
    pool = bind(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("w"))
    return N.weighted_pick(pool, "w", "user_id", 20).select("user_id")


@query("l28b_swarm_selection")
def l28b(spark, sf):
    """Visits of a swarm over the features of the 500 most active users, plus one, as the weights of the sample."""
    e = bind(spark, sf, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("high"))
    pool = e.orderBy(F.desc("n"), "user_id").limit(500)  # the pool's size is a parameter of the selection
    return N.swarm_selection(pool, "user_id", ["n", "mean", "high"], 20)


@query(
    "l29_per_query_examples",
    """with p as (select seq as id, lang as pattern, length(original) as n from corpus), q as (select * from p where id % 100 = 0),
    pairs as (select q.id as q, q.n as q_n, p.* from q join p on q.pattern = p.pattern and q.id <> p.id), f as (select pattern, min(id) as ex from p group by pattern)
    select q, arg_max(id, n * 1000000000 + id) as ex from pairs where n < q_n group by q
    union select q, arg_min(id, n * 1000000000 + id) as ex from pairs where n >= q_n group by q
    union select q.id as q, ex from q join f on q.pattern <> f.pattern""",
    "corpus",
)
def l29(spark, sf):
    c = bind(spark, sf, "corpus").select(F.col("seq").alias("id"), F.col("lang").alias("pattern"), F.length("original").alias("n"))
    return N.per_query_examples(c.where("id % 100 = 0"), c)


@query("h31_year_range", "select o_orderkey from orders where year(o_orderdate) between 1995 and 1996")
def h31(spark, sf):
    low, high = year_range("1995-1996")
    return bind(spark, sf, "orders").where(F.year("o_orderdate").between(low, high)).select("o_orderkey")


def year_range(text: str) -> tuple[int, int]:
    """Both ends of ``a-b``, or one year."""
    low, _, high = text.partition("-")
    return int(low), int(high or low)


@query("m8_version_gate", "select prompt_version, prompt_version in ('v0', 'v1', 'v2') as known from job group by 1", "job")
def m8(spark, sf):
    return bind(spark, sf, "job").select("prompt_version").distinct().withColumn("known", F.col("prompt_version").isin("v0", "v1", "v2"))

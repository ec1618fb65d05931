"""Queries of sections A, I, L and M: sources, quotas, batches, tenants, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import names as N
from inkstone.operators import relational as R
from inkstone.operators import replay
from inkstone.queries.bindings import bind
from inkstone.queries.registry import query
from inkstone.session import shared_folder
from inkstone.sources import readers
from inkstone.streaming import jobs


@query("a1_corpus_scan", "select seq, id, date, original from corpus", "corpus")
def a1(spark, sf):
    return bind(spark, sf, "corpus").select("seq", "id", "date", "original")


@query("a2_period_slice", "select seq from corpus where substring(date, 1, 3) in ('A03', 'A11')", "corpus")
def a2(spark, sf):
    return bind(spark, sf, "corpus").where(F.substring("date", 1, 3).isin("A03", "A11")).select("seq")


@query("a3_oversize_cut", "select count(*) filter (where length(original) <= 2000) as kept, count(*) filter (where length(original) > 2000) as cut from corpus", "corpus")
def a3(spark, sf):
    n = F.length("original")
    return bind(spark, sf, "corpus").agg(F.count(F.when(n <= 2000, 1)).alias("kept"), F.count(F.when(n > 2000, 1)).alias("cut"))


@query("a4_kb_map_scan", "select key, value from (select unnest(map_entries(json_transform(props, '\"MAP(VARCHAR, BIGINT)\"'))) e from events), lateral (select e.key as key, e.value as value)")
def a4(spark, sf):
    return bind(spark, sf, "events").select(F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))


@query("a5_tolerant_jsonl", "select id, hypothesis from (select user_id as id, event_type as hypothesis, row_number() over (partition by user_id order by event_id desc) r from events where event_id % 10 <> 0) where r = 1")
def a5(spark, sf):
    good = F.to_json(F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("hypothesis")))
    lines = bind(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit('{"id": 1, "hypo')).otherwise(good).alias("line"))
    rows = lines.select("event_id", F.from_json("line", "id bigint, hypothesis string").alias("j")).where("j.hypothesis is not null").select("event_id", "j.*")
    return R.first_seen(rows.withColumn("o", -F.col("event_id")), "id", "o").select("id", "hypothesis")


@query("a9_point_reads", "select id, status from job where id = '7' union all select id, status from job where idempotency_key = 'key-12' union all select id, status from job where batch_id = '5' and status = 'FAILED'", "job")
def a9(spark, sf):
    j = bind(spark, sf, "job")
    reads = [j.where("id = '7'"), j.where("idempotency_key = 'key-12'"), j.where("batch_id = '5' and status = 'FAILED'")]
    return reads[0].unionAll(reads[1]).unionAll(reads[2]).select("id", "status")


@query("a10_bulk_insert", r"select 'batch:b1:' || cast(seq as varchar) as idempotency_key, case when substring(id, 5, 1) = 'A' then try_cast(substring(id, 6, 2) as int) + 1622 end as doc_year, sha256(regexp_replace(original, '[ \t\n\x0B\f\r]+', '', 'g')) as normalized_hash from corpus where seq between 40 and 139", "corpus")
def a10(spark, sf):
    c = bind(spark, sf, "corpus").where(F.col("seq").between(40, 139))
    return c.select(F.concat(F.lit("batch:b1:"), F.col("seq").cast("string")).alias("idempotency_key"), T.catalogue_year(F.col("id")).alias("doc_year"), T.normalized_hash(F.col("original")).alias("normalized_hash"))


@query("a11_insert_if_absent", "select id, case when batch_id = '1' then 'old' else 'new' end as state from job where batch_id in ('1', '2')", "job")
def a11(spark, sf):
    """Rows that the sink has keep what it has; inserting again adds nothing."""
    j = bind(spark, sf, "job")
    home = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    readers.append(j.where("batch_id = '1'").select("id", F.lit("old").alias("state")), home)
    for _ in range(2):
        readers.insert_if_absent(spark.read.parquet(home), j.where("batch_id in ('1', '2')").select("id", F.lit("new").alias("state")), "id", home)
    return spark.read.parquet(home)


@query("a12_ledger_append", "select job_id, call_no, model, tokens_in + tokens_out as tokens, call_no % 4 <> 0 as parsed from ledger", "ledger")
def a12(spark, sf):
    """One row for each call, also for those whose answer did not parse."""
    calls = bind(spark, sf, "ledger").select("job_id", "call_no", "model", (F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), (F.col("call_no") % 4 != 0).alias("parsed"))
    home = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    readers.append(calls.where("parsed"), home)
    readers.append(calls.where("not parsed"), home)
    return spark.read.parquet(home)


@query("a14_dead_letters", "select id as job_id, 'E' || cast(seq % 3 as varchar) as error_class, substring(quality_grade || repeat('x', cast(seq % 900 as int)), 1, 400) as message from job where status = 'DEAD'", "job")
def a14(spark, sf):
    dead = bind(spark, sf, "job").where("status = 'DEAD'")
    home = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    message = F.concat("quality_grade", F.expr("repeat('x', cast(seq % 900 as int))"))
    dead.select(F.col("id").alias("job_id"), F.concat(F.lit("E"), (F.col("seq") % 3).cast("string")).alias("error_class"), message.alias("message"), F.col("completed_at").cast("timestamp").alias("failed_at")).write.parquet(f"{home}/in")
    stream = jobs.job_stream(spark, f"{home}/in", "job_id string, error_class string, message string, failed_at timestamp", files_per_batch=4)
    jobs.run_available(stream, f"{home}/cp", jobs.dead_letters(f"{home}/out"))
    return spark.read.parquet(f"{home}/out").select("job_id", "error_class", "message")


@query("a15_cache_lookup", "select e.event_id, c.k as hit from (select event_id, cast(json_extract_string(props, '$.k') as bigint) k, user_id from events) e left join (select distinct user_id as k from events where user_id % 3 = 0) c on e.user_id = c.k and e.event_id % 5 <> 0")
def a15(spark, sf):
    e = bind(spark, sf, "events")
    cache = e.where("user_id % 3 = 0").select(F.col("user_id").alias("hit"), F.concat(F.lit('{"v": '), F.col("user_id").cast("string"), F.lit("}")).alias("body")).distinct()
    # a value that does not parse is a miss; one in five has expired
    cache = cache.where(F.try_parse_json("body").isNotNull()).drop("body")
    return e.join(cache, (F.col("user_id") == F.col("hit")) & (F.col("event_id") % 5 != 0), "left").select("event_id", "hit")


@query("a17_html_annotations", "select page_id, array_to_string(list_distinct_in_order, ',') as names from (select page_id, list_transform(list_sort(list({'p': p, 'w': w})), lambda x: x.w) as list_distinct_in_order from (select page_id, trim(w) w, min(p) p from (select page_id, unnest(regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1)) w, generate_subscripts(regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1), 1) p from pages) group by page_id, trim(w)) group by page_id)")
def a17(spark, sf):
    names = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)</a>'), F.lit(1)), lambda x: F.trim(x)))
    return bind(spark, sf, "pages").where(F.size(names) > 0).select("page_id", F.array_join(names, ",").alias("names"))


@query("a18_tsv_report", r"select cast(seq as varchar) as seq, lang, substring(regexp_replace(original, '[\t\n\r]+', ' ', 'g'), 1, 80) as cell from corpus", "corpus")
def a18(spark, sf):
    """Written as a report and read back."""
    home = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    readers.tsv_report(bind(spark, sf, "corpus").select("seq", "lang", F.col("original").alias("cell")), home)
    # one cell ends in a space, another may be empty: nothing is trimmed, and an empty cell is not null
    out = spark.read.option("quote", "").option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(home, sep="\t", header=True, schema="seq string, lang string, cell string")
    return out.withColumn("cell", F.coalesce("cell", F.lit("")))


@query("a7_csv_scan", "select cast(c_custkey as varchar) as person, c_name as name, case when c_custkey % 4 = 0 then null else c_nationkey end as born, cast(c_nationkey as int) + 1600 as year, case when c_custkey % 3 = 0 then 'x, \"y\"' else c_mktsegment end as office from customer")
def a7(spark, sf):
    """Written with a header, quoted cells and missing years, and read by the history's schema."""
    home = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    c = bind(spark, sf, "customer")
    none = F.lit(None).cast("string")
    office = F.when(F.col("c_custkey") % 3 == 0, 'x, "y"').otherwise(F.col("c_mktsegment"))
    rows = c.select(F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_name"), none, F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey")), none, F.col("c_nationkey") + 1600, office, none, none)
    rows.toDF("인물아이디", "한자_명", "한글_명", "본관_표준", "생년", "몰년", "년", "관직명_정규화", "자", "호").write.option("escape", '"').csv(home, header=True)
    out = readers.office_history(spark, home)
    return out.select(F.col("인물아이디").alias("person"), F.col("한글_명").alias("name"), F.col("생년").alias("born"), F.col("년").alias("year"), F.col("관직명_정규화").alias("office"))


@query("i8_daily_quota", "select event_id, row_number() over (partition by model, cast(ts as date) order by ts, event_id) <= 20 as admitted from rate_event", "rate_event")
def i8(spark, sf):
    return replay.reserve_daily(bind(spark, sf, "rate_event"), "model", "ts", "event_id", 20).select("event_id", "admitted")


@query("i9_tenant_charge", "select event_id, cast(sum(k) over w as bigint) as charged, sum(k) over w <= 500 as allowed from (select *, cast(floor(value) as bigint) k from rate_event) window w as (partition by tenant_id, cast(ts as date) order by ts, event_id rows unbounded preceding)", "rate_event")
def i9(spark, sf):
    e = bind(spark, sf, "rate_event").withColumn("k", F.floor("value"))
    return replay.charge_daily(e, "tenant_id", "ts", "event_id", "k", 500).select("event_id", F.col("charged").cast("bigint").alias("charged"), "allowed")


_BATCH = "select batch_id, count(*) total, count(*) filter (where status in ('SUCCEEDED', 'FAILED', 'DEAD')) terminal, count(*) filter (where status <> 'PENDING') as started from job group by batch_id"


@query("i10_batch_status", f"select batch_id, case when terminal >= total then 'COMPLETED' when spent >= 1500 then 'BUDGET_EXHAUSTED' else 'RUNNING' end as status, greatest(0, 3 - (started - terminal)) as to_publish from ({_BATCH}) b left join (select batch_id b2, count(*) spent from ledger join job on job_id = id group by 1) s on b.batch_id = s.b2", "job, ledger")
def i10(spark, sf):
    j = bind(spark, sf, "job")
    done = F.col("status").isin("SUCCEEDED", "FAILED", "DEAD")
    b = j.groupBy("batch_id").agg(F.count("*").alias("total"), F.count(F.when(done, 1)).alias("terminal"), F.count(F.when(F.col("status") != "PENDING", 1)).alias("started"))
    spent = bind(spark, sf, "ledger").join(j, F.col("job_id") == F.col("id")).groupBy("batch_id").agg(F.count("*").alias("spent"))
    status = F.when(F.col("terminal") >= F.col("total"), "COMPLETED").when(F.coalesce("spent", F.lit(0)) >= 1500, "BUDGET_EXHAUSTED").otherwise("RUNNING")
    return b.join(spent, "batch_id", "left").select("batch_id", status.alias("status"), F.greatest(F.lit(0).cast("bigint"), 3 - (F.col("started") - F.col("terminal"))).alias("to_publish"))


@query("i11_resume", "select id, case when status = 'FAILED' then 'PENDING' else status end as status from job", "job")
def i11(spark, sf):
    return bind(spark, sf, "job").select("id", F.when(F.col("status") == "FAILED", "PENDING").otherwise(F.col("status")).alias("status"))


@query("i12_redelivery_cap", "select id, case when seq % 7 >= 4 then 'DEAD' else 'REDELIVER' end as action, case when seq % 7 >= 4 then status || '_MAX_REDELIVERY' end as reason from job where status in ('FAILED', 'RUNNING')", "job")
def i12(spark, sf):
    dead = F.col("seq") % 7 >= 4
    return bind(spark, sf, "job").where("status in ('FAILED', 'RUNNING')").select("id", F.when(dead, "DEAD").otherwise("REDELIVER").alias("action"), F.when(dead, F.concat("status", F.lit("_MAX_REDELIVERY"))).alias("reason"))


@query("i13_failure_rate", "select event_id, avg(cast(event_type = 'error' as int)) over (partition by model order by ts, event_id rows 9 preceding) as rate from rate_event", "rate_event")
def i13(spark, sf):
    e = bind(spark, sf, "rate_event").withColumn("failed", F.col("event_type") == "error")
    return replay.failure_rate(e, "model", "ts", "event_id", "failed").select("event_id", "rate")


@query("i15_metric_counters", "select date_trunc('minute', ts) as minute, event_type, count(*) as n from events group by 1, 2")
def i15(spark, sf):
    return bind(spark, sf, "events").groupBy(F.window("ts", "1 minute").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("minute"), "event_type", "n")


@query("i16_chunk_concat", "select conv_id, string_agg(text, '' order by turn) as whole from conversations group by conv_id")
def i16(spark, sf):
    whole = F.expr("listagg(text, '') within group (order by turn)")
    return bind(spark, sf, "conversations").groupBy("conv_id").agg(whole.alias("whole"))


# Messages of providers, one for each class.
_MESSAGES = ["cannot PARSE the answer", "NER service down", "429 spending cap reached", "RESOURCE_EXHAUSTED: quota per day", "HTTP 429", "403 forbidden", "404 no such model", "500 oops", "request timed out", "blocked by SAFETY", "code 14290", "?"]
_CLASSES = ["PARSE", "NER_UNAVAILABLE", "SPEND_CAP", "QUOTA_DAILY", "RATE_LIMIT", "AUTH", "MODEL_NOT_FOUND", "UNAVAILABLE", "TIMEOUT", "SAFETY", "UNKNOWN", "UNKNOWN"]


@query(
    "l13_failure_flags",
    f"""with f as (select id, seq, {_CLASSES}[seq % 12 + 1] as error_class from job where status in ('FAILED', 'DEAD', 'RUNNING'))
    select id, error_class, error_class in ('PARSE', 'NER_UNAVAILABLE', 'RATE_LIMIT', 'UNAVAILABLE', 'TIMEOUT', 'UNKNOWN') as retry, error_class in ('SPEND_CAP', 'AUTH', 'MODEL_NOT_FOUND', 'SAFETY') as dead,
        case when error_class in ('SPEND_CAP', 'AUTH', 'MODEL_NOT_FOUND', 'SAFETY') then 'DEAD' when error_class = 'QUOTA_DAILY' then 'FAILED' else 'REDELIVER' end as next from f""",
    "job",
)
def l13(spark, sf):
    """A failed call's message is classified, and the class tells what becomes of the job."""
    failed = bind(spark, sf, "job").where("status in ('FAILED', 'DEAD', 'RUNNING')")
    message = F.element_at(F.array(*map(F.lit, _MESSAGES)), (F.col("seq") % 12 + 1).cast("int"))
    actions = spark.createDataFrame([(k, *v) for k, v in T.ERROR_ACTIONS.items()], "error_class string, retry boolean, dead boolean")
    out = failed.select("id", T.classify_error(message).alias("error_class")).join(F.broadcast(actions), "error_class")  # a row for each class
    return out.withColumn("next", F.when(F.col("dead"), "DEAD").when(F.col("retry"), "REDELIVER").otherwise("FAILED"))


@query("l16_allocation", "select event_id, case when user_id % 3 = 0 and r <= 20 then 'upper' else 'base' end as chosen, user_id % 3 = 0 and r > 20 as downgraded from (select *, row_number() over (partition by user_id % 3 = 0, model, cast(ts as date) order by ts, event_id) r from rate_event)", "rate_event")
def l16(spark, sf):
    e = bind(spark, sf, "rate_event")
    hard = replay.reserve_daily(e.where("user_id % 3 = 0"), "model", "ts", "event_id", 20)
    out = hard.select("event_id", F.when(F.col("admitted"), "upper").otherwise("base").alias("chosen"), (~F.col("admitted")).alias("downgraded"))
    return out.unionAll(e.where("user_id % 3 <> 0").select("event_id", F.lit("base"), F.lit(False)))


_SECOND = "case when seq % 9 = 0 then null when seq % 2 = 0 then 'VERIFIED' else 'REJECTED' end"


@query(
    "l17_promotion",
    f"""with p as (select *, row_number() over (partition by cast(completed_at as date) order by completed_at, seq) <= 2 as admitted from job where quality_grade = 'REJECTED' and seq % 10 <> 3), s as (select id, {_SECOND} as again from p where admitted)
    select j.id, case when again is not null then 'second' else 'first' end as attempt, coalesce(again, quality_grade) as grade, cast(1 + (s.id is not null)::int as bigint) as calls from job j left join s on s.id = j.id""",
    "job",
)
def l17(spark, sf):
    """Rejected jobs where it is enabled get a second call while the day's quota of two lasts; it may fail, or be rejected again."""
    j = bind(spark, sf, "job").select("id", "seq", "completed_at", F.col("quality_grade").alias("grade"))
    asked = j.where((F.col("grade") == "REJECTED") & (F.col("seq") % 10 != 3)).withColumn("model", F.lit("upper"))
    called = replay.reserve_daily(asked, "model", "completed_at", "seq", 2).where("admitted")
    second = called.select("id", F.when(F.col("seq") % 9 == 0, F.lit(None)).when(F.col("seq") % 2 == 0, "VERIFIED").otherwise("REJECTED").alias("grade"))
    calls = called.select(F.col("id").alias("called"), F.lit(1).cast("bigint").alias("more"))
    out = replay.promoted(j.select("id", "grade"), second)
    return out.join(calls, F.col("id") == F.col("called"), "left").select("id", "attempt", "grade", (1 + F.coalesce("more", F.lit(0))).alias("calls"))


@query("l30_expression_index", "select source, count(*) filter (where regexp_matches(original, '(?i)licen[sc]e')) as rows_with, cast(sum(len(regexp_extract_all(original, '(?i)licen[sc]e'))) as bigint) as occurrences from corpus group by source", "corpus")
def l30(spark, sf):
    t = F.col("original")
    return bind(spark, sf, "corpus").groupBy("source").agg(F.count(F.when(t.rlike("(?i)licen[sc]e"), 1)).alias("rows_with"), F.sum(F.regexp_count(t, F.lit("(?i)licen[sc]e"))).alias("occurrences"))


# label, condition over o (original), r (reference), h (hypothesis); the same SQL for both engines
_TYPES = [
    ("short_original", "length(o) <= 200"),
    ("script_left", "length(regexp_replace(r, '[^À-ÿ]', '')) / greatest(length(r), 1) > 0.05"),
    ("mostly_names", "length(r) <= 400 and regexp_like(r, '[A-Z][a-z]{2,3} (the|of|and)')"),
    ("length_differs", "length(h) / greatest(length(r), 1) < 0.5 or length(h) / greatest(length(r), 1) > 2.0"),
    ("dropped", "length(h) < 5 or length(regexp_replace(h, '[^À-ÿ]', '')) / greatest(length(h), 1) > 0.2"),
    ("offices", "regexp_like(r, 'tion|heer|ledble')"),
]


def _duck(condition: str) -> str:
    return condition.replace("regexp_like", "regexp_matches").replace("[^À-ÿ]', '')", "[^À-ÿ]', '', 'g')")


@query(
    "l32_low_score_typology",
    "with low as (select seq, original as o, translation as r, substring(translation, 1, cast(length(original) // 2 as int)) as h, abs(length(original) - length(translation)) as score from pairs where abs(length(original) - length(translation)) > 100), t as (select seq, score, unnest(case when len(l) > 0 then l else ['other'] end) as label from (select *, list_filter(["
    + ", ".join(f"case when {_duck(c)} then '{n}' end" for n, c in _TYPES)
    + "], lambda x: x is not null) as l from low)) select label, count(*) as n, string_agg(cast(seq as varchar), ',' order by score, seq) filter (where k <= 5) as examples from (select *, row_number() over (partition by label order by score, seq) k from t) group by label",
    "pairs",
)
def l32(spark, sf):
    """Rules that may all hold of one row; a row of none is other; the lowest five of each label are its examples."""
    p = bind(spark, sf, "pairs").select("seq", F.col("original").alias("o"), F.col("translation").alias("r"), F.expr("substring(translation, 1, cast(length(original) div 2 as int))").alias("h"))
    low = p.withColumn("score", F.abs(F.length("o") - F.length("r"))).where("score > 100")
    labels = F.array_compact(F.array(*[F.when(F.expr(c), n) for n, c in _TYPES]))
    typed = low.select("seq", "score", F.explode(F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("other")))).alias("label"))
    top = R.top_per_group(typed, "label", [F.col("score"), F.col("seq")], 5)
    examples = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("score", "seq"))), lambda x: x["seq"].cast("string")), ",")
    return typed.groupBy("label").agg(F.count("*").alias("n")).join(top.groupBy("label").agg(examples.alias("examples")), "label")


@query(
    "l33_verdict_join_back",
    """with d as (select doc_id, regexp_extract_all(substring(text, 1, 1000000), 'ti[a-z]*n') as m, regexp_split_to_array(text, 'ti[a-z]*n') as p from documents where lang = 'en'),
    c as (select doc_id, i as cand_id, cast(list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) as int) as start, length(m[i]) as n from d, unnest(range(1, len(m) + 1)) t(i)),
    v as (select doc_id, cand_id, (doc_id + cand_id) % 3 = 0 as verdict from c where cand_id % 4 <> 0 union all select doc_id, 100000, true from d)
    select doc_id, cand_id, verdict, start, cast(start + n as int) as stop from v join c using (doc_id, cand_id) union all select doc_id, null, null, null, null from d where len(m) = 0""",
)
def l33(spark, sf):
    """Verdicts get their candidates' offsets; a verdict on no candidate goes; a text without candidates is one empty row."""
    d = bind(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id"), F.col("text"))
    found = N.rule_ner(d, "text", ["(ti[a-z]*n)"]).select("doc_id", F.posexplode_outer("spans").alias("i", "s"))
    candidates = found.select("doc_id", (F.col("i") + 1).cast("bigint").alias("cand_id"), F.col("s.start").alias("start"), F.col("s.end").alias("stop"))
    asked = candidates.where("cand_id % 4 <> 0").select("doc_id", "cand_id", ((F.col("doc_id") + F.col("cand_id")) % 3 == 0).alias("verdict"))
    verdicts = asked.unionAll(d.select("doc_id", F.lit(100000).cast("bigint"), F.lit(True)))
    return N.joined_back(verdicts, candidates, "doc_id")


@query("l35_pool_cut", "select user_id, count(*) as visits from events group by user_id order by visits desc, user_id limit 50")
def l35(spark, sf):
    return bind(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("visits")).orderBy(F.desc("visits"), "user_id").limit(50)


@query("l36_guide_block", "select seq, coalesce(array_to_string(list_filter([case when regexp_matches(original, '(?i)\\band\\b') then '- AND guide' end, case when regexp_matches(original, '(?i)\\bder\\b') then '- DER guide' end, case when regexp_matches(original, '(?i)\\bles\\b') then '- LES guide' end], lambda x: x is not null), chr(10)), '') as block from corpus", "corpus")
def l36(spark, sf):
    rules = [(f"- {n} guide", f"(?i)\\b{n}\\b") for n in ("AND", "DER", "LES")]
    return bind(spark, sf, "corpus").select("seq", F.array_join(T.all_labels(F.col("original"), rules), "\n").alias("block"))


@query("m1_guarded_transition", "select id, case when status = 'RUNNING' then 'SUCCEEDED' else status end as status, status = 'RUNNING' as moved from job", "job")
def m1(spark, sf):
    ok = F.col("status") == "RUNNING"
    return bind(spark, sf, "job").select("id", F.when(ok, "SUCCEEDED").otherwise(F.col("status")).alias("status"), ok.alias("moved"))


@query("m2_batch_progress", "select batch_id, count(*) filter (where status = 'SUCCEEDED') as done, count(*) filter (where status in ('FAILED', 'DEAD')) as failed, count(*) as total from job group by batch_id", "job")
def m2(spark, sf):
    s = F.col("status")
    return bind(spark, sf, "job").groupBy("batch_id").agg(F.count(F.when(s == "SUCCEEDED", 1)).alias("done"), F.count(F.when(s.isin("FAILED", "DEAD"), 1)).alias("failed"), F.count("*").alias("total"))


@query("m3_budget", "select batch_id, count(*) >= 1500 as exhausted from ledger join job on job_id = id group by batch_id", "job, ledger")
def m3(spark, sf):
    return bind(spark, sf, "ledger").join(bind(spark, sf, "job"), F.col("job_id") == F.col("id")).groupBy("batch_id").agg((F.count("*") >= 1500).alias("exhausted"))


@query("m4_auto_pause", "select batch_id, bool_or(status = 'DEAD' and seq % 33 = 0) as paused from job group by batch_id", "job")
def m4(spark, sf):
    return bind(spark, sf, "job").groupBy("batch_id").agg(F.bool_or((F.col("status") == "DEAD") & (F.col("seq") % 33 == 0)).alias("paused"))


@query("m5_tenant_resolution", "select o_orderkey, coalesce(cast(c_custkey as varchar), 'default') as tenant from orders left join (select c_custkey, sha256('key' || cast(c_custkey as varchar)) h from customer where c_custkey % 2 = 0) on h = sha256('key' || cast(o_custkey as varchar))")
def m5(spark, sf):
    t = bind(spark, sf, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.sha2(F.concat(F.lit("key"), F.col("c_custkey").cast("string")), 256).alias("h"))
    o = bind(spark, sf, "orders").withColumn("k", F.sha2(F.concat(F.lit("key"), F.col("o_custkey").cast("string")), 256))
    return o.join(t, F.col("k") == F.col("h"), "left").select("o_orderkey", F.coalesce(F.col("c_custkey").cast("string"), F.lit("default")).alias("tenant"))


@query("m6_idempotency", "select id, min(seq) over (partition by idempotency_key) as job_of, tenant_id <> first_value(tenant_id) over (partition by idempotency_key order by seq) as conflict from job", "job")
def m6(spark, sf):
    j = bind(spark, sf, "job")
    first = j.groupBy("idempotency_key").agg(F.min("seq").alias("job_of"), F.min_by("tenant_id", "seq").alias("owner"))
    return j.join(first, "idempotency_key").select("id", "job_of", (F.col("tenant_id") != F.col("owner")).alias("conflict"))


@query("m7_temporal_split", "select seq, case when substring(date, 1, 3) >= 'A20' then 'test' else 'train' end as split from corpus", "corpus")
def m7(spark, sf):
    return bind(spark, sf, "corpus").select("seq", F.when(F.substring("date", 1, 3) >= "A20", "test").otherwise("train").alias("split"))

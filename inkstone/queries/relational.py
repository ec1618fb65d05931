"""Queries of sections C, D, E, F and G."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import names as N
from inkstone.operators import relational as R
from inkstone.queries.bindings import bind
from inkstone.queries.registry import query

TOKENS = r"[A-Za-z]{5,}"


@query("c1_job_result_join", "select j.id, count(*) as n_calls from job j join ledger l on j.id = l.job_id group by j.id", "job, ledger")
def c1(spark, sf):
    return bind(spark, sf, "job").join(bind(spark, sf, "ledger"), F.col("id") == F.col("job_id")).groupBy("id").agg(F.count("*").alias("n_calls"))


@query("c2_batch_spend_count", "select count(*) as calls from ledger l join job j on j.id = l.job_id where j.batch_id = '7'", "job, ledger")
def c2(spark, sf):
    jobs = bind(spark, sf, "job").where("batch_id = '7'")
    return bind(spark, sf, "ledger").join(jobs, F.col("id") == F.col("job_id")).agg(F.count("*").alias("calls"))


_CLEAN = r"sha256(regexp_replace({0}.original, '[ \t\n\x0B\f\r]+', '', 'g'))"


@query("c5_golden_hash_join", f"select c.seq, g.seq as gold from corpus c join corpus g on {_CLEAN.format('c')} = {_CLEAN.format('g')} where g.seq % 10 = 0", "corpus")
def c5(spark, sf):
    c = bind(spark, sf, "corpus").select("seq", T.normalized_hash(F.col("original")).alias("h"))
    return c.join(c.where("seq % 10 = 0").withColumnRenamed("seq", "gold"), "h").select("seq", "gold")


@query("c6_common_ids", "select arm, id from arm where id in (select id from arm group by id having count(distinct arm) = 2)", "arm")
def c6(spark, sf):
    return R.in_all_arms(bind(spark, sf, "arm"), n_arms=2).select("arm", "id")


@query("c7_paired_delta", "select a.id, length(b.hypothesis) - length(a.hypothesis) as delta, a.hypothesis <> b.hypothesis as changed from arm a join arm b on a.id = b.id and a.arm = 'a' and b.arm = 'b'", "arm")
def c7(spark, sf):
    arms = bind(spark, sf, "arm")
    a, b = arms.where("arm = 'a'").select("id", F.col("hypothesis").alias("x")), arms.where("arm = 'b'").select("id", F.col("hypothesis").alias("y"))
    return a.join(b, "id").select("id", (F.length("y") - F.length("x")).cast("bigint").alias("delta"), (F.col("x") != F.col("y")).alias("changed"))


@query("c8_neighbour_join", "select a.seq, b.seq - a.seq as off, b.lang = a.lang as same_lang from corpus a join corpus b on b.seq between a.seq - 2 and a.seq + 2 and a.seq <> b.seq", "corpus")
def c8(spark, sf):
    c = bind(spark, sf, "corpus").select("seq", "lang")
    n = R.neighbours(c, 2).join(c.select(F.col("seq").alias("s"), F.col("lang").alias("own")), F.col("seq") == F.col("s"))
    return n.select("seq", F.col("off").cast("bigint").alias("off"), (F.col("other_lang") == F.col("own")).alias("same_lang"))


_KEYS = "select distinct substring(n_name, 1, 4) as key from nation union select distinct lower(substring(n_name, 2, 3)) from nation"


@query("c9_kgram_dictionary_join", f"with k as ({_KEYS}), c as (select seq, string_split(original, '') ch from corpus), g as (select seq, i, ch[i] || ch[i + 1] || ch[i + 2] as g3, ch[i] || ch[i + 1] || ch[i + 2] || ch[i + 3] as g4 from c, unnest(range(1, len(ch) - 1)) t(i)) select seq, key, cast(i as bigint) as place from g join k on key = g3 union all select seq, key, cast(i as bigint) from g join k on key = g4", "corpus")
def c9(spark, sf):
    nation = bind(spark, sf, "nation")
    keys = nation.select(F.substring("n_name", 1, 4).alias("key")).union(nation.select(F.lower(F.substring("n_name", 2, 3)))).distinct()
    found = N.dictionary_hits(bind(spark, sf, "corpus"), keys)
    return found.select("seq", "key", (F.col("start") + 1).cast("bigint").alias("place"))


@query("c11_containment", "select seq, count(*) as names, count(*) filter (where contains(original, r_name) or contains(lower(original), lower(substring(r_name, 1, 2)))) as held from corpus, region group by seq", "corpus")
def c11(spark, sf):
    names = bind(spark, sf, "region").agg(F.array_agg("r_name").alias("names"))  # five names at every scale
    c = bind(spark, sf, "corpus").crossJoin(F.broadcast(names)).select("seq", "original", F.explode("names").alias("r_name"))
    held = F.col("original").contains(F.col("r_name")) | F.lower("original").contains(F.lower(F.substring("r_name", 1, 2)))
    return c.groupBy("seq").agg(F.count("*").alias("names"), F.count(F.when(held, 1)).alias("held"))


@query("c12_anti_join", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def c12(spark, sf):
    return bind(spark, sf, "customer").join(bind(spark, sf, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("c13_work_remaining", "select distinct source || text as todo from documents where doc_id not in (select doc_id from labels)")
def c13(spark, sf):
    return bind(spark, sf, "documents").join(bind(spark, sf, "labels"), "doc_id", "left_anti").select(F.concat("source", "text").alias("todo")).distinct()


@query("c14_first_producer", "select c.seq, f.v as producer from corpus c join (select original, min(seq) v from corpus group by original) f on c.original = f.original where c.seq > f.v", "corpus")
def c14(spark, sf):
    c = bind(spark, sf, "corpus").select("seq", F.sha2("original", 256).alias("h"))
    return c.join(c.groupBy("h").agg(F.min("seq").alias("producer")), "h").where("seq > producer").select("seq", "producer")


@query("c15_priority_merge", "select id, arm from (select * from arm where arm = 'a' union all select * from arm where arm = 'b' and id not in (select id from arm where arm = 'a') and length(hypothesis) >= 200)", "arm")
def c15(spark, sf):
    arms = bind(spark, sf, "arm")
    return R.with_priority(arms.where("arm = 'a'"), arms.where("arm = 'b'"), "id", F.length("hypothesis") < 200).select("id", "arm")


@query("c16_lookup_with_fallback", "select c.c_custkey, coalesce(n.n_name, r.r_name, '?') as named from customer c left join nation n on c.c_nationkey = n.n_nationkey and n.n_nationkey % 2 = 0 left join region r on c.c_nationkey % 7 = r.r_regionkey")
def c16(spark, sf):
    n = bind(spark, sf, "nation").where("n_nationkey % 2 = 0")
    r = bind(spark, sf, "region")
    c = bind(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("c_nationkey") % 7 == F.col("r_regionkey"), "left")
    return c.select("c_custkey", F.coalesce("n_name", "r_name", F.lit("?")).alias("named"))


@query("d1_filtered_counts", "select batch_id, count(*) filter (where status = 'SUCCEEDED') as ok, count(*) filter (where status in ('FAILED', 'DEAD')) as bad from job group by batch_id", "job")
def d1(spark, sf):
    s = F.col("status")
    return bind(spark, sf, "job").groupBy("batch_id").agg(F.count(F.when(s == "SUCCEEDED", 1)).alias("ok"), F.count(F.when(s.isin("FAILED", "DEAD"), 1)).alias("bad"))


@query("d2_group_count", "select coalesce(model_used, '-') as model, quality_grade, count(*) as n from job group by 1, 2", "job")
def d2(spark, sf):
    return bind(spark, sf, "job").groupBy(F.coalesce("model_used", F.lit("-")).alias("model"), "quality_grade").agg(F.count("*").alias("n"))


@query("d3_cost_by_model", "select model, cast(sum(unit_price_in) as decimal(22, 6)) as cost from ledger group by model", "ledger")
def d3(spark, sf):
    return bind(spark, sf, "ledger").groupBy("model").agg(F.sum("unit_price_in").cast("decimal(22,6)").alias("cost"))


@query("d4_most_calls_per_job", "select coalesce(max(c), 0) as most from (select count(*) c from ledger group by job_id)", "ledger")
def d4(spark, sf):
    return bind(spark, sf, "ledger").groupBy("job_id").agg(F.count("*").alias("c")).agg(F.coalesce(F.max("c"), F.lit(0)).alias("most"))


@query("d5_distinct_versions", "select batch_id, array_to_string(list_sort(list(distinct prompt_version)), ',') as versions, count(distinct prompt_version) = 1 as single from job group by batch_id", "job")
def d5(spark, sf):
    return bind(spark, sf, "job").groupBy("batch_id").agg(F.array_join(F.array_sort(F.collect_set("prompt_version")), ",").alias("versions"), (F.countDistinct("prompt_version") == 1).alias("single"))


_WORDS = "select seq, unnest(regexp_extract_all(original, '[A-Za-z]{5,}')) as word from corpus"


def _tokens(spark, sf):
    return bind(spark, sf, "corpus").select("seq", F.explode(F.regexp_extract_all("original", F.lit(TOKENS), F.lit(0))).alias("word"))


@query("d6_top_frequency", f"select word, count(*) as n, min(seq) as first from ({_WORDS}) group by word order by n desc, first, word limit 50", "corpus")
def d6(spark, sf):
    counts = _tokens(spark, sf).groupBy("word").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return counts.orderBy(F.desc("n"), "first", "word").limit(50)


@query("d7_coverage_share", f"with w as (select word, count(*) n from ({_WORDS}) group by word), t as (select n, row_number() over (order by n desc) r from w) select sum(n) filter (where n >= 10) / sum(n) as share_10, sum(n) filter (where r <= 200) / sum(n) as share_top from t", "corpus")
def d7(spark, sf):
    counts = _tokens(spark, sf).groupBy("word").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n")).limit(200).agg(F.sum("n").alias("top"))
    return counts.agg(F.sum(F.when(F.col("n") >= 10, F.col("n"))).alias("a"), F.sum("n").alias("t")).crossJoin(top).select((F.col("a") / F.col("t")).alias("share_10"), (F.col("top") / F.col("t")).alias("share_top"))


@query("d8_prefix_document_frequency", f"select prefix, count(*) as df from (select distinct seq, substring(word, 1, cast(k as bigint)) as prefix from ({_WORDS}), (select unnest([2, 3, 4, 5]) k)) group by prefix", "corpus")
def d8(spark, sf):
    words = F.regexp_extract_all("original", F.lit(TOKENS), F.lit(0))
    prefixes = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(*[F.substring(w, 1, k) for k in (2, 3, 4, 5)]))))
    return bind(spark, sf, "corpus").select(F.explode(prefixes).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("df"))


_HASH = r"sha256(regexp_replace(original, '[ \t\n\x0B\f\r]+', '', 'g'))"


@query("d9_repeat_rate", f"select count(*) as sentences, count(distinct {_HASH}) as distinct_keys, count(*) - count(distinct {_HASH}) as repeats, 100 * (count(*) - count(distinct {_HASH})) / nullif(count(*), 0) as repeat_pct from corpus", "corpus")
def d9(spark, sf):
    h = bind(spark, sf, "corpus").select(T.normalized_hash(F.col("original")).alias("h"))
    a = h.agg(F.count("h").alias("sentences"), F.countDistinct("h").alias("distinct_keys"))
    return a.withColumn("repeats", F.expr("sentences - distinct_keys")).withColumn("repeat_pct", F.try_divide(100 * F.col("repeats"), F.col("sentences")))


@query("d10_group_first_pairs", f"select seq, first as first_seq from (select seq, min(seq) over (partition by {_HASH}) as first from corpus) where seq > first", "corpus")
def d10(spark, sf):
    c = bind(spark, sf, "corpus").select("seq", T.normalized_hash(F.col("original")).alias("h"))
    return c.join(c.groupBy("h").agg(F.min("seq").alias("first_seq")), "h").where("seq > first_seq").select("seq", "first_seq")


@query("d11_capped_histogram", "select least(c, 6) as n_per, count(*) as n from (select count(*) c from ledger group by job_id) group by 1", "ledger")
def d11(spark, sf):
    return bind(spark, sf, "ledger").groupBy("job_id").agg(F.count("*").alias("c")).groupBy(F.least("c", F.lit(6).cast("bigint")).alias("n_per")).agg(F.count("*").alias("n"))


@query("d12_fixed_bins", "select least(cast(floor(value / 10) as bigint), 9) as bin, count(*) as n from events where value >= 0 group by 1")
def d12(spark, sf):
    return bind(spark, sf, "events").where("value >= 0").groupBy(F.least(F.floor(F.col("value") / 10), F.lit(9).cast("bigint")).alias("bin")).agg(F.count("*").alias("n"))


@query("d13_moments", "select event_type, avg(value) as mean, stddev_pop(value) as sd, min(value) as low, max(value) as high from events group by event_type")
def d13(spark, sf):
    return bind(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("d14_positional_quantile", "with s as (select event_type, value, row_number() over (partition by event_type order by value) - 1 r, count(*) over (partition by event_type) n from events) select event_type, max(value) filter (where r = n // 4) as q1, max(value) filter (where r = n // 2) as q2, max(value) filter (where r = 3 * n // 4) as q3 from s group by event_type")
def d14(spark, sf):
    at = {"q1": "n div 4", "q2": "n div 2", "q3": "3 * n div 4"}
    return R.order_statistics(bind(spark, sf, "events"), ["event_type"], "value", {q: (e, e) for q, e in at.items()})


@query("d15_nearest_rank", "with s as (select event_type, value, row_number() over (partition by event_type order by value) - 1 r, count(*) over (partition by event_type) n from events) select event_type, max(value) filter (where r = least(cast(floor(n * 0.95::double) as bigint), n - 1)) as p95 from s group by event_type")
def d15(spark, sf):
    return R.order_statistics(bind(spark, sf, "events"), ["event_type"], "value", {"p95": ("least(floor(n * 0.95D), n - 1)",) * 2})


@query("d16_median_of_rounds", "select variant, median(v) as median from (select variant, round, avg(hit) v from score group by all) group by variant", "score")
def d16(spark, sf):
    return bind(spark, sf, "score").groupBy("variant", "round").agg(F.avg("hit").alias("v")).groupBy("variant").agg(F.median("v").alias("median"))


@query("d17_micro_ratio", "select variant, sum(hit) / nullif(sum(total), 0) as micro from score group by variant", "score")
def d17(spark, sf):
    return bind(spark, sf, "score").groupBy("variant").agg(F.try_divide(F.sum("hit"), F.sum("total")).alias("micro"))


@query("d18_macro_ratio", "select variant, avg(hit / total) as macro from score where total > 0 group by variant", "score")
def d18(spark, sf):
    return bind(spark, sf, "score").where("total > 0").groupBy("variant").agg(F.avg(F.col("hit") / F.col("total")).alias("macro"))


@query("d19_stage_share", "select sum(hit) / sum(total) as share_of_sums, quantile_disc(hit, 0.5) / quantile_disc(total, 0.5) as share_of_medians from score", "score")
def d19(spark, sf):
    s = bind(spark, sf, "score").select("hit", "total")
    half = {"half": ("ceil(n * 0.5D) - 1",) * 2}
    hit, total = (R.order_statistics(s, [], c, half).select(F.col("half").alias(c)) for c in ("hit", "total"))  # one row each
    sums = s.agg((F.sum("hit") / F.sum("total")).alias("share_of_sums"))
    return sums.crossJoin(hit).crossJoin(total).select("share_of_sums", (F.col("hit") / F.col("total")).alias("share_of_medians"))


@query("d21_vote_agreement", f"with c as (select substring(word, 1, 3) as key, lower(substring(word, 4, 2)) as value, count(*) n, min(seq) first from ({_WORDS}) group by 1, 2), r as (select *, row_number() over (partition by key order by n desc, first, value) k, sum(n) over (partition by key) total from c) select key, value as top, n as votes, n / total as agreement from r where k = 1", "corpus")
def d21(spark, sf):
    t = _tokens(spark, sf).select("seq", F.substring("word", 1, 3).alias("key"), F.lower(F.substring("word", 4, 2)).alias("value"))
    counts = t.groupBy("key", "value").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return counts.groupBy("key").agg(F.min_by("value", F.struct(-F.col("n"), "first", "value")).alias("top"), F.max("n").alias("votes"), (F.max("n") / F.sum("n")).alias("agreement"))


@query("d22_mode_per_group", "with c as (select c_nationkey, c_mktsegment, count(*) n, min(c_custkey) f from customer group by 1, 2) select c_nationkey, c_mktsegment as segment from (select *, row_number() over (partition by c_nationkey order by n desc, f) r from c) where r = 1")
def d22(spark, sf):
    v = R.vote(bind(spark, sf, "customer"), "c_nationkey", "c_mktsegment", "c_custkey")
    return v.select("c_nationkey", F.col("top").alias("segment"))


@query("d23_set_aggregation", "select c_nationkey, array_to_string(list_sort(list(distinct c_mktsegment)), ',') as segments from customer group by 1")
def d23(spark, sf):
    return bind(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"))


@query("d24_first_non_null", "select tenant_id, arg_min(model_used, seq) filter (where model_used is not null) as model from job group by tenant_id", "job")
def d24(spark, sf):
    return bind(spark, sf, "job").groupBy("tenant_id").agg(F.min_by("model_used", F.when(F.col("model_used").isNotNull(), F.col("seq"))).alias("model"))


@query("d25_ordered_distinct", "select tenant_id, array_to_string(list(model_used order by f), ',') as models from (select tenant_id, model_used, min(seq) f from job where model_used is not null group by 1, 2) group by tenant_id", "job")
def d25(spark, sf):
    firsts = bind(spark, sf, "job").where("model_used is not null").groupBy("tenant_id", "model_used").agg(F.min("seq").alias("f"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("f", "model_used"))), lambda x: x["model_used"])
    return firsts.groupBy("tenant_id").agg(F.array_join(ordered, ",").alias("models"))


@query("d26_min_with_fallback", "select id, coalesce(case when seq % 3 = 0 then doc_year end, min(doc_year) over (partition by tenant_id)) as born from job", "job")
def d26(spark, sf):
    j = bind(spark, sf, "job")
    least = j.groupBy("tenant_id").agg(F.min("doc_year").alias("least"))
    return j.join(least, "tenant_id").select("id", F.coalesce(F.when(F.col("seq") % 3 == 0, F.col("doc_year")), "least").alias("born"))


@query("d27_match_count_with_examples", "with m as (select seq, lang, substring(original, 1, 40) s from corpus where regexp_matches(original, '(?i)licen[sc]e|rights')), d as (select lang, s, min(seq) f from m group by 1, 2), r as (select *, row_number() over (partition by lang order by f) k from d) select lang, (select count(*) from m where m.lang = r.lang) as n, string_agg(s, '|' order by f) as examples from r where k <= 5 group by lang", "corpus")
def d27(spark, sf):
    m = bind(spark, sf, "corpus").where(F.col("original").rlike("(?i)licen[sc]e|rights")).select("seq", "lang", F.substring("original", 1, 40).alias("s"))
    top = R.top_per_group(m.groupBy("lang", "s").agg(F.min("seq").alias("f")), "lang", [F.col("f")], 5)
    examples = top.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "s"))), lambda x: x["s"]), "|").alias("examples"))
    return m.groupBy("lang").agg(F.count("*").alias("n")).join(examples, "lang")


@query("d28_regex_occurrences", "select source, cast(sum(len(regexp_extract_all(original, '[a-z]+tion[ .,]'))) as bigint) as n from corpus group by source", "corpus")
def d28(spark, sf):
    return bind(spark, sf, "corpus").groupBy("source").agg(F.sum(F.regexp_count("original", F.lit("[a-z]+tion[ .,]"))).alias("n"))


@query("d29_histogram_entropy", "with c as (select least(floor((value - 0) / 50), 9) bin, count(*) n from events group by 1) select sum(-(n / t) * ln(n / t + 1e-8)) as entropy from c, (select sum(n) t from c)")
def d29(spark, sf):
    return R.histogram_entropy(bind(spark, sf, "events"), "value", 10, 0.0, 500.0)


@query("d30_correlations", "select corr(l_quantity, l_extendedprice) as qp, corr(l_quantity, l_discount) as qd, corr(l_extendedprice, l_tax) as pt from lineitem")
def d30(spark, sf):
    return bind(spark, sf, "lineitem").agg(*[F.corr(a, b).alias(n) for a, b, n in (("l_quantity", "l_extendedprice", "qp"), ("l_quantity", "l_discount", "qd"), ("l_extendedprice", "l_tax", "pt"))])


@query("d31_kl_divergence", "with p as (select lang, count(*) / (select count(*) from corpus where seq % 10 = 0) p from corpus where seq % 10 = 0 group by lang), q as (select lang, count(*) / (select count(*) from corpus) q from corpus group by lang) select sum(p * ln(p / q)) as kl from p join q using (lang)", "corpus")
def d31(spark, sf):
    c = bind(spark, sf, "corpus")
    n = c.groupBy("lang").agg(F.count(F.when(F.col("seq") % 10 == 0, 1)).alias("a"), F.count("*").alias("b"))
    total = n.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p, q = F.col("a") / F.col("ta"), F.col("b") / F.col("tb")
    return n.where("a > 0").crossJoin(total).agg(F.sum(p * F.log(p / q)).alias("kl"))


_ROW = "'{\"id\":\"' || id || '\",\"tokens_in\":' || cast(tokens_in as varchar) || '}'"


@query("d33_json_rows", f"select tenant_id, page, '[' || string_agg({_ROW}, ',' order by seq) || ']' as rows from (select *, (row_number() over (partition by tenant_id order by seq) - 1) // 100 as page from job where status = 'DEAD') group by tenant_id, page", "job")
def d33(spark, sf):
    """Pages of 100 rows, so that no cell grows with the table."""
    dead = R.ranked(bind(spark, sf, "job").where("status = 'DEAD'").select("tenant_id", "seq", "id", "tokens_in"), ["tenant_id"], ["seq"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "id", "tokens_in"))), lambda r: F.struct(r["id"].alias("id"), r["tokens_in"].alias("tokens_in")))
    return dead.groupBy("tenant_id", F.expr("rank div 100").alias("page")).agg(F.to_json(ordered).alias("rows"))


@query("d34_grouped_breakdown", "select pattern, arm, count(*) as n, avg(length(hypothesis)) as mean_length from arm group by grouping sets ((), (pattern), (arm), (pattern, arm))", "arm")
def d34(spark, sf):
    a = bind(spark, sf, "arm")
    return a.groupingSets([[], [F.col("pattern")], [F.col("arm")], [F.col("pattern"), F.col("arm")]], "pattern", "arm").agg(F.count("*").alias("n"), F.avg(F.length("hypothesis")).alias("mean_length"))


@query("d35_throughput", "select tenant_id, count(*) * 60000000.0::double / nullif(epoch_us(max(ts)) - epoch_us(min(ts)), 0) as per_minute from rate_event group by tenant_id", "rate_event")
def d35(spark, sf):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return bind(spark, sf, "rate_event").groupBy("tenant_id").agg(F.try_divide(F.count("*") * 60000000.0, us(F.max("ts")) - us(F.min("ts"))).alias("per_minute"))


@query("d37_outlier_thresholds", "with q as (select quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3, avg(value) m, stddev_samp(value) s from events) select count(*) filter (where value < q1 - 1.5 * (q3 - q1)) as iqr, count(*) filter (where value < m - 2 * s) as sd2, count(*) filter (where value < m - s) as sd1, count(*) filter (where value < 20) as fixed from events, q")
def d37(spark, sf):
    e = bind(spark, sf, "events").select("value")
    q = e.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).crossJoin(R.interpolated(e, [], "value", {"q1": 0.25, "q3": 0.75}))  # one row
    rules = {"iqr": "value < q1 - 1.5 * (q3 - q1)", "sd2": "value < m - 2 * s", "sd1": "value < m - s", "fixed": "value < 20"}
    return e.crossJoin(F.broadcast(q)).agg(*[F.count(F.when(F.expr(c), 1)).alias(n) for n, c in rules.items()])


@query("d38_numeric_profile", "select count(value) as n, avg(value) as mean, stddev_samp(value) as sd, min(value) as low, quantile_cont(value, 0.5) as mid, max(value) as high from events")
def d38(spark, sf):
    e = bind(spark, sf, "events").select("value")
    known = e.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))
    return known.crossJoin(R.interpolated(e, [], "value", {"mid": 0.5}))  # one row each


@query("e1_latest_row", "select id, normalized_hash from (select *, row_number() over (partition by normalized_hash order by t desc nulls first, id) r from (select *, case when seq % 13 = 0 then null else completed_at end t from job)) where r = 1", "job")
def e1(spark, sf):
    j = bind(spark, sf, "job").withColumn("t", F.when(F.col("seq") % 13 != 0, F.col("completed_at")))
    return R.latest(j, "normalized_hash", "t", "id").select("id", "normalized_hash")


@query("e2_first_seen", "select min(seq) as seq, idempotency_key from job group by idempotency_key", "job")
def e2(spark, sf):
    return R.first_seen(bind(spark, sf, "job"), "idempotency_key", "seq").select("seq", "idempotency_key")


@query("e3_best_score", "select seq, tokens_in from (select *, row_number() over (partition by idempotency_key order by tokens_in desc, seq) r from job) where r = 1 and tokens_in >= 1000", "job")
def e3(spark, sf):
    return R.best_of(bind(spark, sf, "job"), "idempotency_key", "tokens_in", "seq", 1000).select("seq", "tokens_in")


@query("e6_repeat_rate_by_prefix", f"with f as (select row_number() over (order by seq) as place, row_number() over (partition by {_HASH} order by seq) > 1 as repeated from corpus) select size, count(*) filter (where repeated) as repeats from f, (select unnest([100, 200, 500, 1000, 10000]::bigint[]) size) where place <= size group by size", "corpus")
def e6(spark, sf):
    c = bind(spark, sf, "corpus").select((F.col("seq") + 1).alias("place"), T.normalized_hash(F.col("original")).alias("h"))  # seq is dense from 0
    return R.repeat_rate_by_prefix(R.repeat_flags(c, "h", "place"), "place", [100, 200, 500, 1000, 10000])


@query("e7_structural_repeat", f"select seq, row_number() over (partition by {_HASH} order by seq) > 1 as repeated from corpus", "corpus")
def e7(spark, sf):
    c = bind(spark, sf, "corpus").select("seq", T.normalized_hash(F.col("original")).alias("h"))
    return c.join(c.groupBy("h").agg(F.min("seq").alias("least")), "h").select("seq", (F.col("seq") > F.col("least")).alias("repeated"))


_RANDOM = "('0x' || substring(md5(cast(seq as varchar)), 1, 8))::bigint"
_ORDER = "conv(substring(md5(cast(seq as string)), 1, 8), 16, 10)"


@query("e10_round_robin_sample", f"with s as (select seq, source, {_RANDOM} h from corpus), r as (select *, row_number() over (partition by source order by h, seq) t, count(*) over (partition by source) z from s) select seq, source from r order by t, z desc, source limit 137", "corpus")
def e10(spark, sf):
    c = bind(spark, sf, "corpus").select("seq", "source", F.expr(_ORDER).cast("bigint").alias("h"))
    return R.round_robin(c, "source", F.struct("h", "seq"), 137).select("seq", "source")


@query("e11_proportional_sample", f"with s as (select seq, lang, {_RANDOM} h from corpus), r as (select *, row_number() over (partition by lang order by h, seq) t, count(*) over (partition by lang) z, (select count(*) from s) n from s) select seq, lang from r where t <= round(z * 100 / n)", "corpus")
def e11(spark, sf):
    c = bind(spark, sf, "corpus").select("seq", "lang", F.expr(_ORDER).cast("bigint").alias("h"))
    return R.proportional(c, "lang", F.struct("h", "seq"), 100).select("seq", "lang")


@query("e12_seeded_sample", f"select seq from corpus order by {_RANDOM}, seq limit 100", "corpus")
def e12(spark, sf):
    return bind(spark, sf, "corpus").orderBy(F.expr(_ORDER).cast("bigint"), "seq").limit(100).select("seq")


@query("e13_counterbalanced", "select r as round, case when r % 2 = 1 then 'A,B' else 'B,A' end as arms from range(1, 7) t(r)")
def e13(spark, sf):
    return spark.range(1, 7).select(F.col("id").alias("round"), F.when(F.col("id") % 2 == 1, F.lit("A,B")).otherwise(F.lit("B,A")).alias("arms"))


@query("e14_paired_movers", "with d as (select id, max(case when round = 1 then value end) - max(case when round = 2 then value end) delta from score group by id having count(distinct case when round in (1, 2) then round end) = 2), r as (select *, row_number() over (order by delta, id) low, row_number() over (order by delta desc, id) high from d) select id, delta from r where low <= 5 or high <= 5", "score")
def e14(spark, sf):
    s = bind(spark, sf, "score").where("round in (1, 2)").groupBy("id").agg(F.max(F.when(F.col("round") == 1, F.col("value"))).alias("a"), F.max(F.when(F.col("round") == 2, F.col("value"))).alias("b"))
    d = s.where("a is not null and b is not null").select("id", (F.col("a") - F.col("b")).alias("delta"))
    return d.orderBy("delta", "id").limit(5).unionAll(d.orderBy(F.desc("delta"), "id").limit(5)).distinct()


@query("e16_sliding_count", "select event_id, count(*) over (partition by model order by ts range between interval 60 seconds preceding and current row) as in_window from rate_event", "rate_event")
def e16(spark, sf):
    e = bind(spark, sf, "rate_event").select("event_id", "model", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return R.within_last(e, ["model"], "us", 60_000_000, "in_window").select("event_id", "in_window")


@query("f1_top_k", "select o_custkey, count(*) as n from orders group by o_custkey order by n desc, o_custkey limit 20")
def f1(spark, sf):
    return bind(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(20)


@query("f2_top_per_group", "select o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) r from orders) where r <= 12")
def f2(spark, sf):
    return R.top_per_group(bind(spark, sf, "orders"), "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")], 12).select("o_orderkey", "o_orderpriority")


@query("f3_limit_then_threshold", f"select * from (select word, count(*) as n from ({_WORDS}) group by word order by n desc, word limit 200) where n >= 30", "corpus")
def f3(spark, sf):
    return _tokens(spark, sf).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(200).where("n >= 30")


@query("f4_nulls_last", "select id, row_number() over (order by model_used nulls last, seq) as place from job where batch_id = '3'", "job")
def f4(spark, sf):
    j = bind(spark, sf, "job").where("batch_id = '3'")  # one batch has a bounded number of rows
    return j.select("id", F.row_number().over(Window.partitionBy("batch_id").orderBy(F.asc_nulls_last("model_used"), "seq")).cast("bigint").alias("place"))


@query("f5_categorical_order", "select id from job order by quality_grade <> 'DEGRADED', tokens_in desc, seq limit 40", "job")
def f5(spark, sf):
    return bind(spark, sf, "job").orderBy(F.col("quality_grade") != "DEGRADED", F.desc("tokens_in"), "seq").limit(40).select("id")


@query("f6_longest_first", "select source, array_to_string(list_transform(list_sort(list_distinct(list({'k': -length(lang || cast(seq % 100 as varchar)), 'w': lang || cast(seq % 100 as varchar)}))), lambda x: x.w), ',') as names from corpus group by source", "corpus")
def f6(spark, sf):
    name = F.concat("lang", (F.col("seq") % 100).cast("string"))
    ordered = F.array_sort(F.collect_set(F.struct((-F.length(name)).alias("k"), name.alias("w"))))
    return bind(spark, sf, "corpus").groupBy("source").agg(F.array_join(F.transform(ordered, lambda x: x["w"]), ",").alias("names"))


@query("f7_first_candidates", "select tenant_id, array_to_string(list(id order by seq)[1:3], ',') as ids from (select * from (select *, row_number() over (partition by tenant_id order by seq) r from job) where r <= 10) group by tenant_id", "job")
def f7(spark, sf):
    top = R.top_per_group(bind(spark, sf, "job"), "tenant_id", [F.col("seq")], 10)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"])
    return top.groupBy("tenant_id").agg(F.array_join(F.slice(ids, 1, 3), ",").alias("ids"))


@query("f8_latest_200", "select id from job order by completed_at desc, seq limit 200", "job")
def f8(spark, sf):
    return bind(spark, sf, "job").orderBy(F.desc("completed_at"), "seq").limit(200).select("id")


@query("f9_offset_range", "select seq from corpus where seq between 50 and 149", "corpus")
def f9(spark, sf):
    return bind(spark, sf, "corpus").where(F.col("seq").between(50, 149)).select("seq")


@query("f10_nearest_offset", "select seq, off from (select a.seq, b.seq - a.seq as off, row_number() over (partition by a.seq order by abs(b.seq - a.seq), b.seq - a.seq) r from corpus a join corpus b on b.seq between a.seq - 2 and a.seq + 2 and a.seq <> b.seq where a.lang = b.lang) where r = 1", "corpus")
def f10(spark, sf):
    c = bind(spark, sf, "corpus").select("seq", "lang")
    n = R.neighbours(c, 2).join(c.select(F.col("seq").alias("s"), F.col("lang").alias("own")), F.col("seq") == F.col("s")).where("own = other_lang")
    return n.groupBy("seq").agg(F.min_by("off", F.struct(F.abs("off"), "off")).cast("bigint").alias("off"))


@query("f11_argmin_passing", "select arg_min(variant, (t, variant)) as chosen from (select variant, avg(total) t, avg(hit) h from score group by variant) where h >= 25", "score")
def f11(spark, sf):
    v = bind(spark, sf, "score").groupBy("variant").agg(F.avg("total").alias("t"), F.avg("hit").alias("h")).where("h >= 25")
    return v.agg(F.min_by("variant", F.struct("t", "variant")).alias("chosen"))


@query("g1_intersection", "select id from arm where arm = 'a' intersect select id from arm where arm = 'b'", "arm")
def g1(spark, sf):
    a = bind(spark, sf, "arm")
    return a.where("arm = 'a'").select("id").intersect(a.where("arm = 'b'").select("id"))


@query("g2_union_with_reasons", "select id, array_to_string(list_sort(list(distinct reason)), ',') as reasons from (select seq id, 'five' reason from corpus where seq % 5 = 0 union all select seq, 'lang' from corpus where lang = 'de') group by id", "corpus")
def g2(spark, sf):
    c = bind(spark, sf, "corpus")
    u = c.where("seq % 5 = 0").select(F.col("seq").alias("id"), F.lit("five").alias("reason")).unionByName(c.where("lang = 'de'").select(F.col("seq").alias("id"), F.lit("lang").alias("reason")))
    return u.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


@query("g3_difference", "select id from arm where arm = 'a' and id not in (select id from arm where arm = 'b')", "arm")
def g3(spark, sf):
    a = bind(spark, sf, "arm")
    return a.where("arm = 'a'").select("id").join(a.where("arm = 'b'").select("id"), "id", "left_anti")


@query("g4_multiset_minus", "select a.source, a.n - coalesce(b.n, 0) as n from (select source, count(*) n from corpus where seq % 2 = 0 group by 1) a left join (select source, count(*) n from corpus where seq % 3 = 0 group by 1) b using (source) where a.n > coalesce(b.n, 0)", "corpus")
def g4(spark, sf):
    c = bind(spark, sf, "corpus")
    return R.multiset_minus(c.where("seq % 2 = 0"), c.where("seq % 3 = 0"), "source")


@query("g5_ordered_dedupe", "select seq, array_to_string(list_transform(list_sort(list({'p': p, 'w': w})), lambda x: x.w), ' ') as words from (select seq, w, min(p) p from (select seq, unnest(regexp_extract_all(original, '[A-Z][a-z]+')) w, generate_subscripts(regexp_extract_all(original, '[A-Z][a-z]+'), 1) p from corpus) group by seq, w) group by seq", "corpus")
def g5(spark, sf):
    words = F.array_distinct(F.regexp_extract_all("original", F.lit("[A-Z][a-z]+"), F.lit(0)))
    return bind(spark, sf, "corpus").where(F.size(words) > 0).select("seq", F.array_join(words, " ").alias("words"))


_SETS = "select seq, list_distinct(regexp_extract_all(original, '[A-Z][a-z]{4,}')) a, list_distinct(regexp_extract_all(translation, '[A-Z][a-z]{4,}')) b from pairs"


@query("g6_set_equality_rate", f"select avg(cast(list_sort(a) = list_sort(b) as int)) as equal_rate from ({_SETS})", "pairs")
def g6(spark, sf):
    names = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Z][a-z]{4,}"), F.lit(0))))
    return bind(spark, sf, "pairs").agg(F.avg((names("original") == names("translation")).cast("int")).alias("equal_rate"))


@query("g7_set_recall", f"select sum(len(list_intersect(a, b))) / nullif(sum(len(a)), 0) as recall from ({_SETS})", "pairs")
def g7(spark, sf):
    names = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Z][a-z]{4,}"), F.lit(0)))
    return bind(spark, sf, "pairs").agg(F.try_divide(F.sum(F.size(F.array_intersect(names("original"), names("translation")))), F.sum(F.size(names("original")))).alias("recall"))


@query("g8_bag_union", "select lang, n from (select seq, 'hanja' lang, length(original) n from corpus union all select seq, 'hangul', length(original) from corpus union all select seq, 'mixed', length(original) from corpus)", "corpus")
def g8(spark, sf):
    c = bind(spark, sf, "corpus").select(F.length("original").cast("bigint").alias("n"))
    out = None
    for tag in ("hanja", "hangul", "mixed"):
        part = c.select(F.lit(tag).alias("lang"), "n")
        out = part if out is None else out.unionByName(part)
    return out

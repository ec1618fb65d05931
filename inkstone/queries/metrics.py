"""Queries of section K and the numeric functions H31-H38."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkstone.operators import metrics as M
from inkstone.operators import names as N
from inkstone.operators import relational as R
from inkstone.queries.bindings import bind
from inkstone.queries.registry import query
from inkstone.session import durable

_NOSPACE = "regexp_replace(coalesce({0}, ''), '[ \\t\\n\\x0B\\f\\r]+', '', 'g')"


def _stats(orders: int, hyp: str = "translation", ref: str = "original") -> str:
    side = "select seq, n, substring(t, i, n) gram, {1} h, {2} r from (select seq, " + _NOSPACE + " t from pairs), unnest(range(1, " + str(orders + 1) + ")) a(n), unnest(range(1, length(t) - n + 2)) b(i)"
    return f"""st as materialized (select seq, n, sum(h) hyp, sum(r) ref, sum(least(h, r)) m from
        (select seq, n, gram, sum(h) h, sum(r) r from ({side.format(hyp, 1, 0)} union all {side.format(ref, 0, 1)}) group by seq, n, gram) group by seq, n)"""


_F = "case when p + r > 0 then 100 * 5 * p * r / (4 * p + r) else 0 end"


@query("k1_corpus_chrf", f"with {_stats(6)}, s as (select n, sum(hyp) hyp, sum(ref) ref, sum(m) m from st group by n), a as (select avg(m / hyp) p, avg(m / ref) r from s where hyp > 0 and ref > 0) select {_F} as chrf from a", "pairs")
def k1(spark, sf):
    return M.chrf(M.ngram_stats(bind(spark, sf, "pairs"), "translation", "original", 6), [])


@query("k2_sentence_chrf", f"with {_stats(6)}, a as (select seq, avg(m / hyp) p, avg(m / ref) r from st where hyp > 0 and ref > 0 group by seq) select seq, {_F} as chrf from a", "pairs")
def k2(spark, sf):
    return M.chrf(M.ngram_stats(bind(spark, sf, "pairs"), "translation", "original", 6), ["seq"])


_BLEU = """, s as (select {0} n, sum(hyp) hyp, sum(m) m from st group by {0} n), z as (select *, sum(cast(m = 0 as int)) over ({1} order by n) k from s where hyp > 0),
q as (select {0} sum(ln(case when m > 0 then m / hyp else pow(0.5, k) / hyp end)) l, count(*) o from z group by {2}), len as (select {0} sum(hyp) h, sum(ref) r from st where n = 1 group by {2})"""


@query("k3_corpus_bleu", f"with {_stats(4)}{_BLEU.format('', '', 'all')} select case when o = 4 then 100 * exp(l / 4) * case when h >= r then 1 else exp(1 - r / h) end else 0 end as bleu from q, len", "pairs")
def k3(spark, sf):
    st = M.ngram_stats(bind(spark, sf, "pairs"), "translation", "original", 4)
    lengths = st.where("n = 1").agg(F.sum("hyp").alias("hyp_len"), F.sum("ref").alias("ref_len"))
    return M.bleu(st, lengths, [], effective_order=False)


@query("k4_sentence_bleu", f"with {_stats(4)}{_BLEU.format('seq,', 'partition by seq', 'seq')} select seq, 100 * exp(l / o) * case when h >= r then 1 else exp(1 - r / h) end as bleu from q join len using (seq)", "pairs")
def k4(spark, sf):
    st = M.ngram_stats(bind(spark, sf, "pairs"), "translation", "original", 4)
    lengths = st.where("n = 1").groupBy("seq").agg(F.sum("hyp").alias("hyp_len"), F.sum("ref").alias("ref_len"))
    return M.bleu(st, lengths, ["seq"], effective_order=True)


@query(
    "k7_segment_metrics",
    "with r as (select id, avg(cast(hit > 25 as int)) h, min(round) m from score group by id), e as (select id, h, unnest(list_filter(['all', case when m = 1 then 'in_kb' end, case when m > 1 then 'out_kb' end, case when cast(id as bigint) % 3 = 0 then 'old_gold' end], lambda x: x is not null)) segment from r) select segment, avg(h) as hit, count(*) as names from e group by segment",
    "score",
)
def k7(spark, sf):
    r = bind(spark, sf, "score").groupBy("id").agg(F.avg((F.col("hit") > 25).cast("int")).alias("h"), F.min("round").alias("m"))
    segments = F.array(F.lit("all"), F.when(F.col("m") == 1, F.lit("in_kb")), F.when(F.col("m") > 1, F.lit("out_kb")), F.when(F.col("id").cast("bigint") % 3 == 0, F.lit("old_gold")))
    return r.select("h", F.explode(F.filter(segments, lambda x: x.isNotNull())).alias("segment")).groupBy("segment").agg(F.avg("h").alias("hit"), F.count("*").alias("names"))


_GOLD = "select seq, upper(substring(original, 1, 6)) as gold, case when seq % 4 = 0 then null when seq % 4 = 1 then upper(substring(original, 1, 6)) when seq % 4 = 2 then upper(substring(original, 1, 6)) || 'X' else lower(substring(original, 1, 5)) end as injected, case when seq % 9 = 0 then 'ref_reading' else 'ok' end as status, original from corpus"


def gold(spark, sf):
    g = F.upper(F.substring("original", 1, 6))
    injected = F.when(F.col("seq") % 4 == 1, g).when(F.col("seq") % 4 == 2, F.concat(g, F.lit("X"))).when(F.col("seq") % 4 == 3, F.lower(F.substring("original", 1, 5)))
    return bind(spark, sf, "corpus").select("seq", g.alias("gold"), injected.alias("injected"), F.when(F.col("seq") % 9 == 0, "ref_reading").otherwise("ok").alias("status"), "original")


@query("b15_scored_names", f"select seq from ({_GOLD}) where gold <> '' and status <> 'ref_reading'", "corpus")
def b15(spark, sf):
    return gold(spark, sf).where("gold <> '' and status <> 'ref_reading'").select("seq")


@query("b16_relinked", f"select seq, coalesce(injected <> '' and injected <> gold and not contains(injected, gold), false) as relinked from ({_GOLD})", "corpus")
def b16(spark, sf):
    i, g = F.col("injected"), F.col("gold")
    return gold(spark, sf).select("seq", F.coalesce((i != "") & (i != g) & ~i.contains(g), F.lit(False)).alias("relinked"))


@query("k8_wrong_injected_rate", f"select avg(cast(contains(original, injected) as int)) as wrong_rate from ({_GOLD}) where injected <> gold and not contains(injected, gold)", "corpus")
def k8(spark, sf):
    i, g = F.col("injected"), F.col("gold")
    return gold(spark, sf).where((i != g) & ~i.contains(g)).agg(F.avg(F.col("original").contains(i).cast("int")).alias("wrong_rate"))


@query("l26_gold_summary", f"select status, coalesce(cast(seq % 4 = 0 as int), 0) as segment, count(*) as n, count(*) filter (where injected <> gold) / count(*) as disagree from ({_GOLD}) group by grouping sets ((status), (status, segment)) ".replace("group by grouping sets ((status), (status, segment))", "group by status, segment"), "corpus")
def l26(spark, sf):
    return gold(spark, sf).groupBy("status", (F.col("seq") % 4 == 0).cast("int").alias("segment")).agg(F.count("*").alias("n"), (F.count(F.when(F.col("injected") != F.col("gold"), 1)) / F.count("*")).alias("disagree"))


_U = "('0x' || substring(md5('0-' || cast(it as varchar) || '-' || cast({0} as varchar)), 1, 8))::bigint / 4294967296.0::double"
_W = "(" + " + ".join(f"cast(u >= {c!r}::double as int)" for c in M.POISSON) + ")"


@query(
    "k9_bootstrap_interval",
    f"""with p as materialized (select l_suppkey, sum(l_quantity) h, sum(l_quantity + l_linenumber) t from lineitem group by l_suppkey),
    d as (select it, h, t, {_W} w from (select *, {_U.format("l_suppkey")} u from p, range(0, 2000) a(it))), r as (select it, sum(h * w) / sum(t * w) ratio from d where w > 0 group by it), o as (select ratio, row_number() over (order by ratio) k from r)
    select (select sum(h) / sum(t) from p) as ratio, max(ratio) filter (where k = 51) as low, max(ratio) filter (where k = 1950) as high from o""",
)
def k9(spark, sf):
    """Clusters are drawn: all lines of a supplier together."""
    rows = bind(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("h"), F.sum(F.col("l_quantity") + F.col("l_linenumber")).alias("t"))
    return M.bootstrap_ratio(rows, "h", "t", "l_suppkey")


@query(
    "k10_bootstrap_chrf",
    f"""with {_stats(6)}, u as materialized (select distinct seq from st), w as (select it, seq, {_W} w from (select *, {_U.format("seq")} u from u, range(0, 1000) a(it))),
    s as (select it, st.n, sum(w * hyp) hyp, sum(w * ref) ref, sum(w * m) m from w join st using (seq) where w > 0 group by it, st.n),
    a as (select it, avg(m / hyp) p, avg(m / ref) r from s where hyp > 0 and ref > 0 group by it), f as (select {_F} as x from a)
    select round(median(x), 6) as median, round(min(x), 6) as low, round(max(x), 6) as high from f""",
    "pairs",
)
def k10(spark, sf):
    st = M.ngram_stats(bind(spark, sf, "pairs"), "translation", "original", 6)
    return M.bootstrap_chrf(st, "seq").agg(*[F.round(f("chrf"), 6).alias(name) for f, name in ((F.median, "median"), (F.min, "low"), (F.max, "high"))])  # of 1,000 iterations


@query("k11_non_inferiority", "with m as (select variant, avg(value) v, avg(hit / total) r, count(*) n from score group by variant) select b.variant, case when b.n < 10 then 2 when a.v - b.v <= 2.0 and a.r - b.r <= 0 then 0 else 1 end as exit_code from m a, m b where a.variant = 'p0' and b.variant <> 'p0'", "score")
def k11(spark, sf):
    m = bind(spark, sf, "score").groupBy("variant").agg(F.avg("value").alias("v"), F.avg(F.col("hit") / F.col("total")).alias("r"), F.count("*").alias("n"))
    base = m.where("variant = 'p0'").select(F.col("v").alias("bv"), F.col("r").alias("br"))  # one row
    good = M.not_inferior(F.col("bv"), F.col("v"), 2.0) & M.not_inferior(F.col("br"), F.col("r"), 0.0)
    return m.where("variant <> 'p0'").crossJoin(base).select("variant", F.when(F.col("n") < 10, 2).when(good, 0).otherwise(1).alias("exit_code"))


@query("k12_ablation_verdict", "with m as (select variant, median(value) v, median(hit) h, avg(total) t from score group by variant), b as (select * from m where variant = 'p0') select arg_min(m.variant, (m.t, m.variant)) as chosen, count(*) as passing from m, b where b.v - m.v <= 400 and b.h - m.h <= 0", "score")
def k12(spark, sf):
    s = bind(spark, sf, "score").select("variant", "value", "hit", "total")
    v, h = (R.order_statistics(s, ["variant"], c, {n: R.MEDIAN}) for c, n in (("value", "v"), ("hit", "h")))
    m = s.groupBy("variant").agg(F.avg("total").alias("t")).join(v, "variant").join(h, "variant")
    base = m.where("variant = 'p0'").select(F.col("v").alias("bv"), F.col("h").alias("bh"))  # one row
    ok = M.not_inferior(F.col("bv"), F.col("v"), 400) & M.not_inferior(F.col("bh"), F.col("h"), 0)
    return m.crossJoin(base).where(ok).agg(F.min_by("variant", F.struct("t", "variant")).alias("chosen"), F.count("*").alias("passing"))


@query("k13_registered_hypotheses", "with m as (select variant, avg(hit) h, stddev_samp(hit) / sqrt(count(*)) s from score group by variant) select variant, h - 1.96::double * s > 25.4::double as h1, h + 1.96::double * s < 25.6::double as h2 from m", "score")
def k13(spark, sf):
    m = bind(spark, sf, "score").groupBy("variant").agg(F.avg("hit").alias("h"), (F.stddev_samp("hit") / F.sqrt(F.count("*"))).alias("s"))
    return m.select("variant", (F.col("h") - 1.96 * F.col("s") > 25.4).alias("h1"), (F.col("h") + 1.96 * F.col("s") < 25.6).alias("h2"))


_NAMES = "select seq, list_distinct(regexp_extract_all(original, '[A-Z][a-z]{4,}')) a, list_distinct(regexp_extract_all(translation, '[A-Z][a-z]{4,}')) b from pairs"


@query("k14_ner_precision_recall", f"select cast(sum(len(list_intersect(a, b))) as bigint) as tp, cast(sum(len(b) - len(list_intersect(a, b))) as bigint) as fp, cast(sum(len(a) - len(list_intersect(a, b))) as bigint) as fn from ({_NAMES})", "pairs")
def k14(spark, sf):
    names = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Z][a-z]{4,}"), F.lit(0)))
    a, b = names("original"), names("translation")
    return bind(spark, sf, "pairs").agg(F.sum(F.size(F.array_intersect(a, b))).alias("tp"), F.sum(F.size(F.array_except(b, a))).alias("fp"), F.sum(F.size(F.array_except(a, b))).alias("fn"))


@query("k16_round_check", "select variant, round, count(*) filter (where hit is null) / count(*) <= 0.05 as complete, count(distinct variant) = 1 as single from score group by variant, round", "score")
def k16(spark, sf):
    return bind(spark, sf, "score").groupBy("variant", "round").agg((F.count(F.when(F.col("hit").isNull(), 1)) / F.count("*") <= 0.05).alias("complete"), (F.max("variant") == F.min("variant")).alias("single"))


def distances(queries, vectors, block: int = 512):
    """Euclidean distances ``a, b, distance`` of a stated query set to all other vectors.

    Queries are gathered in blocks of about ``block``. One block is broadcast; of several, each meets the
    vectors slice by slice, so that a task holds one block and one slice's vectors pass it.
    """
    n_blocks = -(-queries.count() // block) or 1
    mine = queries.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))).alias("q"))
    other = vectors.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    if n_blocks == 1:
        met = other.join(F.broadcast(mine))  # one row
    else:
        n_slices = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        mine = mine.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_slices - 1).cast("bigint"))))
        other = other.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))
        met = other.withColumn("slice", F.pmod(F.xxhash64("b"), F.lit(n_slices).cast("bigint"))).join(mine, ["block", "slice"])
    pairs = met.select("b", "y", F.explode("q").alias("q")).where("q.a <> b")
    d = F.sqrt(F.aggregate(F.zip_with("q.x", "y", lambda p, q: (p.cast("double") - q) * (p.cast("double") - q)), F.lit(0.0), lambda s, v: s + v))
    return pairs.select("q.a", "b", d.alias("distance"))


_DISTANCE = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::double - z[2]) * (z[1]::double - z[2]))))"


@query("h38_pairwise_distance", f"select a.vec_id a, b.vec_id b, round({_DISTANCE}, 6) as distance from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0")
def h38(spark, sf):
    """Rows whose id is divisible by 100 against all rows."""
    e = bind(spark, sf, "embeddings")
    return distances(e.where("vec_id % 100 = 0"), e).select("a", "b", F.round("distance", 6).alias("distance"))


@query(
    "k18_selection_diversity",
    f"""with s as materialized (select *, vec_id % 90 + 10 as n_words from embeddings order by -ln((('0x' || substring(md5('42-' || cast(vec_id as varchar)), 1, 8))::bigint + 1) / (4294967297.0::double)), vec_id limit 20),
    d as (select i, var_pop(x::double) v from (select unnest(embedding) x, generate_subscripts(embedding, 1) i from s) group by i)
    select (select round(avg({_DISTANCE}), 6) from s a join s b on a.vec_id < b.vec_id) as mean_distance, (select count(distinct label) from s) as types, (select round(stddev_pop(n_words), 6) from s) as length_sd, (select round(avg(v), 6) from d) as variance""",
)
def k18(spark, sf):
    """Of a selection of 20: what is measured is the selection."""
    e = bind(spark, sf, "embeddings").withColumn("w", F.lit(1)).withColumn("n_words", F.col("vec_id") % 90 + 10)
    chosen = durable(N.weighted_pick(e, "w", "vec_id", 20))
    apart = distances(chosen, chosen).where("a < b").agg(F.round(F.avg("distance"), 6).alias("mean_distance"))
    kinds = chosen.agg(F.count_distinct("label").alias("types"), F.round(F.stddev_pop("n_words"), 6).alias("length_sd"))
    by_dimension = chosen.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.var_pop(F.col("x").cast("double")).alias("v"))
    return apart.crossJoin(kinds).crossJoin(by_dimension.agg(F.round(F.avg("v"), 6).alias("variance")))  # one row each


@query("h37_min_max_scaling", "select event_id, (value - low) / (high - low + 1e-8) as scaled from events, (select min(value) low, max(value) high from events)")
def h37(spark, sf):
    e = bind(spark, sf, "events").select("event_id", "value")
    ends = e.agg(F.min("value").alias("low"), F.max("value").alias("high"))  # one row
    return e.crossJoin(F.broadcast(ends)).select("event_id", ((F.col("value") - F.col("low")) / (F.col("high") - F.col("low") + 1e-8)).alias("scaled"))


@query("h32_call_cost", "select job_id, call_no, model, cast(round(cast(cast(tokens_in * unit_price_in as decimal(28, 10)) / 1000000 as decimal(28, 10)) * 1400, 4) as decimal(18, 4)) as krw from (select *, cast(round(tokens_in * unit_price_in / 1000000, 10) as decimal(28, 10)) as usd from ledger)".replace("cast(round(cast(cast(tokens_in * unit_price_in as decimal(28, 10)) / 1000000 as decimal(28, 10)) * 1400, 4) as decimal(18, 4))", "cast(tokens_in * cast(unit_price_in * 1000000 as bigint) as bigint)"), "ledger")
def h32(spark, sf):
    usd = F.round((F.col("tokens_in") * F.col("unit_price_in")).cast("decimal(38,16)") / 1000000, 10).cast("decimal(28,10)")
    cost = F.round(usd * 1400, 4).cast("decimal(18,4)")
    # in millionths of a millionth of a dollar the product is exact in both engines; the rounded cost is checked against it
    exact = (F.col("tokens_in") * (F.col("unit_price_in") * 1000000).cast("bigint")).cast("bigint")
    checked = F.when(F.assert_true(F.abs(cost.cast("double") - exact.cast("double") * 1400e-12) < 1e-4).isNull(), exact)
    return bind(spark, sf, "ledger").select("job_id", "call_no", "model", checked.alias("krw"))


@query("h33_projection", "select n, n * 0.00128::double as usd, n * 0.00128::double * 1400 as krw, greatest(n * 12.0::double / 50 / 86400, n / 500.0::double) as days from (select count(*) n from corpus)", "corpus")
def h33(spark, sf):
    n = bind(spark, sf, "corpus").agg(F.count("*").alias("n"))
    usd = F.col("n") * F.lit(0.00128)
    return n.select("n", usd.alias("usd"), (usd * 1400).alias("krw"), F.greatest(F.col("n") * F.lit(12.0) / 50 / 86400, F.col("n") / 500.0).alias("days"))


@query("h35_tokens_per_char", "select avg(r) as mean, median(r) as median from (select len(regexp_extract_all(original, '[^ \\t\\n\\x0B\\f\\r]+')) / length(original) r from corpus where length(original) > 0)", "corpus")
def h35(spark, sf):
    r = F.regexp_count("original", F.lit(r"\S+")) / F.length("original")
    rates = durable(bind(spark, sf, "corpus").where(F.length("original") > 0).select(r.alias("r")))  # read twice
    return rates.agg(F.avg("r").alias("mean")).crossJoin(R.order_statistics(rates, [], "r", {"median": R.MEDIAN}))  # one row each


@query(
    "h36_bio_spans",
    """with t as (select event_id, user_id, value, case when event_type = 'signup' then 'B' when event_type in ('click', 'view') then 'I' else 'O' end tag from events), g as (select *, sum(cast(tag <> 'I' as int)) over (partition by user_id order by event_id) grp from t)
    select user_id, cast(grp as bigint) as grp, count(*) as tokens, avg(value) as score from g group by user_id, grp having bool_or(tag = 'B')""",
)
def h36(spark, sf):
    tag = F.when(F.col("event_type") == "signup", "B").when(F.col("event_type").isin("click", "view"), "I").otherwise("O")
    w = Window.partitionBy("user_id").orderBy("event_id")
    g = bind(spark, sf, "events").withColumn("tag", tag).withColumn("grp", F.sum((F.col("tag") != "I").cast("int")).over(w))
    return g.groupBy("user_id", "grp").agg(F.count("*").alias("tokens"), F.avg("value").alias("score"), F.bool_or(F.col("tag") == "B").alias("b")).where("b").drop("b")


@query("l31_multi_arm_table", "with m as (select arm, avg(length(hypothesis)) v, count(*) n from arm group by arm) select arm, n, v, v - (select v from m where arm = 'a') as delta from m", "arm")
def l31(spark, sf):
    m = bind(spark, sf, "arm").groupBy("arm").agg(F.count("*").alias("n"), F.avg(F.length("hypothesis")).alias("v"))
    base = m.where("arm = 'a'").select(F.col("v").alias("b"))  # one row
    return m.crossJoin(base).select("arm", "n", "v", (F.col("v") - F.col("b")).alias("delta"))

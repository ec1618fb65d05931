"""Translation metrics and their statistics: chrF, BLEU, recall families, bootstrap intervals, verdicts.

N-gram counts are taken once per sentence, in the sentence's row, and summed; scores come from the sums, so
a corpus score and its bootstrap need no second pass over texts. Scores follow the published definitions (chrF with
six character orders and beta 2; BLEU with four orders and exponential smoothing).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.session import ship_code

CHRF_ORDER, BETA = 6, 2.0
BLEU_ORDER = 4


def gram_counts(hyp: str, ref: str, n: int) -> tuple[int, int, int]:
    """Character n-grams of both texts, and clipped matches, in code points."""
    h, r = (Counter([t[i : i + n] for i in range(len(t) - n + 1)]) for t in (hyp, ref))
    if len(h) > len(r):
        h, r = r, h
    get = r.get
    return max(0, len(hyp) - n + 1), max(0, len(ref) - n + 1), sum([c if c < (o := get(g, 0)) else o for g, c in h.items()])


_BLANK = re.compile(r"[ \t\n\x0b\f\r]+")


def ngram_stats(pairs: DataFrame, hyp: str, ref: str, orders: int, *, key: str = "seq", spaces: bool = False) -> DataFrame:
    """``key, n, hyp, ref, match``: counts of character n-grams and clipped matches of each row, for the orders that either text has.

    A row's grams are counted in the row, so none of them is shuffled; null texts are empty.
    """
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for k, h, r in zip(*(c.to_pylist() for c in batch.columns)):
                h, r = (t or "" if spaces else _BLANK.sub("", t or "") for t in (h, r))
                for n in range(1, min(orders, max(len(h), len(r))) + 1):
                    keys.append(k)
                    out.append((n, *gram_counts(h, r, n)))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=[key, "n", "hyp", "ref", "match"])

    ship_code(pairs.sparkSession)
    rows = pairs.select(key, F.col(hyp).alias("h"), F.col(ref).alias("r"))
    return rows.mapInArrow(run, f"`{key}` {kind}, n int, hyp bigint, ref bigint, match bigint")


def chrf(stats: DataFrame, by: list[str]) -> DataFrame:
    """``by, chrf`` from summed statistics of each order."""
    sums = stats.groupBy(*by, "n").agg(*[F.sum(c).alias(c) for c in ("hyp", "ref", "match")])
    used = sums.where("hyp > 0 and ref > 0").groupBy(*by).agg(F.avg(F.col("match") / F.col("hyp")).alias("p"), F.avg(F.col("match") / F.col("ref")).alias("r"))
    f = (1 + BETA**2) * F.col("p") * F.col("r") / (BETA**2 * F.col("p") + F.col("r"))
    return used.select(*by, F.when(F.col("p") + F.col("r") > 0, 100 * f).otherwise(F.lit(0.0)).alias("chrf"))


def bleu(stats: DataFrame, lengths: DataFrame, by: list[str], *, effective_order: bool) -> DataFrame:
    """``by, bleu`` from summed statistics; ``lengths`` has by, hyp_len, ref_len.

    An order without matches gets 1 / 2^k of one match, k counting such orders; with effective order,
    orders without any n-gram are left out, else they make the score 0.
    """
    sums = stats.groupBy(*by, "n").agg(F.sum("hyp").alias("hyp"), F.sum("match").alias("match"))
    w = Window.partitionBy(*by).orderBy("n")
    zero = ((F.col("match") == 0) & (F.col("hyp") > 0)).cast("int")
    k = F.sum(zero).over(w)
    p = F.when(F.col("match") > 0, F.col("match") / F.col("hyp")).otherwise(F.pow(F.lit(0.5), k) / F.col("hyp"))
    scored = sums.where("hyp > 0").withColumn("lp", F.log(p)).groupBy(*by).agg(F.sum("lp").alias("s"), F.count("*").alias("orders"))
    parts = scored.join(lengths, by) if by else scored.crossJoin(lengths)  # one row without keys
    mean = F.col("s") / (F.col("orders") if effective_order else F.lit(BLEU_ORDER))
    whole = F.lit(True) if effective_order else F.col("orders") == BLEU_ORDER
    penalty = F.when(F.col("hyp_len") >= F.col("ref_len"), F.lit(1.0)).otherwise(F.exp(1 - F.col("ref_len") / F.col("hyp_len")))
    return parts.select(*by, F.when(whole, 100 * penalty * F.exp(mean)).otherwise(F.lit(0.0)).alias("bleu"))


#: Poisson with mean 1: the chance of at most 0, 1, 2, ... draws.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(10)]


def drawn(rows: DataFrame, key: str, iters: int, seed: int = 0) -> DataFrame:
    """The rows of each bootstrap iteration: ``iter`` and ``w``, how often the iteration draws the row, above 0.

    Each row is drawn a Poisson number of times with mean 1, by a hash of iteration and key that both engines
    share, so iterations need no row numbers and no join, and sums over them combine before they shuffle.
    """

    def draw(i: Column) -> Column:
        mixed = F.md5(F.concat(F.lit(f"{seed}-"), i.cast("string"), F.lit("-"), F.col(key).cast("string")))
        u = F.conv(F.substring(mixed, 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)
        above = lambda c: F.size(F.filter(F.array(*map(F.lit, POISSON)), lambda p: c >= p))
        return F.struct(i.alias("iter"), F.element_at(F.transform(F.array(u), above), 1).cast("bigint").alias("w"))

    every = F.filter(F.transform(F.sequence(F.lit(0), F.lit(iters - 1)), draw), lambda d: d["w"] > 0)
    # few rows make many: spread them first
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).withColumn("_d", F.explode(every)).select(*rows.columns, "_d.iter", "_d.w")


def bootstrap_ratio(rows: DataFrame, hits: str, total: str, order: str, iters: int = 2000, seed: int = 0) -> DataFrame:
    """The ratio of sums and its interval: ``ratio, low, high``.

    The ends are positions int(.025 n) and int(.975 n) - 1 of the sorted iterations. ``rows`` has one row for
    each unit that is drawn, and ``order`` tells them apart.
    """
    per = drawn(rows.select(order, hits, total), order, iters, seed).groupBy("iter").agg(F.try_divide(F.sum(F.col(hits) * F.col("w")), F.sum(F.col(total) * F.col("w"))).alias("ratio"))
    ends = F.array_sort(F.collect_list("ratio"))  # one number for each iteration
    spread = per.agg(F.get(ends, F.lit(int(0.025 * iters))).alias("low"), F.get(ends, F.lit(int(0.975 * iters) - 1)).alias("high"))
    return rows.agg(F.try_divide(F.sum(hits), F.sum(total)).alias("ratio")).crossJoin(spread)


def bootstrap_chrf(stats: DataFrame, key: str, iters: int = 1000, seed: int = 0) -> DataFrame:
    """``iter, chrf`` from weighted sums of per-sentence statistics; texts are not read again."""
    by_row = stats.groupBy(key).agg(F.collect_list(F.struct("n", "hyp", "ref", "match")).alias("s"))  # six orders at most
    weighted = drawn(by_row, key, iters, seed).select("iter", "w", F.explode("s").alias("s"))
    return chrf(weighted.select("iter", "s.n", *[(F.col(f"s.{c}") * F.col("w")).alias(c) for c in ("hyp", "ref", "match")]), ["iter"])


def name_scores(rows: DataFrame, reflected) -> DataFrame:
    """``strict, lenient, macro``: the share of names (``seq, translation, slots``) that a text has, whole or by their
    given part, and the mean of the sentences' strict shares. With the reference as the text it is the ceiling."""
    e = rows.select("seq", "translation", F.explode("slots").alias("s"))
    strict, lenient = F.col("translation").contains(F.col("s.name")).cast("int"), reflected(F.col("translation"), F.col("s.name")).cast("int")
    per = e.groupBy("seq").agg(F.sum(strict).alias("h"), F.sum(lenient).alias("l"), F.count("*").alias("t"))
    return per.agg(F.try_divide(F.sum("h"), F.sum("t")).alias("strict"), F.try_divide(F.sum("l"), F.sum("t")).alias("lenient"), F.avg(F.col("h") / F.col("t")).alias("macro"))


def not_inferior(base: Column, new: Column, tolerance: float) -> Column:
    """Whether a score dropped by no more than a tolerance."""
    return (base - new) <= tolerance

"""Joins, aggregations, windows, sorts and set operations that the analytics compose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.session import durable


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds consecutive numbers from 0 by ``order``, without a window over all rows in one task.

    Rows are sorted within ranges; the ranges' sizes, one number for each partition, give the offsets.
    """
    ordered = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    ordered = durable(ordered.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))  # partitions are numbered once
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ordered.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return ordered.join(offsets, "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def neighbours(df: DataFrame, width: int, order: str = "seq") -> DataFrame:
    """Each row's ``order`` with the rows at most ``width`` places away, itself left out: ``order, off, other.*``.

    Offsets are exploded and joined by equality, so no band join and no cross join is needed.
    """
    offsets = F.explode(F.array(*[F.lit(o) for o in range(-width, width + 1) if o]))
    wanted = df.select(order, offsets.alias("off")).withColumn("_at", F.col(order) + F.col("off"))
    return wanted.join(df.withColumnsRenamed({c: f"other_{c}" for c in df.columns}), F.col("_at") == F.col(f"other_{order}")).drop("_at")


def in_all_arms(arms: DataFrame, key: str = "id", arm: str = "arm", n_arms: int | None = None) -> DataFrame:
    """Rows whose key every arm has."""
    if n_arms is None:
        n_arms = arms.select(arm).distinct().count()
    common = arms.groupBy(key).agg(F.countDistinct(arm).alias("n")).where(F.col("n") == n_arms).select(key)
    return arms.join(common, key, "left_semi")


def with_priority(first: DataFrame, second: DataFrame, key: str, bad: Column) -> DataFrame:
    """All of the first, and of the second what the first lacks and is not bad."""
    return first.unionByName(second.join(first.select(key), key, "left_anti").where(~bad))


def latest(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The latest row of each key; a missing time counts as latest, as PostgreSQL's descending order has it."""
    w = Window.partitionBy(key).orderBy(F.col(time).desc_nulls_first(), tie)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def best_of(df: DataFrame, key: str, score: str, order: str, least: float) -> DataFrame:
    """The best row of each key, then those that reach a score."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), order)
    return df.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) & (F.col(score) >= least)).drop("_n")


def top_frequent(df: DataFrame, value: str, order: str, k: int) -> DataFrame:
    """The k most frequent values, ties by first appearance: ``value, n, first``."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(k)


def vote(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each key, ties by first appearance, and its share: ``key, top, votes, agreement``."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(key).agg(
        F.min_by(value, F.struct(-F.col("n"), "first")).alias("top"), F.max("n").alias("votes"), (F.max("n") / F.sum("n")).alias("agreement")
    )


def chunked(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The rows dealt by range of (group, order), with ``_chunk``: chunks follow the order, so a large group fills many."""
    dealt = df.repartitionByRange(*group, *order).withColumn("_chunk", F.spark_partition_id())
    return durable(dealt)  # partitions are numbered once


def running_total(df: DataFrame, group: list[str], order: list[str], amount: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of a whole number over a group's rows up to each, in an order without ties.

    Sums within chunks of the order plus what earlier chunks hold; no task sees a whole group.
    """
    rows = chunked(df, group, order)
    keys = [f"_g{i}" for i in range(len(group))]
    sums = rows.groupBy(F.col("_chunk").alias("_c"), *[F.col(g).alias(k) for g, k in zip(group, keys)]).agg(F.sum(amount).alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(earlier), F.lit(0))).drop("_s")
    same = F.col("_chunk") == F.col("_c")
    for g, k in zip(group, keys):
        same = same & F.col(g).eqNullSafe(F.col(k))
    within = Window.partitionBy("_chunk", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(sums, same).withColumn(name, F.sum(amount).over(within) + F.col("_before")).drop("_chunk", "_c", "_before", *keys)


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Adds ``name``: the place from 0 of each row in its group, in an order without ties."""
    out = running_total(df.withColumn("_one", F.lit(1).cast("bigint")), group, order, "_one", name)
    return out.withColumn(name, F.col(name) - 1).drop("_one")


def order_statistics(df: DataFrame, group: list[str], value: str, places: dict[str, tuple[str, str]]) -> DataFrame:
    """``group`` with, for each name, the mean of the values at two places from 0, given as SQL over ``n``, the
    group's number of values; equal places give the value itself. Nulls are no values.

    Rows are ranked by ranges of the value, equal values in any order, and only those at the places leave.
    """
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("_v")).withColumn("_tie", F.monotonically_increasing_id())
    rows = ranked(rows, group, ["_v", "_tie"], "_r")
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"))
    met = rows.join(F.broadcast(sizes)) if not group else rows.join(sizes, group)  # without groups one row
    wanted = F.array(*[F.expr(f"cast({p} as bigint)") for pair in places.values() for p in dict.fromkeys(pair)])
    met = met.where(F.array_contains(wanted, F.col("_r")))
    at = lambda p: F.max(F.when(F.col("_r") == F.expr(f"cast({p} as bigint)"), F.col("_v")))
    return met.groupBy(*group).agg(*[(at(low) if low == high else (at(low) + at(high)) / 2).alias(name) for name, (low, high) in places.items()])


def interpolated(df: DataFrame, group: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """``group`` with quantiles that are interpolated between neighbours, as ``percentile`` gives them."""
    ends = {f"{name}_{end}": (f"{f}((n - 1) * {p}D)",) * 2 for name, p in points.items() for end, f in (("low", "floor"), ("high", "ceil"))}
    rows = df.where(F.col(value).isNotNull())
    stats = order_statistics(rows, group, value, ends)
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_size"))
    met = stats.join(F.broadcast(sizes)) if not group else stats.join(sizes, group)  # without groups one row each
    part = lambda p: (F.col("_size") - 1) * F.lit(p) - F.floor((F.col("_size") - 1) * F.lit(p))
    return met.select(*group, *[(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * part(p)).alias(n) for n, p in points.items()])


MEDIAN = ("(n - 1) div 2", "n div 2")


def within_last(df: DataFrame, group: list[str], micros: str, width: int, name: str) -> DataFrame:
    """Adds ``name``: a group's rows whose time, in microseconds, is at most ``width`` before a row's own, and not after it.

    Time is cut into slices of the width; a row is counted in its own slice and seen from the next, so a
    group's window holds two slices, not the whole group.
    """
    slice_ = F.floor(F.col(micros) / F.lit(width))
    seen = df.withColumn("_s", F.explode(F.array(F.struct(slice_.alias("at"), F.lit(True).alias("own")), F.struct((slice_ + 1).alias("at"), F.lit(False).alias("own")))))
    seen = seen.withColumn("_at", F.col("_s.at")).withColumn("_own", F.col("_s.own")).drop("_s")
    w = Window.partitionBy(*group, "_at").orderBy(micros).rangeBetween(-width, 0)
    return seen.withColumn(name, F.count("*").over(w)).where("_own").drop("_at", "_own")


def repeat_flags(df: DataFrame, key: str, order: str) -> DataFrame:
    """Whether an earlier row has the same key; rows without a key never repeat.

    A minimum combines before the shuffle, and the join's hot keys can be split; a window could do neither.
    """
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    joined = df.join(first, key, "left")
    return joined.withColumn("repeated", F.coalesce(F.col(order) > F.col("_first"), F.lit(False))).drop("_first")


def repeat_rate_by_prefix(flags: DataFrame, order: str, sizes: list[int]) -> DataFrame:
    """Repeats among the first rows of each size: ``size, repeats``; ``order`` counts from 1."""
    size = F.explode(F.array(*[F.lit(s).cast("bigint") for s in sizes]))
    return flags.select(order, "repeated", size.alias("size")).where(F.col(order) <= F.col("size")).groupBy("size").agg(F.count(F.when(F.col("repeated"), 1)).alias("repeats"))


def round_robin(df: DataFrame, stratum: str, order: Column, n: int) -> DataFrame:
    """Take one row from each stratum in turn, larger strata first, until there are n."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    # no stratum gives more than n rows, and a limit on the rank is pushed below the shuffle
    ranked = df.withColumn("_turn", F.row_number().over(Window.partitionBy(stratum).orderBy(order))).where(F.col("_turn") <= n).join(sizes, stratum)
    return ranked.orderBy("_turn", F.desc("_size"), stratum).limit(n).drop("_size")


def proportional(df: DataFrame, stratum: str, order: Column, n: int) -> DataFrame:
    """From each stratum its share of n rows, rounded."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    total = df.count()
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy(order))).where(F.col("_rank") <= n)
    out = ranked.join(sizes, stratum)
    return out.where(F.col("_rank") <= F.round(F.col("_size") * n / total)).drop("_rank", "_size")


def multiset_minus(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Positive differences of counts: ``key, n``."""
    left = a.groupBy(key).agg(F.count("*").alias("na"))
    right = b.groupBy(key).agg(F.count("*").alias("nb"))
    return left.join(right, key, "left").select(key, (F.col("na") - F.coalesce("nb", F.lit(0))).alias("n")).where("n > 0")


def top_per_group(df: DataFrame, group: str | list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def histogram_entropy(df: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """Entropy in nats of an equal-width histogram, with 1e-8 added inside the logarithm."""
    b = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1))
    counts = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("p", F.col("n") / total).agg(F.sum(-F.col("p") * F.log(F.col("p") + 1e-8)).alias("entropy"))

"""Knowledge-base mining: names that the base lacks are read off their translations.

Schemas: ``mention`` seq, ord, key, stage, injected (the base's name of a linked mention); ``reading`` name,
readings; ``token`` seq, n, token (what in a row's translation can be a name of n characters); ``surname``
char, fixed. Votes come from two passes over a row's mentions. Exact: the first reading that is one of the
row's tokens. Aligned, for mentions without one: the only token that has the key's length and opens with the
surname's reading, shares a later character with the first reading if the key has three characters or more,
and is neither another mention's name nor read exactly by any mention of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text as T

HIGH_VOTES, HIGH_AGREE = 2, 0.8
MEDIUM_VOTES, MEDIUM_AGREE = 1, 0.6
COMMON_RATIO, COMMON_LEAST = 5, 20


def votes(mentions: DataFrame, readings: DataFrame, tokens: DataFrame, surnames: DataFrame) -> DataFrame:
    """``seq, ord, key, bucket, injected, reading, exact`` of each mention of two or more characters that is missed or
    linked singly; reading is null without a vote."""
    m = mentions.where(F.length("key") >= 2).join(readings, F.col("key") == F.col("name"), "left").drop("name")
    m = m.withColumn("readings", F.coalesce("readings", F.array().cast("array<string>")))
    tried = m.select("seq", "ord", F.posexplode("readings").alias("i", "token"))
    spelled = tokens.select(F.col("seq"), "token").distinct()
    exact = tried.join(spelled, ["seq", "token"]).groupBy("seq", "ord").agg(F.min_by("token", "i").alias("exact"))
    m = m.join(exact, ["seq", "ord"], "left")
    taken = m.where("exact is not null").select("seq", F.col("exact").alias("token"), F.lit(None).cast("string").alias("own"))
    injected = m.where("injected is not null").select("seq", F.col("injected").alias("token"), F.col("injected").alias("own"))
    blocked = taken.unionAll(injected).distinct().withColumnsRenamed({"seq": "bs", "token": "bt"})
    first = F.get("readings", 0)
    opens = m.join(surnames, F.substring("key", 1, 1) == F.col("char"), "left")
    opens = opens.withColumn("opens", F.coalesce("fixed", T.initial_sound(F.substring(first, 1, 1)))).where("exact is null and opens is not null")
    shared = F.exists(F.sequence(F.lit(2), F.length("key")), lambda i: F.substring(F.col("token"), i, F.lit(1)) == F.substring(F.col("first"), i, F.lit(1)))
    near = opens.select("seq", "ord", "key", "injected", "opens", first.alias("first")).join(tokens, "seq").where((F.col("n") == F.length("key")) & F.col("token").startswith(F.col("opens")))
    near = near.where((F.length("key") < 3) | F.col("first").isNull() | shared)
    # a name blocks all mentions but those that it was injected for
    free = near.join(blocked, (F.col("seq") == F.col("bs")) & (F.col("token") == F.col("bt")) & ~F.coalesce(F.col("own") == F.col("injected"), F.lit(False)), "left_anti")
    aligned = free.groupBy("seq", "ord").agg(F.count("*").alias("n"), F.min("token").alias("aligned")).where("n = 1").drop("n")
    bucket = F.when(F.col("stage") == "MISS", "miss").when((F.col("stage") == "SINGLE") & F.col("injected").isNotNull(), "pseudo")
    out = m.join(aligned, ["seq", "ord"], "left").withColumn("bucket", bucket).where("bucket is not null")
    return out.select("seq", "ord", "key", "bucket", "injected", F.coalesce("exact", "aligned").alias("reading"), F.col("exact").isNotNull().alias("exact"))


def tier(votes_: Column, agree: Column, exact_top: Column, common: Column) -> Column:
    """High, Medium or Low of a key: all its votes, the top reading's share, its exact votes, whether it is a common word."""
    high = (votes_ >= HIGH_VOTES) & (agree >= HIGH_AGREE) & ((exact_top >= 1) | (votes_ >= 3))
    medium = (votes_ >= MEDIUM_VOTES) & (agree >= MEDIUM_AGREE)
    return F.when(votes_.isNull() | (votes_ == 0) | common, "Low").when(high, "High").when(medium, "Medium").otherwise("Low")


def summarised(voted: DataFrame, words: DataFrame) -> DataFrame:
    """``bucket, key, tier, reading, agree, votes, exact, n_rows, common, gold``: one row for each mined key.

    Of equal votes the reading first met wins. ``words`` has seq, word: the words of every translation; a top
    reading without exact votes that opens words of more than ``COMMON_RATIO`` times the key's rows, and more
    than ``COMMON_LEAST``, is a common word. ``gold`` is the base's name most often injected.
    """
    at = F.struct("seq", "ord")
    rows = voted.groupBy("bucket", "key").agg(F.count("*").alias("n_rows"))
    names = voted.where("injected is not null").groupBy("bucket", "key", "injected").agg(F.count("*").alias("n"), F.min(at).alias("first"))
    gold = names.groupBy("bucket", "key").agg(F.min_by("injected", F.struct(-F.col("n"), "first")).alias("gold"))
    by_reading = voted.where("reading is not null").groupBy("bucket", "key", "reading").agg(F.count("*").alias("n"), F.count(F.when(F.col("exact"), 1)).alias("e"), F.min(at).alias("first"))
    top = by_reading.groupBy("bucket", "key").agg(
        F.min_by(F.struct("reading", "n", "e"), F.struct(-F.col("n"), "first")).alias("top"), F.sum("n").alias("votes"), F.sum("e").alias("exact")
    )
    asked = top.select(F.col("top.reading").alias("token")).distinct()
    lengths = asked.select(F.length("token").alias("n")).distinct()  # one row for each length of a name
    opens = words.crossJoin(F.broadcast(lengths)).where(F.length("word") >= F.col("n")).select("seq", F.expr("substring(word, 1, n)").alias("token")).distinct()
    spread = opens.join(asked, "token").groupBy("token").agg(F.count("*").alias("df"))
    out = rows.join(top, ["bucket", "key"], "left").join(spread, F.col("top.reading") == F.col("token"), "left").join(gold, ["bucket", "key"], "left")
    common = F.coalesce((F.col("top.e") == 0) & (F.coalesce("df", F.lit(0)) > F.greatest(COMMON_RATIO * F.col("n_rows"), F.lit(COMMON_LEAST).cast("bigint"))), F.lit(False))
    agree = F.col("top.n") / F.col("votes")
    return out.select(
        "bucket",
        "key",
        tier(F.col("votes"), agree, F.col("top.e"), common).alias("tier"),
        F.col("top.reading").alias("reading"),
        F.coalesce(F.round(agree, 3), F.lit(0.0)).alias("agree"),
        F.coalesce("votes", F.lit(0).cast("bigint")).alias("votes"),
        F.coalesce("exact", F.lit(0).cast("bigint")).alias("exact"),
        "n_rows",
        common.alias("common"),
        "gold",
    )


def _share(hit: Column, of: Column) -> Column:
    return F.round(F.try_divide(F.count(F.when(hit, 1)), F.count(F.when(of, 1))), 4)


def _n(c: Column) -> Column:
    return F.count(F.when(c, 1))


def pseudo_precision(mined: DataFrame) -> DataFrame:
    """A. ``part, name, n, right, share``: by tier, whether keys that the base knows were read as the base has them."""
    rows = mined.where("bucket = 'pseudo' and reading is not null").groupBy("tier").agg(F.count("*").alias("n"), _n(F.col("reading") == F.col("gold")).alias("right"))
    return rows.select(F.lit("A").alias("part"), F.col("tier").alias("name"), "n", "right", F.round(F.col("right") / F.col("n"), 4).alias("share"))


def gold_coverage(mined: DataFrame, gold: DataFrame) -> DataFrame:
    """B. By tier (or absent) and by status: gold names outside the base (key, gold, status) and those read rightly.

    ``share`` is the precision of a tier's names, and of a status the share of names with a High key.
    """
    miss = mined.where("bucket = 'miss'").select(F.col("key").alias("k"), "tier", "reading")
    rows = gold.where(F.length("key") >= 2).join(miss, F.col("key") == F.col("k"), "left").withColumn("tier", F.coalesce("tier", F.lit("absent")))
    right = F.coalesce(F.col("reading") == F.col("gold"), F.lit(False))
    high = F.col("tier") == "High"
    by_tier = rows.groupBy("tier").agg(F.count("*").alias("n"), _n(right).alias("right"), _share(right, F.col("tier") != "absent").alias("share"))
    by_status = rows.groupBy("status").agg(F.count("*").alias("n"), _n(right & high).alias("right"), _share(high, F.lit(True)).alias("share"))
    return by_tier.select(F.lit("B tier").alias("part"), F.col("tier").alias("name"), "n", "right", "share").unionAll(by_status.select(F.lit("B status"), "status", "n", "right", "share"))


def mention_coverage(mined: DataFrame) -> DataFrame:
    """C. The mentions of missed keys, and the share of them that High keys have."""
    rows = mined.where("bucket = 'miss'")
    high = F.sum(F.when(F.col("tier") == "High", F.col("n_rows")).otherwise(0))
    return rows.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n"), F.coalesce(high, F.lit(0)).alias("right"), F.round(F.try_divide(high, F.sum("n_rows")), 4).alias("share")).select(F.lit("C").alias("part"), F.lit("High").alias("name"), "n", "right", "share")


def temporal(mined: DataFrame, later: DataFrame) -> DataFrame:
    """D. Keys mined from earlier rows on the missed mentions of later rows: coverage by tier, and how often the
    later translation bears a High key out where it has a vote of its own."""
    known = mined.where("bucket = 'miss'").select(F.col("key").alias("k"), "tier", F.col("reading").alias("mined"))
    rows = later.where("bucket = 'miss'").join(known, F.col("key") == F.col("k"), "left")
    high, every = F.coalesce(F.col("tier") == "High", F.lit(False)), F.lit(True)
    checked = high & F.col("reading").isNotNull()
    right = checked & (F.col("reading") == F.col("mined"))
    one = rows.agg(
        F.array(
            F.struct(F.lit("High").alias("name"), F.count("*").alias("n"), _n(high).alias("right"), _share(high, every).alias("share")),
            F.struct(F.lit("Medium").alias("name"), F.count("*").alias("n"), _n(F.col("tier") == "Medium").alias("right"), _share(F.col("tier") == "Medium", every).alias("share")),
            F.struct(F.lit("High borne out").alias("name"), _n(checked).alias("n"), _n(right).alias("right"), _share(right, checked).alias("share")),
        ).alias("x")
    )
    return one.select(F.explode("x").alias("x")).select(F.lit("D").alias("part"), "x.*")


def coverage(names: DataFrame, master: DataFrame, since: int, until: int, examples: int = 12) -> DataFrame:
    """``part, name, n, share``: names (ord, key, in_kb) outside the base against a master of persons (hanja, active_from, active_to).

    Parts: all names and those outside; the outside ones by whether the master has an active person, one of
    another era, or none; what a larger base could reach; lengths of those in no master; first examples of each class.
    """
    p = master.select(F.col("hanja").alias("h"), ((F.coalesce("active_from", F.lit(0)) <= until) & (F.coalesce("active_to", F.lit(9999)) >= since)).alias("active"))
    p = p.groupBy("h").agg(F.bool_or("active").alias("active"))
    state = F.when(F.col("active").isNull(), "not_in_master").when(F.col("active"), "in_master_active").otherwise("in_master_other_era")
    out = names.where(~F.col("in_kb")).join(p, F.col("key") == F.col("h"), "left").select("ord", "key", state.alias("state"))
    total = names.agg(F.count("*").alias("names"), _n(~F.col("in_kb")).alias("out"))  # one row
    heads = total.select(F.explode(F.array(F.struct(F.lit("names").alias("name"), F.col("names").alias("n"), F.lit(1.0).alias("share")), F.struct(F.lit("out_kb").alias("name"), F.col("out").alias("n"), F.round(F.try_divide("out", "names"), 4).alias("share")))).alias("x"))
    heads = heads.select(F.lit("all").alias("part"), "x.*")
    by_state = out.groupBy("state").agg(F.count("*").alias("n")).select(F.lit("state").alias("part"), F.col("state").alias("name"), "n", F.lit(None).cast("double").alias("share"))
    reach = out.agg(_n(F.col("state") != "not_in_master").alias("n"), F.round(F.try_divide(_n(F.col("state") != "not_in_master"), F.count("*")), 4).alias("share"))
    reach = reach.select(F.lit("ceiling").alias("part"), F.lit("in_master").alias("name"), "n", "share")
    absent = out.where("state = 'not_in_master'").groupBy(F.length("key").cast("string").alias("name")).agg(F.count("*").alias("n"))
    absent = absent.select(F.lit("length").alias("part"), "name", "n", F.lit(None).cast("double").alias("share"))
    shown = None
    for s in ("in_master_active", "in_master_other_era", "not_in_master"):
        few = out.where(F.col("state") == s).orderBy("ord").limit(examples)
        few = few.select(F.concat(F.lit("example "), "state").alias("part"), F.col("key").alias("name"), F.col("ord").alias("n"), F.lit(None).cast("double").alias("share"))
        shown = few if shown is None else shown.unionAll(few)
    return heads.unionAll(by_state).unionAll(reach).unionAll(absent).unionAll(shown)

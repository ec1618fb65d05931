"""Names: rule recognition, dictionary scan, gold resolution, repair, few-shot selection."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkstone.functions import text as T
from inkstone.operators.relational import top_per_group
from inkstone.session import ship_code

# What a prompt says before its linked entities, an office and undecided candidates.
ENTITY_HEADER = "\n[등장 인물 한자→한글]\n"
OFFICE = ("  (관직: ", ")")
UNDECIDED = " → 동명이인 후보 중 문맥으로 판단: "

SPANS = "array<struct<surface:string,start:int,end:int,score:double>>"


def rule_spans(text: str, rules: list[str], score: float = 0.5) -> list[dict]:
    """First groups of the rules in priority order that overlap nothing kept before, by start."""
    kept: list[tuple[int, int, str]] = []
    for rule in rules:
        for m in re.finditer(rule, text):
            a, b = m.span(1)
            if all(b <= x or y <= a for x, y, _ in kept):
                kept.append((a, b, m[1]))
    return [{"surface": s, "start": a, "end": b, "score": score} for a, b, s in sorted(kept)]


def rule_ner(df: DataFrame, text: str, rules: list[str]) -> DataFrame:
    """Adds ``spans``. Offsets are needed, which Spark's regular expressions do not give."""

    def find(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: rule_spans(t or "", rules))

    ship_code(df.sparkSession)
    return df.withColumn("spans", F.pandas_udf(find, SPANS)(F.col(text)))


#: Keys of a dictionary that is sent to every executor: at most this many characters in all.
MOST_KEY_CHARACTERS = 20_000_000


def longest_disjoint(hits: list[tuple[int, int, str]], size: int) -> list[tuple[int, int, str]]:
    """Of dictionary hits (start, end, key) the longest first that overlap none taken, by start; ``size`` is the text's length."""
    used = bytearray(size)
    taken = []
    for a, b, key in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
        if not any(used[a:b]):
            used[a:b] = b"\1" * (b - a)
            taken.append((a, b, key))
    return sorted(taken)


def dictionary_hits(df: DataFrame, keys: DataFrame, text: str = "original", row: str = "seq", disjoint: bool = False) -> DataFrame:
    """``row, start, end, key`` of every place, in code points from 0, where a key of the dictionary stands in a text.

    One pass over each text finds all keys, by an automaton that each worker builds from the dictionary, so only
    hits leave a row. With ``disjoint`` only the longest hits that do not overlap. A dictionary of over
    ``MOST_KEY_CHARACTERS`` is cut into parts by a hash of the key, each of which passes the texts once;
    ``disjoint`` then needs one part. Empty keys and null texts have no hits.
    """
    spark = df.sparkSession
    ship_code(spark)
    known = keys.select(F.col(keys.columns[0]).alias("key")).where("key <> ''").distinct()
    parts = -(-(known.agg(F.sum(F.length("key"))).first()[0] or 0) // MOST_KEY_CHARACTERS) or 1
    if disjoint and parts > 1:
        raise ValueError("the longest disjoint hits need a dictionary of one part")
    kind = df.schema[row].dataType.simpleString()
    out = None
    for p in range(parts):
        part = known if parts == 1 else known.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == p)
        shipped = spark.sparkContext.broadcast([r.key for r in part.collect()])

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for key in shipped.value:
                automaton.add_word(key, key)
            if shipped.value:
                automaton.make_automaton()
            for batch in batches:
                rows, starts, ends, found = [], [], [], []
                for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if not t or not shipped.value:
                        continue
                    hits = [(end + 1 - len(key), end + 1, key) for end, key in automaton.iter(t)]
                    for a, b, key in longest_disjoint(hits, len(t)) if disjoint else hits:
                        rows.append(r)
                        starts.append(a)
                        ends.append(b)
                        found.append(key)
                columns = [pa.array(rows, batch.schema.field(0).type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(found, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[row, "start", "end", "key"])

        hits = df.select(row, text).mapInArrow(run, f"`{row}` {kind}, start int, end int, key string")
        out = hits if out is None else out.unionAll(hits)
    return out


def dictionary_scan(df: DataFrame, keys: DataFrame, text: str = "original", row: str = "seq") -> DataFrame:
    """``row, spans``: longest non-overlapping keys of each text that has any, by start."""
    hits = dictionary_hits(df, keys, text, row, disjoint=True)
    return hits.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("start", "end", "key"))).alias("spans"))


def unescape_entities(text: Column) -> Column:
    """HTML unescape in which two numeric entities that are a surrogate pair make one character."""

    def decode(batch: pd.Series) -> pd.Series:
        def pair(m: re.Match) -> str:
            high, low = int(m[1]), int(m[2])
            return chr(0x10000 + ((high - 0xD800) << 10) + (low - 0xDC00)) if 0xD800 <= high < 0xDC00 <= low < 0xE000 else m[0]

        return batch.map(lambda t: None if t is None else html.unescape(re.sub(r"&#(\d+);&#(\d+);", pair, t)))

    return F.pandas_udf(decode, StringType())(text)


def readings(names: DataFrame, table: DataFrame, surnames: DataFrame) -> DataFrame:
    """``name, readings``: candidate readings of each distinct name, in order, once each.

    ``table`` has char, reading (one character) and gives the library's reading; ``surnames`` has char, fixed: how
    a name of two or more characters that opens with it is read. Then follow both with the initial-sound law. No
    character in the table: no reading. Characters that the table lacks stay.
    """
    chars = names.select("name").distinct().where("name <> ''").select("name", F.posexplode(T.characters(F.col("name"))).alias("i", "char"))
    read = chars.join(table, "char", "left").join(surnames.select(F.col("char"), "fixed"), "char", "left")
    base = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("reading", "char").alias("c")))), lambda x: x["c"]), "")
    rows = read.groupBy("name").agg(base.alias("base"), F.max(F.when(F.col("i") == 0, F.col("fixed"))).alias("fixed"))
    own = F.when((F.length("name") >= 2) & F.col("fixed").isNotNull(), F.concat("fixed", F.substring("base", 2, 1 << 30)))
    found = F.array_compact(F.array("base", own))
    found = F.array_distinct(F.concat(found, F.transform(found, T.initial_sound)))
    readable = (F.col("base") != F.col("name")) & (F.length("base") == F.length("name"))
    return rows.select("name", F.when(readable, found).otherwise(F.array().cast("array<string>")).alias("readings"))


def tokens_of(words: DataFrame, lengths: DataFrame, known: DataFrame, *, particles: tuple[str, ...]) -> DataFrame:
    """``seq, n, token``: what in a row's words (seq, word) can be a name of one of the row's lengths (seq, n), once a row.

    A name opens a word and nothing or a particle follows it; a token that with the next character is one of the
    ``known`` (name) longer names is a part of that name. Names have two characters or more.
    """
    cut = words.join(lengths.where("n >= 2"), "seq").where(F.length("word") >= F.col("n"))
    rest = F.expr("substring(word, n + 1)")
    follows = F.lit(False)
    for p in particles:
        follows = follows | rest.startswith(p)
    cut = cut.where((rest == "") | follows).select("seq", "n", F.expr("substring(word, 1, n)").alias("token"), F.expr("case when length(word) > n then substring(word, 1, n + 1) end").alias("longer"))
    return cut.join(known.select(F.col("name").alias("longer")).distinct(), "longer", "left_anti").select("seq", "n", "token").distinct()


def name_tokens(rows: DataFrame, lengths: tuple[int, ...], known: DataFrame, *, run: str, particles: tuple[str, ...], text: str = "translation") -> DataFrame:
    """``tokens_of`` texts (seq and the text), whose words are what matches ``run``, for the same lengths in every row."""
    words = rows.select("seq", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(run), F.lit(0)))).alias("word"))
    wanted = rows.select("seq", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n")).distinct()
    return tokens_of(words, wanted, known, particles=particles)


def joined_back(verdicts: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """``key, cand_id, verdict, start, stop``: verdicts with the offsets of their candidates.

    ``candidates`` has key, cand_id, start, stop, and for a text without any one row with a null cand_id, which stays as
    its empty row; a verdict on a candidate that is not there goes.
    """
    met = verdicts.join(candidates, [key, "cand_id"]).select(key, "cand_id", "verdict", "start", "stop")
    none = candidates.where("cand_id is null").select(key, "cand_id", F.lit(None).cast("boolean").alias("verdict"), "start", "stop")
    return met.unionByName(none)


def resolve_gold(candidates: DataFrame, key: str = "id") -> DataFrame:
    """The candidate of the first source that has one: ``key, gold, status``; candidates have source rank, reading, status."""
    return candidates.groupBy(key).agg(F.min_by("reading", F.struct("rank", "ord")).alias("gold"), F.min_by("status", F.struct("rank", "ord")).alias("status"))


def repaired(text: Column, gold: Column, library: Column, letters: str = "가-힣") -> Column:
    """A struct of the ``text`` with a wrong reading of a name replaced, and ``state``: already, fixed or unfixable.

    A wrong reading is a run of ``letters`` of the name's length that opens with its surname and is not the name. A
    single one is replaced; of several the first that is the library's reading. Names have two characters or more.
    """
    n = F.length(gold)

    def chunks(chars: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(chars)), lambda i: F.get(chars, i - 1) == F.substring(gold, 1, 1))
        return F.transform(places, lambda i: F.struct(i.alias("i"), F.array_join(F.slice(chars, i, F.greatest(n, F.lit(1))), "").alias("c")))

    # the text is cut into characters once, and a place costs no search from its start
    found = F.when(text != "", F.element_at(F.transform(F.array(T.characters(text)), chunks), 1))
    wrong = F.filter(F.coalesce(found, F.array().cast("array<struct<i:int,c:string>>")), lambda x: (F.length(x["c"]) == n) & (x["c"] != gold) & x["c"].rlike(f"^[{letters}]+$"))
    first = F.get(F.filter(wrong, lambda x: x["c"] == library), 0)
    chosen = F.when(F.size(wrong) == 1, F.get(wrong, 0)).otherwise(first)
    has = text.contains(gold)
    fix = ~has & (n >= 2) & (F.length(text) > 0) & chosen.isNotNull()
    new = F.concat(F.substring(text, F.lit(1), chosen["i"] - 1), gold, F.substring(text, chosen["i"] + n, F.length(text)))
    state = F.when(has, "already").when(F.coalesce(fix, F.lit(False)), "fixed").otherwise("unfixable")
    return F.struct(F.when(state == "fixed", new).otherwise(text).alias("text"), state.alias("state"))


def repair_all(text: Column, entities: Column, letters: str = "가-힣") -> Column:
    """A struct of ``text`` and ``states`` (an array) after repairs for all entities (gold, library), each in what the one before left."""
    start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("states"))

    def step(acc: Column, e: Column) -> Column:
        done = F.transform(F.array(repaired(acc["text"], e["gold"], e["library"], letters)), lambda r: F.struct(r["text"].alias("text"), F.concat(acc["states"], F.array(r["state"])).alias("states")))
        return F.element_at(done, 1)

    return F.aggregate(entities, start, step)


def rendered(original: Column, entities: Column, drop_first: Column) -> Column:
    """A stand-in translation: the surface of each linked entity replaced by its name, in order.

    Entities have surface and name; a blank name is passed over, and with ``drop_first`` so is the first other one.
    """
    named = F.filter(entities, lambda e: F.coalesce(F.trim(e["name"]) != "", F.lit(False)))
    left = F.when(drop_first, F.slice(named, 2, 1 << 30)).otherwise(named)
    return F.aggregate(left, original, lambda acc, e: F.replace(acc, e["surface"], F.trim(e["name"])))


def prompt(block: Column, entities: Column, original: Column) -> Column:
    """A prompt: guide block, one line for each linked entity, and the sentence. Entities have surface, name, office, resolved, others."""

    def line(e: Column) -> Column:
        office = F.when(e["office"].isNotNull(), F.concat(F.lit(OFFICE[0]), e["office"], F.lit(OFFICE[1]))).otherwise(F.lit(""))
        known = F.concat(F.lit("  · "), e["surface"], F.lit(" → "), e["name"], office)
        return F.when(e["resolved"], known).otherwise(F.concat(F.lit("  · "), e["surface"], F.lit(UNDECIDED), F.array_join(e["others"], " / ")))

    lines = F.concat(F.lit(ENTITY_HEADER), F.array_join(F.transform(entities, line), "\n"), F.lit("\n"))
    kb = F.when(F.size(entities) > 0, lines).otherwise(F.lit(""))
    return F.concat(block, kb, original)


def per_query_examples(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """``q, ex``: for each query the pool's rows of its pattern that are nearest in length, one shorter and one as long
    or longer, and the first of each other pattern.

    ``queries`` is a stated query set; both have id, pattern, n, and a query that is in the pool is no example of
    itself. The pool gives the last id and the first two of each pattern and length, so what is put in order is
    a pattern's distinct lengths, as many as texts have at any size of the pool.
    """
    few = top_per_group(pool.select("pattern", "n", "id"), ["pattern", "n"], [F.col("id")], 2)
    firsts = few.groupBy("pattern", "n").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    firsts = firsts.withColumn("b", F.when(F.col("b") != F.col("a"), F.col("b")))
    per = firsts.join(pool.groupBy("pattern", "n").agg(F.max("id").alias("z")), ["pattern", "n"])
    lengths = queries.select("pattern", "n").distinct().join(per, ["pattern", "n"], "full")
    w = Window.partitionBy("pattern").orderBy("n")  # distinct lengths
    lengths = lengths.withColumn("less", F.last("z", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    lengths = lengths.withColumn("more", F.first("a", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    asked = queries.select(F.col("id").alias("q"), "pattern", "n").join(lengths, ["pattern", "n"])
    same = F.when(F.col("a") != F.col("q"), F.col("a")).otherwise(F.col("b"))
    near = asked.select("q", F.explode(F.array("less", F.coalesce(same, "more"))).alias("ex")).where("ex is not null")
    firsts = pool.groupBy("pattern").agg(F.min("id").alias("ex"))  # one row for each pattern
    others = queries.select(F.col("id").alias("q"), F.col("pattern").alias("own")).join(firsts.agg(F.collect_list(F.struct("pattern", "ex")).alias("f")))
    rest = others.select("q", "own", F.explode("f").alias("f")).where("f.pattern <> own").select("q", F.col("f.ex").alias("ex"))
    return near.unionByName(rest).distinct()


def weighted_pick(pool: DataFrame, weight: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows without replacement with chances by weight: the least of -ln(u) / weight, u from a hash of the key."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") + 1) / F.lit(2.0**32 + 1)
    return pool.withColumn("_w", -F.log(u) / F.col(weight)).orderBy("_w", key).limit(k).drop("_w")


def swarm_visits(features, iterations: int = 30, ants: int = 8, seed: int = 42):
    """Visits of a swarm over a bounded pool's scaled features: walkers step to the row that is farthest from what they have met.

    ``features`` is a numpy array on the driver; the pool is a sample whose size the caller sets.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    x = (features - features.min(axis=0)) / (np.ptp(features, axis=0) + 1e-8)
    visits = np.zeros(len(x), dtype=int)
    for _ in range(iterations):
        for _ in range(ants):
            at = int(rng.integers(len(x)))
            gap = np.linalg.norm(x - x[at], axis=1)
            visits[at] += 1
            for _ in range(3):
                at = int(gap.argmax())
                visits[at] += 1
                gap = np.minimum(gap, np.linalg.norm(x - x[at], axis=1))
    return visits


def swarm_selection(pool: DataFrame, key: str, features: list[str], k: int, seed: int = 42) -> DataFrame:
    """k keys of a pool that the caller has cut to a size for the driver, with chances by visits of a swarm plus one."""
    rows = pool.select(key, *features).orderBy(key).toPandas()
    if not len(rows):
        return pool.select(key)
    rows["visits"] = swarm_visits(rows[features].to_numpy(float), seed=seed) + 1
    weighted = pool.sparkSession.createDataFrame(rows[[key, "visits"]])
    return weighted_pick(weighted, "visits", key, k, seed)


def extended_slots(entities: Column, text: Column, kinds: tuple[str, ...]) -> Column:
    """Template over several entity kinds: each surface keeps the kind of its first mention; null without any."""
    chosen = F.filter(entities, lambda e: e["type"].isin(*kinds) & text.contains(e["surface"]))
    surfaces = F.array_distinct(F.transform(chosen, lambda e: e["surface"]))
    first = F.transform(surfaces, lambda s, i: F.struct((-F.length(s)).alias("k"), i.alias("i"), s.alias("key"), F.element_at(F.transform(F.filter(chosen, lambda e: e["surface"] == s), lambda e: e["type"]), 1).alias("type")))
    marked = F.transform(F.array_sort(first), lambda m: F.struct(m["key"].alias("key"), F.concat(F.lit("⟪"), m["type"], (m["i"] + 1).cast("string"), F.lit("⟫")).alias("value")))
    filled = F.aggregate(marked, text, lambda acc, p: F.replace(acc, p["key"], p["value"]))
    return F.when(F.size(surfaces) > 0, filled)

"""Knowledge base: index, entity linking, template slotting, gate, alignment, routing.

Schemas: ``mention`` seq, ord, surface, type; ``kb_index`` surface, pos, kb_id (ids may repeat);
``kb_person`` kb_id, hangul, hanja, active_from, active_to, offices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text as T

MOST_CANDIDATES = 3
_CANDIDATES = "array<struct<pos:int,kb_id:string,since:int,needles:array<string>>>"


def build_index(people: DataFrame, names: tuple[str, ...] = ("hanja", "hangul")) -> DataFrame:
    """``surface, kb_id, ord``: each name and each name without its first character; repeats stay, order is kept."""
    name = F.explode(F.filter(F.array(*[F.col(n) for n in names]), lambda x: x.isNotNull() & (x != "")))
    rows = people.select("kb_id", name.alias("name"))
    short = rows.where(F.length("name") >= 2).select(F.substring("name", 2, 1 << 30).alias("surface"), "kb_id", F.lit(1).alias("ord"))
    return rows.select(F.col("name").alias("surface"), "kb_id", F.lit(0).alias("ord")).unionAll(short)


def candidates(index: DataFrame, people: DataFrame) -> DataFrame:
    """``surface, c``: the entries of each surface in order, with the persons' start and what of their offices a sentence
    may hold (an office's name, and what its first brackets hold); one row a surface."""
    of_office = lambda o: F.array_compact(F.array(F.nullif(T.strip_parens(o), F.lit("")), T.first_paren(o)))
    needles = F.coalesce(F.flatten(F.transform("offices", of_office)), F.array().cast("array<string>"))
    person = people.select(F.col("kb_id").alias("id"), F.coalesce("active_from", F.lit(0)).alias("since"), needles.alias("needles"))
    rows = index.where("kb_id is not null").join(person, F.col("kb_id") == F.col("id"), "left")
    return rows.groupBy("surface").agg(F.array_sort(F.collect_list(F.struct("pos", "kb_id", "since", "needles"))).alias("c"))


def link(mentions: DataFrame, index: DataFrame, people: DataFrame, sentences: DataFrame, ready: DataFrame | None = None) -> DataFrame:
    """Link mentions: SINGLE, TIME, OFFICE, AMBIGUOUS or MISS, with candidate ids.

    One index entry is SINGLE whatever its time. Else candidates active by the sentence's year
    remain (a missing start is 0, the end is ignored); one is TIME. Else candidates with an office
    whose name or first bracketed part stands in the sentence; one is OFFICE. Else AMBIGUOUS, with the
    office matches or the first three candidates in time. ``sentences`` has seq, original, year.

    A mention meets one row of ``candidates`` (``ready``, if the caller has them), so nothing is grouped by mention;
    mentions that carry their sentence's ``year`` meet sentences only where its text must decide.
    """
    rows = mentions if "year" in mentions.columns else mentions.join(sentences.select("seq", "year"), "seq")
    found = rows.join(candidates(index, people) if ready is None else ready, "surface", "left")
    found = found.withColumn("c", F.coalesce("c", F.array().cast(_CANDIDATES)))
    year = F.coalesce("year", F.lit(2147483647))
    timed = found.withColumn("t", F.filter("c", lambda x: F.coalesce(x["since"] <= year, F.lit(False)))).select("seq", "ord", "surface", "type", "c", "t")
    # texts are needed only where two or more candidates remain
    unsure = timed.where((F.size("c") > 1) & (F.size("t") > 1)).join(sentences.select("seq", "original"), "seq")
    held = lambda x: F.coalesce(F.exists(x["needles"], lambda n: F.col("original").contains(n)), F.lit(False))
    unsure = unsure.withColumn("o", F.filter("t", held)).drop("original")
    sure = timed.where((F.size("c") <= 1) | (F.size("t") <= 1)).withColumn("o", F.slice("t", 1, 0))
    n, nt, no = F.size("c"), F.size("t"), F.size("o")
    stage = F.when(n == 0, "MISS").when(n == 1, "SINGLE").when(nt == 1, "TIME").when(no == 1, "OFFICE").otherwise("AMBIGUOUS")
    chosen = F.when(n <= 1, F.col("c")).when(nt == 1, F.col("t")).when(no > 0, F.col("o")).otherwise(F.slice("t", 1, MOST_CANDIDATES))
    out = sure.unionByName(unsure)
    return out.select("seq", "ord", "surface", "type", stage.alias("stage"), F.transform(chosen, lambda x: x["kb_id"]).alias("candidate_ids"))


def confirmed(linked: DataFrame, people: DataFrame) -> DataFrame:
    """Linked persons with one id and a name: ``seq, ord, surface, name``."""
    one = linked.where((F.col("type") == "PER") & F.col("stage").isin("SINGLE", "TIME", "OFFICE"))
    named = people.select("kb_id", F.col("hangul").alias("name")).where(F.trim("name") != "")
    return one.withColumn("kb_id", F.element_at("candidate_ids", 1)).join(named, "kb_id").select("seq", "ord", "surface", "name")


def entities_of(linked: DataFrame, people: DataFrame, sentences: DataFrame) -> DataFrame:
    """Sentences with ``slots``: array of (at, surface, name), one for each confirmed surface in order of first place."""
    c = confirmed(linked, people).groupBy("seq", "surface").agg(F.min_by("name", "ord").alias("name"))
    slots = c.groupBy("seq").agg(F.collect_list(F.struct("surface", "name")).alias("raw"))
    rows = sentences.join(slots, "seq", "left")
    placed = F.transform("raw", lambda e: F.struct(F.instr(F.col("original"), e["surface"]).alias("at"), e["surface"].alias("surface"), e["name"].alias("name")))
    held = F.array_sort(F.filter(placed, lambda e: e["at"] > 0))
    return rows.withColumn("slots", F.coalesce(held, F.filter(placed, lambda e: F.lit(False)), F.array().cast("array<struct<at:int,surface:string,name:string>>"))).drop("raw")


def slot(rows: DataFrame, kind: str = "PER") -> DataFrame:
    """The template of each sentence: confirmed surfaces replaced, longest first, by numbered markers.

    Adds ``template`` and ``template_hash``, null where there is no slot; the number is the slot's place by first occurrence.
    """
    marked = F.transform("slots", lambda s, i: F.struct((-F.length(s["surface"])).alias("k"), i.alias("i"), s["surface"].alias("key"), F.concat(F.lit(f"⟪{kind}"), (i + 1).cast("string"), F.lit("⟫")).alias("value")))
    filled = T.replace_in_order(F.col("original"), F.array_sort(marked))
    out = rows.withColumn("template", F.when(F.size("slots") > 0, filled))
    return out.withColumn("template_hash", F.when(F.col("template").isNotNull(), T.normalized_hash(F.col("template"))))


def templated(translation: Column, slots: Column) -> Column:
    """The translation with each name replaced, longest name first; null if a name is absent at its turn."""
    ordered = F.array_sort(F.transform(slots, lambda s, i: F.struct((-F.length(s["name"])).alias("k"), i.alias("i"), s["name"].alias("name"))))
    mark = lambda s: F.concat(F.lit("⟪PER"), (s["i"] + 1).cast("string"), F.lit("⟫"))
    # a null stays null, so the fold's result is read once
    return F.aggregate(ordered, translation, lambda acc, s: F.when(acc.contains(s["name"]), F.replace(acc, s["name"], mark(s))))


def reinjected(template: Column, slots: Column) -> Column:
    """The template with names for markers and fitting particles; null if a marker is absent or one is left."""
    start = F.struct(template.alias("text"), F.lit(True).alias("ok"), F.lit(1).alias("i"))

    def fill(acc: Column, s: Column) -> Column:
        mark = F.concat(F.lit("⟪PER"), acc["i"].cast("string"), F.lit("⟫"))
        closed = T.has_final_consonant(s["name"])
        # what follows a marker is a particle of two characters, or one at the end of a word
        text = F.replace(acc["text"], F.concat(mark, F.lit("이라")), F.concat(s["name"], F.when(closed, F.lit("이라")).otherwise(F.lit("라"))))
        for a, b in T.PARTICLES:
            fit = F.when(closed, F.lit(a)).otherwise(F.lit(b))
            text = F.regexp_replace(text, F.concat(mark, F.lit(f"[{a}{b}](?![가-힣])")), F.concat(mark, fit))
        text = F.replace(text, mark, s["name"])
        return F.struct(text.alias("text"), (acc["ok"] & acc["text"].contains(mark)).alias("ok"), (acc["i"] + 1).alias("i"))

    done = F.aggregate(slots, start, fill)
    return F.when(done["ok"] & ~done["text"].contains("⟪"), done["text"])


def reflected(text: Column, name: Column) -> Column:
    """Whether a text has a name, or its given part if the name has three characters or more."""
    return text.contains(name) | ((F.length(name) >= 3) & text.contains(F.substring(name, 2, 1 << 30)))


def grade(translation: Column, slots: Column, n_miss: Column) -> Column:
    """REJECTED if blank or a confirmed name is missing, else DEGRADED if an entity was missed, else VERIFIED."""
    missing = F.exists(slots, lambda s: ~reflected(translation, s["name"]))
    blank = translation.isNull() | (F.trim(translation) == "")
    return F.when(blank | missing, "REJECTED").when(n_miss > 0, "DEGRADED").otherwise("VERIFIED")


def corrected(grade_: Column, misaligned: Column, n_miss: Column) -> Column:
    """A rejected but misaligned row is judged by its misses alone."""
    return F.when((grade_ == "REJECTED") & misaligned, F.when(n_miss > 0, "DEGRADED").otherwise("VERIFIED")).otherwise(grade_)


def misaligned(rows: DataFrame, width: int = 2) -> DataFrame:
    """``seq, misaligned``: all of a row's missing names are in one and the same neighbour's translation.

    ``rows`` has seq, translation and slots.
    """
    lacking = rows.select("seq", F.filter("slots", lambda s: ~F.coalesce(reflected(F.col("translation"), s["name"]), F.lit(False))).alias("lack")).where(F.size("lack") > 0)
    around = lacking.select("seq", "lack", F.explode(F.array(*[F.lit(o) for o in range(-width, width + 1) if o])).alias("off"))
    met = around.join(rows.select((F.col("seq")).alias("other"), F.col("translation").alias("near")), F.col("seq") + F.col("off") == F.col("other"))
    hit = met.where(F.forall("lack", lambda s: F.coalesce(reflected(F.col("near"), s["name"]), F.lit(False)))).select("seq").distinct()
    return rows.select("seq").join(hit.withColumn("misaligned", F.lit(True)), "seq", "left").select("seq", F.coalesce("misaligned", F.lit(False)).alias("misaligned"))


def signals(linked: DataFrame, sentences: DataFrame, formulaic: str) -> DataFrame:
    """Routing signals of each sentence: counts by type and stage, and whether a formula matches."""
    per = F.col("type") == "PER"
    one = lambda c: F.count(F.when(c, 1))
    counts = linked.groupBy("seq").agg(
        F.count("*").alias("n_entities"),
        one(per).alias("n_per"),
        one(per & F.col("stage").isin("SINGLE", "TIME", "OFFICE")).alias("n_confirmed"),
        one(per & (F.col("stage") == "MISS")).alias("n_miss"),
        one(per & (F.col("stage") == "AMBIGUOUS")).alias("n_ambiguous"),
    )
    names = ["n_entities", "n_per", "n_confirmed", "n_miss", "n_ambiguous"]
    rows = sentences.select("seq", F.col("original").rlike(formulaic).alias("formulaic")).join(counts, "seq", "left")
    return rows.select("seq", "formulaic", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])


def tier() -> Column:
    """T2 with an ambiguous person, T0 for a formula without entities, else T1."""
    return F.when(F.col("n_ambiguous") > 0, "T2").when((F.col("n_entities") == 0) & F.col("formulaic"), "T0").otherwise("T1")


def tier_plan() -> Column:
    """The rejected rule: misses count as hard too."""
    return F.when((F.col("n_ambiguous") > 0) | (F.col("n_miss") > 0), "T2").when((F.col("n_entities") == 0) & F.col("formulaic"), "T0").otherwise("T1")

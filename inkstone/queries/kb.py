"""Queries of sections L and of the replay operators E4, E5, E8 and E9."""

from __future__ import annotations


from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import kb, replay
from inkstone.operators import metrics as M
from inkstone.operators import mining as mining_ops
from inkstone.operators import names as N
from inkstone.operators import relational as R
from inkstone.queries.bindings import bind, with_tables
from inkstone.queries.registry import query
from inkstone.session import durable

FORMULA = "(?i)licen[sc]e|reserved"

# The same derivation for both engines: capitalised tokens are mentions, an index and persons follow by rule.
_H = "('0x' || substring(md5({0}), 1, 6))::bigint"
CTES = {
    "mention": """select seq, ord, surface, case length(surface) % 5 when 0 then 'LOC' when 1 then 'DAT' else 'PER' end as type
        from (select seq, unnest(x) surface, generate_subscripts(x, 1) ord from (select seq, regexp_extract_all(original, '[A-Z][a-z]{6,}') x from corpus))""",
    "sentence": "select seq, original, 1622 + cast(substring(id, 6, 2) as int) as year from corpus",
    "kb_index": f"select surface, pos, 'P' || surface || cast(pos as varchar) as kb_id from (select distinct surface from mention), unnest(range(1, 1 + {_H.format('surface')} % 4)) t(pos)",
    "kb_person": f"""select kb_id, surface as hanja, upper(surface) as hangul, case when h % 5 = 0 then null else 1600 + h % 60 end as active_from,
        'Zz' || cast(h % 50 as varchar) as office, substring('tionheerthandeing', cast(h % 12 + 1 as bigint), 4) as paren from (select kb_id, surface, {_H.format('kb_id')} h from kb_index)""",
    "cand": """select m.seq, m.ord, m.surface, m.type, i.pos, i.kb_id, coalesce(p.active_from, 0) <= s.year as timed,
        coalesce(p.active_from, 0) <= s.year and (contains(s.original, p.office) or contains(s.original, p.paren)) as held
        from mention m join sentence s using (seq) left join kb_index i using (surface) left join kb_person p using (kb_id)""",
    "linked": """select seq, ord, surface, type, case when n = 0 then 'MISS' when n = 1 then 'SINGLE' when nt = 1 then 'TIME' when no = 1 then 'OFFICE' else 'AMBIGUOUS' end as stage,
        coalesce(case when n <= 1 then a when nt = 1 then t when no > 0 then o else t[1:3] end, []) as ids
        from (select seq, ord, surface, any_value(type) as type, count(kb_id) n, count(*) filter (where timed and kb_id is not null) nt, count(*) filter (where held) no,
        list(kb_id order by pos) filter (where kb_id is not null) a, list(kb_id order by pos) filter (where timed and kb_id is not null) t, list(kb_id order by pos) filter (where held) o from cand group by seq, ord, surface)""",
    "named": """select seq, surface, arg_min(hangul, ord) as name from (select l.*, ids[1] as kb_id from linked l where type = 'PER' and stage in ('SINGLE', 'TIME', 'OFFICE')) join kb_person using (kb_id) group by seq, surface""",
    "slot": "select seq, surface, name, row_number() over (partition by seq order by instr(original, surface), surface, name) as i from named join sentence using (seq) where instr(original, surface) > 0",
    "templ": """select seq, list_reduce(list_concat([any_value(original)], list(surface || '|⟪PER' || cast(i as varchar) || '⟫' order by length(surface) desc, i)),
        lambda acc, x: replace(acc, split_part(x, '|', 1), split_part(x, '|', 2))) as template from slot join sentence using (seq) group by seq""",
    "answer": "select seq, case when seq % 17 = 0 then '' when seq % 5 = 0 then lower(original) else upper(original) end as translation from sentence",
    "missing": "select seq, count(*) filter (where not (contains(translation, name) or (length(name) >= 3 and contains(translation, substring(name, 2))))) as lack from slot join answer using (seq) group by seq",
    "missed": "select seq, count(*) filter (where type = 'PER' and stage = 'MISS') as n_miss from linked group by seq",
    "graded": """select s.seq, case when trim(translation) = '' or coalesce(lack, 0) > 0 then 'REJECTED' when coalesce(n_miss, 0) > 0 then 'DEGRADED' else 'VERIFIED' end as grade, coalesce(n_miss, 0) as n_miss
        from sentence s join answer using (seq) left join missing m on s.seq = m.seq left join missed d on s.seq = d.seq""",
    "near": """select distinct s.seq from slot s join answer a on s.seq = a.seq join answer b on b.seq between s.seq - 2 and s.seq + 2 and b.seq <> s.seq
        where not (contains(a.translation, name) or contains(a.translation, substring(name, 2)))
        group by s.seq, b.seq having bool_and(contains(b.translation, name) or contains(b.translation, substring(name, 2)))""",
    "made": """select seq, list_reduce(list_concat([any_value(translation)], list(name || '|⟪PER' || cast(i as varchar) || '⟫' order by length(name) desc, i)),
        lambda acc, x: case when contains(acc, split_part(x, '|', 1)) then replace(acc, split_part(x, '|', 1), split_part(x, '|', 2)) end) as made from slot join answer using (seq) group by seq""",
    "aligned": """select g.seq, case when grade = 'REJECTED' and g.seq in (select seq from near) then case when n_miss > 0 then 'DEGRADED' else 'VERIFIED' end else grade end as grade, n_miss from graded g""",
    "signal": """select s.seq, regexp_matches(original, '(?i)licen[sc]e|reserved') as formulaic, count(l.seq) as n_entities, count(*) filter (where type = 'PER') as n_per,
        count(*) filter (where type = 'PER' and stage in ('SINGLE', 'TIME', 'OFFICE')) as n_confirmed, count(*) filter (where type = 'PER' and stage = 'MISS') as n_miss,
        count(*) filter (where type = 'PER' and stage = 'AMBIGUOUS') as n_ambiguous from sentence s left join linked l on s.seq = l.seq group by s.seq, original""",
}


#: Templates over two kinds of entities.
EXTENDED = r""", firsts as materialized (select seq, surface, arg_min(type, ord) as type, min(ord) as o from mention where type in ('PER', 'LOC') group by seq, surface),
numbered as materialized (select *, row_number() over (partition by seq order by o) as i from firsts),
filled as (select seq, list_reduce(list_concat([any_value(original)], list(surface || '|⟪' || type || cast(i as varchar) || '⟫' order by length(surface) desc, i)),
    lambda acc, x: replace(acc, split_part(x, '|', 1), split_part(x, '|', 2))) as template from numbered join sentence using (seq) group by seq)"""


def extended(spark, sf):
    """``seq, template`` over persons and places."""
    m = mentions(spark, sf).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("ord", "surface", "type"))).alias("entities"))
    rows = bind(spark, sf, "corpus").select("seq", "original").join(m, "seq")
    return rows.select("seq", N.extended_slots(F.col("entities"), F.col("original"), ("PER", "LOC")).alias("template")).where("template is not null")


def sql(upto: str, body: str, more: str = "") -> str:
    """A statement with the chain of common tables up to one."""
    names = list(CTES)
    chain = names[: names.index(upto) + 1]
    ctes = ",\n".join(f"{n} as materialized ({CTES[n]})" for n in chain)
    return with_tables("corpus", f"with {ctes}{more}\n{body}")


def sentences(spark, sf):
    return bind(spark, sf, "corpus").select("seq", "original", T.catalogue_year(F.col("id")).alias("year"))


def mentions(spark, sf):
    found = F.posexplode(F.regexp_extract_all("original", F.lit("[A-Z][a-z]{6,}"), F.lit(0))).alias("ord", "surface")
    m = bind(spark, sf, "corpus").select("seq", T.catalogue_year(F.col("id")).alias("year"), found)
    kind = F.when(F.length("surface") % 5 == 0, "LOC").when(F.length("surface") % 5 == 1, "DAT").otherwise("PER")
    return m.select("seq", (F.col("ord") + 1).cast("bigint").alias("ord"), "surface", kind.alias("type"), "year")


def _hash(c):
    return F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("bigint")


_LOADED = {}


def loaded(spark, sf, name, make):
    """A knowledge-base table, made once for each application and state of the source's files; new files are loaded anew."""
    files = []
    for f in sorted(bind(spark, sf, "documents").inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        state = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        files.append((f, state.getModificationTime(), state.getLen()))
    key = (spark.sparkContext.applicationId, name, tuple(files))
    if key not in _LOADED:
        _LOADED[key] = durable(make())
    return _LOADED[key]


def index(spark, sf):
    return loaded(spark, sf, "index", lambda: _index(spark, sf))


def people(spark, sf):
    return loaded(spark, sf, "people", lambda: _people(spark, sf))


def _index(spark, sf):
    s = mentions(spark, sf).select("surface").distinct()
    n = _hash(F.col("surface")) % 4
    s = s.where(n > 0).select("surface", F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("pos"))
    return s.withColumn("kb_id", F.concat(F.lit("P"), "surface", F.col("pos").cast("string")))


def _people(spark, sf):
    h = _hash(F.col("kb_id"))
    office = F.concat(F.lit("Zz"), (h % 50).cast("string"), F.lit(" ("), F.substring(F.lit("tionheerthandeing"), (h % 12 + 1).cast("int"), F.lit(4)), F.lit(")"))
    return index(spark, sf).select("kb_id", F.col("surface").alias("hanja"), F.upper("surface").alias("hangul"), F.when(h % 5 != 0, 1600 + h % 60).alias("active_from"), F.array(office).alias("offices"))


def linked(spark, sf):
    ready = loaded(spark, sf, "candidates", lambda: kb.candidates(index(spark, sf), people(spark, sf)))
    return kb.link(mentions(spark, sf), index(spark, sf), people(spark, sf), sentences(spark, sf), ready)


def slotted(spark, sf):
    return kb.slot(kb.entities_of(linked(spark, sf), people(spark, sf), sentences(spark, sf)))


def answer():
    text = F.col("original")
    return F.when(F.col("seq") % 17 == 0, F.lit("")).when(F.col("seq") % 5 == 0, T.simple_lower(text)).otherwise(T.simple_upper(text))


def graded(spark, sf):
    links = durable(linked(spark, sf))  # read twice
    miss = links.groupBy("seq").agg(F.count(F.when((F.col("type") == "PER") & (F.col("stage") == "MISS"), 1)).alias("n_miss"))
    rows = kb.entities_of(links, people(spark, sf), sentences(spark, sf)).join(miss, "seq", "left").withColumn("n_miss", F.coalesce("n_miss", F.lit(0)))
    rows = rows.withColumn("translation", answer())
    return rows.withColumn("grade", kb.grade(F.col("translation"), F.col("slots"), F.col("n_miss")))


@query("c3_mention_index_join", sql("kb_index", "select m.seq, m.ord, i.kb_id from mention m left join kb_index i using (surface)"))
def c3(spark, sf):
    return mentions(spark, sf).join(index(spark, sf), "surface", "left").select("seq", "ord", "kb_id")


@query("c4_candidate_person_join", sql("kb_person", "select i.kb_id, p.active_from from kb_index i left join kb_person p using (kb_id)"))
def c4(spark, sf):
    return index(spark, sf).join(people(spark, sf).select("kb_id", "active_from"), "kb_id", "left").select("kb_id", "active_from")


@query("l1_kb_build", sql("kb_person", "select surface, kb_id, ord from (select hanja as surface, kb_id, 0 as ord from kb_person union all select hangul, kb_id, 0 from kb_person union all select substring(hanja, 2), kb_id, 1 from kb_person union all select substring(hangul, 2), kb_id, 1 from kb_person)"))
def l1(spark, sf):
    return kb.build_index(people(spark, sf))


@query("l2_person_master", "select o_custkey as person, min(o_orderdate) as born, max(o_orderdate) as died, string_agg(s, ',' order by f, s) as offices from (select o_custkey, o_orderdate, first_value(o_orderpriority) over w as s, min(o_orderkey) over (partition by o_custkey, o_orderpriority) as f, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) as r from orders window w as (partition by o_custkey, o_orderpriority order by o_orderkey)) where r >= 1 and r = 1 group by 1")
def l2(spark, sf):
    o = bind(spark, sf, "orders")
    first = o.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("f"), F.min_by("o_orderdate", "o_orderkey").alias("at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("f", "o_orderpriority"))), lambda x: x["o_orderpriority"])
    return first.groupBy(F.col("o_custkey").alias("person")).agg(F.min("at").alias("born"), F.max("at").alias("died"), F.array_join(ordered, ",").alias("offices"))


@query("l3_entity_link", sql("linked", "select seq, ord, surface, stage, array_to_string(ids, ',') as ids from linked"))
def l3(spark, sf):
    return linked(spark, sf).select("seq", "ord", "surface", "stage", F.array_join("candidate_ids", ",").alias("ids"))


@query("d32_stage_distribution", sql("linked", "select stage, count(*) as n from linked group by stage"))
def d32(spark, sf):
    return linked(spark, sf).groupBy("stage").agg(F.count("*").alias("n"))


@query("l4_prepare", sql("linked", "select seq, string_agg(surface || ':' || case when len(ids) = 1 and stage <> 'AMBIGUOUS' then ids[1] else '?' end, ';' order by ord) as kb_block, count(*) filter (where stage = 'MISS') as misses from linked where type = 'PER' group by seq"))
def l4(spark, sf):
    one = F.when((F.size("candidate_ids") == 1) & (F.col("stage") != "AMBIGUOUS"), F.element_at("candidate_ids", 1)).otherwise(F.lit("?"))
    rows = linked(spark, sf).where("type = 'PER'").select("seq", "ord", "stage", F.concat("surface", F.lit(":"), one).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"])
    return rows.groupBy("seq").agg(F.array_join(lines, ";").alias("kb_block"), F.count(F.when(F.col("stage") == "MISS", 1)).alias("misses"))


@query("b1_confirmed_per", sql("named", "select seq, surface, name from named"))
def b1(spark, sf):
    return kb.confirmed(linked(spark, sf), people(spark, sf)).groupBy("seq", "surface").agg(F.min_by("name", "ord").alias("name"))


@query("e4_slot_numbering", sql("slot", "select seq, surface, i from slot"))
def e4(spark, sf):
    rows = kb.entities_of(linked(spark, sf), people(spark, sf), sentences(spark, sf))
    return rows.select("seq", F.posexplode("slots").alias("p", "s")).select("seq", F.col("s.surface").alias("surface"), (F.col("p") + 1).cast("bigint").alias("i"))


@query("l6_template_slotting", sql("templ", r"select seq, template, sha256(regexp_replace(template, '[ \t\n\x0B\f\r]+', '', 'g')) as template_hash from templ"))
def l6(spark, sf):
    return slotted(spark, sf).where("template is not null").select("seq", "template", "template_hash")


@query("l8_translation_templating", sql("made", "select m.seq, replace(made, 'ẞ', 'SS') as template from made m where made is not null"))
def l8(spark, sf):
    rows = kb.entities_of(linked(spark, sf), people(spark, sf), sentences(spark, sf)).where(F.size("slots") > 0).withColumn("translation", answer())
    made = kb.templated(F.col("translation"), F.col("slots"))
    made = F.replace(made, F.lit("ẞ"), F.lit("SS"))
    return rows.select("seq", F.explode(F.array_compact(F.array(made))).alias("template"))  # made once a row, where a filter would make it again


@query("l9_misalignment", sql("near", "select s.seq, s.seq in (select seq from near) as misaligned from sentence s"))
def l9(spark, sf):
    rows = kb.entities_of(linked(spark, sf), people(spark, sf), sentences(spark, sf)).withColumn("translation", answer())
    return kb.misaligned(rows)


# A translation's tail in which the first name is followed by particles and by other words.
_TAIL = " ⟪PER1⟫이라 하고 ⟪PER1⟫을 ⟪PER1⟫이조 ⟪PER1⟫와. ⟪PER1⟫는"
_CLOSED = "(unicode(right(n, 1)) between 44032 and 55203 and (unicode(right(n, 1)) - 44032) % 28 <> 0)"
_FIT = "replace({0}, m || '이라', n || case when c then '이라' else '라' end)"
for _a, _b in T.PARTICLES:
    _FIT = f"regexp_replace({_FIT}, m || '[{_a}{_b}]([^가-힣]|$)', m || case when c then '{_a}' else '{_b}' end || '\\1', 'g')"
_NAMED = f"""named2 as materialized (select seq, i, m, n, {_CLOSED} as c from (select seq, i, '⟪PER' || cast(i as varchar) || '⟫' as m, name || case seq % 3 when 0 then '철' when 1 then '수' else '' end as n from slot)),
filled as (select seq, list_reduce(list_concat([struct_pack(t := template || case when seq % 7 = 0 then ' ⟪PER99⟫' else '{_TAIL}' end, m := '', n := '', c := false)], list(struct_pack(t := '', m := m, n := n, c := c) order by i)),
    lambda acc, x: struct_pack(t := case when contains(acc.t, x.m) then replace({_FIT.format("acc.t").replace("m ||", "x.m ||").replace("n ||", "x.n ||").replace("when c ", "when x.c ")}, x.m, x.n) end, m := '', n := '', c := false)).t as text
    from named2 join templ using (seq) group by seq, template)"""


@query("l10_reinjection", sql("templ", "select seq, text from filled where text is not null and not contains(text, '⟪')", ", " + _NAMED))
def l10(spark, sf):
    """Templates get a tail with particles, or a marker that no name fills; names end in a consonant, a vowel or no Hangul."""
    rows = slotted(spark, sf).where("template is not null")
    ending = F.when(F.col("seq") % 3 == 0, "철").when(F.col("seq") % 3 == 1, "수").otherwise("")
    slots = F.transform("slots", lambda s: F.struct(s["at"].alias("at"), s["surface"].alias("surface"), F.concat(s["name"], ending).alias("name")))
    template = F.concat("template", F.when(F.col("seq") % 7 == 0, " ⟪PER99⟫").otherwise(_TAIL))
    return rows.select("seq", kb.reinjected(template, slots).alias("text")).where("text is not null")


@query("l11_quality_gate", sql("graded", "select seq, grade from graded"))
def l11(spark, sf):
    return graded(spark, sf).select("seq", "grade")


@query("l12_corrected_grade", sql("near", "select seq, case when grade = 'REJECTED' and seq in (select seq from near) then case when n_miss > 0 then 'DEGRADED' else 'VERIFIED' end else grade end as grade from graded"))
def l12(spark, sf):
    rows = graded(spark, sf)
    return rows.join(kb.misaligned(rows), "seq").select("seq", kb.corrected(F.col("grade"), F.col("misaligned"), F.col("n_miss")).alias("grade"))


@query("e5_neighbour_comparison", sql("near", "select count(*) as n from near"))
def e5(spark, sf):
    rows = kb.entities_of(linked(spark, sf), people(spark, sf), sentences(spark, sf)).withColumn("translation", answer())
    return kb.misaligned(rows).agg(F.count(F.when(F.col("misaligned"), 1)).alias("n"))


@query("k5_injected_name_recall", sql("answer", "select count(*) filter (where contains(translation, name)) / nullif(count(*), 0) as recall from slot join answer using (seq)"))
def k5(spark, sf):
    rows = kb.entities_of(linked(spark, sf), people(spark, sf), sentences(spark, sf)).withColumn("translation", answer())
    e = rows.select("translation", F.explode("slots").alias("s"))
    return e.agg(F.try_divide(F.count(F.when(F.col("translation").contains(F.col("s.name")), 1)), F.count("*")).alias("recall"))


_ETS = "select count(*) filter (where strict) / count(*) as strict, count(*) filter (where lenient) / count(*) as lenient, (select avg(r) from (select avg(cast(strict2 as int)) r from (select s.seq, contains({0}, name) strict2 from slot s join {1} using (seq)) group by seq)) as macro from (select contains({0}, name) strict, contains({0}, name) or (length(name) >= 3 and contains({0}, substring(name, 2))) lenient from slot join {1} using (seq))"


@query("k6_ets", sql("answer", _ETS.format("translation", "answer")))
def k6(spark, sf):
    rows = kb.entities_of(linked(spark, sf), people(spark, sf), sentences(spark, sf)).withColumn("translation", answer())
    return M.name_scores(rows, kb.reflected)


@query("k17_reference_ceiling", sql("answer", _ETS.format("reference", "ref"), ", ref as (select seq, case when seq % 4 = 0 then replace(upper(original), 'TH', 'TT') else upper(original) end as reference from sentence)"))
def k17(spark, sf):
    """The reference itself as the text that is scored: what no translation can exceed."""
    reference = F.when(F.col("seq") % 4 == 0, F.replace(F.upper("original"), F.lit("TH"), F.lit("TT"))).otherwise(F.upper("original"))
    rows = kb.entities_of(linked(spark, sf), people(spark, sf), sentences(spark, sf)).withColumn("translation", reference)
    return M.name_scores(rows, kb.reflected)


@query("k15_gate_false_positives", sql("graded", "select avg(cast(grade = 'REJECTED' as int)) as rate from graded where seq in (select seq from slot)"))
def k15(spark, sf):
    return graded(spark, sf).where(F.size("slots") > 0).agg(F.avg((F.col("grade") == "REJECTED").cast("int")).alias("rate"))


@query("l14_routing_signals", sql("signal", "select * from signal"))
def l14(spark, sf):
    return kb.signals(linked(spark, sf), sentences(spark, sf), FORMULA)


_TIER = "case when n_ambiguous > 0 then 'T2' when n_entities = 0 and formulaic then 'T0' else 'T1' end"


@query("l15_tier_decision", sql("signal", f"select seq, {_TIER} as tier, case when n_ambiguous > 0 or n_miss > 0 then 'T2' when n_entities = 0 and formulaic then 'T0' else 'T1' end as tier_plan from signal"))
def l15(spark, sf):
    return kb.signals(linked(spark, sf), sentences(spark, sf), FORMULA).select("seq", kb.tier().alias("tier"), kb.tier_plan().alias("tier_plan"))


@query("l21_routing_report", sql("signal", f"select {_TIER} as tier, count(*) as n, sum(n_miss)::bigint as misses, count(*) / sum(count(*)) over () as share from signal group by 1"))
def l21(spark, sf):
    s = kb.signals(linked(spark, sf), sentences(spark, sf), FORMULA).groupBy(kb.tier().alias("tier")).agg(F.count("*").alias("n"), F.sum("n_miss").alias("misses"))
    total = s.agg(F.sum("n").alias("all"))  # one row
    return s.crossJoin(total).select("tier", "n", "misses", (F.col("n") / F.col("all")).alias("share"))


@query("h41_quota_shares", sql("signal", f"select {_TIER} as tier, count(*) / 500.0::double as days, count(*) / 500.0::double > 1 as over from signal group by 1"))
def h41(spark, sf):
    s = kb.signals(linked(spark, sf), sentences(spark, sf), FORMULA).groupBy(kb.tier().alias("tier")).agg(F.count("*").alias("n"))
    return s.select("tier", (F.col("n") / 500.0).alias("days"), (F.col("n") / 500.0 > 1).alias("over"))


_REPLAY = r""", rows as materialized (select g.seq, sha256(regexp_replace(s.original, '[ \t\n\x0B\f\r]+', '', 'g')) as k, sha256(regexp_replace(t.template, '[ \t\n\x0B\f\r]+', '', 'g')) as t, g.grade, m.made is not null as templatable, m.made
    from aligned g join sentence s using (seq) left join templ t on t.seq = g.seq left join made m on m.seq = g.seq)"""
_REPLAY_SQL = {
    "e8": "select seq, case when coalesce(bool_or(grade <> 'REJECTED') over (partition by k order by seq rows between unbounded preceding and 1 preceding), false) then 'L1' else 'LLM' end as outcome from rows",
}


def replay_rows(spark, sf):
    """Rows for the replay: grades are corrected for misaligned pairs, templates are those of the linked sentences."""
    g = durable(graded(spark, sf))  # read by the correction and by the slots
    t = kb.slot(g).join(kb.misaligned(g), "seq")
    grade = kb.corrected(F.col("grade"), F.col("misaligned"), F.col("n_miss")).alias("grade")
    made = kb.templated(F.col("translation"), F.col("slots")).alias("made")
    return t.select("seq", "original", "slots", "misaligned", F.col("grade").alias("raw_grade"), T.normalized_hash(F.col("original")).alias("l1_key"), "template", "template_hash", grade, made, "n_miss").withColumn("templatable", F.col("made").isNotNull())


@query("e8_l1_replay", sql("aligned", _REPLAY_SQL["e8"], _REPLAY))
def e8(spark, sf):
    return replay.l1_only(replay_rows(spark, sf))


# the sequential cache itself: one step a row, with what it holds as lists
_COUPLED = """, nth as materialized (select *, row_number() over (order by seq) as k2 from rows),
o as (with recursive s as (select 0::bigint as k2, []::varchar[] as l1, []::varchar[] as tl, []::bigint[] as pl, null::bigint as seq, null::varchar as outcome, null::bigint as v
    union all select k2, case when outcome = 'LLM' and grade <> 'REJECTED' then list_append(l1, k) else l1 end, case when store then list_append(tl, t) else tl end, case when store then list_append(pl, seq) else pl end, seq, outcome, v
    from (select *, outcome = 'LLM' and grade = 'VERIFIED' and templatable and t is not null as store from
        (select r.k2, r.k, r.t, r.grade, r.templatable, r.seq, s.l1, s.tl, s.pl, case when list_contains(s.l1, r.k) then 'L1' when list_contains(s.tl, r.t) then 'L2' else 'LLM' end as outcome,
            case when not list_contains(s.l1, r.k) and list_contains(s.tl, r.t) then s.pl[list_position(s.tl, r.t)] end as v from s join nth r on r.k2 = s.k2 + 1)))
    select seq, outcome, v from s where k2 > 0)"""


def replayed(spark, sf):
    rows = durable(replay_rows(spark, sf))  # the replay reads it several times
    return rows, replay.coupled(rows)


@query("e9_coupled_replay", sql("aligned", "select seq, outcome, v as producer from o", _REPLAY + _COUPLED))
def e9(spark, sf):
    return replayed(spark, sf)[1]


@query("d36_replay_tally", sql("aligned", "select outcome, count(*) as n from o group by outcome", _REPLAY + _COUPLED))
def d36(spark, sf):
    return replayed(spark, sf)[1].groupBy("outcome").agg(F.count("*").alias("n"))


_KRW = "* (820 * 0.30::double + 266 * 2.50::double) / 1e6 * 1400"


def _krw(calls):
    return calls * (820 * F.lit(0.30) + 266 * F.lit(2.50)) / 1e6 * 1400


@query("h34_replay_cost", sql("aligned", f"select count(*) filter (where outcome = 'LLM') {_KRW} as krw from o", _REPLAY + _COUPLED))
def h34(spark, sf):
    calls = replayed(spark, sf)[1].agg(F.count(F.when(F.col("outcome") == "LLM", 1)).alias("calls"))
    return calls.select(_krw(F.col("calls")).alias("krw"))


@query("a20_cache_pair_dump", sql("aligned", "select o.seq, v as producer, sha256(a.original) as hit_text, sha256(b.original) as producer_text from o join sentence a on a.seq = o.seq join sentence b on b.seq = v where outcome = 'L2' and o.seq not in (select seq from near) and v not in (select seq from near)", _REPLAY + _COUPLED))
def a20(spark, sf):
    """Pairs of which neither sentence is misaligned."""
    rows, out = replayed(spark, sf)
    good = rows.where("not misaligned").select(F.col("seq").alias("s"), F.sha2("original", 256).alias("h"))
    hits = out.where("outcome = 'L2'").join(good, F.col("seq") == F.col("s")).select("seq", "producer", F.col("h").alias("hit_text"))
    return hits.join(good.withColumnRenamed("h", "producer_text"), F.col("producer") == F.col("s")).drop("s")


# one stored entry in five is damaged, one in three has a marker too many; one sentence in six is not to be looked up
_LOOKUP = """, store as materialized (select p.seq as v, r.t, case when p.seq % 5 = 0 then null when p.seq % 3 = 0 then r.made || '⟪PER98⟫' else r.made end as body
    from (select t, min(seq) as seq from (select o.seq, r.t from o join rows r using (seq) where outcome = 'LLM' and grade = 'VERIFIED' and templatable and t is not null) group by t) p join rows r on r.seq = p.seq),
served as (select r.seq, r.t, st.v, st.body, list_reduce(list_concat([any_value(st.body)], list('⟪PER' || cast(i as varchar) || '⟫|' || name order by i)), lambda acc, x: case when contains(acc, split_part(x, '|', 1)) then replace(acc, split_part(x, '|', 1), split_part(x, '|', 2)) end) as text
    from rows r join slot using (seq) left join store st on st.t = r.t and st.v < r.seq group by r.seq, r.t, st.v, st.body),
looked as (select r.seq, r.t as template_hash, case when r.t is null then 'not_eligible' when r.seq % 6 = 0 then 'disabled' when s.v is null then 'miss' when s.body is null then 'abort_deserialize' when s.text is null or contains(s.text, '⟪') then 'abort_structure'
    when exists (select 1 from slot x where x.seq = r.seq and not (contains(s.text, x.name) or (length(x.name) >= 3 and contains(s.text, substring(x.name, 2))))) then 'abort_gate' else 'hit' end as state from rows r left join served s using (seq))"""


def looked_up(spark, sf):
    rows, out = replayed(spark, sf)
    calls = out.where("outcome = 'LLM'").select(F.col("seq").alias("called"))
    stored = rows.join(calls, F.col("seq") == F.col("called")).where("grade = 'VERIFIED' and templatable and template_hash is not null")
    first = stored.groupBy("template_hash").agg(F.min_by(F.struct("seq", "made"), "seq").alias("p"))
    body = F.to_json(F.struct(F.concat("p.made", F.when((F.col("p.seq") % 3 == 0) & (F.col("p.seq") % 5 != 0), "⟪PER98⟫").otherwise("")).alias("template")))
    store = first.select(F.col("template_hash").alias("t"), F.col("p.seq").alias("v"), F.when(F.col("p.seq") % 5 == 0, F.expr("substring({0}, 1, 9)".format("to_json(struct(p.made as template))"))).otherwise(body).alias("body"))
    met = rows.join(store, (F.col("template_hash") == F.col("t")) & (F.col("v") < F.col("seq")), "left")
    met = met.withColumn("cached", F.from_json("body", "template string")["template"])
    met = met.withColumn("served", kb.reinjected(F.col("cached"), F.col("slots")))
    met = met.withColumn("verdict", kb.grade(F.col("served"), F.col("slots"), F.col("n_miss")))
    state = replay.lookup_state(F.col("slots"), F.col("seq") % 6 != 0, F.col("body"), F.col("cached"), F.col("served"), F.col("verdict"))
    return met.select("seq", "template_hash", state.alias("state"))


@query("l19_lookup_states", sql("aligned", "select * from looked", _REPLAY + _COUPLED + _LOOKUP))
def l19(spark, sf):
    """Every sentence's template lookup; a lookup that is switched off still gives the hash."""
    return looked_up(spark, sf)


@query("l19b_lookup_rates", sql("aligned", "select count(*) filter (where looked_up) as lookups, count(*) filter (where state = 'hit') as hits, count(*) filter (where looked_up and state <> 'hit') as misses, count(*) filter (where state = 'hit') / nullif(count(*) filter (where looked_up), 0) as hit_rate from (select *, state not in ('not_eligible', 'disabled') as looked_up from looked)", _REPLAY + _COUPLED + _LOOKUP))
def l19b(spark, sf):
    return replay.lookup_rates(looked_up(spark, sf))


@query("l18_cache_policy", sql("graded", "select seq, grade <> 'REJECTED' and trim(translation) <> '' and seq % 6 <> 0 as store_l1, grade = 'VERIFIED' and seq in (select seq from slot) and seq % 6 <> 0 as store_l2 from graded join answer using (seq)"))
def l18(spark, sf):
    g = graded(spark, sf)
    real = F.col("seq") % 6 != 0  # answers of fake models and of callers' own keys are not stored
    return g.select("seq", ((F.col("grade") != "REJECTED") & (F.trim("translation") != "") & real).alias("store_l1"), ((F.col("grade") == "VERIFIED") & (F.size("slots") > 0) & real).alias("store_l2"))


_SIZES = [100, 200, 500, 1000, 2000, 5000, 10000, 20000, 40000]
_PREFIX = " union all ".join(
    f"select 'l1_repeats_{n}', case when count(*) = {n} then count(*) - count(distinct k) end from nth where k2 <= {n} union all select 'l2_repeats_{n}', case when count(*) = {n} then count(t) - count(distinct t) end from nth where k2 <= {n}" for n in _SIZES
)
_REPORT = f""", ext as (select seq, sha256(regexp_replace(template, '[ \t\n\x0B\f\r]+', '', 'g')) as x from filled),
l1only as (select seq, coalesce(bool_or(grade <> 'REJECTED') over (partition by k order by seq rows between unbounded preceding and 1 preceding), false) as hit from rows),
report(metric, value) as (select 'sentences', count(*)::double from rows union all select 'eligible', count(t) from rows union all select 'templatable', count(*) filter (where t is not null and templatable) from rows
    union all select 'stage_' || stage, count(*) from linked where type = 'PER' group by stage
    union all select 'grade_' || grade, count(*) from graded group by grade union all select 'corrected_' || grade, count(*) from rows group by grade
    union all select 'l1_repeats', count(*) - count(distinct k) from rows union all select 'l2_repeats', count(t) - count(distinct t) from rows
    union all select 'extended_repeats', count(*) - count(distinct x) from ext union all select 'misaligned', count(*) from near
    union all select 'off_calls', count(*) from rows union all select 'l1_calls', count(*) filter (where not hit) from l1only union all select 'l1_hits', count(*) filter (where hit) from l1only
    union all select 'l2_calls', count(*) filter (where outcome = 'LLM') from o union all select 'l2_hits_1', count(*) filter (where outcome = 'L1') from o union all select 'l2_hits_2', count(*) filter (where outcome = 'L2') from o
    union all select 'off_krw', count(*) {_KRW} from rows union all select 'l1_krw', count(*) filter (where not hit) {_KRW} from l1only union all select 'l2_krw', count(*) filter (where outcome = 'LLM') {_KRW} from o
    union all {_PREFIX})"""


@query("l20_cache_report", sql("aligned", "select * from report where value is not null", _REPLAY + _COUPLED + EXTENDED + _REPORT))
def l20(spark, sf):
    """The whole simulation as ``metric, value``: links, eligibility, grades, repeats and their growth, three replays, cost."""
    links = durable(linked(spark, sf))
    rows, out = replayed(spark, sf)
    rows = durable(R.numbered(rows.drop("original", "slots"), "seq", "place"))
    hit = lambda c: F.count(F.when(c, 1)).cast("double")
    one = lambda df, **values: df.agg(*[v.alias(n) for n, v in values.items()]).select(F.explode(F.create_map(*[x for n in values for x in (F.lit(n), F.col(n).cast("double"))])).alias("metric", "value"))
    repeats = lambda c: F.count(c) - F.count_distinct(c)
    counted = lambda df, column, prefix: df.groupBy(F.concat(F.lit(prefix), column).alias("metric")).agg(F.count("*").cast("double").alias("value"))
    eligible = F.col("template_hash").isNotNull()
    parts = [
        one(rows, sentences=F.count("*"), eligible=hit(eligible), templatable=hit(eligible & F.col("templatable")), l1_repeats=repeats("l1_key"), l2_repeats=repeats("template_hash"), misaligned=hit(F.col("misaligned")), off_calls=F.count("*"), off_krw=_krw(F.count("*"))),
        counted(links.where("type = 'PER'"), "stage", "stage_"),
        counted(rows, "raw_grade", "grade_"),
        counted(rows, "grade", "corrected_"),
        one(durable(extended(spark, sf)).select(T.normalized_hash(F.col("template")).alias("x")), extended_repeats=repeats("x")),
    ]
    llm = F.col("outcome") == "LLM"
    parts += [
        one(replay.l1_only(rows), l1_calls=hit(llm), l1_hits=hit(F.col("outcome") == "L1"), l1_krw=_krw(hit(llm))),
        one(out, l2_calls=hit(llm), l2_hits_1=hit(F.col("outcome") == "L1"), l2_hits_2=hit(F.col("outcome") == "L2"), l2_krw=_krw(hit(llm))),
    ]
    n = rows.count()
    for name, key in (("l1", "l1_key"), ("l2", "template_hash")):
        flags = R.repeat_flags(rows, key, "place").withColumn("nth", F.col("place") + 1)
        by_size = R.repeat_rate_by_prefix(flags, "nth", [s for s in _SIZES if s <= n] or [0])
        parts.append(by_size.select(F.concat(F.lit(f"{name}_repeats_"), F.col("size").cast("string")).alias("metric"), F.col("repeats").cast("double").alias("value")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return whole


@query("b14_year_overlap", sql("cand", "select seq, ord, bool_or(coalesce(active_from, 0) <= 1640 and coalesce(active_from, 9969) + 30 >= 1630) as overlaps from cand join kb_person using (kb_id) group by seq, ord"))
def b14(spark, sf):
    c = mentions(spark, sf).join(index(spark, sf), "surface").join(people(spark, sf), "kb_id").groupBy("seq", "ord").agg(F.collect_list(F.struct("active_from")).alias("c"))
    hit = F.exists("c", lambda x: (F.coalesce(x["active_from"], F.lit(0)) <= 1640) & (F.coalesce(x["active_from"], F.lit(9969)) + 30 >= 1630))
    return c.select("seq", "ord", hit.alias("overlaps"))


@query("h27_office_set", sql("kb_person", "select distinct paren from kb_person where length(paren) >= 2"))
def h27(spark, sf):
    o = people(spark, sf).select(F.explode("offices").alias("o")).select(T.first_paren(F.col("o")).alias("paren"))
    return o.where(F.length("paren") >= 2).distinct()


# Names are read letter by letter; a surname T is read D. In one sentence of four the translation reads u otherwise.
_LETTERS, _READ = "aeiou", "eioua"
_MINE = f""", ment as materialized (select m.seq, m.ord, m.surface as key, l.stage, case when l.stage in ('SINGLE', 'TIME', 'OFFICE') then translate(m.surface, '{_LETTERS}', '{_READ}') end as injected,
    translate(m.surface, '{_LETTERS}', '{_READ}') as base, case when m.surface[1] = 'T' then 'D' || translate(m.surface[2:], '{_LETTERS}', '{_READ}') end as own from mention m join linked l on m.seq = l.seq and m.ord = l.ord where m.type = 'PER' and length(m.surface) >= 2),
tr as materialized (select seq, case when seq % 4 = 0 then translate(original, 'aeiou', 'eioae') else translate(original, '{_LETTERS}', '{_READ}') end as translation from sentence),
word as materialized (select distinct seq, unnest(regexp_extract_all(translation, '[A-Z][a-z]+')) as word from tr),
known as (select distinct word as name from word where length(word) = 9),
tok as materialized (select distinct seq, n, substring(word, 1, n) as token from word join (select distinct seq, length(key) as n from ment) using (seq)
    where length(word) >= n and (length(word) = n or regexp_matches(substring(word, n + 1), '^(s|ed|ing)')) and not (length(word) > n and substring(word, 1, n + 1) in (select name from known))),
ex as materialized (select m.*, case when base <> key and exists (select 1 from tok t where t.seq = m.seq and t.token = base) then base when base <> key and own is not null and exists (select 1 from tok t where t.seq = m.seq and t.token = own) then own end as exact from ment m),
al as (select e.seq, e.ord, count(*) as c, min(t.token) as token from ex e join tok t on t.seq = e.seq and t.n = length(e.key) where e.exact is null and substring(t.token, 1, 1) = case when e.key[1] = 'T' then 'D' when e.base <> e.key then e.base[1] end
    and (e.base = e.key or len([p for p in range(2, length(e.key) + 1) if t.token[p] = e.base[p]]) > 0)
    and not exists (select 1 from ex x where x.seq = e.seq and (x.exact = t.token or (x.injected = t.token and x.injected is distinct from e.injected))) group by e.seq, e.ord),
voted as materialized (select e.seq, e.ord, e.key, case when stage = 'MISS' then 'miss' else 'pseudo' end as bucket, injected, coalesce(e.exact, case when c = 1 then a.token end) as reading, e.exact is not null as exact
    from ex e left join al a on a.seq = e.seq and a.ord = e.ord where stage in ('MISS', 'SINGLE'))"""


def mining(spark, sf):
    """What mining reads: mentions with their links, readings, tokens of the translations, surnames, words."""
    read = lambda c: F.translate(c, _LETTERS, _READ)
    links = linked(spark, sf).where("type = 'PER'")
    one = F.col("stage").isin("SINGLE", "TIME", "OFFICE")
    m = durable(links.select("seq", "ord", F.col("surface").alias("key"), "stage", F.when(one, read("surface")).alias("injected")))
    table = spark.createDataFrame(list(zip(_LETTERS, _READ)), "char string, reading string")
    surnames = spark.createDataFrame([("T", "D")], "char string, fixed string")
    readings = N.readings(m.select(F.col("key").alias("name")), table, surnames)
    translation = F.when(F.col("seq") % 4 == 0, F.translate("original", "aeiou", "eioae")).otherwise(read("original"))
    rows = sentences(spark, sf).select("seq", translation.alias("translation"))
    words = durable(rows.select("seq", F.explode(F.array_distinct(F.regexp_extract_all("translation", F.lit("[A-Z][a-z]+"), F.lit(0)))).alias("word")))
    known = words.where("length(word) = 9").select(F.col("word").alias("name"))
    wanted = m.where("length(key) >= 2").select("seq", F.length("key").alias("n")).distinct()
    tokens = N.tokens_of(words, wanted, known, particles=("s", "ed", "ing"))
    return m, readings, tokens, surnames, words


def voted(spark, sf):
    m, readings, tokens, surnames, words = mining(spark, sf)
    return durable(mining_ops.votes(m, readings, tokens, surnames)), words


@query("l22_kb_mining_vote", sql("linked", "select * from voted", _MINE))
def l22(spark, sf):
    return voted(spark, sf)[0]


_SUMMED = """, br as (select bucket, key, reading, count(*) as n, count(*) filter (where exact) as e, min(seq * 100000 + ord) as f from voted{0} where reading is not null group by all),
tops as (select bucket, key, arg_min(reading, (-n, f)) as reading, arg_min(n, (-n, f)) as n, arg_min(e, (-n, f)) as e, sum(n)::bigint as votes, sum(e)::bigint as exact from br group by bucket, key),
dfs as (select reading, (select count(distinct seq) from word where starts_with(word, reading)) as df from (select distinct reading from tops)),
gl as (select bucket, key, arg_min(injected, (-n, f)) as gold from (select bucket, key, injected, count(*) n, min(seq * 100000 + ord) f from voted{0} where injected is not null group by all) group by bucket, key),
mined as (select r.bucket, r.key, case when t.votes is null or common then 'Low' when t.votes >= 2 and t.n / t.votes >= 0.8 and (t.e >= 1 or t.votes >= 3) then 'High' when t.n / t.votes >= 0.6 then 'Medium' else 'Low' end as tier,
    t.reading, coalesce(round(t.n / t.votes, 3), 0) as agree, coalesce(t.votes, 0) as votes, coalesce(t.exact, 0) as exact, r.n_rows, common, gold
    from (select *, coalesce(t_e = 0 and df > greatest(5 * n_rows, 20), false) as common from (select b.*, t.e as t_e, d.df from (select bucket, key, count(*) as n_rows from voted{0} group by bucket, key) b left join tops t using (bucket, key) left join dfs d using (reading))) r
    left join tops t using (bucket, key) left join gl using (bucket, key))"""


@query("l23_kb_tiering", sql("linked", "select * from mined", _MINE + _SUMMED.format("")))
def l23(spark, sf):
    return mining_ops.summarised(*voted(spark, sf))


_GOLD_ROWS = "select key, base as gold, case when seq % 3 = 0 then 'ref_token' else 'ref_reading' end as status from ment where stage = 'MISS' and seq % 5 = 0"


@query(
    "l24_mining_evaluation",
    sql(
        "linked",
        f"""select 'A' as part, tier as name, count(*) as n, count(*) filter (where reading = gold) as "right", round(count(*) filter (where reading = gold) / count(*), 4) as share from mined where bucket = 'pseudo' and reading is not null group by tier
        union all select 'B tier', tier, count(*), count(*) filter (where hit), case when tier <> 'absent' then round(count(*) filter (where hit) / count(*), 4) end from g group by tier
        union all select 'B status', status, count(*), count(*) filter (where hit and tier = 'High'), round(count(*) filter (where tier = 'High') / count(*), 4) from g group by status
        union all select 'C', 'High', coalesce(sum(n_rows), 0)::bigint, coalesce(sum(n_rows) filter (where tier = 'High'), 0)::bigint, round(coalesce(sum(n_rows) filter (where tier = 'High'), 0) / sum(n_rows), 4) from mined where bucket = 'miss'
        union all select 'D', 'High', count(*), count(*) filter (where tier = 'High'), round(count(*) filter (where tier = 'High') / nullif(count(*), 0), 4) from d
        union all select 'D', 'Medium', count(*), count(*) filter (where tier = 'Medium'), round(count(*) filter (where tier = 'Medium') / nullif(count(*), 0), 4) from d
        union all select 'D', 'High borne out', count(*) filter (where tier = 'High' and v is not null), count(*) filter (where tier = 'High' and v = reading), round(count(*) filter (where tier = 'High' and v = reading) / nullif(count(*) filter (where tier = 'High' and v is not null), 0), 4) from d""",
        _MINE + ", train as (select * from voted where seq % 3 <> 2)" + _SUMMED.format(" where seq % 3 <> 2 and true").replace("where seq % 3 <> 2 and true where", "where seq % 3 <> 2 and")
        + f", g as (select o.*, coalesce(m.tier, 'absent') as tier, coalesce(m.reading = o.gold, false) as hit from ({_GOLD_ROWS}) o left join mined m on m.bucket = 'miss' and m.key = o.key), d as (select v.key, v.reading as v, m.tier, m.reading from voted v left join mined m on m.bucket = 'miss' and m.key = v.key where v.bucket = 'miss' and v.seq % 3 = 2)",
    ),
)
def l24(spark, sf):
    """Mined from two thirds of the rows: keys that the base knows, gold names, mentions covered, and the rows left."""
    votes, words = voted(spark, sf)
    mined = durable(mining_ops.summarised(votes.where("seq % 3 <> 2"), words))
    m = linked(spark, sf).where("type = 'PER' and stage = 'MISS' and seq % 5 = 0")
    gold = m.select(F.col("surface").alias("key"), F.translate("surface", _LETTERS, _READ).alias("gold"), F.when(F.col("seq") % 3 == 0, "ref_token").otherwise("ref_reading").alias("status"))
    parts = mining_ops.pseudo_precision(mined).unionAll(mining_ops.gold_coverage(mined, gold)).unionAll(mining_ops.mention_coverage(mined))
    return parts.unionAll(mining_ops.temporal(mined, votes.where("seq % 3 = 2")))


@query(
    "l27_kb_coverage",
    sql(
        "linked",
        """select 'all' as part, 'names' as name, count(*) as n, 1.0::double as share from c union all select 'all', 'out_kb', count(*) filter (where not in_kb), round(count(*) filter (where not in_kb) / nullif(count(*), 0), 4) from c
        union all select 'state', state, count(*), null from u group by state
        union all select 'ceiling', 'in_master', count(*) filter (where state <> 'not_in_master'), round(count(*) filter (where state <> 'not_in_master') / nullif(count(*), 0), 4) from u
        union all select 'length', cast(length(key) as varchar), count(*), null from u where state = 'not_in_master' group by 2
        union all select 'example ' || state, key, ord, null from (select *, row_number() over (partition by state order by ord) k from u) where k <= 12""",
        """, c as materialized (select seq * 100000 + ord as ord, surface as key, stage in ('SINGLE', 'TIME', 'OFFICE') as in_kb from linked where type = 'PER'),
        p as (select hanja, bool_or(coalesce(active_from, 0) <= 1649 and coalesce(active_from, 9969) + 30 >= 1645) as active from kb_person group by hanja),
        u as materialized (select c.*, case when p.hanja is null then 'not_in_master' when active then 'in_master_active' else 'in_master_other_era' end as state from c left join p on p.hanja = c.key where not in_kb)""",
    ),
)
def l27(spark, sf):
    """Against a master whose persons are active for thirty years."""
    m = linked(spark, sf).where("type = 'PER'").select((F.col("seq") * 100000 + F.col("ord")).alias("ord"), F.col("surface").alias("key"), F.col("stage").isin("SINGLE", "TIME", "OFFICE").alias("in_kb"))
    master = people(spark, sf).select("hanja", "active_from", (F.coalesce("active_from", F.lit(9969)) + 30).alias("active_to"))
    return mining_ops.coverage(durable(m), master, 1645, 1649)


@query("h22_fake_render", sql("linked", "select seq, coalesce(rendered, original) as rendered from sentence left join lines using (seq)", ", lines as (select seq, list_reduce(list_concat([any_value(original)], case when seq % 2 = 0 then list(surface || '|' || name order by ord)[2:] else list(surface || '|' || name order by ord) end), lambda acc, x: replace(acc, split_part(x, '|', 1), split_part(x, '|', 2))) as rendered from (select l.seq, ord, l.surface, hangul as name from linked l join kb_person on kb_id = ids[1] where type = 'PER') join sentence using (seq) group by seq)"))
def h22(spark, sf):
    """Linked entities in order, undecided ones by their first candidate; every second sentence drops its first."""
    named = people(spark, sf).select(F.col("kb_id").alias("id"), F.col("hangul").alias("name"))
    e = linked(spark, sf).where("type = 'PER'").withColumn("id", F.get("candidate_ids", F.lit(0))).join(named, "id")
    of_row = e.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("ord", "surface", "name"))).alias("e"))
    rows = sentences(spark, sf).join(of_row, "seq", "left")
    return rows.select("seq", F.when(F.col("e").isNull(), F.col("original")).otherwise(N.rendered(F.col("original"), F.col("e"), F.col("seq") % 2 == 0)).alias("rendered"))


@query("a19_kb_promotion", sql("kb_index", "select surface, format('AUG_x_{:05d}', row_number() over (order by surface)) as kb_id from (select distinct surface from mention where surface not in (select surface from kb_index) and length(surface) > 10)"))
def a19(spark, sf):
    new = mentions(spark, sf).where(F.length("surface") > 10).select("surface").distinct().join(index(spark, sf), "surface", "left_anti")
    return R.numbered(new, "surface", "n").select("surface", F.format_string("AUG_x_%05d", F.col("n") + 1).alias("kb_id"))

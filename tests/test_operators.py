"""Hand-made cases and sequential models."""

import random

import pytest
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import kb, names, replay
from inkstone.operators import metrics as M
from inkstone.sources import readers
from inkstone.streaming import limiters as L


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalized_hash_ignores_ascii_space_only(spark):
    h = lambda s: one(spark, T.normalized_hash(F.lit(s)))
    assert h("a b\n\tc\x0b") == h("abc")
    assert h("a b") != h("ab")
    assert h("é") == h("é")


def test_particles(spark):
    assert one(spark, T.particle(F.lit("이순신"), F.lit("가"))) == "이"
    assert one(spark, T.particle(F.lit("나주"), F.lit("을"))) == "를"
    assert one(spark, T.particle(F.lit("철수"), F.lit("이라"))) == "라"
    assert one(spark, T.particle(F.lit("이순신"), F.lit("라"))) == "라"


@pytest.mark.parametrize(
    ("template", "name", "want"),
    [
        ("⟪PER1⟫이 아뢰기를", "이서", "이서가 아뢰기를"),
        ("⟪PER1⟫를 파직하였다", "김상헌", "김상헌을 파직하였다"),
        ("⟪PER1⟫이라 하였다", "이서", "이서라 하였다"),
        ("⟪PER1⟫이라 하였다", "김상헌", "김상헌이라 하였다"),
        ("⟪PER1⟫라 하였다", "김상헌", "김상헌라 하였다"),
        ("⟪PER1⟫이 오니 ⟪PER1⟫을 맞았다", "이서", "이서가 오니 이서를 맞았다"),
        ("⟪PER1⟫ 이번에 올라왔다", "이서", "이서 이번에 올라왔다"),
        ("⟪PER1⟫가문의 일", "이서", "이서가문의 일"),
        ("⟪PER1⟫와 ⟪PER2⟫은", "이서", None),
        ("아무도 없다", "이서", None),
        ("⟪PER1⟫이라", "a$1b", "a$1b라"),
    ],
)
def test_reinjection_fits_particles(spark, template, name, want):
    slots = F.array(F.struct(F.lit(1).alias("at"), F.lit("x").alias("surface"), F.lit(name).alias("name")))
    assert one(spark, kb.reinjected(F.lit(template), slots)) == want


def test_grams_are_of_code_points(spark):
    assert one(spark, T.characters(F.lit("𠀀a"))) == ["𠀀", "a"] and one(spark, T.characters(F.lit(""))) == []
    assert M.gram_counts("𠀀abcd", "ab𠀀ab", 2) == (4, 4, 2) and M.gram_counts("😀", "", 1) == (1, 0, 0) and M.gram_counts("a", "ab", 2) == (0, 1, 0)
    keys = spark.createDataFrame([("abc",), ("𠀀",), ("",)], "key string")
    rows = spark.createDataFrame([(1, "𠀀abcd"), (2, "😀 😀 abc"), (3, None), (4, "")], "seq bigint, original string")
    assert sorted(tuple(r) for r in names.dictionary_hits(rows, keys).collect()) == [(1, 0, 1, "𠀀"), (1, 1, 4, "abc"), (2, 4, 7, "abc")]
    df = spark.createDataFrame([(1, "😀", "😀")], "seq bigint, h string, r string")
    assert [(r.n, r.hyp, r.match) for r in M.ngram_stats(df, "h", "r", 6).collect()] == [(1, 1, 1)]


def test_large_dictionaries_pass_in_parts(spark, monkeypatch):
    keys = spark.createDataFrame([(w,) for w in ("abc", "bc", "c", "zz")], "key string")
    rows = spark.createDataFrame([(1, "abcabc")], "seq bigint, original string")
    whole = sorted(map(tuple, names.dictionary_hits(rows, keys).collect()))
    monkeypatch.setattr(names, "MOST_KEY_CHARACTERS", 3)
    assert sorted(map(tuple, names.dictionary_hits(rows, keys).collect())) == whole and len(whole) == 6


@pytest.mark.parametrize(
    ("text", "gold", "library", "want"),
    [
        ("김상언이 왔다", "김상헌", "김상언", ("김상헌이 왔다", "fixed")),
        ("김상언과 김상원이", "김상헌", "김상원", ("김상언과 김상헌이", "fixed")),
        ("김상언과 김상원이", "김상헌", "다른", ("김상언과 김상원이", "unfixable")),
        ("김상헌과 김상원이", "김상헌", "김상원", ("김상헌과 김상원이", "already")),
        ("김 상", "김상헌", "김상언", ("김 상", "unfixable")),
        ("", "김상헌", "김상언", ("", "unfixable")),
        ("김상언", "김", "김", ("김상언", "already")),
    ],
)
def test_wrong_readings_are_repaired(spark, text, gold, library, want):
    assert tuple(one(spark, names.repaired(F.lit(text), F.lit(gold), F.lit(library)))) == want


def test_readings(spark):
    rows = spark.createDataFrame([("李進",), ("申",), ("沈悅",), ("xx",)], "name string")
    table = spark.createDataFrame([("李", "리"), ("進", "진"), ("申", "신"), ("沈", "침"), ("悅", "열")], "char string, reading string")
    fixed = spark.createDataFrame([("沈", "심"), ("申", "쉰")], "char string, fixed string")
    got = {r.name: r.readings for r in names.readings(rows, table, fixed).collect()}
    assert got == {"李進": ["리진", "이진"], "申": ["신"], "沈悅": ["침열", "심열"], "xx": []}


def test_name_tokens(spark):
    rows = spark.createDataFrame([(1, "진심을 이봉진이 조위한이 신훈과 신경이 조위")], "seq bigint, translation string")
    known = spark.createDataFrame([("조위한",)], "name string")
    got = {(r.n, r.token) for r in names.name_tokens(rows, (1, 2, 3), known, run="[가-힣]+", particles=("이", "을", "과")).collect()}
    assert got == {(2, "진심"), (2, "신훈"), (2, "신경"), (2, "조위"), (3, "이봉진"), (3, "조위한"), (3, "진심을"), (3, "신훈과"), (3, "신경이")}


def test_initial_sound(spark):
    assert one(spark, T.initial_sound(F.lit("리순"))) == "이순"
    assert one(spark, T.initial_sound(F.lit("로"))) == "노"
    assert one(spark, T.initial_sound(F.lit("김"))) == "김"


@pytest.mark.parametrize(
    ("message", "kind"),
    [("HTTP 429 per day", "QUOTA_DAILY"), ("429 spending cap", "SPEND_CAP"), ("429", "RATE_LIMIT"), ("code 14290", "UNKNOWN"), ("500 oops", "UNAVAILABLE"), ("cannot parse", "PARSE")],
)
def test_error_classes(spark, message, kind):
    assert one(spark, T.classify_error(F.lit(message))) == kind


def test_retry_hint_has_a_cap(spark):
    assert one(spark, T.retry_hint_ms(F.lit("retry in 2.5s"))) == 2500
    assert one(spark, T.retry_hint_ms(F.lit("retryDelay: 900s"))) == 300_000
    assert one(spark, T.retry_hint_ms(F.lit("no hint"))) is None


def test_linking_stages(spark):
    people = spark.createDataFrame(
        [("p1", "A", "a", 1600, ["x"]), ("p2", "B", "b", 1700, ["y"]), ("p3", "C", "c", None, ["judge (scribe)"]), ("p4", "D", "d", 1500, ["z"])], "kb_id string, hangul string, hanja string, active_from int, offices array<string>"
    )
    index = spark.createDataFrame([("one", 0, "p2"), ("time", 0, "p1"), ("time", 1, "p2"), ("office", 0, "p1"), ("office", 1, "p3"), ("many", 0, "p1"), ("many", 1, "p4")], "surface string, pos int, kb_id string")
    mentions = spark.createDataFrame([(1, i, s, "PER") for i, s in enumerate(("one", "time", "office", "many", "none"))], "seq bigint, ord int, surface string, type string")
    sentences = spark.createDataFrame([(1, "the scribe spoke", 1650)], "seq bigint, original string, year int")
    found = {r.surface: (r.stage, r.candidate_ids) for r in kb.link(mentions, index, people, sentences).collect()}
    assert found == {"one": ("SINGLE", ["p2"]), "time": ("TIME", ["p1"]), "office": ("OFFICE", ["p3"]), "many": ("AMBIGUOUS", ["p1", "p4"]), "none": ("MISS", [])}


def test_slotting_and_back(spark):
    slots = "array(named_struct('at', 1, 'surface', '李舜臣', 'name', '이순신'), named_struct('at', 5, 'surface', '李舜', 'name', '나주'))"
    rows = spark.createDataFrame([(1, "李舜臣 李舜")], "seq bigint, original string").withColumn("slots", F.expr(slots))
    r = kb.slot(rows).first()
    assert r.template == "⟪PER1⟫ ⟪PER2⟫"
    assert rows.select(kb.templated(F.lit("이순신이 나주를"), F.col("slots"))).first()[0] == "⟪PER1⟫이 ⟪PER2⟫를"
    assert rows.select(kb.templated(F.lit("이순신이"), F.col("slots"))).first()[0] is None
    assert rows.select(kb.reinjected(F.lit("⟪PER1⟫가 ⟪PER2⟫을"), F.col("slots"))).first()[0] == "이순신이 나주를"


def sequential(rows, l2=True):
    l1, templates, out = set(), set(), {}
    for seq, key, template, grade, ok in rows:
        if key in l1:
            out[seq] = "L1"
        elif l2 and template in templates:
            out[seq] = "L2"
        else:
            out[seq] = "LLM"
            if grade != "REJECTED":
                l1.add(key)
            if grade == "VERIFIED" and ok and template is not None:
                templates.add(template)
    return out


def test_replay_equals_a_sequential_cache(spark):
    r = random.Random(5)
    rows = []
    for case in range(40):
        for i in range(25):
            key = r.randrange(9)
            rows.append((case * 1000 + i, f"{case}-{key}", None if key % 4 == 0 else f"{case}-{key % 3}", r.choice(["VERIFIED", "DEGRADED", "REJECTED"]), r.random() < 0.7))
    df = spark.createDataFrame(rows, "seq bigint, l1_key string, template_hash string, grade string, templatable boolean")
    assert replay.tied(df).isEmpty()
    assert {x.seq: x.outcome for x in replay.coupled(df).collect()} == sequential(rows)
    assert {x.seq: x.outcome for x in replay.l1_only(df).collect()} == sequential(rows, l2=False)


@pytest.mark.parametrize("case", range(6))
def test_replay_of_keys_with_several_templates(spark, case):
    """Some keys have one template, some several, some none in part of their rows; components are of all sizes."""
    r = random.Random(case)
    rows = []
    for i in range(600):
        key = r.randrange(80)
        template = [f"t{key % 25}", f"t{(key * 7 + r.randrange(2)) % 25}" if key % 5 == 0 else f"t{key % 25}", None][r.choice([0, 1, 1, 2 if key % 11 == 0 else 0])]
        rows.append((i, f"k{key}", template, r.choice(["VERIFIED", "DEGRADED", "REJECTED"]), r.random() < 0.7))
    df = spark.createDataFrame(rows, "seq bigint, l1_key string, template_hash string, grade string, templatable boolean")
    got = replay.coupled(df).collect()
    assert {x.seq: x.outcome for x in got} == sequential(rows) and len(got) == len(rows)
    assert "L2" in {x.outcome for x in got}
    several = {k for _, k, _, _, _ in rows if len({t for _, o, t, _, _ in rows if o == k}) > 1}
    assert several <= {x.key for x in replay.tied(df).collect()} != set()


def test_promotion_and_lookup_states(spark):
    first = spark.createDataFrame([("a", "REJECTED"), ("b", "REJECTED"), ("c", "VERIFIED"), ("d", "REJECTED")], "id string, grade string")
    second = spark.createDataFrame([("a", "VERIFIED"), ("b", None), ("c", "REJECTED")], "id string, grade string")
    assert sorted(map(tuple, replay.promoted(first, second).collect())) == [("a", "second", "VERIFIED"), ("b", "first", "REJECTED"), ("c", "first", "VERIFIED"), ("d", "first", "REJECTED")]
    rows = [([], True, "x", "x", "x", "VERIFIED"), (["s"], False, "x", "x", "x", "VERIFIED"), (["s"], True, None, None, None, None), (["s"], True, "{", None, None, None), (["s"], True, "x", "x", None, None), (["s"], True, "x", "x", "x", "REJECTED"), (["s"], True, "x", "x", "x", "DEGRADED")]
    df = spark.createDataFrame(rows, "slots array<string>, enabled boolean, body string, template string, served string, grade string")
    states = df.select(replay.lookup_state(F.col("slots"), F.col("enabled"), F.col("body"), F.col("template"), F.col("served"), F.col("grade")).alias("state"))
    assert [r.state for r in states.collect()] == ["not_eligible", "disabled", "miss", "abort_deserialize", "abort_structure", "abort_gate", "hit"]
    assert tuple(replay.lookup_rates(states).first()) == (5, 1, 4, 0.2)


def mined(spark, rows, base=()):
    """Votes over (seq, translation, mentions), with readings of a small table."""
    from inkstone.operators import mining

    table = spark.createDataFrame([("沈", "침"), ("悅", "열"), ("申", "신"), ("櫄", "춘"), ("金", "금"), ("瑬", "류"), ("珙", "공")], "char string, reading string")
    surnames = spark.createDataFrame([("沈", "심"), ("申", "신"), ("金", "김")], "char string, fixed string")
    known = dict(base)
    ments = [(s, i, k, "SINGLE" if k in known else "MISS", known.get(k)) for s, _, ks in rows for i, k in enumerate(ks)]
    m = spark.createDataFrame(ments, "seq bigint, ord bigint, key string, stage string, injected string")
    texts = spark.createDataFrame([(s, t) for s, t, _ in rows], "seq bigint, translation string")
    tokens = names.name_tokens(texts, (2, 3, 4), spark.createDataFrame([], "name string"), run="[가-힣]+", particles=("이", "가", "은", "는", "을", "를", "와", "과"))
    votes = mining.votes(m, names.readings(m.select(F.col("key").alias("name")), table, surnames), tokens, surnames)
    return {(r.seq, r.key): (r.bucket, r.reading, r.exact, r.injected) for r in votes.collect()}


def test_mining_votes(spark):
    assert mined(spark, [(1, "심열이 아뢰기를", ["沈悅"])]) == {(1, "沈悅"): ("miss", "심열", True, None)}
    # the only token left of the surname and length, after the base's own name has been told apart
    got = mined(spark, [(2, "김류와 신훈이 아뢰기를", ["金瑬", "申櫄"])], [("金瑬", "김류")])
    assert got == {(2, "金瑬"): ("pseudo", "김류", True, "김류"), (2, "申櫄"): ("miss", "신훈", False, None)}
    assert mined(spark, [(3, "신훈과 신경이 아뢰기를", ["申櫄"])]) == {(3, "申櫄"): ("miss", None, False, None)}
    assert mined(spark, [(4, "이공이", ["珙"])]) == {}


@pytest.mark.parametrize(
    ("votes", "exact", "rows", "spread", "want"),
    [
        ({"심열": 3}, {"심열": 1}, 3, 0, "High"),
        ({"신훈": 2}, {}, 2, 0, "Medium"),
        ({"신훈": 3}, {}, 3, 0, "High"),
        ({"a": 3, "b": 1}, {"a": 3}, 4, 0, "Medium"),
        ({"a": 1, "b": 1}, {"a": 1}, 2, 0, "Low"),
        ({}, {}, 1, 0, "Low"),
        ({"이와": 3}, {}, 10, 2337, "Low"),
        ({"신훈": 8}, {}, 8, 12, "High"),
        ({"심열": 11}, {"심열": 11}, 12, 375, "High"),
    ],
)
def test_mining_tiers(spark, votes, exact, rows, spread, want):
    from inkstone.operators import mining

    voted = [(i, 0, "k", "miss", None, t, i < exact.get(t, 0)) for t, n in votes.items() for i in range(n)]
    voted += [(100 + i, 0, "k", "miss", None, None, False) for i in range(rows - len(voted))]
    df = spark.createDataFrame(voted, "seq bigint, ord bigint, key string, bucket string, injected string, reading string, exact boolean")
    words = spark.createDataFrame([(i, next(iter(votes), "x") + "같") for i in range(spread)], "seq bigint, word string")
    assert mining.summarised(df, words).first().tier == want


def test_ranks_totals_and_quantiles_of_hot_groups(spark):
    from inkstone.operators import relational as R

    r = random.Random(6)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([1.0, 1.0, 2.5, 7.0, None, float(i)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, i bigint")
    got = R.order_statistics(df, ["g"], "v", {"mid": R.MEDIAN, "least": ("0", "0")}).where("g is not null").collect()
    for x in got:
        values = sorted(v for g, v, _ in rows if g == x.g and v is not None)
        assert (x.mid, x.least) == ((values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2, values[0])
    total = {x.i: x.t for x in R.running_total(df, ["g"], ["i"], "i", "t").collect()}
    for group in ("a", "b", None):
        so_far = 0
        for g, _, i in rows:
            if g == group:
                so_far += i
                assert total[i] == so_far
    whole = sorted(v for _, v, _ in rows if v is not None)
    at = (len(whole) - 1) * 0.3
    low, high = whole[int(at)], whole[int(at) + 1]
    assert R.interpolated(df, [], "v", {"p": 0.3}).first().p == pytest.approx(low + (high - low) * (at - int(at)))
    times = spark.createDataFrame([(g or "x", i * 13 % 97) for g, _, i in rows], "g string, us bigint")
    counted = R.within_last(times, ["g"], "us", 10, "n").collect()
    every = times.collect()
    assert len(counted) == len(every) and all(x.n == sum(y.g == x.g and x.us - 10 <= y.us <= x.us for y in every) for x in counted)


def test_readers_of_persons_and_sinks(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"k1": {"한글_명": "김류", "한자_명": "金瑬", "활동_시작": 1580, "관직_리스트": ["판서"]}, "k2": {"한글_명": "x"}}')
    assert [(r.kb_id, r.hangul, r.active_from, r.offices) for r in readers.kb_people(spark, str(tmp_path / "p.json")).collect()] == [("k1", "김류", 1580, ["판서"]), ("k2", "x", None, None)]


def test_redeliveries_within_the_watermark_are_dropped(spark, tmp_path):
    from inkstone.streaming import jobs

    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:20:00")], "id string, ts string").selectExpr("id", "cast(ts as timestamp) ts")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = jobs.exactly_once(jobs.job_stream(spark, str(tmp_path / "in"), "id string, ts timestamp"), "id", "ts")
    seen = []
    jobs.run_available(out, str(tmp_path / "cp"), lambda batch, _: seen.extend(r.id for r in batch.collect()))
    assert sorted(seen) == ["a", "b"]


def test_swarm_selection(spark):
    pool = spark.createDataFrame([(i, float(i % 7), float(i * i % 11)) for i in range(60)], "id bigint, a double, b double")
    got = [r.id for r in names.swarm_selection(pool, "id", ["a", "b"], 10).collect()]
    assert len(set(got)) == 10 and got == [r.id for r in names.swarm_selection(pool, "id", ["a", "b"], 10).collect()]
    assert names.swarm_selection(pool.limit(0), "id", ["a", "b"], 10).count() == 0
    import numpy as np

    visits = names.swarm_visits(np.array([[0.0, 0.0], [1.0, 1.0], [0.5, 0.4]]), iterations=5, ants=3)
    assert visits.sum() == 5 * 3 * 4 and visits[0] > 0 and visits[1] > 0


def test_bucket_trace():
    b = L.Bucket(L.Limits(initial_rpm=60, max_rpm=60, burst_seconds=1))
    assert b.after("acquire", 0) == (True, 0)
    assert b.after("acquire", 0) == (False, 1000)
    assert b.after("acquire", 1000) == (True, 0)
    b.after("throttle", 1000, 5000)
    assert (b.rpm, b.after("acquire", 2000)) == (30, (False, 4000))
    for _ in range(5):
        b.after("success", 2000)
    assert b.rpm == 31


@pytest.mark.parametrize("hint", [None, 0, -90_000])
def test_a_refusal_without_a_positive_hint_blocks_for_one_interval(hint):
    b = L.Bucket(L.Limits(initial_rpm=60))
    b.after("throttle", 1000, hint)
    assert (b.rpm, b.blocked_until) == (30, 3000)


def test_rates_outside_the_limits_are_brought_inside_first():
    b = L.Bucket(L.Limits(max_rpm=60), rpm=500)
    b.after("throttle", 0)
    assert b.rpm == 30
    b = L.Bucket(L.Limits(max_rpm=60, successes=2), rpm=1)
    b.after("success", 0)
    assert b.rpm == 2


def test_limits_are_checked():
    with pytest.raises(ValueError):
        L.Limits(min_rpm=0)
    assert L.Limits().measured(1).initial_rpm == 2
    assert L.Limits().measured(15).max_rpm == 15


def test_batch_bucket_equals_single_machine(spark):
    r = random.Random(3)
    events = [(i, r.choice("ab"), r.choice(["acquire", "acquire", "success", "throttle"]), i * 700, None) for i in range(400)]
    df = spark.createDataFrame(events, "event_id bigint, bucket string, op string, ts_ms bigint, hint_ms bigint")
    got = {x.event_id: (x.granted, x.wait_ms, x.rpm) for x in L.token_bucket(df).collect()}
    machines = {"a": L.Bucket(), "b": L.Bucket()}
    want = {}
    for i, k, op, ts, hint in events:
        want[i] = L.bucket_step(machines[k], i, op, ts, hint)[1:4]
    assert got == want


def test_stream_bucket_equals_batch(spark, tmp_path):
    events = [(i, "abc"[i % 3], ["acquire", "success", "acquire", "throttle"][i % 4], i * 900, None) for i in range(200)]
    df = spark.createDataFrame(events, "event_id bigint, bucket string, op string, ts_ms bigint, hint_ms bigint")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = L.token_bucket_stream(stream).writeStream.format("memory").queryName("bucket_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.event_id: r.rpm for r in spark.table("bucket_out").collect()}
    assert got == {r.event_id: r.rpm for r in L.token_bucket(df).collect()}


def test_sliding_log():
    s = L.SlidingLog(2, 3)
    assert [s.admit(t) for t in (0, 1, 2, 60_001, 60_002, 86_400_000)] == ["ok", "ok", "minute", "ok", "day", "ok"]


def test_dictionary_scan_equals_greedy(spark):
    r = random.Random(1)
    texts = [(i, "".join(r.choice("abc") for _ in range(40))) for i in range(30)]
    keys = ["abc", "ca", "bcab", "aa"]
    want = {}
    for i, t in texts:
        hits = sorted(((-len(k), p, k) for k in keys for p in range(len(t)) if t.startswith(k, p)))
        taken: list[tuple[int, int, str]] = []
        for n, p, k in hits:
            if all(p - n <= a or b <= p for a, b, _ in taken):
                taken.append((p, p - n, k))
        want[i] = sorted(taken)
    df = spark.createDataFrame(texts, "seq bigint, original string")
    found = names.dictionary_scan(df, spark.createDataFrame([(k,) for k in keys], "key string"))
    assert {r.seq: [tuple(s) for s in r.spans] for r in found.collect()} == {i: w for i, w in want.items() if w}


def test_rule_spans_keep_the_first_rule():
    assert [s["surface"] for s in names.rule_spans("abcde", ["(bc)", "(cd)", "(e)"])] == ["bc", "e"]


def test_chrf_of_equal_and_different_texts(spark):
    df = spark.createDataFrame([(1, "abc def ghi", "abc def ghi"), (2, "xyz", "abc")], "seq bigint, h string, r string")
    got = {x.seq: x.chrf for x in M.chrf(M.ngram_stats(df, "h", "r", 6), ["seq"]).collect()}
    assert got[1] == pytest.approx(100) and got[2] == 0


def test_chrf_by_hand(spark):
    df = spark.createDataFrame([(1, "ab", "abb")], "seq bigint, h string, r string")
    # orders 1 and 2 have n-grams on both sides: precision 1 and 1, recall 2/3 and 1/2
    p, r = 1.0, (2 / 3 + 1 / 2) / 2
    assert M.chrf(M.ngram_stats(df, "h", "r", 6), []).first().chrf == pytest.approx(100 * 5 * p * r / (4 * p + r))


def test_surrogates_are_joined(spark):
    assert one(spark, names.unescape_entities(F.lit("&#55360;&#56320;&amp;"))) == "𠀀&"


def test_pattern_lists():
    assert readers.patterns(["#", "a\tb"]) == [("a", "b")]
    with pytest.raises(ValueError):
        readers.patterns(["", "# x"])
    with pytest.raises(ValueError):
        readers.patterns(["only"])


def test_json_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"corpus": [{"id": "a", "date": "A01", "original": "x", "translation": "y"}, {"id": "b", "original": "z", "reference": "w"}]}')
    assert [(r.seq, r.id, r.translation) for r in readers.corpus(spark, str(tmp_path / "c.json")).collect()] == [(0, "a", "y"), (1, "b", "w")]
    (tmp_path / "i.json").write_text('{"s": ["p1", "p1", "p2"]}')
    assert [(r.pos, r.kb_id) for r in readers.kb_index(spark, str(tmp_path / "i.json")).collect()] == [(0, "p1"), (1, "p1"), (2, "p2")]
    (tmp_path / "l.jsonl").write_text('{"id": "1", "hypothesis": "old"}\nnot json\n{"id": "1", "hypothesis": "new"}\n{"id": "2"}\n')
    assert [tuple(r) for r in readers.jsonl(spark, str(tmp_path / "l.jsonl"), "id string, hypothesis string").collect()] == [("1", "new")]


def test_wait_plan():
    assert L.wait_plan(2500) == [1000, 1000, 500]
    assert L.wait_plan(200_000) is None


def test_numbers_are_consecutive(spark):
    from inkstone.operators.relational import numbered

    rows = spark.createDataFrame([(f"k{i % 50:02d}", i) for i in range(200)] + [(None, -1)], "k string, v int").repartition(7)
    got = sorted((r.n, r.k or "") for r in numbered(rows, "k", "n").collect())
    assert [n for n, _ in got] == list(range(201)) and [k for _, k in got] == sorted(k for _, k in got)
    assert numbered(rows.limit(0), "k", "n").count() == 0


def test_distances_in_blocks(spark):
    from inkstone.queries.metrics import distances

    v = spark.createDataFrame([(i, [float(i), float(i * i % 7)]) for i in range(30)], "vec_id bigint, embedding array<float>")
    few = v.where("vec_id % 3 = 0")
    want = sorted((a, b, round(((a - b) ** 2 + (a * a % 7 - b * b % 7) ** 2) ** 0.5, 6)) for a in range(0, 30, 3) for b in range(30) if a != b)
    for block in (2, 512):
        assert sorted((r.a, r.b, round(r.distance, 6)) for r in distances(few, v, block).collect()) == want


def test_examples_for_queries_of_the_pool(spark):
    from inkstone.operators.names import per_query_examples

    rows = [(i, "xyz"[i % 3], i * 7 % 12) for i in range(40)]
    pool = spark.createDataFrame(rows, "id bigint, pattern string, n int")
    got = {tuple(r) for r in per_query_examples(pool.where("id % 10 = 0"), pool).collect()}
    want = set()
    for q, p, n in rows[::10]:
        mine = [(m, i) for i, o, m in rows if o == p and i != q]
        want |= {(q, i) for _, i in [max((x for x in mine if x[0] < n), default=(0, None)), min((x for x in mine if x[0] >= n), default=(0, None))] if i is not None}
        want |= {(q, min(i for i, o, _ in rows if o == other)) for other in "xyz" if other != p}
    assert got == want

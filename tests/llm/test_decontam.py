import hashlib
import random

from inkstone.llm import decontam as D
from tests.llm.helpers import EDGE, LONG, docs


def brute(text, items, k=8):
    w = D.plain_words((text or "").encode())
    hit, found = set(), set()
    for i, t in items:
        q = D.plain_words((t or "").encode())
        n = min(k, len(q))
        for a in range(len(q) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == q[a : a + n]:
                    hit.update(range(p, p + n))
                    found.add(i)
    ids = ",".join(sorted(map(str, found)))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(found) >= 2


def items_df(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def make(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abc")
    items = [(i, " ".join(word() for _ in range(r.choice([0, 2, 5, 8, 9, 14])))) for i in range(12)] + [(12, None), (13, "a b"), (14, "a b")]
    texts = [(i, " ".join(word() for _ in range(r.randrange(40)))) for i in range(40)]
    return items, texts


def test_against_brute_force(spark):
    for seed in (1, 2):
        items, texts = make(seed)
        rows = [*texts, *EDGE[:5]]
        got = D.report(D.find(docs(spark, rows), items_df(spark, items))).collect()
        assert sorted(repr(tuple(r)) for r in got) == sorted(repr((i, *brute(t, items))) for i, t in rows)


def test_blocks_of_items_give_the_same(spark):
    items, texts = make(3)
    whole = D.report(D.find(docs(spark, texts), items_df(spark, items))).collect()
    parts = D.report(D.find(docs(spark, texts), items_df(spark, items), block_words=10)).collect()
    assert sorted(whole) == sorted(parts)


def test_no_items_and_no_documents(spark):
    assert D.find(docs(spark, []), items_df(spark, [(1, "a b c")])).count() == 0
    assert {r.n_items for r in D.report(D.find(docs(spark, EDGE), items_df(spark, []))).collect()} == {0}


def test_clean(spark):
    item = "one two three four five six seven eight nine"
    clean = "Other words, that stand alone. " * 5
    rows = [(1, f"{clean}One two, three four FIVE six seven eight nine! {clean}"), (2, item), (3, clean), (4, None), (5, LONG)]
    got = {r.doc_id: r.text for r in D.clean(docs(spark, rows), items_df(spark, [(1, item)])).collect()}
    assert got == {1: f"{clean}! {clean}", 3: clean, 4: None, 5: LONG}


def test_clean_in_blocks_gives_the_same(spark):
    items, texts = make(4)
    rows = [*texts, *texts[:3], (None, "a b c a b c a b"), *EDGE]
    for how in ({"max_share": 0.3}, {"max_words": 9, "max_coverage": 1.5, "max_share": 0.3}):
        whole, parts = (D.clean(docs(spark, rows), items_df(spark, items), block_words=n, **how) for n in (D.BLOCK_WORDS, 10))
        assert whole.columns == parts.columns
        want = sorted(map(repr, whole.collect()))
        assert want == sorted(map(repr, parts.collect())) and 0 < len(want) < len(rows)


def test_clean_after_a_clashing_name(spark):
    df = docs(spark, [(1, "x"), (2, "a b c d")], extra=False).selectExpr("*", "'clash' as _hit2", "1 as n_chars")
    got = D.clean(df, items_df(spark, [(i, f"{a} {b}") for i, (a, b) in enumerate(["ab", "cd"] * 9)]), block_words=1, max_share=1.0).collect()
    assert sorted((r.doc_id, r.text, r._hit2, r.n_chars) for r in got) == [(1, "x", "clash", 1), (2, "", "clash", 0)]

import random

import numpy as np

import corpus_pipeline
from inkstone.llm import neardup

WORDS = [f"w{i}" for i in range(3000)]


def edited(words, rng, share):
    return [rng.choice(WORDS) if rng.random() < share else w for w in words]


def expected(rows):
    """Ids that stay by all pairs."""
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and len(x & y) >= 0.8 * len(x | y) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if v == old else v for i, v in label.items()}
    return sorted(i for i in sets if label[i] == i)


def test_edited_copies(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(12):
        text = [rng.choice(WORDS) for _ in range(rng.choice([60, 200, 900]))]
        # from copies of similarity above 0.9 to texts below 0.8
        rows += [(len(rows) + k, " ".join(edited(text, rng, share))) for k, share in enumerate([0, 0.004, 0.01, 0.02, 0.02, 0.05])]
    rows += [(1000, ""), (1001, "  "), (1002, "One two"), (1003, "one TWO"), (1004, "one three")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == expected(rows)
    assert len(kept) < 50


def test_large_group_null_and_repeated_ids(spark):
    rng = random.Random(8)
    text = [rng.choice(WORDS) for _ in range(300)]
    rows = [(i, " ".join(edited(text, rng, 0.006))) for i in range(200)]
    assert (want := expected(rows))
    extra = [(None, " ".join(text)), (None, None), (5000, "alone here"), (5000, rows[0][1])]
    docs = spark.createDataFrame(rows + extra, "doc_id bigint, text string")
    kept = [r.doc_id for r in neardup.deduplicate(docs).collect()]
    assert sorted(i for i in kept if i is not None and i < 5000) == want
    assert kept.count(None) == 2 and 5000 not in kept


def test_links_come_from_the_trie_join(spark, monkeypatch):
    rng = random.Random(9)
    text = [rng.choice(WORDS) for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join([*text[: 50 * i], "changed", *text[50 * i + 1 :]])) for i in range(4)], "doc_id bigint, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [0]
    monkeypatch.setattr(neardup, "join_chunks", lambda dealt, **_: dealt.selectExpr("node a", "node b").limit(0))
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == 4


def test_candidates_against_all_pairs(spark):
    rng = random.Random(10)
    rows = []
    for copies in [150, 20, *[2] * 120]:
        text = [rng.choice(WORDS) for _ in range(rng.choice([12, 60, 300]))]
        rows += [" ".join(edited(text, rng, rng.choice([0.01, 0.03, 0.06]))) for _ in range(copies)]
    docs = spark.createDataFrame([*enumerate(rows), (9000, "a short one"), (9001, "")], "doc_id bigint, text string")
    leaves = neardup.prints(docs).drop("key").distinct().cache()
    found = [(r[0], np.array(r[1:], dtype=np.int64).view(np.uint64)) for r in leaves.collect() if r[1] is not None]
    assert len(found) < leaves.count()  # short sets have no print
    chosen = neardup.choices(len(found))
    bits = np.stack([np.unpackbits(p.view(np.uint8), bitorder="little") for _, p in found])
    assert chosen.shape[1] > 0
    want = {node: node for node, _ in found}

    def join(label, a, b):
        old, new = max(label[a], label[b]), min(label[a], label[b])
        return {k: new if v == old else v for k, v in label.items()} if old != new else label

    got = dict(want)
    for i, (node, print_) in enumerate(found):
        differ = bits[i] != bits
        near = (differ.sum(axis=1) <= neardup.BUDGET) & (differ[:, :64].sum(axis=1) <= neardup.LEAD_BUDGET)
        for j in np.flatnonzero(near & ~differ[:, chosen].any(axis=2).all(axis=1)):
            want = join(want, node, found[j][0])
    for group_rows in (40, 30_000):
        label = got
        for a, b in neardup.candidates(leaves, group_rows=group_rows).collect():
            label = join(label, a, b)
        assert label == want
    assert 1 < len(set(want.values())) < len(found) - 200

import random

import numpy as np
import xxhash

from inkstone.llm import simhash as S
from inkstone.operators.graph import components
from tests.llm.helpers import EDGE, docs


def print_of(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [print_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(repr((doc, f"{fps[i]:016x}", least.get(root(i)))) for i, (doc, _) in enumerate(rows))


def texts(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if out and r.random() < 0.6:
            words = out[r.randrange(len(out))][1].split()
            words[r.randrange(len(words))] = r.choice("xyz")
            out.append((i, " ".join(words)))
        else:
            out.append((i, " ".join(r.choice(["a", "b", "c", "d", "e"]) for _ in range(r.randrange(1, 120)))))
    return out


def test_against_brute_force(spark):
    rows = [*((i + 100, t) for i, t in texts(150, 1)), *EDGE]
    want = brute(rows)
    for group_rows in (30_000, 7):
        got = S.near_duplicates(docs(spark, rows), group_rows=group_rows).collect()
        assert sorted(repr(tuple(r)) for r in got) == want


def test_trie_join_finds_every_pair():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in r.choice(64, int(k), replace=False)) for k in r.integers(0, 8, 400)]
    value = np.unique(base[r.integers(0, 40, 400)] ^ np.array(flips, dtype=np.uint64))
    zero = np.zeros(len(value), dtype=np.int64)
    got = {tuple(sorted(p)) for i, j in S.trie_join(zero, zero, value) for p in zip(i.tolist(), j.tolist())}
    want = {(i, j) for i in range(len(value)) for j in range(i + 1, len(value)) if int(value[i] ^ value[j]).bit_count() <= 4}
    assert got == want


def test_tables_agree_in_enough_blocks():
    for n in (10, 10**6, 10**10):
        for blocks in S.tables(n):
            assert sum(w for _, w in blocks) <= 64
        covered = {b for t in S.tables(n) for low, w in t for b in range(low, low + w)}
        assert covered == set(range(64))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (200, 200), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 200}


def test_empty_and_deduplicate(spark):
    assert S.near_duplicates(docs(spark, [])).count() == 0
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (5, "totally other words stand in here now")]
    assert sorted(r.doc_id for r in S.deduplicate(docs(spark, rows)).collect()) == [1, 3, 5]

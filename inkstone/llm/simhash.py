"""SimHash near-duplicates with a binary trie self-join.

Fingerprints of 64 bits link if they differ in at most ``budget`` bits. Two such fingerprints agree
on at least ``blocks - budget`` of ``blocks`` bit blocks, so for each choice of that many blocks the
fingerprints that agree there form a group, and each group's remaining bits form a binary trie. The
trie is joined with itself: pairs of nodes go down together, the bits in which their edges differ
add up, and a pair is dropped as soon as they exceed the budget. A trie is a range of sorted numbers
and a node a sub-range of it, so a whole level of node pairs is a few array operations.

Equal fingerprints are one leaf. A group of more than ``group_rows`` leaves is cut into chunks
and each pair of chunks is joined by a task of its own, so no task holds an unbounded group. Tasks
return a spanning forest of the links they find; components come from a distributed algorithm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import as_bytes, durable, id_kind, ids_and, map_arrow, unused
from inkstone.operators.graph import components

BITS = 64
BUDGET = 4
SHINGLE = 4
SEED = 42
GROUP_ROWS = 30_000
PAIRS_AT_ONCE = 1 << 17
STAR = 64
PIVOTS = (0.5, 0.25, 0.75, 0.1)

PLAIN_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a UTF-8 text as a signed number; no words: 0."""
    words = text.translate(PLAIN_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[: -shingle] + 1]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    sums = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], dtype="<u8")
        sums += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * sums > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint of every whole text; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle, seed) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], schema=schema)

    return map_arrow(ids_and(docs, id_col, text_col), run, f"doc_id {id_kind(docs, id_col)}, fp bigint")


def tables(n: int, budget: int = BUDGET) -> list[list[tuple[int, int]]]:
    """Block choices as lists of (lowest bit, width), such that a group of random numbers stays small.

    More blocks leave more bits to agree in and more tables; the fewest blocks are taken that leave
    some 64 numbers a group.
    """
    need = max(1.0, math.log2(max(n, 2) / 64))
    for blocks in range(budget + 1, budget + 5):
        if BITS * (blocks - budget) / blocks >= need:
            break
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return [[(cuts[i], cuts[i + 1] - cuts[i]) for i in chosen] for chosen in combinations(range(blocks), blocks - budget)]


def _least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node that the edges lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def trie_join(group: np.ndarray, side: np.ndarray, value: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values of one group that differ in at most ``budget`` bits.

    Arrays are sorted by group, side and value (unsigned). A group with one side is joined with
    itself; in a group with two sides, rows of one side are joined with rows of the other.
    """
    cut = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])])
    end = np.r_[cut[1:], len(group)]
    same = np.flatnonzero(group[cut[:-1]] == group[cut[1:]]) if len(cut) > 1 else np.array([], dtype=np.int64)
    # frontier: node pairs as (range of a, range of b, errors so far); a pair of a node with itself has equal ranges
    lone = np.setdiff1d(np.arange(len(cut)), np.r_[same, same + 1])
    left, right = np.r_[lone, same], np.r_[lone, same + 1]
    stack = [(cut[left], end[left], cut[right], end[right], np.zeros(len(left), np.int8), BITS - 1)]
    while stack:
        a0, a1, b0, b1, err, bit = stack.pop()
        work = (a1 - a0) * (b1 - b0)
        small = work <= (64 if bit >= 0 else PAIRS_AT_ONCE)
        if small.any():
            p0, p1, q0, q1 = a0[small], a1[small], b0[small], b1[small]
            sizes = (p1 - p0) * (q1 - q0)
            stops = np.cumsum(sizes)
            low = 0
            while low < len(sizes):
                high = max(low + 1, int(np.searchsorted(stops, (stops[low - 1] if low else 0) + PAIRS_AT_ONCE, "right")))
                k = np.repeat(np.arange(low, high), sizes[low:high])
                within = np.arange(len(k)) - np.repeat(stops[low:high] - sizes[low:high] - (stops[low - 1] if low else 0), sizes[low:high])
                width = (q1 - q0)[k]
                i, j = p0[k] + within // width, q0[k] + within % width
                near = np.bitwise_count(value[i] ^ value[j]) <= budget
                near &= (p0[k] != q0[k]) | (i < j)
                if near.any():
                    yield i[near], j[near]
                low = high
        a0, a1, b0, b1, err = (x[~small] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        if len(a0) > PAIRS_AT_ONCE:
            half = len(a0) // 2
            stack += [tuple(x[s] for x in (a0, a1, b0, b1, err)) + (bit,) for s in (slice(half), slice(half, None))]
            continue
        # below the last bit values are equal: what is left of such ranges is halved until it is a bounded number of pairs
        am, bm = (_middle(value, a0, a1, bit), _middle(value, b0, b1, bit)) if bit >= 0 else ((a0 + a1) >> 1, (b0 + b1) >> 1)
        mine, other = a0 == b0, err + (bit >= 0)
        children = [
            (a0, am, b0, bm, err, np.ones(len(a0), bool)),
            (am, a1, bm, b1, err, np.ones(len(a0), bool)),
            (a0, am, bm, b1, other, np.ones(len(a0), bool)),
            (am, a1, b0, bm, other, ~mine),
        ]
        parts = []
        for x0, x1, y0, y1, e, ok in children:
            ok = ok & (x1 > x0) & (y1 > y0) & (e <= budget)
            parts.append([z[ok] for z in (x0, x1, y0, y1, e)])
        stack.append(tuple(np.concatenate(z) for z in zip(*parts)) + (bit - 1,))


def _middle(value: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """Where in each sorted range the values have the bit set; all bits above are equal in a range."""
    low, high = low.copy(), high.copy()
    one = np.uint64(1) << np.uint64(bit)
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        is_set = np.zeros(len(low), bool)
        is_set[open_] = (value[mid[open_]] & one) != 0
        high = np.where(open_ & is_set, mid, high)
        low = np.where(open_ & ~is_set, mid + 1, low)
    return low


def wide_join(group: np.ndarray, side: np.ndarray, value: np.ndarray, budget: int, rest: list[np.ndarray], whole: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that connect what trie_join's pairs of at most ``whole`` differing bits over value and ``rest`` connect.

    Where ``STAR`` or more rows of a group are near one of its rows, these are linked with it and the others
    are joined with them, so rows of a large group of near copies are not joined with each other.
    """

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        lead = np.bitwise_count(value[i] ^ value[j])
        return (lead <= budget) & (sum((np.bitwise_count(x[i] ^ x[j]) for x in rest), lead.astype(np.int64)) <= whole)

    def joined(rows: np.ndarray, sides: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in trie_join(group[rows], sides, value[rows], budget):
            i, j = rows[i], rows[j]
            ok = near(i, j)
            if ok.any():
                yield i[ok], j[ok]

    def spans(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.r_[True, group[rows][1:] != group[rows][:-1]])
        return first, np.diff(np.r_[first, len(rows)])

    first, n = spans(np.arange(len(value)))
    two = np.repeat(side[first] != side[first + n - 1], n)
    rows = np.flatnonzero(np.repeat(n >= STAR, n))
    done = np.zeros(len(value), bool)
    for share in PIVOTS:
        if not len(rows):
            break
        first, n = spans(rows)
        pivot = np.repeat(rows[first + (n * share).astype(np.int64)], n)
        linked = near(rows, pivot)
        many = np.add.reduceat(linked.astype(np.int64), first)
        linked &= np.repeat(many >= STAR, n)
        yield rows[linked], pivot[linked]
        mixed = np.repeat((many >= STAR) & (many < n), n)
        part, sides = rows[mixed], linked[mixed].astype(np.int64)
        order = np.lexsort((value[part], sides, group[part]))
        if len(part):
            yield from joined(part[order], sides[order])
        done[rows[linked]] = True
        rows = rows[~linked]
    rows = np.flatnonzero(~done)
    if len(rows):
        # a group of two sides may have lost one
        first, n = spans(rows)
        rows = rows[np.repeat(~two[rows[first]] | (side[rows[first]] != side[rows[first + n - 1]]), n)]
    if len(rows):
        yield from joined(rows, side[rows])


def _forest(group: np.ndarray, side: np.ndarray, value: np.ndarray, node: np.ndarray, budget: int, rest: list[np.ndarray], whole: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of nodes, of the links within each group; over value and ``rest`` they have at most ``whole`` bits."""
    order = np.lexsort((value, side, group))
    group, side, value, node = group[order], side[order], value[order], node[order]
    rest = [x[order] for x in rest]
    label = np.arange(len(value))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for i, j in wide_join(group, side, value, budget, rest, whole) if rest else trie_join(group, side, value, budget):
        i, j = label[i], label[j]
        new = i != j
        held.append((i[new], j[new]))
        size += int(new.sum())
        if size >= PAIRS_AT_ONCE:
            label = _least_labels(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), len(label))[label]
            held, size = [], 0
    if held:
        label = _least_labels(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), len(label))[label]
    linked = np.flatnonzero(label != np.arange(len(label)))
    return node[label[linked]], node[linked]


def links(leaves: DataFrame, *, budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges ``a, b`` between nodes of ``fp, node`` (fp distinct) that connect what links connect.

    Links between different fingerprints are all found; of the links inside a task's group a spanning
    forest is returned, which has the same components.
    """
    spark = leaves.sparkSession
    chosen = tables(leaves.count(), budget)
    keys = []
    for t, blocks in enumerate(chosen):
        key, shift = F.lit(0).cast("bigint"), 0
        for low, width in blocks:
            part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
            key = key.bitwiseOR(F.shiftleft(part, shift))
            shift += width
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    rows = leaves.select("fp", "node", F.explode(F.array(*keys)).alias("g")).select("fp", "node", "g.t", "g.key")
    big = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > group_rows).select("t", "key", F.ceil(F.col("n") / group_rows).cast("int").alias("chunks"))
    dealt = rows.join(big, ["t", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    return join_chunks(dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks").cast("bigint")).cast("int")), budget=budget, group_rows=group_rows)


def forest(edges: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect what the edges of each partition connect, fewer than its nodes; a partition is held in memory."""

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches]
        if held:
            nodes, ids = np.unique(np.concatenate(held, axis=1), return_inverse=True)
            label = _least_labels(*ids.reshape(2, -1), len(nodes))
            linked = np.flatnonzero(label != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[label[linked]], pa.int64()), pa.array(nodes[linked], pa.int64())], schema=schema)

    return map_arrow(edges.select("a", "b"), run, "a bigint, b bigint")


def join_chunks(dealt: DataFrame, *, budget: int, group_rows: int, rest: tuple[str, ...] = (), whole: int = BITS) -> DataFrame:
    """Edges ``a, b`` that connect what the trie joins within the groups of ``t, key, own, chunks, fp, node`` connect.

    ``own`` is a row's chunk of the ``chunks`` of its group. Fingerprints of several words have the others in
    the columns ``rest``; linked ones then differ in at most ``whole`` bits, ``budget`` of them in ``fp``.
    """
    # a group in one chunk is one item of work; else each chunk meets itself and every other chunk
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp", "node", *rest)
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:

        def solve(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            t, key, i, j, side, fp, node, *words = (np.concatenate(x) for x in zip(*parts))
            new = np.r_[False, (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            a, b = _forest(np.cumsum(new), side, fp.view(np.uint64), node, budget, [x.view(np.uint64) for x in words], whole)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if size >= 2 * group_rows and len(columns[0]):
                # whole groups only: cut where the last held group ends
                last = [held[-1][k][-1] for k in range(4)]
                same = np.logical_and.reduce([columns[k] == last[k] for k in range(4)])
                stop = int(np.argmin(same)) if not same.all() else len(same)
                held.append([c[:stop] for c in columns])
                columns = [c[stop:] for c in columns]
                if len(columns[0]):
                    yield solve(held)
                    held, size = [], 0
            if len(columns[0]):
                held.append(columns)
                size += len(columns[0])
        if held:
            yield solve(held)

    return map_arrow(dealt, run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, budget: int = BUDGET, seed: int = SEED, group_rows: int = GROUP_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    component_id is the least doc_id reachable over links; equal fingerprints link, so texts without
    words form one component. A row without doc_id takes part through its fingerprint; if no row of
    its component has an id, component_id is null. Ids that are no whole numbers are strings, the least
    in their order.
    """
    prints = durable(fingerprints(docs, shingle=shingle, seed=seed, id_col=id_col, text_col=text_col))
    # the node of a fingerprint is the fingerprint itself: unique, also where ids are null or repeat
    leaves = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = links(leaves.select("fp", F.col("fp").alias("node")), budget=budget, group_rows=group_rows)
    found = components(edges)
    named = found.join(leaves, found["node"] == leaves["fp"]).groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = found.join(named, "component").select(F.col("node").alias("linked"), "component_id")
    owners = leaves.join(by_print, leaves["fp"] == by_print["linked"], "left").select(F.col("fp").alias("owner"), F.coalesce("component_id", "least").alias("component_id"))
    # as a table of its own it meets the rows in a join whose two sides Spark can split where a fingerprint is hot
    owners = durable(owners)
    return prints.join(owners, prints["fp"] == owners["owner"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, *, shingle: int = SHINGLE, budget: int = BUDGET, seed: int = SEED) -> DataFrame:
    """Of each component the row with the least doc_id stays; rows without doc_id stay.

    Among rows of one doc_id all stay or all go.
    """
    found = near_duplicates(docs, shingle=shingle, budget=budget, seed=seed)
    (gone_id,) = unused(docs, "gone_id")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col("doc_id").cast(id_kind(docs)) == F.col(gone_id), "left_anti")

"""Near-duplicates by the Jaccard similarity of five-word shingles, for the pipeline's stage.

Texts link if their shingle sets have a similarity of at least ``SIMILARITY``. Candidates come from
SimHash and the trie self-join of ``inkstone.llm.simhash``: a set has a fingerprint of ``WORDS`` words of
64 bits, and a candidate pair differs in at most ``BUDGET`` bits, ``LEAD_BUDGET`` of them in the first word,
whose trie is joined with itself. Sets of similarity 0.8 differ in some 15 per cent of their bits, so no
choice of blocks would have to agree for certain; the trie joins run within groups that agree in some
of many choices of bits instead, and ``choices`` takes enough of them for a pair of that similarity. What the joins
connect is one candidate group, and each pair of a group is then compared by its whole shingle sets, so
no pair below the similarity links.

Texts of one shingle set are one leaf. A group is cut into some ``sqrt(leaves / 8)`` chunks and each
pair of chunks is compared by a task of its own; tasks return a spanning forest of what they find.
Texts without words have one set, the empty one; a text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import as_bytes, durable, id_number, map_arrow, unused
from inkstone.operators.graph import components
from inkstone.llm.simhash import BITS, GROUP_ROWS, PLAIN_LOWER, forest, join_chunks

SHINGLE = 5
SIMILARITY = 0.8
WORDS = 4
BUDGET = 72
LEAD_BUDGET = 26
#: Share of bits that differ between sets of equal size and the similarity: the angle of their vectors.
DIFFER = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
MISSED = 0.00001
EDGES = 1 << 20
#: Sets of fewer shingles are equal or below the similarity.
LEAST = math.ceil(SIMILARITY / (1 - SIMILARITY) - 1e-9)
SEED = 42
_LAST = 2**63 - 1
_AT_ONCE = 1 << 12
_KEYS = np.random.default_rng(SEED).integers(0, 1 << 64, WORDS, dtype=np.uint64)
_PRINT = [f"f{i}" for i in range(WORDS)]


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's shingles; no words: none."""
    words = text.translate(PLAIN_LOWER).split()
    n = max(1, len(words) - shingle + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)], dtype=np.uint64))


def node_of(found: np.ndarray) -> int:
    """A signed number that stands for a shingle set."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED))))


def fingerprint(found: np.ndarray) -> list[int]:
    """The SimHash of a shingle set that is not empty, as signed numbers; where a bit is even, the first hash decides."""
    sums = np.zeros(BITS * WORDS, dtype=np.int64)
    first = None
    for i in range(0, len(found), _AT_ONCE):
        x = found[i : i + _AT_ONCE, None] ^ _KEYS
        for times in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x ^= x >> np.uint64(33)
            x *= np.uint64(times)
        x ^= x >> np.uint64(33)
        bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
        first = bits[0].astype(np.int64) if first is None else first
        for k in range(0, len(bits), 255):
            sums += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * sums + first > len(found), bitorder="little").view("<i8").tolist()


def choices(n: int) -> np.ndarray:
    """Bit choices, one a row, for n sets: so many bits that some 256 random prints agree in them, and so many choices that a pair agrees in one.

    A bit stands in as many choices as any other, give or take one.
    """
    width = max(0, math.ceil(math.log2(max(n, 1) / 256)))
    if not width:
        return np.zeros((1, 0), dtype=np.int64)
    number = math.ceil(math.log(MISSED) / math.log1p(-((1 - DIFFER) ** width)))
    bits = BITS * WORDS
    rng = np.random.default_rng(SEED)
    each = bits // width
    dealt = [rng.permutation(bits)[: each * width].reshape(each, width) for _ in range(math.ceil(number / each))]
    return np.concatenate(dealt)[:number]


def _key(docs: DataFrame) -> Column:
    return F.coalesce(id_number(docs), F.lit(_LAST)).alias("key")


def prints(docs: DataFrame) -> DataFrame:
    """``key, node, f0, f1, ...``: the shingle set of every row by its number, and its fingerprint; none for sets that only equal ones link with."""

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in as_bytes(batch.column(1))]
            found = [fingerprint(s) if len(s) >= LEAST else [None] * WORDS for s in sets]
            columns = [list(map(node_of, sets)), *([f[k] for f in found] for k in range(WORDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], schema=schema)

    return map_arrow(docs.select(_key(docs), "text"), run, "key bigint, node bigint, " + ", ".join(f"{f} bigint" for f in _PRINT))


def candidates(leaves: DataFrame, *, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges ``a, b`` between nodes of ``node, f0, f1, ...`` that connect what trie joins connect, in each group that agrees in a choice of bits."""
    able = leaves.where(f"{_PRINT[0]} is not null").select("node", *_PRINT)
    chosen = choices(able.count())

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(chosen.shape[1])
        for batch in batches:
            if not batch.num_rows:
                continue
            words = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
            keys = np.stack([bits[:, c] @ weights for c in chosen], axis=1).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * len(chosen), pa.int32()), pa.array(keys.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists.cast(schema.field("keys").type)], schema=schema)

    keyed = map_arrow(able, run, "node bigint, " + ", ".join(f"{f} bigint" for f in _PRINT) + ", keys array<bigint>")
    rows = keyed.select("node", *_PRINT, F.posexplode("keys").alias("t", "key"))
    # few groups are larger than group_rows, at most the choices times the leaves over group_rows
    big = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > group_rows).select("t", "key", F.ceil(F.col("n") / group_rows).cast("int").alias("chunks"))
    dealt = rows.join(F.broadcast(big), ["t", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks").cast("bigint")).cast("int")).withColumnRenamed(_PRINT[0], "fp")
    return join_chunks(dealt, budget=LEAD_BUDGET, group_rows=group_rows, rest=tuple(_PRINT[1:]), whole=BUDGET)


def similar(sets: list[np.ndarray], side: np.ndarray, similarity: float = SIMILARITY) -> Iterator[tuple[int, int]]:
    """Index pairs that connect what pairs of at least the similarity connect; across the sides if there are two."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
    here = np.zeros(len(distinct), dtype=np.int32)
    label = np.arange(len(sets))
    two = side[0] != side[-1]
    last = int(np.argmax(side == 1)) if two else len(sets)
    for k in range(last):
        low = last if two else k + 1
        if low == len(sets) or (label[low:] == label[k]).all():
            continue
        mine = ids[starts[k] : starts[k] + sizes[k]]
        here[mine] = 1
        both = np.add.reduceat(here[ids[starts[low] :]], starts[low:] - starts[low])
        here[mine] = 0
        near = both >= similarity * (sizes[k] + sizes[low:] - both) - 1e-9
        for j in (low + np.flatnonzero(near)).tolist():
            if label[j] != label[k]:
                label[label == label[j]] = label[k]
                yield k, j


def links(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """Edges ``a, b`` between nodes of ``node, least, f0, f1, ...`` that connect what similarity connects."""
    # several choices find the links of a group of near copies: a forest of them goes on
    near = durable(candidates(leaves))
    near = durable(forest(near.coalesce(math.ceil(max(1, near.count()) / EDGES))))
    groups = durable(components(near))
    sized = durable(groups.groupBy("component").agg(F.count("*").alias("n")).selectExpr("component g", "cast(ceil(sqrt(n / 8)) as int) chunks"))
    dealt = groups.join(sized, F.col("component") == F.col("g")).select("g", "chunks", "node")
    wanted = durable(dealt.join(leaves.select(F.col("node").alias("leaf"), "least"), F.col("node") == F.col("leaf")).select("least", "leaf", "g", "chunks"))
    texts = docs.select(_key(docs), "text")
    # rows of one id can have several texts: what is read must have the leaf's set
    read = texts.join(wanted, F.col("key") == F.col("least")).select("text", "leaf", "g", "chunks")

    def take(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in as_bytes(batch.column(0))]
            right = np.array([node_of(s) == n for s, n in zip(sets, batch.column(1).to_pylist())], dtype=bool)
            kept = [s.tobytes() for s, ok in zip(sets, right) if ok]
            yield pa.RecordBatch.from_arrays([*(c.filter(pa.array(right)) for c in batch.columns[1:]), pa.array(kept, pa.binary())], schema=schema)

    held = map_arrow(read, take, "leaf bigint, g bigint, chunks int, words binary")
    own = F.pmod(F.xxhash64("leaf"), F.col("chunks").cast("bigint")).cast("int")
    held = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    held = held.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "leaf", "words")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = held.repartition(n, "g", "i", "j").sortWithinPartitions("g", "i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        group: tuple[int, int, int] | None = None
        rows: dict[int, tuple[int, np.ndarray]] = {}

        def solve() -> pa.RecordBatch:
            side = np.array([s for s, _ in rows.values()])
            nodes = list(rows)
            pairs = [(nodes[a], nodes[b]) for a, b in similar([x for _, x in rows.values()], side)] if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=schema)

        for batch in batches:
            for g, i, j, side, leaf, words in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, i, j) != group:
                    if rows:
                        yield solve()
                    group, rows = (g, i, j), {}
                rows[leaf] = (side, np.frombuffer(words, dtype=np.uint64))
        if rows:
            yield solve()

    return map_arrow(held, run, "a bigint, b bigint")


def deduplicate(docs: DataFrame) -> DataFrame:
    """Of each component the row with the least doc_id stays; rows without doc_id stay.

    Among rows of one doc_id all stay or all go. Of ids that are no whole numbers the one with the
    least hash stays.
    """
    rows = durable(prints(docs))
    leaves = durable(rows.groupBy("node").agg(F.min("key").alias("least"), *(F.min(f).alias(f) for f in _PRINT)))
    found = components(durable(links(docs, leaves)))
    named = found.join(leaves.select(F.col("node").alias("leaf"), "least"), F.col("node") == F.col("leaf")).select("component", "leaf", "least")
    best = named.groupBy("component").agg(F.min("least").alias("best")).withColumnRenamed("component", "c")
    by_leaf = named.join(best, F.col("component") == F.col("c")).select(F.col("leaf").alias("linked"), "best")
    # as a table of its own it meets the rows in a join whose two sides Spark can split where a set is hot
    owners = durable(leaves.join(by_leaf, F.col("node") == F.col("linked"), "left").select(F.col("node").alias("owner"), F.coalesce("best", "least").alias("best")))
    (gone_id,) = unused(docs, "gone_id")
    gone = rows.join(owners, F.col("node") == F.col("owner")).where(f"key > best and key <> {_LAST}").select(F.col("key").alias(gone_id)).distinct()
    return docs.join(gone, id_number(docs) == F.col(gone_id), "left_anti")

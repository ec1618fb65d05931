"""Cross-entropy difference of matched target and background bigram models.

The target is the documents labelled good (quality 1, toxic 0). The background is as many of the other
documents, give or take a few, chosen by a hash of the id, so neither corpus holds the other's documents.
Both are dealt to two folds by another hash. A document is scored by the models of the fold that it is
not in, so no document is scored by a model that has seen it. Within a fold both models share one
vocabulary, the words that stand at least ``LEAST`` times in the two corpora together, and ``<unk>`` for all
others; and the same bigrams, those that stand at least ``LEAST`` times. With c the counts in a model's
corpus, k those of kept bigrams, V the vocabulary with ``<unk>`` and N the corpus's words::

    P1(w) = (c(w) + BETA) / (N + BETA * V)
    P(w | v) = (k(v, w) + ALPHA * P1(w)) / (sum of k(v, .) + ALPHA)

A document's score is the mean over its words of the loss under the target minus that under the
background, in nats: lower is more like the target.

A loss is a sum of weights of the document's words and bigrams, so models are tables of weights by
a 64-bit hash of the gram, which grow with the corpora and are never gathered. Texts are turned, a
chunk at a time, into the sorted hashes of their grams and the rows that hold them. The ``HEAD`` most
frequent grams, a broadcast of bounded size, are weighed on the spot; all others are dealt, like their
weights, by the hash's first bits to tasks that each hold a share of the weights, and what they add
to each row's losses comes back chunk by chunk. The head only saves traffic: no result depends on it.

Null and empty texts have no words: no cross-entropies and no score. Labels that repeat with another
value, or are null, mark no target. Repeated rows count as often as they stand. Rows without id are
in neither corpus and are scored by the models of the first fold. Ids may be whole numbers or strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import as_bytes, durable, id_kind, ids_and, map_arrow, plain_words

LEAST = 2
ALPHA = 32.0
BETA = 0.1
#: Words and rows of a chunk: what a worker holds of the corpus at a time, give or take one text.
CHUNK_WORDS = 1_000_000
CHUNK_ROWS = 1 << 14
#: Weights that a task holds, and weights that every worker holds, some 40 bytes each.
TASK_GRAMS = 2_000_000
HEAD = 1 << 19
#: Documents of both corpora whose bigrams one task counts, and up to which their ids are broadcast.
TASK_DOCS = 20_000
BROADCAST_IDS = 2_000_000
_START, _END, _WORD = 1, 2, 0  # what stands before the first word, after the last, and "before" a single word


def targets(labels: DataFrame, kind: str = "bigint") -> DataFrame:
    """``target_id`` of the documents that are labelled good."""
    known = labels.select(F.col("doc_id").cast(kind).alias("target_id"), "quality", "toxic").where("target_id is not null")
    good = known.groupBy("target_id").agg(F.every((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"), F.count("*").alias("n"), F.count("quality").alias("q"), F.count("toxic").alias("t"))
    return good.where("good and q = n and t = n").select("target_id")


def fold(doc_id: str) -> Column:
    """The fold of a document: 0 or 1; without id: 1, so that the first fold's models score it."""
    return F.when(F.col(doc_id).isNull(), F.lit(1)).otherwise(F.pmod(F.xxhash64(doc_id, F.lit("fold")), F.lit(2)).cast("int"))


def roles(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``train_id, cell`` of the documents of both corpora: twice the fold, plus 1 in the background."""
    kind = id_kind(docs)
    ids = docs.select(F.col("doc_id").cast(kind).alias("train_id")).where("train_id is not null").distinct()
    marked = durable(ids.join(targets(labels, kind), F.col("train_id") == F.col("target_id"), "left").select("train_id", F.col("target_id").isNotNull().alias("good")))
    n, good = marked.agg(F.count("*"), F.coalesce(F.sum(F.col("good").cast("bigint")), F.lit(0))).first()
    share = min(1.0, good / max(1, n - good))
    low = F.xxhash64("train_id", F.lit("side")).cast("double") < F.lit(share * 2.0**64 - 2.0**63)
    return marked.where(F.col("good") | low).select("train_id", (fold("train_id") * 2 + F.when(F.col("good"), 0).otherwise(1)).alias("cell"))


def mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of word hashes."""
    x = (before ^ (before >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Hashes of words; ``known`` keeps those of a chunk's words."""
    digest = xxhash.xxh64_intdigest
    get = known.get
    for w in set(words):
        if w not in known:
            known[w] = digest(w, 0) | 4  # apart from _START, _END and _WORD
    return np.fromiter(map(get, words), np.uint64, len(words))


def _chunks(batches: Iterator[pa.RecordBatch], most_words: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(rows' other values, rows' word hashes) of batches whose first column is texts."""
    extra: list[tuple] = []
    held: list[np.ndarray] = []
    known: dict[bytes, int] = {}
    size = 0
    for batch in batches:
        for text, *other in zip(as_bytes(batch.column(0)), *(c.to_pylist() for c in batch.columns[1:])):
            held.append(word_hashes(plain_words(text), known))
            extra.append(tuple(other))
            size += len(held[-1])
            if size >= most_words or len(held) >= CHUNK_ROWS:
                yield extra, held
                extra, held, size, known = [], [], 0, {}
    if held:
        yield extra, held


def _before(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows, the word before each, and the rows' sizes."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    w = np.concatenate(rows)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[(np.cumsum(sizes) - sizes)[sizes > 0]] = _START
    return w, v, sizes


def _row(schema: pa.Schema, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)


_MOST = 63  # times that a mark can say: its other two bits are the cell


def counts(train: DataFrame, parts: int) -> DataFrame:
    """``v, w, n0 .. n3``: how often each bigram of ``text, cell`` stands in each cell, each word, with v = 0, and all
    words, with v = w = 0; bigrams and words under LEAST in both folds are left out.

    Each chunk of texts sends a task the bigrams that end in the task's words: words, how many entries each has, and
    for each entry the word before and a byte with cell and times.
    """

    def deal(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for cells, rows in _chunks(batches, CHUNK_WORDS):
            w, v, sizes = _before(rows)
            if not len(w):
                continue
            cell = np.repeat(np.array([c for (c,) in cells], dtype=np.uint8), sizes)
            order = np.lexsort((cell, v, w))
            w, v, cell = w[order], v[order], cell[order]
            first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (v[1:] != v[:-1]) | (cell[1:] != cell[:-1])])
            times = np.diff(np.r_[first, len(w)])
            # what a byte can't say is said by several entries
            of = np.repeat(np.arange(len(first)), -(-times // _MOST))
            last = np.r_[of[1:] != of[:-1], True]
            times = np.where(last, (times[of] - 1) % _MOST + 1, _MOST)
            w, v, mark = w[first][of], v[first][of], (times.astype(np.uint8) << 2 | cell[first][of]).astype(np.uint8)
            start = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            runs = np.diff(np.r_[start, len(w)]).astype(np.uint32)
            cuts = np.searchsorted(_parts(w[start], parts), np.arange(parts + 1))
            for p in range(parts):
                a, b = int(cuts[p]), int(cuts[p + 1])
                if a < b:
                    x, y = int(start[a]), int(start[b]) if b < len(start) else len(w)
                    yield _row(schema, p=p, words=w[start[a:b]].tobytes(), runs=runs[a:b].tobytes(), before=v[x:y].tobytes(), marks=mark[x:y].tobytes())

    def add(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def summed() -> Iterator[pa.RecordBatch]:
            w = np.concatenate([np.repeat(np.frombuffer(x, np.uint64), np.frombuffer(r, np.uint32)) for x, r, _, _ in held])
            v = np.concatenate([np.frombuffer(b, np.uint64) for _, _, b, _ in held])
            mark = np.concatenate([np.frombuffer(m, np.uint8) for *_, m in held])
            order = np.lexsort((v, w))
            w, v, mark = w[order], v[order], mark[order]
            n = np.zeros((len(w), 4), dtype=np.int64)
            n[np.arange(len(w)), mark & 3] = mark >> 2
            new_w = np.r_[True, w[1:] != w[:-1]]
            pair = np.flatnonzero(new_w | np.r_[True, v[1:] != v[:-1]])
            word = np.flatnonzero(new_w)
            for at, is_pair in ((pair, True), (word, False)):
                total = np.add.reduceat(n, at, axis=0)
                keep = (total[:, 0] + total[:, 1] >= LEAST) | (total[:, 2] + total[:, 3] >= LEAST)
                before = v[at[keep]] if is_pair else np.zeros(int(keep.sum()), dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(before.view(np.int64)), pa.array(w[at[keep]].view(np.int64)), *(pa.array(total[keep, k]) for k in range(4))], schema=schema)
            whole = n.sum(axis=0)
            yield _row(schema, v=0, w=0, **{f"n{k}": int(whole[k]) for k in range(4)})

        for batch in batches:
            for p, *payload in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part and held:
                    yield from summed()
                    held.clear()
                part = p
                held.append(payload)
        if held:
            yield from summed()

    dealt = map_arrow(train.select("text", "cell"), deal, "p int, words binary, runs binary, before binary, marks binary")
    dealt = dealt.repartitionById(parts, F.col("p")).sortWithinPartitions("p")
    return map_arrow(dealt, add, "v bigint, w bigint, n0 bigint, n1 bigint, n2 bigint, n3 bigint")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Weights by gram, and what all documents share.

    The table is ``v, w, n, a0 .. a3``: what the gram adds to the loss under each cell's model, and how often it stands in
    all corpora; v is 0 for a word and w is 2 after a last word. The array has, for each cell, the loss of ``<unk>`` and
    what a text's start adds.
    """
    chosen = durable(roles(docs, labels))
    n_train = chosen.count()
    # ids of a checked size are broadcast, so that texts stay where they are; more ids meet the texts in a sorted join
    chosen = F.broadcast(chosen) if n_train <= BROADCAST_IDS else chosen.hint("merge")
    rows = ids_and(docs, name="id").join(chosen, F.col("id") == F.col("train_id")).select("text", "cell")
    shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = durable(counts(rows, max(shuffled, -(-n_train // TASK_DOCS))))
    totals = kept.where("v = 0 and w = 0").agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in range(4)]).first()
    words = np.array([float(totals[f"n{k}"]) for k in range(4)])
    kept = kept.where("w <> 0")
    keeps = [f"n{2 * g} + n{2 * g + 1} >= {LEAST}" for g in (0, 1)]
    single = kept.where("v = 0")
    seen = single.agg(*[F.coalesce(F.sum(F.when(F.expr(keeps[k // 2]), F.col(f"n{k}"))), F.lit(0)).alias(f"c{k}") for k in range(4)], *[F.count(F.when(F.expr(x), 1)).alias(f"v{g}") for g, x in enumerate(keeps)]).first()
    size = [seen[f"v{k // 2}"] + 1 for k in range(4)]
    unknown = np.array([-np.log((words[k] - seen[f"c{k}"] + BETA) / (words[k] + BETA * size[k])) for k in range(4)])

    def loss(k: int, word: str) -> Column:
        """Of a word by its own share, or of <unk>."""
        own = -F.log((F.col(word.format(k)) + BETA) / F.lit(float(words[k] + BETA * size[k])))
        known = F.expr(f"{word.format(k // 2 * 2)} + {word.format(k // 2 * 2 + 1)} >= {LEAST}")
        return F.when(known, own).otherwise(F.lit(float(unknown[k])))

    def back(k: int, name: str) -> Column:
        """What a context adds to the loss of a word that follows it in no kept bigram."""
        return F.log((F.coalesce(F.col(name.format(k)), F.lit(0)) + ALPHA) / ALPHA)

    pairs = kept.where("v <> 0")
    follows = durable(pairs.groupBy("v").agg(*[F.sum(F.when(F.expr(keeps[k // 2]), F.col(f"n{k}")).otherwise(0)).alias(f"x{k}") for k in range(4)]).withColumnRenamed("v", "context"))
    first = follows.where(f"context = {_START}").first()
    start = np.array([np.log(((first[f"x{k}"] if first else 0) + ALPHA) / ALPHA) for k in range(4)])
    times = (F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3")).alias("n")
    by_word = single.join(follows, F.col("w") == F.col("context"), "left").select("v", "w", times, *[(loss(k, "n{}") + back(k, "x{}")).alias(f"a{k}") for k in range(4)])
    by_end = follows.select(F.col("context").alias("v"), F.lit(_END).cast("bigint").alias("w"), F.lit(LEAST).cast("bigint").alias("n"), *[(-back(k, "x{}")).alias(f"a{k}") for k in range(4)])
    alone = single.select(F.col("w").alias("word"), *[F.col(f"n{k}").alias(f"c{k}") for k in range(4)])

    def correction(k: int) -> Column:
        p1 = F.exp(-loss(k, "c{}"))
        seen_loss = -F.log((F.col(f"n{k}") + ALPHA * p1) / (F.col(f"x{k}") + ALPHA))
        return F.when(F.expr(keeps[k // 2]), seen_loss - loss(k, "c{}") - back(k, "x{}")).otherwise(F.lit(0.0))

    by_pair = pairs.join(alone, F.col("w") == F.col("word")).join(follows, F.col("v") == F.col("context")).select("v", "w", times, *[correction(k).alias(f"a{k}") for k in range(4)])
    return by_word.unionByName(by_end).unionByName(by_pair), np.stack([unknown, start])


#: What a task gets: weights (kind 0), then the grams of chunks (kind 1) and the rows of chunks (kind 2).
_DEALT = "p int, kind int, code bigint, a0 double, a1 double, a2 double, a3 double, chunk bigint, codes binary, times binary, owners binary, ids array<{id}>, sizes array<int>, losses binary"
_BACK = "chunk bigint, kind int, owners binary, ids array<{id}>, sizes array<int>, losses binary"
SCORES = "doc_id {id}, n_words bigint, target_loss double, background_loss double, score double"


def _parts(code: np.ndarray, n: int) -> np.ndarray:
    """Of n tasks the one of each hash, by its first bits."""
    return ((code >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _codes(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hashes of grams; a single word's has the lowest bit, for a word that the weights lack is ``<unk>``."""
    code = mixed(v, w)
    return np.where(v == _WORD, code | np.uint64(1), code & ~np.uint64(1))


_FOLD = np.uint16(1 << 15)  # an owner's highest bit is its fold, the others its place in the chunk


def _added(gains: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners that occur, and the sums of their gains under target and background of the other fold."""
    found, of = np.unique(owners, return_inverse=True)
    other = np.where(owners & _FOLD, 0, 2)
    at = np.arange(len(owners))
    return found, np.stack([np.bincount(of, weights=gains[at, other + m], minlength=len(found)) for m in (0, 1)], axis=1)


def _found(codes: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where asked codes stand in sorted ones, and whether they do."""
    if not len(codes):
        return np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=bool)
    at = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
    return at, codes[at] == asked


def _grams(docs: DataFrame, head: tuple[np.ndarray, np.ndarray], start: np.ndarray, parts: int, kind: str) -> DataFrame:
    """The grams of every chunk of texts that the head lacks, dealt to tasks, and what the head and the texts' starts,
    by fold, add to its rows."""
    shipped = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        known, weights = shipped.value
        number = TaskContext.get().partitionId() << 32
        for extra, rows in _chunks(batches, CHUNK_WORDS):
            w, v, sizes = _before(rows)
            full = np.flatnonzero(sizes)
            last = w[(np.cumsum(sizes) - 1)[full]]
            fold_of = np.array([f for _, f in extra], dtype=np.uint16) << np.uint16(15)
            place = np.arange(len(rows), dtype=np.uint16) | fold_of
            owner = np.repeat(place, sizes)
            code = np.concatenate([_codes(np.zeros_like(w), w), _codes(v, w), _codes(last, np.full_like(last, _END))])
            owner = np.concatenate([owner, owner, place[full]])
            order = np.argsort(code, kind="stable")
            code, owner = code[order], owner[order]
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, dtype=np.int64)
            times = np.diff(np.r_[first, len(code)])
            at, hit = _found(known, code[first])
            here = np.repeat(hit, times)
            owners, sums = _added(weights[np.repeat(at[hit], times[hit])], owner[here])
            losses = start[fold_of >> np.uint16(15)]
            losses[owners & ~_FOLD] += sums
            code, times, owner = code[first][~hit], times[~hit].astype(np.uint32), owner[~here]
            stop = np.r_[0, np.cumsum(times, dtype=np.int64)]
            cuts = np.searchsorted(_parts(code, parts), np.arange(parts + 1))
            for p in range(parts):
                a, b = int(cuts[p]), int(cuts[p + 1])
                if a < b:
                    yield _row(schema, p=p, kind=1, chunk=number, codes=code[a:b].tobytes(), times=times[a:b].tobytes(), owners=owner[stop[a] : stop[b]].tobytes())
            yield _row(schema, p=number % parts, kind=2, chunk=number, ids=[i for i, _ in extra], sizes=sizes.tolist(), losses=losses.tobytes())
            number += 1

    texts = ids_and(docs, name="id").select("text", "id", fold("id").alias("fold"))
    return map_arrow(texts, run, _DEALT.format(id=kind))


def _coded(weights: DataFrame, parts: int, kind: str) -> DataFrame:
    """The weights by hash, dealt to tasks."""

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = _codes(*(batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1)))
            known = {"p": pa.array(_parts(code, parts).astype(np.int32)), "kind": pa.array(np.zeros(len(code), np.int32)), "code": pa.array(code.view(np.int64))}
            known |= {f"a{k}": batch.column(2 + k) for k in range(4)}
            yield pa.RecordBatch.from_arrays([known.get(f.name, pa.nulls(len(code), f.type)) for f in schema], schema=schema)

    return map_arrow(weights.select("v", "w", "a0", "a1", "a2", "a3"), run, _DEALT.format(id=kind))


def _weighed(dealt: DataFrame, unknown: np.ndarray, kind: str) -> DataFrame:
    """What each task's grams add to the losses of each chunk's rows."""

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        part, new = None, []
        codes, weights = np.zeros(0, dtype=np.uint64), np.zeros((0, 4))
        for batch in batches:
            column = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            p, kinds = (column[c].to_numpy(zero_copy_only=False) for c in ("p", "kind"))
            edges = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (kinds[1:] != kinds[:-1])]).tolist() if len(p) else []
            for a, b in zip(edges, [*edges[1:], len(p)]):
                if p[a] != part:
                    part, new = p[a], []
                    codes, weights = np.zeros(0, dtype=np.uint64), np.zeros((0, 4))
                if kinds[a] == 0:
                    some = {c: column[c].slice(a, b - a).to_numpy(zero_copy_only=False) for c in ("code", "a0", "a1", "a2", "a3")}
                    new.append((some["code"].view(np.uint64), np.stack([some[f"a{k}"] for k in range(4)], axis=1)))
                    continue
                if new:
                    codes, weights = (np.concatenate(x) for x in zip(*new))
                    order = np.argsort(codes, kind="stable")
                    codes, weights, new = codes[order], weights[order], []
                for i in range(a, b):
                    value = {c: column[c][i].as_py() for c in ("chunk", "codes", "times", "owners", "ids", "sizes", "losses")}
                    if kinds[a] == 2:
                        yield _row(schema, kind=0, **{c: value[c] for c in ("chunk", "ids", "sizes", "losses")})
                        continue
                    asked = np.frombuffer(value["codes"], dtype=np.uint64)
                    gains = np.where((asked & np.uint64(1) == 1)[:, None], unknown, 0.0)
                    at, hit = _found(codes, asked)
                    gains[hit] = weights[at[hit]]
                    owners, losses = _added(np.repeat(gains, np.frombuffer(value["times"], dtype=np.uint32), axis=0), np.frombuffer(value["owners"], dtype=np.uint16))
                    some = losses.any(axis=1)
                    yield _row(schema, chunk=value["chunk"], kind=1, owners=owners[some].tobytes(), losses=losses[some].tobytes())

    return map_arrow(dealt, run, _BACK.format(id=kind))


def _summed(back: DataFrame, kind: str) -> DataFrame:
    """The losses of every row of every chunk."""

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        head, total = None, None

        def done() -> pa.RecordBatch:
            ids, sizes = head
            mean = total / np.maximum(sizes, 1)[:, None]
            columns = [pa.array(ids, schema.field(0).type), pa.array(sizes)] + [pa.array(x, mask=sizes == 0) for x in (mean[:, 0], mean[:, 1], mean[:, 0] - mean[:, 1])]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for _, kinds, owners, ids, sizes, losses in zip(*(c.to_pylist() for c in batch.columns)):
                if kinds == 0:
                    if head is not None:
                        yield done()
                    head, total = (ids, np.array(sizes, dtype=np.int64)), np.frombuffer(losses).reshape(-1, 2).copy()
                else:
                    found = np.frombuffer(owners, dtype=np.uint16)
                    total[found & ~_FOLD] += np.frombuffer(losses).reshape(-1, 2)
        if head is not None:
            yield done()

    return map_arrow(back, run, SCORES.format(id=kind))


def _head(weights: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame]:
    """The codes and weights of the most frequent grams, at most ``HEAD``, and the weights left."""
    top = 1 << 14  # counts above it are told apart no further
    by_count = sorted(weights.groupBy(F.least("n", F.lit(top).cast("bigint")).alias("n")).agg(F.count("*").alias("grams")).collect(), reverse=True)  # a row for each count
    least, total = top + 1, 0
    for n, grams in by_count:
        total += grams
        if total > HEAD:
            break
        least = n
    chosen = F.least("n", F.lit(top).cast("bigint")) >= least
    rows = weights.where(chosen).select("v", "w", "a0", "a1", "a2", "a3").toArrow()
    v, w = (rows.column(k).to_numpy().view(np.uint64) for k in (0, 1))
    codes = _codes(v, w)
    order = np.argsort(codes)
    return (codes[order], np.stack([rows.column(2 + k).to_numpy() for k in range(4)], axis=1)[order]), weights.where(~chosen)


def score(docs: DataFrame, weights: DataFrame, shared: np.ndarray) -> DataFrame:
    """``doc_id, n_words, target_loss, background_loss, score`` of every row, by what ``fit`` returns."""
    kind = id_kind(docs)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weights = durable(weights)
    head, rest = _head(weights)
    parts = max(n, -(-rest.count() // TASK_GRAMS))
    # the models of a document's start are those of the other fold
    start = np.stack([shared[1][2:], shared[1][:2]])
    dealt = _coded(rest, parts, kind).unionByName(_grams(docs, head, start, parts, kind))
    dealt = dealt.repartitionById(parts, F.col("p")).sortWithinPartitions("p", "kind")
    back = _weighed(dealt, shared[0], kind)
    return _summed(back.repartition(n, "chunk").sortWithinPartitions("chunk", "kind"), kind)


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on both corpora, then score every document."""
    return score(docs, *fit(docs, labels))

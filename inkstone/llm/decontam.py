"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every substring of the normalised test items, in words. A document's words are
streamed through it; the longest match that ends at each word tells which words lie inside an
occurrence of a window (``window`` consecutive item words; a shorter item is one window).

Items are dealt to blocks of at most ``block_words`` words, give or take one item. A block is broadcast
and each Python worker builds its automaton, about a kilobyte a word, so what an executor holds is
that times its cores whatever the benchmark's size; documents are scanned once per block.

Null or empty texts have no words and no hits. Items without words are ignored; equal items share
windows and each counts. Rows keep their repeats: equal rows give equal results. Ids of documents and
items may be whole numbers or strings; items without id are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import as_bytes, durable, id_kind, map_arrow, plain_words, small_batches, unused

WINDOW = 8
BLOCK_WORDS = 500_000


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the windows of each state."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.next)
        #: The state of the last ``window`` words of a match that ends in a state, -1: the match is shorter.
        self.anchor = [-1] * n
        #: (length, items) of whole short items that end any match in the state, the state's own last.
        self.short: list[tuple[tuple[int, tuple[int, ...]], ...]] = [()] * n
        self.items: dict[int, tuple[int, ...]] = {}
        self._mark(items)

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = c
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def _mark(self, items: list[tuple[int, list[bytes]]]) -> None:
        k, link, length = self.window, self.link, self.length
        order = sorted(range(1, len(link)), key=length.__getitem__)
        for v in order:  # links come first
            if length[v] >= k:
                self.anchor[v] = v if length[link[v]] < k else self.anchor[link[v]]
        found: dict[int, set[int]] = {}
        shorts: dict[int, dict[int, set[int]]] = {}
        for item, words in items:
            v = 0
            for i, w in enumerate(words):
                v = self.next[v][w]
                if i + 1 >= k:
                    found.setdefault(self.anchor[v], set()).add(item)
            if 0 < len(words) < k:
                shorts.setdefault(v, {}).setdefault(len(words), set()).add(item)
        self.items = {v: tuple(sorted(x)) for v, x in found.items()}
        for v in order:
            own = tuple((n, tuple(sorted(x))) for n, x in sorted(shorts.get(v, {}).items()))
            self.short[v] = self.short[link[v]] + own

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans [first, end) of hit words, and the items with occurring windows."""
        nxt, link, length, anchor, short, k = self.next, self.link, self.length, self.anchor, self.short, self.window
        spans: list[tuple[int, int]] = []
        anchors: set[int] = set()
        hit_items: set[int] = set()
        root = nxt[0]
        v = n = 0
        for i, w in enumerate(words):
            t = nxt[v].get(w)
            if t is not None:
                v, n = t, n + 1
            elif v == 0:
                continue
            elif w not in root:
                v = n = 0
                continue
            else:
                v = link[v]
                while w not in nxt[v]:
                    v = link[v]
                n = length[v] + 1
                v = nxt[v][w]
            if n >= k:
                anchors.add(anchor[v])
                spans.append((i - n + 1, i + 1))
            elif short[v]:
                for size, ids in short[v]:
                    if size <= n:
                        hit_items.update(ids)
                        spans.append((i - size + 1, i + 1))
            if n >= k and short[v]:
                for _, ids in short[v]:
                    hit_items.update(ids)
        for a in anchors:
            hit_items.update(self.items[a])
        return merged(spans), hit_items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as disjoint, non-touching ones."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SCANNED = "doc_id {id}, row_key bigint, n_words bigint, spans array<struct<first:int,end:int>>, items array<{item}>, least int"
HIT = "hit_id {id}, hit_key bigint, spans array<struct<first:int,end:int>>, items array<{item}>, least int"

_BUILT: dict[str, tuple[SuffixAutomaton, dict[int, int]]] = {}


class Block:
    """A block of items that is broadcast; a worker builds its automaton once and holds one at a time."""

    def __init__(self, spark: SparkSession, items: list[tuple[int, list[bytes]]], window: int) -> None:
        self.shipped = spark.sparkContext.broadcast(items)
        self.window = window
        self.token = uuid.uuid4().hex

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int], int]:
        """Words of a text, its hit spans, their items, and the words of the shortest of these; 0 without hits."""
        if self.token not in _BUILT:
            _BUILT.clear()
            sizes: dict[int, int] = {}
            for item, words in self.shipped.value:
                sizes[item] = min(len(words), sizes.get(item, len(words)))
            _BUILT[self.token] = SuffixAutomaton(self.shipped.value, self.window), sizes
        automaton, sizes = _BUILT[self.token]
        words = plain_words(text)
        spans, hits = automaton.scan(words)
        return len(words), spans, hits, min((sizes[i] for i in hits), default=0)


def _blocks(spark: SparkSession, items: DataFrame, window: int, block_words: int) -> Iterator[Block]:
    """Items in blocks of about ``block_words`` words, each block on the driver alone; at least one block."""
    rows = items.select(F.col("item_id").cast(id_kind(items, "item_id")).alias("item_id"), "text").where("item_id is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // (4 * block_words)) or 1  # a word and its gap take four bytes or more, mostly
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        block = [(r.item_id, words) for r in part.collect() if (words := plain_words(r.text.encode()))]
        if block or i == 0:
            yield Block(spark, sorted(block), window)


def _scan(docs: DataFrame, block: Block, item_kind: str, id_col: str, text_col: str) -> DataFrame:
    """What one block's automaton finds in each row."""

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [block.scan(t) for t in as_bytes(batch.column(2))]
            columns = ([n for n, *_ in rows], [_structs(s) for _, s, *_ in rows], [sorted(h) for _, _, h, _ in rows], [x for *_, x in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, f.type) for x, f in zip(columns, list(schema)[2:]))], schema=schema)

    kind = id_kind(docs, id_col)
    rows = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, SCANNED.format(id=kind, item=item_kind))


def _structs(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"first": a, "end": b} for a, b in spans]


def _hits(scans: list[DataFrame], item_kind: str) -> DataFrame:
    """Of several blocks' scans, the hits of each row together; rows without hits are absent, equal rows are one."""
    hits = scans[0].where("least > 0")
    for s in scans[1:]:
        hits = hits.unionByName(s.where("least > 0"))
    grouped = hits.groupBy("doc_id", "row_key").agg(
        F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.min("least").alias("least")
    )

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_structs(merged([(s["first"], s["end"]) for s in row])) for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, schema.field(2).type), batch.column(3), batch.column(4)], schema=schema)

    return map_arrow(grouped, run, HIT.format(id=id_kind(scans[0]), item=item_kind))


def find(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: hit spans in words, items with occurring windows and the largest share of
    the shortest of these that one span has: ``doc_id, row_key, n_words, spans, items, coverage``."""
    item_kind = id_kind(items, "item_id")
    scans = [_scan(docs, block, item_kind, id_col, text_col) for block in _blocks(docs.sparkSession, items, window, block_words)]
    found = scans[0]
    if len(scans) > 1:
        scans[0] = durable(scans[0])  # read twice: for the rows, and for their hits
        same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row_key") == F.col("hit_key"))
        rows = scans[0].select("doc_id", "row_key", "n_words").join(_hits(scans, item_kind), same, "left")
        found = rows.selectExpr("doc_id", "row_key", "n_words", "coalesce(spans, array()) spans", "coalesce(items, array()) items", "coalesce(least, 0) least")
    longest = F.array_max(F.transform("spans", lambda s: s["end"] - s["first"]))
    return found.select("doc_id", "row_key", "n_words", "spans", "items", F.when(F.col("least") > 0, longest / F.col("least")).otherwise(F.lit(0.0)).alias("coverage"))


def report(found: DataFrame, min_items: int = 2) -> DataFrame:
    """The digest of ``find``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return found.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.first)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.expr("transform(items, x -> cast(x as string))")), ","), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
    )


_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def without_spans(text: bytes, spans: list[tuple[int, int]], least: int, *, max_words: int, max_coverage: float, max_share: float) -> bytes | None:
    """The text without the spans over a limit; None where they are over ``max_share`` of its words."""
    cut = [(a, b) for a, b in spans if b - a >= max_words or b - a >= max_coverage * least]
    if not cut:
        return text
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    if sum(b - a for a, b in cut) > max_share * len(places):
        return None
    out, at = [], 0
    for a, b in cut:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def _rewritten(columns: list[pa.Array], names: list[str], schema: pa.Schema, found: list[tuple[list[tuple[int, int]], int]], limits: dict[str, float]) -> pa.RecordBatch:
    """The rows that stay, with their new texts."""
    at = names.index("text")
    old = columns[at].cast(pa.binary()).to_pylist()
    new = [t if t is None or not spans else without_spans(t, spans, least, **limits) for t, (spans, least) in zip(old, found)]
    stays = [n is not None or o is None for n, o in zip(new, old)]
    if "n_chars" in names:
        i = names.index("n_chars")
        counts = columns[i].to_pylist()
        columns[i] = pa.array([c if n is None or n == o else len(n.decode()) for c, n, o in zip(counts, new, old)], columns[i].type)
    columns[at] = pa.array(new, pa.binary()).cast(pa.string()).cast(schema.field(at).type)
    return pa.RecordBatch.from_arrays(columns, schema=schema).filter(pa.array(stays, pa.bool_()))


def clean(
    docs: DataFrame, items: DataFrame, *, window: int = WINDOW, max_words: int = WINDOW, max_coverage: float = 0.5, max_share: float = 0.8, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Documents without benchmark spans.

    A span goes if it has ``max_words`` words or covers ``max_coverage`` of the shortest item that
    the text meets; a document goes if over ``max_share`` of its words would. ``n_chars`` follows the
    text where there is such a column. Other columns stay as they are; texts without hits stay byte for byte.
    Null texts stay null.

    One block of items: texts are scanned and cut as they pass. Several blocks: each scans the whole
    texts by itself, and the rows' hits are joined to the documents and cut at once.
    """
    spark, names, schema = docs.sparkSession, docs.columns, docs.schema
    limits = {"max_words": max_words, "max_coverage": max_coverage, "max_share": max_share}
    blocks = list(_blocks(spark, items, window, block_words))
    width = len(names)
    small_batches(spark)
    if len(blocks) == 1:
        block, at = blocks[0], names.index("text")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(spans, least) for _, spans, _, least in map(block.scan, as_bytes(batch.column(at)))]
                yield _rewritten(list(batch.columns), names, batch.schema, found, limits)

        return docs.mapInArrow(scan, schema)

    item_kind = id_kind(items, "item_id")
    marks = unused(docs, *[f"_hit{i}" for i in range(5)])
    hits = _hits([_scan(docs, b, item_kind, "doc_id", "text") for b in blocks], item_kind).toDF(*marks)
    same = F.col("doc_id").cast(id_kind(docs)).eqNullSafe(F.col(marks[0])) & (F.xxhash64("doc_id", "text") == F.col(marks[1]))
    joined = docs.join(hits, same, "left").select(*names, marks[2], marks[4])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, least = (batch.column(i).to_pylist() for i in (width, width + 1))
            found = [([(x["first"], x["end"]) for x in s or ()], n or 0) for s, n in zip(spans, least)]
            kept = pa.schema([batch.schema.field(i) for i in range(width)])
            yield _rewritten(list(batch.columns[:width]), names, kept, found, limits)

    return joined.mapInArrow(cut, schema)

"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression. Each code point has a class; each class is a
transition function on the states of a small machine; an associative scan composes the functions
of neighbouring code points until every composition is constant, which this machine reaches after
a few symbols, so the scan takes two or three passes over an array whatever the text's length.
The states give the boundaries. The slices go to pair merging behind a bounded cache. The pattern
is the public one::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Texts longer than ``BLOCK`` code points are scanned block by block; a block ends at a token start,
where the pattern looks at nothing to the left, so the result is that of one scan.

Null and empty texts have no tokens. Ids may be whole numbers or strings. Rows keep their order and repeats; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from inkstone.llm.common import as_text, id_kind, ids_and, map_arrow

BLOCK = 1 << 19
CACHED_PIECES = 300_000
CACHED_LENGTH = 64
MERGED_BYTES = 1 << 22  # merge_many keeps places in 24 bits
_NEVER = 1 << 30  # above every rank

# Symbols: what the machine tells apart.
_LETTER, _NUMBER, _OTHER, _QUOTE, _SPACE, _WHITE, _EDGE, _STMD, _R, _V, _L, _E = range(12)
_SYMBOLS = 12
# States: what the last symbols leave.
_EDGES, _WORD, _NUM, _OTH, _SPC, _WHT, _APOS, _AR, _AV, _AL, _DONE = range(11)
_STATES = 11
#: Code points of the Unicode property White_Space.
_WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]


def _step(state: int, symbol: int) -> int:
    if symbol == _EDGE:
        return _EDGES
    if symbol == _SPACE:
        return _SPC
    if symbol == _WHITE:
        return _WHT
    if symbol == _NUMBER:
        return _NUM
    if symbol == _OTHER:
        return _OTH
    if symbol == _QUOTE:  # opens a contraction only where a token starts with it
        return _OTH if state in (_SPC, _OTH, _APOS) else _APOS
    if state == _APOS:
        return {_STMD: _DONE, _R: _AR, _V: _AV, _L: _AL}.get(symbol, _WORD)
    if (state in (_AR, _AV) and symbol == _E) or (state == _AL and symbol == _L):
        return _DONE
    return _WORD


@cache
def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each symbol, products of functions, constant value of each (255: none), symbol of each code point."""
    symbols = [tuple(_step(s, x) for s in range(_STATES)) for x in range(_SYMBOLS)]
    ids: dict[tuple[int, ...], int] = {}
    for f in symbols:
        ids.setdefault(f, len(ids))
    known = list(ids)
    for f in known:  # grows while it is read: the closure under composition
        for g in symbols:
            h = tuple(g[x] for x in f)
            if h not in ids:
                ids[h] = len(ids)
                known.append(h)
    product = np.array([[ids[tuple(g[x] for x in f)] for g in known] for f in known], dtype=np.uint16)
    constant = np.array([f[0] if len(set(f)) == 1 else 255 for f in known], dtype=np.uint8)
    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    category = np.frombuffer("".join(map(unicodedata.category, map(chr, range(0x110000)))).encode(), dtype=np.uint8)[::2]
    for kind, name in ((_LETTER, "L"), (_NUMBER, "N")):
        table[category == ord(name)] = kind
    table[_WHITE_SPACE] = _WHITE
    for text, kind in ((" ", _SPACE), ("'", _QUOTE), ("stmd", _STMD), ("r", _R), ("v", _V), ("l", _L), ("e", _E)):
        table[[ord(c) for c in text]] = kind
    return np.array([ids[f] for f in symbols], dtype=np.uint16), product, constant, table


def _starts(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Whether a token starts at each code point; ``edges``: positions of separators between texts, the last one at the end."""
    of_symbol, product, constant, table = _machine()
    symbol = table[codes]
    symbol[edges] = _EDGE
    f = of_symbol[symbol]
    f[0] = of_symbol[_EDGE] if symbol[0] == _EDGE else product[of_symbol[_EDGE], f[0]]
    flat, width, step = product.ravel(), np.uint32(product.shape[1]), 1
    while (loose := np.flatnonzero(constant[f] == 255)).size:
        # composing with the function of the stretch before doubles what each function covers
        loose = loose[loose >= step]
        f[loose] = flat[f[loose - step] * width + f[loose]]
        step *= 2
    state = constant[f]
    before = np.empty_like(state)
    before[0], before[1:] = _EDGES, state[:-1]
    after, after_symbol = np.full_like(state, _EDGES), np.full_like(symbol, _EDGE)
    after[:-1], after_symbol[:-1] = state[1:], symbol[1:]
    white = (state == _SPC) | (state == _WHT)
    was_white = (before == _SPC) | (before == _WHT)
    was_word = (before == _WORD) | (before == _AR) | (before == _AV) | (before == _AL)
    start = np.where(white, ~was_white | ((after_symbol != _SPACE) & (after_symbol != _WHITE) & (after_symbol != _EDGE)), before != _SPC)
    start &= ~((state == _WORD) & was_word)
    start &= ~((state == _NUM) & (before == _NUM))
    start &= ~(((state == _OTH) | (state == _APOS)) & ((before == _OTH) | (before == _APOS)))
    pending = (state == _AR) | (state == _AV) | (state == _AL)
    start &= ~(pending & (after == _DONE)) & (state != _DONE)
    return start


def _split_long(text: str) -> list[str]:
    at, pieces = 0, []
    while at < len(text):
        block = text[at : at + BLOCK]
        codes = np.frombuffer((block + "\n").encode("utf-32-le"), dtype=np.uint32)
        cuts = np.flatnonzero(_starts(codes, np.array([len(block)]))[:-1])
        if at + len(block) < len(text):
            sure = cuts[cuts <= len(block) - 8]
            if sure.size < 2:  # one token fills the block: look at more at once
                return pieces + _split_batch([text[at:]])[0]
            cuts = sure
            end = int(cuts[-1])
            ends = cuts[1:].tolist()
            pieces += [block[a:b] for a, b in zip(cuts[:-1].tolist(), ends)]
            at += end
        else:
            ends = [*cuts[1:].tolist(), len(block)]
            pieces += [block[a:b] for a, b in zip(cuts.tolist(), ends)]
            at = len(text)
    return pieces


def _split_batch(texts: list[str]) -> list[list[str]]:
    sizes = np.array([len(t) for t in texts])
    edges = np.cumsum(sizes + 1) - 1
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), dtype=np.uint32)
    cuts = np.flatnonzero(_starts(codes, edges))
    first = edges - sizes
    low, high = np.searchsorted(cuts, first), np.searchsorted(cuts, edges)
    out = []
    for text, base, a, b in zip(texts, first.tolist(), low.tolist(), high.tolist()):
        p = (cuts[a:b] - base).tolist()
        out.append([text[x:y] for x, y in zip(p, [*p[1:], len(text)])] if p else [])
    return out


def split_groups(texts: list[str]) -> Iterator[list[list[str]]]:
    """The pre-tokens of each text, in groups of texts of about ``BLOCK`` code points."""
    part: list[str] = []
    size = 0
    for text in texts:
        if len(text) > BLOCK:
            if part:
                yield _split_batch(part)
            part, size = [], 0
            yield [_split_long(text)]
            continue
        part.append(text)
        size += len(text) + 1
        if size >= BLOCK:
            yield _split_batch(part)
            part, size = [], 0
    if part:
        yield _split_batch(part)


def split(texts: list[str]) -> Iterator[list[str]]:
    """The pre-tokens of each text."""
    return chain.from_iterable(split_groups(texts))


class Codec:
    """Ranks, their bytes and a bounded cache of merged pieces."""

    def __init__(self, rank_file: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.lengths = np.array([len(b) for b in self.bytes_of] or [0], dtype=np.int64)
        self.names = [str(i).encode() for i in range(len(self.bytes_of))]
        self.cache: dict[str, tuple[int, ...]] = {}
        whole = range(len(self.bytes_of))
        get = self.ranks.get
        pairs, joined = [1 << 62], [_NEVER]
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None:
                    pairs.append(a << 32 | b)
                    joined.append(rank)
        order = np.argsort(pairs)
        #: Pairs of ids that join, sorted, and what they join to; the last pair is larger than any.
        self.pairs = np.array(pairs, dtype=np.int64)[order]
        self.joined = np.array(joined, dtype=np.int64)[order]
        self.of_byte = np.array([self.ranks.get(bytes([b]), 0) for b in range(256)], dtype=np.int64)
        self.ints = list(whole)  # one object for each id that the cache holds

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the pair of lowest rank, the leftmost first, until no pair has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        n = len(piece)
        if n < 48:
            parts = [piece[i : i + 1] for i in range(n)]
            pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            while pairs:
                best = min(pairs)
                if best == 1 << 60:
                    break
                i = pairs.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
                if i < len(pairs):
                    pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            return tuple([ranks[p] for p in parts])
        # Long pieces: linked parts and a heap of (rank, place, end of the left part, end of the right part).
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != mid or mid >= n or end[mid] != stop:
                continue
            alive[mid] = 0
            end[i] = stop
            if stop < n:
                left[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (j := left[i]) >= 0 and (r := ranks.get(piece[j:stop])) is not None:
                heapq.heappush(heap, (r, j, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.joined[at], _NEVER)

    def merge_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """What ``merge`` gives for each piece, one merge in every piece at a time."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), sizes)
        out: list[tuple[int, ...]] = [()] * len(pieces)
        rank = np.full(len(ids), _NEVER)
        inner = np.flatnonzero(piece[:-1] == piece[1:])
        rank[inner] = self._join(ids[inner], ids[inner + 1])
        while len(ids):
            first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            best = np.minimum.reduceat(rank << 24 | np.arange(len(ids)), first)
            at = (best & 0xFFFFFF)[over := (best >> 24) < _NEVER]
            if not over.all():  # these pieces are done
                ends = [*first[1:].tolist(), len(ids)]
                flat = list(map(self.ints.__getitem__, ids.tolist()))
                for k in np.flatnonzero(~over).tolist():
                    out[int(piece[first[k]])] = tuple(flat[first[k] : ends[k]])
            ids[at] = rank[at]
            keep = np.repeat(over, np.diff(np.r_[first, len(ids)]))
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            at = place[at]
            ids, piece, rank = ids[keep], piece[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                same = np.zeros(len(i), dtype=bool)
                inside = i + 1 < len(ids)
                same[inside] = piece[i[inside]] == piece[i[inside] + 1]
                rank[i[~same]] = _NEVER
                i = i[same]
                rank[i] = self._join(ids[i], ids[i + 1])
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Put pieces that the cache lacks into it."""
        new = list(dict.fromkeys(p for p in pieces if p not in self.cache and len(p) <= CACHED_LENGTH))
        if len(self.cache) + len(new) > CACHED_PIECES:
            self.cache.clear()
        data = [p.encode() for p in new]
        for p, b in zip(new, data):
            if (r := self.ranks.get(b)) is not None:
                self.cache[p] = (self.ints[r],)
        rest = [(p, b) for p, b in zip(new, data) if p not in self.cache]
        low = size = 0
        for k, (_, b) in enumerate(rest):
            if size and size + len(b) > MERGED_BYTES:
                self._cache_merged(rest[low:k])
                low, size = k, 0
            size += len(b)
        if rest:
            self._cache_merged(rest[low:])

    def _cache_merged(self, rest: list[tuple[str, bytes]]) -> None:
        self.cache.update(zip([p for p, _ in rest], self.merge_many([b for _, b in rest])))

    def of_pieces(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The ids of each piece."""
        get = self.cache.get
        found = [get(p) for p in pieces]
        if None in found:
            found = [f or get(p) or self.merge(p.encode()) for f, p in zip(found, pieces)]
        return found

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        for group in split_groups(texts):
            self.learn(chain.from_iterable(group))
            for pieces in group:
                yield list(chain.from_iterable(self.of_pieces(pieces)))

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def byte_offsets(self, ids: list[int]) -> np.ndarray:
        """Where each token starts in the text's bytes, and after them the text's length."""
        out = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(self.lengths[np.array(ids, dtype=np.int64)], out=out[1:])
        return out

    def decode_by_offsets(self, ids: list[int], offsets: np.ndarray, size: int = 1 << 20) -> Iterator[bytes]:
        """The bytes of ids in pieces of about ``size``, cut where the offsets say that tokens start.

        Raises ValueError where a piece has not the length that its offsets say.
        """
        total = int(offsets[-1])
        cuts = [0, len(ids)] if len(ids) else []
        if total > size:
            cuts = np.unique(np.append(np.searchsorted(offsets, np.arange(0, total, size)), len(ids))).tolist()
        for a, b in zip(cuts, cuts[1:]):
            piece = self.decode(ids[a:b] if b - a < len(ids) else ids)
            if len(piece) != offsets[b] - offsets[a]:
                raise ValueError("offsets do not fit the ids")
            yield piece


_codecs: dict[int, Codec] = {}


def codec(ranks: Broadcast[bytes] | bytes) -> Codec:
    """The codec of a broadcast rank file, built once in each Python worker."""
    data = ranks if isinstance(ranks, bytes) else ranks.value
    key = hash(data)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data)
    return _codecs[key]


def ship_ranks(spark: SparkSession, path: str) -> Broadcast[bytes]:
    """Send the rank file of a vocabulary to the executors: under a megabyte, whatever the corpus."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


ENCODED = "doc_id {id}, n_tokens bigint, ids array<int>, offsets array<int>"
DIGESTS = "doc_id {id}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and byte offsets of every whole text: ``doc_id, n_tokens, ids, offsets``.

    ``offsets`` has where each token starts in the UTF-8 bytes. Null text: no tokens.
    """
    ranks = ship_ranks(docs.sparkSession, rank_path)

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        c = codec(ranks)
        for batch in batches:
            ids = list(c.encode_batch(as_text(batch.column(1))))
            offsets = [c.byte_offsets(x)[:-1].astype(np.int32) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int32()))], schema=schema
            )

    return map_arrow(ids_and(docs, id_col, text_col), run, ENCODED.format(id=id_kind(docs, id_col)))


def decode(encoded: DataFrame, rank_path: str) -> DataFrame:
    """Bytes of ``doc_id, ids, offsets`` as ``encode`` gives them: ``doc_id, decoded binary``; null ids: no bytes.

    Raises ValueError where the offsets do not fit the ids.
    """
    ranks = ship_ranks(encoded.sparkSession, rank_path)

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        c = codec(ranks)
        for batch in batches:
            out = []
            for ids, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ends = c.byte_offsets(ids or [])
                if (ends[:-1] != np.array(starts or [], dtype=np.int64)).any():
                    raise ValueError("offsets do not fit the ids")
                out.append(b"".join(c.decode_by_offsets(ids or [], ends)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], schema=schema)

    return map_arrow(encoded.select("doc_id", "ids", "offsets"), run, f"doc_id {id_kind(encoded)}, decoded binary")


def digests(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids by their offsets, and return the digests of both, after the ids if asked.

    Decoded bytes live for one piece of a text at a time, so no batch of them is held.
    """
    ranks = ship_ranks(docs.sparkSession, rank_path)

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        c = codec(ranks)
        for batch in batches:
            counts, id_digests, text_digests, kept = [], [], [], []
            for ids in c.encode_batch(as_text(batch.column(1))):
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(b" ".join(map(c.names.__getitem__, ids))).hexdigest())
                digest = hashlib.sha256()
                for piece in c.decode_by_offsets(ids, c.byte_offsets(ids)):
                    digest.update(piece)
                text_digests.append(digest.hexdigest())
                if with_ids:
                    kept.append(np.array(ids, dtype=np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return map_arrow(ids_and(docs, id_col, text_col), run, DIGESTS.format(id=id_kind(docs, id_col)) + ", ids array<int>" * with_ids)

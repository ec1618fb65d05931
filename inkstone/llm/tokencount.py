"""Token counts of fields and sections by offset-mapped attribution.

A document's fields are joined by ``\\n`` and encoded once. Each token's span comes from the offsets
that the encoder keeps; sections tile the document (here: each line with its line end, field after
field), and an interval join of the two sorted lists, inside the row, gives each token its section.
A token that crosses a boundary is allocated by a stated rule:

- ``start``: to the section of its first character (a character that tokens split counts for each);
- ``end``: to the section of its last;
- ``most``: to the section that has most of its bytes, the earlier of equals.

Null fields are empty; a document without characters has one empty section and no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm import bpe
from inkstone.llm.common import as_text, id_kind, map_arrow

RULES = ("start", "end", "most")
COUNTS = "doc_id {id}, n_chars bigint, n_tokens bigint, n_sections bigint, n_crossing bigint, section_starts array<int>, section_tokens array<int>, field_tokens array<int>"


def attribute(token_starts: np.ndarray, size: int, section_starts: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a boundary.

    Starts are sorted byte offsets; tokens and sections tile [0, size).
    """
    if not len(token_starts):
        return np.zeros(len(section_starts), dtype=np.int64), 0
    ends = np.append(token_starts[1:], size)
    first = np.searchsorted(section_starts, token_starts, "right") - 1
    last = np.searchsorted(section_starts, ends, "left") - 1
    crossing = np.flatnonzero(first != last)
    chosen = last if rule == "end" else first
    if rule == "most" and len(crossing):
        chosen = first.copy()
        stops = np.append(section_starts[1:], size)
        for t in crossing.tolist():
            inside = np.arange(first[t], last[t] + 1)
            share = np.minimum(stops[inside], ends[t]) - np.maximum(section_starts[inside], token_starts[t])
            chosen[t] = inside[int(np.argmax(share))]
    return np.bincount(chosen, minlength=len(section_starts)), len(crossing)


def count(docs: DataFrame, rank_path: str, *, fields: tuple[str, ...] = ("text",), rule: str = "start", id_col: str = "doc_id") -> DataFrame:
    """Tokens of each section and of each field of every document, encoded whole and once.

    ``section_starts`` has character offsets in the joined fields; ``field_tokens`` follows ``fields``.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ranks = bpe.ship_ranks(docs.sparkSession, rank_path)

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        c = bpe.codec(ranks)
        for batch in batches:
            parts = list(zip(*(as_text(column) for column in batch.columns[1:])))
            texts = ["\n".join(p) for p in parts]
            out: list[tuple] = []
            for values, text, ids in zip(parts, texts, c.encode_batch(texts)):
                data = text.encode()
                raw = np.frombuffer(data, dtype=np.uint8)
                starts = np.append(0, np.flatnonzero(raw == 10) + 1)
                if len(starts) > 1 and starts[-1] == len(data):
                    starts = starts[:-1]  # the last line end belongs to the line before it
                offsets = c.byte_offsets(ids)
                tokens, crossing = attribute(offsets[:-1], len(data), starts, rule)
                points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
                field_ends = np.cumsum([len(v.encode()) + 1 for v in values])
                field_of = np.minimum(np.searchsorted(field_ends, starts, "right"), len(values) - 1)
                by_field = np.bincount(field_of, weights=tokens, minlength=len(values)).astype(np.int32)
                out.append((len(text), len(ids), len(starts), crossing, points[starts].astype(np.int32), tokens.astype(np.int32), by_field))
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip(columns, list(schema)[1:]))], schema=schema)

    rows = docs.select(F.col(id_col).cast(id_kind(docs, id_col)).alias("doc_id"), *[F.col(f).cast("string").alias(f"field_{i}") for i, f in enumerate(fields)])
    return map_arrow(rows, run, COUNTS.format(id=id_kind(docs, id_col)))

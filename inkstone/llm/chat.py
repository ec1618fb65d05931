"""Chat formatting by token-level assembly.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Role and text are escaped and encoded as segments of
their own, and the reserved ids of the two marks are spliced between them, so no text can produce a
mark. The loss mask covers an assistant's text; it is the prefix sum of +1 and -1 at segment bounds.

Control strings inside roles and texts are escaped: a backslash goes after the first character, also
where backslashes stand there already, so unescaping takes one backslash away and gives back any text.

A conversation is its turns in order (turn, role, text; null turns first), each turn a chunk of the
output; no conversation is ever gathered. Null roles and texts are empty. Ids may be whole numbers or
strings; turns without one are one conversation. Which strings are escaped is a parameter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm import bpe
from inkstone.llm.common import as_text, id_kind, map_arrow

# The marks of the template, and other strings that chat templates give a meaning.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = (
    START,
    END,
    "<|endoftext|>",
    "<|endofprompt|>",
    "<|begin_of_text|>",
    "<|end_of_text|>",
    "<|start_header_id|>",
    "<|end_header_id|>",
    "<|eot_id|>",
    "<|fim_prefix|>",
    "<|fim_middle|>",
    "<|fim_suffix|>",
    "<|system|>",
    "<|user|>",
    "<|assistant|>",
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
)


@cache
def _patterns(control: tuple[str, ...]) -> tuple[re.Pattern, re.Pattern]:
    """What is escaped, and what an escape looks like. The template's own marks are always control strings."""
    marks = dict.fromkeys([START, END, *control])
    if short := [c for c in marks if len(c) < 2]:
        raise ValueError(f"control strings need two characters or more: {short}")
    rest: dict[str, list[str]] = {}
    for c in marks:
        rest.setdefault(c[0], []).append(re.escape(c[1:]))
    # one branch for each first character, so that a text is searched for these alone
    found = [re.compile("|".join(f"{re.escape(a)}\\\\{times}(?:{'|'.join(b)})" for a, b in rest.items())) for times in "*+"]
    return found[0], found[1]


@cache
def _firsts(control: tuple[str, ...]) -> tuple[str, ...]:
    _patterns(control)  # which refuses what can't be escaped
    return tuple({c[0] for c in (START, END, *control)})


def escape(text: str, control: tuple[str, ...] = CONTROL) -> str:
    """The text without control strings."""
    if not any(c in text for c in _firsts(control)):
        return text
    return _patterns(control)[0].sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str, control: tuple[str, ...] = CONTROL) -> str:
    """What ``escape`` was given."""
    if "\\" not in text:
        return text
    return _patterns(control)[1].sub(lambda m: m[0][0] + m[0][2:], text)


def escape_role(role: str, control: tuple[str, ...] = CONTROL) -> str:
    """A role on one line, without control strings."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"), control)


def unescape_role(role: str, control: tuple[str, ...] = CONTROL) -> str:
    """What ``escape_role`` was given."""
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role, control))


CHUNKS = "conv_id {id}, turn bigint, ids array<int>, loss array<boolean>"


def assemble(c: bpe.Codec, roles: list[str], texts: list[str], control: tuple[str, ...] = CONTROL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and loss mask of all turns, one after the other, and where each turn starts, with the end after them."""
    start, end = [len(c.bytes_of)], [len(c.bytes_of) + 1]
    # each distinct role is a segment that is encoded once
    heads = list(dict.fromkeys(roles))
    role_ids = dict(zip(heads, c.encode_batch([escape_role(r, control) + "\n" for r in heads])))
    segments = c.encode_batch([escape(t, control) for t in texts])
    line_end = next(c.encode_batch(["\n"]))
    parts = [p for role in roles for p in (start, role_ids[role], next(segments), end, line_end)]
    bounds = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)), out=bounds[1:])
    ids = np.fromiter(chain.from_iterable(parts), np.int32, bounds[-1])
    steps = np.zeros(len(ids) + 1, dtype=np.int32)
    spoken = 5 * np.flatnonzero(np.fromiter((r == "assistant" for r in roles), bool, len(roles)))
    # an empty text starts and ends at one place, where its steps cancel out
    np.add.at(steps, bounds[spoken + 2], 1)
    np.add.at(steps, bounds[spoken + 3], -1)
    return ids, np.cumsum(steps[:-1]) > 0, bounds[::5]


def _rows(turns: DataFrame) -> DataFrame:
    return turns.select(F.col("conv_id").cast(id_kind(turns, "conv_id")).alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")


def encode(turns: DataFrame, rank_path: str, control: tuple[str, ...] = CONTROL) -> DataFrame:
    """The formatted turns as ``conv_id, turn, ids, loss``, in no order."""
    ranks = bpe.ship_ranks(turns.sparkSession, rank_path)

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        c = bpe.codec(ranks)
        for batch in batches:
            ids, loss, bounds = assemble(c, as_text(batch.column(2)), as_text(batch.column(3)), control)
            lists = [pa.array(np.split(x, bounds[1:-1]) if len(bounds) > 1 else [], f.type) for x, f in zip((ids, loss), list(schema)[2:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], schema=schema)

    return map_arrow(_rows(turns), run, CHUNKS.format(id=id_kind(turns, "conv_id")))


def read_back(c: bpe.Codec, ids: np.ndarray, loss: np.ndarray, bounds: np.ndarray, control: tuple[str, ...] = CONTROL) -> Iterator[tuple[str, str, str, int]]:
    """Role, text and text under the loss mask of each turn, and the code points of its formatted form.

    All ids are decoded at once, the marks to nothing; prefix sums of token lengths cut the bytes.
    """
    start, end = len(c.bytes_of), len(c.bytes_of) + 1
    ends = np.flatnonzero(ids == end)
    low, high = bounds[:-1], bounds[1:]
    marked = np.flatnonzero(ids == start)
    if len(ends) != len(low) or len(marked) != len(low) or (marked != low).any() or (ends < low).any() or (ends >= high).any():
        raise ValueError("not formatted turns")
    lengths = np.append(c.lengths, [0, 0])
    at = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum(lengths[ids], out=at[1:])
    blob = b"".join(map([*c.bytes_of, b"", b""].__getitem__, ids.tolist()))
    # runs under the mask, none of which crosses from a turn to the next
    edges = np.flatnonzero(np.diff(loss.astype(np.int8), prepend=0, append=0))
    runs: dict[int, list[tuple[int, int]]] = {}
    turn = np.searchsorted(bounds, edges[::2], side="right") - 1
    for k, x, y in zip(turn.tolist(), at[edges[::2]].tolist(), at[edges[1::2]].tolist()):
        runs.setdefault(k, []).append((x, y))
    for k, (x, y, z) in enumerate(zip(at[low].tolist(), at[ends].tolist(), at[high].tolist())):
        body, tail = blob[x:y].decode(), blob[y:z].decode()
        masked = unescape(b"".join([blob[p:q] for p, q in runs[k]]).decode(), control) if k in runs else ""
        role, _, text = body.partition("\n")
        yield unescape_role(role, control), unescape(text, control), masked, len(START) + len(body) + len(END) + len(tail)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column as one array, and where each list starts."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]], bounds - bounds[0]


TURNS = "conv_id {id}, turn bigint, role string, text string, masked string, chars bigint"
DIGESTS = "conv_id {id}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _turns(batch: pa.RecordBatch, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, f.type) for x, f in zip(columns, list(schema)[2:]))], schema=schema)


def decode(chunks: DataFrame, rank_path: str, control: tuple[str, ...] = CONTROL) -> DataFrame:
    """Roles and texts read back from formatted turns."""
    ranks = bpe.ship_ranks(chunks.sparkSession, rank_path)

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        c = bpe.codec(ranks)
        for batch in batches:
            (ids, bounds), (loss, _) = _flat(batch.column(2)), _flat(batch.column(3))
            yield _turns(batch, list(read_back(c, ids, loss, bounds, control)), schema)

    return map_arrow(chunks.select("conv_id", "turn", "ids", "loss"), run, TURNS.format(id=id_kind(chunks, "conv_id")))


def formatted(turns: DataFrame, rank_path: str, control: tuple[str, ...] = CONTROL) -> DataFrame:
    """What ``decode`` reads back from what ``encode`` makes, in one pass: ids do not leave the worker."""
    ranks = bpe.ship_ranks(turns.sparkSession, rank_path)

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        c = bpe.codec(ranks)
        for batch in batches:
            ids, loss, bounds = assemble(c, as_text(batch.column(2)), as_text(batch.column(3)), control)
            yield _turns(batch, list(read_back(c, ids, loss, bounds, control)), schema)

    return map_arrow(_rows(turns), run, TURNS.format(id=id_kind(turns, "conv_id")))


def digests(turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``decode``'s turns.

    Turns come sorted from Spark, which spills, and are hashed as they pass: a worker holds one hash state.
    """

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now: tuple | None = None

        def close() -> None:
            if now is not None:
                done.append((now[0], now[1][0], now[2].hexdigest(), now[1][1], now[3].hexdigest(), now[1][2]))

        for batch in batches:
            for conv, role, text, masked, chars in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if now is None or now[0] != conv:
                    close()
                    now = (conv, [0, 0, 0], hashlib.sha256(), hashlib.sha256())
                now[1][0] += 1
                now[1][1] += len(masked)
                now[1][2] += chars
                now[2].update(f"{role}\n{text}\n".encode())
                now[3].update(masked.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)

    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_arrow(dealt, run, DIGESTS.format(id=id_kind(turns, "conv_id")))


def format_report(turns: DataFrame, rank_path: str, control: tuple[str, ...] = CONTROL) -> DataFrame:
    """Format every conversation, read the output back and digest it."""
    return digests(formatted(turns, rank_path, control))


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns plus conversation -7, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = turns.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").unionByName(probe)

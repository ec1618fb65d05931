"""Quality rules: a decision list learned from labelled statistics.

Each whole text gives a few counts. Sequential covering learns rules for the texts to reject: a rule
is a conjunction of thresholds on ratios of these counts, grown by information gain on two thirds of
the labelled rows and pruned on the rest; the rows that it covers leave and the next rule is sought.
The list is emitted as one ordered Spark conditional expression.

The rules are fitted on at most ``FIT_ROWS`` labelled documents, those with the least hash of their
id; statistics and verdicts cover every document. Null texts count as empty. Ratios of texts
without words are 0. Labels that are null, or that repeat with another value, do not teach. Ids may be whole
numbers of any size or strings; rows without id are judged like all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from inkstone.llm.common import as_bytes, id_kind, ids_and, map_arrow, small_batches

FIT_ROWS = 20_000
SYMBOLS = b"#*$%&|<>"
STATS = "doc_id {id}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_upper bigint, n_digits bigint, n_marks bigint, n_lines bigint, n_chars bigint"
_UPPER, _DIGITS, _MARKS, _SPACES = bytes(range(65, 91)), b"0123456789", b"!?", b" \t\n\x0b\x0c\r"
_TAILS = bytes(range(0x80, 0xC0))  # UTF-8 bytes that start no code point


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside ``size``-word windows that the text has twice or more, the first included."""
    n = len(words)
    if n <= size:
        return 0
    first: dict[bytes, int] = {}
    put = first.setdefault
    ids = np.fromiter([put(w, i) for i, w in enumerate(words)], np.int64, n)
    code = ids[: n - size + 1]
    for k in range(1, size):
        nxt = ids[k : n - size + 1 + k]
        if k > 1 and n >= 1 << 20:  # keep the products within 64 bits
            code = np.unique(code, return_inverse=True)[1]
        code = code * n + nxt
    ordered = np.sort(code)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, code), len(twice) - 1)] == code)
    inside = np.zeros(n, dtype=bool)
    for k in range(size):
        inside[at + k] = True
    return int(inside.sum())


def text_stats(text: bytes) -> tuple[int, ...]:
    """The counts of one UTF-8 text, in the order of ``STATS``."""
    words = text.split()
    points = len(text.translate(None, _TAILS))
    count = lambda some: len(text) - len(text.translate(None, some))
    seen: set[bytes] = set()
    lines = dups = 0
    for line in text.split(b"\n"):
        lines += 1
        if line in seen:
            dups += 1
        elif line.strip():
            seen.add(line)
    return (len(words), points - count(_SPACES), count(SYMBOLS), dups, repeated_words(words), count(_UPPER), count(_DIGITS), count(_MARKS), lines, points)


def stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str | None = None) -> DataFrame:
    """The counts of every whole text, one row for each row, and a whole-number label if named."""

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_stats(t) for t in as_bytes(batch.column(1))]
            columns = zip(*rows) if rows else [[]] * 10
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), *batch.columns[2:]], schema=schema)

    rows = ids_and(docs, id_col, text_col) if label_col is None else docs.select(F.col(id_col).cast(id_kind(docs, id_col)).alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
    return map_arrow(rows, run, STATS.format(id=id_kind(docs, id_col)) + ", label int" * (label_col is not None))


#: Ratios that the rules may bound: name, numerator, denominator.
RATIOS = [
    ("mean_word", "word_chars", "n_words"),
    ("symbol_ratio", "n_symbols", "n_words"),
    ("dup_line_ratio", "n_dup_lines", "n_lines"),
    ("repeat_ratio", "n_repeat_words", "n_words"),
    ("upper_ratio", "n_upper", "word_chars"),
    ("digit_ratio", "n_digits", "word_chars"),
    ("mark_ratio", "n_marks", "n_words"),
    ("words_per_line", "n_words", "n_lines"),
]


def ratio(name: str) -> Column:
    """A ratio as a Spark expression; 0 where the denominator is."""
    _, a, b = next(r for r in RATIOS if r[0] == name)
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (ratio, ">=" or "<=", threshold)."""

    terms: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, bound in self.terms:
            out = out & (ratio(name) >= bound if op == ">=" else ratio(name) <= bound)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {o} {b:.6g}" for n, o, b in self.terms)


def _covers(terms: tuple, x: np.ndarray) -> np.ndarray:
    names = [r[0] for r in RATIOS]
    out = np.ones(len(x), dtype=bool)
    for name, op, bound in terms:
        v = x[:, names.index(name)]
        out &= v >= bound if op == ">=" else v <= bound
    return out


def _grow(x: np.ndarray, bad: np.ndarray, most_terms: int, thresholds: int) -> tuple:
    """Add the threshold of the largest information gain until the rule covers bad rows only."""
    terms: tuple = ()
    inside = np.ones(len(x), dtype=bool)
    for _ in range(most_terms):
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if n == 0 or p == 0:
            break
        best = (1e-9, None, None)
        for k, (name, _, _) in enumerate(RATIOS):
            v = x[inside, k]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, thresholds), method="nearest"))
            if len(cuts) < 2:
                continue
            mids = (cuts[1:] + cuts[:-1]) / 2
            b, g = np.sort(v[bad[inside]]), np.sort(v[~bad[inside]])
            pb, nb = np.searchsorted(b, mids), np.searchsorted(g, mids)  # below each cut
            for op, pp, nn in (("<=", pb, nb), (">=", p - pb, n - nb)):
                gain = pp * (np.log2(np.maximum(pp, 1e-12) / np.maximum(pp + nn, 1e-12)) - np.log2(p / (p + n)))
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), (name, op, float(mids[i])), k)
        if best[1] is None:
            break
        terms = tuple(t for t in terms if t[:2] != best[1][:2]) + (best[1],)  # a tighter bound replaces the looser one
        inside &= _covers((best[1],), x)
    return terms


def _prune(terms: tuple, x: np.ndarray, bad: np.ndarray) -> tuple:
    """Of the rule's prefixes the shortest with the best (bad - good) / covered on held-back rows."""

    def worth(t: tuple) -> float:
        c = _covers(t, x)
        p, n = int((c & bad).sum()), int((c & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((terms[:i] for i in range(1, len(terms) + 1)), key=lambda t: (worth(t), -len(t)), default=())


def learn(x: np.ndarray, bad: np.ndarray, *, most_rules: int = 12, most_terms: int = 5, thresholds: int = 65, least_precision: float = 0.9, least_cover: int = 3) -> list[Rule]:
    """Ordered rules that reject; rows of ``x`` are labelled documents, columns the ratios."""
    rules: list[Rule] = []
    hold = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), dtype=bool)
    while len(rules) < most_rules and (bad & left).any():
        grow, back = left & ~hold, left & hold
        terms = _grow(x[grow], bad[grow], most_terms, thresholds)
        if not terms:
            break
        if back.any():
            terms = _prune(terms, x[back], bad[back])
        c = _covers(terms, x) & left
        p, n = int((c & bad).sum()), int((c & ~bad).sum())
        if p < least_cover or p < least_precision * (p + n):
            break
        rules.append(Rule(terms))
        left &= ~c
    return rules


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, label_col: str = "quality", **how: float) -> list[Rule]:
    """Rules from at most ``fit_rows`` labelled documents; label 0 is what to reject."""
    texts = ids_and(docs)
    known = (
        labels.select(F.col("doc_id").cast(id_kind(docs)).alias("label_id"), F.col(label_col).cast("int").alias("label"))
        .where("label_id is not null and label in (0, 1)")
        .groupBy("label_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where("label = most")
    )
    # a first cut by hash leaves some four times fit_rows, so that the sort for the rest meets few rows at any
    # size; that it leaves fewer than fit_rows has a probability under 1e-30, with few rows too
    share = min(1.0, (4 * fit_rows + 200) / max(1, known.count()))
    if share < 1:
        known = known.where(F.xxhash64("label_id") < F.lit(int(-(2**63) + share * 2**64)))
    # at most fit_rows pairs of an id and a label: a few hundred kilobytes
    chosen = known.select("label_id", "label").orderBy(F.xxhash64("label_id"), "label_id").limit(fit_rows)
    taught = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    found = stats(taught, label_col="label").select("doc_id", "label", F.struct(*[ratio(r[0]).alias(r[0]) for r in RATIOS]).alias("r"))
    # rows that share an id teach once, by the least ratios; one row for each chosen id reaches the driver
    rows = found.groupBy("doc_id", "label").agg(F.min("r").alias("r")).select("doc_id", "label", "r.*").toPandas()
    if not len(rows):
        return []
    rows = rows.sort_values("doc_id").reset_index(drop=True)
    return learn(rows[[r[0] for r in RATIOS]].to_numpy(float), (rows["label"] == 0).to_numpy(), **how)


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects: one ordered conditional expression."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), F.lit(False)) if out is None else out.when(rule.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def first_rule(rules: list[Rule]) -> Column:
    """Number of the rule that decides, from 1; null where none does."""
    out = F.lit(None).cast("int")
    for i in range(len(rules), 0, -1):
        out = F.when(rules[i - 1].column(), F.lit(i)).otherwise(out)
    return out


#: Failing on too few words or too many repeated ones, whatever the rules say.
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def judge(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, base: str = BASE_FAILED) -> DataFrame:
    """Counts of every document with ``base_failed``, ``rule`` and ``kept``."""
    rules = fit(docs, labels, fit_rows=fit_rows)
    out = stats(docs).withColumn("base_failed", F.expr(base))
    return out.withColumn("rule", first_rule(rules)).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, base: str = BASE_FAILED) -> DataFrame:
    """The documents that pass, with their own columns; no shuffle and no join on texts."""
    rules = fit(docs, labels, fit_rows=fit_rows)
    counts = [f.split()[0] for f in STATS.split(", ")[1:]]
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_stats(t) for t in as_bytes(batch.column(1))]
            columns = zip(*rows) if rows else [[]] * len(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["_row", *counts])

    small_batches(docs.sparkSession)
    schema = StructType([packed.schema["_row"], *(StructField(c, LongType()) for c in counts)])
    return packed.mapInArrow(run, schema).where(~F.expr(base) & verdict(rules)).select("_row.*")

"""Line deduplication over overlapping three-line windows, with DataFrame functions only.

A window is ``size`` consecutive lines of a text, lines being what ``\\n`` separates. Windows are
compared by 128 hash bits of their lines. The first occurrence of a window is the one with the
least (doc_id, line); every later occurrence is covered, and a line in a covered window goes. Since
an earlier equal line exists for each line that goes, every distinct line stays somewhere.

Defined cases: a text of fewer lines than a window, an empty and a null text stay as they are;
windows of blank lines alone are no windows. Ids that are no whole numbers come in the order of a hash.
A row without id comes after all ids, in the order of a hash of its text. Rows of one id and text are
one document, so repeated rows, with an id or without, are treated alike. Columns of the input keep
their names and values, but for the text and ``n_chars``, which follows it; ``n_lines`` and ``n_removed``
get underscores at their end where the input has columns of these names.

With ``short``, which the pipeline's stage sets and the query's fixed SQL does not have, a text of fewer
lines than a window is one window too, compared with such texts, and so is each line of over
``LONG_WORDS`` words by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import id_number, unused

SIZE = 3
LONG_WORDS = 50


def _windows(docs: DataFrame, size: int, id_col: str, text_col: str, short: bool) -> DataFrame:
    """``key, text_hash, line, n, h1, h2`` of each window; n is how many lines it has."""
    rows = docs.select(id_number(docs, id_col).alias("key"), F.xxhash64(text_col).alias("text_hash"), F.split(text_col, "\n").alias("lines"))
    if not short:
        rows = rows.where(F.size("lines") >= size)

    def window(i):
        lines = [F.get("lines", i + k) for k in range(size)]
        return F.struct(i.cast("int").alias("line"), F.lit(size).alias("n"), F.xxhash64(*lines).alias("h1"), F.xxhash64(F.lit(size), *lines).alias("h2"), F.concat(*lines).rlike(r"\S").alias("has_words"))

    def other(i, n, text, kind):
        # the kind keeps the hashes of long lines and short texts apart
        return F.struct(i.cast("int").alias("line"), n.alias("n"), F.xxhash64(F.lit(kind), text).alias("h1"), F.xxhash64(text, F.lit(kind)).alias("h2"), text.rlike(r"\S").alias("has_words"))

    found = F.transform(F.sequence(F.lit(0), F.size("lines") - size), window)
    if short:
        whole = F.array(other(F.lit(0), F.size("lines"), F.array_join("lines", "\n"), "text"))
        line = lambda i: F.get("lines", i)
        is_long = lambda i: line(i).rlike(r"^\s*+(?:\S++\s++){%d}\S" % LONG_WORDS)
        long = F.transform(F.filter(F.sequence(F.lit(0), F.size("lines") - 1), is_long), lambda i: other(i, F.lit(1), line(i), "line"))
        found = F.concat(F.when(F.size("lines") >= size, found).otherwise(whole), long)
    return rows.select("key", "text_hash", F.explode(found).alias("w")).where("w.has_words").select("key", "text_hash", "w.line", "w.n", "w.h1", "w.h2")


def covered(docs: DataFrame, *, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """``key, text_hash, starts``: first line and number of lines of the later occurrences in each document that has any."""
    owner = f"coalesce(cast(key as decimal(20,0)), {2**63} + shiftrightunsigned(text_hash, 1))"
    windows = _windows(docs, size, id_col, text_col, short).withColumn("place", F.expr(f"cast({owner} as decimal(20,0)) * 1000000000 + line"))
    repeated = windows.groupBy("h1", "h2").agg(F.min("place").alias("first_place"), F.count("*").alias("times")).where("times > 1").drop("times")
    later = windows.join(repeated, ["h1", "h2"]).where("place > first_place")
    return later.groupBy("key", "text_hash").agg(F.array_sort(F.collect_set(F.struct("line", "n"))).alias("starts"))


def deduplicate(
    docs: DataFrame, *, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False, short: bool = False, counts: bool = True
) -> DataFrame:
    """The documents without their covered lines, plus ``n_lines`` and ``n_removed`` if ``counts``.

    ``drop_emptied`` drops documents that lose every line. ``n_chars`` follows the text.
    """
    key, text_hash, starts, gone, whole, n_lines, n_removed = unused(docs, "_key", "_text_hash", "_starts", "_gone", "_whole", "n_lines", "n_removed")
    found = covered(docs, size=size, id_col=id_col, text_col=text_col, short=short).toDF(key, text_hash, starts)
    match = id_number(docs, id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(text_hash))
    joined = docs.join(found, match, "left")
    lines = F.split(text_col, "\n")
    # positions that the windows cover, merged: each window adds its lines once
    covering = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s["line"], s["line"] + s["n"] - 1))))
    # lines between the covered ones, gap by gap, so that long texts need no search for each line
    stops = F.concat(F.col(gone), F.array(F.size(lines)))
    gaps = F.flatten(F.zip_with(F.concat(F.array(F.lit(-1)), F.col(gone)), stops, lambda a, b: F.slice(lines, a + 2, b - a - 1)))
    out = joined.withColumn(n_lines, F.coalesce(F.size(lines), F.lit(0)).cast("bigint")).withColumn(gone, covering)
    out = out.withColumn(n_removed, F.coalesce(F.size(gone), F.lit(0)).cast("bigint"))
    changed = F.col(starts).isNotNull()
    out = out.withColumn(whole, F.when(changed, F.array_join(gaps, "\n")).otherwise(F.col(text_col)))
    if drop_emptied:
        out = out.where((F.col(n_removed) < F.col(n_lines)) | (F.col(n_lines) == 0))

    def column(c: str):
        if c == text_col:
            return F.col(whole).alias(c)
        if c == "n_chars":
            return F.when(changed, F.length(whole)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c)
        return F.col(c)

    return out.select(*map(column, docs.columns), *([n_lines, n_removed] if counts else []))

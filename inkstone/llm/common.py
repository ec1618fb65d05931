"""Helpers that the training-data operators share.

Texts cross to Python as Arrow batches of a few hundred rows, so that a worker holds a few
megabytes at a time whatever the size of a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType, StructType

from inkstone.session import durable, ship_code  # noqa: F401

BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds: texts are large, rows are few."""
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch], pa.Schema], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """mapInArrow with bounded batches; ``fn`` also gets the Arrow schema of ``ddl``."""
    small_batches(df.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return df.mapInArrow(lambda batches: fn(batches, schema), ddl)


def id_kind(docs: DataFrame, id_col: str = "doc_id") -> str:
    """The type in which ids travel: whole numbers as bigint, all else as string."""
    return "bigint" if isinstance(docs.schema[id_col].dataType, IntegralType) else "string"


def ids_and(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "doc_id") -> DataFrame:
    """The ids and texts alone, so that no other column can clash with what an operator adds."""
    return docs.select(F.col(id_col).cast(id_kind(docs, id_col)).alias(name), F.col(text_col).alias("text"))


def id_number(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Ids as numbers that keep the order of whole numbers; other ids by 64 hash bits, whose order is fixed. Null stays null."""
    if id_kind(docs, id_col) == "bigint":
        return F.col(id_col).cast("bigint")
    return F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("string")))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores after those that the documents have as columns."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    """Strings of a column; null becomes empty."""
    return [x or "" for x in column.to_pylist()]


#: Byte table: A-Z to lower case, all that is no digit, letter or byte above 127 to a space.
PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def plain_words(text: bytes) -> list[bytes]:
    r"""Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z is lower-cased."""
    return text.translate(PLAIN).split()

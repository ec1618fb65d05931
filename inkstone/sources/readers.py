"""Readers and sinks: JSON corpora, key maps, JSONL, XML, CSV, pattern lists, resumable stages, ledgers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "corpus array<struct<id string, date string, original string, translation string, reference string>>"
PERSON = "map<string, struct<`한글_명` string, `한자_명` string, `본관_표준` string, `활동_시작` int, `활동_종료` int, `관직_리스트` array<string>>>"


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A root object with an array under ``corpus``; the place in the array is ``seq``."""
    rows = spark.read.schema(CORPUS).option("multiLine", True).json(path).select(F.posexplode("corpus").alias("seq", "r"))
    return rows.select(F.col("seq").cast("bigint"), "r.id", "r.date", "r.original", F.coalesce("r.translation", "r.reference").alias("translation"))


def kb_people(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map from id to person, read with a declared schema, so that keys do not become columns."""
    whole = spark.read.option("wholetext", True).text(path)
    rows = whole.select(F.explode(F.from_json("value", PERSON)).alias("kb_id", "p"))
    names = {"한글_명": "hangul", "한자_명": "hanja", "본관_표준": "clan", "활동_시작": "active_from", "활동_종료": "active_to", "관직_리스트": "offices"}
    return rows.select("kb_id", *[F.col(f"p.`{k}`").alias(v) for k, v in names.items()])


def kb_index(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map from surface to ordered ids: ``surface, pos, kb_id``; repeated ids stay."""
    whole = spark.read.option("wholetext", True).text(path)
    rows = whole.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("surface", "ids"))
    return rows.select("surface", F.posexplode("ids").alias("pos", "kb_id"))


def jsonl(spark: SparkSession, path: str, schema: str, key: str = "id", required: str = "hypothesis") -> DataFrame:
    """Lines that parse and have the required field; of a key the last line of the last file wins."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_n"), F.from_json("value", schema).alias("r"))
    rows = lines.where(F.col(f"r.{required}").isNotNull())
    return rows.groupBy(F.col(f"r.{key}").alias("_k")).agg(F.max_by("r", F.struct("_f", "_n")).alias("r")).select("r.*")


def xml_articles(spark: SparkSession, path: str) -> DataFrame:
    """``id, translation`` of each article; a file that is no well-formed XML is read by pattern."""
    whole = spark.read.option("wholetext", True).text(path)
    blocks = F.regexp_extract_all("value", F.lit(r"(?s)(<article\b.*?</article>)"), F.lit(1))
    a = whole.select(F.explode(blocks).alias("a"))
    parsed = F.from_xml("a", "_id string, translation string", {"mode": "PERMISSIVE"})
    by_pattern = F.nullif(F.regexp_extract("a", r"(?s)<translation>(.*?)</translation>", 1), F.lit(""))
    ids = F.nullif(F.regexp_extract("a", r'<article\b[^>]*\bid="([^"]*)"', 1), F.lit(""))
    return a.select(F.coalesce(parsed["_id"], ids).alias("id"), F.coalesce(parsed["translation"], by_pattern).alias("translation"))


def office_history(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header and nullable years."""
    return spark.read.option("escape", '"').csv(path, header=True, schema="`인물아이디` string, `한자_명` string, `한글_명` string, `본관_표준` string, `생년` int, `몰년` int, `년` int, `관직명_정규화` string, `자` string, `호` string")


def patterns(lines: list[str], columns: int = 2) -> list[tuple[str, ...]]:
    """A pattern list in file order: blank lines and comments go; too few columns or no rows is an error."""
    out = []
    for line in (x.strip() for x in lines):
        if not line or line.startswith("#"):
            continue
        cells = tuple(line.split("\t"))
        if len(cells) < columns:
            raise ValueError(f"a pattern needs {columns} columns: {line!r}")
        out.append(cells[:columns])
    if not out:
        raise ValueError("the pattern list is empty")
    return out


def pattern_list(spark: SparkSession, path: str, columns: int = 2) -> DataFrame:
    """``place, pattern, label`` of a pattern file in file order; with one column the label is null. A list is a configuration file."""
    lines = [line for r in spark.read.option("wholetext", True).text(path).collect() for line in r.value.split("\n")]
    rows = [(i, *r, None)[:3] for i, r in enumerate(patterns(lines, columns))]
    return spark.createDataFrame(rows, "place int, pattern string, label string")


def resumable(todo: DataFrame, done: DataFrame | None, key: str, stage: Callable[[DataFrame], DataFrame], sink: str) -> DataFrame:
    """Run a costly stage on distinct keys that are not done, append to the sink, and return all of it."""
    rest = todo.dropDuplicates([key])
    if done is not None:
        rest = rest.join(done.select(key), key, "left_anti")
    stage(rest).write.mode("append").parquet(sink)
    return todo.sparkSession.read.parquet(sink)


def insert_if_absent(have: DataFrame, new: DataFrame, key: str, sink: str) -> None:
    """Append rows whose key the sink's table lacks."""
    new.join(have.select(key), key, "left_anti").write.mode("append").parquet(sink)


def append(rows: DataFrame, sink: str) -> None:
    """Append rows as they are: a ledger keeps every call, also one whose answer did not parse."""
    rows.write.mode("append").parquet(sink)


def tsv_report(df: DataFrame, path: str, cell: int = 80) -> None:
    """Write a report: tabs and line ends in cells become spaces, cells are cut."""
    clean = [F.substring(F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]+", " "), 1, cell).alias(c) for c in df.columns]
    # what is left has no tab or line end, so nothing is quoted and a quotation mark is a character like any other
    df.select(*clean).write.mode("overwrite").option("quote", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path, sep="\t", header=True)

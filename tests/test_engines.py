"""Queries against their SQL on texts that Java and DuckDB read by rules of their own."""

import duckdb
import pytest
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.queries.catalog import ORACLE, QUERIES
from tests.compare import duck_rows, spark_rows


def check(spark, folder, name, texts):
    """A query and its SQL over a table of documents that has these texts."""
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, 'de', 'web', ?)", [[i, t, len(t or "")] for i, t in enumerate(texts, 1)])
    con.execute(f"copy documents to '{folder}/documents.parquet' (format parquet)")
    found = spark_rows(QUERIES[name](spark, str(folder)))
    assert found == duck_rows(con, ORACLE[name])
    return found


# words beside letters, marks and digits; the long s is a case of s, but no character of an ASCII word
WORDS = ["and", "der", "les", "LES", "leſ", "licence", "licenſe", "LICENSE"]
BESIDE = ["", " ", "é", "ß", "한", "ſ", "́", " ", "x", "1", "_", "𠀀", "'"]
ODD_WORDS = [a + w + b for w in WORDS for a in BESIDE for b in BESIDE] + ["lesé der", "and les licenſe", None, "", "land", "éclesé\nand"]


@pytest.mark.parametrize("name", ["b5_any_pattern", "b6_first_pattern_label", "b7_all_matching_phrases", "b9_stratum_key", "l36_guide_block"])
def test_words_are_of_ascii(spark, tmp_path, name):
    check(spark, tmp_path, name, ODD_WORDS)


def test_templates_change_case_code_point_by_code_point(spark, tmp_path):
    """A name that would only stand in a text whose ß had become SS is no name there."""
    odd = ["ß", "ẞ", "ŉ", "ﬁ", "İ", "ı", "ΑΣ", "ᾳ", "ᾼ", "ǆ", "ǅ", "ſ", "ΐ", "և", "𐐨", "i̇"]
    surfaces = ["Sungein", "Schwester", "Schheit", "Strasse", "Gefluess", "Wassern", "Fliegen", "Istanbul", "Njemanac"]
    texts = [f"{s} {o}{s[1:]} x{s[:-2].lower()}{o} {o}" for s in surfaces for o in odd]
    _, rows = check(spark, tmp_path, "l8_translation_templating", texts)
    assert any("SSUNGEIN" in r for r in rows) and any("ﬁ" in r for r in rows)


def test_simple_cases_are_those_of_duckdb(spark):
    text = "".join(chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000) + "ΑΣ ß"
    df = spark.createDataFrame([(text,), ("Az",), ("",), (None,)], "t string")
    found = [tuple(r) for r in df.select(T.simple_upper(F.col("t")), T.simple_lower(F.col("t"))).collect()]
    assert found == [duckdb.execute("select upper(?::varchar), lower(?::varchar)", [t, t]).fetchone() for (t,) in df.collect()]

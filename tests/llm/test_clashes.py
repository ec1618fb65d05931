"""Columns with the operators' inner names, ids near 2^63, string ids and missing ids."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkstone.llm import bpe, decontam, licenses, linededup, lmscore, neardup, pii, quality, simhash, tokencount
from tests.llm.helpers import EDGE, HUGE, crowded, inner_names, unharmed

PATH = P.path("byte_bpe_50k.tiktoken")
ROWS = [*EDGE, (HUGE, "card 4111111111111111\nx y z\nu v w\na b c"), (-HUGE, "x y z\nu v w\na b c\nd"), (2**63 - 1, "a\nb\nc\nd"), (-(2**63), "a\nb\nc\nd")]


def labels(spark, kind="bigint"):
    rows = [(HUGE, 1, 0), (-HUGE, 0, 0), (5, 1, 0), (7, 0, 1), (2**63 - 1, 1, 0), (-(2**63), 0, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").select(F.col("doc_id").cast(kind), "quality", "toxic", F.lit(1).alias("label"), F.lit(2).alias("label_id"))


def items(spark):
    return spark.createDataFrame([(1, "x y z u v w a b c d"), (2, None)], "item_id bigint, text string")


REWRITES = {
    "pii": lambda s, d: pii.pseudonymise(d, "k"),
    "linededup": lambda s, d: linededup.deduplicate(d),
    "line stage": lambda s, d: corpus_pipeline.line_dedup(s, d, ""),
    "quality": lambda s, d: quality.keep(d, labels(s, dict(d.dtypes)["doc_id"]), base="n_words < 0"),
    "decontam": lambda s, d: decontam.clean(d, items(s)),
    "decontam blocks": lambda s, d: decontam.clean(d, items(s), block_words=1),
    "simhash": lambda s, d: simhash.deduplicate(d),
    "neardup": lambda s, d: neardup.deduplicate(d),
}


@pytest.mark.parametrize("name", sorted(REWRITES))
def test_own_columns_keep_their_values(spark, name):
    d = crowded(spark, ROWS)
    out = REWRITES[name](spark, d)
    assert out.columns[: len(d.columns)] == d.columns
    assert 0 < out.count() <= len(ROWS)
    assert unharmed(out, inner_names())


READS = {
    "decontam": lambda s, d: decontam.report(decontam.find(d, items(s))),
    "quality": lambda s, d: quality.judge(d, labels(s, dict(d.dtypes)["doc_id"])),
    "tokencount": lambda s, d: tokencount.count(d, PATH),
    "licenses": lambda s, d: licenses.report(licenses.find(d)),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "lmscore": lambda s, d: lmscore.cross_entropy_difference(d, labels(s, dict(d.dtypes)["doc_id"])),
    "bpe": lambda s, d: bpe.digests(d, PATH),
}


@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize("name", sorted(READS))
def test_one_row_for_each_row(spark, name, kind):
    d = crowded(spark, [(None if i is None else str(i) if kind == "string" else i, t) for i, t in ROWS], f"doc_id {kind}, text string")
    got = [r.doc_id for r in READS[name](spark, d).collect()]
    assert sorted(map(repr, got)) == sorted(repr(r.doc_id) for r in d.collect())


@pytest.mark.parametrize("name", sorted(REWRITES))
def test_string_ids(spark, name):
    d = spark.createDataFrame([(None if i is None else f"doc-{i}", t) for i, t in ROWS], "doc_id string, text string")
    out = REWRITES[name](spark, d)
    assert 0 < out.count() <= len(ROWS) and set(out.select("doc_id").collect()) <= set(d.select("doc_id").collect())

"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, encoding.

``run(spark, sf_dir)`` applies the stages to ``documents``; each stage's rows are written as Parquet to the
folder that driver and executors share and read again before the next, so lineage stays short. A stage's
rows go when the next stage's are whole. A run with a name of its own is resumed under that name: stages
whose rows are whole are not repeated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from inkstone.llm import bpe, decontam, linededup, neardup, quality
from inkstone.llm.queries import RANKS
from inkstone.session import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words that neither the learned decision list nor the repeat limit rejects; short ones stay."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), base="n_words = 0 or 100 * n_repeat_words > 50 * n_words")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line windows, long lines and short texts; a document that loses every line goes."""
    return linededup.deduplicate(docs, drop_emptied=True, short=True, counts=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group that five-word shingles of similarity 0.8 link."""
    return neardup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark spans; a document that is little else goes."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with the digests of ids and of decoded bytes."""
    return bpe.digests(docs, RANKS, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: Learned rules and merges have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """Apply the stages to ``documents``; with the ``run_id`` of a run that failed, from its last whole stage on."""
    home = f"{shared_folder(spark)}/pipeline-{run_id or uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path
    files = folder(home).getFileSystem(spark._jsc.hadoopConfiguration())
    paths = [f"{home}/{i}-{name}" for i, (name, _) in enumerate(STAGES)]
    whole = [i for i, path in enumerate(paths) if files.exists(folder(f"{path}/_SUCCESS"))]
    done = max(whole, default=-1)
    docs = spark.read.parquet(paths[done] if whole else f"{sf_dir}/documents.parquet")
    for i in range(done + 1, len(STAGES)):
        STAGES[i][1](spark, docs, sf_dir).write.mode("overwrite").parquet(paths[i])
        docs = spark.read.parquet(paths[i])
        if i:
            files.delete(folder(paths[i - 1]), True)
    return docs

import base64
import os
import uuid

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from inkstone.llm import decontam, linededup, quality, simhash
from inkstone.llm import queries as Q
from inkstone.llm.common import plain_words
from inkstone.session import shared_folder
from tests.compare import duck, duck_rows, spark_rows
from tests.llm.test_neardup import expected

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    assert spark_rows(Q.queries()[name](spark, SF)) == duck_rows(duck(SF), Q.oracle_sql()[name])


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert 0 < docs.count() < 200
    # each stage finds nothing left of its own kind
    assert linededup.deduplicate(docs).where("n_removed > 0").count() == 0
    assert simhash.near_duplicates(docs).where("doc_id <> component_id").count() == 0
    assert decontam.report(decontam.find(docs, items)).where("n_items > 0").count() == 0
    assert quality.fit(docs, labels) is not None


def kept_by_rules(rows, rules):
    names = [f.split()[0] for f in quality.STATS.split(", ")[1:]]
    for row in rows:
        n = dict(zip(names, quality.text_stats((row[1] or "").encode())))
        ratios = {name: n[a] / n[b] if n[b] else 0.0 for name, a, b in quality.RATIOS}
        bad = any(all(ratios[r] >= x if op == ">=" else ratios[r] <= x for r, op, x in rule.terms) for rule in rules)
        if n["n_words"] and 100 * n["n_repeat_words"] <= 50 * n["n_words"] and not bad:
            yield row


def without_repeats(rows):
    seen = set()
    for i, text in sorted(rows):
        lines = text.split("\n")
        windows = [("w", p, 3, tuple(lines[p : p + 3])) for p in range(len(lines) - 2)] or [("t", 0, len(lines), text)]
        windows += [("l", p, 1, x) for p, x in enumerate(lines) if len(x.split()) > 50]
        gone = set()
        for kind, p, n, what in windows:
            if "".join(what).strip():
                if (kind, what) in seen:
                    gone.update(range(p, p + n))
                seen.add((kind, what))
        if len(gone) < len(lines):
            yield i, "\n".join(x for p, x in enumerate(lines) if p not in gone)


def without_benchmark(rows, items):
    words = [(i, plain_words((t or "").encode())) for i, t in items]
    for i, text in rows:
        w = plain_words(text.encode())
        hit, least = set(), 0
        for _, q in words:
            n = min(8, len(q))
            grams = {tuple(q[a : a + n]) for a in range(len(q) - n + 1)} if n else set()
            here = [p for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in grams] if n else []
            if here:
                hit.update(x for p in here for x in range(p, p + n))
                least = min(least or len(q), len(q))
        spans = decontam.merged([(p, p + 1) for p in hit])
        new = decontam.without_spans(text.encode(), spans, least, max_words=8, max_coverage=0.5, max_share=0.8)
        if new is not None:
            yield i, new.decode()


def test_whole_run_against_brute_force(spark):
    """Every stage once more in plain Python; only the learned rules are the stage's own."""
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    rows = list(kept_by_rules(rows, quality.fit(d, labels)))
    rows = list(without_repeats(rows))
    alone = set(expected(rows))
    rows = [r for r in rows if r[0] in alone]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = list(without_benchmark(rows, items))
    with open(Q.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: theirs.encode_ordinary(t) for i, t in rows}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 100 < len(got) < d.count()


def test_a_run_is_resumed(spark, monkeypatch):
    calls = []

    def broken(*_):
        raise RuntimeError("an executor is lost")

    def counted(name, stage):
        return name, lambda *a: (calls.append(name), stage(*a))[1]

    stages = [counted(*s) for s in corpus_pipeline.STAGES]
    run_id = uuid.uuid4().hex
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*stages[:3], ("decontaminate", broken), stages[4]])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, SF, run_id)
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    n = corpus_pipeline.run(spark, SF, run_id).count()
    assert calls == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "encode"]
    assert corpus_pipeline.run(spark, SF, run_id).count() == n and len(calls) == 5
    home = f"{shared_folder(spark)}/pipeline-{run_id}"
    assert os.listdir(home) == ["4-encode"]  # the stages before it have gone

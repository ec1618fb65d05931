"""Scores against a plain Python version of both models."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkstone.llm import lmscore
from tests.llm.helpers import EDGE, HUGE, docs


def brute(rows, cells, folds):
    uni, pairs = [Counter() for _ in range(4)], [Counter() for _ in range(4)]
    for i, t in rows:
        if i in cells:
            s = (t or "").split()
            uni[cells[i]].update(s)
            pairs[cells[i]].update(zip(["<s>", *s], s))
    out = []
    for i, t in rows:
        s = (t or "").split()
        g = 1 - folds[i]
        words, both = uni[2 * g] + uni[2 * g + 1], pairs[2 * g] + pairs[2 * g + 1]
        vocabulary = {w for w, n in words.items() if n >= lmscore.LEAST}
        kept = {p for p, n in both.items() if n >= lmscore.LEAST}
        losses = []
        for m in (2 * g, 2 * g + 1):
            total = sum(uni[m].values())
            unknown = sum(n for w, n in uni[m].items() if w not in vocabulary)
            loss = 0.0
            for v, w in zip(["<s>", *s], s):
                p1 = ((uni[m][w] if w in vocabulary else unknown) + lmscore.BETA) / (total + lmscore.BETA * (len(vocabulary) + 1))
                context = sum(n for p, n in pairs[m].items() if p in kept and p[0] == v)
                loss -= math.log(((pairs[m][v, w] if (v, w) in kept else 0) + lmscore.ALPHA * p1) / (context + lmscore.ALPHA))
            losses.append(loss / len(s) if s else None)
        out.append((i, len(s), *losses, losses[0] - losses[1] if s else None))
    return out


@pytest.mark.parametrize(("limit", "value"), [("HEAD", 1 << 19), ("CHUNK_WORDS", 20), ("HEAD", 0), ("HEAD", 25), ("BROADCAST_IDS", 0), ("TASK_DOCS", 1), ("_MOST", 3)])
def test_scores_against_brute_force(spark, monkeypatch, limit, value):
    """The limits deal work and save traffic: with any of them lowered the scores are the same."""
    monkeypatch.setattr(lmscore, limit, value)
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("a a a b b c d e f g h i j k".split()) for _ in range(r.randrange(30)))) for i in range(120)]
    rows += [(None, "a b zzz"), (500, None), (501, ""), (3, "a second text of the same id"), (HUGE, "a b"), (7, rows[7][1])]
    marks = [(i, int(i % 3 == 0), 0) for i in range(100)] + [(3, 0, 0), (6, 1, None), (None, 1, 0), (HUGE, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    d = docs(spark, rows)
    cells = {x.train_id: x.cell for x in lmscore.roles(d, labels).collect()}
    folds = {x.doc_id: x.f for x in d.select("doc_id", lmscore.fold("doc_id").alias("f")).collect()}
    good = {i for i, q, _ in marks if q} - {3, 6, None}
    assert {i for i, c in cells.items() if c % 2 == 0} == good and all(c // 2 == folds[i] for i, c in cells.items())
    assert 0.5 * len(good) < len(cells) - len(good) < 1.6 * len(good)
    got = [tuple(x) for x in lmscore.cross_entropy_difference(d, labels).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for x, y in zip(sorted(got, key=key), sorted(brute(rows, cells, folds), key=key), strict=True):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:], abs=1e-9)


def test_targets_score_lower_than_others(spark):
    """Held out: neither model has seen the document that it scores."""
    r = random.Random(4)
    say = lambda good: " ".join(r.choice(["red", "blue", "green"] if good and r.random() < 0.5 else ["one", "two", "three", "four"]) for _ in range(40))
    rows = [(i, say(i % 2)) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id bigint, quality int, toxic int")
    got = lmscore.cross_entropy_difference(docs(spark, rows), labels)
    low = {x.good: x.score for x in got.groupBy((F.col("doc_id") % 2).alias("good")).agg(F.avg("score").alias("score")).collect()}
    assert low[1] < low[0] - 0.2


def test_without_documents_or_labels(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert lmscore.cross_entropy_difference(docs(spark, []), labels).count() == 0
    assert lmscore.cross_entropy_difference(docs(spark, EDGE), labels).count() == len(EDGE)

import random

import numpy as np
from pyspark.sql import functions as F

from inkstone.llm import quality as Q
from tests.llm.helpers import EDGE, docs


def brute(text):
    text = text or ""
    spaces = " \t\n\x0b\x0c\r"
    words = text.encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, seen, dups = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(spaces):
            dups += line in seen
            seen.add(line)
    return len(words), sum(c not in spaces for c in text), sum(c in "#*$%&|<>" for c in text), dups, len(repeated)


def test_counts_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("ab é\n*") for _ in range(r.randrange(200)))) for i in range(60)]
    rows += [e for e in EDGE if e[0] != 5]
    got = Q.stats(docs(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *brute(t))) for i, t in rows)


def test_repeats_in_very_long_texts(monkeypatch):
    words = [b"a", b"b", b"c", b"d"] * 3 + [b"%d" % i for i in range(50)]
    assert Q.repeated_words(words) == 12
    assert Q.repeated_words([b"w%d" % (i % 7) for i in range(1 << 20)]) == 1 << 20


def table(n, seed):
    r = random.Random(seed)
    good = lambda: " ".join(r.choice(["plain", "words", "make", "good", "text", "of", "many", "kinds"]) + r.choice("abcdefgh") for _ in range(80))
    bad = lambda: " ".join(r.choice(["odd", "text", "x"]) + r.choice("abcdefghij") + r.choice("klmnopqr") + r.choice(["***", "$$$"]) for _ in range(80))
    return [(i, (bad if i % 4 == 0 else good)()) for i in range(n)]


def test_held_out_accuracy(spark):
    rows = table(400, 1)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(200)] + [(1, None, 0), (2, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    d = docs(spark, rows)
    got = Q.judge(d, labels).where("doc_id >= 200").select("doc_id", "kept").collect()
    assert np.mean([r.kept == (r.doc_id % 4 != 0) for r in got]) > 0.97
    kept = Q.keep(d, labels)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in Q.judge(d, labels).where("kept").collect())


def test_edges_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = Q.judge(docs(spark, EDGE), none)
    assert out.where(F.col("kept") != ~F.col("base_failed")).count() == 0
    assert out.count() == len(EDGE)
    assert Q.judge(docs(spark, []), none).count() == 0


def test_rules_are_ordered_expressions(spark):
    rules = [Q.Rule((("symbol_ratio", ">=", 0.5),)), Q.Rule((("mean_word", "<=", 2.0), ("n", ">=", 0.0))[:1])]
    rows = spark.createDataFrame([(1, 10, 10, 9), (2, 10, 15, 0), (3, 10, 90, 0)], "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint")
    got = {r.doc_id: (r.kept, r.rule) for r in rows.select("doc_id", Q.verdict(rules).alias("kept"), Q.first_rule(rules).alias("rule")).collect()}
    assert got == {1: (False, 1), 2: (False, 2), 3: (True, None)}


def test_the_first_threshold_is_the_best_of_all():
    """Growing takes, of every cut of every ratio in either direction, the one of the largest information gain."""
    r = random.Random(3)
    x = np.array([[r.choice([0.0, 0.1, 0.2, 0.5, 0.9]) for _ in Q.RATIOS] for _ in range(60)])
    bad = (x[:, 2] >= 0.5) & (x[:, 5] <= 0.2) | np.array([r.random() < 0.1 for _ in range(60)])
    p, n = int(bad.sum()), int((~bad).sum())
    best = 0.0
    for k in range(len(Q.RATIOS)):
        values = sorted(set(x[:, k]))
        for cut in ((a + b) / 2 for a, b in zip(values, values[1:])):
            for inside in (x[:, k] <= cut, x[:, k] >= cut):
                pp, nn = int((inside & bad).sum()), int((inside & ~bad).sum())
                if pp:
                    best = max(best, pp * (np.log2(pp / (pp + nn)) - np.log2(p / (p + n))))
    first = Q._grow(x, bad, 1, 65)
    inside = Q._covers(first, x)
    pp, nn = int((inside & bad).sum()), int((inside & ~bad).sum())
    assert len(first) == 1 and abs(pp * (np.log2(pp / (pp + nn)) - np.log2(p / (p + n))) - best) < 1e-9
    # pruning leaves the shortest of the best prefixes on the rows held back
    terms = Q._grow(x, bad, 4, 65)
    worth = {t: ((c := Q._covers(t, x))[bad].sum() - c[~bad].sum()) / c.sum() for t in (terms[:i] for i in range(1, len(terms) + 1))}
    assert Q._prune(terms, x, bad) == max(worth, key=lambda t: (worth[t], -len(t)))


def test_few_labels_are_all_taught(spark):
    rows = table(60, 4)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    assert Q.fit(docs(spark, rows), labels, fit_rows=20)
    assert Q.fit(docs(spark, rows), labels, fit_rows=60) and Q.fit(docs(spark, []), labels) == []

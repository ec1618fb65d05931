import random

import corpus_pipeline
from inkstone.llm import linededup as L
from tests.llm.helpers import EDGE, docs


def brute(rows):
    seen, out = set(), []
    for i, t in sorted(rows):
        lines = (t or "").split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not "".join(w).strip():
                continue
            if w in seen:
                gone.update(range(p, p + 3))
            seen.add(w)
        out.append((i, 0 if t is None else len(lines), len(gone), t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, "\n".join(r.choice(["a", "b", "", "c"]) for _ in range(r.randrange(30)))) for i in range(60)]
    got = L.deduplicate(docs(spark, rows)).select("doc_id", "n_lines", "n_removed", "text").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_edges(spark):
    rows = [*EDGE, (8, "x\ny\nz"), (9, "x\ny\nz"), (9, "x\ny\nz"), (None, "x\ny\nz\nw")]
    out = L.deduplicate(docs(spark, rows)).select("doc_id", "n_removed", "text").collect()
    assert len(out) == len(rows)
    assert [r.n_removed for r in out if r.doc_id == 8] == [0]
    assert [r.n_removed for r in out if r.doc_id == 9] == [3, 3]  # repeated rows are treated alike
    assert [r.text for r in out if r.doc_id is None and r.n_removed] == ["w"]
    assert L.deduplicate(docs(spark, [])).count() == 0


def test_emptied_documents_can_go(spark):
    rows = [(1, "x\ny\nz"), (2, "x\ny\nz"), (3, None), (4, "")]
    assert sorted(r.doc_id for r in L.deduplicate(docs(spark, rows), drop_emptied=True).collect()) == [1, 3, 4]


def test_no_python_in_the_plan(spark):
    plan = L.deduplicate(docs(spark, [(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_short_texts_and_long_lines(spark):
    long = " ".join(f"w{i}" for i in range(51))
    rows = [(1, "one line"), (2, "one line"), (3, "two\nlines"), (4, "two\nlines"), (5, f"a\n{long}\nb"), (6, f"c\n{long}\nd\ne"), (7, long), (8, long[: long.rindex(" ")]), (9, "x\n" + long[: long.rindex(" ")]), (10, "one line\nmore")]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs(spark, rows), "").collect()}
    assert got == {1: "one line", 3: "two\nlines", 5: rows[4][1], 6: "c\nd\ne", 8: rows[7][1], 9: rows[8][1], 10: rows[9][1]}


def test_short_windows_beside_brute_force(spark):
    r = random.Random(3)
    rows = [(i, "\n".join(r.choice(["a", "b", "", "c"]) for _ in range(r.randrange(3, 30)))) for i in range(60)]
    got = L.deduplicate(docs(spark, rows), short=True).select("doc_id", "n_lines", "n_removed", "text").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))

"""License scans against every block of every text."""

import math
import random

import pytest

from inkstone.llm import licenses
from inkstone.llm.common import plain_words
from inkstone.llm.licenses import TEMPLATES, THRESHOLD, Template
from tests.llm.helpers import docs


def brute(text, templates):
    """(label, start, containment) of every matching block."""
    words = plain_words((text or "").encode())
    out = set()
    for t in templates:
        width = min(math.ceil(len(t.words) / THRESHOLD - 1e-9), len(words))
        distinct = set(t.words)
        for s in range(len(words) - width + 1 if words else 0):
            block = words[s : s + width]
            share = len(distinct & set(block)) / len(distinct)
            named = all(any(block[i : i + len(p)] == p for i in range(width)) for p in t.phrases)
            if share >= THRESHOLD and named:
                out.add((t.label, s, width, share))
    return out


def wrapped(text, width, mark="# "):
    words, lines = text.split(), []
    while words:
        lines.append(mark + " ".join(words[:width]))
        words = words[width:]
    return "\n".join(lines)


def check(spark, rows, templates):
    got = {r.doc_id: r.matches for r in licenses.find(docs(spark, rows), templates).collect()}
    for doc, text in rows:
        want = brute(text, templates)
        runs = {}
        for t in {t.label for t in templates}:
            for width in {w for label, _, w, _ in want if label == t}:
                mine = sorted((s, c) for label, s, w, c in want if label == t and w == width)
                for s, c in mine:
                    last = runs.get((t, width))
                    if last and last[-1][1] == s + width - 1:
                        last[-1] = (last[-1][0], s + width, max(last[-1][2], c))
                    else:
                        runs.setdefault((t, width), []).append((s, s + width, c))
        expected = sorted((t, *run) for (t, _), rs in runs.items() for run in rs)
        assert sorted((m.template, m.first, m.end, m.containment) for m in got[doc]) == expected


def test_random_blocks(spark):
    r = random.Random(1)
    words = "the of a license under mit apache code red blue w x y z".split()
    templates = [Template("a", "under the mit license code", ("mit license",)), Template("b", "a license of the apache code under the red x", ("apache",)), Template("c", " ".join(r.sample(words, 13)))]
    rows = [(i, r.choice([" ", "\n", ", "]).join(r.choice(words) for _ in range(r.randrange(40)))) for i in range(150)] + [(300, None), (301, ""), (302, " \n\n")]
    check(spark, rows, templates)


def test_whole_notices(spark):
    one = {}
    for t in TEMPLATES:  # one template of each label and width: runs of equal width would be told apart by nothing
        one.setdefault((t.label, len(t.words)), t)
    rows = [(i, f"foo {t.text} bar") for i, t in enumerate(TEMPLATES)]
    rows += [(100 + i, "int main;\n" + wrapped(t.text, 7, " * ") + "\nint x;") for i, t in enumerate(TEMPLATES)]
    rows += [(200 + i, wrapped(t.text.replace("the", "teh", 2), 11)) for i, t in enumerate(TEMPLATES)]
    check(spark, rows, list(one.values()))
    report = {r.doc_id: r for r in licenses.report(licenses.find(docs(spark, rows))).collect()}
    for base in (0, 100):
        for i, t in enumerate(TEMPLATES):
            assert t.label in report[base + i].labels.split(","), (base, t.label)
            assert report[base + i].score == 1.0


CASES = {
    "released under the bsd license": "",
    "he was released under the new license law": "",
    "licensed under cc by sa 4.0": "cc-by,cc-by-sa-4.0",
    "licensed under the zend license version 2 0": "",
    "Released under the\nMIT License.": "mit",
    "This work is licensed under the GNU Lesser General Public License, version 3.": "gpl",
}


def test_naming_words(spark):
    rows = list(enumerate(CASES))
    got = {r.doc_id: r.labels for r in licenses.report(licenses.find(docs(spark, rows))).collect()}
    assert got == {i: CASES[text] for i, text in rows}


@pytest.mark.parametrize("n", [81, 120, 1500])
def test_templates_of_many_distinct_words(spark, n):
    notice = " ".join(f"w{i}" for i in range(n))
    table = spark.createDataFrame([("long", notice, ["w3 w4"]), (None, "x", None), ("none", None, None)], "label string, text string, naming array<string>")
    rows = [(1, notice), (2, "x " * 3000 + wrapped(notice, 9, "") + " y" * 50), (3, " ".join(notice.split()[: int(0.79 * n)])), (4, notice.replace("w3 w4", "w4 w3"))]
    got = {r.doc_id: [(m.template, m.containment) for m in r.matches] for r in licenses.find(docs(spark, rows), table).collect()}
    assert got == {1: [("long", 1.0)], 2: [("long", 1.0)], 3: [], 4: []}


def test_base_phrases_and_edges(spark):
    rows = [(200, "all rights reserved. Cc by cc by"), (300, None), (301, ""), (302, " \n\n"), (None, "cc\nby")]
    report = {x.doc_id: x for x in licenses.report(licenses.find(docs(spark, rows))).collect()}
    assert (report[200].n_base, report[200].first_word, report[200].last_word, report[200].base_labels) == (3, 0, 5, "cc-by,reserved")
    assert [(report[i].n_words, report[i].n_base, report[i].first_word, report[i].labels, report[i].score) for i in (300, 301, 302)] == [(0, 0, None, "", 0.0)] * 3
    assert report[None].n_base == 1
    assert licenses.find(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        licenses.find(docs(spark, rows), [Template("x", "some words", ("other words",))])

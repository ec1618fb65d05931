"""Edge rows that every operator has to stand."""

import glob
import re

LONG = ("the quick brown fox jumps over a lazy dog " * 3000).strip()
EDGE = [(1, None), (2, ""), (3, "   \n\n"), (None, "no id here at all"), (4, "same text again"), (4, "same text again"), (5, LONG), (6, "é 漢字 \U0001f600 x"), (7, "same text again")]
HUGE = 2**62 + 12345  # ids of this size must not overflow


def inner_names():
    """Every name in quotes that a module of the operators could use as a column."""
    found = set()
    for path in glob.glob("inkstone/llm/*.py"):
        with open(path) as f:
            found |= set(re.findall(r"\"([a-z_][a-z0-9_]*)\"", f.read()))
    return sorted(found - {"doc_id", "text", "conv_id", "turn", "role", "n_chars"})


def docs(spark, rows, extra=True):
    """Documents, with columns whose names operators use inside."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    if extra:
        for name in ("key", "fp", "n_words", "lines", "found", "spans", "_text", "node", "component"):
            df = df.selectExpr("*", f"'clash' as {name}")
    return df


def crowded(spark, rows, ddl="doc_id bigint, text string"):
    """Documents with a column of every inner name, each with a value of its own."""
    df = spark.createDataFrame(rows, ddl)
    return df.selectExpr("*", *[f"'own {name}' as `{name}`" for name in inner_names()])


def unharmed(df, names):
    """Whether the columns still have their values in every row."""
    return all(r[n] == f"own {n}" for r in df.select(*[f"`{n}`" for n in names]).collect() for n in names)

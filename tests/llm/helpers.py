"""Small tables for the training-data operators' tests."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside for their own columns.
CLASHING = ("tag", "node", "cell", "h", "component", "part", "rank", "n", "words", "length", "base", "score")


def documents(spark, rows):
    """(doc_id, text[, lang]) rows as a documents table."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("x").alias(name) for name in CLASHING if name not in df.columns))


def prose(seed: int, words: int, stock: str = "the of and river stone light paper garden window copper market winter letter bridge") -> str:
    import random

    pick = random.Random(seed)
    names = stock.split()
    return " ".join(f"{pick.choice(names)}{pick.choice(['', 'er', 'ing', 'ly', 's'])}{pick.randrange(60) if pick.random() < 0.3 else ''}" for _ in range(words))

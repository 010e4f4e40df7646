"""The documents' way through language ID, near-duplicate removal, decontamination, masking and packing.

Every stage works on all that the one before it kept, and all but the last give back the
columns of ``documents``:

1. language: a document without any letter, or in which no learned language has half of
   the text, goes; ``lang`` becomes the predicted language.
2. near_duplicates: of each group of documents linked by a shingle similarity of 0.75 or
   more, the one with the smallest id stays.
3. decontaminate: documents that leak a benchmark item go.
4. personal_data: personal data is replaced by its kind; ``n_chars`` follows the text.
5. pack: documents become pieces of sequences of at most 2048 tokens.

Learned stages and components cannot be written in SQL, so there is no ORACLE_SQL; the
pipeline is tested stage by stage against brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import decontaminate, jaccard_join, langmix, packing, pii
from emberline.llm.common import drop_scratch, lean_batches, materialize, table

#: Least share of the predicted language in a document's text.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are answered in place, so that no text is shuffled; columns stay as they are but for ``lang``."""
    lean_batches(spark)
    model = langmix.fit(docs.filter(~langmix.held_out()))
    return langmix.relabel(docs, model, LEAST_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean_batches(spark)
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean_batches(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean_batches(spark)
    return pii.mask_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_duplicates", near_duplicates), ("decontaminate", drop_contaminated),
    ("personal_data", personal_data), ("pack", pack)]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            drop_scratch(spark, before)
    return docs

"""The posting table against plain containment."""

import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import textindex
from emberline.session import scratch_path


@pytest.fixture(scope="module")
def stored(spark):
    pick = random.Random(6)
    rows = [(k, " ".join(pick.choice(["Gujarat", "Surat", "çà", "Ä-b", "a", "ab", "River🔥side", "SECTOR (22.10° N)"]) for _ in range(pick.randrange(5)))) for k in range(300)]
    rows += [(900, None), (901, ""), (902, "ab"), (903, "aaaa" * 4000 + "needle"), (5, "another Gujarat of id 5")]
    df = spark.createDataFrame(rows, "event_id long, words string")
    path = scratch_path(spark, "index")
    textindex.build_index(df, F.col("words"), path)
    return rows, path


@pytest.mark.parametrize("pattern", ["gujarat", "  SURAT ", "t s", "°", "", "ab", "abc", "ver🔥s", "needle", "aaa", "nothing here", "ä-b sector", "gujarat surat gujarat surat"])
def test_same_rows_as_containment(spark, stored, pattern):
    rows, path = stored
    wanted = pattern.strip().lower()
    got = sorted((r["event_id"], r["words"] or "") for r in textindex.search(spark, path, pattern).collect())
    assert got == sorted((i, w or "") for i, w in rows if wanted in (w or "").lower())


def test_only_the_grams_parts_are_read(spark, stored):
    _, path = stored
    plan = textindex.search(spark, path, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_gram_part" in plan.replace("isnotnull(", "").replace("dynamicpruning", "") or "_gram_part#" in plan.split("PartitionFilters")[1]
    assert "dynamicpruning" in plan  # the rows' parts follow from the ids found

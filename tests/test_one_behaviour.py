"""Operators give the same rows on both sides of every size at which their plan changes."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from emberline.operators import ledger, listing, merge, validate
from emberline.operators.quantiles import exact_quantiles
from emberline.operators.ranking import RANGES_ALWAYS, rank_within


def hot_rows(spark):
    """A third of the rows in one group, null keys, ties in all but the last order column."""
    rows = [("hot", k // 3, k) for k in range(60)] + [(None, k // 2, k) for k in range(40)] + [(f"g{k % 20}", 1, k) for k in range(80)]
    return spark.createDataFrame(rows, "g STRING, v LONG, id LONG").repartition(5)


@pytest.mark.parametrize("largest", [0, RANGES_ALWAYS])
def test_ranks_by_window_and_by_ranges(spark, largest):
    got = {(r["g"], r["id"]): (r["rank"], r["size"]) for r in rank_within(hot_rows(spark), ["g"], ["v", "id"], largest=largest).collect()}
    want = {}
    groups = {}
    for r in hot_rows(spark).collect():
        groups.setdefault(r["g"], []).append((r["v"], r["id"]))
    for g, items in groups.items():
        for k, (_, i) in enumerate(sorted(items)):
            want[g, i] = (k + 1, len(items))
    assert got == want


def test_quantiles_have_one_formula_and_keep_null_keys(spark):
    rows = [(g, math.sin(k) * 37.123) for g in ("a", "b", None) for k in range(41 if g == "a" else 12)] + [("a", None), ("c", 10.426), ("c", 10.426)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    asked = {"q10": 0.1, "median": 0.5, "q90": 0.9}
    one, two = ({r["g"]: tuple(r[n] for n in asked) for r in exact_quantiles(df, "v", asked, ["g"], percentile_limit=limit).collect()} for limit in (10 ** 6, 0))
    assert one == two and set(one) == {"a", "b", "c", None}
    assert one["a"][1] == statistics.median(v for g, v in rows if g == "a" and v is not None) and one["c"] == (10.426,) * 3


def test_roots_depend_on_every_leaf_and_on_their_number(spark):
    def roots(sizes, change=None, fan_out=3):
        rows = [(k, n + 1, f"{k}-{n}" if (k, n) != change else "x") for k, size in sizes.items() for n in range(size)]
        return {r["k"]: (r["root"], r["leaves"]) for r in ledger.tree_digest(spark.createDataFrame(rows, "k LONG, rank LONG, digest STRING"), "k", fan_out=fan_out).collect()}

    base = roots({1: 100, 2: 1, 3: 4})
    assert [base[k][1] for k in (1, 2, 3)] == [100, 1, 4]
    assert roots({2: 1, 3: 4}) == {k: base[k] for k in (2, 3)}  # other keys' sizes do not matter
    for late in (0, 50, 99):
        assert roots({1: 100}, (1, late))[1] != base[1]
    assert roots({1: 99})[1] != base[1]


def receipts(spark, n, second=0):
    rows = [(1, k, f"EV-{k:05d}", f"{k:064x}", f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}") for k in range(n)]
    packages = spark.createDataFrame(rows, "ledger_key LONG, event_id LONG, evidence_id STRING, sha256 STRING, at STRING").select(
        "*", F.col("at").cast("timestamp").alias("anchored_at")).drop("at")
    if not second:
        return ledger.ledger_append(packages)
    first = ledger.ledger_append(packages.filter(F.col("event_id") < second))
    return first.unionByName(ledger.ledger_append(packages, first))


def test_chain_runs_over_block_borders_and_shows_every_change(spark, monkeypatch):
    monkeypatch.setattr(ledger, "BLOCK", 8)
    rows = receipts(spark, 30).orderBy("sequence").collect()
    for split in (5, 8, 20, 30):
        assert receipts(spark, 30, split).orderBy("sequence").collect() == rows
    schema = receipts(spark, 1).schema

    def valid(changed):
        df = spark.createDataFrame(changed, schema)
        return ledger.ledger_verify(df, heads).first()["valid"]

    heads = spark.createDataFrame(
        ledger.ledger_heads(spark.createDataFrame(rows, schema)).collect(), "ledger_key LONG, receipt_count LONG, root STRING")
    assert valid(rows)
    edited = [r if r["sequence"] != 10 else type(r)(**{**r.asDict(), "evidence_sha256": "f" * 64}) for r in rows]
    swapped = [r if r["sequence"] not in (3, 4) else type(r)(**{**r.asDict(), "sequence": 7 - r["sequence"]}) for r in rows]
    assert not valid(edited) and not valid(swapped) and not valid(rows[:-1]) and not valid(rows[1:]) and not valid(rows[:12] + rows[13:])
    # a whole block made anew with correct links inside it
    forged = spark.createDataFrame([r for r in rows if r["sequence"] <= 8], schema)
    other = ledger.ledger_append(spark.createDataFrame([(1, 900 + k, f"EV-9{k}", "e" * 64) for k in range(8)], "ledger_key LONG, event_id LONG, evidence_id STRING, sha256 STRING").withColumn(
        "anchored_at", F.lit("2024-01-01 00:00:09").cast("timestamp")), forged).collect()
    assert [r["sequence"] for r in other] == list(range(9, 17))
    mixed = [r for r in rows if not 9 <= r["sequence"] <= 16] + other
    broken = ledger.ledger_verify(spark.createDataFrame(mixed, schema), heads).first()
    assert not broken["valid"] and broken["broken"] >= 1


def test_long_ledger_verifies(spark):
    rows = receipts(spark, 800)
    assert ledger.ledger_verify(rows, ledger.ledger_heads(rows)).first()["valid"]


def test_every_event_is_ranked(spark):
    rows = [(k, float(k % 7), f"2024-01-{1 + k % 9:02d}") for k in range(1200)]
    df = spark.createDataFrame(rows, "event_id LONG, risk_score DOUBLE, d STRING").select("event_id", "risk_score", F.col("d").cast("timestamp").alias("end_time"))
    got = [r["event_id"] for r in listing.ranked_events(df).orderBy("position").collect()]
    assert got == [r["event_id"] for r in listing.rank_events(df).collect()] and len(got) == 1200


def test_unknown_sensor_is_a_known_detection(spark):
    schema = "event_id LONG, source STRING, timestamp STRING, latitude DOUBLE, longitude DOUBLE, sensor STRING"
    stored = spark.createDataFrame([(77, "S", "t", 1.0, 2.0, None)], schema)
    merged = merge.merge_capture_into_events(spark.createDataFrame([(5, "S", "t", 1.0, 2.0, None)], schema), stored).first()
    assert (merged["outcome"], merged["stored_id"]) == ("adopted", 77)


def test_header_case_does_not_lose_measurements(spark):
    raw = spark.createDataFrame([(0, "25", "75", "2024-01-01", "0100", "330", "5.5", "S"), (1, "25", "76", "2024-01-01", "0100", "330", "-1", "S")],
                                "line_no LONG, Latitude STRING, longitude STRING, ACQ_DATE STRING, acq_time STRING, bright_ti4 STRING, FRP STRING, source STRING")
    got = {r["line_no"]: (r["reason"], r["p_frp_value"]) for r in validate.validate_rows(raw).collect()}
    assert got[0] == (None, 5.5) and got[1][0] == "INVALID_FRP"

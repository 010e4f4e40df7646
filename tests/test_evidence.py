"""Evidence packages bind every field; tampered ones are refused."""

import datetime
from functools import reduce

import pytest
from pyspark.sql import functions as F

from emberline.operators import ledger
from emberline.operators.events import event_table, persistence_metrics
from emberline.operators.features import extract_features
from emberline.operators.cluster import summarize_events
from emberline.operators.scoring import assess_risk
from emberline.session import cut_lineage

ROW = "obs_id long, event_id long, timestamp timestamp, latitude double, longitude double, intensity double, confidence double, confidence_category string, source string, sensor string, " \
      "frp double, scan double, track double, bright_ti5 double, bright_t31 double, daynight string"


def rows(spark, count=3):
    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    return spark.createDataFrame([(k, k // 3, at + datetime.timedelta(hours=5 * k), 25.0 + k * 1e-3, 75.0, 300.0 + k, None, 'h"\\', "VIIRS", None, 1.5, 0.4, None, 290.0, None, "D") for k in range(count)], ROW)


def packaged(linked, weak=None):
    metrics = persistence_metrics(linked)
    return ledger.evidence_packages(event_table(metrics, summarize_events(linked)), assess_risk(metrics), linked, extract_features(linked, metrics), weak)


def test_every_field_of_a_member_counts(spark):
    changed = {"timestamp": F.col("timestamp") + F.expr("INTERVAL 1 SECOND"), "confidence_category": F.lit("h"), "source": F.lit("MODIS"), "sensor": F.lit("N20"), "daynight": F.lit(None).cast("string")}
    names = ("timestamp", "latitude", "longitude", "intensity", "confidence", "confidence_category", "source", "sensor", "frp", "scan", "track", "bright_ti5", "bright_t31", "daynight")
    linked = rows(spark)
    # the same three rows as many events, each with one field of one row changed
    several = linked.withColumn("event_id", F.lit(100).cast("long")).unionByName(linked.orderBy(F.desc("obs_id")).repartition(3).withColumn("event_id", F.lit(101).cast("long")))
    for k, name in enumerate(names):
        other = changed.get(name, F.coalesce(F.col(name), F.lit(0.0)) + 0.01)
        several = several.unionByName(linked.withColumn(name, F.when(F.col("obs_id") == 1, other).otherwise(F.col(name))).withColumn("event_id", F.lit(k).cast("long")))
    roots = {r["event_id"]: r["root"] for r in ledger.members_root(several).collect()}
    assert roots[100] == roots[101] and len(set(roots.values())) == len(names) + 1


def test_every_field_of_a_package_counts(spark):
    weak = spark.createDataFrame([(0, "single_day_observed", 0.25)], "event_id long, weak_prediction string, weak_score double")
    package = cut_lineage(packaged(rows(spark), weak))
    digest = F.sha2(ledger.payload_text(), 256)
    assert package.select((digest == F.col("sha256")) & (ledger.evidence_id(digest) == F.col("evidence_id"))).first()[0]
    variants = [package]
    for name in package.columns:
        kind = package.schema[name].dataType.simpleString()
        if name in ("sha256", "evidence_id", "factors", "features", "probabilities"):
            continue
        variants.append(package.withColumn(name, {"string": F.concat(F.coalesce(name, F.lit("")), F.lit("x")), "timestamp": F.col(name) + F.expr("INTERVAL 1 SECOND")}.get(
            kind, (F.coalesce(F.col(name), F.lit(0)) + 1).cast(kind))))
    for name in ledger.PACKAGE_FEATURES:
        variants.append(package.withColumn("features", F.col("features").withField(name, F.coalesce(F.col(f"features.{name}"), F.lit(0.0)) + 1.0)))
    variants.append(package.withColumn("features", F.lit(None).cast(package.schema["features"].dataType)))
    variants.append(package.withColumn("factors", F.slice("factors", 1, 4)))
    variants.append(package.withColumn("probabilities", F.transform_values("probabilities", lambda k, v: F.when(k == "OTHER", 0.9).otherwise(v))))
    # a null and a missing neighbour do not look alike
    variants.append(package.withColumn("severity", F.lit(None).cast("string")).withColumn("explanation", F.lit("LOW")))
    variants.append(package.withColumn("severity", F.lit("LOW")).withColumn("explanation", F.lit(None).cast("string")))
    every = reduce(lambda a, b: a.unionAll(b), [v.select(digest.alias("d")) for v in variants])
    assert len({r["d"] for r in every.collect()}) == len(variants)


def test_tampered_packages_and_ledgers_are_refused(spark):
    packages = packaged(rows(spark, 12)).withColumn("ledger_key", F.col("event_id") % 2).withColumn("anchored_at", F.col("end_time"))
    first = ledger.append_packages(packages.filter("event_id < 2"))
    heads = ledger.ledger_heads(first)
    assert ledger.append_packages(packages, first, heads).count() == 2
    tampered = packages.withColumn("risk_score", F.when(F.col("event_id") == 3, 99.0).otherwise(F.col("risk_score")))
    with pytest.raises(ValueError, match="CONTENT_DIGEST_MISMATCH: 1 packages, first of event 3"):
        ledger.append_packages(tampered, first, heads)
    renamed = packages.withColumn("evidence_id", F.when(F.col("event_id") == 2, F.lit("EV-0")).otherwise(F.col("evidence_id")))
    with pytest.raises(ValueError, match="event 2"):
        ledger.append_packages(renamed)
    with pytest.raises(ValueError, match="LEDGER_INVALID"):
        ledger.append_packages(packages, first.filter("event_id <> 0"), heads)


def test_refusals_write_out_the_content_once(spark):
    """The digest of a package is the dear part; its evidence id follows from the stored digest."""
    names = {"event_id": "long", "ledger_key": "long", "evidence_id": "string", "sha256": "string", "status": "string", "latitude": "double", "longitude": "double", "start_time": "timestamp",
             "end_time": "timestamp", "anchored_at": "timestamp", "leaves": "long", "root": "string", "active_days": "long", "persistence_score": "double", "trend": "string", "average_intensity": "double",
             "intensity_variance": "double", "spatial_stability": "double", "features": f"struct<{','.join(n + ':double' for n in ledger.PACKAGE_FEATURES)}>", "risk_score": "double", "severity": "string",
             "explanation": "string", "factors": "array<struct<factor:string,score:double,weight:double>>", "classification": "string", "class_confidence": "double", "probabilities": "map<string,double>",
             "model_status": "string", "model_version": "string", "weak_prediction": "string", "weak_score": "double"}
    packages = spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in names.items()))
    receipts = ledger.ledger_append(packages)
    refused = ledger.refusals(packages, receipts, ledger.ledger_heads(receipts)).filter("reason = 'CONTENT_DIGEST_MISMATCH'")
    plan = refused._jdf.queryExecution().analyzed().toString()
    assert sum(line.count(ledger.SCHEMA_VERSION) for line in plan.splitlines()) == 1

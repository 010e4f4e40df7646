"""Evidence digests of events and verifiable receipt chains, on tables.

Nothing here gathers a group of unbounded size: members are digested through a
tree of fixed fan-out, and receipts are chained in blocks of fixed length whose
tails again form a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import config
from emberline.operators.features import FEATURES
from emberline.operators.ranking import rank_within

# Fixed value: genesis link.
EVIDENCE_PREFIX = "EV-"
GENESIS = "0" * 64
SCHEMA_VERSION = "evidence-v3"
FAN_OUT = 4096
BLOCK = 256


def _iso(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def _decimal(value: Column, digits: int = 6) -> Column:
    # the format of a null is cut to the digits, so it is not asked for
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value)).otherwise(F.lit("null"))


def _quoted(value: Column) -> Column:
    """A JSON string, or null."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def _whole(value: Column) -> Column:
    return F.coalesce(value.cast("long").cast("string"), F.lit("null"))


def _object(fields: dict[str, Column]) -> Column:
    """A JSON object with its keys in order; every field is there, unknown ones as null."""
    parts = [part for name in sorted(fields) for part in (F.lit(f',"{name}":'), fields[name])]
    return F.concat(F.lit("{"), F.substring(F.concat(*parts), 2, 2**31 - 1), F.lit("}"))


def observation_fingerprint() -> Column:
    """SHA-256 of the identity of a detection: canonical JSON with sorted keys."""
    text = F.concat(F.lit('{"latitude":'), _decimal(F.col("latitude")), F.lit(',"longitude":'), _decimal(F.col("longitude")),
                    F.lit(',"sensor":"'), F.coalesce("sensor", F.lit("null")), F.lit('","source":"'), F.col("source"),
                    F.lit('","timestamp":"'), _iso(F.col("timestamp")), F.lit('"}'))
    return F.sha2(text, 256)


MEMBER_NUMBERS = ("intensity", "confidence", "frp", "scan", "track", "bright_ti5", "bright_t31")
MEMBER_TEXTS = ("confidence_category", "daynight")


def member_digest() -> Column:
    """SHA-256 over the identity of a detection and every field that was measured; unknown ones count as null."""
    return F.sha2(_object({"source_observation_id": _quoted(observation_fingerprint()), **{n: _decimal(F.col(n)) for n in MEMBER_NUMBERS},
                           **{n: _quoted(F.col(n)) for n in MEMBER_TEXTS}}), 256)


def tree_digest(ranked: DataFrame, key: str, digest: str = "digest", fan_out: int = FAN_OUT) -> DataFrame:
    """(key, root, leaves) of the ordered digests of each key; needs ``rank`` from 1.

    Each level joins ``fan_out`` neighbours until every key has one node left; a key that
    is down to one is not hashed again, so its root depends on nothing but its own leaves.
    The root binds the number of leaves.
    """
    if fan_out < 2:
        raise ValueError("fan_out must be at least 2")
    level = ranked.select(key, (F.col("rank") - 1).alias("place"), F.col(digest).alias("hash"), F.lit(1).cast("long").alias("leaves"))
    widest = ranked.agg(F.max("rank")).first()[0] or 0
    first = True
    while first or widest > 1:
        block = F.floor(F.col("place") / F.lit(fan_out)).cast("long")
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"])
        joined = F.sha2(F.array_join(ordered, ""), 256)
        alone = (F.size(ordered) == 1) & (F.col("block") == 0)
        level = (level.groupBy(key, block.alias("block"))
                 .agg((joined if first else F.when(alone, F.element_at(ordered, 1)).otherwise(joined)).alias("hash"), F.sum("leaves").alias("leaves"))
                 .withColumnRenamed("block", "place"))
        widest = -(-widest // fan_out)
        first = False
    return level.select(key, F.sha2(F.concat_ws("|", F.col("leaves").cast("string"), "hash"), 256).alias("root"), "leaves")


def members_root(linked: DataFrame) -> DataFrame:
    """Root over the members of each event in (time, place, digest) order."""
    hashed = linked.select("event_id", "timestamp", "latitude", "longitude", member_digest().alias("digest"))
    ranked = rank_within(hashed, ["event_id"], ["timestamp", "latitude", "longitude", "digest"])
    return tree_digest(ranked, "event_id")


#: Features that a package leaves out: they depend on other tables than the event's own rows.
CONTEXT_FEATURES = ("historical_activity", "facility_distance_km")
PACKAGE_FEATURES = tuple(n for n in FEATURES if n not in CONTEXT_FEATURES)


def payload_text() -> Column:
    """Canonical JSON of an evidence package; independent of the order of the members.

    It holds the event, its persistence metrics, features, risk with factors and
    explanation, class with probabilities and model, and the root over the members.
    """
    factor = F.transform("factors", lambda f: _object({"factor": _quoted(f["factor"]), "score": _decimal(f["score"], 1), "weight": _decimal(f["weight"], 1)}))
    chances = {name: _decimal(F.col("probabilities")[name]) for name in config.RULE_CLASSES}
    return _object({
        "schema_version": _quoted(F.lit(SCHEMA_VERSION)), "event_id": _whole(F.col("event_id")), "status": _quoted(F.col("status")),
        "centroid": _object({"latitude": _decimal(F.col("latitude")), "longitude": _decimal(F.col("longitude"))}),
        "start_time": _quoted(_iso(F.col("start_time"))), "end_time": _quoted(_iso(F.col("end_time"))),
        "members": _object({"count": _whole(F.col("leaves")), "root": _quoted(F.col("root"))}),
        "persistence": _object({"active_days": _whole(F.col("active_days")), "persistence_score": _decimal(F.col("persistence_score"), 2), "trend": _quoted(F.col("trend")),
                                "average_intensity": _decimal(F.col("average_intensity"), 2), "intensity_variance": _decimal(F.col("intensity_variance"), 2),
                                "spatial_stability": _decimal(F.col("spatial_stability"), 8)}),
        "features": _object({n: _decimal(F.col("features")[n], 8 if n == "spatial_stability" else 6) for n in PACKAGE_FEATURES}),
        "risk": _object({"score": _decimal(F.col("risk_score"), 1), "severity": _quoted(F.col("severity")), "explanation": _quoted(F.col("explanation")),
                         "factors": F.coalesce(F.concat(F.lit("["), F.array_join(factor, ","), F.lit("]")), F.lit("null"))}),
        "classification": _object({"classification": _quoted(F.col("classification")), "confidence": _decimal(F.col("class_confidence")),
                                   "probabilities": _object(chances), "model_status": _quoted(F.col("model_status")), "model_version": _quoted(F.col("model_version"))}),
        "weak_classification": F.when(F.col("weak_prediction").isNull(), F.lit('{"status":"UNAVAILABLE"}')).otherwise(
            _object({"prediction": _quoted(F.col("weak_prediction")), "score": _decimal(F.col("weak_score"))}))})


def evidence_packages(events: DataFrame, risk: DataFrame, linked: DataFrame, features: DataFrame, weak: DataFrame | None = None,
                      model_status: str = "RULES_ONLY", model_version: str | None = None) -> DataFrame:
    """One package per event: its fields, the members' root, digest and evidence id.

    ``risk`` holds the metrics with class, factors and explanation; ``features`` a row of
    doubles per event, rounded as they are to be bound; ``weak`` may bring
    (event_id, weak_prediction, weak_score).
    """
    assessed = risk.select("event_id", "risk_score", "severity", "classification", "factors", "explanation", "probabilities", "class_confidence",
                           "intensity_variance", "spatial_stability")
    vector = features.select("event_id", F.struct(*PACKAGE_FEATURES).alias("features"))
    # only what the digest binds
    own = events.select("event_id", "latitude", "longitude", "start_time", "end_time", "status", "active_days", "persistence_score", "trend", "average_intensity")
    joined = own.join(assessed, "event_id").join(members_root(linked), "event_id").join(vector, "event_id", "left")
    if weak is None:
        joined = joined.withColumn("weak_prediction", F.lit(None).cast("string")).withColumn("weak_score", F.lit(None).cast("double"))
    else:
        joined = joined.join(weak.select("event_id", "weak_prediction", "weak_score"), "event_id", "left")
    named = joined.withColumn("model_status", F.lit(model_status)).withColumn("model_version", F.lit(model_version).cast("string"))
    digested = named.withColumn("sha256", F.sha2(payload_text(), 256))
    return digested.withColumn("evidence_id", evidence_id(F.col("sha256")))


def evidence_id(digest: Column) -> Column:
    return F.concat(F.lit(EVIDENCE_PREFIX), F.upper(F.substring(digest, 1, 16)))


def verify_evidence(packages: DataFrame, receipts: DataFrame) -> DataFrame:
    """Does the content match its digest, and the digest the event's latest receipt?"""
    latest = receipts.groupBy("event_id").agg(F.max_by("evidence_sha256", "sequence").alias("anchored"))
    content = F.sha2(payload_text(), 256) == F.col("sha256")
    return packages.join(latest, "event_id", "left").select(
        "event_id", "evidence_id", content.alias("content_valid"), F.col("anchored").isNotNull().alias("anchor_present"),
        (content & F.coalesce(F.col("anchored") == F.col("sha256"), F.lit(False))).alias("anchor_valid"))


def _receipt_hash(sequence: Column, event_id: Column, evidence: Column, digest: Column, previous: Column, at: Column) -> Column:
    return F.sha2(F.concat_ws("|", sequence.cast("string"), event_id.cast("string"), evidence, digest, previous, _iso(at)), 256)


def receipt_hash() -> Column:
    return _receipt_hash(*(F.col(c) for c in ("sequence", "event_id", "evidence_id", "evidence_sha256", "previous_sha256", "anchored_at")))


def block_start(key: Column, block: Column, before: Column) -> Column:
    """Link of the first receipt of a block: bound to the content of the block before; genesis for the first."""
    return F.when(block == 0, F.lit(GENESIS)).otherwise(F.sha2(F.concat_ws("|", key.cast("string"), F.lit("block"), block.cast("string"), before), 256))


def _block_of(sequence: Column) -> Column:
    return F.floor((sequence - 1) / F.lit(BLOCK)).cast("long")


def _content(x: Column) -> Column:
    return F.sha2(F.concat_ws("|", x["sequence"].cast("string"), x["event_id"].cast("string"), x["evidence_id"], x["evidence_sha256"], _iso(x["anchored_at"])), 256)


def block_roots(receipts: DataFrame, key: str = "ledger_key") -> DataFrame:
    """(key, block, root): digest of the content of a block's receipts, in order (at most BLOCK of them)."""
    item = F.struct("sequence", "event_id", "evidence_id", "evidence_sha256", "anchored_at")
    return (receipts.withColumn("block", _block_of(F.col("sequence"))).groupBy(key, "block")
            .agg(F.array_sort(F.collect_list(item)).alias("items"))
            .select(key, "block", F.sha2(F.array_join(F.transform("items", _content), ""), 256).alias("root")))


def ledger_append(packages: DataFrame, receipts: DataFrame | None = None, key: str = "ledger_key") -> DataFrame:
    """Receipts for packages not yet in the ledger, chained behind the known ones.

    ``packages`` has key, event_id, evidence_id, sha256, anchored_at. Appending the
    same package again gives nothing. Blocks are hashed side by side; the first link of a
    block is bound to the content of the block before, so no block can be replaced alone.
    """
    once = packages.groupBy(key, "evidence_id").agg(
        F.min_by(F.struct("event_id", "sha256", "anchored_at"), F.struct("anchored_at", "event_id")).alias("p")).select(
        key, "evidence_id", "p.event_id", F.col("p.sha256").alias("evidence_sha256"), "p.anchored_at")
    content = [key, "sequence", "event_id", "evidence_id", "evidence_sha256", "anchored_at"]
    if receipts is None:
        ranked = rank_within(once, [key], ["anchored_at", "evidence_id"])
        numbered = ranked.select("*", F.col("rank").alias("sequence"), F.lit(0).cast("long").alias("known"), F.lit(None).cast("string").alias("tail"))
        roots = block_roots(numbered.select(*content), key)
    else:
        fresh = once.join(receipts.select(key, "evidence_id"), [key, "evidence_id"], "left_anti")
        tails = receipts.groupBy(key).agg(F.max("sequence").alias("known"), F.max_by("chain_sha256", "sequence").alias("tail"))
        ranked = rank_within(fresh, [key], ["anchored_at", "evidence_id"]).join(tails, key, "left")
        numbered = ranked.withColumn("known", F.coalesce("known", F.lit(0))).withColumn("sequence", F.col("known") + F.col("rank"))
        last = receipts.join(tails.select(key, "known"), key).filter(_block_of(F.col("sequence")) == _block_of(F.col("known")))
        roots = block_roots(last.select(*content).unionByName(numbered.select(*content)), key)
    before = roots.select(key, (F.col("block") + 1).alias("block"), F.col("root").alias("before"))
    item = F.struct("sequence", "event_id", "evidence_id", "evidence_sha256", "anchored_at")
    blocks = (numbered.withColumn("block", _block_of(F.col("sequence")))
              .groupBy(key, "block").agg(F.array_sort(F.collect_list(item)).alias("items"),  # at most BLOCK items
                                         F.first("known").alias("known"), F.first("tail").alias("tail"))
              .join(before, [key, "block"], "left"))
    continues = (F.col("known") % BLOCK != 0) & (F.floor(F.col("known") / F.lit(BLOCK)) == F.col("block"))
    start = F.when(continues, F.col("tail")).otherwise(block_start(F.col(key), F.col("block"), F.col("before")))
    blocks = blocks.withColumn("start", start)

    def step(acc: Column, x: Column) -> Column:
        linked = _receipt_hash(x["sequence"], x["event_id"], x["evidence_id"], x["evidence_sha256"], acc["link"], x["anchored_at"])
        return F.struct(linked.alias("link"), F.concat(acc["links"], F.array(acc["link"])).alias("links"))

    empty = F.struct(F.col("start").alias("link"), F.array().cast("array<string>").alias("links"))
    links = F.aggregate("items", empty, step, lambda acc: acc["links"])
    rows = blocks.select(key, F.explode(F.arrays_zip(F.col("items").alias("item"), links.alias("previous"))).alias("r"))
    return rows.select(
        key, "r.item.sequence", "r.item.event_id", "r.item.evidence_id", "r.item.evidence_sha256",
        F.col("r.previous").alias("previous_sha256"), "r.item.anchored_at").withColumn("chain_sha256", receipt_hash())


def refusals(packages: DataFrame, receipts: DataFrame, heads: DataFrame, key: str = "ledger_key") -> DataFrame:
    """(key, event_id, reason): packages that must not be appended; a package may have both reasons.

    CONTENT_DIGEST_MISMATCH: the content gives another digest or evidence id than the package
    says. LEDGER_INVALID: the ledger that it would go to does not verify.
    """
    # the content is written out once: equal digests have equal evidence ids
    whole = F.coalesce((F.sha2(payload_text(), 256) == F.col("sha256")) & (evidence_id(F.col("sha256")) == F.col("evidence_id")), F.lit(False))
    altered = packages.filter(~whole).select(key, "event_id", F.lit("CONTENT_DIGEST_MISMATCH").alias("reason"))
    broken = ledger_verify(receipts, heads, key).filter("NOT valid").select(key)  # one row a ledger
    return altered.unionAll(packages.join(broken, key, "left_semi").select(key, "event_id", F.lit("LEDGER_INVALID").alias("reason")))


def append_packages(packages: DataFrame, receipts: DataFrame | None = None, heads: DataFrame | None = None, key: str = "ledger_key") -> DataFrame:
    """Receipts for whole packages (with ``key`` and ``anchored_at``), refused as a whole if one package or its ledger does not verify."""
    if receipts is None:
        receipts_known, heads_known = ledger_append(packages.limit(0), None, key), None
    else:
        receipts_known, heads_known = receipts, heads
    refused = refusals(packages, receipts_known, ledger_heads(receipts_known, key) if heads_known is None else heads_known, key).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("event_id")).collect()  # at most two rows
    if refused:
        raise ValueError("; ".join(f"{r['reason']}: {r['n']} packages, first of event {r['event_id']}" for r in refused))
    return ledger_append(packages.select(key, "event_id", "evidence_id", "sha256", "anchored_at"), receipts, key)


def ledger_heads(receipts: DataFrame, key: str = "ledger_key") -> DataFrame:
    """Checkpoint per ledger: number of receipts and the root over its block tails."""
    tails = receipts.groupBy(key, F.floor((F.col("sequence") - 1) / F.lit(BLOCK)).cast("long").alias("block")).agg(
        F.max_by("chain_sha256", "sequence").alias("digest"), F.count(F.lit(1)).alias("n"))
    roots = tree_digest(tails.withColumn("rank", F.col("block") + 1), key).select(key, "root")
    return tails.groupBy(key).agg(F.sum("n").alias("receipt_count")).join(roots, key)


def ledger_verify(receipts: DataFrame, heads: DataFrame, key: str = "ledger_key") -> DataFrame:
    """(key, valid, receipt_count, broken): edits, deletions, truncation and reordering show.

    Links are checked by an equi-join on (ledger, sequence), so a ledger of any
    length is verified in parallel.
    """
    before = receipts.select(key, (F.col("sequence") + 1).alias("sequence"), F.col("chain_sha256").alias("expected")).distinct()
    at_start = (F.col("sequence") - 1) % BLOCK == 0
    roots = block_roots(receipts, key).select(key, (F.col("block") + 1).alias("block"), F.col("root").alias("before"))
    joined = receipts.join(before, [key, "sequence"], "left").withColumn("block", _block_of(F.col("sequence"))).join(roots, [key, "block"], "left")
    link = F.when(at_start, block_start(F.col(key), F.col("block"), F.col("before"))).otherwise(F.col("expected"))
    good = (F.col("chain_sha256") == receipt_hash()) & F.coalesce(F.col("previous_sha256") == link, F.lit(False))
    rows = joined.groupBy(key).agg(
        F.count(F.lit(1)).alias("receipt_count"), F.min("sequence").alias("low"), F.max("sequence").alias("high"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("broken"))
    found = ledger_heads(receipts, key).select(key, F.col("root").alias("found_root"))
    kept = heads.select(key, F.col("receipt_count").alias("head_count"), F.col("root").alias("head_root"))
    all_keys = kept.join(rows, key, "full").join(found, key, "left")
    whole = ((F.col("low") == 1) & (F.col("high") == F.col("receipt_count")) & (F.col("broken") == 0)
             & (F.col("head_count") == F.col("receipt_count")) & (F.col("head_root") == F.col("found_root")))
    return all_keys.select(key, F.coalesce(whole, F.lit(False)).alias("valid"), F.coalesce("receipt_count", F.lit(0)).alias("receipt_count"),
                           F.coalesce("broken", F.lit(0)).alias("broken"))


def anchor_registry(submissions: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """First write per digest wins; empty digests are refused.

    ``submissions``: sha256, submitter, anchored_at.
    """
    usable = submissions.filter((F.col("sha256") != "") & (F.col("sha256") != GENESIS))
    first = usable.groupBy("sha256").agg(
        F.min_by(F.struct("submitter", "anchored_at"), F.struct("anchored_at", "submitter")).alias("w")).select(
        "sha256", "w.submitter", "w.anchored_at")
    if registry is None:
        return first
    return registry.unionByName(first.join(registry.select("sha256"), "sha256", "left_anti"))

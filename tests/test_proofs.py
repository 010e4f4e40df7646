"""Inclusion and extension proofs against a recursive tree."""

import hashlib

from pyspark.sql import functions as F

from emberline.operators import proofs


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def root_of(leaves):
    if len(leaves) == 1:
        return leaves[0]
    cut = 1
    while cut * 2 < len(leaves):
        cut *= 2
    return sha("1" + root_of(leaves[:cut]) + root_of(leaves[cut:]))


SIZES = {1: 1, 2: 2, 3: 3, 4: 7, 5: 8, 6: 13, 7: 33}


def ledger(spark, sizes, seed=""):
    rows = [(key, k + 1, sha(f"{seed}{key}-{k}")) for key, n in sizes.items() for k in range(n)]
    return spark.createDataFrame(rows, "ledger_key long, sequence long, chain_sha256 string")


def test_roots_and_inclusion(spark):
    receipts = ledger(spark, SIZES)
    nodes = proofs.tree_nodes(receipts)
    heads = proofs.tree_heads(nodes)
    assert {r["ledger_key"]: (r["size"], r["root"]) for r in heads.collect()} == {
        key: (n, root_of([sha("0" + sha(f"{key}-{k}")) for k in range(n)])) for key, n in SIZES.items()}
    given = proofs.inclusion_proofs(nodes, receipts)
    good = proofs.verify_inclusion(receipts, given, heads).collect()
    assert len(good) == sum(SIZES.values()) and all(r["valid"] for r in good)
    assert max(r["siblings"] for r in good) <= 6

    def invalid(changed_receipts=receipts, changed_proofs=given, changed_heads=heads):
        return {(r["ledger_key"], r["sequence"]) for r in proofs.verify_inclusion(changed_receipts, changed_proofs, changed_heads).collect() if not r["valid"]}

    assert invalid(receipts.withColumn("chain_sha256", F.when(F.col("sequence") == 3, F.lit("f" * 64)).otherwise(F.col("chain_sha256")))) == {(k, 3) for k, n in SIZES.items() if n >= 3}
    assert (7, 4) in invalid(changed_proofs=given.filter("NOT (sequence = 4 AND level = 1)"))
    assert (7, 4) in invalid(changed_proofs=given.withColumn("on_left", F.when((F.col("sequence") == 4) & (F.col("level") == 0), F.lit(False)).otherwise(F.col("on_left"))))
    assert invalid(changed_heads=heads.withColumn("size", F.col("size") + 1)) >= {(k, n) for k, n in SIZES.items()}


def test_extension_of_every_length(spark):
    new = {k: 13 for k in range(1, 14)}
    old = {k: k for k in new}
    grown, before = ledger(spark, new), ledger(spark, old)
    nodes = proofs.tree_nodes(grown)
    old_heads, new_heads = proofs.tree_heads(proofs.tree_nodes(before)), proofs.tree_heads(nodes)
    given = proofs.extension_proofs(nodes, old_heads)
    assert given.groupBy("ledger_key").count().agg(F.max("count")).first()[0] <= 8
    assert all(r["valid"] for r in proofs.verify_extension(given, old_heads, new_heads).collect())
    # a ledger rewritten after the first checkpoint, a shorter one, and a proof with a part missing
    rewritten = proofs.tree_nodes(ledger(spark, new, "other"))
    assert not any(r["valid"] for r in proofs.verify_extension(proofs.extension_proofs(rewritten, old_heads), old_heads, proofs.tree_heads(rewritten)).collect())
    shorter = proofs.tree_nodes(ledger(spark, {k: max(k - 1, 1) for k in new}))
    found = {r["ledger_key"]: r["valid"] for r in proofs.verify_extension(proofs.extension_proofs(shorter, old_heads), old_heads, proofs.tree_heads(shorter)).collect()}
    assert found == {k: k == 1 for k in new}
    partial = proofs.verify_extension(given.filter("NOT (old AND place = 0)"), old_heads, new_heads).collect()
    assert not any(r["valid"] for r in partial)


def test_one_receipt_reads_few_rows(spark):
    nodes = proofs.tree_nodes(ledger(spark, {1: 500, 2: 3}))
    one = spark.createDataFrame([(1, 77)], "ledger_key long, sequence long")
    assert proofs.inclusion_proofs(nodes, one).count() <= 9

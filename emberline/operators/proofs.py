"""Inclusion and extension proofs over receipt ledgers, from stored tree nodes.

The receipts of a ledger, in order, are the leaves of a binary hash tree: neighbours are
joined level by level, and a last node without a neighbour goes up unchanged. Leaves and
inner nodes are hashed with different first bytes, so none can stand for the other. The
nodes are a table sorted by (ledger, level, place); whoever wants to check one receipt
reads about log2(n) of its rows, whatever the ledger's length.

* An inclusion proof is the siblings on a receipt's way to the root.
* An extension proof between two checkpoints is the whole subtrees that cover the old
  ledger, which give the old root, and those that cover what was added, which together
  give the new one. It shows that the old receipts are all there, unchanged and in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.session import discard, materialize

#: Trees of up to 2 ** MOST_LEVELS receipts.
MOST_LEVELS = 62


def leaf_hash(chain: Column) -> Column:
    return F.sha2(F.concat(F.lit("0"), chain), 256)


def node_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.lit("1"), left, right), 256)


def _levels(largest: int) -> int:
    return max(largest - 1, 0).bit_length()


def _lifted(level_nodes: DataFrame, level: int, key: str) -> DataFrame:
    """Nodes of the next level; ``size`` is the ledger's number of receipts.

    The root of a smaller ledger stays as it is. A node without its left part is not formed.
    """
    width = F.ceil(F.col("size") / F.lit(1 << level)).cast("long")
    done = F.col("size") <= (1 << level)
    left, right = (F.max(F.when(F.col("place") % 2 == k, F.col("hash"))) for k in (0, 1))
    pairs = level_nodes.groupBy(key, "size", F.shiftright("place", 1).alias("up")).agg(left.alias("left"), right.alias("right"))
    alone = F.col("right").isNull() & (2 * F.col("up") + 1 >= width)
    joined = F.when(done, F.when(F.col("right").isNull(), F.col("left"))).when(
        F.col("right").isNotNull() & F.col("left").isNotNull(), node_hash(F.col("left"), F.col("right"))).when(alone, F.col("left"))
    return pairs.select(key, "size", F.col("up").alias("place"), joined.alias("hash")).filter("hash IS NOT NULL")


def tree_nodes(receipts: DataFrame, key: str = "ledger_key") -> DataFrame:
    """(key, size, level, place, hash): every node of every ledger's tree, sorted for short reads; the root has the highest level."""
    sizes = receipts.groupBy(key).agg(F.count(F.lit(1)).alias("size"))  # one row a ledger
    largest = sizes.agg(F.max("size")).first()[0] or 0
    level = materialize(receipts.select(key, (F.col("sequence") - 1).alias("place"), leaf_hash(F.col("chain_sha256")).alias("hash")).join(F.broadcast(sizes), key).select(
        key, "size", "place", "hash"), "tree-nodes")
    made = [level]
    for k in range(_levels(largest)):
        # ledgers whose root is reached stay out
        level = materialize(_lifted(level.filter(F.col("size") > (1 << k)), k, key), "tree-nodes")
        made.append(level)
    nodes = made[0].withColumn("level", F.lit(0))
    for k, more in enumerate(made[1:], 1):
        nodes = nodes.unionByName(more.withColumn("level", F.lit(k)))
    out = materialize(nodes.select(key, "size", "level", "place", "hash").repartitionByRange(key, "level", "place").sortWithinPartitions(key, "level", "place"), "ledger-tree")
    discard(*made)
    return out


def tree_heads(nodes: DataFrame, key: str = "ledger_key") -> DataFrame:
    """Checkpoint of each ledger: (key, size, root)."""
    return nodes.groupBy(key, "size").agg(F.max_by("hash", "level").alias("root"))


def inclusion_proofs(nodes: DataFrame, receipts: DataFrame, key: str = "ledger_key") -> DataFrame:
    """(key, sequence, size, level, on_left, hash): the sibling at each level at which there is one."""
    wanted = receipts.select(key, "sequence").distinct().join(nodes.select(key, "size").distinct(), key)
    levels = F.sequence(F.lit(0), F.lit(MOST_LEVELS))
    way = (wanted.withColumn("level", F.explode(F.filter(levels, lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k) < F.col("size"))))
           .withColumn("at", F.call_function("shiftright", F.col("sequence") - 1, F.col("level")))
           .withColumn("place", F.when(F.col("at") % 2 == 0, F.col("at") + 1).otherwise(F.col("at") - 1)))
    return way.join(nodes.drop("size"), [key, "level", "place"]).select(key, "sequence", "size", "level", (F.col("at") % 2 == 1).alias("on_left"), "hash")


def verify_inclusion(receipts: DataFrame, proofs: DataFrame, heads: DataFrame, key: str = "ledger_key") -> DataFrame:
    """(key, sequence, siblings, valid): does the receipt's chain hash lead to the checkpoint's root?

    Only the receipt, its proof and the checkpoint are read. A proof for another size, with
    a step missing, moved or turned round is invalid, as the steps follow from (sequence, size).
    """
    steps = proofs.groupBy(key, "sequence").agg(F.array_sort(F.collect_list(F.struct("level", "on_left", "hash"))).alias("steps"))  # at most MOST_LEVELS + 1
    joined = receipts.select(key, "sequence", "chain_sha256").join(heads.select(key, "size", "root"), key, "left").join(steps, [key, "sequence"], "left")
    levels = F.filter(F.sequence(F.lit(0), F.lit(MOST_LEVELS)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k) < F.col("size"))
    at = lambda k: F.call_function("shiftright", F.col("sequence") - 1, k)
    width = lambda k: F.ceil(F.col("size") / F.call_function("shiftleft", F.lit(1).cast("long"), k))
    # the levels at which a sibling must stand, and on which side
    due = F.transform(F.filter(levels, lambda k: (at(k) % 2 == 1) | (at(k) + 1 < width(k))), lambda k: F.struct(k.alias("level"), (at(k) % 2 == 1).alias("on_left")))
    given = F.transform(F.coalesce("steps", F.array().cast("array<struct<level:int,on_left:boolean,hash:string>>")), lambda s: F.struct(s["level"].alias("level"), s["on_left"].alias("on_left")))
    reached = F.aggregate(F.coalesce("steps", F.array().cast("array<struct<level:int,on_left:boolean,hash:string>>")), leaf_hash(F.col("chain_sha256")),
                          lambda acc, s: F.when(s["on_left"], node_hash(s["hash"], acc)).otherwise(node_hash(acc, s["hash"])))
    valid = F.col("sequence").between(F.lit(1), F.col("size")) & (due == given) & (reached == F.col("root"))
    return joined.select(key, "sequence", F.size(given).cast("long").alias("siblings"), F.coalesce(valid, F.lit(False)).alias("valid"))


def _cover(ledgers: DataFrame, low: str, high: str, keep: list[str]) -> DataFrame:
    """(*keep, level, place): the fewest aligned whole subtrees that cover the leaves from low to below high.

    Up to the next multiple of the highest power of two at which the two numbers differ the
    blocks follow the bits of the way there, beyond it the bits of ``high``.
    """
    def power(k: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), k)

    def down(value: Column, k: Column) -> Column:
        return F.call_function("shiftright", value, k)

    a, b, k = F.col("_low"), F.col("_high"), F.col("level")
    spread = ledgers.withColumn("_low", F.col(low).cast("long")).withColumn("_high", F.col(high).cast("long")).filter("_low < _high")
    spread = spread.withColumn("_top", F.length(F.bin(a.bitwiseXOR(b))) - 1).withColumn("_way", F.pmod(-a, power(F.col("_top"))))
    spread = spread.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_top"))))
    way = F.col("_way")
    middle = a + way
    rest = b - middle
    up = spread.filter(down(way, k) % 2 == 1).select(*keep, "level", down(a + way % power(k), k).alias("place"))
    after = spread.filter(down(rest, k) % 2 == 1).select(*keep, "level", (down(b, k) - 1).alias("place"))
    return up.unionAll(after)


def _blocks(pairs: DataFrame, key: str) -> DataFrame:
    """(key, old, level, place): the subtrees that an extension proof of (old_size, size) consists of."""
    sizes = pairs.filter("old_size <= size").withColumn("zero", F.lit(0).cast("long"))
    old = _cover(sizes, "zero", "old_size", [key]).withColumn("old", F.lit(True))
    return old.unionByName(_cover(sizes, "old_size", "size", [key]).withColumn("old", F.lit(False)))


def extension_proofs(nodes: DataFrame, old_heads: DataFrame, key: str = "ledger_key") -> DataFrame:
    """(key, old, level, place, hash): the subtrees that cover the old ledger (old) and what came after."""
    sizes = old_heads.select(key, F.col("size").alias("old_size")).join(nodes.select(key, "size").distinct(), key)
    return _blocks(sizes, key).join(nodes.drop("size"), [key, "level", "place"]).select(key, "old", "level", "place", "hash")


def _climbed(nodes: DataFrame, key: str) -> DataFrame:
    """(key, root) that some subtrees (key, size, level, place, hash) of a ledger of ``size`` receipts give together."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    current = nodes.filter("level = 0").select(key, "size", "place", "hash")
    for k in range(_levels(largest)):
        current = _lifted(current, k, key).unionAll(nodes.filter(F.col("level") == k + 1).select(key, "size", "place", "hash"))
    # more than one node left: the subtrees do not make up the tree
    return current.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("hash").alias("root")).filter("n = 1").select(key, "root")


def verify_extension(proofs: DataFrame, old_heads: DataFrame, new_heads: DataFrame, key: str = "ledger_key") -> DataFrame:
    """(key, old_size, size, valid): is the new ledger the old one with receipts added? Only proofs and checkpoints are read."""
    pairs = old_heads.select(key, F.col("size").alias("old_size"), F.col("root").alias("old_root")).join(new_heads.select(key, "size", "root"), key, "left")
    # the blocks must be those that the two sizes ask for
    asked = _blocks(pairs, key)
    sizes = pairs.select(key, F.col("old_size").alias("_old"), F.col("size").alias("_new"))
    given = asked.join(proofs.select(key, "old", "level", "place", "hash").distinct(), [key, "old", "level", "place"]).join(F.broadcast(sizes), key)
    given = materialize(given, "extension-blocks")
    from_old = _climbed(given.filter("old").select(key, F.col("_old").alias("size"), "level", "place", "hash"), key).withColumnRenamed("root", "found_old")
    from_all = _climbed(given.select(key, F.col("_new").alias("size"), "level", "place", "hash"), key).withColumnRenamed("root", "found_new")
    joined = pairs.join(from_old, key, "left").join(from_all, key, "left")
    valid = (F.col("old_size") <= F.col("size")) & (F.col("found_old") == F.col("old_root")) & (F.col("found_new") == F.col("root"))
    return joined.select(key, "old_size", "size", F.coalesce(valid, F.lit(False)).alias("valid"))

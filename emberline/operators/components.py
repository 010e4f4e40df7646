"""Connected components of an edge table: local contraction, then alternating stars."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.session import cut_lineage

CHUNK_EDGES = 1_000_000


def _stars_of(hi: np.ndarray, lo: np.ndarray) -> pd.DataFrame:
    """Replace the edges of one chunk by (node, smallest node) of each component."""
    nodes, index = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    left, right = index[: len(hi)], index[len(hi):]
    parent = np.arange(len(nodes))
    while True:
        a, b = parent[left], parent[right]
        differ = a != b
        if not differ.any():
            break
        np.minimum.at(parent, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above
    moved = parent != np.arange(len(nodes))
    return pd.DataFrame({"hi": nodes[moved], "lo": nodes[parent[moved]]})


def _contract_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contract a partition chunk by chunk, so memory stays bounded."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= CHUNK_EDGES:
            chunk = pd.concat(held)
            yield _stars_of(chunk["hi"].to_numpy(), chunk["lo"].to_numpy())
            held, size = [], 0
    if size:
        chunk = pd.concat(held)
        yield _stars_of(chunk["hi"].to_numpy(), chunk["lo"].to_numpy())


def _contract(edges: DataFrame) -> DataFrame:
    return edges.select("hi", "lo").mapInPandas(_contract_partition, "hi long, lo long")


def _is_settled(edges: DataFrame) -> bool:
    """True when every node is either a centre or hangs on exactly one centre."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionAll(
        edges.select(F.col("lo").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return (ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
            .filter("hangs > 1 OR (hangs = 1 AND holds = 1)").isEmpty())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour."""
    both = edges.unionAll(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.filter("v > u").join(smallest, "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    smallest = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = (edges.join(smallest, "hi").filter("lo <> m")
             .select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
    return moved.unionAll(smallest.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, left: str, right: str, near: Sequence[str] = (),
                         max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component = smallest node id.

    ``near`` names columns that keep related edges together, so that the local
    contraction already finishes most components. What spans partitions is
    finished by star rounds: a combinable ``min`` per node and a join back. A
    node shared by very many edges costs a skewed join partition, which adaptive
    execution splits, never one huge group.
    """
    pairs = edges.select(*near, F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo")).filter("hi <> lo")
    placed = pairs.repartition(*near) if near else pairs
    current = cut_lineage(_contract(placed))
    if current.limit(CHUNK_EDGES + 1).count() <= CHUNK_EDGES:
        # what one chunk holds, one task contracts to the end; a chunk is all that any task holds
        current = cut_lineage(_contract(current.coalesce(1)))
    else:
        for _ in range(max_rounds):
            if _is_settled(current):
                break
            current = cut_lineage(_contract(_small_star(_large_star(current))).distinct())
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots)

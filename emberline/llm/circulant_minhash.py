r"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A text's set is its distinct word shingles. Only two permutations of Z_2^32 are used:
sigma scatters the shingles once, and coordinate k of the signature is the least value of
pi((sigma(s) - k) mod 2^32) over the set, that is pi shifted circularly by k places.
``ROWS`` coordinates make a band's key. Two texts with similarity s share one of the
``BANDS`` keys with probability 1 - (1 - s^ROWS)^BANDS, which at 0.8 falls short of 1 by
3 in a million and grows with s; whoever shares a key is a candidate, and a link is
confirmed on the full sets of 64-bit shingle hashes.

Candidates are ruled out before they are compared where their sizes or 1,024-bit maps of
their sets show that the threshold is out of reach: every bit of one that the other lacks
is at least one shingle that is not shared. This rules out nothing that could be a link.

Texts with equal sets form a class (however many copies there are), and only classes are
banded. Candidates of large buckets are found through pivots (``buckets``), so a group of
thousands of near copies costs rows in proportion to it, and no cap is set. Sets are
computed anew from the texts of candidate classes only and never leave the executors.

Words are ``[^\x20\x09-\x0D]+`` of the text with A-Z lowered; a text with fewer words than
``width`` has its whole sequence as one shingle, a null, empty or blank text has an empty
set and is linked with nothing. A component's id is the smallest key in it; rows without
a key get a row as well, and a component of such rows alone has none. Repeated rows are
copies of one class and keep their rows. Texts of any length are whole. Extra columns
are not read. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm import buckets
from emberline.llm.common import as_bytes, drop_scratch, materialize, mixed, shingle_hashes, slices, word_hashes
from emberline.session import broadcast_if_small

WIDTH = 2
PERCENT = 80
BANDS, ROWS = 32, 5
#: Shingles hashed at a time, so that work stays in a core's cache.
BLOCK_ITEMS = 50_000
BITMAP_WORDS = 16


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(text.lower().split()), width))


def set_tag(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _scrambled(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A bijection of 32-bit numbers, in place."""
    for shift, factor in ((15, first), (13, second)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def sigma(hashes: np.ndarray) -> np.ndarray:
    """Shingles to their scattered places in Z_2^32."""
    return _scrambled((hashes >> np.uint64(32)).astype(np.uint32), 0x9E3779B1, 0x85EBCA77)


def signatures(sets: list[np.ndarray], count: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of non-empty sets: a row of ``count`` coordinates for each."""
    out = np.empty((len(sets), count), dtype=np.uint32)
    sizes = np.array([len(s) for s in sets])
    group = (np.cumsum(sizes) - sizes) // BLOCK_ITEMS
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sets)]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        if high == low:
            continue
        places = sigma(np.concatenate(sets[low:high]))
        starts = np.cumsum(sizes[low:high]) - sizes[low:high]
        for k in range(count):
            out[low:high, k] = np.minimum.reduceat(_scrambled(places - np.uint32(k), 0xC2B2AE3D, 0x27D4EB2F), starts)
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """64-bit keys of each band; the band's number is part of its key."""
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(signature), bands)).copy()
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    for r in range(rows):
        keys = mixed(keys + parts[:, :, r] + np.uint64(1))
    return keys.view(np.int64)


def bitmap(own: np.ndarray) -> np.ndarray:
    """Which of 64 * BITMAP_WORDS cells hold a shingle of the set."""
    cells = np.zeros(64 * BITMAP_WORDS, dtype=bool)
    cells[(own & np.uint64(64 * BITMAP_WORDS - 1)).astype(np.int64)] = True
    return np.packbits(cells, bitorder="little").view(np.int64)


def may_reach(percent: int):
    """Can two classes x, y with sizes n and maps w0.. reach the threshold? Whole numbers, no false no."""
    def admissible(x: str, y: str) -> Column:
        nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
        # overlap o with 100 o >= percent (nx + ny - o)
        least = F.ceil((nx + ny).cast("long") * percent / (100 + percent))
        only_x = only_y = F.lit(0)
        for k in range(BITMAP_WORDS):
            wx, wy = F.col(f"{x}.w{k}"), F.col(f"{y}.w{k}")
            only_x = only_x + F.bit_count(wx.bitwiseAND(F.bitwise_not(wy)))
            only_y = only_y + F.bit_count(wy.bitwiseAND(F.bitwise_not(wx)))
        return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (only_x <= nx - least) & (only_y <= ny - least)

    return admissible


def banded_sets(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, n_shingles, tag, bands, bits): bands and map only where a task meets a set for the first time."""
    kind = docs.schema[key].dataType.simpleString()

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches, text, 2 << 20):
            sets = [shingles(value, width) for value in as_bytes(batch, text)]
            tags = [set_tag(s) if len(s) else None for s in sets]
            fresh = []
            for k, tag in enumerate(tags):
                if tag is not None and tag not in seen:
                    seen.add(tag)
                    fresh.append(k)
            keys: list[np.ndarray | None] = [None] * len(sets)
            maps: list[np.ndarray | None] = [None] * len(sets)
            for k, row in zip(fresh, band_keys(signatures([sets[k] for k in fresh])) if fresh else [], strict=True):
                keys[k], maps[k] = row, bitmap(sets[k])
            yield pa.record_batch([batch.column(key), pa.array([len(s) for s in sets], pa.int64()), pa.array(tags, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                                   pa.array(maps, pa.list_(pa.int64()))], names=[key, "n_shingles", "tag", "bands", "bits"])

    return docs.select(key, text).mapInArrow(banded, f"`{key}` {kind}, n_shingles long, tag binary, bands array<long>, bits array<long>")


def _sets_of(docs: DataFrame, wanted: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(node, items) of the wanted classes (tag, node, first), from the texts of their first rows."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 2 << 20):
            sets = [shingles(value, width) for value in as_bytes(batch, text)]
            yield pa.record_batch([pa.array([set_tag(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["tag", "items"])

    firsts = broadcast_if_small(wanted.select("first").distinct())
    texts = docs.select(key, text).join(firsts, F.col(key).eqNullSafe(F.col("first")), "left_semi")
    sets = texts.select(text).mapInArrow(listed, "tag binary, items array<long>")
    return sets.join(broadcast_if_small(wanted.select("tag", "node")), "tag").select("node", "items")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("ib")).join(broadcast_if_small(pairs), "b")
    left = sets.join(broadcast_if_small(pairs.select(F.col("a").alias("node")).distinct()), "node", "left_semi")
    # 100 * least size < percent * greatest size cannot reach it
    sized = right.join(left.select(F.col("node").alias("a"), F.col("items").alias("ia")), "a").filter(
        100 * F.least(F.size("ia"), F.size("ib")) >= percent * F.greatest(F.size("ia"), F.size("ib")))
    shared = F.size(F.array_intersect("ia", "ib"))
    return sized.filter(100 * shared >= percent * (F.size("ia") + F.size("ib") - shared)).select("a", "b")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept): the smallest key that links lead to, itself included."""
    spark = docs.sparkSession
    rows = materialize(banded_sets(docs, key, text, width), "minhash-rows")
    classes = (rows.filter("n_shingles > 0").groupBy("tag").agg(F.min(key).alias("first"), F.first("n_shingles").alias("n"),
                                                                      F.first("bands", ignorenulls=True).alias("bands"), F.first("bits", ignorenulls=True).alias("bits")))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    temporary: list[DataFrame] = []

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "minhash-pairs")
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = materialize(classes.select("tag", "node", "first").join(broadcast_if_small(nodes), "node", "left_semi"), "minhash-wanted")
        sets = materialize(_sets_of(docs, wanted, key, text, width), "minhash-sets")
        temporary.extend([pairs, wanted, sets])
        return verified(pairs, sets, percent)

    attributes = classes.select("node", "n", *(F.col("bits")[k].alias(f"w{k}") for k in range(BITMAP_WORDS)))
    labels = buckets.linked(classes.select(F.explode("bands").alias("h"), "node"), verify, ["n", *(f"w{k}" for k in range(BITMAP_WORDS))], may_reach(percent), attributes=attributes)
    named = classes.select("tag", "node", "first")
    placed = buckets.with_components(named, labels)
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = placed.join(least, "component").select("tag", "component_id")
    found = rows.select(key, "n_shingles", "tag").join(of_class, "tag", "left").withColumn("component_id", F.coalesce("component_id", key))
    result = materialize(found.select(key, "n_shingles", "component_id", F.col(key).eqNullSafe(F.col("component_id")).alias("kept")), "minhash-components")
    drop_scratch(spark, rows, classes, *temporary, *([labels] if labels is not None else []))
    return result

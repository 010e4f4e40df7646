"""Best-two-fit packing of encoded documents into sequences of a fixed length.

Lengths are whole numbers up to the capacity, so everything the packer decides
depends on how many pieces of each length are left: a histogram of at most
``capacity`` numbers. The packer fills bins from that histogram and writes the bins
as patterns (lengths in one bin) with a repeat count; pieces then find their bin by
their rank among the pieces of their length. Only the histogram, never a piece,
reaches the driver, whatever the size of the corpus.

Best-two-fit: a bin takes the longest piece left and is then filled greedily with the
longest piece that still fits. Afterwards its smallest piece is replaced by two
unpacked pieces if these fill the gap, widened by that piece, more tightly; this is
repeated while it helps. A pattern is repeated as long as the same decisions hold,
that is until one of its lengths runs short.

Null and empty texts give one piece (the closing id alone). Longer documents are cut into pieces of
the capacity; the last may be shorter. Empty table: no rows. Repeated rows are packed each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import as_bytes, drop_scratch, materialize, slices
from emberline.llm.tokens import VOCABULARY, chunk_ids

CAPACITY = 2048
END_ID = (0).to_bytes(4, "little")


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Encoded pieces: key, piece, start, length, ids_crc32, and (part, rank) among the part's pieces of that length."""
    schema = docs.select(F.col(key)).schema.simpleString()[7:-1].replace(":", " ", 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_ids(vocabulary)
        part = TaskContext.get().partitionId()
        used = np.zeros(capacity + 1, dtype=np.int64)
        for batch in slices(batches, text):
            rows, owners = [], []
            for owner, value in enumerate(as_bytes(batch, text)):
                ids = b"".join(map(table.__getitem__, value.split())) + END_ID
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at:at + 4 * capacity]
                    length = len(piece) // 4
                    rows.append((number, at // 4, length, zlib.crc32(piece), part, int(used[length])))
                    used[length] += 1
                    owners.append(owner)
            number, start, length, crc, parts, rank = zip(*rows, strict=True)
            yield pa.record_batch([batch.column(key).take(pa.array(owners, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                                   pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(parts, pa.int32()), pa.array(rank, pa.int64())],
                                  names=[key, "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.select(key, text).mapInArrow(cut, f"{schema}, piece int, start long, length long, ids_crc32 long, part int, rank long")


def _longest(left: np.ndarray, most: int) -> int:
    """The longest length up to ``most`` of which pieces are left; 0 if none."""
    there = np.flatnonzero(left[1:most + 1])
    return int(there[-1]) + 1 if len(there) else 0


def _best_two(left: np.ndarray, room: int) -> tuple[int, int]:
    """Two unpacked pieces whose sum is as near to ``room`` as possible without exceeding it."""
    there = np.flatnonzero(left[:room + 1])
    there = there[there > 0]
    if len(there) == 0:
        return 0, 0
    # for each first length, the longest second one that fits (itself only if two are left)
    place = np.searchsorted(there, room - there, side="right") - 1
    same = (place >= 0) & (there[np.maximum(place, 0)] == there) & (left[there] < 2)
    place = np.where(same, place - 1, place)
    total = np.where(place >= 0, there + there[np.maximum(place, 0)], 0)
    best = int(np.argmax(total))
    return (int(there[best]), int(there[place[best]])) if total[best] > 0 else (0, 0)


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Bins as (repeats, lengths) from ``counts[length]``; every piece is in exactly one bin."""
    left = counts.astype(np.int64).copy()
    bins = []
    while True:
        first = _longest(left, capacity)
        if not first:
            return bins
        held = [first]
        left[first] -= 1
        gap = capacity - first
        while gap and (fit := _longest(left, gap)):
            held.append(fit)
            left[fit] -= 1
            gap -= fit
        while gap and len(held) > 1:
            small = min(held)
            two = _best_two(left, gap + small)
            if sum(two) <= small:
                break
            held.remove(small)
            left[small] += 1
            for length in two:
                left[length] -= 1
                held.append(length)
            gap += small - sum(two)
        lengths, uses = np.unique(held, return_counts=True)
        # Repeat while no length runs out: a further bin is decided like this one as long as
        # all lengths that were left before it are left before the next one too.
        more = int(((left[lengths] - 1) // uses).min()) if (left[lengths] > 0).all() else 0
        more = max(0, more)
        left[lengths] -= more * uses
        bins.append((1 + more, sorted(held, reverse=True)))


def slots(bins: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """Ranges of ranks: pieces of ``length`` ranked [low, low + repeats) go to sequence + (rank - low), at ``offset``."""
    rows, taken, sequence = [], {}, 0
    for repeats, held in bins:
        offset = 0
        for length in held:
            low = taken.get(length, 0)
            rows.append((length, low, sequence, offset))
            taken[length] = low + repeats
            offset += length
        sequence += repeats
    return pd.DataFrame(rows, columns=["length", "low", "first", "offset"]).sort_values(["length", "low"], kind="stable")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every piece with its sequence_id and the offset in it."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, key, text, capacity, vocabulary), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each length and input partition, numbers only
    bases = materialize(by_part.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "piece-ranks")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in bases.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    plan = slots(best_two_fit(counts, capacity))
    shared = spark.sparkContext.broadcast({length: (g["low"].to_numpy(), g["first"].to_numpy(), g["offset"].to_numpy())
                                           for length, g in plan.groupby("length")})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for value in np.unique(length):
                mine = np.flatnonzero(length == value)
                low, first, at = table[int(value)]
                slot = np.searchsorted(low, rank[mine], side="right") - 1
                sequence[mine] = first[slot] + rank[mine] - low[slot]
                offset[mine] = at[slot]
            kept = [batch.column(name) for name in (key, "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)],
                                  names=[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = (cut.join(bases.select("length", "part", "base"), ["length", "part"])
              .select(key, "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank")))
    schema = cut.select(F.col(key)).schema.simpleString()[7:-1].replace(":", " ", 1)
    result = materialize(ranked.mapInArrow(
        placed, f"{schema}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"), "packed")
    drop_scratch(spark, cut, bases)
    return result

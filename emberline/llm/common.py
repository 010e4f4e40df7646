"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from emberline.session import materialize, scratch_path, shared_dir  # noqa: F401  used by the operators

#: Entries a worker's tables of encoded chunks and of word hashes hold before they are emptied; only memory and time depend on it.
CACHE_ENTRIES = 200_000
HASH_ENTRIES = 120_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def lean_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches: long texts make the default of 10,000 rows a large share of a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def drop_scratch(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the folders of written intermediate tables once nothing reads them again."""
    root = shared_dir(spark).rstrip("/")
    for frame in frames:
        for name in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
            if root.split(":", 1)[-1].lstrip("/") not in name:
                raise ValueError(f"{name} is not below the scratch folder")
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8; null is empty."""
    return [b"" if value is None else value for value in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], name: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most_bytes`` of one text column (one row at least)."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - sizes) // most_bytes
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            if stop > start:
                yield batch.slice(start, stop - start)
        del batch
        pa.default_memory_pool().release_unused()


def ascii_words(text: bytes) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+``, as bytes."""
    return text.split()


class WordHashes(dict):
    """Word -> 64-bit hash; the same on every worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASH_ENTRIES:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (two multiply-shift rounds)."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` words; the whole sequence when it is shorter."""
    if len(hashes) == 0:
        return hashes
    width = min(width, len(hashes))
    count = len(hashes) - width + 1
    out = np.full(count, width, dtype=np.uint64)
    for k in range(width):
        out = mixed(out + hashes[k:k + count])
    return out

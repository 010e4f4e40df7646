"""Benchmark decontamination by latent semantic retrieval.

1. Texts become word numbers of the benchmark's vocabulary (0 for any other word), written
   once; overlapping passages are 32 words with a stride of 16.
2. Document frequencies over all passages give TF-IDF weights. A randomised SVD of the
   passage matrix A follows: tasks sum A'(A R) for a random R, from which the right
   singular vectors are taken. Tasks send vocabulary x rank numbers only.
3. Every passage is projected (singular values divided out) and compared with every passage
   of the benchmark, the stated query set, in blocks. Candidates are all pairs whose cosine
   and whose projection on the benchmark passage are at or above ``least_cosine``.
4. A candidate is checked on words: first how many of the benchmark passage's words the
   passage holds (``held`` at least), then the longest common subsequence of the item and the
   text around the passage, and that of the item's answer (its last quarter). A document
   leaks an item if the first covers ``most`` of the item, or ``least`` of it together
   with ``answer_share`` of the answer.

The benchmark and its vocabulary are sent to every task: they are the query set, not the
corpus. Words are runs without white space and ASCII punctuation, in lower case. Null and
empty texts match nothing; items of fewer than ``least_words`` words are not searched for.
Repeated rows give their matches once. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import as_bytes, drop_scratch, materialize, slices

STRIDE = 16
RANK, OVERSAMPLING = 96, 32
SEED = 7
_SPLIT = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


@dataclass(frozen=True)
class Rule:
    """Thresholds of the search and the checks."""

    least_cosine: float = 0.45
    held: float = 0.5
    most: float = 0.8
    least: float = 0.6
    answer_share: float = 0.8
    least_words: int = 5


@dataclass(frozen=True)
class Benchmark:
    """Items as word numbers (from 1) of their common vocabulary."""

    ids: list
    words: list
    vocabulary: dict = field(repr=False)


def words_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(_SPLIT).split()


def read_benchmark(items: DataFrame, key: str = "item_id", text: str = "text", least_words: int = Rule.least_words) -> Benchmark:
    ids, words, vocabulary = [], [], {}
    for row in items.select(key, text).orderBy(key).collect():  # the query set
        own = words_of((row[text] or "").encode())
        if len(own) >= least_words:
            ids.append(row[key])
            words.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in own], dtype=np.uint32))
    return Benchmark(ids, words, vocabulary)


def numbered(docs: DataFrame, benchmark: Benchmark, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, words): each text's word numbers as unsigned 32-bit integers."""
    kind = docs.select(key).schema.simpleString()[7:-1].replace(":", " ", 1)
    shared = docs.sparkSession.sparkContext.broadcast(benchmark.vocabulary)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.get
        for batch in slices(batches, text):
            rows = []
            for value in as_bytes(batch, text):
                words = words_of(value)
                rows.append(np.fromiter(map(find, words, repeat(0)), dtype="<u4", count=len(words)).tobytes())
            yield pa.record_batch([batch.column(key), pa.array(rows, pa.binary())], names=[key, "words"])

    return docs.select(key, text).mapInArrow(number, f"{kind}, words binary")


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers in blocks of STRIDE, each text closed by an empty block; the text of each block."""
    blocks = [-(-len(t) // (4 * STRIDE)) + 1 for t in texts]
    out = np.zeros(sum(blocks) * STRIDE, dtype=np.uint32)
    at = 0
    for value, count in zip(texts, blocks, strict=True):
        out[at:at + len(value) // 4] = np.frombuffer(value, dtype="<u4")
        at += count * STRIDE
    return out.reshape(-1, STRIDE), np.repeat(np.arange(len(texts)), blocks)


def _block_sums(blocks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of the words' rows of ``weights`` for each block; word 0 adds nothing."""
    known = (blocks > 0).sum(axis=1)
    order = np.argsort(-known, kind="stable")
    packed = np.sort(blocks, axis=1)[:, ::-1][order]
    total = np.zeros((len(blocks), weights.shape[1]), dtype=np.float32)
    for column in range(STRIDE):
        count = int((known > column).sum())  # blocks with more known words stand first
        total[:count] += weights[packed[:count, column]]
    out = np.empty_like(total)
    out[order] = total
    return out


def _windows(blocks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Passages: each block with the next one."""
    sums = _block_sums(blocks, weights)
    sums[:-1] += sums[1:].copy()
    return sums


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return slices(batches, "words", 1 << 20)


def _summed(frame: DataFrame, one, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all tasks of the matrices that ``one`` makes of its batches, by blocks of rows."""
    height = max(1, 65536 // shape[1])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=np.float64)
        for batch in _batches(batches):
            total += one(as_bytes(batch, "words"))
        cuts = range(0, shape[0], height)
        yield pa.record_batch({"block": pa.array(range(len(cuts)), pa.int32()),
                               "cells": pa.array([total[k:k + height].astype(np.float32).tobytes() for k in cuts], pa.binary())})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, dtype=np.float32).astype(np.float64) for c in group["cells"])
        return pd.DataFrame({"block": [group["block"].iloc[0]], "cells": [total.tobytes()]})

    rows = (frame.select("words").mapInArrow(partial, "block int, cells binary")
            .groupBy("block").applyInPandas(added, "block int, cells binary").collect())  # vocabulary x rank numbers
    out = np.zeros(shape)
    for row in rows:
        out[row["block"] * height:(row["block"] + 1) * height] = np.frombuffer(row["cells"]).reshape(-1, shape[1])
    return out


@dataclass(frozen=True)
class LatentSpace:
    """What a word adds to its passage's latent vector, and the singular values."""

    weights: np.ndarray
    singular: np.ndarray


def fit_space(texts: DataFrame, size: int, rank: int = RANK, oversampling: int = OVERSAMPLING) -> LatentSpace:
    """Randomised SVD of the TF-IDF matrix of all passages of ``texts`` (column words)."""
    spark = texts.sparkSession

    def frequencies(values: list[bytes]) -> np.ndarray:
        blocks, _ = _laid_out(values)
        pairs = np.sort(np.concatenate([blocks[:-1], blocks[1:]], axis=1), axis=1)
        new = np.ones(pairs.shape, dtype=bool)
        new[:, 1:] = pairs[:, 1:] != pairs[:, :-1]
        found = np.bincount(pairs[new], minlength=size)
        found[0] = (pairs[:, -1] > 0).sum()  # passages with a known word
        return found.reshape(-1, 1)

    passages = _summed(texts, frequencies, (size, 1))[:, 0]
    idf = np.log1p(passages[0] / np.maximum(passages, 1))
    idf[0] = 0
    wide = min(rank + oversampling, size)
    random = np.random.default_rng(SEED).standard_normal((size, wide))
    random[0] = 0
    first = spark.sparkContext.broadcast((random * idf[:, None]).astype(np.float32))

    def ranged(values: list[bytes]) -> np.ndarray:
        blocks, _ = _laid_out(values)
        made = _windows(blocks, first.value)
        made[1:] += made[:-1].copy()  # a block stands in the passage that starts there and in the one before
        flat = blocks.reshape(-1).astype(np.uint16 if size < 1 << 16 else np.uint32)
        order = np.argsort(flat, kind="stable")
        order = order[np.searchsorted(flat[order], 1):]
        out = np.zeros((size, wide))
        for low in range(0, len(order), 1 << 15):
            part = order[low:low + (1 << 15)]
            terms = flat[part]
            cuts = np.flatnonzero(np.diff(terms, prepend=0))
            out[terms[cuts]] += np.add.reduceat(made[part // STRIDE], cuts, axis=0)
        return out

    reached = _summed(texts, ranged, (size, wide)) * idf[:, None]
    # eigenvectors of A'A from this one product with the random matrix (Nystroem), kept stable by a small shift
    shift = np.sqrt(size) * np.finfo(np.float32).eps * max(np.linalg.norm(reached), 1e-30)
    reached += shift * random
    core = random.T @ reached
    values, turned = np.linalg.eigh((core + core.T) / 2)
    sound = values > 1e-10 * max(values.max(), 1e-300)
    left, root, _ = np.linalg.svd(reached @ (turned[:, sound] / np.sqrt(values[sound])), full_matrices=False)
    squares = np.maximum(root ** 2 - shift, 0)
    best = np.flatnonzero(squares > 1e-9 * max(squares.max(initial=0), 1e-300))[:rank]
    singular = np.sqrt(squares[best])
    weights = (idf[:, None] * left[:, best] / singular).astype(np.float32)
    weights[0] = 0
    return LatentSpace(weights, singular)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-20)


def common_length(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    places: dict[int, int] = {}
    for k, word in enumerate(item.tolist()):
        places[word] = places.get(word, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for word in text.tolist():
        hit = places.get(word)
        if hit:
            met = row & hit
            row = ((row + met) | (row - met)) & full
    return len(item) - row.bit_count()


def _checked(item: np.ndarray, text: np.ndarray, at: int, rule: Rule) -> tuple[float, float] | None:
    """(share of the item, share of its answer) found in order around a passage, if that is a leak."""
    around = text[max(0, at - len(item)):at + 2 * STRIDE + len(item)]
    share = common_length(item, around) / len(item)
    if share < rule.least:
        return None
    answer = item[-max(2, len(item) // 4):]
    told = common_length(answer, around) / len(answer)
    return (share, told) if share >= rule.most or told >= rule.answer_share else None


def search(texts: DataFrame, benchmark: Benchmark, space: LatentSpace, rule: Rule = Rule(), key: str = "doc_id") -> DataFrame:
    """(key, item_id, cosine, lcs_share, answer_share): the items that each document leaks."""
    passages_of, words_in = [], []
    for words in benchmark.words:
        blocks, _ = _laid_out([words.astype("<u4").tobytes()])
        kept = max(1, len(blocks) - 2)
        passages_of.append(_windows(blocks, space.weights)[:kept])
        words_in.append(np.concatenate([blocks[:-1], blocks[1:]], axis=1)[:kept])
    owner = np.repeat(np.arange(len(passages_of)), [len(q) for q in passages_of])
    asked = np.concatenate(passages_of)
    shared = texts.sparkSession.sparkContext.broadcast((_unit(asked).astype(np.float32), np.linalg.norm(asked, axis=1).astype(np.float32), np.concatenate(words_in),
                                                        owner, benchmark.words, space.weights))
    ids = benchmark.ids
    kind = texts.select(key).schema.simpleString()[7:-1].replace(":", " ", 1)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, size, asked_words, owner, items, weights = shared.value
        lengths = (asked_words > 0).sum(axis=1)
        for batch in _batches(batches):
            values = as_bytes(batch, "words")
            blocks, text_of = _laid_out(values)
            passages = _windows(blocks, weights)
            own_words = np.concatenate([blocks, np.concatenate([blocks[1:], np.zeros_like(blocks[:1])])], axis=1)
            known = np.flatnonzero((own_words > 0).sum(axis=1) >= rule.held * lengths.min())
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            tested = set()
            for low in range(0, len(known), 4096):
                mine = known[low:low + 4096]
                cosine = _unit(passages[mine]).astype(np.float32) @ asked.T
                norm = np.linalg.norm(passages[mine], axis=1)[:, None]
                at_p, at_q = np.nonzero(cosine >= rule.least_cosine * np.maximum(1, size / np.maximum(norm, 1e-20)))
                for cut in range(0, len(at_p), 8192):
                    p, q = at_p[cut:cut + 8192], at_q[cut:cut + 8192]
                    words = asked_words[q]
                    there = (words[:, :, None] == own_words[mine[p]][:, None, :]).any(axis=2) & (words > 0)
                    enough = there.sum(axis=1) >= rule.held * lengths[q]
                    for place, query, value in zip(mine[p[enough]].tolist(), q[enough].tolist(), cosine[p[enough], q[enough]].tolist(), strict=True):
                        text, item = int(text_of[place]), int(owner[query])
                        at = (place - int(np.searchsorted(text_of, text))) * STRIDE
                        if (text, item, at) in tested:
                            continue
                        tested.add((text, item, at))
                        checked = _checked(items[item], np.frombuffer(values[text], dtype="<u4"), at, rule)
                        if checked:
                            best[text, item] = max(best.get((text, item), (0.0, 0.0, 0.0)), (*checked, value))
            if best:
                where, what = zip(*best, strict=True)
                share, told, cosine = zip(*best.values(), strict=True)
                yield pa.record_batch([batch.column(key).take(pa.array(where)), pa.array([ids[k] for k in what], pa.int64()), pa.array(cosine, pa.float64()),
                                       pa.array(share, pa.float64()), pa.array(told, pa.float64())],
                                      names=[key, "item_id", "cosine", "lcs_share", "answer_share"])

    rows = texts.select(key, "words").mapInArrow(found, f"{kind}, item_id long, cosine double, lcs_share double, answer_share double")
    return rows.groupBy(key, "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs_share").alias("lcs_share"), F.max("answer_share").alias("answer_share"))


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """Number, fit and search: one row for each (document, leaked item)."""
    benchmark = read_benchmark(items, least_words=rule.least_words)
    texts = materialize(numbered(docs, benchmark, key, text), "benchmark-words")
    if not benchmark.ids:
        schema = f"{docs.select(key).schema.simpleString()[7:-1].replace(':', ' ', 1)}, item_id long, cosine double, lcs_share double, answer_share double"
        return docs.sparkSession.createDataFrame([], schema)
    space = fit_space(texts, len(benchmark.vocabulary) + 1)
    leaks = materialize(search(texts, benchmark, space, rule, key), "benchmark-leaks")
    drop_scratch(docs.sparkSession, texts)
    return leaks


def drop_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """The documents that leak no item."""
    return docs.join(find_leaks(docs, items, key, text, rule).select(key).distinct(), key, "left_anti")

"""Language proportions of a document by expectation-maximisation over n-gram likelihoods.

Model: each language is a distribution over byte trigrams of letters (hashed to ``GRAMS``
cells, smoothed), counted over all training rows. A document's trigrams are a mixture of
these; EM finds the proportions. The language set is chosen by penalised likelihood: a
further language must gain more than ``PENALTY`` * log(trigrams) of log-likelihood.
Documents whose fullest mixture does not gain that over the best single language are
settled at once; for the others the nested sets of the largest proportions are refitted.

Training counts are summed in each task, then by blocks of cells; the model (languages x
GRAMS numbers, fixed in size by the label set) is all that tasks are sent. Only text is
read for a prediction.

Null texts and texts without a letter are ``und`` with score 0. With no training rows
every text is ``und``. Repeated rows get equal answers; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import as_bytes, slices

GRAMS = 1 << 12
BLOCK = 512
PENALTY = 1.5
ROUNDS = 15
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")

# white space for every ASCII byte that is no letter
_KEEP = np.array([c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256)], dtype=np.uint8)


def grams(text: bytes) -> np.ndarray:
    """How often each cell's trigrams occur in the lower-cased letters of a text."""
    lowered = text.decode("utf-8", "replace").lower().encode()
    b = _KEEP[np.frombuffer(b" " + lowered + b" ", dtype=np.uint8)].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(GRAMS, dtype=np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    code = code[b[1:-1] != 0x20]
    return np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=GRAMS)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    share: np.ndarray  # languages x GRAMS, rows sum to 1


def fit(train: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Count every training row's trigrams by language; rows without a language are left out."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, text):
            for name, value in zip(batch.column(lang).to_pylist(), as_bytes(batch, text), strict=True):
                if name not in sums:
                    sums[name] = np.zeros(GRAMS, dtype=np.int64)
                sums[name] += grams(value)
        rows = [(name, k, total[k * BLOCK:(k + 1) * BLOCK].tobytes()) for name, total in sums.items() for k in range(GRAMS // BLOCK)]
        if rows:
            names, blocks, cells = zip(*rows, strict=True)
            yield pa.record_batch({"lang": pa.array(names), "block": pa.array(blocks, pa.int32()), "cells": pa.array(cells, pa.binary())})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, dtype=np.int64) for c in group["cells"]], axis=0)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "block": [group["block"].iloc[0]], "cells": [total.tobytes()]})

    schema = "lang string, block int, cells binary"
    rows = (train.select(F.col(lang).cast("string").alias(lang), F.col(text)).filter(F.col(lang).isNotNull())
            .mapInArrow(counted, schema).groupBy("lang", "block").applyInPandas(added, schema).collect())  # languages x blocks
    names = tuple(sorted({row["lang"] for row in rows}))
    counts = np.zeros((len(names), GRAMS))
    for row in rows:
        counts[names.index(row["lang"]), row["block"] * BLOCK:(row["block"] + 1) * BLOCK] = np.frombuffer(row["cells"], dtype=np.int64)
    counts += smoothing
    return LanguageModel(names, counts / counts.sum(axis=1, keepdims=True))


def _em(counts: np.ndarray, share: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each row of counts; zeros in ``start`` stay zero."""
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    part = start
    for _ in range(rounds):
        part = part * ((counts / np.maximum(part @ share, 1e-30)) @ share.T) / total
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
    return part, (counts * np.log(np.maximum(part @ share, 1e-30))).sum(axis=1, dtype=np.float64)


def proportions(counts: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """(proportions of the chosen set, posterior of each single language), a row for each document."""
    share = model.share.astype(np.float32)
    counts = counts.astype(np.float32)
    k = len(model.languages)
    single = (counts @ np.log(share).T).astype(np.float64)
    likely = np.exp(single - single.max(axis=1, keepdims=True))
    likely /= likely.sum(axis=1, keepdims=True)
    best = single.argmax(axis=1)
    chosen = np.eye(k, dtype=np.float32)[best]
    cost = PENALTY * np.log(np.maximum(counts.sum(axis=1), 2))
    value = single.max(axis=1)
    full, gained = _em(counts, share, np.full((len(counts), k), 1 / k, dtype=np.float32))
    open_rows = np.flatnonzero(gained - cost > value)
    order = np.argsort(-full, axis=1, kind="stable")
    for size in range(2, k + 1):
        if len(open_rows) == 0:
            break
        start = np.zeros((len(open_rows), k), dtype=np.float32)
        np.put_along_axis(start, order[open_rows, :size], 1 / size, axis=1)
        part, reached = _em(counts[open_rows], share, start)
        better = reached - (size - 1) * cost[open_rows] > value[open_rows]
        rows = open_rows[better]
        chosen[rows], value[rows] = part[better], (reached - (size - 1) * cost[open_rows])[better]
        # no larger set can win where the fullest mixture pays less than its price
        open_rows = open_rows[gained[open_rows] - size * cost[open_rows] > value[open_rows]]
    return chosen, likely


def answers(texts: list[bytes], model: LanguageModel) -> list[tuple[str, float, list[str], list[float]]]:
    """(language, score, chosen languages, their shares) of each text."""
    names = model.languages
    out: list[tuple[str, float, list[str], list[float]]] = []
    for start in range(0, len(texts), 256):
        held = texts[start:start + 256]
        if names:
            part, likely = proportions(np.stack([grams(t) for t in held]), model)
        for i, text in enumerate(held):
            if not names or not _LETTER.search(text.decode("utf-8", "replace")):
                out.append((UNKNOWN, 0.0, [], []))
                continue
            chosen = [int(j) for j in np.argsort(-part[i], kind="stable") if part[i, j] > 0]
            first = chosen[0]
            score = float(part[i, first]) if len(chosen) > 1 else float(likely[i, first])
            out.append((names[first], min(1.0, score), [names[j] for j in chosen], [float(part[i, j]) for j in chosen]))
    return out


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, languages, shares): shares of the chosen languages, largest first.

    score is the predicted language's share times its posterior among single languages when
    only one is chosen; 0 for ``und``.
    """
    kind = docs.select(key).schema.simpleString()[7:-1].replace(":", " ", 1)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x GRAMS numbers

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            pred, score, listed, shares = zip(*answers(as_bytes(batch, text), shared.value), strict=True)
            yield pa.record_batch([batch.column(key), pa.array(pred), pa.array(score, pa.float64()), pa.array(listed, pa.list_(pa.string())),
                                   pa.array(shares, pa.list_(pa.float64()))], names=[key, "lang_pred", "score", "languages", "shares"])

    return docs.select(key, text).mapInArrow(answered, f"{kind}, lang_pred string, score double, languages array<string>, shares array<double>")


def relabel(docs: DataFrame, model: LanguageModel, least_share: float = 0.5, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents with a known main language of at least ``least_share`` of the text, which becomes ``lang``.

    All other columns pass as they are. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = answers(as_bytes(batch, text), shared.value)
            stays = [name != UNKNOWN and (shares[0] if shares else 0.0) >= least_share for name, _, _, shares in found]
            told = pa.array([name for name, *_ in found], pa.string())
            columns = [told if name == lang else batch.column(name) for name in names]
            yield pa.record_batch(columns, schema=batch.schema).filter(pa.array(stays))

    return docs.mapInArrow(kept, docs.schema)


def held_out(key: str = "doc_id"):
    """The rows kept from training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))

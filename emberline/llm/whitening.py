"""Embedding whitening: the leading eigenvectors by Jacobi-Davidson on distributed products.

Entries become whole numbers x = floor(256 c). The covariance of the distinct vectors is
never formed: all that Spark computes of it are products with a block of vectors, centred
row by row before they are multiplied, summed in tasks and then by dimension, so that the
driver receives one row a dimension. Around these products:

* a Rayleigh-Ritz step over the search space gives approximations of the leading pairs;
* a pair whose residual is at rounding level is locked, and the rest of the search stays
  orthogonal to it;
* every pair not yet locked extends the search space by a solution of its projected
  correction equation (I - QQ')(A - theta I)(I - QQ') t = -r, found by a few steps of
  MINRES; the equations advance side by side, so that a step is one distributed product;
* a search space of more than ``MOST_SPACE`` vectors is restarted from its Ritz vectors.

A final product with the locked vectors gives their residuals anew; pairs above
rounding level go back to the search.

A vector that is null or has null or non-finite entries is dropped. Vectors shorter than
the longest one count as if filled with zeros. Repeated vectors enter the covariance once
and are all answered; ids may be null or repeated. Components whose eigenvalue is not
above rounding level (constant or too few vectors) have no row, so fewer than
``components`` may come back; of tied eigenvalues any basis may come. A deviation that
does not fit into 64 bits is null. Extra columns are not read. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import drop_scratch, materialize

SCALE = 256
COMPONENTS = 4
#: Vectors in the search space before it is restarted, and MINRES steps to a correction.
MOST_SPACE = 24
INNER_STEPS = 6
MOST_OUTER = 60
#: Residual norm at which a pair is locked, relative to the largest eigenvalue and the root of the
#: dimension: what rounding leaves in a product. It doubles with every round after the 30th.
LOCKED = 8 * np.finfo(float).eps
EXTRA = 2
BATCH_VALUES = 2_000_000


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x): rows whose vector is whole and finite, entries as floor(256 c)."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    # NaN - NaN and inf - inf are not 0; a null entry makes the condition null
    whole = F.coalesce(F.forall(entries, lambda c: F.coalesce((c - c) == 0.0, F.lit(False))), F.lit(False))
    return rows.filter(whole).select(key, F.transform(entries, lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as one int64 matrix, short vectors filled with zeros."""
    for whole in batches:
        step = max(1, BATCH_VALUES // max(1, width))
        for start in range(0, whole.num_rows, step):
            batch = whole.slice(start, step)
            lists = batch.column("x")
            lengths = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            out = np.zeros((batch.num_rows, width), dtype=np.int64)
            out[np.arange(width) < lengths[:, None]] = flat
            yield batch, out


@dataclass(frozen=True)
class Moments:
    """Exact sums over the fit list."""

    n: int
    sums: tuple[int, ...]
    squares: tuple[int, ...]

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    @property
    def trace(self) -> float:
        return float(sum(Fraction(self.n * q - s * s, self.n * self.n) for s, q in zip(self.sums, self.squares, strict=True)))


def moments(fit: DataFrame) -> Moments:
    """n, the sums and the sums of squares of every dimension, in whole numbers of any size."""
    width = fit.agg(F.max(F.size("x"))).first()[0] or 0

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, [0] * width, [0] * width
        for _, x in _matrices(batches, width):
            n += len(x)
            big = x if np.abs(x).max(initial=0) < 1 << 20 else x.astype(object)
            total = [a + int(b) for a, b in zip(total, big.sum(axis=0), strict=True)]
            square = [a + int(b) for a, b in zip(square, (big * big).sum(axis=0), strict=True)]
        if n:
            # high and low halves, so that sums of them fit into decimals of 38 digits
            yield pa.record_batch({"dim": pa.array(range(width), pa.int32()), "n": pa.array([n] * width, pa.int64()),
                                   "total": pa.array([str(t) for t in total]), "square": pa.array([str(s) for s in square])})

    parts = fit.select("x").mapInArrow(summed, "dim int, n long, total string, square string")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("total", "square"))).orderBy("dim").collect()
    return Moments(rows[0]["n"] if rows else 0, tuple(int(r["total"]) for r in rows), tuple(int(r["square"]) for r in rows))


def covariance_product(fit: DataFrame, known: Moments) -> Callable[[np.ndarray], np.ndarray]:
    """V -> covariance times V, by one pass over the fit list; rows are centred before they are multiplied."""
    mean, width = known.mean, len(known.sums)

    def product(block: np.ndarray) -> np.ndarray:
        def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros(block.shape), False
            for _, x in _matrices(batches, width):
                centred = x - mean
                total += centred.T @ (centred @ block)
                seen = True
            if seen:
                yield pa.record_batch({"dim": pa.array(range(width), pa.int32()), **{f"v{k}": total[:, k] for k in range(block.shape[1])}})

        names = [f"v{k}" for k in range(block.shape[1])]
        parts = fit.select("x").mapInArrow(multiplied, "dim int, " + ", ".join(f"{n} double" for n in names))
        rows = parts.groupBy("dim").agg(*(F.sum(n).alias(n) for n in names)).collect()
        out = np.empty(block.shape)
        for r in rows:
            out[r["dim"]] = r[1:]
        return out / known.n

    return product


def _orthonormal(block: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of what the columns add to the given orthonormal ones."""
    kept: list[np.ndarray] = []
    base = np.hstack([a for a in against if a.size] or [np.zeros((len(block), 0))])
    for column in block.T:
        norm = np.linalg.norm(column)
        if not norm > 0 or not np.isfinite(norm):
            continue
        v = column / norm
        for _ in range(3):
            v = v - base @ (base.T @ v)
            for k in kept:
                v = v - k * (k @ v)
            size = np.linalg.norm(v)
            if size < 1e-10:
                break
            v = v / size
        else:
            kept.append(v)
    return np.array(kept).T.reshape(len(block), len(kept))


def corrections(product: Callable[[np.ndarray], np.ndarray], locked: np.ndarray, ritz: np.ndarray, values: np.ndarray, residuals: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions t of the projected correction equations, by MINRES, one block product a step.

    Every column has its own shift and its own Lanczos recurrence, kept orthogonal to the
    locked vectors and to its Ritz vector.
    """
    count = residuals.shape[1]

    def projected(block: np.ndarray) -> np.ndarray:
        for _ in range(2):
            block = block - locked @ (locked.T @ block)
            block = block - ritz * np.sum(ritz * block, axis=0)
        return block

    v = projected(-residuals)
    beta = np.linalg.norm(v, axis=0)
    live = beta > 0
    v = v / np.where(live, beta, 1)
    eta = beta.copy()
    before, older_w, old_w = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    older_c = old_c = np.ones(count)
    older_s = old_s = np.zeros(count)
    beta_now = np.zeros(count)
    out = np.zeros_like(v)
    for _ in range(steps):
        if not live.any():
            break
        u = projected(product(v) - v * values)
        alpha = np.sum(v * u, axis=0)
        u = u - alpha * v - beta_now * before
        beta_next = np.linalg.norm(u, axis=0)
        # QR of the tridiagonal matrix by Givens rotations
        delta = old_c * alpha - older_c * old_s * beta_now
        top = np.hypot(delta, beta_next)
        second = old_s * alpha + older_c * old_c * beta_now
        third = older_s * beta_now
        live = live & (top > 0)
        safe = np.where(live, top, 1)
        c, s = delta / safe, beta_next / safe
        w = (v - third * older_w - second * old_w) / safe
        out = out + np.where(live, c * eta * w, 0)
        eta = -s * eta
        older_w, old_w, before = old_w, w, v
        older_c, old_c, older_s, old_s = old_c, c, old_s, s
        live = live & (beta_next > 1e-14 * np.abs(values))
        v, beta_now = u / np.where(live, beta_next, 1), beta_next
    return projected(out)


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], width: int, count: int, scale: float, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors, residual norms) of a symmetric matrix known by its products.

    ``scale`` is the trace; a matrix of trace 0 has no pair to find.
    """
    count = min(count, width)
    locked, locked_values = np.zeros((width, 0)), np.zeros(0)
    if count == 0 or not scale > 0:
        return locked_values, locked, np.zeros(0)
    start = np.random.default_rng(seed).standard_normal((width, min(width, count + EXTRA)))
    space = _orthonormal(start, [locked])
    image = product(space)
    for turn in range(MOST_OUTER):
        small = space.T @ image
        theta, rotation = np.linalg.eigh((small + small.T) / 2)
        theta, rotation = theta[::-1], rotation[:, ::-1]
        wanted = count - locked.shape[1]
        ritz, ritz_image = space @ rotation, image @ rotation
        residual = ritz_image - ritz * theta
        residual = residual - locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        least = LOCKED * np.sqrt(width) * 2 ** max(0, turn - 30) * max(theta[0], *locked_values, scale / width)
        # pairs are locked in falling order; a space that holds everything has nothing to add
        ready = next((k for k in range(min(wanted, len(theta))) if norms[k] > least), min(wanted, len(theta)))
        if space.shape[1] + locked.shape[1] >= width:
            ready = min(wanted, len(theta))
        if ready:
            locked = np.hstack([locked, ritz[:, :ready]])
            locked_values = np.concatenate([locked_values, theta[:ready]])
            # what is left of the search stays orthogonal to the locked vectors; their images turn with them
            space, image, theta, residual = ritz[:, ready:], ritz_image[:, ready:], theta[ready:], residual[:, ready:]
            ritz, ritz_image = space, image
            if locked.shape[1] == count:
                fresh = product(locked)
                norms = np.linalg.norm(fresh - locked * np.sum(locked * fresh, axis=0), axis=0)
                locked_values = np.sum(locked * fresh, axis=0)
                if (norms <= 4 * least).all() or locked.shape[1] + space.shape[1] >= width:
                    break
                space, image = _merged(space, image, locked, fresh)
                locked, locked_values = np.zeros((width, 0)), np.zeros(0)
                continue
            if space.shape[1] == 0:
                space = _orthonormal(np.random.default_rng(seed + 1).standard_normal((width, count)), [locked])
                image = product(space)
                continue
        if space.shape[1] > MOST_SPACE:
            kept = count - locked.shape[1] + EXTRA
            space, image = ritz[:, :kept], ritz_image[:, :kept]
        todo = min(count - locked.shape[1], ritz.shape[1])
        found = corrections(product, locked, ritz[:, :todo], theta[:todo], residual[:, :todo], INNER_STEPS)
        added = _orthonormal(found, [locked, space])
        if added.shape[1] == 0:
            added = _orthonormal(np.random.default_rng(seed + 2).standard_normal((width, todo)), [locked, space])
            if added.shape[1] == 0:
                continue
        space, image = np.hstack([space, added]), np.hstack([image, product(added)])
    else:
        raise RuntimeError(f"the search did not end in {MOST_OUTER} rounds")
    order = np.argsort(-locked_values, kind="stable")
    return locked_values[order], locked[:, order], norms[order]


def _merged(space: np.ndarray, image: np.ndarray, locked: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.hstack([locked, space]), np.hstack([fresh, image])


@dataclass(frozen=True)
class Whitening:
    """The components of a fit list."""

    known: Moments
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    identity_error: float


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Components of the covariance of the distinct vectors, and how far whitened ones are from the identity."""
    known = moments(distinct)
    product = covariance_product(distinct, known)
    values, vectors, residuals = leading_pairs(product, len(known.sums), components, known.trace if known.n else 0.0)
    kept = values > 1e-12 * known.trace if len(values) else np.zeros(0, dtype=bool)
    values, vectors, residuals = values[kept], vectors[:, kept], residuals[kept]
    error = 0.0
    if len(values):
        scaled = vectors / np.sqrt(values)
        error = float(np.abs(scaled.T @ product(scaled) - np.eye(len(values))).max())
    return Whitening(known, values, vectors, residuals, error)


def transform(vectors: DataFrame, model: Whitening, key: str = "vec_id") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    known, width, count = model.known, len(model.known.sums), len(model.values)
    mean, scaled = known.mean, model.vectors / np.sqrt(model.values)
    explained, sums = model.values / known.trace if count else model.values, known.sums
    kind = vectors.schema[key].dataType.simpleString()
    most = (1 << 63) - 1

    def deviations(x: np.ndarray) -> list[int | None]:
        far = known.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums), default=0)
        if far * far * width <= most:
            apart = known.n * x - np.array(sums, dtype=np.int64)
            return (apart * apart).sum(axis=1).tolist()
        apart = known.n * x.astype(object) - np.array(sums, dtype=object)
        return [int(d) if d <= most else None for d in (apart * apart).sum(axis=1)]

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, width):
            white = (x - mean) @ scaled
            rows = np.repeat(np.arange(batch.num_rows), count)
            yield pa.record_batch([
                batch.column(key).take(pa.array(rows)), pa.array(np.tile(np.arange(1, count + 1), batch.num_rows), pa.int32()),
                pa.array(np.full(len(rows), known.n), pa.int64()), pa.array(deviations(x), pa.int64()).take(pa.array(rows)),
                pa.array(white.reshape(-1)), pa.array(np.tile(explained, batch.num_rows)), pa.array(np.full(len(rows), model.identity_error))],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(answered, f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fit on the distinct vectors, answer every row."""
    vectors = integer_vectors(rows, key, vector)
    width = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    vectors = vectors.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))
    distinct = materialize(vectors.select("x").distinct(), "whitening-fit")
    model = fit(distinct, components)
    drop_scratch(rows.sparkSession, distinct)
    return transform(vectors, model, key)

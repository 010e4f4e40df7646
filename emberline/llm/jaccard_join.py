"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

A text's set is its distinct word shingles, as hashes. Texts with equal sets form a class
(a copy costs one narrow row); the join runs over classes.

1. Hashes are dealt by ranges, as packed arrays: sorted hashes and two bytes that name
   the class within its slice of texts, a class once for each task however many copies the
   task holds. A range's task counts how often each hash occurs and passes on those that
   occur twice or more, back to their slices.
2. A class puts its hashes in one global order, rarest first. Hashes that occur nowhere
   else come first and can match nothing, so a class with more of them than its prefix
   is long leaves; the others keep their shared hashes, in order.
3. Classes meet on the hashes of their prefixes. Length, positional and suffix filters
   (the suffix filter compares how many later hashes fall in each of eight hash cells)
   are applied as part of that join, so only pairs that may reach the threshold come out.
4. Each such pair is verified once, on the shared hashes.

To find the groups without all pairs of a large group, classes that share the least of
their hashes under one of a few scramblings are first compared with one pivot each; what
that links counts as one component. Prefix buckets that lie within a component need no
test and are not written. The others are joined by ``buckets``: small ones in full, large
ones through pivots as long as these link much, what is left in full. No link between two
components is lost.

Hashes are compared by 48 bits, whose chance of confusing a pair of 600-shingle texts is
about one in 10^9. Null and empty texts, or texts without a word, have an empty set and
link with nothing. Rows without id get a row as well; a component's id is the smallest
id in it. Repeated rows are copies. Extra columns are not read. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm import buckets
from emberline.llm.common import as_bytes, drop_scratch, materialize, mixed, shingle_hashes, slices, word_hashes
from emberline.session import broadcast_if_small

WIDTH = 5
PERCENT = 75
#: Hashes to a range and rows to a cell of classes: the size of a task, not a limit.
RANGE_HASHES = 1_000_000
SLICE_BYTES = 8 << 20
SUFFIX_CELLS = 8
#: Cross-component pairs to a posting up to which the rest is joined in full at once.
PAIRS_PER_POSTING = 20
#: Least hashes by which copies of one text find each other before prefixes are joined.
SKETCHES = 4
TAG_BYTES = 12


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; A-Z are lower-cased."""
    return np.unique(shingle_hashes(word_hashes(text.lower().split()), width))


def tag_of(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=TAG_BYTES).digest()


def shingle_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, n_shingles, tag): the size and the identity of each row's set."""
    kind = docs.select(key).schema.simpleString()[7:-1].replace(":", " ", 1)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            sets = [shingles(value, width) for value in as_bytes(batch, text)]
            yield pa.record_batch([batch.column(key), pa.array([len(s) for s in sets], pa.int64()), pa.array([tag_of(s) for s in sets], pa.binary())],
                                  names=[key, "n_shingles", "tag"])

    return docs.select(key, text).mapInArrow(summed, f"{kind}, n_shingles long, tag binary")


def _planes(hashes: np.ndarray) -> bytes:
    """48-bit numbers as six byte planes; sorted ones compress well."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :6] = planes.T
    return out.reshape(-1).view("<u8")


def _packed(texts: DataFrame, text: str, width: int, ranges: int, cells: int) -> DataFrame:
    """(cell, slice, owner, hashes): each slice's classes' hashes, cut into ranges, and once for each slice its tags.

    A class is named by its slice and its place there, two bytes a hash; a slice's row of
    tags has a cell below 0.
    """
    edges = np.array([(k << 48) // ranges for k in range(ranges + 1)], dtype=np.uint64)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen: set[bytes] = set()
        number = TaskContext.get().partitionId() << 24
        for whole in slices(batches, text, SLICE_BYTES):
            for start in range(0, whole.num_rows, 60_000):
                tags, found = [], []
                for value in as_bytes(whole.slice(start, 60_000), text):
                    own = shingles(value, width)
                    tag = tag_of(own)
                    if len(own) and tag not in seen:
                        seen.add(tag)
                        tags.append(tag)
                        found.append(own >> np.uint64(16))
                if not found:
                    continue
                owner = np.repeat(np.arange(len(found), dtype=np.uint16), [len(x) for x in found])
                hashes = np.concatenate(found)
                del found
                order = np.argsort(hashes, kind="stable")
                hashes, owner = hashes[order], owner[order]
                del order
                cuts = np.searchsorted(hashes, edges[:-1])
                rows = [(-1 - number % cells, number, b"".join(tags), b"")]
                for cell, low, high in zip(range(ranges), cuts, [*cuts[1:], len(hashes)], strict=True):
                    if high > low:
                        rows.append((cell, number, owner[low:high].astype("<u2").tobytes(), _planes(hashes[low:high])))
                        if len(rows) == 256:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)
                number += 1

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        cell, number, owner, hashes = zip(*rows, strict=True)
        return pa.record_batch({"cell": pa.array(cell, pa.int32()), "slice": pa.array(number, pa.int64()), "owner": pa.array(owner, pa.binary()),
                                "hashes": pa.array(hashes, pa.binary())})

    return texts.select(text).mapInArrow(packed, "cell int, slice long, owner binary, hashes binary")


def _shared(packed: DataFrame, cells: int) -> DataFrame:
    """(cell, slice, owner, hashes, counts): the hashes of two classes or more, dealt by slice; rows of tags have no counts.

    A class that several tasks met counts as several: its hashes are kept although it may
    be alone with them, and the order by count is still one order for all.
    """
    columns = ["cell", "slice", "owner", "hashes", "counts"]

    def counted(group: pd.DataFrame) -> pd.DataFrame:
        if group["cell"].iat[0] < 0:
            return pd.DataFrame({"cell": (group["slice"] % cells).astype("int32"), "slice": group["slice"], "owner": group["owner"], "hashes": group["hashes"], "counts": None})
        hashes = np.concatenate([_unplanes(data) for data in group["hashes"]])
        owner = np.concatenate([np.frombuffer(data, dtype="<u2").astype(np.int64) + (number << 16) for data, number in zip(group["owner"], group["slice"].tolist(), strict=True)])
        del group
        order = np.lexsort((owner, hashes))
        hashes, owner = hashes[order], owner[order]
        del order
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        runs = np.diff(np.concatenate([starts, [len(hashes)]]))
        uses = np.repeat(runs.astype(np.int32), runs)
        kept = uses > 1
        hashes, owner, uses = hashes[kept], owner[kept], uses[kept]
        at = owner >> 16
        order = np.argsort(at, kind="stable")
        hashes, owner, uses, at = hashes[order], owner[order], uses[order], at[order]
        rows = []
        cuts = np.flatnonzero(np.diff(at, prepend=-1))
        for low, high in zip(cuts, [*cuts[1:], len(at)][:len(cuts)], strict=True):
            number = int(at[low])
            rows.append((number % cells, number, (owner[low:high] & 0xFFFF).astype("<u2").tobytes(), _planes(hashes[low:high]), uses[low:high].astype("<u4").tobytes()))
        return pd.DataFrame(rows, columns=columns)

    return packed.groupBy("cell").applyInPandas(counted, "cell int, slice long, owner binary, hashes binary, counts binary")


def _named(shared: DataFrame) -> DataFrame:
    """(tag, node): each class under the first name that it has in any slice."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, tags in zip(batch.column("slice").to_pylist(), batch.column("owner").to_pylist(), strict=True):
                own = [tags[k:k + TAG_BYTES] for k in range(0, len(tags), TAG_BYTES)]
                yield pa.record_batch({"tag": pa.array(own, pa.binary()), "node": pa.array((number << 16) + np.arange(len(own), dtype=np.int64))})

    rows = shared.filter("counts IS NULL").select("slice", "owner").mapInArrow(listed, "tag binary, node long")
    return rows.groupBy("tag").agg(F.min("node").alias("node"))


def _ordered(shared: DataFrame, classes: DataFrame, cells: int) -> DataFrame:
    """(node, n, mass, items): shared hashes, rarest first, of every class whose prefix holds one.

    mass is the mean logarithm of how many classes hold a hash; it is high for the text
    that many near copies were made from.
    """

    def listed(key: tuple, chunks: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame([], columns=["node", "n", "mass", "items"], dtype=object)
        if len(chunks) == 0 or len(known) == 0:
            return empty
        known = known.sort_values("node")
        nodes, sizes = known["node"].to_numpy(), known["n"].to_numpy()
        parts = []
        for number, own, data, counts in zip(chunks["slice"].tolist(), chunks["owner"], chunks["hashes"], chunks["counts"], strict=True):
            name = np.frombuffer(own, dtype="<u2").astype(np.int64) + (number << 16)
            row = np.minimum(np.searchsorted(nodes, name), len(nodes) - 1)
            mine = nodes[row] == name  # other names of a class bring the same hashes again
            parts.append((row[mine].astype(np.int32), _unplanes(data)[mine], np.frombuffer(counts, dtype="<u4")[mine]))
        del chunks
        owner, hashes, uses = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((hashes, uses, owner))
        owner, hashes, uses = owner[order], hashes[order].astype(np.int64), uses[order]
        del order
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        rows = []
        for low, high in zip(cuts, [*cuts[1:], len(owner)][:len(cuts)], strict=True):
            k = owner[low]
            n = int(sizes[k])
            if n - (high - low) < _prefix(n):
                rows.append((int(nodes[k]), n, float(np.log(uses[low:high]).sum() / n), hashes[low:high]))
        return pd.DataFrame(rows, columns=["node", "n", "mass", "items"]) if rows else empty

    placed = classes.select((F.shiftright("node", 16) % cells).cast("int").alias("cell"), "node", "n")
    return shared.filter("counts IS NOT NULL").groupBy("cell").cogroup(placed.groupBy("cell")).applyInPandas(listed, "node long, n long, mass double, items array<long>")


def _prefix(n: int) -> int:
    """Hashes of which two sets that reach the threshold share one at least."""
    return n - -(-PERCENT * n // 100) + 1


def _postings(lists: DataFrame) -> DataFrame:
    """(h, node, n, pos, s0.., mass): the prefix hashes with their rank and the cells of what follows."""

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(5 + SUFFIX_CELLS)]
            for node, n, mass, items in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "mass")), batch.column("items"), strict=True):
                items = items.values.to_numpy()
                alone = n - len(items)
                head = min(_prefix(n) - alone, len(items))
                cells = np.zeros((head, SUFFIX_CELLS), dtype=np.int32)
                after = np.bincount(items[head:] & (SUFFIX_CELLS - 1), minlength=SUFFIX_CELLS)
                hot = (items[:head, None] & (SUFFIX_CELLS - 1)) == np.arange(SUFFIX_CELLS)
                cells[:] = after + hot[::-1].cumsum(axis=0)[::-1] - hot
                for column, values in zip(columns, (items[:head], np.full(head, node), np.full(head, n), np.arange(alone, alone + head), *cells.T, np.full(head, mass)), strict=True):
                    column.append(values)
            if columns[0]:
                joined = [np.concatenate(column) for column in columns]
                yield pa.record_batch([pa.array(joined[0], pa.int64()), pa.array(joined[1], pa.int64()), *(pa.array(x.astype(np.int32), pa.int32()) for x in joined[2:-1]), pa.array(joined[-1])],
                                      names=["h", "node", "n", "pos", *(f"s{k}" for k in range(SUFFIX_CELLS)), "mass"])

    kinds = ", ".join(f"s{k} int" for k in range(SUFFIX_CELLS))
    return lists.mapInArrow(posted, f"h long, node long, n int, pos int, {kinds}, mass double")


def _may_reach(a: str, b: str) -> Column:
    """Length, positional and suffix filters, for a hash taken as the first that two classes share."""
    def col(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    na, nb, pa_, pb = col(a, "n"), col(b, "n"), col(a, "pos"), col(b, "pos")
    both = na + nb
    # overlap o with 100 o >= PERCENT (both - o), in whole numbers
    least = F.ceil(both.cast("long") * PERCENT / (100 + PERCENT))
    length = (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb))
    rest = 1 + F.least(na - pa_, nb - pb) - 1
    apart = pa_ + pb
    for k in range(SUFFIX_CELLS):
        apart = apart + F.abs(col(a, f"s{k}") - col(b, f"s{k}"))
    return length & (rest >= least) & (both - apart >= 2 * least)


def _verified(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """The pairs (a, b), distinct ones, whose similarity reaches the threshold.

    The narrow pairs go to the lists, and lists travel once, to the class they are compared with.
    """
    right = lists.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib")).join(broadcast_if_small(pairs), "b")
    left = lists.join(broadcast_if_small(pairs.select(F.col("a").alias("node")).distinct()), "node", "left_semi")
    left = left.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    shared = F.size(F.array_intersect("ia", "ib"))
    return right.join(left, "a").filter(100 * shared >= PERCENT * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def _sketches(lists: DataFrame) -> DataFrame:
    """(h, node, mass): the least of a class's shared hashes under each of a few scramblings."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(node, mass, items.values.to_numpy().view(np.uint64)) for node, mass, items in zip(batch.column("node").to_pylist(), batch.column("mass").to_pylist(), batch.column("items"), strict=True)]
            sets = [s for s in sets if len(s[2])]
            if sets:
                every = np.concatenate([s[2] for s in sets])
                starts = np.cumsum([0] + [len(s[2]) for s in sets[:-1]])
                keys = np.stack([mixed(np.minimum.reduceat(mixed(every + np.uint64(k << 48)), starts) + np.uint64(k)) for k in range(SKETCHES)], axis=1)
                yield pa.record_batch({"h": keys.reshape(-1).view(np.int64), "node": np.repeat([s[0] for s in sets], SKETCHES), "mass": np.repeat([s[1] for s in sets], SKETCHES)})

    return lists.select("node", "mass", "items").mapInArrow(sketched, "h long, node long, mass double")


def linked_classes(lists: DataFrame) -> DataFrame | None:
    """Labels (node, component) of the classes with a link; None without any link.

    The labels are those of the whole similarity graph; pairs inside an already known
    component are not tested. Copies of one text are first linked through the class of
    highest mass that shares a sketch with them, so that of the buckets of prefix hashes
    only those are left that join two components.
    """
    spark = lists.sparkSession

    def verify(pairs: DataFrame) -> DataFrame:
        once = materialize(pairs.distinct(), "jaccard-pairs")
        found = materialize(_verified(once, lists), "jaccard-links")
        drop_scratch(spark, once)
        return found

    sketches = materialize(buckets.with_components(_sketches(lists), None), "jaccard-sketches")
    known = verify(buckets.star_pairs(sketches, -F.col("mass")))
    drop_scratch(spark, sketches)
    known = None if known.isEmpty() else known
    labels = None if known is None else buckets.labels_of(known)
    placed = buckets.with_components(_postings(lists).select("h", "node"), labels)
    open_buckets = placed.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("h")
    postings = _postings(lists).join(broadcast_if_small(materialize(open_buckets, "jaccard-open")), "h", "left_semi")
    carried = ["n", "pos", *(f"s{k}" for k in range(SUFFIX_CELLS)), "mass"]
    return buckets.linked(postings, verify, carried, _may_reach, -F.col("mass"), known, labels, PAIRS_PER_POSTING)


def join_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, n_shingles, component_id): the smallest key that links lead to, itself included."""
    spark = docs.sparkSession
    sets = materialize(shingle_sets(docs, key, text, width), "jaccard-sets")
    classes = sets.filter("n_shingles > 0").groupBy("tag").agg(F.min(key).alias("first"), F.first("n_shingles").alias("n"))
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    ranges = max(8, -(-total // RANGE_HASHES))
    shared = materialize(_shared(_packed(docs, text, width, int(ranges), int(ranges)), int(ranges)), "jaccard-shared")
    classes = materialize(classes.join(_named(shared), "tag"), "jaccard-classes")
    lists = materialize(_ordered(shared, classes, int(ranges)), "jaccard-lists")
    drop_scratch(spark, shared)
    labels = linked_classes(lists)
    named = classes.select("tag", "node", "first")
    if labels is None:
        of_class = named.select("tag", F.col("first").alias("component_id"))
    else:
        placed = named.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
        of_class = placed.join(least, "component").select("tag", "component_id")
    # the key of an empty set is its own component
    result = materialize(sets.join(of_class, "tag", "left")
                         .select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id")), "jaccard-components")
    drop_scratch(spark, sets, classes, lists, *([labels] if labels is not None else []))
    return result


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component stays: that of the smallest key (of repeated rows with it, one).

    Rows without a key stay. Texts are shuffled only where the keys to drop are too many to
    be sent to every task, and rows of repeated keys.
    """
    joined = join_documents(docs, key, text)
    gone = joined.filter(F.col(key) != F.col("component_id")).select(key).distinct()
    kept = docs.join(broadcast_if_small(gone), key, "left_anti")
    repeated = joined.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)
    if repeated.isEmpty():
        return kept
    repeated = broadcast_if_small(repeated)
    return kept.join(repeated, key, "left_anti").unionByName(kept.join(repeated, key, "left_semi").dropDuplicates([key])).select(docs.columns)

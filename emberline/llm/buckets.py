"""Links between the members of shared buckets, without all pairs of a large bucket.

Postings (h, node) say which buckets a node is in. All pairs of a bucket of at most
``SMALL`` rows are tested at once, at most (SMALL - 1) / 2 pairs a row. A larger bucket is
first joined with one pivot, the row whose buckets are largest in sum (the text that many
near copies were made from shares more buckets than they do with one another): what that
links counts as one component. From then on only the rows outside a bucket's largest
component are open. While they meet more rows of other components than a multiple of the
postings, and each turn halves that, pivots among them follow; then they are joined with
the rows of their buckets in full, in blocks of ``BLOCK_ROWS`` rows, so that no task meets a
whole bucket with itself. No link between two components is lost; pairs within a known
component need no test. Postings are written once, those of one-row buckets not at all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import drop_scratch, materialize
from emberline.operators.components import connected_components
from emberline.session import broadcast_if_small

SMALL = 16
BLOCK_ROWS = 512
#: Cross-component pairs to a posting up to which the rest is joined in full at once.
PAIRS_PER_POSTING = 20
MOST_TURNS = 6

Verify = Callable[[DataFrame], DataFrame]


def _always(a: str, b: str) -> Column:
    return F.lit(True)


def labels_of(links: DataFrame) -> DataFrame:
    return materialize(connected_components(links, "a", "b"), "bucket-labels")


def with_components(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Postings with the component of their node; a node without a link is its own."""
    if labels is None:
        return postings.withColumn("component", F.col("node"))
    return postings.join(broadcast_if_small(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))


def _blocked(rows: DataFrame, copied: bool) -> DataFrame:
    """A row's block of its bucket of m rows, or a copy of the row for each block."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK_ROWS)).cast("int")
    block = F.explode(F.sequence(F.lit(0), blocks - 1)) if copied else F.pmod(F.xxhash64("node"), blocks).cast("int")
    return rows.withColumn("block", block)


def all_pairs(rows: DataFrame, admissible: Callable[[str, str], Column] = _always) -> DataFrame:
    """(a, b) of every two rows of a bucket in different components."""
    met = (F.col("x.h") == F.col("y.h")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
    return rows.alias("x").join(rows.alias("y"), met & admissible("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def open_pairs(minor: DataFrame, rows: DataFrame, admissible: Callable[[str, str], Column] = _always) -> DataFrame:
    """(a, b) of every row outside its bucket's largest component (``top``) and every row of another component."""
    met = (F.col("x.h") == F.col("y.h")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.component") != F.col("y.component"))
    once = (F.col("y.component") == F.col("x.top")) | (F.col("x.node") < F.col("y.node"))
    return _blocked(minor, True).alias("x").join(_blocked(rows, False).alias("y"), met & once & admissible("x", "y")).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def star_pairs(rows: DataFrame, rank: Column, carried: Sequence[str] = (), admissible: Callable[[str, str], Column] = _always,
               among: DataFrame | None = None) -> DataFrame:
    """(a, b) of each bucket's first row by ``rank`` (of ``among``, if given) and every other one of another component."""
    pivots = (rows if among is None else among).groupBy("h").agg(F.min(F.struct(rank.alias("rank"), "node", "component", *carried)).alias("p")).select("h", "p.*")
    met = (F.col("x.h") == F.col("y.h")) & (F.col("x.component") != F.col("y.component"))
    return rows.alias("x").join(pivots.alias("y"), met & admissible("x", "y")).select(F.col("y.node").alias("a"), F.col("x.node").alias("b"))


def linked(postings: DataFrame, verify: Verify, carried: Sequence[str] = (), admissible: Callable[[str, str], Column] = _always,
           rank: Column | None = None, known: DataFrame | None = None, labels: DataFrame | None = None, per_posting: int | None = None,
           attributes: DataFrame | None = None) -> DataFrame | None:
    """Labels (node, component) of all nodes with a link; None without any link.

    ``verify`` returns those of its distinct pairs (a, b) that are links; ``known`` and
    ``labels`` hold links found before and their components. ``admissible`` may rule out pairs that cannot link, by the
    ``carried`` columns of the postings or of ``attributes`` (one row a node). ``rank``
    orders the first pivots of large buckets, if not by the sum of their buckets' sizes.
    """
    spark = postings.sparkSession
    per_posting = PAIRS_PER_POSTING if per_posting is None else per_posting
    sizes = postings.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1")
    live = postings.join(broadcast_if_small(sizes), "h")
    if attributes is not None:
        live = live.join(attributes, "node")
    live = materialize(live.select("h", "m", "node", *carried), "bucket-postings")
    links = known
    large = live.filter(F.col("m") > SMALL)
    pairs = all_pairs(with_components(live.filter(F.col("m") <= SMALL), labels), admissible)
    ranked = large
    if rank is None:
        ranked, rank = large.join(large.groupBy("node").agg(F.sum("m").alias("reach")), "node"), -F.col("reach")
    pairs = pairs.unionAll(star_pairs(with_components(ranked, labels), rank, carried, admissible))
    before, full = None, False
    for turn in range(MOST_TURNS + 1):
        found = materialize(verify(pairs.distinct()), "bucket-links")
        links = found if links is None else links.unionAll(found)
        if not found.isEmpty():
            older, labels = labels, labels_of(links)
            drop_scratch(spark, *([older] if older is not None else []))
        if full:
            break
        placed = with_components(large, labels)
        counts = placed.groupBy("h", "component").agg(F.count("*").alias("c")).groupBy("h").agg(F.sum("c").alias("rows"), F.max(F.struct("c", "component")).alias("t"))
        mixed = materialize(counts.filter("t.c < rows").select("h", F.col("t.component").alias("top"), "rows", (F.col("rows") - F.col("t.c")).alias("outside")), "bucket-mixed")
        cross, total = mixed.agg(F.sum(F.col("rows") * F.col("outside")), F.sum("rows")).first()
        if not cross:
            drop_scratch(spark, mixed)
            break
        minor = placed.join(broadcast_if_small(mixed.select("h", "top")), "h").filter(F.col("component") != F.col("top"))
        full = cross <= per_posting * total or before is not None and 2 * cross > before or turn == MOST_TURNS - 1
        before = cross
        pairs = open_pairs(minor, placed, admissible) if full else star_pairs(placed, F.xxhash64("node", "h", F.lit(turn)), carried, admissible, minor)
    drop_scratch(spark, live)
    return labels

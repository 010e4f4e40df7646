"""Quality rules as a short-circuit cascade.

Each rule reads one or two measures of the whole text. On a bounded sample every rule is
run on every sampled document: its cost is the time of the measures it needs, its
selectivity the share it rejects. Rules then run in order of rejection per cost, and a
document leaves at the first rule that rejects it. A verdict is the same in any order,
so the sample affects time only; which rule is named as the first to reject does depend
on the order. ``measures`` lists what is to be returned for every document, rejected or
not; those are always computed.

Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words and are rejected.
Repeated rows are judged each; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import as_bytes, shingle_hashes, slices, word_hashes

#: Documents of the cost sample, a bound whatever the size of the table.
SAMPLE_DOCS = 1000
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


class Measured(dict):
    """Measures of one text, computed when first asked for."""

    def __init__(self, text: bytes):
        super().__init__()
        self.text = text

    def __missing__(self, name: str):
        value = self[name] = MEASURES[name](self)
        return value


def _repeat_words(m: Measured) -> int:
    hashes = m["hashes"]
    if len(hashes) < 3:
        return 0
    _, place, uses = np.unique(shingle_hashes(hashes, 3), return_inverse=True, return_counts=True)
    twice = uses[place] > 1
    covered = np.zeros(len(hashes), dtype=bool)
    for k in range(3):
        covered[k:k + len(twice)] |= twice
    return int(covered.sum())


def _top_word(m: Measured) -> int:
    return int(np.unique(m["hashes"], return_counts=True)[1].max()) if m["n_words"] else 0


MEASURES: dict[str, Callable[[Measured], object]] = {
    "words": lambda m: m.text.split(),
    "hashes": lambda m: word_hashes(m["words"]),
    "n_words": lambda m: len(m["words"]),
    # bytes that do not continue a code point, less the separators
    "word_chars": lambda m: len(m.text.decode("utf-8", "replace")) - sum(map(m.text.count, SPACES)),
    "n_symbols": lambda m: sum(map(m.text.count, SYMBOLS)),
    "lines": lambda m: [line for line in m.text.split(b"\n") if line.strip()],
    "n_lines": lambda m: len(m["lines"]),
    "n_dup_lines": lambda m: m["n_lines"] - len(set(m["lines"])),
    "n_repeat_words": _repeat_words,
    "n_lettered": lambda m: sum(1 for word in m["words"] if word.isalpha() or any(b >= 0x80 or chr(b).isalpha() for b in word)),
    "top_word": _top_word,
}


@dataclass(frozen=True)
class Rule:
    """Rejects a document when ``rejects`` holds; ``needs`` are the measures it reads."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Measured], bool]


#: Comparisons of whole numbers, so that verdicts are exact.
RULES = (
    Rule("too_few_words", ("n_words",), lambda m: m["n_words"] < 50),
    Rule("too_many_words", ("n_words",), lambda m: m["n_words"] > 1_000_000),
    Rule("short_words", ("word_chars", "n_words"), lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", ("word_chars", "n_words"), lambda m: m["word_chars"] > 15 * m["n_words"]),
    Rule("symbols", ("n_symbols", "n_words"), lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"]),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("few_letters", ("n_lettered", "n_words"), lambda m: 10 * m["n_lettered"] < 7 * m["n_words"]),
    Rule("one_word_repeated", ("top_word", "n_words"), lambda m: 10 * m["top_word"] > 3 * m["n_words"]),
)


def profile_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_docs: int = SAMPLE_DOCS) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected), best rejection per cost first.

    The sample is the distinct texts with the smallest hashes, whatever the partitioning: at
    most ``sample_docs``, fewer where texts repeat much. A text is tried once and counts for
    all its copies.
    """

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, gone, seen = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for value, copies in zip(as_bytes(batch, text), batch.column("order_copies").to_pylist(), strict=True):
                seen += copies
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    gone[k] += copies * bool(rule.rejects(Measured(value)))
                    cost[k] += copies * (time.perf_counter() - began)
        yield pa.record_batch({"rule": pa.array(range(len(rules)), pa.int32()), "cost": pa.array(cost, pa.float64()),
                               "gone": pa.array(gone, pa.int64()), "seen": pa.array([seen] * len(rules), pa.int64())})

    # a share of the rows by a hash of the text, twice the sample, so that few texts travel
    total = docs.count()
    share = min(1.0, 2.0 * sample_docs / max(1, total))
    hashed = docs.select(F.pmod(F.xxhash64(text), F.lit(1 << 40)).alias("order_hash"), F.col(text).alias("sampled"))
    few = hashed.filter(F.col("order_hash") < int(share * (1 << 40)) + 1).groupBy("order_hash").agg(F.first("sampled").alias("sampled"), F.count(F.lit(1)).alias("order_copies"))
    picked = few.orderBy("order_hash").limit(sample_docs).select(F.col("sampled").alias(text), "order_copies")
    found = (picked.mapInArrow(tried, "rule int, cost double, gone long, seen long")
             .groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("gone").alias("gone"), F.sum("seen").alias("seen")).collect())
    by_rule = {row["rule"]: (row["cost"] / max(1, row["seen"]), row["gone"] / max(1, row["seen"])) for row in found}
    listed = [(rule.name, *by_rule.get(k, (0.0, 0.0))) for k, rule in enumerate(rules)]
    return sorted(listed, key=lambda x: (-x[2] / max(x[1], 1e-9), x[1], x[0]))


def run_cascade(docs: DataFrame, order: list[str], key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES,
                measures: tuple[str, ...] = ()) -> DataFrame:
    """(key, measures..., kept, rejected_by): rejected_by is the first rule in ``order`` that rejects."""
    by_name = {rule.name: rule for rule in rules}
    if sorted(order) != sorted(by_name):
        raise ValueError("order must name every rule once")
    ordered = [by_name[name] for name in order]
    kind = docs.select(key).schema.simpleString()[7:-1].replace(":", " ", 1)
    schema = ", ".join([kind, *(f"{m} long" for m in measures), "kept boolean, rejected_by string"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            columns: list[list] = [[] for _ in measures]
            by: list[str | None] = []
            for value in as_bytes(batch, text):
                m = Measured(value)
                by.append(next((rule.name for rule in ordered if rule.rejects(m)), None))
                for column, name in zip(columns, measures, strict=True):
                    column.append(m[name])
            yield pa.record_batch([batch.column(key), *(pa.array(c, pa.int64()) for c in columns), pa.array([b is None for b in by]), pa.array(by, pa.string())],
                                  names=[key, *measures, "kept", "rejected_by"])

    return docs.select(key, text).mapInArrow(judged, schema)


def filter_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, measures: tuple[str, ...] = (),
                   sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Profile the rules on the sample, then judge every document by the cascade."""
    order = [name for name, _, _ in profile_rules(docs, text, rules, sample_docs)]
    return run_cascade(docs, order, key, text, rules, measures)

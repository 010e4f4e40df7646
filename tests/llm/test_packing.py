import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import packing, token_lengths
from emberline.llm.tokens import VOCABULARY, chunk_ids, encoded
from tests.llm.helpers import documents, prose, with_clashes

TEXTS = ["", None, "Hello, world! don't I'VE x...", " \n\t ", "é ́b H̱ello ΟΔΟΣ Σας İstanbul ﬁn Ǆ", "<|endoftext|> a<|ENDOFTEXT|>b", "word " * 3000, " wide\xa0space\x1cctl",
         "Ünder... (a),b;c's 12.5%% ---", "x" * 5000, prose(3, 700), "日本語のテキスト и русский", "a\x00b"]


def plain_ids(text):
    return chunk_ids(VOCABULARY).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_chunks_give_the_tokenizers_ids():
    table = chunk_ids(VOCABULARY)
    for text in TEXTS:
        assert np.frombuffer(encoded((text or "").encode(), table), "<u4").tolist() == plain_ids(text), text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_gives_the_tokenizers_ids(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(encoded(text.encode(), chunk_ids(VOCABULARY)), "<u4").tolist() == plain_ids(text)


def test_packed_pieces_hold_every_id_once(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(50 + k, prose(k, 30 + 13 * k)) for k in range(60)] + [(50, prose(0, 30))]
    got = packing.pack(with_clashes(documents(spark, rows)).repartition(4)).toPandas()
    for key, text in rows:
        ids = np.array([*plain_ids(text), 0], dtype="<u4").tobytes()
        mine = got[got.doc_id == key].drop_duplicates("piece").sort_values("piece")
        assert mine.start.tolist() == list(range(0, len(ids) // 4, 2048))
        for r in mine.itertuples():
            part = ids[4 * r.start:4 * (r.start + r.length)]
            assert len(part) == 4 * r.length and zlib.crc32(part) == r.ids_crc32
    assert (got.doc_id == 50).sum() == 2  # a repeated row is packed twice
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        ends = bin_.offset + bin_.length
        assert bin_.offset.tolist() == [0, *ends.tolist()[:-1]] and ends.iloc[-1] <= 2048


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_bins_hold_the_histogram(lengths):
    counts = np.bincount(lengths, minlength=21) if lengths else np.zeros(21, dtype=np.int64)
    bins = packing.best_two_fit(counts, 20)
    held = np.zeros(21, dtype=np.int64)
    for repeats, pieces in bins:
        assert sum(pieces) <= 20
        np.add.at(held, pieces, repeats)
    assert held.tolist() == counts.tolist()
    slots = packing.slots(bins)
    assert slots.groupby("length").size().sum() == sum(len(p) for _, p in bins)


def test_two_pieces_fill_the_gap_that_one_leaves():
    # 11 + 6 leaves 3 empty; replacing 6 by 5 + 4 fills the bin
    bins = packing.best_two_fit(np.bincount([11, 6, 5, 4], minlength=21), 20)
    assert (1, [11, 5, 4]) in bins


def test_empty_table(spark):
    assert packing.pack(documents(spark, [])).count() == 0
    assert token_lengths.context_totals(token_lengths.length_histogram(documents(spark, []))).count() == 0


@pytest.mark.parametrize("span", [3, 256])
def test_context_totals(spark, monkeypatch, span):
    monkeypatch.setattr(token_lengths, "RANGE", span)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100 + k, "a b") for k in range(5)]
    lengths = [len(plain_ids(t)) for _, t in rows]
    totals = token_lengths.context_totals(token_lengths.length_histogram(with_clashes(documents(spark, rows))))
    got = {r["context_limit"]: r for r in totals.collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        assert r["docs_within"] == sum(n <= limit for n in lengths) and r["docs_over"] == sum(n > limit for n in lengths)
        assert r["tokens_within"] == sum(n for n in lengths if n <= limit)
        assert r["truncated_tokens"] == sum(min(n, limit) for n in lengths) and r["lost_tokens"] == sum(lengths) - r["truncated_tokens"]
    asked = spark.createDataFrame([(1,), (5,), (10 ** 6,)], "context_limit long")
    for r in token_lengths.totals_at(totals, asked).collect():
        assert r["truncated_tokens"] == sum(min(n, r["context_limit"]) for n in lengths)
    half = token_lengths.quantiles(totals, [0.5]).first()["n_tokens"]
    assert half == sorted(lengths)[(len(lengths) + 1) // 2 - 1]

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import pii
from emberline.llm.crf import Tagger, symbols
from tests.llm.helpers import documents, prose, with_clashes

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = []
    for n, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = (n == 0 or n == 1 and all(int(x) <= 255 for x in m[0].split(".")) or n == 2 and 14 <= len(digits) <= 19 and pii.luhn(digits)
                    or n == 3 and 10 <= len(digits) <= 15)
            if good:
                out.append((m.start(), n, m.end()))
    return [(pii.KINDS[n], a, b) for a, n, b in sorted(out)]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a@.-%+ ()0123459é\n", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text)[0] == brute(text)


def corpus():
    rng = np.random.default_rng(0)
    rows = []
    for k in range(120):
        phone = f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
        digits = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        card = next(digits + str(c) for c in range(10) if pii.luhn(digits + str(c)))
        extra = [phone, card, f"user{k}@mail{k % 7}.example.com", f"10.{k}.{2 * k % 256}.7", f"{k} items", ""][k % 6]
        rows.append((k, f"{prose(k, 12)} {extra} {prose(1000 + k, 15)}"))
    return rows


def test_spans_counts_and_masks(spark):
    rows = [*corpus(), (500, None), (501, ""), (502, "é" * 200 + " a@b.co " + "ü" * 300), (503, "7" * 50_000 + "@"), (0, corpus()[0][1]), (None, "x@y.zz")]
    docs = with_clashes(documents(spark, rows)).repartition(3)
    tagger = pii.train(docs, steps=40)
    got = pii.find(docs, tagger).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        base = pii.shown(brute(texts[r["doc_id"]]))
        assert r["base"] == base
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
    masked = pii.mask_documents(docs)
    assert masked.columns == docs.columns
    by_key = {r["doc_id"]: r for r in masked.collect()}
    assert by_key[None]["text"] == "<EMAIL>" and by_key[None]["n_chars"] == 7 and by_key[500]["text"] is None
    assert not any(brute(r["text"]) for r in by_key.values())


def test_no_spans_to_learn_from_and_empty_table(spark):
    assert pii.train(documents(spark, [(1, "plain"), (2, None)])) is None
    assert pii.scan(documents(spark, [])).count() == 0


def test_tagger_learns_and_windows_agree_with_whole_lines():
    rows, gold = [], []
    for _, text in corpus():
        spans = brute(text)
        start = max(0, (spans[0][1] if spans else 20) - 20)
        window = text[start:start + pii.WIDTH]
        rows.append(symbols(window, pii.WIDTH))
        gold.append(pii._tags(pii.WIDTH, brute(window)))
    tagger = Tagger.new(9, seed=3)
    losses = tagger.train(np.stack(rows), np.stack(gold), steps=120, batch=24)
    assert losses[-1] < 0.3 * losses[0]
    text = "x " * 100 + "call +1 (415) 555-2671 soon " + "y " * 100
    found = pii.added_spans(tagger, [text])[0]
    assert all(text[a:b].strip() for _, _, a, b in found)
    for _, kind, a, b in found:
        assert kind in pii.KINDS and b - a <= pii.MOST_CHARS


def test_gradients():
    tagger = Tagger.new(5, hidden=4, embedding=3)
    tagger.params = {k: v.astype(np.float64) for k, v in tagger.params.items()}
    rng = np.random.default_rng(1)
    rows, gold = rng.integers(1, 131, size=(3, 7)), rng.integers(0, 5, size=(3, 7))
    rows[1, 5:] = 0
    _, grad = tagger.gradients(rows, gold)
    for name in ("trans", "out", "f_h", "b_x", "f_b"):
        value = tagger.params[name]
        at = tuple(rng.integers(0, n) for n in value.shape)
        kept = value[at]
        value[at] = kept + 1e-3
        up = tagger.gradients(rows, gold)[0]
        value[at] = kept - 1e-3
        down = tagger.gradients(rows, gold)[0]
        value[at] = kept
        assert abs((up - down) / 2e-3 - grad[name][at]) < 1e-4


def test_reconciling_keeps_base_and_the_surest():
    base, out = [("ip", 10, 17)], [(30, 40)]
    added = [(0.99, "phone", 15, 25), (0.995, "phone", 50, 60), (0.999, "card", 55, 65), (0.99, "card", 35, 45), (0.99, "email", 0, 10), (0.99, "email", 0, 10)]
    assert pii.reconciled(base, out, added) == [("email", 0, 10), ("ip", 10, 17), ("card", 55, 65)]


def test_planted_spellings_are_added():
    tagger = pii.learned([text[max(0, text.find(extra) - 40):][:pii.WIDTH] for _, text in corpus() for extra in [text.split(" ")[12]]], steps=200)
    assert tagger.precision >= pii.PRECISE and tagger.recall >= 0.5 and tagger.sure < pii.SURE
    planted = {"user7 [at] mail3.example.com": "email", "user8(at)mail2.example.com": "email", "1-800-555-0100": "phone", "415-555-2671": "phone"}
    found = 0
    for k, (form, kind) in enumerate(planted.items()):
        text = f"{prose(50 + k, 30)} {form} {prose(90 + k, 30)}"
        own, ruled_out = pii.base_spans(text)
        spans = pii.reconciled(own, ruled_out, pii.added_spans(tagger, [text])[0])
        assert own == [] and all(text[a:b] == form and of == kind for of, a, b in spans)
        found += len(spans)
    assert found >= 3
    assert pii._window_starts("x" * 130 + " name [at] host.example.com") == [64, 128]


def test_a_failed_match_bars_its_own_kind_only():
    own, ruled_out = pii.base_spans("1-800-555-0100")
    assert ruled_out == [(0, 14, "card")]
    assert pii.reconciled(own, ruled_out, [(0.9, "phone", 0, 14)]) == [("phone", 0, 14)]
    assert pii.reconciled(own, ruled_out, [(0.9, "card", 0, 14)]) == []
    assert pii.plausible("phone", "1-800-555-0100") and not pii.plausible("phone", "555-0100") and not pii.plausible("card", "4532.0151.1283.0367")

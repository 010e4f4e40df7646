import random

import numpy as np
import pytest

from emberline.llm import buckets, circulant_minhash
from emberline.llm.common import table
from tests.llm.helpers import documents, prose, with_clashes


def brute(rows):
    """Components by all pairs of distinct sets."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k:k + 2]) for k in range(len(w) - 1)) if len(w) >= 2 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    first = {}
    for k, s in enumerate(sets):
        if s:
            parent[root(k)] = root(first.setdefault(s, k))
    distinct = list(first.items())
    for i, (s, a) in enumerate(distinct):
        for t, b in distinct[:i]:
            both = len(s & t)
            if both and 100 * both >= 80 * (len(s) + len(t) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            r = root(k)
            least[r] = min(key, least.get(r, key))
    return sorted(((key, len(s), least.get(root(k))) for k, ((key, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus():
    pick = random.Random(5)
    rows = []
    for group in range(10):
        base = prose(group, 40 + 15 * group).split()
        for copy in range(10):
            words = list(base)
            for _ in range(copy):
                words[pick.randrange(len(words))] = f"w{pick.randrange(10_000)}"
            rows.append(" ".join(words))
    chain = prose(77, 120).split()  # neighbours are linked, ends are not
    for k in range(25):
        chain[4 * k % 120] = f"chain{k}"
        rows.append(" ".join(chain))
    shared = prose(7, 40)
    rows += [f"{shared} {prose(200 + k, 60)}" for k in range(30)]
    rows += [prose(300, 90)] * 5 + ["", None, "one", "ONE", "one two", "one  two\n", "A b", "a B", " \t", "ünder Straße", "x " * 30_000, "x " * 29_999, prose(9, 20_000)]
    pick.shuffle(rows)
    return [(3 * k + 1, text) for k, text in enumerate(rows)] + [(None, rows[0]), (None, None), (None, "only null keys here"), (4, rows[1]), (4, "another text of one id")]


@pytest.mark.parametrize(("small", "per_posting"), [(buckets.SMALL, buckets.PAIRS_PER_POSTING), (2, 0), (2, 10**9)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, small, per_posting):
    monkeypatch.setattr(buckets, "SMALL", small)
    monkeypatch.setattr(buckets, "PAIRS_PER_POSTING", per_posting)
    monkeypatch.setattr(buckets, "BLOCK_ROWS", 8)
    rows = corpus()
    got = circulant_minhash.deduplicate(with_clashes(documents(spark, rows)).repartition(5)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_whole_table(spark, folder):
    docs = table(spark, folder, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = circulant_minhash.deduplicate(docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    assert circulant_minhash.deduplicate(documents(spark, [])).collect() == []
    assert [tuple(r) for r in circulant_minhash.deduplicate(documents(spark, [(3, None)])).collect()] == [(3, 0, 3, True)]


def test_shifts_of_one_permutation_estimate_similarity():
    pick = np.random.default_rng(1)
    errors = []
    for share in (0.2, 0.5, 0.8, 0.95):
        for _ in range(20):
            a = pick.integers(0, 1 << 63, 400, dtype=np.uint64)
            b = np.concatenate([a[:int(400 * share)], pick.integers(0, 1 << 63, 400 - int(400 * share), dtype=np.uint64)])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            s, t = circulant_minhash.signatures([np.unique(a), np.unique(b)])
            errors.append((s == t).mean() - true)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
    x = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(circulant_minhash._scrambled(x.copy(), 0xC2B2AE3D, 0x27D4EB2F))) == 1 << 16
    # coordinate k is pi of every place moved k back, around the circle
    one = circulant_minhash.signatures([np.array([5 << 32], dtype=np.uint64)], 3)[0]
    place = circulant_minhash.sigma(np.array([5 << 32], dtype=np.uint64))
    for k in range(3):
        assert one[k] == circulant_minhash._scrambled(place - np.uint32(k), 0xC2B2AE3D, 0x27D4EB2F)[0]


def test_planted_pairs_at_the_threshold_share_a_band():
    pick, missed = np.random.default_rng(2), 0
    for _ in range(300):
        a = pick.integers(0, 1 << 63, 180, dtype=np.uint64)
        b = np.concatenate([a[:160], pick.integers(0, 1 << 63, 20, dtype=np.uint64)])  # 160 / 200
        s, t = circulant_minhash.band_keys(circulant_minhash.signatures([np.unique(a), np.unique(b)]))
        missed += not (s == t).any()
    assert missed == 0

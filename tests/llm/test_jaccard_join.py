import random

import pytest

from emberline.llm import jaccard_join
from tests.llm.helpers import documents, prose, with_clashes


def sets_of(rows):
    out = {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        out[key] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(rows):
    sets = sets_of(rows)
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in keys}


def corpus():
    pick = random.Random(3)
    rows = []
    for group in range(12):
        base = prose(group, 60 + 20 * group).split()
        for copy in range(8):
            words = list(base)
            for _ in range(copy // 2):
                words[pick.randrange(len(words))] = f"w{pick.randrange(10_000)}"
            rows.append(" ".join(words))
    rows += [prose(100 + k, 80) for k in range(20)]
    common = prose(7, 40)
    rows += [f"{common} {prose(200 + k, 60)}" for k in range(30)]
    rows += ["", None, "one", "ONE", "one two", "a b c d e", "A b  c\td\ne", " ", "ünder Straße ÜNDER", "x " * 3000, "x " * 2999]
    pick.shuffle(rows)
    return [(7 * k + 5, text) for k, text in enumerate(rows)]


@pytest.mark.parametrize("per_posting", [jaccard_join.PAIRS_PER_POSTING, 0])
def test_components_are_those_of_all_pairs(spark, monkeypatch, per_posting):
    monkeypatch.setattr(jaccard_join, "PAIRS_PER_POSTING", per_posting)
    monkeypatch.setattr(jaccard_join, "RANGE_HASHES", 500)
    rows = corpus()
    got = jaccard_join.join_documents(with_clashes(documents(spark, rows)).repartition(5)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_threshold_is_exact(spark):
    # 3 of 4 shingles shared is 0.75; 5 of 7 is below
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, "p q r s t u v w x y"), (4, "p q r s t u v w x z")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join_documents(documents(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3 if 5 / 7 >= 0.75 else 4}


def test_null_keys_repeated_rows_and_empty_table(spark):
    text = prose(1, 50)
    got = jaccard_join.join_documents(documents(spark, [(None, text), (9, text), (9, text), (None, "only here and nowhere else at all"), (3, None)])).collect()
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in got if not (r["doc_id"] is None and r["component_id"] is None))
    assert found == [(False, 3, 3), (False, 9, 9), (False, 9, 9), (True, 0, 9)]
    assert len(got) == 5
    assert jaccard_join.join_documents(documents(spark, [])).count() == 0
    kept = jaccard_join.keep_one(documents(spark, [(9, text), (9, text), (4, text), (5, "other words stand here alone"), (None, "x")]))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "5", "None"]

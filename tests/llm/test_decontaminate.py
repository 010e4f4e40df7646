import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import decontaminate as d
from tests.llm.helpers import documents, prose, with_clashes

ITEMS = "item_id long, text string, words string"


def stock(k: int) -> str:
    return " ".join(f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "zo", "pe", "va") for b in ("ran", "dil", "mos", "tek", "fin", "gor", "sul", "bex")) + " the of and"


def test_leaks_copies_and_paraphrases_only(spark):
    items = [(k, prose(k, 20 + 3 * k, stock(0)).capitalize() + ".") for k in range(12)]
    bench = spark.createDataFrame([(*i, "x") for i in items] + [(90, None, "x"), (91, "", "x"), (92, "too few words", "x")], ITEMS)
    rows, want = [], set()
    for k in range(60):
        clean = prose(1000 + k, 120 + k, stock(0))
        if k % 5 == 0:
            item, words = k // 5, items[k // 5][1].split()
            if k % 2:
                words = [w if j % 8 else f"swap{j}" for j, w in enumerate(words)]
            cut = clean.split()
            place = (17 * k) % len(cut)
            clean = " ".join([*cut[:place], *words, *cut[place:]]).upper() if k == 10 else " ".join([*cut[:place], *words, *cut[place:]])
            want.add((k, item))
        rows.append((k, clean))
    rows += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1]), (103, "x " * 50_000 + items[4][1]), (104, "three short words")]
    want |= {(102, 3), (103, 4)}
    got = d.find_leaks(with_clashes(documents(spark, rows)).repartition(3), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    assert got.count() == len(want)
    kept = d.drop_leaks(documents(spark, rows), bench)
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {k for k, _ in want}


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(1, "one two three four five six", "x")], ITEMS)
    assert d.find_leaks(documents(spark, [(1, "a b c")]), none).count() == 0
    assert d.find_leaks(documents(spark, []), one).count() == 0
    assert d.find_leaks(documents(spark, [(1, "nothing known here")]), one).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=40), st.lists(st.integers(0, 7), max_size=60))
def test_common_length(item, text):
    table = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item):
        for j, b in enumerate(text):
            table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
    assert d.common_length(np.array(item), np.array(text, dtype=int)) == table[-1][-1]


def test_singular_vectors_are_those_of_the_passage_matrix(spark):
    rows = [(k, prose(k, 100, stock(0))) for k in range(40)]
    bench = spark.createDataFrame([(k, prose(500 + k, 40, stock(0)), "x") for k in range(5)], ITEMS)
    b = d.read_benchmark(bench)
    texts = d.numbered(documents(spark, rows), b)
    size = len(b.vocabulary) + 1
    space = d.fit_space(texts, size, rank=6, oversampling=1000)
    blocks, _ = d._laid_out([bytes(r["words"]) for r in texts.collect()])
    passages = np.concatenate([blocks[:-1], blocks[1:]], axis=1)
    counts = np.zeros((len(passages), size))
    np.add.at(counts, (np.arange(len(passages))[:, None], passages), 1)
    counts[:, 0] = 0
    idf = np.log1p((counts.sum(axis=1) > 0).sum() / np.maximum((counts > 0).sum(axis=0), 1))
    exact = np.linalg.svd(counts * idf, compute_uv=False)[:6]
    assert np.allclose(space.singular, exact, rtol=0.01)

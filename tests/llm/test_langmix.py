import numpy as np

from emberline.llm import langmix
from tests.llm.helpers import documents, prose, with_clashes

EN = "the of and that river stone light paper garden window"
DE = "der die und nicht fluss stein licht papier garten fenster über größe"
FR = "le la et que rivière pierre lumière papier jardin fenêtre"


def corpus():
    rows = [(k, prose(k, 40, stock), lang) for k, (stock, lang) in enumerate([(EN, "en"), (DE, "de"), (FR, "fr")] * 30)]
    return rows


def test_held_out_accuracy_and_mixtures(spark):
    docs = with_clashes(documents(spark, corpus()))
    model = langmix.fit(docs.filter(~langmix.held_out()))
    assert model.languages == ("de", "en", "fr")
    found = {r["doc_id"]: r for r in langmix.identify(docs, model).collect()}
    assert all(found[k]["lang_pred"] == lang for k, _, lang in corpus())
    mixed = documents(spark, [(1, prose(900, 120, EN) + " " + prose(901, 60, DE)), (2, prose(902, 80, FR))])
    got = {r["doc_id"]: r for r in langmix.identify(mixed, model).collect()}
    assert got[1]["lang_pred"] == "en" and got[1]["languages"][:2] == ["en", "de"] and 0.2 < got[1]["shares"][1] < 0.5
    assert got[2]["languages"] == ["fr"] and got[2]["score"] > 0.99


def test_texts_without_letters_and_rows_without_language(spark):
    docs = documents(spark, [*corpus(), (500, None, "en"), (501, "", None), (502, "12 ... !", "de"), (503, prose(5, 30, DE), None), (None, prose(6, 30, FR), "fr"), (504, "ÜÖÄ", None)])
    model = langmix.fit(docs.filter(~langmix.held_out()))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langmix.identify(docs, model).collect()}
    assert got[500] == got[501] == got[502] == ("und", 0.0)
    assert got[503][0] == "de" and got[None][0] == "fr" and got[504][0] in model.languages
    assert all(0 <= score <= 1 for _, score in got.values())
    kept = langmix.relabel(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} & {500, 501, 502} == set()


def test_no_training_rows_and_empty_table(spark):
    model = langmix.fit(documents(spark, [(1, "abc", None)]))
    assert [(r["lang_pred"], r["score"]) for r in langmix.identify(documents(spark, [(1, "abc")]), model).collect()] == [("und", 0.0)]
    assert langmix.identify(documents(spark, []), model).count() == 0


def test_em_finds_known_proportions():
    rng = np.random.default_rng(0)
    share = rng.dirichlet(np.full(langmix.GRAMS, 0.05), size=2)
    model = langmix.LanguageModel(("a", "b"), share + 1e-9)
    counts = rng.multinomial(3000, 0.7 * share[0] + 0.3 * share[1]).reshape(1, -1)
    chosen, _ = langmix.proportions(counts, model)
    assert abs(chosen[0, 0] - 0.7) < 0.05

import re
from collections import Counter

from emberline.llm import cascade
from tests.llm.helpers import documents, prose, with_clashes

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    three = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    uses = Counter(three)
    covered = {k + j for k, t in enumerate(three) if uses[t] > 1 for j in range(3)}
    n = len(words)
    row = (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    lettered = sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", w)) for w in words)
    top = max(Counter(words).values(), default=0)
    bad = (n < 50 or n > 1_000_000 or row[1] < 2 * n or row[1] > 15 * n or 10 * row[2] > n or 10 * row[3] > 3 * len(lines)
           or 100 * row[4] > 50 * n or 10 * lettered < 7 * n or 10 * top > 3 * n)
    return (*row, not bad)


def test_measures_and_verdicts(spark):
    texts = [None, "", " \n ", "a b a b a b", prose(1, 49), prose(1, 50), prose(2, 300), "same line here\n" * 30 + prose(3, 200), "wörter ünd Straße " * 40,
             " ".join("12 34 ; ..".split() * 40), prose(4, 100) + " ###" * 30, "a\x0bb\x0cc\rd\te\nf \x1c g\xa0h", "x " * 60_000, "Supercalifragilistic" * 20 + " " + prose(6, 20)]
    rows = list(enumerate(texts)) + [(2, texts[6]), (None, texts[6])]
    got = cascade.filter_quality(with_clashes(documents(spark, rows)), measures=BASE).collect()
    want = sorted((str(key), *map(str, brute(text))) for key, text in rows)
    assert sorted((str(r["doc_id"]), *(str(r[c]) for c in (*BASE, "kept"))) for r in got) == want
    assert all((r["rejected_by"] is None) == r["kept"] for r in got)


def test_any_order_gives_the_same_verdicts(spark):
    docs = documents(spark, [(k, prose(k, 20 + 9 * k) + " ###" * (k % 7)) for k in range(30)])
    names = [r.name for r in cascade.RULES]
    a = {r["doc_id"]: r["kept"] for r in cascade.run_cascade(docs, names).collect()}
    b = {r["doc_id"]: r["kept"] for r in cascade.run_cascade(docs, names[::-1]).collect()}
    assert a == b and {True, False} == set(a.values())


def test_order_is_by_rejection_per_cost(spark):
    docs = documents(spark, [(k, "a b") for k in range(40)] + [(99, prose(1, 80))])
    profile = cascade.profile_rules(docs)
    worth = [gone / max(cost, 1e-9) for _, cost, gone in profile]
    assert worth == sorted(worth, reverse=True) and profile[0][2] > 0.9


def test_empty_table(spark):
    assert cascade.filter_quality(documents(spark, [])).count() == 0

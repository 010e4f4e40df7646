from emberline.llm import html_template as h
from tests.llm.helpers import prose

SCHEMA = "page_id long, url string, html string, host string, path string"


def page(k: int, style: int) -> tuple[str, str]:
    title, paragraphs = f"Title {k} &amp; more", [prose(10 * k + j, 12 + 5 * j) for j in range(2 + k % 4)]
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    furniture = f"<nav><ul>{''.join(f'<li><a href=/{j}>menu {j}</a>' for j in range(6))}</ul></nav>"
    foot = "<footer>&copy; example <a href=/>home</a></footer>"
    want = " ".join([f"Title {k} & more", *paragraphs])
    if style == 0:
        html = f"<!DOCTYPE html><html><head><title>x</title><script>var t='<p>no</p>';</script></head><body>{furniture}<article><h1>{title}</h1>{body}<section class='comments'><p>First! {prose(k, 9)}</p></section></article><aside>side {prose(k, 20)}</aside>{foot}</body></html>"
    elif style == 1:
        html = (f"<html><body class=page><div id=top-menu>menu here</div><div class='content-area'><h1>{title}</h1><div class='text'>{body}</div><div class='ad'>buy {prose(k, 30)}</div>"
                f"<form><input name=q><button>Go</button></form></div><div class='cookie-notice'>We use cookies {prose(1, 25)}</div>{foot}")
    else:
        html = f"<body><main><h1>{title}</h1><b>{paragraphs[0]}</b><br>{'<br/>'.join(paragraphs[1:])}</main><!-- <p>gone</p> --><div class=sidebar>{prose(k, 40)}</div></body>"
    return html, want


def test_main_text_of_three_templates(spark):
    rows, want = [], {}
    for style, host in enumerate(("a.example", "b.example:80", "c.example")):
        for k in range(12):
            html, text = page(k, style)
            key = 100 * style + k
            rows.append((key, f"http://{host}/{k}", html, "x", "y"))
            want[key] = text
    html, text = page(50, 0)
    rows += [(900, "http://alone.example/", html, "x", "y"), (901, None, html, "x", "y"), (902, "not a url", "", "x", "y"), (903, "http://a.example/n", None, "x", "y"),
             (904, "http://a.example/t", "plain &lt;text&gt;  only", "x", "y"), (904, "http://a.example/t", "plain &lt;text&gt;  only", "x", "y"), (905, "http://a.example/b", "<", "x", "y"),
             (906, "http://a.example/v", "<article><p>" + "long words " * 100_000 + "</p>", "x", "y")]
    want |= {900: text, 901: text, 902: "", 903: "", 904: "plain <text> only", 905: "", 906: ("long words " * 100_000).strip()}
    got = h.extract(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == want[r["page_id"]], r["page_id"]
        assert r["n_chars"] == len(r["text"])


def test_both_ways_to_the_best_nodes_agree(spark, monkeypatch):
    rows = [(k, f"http://h{k % 3}.example/{k}", page(k, k % 3)[0], "x", "y") for k in range(30)]
    pages = spark.createDataFrame(rows, SCHEMA)
    one = {r["page_id"]: r["text"] for r in h.extract(pages).collect()}
    monkeypatch.setattr(h, "BROADCAST_HOSTS", 0)
    assert {r["page_id"]: r["text"] for r in h.extract(pages).collect()} == one


def test_classes_hold_tokens_with_one_vector(spark):
    rows = [("h", k, page(k, 0)[0]) for k in range(6)]
    sums = h.token_sums(spark.createDataFrame(rows, "host string, page long, html string"))
    template = {r["path"]: r for r in h.templates(sums.filter("host = 'h'")).collect()}
    assert ">html>body>article>h1" in template and ">html>body>article>p" not in template
    assert template[">html>body>article"]["class_tokens"] >= 8
    best = h.best_nodes(h.templates(sums.filter("host = 'h'"))).first()["nodes"]
    assert best[0] == ">html>body>article"


def test_omitted_tags_and_sibling_blocks_keep_their_text(spark):
    bare = {
        "body omitted": ("<h1>T{k}</h1><p>a{k}</p><p>b{k}</p>", "T{k} a{k} b{k}"),
        "html only": ("<html><p>a{k}</p><p>b{k}</p></html>", "a{k} b{k}"),
        "paragraphs only": ("<p>a{k}<p>b{k}", "a{k} b{k}"),
        "head not closed": ("<!DOCTYPE html><title>x</title><meta charset=utf-8><p>a{k}</p><ul><li>b{k}</ul>", "a{k} b{k}"),
        "siblings": ("<body class='header-fixed'><nav>menu</nav><h1>T{k}</h1><div class=text>a{k} words</div><div class=more>b{k} words</div><footer>f</footer></body>", "T{k} a{k} words b{k} words"),
        "after the body": ("<html><body><p>a{k}</p></body></html><p>b{k}</p>", "a{k} b{k}"),
        "links only": ("<div class=list><a href=/>a{k}</a></div><nav>menu</nav>", "a{k}"),
        "no tag": ("a{k} < b and <c", "a{k} < b and <c"),
    }
    rows, want = [], {}
    for n, (html, text) in enumerate(bare.values()):
        for k in range(4):  # a host of three pages, and a host of one
            key = 10 * n + k
            rows.append((key, f"http://{'one' if k == 3 else 'h'}{n}.example/{k}", html.replace("{k}", str(k)), "x", "y"))
            want[key] = text.replace("{k}", str(k))
            assert h.page_text(rows[-1][2], []) == want[key], (n, k)
    got = {r["page_id"]: r["text"] for r in h.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_empty_table(spark):
    assert h.extract(spark.createDataFrame([], SCHEMA)).count() == 0

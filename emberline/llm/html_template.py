"""Main text by equivalence-class template deduction over the pages of a host.

Tokens are opening tags in their role: the path of labels (tag, class, id) from the root.
A token's occurrence vector says how often it stands on each page of its host. Vectors are
never held: tasks combine, for each (host, token), its support and the exclusive or of
hashes of (page, count), so that tokens with equal vectors have equal sums. Tokens with
one vector form an equivalence class. A class is valid when it is frequent on its host and
its tokens stand once on each of their pages; valid classes nest along their paths into
the host's template. What lies between template tokens are the slots; those that hold more
text than links and are not page furniture count. The main text is the node around them: the
outermost article or main, if slots lie in one, else the child of the body that holds them
all, else, when siblings hold them, what contains the siblings. It is cut out of each page,
without the furniture nested in it.

Every page has a html and a body, whether their tags are written or not; their classes
and ids do not count, and what follows the body's end still belongs to it.

A host of one page, and pages without any of their host's nodes, use the template that
is deduced over all hosts in the same way, then their own tokens, then the whole page less
its furniture. A text without any tag is kept whole. Host sums are combined inside tasks, so
a host may hold any share of the pages.

Null and empty html give an empty text. Repeated rows get equal texts; a null url is a
host of its own. Extra columns are not read. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import drop_scratch, materialize, slices

#: Share of a host's pages on which a class must occur.
FREQUENT = 0.5
#: Hosts up to which the table of best nodes is sent to every task; beyond, pages are joined to it.
BROADCAST_HOSTS = 50_000
SALTS = 16
ALL_HOSTS = "*"
HTML, BODY = ">html", ">html>body"

# Fixed values of HTML: elements without content, elements that flow in a line, and raw text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong "
                   "sub sup time tt u var wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed".split())
FURNITURE_TAGS = frozenset("head nav header footer aside form button select menu dialog svg canvas object audio video script style title textarea "
                           "noscript iframe template xmp noembed".split())
FURNITURE_NAMES = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo comment comments disqus replies respond sidebar menu nav "
                            "navbar navigation breadcrumb breadcrumbs notice notices cookie cookies consent popup modal newsletter subscribe share "
                            "sharing social related footer header masthead toolbar widget login signup".split())
HEAD_TAGS = frozenset("base link meta noscript script style template title".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p "
                     "pre section table ul".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*+(?:>|\Z)))", re.S)
_COMPLETE = re.compile(r"<(?:/?[a-zA-Z]|[!?])[^>]*>")
_NAMED = re.compile(r"""\b(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def label(tag: str, attributes: str) -> str:
    """tag.class#id; names with digits, which number their nodes, are left out."""
    out = tag
    if "=" in attributes:
        for kind, *values in _NAMED.findall(attributes):
            names = [n for n in "".join(values).lower().split() if not any(c.isdigit() for c in n) and ">" not in n]
            if names:
                out += ("." if kind.lower() == "class" else "#") + " ".join(sorted(names))
    return out


def is_furniture(name: str) -> bool:
    """Whether a label is that of a menu, header, footer, notice, advert, form, script or comment."""
    tag = re.split(r"[.#]", name, maxsplit=1)[0]
    return tag in FURNITURE_TAGS or not FURNITURE_NAMES.isdisjoint(re.split(r"[^a-z0-9]+", name[len(tag):]))


def walk(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", path, tag), ("break", path, tag) and ("text", path, text) in page order."""
    stack: list[tuple[str, str]] = []  # tag, path; of the head or below the body
    at = 0
    path = root = ""  # root: HTML before the body has begun, then BODY

    def begun(body: bool) -> Iterator[tuple[str, str, str]]:
        nonlocal path, root
        if not root:
            path = root = HTML
            yield "open", HTML, "html"
        if body and root == HTML:
            stack.clear()
            path = root = BODY
            yield "open", BODY, "body"

    for found in iter(lambda: _TAG.search(page, at), None):
        if found.start() > at:
            value = page[at:found.start()]
            if root != BODY and not value.isspace():
                yield from begun(True)
            yield "text", path, value
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag or tag in ("html", "body") and root == BODY and k == 0:
                    del stack[k:]
                    path = stack[-1][1] if stack else root
                    break
            yield "break", path, tag
            continue
        if root != BODY:
            yield from begun(tag not in HEAD_TAGS and tag not in ("html", "head"))
        if tag in ("html", "body") or tag == "head" and (stack or root == BODY):
            continue
        if tag in CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            ends = ("p",) if tag in CLOSES_P else ("dt", "dd") if tag in ("dt", "dd") else (tag,)
            limit = ("ul", "ol", "dl", "table", "div", "article", "section", "body", "td")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in limit:
                    break
        parent = stack[-1][1] if stack else root
        own = f"{parent}>{label(tag, found[3])}"
        yield "open", own, tag
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = len(page) if end is None else end.start()
        elif tag not in VOID and not found[3].endswith("/>"):
            stack.append((tag, own))
        path = stack[-1][1] if stack else root
    if at < len(page):
        if root != BODY and not page[at:].isspace():
            yield from begun(True)
        yield "text", path, page[at:]


def page_tokens(page: str) -> dict[str, list[int]]:
    """path -> [times, characters of text directly in it, of these in links]."""
    out: dict[str, list[int]] = {}
    for kind, path, value in walk(page):
        if kind == "open":
            out.setdefault(path, [0, 0, 0])[0] += 1
        elif kind == "text" and not value.isspace():
            row = out.setdefault(path, [0, 0, 0])
            row[1] += len(value)
            if ">a>" in f"{path}>" or ">a." in path or ">a#" in path:
                row[2] += len(value)
    return out


def main_text(page: str, node: str) -> str | None:
    """The text in the node, without furniture; None if the page has no such node."""
    parts: list[str] = []
    seen = False
    furniture: dict[str, bool] = {}
    inside = f"{node}>"
    for kind, path, value in walk(page):
        if path != node and not path.startswith(inside):
            continue
        seen = True
        if kind == "text":
            if path not in furniture:
                furniture[path] = any(map(is_furniture, filter(None, path[len(node):].split(">"))))
            if not furniture[path]:
                parts.append(value)
        elif value not in INLINE:
            parts.append(" ")
    return " ".join(entities.unescape("".join(parts)).split()) if seen else None


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def token_sums(pages: DataFrame) -> DataFrame:
    """(host, path, pages, vector, most, chars, links) for each host and over all hosts."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], list[int]] = {}

        def rows() -> pa.RecordBatch:
            hosts, paths = zip(*sums, strict=True)
            counts = list(zip(*sums.values(), strict=True))
            return pa.record_batch([pa.array(hosts), pa.array(paths), *(pa.array(c, pa.int64()) for c in counts)],
                                   names=["host", "path", "pages", "vector", "most", "chars", "links"])

        for batch in slices(batches, "html"):
            for host, page, value in zip(batch.column("host").to_pylist(), batch.column("page").to_pylist(), batch.column("html").to_pylist(), strict=True):
                tokens = page_tokens(value or "")
                for path, (times, chars, links) in tokens.items():
                    mark = int.from_bytes(hashlib.blake2b(f"{page}:{times}".encode(), digest_size=8).digest(), "little", signed=True)
                    for name in (host, ALL_HOSTS):
                        row = sums.setdefault((name, path), [0, 0, 0, 0, 0])
                        row[0] += times > 0
                        row[1] ^= mark
                        row[2] = max(row[2], times)
                        row[3] += chars
                        row[4] += links
            if len(sums) > 200_000:
                yield rows()
                sums.clear()
        if sums:
            yield rows()

    schema = "host string, path string, pages long, vector long, most long, chars long, links long"
    return (pages.mapInArrow(summed, schema).groupBy("host", "path")
            .agg(F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"), F.max("most").alias("most"),
                 F.sum("chars").alias("chars"), F.sum("links").alias("links")))


def templates(sums: DataFrame) -> DataFrame:
    """(host, path, class_tokens, slot_chars, slot_links): the nested valid classes with their slots' text."""
    size = sums.groupBy("host").agg(F.max("pages").alias("host_pages"))
    classes = sums.filter("most = 1").groupBy("host", "vector", "pages").agg(F.count("*").alias("class_tokens"))
    valid = (sums.filter("most = 1").join(classes, ["host", "vector", "pages"]).join(size, "host")
             .filter((F.col("pages") >= FREQUENT * F.col("host_pages")) & (F.col("host_pages") > 1)).select("host", "path", "class_tokens"))
    # a token's text belongs to the innermost template token around it
    steps = F.split(F.substring(F.col("path"), 2, 1 << 20), ">")
    around = F.transform(F.sequence(F.lit(1), F.size("steps")), lambda k: F.concat(F.lit(">"), F.array_join(F.slice("steps", 1, k), ">")))
    up = (sums.filter("chars > 0 AND path <> ''").withColumn("steps", steps).select("host", "path", "chars", "links", F.explode(around).alias("above")))
    template = valid.select("host", F.col("path").alias("above"), "class_tokens")
    innermost = (up.join(template, ["host", "above"])
                 .groupBy("host", "path").agg(F.max_by("above", F.length("above")).alias("slot"), F.first("chars").alias("chars"), F.first("links").alias("links")))
    slots = innermost.groupBy("host", F.col("slot").alias("path")).agg(F.sum("chars").alias("slot_chars"), F.sum("links").alias("slot_links"))
    return valid.join(slots, ["host", "path"], "left").fillna(0, ["slot_chars", "slot_links"])


def _top(slot: str) -> tuple[str, bool] | None:
    """The highest node around a slot, and whether it is an article or main; None for furniture and what is not in the body."""
    if slot != BODY and not slot.startswith(f"{BODY}>"):
        return None
    steps = slot.split(">")[3:]
    if any(map(is_furniture, steps)):
        return None
    for k, step in enumerate(steps):
        if re.split(r"[.#]", step, maxsplit=1)[0] in ("article", "main"):
            return ">".join([BODY, *steps[:k + 1]]), True
    return ">".join([BODY, *steps[:1]]), False


def _around(slots: list[str]) -> list[str]:
    """The node that contains all slots in an article or main, then the one that contains the others."""
    tops = [top for top in map(_top, slots) if top]
    out = []
    for marked in (True, False):
        steps = [node.split(">") for node, own in tops if own is marked]
        if steps:
            same = next((k for k, step in enumerate(zip(*steps)) if len(set(step)) > 1), min(map(len, steps)))  # noqa: B905  the shortest ends it
            out.append(">".join(steps[0][:same]))
    return out


def best_nodes(template: DataFrame) -> DataFrame:
    """(host, nodes): nodes to cut out, best first; a row for each host with a slot that counts."""

    @F.udf("array<string>")
    def around(slots):
        return _around(slots)

    # a host's slots are nodes that stand once on its pages, so they are few
    slots = template.filter(F.col("slot_chars") > 2 * F.col("slot_links")).groupBy("host").agg(F.collect_set("path").alias("slots"))
    return slots.select("host", around("slots").alias("nodes")).filter(F.size("nodes") > 0)


def _own_nodes(page: str) -> list[str]:
    """The nodes by the page's own tokens, for pages that no template fits."""
    tokens = page_tokens(page)
    once = {path for path, row in tokens.items() if row[0] == 1}
    sums: dict[str, int] = {}
    for path, (_, chars, links) in tokens.items():
        steps = path[1:].split(">")
        slot = next((p for k in range(len(steps), 0, -1) if (p := ">" + ">".join(steps[:k])) in once), None)
        if slot and chars:
            sums[slot] = sums.get(slot, 0) + chars - 2 * links
    return _around([slot for slot, score in sums.items() if score > 0])


def page_text(page: str, nodes: list[str]) -> str:
    """The main text by the first node that the page has, else the whole page less its furniture."""
    if not page.strip():
        return ""
    if not _COMPLETE.search(page):
        text = " ".join(entities.unescape(page).split())
        return text if text.strip("<> ") else ""
    for node in nodes:
        text = main_text(page, node)
        if text:
            return text
    for node in [*_own_nodes(page), BODY]:
        text = main_text(page, node)
        if text:
            return text
    return ""


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    spark = pages.sparkSession
    rows = pages.select(F.col(key), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), _host(F.col(url)).alias("host"))
    sums = materialize(token_sums(rows.select("host", "html", F.xxhash64(F.col(key), F.col("url")).alias("page"))), "page-tokens")
    nodes = materialize(best_nodes(templates(sums)), "page-nodes")
    everywhere = nodes.filter(F.col("host") == ALL_HOSTS).select("nodes").collect()  # one row, two paths at most
    common = list(everywhere[0]["nodes"]) if everywhere else []
    own = nodes.filter(F.col("host") != ALL_HOSTS)
    if own.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(own), "host", "left")
    else:
        spread = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64(key, "url"), F.lit(SALTS)).cast("int")).join(spread, ["host", "salt"], "left")
    kind = pages.select(key).schema.simpleString()[7:-1].replace(":", " ", 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [page_text(page or "", list(dict.fromkeys([*(best or []), *common])))
                     for page, best in zip(batch.column("html").to_pylist(), batch.column("nodes").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(key), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                  names=[key, "url", "text", "n_chars"])

    return joined.select(key, "url", "html", "nodes").mapInArrow(cut, f"{kind}, url string, text string, n_chars long")

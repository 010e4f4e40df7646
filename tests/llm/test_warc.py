import gzip
import hashlib

from emberline.llm import warc

SCHEMA = "page_id long, url string, html string, salt string, first string"


def brute(rows):
    out = []
    for i, _, page in rows:
        body = (page or "").encode()
        same = [j for j, _, p in rows if j is not None and (p or "").encode() == body]
        first = min(same) if len(body) >= 100 and same else None
        revisit = first is not None and i != first
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    long_page = "<p>é" * 40
    rows = [(5, "http://a/x y\r\nX: 1", long_page), (3, None, long_page), (9, "http://b", long_page), (1, "u", ""), (2, "u", None), (4, "u", "short"), (6, "u", "short"),
            (7, "v", "a" * 100), (8, "v", "a" * 99), (10, "v", "a" * 100), (10, "v", "a" * 100), (None, "n", long_page), (None, "n", "z" * 500), (11, "w", "q\r\n\r\n" * 50_000)]
    pages = spark.createDataFrame([(*r, "s", "f") for r in rows], SCHEMA).repartition(3)
    folder = str(tmp_path / "archives")
    got = warc.write_and_read(pages, folder).collect()
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=str) == brute(rows)
    assert all(r["digest_valid"] for r in got)
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "archives").glob("*.warc.gz"))
    assert raw.count(b"WARC/1.1\r\n") == len(rows) and b"\r\nX: 1" not in raw
    refer = {r["refers_to_record"] for r in got if r["record_type"] == "revisit"}
    assert refer <= {r["record_id"] for r in got if r["record_type"] == "response"}


def test_empty_table(spark):
    assert warc.write_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

"""Main text and archives."""

import base64
import hashlib

import duckdb
import pytest

from palisade.llm import html, queries, warc
from tests.compare import TABLES

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style></head><body class="has-sidebar"><header class=top><h1>Site</h1></header>
<nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div><main><article><header><h1>Title &amp; co</h1><div class="share">Share</div><span>byline</span></header>
<p>One<br>two &nbsp; three<p>Four <b>five</b>&#33;<ul><li>a<li>b</ul><div class='ad-box'>buy<p>now</div><script>if(a<b){"</p>"}</script>text a < b tail<blockquote>q</blockquote>
<table><tr><td>1<td>2</table><section id="comments"><article>comment</article></section><form>f</form><!-- c --></article></main><aside>Side</aside><footer>&copy; F</footer><div hidden>h</div></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "Title & co|One two three|Four five!|a|b|text a < b tail|q|1|2"),
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt;", "plain <text>"),
        ("<p>a<p>b<!-- never ends", "a|b"),
        ("<a title='x>y'>z</a> <b x=\"open>k</b> t", "z k t"),
        ("<div>a <div>b</div> c</div>", "a|b|c"),
        ("<ARTICLE>Up<NAV>no</NAV></ARTICLE>rest", "Up"),
        ("<script>never closed <p>x", ""),
        ("<article><p>x</p></article><article class=comment>y</article>", "x"),
        ('<div role="main"><p>m</p></div><p>o</p>', "m"),
        ('<div class="post-content"><p>m</p></div><div>o</div>', "m"),
        ("<main><p>m</p><article><p>x</p></article></main>", "x"),
        ("<p>a</b></i></p>b</div>", "a|b"),
        ("<article>1 &lt; 2 &amp;amp; é&#x1F600;</article>", "1 < 2 &amp; é😀"),
        ("< p>x <3 y", "< p>x <3 y"),
        ("<svg><text>s</text></svg><p>t <select><option>o</select>u<button>x</button>", "t u"),
    ],
)
def test_main_text(page, text):
    got = html.main_text(html.Page(page))
    assert " ".join(got.replace("\n\n", "|").split()) == " ".join(text.split())


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", '<a "' * 30_000, "</b>" * 50 + "<p>" * 30_000, "<b>" * 30_000 + "</i>" * 30_000, "<!--" * 30_000, "&#" * 30_000])
def test_odd_pages_end(page):
    html.main_text(html.Page(page))


def pages(spark):
    rows = []
    for i in range(8):
        rows.append((i, "http://a.com/x", f"<div><b>Share this</b></div><div><p>Story number {i} goes on</p></div><div>Subscribe now</div>"))
        rows.append((100 + i, f"https://user@B.com:80/{i}?q", f"<article><p>Always the same</p><p>{i}</p></article><nav>n</nav>"))
    return spark.createDataFrame([*rows, (None, None, None), (7, "http://a.com/x", rows[14][2])], "page_id long, url string, html string")


def test_template_of_a_host(spark):
    """Without a marked article, what is the same on a host's pages is template; in an article it stays."""
    got = {r.page_id: r["__text"] for r in html.extracted(pages(spark)).collect()}
    assert got[3] == "Story number 3 goes on"
    assert got[103] == "Always the same\n\n3"
    assert got[None] == ""
    hosts = {r.host: r for r in html.templates(pages(spark)).collect()}
    article = html.token(0, "article")
    assert set(hosts) == {"a.com", "b.com"}
    assert hosts["b.com"].slot == article
    assert hosts["b.com"].constant == [html.token(html.token(article, "p"), "Always the same")]
    assert hosts["b.com"].fixed == []
    assert hosts["a.com"].slot is None
    assert html.extracted(pages(spark).limit(0)).count() == 0


def test_texts_that_all_articles_have(spark):
    rows = [(i, "http://c.org/", f"<article><p>Sign up today</p><p>{'Copied story' if i % 3 else f'Story {i}'}</p></article>") for i in range(30)]
    got = {r.page_id: r["__text"] for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3"
    assert got[4] == "Copied story"


def test_op7(spark):
    got = queries.op7_main_text(spark, TABLES).collect()
    raw = dict(duckdb.connect().sql(f"SELECT page_id, html FROM '{TABLES}/pages.parquet'").fetchall())
    assert len(got) == len(raw)
    for r in got:
        assert r.n_chars == len(r.text)
        assert r.text
        assert "<" not in r.text or "&lt;" in raw[r.page_id]


# WARC

ROWS = [(0, "http://a", "x"), (1, "http://b", "x"), (2, "u v", None), (3, "u", ""), (4, None, "é" * 200_000), (5, "q", "y"), (None, "z", "y"), (None, "z", "lone"), (6, "u", "x"), (0, "http://a", "x")]


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_archives(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, digest int").repartition(3)
    got = warc.archived(df, f"{tmp_path}/w")
    rows = got.select(warc.page_of("record_id").alias("page"), warc.page_of("refers_to").alias("ref"), "*").collect()
    assert len(rows) == len(ROWS)
    payloads = dict((p, h) for p, _, h in ROWS if p is not None)
    refers = {1: 0, 3: 2, 6: 0}
    for r in rows:
        if r.page is not None:
            raw = (payloads[r.page] or "").encode()
            assert (r.payload_bytes, r.payload_digest) == (len(raw), b32(payloads[r.page]))
            assert r.ref == refers.get(r.page)
            assert r.record_type == ("revisit" if r.page in refers else "response")
            assert r.payload == (None if r.page in refers else bytearray(raw))
    assert sorted((r.record_type, r.ref) for r in rows if r.page is None) == [("response", None), ("revisit", 5)]
    found = warc.read(spark, f"{tmp_path}/w", record_type=["revisit"], target_uri=["http://b", "u"])
    assert sorted(r.record_id for r in found.collect()) == ["urn:x-page:1", "urn:x-page:3", "urn:x-page:6"]
    with pytest.raises(ValueError, match="payload_bytes"):
        warc.read(spark, f"{tmp_path}/w", payload_bytes=["1"])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pushed = spark.read.format("warc").options(path=f"{tmp_path}/w", pushdown="true").load().filter("record_type = 'revisit' AND target_uri IN ('http://b', 'u')")
    assert "Filter (" not in pushed._jdf.queryExecution().executedPlan().toString()
    assert pushed.count() == 3
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    small = warc.read(spark, f"{tmp_path}/w", payload=False, split_bytes=1)
    assert small.filter("payload IS NOT NULL").count() == 0
    assert small.count() == len(ROWS)
    for manifest in (tmp_path / "w").glob("_manifest*"):
        manifest.unlink()
    assert got.count() == len(ROWS)
    assert warc.archived(df.limit(0), f"{tmp_path}/e").count() == 0


def test_appending_keeps_what_is_there(spark, tmp_path):
    for part in (0, 3):
        df = spark.createDataFrame([(part + i, "u", f"page {part + i}") for i in range(3)], "page_id long, url string, html string")
        warc.write(df, f"{tmp_path}/w")
    got = warc.read(spark, f"{tmp_path}/w").select(warc.page_of("record_id").alias("p"), "payload").collect()
    assert sorted((r.p, bytes(r.payload)) for r in got) == [(i, f"page {i}".encode()) for i in range(6)]


def test_a_retried_task(tmp_path):
    """What a lost attempt has written isn't read, with or without its successor's archive beside it."""
    import pyarrow as pa

    row = {"record_id": "urn:x-page:1", "record_type": "response", "target_uri": "u", "payload": b"x", "digest": hashlib.sha1(b"x").hexdigest(), "refers_to": None}
    writer = warc.WarcWriter({"path": str(tmp_path)})
    writer.write(iter([pa.RecordBatch.from_pylist([row])]))  # its message is lost
    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist([row])]))])
    assert len(list(tmp_path.glob("*.warc.gz"))) == 2
    reader = warc.WarcReader({"path": str(tmp_path)})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1


def test_minimum_size_of_revisits(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    assert warc.records(df, 2).filter("record_type = 'revisit'").count() == 0


def test_many_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT_BYTES", 200)
    store, path = warc.place(str(tmp_path / "s"))
    import pyarrow as pa

    rows = [{"record_id": f"urn:x-page:{i}", "record_type": "response", "target_uri": "u", "payload": bytes([i]) * i * 50, "digest": hashlib.sha1(bytes([i]) * i * 50).hexdigest(), "refers_to": None} for i in range(60)]
    writer = warc.WarcWriter({"path": path})
    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist(rows)])), None])
    reader = warc.WarcReader({"path": path, "split_bytes": "200"})
    parts = reader.partitions()
    assert len(parts) > 10
    got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [r["payload"] for r in got] == [x["payload"] for x in rows]
    damaged = next(p for p in (tmp_path / "s").iterdir() if p.name.endswith(".gz"))
    damaged.write_bytes(damaged.read_bytes()[:-3])
    with pytest.raises(ValueError, match="ends within"):
        [b for p in parts for b in reader.read(p)]


def test_op8(spark):
    expected, first = [], {}
    raw = sorted(duckdb.connect().sql(f"SELECT page_id, html FROM '{TABLES}/pages.parquet'").fetchall())
    for p, h in raw:
        f = first.setdefault(h or "", p)
        expected.append((p, len((h or "").encode()), b32(h), "response" if f == p else "revisit", None if f == p else f))
    assert sorted(map(tuple, queries.op8_warc(spark, TABLES).collect())) == expected

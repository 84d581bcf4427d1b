"""Templates deduced from a host's pages."""

import random
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from palisade.llm import html

TABLES = "/root/testdata/sf0.1"
NAMELESS = [("<nav>", '<div class="qa">'), ("</nav>", "</div>"), ('<div class="ad">', '<div class="qb">'), ("<article>", '<div class="qc">'), ("</article>", "</div>"), ("<footer>", '<div class="qd">'), ("</footer>", "</div>")]


def texts(df):
    return {r.page_id: r["__text"] for r in html.extracted(df).collect()}


def test_without_names_the_template_finds_the_article(spark):
    """The pages of the table, their elements renamed so that no name tells anything: the main text is that of the named pages. Without templates it isn't."""
    rows = duckdb.connect().sql(f"SELECT page_id, url, html FROM '{TABLES}/pages.parquet' WHERE url LIKE '%blog.%' ORDER BY 1").fetchall()
    count = defaultdict(int)
    for _, u, _ in rows:
        count[u.split("/")[2]] += 1
    rows = [r for r in rows if count[r[1].split("/")[2]] >= 20]
    plain = []
    for p, u, h in rows:
        for old, new in NAMELESS:
            h = h.replace(old, new)
        plain.append((p, u, h))
    named = {p: html.main_text(html.Page(h)) for p, _, h in rows}
    assert len(rows) > 300
    got = texts(spark.createDataFrame(plain, "page_id long, url string, html string"))
    assert sum(got[p] == named[p] for p in named) >= 0.99 * len(named)
    assert not any(html.main_text(html.Page(h)) == named[p] for p, _, h in plain)


def slow_classes(pages):
    """Of one host: {token: (class, valid)}, by the definitions."""
    seen, distinct = set(), []
    for h in pages:
        s = html.seen(h)
        if s["same"] not in seen:
            seen.add(s["same"])
            distinct.append(s)
    n = len(distinct)
    vectors = defaultdict(lambda: [0] * n)
    around = {}
    for i, s in enumerate(distinct):
        for t in s["tags"]:
            vectors[t["h"]][i] = t["n"]
            around[t["h"]] = t["around"]
    groups = defaultdict(set)
    for h, v in vectors.items():
        on = sum(x > 0 for x in v)
        if (on > 1 or h == 0) and on * 100 >= (n + html.PRIOR) * html.SUPPORT:
            groups[tuple(v)].add(h)
    of = {h: min(g) for g in groups.values() for h in g}
    out = {}
    for g in groups.values():
        orders, ok = set(), True
        for s in distinct:
            run = [h for h in s["sequence"] if h in g]
            if run:
                orders.add(tuple(run[: len(g)]))
                ok &= run == run[: len(g)] * (len(run) // len(g)) and len(set(run[: len(g)])) == len(g)
        outer = {of.get(around[h]) for h in g if h and of.get(around[h]) != min(g)}
        out |= {h: (min(g), ok and len(orders) == 1 and (not outer or len(outer) == 1 and None not in outer)) for h in g}
    return out


def test_classes_by_brute_force(spark):
    rng = random.Random(8)
    hosts = {}
    for k in range(4):
        pages = []
        for i in range(9):
            items = "".join(f"<li><a>{rng.randrange(30)}</a><i>x</i></li>" for _ in range(rng.randrange(1, 4)))
            parts = [f"<ul>{items}</ul>", f"<div class=m><h2>T{i}</h2>" + "".join(f"<p>text {rng.random()}</p>" for _ in range(rng.randrange(1, 4))) + "</div>", "<div class=f><b>end</b><u>e</u></div>" if rng.random() < 0.9 else ""]
            if k % 2:
                rng.shuffle(parts)
            pages.append("<body>" + "".join(parts) + "</body>")
        hosts[f"h{k}.org"] = pages + pages[:3]
    rows = [(i, f"http://{h}/", p) for h, pages in hosts.items() for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    found = defaultdict(dict)
    for r in html.classes(html.different_pages(df)).collect():
        found[r.host][r.h] = (r["class"], r.valid)
    assert found == {h: slow_classes(p) for h, p in hosts.items()}
    assert any(not v for x in found.values() for _, v in x.values())
    assert any(v for x in found.values() for _, v in x.values())


def test_the_template_decides_against_a_mark_elsewhere(spark):
    """A marked teaser beside the main slot isn't the article."""
    rows = [(i, "http://t.org/", f"<div class=a1><div class=q><p>Story {i} {'goes on ' * 30}</p><p>and ends {i}</p></div><article>teaser {i}</article></div>") for i in range(12)]
    got = texts(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got[3] == " ".join(f"Story 3 {'goes on ' * 30}".split()) + "\n\nand ends 3"
    assert html.main_text(html.Page(rows[3][2])) == "teaser 3"


def test_pages_without_a_host(spark):
    rows = [(i, None, f"<p>shared</p><p>own {i}</p>") for i in range(12)] + [(99, "http://x.org", None), (98, "http://x.org", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    got = html.extracted(df)
    assert got.columns == ["page_id", "url", "html", "host", "__text"]
    assert {r.page_id: r["__text"] for r in got.collect()} == {i: f"shared\n\nown {i}" for i in range(12)} | {98: "", 99: ""}
    assert got.filter(F.col("__text").isNull()).count() == 0

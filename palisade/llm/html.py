"""Main text of web pages by templates deduced from a host's pages.

A page is read as tokens: start tags, told apart by the path of elements (with classes and ids) that leads to them.
The occurrence vector of a token says how often it is on each page of a host; pages with the same texts count as one. Tokens with equal vectors form
an equivalence class, if they are on enough pages (SUPPORT). A class is valid if it is ordered, that is if its tokens follow each other in one order, again and again, on each
page, and nested, that is if all of it lies within one other class. The valid classes make up the host's template; what lies between their tokens are its slots.
Nothing of a host is gathered in one task for this: vectors are their number of pages, their sum, and two sums (modulo 2) of hashes of (page, count),
which add up across partitions and are equal if the vectors are; orders are compared by hashes, too.

Texts that are the same on most of the host's pages belong to the template. Of the other text, outside of links, each slot's share is taken over all pages.
The main slot is the innermost element that the template has once a page and that holds MAIN hundredths of it. The main text is what this
slot holds on a page, but for the template's texts and for what is boilerplate by element, ARIA role or by a word of the class or id
(menus, headers, footers, sidebars, notices, adverts, forms, comments of readers). If a page marks its article or its main part, and that is within the main slot or around it, the mark breaks
the tie between the two. Where a host has too few pages for a template, the mark alone decides, and without one all text that isn't boilerplate.
In a main slot or a marked article, texts belong to the template only if nearly all pages have them (FIXED), and one that would be left empty stays as it is, so that copied stories stay.

Character references are decoded, white space in a block becomes one space, blocks are joined by two newlines.

Rows: null or empty html gives an empty text. Pages without a host have no template. Repeated pages
get equal texts; an empty table gives an empty table. Very long pages are read whole. Malformed markup is read as browsers do by and large: an unclosed element ends
with the one around it. Other columns are passed on, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import findable, stored, workspace

#: Share of a host's different pages (and PRIOR more that have nothing in common with them) that a token or text of the template is on, in hundredths.
SUPPORT, PRIOR = 60, 3
#: The same for texts within the main slot or a marked article.
FIXED, FIXED_PRIOR = 90, 1
#: Share of a host's text that the main slot holds, in hundredths.
MAIN = 80
#: Elements that name a path; deeper ones are read as the rest, but named as that far.
DEPTH = 60

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>|<[!?][^>]*>|[^<]+|<""", re.S)
UNENDED = re.compile(r"<(?:!--|[/?a-zA-Z])")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""")
HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|/|$)", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header"
    " hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose end is the end of an open p.
ENDS_P = BLOCKS - frozenset("html body head title option optgroup tbody thead tfoot tr td th legend summary li dd dt".split())
#: An element that begins ends an open one of these, up to the container.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
BOILERPLATE = frozenset("head nav header footer aside form script style noscript template iframe svg canvas object button select textarea dialog menu audio video search noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar tooltip".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal"
    " overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer copyright comment comments respond disqus reply replies share sharing social"
    " related recommended newsletter subscribe subscription signup login search pagination pager toolbar skip widget".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that can be a main slot.
CONTAINERS = frozenset("article body center details div main section table tbody td tr".split())
MAIN_NAMES = frozenset("article content post entry story main".split())


def token(around: int, name: str) -> int:
    """The hash, as a signed long, of the path of an element within another one, or of a text in a path."""
    h = xxhash.xxh3_64_intdigest(around.to_bytes(8, "little", signed=True) + name.encode("utf-8", "surrogatepass"))
    return (h if h < 1 << 63 else h - (1 << 64)) or 1


class Page:
    """blocks: (paths around it, how surely it is in the article, text, characters outside of links) of what isn't boilerplate, in page order. tags: (path, path around it, depth, container?) of all start tags.

    Boilerplate: 0 no, 1 in the header of an article, whose headings aren't, 2 yes. Article: 0 no, 1 by name, 2 the page's main part, 3 the article itself."""

    def __init__(self, html: str | None) -> None:
        self.blocks: list[tuple[tuple[int, ...], int, str, int]] = []
        self.tags: list[tuple[int, int, int, bool]] = []
        self.text: list[str] = []
        self.outside = 0
        self.place: tuple[tuple[int, ...], int] = ((), 0)  # paths and article of the block at hand
        # (tag, path, boilerplate, main) of the open elements
        self.open: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]
        self.count: Counter[str] = Counter()
        self.read(html or "")
        self.flush()

    def flush(self) -> None:
        if self.text:
            text = "".join(self.text)
            if text := " ".join((unescape(text) if "&" in text else text).split()):
                self.blocks.append((*self.place, text, self.outside))
            self.text = []
            self.outside = 0

    def add(self, text: str) -> None:
        _, _, boilerplate, main = self.open[-1]
        if not boilerplate:
            if not self.text:
                self.place = (tuple(x[1] for x in self.open[: DEPTH + 1]), main)
            self.text.append(text)
            if not self.count["a"]:
                self.outside += len(text)

    def read(self, html: str) -> None:
        at, scan, last = 0, TOKEN.match, html.rfind(">")
        while at < len(html):
            if at > last:  # a tag or comment that begins here never ends
                self.add(UNENDED.split(html[at:], 1)[0])
                return
            m = scan(html, at)
            at = m.end()
            tag = m[2]
            if tag is None:
                if (c := m[0])[0] != "<" or len(c) == 1:
                    self.add(c)
                continue
            tag = tag.lower()
            if m[1]:
                self.end(tag)
            else:
                self.start(tag, m[3] or "")
                if tag in RAW:
                    end = raw_end(tag).search(html, at)
                    at = end.start() if end else len(html)

    def pop(self, to: int) -> None:
        if any(x[0] in BLOCKS and not self.open[to + i - 1][2] for i, x in enumerate(self.open[to:])):
            self.flush()
        self.count.subtract(x[0] for x in self.open[to:])
        del self.open[to:]

    def start(self, tag: str, attributes: str) -> None:
        if tag in ENDS_P:
            self.close({"p"}, {"table", "button"})
        if tag in ENDS:
            self.close(*ENDS[tag])
        if tag in HEADINGS:
            self.close(HEADINGS, {"table"})
        if tag in BLOCKS and not self.open[-1][2]:
            self.flush()
        elif tag == "br":
            self.add(" ")
        _, path, boilerplate, main = self.open[-1]
        name, bad, good = described(tag, attributes.rstrip("/"))
        if len(self.open) <= DEPTH:
            path = token(around := path, name)
            self.tags.append((path, around, len(self.open), tag in CONTAINERS))
        if tag in VOID or tag not in RAW and attributes.endswith("/") and tag not in BLOCKS:
            return
        if bad == 1 and not main or tag == "header" and boilerplate:
            bad = 2
        if tag in HEADINGS and boilerplate == 1:
            boilerplate = 0  # the heading of an article may be in its header
        self.open.append((tag, path, max(boilerplate, bad), max(main, good)))
        self.count[tag] += 1

    def close(self, tags: set[str] | frozenset[str], up_to: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            t = self.open[i][0]
            if t in tags:
                self.pop(i)
                return
            if t in up_to or t in BLOCKS and t not in ("p", *HEADINGS):
                return

    def end(self, tag: str) -> None:
        if tag in BLOCKS and not self.open[-1][2]:
            self.flush()
        for i in range(len(self.open) - 1, 0, -1) if self.count[tag] else ():
            if self.open[i][0] == tag:
                self.pop(i)
                return
            if self.open[i][0] in ("article", "main", "body", "table") and tag not in BLOCKS:
                return


@lru_cache(64)
def raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I)


@lru_cache(20_000)
def described(tag: str, attributes: str) -> tuple[str, int, int]:
    """An element's name in paths, whether it is boilerplate (1: as a header, 2), and how surely it is the article (0 to 3)."""
    known = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes) if k}
    named = " ".join(known.get(k, "") for k in ("class", "id"))
    name = tag + "".join(f".{x}" for x in sorted(set(re.sub(r"\d+", "0", named).split())))
    if tag in ("html", "body"):
        return name, 0, 0
    said = {w.lower() for w in WORD.findall(named)}
    role = known.get("role", "").lower()
    hidden = "hidden" in attributes and HIDDEN.search(QUOTED.sub("", attributes)) or known.get("aria-hidden", "").lower() == "true" or "display:none" in known.get("style", "").replace(" ", "").lower()
    other = tag in BOILERPLATE - {"header"} or role in ROLES or said & NAMES and tag != "main" or hidden
    bad = 2 if other else int(tag == "header")
    good = 3 if "article" in (tag, role) or known.get("itemprop", "").lower() == "articlebody" else 2 if "main" in (tag, role) else int(bool(said & MAIN_NAMES))
    return name, bad, good


Template = tuple[int | None, frozenset[int], frozenset[int]]


def main_text(page: Page, template: Template | None = None) -> str:
    """The blocks of a page that are its main text. template: the main slot, texts of the template, those that are it in the main slot, too."""
    slot, constant, fixed = template or (None, frozenset(), frozenset())
    sure = max((main for _, main, _, _ in page.blocks), default=0)
    marked = [x for x in page.blocks if x[1] >= sure]
    within = [x for x in page.blocks if slot in x[0]] if slot is not None else []
    if within and (sure < 2 or not any(slot in x[0] for x in marked)):
        chosen, own = within, True  # the template decides; weak marks and those elsewhere don't
    else:
        chosen, own = marked, sure > 0
    gone = fixed if own else constant
    left = [text for paths, _, text, _ in chosen if not gone or token(paths[-1], text) not in gone]
    return "\n\n".join(left or [x[2] for x in chosen if own])


SEEN = "struct<same: binary, first: bigint, tags: array<struct<h: bigint, around: bigint, depth: int, holds: boolean, n: int>>, sequence: array<bigint>, blocks: array<struct<h: bigint, n: int, paths: array<bigint>>>>"


def seen(html: str | None) -> dict:
    """A digest of the texts of a page, its tokens (0: the page itself) and their order, its blocks."""
    page = Page(html)
    n = Counter(x[0] for x in page.tags)
    tags = [{"h": 0, "around": None, "depth": 0, "holds": False, "n": 1}]
    tags += [{"h": h, "around": around, "depth": depth, "holds": holds, "n": n[h]} for h, around, depth, holds in dict.fromkeys(page.tags)]
    blocks = [{"h": token(paths[-1], text), "n": outside, "paths": list(paths)} for paths, _, text, outside in page.blocks]
    same = md5("\0".join(x[2] for x in page.blocks).encode("utf-8", "surrogatepass")).digest()
    first = token(0, html or "")
    return {"same": same, "first": first, "tags": tags, "sequence": [0, *(x[0] for x in page.tags)], "blocks": blocks}


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def different_pages(pages: DataFrame) -> DataFrame:
    """host, same, tags, sequence, blocks: of a host's pages with the same texts, one."""
    tag = pa.struct([("h", pa.int64()), ("around", pa.int64()), ("depth", pa.int32()), ("holds", pa.bool_()), ("n", pa.int32())])
    block = pa.struct([("h", pa.int64()), ("n", pa.int32()), ("paths", pa.list_(pa.int64()))])
    kind = pa.struct([("same", pa.binary()), ("first", pa.int64()), ("tags", pa.list_(tag)), ("sequence", pa.list_(pa.int64())), ("blocks", pa.list_(block))])

    @F.arrow_udf(SEEN)
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([seen(x) for x in batch.to_pylist()], kind)

    read = pages.select(host(F.col("url")).alias("host"), "html").filter("host <> ''").select("host", each(F.col("html")).alias("x")).select("host", "x.*")
    least = F.min(F.struct("first", "tags", "sequence", "blocks")).alias("x")
    return read.groupBy("host", "same").agg(least).select("host", "same", "x.tags", "x.sequence", "x.blocks")


def often(share: int, prior: int) -> Column:
    return F.col("on") * 100 >= (F.col("pages") + prior) * share


def classes(pages: DataFrame) -> DataFrame:
    """host, h, around, depth, holds, class, size, once, pages, valid, inside: the tokens of a host's equivalence classes. pages: as in ``different_pages``.

    once: it is exactly once on each page that has it. inside: the class that this one is nested in."""
    page = F.xxhash64("same", "n"), F.xxhash64("n", "same")
    vectors = pages.select("host", "same", F.explode("tags").alias("t")).select("host", "same", "t.*").groupBy("host", "h")
    vectors = vectors.agg(
        F.count("*").alias("on"), F.sum("n").alias("total"), F.bit_xor(page[0]).alias("a"), F.bit_xor(page[1]).alias("b"), F.max("n").alias("most"), F.min("around").alias("around"), F.min("depth").alias("depth"), F.max("holds").alias("holds")
    )
    vectors = stored(vectors.filter("on > 1 OR h = 0"), "vectors")
    sizes = vectors.filter("h = 0").select("host", F.col("on").alias("pages"))
    equal = Window.partitionBy("host", "on", "total", "a", "b")
    found = vectors.join(sizes, "host").filter(often(SUPPORT, PRIOR)).withColumn("class", F.min("h").over(equal)).withColumn("size", F.count("*").over(equal))
    found = stored(found.select("host", "h", "around", "depth", "holds", "class", "size", (F.col("most") == 1).alias("once"), "pages"), "classes")

    places = pages.select("host", "same", F.posexplode("sequence").alias("at", "h")).join(found.select("host", "h", "class", "size"), ["host", "h"])
    runs = places.groupBy("host", "same", "class").agg(F.max("size").alias("size"), F.transform(F.sort_array(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]).alias("s"))
    order = F.slice("s", 1, F.col("size"))
    again = F.forall(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.get("s", i) == F.get("s", F.pmod(i, "size").cast("int")))
    runs = runs.select("host", "class", (again & (F.size(F.array_distinct(order)) == F.col("size")) & (F.pmod(F.size("s"), "size") == 0)).alias("ok"), F.xxhash64(order).alias("order"))
    ordered = runs.groupBy("host", "class").agg((F.min("ok") & (F.min("order") == F.max("order"))).alias("ordered"))

    outer = found.select("host", F.col("h").alias("around"), F.col("class").alias("other"))
    nests = found.join(outer, ["host", "around"], "left").filter("h <> 0 AND (other IS NULL OR other <> class)")
    nests = nests.groupBy("host", "class").agg((F.count_distinct("other") == 1).alias("nested"), F.min("other").alias("inside"), (F.count("*") == F.count("other")).alias("known"))
    valid = F.col("ordered") & F.coalesce(F.col("nested") & F.col("known"), F.lit(True))
    return found.join(ordered, ["host", "class"]).join(nests, ["host", "class"], "left").withColumn("valid", valid).drop("ordered", "nested", "known")


def templates(pages: DataFrame) -> DataFrame:
    """host, slot (the path of the main slot), constant and fixed (hashes of texts of the template).

    A host is a small row: only what has the support is gathered, at most 100 / SUPPORT times what a page has."""
    with workspace(pages.sparkSession):
        pages = stored(different_pages(pages), "pages")
        tokens = stored(classes(pages), "template")
        sizes = tokens.filter("h = 0").select("host", "pages")
        blocks = pages.select("host", F.explode("blocks").alias("b"))
        texts = pages.select("host", F.explode(F.array_distinct(F.col("blocks.h"))).alias("h")).groupBy("host", "h").agg(F.count("*").alias("on")).filter("on > 1")
        texts = stored(texts.join(sizes, "host").filter(often(SUPPORT, PRIOR)).withColumn("fixed", often(FIXED, FIXED_PRIOR)), "texts")
        own = blocks.select("host", "b.*").join(texts.select("host", "h"), ["host", "h"], "left_anti")
        weights = stored(own.select("host", "n", F.explode("paths").alias("h")).groupBy("host", "h").agg(F.sum("n").alias("n")), "weights")
        whole = weights.filter("h = 0").select("host", F.col("n").alias("whole"))
        # the elements that the template has once a page, in one valid class within the other up to the page
        firm = tokens.filter("valid AND once AND holds").join(weights, ["host", "h"]).join(whole, "host").filter(F.col("n") * 100 >= F.col("whole") * MAIN)
        slots = firm.filter("whole > 0").groupBy("host").agg(F.max(F.struct("depth", "h")).alias("x")).select("host", F.col("x.h").alias("slot"))
        of = texts.groupBy("host").agg(F.sort_array(F.collect_list("h")).alias("constant"), F.sort_array(F.collect_list(F.when(F.col("fixed"), F.col("h")))).alias("fixed"))
        return stored(of.join(slots, "host", "full").select("host", "slot", "constant", "fixed"), "templates", keep=True)


@lru_cache(256)
def _template(slot: int | None, constant: tuple, fixed: tuple) -> Template:
    return slot, frozenset(constant), frozenset(fixed)


def extracted(pages: DataFrame) -> DataFrame:
    """``pages`` and ``__text``, the main text of each."""
    findable(pages.sparkSession)
    known = templates(pages).select(F.col("host").alias("__host"), F.struct("slot", "constant", "fixed").alias("__template"))

    @F.arrow_udf("string")
    def text(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for html, template in batches:
            found = (_template(t["slot"], tuple(t["constant"] or ()), tuple(t["fixed"] or ())) if t else None for t in template.to_pylist())
            yield pa.array([main_text(Page(h), t) for h, t in zip(html.to_pylist(), found, strict=True)], pa.string())

    joined = pages.join(known, host(F.col("url")) == F.col("__host"), "left")
    return joined.withColumn("__text", text(F.col("html"), F.col("__template"))).drop("__host", "__template")

"""Near copies by the similarity of word shingles, with SimHash sketches compared bit-sliced.

Operator 5 for a similarity instead of a radius. Two texts are near copies if the sets of their 5-word shingles have a Jaccard similarity of
SIMILARITY or more. Texts whose lower-cased words are equal collapse first, by an aggregation that combines before the shuffle.
Each of the others gets a SimHash sketch of WIDTH bits, by the same rule as the fingerprint's, over its set of shingles. Sketches of
near copies differ in 78 bits on average (similarity 0.8, texts of 50 words or more), by a standard deviation of 8; RADIUS is six of these beyond. No blocks of bits are the same for
such distances, so that buckets come from minima of shingle hashes: BANDS times ROWS of them are taken, and two texts that
agree in all ROWS minima of a band share a bucket. Those of similarity s share none with probability (1 - s ** ROWS) ** BANDS: 3 in
100,000 at 0.8, less above.

First each text is compared with the smallest of each of its buckets. Then, in buckets whose texts these links haven't
connected, sketches are compared as fingerprints are in ``simhash``: bit planes, carry-save counters, blocks abandoned; large
buckets are dealt into pairs of parts. The texts come with them, and a task verifies the pairs within the radius that aren't connected yet itself: it returns a forest of links, never
pairs that turn out not to be similar. A link is made
of pairs only whose shingles themselves, not hashes, have the similarity asked for.

Words are parted by ASCII white space. Fewer words than a shingle make one. Texts without words, null ones too, are copies of each other.
The representative is the smallest doc_id, a null one being larger than any.
Very long texts are read whole, in parts of bounded size. Repeated rows are copies of each other.
An empty table gives an empty table. Other columns are passed on, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import findable, stored, workspace
from palisade.llm.simhash import PAIR, SPLIT, by_group, components, dealt, groups_of, near_pairs, sides

SHINGLE = 5
#: The least similarity of near copies, in hundredths.
SIMILARITY = 80
BANDS, ROWS = 20, 4
#: Bits of a sketch, and how many of them may differ in near copies.
WIDTH, RADIUS = 512, 127
#: Rows whose sketches a task compares at once.
COMPARED = 1 << 13
#: Shingles whose hashes are mixed at once.
AT_ONCE = 2_048
_rng = np.random.default_rng(42)
FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(w: list[bytes], n: int = SHINGLE) -> set[bytes]:
    return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


SEEDS = _rng.integers(0, 1 << 63, WIDTH // 64, np.uint64)


def hashes(w: list[bytes]) -> np.ndarray:
    """Of the set of a text's shingles; none for a text without words."""
    return np.frombuffer(b"".join([xxhash.xxh64_digest(s, 42) for s in shingles(w)]), np.uint64)


def bands(h: np.ndarray) -> list[int]:
    """A signed long for each band of a text; none for a text without words."""
    if not len(h):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), AT_ONCE):
        least = np.minimum(least, (FACTORS[:, None] * h[None, i : i + AT_ONCE] + ADDENDS[:, None]).min(1))
    raw = least.tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[i : i + 8 * ROWS]) for i in range(0, len(raw), 8 * ROWS)], np.uint64).view(np.int64).tolist()


def sketch(h: np.ndarray) -> bytes:
    """The bits that are set in over half the hashes, each mixed to WIDTH bits."""
    counts = np.zeros(WIDTH, np.int64)
    for i in range(0, len(h), AT_ONCE):
        x = h[i : i + AT_ONCE, None] ^ SEEDS[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(h)).tobytes()


def signed(text: Column) -> Column:
    """same: a digest of the words, bands, sketch."""
    kind = pa.struct([("same", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    @F.arrow_udf("struct<same: binary, bands: array<bigint>, sketch: binary>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for t in batch:
                w = words(t.as_py())
                h = hashes(w)
                out.append({"same": hashlib.md5(b" ".join(w)).digest(), "bands": bands(h), "sketch": sketch(h)})
            yield pa.array(out, kind)

    return of(text)


def similar(a: Column, b: Column) -> Column:
    @F.arrow_udf("boolean")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out, known, x = [], None, set()
            for s, t in zip(left.to_pylist(), right.to_pylist(), strict=True):
                if s != known:
                    known, x = s, shingles(words(s))
                y = shingles(words(t))
                both = len(x & y)
                out.append(100 * both >= SIMILARITY * (len(x) + len(y) - both))
            yield pa.array(out, pa.bool_())

    return of(a, b)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b: rid) that are similar. texts: rid, text."""
    one, two = (texts.select(F.col("rid").alias(c), F.col("text").alias(f"text_{c}")).hint("merge") for c in "ab")
    return pairs.join(two, "b").join(one, "a").filter(similar(F.col("text_a"), F.col("text_b"))).select("a", "b")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of hashes have the similarity; sets of shingles that have it always pass."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SIMILARITY * (len(a) + len(b) - both)


def linked(rid: np.ndarray, root: np.ndarray, texts: list[str | None], pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Links among pairs of rows, of those that neither their roots nor links found before connect. A row can occur several times."""
    over: dict[int, int] = {}  # roots that links have joined

    def top(x: int) -> int:
        while (y := over.get(x, x)) != x:
            over[x] = over.get(y, y)
            x = y
        return x

    sets: dict[int, np.ndarray] = {}
    out = []
    for a, b in pairs:
        apart = root[a] != root[b]
        for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            x, y = top(int(root[i])), top(int(root[j]))
            if x == y:
                continue
            for k in (i, j):
                if int(rid[k]) not in sets:
                    sets[int(rid[k])] = np.unique(hashes(words(texts[k])))
            if not alike(sets[int(rid[i])], sets[int(rid[j])]):
                continue
            one, two = shingles(words(texts[i])), shingles(words(texts[j]))
            both = len(one & two)
            if 100 * both >= SIMILARITY * (len(one) + len(two) - both):
                over[max(x, y)] = min(x, y)
                out.append((min(int(rid[i]), int(rid[j])), max(int(rid[i]), int(rid[j]))))
    return out


def sketched_links(rows: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """a, b (rid): a forest of the links between rows (t, key, rid, root, text, sketch) of one bucket that aren't connected."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, PAIR, COMPARED):
            group, side = groups_of(table, PAIR), sides(table)
            order = np.lexsort((side, group))
            words_ = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(table), -1)[order]
            rid, root = table["rid"].to_numpy()[order], table["root"].to_numpy()[order]
            texts = table["text"].take(pa.array(order)).to_pylist()
            found = linked(rid, root, texts, near_pairs(group[order], side[order], words_, radius))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    parts = dealt(rows, split, by="rid")
    return parts.repartition(*PAIR).sortWithinPartitions(*PAIR).mapInArrow(compare, "a bigint, b bigint").distinct()


def links(members: DataFrame, texts: DataFrame, split: int = SPLIT) -> DataFrame:
    """node, root: of every text with a link, the smallest text that links lead to.

    members: rid, t, key, least of buckets of two or more. texts: rid, text, sketch."""
    with workspace(members.sparkSession):
        pairs = members.filter("rid <> least").select(F.col("least").alias("a"), F.col("rid").alias("b")).distinct()
        found = stored(verified(pairs, texts.select("rid", "text")), "links")
        roots = components(found)
        tied = members.join(roots.hint("merge"), members["rid"] == roots["node"], "left").select("t", "key", "rid", F.coalesce("root", "rid").alias("root"))
        tied = stored(tied, "tied")
        parted = tied.groupBy("t", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("t", "key")
        rest = stored(tied.join(parted.hint("merge"), ["t", "key"], "left_semi").join(texts.hint("merge"), "rid"), "parted")
        more = stored(sketched_links(rest, split=split), "more_links")
        whole = roots if more.isEmpty() else components(found.unionByName(more))
        return stored(whole, "roots", keep=True)


def deduplicated(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id (of rows that share it, one); with the columns of ``docs``."""
    findable(docs.sparkSession)
    with workspace(docs.sparkSession):
        packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "doc_id", "text")
        whole = packed.withColumn("x", signed(F.col("text"))).select("__row", "doc_id", "x.*", F.monotonically_increasing_id().alias("rid"))
        whole = stored(whole, "signed", keep=True)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
        distinct = stored(whole.groupBy("same").agg(first).select("first", "first.rid"), "distinct")
        each = whole.select("rid", "bands").join(distinct.select("rid").hint("merge"), "rid", "left_semi")
        keys = stored(each.select("rid", F.posexplode("bands").alias("t", "key")), "bands")
        shared = keys.groupBy("t", "key").agg(F.min("rid").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
        members = stored(keys.join(stored(shared, "buckets").hint("merge"), ["t", "key"]), "members")
        met = whole.select("rid", F.col("__row.text").alias("text"), "sketch").join(members.select("rid").distinct().hint("merge"), "rid", "left_semi")
        met = stored(met, "texts")
        nodes = links(members, met, split)
        tied = distinct.join(nodes.hint("merge"), distinct["rid"] == nodes["node"], "left").select(F.coalesce("root", "rid").alias("root"), "first")
        left = stored(tied.groupBy("root").agg(F.min("first").alias("x")).select(F.col("x.rid").alias("__rid")), "kept", keep=True)
    # always a merge join: the plan, and what it shuffles, is the same at every size
    return whole.join(left.hint("merge"), whole["rid"] == left["__rid"], "left_semi").select("__row.*")

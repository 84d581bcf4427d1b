"""SimHash near-duplicates by bit-sliced comparison.

Fingerprint: of the XXH64 hashes (seed 42) of a text's word shingles, repeats included, a bit is 1 if it is set in over
half. Equal fingerprints collapse first, by an aggregation that combines before the shuffle.

Two fingerprints within the radius r agree wholly on at least m - r of m blocks of bits. For each choice of m - r blocks there is a
table of buckets, so every link is found in one; m grows with the number of different fingerprints, which keeps buckets small.
In a bucket, 64 fingerprints are turned into 64 words, one for each bit plane. A query's differences from all 64 are
counted at once, plane after plane, by carry-save adders over words; entries all of whose lanes have exceeded the radius
are abandoned. Buckets of more than SPLIT members are dealt into parts, and each pair of parts is a task of its own. A task
returns a spanning forest of the links it found, never all pairs.

Components come from rounds of large-star and small-star, each round stored; no round gathers a node's links in one task.

Rows: a null text, or one without words, has fingerprint 0 and is linked like any other. Fewer words than a shingle
make one. Very long texts are read whole. The representative is the smallest doc_id, a null one being larger than any. Repeated rows are
duplicates of each other. An empty table gives an empty table. Other columns are passed on by ``deduplicated``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import findable, kept, stored, workspace

SHINGLE, RADIUS = 3, 3
#: Members of a bucket, or of a part of one, at most (parts are dealt by hash, so by and large).
SPLIT = 2_048
#: Rows that a task compares at once, and (query, word) entries.
ROWS, ENTRIES = 1 << 17, 1 << 20
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, 42) for s in shingles]), np.uint8).reshape(-1, 8)
    # eight counters of a byte in each word, emptied before they can overflow
    lanes = np.unpackbits(hashes, axis=1).view(np.uint64)
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0) if len(lanes) > 1 else lanes
    counts = sums.view(np.uint8).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf("bigint")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint(t.as_py(), shingle) for t in batch], np.uint64).view(np.int64), pa.int64())

    return of(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def bounds(blocks: int) -> list[tuple[int, int]]:
    """(first bit, width) of each block of a fingerprint."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def block_count(n: int, radius: int) -> int:
    """Blocks for n different fingerprints: the fewest whose buckets hold 64 or fewer if fingerprints are spread evenly."""
    for m in range(radius + 1, 13):
        if n >> min(64 * (m - radius) // m, 60) <= 64:
            return m
    return 12


def buckets(distinct: DataFrame, radius: int, blocks: int) -> DataFrame:
    """fp, t, key: each fingerprint in a bucket of each table."""
    parts = bounds(blocks)

    def key(chosen: tuple[int, ...]) -> Column:
        value = F.lit(0).cast("long")
        for c in chosen:
            first, width = parts[c]
            bits = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else F.col("fp")
            value = (F.shiftleft(value, width) if width < 64 else value).bitwiseOR(bits)
        return value

    chosen = list(combinations(range(blocks), blocks - radius))
    return distinct.select("fp", F.posexplode(F.array(*(key(c) for c in chosen))).alias("t", "key"))


def dealt(rows: DataFrame, split: int = SPLIT, by: str = "fp") -> DataFrame:
    """rows (t, key, and what ``by`` deals) with the part they are in and the pair of parts (low, high) that is to be compared."""
    large = rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > split).select("t", "key", F.ceil(F.col("n") / split).cast("int").alias("parts"))
    parted = rows.join(large, ["t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parted = parted.withColumn("part", F.when(F.col("parts") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64(by), "parts").cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    own = [c for c in rows.columns if c not in ("t", "key")]
    return parted.select("t", "key", *own, "part", other).select("t", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", *own)


def planes(words: np.ndarray) -> np.ndarray:
    """(w, 64, k) words of fingerprints, a row for the lanes of a word, to (w, 64 * k) words, one for each bit plane."""

    def turned(x: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(x.tobytes(), np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
        return np.frombuffer(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").tobytes(), np.uint64).reshape(-1, 64)

    return np.concatenate([turned(words[:, :, i]) for i in range(words.shape[2])], axis=1)


def within(queries: np.ndarray, plane: np.ndarray, word: np.ndarray, radius: int) -> np.ndarray:
    """For each entry (a query, as words, and the word of lanes it is compared to): the lanes at most ``radius`` bits away, as bits of a word."""
    bits = max(1, radius.bit_length())
    out = np.zeros(len(queries), np.uint64)
    alive = np.arange(len(queries))
    counter = [np.zeros(len(queries), np.uint64) for _ in range(bits)]
    over = np.zeros(len(queries), np.uint64)  # lanes with 2 ** bits differences or more
    q, w = queries, word
    for p in range(plane.shape[1]):
        carry = plane[w, p] ^ (np.uint64(0) - (q[:, p >> 6] >> np.uint64(p & 63) & np.uint64(1)))
        for i in range(bits):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        over |= carry
        if p % 8 == 7 and p < plane.shape[1] - 1:
            left = np.flatnonzero(over != ALL)
            if len(left) < 0.75 * len(alive):  # abandon the entries beyond the radius in every lane
                alive, q, w, over = alive[left], q[left], w[left], over[left]
                counter = [c[left] for c in counter]
    if radius + 1 < 1 << bits:  # counted further than the radius
        more, same = np.zeros(len(over), np.uint64), np.full(len(over), ALL)
        for i in range(bits - 1, -1, -1):
            bit = ALL if radius >> i & 1 else np.uint64(0)
            more |= same & counter[i] & ~bit
            same &= ~(counter[i] ^ bit)
        over |= more
    out[alive] = ~over
    return out


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that the links a-b lead to."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_pairs(group: np.ndarray, side: np.ndarray, words: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (the lesser first) whose fingerprints (rows of words) are within the radius, in parts.

    Rows are sorted by group and side. side: 0 is only compared to 1, 2 to all 2 of its group."""
    lane = np.flatnonzero(side > 0)  # what is compared to
    if not len(lane):
        return
    g = group[lane]
    start = np.flatnonzero(np.diff(g, prepend=g[0] - 1))
    rank = np.arange(len(g)) - np.repeat(start, np.diff(start, append=len(g)))
    per = (np.diff(start, append=len(g)) + 63) // 64  # words of a group
    first = np.cumsum(per) - per
    at = np.repeat(first, np.diff(start, append=len(g))) + rank // 64
    members = np.zeros((int(per.sum()), 64), np.int64) - 1
    members[at, rank % 64] = lane
    plane = planes(np.where((members >= 0)[:, :, None], words[np.maximum(members, 0)], np.uint64(0)))
    valid = np.packbits(members >= 0, axis=1, bitorder="little").view(np.uint64)[:, 0]
    query = np.flatnonzero(side != 1)
    slot = np.searchsorted(g[start], group[query])
    ok = slot < len(start)
    query, slot = query[ok], slot[ok]
    ok = g[start][slot] == group[query]
    query, slot = query[ok], slot[ok]
    n = per[slot]
    ends = np.cumsum(n)
    begin = 0
    while begin < len(query):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + ENTRIES // words.shape[1])))
        k = n[begin:end]
        q = np.repeat(query[begin:end], k)
        w = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[slot[begin:end]], k)
        near = within(words[q], plane, w, radius) & valid[w]
        hit = np.flatnonzero(near)
        for i in range(0, len(hit), 1 << 14):
            part = hit[i : i + (1 << 14)]
            row, lanes = np.nonzero(np.unpackbits(near[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = q[part][row], members[w[part][row], lanes]
            a, b = a[a != b], b[a != b]
            yield np.minimum(a, b), np.maximum(a, b)
        begin = end


def linked(group: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as a forest, of fingerprints in sorted groups; sides as in ``near_pairs``."""
    order = np.lexsort((side, group))
    group, side, fp = group[order], side[order], fp[order]
    found_a, found_b = [], []
    for a, b in near_pairs(group, side, fp[:, None], radius):
        found_a.append(a)
        found_b.append(b)
        if sum(map(len, found_a)) > ENTRIES:  # keep only a forest of what was found so far
            root = forest(np.concatenate(found_a), np.concatenate(found_b), len(fp))
            tied = np.flatnonzero(root != np.arange(len(fp)))
            found_a, found_b = [root[tied]], [tied]
    if not found_a:
        return fp[:0], fp[:0]
    root = forest(np.concatenate(found_a), np.concatenate(found_b), len(fp))
    tied = np.flatnonzero(root != np.arange(len(fp)))
    return fp[tied], fp[root[tied]]


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole groups, of so many rows by and large."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            table = pa.Table.from_batches(held)
            same = np.ones(len(table), bool)
            for c in keys:
                same &= table[c].to_numpy() == table[c][-1].as_py()
            cut = len(table) - int(same.sum())  # the last group may go on
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
    if sum(map(len, held)):
        yield pa.Table.from_batches(held)


def groups_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Numbers of the groups of a sorted table's rows."""
    new = np.zeros(len(table), bool)
    for c in keys:
        x = table[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


PAIR = ["t", "key", "low", "high"]


def sides(table: pa.Table) -> np.ndarray:
    """What the rows of a pair of parts are compared to."""
    low, high = table["low"].to_numpy(), table["high"].to_numpy()
    return np.where(low == high, 2, (table["part"].to_numpy() == high).astype(np.int64))


def links(distinct: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """a, b: links between different fingerprints (column fp of ``distinct``) that connect all that are within the radius."""
    rows = dealt(buckets(distinct, radius, block_count(distinct.count(), radius)), split)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, PAIR, ROWS):
            a, b = linked(groups_of(table, PAIR), sides(table), table["fp"].to_numpy().view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return rows.repartition(*PAIR).sortWithinPartitions(*PAIR).mapInArrow(compare, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: of every node with an edge (a, b: longs), the smallest node that edges lead to."""
    with workspace(edges.sparkSession):
        pairs = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        before = None
        while True:
            with workspace(edges.sparkSession):
                both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
                least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
                large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
                large = stored(large, "large")
                least = large.groupBy("u").agg(F.min("v").alias("m"))
                small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct()
                pairs = stored(small, "small", keep=True)
            now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == before:
                return kept(pairs).select(F.col("u").alias("node"), F.col("v").alias("root"))
            before = now


def grouped(rows: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """``rows`` (stored; doc_id, fp), root, a fingerprint that stands for the group, and component_id, its smallest doc_id."""
    with workspace(rows.sparkSession):
        distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
        nodes = components(links(distinct, radius, split))
        tied = distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
        roots = tied.groupBy("root").agg(F.min("least").alias("component_id"))
        of = stored(tied.join(roots, "root").select(F.col("fp").alias("__fp"), "root", "component_id"), "roots", keep=True)
    return rows.join(of, rows["fp"] == of["__fp"]).drop("__fp")


def deduplicated(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One document of each group, that of the smallest doc_id (of rows that share it, one); with the columns of ``docs``."""
    findable(docs.sparkSession)
    with workspace(docs.sparkSession):
        packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "doc_id", "text")
        whole = stored(packed.withColumn("fp", fingerprints(F.col("text"), shingle)).drop("text").withColumn("rid", F.monotonically_increasing_id()), "fingerprinted", keep=True)
        groups = grouped(whole.select("doc_id", "fp", "rid"), radius)
        first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("x"))
        left = stored(first.select(F.col("x.rid").alias("__rid")), "kept", keep=True)
    # always a merge join: the plan, and what it shuffles, is the same at every size
    return whole.join(left.hint("merge"), whole["rid"] == left["__rid"], "left_semi").select("__row.*")

"""Passages that repeat anywhere in a corpus: what relative Lempel-Ziv parsing and the suffix sort have in common.

A text is a sequence of symbols (bytes, or words). A window is WINDOW consecutive symbols of one text; the windows that
occur elsewhere are sought. No window is compared to all others. Each window has an anchor: of its grams of
``gram`` symbols, the one with the least hash, the leftmost of equal ones. Equal windows have equal anchors at the same
place, so that only windows with the same anchor need to be compared, and neighbouring windows mostly share theirs.

1. The hashes of all anchors are counted by Spark's aggregation, at most two of a hash from each batch. Those that occur again set bits
   of a filter of bounded size (the more bits, the fewer needless candidates; no candidate is lost).
2. Each anchor that passes gives an occurrence: where it is, and its context, which is all its windows' symbols.
   Equal contexts collapse by an aggregation that combines before the shuffle, so that a passage which a third of all
   texts hold is one row a task. They are grouped by a 128-bit digest and compared by their bytes; should two differ, all starts anew
   with another seed. What is left of an anchor, its different contexts, is a block.
3. A block of more than CROWD contexts is divided: each of its windows has a second anchor by another hash, and those that share it
   are a context of their own in a smaller block, which is divided again if need be. Equal windows share all their anchors.
4. The caller's ``resolve`` compares the contexts of a block, and tells which of their windows repeat and how far they match.
5. Verdicts go back to all occurrences, and the runs of each text are gathered.

Rows: the operators on top of this say what they do with theirs. Texts are told apart by doc_id and a hash of the
text; rows that agree in both are occurrences of their own, but get one verdict. A null doc_id is larger than any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import findable, stored, text_key, workspace

#: Symbols that are hashed at once; longer texts go in pieces that overlap by a window.
PIECE = 1 << 20
#: Parts of the filter, as a power of 2; its bits for each repeated anchor, and its bits at most (as a power of 2).
PARTS, BITS_EACH, MOST_BITS = 7, 64, 30
#: Bytes that a task has sent already and needn't send again, at most; then it forgets all and begins again.
REMEMBERED = 64 << 20

#: Stands for a null doc_id.
LAST = (1 << 63) - 1
ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64, for i < n."""

    def raised(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return raised(BASE), raised(pow(BASE, -1, 1 << 64))


@cache
def byte_values() -> np.ndarray:
    return np.random.default_rng(20_011).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray, odd: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(odd)
    h ^= h >> np.uint64(29)
    h = h * ODD
    return h ^ (h >> np.uint64(32))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes of a sequence: n + 1 of them."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(PIECE * 2)[0][: len(values)], out=out[1:])
    return out


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """The polynomial hashes of n consecutive symbols, from each place on."""
    p = prefix(values)
    return (p[n:] - p[:-n]) * powers(PIECE * 2)[1][: len(values) - n + 1]


@dataclass
class Anchors:
    """For each: where it is, the first and last window start that it is the anchor of, and its hash."""

    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    hash: np.ndarray


def anchors(values: np.ndarray, ends: np.ndarray, window: int, gram: int) -> Anchors:
    """Of texts that lie one after the other in ``values``, up to ``ends``."""
    none = np.zeros(0, np.int64)
    if len(values) < window:
        return Anchors(none, none, none, none.astype(np.uint64))
    h = grams(values, gram)
    w = window - gram + 1
    v = mixed(h, 0xBF58476D1CE4E5B9) & np.uint64(0xFFFFFFFFFF000000) | np.arange(len(h), dtype=np.uint64)
    n = 1
    while n < w:  # the least of n values from each place on
        step = min(n, w - n)
        v = np.minimum(v[:-step], v[step:])
        n += step
    at = (v & np.uint64(0xFFFFFF)).astype(np.int64)
    ok = np.ones(len(at), bool)
    for e in ends[:-1].tolist():  # windows that would go on in the next text
        ok[max(0, e - window + 1) : e] = False
    start = np.flatnonzero(ok)
    at = at[start]
    if not len(at):
        return Anchors(none, none, none, none.astype(np.uint64))
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return Anchors(at[first], start[first], start[last], mixed(h[at[first]], 0x94D049BB133111EB))


@dataclass
class Symbols:
    """How texts are read as symbols."""

    window: int
    gram: int
    by_word: bool

    def pieces(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], tuple]]:
        """Runs of texts, or pieces of long ones: values, ends, for each (text, its first symbol's place in the text, in the run), and where symbols are."""
        run: list[tuple[int, int, int, tuple]] = []
        size = 0
        for i, text in enumerate(texts):
            found = self.split(text)
            n = len(found[0])
            if n < self.window:
                continue
            for a in range(0, n, PIECE):
                b = min(n, a + PIECE + self.window - 1)
                if b - a < self.window:
                    continue
                if run and size + b - a > PIECE + self.window:
                    yield self._run(run)
                    run, size = [], 0
                run.append((i, a, b, found))
                size += b - a
        if run:
            yield self._run(run)

    def split(self, text: bytes) -> tuple[np.ndarray, ...]:
        """Values of the symbols of a text, and (of words) where they begin and end."""
        raw = np.frombuffer(text, np.uint8)
        if not self.by_word:
            return (raw,)
        inner = _IN_WORD[raw]
        edge = np.flatnonzero(np.diff(inner, prepend=np.int8(0), append=np.int8(0)))
        begin, end = edge[::2], edge[1::2]
        values = np.zeros(len(begin), np.uint64)
        if len(begin):
            for a in range(0, len(raw), PIECE):
                b = min(len(raw), a + PIECE)
                p = prefix(byte_values()[raw[a:b]])
                lo, hi = int(np.searchsorted(end, a, "right")), int(np.searchsorted(begin, b))
                if lo == hi:
                    continue
                s, e = np.maximum(begin[lo:hi], a) - a, np.minimum(end[lo:hi], b) - a
                part = (p[e] - p[s]) * powers(PIECE * 2)[1][s]
                if begin[lo] < a:  # a word that began in the piece before
                    part[:1] = part[:1] * np.uint64(pow(BASE, int(a - begin[lo]), 1 << 64)) + values[lo : lo + 1]
                values[lo:hi] = part
            values = mixed(values + (end - begin).astype(np.uint64), 0x94D049BB133111EB)
        return values, begin, end

    def read(self, context: bytes) -> tuple[np.ndarray, Callable[[int], int], Callable[[int], int]]:
        """Values of the symbols of a context, and where a symbol begins and ends in it."""
        values, *places = self.split(context)
        if self.by_word:
            return values, lambda i: int(places[0][i]), lambda i: int(places[1][i])
        return byte_values()[values], lambda i: i, lambda i: i + 1

    def _run(self, run: list) -> tuple:
        values = np.concatenate([found[0][a:b] for _, a, b, found in run])
        if not self.by_word:
            values = byte_values()[values]
        ends = np.cumsum([b - a for _, a, b, _ in run])
        starts = ends - [b - a for _, a, b, _ in run]
        return values, ends, [(i, a, int(s)) for (i, a, _, _), s in zip(run, starts, strict=True)], [found[1:] for *_, found in run]


_IN_WORD = np.ones(256, np.int8)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = 0


def _bytes(texts: pa.Array) -> list[bytes]:
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def doc_key(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), text_key(F.col("text")).alias("th")]


def repeated(docs: DataFrame, hashes: Callable[[list[bytes]], list[np.ndarray]]) -> DataFrame:
    """h: of the 64-bit hashes that ``hashes`` finds in texts, those that occur more than once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = hashes(_bytes(batch.column(0)))
            if found and len(all_ := np.concatenate(found)):
                h, n = np.unique(all_, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["h", "n"])

    counted = docs.select("text").mapInArrow(count, "h bigint, n int").groupBy("h").agg(F.sum("n").alias("n"))
    return stored(counted.filter("n > 1").select("h"), "hashes")


def bit_filter(found: DataFrame) -> np.ndarray:
    """Bits for the hashes that were found; no more than 2 ** MOST_BITS, whatever their number."""
    bits = min(MOST_BITS, max(20, (found.count() * BITS_EACH).bit_length()))
    share = 1 << bits - PARTS

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            at = (batch.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            for r in np.unique(at // share).tolist():
                part = own.setdefault(r, np.zeros(share // 8, np.uint8))
                flags = np.zeros(share, np.uint8)
                flags[at[at // share == r] - r * share] = 1
                part |= np.packbits(flags, bitorder="little")
        for r, part in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["part", "bits"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    parted = found.select(F.shiftrightunsigned("h", 64 - PARTS).alias("part"), "h").repartition("part")
    for r, part in parted.mapInArrow(fill, "part int, bits binary").toLocalIterator():
        out[r * share // 8 : (r + 1) * share // 8] |= np.frombuffer(part, np.uint8)
    return out


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


OCCURRENCE = "did bigint, th bigint, at bigint, g bigint, c1 bigint, c2 bigint, before int, after int, context binary"


def occurrences(docs: DataFrame, symbols: Symbols, bits: np.ndarray, seed: int = 0) -> DataFrame:
    """The anchors that pass the filter. before: symbols of the context before the anchor; after: from it on.

    Its first window begins with the context and its last one ends with it. A task sends a context's bytes once; it
    remembers them, so that other bytes of the same digest are sent too."""
    sent = docs.sparkSession.sparkContext.broadcast(bits.tobytes())
    names = [x.split()[0] for x in OCCURRENCE.split(", ")]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(sent.value, np.uint8)
        told: dict[bytes, bytes] = {}
        held = 0
        for batch in batches:
            texts = _bytes(batch.column(2))
            did, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for values, ends, parts, places in symbols.pieces(texts):
                a = anchors(values, ends, symbols.window, symbols.gram)
                keep = passes(known, a.hash)
                at, first, last, g = a.at[keep], a.first[keep], a.last[keep], a.hash[keep]
                if not len(at):
                    continue
                part = np.searchsorted(ends, at, "right")
                text = np.array([p[0] for p in parts])[part]
                shift = np.array([p[1] - p[2] for p in parts])[part]  # from places in the run to places in the text
                contexts: list[bytes | None] = []
                digests = []
                for t, p, s, e in zip(text.tolist(), part.tolist(), (first + shift).tolist(), (last + shift + symbols.window).tolist(), strict=True):
                    if symbols.by_word:
                        begin, end = places[p]
                        context = b" ".join(texts[t][begin[s] : end[e - 1]].split())
                    else:
                        context = texts[t][s:e]
                    contexts.append(context)
                before = at - first
                heads = np.stack([g.view(np.int64), before], 1)
                for i, context in enumerate(contexts):
                    digest = xxhash.xxh3_128_digest(context + heads[i].tobytes(), seed)
                    digests.append(digest)
                    if told.setdefault(digest, context) is not context and told[digest] == context:
                        contexts[i] = None
                    else:
                        held += len(context) + 100
                if held > REMEMBERED:
                    told.clear()
                    held = 0
                c = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                columns = [did[text], th[text], at + shift, g.view(np.int64), c[:, 0], c[:, 1], before.astype(np.int32), (last + symbols.window - at).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(contexts, pa.binary())], names)

    return docs.select(*doc_key(docs), "text").mapInArrow(emit, OCCURRENCE)


#: Which windows of a context repeat: starts relative to the anchor, from and to (inclusive), and where the match of these ends.
VERDICT = "g bigint, c1 bigint, c2 bigint, did bigint, th bigint, at bigint, n bigint, runs array<struct<first: int, last: int, end: int>>"
RUN = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("end", pa.int32())])
#: Contexts that a task resolves at once.
ROWS = 20_000
#: Contexts of a block from which on it is divided.
CROWD = 2_000
#: How often blocks are divided at most; what shares so many anchors is the same but for a few symbols.
LEVELS = 6

Resolve = Callable[[np.ndarray, pa.Table], list[list[dict]]]


class Collision(Exception):
    """Two different contexts have the same digest."""


def blocks(seen: DataFrame) -> DataFrame:
    """The different contexts: how often each occurs, and its earliest occurrence. Equal digests are checked by the bytes."""
    key = F.min(F.struct("did", "th", "at")).alias("x")
    got = seen.groupBy("g", "c1", "c2").agg(F.count("*").alias("n"), key, F.max("before").alias("before"), F.max("after").alias("after"), F.max("context").alias("context"), F.min("context").alias("least"))
    found = stored(got.select("g", "c1", "c2", "n", "x.did", "x.th", "x.at", "before", "after", "context", F.when(F.col("least") != F.col("context"), F.lit(1)).alias("differ")), "blocks")
    if not found.filter("differ = 1").isEmpty():
        raise Collision
    return found.drop("differ")


def verdicts(found: DataFrame, symbols: Symbols, resolve: Resolve, all_copies: bool, crowd: int = CROWD, level: int = 1) -> DataFrame:
    """VERDICT for each context of a block (``found`` is stored) that has several, or one that occurs again."""
    large = stored(found.groupBy("g").agg(F.count("*").alias("contexts")).filter(F.col("contexts") > crowd).select("g"), "crowded")
    if level >= LEVELS or large.isEmpty():
        return block_verdicts(found, resolve)
    parts = stored(divided(found.join(large, "g", "left_semi"), symbols, level), "parts")
    judged = stored(verdicts(blocks(parts), symbols, resolve, all_copies, crowd, level + 1), "verdicts")
    whole = parts.select("g", "c1", "c2", "did", "th", "at", "before", "after", F.struct("pg", "p1", "p2", "did", "th", "at", "pn").alias("owner"))
    runs = applied(whole, judged, symbols, all_copies).groupBy("owner").agg(F.sort_array(F.collect_set("r")).alias("runs"))
    names = dict(zip(("g", "c1", "c2", "did", "th", "at", "n"), ("pg", "p1", "p2", "did", "th", "at", "pn"), strict=True))
    of_large = runs.select(*(F.col(f"owner.{old}").alias(new) for new, old in names.items()), "runs")
    return block_verdicts(found.join(large, "g", "left_anti"), resolve).unionByName(of_large)


def applied(seen: DataFrame, judged: DataFrame, symbols: Symbols, all_copies: bool) -> DataFrame:
    """``seen`` (with did, th, at, before, after of an occurrence), ref (the earliest one of its context) and r, a run that repeats; null if none does."""
    v = judged.select("g", "c1", "c2", "n", "runs", F.struct("did", "th", "at").alias("ref"))
    joined = seen.join(v, ["g", "c1", "c2"], "left")
    whole = F.array(F.struct((-F.col("before")).alias("first"), (F.col("after") - symbols.window).alias("last"), F.col("after").alias("end")))
    own = F.struct("did", "th", "at") == F.col("ref")
    runs = F.when((F.col("n") > 1) & (F.lit(all_copies) | ~own), whole).otherwise(F.col("runs"))
    return joined.withColumn("r", F.explode_outer(runs)).drop("n", "runs")


def divided(found: DataFrame, symbols: Symbols, level: int) -> DataFrame:
    """The contexts of crowded blocks as smaller ones: those runs of their windows that share a second anchor, each with its parent (pg, p1, p2, pn).

    The second anchor is the window's gram with the least value of a hash of this level; its place and bytes go into the new g."""
    kept = "did bigint, th bigint, at bigint"
    parent = "pg bigint, p1 bigint, p2 bigint, pn bigint"
    schema = f"{kept}, {parent}, g bigint, c1 bigint, c2 bigint, before int, after int, context binary"
    names = [x.split()[0] for x in schema.split(", ")]
    odd = np.uint64((2 * level + 1) * int(ODD) % (1 << 64))
    w = symbols.window - symbols.gram + 1

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, g, digests, before, after, contexts = [], [], [], [], [], []
            head = batch["g"].to_pylist()
            for i, (context, b) in enumerate(zip(batch["context"].to_pylist(), batch["before"].to_pylist(), strict=True)):
                values, begin, end = symbols.read(context)
                v = mixed(grams(values, symbols.gram) ^ odd, 0xBF58476D1CE4E5B9) & np.uint64(0xFFFFFFFFFFFF0000) | np.arange(len(values) - symbols.gram + 1, dtype=np.uint64)
                at = np.lib.stride_tricks.sliding_window_view(v, w).min(1) & np.uint64(0xFFFF)
                cut = np.flatnonzero(np.diff(at, prepend=at[0] ^ np.uint64(1))).tolist()
                for s, last in zip(cut, [*(x - 1 for x in cut[1:]), len(at) - 1], strict=True):
                    p = int(at[s])
                    gram = context[begin(p) : end(p + symbols.gram - 1)]
                    part = context[begin(s) : end(last + symbols.window - 1)]
                    new = xxhash.xxh3_64_intdigest(gram + b"%d %d" % (p - b, head[i]), level)
                    row.append(i)
                    g.append(new)
                    digests.append(xxhash.xxh3_128_digest(part + b"%d %d" % (new, b - s), level))
                    before.append(b - s)
                    after.append(last + symbols.window - b)
                    contexts.append(part)
            c = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            of = [batch[x].take(pa.array(row, pa.int64())) for x in ("did", "th", "at", "g", "c1", "c2", "n")]
            own = [pa.array(np.array(g, np.uint64).view(np.int64)), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(before, pa.int32()), pa.array(after, pa.int32()), pa.array(contexts, pa.binary())]
            yield pa.RecordBatch.from_arrays([*of, *own], names)

    return found.mapInArrow(split, schema)


def block_verdicts(found: DataFrame, resolve: Resolve) -> DataFrame:
    """VERDICT by ``resolve``, a block in a task."""
    names = ["g", "c1", "c2", "did", "th", "at", "n", "runs"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: pa.Table) -> pa.RecordBatch:
            g = rows["g"].to_numpy()
            new = np.ones(len(g), bool)
            new[1:] = g[1:] != g[:-1]
            group = np.cumsum(new) - 1
            keep = (np.bincount(group)[group] > 1) | (rows["n"].to_numpy() > 1)
            rows, group = rows.filter(pa.array(keep)), group[keep]
            runs = resolve(group, rows) if len(rows) else []
            return pa.RecordBatch.from_arrays([rows[c].combine_chunks() if len(rows) else pa.array([], pa.int64()) for c in names[:-1]] + [pa.array(runs, pa.list_(RUN))], names)

        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(map(len, kept)) >= ROWS:
                rows = pa.Table.from_batches(kept)
                cut = len(rows) - int((rows["g"].to_numpy() == rows["g"][-1].as_py()).sum())  # the last block may go on
                if cut:
                    yield done(rows.slice(0, cut))
                kept = rows.slice(cut).combine_chunks().to_batches()
        if sum(map(len, kept)):
            yield done(pa.Table.from_batches(kept))

    return found.repartition("g").sortWithinPartitions("g").mapInArrow(work, VERDICT)


def spans(docs: DataFrame, symbols: Symbols, resolve: Resolve, all_copies: bool, crowd: int = CROWD) -> DataFrame:
    """did, th, spans: of each text with repeated windows, runs of these (starts from start to last, matching up to end), with where the first occurrence is.

    A context that occurs n > 1 times repeats with all its windows; all_copies tells if that holds for its earliest
    occurrence too, or only for the later ones. What ``resolve`` finds holds for the earliest (all_copies: for every) one."""
    spark = docs.sparkSession
    findable(spark)
    docs = docs.select("doc_id", "text")
    with workspace(spark):
        bits = bit_filter(repeated(docs, lambda texts: [anchors(v, e, symbols.window, symbols.gram).hash for v, e, *_ in symbols.pieces(texts)]))
        seed = 0
        while True:
            seen = stored(occurrences(docs, symbols, bits, seed), "occurrences")
            try:
                judged = stored(verdicts(blocks(seen), symbols, resolve, all_copies, crowd), "verdicts")
                break
            except Collision:
                seed += 1
        each = applied(seen.drop("context"), judged, symbols, all_copies).filter("r IS NOT NULL")
        span = F.struct(
            (F.col("at") + F.col("r.first")).alias("start"),
            (F.col("at") + F.col("r.last")).alias("last"),
            (F.col("at") + F.col("r.end")).alias("end"),
            F.col("ref.did").alias("ref"),
            (F.col("ref.at") + F.col("r.first")).alias("ref_start"),
        )
        return stored(each.groupBy("did", "th").agg(F.sort_array(F.collect_set(span)).alias("spans")), "spans", keep=True)


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` and ``__spans``; null for texts without any."""
    did, th = doc_key(docs)
    spans_ = found.select(F.col("did").alias("__did"), F.col("th").alias("__th"), F.col("spans").alias("__spans"))
    return docs.join(spans_, (did == F.col("__did")) & (th == F.col("__th")), "left").drop("__did", "__th")

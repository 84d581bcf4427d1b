"""Benchmark decontamination by suffix arrays of the training texts.

Texts are taken in shards of SHARD_BYTES by and large. The words of a shard are numbered by 64-bit hashes, documents parted by a number that no word has, and
a suffix array is made over all positions, ordered by their first DEPTH words, by prefix doubling. Every test suffix is then binary-searched in it, all at
once: the range of suffixes that share its first 13 words (or all words of a shorter item) gives all verbatim
occurrences and where they are. Those that can't be extended to the left are compared word by word beyond that, which gives
the longest verbatim matches; their words are compared by their bytes in the end, so that no hash decides. Nothing is shuffled, whatever documents repeat.

The benchmark is the query set. It is read in blocks of at most BLOCK_BYTES of text, longer items in overlapping parts; blocks are
broadcast, and a worker holds one at a time. The documents are read once, whatever the number of blocks.

A window is 13 consecutive words of an item; an item of fewer words, but not none, is one window. A document word
inside an occurrence of a window is hit. A document is contaminated if it has hits and these are a twentieth of its words or more.

Rows: a null text, or one without words, has no hits; nor does an item without words. Repeated documents and items
are judged each for itself; items that share an item_id are told apart in matches and count as one in ``items``, where a null item_id
is an id like any other (a digest of the ids leaves it out). Very long texts are a shard of their own. An empty table gives an empty
table, an empty benchmark no hits. Other columns are passed on, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import findable
from palisade.llm.repeats import Symbols

WINDOW = 13
#: Words that order a shard's suffixes; no search compares more.
DEPTH = 16
SHARD_BYTES = 8 << 20
#: Text of a block of the benchmark.
BLOCK_BYTES = 16_000_000

#: Bytes that are not in words become spaces; A-Z become a-z.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))

MATCH = "struct<item_id: bigint, item_word: int, doc_word: int, n_words: int>"
HITS = f"struct<n_words: bigint, hit: array<struct<start: int, end: int>>, items: array<bigint>, longest: int, matches: array<{MATCH}>>"

#: A part of an item: its number, its item_id, the place of its first word in the item, its folded text.
Part = tuple[int, int | None, int, bytes]


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD)


def words(text: str | None) -> list[bytes]:
    return folded(text).split()


class Numbered:
    """Folded texts one after the other: a number for each word, 0 after each text."""

    def __init__(self, texts: list[bytes]) -> None:
        self.raw = b" ".join(texts) + b" "
        hashed, self.begin, self.end = Symbols(1, 1, by_word=True).split(self.raw)
        ends = np.cumsum([len(t) + 1 for t in texts])
        upto = np.searchsorted(self.begin, ends)
        self.size = np.diff(upto, prepend=0)
        #: where each text begins among the numbers, and each number's text
        self.start = np.concatenate([[0], upto[:-1]]) + np.arange(len(texts)) if texts else np.zeros(0, np.int64)
        self.numbers = np.zeros(len(hashed) + len(texts), np.uint64)
        self.text = np.repeat(np.arange(len(texts)), self.size + 1)
        place = np.ones(len(self.numbers), bool)
        place[self.start + self.size] = False
        self.numbers[place] = np.maximum(hashed, np.uint64(1))

    def word(self, text: int, i: int) -> bytes:
        k = int(self.start[text]) - text + i
        return self.raw[self.begin[k] : self.end[k]]


def suffix_array(numbers: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """All positions, ordered by the ``depth`` numbers from there on, by doubling the numbers compared."""
    n = len(numbers)
    order = np.argsort(numbers, kind="stable")
    places, keys = np.arange(n), numbers[order]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    length = 1
    while n:
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        sizes = np.diff(first, append=len(keys))
        rank[order[places]] = np.repeat(places[first], sizes)
        tied = np.repeat(sizes > 1, sizes)
        if length >= depth or not tied.any():
            break
        places = places[tied]  # only suffixes that are equal so far are sorted again
        at = order[places]
        keys = rank[at].astype(np.uint64) << np.uint64(32) | (rank[np.minimum(at + length, n)] + 1).astype(np.uint64)
        again = np.argsort(keys, kind="stable")
        order[places], keys = at[again], keys[again]
        length *= 2
    return order


class Shard(Numbered):
    @cached_property
    def suffixes(self) -> np.ndarray:
        return suffix_array(self.numbers)


class TestSet(Numbered):
    """A block of the benchmark: its parts of items, and the suffixes to search for."""

    __test__ = False

    def __init__(self, parts: list[Part], window: int = WINDOW) -> None:
        super().__init__([p[3] for p in parts])
        self.parts, self.window = parts, window
        count = np.where(self.size > 0, np.maximum(self.size - window + 1, 1), 0)
        of = np.repeat(np.arange(len(parts)), count)
        self.wanted = self.start[of] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) if len(parts) else np.zeros(0, np.int64)
        self.length = np.minimum(window, self.size)[of] if len(parts) else np.zeros(0, np.int64)

    def search(self, shard: Shard, after: bool) -> np.ndarray:
        """For each wanted suffix the number of the shard's suffixes whose first words are less (after: or equal)."""
        lo, hi = np.zeros(len(self.wanted), np.int64), np.full(len(self.wanted), len(shard.numbers), np.int64)
        last = len(shard.numbers) - 1
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            at, own, n = shard.suffixes[mid], self.wanted[open_], self.length[open_]
            sign = np.zeros(len(open_), np.int8)
            same = np.arange(len(open_))
            for d in range(self.window):
                same = same[n[same] > d]
                if not len(same):
                    break
                a, b = shard.numbers[np.minimum(at[same] + d, last)], self.numbers[own[same] + d]
                sign[same] = np.where(a < b, -1, np.where(a > b, 1, 0))
                same = same[a == b]
            right = sign <= 0 if after else sign < 0
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        return lo

    def matches(self, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every longest match of a window or more: where it is in the shard, where in the block, its words."""
        lo, hi = self.search(shard, False), self.search(shard, True)
        n = hi - lo
        own = np.repeat(self.wanted, n)
        least = np.repeat(self.length, n)
        at = shard.suffixes[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        # those that go on to the left belong to a longer match; 0 never matches, as it parts texts
        before = (own > 0) & (at > 0) & (self.numbers[own - 1] != 0) & (self.numbers[own - 1] == shard.numbers[at - 1])
        at, own, size = at[~before], own[~before], least[~before]
        growing = np.arange(len(at))
        while len(growing):
            a, b = shard.numbers[at[growing] + size[growing]], self.numbers[own[growing] + size[growing]]
            growing = growing[(a == b) & (a != 0)]
            size[growing] += 1
        return at, own, size


def verified(tests: TestSet, shard: Shard) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, word, part, word of the part, words) of the longest matches, by the bytes of their words."""
    for at, own, n in zip(*(x.tolist() for x in tests.matches(shard)), strict=True):
        text, part = int(shard.text[at]), int(tests.text[own])
        i, j = at - int(shard.start[text]), own - int(tests.start[part])
        same = [shard.word(text, i + k) == tests.word(part, j + k) for k in range(n)]
        least = min(tests.window, int(tests.size[part]))
        k = 0
        while k < n:  # a run ends where hashes were equal, but not words
            end = same.index(False, k) if False in same[k:] else n
            if end - k >= least:
                yield text, i + k, part, j + k, end - k
            k = end + 1


def merged(spans: Iterator[tuple[int, int]]) -> list[dict]:
    """Spans without overlaps, in order."""
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def shards(texts: list[str | None], size: int = SHARD_BYTES) -> Iterator[tuple[int, Shard]]:
    """Shards of a batch, each with the number of its first text."""
    first, held, n = 0, [], 0
    for i, text in enumerate(texts):
        raw = folded(text)
        if held and n + len(raw) > size:
            yield first, Shard(held)
            first, held, n = i, [], 0
        held.append(raw)
        n += len(raw)
    if held:
        yield first, Shard(held)


def judged(blocks_: Iterator[TestSet], texts: list[str | None]) -> list[dict]:
    """HITS for each text of a batch. Parts of a long item that match on one diagonal are one match."""
    own = list(shards(texts))
    found: dict[int, dict[tuple, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
    for tests in blocks_:
        for first, shard in own:
            for text, i, part, j, n in verified(tests, shard):
                number, item, offset, _ = tests.parts[part]
                found[first + text][number, item, i - j - offset].append((i, i + n))
    out = [{"n_words": int(n), "hit": [], "items": [], "longest": 0, "matches": []} for _, shard in own for n in shard.size]
    for text, diagonals in found.items():
        row = out[text]
        for (_, item, diagonal), places in sorted(diagonals.items(), key=lambda x: (x[0][0], x[0][2])):
            row["matches"] += [{"item_id": item, "item_word": x["start"] - diagonal, "doc_word": x["start"], "n_words": x["end"] - x["start"]} for x in merged(places)]
        row["hit"] = merged((m["doc_word"], m["doc_word"] + m["n_words"]) for m in row["matches"])
        row["items"] = list(dict.fromkeys(m["item_id"] for m in row["matches"]))
        row["longest"] = max(m["n_words"] for m in row["matches"])
    return out


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES, window: int = WINDOW) -> Iterator[list[Part]]:
    """The items, in blocks of at most so many bytes of text; longer items in parts that overlap by a window less a word."""
    block, size = [], 0
    for number, row in enumerate(benchmark.select(F.col("item_id"), F.col("text")).toLocalIterator()):
        for offset, raw in in_parts(folded(row[1]), most, window):
            if block and size + len(raw) > most:
                yield block
                block, size = [], 0
            block.append((number, row[0], offset, raw))
            size += len(raw)
    if block:
        yield block


def in_parts(raw: bytes, most: int, window: int) -> Iterator[tuple[int, bytes]]:
    if len(raw) <= most:
        yield 0, raw
        return
    ws = raw.split()
    ends = np.cumsum([len(w) + 1 for w in ws])
    at = 0
    while True:
        before = int(ends[at - 1]) if at else 0
        end = min(len(ws), max(at + window, int(np.searchsorted(ends, before + most, "right"))))
        yield at, b" ".join(ws[at:end])
        if end == len(ws):
            return
        at = end - window + 1


def searched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` and ``__hits``: n_words, spans of hit words, items that occur, the longest match, all longest matches."""
    spark = docs.sparkSession
    findable(spark)
    match = pa.struct([("item_id", pa.int64()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())])
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    kind = pa.struct([("n_words", pa.int64()), ("hit", pa.list_(span)), ("items", pa.list_(pa.int64())), ("longest", pa.int32()), ("matches", pa.list_(match))])
    sent = [spark.sparkContext.broadcast(block) for block in blocks(benchmark, block_bytes, window)]

    @F.arrow_udf(HITS)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only = TestSet(sent[0].value, window) if len(sent) == 1 else None

        def each() -> Iterator[TestSet]:
            for block in sent:
                yield only or TestSet(block.value, window)
                if only is None and hasattr(block, "_value"):
                    del block._value  # read again from the executor's disk for the next batch

        for batch in batches:
            yield pa.array(judged(each(), batch.to_pylist()), kind)

    return docs.withColumn("__hits", hits(F.col("text")))


def n_hit() -> Column:
    return F.aggregate("__hits.hit", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated() -> Column:
    return (n_hit() > 0) & (20 * n_hit() >= F.col("__hits.n_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with their columns."""
    return searched(docs, benchmark).filter(~contaminated()).select(*(F.col(f"`{c}`") for c in docs.columns))

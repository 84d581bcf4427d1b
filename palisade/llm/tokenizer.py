"""Byte-level BPE: encoding by overlapping chunks, and decoding.

A text is cut into chunks of code points, each with an overlap into the next one. Each chunk is a row of its own and is pre-tokenised by itself,
from its first code point on, so that the chunks of a long text are worked on side by side. A chunk may begin within a pre-token, and then its first boundaries can be wrong. But
the pattern never looks back: two runs that share a boundary agree from there on. So the run of the chunk before and its own
are stitched at their first common boundary within the overlap, and each chunk encodes the pre-tokens between its two joints. Boundaries near the end of a chunk's overlap
could move if the text went on; only those count that have SETTLED changes of class (white space, letters, numbers, others)
after them, further than which no match of such a pattern looks. A text with a joint where the runs don't meet (a run of letters longer than the overlap)
is pre-tokenised whole, in one task. Each pre-token is then encoded by merging the pair of least rank, as long as there is one; equal pre-tokens are
encoded once in a worker. Decoding concatenates the bytes of the ids.

Rows: a null text counts as empty; an empty text has no ids. Texts of any length are encoded whole. Equal rows get equal
results; an empty table gives an empty table. Other columns are passed on, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import findable, kept, stored, workspace

#: Code points in a chunk, and in its overlap with the next one.
CHUNK, OVERLAP = 1 << 16, 1 << 11
#: Changes of class that must follow a boundary within an overlap.
SETTLED = 4
CLASSES = regex.compile(r"\s+|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+")
#: Pre-tokens that a worker remembers; then it forgets all and begins again.
REMEMBERED = 400_000
#: Code points of the chunks in a batch.
BATCH = 4 << 20
#: Symbols of a pre-token from which on the least pair comes from a heap instead of a scan.
HEAP = 200
NEVER = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def cut(text: str, chunk: int, overlap: int) -> list[str]:
    return [text[a : a + chunk + overlap] for a in range(0, len(text), chunk)]


def starts(pattern: regex.Pattern, part: str, last: bool) -> list[int]:
    """The boundaries (where pre-tokens begin) of a chunk's run that don't depend on what follows."""
    found = [m.start() for m in pattern.finditer(part)]
    if last:
        return found
    runs = [m.start() for m in CLASSES.finditer(part)]
    safe = runs[-SETTLED - 1] if len(runs) > SETTLED else -1
    return [s for s in found if s <= safe]


def between(pattern: regex.Pattern, part: str, begin: int, end: int | None) -> list[str]:
    """The pre-tokens of a chunk's run from a joint up to the next one."""
    return [m[0] for m in pattern.finditer(part, begin) if end is None or m.start() < end]


def stitched(pattern: regex.Pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[str]]:
    """The pre-tokens of ``text``, chunk by chunk; together they are those of one run over the whole text."""
    parts = cut(text, chunk, overlap)
    own = [starts(pattern, p, i * chunk + len(p) == len(text)) for i, p in enumerate(parts)]
    joints = [min({s - chunk for s in a if s >= chunk} & set(b), default=None) for a, b in zip(own, own[1:], strict=False)]
    if not text or None in joints:
        yield pattern.findall(text)
        return
    for part, begin, end in zip(parts, [0, *joints], [*(j + chunk for j in joints), None], strict=True):
        yield between(pattern, part, begin, end)


class Codec:
    """Encodes pre-tokens, remembering them, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.known: dict[str, tuple[int, str, bytes]] = {}

    def merge(self, raw: bytes) -> list[int]:
        """The ids of a pre-token: of neighbouring symbols the pair of least rank, the leftmost of equal ones, becomes one."""
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        if len(raw) >= HEAP:
            return self.merge_long(raw)
        get = self.ranks.get
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (least := min(pairs)) < NEVER:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], NEVER)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], NEVER)
        return [self.ranks[p] for p in parts]

    def merge_long(self, raw: bytes) -> list[int]:
        """The same with the pairs in a heap and the symbols (where they end, by where they begin) linked."""
        n = len(raw)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)

        def offer(i: int) -> None:
            if end[i] < n and (r := self.ranks.get(raw[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))

        while heap:
            _, i, e = heapq.heappop(heap)
            if gone[i] or end[i] >= n or end[end[i]] != e or end[i] == e:
                continue  # one of the two has been merged since
            gone[end[i]] = 1
            end[i] = e
            if e < n:
                before[e] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def piece(self, pre: str) -> tuple[int, str, bytes]:
        """How many ids a pre-token has, the ids as text, and the bytes they decode to."""
        ids = self.merge(pre.encode("utf-8", "surrogatepass"))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[pre] = out = (len(ids), ",".join(map(str, ids)), self.decode(ids))
        return out

    def pieces(self, pres: list[str]) -> tuple[int, bytes, bytes]:
        """The same of several pre-tokens."""
        if not pres:
            return 0, b"", b""
        get, piece = self.known.get, self.piece
        ns, said, decoded = zip(*[get(pre) or piece(pre) for pre in pres], strict=True)
        return sum(ns), ",".join(said).encode(), b"".join(decoded)

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        return [int(i) for part in stitched(self.pattern, text, chunk, overlap) if part for i in self.pieces(part)[1].split(b",")]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as text, SHA-256 of the bytes they decode to."""
        n, ids, raw = self.pieces(self.pattern.findall(text))
        return n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each file in a worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def encoded(text: Column, path: str, pattern: str) -> Column:
    """The ids of a text, as an array."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for batch in batches:
            yield pa.array([c.encode(t or "") for t in batch.to_pylist()], pa.list_(pa.int32()))

    return ids(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that an array of ids stands for."""

    @F.arrow_udf("binary")
    def raw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for batch in batches:
            yield pa.array([c.decode(x or []) for x in batch.to_pylist()], pa.binary())

    return raw(ids)


DIGESTS = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>"
KIND = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digests(text: Column, path: str, pattern: str) -> Column:
    """DIGESTS of a text that is one chunk."""

    @F.arrow_udf(DIGESTS)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for batch in batches:
            rows = [c.digests(x.as_py() or "") for x in batch]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], KIND[i].type) for i in range(3)], fields=list(KIND))

    return of(text)


def chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """rid, k, last, part: the chunks of texts (rid, text); last: it reaches the text's end."""
    names = ["rid", "k", "last", "part"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for rid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, part in enumerate(cut(text, chunk, overlap)):
                    rows.append((rid, k, k * chunk + len(part) == len(text), part))
                    size += len(part)
                    if size >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)

    return texts.select("rid", "text").mapInArrow(of, "rid bigint, k bigint, last boolean, part string")


def joints(parts: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """rid, k, joint: where (in chunk k) the run of the chunk before and its own meet first; null if they don't."""
    kind = pa.struct([("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32()))])

    @F.arrow_udf("struct<head: array<int>, tail: array<int>>")
    def ends(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        compiled = regex.compile(pattern)
        for part, last in batches:
            found = [starts(compiled, p, b) for p, b in zip(part.to_pylist(), last.to_pylist(), strict=True)]
            yield pa.array([{"head": [s for s in x if s <= overlap], "tail": [s - chunk for s in x if s >= chunk]} for x in found], kind)

    run = parts.select("rid", "k", ends("part", "last").alias("x")).select("rid", "k", "x.head", "x.tail")
    run = stored(run, "ends")
    before = run.select("rid", (F.col("k") + 1).alias("k"), F.col("tail").alias("before"))
    return run.filter("k > 0").select("rid", "k", "head").join(before, ["rid", "k"]).select("rid", "k", F.array_min(F.array_intersect("head", "before")).alias("joint"))


def long_digests(texts: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """rid and __bpe of texts (rid, text) of several chunks, each chunk a row that any task may take."""
    piece = pa.struct([("n", pa.int64()), ("ids", pa.binary()), ("raw", pa.binary())])

    @F.arrow_udf("struct<n: bigint, ids: binary, raw: binary>")
    def pieces(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for part, begin, end in batches:
            rows = [c.pieces(between(c.pattern, p, a, b)) for p, a, b in zip(part.to_pylist(), begin.to_pylist(), end.to_pylist(), strict=True)]
            yield pa.array([dict(zip(("n", "ids", "raw"), r, strict=True)) for r in rows], piece)

    @F.arrow_udf(DIGESTS)
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for found in batch:
                n, ids, raw = 0, hashlib.sha256(), hashlib.sha256()
                for x in found:
                    if m := x["x"]["n"].as_py():
                        ids.update((b"," if n else b"") + x["x"]["ids"].as_py())
                        raw.update(x["x"]["raw"].as_py())
                        n += m
                out.append({"n_tokens": n, "ids_sha256": ids.hexdigest(), "decoded_sha256": raw.hexdigest()})
            yield pa.array(out, KIND)

    with workspace(texts.sparkSession):
        parts = stored(chunks(texts, chunk, overlap).repartition("rid", "k"), "chunks")
        met = stored(joints(parts, pattern, chunk, overlap), "joints")
        apart = met.filter("joint IS NULL").select("rid").distinct()
        begins = met.select("rid", "k", F.col("joint").alias("begin"))
        ends = met.select("rid", (F.col("k") - 1).alias("k"), (F.col("joint") + chunk).alias("end"))
        whole = parts.join(apart, "rid", "left_anti").join(begins, ["rid", "k"], "left").join(ends, ["rid", "k"], "left")
        each = whole.select("rid", "k", pieces("part", F.coalesce("begin", F.lit(0)), "end").alias("x"))
        met_ = each.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("x")).select("rid", joined("x").alias("__bpe"))
        rest = texts.select("rid", "text").join(apart, "rid", "left_semi").select("rid", digests(F.col("text"), path, pattern).alias("__bpe"))
        return stored(met_.unionByName(rest), "bpe", keep=True)


def round_trip(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` and ``__bpe``: n_tokens, ids_sha256, decoded_sha256 of each whole text."""
    spark = docs.sparkSession
    findable(spark)
    several = F.coalesce(F.length("text"), F.lit(0)) > chunk
    short = docs.filter(~several).withColumn("__bpe", digests(F.col("text"), path, pattern))
    with workspace(spark):
        packed = docs.filter(several).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.monotonically_increasing_id().alias("rid"))
        long = stored(packed, "long", keep=True)
        found = kept(long_digests(long.select("rid", "__row.text"), path, pattern, chunk, overlap))
    return short.unionByName(long.join(found, "rid").select("__row.*", "__bpe"))

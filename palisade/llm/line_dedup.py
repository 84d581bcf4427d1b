"""Removal of repeated runs of lines, by content-defined chunks.

Blank lines belong to the line before them (those a text begins with, to the first that isn't blank), so that paragraphs parted by blank
lines are chunked as those that aren't. Each line that isn't blank has a hash; a polynomial hash rolls over those of the last ROLL, and a chunk
ends where it is 0 modulo EVERY. ROLL is 1: a run of lines has the same boundaries whatever stands before it, and lines inserted
or dropped elsewhere don't move them. Chunks have LEAST such lines at least, and no limit: a chunk without a boundary ends with its text. The hashes of chunks with two
of them or more are counted; a bounded filter of those that occur again decides which are sent. These are grouped by a 128-bit digest, and
their bytes compared; should two differ, all starts anew with another seed. Of equal chunks all but the first, in the smallest doc_id,
go. Grouping combines before the shuffle, so that a chunk that many texts share isn't a burden to one task.

Rows: a null text stays null; a text of single lines stays as it is. Texts of equal doc_id are ordered by a hash of the text; rows that
agree in doc_id and text are taken as one and the same. A null doc_id is larger than any. An empty table gives an empty
table. Very long texts are chunked whole. Other columns are passed on, whatever their names; n_chars follows the text if it is there.
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
from palisade.llm.repeats import REMEMBERED, Collision, _bytes, bit_filter, doc_key, passes, repeated

ROLL, EVERY, LEAST = 1, 2, 2
BASE, MASK = 0xD6E8FEB86659FD93, (1 << 64) - 1
DROP = (BASE ** ROLL) & MASK


def chunks(text: bytes) -> list[tuple[int, int]]:
    """(first line, lines) of each chunk of a text, in order."""
    lines = text.split(b"\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    hashes = [xxhash.xxh64_intdigest(lines[i]) for i in full]
    out, begin, first, roll = [], 0, 0, 0  # first: the chunk's first line, as counted without blank ones
    for k, h in enumerate(hashes):
        roll = (roll * BASE + h - (hashes[k - ROLL] * DROP if k >= ROLL else 0)) & MASK
        n = k + 1 - first
        if k + 1 < len(full) and n >= LEAST and (roll >> 32) % EVERY == 0:
            out.append((begin, full[k + 1] - begin))
            begin, first = full[k + 1], k + 1
    return [*out, (begin, len(lines) - begin)]


def eligible(text: bytes) -> list[tuple[int, int, bytes]]:
    """First line, lines and bytes of those chunks that have two lines or more that aren't blank."""
    if b"\n" not in text:
        return []
    lines = text.split(b"\n")
    own = ((a, n, lines[a : a + n]) for a, n in chunks(text) if n > 1)
    return [(a, n, b"\n".join(ls)) for a, n, ls in own if sum(bool(x.strip()) for x in ls) > 1]


def _hashes(texts: list[bytes]) -> list[np.ndarray]:
    return [np.array([xxhash.xxh3_64_intdigest(c) for t in texts for _, _, c in eligible(t)], np.uint64)]


SENT = "did bigint, th bigint, c1 bigint, c2 bigint, line int, lines int, chunk binary"


def sent(docs: DataFrame, bits: np.ndarray, seed: int) -> DataFrame:
    """SENT: the chunks that pass the filter; a task sends the bytes of a chunk once, and other bytes of the same digest too."""
    passed_on = docs.sparkSession.sparkContext.broadcast(bits.tobytes())
    names = [x.split()[0] for x in SENT.split(", ")]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(passed_on.value, np.uint8)
        told: dict[bytes, bytes] = {}
        held = 0
        for batch in batches:
            did, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = [(i, *c) for i, t in enumerate(_bytes(batch.column(2))) for c in eligible(t)]
            h = np.array([xxhash.xxh3_64_intdigest(c) for *_, c in found], np.uint64)
            keep = np.flatnonzero(passes(known, h)).tolist() if len(h) else []
            if not keep:
                continue
            i, line, lines, chunk = map(list, zip(*(found[k] for k in keep), strict=True))
            digests = [xxhash.xxh3_128_digest(c, seed) for c in chunk]
            for k, (d, c) in enumerate(zip(digests, chunk, strict=True)):
                if told.setdefault(d, c) is not c and told[d] == c:
                    chunk[k] = None
                else:
                    held += len(c) + 100
            if held > REMEMBERED:
                told.clear()
                held = 0
            c = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            columns = [did[i], th[i], c[:, 0], c[:, 1], np.array(line, np.int32), np.array(lines, np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(chunk, pa.binary())], names)

    return docs.select(*doc_key(docs), "text").mapInArrow(send, SENT)


def first_chunks(seen: DataFrame) -> DataFrame:
    """c1, c2, first: of each chunk that occurs again its first occurrence. Equal digests are checked by the bytes."""
    first = F.min(F.struct("did", "th", "line")).alias("first")
    differ = F.when(F.min("chunk") != F.max("chunk"), F.lit(1)).alias("differ")
    found = stored(seen.groupBy("c1", "c2").agg(first, F.count("*").alias("n"), differ).filter("n > 1").drop("n"), "first_chunks")
    if not found.filter("differ = 1").isEmpty():
        raise Collision
    return found.drop("differ")


def repeats(docs: DataFrame) -> DataFrame:
    """did, th, gone: of each text with chunks that occur before, first line and lines of these."""
    spark = docs.sparkSession
    findable(spark)
    with workspace(spark):
        bits = bit_filter(repeated(docs, _hashes))
        seed = 0
        while True:
            seen = stored(sent(docs, bits, seed), "chunks")
            try:
                groups = first_chunks(seen)
                break
            except Collision:
                seed += 1
        # both sides are read from storage: rows of a hot chunk can be split
        later = seen.drop("chunk").join(groups.hint("merge"), ["c1", "c2"]).filter(F.struct("did", "th", "line") != F.col("first"))
        return stored(later.groupBy("did", "th").agg(F.sort_array(F.collect_set(F.struct("line", "lines"))).alias("gone")), "gone", keep=True)


def marked(docs: DataFrame) -> DataFrame:
    """``docs`` and ``__gone``, the runs of lines to remove; null if there are none."""
    found = repeats(docs.select("doc_id", "text"))
    did, th = doc_key(docs)
    gone = found.select(F.col("did").alias("__did"), F.col("th").alias("__th"), F.col("gone").alias("__gone"))
    # always a merge join: the plan, and what it shuffles, is the same at every size
    return docs.join(gone.hint("merge"), (did == F.col("__did")) & (th == F.col("__th")), "left").drop("__did", "__th")


def without(text: str, gone: list[dict] | None) -> tuple[int, list[str]]:
    """How many lines a text has, and those that stay."""
    lines = text.split("\n")
    kept, at = [], 0
    for x in gone or []:
        kept += lines[at : x["line"]]
        at = x["line"] + x["lines"]
    return len(lines), kept + lines[at:]


def kept_text(text: Column, gone: Column) -> Column:
    """A text without its repeated chunks."""

    @F.arrow_udf("string")
    def kept(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            yield pa.array(["\n".join(without(t, g)[1]) for t, g in zip(texts.to_pylist(), found.to_pylist(), strict=True)], pa.string())

    return F.when(gone.isNull(), text).otherwise(kept(F.when(gone.isNull(), F.lit("")).otherwise(text), gone))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts that are left."""
    out = marked(docs).withColumn("text", kept_text(F.col("text"), F.col("__gone"))).drop("__gone")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest() -> Column:
    kind = pa.struct([("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    @F.arrow_udf("struct<n_lines: bigint, n_removed: bigint, kept_sha256: string>")
    def told(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            rows = []
            for t, g in zip(texts.to_pylist(), found.to_pylist(), strict=True):
                n, kept = without(t or "", g)
                rows.append({"n_lines": n, "n_removed": n - len(kept), "kept_sha256": hashlib.sha256("\n".join(kept).encode("utf-8", "surrogatepass")).hexdigest()})
            yield pa.array(rows, kind)

    return told(F.col("text"), F.col("__gone"))

"""Substring removal by relative Lempel-Ziv parsing.

The reference blocks hold the passages of all texts by their anchors (see ``repeats``; no other block can hold a window of a text than those
that its anchors name). In a block, the longest match of each place is found between its neighbours in the block's sorted suffixes.
A whole document is then factored greedily: from a place on, the longest match in any of its blocks is a factor, and the next
factor begins where it ends; a place that no block holds is a factor of one word. Factors of WINDOW words or more are
duplicate spans. A window that repeats as a whole can still straddle the boundary of two factors, as greedy factors begin anywhere; but it
contains one boundary at most, as the factor from there on reaches its end. So the places before each boundary are
checked for matches of a window that go beyond it.

Every word covered by a window that occurs elsewhere too, in the same text or another, is removed, in all its
occurrences; windows are judged on the input.

Rows: a null text has no words; texts of fewer words than a window lose nothing, very long ones are parsed whole. Repeated rows are copies of each other,
and lose all windows. An empty table gives an empty table. Other columns are passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.repeats import CROWD, Symbols, mixed, spans, with_spans
from palisade.llm.suffix_dedup import merged
from palisade.llm.suffixes import Block, reaches

WINDOW, GRAM = 35, 10
WORDS = Symbols(WINDOW, GRAM, by_word=True)
#: Texts whose spans are Python objects at once.
AT_ONCE = 200


def factored(found: list[dict] | None, window: int = WINDOW, boundaries: bool = True) -> list[dict]:
    """The duplicate spans of a document, from the matches of its places: greedy factors, then what straddles their boundaries.

    found: places from start to last match up to end; ref and ref_start tell where the passage around them is found first."""
    matches: list[tuple[int, int, int, dict]] = []  # (first, last, end) in order; of equal places the longest
    for x in sorted(found or [], key=lambda x: (x["start"], -x["end"], x["last"])):
        first = max(x["start"], matches[-1][1] + 1) if matches else x["start"]
        if first <= x["last"]:
            matches.append((first, x["last"], x["end"], x))
    out: list[dict] = []

    def duplicate(a: int, b: int, x: dict) -> None:
        if b - a >= window:
            out.append({"start": a, "end": b, "ref": x.get("ref"), "ref_start": x.get("ref_start", 0) + a - x["start"]})

    at, i = 0, 0
    while i < len(matches):
        first, last, end, x = matches[i]
        if last < at:
            i += 1
            continue
        factor = max(at, first)  # the places before are factors of one word
        at = end
        duplicate(factor, end, x)
        k = i
        while boundaries and k < len(matches) and matches[k][0] < at:  # windows that begin in this factor and end beyond it
            first, last, end, x = matches[k]
            begin = max(first, at - window + 1, factor + 1)
            if begin <= min(last, at - 1):
                duplicate(begin, end, x)
            k += 1
    return out


FACTOR = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("ref", pa.int64()), ("ref_start", pa.int64())])


def values(column: pa.Array) -> Iterator:
    """The values of a column, few of them at once."""
    for a in range(0, len(column), AT_ONCE):
        yield from column.slice(a, AT_ONCE).to_pylist()


def factors_of(found: pa.Array, window: int) -> pa.Array:
    parts = [pa.array([factored(x, window) or None for x in values(found.slice(a, AT_ONCE))], pa.list_(FACTOR)) for a in range(0, len(found), AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(FACTOR))


def factors(found: Column, window: int) -> Column:
    @F.arrow_udf("array<struct<start: bigint, end: bigint, ref: bigint, ref_start: bigint>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield factors_of(batch, window)

    return of(found)


def repeating(group: np.ndarray, rows: pa.Table, symbols: Symbols = WORDS) -> list[list[dict]]:
    """How far each window of a context matches other contexts of its group, if as a whole."""
    anchor = symbols.window - symbols.gram
    ids: dict[bytes, int] = {}
    words = [[ids.setdefault(w, len(ids) + 1) for w in c.split(b" ")] for c in rows["context"].to_pylist()]
    before, after = rows["before"].to_numpy().astype(np.int64), rows["after"].to_numpy().astype(np.int64)
    n = before + after
    row = np.repeat(np.arange(len(n)), n)
    matrix = np.zeros((len(n), anchor + symbols.window), np.int64)
    matrix[row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (anchor - before)[row]] = [i for ws in words for i in ws]
    block = Block(matrix, mixed(matrix.view(np.uint64), 0xD1B54A32D192ED03), anchor - before, anchor + after)
    row, col, bucket = block.suffixes(group, symbols.window)
    order, shared = block.neighbours(row, col, bucket, symbols.window, matrix.shape[1])
    longest = np.zeros(len(order), np.int64)
    longest[order] = np.maximum(shared, np.append(shared[1:], 0))
    long = longest >= symbols.window
    return reaches(row[long], col[long], (col + longest)[long], len(n), anchor)


def parsed(docs: DataFrame, symbols: Symbols = WORDS, crowd: int = CROWD) -> DataFrame:
    """``docs`` and ``__spans``: of each text the factors (in words) that occur elsewhere, with the place where the passage around them is found first; they may overlap."""
    found = spans(docs, symbols, lambda group, rows: repeating(group, rows, symbols), all_copies=True, crowd=crowd)
    return with_spans(docs, found.withColumn("spans", factors(F.col("spans"), symbols.window)))


def cut(text: str | None, found: list[dict] | None) -> tuple[int, list[bytes]]:
    """How many words a text has, and those that are left."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    kept, at = [], 0
    for a, b in merged(found):
        kept += words[at:a]
        at = b
    return len(words), kept + words[at:]


def kept_text() -> Column:
    """The words left of each text, joined by one space."""

    @F.arrow_udf("string")
    def kept(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, found in batches:
            yield pa.array([b" ".join(cut(t, s)[1]).decode("utf-8", "surrogatepass") for t, s in zip(values(text), values(found), strict=True)], pa.string())

    return kept(F.col("text"), F.col("__spans"))


def digest() -> Column:
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    @F.arrow_udf("struct<n_words: bigint, n_removed: bigint, kept_sha256: string>")
    def told(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            rows = []
            for t, s in zip(values(texts), values(found), strict=True):
                n, kept = cut(t, s)
                rows.append({"n_words": n, "n_removed": n - len(kept), "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()})
            yield pa.array(rows, kind)

    return told(F.col("text"), F.col("__spans"))

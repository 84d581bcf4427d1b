"""Exact substring removal by a hash-compared suffix sort.

Of each string of WINDOW bytes that occurs more than once, every byte of the later occurrences is removed: those in texts of
larger doc_id, or further on in the same text. Strings are judged on the input; matches never cross texts. How
occurrences meet is described in ``repeats``, how suffixes are sorted in ``suffixes``.

Rows: a null text is empty; texts shorter than a string lose nothing, very long ones are read whole, in overlapping pieces. Texts of equal doc_id are ordered by a hash of the
text; rows that agree in doc_id and text are taken as one and the same, and lose what one of them would. A null doc_id is
larger than any. An empty table gives an empty table. Other columns are passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.repeats import CROWD, Symbols, byte_values, spans, with_spans
from palisade.llm.suffixes import Block, runs

WINDOW, GRAM = 100, 32
BYTES = Symbols(WINDOW, GRAM, by_word=False)


def later(group: np.ndarray, rows: pa.Table, symbols: Symbols = BYTES) -> list[list[dict]]:
    """Which windows of each context are those of a context with an earlier occurrence in its group."""
    anchor = symbols.window - symbols.gram
    before, after = rows["before"].to_numpy().astype(np.int64), rows["after"].to_numpy().astype(np.int64)
    raw = np.frombuffer(b"".join(rows["context"].to_pylist()), np.uint8)
    n = before + after
    row = np.repeat(np.arange(len(n)), n)
    matrix = np.zeros((len(n), anchor + symbols.window), np.uint8)
    matrix[row, np.arange(len(raw)) - np.repeat(np.cumsum(n) - n, n) + (anchor - before)[row]] = raw
    block = Block(matrix, byte_values()[matrix], anchor - before, anchor + after)
    row, col, bucket = block.suffixes(group, symbols.window)
    order, shared = block.neighbours(row, col, bucket, symbols.window, symbols.window)
    if not len(order):
        return runs(row, col, len(n), anchor, symbols.window)
    rank = np.empty(len(n), np.int64)
    rank[np.lexsort((rows["at"].to_numpy(), rows["th"].to_numpy(), rows["did"].to_numpy()))] = np.arange(len(n))
    row, col = row[order], col[order]
    begin = np.flatnonzero(shared < symbols.window)  # of each class of equal windows
    least = np.repeat(np.minimum.reduceat(rank[row], begin), np.diff(begin, append=len(order)))
    again = rank[row] > least
    return runs(row[again], col[again], len(n), anchor, symbols.window)


def merged(found: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted((x["start"], x["end"]) for x in found or []):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def cut(text: str | None, found: list[dict] | None) -> tuple[bytes, bytes, list[tuple[int, int]]]:
    """A text's bytes, what is left of them, and the runs removed."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    gone = merged(found)
    kept, at = [], 0
    for a, b in gone:
        kept.append(raw[at:a])
        at = b
    return raw, b"".join([*kept, raw[at:]]), gone


def removed(docs: DataFrame, symbols: Symbols = BYTES, crowd: int = CROWD) -> DataFrame:
    """``docs`` and ``__spans``: of each text the spans (in bytes) that repeat earlier ones, with where; they may overlap."""
    return with_spans(docs, spans(docs, symbols, lambda group, rows: later(group, rows, symbols), all_copies=False, crowd=crowd))


def kept_bytes() -> Column:
    """What is left of each text; it may not be valid UTF-8, as bytes are removed."""

    @F.arrow_udf("binary")
    def kept(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, found in batches:
            yield pa.array([cut(t, s)[1] for t, s in zip(text.to_pylist(), found.to_pylist(), strict=True)], pa.binary())

    return kept(F.col("text"), F.col("__spans"))


def digest() -> Column:
    kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    @F.arrow_udf("struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string>")
    def told(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            rows = []
            for t, s in zip(texts.to_pylist(), found.to_pylist(), strict=True):
                raw, kept, gone = cut(t, s)
                rows.append({"n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(gone), "kept_sha256": hashlib.sha256(kept).hexdigest()})
            yield pa.array(rows, kind)

    return told(F.col("text"), F.col("__spans"))

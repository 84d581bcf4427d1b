"""Spans of a batch are Python objects for a few texts at once."""

import tracemalloc

import pyarrow as pa

from palisade.llm.relative_lz import WINDOW, factored, factors_of


def test_factors_hold_few_texts_at_once():
    kind = pa.list_(pa.struct([("start", pa.int64()), ("last", pa.int64()), ("end", pa.int64()), ("ref", pa.int64()), ("ref_start", pa.int64())]))
    row = [{"start": 100 * i, "last": 100 * i + 5, "end": 100 * i + 60, "ref": 10**6, "ref_start": 10**6 + i} for i in range(60)]
    found = pa.concat_arrays([pa.array([row, None, []], kind)] * 1_000)
    tracemalloc.start()
    got = factors_of(found, WINDOW)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.slice(0, 6).to_pylist() == [factored(row, WINDOW), None, None] * 2
    assert len(got) == 3_000 and peak < 15e6
    assert len(factors_of(found.slice(0, 0), WINDOW)) == 0

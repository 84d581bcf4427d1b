"""Scores are the same whatever is scored at once, and memory doesn't grow with a batch."""

import tracemalloc

import numpy as np

from palisade.llm import toxicity


def test_pieces_are_bounded_and_score_alike():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 5_000, 400)) for _ in range(2_000)] + [None, ""]
    row = rng.integers(0, 1_000, toxicity.SLOTS)
    machine = toxicity.Machine(-1.0, row, rng.normal(0, 0.1, 1_000), rng.normal(0, 0.01, (1_000, toxicity.FACTORS)))
    whole = machine.scores([toxicity.hashed(t) for t in texts])
    tracemalloc.start()
    parts = [machine.scores(rows) for rows in toxicity.pieces(texts)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(parts) > 5
    assert np.allclose(np.concatenate(parts), whole, rtol=0, atol=1e-12)
    assert peak < 60e6
    assert [*toxicity.pieces([])] == []

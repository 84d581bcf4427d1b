"""Toxicity scores by a factorization machine over hashed terms.

A term is a run of letters and digits in lower case; a text's features are the hashes of its distinct terms and of their
beginnings of PREFIXES code points, which inflected and compounded words share. The machine
adds up a bias, a weight for each feature, and for each pair of features the product of their factor vectors, so that
an insult together with a group's name can weigh more than the two by themselves. It is fitted by AdaGrad on the
logistic loss, on a bounded sample of labelled rows: at most TRAIN_ROWS of each class and TRAIN_FEATURES features of them, those whose hashed doc_id is
least. The sample's features come to the driver; scoring then runs over every whole text, in Arrow batches, without a
shuffle.

Features that MIN_ROWS rows of the sample have take part, whether they depend on the label by themselves or not. The many rare terms
are kept from learning single rows by heart by a proximal step: weights and factors shrink towards 0 at each update and are 0
unless rows agree. Toxic rows that are fewer than the others count up to TOXIC_WEIGHT times in the fit; what the sample's bound has changed in the classes' shares is set back in the end.
All parameters were set by cross-validation within the rows that aren't held out.

Rows: a null or empty text has no features and gets the score of the bias; very long ones have the features of their whole text. Repeated rows get equal scores; of several
labels of one doc_id the largest counts, and of several texts of a labelled doc_id one is learnt from. A null doc_id isn't learnt from, and isn't held out. Without labels of both classes the
score is the share of toxic labels, or 0 without any. An empty table gives an empty table. Other columns are passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import findable, text_key

#: Labelled rows of each class that the machine is fitted on, at most.
TRAIN_ROWS = 8_000
#: Their features (a long text has many), by class, at most; rows beyond that are left out of the sample.
TRAIN_FEATURES = 8_000_000
#: Slots for hashed terms.
SLOTS = 1 << 20
#: Lengths of the beginnings of terms that are features too.
PREFIXES = (4, 5)
MIN_ROWS, TOXIC_WEIGHT = 5, 2.0
#: Features that are scored at once; a text with more is scored by itself.
SCORED = 100_000
FACTORS, EPOCHS, RATE, FACTOR_RATE, BATCH, SEED = 8, 14, 0.1, 0.06, 128, 11
#: How far weights and factors shrink, in units of a gradient; how far factors spread at first.
SHRINK, FACTOR_SHRINK, SPREAD = 0.04, 0.1, 0.05

_FOLD = bytes(0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def hashed(text: str | None) -> list[int]:
    """The features of a text."""
    terms = {*(text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).decode("utf-8", "surrogatepass").split(" ")}
    terms.discard("")
    found = {crc32(w.encode("utf-8", "surrogatepass")) & SLOTS - 1 for w in terms}
    for n in PREFIXES:
        found |= {crc32(b"%d " % n + w.encode("utf-8", "surrogatepass")) & SLOTS - 1 for w in {w[:n] for w in terms if len(w) > n}}
    return list(found)


@dataclass
class Machine:
    """The bias, and for each slot the row of its weight and factors, 0 if it has none."""

    bias: float
    row: np.ndarray
    weight: np.ndarray
    factors: np.ndarray

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        flat = self.row[np.fromiter(chain.from_iterable(rows), np.int64)]
        ends = np.cumsum([len(r) for r in rows])
        of = np.repeat(np.arange(len(rows)), np.diff(ends, prepend=0))[flat > 0]
        flat = flat[flat > 0]
        return _sigmoid(_logits(self.bias, self.weight, self.factors, flat, of, len(rows))[0])


def pieces(texts: Iterable[str | None]) -> Iterator[list[list[int]]]:
    """The features of texts, in order, of so many texts at once as have SCORED features."""
    rows: list[list[int]] = []
    held = 0
    for text in texts:
        rows.append(hashed(text))
        held += len(rows[-1])
        if held >= SCORED:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logits(bias: float, weight: np.ndarray, factors: np.ndarray, flat: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: the machine's sum before the sigmoid, and the sum of its factor vectors. ``of`` is sorted."""
    linear, sums, squares = np.zeros(n), np.zeros((n, factors.shape[1])), np.zeros(n)
    if len(of):
        begin = np.flatnonzero(np.diff(of, prepend=-1))
        v = factors[flat]
        linear[of[begin]] = np.add.reduceat(weight[flat], begin)
        sums[of[begin]] = np.add.reduceat(v, begin)
        squares[of[begin]] = np.add.reduceat((v * v).sum(1), begin)
    return bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums


def fitted(flat: np.ndarray, sizes: np.ndarray, toxic: np.ndarray) -> Machine:
    """A machine for rows of features (all in one array, and how many each row has) and their labels."""
    y = toxic.astype(float)
    row = np.zeros(SLOTS, np.int64)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return Machine(float("-inf") if share == 0 else float("inf"), row, np.zeros(1), np.zeros((1, FACTORS)))
    of = np.repeat(np.arange(len(y)), sizes)
    used = np.flatnonzero(np.bincount(flat, minlength=SLOTS) >= MIN_ROWS)
    row[used] = np.arange(1, len(used) + 1)
    of, flat = of[row[flat] > 0], row[flat][row[flat] > 0]
    starts = np.searchsorted(of, np.arange(len(y) + 1))
    rng = np.random.default_rng(SEED)
    n = len(used) + 1
    weight, factors = np.zeros(n), rng.normal(0, SPREAD, (n, FACTORS))
    factors[0] = 0
    bias = float(np.log(share / (1 - share)))
    seen_w, seen_v = np.full(n, 1e-2), np.full((n, FACTORS), 1e-2)

    heavy = min(TOXIC_WEIGHT, max(1.0, (1 - share) / share))

    def shrunk(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.sign(x) * np.maximum(np.abs(x) - by, 0)

    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for part in np.array_split(order, max(1, len(y) // BATCH)):
            sizes = starts[part + 1] - starts[part]
            local = np.repeat(np.arange(len(part)), sizes)
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[part], sizes)
            features = flat[at]
            z, sums = _logits(bias, weight, factors, features, local, len(part))
            error = (_sigmoid(z) - y[part]) * np.where(y[part] > 0, heavy, 1) / len(part) * 16
            hit, back = np.unique(features, return_inverse=True)
            e = error[local]
            g = np.bincount(back, e, len(hit))
            ev = e[:, None] * (sums[local] - factors[features])
            gv = np.stack([np.bincount(back, ev[:, f], len(hit)) for f in range(FACTORS)], 1)
            seen_w[hit] += g * g
            seen_v[hit] += gv * gv
            step, step_v = RATE / np.sqrt(seen_w[hit]), FACTOR_RATE / np.sqrt(seen_v[hit])
            weight[hit] = shrunk(weight[hit] - step * g, step * SHRINK)
            factors[hit] = shrunk(factors[hit] - step_v * gv, step_v * FACTOR_SHRINK)
            bias -= RATE / 8 * error.sum()
    return Machine(bias, row, weight, factors)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features() -> callable:
    @F.arrow_udf("array<int>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [pa.array([sorted(r) for r in rows], pa.list_(pa.int32())) for rows in pieces(x.as_py() for x in batch)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return features


def _known(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the labelled rows that aren't held out."""
    usable = F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    return labels.filter(usable).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, features: int = TRAIN_FEATURES) -> DataFrame:
    """features and toxic of at most so many labelled rows of each class, with so many features; rows that are held out have no part in it."""
    known = _known(labels)
    least = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]
    ids = least[0].unionByName(least[1])  # 2 * rows at most, whatever the size of the input
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    got = texts.select("doc_id", "toxic", text_key(F.col("text")).alias("k"), _features()(F.col("text")).alias("features"))
    one = got.groupBy("doc_id").agg(F.min(F.struct("k", "features", "toxic")).alias("x")).select("doc_id", "x.features", "x.toxic")
    upto = F.sum(F.size("features")).over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return one.withColumn("upto", upto).filter(F.col("upto") <= features).select("doc_id", "features", "toxic").orderBy("doc_id")


def shift(labels: DataFrame, sampled: dict[int, int]) -> float:
    """What a sample of so many rows of each class lacks in the log-odds of toxic rows."""
    n = {r.toxic: r.n for r in _known(labels).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return float(np.log(max(1, n.get(1, 0)) / max(1, n.get(0, 0))) - np.log(max(1, sampled.get(1, 0)) / max(1, sampled.get(0, 0))))


def learnt(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    findable(docs.sparkSession)
    got = sample(docs, labels, rows).toArrow().combine_chunks()
    features = pa.concat_arrays(got["features"].chunks) if len(got) else pa.array([], pa.list_(pa.int32()))
    toxic = got["toxic"].to_numpy()
    machine = fitted(features.flatten().to_numpy(), np.diff(features.offsets.to_numpy()), toxic)
    return replace(machine, bias=machine.bias + shift(labels, {c: int((toxic == c).sum()) for c in (0, 1)}))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` and ``__score``."""
    spark = docs.sparkSession
    findable(spark)
    sent = spark.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [sent.value.scores(rows) for rows in pieces(x.as_py() for x in batch)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return docs.withColumn("__score", score(F.col("text")))

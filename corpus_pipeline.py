"""The corpus pipeline: documents that pass the quality rules, without repeated runs of lines, near copies and benchmark
passages, as byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet, which the next stage reads.
All but the last return the columns of ``documents``. A stage can also be chained lazily: what its result still reads belongs to the
workspace of the caller (``run`` opens one for each stage and deletes what it stored as soon as its result is written).

Rows, for every stage: an empty table gives an empty table; other columns are passed on, whatever their names, but by the last stage, which returns its own.
Very long texts are taken whole.
quality_rules: null and empty texts fail; repeated rows are judged each for itself; null lang or source is a group of its own.
line_chunks: null texts stay null, empty ones empty; of rows equal in doc_id and text each keeps what the first keeps; n_chars follows the text.
near_duplicates: texts without words, null ones too, are copies of each other; of repeated rows one stays; a null doc_id is larger than any.
decontamination: null and empty texts have no hits and stay; repeated rows are judged each for itself; an empty benchmark removes nothing.
byte_bpe: a null text counts as empty; repeated rows give equal rows; doc_id is passed on, null too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import decontaminate, line_dedup, near, quality, tokenizer
from palisade.llm.common import kept, release, stored, table, workspace
from palisade.llm.queries import tokenizer_files

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return quality.filtered(docs)


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that an earlier document has go from the texts."""
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity of 5-word shingles 0.8 or more) stays, that of the smallest doc_id."""
    return near.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, their number and digest, and the digest of what they decode to."""
    path, pattern = tokenizer_files()
    out = tokenizer.round_trip(docs.select("doc_id", "text"), path, pattern)
    return out.select("doc_id", "__bpe.*", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_chunks", line_chunks),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL has no near copies, content-defined chunks or BPE; tests compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    with workspace(spark):
        for name, f in STAGES:
            with workspace(spark):
                docs = stored(f(spark, docs, sf_dir), name, keep=True)
            if before is not None:
                release(before)
            before = docs
        return kept(docs)

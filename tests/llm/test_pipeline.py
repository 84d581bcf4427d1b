"""The pipeline against a plain version of it."""

import hashlib

import duckdb
import tiktoken

import corpus_pipeline
from palisade.llm import queries, tokenizer
from palisade.llm.common import shared_dir, workspace
from tests.compare import TABLES, duck
from tests.llm.fixtures import ODD, odd_docs
from tests.llm.test_copies import slow_eligible
from tests.llm.test_near import slow_roots
from tests.llm.test_text import slow_hits, slow_kept


def slow_pipeline():
    """Near copies are those of the pipeline's stage: a similarity of 5-word shingles of 0.8 or more."""
    docs = sorted(slow_kept(duck().sql("SELECT doc_id, text, lang, source FROM documents").fetchall()))
    seen, lines = set(), []
    for d, t in docs:
        raw, gone = (t or "").encode(), set()
        for a, n, c in slow_eligible(raw):
            if c in seen:
                gone.update(range(a, a + n))
            seen.add(c)
        lines.append((d, b"\n".join(x for i, x in enumerate(raw.split(b"\n")) if i not in gone).decode()))
    first = {}
    for (d, t), r in zip(lines, slow_roots([t for _, t in lines]), strict=True):
        first.setdefault(r, (d, t))
    kept = sorted(first.values())
    items = duckdb.connect().sql(f"SELECT item_id, text FROM '{TABLES}/benchmark.parquet'").fetchall()
    clean = [x for x, (n, h, _) in zip(kept, slow_hits(items, [t for _, t in kept]), strict=True) if not (h and 20 * h >= n)]
    path, pattern = queries.tokenizer_files()
    bpe = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=tokenizer.load_ranks(path), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return [(d, len(ids := bpe.encode_ordinary(t)), sha(",".join(map(str, ids)).encode()), sha(t.encode()), len(t.encode())) for d, t in clean]


def test_pipeline_by_a_plain_version(spark):
    expected = slow_pipeline()
    assert sorted(map(tuple, corpus_pipeline.run(spark, TABLES).collect())) == expected
    assert 0 < len(expected) < 200


def test_stages(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, TABLES)
        assert sorted(out.columns) == sorted(docs.columns)
        assert stage(spark, docs.limit(0), TABLES).count() == 0


def tables_left(spark):
    from pathlib import Path

    found = Path(shared_dir(spark).removeprefix("file://")).glob("palisade-*/*")
    return {p.name for p in found}


def test_stages_chained_without_storing(spark):
    """Each stage on the lazy result of the one before; in a workspace, nothing is left behind."""
    before = tables_left(spark)
    with workspace(spark):
        docs = spark.read.parquet(f"{TABLES}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, TABLES)
        got = sorted(map(tuple, docs.collect()))
        assert tables_left(spark) > before
    assert got == slow_pipeline()
    assert tables_left(spark) == before


def test_operators_in_threads(spark):
    """Four at once in one session: the results of each by itself, and no table is left."""
    from concurrent.futures import ThreadPoolExecutor

    before = tables_left(spark)

    def run(name):
        with workspace(spark):
            return sorted(map(tuple, queries.queries()[name](spark, TABLES).collect()))

    names = ["op10_suffixes", "op5_simhash", "op9_substrings", "op2_quality_rules"]
    with ThreadPoolExecutor(4) as pool:
        together = list(pool.map(run, names))
    assert tables_left(spark) == before
    for name, got in zip(names, together, strict=True):
        assert got == run(name)


def test_a_failing_operator_leaves_nothing(spark):
    from pyspark.sql import functions as F

    from palisade.llm import line_dedup

    before = tables_left(spark)
    docs = odd_docs(spark).withColumn("text", F.when(F.col("doc_id") == 10, F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    try:
        line_dedup.deduplicated(docs)
        raise AssertionError
    except Exception as e:
        assert "no" in str(e)
    assert tables_left(spark) == before


def test_stages_of_odd_rows(spark):
    """Null, empty, long and repeated rows, and columns with clashing names, through every stage."""
    docs = odd_docs(spark)
    n = {name: stage(spark, docs, TABLES) for name, stage in corpus_pipeline.STAGES}
    for name in list(n)[:-1]:
        assert n[name].schema == docs.schema, name
    assert n["quality_rules"].filter("text IS NULL OR text = ''").count() == 0
    assert n["line_chunks"].count() == len(ODD)
    assert n["line_chunks"].filter("text IS NULL").count() == 2
    assert n["near_duplicates"].filter("length(trim(coalesce(text, ''))) = 0").count() <= 1
    assert n["decontamination"].count() == len(ODD)
    assert n["byte_bpe"].count() == len(ODD)
    assert n["byte_bpe"].filter("doc_id IS NULL").count() == 2

"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import decontaminate, html, line_dedup, quality, relative_lz, simhash, sql, suffix_dedup, tokenizer, toxicity, warc
from palisade.llm.common import findable, scratch, stored, table


def _list_sha256(ids: Column) -> Column:
    """SHA-256 of ids, sorted as strings, comma-joined."""
    return F.sha2(F.array_join(F.sort_array(F.transform(ids, lambda x: x.cast("string"))), ",").cast("binary"), 256)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.scored(docs, toxicity.learnt(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.3).cast("int").alias("predicted"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.scored(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.searched(docs, table(spark, sf_dir, "benchmark"))
    hits = F.col("__hits")
    return out.select(
        "doc_id",
        hits["n_words"].alias("n_words"),
        decontaminate.n_hit().alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        _list_sha256(hits["items"]).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
        hits["longest"].alias("longest_match"),
    )


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.marked(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", line_dedup.digest().alias("x")).select("doc_id", "x.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    findable(spark)
    docs = table(spark, sf_dir, "documents")
    rows = stored(docs.select("doc_id", simhash.fingerprints(F.col("text")).alias("fp")), "rows")
    return simhash.grouped(rows).select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def tokenizer_files() -> tuple[str, str]:
    """The vocabulary and the pattern that op6 and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenizer.round_trip(docs, *tokenizer_files()).select("doc_id", "__bpe.*")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are read with their payloads, which are checked against their digests; of revisits only the headers."""
    path = scratch(spark, "warc", keep=True)
    warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    out = warc.read(spark, path, record_type=["response"]).unionByName(warc.read(spark, path, payload=False, record_type=["revisit"]))
    size = F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes"))
    return out.select(warc.page_of("record_id").alias("page_id"), size.alias("payload_bytes"), "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relative_lz.parsed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", relative_lz.digest().alias("x")).select("doc_id", "x.*")


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", suffix_dedup.digest().alias("x")).select("doc_id", "x.*")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_quality_rules, op3_decontamination, op4_line_chunks, op5_simhash, op6_byte_bpe, op7_main_text, op8_warc, op9_substrings, op10_suffixes)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": sql.OP2, "op3_decontamination": sql.OP3, "op8_warc": sql.OP8, "op9_substrings": sql.OP9, "op10_suffixes": sql.OP10}

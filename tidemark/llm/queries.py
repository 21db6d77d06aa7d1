"""Registered queries of the corpus operators, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    conversation_repair, decontaminate, filter_audit, kd_shards, ngram_join, quality, quality_rules, suffix_dedup,
    token_counts, token_files, toxicity, transducer, warc,
)
from tidemark.llm.oracles import ORACLES  # noqa: F401
from tidemark.session import prepare

VOCABULARY = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@query
def op1_quality_classifier(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(documents, table(spark, sf_dir, "labels"))
    return quality.classify(documents, model).select("doc_id", "held_out", "score", "predicted")


@query
def op2_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), ngram_join.Similarity(words=4, percent=85))


@query
def op3_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.remains(table(spark, sf_dir, "documents"), suffix_dedup.Settings(length=100))


@query
def op4_token_id_output(spark, sf_dir):
    files, _ = token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary_path())
    return token_files.read_token_files(files)


@query
def op5_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path(), limit=2048)


@query
def op6_bpe_encode_decode(spark, sf_dir):
    return transducer.digests(table(spark, sf_dir, "documents"), vocabulary_path())


@query
def op10_benchmark_decontamination(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = decontaminate.find_leaks(documents, table(spark, sf_dir, "benchmark"))
    return leaks.selectExpr("doc_id", "size(leaked_items) > 0 as contaminated", "leaked_items")


@query
def op8_kd_tree_shards(spark, sf_dir):
    rows = kd_shards.kd_shards(table(spark, sf_dir, "documents"), shards=40)
    return rows.selectExpr("doc_id", "size", "text_crc32", "'bytes' as law", "shard", "slot", "int(null) as grown_shard")


@query
def op9_warc(spark, sf_dir):
    arcs = warc.write_arcs(table(spark, sf_dir, "pages"))
    return warc.warc_index(warc.convert(arcs))


@query
def op7_quality_rules(spark, sf_dir):
    rows = quality_rules.judge(table(spark, sf_dir, "documents"))
    return rows.drop("class_distance", "word_distance")


@query
def op11_conversation_repair(spark, sf_dir):
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


@query
def op12_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    return toxicity.classify(documents, model).select("doc_id", "held_out", "score", "predicted")


@query
def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

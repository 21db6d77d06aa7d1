"""The corpus pipeline: every stage works on what the stage before it kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, ngram_join, quality, suffix_dedup, transducer
from tidemark.llm.queries import table, vocabulary_path
from tidemark.session import materialize, prepare

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier accepts."""
    model = quality.fit(docs, table(prepare(spark), sf_dir, "labels"))
    return quality.classify(docs.select(COLUMNS), model).where("predicted = 1").select(COLUMNS)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of every group, and every text of it.

    Groups are those of 5-word shingles with a similarity of 0.8. Of rows with equal
    id and text one stays, that with the smallest other columns. Rows with a null id
    are no copies of anything and stay.
    """
    found = ngram_join.jaccard_components(docs, ngram_join.Similarity(words=5, percent=80))
    copies = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    kept = docs.select(COLUMNS).where("doc_id is not null").join(copies, "doc_id", "left_anti")
    kept = kept.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    return kept.select("doc_id", "text", "rest.*").union(docs.select(COLUMNS).where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of 100 bytes and more out of the texts; ``n_chars`` follows.

    Documents that lose everything go.
    """
    cut = suffix_dedup.deduplicate(docs.select(COLUMNS), suffix_dedup.Settings(length=100))
    return cut.selectExpr("doc_id", "text", "lang", "source", "bigint(length(text)) as n_chars")


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents into which benchmark items leak."""
    found = decontaminate.find_leaks(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where("size(leaked_items) = 0").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and the text decoded from them."""
    encoded = transducer.encode(docs, vocabulary_path())
    return encoded.selectExpr("doc_id", "octet_length(ids) div 4 as n_tokens", "ids", "decoded")


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", join_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", remove_benchmarks),
    ("BPE encoding and decoding", encode),
]

# The classifier and the encoder are no SQL; tests/llm holds the stages against
# brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    *stages, (_, last) = STAGES
    docs = reduce(lambda kept, stage: materialize(stage[1](spark, kept, sf_dir), "stage"), stages, docs)
    return last(spark, docs, sf_dir)

"""Text line sources: one event per line, ``event_ts,id,content``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path)


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Text files as a stream, oldest file first.

    A replayable source: after a failure the same files form the same batch.
    """
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)


def stream_kafka_lines(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """The same lines from Kafka topics, read by as many tasks as there are partitions."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    rows = reader.option("subscribe", topic).options(**options).load()
    return rows.selectExpr("cast(value as string) as value")

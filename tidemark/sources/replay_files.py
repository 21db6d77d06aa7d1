"""Replay files: arrival-ordered CSV with offsets in seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.parse import offset_to_epoch_ms
from tidemark.sources import schemas


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    """Typed scan without schema inference (no extra pass over the file)."""
    return spark.read.schema(schemas.REPLAY).option("header", True).csv(path)


def replay_events(replay: DataFrame, base_s: float = 0.0) -> DataFrame:
    """Arrival log of a replay that starts at ``base_s`` (epoch seconds)."""
    return replay.selectExpr(
        f"{offset_to_epoch_ms(f'{float(base_s)}D', 'event_offset')} as event_ts",
        f"{offset_to_epoch_ms(f'{float(base_s)}D', 'send_offset')} as arrival_ts",
        "id as log_id",
        "content",
        "bigint(round(delay * 1000)) as delay_ms",
    )


def to_replay(log: DataFrame, base_ms: int, unit_ms: int = 1000) -> DataFrame:
    """Replay rows of an arrival log; offsets and delay with four decimals."""
    unit = f"{float(unit_ms)}D"
    return log.selectExpr(
        f"round((arrival_ts - {base_ms}) / {unit}, 4) as send_offset",
        f"round((event_ts - {base_ms}) / {unit}, 4) as event_offset",
        "log_id as id",
        f"round(delay_ms / {unit}, 4) as delay",
        "content",
    )


def write_replay(replay: DataFrame, path: str) -> None:
    """Globally sorted by arrival: range partitioned, then sorted in each file."""
    ordered = replay.repartitionByRange("send_offset", "id").sortWithinPartitions("send_offset", "id")
    ordered.write.option("header", True).csv(path)

"""Summary texts of runs: writing them and reading the numbers back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.arith import percent_text

# Labels of the stored summary texts.
RUN_LABEL = "实验"
ROWS_LABEL = "总数据量(清洗后)"
PROCESSED_LABEL = "处理数据量"
LATE_LABEL = "丢弃数据量(LATE)"
DROP_LABEL = "总丢弃率"
LATENCY_LABEL = "平均处理延迟"
TRIGGER_LABEL = "平均窗口触发延迟"

SUMMARY_FILE = "summary.txt"
WINDOW_SUMMARY_FILE = "summary_window.txt"


def _number(label: str, unit: str) -> str:
    found = rf"regexp_extract(value, r'{label}:\s*([\d\.]+)\s*{unit}', 1)"
    return f"coalesce(try_cast(nullif({found}, '') as double), 0D)"


def parse_summaries(texts: DataFrame) -> DataFrame:
    """Numbers from ``run_id, value`` rows with one whole text each; 0.0 if missing.

    Stored texts are rounded: two decimals of a percentage, four of a second.
    """
    return texts.selectExpr(
        "run_id",
        f"{_number(DROP_LABEL, '%')} / 100D as drop_rate",
        f"{_number(LATENCY_LABEL, 's')} as avg_latency_s",
    )


def parse_window_summaries(texts: DataFrame) -> DataFrame:
    return texts.selectExpr("run_id", f"{_number(TRIGGER_LABEL, 's')} as avg_trigger_delay_s")


def read_texts(spark: SparkSession, folder: str, file_name: str = "*.txt") -> DataFrame:
    """Whole texts ``folder/<run>/file_name`` with the run taken from the folder.

    Folders may also be named ``run_id=<run>``, as ``write_texts`` names them.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file_name)
    texts = reader.text(folder, wholetext=True)
    name = "url_decode(replace(element_at(split(_metadata.file_path, '/'), -2), '+', '%2B'))"
    # File paths are encoded twice: as a partition's name, and as a URI.
    return texts.selectExpr(f"{name} as name", "value").selectExpr(
        "if(startswith(name, 'run_id='), url_decode(replace(substr(name, 8), '+', '%2B')), name) as run_id", "value"
    )


def summary_texts(summaries: DataFrame) -> DataFrame:
    """Texts of ``run_id, rows, processed, late, drop_rate, avg_latency_s`` rows."""
    lines = [
        f"concat('{RUN_LABEL}: ', run_id)",
        f"concat('{ROWS_LABEL}: ', rows)",
        f"concat('{PROCESSED_LABEL}: ', processed)",
        f"concat('{LATE_LABEL}: ', late)",
        f"concat('{DROP_LABEL}: ', {percent_text('drop_rate')})",
        f"format_string('{LATENCY_LABEL}: %.4f s', avg_latency_s)",
    ]
    return summaries.selectExpr("run_id", f"concat_ws('\n', {', '.join(lines)}, '') as value")


def window_summary_texts(summaries: DataFrame) -> DataFrame:
    text = f"format_string('{TRIGGER_LABEL}: %.4f s\n', avg_trigger_delay_s) as value"
    return summaries.selectExpr("run_id", text)


def write_texts(texts: DataFrame, folder: str) -> None:
    """One text per run below ``folder/run_id=<run>/``."""
    texts.select("run_id", F.col("value")).write.partitionBy("run_id").text(folder)

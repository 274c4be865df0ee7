"""Log streams: the same scans over batch and streaming lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scan import scan_raw
from ..rules import Rule, builtin
from ..schema import FINDING, FINDING_COLUMNS

VAULT_TOKENS = Rule("vault-token-in-log", "Vault token in a log line", "high", r"(?i)\b([shbr])\.([A-Za-z0-9]{20,})\b")


def log_lines(lines: DataFrame, source: str, text: str = "value") -> DataFrame:
    """(path, line, text) of a batch of log lines in file order; a stream has no numbers, its lines are 0.

    Lines are numbered within the block of the file they were read from, or the
    partition where there is no file, and blocks by the lines of those before.
    """
    if lines.isStreaming:
        return lines.select(F.lit(source).alias("path"), F.lit(0).alias("line"), F.col(text).alias("text"))
    at = F.monotonically_increasing_id()
    try:
        rows = lines.select(F.col(text).alias("text"), at.alias("_at"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    except AnalysisException:
        rows = lines.select(F.col(text).alias("text"), at.alias("_at"), F.lit("").alias("_file"), F.shiftright(at, 33).alias("_block"))
    blocks = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    blocks = blocks.select("_file", "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at"))
    return rows.withColumn("_place", place).join(blocks, ["_file", "_block"]).select(F.lit(source).alias("path"), (F.col("_before") + F.col("_place")).cast("int").alias("line"), "text")


def scan_log(lines: DataFrame, rules: list[Rule] | None = None, max_lines: int = 0) -> DataFrame:
    """Raw findings of the first max_lines lines (0: all)."""
    return scan_raw(lines.orderBy("line").limit(max_lines) if max_lines and not lines.isStreaming else lines, rules)


def read_log_file(spark: SparkSession, path: str) -> DataFrame:
    return log_lines(spark.read.text(path), path)


def stream_log_folder(spark: SparkSession, path: str) -> DataFrame:
    return log_lines(spark.readStream.text(path), path)


def stream_log_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    return log_lines(spark.readStream.format("socket").option("host", host).option("port", port).load(), f"tcp://{host}:{port}")


def connection_error(spark: SparkSession, source: str, message: str) -> DataFrame:
    """The finding that says a stream could not be opened."""
    row = ("syslog-connection-error", message, "low", 1, source, 0, 0, "", message, None, False, None, None)
    return spark.createDataFrame([row], FINDING)


def scan_vault_tokens(lines: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    return scan_raw(lines, [VAULT_TOKENS, *(builtin() if rules is None else rules)])


def start_scan(lines: DataFrame, sink: str, checkpoint: str, rules: list[Rule] | None = None) -> StreamingQuery:
    """Findings of a stream of lines, appended as Parquet."""
    return scan_raw(lines, rules).select(*FINDING_COLUMNS).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").start()

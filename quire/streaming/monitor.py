"""Live monitoring as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators import monitoring as M

REQUEST = "ts timestamp, ord long, method string, path string, status_code int, latency_ms double"


def requests(spark: SparkSession, path: str, *, files_per_trigger: int = 10) -> DataFrame:
    """A stream of request records from JSON-lines files as they come in."""
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_per_trigger).json(path)


def ingest(stream: DataFrame, table_path: str, checkpoint: str, *, seconds: float | None = 5) -> StreamingQuery:
    """Appends the stream to a Parquet table; the file sink's log keeps each record once over restarts."""
    out = stream.writeStream.format("parquet").outputMode("append").option("path", table_path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if seconds is None else out.trigger(processingTime=f"{seconds} seconds")).start()


def snapshot(spark: SparkSession, table_path: str, *, keep: int = 500) -> DataFrame:
    """The monitor's view of the latest requests: a top-n over the table."""
    return M.api_summary(spark.read.schema(REQUEST).parquet(table_path), keep=keep)


def windowed(stream: DataFrame, *, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Requests, errors and mean latency of each path and time window; an extension with bounded state."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "path")
    return w.agg(F.count(F.lit(1)).alias("requests"), F.sum((F.col("status_code") >= 400).cast("long")).alias("errors"), F.avg("latency_ms").alias("avg_ms")).select(F.col("w.start").alias("start"), "path", "requests", "errors", "avg_ms")

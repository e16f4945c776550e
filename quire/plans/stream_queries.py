"""Monitoring as a stream, run to its end over files made from the events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.plans import monitor_queries
from quire.sources.shared import shared_folder
from quire.sources.synthetic import requests
from quire.streaming import monitor


def stream_monitor(spark, sf_dir):
    """Replays the requests as files, ingests them as a stream and summarises the latest."""
    at = f"{shared_folder(spark).rstrip('/')}/quire-stream-{uuid.uuid4().hex}"
    requests(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).write.json(f"{at}/in")
    monitor.ingest(monitor.requests(spark, f"{at}/in"), f"{at}/table", f"{at}/log", seconds=None).awaitTermination()
    return monitor.snapshot(spark, f"{at}/table")


QUERIES = {"stream_monitor": stream_monitor}
ORACLE_SQL = {"stream_monitor": monitor_queries.ORACLE_SQL["api_summary"]}

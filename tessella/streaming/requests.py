"""Requests as a stream. The service is stateless, so each request is a row of its own: no watermark and no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.qa import request_fault


def request_stream(spark: SparkSession, path: str) -> DataFrame:
    """(body, fault) of request bodies that arrive as lines of text files in a folder."""
    return spark.readStream.text(path).select(F.col("value").alias("body"), request_fault(F.col("value")).alias("fault"))


def serve(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Answer sound requests batch by batch (`answer`: rows with body -> rows with body, status and response) and write all of them
    to `out`; unsound ones get status 422. A batch that is run again overwrites its own folder, so each is written once."""

    def batch(df: DataFrame, number: int) -> None:
        bad = df.filter("fault is not null").select("body", F.lit(422).alias("status"), F.col("fault").alias("response"))
        answer(df.filter("fault is null").select("body")).select("body", "status", "response").unionByName(bad).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Scores of answers as they arrive: lines of JSON (a record and its response) in a folder, results appended as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.generate import score
from ..sources.records import LINE


def score_stream(spark: SparkSession, folder: str, layouts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch is scored like a batch job; ids that came before (a file written again) are dropped within the watermark of a day."""
    lines = spark.readStream.schema("value string").text(folder)
    rows = lines.select(F.from_json("value", LINE + ", response string").alias("r"), F.current_timestamp().alias("seen")).select("r.*", "seen").where("id is not null")
    rows = rows.withWatermark("seen", "1 day").dropDuplicatesWithinWatermark(["id"])

    def put(batch: DataFrame, number: int) -> None:
        score(batch, layouts).write.mode("overwrite").parquet(f"{out}/batch={number}")  # the same batch again replaces itself

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

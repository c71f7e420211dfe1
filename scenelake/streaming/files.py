"""Following a folder of results: files not yet in the log are processed, then the query stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def process_new(spark: SparkSession, source: str, schema: StructType, sink: str, log: str, transform) -> None:
    """Run ``transform`` over all Parquet files of ``source`` that no earlier call has seen.

    The checkpoint ``log`` holds the files seen, so a repeated call processes new files only; each
    call ends once nothing is left.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    query = (
        transform(stream)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", log)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Event-time sessions of each user: streaming with a watermark, or in a batch."""
    from pyspark.sql import functions as F

    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(
        "user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"
    )

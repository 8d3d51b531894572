"""Sufficient statistics kept up to date from a stream of detections (an extension).

Detections (id, occasion, event time) are deduplicated within a watermark, appended to a table of
captures partitioned by occasion, and ``current`` compresses that table at any time.  Batches are
written under their epoch, so a batch that is repeated after a failure overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldmark.operators.suffstat import compressed
from fieldmark.sources.histories import summarised


def maintain(detections: DataFrame, table: str, checkpoint: str, time_col: str = "ts", delay: str = "1 day", trigger: dict | None = None) -> StreamingQuery:
    """Start writing distinct (id, occasion) pairs of ``detections(id, occasion, <time_col>)`` to ``table``."""
    pairs = detections.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["id", "occasion"]).select("id", "occasion")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")

    return pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(detections: DataFrame, time_col: str = "ts", delay: str = "1 day", length: str = "7 days") -> DataFrame:
    """Captures and individuals (approximate) per event-time window, for monitoring a survey as it runs."""
    return detections.withWatermark(time_col, delay).groupBy(F.window(time_col, length)).agg(F.count(F.lit(1)).alias("captures"), F.approx_count_distinct("id").alias("individuals"))


def current(spark: SparkSession, table: str, occasions: int) -> DataFrame:
    """(x, e, l, n) of all individuals seen so far; late repeats across batches count once."""
    seen = spark.read.schema("id long, occasion int").parquet(table).where(F.col("occasion").between(0, occasions - 1))
    cells = [F.max(F.when(F.col("occasion") == t, 1).otherwise(0)) for t in range(occasions)]
    return compressed(summarised(seen.groupBy("id").agg(F.array(*cells).alias("h")), occasions))

"""Drift of a stream of candidates, window by window, against the stored histogram of the golden texts.

The state of a window is one array of counts, whatever the number of texts; it is dropped when the watermark has passed.
A text that is late but within the delay counts in its window, whose row is then written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scorelake.operators import drift
from scorelake.operators.runs import checked_threshold


def stored_counts(golden: DataFrame, bucket: Column, buckets: int) -> list[int]:
    """The golden texts' histogram, as many numbers as there are buckets."""
    return list(golden.agg(drift.counts(bucket, buckets).alias("c")).first()["c"])


def windows(candidates: DataFrame, ts: str, bucket: Column, golden: list[int], window: str, delay: str, threshold: float = drift.THRESHOLD) -> DataFrame:
    """(window_start, window_end, n, counts, drift_score, status) of a stream, or of a table, of candidates. A null time is
    in no window and is left out, as is a null bucket from the counts; ``golden`` are the ``stored_counts``."""
    checked_threshold(threshold, "threshold", 1.0)
    if not golden:
        raise ValueError("the golden histogram has no buckets")
    rows = candidates.withColumn(ts, F.col(ts).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(ts, delay)
    held = rows.groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("n"), drift.counts(bucket, len(golden)).alias("counts"))
    score = drift.divergence(F.array(*(F.lit(int(x)).cast("long") for x in golden)), F.col("counts"))
    scored = held.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "counts", score.alias("drift_score"))
    return scored.withColumn("status", F.when(F.col("drift_score") > threshold, "drifted").otherwise("ok"))


def write(windows_: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start to write a stream's ``windows`` below ``folder``: each batch's changed windows, in a folder of the batch. A
    batch that is run again after a failure replaces its own folder."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return windows_.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """Each window as it was written last."""
    rows = spark.read.parquet(folder)
    names = [c for c in rows.columns if c != "batch"]
    return rows.groupBy("window_start").agg(F.max_by(F.struct(*names), "batch").alias("r")).select("r.*")

"""Change statistics over hunks that keep arriving.

State is kept per file of a change set and dropped by watermark; every micro-batch is
written through a batch function, so a repeated batch overwrites its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_stats(hunks: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Hunks, additions and deletions per change set and event-time window (column arrived_at).

    Hunks delivered again within the watermark count once.
    """
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return (
        deduplicated(hunks, late)
        .groupBy(F.window("arrived_at", window).alias("w"), "changeset_id")
        .agg(F.count("*").alias("hunks"), F.sum(size("additions")).alias("additions"), F.sum(size("deletions")).alias("deletions"))
        .select(F.col("w.start").alias("window_start"), "changeset_id", "hunks", "additions", "deletions")
    )


def deduplicated(hunks: DataFrame, late: str = "30 minutes") -> DataFrame:
    """Arriving hunks without those delivered before within the watermark."""
    return hunks.withWatermark("arrived_at", late).dropDuplicatesWithinWatermark(["changeset_id", "path", "hunk_ord"])


def analyze_batches(hunks: DataFrame, analyzer, out: str, checkpoint: str) -> StreamingQuery:
    """Run a batch analyzer (DataFrame -> DataFrame) over each micro-batch; output is keyed by batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        analyzer(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return hunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

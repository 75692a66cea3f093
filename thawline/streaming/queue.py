"""Resumable scoring of pairs, and counts over event time.

The work queue is a folder of pair files read as a stream: a checkpoint remembers which files are
scored, so a stopped run goes on where it was and publishes each pair once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import StreamingQueryException
from pyspark.sql.streaming import StreamingQuery

from ..operators.synthetic import PairScorer, hashed_scorer, score_pairs


def score_queue(spark: SparkSession, pairs: str, out: str, checkpoint: str, scorer: PairScorer = hashed_scorer, files: int = 8) -> StreamingQuery:
    """Scores all pair files (user_id, item_id, prompt, Parquet) that are there and not scored yet, then stops."""
    rows = spark.readStream.schema("user_id long, item_id long, prompt string").option("maxFilesPerTrigger", files).parquet(pairs)
    return score_pairs(rows, scorer).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def run_queue(spark: SparkSession, pairs: str, out: str, checkpoint: str, scorer: PairScorer = hashed_scorer, files: int = 8, failures: int = 3) -> int:
    """``score_queue`` to its end, started again after a failure as often as ``failures`` times in a row without progress; each start goes on where
    the checkpoint stands.  Returns the number of starts."""
    starts, left, before = 0, failures, -1
    while True:
        starts += 1
        query = score_queue(spark, pairs, out, checkpoint, scorer, files)
        try:
            query.awaitTermination()
            return starts
        except StreamingQueryException:
            done = query.lastProgress.batchId if query.lastProgress else -1
            left = failures - 1 if done > before else left - 1
            before = max(before, done)
            if left <= 0:
                raise


def windowed_popularity(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, item, n): events per item and tumbling window; later events than ``late`` are dropped on a stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width).alias("w"), "item").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "item", "n")

"""Commit counts over a stream of commits. An addition of this engine: windows with a watermark over commit time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_commits(commits: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, end, author, commits per window of commit time; commits that are later than the watermark are left out."""
    seen = commits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = seen.groupBy(F.window("ts", window), "author").agg(F.count("*").alias("commits"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "author", "commits")

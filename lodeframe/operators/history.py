"""Snapshots of a repository's figures over time, kept as an append-only Parquet table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.functions.text import explode_lines
from lodeframe.operators.complexity import complexity_snapshot
from lodeframe.operators.dependencies import snapshot_counts
from lodeframe.operators.scans import sast_snapshot, snapshot_secrets

SCHEMA = (
    "timestamp string, repo_path string, commit_hash string, sast_high bigint, sast_medium bigint, sast_info bigint, sca_total_deps bigint, sca_unpinned bigint, "
    "sca_cve_count bigint, complexity_avg double, complexity_above_threshold bigint, license_copyleft bigint, license_permissive bigint, secrets_found bigint"
)


def snapshot(blobs: DataFrame, repo_path: str, commit_hash: str, timestamp: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """One row of SCHEMA. The advisory and licence counts are zero here; their own queries give the real figures."""
    lines = explode_lines(blobs)
    figures = sast_snapshot(lines, ignored).crossJoin(snapshot_secrets(lines, ignored)).crossJoin(snapshot_counts(blobs)).crossJoin(complexity_snapshot(blobs, ignored))
    zero = F.lit(0).cast("bigint")
    return figures.select(
        F.lit(timestamp).alias("timestamp"), F.lit(repo_path).alias("repo_path"), F.lit(commit_hash).alias("commit_hash"), "sast_high", "sast_medium", "sast_info",
        F.col("sca_total").cast("bigint").alias("sca_total_deps"), "sca_unpinned", zero.alias("sca_cve_count"), "complexity_avg", F.col("complexity_above").alias("complexity_above_threshold"),
        zero.alias("license_copyleft"), zero.alias("license_permissive"), "secrets_found",
    )


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, repo_path: str, n: int = 20) -> DataFrame:
    """The last n snapshots of a repository, oldest first."""
    rows = spark.read.schema(SCHEMA).parquet(path).filter(F.col("repo_path") == repo_path)
    return rows.orderBy(F.desc("timestamp")).limit(n).orderBy("timestamp")


def arrow(old: Column, new: Column) -> Column:
    return F.when(new < old, "↓").when(new > old, "↑").otherwise("→")


def trend_direction(snapshots: DataFrame, at: str, metrics: dict[str, Column]) -> DataFrame:
    """label, first, last, direction of each metric between the first and the last snapshot."""
    rows = F.array(*[F.struct(F.lit(k).alias("label"), F.min_by(v, at).cast("bigint").alias("first"), F.max_by(v, at).cast("bigint").alias("last")) for k, v in metrics.items()])
    out = snapshots.agg(F.count("*").alias("n"), rows.alias("rows")).filter("n > 1").select(F.inline("rows"))
    return out.withColumn("direction", arrow(F.col("first"), F.col("last")))


def deltas(snapshots: DataFrame, at: str, metric: str) -> DataFrame:
    """Each snapshot's change from the one before, over the few rows of a history."""
    return snapshots.select(at, metric, (F.col(metric) - F.lag(metric).over(Window.orderBy(at))).alias("change"))

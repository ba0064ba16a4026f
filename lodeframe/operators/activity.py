"""Commit activity. Inputs are commits (oid, message, author, ts, tz_offset_min, parent_count, ...) and file_changes (oid, pos,
path, insertions, deletions); "the last year" ends at an explicit instant. Ties are broken by name, so results are total."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions import rule_tables as fixed
from lodeframe.functions.text import java, shortened, trimmed

WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def last_year(as_of: str | datetime) -> Column:
    return F.col("ts") >= F.lit(str(as_of)).cast("timestamp_ntz") - F.expr("INTERVAL 365 DAYS")


def newest(commits: DataFrame, n: int) -> DataFrame:
    """The n newest commits: a sorted top-n, not a window over everything."""
    return commits.orderBy(F.desc("ts"), "oid").limit(n)


def newest_of_all(commits: DataFrame, as_of: str, among: int = 1000) -> DataFrame:
    """The newest commits, and the newest of the last year that aren't merges: all that the sections on the newest commits need."""
    all_ = newest(commits, among)
    authored = newest(commits.filter(last_year(as_of) & (F.col("parent_count") <= 1)), among)
    return all_.unionByName(authored.join(F.broadcast(all_.select("oid")), "oid", "left_anti"))


def changes_of(some: DataFrame, changes: DataFrame) -> DataFrame:
    """The changes of some few commits."""
    return changes.join(F.broadcast(some.select("oid")), "oid", "left_semi")


def top(df: DataFrame, by: str, name: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(by), name).limit(n)


def repo_overview(commits: DataFrame, refs: DataFrame) -> DataFrame:
    """Totals, refs, first and last commit and the whole days between them, in one row."""
    seen = commits.agg(F.count("*").alias("total_commits"), F.min("ts").alias("first_commit"), F.max("ts").alias("last_commit"))
    counts = refs.agg(F.count_if(F.col("kind") == "branch").alias("branches"), F.count_if(F.col("kind") == "tag").alias("tags"))
    days = F.timestamp_diff("DAY", F.col("first_commit"), F.col("last_commit")).cast("bigint")
    return seen.crossJoin(counts).withColumn("active_days", days)


def commit_velocity(commits: DataFrame, as_of: str) -> DataFrame:
    n = F.count("*")
    return commits.filter(last_year(as_of)).agg(n.alias("commits"), (n / F.lit(365.0)).alias("per_day"), (n / F.lit(365.0) * 7).alias("per_week"))


def top_contributors(commits: DataFrame, n: int = 20) -> DataFrame:
    """Authors by commits that aren't merges."""
    return top(commits.filter("parent_count <= 1").groupBy("author").agg(F.count("*").alias("commits")), "commits", "author", n)


def commits_by_month(commits: DataFrame, months: int = 24) -> DataFrame:
    """The last months that have commits, in UTC. Months without any are not filled in."""
    counted = commits.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("commits"))
    return counted.orderBy(F.desc("month")).limit(months).orderBy("month")


def commits_by_weekday(commits: DataFrame) -> DataFrame:
    """Seven rows, in UTC, zeros kept."""
    days = commits.sparkSession.createDataFrame(list(enumerate(WEEKDAYS)), "day_no int, day string")
    counted = commits.groupBy(F.weekday("ts").alias("day_no")).agg(F.count("*").alias("n"))
    return F.broadcast(days).join(counted, "day_no", "left").select("day_no", "day", F.coalesce("n", F.lit(0)).cast("bigint").alias("commits"))


def commits_by_hour(commits: DataFrame) -> DataFrame:
    """24 rows by the author's own clock, zeros kept."""
    hours = commits.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    local = F.hour(F.expr("ts + tz_offset_min * INTERVAL '1' MINUTE"))
    counted = commits.groupBy(local.alias("hour")).agg(F.count("*").alias("n"))
    return hours.join(counted, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("bigint").alias("commits"))


def emergency_commits(commits: DataFrame, as_of: str) -> DataFrame:
    found = commits.filter(last_year(as_of) & F.col("message").rlike(java(fixed.EMERGENCY_MESSAGE)))
    return found.select(F.substring("oid", 1, 7).alias("hash"), F.date_format("ts", "yyyy-MM-dd").alias("day"), shortened(trimmed(F.col("message")), 60).alias("message"))


def merges_by_month(commits: DataFrame, as_of: str) -> DataFrame:
    return commits.filter(last_year(as_of) & (F.col("parent_count") > 1)).groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("merges"))


def largest_files(blobs: DataFrame, n: int = 20) -> DataFrame:
    return top(blobs.select("path", F.col("size").cast("bigint").alias("size")), "size", "path", n)


def most_changed_files(commits: DataFrame, changes: DataFrame, as_of: str, n: int = 20) -> DataFrame:
    seen = changes.join(commits.filter(last_year(as_of)).select("oid"), "oid", "left_semi")
    return top(seen.groupBy("path").agg(F.count("*").alias("changes")), "changes", "path", n)


def bug_fix_files(commits: DataFrame, changes: DataFrame, n: int = 20) -> DataFrame:
    fixes = commits.filter(F.col("message").rlike(java(fixed.FIX_MESSAGE))).select("oid")
    return top(changes.join(fixes, "oid", "left_semi").groupBy("path").agg(F.count("*").alias("fixes")), "fixes", "path", n)


def code_churn(commits: DataFrame, changes: DataFrame, n: int = 20, among: int = 500) -> DataFrame:
    """Files by changes among the newest commits, which are few: a fixed number of ids is sent to the changes."""
    seen = changes.join(F.broadcast(newest(commits.select("oid", "ts"), among).select("oid")), "oid", "left_semi")
    return top(seen.groupBy("path").agg(F.count("*").alias("changes")), "changes", "path", n)


def lines_per_author(commits: DataFrame, changes: DataFrame, as_of: str, n: int = 20, among: int = 1000) -> DataFrame:
    """Lines added and removed by author in the newest commits of the last year that aren't merges."""
    some = newest(commits.filter(last_year(as_of) & (F.col("parent_count") <= 1)).select("oid", "ts", "author"), among)
    seen = changes.join(F.broadcast(some.select("oid", "author")), "oid")
    sums = seen.groupBy("author").agg(F.sum("insertions").alias("added"), F.sum("deletions").alias("removed"))
    return sums.orderBy(F.desc(F.col("added") + F.col("removed")), "author").limit(n)


def stale_files(commits: DataFrame, changes: DataFrame, n: int = 20, among: int = 1000) -> DataFrame:
    """Files of the newest commits whose last change is longest ago."""
    some = newest(commits.select("oid", "ts"), among)
    return changes.join(F.broadcast(some), "oid").groupBy("path").agg(F.max("ts").alias("last_change")).orderBy("last_change", "path").limit(n)


def commit_log(commits: DataFrame, n: int = 10) -> DataFrame:
    first_line = F.substring_index(trimmed(F.col("message")), "\n", 1)
    return newest(commits, n).select(F.substring("oid", 1, 7).alias("hash"), first_line.alias("message"), "author")

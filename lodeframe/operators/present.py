"""The numbers behind bars, sparklines and the overall status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Cells of the longest bar.
WIDTH = 40
LEVELS = "▁▂▃▄▅▆▇█"


def bar_widths(df: DataFrame, value: str, width: int = WIDTH) -> DataFrame:
    """Adds width: value's share of the largest value, of width cells at most. The largest is one row and is broadcast."""
    top = F.broadcast(df.agg(F.greatest(F.lit(1), F.max(value)).alias("_top")))
    return df.crossJoin(top).withColumn("width", F.floor(F.col(value) / F.col("_top") * width).cast("bigint")).drop("_top")


def sparkline_levels(df: DataFrame, value: str) -> DataFrame:
    """Adds level, from 0 to 7."""
    top = F.broadcast(df.agg(F.greatest(F.lit(1), F.max(value)).alias("_top")))
    return df.crossJoin(top).withColumn("level", F.least(F.lit(7), F.floor(F.col(value) / F.col("_top") * 7)).cast("bigint")).drop("_top")


def overall_status(sast_high: Column, secrets: Column, sast_medium: Column, unpinned: Column) -> Column:
    return F.when((sast_high > 0) | (secrets > 0), "CRITICAL").when((sast_medium > 0) | (unpinned > 5), "WARNING").otherwise("PASS")


def sparkline(values: list[float]) -> str:
    """A line of blocks for a few values, by the levels of sparkline_levels()."""
    top = max([1, *values])
    return "".join(LEVELS[min(7, int(v / top * 7))] for v in values)

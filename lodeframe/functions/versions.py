"""Version numbers as arrays that compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numbers(version: Column) -> Column:
    """The leading digits of each dotted part, after any leading v; parts without digits are left out."""
    parts = F.split(F.regexp_replace(version, "^v+", ""), r"\.")
    digits = F.filter(F.transform(parts, lambda p: F.regexp_extract(p, "^[0-9]+", 0)), lambda d: d != "")
    return F.transform(digits, lambda d: d.cast("decimal(20,0)"))


def version_less_than(current: Column, target: Column) -> Column:
    """Whether current comes before target, missing parts counting as zero."""
    a, b = numbers(current), numbers(target)
    size = F.greatest(F.size(a), F.size(b))

    def padded(x: Column) -> Column:
        return F.concat(x, F.array_repeat(F.lit(0).cast("decimal(20,0)"), size - F.size(x)))

    return padded(a) < padded(b)

"""Licence identifiers, texts and compliance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions import rule_tables as fixed
from lodeframe.functions.text import java, trimmed


def category(spdx: Column) -> Column:
    out = F.lit("unknown")
    for name, ids in fixed.LICENCE_CATEGORIES.items():
        out = F.when(F.upper(spdx).isin(*ids.split()), F.lit(name)).otherwise(out)
    return out


def normalized(raw: Column) -> Column:
    """The usual identifier for a spelling, or the spelling without quotes and white space around it."""
    bare = F.regexp_replace(trimmed(raw), '^"+|"+$', "")
    known = F.create_map(*[F.lit(x) for pair in fixed.LICENCE_SPELLINGS for x in pair])
    return F.coalesce(F.try_element_at(known, F.upper(bare)), bare)


def detected(content: Column) -> Column:
    """struct(licence, confidence) of a licence text."""
    text = F.lower(content)

    def answer(spdx, sure: str) -> Column:
        return F.struct((F.lit(spdx) if isinstance(spdx, str) else spdx).alias("licence"), F.lit(sure).alias("confidence"))

    out = answer("Unknown", "low")
    for words, spdx in reversed(fixed.LICENCE_HINTS):
        out = F.when(text.contains(words), answer(spdx, "medium")).otherwise(out)
    header = java(fixed.LICENCE_HEADER)
    out = F.when(content.rlike(header), answer(normalized(F.regexp_extract(content, header, 1)), "high")).otherwise(out)
    for spdx, required, barred in reversed(fixed.LICENCE_PHRASES):
        fits = F.lit(True)
        for p in required:
            fits = fits & text.contains(p)
        for p in barred:
            fits = fits & ~text.contains(p)
        out = F.when(fits, answer(spdx, "high")).otherwise(out)
    return out


def licence_detect(blobs: DataFrame) -> DataFrame:
    """path, licence, confidence and category by the content of every blob given."""
    found = blobs.select("path", detected(F.col("content")).alias("x"))
    return found.select("path", "x.licence", "x.confidence", category(F.col("x.licence")).alias("category"))


def licence_files(blobs: DataFrame) -> DataFrame:
    """licence_detect over files that are named like licences, in any folder."""
    name = F.upper(F.element_at(F.split("path", "/"), -1))
    return licence_detect(blobs.filter(name.startswith("LICENSE") | name.startswith("LICENCE") | (name == "COPYING")))


def compliance(manifests: DataFrame) -> DataFrame:
    """path, licence, category, copyleft (its copyleft parts, in order), permissive (all parts are) and missing, by manifest
    (path, licence, n_deps). A go.mod can't declare a licence, so none is missing there."""
    parts = lambda by: F.transform(F.split("licence", by), normalized)
    weak = F.filter(parts(" OR |/| AND "), lambda x: category(x).startswith("copyleft"))
    free = F.forall(parts(" OR |/"), lambda x: category(x) == "permissive")
    declares = F.col("path").endswith("Cargo.toml") | F.col("path").endswith("package.json")
    return manifests.select(
        "path", "licence", F.when(F.col("licence").isNotNull(), category(F.col("licence"))).alias("category"),
        F.coalesce(F.array_join(weak, ", "), F.lit("")).alias("copyleft"), F.coalesce(free, F.lit(False)).alias("permissive"), (F.col("licence").isNull() & declares).alias("missing"), "n_deps",
    )


def compliance_summary(manifests: DataFrame) -> DataFrame:
    rows = compliance(manifests)
    return rows.agg(
        F.count("*").alias("manifests"), F.sum(F.col("n_deps").cast("bigint")).alias("dependencies"), F.count_if(F.col("copyleft") != "").alias("with_copyleft"),
        F.coalesce(F.bool_or("permissive"), F.lit(False)).alias("project_permissive"), F.count_if("missing").alias("missing"),
    )

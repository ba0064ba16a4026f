"""A training-data pipeline: STAGES applied to `documents`, each on all that the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm import decontaminate, ngram_join, pack, pii, quality
from lodeframe.llm.base import Kept, Scope, checked_broadcast, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (learnt from `labels`) accepts."""
    rows = docs.select(*COLUMNS)
    model = quality.learn(rows, table(spark, sf_dir, "labels"))
    return quality.score(rows, model).filter("predicted = 1").select(*COLUMNS)


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: of the smallest id (a null one only if there is no other), and of its
    texts the one with the smallest hash. Each row is judged by its own text, whatever other rows have its id; rows without
    words are like no other and stay."""
    rows = docs.select(*COLUMNS)
    again = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if again.isEmpty():
        nodes = rows.withColumn("node", F.col("doc_id").cast("bigint"))
        found = Kept(ngram_join.jaccard_components(nodes, "node"), "components").df
        gone = found.filter("component_id <> node").select("node")
    else:  # ids don't tell rows apart, so rows are numbered, and written so that the numbers stay
        nodes = Kept(rows.withColumn("node", F.monotonically_increasing_id()), "nodes").df
        found = Kept(ngram_join.jaccard_components(nodes, "node"), "components").df
        ranked = nodes.select("node", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text"), "node").alias("rank"))
        members = found.filter("n_shingles > 0").join(ranked, "node")
        first = members.groupBy("component_id").agg(F.min("rank").alias("first"))
        gone = members.join(first, "component_id").filter("node <> first.node").select("node")
    return nodes.join(checked_broadcast(Kept(gone, "gone").df), "node", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a `benchmark` item."""
    found = Kept(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id", "text_key").distinct(), "contaminated")
    hit = checked_broadcast(found.df.withColumnRenamed("doc_id", "hit_id"))
    rows = docs.select(*COLUMNS)
    return rows.join(hit, F.expr("doc_id <=> hit_id") & (decontaminate.text_key(F.col("text")) == F.col("text_key")), "left_anti")


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by marks; n_chars counts the new text."""
    rows = docs.select(*COLUMNS)
    return pii.redact(rows, pii.learn(rows)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 token ids."""
    import public_tokenizers

    return pack.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


#: (name, function of (spark, docs, sf_dir)). All but the last return the columns of documents.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_alike),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal),
    ("packing", pack_sequences),
]

#: No SQL expresses the classifier or the packing; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each keeps is written and read again as the next one's input. Nothing but the last
    stage's input is left when it returns."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with Scope(spark) as scope:
            written = scope.spare(Kept(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before:
            before.drop()
        docs, before = written.df, written
    return STAGES[-1][1](spark, docs, sf_dir)

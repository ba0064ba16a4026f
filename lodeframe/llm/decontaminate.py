"""Benchmark decontamination by winnowing, in DataFrame functions only (operator 3).

Documents and benchmark items keep the smallest hash of every WINNOW consecutive word k-grams as fingerprints, so that any
shared span of WINDOW = k + WINNOW - 1 words has a shared fingerprint. Documents that share none are done. In the others,
every window of WINDOW words is compared with the items' windows by hash and fingerprint together, and the windows that
occur are merged into spans. An item shorter than a window is one window of its own length, looked for at every position.

Word arrays are hashed once; hashes of longer runs come from combining those of shorter ones that lie side by side.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.base import Kept, checked_broadcast, table

GRAM, WINNOW = 5, 6
WINDOW = GRAM + WINNOW - 1
#: What stands between words: every ASCII character but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case. Only ASCII letters fold, so lower() will do just where all is ASCII."""
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(folded, BETWEEN), "")


def after(values: str, k: int) -> Column:
    """The array from its k-th element on."""
    return F.slice(values, F.lit(k + 1), F.size(values))


def text_key(text: Column) -> Column:
    """A hash by which a row's text is told from others of its id; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def run_hashes(df: DataFrame, lengths: set[int]) -> DataFrame:
    """Adds h1 (word hashes) and a column h<L> for each length: hashes of the L words from each position; its last L - 1
    elements are of no meaning. Each step is a projection of its own, so that no array is computed twice."""
    have = {1}
    df = df.withColumn("h1", F.transform("w", lambda x: F.xxhash64(x)))

    def add(df: DataFrame, left: int, right: int) -> DataFrame:
        have.add(left + right)
        return df.withColumn(f"h{left + right}", F.zip_with(f"h{left}", after(f"h{right}", left), lambda a, b: F.xxhash64(a, b)))

    for length in sorted(lengths):
        total = 1 << (length.bit_length() - 1)
        for p in (1 << i for i in range(1, length.bit_length())):
            if p not in have:
                df = add(df, p // 2, p // 2)
        for p in (1 << i for i in reversed(range(length.bit_length() - 1))):
            if length & p:
                if total + p not in have:
                    df = add(df, total, p)
                total += p
    return df


def winnowed(df: DataFrame) -> DataFrame:
    """Adds low: for each window of WINDOW words, the smallest hash of its k-grams. Needs h5 of run_hashes."""
    least = lambda a, b: F.least(a, b)
    df = df.withColumn("m2", F.zip_with("h5", after("h5", 1), least))
    df = df.withColumn("m4", F.zip_with("m2", after("m2", 2), least))
    return df.withColumn("low", trim(F.zip_with("m4", after("m4", 2), least), WINDOW))


def trim(values: Column, length: int) -> Column:
    """Only the positions from which length words follow."""
    return F.slice(values, F.lit(1), F.greatest(F.size("w") - (length - 1), F.lit(0)))


def windows_of(items: DataFrame, short: list[int]) -> DataFrame:
    """(len, low, hash, items): the distinct windows of the items, with the items that have them."""
    made = winnowed(run_hashes(items.filter(F.size("w") > 0), {GRAM, WINDOW, *short}))
    long = made.filter(F.size("w") >= WINDOW).select("item", F.lit(WINDOW).alias("len"), F.explode(F.arrays_zip("low", trim(F.col(f"h{WINDOW}"), WINDOW).alias("hash"))).alias("x"))
    parts = [long.select("item", "len", "x.low", "x.hash")]
    for n in short:
        parts.append(made.filter(F.size("w") == n).select("item", F.lit(n).alias("len"), F.col(f"h{n}")[0].alias("low"), F.col(f"h{n}")[0].alias("hash")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("len", "low", "hash").agg(F.collect_set("item").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated, text_key of every row of docs.

    A document word is hit if it lies in an occurrence of any item window. Null, empty and wordless texts have no words and
    are clean; items without words have no windows; null item ids are left out of the ids but their windows hit. Null and
    repeated document ids are judged row by row. Without items all is clean. Other columns are ignored.
    """
    items = Kept(benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.coalesce(F.col(item_text).cast("string"), F.lit(""))).alias("w")), "items")
    short = sorted(r["n"] for r in items.df.select(F.size("w").alias("n")).filter(f"n between 1 and {WINDOW - 1}").distinct().collect())
    windows = Kept(windows_of(items.df, short), "windows")
    prints = windows.df.select(F.col("low").alias("print")).distinct().withColumn("hit", F.lit(True))
    n_windows = windows.df.count()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", text_key(F.col("text")).alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    # One pass over all texts: each row's own mark (print null) and those of its fingerprints that items have.
    made = winnowed(run_hashes(keyed.select("id", "k1", "k2", words(F.col("text")).alias("w")), {GRAM, *short}))
    found = F.concat(F.array(F.lit(None).cast("bigint")), F.array_distinct("low"), *[trim(F.col(f"h{n}"), n) for n in short])
    each = made.select("id", "k1", "k2", F.size("w").cast("bigint").alias("n_words"), F.explode(found).alias("print"))
    marked = each.join(checked_broadcast(prints, n_windows), "print", "left").filter("print is null or hit")
    base = Kept(marked.select("id", "k1", "k2", "n_words", F.col("print").isNotNull().alias("hit")), "marked")

    keys = base.df.filter("hit").select("k1", "k2").distinct()
    near = keyed.join(checked_broadcast(keys, keys.count()), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    full = winnowed(run_hashes(near.select("k1", "k2", words(F.col("text")).alias("w")), {GRAM, WINDOW, *short}))
    at = full.select("k1", "k2", F.lit(WINDOW).alias("len"), F.posexplode(F.arrays_zip("low", trim(F.col(f"h{WINDOW}"), WINDOW).alias("hash"))).alias("pos", "x"))
    at = at.select("k1", "k2", "len", "pos", "x.low", "x.hash")
    for n in short:
        one = full.select("k1", "k2", F.lit(n).alias("len"), F.posexplode(trim(F.col(f"h{n}"), n)).alias("pos", "hash"))
        at = at.unionByName(one.withColumn("low", F.col("hash")))
    hits = at.join(checked_broadcast(windows.df, n_windows), ["len", "low", "hash"])
    spans = hits.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("pos", "len"))).alias("at"), F.collect_set("items").alias("items"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate(
        "at",
        start,
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["pos"] + x["len"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["pos"] + x["len"] - F.greatest(acc["end"], x["pos"]))).alias("n")
        ),
        lambda acc: acc["n"],
    )
    # Written, so that the join below deals both sides anew and a text of very many copies can be split.
    result = Kept(spans.select("k1", "k2", covered.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items")), "hits")

    out = base.df.filter("not hit").join(result.df, ["k1", "k2"], "left")
    ids = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.col("k1").alias("text_key"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")

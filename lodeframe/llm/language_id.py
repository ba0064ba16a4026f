"""Language identification by compression (operator 5).

Every language has a raw-content zstandard dictionary: its most frequent words, with single spaces between them, the most
frequent last. Words are counted over the whole texts of a sample of labelled rows. A text is compressed block by block
with each language's dictionary, and the language whose dictionary makes it smallest is chosen. Where the two best are too
close, the decision is marked as not confident.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.llm.base import crc_fold, small_batches, table, texts_of

#: Labelled rows sampled per language, and languages (those with most rows): the bounds of what is learnt from.
SAMPLE_ROWS, LANGUAGES = 2_000, 200
#: Size of a dictionary.
DICTIONARY_BYTES = 96 << 10
BLOCK_BYTES = 2048
#: Short matches matter most: syllables and word endings, not phrases, tell languages apart.
SEARCH = zstandard.ZstdCompressionParameters.from_level(
    3, strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=4, hash_log=16, chain_log=16, window_log=18, write_checksum=False, write_content_size=False, write_dict_id=False
)
#: Margin of the second best over the best, as a share of the best, below which a decision isn't confident.
NARROW = 0.01
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


def plain(text: str) -> bytes:
    """Letters only, lower case, single spaces."""
    return NOT_LETTERS.sub(" ", text.lower()).encode("utf-8")


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """Dictionary content per language, from the whole of at most rows texts of each, chosen by the hashes of id and text.

    Rows whose fold is 1 and null languages and texts teach nothing. A language whose texts have no letter has an empty
    dictionary. What comes to the driver is at most LANGUAGES dictionaries.
    """
    small_batches(docs.sparkSession)
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    train = train.filter((crc_fold(F.col("id")) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = [(r["lang"], r["n"]) for r in train.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()]
    if not counts:
        return {}
    known = F.broadcast(docs.sparkSession.createDataFrame(counts, "lang string, n bigint"))
    # Twice as many as needed pass the hash of the id; of these the first by hash are taken.
    scale = 1 << 30
    likely = train.join(known, "lang").filter(F.pmod(F.xxhash64("id"), F.lit(scale)) < F.ceil(F.lit(2.0 * rows * scale) / F.col("n")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), F.xxhash64("text"))
    sample = likely.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(plain(text).split())
        for lang, words in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    words = sample.select("lang", "text").mapInArrow(count, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    room = F.sum(F.octet_length("word") + 1).over(by_count.rowsBetween(Window.unboundedPreceding, 0))
    kept = words.withColumn("upto", room).filter(F.col("upto") <= DICTIONARY_BYTES).collect()
    learnt: dict[str, list] = {lang: [] for lang, _ in counts}
    for r in sorted(kept, key=lambda r: (r["n"], -r["upto"])):
        learnt[r["lang"]].append(bytes(r["word"]))
    return {lang: b" ".join(words) for lang, words in learnt.items()}


@cache
def compressors(learnt: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    made = []
    for lang, content in learnt:
        words = zstandard.ZstdCompressionDict(content.ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=SEARCH)
        made.append((lang, zstandard.ZstdCompressor(dict_data=words, compression_params=SEARCH)))
    return made


def judge(text: str, by: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float, bool]:
    """Language, score and whether the margin is wide enough."""
    data = plain(text)
    blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
    sizes = [(sum(len(c.compress(b)) for b in blocks), lang) for lang, c in by]
    best, lang = min(sizes)
    rest = [s for s in sizes if s[1] != lang]
    margin = (min(rest)[0] - best) / best if rest else 1.0
    score = 1 / sum(math.exp(-min(60.0, 100 * (s - best) / best)) for s, _ in sizes)
    return lang, score, margin >= NARROW


def identify(docs: DataFrame, learnt: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score, confident of every row; only the text is looked at.

    Null text and text without a letter: `und`, score 0, not confident; so is everything if nothing was learnt. Null and
    repeated ids are judged row by row. Other columns are ignored. One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    frozen = tuple(sorted(learnt.items()))
    rows = docs.select(F.col(id_col).alias("id"), (crc_fold(F.col(id_col)) == 1).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = compressors(frozen)
        for batch in batches:
            out = [judge(t, by) if by and LETTER.search(t) else ("und", 0.0, False) for t in texts_of(batch, "text").to_pylist()]
            lang, score, sure = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())], ["id", "held_out", "lang_pred", "score", "confident"]
            )

    out = rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double, confident boolean")
    return out.withColumnRenamed("id", id_col)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs, "doc_id", "text", "lang"))

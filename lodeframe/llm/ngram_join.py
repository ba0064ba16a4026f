"""Jaccard self-join of documents on word n-grams by multiple global orders (operator 2).

A document's n-grams are put into several global orders of all n-grams. Two sets that are similar enough share an element
among the first few of each set (its prefix) under every order. The first order puts n-grams of rare frequency classes
first; documents that share one of its prefix n-grams are candidates. The prefixes under the further orders lie beside
them, and only pairs that share an n-gram under each of these as well are candidates still: the filters are intersected
before any text moves. For what is left the texts are fetched and the exact overlap is computed.

The frequency classes come from a count sketch of fixed size over all n-grams of all documents. Any order is correct; the
sketch only keeps n-grams of passages that many documents share out of the prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.base import Kept, bytes_of, checked_broadcast, offsets_of, passes, serve, small_batches, table, texts_of
from lodeframe.llm.components import linked
from lodeframe.llm.shingles import U, Words, mix, seeds, set_keys, shingles

WORDS = 5
#: Similarity as a fraction, so that the test is exact: 100 * overlap >= 80 * union.
SIMILAR = (80, 100)
#: Counters of the sketch: a fixed size, whatever the corpus.
COUNTERS = 1 << 20
BLOCKS = 16
#: Orders beside the first that candidates have to pass.
FURTHER_ORDERS = 2
#: Shingles of the texts that are compared with one copy of another text.
TOGETHER = 1 << 16


def prefix_size(n, similar: tuple[int, int] = SIMILAR):
    """Elements of a set of n, under any order, of which a similar set must hold at least one."""
    num, den = similar
    return n - (num * n + den - 1) // den + 1


def sets_of(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a text column with their shingle sets (flat, first)."""
    for a, b in passes(column):
        part = column.slice(a, b - a)
        yield a, b, *shingles(Words(bytes_of(part), offsets_of(part)), k)


def signatures(docs: DataFrame, k: int) -> Kept:
    """One pass: (id, h1, h2, n) of every row (block null), and compressed sketch parts (id null, block set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("ngram_join")
        counts = np.zeros(COUNTERS, np.int64)
        names = ["id", "h1", "h2", "n", "block", "part"]
        for batch in batches:
            column = texts_of(batch, "text")
            n, h1, h2 = [], [], []
            for _, _, flat, first in sets_of(column, k):
                counts += np.bincount((flat >> U(44)).astype(np.int64), minlength=COUNTERS)
                x, y = set_keys(flat, first)
                n.append(np.diff(first)), h1.append(x), h2.append(y)
            join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(join(c), pa.int64()) for c in (h1, h2, n)), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names)
        if counts.any():
            pack = zstandard.ZstdCompressor(level=3)
            parts = [pack.compress(c.astype(np.uint32).tobytes()) for c in np.split(counts, BLOCKS)]
            empty = pa.nulls(BLOCKS, pa.int64())
            yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], names)

    return Kept(docs.mapInArrow(run, "id bigint, h1 bigint, h2 bigint, n bigint, block int, part binary"), "signatures")


def sketch_of(parts: DataFrame) -> np.ndarray:
    """The summed counters. Parts are added up on the executors, block by block; the driver gets BLOCKS arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("ngram_join")
        unpack, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(unpack.decompress(part), np.uint32)
                sums[block] = sums[block] + more if block in sums else more.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "sums"])

    counts = np.zeros((BLOCKS, COUNTERS // BLOCKS), np.int64)
    for r in parts.select("block", "part").repartition(BLOCKS, "block").mapInArrow(run, "block int, sums binary").collect():
        counts[r["block"]] += np.frombuffer(r["sums"], np.int64)
    return counts.ravel()


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """Class of each counter: 0 is ordinary, and two more for every doubling over the mean."""
    mean = max(1.0, float(counts.mean()))
    return np.clip(2 * np.log2(np.maximum(counts, 1) / mean), 0, 63).astype(np.uint8)


def prefixes(docs: DataFrame, k: int, counts: np.ndarray, similar: tuple[int, int]) -> DataFrame:
    """(id, h1, h2, n, e, buckets, further): the prefix n-grams under the first order, for every row with any; e is the place
    in the order of the prefix's last element (its upper 31 bits). further: the prefix under each further order, in 32 bits
    (n-grams that then look equal let a pair pass, which is no harm)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(frequency_classes(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("ngram_join")
        classes = sent.value
        by, further = seeds(31, 1)[0], seeds(37, FURTHER_ORDERS)
        for batch in batches:
            column = texts_of(batch, "text")
            for a, _, flat, first in sets_of(column, k):
                order = (classes[(flat >> U(44)).astype(np.int64)].astype(U) << U(58)) | (mix(flat * by) >> U(6))
                others = [mix(flat * o) for o in further]
                size = np.diff(first)
                rows = np.flatnonzero(size)
                picked, last, marks = [], [], []
                for i, j in zip(first[:-1][rows].tolist(), first[1:][rows].tolist(), strict=True):
                    p = prefix_size(j - i, similar)
                    best = np.argpartition(order[i:j], p - 1)[:p] + i
                    picked.append(best)
                    last.append(int(order[best[-1]] >> U(33)))
                    marks += [np.partition(o[i:j], p - 1)[:p] for o in others]
                ends = np.r_[0, np.cumsum([len(x) for x in picked], dtype=np.int64)]
                at = np.concatenate(picked) if picked else np.zeros(0, np.int64)
                buckets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[at].view(np.int64), pa.int64()))
                inner = np.r_[0, np.cumsum([len(x) for x in marks], dtype=np.int64)]
                values = ((np.concatenate(marks) if marks else np.zeros(0, U)) >> U(32)).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(values, pa.int32()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * FURTHER_ORDERS, pa.int32()), lists)
                h1, h2 = set_keys(flat, first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows + a)), *(pa.array(c[rows].astype(np.int64)) for c in (h1, h2, size)), pa.array(last, pa.int32()), buckets, lists],
                    ["id", "h1", "h2", "n", "e", "buckets", "further"],
                )

    return docs.mapInArrow(run, "id bigint, h1 bigint, h2 bigint, n bigint, e int, buckets array<bigint>, further array<array<int>>")


def sharing_further(marks: DataFrame):
    """A function from pairs (a, b) to those that share a prefix element under each further order; marks: (id, further)."""

    def admit(pairs: DataFrame) -> DataFrame:
        both = pairs.join(marks.select(F.col("id").alias("a"), F.col("further").alias("x")), "a").join(marks.select(F.col("id").alias("b"), F.col("further").alias("y")), "b")
        share = F.lit(True)
        for i in range(FURTHER_ORDERS):
            share = share & F.arrays_overlap(F.col("x")[i], F.col("y")[i])
        return both.filter(share).select("a", "b")

    return admit


def can_link(similar: tuple[int, int]):
    """Whether two sets can be similar, by sizes n, prefix ends e, and at most c shared prefix elements.

    Of the set whose prefix ends first, every shared element up to that end is in both prefixes, so the overlap is at most c
    plus what that set has after its prefix.
    """
    num, den = similar

    def possible(x, y, c):
        # In whole numbers, as sizes are; integer division would need a cast per row.
        after = lambda n: F.ceil(n * num / den) - 1
        need = F.ceil((x("n") + y("n")) * num / (num + den))
        room = F.when(x("e") < y("e"), after(x("n"))).when(y("e") < x("e"), after(y("n"))).otherwise(F.greatest(after(x("n")), after(y("n"))))
        return (F.least(x("n"), y("n")) * den >= F.greatest(x("n"), y("n")) * num) & (c + room >= need)

    return possible


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def verifier(docs: DataFrame, sizes: DataFrame, k: int, similar: tuple[int, int], only_needed: bool = False):
    """A function from candidate pairs (a, b) of ids to those that are similar, computed from the whole texts. sizes: (id, n)
    of every id. only_needed: docs holds hardly any other ids than the pairs'.

    A text a goes with the texts b that are compared with it, one copy for about TOGETHER shingles of these, and is followed
    by them, so that neither a hub's copies nor a group's texts pile up.
    """
    num, den = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("ngram_join")
        mine = np.zeros(0, U)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            head = np.asarray(batch.column(1).is_null())
            for a, b, flat, first in sets_of(texts_of(batch, "text"), k):
                for row in range(a, b):
                    other = flat[first[row - a] : first[row - a + 1]]
                    if head[row]:
                        mine = other.copy()
                    elif len(mine) and len(other):
                        both = len(np.intersect1d(mine, other, assume_unique=True))
                        keep[row] = den * both >= num * (len(mine) + len(other) - both)
            chosen = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen)], ["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        texts = docs
        if not only_needed:
            ids = ends_of(pairs)
            if ids.isEmpty():
                return pairs
            texts = docs.join(checked_broadcast(ids), "id", "left_semi")
        sized = pairs.join(sizes.select(F.col("id").alias("b"), "n"), "b")
        blocks = sized.groupBy("a").agg(F.ceil(F.sum("n") / TOGETHER).cast("int").alias("blocks"))
        each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        heads = blocks.join(texts.select(F.col("id").alias("a"), "text"), "a").select("a", F.lit(None).cast("bigint").alias("b"), "text", each)
        rest = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block"))
        rest = rest.join(texts.select(F.col("id").alias("b"), "text"), "b").select("a", "b", "text", "block")
        dealt = heads.unionByName(rest).repartition("a", "block").sortWithinPartitions("a", "block", "b")
        return dealt.select("a", "b", "text").mapInArrow(run, "a bigint, b bigint")

    return verify


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """id, n_shingles, component_id of every row.

    Rows with the same set of shingles are linked; sets are linked if 100 * overlap >= 80 * union, exactly. component_id is
    the smallest id that links reach. Null, empty or blank texts have no shingles and are linked with nothing. Rows may
    repeat an id: each is judged by its own text, and ids count as one node. A null id is no node: such a row gets its
    group's component, or null if it's alone. Other columns are ignored. Ids must be integers.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    kept = signatures(rows, k)
    counts = sketch_of(kept.df.filter("block is not null"))
    marks = kept.df.filter("block is null").select("id", "h1", "h2", "n")
    groups = marks.filter("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"))

    one = prefixes(rows, k, counts, similar).filter("id is not null").groupBy("h1", "h2")
    first = Kept(one.agg(F.min("id").alias("id"), F.first("n").cast("int").alias("n"), F.first("e").alias("e"), F.first("buckets").alias("buckets"), F.first("further").alias("further")), "prefixes")
    each = first.df.select(F.explode("buckets").alias("bucket"), "id", "n", "e")
    label = linked(each, can_link(similar), verifier(rows, first.df.select("id", "n"), k, similar), sharing_further(first.df.select("id", "further")))
    first.drop()

    # Written, so that the join below deals both sides anew and a group of very many copies can be split.
    named = Kept(groups.join(label.df.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id")), "named")
    label.drop()
    out = marks.join(named.df, ["h1", "h2"], "left")
    alone = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), alone.alias("component_id"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))

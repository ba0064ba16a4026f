"""Sequence packing along a space-filling curve (operator 7).

A document's tokens are hashed into a vector, projected to three dimensions and placed on a Hilbert curve. Documents are
range-partitioned and sorted by their place on the curve and packed in that order, so that neighbours share sequences.
Runs of a full sequence are cut off a long document beforehand and are sequences of their own; only what is left over
travels. The last, unfilled sequence of a partition is cut into power-of-two sequences, so that nothing is padded.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, compress, pairwise, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.base import give_back, serve, small_batches, table, texts_of
from lodeframe.llm.shingles import mix, ragged
from lodeframe.llm.token_count import merger

LENGTH = 2048
#: Id that ends every document.
END = 1
#: Rows for each partition that are tokenized beforehand to place the partitions' bounds. They balance partitions; no row
#: depends on them.
BOUND_ROWS = 128
#: Words whose ids a worker remembers: only a memo.
MEMO = 1_000_000
#: Slots, by hash, that say which words a worker has met. A word is remembered from the second batch that has it on, so that
#: words that never come again take no memory.
MET = 1 << 22
DIMENSIONS, BITS, BINS = 3, 10, 1024
#: Texts of these characters only (no controls, no marks, nothing that normalization would change) are folded, split at
#: white space and merged word by word here; all other texts go to the library whole.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]")
#: The pre-token pattern of this vocabulary (a fixed value).
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class Ids:
    """Token ids of texts by a lower-casing vocabulary file with word ends, with words remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merger = merger(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.met = np.zeros(MET, bool)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 16, np.int64)

    def learn(self, words: list[str]) -> dict[str, int]:
        """Where the ids of these words (distinct, not known) are, until words are learnt again; those met before are known
        from now on."""
        if not words:
            return {}
        slot = np.fromiter(map(hash, words), np.int64, len(words)) & (MET - 1)
        met = self.met[slot]
        self.met[slot] = True
        words = [*compress(words, met.tolist()), *compress(words, (~met).tolist())]
        pieces = [[w] if w.isalpha() else PIECE.findall(w) for w in words]
        ids, sizes = self.merger.merge(list(chain.from_iterable(pieces)))
        n, at = len(self.known), int(self.first[len(self.known)])
        ends = np.cumsum(sizes)[np.cumsum([len(p) for p in pieces]) - 1]
        while at + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while n + len(words) >= len(self.first):
            self.first = np.r_[self.first, np.zeros_like(self.first)]
        self.flat[at : at + len(ids)] = ids
        self.first[n + 1 : n + 1 + len(words)] = at + ends
        found = dict(zip(words, range(n, n + len(words)), strict=True))
        lasting = int(np.count_nonzero(met))
        self.known.update(zip(words[:lasting], range(n, n + lasting), strict=True))
        return found

    def of(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.lower().split() if not UNUSUAL.search(t) and not any(s in t for s in self.merger.specials) else None for t in texts]
        usual = [words for words in split if words is not None]
        sizes = np.array([len(words) for words in usual], np.int64)
        flat_words = list(chain.from_iterable(usual))
        known = self.known
        w = np.fromiter(map(known.get, flat_words, repeat(-1)), np.int64, len(flat_words))
        missing = np.flatnonzero(w < 0)
        if len(missing):
            absent = [flat_words[i] for i in missing.tolist()]
            fresh = set(absent)
            if len(known) + len(fresh) > MEMO:  # it's emptied: the other words of these texts are needed as well
                self.forget()
                missing, absent, fresh = np.arange(len(w)), flat_words, set(flat_words)
            found = self.learn(list(fresh))
            w[missing] = np.fromiter(map(found.__getitem__, absent), np.int64, len(absent))
        start = self.first[w]
        length = self.first[w + 1] - start
        flat = self.flat[ragged(start, length)]
        ends = np.r_[0, np.cumsum(length)][np.r_[0, np.cumsum(sizes)]].tolist()
        found = iter(flat[a:b] for a, b in pairwise(ends))
        return [next(found) if words is not None else np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32) for text, words in zip(texts, split, strict=True)]


@cache
def tokenizer(path: str) -> Ids:
    ids = Ids(path)
    give_back()  # what reading the file took
    return ids


def forget() -> None:
    """Empties what a worker keeps from task to task."""
    tokenizer.cache_clear()
    merger.cache_clear()


@cache
def projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BINS, DIMENSIONS))


def place(ids: np.ndarray) -> np.ndarray:
    """Grid cell of a document: damped counts of hashed ids, normalized and projected."""
    counts = np.log1p(np.bincount((mix(ids.astype(np.uint64)) % np.uint64(BINS)).astype(np.int64), minlength=BINS))
    x = (counts / max(np.linalg.norm(counts), 1e-9)) @ projection()
    return np.clip((1 / (1 + np.exp(-1.7 * x)) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def hilbert(cells: np.ndarray) -> np.ndarray:
    """Distance along the Hilbert curve of grid cells (n, DIMENSIONS), by Skilling's transform."""
    x = cells.T.copy()
    q = 1 << (BITS - 1)
    while q > 1:
        p = q - 1
        for i in range(DIMENSIONS):
            high = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, DIMENSIONS):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (BITS - 1)
    while q > 1:
        t = np.where((x[-1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(BITS - 1, -1, -1):
        for i in range(DIMENSIONS):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


NAMES = ["id", "start", "length", "crc", "doc_tokens", "part", "place", "ids"]
KINDS = "id {id}, start bigint, length bigint, crc bigint, doc_tokens bigint, part int, place bigint, ids binary"


def tokenized(docs: DataFrame, path: str, bounds: list[int] | None) -> DataFrame:
    """Per document its full runs (ids null) and what is left over (with ids), each with the partition it belongs to.

    docs: (id, text, tie). place orders by curve, then by tie, so that many equal documents still spread.
    """
    kind = docs.schema["id"].dataType.simpleString()
    cuts = np.array(bounds or [], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("pack", forget)
        for batch in batches:
            found = [np.append(x, np.uint32(END)) for x in tokenizer(path).of(texts_of(batch, "text").to_pylist())]
            if not found:
                continue
            keys = (hilbert(np.array([place(x) for x in found])) << 32) | (batch.column(2).to_numpy() & 0xFFFFFFFF)
            rows: list[tuple] = []
            owner = []
            for i, x in enumerate(found):
                full = len(x) // LENGTH * LENGTH
                key = int(keys[i])
                part = int(np.searchsorted(cuts, key, side="right"))
                for a in range(0, full, LENGTH):
                    rows.append((a, LENGTH, crc(x[a : a + LENGTH]), len(x), part, key, None))
                if full < len(x):
                    rows.append((full, len(x) - full, None, len(x), part, key, x[full:].astype("<u4" if x.max() > 0xFFFF else "<u2").tobytes()))
                owner += [i] * (len(rows) - len(owner))
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], NAMES)

    return docs.mapInArrow(run, KINDS.format(id=kind))


class Packer:
    """Fills one sequence after the other; rows are (id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, part: int):
        self.next, self.rows, self.open, self.filled = part << 32, [], [], 0

    def emit(self, pieces: list[tuple], size: int | None = None) -> None:
        """Close a sequence of these pieces (id, start, ids, doc_tokens)."""
        at = 0
        for i, start, ids, total in pieces:
            self.rows.append((i, start, len(ids), crc(ids), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, i, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids):
            take = min(len(ids), LENGTH - self.filled)
            self.open.append((i, start, ids[:take], total))
            self.filled += take
            start, ids = start + take, ids[take:]
            if self.filled == LENGTH:
                self.emit(self.open)
                self.open, self.filled = [], 0

    def whole(self, i, start: int, length: int, check: int, total: int) -> None:
        self.rows.append((i, start, length, check, total, self.next, 0))
        self.next += 1

    def close(self) -> None:
        """The open sequence, in pieces of powers of two."""
        left, self.open, filled = self.open, [], self.filled
        self.filled = 0
        for bit in reversed(range(filled.bit_length())):
            if not filled >> bit & 1:
                continue
            room, taken = 1 << bit, []
            while room:
                i, start, ids, total = left[0]
                n = min(room, len(ids))
                taken.append((i, start, ids[:n], total))
                left[0:1] = [(i, start + n, ids[n:], total)] if n < len(ids) else []
                room -= n
            self.emit(taken)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of sequences of at most 2048 ids.

    Every row is a document of its ids by the vocabulary file at path plus an end id; null text is empty and has that id
    only. Null and repeated ids are packed row by row. Sequences hold 2048 ids or a power of two, so none is padded. The
    file must lie at path on every executor. Other columns are ignored. An empty table gives no pieces.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tie = F.xxhash64(F.col(id_col), F.monotonically_increasing_id())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), tie.alias("tie"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, BOUND_ROWS * parts / max(1, docs.count()))
    sampled = tokenized(rows.filter(F.pmod(F.xxhash64("tie"), F.lit(1 << 30)) <= int(share * (1 << 30))), path, None)
    at = [i / parts for i in range(1, parts)]
    # Quantiles are summed up on the executors; the driver gets a number for each partition.
    bounds = sampled.filter("ids is not null").agg(F.percentile_approx("place", at, 32 * parts).alias("b")).first()["b"] if at else None
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("pack", forget)
        packer = Packer(TaskContext.get().partitionId())
        kinds = [pa.int64()] * 6
        id_kind = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_kind), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            )

        for batch in batches:
            id_kind = batch.column(0).type
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 7)]
            for i, start, length, check, total, ids in zip(*columns, strict=True):
                if ids is None:
                    packer.whole(i, start, length, check, total)
                else:
                    packer.add(i, start, np.frombuffer(ids, "<u4" if len(ids) == 4 * length else "<u2"), total)
            if packer.rows:
                yield out(packer.take())
        packer.close()
        if packer.rows:
            yield out(packer.take())

    dealt = tokenized(rows, path, bounds).repartitionById(parts, F.col("part")).sortWithinPartitions("place", "start")
    done = dealt.mapInArrow(run, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return done.withColumnRenamed("id", id_col)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

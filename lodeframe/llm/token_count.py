"""Token counts by rank-synchronous array merging (operator 4).

Pre-tokens of a batch are held as one ragged numpy array of byte symbols. Every step looks up the ranks of all adjacent
pairs, finds each sequence's lowest rank, and merges that pair wherever it occurs in its sequence, for all sequences at
once; the count of a pre-token is the number of symbols that survive. A pre-token's count is remembered per worker (a
bounded memo), so frequent words are merged once.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.base import small_batches, table, texts_of

#: The byte-level pre-token pattern of this family of vocabularies (a fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counts a worker remembers. It is only a memo: the result is the same at any size.
MEMO = 400_000
#: Steps after which the sequences that aren't done go on as linked arrays, where a step costs what it merges.
STEPS = 256
#: Context limit of the over_limit column.
LIMIT = 1024


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in chars:
            chars[b] = chr(256 + len(chars) - len(plain))
    return chars


class PairTable:
    """A hash map from pairs of symbols to ranks in flat arrays, for vectorised lookups."""

    def __init__(self, keys: np.ndarray):
        self.levels = []
        left, bits = np.arange(len(keys)), 18
        while len(left):
            slot = self.slot(keys[left], bits, len(self.levels))
            rank = np.full(1 << bits, -1, np.int64)
            rank[slot] = left  # of keys with one slot the last stays, the others go to the next level
            self.levels.append((bits, rank))
            left = left[rank[slot] != left]
            bits = max(8, int(2 * len(left)).bit_length())
        self.keys = keys

    @staticmethod
    def slot(keys: np.ndarray, bits: int, level: int) -> np.ndarray:
        odd = np.uint64((0x9E3779B97F4A7C15 + 0x632BE59BD9B4E01A * level) % (1 << 64))
        return ((keys.astype(np.uint64) * odd) >> np.uint64(64 - bits)).astype(np.int64)

    def ranks(self, wanted: np.ndarray, none: int) -> np.ndarray:
        """Index of each wanted key, or none."""
        out = np.full(len(wanted), none, np.int64)
        open_ = np.arange(len(wanted))
        for level, (bits, rank) in enumerate(self.levels):
            found = rank[self.slot(wanted[open_], bits, level)]
            hit = (found >= 0) & (self.keys[found] == wanted[open_])
            out[open_[hit]] = found[hit]
            open_ = open_[~hit & (found >= 0)]
            if not len(open_):
                break
        return out


def every_second(spots: np.ndarray) -> np.ndarray:
    """Of runs of places that lie side by side (one symbol repeated), every second one from the left."""
    return spots[every_second_of(spots, spots + 1)]


def every_second_of(at: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The same as indices, where right holds each place's right neighbour."""
    fresh = np.r_[True, at[1:] != right[:-1]]
    nth = np.arange(len(at))
    return np.flatnonzero((nth - np.maximum.accumulate(np.where(fresh, nth, 0))) % 2 == 0)


class Merger:
    """Merge ranks of a byte-level vocabulary, applied to many sequences at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        chars = [c for _, c in sorted(byte_alphabet().items())]
        suffix = model.get("end_of_word_suffix") or ""
        self.byte_ids = np.array([vocab[c] for c in chars], np.int64)
        self.last_ids = np.array([vocab[c + suffix] for c in chars], np.int64)
        self.width = 1 << int(max(vocab.values())).bit_length()
        keys, made = [], []
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            keys.append(vocab[left] * self.width + vocab[right])
            made.append(vocab[left + right])
        self.keys, self.made, self.none = np.array(keys, np.int64), np.array(made, np.int64), len(keys)
        self.table = PairTable(self.keys)
        split = "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))
        self.special = regex.compile(split) if split else None
        self.pattern = regex.compile(PRE_TOKEN)
        self.memo: dict[str, int] = {}

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of all words, one after the other, and how many each word has."""
        raw = [w.encode("utf-8") for w in words]
        counts = np.array([len(r) for r in raw], np.int64)
        done = [(np.full(0, 0), np.zeros(0, np.int64))]
        ids = np.flatnonzero(counts)
        sizes = counts[ids]
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.byte_ids[data]
        symbols[np.cumsum(sizes) - 1] = self.last_ids[data[np.cumsum(sizes) - 1]]
        step = 0
        while len(ids):
            starts = np.cumsum(sizes) - sizes
            if step == STEPS:
                for i, x in zip(ids.tolist(), np.split(symbols, starts[1:]), strict=True):
                    kept = self.merge_linked(x)
                    done.append((np.full(len(kept), i), kept))
                    counts[i] = len(kept)
                break
            step += 1
            seq = np.repeat(np.arange(len(ids)), sizes)
            rank = np.full(len(symbols), self.none, np.int64)
            rank[:-1] = self.table.ranks(symbols[:-1] * self.width + symbols[1:], self.none)
            rank[starts + sizes - 1] = self.none  # no pair reaches into the next sequence
            low = np.minimum.reduceat(rank, starts)
            live = low < self.none
            if not live.all():
                out = ~live[seq]
                done.append((ids[seq[out]], symbols[out]))
                symbols, rank = symbols[~out], rank[~out]
                ids, sizes, low = ids[live], sizes[live], low[live]
                if not len(ids):
                    break
                seq = np.repeat(np.arange(len(ids)), sizes)
            spots = every_second(np.flatnonzero(rank == low[seq]))
            symbols[spots] = self.made[rank[spots]]
            keep = np.ones(len(symbols), bool)
            keep[spots + 1] = False
            symbols = symbols[keep]
            sizes = sizes - np.bincount(seq[spots], minlength=len(ids))
            counts[ids] = sizes
        owner, kept = (np.concatenate(x) for x in zip(*done, strict=True))
        return kept[np.argsort(owner, kind="stable")], counts

    def merge_linked(self, symbols: np.ndarray) -> np.ndarray:
        """The same steps for one very long sequence: its lowest-rank pair is merged wherever it occurs, but places are
        filed by rank and symbols linked to their neighbours, so that a step looks only at what it merges."""
        n = len(symbols)
        symbols, after, before = symbols.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        filed: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def file(at: np.ndarray) -> None:
            """Note the pairs that begin at these places under their ranks."""
            at = at[after[at] < n]
            rank = self.table.ranks(symbols[at] * self.width + symbols[after[at]], self.none)
            at, rank = at[rank < self.none], rank[rank < self.none]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for part, r in zip(np.split(at, cuts), rank[np.r_[0, cuts]].tolist() if len(rank) else [], strict=False):
                if r not in filed:
                    filed[r] = []
                    heapq.heappush(queue, r)
                filed[r].append(part)

        file(np.arange(n - 1))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(filed.pop(r)))
            right = after[at]
            there = (symbols[at] >= 0) & (right < n)
            at, right = at[there], right[there]
            same = symbols[at] * self.width + symbols[right] == self.keys[r]
            at, right = at[same], right[same]
            if not len(at):
                continue
            # places that follow each other overlap: every second one of such a run, from the left
            spots = every_second_of(at, right)
            at, right = at[spots], right[spots]
            symbols[at], symbols[right] = self.made[r], -1
            beyond = after[right]
            after[at] = beyond
            inner = beyond < n
            before[beyond[inner]] = at[inner]
            left = before[at]
            file(np.unique(np.r_[at, left[left >= 0]]))
        return symbols[symbols >= 0]

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a special token's own string counts as one token, as the library does by default."""
        memo, found, extra = self.memo, [], []
        for text in texts:
            cut = self.special.split(text) if self.special and any(s in text for s in self.specials) else [text]
            words = self.pattern.findall(cut[0]) if len(cut) == 1 else [w for part in cut for w in self.pattern.findall(part)]
            found.append(words)
            extra.append(len(cut) - 1)
        fresh = list({w for words in found for w in words if w not in memo})
        if fresh:
            new = dict(zip(fresh, self.merge(fresh)[1].tolist(), strict=True))
            if len(memo) + len(new) > MEMO:
                old = memo
                memo = self.memo = {w: old[w] for words in found for w in words if w in old}
            memo.update(new)
        get = memo.__getitem__
        return [sum(map(get, words)) + e for words, e in zip(found, extra, strict=True)]


@cache
def merger(path: str) -> Merger:
    return Merger(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row, by the byte-level BPE vocabulary file at path.

    Null text counts as empty (0 bytes, 0 tokens, not over the limit); null and repeated ids are kept row by row. The
    vocabulary file must lie at path on every executor. Other columns of docs are ignored. One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    kind = docs.select(F.col(id_col).alias("id")).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for batch in batches:
            column = texts_of(batch, "text")
            tokens = m.count_texts(column.to_pylist())
            sizes = pa.compute.binary_length(column).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

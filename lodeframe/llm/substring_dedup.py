"""Paragraphs that repeat within and across documents, by MinHash banding (operator 1).

A paragraph is a line of at least MIN_WORDS words, or shorter lines in a row that together have as many, or, in a text that has
neither, the whole text. It is a set of word 5-grams. Equal sets are one paragraph; for the others, BANDS bands of ROWS minima
each make candidates (at similarity 0.8 a pair shares a band with probability 0.998), whose exact Jaccard similarity is
computed. Components of true links are clusters, of which the first occurrence stays.

A passage that repeats inside of longer, otherwise different paragraphs has no similar paragraph. So every window of PASSAGE
words is a paragraph of its own as well, with one band of PASSAGE_ROWS minima: equal windows surely share it. Windows in a row
mostly have the same minima, so that a text has few keys. Windows of colliding keys are verified word by word (by 128-bit
hashes); equal ones are one cluster, of which the first occurrence stays, and those that overlap are one passage, which is
reported from its first to its last word.

One pass over all texts makes paragraphs and keys; only texts with paragraphs that are compared, or with colliding windows, are
read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.base import Kept, bytes_of, checked_broadcast, offsets_of, passes, small_batches, table, texts_of
from lodeframe.llm.components import linked
from lodeframe.llm.ngram_join import SIMILAR, WORDS, ends_of, sets_of, verifier
from lodeframe.llm.shingles import U, Words, mix, powers, ragged, seeds, set_keys, shingles

MIN_WORDS = 20
BANDS, ROWS = 12, 4
#: Words of a passage at least, and minima of a window's band.
PASSAGE, PASSAGE_ROWS = 50, 2
#: Hashed shingles for which all minima are taken together.
STRIP = 1 << 15


class Lines:
    """The lines of a range of texts, and their words."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = bytes_of(column), offsets_of(column)
        self.lo, hi = int(self.offsets[0]), int(self.offsets[-1])
        breaks = np.flatnonzero(self.data[self.lo : hi] == 10) + self.lo + 1
        self.bounds = np.unique(np.r_[self.offsets, breaks])
        self.words = Words(self.data, self.bounds)
        self.chars = np.r_[0, np.cumsum((self.data[self.lo : hi] & 0xC0) != 0x80)]
        #: First word of each text.
        self.first = np.searchsorted(self.words.start, self.offsets)

    def paragraphs(self, joined: bool = False) -> Paragraphs:
        """Lines of MIN_WORDS words or more. joined: lines in a row that are shorter, but not blank, count as one, and a text
        without any such unit is one."""
        bounds = self.bounds
        if not joined or len(bounds) < 2:
            return Paragraphs(self, bounds, np.diff(np.searchsorted(self.words.start, bounds)) >= MIN_WORDS)
        size = self.words.counts()
        brief = (size > 0) & (size < MIN_WORDS)
        begins = np.ones(len(bounds), bool)
        begins[1:-1] = ~(brief[1:] & brief[:-1]) | np.isin(bounds[1:-1], self.offsets)
        bounds = bounds[begins]
        size = np.diff(np.searchsorted(self.words.start, bounds))
        # texts whose every unit is too short become one unit
        owner = np.searchsorted(self.offsets, bounds[:-1], side="right") - 1
        lone = np.bincount(owner[size >= MIN_WORDS], minlength=len(self.offsets)) == 0
        stays = np.r_[~lone[owner] | np.r_[True, owner[1:] != owner[:-1]], True]
        bounds = bounds[stays]
        size, owner = np.diff(np.searchsorted(self.words.start, bounds)), owner[stays[:-1]]
        return Paragraphs(self, bounds, (size >= MIN_WORDS) | (lone[owner] & (size > 0)))

    def runs(self) -> tuple[np.ndarray, ...]:
        """Runs of windows of PASSAGE words with one band key: text, first and last window (by first word in the text), and key."""
        words, first = self.words, self.first
        h, n = words.hash, len(words.hash)
        grams = PASSAGE - WORDS + 1
        sizes = np.diff(first)
        if not len(sizes) or sizes.max() < PASSAGE:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        gram = np.zeros(n, U)
        for j in range(WORDS):
            gram[: n - j] += h[j:] * seeds(23, 64)[j]
        key = np.zeros(n, U)
        for by in seeds(43, PASSAGE_ROWS):
            key = mix(key * U(0x9E3779B97F4A7C15) + sliding_min(mix(gram ^ by), grams))
        left = np.repeat(first[1:], sizes) - np.arange(n)  # words from here to the end of the text
        whole = left >= PASSAGE
        fresh = whole.copy()
        fresh[1:] &= (key[1:] != key[:-1]) | ~whole[:-1]
        at = np.flatnonzero(fresh)
        ends = whole.copy()
        ends[:-1] &= fresh[1:] | ~whole[1:]
        last = np.flatnonzero(ends)
        text = np.searchsorted(first, at, side="right") - 1
        return text, at - first[text], last - first[text], key[at]


class Paragraphs:
    """Chosen ones of the units between bounds: owner row, number of the first line in its text, and where it lies."""

    def __init__(self, lines: Lines, bounds: np.ndarray, chosen: np.ndarray):
        data, offsets, chars, lo = lines.data, lines.offsets, lines.chars, lines.lo
        first = np.searchsorted(lines.words.start, bounds)
        start, end = bounds[:-1][chosen], bounds[1:][chosen]
        end = end - (data[end - 1] == 10)
        # the last of several empty texts at one place holds what starts there
        self.row = np.searchsorted(offsets, start, side="right") - 1
        text_start = offsets[self.row]
        self.number = np.searchsorted(lines.bounds, start) - np.searchsorted(lines.bounds, text_start)
        self.start, self.end = chars[start - lo] - chars[text_start - lo], chars[end - lo] - chars[text_start - lo]
        counts = np.diff(first)[chosen]
        self.first_word = first[:-1][chosen] - lines.first[self.row]
        self.last_word = self.first_word + counts - 1
        part = copy(lines.words)
        part.hash, part.first = lines.words.hash[ragged(first[:-1][chosen], counts)], np.r_[0, np.cumsum(counts)]
        self.flat, self.first = shingles(part, WORDS)
        self.size = np.diff(self.first)
        self.key, _ = set_keys(self.flat, self.first)

    def bands(self) -> np.ndarray:
        """One key per paragraph and band."""
        out = np.empty((len(self.size), BANDS), U)
        by = seeds(41, BANDS * ROWS)
        a = 0
        while a < len(self.size):
            b = max(a + 1, int(np.searchsorted(self.first, self.first[a] + STRIP, side="right")) - 1)
            part, starts = self.flat[self.first[a] : self.first[b]], self.first[a:b] - self.first[a]
            for band in range(BANDS):
                key = np.full(b - a, band + 1, U)
                for row in range(ROWS):
                    low = np.minimum.reduceat(mix(part ^ by[band * ROWS + row]), starts)
                    key = mix(key * U(0x9E3779B97F4A7C15) + low)
                out[a:b, band] = key
            a = b
        return out


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of x[i : i + n], of fewer at the end."""
    out, width = x.copy(), 1
    while width < n:
        step = min(width, n - width)
        out[:-step] = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:-step]
        width += step
    return out


UNITS = "id bigint, paragraph bigint, at bigint, last bigint, start bigint, end bigint, n bigint, key bigint, bands array<bigint>"


def units(rows: DataFrame, joined: bool) -> Kept:
    """The one pass over all texts: of every paragraph (id, paragraph, first and last word, start, end, n, key, bands), and if
    joined, with a null paragraph, of every run of windows (id, first and last window, key)."""
    names = [x.split()[0] for x in UNITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts_of(batch, "text")
            for a, b in passes(column):
                lines = Lines(column.slice(a, b - a))
                p = lines.paragraphs(joined)
                n = len(p.size)
                ints = [pa.array(x.astype(np.int64)) for x in (p.number, p.first_word, p.last_word, p.start, p.end, p.size, p.key)]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(p.bands().ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(p.row + a)), *ints, bands], names)
                if joined:
                    text, at, last, key = lines.runs()
                    n = len(text)
                    none, ints = pa.nulls(n, pa.int64()), [pa.array(x.astype(np.int64)) for x in (at, last)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(text + a)), none, *ints, none, none, none, pa.array(key.view(np.int64)), pa.nulls(n, pa.list_(pa.int64()))], names
                    )

    return Kept(rows.mapInArrow(run, UNITS), "units")


class Cover:
    """Words of one document that are reported already: from (at, last, removed) of its paragraphs."""

    def __init__(self, known: list[dict]):
        self.runs = {}
        for removed in (True, False):
            joined: list[list[int]] = []
            for a, b in sorted((k["at"], k["last"] + 1) for k in known if k["removed"] == removed):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            self.runs[removed] = np.array(joined, np.int64).reshape(-1, 2)

    def touches(self, removed: bool, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which of the spans have a word in a paragraph of this sort."""
        runs = self.runs[removed]
        if not len(runs):
            return np.zeros(len(start), bool)
        i = np.searchsorted(runs[:, 1], start, side="right")  # the first run that ends behind the start
        return (i < len(runs)) & (runs[np.minimum(i, len(runs) - 1), 0] < end)

    def room(self, removed: bool, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The longest part of each span that has no word in such a paragraph."""
        runs = self.runs[removed]
        if not len(runs):
            return end - start
        a, b = np.r_[-1, runs[:, 1]], np.r_[runs[:, 0], np.iinfo(np.int64).max]  # the gaps between runs
        i, j = np.searchsorted(b, start, side="right"), np.searchsorted(a, end) - 1
        first, last = np.minimum(b[np.minimum(i, len(b) - 1)], end) - np.maximum(a[i], start), np.minimum(b[np.maximum(j, 0)], end) - np.maximum(a[np.maximum(j, 0)], start)
        most = np.where(i <= j, np.maximum(first, last), 0)
        for x in np.flatnonzero(j - i > 1).tolist():  # spans over several gaps
            most[x] = max(most[x], (b[i[x] + 1 : j[x]] - a[i[x] + 1 : j[x]]).max())
        return np.maximum(most, 0)


def flagged(runs: DataFrame, known: DataFrame) -> Kept:
    """(id, at, last, key, live, listed) of runs of windows: live ones have room for a window outside of removed paragraphs,
    listed ones none outside of those that stay."""
    by_id = runs.groupBy("id").agg(F.collect_list(F.struct("at", "last", "key")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten()
            at, last, key = (np.asarray(flat.field(k)) for k in range(3))
            ends = np.cumsum(np.asarray(batch.column(1).value_lengths()), dtype=np.int64)
            live, listed, a = np.ones(len(at), bool), np.zeros(len(at), bool), 0
            for b, known in zip(ends.tolist(), batch.column(2).to_pylist(), strict=True):
                if known:
                    cover, span = Cover(known), (at[a:b], last[a:b] + PASSAGE)
                    live[a:b], listed[a:b] = cover.room(True, *span) >= PASSAGE, cover.room(False, *span) < PASSAGE
                a = b
            owner = pa.array(np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), *(pa.array(x) for x in (at, last, key, live, listed))], ["id", "at", "last", "key", "live", "listed"])

    return Kept(by_id.join(known, "id", "left").select("id", "runs", "known").mapInArrow(run, "id bigint, at bigint, last bigint, key bigint, live boolean, listed boolean"), "flagged")


def every_window(rows: DataFrame, near: DataFrame) -> Kept:
    """(id, version, at, start, end, key, other, live, listed) of the windows in the runs that near (id, runs, known) names, as
    two hashes of their words. Live ones have no word in a removed paragraph, listed ones have one in a paragraph that stays.
    version tells texts of one id apart."""
    names = ["id", "version", "at", "start", "end", "key", "other", "live", "listed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts_of(batch, "text")
            for a, b in passes(column):
                part = column.slice(a, b - a)
                data, offsets = bytes_of(part), offsets_of(part)
                words = Words(data, offsets)
                n, counts = len(words.hash), words.counts()
                change = np.zeros(n + 1, np.int64)
                for i, runs in enumerate(batch.column(2).slice(a, b - a)):
                    at, last = (np.asarray(runs.values.field(k)) for k in range(2))
                    fits = last + PASSAGE <= counts[i]  # another text of this id may be shorter
                    np.add.at(change, words.first[i] + at[fits], 1)
                    np.add.at(change, words.first[i] + last[fits] + 1, -1)
                at = np.flatnonzero(np.cumsum(change[:-1]) > 0)
                unit = np.searchsorted(words.first, at, side="right") - 1
                up, down = powers(n)
                keys = []
                for h in (words.hash, mix(words.hash + U(0x632BE59BD9B4E019))):
                    total = np.zeros(n + 1, U)
                    np.cumsum(h * up, out=total[1:])
                    keys.append(mix((total[at + PASSAGE] - total[at]) * down[at]))
                lo, hi = int(offsets[0]), int(offsets[-1])
                chars = np.r_[0, np.cumsum((data[lo:hi] & 0xC0) != 0x80)]
                base = chars[offsets[unit] - lo]
                start, end = chars[words.start[at] - lo] - base, chars[words.end[at + PASSAGE - 1] - lo] - base
                place = at - words.first[unit]
                live, listed = np.ones(len(at), bool), np.zeros(len(at), bool)
                cuts = np.searchsorted(unit, np.arange(b - a + 1))
                for i, known in enumerate(batch.column(3).slice(a, b - a).to_pylist()):
                    if known:
                        cover, here = Cover(known), slice(cuts[i], cuts[i + 1])
                        live[here], listed[here] = ~cover.touches(True, place[here], place[here] + PASSAGE), cover.touches(False, place[here], place[here] + PASSAGE)
                owner = pa.array(unit + a)
                ints = [pa.array(x.astype(np.int64)) for x in (place, start, end)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(4).take(owner), *ints, *(pa.array(k.view(np.int64)) for k in keys), pa.array(live), pa.array(listed)], names)

    some = rows.join(checked_broadcast(near.select("id")), "id", "left_semi")
    full = some.join(checked_broadcast(near), "id").select("id", "text", "runs", "known", F.xxhash64("text").alias("version"))
    return Kept(full.mapInArrow(run, "id bigint, version bigint, at bigint, start bigint, end bigint, key bigint, other bigint, live boolean, listed boolean"), "windows")


def holders(windows: DataFrame, *keys: str) -> DataFrame:
    """(keys, keep, n, several, loose): the smallest id that holds a window outside of removed paragraphs, how many occurrences
    there are, whether other ids hold it outside of them too, and whether one lies outside of all paragraphs that have copies.
    Only windows of two or more ids."""
    lives = F.when(F.col("live"), F.col("id"))
    found = windows.groupBy(*keys).agg(
        F.min("id").alias("lo"), F.max("id").alias("hi"), F.min(lives).alias("keep"), F.max(lives).alias("last"), F.count("*").alias("n"), F.max(F.expr("live and not listed")).alias("loose")
    )
    return found.filter("lo < hi and keep is not null").select(*keys, "keep", "n", F.expr("keep < last").alias("several"), "loose")


def shared_passages(rows: DataFrame, made: Kept, paragraphs: DataFrame) -> DataFrame:
    """(id, start, end, n_members, keep) of the runs of PASSAGE or more words that other documents hold too. made: units(rows), dropped
    as soon as it isn't needed.
    What has a word in a removed one of `paragraphs` (id, at, last, removed: by words) is reported already, and so is what besides
    has one in one that stays only.

    keep is the smallest id that holds a window outside of removed paragraphs, so that of every window one stays. Neighbouring
    windows with the same keeper are one run; where keep changes another run begins, which overlaps the one before.
    n_members is the least number of occurrences of a run's windows.
    """
    runs = made.df.filter("paragraph is null")
    shared = Kept(runs.groupBy("key").agg(F.min("id").alias("keep"), F.max("id").alias("last")).filter("keep < last").select("key"), "shared")
    met = runs.select("id", "at", "last", "key").join(checked_broadcast(shared.df), "key")
    # A document's runs and paragraphs are as many as its words at most.
    known = paragraphs.groupBy("id").agg(F.collect_list(F.struct("at", "last", "removed")).alias("known"))
    flags = flagged(met, known)
    for t in (shared, made):
        t.drop()
    open_ = Kept(holders(flags.df, "key").filter("several or loose").select("key"), "open")
    hits = flags.df.join(checked_broadcast(open_.df), "key").groupBy("id").agg(F.collect_list(F.struct("at", "last")).alias("runs"))
    near = Kept(hits.join(known, "id", "left").select("id", "runs", "known"), "near")
    windows = every_window(rows, near.df)
    for t in (flags, open_, near):
        t.drop()
    held = Kept(holders(windows.df, "key", "other"), "held")
    told = windows.df.filter("live").join(checked_broadcast(held.df), ["key", "other"]).filter("several or not listed")
    by_text = told.groupBy("id", "version").agg(F.collect_list(F.struct("at", "start", "end", "n", "keep")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, size = batch.column(1).flatten(), np.asarray(batch.column(1).value_lengths())
            owner = np.repeat(np.arange(len(size)), size)
            at, start, end, n, keep = (np.asarray(flat.field(k)) for k in range(5))
            order = np.lexsort((at, owner))
            at, start, end, n, keep, owner = (x[order] for x in (at, start, end, n, keep, owner))
            fresh = np.ones(len(at), bool)
            fresh[1:] = (owner[1:] != owner[:-1]) | (keep[1:] != keep[:-1]) | (at[1:] > at[:-1] + 1)
            first = np.flatnonzero(fresh)
            last = np.r_[first[1:], len(at)][: len(first)] - 1
            least = np.minimum.reduceat(n, first) if len(first) else n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[first])), *(pa.array(x) for x in (start[first], end[last], least, keep[first]))], ["id", "start", "end", "n_members", "keep"])

    out = Kept(by_text.select("id", "spans").mapInArrow(run, "id bigint, start bigint, end bigint, n_members bigint, keep bigint"), "passages")
    windows.drop()
    held.drop()
    return out.df


def pieces(rows: DataFrame, near: DataFrame) -> DataFrame:
    """(id, text) of the paragraphs whose keys and places near (id, places) names, by key. A place of a text that has no such
    paragraph, as another row of its id has it, gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts_of(batch, "text")
            data, offsets = bytes_of(column), offsets_of(column)
            for i, places in enumerate(batch.column(1)):
                key, start, end = (np.asarray(places.values.field(k)) for k in range(3))
                text = data[offsets[i] : offsets[i + 1]]
                at = np.r_[np.flatnonzero((text & 0xC0) != 0x80), len(text)]
                fits = end < len(at)
                key, start, end = key[fits], at[start[fits]], at[end[fits]]
                texts = pa.array([text[x:y].tobytes() for x, y in zip(start.tolist(), end.tolist(), strict=True)], pa.binary()).cast(pa.string())
                same = np.zeros(len(key), bool)
                for a, b, flat, first in sets_of(texts, WORDS):
                    same[a:b] = set_keys(flat, first)[0] == key[a:b]
                chosen = pa.array(np.flatnonzero(same))
                yield pa.RecordBatch.from_arrays([pa.array(key).take(chosen), texts.take(chosen)], ["id", "text"])

    some = rows.join(checked_broadcast(near.select("id")), "id", "left_semi")
    return some.join(checked_broadcast(near), "id").select("text", "places").mapInArrow(run, "id bigint, text string")


def elements(texts: DataFrame) -> DataFrame:
    """(id, element): the shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, flat, first in sets_of(texts_of(batch, "text"), WORDS):
                size = np.diff(first)
                owner = pa.array(np.repeat(np.arange(len(size)), size) + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array(flat.view(np.int64))], ["id", "element"])

    return texts.mapInArrow(run, "id bigint, element bigint")


def usable(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the rows that take part."""
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")


def clusters(rows: DataFrame, made: Kept) -> DataFrame:
    """(id, paragraph, at, last, start, end, n_members, keep, removed) of every paragraph of units(rows) that has a near copy."""
    near = made.df.filter("paragraph is not null")
    groups = near.groupBy("key").agg(F.count("*").alias("copies"), F.min(F.struct("id", "paragraph")).alias("keep"), F.first("n").cast("int").alias("n"), F.first("bands").alias("bands"))
    once = Kept(groups, "once")
    buckets = once.df.select(F.explode("bands").alias("bucket"), F.col("key").alias("id"), "n", F.lit(0).alias("e"))
    num, den = SIMILAR

    def possible(x, y, c):
        return (F.least(x("n"), y("n")) * den >= F.greatest(x("n"), y("n")) * num) & (c > 0)

    kept: list[Kept] = []

    def fetch(ids: DataFrame) -> DataFrame:
        found = near.select("key", F.struct("id", "start", "end").alias("place")).join(checked_broadcast(ids.withColumnRenamed("id", "key")), "key", "left_semi")
        first = found.groupBy("key").agg(F.min("place").alias("place"))
        places = Kept(first.groupBy("place.id").agg(F.collect_list(F.struct("key", "place.start", "place.end")).alias("places")), "places")
        kept.append(Kept(pieces(rows, places.df).groupBy("id").agg(F.min("text").alias("text")), "texts"))
        places.drop()
        return kept[-1].df

    def verify(pairs: DataFrame) -> DataFrame:
        ids = ends_of(pairs)
        return pairs if ids.isEmpty() else verifier(fetch(ids), once.df.select(F.col("key").alias("id"), "n"), WORDS, SIMILAR, only_needed=True)(pairs)

    def narrow(ids: DataFrame) -> DataFrame:
        """How many of its shingles none of the other ids has: those it can't share with one of them."""
        if ids.isEmpty():
            return ids.withColumn("v", F.lit(0).cast("bigint"))
        crowd = Kept(ids, "crowd")
        kept.append(crowd)
        own = elements(fetch(crowd.df)).groupBy("element").agg(F.count("*").alias("c"), F.min("id").alias("id")).filter("c = 1")
        return crowd.df.join(own.groupBy("id").agg(F.count("*").alias("v")), "id", "left").select("id", F.coalesce("v", F.lit(0)).alias("v"))

    def close(x, y):
        # What is their own is known of the ids of busy buckets against each other; with others they may share all they have.
        left = lambda of: of("n") - of("v")
        most = F.coalesce(F.when(x("v").isNotNull() & y("v").isNotNull(), F.least(left(x), left(y))), F.least(x("n"), y("n")).cast("bigint"))
        return most >= F.ceil((x("n") + y("n")) * num / (num + den))

    label = linked(buckets, possible, verify, narrow=narrow, close=close, popular=True)
    for t in kept:
        t.drop()
    named = Kept(once.df.select("key", "copies", "keep").join(label.df.withColumnRenamed("id", "key"), "key", "left").withColumn("cluster", F.coalesce("component", "key")).drop("component"), "named")
    sizes = named.df.groupBy("cluster").agg(F.sum("copies").alias("n_members"), F.min("keep").alias("keep")).filter("n_members > 1")
    by_key = named.df.select("key", "cluster").join(sizes, "cluster").select("key", "n_members", "keep")
    stays = (F.col("id") == F.col("keep.id")) & (F.col("paragraph") == F.col("keep.paragraph"))
    out = Kept(near.select("id", "paragraph", "at", "last", "start", "end", "key").join(by_key, "key").select("id", "paragraph", "at", "last", "start", "end", "n_members", "keep", (~stays).alias("removed")), "clusters")
    for t in (once, label, named):
        t.drop()
    return out.df


def told(found: DataFrame, id_col: str) -> DataFrame:
    return found.select(F.col("id").alias(id_col), "paragraph", "start", "end", "n_members", F.col("keep.id").alias("keep_doc_id"), F.col("keep.paragraph").alias("keep_paragraph"), "removed")


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", joined: bool = False) -> DataFrame:
    """(id, paragraph, start, end, n_members, keep_doc_id, keep_paragraph, removed) of every paragraph that has a near copy.

    start and end are code points; a cluster's first occurrence, by id and paragraph number, stays and all others are
    removed. Paragraphs of fewer than 20 words and null, empty or blank texts have none. joined: lines of fewer words, but not
    blank ones, that follow each other are one paragraph if they have 20 words, and a text without any paragraph is one, if
    it has words. Rows may repeat an id: each row's paragraphs are occurrences of their own. Rows with a null id don't take
    part. Other columns are ignored. Ids must be integers. Sets of shingles are told apart by 64-bit keys.
    """
    small_batches(docs.sparkSession)
    rows = usable(docs, id_col, text_col)
    made = units(rows, joined)
    out = told(clusters(rows, made), id_col)
    made.drop()
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """repeated_paragraphs(joined) and, with a null paragraph, the passages of 50 or more words that two or more ids share
    outside of removed paragraphs (keep_paragraph is null as well; all but the smallest id's are removed)."""
    small_batches(docs.sparkSession)
    rows = usable(docs, id_col, text_col)
    made = units(rows, True)
    found = clusters(rows, made)
    more = shared_passages(rows, made, found.select("id", "at", "last", "removed"))
    keep = F.struct(F.col("keep").alias("id"), F.lit(None).cast("bigint").alias("paragraph"))
    passages = more.select("id", F.lit(None).cast("bigint").alias("paragraph"), "start", "end", "n_members", keep.alias("keep"), (F.col("id") != F.col("keep")).alias("removed"))
    return told(found.drop("at", "last").unionByName(passages), id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with what repeats() reports as removed cut out of text_col. Ids must be unique; null ids and texts stay as they
    are."""
    spans = F.array_sort(F.collect_list(F.struct("start", "end", F.col("paragraph").isNotNull().alias("line"))))
    gone = repeats(docs, id_col, text_col).filter("removed").groupBy(F.col(id_col).alias("_id")).agg(spans.alias("_gone"))
    rows = docs.join(gone, docs[id_col] == gone["_id"], "left").drop("_id")
    at = rows.columns.index(text_col)
    schema = docs.schema

    def cut(text: str, spans: list[dict]) -> str:
        out, done = [], 0
        for s in spans:
            out.append(text[done : max(done, s["start"])])
            done = max(done, s["end"] + s["line"])  # a paragraph goes with its line end
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            spans = columns.pop().to_pylist()
            columns[at] = pa.array([cut(t, s) if s else t for t, s in zip(columns[at].to_pylist(), spans, strict=True)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))

"""Quality classification from random-indexing word vectors (operator 8).

Every word form has a fixed sparse random index vector; a word's vector adds up the index vectors of the words beside it
in all texts. A document pools its words' vectors (mean and spread) together with index vectors of the words'
shapes (runs of upper case, lower case, digits and each sign). A two-layer network gives a logit, and a temperature fitted
on part of the sample turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodeframe.llm.base import Kept, bytes_of, crc_fold, offsets_of, passes, serve, small_batches, table, texts_of
from lodeframe.llm.shingles import U, Words, byte_values, mix, powers

#: Labelled rows that are learnt from at most: a documented bound.
SAMPLE_ROWS = 6_000
BUCKETS, WIDTH = 1 << 15, 48
SHAPES, SHAPE_WIDTH = 1 << 12, 32
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 2e-3, 1e-4
NEAR = 2
PIECE = 1 << 19
#: Parts in which the word vectors' sums are added up.
BLOCKS = 16


def index_entries(n: int, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the four entries of each sparse ternary index vector."""
    rng = np.random.default_rng(seed)
    drawn = [(rng.integers(0, width, n), rng.choice(np.array([-1.0, 1.0], np.float32), n)) for _ in range(4)]
    return np.stack([d[0] for d in drawn], 1), np.stack([d[1] for d in drawn], 1)


def index_vectors(n: int, width: int, seed: int) -> np.ndarray:
    """Sparse ternary index vectors: four entries of +1 or -1 each."""
    out = np.zeros((n, width), np.float32)
    for place, sign in zip(*(x.T for x in index_entries(n, width, seed)), strict=True):
        out[np.arange(n), place] += sign
    return out


def shape_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """Hash of each word's shape: its character classes with runs collapsed."""
    classes = np.arange(256, dtype=np.uint8)
    classes[65:91], classes[97:123], classes[128:], classes[48:58] = 65, 97, 97, 57
    out = np.empty(len(words.start), U)
    values = byte_values(False)
    done = 0
    while done < len(out):
        base = int(words.start[done])
        stop = max(done + 1, int(np.searchsorted(words.end, base + PIECE, side="right")))
        c = classes[data[base : int(words.end[stop - 1])]]
        a, b = words.start[done:stop] - base, words.end[done:stop] - base
        fresh = np.ones(len(c), bool)
        fresh[1:] = c[1:] != c[:-1]
        fresh[a] = True
        nth = np.r_[0, np.cumsum(fresh)]
        up, down = powers(int(nth[-1]) + 1)
        run = np.zeros(len(c) + 1, U)
        np.cumsum(np.where(fresh, values[c] * up[nth[:-1]], U(0)), out=run[1:])
        out[done:stop] = mix((run[b] - run[a]) * down[nth[a]])
        done = stop
    return out


def slots(hashes: np.ndarray, n: int) -> np.ndarray:
    return (hashes % U(n)).astype(np.int64)


def add_neighbours(total: np.ndarray, column: pa.Array, place: np.ndarray, sign: np.ndarray) -> None:
    """Adds to each word slot's part of total the index vectors of the words up to NEAR beside it. In place, a direction and
    a distance at a time, so that a pass over the texts needs little memory beside total."""
    sign = sign.astype(total.dtype)
    for a, b in passes(column):
        part = column.slice(a, b - a)
        words = Words(bytes_of(part), offsets_of(part), False)
        w = slots(words.hash, BUCKETS)
        unit = np.repeat(np.arange(b - a), words.counts())
        for d in range(1, NEAR + 1):
            same = unit[d:] == unit[:-d]
            left, right = w[:-d][same], w[d:][same]
            for x, y in ((left, right), (right, left)):
                np.add.at(total, (x[:, None] * WIDTH + place[y]).ravel(), sign[y].ravel())


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Random indexing over the whole of all texts; a word without neighbours has its own index vector alone.

    Each task adds up its texts; parts are added up on the executors, block by block, so the driver gets BLOCKS arrays. All
    sums are whole numbers, so their order doesn't matter.
    """
    small_batches(texts.sparkSession)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("quality")
        place, sign = index_entries(BUCKETS, WIDTH, 5)
        total = np.zeros(BUCKETS * WIDTH, np.float64)
        for batch in batches:
            add_neighbours(total, texts_of(batch, "text"), place, sign)
        if total.any():
            pack = zstandard.ZstdCompressor(level=1)
            for block, x in enumerate(np.split(total.astype(np.int64), BLOCKS)):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pack.compress(x.tobytes())], pa.binary())], ["block", "part"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("quality")
        unpack, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(unpack.decompress(part.as_py()), np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "sums"])

    total = np.zeros((BLOCKS, BUCKETS * WIDTH // BLOCKS), np.float64)
    parts = texts.select("text").mapInArrow(add, "block int, part binary").repartition(BLOCKS, "block")
    for r in parts.mapInArrow(join, "block int, sums binary").collect():
        total[r["block"]] += np.frombuffer(r["sums"], np.int64)
    total = total.reshape(BUCKETS, WIDTH) + index_vectors(BUCKETS, WIDTH, 5)
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features(column: pa.Array, vectors: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """One row per text: mean and spread of word vectors, mean of shape vectors, the share of words that repeat
    the word before, and the log of the word count."""
    out = np.zeros((len(column), 2 * WIDTH + SHAPE_WIDTH + 2), np.float32)
    for a, b in passes(column):
        part = column.slice(a, b - a)
        data = bytes_of(part)
        words = Words(data, offsets_of(part), False)
        w, s = slots(words.hash, BUCKETS), slots(shape_hashes(data, words), SHAPES)
        for row, (i, j) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True), a):
            n = j - i
            if not n:
                continue
            first, second, shape = np.zeros(WIDTH, np.float64), np.zeros(WIDTH, np.float64), np.zeros(SHAPE_WIDTH, np.float64)
            for k in range(i, j, 1 << 14):
                x = vectors[w[k : min(j, k + (1 << 14))]].astype(np.float64)  # sums of squares would lose digits
                first += x.sum(0)
                second += np.einsum("ij,ij->j", x, x)
            counts = np.bincount(s[i:j])
            kinds = np.flatnonzero(counts)
            shape += counts[kinds] @ shapes[kinds]
            mean = first / n
            out[row, :WIDTH] = mean
            out[row, WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(second / n - mean * mean, 0))
            out[row, 2 * WIDTH : -2] = shape / n
            out[row, -2] = np.count_nonzero(words.hash[i + 1 : j] == words.hash[i : j - 1]) / n
            out[row, -1] = np.log1p(n)
    return out


@dataclass
class Model:
    """vectors and shapes make features; the rest is the network. Without labels of both kinds, prior is all there is."""

    vectors: np.ndarray
    shapes: np.ndarray
    prior: float
    net: tuple | None

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.net is None:
            return np.full(len(column), self.prior)
        mean, scale, w1, b1, w2, b2, temperature = self.net
        x = (features(column, self.vectors, self.shapes) - mean) / scale
        logit = np.tanh(x.astype(np.float64) @ w1 + b1) @ w2 + b2
        return 1 / (1 + np.exp(-np.clip(logit / temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray) -> tuple:
    """Adam on the logistic loss; every fifth row is kept back for the temperature."""
    rng = np.random.default_rng(3)
    back = np.arange(len(x)) % 5 == 0
    mean, scale = x[~back].mean(0), x[~back].std(0) + 1e-3
    z = ((x - mean) / scale).astype(np.float64)
    fit, target = z[~back], y[~back]
    p = [rng.standard_normal((z.shape[1], HIDDEN)) / np.sqrt(z.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(fit))
        for k in range(0, len(order), BATCH):
            xb, yb = fit[order[k : k + BATCH]], target[order[k : k + BATCH]]
            h = np.tanh(xb @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -60, 60))) - yb) / len(yb)
            dh = np.outer(g, p[2]) * (1 - h * h)
            grads = [xb.T @ dh + DECAY * p[0], dh.sum(0), h.T @ g + DECAY * p[2], np.array([g.sum()])]
            step += 1
            for i, q in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * q
                v[i] = 0.999 * v[i] + 0.001 * q * q
                p[i] = p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    held, truth = np.tanh(z[back] @ p[0] + p[1]) @ p[2] + p[3][0], y[back]
    loss = lambda t: np.logaddexp(0, np.where(truth == 1, -held, held) / t).mean()
    temperature = min(np.geomspace(0.25, 16, 61), key=loss)
    return mean, scale, p[0], p[1], p[2], float(p[3][0]), float(temperature)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most rows labelled texts, chosen by the id's hash among ids whose fold isn't 1, and word vectors from
    all texts.

    Only 0 and 1 count as labels; an id labelled more than once has its largest label. Ids without a text are left out.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (crc_fold(F.col(id_col)) != 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    count = known.count()
    scale = 1 << 30
    share = min(scale, int(scale * 1.1 * rows / max(count, 1)) + 1)
    chosen = known.filter(F.pmod(F.xxhash64("id"), F.lit(scale)) < share).orderBy(F.xxhash64("id")).limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    sample = Kept(texts.join(F.broadcast(chosen), "id"), "sample")
    once = sample.df.groupBy("id").agg(F.count("*").alias("n")).filter("n = 1")
    vectors, shapes = word_vectors(texts), index_vectors(SHAPES, SHAPE_WIDTH, 9)
    sent = spark.sparkContext.broadcast((vectors, shapes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("quality")
        vectors, shapes = sent.value
        for batch in batches:
            x = features(texts_of(batch, "text"), vectors, shapes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "label", "x"])

    made = sample.df.join(F.broadcast(once), "id", "left_semi").select("id", F.col("label").cast("int"), "text")
    kind = made.schema["id"].dataType.simpleString()
    rows_ = sorted(made.mapInArrow(run, f"id {kind}, label int, x binary").collect(), key=lambda r: r["id"])
    sample.drop()
    y = np.array([r["label"] for r in rows_], np.float64)
    prior = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2 or len(y) < 20:
        return Model(vectors, shapes, prior, None)
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows_])
    return Model(vectors, shapes, prior, train(x, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, and held_out, score and predicted; only the text is looked at. Columns of docs that have one of
    these names are replaced.

    Null and blank texts are scored as texts without words. Null and repeated ids are scored row by row. One pass, no
    shuffle.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    rows = docs.select(*rest)
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("quality")
        for batch in batches:
            p = sent.value.scores(texts_of(batch, text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, "score"])

    out = rows.mapInArrow(run, schema)
    held = (crc_fold(F.col(id_col)) == 1).alias("held_out")
    return out.select(*rest, held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, learn(docs, table(spark, sf_dir, "labels"))).drop("text")

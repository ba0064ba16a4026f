"""Nearest neighbours with a hierarchical k-means tree and best-bin-first search (operator 10).

The top of the tree is fitted on a bounded sample; every vector is filed under one of its leaves. A leaf that holds more than
LEAF_ROWS vectors gets a tree of its own, fitted on the executors on a sample of its vectors, and so on, so that leaves stay
small however large the table is. A query takes leaves from a priority queue of tree nodes, nearest centre first; what it
takes on one level is opened on the next, and the nearest of all that is open go on.

How many leaves a query visits is calibrated: for some queries the true neighbours among all vectors are computed, and visits
widen until enough of these lie in visited leaves. Leaves are searched in blocks of bounded size, so that a leaf with very
many vectors or queries is spread over many tasks.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.llm.base import Kept, checked_broadcast, small_batches, table

#: Vectors that a tree is fitted on, and queries that the visits are calibrated with: documented bounds.
SAMPLE_ROWS, CALIBRATION_QUERIES = 16_384, 256
#: Vectors that a leaf should hold at most, and sampled ones that it should hold at least.
LEAF_ROWS, LEAF_SAMPLE = 512, 16
BRANCHES, ITERATIONS = 8, 8
#: Share of the calibration queries' true neighbours that must lie in visited leaves.
RECALL = 0.95
#: Leaves visited when calibration starts; they are widened WIDEN times.
VISITS, WIDEN = 32, 4
#: Vectors and queries that one task compares at a time.
BLOCK = 2048
NEIGHBOURS, EVERY = 5, 50
#: Bits of a leaf's number within its tree: numbers of one level lie above all those of the level before.
BITS, TOP = 14, 1 << 14


@dataclass
class Tree:
    """children[i] and centres[i] belong to inner node i; a child is -1 - leaf or an inner node."""

    children: list[list[int]] = field(default_factory=list)
    centres: list[np.ndarray] = field(default_factory=list)
    leaves: int = 0

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector, going down to the nearest centre."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.children else []
        while todo:
            node, rows = todo.pop()
            nearest = np.argmax(x[rows] @ self.centres[node].T, 1)
            for i, child in enumerate(self.children[node]):
                part = rows[nearest == i]
                if child < 0:
                    out[part] = -1 - child
                elif len(part):
                    todo.append((child, part))
        return out

    def visit(self, q: np.ndarray, start: float = -2.0) -> Iterator[tuple[float, int]]:
        """(priority, leaf) of all leaves, best bin first; priorities never fall, and begin at start."""
        if not self.children:
            yield start, 0
            return
        heap = [(start, 0)]
        while heap:
            near, node = heapq.heappop(heap)
            start = max(start, near)
            if node < 0:
                yield start, -1 - node
            else:
                for near, child in zip((-(self.centres[node] @ q)).tolist(), self.children[node], strict=True):
                    heapq.heappush(heap, (near, child))


def grow(x: np.ndarray, most: int) -> Tree:
    """A tree over unit vectors, split until a node has at most `most` of them or can't be split."""
    tree, rng = Tree(), np.random.default_rng(13)

    def split(rows: np.ndarray) -> int:
        if len(rows) > max(most, BRANCHES):
            centres = x[rng.choice(rows, BRANCHES, replace=False)]
            for _ in range(ITERATIONS):
                near = np.argmax(x[rows] @ centres.T, 1)
                sums = np.zeros_like(centres)
                np.add.at(sums, near, x[rows])
                norms = np.linalg.norm(sums, axis=1, keepdims=True)
                centres = np.where(norms > 0, sums / np.maximum(norms, 1e-30), centres)
            near = np.argmax(x[rows] @ centres.T, 1)
            used = np.unique(near)
            if len(used) > 1:
                node = len(tree.children)
                tree.children.append([])
                tree.centres.append(centres[used])
                tree.children[node] = [split(rows[near == i]) for i in used]
                return node
        tree.leaves += 1
        return -tree.leaves

    split(np.arange(len(x)))
    return tree


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one."""
    x = level(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def level(x: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two, which changes no digit, so that very large or small components neither overflow nor
    vanish when squared."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of q (one vector or one for each row) with each row of x, in double precision and the same for equal rows
    wherever they stand."""
    q, x = level(np.atleast_2d(q)), level(x)
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum(1)))


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, vector row and exact cosine of the k best of x for every query, ties to smaller ids; not its own id."""
    rough = unit(q) @ unit(x).T
    own = np.isin(q_ids, ids)
    rough[own] = np.where(q_ids[own][:, None] == ids[None], -np.inf, rough[own])
    least = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k, None] if len(ids) > k else -np.inf
    row, at = np.nonzero((rough >= least - 1e-9) & (rough > -np.inf))  # rough scores may be off in the last digits
    exact = np.concatenate([cosines(q[row[a : a + (1 << 16)]], x[at[a : a + (1 << 16)]]) for a in range(0, max(1, len(row)), 1 << 16)])
    order = np.lexsort((ids[at], -exact, row))
    row, at, exact = row[order], at[order], exact[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], at[nth < k], exact[nth < k]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.to_pylist() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), width)


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec): vectors as bytes of doubles, without those that take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if v and None not in v:
                    x = np.array(v, np.float64)
                    if np.isfinite(x).all() and x.any():
                        ids.append(i)
                        rows.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], ["id", "vec"])

    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    return rows.mapInArrow(run, "id bigint, vec binary")


def hashed_share(n: int, of: int | None) -> int:
    """Bound of a hash modulo 2**30 below which about a tenth more than n of `of` rows lie."""
    return min(1 << 30, int((1 << 30) * 1.1 * n / max(of or 0, 1)) + 1)


def under_trees(rows: DataFrame, trees: DataFrame, sizes: DataFrame, work: Callable, out: str) -> DataFrame:
    """work(tree, batch) over rows (node, id, vec, ...), where each row's node has a tree in trees (node, tree).

    A tree is followed by its rows, in blocks of about BLOCK * 8 rows by sizes (node, n), so that a node of very many rows is
    spread and nothing but a tree is held."""
    blocks = sizes.select("node", F.ceil(F.col("n") / (8 * BLOCK)).cast("int").alias("blocks"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    heads = trees.join(blocks, "node").select("node", "tree", each)
    dealt = rows.join(blocks, "node").withColumn("block", F.pmod(F.xxhash64("id", "vec"), "blocks").cast("int")).drop("blocks").withColumn("tree", F.lit(None).cast("binary"))
    both = heads.unionByName(dealt, allowMissingColumns=True).repartition("node", "block").sortWithinPartitions("node", "block", F.col("tree").isNull())
    names = [c for c in rows.columns if c != "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            heads = np.flatnonzero(np.asarray(batch.column(1).is_valid()))
            for a, b in zip([0, *heads.tolist()], [*heads.tolist(), batch.num_rows], strict=True):
                if a in heads:
                    tree, a = pickle.loads(batch.column(1)[a].as_py()), a + 1
                if a < b:
                    yield work(tree, batch.slice(a, b - a))

    return both.select("node", "tree", *names).mapInArrow(run, out)


class Index:
    """The filed vectors (id, vec, node), the top tree and, level by level, the trees of split leaves (node, tree)."""

    def __init__(self, vectors: DataFrame, id_col: str, vector_col: str, leaf_rows: int):
        self.spark = vectors.sparkSession
        small_batches(self.spark, 4 * BLOCK)
        usable = Kept(valid(vectors, id_col, vector_col), "vectors")
        count = usable.df.count()
        near = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < hashed_share(SAMPLE_ROWS, count)
        sample = usable.df.filter(near).orderBy(F.xxhash64("id"), "vec").limit(SAMPLE_ROWS).collect()
        lengths = [len(r["vec"]) for r in sample]
        self.width = width = max(set(lengths), key=lambda n: (lengths.count(n), -n)) // 8 if lengths else 1
        fit = [r["vec"] for r in sample if len(r["vec"]) == 8 * width]
        most = max(LEAF_SAMPLE, leaf_rows * len(fit) // max(count, 1))
        self.tree = tree = grow(unit(np.frombuffer(b"".join(fit), np.float64).reshape(-1, width)), most) if fit else Tree(leaves=1)
        self.sent = sent = self.spark.sparkContext.broadcast(tree)

        def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    leaf = sent.value.leaf_of(unit(matrix(batch.column(1), width))) + TOP
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["id", "vec", "node"])

        self.filed = Kept(usable.df.filter(F.octet_length("vec") == 8 * width).mapInArrow(file, "id bigint, vec binary, node bigint"), "filed")
        usable.drop()
        self.sizes = [Kept(self.filed.df.groupBy("node").agg(F.count("*").alias("n")), "sizes")]
        self.trees: list[Kept] = []
        while self.split(leaf_rows):
            pass

    def split(self, leaf_rows: int) -> bool:
        """Give every leaf that holds too many vectors a tree of its own; whether any has got one."""
        width, large = self.width, Kept(self.sizes[-1].df.filter(F.col("n") > leaf_rows * 2), "large")
        if large.df.isEmpty():
            large.drop()
            return False
        sizes = checked_broadcast(large.df)
        share = F.least(F.lit(1 << 30), F.ceil(F.lit(SAMPLE_ROWS * float(1 << 30)) / F.col("n")))
        # A level's hash is its own, else a sample would be the part of the level before that made the leaf.
        at = F.pmod(F.xxhash64("id", F.lit(len(self.trees))), F.lit(1 << 30))
        order = Window.partitionBy("node").orderBy(F.xxhash64("id"), "vec")
        sample = self.filed.df.join(sizes, "node").filter(at < share).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= SAMPLE_ROWS)

        def fit(x: pa.Table) -> pa.Table:
            n = x["n"][0].as_py()
            tree = grow(unit(matrix(x["vec"], width)), max(LEAF_SAMPLE, leaf_rows * x.num_rows // n))
            made = [pickle.dumps(tree)] if tree.leaves > 1 else []  # equal vectors can't be split
            return pa.table([pa.array([x["node"][0].as_py()] * len(made), pa.int64()), pa.array(made, pa.binary())], ["node", "tree"])

        trees = Kept(sample.select("node", "n", "vec").groupBy("node").applyInArrow(fit, "node bigint, tree binary"), "trees")
        if trees.df.isEmpty():
            large.drop(), trees.drop()
            return False

        def file(tree: Tree, batch: pa.RecordBatch) -> pa.RecordBatch:
            leaf = tree.leaf_of(unit(matrix(batch.column(3), width)))
            node = (batch.column(0).to_numpy() << BITS) + leaf
            return pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(node)], ["id", "vec", "node"])

        into = checked_broadcast(trees.df.select("node"))
        rows = self.filed.df.join(into, "node", "left_semi").select("node", "id", "vec")
        done = self.filed.df.join(into, "node", "left_anti").select("id", "vec", "node")
        last, self.filed = self.filed, Kept(done.unionByName(under_trees(rows, trees.df, large.df, file, "id bigint, vec binary, node bigint")), "filed")
        last.drop(), large.drop()
        self.trees.append(trees)
        self.sizes.append(Kept(self.filed.df.groupBy("node").agg(F.count("*").alias("n")), "sizes"))
        return True

    def opened(self, queries: DataFrame, visits: int, k: int) -> DataFrame:
        """(id, node, nth): the leaves that queries (id, vec) visit, in order: `visits` of them, and more while these hold no
        more than k vectors."""
        sent, width = self.sent, self.width
        # As many rows as the top tree has leaves.
        held = {r["node"]: r["n"] for r in self.sizes[0].df.collect()}

        def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, nodes, keys = [], [], []
                for i, q in enumerate(unit(matrix(batch.column(1), width)) if batch.num_rows else ()):
                    seen = room = 0
                    for key, leaf in sent.value.visit(q):
                        if n := held.get(leaf + TOP, 0):
                            rows.append(i), nodes.append(leaf + TOP), keys.append(key)
                            seen, room = seen + 1, room + n
                            if seen >= visits and room > k:
                                break
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(nodes, pa.int64()), pa.array(keys, pa.float64())], ["id", "node", "key"])

        order = Window.partitionBy("id").orderBy("key", "node")
        open_ = queries.mapInArrow(top, "id bigint, node bigint, key double")

        def inner(tree: Tree, batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, nodes, keys = [], [], []
            for i, (node, start, q) in enumerate(zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), unit(matrix(batch.column(3), width)), strict=True)):
                for n, (key, leaf) in enumerate(tree.visit(q, start)):
                    if n >= max(visits, k + 1) * 4:
                        break  # far more than can go on, empty leaves included
                    rows.append(i), nodes.append((node << BITS) + leaf), keys.append(key)
            return pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(rows, pa.int64())), pa.array(nodes, pa.int64()), pa.array(keys, pa.float64())], ["id", "node", "key"])

        for trees, sizes in zip(self.trees, self.sizes[1:], strict=True):
            into = checked_broadcast(trees.df.select("node"))
            rows = open_.join(into, "node", "left_semi")
            asked = rows.groupBy("node").agg(F.count("*").alias("n"))
            inside = under_trees(rows.join(queries, "id").select("node", "id", "vec", "key"), trees.df, asked, inner, "id bigint, node bigint, key double")
            all_ = open_.join(into, "node", "left_anti").unionByName(inside).join(checked_broadcast(sizes.df), "node")
            before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            open_ = all_.withColumn("before", before).withColumn("nth", F.row_number().over(order)).filter((F.col("nth") <= visits) | (F.col("before") <= k)).select("id", "node", "key")
        return open_.withColumn("nth", F.row_number().over(order)).select("id", "node", "nth")

    def true_leaves(self, queries: DataFrame, k: int) -> DataFrame:
        """(id, node) of each of the k true neighbours of a few queries, which are held against all vectors."""
        some = queries.collect()
        width, q_ids = self.width, np.array([r["id"] for r in some], np.int64)
        sent = self.spark.sparkContext.broadcast((q_ids, np.frombuffer(b"".join(r["vec"] for r in some), np.float64).reshape(-1, width)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    row, at, score = nearest(*sent.value, batch.column(0).to_numpy(), matrix(batch.column(1), width), k)
                    yield pa.RecordBatch.from_arrays([pa.array(sent.value[0][row]), pa.array(score), batch.column(0).take(pa.array(at)), batch.column(2).take(pa.array(at))], ["id", "score", "other", "node"])

        order = Window.partitionBy("id").orderBy(F.desc("score"), "other")
        found = self.filed.df.mapInArrow(run, "id bigint, score double, other bigint, node bigint") if some else self.filed.df.limit(0).selectExpr("id", "0D as score", "id as other", "node")
        return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("id", "node")

    def calibrated(self, queries: DataFrame, k: int, recall: float) -> int:
        """Leaves to visit: the fewest found that hold the wanted share of the true neighbours of some queries among all vectors.
        They widen until they do; at a recall of 1 all leaves are visited, and the search is exact."""
        leaves = self.sizes[-1].df.count()
        if recall >= 1 or leaves <= 1:
            return max(1, leaves)
        few = Kept(queries.orderBy(F.xxhash64("id")).limit(CALIBRATION_QUERIES), "calibration")
        true = Kept(self.true_leaves(few.df, k), "true")
        wanted, visits = math.ceil(recall * true.df.count()), VISITS
        while True:
            visits = min(visits, leaves)
            # As many rows as the calibration queries have neighbours.
            ranks = sorted(r["nth"] for r in self.opened(few.df, visits, k).join(F.broadcast(true.df), ["id", "node"]).select("nth").collect())
            if len(ranks) >= wanted or visits == leaves:
                break
            visits *= WIDEN
        few.drop(), true.drop()
        # On one level fewer visits are a part of more; else the beam that was measured is kept.
        return max(1, min(visits, ranks[wanted - 1])) if wanted and len(ranks) >= wanted and not self.trees else visits

    def search(self, queries: DataFrame, visits: int, k: int) -> tuple[DataFrame, Kept]:
        """(query_id, rank, vec_id, score) of the best of the visited leaves, and the visits (id, node, nth).

        The first few leaves of a query, the square root of all, tell how near its k-th neighbour is at least; the others give
        only what is as near."""
        wanted = Kept(self.opened(queries, visits, k), "wanted")
        first = math.isqrt(max(0, visits - 1)) + 1
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        near = Kept(best(self.compared(wanted.df.filter(F.col("nth") <= first), queries.withColumn("least", F.lit(-2.0)), k)), "near")
        reached = near.df.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        bounded = queries.join(reached, "id", "left").select("id", "vec", F.coalesce("least", F.lit(-2.0)).alias("least"))
        rest = self.compared(wanted.df.filter(F.col("nth") > first), bounded, k)
        return best(near.df.drop("rank").unionByName(rest)), wanted

    def compared(self, visits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, vec_id, score): of every leaf and block, the k nearest to each query (id, vec, least) that visits it, if
        they are as near as least."""
        width = self.width
        asked = visits.groupBy("node").agg(F.count("*").alias("asked"))
        parts = self.sizes[-1].df.join(asked, "node").select("node", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asked") / BLOCK).cast("int").alias("groups"))
        blocks = checked_broadcast(parts)
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = visits.join(blocks, "node").select("id", "node", each("blocks").alias("block"), F.pmod(F.xxhash64("id"), "groups").cast("int").alias("group")).join(checked_broadcast(queries), "id")
        right = self.filed.df.join(blocks, "node").select("id", "vec", "node", F.pmod(F.xxhash64("id", "vec"), "blocks").cast("int").alias("block"), each("groups").alias("group"))

        def compare(q: pa.Table, x: pa.Table) -> pa.Table:
            columns = ((), (), ())
            if q.num_rows and x.num_rows:
                q_ids, ids = q["id"].to_numpy(), x["id"].to_numpy()
                row, at, score = nearest(q_ids, matrix(q["vec"], width), ids, matrix(x["vec"], width), k)
                near = score >= q["least"].to_numpy()[row]
                columns = (q_ids[row[near]], ids[at[near]], score[near])
            return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

        keys = ["node", "block", "group"]
        return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(compare, "query_id bigint, vec_id bigint, score double")

    def queries(self, every: int) -> DataFrame:
        return self.filed.df.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec"))


def neighbours(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS, every: int = EVERY, recall: float = RECALL, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine of every id divisible by `every`, nearest first.

    Ties go to the smaller id. Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
    null ids, nor vectors of another length than most of the sample. All rows but those of the query's own id are
    candidates; rows that repeat an id are candidates each, and a query id is searched once, with its smallest vector. All
    candidates are returned if there are fewer than k. An empty table gives no rows. Other columns are ignored. recall=1
    visits every leaf, which is exact.
    """
    index = Index(vectors, id_col, vector_col, leaf_rows)
    queries = Kept(index.queries(every), "queries")
    return index.search(queries.df, index.calibrated(queries.df, k, recall), k)[0]


def measured(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS, recall: float = RECALL, leaf_rows: int = LEAF_ROWS, every: int = EVERY, n: int = 500) -> dict:
    """What the search reaches on queries that it wasn't calibrated with, n ids that `every` doesn't divide: recall against
    brute force, the share of all vectors that a query is compared with, visits and leaves."""
    index = Index(vectors, id_col, vector_col, leaf_rows)
    visits = index.calibrated(index.queries(every), k, recall)
    apart = Kept(index.filed.df.filter(F.col("id") % every != 0).groupBy("id").agg(F.min("vec").alias("vec")).orderBy(F.xxhash64("id")).limit(n), "apart")
    found, wanted = index.search(apart.df, visits, k)
    got = {(r["query_id"], r["vec_id"]) for r in found.collect()}
    exact = {(r["query_id"], r["vec_id"]) for r in index.search(apart.df, index.sizes[-1].df.count(), k)[0].collect()}
    sizes = index.sizes[-1].df
    share = wanted.df.join(sizes, "node").agg(F.sum("n")).first()[0] / (apart.df.count() * index.filed.df.count())
    return {"recall": len(got & exact) / len(exact), "share": share, "visits": visits, "leaves": sizes.count(), "levels": 1 + len(index.trees)}


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))

"""Connected components, and links found without spelling out all pairs of a dense group.

Candidates come as rows (bucket, id): two ids that share a bucket are candidates. First every id of a bucket is tried
against the bucket's hub only, which is linear in the rows, and components are formed from what holds. Then only ids of
different components that share a bucket are tried pair by pair, so that nothing is missed: a pair inside one component
can't change the components. Bounds on what two ids can share are part of the join's condition, so that pairs they exclude
aren't made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.base import Kept, checked_broadcast

#: Rows from which on an open bucket's ids are held against each other's elements before they are paired.
BUSY = 32
#: Ids of one open bucket that one task pairs with as many others of it.
BLOCK = 1024
#: Alternations after which the label graph must be stable (it halves chains every time).
MAX_ROUNDS = 60


def star_step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step of the alternating algorithm, over edges (u, v) with u > v."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def is_stars(edges: DataFrame) -> bool:
    """Whether each u has one edge and no v has any: every component is a star around its smallest id."""
    n = edges.agg(F.count("*"), F.count_distinct("u")).first()
    return n[0] == n[1] and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> Kept:
    """(id, component) of every id of links that isn't the smallest of its component, as a written table.

    Links may be repeated, reversed or loops; null ends are left out. Without links the table is empty.
    """
    state = Kept(links.filter(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    for _ in range(MAX_ROUNDS):
        if is_stars(state.df):
            break
        last = state
        state = Kept(star_step(last.df), "links")
        last.drop()
    else:
        raise RuntimeError("components did not settle")
    out = Kept(state.df.select(F.col("u").alias("id"), F.col("v").alias("component")), "components")
    state.drop()
    return out


def sharing_enough(pairs: DataFrame, rest: DataFrame, possible: Callable) -> DataFrame:
    """The pairs (a, b) that can be a link by the exact number of open buckets that they share."""
    lists = rest.groupBy("id").agg(F.collect_list("bucket").alias("buckets"), F.first("n").alias("n"), F.first("e").alias("e"))
    full = pairs.join(lists.select(F.col("id").alias("a"), F.struct("buckets", "n", "e").alias("x")), "a")
    full = full.join(lists.select(F.col("id").alias("b"), F.struct("buckets", "n", "e").alias("y")), "b")
    x, y = (lambda column: F.col(f"x.{column}")), (lambda column: F.col(f"y.{column}"))
    return full.filter(possible(x, y, F.size(F.array_intersect("x.buckets", "y.buckets")))).select("a", "b")


def linked(
    rows: DataFrame,
    possible: Callable,
    verify: Callable[[DataFrame], DataFrame],
    admit: Callable[[DataFrame], DataFrame] | None = None,
    narrow: Callable | None = None,
    close: Callable | None = None,
    popular: bool = False,
) -> Kept:
    """Components of all true links between ids that share a bucket.

    rows: (bucket long, id long, n int, e int), cheap to read. possible(x, y, c): a column, whether the ids of x and y can be
    a link if they share c buckets at most; x("n"), x("e") and x("s") give an id's values, where s counts its buckets that
    any other id shares too.
    admit: if given, takes distinct pairs (a, b) and returns those that pass further cheap filters. verify: the same, and
    returns those that are links. Returns (id, component) as components() does.
    narrow, close: if given, narrow(ids) gives (id, v) for the ids that are still open after the hubs in a bucket of BUSY or
    more, and close(x, y) says by x("v") and y("v") (null for the others) whether two of them can be a link. popular: buckets
    are no elements of a set, so neither an id's own part nor the buckets that two share say anything about their
    similarity; hubs are ids whose buckets are large; and no row repeats, so that rows count ids.
    """
    # Counted before they are joined back: a bucket of very many ids collapses before the shuffle, and a join can be split.
    several = [F.lit(0).alias("lo"), (F.count("*") - 1).alias("hi")] if popular else [F.min("id").alias("lo"), F.max("id").alias("hi")]
    meeting = Kept(rows.groupBy("bucket").agg(*several).filter("lo < hi").select("bucket"), "meeting")
    met = Kept(rows.join(checked_broadcast(meeting.df), "bucket", "left_semi"), "shared")
    meeting.drop()
    shared = Kept(met.df.join(met.df.groupBy("id").agg(F.count("*").cast("int").alias("s")), "id"), "shared")
    met.drop()
    side = lambda name: lambda column: F.col(f"{name}.{column}")
    admitted = admit or (lambda pairs: pairs)

    # The hub of a bucket is the id with the smallest part of its own: what the others were copied from, if anything is.
    own, ranked = F.col("n") / F.col("s"), shared.df
    if popular:
        sizes = shared.df.groupBy("bucket").agg(F.count("*").alias("size"))
        ranked = shared.df.join(shared.df.join(sizes, "bucket").groupBy("id").agg(F.sum("size").alias("fame")), "id")
        own = -F.col("fame")
    hub = F.min_by(F.struct("id", "n", "e", "s"), F.struct(own.alias("own"), F.col("id"))).alias("hub")
    hubs = ranked.groupBy("bucket").agg(hub)
    stars = shared.df.alias("x").join(hubs, "bucket").filter("x.id <> hub.id")
    stars = stars.filter(possible(side("x"), side("hub"), F.least("x.s", "hub.s"))).select(F.col("hub.id").alias("a"), F.col("x.id").alias("b"))
    tried = Kept(stars.distinct(), "tried")
    passed = Kept(admitted(tried.df), "admitted")
    first = Kept(verify(passed.df), "linked")
    label = components(first.df)

    at = shared.df.join(label.df, "id", "left").select("bucket", "id", "n", "e", "s", F.coalesce("component", "id").alias("c"))
    split = at.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).filter("lo < hi").select("bucket", "size")
    # Ids list their open buckets, rarest first. Two that share c of s and t open buckets share one of the first s - c + 1 and
    # t - c + 1, so it's enough to meet there.
    listed = Window.partitionBy("id").orderBy("size", "bucket")
    ranked = at.drop("s").join(split, "bucket").withColumn("r", F.row_number().over(listed)).withColumn("s", F.count("*").over(Window.partitionBy("id")))
    if popular:  # ids have few buckets then: with their list at hand, a pair is made in the first one that both have
        ranked = ranked.withColumn("list", F.collect_list("bucket").over(listed.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rest = Kept(ranked, "rest")
    if narrow:
        busy = rest.df.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") >= BUSY).select("bucket")
        crowd = rest.df.join(busy, "bucket", "left_semi").select("id").distinct()
        wide, rest = rest, Kept(rest.df.join(narrow(crowd), "id", "left"), "rest")
        wide.drop()
    x, y = side("x"), side("y")
    apart = (x("bucket") == y("bucket")) & (x("i") == y("i")) & (x("j") == y("j")) & (x("c") < y("c")) & possible(x, y, F.least(x("s") - x("r"), y("s") - y("r")) + 1)
    if close:
        apart = apart & close(x, y)
    if popular:
        apart = apart & (F.array_intersect(x("list"), y("list"))[0] == x("bucket"))
    # A bucket of many open ids is held against itself in squares of about BLOCK by BLOCK, each a key of its own.
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine, all_ = F.pmod(F.xxhash64("id"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    left, right = rest.df.select("*", mine.alias("i"), all_.alias("j")), rest.df.select("*", mine.alias("j"), all_.alias("i"))
    across = left.alias("x").join(right.alias("y"), apart).select(x("id").alias("a"), y("id").alias("b")).distinct()
    pairs = across if popular else sharing_enough(across, rest.df, possible)
    again = tried.df.select("a", "b").unionByName(tried.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = Kept(admitted(pairs.select("a", "b").join(again, ["a", "b"], "left_anti")), "tried")
    second = Kept(verify(more.df), "linked")
    out = components(label.df.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(second.df.select("a", "b")))
    for t in (shared, tried, passed, first, label, rest, more, second):
        t.drop()
    return out

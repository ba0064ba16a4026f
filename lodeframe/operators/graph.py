"""Dependency graphs: nodes (name, version), edges (src, dst) and direct dependencies (name), each with a graph_id if there are
several graphs. Equal names of different graphs are different nodes.

Reachability and cycles of a graph of up to LOCAL_EDGES edges are found in one task, by the graph (a lock file has a few
thousand). Larger graphs go by distributed fixpoints, which run until nothing changes; every round is written to the shared
checkpoint folder, so that lineage stays short and a lost executor costs no rounds."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions import rule_tables as fixed
from lodeframe.functions.tables import settled
from lodeframe.functions.text import ends_with_any, explode_lines, outside, trimmed
from lodeframe.operators.dependencies import cargo_edges, cargo_packages, go_mod, go_sum, manifests, npm_packages, placed_requirements

#: Edges, nodes and direct dependencies of a graph that one task holds at most.
LOCAL_EDGES = 200_000
ID = "graph_id"


def by_graph(df: DataFrame) -> DataFrame:
    """df with a graph_id: one for all if it has none."""
    return df if ID in df.columns else df.withColumn(ID, F.lit(""))


def solved(nodes: DataFrame, edges: DataFrame, direct: DataFrame, local: Callable, spread_out: Callable, out: str) -> DataFrame:
    """local(nodes, edges, direct) -> rows on the graphs that are small enough, spread_out(nodes, edges, direct) -> DataFrame of
    (graph_id, *out) on the others."""
    parts = [by_graph(nodes).select(ID, "name").distinct(), by_graph(edges).select(ID, "src", "dst").distinct(), by_graph(direct).select(ID, "name").distinct()]
    rows = parts[0].select(ID, F.lit(0).alias("kind"), F.col("name").alias("a"), F.lit("").alias("b"))
    rows = rows.unionByName(parts[1].select(ID, F.lit(1).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))
    rows = settled(rows.unionByName(parts[2].select(ID, F.lit(2).alias("kind"), F.col("name").alias("a"), F.lit("").alias("b"))))
    sizes = rows.groupBy(ID).agg(F.count("*").alias("n"))
    large = settled(sizes.filter(F.col("n") > LOCAL_EDGES).select(ID))

    def run(x: pa.Table) -> pa.Table:
        graph, a, b, kind = x[ID][0].as_py(), x["a"].to_pylist(), x["b"].to_pylist(), x["kind"].to_pylist()
        of = lambda k: [i for i, y in enumerate(kind) if y == k]
        found = local([a[i] for i in of(0)], [(a[i], b[i]) for i in of(1)], [a[i] for i in of(2)])
        columns = list(zip(*found, strict=True)) if found else [()] * len(names)
        return pa.table([pa.array([graph] * len(found), pa.string()), *(pa.array(c, pa.string()) for c in columns)], [ID, *names])

    names = [c.split()[0] for c in out.split(", ")]
    done = rows.join(large, ID, "left_anti").groupBy(ID).applyInArrow(run, f"{ID} string, {out}")
    if not large.isEmpty():
        far = rows.join(large, ID, "left_semi")
        pick = lambda k, *to: far.filter(F.col("kind") == k).select(ID, *(F.col(c).alias(t) for c, t in zip("ab", to, strict=False)))
        done = done.unionByName(spread_out(pick(0, "name"), pick(1, "src", "dst"), pick(2, "name")).select(ID, *names))
    return done if ID in nodes.columns + edges.columns else done.drop(ID)


def seeds(nodes: DataFrame, edges: DataFrame, direct: DataFrame) -> DataFrame:
    """Direct dependencies that are nodes; for a graph that has none, nodes that nothing depends on."""
    known = nodes.join(direct.select(ID, "name"), [ID, "name"], "left_semi")
    roots = nodes.join(edges.select(ID, F.col("dst").alias("name")), [ID, "name"], "left_anti").join(known.select(ID), ID, "left_anti")
    return known.unionByName(roots).distinct()


def reached_from(nodes: DataFrame, edges: DataFrame, direct: DataFrame) -> DataFrame:
    """What the seeds depend on, by widening one frontier after the other."""
    links = edges.filter("src <> dst")
    seen = frontier = settled(seeds(nodes, edges, direct).select(ID, "name"))
    while not frontier.isEmpty():
        ahead = links.join(frontier.withColumnRenamed("name", "src"), [ID, "src"], "left_semi").select(ID, F.col("dst").alias("name")).distinct()
        frontier = settled(ahead.join(seen, [ID, "name"], "left_anti"))
        seen = settled(seen.unionByName(frontier))
    return seen


def reached_here(nodes: list[str], edges: list[tuple[str, str]], direct: list[str]) -> list[tuple[str]]:
    known = set(nodes)
    seen = known & set(direct) or known - {b for _, b in edges}
    after: dict[str, list[str]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    todo = list(seen)
    while todo:
        for b in after.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return [(x,) for x in seen]


def reachable(nodes: DataFrame, edges: DataFrame, direct: DataFrame) -> DataFrame:
    """([graph_id], name) of all that the seeds of a graph depend on, seeds included: direct dependencies that are nodes, or else
    nodes that nothing depends on."""
    return solved(nodes, edges, direct, reached_here, reached_from, "name string")


def unreachable(nodes: DataFrame, edges: DataFrame, direct: DataFrame) -> DataFrame:
    keys = [ID, "name"] if ID in nodes.columns else ["name"]
    return nodes.select(*keys).distinct().join(reachable(nodes, edges, direct), keys, "left_anti")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have edges both in and out, trimmed until nothing changes: only these can lie on cycles."""
    core, size = settled(edges.select(ID, "src", "dst").filter("src <> dst").distinct()), -1
    while (count := core.count()) not in (0, size):
        size = count
        starts, ends = core.select(ID, F.col("src").alias("dst")).distinct(), core.select(ID, F.col("dst").alias("src")).distinct()
        core = settled(core.join(starts, [ID, "dst"], "left_semi").join(ends, [ID, "src"], "left_semi").select(ID, "src", "dst"))
    return core


def cycles_spread(nodes: DataFrame, edges: DataFrame, direct: DataFrame) -> DataFrame:
    """Colours spread forward: a node's colour is the smallest name that reaches it. Within a colour, what reaches the node of
    that name backward is its component; the rest goes another round, which has fewer nodes."""
    core, found = cyclic_core(edges), None
    while not core.isEmpty():
        colour = spread(core)
        end = lambda name, c: colour.select(ID, F.col("name").alias(name), F.col("colour").alias(c))  # noqa: B023, E731
        inside = settled(core.join(end("src", "c1"), [ID, "src"]).join(end("dst", "c2"), [ID, "dst"]).filter("c1 = c2").select(ID, "src", "dst", F.col("c1").alias("colour")))
        part = seen = settled(colour.filter("name = colour").select(ID, "name", "colour"))
        while not part.isEmpty():
            back = inside.join(part.select(ID, F.col("name").alias("dst"), "colour"), [ID, "dst", "colour"], "left_semi").select(ID, F.col("src").alias("name"), "colour").distinct()
            part = settled(back.join(seen, [ID, "name", "colour"], "left_anti"))
            seen = settled(seen.unionByName(part))
        large = seen.groupBy(ID, "colour").agg(F.count("*").alias("n")).filter("n > 1").select(ID, "colour")
        here = seen.join(large, [ID, "colour"], "left_semi").select(ID, F.col("colour").alias("component"), "name")
        found = here if found is None else found.unionByName(here)
        rest = inside.join(seen.select(ID, F.col("name").alias("src")), [ID, "src"], "left_anti").join(seen.select(ID, F.col("name").alias("dst")), [ID, "dst"], "left_anti")
        core = cyclic_core(rest)
    return edges.sparkSession.createDataFrame([], f"{ID} string, component string, name string") if found is None else found


def spread(edges: DataFrame) -> DataFrame:
    """(graph_id, name, colour): the smallest name from which each node can be reached."""
    names = edges.select(ID, F.col("src").alias("name")).unionByName(edges.select(ID, F.col("dst").alias("name"))).distinct()
    colour = settled(names.withColumn("colour", F.col("name")))
    while True:
        sent = edges.join(colour.withColumnRenamed("name", "src"), [ID, "src"]).select(ID, F.col("dst").alias("name"), "colour")
        last, colour = colour, settled(colour.unionByName(sent).groupBy(ID, "name").agg(F.min("colour").alias("colour")))
        if colour.join(last, [ID, "name", "colour"], "left_anti").isEmpty():
            return colour


def cycles_here(nodes: list[str], edges: list[tuple[str, str]], direct: list[str]) -> list[tuple[str, str]]:
    """Strongly connected components by one depth-first walk that keeps its own stack."""
    after: dict[str, list[str]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    inside: set[str] = set()
    found = []
    for root in after:
        walk = [] if root in order else [(root, iter(after[root]))]
        while walk:
            node, rest = walk[-1]
            if node not in order:
                order[node] = low[node] = len(order)
                held.append(node)
                inside.add(node)
            down = None
            for b in rest:
                if b not in order:
                    down = b
                    break
                if b in inside:
                    low[node] = min(low[node], order[b])
            if down is not None:
                walk.append((down, iter(after.get(down, ()))))
                continue
            walk.pop()
            if walk:
                low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
            if low[node] == order[node]:
                part = []
                while not part or part[-1] != node:
                    part.append(held.pop())
                    inside.discard(part[-1])
                if len(part) > 1:
                    found += [(min(part), x) for x in part]
    return found


def cycles(edges: DataFrame) -> DataFrame:
    """([graph_id], component, name) of nodes in strongly connected components of two or more, each named by its smallest
    node; self-loops alone are no cycles."""
    none = by_graph(edges).select(ID, F.col("src").alias("name")).limit(0)
    return solved(none if ID in edges.columns else none.drop(ID), edges, none, cycles_here, cycles_spread, "component string, name string")


def degrees(nodes: DataFrame, edges: DataFrame, direct: DataFrame) -> DataFrame:
    """One row of counts: packages, edges (repeats included), direct dependencies. Of several graphs, a row for all together."""
    n, e, d = (df.agg(F.count("*").alias(k)) for df, k in ((by_graph(nodes).select(ID, "name").distinct(), "packages"), (edges, "edges"), (by_graph(direct).select(ID, "name").distinct(), "direct")))
    return n.crossJoin(e).crossJoin(d)


def graph_summary(nodes: DataFrame, edges: DataFrame, direct: DataFrame) -> DataFrame:
    """graph_id, packages, edges, direct, cycles, on_cycle, reachable, unreachable of every graph that has a node."""
    count = lambda df, k: df.groupBy(ID).agg(F.count("*").alias(k))
    loops, far = cycles(edges), reachable(nodes, edges, direct)
    parts = [count(edges, "edges"), count(direct.select(ID, "name").distinct(), "direct"), loops.groupBy(ID).agg(F.count_distinct("component").alias("cycles"), F.count("*").alias("on_cycle"))]
    parts += [count(far, "reachable"), count(nodes.select(ID, "name").distinct().join(far, [ID, "name"], "left_anti"), "unreachable")]
    out = count(nodes.select(ID, "name").distinct(), "packages")
    for p in parts:
        out = out.join(p, ID, "left")
    return out.select(ID, "packages", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("edges", "direct", "cycles", "on_cycle", "reachable", "unreachable")))


def imports(blobs: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """name: what source lines import, by the habits of several languages."""
    path = F.col("path")
    lines = explode_lines(blobs.filter(outside(path, fixed.SKIP_CODE, ignored) & ends_with_any(path, fixed.IMPORTING_FILES)))
    t = lines.select(trimmed(F.col("line")).alias("t"))
    line = F.col("t")
    rust = F.regexp_replace(F.regexp_replace(line, "^(extern crate )+", ""), "^(use )+", "")
    rust = F.translate(F.regexp_replace(F.substring_index(rust, "::", 1), ";+$", ""), "-", "_")

    def quoted(q: str) -> Column:
        return F.regexp_extract(line, f"^[^{q}]*{q}([^{q}]*){q}", 1)

    def package(text) -> Column:
        return F.when(text.startswith("@"), F.substring_index(text, "/", 2)).otherwise(F.substring_index(text, "/", 1))

    def relative_or_missing(q: str):
        return ~line.rlike(f"^[^{q}]*{q}[^{q}]*{q}") | quoted(q).startswith(".")

    script = F.when(~relative_or_missing("'"), package(quoted("'"))).when(~relative_or_missing('"'), package(quoted('"')))
    python = F.substring_index(F.split(line, r"\s+")[1], ".", 1)
    go = F.when(line.rlike('^[^"]*"[^"]*"'), quoted('"'))
    names = F.array(
        F.when((line.startswith("use ") | line.startswith("extern crate ")) & (rust != ""), rust),
        F.when(line.contains("from ") | line.contains("require("), script),
        F.when((line.startswith("import ") | line.startswith("from ")) & (F.size(F.split(line, r"\s+")) >= 2), python),
        F.when(line.contains('"') & (line.startswith("import") | line.startswith('"')), F.substring_index(go, "/", -1)),
        F.when(line.contains('"') & (line.startswith("import") | line.startswith('"')), go),
    )
    return t.select(F.explode(F.array_compact(names)).alias("name")).distinct()


def parts_of(names: DataFrame, name: str, longest: DataFrame) -> DataFrame:
    """(name, part): the substrings of each name, the empty one included, no longer than the one value in longest."""
    size = F.length(name)
    starts = names.crossJoin(F.broadcast(longest)).select(name, "most", F.explode(F.sequence(F.lit(1), F.greatest(size, F.lit(1)))).alias("at"))
    reach = F.least(size - F.col("at") + 1, F.col("most"))
    each = starts.select(name, "at", F.explode(F.sequence(F.lit(0), reach)).alias("n"))
    return each.select(name, F.expr(f"substr({name}, at, n)").alias("part")).distinct()


def phantoms(direct: DataFrame, imported: DataFrame) -> DataFrame:
    """([graph_id], name) of direct dependencies that no import names: equal, equal with `_` for `-`, or one part of the other.

    Containment goes by equality with the other's substrings, so that neither side has to fit into one machine."""
    plain = lambda c: F.lower(F.translate(c, "-", "_"))
    keys = [ID, "name"] if ID in direct.columns else ["name"]
    d = direct.select(*keys).distinct().withColumn("low", F.lower("name")).withColumn("plain", plain("name"))
    i = imported.select(F.lower("name").alias("imp"), plain("name").alias("plain")).distinct()
    rest = d.join(i.select(F.col("imp").alias("low")).distinct(), "low", "left_anti").join(i.select("plain").distinct(), "plain", "left_anti")
    lows, imps = rest.select("low").distinct(), i.select("imp").distinct()
    most = lambda df, c: df.agg(F.coalesce(F.max(F.length(c)), F.lit(0)).alias("most"))
    within_import = lows.join(parts_of(imps, "imp", most(lows, "low")).select(F.col("part").alias("low")).distinct(), "low", "left_semi")
    holds_import = parts_of(lows, "low", most(imps, "imp")).join(imps.select(F.col("imp").alias("part")), "part", "left_semi").select("low")
    used = within_import.unionByName(holds_import).distinct()
    return rest.join(used, "low", "left_anti").select(*keys)


def graphs(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graph_id, name, version), (graph_id, src, dst), (graph_id, name) of all lock files: root ones of four ecosystems, and
    nested ones of Cargo and npm. A graph's id is its lock file's path."""
    root_only = ~F.col("path").contains("/")
    manifest = lambda lock, own: F.regexp_replace("path", f"{own}$", lock).alias("graph_id")
    declared = manifests(files).select("path", F.explode("deps").alias("name"))
    npm = npm_packages(files)
    go, python = go_sum(files).filter(root_only), placed_requirements(files, ("==", ">=")).filter(root_only)
    module = F.regexp_extract(F.array_join(F.transform(F.split("content", "\n"), trimmed), "\n"), r"(?m)^module (.*)$", 1)
    roots = files.filter(F.col("path") == "go.mod").select(F.lit("go.sum").alias("path"), trimmed(module).alias("name")).filter("name <> ''")
    roots = roots.join(files.filter(F.col("path") == "go.sum").select("path"), "path", "left_semi").withColumn("version", F.lit("root"))
    # Of several entries for a name the last one counts: by place in a file of lines, by key in an object.
    at = lambda df, *place: df.select("path", "name", "version", F.struct(*place).alias("place"))
    lines, none = ["pos", F.lit("").alias("key")], [F.lit(0).alias("pos"), F.lit("").alias("key")]
    nodes = at(cargo_packages(files), *lines).unionByName(at(npm, F.lit(0).alias("pos"), F.col("place").alias("key"))).unionByName(at(go, *none)).unionByName(at(python, *lines))
    nodes = nodes.unionByName(at(roots, F.lit(1).alias("pos"), F.lit("").alias("key")))
    wants = npm.select("path", F.col("name").alias("src"), F.explode("wants").alias("dst"))
    edges = cargo_edges(files).unionByName(wants).unionByName(go.join(roots.select("path", F.col("name").alias("src")), "path").select("path", "src", F.col("name").alias("dst")))
    ends = lambda name: (F.col("path") == name) | F.col("path").endswith("/" + name)
    direct = declared.filter(ends("Cargo.toml")).select(manifest("Cargo.lock", r"Cargo\.toml"), "name")
    direct = direct.unionByName(declared.filter(ends("package.json")).select(manifest("package-lock.json", r"package\.json"), "name"))
    direct = direct.unionByName(go_mod(files, direct_only=True).filter(F.col("path") == "go.mod").select(F.lit("go.sum").alias("graph_id"), "name"))
    last = nodes.groupBy(F.col("path").alias("graph_id"), "name").agg(F.max_by("version", "place").alias("version"))
    return last, edges.withColumnRenamed("path", "graph_id"), direct.distinct()


def dot(nodes: DataFrame, edges: DataFrame, direct: DataFrame, on_cycle: DataFrame | None = None) -> str:
    """The graphs in the DOT language, one after the other; they are collected, as a drawing has to be."""
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    collect = lambda df, *order: by_graph(df).orderBy(ID, *order).collect()
    all_nodes, all_edges, all_direct = collect(nodes, "name"), collect(edges, "src", "dst"), collect(direct, "name")
    groups = {(r[ID], r["name"]): r["component"] for r in by_graph(on_cycle).collect()} if on_cycle is not None else {}
    out = []
    for g in sorted({r[ID] for r in all_nodes}):
        own = {r["name"] for r in all_direct if r[ID] == g}
        out += ["digraph dependencies {", "  rankdir=LR;", "  node [shape=box, style=filled];"]
        for r in all_nodes:
            if r[ID] == g:
                out.append(f"  {quote(r['name'])} [label={quote(r['name'] + ' ' + r['version'])}, fillcolor=\"{'#4FC3F7' if r['name'] in own else '#E0E0E0'}\"];")
        for r in all_edges:
            if r[ID] == g:
                red = " [color=red]" if (g, r["src"]) in groups and groups.get((g, r["dst"])) == groups[(g, r["src"])] else ""
                out.append(f"  {quote(r['src'])} -> {quote(r['dst'])}{red};")
        out.append("}")
    return "\n".join(out)

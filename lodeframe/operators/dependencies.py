"""Dependency manifests and lock files as rows, pinning, advisories. Inputs are files (path, content) or dependencies (name,
version, source)."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions import rule_tables as fixed
from lodeframe.functions.text import lines_of, trimmed
from lodeframe.functions.versions import version_less_than
from lodeframe.operators.licences import normalized


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def named(files: DataFrame, name: str) -> DataFrame:
    return files.filter(file_name(F.col("path")) == name).select("path", "content")


def stripped_lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.transform(lines_of(F.col("content")), trimmed)).alias("pos", "line"))


def unquoted(text: Column) -> Column:
    return F.regexp_replace(text, '^"+|"+$', "")


def cargo_packages(files: DataFrame) -> DataFrame:
    """path, pos, name, version, block (its lines) of every package block of a Cargo.lock that has both."""
    lines = F.transform(lines_of(F.col("content")), trimmed)
    text = F.array_join(lines, "\n")
    blocks = named(files, "Cargo.lock").select("path", F.posexplode(F.split(F.concat(F.lit("\n"), text, F.lit("\n")), r"\n\[\[package\]\](?=\n)")).alias("pos", "block"))

    def last(field: str) -> Column:
        # of several lines for a field the last counts
        return unquoted(F.try_element_at(F.regexp_extract_all("block", F.lit(rf"(?m)^{field} = (.*)$"), F.lit(1)), F.lit(-1)))

    return blocks.select("path", "pos", last("name").alias("name"), last("version").alias("version"), "block").filter("name is not null and version is not null")


def cargo_lock(files: DataFrame) -> DataFrame:
    return cargo_packages(files).select("path", "name", "version")


def cargo_edges(files: DataFrame) -> DataFrame:
    """path, src, dst of the dependency lists in the package blocks; only the name of `name version (source)` counts."""
    inner = F.explode(F.regexp_extract_all("block", F.lit(r"\ndependencies = \[\n((?:(?!\]\n)[^\n]*\n)*)"), F.lit(1)))
    entries = cargo_packages(files).select("path", "name", inner.alias("inner")).select("path", "name", F.explode(F.split("inner", "\n")).alias("entry"))
    dst = F.split(F.regexp_replace("entry", '^[",]+|[",]+$', ""), r"\s+")[0]
    return entries.select("path", F.col("name").alias("src"), dst.alias("dst")).filter("dst <> ''")


#: Sections of an entry or a manifest that name dependencies.
NPM_SECTIONS = ("dependencies", "devDependencies", "peerDependencies")
LOCK = "struct<packages:map<string,struct<version:string," + ",".join(f"{s}:map<string,string>" for s in NPM_SECTIONS) + ">>>"


def keys_in(entry: str) -> Column:
    return F.concat(*[F.coalesce(F.map_keys(f"{entry}.{s}"), F.array().cast("array<string>")) for s in NPM_SECTIONS])


def npm_packages(files: DataFrame) -> DataFrame:
    """path, place, name, version, wants (names in its sections) of the `packages` map of a package-lock.json, without the root."""
    parsed = named(files, "package-lock.json").select("path", F.from_json("content", LOCK).alias("lock"))
    rows = parsed.select("path", F.explode("lock.packages").alias("place", "entry")).filter("place <> ''")
    name = F.substring_index("place", "node_modules/", -1)
    return rows.select("path", "place", name.alias("name"), F.coalesce("entry.version", F.lit("unknown")).alias("version"), keys_in("entry").alias("wants"))


def npm_lock(files: DataFrame) -> DataFrame:
    """path, name, version: the packages map, or in old files, which have none, the nested dependencies."""

    def nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    tree = json.loads(content)
                except (TypeError, ValueError):
                    continue
                todo = [tree] if isinstance(tree, dict) and not isinstance(tree.get("packages"), dict) else []
                while todo:
                    inner = todo.pop().get("dependencies")
                    for name, entry in inner.items() if isinstance(inner, dict) else ():
                        version = entry.get("version") if isinstance(entry, dict) else None
                        rows.append((path, name, version if isinstance(version, str) else "unknown"))
                        if isinstance(entry, dict):
                            todo.append(entry)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [()] * 3)], ["path", "name", "version"])

    old = named(files, "package-lock.json").mapInArrow(nested, "path string, name string, version string")
    return npm_packages(files).select("path", "name", "version").unionByName(old)


def go_sum(files: DataFrame) -> DataFrame:
    """path, name, version: the first version of each module."""
    parts = F.filter(F.split("line", r"\s+"), lambda x: x != "")
    rows = stripped_lines(named(files, "go.sum")).select("path", "pos", parts.alias("p")).filter(F.size("p") >= 2)
    first = F.min_by(F.regexp_replace(F.col("p")[1], r"(/go\.mod)+$", ""), "pos")
    return rows.groupBy("path", F.col("p")[0].alias("name")).agg(first.alias("version"))


def placed_requirements(files: DataFrame, operators: tuple[str, ...]) -> DataFrame:
    """path, pos, name, version of requirements.txt lines; the first of the operators that a line holds splits it. Advisories and
    graphs know `==` and `>=` only."""
    rows = stripped_lines(named(files, "requirements.txt")).filter((F.col("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").startswith("-"))
    name, version = F.col("line"), F.lit("unpinned")
    for op in reversed(operators):
        at = F.instr(F.col("line"), op)
        value = trimmed(F.expr(f"substr(line, instr(line, '{op}') + 2)"))
        name = F.when(at > 0, trimmed(F.expr(f"substr(line, 1, instr(line, '{op}') - 1)"))).otherwise(name)
        version = F.when(at > 0, value if op == "==" else F.concat(F.lit(op), value)).otherwise(version)
    return rows.select("path", "pos", F.substring_index(name, "[", 1).alias("name"), version.alias("version"))


def requirements(files: DataFrame, operators: tuple[str, ...] = ("==", ">=", "~=", "<=", "!=")) -> DataFrame:
    return placed_requirements(files, operators).select("path", "name", "version")


def go_mod(files: DataFrame, direct_only: bool = False) -> DataFrame:
    """path, name of required modules; direct_only leaves out lines marked as indirect."""
    whole = F.array_join(F.transform(lines_of(F.col("content")), trimmed), "\n")
    text = named(files, "go.mod").select("path", F.concat(F.lit("\n"), whole, F.lit("\n")).alias("text"))
    blocks = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"\nrequire \([^\n]*\n((?:(?!\)\n)[^\n]*\n)*)"), F.lit(1)), lambda b: F.split(b, "\n")))
    singles = F.regexp_extract_all("text", F.lit(r"(?<=\n)require ([^(\n]+)(?=\n)"), F.lit(1))
    rows = text.select("path", F.explode(F.concat(blocks, singles)).alias("line")).filter("line <> '' and line not like '//%'")
    if direct_only:
        rows = rows.filter(~F.col("line").contains("// indirect"))
    return rows.select("path", F.split("line", r"\s+")[0].alias("name"))


def manifests(files: DataFrame) -> DataFrame:
    """path, licence, deps of Cargo.toml, package.json and go.mod files. Ones that can't be read have neither."""

    def toml(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    tree = tomllib.loads(content or "")
                except tomllib.TOMLDecodeError:
                    tree = {}
                licence = tree.get("package", {}).get("license") if isinstance(tree.get("package"), dict) else None
                deps = [n for s in ("dependencies", "dev-dependencies", "build-dependencies") if isinstance(tree.get(s), dict) for n in tree[s]]
                rows.append((path, licence if isinstance(licence, str) else None, deps))
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 3, kinds, strict=True)], ["path", "licence", "deps"])

    schema = "path string, licence string, deps array<string>"
    rust = named(files, "Cargo.toml").mapInArrow(toml, schema)
    tree = F.from_json("content", "struct<license:string," + ",".join(f"{s}:map<string,string>" for s in NPM_SECTIONS) + ">")
    npm = named(files, "package.json").select("path", tree.alias("t")).select("path", F.col("t.license").alias("licence"), keys_in("t").alias("deps"))
    modules = go_mod(files).groupBy("path").agg(F.collect_list("name").alias("deps"))
    go = named(files, "go.mod").select("path").join(modules, "path", "left").select("path", F.lit(None).cast("string").alias("licence"), F.coalesce("deps", F.array().cast("array<string>")).alias("deps"))
    return rust.unionByName(npm).unionByName(go).withColumn("licence", normalized(F.col("licence")))


def inventory(files: DataFrame, short_operators: bool = False) -> DataFrame:
    """name, version, source over all lock files; source is the path where it isn't at the root."""
    kinds = [cargo_lock(files), npm_lock(files), go_sum(files), requirements(files, ("==", ">=") if short_operators else ("==", ">=", "~=", "<=", "!="))]
    rows = kinds[0]
    for k in kinds[1:]:
        rows = rows.unionByName(k)
    return rows.select("name", "version", F.col("path").alias("source"))


def by_source(deps: DataFrame) -> DataFrame:
    return deps.groupBy("source").agg(F.count("*").alias("dependencies"))


def listed(deps: DataFrame, n: int = 30) -> DataFrame:
    """The first n of each source by name and version."""
    order = Window.partitionBy("source").orderBy("name", "version")
    return deps.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n)


def unpinned(deps: DataFrame) -> DataFrame:
    v = F.col("version")
    return deps.filter((v == "unpinned") | v.startswith(">=") | v.startswith("~="))


def prerelease(deps: DataFrame) -> DataFrame:
    v = F.col("version")
    return deps.filter(v.startswith("0.") | v.contains("-alpha") | v.contains("-beta") | v.contains("-rc") | v.contains("-dev"))


def snapshot_counts(files: DataFrame) -> DataFrame:
    """One row (sca_total, sca_unpinned) by the snapshot's own way of counting."""
    reqs = stripped_lines(named(files, "requirements.txt")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    a = reqs.agg(F.count("*").alias("n"), F.count_if(~F.col("line").contains("==")).alias("u"))
    b = named(files, "Cargo.lock").agg(F.coalesce(F.sum(F.regexp_count("content", F.lit(r"\[\[package\]\]"))), F.lit(0)).alias("n"))
    lock = F.size(F.map_keys(F.col("lock.packages")))
    c = named(files, "package-lock.json").select(F.from_json("content", LOCK).alias("lock")).agg(F.coalesce(F.sum(F.when(F.col("lock.packages").isNotNull(), F.greatest(lock - 1, F.lit(0)))), F.lit(0)).alias("n"))
    total = F.col("a.n") + F.col("b.n") + F.col("c.n")
    return a.alias("a").crossJoin(b.alias("b")).crossJoin(c.alias("c")).select(total.alias("sca_total"), F.col("a.u").alias("sca_unpinned"))


def advisories(spark) -> DataFrame:
    return spark.createDataFrame(list(fixed.ADVISORIES), "package string, ecosystem string, affected_below string, fixed_version string, cve_id string, severity string, summary string")


def cve_matches(deps: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Dependencies with advisories for their name (case aside) and an older version. The ecosystem isn't looked at.

    The built-in advisories are a few rows and are broadcast; Spark chooses for a table that is given."""
    table = F.broadcast(advisories(deps.sparkSession)) if known is None else known
    on = (F.lower(deps["name"]) == F.lower(table["package"])) & version_less_than(deps["version"], table["affected_below"])
    return deps.join(table, on).select("name", "version", "source", "cve_id", "severity", "fixed_version", "summary")


def update_command(name: Column, fixed_version: Column, source: Column) -> Column:
    return (
        F.when(source == "Cargo.lock", F.format_string("cargo update -p %s --precise %s", name, fixed_version))
        .when(source == "package-lock.json", F.format_string("npm install %s@%s", name, fixed_version))
        .when(source == "go.sum", F.format_string("go get %s@v%s", name, fixed_version))
        .when(source == "requirements.txt", F.format_string("pip install %s==%s", name, fixed_version))
        .otherwise(F.lit(""))
    )


def cve_commands(deps: DataFrame) -> DataFrame:
    found = cve_matches(deps)
    return found.select("name", "version", "source", "cve_id", update_command(F.col("name"), F.col("fixed_version"), F.col("source")).alias("command"))

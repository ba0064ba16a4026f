"""A report as rows of structured elements, and its JSON, Markdown, HTML and text forms.

An element is (seq, section, kind, label, value, cells): kind is heading, stat, ok, warning, info, bar or row."""

from __future__ import annotations

import html
import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.tables import settled
from lodeframe.functions.text import human_size
from lodeframe.operators import activity, complexity, dependencies, graph, licences, present, scans

SCHEMA = "seq bigint, section string, kind string, label string, value string, cells array<string>"
#: Rows of a listing that a report shows; counts are of all rows.
SHOWN = 20


#: The groups of sections, in the order of a report.
ACTIVITY, SECURITY, ANALYSIS, GRAPHS = "activity", "security", "analysis", "graphs"
GROUPS = (ACTIVITY, SECURITY, ANALYSIS, GRAPHS)


@dataclass
class Tables:
    """What a report is made from. files are all readable files, code those whose functions count, ignore the `.gitignore`
    (no row if there's none), late_deps the dependencies that advisories are held against."""

    commits: DataFrame
    changes: DataFrame
    refs: DataFrame
    blobs: DataFrame
    lines: DataFrame
    code: DataFrame
    ignore: DataFrame
    deps: DataFrame
    late_deps: DataFrame
    manifests: DataFrame
    licence_texts: DataFrame
    nodes: DataFrame
    edges: DataFrame
    direct: DataFrame
    imported: DataFrame
    as_of: str
    ignored: tuple[str, ...] = ()


def element(section: str, no: int, kind: str, label, value, cells: Column | None = None) -> list[Column]:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.lit(None).cast("array<string>")
    return [F.lit(no).cast("bigint").alias("seq"), F.lit(section).alias("section"), F.lit(kind).alias("kind"), as_column(label).cast("string").alias("label"), as_column(value).cast("string").alias("value"), (none if cells is None else cells).alias("cells")]


def shown_value(field) -> Column:
    """A value as a report shows it: fractions with two digits, cut off."""
    c = F.col(field.name)
    if field.dataType.typeName() == "double":
        n = F.floor(c * 100)
        return F.concat((F.floor(n / 100)).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss") if field.dataType.typeName().startswith("timestamp") else c.cast("string"), F.lit(""))


def stats(df: DataFrame, section: str, no: int) -> DataFrame:
    """A row's columns, one element each."""
    pairs = F.array(*[F.struct(F.lit(f.name).alias("k"), shown_value(f).alias("v")) for f in df.schema.fields])
    return df.select(F.explode(pairs).alias("p")).select(*element(section, no, "stat", F.col("p.k"), F.col("p.v")))


def bars(df: DataFrame, section: str, no: int, label: str, value: str) -> DataFrame:
    """A bar for each of the few rows (authors, months, hours) of df, which one window holds."""
    top = F.greatest(F.lit(1), F.max(value).over(Window.partitionBy(F.lit(0))))
    wide = df.withColumn("width", F.floor(F.col(value) / top * present.WIDTH).cast("bigint"))
    return wide.select(*element(section, no, "bar", F.col(label), F.col(value), F.array(F.col("width").cast("string"))))


def listed(df: DataFrame, section: str, no: int, order: Iterable[str], shown: int = SHOWN) -> DataFrame:
    """(no, section, shown, ord, cells) of every row, to be counted and cut to the first in order by first_of()."""
    fields = {f.name: f for f in df.schema.fields}
    key = lambda c: F.lpad(F.col(c).cast("string"), 20, "0") if fields[c].dataType.typeName() in ("integer", "long") else shown_value(fields[c])
    return df.select(F.lit(no).cast("bigint").alias("no"), F.lit(section).alias("section"), F.lit(shown).alias("shown"), F.array(*map(key, order)).alias("ord"), F.array(*[shown_value(f) for f in df.schema.fields]).alias("cells"))


def first_of(rows: DataFrame, sections: list[tuple[int, str]]) -> DataFrame:
    """Elements of listed() rows: for every section the count of its rows, and the first ones. rows are read twice."""
    rows = settled(rows)
    all_ = rows.sparkSession.createDataFrame(sections, "no bigint, section string")
    counts = all_.join(rows.groupBy("no").agg(F.count("*").alias("n")), "no", "left")
    totals = counts.select(F.col("no").alias("seq"), "section", F.lit("stat").alias("kind"), F.lit("Total").alias("label"), F.coalesce("n", F.lit(0)).cast("string").alias("value"), F.lit(None).cast("array<string>").alias("cells"))
    nth = F.row_number().over(Window.partitionBy("no").orderBy("ord", "cells"))
    none = F.lit(None).cast("string")
    first = rows.withColumn("nth", nth).filter(F.col("nth") <= F.col("shown"))
    return totals.unionByName(first.select((F.col("no") + 1).alias("seq"), "section", F.lit("row").alias("kind"), none.alias("label"), none.alias("value"), "cells"))


def elements(t: Tables, groups: Iterable[str] = GROUPS) -> DataFrame:
    """All sections of the groups, in the order of a full scan. Lines are gone through once for all their scans, changes once for
    all sections on the newest commits, code once for its functions, and every other input once for each section."""
    parts: list[DataFrame] = []
    rows: list[DataFrame] = []
    sections: list[tuple[int, str]] = []

    def add(df: DataFrame, section: str, no: int, order: Iterable[str], shown: int = SHOWN) -> None:
        sections.append((no, section))
        rows.append(listed(df, section, no, order, shown))

    if {ACTIVITY, SECURITY} & set(groups):
        late = settled(activity.newest_of_all(t.commits, t.as_of))
        touched = settled(activity.changes_of(late, t.changes))
    if ACTIVITY in groups:
        c, f = t.commits, t.changes
        parts += [
            stats(activity.repo_overview(c, t.refs), "Overview", 10),
            stats(activity.commit_velocity(c, t.as_of), "Velocity", 50),
            bars(activity.top_contributors(c), "Top contributors", 100, "author", "commits"),
            bars(activity.commits_by_month(c), "Commits by month", 200, "month", "commits"),
            bars(activity.commits_by_weekday(c), "Activity by weekday", 300, "day", "commits"),
            bars(activity.commits_by_hour(c).withColumn("hour", F.format_string("%02d", "hour")), "Activity by hour", 400, "hour", "commits"),
            bars(activity.merges_by_month(c, t.as_of), "Merges by month", 600, "month", "merges"),
        ]
        add(activity.emergency_commits(c, t.as_of), "Emergency commits", 500, ["day", "hash"])
        add(activity.largest_files(t.blobs).withColumn("size", human_size(F.col("size"))), "Largest files", 700, ["path"])
        add(activity.most_changed_files(c, f, t.as_of), "Most changed files", 750, ["path"])
        add(activity.bug_fix_files(c, f), "Files of fixes", 760, ["path"])
        add(activity.code_churn(late, touched), "Churn", 770, ["path"])
        add(activity.lines_per_author(late, touched, t.as_of), "Lines by author", 780, ["author"])
        add(activity.stale_files(late, touched), "Stale files", 790, ["last_change", "path"])
    if {SECURITY, ANALYSIS, GRAPHS} & set(groups):
        found = settled(scans.line_scans(t.lines, t.ignored))
        of = lambda scan: found.filter(F.col("scan") == scan)
    if SECURITY in groups:
        add(of("secrets").select("path", "line_no", "rule"), "Secrets", 1000, ["path", "line_no", "rule"], 30)
        add(of("dangerous").select("path", "line_no", "rule"), "Dangerous patterns", 1100, ["path", "line_no", "rule"], 30)
        add(scans.sensitive_files(t.blobs, t.ignored), "Sensitive files", 1150, ["path"])
        add(of("addresses").select("path", "line_no", "nth", F.col("rule").alias("ip")), "Hardcoded addresses", 1200, ["path", "line_no", "nth"])
        add(scans.secret_commits(t.commits), "Commits about secrets", 1300, ["hash"])
        add(scans.sensitive_commits(late, touched), "Commits on sensitive files", 1350, ["hash"])
        add(scans.gitignore_coverage(t.ignore), "Ignored files", 1400, ["entry"])
        missing = t.ignore.agg(F.count("*").alias("n")).filter("n = 0")
        parts.append(missing.select(*element("Ignored files", 1399, "warning", "No .gitignore file found", "")))
    if ANALYSIS in groups:
        add(licences.compliance(t.manifests), "Licences", 2000, ["path"])
        add(licences.licence_files(t.licence_texts), "Licence files", 2050, ["path"])
        functions = settled(complexity.complexity_functions(t.code, t.ignored))
        parts.append(stats(complexity.summary_of(functions), "Complexity", 2060))
        add(complexity.top_of(functions), "Complex functions", 2070, ["path", "line"])
        sast = of("sast").select("path", "line_no", "rule", "severity", "nth")
        by = sast.groupBy("severity").agg(F.count("*").alias("n"))
        parts.append(by.select(*element("Static analysis", 2100, "stat", F.col("severity"), F.col("n"))))
        for i, severity in enumerate(("HIGH", "MEDIUM", "INFO")):
            add(sast.filter(F.col("severity") == severity).drop("severity"), f"Static analysis: {severity}", 2110 + 10 * i, ["path", "line_no", "nth"])
        add(dependencies.by_source(t.deps), "Dependencies", 2200, ["source"])
        add(dependencies.unpinned(t.deps), "Unpinned dependencies", 2210, ["source", "name", "version"], 15)
        add(dependencies.prerelease(t.deps), "Prereleases", 2220, ["source", "name", "version"], 15)
    if GRAPHS in groups:
        add(graph.graph_summary(*map(graph.by_graph, (t.nodes, t.edges, t.direct))), "Dependency graphs", 2400, ["graph_id"])
        loops = graph.cycles(graph.by_graph(t.edges)).groupBy("graph_id", "component").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("members"))
        add(loops, "Circular dependencies", 2410, ["graph_id", "component"], 10)
        add(graph.phantoms(graph.by_graph(t.direct), t.imported), "Unused dependencies", 2420, ["graph_id", "name"])
        add(graph.unreachable(*map(graph.by_graph, (t.nodes, t.edges, t.direct))), "Packages out of reach", 2430, ["graph_id", "name"], 10)
        add(complexity.complexity_hints(t.code, t.ignored), "Refactoring hints", 2500, ["path", "line"], 15)
        add(dependencies.cve_commands(t.late_deps), "Advisories", 2550, ["name", "version", "source", "cve_id"])
        add(scans.remedied(of("remediation")), "Remediation", 2600, ["path", "line_no", "rule"])
    if rows:
        both = rows[0]
        for r in rows[1:]:
            both = both.unionByName(r)
        parts.append(first_of(both, sections))
    if not parts:
        return t.commits.sparkSession.createDataFrame([], SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def collected(rows: DataFrame) -> list[dict]:
    """A report is short by construction, so it's brought to the driver to be written."""
    return [r.asDict() for r in rows.orderBy("seq", "label", "cells").collect()]


def grouped(rows: list[dict]) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for r in rows:
        out.setdefault(r["section"], []).append(r)
    return out


def to_json(rows: list[dict], summary: dict) -> str:
    sections = [{"title": t, "items": [{k: v for k, v in r.items() if k not in ("seq", "section") and v is not None} for r in rs]} for t, rs in grouped(rows).items()]
    return json.dumps({"report": {"format": 1}, "summary": summary, "sections": sections}, ensure_ascii=False, indent=2)


def cell(text: str) -> str:
    return text.replace("|", "\\|").replace("\n", " ")


def to_markdown(rows: list[dict], summary: dict) -> str:
    out = ["# Repository report", "", "| Metric | Value |", "|---|---|", *(f"| {cell(str(k))} | {cell(str(v))} |" for k, v in summary.items()), ""]
    for title, rs in grouped(rows).items():
        out += [f"## {title}", ""]
        for r in rs:
            if r["kind"] == "row":
                out.append("| " + " | ".join(cell(c) for c in r["cells"]) + " |")
            elif r["kind"] == "bar":
                out.append(f"- {r['label']}: {'█' * int(r['cells'][0])} {r['value']}")
            else:
                out.append(f"- **{r['label']}**: {r['value']}")
        out.append("")
    return "\n".join(out)


def chart(rows: list[dict]) -> str:
    """Bars as a drawing."""
    top = max([1, *(float(r["value"]) for r in rows)])
    esc = lambda x: html.escape(str(x))
    out = [f'<svg viewBox="0 0 640 {22 * len(rows) + 4}" width="640" role="img">']
    for i, r in enumerate(rows):
        wide, y = float(r["value"]) / top * 400, 22 * i + 4
        out.append(f'<text x="170" y="{y + 13}" text-anchor="end">{esc(r["label"])}</text><rect x="180" y="{y}" width="{wide:.1f}" height="16" rx="2"/><text x="{186 + wide:.1f}" y="{y + 13}">{esc(r["value"])}</text>')
    return "".join([*out, "</svg>"])


def to_html(rows: list[dict], summary: dict) -> str:
    esc = lambda x: html.escape(str(x))
    body = [f"<p class=status-{esc(summary.get('status', ''))}>{esc(summary.get('status', ''))}</p>", "<table>" + "".join(f"<tr><th>{esc(k)}</th><td>{esc(v)}</td></tr>" for k, v in summary.items()) + "</table>"]
    for title, rs in grouped(rows).items():
        drawn, told = [r for r in rs if r["kind"] == "bar"], [r for r in rs if r["kind"] == "row"]
        inner = [f"<p class={r['kind']}><b>{esc(r['label'])}</b> {esc(r['value'])}</p>" for r in rs if r["kind"] not in ("bar", "row")]
        if drawn:
            inner.append(chart(drawn))
        if told:
            inner.append("<table>" + "".join("<tr>" + "".join(f"<td>{esc(c)}</td>" for c in r["cells"]) + "</tr>" for r in told) + "</table>")
        body.append(f"<details open><summary>{esc(title)}</summary>{''.join(inner)}</details>")
    style = "body{font-family:sans-serif;margin:2em}td,th{padding:.1em .8em;text-align:left;border-bottom:1px solid #ddd}svg{font-size:12px}rect{fill:#48c}.warning,.status-WARNING{color:#a60}.status-CRITICAL{color:#b00}.status-PASS{color:#070}"
    return f"<!doctype html><html><head><meta charset=utf-8><title>Repository report</title><style>{style}</style></head><body>{''.join(body)}</body></html>"


def aligned(rows: list[list[str]], width: int = 50) -> list[str]:
    """Rows of cells as lines of a table; cells of more than width characters are cut."""
    cut = [[c if len(c) <= width else c[: width - 1] + "…" for c in r] for r in rows]
    wide = [max(len(r[i]) for r in cut if i < len(r)) for i in range(max(map(len, cut), default=0))]
    return ["  " + "  ".join(c.ljust(w) for c, w in zip(r, wide, strict=False)).rstrip() for r in cut]


def to_text(rows: list[dict], width: int = 50) -> str:
    out = []
    for title, rs in grouped(rows).items():
        out += ["", title]
        for r in rs:
            if r["kind"] == "bar":
                out.append(f"  {r['label']:>20} {'█' * int(r['cells'][0])} {r['value']}")
            elif r["kind"] != "row":
                out.append(f"  {'! ' if r['kind'] == 'warning' else ''}{r['label']}: {r['value']}" if r["value"] else f"  ! {r['label']}")
        out += aligned([[c.replace("\n", " ") for c in r["cells"]] for r in rs if r["kind"] == "row"], width)
    return "\n".join(out)

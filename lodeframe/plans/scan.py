"""A full scan of one repository, from the command line or over HTTP.

    python -m lodeframe.plans.scan scan --path . --json out.json --history-db folder --show-trends
    python -m lodeframe.plans.scan serve --port 3000
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions.text import explode_lines
from lodeframe.operators import activity, dependencies, graph, history, present
from lodeframe.plans import report
from lodeframe.plans.pdf import pdf
from lodeframe.sources import git

class Scan:
    """The tables of a repository, each read once, and what a report says about them."""

    def __init__(self, spark: SparkSession, path: str, ignored: tuple[str, ...] = (), as_of: str | None = None):
        self.path, self.ignored = git.root(path), ignored
        self.as_of = as_of or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        self.commits = git.read(spark, path, "commits", linecounts=False).persist()
        self.changes, self.blobs, self.refs = (git.read(spark, path, t).persist() for t in ("file_changes", "blobs", "refs"))
        self.files = self.blobs.filter("content is not null")
        self.lines = explode_lines(self.files)

    def elements(self, groups: tuple[str, ...] = report.GROUPS) -> DataFrame:
        files = self.files
        manifests = dependencies.manifests(files).select("path", "licence", F.size("deps").alias("n_deps"))
        ignore = files.filter("path = '.gitignore'").select("content")
        tables = report.Tables(
            self.commits, self.changes, self.refs, self.blobs, self.lines, files, ignore, dependencies.inventory(files), dependencies.inventory(files, True), manifests, files,
            *graph.graphs(files), graph.imports(files, self.ignored), self.as_of, self.ignored,
        )
        return report.elements(tables, groups)

    def snapshot(self) -> DataFrame:
        head = self.commits.agg(F.max_by("oid", "ts").alias("x")).first()["x"] or "unknown"
        return history.snapshot(self.files, self.path, head, datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), self.ignored)

    def dot(self) -> str:
        nodes, edges, direct = graph.graphs(self.files)
        return graph.dot(nodes, edges, direct, graph.cycles(edges))


def summary(row: dict) -> dict:
    status = "CRITICAL" if row["sast_high"] > 0 or row["secrets_found"] > 0 else "WARNING" if row["sast_medium"] > 0 or row["sca_unpinned"] > 5 else "PASS"
    return {**row, "status": status}


def trends(snapshots: DataFrame) -> list[str]:
    """The last snapshots as a table, lines of blocks and arrows. A history is short by construction."""
    rows = [r.asDict() for r in snapshots.orderBy("timestamp").collect()]
    if not rows:
        return ["No history yet"]
    heads = ["Date", "Commit", "High", "Medium", "Complexity", "Advisories", "Secrets"]
    of = lambda r: [r["timestamp"][:10], r["commit_hash"][:7], str(r["sast_high"]), str(r["sast_medium"]), f"{r['complexity_avg']:.1f}", str(r["sca_cve_count"]), str(r["secrets_found"])]
    out = ["Trends", *report.aligned([heads, *map(of, rows)])]
    if len(rows) > 1:
        for label, value in (("SAST HIGH findings", lambda r: r["sast_high"]), ("Avg complexity", lambda r: int(r["complexity_avg"] * 10)), ("CVE count", lambda r: r["sca_cve_count"])):
            out.append(f"  {label}: {present.sparkline([value(r) for r in rows])}")
    metrics = {"SAST HIGH findings": F.col("sast_high"), "Avg complexity": F.floor(F.col("complexity_avg") * 10), "CVE count": F.col("sca_cve_count"), "Secrets found": F.col("secrets_found")}
    return out + [f"  {r['direction']} {r['label']}: {r['first']} → {r['last']}" for r in history.trend_direction(snapshots, "timestamp", metrics).collect()]


def scan(spark: SparkSession, args: argparse.Namespace) -> None:
    groups = tuple(g for g in report.GROUPS if not (args.security_only if g == report.ACTIVITY else args.analytics_only))
    s = Scan(spark, args.path, tuple(d for d in (args.ignore_dirs or "").split(",") if d))
    rows = report.collected(s.elements(groups))
    figures = s.snapshot().persist()
    about = summary(figures.first().asDict())
    text = report.to_text(rows)
    print(text)
    for name, make in (("json", lambda: report.to_json(rows, about)), ("markdown", lambda: report.to_markdown(rows, about)), ("html", lambda: report.to_html(rows, about)), ("dot", s.dot), ("pdf", lambda: pdf(text))):
        if target := getattr(args, name):
            made = make()
            with open(target, "wb") as f:
                f.write(made if isinstance(made, bytes) else made.encode())
    if args.history_db:
        history.append(figures, args.history_db)
    if args.show_trends and args.history_db:
        print("\n".join(trends(history.load(spark, args.history_db, s.path))))


def answer(spark: SparkSession, path: str, url: str) -> tuple[int, dict]:
    """What `/health`, `/status`, `/log?count=` and `/diff` say about a repository."""
    asked = urlparse(url)
    try:
        if asked.path == "/health":
            return 200, {"ok": True, "data": "ok"}
        if asked.path == "/status":
            return 200, {"ok": True, "data": [r.asDict() for r in git.read(spark, path, "status").orderBy("path").collect()]}
        if asked.path == "/log":
            n = int(parse_qs(asked.query).get("count", ["10"])[0])
            return 200, {"ok": True, "data": [r.asDict() for r in activity.commit_log(git.read(spark, path, "commits"), n).collect()]}
        if asked.path == "/diff":
            return 200, {"ok": True, "data": "\n".join(r["line"] for r in git.read(spark, path, "diff").orderBy("line_no").collect())}
        return 404, {"ok": False, "error": "no such path"}
    except Exception as e:  # the answer carries whatever went wrong
        return 500, {"ok": False, "error": str(e)}


def serve(spark: SparkSession, path: str, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            code, body = answer(spark, path, self.path)
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodeframe")
    commands = parser.add_subparsers(dest="command", required=True)
    s = commands.add_parser("scan")
    s.add_argument("--path", default=".")
    for flag in ("--security-only", "--analytics-only", "--show-trends"):
        s.add_argument(flag, action="store_true")
    for target in ("--pdf", "--html", "--json", "--markdown", "--dot", "--history-db", "--ignore-dirs"):
        s.add_argument(target)
    v = commands.add_parser("serve")
    v.add_argument("--port", type=int, default=3000)
    v.add_argument("--path", default=".")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lodeframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "serve":
        serve(spark, args.path, args.port).serve_forever()
    scan(spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""A git repository as Spark data sources: `spark.read.format("git").option("path", p).option("table", t).load()`.

Tables: commits, file_changes, blobs, refs, status, diff. The log and the tree are dealt over partitions by ranges of places
in them, as of the commit that HEAD was when the read was planned, so that several tasks run git side by side. Each task runs
one git process (two for blobs) and streams what it says. The repository must be reachable at path on every executor.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import islice

from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition

SCHEMAS = {
    "commits": "oid string, message string, author string, ts timestamp_ntz, tz_offset_min int, parent_count int, insertions bigint, deletions bigint",
    "file_changes": "oid string, pos int, path string, insertions bigint, deletions bigint",
    "blobs": "path string, size bigint, content string",
    "refs": "kind string, name string",
    "status": "path string, status string",
    "diff": "line_no int, line string",
}


def git(path: str, *args: str, data: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-c", "core.quotePath=false", "-C", path, *args], input=data, capture_output=True, check=True).stdout


def root(path: str) -> str:
    """The repository that path lies in."""
    return os.path.abspath(git(path, "rev-parse", "--show-toplevel").decode().strip() or path)


@dataclass
class Range(InputPartition):
    """Places from..to of the log or the tree of a commit."""

    head: str
    start: int
    stop: int


def streamed(path: str, *args: str, end: bytes) -> Iterator[str]:
    """What git says, cut at end bytes, without holding more than one part."""
    with subprocess.Popen(["git", "-c", "core.quotePath=false", "-c", "log.showRoot=true", "-C", path, *args], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as p:
        left = b""
        while more := p.stdout.read(1 << 16):
            *parts, left = (left + more).split(end)
            yield from (x.decode("utf-8", "replace") for x in parts)
        if left:
            yield left.decode("utf-8", "replace")


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options.get("path", "."), options.get("table", "commits")
        self.parts, self.since = int(options.get("partitions", 8)), None
        self.counted = str(options.get("linecounts", "true")).lower() == "true"

    def pushFilters(self, filters):
        """Lower bounds on ts become a filter of `git log`, which only leaves out what the filter would; all filters stay."""
        for f in filters:
            if self.table == "commits" and isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("ts",) and isinstance(f.value, datetime):
                self.since = f.value if self.since is None else max(self.since, f.value)
            yield f

    def bound(self) -> list[str]:
        return [f"--since-as-filter={self.since.isoformat()}Z"] if self.since else []

    def partitions(self) -> list[Range]:
        if self.table not in ("commits", "file_changes", "blobs"):
            return [Range("", 0, 1)]
        try:
            head = git(self.path, "rev-parse", "--verify", "HEAD").decode().strip()
        except subprocess.CalledProcessError:
            return [Range("", 0, 0)]  # no commit yet
        if self.table == "blobs":
            n = sum(1 for _ in self.tree(head))
        else:
            n = int(git(self.path, "rev-list", "--count", *self.bound(), head))
        step = max(1, -(-n // self.parts))
        return [Range(head, i, min(n, i + step)) for i in range(0, n, step)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.start < partition.stop:
            yield from getattr(self, f"read_{self.table}")(partition)

    def log(self, part: Range, form: str, *args: str) -> Iterator[str]:
        """The entries of a range of the log, each begun by a byte that no message can hold."""
        between = streamed(self.path, "log", f"--skip={part.start}", f"--max-count={part.stop - part.start}", *self.bound(), *args, f"--format=%x01{form}", part.head, end=b"\x01")
        return (entry for entry in between if entry)

    def read_commits(self, part: Range) -> Iterator[tuple]:
        """Without line counts (option linecounts=false) no commit is compared with its parent, and they are null."""
        stat = ["--diff-merges=first-parent", "--no-renames", "--numstat"] if self.counted else ["--no-patch"]
        for entry in self.log(part, "%H%x00%an%x00%ct%x00%cd%x00%P%x00%B%x02", "--date=format:%z", *stat):
            head, _, stat_lines = entry.partition("\x02")
            oid, author, seconds, zone, parents, message = head.split("\0", 5)
            counts = [c.split("\t")[:2] for c in stat_lines.strip().split("\n") if "\t" in c]
            offset = (1 if zone[0] == "+" else -1) * (int(zone[1:3]) * 60 + int(zone[3:5]))
            when = datetime.fromtimestamp(int(seconds), timezone.utc).replace(tzinfo=None)
            added, removed = (sum(int(c[i]) for c in counts if c[i].isdigit()) if self.counted else None for i in (0, 1))
            yield oid, message.rstrip("\n") + "\n", author or "unknown", when, offset, len(parents.split()), added, removed

    def read_file_changes(self, part: Range) -> Iterator[tuple]:
        for entry in self.log(part, "%H%x00", "--diff-merges=first-parent", "--no-renames", "--numstat", "-z"):
            oid, _, changes = entry.partition("\0")
            for pos, row in enumerate(r.lstrip("\n") for r in changes.split("\0") if r.strip("\n")):
                added, removed, path = row.split("\t", 2)
                yield oid, pos, path, int(added) if added.isdigit() else 0, int(removed) if removed.isdigit() else 0

    def tree(self, head: str) -> Iterator[str]:
        rows = streamed(self.path, "ls-tree", "-r", "-l", "-z", head, end=b"\0")
        return (r for r in rows if r.split(" ")[1:2] == ["blob"])

    def read_blobs(self, part: Range) -> Iterator[tuple]:
        """Content is null where it isn't UTF-8."""
        with subprocess.Popen(["git", "-C", self.path, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
            for row in islice(self.tree(part.head), part.start, part.stop):
                about, path = row.split("\t", 1)
                p.stdin.write(about.split()[2].encode() + b"\n")
                p.stdin.flush()
                size = int(p.stdout.readline().split()[2])
                data = p.stdout.read(size)
                p.stdout.read(1)
                try:
                    yield path, size, data.decode("utf-8")
                except UnicodeDecodeError:
                    yield path, size, None

    def read_refs(self, _: Range) -> Iterator[tuple]:
        for ref in git(self.path, "for-each-ref", "--format=%(refname)", "refs/heads", "refs/tags").decode().split():
            yield ("branch", ref[len("refs/heads/") :]) if ref.startswith("refs/heads/") else ("tag", ref[len("refs/tags/") :])

    def read_status(self, _: Range) -> Iterator[tuple]:
        """new before modified before deleted before untracked before other."""
        for row in git(self.path, "status", "--porcelain", "-z", "--no-renames", "--untracked-files=all").decode("utf-8", "replace").split("\0"):
            if row:
                code = row[:2]
                yield row[3:], "untracked" if code == "??" else "new" if "A" in code else "modified" if "M" in code else "deleted" if "D" in code else "other"

    def read_diff(self, _: Range) -> Iterator[tuple]:
        for i, line in enumerate(git(self.path, "diff").decode("utf-8", "replace").splitlines(), 1):
            yield i, line


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema) -> DataSourceReader:
        return GitReader(self.options)


def read(spark, path: str, table: str, partitions: int = 8, linecounts: bool = True):
    """One table of the repository that path lies in. linecounts: whether commits tell how many lines they add and remove."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitSource)
    return spark.read.format("git").option("path", root(path)).option("table", table).option("partitions", partitions).option("linecounts", str(linecounts).lower()).load()

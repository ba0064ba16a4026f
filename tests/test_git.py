"""The git source on a repository made here, up to reports and history."""

import json
import subprocess

import pytest

from lodeframe.functions.text import explode_lines
from lodeframe.operators import activity, dependencies, graph, history, scans
from lodeframe.plans import report
from lodeframe.sources import git


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = tmp_path_factory.mktemp("repo")

    def run(*args, date="2024-01-02T03:04:05 +0200"):
        env = {"GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date, "PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(path)}
        subprocess.run(["git", "-c", "user.name=Ann", "-c", "user.email=a@example.org", "-C", str(path), *args], check=True, capture_output=True, env=env)

    run("init", "-q", "-b", "main")
    (path / "a.py").write_text('import os\nos.system("x" + y)\n')
    (path / "requirements.txt").write_text("django==1.0\nflask\n")
    (path / "bin").write_bytes(b"\xff\xfe\x00")
    run("add", ".")
    run("commit", "-qm", "First")
    run("checkout", "-qb", "side")
    (path / "auth.py").write_text("a\nb\n")
    run("add", ".")
    run("commit", "-qm", "Fix login token", date="2024-01-03T03:04:05 -0500")
    run("checkout", "-q", "main")
    run("merge", "-q", "--no-ff", "-m", "Merge side", "side", date="2024-01-04T03:04:05 +0000")
    run("tag", "v1")
    (path / "a.py").write_text("changed\n")
    (path / "new.txt").write_text("n\n")
    return path


def test_tables(spark, repo):
    commits = {r["message"].strip(): r for r in git.read(spark, str(repo), "commits", 2).collect()}
    assert set(commits) == {"First", "Fix login token", "Merge side"}
    assert commits["Merge side"]["parent_count"] == 2 and commits["Fix login token"]["tz_offset_min"] == -300
    assert (commits["First"]["insertions"], commits["Merge side"]["insertions"]) == (4, 2)
    changes = git.read(spark, str(repo), "file_changes", 2)
    assert {(r["path"], r["insertions"]) for r in changes.collect() if r["oid"] == commits["Merge side"]["oid"]} == {("auth.py", 2)}
    blobs = {r["path"]: r["content"] for r in git.read(spark, str(repo), "blobs", 2).collect()}
    assert blobs["bin"] is None and blobs["auth.py"] == "a\nb\n"
    assert {tuple(r) for r in git.read(spark, str(repo), "refs").collect()} == {("branch", "main"), ("branch", "side"), ("tag", "v1")}
    assert {tuple(r) for r in git.read(spark, str(repo), "status").collect()} == {("a.py", "modified"), ("new.txt", "untracked")}
    assert git.read(spark, str(repo), "diff").filter("line = '+changed'").count() == 1
    assert git.read(spark, str(repo), "commits").filter("ts >= timestamp_ntz'2024-01-04 00:00:00'").count() == 1


def test_ranges(spark, repo):
    """The same rows by any number of partitions; line counts only where they are asked for."""
    for t in ("commits", "file_changes", "blobs"):
        one, many = (sorted(map(str, git.read(spark, str(repo), t, n).collect())) for n in (1, 7))
        assert one == many and one
    assert {r["insertions"] for r in git.read(spark, str(repo), "commits", linecounts=False).collect()} == {None}


def test_empty_repository(spark, tmp_path):
    subprocess.run(["git", "-C", str(tmp_path), "init", "-q"], check=True)
    assert [git.read(spark, str(tmp_path), t).count() for t in ("commits", "file_changes", "blobs", "refs")] == [0, 0, 0, 0]


def test_full_scan(spark, repo, tmp_path):
    commits, changes, blobs = (git.read(spark, str(repo), t) for t in ("commits", "file_changes", "blobs"))
    assert activity.top_contributors(commits).first()[:] == ("Ann", 2)
    assert scans.sensitive_commits(commits, changes).count() == 2
    files = blobs.filter("content is not null")
    deps = dependencies.inventory(files)
    assert {(r["name"], r["version"]) for r in deps.collect()} == {("django", "1.0"), ("flask", "unpinned")}
    manifests = dependencies.manifests(files).selectExpr("path", "licence", "size(deps) as n_deps")
    ignore = files.filter("path = '.gitignore'").select("content")
    tables = report.Tables(
        commits, changes, git.read(spark, str(repo), "refs"), blobs, explode_lines(files), files, ignore, deps, deps, manifests, files, *graph.graphs(files), graph.imports(files), "2024-02-01"
    )
    rows = report.collected(report.elements(tables))
    assert any(r["kind"] == "warning" and "gitignore" in r["label"] for r in rows)
    assert {r["section"] for r in report.collected(report.elements(tables, ("graphs",)))} == {r["section"] for r in rows if r["seq"] >= 2400}
    summary = {"sast_high": 1, "status": "CRITICAL"}
    assert json.loads(report.to_json(rows, summary))["summary"] == summary
    assert "## Static analysis: HIGH" in report.to_markdown(rows, summary) and "<svg" in report.to_html(rows, summary)
    assert "## Static analysis" in report.to_markdown(rows, summary) and "<details" in report.to_html(rows, summary) and "Python os.system" in report.to_text(rows)
    path = str(tmp_path / "history")
    for day in ("2024-01-05T00:00:00Z", "2024-01-06T00:00:00Z"):
        history.append(history.snapshot(files, "r", "x", day), path)
    kept = history.load(spark, path, "r").collect()
    assert [r["timestamp"][:10] for r in kept] == ["2024-01-05", "2024-01-06"] and kept[0]["sca_unpinned"] == 1


def test_streamed_commits(spark, repo, tmp_path):
    from lodeframe.streaming.commits import windowed_commits

    source = str(tmp_path / "in")
    git.read(spark, str(repo), "commits").selectExpr("oid", "author", "cast(ts as timestamp) as ts").write.parquet(source)
    stream = windowed_commits(spark.readStream.schema("oid string, author string, ts timestamp").parquet(source))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 3


def test_command_line(spark, repo, tmp_path, capsys):
    from lodeframe.plans import scan

    out = {k: tmp_path / f"r.{k}" for k in ("json", "markdown", "html", "dot", "pdf")}
    args = ["scan", "--path", str(repo), "--history-db", str(tmp_path / "h"), "--show-trends", *(x for k, p in out.items() for x in (f"--{k}", str(p)))]
    assert scan.main(args) == 0 and scan.main(args) == 0
    text = capsys.readouterr().out
    assert "Python os.system" in text and "CVE-2024-27351" in text and "→ Secrets found: 0 → 0" in text
    assert "Trends" in text and "CVE count: ▁▁" in text and "No .gitignore file found" in text
    assert json.loads(out["json"].read_text())["summary"]["status"] == "PASS"
    assert out["pdf"].read_bytes().startswith(b"%PDF") and out["dot"].read_text().startswith("digraph")


def test_answers(spark, repo):
    from lodeframe.plans.scan import answer

    assert answer(spark, str(repo), "/health") == (200, {"ok": True, "data": "ok"})
    assert [x["message"] for x in answer(spark, str(repo), "/log?count=2")[1]["data"]] == ["Merge side", "Fix login token"]
    assert "+changed" in answer(spark, str(repo), "/diff")[1]["data"] and len(answer(spark, str(repo), "/status")[1]["data"]) == 2
    assert answer(spark, "/nowhere", "/log")[0] == 500 and answer(spark, str(repo), "/x")[0] == 404

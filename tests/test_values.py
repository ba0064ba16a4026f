"""Goldens for versions, lines, licences, parsers, rules, complexity and graphs."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeframe.functions import rule_tables as fixed
from lodeframe.functions.text import explode_lines, human_size, java, needles, outside, shortened, there, trimmed, without_colour
from lodeframe.functions.versions import version_less_than
from lodeframe.operators import complexity, dependencies, graph, licences, scans

VERSIONS = [
    ("4.17.20", "4.17.21", True), ("4.17.21", "4.17.21", False), ("1.2", "1.2.0", False), ("v0.16.0", "0.17.0", True), ("1.2.6-beta.1", "1.2.6", False), ("10.0.0", "9.9.9", False),
    ("unpinned", "2.31.0", True), (">=2.31.0", "2.31.0", False), ("~=1.0", "1.6.0", True),
]


def test_versions(spark):
    df = spark.createDataFrame(VERSIONS, "a string, b string, want boolean")
    assert [tuple(r) for r in df.select(version_less_than(F.col("a"), F.col("b")), "want").collect() if r[0] != r[1]] == []


def by_hand(current: str, target: str) -> bool:
    def parse(v):
        return [int(m[0]) for p in v.lstrip("v").split(".") if (m := re.match("[0-9]+", p))]

    a, b = parse(current), parse(target)
    n = max(len(a), len(b))
    return a + [0] * (n - len(a)) < b + [0] * (n - len(b))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(*[st.text("0123456789.v-ab", max_size=10)] * 2), min_size=30, max_size=60))
def test_versions_by_hand(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", version_less_than(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r for r in got if r["x"] != by_hand(r["a"], r["b"])] == []


def test_lines(spark):
    df = spark.createDataFrame([("a", "a\r\nb\n"), ("b", ""), ("c", "\n\nx"), ("d", None), ("e", "x\r"), ("f", "\n")], "path string, content string")
    got = {}
    for r in explode_lines(df).orderBy("path", "line_no").collect():
        got.setdefault(r["path"], []).append(r["line"])
    assert got == {"a": ["a", "b"], "c": ["", "", "x"], "e": ["x\r"], "f": [""]}


def test_text(spark):
    df = spark.createDataFrame([("\t a  ",)], "x string")
    assert df.select(trimmed(F.col("x"))).first()[0] == "a"
    one = spark.range(1)
    assert one.select(shortened(F.lit("x" * 61), 60)).first()[0] == "x" * 59 + "…"
    assert one.select(human_size(F.lit(1 << 20)), human_size(F.lit(1536)), human_size(F.lit(3))).first()[:] == ("1024.0 KB", "1.5 KB", "3 B")
    assert one.select(without_colour(F.lit("\x1b[1mx\x1b[0m"))).first()[0] == "x"
    paths = spark.createDataFrame([("vendor/x",), ("web/vendor/x",), ("doc/a",), ("docs/a",)], "path string")
    assert [r[0] for r in paths.filter(outside(F.col("path"), ["vendor/"], ["doc"])).collect()] == ["web/vendor/x", "docs/a"]


def test_all_rules_compile(spark):
    rules = [*fixed.SAST, *fixed.SAST_REMEDIATION, *fixed.SAST_SNAPSHOT, *fixed.SECRETS, *fixed.DANGEROUS]
    assert len(fixed.SAST) == 86
    assert spark.range(1).select(F.array(*[F.lit("x").rlike(java(r[3])) for r in rules])).count() == 1


#: A line that the rule fits, by part of its name; further rules may fit as well.
HITS = {
    "os.system": ('.py', 'os.system("ls")'), "shell=True": (".py", "subprocess.run(cmd, shell=True)"), "prototype pollution (direct": (".js", "a.__proto__ = b"), "weak TLS": (".go", "tls.Config{InsecureSkipVerify: true}"),
    "Java Runtime.exec": (".java", "Runtime.getRuntime().exec(x)"), "PHP extract": (".php", "extract($_GET)"), "Ruby Marshal": (".rb", "Marshal.load(x)"), "mass assignment": (".rb", "p.permit!"), "ECB": (".java", 'Cipher.getInstance("AES/ECB/PKCS5Padding")'),
    "Spring CSRF": (".java", "http.csrf().disable()"), "raw pointer": (".rs", "let p: *const u8 = x;"), "unhandled error": (".go", "x := a.B(c)"), "document.write": (".js", "document.write(x)"), "debug mode": (".py", "app.run(debug=True)"), "JSP": (".jsp", '<%= request.getParameter("a") %>'),
}


@pytest.mark.parametrize("part", sorted(HITS))
def test_rule_hits(spark, part):
    ending, line = HITS[part]
    rows = [(f"src/a{ending}", 1, line), (f"src/a{ending}", 2, "// " + line), (f"src/tests/a{ending}", 3, line), ("src/a.txt", 4, line), (f"vendor/a{ending}", 5, line)]
    got = scans.sast_report(spark.createDataFrame(rows, "path string, line_no int, line string")).collect()
    assert {r["line_no"] for r in got} == {1} and any(part in r["rule"] for r in got)


TEXTS = [
    ("Permission is hereby granted, free of charge ... The above copyright notice and this permission notice shall", "MIT", "high"), ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3", "AGPL-3.0", "high"),
    ("GNU Lesser General Public License version 2.1", "LGPL-2.1", "high"), ("GNU General Public License, version 2, see the lesser one", "GPL", "medium"), ("SPDX-License-Identifier:  GPL2 ", "GPL-2.0-only", "high"),
    ("Redistribution and use in source and binary forms", "BSD-2-Clause", "high"), ("in the public domain", "Public Domain", "medium"), ("nothing", "Unknown", "low"),
]


def test_licence_texts(spark):
    df = spark.createDataFrame([(str(i), t[0]) for i, t in enumerate(TEXTS)], "path string, content string")
    assert [(r["licence"], r["confidence"]) for r in licences.licence_detect(df).orderBy("path").collect()] == [t[1:] for t in TEXTS]


RUST = """fn f(a: i32) -> i32 {
    if a > 0 && a < 9 {
        return 1;
    } else if a < 0 {
        return 2;
    }
    match a { 0 => 3, _ => 4 }
}
fn g() { if true {} }
trait T {
    fn h();
    fn k() {
        if x {}
    }
}
"""
PYTHON = """def p(x):
    # if comment
    if x and x > 1 or x < 0:
        return 1
    elif x:
        for i in x: pass
    def inner():
        while x: pass
    return 0
def q(): pass
"""


def test_complexity(spark):
    df = spark.createDataFrame([("a.rs", RUST), ("b.py", PYTHON)], "path string, content string")
    found = {(r["name"], r["line"], r["complexity"]) for r in complexity.complexity_functions(df).collect()}
    assert found == {("f", 1, 8), ("g", 9, 1), ("h", 11, 2), ("p", 1, 7), ("q", 10, 1)}
    hints = {(r["name"], r["line"], r["complexity"]) for r in complexity.complexity_hints(df, threshold=0).collect()}
    assert hints == {("f", 1, 5), ("g", 9, 1), ("h", 11, 2), ("p", 1, 6), ("q", 10, 1)}
    assert complexity.complexity_snapshot(df, threshold=6).first()[:] == (10 / 3, 1)


def test_graph(spark):
    e = lambda *rows: spark.createDataFrame(list(rows), "src string, dst string")
    got = graph.cycles(e(("a", "b"), ("b", "a"), ("c", "c"), ("b", "d"), ("d", "x"), ("x", "y"), ("y", "d"))).collect()
    assert {(r["component"], r["name"]) for r in got} == {("a", "a"), ("a", "b"), ("d", "d"), ("d", "x"), ("d", "y")}
    assert graph.cycles(e(("a", "b"))).count() == 0
    nodes, direct = spark.createDataFrame([("a",), ("b",), ("z",)], "name string"), spark.createDataFrame([], "name string")
    assert {r[0] for r in graph.reachable(nodes, e(("a", "b"), ("b", "out")), direct).collect()} == {"a", "b", "out", "z"}
    assert graph.unreachable(nodes, e(("a", "b")), spark.createDataFrame([("a",)], "name string")).collect()[0][0] == "z"
    text = graph.dot(nodes.selectExpr("name", "'1' as version"), e(("a", "b")), direct)
    assert '"a" -> "b"' in text and text.startswith("digraph")


def ring(n):
    return [(f"n{i:04}", f"n{(i + 1) % n:04}") for i in range(n)]


@pytest.mark.parametrize("most", [None, 0])
def test_graphs_apart(spark, monkeypatch, most):
    """Equal names of two graphs are different nodes, whether graphs go to a task each or over all of them."""
    if most is not None:
        monkeypatch.setattr(graph, "LOCAL_EDGES", most)
    edges = spark.createDataFrame([("g", "a", "b"), ("h", "b", "a"), ("g", "b", "c"), ("g", "c", "b"), ("h", "b", "b")], "graph_id string, src string, dst string")
    nodes = spark.createDataFrame([(g, x) for g in "gh" for x in "abcd"], "graph_id string, name string")
    direct = spark.createDataFrame([("g", "b"), ("g", "out")], "graph_id string, name string")
    assert {tuple(r) for r in graph.cycles(edges).select("graph_id", "component", "name").collect()} == {("g", "b", "b"), ("g", "b", "c")}
    far = {tuple(r) for r in graph.reachable(nodes, edges, direct).select("graph_id", "name").collect()}
    assert far == {("g", "b"), ("g", "c"), ("h", "c"), ("h", "d")}
    rows = {r["graph_id"]: r for r in graph.graph_summary(nodes, edges, direct).collect()}
    assert tuple(rows["g"])[1:] == (4, 3, 2, 1, 2, 2, 2) and tuple(rows["h"])[1:] == (4, 2, 0, 0, 0, 2, 2)


def test_long_ring_and_chain(spark):
    edges = spark.createDataFrame([*ring(1000), *((f"c{i:04}", f"c{i + 1:04}") for i in range(1000))], "src string, dst string")
    got = graph.cycles(edges).collect()
    assert len(got) == 1000 and {r["component"] for r in got} == {"n0000"}
    nodes = edges.selectExpr("src as name")
    start = spark.createDataFrame([("c0000",)], "name string")
    assert graph.reachable(nodes, edges, start).count() == 1001 and graph.unreachable(nodes, edges, start).count() == 1000


def test_ring_over_all(spark, monkeypatch):
    """A ring and a chain with many more steps than any bound on rounds of old would be for their size."""
    monkeypatch.setattr(graph, "LOCAL_EDGES", 0)
    edges = spark.createDataFrame([*ring(12), ("n0003", "tail"), ("tail", "end")], "src string, dst string")
    got = graph.cycles(edges).collect()
    assert len(got) == 12 and {r["component"] for r in got} == {"n0000"}
    assert graph.reachable(edges.selectExpr("src as name"), edges, spark.createDataFrame([("n0005",)], "name string")).count() == 14


def test_last_version_counts(spark):
    lock = "".join(f'[[package]]\nname = "x"\nversion = "{v}"\n\n' for v in ("1.9.0", "1.10.0"))
    npm = '{"packages":{"":{},"node_modules/b/node_modules/a":{"version":"2.0.0","peerDependencies":{"p":"1"}},"node_modules/a":{"version":"10.0.0","devDependencies":{"d":"1"}}}}'
    files = spark.createDataFrame([("Cargo.lock", lock), ("package-lock.json", npm), ("requirements.txt", "r==2\nr==10\n")], "path string, content string")
    nodes, edges, _ = graph.graphs(files)
    assert {(r["name"], r["version"]) for r in nodes.collect()} == {("x", "1.10.0"), ("a", "2.0.0"), ("r", "10")}
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("a", "p"), ("a", "d")}


def test_one_pass_finds_what_the_scans_find(spark, small):
    from lodeframe.plans.catalog import LINES

    lines = LINES(spark, small).unionByName(spark.createDataFrame([(f"src/x{e}", i, t) for i, (e, t) in enumerate(HITS.values())], "path string, line_no int, line string"))
    lines = lines.unionByName(spark.createDataFrame([("a.py", 1, "ſECRET = CURſor.execute(ſ)"), ("a.py", 2, "PaſsWORD api_KEY"), ("k.env", 3, "A" * 40), ("a.go", 4, "x = a.B(c)")], "path string, line_no int, line string"))
    found = scans.line_scans(lines)
    of = lambda scan, *columns: sorted(map(tuple, found.filter(F.col("scan") == scan).select(*columns).collect()))
    rows = lambda df, *columns: sorted(map(tuple, df.select(*columns).collect()))
    assert of("secrets", "path", "line_no", "rule") == rows(scans.secrets(lines), "path", "line_no", "pattern")
    assert of("dangerous", "path", "line_no", "rule") == rows(scans.dangerous_patterns(lines), "path", "line_no", "pattern")
    assert of("sast", "path", "line_no", "rule", "severity") == rows(scans.sast_report(lines), "path", "line_no", "rule", "severity")
    assert of("addresses", "path", "line_no", "nth", "rule") == rows(scans.hardcoded_ips(lines), "path", "line_no", "nth", "ip")
    # and without the literals that come first
    plain = lines.filter(scans.code_file(F.col("path"), ()) & ~F.col("line").rlike(scans.COMMENT)).select("path", "line_no", "line", F.explode(scans.hits(fixed.SAST)).alias("hit"))
    assert of("sast", "path", "line_no", "rule") == rows(plain, "path", "line_no", "hit.rule")


def test_patterns_wait_for_their_literals(spark, monkeypatch):
    # On the first line Java runs out of stack in the pattern, which has to be left alone there.
    monkeypatch.setattr(fixed, "SAST", [("slow", "HIGH", ".py", r"(a|b)*needle\(", "")])
    lines = spark.createDataFrame([("src/a.py", 1, "ab" * 100_000), ("src/a.py", 2, "abneedle(")], "path string, line_no int, line string")
    assert [r["line_no"] for r in scans.line_scans(lines).filter("scan = 'sast'").collect()] == [2]


def test_report_reads_once_for_several_sections(spark, small):
    from dataclasses import replace

    from lodeframe.plans import report
    from lodeframe.plans.catalog import AS_OF
    from lodeframe.sources.views import view

    of = lambda name: view(spark, small, name)
    seen = spark.sparkContext.accumulator(0)

    def counted(df):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    none = of("v_blobs").select("path", "content").limit(0)
    ignore = none.select("content")
    deps, manifests, nodes, edges, direct = (of(v) for v in ("v_deps", "v_manifests", "v_graph_nodes", "v_graph_edges", "v_graph_direct"))
    lines = spark.createDataFrame([], "path string, line_no int, line string")
    t = report.Tables(of("v_commits"), of("v_file_changes"), of("v_refs"), of("v_blobs"), lines, of("v_sources"), ignore, deps, deps, manifests, none, nodes, edges, direct, of("v_imports"), AS_OF)
    n = t.changes.count()
    report.elements(replace(t, changes=counted(t.changes)), [report.ACTIVITY, report.SECURITY]).count()
    assert n <= seen.value <= 3 * n
    seen.value = 0
    report.elements(replace(t, code=counted(t.code)), [report.ANALYSIS]).count()
    assert seen.value == t.code.count()


def test_folded_as_patterns_do(spark):
    one = spark.range(128, 0x30000).filter("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    fit = one.filter(F.col("c").rlike(java("(?i)^(" + "|".join("abcdefghijklmnopqrstuvwxyz") + ")$")))
    got = fit.select("c", F.concat(F.lit("x"), scans.folded(F.col("c")), F.lit("y")).rlike("^x[a-z]y$").alias("plain")).collect()
    assert {r["c"] for r in got} >= {"\u017f", "\u212a"} and all(r["plain"] for r in got)


def test_there(spark):
    runs = ["a" * 39, "a" * 40, "-" + "b/" * 20 + "==", "é" + "c" * 41, "d" * 39 + "=" + "d" * 39, "", "e" * 39 + " " + "f" * 40]
    pattern = r"[A-Za-z0-9+/]{40,}={0,2}"
    df = spark.createDataFrame([(x,) for x in runs], "x string")
    assert there(pattern) != java(pattern) and df.filter(F.col("x").rlike(there(pattern)) != F.col("x").rlike(java(pattern))).count() == 0
    for other in (r"[a-z]{2,}x", r"(?i)[a-z]{2,}", r"[^a]{3,}", r"\w{3,}", "[a-z]{2,4}", "("):
        assert there(other) == java(other)


def test_needles():
    assert needles(r"pickle\.(loads?|Unpickler)\(") == (("pickle.",), False)
    assert needles(r"(?i)(Password|secret)\s*=") == (("password", "secret"), True)
    assert needles(r"a?[bc]*") == ((), False) and needles(r"(abc|d?)") == ((), False) and needles(r"(?:xy){2}z") == (("xy",), False)


def test_graphs_of_files(spark, small):
    from lodeframe.sources.views import view

    nodes, edges, direct = graph.graphs(view(spark, small, "v_files"))
    assert {tuple(r) for r in edges.filter("graph_id = 'go.sum'").collect()} == {("go.sum", "m", "a/b"), ("go.sum", "m", "c")}
    assert {tuple(r)[1:] for r in direct.filter("graph_id = 'Cargo.lock'").collect()} == {("serde",), ("quick",)}
    assert ("go.sum", "m", "root") in {tuple(r) for r in nodes.collect()}


def test_phantoms(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    got = graph.phantoms(names("serde-json", "left", "quick"), names("serde_json", "leftpad"))
    assert [r[0] for r in got.collect()] == ["quick"]
    assert graph.phantoms(names("a"), names()).count() == 1


def test_cve_ignores_ecosystem(spark):
    deps = spark.createDataFrame([("semver", "1.0.0", "Cargo.lock"), ("Requests", "unpinned", "x/requirements.txt")], "name string, version string, source string")
    got = {(r["name"], r["cve_id"], r["command"]) for r in dependencies.cve_commands(deps).collect()}
    assert got == {("semver", "CVE-2022-25883", "cargo update -p semver --precise 7.5.2"), ("Requests", "CVE-2023-32681", "")}

"""Named queries over the driver's tables (through the repository views), each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions import rule_tables as fixed
from lodeframe.functions.text import explode_lines
from lodeframe.operators import activity, complexity, dependencies, graph, history, licences, present, scans
from lodeframe.plans import report
from lodeframe.sources.views import view, with_views

#: The instant at which "the last year" ends in these tables.
AS_OF = "2001-06-01 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The same over views, before these are written out.
OVER_VIEWS: dict[str, str] = {}


def query(name: str, sql: str | None, *views: str):
    """Registers f(view, ...) under a name, with its SQL."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(*(LINES(spark, sf_dir) if v == "v_lines" else view(spark, sf_dir, v) for v in views))
        if sql is not None:
            OVER_VIEWS[name], SQL[name] = sql, with_views(sql)
        return f

    return put


def LINES(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents, as blobs, and the sample code lines."""
    return view(spark, sf_dir, "v_code_lines").unionByName(explode_lines(view(spark, sf_dir, "v_blobs")))


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(s: str) -> str:
    return "[" + ", ".join(map(text, s.split())) + "]"


YEAR = f"ts >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY"
V_LINES = """v_lines AS (SELECT path, line_no, line FROM v_code_lines UNION ALL SELECT path, CAST(unnest(range(1, len(p) + 1)) AS INT) AS line_no, regexp_replace(unnest(p), '\\r$', '') AS line
  FROM (SELECT path, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM (SELECT path, string_split(content, chr(10)) AS p FROM v_blobs)))"""
WORD_END = r"($|[^\pL\pM\pN_])"
WORD_START = r"(^|[^\pL\pM\pN_])"


def rules(table, unicode_bounds: bool = False) -> str:
    def pattern(p: str) -> str:
        return p.replace(r"\b(", WORD_START + "(").replace(r")\b", ")" + WORD_END) if unicode_bounds else p

    rows = ",\n".join(f"({n}, {text(r[0])}, {text(r[1])}, {words(r[2])}, {text(pattern(r[3]))}, {text(r[4])})" for n, r in enumerate(table))
    return f"rules(rule_no, rule, severity, endings, pattern, description) AS (VALUES {rows})"


def hits(table, where: str, unicode_bounds: bool = False) -> str:
    """CTEs up to hits: rule findings on the lines for which `where` holds."""
    return f"""WITH {V_LINES}, {rules(table, unicode_bounds)}, hits AS (SELECT l.path, l.line_no, l.line, r.* FROM v_lines l JOIN rules r
  ON len(list_filter(r.endings, lambda e: ends_with(l.path, e))) > 0 AND regexp_matches(l.line, r.pattern) AND NOT (contains(r.rule, 'yaml.load') AND contains(l.line, 'SafeLoader')) WHERE {where})"""


def outside(folders) -> str:
    return " AND ".join(f"NOT starts_with(l.path, {text(d)})" for d in folders)


NO_TESTS = "NOT contains(l.path, '_test.') AND NOT contains(l.path, '.test.') AND NOT contains(l.path, '/test/')"
CODE = rf"{outside(fixed.SKIP_CODE)} AND {NO_TESTS} AND NOT contains(l.path, '/tests/') AND NOT regexp_matches(l.line, '^\s*(//|#|/\*|\*)')"
NEWEST = "SELECT oid, ts, message, author FROM v_commits {where} ORDER BY ts DESC, oid LIMIT {n}"
SHORT = "CASE WHEN strlen({m}) > {n} THEN substr({m}, 1, {n} - 1) || '…' ELSE {m} END"


# Activity

query("repo_overview", "SELECT c.*, r.*, CAST(date_sub('day', c.first_commit, c.last_commit) AS BIGINT) AS active_days FROM (SELECT count(*) AS total_commits, min(ts) AS first_commit, max(ts) AS last_commit FROM v_commits) c, (SELECT count(*) FILTER (kind = 'branch') AS branches, count(*) FILTER (kind = 'tag') AS tags FROM v_refs) r", "v_commits", "v_refs")(activity.repo_overview)
query("commit_velocity", f"SELECT count(*) AS commits, count(*) / 365.0::DOUBLE AS per_day, count(*) / 365.0::DOUBLE * 7 AS per_week FROM v_commits WHERE {YEAR}", "v_commits")(lambda c: activity.commit_velocity(c, AS_OF))
query("top_contributors", "SELECT author, count(*) AS commits FROM v_commits WHERE parent_count <= 1 GROUP BY author ORDER BY commits DESC, author LIMIT 20", "v_commits")(activity.top_contributors)
query("commits_by_month", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS commits FROM v_commits GROUP BY 1 ORDER BY 1 DESC LIMIT 24", "v_commits")(activity.commits_by_month)
query("commits_by_weekday", "SELECT CAST(d.i AS INT) AS day_no, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][d.i + 1] AS day, count(oid) AS commits FROM range(7) d(i) LEFT JOIN v_commits ON isodow(ts) - 1 = d.i GROUP BY d.i", "v_commits")(activity.commits_by_weekday)
query("commits_by_hour", "SELECT CAST(h.i AS INT) AS hour, count(oid) AS commits FROM range(24) h(i) LEFT JOIN v_commits ON hour(ts + tz_offset_min * INTERVAL '1' MINUTE) = h.i GROUP BY h.i", "v_commits")(activity.commits_by_hour)
query("emergency_commits", f"SELECT substr(oid, 1, 7) AS hash, strftime(ts, '%Y-%m-%d') AS day, {SHORT.format(m='message', n=60)} AS message FROM v_commits WHERE {YEAR} AND regexp_matches(message, {text(fixed.EMERGENCY_MESSAGE)})", "v_commits")(lambda c: activity.emergency_commits(c, AS_OF))
query("merges_by_month", f"SELECT strftime(ts, '%Y-%m') AS month, count(*) AS merges FROM v_commits WHERE {YEAR} AND parent_count > 1 GROUP BY 1", "v_commits")(lambda c: activity.merges_by_month(c, AS_OF))
query("largest_files", "SELECT path, size FROM v_blobs ORDER BY size DESC, path LIMIT 20", "v_blobs")(activity.largest_files)
query("most_changed_files", f"SELECT path, count(*) AS changes FROM v_file_changes JOIN v_commits USING (oid) WHERE {YEAR} GROUP BY path ORDER BY changes DESC, path LIMIT 20", "v_commits", "v_file_changes")(lambda c, f: activity.most_changed_files(c, f, AS_OF))
query("bug_fix_files", f"SELECT path, count(*) AS fixes FROM v_file_changes JOIN v_commits USING (oid) WHERE regexp_matches(message, {text(fixed.FIX_MESSAGE)}) GROUP BY path ORDER BY fixes DESC, path LIMIT 20", "v_commits", "v_file_changes")(activity.bug_fix_files)
query("code_churn", f"WITH recent AS ({NEWEST.format(where='', n=500)}) SELECT path, count(*) AS changes FROM v_file_changes JOIN recent USING (oid) GROUP BY path ORDER BY changes DESC, path LIMIT 20", "v_commits", "v_file_changes")(activity.code_churn)
query("lines_per_author", f"WITH recent AS ({NEWEST.format(where=f'WHERE {YEAR} AND parent_count <= 1', n=1000)}) SELECT author, CAST(sum(insertions) AS BIGINT) AS added, CAST(sum(deletions) AS BIGINT) AS removed FROM v_file_changes JOIN recent USING (oid) GROUP BY author ORDER BY added + removed DESC, author LIMIT 20", "v_commits", "v_file_changes")(lambda c, f: activity.lines_per_author(c, f, AS_OF))
query("stale_files", f"WITH recent AS ({NEWEST.format(where='', n=1000)}) SELECT path, max(ts) AS last_change FROM v_file_changes JOIN recent USING (oid) GROUP BY path ORDER BY last_change, path LIMIT 20", "v_commits", "v_file_changes")(activity.stale_files)
query("commit_log", "SELECT substr(oid, 1, 7) AS hash, message, author FROM v_commits ORDER BY ts DESC, oid LIMIT 10", "v_commits")(activity.commit_log)

# Security

query("secrets", hits(fixed.SECRETS, outside(fixed.SKIP_SECRETS) + " AND NOT regexp_matches(lower(l.line), 'test|mock|fixture|example')") + " SELECT path, line_no, rule AS pattern FROM hits", "v_lines")(scans.secrets)
query("dangerous_patterns", hits(fixed.DANGEROUS, f"{outside(fixed.SKIP_DANGEROUS)} AND {NO_TESTS}", True) + " SELECT path, line_no, rule AS pattern FROM hits", "v_lines")(scans.dangerous_patterns)
query("sensitive_files", "SELECT path FROM (SELECT path FROM v_blobs UNION ALL SELECT DISTINCT path FROM v_file_changes UNION ALL SELECT path FROM v_paths) l WHERE " + f"{outside(fixed.SKIP_SENSITIVE)} AND regexp_matches(path, {text(fixed.SENSITIVE_PATH)})", "v_blobs", "v_file_changes", "v_paths")(
    lambda b, f, p: scans.sensitive_files(b.select("path").unionByName(f.select("path").distinct()).unionByName(p))
)
query("sensitive_commits", f"WITH recent AS ({NEWEST.format(where='', n=500)}) SELECT substr(oid, 1, 7) AS hash, {SHORT.format(m='message', n=50)} AS message, string_agg(path, ', ' ORDER BY pos, path) AS paths FROM v_file_changes JOIN recent USING (oid) WHERE regexp_matches(path, {text(fixed.SENSITIVE_CHANGE)}) GROUP BY oid, ts, message ORDER BY ts DESC, oid LIMIT 20", "v_commits", "v_file_changes")(scans.sensitive_commits)
query("secret_commits", f"SELECT substr(oid, 1, 7) AS hash, {SHORT.format(m='message', n=70)} AS message FROM v_commits WHERE regexp_matches(message, {text(fixed.SECRET_MESSAGE)}) ORDER BY ts DESC, oid LIMIT 20", "v_commits")(scans.secret_commits)
query("hardcoded_ips", f"""WITH {V_LINES}, found AS (SELECT l.path, l.line_no, regexp_extract_all(l.line, {text(fixed.ADDRESS)}) AS ips FROM v_lines l WHERE {outside(fixed.SKIP_DANGEROUS)}
  AND len(list_filter({words(fixed.ADDRESS_FILES)}, lambda e: ends_with(l.path, e))) > 0 AND NOT (contains(l.line, 'example') OR contains(l.line, 'test') OR (contains(l.line, '//') AND contains(l.line, 'localhost'))))
  SELECT * FROM (SELECT path, line_no, CAST(unnest(range(len(ips))) AS INT) AS nth, unnest(ips) AS ip FROM found) WHERE ip NOT IN ({', '.join(map(text, fixed.SAFE_ADDRESSES))})""", "v_lines")(scans.hardcoded_ips)
query("gitignore_coverage", f"SELECT entry, coalesce(contains(content, entry), false) AS ignored, count(*) AS files FROM v_ignores, (SELECT unnest({'[' + ', '.join(map(text, fixed.IGNORED_BY_RIGHTS)) + ']'}) AS entry) GROUP BY 1, 2", "v_ignores")(
    lambda f: scans.gitignore_coverage(f).groupBy("entry", "ignored").agg(F.count("*").alias("files"))
)

# Static analysis

query("sast_report", hits(fixed.SAST, CODE) + " SELECT path, line_no, rule, severity, description FROM hits", "v_lines")(scans.sast_report)
query("sast_by_severity", hits(fixed.SAST, CODE) + " SELECT severity, count(*) AS findings FROM hits GROUP BY severity", "v_lines")(scans.sast_by_severity)
query("sast_top", hits(fixed.SAST, CODE) + " SELECT severity, CAST(nth AS INT) AS nth, path, line_no, rule FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY path, line_no, rule_no) AS nth FROM hits) WHERE nth <= 20", "v_lines")(scans.sast_top)
REMEDY = ", ".join(f"({n}, {text(p.lower())}, {text(g)}, {text(e)})" for n, (p, g, e) in enumerate(fixed.REMEDIATIONS))
query("sast_remediation", hits(fixed.SAST_REMEDIATION, CODE) + f""", remedies(ord, part, guidance, example) AS (VALUES {REMEDY}),
  best AS (SELECT rule, min_by(guidance, ord) AS guidance, min_by(example, ord) AS example FROM rules JOIN remedies ON contains(lower(rule), part) GROUP BY rule)
  SELECT path, line_no, h.rule, severity, CASE WHEN strlen(trim(line)) > 80 THEN substr(trim(line), 1, 77) || '...' ELSE trim(line) END AS code, coalesce(b.guidance, description) AS guidance, b.example FROM hits h LEFT JOIN best b ON h.rule = b.rule""", "v_lines")(scans.sast_remediation)
query("sast_snapshot", hits(fixed.SAST_SNAPSHOT, outside(fixed.SKIP_CODE)) + " SELECT count(*) FILTER (severity = 'HIGH') AS sast_high, count(*) FILTER (severity = 'MEDIUM') AS sast_medium, count(*) FILTER (severity = 'INFO') AS sast_info FROM hits", "v_lines")(scans.sast_snapshot)
query("snapshot_secrets", f"WITH {V_LINES} SELECT count(*) AS secrets_found FROM v_lines l WHERE {outside(fixed.SKIP_CODE)} AND regexp_matches(line, {text(fixed.SNAPSHOT_SECRET)})", "v_lines")(scans.snapshot_secrets)

# Licences

CATEGORY = "CASE " + " ".join(f"WHEN upper({{x}}) IN ({', '.join(map(text, ids.split()))}) THEN {text(c)}" for c, ids in fixed.LICENCE_CATEGORIES.items()) + " ELSE 'unknown' END"
NORMAL = "CASE upper({x}) " + " ".join(f"WHEN {text(a)} THEN {text(b)}" for a, b in fixed.LICENCE_SPELLINGS) + " ELSE {x} END"
SIGNS = " ".join("WHEN " + " AND ".join([f"contains(t, {text(p)})" for p in req] + [f"NOT contains(t, {text(p)})" for p in bar]) + f" THEN {text(spdx + '|high')}" for spdx, req, bar in fixed.LICENCE_PHRASES)
HINTS = " ".join(f"WHEN contains(t, {text(w)}) THEN {text(spdx + '|medium')}" for w, spdx in fixed.LICENCE_HINTS)
query("license_detect", f"WITH x AS (SELECT path, string_split(CASE {SIGNS} {HINTS} ELSE 'Unknown|low' END, '|') AS a FROM (SELECT path, lower(content) AS t FROM v_blobs)) SELECT path, a[1] AS licence, a[2] AS confidence, {CATEGORY.format(x='a[1]')} AS category FROM x", "v_blobs")(licences.licence_detect)
query("license_category", f"SELECT doc_id, licence, {CATEGORY.format(x='licence')} AS category FROM v_spellings", "v_spellings")(lambda m: m.withColumn("category", licences.category(F.col("licence"))))
query("license_normalize", f"SELECT doc_id, {NORMAL.format(x='licence')} AS licence FROM v_spellings", "v_spellings")(lambda m: m.select("doc_id", licences.normalized(F.col("licence")).alias("licence")))
PARTS = "list_transform(regexp_split_to_array(licence, {by}), lambda y: {normal})".format
OF = CATEGORY.format(x="y")
COMPLIANCE = f"""SELECT path, licence, CASE WHEN licence IS NOT NULL THEN {CATEGORY.format(x='licence')} END AS category,
  coalesce(array_to_string(list_filter({PARTS(by="' OR |/| AND '", normal=NORMAL.format(x='y'))}, lambda y: starts_with({OF}, 'copyleft')), ', '), '') AS copyleft,
  coalesce(len(list_filter({PARTS(by="' OR |/'", normal=NORMAL.format(x='y'))}, lambda y: {OF} <> 'permissive')) = 0, false) AS permissive,
  licence IS NULL AND (ends_with(path, 'Cargo.toml') OR ends_with(path, 'package.json')) AS missing, n_deps FROM v_manifests"""
query("license_compliance", COMPLIANCE, "v_manifests")(licences.compliance)
query("license_summary", f"SELECT count(*) AS manifests, CAST(sum(n_deps) AS BIGINT) AS dependencies, count(*) FILTER (copyleft <> '') AS with_copyleft, bool_or(permissive) AS project_permissive, count(*) FILTER (missing) AS missing FROM ({COMPLIANCE})", "v_manifests")(licences.compliance_summary)

# Dependencies

query("sca_summary", "SELECT source, count(*) AS dependencies FROM v_deps GROUP BY source", "v_deps")(dependencies.by_source)
query("sca_listed", "SELECT name, version, source, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY name, version) AS nth FROM v_deps) WHERE nth <= 30", "v_deps")(dependencies.listed)
query("sca_unpinned", "SELECT * FROM v_deps WHERE version = 'unpinned' OR starts_with(version, '>=') OR starts_with(version, '~=')", "v_deps")(dependencies.unpinned)
query("sca_prerelease", "SELECT * FROM v_deps WHERE starts_with(version, '0.') OR regexp_matches(version, '-alpha|-beta|-rc|-dev')", "v_deps")(dependencies.prerelease)
NUMBERS = "list_transform(list_filter(list_transform(string_split(regexp_replace({x}, '^v+', ''), '.'), lambda p: regexp_extract(p, '^[0-9]+')), lambda d: d <> ''), lambda d: CAST(d AS BIGINT))"
PAD = "list_concat({x}, list_resize(CAST([] AS BIGINT[]), 12 - len({x}), CAST(0 AS BIGINT)))"
ADVISORIES = ", ".join("(" + ", ".join(map(text, a)) + ")" for a in fixed.ADVISORIES)
MATCHES = f"""WITH known(package, ecosystem, affected_below, fixed_version, cve_id, severity, summary) AS (VALUES {ADVISORIES}),
  pairs AS (SELECT d.*, k.*, {NUMBERS.format(x='version')} AS a, {NUMBERS.format(x='affected_below')} AS b FROM v_deps d JOIN known k ON lower(name) = lower(package)),
  found AS (SELECT * FROM pairs WHERE {PAD.format(x='a')} < {PAD.format(x='b')})"""
query("cve_matches", MATCHES + " SELECT name, version, source, cve_id, severity, fixed_version, summary FROM found", "v_deps")(dependencies.cve_matches)
query("cve_commands", MATCHES + """ SELECT name, version, source, cve_id, CASE source WHEN 'Cargo.lock' THEN 'cargo update -p ' || name || ' --precise ' || fixed_version WHEN 'package-lock.json' THEN 'npm install ' || name || '@' || fixed_version
  WHEN 'go.sum' THEN 'go get ' || name || '@v' || fixed_version WHEN 'requirements.txt' THEN 'pip install ' || name || '==' || fixed_version ELSE '' END AS command FROM found""", "v_deps")(dependencies.cve_commands)


def values(columns: str, *rows: tuple) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join('NULL' if x is None else str(x) if isinstance(x, int) else text(x) for x in r) + ')' for r in rows)}) AS t({columns})"


def made(folder: str, columns: dict[str, str]) -> str:
    """What the generated files of a folder hold, row by row, told from the id that they were made of."""
    of = lambda e: e.replace("{d}", "CAST(doc_id AS STRING)")
    return "SELECT " + ", ".join(f"{of(e)} AS {c}" for c, e in columns.items()) + " FROM documents"


def mod(n: int) -> str:
    return f"CAST(doc_id % {n} AS STRING)"


def parsed(fixture: str, *generated: dict[str, str]) -> str:
    return " UNION ALL ".join([fixture, *(made("", g) for g in generated)])


CARGO, NPM, GO, REQS = ({"path": f"'{f}' || {{d}} || '/{n}'"} for f, n in (("c", "Cargo.lock"), ("n", "package-lock.json"), ("g", "go.sum"), ("r", "requirements.txt")))
query("parse_cargo_lock", parsed(values("path, name, version", ("Cargo.lock", "app", "0.1.0"), ("Cargo.lock", "serde", "1.0.1"), ("Cargo.lock", "regex", "1.5.4")),
    CARGO | {"name": "'app' || {d}", "version": f"'0.' || {mod(9)} || '.1'"}, CARGO | {"name": f"'lib' || {mod(3)}", "version": f"'1.' || {mod(5)} || '.0'"}), "v_many_files")(dependencies.cargo_lock)
query("parse_cargo_edges", parsed(values("path, src, dst", ("Cargo.lock", "app", "serde"), ("Cargo.lock", "app", "regex"), ("Cargo.lock", "regex", "app")), CARGO | {"src": "'app' || {d}", "dst": f"'lib' || {mod(3)}"}), "v_many_files")(dependencies.cargo_edges)
query("parse_npm_lock", parsed(values("path, name, version", ("web/package-lock.json", "a", "1.0.0"), ("web/package-lock.json", "@s/b", "unknown"), ("old/package-lock.json", "a", "1"), ("old/package-lock.json", "b", "2")),
    NPM | {"name": f"'a' || {mod(6)}", "version": f"{mod(8)} || '.2.0'"}, NPM | {"name": "'b'", "version": f"'1.' || {mod(4)} || '.0'"}), "v_many_files")(dependencies.npm_lock)
query("parse_go_sum", parsed(values("path, name, version", ("go.sum", "a/b", "v1.0.0"), ("go.sum", "c", "v2.0.0")), GO | {"name": f"'m/x' || {mod(5)}", "version": f"'v1.' || {mod(7)} || '.0'"}, GO | {"name": "'m/y'", "version": f"'v0.' || {mod(3)} || '.0'"}), "v_many_files")(dependencies.go_sum)
ALL_REQS = [REQS | {"name": f"'pkg' || {mod(9)}", "version": f"{mod(6)} || '.1'"}, REQS | {"name": "'other'", "version": f"'>=' || {mod(4)}"}, REQS | {"name": f"'bare' || {mod(2)}", "version": "'unpinned'"}]
query("parse_requirements", parsed(values("path, name, version", ("requirements.txt", "x", "1.0"), ("requirements.txt", "y", ">=2"), ("requirements.txt", "z", "~=3"), ("requirements.txt", "w", "unpinned")), *ALL_REQS, REQS | {"name": "'third'", "version": "'~=2'"}), "v_many_files")(dependencies.requirements)
query("parse_requirements_short", parsed(values("path, name, version", ("requirements.txt", "x", "1.0"), ("requirements.txt", "y", ">=2"), ("requirements.txt", "z~=3", "unpinned"), ("requirements.txt", "w", "unpinned")), *ALL_REQS, REQS | {"name": "'third~=2'", "version": "'unpinned'"}), "v_many_files")(
    lambda f: dependencies.requirements(f, ("==", ">="))
)
MODS = {"path": "'g' || {d} || '/go.mod'"}
query("parse_go_mod", parsed(values("path, name", ("go.mod", "a/b"), ("go.mod", "c"), ("go.mod", "d")), MODS | {"name": f"'m/x' || {mod(5)}"}, MODS | {"name": "'m/y'"}, MODS | {"name": f"'solo' || {mod(3)}"}), "v_many_files")(dependencies.go_mod)
query("parse_go_mod_direct", parsed(values("path, name", ("go.mod", "a/b"), ("go.mod", "d")), MODS | {"name": f"'m/x' || {mod(5)}"}, MODS | {"name": f"'solo' || {mod(3)}"}), "v_many_files")(lambda f: dependencies.go_mod(f, True))
query("parse_manifests", parsed(values("path, licence, deps", ("Cargo.toml", "MIT", "quick,serde"), ("web/package.json", "GPL-2.0-only", "a,z"), ("go.mod", None, "a/b,c,d")),
    {"path": "'c' || {d} || '/Cargo.toml'", "licence": "CASE doc_id % 3 WHEN 0 THEN 'MIT' WHEN 1 THEN 'GPL-2.0-only' ELSE 'BSD-3-Clause' END", "deps": f"'lib' || {mod(3)}"}, {"path": "'n' || {d} || '/package.json'", "licence": "'Apache-2.0'", "deps": f"'a' || {mod(6)} || ',d'"},
    MODS | {"licence": "NULL", "deps": f"'m/x' || {mod(5)} || ',m/y,solo' || {mod(3)}"}), "v_many_files")(lambda f: dependencies.manifests(f).withColumn("deps", F.array_join(F.array_sort("deps"), ",")))
query("sca_snapshot", "SELECT CAST(4 + 1 + 3 + 2 + count(*) * (5 + 2 + 2) AS BIGINT) AS sca_total, CAST(4 + count(*) * 4 AS BIGINT) AS sca_unpinned FROM documents", "v_many_files")(dependencies.snapshot_counts)

# Graph

query("dep_degree", "SELECT (SELECT count(*) FROM v_nodes) AS packages, (SELECT count(*) FROM v_dep_edges) AS edges, (SELECT count(*) FROM v_direct_deps) AS direct", "v_nodes", "v_dep_edges", "v_direct_deps")(graph.degrees)
REACH = """WITH RECURSIVE known AS (SELECT name FROM v_direct_deps WHERE name IN (SELECT name FROM v_nodes)),
  seeds AS (SELECT name FROM known UNION SELECT name FROM v_nodes WHERE (SELECT count(*) FROM known) = 0 AND name NOT IN (SELECT dst FROM v_dep_edges)),
  reach AS (SELECT name FROM seeds UNION SELECT dst FROM reach JOIN v_dep_edges ON src = name)"""
query("dep_reachable", REACH + " SELECT name FROM reach", "v_nodes", "v_dep_edges", "v_direct_deps")(graph.reachable)
query("dep_unreachable", REACH + " SELECT name FROM v_nodes WHERE name NOT IN (SELECT name FROM reach)", "v_nodes", "v_dep_edges", "v_direct_deps")(graph.unreachable)
query("dep_cycles", """WITH RECURSIVE paths AS (SELECT src, dst FROM v_dep_edges WHERE src <> dst UNION SELECT p.src, e.dst FROM paths p JOIN v_dep_edges e ON p.dst = e.src WHERE e.src <> e.dst),
  mutual AS (SELECT a.src AS name, a.dst AS other FROM paths a JOIN paths b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst)
  SELECT least(name, min(other)) AS component, name FROM mutual GROUP BY name""", "v_dep_edges")(graph.cycles)
GRAPHS = """RECURSIVE seeds AS (SELECT graph_id, name FROM v_graph_direct WHERE (graph_id, name) IN (SELECT graph_id, name FROM v_graph_nodes)
    UNION SELECT graph_id, name FROM v_graph_nodes n WHERE NOT EXISTS (SELECT 1 FROM v_graph_direct d JOIN v_graph_nodes m USING (graph_id, name) WHERE graph_id = n.graph_id) AND (graph_id, name) NOT IN (SELECT graph_id, dst FROM v_graph_edges)),
  reach AS (SELECT graph_id, name FROM seeds UNION SELECT r.graph_id, dst FROM reach r JOIN v_graph_edges e ON e.src = r.name AND e.graph_id = r.graph_id),
  paths AS (SELECT graph_id, src, dst FROM v_graph_edges WHERE src <> dst UNION SELECT p.graph_id, p.src, e.dst FROM paths p JOIN v_graph_edges e ON p.dst = e.src AND p.graph_id = e.graph_id WHERE e.src <> e.dst),
  mutual AS (SELECT a.graph_id, a.src AS name, a.dst AS other FROM paths a JOIN paths b ON a.src = b.dst AND a.dst = b.src AND a.graph_id = b.graph_id WHERE a.src <> a.dst),
  loops AS (SELECT graph_id, least(name, min(other)) AS component, name FROM mutual GROUP BY graph_id, name),
  lost AS (SELECT DISTINCT graph_id, name FROM v_graph_nodes WHERE (graph_id, name) NOT IN (SELECT graph_id, name FROM reach)),
  """
query(
    "dep_graphs",
    f"""WITH {GRAPHS} n AS (SELECT graph_id, count(DISTINCT name) AS packages FROM v_graph_nodes GROUP BY graph_id), e AS (SELECT graph_id, count(*) AS edges FROM v_graph_edges GROUP BY graph_id), d AS (SELECT graph_id, count(DISTINCT name) AS direct FROM v_graph_direct GROUP BY graph_id),
  l AS (SELECT graph_id, count(DISTINCT component) AS cycles, count(*) AS on_cycle FROM loops GROUP BY graph_id), r AS (SELECT graph_id, count(*) AS reachable FROM reach GROUP BY graph_id), u AS (SELECT graph_id, count(*) AS unreachable FROM lost GROUP BY graph_id)
  SELECT graph_id, packages, coalesce(edges, 0) AS edges, coalesce(direct, 0) AS direct, coalesce(cycles, 0) AS cycles, coalesce(on_cycle, 0) AS on_cycle, coalesce(reachable, 0) AS reachable, coalesce(unreachable, 0) AS unreachable
  FROM n LEFT JOIN e USING (graph_id) LEFT JOIN d USING (graph_id) LEFT JOIN l USING (graph_id) LEFT JOIN r USING (graph_id) LEFT JOIN u USING (graph_id)""",
    "v_graph_nodes",
    "v_graph_edges",
    "v_graph_direct",
)(graph.graph_summary)
query("dep_graph_cycles", f"WITH {GRAPHS} z AS (SELECT 1) SELECT graph_id, component, name FROM loops", "v_graph_edges")(graph.cycles)
query("dep_graph_unreachable", f"WITH {GRAPHS} z AS (SELECT 1) SELECT graph_id, name FROM lost", "v_graph_nodes", "v_graph_edges", "v_graph_direct")(graph.unreachable)
query("phantom_deps", """WITH i AS (SELECT DISTINCT lower(name) AS imp, lower(replace(name, '-', '_')) AS plain FROM v_imports)
  SELECT DISTINCT name FROM v_direct_deps d WHERE NOT EXISTS (SELECT 1 FROM i WHERE imp = lower(d.name) OR plain = lower(replace(d.name, '-', '_')) OR contains(imp, lower(d.name)) OR contains(lower(d.name), imp))""", "v_direct_deps", "v_imports")(graph.phantoms)
query("imports", "SELECT DISTINCT name FROM (SELECT 'os' AS name, min(doc_id) AS d FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT DISTINCT 'pkg_' || CAST(doc_id % 7 AS STRING), 1 FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT unnest(['@scope/a', 'a', 'b', '@scope/a/b']), min(doc_id) FROM documents WHERE doc_id % 3 = 2) WHERE d IS NOT NULL", "v_sources")(graph.imports)

# Complexity

#: The functions of the generated sources, told from the ids that they were made of; by_words is what the hints' way of
#: counting gives.
FUNCTIONS = """functions AS (SELECT path, doc_id, unnest(CASE doc_id % 3
    WHEN 0 THEN [{'name': 'f', 'line': 1, 'complexity': 1 + 2 * (1 + doc_id % 9), 'by_words': 2 + doc_id % 9}, {'name': 'g', 'line': 4 + doc_id % 9, 'complexity': 1, 'by_words': 1}]
    WHEN 1 THEN [{'name': 'p', 'line': 3, 'complexity': 1 + 3 * (1 + doc_id % 12), 'by_words': 2 + doc_id % 12}, {'name': 'q', 'line': 6 + 2 * (doc_id % 12), 'complexity': 1, 'by_words': 1}]
    ELSE [{'name': 'h', 'line': 2, 'complexity': 1 + 3 * (1 + doc_id % 6), 'by_words': 1}] END, recursive := true)
  FROM (SELECT doc_id, 'src/m_' || CAST(doc_id AS STRING) || CASE doc_id % 3 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' ELSE '.ts' END AS path FROM documents))"""
ONE = "path, name, CAST(line AS INT) AS line, CAST(complexity AS INT) AS complexity"
query("complexity_functions", f"WITH {FUNCTIONS} SELECT {ONE} FROM functions", "v_sources")(complexity.complexity_functions)
query("complexity_top", f"WITH {FUNCTIONS} SELECT {ONE} FROM functions ORDER BY complexity DESC, path, line LIMIT 20", "v_sources")(complexity.complexity_top)
query("complexity_summary", f"WITH {FUNCTIONS} SELECT count(*) AS functions, avg(complexity) AS average, count(*) FILTER (complexity > 10) AS above FROM functions", "v_sources")(complexity.complexity_summary)
query("complexity_by_language", f"WITH {FUNCTIONS} SELECT language, count(DISTINCT path) AS files, count(*) AS functions FROM (SELECT path, regexp_extract(path, '[.][a-z]+$') AS language FROM functions) GROUP BY language", "v_sources")(complexity.complexity_by_language)
query("complexity_hints", f"WITH {FUNCTIONS} SELECT path, name, CAST(line AS INT) AS line, CAST(by_words AS INT) AS complexity, {text(fixed.HINTS_BY_VALUE[2][1] + '; ' + dict(fixed.HINTS_BY_FILE)['.py'])} AS hint FROM functions WHERE by_words > 10", "v_sources")(complexity.complexity_hints)
query("complexity_snapshot", f"WITH {FUNCTIONS} SELECT avg(complexity) AS complexity_avg, count(*) FILTER (complexity > 10) AS complexity_above FROM functions WHERE ends_with(path, '.rs')", "v_sources")(complexity.complexity_snapshot)

# History and presentation


@query(
    "trend_direction",
    """WITH e AS (SELECT min_by(v_history, day) AS a, max_by(v_history, day) AS b FROM v_history), r(label, first, last) AS (SELECT 'SAST HIGH findings', a.sast_high, b.sast_high FROM e UNION ALL SELECT 'Avg complexity', CAST(floor(a.complexity_avg * 10) AS BIGINT), CAST(floor(b.complexity_avg * 10) AS BIGINT) FROM e
  UNION ALL SELECT 'CVE count', a.sca_cve_count, b.sca_cve_count FROM e UNION ALL SELECT 'Secrets found', a.secrets_found, b.secrets_found FROM e) SELECT label, first, last, CASE WHEN last < first THEN '↓' WHEN last > first THEN '↑' ELSE '→' END AS direction FROM r""",
    "v_history",
)
def trend_direction(h: DataFrame) -> DataFrame:
    metrics = {"SAST HIGH findings": F.col("sast_high"), "Avg complexity": F.floor(F.col("complexity_avg") * 10), "CVE count": F.col("sca_cve_count"), "Secrets found": F.col("secrets_found")}
    return history.trend_direction(h, "day", metrics)


query("history_deltas", "SELECT day, secrets_found, secrets_found - lag(secrets_found) OVER (ORDER BY day) AS change FROM v_history", "v_history")(lambda h: history.deltas(h, "day", "secrets_found"))
BY_MONTH = "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS commits FROM v_commits GROUP BY 1"
query("bar_widths", f"SELECT month, commits, CAST(floor(commits / greatest(1, max(commits) OVER ())::DOUBLE * 40) AS BIGINT) AS width FROM ({BY_MONTH})", "v_commits")(lambda c: present.bar_widths(activity.commits_by_month(c, 10_000), "commits"))
query("sparkline_levels", f"SELECT month, commits, CAST(least(7, floor(commits / greatest(1, max(commits) OVER ())::DOUBLE * 7)) AS BIGINT) AS level FROM ({BY_MONTH})", "v_commits")(lambda c: present.sparkline_levels(activity.commits_by_month(c, 10_000), "commits"))
query("overall_status", "SELECT source, CASE WHEN sast_high > 0 OR secrets_found > 0 THEN 'CRITICAL' WHEN sast_medium > 0 OR sca_unpinned > 5 THEN 'WARNING' ELSE 'PASS' END AS status FROM v_status", "v_status")(
    lambda h: h.select("source", present.overall_status(*map(F.col, ("sast_high", "secrets_found", "sast_medium", "sca_unpinned"))).alias("status"))
)


# A whole report. Its SQL is put together from that of its sections.


def as_text(column: str) -> str:
    return f"coalesce(CAST({column} AS VARCHAR), '')"


def stats_sql(no: int, section: str, sql: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {no} AS seq, {text(section)} AS section, 'stat' AS kind, {text(c)} AS label, {e} AS value, NULL AS cells FROM ({sql})" for c, e in columns.items())


def bars_sql(no: int, section: str, sql: str, label: str, value: str) -> str:
    return f"SELECT {no} AS seq, {text(section)} AS section, 'bar' AS kind, CAST({label} AS VARCHAR) AS label, CAST({value} AS VARCHAR) AS value, CAST(CAST(floor({value} / greatest(1, max({value}) OVER ())::DOUBLE * 40) AS BIGINT) AS VARCHAR) AS cells FROM ({sql})"


def rows_sql(no: int, section: str, sql: str, order: str, cells: str, shown: int = 20) -> str:
    shown_cells = "[" + ", ".join(c.strip() if "(" in c else as_text(c.strip()) for c in cells.split(";")) + "]"
    return f"""SELECT {no} AS seq, {text(section)} AS section, 'stat' AS kind, 'Total' AS label, CAST(count(*) AS VARCHAR) AS value, NULL AS cells FROM ({sql})
  UNION ALL SELECT {no + 1}, {text(section)}, 'row', NULL, NULL, array_to_string({shown_cells}, ' | ') FROM (SELECT *, row_number() OVER (ORDER BY {order}, {shown_cells}) AS nth_row FROM ({sql})) WHERE nth_row <= {shown}"""


HUNDREDTHS = "CAST(CAST(floor(floor({x} * 100) / 100) AS BIGINT) AS VARCHAR) || '.' || lpad(CAST(CAST(floor({x} * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0')"
SECOND = "strftime({x}, '%Y-%m-%d %H:%M:%S')"


def report_sql() -> str:
    of = OVER_VIEWS.__getitem__
    sast = hits(fixed.SAST, CODE)
    size = "CASE WHEN size > 1048576 THEN printf('%.1f MB', size / 1048576.0) WHEN size > 1024 THEN printf('%.1f KB', size / 1024.0) ELSE printf('%d B', size) END"
    parts = [
        stats_sql(10, "Overview", of("repo_overview"), {c: as_text(c) for c in ("total_commits", "branches", "tags", "active_days")} | {c: SECOND.format(x=c) for c in ("first_commit", "last_commit")}),
        stats_sql(50, "Velocity", of("commit_velocity"), {"commits": as_text("commits"), "per_day": HUNDREDTHS.format(x="per_day"), "per_week": HUNDREDTHS.format(x="per_week")}),
        bars_sql(100, "Top contributors", of("top_contributors"), "author", "commits"),
        bars_sql(200, "Commits by month", of("commits_by_month"), "month", "commits"),
        bars_sql(300, "Activity by weekday", of("commits_by_weekday"), "day", "commits"),
        bars_sql(400, "Activity by hour", of("commits_by_hour"), "lpad(CAST(hour AS VARCHAR), 2, '0')", "commits"),
        bars_sql(600, "Merges by month", of("merges_by_month"), "month", "merges"),
        rows_sql(500, "Emergency commits", of("emergency_commits"), "day, hash", "hash; day; message"),
        rows_sql(700, "Largest files", of("largest_files"), "path", f"path; {size}"),
        rows_sql(750, "Most changed files", of("most_changed_files"), "path", "path; changes"),
        rows_sql(760, "Files of fixes", of("bug_fix_files"), "path", "path; fixes"),
        rows_sql(770, "Churn", of("code_churn"), "path", "path; changes"),
        rows_sql(780, "Lines by author", of("lines_per_author"), "author", "author; added; removed"),
        rows_sql(790, "Stale files", of("stale_files"), "last_change, path", f"path; {SECOND.format(x='last_change')}"),
        rows_sql(1000, "Secrets", of("secrets"), "path, line_no, pattern", "path; line_no; pattern", 30),
        rows_sql(1100, "Dangerous patterns", of("dangerous_patterns"), "path, line_no, pattern", "path; line_no; pattern", 30),
        rows_sql(1150, "Sensitive files", f"SELECT path FROM v_blobs l WHERE {outside(fixed.SKIP_SENSITIVE)} AND regexp_matches(path, {text(fixed.SENSITIVE_PATH)})", "path", "path"),
        rows_sql(1200, "Hardcoded addresses", of("hardcoded_ips"), "path, line_no, nth", "path; line_no; nth; ip"),
        rows_sql(1300, "Commits about secrets", of("secret_commits"), "hash", "hash; message"),
        rows_sql(1350, "Commits on sensitive files", of("sensitive_commits"), "hash", "hash; message; paths"),
        rows_sql(1400, "Ignored files", "SELECT entry, contains(content, entry) AS ignored FROM (SELECT content FROM v_files WHERE path = '.gitignore'), (SELECT unnest([" + ", ".join(map(text, fixed.IGNORED_BY_RIGHTS)) + "]) AS entry)", "entry", "entry; ignored"),
        rows_sql(2000, "Licences", of("license_compliance"), "path", "path; licence; category; copyleft; permissive; missing; n_deps"),
        rows_sql(2050, "Licence files", of("license_detect") + " WHERE false", "path", "path; licence; confidence; category"),
        stats_sql(2060, "Complexity", of("complexity_summary"), {"functions": as_text("functions"), "average": HUNDREDTHS.format(x="average"), "above": as_text("above")}),
        rows_sql(2070, "Complex functions", of("complexity_top"), "path, line", "path; name; line; complexity"),
        f"SELECT 2100 AS seq, 'Static analysis' AS section, 'stat' AS kind, severity AS label, CAST(findings AS VARCHAR) AS value, NULL AS cells FROM ({of('sast_by_severity')})",
        *(rows_sql(2110 + 10 * i, f"Static analysis: {s}", f"{sast} SELECT path, line_no, rule, rule_no FROM hits WHERE severity = '{s}'", "path, line_no, rule_no", "path; line_no; rule; rule_no") for i, s in enumerate(("HIGH", "MEDIUM", "INFO"))),
        rows_sql(2200, "Dependencies", of("sca_summary"), "source", "source; dependencies"),
        rows_sql(2210, "Unpinned dependencies", of("sca_unpinned"), "source, name, version", "name; version; source", 15),
        rows_sql(2220, "Prereleases", of("sca_prerelease"), "source, name, version", "name; version; source", 15),
        rows_sql(2400, "Dependency graphs", of("dep_graphs"), "graph_id", "graph_id; packages; edges; direct; cycles; on_cycle; reachable; unreachable"),
        rows_sql(2410, "Circular dependencies", f"SELECT graph_id, component, string_agg(name, ', ' ORDER BY name) AS members FROM ({of('dep_graph_cycles')}) GROUP BY graph_id, component", "graph_id, component", "graph_id; component; members", 10),
        rows_sql(2420, "Unused dependencies", of("phantom_deps").replace("DISTINCT name FROM v_direct_deps", "DISTINCT graph_id, name FROM v_graph_direct"), "graph_id, name", "graph_id; name"),
        rows_sql(2430, "Packages out of reach", of("dep_graph_unreachable"), "graph_id, name", "graph_id; name", 10),
        rows_sql(2500, "Refactoring hints", of("complexity_hints"), "path, line", "path; name; line; complexity; hint", 15),
        rows_sql(2550, "Advisories", of("cve_commands"), "name, version, source, cve_id", "name; version; source; cve_id; command"),
        rows_sql(2600, "Remediation", of("sast_remediation"), "path, line_no, rule", "path; line_no; rule; severity; code; guidance; example"),
    ]
    return "SELECT CAST(seq AS BIGINT) AS seq, section, kind, label, value, cells FROM (" + "\n UNION ALL ".join(parts) + ")"


@query("report_elements", report_sql(), "v_commits", "v_file_changes", "v_refs", "v_blobs", "v_lines", "v_sources", "v_files", "v_deps", "v_manifests", "v_graph_nodes", "v_graph_edges", "v_graph_direct", "v_imports")
def report_elements(c, f, r, b, lines, sources, files, d, m, nodes, edges, direct, imported) -> DataFrame:
    """A whole report, with cells as one text."""
    ignore = files.filter("path = '.gitignore'").select("content")
    tables = report.Tables(c, f, r, b, lines, sources, ignore, d, d, m, b, nodes, edges, direct, imported, AS_OF)
    return report.elements(tables).withColumn("cells", F.array_join("cells", " | "))

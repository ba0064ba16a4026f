"""A repository seen in driver tables: the same SQL for Spark and for the checking database."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: `{table}` stands for a table. Views may stand for each other as `{v_...}`.
VIEWS = {
    "v_commits": """SELECT md5(CAST(o_orderkey AS STRING)) AS oid, o_orderkey AS seq,
  'dev_' || CAST(o_custkey % 40 AS STRING) AS author,
  o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR AS ts,
  CAST(((o_orderkey * 7) % 27 - 12) * 60 AS INT) AS tz_offset_min,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS INT) AS parent_count,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Hotfix: rollback module '
    WHEN '2-HIGH' THEN 'Fix broken login ' WHEN '3-MEDIUM' THEN 'Rotate leaked API key '
    ELSE 'Refactor part ' END || CAST(o_orderkey AS STRING) AS message
FROM {orders}""",
    "v_file_changes": """SELECT md5(CAST(l.l_orderkey AS STRING)) AS oid, l.l_linenumber AS pos,
  CASE p.p_size % 4 WHEN 0 THEN 'src/auth/' WHEN 1 THEN 'src/' WHEN 2 THEN 'vendor/' ELSE 'docs/' END
    || replace(p.p_name, ' ', '_') || CASE p.p_size % 5 WHEN 0 THEN '.rs' WHEN 1 THEN '.go'
    WHEN 2 THEN '.py' WHEN 3 THEN '.ts' ELSE '.java' END AS path,
  CAST(floor(l.l_quantity) AS BIGINT) AS insertions,
  CAST(floor(l.l_extendedprice) AS BIGINT) % 37 AS deletions
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "v_refs": """SELECT 'branch' AS kind, r_name AS name FROM {region} UNION ALL SELECT 'tag' AS kind, n_name AS name FROM {nation}""",
    "v_blobs": """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'src/tests/' ELSE 'src/' END
  || source || '/doc_' || CAST(doc_id AS STRING) || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.ts'
  WHEN 'de' THEN '.go' ELSE '.java' END AS path, n_chars AS size, text AS content FROM {documents}""",
    "v_code_lines": """SELECT 'src/f_' || CAST(d.doc_id AS STRING) || s.ext AS path, CAST(1 + d.doc_id % 50 AS INT) AS line_no, s.line AS line FROM {documents} d JOIN (VALUES
  (0, '.py', 'cursor.execute("SELECT * FROM t WHERE id=" + uid)'),
  (1, '.py', 'data = pickle.loads(blob)'),
  (2, '.py', 'cfg = yaml.load(f, Loader=yaml.SafeLoader)'),
  (3, '.py', 'cfg = yaml.load(f)'),
  (4, '.js', 'el.innerHTML = body;'),
  (5, '.ts', 'const r = Math.random();'),
  (6, '.java', 'Random r = new Random();'),
  (7, '.rs', '    unsafe { ptr.read() }'),
  (8, '.go', '// exec.Command(input) is only a comment'),
  (9, '.php', 'eval($code);'),
  (10, '.rb', 'obj = YAML.load(s)'),
  (11, '.go', 'addr := "10.1.2.3" + ":" + "192.168.0.1"'),
  (12, '.yaml', 'password: hunter2hunter2'),
  (13, '.py', 'SECRET_KEY = "abcdef123456"'),
  (14, '.py', 'bind("127.0.0.1")  # loopback'),
  (15, '.rs', 'let x = fixture_password();')) AS s(id, ext, line) ON d.doc_id % 16 = s.id""",
    "v_deps": """SELECT CASE p_partkey % 8 WHEN 0 THEN 'lodash' WHEN 1 THEN 'Django' WHEN 2 THEN 'semver'
  WHEN 3 THEN 'hyper' WHEN 4 THEN 'golang.org/x/net' WHEN 5 THEN 'requests' ELSE 'lib_' || CAST(p_partkey AS STRING) END AS name,
  CASE WHEN p_partkey % 11 = 0 THEN 'unpinned' WHEN p_partkey % 13 = 0 THEN '>=' || CAST(p_size AS STRING) || '.31.0'
   WHEN p_partkey % 17 = 0 THEN 'v0.' || CAST(p_size AS STRING) || '.0-beta'
   ELSE CAST(p_size % 6 AS STRING) || '.' || CAST(p_partkey % 25 AS STRING) || '.' || CAST(p_size AS STRING) END AS version,
  CASE p_partkey % 4 WHEN 0 THEN 'Cargo.lock' WHEN 1 THEN 'package-lock.json' WHEN 2 THEN 'go.sum' ELSE 'requirements.txt' END AS source
FROM {part}""",
    "v_dep_edges": """SELECT 'pkg_' || CAST(s_suppkey AS STRING) AS src,
  'pkg_' || CAST((s_suppkey * s_suppkey + 7) % (SELECT count(*) FROM {supplier}) AS STRING) AS dst FROM {supplier}""",
    "v_direct_deps": """SELECT 'pkg_' || CAST(s_suppkey AS STRING) AS name FROM {supplier} WHERE s_suppkey % 40 = 0""",
    "v_nodes": """SELECT 'pkg_' || CAST(s_suppkey AS STRING) AS name FROM {supplier}""",
    "v_graph_nodes": """SELECT 'g' || CAST(s_suppkey % 3 AS STRING) AS graph_id, 'pkg_' || CAST((s_suppkey - s_suppkey % 3) AS STRING) AS name, CAST(s_suppkey % 7 AS STRING) || '.0' AS version FROM {supplier}""",
    "v_graph_edges": """SELECT 'g' || CAST(s_suppkey % 3 AS STRING) AS graph_id, 'pkg_' || CAST((s_suppkey - s_suppkey % 3) AS STRING) AS src,
  'pkg_' || CAST((s_suppkey * s_suppkey + 7) % (SELECT count(*) FROM {supplier}) - ((s_suppkey * s_suppkey + 7) % (SELECT count(*) FROM {supplier})) % 3 AS STRING) AS dst FROM {supplier}""",
    "v_graph_direct": """SELECT 'g' || CAST(s_suppkey % 3 AS STRING) AS graph_id, 'pkg_' || CAST((s_suppkey - s_suppkey % 3) AS STRING) AS name FROM {supplier} WHERE s_suppkey % 3 < 2 AND s_suppkey % 8 = 0""",
    "v_paths": """SELECT CASE doc_id % 5 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'node_modules/' ELSE 'app/' END || source || '/' || CAST(doc_id AS STRING) || CASE doc_id % 11 WHEN 0 THEN '/.env' WHEN 1 THEN '/server.KEY' WHEN 2 THEN '/env.py' WHEN 3 THEN '/.env.local'
  WHEN 4 THEN '/id.pem.txt' WHEN 5 THEN '/store.jks' WHEN 6 THEN '/AuthTokens.ts' WHEN 7 THEN '/my_credentials' WHEN 8 THEN '/keys/a.txt' WHEN 9 THEN '/x.p12' ELSE '/notes.md' END AS path FROM {documents}""",
    "v_spellings": """SELECT doc_id, CASE doc_id % 14 WHEN 0 THEN 'mit' WHEN 1 THEN 'GPL2' WHEN 2 THEN 'LGPL-3.0' WHEN 3 THEN 'WTFPL' WHEN 4 THEN 'Apache-2.0' WHEN 5 THEN 'GPL' WHEN 6 THEN 'agpl-3.0-or-later' WHEN 7 THEN 'BSD3'
  WHEN 8 THEN 'CC0' WHEN 9 THEN 'MPL-2.0' WHEN 10 THEN 'bsd-2-clause' WHEN 11 THEN 'Unlicense' WHEN 12 THEN '' ELSE 'EPL-2.0' END AS licence FROM {documents}""",
    "v_status": """SELECT source, CAST(sum(CASE WHEN doc_id % 97 = 5 THEN 1 ELSE 0 END) AS BIGINT) AS sast_high, CAST(sum(CASE WHEN doc_id % 83 = 7 THEN 1 ELSE 0 END) AS BIGINT) AS secrets_found,
  CAST(sum(CASE WHEN doc_id % 61 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS sast_medium, CAST(count(*) % 13 AS BIGINT) AS sca_unpinned FROM {documents} GROUP BY source""",
    "v_ignores": """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CASE WHEN doc_id % 2 = 0 THEN '.env' || chr(10) ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '*.key' || chr(10) ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN 'a/*.pem' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 7 = 0 THEN '*.p12' || chr(10) || '*.secret' ELSE 'x' END END AS content FROM {documents}""",
    "v_many_files": """SELECT path, content FROM {v_files} WHERE path <> '.gitignore'
  UNION ALL SELECT 'c' || CAST(doc_id AS STRING) || '/Cargo.lock', '[[package]]' || chr(10) || 'name = "app' || CAST(doc_id AS STRING) || '"' || chr(10) || 'version = "0.' || CAST(doc_id % 9 AS STRING) || '.1"' || chr(10) || 'dependencies = [' || chr(10)
    || ' "lib' || CAST(doc_id % 3 AS STRING) || ' 1.0.0 (registry)",' || chr(10) || ']' || chr(10) || chr(10) || '[[package]]' || chr(10) || 'name = "lib' || CAST(doc_id % 3 AS STRING) || '"' || chr(10) || 'version = "1.' || CAST(doc_id % 5 AS STRING) || '.0"' || chr(10) FROM {documents}
  UNION ALL SELECT 'n' || CAST(doc_id AS STRING) || '/package-lock.json', '{"packages":{"":{},"node_modules/a' || CAST(doc_id % 6 AS STRING) || '":{"version":"' || CAST(doc_id % 8 AS STRING) || '.2.0","dependencies":{"b":"1"}},"node_modules/a' || CAST(doc_id % 6 AS STRING) || '/node_modules/b":{"version":"1.' || CAST(doc_id % 4 AS STRING) || '.0"}}}' FROM {documents}
  UNION ALL SELECT 'g' || CAST(doc_id AS STRING) || '/go.sum', 'm/x' || CAST(doc_id % 5 AS STRING) || ' v1.' || CAST(doc_id % 7 AS STRING) || '.0 h1:q' || chr(10) || 'm/x' || CAST(doc_id % 5 AS STRING) || ' v1.9.9/go.mod h1:z' || chr(10) || 'm/y v0.' || CAST(doc_id % 3 AS STRING) || '.0/go.mod h1:w' || chr(10) FROM {documents}
  UNION ALL SELECT 'r' || CAST(doc_id AS STRING) || '/requirements.txt', 'pkg' || CAST(doc_id % 9 AS STRING) || '==' || CAST(doc_id % 6 AS STRING) || '.1' || chr(10) || '# c' || chr(10) || chr(10) || 'other[x]>=' || CAST(doc_id % 4 AS STRING) || chr(10) || 'third~=2' || chr(10) || '-r base' || chr(10) || 'bare' || CAST(doc_id % 2 AS STRING) || chr(10) FROM {documents}
  UNION ALL SELECT 'g' || CAST(doc_id AS STRING) || '/go.mod', 'module m' || chr(10) || 'require (' || chr(10) || 'm/x' || CAST(doc_id % 5 AS STRING) || ' v1' || chr(10) || 'm/y v0 // indirect' || chr(10) || ')' || chr(10) || 'require solo' || CAST(doc_id % 3 AS STRING) || ' v2' || chr(10) FROM {documents}
  UNION ALL SELECT 'c' || CAST(doc_id AS STRING) || '/Cargo.toml', '[package]' || chr(10) || 'license = "' || CASE doc_id % 3 WHEN 0 THEN 'MIT' WHEN 1 THEN 'GPL2' ELSE 'BSD3' END || '"' || chr(10) || '[dependencies]' || chr(10) || 'lib' || CAST(doc_id % 3 AS STRING) || ' = "1"' || chr(10) FROM {documents}
  UNION ALL SELECT 'n' || CAST(doc_id AS STRING) || '/package.json', '{"license":"APACHE2","dependencies":{"a' || CAST(doc_id % 6 AS STRING) || '":"1"},"devDependencies":{"d":"2"}}' FROM {documents}""",
    "v_manifests": """SELECT * FROM (VALUES
  ('Cargo.toml', 'MIT OR Apache-2.0', 12), ('web/package.json', 'GPL-3.0', 30), ('lib/Cargo.toml', 'MIT/LGPL-2.1', 4),
  ('cli/package.json', 'BSD2', 7), ('go.mod', NULL, 5), ('tools/Cargo.toml', NULL, 2), ('x/package.json', 'Artistic-2.0 AND MPL2', 1)) AS m(path, licence, n_deps)""",
    "v_imports": """SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'pkg_' || CAST(s_suppkey AS STRING) ELSE 'other_' || CAST(s_suppkey AS STRING) END AS name FROM {supplier} WHERE s_suppkey % 5 <> 0""",
    "v_sources": """SELECT 'src/m_' || CAST(doc_id AS STRING) || CASE doc_id % 3 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' ELSE '.ts' END AS path,
  CASE doc_id % 3 WHEN 0 THEN 'fn f(a: i32) -> i32 {' || chr(10) || repeat('    if a > 0 && a < 9 { return 1; }' || chr(10), CAST(1 + doc_id % 9 AS INT)) || '}' || chr(10) || 'fn g() { if true {} }' || chr(10)
    WHEN 1 THEN 'import os' || chr(10) || 'from pkg_' || CAST(doc_id % 7 AS STRING) || '.core import x' || chr(10) || 'def p(x):' || chr(10) || repeat('    if x and x > 1 or x < 0:' || chr(10) || '        return 1' || chr(10), CAST(1 + doc_id % 12 AS INT)) || 'def q(): pass' || chr(10)
    ELSE 'import a from "@scope/a/b";' || chr(10) || 'export const h = (x) => {' || chr(10) || repeat('  x = x ?? y ? 1 : 2;' || chr(10), CAST(1 + doc_id % 6 AS INT)) || '};' || chr(10) END AS content,
  n_chars AS size FROM {documents}""",
    "v_files": """SELECT * FROM (VALUES
  ('Cargo.lock', '[[package]]' || chr(10) || 'name = "app"' || chr(10) || 'version = "0.1.0"' || chr(10) || 'dependencies = [' || chr(10) || ' "serde",' || chr(10) || ' "regex 1.5.4 (registry)",' || chr(10) || ']' || chr(10) || chr(10) || '[[package]]' || chr(10) || 'name = "serde"' || chr(10) || 'version = "1.0.1"' || chr(10) || chr(10) || '[[package]]' || chr(10) || 'name = "regex"' || chr(10) || 'version = "1.5.4"' || chr(10) || 'dependencies = [' || chr(10) || ' "app",' || chr(10) || ']' || chr(10)),
  ('Cargo.toml', '[package]' || chr(10) || 'license = "MIT"' || chr(10) || '[dependencies]' || chr(10) || 'serde = "1"' || chr(10) || '[dev-dependencies]' || chr(10) || 'quick = "1"' || chr(10)),
  ('web/package-lock.json', '{"packages":{"":{},"node_modules/a":{"version":"1.0.0","dependencies":{"@s/b":"1"}},"node_modules/a/node_modules/@s/b":{}}}'),
  ('old/package-lock.json', '{"dependencies":{"a":{"version":"1","dependencies":{"b":{"version":"2"}}}}}'),
  ('web/package.json', '{"license":"GPL2","dependencies":{"a":"1"},"peerDependencies":{"z":"1"}}'),
  ('go.sum', 'a/b v1.0.0 h1:x' || chr(10) || 'a/b v1.0.0/go.mod h1:y' || chr(10) || 'c v2.0.0/go.mod h1:z' || chr(10)),
  ('go.mod', 'module m' || chr(10) || 'require (' || chr(10) || 'a/b v1.0.0' || chr(10) || 'c v2.0.0 // indirect' || chr(10) || ')' || chr(10) || 'require d v1' || chr(10)),
  ('requirements.txt', 'x==1.0' || chr(10) || 'y[extra]>=2' || chr(10) || 'z~=3' || chr(10) || 'w' || chr(10) || '# c' || chr(10) || '-r f' || chr(10)),
  ('.gitignore', '*.pem' || chr(10) || '.env' || chr(10))) AS f(path, content)""",
    "v_history": """SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS day, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS sast_high,
  CAST(count(*) AS BIGINT) AS secrets_found, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS sca_cve_count,
  CAST(sum(o_custkey % 10) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS complexity_avg FROM {orders} GROUP BY 1""",
}


def text_of(name: str, table) -> str:
    """The SQL of a view, with table(name) for each table in it."""
    return re.sub(r"\{(\w+)\}", lambda m: f"({text_of(m[1], table)})" if m[1] in VIEWS else table(m[1]), VIEWS[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the parquet tables of a folder."""
    return spark.sql(text_of(name, lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))


def with_views(sql: str) -> str:
    """SQL for the checking database, with the views it names as common table expressions."""
    named = [n for n in VIEWS if n in sql]
    if not named:
        return sql
    ctes = ", ".join(f"{n} AS ({text_of(n, lambda t: t)})" for n in named)
    head, rest = ("WITH RECURSIVE ", sql.strip()[len("WITH RECURSIVE ") :]) if sql.strip().startswith("WITH RECURSIVE ") else ("WITH ", sql.strip()[len("WITH ") :] if sql.strip().startswith("WITH ") else None)
    return f"{head}{ctes}, {rest}" if rest is not None else f"WITH {ctes} {sql}"

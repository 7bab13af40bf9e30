"""Registration of queries with their SQL, and the SQL of the views they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with DuckDB SQL if there is some."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


UP, LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def low(c: str) -> str:
    return f"translate({c}, {UP}, {LOW})"


def up(c: str) -> str:
    return f"translate({c}, {LOW}, {UP})"


def tokens(c: str) -> str:
    """Tokens of a text in DuckDB."""
    return f"list_filter(list_transform(regexp_extract_all({c}, '[A-Z][a-z0-9]*|[a-z0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 2)"


def bucket(c: str) -> str:
    codes = f"list_transform(string_split({c}, ''), lambda ch: ascii(ch))"
    return f"list_reduce(list_prepend(37, {codes}), lambda h, b: (xor(h, b) * 179) & 255)"


DIRECTORIES = (
    "src/api", "src/services", "src/db", "src/pages", "src/components", "src/hooks", "src/workers", "src/clients",
    "src/repository", "lib", "secrets", "tests", "src/handlers", "src/routes", "src/tests", "fixtures", "pkg/fixtures/test",
)
SUFFIXES = (".ts", ".tsx", ".js", ".rs", ".py", ".test.ts", ".env", ".jsx", ".pem", "/secret.json", "/id_dsa", "_test.py")
KINDS = ("function", "method", "class", "struct", "enum", "trait", "interface", "component", "constant", "variable")


def listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def lines_sql(c: str) -> str:
    body = f"CASE WHEN ends_with({c}, chr(10)) THEN substr({c}, 1, length({c}) - 1) ELSE {c} END"
    return f"CASE WHEN {c} = '' THEN CAST([] AS VARCHAR[]) ELSE list_transform(string_split({body}, chr(10)), lambda x: CASE WHEN ends_with(x, chr(13)) THEN substr(x, 1, length(x) - 1) ELSE x END) END"


SENSITIVE = """(base IN ('.env', 'id_rsa', 'id_ed25519', 'credentials', 'credentials.json', 'secret.json')
  OR starts_with(base, '.env.') OR ends_with(base, '.pem') OR ends_with(base, '.key')
  OR starts_with(lpath, 'secrets/') OR contains(lpath, '/secrets/') OR contains(lpath, '/.git/'))"""

FILES = f"""
file_paths AS (
  SELECT doc_id, 'f' || doc_id AS file_id,
         {listed(DIRECTORIES)}[1 + doc_id % {len(DIRECTORIES)}] || '/m' || doc_id || {listed(SUFFIXES)}[1 + doc_id % {len(SUFFIXES)}] AS path, text
  FROM documents
), files AS (
  SELECT doc_id, file_id, path, text, CAST(strlen(text) AS BIGINT) AS size_bytes, md5(text) AS hash,
         {low("path")} AS lpath, regexp_extract({low("path")}, '([^/]*)$', 1) AS base,
         CASE regexp_extract({low("path")}, '\\.([^./]+)$', 1)
           WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript'
           WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' END AS language
  FROM file_paths
)"""

SYMBOLS = (
    FILES
    + f""", file_lines AS (
  SELECT doc_id, file_id, {lines_sql("text")} AS ls FROM files
), symbols AS (
  SELECT 's' || doc_id || '-' || pos AS symbol_id, file_id, CAST(pos AS INTEGER) AS ord, name,
         {listed(KINDS)}[CAST(1 + pos % 10 AS BIGINT)] AS kind, CAST(pos AS INTEGER) AS start_line,
         CAST(least(pos + doc_id % 7, len(ls)) AS INTEGER) AS end_line
  FROM (SELECT doc_id, file_id, ls, pos, regexp_extract(ls[pos], '[A-Za-z0-9]+') AS name
        FROM (SELECT doc_id, file_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM file_lines))
  WHERE name <> ''
)"""
)

UNITS = (
    SYMBOLS
    + f""", all_units AS (
  SELECT s.*, f.path, f.language, f.lpath, f.base,
         substr(array_to_string(l.ls[s.start_line:least(s.end_line, s.start_line + 79)], chr(10)), 1, 2500) AS text
  FROM symbols s JOIN files f USING (file_id) JOIN file_lines l USING (file_id)
), units AS (
  SELECT symbol_id, file_id, ord, name, kind, path, language, start_line, end_line, text FROM all_units
  WHERE NOT {SENSITIVE} AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''
    AND NOT (contains({up("text")}, 'BEGIN PRIVATE KEY') OR contains({up("text")}, 'BEGIN RSA PRIVATE KEY') OR contains({up("text")}, 'AWS_SECRET_ACCESS_KEY')
      OR contains({up("text")}, 'API_KEY=') OR contains({up("text")}, 'SECRET=') OR contains({up("text")}, 'PASSWORD=') OR contains({up("text")}, 'PRIVATE_KEY'))
)"""
)

TOUCHES = """
touched AS (
  SELECT l_orderkey AS k, list_sort(list_distinct(list('p/' || l_partkey))) AS paths FROM lineitem GROUP BY l_orderkey
), touches AS (
  SELECT CAST(o_orderkey AS INTEGER) AS ord, 'c' || o_orderkey AS sha, c_name AS author_name,
         CASE WHEN o_orderkey % 2 = 0 THEN 'U' ELSE 'u' END || c_custkey || '@mail' AS author_email,
         CAST(epoch(o_orderdate) AS BIGINT) AS authored_at, 'change ' || o_orderkey AS subject, paths
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN touched ON k = o_orderkey
)"""

EDGES = """
edges AS (
  SELECT DISTINCT 'order:' || l_orderkey AS source_id, 'part:' || l_partkey AS target_id, 'calls' AS kind FROM lineitem
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'supp:' || l_suppkey, 'references' FROM lineitem
  UNION ALL SELECT 'cust:' || o_custkey, 'order:' || o_orderkey, 'imports' FROM orders
  UNION ALL SELECT 'cust:' || c_custkey, 'nation:' || c_nationkey, 'extends' FROM customer
  UNION ALL SELECT 'supp:' || s_suppkey, 'nation:' || s_nationkey, 'extends' FROM supplier
  UNION ALL SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey, 'contains' FROM nation
), nodes AS (
  SELECT 'order:' || o_orderkey AS symbol_id, 'Order' || o_orderkey AS name, 'function' AS kind, 'src/api/o' || o_orderkey || '.ts' AS path FROM orders
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'class', 'src/db/p' || p_partkey || '.rs' FROM part
  UNION ALL SELECT 'supp:' || s_suppkey, s_name, 'struct', 'src/services/s' || s_suppkey || '.py' FROM supplier
  UNION ALL SELECT 'cust:' || c_custkey, c_name, 'function', 'src/components/c' || c_custkey || '.tsx' FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'enum', 'src/tests/n' || n_nationkey || '.ts' FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, r_name, 'trait', 'lib/r' || r_regionkey || '.js' FROM region
)"""

"""Queries over change history and its line formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import narratives, retrieval
from . import views
from .base import TOUCHES, query

HOTSPOTS = f"""
WITH {TOUCHES}, rows AS (SELECT ord, sha, authored_at, lower(author_email) AS who, unnest(paths) AS path FROM touches)
SELECT path, count(*) AS changes, count(DISTINCT who) AS contributors,
       arg_max(sha, (authored_at, ord)) AS last_sha, max(authored_at) AS last_at
FROM rows GROUP BY path"""


@query(HOTSPOTS)
def hist_hotspots(spark, sf_dir):
    return H.hotspots(views.touches(spark, sf_dir))


@query(f"SELECT path, changes, contributors, last_sha, last_at FROM ({HOTSPOTS}) ORDER BY changes DESC, contributors DESC, path LIMIT 8")
def hist_hotspots_top(spark, sf_dir):
    return H.ranked_hotspots(views.touches(spark, sf_dir), 8)


AUTHORS = f"""
WITH {TOUCHES}
SELECT arg_min(author_name, ord) AS name, arg_min(author_email, ord) AS email, count(*) AS commits, CAST(sum(len(paths)) AS BIGINT) AS files_touched
FROM touches GROUP BY lower(author_email)"""


@query(AUTHORS)
def hist_authors(spark, sf_dir):
    return H.authors(views.touches(spark, sf_dir))


@query(f"SELECT * FROM ({AUTHORS}) ORDER BY commits DESC, name, email LIMIT 12")
def hist_authors_top(spark, sf_dir):
    return H.ranked_authors(views.touches(spark, sf_dir), 12)


@query(f"WITH {TOUCHES} SELECT ord, sha, author_name, author_email, authored_at, subject, CAST(len(paths) AS BIGINT) AS files_changed FROM touches")
def hist_commits(spark, sf_dir):
    return H.commits(views.touches(spark, sf_dir))


def log_lines(spark, sf_dir):
    """The history of each author as log text: a header line per commit, then its paths below ``sub/``."""
    rows = views.touches(spark, sf_dir)
    head = F.concat_ws(H.FIELD, "sha", "author_name", "author_email", F.col("authored_at").cast("string"), "subject")
    paths = F.transform("paths", lambda p: F.concat(F.lit("sub/"), p))
    each = rows.select(F.lower("author_email").alias("repo"), "ord", F.posexplode(F.concat(F.array(head), paths)).alias("k", "line"))
    return each.select("repo", (F.col("ord").cast("long") * 1000 + F.col("k")).alias("ord"), "line")


@query(
    f"""WITH {TOUCHES}
SELECT lower(author_email) AS repo, CAST(row_number() OVER (PARTITION BY lower(author_email) ORDER BY ord) - 1 AS INTEGER) AS ord,
       sha, author_name, author_email, authored_at, subject, array_to_string(paths, ',') AS paths FROM touches"""
)
def log_parse(spark, sf_dir):
    parsed = H.parse_log(log_lines(spark, sf_dir), "sub")
    return parsed.withColumn("paths", F.array_join("paths", ","))


def status_lines(spark, sf_dir):
    """A name-status line per document."""
    doc = F.col("doc_id")
    path = F.concat(F.lit("sub/d"), (doc % 97).cast("string"), F.lit("/"), doc.cast("string"))
    letter = views.pick(("A", "M", "D", "R100", "C75", "T"), doc % 6)
    line = F.when((doc % 6).isin(3, 4), F.concat_ws("\t", letter, path, F.concat(path, F.lit("n")))).otherwise(F.concat_ws("\t", letter, path))
    return views.table(spark, sf_dir, "documents").select(doc.alias("ord"), line.alias("line"))


STATUS = """
WITH d AS (SELECT doc_id AS ord, doc_id % 6 AS m, 'd' || doc_id % 97 || '/' || doc_id AS p FROM documents), diff AS (
SELECT ord, CASE m WHEN 0 THEN 'added' WHEN 4 THEN 'added' WHEN 1 THEN 'modified' WHEN 5 THEN 'modified' WHEN 2 THEN 'deleted' ELSE 'renamed' END AS status,
       CASE WHEN m IN (2, 3) THEN p END AS old_path, CASE WHEN m IN (3, 4) THEN p || 'n' WHEN m IN (0, 1, 5) THEN p END AS new_path FROM d)"""


@query(STATUS + " SELECT * FROM diff")
def name_status_parse(spark, sf_dir):
    return H.parse_name_status(status_lines(spark, sf_dir), "sub")


@query(STATUS + " SELECT DISTINCT new_path AS path FROM diff WHERE status <> 'deleted'")
def diff_parse_paths(spark, sf_dir):
    return H.parse_paths(H.parse_name_status(status_lines(spark, sf_dir), "sub"))


@query(STATUS + " SELECT DISTINCT old_path AS path FROM diff WHERE status IN ('deleted', 'renamed')")
def diff_drop_paths(spark, sf_dir):
    return H.drop_paths(H.parse_name_status(status_lines(spark, sf_dir), "sub"))


PORCELAIN = """
WITH d AS (SELECT doc_id AS ord, doc_id % 5 AS m, 'd' || doc_id % 97 || '/' || doc_id AS p FROM documents), tree AS (
SELECT ord, CASE m WHEN 0 THEN 'modified' WHEN 1 THEN 'added' WHEN 2 THEN 'deleted' WHEN 3 THEN 'modified' ELSE 'added' END AS status,
       CASE WHEN m = 2 THEN p END AS old_path, CASE WHEN m = 3 THEN p || 'n' WHEN m <> 2 THEN p END AS new_path FROM d)"""


def porcelain_lines(spark, sf_dir):
    doc = F.col("doc_id")
    path = F.concat(F.lit("d"), (doc % 97).cast("string"), F.lit("/"), doc.cast("string"))
    code = views.pick((" M ", "?? ", " D ", "R  ", "A  "), doc % 5)
    rest = F.when(doc % 5 == 3, F.concat(path, F.lit(" -> "), path, F.lit("n"))).otherwise(path)
    return views.table(spark, sf_dir, "documents").select(doc.alias("ord"), F.concat(code, rest).alias("line"))


@query(PORCELAIN + " SELECT * FROM tree")
def porcelain_parse(spark, sf_dir):
    return H.parse_porcelain(porcelain_lines(spark, sf_dir))


@query(
    STATUS
    + ", "
    + PORCELAIN.replace("\nWITH d AS", "e AS").replace("FROM d)", "FROM e)")
    + """, every AS (SELECT 0 AS src, * FROM diff UNION ALL SELECT 1, * FROM tree)
SELECT status, old_path, new_path, CAST(src AS INTEGER) AS src, CAST(ord AS BIGINT) AS ord FROM (
  SELECT *, row_number() OVER (PARTITION BY status, old_path, new_path ORDER BY src, ord) AS k FROM every) WHERE k = 1"""
)
def diff_union(spark, sf_dir):
    return H.merged_diff(H.parse_name_status(status_lines(spark, sf_dir), "sub"), H.parse_porcelain(porcelain_lines(spark, sf_dir)))


@query("SELECT n_name AS name, md5(n_name) AS sha, n_name = 'FRANCE' AS is_default FROM nation")
def branches_parse(spark, sf_dir):
    lines = views.table(spark, sf_dir, "nation").select(F.concat_ws(H.FIELD, "n_name", F.md5("n_name")).alias("line"))
    return H.parse_branches(lines, "FRANCE")


def branch_table(spark, sf_dir):
    return branches_parse(spark, sf_dir)


@query(f"SELECT name AS subject, commits AS n, 'authors' AS route FROM ({AUTHORS}) ORDER BY commits DESC, name, email LIMIT 12")
def evolution_authors(spark, sf_dir):
    return retrieval.answer_evolution(views.touches(spark, sf_dir), branch_table(spark, sf_dir), "Who wrote most of this?")


@query(f"SELECT path AS subject, changes AS n, 'hotspots' AS route FROM ({HOTSPOTS}) ORDER BY changes DESC, contributors DESC, path LIMIT 8")
def evolution_hotspots(spark, sf_dir):
    return retrieval.answer_evolution(views.touches(spark, sf_dir), branch_table(spark, sf_dir), "Which files change most often?")


@query(f"WITH {TOUCHES} SELECT sha || ' ' || subject AS subject, CAST(len(paths) AS BIGINT) AS n, 'commits' AS route FROM touches ORDER BY ord LIMIT 12")
def evolution_commits(spark, sf_dir):
    return retrieval.answer_evolution(views.touches(spark, sf_dir), branch_table(spark, sf_dir), "Show the latest commits")


@query("SELECT n_name AS subject, CAST(n_name = 'FRANCE' AS BIGINT) AS n, 'branches' AS route FROM nation")
def evolution_branches(spark, sf_dir):
    return retrieval.answer_evolution(views.touches(spark, sf_dir), branch_table(spark, sf_dir), "List the branches")


NL = "chr(10)"


def report_sql(title: str, line: str, rows: str, order: str) -> str:
    return f"SELECT '{title}' || {NL} || {NL} || coalesce(string_agg({line} || {NL} || {NL}, '' ORDER BY {order}), '') AS text FROM ({rows})"


@query(report_sql("Authors", f"name || ' <' || email || '>' || {NL} || commits || ' commits · ' || files_touched || ' file touches'", AUTHORS + " ORDER BY commits DESC, name, email LIMIT 12", "commits DESC, name, email"))
def report_authors(spark, sf_dir):
    return narratives.evolution_report(views.touches(spark, sf_dir), branch_table(spark, sf_dir), "authors")


@query(report_sql("Files that change most frequently", f"path || {NL} || 'Changed ' || changes || ' times' || {NL} || contributors || ' contributors'", HOTSPOTS + " ORDER BY changes DESC, contributors DESC, path LIMIT 8", "changes DESC, contributors DESC, path"))
def report_hotspots(spark, sf_dir):
    return narratives.evolution_report(views.touches(spark, sf_dir), branch_table(spark, sf_dir), "hotspots")


@query(report_sql("Recent commits", f"substr(sha, 1, 8) || '  ' || subject || {NL} || author_name || ' · ' || len(paths) || ' files'", f"WITH {TOUCHES} SELECT * FROM touches ORDER BY ord LIMIT 12", "ord"))
def report_commits(spark, sf_dir):
    return narratives.evolution_report(views.touches(spark, sf_dir), branch_table(spark, sf_dir), "commits")


@query(report_sql("Branches", f"n_name || CASE WHEN n_name = 'FRANCE' THEN ' (default)' ELSE '' END || {NL} || substr(md5(n_name), 1, 12)", "SELECT n_name FROM nation", "n_name <> 'FRANCE', n_name"))
def report_branches(spark, sf_dir):
    return narratives.evolution_report(views.touches(spark, sf_dir), branch_table(spark, sf_dir), "branches")

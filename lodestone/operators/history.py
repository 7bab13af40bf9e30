"""Change history: log, branch and diff lines as tables; commits, authors, hotspots.

``touches`` has a row per commit: ord (0 is the newest), sha, author_name,
author_email, authored_at (epoch seconds), subject, paths (array<string>).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.text import ascii_lower

FIELD = "\x1f"


def commits(touches: DataFrame) -> DataFrame:
    """A row per commit with the number of paths it touched."""
    return touches.select(
        "ord", "sha", "author_name", "author_email", "authored_at", "subject", F.size("paths").cast("long").alias("files_changed")
    )


def authors(touches: DataFrame) -> DataFrame:
    """A row per author (e-mail without regard to ASCII case): commits, paths touched, first name seen."""
    named = F.when(F.col("author_name") != "", F.struct("ord", "author_name"))
    return (
        touches.groupBy(ascii_lower(F.col("author_email")).alias("key"))
        .agg(
            F.coalesce(F.min(named)["author_name"], F.lit("")).alias("name"),
            F.min(F.struct("ord", "author_email"))["author_email"].alias("email"),
            F.count("*").alias("commits"),
            F.sum(F.size("paths")).cast("long").alias("files_touched"),
        )
        .select("name", "email", "commits", "files_touched")
    )


def hotspots(touches: DataFrame) -> DataFrame:
    """A row per path that isn't sensitive: changes, contributors, last commit (later in the log wins a tie)."""
    rows = touches.select(
        "ord", "sha", "authored_at", ascii_lower(F.col("author_email")).alias("who"), F.explode("paths").alias("path")
    )
    return (
        rows.where(~P.is_sensitive(F.col("path")))
        .groupBy("path")
        .agg(
            F.count("*").alias("changes"),
            F.countDistinct("who").alias("contributors"),
            F.max(F.struct("authored_at", "ord", "sha")).alias("last"),
        )
        .select("path", "changes", "contributors", F.col("last.sha").alias("last_sha"), F.col("last.authored_at").alias("last_at"))
    )


def ranked_hotspots(touches: DataFrame, limit: int) -> DataFrame:
    return hotspots(touches).orderBy(F.desc("changes"), F.desc("contributors"), "path").limit(limit)


def ranked_authors(touches: DataFrame, limit: int) -> DataFrame:
    return authors(touches).orderBy(F.desc("commits"), "name", "email").limit(limit)


SEGMENT = 1 << 16


def parse_log(log_lines: DataFrame, prefix: str = "", segment: int = SEGMENT) -> DataFrame:
    """Lines (repo, ord, line) -> touches: a line with field separators opens a commit, others are its paths.

    Lines are numbered within ``repo``; the running count of headers tells the commit. It is taken within segments of
    ``segment`` numbers, to which the headers of the segments before are added, so one history is read by many tasks.
    A header of fewer than five fields is dropped with the paths below it; a time that is no number is 0.
    """
    header = F.col("line").contains(FIELD)
    parts = F.split("line", FIELD)
    lines = log_lines.select("repo", "ord", "line").withColumns(
        {"header": header, "good": header & (F.size(parts) >= 5), "seg": F.floor(F.col("ord") / segment)}
    )
    before = Window.partitionBy("repo").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = lines.groupBy("repo", "seg").agg(F.count_if("header").alias("h"), F.count_if("good").alias("g")).select(
        "repo", "seg", F.coalesce(F.sum("h").over(before), F.lit(0)).alias("headers"), F.coalesce(F.sum("g").over(before), F.lit(0)).alias("goods")
    )
    order = Window.partitionBy("repo", "seg").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    local = lines.withColumns({"commit": F.sum(F.col("header").cast("long")).over(order), "place": F.sum(F.col("good").cast("long")).over(order)})
    numbered = local.join(carried, ["repo", "seg"]).withColumns({"commit": F.col("commit") + F.col("headers"), "place": F.col("place") + F.col("goods")}).where("commit > 0")
    path = P.strip_prefix(F.trim("line"), prefix)
    grouped = numbered.groupBy("repo", "commit").agg(
        F.max(F.when(F.col("header"), parts)).alias("f"),
        F.array_sort(F.collect_list(F.when(~F.col("header") & (F.trim("line") != "") & (path != ""), F.struct("ord", path.alias("path"))))).alias("p"),
        F.max("place").alias("place"),
    )
    return grouped.where(F.size("f") >= 5).select(
        "repo",
        (F.col("place") - 1).cast("int").alias("ord"),
        F.get("f", F.lit(0)).alias("sha"),
        F.get("f", F.lit(1)).alias("author_name"),
        F.get("f", F.lit(2)).alias("author_email"),
        F.coalesce(F.get("f", F.lit(3)).try_cast("long"), F.lit(0)).alias("authored_at"),
        F.coalesce(F.get("f", F.lit(4)), F.lit("")).alias("subject"),
        F.transform("p", lambda x: x["path"]).alias("paths"),
    )


def parse_branches(lines: DataFrame, default: str) -> DataFrame:
    """Lines ``name<sep>sha`` -> name, sha, is_default; the default comes first when ordered."""
    parts = F.split("line", FIELD)
    return lines.where(F.col("line").contains(FIELD)).select(
        F.get(parts, F.lit(0)).alias("name"),
        F.get(parts, F.lit(1)).alias("sha"),
        (F.get(parts, F.lit(0)) == default).alias("is_default"),
    )


def parse_name_status(lines: DataFrame, prefix: str = "") -> DataFrame:
    """Lines ``status<tab>path[<tab>path]`` -> ord, status, old_path, new_path.

    Copies count as added and type changes as modified; other letters drop out.
    """
    good = lines.where(F.col("line").rlike(r"^(?:R[0-9]*\t[^\t]+\t[^\t]+|[ACMTD][0-9]*\t[^\t]+(?:\t[^\t]+)?)$"))
    parts = F.split("line", "\t")
    rows = good.select("ord", F.substring("line", 1, 1).alias("letter"), F.get(parts, F.lit(1)).alias("a"), F.get(parts, F.lit(2)).alias("b"))
    rows = rows.select("ord", "letter", P.strip_prefix(F.col("a"), prefix).alias("a"), P.strip_prefix(F.col("b"), prefix).alias("b"))
    letter = F.col("letter")
    status = F.when(letter.isin("A", "C"), "added").when(letter.isin("M", "T"), "modified").when(letter == "D", "deleted").otherwise("renamed")
    return rows.select(
        "ord",
        status.alias("status"),
        F.when(letter.isin("R", "D"), F.col("a")).alias("old_path"),
        F.when(letter == "R", F.col("b")).when(letter.isin("A", "C"), F.coalesce("b", "a")).when(letter.isin("M", "T"), F.col("a")).alias("new_path"),
    )


def parse_porcelain(lines: DataFrame, prefix: str = "") -> DataFrame:
    """Working-tree lines ``XY path`` -> ord, status, new_path (deleted: old_path); a rename gives its target."""
    code, rest = F.substring("line", 1, 2), F.substr(F.col("line"), F.lit(4))
    target = F.when(rest.contains(" -> "), F.substring_index(rest, " -> ", -1)).otherwise(rest)
    path = P.strip_prefix(F.regexp_replace(target, '^"|"$', ""), prefix)
    status = F.when(code.contains("D"), "deleted").when(code.contains("A") | code.contains("?"), "added").otherwise("modified")
    return lines.where(F.length("line") > 3).select(
        "ord",
        status.alias("status"),
        F.when(status == "deleted", path).alias("old_path"),
        F.when(status != "deleted", path).alias("new_path"),
    )


def parse_paths(diff: DataFrame) -> DataFrame:
    """Paths to parse: added, modified, and the new names of renamed files."""
    return diff.where("status <> 'deleted'").select(F.col("new_path").alias("path")).distinct()


def drop_paths(diff: DataFrame) -> DataFrame:
    """Paths that are gone: deleted, and the old names of renamed files."""
    return diff.where("status in ('deleted', 'renamed')").select(F.col("old_path").alias("path")).distinct()


def merged_diff(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both diffs without repeats; an entry keeps its first place."""
    every = first.withColumn("src", F.lit(0)).unionByName(second.withColumn("src", F.lit(1)))
    return every.groupBy("status", "old_path", "new_path").agg(F.min(F.struct("src", "ord")).alias("place")).select(
        "status", "old_path", "new_path", F.col("place.src").alias("src"), F.col("place.ord").alias("ord")
    )

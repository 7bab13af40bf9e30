"""The texts of answers: leads, history reports, summaries and the context pack as a prompt.

Each is one row, put together in a stated order from at most a few dozen rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from . import health, history

# fixed values: how many of each a text lists
LEADS, AUTHORS, HOTSPOTS, COMMITS, CITED_HOTSPOTS = 4, 12, 8, 12, 4


def joined(rows: DataFrame, line: Column, *order: Column | str, between: str = "") -> DataFrame:
    """One row ``text``: the lines of a short list in its order; empty for no rows."""
    entry = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order], line.alias("line"))
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["line"])
    return rows.agg(F.array_join(listed, between).alias("text"))


def called(name: Column, kind: Column) -> Column:
    return F.when(kind.isin("function", "method"), F.concat(name, F.lit("()"))).otherwise(name)


def extractive(pack: DataFrame, intent: str, relations: list[str]) -> DataFrame:
    """One row ``text``: the leading unit and where it is, or what it connects to, and what it handles."""
    first = pack.where("rank = 1")
    if intent == "explain":
        unit = F.struct("rank", "name", X.citation_key(F.col("symbol_id")).alias("key"))
        few = pack.where(F.col("rank") <= LEADS).agg(F.array_sort(F.collect_list(unit)).alias("units"))
        names, keys = F.transform("units", lambda u: u["name"]), F.transform("units", lambda u: F.concat(F.lit("[citation:"), u["key"], F.lit("]")))
        rest = F.when(F.size("units") > 1, F.concat(F.lit(", which connects to "), F.array_join(F.slice(names, 2, LEADS), ", "))).otherwise("")
        relation = f" Key relationship: {relations[0]}." if relations else ""
        lead = few.select(F.concat(F.get(names, F.lit(0)), F.lit(" is the primary entry"), rest, F.lit("." + relation + " "), F.array_join(keys, " ")).alias("lead"))
    else:
        lead = first.select(F.concat(called(F.col("name"), F.col("kind")), F.lit("\n\n"), "path", F.lit(":"), F.col("start_line").cast("string")).alias("lead"))
    items = first.select(X.handles(F.col("text")).alias("items"))
    told = F.concat(F.lit("\n\nHandles:\n"), F.array_join(F.transform("items", lambda i: F.concat(F.lit("- "), i, F.lit("\n"))), ""))
    return lead.crossJoin(items).select(F.concat("lead", F.when(F.size("items") > 0, told).otherwise("")).alias("text"))  # one row each


def authors_report(touches: DataFrame) -> DataFrame:
    rows = history.ranked_authors(touches, AUTHORS)
    line = F.format_string("%s <%s>\n%d commits · %d file touches\n\n", "name", "email", "commits", "files_touched")
    return headed("Authors\n\n", joined(rows, line, (-F.col("commits")).alias("n"), "name", "email"))


def branches_report(branches: DataFrame) -> DataFrame:
    mark = F.when(F.col("is_default"), " (default)").otherwise("")
    line = F.concat("name", mark, F.lit("\n"), F.substring("sha", 1, 12), F.lit("\n\n"))
    return headed("Branches\n\n", joined(branches, line, (~F.col("is_default")).alias("rest"), "name"))


def commits_report(touches: DataFrame) -> DataFrame:
    rows = history.commits(touches).orderBy("ord").limit(COMMITS)
    line = F.format_string("%s  %s\n%s · %d files\n\n", F.substring("sha", 1, 8), "subject", "author_name", "files_changed")
    return headed("Recent commits\n\n", joined(rows, line, "ord"))


def hotspots_report(touches: DataFrame) -> DataFrame:
    rows = history.ranked_hotspots(touches, HOTSPOTS)
    line = F.format_string("%s\nChanged %d times\n%d contributors\n\n", "path", "changes", "contributors")
    body = joined(rows, line, (-F.col("changes")).alias("n"), (-F.col("contributors")).alias("c"), "path")
    none = "No file history was collected for this repository.\n"
    return headed("Files that change most frequently\n\n", body.select(F.when(F.col("text") == "", none).otherwise(F.col("text")).alias("text")))


def headed(title: str, body: DataFrame) -> DataFrame:
    return body.select(F.concat(F.lit(title), "text").alias("text"))


def evolution_report(touches: DataFrame, branches: DataFrame, route: str) -> DataFrame:
    """One row ``text`` of the report that a question about history asks for."""
    if route == "branches":
        return branches_report(branches)
    return {"authors": authors_report, "commits": commits_report, "hotspots": hotspots_report}[route](touches)


def hotspot_citations(touches: DataFrame, nodes: DataFrame) -> DataFrame:
    """The first symbols of the files that change most: place, symbol and how often the file changed."""
    hot = history.ranked_hotspots(touches, CITED_HOTSPOTS).select("path", "changes", "contributors")
    own = nodes.join(F.broadcast(hot), "path")  # four rows
    first = own.groupBy("path", "changes", "contributors").agg(F.min(F.struct("ord", "symbol_id", "name", "start_line", "end_line")).alias("s"))
    return first.select(
        F.col("s.symbol_id").alias("symbol_id"), F.col("s.name").alias("name"), "path", F.col("s.start_line").alias("start_line"), F.col("s.end_line").alias("end_line"),
        F.format_string("Changed %d times · %d contributors", "changes", "contributors").alias("excerpt"), "changes", "contributors",
    ).orderBy(F.desc("changes"), F.desc("contributors"), "path")


def outline_summary(files: DataFrame) -> DataFrame:
    """One row ``text``: the groups of layers with their files."""
    rows = health.outline(files)
    layers = F.array_join(F.transform("layers", lambda x: F.concat(P.label_of(x["layer"]), F.lit(" ("), x["n_files"].cast("string"), F.lit(")"))), ", ")
    plural = F.when(F.col("n_files") == 1, "").otherwise("s")
    line = F.concat(F.initcap("group"), F.lit(" — "), F.col("n_files").cast("string"), F.lit(" file"), plural, F.lit(": "), layers)
    body = joined(rows, line, "place", between=". ")
    none = "No architecture layers were detected from file paths."
    return body.select(F.when(F.col("text") == "", none).otherwise(F.concat(F.lit("Inferred from paths, not an LLM. "), "text")).alias("text"))


def repository_summary(files: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """One row ``text``: counts, the outline and the shares of languages."""
    shares = health.languages(files)
    counts = files.agg(F.count("*").alias("files")).crossJoin(symbols.agg(F.count("*").alias("symbols"))).crossJoin(outline_summary(files).withColumnRenamed("text", "outline"))
    whole = files.agg(F.greatest(F.count("*"), F.lit(1)).alias("whole"))
    line = F.concat("language", F.lit(" "), F.round(100.0 * F.col("n_files") / F.col("whole")).cast("int").cast("string"), F.lit("%"))
    told = joined(shares.crossJoin(whole), line, line.alias("by"), between=", ")  # one row
    languages = F.when(F.col("text") == "", "no detected languages").otherwise(F.col("text"))
    bare = F.regexp_replace("outline", r"\.+$", "")
    said = F.concat(F.lit(f"{name} has "), F.col("files").cast("string"), F.lit(" files and "), F.col("symbols").cast("string"), F.lit(" symbols. "), bare, F.lit(". Languages: "), languages, F.lit("."))
    return counts.crossJoin(told).select(said.alias("text"))  # one row each


def architecture(files: DataFrame) -> DataFrame:
    """(place, line): layers with their files, as a prompt lists them."""
    return health.layers(files).select("place", F.concat("layer", F.lit(" ("), F.col("n_files").cast("string"), F.lit(")")).alias("line"))


def prompt(pack: DataFrame, relations: DataFrame, layers: DataFrame) -> DataFrame:
    """One row ``text``: the context pack as a language model gets it; secrets are blanked."""
    bullet = lambda c: F.concat(F.lit("- "), c, F.lit("\n"))
    unit = F.concat(
        F.lit("- [citation:"), X.citation_key(F.col("symbol_id")), F.lit("] "), "name", F.lit(" ("), "kind", F.lit(") "), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("\n"),
        X.redact_secrets(F.col("text")), F.lit("\n\n"),
    )
    parts = [joined(layers, bullet(F.col("line")), "place"), joined(pack, unit, "rank"), joined(relations, bullet(F.col("relation")), "relation")]
    a, b, c = (p.withColumnRenamed("text", n) for p, n in zip(parts, "abc"))
    return a.crossJoin(b).crossJoin(c).select(  # one row each
        F.concat(F.lit("CODEBASE CONTEXT\n\nArchitecture:\n"), "a", F.lit("\nRelevant symbols:\n"), "b", F.lit("Relationships:\n"), "c").alias("text")
    )

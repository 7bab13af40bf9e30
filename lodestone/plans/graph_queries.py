"""Queries over the graph of foreign keys, over resolution facts, snapshots and job events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import adjacency, graph, incremental, resolve, retrieval
from ..operators import units as U
from ..operators.persist import persisted
from ..streaming import jobs
from . import views
from .base import EDGES, FILES, SYMBOLS, query

NODE = "nation:7"
ORIGIN = "part:7"


def neighbour_sql(side: str, other: str, extra: str = "") -> str:
    return f"SELECT e.{other} AS symbol_id, e.kind, n.name, n.kind AS symbol_kind, n.path FROM edges e JOIN nodes n ON n.symbol_id = e.{other} WHERE e.{side} = '{NODE}' AND e.kind <> 'contains'{extra}"


@query(f"WITH {EDGES} SELECT target_id AS symbol_id, kind, 'out' AS way FROM edges WHERE source_id = 'order:11' UNION ALL SELECT source_id, kind, 'in' FROM edges WHERE target_id = '{NODE}' AND kind = 'contains'")
def graph_neighbors(spark, sf_dir):
    rows = views.edges(spark, sf_dir)
    out = graph.neighbors(rows, "order:11").withColumn("way", F.lit("out"))
    return out.unionByName(graph.incoming(rows, NODE, "contains").withColumn("way", F.lit("in")))


@query(f"WITH {EDGES} {neighbour_sql('target_id', 'source_id')}")
def graph_dependents(spark, sf_dir):
    return graph.dependents(views.edges(spark, sf_dir), views.nodes(spark, sf_dir), NODE)


@query(f"WITH {EDGES} {neighbour_sql('source_id', 'target_id').replace(NODE, 'order:11')}")
def graph_dependencies(spark, sf_dir):
    return graph.dependencies(views.edges(spark, sf_dir), views.nodes(spark, sf_dir), "order:11")


@query(
    f"""WITH {EDGES}, r AS (SELECT source_id AS symbol_id, kind FROM edges WHERE target_id = 'order:11' AND kind <> 'contains'
 UNION SELECT target_id, kind FROM edges WHERE source_id = 'order:11' AND kind <> 'contains')
SELECT r.symbol_id, r.kind, n.name, n.kind AS symbol_kind, n.path FROM r JOIN nodes n USING (symbol_id)"""
)
def graph_related(spark, sf_dir):
    return graph.related(views.edges(spark, sf_dir), views.nodes(spark, sf_dir), "order:11")


DEGREES = f"WITH {EDGES}, ends AS (SELECT source_id AS symbol_id FROM edges UNION ALL SELECT target_id FROM edges), degrees AS (SELECT symbol_id, count(*) AS degree FROM ends GROUP BY symbol_id)"


@query(DEGREES + " SELECT * FROM degrees")
def graph_degrees(spark, sf_dir):
    return graph.degrees(views.edges(spark, sf_dir))


COMPACT = DEGREES + ", top AS (SELECT d.symbol_id, d.degree, n.name, n.kind, n.path FROM degrees d JOIN nodes n USING (symbol_id) ORDER BY degree DESC, name, symbol_id LIMIT 48)"


@query(COMPACT + " SELECT * FROM top")
def graph_compact(spark, sf_dir):
    return graph.compact_view(views.edges(spark, sf_dir), views.nodes(spark, sf_dir))


@query(
    COMPACT
    + """, inner_edges AS (SELECT DISTINCT source_id, target_id FROM edges WHERE source_id IN (SELECT symbol_id FROM top) AND target_id IN (SELECT symbol_id FROM top)),
 steps AS (SELECT source_id AS a, target_id AS b, 1 AS step FROM inner_edges UNION SELECT target_id, source_id, -1 FROM inner_edges),
 focus AS (SELECT symbol_id FROM top ORDER BY degree DESC, name, symbol_id LIMIT 1),
 walk AS (SELECT symbol_id, 0 AS layer FROM focus), one AS (SELECT b AS symbol_id, arg_min(step, -step) AS layer FROM steps JOIN focus ON a = symbol_id WHERE b NOT IN (SELECT symbol_id FROM walk) GROUP BY b),
 placed AS (SELECT * FROM walk UNION ALL SELECT * FROM one), every AS (SELECT t.symbol_id, t.name, coalesce(p.layer, 0) AS layer FROM top t LEFT JOIN placed p USING (symbol_id))
 SELECT symbol_id, CAST(layer AS INTEGER) AS layer, CAST((row_number() OVER w - 1) * 188 - count(*) OVER (PARTITION BY layer) * 188 / 2 + 94 AS DOUBLE) AS x, CAST(layer * 118 AS DOUBLE) AS y
 FROM every WINDOW w AS (PARTITION BY layer ORDER BY name, symbol_id)"""
)
def graph_compact_layout(spark, sf_dir):
    """Coordinates of the nodes of highest degree (nations, that no path of two edges leads on from within them)."""
    edges = views.edges(spark, sf_dir)
    return graph.compact_layout(edges, graph.compact_view(edges, views.nodes(spark, sf_dir)))


@query(COMPACT.replace("LIMIT 48", "LIMIT 200") + " SELECT source_id, target_id, kind FROM edges WHERE source_id IN (SELECT symbol_id FROM top) AND target_id IN (SELECT symbol_id FROM top)")
def graph_compact_edges(spark, sf_dir):
    """The edges among the nodes of highest degree."""
    rows = views.edges(spark, sf_dir)
    return graph.induced(rows, graph.compact_view(rows, views.nodes(spark, sf_dir), 200))


@query(f"WITH {EDGES} SELECT source_id, count(*) AS n, md5(string_agg(target_id || kind, ',' ORDER BY target_id, kind)) AS targets FROM edges GROUP BY source_id")
def graph_adjacency(spark, sf_dir):
    rows = graph.adjacency(views.edges(spark, sf_dir))
    listed = F.array_join(F.transform("targets", lambda t: F.concat(t["target_id"], t["kind"])), ",")
    return rows.select("source_id", F.size("targets").cast("long").alias("n"), F.md5(listed).alias("targets"))


HOOD = f"""WITH RECURSIVE {EDGES}, ways AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges),
walk(symbol_id, depth) AS (SELECT '{ORIGIN}', 0 UNION SELECT b, depth + 1 FROM walk JOIN ways ON a = symbol_id WHERE depth < 2),
hood AS (SELECT symbol_id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY symbol_id)"""


@query(HOOD + " SELECT * FROM hood")
def graph_neighborhood(spark, sf_dir):
    return graph.neighborhood(views.edges(spark, sf_dir), ORIGIN, 2)


@query(HOOD + " SELECT source_id, target_id, kind FROM edges WHERE source_id IN (SELECT symbol_id FROM hood) AND target_id IN (SELECT symbol_id FROM hood)")
def graph_neighborhood_edges(spark, sf_dir):
    rows = views.edges(spark, sf_dir)
    return graph.induced(rows, graph.neighborhood(rows, ORIGIN, 2))


IMPACT = f"""WITH RECURSIVE {EDGES}, back AS (SELECT DISTINCT target_id AS a, source_id AS b FROM edges WHERE kind <> 'contains'),
walk(symbol_id, depth) AS (SELECT '{ORIGIN}', 0 UNION SELECT b, depth + 1 FROM walk JOIN back ON a = symbol_id WHERE depth < 16),
reached AS (SELECT symbol_id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY symbol_id),
report AS (SELECT r.symbol_id, n.name, n.path, r.depth, r.depth = 1 AS direct, r.depth > 1 AS indirect,
  r.depth > 0 AND contains(n.path, '/tests/') AS is_test, r.depth > 0 AND contains(n.path, '/api/') AS is_route,
  r.depth > 0 AND (contains(n.path, '/components/') OR (ends_with(n.path, '.tsx') AND regexp_matches(n.name, '^\\p{{Lu}}'))) AS is_component
 FROM reached r JOIN nodes n USING (symbol_id))"""


def impact_rows(spark, sf_dir):
    return graph.impact_report(views.edges(spark, sf_dir), views.nodes(spark, sf_dir), ORIGIN)


@query(IMPACT + " SELECT * FROM report")
def graph_impact(spark, sf_dir):
    """Everything that depends on a part, with the lists it is in."""
    return impact_rows(spark, sf_dir)


def stored_edges(spark, sf_dir):
    return persisted(adjacency.adjacency(views.edges(spark, sf_dir)), "adjacency")


@query(IMPACT + " SELECT * FROM report")
def graph_impact_stored(spark, sf_dir):
    """The same over a stored adjacency table."""
    return graph.impact_report(views.edges(spark, sf_dir), views.nodes(spark, sf_dir), ORIGIN, stored=stored_edges(spark, sf_dir))


@query(HOOD + " SELECT * FROM hood")
def graph_neighborhood_stored(spark, sf_dir):
    return graph.neighborhood(views.edges(spark, sf_dir), ORIGIN, 2, stored_edges(spark, sf_dir))


CAP = 400


@query(
    f"""WITH {EDGES}, back AS (SELECT DISTINCT target_id AS a, source_id AS b FROM edges WHERE kind <> 'contains'),
one AS (SELECT b AS symbol_id, row_number() OVER (ORDER BY b) AS place FROM back WHERE a = '{NODE}'), done AS (SELECT 1 + count(*) AS n FROM one),
two AS (SELECT b AS symbol_id, min(place) AS place FROM back JOIN one ON a = symbol_id WHERE b <> '{NODE}' AND b NOT IN (SELECT symbol_id FROM one) GROUP BY b),
numbered AS (SELECT *, row_number() OVER (ORDER BY place, symbol_id) AS idx FROM two),
turns AS (SELECT place FROM numbered GROUP BY place HAVING min(idx) - 1 + (SELECT n FROM done) < {CAP})
SELECT '{NODE}' AS symbol_id, CAST(0 AS INTEGER) AS depth UNION ALL SELECT symbol_id, 1 FROM one
UNION ALL SELECT symbol_id, 2 FROM numbered WHERE place IN (SELECT place FROM turns) AND (SELECT n FROM done) < {CAP}"""
)
def graph_impact_capped(spark, sf_dir):
    """A search that the limit on nodes ends: the orders of a nation's suppliers."""
    return graph.impact(views.edges(spark, sf_dir), NODE, CAP, depth=2)


@query(
    IMPACT
    + """, g AS (SELECT path, count(*) AS symbols, bool_or(is_component) AS c FROM report GROUP BY path)
 SELECT path, symbols, coalesce(nullif(concat_ws(',', CASE WHEN contains(path, '/tests/') THEN 'test' END, CASE WHEN contains(path, '/api/') THEN 'route' END,
  CASE WHEN c THEN 'component' END, CASE WHEN contains(path, '/services/') THEN 'service' END), ''), 'other') AS roles FROM g"""
)
def graph_impact_files(spark, sf_dir):
    return graph.impact_files(impact_rows(spark, sf_dir)).withColumn("roles", F.array_join("roles", ","))


@query(
    IMPACT
    + """, t AS (SELECT max(name) FILTER (depth = 0) AS origin, count(*) FILTER (direct) AS direct, count(*) FILTER (indirect) AS indirect, count(*) FILTER (is_test) AS is_test,
  count(*) FILTER (is_route) AS is_route, count(*) FILTER (is_component) AS is_component, count(DISTINCT path) AS files, count(DISTINCT path) FILTER (is_test) AS test_files FROM report)
,
 l AS (SELECT 1 AS place, *, row_number() OVER w AS k FROM report WHERE direct WINDOW w AS (ORDER BY depth, name, symbol_id)
  UNION ALL SELECT 2, *, row_number() OVER w FROM report WHERE is_route WINDOW w AS (ORDER BY depth, name, symbol_id)
  UNION ALL SELECT 3, *, row_number() OVER w FROM report WHERE is_test WINDOW w AS (ORDER BY depth, name, symbol_id)),
 s AS (SELECT place, chr(10) || ['Direct dependents', 'API endpoints that sit on this path', 'Tests that exercise this symbol'][place] || ':' || chr(10)
   || string_agg(chr(8594) || ' ' || name || ' (' || path || ')' || chr(10), '' ORDER BY k) AS told FROM l WHERE k <= CASE place WHEN 1 THEN 8 ELSE 6 END GROUP BY place)
 SELECT *, 'Changing ' || origin || '() can affect ' || (direct + indirect) || ' symbols across ' || files || ' files.' || chr(10) || chr(10) || '- ' || is_route || ' API endpoint'
  || CASE is_route WHEN 1 THEN '' ELSE 's' END || chr(10) || '- ' || is_component || ' UI component' || CASE is_component WHEN 1 THEN '' ELSE 's' END || chr(10) || '- ' || test_files
  || ' test suite' || CASE test_files WHEN 1 THEN '' ELSE 's' END || chr(10) || coalesce((SELECT string_agg(told, '' ORDER BY place) FROM s), '') AS narrative FROM t"""
)
def graph_impact_narrative(spark, sf_dir):
    return retrieval.explain_impact(impact_rows(spark, sf_dir))


@query(IMPACT + " SELECT max(path) FILTER (depth = 0) AS origin, string_agg(depth || name || symbol_id, ',' ORDER BY depth, name, symbol_id) FILTER (depth > 0) AS children FROM report")
def graph_impact_tree(spark, sf_dir):
    rows = graph.impact_tree(impact_rows(spark, sf_dir))
    listed = F.transform("children", lambda c: F.concat(c["depth"].cast("string"), c["name"], c["symbol_id"]))
    return rows.select(F.col("origin.path").alias("origin"), F.array_join(listed, ",").alias("children"))


@query(
    f"""WITH {EDGES}, l AS (SELECT symbol_id, name, CAST(length(name) % 7 - 3 AS INTEGER) AS layer FROM nodes)
SELECT symbol_id, layer, CAST((row_number() OVER w - 1) * 188 - count(*) OVER (PARTITION BY layer) * 94.0 + 94 AS DOUBLE) AS x, CAST(layer * 118 AS DOUBLE) AS y
FROM l WINDOW w AS (PARTITION BY layer ORDER BY name, symbol_id)"""
)
def graph_layout(spark, sf_dir):
    nodes = views.nodes(spark, sf_dir)
    layers = nodes.select("symbol_id", (F.length("name") % 7 - 3).alias("layer"))
    return graph.layout(layers, nodes)


@query()
def graph_layers(spark, sf_dir):
    """Signed layers of a view (its first-assignment rule is held against brute force in the tests)."""
    return graph.signed_layers(views.edges(spark, sf_dir), ORIGIN, 2)


CALLS = f"""WITH {SYMBOLS}, sites AS (SELECT file_id, ord AS s_ord, CAST(ord + k AS INTEGER) AS line, CAST(ord * 10 + k AS INTEGER) AS ord, name AS callee
  FROM symbols, (VALUES (0), (2)) v(k))"""


def stored_symbols(spark, sf_dir):
    """The symbols as an index holds them: written once, for queries that read them more than once."""
    return persisted(views.symbols(spark, sf_dir), "symbols")


def call_sites(symbols):
    """Two call lines below every symbol."""
    rows = symbols.withColumn("k", F.explode(F.array(F.lit(0), F.lit(2))))
    return rows.select("file_id", (F.col("ord") * 10 + F.col("k")).alias("ord"), F.col("name").alias("callee"), (F.col("ord") + F.col("k")).alias("line"))


@query(CALLS + " SELECT c.file_id, c.ord, c.callee, c.line, arg_min(s.symbol_id, (s.end_line - s.start_line, s.ord)) AS symbol_id FROM sites c JOIN symbols s ON s.file_id = c.file_id AND c.line BETWEEN s.start_line AND s.end_line GROUP BY ALL")
def join_enclosing_symbol(spark, sf_dir):
    symbols = stored_symbols(spark, sf_dir)
    return resolve.enclosing_symbols(call_sites(symbols), symbols)


@query(f"WITH {SYMBOLS} SELECT file_id, name, arg_min(symbol_id, ord) AS target_id FROM symbols GROUP BY file_id, name")
def join_first_by_name(spark, sf_dir):
    return resolve.first_by_name(stored_symbols(spark, sf_dir))


# every file imports its neighbour of the same folder list by a relative path; odd ones by name, even ones as a whole
IMPORTS = f"""{SYMBOLS}, imports AS (
 SELECT f.file_id, 1 AS ord, '/' || regexp_replace(g.path, '\\.[^./]*$', '') AS module,
  CASE WHEN f.doc_id % 2 = 1 THEN (SELECT list(name ORDER BY ord)[1:3] FROM symbols s WHERE s.file_id = g.file_id) ELSE CAST([] AS VARCHAR[]) END AS names
 FROM files f JOIN files g ON g.doc_id = f.doc_id + 1),
candidates AS (SELECT file_id, ord, names, unnest(range(1, 12)) AS pos,
  unnest([stem || '.ts', stem || '.tsx', stem || '.js', stem || '.jsx', stem || '.rs', stem || '.py', base || '/index.ts', base || '/index.js', base || '/mod.rs', base || '/__init__.py', base]) AS path
  FROM (SELECT *, substr(module, 2) AS base, regexp_replace(substr(module, 2), '([^/])\\.[^./]*$', '\\1') AS stem FROM imports)),
targets AS (SELECT c.file_id, c.ord, any_value(c.names) AS names, arg_min(f.file_id, c.pos) AS target_file FROM candidates c JOIN files f USING (path) GROUP BY c.file_id, c.ord),
firsts AS (SELECT file_id, name, arg_min(symbol_id, ord) AS target_id FROM symbols GROUP BY file_id, name),
imported AS (
 SELECT t.file_id, t.ord AS import_ord, s.ord AS name_ord, s.name, t.target_file, s.symbol_id AS target_id FROM targets t JOIN symbols s ON s.file_id = t.target_file WHERE len(t.names) = 0
 UNION ALL SELECT t.file_id, t.import_ord, CAST(t.name_ord - 1 AS INTEGER), t.name, t.target_file, f.target_id FROM (SELECT file_id, ord AS import_ord, target_file, unnest(names) AS name, unnest(range(1, len(names) + 1)) AS name_ord FROM targets) t
  JOIN firsts f ON f.file_id = t.target_file AND f.name = t.name)"""


def import_facts(spark, sf_dir, symbols):
    files = views.files(spark, sf_dir)
    after = files.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("next_path"), F.col("file_id").alias("next_file"))
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("ord", "name"))
    dealt = symbols.select("file_id", "ord", "name").repartition(resolve.pieces_for(symbols), "file_id")
    heads = dealt.withColumn("place", place).where("place <= 3")
    names = heads.groupBy(F.col("file_id").alias("next_file")).agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("n"))
    rows = files.select("doc_id", "file_id").join(after, "doc_id").join(names, "next_file", "left")
    listed = F.when(F.col("doc_id") % 2 == 1, F.coalesce(F.transform("n", lambda x: x["name"]), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    module = F.concat(F.lit("/"), F.regexp_replace("next_path", r"\.[^./]*$", ""))
    return persisted(rows.select("file_id", F.lit(1).alias("ord"), module.alias("module"), listed.alias("names")), "imports")


def imported_rows(spark, sf_dir, symbols):
    targets = resolve.import_targets(import_facts(spark, sf_dir, symbols), views.files(spark, sf_dir))
    return resolve.imported_symbols(targets, symbols)


@query(f"WITH {IMPORTS} SELECT file_id, ord, target_file FROM targets")
def join_import_targets(spark, sf_dir):
    imports = import_facts(spark, sf_dir, stored_symbols(spark, sf_dir))
    return resolve.import_targets(imports, views.files(spark, sf_dir)).drop("names")


@query(f"WITH {IMPORTS} SELECT * FROM imported")
def join_imported_symbols(spark, sf_dir):
    return imported_rows(spark, sf_dir, stored_symbols(spark, sf_dir))


@query(
    f"""WITH {IMPORTS}, heads AS (SELECT symbol_id, file_id FROM symbols WHERE kind <> 'method')
SELECT DISTINCT h.symbol_id AS source_id, i.target_id, 'imports' AS kind FROM heads h JOIN imported i USING (file_id) WHERE h.symbol_id <> i.target_id"""
)
def join_import_edges(spark, sf_dir):
    symbols = stored_symbols(spark, sf_dir).withColumn("container", F.lit(None).cast("string"))
    return resolve.apart(resolve.import_edges(symbols, persisted(imported_rows(spark, sf_dir, symbols), "imported")))


@query(
    f"""WITH {IMPORTS}, uses AS (SELECT s.file_id, s.symbol_id AS use_id, CASE WHEN s.ord % 2 = 0 THEN s.name ELSE o.name END AS name
 FROM symbols s LEFT JOIN symbols o ON o.file_id = 'f' || (CAST(substr(s.file_id, 2) AS BIGINT) + 3) AND o.ord = s.ord),
reach AS (SELECT DISTINCT file_id, target_file FROM imported),
every AS (SELECT use_id, 0 AS rank, 0 AS a, 0 AS b, target_id FROM uses JOIN firsts USING (file_id, name)
 UNION ALL SELECT use_id, 1, import_ord, name_ord, target_id FROM uses JOIN imported USING (file_id, name)
 UNION ALL SELECT use_id, 2, 0, 0, f.target_id FROM uses u JOIN reach r USING (file_id) JOIN firsts f ON f.file_id = r.target_file AND f.name = u.name)
SELECT use_id, arg_min(target_id, (rank, a, b, target_id)) AS target_id FROM every GROUP BY use_id"""
)
def join_resolve_names(spark, sf_dir):
    """Names resolved in the file, then through imports, then through any imported file."""
    symbols = stored_symbols(spark, sf_dir)
    number = F.substr(F.col("file_id"), F.lit(2)).cast("long")
    other = symbols.select(F.concat(F.lit("f"), (number - 3).cast("string")).alias("file_id"), "ord", F.col("name").alias("other"))
    uses = symbols.join(other, ["file_id", "ord"], "left").select(
        "file_id", F.col("symbol_id").alias("use_id"), F.when(F.col("ord") % 2 == 0, F.col("name")).otherwise(F.col("other")).alias("name")
    )
    return resolve.resolve_names(persisted(uses, "uses"), symbols, persisted(imported_rows(spark, sf_dir, symbols), "imported"))


@query(
    f"""WITH {IMPORTS}, sites AS (SELECT file_id, CAST(ord + k AS INTEGER) AS line, CAST(ord * 10 + k AS INTEGER) AS ord, name AS callee FROM symbols, (VALUES (0), (2)) v(k)),
placed AS (SELECT c.file_id, c.ord, c.callee, arg_min(s.symbol_id, (s.end_line - s.start_line, s.ord)) AS source_id FROM sites c JOIN symbols s ON s.file_id = c.file_id AND c.line BETWEEN s.start_line AND s.end_line GROUP BY ALL),
called AS (SELECT p.source_id, f.target_id, 'calls' AS kind FROM placed p JOIN firsts f ON f.file_id = p.file_id AND f.name = p.callee)
SELECT DISTINCT * FROM (SELECT * FROM called UNION ALL SELECT h.symbol_id, i.target_id, 'imports' FROM symbols h JOIN imported i USING (file_id) WHERE h.kind <> 'method') WHERE source_id <> target_id"""
)
def resolve_edges(spark, sf_dir):
    """All edges of the files from their facts."""
    symbols = stored_symbols(spark, sf_dir).withColumn("container", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "file_id string, ord int, child string, parent string, kind string")
    return resolve.resolve(views.files(spark, sf_dir), symbols, import_facts(spark, sf_dir, symbols), call_sites(symbols), none)


SNAPSHOTS = f"""WITH {FILES}, prev AS (SELECT file_id, path, hash FROM files WHERE doc_id % 19 <> 0),
curr AS (SELECT file_id, CASE WHEN doc_id % 17 = 0 THEN path || '.moved' ELSE path END AS path, CASE WHEN doc_id % 13 = 0 THEN md5(hash) ELSE hash END AS hash, doc_id FROM files WHERE doc_id % 11 <> 0)"""


def snapshots(spark, sf_dir):
    files = views.files(spark, sf_dir)
    doc = F.col("doc_id")
    old = files.where(doc % 19 != 0).select("file_id", "path", "hash")
    new = files.where(doc % 11 != 0).select(
        "file_id", F.when(doc % 17 == 0, F.concat("path", F.lit(".moved"))).otherwise(F.col("path")).alias("path"),
        F.when(doc % 13 == 0, F.md5("hash")).otherwise(F.col("hash")).alias("hash"), "doc_id",
    )
    return old, new


@query(SNAPSHOTS + " SELECT coalesce(p.path, c.path) AS path, CASE WHEN c.path IS NULL THEN 'dropped' WHEN p.hash = c.hash THEN 'skipped_by_hash' ELSE 'parse' END AS action FROM prev p FULL JOIN curr c ON p.path = c.path")
def inc_plan(spark, sf_dir):
    """What a re-index does with each file."""
    return incremental.plan_files(*snapshots(spark, sf_dir))


@query(
    SNAPSHOTS
    + """, listed AS (SELECT path FROM curr WHERE doc_id % 5 = 0)
 SELECT coalesce(p.path, c.path) AS path, CASE WHEN c.path IS NULL THEN 'dropped' WHEN p.hash = c.hash AND l.path IS NULL THEN 'skipped_by_diff' WHEN p.hash = c.hash THEN 'skipped_by_hash' ELSE 'parse' END AS action
 FROM prev p FULL JOIN curr c ON p.path = c.path LEFT JOIN listed l ON l.path = coalesce(p.path, c.path)"""
)
def inc_plan_with_diff(spark, sf_dir):
    """The same where a version-control diff lists every fifth file."""
    old, new = snapshots(spark, sf_dir)
    return incremental.plan_files(old, new, changed=new.where("doc_id % 5 = 0").select("path"))


MERGE = f"""WITH {SYMBOLS}, unit_edges AS (SELECT a.symbol_id AS source_id, b.symbol_id AS target_id, 'calls' AS kind FROM symbols a JOIN symbols b ON a.file_id = b.file_id AND b.ord = a.ord + 1),
live_files AS (SELECT file_id FROM files WHERE doc_id % 11 <> 0), changed AS (SELECT file_id FROM files WHERE doc_id % 13 = 0),
merged AS (SELECT symbol_id, file_id, name FROM symbols WHERE file_id IN (SELECT file_id FROM live_files) AND file_id NOT IN (SELECT file_id FROM changed)
 UNION ALL SELECT symbol_id, file_id, upper(name) FROM symbols WHERE file_id IN (SELECT file_id FROM changed))"""


def merge_inputs(spark, sf_dir):
    files, symbols = views.files(spark, sf_dir), views.symbols(spark, sf_dir)
    changed = files.where("doc_id % 13 = 0").select("file_id")
    fresh = symbols.join(changed, "file_id", "left_semi").withColumn("name", F.upper("name")).select(*symbols.columns)
    return files.where("doc_id % 11 <> 0"), symbols, changed, fresh


@query(MERGE + " SELECT * FROM merged")
def inc_merge_symbols(spark, sf_dir):
    files, symbols, changed, fresh = merge_inputs(spark, sf_dir)
    return incremental.merge_symbols(symbols, fresh, files, changed).select("symbol_id", "file_id", "name")


@query(
    MERGE
    + """ SELECT DISTINCT * FROM (
 SELECT e.* FROM unit_edges e JOIN symbols s ON s.symbol_id = e.source_id WHERE s.file_id NOT IN (SELECT file_id FROM changed) AND source_id IN (SELECT symbol_id FROM merged) AND target_id IN (SELECT symbol_id FROM merged)
 UNION ALL SELECT e.* FROM unit_edges e JOIN symbols s ON s.symbol_id = e.source_id WHERE s.file_id IN (SELECT file_id FROM changed)) WHERE source_id <> target_id"""
)
def inc_merge_edges(spark, sf_dir):
    files, symbols, changed, fresh = merge_inputs(spark, sf_dir)
    edges = views.unit_edges(spark, sf_dir)
    merged = incremental.merge_symbols(symbols, fresh, files, changed)
    starts = symbols.join(changed, "file_id", "left_semi").select(F.col("symbol_id").alias("source_id"))
    return incremental.merge_edges(edges, edges.join(starts, "source_id", "left_semi"), merged, changed)


@query(MERGE + " SELECT s.symbol_id FROM symbols s JOIN merged m USING (symbol_id) WHERE s.file_id NOT IN (SELECT file_id FROM changed) UNION ALL SELECT symbol_id FROM merged WHERE file_id IN (SELECT file_id FROM changed)")
def inc_reuse_units(spark, sf_dir):
    files, symbols, changed, fresh = merge_inputs(spark, sf_dir)
    return incremental.reuse_units(symbols, fresh, files, changed).select("symbol_id")


@query(MERGE + " SELECT symbol_id, file_id NOT IN (SELECT file_id FROM changed) AND ord % 2 = 0 AS reused FROM symbols WHERE file_id IN (SELECT file_id FROM live_files)")
def inc_reuse_embeddings(spark, sf_dir):
    """Vectors exist for every other symbol: those of unchanged live units stay, the rest are to be made."""
    files, symbols, changed, _ = merge_inputs(spark, sf_dir)
    units = incremental.live(symbols, files)
    kept, missing = incremental.reuse_embeddings(symbols.where("ord % 2 = 0").select("symbol_id"), units, changed)
    return kept.select("symbol_id", F.lit(True).alias("reused")).unionByName(missing.select("symbol_id", F.lit(False).alias("reused")))


@query(MERGE + " SELECT DISTINCT e.source_id, e.target_id, e.kind FROM unit_edges e WHERE source_id IN (SELECT symbol_id FROM symbols WHERE file_id IN (SELECT file_id FROM live_files)) AND target_id IN (SELECT symbol_id FROM symbols WHERE file_id IN (SELECT file_id FROM live_files))")
def inc_live_edges(spark, sf_dir):
    files, symbols, _, _ = merge_inputs(spark, sf_dir)
    return incremental.live_edges(views.unit_edges(spark, sf_dir), incremental.live(symbols, files))


@query(MERGE + " SELECT CAST((SELECT sum(len(ls)) FROM file_lines WHERE doc_id % 13 = 0) + (SELECT sum(n) FROM (SELECT max(end_line) AS n FROM symbols WHERE file_id NOT IN (SELECT file_id FROM changed) GROUP BY file_id)) AS BIGINT) AS lines")
def inc_line_count(spark, sf_dir):
    _, symbols, changed, _ = merge_inputs(spark, sf_dir)
    parsed = views.files(spark, sf_dir).where("doc_id % 13 = 0").select(F.size(X.lines(F.col("text"))).alias("n_lines"))
    return incremental.line_count(parsed, symbols.join(changed, "file_id", "left_anti")).select(F.col("lines").cast("long").alias("lines"))


@query(
    """SELECT u.symbol_id, u.path FROM (WITH """
    + SYMBOLS
    + """ SELECT symbol_id, path FROM symbols JOIN files USING (file_id) WHERE ord % 4 = 0) u"""
)
def citation_validation(spark, sf_dir):
    """Of all citations those whose symbol and path are in the pack."""
    cited = U.symbols_with_files(views.symbols(spark, sf_dir), views.files(spark, sf_dir)).select("symbol_id", "path", "ord")
    wrong = cited.select("symbol_id", F.concat("path", F.lit("x")).alias("path"), "ord")
    return retrieval.valid_citations(cited.unionByName(wrong), cited.where("ord % 4 = 0")).select("symbol_id", "path")


def job_events(spark, sf_dir):
    """Events as job progress: the user is the job."""
    stage = views.pick(jobs.STAGES, F.pmod(F.col("event_id"), F.lit(8)))
    rows = views.table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), stage.alias("stage"), "event_type", "value")


JOBS = "WITH e AS (SELECT user_id AS job_id, event_id, CAST(ts AS TIMESTAMP) AS ts, ['queued','scanning','parsing','resolving','embedding','persisting','succeeded','failed'][1 + event_id % 8] AS stage, event_type FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS k FROM e)"


@query(JOBS + " SELECT job_id, epoch_us(ts) AS at, event_id, stage, event_type FROM l WHERE k = 1")
def jobs_latest(spark, sf_dir):
    rows = jobs.latest(job_events(spark, sf_dir).select("job_id", "ts", "event_id", "stage", "event_type"))
    return rows.select("job_id", F.unix_micros("ts").alias("at"), "event_id", "stage", "event_type")


@query(JOBS + ", a AS (SELECT job_id, min(ts) AS started, count(*) AS n_events, arg_max(stage, (ts, stage, event_id)) AS status, max(ts) AS last FROM e GROUP BY job_id) SELECT job_id, epoch_us(started) AS started_at, status, CASE WHEN status IN ('succeeded', 'failed') THEN epoch_us(last) END AS finished_at, n_events FROM a")
def jobs_runs(spark, sf_dir):
    rows = jobs.runs(job_events(spark, sf_dir))
    return rows.select("job_id", F.unix_micros("started_at").alias("started_at"), "status", F.unix_micros("finished_at").alias("finished_at"), "n_events")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE 'new' END AS source, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS started_at, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '2' ELSE c_mktsegment END AS status FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0")
def runs_upsert(spark, sf_dir):
    """Old runs for every third customer, new ones for every second: the first source and start stay."""
    rows = views.table(spark, sf_dir, "customer")
    side = lambda where, source, at, tail: rows.where(where).select(F.col("c_custkey").alias("id"), F.lit(source).alias("source"), F.lit(at).alias("started_at"), F.concat("c_mktsegment", F.lit(tail)).alias("status"))
    return jobs.upsert_runs(side("c_custkey % 3 = 0", "old", 1, ""), side("c_custkey % 2 = 0", "new", 2, "2"))


@query("SELECT s_suppkey AS source FROM supplier WHERE s_suppkey % 4 <> 1")
def jobs_startable(spark, sf_dir):
    """Requests without a run under way."""
    rows = views.table(spark, sf_dir, "supplier")
    status = F.when(F.col("s_suppkey") % 4 == 1, "parsing").when(F.col("s_suppkey") % 4 == 2, "failed").otherwise("succeeded")
    return jobs.startable(rows.select(F.col("s_suppkey").alias("source")), rows.select(F.col("s_suppkey").alias("source"), status.alias("status")))


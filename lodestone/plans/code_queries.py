"""Queries over files, symbols and units: classifiers, rollups, text, search, retrieval."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..operators import adjacency, health, narratives, postings, retrieval, search
from ..operators import units as U
from ..operators.persist import persisted
from . import views
from .base import FILES, SENSITIVE, SYMBOLS, UNITS, bucket, lines_sql, low, query, tokens, up

SEG = r"(?:^|[/.\-_])(?:{})(?:[/.\-_]|$)"


def seg(words: str) -> str:
    return f"regexp_matches(lpath, '{SEG.format(words)}')"


LAYER = f"""CASE
  WHEN {seg("page|pages")} OR base IN ('page.tsx', 'page.jsx', 'page.ts') THEN 'pages'
  WHEN {seg("api|handler|handlers|routes|http|controller|controllers")} THEN 'api'
  WHEN {seg("service|services")} THEN 'services'
  WHEN {seg("repository|repositories")} OR contains(base, 'repository') THEN 'repositories'
  WHEN {seg("db|database|storage")} THEN 'database'
  WHEN {seg("worker|workers|job|jobs|queue")} THEN 'workers'
  WHEN {seg("component|components")} THEN 'components'
  WHEN {seg("hook|hooks")} THEN 'hooks'
  WHEN {seg("client|clients|external|integration|integrations")} THEN 'external'
  ELSE 'other' END"""
TEST = """((contains(lpath, '/tests/') OR contains(lpath, '/test/') OR contains(lpath, '/__tests__/')
  OR contains(base, '.test.') OR contains(base, '.spec.') OR ends_with(base, '_test.rs') OR ends_with(base, '_test.py') OR starts_with(base, 'test_'))
  AND NOT contains(lpath, '/fixtures/'))"""
ROUTE = f"""({seg("route|routes|pages|handlers|handler")} OR contains(lpath, '/api/')
  OR base IN ('page.tsx', 'page.jsx', 'page.ts', 'route.ts', 'route.tsx', 'layout.tsx'))"""
ORDER = "list_position(['api','services','repositories','database','workers','components','hooks','pages','external','other'], layer) - 1"
GROUP = """CASE WHEN layer IN ('components','hooks','pages') THEN 'frontend' WHEN layer IN ('api','services','repositories') THEN 'backend'
  WHEN layer IN ('database','workers','external') THEN 'infrastructure' ELSE 'other' END"""
LAYERED = f"{FILES}, layered AS (SELECT *, {LAYER} AS layer, {TEST} AS is_test, {ROUTE} AS is_route, {SENSITIVE} AS is_sensitive FROM files)"


@query(
    f"""WITH {LAYERED}
SELECT file_id, path, language, is_sensitive, is_test, is_route, layer, {GROUP} AS layer_group, CAST({ORDER} AS INTEGER) AS layer_place,
       regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM layered"""
)
def path_classes(spark, sf_dir):
    """Every classifier of paths over every file."""
    p = F.col("path")
    rows = views.files(spark, sf_dir).withColumn("layer", P.layer(p))
    return rows.select(
        "file_id", "path", "language", P.is_sensitive(p).alias("is_sensitive"), P.is_test(p).alias("is_test"), P.is_route(p).alias("is_route"),
        "layer", P.group_of(F.col("layer")).alias("layer_group"), P.layer_order(F.col("layer")).alias("layer_place"), P.directory(p).alias("directory"),
    )


COMPONENT = f"""(kind = 'component' OR regexp_matches(path, '(?:^|[/.\\-_])components?(?:[/.\\-_]|$)')
  OR (regexp_matches(path, '\\.(tsx|jsx)$') AND regexp_matches(name, '^\\p{{Lu}}')))"""


@query(
    f"""WITH {SYMBOLS}, f AS (SELECT file_id, path, lpath, base, {LAYER} AS layer, {TEST} AS t, {ROUTE} AS r FROM files),
per AS (SELECT file_id, bool_or({COMPONENT}) AS c FROM symbols JOIN files USING (file_id) GROUP BY file_id),
listed AS (SELECT path, list_filter([CASE WHEN t THEN 'test' END, CASE WHEN r THEN 'route' END, CASE WHEN c THEN 'component' END, CASE WHEN layer = 'services' THEN 'service' END], lambda x: x IS NOT NULL) AS rs FROM f JOIN per USING (file_id))
SELECT path, CASE WHEN len(rs) = 0 THEN 'other' ELSE array_to_string(rs, ',') END AS roles FROM listed"""
)
def file_roles(spark, sf_dir):
    """The roles of every file with symbols."""
    placed = U.symbols_with_files(views.symbols(spark, sf_dir), views.files(spark, sf_dir))
    any_component = F.bool_or(P.is_component(F.col("path"), F.col("name"), F.col("kind"))).alias("c")
    rows = placed.groupBy("file_id", "path").agg(any_component)
    return rows.select("path", F.array_join(P.roles(F.col("path"), F.col("c")), ",").alias("roles"))


@query(f"WITH {LAYERED} SELECT layer, CASE layer WHEN 'api' THEN 'Controllers' WHEN 'services' THEN 'Services' WHEN 'repositories' THEN 'Repositories' WHEN 'database' THEN 'Database' WHEN 'workers' THEN 'Queue' WHEN 'components' THEN 'Components' WHEN 'hooks' THEN 'Hooks' WHEN 'pages' THEN 'Pages' WHEN 'external' THEN 'External APIs' ELSE 'Other' END AS label, count(*) AS n_files, CAST({ORDER} AS INTEGER) AS place FROM layered GROUP BY layer")
def layer_counts(spark, sf_dir):
    return health.layers(views.files(spark, sf_dir))


@query(
    f"""WITH {LAYERED}, c AS (SELECT layer, {GROUP} AS g, CAST({ORDER} AS INTEGER) AS place, count(*) AS n FROM layered GROUP BY layer)
SELECT g AS "group", CAST(sum(n) AS BIGINT) AS n_files, string_agg(layer || '=' || n, ',' ORDER BY place) AS layers,
       CAST(list_position(['frontend','backend','infrastructure','other'], g) - 1 AS INTEGER) AS place FROM c GROUP BY g"""
)
def layer_outline(spark, sf_dir):
    rows = health.outline(views.files(spark, sf_dir))
    text = F.transform("layers", lambda x: F.concat(x["layer"], F.lit("="), x["n_files"].cast("string")))
    return rows.withColumn("layers", F.array_join(text, ","))


LABEL = "CASE layer WHEN 'api' THEN 'Controllers' WHEN 'services' THEN 'Services' WHEN 'repositories' THEN 'Repositories' WHEN 'database' THEN 'Database' WHEN 'workers' THEN 'Queue' WHEN 'components' THEN 'Components' WHEN 'hooks' THEN 'Hooks' WHEN 'pages' THEN 'Pages' WHEN 'external' THEN 'External APIs' ELSE 'Other' END"
OUTLINE_TEXT = f"""{LAYERED}, c AS (SELECT {LABEL} || ' (' || count(*) || ')' AS told, {GROUP} AS g, {ORDER} AS place, count(*) AS n FROM layered GROUP BY layer),
gs AS (SELECT upper(substr(g, 1, 1)) || substr(g, 2) || ' — ' || CAST(sum(n) AS BIGINT) || ' file' || CASE sum(n) WHEN 1 THEN '' ELSE 's' END || ': ' || string_agg(told, ', ' ORDER BY place) AS line,
  list_position(['frontend','backend','infrastructure','other'], g) AS p FROM c GROUP BY g),
outlined AS (SELECT 'Inferred from paths, not an LLM. ' || string_agg(line, '. ' ORDER BY p) AS text FROM gs)"""


@query(f"WITH {OUTLINE_TEXT} SELECT text FROM outlined")
def outline_text(spark, sf_dir):
    return narratives.outline_summary(views.files(spark, sf_dir))


@query(
    f"""WITH {SYMBOLS}, {OUTLINE_TEXT.removeprefix(FILES + ", ")},
shares AS (SELECT language || ' ' || CAST(round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM files)) AS INTEGER) || '%' AS told FROM files WHERE language IS NOT NULL GROUP BY language)
SELECT 'corpus has ' || (SELECT count(*) FROM files) || ' files and ' || (SELECT count(*) FROM symbols) || ' symbols. ' || (SELECT text FROM outlined) || '. Languages: ' || (SELECT string_agg(told, ', ' ORDER BY told) FROM shares) || '.' AS text"""
)
def summary_text(spark, sf_dir):
    return narratives.repository_summary(views.files(spark, sf_dir), views.symbols(spark, sf_dir), "corpus")


@query(
    f"""WITH {FILES}, k AS (SELECT language, count(*) AS n FROM files WHERE language IS NOT NULL GROUP BY language)
SELECT language, n AS n_files, round(100.0 * n / (SELECT sum(n) FROM k), 6) AS percent, CAST(list_position(['typescript','javascript','rust','python'], language) AS INTEGER) AS place FROM k"""
)
def language_histogram(spark, sf_dir):
    return health.languages(views.files(spark, sf_dir))


NEXT = "unit_edges AS (SELECT a.symbol_id AS source_id, b.symbol_id AS target_id, 'calls' AS kind FROM symbols a JOIN symbols b ON a.file_id = b.file_id AND b.ord = a.ord + 1)"
COMPLEXITY = """(SELECT round(coalesce((least(avg(coalesce(calls, 0)) / 6, 1.0) + least(avg(greatest(end_line - start_line, 1)) / 60, 1.0)) / 2, 0), 6)
  FROM symbols LEFT JOIN (SELECT source_id, count(*) AS calls FROM unit_edges GROUP BY source_id) ON source_id = symbol_id WHERE kind IN ('function', 'method'))"""


@query(f"WITH {SYMBOLS}, {NEXT} SELECT {COMPLEXITY} AS complexity")
def structural_complexity(spark, sf_dir):
    return health.complexity(views.symbols(spark, sf_dir), views.unit_edges(spark, sf_dir))


@query(
    f"""WITH {SYMBOLS}, {NEXT}, layered AS (SELECT *, {LAYER} AS layer, {TEST} AS is_test, {ROUTE} AS is_route FROM files),
fc AS (SELECT count(*) AS files, count(DISTINCT language) AS languages, count(*) FILTER (is_test) AS test_files, count(*) FILTER (layer <> 'other') AS mapped_files FROM layered),
sc AS (SELECT count(*) AS symbols, count(*) FILTER (is_test) AS test_symbols, count(*) FILTER (is_route AND kind IN ('function', 'method', 'component')) AS endpoints FROM symbols JOIN layered USING (file_id))
SELECT files, languages, symbols, test_files, test_symbols, endpoints, CAST(0 AS BIGINT) AS dependencies, {COMPLEXITY} AS complexity,
       round(mapped_files / files, 6) AS mapped, round(test_files / files, 6) AS test_presence FROM fc, sc"""
)
def repo_health(spark, sf_dir):
    return health.health(views.files(spark, sf_dir), views.symbols(spark, sf_dir), views.unit_edges(spark, sf_dir))


@query(
    f"""WITH {SYMBOLS}, {NEXT} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols,
 (SELECT count(*) FROM unit_edges WHERE kind = 'imports') AS imports, (SELECT CAST(sum(len(ls)) AS BIGINT) FROM file_lines) AS lines"""
)
def index_stats(spark, sf_dir):
    files = views.files(spark, sf_dir)
    counts = files.select(F.size(X.lines(F.col("text"))).cast("long").alias("lines"))
    return health.index_stats(files, views.symbols(spark, sf_dir), views.unit_edges(spark, sf_dir), counts)


@query(f"WITH {FILES} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, count(*) AS n_files, md5(string_agg(regexp_extract(path, '([^/]*)$', 1), ',' ORDER BY regexp_extract(path, '([^/]*)$', 1))) AS names FROM files GROUP BY 1")
def files_by_directory(spark, sf_dir):
    rows = U.files_by_directory(views.files(spark, sf_dir))
    return rows.withColumn("names", F.md5(F.array_join("names", ",")))


@query(f"WITH {FILES} SELECT count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS b FROM files WHERE size_bytes BETWEEN 1 AND 1048576")
def limits_totals(spark, sf_dir):
    kept = U.check_limits(views.files(spark, sf_dir), max_files=1 << 40, max_bytes=1 << 50)
    return kept.agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))


@query(f"SELECT doc_id, CAST(len({tokens('text')}) AS BIGINT) AS n_tokens, md5(array_to_string({tokens('text')}, ' ')) AS tokens_md5 FROM documents")
def text_tokenize(spark, sf_dir):
    rows = views.table(spark, sf_dir, "documents").select("doc_id", X.tokenize(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS INTEGER) AS n FROM documents")
def text_token_count(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", X.token_count(F.col("text")).alias("n"))


WIDEN = """list_concat([t], CASE WHEN length(t) >= 8 THEN [substr(t, 1, 4)] ELSE [] END,
 CASE WHEN t IN ('authentication','authorize','authorized','login') THEN ['auth','login','session'] ELSE [] END,
 CASE WHEN t IN ('payments','payment','billing','checkout') THEN ['pay','payment','stripe','transaction'] ELSE [] END,
 CASE WHEN t IN ('failed','failure','failing') THEN ['fail','failure','retry'] ELSE [] END)"""


@query(f"SELECT conv_id, turn, text || ' ' || array_to_string(list_sort(list_distinct(flatten(list_transform({tokens('text')}, lambda t: {WIDEN})))), ' ') AS expanded FROM conversations")
def text_expanded_query(spark, sf_dir):
    """Conversation turns as questions."""
    return views.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.expanded_query(F.col("text")).alias("expanded"))


def has(c: str, *needles: str) -> str:
    return "(" + " OR ".join(f"contains({c}, '{n}')" for n in needles) + ")"


Q = low("text")
INTENT = f"""CASE WHEN {has(Q, "hotspot", "frequently", "contributor", "who wrote", "authors", "commits", "branches")} OR (contains({Q}, 'change') AND {has(Q, "file", "most", "often")}) THEN 'evolution'
 WHEN {has(Q, "where", "which file", "handle", "find")} THEN 'locate' WHEN {has(Q, "impact", "depend", "break", "affect")} THEN 'impact'
 WHEN {has(Q, "how", "explain", "work", "does")} THEN 'explain' ELSE 'search' END"""


@query(f"SELECT conv_id, turn, {INTENT} AS intent, CASE WHEN {has(Q, 'author', 'who wrote', 'contributor')} THEN 'authors' WHEN contains({Q}, 'branch') THEN 'branches' WHEN contains({Q}, 'commit') AND NOT contains({Q}, 'file') THEN 'commits' ELSE 'hotspots' END AS route FROM conversations")
def question_intents(spark, sf_dir):
    return views.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", X.detect_intent(F.col("text")).alias("intent"), X.evolution_route(F.col("text")).alias("route")
    )


INJECTED = """CASE doc_id % 6 WHEN 0 THEN text || chr(10) || 'API_KEY=' || doc_id WHEN 1 THEN 'password=' || doc_id || ': x' || chr(10) || text
 WHEN 2 THEN text || chr(13) || chr(10) || '-----BEGIN PRIVATE KEY-----' WHEN 3 THEN 'private_key: ' || doc_id || chr(10) || text ELSE text END"""


def injected():
    doc, text = F.col("doc_id"), F.col("text")
    number = doc.cast("string")
    return (
        F.when(doc % 6 == 0, F.concat(text, F.lit("\nAPI_KEY="), number))
        .when(doc % 6 == 1, F.concat(F.lit("password="), number, F.lit(": x\n"), text))
        .when(doc % 6 == 2, F.concat(text, F.lit("\r\n-----BEGIN PRIVATE KEY-----")))
        .when(doc % 6 == 3, F.concat(F.lit("private_key: "), number, F.lit("\n"), text))
        .otherwise(text)
    )


MARKED = has(up("x"), "BEGIN PRIVATE KEY", "AWS_SECRET_ACCESS_KEY", "API_KEY=", "SECRET=", "PASSWORD=", "PRIVATE_KEY")


@query(
    f"""WITH d AS (SELECT doc_id, {INJECTED} AS text FROM documents)
SELECT doc_id, {has(up("text"), "BEGIN PRIVATE KEY", "BEGIN RSA PRIVATE KEY", "AWS_SECRET_ACCESS_KEY", "API_KEY=", "SECRET=", "PASSWORD=", "PRIVATE_KEY")} AS secret,
 md5(array_to_string(list_transform({lines_sql("text")}, lambda x: CASE WHEN NOT {MARKED} THEN x WHEN contains(x, '=') THEN regexp_extract(x, '^([^=]*)', 1) || '=[REDACTED]'
   WHEN contains(x, ':') THEN regexp_extract(x, '^([^:]*)', 1) || ': [REDACTED]' ELSE '[REDACTED]' END), chr(10))) AS redacted_md5 FROM d"""
)
def secret_redaction(spark, sf_dir):
    rows = views.table(spark, sf_dir, "documents").select("doc_id", injected().alias("text"))
    return rows.select("doc_id", X.looks_like_secret(F.col("text")).alias("secret"), F.md5(X.redact_secrets(F.col("text"))).alias("redacted_md5"))


@query(f"WITH {UNITS} SELECT symbol_id, name, kind, path, language, start_line, end_line, md5(text) AS text_md5 FROM units")
def semantic_units(spark, sf_dir):
    return views.units(spark, sf_dir).select("symbol_id", "name", "kind", "path", "language", "start_line", "end_line", F.md5("text").alias("text_md5"))


@query(
    f"""WITH m AS (SELECT doc_id, 'src/a' || doc_id % 7 || '/b/f' || doc_id || '.ts' AS importer,
  ['./x.y', '../z', '../../q/../r.js', '/abs/./m', 'react', '../../../../up'][1 + doc_id % 6] || CASE WHEN doc_id % 6 < 3 THEN '' ELSE '' || doc_id % 5 END AS module FROM documents),
b AS (SELECT doc_id, module, CASE WHEN starts_with(module, '/') THEN string_split(module, '/') ELSE list_concat(string_split(regexp_extract(importer, '^(.*/)[^/]*$', 1), '/'), string_split(module, '/')) END AS parts FROM m),
n AS (SELECT doc_id, module, list_filter(parts, lambda x: x <> '' AND x <> '.') AS parts FROM b),
r AS (SELECT doc_id, module, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(parts, lambda x: [x])),
   lambda acc, x: CASE WHEN x[1] = '..' THEN acc[1:greatest(len(acc) - 1, 0)] ELSE list_concat(acc, x) END) AS parts FROM n),
s AS (SELECT doc_id, module, array_to_string(parts, '/') AS base, regexp_replace(array_to_string(parts, '/'), '([^/])\\.[^./]*$', '\\1') AS stem FROM r)
SELECT doc_id, CASE WHEN starts_with(module, '.') OR starts_with(module, '/') THEN base END AS base,
 CASE WHEN starts_with(module, '.') OR starts_with(module, '/') THEN array_to_string([stem || '.ts', stem || '.tsx', stem || '.js', stem || '.jsx', stem || '.rs', stem || '.py', base || '/index.ts', base || '/index.js', base || '/mod.rs', base || '/__init__.py', base], ' ') ELSE '' END AS candidates FROM s"""
)
def module_candidates(spark, sf_dir):
    doc = F.col("doc_id")
    module = views.pick(("./x.y", "../z", "../../q/../r.js", "/abs/./m", "react", "../../../../up"), doc % 6)
    module = F.concat(module, F.when(doc % 6 < 3, "").otherwise((doc % 5).cast("string")))
    importer = F.concat(F.lit("src/a"), (doc % 7).cast("string"), F.lit("/b/f"), doc.cast("string"), F.lit(".ts"))
    found = views.table(spark, sf_dir, "documents").select("doc_id", P.module_candidates(importer, module).alias("c"))
    return found.select("doc_id", F.get("c", F.lit(10)).alias("base"), F.array_join("c", " ").alias("candidates"))


@query(
    """WITH h AS (SELECT page_id, url, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(url)) AS d FROM pages)
SELECT page_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', 1 + (list_position(string_split('0123456789abcdef', ''), substr(d, 17, 1)) - 1) % 4, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS id,
 regexp_extract(regexp_replace(regexp_replace(url, '/+$', ''), '\\.git$', ''), '([^/:]*)$', 1) AS name,
 regexp_matches(trim(substr(d, 1, CAST(page_id % 12 AS BIGINT))), '^[0-9a-fA-F]{7,}$') AS sha_like FROM h"""
)
def stable_ids(spark, sf_dir):
    """Name-based UUIDs, names of URLs and the test for commit ids."""
    rows = views.table(spark, sf_dir, "pages")
    namespace = F.lit("6ba7b810-9dad-11d1-80b4-00c04fd430c8")
    digest = F.sha1(F.concat(F.unhex(F.replace(namespace, F.lit("-"), F.lit(""))), F.encode("url", "UTF-8")))
    part = F.substr(digest, F.lit(1), (F.col("page_id") % 12).cast("int"))
    return rows.select(
        "page_id", X.uuid5(namespace, F.col("url")).alias("id"), X.repo_name(F.col("url")).alias("name"), X.looks_like_sha(part).alias("sha_like")
    )


HANDLED = f"""WITH {UNITS}, l AS (SELECT symbol_id, text, list_transform({lines_sql("text")}, lambda x: regexp_replace(x, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')) AS ls FROM units),
c AS (SELECT symbol_id, text, list_filter(list_transform(list_filter(ls, lambda x: starts_with(x, '//') OR starts_with(x, '#')), lambda x: regexp_replace(substr(x, CASE WHEN starts_with(x, '//') THEN 3 ELSE 2 END), '^[\\s\\pZ]+', '')), lambda x: strlen(x) > 3) AS cs FROM l),
d AS (SELECT symbol_id, text, list_filter(list_transform(range(1, len(cs) + 1), lambda i: CASE WHEN i > 1 AND cs[i] = cs[i - 1] THEN NULL ELSE cs[i] END), lambda x: x IS NOT NULL) AS cs FROM c)
SELECT symbol_id, array_to_string((CASE WHEN len(cs) > 0 THEN cs ELSE list_sort(list_distinct(list_filter({tokens("text")}, lambda x: length(x) > 4 AND {has("x", "fail", "retry", "notify", "status", "transaction", "stripe", "session", "auth")}))) END)[1:6], ';') AS handles FROM d"""


@query(HANDLED)
def unit_handles(spark, sf_dir):
    return views.units(spark, sf_dir).select("symbol_id", F.array_join(X.handles(F.col("text")), ";").alias("handles"))


CODE_LINE = "contains(x, '(') OR starts_with(x, 'export ') OR starts_with(x, 'function ') OR starts_with(x, 'class ') OR starts_with(x, 'pub ') OR starts_with(x, 'def ')"


@query(
    f"""WITH {UNITS}, l AS (SELECT symbol_id, name, kind, list_transform({lines_sql("text")}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS ls, {tokens("name")} AS w FROM units),
h AS (SELECT *, list_filter(list_transform(ls[1:6], lambda x: CASE WHEN {CODE_LINE} THEN 1 ELSE 0 END), lambda x: x >= 0) AS code FROM l),
c AS (SELECT *, list_filter(list_transform(list_filter(ls[1:coalesce(nullif(list_position(code, 1), 0), 7) - 1], lambda x: starts_with(x, '//') OR starts_with(x, '#')),
  lambda x: regexp_replace(regexp_replace(x, '^(//|#)', ''), '^\\s+', '')), lambda x: strlen(x) > 3)[1] AS comment FROM h),
f AS (SELECT *, list_filter(list_transform(list_filter(ls, lambda x: regexp_matches(x, '^(//|#|\\*)')),
  lambda x: regexp_replace(regexp_replace(x, '^(//|#|\\*)\\s*/*', ''), '^\\s+', '')), lambda x: strlen(x) > 3) AS steps,
  upper(substr(w[1], 1, 1)) || substr(w[1], 2) AS verb FROM c),
g AS (SELECT *, CASE WHEN regexp_matches(w[1], '(s|x|ch)$') THEN verb || 'es' WHEN ends_with(w[1], 'y') AND length(w[1]) > 1 THEN substr(verb, 1, length(verb) - 1) || 'ies' ELSE verb || 's' END AS acts FROM f)
SELECT symbol_id, coalesce(comment, CASE WHEN len(w) = 0 THEN 'The ' || kind || ' ' || name || '.'
  WHEN kind IN ('function', 'method') THEN acts || CASE WHEN len(w) > 1 THEN ' a ' || array_to_string(w[2:], ' ') || '.' ELSE ' this unit of work.' END
  WHEN kind IN ('class', 'struct', 'component') THEN 'Defines ' || name || '.' ELSE 'The ' || kind || ' ' || name || '.' END) AS purpose,
  array_to_string((CASE WHEN len(steps) > 0 THEN steps ELSE ['Calls ' || name] END)[1:8], ';') AS flow FROM g"""
)
def unit_purposes(spark, sf_dir):
    """What each unit is for and its steps."""
    rows = views.units(spark, sf_dir)
    name, text = F.col("name"), F.col("text")
    return rows.select("symbol_id", X.purpose(name, F.col("kind"), text).alias("purpose"), F.array_join(X.flow(text, F.array(name)), ";").alias("flow"))


EMBED = f"concat_ws(' ', name, kind, path, language, text)"


@query(
    f"""WITH {UNITS}, b AS (SELECT symbol_id, list_transform({tokens(EMBED)}, lambda t: {bucket("t")}) AS bs FROM units),
e AS (SELECT symbol_id, unnest(bs) AS bucket FROM b), c AS (SELECT symbol_id, bucket, count(*) AS n FROM e GROUP BY ALL)
SELECT symbol_id, CAST(bucket AS INTEGER) AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY symbol_id)), 6) AS weight FROM c"""
)
def unit_embeddings(spark, sf_dir):
    return search.embeddings(views.units(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"


@query(f"SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST({VECTOR} AS DOUBLE[])), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")
def vector_top_k(spark, sf_dir):
    rows = views.table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id = 7").first()["embedding"]
    return search.vector_top_k(rows, asked, 20)


NEEDLE = "the"
EXACT = f"""WITH {UNITS}, ut AS (SELECT symbol_id, arg_min(text, ord) AS unit_text FROM units GROUP BY symbol_id),
rows AS (SELECT symbol_id, name, path, kind, {low("name")} AS n, lpath, base, {low("coalesce(unit_text, '')")} AS t FROM symbols JOIN files USING (file_id) LEFT JOIN ut USING (symbol_id)),
hits AS (SELECT symbol_id, name, path, kind,
 CASE WHEN contains(n, '@Q') THEN 1.0 WHEN contains(base, '@Q') THEN 0.85 WHEN contains(lpath, '@Q') THEN 0.7 WHEN contains(n, '@Q') OR contains(t, '@Q') THEN 0.45 END AS score,
 CASE WHEN contains(n, '@Q') THEN 'symbolName' WHEN contains(base, '@Q') THEN 'fileName' WHEN contains(lpath, '@Q') THEN 'path' WHEN contains(n, '@Q') OR contains(t, '@Q') THEN 'text' END AS source FROM rows)"""


@query(EXACT.replace("@Q", NEEDLE) + " SELECT symbol_id, name, path, kind, CAST(score AS DOUBLE) AS score, source FROM hits WHERE score IS NOT NULL")
def exact_scores(spark, sf_dir):
    """Every hit of a query, not only the first ones."""
    return search.exact_scores(views.symbols(spark, sf_dir), views.files(spark, sf_dir), views.units(spark, sf_dir), "The ")


QUERY_OF_EXACT = EXACT.replace("@Q", "pages") + " SELECT symbol_id, name, path, kind, CAST(score AS DOUBLE) AS score, source FROM hits WHERE score IS NOT NULL ORDER BY score DESC, name, symbol_id LIMIT 32"


@query(QUERY_OF_EXACT)
def exact_search(spark, sf_dir):
    return search.exact_search(views.symbols(spark, sf_dir), views.files(spark, sf_dir), views.units(spark, sf_dir), "pages")


QUESTION = "How is the failed payment retried and handled in the service?"
QUERY_BUCKETS = f"""qt AS (SELECT unnest({tokens("expanded")}) AS t FROM (SELECT text || ' ' || array_to_string(list_sort(list_distinct(flatten(list_transform({tokens("text")}, lambda t: {WIDEN})))), ' ') AS expanded FROM (SELECT '{QUESTION}' AS text))),
qb AS (SELECT {bucket("t")} AS bucket, count(*) AS n FROM qt GROUP BY 1), qn AS (SELECT sqrt(sum(n * n)) AS norm FROM qb)"""
SEMANTIC = f"""{UNITS}, {QUERY_BUCKETS}, b AS (SELECT symbol_id, unnest(list_transform({tokens(EMBED)}, lambda t: {bucket("t")})) AS bucket FROM units),
c AS (SELECT symbol_id, bucket, count(*) AS n FROM b GROUP BY ALL),
nearness AS (SELECT symbol_id, round(coalesce(sum(c.n * qb.n), 0) / (sqrt(any_value(ss)) * (SELECT norm FROM qn)), 9) AS score
  FROM (SELECT *, sum(n * n) OVER (PARTITION BY symbol_id) AS ss FROM c) c LEFT JOIN qb USING (bucket) GROUP BY symbol_id),
near AS (SELECT u.symbol_id, u.name, u.path, u.kind, u.ord, u.text, coalesce(s.score, 0.0) AS score FROM units u LEFT JOIN nearness s USING (symbol_id))"""


@query(f"WITH {SEMANTIC} SELECT symbol_id, name, path, kind, CAST(round(score, 6) AS DOUBLE) AS score FROM near")
def semantic_scores(spark, sf_dir):
    """The cosine of every unit with a question."""
    rows = search.semantic_scores(views.units(spark, sf_dir), QUESTION)
    return rows.select("symbol_id", "name", "path", "kind", F.round("score", 6).alias("score"))


@query(f"WITH {SEMANTIC} SELECT symbol_id, name, path, kind, CAST(score AS DOUBLE) AS score, 'semantic' AS source FROM near ORDER BY near.score DESC, symbol_id LIMIT 16")
def semantic_search(spark, sf_dir):
    return search.semantic_search(views.units(spark, sf_dir), QUESTION)


def hybrid_sql(q: str) -> str:
    semantic = SEMANTIC.replace(QUESTION, q)[len(UNITS) :]
    return (
        EXACT.replace("@Q", q)
        + semantic
        + f""", e AS (SELECT symbol_id, name, path, kind, CAST(score AS DOUBLE) AS score, source, 0 AS src FROM hits WHERE score IS NOT NULL ORDER BY hits.score DESC, name, symbol_id LIMIT 32),
 s AS (SELECT symbol_id, name, path, kind, CAST(score AS DOUBLE) AS score, 'semantic' AS source, 1 AS src FROM near ORDER BY near.score DESC, symbol_id LIMIT 16),
 k AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY score DESC, src) AS rn FROM (SELECT * FROM e UNION ALL SELECT * FROM s))
 SELECT symbol_id, name, path, kind, score, source FROM k WHERE rn = 1 ORDER BY score DESC, name, symbol_id LIMIT 40"""
    )


@query(hybrid_sql("pages"))
def hybrid_search(spark, sf_dir):
    return search.hybrid_search(views.symbols(spark, sf_dir), views.files(spark, sf_dir), views.stored_units(spark, sf_dir), "pages")


@query(f"WITH {SYMBOLS} SELECT symbol_id, name, kind, path FROM symbols JOIN files USING (file_id) WHERE lower(name) LIKE lower('%T_e%') ORDER BY name, symbol_id LIMIT 200")
def symbol_like(spark, sf_dir):
    rows = U.like_search(views.symbols(spark, sf_dir), views.files(spark, sf_dir), "T_e")
    return rows.select("symbol_id", "name", "kind", "path")


@query(EXACT.replace("@Q", "pages") + ", best AS (SELECT symbol_id FROM hits WHERE score IS NOT NULL ORDER BY score DESC, name, symbol_id LIMIT 200) SELECT symbol_id, name, kind, path FROM symbols JOIN files USING (file_id) JOIN best USING (symbol_id) WHERE kind = 'function'")
def symbol_list(spark, sf_dir):
    rows = search.symbol_list(views.symbols(spark, sf_dir), views.files(spark, sf_dir), views.units(spark, sf_dir), "pages", "function")
    return rows.select("symbol_id", "name", "kind", "path")


@query(f"WITH {SYMBOLS} SELECT symbol_id AS id, name, kind, path, start_line AS \"startLine\", end_line AS \"endLine\" FROM symbols JOIN files USING (file_id)")
def symbol_response(spark, sf_dir):
    """Symbols with their files under the names of the service's responses."""
    rows = U.symbols_with_files(views.symbols(spark, sf_dir), views.files(spark, sf_dir))
    return rows.select(F.col("symbol_id").alias("id"), "name", "kind", "path", F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"))


@query(f"WITH {UNITS} SELECT s.symbol_id, f.path, f.language, CAST(len(list_filter(regexp_split_to_array(u.text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS INTEGER) AS token_count FROM units u JOIN symbols s USING (symbol_id) JOIN files f ON f.file_id = s.file_id")
def chunk_rows(spark, sf_dir):
    """Units with their symbols and files: three tables by key."""
    units = views.units(spark, sf_dir).select("symbol_id", X.token_count(F.col("text")).alias("token_count"))
    joined = units.join(views.symbols(spark, sf_dir).select("symbol_id", "file_id"), "symbol_id")
    return joined.join(views.files(spark, sf_dir).select("file_id", "path", "language"), "file_id").select("symbol_id", "path", "language", "token_count")


@query(f"WITH {UNITS} SELECT s.symbol_id, coalesce(md5(u.text), md5('')) AS unit_md5 FROM symbols s LEFT JOIN units u USING (symbol_id)")
def symbol_first_units(spark, sf_dir):
    rows = U.first_units(views.symbols(spark, sf_dir), views.units(spark, sf_dir))
    return rows.select("symbol_id", F.md5("unit_text").alias("unit_md5"))


@query(f"WITH {SYMBOLS} SELECT symbol_id, file_id, name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file_id, ord) AS k FROM symbols) WHERE k = 1")
def first_of_name(spark, sf_dir):
    rows = U.dedup_keep_first(views.symbols(spark, sf_dir), "name", "file_id", "ord")
    return rows.select("symbol_id", "file_id", "name")


def cited_units(spark, sf_dir):
    rows = views.units(spark, sf_dir)
    return rows.withColumn("place", X.location(F.col("path"), F.col("start_line"), F.col("end_line")))


@query(f"WITH {UNITS} SELECT symbol_id, 'See ' || path || ':' || start_line || '-' || end_line || ' and [citation:none]' AS told, path || ':' || start_line || '-' || end_line AS first_place FROM units")
def citation_markers(spark, sf_dir):
    """Markers in a text become places, and places are found again."""
    key = F.col("symbol_id")
    cited = F.array(F.struct(key.alias("key"), F.col("place").alias("place")))
    told = X.resolve_markers(F.concat(F.lit("See [citation:"), key, F.lit("] and [citation:none]")), cited)
    return cited_units(spark, sf_dir).select("symbol_id", told.alias("told"), F.get(X.markers(told), F.lit(0)).alias("first_place"))


BONUS = f"""CASE WHEN strlen(name) >= 4 AND contains({low(f"'{QUESTION}'")}, {low("name")}) THEN 0.6
 WHEN len(list_intersect(list_filter({tokens("name")}, lambda t: length(t) >= 4), (SELECT list(t) FROM qd))) > 0 THEN 0.45 ELSE 0.0 END"""
RETRIEVE = f"""WITH {SEMANTIC}, {NEXT}, qd AS (SELECT DISTINCT unnest(flatten(list_transform({tokens("text")}, lambda t: {WIDEN}))) AS t FROM (SELECT '{QUESTION}' AS text)),
n AS (SELECT symbol_id, name, score + {BONUS} AS semantic, score FROM near WHERE score > 0 ORDER BY near.score DESC, symbol_id LIMIT 16),
lx AS (SELECT symbol_id, round({BONUS} + (SELECT count(*) FROM qd WHERE contains({low("near.name")}, qd.t) OR contains({low("near.text")}, qd.t)) / (SELECT count(*) FROM qd), 9) AS lexical FROM near),
l AS (SELECT symbol_id, lexical FROM lx WHERE lexical > 0 ORDER BY lexical DESC, symbol_id LIMIT 8),
m AS (SELECT coalesce(n.symbol_id, l.symbol_id) AS symbol_id, CASE WHEN n.semantic IS NOT NULL THEN n.semantic + 0.35 * coalesce(l.lexical, 0) ELSE 0.8 * l.lexical END AS score FROM n FULL JOIN l ON n.symbol_id = l.symbol_id),
r AS (SELECT symbol_id, m.score, units.name FROM m JOIN units USING (symbol_id)),
seeds AS (SELECT symbol_id FROM r ORDER BY score DESC, name, symbol_id LIMIT 3),
around AS (SELECT target_id AS symbol_id FROM unit_edges WHERE source_id IN (SELECT symbol_id FROM seeds) UNION SELECT source_id FROM unit_edges WHERE target_id IN (SELECT symbol_id FROM seeds)),
every AS (SELECT * FROM r UNION ALL SELECT symbol_id, 0.35, name FROM around JOIN units USING (symbol_id) WHERE symbol_id NOT IN (SELECT symbol_id FROM r)),
top AS (SELECT symbol_id, score, name FROM every ORDER BY score DESC, name, symbol_id LIMIT 5)"""


@query(RETRIEVE + " SELECT symbol_id, CAST(round(score, 6) AS DOUBLE) AS score, name FROM top")
def retrieve(spark, sf_dir):
    """The ranked candidates of a question (a location: five)."""
    return retrieval.retrieve(views.stored_units(spark, sf_dir), views.unit_edges(spark, sf_dir), QUESTION)


@query(
    RETRIEVE
    + f""", ranked AS (SELECT u.symbol_id, u.path, CAST(row_number() OVER (ORDER BY round(top.score, 6) DESC, top.name, u.symbol_id) AS INTEGER) AS rank, strlen(u.text) AS bytes FROM top JOIN units u USING (symbol_id)),
 packed AS (SELECT *, CAST(sum(bytes) OVER (ORDER BY rank) AS BIGINT) AS bytes_so_far FROM ranked)
 SELECT symbol_id, rank, path, bytes_so_far FROM packed WHERE bytes_so_far <= 12000"""
)
def context_pack(spark, sf_dir):
    """What fits the context of an answer."""
    units = views.stored_units(spark, sf_dir)
    ranked = retrieval.retrieve(units, views.unit_edges(spark, sf_dir), QUESTION)
    return retrieval.context_pack(ranked, units).select("symbol_id", "rank", "path", "bytes_so_far")


class Stored:
    """What an index stores of the units: postings, vectors and adjacency; each made when a query first needs it, once per session and folder."""

    MADE: dict[tuple[str, str], Stored] = {}

    @classmethod
    def of(cls, spark, sf_dir):
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls.MADE:
            cls.MADE[key] = cls(spark, sf_dir)
        return cls.MADE[key]

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def units(self):
        return views.stored_units(self.spark, self.sf_dir)

    @cached_property
    def lexicon(self):
        posted = persisted(postings.postings(self.units), "postings")
        pieces = postings.dealt(postings.grams(posted), "gram")
        return postings.Lexicon(posted, persisted(pieces, "grams"))

    @cached_property
    def vectors(self):
        vectors = search.embeddings(self.units).withColumn("part", F.col("bucket") % search.VECTOR_PARTS)
        return persisted(vectors, "vectors")

    @cached_property
    def edges(self):
        return views.unit_edges(self.spark, self.sf_dir)

    @cached_property
    def adjacent(self):
        return persisted(adjacency.adjacency(self.edges), "adjacency")


@query(QUERY_OF_EXACT)
def exact_search_stored(spark, sf_dir):
    """Exact search over postings, texts unread."""
    stored = Stored.of(spark, sf_dir)
    return search.exact_search(views.symbols(spark, sf_dir), views.files(spark, sf_dir), stored.units, "pages", lexicon=stored.lexicon)


@query(f"WITH {SEMANTIC} SELECT symbol_id, name, path, kind, CAST(score AS DOUBLE) AS score, 'semantic' AS source FROM near ORDER BY near.score DESC, symbol_id LIMIT 16")
def semantic_search_stored(spark, sf_dir):
    """Semantic search over stored vectors: the question's buckets only."""
    stored = Stored.of(spark, sf_dir)
    return search.semantic_search(stored.units, QUESTION, vectors=stored.vectors)


@query(RETRIEVE + " SELECT symbol_id, CAST(round(score, 6) AS DOUBLE) AS score, name FROM top")
def retrieve_stored(spark, sf_dir):
    """The candidates of a question over stored tables."""
    stored = Stored.of(spark, sf_dir)
    return retrieval.retrieve(stored.units, stored.edges, QUESTION, stored.vectors, stored.lexicon, stored.adjacent)


IMPACT_QUESTION = "What depends on a failed payment session?"
RETRIEVE_IMPACT = RETRIEVE.replace("WITH ", "WITH RECURSIVE ", 1).replace(QUESTION, IMPACT_QUESTION).partition("every AS (")[0] + """found AS (SELECT * FROM r UNION ALL
  SELECT symbol_id, 0.35, name FROM around JOIN units USING (symbol_id) WHERE symbol_id NOT IN (SELECT symbol_id FROM r)),
origin AS (SELECT symbol_id FROM found ORDER BY score DESC, name, symbol_id LIMIT 1),
walk(symbol_id, depth) AS (SELECT symbol_id, 0 FROM origin UNION ALL SELECT e.source_id, depth + 1 FROM walk JOIN unit_edges e ON e.target_id = walk.symbol_id WHERE depth < 16),
told AS (SELECT u.symbol_id, u.name FROM walk JOIN units u USING (symbol_id) WHERE depth = 1 OR depth > 1 AND (kind = 'component' OR regexp_matches(path, '(^|[/.\\-_])components?([/.\\-_]|$)')
  OR ((ends_with(path, '.tsx') OR ends_with(path, '.jsx')) AND regexp_matches(name, '^\\p{Lu}')))),
every AS (SELECT * FROM found UNION ALL SELECT symbol_id, 0.3, name FROM told WHERE symbol_id NOT IN (SELECT symbol_id FROM found)),
top AS (SELECT symbol_id, score, name FROM every ORDER BY score DESC, name, symbol_id LIMIT 12)"""


@query(RETRIEVE_IMPACT + " SELECT symbol_id, CAST(round(score, 6) AS DOUBLE) AS score, name FROM top")
def retrieve_impact(spark, sf_dir):
    """The candidates of a question about impact: direct dependents and components of the best one come in."""
    return retrieval.retrieve(views.stored_units(spark, sf_dir), views.stored_unit_edges(spark, sf_dir), IMPACT_QUESTION)


ANSWERED = RETRIEVE + f""", ranked AS (SELECT u.*, CAST(row_number() OVER (ORDER BY round(top.score, 6) DESC, top.name, u.symbol_id) AS INTEGER) AS rank FROM top JOIN units u USING (symbol_id)),
 packed AS (SELECT * FROM (SELECT *, sum(strlen(text)) OVER (ORDER BY rank) AS bytes FROM ranked) WHERE bytes <= 12000),
 shown AS (SELECT * FROM packed WHERE path = (SELECT path FROM packed WHERE rank = 1) ORDER BY rank LIMIT 4),
 counted AS (SELECT count(*) AS s, count(DISTINCT path) AS f FROM packed), lead AS (SELECT * FROM packed WHERE rank = 1), told AS (SELECT handles FROM ({HANDLED.replace("WITH " + UNITS + ",", "WITH").replace("FROM units)", "FROM lead)", 1).replace("';'", "chr(10) || '- '")}))
 SELECT name || CASE WHEN kind IN ('function', 'method') THEN '()' ELSE '' END || chr(10) || chr(10) || path || ':' || start_line
   || CASE WHEN handles = '' THEN '' ELSE chr(10) || chr(10) || 'Handles:' || chr(10) || '- ' || handles || chr(10) END AS text, 'extractive' AS mode, 'locate' AS intent,
  CASE WHEN s >= 4 AND f >= 3 THEN 'high' WHEN s >= 2 AND f >= 2 THEN 'medium' ELSE 'low' END AS confidence,
  'Retrieved ' || s || ' symbol' || CASE s WHEN 1 THEN '' ELSE 's' END || ' from ' || f || ' file' || CASE f WHEN 1 THEN '' ELSE 's' END AS retrieval_summary,
  (SELECT string_agg(path || ':' || start_line || '-' || end_line, ',' ORDER BY rank) FROM shown) AS cited FROM lead, told, counted"""


@query(ANSWERED)
def grounded_answer(spark, sf_dir):
    """A question answered with citations."""
    rows = retrieval.ask(views.stored_units(spark, sf_dir), views.stored_unit_edges(spark, sf_dir), QUESTION)
    return rows.select("text", "mode", "intent", "confidence", "retrieval_summary", F.array_join(F.transform("citations", lambda c: c["place"]), ",").alias("cited"))


@query(f"WITH {UNITS} SELECT path, symbol_id FROM (SELECT path, symbol_id, row_number() OVER (PARTITION BY path ORDER BY ord) AS k FROM symbols JOIN files USING (file_id)) WHERE k = 1")
def path_first_symbol(spark, sf_dir):
    """The first symbol of each file, as hotspots cite it."""
    rows = U.symbols_with_files(views.symbols(spark, sf_dir), views.files(spark, sf_dir))
    return rows.groupBy("path").agg(F.min(F.struct("ord", "symbol_id"))["symbol_id"].alias("symbol_id"))



"""Stored postings, adjacency and vectors answer as the tables they are made from; commits are whole."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.operators import adjacency, graph, history, narratives, persist, postings, resolve, retrieval, search
from lodestone.sources import git, store
from lodestone.sources.extract import Parser
from lodestone.streaming import jobs

WORDS = ("retryPayment", "handle_failure", "authToken", "x", "über", "status42", "Payments", "a_b", "log", "élan")
UNIT = "symbol_id string, file_id string, ord int, name string, kind string, path string, language string, start_line int, end_line int, text string"
EDGE = "source_id string, target_id string, kind string"


@pytest.fixture(scope="module")
def code(spark):
    rows = []
    for i in range(120):
        text = "\n".join(f"{WORDS[(i * 7 + k * k) % 10]}({WORDS[(i + k) % 10]}); // step {i % 13}" for k in range(i % 5 + 1))
        kind = ("function", "class", "component", "method")[i % 4]
        rows.append((f"s{i:03}", f"f{i % 9}", i, f"{WORDS[i % 10]}{i % 17}", kind, f"src/{('api', 'tests', 'components')[i % 3]}/f{i % 9}.ts", "typescript", i + 1, i + 3, text))
    units = spark.createDataFrame(rows, UNIT)
    edges = spark.createDataFrame([(f"s{(i * i + 3) % 120:03}", f"s{i:03}", ("calls", "imports", "contains")[i % 3]) for i in range(120)] + [(f"s{i:03}", "s005", "calls") for i in range(60, 100)], EDGE)
    posted = persist.persisted(postings.postings(units), "postings")
    lexicon = postings.Lexicon(postings.dealt(posted, "run"), postings.dealt(postings.grams(posted), "gram"))
    files = units.select("file_id", "path", "language").distinct()
    symbols = units.select("symbol_id", "file_id", "ord", "name", "kind", "start_line", "end_line")
    return units, edges, lexicon, adjacency.adjacency(edges), files, symbols


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("query", ["pay", "failure", "42", "token x", "ber", "step 1", "nothing here", "E", "  "])
def test_exact_search_over_postings(code, query):
    units, _, lexicon, _, files, symbols = code
    assert rows(search.exact_scores(symbols, files, units, query)) == rows(search.exact_scores(symbols, files, units, query, lexicon))
    plain, stored = (search.exact_search(symbols, files, units, query, lexicon=x) for x in (None, lexicon))
    assert [tuple(r) for r in plain.collect()] == [tuple(r) for r in stored.collect()]


@pytest.mark.parametrize("question", ["Where are failed payments retried?", "What does authToken break?", "How does the log work?", "zzz", "status42 handle"])
def test_retrieval_over_stored_tables(code, question):
    units, edges, lexicon, adjacent, _, _ = code
    vectors = search.embeddings(units)
    plain = retrieval.retrieve(units, edges, question)
    stored = retrieval.retrieve(units, edges, question, vectors.withColumn("part", F.col("bucket") % search.VECTOR_PARTS), lexicon, adjacent)
    assert [tuple(r) for r in plain.collect()] == [tuple(r) for r in stored.collect()]


def test_texts_are_not_read_with_postings(code):
    units, _, lexicon, _, _, _ = code
    stored = persist.persisted(units, "units")
    plan = retrieval.lexical_scores(stored, "payments", ["payments"], lexicon)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<symbol_id:string,ord:int,name:string>" in plan


def test_traversal_over_adjacency(code):
    _, edges, _, adjacent, _, _ = code
    for node in ("s005", "s000", "none"):
        assert rows(graph.impact(edges, node)) == rows(graph.impact(edges, node, stored=adjacent))
        assert rows(graph.impact(edges, node, max_nodes=7)) == rows(graph.impact(edges, node, max_nodes=7, stored=adjacent))
        assert rows(graph.neighborhood(edges, node, 2)) == rows(graph.neighborhood(edges, node, 2, adjacent))


def test_impact_questions_add_direct_dependents_and_components(spark):
    kinds = {"a": "function", "b": "function", "c": "component", "d": "function"}
    units = spark.createDataFrame([(k, "f", i, f"{k}{'loginFlow' if k == 'a' else 'zz'}", kind, f"src/x/{k}.ts", "typescript", 1, 2, "loginFlow" if k == "a" else "q") for i, (k, kind) in enumerate(kinds.items())], UNIT)
    edges = spark.createDataFrame([("b", "a", "calls"), ("d", "b", "calls"), ("c", "d", "calls")], EDGE)
    got = {r.symbol_id: r.score for r in retrieval.retrieve(units, edges, "What breaks if loginFlow changes?").collect()}
    assert got["b"] == 0.35 and got["c"] == 0.3 and "d" not in got


def test_a_stopped_write_changes_nothing(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path))
    table = lambda *names: spark.createDataFrame([(n,) for n in names], "path string")
    kept.commit("r", kept.write("r", {"files": table("a"), "symbols": table("s")}))
    half = kept.write("r", {"files": table("b")})
    assert rows(kept.load("files", "r")) == [("a",)]
    kept.commit("r", half)
    assert rows(kept.load("files", "r")) == [("b",)] and rows(kept.load("symbols", "r")) == [("s",)]
    for n in "cde":
        kept.commit("r", kept.write("r", {"files": table(n), "symbols": table(n)}))
    assert len(kept._names(kept.path("data", "r"))) == 2 and len(kept._names(kept.path("manifests", "r"))) == 2
    with pytest.raises(LookupError):
        kept.load("edges", "r")


def test_two_writers_lose_nothing(spark, tmp_path):
    stores = [store.Store(spark, str(tmp_path)) for _ in range(2)]

    def work(k):
        for i in range(3):
            stores[k].save_run(spark.createDataFrame([(f"run{k}{i}", "r", "src", "queued", "queued", None, i, None)], store.RUN_SCHEMA))
            stores[k].save(f"t{k}", spark.createDataFrame([(i,)], "n int"), "r")

    threads = [threading.Thread(target=work, args=(k,)) for k in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert {r.id for r in stores[0].latest("runs", store.RUN_SCHEMA).collect()} == {f"run{k}{i}" for k in range(2) for i in range(3)}
    stores[0].compact("runs")
    assert stores[1].latest("runs", store.RUN_SCHEMA).count() == 6 and len(stores[0]._names(stores[0].path("runs"))) == 1
    assert rows(stores[0].load("t0", "r")) == [(2,)] and rows(stores[0].load("t1", "r")) == [(2,)]


def test_a_source_has_one_run_at_a_time(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path))
    got = []
    threads = [threading.Thread(target=lambda k=k: got.append(kept.claim("src", f"run{k}"))) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(set(got)) == 1
    assert kept.claim("other", "x") == "x" and kept.claim("src", "late") == got[0]
    kept.release("src", got[0])
    assert kept.claim("src", "next") == "next"
    assert kept.claim("src", "after", now=9e9) == "after"
    engine = Engine(spark, str(tmp_path / "e"))
    first = engine.enqueue(str(tmp_path))
    assert engine.enqueue(f"{tmp_path}/.") == first and engine.job(first).first().status == "queued"


def test_sources_are_known_by_their_resolved_path(tmp_path):
    assert git.canonical(f"{tmp_path}/../{tmp_path.name}") == str(tmp_path.resolve()) and git.canonical("https://x/y.git") == "https://x/y.git"
    for spec in ("--upload-pack=touch /tmp/x", "ext::sh -c id", "nowhere"):
        with pytest.raises(ValueError, match="neither"):
            git.materialize(spec, str(tmp_path))


def test_history_reports(spark):
    touches = spark.createDataFrame(
        [(0, "aaaaaaaaaaaa", "Ann", "a@x", 3, "fix", ["src/a.ts", "src/b.ts"]), (1, "bbbbbbbbbbbb", "Bob", "b@x", 2, "add", ["src/a.ts"])],
        "ord int, sha string, author_name string, author_email string, authored_at long, subject string, paths array<string>",
    )
    branches = spark.createDataFrame([("dev", "1234567890abcdef", False), ("main", "fedcba0987654321", True)], "name string, sha string, is_default boolean")
    told = lambda route: narratives.evolution_report(touches, branches, route).first()["text"]
    assert told("authors") == "Authors\n\nAnn <a@x>\n1 commits · 2 file touches\n\nBob <b@x>\n1 commits · 1 file touches\n\n"
    assert told("branches") == "Branches\n\nmain (default)\nfedcba098765\n\ndev\n1234567890ab\n\n"
    assert told("commits") == "Recent commits\n\naaaaaaaa  fix\nAnn · 2 files\n\nbbbbbbbb  add\nBob · 1 files\n\n"
    assert told("hotspots") == "Files that change most frequently\n\nsrc/a.ts\nChanged 2 times\n2 contributors\n\nsrc/b.ts\nChanged 1 times\n1 contributors\n\n"
    assert narratives.hotspots_report(touches.limit(0)).first()["text"].endswith("No file history was collected for this repository.\n")
    nodes = spark.createDataFrame([("s1", 2, "late", "src/a.ts", 9, 12), ("s0", 1, "first", "src/a.ts", 1, 4)], "symbol_id string, ord int, name string, path string, start_line int, end_line int")
    answer = retrieval.ask_evolution(touches, branches, nodes, "Which files change most often?").first()
    assert answer.text.startswith("Files that change") and [(c.symbol_id, c.place, c.excerpt) for c in answer.citations] == [("s0", "src/a.ts:1-4", "Changed 2 times · 2 contributors")]
    assert answer.confidence == "low"
    with pytest.raises(retrieval.BadRequest):
        retrieval.ask_evolution(touches.limit(0), branches, nodes, "authors?")


def test_summaries_and_prompt(spark, code):
    units, edges, *_ = code
    files = spark.createDataFrame([("1", "src/api/a.ts", "typescript"), ("2", "src/hooks/b.ts", "typescript"), ("3", "w.py", "python")], "file_id string, path string, language string")
    assert narratives.outline_summary(files).first()["text"] == "Inferred from paths, not an LLM. Frontend — 1 file: Hooks (1). Backend — 1 file: Controllers (1). Other — 1 file: Other (1)"
    assert narratives.outline_summary(files.limit(0)).first()["text"] == "No architecture layers were detected from file paths."
    told = narratives.repository_summary(files, units, "pay").first()["text"]
    assert told == "pay has 3 files and 120 symbols. Inferred from paths, not an LLM. Frontend — 1 file: Hooks (1). Backend — 1 file: Controllers (1). Other — 1 file: Other (1). Languages: python 33%, typescript 67%."
    seen = []
    retrieval.ask(units, edges, "How does the log work?", lambda q, lines: seen.extend(lines) or "ok", files=files)
    assert seen[:4] == ["CODEBASE CONTEXT", "", "Architecture:", "- api (1)"] and "Relevant symbols:" in seen and "Relationships:" in seen
    assert any(x.startswith("- [citation:s") for x in seen)
    answer = retrieval.ask(units, edges, "How does the log work?").first()
    assert " is the primary entry, which connects to " in answer.text and "[citation:" not in answer.text


def test_scratch_is_kept_apart_by_thread(spark):
    df = spark.range(3)
    done = []

    def other():
        with persist.scratch():
            persist.persisted(df, "x")
        done.append(1)

    with persist.scratch():
        mine = persist.persisted(df, "y")
        t = threading.Thread(target=other)
        t.start()
        t.join()
        assert mine.count() == 3 and done
        short, long = persist.settled(mine, "short"), persist.settled(mine, "long", limit=2)
    assert short.count() == 3 and long.count() == 3
    with pytest.raises(Exception):
        mine.count()


def test_followers_get_snapshot_tail_and_what_they_missed(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def come(*events):
        rows = [(job, "r", f"s{ts}", f"m{ts}", None, ts, ts, None, None, None, None) for job, ts in events]
        spark.createDataFrame(rows, jobs.EVENT).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(jobs.EVENT).parquet(source)
        jobs.follow_stream(stream, out, str(tmp_path / "ck"), keep=4).awaitTermination(120)
        return spark.read.parquet(f"{out}/*")

    come(("a", 1), ("a", 3), ("b", 9))
    followed = come(("a", 2), ("a", 4), ("a", 5), ("a", 6))
    told = jobs.news(followed, "a").first()
    assert (told.n_events, told.missed, told.snapshot.stage, [e.ts for e in told.events]) == (6, 2, "s6", [3, 4, 5, 6])
    assert [(r.missed, [e.ts for e in r.events]) for r in (jobs.news(followed, "a", n).first() for n in (1, 4, 6, 9))] == [(1, [3, 4, 5, 6]), (0, [5, 6]), (0, []), (0, [])]
    assert jobs.news(followed, "b").first().snapshot.files == 9 and jobs.news(followed, "c").isEmpty()


@pytest.mark.parametrize("segment", [1, 3, 7])
def test_a_history_is_read_in_segments(spark, segment):
    sep = history.FIELD
    lines = ["lost path"]
    for i in range(9):
        lines += [sep.join([f"sha{i}", "n", "e", str(i), f"subject {i}"][: 3 if i == 4 else 5]), *[f"p{i}/{k}" for k in range(i % 4)]]
    table = spark.createDataFrame([(r, n, line) for r in ("x", "y") for n, line in enumerate(lines)], "repo string, ord int, line string")
    whole = history.parse_log(table)
    assert rows(history.parse_log(table, segment=segment)) == rows(whole)
    got = {(r.ord, r.sha): r.paths for r in whole.where("repo = 'x'").collect()}
    assert got == {(k, f"sha{i}"): [f"p{i}/{n}" for n in range(i % 4)] for k, i in enumerate(i for i in range(9) if i != 4)}


def test_edges_of_changed_files_are_those_of_all(spark):
    files = spark.createDataFrame([(f"f{i}", f"src/m{i}.ts", "typescript") for i in range(6)], "file_id string, path string, language string")
    symbols = [(f"s{i}{n}", f"f{i}", k, n, kind, 1 + 3 * k, 3 + 3 * k, box) for i in range(6) for k, (n, kind, box) in enumerate((("A", "class", None), ("m", "method", "A"), ("B", "class", None), (f"own{i}", "function", None)))]
    symbols = spark.createDataFrame(symbols, "symbol_id string, file_id string, ord int, name string, kind string, start_line int, end_line int, container string")
    imports = spark.createDataFrame([(f"f{i}", 0, f"./m{(i + 1) % 6}", [f"own{(i + 1) % 6}"] if i % 2 else []) for i in range(6)], "file_id string, ord int, module string, names array<string>")
    calls = spark.createDataFrame([(f"f{i}", n, name, 4) for i in range(6) for n, name in enumerate(("B", f"own{(i + 1) % 6}", "none"))], "file_id string, ord int, callee string, line int")
    heritage = spark.createDataFrame([(f"f{i}", 0, "A", parent, "extends") for i in range(6) for parent in ("B", f"own{(i + 1) % 6}")], "file_id string, ord int, child string, parent string, kind string")
    every = set(rows(resolve.resolve(files, symbols, imports, calls, heritage)))
    assert {("s0A", "s0B", "extends"), ("s0A", "s1own1", "extends"), ("s0m", "s0B", "calls"), ("s0A", "s0m", "contains"), ("s1B", "s2own2", "imports")} <= every
    changed = spark.createDataFrame([("f1",), ("f4",), ("f4",)], "file_id string")
    got = resolve.resolve_changed(files, symbols, imports, calls, heritage, changed)
    assert rows(got) == sorted(e for e in every if e[0][:2] in ("s1", "s4"))


def outline_of_ini(code):
    """Sections of a settings file as classes, their keys as constants within."""
    parts, at = [], None
    for n, line in enumerate(code.split("\n"), 1):
        name = line.strip("[] \t") if line.startswith("[") else line.partition("=")[0].strip()
        if line.startswith("["):
            at = len(parts)
        if line.startswith("[") or "=" in line:
            owner = None if line.startswith("[") else at
            parts.append({"kind": "class" if line.startswith("[") else "constant", "name": name, "head": line, "start_line": n, "end_line": n, "owner": owner, "arrow": False, "jsx": False, "given": False})
    return parts, code


def test_parsers_embedders_and_searchers_of_ones_own(spark, tmp_path):
    tree = tmp_path / "src"
    tree.mkdir()
    (tree / "a.ini").write_text("; [ghost]\nuse b.ini: limits\n[server]\nport = lookup(1)\n")
    (tree / "b.ini").write_text("[limits]\nmost = 3\n")
    (tree / "c.py").write_text("def lookup(x): return x\n")
    ini = Parser("ini", ("ini",), outline_of_ini, tokens=";[^\\n]*", module=r"^use (\S+?):\s*(.*)$")
    letters = lambda texts: [{k: float(t.count(chr(97 + k))) for k in range(26)} for t in texts]
    ranked = lambda units, query: units.select("symbol_id", "name", "path", "kind", F.lit(1.0).alias("score"), F.lit(query).alias("source"))
    engine = Engine(spark, str(tmp_path / "index"), parsers=(ini,), embedder=letters, searcher=ranked)
    key = engine.index(str(tree))
    got = {(r.name, r.kind, r.path) for r in engine.symbols(key).collect()}
    assert got == {("server", "class", "a.ini"), ("port", "constant", "a.ini"), ("limits", "class", "b.ini"), ("most", "constant", "b.ini"), ("lookup", "function", "c.py")}
    vectors = engine.store.load("embeddings", key)
    assert vectors.groupBy("symbol_id").agg(F.round(F.sum(F.col("weight") ** 2), 6).alias("n")).where("n <> 1").isEmpty() and vectors.count() > 5
    assert {r.source for r in engine.similar(key, "q").collect()} == {"q"}
    plain = Engine(spark, str(tmp_path / "index"), parsers=(ini,), embedder=letters)
    assert plain.similar(key, "most").first().score > 0.5 and plain.search(key, "most").first().name == "most"

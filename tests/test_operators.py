"""Graph, history, incremental and retrieval operators on small hand-made tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, health, history, incremental, resolve, retrieval, search
from lodestone.operators import units as U
from lodestone.sources import store
from lodestone.streaming import jobs

AUTH = [
    ("login", "method", "src/services/AuthService.ts"), ("useAuth", "function", "src/hooks/useAuth.ts"), ("AuthProvider", "component", "src/components/AuthProvider.tsx"),
    ("Dashboard", "component", "src/components/Dashboard.tsx"), ("logs_in_a_user", "function", "src/services/AuthService.test.ts"),
    ("sessionHandler", "function", "src/api/session.ts"), ("findUser", "method", "src/db/UserRepository.ts"),
]
AUTH_EDGES = [("useAuth", "login", "calls"), ("AuthProvider", "useAuth", "calls"), ("logs_in_a_user", "login", "calls"), ("sessionHandler", "login", "calls"), ("login", "findUser", "calls"), ("Dashboard", "AuthProvider", "imports")]


@pytest.fixture
def auth(spark):
    nodes = spark.createDataFrame([(n, n, k, p, p) for n, k, p in AUTH], "symbol_id string, name string, kind string, path string, file_id string")
    return nodes, spark.createDataFrame(AUTH_EDGES, "source_id string, target_id string, kind string")


def names(df, where="true"):
    return {r.symbol_id for r in df.where(where).collect()}


def test_neighbours(auth):
    nodes, edges = auth
    assert names(graph.neighbors(edges, "useAuth", "calls")) == {"login"}
    assert names(graph.dependents(edges, nodes, "login")) == {"useAuth", "logs_in_a_user", "sessionHandler"}
    assert names(graph.related(edges, nodes, "AuthProvider")) == {"useAuth", "Dashboard"}


def test_impact(auth):
    nodes, edges = auth
    report = graph.impact_report(edges, nodes, "login").cache()
    assert names(report, "direct") == {"useAuth", "logs_in_a_user", "sessionHandler"}
    assert {(r.symbol_id, r.depth) for r in report.where("indirect").collect()} == {("AuthProvider", 2), ("Dashboard", 3)}
    assert names(report, "is_test") == {"logs_in_a_user"} and names(report, "is_route") == {"sessionHandler"}
    assert names(report, "is_component") == {"AuthProvider", "Dashboard"}
    assert graph.impact_files(report).count() == 6
    told = retrieval.explain_impact(report).first()
    assert (told.direct, told.indirect, told.files) == (3, 2, 6)
    lines = told.narrative.split("\n")
    assert lines[0] == "Changing login() can affect 5 symbols across 6 files." and "- 1 API endpoint" in lines and "- 2 UI components" in lines and "- 1 test suite" in lines
    assert lines[6:8] == ["Direct dependents:", "\u2192 logs_in_a_user (src/services/AuthService.test.ts)"] and lines.count("\u2192 sessionHandler (src/api/session.ts)") == 2
    tree = graph.impact_tree(report).first()
    assert tree.origin.name == "login" and [c.name for c in tree.children][-1] == "Dashboard"


def test_layers_of_a_neighbourhood(auth):
    nodes, edges = auth
    assert {r.symbol_id: r.layer for r in graph.signed_layers(edges, "login", 1).collect()} == {"login": 0, "findUser": 1, "useAuth": -1, "logs_in_a_user": -1, "sessionHandler": -1}
    placed = {r.symbol_id: (r.x, r.y) for r in graph.layout(graph.signed_layers(edges, "login", 1), nodes).collect()}
    assert placed["findUser"] == (0.0, 118.0) and placed["login"] == (0.0, 0.0) and placed["logs_in_a_user"] == (-188.0, -118.0)


def test_health_of_the_auth_files(spark, auth):
    nodes, edges = auth
    files = nodes.select("path", F.col("path").alias("file_id"), F.lit("typescript").alias("language"))
    symbols = nodes.select("symbol_id", "file_id", "name", "kind", F.lit(1).alias("start_line"), F.lit(9).alias("end_line"))
    row = health.health(files, symbols, edges).first()
    assert (row.files, row.languages, row.test_files, row.test_symbols, row.endpoints, row.mapped, row.dependencies) == (7, 1, 1, 1, 1, 1.0, 1)
    assert {r.layer: r.n_files for r in health.layers(files).collect()} == {"api": 1, "services": 2, "repositories": 1, "components": 2, "hooks": 1}


def test_impact_depth_and_cap(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "calls") for i in range(40)], "source_id string, target_id string, kind string")
    assert graph.impact(chain, "n40").where("depth > 0").count() == 16
    star = spark.createDataFrame([(f"a{i}", "o", "calls") for i in range(500)], "source_id string, target_id string, kind string")
    assert graph.impact(star, "o").count() == 501
    more = star.unionByName(spark.createDataFrame([(f"b{i}", f"a{i}", "calls") for i in range(500)], star.schema))
    assert graph.impact(more, "o").count() == 501
    small = spark.createDataFrame([(f"a{i}", "o", "calls") for i in range(3)] + [(f"b{i}{j}", f"a{i}", "calls") for i in range(3) for j in range(300)], star.schema)
    assert graph.impact(small, "o").count() == 1 + 3 + 600  # the third parent finds 604 nodes visited


def test_signed_layers_like_brute_force(spark):
    rng = random.Random(5)
    pairs = sorted({(f"n{rng.randint(0, 14)}", f"n{rng.randint(0, 14)}") for _ in range(30)})
    pairs = [p for p in pairs if p[0] != p[1]]
    layers, front = {"n0": 0}, ["n0"]
    for _ in range(3):
        found: dict[str, list] = {}
        for a, b in pairs:
            if a in front and b not in layers:
                found.setdefault(b, []).append((-1, layers[a] + 1))
            if b in front and a not in layers:
                found.setdefault(a, []).append((1, layers[b] - 1))
        for n, options in found.items():
            layers[n] = min(options)[1]
        front = list(found)
    edges = spark.createDataFrame([(a, b, "calls") for a, b in pairs], "source_id string, target_id string, kind string")
    assert {r.symbol_id: r.layer for r in graph.signed_layers(edges, "n0", 3).collect()} == layers


TOUCHES = "ord int, sha string, author_name string, author_email string, authored_at long, subject string, paths array<string>"


def test_history(spark):
    rows = [(0, "d", "Ann", "A@x", 40, "s", ["src/s.ts", ".env"]), (1, "c", "Bob", "b@x", 40, "s", ["src/s.ts"]), (2, "b", "", "b@x", 20, "s", ["x"]), (3, "a", "Annie", "a@x", 10, "s", ["src/s.ts", "x"])]
    touches = spark.createDataFrame(rows, TOUCHES)
    spots = {r.path: r for r in history.hotspots(touches).collect()}
    assert set(spots) == {"src/s.ts", "x"}
    assert (spots["src/s.ts"].changes, spots["src/s.ts"].contributors, spots["src/s.ts"].last_sha) == (3, 2, "c")
    who = {r.email.lower(): r for r in history.authors(touches).collect()}
    assert (who["a@x"].name, who["a@x"].commits, who["a@x"].files_touched) == ("Ann", 2, 4)
    assert history.authors(touches.limit(0)).count() == 0


def test_parse_log(spark):
    head = lambda *f: history.FIELD.join(f)
    lines = [head("s1", "Ann", "a@x", "10", "one"), "", "crates/app/a.rs", "other/b.rs", head("s2", "Bob", "b@x", "9", "two"), head("s3", "C", "c@x", "8", "")]
    df = spark.createDataFrame([("", i, x) for i, x in enumerate(lines)], "repo string, ord int, line string")
    got = history.parse_log(df, "crates/app").orderBy("ord").collect()
    assert [(r.sha, r.authored_at, r.subject, r.paths) for r in got] == [("s1", 10, "one", ["a.rs", "other/b.rs"]), ("s2", 9, "two", []), ("s3", 8, "", [])]


def test_parse_log_drops_broken_headers(spark):
    head = lambda *f: history.FIELD.join(f)
    lines = ["early.rs", head("s1", "Ann", "a@x", "10", "one"), "a.rs", head("broken", "x"), "lost.rs", head("s2", "Bob", "b@x", "soon", "two"), "crates/app/", "b.rs"]
    df = spark.createDataFrame([("", i, x) for i, x in enumerate(lines)], "repo string, ord int, line string")
    got = history.parse_log(df, "crates/app").orderBy("ord").collect()
    assert [(r.ord, r.sha, r.authored_at, r.paths) for r in got] == [(0, "s1", 10, ["a.rs"]), (1, "s2", 0, ["b.rs"])]


def test_impact_citations(spark, auth):
    nodes, edges = auth
    report = graph.impact_report(edges, nodes, "login")
    units = nodes.select("symbol_id", "name", "path", F.lit(1).alias("ord"), F.lit(3).alias("start_line"), F.lit(9).alias("end_line"))
    rows = retrieval.impact_citations(report, units).collect()
    assert rows[0].symbol_id == "login" and rows[0].place == "src/services/AuthService.ts:3-9"
    assert [r.symbol_id for r in rows[1:]] == ["logs_in_a_user", "sessionHandler", "useAuth", "sessionHandler", "AuthProvider", "Dashboard"]


def test_levels_numbered_by_ranges(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("a"), F.concat(F.lit("n"), F.col("id")).alias("b"))
    got, size = graph.numbered(rows, "a", "b")
    want = sorted((r.a, r.b) for r in rows.collect())
    assert size == 1000 and [(r.a, r.b) for r in got.orderBy("idx").collect()] == want
    assert sorted(r.idx for r in got.collect()) == list(range(1, 1001))
    assert graph.numbered(rows.limit(0), "a", "b")[1] == 0


def test_name_status_and_porcelain(spark):
    lines = ["A\ta.ts", "M\tb.ts", "D\tc.ts", "R100\td.ts\te.ts", "C80\tf.ts\tg.ts", "T\th.ts", "X\tq", "R100\tonly", ""]
    df = spark.createDataFrame(list(enumerate(lines)), "ord int, line string")
    diff = history.parse_name_status(df)
    assert {r.path for r in history.parse_paths(diff).collect()} == {"a.ts", "b.ts", "e.ts", "g.ts", "h.ts"}
    assert {r.path for r in history.drop_paths(diff).collect()} == {"c.ts", "d.ts"}
    tree = history.parse_porcelain(spark.createDataFrame([(0, " M x.ts"), (1, "?? n.ts"), (2, " D z.ts"), (3, 'R  a -> "b c"')], "ord int, line string"))
    assert sorted((r.status, r.new_path or r.old_path) for r in tree.collect()) == [("added", "n.ts"), ("deleted", "z.ts"), ("modified", "b c"), ("modified", "x.ts")]


def test_plan_files(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("e", "1")], "path string, hash string")
    plain = {r.path: r.action for r in incremental.plan_files(old, new).collect()}
    assert plain == {"a": "skipped_by_hash", "b": "parse", "c": "skipped_by_hash", "d": "dropped", "e": "parse"}
    listed = spark.createDataFrame([("c",)], "path string")
    by_diff = {r.path: r.action for r in incremental.plan_files(old, new, changed=listed).collect()}
    assert by_diff == {"a": "skipped_by_diff", "b": "parse", "c": "skipped_by_hash", "d": "dropped", "e": "parse"}


def test_enclosing_symbol_is_the_smallest(spark):
    symbols = spark.createDataFrame([("f", 0, "s0", 1, 10), ("f", 1, "s1", 2, 5), ("f", 2, "s2", 3, 6), ("g", 0, "s3", 1, 99)], "file_id string, ord int, symbol_id string, start_line int, end_line int")
    calls = spark.createDataFrame([("f", 0, "x", 4), ("f", 1, "y", 9), ("f", 2, "z", 50)], "file_id string, ord int, callee string, line int")
    assert {r.callee: r.symbol_id for r in resolve.enclosing_symbols(calls, symbols).collect()} == {"x": "s1", "y": "s0"}


UNIT = "symbol_id string, file_id string, ord int, name string, kind string, path string, language string, start_line int, end_line int, text string"
PAYMENT = [
    ("u1", "f1", 1, "handleFailure", "method", "src/services/payment.ts", "typescript", 10, 16, "// retries failed payments\nthis.retryPayment(error)"),
    ("u2", "f1", 2, "processPayment", "method", "src/services/payment.ts", "typescript", 1, 8, "charge the card with stripe"),
    ("u3", "f2", 1, "AuthProvider", "component", "src/components/AuthProvider.tsx", "typescript", 1, 20, "login session context"),
]


@pytest.fixture
def payment(spark):
    units = spark.createDataFrame(PAYMENT, UNIT)
    return units, spark.createDataFrame([("u1", "u2", "calls")], "source_id string, target_id string, kind string")


def test_answers_lead_with_the_right_unit(payment):
    units, edges = payment
    row = retrieval.ask(units, edges, " Where are failed payments handled? ").first()
    assert row.intent == "locate" and row.mode == "extractive" and row.text.startswith("handleFailure()\n\nsrc/services/payment.ts:10\n\nHandles:\n- ")
    assert "AuthProvider" not in [c.path for c in row.citations] and row.citations[0].place == "src/services/payment.ts:10-16"
    auth = retrieval.ask(units, edges, "How does authentication work?").first()
    assert auth.text.startswith("AuthProvider")


def test_models_are_optional(payment):
    units, edges = payment
    told = retrieval.ask(units, edges, "Where are failed payments?", lambda q, s: "See [citation:u1].").first()
    assert told.mode == "generated" and told.text == "See src/services/payment.ts:10-16."
    for broken in (lambda q, s: " ", lambda q, s: 1 / 0):
        assert retrieval.ask(units, edges, "Where are failed payments?", broken).first().mode == "extractive"


@pytest.mark.parametrize("question", ["", "   ", "x" * 501])
def test_bad_questions(payment, question):
    with pytest.raises(retrieval.BadRequest):
        retrieval.ask(*payment, question)


def test_pack_budget_and_secrets(spark):
    rows = [(f"s{i}", "f", i, f"n{i}", "function", "src/a.ts", "typescript", 1, 2, "x" * 5000) for i in range(4)]
    rows += [("secret", "f", 9, "n", "function", "src/a.ts", "typescript", 1, 2, "API_KEY=1"), ("env", "g", 1, "n", "function", ".env", "typescript", 1, 2, "y")]
    units = spark.createDataFrame(rows, UNIT)
    ranked = units.select("symbol_id", (1.0 / F.col("ord")).alias("score"), "name").where("ord > 0")
    assert [r.symbol_id for r in retrieval.context_pack(ranked, units).orderBy("rank").collect()] == ["s1", "s2"]


def test_exact_search_order(spark):
    files = spark.createDataFrame([("f1", "src/auth.ts", "typescript"), ("f2", "login/x.ts", "typescript"), ("f3", "src/other.ts", "typescript")], "file_id string, path string, language string")
    symbols = spark.createDataFrame([("a", "f1", 1, "userLogin", "function"), ("b", "f2", 1, "other", "function"), ("c", "f3", 1, "thing", "class"), ("d", "f3", 2, "none", "class")], "symbol_id string, file_id string, ord int, name string, kind string")
    units = spark.createDataFrame([("c", 1, "calls login here"), ("d", 2, "nothing")], "symbol_id string, ord int, text string")
    got = [(r.symbol_id, r.score, r.source) for r in search.exact_search(symbols, files, units, " LOGIN ").collect()]
    assert got == [("a", 1.0, "symbolName"), ("b", 0.7, "path"), ("c", 0.45, "text")]
    assert search.exact_search(symbols, files, units, "  ").count() == 0
    assert [r.symbol_id for r in search.symbol_list(symbols, files, units, kind="class").collect()] == ["d", "c"]
    with pytest.raises(ValueError, match="kind"):
        search.symbol_list(symbols, files, units, kind="nope")
    assert [r.symbol_id for r in U.like_search(symbols, files, "t_in").collect()] == ["c"]
    assert [r.symbol_id for r in U.like_search(symbols, files, "h_n").collect()] == ["c"]


def test_limits(spark):
    files = spark.createDataFrame([("a", 10), ("b", 0), ("c", 5000)], "path string, size_bytes long")
    assert {r.path for r in U.check_limits(files, max_file=100).collect()} == {"a"}
    with pytest.raises(ValueError, match="too many"):
        U.check_limits(files, max_files=1)
    with pytest.raises(ValueError, match="too many"):
        U.check_limits(files, max_bytes=10)


def test_runs_and_store(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "s"))
    assert kept.repositories().count() == 0 and not kept.has("files")
    row = lambda rid, status, at: spark.createDataFrame([(rid, "r", f"src{at}", status, status, None, at, None)], store.RUN_SCHEMA)
    kept.save_run(row("a", "queued", 1))
    kept.save_run(row("a", "succeeded", 2))
    kept.save_run(row("b", "parsing", 3))
    rows = {r.id: r for r in kept.latest("runs", store.RUN_SCHEMA).collect()}
    assert (rows["a"].status, rows["a"].source, rows["a"].started_at) == ("succeeded", "src1", 1) and rows["b"].status == "parsing"
    asked = spark.createDataFrame([("src3",), ("src1",)], "source string")
    assert [r.source for r in jobs.startable(asked, kept.latest("runs", store.RUN_SCHEMA)).collect()] == ["src1"]
    for repo, names_ in (("r1", ["a", "b"]), ("r2", ["c"]), ("r1", ["z"])):
        kept.save("files", spark.createDataFrame([(n,) for n in names_], "path string"), repo)
    assert [r.path for r in kept.load("files", "r1").collect()] == ["z"] and [r.path for r in kept.load("files", "r2").collect()] == ["c"]
    plan = kept.load("files", "r1")._jdf.queryExecution().executedPlan().toString()
    assert "/data/r1/" in plan and "/data/r2/" not in plan
    old = spark.createDataFrame([(1,)], "a int")
    assert store.migrate(old, {"a": "b"}, {"c": "string"}).columns == ["b", "c"]


def test_progress_stream(spark, tmp_path):
    schema = "job_id string, ts long, stage string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    for rows in ([("a", 1, "queued"), ("b", 1, "queued")], [("a", 3, "succeeded"), ("a", 2, "parsing"), ("c", 1, "queued")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.progress_stream(stream(), out, str(tmp_path / "ck")).awaitTermination(60)
    got = {r.job_id: r.stage for r in spark.read.parquet(f"{out}/snapshot=1").collect()}
    assert got == {"a": "succeeded", "b": "queued", "c": "queued"}
    query = jobs.progress_state(stream()).writeStream.outputMode("complete").format("memory").queryName("progress").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r.job_id: r.stage for r in spark.sql("select * from progress").collect()} == got

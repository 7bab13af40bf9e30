"""The engine: index repositories into tables, and answer the service's queries over them.

Every answer is a DataFrame. Unknown things raise ``NotFound``, bad arguments
``BadRequest``.
"""

from __future__ import annotations

import subprocess
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import adjacency, graph, health, history, incremental, narratives, postings, resolve, retrieval, search
from .operators import units as U
from .operators.persist import persisted, scratch, settled, shared_dir, ship
from .operators.retrieval import BadRequest, NotFound
from .sources import git, tree
from .sources.extract import Parser, extract
from .sources.store import REPOSITORY_SCHEMA, RUN_SCHEMA, Store
from .streaming import jobs


PROGRESS = threading.Lock()
"""One reader of a session at a time takes up new events: they share a checkpoint."""


class Engine:
    def __init__(
        self, spark: SparkSession, root: str, cache: str | None = None, parsers: tuple[Parser, ...] = (), embedder: search.Embedder | None = None,
        searcher: Callable[[DataFrame, str], DataFrame] | None = None,
    ):
        """``root`` holds the index. Clones go to ``cache``, a local path that all executors see: by default one within the shared folder.

        ``parsers`` add languages, ``embedder`` makes the vectors of units and questions, and ``searcher`` takes the place
        of semantic search: (units, query) -> symbol_id, name, path, kind, score, source.
        """
        ship(spark)
        self.spark, self.store, self.cache = spark, Store(spark, root), cache
        self.parsers, self.embedder, self.searcher = tuple(parsers), embedder, searcher

    def _cache(self) -> str:
        if self.cache is None:
            shared = shared_dir(self.spark)
            if "://" in shared and not shared.startswith("file://"):
                raise BadRequest("clones need a cache folder that driver and executors mount")
            self.cache = f"{shared.removeprefix('file://')}/lodestone-sources"
        return self.cache

    # indexing

    def _run(self, run_id: str, source: str, stage: str, started: int, repository_id: str | None = None, error: str | None = None) -> None:
        finished = int(time.time()) if stage in jobs.TERMINAL else None
        row = (run_id, repository_id, source, stage, stage, error, started, finished)
        self.store.save_run(self.spark.createDataFrame([row], RUN_SCHEMA))
        self._event(run_id, stage, f"{stage} {source}", repository_id, error)

    def _event(self, run_id: str, stage: str, message: str, repository_id: str | None = None, error: str | None = None, **counters: int) -> None:
        """Tell what a run does, to who follows it."""
        row = (run_id, repository_id, stage, message, error, time.time_ns() // 1000, *(counters.get(c) for c in jobs.COUNTERS))
        self.store.append("events", self.spark.createDataFrame([row], jobs.EVENT))

    def progress(self, run_id: str, seen: int = 0) -> DataFrame:
        """For a reader that has seen so many events of a run: the snapshot, newer events, and how many of them are gone.

        What has come since the last call, by whoever, is taken up first.
        """
        events = self.spark.readStream.schema(jobs.EVENT).option("recursiveFileLookup", True).parquet(self.store.path("events"))
        out = self.store.path("progress")
        with PROGRESS:
            jobs.follow_stream(events, out, self.store.path("progress-state")).awaitTermination()
        found = jobs.news(self.spark.read.parquet(f"{out}/*"), run_id, seen)
        if found.isEmpty():
            raise NotFound(f"no job {run_id}")
        return found

    def index(self, source: str, repository_id: str | None = None) -> str:
        """Index a folder or a repository URL; a known one is indexed anew where it changed. Returns its id.

        A source that is being indexed isn't indexed twice: the run under way is waited for.
        """
        url = git.canonical(source)
        run_id = str(uuid.uuid4())
        holder = self.store.claim(url, run_id)
        if holder != run_id:
            return self._wait(holder)
        try:
            with scratch():
                return self._index(url, repository_id, run_id)
        finally:
            self.store.release(url, run_id)

    def enqueue(self, source: str) -> str:
        """The run that would index a source now: the one under way, or a new one, which is recorded as queued."""
        url, run_id = git.canonical(source), str(uuid.uuid4())
        holder = self.store.claim(url, run_id)
        if holder == run_id:
            self._run(run_id, url, "queued", int(time.time()))
        return holder

    def run(self, run_id: str) -> str:
        """Do what ``enqueue`` recorded; returns the repository's id."""
        row = self.job(run_id).first()
        try:
            with scratch():
                return self._index(row["source"], None, run_id)
        finally:
            self.store.release(row["source"], run_id)

    def _wait(self, run_id: str, seconds: float = 3600) -> str:
        until = time.time() + seconds
        while time.time() < until:
            row = self.runs().where(F.col("id") == run_id).first()
            if row is not None and row["status"] == "succeeded":
                return row["repository_id"]
            if row is not None and row["status"] == "failed":
                raise RuntimeError(row["error"])
            time.sleep(0.5)
        raise TimeoutError(f"run {run_id} hasn't ended")

    def _index(self, source: str, repository_id: str | None, run_id: str) -> str:
        started = int(time.time())
        self._run(run_id, source, "queued", started)
        try:
            known = self.store.by_url(source).first()
            key = known["id"] if known else repository_id or str(uuid.uuid4())
            self._run(run_id, source, "scanning", started, key)
            where = git.materialize(source, self._cache())
            prefix = git.prefix_of(where["root"])
            files = persisted(tree.walk(self.spark, where["root"], repository_id=key, more={e: p.language for p in self.parsers for e in p.extensions}, **tree.limits()), "files")
            stage = lambda name: self._run(run_id, source, name, started, key)
            if known and self.store.has("files", key):
                tables, lines = self._refresh(files, key, self._changes(where, known, prefix), stage)
            else:
                tables, lines = self._extract_all(files, stage)
            stage("persisting")
            self._event(run_id, "persisting", f"{lines} lines", key, lines=lines, **{c: tables[c].count() for c in ("files", "symbols", "edges", "units") if c in tables})
            if tables:
                posted = persisted(postings.postings(tables["units"]), "postings")
                tables |= {"postings": postings.dealt(posted, "run"), "grams": postings.dealt(postings.grams(posted), "gram"), "adjacency": adjacency.adjacency(persisted(tables["edges"], "edges"))}
            past = {"touches": git.touches(self.spark, where["root"], prefix), "branches": git.branches(self.spark, where["root"])}
            # all tables become current at once
            self.store.commit(key, self.store.write(key, {**tables, **past}))
            row = (key, where["name"], where["url"], where["branch"], where["sha"], known["created_at"] if known else started, lines)
            self.store.save_repository(self.spark.createDataFrame([row], REPOSITORY_SCHEMA))
        except Exception as problem:
            self._run(run_id, source, "failed", started, error=str(problem)[:500])
            raise
        self._run(run_id, source, "succeeded", started, key)
        return key

    def _changes(self, where: dict[str, str], known, prefix: str) -> DataFrame | None:
        """What version control says has changed since the last index; None if it can't tell."""
        try:
            return persisted(git.changes(self.spark, where["root"], known["commit_sha"], where["sha"], prefix), "changes")
        except subprocess.CalledProcessError:
            return None

    @staticmethod
    def _lines(files: DataFrame) -> DataFrame:
        return files.select("file_id", F.size(X.lines(F.col("text"))).alias("n_lines"))

    def _extract_all(self, files: DataFrame, stage: Callable[[str], None]) -> tuple[dict[str, DataFrame], int]:
        stage("parsing")
        facts = {name: persisted(rows, name) for name, rows in extract(files, self.parsers).items()}
        symbols = facts["symbols"]
        stage("resolving")
        edges = resolve.resolve(files, symbols, facts["imports"], facts["calls"], facts["heritage"])
        stage("embedding")
        units = persisted(U.build_units(symbols, files), "units")
        lines = incremental.line_count(self._lines(files)).first()["lines"]
        return {"files": files, "symbols": symbols, "edges": edges, "units": units, "embeddings": search.embeddings(units, embedder=self.embedder)}, int(lines)

    def _refresh(self, files: DataFrame, key: str, diff: DataFrame | None, stage: Callable[[str], None]) -> tuple[dict[str, DataFrame], int]:
        """Only files that are new or whose hash changed are extracted; the rest of the index is reused, all of it if nothing changed."""
        old = {name: self.store.load(name, key) for name in ("files", "symbols", "edges", "units", "embeddings")}
        listed = (None, None) if diff is None else (history.parse_paths(diff), history.drop_paths(diff))
        plan = persisted(incremental.plan_files(old["files"], files, *listed), "plan")
        todo = files.join(plan.where("action = 'parse'"), "path", "left_semi")
        skipped = files.join(plan.where("action like 'skipped%'"), "path", "left_semi").select("file_id")
        lines = incremental.line_count(self._lines(todo), old["symbols"].join(skipped, "file_id", "left_semi")).first()["lines"]
        if plan.where("action in ('parse', 'dropped')").isEmpty():
            return {}, int(lines)
        stage("parsing")
        changed = persisted(todo.select("file_id"), "changed")
        facts = {name: persisted(rows, name) for name, rows in extract(todo, self.parsers).items()}
        symbols = persisted(incremental.merge_symbols(old["symbols"], facts["symbols"], files, changed), "symbols")
        stage("resolving")
        fresh = resolve.resolve_changed(files, symbols, facts["imports"], facts["calls"], facts["heritage"], changed)
        edges = incremental.merge_edges(old["edges"], fresh, symbols, changed)
        stage("embedding")
        units = persisted(incremental.reuse_units(old["units"], U.build_units(facts["symbols"], files), files, changed), "units")
        kept, missing = incremental.reuse_embeddings(old["embeddings"], units, changed)
        vectors = kept.unionByName(search.embeddings(missing, embedder=self.embedder).select(*kept.columns))
        return {"files": files, "symbols": symbols, "edges": edges, "units": units, "embeddings": vectors}, int(lines)

    def reindex(self, repository_id: str) -> str:
        return self.index(self._repository(repository_id)["url"])

    # reading

    def _repository(self, repository_id: str):
        found = self.store.repositories().where(F.col("id") == repository_id).first()
        if found is None:
            raise NotFound(f"no repository {repository_id}")
        return found

    def _load(self, repository_id: str, *names: str) -> list[DataFrame]:
        self._repository(repository_id)
        return [self.store.load(n, repository_id) for n in names]

    def _nodes(self, repository_id: str) -> DataFrame:
        symbols, files = self._load(repository_id, "symbols", "files")
        return U.symbols_with_files(symbols, files)

    def repositories(self) -> DataFrame:
        """Repositories by name, one per URL."""
        rows = self.store.repositories()
        return U.dedup_keep_first(rows, "url", "name", F.desc("created_at"), "id").orderBy("name")

    def overview(self, repository_id: str) -> DataFrame:
        files, symbols, edges = self._load(repository_id, "files", "symbols", "edges")
        return health.health(files, symbols, edges)

    def languages(self, repository_id: str) -> DataFrame:
        return health.languages(self._load(repository_id, "files")[0]).orderBy("place")

    def layers(self, repository_id: str) -> DataFrame:
        return health.layers(self._load(repository_id, "files")[0]).orderBy("place")

    def files(self, repository_id: str) -> DataFrame:
        return self._load(repository_id, "files")[0].drop("text").orderBy("path")

    def contents(self, repository_id: str, path: str) -> DataFrame:
        files = self._load(repository_id, "files")[0]
        try:
            found = tree.contents(files, path)
        except ValueError as problem:
            raise BadRequest(str(problem)) from problem
        if found.isEmpty():
            raise NotFound(f"no file {path}")
        return found

    def symbols(self, repository_id: str, query: str | None = None, kind: str | None = None) -> DataFrame:
        symbols, files, units = self._load(repository_id, "symbols", "files", "units")
        try:
            return search.symbol_list(symbols, files, units, query, kind, self._lexicon(repository_id))
        except ValueError as problem:
            raise BadRequest(str(problem)) from problem

    def _lexicon(self, repository_id: str) -> postings.Lexicon:
        return postings.Lexicon(*self._load(repository_id, "postings", "grams"))

    def search(self, repository_id: str, query: str) -> DataFrame:
        symbols, files, units = self._load(repository_id, "symbols", "files", "units")
        vectors = self.store.load("embeddings", repository_id, parts=True)
        return search.hybrid_search(symbols, files, units, query, vectors=vectors, lexicon=self._lexicon(repository_id), embedder=self.embedder)

    def similar(self, repository_id: str, query: str) -> DataFrame:
        """Semantic search by itself, or what was given in its place."""
        units = self._load(repository_id, "units")[0]
        if self.searcher is not None:
            return self.searcher(units, query)
        return search.semantic_search(units, query, vectors=self.store.load("embeddings", repository_id, parts=True), embedder=self.embedder)

    def graph(self, repository_id: str, focus: str | None = None, depth: int = 2, full: bool = False) -> tuple[DataFrame, DataFrame]:
        """Nodes and the edges among them: all (without coordinates), or those around a symbol or the 48 best connected, placed."""
        nodes, (edges, adjacent) = self._nodes(repository_id), self._load(repository_id, "edges", "adjacency")
        if full:
            return nodes, edges
        with scratch():
            if focus is None:
                view = settled(graph.compact_view(edges, nodes), "view")
                inner, placed = graph.induced(edges, view), graph.compact_layout(edges, view)
                return nodes.join(settled(placed, "placed"), "symbol_id"), settled(inner, "inner")
            self._symbol(nodes, focus)
            kept = settled(graph.neighborhood(edges, focus, depth, adjacent), "hood").select("symbol_id")
            inner = settled(graph.induced(edges, kept), "inner")
            placed = graph.layout(graph.signed_layers(inner, focus, max(depth, 1)), nodes)
            return nodes.join(settled(placed, "placed"), "symbol_id"), inner

    def _symbol(self, nodes: DataFrame, symbol_id: str):
        found = nodes.where(F.col("symbol_id") == symbol_id).first()
        if found is None:
            raise NotFound(f"no symbol {symbol_id}")
        return found

    def impact(self, repository_id: str, symbol_id: str) -> DataFrame:
        nodes, (edges, adjacent) = self._nodes(repository_id), self._load(repository_id, "edges", "adjacency")
        self._symbol(nodes, symbol_id)
        with scratch():
            return settled(graph.impact_report(edges, nodes, symbol_id, graph.MAX_NODES, stored=adjacent), "impact").orderBy("depth", "name", "symbol_id")

    def explain(self, repository_id: str, symbol_id: str) -> DataFrame:
        """What a symbol is and does, with the place of its unit as a citation."""
        self._symbol(self._nodes(repository_id), symbol_id)
        return retrieval.explain_symbol(*self._load(repository_id, "symbols", "files", "units", "edges"), symbol_id)

    def explain_impact(self, repository_id: str, symbol_id: str) -> DataFrame:
        """Counts, the narrative and its citations."""
        report = self.impact(repository_id, symbol_id)
        places = retrieval.impact_citations(report, self._load(repository_id, "units")[0])
        entry = F.struct("list", "depth", "name", "symbol_id", "place", "key")
        cited = places.agg(F.array_sort(F.collect_list(entry)).alias("citations"))  # seven at most
        return retrieval.explain_impact(report).crossJoin(cited)  # one row each

    def dependencies(self, repository_id: str, symbol_id: str) -> DataFrame:
        return graph.dependencies(self._load(repository_id, "edges")[0], self._nodes(repository_id), symbol_id).orderBy("name")

    def dependents(self, repository_id: str, symbol_id: str) -> DataFrame:
        return graph.dependents(self._load(repository_id, "edges")[0], self._nodes(repository_id), symbol_id).orderBy("name")

    def related(self, repository_id: str, symbol_id: str) -> DataFrame:
        return graph.related(self._load(repository_id, "edges")[0], self._nodes(repository_id), symbol_id).orderBy("name")

    def outline(self, repository_id: str) -> DataFrame:
        """One row: the layers of the repository in a sentence."""
        return narratives.outline_summary(self._load(repository_id, "files")[0])

    def summary(self, repository_id: str) -> DataFrame:
        """One row: the repository in three sentences."""
        files, symbols = self._load(repository_id, "files", "symbols")
        return narratives.repository_summary(files, symbols, self._repository(repository_id)["name"])

    def symbol(self, symbol_id: str) -> DataFrame:
        """A symbol of any repository."""
        found = self.store.everything("symbols").where(F.col("symbol_id") == symbol_id)
        if found.isEmpty():
            raise NotFound(f"no symbol {symbol_id}")
        files = self.store.everything("files").select("repository_id", "file_id", "path", "language")
        return found.join(files, ["repository_id", "file_id"])

    def ask(self, repository_id: str, question: str, model: retrieval.Model | None = None) -> DataFrame:
        units, edges, touches, branches, files, adjacent = self._load(repository_id, "units", "edges", "touches", "branches", "files", "adjacency")
        vectors = self.store.load("embeddings", repository_id, parts=True)
        question = retrieval.check_question(question)
        with scratch():
            if retrieval.intent_of(units, question) == "evolution":
                return retrieval.ask_evolution(touches, branches, self._nodes(repository_id), question)
            return retrieval.ask(units, edges, question, model, vectors, self._lexicon(repository_id), adjacent, files, self.embedder)

    def evolution(self, repository_id: str) -> dict[str, DataFrame]:
        touches, branches = self._load(repository_id, "touches", "branches")
        return {
            "commits": history.commits(touches).orderBy("ord"),
            "authors": history.authors(touches),
            "hotspots": history.hotspots(touches),
            "branches": branches.orderBy(F.desc("is_default"), "name"),
        }

    def runs(self) -> DataFrame:
        return self.store.latest("runs", RUN_SCHEMA)

    def job(self, run_id: str) -> DataFrame:
        found = self.runs().where(F.col("id") == run_id)
        if found.isEmpty():
            raise NotFound(f"no job {run_id}")
        return found

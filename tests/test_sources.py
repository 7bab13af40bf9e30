"""Walking, extraction and the whole engine on a small source tree of our own."""

from __future__ import annotations

import subprocess

import pytest

from lodestone.engine import Engine
from lodestone.operators.retrieval import BadRequest, NotFound
from lodestone.sources import extract, git, tree

SOURCES = {
    "src/services/orders.ts": """import { Mailer } from '../clients/mail';
import type { Order as Item } from "./types";
import fs from 'fs';

export const MAX_ITEMS = 5;

export class OrderService extends Base implements Closable {
  constructor(private mailer: Mailer) {}

  // sends "mail {" when paid
  async place(order: Item) {
    if (order) {
      this.check(order);
    }
    return this.mailer.send(new Thing(order));
  }

  private check(order: Item) { return order; }
}

/* function hidden() {
} */
export const total = (items: number[]) => {
  return items.reduce((a, b) => a + b, 0);
};

export function load(id: string) {
  const found = total([1]);
  return fs.readFile(id);
}
""",
    "src/clients/mail.ts": "export class Mailer {\n  send(x) {\n    return post(x);\n  }\n}\n",
    "src/components/Button.tsx": "import { load } from '../services/orders';\n\nexport function Button() {\n  load('x');\n  return <button>Pay</button>;\n}\nexport interface Props { a: string }\nenum Color { Red }\n",
    "src/jobs/sync.py": '''"""Sync."""
import os, json as js
from db.repository import Repo as R, Other
from .util import *

TIMEOUT = 3
LIMIT2 = 4


class Sync(Service, base.Mixin):
    """A job."""

    def run(self, n):
        helper(n)
        return js.dumps(n)

    async def stop(self):
        pass


def helper(n):

    return os.path.join("a", n)
''',
    "src/auth.rs": """use std::fmt;
use crate::db::{Repo, User as Account, self};

pub struct Auth<'a> { name: &'a str }

pub trait Store {
    fn find(&self, id: u32) -> Option<u32>;
}

impl Store for Auth<'_> {
    fn find(&self, id: u32) -> Option<u32> {
        lookup(id)
    }
}

pub const LIMIT: u32 = 3;

pub fn boot() {
    let a = Auth { name: "x" };
    a.find(1);
    Repo::open(2);
}
""",
    ".env": "API_KEY=1\n",
    "node_modules/x/index.js": "function no() {}\n",
    "ignored/skip.ts": "export function no() {}\n",
    "README.md": "text\n",
    "empty.ts": "",
    ".gitignore": "ignored/\n*.log\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree") / "shop"
    for path, text in SOURCES.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text(text)
    run(str(base), "init", "-q", "-b", "main")  # ignore files count within a repository only
    return str(base)


@pytest.fixture(scope="module")
def facts(spark, root):
    files = tree.walk(spark, root).cache()
    found = extract.extract(files)
    paths = {r.file_id: r.path for r in files.collect()}
    return {name: [(paths[r.file_id].rpartition("/")[2], r) for r in rows.collect()] for name, rows in found.items()}


def test_walk_keeps_hidden_names_and_nested_ignore_rules(spark, tmp_path):
    kept = ["pkg/b.py", "pkg/__init__.py", "pkg/_private.py", "src/__tests__/a.ts", ".github/tool.js", "sub/keep/x.py", "sub/deep/build_me.py", "odd name+%41.py"]
    gone = [
        "sub/gen/x.py", "sub/x_gen.py", "sub/deep/local.py", "top.gen.ts", "secrets/a.py", "node_modules/a.js", "docs/a/b/c.py", "excluded.py",
        "sub/dotignored.py", "empty.py", "a.txt",
    ]
    for name in kept + gone:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if name == "empty.py" else "x = 1\n")
    (tmp_path / ".git/info").mkdir(parents=True)
    (tmp_path / ".git/info/exclude").write_text("excluded.py\nsub/keep/\n")
    (tmp_path / ".gitignore").write_text("# made\n*.gen.ts\n/local.py\ndocs/**/c.py\n")
    (tmp_path / "sub/.gitignore").write_text("gen/\n*_gen.py\nkeep/\n!keep/\ndeep/l[a-o]cal.py\n")
    (tmp_path / "sub/.ignore").write_text("dotignored.py\n")
    assert sorted(r.path for r in tree.walk(spark, str(tmp_path)).collect()) == sorted(kept)
    with pytest.raises(ValueError):
        tree.walk(spark, str(tmp_path), max_files=len(kept) - 1)
    assert tree.walk(spark, str(tmp_path), max_files=len(kept)).count() == len(kept)


def test_walk(spark, root):
    rows = tree.walk(spark, root).collect()
    assert sorted(r.path for r in rows) == ["src/auth.rs", "src/clients/mail.ts", "src/components/Button.tsx", "src/jobs/sync.py", "src/services/orders.ts"]
    assert all(r.text == SOURCES[r.path] and r.size_bytes == len(r.text.encode()) for r in rows)
    with pytest.raises(ValueError, match="too many"):
        tree.walk(spark, root, max_files=2)


def test_symbols(facts):
    got = {(f, r.name, r.kind, r.start_line, r.end_line, r.container) for f, r in facts["symbols"]}
    assert got == {
        ("orders.ts", "MAX_ITEMS", "constant", 5, 5, None), ("orders.ts", "OrderService", "class", 7, 19, None),
        ("orders.ts", "place", "method", 11, 16, "OrderService"), ("orders.ts", "check", "method", 18, 18, "OrderService"),
        ("orders.ts", "total", "function", 23, 25, None), ("orders.ts", "load", "function", 27, 30, None), ("orders.ts", "found", "variable", 28, 28, None),
        ("mail.ts", "Mailer", "class", 1, 5, None), ("mail.ts", "send", "method", 2, 4, "Mailer"),
        ("Button.tsx", "Button", "component", 3, 6, None), ("Button.tsx", "Props", "interface", 7, 7, None), ("Button.tsx", "Color", "enum", 8, 8, None),
        ("sync.py", "TIMEOUT", "constant", 6, 6, None), ("sync.py", "Sync", "class", 10, 18, None), ("sync.py", "run", "method", 13, 15, "Sync"),
        ("sync.py", "stop", "method", 17, 18, "Sync"), ("sync.py", "helper", "function", 21, 23, None),
        ("auth.rs", "Auth", "struct", 4, 4, None), ("auth.rs", "Store", "trait", 6, 8, None),
        ("auth.rs", "find", "method", 11, 13, "Auth"), ("auth.rs", "LIMIT", "constant", 16, 16, None), ("auth.rs", "boot", "function", 18, 22, None),
    }


def test_imports(facts):
    assert {(f, r.module, tuple(r.names)) for f, r in facts["imports"]} == {
        ("orders.ts", "../clients/mail", ("Mailer",)), ("orders.ts", "./types", ("Item",)), ("orders.ts", "fs", ("fs",)), ("Button.tsx", "../services/orders", ("load",)),
        ("sync.py", "os", ("os",)), ("sync.py", "json", ("js",)), ("sync.py", "db.repository", ("R", "Other")), ("sync.py", ".util", ()),
        ("auth.rs", "std", ("fmt",)), ("auth.rs", "crate::db", ("Repo", "User")),
    }


def test_calls_and_heritage(facts):
    calls = {(f, r.callee, r.line) for f, r in facts["calls"]}
    assert {("orders.ts", "check", 13), ("orders.ts", "send", 15), ("orders.ts", "reduce", 24), ("orders.ts", "total", 28), ("Button.tsx", "load", 4), ("sync.py", "helper", 14), ("sync.py", "dumps", 15), ("auth.rs", "lookup", 12), ("auth.rs", "find", 20), ("auth.rs", "open", 21)} <= calls
    assert not {c for _, c, _ in calls} & {"Thing", "if", "place", "hidden", "Sync"}
    assert {(r.child, r.parent, r.kind) for _, r in facts["heritage"]} == {("OrderService", "Base", "extends"), ("OrderService", "Closable", "implements"), ("Sync", "Service", "extends"), ("Sync", "Mixin", "extends"), ("Auth", "Store", "implements")}


def run(root, *args):
    subprocess.run(["git", "-C", root, "-c", "user.name=Ann", "-c", "user.email=a@x", *args], check=True, capture_output=True)


def test_engine_end_to_end(spark, root, tmp_path):
    run(root, "init", "-q", "-b", "main")
    run(root, "add", "src", ".gitignore")
    run(root, "commit", "-q", "-m", "first")
    engine = Engine(spark, str(tmp_path / "store"))
    key = engine.index(root)
    assert [r.name for r in engine.repositories().collect()] == ["shop"]
    assert engine.files(key).count() == 5 and engine.overview(key).first().symbols == 22
    nodes = {r.name: r.symbol_id for r in engine._nodes(key).collect()}
    edges = {(r.source_id, r.target_id, r.kind) for r in engine.store.load("edges", key).collect()}
    assert (nodes["Button"], nodes["load"], "calls") in edges and (nodes["Button"], nodes["load"], "imports") in edges
    assert (nodes["OrderService"], nodes["place"], "contains") in edges and (nodes["place"], nodes["check"], "calls") in edges
    assert (nodes["place"], nodes["send"], "calls") in edges and (nodes["Auth"], nodes["Store"], "implements") in edges
    # the call stands in the declaration of a local variable, which is the smallest symbol around it
    assert {r.name for r in engine.impact(key, nodes["total"]).where("depth > 0").collect()} == {"found"}
    assert {r.name for r in engine.impact(key, nodes["load"]).where("depth > 0").collect()} == {"Button", "Props", "Color"}
    assert engine.search(key, "OrderService").first().name == "OrderService"
    assert {r.name for r in engine.dependents(key, nodes["load"]).collect()} >= {"Button"}
    assert engine.explain(key, nodes["place"]).first().place == "src/services/orders.ts:11-16"
    assert engine.symbol(nodes["load"]).count() == 1
    view, inner = engine.graph(key, nodes["load"], 1)
    assert {"load", "Button"} <= {r.name for r in view.collect()} and inner.count() > 2
    assert engine.graph(key)[0].count() > 5
    assert engine.ask(key, "Where are orders placed?").first().citations
    assert engine.contents(key, "src/clients/mail.ts").first().text == SOURCES["src/clients/mail.ts"]
    assert [r.n_files for r in engine.languages(key).collect()] == [3, 1, 1]
    for call, problem in ((lambda: engine.contents(key, "../x"), BadRequest), (lambda: engine.contents(key, "no.ts"), NotFound), (lambda: engine.files("none"), NotFound), (lambda: engine.symbols(key, kind="x"), BadRequest), (lambda: engine.job("none"), NotFound)):
        with pytest.raises(problem):
            call()

    # an edit: one file changes, one goes, ids of the others stay
    from pathlib import Path

    (Path(root) / "src/clients/mail.ts").write_text("export class Mailer {\n  send(x) {\n    return x;\n  }\n  flush() {\n    return 1;\n  }\n}\n")
    (Path(root) / "src/auth.rs").unlink()
    assert engine.reindex(key) == key
    after = {r.name: r.symbol_id for r in engine._nodes(key).collect()}
    assert "flush" in after and "boot" not in after and after["load"] == nodes["load"]
    fresh = Engine(spark, str(tmp_path / "other"))
    other = fresh.index(root, key)
    for table in ("symbols", "edges", "units", "embeddings"):
        columns = [c for c in engine.store.load(table, key).columns if c != "weight"]
        both = [sorted(map(tuple, e.store.load(table, k).select(*columns).collect())) for e, k in ((engine, key), (fresh, other))]
        assert [repr(x) for x in both[0]] == [repr(x) for x in both[1]], table
    assert {r.path for r in engine.evolution(key)["hotspots"].collect()} >= {"src/auth.rs"}
    assert engine.runs().where("status = 'succeeded'").count() == 2
    assert [r.name for r in git.branches(spark, root).collect()] == ["main"]
    changed = git.changes(spark, root, "HEAD", "HEAD")
    assert {(r.status, r.new_path or r.old_path) for r in changed.collect()} >= {("modified", "src/clients/mail.ts"), ("deleted", "src/auth.rs")}
    with pytest.raises(Exception):
        engine.index(str(tmp_path / "nowhere"))
    assert engine.runs().where("status = 'failed'").count() == 1
    # progress: the snapshot, then what is new
    run_id = engine.runs().where("status = 'succeeded'").orderBy("started_at").first().id
    told = engine.progress(run_id).first()
    assert told.snapshot.stage == "succeeded" and told.missed == 0 and len(told.events) == told.n_events
    assert [e.stage for e in told.events if e.files is None] == ["queued", "scanning", "parsing", "resolving", "embedding", "persisting", "succeeded"]
    counted = next(e for e in told.events if e.files is not None)
    assert (counted.files, counted.symbols) == (5, 22)
    later = engine.progress(run_id, told.n_events - 1).first()
    assert [e.stage for e in later.events] == ["succeeded"] and later.missed == 0 and engine.progress(run_id, told.n_events).first().events == []
    assert engine.outline(key).first().text.startswith("Inferred") and engine.summary(key).first().text.startswith("shop has ")
    assert [c.list for c in engine.explain_impact(key, after["load"]).first().citations][:1] == [0]
    history = engine.ask(key, "Which files change most often?").first()
    assert history.text.startswith("Files that change most frequently") and history.citations
    placed = engine.graph(key)[0].first()
    assert placed.x is not None and placed.y is not None
    assert after["flush"] in {r.symbol_id for r in engine.symbols(key, "flush").collect()}

"""Extraction stays within a file: what its statements, calls and symbols are needs no shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import lines
from lodestone.sources import extract

TEXTS = {
    ("a.ts", "typescript"): "import {\n  One\n} from './x'; import './w'\r\nexport { Two } from './y'\nimport Broken from\nconst n = f('q');\nimport { Late } from './z';",
    ("b.py", "python"): "x = (\nfrom a import b\n)\nimport c, d.e as f\nfrom g import \\\n  h\n",
    ("c.rs", "rust"): "pub(crate) use a::{B, c as d};\nuse e::F\nfn g() {}\n",
}


def file_rows(spark):
    files = spark.createDataFrame([(p, p, lang, t) for (p, lang), t in TEXTS.items()], "file_id string, path string, language string, text string")
    return extract.file_rows(files)


def test_imports_and_calls_shuffle_nothing(spark):
    rows = file_rows(spark)
    each = extract.line_rows(rows)
    for found in (extract.imports(each), extract.imports(rows), extract.calls(rows)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan
    assert sorted(extract.imports(each).collect()) == sorted(extract.imports(rows).collect())
    assert sorted(extract.calls(each).collect()) == sorted(extract.calls(rows).collect())


def test_statements_that_nest_or_do_not_end(spark):
    got = {(r.file_id, r.ord, r.module, tuple(r.names)) for r in extract.imports(file_rows(spark)).collect()}
    assert got == {
        ("a.ts", 1, "./x", ("One",)), ("a.ts", 4, "./y", ("Two",)), ("a.ts", 7, "./z", ("Late",)),
        ("b.py", 2, "a", ("b",)), ("b.py", 4, "c", ("c",)), ("b.py", 4, "d.e", ("f",)), ("b.py", 5, "g", ("h",)), ("c.rs", 1, "a", ("B", "c")),
    }


def test_lines_lose_one_line_end(spark):
    texts = {"": [], "\n": [""], "a\r\n": ["a"], "a\n\r": ["a", ""], "\r\r\n": ["\r"], "\r\n\r\n": ["", ""], "a\r\r\nb\r": ["a\r", "b"], "a\rb\n\n": ["a\rb", ""]}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lines(F.col("t")).alias("ls"))
    assert {r.t: r.ls for r in rows.collect()} == texts

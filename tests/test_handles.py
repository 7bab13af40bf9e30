"""What a unit handles, against the rules read literally; the expression works each step out once."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lodestone.functions import text as X


def told(text: str) -> list[str]:
    lines = text.split("\n")
    bare = [re.sub(r"^(//|#)", "", x.strip()).lstrip() for x in lines if x.strip().startswith(("//", "#"))]
    notes = [x for x in bare if len(x.encode()) > 3]
    notes = [x for i, x in enumerate(notes) if i == 0 or x != notes[i - 1]]
    tokens = {t.lower() for t in re.findall("[A-Z][a-z0-9]*|[a-z0-9]+", text)}
    return (notes or sorted(t for t in tokens if len(t) > 4 and any(w in t for w in X.HANDLE_WORDS)))[:6]


TEXTS = (
    "", "plain words", "a # in the line\nFailure of it", "// one\n// one\n# two words\n//x\n  # three  ", "reTry ReTry Retry retryAll retried", "FAILED failED avail unfailing", "#\n//\nSTATUS Status",
    "the authors authenticate Sessions in transactions of stripes and notify", "// é é\n# wide ", "a // b\n // c and d", "professions south details", "1fail2 fail5 5stripe5",
)


def test_handles_as_told(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", X.handles(F.col("t")).alias("h"))
    assert {r.t: r.h for r in rows.collect()} == {t: told(t) for t in TEXTS}
    assert spark.sql("SELECT CAST(NULL AS string) AS t").select(X.handles(F.col("t")).alias("h")).first().h is None


def test_lines_are_trimmed_once(spark, capsys):
    spark.range(1).selectExpr("string(id) AS t").select(X.handles(F.col("t")).alias("h")).explain(True)
    analysed = capsys.readouterr().out.partition("== Analyzed Logical Plan ==")[2].partition("== Optimized")[0]
    assert analysed.count(r"]+\z") == 1

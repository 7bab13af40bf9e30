"""Column functions over source text: lines, tokens, snippets, secrets.

Case folding is ASCII only and lengths are bytes unless said otherwise, so that
accented text keeps its letters.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_LETTERS = UPPER_LETTERS.lower()

# fixed values: markers of secrets in upper-cased text
DETECT_MARKERS = (
    "BEGIN PRIVATE KEY",
    "BEGIN RSA PRIVATE KEY",
    "AWS_SECRET_ACCESS_KEY",
    "API_KEY=",
    "SECRET=",
    "PASSWORD=",
    "PRIVATE_KEY",
)
REDACT_MARKERS = tuple(m for m in DETECT_MARKERS if m != "BEGIN RSA PRIVATE KEY")

# fixed values: words that bring their family into a query
SYNONYMS = (
    (("authentication", "authorize", "authorized", "login"), ("auth", "login", "session")),
    (("payments", "payment", "billing", "checkout"), ("pay", "payment", "stripe", "transaction")),
    (("failed", "failure", "failing"), ("fail", "failure", "retry")),
)
HANDLE_WORDS = ("fail", "retry", "notify", "status", "transaction", "stripe", "session", "auth")

SNIPPET_LINES = 80
SNIPPET_CHARS = 2500
MAX_HANDLES = 6


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER_LETTERS, LOWER_LETTERS)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, LOWER_LETTERS, UPPER_LETTERS)


def contains_any(c: Column, needles: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | c.contains(needle)
    return found


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line, an empty text has none."""
    body = F.regexp_replace(text, r"\r?\n\z|\r\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


def tokenize(text: Column) -> Column:
    """Lower-cased ASCII letter and digit runs, cut before every capital, of two bytes or more."""
    runs = F.regexp_extract_all(text, F.lit("[A-Z][a-z0-9]*|[a-z0-9]+"), F.lit(0))
    # the runs are ASCII, so lower() folds nothing else
    return F.filter(F.transform(runs, lambda r: F.lower(r)), lambda t: F.length(t) >= 2)


def query_tokens(question: Column) -> Column:
    """Sorted distinct tokens with the 4-byte prefixes of long ones and their synonyms."""

    def widened(t: Column) -> Column:
        parts = [F.array(t), F.when(F.length(t) >= 8, F.array(F.substring(t, 1, 4))).otherwise(F.array().cast("array<string>"))]
        for triggers, family in SYNONYMS:
            more = F.array(*map(F.lit, family))
            parts.append(F.when(t.isin(*triggers), more).otherwise(F.array().cast("array<string>")))
        return F.concat(*parts)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(tokenize(question), widened))))


def expanded_query(question: Column) -> Column:
    return F.concat_ws(" ", question, F.array_join(query_tokens(question), " "))


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def held(text: Column, needles: list[str]) -> Column:
    """How many of some strings a text holds, without regard to ASCII case: searched for over a batch of texts at once."""

    def run(texts: pa.Array) -> pa.Array:
        lowered = pc.ascii_lower(texts.cast(pa.large_string()))
        found = np.zeros(len(texts), np.int64)
        for needle in needles:
            found += pc.match_substring(lowered, needle).fill_null(False).to_numpy(zero_copy_only=False)
        return pa.array(found)

    return F.arrow_udf(run, "bigint")(text) if needles else F.lit(0).cast("long")


def snippet(all_lines: Column, start: Column, end: Column) -> Column:
    """Lines start..end (from 1, inclusive), 80 lines and 2500 characters at most."""
    count = F.greatest(F.least(end - start + 1, F.lit(SNIPPET_LINES)), F.lit(0))
    return F.substring(F.array_join(F.slice(all_lines, start, count), "\n"), 1, SNIPPET_CHARS)


def any_of(needles: tuple[str, ...] | list[str]) -> str:
    """A pattern for any of some strings, without regard to ASCII case: one pass over a text."""
    return "(?i)" + "|".join(re.escape(n) for n in needles)


def looks_like_secret(text: Column) -> Column:
    return text.rlike(any_of(DETECT_MARKERS))


def redact_secrets(text: Column) -> Column:
    """Lines with a marker keep what stands up to ``=``, or else ``:``, and lose the rest."""

    def one(line: Column) -> Column:
        hidden = (
            F.when(line.contains("="), F.concat(F.substring_index(line, "=", 1), F.lit("=[REDACTED]")))
            .when(line.contains(":"), F.concat(F.substring_index(line, ":", 1), F.lit(": [REDACTED]")))
            .otherwise(F.lit("[REDACTED]"))
        )
        return F.when(line.rlike(any_of(REDACT_MARKERS)), hidden).otherwise(line)

    return F.array_join(F.transform(lines(text), one), "\n")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def handles(text: Column) -> Column:
    """What a unit says it handles: its comments, else its telling tokens; six at most."""
    none = F.array().cast("array<string>")
    # few lines hold a mark, and few texts a telling word: what follows its first letter stands in the text as it is
    held = F.filter(lines(text), lambda x: x.contains("//") | x.contains("#"))
    trimmed = F.transform(held, lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+\z", ""))
    marked = F.filter(trimmed, lambda x: x.startswith("//") | x.startswith("#"))
    bare = F.transform(marked, lambda x: F.regexp_replace(F.regexp_replace(x, r"^(?://|#)", ""), r"^[\s\p{Z}]+", ""))
    comments = F.when(text.contains("//") | text.contains("#"), F.filter(bare, lambda x: F.octet_length(x) > 3)).otherwise(none)

    def distinct(own: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), own)
        changed = F.zip_with(own, before, lambda x, y: F.when(y.isNull() | (x != y), x))
        return F.filter(changed, lambda x: x.isNotNull())

    tokens = F.array_sort(F.array_distinct(F.filter(tokenize(text), lambda t: (F.length(t) > 4) & contains_any(t, HANDLE_WORDS))))
    telling = F.when(text.isNull() | contains_any(text, tuple(w[1:] for w in HANDLE_WORDS)), tokens).otherwise(none)
    told = once(comments, distinct)
    return F.slice(once(told, lambda d: F.when(F.size(d) > 0, d).otherwise(telling)), 1, MAX_HANDLES)


def citation_key(symbol_id: Column) -> Column:
    return F.substring(symbol_id, 1, 8)


def location(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def resolve_markers(text: Column, citations: Column) -> Column:
    """``[citation:key]`` becomes the location of the citation with that key (structs of key and place)."""
    return F.aggregate(
        citations, text, lambda t, c: F.replace(t, F.concat(F.lit("[citation:"), c["key"], F.lit("]")), c["place"])
    )


def markers(text: Column) -> Column:
    """All ``path:start-end`` places in a text."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_./-]+:[0-9]+-[0-9]+"), F.lit(0))


def repo_name(url: Column) -> Column:
    """Last path segment of a repository URL, without a closing slash or ``.git``."""
    bare = F.regexp_replace(F.regexp_replace(url, r"/+\z", ""), r"\.git\z", "")
    return F.regexp_extract(bare, r"([^/:]*)\z", 1)


def looks_like_sha(text: Column) -> Column:
    return F.trim(text).rlike(r"\A[0-9a-fA-F]{7,}\z")


def inflect(verb: Column) -> Column:
    """Capitalised third person: -es after s, x, ch; -ies for y; else -s."""
    head = F.concat(ascii_upper(F.substring(verb, 1, 1)), F.substr(verb, F.lit(2)))
    return (
        F.when(verb.rlike("(s|x|ch)$"), F.concat(head, F.lit("es")))
        .when(verb.endswith("y") & (F.length(verb) > 1), F.concat(F.regexp_replace(head, "y$", ""), F.lit("ies")))
        .otherwise(F.concat(head, F.lit("s")))
    )


COMMENT_LINES, MAX_STEPS = 6, 8
OPENERS = ("export ", "function ", "class ", "pub ", "def ")  # fixed values: a declaration, where leading comments end


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def after_mark(line: Column, marks: str) -> Column:
    """The text of a comment line; null if the line begins with none of the marks (a pattern)."""
    return F.when(line.rlike(f"^(?:{marks})"), stripped(F.regexp_replace(line, f"^(?:{marks})", "")))


def told(notes: Column) -> Column:
    """Comments of more than three bytes."""
    return F.filter(notes, lambda x: x.isNotNull() & (F.octet_length(x) > 3))


def leading_comment(text: Column) -> Column:
    """The first comment of a snippet above its declaration, within six lines; null if there is none."""
    head = F.transform(F.slice(lines(text), 1, COMMENT_LINES), stripped)

    def step(acc: Column, line: Column) -> Column:
        ends = line.contains("(")
        for opener in OPENERS:
            ends = ends | line.startswith(opener)
        note = F.when(~acc["over"] & ~ends, after_mark(line, "//|#"))
        found = F.coalesce(acc["found"], F.when(F.octet_length(note) > 3, note))
        return F.struct((acc["over"] | ends).alias("over"), found.alias("found"))

    start = F.struct(F.lit(False).alias("over"), F.lit(None).cast("string").alias("found"))
    return F.aggregate(head, start, step, lambda acc: acc["found"])


def purpose(name: Column, kind: Column, text: Column) -> Column:
    """What a symbol is for: its leading comment, or a sentence from its name and kind."""
    words = tokenize(name)
    plain = F.concat(F.lit("The "), kind, F.lit(" "), name, F.lit("."))
    rest = F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), " ")
    act = F.concat(inflect(F.get(words, F.lit(0))), F.when(rest == "", F.lit(" this unit of work.")).otherwise(F.concat(F.lit(" a "), rest, F.lit("."))))
    by_kind = (
        F.when(F.size(words) == 0, plain)
        .when(kind.isin("function", "method"), act)
        .when(kind.isin("class", "struct", "component"), F.concat(F.lit("Defines "), name, F.lit(".")))
        .otherwise(plain)
    )
    return F.coalesce(leading_comment(text), by_kind)


def flow(text: Column, calls: Column) -> Column:
    """The steps of a symbol: its comments, or what it calls; eight at most."""
    marked = F.transform(F.transform(lines(text), stripped), lambda x: after_mark(x, r"//|#|\*"))
    notes = told(F.transform(marked, lambda x: stripped(F.regexp_replace(x, "^/+", ""))))
    return F.slice(F.when(F.size(notes) > 0, notes).otherwise(F.transform(calls, lambda c: F.concat(F.lit("Calls "), c))), 1, MAX_STEPS)


def explanation(purpose_text: Column, steps: Column, dependencies: Column) -> Column:
    """Purpose, numbered flow and dependencies as one text."""
    numbered = F.array_join(F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s, F.lit("\n"))), "")
    named = F.array_join(F.transform(dependencies, lambda d: F.concat(F.lit("\u2192 "), d, F.lit("\n"))), "")
    return F.concat(
        F.lit("Purpose\n"), purpose_text, F.lit("\n"),
        F.when(F.size(steps) > 0, F.concat(F.lit("\nFlow\n"), numbered)).otherwise(""),
        F.when(F.size(dependencies) > 0, F.concat(F.lit("\nDependencies\n"), named)).otherwise(""),
    )


def uuid5(namespace: Column, name: Column) -> Column:
    """Name-based UUID (version 5) of a namespace UUID and a name, both strings."""
    digest = F.sha1(F.concat(F.unhex(F.replace(namespace, F.lit("-"), F.lit(""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def detect_intent(question: Column) -> Column:
    """evolution, locate, impact, explain or search, by the first rule that holds."""
    q = ascii_lower(question)
    evolution = contains_any(
        q, ("hotspot", "frequently", "contributor", "contributors", "who wrote", "authors", "commits", "branches")
    ) | (q.contains("change") & contains_any(q, ("file", "most", "often")))
    return (
        F.when(evolution, "evolution")
        .when(contains_any(q, ("where", "which file", "handle", "find")), "locate")
        .when(contains_any(q, ("impact", "depend", "break", "affect")), "impact")
        .when(contains_any(q, ("how", "explain", "work", "does")), "explain")
        .otherwise("search")
    )


def evolution_route(question: Column) -> Column:
    q = ascii_lower(question)
    return (
        F.when(contains_any(q, ("author", "who wrote", "contributor")), "authors")
        .when(q.contains("branch"), "branches")
        .when(q.contains("commit") & ~q.contains("file"), "commits")
        .otherwise("hotspots")
    )

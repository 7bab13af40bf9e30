"""URL filters: glob rules in one bit-parallel Shift-And automaton.

Each rule becomes one run of bits in a multiword mask, one bit for every byte it
must match. One step per input byte advances the states of all rules at once:
``D = ((D << 1) | starts) & accepts[byte]``, plus the bits of ``*``, which stay
set. A batch of URLs is simulated together, so the inner step is a numpy
operation over (urls x mask words).

Defined results: a null URL or one without ``://`` has an empty host and path
and matches no rule; so does a URL whose host is empty. Ties between rules of
equal length go to the rule listed first. Repeated rows and null ids give a row
each; very long URLs cost time in proportion to their length. Extra columns of
the input are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, utf8

SEPARATOR = 0xFF  # between host and path: a byte that UTF-8 never has, so a host glob can't run into the path
ANY = -1

RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
"""The rules of the registered query: (verdict, host and path prefix)."""


@dataclass(frozen=True)
class Automaton:
    """Masks of all rules: ``accepts[byte]``, ``starts``, ``stays`` and the end bit of each rule."""

    accepts: np.ndarray
    starts: np.ndarray
    stays: np.ndarray
    ends: tuple[int, ...]


def glob_of(rule: str) -> list[int]:
    """``host/path`` as a glob over ``.host<separator>path``: any subdomain before, anything after.

    ``*`` within a rule stands for any run of bytes of the host or of the path.
    """
    host, slash, path = rule.partition("/")
    coded = [ANY if b == 42 else b for b in f".{host.lower()}".encode()]
    return [ANY, *coded, SEPARATOR, *(ANY if b == 42 else b for b in f"{slash}{path}".encode())]


def compile_rules(rules: Sequence[str]) -> Automaton:
    globs = [glob_of(r) for r in rules]
    bits = sum(1 + sum(g != ANY for g in glob) for glob in globs)  # a start state for each rule, a state for each byte
    words = max(1, -(-bits // 64))
    accepts, starts, stays = np.zeros((256, words), np.uint64), np.zeros(words, np.uint64), np.zeros(words, np.uint64)
    ends, at = [], 0

    def put(mask: np.ndarray, bit: int) -> None:
        mask[bit >> 6] |= np.uint64(1 << (bit & 63))

    for glob in globs:
        put(starts, at)
        for token in glob:
            if token == ANY:  # the state before a star keeps itself on every byte
                put(stays, at)
            else:
                at += 1
                put(accepts[token], at)
        ends.append(at)
        at += 1
    return Automaton(accepts, starts, stays, tuple(ends))


def shift(states: np.ndarray) -> np.ndarray:
    out = states << np.uint64(1)
    if states.shape[1] > 1:
        out[:, 1:] |= states[:, :-1] >> np.uint64(63)
    return out


def match(automaton: Automaton, texts: Sequence[bytes]) -> np.ndarray:
    """(texts x rules) booleans: the rule is matched by some prefix of the text.

    A rule's end state counts as soon as it is reached, as rules end in an open
    tail. Texts are stepped in order of length, so that finished ones drop out.
    """
    order = np.argsort([-len(t) for t in texts], kind="stable")
    lengths = np.array([len(texts[i]) for i in order])
    states = np.tile(automaton.starts, (len(texts), 1))
    seen = states.copy()
    joined = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(texts) else np.zeros(0, int)
    live = len(texts)
    for step in range(int(lengths[0]) if len(texts) else 0):
        while live and lengths[live - 1] <= step:
            live -= 1
        now = states[:live]
        states[:live] = (shift(now) & automaton.accepts[joined[first[:live] + step]]) | (now & automaton.stays)
        seen[:live] |= states[:live]
    found = np.zeros((len(texts), len(automaton.ends)), bool)
    for k, bit in enumerate(automaton.ends):
        found[order, k] = (seen[:, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1)
    return found


def host_and_path(url: bytes) -> tuple[bytes, bytes]:
    _, sep, rest = url.partition(b"://")
    if not sep:
        return b"", b""
    for mark in (b"#", b"?"):
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition(b"/")
    return bytes(b + 32 if 65 <= b <= 90 else b for b in host), slash + path


def filter_urls(
    df: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    default: str = "allow",
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """One row per input row: key, host, path, the longest fitting rule and the verdict.

    A rule fits its host and all its subdomains if the path starts with the
    rule's path. Where none fits, ``rule`` is null and ``verdict`` is ``default``.
    """
    by_length = sorted(range(len(rules)), key=lambda k: (-len(rules[k][1]), k))
    names, verdicts = [rules[k][1] for k in by_length], [rules[k][0] for k in by_length]
    automaton = compile_rules(names)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        split = [host_and_path(u) for u in utf8(batch.column(1))]
        found = match(automaton, [b".%s%c%s" % (h, SEPARATOR, p) if h else b"" for h, p in split])
        best = np.where(found.any(axis=1), found.argmax(axis=1), -1) if len(names) else np.full(len(split), -1)
        text = lambda values: pa.array(values, pa.binary()).cast(pa.string())
        return pa.record_batch(
            [
                batch.column(0),
                text([h for h, _ in split]),
                text([p for _, p in split]),
                pa.array([names[k] if k >= 0 else None for k in best], pa.string()),
                pa.array([verdicts[k] if k >= 0 else default for k in best], pa.string()),
            ],
            ["page_id", "host", "path", "rule", "verdict"],
        )

    plain = df.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))
    return map_text(
        plain, judge, "page_id long, host string, path string, rule string, verdict string", column="url", limit=1 << 18
    )

"""Plain versions of the operators, straight from their definitions."""

from __future__ import annotations

import hashlib
import re

import xxhash

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def space_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def fingerprint(text: str | None) -> int:
    words = space_words((text or "").translate(ASCII_LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict[int, int], bits: int = 2) -> dict[int, int]:
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def repeated_words(docs: dict[int, str | None], k: int = 13) -> dict[int, list[bool]]:
    """Which words of each document a window of a smaller document covers."""
    words = {i: space_words(t) for i, t in docs.items()}
    first: dict[tuple, int] = {}
    for i in sorted(words):
        for at in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][at : at + k]), i)
    out = {}
    for i, own in words.items():
        gone = [False] * len(own)
        for at in range(len(own) - k + 1):
            if first[tuple(own[at : at + k])] < i:
                gone[at : at + k] = [True] * k
        out[i] = gone
    return out


def contamination(text: str | None, items: list[tuple[int, str | None]], window: int = 10) -> tuple[int, list[bool], list[int]]:
    words = plain_words(text)
    hit, found = [False] * len(words), set()
    for item, item_text in items:
        own = plain_words(item_text)
        size = min(window, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for at in range(len(words) - size + 1) if own else ():
            if tuple(words[at : at + size]) in windows:
                hit[at : at + size] = [True] * size
                found.add(item)
    return len(words), hit, sorted(found)


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def without(text: str, spans: list[tuple[int, int]], gone: list[bool]) -> str:
    """Text without the words marked; a run of them goes up to the start of the next kept word."""
    out, at = [], 0
    k = 0
    while k < len(spans):
        if gone[k]:
            out.append(text[at : spans[k][0]])
            while k < len(spans) and gone[k]:
                k += 1
            at = spans[k][0] if k < len(spans) else len(text)
        else:
            k += 1
    return "".join([*out, text[at:]])

"""Brute-force versions of the operators, in plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def fold(doc_id, n: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def rules(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def base_scores(rows: list[tuple]) -> dict:
    """doc_id -> (n_tokens, n_known, N, base) of rows (doc_id, text)."""
    tokens = {d: [*WORD.findall(lower(t or "")), None] for d, t in rows}
    count = Counter(x for d, t in tokens.items() if fold(d, 7) != 2 for x in t)
    total, distinct = sum(count.values()), len(count)
    return {
        d: (len(t), sum(count[x] > 0 for x in t), total, sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in t))
        for d, t in tokens.items()
    }


def fingerprint(text: str | None, shingle: int = 4) -> int:
    words = WORD.findall(lower(text or ""))
    grams = [" ".join(words[i : i + shingle]) for i in range(max(len(words) - shingle + 1, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps: dict, radius: int = 4) -> dict:
    """doc_id -> smallest doc_id reachable over fingerprints within the radius."""
    low: dict = {}
    for d, f in fps.items():
        low[f] = min(low.get(f, d), d)
    nodes = list(low)
    parent = {f: f for f in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    best: dict = {}
    for f in nodes:
        best[find(f)] = min(best.get(find(f), low[f]), low[f])
    return {d: best[find(f)] for d, f in fps.items()}


def substring_removed(rows: list[tuple], size: int = 50) -> dict:
    """doc_id -> (n_words, n_removed, sha256 of kept words) of rows (doc_id, text)."""
    words = {d: WORD.findall(t or "") for d, t in rows}
    first: dict = {}
    for d, w in words.items():
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in words.items():
        gone = {i + j for i in range(len(w) - size + 1) if first[tuple(w[i : i + size])] < d for j in range(size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out


def line_removals(rows: list[tuple]) -> dict:
    """doc_id -> line numbers removed, of rows (doc_id, text) with distinct doc_ids."""
    lines = []
    for d, t in sorted(rows, key=lambda r: r[0]):
        for i, line in enumerate((t or "").split("\n")):
            tokens = frozenset(WORD.findall(lower(line)))
            if tokens:
                lines.append((d, i, tokens))
    out: dict = {}
    seen: dict = {}
    for d, i, tokens in lines:
        near = any(
            5 * len(tokens & other) >= 4 * len(tokens | other)
            for n in range(-(-len(tokens) * 4 // 5), len(tokens) * 5 // 4 + 1)
            for other in seen.get(n, ())
        )
        if near:
            out.setdefault(d, []).append(i)
        seen.setdefault(len(tokens), {})[tokens] = None
    return out

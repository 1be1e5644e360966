"""Line and substring dedup against brute force."""

from __future__ import annotations

import random
import time
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tidemark.llm import line_dedup, substring
from tidemark.llm import queries as q
from tidemark.llm._text import pieces

SF1 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF1}/documents.parquet").select("doc_id", "text").collect()]


def test_substrings(spark, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in q.op10_substring_dedup(spark, SF1).collect()}
    want = brute.substring_removed(rows)
    assert got == want
    assert sum(x[1] for x in want.values()) > 1000


@pytest.mark.parametrize(("witnesses", "large", "hot"), [(2, 2048, 4096), (1, 2, 1 << 40)])
def test_lines(spark, rows, witnesses, large, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "STEP_PAIRS", 1 << 22 if large > 2 else 100)
    monkeypatch.setattr(line_dedup, "WITNESSES", witnesses)
    monkeypatch.setattr(line_dedup, "KEPT", witnesses)
    monkeypatch.setattr(line_dedup, "OTHERS", 1)
    monkeypatch.setattr(line_dedup, "LARGE", large)
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    got = {r.doc_id: sorted(r.lines) for r in line_dedup.removed_lines(docs).collect()}
    want = brute.line_removals(rows)
    assert got == want and len(want) > 100
    clean = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    for d, t in rows:
        gone = set(want.get(d, ()))
        assert clean[d] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)


@pytest.mark.parametrize("hot", [60_000, 9_000, 1])
@pytest.mark.parametrize(("large", "step"), [(2048, 1 << 22), (2048, 50), (3, 50)])
def test_every_similar_pair_is_a_candidate(hot, large, step, monkeypatch):
    monkeypatch.setattr(line_dedup, "LARGE", large)
    monkeypatch.setattr(line_dedup, "STEP_PAIRS", step)
    rng = random.Random(11)
    base = [[str(int(rng.paretovariate(0.5)) % 300) for _ in range(rng.randint(1, 25))] for _ in range(30)]
    texts = []
    for _ in range(300):
        words = list(rng.choice(base))
        words[rng.randrange(len(words))] = str(rng.randrange(300))
        texts.append(" ".join(words))
    (piece,) = pieces(pa.array(texts))
    lines = line_dedup.Lines(piece)
    rarity = np.zeros(line_dedup.SKETCH, dtype=np.int64)
    np.add.at(rarity, (lines.tokens & np.uint64(line_dedup.SKETCH - 1)).astype(np.int64), 1)
    entries = line_dedup.entries_of(lines, np.arange(len(texts)), line_dedup._logs(rarity), hot, Fraction("0.8"))
    entries = line_dedup._first_of_each(entries)
    found = set()
    for x, y, _ in line_dedup.candidates(entries, Fraction("0.8"), None, None):
        assert (line_dedup.Filters(entries, Fraction("0.8")).rank[x] > line_dedup.Filters(entries, Fraction("0.8")).rank[y]).all()
        found |= {frozenset(p) for p in zip(entries["set"][x].tolist(), entries["set"][y].tolist(), strict=True)}
    sets = {int(h): frozenset(t.split()) for h, t in zip(lines.set, texts, strict=True)}
    want = {frozenset((a, b)) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert want <= found and len(want) > 20


def test_phrase_automaton_on_periodic_texts():
    rng = random.Random(2)
    for size, word in ((10, lambda i: b"w"), (10, lambda i: b"ab"[i % 2 : i % 2 + 1]), (4, lambda i: rng.choice([b"x", b"y"]))):
        passages = [(d, b" ".join(word(i) for i in range(n))) for d, n in ((3, 40), (1, 25), (7, 33))]
        automaton = substring.PhraseAutomaton(passages, size)
        for doc_id in (0, 2, 5, 9):
            words = [word(i) for i in range(60)] + [b"z"] + [word(i) for i in range(12)]
            there = {tuple(p.split()[i : i + size]) for d, p in passages if d < doc_id for i in range(len(p.split()) - size + 1)}
            want = {i + j for i in range(len(words) - size + 1) if tuple(words[i : i + size]) in there for j in range(size)}
            assert {x for a, b in automaton.runs(doc_id, words) for x in range(a, b)} == want
    began = time.perf_counter()
    automaton = substring.PhraseAutomaton([(1, b"w " * 19_999)], 50)
    assert automaton.runs(2, [b"w"] * 20_000) == [(0, 20_000)]
    assert time.perf_counter() - began < 2

"""Documents of similarity 0.8 and more."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm import brute
from tidemark.llm import shingle_pairs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], SCHEMA).repartition(3)


def _near_copies():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice((40, 150, 300)))]
        rows.append(base)
        for _ in range(rng.randint(1, 5)):
            copy = list(rng.choice(rows[-1:] + [base]))
            for _ in range(max(1, round(len(copy) * rng.uniform(0.005, 0.035)))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy)
    rng.shuffle(rows)
    return [(i, " ".join(x)) for i, x in enumerate(rows)] + [(900, "one two"), (901, "two one"), (902, "One two")]


def _kept(rows, shingle=5):
    """doc_ids that stay: the smallest of each component of similar shingle sets or near fingerprints."""
    sets, low = {}, {d: d for d, _ in rows}
    for d, t in rows:
        w = brute.WORD.findall(brute.lower(t))
        sets[d] = {tuple(w[i : i + shingle]) for i in range(max(len(w) - shingle + 1, min(len(w), 1)))}
    fps = {d: brute.fingerprint(t, shingle) for d, t in rows}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and (5 * len(sets[a] & sets[b]) >= 4 * max(1, len(sets[a] | sets[b])) or (fps[a] ^ fps[b]).bit_count() <= 4)]
    while changed:
        changed = False
        for a, b in pairs:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return sorted(d for d in low if low[d] == d), sum((fps[a] ^ fps[b]).bit_count() > 4 for a, b in pairs)


def test_near_copies_of_similarity_08(spark, monkeypatch):
    rows = _near_copies()
    want, beyond = _kept(rows)
    assert beyond > 10
    for size in (shingle_pairs.CHUNK, 2):
        monkeypatch.setattr(shingle_pairs, "CHUNK", size)
        got = corpus_pipeline.near_duplicate_stage(spark, _docs(spark, rows), "")
        assert sorted(r.doc_id for r in got.collect()) == want

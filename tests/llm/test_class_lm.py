"""The class model against brute force."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import class_lm as lm
from tidemark.llm._scratch import stored
from tidemark.llm._text import pieces

SF = "/root/testdata/sf0.001"


def _hash(word):
    (piece,) = pieces(pa.array([word]))
    return int(lm.words_of(piece)[0].view(np.int64)[0])


@pytest.fixture(scope="module")
def model(spark):
    """(texts by doc_id as words, class by word, count by word)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train = docs.filter(~lm.held_out_rows(7, 2)).select("text")
    rows = {r.word: (r["class"], r.n) for r in lm.cluster(train, stored(lm.count_words(train), "w")).collect()}
    texts = {r.doc_id: brute.WORD.findall(brute.lower(r.text or "")) for r in docs.collect()}
    named = {w: rows[h] for w in {x for t in texts.values() for x in t} if (h := _hash(w)) in rows}
    return texts, {w: c for w, (c, _) in named.items()}, {w: n for w, (_, n) in named.items()}


def test_scores(spark, model):
    texts, of, n = model
    count = Counter(x for d, t in texts.items() if brute.fold(d, 7) != 2 for x in t)
    assert n == count and set(of.values()) <= set(range(1, lm.CLASSES))
    size, unknown = Counter(), lm.CLASSES
    for w, c in of.items():
        size[c] += n[w]
    path = {d: [0, *[of.get(w, unknown) for w in t], 0] for d, t in texts.items()}
    pairs = Counter(p for d, s in path.items() if brute.fold(d, 7) != 2 for p in zip(s, s[1:]))
    arrive, mass, kinds = Counter(), Counter(), Counter()
    for (a, b), k in pairs.items():
        arrive[b] += k
        mass[a] += k
        kinds[a] += 1
    single = sum(k == 1 for k in count.values())
    new = (single + 1) / (sum(count.values()) + single + 2)

    def move(a, b):
        if b == unknown:
            return new
        unigram = (arrive[b] + 0.5) / (sum(arrive.values()) + 0.5 * lm.CLASSES)
        if a == unknown or not mass[a]:
            return (1 - new) * unigram
        weight = mass[a] / (mass[a] + kinds[a])
        return (1 - new) * (weight * pairs[a, b] / mass[a] + (1 - weight) * unigram)

    assert sum(move(3, b) for b in range(lm.CLASSES + 1)) == pytest.approx(1)
    got = {r.doc_id: r for r in lm.lm_scores(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for d, t in texts.items():
        want = sum(math.log10(move(a, b)) for a, b in zip(path[d], path[d][1:])) + sum(math.log10(n[w] / size[of[w]]) for w in t if w in of)
        assert got[d].score == pytest.approx(want, rel=1e-9)


def _likelihood(texts, of, n):
    size, pairs, before = Counter(), Counter(), Counter()
    for w, c in of.items():
        size[c] += n[w]
    for d, t in texts.items():
        if brute.fold(d, 7) != 2:
            s = [0, *[of[w] for w in t], 0]
            pairs.update(zip(s, s[1:]))
    for (a, _), k in pairs.items():
        before[a] += k
    return sum(k * math.log(k / before[a]) for (a, _), k in pairs.items()) + sum(k * math.log(k / size[of[w]]) for w, k in n.items())


def test_clustering_raises_the_likelihood(model):
    texts, of, n = model
    dealt = {w: 1 + i % (lm.CLASSES - 1) for i, w in enumerate(sorted(n, key=lambda w: (-n[w], w)))}
    assert _likelihood(texts, of, n) > _likelihood(texts, dealt, n) + 0.01 * sum(n.values())


def test_exchange_ends_where_no_unit_gains():
    rng = np.random.default_rng(3)
    counts = rng.poisson(rng.gamma(0.3, 20, (40, 40)))
    of = lm.exchange(counts, 6)
    words = list(range(39))

    def likelihood(of):
        one = np.eye(6)[of]
        grid = one.T @ counts @ one
        e = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return e(grid) - e(grid.sum(0)) - e(grid.sum(1))

    best = likelihood(of)
    for u in words:
        for c in range(1, 6):
            moved = of.copy()
            moved[u] = c
            assert likelihood(moved) <= best + 1e-6


def test_held_out_texts_gain_from_classes(spark):
    got = lm.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out")
    score, base = got.agg(F.sum("score"), F.sum("base_score")).head()
    assert score > base

from __future__ import annotations

import re

import numpy as np

from tidemark.llm import toxicity

TEXTS = ["Vile vile words", "kind words here", "", None, "vile, unkind wordsmith here " * 40]


def _expected(text: str | None) -> set[bytes]:
    """Words and their first four and five bytes, as the operator counts them once a text."""
    found: set[bytes] = set()
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode()):
        found |= {b"word:" + w, *(b"%d:" % n + w[:n] for n in (4, 5) if len(w) > n)}
    return found


def test_document_frequencies_count_all_texts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "doc_id long, text string").repartition(4)
    counts, n = toxicity.document_frequencies(docs)
    assert n == len(TEXTS) * 3
    keys = [k for t in TEXTS * 3 for k in _expected(t)]
    expected = sorted(keys.count(k) for k in set(keys))
    assert sorted(counts[counts > 0].tolist()) == expected
    among = np.flatnonzero(counts)[::2]
    some, _ = toxicity.document_frequencies(docs, among)
    assert (some[among] == counts[among]).all() and some.sum() == counts[among].sum()
    none, n = toxicity.document_frequencies(docs.limit(0))
    assert n == 0 and not none.any()


def test_words_are_chosen_from_all_texts(spark):
    rows = [(i, f"plain text of row{i} " + ("grumblewort " if i % 4 == 0 else "daisies ") * 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400, 3)], "doc_id long, toxic int")
    few = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels, max_unlabelled=60).collect()}
    toxic, clean = [few[i] for i in range(400) if i % 4 == 0], [few[i] for i in range(400) if i % 4]
    assert min(toxic) > max(clean)

"""Registered queries against brute force on the small tables."""

from __future__ import annotations

import pytest

from tests.llm import brute
from tidemark.llm import queries as q

SF = "/root/testdata/sf0.001"
SF1 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF1}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}


def test_quality_rules_counts(spark, rows):
    got = {r.doc_id: tuple(r)[1:7] for r in q.op5_quality_rules(spark, SF1).collect()}
    assert got == {d: brute.rules(t) for d, t in rows}


def test_quality_rules_keep_clean(spark, labels):
    got = [r for r in q.op5_quality_rules(spark, SF1).collect() if not r.base_failed and r.doc_id in labels and labels[r.doc_id].quality == 1]
    assert sum(r.kept for r in got) / len(got) > 0.98


def test_base_scores(spark, rows):
    want = brute.base_scores(rows)
    got = q.op2_lm_scoring(spark, SF1).collect()
    assert {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in got} == {d: x[:3] for d, x in want.items()}
    for r in got:
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
        assert r.held_out == (brute.fold(r.doc_id, 7) == 2)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_fingerprints_and_components(spark, rows):
    fps = {d: brute.fingerprint(t) for d, t in rows}
    linked = brute.components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in q.op8_simhash(spark, SF1).collect()}
    assert got == {d: (f"{f:016x}", linked[d]) for d, f in fps.items()}


@pytest.mark.parametrize(("name", "column", "folds", "fold"), [("op1_quality_classifier", "quality", 5, 0), ("op7_toxicity", "toxic", 4, 2)])
def test_classifiers_on_held_out_rows(spark, labels, name, column, folds, fold):
    got = getattr(q, name)(spark, SF1).collect()
    assert len(got) == 1000 and all(r.held_out == (brute.fold(r.doc_id, folds) == fold) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.score, getattr(labels[r.doc_id], column)) for r in got if r.held_out and r.doc_id in labels]
    ones, zeros = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert auc > 0.8

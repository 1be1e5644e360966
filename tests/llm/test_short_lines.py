"""Lines of one to four distinct words."""

from __future__ import annotations

import corpus_pipeline
from tests.llm import brute
from tidemark.llm import line_dedup
from tidemark.llm import queries as q

SF1 = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], SCHEMA).repartition(3)


def _texts(df):
    return sorted((r.text for r in df.collect()), key=repr)


def test_short_lines(spark, tmp_path):
    rows = [(1, "a\nb c\nd e f g\n\n"), (2, "A\nc b\nd e f g h\n \n"), (3, "a b\nd e f\ng f e d\nx\nx x")]
    got = line_dedup.removed_lines(_docs(spark, rows))
    want = brute.line_removals(rows)
    assert {r.doc_id: sorted(r.lines) for r in got.collect()} == want == {2: [0, 1, 2], 3: [2, 4]}
    _docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_lines_removed for r in q.op4_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 3, 3: 2}
    staged = corpus_pipeline.line_stage(spark, _docs(spark, rows), str(tmp_path))
    assert _texts(staged) == sorted(["a\nb c\nd e f g\n\n", " \n", "a b\nd e f\nx"], key=repr)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF1}/documents.parquet").select("doc_id", "text").collect()]
    got = line_dedup.removed_lines(spark.read.parquet(f"{SF1}/documents.parquet"))
    assert {r.doc_id: sorted(r.lines) for r in got.collect()} == brute.line_removals(rows)

"""Rows that share a doc_id or have none."""

from __future__ import annotations

import random

from tidemark.llm import decontamination, line_dedup, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], SCHEMA).repartition(3)


def _texts(df):
    return sorted((r.text for r in df.collect()), key=repr)


def test_rows_that_share_a_doc_id_or_have_none(spark):
    rng = random.Random(9)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(14))
    l0, l1, x, y, z = (line() for _ in range(5))
    for d in (None, 7):
        rows = [(d, f"{l0}\n{l1}"), (d, f"{x}\n{l0}")]
        got = line_dedup.dedup_lines(_docs(spark, rows)).collect()
        assert sorted(n for r in got for n in r.text.split("\n")) == sorted([l0, l1, x])
        assert sum(r.n_lines_removed for r in got) == 1
        assert sorted(r.text for r in line_dedup.dedup_lines(_docs(spark, [(d, l0), (d, l0)])).collect()) == ["", l0]
        kept = simhash.keep_one_of_each(_docs(spark, [(d, y), (d, z), (d, z), (1 if d else None, z)]))
        assert _texts(kept) == sorted([y, z])
        benchmark = spark.createDataFrame([(1, z)], "item_id long, text string")
        left = decontamination.drop_contaminated(_docs(spark, [(d, y), (d, f"{x} {z}"), (d, None), (3, l0)]), benchmark)
        assert _texts(left) == sorted([y, l0, None], key=repr)
    # an order by doc_id holds where some rows share one: the earlier document keeps the line
    got = line_dedup.dedup_lines(_docs(spark, [(5, l0), (2, l0), (9, x), (9, y), (None, x)]))
    assert {(r.doc_id, r.text) for r in got.collect()} == {(5, ""), (2, l0), (9, ""), (9, y), (None, x)}

"""The driver's entry file and restarts of streams."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from tidemark.operators import matches
from tidemark.streaming import streams

ROOT = Path(__file__).resolve().parent.parent


def test_core_works_where_a_package_of_the_operators_is_missing(tmp_path):
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'radar_latest' in q and set(s) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(ROOT), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=False)
    assert done.returncode == 0 and int(done.stdout) > 100, done.stderr


def _rows(spark, folder, rows):
    spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(folder)


def test_streams_go_on_after_a_restart(spark, tmp_path):
    at = lambda h: __import__("datetime").datetime(2024, 1, 1, h)
    folder, base = f"{tmp_path}/in", f"file://{tmp_path}/base"
    _rows(spark, folder, [(1, 1, at(1), 1.0), (2, 2, at(2), 2.0)])
    stream = lambda: spark.readStream.schema("user_id long, event_id long, ts timestamp, value double").parquet(folder)
    latest = lambda df: sorted((r.user_id, r.value) for r in df.collect())
    assert latest(streams.run_upserts(stream(), "u", "user_id", base)) == [(1, 1.0), (2, 2.0)]
    _rows(spark, folder, [(2, 3, at(5), 5.0), (3, 4, at(1), 3.0), (1, 5, at(0), 9.0)])
    assert latest(streams.run_upserts(stream(), "u", "user_id", base)) == [(1, 1.0), (2, 5.0), (3, 3.0)]
    assert latest(streams.run_upserts(stream(), "u", "user_id", base)) == [(1, 1.0), (2, 5.0), (3, 3.0)]
    every = streams.run_to_table(stream(), "t", "append", f"{base}-t")
    assert every.agg(F.count("*")).head()[0] == 5
    empty = f"{tmp_path}/empty"
    spark.createDataFrame([], "user_id long, event_id long, ts timestamp, value double").write.parquet(empty)
    assert streams.run_upserts(spark.readStream.schema(every.schema).parquet(empty), "e", "user_id").count() == 0


def _fixture(spark, wanted, fixtures):
    wanted = spark.createDataFrame(wanted, "match_id long, a string, a_code string, b string, b_code string, starts long")
    fixtures = spark.createDataFrame(fixtures, "fixture_id long, side_1 array<string>, side_2 array<string>, starts long")
    return [tuple(r) for r in matches.fuzzy_fixture(wanted, fixtures).orderBy("match_id").collect()]


def test_names_of_other_scripts_differ(spark):
    wanted = [(1, "Динамо", None, "Зенит", None, 0), (2, "--", None, "??", None, 0), (3, None, None, None, None, 0)]
    fixtures = [(7, ["Спартак"], ["Локомотив"], 0), (8, ["Зенит"], ["динамо"], 0), (9, ["--"], ["??"], 0), (10, None, [None], 0)]
    assert _fixture(spark, wanted, fixtures) == [(1, 0, 8, 2)]


def test_tiers_of_fixtures(spark):
    day = 86_400_000_000
    wanted = [
        (1, "Inner Circle Esports", "inn", "Natus Vincere", "navi", 10 * day),
        (2, "Inner Circle Prospect", "inn", "Natus Vincere", "navi", 10 * day),
        (3, "Dendele CS", None, "Vila Nova", None, 10 * day),
        (4, "Same Names", None, "Twice Met", None, 10 * day),
        (5, "Last Day", None, "Of Block", None, 13 * day),
    ]
    fixtures = [
        (11, ["INN"], ["NAVI"], 11 * day),  # codes of both
        (12, ["Na'Vi"], ["IC eSports"], 9 * day),  # initials, turned
        (13, ["Inner Circle Prospect"], ["natus vincere"], 20 * day),  # another week
        (14, ["DENDELE"], ["Vila-Nova", None], 12 * day),
        (15, ["Same Names"], ["Twice Met"], 9 * day),
        (16, ["Twice Met"], ["Same Names"], 11 * day),  # equally near
        (17, ["Last Day"], ["Of Block"], 14 * day),  # the day beside the block
    ]
    assert _fixture(spark, wanted, fixtures) == [(1, 2, 11, 1), (3, 1, 14, 1), (4, 0, None, None), (5, 0, 17, 1)]

"""Boundary cases of the operators."""

from __future__ import annotations

import random
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.functions import quotes as q
from tidemark.functions import sizing
from tidemark.functions import text as t
from tidemark.operators import asof, backtest, bins, detection, digests, evaluation, graphs, lifecycle, odds, portfolio, relations
from tidemark.operators import quotes as quote_op
from tidemark.sources import readers


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).head())


@pytest.mark.parametrize(
    ("direction", "tie", "want"),
    [("both", "earlier", 90), ("both", "later", 110), ("both", "first", 110), ("both", "last", 90), ("backward", "earlier", 90), ("forward", "earlier", 110)],
)
def test_nearest_ties(spark, direction, tie, want):
    left = spark.createDataFrame([("a", 1, 100), ("a", 2, 500), ("b", 3, 100)], "k string, id long, target long")
    right = spark.createDataFrame([("a", 110, 1), ("a", 90, 2), ("a", 79, 3), ("a", 121, 4)], "k string, tick long, seq long").withColumn("v", F.col("tick"))
    got = {r.id: r.v for r in asof.nearest(left, right, ["k"], ["k", "id"], "target", 20, ["v"], direction, tie, "seq").collect()}
    assert got == {1: want, 2: None, 3: None}


def test_nearest_tolerance_is_inclusive(spark):
    left = spark.createDataFrame([("a", 1, 100)], "k string, id long, target long")
    right = spark.createDataFrame([("a", 80), ("a", 121)], "k string, tick long").withColumn("v", F.col("tick"))
    assert asof.nearest(left, right, ["k"], ["k", "id"], "target", 20, ["v"]).head().v == 80
    assert asof.nearest(left, right, ["k"], ["k", "id"], "target", 19, ["v"]).head().v is None


def test_nearest_against_brute_force(spark):
    rng = random.Random(1)
    left = [(rng.choice("ab"), i, rng.randrange(-1000, 1000)) for i in range(200)]
    right = [(rng.choice("ab"), rng.randrange(-1000, 1000), i) for i in range(200)]
    l, r = spark.createDataFrame(left, "k string, id long, target long"), spark.createDataFrame(right, "k string, tick long, seq long")
    for tolerance in (0, 1, 7, 50, 5000):
        got = {x.id: x.seq for x in asof.nearest(l, r, ["k"], ["k", "id"], "target", tolerance, ["seq"], seq="seq").collect()}
        for k, i, target in left:
            near = [(abs(target - tick), tick, s) for kk, tick, s in right if kk == k and abs(target - tick) <= tolerance]
            assert got[i] == (min(near)[2] if near else None)


def test_latest_before_and_counts(spark):
    left = spark.createDataFrame([("a", 1, 100), ("a", 2, 50), ("b", 3, 9)], "k string, id long, target long")
    right = spark.createDataFrame([("a", 100, 1.0), ("a", 60, 2.0)], "k string, tick long, v double")
    assert {r.id: r.v for r in asof.latest_before(left, right, ["k"], "target", ["v"]).collect()} == {1: 1.0, 2: None, 3: None}
    windows = spark.createDataFrame([("a", 1, 60, 100), ("a", 2, 61, 99), ("b", 3, 0, 9)], "k string, id long, low long, high long")
    assert {r.id: r.n for r in asof.count_between(windows, right, ["k"], ["k", "id"], "low", "high").collect()} == {1: 2, 2: 0, 3: 0}


@pytest.mark.parametrize(
    ("now", "then", "base", "change"),
    [((0.5, 0.6, 0.4), (0.4, 0.5, 0.3), "mid", 0.1), ((None, 0.6, 0.4), (0.4, 0.5, 0.3), "ask", 0.1), ((None, None, 0.4), (None, 0.5, 0.3), "bid", 0.1), ((None, 0.6, None), (0.4, None, 0.3), None, None), ((0.0, None, None), (0.2, None, None), "mid", -0.2)],
)
def test_change_never_mixes_bases(spark, now, then, base, change):
    cols = lambda v: {k: F.lit(x).cast("double") for k, x in zip(("mid", "ask", "bid"), v, strict=True)}
    got = one(spark, q.change_with_base(cols(now), cols(then)).alias("c"))[0]
    assert (got.base, got.change) == (base, change)


def test_books(spark):
    assert one(spark, q.sides(F.lit(0.0), F.lit(0.5)), q.sides(F.lit(0.1), F.lit(1.0)), q.sides(F.lit(0.1), F.lit(0.9)), q.sides(F.lit(None).cast("double"), F.lit(None).cast("double"))) == (1, 1, 2, 0)
    levels = F.array(F.struct(F.lit("0.1").alias("price"), F.lit("5").alias("size")), F.struct(F.lit("0.2").alias("price"), F.lit("bad").alias("size")))
    best = one(spark, q.best_level(levels), q.best_level(F.slice(levels, 1, 0)))
    assert tuple(best[0]) == (0.2, None) and tuple(best[1]) == (None, None)
    rows = spark.createDataFrame([("e", "o", 1, None, None, 0.5, 1), ("e", "o", 2, 0.4, None, 0.5, 2), ("e", "o", 3, 0.4, 0.5, None, 3)], "event_id string, outcome string, tick long, bid double, ask double, mid double, seq long")
    got = {r.seq: (r.mid, r.spread) for r in quote_op.snapshots(rows).collect()}
    assert got == {2: (None, None), 3: (0.45, 0.1)}


def test_evaluation_of_nothing(spark):
    empty = spark.createDataFrame([], "match_id long, checkpoint int, as_of long, version string, p double, market double, y int, liquidity double, spread double")
    row = evaluation.scores(empty, []).head()
    assert row.n == 0 and row.agent is None and row.skill is None
    assert evaluation.reliability(empty, F.col("p"), 0.0, 0.1, 10).count() == 0
    assert evaluation.entity_halves(empty).count() == 0


def test_reliability_edges(spark):
    rows = spark.createDataFrame([(i, p, 1, 0.1) for i, p in enumerate((0.0, 0.3, 0.999, 1.0))], "match_id long, p double, y int, spread double")
    got = {r.bucket: r.n for r in evaluation.reliability(rows, F.col("p"), 0.0, 0.1, 10).collect()}
    assert got == {0: 1, int(0.3 / 0.1): 1, 9: 2}
    assert evaluation.reliability(rows, F.col("p"), 0.5, 0.05, 10).agg(F.sum("n")).head()[0] == 2


@pytest.mark.parametrize("n", [0, 1, 2, 7, 40])
def test_halves_against_sorting(spark, n):
    rng = random.Random(n)
    rows = [(f"m{i:03}", rng.choice([5, 5, 9, 10**15, 10**15 + i])) for i in range(n)]
    df = spark.createDataFrame(rows, "match_id string, as_of long")
    order = [m for m, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    want = {m: "train" if i < n // 2 else "test" for i, m in enumerate(order)}
    assert {r.match_id: r.half for r in evaluation.entity_halves(df).collect()} == want


def test_drawdown(spark):
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate((-1.0, 2.0, -3.0, 1.0))] + [("b", 0, 1.0)], "k string, i int, pnl double")
    got = {r.k: (r.max_drawdown, r.final) for r in backtest.max_drawdown(rows, ["k"], ["i"]).collect()}
    assert got == {"a": (3.0, -1.0), "b": (0.0, 1.0)}


def test_sizing(spark):
    none = F.lit(None).cast("string")
    p = lambda s: sizing.parse_probability(F.lit(s) if s is not None else none)
    got = one(spark, p("62,5 %"), p("101"), p("x"), p(" "), p(None), p("0"))
    assert [tuple(x) for x in got] == [(0.625, None), (None, "out of range"), (None, "not a number"), (None, "empty"), (None, "empty"), (0.0, None)]
    assert one(spark, sizing.basket_edge(F.lit(1.0), F.lit(3)), sizing.basket_edge(F.lit(0.0), F.lit(3)), sizing.basket_edge(F.lit(3.5), F.lit(3))) == (0.0, 0.0, 0.0)
    assert one(spark, sizing.kelly(F.lit(0.1), F.lit(1.0), 0.5, 0.1), sizing.kelly(F.lit(0.9), F.lit(1.0), 0.5, 0.1)) == (0.0, 0.1)
    w = one(spark, sizing.wilson(F.lit(0), F.lit(0)), sizing.wilson(F.lit(5), F.lit(5)))
    assert tuple(w[0]) == (0.0, 1.0) and 0.56 < w[1].low < 0.57 and w[1].high == 1.0


def test_text(spark):
    s = F.lit
    assert one(spark, t.normal_form(s("  A \t b\n")), t.pair_key(s("x"), s("y")) == t.pair_key(s("y"), s("x"))) == ("a b ", True)  # only spaces are trimmed
    assert one(spark, t.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), t.similarity(s("word"), s("Word!"))) == (0.0, 1.0)
    assert one(spark, t.capitalized_runs(s("the New York Times and Paris or Los Angeles")), t.best_of(s("final BO5 now")), t.is_subsequence(s("nv"), s("navi"))) == (["New York Times", "Los Angeles"], 5, True)
    assert one(spark, t.entities(s("$BTC over 100k or 3.5% says FBI"))) == (["$BTC", "BTC", "FBI", "100k", "3.5%"],)
    p = lambda x: t.parse_slug(s(x), ["cs2", "cs2-x"])
    got = one(spark, p("cs2-navi-faze-2026-08-06-map-2"), p("cs2-x-a-b-2026-08-06"), p("cs2-a-b-2026-02-30"), p("nba-a-b-2026-08-06"))
    assert [(r.prefix, r.a, r.b, r.suffix, r.reason) for r in got] == [("cs2", "navi", "faze", "map-2", None), ("cs2-x", "a", "b", None, None), ("cs2", None, None, None, "malformed"), (None, None, None, None, "other")]
    assert tuple(one(spark, t.bin_of(s("<20")))[0]) == (0, 19) and tuple(one(spark, t.bin_of(s("x")))[0]) == (None, None)


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 400)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graphs.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_similar_pairs_are_exact(spark):
    rng = random.Random(4)
    sets = {i: sorted({rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))}) for i in range(80)}
    items = spark.createDataFrame(list(sets.items()), "id long, tokens array<string>")
    for least in (0.3, 0.5, 0.8, 1.0):
        got = {(r.a, r.b) for r in graphs.similar_pairs(items, least).collect()}
        want = {(a, b) for a in sets for b in sets if a < b and round(len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])), 6) >= least}
        assert got == want


def test_bankroll_is_null_with_one_unmarked_leg(spark):
    legs = spark.createDataFrame([(1, "e", "x", 10.0, 0.5, False, None), (1, "f", "x", 10.0, 0.5, False, None), (2, "e", "x", 5.0, 0.5, False, 4.0)], "bet int, event_id string, outcome string, stake double, entry double, closed boolean, shares double")
    latest = spark.createDataFrame([("e", "x", 1, 0.6, None, None)], "event_id string, outcome string, tick long, bid double, mid double, ask double")
    got = {r.bet: (r.staked, r.unmarked, r.marked, r.no_quote) for r in portfolio.bankroll(portfolio.mark(legs, latest), ["bet"]).collect()}
    assert got == {1: (20.0, 1, None, 1), 2: (5.0, 0, 2.4, 0)}


def test_relation_verdicts(spark):
    v = lambda kind, *o: one(spark, relations.verdict(F.lit(kind), F.array(*[F.lit(x).cast("boolean") for x in o])))[0]
    assert [v("implies", True, False), v("implies", False, False), v("excludes", True, True), v("partitions", True, False, False), v("equals", True, None), v("conjunction", True, True, True), v("none", True, True)] == [
        "refuted", "confirmed", "refuted", "confirmed", "untestable", "confirmed", "untestable",
    ]


def test_upsert(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, seq long, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("a", 1, "w"), ("b", 1, "q"), ("c", 1, "n")], "k string, seq long, v string")
    assert {r.k: r.v for r in lifecycle.upsert(base, new, ["k"], "seq").collect()} == {"a": "z", "b": "q", "c": "n"}
    assert {r.k: r.v for r in lifecycle.upsert(base, new, ["k"], "seq", ignore=True).collect()} == {"a": "x", "b": "y", "c": "n"}


def test_retention_of_null_slugs(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 90)], "event_id string, tick long")
    events = spark.createDataFrame([("a", None, "final", False), ("b", "cs2-x", "final", False), ("c", "nba-x", "open", True), ("d", None, "final", False)], "event_id string, slug string, status string, held boolean")
    got = {r.event_id: r.branch for r in lifecycle.deletable(rows, events, 100, 50, 5, [], ["cs2-%"]).collect()}
    assert got == {"a": "old", "b": None, "c": None, "d": None}


def test_orphan_prefixes_are_checked(spark):
    events = spark.createDataFrame([(1, "cs2-a")], "event_id long, slug string")
    with pytest.raises(ValueError, match="prefixes"):
        lifecycle.orphans_by_prefix(events, events, ["cs2%"])


def test_suspensions(spark):
    rows = spark.createDataFrame([(i, i, a, float(i)) for i, a in enumerate((False, True, False, False, True, False))], "created long, seq long, active boolean, price double").withColumn("m", F.lit(1))
    got = sorted((r.start, r.end, r.n, r.before, r.after, r.enclosed) for r in odds.suspensions(rows, ["m"]).collect())
    assert got == [(0, 0, 1, None, 1.0, False), (2, 3, 2, 1.0, 4.0, True), (5, 5, 1, 4.0, None, False)]


def test_bootstraps_agree(spark):
    rng = random.Random(6)
    sums = spark.createDataFrame([("v", i, rng.random() * 10, 10) for i in range(60)], "k string, cluster long, s double, n long")
    a, b = bins.cluster_bootstrap(sums, ["k"], 400).head(), bins.seeded_bootstrap(sums, ["k"], 400).head()
    assert a.mean == pytest.approx(b["mean"]) and abs(a.low - b.low) < 0.03 and abs(a.high - b.high) < 0.03
    assert tuple(a) == tuple(bins.cluster_bootstrap(sums, ["k"], 400).head())


def test_momentum_from_zero(spark):
    rows = spark.createDataFrame([("e", "o", 100, 0.5, 10.0, 0.0, 10.0)], "event_id string, outcome string, tick long, mid double, volume_24h double, past_mid double, past_volume double")
    assert detection.momentum(rows, 100, 10).head().kind == "momentum"


def test_finding_problems(spark):
    rows = spark.createDataFrame([("trap", "0" * 64, "long enough text", None, "grave", None), ("odd", "x", "short", "c", "detail", "s")], "kind string, sha string, passage string, conflict string, severity string, scenario string")
    a, b = digests.finding_problems(rows, ["trap"]).collect()
    assert (a.problems, a.severity) == ([], "detail") and b.problems == ["unknown kind", "bad hash", "short passage", "conflict mismatch"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("# x\n```\none\n```\n```\ntwo\n```\n")
    got = readers.markdown_blocks(spark, str(tmp_path / "a.md"), "(?s)```\\n(.*?)\\n```").collect()
    assert [(r.place, r.block) for r in got] == [(0, "one"), (1, "two")]
    (tmp_path / "b.jsonl").write_text('{"id": 1, "outcomePrices": "[\\"0.4\\"]", "volume": "x"}\nbroken\n')
    rows = readers.market_records(readers.json_lines(spark, str(tmp_path / "b.jsonl"), readers.MARKET).select(F.to_json(F.struct("*")).alias("body"))).collect()
    assert rows[0].yes == 0.4 and rows[0].volume is None
    readers.append(spark.range(3).withColumn("day", F.lit(1)), f"{tmp_path}/out", ["day"])
    readers.append(spark.range(2).withColumn("day", F.lit(2)), f"{tmp_path}/out", ["day"])
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    assert one(spark, readers.start_time(F.lit("2026-08-06 10:00:00+00")).isNotNull(), readers.start_time(F.lit("soon")).isNull()) == (True, True)


def test_the_rest_works_without_the_training_data_part(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class Block(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, *a):\n"
        "        if name.startswith('tidemark.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e\n"
        "assert 'radar_latest' in e.queries() and not any(x.startswith('op') and x[2].isdigit() for x in e.queries()) and 'pipeline' not in e.queries()\n"
        "e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_first_sentences_and_search_form(spark):
    s = lambda v: F.lit(v).cast("string")
    text = s("One two.  Three\nfour! Five six seven")
    assert one(spark, t.first_sentences(text, 24), t.first_sentences(text, 80), t.first_sentences(s("abcdefgh ijklmnop"), 12)) == ("One two. Three four!", "One two. Three four! Five six seven", "abcdefgh…")
    assert one(spark, t.search_form(s("It’s  “so” – yes")), t.search_form(s(None))) == ("it's \"so\" - yes", None)


def test_excerpt_and_first_hit(spark):
    s = lambda v: F.lit(v).cast("string")
    fields = [("a", s("nothing")), ("b", s("x" * 50 + " worth it"))]
    hit = t.first_hit(fields, [(r"(?i)\bodds\b", "odds"), (r"(?i)\bworth\b", "worth")])
    assert one(spark, hit["field"], hit["term"], hit["excerpt"]) == ("b", "worth", "x" * 39 + " worth it")
    assert one(spark, t.first_hit(fields[:1], [("worth", "worth")]).isNull()) == (True,)


def test_similar_pairs_against_all_pairs(spark):
    draw = random.Random(5)
    sets = [(i, sorted(draw.sample("abcdefghij", draw.randint(0, 6)))) for i in range(60)] + [(60, None), (61, ["a"]), (62, ["a"])]
    items = spark.createDataFrame(sets, "id int, tokens array<string>")
    for least in (0.4, 0.6, 1.0):
        want = {(a, b) for a, x in sets for b, y in sets if a < b and x and y and len({*x} & {*y}) / len({*x, *y}) >= least}
        found = [(r.a, r.b) for r in graphs.similar_pairs(items, least).collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_component_chunks(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 70_000), (70_000, 140_000), (5, 6)], "a long, b long")
    rows = sorted(tuple(r) for r in graphs.component_chunks(pairs, 3).collect())
    assert rows == [(1, 1, 4, 0), (2, 1, 4, 0), (5, 5, 2, 0), (6, 5, 2, 0), (70_000, 1, 4, 0), (140_000, 1, 4, 1)]


def test_nested_odds(spark):
    from tidemark.sources import nested

    bodies = [
        (1, '{"bookmakers":[{"key":"k","markets":[{"name":"m","price":2},{"outcomes":{"o":{"label":"x","p":[{"price":"no"},{"price":1.5,"is_active":false}]}}}]},7]}'),
        (2, '{"bookmakers":{"s":{"price":true}}}'), (3, "no json"), (4, None), (5, "[]"), (6, '{"bookmakers":[{}]}'),
    ]
    rows = {tuple(r) for r in nested.odds_entries(spark.createDataFrame(bodies, "id long, body string")).collect()}
    assert rows == {
        (1, "k", "bookmakers.0.markets.0", "m", 2.0, None), (1, "k", "bookmakers.0.markets.1.outcomes.o.p.0", "x", None, None),
        (1, "k", "bookmakers.0.markets.1.outcomes.o.p.1", "x", 1.5, False), (2, "s", "bookmakers.s", None, None, None),
    }


def test_execution_reasons_and_outcomes(spark):
    from tidemark.operators import datasets

    matches = spark.createDataFrame([(i, str(i), "A", 600_000_000) for i in range(1, 8)], "match_id int, event_id string, team string, scheduled_at long")
    side = lambda e, o, mid, ask, tick=0: (str(e), o, tick, mid, ask, 1)
    rows = [
        side(1, "A", 0.6, 0.61), side(2, "A", 0.4, 0.41), side(2, "B", None, 0.6), side(3, "A", 0.4, 0.4), side(3, "B", 0.6, 0.6), side(3, "C", 0.6, 0.6),
        side(4, "A", 0.5, 0.5), side(5, "A", None, 0.5), side(6, "A", 0.7, None), side(7, "A", 0.7, 0.7, 10**10),
    ]
    quotes = spark.createDataFrame(rows, "event_id string, outcome string, tick long, mid double, ask double, seq int")
    found = {r.match_id: (r.label, r.mid, r.reason) for r in datasets.execution_prices(matches, quotes, [10], 1_000).collect()}
    assert found == {
        1: ("A", 0.6, None), 2: ("B", 0.6, None), 3: (None, None, "no_favourite_side"), 4: (None, None, "tie"), 5: (None, None, "no_mid"), 6: (None, None, "no_ask"), 7: (None, None, "no_snapshot"),
    }
    series = {r.match_id: r.series for r in datasets.series_coverage(matches.withColumn("team", F.when(F.col("match_id") == 2, "Z").otherwise(F.col("team"))), quotes.filter("event_id <> '1'"), [10], 1_000).collect()}
    assert (series[1], series[2], series[3], series[7]) == ("no_series", "other_sides_only", "anchored", "anchorless")


def test_conjunction_of_one_market_is_untestable(spark):
    v = lambda *o: one(spark, relations.verdict(F.lit("conjunction"), F.array(*[F.lit(x).cast("boolean") for x in o])))[0]
    assert [v(True), v(False), v(True, True), v(True, False), v(False, False)] == ["untestable", "untestable", "confirmed", "refuted", "confirmed"]


def test_refutation_rates_with_customers_of_one_order(spark, tmp_path):
    from tidemark import registry

    spark.createDataFrame([(1, 4, "F"), (2, 10, "O"), (3, 6, "F"), (4, 6, "O")], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    rows = {r.kind: (r.n, r.refuted) for r in registry.queries()["refutation_rates"](spark, str(tmp_path)).collect()}
    assert rows == {"conjunction": (0, 0), "implies": (1, 1)}


def test_stakes_are_rounded_as_in_sql(spark):
    assert one(spark, sizing.stake(F.lit(1899.75), F.lit(0.4) * 10, 0.05)) == (37.99,)


def test_lead_ratios_are_rounded_as_in_sql(spark):
    legs = spark.createDataFrame([(1, 1, 160000.09), (1, 2, 20000.0), (1, 3, 0.0), (2, 4, 40000.49), (2, 5, 20000.0)], "group long, id long, volume double")
    assert {(r.other, r.ratio) for r in graphs.lead_pairs(legs).collect()} == {(2, 8.000004), (3, float("inf")), (5, 2.000024)}


@pytest.mark.parametrize("most_met", [0, 2])
def test_similar_pairs_by_extended_keys(spark, monkeypatch, most_met):
    monkeypatch.setattr(graphs, "MOST_MET", most_met)
    monkeypatch.setattr(graphs, "DEAL", 3)
    draw = random.Random(9)
    sets = [(i, draw.sample("abcdefghij", draw.randint(0, 7))) for i in range(60)] + [(i, ["a", "b", "z"]) for i in range(60, 70)]
    items = spark.createDataFrame(sets, "id int, tokens array<string>")
    count = {t: sum(t in x for _, x in sets) for t in "abcdefghijz"}
    for least, share in ((0.3, None), (0.6, None), (1.0, None), (0.3, 0.4)):
        blocks = {t for t, n in count.items() if share is None or 2 <= n <= max(2, int(len(sets) * share))}
        want = sorted((a, b, round(len({*x} & {*y}) / len({*x, *y}), 6)) for a, x in sets for b, y in sets if a < b and {*x} & {*y} & blocks and round(len({*x} & {*y}) / len({*x, *y}), 6) >= least)
        assert sorted(tuple(r) for r in graphs.similar_pairs(items, least, 2, share).collect()) == want


def _copied_titles(spark):
    """20,000 copies of one title, two of another that is similar, one title alone."""
    copy = F.when(F.col("id") < 20_000, F.array(*map(F.lit, "abcde"))).when(F.col("id") < 20_002, F.array(*map(F.lit, "abcdf"))).otherwise(F.array(F.lit("q")))
    return spark.range(20_003).select("id", copy.alias("tokens"))


def test_links_of_copies_are_counted_by_classes(spark):
    rows = {(r.id >= 20_000, r.links) for r in graphs.link_counts(_copied_titles(spark), 0.6).collect()}
    assert rows == {(False, 20_001), (True, 20_001)}


def test_chunks_of_copies(spark):
    rows = {r.id: (r.component, r.members, r.part) for r in graphs.similar_chunks(_copied_titles(spark), 0.6, 2).collect()}
    assert rows == {i: (0, 20_002, i // 2) for i in range(20_002)}


def test_subjects_of_copies(spark):
    rows = {(r.id == 20_002, r.component, r.members, r.label) for r in graphs.subjects(_copied_titles(spark), 0.6).collect()}
    assert rows == {(False, 0, 20_002, "a"), (True, 20_002, 1, "—")}


def test_search_among_copies(spark):
    """Every item is a query: 4,000 copies of one title beside 4,000 of another have 32 million hits, but one pair of kinds."""
    words = F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("c")))
    items = spark.range(8000).select("id", words.alias("tokens")).unionByName(spark.createDataFrame([(9000, ["c", "d"])], "id long, tokens array<string>"))
    found = {}
    for r in graphs.search(items, items, 0.6, 3).collect():
        found.setdefault(r.query, []).append((r.rank, r.id, r.score))
    assert len(found) == 8001
    assert all(sorted(v) == [(1, q % 2, 1.0), (2, q % 2 + 2, 1.0), (3, q % 2 + 4, 1.0)] for q, v in found.items() if q < 9000)
    assert [(r, i) for r, i, _ in sorted(found[9000])] == [(1, 9000), (2, 1), (3, 3)]


def test_fixtures_of_equal_names_are_counted_not_paired(spark):
    """20,000 matches and 20,000 fixtures of the same names have 400 million pairs."""
    from tidemark.operators import matches

    day = 86_400_000_000
    starts = F.lit(10 * day) + F.when(F.col("id") == 7, F.lit(3_600_000_000)).when(F.col("id") == 8, F.lit(-day)).otherwise(F.lit(0))
    fixtures = spark.range(20_000).select(F.col("id").alias("fixture_id"), F.array(F.lit("Red Comet")).alias("side_1"), F.array(F.lit("Silver Foxes"), F.lit("SF")).alias("side_2"), starts.cast("long").alias("starts"))
    at = F.lit(10 * day) + F.when(F.col("id") % 2 == 0, F.lit(4_000_000_000)).otherwise(F.lit(0))
    none = F.lit(None).cast("string")
    wanted = spark.range(20_000).select(F.col("id").alias("match_id"), F.lit("silver foxes").alias("a"), none.alias("a_code"), F.lit("The Red Comet").alias("b"), none.alias("b_code"), at.cast("long").alias("starts"))
    found = matches.fuzzy_fixture(wanted, fixtures).groupBy(F.col("match_id") % 2, "tier", "fixture_id", "side_a").count().collect()
    assert {tuple(r) for r in found} == {(0, 1, 7, 2, 10_000), (1, 1, None, None, 10_000)}


def test_candidates_among_copies_of_frequent_tokens(spark):
    """30 copies share a token that blocks and 2,000 copies of another title only frequent ones, which must not meet."""
    common = [F.lit(x) for x in "abcd"]
    words = F.when(F.col("id") < 30, F.array(*common, F.lit("rare"))).when(F.col("id") < 31, F.array(F.lit("rare"), *common[:2])).otherwise(F.array(*common))
    rows = graphs.similar_pairs(spark.range(2031).select("id", words.alias("tokens")), 0.4, 2, 0.02).collect()
    assert {(r.a, r.b, r.score) for r in rows} == {(a, b, 1.0) for a in range(30) for b in range(a + 1, 30)} | {(a, 30, 0.6) for a in range(30)}
    assert len(rows) == 465


@pytest.mark.parametrize("slots", [1, 4, 8])
def test_similar_pairs_of_longer_sets(spark, monkeypatch, slots):
    """Sets of up to 14 tokens, some of them copies, with less than all, and more than all, of their tokens in columns."""
    monkeypatch.setattr(graphs, "MOST_MET", 1)
    monkeypatch.setattr(graphs, "DEAL", 3)
    monkeypatch.setattr(graphs, "SLOTS", slots, raising=False)
    draw = random.Random(slots)
    sets = [(i, draw.sample("abcdefghijklmnop", draw.randint(0, 14))) for i in range(60)]
    sets += [(i + 60, x[::-1]) for i, x in sets[:12]] + [(i + 72, sets[0][1]) for i in range(8)]
    items = spark.createDataFrame(sets, "id long, tokens array<string>")
    count = {t: sum(t in x for _, x in sets) for t in "abcdefghijklmnop"}
    for least, share in ((0.5, None), (0.4, 0.55)):
        blocks = {t for t, n in count.items() if share is None or 2 <= n <= max(2, int(len(sets) * share))}
        want = sorted((a, b, round(len({*x} & {*y}) / len({*x, *y}), 6)) for a, x in sets for b, y in sets if a < b and {*x} & {*y} & blocks and round(len({*x} & {*y}) / len({*x, *y}), 6) >= least)
        assert want and sorted(tuple(r) for r in graphs.similar_pairs(items, least, 2, share).collect()) == want


def test_pairs_among_distinct_titles_with_frequent_tokens(spark):
    """100,000 titles of seven tokens, all different, share three, which is too few for 0.4: 5 billion pairs that must not meet; two titles share four."""
    own = [F.concat(F.lit(x), F.when(F.col("id") < 2, 0).otherwise(F.col("id")).cast("string") if x == "n" else F.col("id").cast("string")) for x in "nopq"]
    items = spark.range(100_000).select("id", F.array(*own, *map(F.lit, "abc")).alias("tokens"))
    stop = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        assert [tuple(r) for r in graphs.similar_pairs(items, 0.4).collect()] == [(0, 1, 0.4)]
    finally:
        stop.cancel()


def test_refutation_rates_with_orders_without_keys(spark, tmp_path):
    """SQL lists null keys last, so an order without a key is a market without an outcome."""
    import duckdb

    from tidemark import registry

    rows = [(1, 4, "F"), (2, 4, "F"), (None, 4, "F"), (3, 6, "F"), (None, 6, "O"), (4, 10, "F"), (5, 10, "F"), (6, None, "F"), (None, None, "O")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    for name in ("relation_verdicts", "refutation_rates"):
        got = sorted(map(repr, map(tuple, registry.queries()[name](spark, str(tmp_path)).collect())))
        assert got == sorted(map(repr, duck.sql(registry.oracle_sql()[name]).fetchall()))


@pytest.mark.parametrize("most_counting", [0, 2, 8])
def test_search_by_subsets_against_all_pairs(spark, monkeypatch, most_counting):
    import math

    monkeypatch.setattr(graphs, "MOST_COUNTING", most_counting)
    draw = random.Random(4)
    sets = {i: set(draw.sample("abcdefghij", draw.randint(0, 5))) for i in range(120)}
    items = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "id long, tokens array<string>")
    df = {t: sum(t in x for x in sets.values()) for t in "abcdefghij"}
    weight = {t: math.log(len(sets) / n) for t, n in df.items() if n <= len(sets) * 0.26}
    assert 0 < len(weight) < len(df)
    want = set()
    for q in range(0, 120, 3):
        own = sets[q] & weight.keys()
        scored = [(-round(sum(weight[t] for t in sorted(own & x)) / sum(weight[t] for t in sorted(own)), 6), i) for i, x in sets.items() if own & x]
        want |= {(q, i, -s, r) for r, (s, i) in enumerate(sorted(scored)[:4], 1)}
    assert {tuple(r) for r in graphs.search(items, items.filter("id % 3 = 0"), 0.26, 4).collect()} == want


def test_search_of_distinct_items_with_frequent_tokens(spark):
    """120,000 items, all different and all queries, half with one frequent token and half with another: 7.2 billion hits."""
    words = F.array(F.when(F.col("id") % 2 == 0, "even").otherwise("odd"), F.concat(F.lit("n"), F.col("id").cast("string")))
    items = spark.range(120_000).select("id", words.alias("tokens"))
    rows = graphs.search(items, items, 0.5, 3)
    assert rows.groupBy("rank").count().orderBy("rank").collect() == [(1, 120_000), (2, 120_000), (3, 120_000)]
    assert rows.filter("rank = 1 AND id <> query").count() == 0
    assert sorted(r.id for r in rows.filter("query = 90001").collect()) == [1, 3, 90001]


def test_components_compute_their_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def next_id(i):
        made.add(1)
        return i + 1

    edges = spark.range(100).select(F.col("id").alias("a"), F.udf(next_id, "long").asNondeterministic()("id").alias("b"))
    assert {r.component for r in graphs.connected_components(edges).collect()} == {0}
    assert made.value == 100

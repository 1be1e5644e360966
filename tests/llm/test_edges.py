"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tidemark.llm import chat_format, class_lm, decontamination, line_dedup, mixing, quality_rules, rule_ensemble, simhash, substring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("n_words", "kept", "copy", "shuffle_key", "score", "fp", "row", "unit", "sha", "key", "words", "at", "set", "line", "held_out", "label", "positive", "bucket", "prediction", "band_group", "n_lines_removed")


def _rows() -> list[tuple]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeiou") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(70), text(14)
    rows = [
        (1, f"{text(30)}\n{passage} {text(20)}"), (2, f"{passage}\n{line}"), (3, f"{line}\n\n{text(8)}\r\n{passage} x"), (4, None), (5, ""), (6, " \t\n\v\f\r "),
        (7, text(25_000)), (8, "A" * 100_000), (9, f"{line.upper()} extra\n{text(12)}"), (9, f"{line} again\n{text(60)}"), (10, passage), (10, passage), (None, f"{passage}\n{line}"), (None, None),
        (11, "b b b b b b b b b b b b b b b b b b b b b b b b b b"), (12, "é ü ß " * 30), (13, "x\ny\nx\ny\n" * 20), (14, passage + " " + passage), (-5, text(55)),
    ]
    return [(d, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None) for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(_rows(), SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, None, 1), (3, 0, None), (4, 1, 1), (None, 1, 1), (3, 0, 0), (3, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def _sorted(rows):
    return sorted(rows, key=repr)


def test_quality_rules(docs, none):
    got = quality_rules.quality_rules(docs).collect()
    assert _sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == _sorted((r[0], *brute.rules(r[1])) for r in _rows())
    assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules.quality_rules(none).count() == 0
    kept = quality_rules.keep_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules.keep_documents(none).count() == 0


def test_classifiers(docs, none, labels):
    for f in (rule_ensemble.quality_scores, toxicity.toxicity_scores):
        got = f(docs, labels).collect()
        assert _sorted(r.doc_id for r in got) == _sorted(r[0] for r in _rows())
        assert all(0 <= r.score <= 1 for r in got)
        assert f(none, labels).count() == 0
        assert {r.score for r in f(docs, labels.filter("false")).collect()}
    assert {r.score for r in rule_ensemble.quality_scores(docs, labels.filter("false")).collect()} == {0.5}


def test_language_model(docs, none):
    got = class_lm.lm_scores(docs).collect()
    assert len(got) == len(_rows())
    tokens = {(d, t): [*brute.WORD.findall(brute.lower(t or "")), None] for d, t, *_ in _rows()}
    train = [x for d, t, *_ in _rows() if brute.fold(d, 7) != 2 for x in tokens[d, t]]
    assert {r.train_tokens for r in got} == {len(train)}
    assert _sorted((r.doc_id, r.n_tokens, r.n_known) for r in got) == _sorted((d, len(tokens[d, t]), sum(x in set(train) for x in tokens[d, t])) for d, t, *_ in _rows())
    assert all(r.score < 0 and r.base_score < 0 for r in got)
    assert class_lm.lm_scores(none).count() == 0


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    fps = [(d, brute.fingerprint(t)) for d, t, *_ in _rows()]
    assert _sorted((r.doc_id, r.fingerprint) for r in got) == _sorted((d, f"{f:016x}") for d, f in fps)
    linked = brute.components({(i if d is None else d, i): f for i, (d, f) in enumerate(fps) if d is not None})
    want = _sorted((d, linked[d, i][0]) for i, (d, f) in enumerate(fps) if d is not None)
    assert _sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns


def test_large_shards_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {}
    for i in range(300):
        f = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            f ^= 1 << rng.randrange(64)
        fps[i] = f
    distinct = sorted(set(fps.values()))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in distinct], "fp long")
    links = simhash.fingerprint_links(df)
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(links).collect()}
    want = brute.components({i: f for i, f in enumerate(distinct)})
    groups = lambda of: {frozenset(k for k in range(len(distinct)) if of(k) == v) for v in map(of, range(len(distinct)))}
    assert groups(lambda k: roots.get(distinct[k], distinct[k])) == groups(lambda k: want[k])


def test_decontamination(spark, docs, none):
    text = {d: t for d, t, *_ in _rows()}
    items = [(1, " ".join(text[2].split()[5:40])), (2, "b b"), (3, None), (4, " -- "), (None, " ".join(text[2].split()[:12])), (1, " ".join(text[2].split()[5:40])), (5, "zzz yyy")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    got = {(r.doc_id, r.n_words): r for r in decontamination.contamination(docs, benchmark).collect()}
    assert got[11, 26].n_hit == 26 and got[11, 26].n_items == 1
    assert got[2, len(text[2].split())].n_hit >= 35 and got[4, 0].n_hit == 0 and not got[4, 0].contaminated
    assert decontamination.contamination(none, benchmark).count() == 0
    assert decontamination.contamination(docs, benchmark.filter("false")).filter("contaminated").count() == 0
    left = decontamination.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns and 2 not in {r.doc_id for r in left.collect()}


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten"
    rows = {
        1: item, 2: "x " + item.replace("five", "five q q q q q") + " y", 3: item.replace("five", "five q q q q q q"), 4: "ten nine eight seven six five four three two one",
        5: item.replace("ten", "eleven"), 6: "red x red", 7: "two two three", 8: "z " * 30 + "three two", 9: None, 10: "three " + "q " * 14 + "two", 11: "three " + "q " * 13 + "two",
    }
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item), (2, "red"), (3, "two three two"), (4, "absent words"), (None, "red")], "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near_items) for r in decontamination.contamination(docs, benchmark).collect()}

    def near(text, window, span=15):
        words = (text or "").split()
        return any(set(window.split()) <= set(words[s : s + span]) for s in range(len(words)))

    items = (item, "red", "two three two")
    want = {d: sum(near(t, i) for i in items) for d, t in rows.items()}
    assert {d: n for d, (_, n) in got.items()} == want and want[2] == 2 and want[3] == 1 and want[10] == 0 and want[11] == 1
    assert {d: n for d, (n, _) in got.items() if n} == {1: 1, 6: 1}


def test_substrings(spark, docs, none):
    rows = [(d, t) for d, t, *_ in _rows() if d is not None and d not in (9, 10)]
    got = substring.repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.substring_removed(rows)
    every = substring.repeated_substrings(docs).collect()
    assert len(every) == len(_rows())
    same = [r for r in every if r.doc_id == 10]
    assert len(same) == 2 and same[0] == same[1] and same[0].n_removed == 70
    assert all(r.n_removed == 0 for r in every if r.doc_id is None)
    assert substring.repeated_substrings(none).count() == 0


def test_lines(docs, none):
    out = line_dedup.dedup_lines(docs)
    assert out.columns[: len(SCHEMA.split(","))] == docs.columns[: len(SCHEMA.split(","))] and out.count() == len(_rows())
    assert all(r.text is None for r in out.filter("doc_id = 4").collect())
    assert line_dedup.dedup_lines(none).count() == 0
    rows = [(d, t) for d, t, *_ in _rows() if d is not None and d not in (9, 10)]
    got = line_dedup.removed_lines(docs.sparkSession.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: sorted(r.lines) for r in got.collect()} == brute.line_removals(rows)


def test_mixing(docs, none):
    out = mixing.mix_sources(docs, {"s1": 0.5})
    assert [c for c in out.columns if c not in docs.columns] == [] and out.count() > 0
    again = mixing.mix_sources(docs, {"s1": 0.5})
    assert _sorted((r.doc_id, r.copy, r.shuffle_key) for r in out.collect()) == _sorted((r.doc_id, r.copy, r.shuffle_key) for r in again.collect())
    assert mixing.mix_sources(none, {"s1": 0.5}).count() == 0
    assert mixing.mix_sources(docs, {"s1": 0.0}).filter("source = 's1'").count() == 0
    with pytest.raises(ValueError, match="weights"):
        mixing.mix_sources(docs, {"a": 0.7, "b": 0.7})


def test_mixing_reaches_its_targets(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 100 == 1, "rare").otherwise("rest").alias("source"))
    n = {r.source: r["count"] for r in mixing.mix_sources(docs, {"big": 0.1, "rare": 0.5}).groupBy("source").count().collect()}
    total = sum(n.values())
    assert abs(n["big"] / total - 0.1) < 0.01 and abs(n["rare"] / total - 0.5) < 0.02 and abs(total - 30_000) < 1_500


def test_chat_format(spark):
    rows = [
        (1, 0, "user", "a%25<s>[INST]"), (1, 1, "assistant", "</s>\\ \n[/INST] é"), (1, 1, "assistant", "again"), (1, 2, None, None), (2, 0, "assistant", ""), (None, None, "we[ird\nrole", "x"), (3, 0, "user", "only"),
        (1, 1, "assistant", "again"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    formatted = chat_format.format_conversations(turns)
    first = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    import hashlib

    for r in chat_format.digest(chat_format.expand_examples(formatted)).collect():
        own = sorted((x for x in rows if x[0] == r.conv_id), key=first)
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    every = chat_format.expand_examples(formatted).collect()
    examples = [e for e in every if e.reply is not None]
    assert len(examples) == 4 and len(every) == 7 and sum(e.last for e in every) == 4
    assert all(e.last and e.loss_start == e.loss_end for e in every if e.reply is None)
    assert [len(e.context) for e in examples if e.conv_id == 1] == sorted({len(e.context) for e in examples if e.conv_id == 1})
    for e in examples:
        whole = e.context + e.reply
        assert whole[e.loss_start : e.loss_end] == e.reply[3:-4] and e.reply.startswith("<s>") and e.reply.endswith("</s>")
    assert chat_format.digest(chat_format.expand_examples(chat_format.format_conversations(turns.filter("false")))).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rows = [r for r in _rows() if r[1] is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(rows[0][1].split()[:12]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "mixing":
            assert docs.columns == want
    ids = {r.doc_id for r in docs.collect()}
    assert 1 not in ids and 5 not in ids and 11 not in ids

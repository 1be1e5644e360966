"""Substring dedup with repeated-phrase automata.

1. Anchors. Every window of ``size`` words has a minimizer, the least hash of its half-size
   grams. Equal windows have equal minimizers, so only windows whose minimizer stands in two
   documents can recur; all others are never shuffled.
2. Passages. The remaining windows are counted by hash. In the document with the smallest
   doc_id that holds a window seen elsewhere too, runs of such windows are its passages: each
   recurring text is kept once, in its first document.
3. Automata. Passages go to shards of bounded size. In a shard, half-size tiles of the
   passages make one Aho-Corasick automaton over words; every document that holds a recurring
   window of the shard streams through it, and each hit is extended word by word. Runs of at
   least ``size`` words are occurrences, compared exactly and not by hash.

Whole copies of a text are folded first: all but the first lose every window.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import discard, release_shuffles, stored
from ._text import BYTE, WORD, Piece, mix, pieces, range_hash, running, windows

#: Words of passages in one automaton, on average, and words streamed through one task of it.
SHARD_WORDS = 150_000
TASK_WORDS = 600_000


def _text_of(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    start, end, text = piece.ranges(WORD[piece.data])
    return range_hash(running(BYTE[piece.data]), start, end), text


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """min(values[i : i + width]) for every i."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def minimizers(piece: Piece, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of ``size`` words: its text, place in the text, minimizer, and hash."""
    hashes, text = _text_of(piece)
    gram = size // 2
    at, window = windows(hashes, text, size)
    if not len(at):
        return text[:0], at, window, window
    n = len(hashes) - gram + 1
    every = np.arange(n)
    low = _sliding_min(range_hash(running(hashes), every, every + gram), size - gram + 1)
    first = np.searchsorted(text, np.arange(piece.n))
    return text[at], at - first[text[at]], low[at], window


def _lists(owner: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.bincount(owner, minlength=n).cumsum()]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def _digests(piece: Piece) -> tuple[list[int], list[bytes]]:
    counts, digests = [], []
    data, offsets = piece.data.tobytes(), piece.offsets.tolist()
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        own = data[a:b].split()
        counts.append(len(own))
        digests.append(hashlib.sha256(b" ".join(own)).digest())
    return counts, digests


def describe(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_words, sha, anchors) of rows (doc_id, text): the words' SHA-256 and the distinct minimizers."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                counts, digests = _digests(piece)
                text, _, low, _ = minimizers(piece, size)
                order = np.lexsort((low, text))
                text, low = text[order], low[order]
                new = np.ones(len(low), dtype=bool)
                new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
                anchors = _lists(text[new], piece.n, low[new].view(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[piece.first : piece.first + piece.n], pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), anchors],
                    ["doc_id", "n_words", "sha", "anchors"],
                )

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, n_words long, sha binary, anchors array<long>")


def candidate_windows(rows: DataFrame, size: int) -> DataFrame:
    """(unit, doc_id, text, places, hashes) of rows (unit, doc_id, sha, anchors, text).

    The windows are those whose minimizer is among ``anchors``. Rows whose text is not the
    one that ``sha`` stands for, which repeated doc_ids bring about, are left out.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(4)):
                own = slice(piece.first, piece.first + piece.n)
                _, digests = _digests(piece)
                right = np.array([a == b for a, b in zip(digests, batch.column(2)[own].to_pylist(), strict=True)], dtype=bool)
                lists = batch.column(3)[own]
                anchors = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                owner = np.repeat(np.arange(piece.n), lists.value_lengths().fill_null(0).to_numpy())
                text, place, low, window = minimizers(piece, size)
                wanted = np.isin(mix(low ^ mix(text)), mix(anchors ^ mix(owner))) & right[text]
                text, place, window = text[wanted], place[wanted], window[wanted]
                out = pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[own], batch.column(1)[own], batch.column(4)[own],
                        _lists(text, piece.n, place.astype(np.int32), pa.int32()), _lists(text, piece.n, window.view(np.int64), pa.int64()),
                    ],
                    ["unit", "doc_id", "text", "places", "hashes"],
                )
                yield out.filter(pa.array(np.bincount(text, minlength=piece.n) > 0))

    schema = "unit long, doc_id long, text string, places array<int>, hashes array<long>"
    return rows.select("unit", "doc_id", "sha", "anchors", "text").mapInArrow(apply, schema)


def passages_of(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, passage) of rows (doc_id, text, places): the words of maximal runs of windows, space-joined."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, found = [], [], []
            for doc_id, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = text.as_py().encode().split()
                at = np.sort(places.values.to_numpy())
                cut = np.flatnonzero(np.diff(at) > 1) + 1
                for run in np.split(at, cut):
                    passage = words[run[0] : run[-1] + size]
                    ids.append(doc_id)
                    sizes.append(len(passage))
                    found.append(b" ".join(passage).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.string())], ["doc_id", "n", "passage"])

    return rows.select("doc_id", "text", "places").mapInArrow(apply, "doc_id long, n long, passage string")


class PhraseAutomaton:
    """Finds every run of at least ``size`` words that a text shares with one of the passages.

    A window of ``size`` words of a passage holds one of the passage's half-size tiles whole. The automaton
    finds the tiles, and the windows around them are compared with the one passage window of
    their hash that has the smallest doc_id: one comparison a window, however often it stands there.
    """

    def __init__(self, passages: list[tuple[int, bytes]], size: int):
        self.size, self.tile = size, size // 2
        self.vocabulary: dict[bytes, int] = {}
        texts = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in passage.split()] for _, passage in passages]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for ids in texts:
            for at in range(0, len(ids) - self.tile + 1, self.tile):
                self.automaton.add_word(tuple(ids[at : at + self.tile]), 1)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.ids = np.array([x for ids in texts for x in ids], dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(ids) for ids in texts])
        places, keys = windows(mix(self.ids), owner, size)
        first = np.array([doc_id for doc_id, _ in passages], dtype=np.int64)[owner[places]]
        order = np.lexsort((first, keys))
        self.keys, one = np.unique(keys[order], return_index=True)
        self.places, self.first = places[order][one], first[order][one]

    def runs(self, doc_id: int, words: list[bytes]) -> list[tuple[int, int]]:
        """Word ranges [start, end) of the text that stand in passages of smaller doc_ids."""
        if not len(self.keys) or len(words) < self.size:
            return []
        known = self.vocabulary.get
        ids = tuple([known(w, 0) for w in words])
        begins = np.array([end for end, _ in self.automaton.iter(ids)], dtype=np.int64) - self.tile + 1
        steps = np.zeros(len(ids) + 1, dtype=np.int64)
        np.add.at(steps, np.maximum(begins - (self.size - self.tile), 0), 1)
        np.add.at(steps, begins + 1, -1)
        start = np.flatnonzero(np.cumsum(steps)[: len(ids) - self.size + 1])
        text = np.array(ids, dtype=np.int64)
        key = range_hash(running(mix(text)), start, start + self.size)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[at] == key) & (self.first[at] < doc_id)
        start, at = start[found], self.places[at[found]]
        own = np.arange(self.size)
        same = [(text[a[:, None] + own] == self.ids[b[:, None] + own]).all(1) for a, b in ((start[i : i + 4096], at[i : i + 4096]) for i in range(0, len(start), 4096))]
        start = start[np.concatenate([*same, np.zeros(0, bool)])]
        return [(int(x[0]), int(x[-1]) + self.size) for x in np.split(start, np.flatnonzero(np.diff(start) > self.size) + 1) if len(x)]


def locate(rows: DataFrame, size: int) -> DataFrame:
    """(unit, spans array<int>) of rows (shard, salt, kind, id, doc_id, text) that are sorted by these columns.

    In a (shard, salt), rows of kind 0 are passages and come first; rows of kind 1 are documents.
    ``spans`` holds starts and ends of word ranges in turn.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple | None = None
        waiting: list[tuple[int, bytes]] = []
        automaton: PhraseAutomaton | None = None
        for batch in batches:
            units, spans = [], []
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for i, (shard, salt, kind, unit, doc_id) in enumerate(zip(*columns, strict=True)):
                if place != (shard, salt):
                    place, waiting, automaton = (shard, salt), [], None
                text = batch.column(5)[i].as_py().encode()
                if kind == 0:
                    waiting.append((doc_id, text))
                    continue
                if automaton is None:
                    automaton = PhraseAutomaton(waiting, size)
                    waiting = []
                runs = automaton.runs(doc_id, text.split())
                if runs:
                    units.append(unit)
                    spans.append([x for run in runs for x in run])
            if units:
                yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(spans, pa.list_(pa.int32()))], ["unit", "spans"])

    return rows.mapInArrow(apply, "unit long, spans array<int>")


def _covered(spans: list[int], n: int) -> np.ndarray:
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, np.asarray(spans[0::2], dtype=np.int64), 1)
    np.add.at(steps, np.asarray(spans[1::2], dtype=np.int64), -1)
    return np.cumsum(steps)[:-1] > 0


def remove(rows: DataFrame) -> DataFrame:
    """(unit, n_removed, kept_sha, kept) of rows (unit, text, spans): the words outside all spans, space-joined."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, kept = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode().split()
                gone = _covered(spans, len(words))
                left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(left).digest())
                kept.append(left.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(digests, pa.binary()), pa.array(kept, pa.string())], ["unit", "n_removed", "kept_sha", "kept"]
            )

    return rows.select("unit", "text", "spans").mapInArrow(apply, "unit long, n_removed long, kept_sha binary, kept string")


def _pieces_of_work(texts: DataFrame, links: DataFrame, size: int) -> DataFrame:
    """Rows for :func:`locate`. ``texts``: (unit, doc_id, text); ``links``: (unit, doc_id, first, places)."""
    own = links.filter("first = doc_id").select("unit", "places")
    passages = stored(passages_of(texts.join(own, "unit"), size), "passages")
    total = passages.agg(F.sum("n")).head()[0] or 0
    shards = max(1, math.ceil(total / SHARD_WORDS))
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    routes = links.filter("first < doc_id").select("unit", F.pmod(F.xxhash64("first"), F.lit(shards)).cast("int").alias("shard")).distinct()
    routes = stored(routes.join(texts.select("unit", F.octet_length("text").alias("bytes")), "unit"), "routes")
    loads = routes.groupBy("shard").agg(F.ceil(F.sum("bytes") / (6 * TASK_WORDS)).cast("int").alias("salts"))
    salted = passages.withColumn("shard", shard).join(loads, "shard")
    salted = salted.select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), "doc_id", F.col("passage").alias("text"))
    visits = routes.join(loads, "shard").select("unit", "shard", F.pmod(F.xxhash64("unit"), F.col("salts")).cast("int").alias("salt"))
    visits = visits.join(texts, "unit").select("shard", "salt", F.lit(1).alias("kind"), F.col("unit").alias("id"), "doc_id", "text")
    tasks = int(loads.agg(F.sum("salts")).head()[0] or 1)
    return salted.unionByName(visits).repartition(max(1, math.ceil(tasks / 2)), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")


def repeated_substrings(docs: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept of every row of ``docs`` (doc_id, text).

    A word goes if a window of ``size`` consecutive words that covers it also starts in a
    document with a smaller doc_id; windows are judged on the input. ``kept`` holds the words
    that stay, space-joined, where some went, and is null where none did. Null and empty texts
    have no words. Rows that share a doc_id never remove words from each other. A null doc_id
    is the smallest. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    lowest = F.lit(-(1 << 63))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("doc_id"), "text")
    described = stored(describe(rows, size), "described")
    whole = described.filter(F.col("n_words") >= size)
    firsts = stored(whole.groupBy("sha").agg(F.min("doc_id").alias("first")), "firsts")
    units = whole.join(firsts, "sha").filter("doc_id = first").dropDuplicates(["doc_id", "sha"])
    units = stored(units.select("doc_id", "sha", "anchors").withColumn("unit", F.monotonically_increasing_id()), "units")

    anchors = units.select("unit", "doc_id", F.explode("anchors").alias("anchor"))
    recurring = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor")
    recurring = stored(recurring, "recurring")  # so that the join below stands alone and Spark can split hot anchors
    own = anchors.select("unit", "anchor").join(recurring, "anchor").groupBy("unit").agg(F.collect_list("anchor").alias("anchors"))
    own = stored(units.select("unit", "doc_id", "sha").join(own, "unit"), "anchors")
    texts = stored(candidate_windows(rows.join(own, "doc_id"), size).dropDuplicates(["unit"]), "candidates")
    discard(recurring, own)
    release_shuffles(spark)

    seen = texts.select("unit", "doc_id", F.explode(F.arrays_zip("places", "hashes")).alias("w")).select("unit", "doc_id", "w.places", "w.hashes")
    seen = seen.withColumnsRenamed({"places": "place", "hashes": "hash"})
    again = seen.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("hash", "first")
    again = stored(again, "again")
    links = seen.join(again, "hash").groupBy("unit", "doc_id", "first").agg(F.collect_list(F.when(F.col("first") == F.col("doc_id"), F.col("place"))).alias("places"))
    links = stored(links, "links")
    discard(again)
    release_shuffles(spark)

    slim = texts.select("unit", "doc_id", "text")
    found = stored(locate(_pieces_of_work(slim, links, size), size), "found")
    release_shuffles(spark)
    spans = found.groupBy("unit").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    cleaned = stored(remove(slim.join(spans, "unit")), "cleaned")
    discard(texts, links, found)

    keys = units.select("unit", F.col("doc_id").alias("unit_doc"), F.col("sha").alias("unit_sha")).join(cleaned, "unit")
    out = described.select("doc_id", "n_words", "sha").join(firsts.withColumnRenamed("sha", "first_sha"), F.col("sha") == F.col("first_sha"), "left")
    out = out.join(keys, (F.col("doc_id") == F.col("unit_doc")) & (F.col("sha") == F.col("unit_sha")), "left")
    copy = F.col("doc_id") > F.col("first")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.when(F.col("doc_id") != lowest, F.col("doc_id")).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, nothing).otherwise(F.lower(F.hex(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )

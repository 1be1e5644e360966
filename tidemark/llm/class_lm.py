"""Language-model scoring with a Brown class-based bigram model.

Exchange clustering assigns every training word to a class, and a text's probability is the
product of class-transition and word-emission probabilities:

    P(w | v) = P(class(w) | class(v)) * n(w) / n(class(w))

Exchange runs on the driver for the words that make up at least 1 / ``UNITS`` of all tokens, until
none moves. All other words then move in distributed rounds: Spark gathers how often each word
follows and precedes each class, and every word goes to the class that raises the likelihood
most while the class bigrams are held fixed (as in distributed exchange, Uszkoreit and Brants
2008). The first round knows the classes of the driver's words, later ones those of all words
with at least 1 / ``TABLE`` of the tokens. A share has a proven number of holders; the counts and
classes of all words stay distributed, and words outside the table get theirs by a join.

Transitions are interpolated with the class unigram. Unseen words are one symbol and class of
their own, with the Good-Turing share of new tokens. Every text ends in an end token, a class
of its own, which is also the state before the first word. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import discard, stored
from ._text import COUNTS, LOWERED, WORD, Piece, byte_hash, counted, pieces

#: Shares of words that the driver clusters, and of words that are sent to every executor.
UNITS, TABLE = 1 << 12, 1 << 20
CLASSES = 48
#: The class of the end token.
END = 0
#: Words that one task of a distributed round assigns, on average, and context counts that it holds at once.
SHARD_WORDS, STEP = 50_000, 1 << 14
#: Stands for a class that is not known here.
OTHER = 255
U = np.uint64


def words_of(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each word, A-Z as a-z."""
    start, end, text = piece.ranges(WORD[piece.data])
    return byte_hash(piece.data, LOWERED, start, end), text


def count_words(train: DataFrame) -> DataFrame:
    """(word long, n long): the hash of each distinct word of rows (text) and its count."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for piece in pieces(batch.column(0), 1 << 20):
                yield words_of(piece)[0].view(np.int64)

    parts = train.select("text").mapInArrow(lambda b: counted(hashes(b)), COUNTS)
    return parts.groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("n"))


@dataclass
class WordTable:
    """Some words: sorted hashes, with their classes and counts."""

    words: np.ndarray
    classes: np.ndarray
    counts: np.ndarray

    @classmethod
    def of_rows(cls, rows: pa.Table) -> WordTable:
        words = rows.column("word").to_numpy().view(U)
        order = np.argsort(words)
        return cls(words[order], rows.column("class").to_numpy()[order].astype(np.uint8), rows.column("n").to_numpy()[order])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are here, and the places of these."""
        if not len(self.words):
            return np.zeros(len(hashes), dtype=bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        here = self.words[at] == hashes
        return here, at[here]

    def classes_of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), OTHER, dtype=np.int64)
        here, at = self.find(hashes)
        out[here] = self.classes[at]
        return out


def with_ends(units: np.ndarray, text: np.ndarray, n: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's units and its end: the units before, the units themselves, and their texts."""
    place = np.arange(len(units)) + text
    sequence = np.full(len(units) + n, end, dtype=np.int64)
    sequence[place] = units
    before = np.empty_like(sequence)
    before[1:] = sequence[:-1]
    before[:1] = end
    owner = np.full(len(sequence), -1, dtype=np.int64)
    owner[place] = text
    ends = np.bincount(text, minlength=n).cumsum() + np.arange(n)
    owner[ends] = np.arange(n)
    return before, sequence, owner


def count_bigrams(train: DataFrame, units: np.ndarray) -> np.ndarray:
    """How often each unit follows each, the end as the last one; pairs with other words are left out."""
    table, n = WordTable(np.sort(units), np.zeros(len(units), np.uint8), np.zeros(len(units))), len(units)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for piece in pieces(batch.column(0), 1 << 20):
                hashes, text = words_of(piece)
                unit = np.full(len(hashes), -1)
                here, at = table.find(hashes)
                unit[here] = at
                before, after, _ = with_ends(unit, text, piece.n, n)
                both = (before >= 0) & (after >= 0)
                yield before[both] * (n + 1) + after[both]

    rows = train.select("text").mapInArrow(lambda b: counted(pairs(b)), COUNTS).groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((n + 1) ** 2)
    out[rows.column("key").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(n + 1, n + 1)


def _entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(counts: np.ndarray, classes: int = CLASSES, rounds: int = 50) -> np.ndarray:
    """Exchange clustering: the class of each unit; the last unit, the end, keeps class 0.

    Starts from units dealt out by frequency. Each unit in turn moves to the class that
    most raises the likelihood of the class bigrams, until no unit moves, ``rounds`` times at most.
    """
    n = len(counts)
    total = counts.sum(0) + counts.sum(1)
    order = np.argsort(-total[:-1], kind="stable")
    order = order[total[order] > 0]
    of = np.ones(n, dtype=np.int64)
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    of[n - 1] = 0
    counts = counts.astype(np.float64)
    one = np.zeros((n, classes))
    one[np.arange(n), of] = 1
    follow, lead = counts @ one, counts.T @ one  # unit -> class, class -> unit
    grid = one.T @ counts @ one
    for _ in range(rounds):
        moved = 0
        for u in order:
            a, own = of[u], counts[u, u]
            out, into = follow[u].copy(), lead[u].copy()
            out[a] -= own
            into[a] -= own
            # without u in any class
            grid[a] -= out
            grid[:, a] -= into
            grid[a, a] -= own
            rows, cols = grid.sum(1) + into, grid.sum(0) + out
            # the gain of putting u into class b: changed bigrams, less changed totals
            gain = (_entropy(grid + out[None, :]) - _entropy(grid)).sum(1) + (_entropy(grid.T + into[None, :]) - _entropy(grid.T)).sum(1)
            d = np.arange(classes)
            diagonal = grid[d, d]
            gain += _entropy(diagonal + out + into + own) + _entropy(diagonal) - _entropy(diagonal + out) - _entropy(diagonal + into)
            s_out, s_in = out.sum() + own, into.sum() + own
            gain -= _entropy(rows + s_out) - _entropy(rows) + _entropy(cols + s_in) - _entropy(cols)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            grid[b] += out
            grid[:, b] += into
            grid[b, b] += own
            if b != a:
                moved += 1
                of[u] = b
                follow[:, a] -= counts[:, u]
                follow[:, b] += counts[:, u]
                lead[:, a] -= counts[u]
                lead[:, b] += counts[u]
        if not moved:
            break
    return of


def _packed(word: np.ndarray, code: np.ndarray, n: np.ndarray) -> bytes:
    """Counts of (word, code), sorted by word, compressed."""
    names, first = np.unique(word, return_index=True)
    kinds = np.diff(np.append(first, len(word))).astype("<u2")
    head = np.array([len(names), len(word)], dtype="<i8")
    gaps = np.diff(names, prepend=U(0))
    return zstandard.compress(b"".join(x.tobytes() for x in (head, gaps, kinds, code.astype("u1"), n.astype("<u4"))), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.decompress(data)
    names, size = np.frombuffer(data, "<i8", 2).tolist()
    at = 16 + 8 * names
    word = np.cumsum(np.frombuffer(data, U, names, 16), dtype=U)
    kinds = np.frombuffer(data, "<u2", names, at)
    at += 2 * names
    return np.repeat(word, kinds), np.frombuffer(data, "u1", size, at), np.frombuffer(data, "<u4", size, at + size)


def contexts(train: DataFrame, table: WordTable, shards: int) -> DataFrame:
    """(shard int, part binary): packed counts of the classes before and after each word.

    A code is the class before a word, or ``CLASSES`` + 1 more than the class after it; the class ``CLASSES`` is that
    of words outside the table. Parts are merged while they fit, which bounds a task's memory.
    """
    shared = train.sparkSession.sparkContext.broadcast(table)

    def merged(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word, code, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(word, kind="stable")
        word, code, n = word[order], code[order], n[order]
        place = np.cumsum(np.append(False, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
        key, first, where = np.unique(place * 256 + code, return_index=True, return_inverse=True)
        return word[first], (key & 255).astype(np.uint8), np.bincount(where, weights=n, minlength=len(key)).astype(np.int64)

    def dealt(word: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        shard = (word % U(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        names, first = np.unique(shard[order], return_index=True)
        parts = [_packed(word[x], code[x], n[x]) for x in np.split(order, first[1:])] if len(order) else []
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(parts, pa.binary())], ["shard", "part"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece in pieces(batch.column(0), 1 << 20):
                hashes, text = words_of(piece)
                own = shared.value.classes_of(hashes)
                own[own == OTHER] = CLASSES
                before, after, owner = with_ends(own, text, piece.n, END)
                place = np.arange(len(hashes)) + text
                codes = np.concatenate([before[place], CLASSES + 1 + after[place + 1]]).astype(np.uint8)
                held.append(merged([(np.tile(hashes, 2), codes, np.ones(len(codes)))]))
                size += len(held[-1][0])
                if size > 1 << 20:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > 3 << 18:
                        yield dealt(*held[0])
                        held, size = [], 0
        if held:
            yield dealt(*merged(held))

    return train.select("text").mapInArrow(apply, "shard int, part binary")


def _logs(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(x, 1e-300))


def assign(parts: DataFrame, grid: np.ndarray, units: WordTable, shards: int) -> DataFrame:
    """(word, n, class, pair) of :func:`contexts`: each word with its class, and counts n of class pairs.

    A word goes to the class in which its contexts are most likely under the bigram counts
    ``grid``; ``units`` keep their classes. Rows with a ``pair``, class * ``CLASSES`` + class, count
    the bigrams of words after known classes, and of ends after words.
    """
    smooth = grid + 0.1
    before, after = np.zeros((CLASSES + 1, CLASSES)), np.zeros((CLASSES + 1, CLASSES))
    before[:CLASSES] = np.log(smooth)
    after[:CLASSES] = np.log(smooth).T
    gains = np.concatenate([before, after])
    sizes = np.log(smooth.sum(0)) + np.log(smooth.sum(1))
    names, kinds = ["word", "n", "class", "pair"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def rows(**columns: np.ndarray) -> pa.RecordBatch:
        size = len(columns["n"])
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in zip(names, kinds, strict=True)], names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            for shard, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blobs.setdefault(shard, []).append(part)
        pairs = np.zeros((CLASSES, CLASSES), dtype=np.int64)
        for shard in sorted(blobs):
            word, code, n = (np.concatenate(x) for x in zip(*map(_unpacked, blobs.pop(shard)), strict=True))
            every, where = np.unique(word, return_inverse=True)
            order = np.argsort(where, kind="stable")
            where, code, n = where[order], code[order], n[order]
            for low in range(0, len(every), STEP):
                a, b = np.searchsorted(where, [low, low + STEP])
                some = every[low : low + STEP]
                width = 2 * (CLASSES + 1)
                seen = np.bincount((where[a:b] - low) * width + code[a:b], weights=n[a:b], minlength=len(some) * width).reshape(len(some), width)
                count = seen[:, : CLASSES + 1].sum(1)
                gain = seen @ gains - count[:, None] * sizes
                gain[:, END] = -np.inf
                best = gain.argmax(1)
                here, at = units.find(some)
                best[here] = units.classes[at]
                one = np.zeros((len(some), CLASSES))
                one[np.arange(len(some)), best] = 1
                pairs += np.rint(seen[:, :CLASSES].T @ one).astype(np.int64)
                pairs[:, END] += np.rint(one.T @ seen[:, CLASSES + 1 + END]).astype(np.int64)
                yield rows(word=some.view(np.int64), n=np.rint(count).astype(np.int64), **{"class": best.astype(np.int32)})
        at = np.flatnonzero(pairs)
        yield rows(n=pairs.reshape(-1)[at], pair=at.astype(np.int32))

    return parts.repartition(shards, "shard").mapInArrow(apply, "word long, n long, class int, pair int")


def _grid(rows: pa.Table, key: str, size: int) -> np.ndarray:
    out = np.zeros(size * size)
    out[rows.column(key).to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(size, size)


def cluster(train: DataFrame, words: DataFrame, rounds: int = 2) -> DataFrame:
    """(word, n, class): every training word with its class. ``words``: the stored :func:`count_words` of rows (text)."""
    total, distinct = words.agg(F.sum("n"), F.count("*")).head()
    frequent = lambda df, share: df.filter(F.col("n") * share >= (total or 0))
    units = np.sort(frequent(words.select("word", "n"), UNITS).toArrow().column("word").to_numpy().view(U))
    counts = count_bigrams(train, units)
    of = exchange(counts, CLASSES)
    one = np.zeros((len(of), CLASSES))
    one[np.arange(len(of)), of] = 1
    grid = one.T @ counts @ one
    fixed = table = WordTable(units, of[:-1].astype(np.uint8), np.zeros(len(units)))
    shards = max(1, math.ceil(distinct / SHARD_WORDS))
    for i in range(rounds):
        found = stored(assign(contexts(train, table, shards), grid, fixed, shards), "classes")
        if i + 1 < rounds:
            pairs = found.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
            grid = _grid(pairs, "pair", CLASSES)
            table = WordTable.of_rows(frequent(found.filter("pair IS NULL").select("word", "n", "class"), TABLE).toArrow())
            discard(found)
    return found.filter("pair IS NULL").select("word", "n", "class")


PARTS = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, emission double, classes binary, rare array<struct<word:long,place:int>>"


def partial_scores(docs: DataFrame, table: WordTable, sizes: np.ndarray, ends: int) -> DataFrame:
    """Of each text all that needs no rare words: rows (doc_id, held_out, text) to ``PARTS``.

    ``classes`` has a byte for each word, ``OTHER`` where ``rare`` has the word's hash. ``log_counts`` sums
    log10(c + 1) over the tokens at hand, ``emission`` the logs of their shares of their classes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kind = pa.struct([("word", pa.int64()), ("place", pa.int32())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        log_n, log_share = np.log10(t.counts + 1.0), np.log10(np.maximum(t.counts, 1) / np.maximum(sizes[t.classes], 1))
        for batch in batches:
            for piece in pieces(batch.column(2)):
                n = piece.n
                hashes, text = words_of(piece)
                here, at = t.find(hashes)
                classes = np.full(len(hashes), OTHER, dtype=np.uint8)
                classes[here] = t.classes[at]
                words = np.bincount(text, minlength=n)
                offsets = np.concatenate([[0], np.cumsum(words)])
                rare = np.flatnonzero(~here)
                pairs = pa.StructArray.from_arrays([pa.array(hashes[rare].view(np.int64)), pa.array((rare - offsets[text[rare]]).astype(np.int32))], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(text[rare], minlength=n))]).astype(np.int32)), pairs)
                data = classes.tobytes()
                own = slice(piece.first, piece.first + n)
                sums = lambda values: np.bincount(text[here], weights=values[at], minlength=n)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[own], batch.column(1)[own], pa.array(words + 1), pa.array(np.bincount(text[here], minlength=n) + (ends > 0)),
                        pa.array(sums(log_n) + np.log10(ends + 1)), pa.array(sums(log_share)),
                        pa.array([data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary()), lists,
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "emission", "classes", "rare"],
                )

    return docs.select("doc_id", "held_out", "text").mapInArrow(apply, PARTS)


def _transitions(sequence: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Classes before and after each transition of a text, its end included."""
    whole = np.frombuffer(bytes([END]) + sequence + bytes([END]), dtype=np.uint8).astype(np.int64)
    return whole[:-1], whole[1:]


def complete(rows: DataFrame) -> DataFrame:
    """``rows`` with the found classes of rare words (places, kinds) filled in; words that stay unknown get the class ``CLASSES``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for classes, places, kinds in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                own = np.frombuffer(classes, dtype=np.uint8).copy()
                if places.is_valid:
                    own[places.values.to_numpy()] = kinds.values.to_numpy()
                own[own == OTHER] = CLASSES
                out.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["row", "classes"])

    return rows.mapInArrow(apply, "row long, classes binary")


def count_transitions(sequences: DataFrame) -> np.ndarray:
    """How often each class follows each in rows (classes): a table of fixed size."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((CLASSES + 1) ** 2, dtype=np.int64)
        for batch in batches:
            for sequence in batch.column(0).to_pylist():
                a, b = _transitions(sequence)
                table += np.bincount(a * (CLASSES + 1) + b, minlength=len(table))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["key", "n"])

    return _grid(sequences.select("classes").mapInArrow(apply, COUNTS).groupBy("key").agg(F.sum("n").alias("n")).toArrow(), "key", CLASSES + 1)


def transition_logs(grid: np.ndarray, new: float) -> np.ndarray:
    """log10 P(class | class) from counts; the last class is that of unseen words, with the probability ``new`` after any."""
    grid = grid[:CLASSES, :CLASSES]
    arrive, mass, kinds = grid.sum(0), grid.sum(1), (grid > 0).sum(1)
    unigram = (arrive + 0.5) / (arrive + 0.5).sum()
    weight = (mass / np.maximum(mass + kinds, 1))[:, None]  # Witten-Bell
    out = np.empty((CLASSES + 1, CLASSES + 1))
    out[:CLASSES, :CLASSES] = weight * grid / np.maximum(mass, 1)[:, None] + (1 - weight) * unigram
    out[CLASSES, :CLASSES] = unigram
    out[:, :CLASSES] *= 1 - new
    out[:, CLASSES] = new
    return np.log10(out)


def sum_transitions(sequences: DataFrame, logs: np.ndarray) -> DataFrame:
    """(row, moves): the sum of each sequence's transition logs."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(logs[_transitions(x)].sum()) for x in batch.column(1).to_pylist()], pa.float64())], ["row", "moves"])

    return sequences.select("row", "classes").mapInArrow(apply, "row long, moves double")


def held_out_rows(folds: int, fold: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold


def lm_scores(docs: DataFrame, folds: int = 7, fold: int = 2, rounds: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Trained on the rows that are not held out (crc32 of doc_id as text, modulo ``folds``, is
    not ``fold``). Null texts are empty: their only token is the end. A null doc_id counts as
    empty text for the fold. Repeated rows give repeated rows and are counted as often; an empty
    table gives an empty result. Without training rows every word is unknown. Other columns
    are ignored. doc_id is read as a long.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_rows(folds, fold).alias("held_out"), "text")
    train = docs.filter(~F.col("held_out"))
    words = stored(count_words(train), "lm-words")
    total, distinct, single = words.agg(F.sum("n"), F.count("*"), F.count(F.when(F.col("n") == 1, 1))).head()
    total, ends = total or 0, train.count()
    classes = cluster(train, words, rounds)
    sizes = np.ones(CLASSES)
    for r in classes.groupBy("class").agg(F.sum("n").alias("n")).collect():
        sizes[r["class"]] = r.n
    table = WordTable.of_rows(classes.filter(F.col("n") * TABLE >= total).toArrow())
    parts = stored(partial_scores(docs, table, sizes, ends).withColumn("row", F.monotonically_increasing_id()), "lm-parts")
    # Rare words meet their counts and classes by hash; none of them makes up more than 1 / TABLE of the tokens.
    tokens = parts.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.place").alias("place"))
    size = F.element_at(F.array(*[F.lit(float(x)) for x in sizes]), F.col("class") + 1)
    told = (
        tokens.join(classes, "word")
        .groupBy("row")
        .agg(
            F.count("*").alias("rare_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("rare_logs"), F.sum(F.log10(F.col("n") / size)).alias("rare_emission"),
            F.collect_list("place").alias("places"), F.collect_list(F.col("class").cast("byte")).alias("kinds"),
        )
    )
    told = stored(told, "lm-told")
    discard(words)
    full = parts.join(told.select("row", "places", "kinds"), "row", "left").select("row", "classes", "places", "kinds", "held_out")
    sequences = stored(complete(full.select("row", "classes", "places", "kinds")), "lm-sequences")
    trained = sequences.join(parts.filter(~F.col("held_out")).select("row"), "row")
    new = (single + 1) / (total + single + 2)
    moves = sum_transitions(sequences, transition_logs(count_transitions(trained), new))
    out = parts.drop("classes", "rare").join(told.drop("places", "kinds"), "row", "left").na.fill({"rare_known": 0, "rare_logs": 0.0, "rare_emission": 0.0}).join(moves, "row")
    tokens, kinds = total + ends, distinct + (ends > 0)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("rare_known")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") + F.col("rare_logs") - F.col("n_tokens") * F.log10(F.lit(float(tokens + kinds + 1)))).alias("base_score"),
        (F.col("emission") + F.col("rare_emission") + F.col("moves")).alias("score"),
    )

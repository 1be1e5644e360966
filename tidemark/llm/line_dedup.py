"""Line dedup: an exact set-similarity self-join of lines.

A line's tokens are its distinct words (A-Z lower-cased), ordered from the rarest to the most
frequent. Two lines with Jaccard similarity t share a token among the first
n - ceil(t * n) + 1 tokens of each (prefix filter), have sizes within a factor t (length
filter), leave enough tokens after a shared position (positional filter), and differ in so few
tokens that 128-bit parity maps of theirs differ in no more bits. Pairs that pass are
verified on the whole token sets. A line is removed if an earlier line is similar.

Rarity is a Spark-summed table of ``SKETCH`` hashed counters over all texts, sent out as their
logarithms: every total order of the tokens gives the same pairs, so collisions cost time and never
results. A token that makes up more than 1 / ``HOT`` of all would gather too many lines, so a line
meets others there only under the token and another one together: similar lines share two tokens
among the first n - ceil(t * n) + 2 of each, the first of them being the one they meet at.

One earlier similar line is enough. The earlier candidate with the nearest parity map is
verified first, then the other candidates at hand, then, for lines that are still open and
had more than were kept, all the rest. So no match is lost and no group emits all its pairs.

The texts are read three times (counters, prefix entries, token sets of candidates) and never
shuffled before the lines are removed. Token sets to fetch are known by a bit map of
``BITS`` bits; bits that are set by chance fetch a set that nothing asks for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import ROW, discard, release_shuffles, stored, with_row_key
from ._text import LOWERED, WORD, Piece, byte_hash, mix, owners, pieces, range_hash, returned, running

#: Counters of the rarity table, 2 bytes each.
SKETCH = 1 << 22
#: Share of a token from which lines meet at pairs of tokens.
HOT = 512
#: Candidates that a shared token gives a line before the last round: with one that looks similar at hand, and else.
WITNESSES, OTHERS = 16, 512
#: Candidates that a line keeps in all before the last round.
KEPT = 4096
#: Prefix entries that one task reads, on average.
TASK_ENTRIES = 500_000
#: Entries of a token from which its lines are compared in order of occurrence, until they have enough.
LARGE = 2048
#: Pairs that are compared before what passes is handed on.
STEP_PAIRS = 1 << 22
#: Size of the map of wanted token sets.
BITS = 1 << 26
#: Unresolved lines that one further round takes.
ROUND_LINES = 500_000
U = np.uint64

#: One prefix token of one line: the token, the line's token set, its first occurrence, ...
ENTRY = np.dtype([("token", "<u4"), ("size", "<u4"), ("place", "<u4"), ("parity", "<u8"), ("parity2", "<u8"), ("set", "<u8"), ("doc", "<i8"), ("line", "<i4")])


def _stable(key: np.ndarray) -> np.ndarray:
    """A stable order by small integers; numpy sorts 16-bit ones by radix."""
    return np.argsort(key.astype(np.uint16) if not len(key) or key.max() < 65536 else key, kind="stable")


class Lines:
    """The lines of a piece that have words: their token sets."""

    def __init__(self, piece: Piece):
        start, end, _ = piece.ranges(WORD[piece.data])
        line_start, _, line_text = piece.lines()
        first_line = np.searchsorted(line_text, np.arange(piece.n))
        tokens = byte_hash(piece.data, LOWERED, start, end)
        owner = owners(start, line_start)
        order = np.argsort(tokens)
        order = order[_stable(owner[order])]
        tokens, owner = tokens[order], owner[order]
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        tokens, owner = tokens[new], owner[new]
        size = np.bincount(owner, minlength=len(line_start))
        keep = size > 0
        #: tokens, sorted by line and then by hash, and the line of each
        self.tokens, self.owner = tokens[keep[owner]], (np.cumsum(keep) - 1)[owner[keep[owner]]]
        self.size = size[keep]
        self.text = line_text[keep]
        self.number = np.flatnonzero(keep) - first_line[self.text]
        self.first = np.concatenate([[0], np.cumsum(self.size)])[:-1].astype(np.int64)
        sums = running(self.tokens)
        self.set = range_hash(sums, self.first, self.first + self.size)

    def __len__(self) -> int:
        return len(self.size)

    def check(self) -> np.ndarray:
        """Other hashes of the sets; equal lines agree in both."""
        return range_hash(running(mix(self.tokens ^ U(0x5DEECE66D))), self.first, self.first + self.size)

    def parity(self) -> tuple[np.ndarray, np.ndarray]:
        """128-bit maps, as two words: bit b is the parity of the tokens that hash to b."""
        if not len(self):
            return np.zeros(0, U), np.zeros(0, U)
        spread = mix(self.tokens)
        bit, low = U(1) << (spread >> U(58)), (spread >> U(57)) & U(1) == 0
        return np.bitwise_xor.reduceat(np.where(low, bit, U(0)), self.first), np.bitwise_xor.reduceat(np.where(low, U(0), bit), self.first)


def _summed(parts: DataFrame, kind: str, merge: np.ufunc) -> np.ndarray:
    """The merge of all tables of (slice int, part binary): tasks take whole slices and hold one sum of each."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for name, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(zstandard.decompress(part.as_buffer()), dtype=kind)
                whole[name] = merge(whole[name], own) if name in whole else own.copy()
        names = sorted(whole)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([zstandard.compress(whole[n].tobytes(), 1) for n in names], pa.binary())], ["slice", "part"])

    found = parts.repartition("slice").mapInArrow(returned(apply), "slice int, part binary").toArrow().sort_by("slice")
    if not len(found):
        return np.zeros(0, dtype=kind)
    return np.concatenate([np.frombuffer(zstandard.decompress(x.as_buffer()), dtype=kind) for x in found.column("part")])


def _sliced(table: np.ndarray, slices: int) -> pa.RecordBatch:
    parts = [zstandard.compress(x.tobytes(), 1) for x in np.split(table, slices)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(slices, dtype=np.int32)), pa.array(parts, pa.binary())], ["slice", "part"])


def count_tokens(docs: DataFrame) -> tuple[np.ndarray, int]:
    """1,000 times the binary logarithms of hashed token counts of all texts, and the number of tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            for piece in pieces(batch.column(0)):
                start, end, _ = piece.ranges(WORD[piece.data])
                tokens = byte_hash(piece.data, LOWERED, start, end)
                np.add.at(table, (tokens & U(SKETCH - 1)).astype(np.int64), 1)
        yield _sliced(table, 64)

    table = _summed(docs.select("text").mapInArrow(returned(count), "slice int, part binary"), "<i8", np.add)
    return _logs(table) if len(table) else np.zeros(SKETCH, dtype=np.uint16), int(table.sum())


def _logs(counts: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log2(np.maximum(counts, 1))).astype(np.uint16)


def prefix_length(size: np.ndarray, threshold: Fraction) -> np.ndarray:
    return size - -(-size * threshold.numerator // threshold.denominator) + 1


def entries_of(lines: Lines, doc: np.ndarray, rarity: np.ndarray, hot: int, threshold: Fraction) -> np.ndarray:
    """The prefix entries of the lines, of equal ones the first; ``doc`` is each line's doc_id.

    Tokens of rank ``hot`` or more give an entry for every later token of the prefix that is longer by one.
    """
    by_set = np.lexsort((lines.number, doc, lines.set))
    repeat = np.zeros(len(lines), dtype=bool)
    repeat[by_set[1:]] = lines.set[by_set[1:]] == lines.set[by_set[:-1]]
    rank = rarity[(lines.tokens & U(SKETCH - 1)).astype(np.int64)]
    order = _stable(rank)
    order = order[_stable(lines.owner[order])]
    place = np.arange(len(order)) - lines.first[lines.owner]
    prefix = np.where(repeat, 0, prefix_length(lines.size, threshold))
    chosen = place < prefix[lines.owner]
    # sets so small that only equal ones are similar enough meet by their hash alone
    chosen &= (lines.size * threshold.denominator >= threshold.numerator * (lines.size + 1))[lines.owner]
    chosen &= rank[order] > 0  # a counter of 1 is a token that no other line has
    often = rank[order] >= hot
    alone, paired = np.flatnonzero(chosen & ~often), np.flatnonzero(chosen & often)
    of = lines.owner[paired]
    count = np.minimum(prefix[of] + 1, lines.size[of]) - place[paired] - 1
    first = np.repeat(paired, count)
    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
    tokens = lines.tokens[order]
    keys = np.concatenate([mix(tokens[alone]), mix(tokens[first] + mix(tokens[second]))])
    at = np.concatenate([alone, first])
    owner = lines.owner[at]
    out = np.empty(len(at), dtype=ENTRY)
    out["token"] = keys >> U(32)
    out["size"], out["place"] = lines.size[owner], place[at]
    first, second = lines.parity()
    out["parity"], out["parity2"], out["set"] = first[owner], second[owner], lines.set[owner]
    out["doc"], out["line"] = doc[owner], lines.number[owner]
    return out


def _first_of_each(entries: np.ndarray) -> np.ndarray:
    """One entry of each (token, set), that of the first occurrence, of tokens with two sets or more; by token, then size."""
    key = _pair(entries["token"], entries["set"] >> U(32))
    entries = entries[np.argsort(key)]
    same = np.zeros(len(entries) + 1, dtype=bool)
    same[1:-1] = (entries["token"][1:] == entries["token"][:-1]) & (entries["set"][1:] == entries["set"][:-1])
    several = same[1:] | same[:-1]
    part = entries[several]
    part = part[np.lexsort((part["line"], part["doc"], part["set"], part["token"]))]
    first = np.ones(len(part), dtype=bool)
    first[1:] = (part["token"][1:] != part["token"][:-1]) | (part["set"][1:] != part["set"][:-1])
    entries = np.concatenate([entries[~several], part[first]])
    entries = entries[np.argsort(_pair(entries["token"], entries["size"]))]
    token = entries["token"]
    apart = np.ones(len(entries) + 1, dtype=bool)
    apart[1:-1] = token[1:] != token[:-1]
    return entries[~(apart[1:] & apart[:-1])]


def _pair(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(U) << U(32)) | low.astype(U)


class Filters:
    """The filters of a pair of entries of one token.

    At the first token that two sets share, all before it in either is not shared, so its
    two places add up to no more than the sets may differ; similar sets meet there at least.
    """

    def __init__(self, entries: np.ndarray, threshold: Fraction):
        self.size, self.place = entries["size"].astype(np.int64), entries["place"].astype(np.int64)
        self.parity, self.parity2, self.name = entries["parity"].copy(), entries["parity2"].copy(), entries["set"].copy()
        self.t, self.u = threshold.numerator, threshold.denominator
        self.rank = np.empty(len(entries), dtype=np.int64)
        order = np.lexsort((entries["line"], entries["doc"]))
        at = np.ones(len(entries), dtype=np.int64)
        at[1:] = (entries["doc"][order][1:] != entries["doc"][order][:-1]) | (entries["line"][order][1:] != entries["line"][order][:-1])
        self.rank[order] = np.cumsum(at)

    def distance(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many bits the parity maps differ: no more than the sets do in tokens."""
        return (np.bitwise_count(self.parity[x] ^ self.parity[y]) + np.bitwise_count(self.parity2[x] ^ self.parity2[y])).astype(np.int64)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many tokens two similar sets of these sizes differ at most."""
        whole = self.size[x] + self.size[y]
        return whole - 2 * -(-self.t * whole // (self.t + self.u))

    def passed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = self.size[x], self.size[y]
        # overlap o has J >= t iff o * (t + u) >= t * (a + b)
        needed = -(-self.t * (a + b) // (self.t + self.u))
        apart = a + b - 2 * needed
        near = np.flatnonzero(np.bitwise_count(self.parity[x] ^ self.parity[y]) <= apart)
        near = near[self.distance(x[near], y[near]) <= apart[near]]
        x, y, a, b, needed, apart = x[near], y[near], a[near], b[near], needed[near], apart[near]
        ok = (b * self.u >= a * self.t) & (a * self.u >= b * self.t) & (self.place[x] + self.place[y] <= apart)
        ok &= (np.minimum(a - self.place[x], b - self.place[y]) >= needed) & (self.name[x] != self.name[y]) & (self.rank[x] != self.rank[y])
        return near[ok]


def candidates(entries: np.ndarray, threshold: Fraction, limit: int | None, only: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (later, earlier) of entry numbers that pass all filters, and whether the later had more than ``limit``.

    ``entries`` are those of :func:`_first_of_each`; ``only`` marks the entries to find
    candidates for. Tokens of few entries compare each entry with the smaller ones of a
    size that can be similar, and keep the nearest by their parity maps: ``limit`` of them if the
    nearest differs in half the bits it may at most, else ``OTHERS``. Tokens of many entries
    compare each with the earlier ones, in order of occurrence, until it has ``limit``. Some tokens
    are taken at once, so that no more than some ``STEP_PAIRS`` pairs are held.
    """
    f = Filters(entries, threshold)
    token = entries["token"]
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(token)))
    small = np.flatnonzero(sizes <= LARGE)
    work = np.cumsum(sizes[small] * sizes[small])
    for some in np.split(small, np.searchsorted(work, np.arange(STEP_PAIRS, work[-1] if len(work) else 0, STEP_PAIRS))):
        if len(some):
            every = np.repeat(starts[some] - np.cumsum(sizes[some]) + sizes[some], sizes[some]) + np.arange(int(sizes[some].sum()))
            yield _nearest(f, token, every, limit, only)
    for i in np.flatnonzero(sizes > LARGE):
        yield from _in_order(f, np.arange(starts[i], starts[i] + sizes[i]), limit, only)


def _nearest(f: Filters, token: np.ndarray, every: np.ndarray, limit: int | None, only: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidates of all entries ``every`` of some tokens, each compared with the smaller ones."""
    later, earlier = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    key = _pair(token[every], f.size[every])
    live = np.arange(len(every))
    other = np.searchsorted(key, _pair(token[every], -(-f.size[every] * f.t // f.u)), "left")
    while True:
        going = other < live
        live, other = live[going], other[going]
        if not len(live):
            break
        a, b = every[live], every[other]
        hit = f.passed(a, b)
        x, y = a[hit], b[hit]
        turn = f.rank[x] < f.rank[y]
        x, y = np.where(turn, y, x), np.where(turn, x, y)
        wanted = slice(None) if only is None else only[x]
        later.append(x[wanted])
        earlier.append(y[wanted])
        other = other + 1
    x, y = np.concatenate(later), np.concatenate(earlier)
    if limit is None or not len(x):
        return x, y, np.zeros(len(x), dtype=bool)
    distance = f.distance(x, y)
    order = np.lexsort((distance, x))
    x, y, distance = x[order], y[order], distance[order]
    first = np.searchsorted(x, x, "left")
    near = 2 * distance[first] <= f.apart(x[first], y[first])
    over = np.arange(len(x)) - first >= np.where(near, limit, max(limit, OTHERS))
    flagged = np.unique(x[over])
    return x[~over], y[~over], np.isin(x[~over], flagged)


def _in_order(f: Filters, every: np.ndarray, limit: int | None, only: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The candidates of all entries of one token, each compared with the earlier ones until it has ``limit``."""
    every = every[np.argsort(f.rank[every], kind="stable")]
    have = np.zeros(len(every), dtype=np.int64)
    live = np.arange(len(every)) if only is None else np.flatnonzero(only[every])
    other = np.zeros(len(live), dtype=np.int64)
    later, earlier, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while True:
        going = other < live
        if limit is not None:
            going &= have[live] <= limit
        live, other = live[going], other[going]
        if not len(live):
            break
        hit = f.passed(every[live], every[other])
        have[live[hit]] += 1
        later.append(live[hit])
        earlier.append(other[hit])
        size += len(hit)
        other = other + 1
        if size > STEP_PAIRS and limit is None:
            x, y = np.concatenate(later), np.concatenate(earlier)
            yield every[x], every[y], np.zeros(len(x), dtype=bool)
            later, earlier, size = [x[:0]], [y[:0]], 0
    x, y = np.concatenate(later), np.concatenate(earlier)
    yield every[x], every[y], np.zeros(len(x), dtype=bool) if limit is None else have[x] > limit


LINE = "shard int, entries binary, set long, check long, doc_id long, line int"


def line_rows(docs: DataFrame, rarity: np.ndarray, hot: int, threshold: Fraction, shards: int) -> DataFrame:
    """Two kinds of rows, dealt to shards: packed prefix entries (shard, entries), and lines (shard, set, check, doc_id, line)."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)
    names = ["shard", "entries", "set", "check", "doc_id", "line"]
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def rows(columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for piece in pieces(batch.column(1)):
                lines = Lines(piece)
                doc = ids[piece.first + lines.text]
                shard = (lines.set % U(shards)).astype(np.int32)
                yield rows({"shard": shard, "set": lines.set.view(np.int64), "check": lines.check().view(np.int64), "doc_id": doc, "line": lines.number.astype(np.int32)})
                held.append(entries_of(lines, doc, shared.value, hot, threshold))
                size += len(held[-1])
                if size > 500_000:
                    yield rows(_dealt(held, shards))
                    held, size = [], 0
        if size:
            yield rows(_dealt(held, shards))

    return docs.select("doc_id", "text").mapInArrow(returned(apply), LINE)


PAIR = "x long, y long, x_doc long, y_doc long, apart int, more boolean, line int, check long"


def candidate_pairs(rows: DataFrame, threshold: Fraction, tasks: int, limit: int | None = None, only: np.ndarray | None = None) -> DataFrame:
    """Candidate pairs of token sets, ``x`` the later one, with the documents of their first occurrences; and the lines.

    ``rows`` are :func:`line_rows`. ``apart`` is the distance of the parity maps, ``more`` marks
    lines with candidates beyond ``limit``. A row with ``line`` is a line: its set is ``x`` and
    ``check``, its document ``x_doc``.
    """
    shared = rows.sparkSession.sparkContext.broadcast(only)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64()]
    names = ["x", "y", "x_doc", "y_doc", "apart", "more", "line", "check"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = []
        for batch in batches:
            is_line = batch.column(5).is_valid()
            lines = batch.filter(is_line)
            if len(lines):
                columns = {"x": lines.column(2), "check": lines.column(3), "x_doc": lines.column(4), "line": lines.column(5)}
                yield pa.RecordBatch.from_arrays([columns.get(n, pa.nulls(len(lines), k)) for n, k in zip(names, kinds, strict=True)], names)
            blobs += [_unpacked(x) for x in batch.filter(batch.column(5).is_null()).column(1).to_pylist()]
        if not blobs:
            return
        entries = _first_of_each(np.concatenate(blobs))
        del blobs
        chosen = shared.value
        for x, y, more in candidates(entries, threshold, limit, None if chosen is None else np.isin(entries["set"], chosen)):
            flagged = np.unique(entries["set"][x[more]])
            later, earlier = entries[x], entries[y]
            _, one = np.unique(mix(later["set"]) ^ earlier["set"], return_index=True)
            later, earlier = later[one], earlier[one]
            apart = np.bitwise_count(later["parity"] ^ earlier["parity"]) + np.bitwise_count(later["parity2"] ^ earlier["parity2"])
            columns = {
                "x": later["set"].view(np.int64), "y": earlier["set"].view(np.int64), "x_doc": later["doc"], "y_doc": earlier["doc"],
                "apart": apart.astype(np.int32), "more": np.isin(later["set"], flagged),
            }
            yield pa.RecordBatch.from_arrays([pa.array(columns[n]) if n in columns else pa.nulls(len(later), k) for n, k in zip(names, kinds, strict=True)], names)

    return rows.repartition(tasks, "shard").mapInArrow(returned(join), PAIR)


def _packed(entries: np.ndarray) -> bytes:
    """The entries by token, field by field, compressed."""
    entries = entries[np.argsort(entries["token"])]
    fields = {name: entries[name] for name in ENTRY.names}
    fields["token"] = np.diff(fields["token"], prepend=np.uint32(0))
    return zstandard.compress(b"".join(fields[name].tobytes() for name in ENTRY.names), 1)


def _unpacked(data: bytes) -> np.ndarray:
    data = zstandard.decompress(data)
    n, at = len(data) // ENTRY.itemsize, 0
    out = np.empty(n, dtype=ENTRY)
    for name in ENTRY.names:
        kind = ENTRY[name]
        out[name] = np.frombuffer(data, dtype=kind, count=n, offset=at)
        at += n * kind.itemsize
    out["token"] = np.cumsum(out["token"], dtype=np.uint32)
    return out


def _dealt(held: list[np.ndarray], shards: int) -> dict:
    entries = np.concatenate(held)
    shard = entries["token"] % shards
    order = _stable(shard)
    entries, shard = entries[order], shard[order]
    name, first = np.unique(shard, return_index=True)
    ends = np.append(first[1:], len(entries))
    return {"shard": name.astype(np.int32), "entries": [_packed(entries[a:b]) for a, b in zip(first, ends, strict=True)]}


def _bits(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spread = mix(sets.view(U))
    return (spread & U(BITS - 1)).astype(np.int64), ((spread >> U(32)) & U(BITS - 1)).astype(np.int64)


def sets_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(set, tokens binary) of both ends of the pairs (x, y, x_doc, y_doc), each once, and of a few others.

    Only the documents where the pairs' ends first stand are read line by line.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BITS, dtype=bool)
        for batch in batches:
            for column in batch.columns:
                for bit in _bits(column.to_numpy(zero_copy_only=False).astype(np.int64)):
                    table[bit] = True
        yield _sliced(np.packbits(table), 64)

    def marked(*columns: str) -> np.ndarray:
        found = _summed(pairs.select(*columns).mapInArrow(returned(mark), "slice int, part binary"), "u1", np.bitwise_or)
        return found if len(found) else np.zeros(BITS // 8, dtype=np.uint8)

    shared = docs.sparkSession.sparkContext.broadcast((marked("x", "y"), marked("x_doc", "y_doc")))

    def asked(table: np.ndarray, values: np.ndarray) -> np.ndarray:
        a, b = _bits(values)
        return (table[a >> 3] << (a & 7) & 128 > 0) & (table[b >> 3] << (b & 7) & 128 > 0)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, documents = shared.value
        for batch in batches:
            batch = batch.filter(pa.array(asked(documents, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))))
            for piece in pieces(batch.column(1)):
                lines = Lines(piece)
                wanted = np.flatnonzero(asked(sets, lines.set.view(np.int64)))
                _, one = np.unique(lines.set[wanted], return_index=True)
                wanted = wanted[one]
                tokens = [lines.tokens[i : i + n].tobytes() for i, n in zip(lines.first[wanted].tolist(), lines.size[wanted].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(lines.set[wanted].view(np.int64)), pa.array(tokens, pa.binary())], ["set", "tokens"])

    return stored(docs.select("doc_id", "text").mapInArrow(returned(apply), "set long, tokens binary").dropDuplicates(["set"]), "sets")


def similar_pairs(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (x, y) whose whole token sets have at least the threshold's Jaccard similarity."""
    both = pairs.select("x", "y").join(sets.withColumnsRenamed({"set": "x", "tokens": "a"}), "x").join(sets.withColumnsRenamed({"set": "y", "tokens": "b"}), "y")
    t, u = threshold.numerator, threshold.denominator

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                shared = int((b[at] == a).sum())
                good.append(shared * u >= t * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(good, pa.bool_()))

    return both.select("x", "y", "a", "b").mapInArrow(returned(verify), "x long, y long")


def removed_lines(docs: DataFrame, threshold: str = "0.8") -> DataFrame:
    """(doc_id, lines array<int>): the numbers (from 0) of the lines to remove, of documents that lose any.

    A line goes if an earlier line, by doc_id and line number, has a token set of at least the
    threshold's Jaccard similarity; earlier lines count whether they stay or go. Lines with the
    same doc_id and number, which only repeated doc_ids bring about, do not remove each other.
    """
    spark = docs.sparkSession
    share = Fraction(threshold)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), "text")
    rarity, tokens = count_tokens(rows)
    tasks = max(1, math.ceil(tokens * (1.2 - float(share)) / (2 * TASK_ENTRIES)))
    hot = max(int(_logs(np.array([tokens // HOT]))[0]), 1)
    rows_of = lambda only=None: candidate_pairs(line_rows(rows, rarity, hot, share, 4 * tasks), share, tasks, WITNESSES if only is None else None, only)
    table = stored(rows_of(), "lines")
    release_shuffles(spark)
    lines, first_pairs = table.filter("line IS NOT NULL").select(F.col("x").alias("set"), "check", F.col("x_doc").alias("doc_id"), "line"), table.filter("line IS NULL")
    found = []

    def verify(pairs: DataFrame, sets: DataFrame) -> None:
        found.append(stored(similar_pairs(pairs, sets, share).select("x").distinct(), "similar"))
        release_shuffles(spark)

    others = F.collect_set(F.struct("apart", "y", "y_doc"))
    kept = first_pairs.groupBy("x").agg(F.first("x_doc").alias("x_doc"), F.sort_array(others).alias("ys"), F.max("more").alias("more"))
    kept = stored(kept.select("x", "x_doc", F.slice("ys", 1, KEPT).alias("ys"), (F.col("more") | (F.size("ys") > KEPT)).alias("more")), "pairs")
    release_shuffles(spark)
    pair = lambda df, ys: df.select("x", "x_doc", F.explode(ys).alias("p")).select("x", "x_doc", "p.y", "p.y_doc")
    sets = sets_of(rows, pair(kept, F.col("ys")))
    verify(pair(kept, F.slice("ys", 1, 1)), sets)
    left = kept.filter(F.size("ys") > 1).join(found[0], "x", "left_anti")
    verify(pair(left, F.slice("ys", 2, KEPT)), sets)
    open_sets = stored(left.filter("more").select("x").join(found[1], "x", "left_anti"), "open")
    rounds = math.ceil(open_sets.count() / ROUND_LINES)
    for i in range(rounds):
        part = open_sets.filter(F.pmod(F.xxhash64("x"), F.lit(rounds)) == i).toArrow().column("x").to_numpy().view(U)
        rest = stored(rows_of(np.sort(part)).filter("line IS NULL").dropDuplicates(["x", "y"]), "pairs")
        verify(rest, sets_of(rows, rest))
    discard(sets, kept, open_sets)
    similar = found[0]
    for more in found[1:]:
        similar = similar.union(more)
    similar = similar.distinct().select(F.col("x").alias("set"), F.lit(True).alias("similar"))
    # copies agree in both hashes of the set; a similar set was compared in full
    first = lines.groupBy("set", "check").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("times")).join(similar, "set", "left")
    first = stored(first.filter("times > 1 OR similar"), "first")
    gone = lines.join(first, ["set", "check"]).filter(F.col("similar").isNotNull() | (F.struct("doc_id", "line") > F.col("first")))
    out = stored(gone.groupBy("doc_id").agg(F.collect_set("line").alias("lines")), "removed")
    discard(table, first, *found)
    release_shuffles(spark)
    return out


def dedup_lines(docs: DataFrame, threshold: str = "0.8") -> DataFrame:
    """All rows and columns of ``docs``, the text without its removed lines, and n_lines_removed.

    Lines are what stands between line feeds. Lines without words always stay. Texts that lose nothing are unchanged, null texts too; a text may become
    empty. Null doc_ids come first in the order of lines. Rows that share a doc_id, or
    have none, are rows of their own, in a fixed order. An
    empty table gives an empty result. A column named n_lines_removed is replaced.
    """
    docs = with_row_key(docs.drop("n_lines_removed"))
    removed = removed_lines(docs.select(F.col(ROW).alias("doc_id"), "text"), threshold)
    removed = removed.withColumnsRenamed({"doc_id": "_tidemark_doc", "lines": "_tidemark_lines"})
    # always a merge join: what is removed grows with the documents, so the plan must not change with its size
    rows = docs.join(removed.hint("merge"), F.col(ROW) == F.col("_tidemark_doc"), "left")
    gone = F.col("_tidemark_lines")
    rows = rows.withColumn("_tidemark_split", F.when(gone.isNotNull(), F.split("text", "\n", -1)))
    kept = F.array_join(F.filter("_tidemark_split", lambda _, i: ~F.array_contains(gone, i)), "\n")
    count = F.when(F.col("_tidemark_split").isNull(), 0).otherwise(F.size(gone))
    text = F.when(F.col("_tidemark_split").isNull(), F.col("text")).otherwise(kept)
    return rows.withColumn("n_lines_removed", count).withColumn("text", text).drop(ROW, "_tidemark_doc", "_tidemark_lines", "_tidemark_split")

"""Documents whose sets of word shingles have at least a given Jaccard similarity.

Each distinct set gets ``BANDS`` hashes of ``DEPTH`` minima (MinHash). Sets that share a hash
are candidates of each other, and candidates that hang together form a group: two sets of
similarity 0.8 are missed with probability (1 - 0.8^5)^40 = 1.3e-7. In a group the whole
shingle sets are compared, every two of them; a large group is cut into chunks of bounded size,
and every two chunks meet once. Links leave a meeting as a spanning forest, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import release_shuffles, stored
from ._text import LOWERED, WORD, Piece, mix, pieces, range_hash, returned, running, windows

#: MinHash bands and the minima in each.
BANDS, DEPTH = 40, 5
#: Sets of one chunk of a group.
CHUNK = 256
#: Shingles that a comparison holds in one matrix.
COLUMNS = 4096
U = np.uint64
FACTOR = mix(np.arange(1, BANDS * DEPTH + 1)) | U(1)
ADDEND = mix(np.arange(1, BANDS * DEPTH + 1) + (1 << 32))


class Shingles:
    """The distinct shingles of a piece's texts; a text of fewer words is one shingle, a text without words has none."""

    def __init__(self, piece: Piece, shingle: int):
        start, end, text = piece.ranges(WORD[piece.data])
        hashes = range_hash(running(LOWERED[piece.data]), start, end)
        at, tokens = windows(hashes, text, shingle)
        owner = text[at]
        n = np.bincount(text, minlength=piece.n)
        short = np.flatnonzero((n > 0) & (n < shingle))
        first = np.searchsorted(text, short)
        tokens = np.concatenate([tokens, range_hash(running(hashes), first, first + n[short])])
        owner = np.concatenate([owner, short])
        order = np.lexsort((tokens, owner))
        tokens, owner = tokens[order], owner[order]
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        #: shingles by text and then by hash, the texts that have any, and where each begins
        self.tokens = tokens[new]
        self.text, self.first = np.unique(owner[new], return_index=True)
        self.size = np.diff(np.append(self.first, len(self.tokens)))

    def sets(self) -> np.ndarray:
        return range_hash(running(self.tokens), self.first, self.first + self.size)

    def bands(self) -> np.ndarray:
        """One row of band hashes for each text that has shingles."""
        out = np.zeros((len(self.text), BANDS), dtype=U)
        if len(self.text):
            for i in range(BANDS * DEPTH):
                low = np.minimum.reduceat(self.tokens * FACTOR[i] + ADDEND[i], self.first)
                out[:, i // DEPTH] = mix(out[:, i // DEPTH] ^ low)
        return out ^ mix(np.arange(BANDS))


def add_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, fp, set, bands) of rows (node, text): fingerprint, set hash and band hashes; without words set 0 and no bands."""
    from .simhash import fingerprints

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                found = Shingles(piece, shingle)
                sets, has = np.zeros(piece.n, dtype=U), np.zeros(piece.n, dtype=np.int32)
                sets[found.text], has[found.text] = found.sets(), BANDS
                offsets = np.concatenate([[0], np.cumsum(has)]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.bands().view(np.int64).reshape(-1)))
                node = batch.column(0).slice(piece.first, piece.n)
                yield pa.RecordBatch.from_arrays([node, pa.array(fingerprints(piece, shingle)), pa.array(sets.view(np.int64)), bands], ["node", "fp", "set", "bands"])

    return docs.mapInArrow(returned(apply), "node long, fp long, set long, bands array<long>")


def similar_within(left: list[tuple], right: list[tuple], threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (i, j) of the pairs of sets, left and then right ones, that are similar; without right ones of the left."""
    every = [x[1] for x in [*left, *right]]
    size = np.array([len(x) for x in every], dtype=np.int64)
    a = len(left)
    owner = np.repeat(np.arange(len(every)), size)
    _, token, times = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    several = times[token] > 1
    token, owner = (np.cumsum(times > 1) - 1)[token[several]], owner[several]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    shared = np.zeros((a, len(right) or a), dtype=np.int64)
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, COLUMNS):
        x, y = np.searchsorted(token, [low, low + COLUMNS])
        block = np.zeros((len(every), COLUMNS), dtype=bool)
        block[owner[x:y], token[x:y] - low] = True
        block = np.packbits(block, axis=1).view(U)
        others = block[a:] if right else block
        for i in range(a):
            shared[i] += np.bitwise_count(others & block[i]).sum(1, dtype=np.int64)
    whole = size[:a, None] + (size[a:] if right else size)[None, :] - shared
    i, j = np.nonzero(shared * threshold.denominator >= threshold.numerator * whole)
    return (i, j + a) if right else (i[i < j], j[i < j])


def similar_links(docs: DataFrame, banded: DataFrame, shingle: int, threshold: str = "0.8") -> DataFrame:
    """Links (a, b) of nodes that connect all similar sets.

    ``docs`` are rows (node, text) with distinct nodes, and ``banded`` the (node, bands) of one row of each set.
    """
    from .simhash import LINK, components, unite

    share = Fraction(threshold)
    keyed = banded.select("node", F.explode("bands").alias("key"))
    met = keyed.groupBy("key").agg(F.collect_list("node").alias("nodes")).filter(F.size("nodes") > 1)
    met = met.select(F.explode("nodes").alias("a"), F.array_min("nodes").alias("b")).filter("a <> b").distinct()
    groups = stored(components(stored(met, "met")), "groups")
    release_shuffles(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(2)):
                found = Shingles(piece, shingle)
                at = pa.array(piece.first + found.text)
                tokens = [found.tokens[i : i + n].tobytes() for i, n in zip(found.first.tolist(), found.size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(tokens, pa.binary())], ["node", "root", "tokens"])

    wanted = docs.join(groups, "node").select("node", "root", "text")
    sets = stored(wanted.mapInArrow(returned(read), "node long, root long, tokens binary"), "shingles")
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    parted = sets.join(sizes, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    chunks = parted.groupBy("root", "part", "parts").agg(F.collect_list(F.struct("node", "tokens")).alias("own"))
    meets = chunks.select("root", "part", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = meets.groupBy("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(
        F.sort_array(F.collect_list(F.struct("part", "own"))).alias("sides")
    )
    # a chunk that has no member is missing from its cells; the other one meets itself elsewhere
    cells = cells.filter((F.col("i") == F.col("j")) | (F.size("sides") == 2))
    none = F.array().cast("array<struct<node:long,tokens:binary>>")
    pairs = cells.select(F.col("sides")[0]["own"].alias("x"), F.coalesce(F.get("sides", F.lit(1))["own"], none).alias("y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sides in zip(batch.column(0), batch.column(1), strict=True):
                left, right = ([(r["node"].as_py(), np.frombuffer(r["tokens"].as_buffer(), U)) for r in side.values] for side in sides)
                node = np.array([x[0] for x in [*left, *right]], dtype=np.int64)
                label = np.arange(len(node))
                unite(label, *similar_within(left, right, share))
                member = np.flatnonzero(label != np.arange(len(label)))
                out.append(np.stack([node[member], node[label[member]]]))
            a, b = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return pairs.mapInArrow(returned(compare), LINK)

"""SimHash near-duplicates found with BK-trees.

Distinct fingerprints go to shards by their blocks: two fingerprints that differ in at
most r bits agree in at least one of r + 1 blocks, so shards by (block, value) lose no
link. A large shard is cut into chunks of bounded size, and every two chunks meet once.
In a shard a BK-tree is built, whose children are keyed by their Hamming distance to the
parent; a query follows only edges within the radius of its own distance. Links leave a
shard as a spanning forest, never as all pairs, and label propagation joins the shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingle_pairs
from ._scratch import ROW, release_shuffles, stored, with_row_key
from ._text import LOWER, WORD, Piece, pieces, returned

#: Fingerprints of one shard chunk.
CHUNK = 2048
#: Pairs (query, node) that a search holds at once.
FRONTIER = 1 << 21


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Bits set in over half of the shingles' XXH64 (seed 42); 0 without words."""
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    digest = xxhash.xxh64_intdigest
    starts = starts.tolist()
    n = len(words) - shingle + 1
    hashes = np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(starts[:n], starts[shingle:], strict=True)), np.uint64, n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(piece: Piece, shingle: int) -> np.ndarray:
    """The fingerprint of each text of a piece, as signed integers."""
    data = np.where(WORD[piece.data], LOWER[piece.data], 32).astype(np.uint8).tobytes()
    offsets = piece.offsets.tolist()
    return np.array([fingerprint(data[a:b].split(), shingle) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.uint64).view(np.int64)


def add_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id long, fp long): the fingerprint of every whole text; null texts as empty."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fingerprints(piece, shingle) for piece in pieces(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*out, np.zeros(0, np.int64)]))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(returned(apply), "doc_id long, fp long")


class BKForest:
    """BK-trees of several shards at once, built level by level.

    Node i is fingerprint i; ``roots`` has each shard's root. The edge from a parent to a
    child has the key parent * 65 + distance, and ``edges`` holds these keys sorted.
    """

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        self.fps = fps
        _, roots, owner = np.unique(shard, return_index=True, return_inverse=True)
        self.roots = roots
        parent = roots[owner]
        waiting = np.flatnonzero(parent != np.arange(len(fps)))
        edges, children = [], []
        while len(waiting):
            key = parent[waiting] * 65 + np.bitwise_count(fps[waiting] ^ fps[parent[waiting]])
            key, first, where = np.unique(key, return_index=True, return_inverse=True)
            child = waiting[first]
            edges.append(key)
            children.append(child)
            down = child[where]
            inner = down != waiting
            waiting, down = waiting[inner], down[inner]
            parent[waiting] = down
        edge = np.concatenate([*edges, np.zeros(0, np.int64)])
        order = np.argsort(edge)
        self.edges, self.children = edge[order], np.concatenate([*children, np.zeros(0, np.int64)])[order]

    def search(self, queries: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query number, node) within the radius; ``root`` is the root each query starts from."""
        step = 4096
        for at in range(0, len(queries), step):
            stack = [(np.arange(at, min(at + step, len(queries))), root[at : at + step])]
            while stack:
                query, node = stack.pop()
                if len(query) > FRONTIER:
                    half = len(query) // 2
                    stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                    continue
                distance = np.bitwise_count(queries[query] ^ self.fps[node]).astype(np.int64)
                near = distance <= radius
                if near.any():
                    yield query[near], node[near]
                low = np.searchsorted(self.edges, node * 65 + np.maximum(distance - radius, 0), "left")
                high = np.searchsorted(self.edges, node * 65 + np.minimum(distance + radius, 64), "right")
                count = high - low
                total = int(count.sum())
                if total:
                    place = np.repeat(low - np.concatenate([[0], count.cumsum()[:-1]]), count) + np.arange(total)
                    stack.append((np.repeat(query, count), self.children[place]))


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of every link (a, b) the smallest label of their components."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            to = label[label]
            if (to == label).all():
                break
            label[:] = to


def _links(left: list[np.ndarray], right: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of many shards: in each, a tree of the left set, and queries from the right set (or the left)."""
    sizes = np.array([len(x) for x in left])
    fps = np.concatenate(left).view(np.uint64)
    shard = np.repeat(np.arange(len(left)), sizes)
    forest = BKForest(fps, shard)
    same = np.array([len(x) == 0 for x in right])
    q_sizes = np.array([len(x) for x in right])
    queries = np.concatenate([fps[same[shard]], np.concatenate(right).view(np.uint64)])
    q_shard = np.concatenate([shard[same[shard]], np.repeat(np.arange(len(right)), q_sizes)])
    own = np.flatnonzero(same[shard])
    name = np.concatenate([own, len(fps) + np.arange(q_sizes.sum())])  # the label slot of each query
    every = np.concatenate([fps, queries[len(own) :]])
    label = np.arange(len(every))
    for query, node in forest.search(queries, forest.roots[q_shard], radius):
        unite(label, name[query], node)
    member = np.flatnonzero(label != np.arange(len(label)))
    return every[member], every[label[member]]


LINK = "a long, b long"


def fingerprint_links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that connect all those within the radius."""
    blocks = radius + 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    values = [
        F.shiftrightunsigned("fp", cuts[i]).bitwiseAND((1 << (cuts[i + 1] - cuts[i])) - 1).bitwiseOR(F.lit(i << 40)) for i in range(blocks)
    ]
    keyed = distinct.select("fp", F.explode(F.array(*values)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    large = sizes.select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts"))
    chunks = (
        keyed.join(large, "key")
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .groupBy("key", "part", "parts")
        .agg(F.collect_list("fp").alias("fps"))
    )
    # chunk i meets chunk j in the cell (min, max); its fingerprints are the tree or the queries there
    meets = chunks.select("key", "part", "fps", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = meets.groupBy("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(
        F.sort_array(F.collect_list(F.struct("part", "fps"))).alias("sets")
    )
    empty = F.array().cast("array<long>")
    shards = cells.select(F.col("sets")[0]["fps"].alias("tree"), F.coalesce(F.get("sets", F.lit(1))["fps"], empty).alias("queries"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0
        for batch in batches:
            for tree, queries in zip(batch.column(0), batch.column(1), strict=True):
                for x, to in ((tree, held[0]), (queries, held[1])):
                    to.append(x.values.to_numpy(zero_copy_only=False).astype(np.int64))
                    size += len(to[-1])
                if size >= 1 << 17:
                    yield _link_batch(*_links(*held, radius))
                    held, size = [[], []], 0
        if held[0]:
            yield _link_batch(*_links(*held, radius))

    return shards.mapInArrow(returned(apply), LINK)


def _link_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node (signed) of each linked node's component.

    Min-label propagation with pointer jumping; every round is written to the shared
    folder. Rounds grow with the logarithm of the longest chain, rows never.
    """
    spark = links.sparkSession
    edges = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), "links")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        lowest = (
            edges.join(labels, F.col("a") == F.col("node"))
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        hooked = labels.join(lowest, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("hook"))
        # a root that a member's neighbour beats takes that label too
        beaten = hooked.groupBy(F.col("old").alias("node")).agg(F.min("hook").alias("low"))
        hooked = hooked.join(beaten, "node", "left").select("node", "old", F.least("hook", "low").alias("hook"))
        hooked = stored(hooked, "hooks")
        jump = hooked.select(F.col("node").alias("at"), F.col("hook").alias("next"))
        labels = stored(hooked.join(jump, hooked["hook"] == jump["at"], "left").select("node", "old", F.least("hook", "next").alias("root")), "labels")
        release_shuffles(spark)
        if not labels.filter("root <> old").head(1):
            return labels.select("node", "root")
        labels = labels.select("node", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs``.

    Rows are linked if their fingerprints differ in at most ``radius`` bits; component_id is
    the smallest doc_id that links reach, the row's own included. Null and empty texts have
    fingerprint zero and are linked like others. Repeated rows give repeated rows. A null
    doc_id is a row like any other, but never the smallest unless its whole component has
    null ids. An empty table gives an empty result; other columns are ignored.
    """
    marked = stored(add_fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(fingerprint_links(classes.select("fp"), radius))
    lowest = (
        roots.join(classes, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("low").alias("component_low"))
    )
    linked = roots.join(lowest, "root").select(F.col("node").alias("fp"), "component_low")
    found = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_low", "low").alias("component_id"))
    # stored, so that this join stands alone and Spark can split a hot fingerprint's rows
    found = stored(found, "classes")
    return marked.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = 5, radius: int = 4, threshold: str = "0.8") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group one row, with the smallest doc_id, stays.

    Rows are linked if their fingerprints differ in at most ``radius`` bits or if their sets of
    shingles have at least the threshold's Jaccard similarity. All columns are as they were. Rows
    that share a doc_id, or have none, are rows of their own; null doc_ids come first.
    """
    docs = with_row_key(docs)
    rows = docs.select(F.col(ROW).alias("node"), "text")
    marked = shingle_pairs.add_sets(rows, shingle)
    classes = stored(marked.groupBy("fp", "set").agg(F.min("node").alias("node"), F.first("bands").alias("bands")), "classes")
    by_fp = stored(classes.groupBy("fp").agg(F.min("node").alias("low")), "distinct")
    worded = classes.filter(F.size("bands") > 0)
    by_set = stored(worded.groupBy("set").agg(F.min("node").alias("low"), F.first("bands").alias("bands")), "sets")
    near = fingerprint_links(by_fp.select("fp"), radius)
    for end in ("a", "b"):
        near = near.join(by_fp.select(F.col("fp").alias(end), F.col("low").alias(f"{end}_low")), end)
    parts = [
        near.select(F.col("a_low").alias("a"), F.col("b_low").alias("b")),
        classes.join(by_fp, "fp").filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")),
        worded.join(by_set.select("set", "low"), "set").filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")),
        shingle_pairs.similar_links(rows, by_set.select(F.col("low").alias("node"), "bands"), shingle, threshold),
    ]
    links = stored(parts[0].union(parts[1]).union(parts[2]).union(parts[3]), "links")
    release_shuffles(docs.sparkSession)
    stay = classes.join(components(links), "node", "left").filter("root IS NULL OR root = node")
    return docs.join(stay.select(F.col("node").alias("_tidemark_stay")), F.col(ROW) == F.col("_tidemark_stay"), "left_semi").drop(ROW)

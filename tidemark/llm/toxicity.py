"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear over the presence of hashed words and word beginnings. It is trained in numpy from
confirmed toxic examples and unlabelled texts: the risk of the negative class is the
unlabelled risk less the class prior's share of the positive one, and is kept from
falling below zero (Kiryo et al., 2017).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import LOWERED, Piece, byte_set, pieces, range_hash, running
from .rule_ensemble import labelled_sample

#: Words are hashed into so many buckets.
BUCKETS = 1 << 20
#: A bucket counts from so many confirmed texts on.
LEAST = 3
_LETTER = byte_set(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))


def token_buckets(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the texts' words and of their first four and five bytes, which inflections share.

    Words are runs of letters and digits, A-Z as a-z.
    """
    start, end, text = piece.ranges(_LETTER[piece.data])
    sums = running(LOWERED[piece.data])
    hashes, owners = [range_hash(sums, start, end)], [text]
    for size in (4, 5):
        long = end - start > size
        hashes.append(range_hash(sums, start[long], start[long] + size) + np.uint64(size))
        owners.append(text[long])
    return np.concatenate(owners), (np.concatenate(hashes) & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class WordWeights:
    """Log odds of toxicity: intercept and the weight of each present bucket."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        out = np.zeros(BUCKETS, dtype=np.float64)
        out[self.buckets] = self.weights
        return out


def choose_buckets(p: np.ndarray, n_positive: int, u: np.ndarray, n_unlabelled: int, most: int) -> np.ndarray:
    """Buckets that stand in more positive texts than their share of unlabelled ones explains.

    ``p`` and ``u`` count, for every bucket, the positive and the unlabelled texts that hold it.
    """
    rate_p, rate_u = (p + 0.5) / (n_positive + 1), (u + 0.5) / (n_unlabelled + 1)
    gain = p * np.log(rate_p / rate_u) - n_positive * (rate_p - rate_u)
    gain[(rate_p < 1.5 * rate_u) | (p < LEAST)] = 0
    chosen = np.argsort(-gain, kind="stable")[:most]
    return np.sort(chosen[gain[chosen] > 4.0])


def _rows(texts: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the chosen buckets in the texts."""
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    feature = place[np.concatenate([*texts, np.zeros(0, np.int64)])]
    return row[feature >= 0], feature[feature >= 0]


def fit_weights(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], buckets: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 2e-4
) -> WordWeights:
    """Minimise the non-negative risk by Adam over all given texts (their buckets) at once.

    ``prior`` is the share of toxic texts among the unlabelled. Without positive or
    unlabelled texts every score is the prior.
    """
    prior = min(max(prior, 1e-3), 0.5)
    if not positive or not unlabelled:
        return WordWeights(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    place = np.full(BUCKETS, -1)
    place[buckets] = np.arange(len(buckets))
    (rp, fp), (ru, fu) = _rows(positive, place), _rows(unlabelled, place)
    np_, nu, k = len(positive), len(unlabelled), len(buckets)
    w = np.zeros(k + 1)
    w[k] = np.log(prior / (1 - prior))
    m, v = np.zeros(k + 1), np.zeros(k + 1)

    def gradient(row: np.ndarray, feature: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(feature, weights=slope[row], minlength=k), slope.sum())

    for step in range(1, steps + 1):
        zp = np.bincount(rp, weights=w[fp], minlength=np_) + w[k]
        zu = np.bincount(ru, weights=w[fu], minlength=nu) + w[k]
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative_p, negative_u = np.logaddexp(0, zp), np.logaddexp(0, zu)
        of_positive = prior * gradient(rp, fp, (sp - 1) / np_)
        of_negative = gradient(ru, fu, su / nu) - prior * gradient(rp, fp, sp / np_)
        if negative_u.mean() - prior * negative_p.mean() >= 0:
            g = of_positive + of_negative
        else:  # the corrected risk is below zero: step back from overfitting
            g = -of_negative
        g[:k] += decay * w[:k]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return WordWeights(buckets, w[:k], float(w[k]))


def document_frequencies(texts: DataFrame, among: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """How many of all ``texts`` hold each bucket (only buckets ``among`` the given ones), and the number of texts.

    Each task counts its own texts, so at most a row for each task and bucket is shuffled
    and one for each bucket reaches the driver.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(BUCKETS, dtype=np.int64), 0
        wanted = np.ones(BUCKETS, dtype=bool)
        if among is not None:
            wanted[:] = False
            wanted[among] = True
        for batch in batches:
            n += batch.num_rows
            for piece in pieces(batch.column(0)):
                text, bucket = token_buckets(piece)
                told = np.flatnonzero(wanted[bucket])
                counts += np.bincount(np.unique(text[told] * BUCKETS + bucket[told]) % BUCKETS, minlength=BUCKETS)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(counts[found], n))], ["bucket", "n"])

    table = texts.select("text").mapInArrow(apply, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = table.column("bucket").to_numpy(), table.column("n").to_numpy()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[bucket[bucket >= 0]] = n[bucket >= 0]
    return out, int(n[bucket < 0].sum())


def _bucket_lists(rows: DataFrame, buckets: np.ndarray) -> DataFrame:
    """(doc_id, positive, buckets array<int>) of rows (doc_id, positive, text); only the given buckets."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(BUCKETS, dtype=bool)
        wanted[buckets] = True
        for batch in batches:
            offsets, values, n = [np.zeros(1, np.int64)], [], 0
            for piece in pieces(batch.column(2)):
                text, bucket = token_buckets(piece)
                told = np.flatnonzero(wanted[bucket])
                pairs = np.unique(text[told] * BUCKETS + bucket[told])
                offsets.append(np.bincount(pairs // BUCKETS, minlength=piece.n).cumsum() + n)
                values.append(pairs % BUCKETS)
                n += len(pairs)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(offsets).astype(np.int32)), pa.array(np.concatenate([*values, np.zeros(0, np.int64)]).astype(np.int32))
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "positive", "buckets"])

    return rows.select("doc_id", "positive", "text").mapInArrow(apply, "doc_id long, positive boolean, buckets array<int>")


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: DataFrame, label_col: str, max_positive: int, max_unlabelled: int, most: int) -> WordWeights:
    """``labels``: labelled rows to learn from; ``train``: texts that may serve as unlabelled.

    Buckets are chosen by the document frequencies of all ``train`` texts; the weights are
    fitted on the confirmed sample and on ``max_unlabelled`` rows, of which only chosen buckets reach the driver.
    """
    known = labels.filter(F.col(label_col).isNotNull())
    toxic = labelled_sample(known.filter(F.col(label_col) > 0), label_col, max_positive).select("doc_id", F.lit(True).alias("positive"))
    share = known.agg(F.avg((F.col(label_col) > 0).cast("double"))).head()[0]
    confirmed = docs.join(F.broadcast(toxic), "doc_id").select("doc_id", "positive", "text")
    p, n_positive = document_frequencies(confirmed)
    u, n_unlabelled = document_frequencies(train, np.flatnonzero(p >= LEAST))
    buckets = choose_buckets(p, n_positive, u, n_unlabelled, most)
    part = train if n_unlabelled <= max_unlabelled else train.filter(F.rand(7) < max_unlabelled / n_unlabelled)
    rows = confirmed.unionByName(part.select("doc_id", F.lit(False).alias("positive"), "text"))
    table = _bucket_lists(rows, buckets).toArrow().sort_by("doc_id").combine_chunks()
    lists: dict[bool, list[np.ndarray]] = {True: [], False: []}
    if len(table):
        listed = table.column("buckets").chunk(0)
        values, offsets = listed.values.to_numpy(), listed.offsets.to_numpy()
        for flag, start, end in zip(table.column("positive").to_pylist(), offsets[:-1], offsets[1:], strict=True):
            lists[flag].append(values[start:end])
    return fit_weights(lists[True], lists[False], buckets, share if share is not None else 0.1)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = 0.3, folds: int = 4, fold: int = 2,
    max_positive: int = 3_000, max_unlabelled: int = 30_000, max_buckets: int = 512,
) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    Words are chosen (``max_buckets`` at most) by their document frequencies in all training texts;
    their weights are fitted on about ``max_positive`` confirmed and ``max_unlabelled`` unlabelled texts
    at most; held-out rows (crc32 of doc_id as text, modulo ``folds``, equal to ``fold``) serve as
    neither. The class prior is the share of toxic rows among the labelled training rows.
    Null and empty texts have no words and get the intercept's score; a null doc_id counts as
    empty text for the fold. Repeated rows give repeated rows, an empty table an empty result,
    and labels without toxic rows the prior as every score. Other columns are ignored.
    """
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit_toxicity(docs, labels.filter(remainder != fold), docs.filter(remainder != fold), label_col, max_positive, max_unlabelled, max_buckets)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            scores = [np.zeros(0)]
            for piece in pieces(batch.column(1)):
                text, bucket = token_buckets(piece)
                told = np.flatnonzero(table[bucket])
                pairs = np.unique(text[told] * BUCKETS + bucket[told])
                odds = np.bincount(pairs // BUCKETS, weights=table[pairs % BUCKETS], minlength=piece.n) + model.intercept
                scores.append(1 / (1 + np.exp(-odds)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores))], ["doc_id", "score"])

    scored = docs.mapInArrow(apply, "doc_id long, score double")
    return scored.select("doc_id", (remainder == fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

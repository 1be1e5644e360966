"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Small boosted trees are grown on a bounded sample of labelled rows; each path from a
root is a rule, a conjunction of thresholds. Lasso logistic regression gives most rules
weight zero, and the rest become one Spark column expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import BYTE, WORD, Piece, byte_set, mix, pieces, range_hash, running, windows

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "longest_word", "upper", "digit", "symbol", "exclamation", "stop", "pipe",
    "non_ascii", "space", "symbol_words", "upper_words", "unique_words", "short_words", "log_lines", "words_a_line",
    "dup_lines", "repeat_words",
)
_UPPER = byte_set(bytes(range(65, 91)))
_LETTER = byte_set(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_DIGIT = byte_set(b"0123456789")
_SYMBOL = byte_set(b"#*$%&<>@^~_=+\\{}[]")
_STOP = byte_set(b".,;:?")


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def statistics_of(piece: Piece) -> list[np.ndarray]:
    """The ``STATISTICS`` of each text. Empty texts have zeros."""
    data, n = piece.data, piece.n
    size = np.diff(piece.offsets)
    inside = WORD[data]
    start, end, text = piece.ranges(inside)
    length = end - start
    n_words = np.bincount(text, minlength=n)

    def words_where(flags: np.ndarray) -> np.ndarray:
        return _share(np.bincount(text[flags], minlength=n), n_words)

    def bytes_where(table: np.ndarray) -> np.ndarray:
        return _share(piece.per_text(table[data]), size)

    def inside_word(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(table[data], out=sums[1:])
        return sums[end] - sums[start]

    longest = np.zeros(n)
    np.maximum.at(longest, text, length)
    sums = running(BYTE[data])
    hashes = range_hash(sums, start, end)
    _, first = np.unique(mix(hashes ^ mix(text)), return_index=True)
    unique = np.bincount(text[first], minlength=n)
    at, window = windows(hashes, text, 8)
    _, where, times = np.unique(mix(window ^ mix(text[at])), return_inverse=True, return_counts=True)
    steps = np.zeros(len(start) + 1, dtype=np.int64)
    again = at[times[where] > 1]
    np.add.at(steps, again, 1)
    np.add.at(steps, again + 8, -1)
    line_start, line_end, line_text = piece.lines()
    worded = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_text = line_text[worded]
    _, line_first = np.unique(mix(range_hash(sums, line_start[worded], line_end[worded]) ^ mix(line_text)), return_index=True)
    n_lines = np.bincount(line_text, minlength=n)
    dup = n_lines - np.bincount(line_text[line_first], minlength=n)
    return [
        np.log1p(size), np.log1p(n_words), _share(np.bincount(text, weights=length, minlength=n), n_words), np.minimum(longest, 200.0),
        _share(piece.per_text(_UPPER[data]), piece.per_text(_LETTER[data])), bytes_where(_DIGIT), bytes_where(_SYMBOL),
        bytes_where(byte_set(b"!")), bytes_where(_STOP), bytes_where(byte_set(b"|")), bytes_where(byte_set(bytes(range(128, 256)))),
        bytes_where(~WORD), words_where(inside_word(_SYMBOL) > 0), words_where(inside_word(_UPPER) > 1), _share(unique, n_words),
        words_where(length < 3), np.log1p(n_lines), _share(n_words, n_lines), _share(dup, n_lines),
        words_where(np.cumsum(steps)[:-1] > 0),
    ]


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the statistics (double) of every whole text; null texts as empty."""
    source = docs.select(*[docs[c].alias(f"_{i}") for i, c in enumerate(keep)], docs[text_col].alias("_text"))
    schema = reduce(lambda s, c: s.add(c, "double"), STATISTICS, source.drop("_text").schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            found = [statistics_of(p) for p in pieces(batch.column(last))]
            columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(last)), *(pa.array(c.astype(np.float64)) for c in columns)],
                [*(f"_{i}" for i in range(last)), *STATISTICS],
            )

    out = source.mapInArrow(apply, schema)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], *STATISTICS)


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, low, high): low < value <= high for all of them."""

    bounds: tuple[tuple[int, float, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for i, low, high in self.bounds:
            out &= (x[:, i] > low) & (x[:, i] <= high)
        return out

    def column(self, names: tuple[str, ...] = STATISTICS) -> Column:
        parts = []
        for i, low, high in self.bounds:
            if low > -np.inf:
                parts.append(F.col(names[i]) > float(low))
            if high < np.inf:
                parts.append(F.col(names[i]) <= float(high))
        return reduce(lambda a, b: a & b, parts)


def _narrowed(bounds: dict[int, tuple[float, float]], i: int, low: float, high: float) -> dict[int, tuple[float, float]]:
    a, b = bounds.get(i, (-np.inf, np.inf))
    return bounds | {i: (max(a, low), min(b, high))}


def _grow(bins: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, residual: np.ndarray, depth: int, least: int, bounds: dict, out: list) -> None:
    """Add the rules of the best binary tree on the residuals; ``out`` gets (bounds, rows, mean)."""
    if depth == 0 or len(rows) < 2 * least:
        return
    best = (1e-9, -1, -1)
    total, n = residual[rows].sum(), len(rows)
    for i, cut in enumerate(cuts):
        if not len(cut):
            continue
        count = np.bincount(bins[rows, i], minlength=len(cut) + 1).cumsum()[:-1]
        left = np.bincount(bins[rows, i], weights=residual[rows], minlength=len(cut) + 1).cumsum()[:-1]
        ok = (count >= least) & (n - count >= least)
        if ok.any():
            gain = np.where(ok, left**2 / np.maximum(count, 1) + (total - left) ** 2 / np.maximum(n - count, 1) - total**2 / n, -1)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), i, at)
    _, i, at = best
    if i < 0:
        return
    goes_left = bins[rows, i] <= at
    for side, low, high in ((goes_left, -np.inf, cuts[i][at]), (~goes_left, cuts[i][at], np.inf)):
        inner = _narrowed(bounds, i, low, high)
        out.append((inner, rows[side], residual[rows[side]].mean()))
        _grow(bins, cuts, rows[side], residual, depth - 1, least, inner, out)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, seed: int = 7) -> list[Rule]:
    """Distinct rules from all paths of boosted trees, each grown on half of the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0.02, 0.98, 49))) for i in range(x.shape[1])]
    cuts = [c[(c >= x[:, i].min()) & (c < x[:, i].max())] for i, c in enumerate(cuts)]
    bins = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], axis=1)
    logit, rules, least = np.zeros(len(y)), {}, max(5, len(y) // 500)
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-logit))
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        nodes: list = []
        _grow(bins, cuts, rows, residual, depth, least, {}, nodes)
        for bounds, _, mean in nodes:
            rule = Rule(tuple((i, float(a), float(b)) for i, (a, b) in sorted(bounds.items())))
            rules[rule] = None
            logit += 0.5 * mean * rule.holds(x)
    return list(rules)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 5e-4, steps: int = 250) -> tuple[np.ndarray, float]:
    """Weights and intercept of the mean logistic loss + penalty * |weights|, by accelerated proximal gradient."""
    x = x.astype(np.float32)
    n, k = x.shape
    w, b = np.zeros(k, dtype=np.float32), np.float32(0)
    v, vb, t = w.copy(), b, 1.0
    ones = np.ones(k, dtype=np.float32) / max(np.sqrt(k), 1)
    for _ in range(10):  # the largest eigenvalue of the Gram matrix bounds the step
        ones = x.T @ (x @ ones)
        norm = float(np.linalg.norm(ones)) or 1.0
        ones /= norm
    step = 1 / (0.25 * (norm / n + 1) + 1e-6)
    for _ in range(steps):
        gradient = (1 / (1 + np.exp(-np.clip(x @ v + vb, -30, 30))) - y).astype(np.float32) / n
        to = v - step * (x.T @ gradient)
        to = np.sign(to) * np.maximum(np.abs(to) - step * penalty, 0)
        to_b = vb - step * gradient.sum()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = to + (t - 1) / t_next * (to - w), to_b + (t - 1) / t_next * (to_b - b)
        w, b, t = to, to_b, t_next
    return w, float(b)


@dataclass
class RuleEnsemble:
    """Rules, weights and intercept of the log odds of label 1."""

    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
        """Without rows the log odds are 0; with one label only they are those of (n + 1) / (n + 2)."""
        ones = int(y.sum())
        if ones in (0, len(y)):
            return cls(intercept=float(np.log((ones + 1) / (len(y) - ones + 1))))
        rules = tree_rules(x, y)
        held = np.stack([r.holds(x) for r in rules], axis=1) if rules else np.zeros((len(x), 0), dtype=bool)
        w, b = lasso_logistic(held, y)
        chosen = np.flatnonzero(np.abs(w) > 1e-4)
        return cls([rules[i] for i in chosen], [float(w[i]) for i in chosen], b)

    def column(self) -> Column:
        """The probability of label 1 as a Spark expression over the ``STATISTICS``."""
        odds = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            odds = odds + F.when(rule.column(), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def labelled_sample(labels: DataFrame, label_col: str, most: int) -> DataFrame:
    """(doc_id, label) of about ``most`` labelled rows at most, chosen by a hash of doc_id.

    Repeated doc_ids count once, with their smallest label; null ids and labels are left out.
    """
    one = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).alias("label"))
    n = one.count()
    return one if n <= most else one.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))


def fit_ensemble(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 12_000) -> RuleEnsemble:
    """Fitted on at most about ``max_rows`` of the labelled rows; only their statistics reach the driver."""
    sample = labelled_sample(labels, label_col, max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    table = with_statistics(rows.select("doc_id", "label", "text"), ["doc_id", "label"]).toPandas()
    table = table.drop_duplicates().sort_values(["doc_id", *STATISTICS], kind="stable")
    return RuleEnsemble.fit(table[list(STATISTICS)].to_numpy(float), (table["label"] > 0).to_numpy(float))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, fold: int = 0, max_rows: int = 12_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    Labels of held-out rows (crc32 of doc_id as text, modulo ``folds``, equal to ``fold``)
    are never read. Null and empty texts have all statistics zero and a score like any other;
    a null doc_id counts as empty text for the fold. Repeated rows give repeated rows, tables
    without rows an empty result, and labels without rows the score 0.5. Other columns are ignored.
    """
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds
    docs = docs.select("doc_id", "text")
    model = fit_ensemble(docs, labels.filter(remainder != fold), max_rows=max_rows)
    scored = with_statistics(docs, ["doc_id"]).withColumn("score", model.column())
    return scored.select("doc_id", (remainder == fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

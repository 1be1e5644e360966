"""Mixing sources to target weights by Poisson replication.

Each document is repeated k times, where k inverts a Poisson distribution at a number
hashed from its doc_id. The mean is its source's target repetition rate, so the sources
get their target shares in expectation and every run gives the same rows. The copies are
then shuffled globally by a hash of doc_id and copy.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Larger means are sums of equal parts of at most this mean, each with a hash of its own.
PART = 32.0
#: Steps of the distribution function; beyond them lies less than 1e-30 at mean ``PART``.
STEPS = 128
#: Up to so many sources their table is broadcast; beyond, Spark joins it by a shuffle.
BROADCAST_SOURCES = 50_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the parts, joined by colons."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def target_rates(docs: DataFrame, weights: Mapping[str, float], total: int | None = None, source_col: str = "source") -> DataFrame:
    """(_tidemark_source, rate): the mean number of copies of each source's documents.

    ``weights`` are target shares of named sources; the others split the rest by their
    sizes. Named sources that the documents lack leave their share to all others. ``total``
    is the expected number of rows, by default as many as there are.
    """
    if min(weights.values(), default=0) < 0 or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights must not be negative and must add up to 1 at most")
    sizes = docs.groupBy(F.col(source_col).alias("_tidemark_source")).agg(F.count("*").alias("n"))
    named = F.lit(None).cast("double")
    if weights:
        pairs = [F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]
        named = F.try_element_at(F.create_map(*pairs), F.coalesce(F.col("_tidemark_source"), F.lit("")))
        named = F.when(F.col("_tidemark_source").isNotNull(), named)
    sizes = sizes.withColumn("weight", named)
    rows, present, rest = sizes.agg(F.sum("n"), F.sum("weight"), F.sum(F.when(F.col("weight").isNull(), F.col("n")))).head()
    rows, present, rest = rows or 0, present or 0.0, rest or 0
    remainder = max(1.0 - sum(weights.values()), 0.0) if rest else 0.0
    whole = (present + remainder) or 1.0
    share = F.coalesce(F.col("weight"), F.col("n") * F.lit(remainder / rest if rest else 0.0)) / F.lit(whole)
    return sizes.select("_tidemark_source", (share * F.lit(float(rows if total is None else total)) / F.col("n")).alias("rate"))


def poisson_steps(mean: Column) -> Column:
    """P(X <= k) for k = 0 ... STEPS - 1 as an array."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        return F.struct(p.alias("p"), F.array_append(a["c"], F.element_at(a["c"], -1) + p).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS - 1)), start, step, lambda a: a["c"])


def mix_sources(
    docs: DataFrame, weights: Mapping[str, float], total: int | None = None, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", partitions: int | None = None
) -> DataFrame:
    """The rows of ``docs``, each as often as its Poisson number says, with ``copy`` (from 1) and ``shuffle_key``.

    The result is range-partitioned and sorted by ``shuffle_key``, a hash of doc_id and copy.
    Rows that share a doc_id share their number and keys. Null sources are one source, which
    ``weights`` cannot name; null doc_ids hash as empty text. Texts play no part. An empty
    table gives an empty result. Columns named copy or shuffle_key are replaced.
    """
    docs = docs.drop("copy", "shuffle_key")
    rates = target_rates(docs, weights, total, source_col).withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    rates = rates.select("_tidemark_source", F.col("parts").alias("_tidemark_parts"), poisson_steps(F.col("rate") / F.col("parts")).alias("_tidemark_steps"))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    names = docs.columns
    rows = docs.join(rates, docs[source_col].eqNullSafe(F.col("_tidemark_source")))
    numbers = F.transform(F.sequence(F.lit(1), F.col("_tidemark_parts")), lambda part: uniform(seed, F.col(id_col), part))
    count = F.aggregate(numbers, F.lit(0), lambda n, u: n + F.size(F.filter("_tidemark_steps", lambda c: c <= u)))
    rows = rows.withColumn("_tidemark_count", count).filter("_tidemark_count > 0")
    rows = rows.select(*[F.col(f"`{c}`") for c in names], F.explode(F.sequence(F.lit(1), F.col("_tidemark_count"))).alias("copy"))
    rows = rows.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("order"), F.col("copy").cast("string"))))
    dealt = rows.repartitionByRange(partitions, "shuffle_key") if partitions else rows.repartitionByRange("shuffle_key")
    return dealt.sortWithinPartitions("shuffle_key")

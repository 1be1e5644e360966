"""Benchmark decontamination with a distributed positional inverted index.

DataFrame functions only. Texts are split once and their words stored. The index holds token
postings (term, doc_id, position) of them. A test window is looked up by its rarest terms: their
postings, moved back by each term's offset in the window, are intersected to starts where all of
them agree, and at these starts the whole phrase is compared. Where the postings of the rarest
terms stand close together, in any order, all other words of the window are looked for in the
same run of words: a proximity match. Terms that the training texts lack rule a window out at
once, and postings are built only for the terms that lookups read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import discard, stored

#: Java pattern of what stands between words: ASCII but 0-9, A-Z and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; of a null text none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), BETWEEN)
    return F.array_remove(parts, "")


def test_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words) of the items that have words, each once."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("words"))
    return items.filter(F.size("words") > 0).distinct()


def test_windows(items: DataFrame, size: int = 10) -> DataFrame:
    """(item, at, window): each run of ``size`` words of an item, or all words of a shorter one, by where it begins."""
    last = F.greatest(F.size("words") - size, F.lit(0))
    starts = items.select("item", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return starts.select("item", "at", F.slice("words", F.col("at") + 1, size).alias("window"))


def tokens_of(docs: DataFrame) -> DataFrame:
    """(doc_id, position, term) of rows (doc_id, words)."""
    return docs.select("doc_id", F.posexplode("words").alias("position", "term"))


def term_counts(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n) of those ``terms`` (term) that stand in the tokens."""
    return tokens.select("term").join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def rarest_terms(windows: DataFrame, counts: DataFrame, lookups: int) -> DataFrame:
    """(item, at, offset, term, needed): up to ``lookups`` rarest distinct terms of each window.

    Windows with a term that no training text has are left out.
    """
    terms = windows.select("item", "at", F.size("window").alias("size"), F.posexplode("window").alias("offset", "term"))
    window = Window.partitionBy("item", "at")
    known = terms.join(counts, "term").withColumn("found", F.count("*").over(window)).filter("found = size")
    first = known.groupBy("item", "at", "term", "n").agg(F.min("offset").alias("offset"))
    ranked = first.withColumn("rank", F.row_number().over(window.orderBy("n", "offset"))).filter(F.col("rank") <= lookups)
    return ranked.withColumn("needed", F.count("*").over(window)).select("item", "at", "offset", "term", "needed")


def postings(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: (term, doc_id, position) of the tokens that are among ``terms`` (term)."""
    return tokens.join(terms.distinct(), "term", "left_semi").select("term", "doc_id", "position")


def looked_up(index: DataFrame, lookups: DataFrame) -> DataFrame:
    """(item, at, doc_id, term, offset, position, needed): the postings of each window's looked-up terms."""
    return index.join(lookups, "term").select("item", "at", "doc_id", "term", "offset", "position", "needed")


def phrase_starts(found: DataFrame) -> DataFrame:
    """(item, at, doc_id, place): where the postings of all looked-up terms agree after moving back."""
    moved = found.select("item", "at", "doc_id", (F.col("position") - F.col("offset")).alias("place"), "needed").filter("place >= 0")
    agree = moved.groupBy("item", "at", "doc_id", "place").agg(F.count("*").alias("n"), F.first("needed").alias("needed"))
    # repeated rows may add postings to a start but never take one away
    return agree.filter("n >= needed").select("item", "at", "doc_id", "place")


def close_places(found: DataFrame, span: int) -> DataFrame:
    """(item, at, doc_id, place): postings that follow one of another looked-up term by less than ``span`` words.

    Two terms of a window are looked up, or the only one it has. Any run of ``span`` words that
    holds both holds such a place, as between the two somewhere one term's postings give way to the other's.
    """
    order = Window.partitionBy("item", "at", "doc_id").orderBy("position", "term")
    last = found.withColumn("last_term", F.lag("term").over(order)).withColumn("last_position", F.lag("position").over(order))
    near = (F.col("last_term") != F.col("term")) & (F.col("position") - F.col("last_position") < span)
    return last.filter((F.col("needed") == 1) | near).select("item", "at", "doc_id", F.col("position").alias("place")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, span: int = 15) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items and hits of every row of ``docs`` (doc_id, text).

    ``hits`` are the places (start, length) of exact window matches, by start. A word inside
    any of them is hit. n_near_items counts the items that have a proximity match: a window whose
    words all stand in a run of ``span`` words, in any order; exact matches are such too. Null and
    empty texts have no words, and such items no windows. Rows that share a doc_id, or have none,
    each get their own matches. Repeated items count once per item_id, and a null item_id is left
    out of the item list. Empty tables give no matches. Other columns are ignored.
    """
    # rows that clash in this hash share their candidates, which are compared in each row's own words
    tokens = stored(docs.select(F.xxhash64("doc_id", "text").alias("_tidemark_key"), "doc_id", words(F.col("text")).alias("words")), "tokens")
    found = candidates(tokens.select("_tidemark_key", "words"), benchmark, size, span)
    # a text is shuffled as one string, which takes a fraction of an array's bytes: no word has a space
    lines = tokens.select("_tidemark_key", "doc_id", F.size("words").alias("n_words"), F.array_join("words", " ").alias("line"))
    # always a merge join: the candidates grow with the documents, so the plan must not change with their size
    rows = lines.join(found.hint("merge"), "_tidemark_key", "left")
    again = F.when(F.col("_tidemark_at").isNotNull(), F.split("line", " "))
    return matched(rows.select("doc_id", "n_words", again.alias("words"), F.col("_tidemark_at").alias("at")), size, span)


def candidates(docs: DataFrame, benchmark: DataFrame, size: int, span: int | None) -> DataFrame:
    """(_tidemark_key, _tidemark_at) of rows (_tidemark_key, words): by benchmark item, where its windows may match.

    ``span``: look for proximity matches too; their candidates are marked ``near``.
    """
    items = stored(test_items(benchmark).withColumn("item", F.monotonically_increasing_id()), "items")
    windows = test_windows(items, size)
    tokens = tokens_of(docs.withColumnRenamed("_tidemark_key", "doc_id"))
    counts = stored(term_counts(tokens, items.select(F.explode("words").alias("term")).distinct()), "terms")
    lookup = stored(rarest_terms(windows, counts, 2), "lookups")
    index = stored(postings(tokens, lookup.select("term")), "postings")
    found = looked_up(index, lookup)
    places = phrase_starts(found).withColumn("near", F.lit(False))
    if span:
        places = places.unionByName(close_places(found, span).withColumn("near", F.lit(True)))
    # an item's words are there once for a text, whatever number of its windows may match
    by_item = places.groupBy(F.col("doc_id").alias("_tidemark_key"), "item").agg(F.collect_list(F.struct("at", "place", "near")).alias("places")).join(items, "item")
    by_text = by_item.groupBy("_tidemark_key").agg(F.collect_list(F.struct("item_id", "places", F.col("words").alias("item_words"))).alias("_tidemark_at"))
    out = stored(by_text, "passages")
    discard(items, counts, lookup, index)
    return out


def _stands(words: str, size: int, item: Column, place: Column) -> Column:
    """Whether the window of the item at ``place`` stands there in the words."""
    return F.slice(words, place["place"] + 1, F.least(F.lit(size), F.size(item["item_words"]))) == F.slice(item["item_words"], place["at"] + 1, size)


def _near(words: str, size: int, span: int, item: Column, place: Column) -> Column:
    """Whether a run of ``span`` words that holds the place has all words of the window."""
    window = F.slice(item["item_words"], place["at"] + 1, size)
    first = F.greatest(place["place"] - span + 1, F.lit(0))
    around = F.size(F.array_except(window, F.slice(words, first + 1, place["place"] - first + span))) == 0
    return around & F.exists(F.sequence(first, place["place"]), lambda s: F.size(F.array_except(window, F.slice(words, s + 1, span))) == 0)


def matched(rows: DataFrame, size: int, span: int) -> DataFrame:
    """The result columns of rows (doc_id, n_words, words, at): candidates compared in the words themselves; ``words`` may be null without them."""

    def spans(a: Column) -> Column:
        there = F.filter(a["places"], lambda p: ~p["near"] & _stands("words", size, a, p))
        return F.transform(there, lambda p: F.struct(p["place"].alias("start"), F.least(F.lit(size), F.size(a["item_words"])).alias("length")))

    per_item = F.transform(
        "at",
        lambda a: F.struct(
            a["item_id"].cast("string").alias("item_id"), spans(a).alias("spans"), F.exists(a["places"], lambda p: p["near"] & _near("words", size, span, a, p)).alias("near")
        ),
    )
    none = F.array().cast("array<struct<item_id:string,spans:array<struct<start:int,length:int>>,near:boolean>>")
    rows = rows.withColumn("per_item", F.coalesce(per_item, none))
    names = lambda chosen: F.array_sort(F.array_compact(F.array_distinct(F.transform(F.filter("per_item", chosen), lambda x: x["item_id"]))))
    rows = rows.select(
        "doc_id", "n_words",
        F.array_sort(F.array_distinct(F.flatten(F.col("per_item.spans")))).alias("hits"),
        names(lambda x: F.size(x["spans"]) > 0).alias("items"), F.size(names(lambda x: x["near"])).cast("long").alias("n_near_items"),
    )
    hit = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))
    rows = rows.withColumn("n_hit", F.size(hit))
    return rows.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "n_near_items", "hits",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark stands, all columns as they were.

    Rows are judged each by its own text, null and repeated doc_ids included; null and empty texts stay.
    """
    keyed = docs.withColumn("_tidemark_key", F.xxhash64("doc_id", "text"))
    tokens = stored(keyed.select("_tidemark_key", words(F.col("text")).alias("words")), "tokens")
    found = candidates(tokens, benchmark, size, None)
    discard(tokens)
    rows = keyed.join(found.hint("merge"), "_tidemark_key", "left")
    # only texts with candidates are split again
    rows = rows.withColumn("_tidemark_words", F.when(F.col("_tidemark_at").isNotNull(), words(F.col("text"))))
    hit = F.exists("_tidemark_at", lambda a: F.exists(a["places"], lambda p: _stands("_tidemark_words", size, a, p)))
    return rows.filter(~F.coalesce(hit, F.lit(False))).select(*docs.columns)

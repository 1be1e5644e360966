"""Column functions on text: normal forms, keys, tokens, similarity, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grammatical words of market questions.
STOPWORDS = (
    "a", "an", "the", "be", "is", "are", "was", "were", "been", "will", "would", "shall", "should", "can", "could", "may", "might", "must",
    "do", "does", "did", "have", "has", "had", "of", "in", "on", "at", "to", "for", "from", "by", "with", "and", "or", "but", "if", "then",
    "than", "as", "that", "this", "these", "those", "it", "its", "there", "any", "all", "no", "not", "more", "most", "least", "less", "who",
    "what", "which", "when", "where", "how", "before", "after", "during", "between", "up", "down", "out", "over", "under", "vs", "v",
)

#: Latin letters with marks, and the letters they become.
MARKED = "áàâãäåéèêëíìîïóòôõöúùûüçñý"
PLAIN = "aaaaaaeeeeiiiiooooouuuucny"


def normal_form(text: Column) -> Column:
    """Trimmed, runs of white space as one space, lower case."""
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


#: Typographic quotes and dashes, and the plain characters that a search takes them for.
TYPOGRAPHIC = "‘’‛′“”″‐‑‒–—―−"
TYPED = "\'\'\'\'\"\"\"-------"


def search_form(text: Column) -> Column:
    """The normal form with plain quotes and dashes. Letters with combining marks are not composed: Spark has no function for that."""
    return normal_form(F.translate(text, TYPOGRAPHIC, TYPED))


def pair_key(a: Column, b: Column) -> Column:
    """A key of two texts that does not depend on their order."""
    return F.md5(F.concat(F.least(a, b), F.lit("|"), F.greatest(a, b)))


def fingerprint(ids: Column) -> Column:
    """First 16 hex digits of the SHA-256 of sorted ids."""
    return F.substring(F.sha2(F.array_join(F.sort_array(ids), ","), 256), 1, 16)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words of ASCII letters and digits, each padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all elements; 0 for two empty arrays."""
    whole = F.size(F.array_union(a, b))
    return F.when(whole == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / whole)


def similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Distinct lower-case tokens in order: split at what is neither letter, digit nor one of $ % . ' -, trimmed of . ' -, without stopwords."""
    parts = F.transform(F.split(F.lower(text), r"[^a-z0-9$%.'-]+"), lambda t: F.btrim(t, F.lit(".'-")))
    return F.array_distinct(F.filter(parts, lambda t: (t != "") & ~t.isin(list(stopwords))))


def entities(text: Column) -> Column:
    """Tickers, acronyms and numbers with their unit, as an array in the order of kinds."""
    begin, end = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"  # borders of ASCII words, whatever the engine's word border is
    kinds = (r"(\$[A-Z]{1,6})" + end, begin + "([A-Z]{2,6})" + end, begin + r"([0-9]+(?:\.[0-9]+)?(?:%|k|m|bn)?)(?![0-9A-Za-z])")
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(k), 1) for k in kinds]))


def capitalized_runs(text: Column) -> Column:
    """Runs of two or more capitalized words."""
    return F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)+)"), 1)


def plain_name(text: Column) -> Column:
    """Lower case, marks taken off, only letters and digits of any script."""
    return F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), r"[^\p{L}\p{N}]", "")


def acronym(text: Column) -> Column:
    """First letters of the words."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether the letters of ``short`` stand in ``long`` in this order: one fold over its letters."""
    letters = F.filter(F.split(long, ""), lambda c: c != "")
    matched = F.aggregate(letters, F.lit(0), lambda n, c: F.when((n < F.length(short)) & (F.substring(short, n + 1, F.lit(1)) == c), n + 1).otherwise(n))
    return (F.length(short) > 0) & (matched == F.length(short))


def near_miss(a: Column, b: Column, most: int) -> Column:
    """Edit distance up to ``most``; beyond, ``most`` + 1."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def parse_slug(slug: Column, prefixes: list[str]) -> Column:
    """struct(prefix, a, b, date, suffix, reason) of ``prefix-a-b-yyyy-mm-dd[-suffix]``; the longest prefix wins."""
    prefix = F.lit(None).cast("string")
    for p in sorted(prefixes, key=len):
        prefix = F.when(F.startswith(slug, F.lit(p + "-")), p).otherwise(prefix)
    rest = F.substring(slug, F.length(prefix) + 2, F.length(slug))
    group = lambda i: F.regexp_extract(rest, r"^([a-z0-9]+)-([a-z0-9]+)-(\d{4}-\d{2}-\d{2})(?:-(.+))?$", i)
    day = F.try_to_date(group(3), "yyyy-MM-dd")
    reason = F.when(prefix.isNull(), "other").when(day.isNull(), "malformed")
    keep = lambda c: F.when(reason.isNull() & (c != ""), c)
    return F.struct(prefix.alias("prefix"), keep(group(1)).alias("a"), keep(group(2)).alias("b"), F.when(reason.isNull(), day).alias("date"), keep(group(4)).alias("suffix"), reason.alias("reason"))


def first_rule(text: Column, rules: list[tuple[str, str]], rest: str) -> Column:
    """The label of the first pattern that the text matches."""
    out = F.lit(rest)
    for pattern, label in reversed(rules):
        out = F.when(F.rlike(text, F.lit(pattern)), label).otherwise(out)
    return out


def whole_word(words: list[str]) -> str:
    """A Java pattern of any of the words between characters that are no letters."""
    return "(?i)(?<![a-z])(?:" + "|".join(words) + ")(?![a-z])"


def excerpt(text: Column, pattern: str, before: int, after: int) -> Column:
    """``before`` characters before the first match of the pattern to ``after`` from its beginning; null without one."""
    at = F.length(F.regexp_extract(text, f"(?s)^(.*?)(?:{pattern})", 1))
    start = F.greatest(at - before, F.lit(0))
    return F.when(F.rlike(text, F.lit(pattern)), F.substring(text, start + 1, at + after - start))


def first_hit(fields: list[tuple[str, Column]], patterns: list[tuple[str, str]], before: int = 40, after: int = 60) -> Column:
    """struct(field, term, excerpt) of the first match, fields before patterns; null without one."""
    hits = [
        F.when(F.rlike(value, F.lit(pattern)), F.struct(F.lit(name).alias("field"), F.lit(term).alias("term"), excerpt(value, pattern, before, after).alias("excerpt")))
        for name, value in fields for pattern, term in patterns
    ]
    return F.coalesce(*hits)


def best_of(text: Column) -> Column:
    return F.regexp_extract(text, r"(?i)\bbo(\d+)\b", 1).try_cast("int")


def bin_of(text: Column) -> Column:
    """struct(low, high) of ``a-b``, ``<b`` or ``a+``; an open end is null."""
    both, top, bottom = r"^(\d+)-(\d+)$", r"^(\d+)\+$", r"^<(\d+)$"
    low = F.when(F.rlike(text, F.lit(both)), F.regexp_extract(text, both, 1)).when(F.rlike(text, F.lit(top)), F.regexp_extract(text, top, 1)).when(F.rlike(text, F.lit(bottom)), F.lit("0"))
    high = F.when(F.rlike(text, F.lit(both)), F.regexp_extract(text, both, 2)).when(F.rlike(text, F.lit(bottom)), (F.regexp_extract(text, bottom, 1).try_cast("int") - 1).cast("string"))
    return F.struct(low.try_cast("int").alias("low"), high.try_cast("int").alias("high"))


def age_label(seconds: Column) -> Column:
    return F.when(seconds < 60, F.concat(F.floor(seconds).cast("string"), F.lit("s"))).when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("min"))).when(
        seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h"))
    ).otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d")))


def quarter_label(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))


def first_sentences(text: Column, most: int) -> Column:
    """The beginning in ``most`` characters, white space as one space: whole sentences if they fill over half of it, else whole words and an ellipsis."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(clean, 1, most)
    whole, words = F.regexp_extract(head, "^(.*[.!?]) ", 1), F.regexp_extract(head, "^(.+) ", 1)
    cut = F.concat(F.rtrim(F.when(words != "", words).otherwise(head)), F.lit("…"))
    return F.when(F.length(clean) <= most, clean).when(F.length(whole) - 1 > most / 2, whole).otherwise(cut)


def context_instant(updated: Column, unreadable: Column, as_of: Column, now: Column, tolerance: int) -> Column:
    """struct(kind, at): source with its own instant, observation at ``as_of`` where that is now, else refuse. Instants are microseconds."""
    kind = F.when(unreadable, "refuse").when(updated.isNotNull(), F.when(updated > as_of + tolerance, "refuse").otherwise("source")).when(F.abs(as_of - now) > tolerance, "refuse").otherwise("observation")
    return F.struct(kind.alias("kind"), F.when(kind == "source", updated).when(kind == "observation", as_of).alias("at"))


def skip_rewrite(last: Column, candidate: Column, kind: Column, ttl: int) -> Column:
    """Whether a context says nothing new: the same instant of its source, or an observation younger than ``ttl`` microseconds."""
    return F.when(last.isNull(), False).when(kind == "source", last == candidate).otherwise(candidate - last < ttl)

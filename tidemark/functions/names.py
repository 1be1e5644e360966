"""Team names: canonical forms, words that tell teams of one organisation apart, and how well two names agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MARKED, PLAIN, is_subsequence, plain_name

#: Words that decorate names.
DECORATIVE = ("esports", "esport", "gaming", "team", "club", "org", "cs", "cs2", "csgo", "gg", "the")

#: Words that tell teams of one organisation apart; they are neither removed nor abbreviated.
DISTINGUISHING = ("academy", "prospect", "prospects", "junior", "juniors", "jr", "youth", "young", "female", "women", "fe", "b", "ii")

#: How a name agrees, strongest first; a tier is a place in this list.
TIERS = ("exact", "canonical", "code", "abbrev")


def name_words(text: Column) -> Column:
    """Lower-case words of letters and digits, marks taken off. Null has none."""
    return F.filter(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _undecorated(text: Column) -> Column:
    return F.filter(name_words(text), lambda w: ~w.isin(*DECORATIVE))


def canonical_name(text: Column) -> Column:
    """The words without decoration, joined; a name of nothing else keeps them."""
    kept = _undecorated(text)
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(name_words(text)), "")


def distinguishing_words(text: Column) -> Column:
    """The distinguishing words of a name, sorted, as one text."""
    return F.array_join(F.sort_array(F.filter(name_words(text), lambda w: w.isin(*DISTINGUISHING))), ",")


def initials(text: Column) -> Column:
    return F.array_join(F.transform(_undecorated(text), lambda w: F.substring(w, 1, 1)), "")


def name_forms(text: Column) -> Column:
    """struct(plain, canonical, distinct, initials): what names are compared by."""
    plain = plain_name(F.coalesce(text, F.lit("")))
    return F.struct(plain.alias("plain"), canonical_name(text).alias("canonical"), distinguishing_words(text).alias("distinct"), initials(text).alias("initials"))


def _shortens(short: Column, long: Column) -> Column:
    return (F.length(short) >= 3) & (F.length(short) < F.length(long)) & is_subsequence(short, long)


def side_tier(ours: Column, code: Column, variants: Column) -> Column:
    """The best tier of our name (its forms) and ``code`` among the forms of their ``variants``; null where none agrees.

    Distinguishing words must be the same on both sides, and a name that has any agrees by
    neither code nor abbreviation. Names without letters or digits agree with none.
    """
    usable = F.filter(variants, lambda v: (v["distinct"] == ours["distinct"]) & (v["plain"] != ""))
    canonical = ours["canonical"]

    def shortened(v: Column) -> Column:
        theirs = v["canonical"]
        by_initials = ((F.length(ours["initials"]) >= 2) & (theirs == ours["initials"])) | ((F.length(canonical) >= 2) & (v["initials"] == canonical))
        return (F.length(theirs) >= 2) & (by_initials | _shortens(canonical, theirs) | _shortens(theirs, canonical))

    whole = ours["distinct"] == ""
    named = ours["plain"] != ""
    coded = F.length(F.trim(code)) >= 2
    return (
        F.when(named & F.exists(usable, lambda v: v["plain"] == ours["plain"]), 0)
        .when(named & F.exists(usable, lambda v: v["canonical"] == canonical), 1)
        .when(named & whole & coded & F.exists(usable, lambda v: v["plain"] == plain_name(code)), 2)
        .when(named & whole & F.exists(usable, shortened), 3)
    )


def _letter_pairs(name: Column) -> Column:
    """Distinct pairs of letters that stand in ``name`` in this order, as texts."""
    letters = lambda text: F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    after = lambda x: letters(F.substring(name, F.instr(name, x) + 1, F.length(name)))
    return F.flatten(F.transform(letters(name), lambda x: F.transform(after(x), lambda y: F.concat(x, y))))


def _marked(mark: str, value: Column) -> Column:
    return F.concat(F.lit(mark), value)


def our_keys(ours: Column, code: Column) -> Column:
    """Keys of a name's forms: whatever agrees in some tier shares one with :func:`their_keys`."""
    name = ours["canonical"]
    strong = F.array(_marked("plain:", ours["plain"]), _marked("canonical:", name))
    weak = F.concat(
        F.array(_marked("canonical:", ours["initials"]), _marked("initials:", name), _marked("short:", F.substring(name, 1, 2)), _marked("plain:", plain_name(F.coalesce(code, F.lit(""))))),
        F.transform(_letter_pairs(name), lambda p: _marked("long:", p)),
    )
    return F.array_distinct(F.when(ours["distinct"] == "", F.concat(strong, weak)).otherwise(strong))


def their_keys(variants: Column) -> Column:
    """Keys of the forms of all variants of a name."""

    def keys(v: Column) -> Column:
        name = v["canonical"]
        plain = F.array(_marked("plain:", v["plain"]), _marked("canonical:", name), _marked("initials:", v["initials"]), _marked("long:", F.substring(name, 1, 2)))
        return F.concat(plain, F.transform(_letter_pairs(name), lambda p: _marked("short:", p)))

    return F.array_distinct(F.flatten(F.transform(variants, keys)))

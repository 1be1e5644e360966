"""Column functions that tie names, sides and plans together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import plain_name


def same_subject(a: Column, b: Column, least: int = 4) -> Column:
    """Whether one key begins with the other, both having ``least`` letters at least."""
    return (F.length(a) >= least) & (F.length(b) >= least) & (F.startswith(a, b) | F.startswith(b, a))


def composite_kind(text: Column) -> Column:
    """range, both, either or single: what joins the parts of a composite question; a range is no composite."""
    return (
        F.when(F.rlike(text, F.lit(r"(?i)\bbetween\b.+\band\b")), "range").when(F.rlike(text, F.lit(r"(?i)\b(and|both)\b")), "both").when(F.rlike(text, F.lit(r"(?i)\bor\b")), "either").otherwise("single")
    )


def split_at_connective(text: Column) -> Column:
    """The parts before and after the first `` and `` or `` or ``; one part without."""
    places = [F.locate(c, F.lower(text)) for c in (" and ", " or ")]
    nearest = F.least(*[F.when(p > 0, p) for p in places])
    width = F.when(F.lower(F.substring(text, nearest, F.lit(5))) == " and ", 5).otherwise(4)
    return F.when(nearest.isNull(), F.array(text)).otherwise(F.array(F.substring(text, F.lit(1), nearest - 1), F.substring(text, nearest + width, F.length(text))))


def dates_in(text: Column) -> Column:
    """All valid ISO dates that stand in the text, in order."""
    found = F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), 1)
    return F.filter(F.transform(found, lambda d: F.try_to_date(d, "yyyy-MM-dd")), lambda d: d.isNotNull())


def nearest_date(dates: Column, target: Column) -> Column:
    """The date nearest to the target, the earlier one at equal distance."""
    return F.array_min(F.transform(dates, lambda d: F.struct(F.abs(F.datediff(d, target)).alias("gap"), d.alias("date"))))["date"]


def value_ladder(text: Column) -> Column:
    """The first amount in the text in units: ``$1.5k`` is 1500; null without one."""
    number = F.regexp_extract(text, r"\$?(\d+(?:\.\d+)?)\s*(k|m|bn)?(?![\w.])", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, r"\$?(\d+(?:\.\d+)?)\s*(k|m|bn)?(?![\w.])", 2))
    return number * F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "bn", 1e9).otherwise(1.0)


def side_index(labels: Column, team_a: Column, team_b: Column) -> Column:
    """struct(index, reason): the place of team A among the labels, from A's own label or the complement of B's.

    Labels that no team name fits, and teams that several labels fit, give a reason instead.
    """
    places = lambda team: F.filter(F.transform(labels, lambda x, i: F.when(plain_name(x) == plain_name(team), i)), lambda i: i.isNotNull())
    a, b = places(team_a), places(team_b)
    ambiguous = (F.size(a) > 1) | (F.size(b) > 1) | ((F.size(a) == 1) & (F.size(b) == 1) & (F.get(a, F.lit(0)) == F.get(b, F.lit(0))))
    index = F.when(F.size(a) == 1, F.get(a, F.lit(0))).when((F.size(b) == 1) & (F.size(labels) == 2), 1 - F.get(b, F.lit(0)))
    reason = F.when(ambiguous, "ambiguous").when(index.isNull(), "no team label")
    return F.struct(F.when(reason.isNull(), index).alias("index"), reason.alias("reason"))


def active_between(joined: Column, left: Column, at: Column) -> Column:
    """Member from the joining instant on, and up to, not at, the leaving one; no leaving instant is for good."""
    return (joined <= at) & (left.isNull() | (at < left))


def home_first(teams: Column) -> Column:
    """struct(a, b, review): the home team first by its field, else in the order of the array, which asks for a review."""
    home, away = F.filter(teams, lambda t: t["side"] == "home"), F.filter(teams, lambda t: t["side"] == "away")
    named = (F.size(home) == 1) & (F.size(away) == 1)
    pick = lambda xs, i: F.try_element_at(xs, F.lit(i))["name"]
    return F.struct(F.when(named, pick(home, 1)).otherwise(pick(teams, 1)).alias("a"), F.when(named, pick(away, 1)).otherwise(pick(teams, 2)).alias("b"), (~named).alias("review"))


def odds_side(name: Column, aliases_a: Column, aliases_b: Column, outcome_id: Column, first_id: Column) -> Column:
    """A or B by alias; else by consecutive outcome ids; null if neither tells."""
    key = plain_name(name)
    has = lambda xs: F.exists(xs, lambda x: plain_name(x) == key)
    return F.when(has(aliases_a) & ~has(aliases_b), "A").when(has(aliases_b) & ~has(aliases_a), "B").when(outcome_id == first_id, "A").when(outcome_id == first_id + 1, "B")


def review_reasons(**checks: Column) -> Column:
    """The names of the checks that hold, in their order."""
    return F.filter(F.array(*[F.when(c, F.lit(name.replace("_", " "))) for name, c in checks.items()]), lambda x: x.isNotNull())


def truncation_hint(n: Column, page_sizes: tuple[int, ...] = (50, 100, 250, 500, 1000)) -> Column:
    """Whether a result's size is one that page limits give, and so may be cut."""
    return n.isin(list(page_sizes))


def common_title(titles: Column, share: float = 0.8) -> Column:
    """What at least ``share`` of the titles end in after their first word; null if nothing does."""
    rests = F.transform(titles, lambda t: F.regexp_extract(t, r"^\S+\s+(.*)$", 1))
    counted = F.transform(F.array_distinct(rests), lambda r: F.struct(F.size(F.filter(rests, lambda x: x == r)).alias("n"), r.alias("r")))
    best = F.array_max(counted)
    return F.when((best["r"] != "") & (best["n"] >= share * F.size(titles)), best["r"])

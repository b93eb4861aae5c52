"""Column helpers for the emptiness, rounding and list conventions of catalogue records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRECISION_RANK = {"day": 4, "month": 3, "quarter": 2, "year": 1, "unknown": 0}


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it; chains of conditions would otherwise copy it each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_blank(c: Column) -> Column:
    """Null or the empty string."""
    return c.isNull() | (c.cast("string") == "")


def empty_number(c: Column) -> Column:
    """Null, NaN or 0: a number that says nothing."""
    return c.isNull() | F.isnan(c.cast("double")) | (c == 0)


def empty_text(c: Column) -> Column:
    """Null, '' or '0'."""
    return c.isNull() | c.isin("", "0")


def empty_list(c: Column) -> Column:
    return c.isNull() | (F.size(c) == 0)


def filled(c: Column) -> Column:
    """The number, or null where it says nothing."""
    return F.when(~empty_number(c), c)


def round_away(c: Column) -> Column:
    """Nearest whole number, halves away from zero; 0 for null and for what is not finite."""

    def rounded(x: Column) -> Column:
        low = F.floor(F.abs(x))
        whole = low + F.when(F.abs(x) - low >= 0.5, 1).otherwise(0)
        finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        return F.when(finite, F.when(x < 0, -whole).otherwise(whole)).otherwise(F.lit(0)).cast("bigint")

    return let(c.cast("double"), rounded)


def round_up_half(c: Column, digits: int = 0) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits: halves towards plus infinity."""
    scaled = F.floor(c.cast("double") * float(10**digits) + 0.5)
    return scaled.cast("bigint") if digits == 0 else scaled.cast("double") / float(10**digits)


def hours(amount: Column, per_hour: int) -> Column:
    """Minutes (60) or seconds (3600) as hours to one decimal; null unless positive."""
    return F.when(amount > 0, round_up_half(amount.cast("double") / per_hour, 1))


def months_apart(a: Column, b: Column) -> Column:
    """Difference of the month indexes of two dates; days do not count."""
    return F.abs((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b))


def whole_months(a: Column, b: Column) -> Column:
    """Full calendar months between two dates: one less if the later day of the month is not reached."""
    low, high = F.least(a, b), F.greatest(a, b)
    apart = (F.year(high) - F.year(low)) * 12 + F.month(high) - F.month(low)
    return F.when(a.isNotNull() & b.isNotNull(), apart - F.when(F.dayofmonth(high) < F.dayofmonth(low), 1).otherwise(0))


def age_years(released: Column, now: Column) -> Column:
    return F.floor(whole_months(released, now) / 12).cast("int")


def precision_rank(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PRECISION_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), F.lit(0))


def clean_list(c: Column) -> Column:
    """Trimmed, without empties and repeats, in first-seen order."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def to_pipes(c: Column) -> Column:
    """['a', 'b'] -> '|a|b|', null if nothing is left."""
    kept = clean_list(c)
    return F.when(F.size(kept) > 0, F.concat(F.lit("|"), F.array_join(kept, "|"), F.lit("|")))


def from_pipes(c: Column) -> Column:
    """'|a|b|' -> ['a', 'b']; never null."""
    parts = F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def ordered_subset(values: Column, order: list[str]) -> Column:
    """Those of `order` that `values` holds in any case, in that order."""
    held = F.transform(values, lambda x: F.upper(F.trim(x)))
    return F.filter(F.array(*[F.lit(x) for x in order]), lambda x: F.array_contains(held, x))


def positive_share(good: Column, total: Column) -> Column:
    """Share of good votes in percent, rounded half up; null without votes."""
    return F.when(total > 0, round_up_half(good.cast("double") / total * 100))


def review_label(percent: Column, votes: Column) -> Column:
    """The usual words for a share of positive reviews; null under ten votes."""
    labels = F.when((percent >= 95) & (votes >= 500), "Overwhelmingly Positive").when((percent >= 80) & (votes >= 50), "Very Positive")
    labels = labels.when(percent >= 80, "Positive").when(percent >= 70, "Mostly Positive").when(percent >= 40, "Mixed").when(percent >= 20, "Mostly Negative")
    labels = labels.when(votes >= 500, "Overwhelmingly Negative").when(votes >= 50, "Very Negative").otherwise("Negative")
    return F.when(percent.isNotNull() & (votes >= 10), labels)


def owners_midpoint(text: Column) -> Column:
    """'1,000,000 .. 2,000,000' -> the middle; null unless both sides are numbers."""
    sides = F.split(F.regexp_replace(F.regexp_replace(text, "(?i)&nbsp;", ""), r"[\s,]", ""), r"\.\.")
    low, high = (F.regexp_extract(F.get(sides, F.lit(i)), r"^(\d+)", 1).try_cast("double") for i in (0, 1))
    return F.when(F.size(sides) == 2, round_up_half((low + high) / 2))


def vote_share(good: Column, bad: Column) -> Column:
    """struct<score, votes> of good and bad votes; a side without votes counts as one in the score, null if both are without."""
    g, b = F.coalesce(filled(good), F.lit(1)), F.coalesce(filled(bad), F.lit(1))
    score = round_up_half(g.cast("double") / (g + b) * 100)
    votes = (F.coalesce(good, F.lit(0)) + F.coalesce(bad, F.lit(0))).cast("bigint")
    return F.when(~(empty_number(good) & empty_number(bad)), F.struct(score.alias("score"), votes.alias("votes")))


def money_cents(text: Column) -> Column:
    """'1999 USD' -> 1999, the first whole number; null if there is none."""
    return F.regexp_extract(text, r"(-?\d+)", 1).try_cast("bigint")


def first_int(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("bigint")


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def slot(value: Column, table: dict, fallback) -> Column:
    """Exact lookup in a small fixed table."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, value), F.lit(fallback))


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB to one decimal."""
    kb, mb, gb = 1024, 1024**2, 1024**3
    shown = lambda unit, name: F.concat(F.format_number(size / unit, 1), F.lit(f" {name}"))
    return F.when(size < kb, F.concat(size.cast("bigint").cast("string"), F.lit(" B"))).when(size < mb, shown(kb, "KB")).when(size < gb, shown(mb, "MB")).otherwise(shown(gb, "GB"))


def percent(part: Column, whole: Column) -> Column:
    """Percent to one decimal; 0 of nothing is 0."""
    return F.when(whole > 0, F.floor(part.cast("double") / whole * 1000 + 0.5) / 10).otherwise(F.lit(0.0))


def percentile_of(ordered: Column, percent: float) -> Column:
    """The percentile of an ascending array of numbers, between neighbours in proportion; null of an empty one."""
    place = (F.size(ordered) - 1) * (percent / 100)
    low = F.get(ordered, F.floor(place).cast("int"))
    high = F.get(ordered, F.ceil(place).cast("int"))
    return F.when(F.size(ordered) > 0, low + (high - low) * (place - F.floor(place)))


def playtime_summary(reviews: Column) -> Column:
    """struct<count, median, p25, p75, median_forever> of minutes played, from an array of struct<at_review, forever>; null if no review has any.

    A review counts with its minutes at the review, else with those overall; the last median is of the minutes overall alone."""
    positive = lambda x: F.when((x > 0) & (x < float("inf")), x.cast("double"))
    series = lambda f: F.array_sort(F.filter(F.transform(reviews, f), lambda x: x.isNotNull()))
    at = series(lambda r: F.coalesce(positive(r["at_review"]), positive(r["forever"])))
    ever = series(lambda r: positive(r["forever"]))
    found = F.struct(F.size(at).alias("count"), percentile_of(at, 50).alias("median"), percentile_of(at, 25).alias("p25"), percentile_of(at, 75).alias("p75"), percentile_of(ever, 50).alias("median_forever"))
    return F.when(F.size(at) > 0, found)


def year_of(text: Column) -> Column:
    """The year that a date as text begins with; null if it begins with no four digits or with 0000."""
    year = F.regexp_extract(text.cast("string"), r"^\s*(\d{4})(?!\d)", 1).try_cast("int")
    return F.when(year > 0, year)

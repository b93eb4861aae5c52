"""Faceted filters, cards and random selection over a catalogue table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_VALUES = 16
SEGMENTS = (1, 12, 16)


@dataclass(frozen=True)
class Facets:
    """A filter request.  None means: no condition."""

    include: dict[str, list[str]] = field(default_factory=dict)  # list column -> values, any of them
    exclude: dict[str, list[str]] = field(default_factory=dict)
    include_value: dict[str, list[str]] = field(default_factory=dict)  # scalar column -> values
    exclude_value: dict[str, list[str]] = field(default_factory=dict)
    folded: frozenset[str] = frozenset()  # list columns compared without regard to case and accents
    price: tuple[float, float] | None = None
    price_top: float = 100.0  # from here on the upper bound is open
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)  # inclusive
    released: tuple[str, str] | None = None  # months, YYYY-MM
    not_null: tuple[str, ...] = ()
    ids: list[int] | None = None
    library: DataFrame | None = None  # one column of ids; None: no filter, empty: no rows
    preset: DataFrame | None = None


def capped(values: list | None) -> list:
    """The first 16 values, without blanks among them."""
    return [v for v in (values or [])[:MAX_VALUES] if v not in (None, "")]


def has_any(column: Column, values: list[str], folded: bool = False) -> Column:
    wanted = F.array(*[F.lit(v) for v in values])
    if folded:
        fold = lambda c: F.transform(c, lambda x: F.collate(x, "UNICODE_CI_AI"))
        return F.arrays_overlap(fold(column), fold(wanted))
    return F.arrays_overlap(column, wanted)


def price_condition(price: Column, low: float, high: float, top: float) -> Column:
    """Cents between the bounds.  A null price passes only if the range begins at 0 or below; from `top` on there is no upper bound."""
    cents = lambda x: int(x * 100 + 0.5)
    if high >= top:
        inside, free = price >= cents(low), low <= 0
    else:
        inside, free = price.between(cents(low), cents(high)), low == 0
    return inside | price.isNull() if free else inside


def region_condition(own: Column, *others: Column) -> Column:
    """Not: unsold in one's own region though sold in another."""
    sold = lambda c: F.coalesce(c, F.lit(0)) > 0
    elsewhere = sold(others[0])
    for c in others[1:]:
        elsewhere = elsewhere | sold(c)
    return sold(own) | ~elsewhere


def conditions(f: Facets, price_col: str = "price", released_col: str = "release_date", id_col: str = "id") -> list[Column]:
    found = []
    for name, values in f.include.items():
        if capped(values):
            found.append(has_any(F.col(name), capped(values), name in f.folded))
    for name, values in f.exclude.items():
        if capped(values):
            found.append(F.col(name).isNull() | ~has_any(F.col(name), capped(values), name in f.folded))
    found += [F.col(name).isin(capped(v)) for name, v in f.include_value.items() if capped(v)]
    found += [F.col(name).isNull() | ~F.col(name).isin(capped(v)) for name, v in f.exclude_value.items() if capped(v)]
    if f.price is not None:
        found.append(price_condition(F.col(price_col), *f.price, f.price_top))
    found += [F.col(name).between(low, high) for name, (low, high) in f.ranges.items()]
    if f.released is not None:
        first, last = (F.lit(f"{m}-01").cast("date") for m in f.released)
        found.append(F.col(released_col).between(first, F.last_day(last)))
    found += [F.col(name).isNotNull() for name in f.not_null]
    if f.ids is not None:
        ids = [i for i in f.ids[:MAX_VALUES] if isinstance(i, int) and i > 0]
        if ids:
            found.append(F.col(id_col).isin(ids))
    return found


def select_rows(items: DataFrame, f: Facets, *, id_col: str = "id", price_col: str = "price", released_col: str = "release_date", visible: Column | None = None, library_col: str | None = None) -> DataFrame:
    """The visible rows that meet all conditions; library and preset are semi-joins."""
    out = items if visible is None else items.where(visible)
    for c in conditions(f, price_col, released_col, id_col):
        out = out.where(c)
    for side, on in ((f.library, library_col or id_col), (f.preset, id_col)):
        if side is not None:
            out = out.join(side.toDF("__key"), F.col(on) == F.col("__key"), "left_semi")
    return out


def clamp_segments(n: int | None) -> int:
    low, default, high = SEGMENTS
    return default if n is None else max(low, min(high, int(n)))


def seeded(key: Column, seed: str) -> Column:
    """A reproducible random order: any engine gets the same."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def sample(items: DataFrame, n: int, id_col: str = "id", seed: str = "0") -> DataFrame:
    """n rows without replacement in seeded order: a top-k, no full sort."""
    return items.orderBy(seeded(F.col(id_col), seed), id_col).limit(n)


def sample_padded(items: DataFrame, segments: int, id_col: str = "id", seed: str = "0") -> DataFrame:
    """Exactly `segments` rows (place, id) if there is any row: fewer rows are repeated in turn, then all are shuffled."""
    spark, n = items.sparkSession, clamp_segments(segments)
    picked = sample(items.select(id_col), n, id_col, seed)
    turn = Window.orderBy(seeded(F.col(id_col), seed), id_col)  # at most 16 rows
    picked = picked.withColumn("turn", F.row_number().over(turn) - 1)
    size = picked.agg(F.count("*").alias("size"))
    seats = spark.range(n).select(F.col("id").cast("int").alias("seat"))
    dealt = seats.join(F.broadcast(size), F.col("size") > 0).join(F.broadcast(picked), F.col("seat") % F.col("size") == F.col("turn"))  # 16 rows at most
    order = Window.orderBy(seeded(F.col("seat"), seed + "/shuffle"), "seat")
    return dealt.select(F.row_number().over(order).alias("place"), id_col)


def pick_from(items: DataFrame, pick: int, id_col: str = "id") -> DataFrame:
    """The row of the first id at or after `pick`, else of the first id.  Ids after a gap are likelier; the pick is the caller's."""
    after = F.col(id_col) >= pick
    return items.orderBy((~after).cast("int"), id_col).limit(1)


def in_order(items: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows for a list of ids (pos, id) as often and in the order that they are asked for; unknown ids are left out."""
    return ids.toDF("pos", "__id").join(items, F.col("__id") == F.col(id_col)).drop("__id").orderBy("pos")


def export_visible(non_item: Column, purchasable: Column, discount: Column) -> Column:
    return non_item.isNull() & purchasable & (discount.isNull() | (discount != 100))


def price_block(lang: Column, cis: Column, usd: Column, rub: Column, cis_usd: Column) -> Column:
    """The price that a user sees: the regional one on wish, else roubles for Russian, else dollars."""
    return F.when(cis & (lang == "ru"), cis_usd).when(lang == "ru", rub).otherwise(usd)


def described(lang: Column, en: Column, ru: Column) -> Column:
    """The text in the user's language; Russian falls back to English, also from an empty text."""
    return F.when((lang == "ru") & ru.isNotNull() & (ru != ""), ru).otherwise(en)


def recent_block(percent: Column, votes: Column, label: Column) -> Column:
    """A struct of recent reviews, or null under ten votes."""
    return F.when(votes >= 10, F.struct(percent.alias("percent"), votes.alias("votes"), label.alias("label")))

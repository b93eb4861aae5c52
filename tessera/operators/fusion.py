"""Fusing records of several sources into one row: priorities, unions, release dates, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import age_years, empty_list, empty_number, filled, hours, let, precision_rank, round_away, slot, whole_months

# Weights of the composite scores.
MISSING_PENALTY = {"steam": 4, "igdb": 2, "igdb_users": 2, "critics": 4, "users": 4, "gamerankings": 2, "gamefaqs": 2}
OWNER_PENALTY = {150000000: -6, 75000000: -6, 35000000: -6, 15000000: -4, 7500000: -4, 3500000: -2, 1500000: -2, 750000: 2, 350000: 2, 150000: 4, 75000: 4, 35000: 6, 10000: 6}
AGE_PENALTY, AGE_ELSE, INDIE_PENALTY = ((3, 0), (6, 2), (12, 2), (18, 4), (24, 4)), 6, 8
VOTE_WEIGHT = {"log_base": 10.0, "offset": 10.0, "least": 1.0}
POINT_DEFAULTS = {"time": 30, "score": 15, "owners": 5, "difficulty": 20}
DIFFICULTY_POINTS = {"Simple": 0, "Simple-Easy": 5, "Easy": 10, "Easy-Just Right": 15, "Just Right": 20, "Just Right-Tough": 25, "Tough": 30, "Tough-Unforgiving": 35, "Unforgiving": 40}
OWNER_POINTS = {150000000: 20, 75000000: 20, 35000000: 20, 15000000: 18, 7500000: 16, 3500000: 14, 1500000: 12, 750000: 10, 350000: 8, 150000: 6, 75000: 4, 35000: 2, 10000: 0}
TIME_EXACT, TIME_LONG = {11: 60, 12: 70, 13: 80, 14: 90, 15: 100}, ((18, 10), (21, 20), (24, 30), (27, 40))
SCORE_BELOW = ((40, 15), (50, 20), (60, 25), (70, 30), (80, 35), (100, 40))
PRICE_MULTIPLIER = ((10000, 1.0), (25000, 1.0), (40000, 1.0), (60000, 1.0), (80000, 1.0))
SOURCE_ORDER = ("steam", "gog", "igdb", "hltb", "gamefaqs", "metacritic", "gamerankings", "steamspy", "wikidata", "legacy")


def source_priority(source: Column) -> Column:
    return slot(source, {s: i for i, s in enumerate(SOURCE_ORDER)}, len(SOURCE_ORDER))


def first_filled(value: Column, priority: Column, empty: Column) -> Column:
    """Aggregate: the value of the first record by priority that is not empty."""
    return F.min_by(F.when(~empty, value), F.when(~empty, priority))


def union_lists(values: Column, priority: Column) -> Column:
    """Aggregate: all elements of the records' lists in first-seen order by priority."""
    rows = F.array_sort(F.collect_list(F.when(~empty_list(values), F.struct(priority.alias("p"), values.alias("v")))))
    return F.array_distinct(F.flatten(F.transform(rows, lambda r: r["v"])))


def fuse(records: DataFrame, by: str, scalars: dict[str, Column], lists: list[str], priority: Column) -> DataFrame:
    """One row per item in one shuffle: scalars maps a column to its test for emptiness."""
    picked = [first_filled(F.col(c), priority, empty).alias(c) for c, empty in scalars.items()]
    return records.groupBy(by).agg(*picked, *[union_lists(F.col(c), priority).alias(c) for c in lists])


def critics_score(scores: list[tuple[Column, Column, str]]) -> Column:
    """struct<score, count, source> of the first source that has a score."""
    return F.coalesce(*[F.when(~empty_number(s), F.struct(s.alias("score"), n.alias("count"), F.lit(name).alias("source"))) for s, n, name in scores])


def composite_score(ratings: dict[str, Column], stars: Column, owners: Column, released: Column, genres: Column, now: Column, votes: dict[str, Column] | None = None) -> Column:
    """0..100.  Mean of the ratings that are there (five stars count as 100), one alone unrounded; from 50 on less the penalties for missing ratings,
    rare ownership, age and the genre indie.  votes: then the mean is weighted by the logarithm of the votes."""
    every = {**{k: filled(v).cast("double") for k, v in ratings.items()}, "gamefaqs": filled(stars).cast("double") * 20}
    def summed(r: Column) -> Column:
        v = {k: r[k] for k in every}
        mean = weighted_mean(v, votes) if votes is not None else sum((F.coalesce(x, F.lit(0.0)) for x in v.values()), F.lit(0.0)) / F.nullif(sum((x.isNotNull().cast("int") for x in v.values()), F.lit(0)), F.lit(0))
        missing = sum((F.when(x.isNull(), MISSING_PENALTY[k]).otherwise(0) for k, x in v.items()), F.lit(0))
        return F.struct(sum((x.isNotNull().cast("int") for x in v.values()), F.lit(0)).alias("n"), mean.alias("mean"), F.coalesce(*v.values()).alias("one"), missing.alias("missing"))

    penalty = F.when(empty_number(owners), 0).otherwise(slot(owners.cast("bigint"), OWNER_PENALTY, 0))
    penalty = penalty + let(age_years(released, now), _age_penalty)
    penalty = penalty + F.when(F.exists(genres, lambda g: F.lower(g).contains("indie")), INDIE_PENALTY).otherwise(0)

    def scored(x: Column) -> Column:
        score = F.when(x["n"] == 0, 0.0).when(x["n"] == 1, x["one"]).otherwise(round_away(x["mean"]).cast("double"))
        return let(score, lambda s: F.least(F.greatest(F.when(s >= 50, s - x["missing"] - penalty).otherwise(s), F.lit(0.0)), F.lit(100.0)))

    return let(let(F.struct(*[v.alias(k) for k, v in every.items()]), summed), scored)


def _age_penalty(years: Column) -> Column:
    aged = F.when(years.isNull(), AGE_ELSE)
    for most, points in AGE_PENALTY:
        aged = aged.when(years <= most, points)
    return aged.otherwise(AGE_ELSE)


def weighted_mean(ratings: dict[str, Column], votes: dict[str, Column]) -> Column:
    """Mean of the ratings that are there, weighted by log(votes + offset), at least 1; null without ratings."""
    top, weights = F.lit(0.0), F.lit(0.0)
    for name, value in ratings.items():
        v = filled(votes[name]) if name in votes else F.lit(None).cast("double")
        w = F.coalesce(F.greatest(F.lit(VOTE_WEIGHT["least"]), F.ln(v + VOTE_WEIGHT["offset"]) / F.ln(F.lit(VOTE_WEIGHT["log_base"]))), F.lit(VOTE_WEIGHT["least"]))
        top, weights = top + F.coalesce(value * w, F.lit(0.0)), weights + F.when(value.isNotNull(), w).otherwise(0.0)
    return F.when(weights > 0, top / weights)


def final_time(main: Column, other_main: Column, complete: Column, other_complete: Column) -> Column:
    """struct<final_time, time_complete> in whole hours: the first known time, and a completion time that is longer than it."""
    first = F.coalesce(filled(main), filled(other_main), filled(complete), filled(other_complete), F.lit(0.0)).cast("double")
    whole = F.when(first > F.coalesce(complete.cast("double"), F.lit(0.0)), first + 1).otherwise(complete.cast("double"))
    return F.struct(round_away(first).alias("final_time"), F.when(empty_number(whole), round_away(other_complete)).otherwise(round_away(whole)).alias("time_complete"))


def average_playtime(review_minutes: Column, review_count: Column, median: Column, mean: Column, least: int = 10, floor: int = 3) -> Column:
    """struct<hours, source>: reviews if there are enough, then the survey's median or mean, then a few reviews; else null."""
    known = (review_minutes > 0) & (review_count > 0)
    said = lambda amount, source: F.struct(hours(amount, 60).alias("hours"), F.lit(source).alias("source"))
    return F.coalesce(
        F.when(known & (review_count >= least), said(review_minutes, "steam_reviews")),
        F.when(median > 0, said(median, "steamspy")),
        F.when(mean > 0, said(mean, "steamspy")),
        F.when(known & (review_count >= floor), said(review_minutes, "steam_reviews")),
    )


def points(difficulty: Column, time: Column, score: Column, owners: Column, price: Column) -> Column:
    """Reward points: time, score, owners and difficulty by table, times the price bracket's factor, plus a bonus for long ones.

    A score of exactly 100 has no bracket and counts as unknown."""
    by_time = F.when(empty_number(time), POINT_DEFAULTS["time"]).when(time <= 10, time * 5)
    for hours_, value in TIME_EXACT.items():
        by_time = by_time.when(time == hours_, value)
    by_time = by_time.otherwise(100).cast("double")
    bonus = F.when(empty_number(time) | (time <= 10) | time.isin(*TIME_EXACT), 0)
    for most, more in TIME_LONG:
        bonus = bonus.when(time <= most, more)
    bonus = bonus.otherwise(50)
    by_score = F.when(empty_number(score), POINT_DEFAULTS["score"]).when(score <= 30, 10)
    for below, value in SCORE_BELOW:
        by_score = by_score.when(score < below, value)
    by_score = by_score.otherwise(POINT_DEFAULTS["score"])
    by_owners = F.when(empty_number(owners), POINT_DEFAULTS["owners"]).otherwise(slot(owners.cast("bigint"), OWNER_POINTS, POINT_DEFAULTS["owners"]))
    total = by_time + by_score + by_owners + slot(difficulty, DIFFICULTY_POINTS, POINT_DEFAULTS["difficulty"])
    paid = F.coalesce(price, F.lit(0))
    scaled = F.when(paid < PRICE_MULTIPLIER[0][0], round_away(total * PRICE_MULTIPLIER[0][1]).cast("double"))
    for below, factor in PRICE_MULTIPLIER[1:]:
        scaled = scaled.when(paid < below, round_away(total * factor).cast("double"))
    return scaled.otherwise(total) + bonus


def resolve_release(candidates: DataFrame, by: str = "item_id", tolerance: int = 8, old_months: int = 12) -> DataFrame:
    """(by, date, precision, confidence, store_date, conflict) from candidates (by, date, precision, kind), kind store or independent.

    Independent dates are clustered: sorted by month, a gap of more than `tolerance` months parts them.  A cluster of two or more wins (90), largest
    first.  Else, without a store date, the earliest independent one (60); if it is over `old_months` earlier than the store's (80 alone, 70 of
    several); if it is the only one (60); else the store date with a conflict (20).  Without independent dates the store's (30).  Candidates without
    date or precision are ignored; items without others are left out.
    """
    return decided_release(release_clusters(candidates, by, tolerance), by, old_months)


def release_clusters(candidates: DataFrame, by: str = "item_id", tolerance: int = 8) -> DataFrame:
    """The first half of resolve_release: of each item the largest cluster (top), the number of independent dates, the earliest of them and the store's."""
    known = F.col("date").isNotNull() & (F.coalesce(F.col("precision"), F.lit("unknown")) != "unknown")
    rows = candidates.where(known & F.col("kind").isin("independent", "store")).withColumn("rank", precision_rank(F.col("precision"))).withColumn("month", F.year("date") * 12 + F.month("date"))
    # one exchange: the windows and both groupings have all of an item's candidates in one place
    line = Window.partitionBy(by).orderBy("kind", "month", "date")
    parted = (F.lag("kind").over(line) != F.col("kind")) | (F.col("month") - F.lag("month").over(line) > tolerance)
    rows = rows.withColumn("parted", F.coalesce(parted, F.lit(False)).cast("int")).withColumn("cluster", F.sum("parted").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    best, early = F.min(F.struct((-F.col("rank")).alias("r"), "date", "precision")), F.min(F.struct("date", (-F.col("rank")).alias("r"), "precision"))
    clusters = rows.groupBy(by, "kind", "cluster").agg(F.count("*").alias("n"), best.alias("best"), early.alias("early"))
    independent = F.col("kind") == "independent"
    return clusters.groupBy(by).agg(
        F.min(F.when(independent, F.struct((-F.col("n")).alias("m"), F.col("best.r").alias("r"), F.col("best.date").alias("d"), "best"))).alias("top"),
        F.sum(F.when(independent, F.col("n"))).alias("independents"),
        F.min(F.when(independent, F.col("early"))).alias("early"),
        F.min(F.when(~independent, F.col("best"))).alias("store"),
    )


def decided_release(joined: DataFrame, by: str = "item_id", old_months: int = 12) -> DataFrame:
    """The second half of resolve_release, on rows (by, top, independents, early, store); store needs a date and a precision alone."""
    size = -F.col("top.m")
    gap = F.abs((F.year("early.date") - F.year("store.date")) * 12 + F.month("early.date") - F.month("store.date"))
    old = F.col("store").isNotNull() & (gap > old_months) & (F.col("early.date") < F.col("store.date"))

    def said(from_: str, confidence: Column | int, conflict: bool = False) -> Column:
        level = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.struct(F.col(f"{from_}.date").alias("date"), F.col(f"{from_}.precision").alias("precision"), level.cast("int").alias("confidence"), F.lit(conflict).alias("conflict"))

    found = (
        F.when(F.col("top").isNull(), said("store", 30))
        .when(size >= 2, said("top.best", 90))
        .when(F.col("store").isNull(), said("early", 60))
        .when(old, said("early", F.when(F.col("independents") == 1, 80).otherwise(70)))
        .when(F.col("independents") == 1, said("early", 60))
        .otherwise(said("store", 20, True))
    )
    return joined.withColumn("found", found).select(by, "found.*", F.col("store.date").alias("store_date"))


def four_date_release(meta: Column, survey: Column, times: Column, store: Column, platform: Column, months: int = 8) -> Column:
    """The older rule for four dates: three of the six pairs within `months` decide (the first date of the last such pair), else the first near pair."""
    four = [meta, survey, times, store]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    measured = F.array(*[F.coalesce(whole_months(four[i], four[j]) <= months, F.lit(False)) for i, j in pairs])

    def ruled(near: Column) -> Column:
        of = {pair: near[at] for at, pair in enumerate(pairs)}
        count = F.size(F.filter(near, lambda x: x))
        last = F.coalesce(*[F.when(of[i, j], four[i]) for i, j in reversed(pairs)])
        whole = meta.isNotNull() & survey.isNotNull() & times.isNotNull() & store.isNotNull()
        first = F.when(whole, F.when(count >= 3, last)).when(F.coalesce(platform != "Steam", F.lit(True)), store)
        ladder = F.when(of[0, 1] | of[0, 2], meta).when(of[1, 2], survey)
        ladder = ladder.when(survey.isNotNull() & ~survey.eqNullSafe(store), survey).otherwise(F.coalesce(meta, times, survey, store))
        return F.coalesce(first, ladder)

    return let(measured, ruled)


def has_any_price(prices: Column) -> Column:
    """Whether any region has an initial or a final price; 0 says nothing."""
    some = F.lit(False)
    for region in ("usd", "rub", "cis_usd"):
        some = some | ~empty_number(prices[region]["initial"]) | ~empty_number(prices[region]["final"])
    return F.coalesce(some, F.lit(False))


def store_fields(records: DataFrame, by: str = "game_id", fields: tuple[str, ...] = ("name", "image", "description_en", "description_ru", "achievements")) -> DataFrame:
    """One row an item: the store's fields and the prices to show, from the long form of extracted records (by, source, priority, vocabulary).

    A field is the first filled one of Steam and GOG, else that of the store record: Steam's, GOG's, or the first by priority of those with a store
    release.  Prices are those of the first of Steam and GOG that has any, else the store record's.  One aggregation."""
    own = F.when(F.col("source") == "steam", 0).when(F.col("source") == "gog", 1)
    rank = F.coalesce(own, F.when(F.col("store_release").isNotNull(), 2 + F.col("priority")))
    first = lambda value, order, when: F.min_by(F.when(when, value), F.when(when, order))
    blank = lambda c: F.coalesce(c.cast("string").isin("", "0"), F.lit(True))
    picks = [first(F.col(f), own, own.isNotNull() & ~blank(F.col(f))).alias(f"__{f}") for f in fields]
    store = first(F.struct(F.col("source").alias("store"), "prices", *fields), rank, rank.isNotNull()).alias("__store")
    sold = first(F.col("prices"), own, own.isNotNull() & has_any_price(F.col("prices"))).alias("__prices")
    found = records.groupBy(by).agg(*picks, store, sold)
    shown = [F.coalesce(f"__{f}", F.when(~blank(F.col("__store")[f]), F.col("__store")[f])).alias(f) for f in fields]
    return found.select(by, F.col("__store.store").alias("store"), *shown, F.coalesce("__prices", "__store.prices").alias("prices"))

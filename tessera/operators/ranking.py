"""Ranked search, dictionaries, pages and freshness queues: top-k plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.segments import numbered

SEARCH_ROWS, DICTIONARY_ROWS, SUGGESTIONS, PAGE = 20, 2000, 50, 50


def search_rank(name: Column, needle: str) -> list[Column]:
    """Sort keys: whole name, prefix, start of a word."""
    low, q = F.lower(name), needle.strip().lower()
    return [(low == q).desc(), low.startswith(q).desc(), F.contains(low, F.lit(f" {q}")).desc()]


def ranked_search(items: DataFrame, needle: str, *, name_col: str = "name", popularity: list[str] | None = None, n: int = SEARCH_ROWS) -> DataFrame:
    """Names that hold the needle: equal ones first, then prefixes, starts of words, the most popular (null last), the name.  A blank needle finds nothing."""
    if not needle.strip():
        return items.where(F.lit(False))
    found = items.where(F.contains(F.lower(F.col(name_col)), F.lit(needle.strip().lower())))
    return found.orderBy(*search_rank(F.col(name_col), needle), *[F.col(p).desc_nulls_last() for p in popularity or []], name_col).limit(n)


def dictionary(items: DataFrame, values: Column) -> DataFrame:
    """(value, n): in how many rows each value of a list column occurs."""
    return items.select(F.explode(F.array_distinct(values)).alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n"))


def merge_spellings(counts: DataFrame, key: Column | None = None) -> DataFrame:
    """Spellings of one key as the commonest of them (ties: more lower-case letters, then the smaller text) with the sum of their counts."""
    key = F.lower(F.trim(F.regexp_replace("value", r"\s+", " "))) if key is None else key
    small = F.length(F.regexp_replace("value", r"[^\p{Ll}]", ""))
    order = Window.partitionBy("key").orderBy(F.col("n").desc(), small.desc(), "value")
    keyed = counts.withColumn("key", key)
    best = keyed.withColumn("turn", F.row_number().over(order)).groupBy("key").agg(F.max(F.when(F.col("turn") == 1, F.col("value"))).alias("value"), F.sum("n").alias("n"))
    return best.select("value", "n")


def dictionary_top(counts: DataFrame, n: int = DICTIONARY_ROWS) -> DataFrame:
    return counts.orderBy(F.col("n").desc(), "value").limit(n)


def dictionary_search(counts: DataFrame, needle: str, n: int = SUGGESTIONS) -> DataFrame:
    """Values that hold the needle with their rank: 0 equal, 1 prefix, 2 start of a word, 3 elsewhere."""
    low, q = F.lower("value"), needle.strip().lower()
    rank = F.when(low == q, 0).when(low.startswith(q), 1).when(F.contains(low, F.lit(f" {q}")), 2).otherwise(3)
    return counts.where(F.contains(low, F.lit(q))).withColumn("rank", rank).orderBy("rank", F.col("n").desc(), "value").limit(n)


def distinct_values(items: DataFrame, column: str) -> DataFrame:
    return items.select(column).distinct()


def contains_search(items: DataFrame, needles: dict[str, str]) -> DataFrame:
    """Rows of which any of the columns, as text, holds its needle; blank needles find nothing."""
    found = F.lit(False)
    for column, needle in needles.items():
        if needle.strip():
            found = found | F.coalesce(F.contains(F.col(column).cast("string"), F.lit(needle)), F.lit(False))
    return items.where(found)


def keyset_page(items: DataFrame, after: int, n: int, id_col: str = "id") -> DataFrame:
    return items.where(F.col(id_col) > after).orderBy(id_col).limit(n)


def offset_page(items: DataFrame, page: int, order: list[Column], n: int = PAGE) -> DataFrame:
    """Page `page` from 1; each page is a top-k of page * n rows."""
    return items.orderBy(*order).offset((page - 1) * n).limit(n)


def filtered_page(rows: DataFrame, equal: dict[str, str | None], page: int, order: list[Column], n: int = PAGE, total: str = "total") -> DataFrame:
    """A page (from 1) of the rows whose columns equal the given values (None: any value), each with how many rows there are on all pages.

    A top-k beside one count; a page beyond the last has no rows."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    count = rows.agg(F.count("*").alias(total))
    return offset_page(rows, page, order, n).join(F.broadcast(count))  # one row


def stale_first(items: DataFrame, records: DataFrame, *, key: str, fetched: str, now: str, days: int, n: int, popularity: str | None = None) -> DataFrame:
    """Up to n items never fetched or fetched over `days` days before `now`: never fetched ones first, then the oldest (or the most popular).

    records: (key, fetched), one or more a key; the newest counts.
    """
    newest = records.groupBy(key).agg(F.max(fetched).alias("fetched_at"))
    limit = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    joined = items.join(newest, key, "left").where(F.col("fetched_at").isNull() | (F.col("fetched_at") < limit))
    keys = [F.col(popularity).desc_nulls_last()] if popularity else [F.col("fetched_at").asc_nulls_first()]
    return joined.orderBy(*keys, key).limit(n)


def stale_by_status(items: DataFrame, records: DataFrame, *, key: str, now: str, days: dict[str, int], other_days: int) -> DataFrame:
    """Items whose newest record (key, status, fetched_at) is missing or older than its status allows."""
    newest = records.groupBy(key).agg(F.max_by("status", F.struct("fetched_at", "status")).alias("status"), F.max("fetched_at").alias("fetched_at"))
    allowed = F.lit(other_days)
    for status, d in days.items():
        allowed = F.when(F.col("status") == status, d).otherwise(allowed)
    age = F.datediff(F.lit(now).cast("date"), F.col("fetched_at").cast("date"))
    return items.join(newest, key, "left").where(F.col("fetched_at").isNull() | (age > allowed))


def newest(items: DataFrame, keep: int, by: list[Column], order: list[Column]) -> DataFrame:
    """Rows beyond the `keep` newest of each group: what pruning removes."""
    return items.withColumn("__turn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__turn") > keep).drop("__turn")


def natural_key(name: Column) -> Column:
    """A sort key in which numbers count as numbers and case does not: theme2 before theme10."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(F.regexp_replace(r, "^0+(?=.)", ""), 20, "0")).otherwise(r)), "")


def natural_listing(files: DataFrame, pattern: str, name_col: str = "name") -> DataFrame:
    """(place, name) of the files whose whole name fits the pattern in any case, in natural order; places from ranges of names and their counts."""
    found = files.where(F.col(name_col).rlike(f"(?i)^(?:{pattern})$")).select(F.col(name_col).alias("name"))
    placed = numbered(found.withColumn("__key", natural_key(F.col("name"))), [F.col("__key"), F.col("name")])
    return placed.select(F.col("place").cast("int").alias("place"), "name")

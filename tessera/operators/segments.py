"""Orders and running values over few large keys: rows are dealt to ranges, each range of a key yields a summary, summaries are carried on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written

PART = "__part"


def dealt(rows: DataFrame, order: list[Column | str], parts: int | None = None) -> DataFrame:
    """The rows in ranges of `order`, which `__part` numbers in order; rows equal in all of `order` share a range.

    Ranges hold about equally many rows, whatever keys the order begins with.  The table is written, so that all steps see the same ranges."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()), "segments")


def carried(rows: DataFrame, by: list[str], summary: DataFrame, values: list[str]) -> DataFrame:
    """The rows with each range's carried values; summary: (by, __part, values), a row for each key and range.  Keys may be null."""
    here = summary.select(*[F.col(c).alias(f"__{c}_") for c in [*by, PART]], *values)
    match = rows[PART] == here[f"__{PART}_"]
    for c in by:
        match = match & rows[c].eqNullSafe(here[f"__{c}_"])
    return rows.join(here, match, "left").drop(*[f"__{c}_" for c in [*by, PART]])


def numbered(rows: DataFrame, order: list[Column | str], by: list[str] | None = None, name: str = "place", parts: int | None = None) -> DataFrame:
    """The rows with their place, from 1, in `order` within each key `by` (without: in all rows): the rank within a range after the counts of the key's
    ranges before it.  Of rows equal in order each gets a place of its own."""
    by = by or []
    ranged = dealt(rows, [*by, *order], parts)
    counts = ranged.groupBy(*by, PART).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if by else None
    if by:
        ahead = counts.withColumn("__ahead", before)
    else:  # as many counts as ranges, which are no more than shuffle partitions
        total, offsets = 0, []
        for r in sorted(counts.collect(), key=lambda r: r[PART]):
            offsets.append((r[PART], total))
            total += r["__n"]
        ahead = rows.sparkSession.createDataFrame(offsets, f"{PART} int, __ahead bigint")
    place = F.row_number().over(Window.partitionBy(*by, PART).orderBy(*order))
    return carried(ranged.withColumn("__within", place), by, ahead, ["__ahead"]).withColumn(name, F.col("__ahead") + F.col("__within")).drop(PART, "__within", "__ahead")

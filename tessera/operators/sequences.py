"""Event sequences: de-duplication, quotas, rates, streaks and repeated failures as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.segments import PART, carried, dealt, numbered


def pending_once(jobs: DataFrame, job_id: Column, at: str, until: str) -> DataFrame:
    """Jobs not enqueued while an earlier one of the same id is still pending (its `until` is after this one's `at`)."""
    before = Window.partitionBy("__job").orderBy(at, until).rowsBetween(Window.unboundedPreceding, -1)
    held = jobs.withColumn("__job", job_id).withColumn("__busy", F.max(until).over(before))
    return held.where(F.col("__busy").isNull() | (F.col("__busy") <= F.col(at))).drop("__job", "__busy")


def per_window(events: DataFrame, by: list[str], at: str, width: str, most: int | None = None) -> DataFrame:
    """Counts by tumbling window; `most`: only windows over the quota."""
    out = events.groupBy(*by, F.window(at, width).alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), "n")
    return out if most is None else out.where(F.col("n") > most)


def sessions(events: DataFrame, by: str, at: str, gap: str) -> DataFrame:
    """Sessions by gap: (by, start, n)."""
    return events.groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def _since_good(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Rows (with __part and __bad) with __run, the good events of their key and range so far."""
    line = Window.partitionBy(PART, by).orderBy(*order)
    return rows.withColumn("__run", F.coalesce(F.sum(1 - F.col("__bad")).over(line), F.lit(0)))


def _carry(ends: DataFrame, by: str, tail: str, merge) -> DataFrame:
    """ends: (by, __part, __good, tail), whether a range has a good event and what its last run of bad ones comes to; gives (by, __part, __carry): what the run
    that is open at the start of each range comes to, `merge` over the ranges back to the last one with a good event."""
    line = Window.partitionBy(by).orderBy(PART)
    runs = ends.withColumn("__since", F.sum("__good").over(line))
    so_far = merge(tail).over(Window.partitionBy(by, "__since").orderBy(PART))
    return runs.withColumn("__total", so_far).withColumn("__carry", F.lag("__total").over(line)).where("__carry IS NOT NULL")


def streaks(events: DataFrame, by: str, order: list[str], bad: Column) -> DataFrame:
    """Each event with `streak`: bad events in a row up to it, 0 after a good one.

    Runs are counted within time ranges of a key; what is open at a range's end is carried into the next, so no task holds all of a key."""
    rows = _since_good(dealt(events.withColumn("__bad", bad.cast("int")), [by, *order]), by, order)
    rows = rows.withColumn("__streak", F.sum("__bad").over(Window.partitionBy(PART, by, "__run").orderBy(*order)))
    ends = rows.groupBy(by, PART).agg(F.max((F.col("__run") > 0).cast("int")).alias("__good"), F.coalesce(F.max_by("__streak", F.struct(*order)), F.lit(0)).alias("__tail"))
    rows = carried(rows, [by], _carry(ends, by, "__tail", F.sum), ["__carry"])
    return rows.withColumn("streak", F.when(F.col("__run") == 0, F.coalesce(F.col("__streak") + F.coalesce("__carry", F.lit(0)), "__carry")).otherwise(F.col("__streak"))).drop("__bad", "__run", "__streak", "__carry", PART)


def repeated_failures(events: DataFrame, by: str, order: list[str], at: str, bad: Column, hours: int = 24) -> DataFrame:
    """Keys with two failures at least `hours` apart and no success between: (by, first_at, failed_at) of the first such pair.

    As streaks, in ranges: the first failure of a run that is open at a range's end is carried into the next."""
    rows = _since_good(dealt(events.withColumn("__bad", bad.cast("int")), [by, *order]), by, order)
    rows = rows.withColumn("__first", F.min(F.when(F.col("__bad") == 1, F.col(at))).over(Window.partitionBy(PART, by, "__run")))
    ends = rows.groupBy(by, PART).agg(F.max((F.col("__run") > 0).cast("int")).alias("__good"), F.max_by("__first", F.struct(*order)).alias("__tail"))
    rows = carried(rows.where("__bad = 1"), [by], _carry(ends, by, "__tail", F.min), ["__carry"])
    first = F.when(F.col("__run") == 0, F.least("__first", "__carry")).otherwise(F.col("__first"))
    marked = rows.withColumn("first_at", first).where(F.col(at) >= F.col("first_at") + F.expr(f"INTERVAL {hours} HOURS"))
    return marked.groupBy(by).agg(F.min(F.struct(F.col(at).alias("failed_at"), "first_at")).alias("x")).select(by, "x.first_at", "x.failed_at")


def backlog(pending: Column, batch: int) -> Column:
    """What a source does with its queue: skip enqueueing over half a batch, trim over two."""
    return F.when(pending > 2 * batch, "trim").when(pending > batch / 2, "skip").otherwise("enqueue")


def trimmed(pending: DataFrame, by: str, order: list[str], batch: int) -> DataFrame:
    """Pending jobs with `trimmed`: of a source with over two batches of them, all but the oldest batch go; what was trimmed is selected again by later runs.

    Places are counted in two levels (see segments.numbered), so a source's whole queue meets in no task."""
    counts = pending.groupBy(by).agg(F.count("*").alias("__waiting")).where(F.col("__waiting") > 2 * batch).select(F.col(by).alias("__by"), "__waiting")
    placed = numbered(pending, [F.col(c) for c in order], [by], "__place")
    joined = placed.join(counts, placed[by].eqNullSafe(counts["__by"]), "left")
    return joined.withColumn("trimmed", F.col("__waiting").isNotNull() & (F.col("__place") > batch)).drop("__by", "__waiting", "__place")


def with_pause(events: DataFrame, by: str, at: str, block: Column, hours: int) -> DataFrame:
    """The events with `paused`: whether a block of their source less than `hours` earlier still holds it up.  A later block begins the pause anew.

    Events of one moment do not pause each other.  The last block is a running maximum within time ranges of a source, which the ranges before it begin."""
    rows = dealt(events.withColumn("__block", F.when(block, F.col(at))), [by, at])
    before = Window.partitionBy(PART, by).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(by, PART).agg(F.max("__block").alias("__last"))
    earlier = Window.partitionBy(by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    rows = carried(rows.withColumn("__own", F.max("__block").over(before)), [by], ends.withColumn("__carry", F.max("__last").over(earlier)).where("__carry IS NOT NULL"), ["__carry"])
    last = F.greatest("__own", "__carry")
    return rows.withColumn("paused", F.coalesce(F.col(at) < last + F.make_interval(hours=F.lit(hours)), F.lit(False))).drop("__block", "__own", "__carry", PART)

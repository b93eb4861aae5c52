"""Versioned tables: upserts, selective updates, conflicts, purges and retention as plans from an old version to a new one."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import written


def merge_latest(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """All rows of both with one row a key: the first in `order`.  Columns are taken by name."""
    turn = Window.partitionBy(*keys).orderBy(*order)
    return old.unionByName(new).withColumn("__turn", F.row_number().over(turn)).where("__turn = 1").drop("__turn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], recency: str) -> DataFrame:
    """New rows replace old ones of their key; of several new ones the most recent counts, of equally recent ones that with the smallest hash of all
    columns but maps.  Old rows without a new one go through an anti-join, unsorted."""
    tie = F.xxhash64(*[f.name for f in new.schema.fields if "map<" not in f.dataType.simpleString()])
    turn = Window.partitionBy(*keys).orderBy(F.col(recency).desc_nulls_last(), tie)
    fresh = new.withColumn("__turn", F.row_number().over(turn)).where("__turn = 1").drop("__turn")
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def with_references(rows: DataFrame, parents: DataFrame, key: str, *, drop: bool = False) -> DataFrame:
    """Rows whose parent is missing lose the reference (set to null), or go if `drop`."""
    if drop:
        return rows.join(parents.select(key), key, "left_semi")
    known = parents.select(F.col(key).alias("__key")).distinct()
    joined = rows.join(known, rows[key] == known["__key"], "left")
    return joined.withColumn(key, F.col("__key")).drop("__key").select(*rows.columns)


def guarded_upsert(old: DataFrame, new: DataFrame, keys: list[str], *, method: str, confidence: str, protected: list[str]) -> DataFrame:
    """A new row replaces an old one only if that was made by no protected method and has no higher confidence; among new ones the most confident (ties: the
    smallest hash of the row).  New rows come down to one a key, then one join; old rows are neither sorted nor grouped, so they need one row a key.  Null
    keys never meet."""
    tie = F.xxhash64(*[f.name for f in new.schema.fields if "map<" not in f.dataType.simpleString()])
    turn = Window.partitionBy(*keys).orderBy(F.col(confidence).desc_nulls_last(), tie)
    best = new.withColumn("__turn", F.row_number().over(turn)).where("__turn = 1").drop("__turn")
    held = old.select(*keys, F.struct(*old.columns).alias("__old"))
    both = held.join(best.select(*keys, F.struct(*old.columns).alias("__new")), keys, "full")
    was, comes = F.col(f"__old.`{confidence}`"), F.col(f"__new.`{confidence}`")
    stays = F.col("__old").isNotNull() & (F.col("__new").isNull() | F.coalesce(F.col(f"__old.`{method}`").isin(*protected), F.lit(False)) | F.coalesce(was > comes, was.isNotNull() & comes.isNull()))
    return both.select(F.when(stays, F.col("__old")).otherwise(F.col("__new")).alias("r")).select("r.*")


def selective_update(old: DataFrame, new: DataFrame, key: str, *, identity: list[str], always: list[str], overridden: DataFrame | None = None) -> DataFrame:
    """Columns of the old rows set from the new ones: identity columns never, blank new values not, `always` columns even if blank.

    overridden: (key, field, value as string) of values set by hand, which win; of several for one field the largest."""
    names = [c for c in old.columns if c != key]
    joined = old.alias("o").join(new.select(key, *[F.col(c).alias(f"__{c}") for c in names if c in new.columns]), key, "left").withColumn("__hit", F.lit(True))
    hand = None
    if overridden is not None:
        hand = overridden.groupBy(key, "field").agg(F.max("value").alias("value")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("__hand"))
        joined = joined.join(hand, key, "left")
    out = [F.col(key)]
    for c in names:
        value = F.col(c)
        if c in new.columns and c not in identity:
            fresh = F.col(f"__{c}")
            blank = fresh.isNull() | (fresh.cast("string") == "")
            value = fresh if c in always else F.when(blank, value).otherwise(fresh)
        if hand is not None:
            set_ = F.try_element_at("__hand", F.lit(c))
            value = F.when(set_.isNotNull(), set_.cast(old.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return joined.select(*out)


def reconcile(existing: DataFrame, found: DataFrame, keys: list[str], payload: str, status: str = "status") -> DataFrame:
    """Conflicts after a run: new ones open, open ones refreshed or gone if not found again; accepted and overridden ones are never touched.  Adds `action`."""
    fresh = found.select(*keys, F.col(payload).alias("__p"), F.lit(True).alias("__f"))
    both = existing.withColumn("__e", F.lit(True)).join(fresh, keys, "full")
    settled = F.col("__e").isNotNull() & (F.col(status) != "open")
    action = F.when(settled, "kept").when(F.col("__e").isNull(), "opened").when(F.col("__f").isNull(), "deleted").otherwise("refreshed")
    value = F.when(settled, F.col(payload)).otherwise(F.coalesce("__p", F.col(payload)))
    return both.withColumn("action", action).where("action <> 'deleted'").select(*keys, value.alias(payload), F.when(F.col("__e").isNull(), "open").otherwise(F.col(status)).alias(status), "action")


def reopened(existing: DataFrame, found: DataFrame, keys: list[str], payload: str, status: str = "status") -> DataFrame:
    """Conflicts that a matcher reports open again whatever their state."""
    fresh = found.select(*keys, payload, F.lit("open").alias(status))
    return existing.select(*keys, payload, status).join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def purge_candidates(items: DataFrame, overrides: DataFrame, key: str, flagged: Column, protected: Column | None = None) -> DataFrame:
    """Flagged items without an override that protects them."""
    held = overrides if protected is None else overrides.where(protected)
    return items.where(flagged).join(held.select(key), key, "left_anti")


def purge(tables: dict[str, DataFrame], gone: DataFrame, key: str, *, tombstones: str, keep: list[str]) -> dict[str, DataFrame]:
    """New versions of all tables without the purged items: rows go from every table but `tombstones`, whose rows stay as not_found with a null key and null payload."""
    out = {}
    for name, rows in tables.items():
        if name != tombstones:
            out[name] = rows.join(gone.select(key), key, "left_anti")
            continue
        marked = rows.join(gone.select(F.col(key).alias("__gone")).distinct(), rows[key] == F.col("__gone"), "left")
        dead = F.col("__gone").isNotNull()
        columns = [F.when(dead, F.lit("not_found")).otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) if c in keep else F.when(~dead, F.col(c)).alias(c) for c in rows.columns]
        out[name] = marked.select(*columns)
    return out


def retained(rows: DataFrame, created: str, now: str, months: int) -> DataFrame:
    """Rows not older than so many months; on a table partitioned by month only partitions are dropped."""
    return rows.where(F.col(created) >= F.add_months(F.lit(now).cast("date"), -months))


def write_months(rows: DataFrame, path: str, at: str) -> None:
    """Rows into a table with a folder for each month of `at` (column `month`, 'none' without a time); months that the rows touch are replaced, others stay."""
    month = F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("none"))
    rows.withColumn("month", month).repartition("month").write.partitionBy("month").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def drop_old_months(spark: SparkSession, path: str, at: str, now: str, months: int) -> tuple[list[str], list[str]]:
    """Retention on a table of write_months: folders of months wholly before the limit go as they are, the month that the limit cuts is rewritten without
    its older rows, no other file is read or touched.  Gives the months dropped and rewritten; rows without a time stay, as do those of the limit itself."""
    limit = spark.range(1).select(F.add_months(F.lit(now).cast("date"), -months).cast("string")).first()[0]
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = sorted(s.getPath().getName().removeprefix("month=") for s in files.listStatus(folder) if s.getPath().getName().startswith("month="))
    old, cut = [m for m in found if m < limit[:7]], [m for m in found if m == limit[:7]]
    for m in old:
        files.delete(jvm.org.apache.hadoop.fs.Path(folder, f"month={m}"), True)
    for m in cut:
        held = spark.read.parquet(f"{path.rstrip('/')}/month={m}")
        rest = written(held.where(F.col(at) >= F.lit(limit).cast("date")), "month")
        if rest.isEmpty():
            files.delete(jvm.org.apache.hadoop.fs.Path(folder, f"month={m}"), True)
        else:
            write_months(rest, path, at)
    return old, cut


def catalog_diff(seen: DataFrame, known: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """(key, change): new ones seen but neither known nor recorded, missing ones known but not seen."""
    new = seen.select(key).distinct().join(known.select(key), key, "left_anti").join(recorded.select(key), key, "left_anti").withColumn("change", F.lit("new"))
    return new.unionByName(known.select(key).distinct().join(seen.select(key), key, "left_anti").withColumn("change", F.lit("missing")))


def changed(rows: DataFrame, previous: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows that are new or whose columns differ from the previous signature (key, signature)."""
    signed = rows.withColumn("signature", F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))
    old = previous.select(F.col(key).alias("__k"), F.col("signature").alias("__s"))
    return signed.join(old, (F.col(key) == F.col("__k")) & (F.col("signature") == F.col("__s")), "left_anti")


def missing_twice(walks: DataFrame, key: str, walk: str) -> DataFrame:
    """Keys absent from the two latest walks but in an earlier one."""
    last = walks.agg(F.max(walk).alias("__last"))
    recent = walks.join(F.broadcast(last), F.col(walk) > F.col("__last") - 2).select(key)  # one row
    return walks.select(key).distinct().join(recent, key, "left_anti")


def replace_version(df: DataFrame, path: str) -> str:
    """Writes a new version beside the old ones and returns its folder; readers move on when they take the new name."""
    version = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    return version


def _latest(spark: SparkSession, path: str) -> int:
    """The number of the last complete manifest of a group of tables, 0 without one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/manifests")
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(folder):
        return 0
    done = lambda place: files.exists(spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS"))
    return max([int(s.getPath().getName()) for s in files.listStatus(folder) if done(s.getPath())], default=0)


def replace_together(tables: dict[str, DataFrame], path: str) -> int:
    """New versions of several tables at once; gives the number of the state that they make.

    All versions are written before the manifest that names them, so readers see all of them or, if a write fails, none.  Tables that are not given keep their
    versions.  Of two writers that began from one state the second fails at its manifest and can be repeated; plans made from the old state stay valid."""
    spark = next(iter(tables.values())).sparkSession
    number = _latest(spark, path)
    held = {r["name"]: r["folder"] for r in spark.read.schema("name string, folder string").json(f"{path.rstrip('/')}/manifests/{number:010d}").collect()} if number else {}
    held |= {name: replace_version(df, f"{path.rstrip('/')}/{name}") for name, df in tables.items()}
    spark.createDataFrame(sorted(held.items()), "name string, folder string").coalesce(1).write.json(f"{path.rstrip('/')}/manifests/{number + 1:010d}")
    return number + 1


def current(spark: SparkSession, path: str, name: str, number: int | None = None) -> DataFrame:
    """A table as the last state of replace_together has it, or that of a number."""
    number = number or _latest(spark, path)
    held = spark.read.schema("name string, folder string").json(f"{path.rstrip('/')}/manifests/{number:010d}")
    return spark.read.parquet(held.where(F.col("name") == name).first()["folder"])


def replaced_members(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """Membership rows with the groups that `new` names replaced as a whole by its distinct rows; other groups stay.  A group is emptied by a row of
    nulls but for its key."""
    fresh = new.select(*old.columns).distinct()
    others = [F.col(c).isNotNull() for c in old.columns if c != group]
    kept = others[0]
    for c in others[1:]:
        kept = kept & c
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(fresh.where(kept))


def append_rows(df: DataFrame, path: str) -> None:
    """Adds rows to a log table; readers see all of an append or none of it."""
    df.write.mode("append").parquet(path)

"""Coverage reports, link pivots and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import percent


def pivot_links(links: DataFrame, by: str, kinds: list[str], kind: str, value: str, order: str) -> DataFrame:
    """One row per item and one column per kind with the latest value: a single aggregation instead of a join for each kind."""
    picks = [F.max_by(F.when(F.col(kind) == k, F.col(value)), F.when(F.col(kind) == k, F.col(order))).alias(k) for k in kinds]
    return links.groupBy(by).agg(*picks)


def field_coverage(items: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, n, total, pct): all counts in one pass, then unpivoted."""
    one = items.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f) for f, c in fields.items()])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields])
    return one.select("total", F.inline(rows)).select("field", "n", "total", percent(F.col("n"), F.col("total")).alias("pct"))


def conditional_totals(items: DataFrame, totals: dict[str, Column]) -> DataFrame:
    return items.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in totals.items()])


def status_matrix(records: DataFrame, by: str, status: str, statuses: list[str]) -> DataFrame:
    """Counts by source with a column for each status, 0 where there are none."""
    return records.groupBy(by).agg(*[F.count_if(F.col(status) == s).alias(s) for s in statuses], F.count("*").alias("total"))


def covered(links: DataFrame, items: DataFrame, by: str, key: str) -> DataFrame:
    """Distinct items that each source covers (exact)."""
    return links.join(items.select(key), key, "left_semi").groupBy(by).agg(F.count_distinct(key).alias("covered"))


def remaining(items: DataFrame, records: DataFrame, key: str, by: str, at: str, limit: Column) -> DataFrame:
    """By source: items never fetched or fetched before the limit."""
    newest = records.groupBy(key).agg(F.max(at).alias("__at"))
    return items.join(newest, key, "left").groupBy(by).agg(F.count_if(F.col("__at").isNull() | (F.col("__at") < limit)).alias("remaining"))


def id_range(items: DataFrame, id_col: str, offset: int = 0) -> DataFrame:
    """One row (low, high, total): bounds of the ids, and the rows with `offset` counted before."""
    return items.agg(F.min(id_col).alias("low"), F.max(id_col).alias("high"), (F.count("*") + offset).alias("total"))


def counted_list(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The wanted rows with `n`, how many rows have their key; 0 where there are none."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return wanted.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def grouped_values(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, held, joined): the distinct values of each group in order, as an array and joined by ', '.  For columns of few values."""
    held = rows.groupBy(by).agg(F.array_sort(F.collect_set(value)).alias("held"))
    return held.withColumn("joined", F.array_join("held", ", "))


def members(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, value: str) -> DataFrame:
    """The parents with `members`, the sorted values of their children; an empty array where there are none."""
    grouped = children.groupBy(F.col(child_key).alias("__key")).agg(F.array_sort(F.collect_list(value)).alias("members"))
    joined = parents.join(grouped, F.col(parent_key) == F.col("__key"), "left").drop("__key")
    return joined.withColumn("members", F.coalesce("members", F.array().cast(grouped.schema["members"].dataType)))


def percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, ...): exact percentiles between neighbours in proportion, one column for each name in shares."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *[F.percentile(value, share).alias(name) for name, share in shares.items()])


def parsed_json(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """The rows with `parsed` (fields of the schema; nulls where the text is no JSON) and `keys` (names at the top; null for what is no object)."""
    return rows.withColumn("parsed", F.from_json(column, schema)).withColumn("keys", F.json_object_keys(column))


def write_json(df: DataFrame, path: str, *, gzip: bool = False) -> None:
    """One object a line with all keys, nulls too; the commit protocol makes the folder appear whole."""
    writer = df.write.option("ignoreNullFields", "false")
    (writer.option("compression", "gzip") if gzip else writer).json(path)


def write_names(df: DataFrame, path: str, name: str = "name") -> None:
    """Names only, one a line, without header or quotes."""
    df.select(F.col(name).cast("string").alias("value")).write.text(path)


def markdown_table(rows: list, columns: list[str]) -> str:
    """A report's table from a few collected rows."""
    cells = [[f"{v:,}" if isinstance(v, int) else "" if v is None else str(v) for v in (r[c] for c in columns)] for r in rows]
    lines = [columns, ["---"] * len(columns), *cells]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def counters(rows: DataFrame, by: str, totals: dict[str, Column]) -> DataFrame:
    """One row for each source with how many of its rows meet each condition: the counters of a run."""
    return rows.groupBy(by).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in totals.items()])


def source_status(sources: DataFrame, statuses: DataFrame, covered_items: DataFrame, states: DataFrame, by: str = "source") -> DataFrame:
    """The fixed list of sources in its order with counts by status, covered items and state; counts are 0, flags false and times null where there are none."""
    out = sources.join(statuses, by, "left").join(covered_items, by, "left").join(states, by, "left")
    zero = {c: 0 for d in (statuses, covered_items) for c in d.columns if c != by}
    return out.fillna(zero).fillna({c: False for c, kind in states.dtypes if kind == "boolean"})

"""Cutting lineage through the shared checkpoint folder, slices of batches for Python stages, and column names that nobody uses."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_ROWS = 1000
SLICE_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's own checkpoint folder.

    Only on a local master, where driver and executors are one process, a folder is made where neither is set; elsewhere that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """The same rows, written to a Parquet table in the shared folder and read back, so that a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes the files of tables that `settled` gave and that nothing reads any more: what was made of them has been written itself."""
    for df in tables:
        if path := getattr(df, "settled_at", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def sliced(batches: Iterable[pa.RecordBatch], column: str, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and, but for single longer values, `size` bytes of a text or binary column.

    Spark bounds a batch by spark.sql.execution.arrow.maxBytesPerBatch; these slices bound what a worker holds as Python objects.
    """
    for batch in batches:
        ends = pc.cumulative_sum(pc.cast(pc.fill_null(pc.binary_length(batch.column(column)), 0), pa.int64())).to_numpy()
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = int(min(at + rows, max(at + 1, ends.searchsorted(before + size, side="right"))))
            yield batch.slice(at, end - at)
            at = end


def spare(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores after those that the columns (in any case) hold already."""
    held, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def row_key(docs: DataFrame, seed: int) -> Column:
    """A seeded hash of all columns (maps as JSON)."""
    return F.xxhash64(F.lit(seed), *[F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields])

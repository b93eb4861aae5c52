"""Best-fit-decreasing packing of token sequences, planned on the histogram of lengths and carried out by ranks."""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.lineage import settled, sliced
from tessera.llm.tokens import END_ID, encoder, vocabulary_path

CAPACITY = 4096
BUCKET_ROWS = 1000
LARGEST_ID = 65_535  # packed ids and positions are unsigned 16-bit numbers


class CapacityTree:
    """Segment tree over the remaining capacities 0..capacity: finds the tightest open bin in logarithmic time."""

    def __init__(self, capacity: int):
        self.base = 1
        while self.base <= capacity:
            self.base *= 2
        self.open = [0] * (2 * self.base)

    def add(self, remaining: int, change: int) -> None:
        node = self.base + remaining
        while node:
            self.open[node] += change
            node //= 2

    def tightest(self, need: int) -> int | None:
        """Smallest remaining capacity of at least `need` that has an open bin."""
        node = self.base + need
        if self.open[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.base:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.base
            node //= 2
        return None


@dataclass(frozen=True)
class Plan:
    """Runs by length: items first_rank.. of a length go to consecutive bins from first_bin, per_bin each, the first at first_offset."""

    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    bins: int

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for length in np.unique(lengths):
            at = lengths == length
            first, bin0, per, offset = self.runs[int(length)]
            run = np.searchsorted(first, ranks[at], side="right") - 1
            step = ranks[at] - first[run]
            bins[at] = bin0[run] + step // per[run]
            offsets[at] = offset[run] + step % per[run] * length
        return bins, offsets


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> Plan:
    """Exactly the bins of best-fit decreasing, from the number of items of each length (1..capacity).

    Items of one length are interchangeable, and the tightest bin stays the tightest while it takes items of the same length; so a whole run of
    equal bins is filled in one step.  The state is at most a few runs for each length, whatever the number of items.
    """
    tree, free = CapacityTree(capacity), defaultdict(deque)

    def put(remaining: int, run: tuple[int, int], front: bool = False) -> None:
        (free[remaining].appendleft if front else free[remaining].append)(run)
        tree.add(remaining, 1)

    bins, runs = 0, defaultdict(list)
    for length in sorted(histogram, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        left, rank = histogram[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                new = -(-left // (capacity // length))
                put(capacity, (bins, new))
                bins, remaining = bins + new, capacity
            first, count = free[remaining].popleft()
            tree.add(remaining, -1)
            per = remaining // length
            take = min(left, count * per)
            full, part = divmod(take, per)
            runs[length].append((rank, first, per, capacity - remaining))
            if full:
                put(remaining - per * length, (first, full))
            if part:
                put(remaining - part * length, (first + full, 1))
            used = full + bool(part)
            if used < count:
                put(remaining, (first + used, count - used), front=True)
            left, rank = left - take, rank + take
    return Plan({k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in runs.items()}, bins)


def _cutter(path: str, capacity: int, end_id: int | None, keep_ids: bool):
    def run(batches):
        words = encoder(path)
        for batch in sliced(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, code in enumerate(words.encode(texts)):
                code += end
                for at in range(0, len(code), 4 * capacity):
                    part = code[at : at + 4 * capacity]
                    rows.append(row)
                    piece.append(at // (4 * capacity))
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        wide = np.frombuffer(part, "<u4")
                        if wide.max() > LARGEST_ID:
                            raise ValueError(f"id {wide.max()} does not fit 16 bits")
                        ids.append(wide.astype("<u2").tobytes())
            columns = [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int | None = END_ID, keep_ids: bool = False, path: str | None = None) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids]) of all texts: only texts of more than `capacity` ids are cut, into full pieces and a rest.

    ids: little-endian unsigned 16-bit.  With end_id None a text without ids has no piece.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    fields = [source.schema["id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    return source.mapInArrow(_cutter(path or vocabulary_path(), capacity, end_id, keep_ids), T.StructType(fields))


def _placer(plan: Plan, wanted: list[str]):
    def run(batches):
        for batch in batches:
            bins, offsets = plan.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            kept = [batch.column(c) for c in wanted]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bins), pa.array(offsets)], names=[*wanted, "sequence_id", "offset"])

    return run


def placed(cut: DataFrame, capacity: int) -> DataFrame:
    """The pieces with sequence_id and offset by best-fit decreasing over all of them; `cut` is settled (read twice).

    The driver sees one count for each length, at most `capacity` numbers.  A piece's rank among those of its length is its place in a hash bucket of
    about BUCKET_ROWS of them plus the size of the buckets before, so that no task sorts a whole length.
    """
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit_decreasing(histogram, capacity)
    names = cut.columns
    buckets = max(1, max(histogram.values(), default=0) // BUCKET_ROWS)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("turn", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("turn") + F.col("before") - 1)
    schema = T.StructType([cut.schema[c] for c in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*names, F.col("rank").cast("bigint").alias("rank")).mapInArrow(_placer(plan, names), schema)


def best_fit_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end_id: int | None = END_ID, path: str | None = None) -> DataFrame:
    """Packs all texts into sequences of at most `capacity` ids: one row per piece with its sequence and place.

    Null text counts as empty (its only id is end_id).  Ids of rows may be null or repeated: each row is a document of its own.  Equal lengths are
    told apart by hash, id and piece.  Other columns are ignored; an empty table gives an empty result.
    """
    cut = settled(pieces(docs, id_col, text_col, capacity, end_id, path=path), "pieces")
    return placed(cut, capacity).withColumnRenamed("id", id_col)


def _assembler(capacity: int, pad_id: int):
    def run(batches):
        ramp = np.arange(capacity, dtype="<u2").tobytes()
        pad, zeros = np.full(capacity, pad_id, "<u2").tobytes(), bytes(2 * capacity)
        held: list = []
        out: list[list] = [[] for _ in range(7)]
        kind = None

        def flush():
            ids, ends = b"".join([x[4] for x in held]), [0]
            for x in held:
                ends.append(ends[-1] + x[3])
            rest = 2 * capacity - len(ids)
            places = b"".join([ramp[: 2 * x[3]] for x in held])
            for column, value in zip(out, (held[0][0], ends[-1], ids + pad[:rest], ends, places + zeros[:rest], [x[1] for x in held], [x[2] for x in held])):
                column.append(value)
            held.clear()

        def batch_out():
            schema = _matrix_arrow(kind)
            whole = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
            for column in out:
                column.clear()
            return whole

        for batch in batches:
            kind = batch.schema.field("id").type
            for row in zip(*[batch.column(c).to_pylist() for c in ("sequence_id", "id", "piece", "length", "ids")]):
                if held and held[0][0] != row[0]:
                    flush()
                held.append(row)
            if len(out[0]) >= 256:
                yield batch_out()
        if held:
            flush()
        if out[0]:
            yield batch_out()

    return run


def _matrix_arrow(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("input_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("doc_ids", pa.list_(kind)), ("pieces", pa.list_(pa.int32()))])


def packed_matrices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 2048, end_id: int | None = END_ID, pad_id: int = 0, path: str | None = None) -> DataFrame:
    """One row per packed sequence: input_ids and position_ids (capacity little-endian unsigned 16-bit numbers each, padded with pad_id and 0),
    cu_seqlens (0 and the end of each segment), doc_ids and pieces of the segments, n_tokens.  Positions restart at 0 in each segment.

    Texts of more than `capacity` ids are cut without loss.  Nulls, repeats and empty tables: as best_fit_pack.  ValueError if an id, the padding or a
    position does not fit 16 bits.
    """
    if not 1 <= capacity <= LARGEST_ID + 1 or not 0 <= pad_id <= LARGEST_ID:
        raise ValueError(f"capacity {capacity} or padding {pad_id} does not fit 16 bits")
    cut = settled(pieces(docs, id_col, text_col, capacity, end_id, keep_ids=True, path=path).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    places = placed(cut.drop("ids", "start"), capacity).select("uid", "sequence_id", "offset")  # ids stay out of the ranking
    laid = cut.join(places, "uid").select("sequence_id", "offset", "id", "piece", "length", "ids")
    laid = laid.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    schema = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("input_ids", T.BinaryType()), T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())), T.StructField("position_ids", T.BinaryType()), T.StructField("doc_ids", T.ArrayType(cut.schema["id"].dataType)), T.StructField("pieces", T.ArrayType(T.IntegerType()))])
    return laid.mapInArrow(_assembler(capacity, pad_id), schema)


def matrix(rows: list, capacity: int) -> np.ndarray:
    """Collected input_ids (or position_ids) as one numpy matrix."""
    return np.frombuffer(b"".join(rows), "<u2").reshape(-1, capacity)

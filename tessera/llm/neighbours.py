"""Approximate nearest neighbours: NN-descent builds a graph by Spark joins, queries search it greedily."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.lineage import discard, settled

DEGREE = 32
SETTLED_SHARE = 0.001
CELLS_EACH = 3
CELL_ROWS = 256
MAX_PIVOTS = 1024
SPLIT = 16
_AT_ONCE = 1 << 21


def beam_width(rows: int, degree: int = DEGREE) -> int:
    """The rule of the beam: six times the degree up to 2^16 rows, and once the degree more each time the rows double beyond."""
    return degree * max(6, (max(rows, 1) - 1).bit_length() - 10)


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, of finite components, not zero."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def scaled(v: Column) -> Column:
    """struct<v, norm>: the vector over its largest component, so that no square overflows or vanishes, and the length of that; once for a vector."""
    most = F.array_max(F.transform(v, F.abs))
    unit = F.get(F.transform(F.array(most), lambda m: F.transform(v, lambda x: x / m)), F.lit(0))
    return F.get(F.transform(F.array(unit), lambda u: F.struct(u.alias("v"), F.sqrt(_dot(u, u)).alias("norm"))), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision of two `scaled` vectors."""
    return _dot(a["v"], b["v"]) / (a["norm"] * b["norm"])


def _codes(batches):
    """8-bit codes of the vectors, by which the graph is built; results are scored on the vectors themselves."""
    for batch in batches:
        column = batch.column("v")
        out = []
        for v in column.to_pylist():
            x = np.asarray(v, float)
            out.append(np.rint(x / np.abs(x).max() * 127).astype(np.int8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], names=["node", "code"])


def _matrix(codes: pa.Array) -> np.ndarray:
    """A column of codes of one length as a matrix, without a Python object for each."""
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    if not len(codes):
        return np.empty((0, 0), np.int8)
    large = np.int64 if pa.types.is_large_binary(codes.type) else np.int32
    ends = np.frombuffer(codes.buffers()[1], large)[codes.offset : codes.offset + len(codes) + 1]
    return np.frombuffer(codes.buffers()[2], np.int8)[ends[0] : ends[-1]].reshape(len(codes), -1)


def _norms(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.float64)
    return np.maximum(np.sqrt((x * x).sum(-1)), 1e-9)


def _similar(dots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines from dot products and norms.  Products of codes are summed exactly, so a pair has the same value wherever it is met, either way round."""
    return (dots.astype(np.float64) / (a * b)).astype(np.float32)


def _number(width: int) -> type:
    """The float type that holds sums of `width` products of codes exactly."""
    return np.float32 if width * 127 * 127 < 1 << 24 else np.float64


def _unit(codes) -> np.ndarray:
    x = np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _cells(pivots: np.ndarray, each: int):
    def run(batches):
        for batch in batches:
            sims = _unit(batch.column("code").to_pylist()) @ pivots.T
            best = np.argsort(-sims, axis=1, kind="stable")[:, :each]
            rows = np.repeat(np.arange(len(best)), best.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(rows)), batch.column("code").take(pa.array(rows)), pa.array(best.reshape(-1), pa.int32())], names=["node", "code", "cell"])

    return run


def _nearest_pivot(batches):
    """The cell's pivot (their codes are in `pivots`, equally many in each row) that is nearest to each row."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            x = _unit(part.column("code").to_pylist())
            pivots = _unit([p for row in part.column("pivots").to_pylist() for p in row]).reshape(len(x), -1, x.shape[1])
            best = np.einsum("ij,ikj->ik", x, pivots).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("code"), part.column("cell"), pa.array(best, pa.int32())], names=["node", "code", "cell", "sub"])


def _split_cells(placed: DataFrame, seed: int) -> DataFrame:
    """Rows (node, code, cell) with every cell of more than 2 * CELL_ROWS rows split by SPLIT pivots of its own, level by level.

    It ends when no cell is larger, or when pivots part the large ones no further (codes that are all alike).
    """
    done, level = None, 0
    while True:
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
        large = settled(sizes.where(F.col("n") > 2 * CELL_ROWS), "large")
        small = placed.join(large, "cell", "left_anti")
        done = small if done is None else done.unionByName(small)
        before = large.agg(F.max("n")).first()[0]
        if before is None:
            return done
        rows = placed.join(large.select("cell"), "cell", "left_semi")
        order = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed + level), "node"), "node")
        pivots = rows.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= SPLIT).groupBy("cell").agg(F.collect_list("code").alias("pivots"))
        parted = rows.join(pivots, "cell").select("node", "code", "cell", "pivots").mapInArrow(_nearest_pivot, "node bigint, code binary, cell bigint, sub int")
        placed = settled(parted.select("node", "code", F.xxhash64("cell", "sub").alias("cell")), "cells")
        level += 1
        after = placed.groupBy("cell").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if after == before:
            return done.unionByName(placed)


def _within(most: int):
    """From groups of (node, code, low, new): for each member its `most` best others above its bound `low`, of pairs with a new member.

    Groups of like size are measured together, padded to the largest of them."""

    def measured(codes, node, low, new, at):
        held = at >= 0
        x = codes[at].astype(_number(codes.shape[1]))
        norm = _norms(codes[at])
        sims = _similar(x @ x.transpose(0, 2, 1), norm[:, :, None], norm[:, None, :])
        fresh = new[at] & held
        sims[~(held[:, :, None] & held[:, None, :] & (fresh[:, :, None] | fresh[:, None, :]))] = -3
        same = node[at][:, :, None] == node[at][:, None, :]
        sims[same] = -3
        m = min(most, at.shape[1])
        best = np.argpartition(-sims, m - 1, axis=2)[:, :, :m]
        value = np.take_along_axis(sims, best, axis=2)
        g, r, c = np.nonzero(value > low[at][:, :, None])
        return node[at[g, r]], node[at[g, best[g, r, c]]], value[g, r, c]

    def run(batches):
        for batch in batches:
            groups = batch.column("members")
            members, sizes = groups.flatten(), np.diff(groups.offsets.to_numpy())
            node, low = members.field("node").to_numpy(), members.field("low").to_numpy()
            new, codes = members.field("new").to_numpy(zero_copy_only=False), _matrix(members.field("code"))
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            order = np.argsort(sizes, kind="stable")
            order = order[sizes[order] > 1]
            first = 0
            while first < len(order):
                last = first + 1
                while last < len(order) and (last + 1 - first) * int(sizes[order[last]]) ** 2 <= _AT_ONCE:
                    last += 1
                chosen = order[first:last]
                ramp = np.arange(sizes[chosen].max())
                at = np.where(ramp < sizes[chosen, None], starts[chosen, None] + ramp, -1)
                a, b, sim = measured(codes, node, low, new, at)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sim)], names=["node", "other", "sim"])
                first = last

    return run


_EDGE = "node bigint, other bigint, sim float"


def _edges(graph: DataFrame) -> DataFrame:
    return graph.select("node", F.explode("edges").alias("e")).select("node", "e.other", "e.sim", "e.new")


def _top(edges: DataFrame, by: str, degree: int, then: str) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col("sim").desc(), then)
    return edges.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= degree).drop("__rank")


def _merged(edges: DataFrame, degree: int) -> DataFrame:
    """Rows (node, low, edges): of edges (node, other, sim, new) each node's `degree` best; `low` is its bound for better ones, -2 while it has fewer.

    An edge that is met again has the same sim, so dense ranks count it once; all is done in one exchange by node, which Spark cuts to the best
    before it shuffles.
    """
    order = Window.partitionBy("node").orderBy(F.col("sim").desc(), "other")
    best = edges.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= degree).groupBy("node", "other").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    low = F.when(F.count("*") >= degree, F.min("sim")).otherwise(F.lit(-2.0)).cast("float")
    return settled(best.groupBy("node").agg(low.alias("low"), F.collect_list(F.struct("other", "sim", "new")).alias("edges")), "graph")


def build_graph(nodes: DataFrame, *, degree: int = DEGREE, rounds: int | None = None, seed: int = 7) -> DataFrame:
    """Edges (node, other, sim) to about the `degree` nearest others of each node; nodes: (node, code), settled.

    The first graph joins nodes that share one of their nearest pivots (at most MAX_PIVOTS sampled nodes); large cells are split by pivots of
    their own, level by level, so cells keep their size however many rows there are.
    Each round then compares, around every node, its neighbours and up to `degree` of those it is a neighbour of with each other, and keeps what is
    nearer than a node's furthest neighbour so far; only pairs with a new edge are compared.  Rounds go on until at most SETTLED_SHARE
    of the edges are new (or for `rounds`, if given).  Nodes are distinct and not null, codes of one length; ties go to smaller nodes; nodes with equal codes are
    neighbours like any; one node has no edges, an empty table gives none.  Other columns are ignored.
    """
    n = nodes.count()
    count = int(min(MAX_PIVOTS, max(1, n // (CELL_ROWS // 2))))
    chosen = [r["code"] for r in nodes.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(count).select("code").collect()]
    if not chosen:
        return nodes.sparkSession.createDataFrame([], _EDGE)
    placed = settled(nodes.mapInArrow(_cells(_unit(chosen), min(CELLS_EACH, count)), "node bigint, code binary, cell int").withColumn("cell", F.col("cell").cast("bigint")), "cells")
    placed = settled(_split_cells(placed, seed), "cells")
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / (2 * CELL_ROWS)).alias("parts"))  # above 1 only for cells of like codes
    placed = placed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "cell", "node"), F.col("parts")))
    member = F.struct("node", "code", F.lit(-2.0).cast("float").alias("low"), F.lit(True).alias("new"))
    found = placed.groupBy("cell", "part").agg(F.collect_list(member).alias("members")).select("members").mapInArrow(_within(degree), _EDGE)
    graph, turn = _merged(found.withColumn("new", F.lit(True)), degree), 0
    while rounds is None or turn < rounds:
        edges = _edges(graph)
        ahead = edges.select(F.col("other").alias("u"), F.col("node").alias("v"), "new")
        back = _top(edges, "other", degree, "node").select(F.col("node").alias("u"), F.col("other").alias("v"), "new")
        around = ahead.unionByName(back)
        if turn:
            around = around.join(around.where("new").select("v").distinct(), "v", "left_semi")
        around = around.repartition("u").groupBy("u", "v").agg(F.min("new").alias("new"))
        coded = nodes.join(graph.select("node", "low"), "node", "left").select(F.col("node").alias("u"), "code", F.coalesce("low", F.lit(-2.0)).cast("float").alias("low"))
        groups = around.join(coded, "u").groupBy("v").agg(F.collect_list(F.struct(F.col("u").alias("node"), "code", "low", "new")).alias("members"))
        found = groups.select("members").mapInArrow(_within(degree), _EDGE)
        last, graph = graph, _merged(edges.withColumn("new", F.lit(False)).unionByName(found.withColumn("new", F.lit(True))), degree)
        discard(last)
        changed = graph.select(F.size(F.filter("edges", lambda e: e["new"])).alias("n")).agg(F.sum("n")).first()[0] or 0
        turn += 1
        if changed <= SETTLED_SHARE * n * degree:
            break
    return _edges(graph).drop("new")


def _measured(batches):
    for batch in batches:
        a, b = _matrix(batch.column("qcode")), _matrix(batch.column("code"))
        for at in range(0, len(a), 4096):
            part = slice(at, at + 4096)
            x, y = a[part], b[part]
            dots = np.einsum("ij,ij->i", x.astype(_number(x.shape[1])), y.astype(_number(x.shape[1])))
            yield pa.RecordBatch.from_arrays([batch.column("query")[part], batch.column("other")[part], pa.array(_similar(dots, _norms(x), _norms(y)))], names=["query", "other", "sim"])


def search_graph(edges: DataFrame, nodes: DataFrame, queries: DataFrame, *, beam: int | None = None, hops: int | None = None, degree: int = DEGREE) -> DataFrame:
    """Greedy search: from each query's node, step by step to the neighbours (either way) of the `beam` nearest nodes found so far (beam_width of the nodes, if
    not given), until all of these have been expanded (or for `hops` steps, if given).

    queries: (query), distinct nodes that are searched for; gives (query, other, sim), at most `beam` rows for each, ties to smaller nodes.  Queries without
    an edge, or that are no nodes, find nothing; empty tables give an empty result.
    """
    beam = beam or beam_width(nodes.count(), degree)
    back = _top(edges, "other", degree, "node").select(F.col("other").alias("node"), F.col("node").alias("other"))
    both = settled(edges.select("node", "other").unionByName(back).groupBy("node").agg(F.collect_set("other").alias("others")), "both")  # at most 2 * degree each
    wanted = queries.join(nodes, queries["query"] == nodes["node"]).select("query", F.col("code").alias("qcode"))
    held = edges.join(queries, edges["node"] == queries["query"]).select("query", "other", "sim", F.lit(False).alias("done"))
    held = settled(held, "beam")
    coded = nodes.withColumnRenamed("node", "other")
    step = 0
    while (hops is None or step < hops) and not held.where("NOT done").isEmpty():
        step += 1
        fresh = held.where("NOT done").select("query", F.col("other").alias("node")).join(both, "node").select("query", F.explode("others").alias("other")).where("query <> other")
        fresh = fresh.repartition("other").groupBy("other", "query").agg(F.lit(1))
        scored = fresh.join(coded, "other").join(wanted, "query").select("query", "other", "qcode", "code").mapInArrow(_measured, "query bigint, other bigint, sim float")
        everything = held.withColumn("done", F.lit(True)).unionByName(scored.withColumn("done", F.lit(False)))
        order = Window.partitionBy("query").orderBy(F.col("sim").desc(), "other")
        ranked = everything.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= beam)
        last, held = held, settled(ranked.groupBy("query", "other").agg(F.max("sim").alias("sim"), F.max("done").alias("done")), "beam")
        discard(last)
    return held.select("query", "other", "sim")


def nearest(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 5, **options) -> DataFrame:
    """For each query row its `top` nearest other rows found: query_id, rank (from 1), the row's id, score (cosine in double), ties to smaller ids.

    Rows without an id take no part, nor vectors that are null, zero, or hold null or non-finite components, nor those of another length than
    most.  Rows equal in id and vector count once.  Equal vectors are one node of the graph with its top + 1 smallest ids, which is
    all that a query can need of them.  With at most `top` candidates all are returned.  An empty table gives an empty result.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).alias("id"), v.alias("v"), is_query.alias("asked"))
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.col("count").desc(), "w").first()
    rows = rows.where(F.size("v") == (width["w"] if width else 0))
    order = Window.partitionBy("v").orderBy("id")
    few = rows.select("id", "v").withColumn("__rank", F.dense_rank().over(order)).where(F.col("__rank") <= top + 1).select("id", "v").distinct()
    groups = few.groupBy("v").agg(F.min("id").alias("node"), F.array_sort(F.collect_list("id")).alias("ids"))
    # one id with several vectors would name two nodes: nodes are numbered by the hash of id and vector
    groups = settled(groups.select(F.xxhash64("node", "v").alias("node"), "v", "ids", scaled(F.col("v")).alias("unit")), "vectors")
    nodes = settled(groups.select("node", "v").mapInArrow(_codes, "node bigint, code binary"), "codes")
    asked = settled(rows.where("asked").select("id", "v").distinct().join(groups.select("v", "node"), "v").select(F.col("id").alias("query_id"), F.col("node").alias("query")), "asked")
    wanted = asked.select("query").distinct()
    degree = options.pop("degree", DEGREE)
    edges = build_graph(nodes, degree=degree, rounds=options.pop("rounds", None))
    found = search_graph(edges, nodes, wanted, degree=degree, **options).select("query", "other")
    found = found.unionByName(wanted.select("query", F.col("query").alias("other")))
    mine, theirs = groups.select(F.col("node").alias("query"), F.col("unit").alias("a")), groups.select(F.col("node").alias("other"), F.col("unit").alias("b"), "ids")
    scored = found.join(mine, "query").join(theirs, "other").select("query", "ids", cosine(F.col("a"), F.col("b")).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec")
    pairs = asked.join(scored, "query").select("query_id", "score", F.explode("ids").alias("vec")).where("query_id <> vec")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec").alias(id_col), "score")

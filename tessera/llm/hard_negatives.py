"""Hard negatives by inner product: a table of pivot distances brackets scores, what it leaves open is measured exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.lineage import settled

PIVOTS = 16
ROW_BLOCK = 1024
ANCHOR_BLOCK = 128
SEED_BLOCKS = 4
SHELVES = 64
SCALE = 256
SIMILAR, OTHER = "same label", "another label"
_FOUND = "anchor bigint, positive bigint, node bigint, score bigint"


def whole_numbers(vector: Column) -> Column:
    """floor(256 * x) of each component as bigint; null where the vector is null or empty, holds a null or a component that is not finite, or is longer
    than 2^29 in this scale (so that no inner product, nor ten times one, leaves the range of bigint)."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**21))
    whole = F.when(fine & (F.size(v) > 0), F.transform(v, lambda x: F.floor(x * SCALE)))
    return F.when(_square(whole) <= 2.0**58, whole)


def _square(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _placed(pivots: np.ndarray, cells: int, most: float):
    """Adds to rows (node, vec, label, v, asked) their distances to the pivots.  In the augmented space a row has one component more, sqrt(most - |v|^2),
    and an anchor 0 there: |q - x|^2 = |q|^2 + most - 2 (q, x), so that near rows are those of high inner product.  `far` are the distances of the
    row, `near` of the row as an anchor; `cell` is the nearest of the first pivots."""

    def run(batches):
        norms_p = (pivots * pivots).sum(axis=1)
        tails = np.sqrt(np.maximum(most - norms_p, 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            norms, inner = (x * x).sum(axis=1), x @ pivots.T
            far = np.sqrt(np.maximum(2 * (most - inner - np.sqrt(np.maximum(most - norms, 0))[:, None] * tails), 0))
            near = np.sqrt(np.maximum(norms[:, None] + most - 2 * inner, 0))
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(pivots))
            lists = [pa.ListArray.from_arrays(ends, pa.array(m.reshape(-1))) for m in (far, near)]
            names = ["node", "vec", "label", "v", "asked"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(norms), *lists, pa.array(far[:, :cells].argmin(axis=1), pa.int32())], names=[*names, "norm", "far", "near", "cell"])

    return run


def _bracket(near: np.ndarray, far: np.ndarray, norms: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of anchors and rows: no distance is under the largest difference or over the smallest sum of two distances to one
    pivot.  Widened by what rounding can take."""
    low, high = np.zeros((len(near), len(far))), np.full((len(near), len(far)), np.inf)
    for p in range(near.shape[1]):
        a, b = near[:, p, None], far[None, :, p]
        np.maximum(low, np.abs(a - b), out=low)
        np.minimum(high, a + b, out=high)
    whole = norms[:, None] + most
    slack = 1e-6 * whole + 1
    return (whole - high * high) / 2 - slack, (whole - low * low) / 2 + slack


def _exact(anchors: np.ndarray, rows: np.ndarray, survivors: np.ndarray) -> np.ndarray:
    """Inner products of the surviving pairs, 0 elsewhere; in floats where all sums are exact in them, else in 64-bit integers."""
    largest = float(np.abs(anchors).max()) * float(np.abs(rows).max()) * anchors.shape[1]
    kind = np.float64 if largest < 1 << 53 else np.int64
    a, b = anchors.astype(kind), rows.astype(kind)
    if survivors.mean() > 0.1:
        return np.where(survivors, a @ b.T, 0).astype(np.int64)
    out = np.zeros(survivors.shape, dtype=np.int64)
    i, j = np.nonzero(survivors)
    for at in range(0, len(i), 1 << 14):
        part = slice(at, at + (1 << 14))
        out[i[part], j[part]] = (a[i[part]] * b[j[part]]).sum(axis=1)
    return out


def _best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` highest allowed scores, ties to smaller ids."""
    at = np.flatnonzero(allowed)
    if len(at) > top:
        at = at[scores[at] >= np.partition(scores[at], len(at) - top)[len(at) - top]]
    return at[np.lexsort((ids[at], -scores[at]))[:top]]


def _scanner(kind: str, top: int, most: float, low: tuple[int, int], high: tuple[int, int]):
    """From an anchor block and a row block, for each window (positive, score, bound) of an anchor the `top` rows of the kind whose scores are not under
    the bound, and for OTHER lie within the fractions low and high of the window's score.  Only pairs whose bracket meets a window are measured."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                q, r = (batch.column(c)[at].values for c in ("anchors", "rows"))
                a, b = _matrix(q.field("v"), np.int64), _matrix(r.field("v"), np.int64)
                below, above = _bracket(_matrix(q.field("near")), _matrix(r.field("far")), q.field("norm").to_numpy(), most)
                fits = q.field("label").to_numpy()[:, None] == r.field("label").to_numpy()[None, :]
                fits = (fits if kind == SIMILAR else ~fits) & (q.field("node").to_numpy()[:, None] != r.field("node").to_numpy()[None, :])
                windows = [(i, w["positive"], w["score"], w["bound"]) for i, held in enumerate(q.field("windows").to_pylist()) for w in held]
                survivors = np.zeros_like(fits)
                for i, _, score, bound in windows:
                    survivors[i] |= (above[i] >= bound) & (below[i] <= (np.inf if kind == SIMILAR else high[0] * score / high[1]))
                survivors &= fits
                if not survivors.any():
                    continue
                scores, node, vec, asker = _exact(a, b, survivors), r.field("node").to_numpy(), r.field("vec").to_numpy(), q.field("node").to_numpy()
                out = []
                for i, positive, score, bound in windows:
                    allowed = survivors[i] & (scores[i] >= bound)
                    if kind == OTHER:
                        allowed &= (low[0] * score <= low[1] * scores[i]) & (high[1] * scores[i] <= high[0] * score)
                    best = _best(scores[i], vec, allowed, top)
                    out.append((np.full(len(best), asker[i]), np.full(len(best), positive), node[best], scores[i][best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=["anchor", "positive", "node", "score"])

    return run


class PivotTable:
    """Rows (node, vec, label, v, asked) in blocks of their label with distances to shared pivots; scans pairs of an anchor block and a row block."""

    def __init__(self, rows: DataFrame, *, pivots: int = PIVOTS, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK):
        most, count = rows.agg(F.max(_square(F.col("v"))), F.count("*")).first()
        self.most = float(most)
        by = F.xxhash64(F.lit(11), "v")
        chosen = [r["v"] for r in rows.select("v").distinct().orderBy(by, "v").limit(pivots).collect()]
        self.pivots = len(chosen)
        cells = min(self.pivots, max(1, count // (8 * row_block)))
        fields = "node bigint, vec bigint, label bigint, v array<bigint>, asked boolean, norm double, far array<double>, near array<double>, cell int"
        table = settled(rows.mapInArrow(_placed(np.array(chosen, dtype=np.float64), cells, self.most), fields), "pivot_table")
        self.ids = table.select("node", "vec")
        sizes = table.groupBy("label", "cell").agg(F.ceil(F.count("*") / row_block).alias("parts"), F.greatest(F.lit(1), F.ceil(F.count_if("asked") / anchor_block)).alias("homes"))
        dealt = table.join(sizes, ["label", "cell"])
        number = lambda parts: F.xxhash64("label", "cell", F.pmod(F.xxhash64(F.lit(3), "node"), F.col(parts)))
        rows_of = dealt.groupBy(number("parts").alias("block"), F.col("label").alias("row_label")).agg(F.collect_list(F.struct("node", "vec", "label", "v", "far")).alias("rows"), *self._ends("far"))
        self.blocks = settled(rows_of.select("block", "row_label", "rows", *self._gathered("far")), "row_blocks")
        self.anchors = settled(dealt.where("asked").select(number("homes").alias("home"), "node", "vec", "label", "v", "norm", "near"), "anchors")

    def _ends(self, name: str) -> list[Column]:
        return [f(F.get(name, F.lit(i))).alias(f"{end}{i}") for i in range(self.pivots) for end, f in (("low", F.min), ("high", F.max))]

    def _gathered(self, name: str) -> list[Column]:
        return [F.array(*[F.col(f"{end}{i}") for i in range(self.pivots)]).alias(f"{name}_{end}") for end in ("low", "high")]

    def _units(self, asked: DataFrame, kind: str, seeds: int | None) -> DataFrame:
        """(home, block) whose blocks' least and largest distances to the pivots leave room for a score above the anchors' bounds; with `seeds` only
        each anchor block's so many with most room.  Anchor blocks meet the summaries of row blocks, not the rows."""
        ends = asked.groupBy("home", "label").agg(F.min("least").alias("bound"), F.max("norm").alias("norm"), *self._ends("near")).select("home", "label", "bound", "norm", *self._gathered("near"))
        summaries = self.blocks.select("block", "row_label", "far_low", "far_high", F.pmod(F.xxhash64("block"), F.lit(SHELVES)).cast("int").alias("shelf"))
        met = ends.withColumn("shelf", F.explode(F.sequence(F.lit(0), F.lit(SHELVES - 1)))).join(summaries, "shelf")
        met = met.where("label = row_label" if kind == SIMILAR else "label <> row_label")
        over = F.zip_with("far_low", "near_high", lambda x, y: x - y), F.zip_with("near_low", "far_high", lambda x, y: x - y)
        apart = F.greatest(F.array_max(over[0]), F.array_max(over[1]), F.lit(0.0))
        whole = F.col("norm") + self.most
        met = met.withColumn("room", (whole - apart * apart) / 2 + whole * 1e-6 + 1).where("room >= bound").select("home", "block", "room")
        if seeds is not None:
            order = Window.partitionBy("home").orderBy(F.col("room").desc(), "block")
            met = met.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= seeds)
        return met.select("home", "block")

    def scan(self, windows: DataFrame, kind: str, top: int, *, seeds: int | None = None, low: tuple[int, int] = (0, 1), high: tuple[int, int] = (1, 1)) -> DataFrame:
        """(anchor, positive, rank, node, vec, score): the best `top` rows for each window (anchor, positive, score, bound)."""
        held = windows.groupBy("anchor").agg(F.collect_list(F.struct("positive", "score", "bound")).alias("windows"), F.min("bound").alias("least"))
        asked = self.anchors.join(held.withColumnRenamed("anchor", "node"), "node")
        units = self._units(asked, kind, seeds)
        anchors = asked.groupBy("home").agg(F.collect_list(F.struct("node", "label", "v", "norm", "near", "windows")).alias("anchors"))
        pairs = units.join(anchors, "home").join(self.blocks.select("block", "rows"), "block").select("anchors", "rows")
        found = pairs.mapInArrow(_scanner(kind, top, self.most, low, high), _FOUND)
        order = Window.partitionBy("anchor", "positive").orderBy(F.col("score").desc(), "vec", "node")
        ranked = found.join(self.ids, "node").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        return settled(ranked.select("anchor", "positive", "rank", "node", "vec", "score"), "found")

    def best(self, windows: DataFrame, kind: str, top: int, **options) -> DataFrame:
        """As scan, in two passes: the blocks with most room raise the bounds to the scores of `top` rows found there, the rest is held against these."""
        first = self.scan(windows, kind, top, seeds=SEED_BLOCKS, **options)
        full = first.groupBy("anchor", "positive").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= top)
        raised = windows.join(full.select("anchor", "positive", "least"), ["anchor", "positive"], "left")
        return self.scan(settled(raised.select("anchor", "positive", "score", F.greatest("bound", "least").alias("bound")), "bounds"), kind, top, **options)


def hard_negatives(vectors: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label: Column | None = None, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (3, 10), high: tuple[int, int] = (9, 10), **options) -> DataFrame:
    """For each anchor and each of its positives the first `negatives` rows of other labels whose scores lie between the fractions `low` and `high` of
    the positive's: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Scores are inner products of whole_numbers(vector); higher ones come first, ties go to smaller ids (then to a hash of the row).  An anchor's positives
    are its first `positives` other rows of its label (`label`: an expression for it instead of the column).  The result is exact: brackets from
    pivot distances only save measuring.  Rows without id or label take no part, nor those whose vector whole_numbers refuses or is of another length than
    most; repeated rows count once.  Of one id with several labels or vectors each row counts.  A negative positive score allows no
    negative, since the bounds cross.  Other columns are ignored; an empty table gives an empty result.
    """
    label = F.col(f"`{label_col}`") if label is None else label
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec"), label.cast("bigint").alias("label"), whole_numbers(F.col(f"`{vector_col}`")).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asked"))
    rows = rows.where("vec IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.col("count").desc(), "w").first()
    if width is None:
        return rows.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    rows = rows.where(F.size("v") == width["w"]).groupBy("vec", "label", "v").agg(F.max("asked").alias("asked"))
    table = PivotTable(settled(rows.withColumn("node", F.xxhash64("vec", "label", "v")).select("node", "vec", "label", "v", "asked"), "rows"), **options)
    least = F.lit(-(2**62))
    open_ = table.anchors.select(F.col("node").alias("anchor"), F.lit(0).cast("bigint").alias("positive"), F.lit(0).cast("bigint").alias("score"), least.alias("bound"))
    near = table.best(open_, SIMILAR, positives)
    windows = near.where("score >= 0").select("anchor", F.col("node").alias("positive"), "score", F.ceil(F.col("score") * low[0] / low[1] - 1).cast("bigint").alias("bound"))
    found = table.best(windows, OTHER, negatives, low=low, high=high)
    named = table.ids.select(F.col("node").alias("anchor"), F.col("vec").alias("anchor_id"))
    pairs = near.select("anchor", F.col("node").alias("positive"), F.col("vec").alias("positive_id"), F.col("score").alias("positive_score")).join(named, "anchor")
    return found.join(pairs, ["anchor", "positive"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

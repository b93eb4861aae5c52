"""Hard negatives against a plain double loop; brackets against true scores; odd inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as hn


def plain(rows, anchors):
    """Rows (id, label, vector), distinct and usable."""
    held = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    out = []
    for i, label, v in held:
        if i not in anchors:
            continue
        scored = [(-sum(x * y for x, y in zip(v, u)), j, other) for j, other, u in held if j != i]
        for minus, j, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fits = sorted(s for s in scored if s[2] != label and 30 * -minus <= 100 * -s[0] <= 90 * -minus)
            out += [(i, j, n + 1, k, -minus, -score) for n, (score, k, _) in enumerate(fits[:10])]
    return sorted(out)


def some_rows(rng, n, labels=4, width=6):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = rng.randrange(labels)
        rows.append((i, label, [c + rng.gauss(0.3, 0.6) for c in centres[label]]))
    return rows


SCHEMA = "vec_id bigint, label int, embedding array<float>, score int, node string"


@pytest.mark.parametrize("options", [{}, {"pivots": 3, "row_block": 16, "anchor_block": 2}])
def test_equals_a_double_loop(spark, options):
    rng = random.Random(11)
    rows = some_rows(rng, 260) + [(1000 + i, i % 2, [1.0, 0.5, 0.25, 0.0, -1.0, 2.0]) for i in range(40)]  # ties, copies
    rows = [(i, label, np.float32(v).tolist()) for i, label, v in rows]
    anchors = {0, 7, 21, 100, 1000, 1001}
    odd = [(None, 1, [1.0] * 6), (2000, None, [1.0] * 6), (2001, 1, None), (2002, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, 1, [float("nan")] * 6), (2004, 1, [float("inf")] * 6), (2005, 1, [1.0]), (2006, 1, []), (2007, 1, [1e30] * 6)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + rows[:5] + odd], SCHEMA)
    got = hn.hard_negatives(df, F.col("vec_id").isin(*anchors, 2000, 2003), **options)
    want = plain(rows, anchors)
    assert len(want) > 100 and sorted(tuple(r) for r in got.collect()) == want


def test_brackets_hold_the_score():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(200, 8)) * 256)
    x[:3] = 0
    pivots, most = x[[5, 9, 0]], float((x * x).sum(axis=1).max())
    norms = (x * x).sum(axis=1)
    tails, tail = np.sqrt(np.maximum(most - (pivots * pivots).sum(axis=1), 0)), np.sqrt(np.maximum(most - norms, 0))
    far = np.sqrt(np.maximum(2 * (most - x @ pivots.T - tail[:, None] * tails), 0))
    near = np.sqrt(np.maximum(norms[:, None] + most - 2 * x @ pivots.T, 0))
    low, high = hn._bracket(near, far, norms, most)
    assert ((low <= x @ x.T) & (x @ x.T <= high)).all() and (high - low).min() < 2 * most


def test_large_components_are_summed_as_integers():
    a = np.array([[2**27 + 1, 2**27 - 1]])
    found = hn._exact(a, a, np.array([[True]]))
    assert int(found[0, 0]) == (2**27 + 1) ** 2 + (2**27 - 1) ** 2


def test_empty_and_single(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 2.0])], "vec_id bigint, label int, embedding array<float>")
    assert hn.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert hn.hard_negatives(df, F.lit(True)).count() == 0
    assert hn.hard_negatives(df.withColumn("embedding", F.lit(None).cast("array<float>")), F.lit(True)).count() == 0
    two = df.unionByName(df.withColumn("vec_id", F.lit(5).cast("bigint"))).unionByName(df.withColumn("vec_id", F.lit(6).cast("bigint")).withColumn("label", F.lit(2)).withColumn("embedding", F.array(F.lit(0.5), F.lit(1.0)).cast("array<float>")))
    assert [tuple(r) for r in hn.hard_negatives(two, F.col("vec_id") == 0).collect()] == [(0, 5, 1, 6, 256 * 256 * 5, 128 * 256 * 5)]

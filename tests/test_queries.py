"""Every query with SQL against DuckDB on the smallest tables, and the entry points."""

import decimal
import importlib
import math
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry_points
from tessera.plans import catalogue, flows, records

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, DATA)
    found = duck.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_other_queries_run(spark, name):
    assert len(catalogue.QUERIES[name](spark, DATA).collect()) > 0


def against_sql(spark, folder, name, **tables):
    """A query's rows and its SQL's on own tables, given as SQL."""
    c = duckdb.connect()
    for t, sql in tables.items():
        c.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = c.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    return sorted(repr(tuple(r[k] for k in columns)) for r in entry_points.queries()[name](spark, str(folder)).collect()), sorted(map(repr, found.fetchall()))


def test_release_cluster_follows_the_orders(spark, tmp_path):
    """Orders that share a key each have a row, line items without an order none."""
    orders = "SELECT CAST(k AS BIGINT) AS o_orderkey, CAST(t AS TIMESTAMP) AS o_orderdate FROM (VALUES (1, '1995-06-01'), (1, '1996-06-01'), (1, '1996-06-01'), (6, '1995-06-01'), (7, '1995-06-01'), (NULL, '1995-01-01')) v(k, t)"
    lines = "SELECT CAST(k AS BIGINT) AS l_orderkey, CAST(t AS TIMESTAMP) AS l_shipdate FROM (VALUES (1, '1995-01-01'), (2, '1995-01-01'), (2, '1995-02-01'), (7, '1990-01-01'), (7, '1994-01-01'), (NULL, '1995-01-01')) v(k, t)"
    got, want = against_sql(spark, tmp_path, "release_cluster", orders=orders, lineitem=lines)
    assert got == want and len(want) == 5


def test_query_bindings_read_every_document(spark, tmp_path):
    """Documents that come from several partitions are landed one a file, so none is read in part."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, want = against_sql(spark, tmp_path, "query_bindings", customer="SELECT range AS c_custkey FROM range(100) UNION ALL SELECT NULL UNION ALL SELECT 5 UNION ALL SELECT -60001")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want and len(want) == 102


def likeness(a, b):
    """similar_text as it is described: the first longest common stretch, then both sides of it."""

    def chars(a, b):
        best, at, met = 0, None, 0
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n > best:
                    best, at, met = n, (i, j), met + 1
        if not best:
            return 0
        (i, j), right = at, (a[at[0] + best :], b[at[1] + best :])
        return best + (chars(a[:i], b[:j]) if met > 1 and i and j else 0) + (chars(*right) if all(right) else 0)

    return chars(a, b) * 200 / (len(a) + len(b))


def test_store_links_equal_brute_force(spark):
    """fuzzy_link_sound has no SQL: candidates by the rarest word that any of them holds, then the decision on titles and years."""
    parts = spark.read.parquet(f"{DATA}/part.parquet").collect()
    targets = {r["p_partkey"]: (f"{r['p_name']} no{r['p_partkey']}", r["p_size"] + 1990) for r in parts}
    held = {k + 1000000: (key + "x" if k % 6 == 0 else key, year + 9 if k % 10 == 0 else year + 1) for k, (key, year) in targets.items() if k % 2 == 0}
    often = {}
    for c, (key, _) in held.items():
        for w in set(key.split(" ")):
            often.setdefault(w, set()).add(c)
    want = set()
    for t, (key, year) in targets.items():
        words = sorted((len(often[w]), w) for w in set(key.split(" ")) if w in often and len(w) >= 3)
        near = often[words[0][1]] if words else []
        exact = [c for c in near if held[c][0] == key]
        best = max(near, key=lambda c: (likeness(key, held[c][0]), -c), default=None)
        close = lambda c: abs(held[c][1] - year) <= 1
        if len(exact) == 1:
            want.add((t, exact[0] if abs(held[exact[0]][1] - year) <= 3 else None, "match" if abs(held[exact[0]][1] - year) <= 3 else "ambiguous", "exact"))
        elif best is not None:
            sure = likeness(key, held[best][0]) >= 95
            want.add((t, best if sure and close(best) else None, ("match" if close(best) else "ambiguous") if sure else "none", "fuzzy"))
    got = {tuple(r) for r in catalogue.QUERIES["fuzzy_link_sound"](spark, DATA).select("p_partkey", "match_id", "decision", "method").collect()}
    assert got == want


def test_entry(spark):
    assert entry_points.entry(spark).count() == 12


def test_no_nested_loops_in_links(spark):
    plan = catalogue.QUERIES["fuzzy_link"](spark, DATA)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = catalogue.QUERIES["facet_filter"](spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(p_size,5)" in plan and "p_container" not in plan


def test_entry_points_without_the_subpackage(monkeypatch):
    """Without tessera.llm and the pipeline the other queries remain."""
    for name in [n for n in sys.modules if n.startswith("tessera.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tessera.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        again = importlib.reload(entry_points)
        assert set(again.queries()) == set(catalogue.QUERIES) | set(records.QUERIES) | set(flows.QUERIES) and set(again.oracle_sql()) == set(catalogue.ORACLES) | set(records.ORACLES) | set(flows.ORACLES)
    finally:
        monkeypatch.undo()
        importlib.reload(entry_points)

"""Operators on literal rows: decisions, releases, tables, sequences, streams."""

import datetime
import json

import duckdb
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import classify, facets, fusion, incremental, linking, ranking, reports, sequences
from tessera.streaming import jobs

D = datetime.date


def test_price_condition_null_rules(spark):
    df = spark.createDataFrame([(1, None), (2, 500), (3, 99999)], "id int, price bigint")
    ids = lambda *a: sorted(r["id"] for r in df.where(facets.price_condition(F.col("price"), *a)).collect())
    assert ids(0, 10, 100) == [1, 2] and ids(1, 10, 100) == [2] and ids(0, 100, 100) == [1, 2, 3] and ids(5, 100, 100) == [2, 3]


def test_facets_caps_and_library(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, None), (3, ["b"])], "id bigint, tags array<string>")
    run = lambda f: sorted(r["id"] for r in facets.select_rows(df, f).collect())
    assert run(facets.Facets(exclude={"tags": ["a"]})) == [2, 3] and run(facets.Facets(include={"tags": [""] * 16 + ["a"]})) == [1, 2, 3]
    assert run(facets.Facets(library=df.select("id").limit(0))) == [] and run(facets.Facets(ids=[3, -1])) == [3]
    assert facets.sample_padded(df, 7).count() == 7 and facets.sample_padded(df.limit(0), 7).count() == 0
    assert [facets.clamp_segments(n) for n in (None, 0, 99)] == [12, 1, 16]
    assert ranking.ranked_search(df, "  ", name_col="id").count() == 0


def release(spark, *rows):
    df = spark.createDataFrame([(1, None if d is None else D.fromisoformat(d), p, k) for d, p, k in rows], "item_id int, date date, precision string, kind string")
    got = fusion.resolve_release(df).collect()
    return (str(got[0]["date"]), got[0]["confidence"], got[0]["conflict"]) if got else None


def test_release_rules(spark):
    i, s = "independent", "store"
    assert release(spark, ("2010-05-01", "day", s)) == ("2010-05-01", 30, False)
    assert release(spark, ("2010-05-01", "day", i), ("2010-09-01", "month", i), ("2020-01-01", "day", s)) == ("2010-05-01", 90, False)
    assert release(spark, ("2001-01-01", "year", i), ("2001-06-05", "day", i), ("2001-12-01", "day", i)) == ("2001-06-05", 90, False)
    assert release(spark, ("1998-01-01", "day", i)) == ("1998-01-01", 60, False)
    assert release(spark, ("1998-01-01", "day", i), ("2010-01-01", "day", s)) == ("1998-01-01", 80, False)
    assert release(spark, ("1998-01-01", "day", i), ("2003-01-01", "day", i), ("2010-01-01", "day", s)) == ("1998-01-01", 70, False)
    assert release(spark, ("2010-03-01", "day", i), ("2010-01-01", "day", s)) == ("2010-03-01", 60, False)
    assert release(spark, ("2012-03-01", "day", i), ("2015-03-01", "day", i), ("2010-01-01", "day", s)) == ("2010-01-01", 20, True)
    assert release(spark, (None, "unknown", i)) is None


def test_classes_of_titles(spark):
    want = {
        "Demolition Simulator": None, "Tiny Demo": "demo", "Tiny - Original Game Soundtrack": "soundtrack", "Tiny: Season Pass": "dlc", "Live Cat Wallpaper": "tool", "Tiny - Wallpaper Pack": None, "Tiny - Wallpapers": "artbook", "Tiny Dedicated Server": "tool", "Tiny OST (Deluxe)": "soundtrack",
        "Tiny + Soundtrack": "bundle", "Tiny - Soundtrack and Digital Goods Bundle": "bundle", "Tiny + Other Thing": None, "Rambo The Video Game": None, "Art & Strategy Guide": "other",
    }
    df = spark.createDataFrame([(i, n) for i, n in enumerate(want)], "i int, n string")
    got = [r[0] for r in df.orderBy("i").select(classify.classify_name(F.col("n"), F.lit(True))).collect()]
    assert dict(zip(want, got)) == want
    assert spark.range(1).select(classify.bundle_base(F.lit("Tiny Tale - Game + OST"))).first()[0] == "Tiny Tale"


def test_link_decisions(spark):
    targets = spark.createDataFrame([(1, "alpha quest", 2000, ["X"]), (2, "beta quest", 2000, ["X"]), (3, "gamma quest", None, ["X"]), (4, "delta quest", 2000, ["X"])], "t int, key string, year int, makers array<string>")
    cands = spark.createDataFrame([(10, "alpha quest", 2001, []), (20, "beta quest", 2000, []), (21, "beta quest", 2010, []), (30, "gamma quests", 1999, ["X"]), (40, "delta quest", 2010, [])], "c int, key string, year int, makers array<string>")
    pairs = linking.block(targets, cands, target_id="t", candidate_id="c")
    scored = linking.scored_pairs(targets, cands, pairs, target_id="t", candidate_id="c")
    got = {r["t"]: (r["match_id"], r["decision"]) for r in linking.decide_store(scored, target_id="t", candidate_id="c", makers="makers").collect()}
    assert got == {1: (10, "match"), 2: (20, "match"), 3: (30, "match"), 4: (None, "ambiguous")}
    times = {r["t"]: (r["match_id"], r["confidence"]) for r in linking.decide_times(scored, target_id="t", candidate_id="c").collect()}
    assert times == {1: (10, 70), 2: (20, 70)}
    page = spark.createDataFrame([("Tiny: Dawn", 2012, "tiny", [2010]), ("tiny", 2016, "tiny", [2010]), ("tiny", 2000, "Tiny", [])], "a string, y int, b string, years array<int>")
    assert [r[0] for r in page.select(linking.page_matches(F.col("a"), F.col("y"), F.col("b"), F.col("years"))).collect()] == [True, False, True]


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, at int")
    assert sorted(tuple(r) for r in incremental.upsert(old, new, ["k"], "at").collect()) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]
    assert sorted((r["k"] is None, r["v"]) for r in incremental.with_references(new, old.select("k"), "k").collect()) == [(False, "c"), (False, "d"), (True, "e")]
    assert [tuple(r) for r in incremental.reopened(spark.createDataFrame([(1, "p", "accepted")], "k int, p string, status string"), spark.createDataFrame([(1, "q")], "k int, p string"), ["k"], "p").collect()] == [(1, "q", "open")]
    path = incremental.replace_version(old, str(tmp_path / "t"))
    assert spark.read.parquet(path).count() == 2
    reports.write_json(old.select("k", F.lit(None).cast("string").alias("n")).coalesce(1), str(tmp_path / "j"))
    line = next((tmp_path / "j").glob("*.json")).read_text().splitlines()[0]
    assert json.loads(line) == {"k": 1, "n": None}
    reports.write_names(old.coalesce(1), str(tmp_path / "n"), "v")
    assert next((tmp_path / "n").glob("*.txt")).read_text() == "a\nb\n"
    assert reports.markdown_table([{"a": 1234, "b": None}], ["a", "b"]).splitlines()[-1] == "| 1,234 |  |"


def test_ties_and_repeated_overrides(spark):
    old = spark.createDataFrame([(1, "a", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 2), (2, "e", 2)], "k int, v string, at int")
    picked = {tuple(r) for p in (1, 2, 5) for r in incremental.upsert(old, new.repartition(p), ["k"], "at").where("k = 2").collect()}
    assert len(picked) == 1
    hand = spark.createDataFrame([(1, "v", "x"), (1, "v", "y"), (1, "v", "x")], "k int, field string, value string")
    assert incremental.selective_update(old, new, "k", identity=[], always=[], overridden=hand).first()["v"] == "y"


def test_streams_resume(spark, tmp_path):
    """A second run of the same folder reads only what came since; neighbours of the table are not read."""
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "i int").coalesce(1)
    source, home = str(tmp_path / "table"), str(tmp_path / "home")
    rows(1, 2).write.parquet(source)
    rows(99).write.parquet(source + "2")
    run = lambda: sorted(r["i"] for r in jobs.run_available(jobs.read_stream(spark, source), "r", folder=home).collect())
    assert run() == [1, 2]
    rows(3).write.mode("append").parquet(source)
    assert run() == [1, 2, 3] and run() == [1, 2, 3]


def test_sequences(spark):
    t = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    rows = [(1, 0, "bad", t(0)), (1, 1, "bad", t(30)), (1, 2, "ok", t(31)), (2, 3, "bad", t(0)), (2, 4, "ok", t(5)), (2, 5, "bad", t(40))]
    e = spark.createDataFrame(rows, "k int, i int, s string, at timestamp")
    bad = F.col("s") == "bad"
    assert [r["streak"] for r in sequences.streaks(e, "k", ["at"], bad).orderBy("i").collect()] == [1, 2, 0, 1, 0, 1]
    assert [(r["k"], r["failed_at"]) for r in sequences.repeated_failures(e, "k", ["at"], "at", bad).collect()] == [(1, t(30))]
    assert spark.range(1).select(sequences.backlog(F.lit(51), 100), sequences.backlog(F.lit(50), 100), sequences.backlog(F.lit(201), 100)).first()[:] == ("skip", "enqueue", "trim")


def test_streams_equal_batches(spark, tmp_path):
    t = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = [(i % 3, i, t(i), "error" if i % 4 else "ok") for i in range(40)]
    df = spark.createDataFrame(rows, "user_id bigint, event_id bigint, ts timestamp, event_type string")
    df.where("event_id < 20").coalesce(1).write.parquet(str(tmp_path / "e"))
    df.where("event_id >= 20").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    path = str(tmp_path / "e") + "/"
    once = jobs.run_available(jobs.deduplicated(jobs.read_stream(spark, path, 1), ["user_id"], "ts", "2 hours"), "once")
    assert once.count() == 3
    counted = jobs.run_available(jobs.windowed(jobs.read_stream(spark, path), ["user_id"], "ts", "10 minutes", "0 seconds"), "windows")
    assert counted.count() > 0 and counted.agg(F.max("n")).first()[0] <= 4
    seen = []
    query = jobs.coalesced(jobs.read_stream(spark, path), "user_id", lambda batch, n: seen.append(sorted(r[0] for r in batch.collect())), "1 second")
    query.processAllAvailable()
    query.stop()
    assert seen and seen[0] == [0, 1, 2]


def test_links_follow_the_sql_on_keys_of_short_words(spark, tmp_path):
    """fuzzy_link: keys without a word of four letters have no link, and a common word makes no pairs."""
    import __spark_entry__

    rows = [(k, "red rod" if k < 10 else "large widget", 5) for k in range(400)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = {tuple(r) for r in __spark_entry__.queries()["fuzzy_link"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = set(c.execute(__spark_entry__.oracle_sql()["fuzzy_link"]).fetchall())
    assert got == want and len(want) > 100
    keys = spark.range(400).select("id", F.concat(F.lit("large widget no"), F.col("id").cast("string")).alias("key"))
    far = spark.range(400).select("id", F.concat(F.lit("large widget xy"), F.col("id").cast("string"), F.lit("zz")).alias("key"))
    assert linking.near_block(keys, far, target_id="id", candidate_id="id").count() == 0


def test_likely_block_loses_no_likely_pair(spark):
    """Against all pairs that share the rarest word: short keys, long ones, keys on the edge of two characters and of thirty."""
    stems = ["aa bbb", "large widget no1234567", "the long title of a tale in nine words", "small widget at 12345678901"[:29]]
    keys = [s[:i] + "q" * n + s[i + cut :] for s in stems for i in range(0, len(s), 3) for n, cut in ((0, 0), (1, 0), (2, 0), (0, 1), (1, 1), (0, 2), (3, 0), (0, 3))]
    t = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    rarest = linking.rarest_words(t, t, target_id="id", least=3)
    got = {(r["__t"], r["__c"]) for r in linking.likely_block(t, t, rarest, target_id="id", candidate_id="id", least=3).collect()}
    every = {(r["__t"], r["__c"]) for r in linking.block(t, t, target_id="id", candidate_id="id", least=3, rare=1).collect()}
    assert got <= every and {p for p in every if names.similar_percent(keys[p[0]], keys[p[1]]) >= 95} <= got and len(got) < len(every)

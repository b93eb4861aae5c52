"""Segmented scans, places, lookups, paged listings, timed streams and partitioned retention on literal rows."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import incremental, linking, ranking, segments, sequences
from tessera.sources import paged
from tessera.streaming import jobs

T0 = datetime.datetime(2024, 1, 1)


def hours(h):
    return T0 + datetime.timedelta(hours=h)


def some_events(rng, n, keys=("a", "b", None)):
    return [(rng.choice(keys), i, hours(rng.randrange(n // 2) / 4), rng.random() < 0.8) for i in range(n)]


def plain_lines(rows):
    lines = {}
    for k, i, at, bad in sorted(rows, key=lambda r: (r[2], r[1])):
        lines.setdefault(k, []).append((i, at, bad))
    return lines


@pytest.fixture(scope="module")
def events(spark):
    rows = some_events(random.Random(1), 600)
    rows += [("long", 1000 + i, hours(i), True) for i in range(300)]  # one run over many ranges
    return rows, spark.createDataFrame(rows, "k string, i int, at timestamp, bad boolean")


def test_streaks_of_few_keys(events):
    rows, df = events
    want = {}
    for line in plain_lines(rows).values():
        n = 0
        for i, _, bad in line:
            n = n + 1 if bad else 0
            want[i] = n
    got = sequences.streaks(df, "k", ["at", "i"], F.col("bad"))
    assert {r["i"]: r["streak"] for r in got.collect()} == want and got.columns == [*df.columns, "streak"]


def test_no_task_holds_a_key(events, spark):
    _, df = events
    sizes = [r["n"] for r in segments.dealt(df, ["k", "at", "i"], 12).groupBy(segments.PART).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 10 and max(sizes) < 3 * df.count() / 12


def test_repeated_failures_of_few_keys(events):
    rows, df = events
    want = {}
    for k, line in plain_lines(rows).items():
        first = None
        for _, at, bad in line:
            first = None if not bad else first or at
            if bad and at >= first + datetime.timedelta(hours=9) and k not in want:
                want[k] = (first, at)
    got = sequences.repeated_failures(df, "k", ["at", "i"], "at", F.col("bad"), 9)
    assert {r["k"]: (r["first_at"], r["failed_at"]) for r in got.collect()} == want and "long" in want


def plain_pauses(rows, length):
    blocks = [(k, at) for k, _, at, bad in rows if bad]
    return {i: any(b < at < b + datetime.timedelta(hours=length) for x, b in blocks if x == k) for k, i, at, _ in rows}


def test_pauses_of_few_keys(spark):
    rows = [(k, i, at, i % 29 == 0) for k, i, at, _ in some_events(random.Random(2), 400)]
    df = spark.createDataFrame(rows, "k string, i int, at timestamp, bad boolean")
    got = {r["i"]: r["paused"] for r in sequences.with_pause(df, "k", "at", F.col("bad"), 3).collect()}
    assert got == plain_pauses(rows, 3) and 20 < sum(got.values()) < 380
    assert sequences.with_pause(df.limit(0), "k", "at", F.col("bad"), 3).count() == 0 and sequences.streaks(df.limit(0), "k", ["at"], F.col("bad")).count() == 0


def test_places_and_trimming(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), rng.randrange(40), i) for i in range(500)] + [("few", 1, 1000), (None, 2, 1001)]
    df = spark.createDataFrame(rows, "s string, at int, i int")
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    assert {r["i"]: r["place"] for r in segments.numbered(df, [F.col("at"), F.col("i")]).collect()} == {r[2]: n + 1 for n, r in enumerate(order)}
    by = {}
    for s, _, i in order:
        by.setdefault(s, []).append(i)
    want = {i: len(line) > 60 and n >= 30 for line in by.values() for n, i in enumerate(line)}
    assert {r["i"]: r["trimmed"] for r in sequences.trimmed(df, "s", ["at", "i"], 30).collect()} == want
    files = spark.createDataFrame([("theme10.mp3",), ("Theme2.mp3",), ("theme2.txt",), ("theme1.mp3",)], "name string")
    assert [tuple(r) for r in ranking.natural_listing(files, r"theme.*\.mp3").orderBy("place").collect()] == [(1, "theme1.mp3"), (2, "Theme2.mp3"), (3, "theme10.mp3")]
    assert ranking.natural_listing(files.limit(0), ".*").count() == 0


def test_words_inside_words_equal_like(spark):
    rng = random.Random(4)
    syllables = ["star", "craft", "re", "master", "s", "ed", "o", "io"]
    title = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 4)))
    held = [(100 + i, title()) for i in range(120)] + [(1, "starcrafts remastered"), (2, None), (3, "")]
    asked = [(i, title()) for i in range(40)] + [(900, "starcraft remaster"), (901, "zzzz"), (902, None), (903, ""), (904, "o")]
    word = lambda key: next((w for w in key.split(" ") if len(w) >= 4), key.split(" ")[0])
    want = set()
    for t, key in asked:
        found = sorted((c != key, i) for i, c in held if key and c and (c == key or word(key) in c))
        want |= {(t, i) for _, i in found[:5]}
    t, c = spark.createDataFrame(asked, "t int, key string"), spark.createDataFrame(held, "c int, key string")
    got = {(r["__t"], r["__c"]) for r in linking.contains_block(t, c, target_id="t", candidate_id="c", most=5).collect()}
    assert got == want and (900, 1) in got
    assert linking.contains_block(t.limit(0), c, target_id="t", candidate_id="c").count() == 0 and linking.contains_block(t, c.limit(0), target_id="t", candidate_id="c").count() == 0


def test_cascade_asks_only_for_what_is_open(spark):
    seen = []

    def tier(*ids):
        def run(open_):
            seen.append(sorted(r["t"] for r in open_.collect()))
            return open_.where(F.col("t").isin(*ids)).withColumn("found", F.col("t") * 10)

        return run

    df = spark.createDataFrame([(i,) for i in range(5)], "t int")
    got = linking.cascade(df, [("a", tier(1, 2)), ("b", tier(2, 3)), ("c", tier())], target_id="t")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 10, "a"), (2, 20, "a"), (3, 30, "b")] and seen == [[0, 1, 2, 3, 4], [0, 3, 4], [0, 4]]


def test_lookups_by_variant(spark):
    targets = spark.createDataFrame([(1, ["Tiny Tale Deluxe Thing", "Tiny Tale"], 2001), (2, ["Tiny Tale"], 1980), (3, ["Other"], 2001), (4, [], 2001), (5, ["a1", "a2", "a3", "Tiny Tale"], 2001)], "t int, variants array<string>, year int")
    held = spark.createDataFrame([(10, "tiny tale", 2000, ["PC"]), (11, "other", 2001, ["Switch"])], "c int, key string, year int, platforms array<string>")
    decide = lambda s: linking.decide_times(s, target_id="t", candidate_id="c")
    got = linking.lookups(targets, held, target_id="t", candidate_id="c", decide=decide, platform=("platforms", "PC"))
    assert {r["t"]: (r["match_id"], r["status"], r["tier"]) for r in got.collect()} == {1: (10, "match", 2), 2: (None, "not_found", None), 3: (None, "no_platform", 1), 4: (None, "not_found", None), 5: (None, "not_found", None)}


def test_table_function_gives_the_variants(spark):
    titles = ["Tiny Tale Remastered", "Tiny Tale: The Second Coming of", "Big", None, "", "Nioh 2 - The Complete Edition", "The And"]
    df = spark.createDataFrame(list(enumerate(titles)), "i int, title string")
    got = {}
    for r in sorted(names.with_variants(df, "title").collect(), key=lambda r: (r["i"], r["place"])):
        got.setdefault(r["i"], []).append(r["variant"])
    want = {r["i"]: r["v"] for r in df.select("i", names.name_variants(F.col("title")).alias("v")).collect() if r["v"]}
    assert got == want
    assert names.with_variants(df, "title", most=1).groupBy("i").count().where("count > 1").count() == 0


def put(folder, number, body):
    folder.mkdir(exist_ok=True)
    (folder / f"page-{number}.json").write_text(body)


def test_walks_end_where_they_should(spark, tmp_path):
    home = tmp_path / "walk"
    for n in range(12):
        put(home, n, f'{{"apps": [{n}, {n + 100}]}}')
    run = lambda **k: (lambda rows, end: (sorted(int(r["item"]) for r in rows.where("item < '100'").collect()), end))(*paged.walked(paged.pages(spark, str(home), items_at="apps", pages_per_task=5), **k))
    assert run()[1] == 12
    put(home, 3, "<html>"), put(home, 5, '{"apps": 7}'), put(home, 8, '{"other": []}')
    rows, end = paged.walked(paged.pages(spark, str(home), items_at="apps"), max_bad=2)
    assert end == 8 and sorted({r["page"] for r in rows.collect()}) == [0, 1, 2, 4, 6, 7]
    assert paged.walked(paged.pages(spark, str(home), items_at="apps"), max_bad=1)[1] == 5
    (home / "page-1.json").unlink()
    assert paged.walked(paged.pages(spark, str(home), items_at="apps"))[1] == 1
    rows, end = paged.walked(paged.pages(spark, str(home), start=6, items_at="apps"), start=6)
    assert end == 8 and {r["page"] for r in rows.collect()} == {6, 7}
    rows, end = paged.walked(paged.pages(spark, str(tmp_path / "nothing")))
    assert end == 0 and rows.count() == 0


def test_page_stream_resumes_at_its_cursor(spark, tmp_path):
    home, state = tmp_path / "pages", str(tmp_path / "state")
    put(home, 0, "[1]"), put(home, 1, "[2]"), put(home, 3, "[4]")
    run = lambda: sorted((r["page"], r["ok"]) for r in jobs.run_available(paged.page_stream(spark, str(home)), "p", folder=state).collect())
    assert run() == [(0, True), (1, True)] and run() == [(0, True), (1, True)]
    put(home, 0, "[99]"), put(home, 2, "<html>")  # what was read is not read again
    assert run() == [(0, True), (1, True), (2, False), (3, True)]


def land_in_batches(spark, path, rows, schema, cuts):
    for low, high in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(rows[low:high], schema).coalesce(1).write.mode("append").parquet(path)
        yield


def test_debounce_across_batches_and_restarts(spark, tmp_path):
    ms = lambda n: T0 + datetime.timedelta(milliseconds=n)
    rows = [("a", ms(0)), ("b", ms(100)), ("a", ms(3000)), ("a", ms(4999)), ("a", ms(5000)), ("b", ms(5050)), ("a", ms(9000)), ("b", ms(20000)), ("c", ms(60000))]
    path, home = str(tmp_path / "e"), str(tmp_path / "home")
    for _ in land_in_batches(spark, path, rows, "k string, at timestamp", [1, 3, 6]):
        got = jobs.run_available(jobs.debounced(jobs.read_stream(spark, path, 1), "k", "at", 5000), "d", folder=home).collect()
    assert sorted((r["k"], r["first_at"], r["n"]) for r in got) == [("a", ms(0), 3), ("a", ms(5000), 2), ("b", ms(100), 2), ("b", ms(20000), 1)]


def test_pause_stream_equals_the_batch_form(spark, tmp_path):
    rows = sorted(((k, i, at, i % 17 == 0) for k, i, at, _ in some_events(random.Random(5), 200, ("a", "b"))), key=lambda r: r[2])
    times = [r[2] for r in rows]
    cuts = [next(i for i in range(n, 200) if times[i] != times[i - 1]) for n in (60, 120)]
    path, home = str(tmp_path / "e"), str(tmp_path / "home")
    for _ in land_in_batches(spark, path, rows, "k string, i int, at timestamp, bad boolean", cuts):
        out = jobs.run_available(jobs.pause_stream(jobs.read_stream(spark, path, 1), "k", "i", "at", "bad", 3 * 3_600_000), "p", folder=home).collect()
    assert {r["i"]: r["paused"] for r in out if r["kind"] == "event"} == plain_pauses(rows, 3)
    for k in "ab":
        blocks = sorted({at for x, _, at, bad in rows if x == k and bad})
        ends = [b + datetime.timedelta(hours=3) for b, after in zip(blocks, [*blocks[1:], datetime.datetime.max]) if after >= b + datetime.timedelta(hours=3)]
        assert sorted(r["at"] for r in out if r["k"] == k and r["kind"] == "pause") == blocks
        assert sorted(r["at"] for r in out if r["k"] == k and r["kind"] == "resume") == [e for e in ends if e <= times[-1]]


def test_streaks_in_a_stream_with_text_keys(spark, tmp_path):
    rows = sorted(((k, i, at, "error" if bad else "ok") for k, i, at, bad in some_events(random.Random(6), 120, ("steam", "gog"))), key=lambda r: (r[2], r[1]))
    path, home = str(tmp_path / "e"), str(tmp_path / "home")
    for _ in land_in_batches(spark, path, rows, "k string, i int, at timestamp, s string", [50, 51]):
        got = jobs.run_available(jobs.streak_stream(jobs.read_stream(spark, path, 1), "k", "i", "at", "s", "error"), "s", folder=home).collect()
    want = {r["i"]: r["streak"] for r in sequences.streaks(spark.createDataFrame(rows, "k string, i int, at timestamp, s string"), "k", ["at", "i"], F.col("s") == "error").collect()}
    assert {r["i"]: r["streak"] for r in got} == want


def test_retention_touches_only_old_months(spark, tmp_path):
    path = str(tmp_path / "months")
    rows = [(i, datetime.date(2024, 1, 1) + datetime.timedelta(days=7 * i)) for i in range(30)] + [(99, None)]
    incremental.write_months(spark.createDataFrame(rows, "i int, at date"), path, "at")
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names_ in os.walk(path) for f in names_ if f.endswith(".parquet")}
    before = files()
    assert incremental.drop_old_months(spark, path, "at", "2024-06-17", 2) == (["2024-01", "2024-02", "2024-03"], ["2024-04"])
    left = spark.read.parquet(path)
    assert sorted(r["i"] for r in left.collect()) == [i for i, at in rows if at is None or at >= datetime.date(2024, 4, 17)]
    assert {f for f in before if "2024-05" in f or "2024-06" in f or "none" in f} <= files().keys() and all(files()[f] == t for f, t in before.items() if f in files() and "2024-04" not in f)
    incremental.write_months(spark.createDataFrame([(500, datetime.date(2024, 5, 3))], "i int, at date"), path, "at")
    assert [r["i"] for r in spark.read.parquet(path).where("month = '2024-05'").collect()] == [500] and spark.read.parquet(path).where("month = '2024-06'").count() > 0
    assert incremental.drop_old_months(spark, path, "at", "2024-07-30", 2)[1] == ["2024-05"] and not os.path.isdir(f"{path}/month=2024-05")


def test_guarded_upsert_rules(spark):
    s = "k int, m string, c int"
    old = spark.createDataFrame([(1, "hand", 10), (2, "fuzzy", 50), (3, "fuzzy", 50), (4, "fuzzy", None), (5, "fuzzy", 1)], s)
    new = spark.createDataFrame([(1, "wiki", 90), (2, "wiki", 50), (3, "wiki", 40), (4, "wiki", 5), (6, "wiki", 7), (6, "wiki", 9), (6, "other", None)], s)
    got = incremental.guarded_upsert(old, new, ["k"], method="m", confidence="c", protected=["hand"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "hand", 10), (2, "wiki", 50), (3, "fuzzy", 50), (4, "wiki", 5), (5, "fuzzy", 1), (6, "wiki", 9)]


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "i int")
    held = lambda name, **k: sorted(r["i"] for r in incremental.current(spark, path, name, **k).collect())
    assert incremental.replace_together({"a": rows(1), "b": rows(2)}, path) == 1
    broken = rows(1).select((F.col("i") / F.raise_error(F.lit("no"))).alias("i"))
    with pytest.raises(Exception):
        incremental.replace_together({"a": rows(3), "b": broken}, path)
    assert (held("a"), held("b")) == ([1], [2])
    assert incremental.replace_together({"a": rows(3, 4)}, path) == 2
    assert (held("a"), held("b"), held("a", number=1)) == ([3, 4], [2], [1])
    os.remove(f"{path}/manifests/0000000002/_SUCCESS")  # a manifest that is not complete does not count
    assert held("a") == [1]


def test_contains_block_joins_lists_of_equal_keys(spark):
    """300 targets and 300 candidates of one key: the joins give one row a target, not 90,000 pairs, and the first candidates are found."""
    rows = spark.range(300).select("id", F.lit("blue ring").alias("key"))
    out = linking.contains_block(rows, rows, target_id="id", candidate_id="id", most=5)
    got = {(r["__t"], r["__c"]) for r in out.collect()}
    assert got == {(t, c) for t in range(300) for c in range(5)}
    metrics, seen = [], [out._jdf.queryExecution().executedPlan()]
    while seen:
        node = seen.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            node = node.executedPlan()
        if "QueryStage" in node.nodeName():
            node = node.plan()
        seen += [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in node.nodeName():
            metrics.append(node.metrics().apply("numOutputRows").value())
    assert metrics and max(metrics) <= 600


def test_walk_reads_its_pages_once(spark, tmp_path):
    """Each page file is opened once in a walk, and long listings have no more than MOST_TASKS ranges."""
    for n in range(6):
        (tmp_path / f"page-{n}.json").write_text('["a"]' if n < 5 else "[]")
    read = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(page):
        read.add(1)
        return True

    rows, end = paged.walked(paged.pages(spark, str(tmp_path)).where(seen.asNondeterministic()("page")))
    assert end == 5 and sorted(r["page"] for r in rows.collect()) == [0, 1, 2, 3, 4] and read.value == 6
    source = paged._Pages({"path": str(tmp_path), "pagespertask": "1"})
    source.landed = lambda: {n: str(n) for n in range(5000)}
    assert len(source.ranges(0)) <= paged.MOST_TASKS and sum(len(r.pages) for r in source.ranges(0)) == 5000

"""Queries on flows of work: paged listings, tiered lookups, queues, pauses and retention, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dates, html, names, urls
from tessera.operators import classify, incremental, linking, ranking, sequences
from tessera.plans import catalogue
from tessera.session import shared_path, spread, table
from tessera.sources import paged
from tessera.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


# --- paged listings ----------------------------------------------------------------------------------

_EACH = 25


def _listing(spark, d):
    """Pages of 25 parts as a source lands them: page 2 is an error page, the page after three quarters is empty."""
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / _EACH).alias("page"), F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))).alias("item"))
    last = p.agg(F.max("page")).first()[0] or 0
    bodies = p.groupBy("page").agg(F.concat(F.lit('{"response":{"apps":['), F.array_join(F.collect_list("item"), ","), F.lit("]}}")).alias("body"))
    empty = (last + 1) * 3 // 4
    return bodies.select("page", F.when(F.col("page") == 2, "<html>Sorry</html>").when(F.col("page") == empty, '{"response":{"apps":[]}}').otherwise(F.col("body")).alias("body"))


_WALKED = f"""WITH p AS (SELECT p_partkey, p_name, p_partkey // {_EACH} AS page FROM part) SELECT page, p_partkey AS id, p_name AS name FROM p WHERE page <> 2 AND page < (SELECT (max(page) + 1) * 3 // 4 FROM p)"""


def _items(rows):
    return rows.withColumn("x", F.from_json("item", "id bigint, name string")).select("page", "x.id", "x.name")


@query(_WALKED)
def paged_walk(spark, d):
    """A listing walked to its first empty page, over a bad one, in planned ranges of pages."""
    path = shared_path(spark, "listing")
    paged.land(_listing(spark, d), path, "page", "body")
    rows, _ = paged.walked(paged.pages(spark, path, items_at="response.apps"), max_bad=2)
    return _items(rows)


@query(f"""WITH p AS (SELECT p_partkey, p_name, p_partkey // {_EACH} AS page FROM part)
SELECT page, p_partkey AS id, p_name AS name, page >= 3 AS later FROM p WHERE page <> 2 AND page <> (SELECT (max(page) + 1) * 3 // 4 FROM p)""")
def paged_stream(spark, d):
    """The listing as a stream in two runs: the second goes on at the first one's cursor, and pages that land ahead of their turn wait."""
    path, home = shared_path(spark, "listing"), shared_path(spark, "listing-stream")
    listing = _listing(spark, d)

    def run():
        rows = paged.page_stream(spark, path, items_at="response.apps").select("page", F.explode("items").alias("item"))
        return jobs.run_available(rows, "listing", folder=home)

    paged.land(listing.where("page < 3 OR page = 4"), path, "page", "body")
    first = run().select("page").distinct().withColumn("earlier", F.lit(True))
    first = first.sparkSession.createDataFrame(first.collect(), "page bigint, earlier boolean")  # pages 0 and 1
    paged.land(listing.where("page = 3 OR page > 4"), path, "page", "body")
    return _items(run()).join(F.broadcast(first), "page", "left").withColumn("later", F.col("earlier").isNull()).drop("earlier")


# --- lookups -----------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT p_partkey AS t, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE string_split(p_name, ' ')[2] || ' x' || p_partkey END AS key FROM part),
c AS (SELECT p_partkey AS c, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE replace(p_name, ' ', '') || 's' END AS key FROM part),
w AS (SELECT t, key, coalesce(list_filter(string_split(key, ' '), lambda x: length(x) >= 4)[1], string_split(key, ' ')[1]) AS word FROM t),
pairs AS (SELECT t, c, c.key <> w.key AS tier FROM w JOIN c ON c.key = w.key OR contains(c.key, word))
SELECT t, c FROM pairs QUALIFY row_number() OVER (PARTITION BY t ORDER BY tier, c) <= 25""")
def contains_candidates(spark, d):
    """Candidates that hold a title's word anywhere, also inside a word, by an index of three-character stretches."""
    k, p = F.col("p_partkey"), spread(table(spark, d, "part"))
    targets = p.select(k.alias("id"), F.when(k % 4 == 0, F.col("p_name")).otherwise(F.concat(F.split("p_name", " ")[1], F.lit(" x"), k.cast("string"))).alias("key"))
    held = p.select(k.alias("id"), F.when(k % 3 == 0, F.col("p_name")).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("s"))).alias("key"))
    return linking.contains_block(targets, held, target_id="id", candidate_id="id").select(F.col("__t").alias("t"), F.col("__c").alias("c"))


def _looked_up(spark, d):
    k, p = F.col("p_partkey"), table(spark, d, "part")
    title = F.concat(F.lit("Part"), k.cast("string"), F.lit(" "), "p_name")
    asked = F.when(k % 4 == 0, title).when(k % 4 == 1, F.concat(title, F.lit(" Remastered"))).when(k % 4 == 2, F.concat(title, F.lit(" - A New Tale Remastered"))).otherwise(F.concat(F.lit("Gone"), k.cast("string")))
    targets = p.select("p_partkey", names.name_variants(asked).alias("variants"), (F.col("p_size") + 1990).alias("year"))
    platforms = F.when(k % 5 == 0, F.array(F.lit("PS4"))).otherwise(F.array(F.lit("PC"), F.lit("PS4")))
    held = p.select((k + 1000000).alias("c_id"), names.match_key(title).alias("key"), F.when(k % 7 == 0, F.col("p_size") + 1999).otherwise(F.col("p_size") + 1991).alias("year"), platforms.alias("platforms"))
    equal = lambda a, b: F.lit(0.0)  # noqa: E731  equal titles only
    decide = lambda scored: linking.decide_times(scored, target_id="p_partkey", candidate_id="c_id")
    return linking.lookups(targets, held, target_id="p_partkey", candidate_id="c_id", decide=decide, platform=("platforms", "PC"), score=equal)


_TIERS = """found AS (SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 AND p_partkey % 7 <> 0 THEN p_partkey % 4 + 1 END AS tier FROM part),
told AS (SELECT *, CASE WHEN tier IS NULL THEN 'not_found' WHEN p_partkey % 5 = 0 THEN 'no_platform' ELSE 'match' END AS status FROM found)"""


@query(f"WITH {_TIERS} SELECT p_partkey, CASE WHEN status = 'match' THEN p_partkey + 1000000 END AS match_id, status, CAST(tier AS INTEGER) AS tier FROM told")
def lookup_cascade(spark, d):
    """Titles looked up by up to three variants, each only for what the ones before left open; a match must be sold for PC."""
    return _looked_up(spark, d).select("p_partkey", "match_id", "status", "tier")


@query(f"WITH {_TIERS} SELECT CAST(tier AS INTEGER) AS tier, status, count(*) AS n FROM told GROUP BY 1, 2")
def lookup_tiers(spark, d):
    return _looked_up(spark, d).groupBy("tier", "status").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN [p_name || ' Remastered', p_name] WHEN 1 THEN [p_name || ' A New Tale', p_name] ELSE [p_name || ' 2 The', p_name || ' 2'] END AS v FROM part)
SELECT p_partkey, CAST(unnest([1, 2]) AS INTEGER) AS place, unnest(v) AS variant FROM v""")
def variants_lateral(spark, d):
    """Search variants as rows, by a table function in a lateral join."""
    k = F.col("p_partkey")
    titled = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.when(k % 3 == 0, " Remastered").when(k % 3 == 1, ": A New Tale").otherwise(" 2 The Complete Edition")).alias("title"))
    return names.with_variants(titled, "title").select("p_partkey", "place", "variant")


# --- queues, pauses, retention -----------------------------------------------------------------------


@query("""WITH q AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS place, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey, o_orderpriority, n > 400 AND place > 200 AS trimmed FROM q""")
def trimmed_backlog(spark, d):
    """Of a source with over two batches waiting all but the oldest batch goes."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return sequences.trimmed(o, "o_orderpriority", ["o_orderdate", "o_orderkey"], 200).select("o_orderkey", "o_orderpriority", "trimmed")


@query(catalogue.ORACLES["retention"])
def retention_by_month(spark, d):
    """Retention on a table with a folder a month: old months go without a rewrite."""
    path = shared_path(spark, "months")
    incremental.write_months(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), path, "o_orderdate")
    incremental.drop_old_months(spark, path, "o_orderdate", catalogue.NOW, 18)
    return spark.read.parquet(path).select("o_orderkey", "o_orderdate")


@query("""WITH RECURSIVE g(user_id, first_at) AS (SELECT user_id, min(ts) FROM events GROUP BY 1
  UNION ALL SELECT user_id, next FROM (SELECT g.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = g.user_id AND e.ts >= g.first_at + INTERVAL 6 HOURS) AS next FROM g) WHERE next IS NOT NULL)
SELECT g.user_id, g.first_at, count(*) AS n FROM g JOIN events e ON e.user_id = g.user_id AND e.ts >= g.first_at AND e.ts < g.first_at + INTERVAL 6 HOURS
WHERE g.first_at + INTERVAL 6 HOURS <= (SELECT max(ts) FROM events) GROUP BY 1, 2""")
def debounce_stream(spark, d):
    """Events of a user within six hours of the first as one, when the six hours are over; what still waits at the stream's end is not given."""
    stream = jobs.read_stream(spark, f"{d}/events.parquet").select("user_id", "ts")
    out = jobs.run_available(jobs.debounced(stream, "user_id", "ts", 6 * 3_600_000), "debounced")
    end = table(spark, d, "events").agg(F.max("ts").cast("timestamp").alias("mark"))
    return out.join(F.broadcast(end), F.col("due_at") <= F.col("mark")).select("user_id", F.col("first_at").cast("timestamp_ntz").alias("first_at"), "n")


@query("""SELECT event_id, EXISTS (SELECT 1 FROM events b WHERE b.user_id = e.user_id AND b.event_type = 'error' AND b.ts < e.ts AND e.ts < b.ts + INTERVAL 3 HOURS) AS paused FROM events e""")
def pause_state(spark, d):
    """The timed pauses again, as state with a timer in a stream."""
    stream = jobs.read_stream(spark, f"{d}/events.parquet").select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("block"))
    out = jobs.run_available(jobs.pause_stream(stream, "user_id", "event_id", "ts", "block", 3 * 3_600_000), "pauses")
    return out.where("kind = 'event'").select("event_id", "paused")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'seen' ELSE o_orderstatus END AS status, 'x' || c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey""")
def replaced_together(spark, d):
    """Two tables replaced in one step, after a step that wrote them first and one that failed half way."""
    path = shared_path(spark, "state")
    orders, customers = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status")), table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"))
    incremental.replace_together({"orders": orders, "customers": customers}, path)
    old, held = incremental.current(spark, path, "orders"), incremental.current(spark, path, "customers")
    incremental.replace_version(old.limit(0), f"{path}/orders")  # a version that no manifest names
    incremental.replace_together({"orders": old.withColumn("status", F.when(F.col("o_orderkey") % 2 == 0, "seen").otherwise(F.col("status"))), "customers": held.withColumn("name", F.concat(F.lit("x"), "name"))}, path)
    new, named = incremental.current(spark, path, "orders"), incremental.current(spark, path, "customers")
    return new.join(named, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "status", "name")


# --- packs, pages of conflicts, addresses ------------------------------------------------------------

_PACKS = ["", " DLC Collection Pack", " Twin Pack", " Season Pass", " Skins"]


@query("""WITH p AS (SELECT p_partkey, p_partkey % 3 = 0 AS pack, p_partkey + CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END AS number FROM part)
SELECT p_partkey FROM p WHERE NOT pack OR (number % 5 IN (0, 2) AND number NOT IN (SELECT p_partkey FROM p WHERE NOT pack))""")
def keepable_packs(spark, d):
    """Packs that are neither extras nor wrap a product of the same title; every second one has its neighbour's."""
    k = F.col("p_partkey")
    number = k + F.when(k % 6 == 0, 1).otherwise(0)
    title = F.concat(F.lit("Part"), number.cast("string"), F.get(F.array(*[F.lit(x) for x in _PACKS]), (number % 5).cast("int")))
    products = table(spark, d, "part").select("p_partkey", F.when(k % 3 == 0, "pack").otherwise("game").alias("kind"), title.alias("title"))
    return classify.keepable(products).select("p_partkey")


@query("""SELECT o_orderkey, c_name, o_orderpriority, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AS total FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20""")
def conflict_page(spark, d):
    """The second page of open conflicts of one field, with the count for the pager."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_orderpriority", "o_orderstatus", "o_orderdate")
    page = ranking.filtered_page(o, {"o_orderstatus": "O", "o_orderpriority": "1-URGENT"}, 2, [F.col("o_orderdate").desc(), F.col("o_orderkey")], 20)
    return page.select("o_orderkey", "c_name", "o_orderpriority", "total")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Q' || (p_partkey + 1) ELSE 'P' || p_partkey END AS entity, ['game', 'movie', 'unknown'][p_partkey % 3 + 1] AS kind, CASE WHEN p_partkey % 3 = 2 THEN 'dlc/' ELSE '' END || replace(p_name, ' ', '_') AS slug,
CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '-') END AS linked, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS number, 'https://en.wikipedia.org/wiki/' || replace(p_name, ' ', '_') || '_(' || p_size || ')' AS article FROM part""")
def address_parts(spark, d):
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    p = table(spark, d, "part")
    uri = F.when(k % 2 == 0, F.concat(F.lit("http://host/entity/Q"), (k + 1).cast("string"))).otherwise(F.concat(F.lit("P"), text))
    shop = F.concat(F.get(F.array(F.lit("game/"), F.lit("movie/"), F.lit("dlc/")), (k % 3).cast("int")), F.replace("p_name", F.lit(" "), F.lit("_")))
    link = F.concat(F.when(k % 2 == 0, "https://shop/en/game/").otherwise("https://shop/en/movie/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("?x=1#top"))
    page = F.concat(F.lit("/pc/"), F.when(k % 5 != 0, text).otherwise(F.lit("")), F.lit("-some-title"))
    article = urls.encyclopedia_url("en", F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")")))
    out = p.select("p_partkey", urls.entity_id(uri).alias("entity"), urls.shop_path(shop).alias("s"), urls.slug_of_link(link).alias("linked"), urls.page_number(page).alias("number"), article.alias("article"))
    return out.select("p_partkey", "entity", "s.kind", "s.slug", "linked", "number", "article")


_MONTHS_SQL = ", ".join(f"'{m}'" for m in dates.SHOWN)
_RU_OF_SQL, _RU_SQL = (", ".join(f"'{m}'" for m in names_) for names_ in (dates.SHOWN_RU_OF, dates.SHOWN_RU))


@query(f"""WITH o AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS ru, o_orderkey % 5 AS p, o_orderdate AS d FROM orders)
SELECT o_orderkey, CASE p WHEN 0 THEN CASE WHEN ru THEN day(d) || ' ' || [{_RU_OF_SQL}][month(d)] || ' ' || year(d) ELSE [{_MONTHS_SQL}][month(d)] || ' ' || day(d) || ', ' || year(d) END
 WHEN 1 THEN CASE WHEN ru THEN [{_RU_SQL}][month(d)] ELSE [{_MONTHS_SQL}][month(d)] END || ' ' || year(d) WHEN 2 THEN CASE WHEN ru THEN quarter(d) || ' квартал ' || year(d) ELSE 'Q' || quarter(d) || ' ' || year(d) END
 WHEN 3 THEN CAST(year(d) AS VARCHAR) ELSE '???' END AS shown FROM o""")
def shown_dates(spark, d):
    k = F.col("o_orderkey")
    precision = F.get(F.array(*[F.lit(x) for x in ("day", "month", "quarter", "year", "unknown")]), (k % 5).cast("int"))
    shown = dates.shown_date(F.col("o_orderdate").cast("date"), precision, F.when(k % 2 == 0, "ru").otherwise("en"))
    return table(spark, d, "orders").select("o_orderkey", shown.alias("shown"))


@query(r"""WITH b AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array('<' || replace(text, '. ', '.' || chr(10) || chr(10)) || ' & Co>', '\n{2,}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS b FROM documents),
t AS (SELECT doc_id, array_to_string(list_transform(b, lambda x: '<p style="padding-bottom:10px">' || replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') || '</p>'), '') AS t FROM b)
SELECT doc_id, length(t) AS n, md5(t) AS digest FROM t""")
def description_html(spark, d):
    """Every text, its sentences parted by blank lines, as paragraphs."""
    marked = F.concat(F.lit("<"), F.replace("text", F.lit(". "), F.lit(".\n\n")), F.lit(" & Co>"))
    return table(spark, d, "documents").select("doc_id", html.paragraphs(marked).alias("t")).select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))

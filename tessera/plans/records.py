"""Queries on source records and published rows: payloads, pages and links made from the driver tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import names, scalars
from tessera.operators import classify, facets, fusion, incremental, linking, publishing, ranking, reports, sequences
from tessera.session import spread, table
from tessera.sources import extractors, review_pages
from tessera.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _o(**fields) -> Column:
    """A struct of named columns."""
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def _extracted(df: DataFrame, key: str, source: str, payload: Column) -> DataFrame:
    return extractors.projected(spread(df), source, F.to_json(payload), (key,))


# --- extractors --------------------------------------------------------------------------------------


@query("""SELECT p_partkey, p_name AS name, p_partkey AS steam_appid, 'A' || chr(10) || p_brand AS description_en, ['English', 'German'] AS languages, ['English'] AS voiceovers, [p_brand] AS developers,
CASE WHEN p_partkey % 2 = 0 THEN ['WIN', 'MAC'] ELSE ['WIN'] END AS platforms, CASE WHEN p_partkey % 7 <> 0 THEN CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) END AS initial, DATE '2011-11-08' AS released,
CASE WHEN p_partkey > 0 THEN 50 END AS score, CASE WHEN p_partkey > 0 THEN p_partkey * 2 END AS votes, CASE WHEN p_partkey % 7 <> 0 THEN true WHEN p_partkey % 2 = 0 THEN false END AS purchasable FROM part""")
def extract_steam(spark, d):
    k, cents = F.col("p_partkey"), scalars.round_up_half(F.col("p_retailprice") * 100)
    en = _o(
        name=F.col("p_name"), steam_appid=k, is_free=False, short_description=F.concat(F.lit("A<br>"), "p_brand"), supported_languages="English<strong>*</strong>, German<br><strong>*</strong>spoken", developers=F.array("p_brand", F.lit(" ")),
        price_overview=F.when(k % 7 != 0, _o(initial=cents, final=cents, discount_percent=0)), package_groups=F.when(k % 2 == 0, F.array().cast("array<struct<name: string>>")), platforms=_o(windows=True, mac=k % 2 == 0, linux=False), release_date=_o(coming_soon=False, date="8 Nov, 2011"),
    )
    payload = _o(appid=_text(k), en=en, reviews=_o(success=1, query_summary=_o(total_positive=k, total_reviews=k * 2)))
    f = _extracted(table(spark, d, "part"), "p_partkey", "steam", payload)
    return f.select("p_partkey", "name", "steam_appid", "description_en", "languages", "voiceovers", "developers", "platforms", F.col("prices.usd.initial").alias("initial"), F.col("store_release.date").alias("released"), F.col("score_steam").alias("score"), F.col("score_steam_votes").alias("votes"), F.col("steam_purchasable").alias("purchasable"))


@query("""SELECT p_partkey, p_name || ' & é' AS name, CAST(p_partkey AS VARCHAR) AS gog_id, 'slug_' || p_partkey AS slug, ['WIN', 'MAC'] AS platforms, [p_brand] AS developers, 2000 AS initial, 500 AS final, 75 AS discount, ['English'] AS voiceovers, DATE '2014-05-06' AS released, true AS purchasable FROM part""")
def extract_gog(spark, d):
    k = F.col("p_partkey")
    spoken = F.array(*[_o(_embedded=_o(language=_o(name="English"), localizationScope=_o(type=t))) for t in ("text", "audio")])
    systems = F.array(*[_o(operatingSystem=_o(name=n)) for n in ("windows", "osx", "amiga")])
    inner = _o(product=_o(id=k, title=F.concat(F.lit(" "), "p_name", F.lit(" &amp; &#233; ")), isAvailableForSale=False), developers=F.array(_o(name=F.col("p_brand")), _o(name=F.col("p_brand"))), supportedOperatingSystems=systems, localizations=spoken)
    prices = _o(_embedded=_o(prices=F.array(_o(currency=_o(code="EUR"), basePrice="1 EUR", finalPrice="1 EUR"), _o(currency=_o(code="USD"), basePrice="2000 USD", finalPrice="500 USD"))))
    link = _o(store=_o(href=F.concat(F.lit("https://www.gog.com/en/game/slug_"), _text(k), F.lit("?x=1"))))
    f = _extracted(table(spark, d, "part"), "p_partkey", "gog", _o(en=_o(overview="<b>O</b>", _links=link, _embedded=inner), pricesUsd=prices, catalog=_o(releaseDate="2014.05.06")))
    usd = F.col("prices.usd")
    return f.select("p_partkey", "name", "gog_id", F.col("gog_slug").alias("slug"), "platforms", "developers", usd["initial"].cast("int").alias("initial"), usd["final"].cast("int").alias("final"), usd["discount"].cast("int").alias("discount"), "voiceovers", F.col("store_release.date").alias("released"), F.col("gog_purchasable").alias("purchasable"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS released, ['day', 'month', 'year', 'quarter'][o_orderkey % 4 + 1] AS precision, o_orderkey % 100 + 1 AS score, 1.0 AS main, 2.0 AS complete, ['D'] AS developers, ['P'] AS publishers, CAST(o_orderkey AS VARCHAR) AS steam_id, 'https://w/' || o_orderkey AS wiki FROM orders""")
def extract_igdb(spark, d):
    k = F.col("o_orderkey")
    at = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + 100
    firm = lambda name, dev: _o(company=_o(name=name), developer=dev, publisher=not dev)
    game = _o(
        name="G", first_release_date=at, release_dates=F.array(_o(date=at + 5, date_format=F.lit(7)), _o(date=at, date_format=F.element_at(F.array(*[F.lit(x) for x in (0, 1, 2, 4)]), (k % 4 + 1).cast("int")))), aggregated_rating=(k % 100).cast("double") + 0.5,
        involved_companies=F.array(firm("D", True), firm("P", False), firm("D", True)), external_games=F.array(_o(uid=_text(k), category=1)), websites=F.array(_o(url=F.concat(F.lit("https://w/"), _text(k)), type=3)),
    )
    f = _extracted(table(spark, d, "orders"), "o_orderkey", "igdb", _o(game=game, timeToBeat=_o(hastily=3600, completely=7200)))
    return f.select("o_orderkey", F.col("release.date").alias("released"), F.col("release.precision").alias("precision"), F.col("score_igdb").alias("score"), F.col("time_main").alias("main"), F.col("time_complete").alias("complete"), "developers", "publishers", F.col("links")["steam"]["id"].alias("steam_id"), F.col("links")["wikipedia"]["url"].alias("wiki"))


@query("""SELECT c_custkey, (c_custkey * 1000 + c_custkey * 3000) // 2 AS owners, CASE WHEN c_custkey > 0 THEN CAST(floor(c_custkey / (c_custkey + 1.0) * 100 + 0.5) AS BIGINT) END AS score, CASE WHEN c_custkey > 0 THEN c_custkey END AS votes,
['high', 'a', 'b'] AS tags, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 3 AS DOUBLE) END AS median FROM customer""")
def extract_steamspy(spark, d):
    k = F.col("c_custkey")
    span = F.concat(F.format_number(k * 1000, 0), F.lit(" .. "), F.format_number(k * 3000, 0))
    tags = F.create_map(F.lit("b"), F.lit(1), F.lit("high"), F.lit(9), F.lit("a"), F.lit(1))
    f = _extracted(table(spark, d, "customer"), "c_custkey", "steamspy", _o(appid=k, name=F.col("c_name"), positive=k, negative=F.lit(0), owners=span, median_forever=k % 3, average_forever=0, tags=tags))
    return f.select("c_custkey", F.col("owners_estimate").alias("owners"), F.col("score_steam").alias("score"), F.col("score_steam_votes").alias("votes"), "tags", F.col("playtime_median").alias("median"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS released, CASE WHEN o_orderkey % 50 > 0 THEN floor((o_orderkey % 50) * 1800 / 3600.0 * 10 + 0.5) / 10 END AS main, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 3 AS VARCHAR) END AS steam_id FROM orders""")
def extract_hltb(spark, d):
    k = F.col("o_orderkey")
    f = _extracted(table(spark, d, "orders"), "o_orderkey", "hltb", _o(game_id=k, release_na=F.date_format("o_orderdate", "yyyy-MM-dd"), comp_main=(k % 50) * 1800, comp_100=0, profile_steam=k % 3))
    return f.select("o_orderkey", F.col("release.date").alias("released"), F.col("time_main").alias("main"), F.col("links")["steam"]["id"].alias("steam_id"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 100 AS DOUBLE) END AS score, CASE WHEN o_orderkey % 4 > 0 THEN 'metacritic' END AS source, CASE WHEN o_orderkey % 4 > 0 THEN 12 END AS n, CAST(o_orderdate AS DATE) AS released, CASE WHEN o_orderkey % 2 = 0 THEN 's' || o_orderkey END AS slug FROM orders""")
def extract_metacritic(spark, d):
    k = F.col("o_orderkey")
    payload = _o(slug=F.when(k % 2 == 0, F.concat(F.lit("s"), _text(k))).otherwise(""), url="https://x/", metascore=F.when(k % 4 > 0, k % 100), criticReviews=12, datePublished=F.date_format("o_orderdate", "MMM d, yyyy"))
    f = _extracted(table(spark, d, "orders"), "o_orderkey", "metacritic", payload)
    return f.select("o_orderkey", F.col("score_critics").alias("score"), F.col("score_critics_source").alias("source"), F.col("score_critics_count").cast("int").alias("n"), F.col("release.date").alias("released"), F.col("links")["metacritic"]["id"].alias("slug"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Tough' END AS difficulty, c_custkey % 50 / 10.0 AS stars, CAST(c_custkey % 90 AS DOUBLE) AS hours, make_date(2000 + CAST(c_custkey % 20 AS INTEGER), 5, 4) AS released FROM customer""")
def extract_gamefaqs(spark, d):
    k = F.col("c_custkey")
    payload = _o(pid="9", url="u", difficultyLabel=F.when(k % 2 == 0, "Tough").otherwise(""), ratingTitle=F.concat(F.lit("Average: "), _text((k % 50).cast("double") / 10), F.lit(" out of 5")), lengthTitle=F.concat(_text(k % 90), F.lit(" hours")), releaseRaw=F.concat(F.lit("May 4, "), _text(k % 20 + 2000)))
    f = _extracted(table(spark, d, "customer"), "c_custkey", "gamefaqs", payload)
    return f.select("c_custkey", "difficulty", F.col("score_gamefaqs").alias("stars"), F.col("time_gamefaqs").alias("hours"), F.col("release.date").alias("released"))


@query("""SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS released, 'month' AS precision, 'g' || o_orderkey AS shop, 'https://en.wikipedia.org/wiki/A_' || o_orderkey AS wiki, o_orderkey AS steam_appid, ['X', 'Y'] AS developers FROM orders""")
def extract_wikidata(spark, d):
    k = F.col("o_orderkey")
    v = lambda c: _o(type="literal", value=c)
    dates = F.concat(F.date_format(F.add_months("o_orderdate", 24), "yyyy"), F.lit("-00-00|9||"), F.date_format("o_orderdate", "yyyy-MM"), F.lit("-00T00:00:00Z|10||1901-01-01|7"))
    payload = _o(item=v("http://x/Q1"), steamId=v(_text(k)), gogId_=v(F.concat(F.lit("game/g"), _text(k))), wikiEnTitle_=v(F.concat(F.lit("A "), _text(k))), pubDates=v(dates), developers=v("X|Y|X"))
    f = _extracted(table(spark, d, "orders"), "o_orderkey", "wikidata", payload)
    return f.select("o_orderkey", F.col("release.date").alias("released"), F.col("release.precision").alias("precision"), F.col("links")["gog"]["id"].alias("shop"), F.col("links")["wikipedia_en"]["url"].alias("wiki"), "steam_appid", F.array_distinct("developers").alias("developers"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 90 + 1 END AS score, CASE WHEN c_custkey % 2 = 0 THEN 'https://gamefaqs.gamespot.com/pc/' || c_custkey END AS url FROM customer""")
def extract_gamerankings(spark, d):
    k = F.col("c_custkey")
    f = _extracted(table(spark, d, "customer"), "c_custkey", "gamerankings", _o(id="1", platform=F.when(k % 2 == 0, "PC").otherwise("PS2"), score=(k % 90).cast("double") + 0.5, reviews=k % 4, path=F.concat(F.lit("/pc/"), _text(k))))
    return f.select("c_custkey", F.col("score_gamerankings").alias("score"), F.col("links")["gamefaqs"]["url"].alias("url"))


@query("""SELECT p_partkey, [p_brand || ', Inc.', 'Small, Ltd'] AS developers, ['A', 'B'] AS genres, p_partkey % 2 = 0 AS on_steam, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS steam_appid, CASE WHEN p_partkey % 2 = 1 THEN CAST(p_partkey AS VARCHAR) END AS gog_id, DATE '2001-02-03' AS hinted, p_partkey AS initial FROM part""")
def extract_legacy(spark, d):
    k = F.col("p_partkey")
    payload = _o(sid=_text(k), store_platform=F.when(k % 2 == 0, "Steam").otherwise("GOG"), store_url="s", developers=F.concat("p_brand", F.lit(", Inc., Small, Ltd")), genres="A, B,", published_meta="2001-02-03", price_en=k, meta_score=70)
    f = _extracted(table(spark, d, "part"), "p_partkey", "legacy", payload)
    return f.select("p_partkey", "developers", "genres", F.col("links")["steam"].isNotNull().alias("on_steam"), "steam_appid", "gog_id", F.col("release_candidates")[0]["release"]["date"].alias("hinted"), F.col("prices.usd.initial").alias("initial"))


@query("""SELECT CASE WHEN c_custkey % 3 = 0 THEN 'steam' ELSE 'hltb' END AS source, count(*) AS n, CAST(count(*) FILTER (c_custkey % 3 = 0) AS BIGINT) AS named FROM customer WHERE c_custkey % 3 < 2 GROUP BY 1""")
def source_registry(spark, d):
    """Landed records of several sources in the long form: unknown sources are left out, broken payloads give nulls."""
    k = F.col("c_custkey")
    source = F.when(k % 3 == 0, "steam").when(k % 3 == 1, "hltb").otherwise("nowhere")
    payload = F.when(k % 3 == 0, F.to_json(_o(en=_o(name=F.col("c_name"))))).otherwise("{broken")
    out = extractors.extracted(table(spark, d, "customer").select(k.alias("game_id"), source.alias("source"), payload.alias("payload")))
    return out.groupBy("source").agg(F.count("*").alias("n"), F.count("name").alias("named"))


# --- landed files and pages --------------------------------------------------------------------------


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1""")
def query_bindings(spark, d):
    """Result files of a graph query, one row a binding."""
    rows = table(spark, d, "customer").select(_o(item=_o(value=_text("c_custkey"))).alias("b"), F.concat_ws("-", F.floor(F.col("c_custkey") / 20000), F.col("c_custkey") % 7).alias("file"))
    files = rows.groupBy("file").agg(F.to_json(F.struct(F.struct(F.collect_list("b").alias("bindings")).alias("results"))).alias("value"))
    path = jobs.shared_path(spark, "bindings")
    files.repartition("file").write.partitionBy("file").text(path)  # one document a file: a second one in it would not be read
    found = extractors.bindings(spark, path).select(F.get_json_object("payload", "$.item.value").alias("id"))
    return found.groupBy("id").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, c_name AS name, CAST(c_custkey % 100 AS DOUBLE) AS score, 1000 + c_custkey % 100 AS reviews, CAST((c_custkey % 10) * 10 + 7 AS BIGINT) AS users, 'pc' AS platform FROM customer""")
def critics_pages(spark, d):
    k = F.col("c_custkey")
    page = F.concat(
        F.lit('<title>x Reviews - Metacritic</title><script type="application/ld+json">{"@type":"VideoGame","name":"'), "c_name", F.lit('","aggregateRating":{"ratingValue":1,"reviewCount":1}}</script><a href="/game/x/critic-reviews/?platform=pc"><div aria-label="Metascore"><span>'), _text(k % 100),
        F.lit('</span></div><div class="a review-count">Based on 1,'), F.lpad(_text(k % 100), 3, "0"), F.lit(' Reviews</div></a><div aria-label="User score"><span>'), _text(k % 10), F.lit(".7</span></div>"),
    )
    r = table(spark, d, "customer").select("c_custkey", review_pages.critics_page(page).alias("r"))
    return r.select("c_custkey", "r.name", F.col("r.metascore").alias("score"), F.col("r.criticReviews").alias("reviews"), F.col("r.userScore").alias("users"), "r.platform")


@query("""SELECT c_custkey, c_name || ' & co' AS name, 'Tough' AS difficulty, 'Average: ' || (c_custkey % 5) || ' stars' AS rating, NULL::VARCHAR AS length, 'May 5, 2010' AS released FROM customer""")
def hints_pages(spark, d):
    page = F.concat(F.lit('<h1 class="page-title">'), "c_name", F.lit(' &amp; co</h1><div title="Average: '), _text(F.col("c_custkey") % 5), F.lit(' stars"><a id="gs_rate_avg_hint">Great</a></div><div title="20 hours"><a id="gs_length_avg_hint">Unrated</a></div><div><a id="gs_difficulty_avg_hint">Tough (12%)</a></div><b>Release:</b> <a href="#">May 5, 2010</a>'))
    r = table(spark, d, "customer").select("c_custkey", review_pages.hints_page(page).alias("r"))
    return r.select("c_custkey", F.col("r.pageName").alias("name"), F.col("r.difficultyLabel").alias("difficulty"), F.col("r.ratingTitle").alias("rating"), F.col("r.lengthTitle").alias("length"), F.col("r.releaseRaw").alias("released"))


@query("""SELECT c_custkey, c_custkey AS n, c_name AS name FROM customer""")
def embedded_state(spark, d):
    page = F.concat(F.lit('<script id="other">{}</script><script id="__NEXT_DATA__" type="application/json">'), F.to_json(_o(props=_o(n=F.col("c_custkey"), name=F.col("c_name")))), F.lit("</script>"))
    r = table(spark, d, "customer").select("c_custkey", review_pages.next_data(page, "props struct<n: bigint, name: string>").alias("r"))
    return r.select("c_custkey", "r.props.n", "r.props.name")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE 'item-' || p_partkey END AS slug, ['item-' || p_partkey || '-dawn', 'item-' || p_partkey] AS guesses FROM part""")
def review_links(spark, d):
    """Slugs in all forms of links, and the addresses to try for a title."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("item-"), _text(k))
    link = F.element_at(F.array(F.concat(F.lit("https://www.metacritic.com/game/"), name, F.lit("/")), F.concat(F.lit("game/"), name), F.concat(F.lit("pc/"), name, F.lit("/x")), name, F.lit("")), (k % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", review_pages.review_id(link).alias("slug"), review_pages.slug_guesses(F.concat(F.lit("Item "), _text(k), F.lit(": Dawn"))).alias("guesses"))


# --- titles, numbers, lists --------------------------------------------------------------------------


@query("""SELECT p_partkey, p_name || ' Demo' AS fixed, p_partkey % 2 = 0 AS demo, lower(p_name) || ' and co' AS key, 'Part ' || ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][p_partkey % 9 + 1] AS roman, 'Part ' || (p_partkey % 9 + 1) AS digits FROM part""")
def title_tools(spark, d):
    k = F.col("p_partkey")
    udf = lambda f: F.pandas_udf(lambda s: s.map(f), "string")
    roman = F.element_at(F.array(*[F.lit(f"Part {names.to_roman(i)}") for i in range(1, 10)]), (k % 9 + 1).cast("int"))
    return table(spark, d, "part").select(
        "p_partkey", names.fix_name(F.concat(F.lit(" "), "p_name", F.lit(" Demo "))).alias("fixed"), names.is_demo(F.concat("p_name", F.when(k % 2 == 0, " Demo").otherwise(" Demos"))).alias("demo"),
        names.match_key(F.concat(F.upper("p_name"), F.lit(" &amp; Co™"))).alias("key"), udf(names.swap_number)(F.concat(F.lit("Part "), _text(k % 9 + 1))).alias("roman"), udf(names.swap_roman)(roman).alias("digits"),
    )


@query("""SELECT p_partkey, p_partkey * 1500000 AS owners, p_partkey AS cents, p_partkey AS whole, p_partkey + 0.25 AS number, CASE WHEN p_partkey % 2 = 0 THEN ['WIN', 'LNX'] ELSE ['MAC'] END AS platforms FROM part""")
def parsed_numbers(spark, d):
    k = F.col("p_partkey")
    span = F.concat(F.format_number(k * 1000000, 0), F.lit("&nbsp;..&nbsp;"), F.format_number(k * 2000000, 0))
    systems = F.when(k % 2 == 0, F.array(F.lit("lnx"), F.lit(" Win"), F.lit("amiga"))).otherwise(F.array(F.lit("mac"), F.lit("MAC")))
    return table(spark, d, "part").select(
        "p_partkey", scalars.owners_midpoint(span).alias("owners"), scalars.money_cents(F.concat(_text(k), F.lit(" USD"))).alias("cents"), scalars.first_int(F.concat(F.lit("about "), _text(k), F.lit(" of 9"))).alias("whole"),
        scalars.first_number(F.concat(F.lit("x "), _text(k), F.lit(".25 hours"))).alias("number"), scalars.ordered_subset(systems, ["WIN", "MAC", "LNX"]).alias("platforms"),
    )


@query("""WITH m AS (SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 500 END AS then_, o_orderkey % 700 AS ever FROM orders),
s AS (SELECT o_custkey, CASE WHEN then_ > 0 THEN then_ WHEN ever > 0 THEN ever END AS used, CASE WHEN ever > 0 THEN ever END AS ever FROM m)
SELECT o_custkey, CAST(count(used) AS INTEGER) AS n, quantile_cont(CAST(used AS DOUBLE), 0.5) AS median, quantile_cont(CAST(used AS DOUBLE), 0.25) AS p25, quantile_cont(CAST(used AS DOUBLE), 0.75) AS p75, quantile_cont(CAST(ever AS DOUBLE), 0.5) AS median_forever FROM s GROUP BY 1""")
def review_playtime(spark, d):
    k = F.col("o_orderkey")
    reviews = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.when(k % 3 != 0, k % 500).otherwise(0).alias("at_review"), (k % 700).alias("forever"))).alias("r"))  # a page of reviews an item
    s = reviews.select("o_custkey", scalars.playtime_summary(F.col("r")).alias("s"))
    return s.select("o_custkey", F.coalesce("s.count", F.lit(0)).alias("n"), "s.median", "s.p25", "s.p75", "s.median_forever")


# --- links -------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 13 < 7 WHEN p_partkey % 4 = 3 THEN false ELSE true END AS same FROM part""")
def page_match(spark, d):
    """Titles equal, with or without subtitle; years from one before the page's to five after it."""
    k = F.col("p_partkey")
    page = F.concat("p_name", F.when(k % 4 == 1, ": Dawn").when(k % 4 == 3, " II").otherwise(""))
    years = F.when(k % 4 == 0, F.array((2000 - 5 + k % 13).cast("int"))).otherwise(F.array().cast("array<int>"))
    return table(spark, d, "part").select("p_partkey", linking.page_matches(page, F.lit(2000), F.col("p_name"), years, before=1, after=5).alias("same"))


@query("""SELECT p_partkey AS t, CASE p_partkey % 5 WHEN 0 THEN p_partkey * 10 WHEN 1 THEN NULL WHEN 2 THEN p_partkey * 10 + 1 WHEN 3 THEN p_partkey * 10 ELSE NULL END AS match_id, CASE p_partkey % 5 WHEN 1 THEN 'ambiguous' WHEN 4 THEN 'none' ELSE 'match' END AS decision, CASE WHEN p_partkey % 5 IN (3, 4) THEN 'fuzzy' ELSE 'exact' END AS method FROM part""")
def store_decision(spark, d):
    """One equal title; one of a year too far off; two equal ones with one near year; a likely one with a common maker; an unlikely one."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    key = F.concat(F.lit("the long title of number "), _text(k))
    targets = p.select(k.alias("t"), key.alias("key"), F.when(k % 5 != 3, 2000).alias("year"), F.array(F.lit("X")).alias("makers"))
    first = p.select((k * 10).alias("c"), k.alias("of"), F.when(k % 5 == 3, F.concat(key, F.lit("s"))).when(k % 5 == 4, F.concat(F.lit("else "), F.reverse(key))).otherwise(key).alias("key"), F.when(k % 5 == 1, 2004).when(k % 5 == 2, 2010).otherwise(2001).alias("year"), F.array(F.lit("X")).alias("makers"))
    second = p.where("p_partkey % 5 = 2").select((k * 10 + 1).alias("c"), k.alias("of"), key.alias("key"), F.lit(1999).alias("year"), F.array(F.lit("Y")).alias("makers"))
    candidates = first.unionByName(second)
    pairs = candidates.select(F.col("of").alias("__t"), F.col("c").alias("__c"))
    scored = linking.scored_pairs(targets, candidates.drop("of"), pairs, target_id="t", candidate_id="c")
    return linking.decide_store(scored, target_id="t", candidate_id="c", makers="makers")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS external_id, CASE WHEN p_partkey % 9 < 6 THEN p_partkey END AS item_id, ['attach', 'attach', 'attach', 'conflict', 'attach', 'conflict', 'purged', 'non_item', 'create'][p_partkey % 9 + 1] AS status,
['store', 'store', 'wikidata', NULL, 'name', NULL, NULL, NULL, 'store'][p_partkey % 9 + 1] AS method, [100, 100, 95, NULL, 80, NULL, NULL, NULL, 100][p_partkey % 9 + 1] AS confidence FROM part""")
def attach_ladder(spark, d):
    """Every rung: own id, slug, link, another product's id, title, ambiguous title, purged, other class, new."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    rung, id_ = k % 9, _text(k)
    products = p.select(id_.alias("external_id"), F.concat(F.lit("s"), id_).alias("slug"), F.when(rung == 7, "dlc").alias("class"), (rung == 6).alias("purged"))
    items = p.where(rung < 6).select(k.alias("id"), F.when(rung == 0, id_).when(rung == 3, "other").alias("shop_id"), F.when(rung.isin(1, 3), F.concat(F.lit("s"), id_)).alias("shop_slug"))
    links = p.where(rung.isin(2, 8)).select(k.alias("item_id"), F.concat(F.lit("s"), id_).alias("external_id"), F.when(rung == 2, "wikidata").otherwise("guess").alias("method"))
    named = p.where(rung > 3).select(id_.alias("external_id"), k.alias("item_id"), F.when(rung == 4, "match").when(rung == 5, "ambiguous").otherwise("none").alias("decision"), F.lit(80).alias("confidence"))
    return linking.attach_ladder(products, items, links, named)


@query("""SELECT p_partkey AS id, 's' || (p_partkey // 3) AS slug, CASE WHEN p_partkey // 3 % 2 = 1 AND p_partkey % 3 = 1 THEN 'set' ELSE 'collision' END AS action FROM part WHERE p_partkey % 3 > 0""")
def slug_backfill(spark, d):
    """Three items ask for one slug: in every other group the first holds it already, in the rest it asks for nothing."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    group = F.floor(k / 3)
    slug = F.concat(F.lit("s"), _text(group))
    items = p.select(k.alias("id"), F.when((group % 2 == 0) & (k % 3 == 0), slug).alias("slug"))
    return linking.backfilled_slugs(items, p.where("p_partkey % 3 > 0").select(k.alias("id"), slug.alias("slug")))


# --- visibility, published rows ----------------------------------------------------------------------


@query("""SELECT p_partkey, p_partkey % 2 = 1 AND p_partkey % 3 > 0 AND p_partkey % 5 > 0 AS found, p_partkey % 3 > 0 AND p_partkey % 5 > 0 AND p_partkey % 101 <> 100 AS exported FROM part""")
def visibility(spark, d):
    k = F.col("p_partkey")
    non_item, sold = F.when(k % 3 == 0, "dlc"), k % 5 > 0
    return table(spark, d, "part").select("p_partkey", publishing.visible(k % 2 == 0, non_item, sold).alias("found"), facets.export_visible(non_item, sold, F.when(k % 101 > 0, k % 101)).alias("exported"))


@query("""SELECT p_partkey AS id FROM part WHERE p_size >= 5 AND p_partkey % 3 > 0 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)""")
def library_items(spark, d):
    """Items of a user's library that have a score."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")).alias("score"))
    owned = table(spark, d, "lineitem").where("l_quantity = 50").select("l_partkey").distinct()
    return facets.select_rows(p, facets.Facets(ranges={"p_size": (5, 10**6)}, not_null=["score"], library=owned)).select("id")


@query("""SELECT p_partkey AS id, p_partkey % 4 = 0 AS base_exists FROM part""")
def bundle_bases(spark, d):
    """Bundles whose base item is listed as an item proper of its own."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    title = F.concat(F.lit("Tale of "), _text(k))
    listed = p.select(k.alias("id"), F.when(k % 4 < 3, F.concat(title, F.lit(" + Soundtrack"))).otherwise(title).alias("name"))
    items = p.select((k + F.when(k % 4 == 1, 0).otherwise(1000000)).alias("id"), title.alias("name_normalized"), F.when(k % 4 == 2, "dlc").alias("non_game"))
    return classify.with_base_exists(listed, items).select("id", "base_exists")


_ITEMS_SQL = """games AS (SELECT p_partkey AS k, p_name, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS price, p_size FROM part)"""


def _items(spark, d):
    """Items with all columns that are published."""
    k, none = F.col("p_partkey"), F.lit(None)
    cents = scalars.round_up_half(F.col("p_retailprice") * 100)
    columns = {
        "id": k, "kind": F.lit("game"), "name": F.col("p_name"), "image": none.cast("string"), "description_en": F.concat(F.lit("<p>"), "p_name", F.lit("</p>")), "description_ru": F.when(k % 2 == 0, F.concat(F.lit("ru "), "p_name")).otherwise(""),
        "steam_appid": k * 10, "gog_id": F.when(k % 3 == 0, k), "release_date": F.lit("2001-02-03"), "release_precision": F.when(k % 2 == 0, "day"), "early_access_date": none.cast("string"), "store_release_date": F.lit("2001-02-04"),
        "price_usd": cents, "price_final_usd": cents - 1, "discount_usd": F.when(k % 11 == 0, 100).otherwise(F.when(k % 2 == 0, 5)), "price_rub": cents * 90, "price_final_rub": cents * 90, "discount_rub": F.lit(0), "price_cis_usd": cents, "price_final_cis_usd": cents, "discount_cis_usd": F.lit(0),
        "platforms": F.when(k % 2 == 0, "WIN,MAC"), "developers": F.concat(F.lit("|"), "p_brand", F.lit("|Other|")), **{c: none.cast("string") for c in ("publishers", "languages", "voiceovers", "categories", "tags")}, "genres": F.lit("|A|"), "achievements": k % 7,
        "score_steam": k % 101, "score_steam_votes": k % 600, "score_steam_recent": k % 101, "score_steam_recent_votes": k % 20, "owners_estimate": k * 100, "time_average": F.lit(1.5), "time_average_source": F.lit("steam"), "time_main": F.lit(2.0), "time_complete": F.lit(3.0), "final_time": F.lit(2),
        "difficulty": F.lit("Tough"), "score_gamefaqs": F.lit(4.2), "score_critics": k % 100, "score_critics_source": F.when(k % 2 == 0, "metacritic").otherwise("opencritic"), "score_critics_count": k % 30, "score_users_metacritic": F.lit(80), "score_igdb": F.lit(70), "score_igdb_users": F.lit(71), "score_gamerankings": F.lit(72),
        "gg_score": k % 100, "ggp": F.lit(40), "updated_at": F.lit("2026-01-02 03:04:05").cast("timestamp_ntz"), "non_game": F.when(k % 13 == 0, "dlc"), "purchasable": k % 17 != 0,
    }
    return table(spark, d, "part").select(*[v.alias(c) for c, v in columns.items()])


def _item_links(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    of = lambda source, at, tail="": p.select(k.alias("game_id"), F.lit(source).alias("source"), F.concat(F.lit(f"https://{source}{tail}/"), _text(k)).alias("url"), F.lit(at).alias("updated_at"))
    return of("steam", 1, "/old").unionByName(of("steam", 2)).unionByName(of("hltb", 1).where("game_id % 2 = 0")).unionByName(of("wikipedia_en", 1)).unionByName(of("wikipedia_ru", 1).where("game_id % 2 = 0"))


@query(f"""WITH {_ITEMS_SQL} SELECT 51 AS width, k AS id, k * 10 AS steam_appid, 'https://steam/' || k AS steam_url, NULL::VARCHAR AS gog_url, CASE WHEN k % 2 = 0 THEN 'https://hltb/' || k END AS hltb_url, price AS price_usd, CASE WHEN k % 2 = 0 THEN 5 END AS discount_percent, CASE WHEN k % 2 = 0 THEN ['WIN', 'MAC'] ELSE [] END AS platforms, len(string_split(p_name, ' ')) + 0 AS words,
['A'] AS genres, CAST([] AS VARCHAR[]) AS tags, CASE WHEN k % 2 = 0 THEN k % 100 END AS metacritic_score, CASE WHEN k % 2 = 0 THEN k % 30 END AS metacritic_reviews, CASE WHEN k % 20 < 10 THEN NULL WHEN k % 101 >= 80 THEN 'Positive' WHEN k % 101 >= 70 THEN 'Mostly Positive' WHEN k % 101 >= 40 THEN 'Mixed' WHEN k % 101 >= 20 THEN 'Mostly Negative' ELSE 'Negative' END AS steam_recent_label, 40 AS gg_points, '2026-01-02T03:04:05Z' AS updated_at
FROM games WHERE k % 13 <> 0 AND k % 17 <> 0 AND k % 11 <> 0""")
def published_rows(spark, d):
    rows = publishing.export_rows(_items(spark, d), _item_links(spark, d))
    shown = "id steam_appid steam_url gog_url hltb_url price_usd discount_percent platforms genres tags metacritic_score metacritic_reviews steam_recent_label gg_points updated_at".split()
    return rows.select(F.lit(len(rows.columns)).alias("width"), F.size(F.split("name", " ")).alias("words"), *shown)


@query(f"""WITH {_ITEMS_SQL} SELECT k AS id, CASE WHEN k % 2 = 0 THEN 'ru ' || p_name ELSE p_name END AS description, CASE WHEN k % 2 = 0 THEN 'day' ELSE 'unknown' END AS precision, price * 90 AS amount, 'RUB' AS currency, CASE WHEN k % 20 >= 10 THEN k % 20 END AS recent_votes, k % 600 AS votes, CASE WHEN k % 2 = 0 THEN 'https://wikipedia_ru/' || k ELSE 'https://wikipedia_en/' || k END AS wiki, 'https://steam/' || k AS steam, 2 AS makers FROM games""")
def item_cards(spark, d):
    c = publishing.cards(_items(spark, d), _item_links(spark, d), lang="ru")
    reviews = F.col("scores.steamReviews")
    return c.select("id", "description", "release.precision", "price.amount", "price.currency", reviews["recent"]["votes"].alias("recent_votes"), reviews["all"]["votes"].alias("votes"), F.col("links.wikipedia").alias("wiki"), F.col("links.steam").alias("steam"), F.size("developers").alias("makers"))


@query("""SELECT p_partkey AS game_id, CASE WHEN p_partkey % 4 = 3 THEN 'legacy' WHEN p_partkey % 4 = 2 THEN 'gog' ELSE 'steam' END AS store, CASE WHEN p_partkey % 4 = 1 THEN 'gog name' WHEN p_partkey % 4 = 2 THEN 'gog name' WHEN p_partkey % 4 = 3 THEN 'old name' ELSE p_name END AS name, CASE WHEN p_partkey % 4 IN (0, 3) THEN 100 ELSE 200 END AS price FROM part""")
def picked_store(spark, d):
    """Steam with all; Steam without name and price beside GOG; GOG alone; only the legacy snapshot with a store release."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    money = lambda cents: F.struct(*[F.struct((F.lit(cents) if r == "usd" else F.lit(None)).cast("bigint").alias("initial"), F.lit(None).cast("bigint").alias("final")).alias(r) for r in ("usd", "rub", "cis_usd")])
    none = F.lit(None).cast("struct<usd: struct<initial: bigint, final: bigint>, rub: struct<initial: bigint, final: bigint>, cis_usd: struct<initial: bigint, final: bigint>>")
    row = lambda source, name, price, released: p.select(k.alias("game_id"), F.lit(source).alias("source"), fusion.source_priority(F.lit(source)).alias("priority"), name.alias("name"), price.alias("prices"), released.alias("store_release"))
    steam = row("steam", F.when(k % 4 == 0, F.col("p_name")).otherwise(""), F.when(k % 4 == 0, money(100)).otherwise(money(0)), F.lit(None).cast("string")).where("game_id % 4 < 2")
    gog = row("gog", F.lit("gog name"), money(200), F.lit(None).cast("string")).where("game_id % 4 IN (1, 2)")
    old = row("legacy", F.lit("old name"), money(100), F.lit("2001"))
    other = row("igdb", F.lit("igdb name"), none, F.lit(None).cast("string"))
    found = fusion.store_fields(steam.unionByName(gog).unionByName(old).unionByName(other), fields=("name",))
    return found.select("game_id", "store", "name", F.col("prices.usd.initial").cast("int").alias("price"))


# --- tables and files --------------------------------------------------------------------------------


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'fresh' ELSE 'old' END AS payload, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 2 = 0 THEN 'open' ELSE 'accepted' END AS status FROM customer""")
def reopened_conflicts(spark, d):
    k = F.col("c_custkey")
    old = table(spark, d, "customer").select("c_custkey", F.lit("old").alias("payload"), F.when(k % 2 == 0, "open").otherwise("accepted").alias("status"))
    return incremental.reopened(old, old.where(k % 3 == 0).select("c_custkey", F.lit("fresh").alias("payload")), ["c_custkey"], "payload")


@query("""SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer""")
def json_export(spark, d):
    """The gzip JSON export, read back."""
    path = jobs.shared_path(spark, "json")
    reports.write_json(table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment")), path, gzip=True)
    return spark.read.schema("c_custkey bigint, c_name string, segment string").json(path)


@query("""SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1""")
def names_export(spark, d):
    path = jobs.shared_path(spark, "names")
    reports.write_names(table(spark, d, "part"), path, "p_name")
    return spark.read.text(path).groupBy(F.col("value").alias("name")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 300 > 200 THEN 'trim' WHEN o_orderkey % 300 > 50 THEN 'skip' ELSE 'enqueue' END AS verdict FROM orders""")
def back_pressure(spark, d):
    return table(spark, d, "orders").select("o_orderkey", sequences.backlog(F.col("o_orderkey") % 300, 100).alias("verdict"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 1950 + c_custkey % 70 END AS year FROM customer""")
def years(spark, d):
    k = F.col("c_custkey")
    shown = F.when(k % 3 == 0, F.concat(_text(1950 + k % 70), F.lit("-02-03"))).when(k % 3 == 1, _text(1950 + k % 70)).otherwise(F.element_at(F.array(F.lit("0000-01-01"), F.lit("19777"), F.lit("soon"), F.lit(None)), (k % 4 + 1).cast("int")))
    return table(spark, d, "customer").select("c_custkey", scalars.year_of(shown).alias("year"))


@query("""SELECT event_id, EXISTS (SELECT 1 FROM events b WHERE b.user_id = e.user_id AND b.event_type = 'error' AND b.ts < e.ts AND e.ts < b.ts + INTERVAL 3 HOURS) AS paused FROM events e""")
def timed_pause(spark, d):
    """Events that meet a source held up by an error of the three hours before."""
    return sequences.with_pause(table(spark, d, "events"), "user_id", "ts", F.col("event_type") == "error", 3).select("event_id", "paused")


@query("""SELECT CAST(row_number() OVER (ORDER BY n) AS INTEGER) AS place, 'Theme' || n || '-x.mp3' AS name FROM (SELECT DISTINCT p_size AS n FROM part)""")
def theme_listing(spark, d):
    sizes = table(spark, d, "part").select("p_size").distinct()
    names_ = sizes.select(F.explode(F.array(*[F.concat(F.lit(head), _text("p_size"), F.lit(tail)) for head, tail in (("Theme", "-x.mp3"), ("theme", ".txt"), ("other", ".ogg"))])).alias("name"))
    return ranking.natural_listing(names_, r"theme[\w-]*\.(mp3|ogg|m4a)")


@query("""SELECT o_custkey AS preset, o_orderkey AS item FROM orders WHERE o_custkey % 3 > 0 UNION ALL SELECT DISTINCT o_custkey, -1 FROM orders WHERE o_custkey % 6 = 0""")
def preset_replacement(spark, d):
    """A third of the presets is replaced: half of these by one item that is given twice, the rest by nothing."""
    old = table(spark, d, "orders").select(F.col("o_custkey").alias("preset"), F.col("o_orderkey").alias("item"))
    new = old.where("preset % 3 = 0").select("preset", F.when(F.col("preset") % 6 == 0, -1).cast("bigint").alias("item"))
    return incremental.replaced_members(old, new.unionByName(new), "preset")


@query("""SELECT o_orderpriority AS source, count(*) * 2 AS rolls, CAST(count(*) * 6 AS BIGINT) AS items FROM orders GROUP BY 1""")
def roll_log(spark, d):
    """Two appends to the log of rolls, each with its list of items."""
    path, k = jobs.shared_path(spark, "rolls"), F.col("o_orderkey")
    rolls = table(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), F.array(k, k + 1, k + 2).alias("items"))
    for _ in range(2):
        incremental.append_rows(rolls, path)
    log = spark.read.parquet(path)
    return log.groupBy("source").agg(F.count("*").alias("rolls"), F.sum(F.size("items")).alias("items"))


@query("""WITH s(source) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('9-NONE')), c AS (SELECT o_orderpriority AS source, count(*) FILTER (o_orderstatus = 'O') AS ok, count(*) FILTER (o_orderstatus = 'F') AS error, count(DISTINCT o_custkey) AS covered FROM orders GROUP BY 1)
SELECT s.source, coalesce(ok, 0) AS ok, coalesce(error, 0) AS error, coalesce(covered, 0) AS covered, s.source = '2-HIGH' AS paused FROM s LEFT JOIN c USING (source)""")
def sources_report(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "source")
    fixed = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("9-NONE",)], "source string")
    statuses = reports.counters(o, "source", {"ok": F.col("o_orderstatus") == "O", "error": F.col("o_orderstatus") == "F"})
    covered = reports.covered(o, o.select("o_custkey"), "source", "o_custkey")
    return reports.source_status(fixed, statuses, covered, spark.createDataFrame([("2-HIGH", True)], "source string, paused boolean"))

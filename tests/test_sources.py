"""Extractors on own small payloads in the sources' shapes."""

import datetime
import json

from pyspark.sql import functions as F

from tessera.sources import extractors, review_pages


def extract(spark, name, payload):
    row = spark.createDataFrame([(json.dumps(payload),)], "p string").select(extractors.EXTRACTORS[name](F.col("p")).alias("f")).first()["f"]
    return {k: v for k, v in row.asDict(recursive=True).items() if v is not None}


def test_steam(spark):
    payload = {
        "appid": "10", "en": {"name": "Tiny", "steam_appid": 10, "is_free": False, "short_description": "A<br>B", "supported_languages": "English<strong>*</strong>, German<br><strong>*</strong>audio", "developers": ["D", " "], "price_overview": {"initial": 999, "final": 499, "discount_percent": 50},
        "package_groups": [], "platforms": {"windows": True, "mac": False, "linux": True}, "genres": [{"id": "70", "description": "Early Access"}], "release_date": {"coming_soon": False, "date": "8 Nov, 2011"}, "recommendations": {"total": 7}, "metacritic": {"score": 81, "url": "u"}},
        "reviews": {"success": 1, "query_summary": {"total_positive": 2, "total_reviews": 3}}, "recentReviews": {"positive": 0, "negative": 4}, "reviewsPlaytime": {"count": 5, "medianAtReview": 90.0},
    }
    f = extract(spark, "steam", payload)
    day = {"date": datetime.date(2011, 11, 8), "precision": "day"}
    assert f["languages"] == ["English", "German"] and f["voiceovers"] == ["English"] and f["platforms"] == ["WIN", "LNX"] and f["developers"] == ["D"]
    assert f["store_release"] == f["early_access"] == day and f["prices"]["usd"] == {"initial": 999, "final": 499, "discount": 50} and f["steam_purchasable"] is True
    assert (f["score_steam"], f["score_steam_votes"], f["score_steam_recent"], f["score_steam_recent_votes"]) == (67, 3, 0, 4) and f["playtime_review_minutes"] == 90
    assert f["links"] == {"metacritic": {"id": None, "url": "u"}} and f["description_en"] == "A\nB" and f["score_critics_source"] == "metacritic"
    assert extract(spark, "steam", {"appid": "1"}) == {}
    assert extract(spark, "steam", {"en": {"name": "x", "release_date": {"coming_soon": True}}})["steam_purchasable"] is True


def test_gog(spark):
    named = lambda *n: [{"name": x} for x in n]
    payload = {
        "en": {"overview": "<b>O</b>", "_links": {"store": {"href": "https://www.gog.com/en/game/tiny_game"}}, "_embedded": {"product": {"id": 7, "title": "Tiny &amp; Co", "isAvailableForSale": False}, "developers": named("D", "D"), "tags": named("T"),
        "supportedOperatingSystems": [{"operatingSystem": {"name": "windows"}}, {"operatingSystem": {"name": "osx"}}], "localizations": [{"_embedded": {"language": {"name": "English"}, "localizationScope": {"type": t}}} for t in ("text", "audio")]}},
        "pricesUsd": {"_embedded": {"prices": [{"currency": {"code": "USD"}, "basePrice": "2000 USD", "finalPrice": "500 USD"}]}}, "catalog": {"releaseDate": "2014.05.06"},
    }
    f = extract(spark, "gog", payload)
    assert f["name"] == "Tiny & Co" and f["gog_slug"] == "tiny_game" and f["platforms"] == ["WIN", "MAC"] and f["developers"] == ["D"] and f["genres"] == f["tags"] == ["T"]
    assert f["prices"]["usd"] == {"initial": 2000, "final": 500, "discount": 75} and f["is_free"] is False and f["gog_purchasable"] is True and f["languages"] == f["voiceovers"] == ["English"]
    assert f["store_release"]["date"] == datetime.date(2014, 5, 6)


def test_databases(spark):
    game = {"name": "G", "first_release_date": 1700000000, "release_dates": [{"date": 1700000000, "date_format": 2}], "aggregated_rating": 80.5, "involved_companies": [{"company": {"name": "C"}, "developer": True}], "external_games": [{"uid": "10", "category": 1}], "websites": [{"url": "w", "type": 3}]}
    f = extract(spark, "igdb", {"game": game, "timeToBeat": {"hastily": 3600, "completely": 7200}})
    assert f["release"] == {"date": datetime.date(2023, 11, 14), "precision": "year"} and f["score_igdb"] == 81 and f["developers"] == ["C"] and (f["time_main"], f["time_complete"]) == (1.0, 2.0)
    assert f["links"]["steam"]["id"] == "10" and f["links"]["wikipedia"]["url"] == "w"
    f = extract(spark, "steamspy", {"appid": 1, "name": "n", "positive": 3, "negative": 0, "owners": "20,000 .. 50,000", "median_forever": 0, "average_forever": 5, "tags": {"b": 1, "a": 9}})
    assert (f["score_steam"], f["score_steam_votes"], f["owners_estimate"]) == (75, 3, 35000) and f["tags"] == ["a", "b"] and "playtime_median" not in f and f["playtime_mean"] == 5
    f = extract(spark, "hltb", {"release_na": "2013-07-09", "comp_main": 30600, "comp_100": 0, "profile_steam": 4242})
    assert f["time_main"] == 8.5 and "time_complete" not in f and f["links"]["steam"]["id"] == "4242" and f["release"]["precision"] == "day"
    f = extract(spark, "gamerankings", {"id": "1", "platform": "PC", "score": 90.5, "reviews": 2, "path": "/pc/1"})
    assert f["score_gamerankings"] == 91 and f["links"]["gamefaqs"]["id"] == "1"
    assert extract(spark, "gamerankings", {"score": 90, "reviews": 0}) == {}


def test_reviews(spark):
    f = extract(spark, "metacritic", {"slug": "s", "url": "u", "metascore": 77, "criticReviews": 10, "userScore": 88, "datePublished": "2013-07-08"})
    assert (f["score_critics"], f["score_critics_count"], f["score_users"]) == (77, 10, 88) and f["links"]["metacritic"] == {"id": "s", "url": "u"}
    f = extract(spark, "gamefaqs", {"pid": "9", "url": "u", "difficultyLabel": "Tough", "ratingTitle": "4.36 out of 5", "lengthTitle": "38.7 hours"})
    assert (f["difficulty"], f["score_gamefaqs"], f["time_gamefaqs"]) == ("Tough", 4.36, 38.7)


def test_wikidata_and_legacy(spark):
    v = lambda x: {"type": "literal", "value": x}
    f = extract(spark, "wikidata", {"item": v("http://x/Q1"), "steamId": v("5"), "gogId_": v("game/g"), "wikiEnTitle_": v("A B"), "pubDates": v("2011-05-00|9||2010-03-04T00:00:00Z|10||1999-01-01|7"), "developers": v("X|Y|X")})
    assert f["release"] == {"date": datetime.date(2010, 3, 1), "precision": "month"} and f["links"]["gog"]["id"] == "g" and f["links"]["wikipedia_en"]["url"].endswith("/A_B") and f["steam_appid"] == 5
    f = extract(spark, "legacy", {"sid": "12", "store_platform": "Steam", "store_url": "s", "developers": "Big Games, Inc., Small, Ltd", "genres": "A, B,", "published_meta": "2001-02-03", "price_en": 100, "meta_score": 70})
    assert f["developers"] == ["Big Games, Inc.", "Small, Ltd"] and f["genres"] == ["A", "B"] and f["steam_appid"] == 12 and f["prices"]["usd"]["initial"] == 100
    assert f["release_candidates"][0]["release"]["date"] == datetime.date(2001, 2, 3) and f["score_critics_source"] == "metacritic"


def test_long_form_and_bad_payloads(spark):
    rows = [(1, "steam", json.dumps({"en": {"name": "A"}})), (1, "hltb", "{broken"), (2, "nowhere", "{}"), (3, "steam", None)]
    out = extractors.extracted(spark.createDataFrame(rows, "game_id int, source string, payload string")).collect()
    assert sorted((r["game_id"], r["source"], r["name"]) for r in out) == [(1, "hltb", None), (1, "steam", "A"), (3, "steam", None)]


def test_bindings_file(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"results": {"bindings": [{"item": {"value": "a"}}, {"item": {"value": "b"}}]}}))
    got = extractors.bindings(spark, str(tmp_path)).select(F.get_json_object("payload", "$.item.value")).collect()
    assert sorted(r[0] for r in got) == ["a", "b"]


def test_review_pages(spark):
    page = """<title>Tiny Reviews - Metacritic</title><script type="application/ld+json">{"@type":"VideoGame","name":"Tiny","datePublished":"2011-01-02","aggregateRating":{"ratingValue":90,"reviewCount":12}}</script>
    <a class="product-score-card" href="/game/tiny/critic-reviews/?platform=pc"><div aria-label="Metascore 88 out of 100"><span>88</span></div><div class="product-score-card__review-count">Based on 1,034 Reviews</div></a>
    <div data-testid="global-score-value-wrapper" aria-label="User score 8.7 out of 10"><span>8.7</span></div> Based on 2,345 User Ratings"""
    df = spark.createDataFrame([(page,)], "h string")
    r = df.select(review_pages.critics_page(F.col("h")).alias("r")).first()["r"]
    assert (r["name"], r["datePublished"], r["metascore"], r["criticReviews"], r["userScore"], r["userRatings"], r["platform"]) == ("Tiny", "2011-01-02", 88, 1034, 87, 2345, "pc")
    hints = '<h1 class="page-title">Tiny</h1><div title="Average: 4.2 stars"><a id="gs_rate_avg_hint">Great</a></div><div title="20 hours"><a id="gs_length_avg_hint">Unrated</a></div><div><a id="gs_difficulty_avg_hint">Tough (12%)</a></div><aside><div class="content"><b>Release:</b> <a href="#">May 5, 2010</a></div></aside>'
    r = spark.createDataFrame([(hints,)], "h string").select(review_pages.hints_page(F.col("h")).alias("r")).first()["r"]
    assert (r["pageName"], r["difficultyLabel"], r["ratingTitle"], r["lengthTitle"], r["releaseRaw"]) == ("Tiny", "Tough", "Average: 4.2 stars", None, "May 5, 2010")
    ids = spark.createDataFrame([("https://www.metacritic.com/game/tiny/",), ("game/tiny",), ("pc/tiny/x",), ("tiny",), ("",)], "l string").select(review_pages.review_id(F.col("l"))).collect()
    assert [r[0] for r in ids] == ["tiny"] * 4 + [None]
    g = spark.createDataFrame([("Tiny’s Quest: Dawn",)], "n string").select(review_pages.slug_guesses(F.col("n"))).first()[0]
    assert g == ["tinys-quest-dawn", "tiny-s-quest-dawn", "tiny-s-quest"]


def parses(spark, name, schema="k long, payload string"):
    """How often the plan of a source's projection parses the payload, with a field read three times, and the plan's length."""
    read = extractors.projected(spark.createDataFrame([(1, "{}")], schema), name, keep=("k",)).select("k", "name", "links", "links.steam.id", "links.gog.id", "release.date", "release.precision", "store_release.date", "prices", "prices.usd.initial", "prices.usd.final", "description_en")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = read._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    return plan.count("from_json("), len(plan)


def test_igdb_parses_once(spark):
    assert parses(spark, "igdb")[0] == 1


def test_gog_parses_once(spark):
    parsed, length = parses(spark, "gog")
    assert parsed == 1 and length < 60000


def test_steam_parses_once(spark):
    parsed, length = parses(spark, "steam")
    assert parsed == 1 and length < 60000


def test_wikidata_parses_once(spark):
    assert parses(spark, "wikidata")[0] == 1

"""One projection for each source: JSON payload -> the common vocabulary of extracted fields.

Every extractor is a Column from a JSON text; unknown keys are ignored, and a payload that is no JSON gives nulls (PERMISSIVE).  On tables use `projected`,
which parses a payload once and works out only the fields that are read; a value that a field names several times is computed once (`let`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import names, scalars
from tessera.functions.dates import parse_date
from tessera.functions.html import html_text
from tessera.functions.scalars import let
from tessera.operators.fusion import source_priority

_DATE = "struct<date: date, precision: string>"
_MONEY = "struct<initial: bigint, final: bigint, discount: bigint>"
_LIST = "array<string>"
VOCABULARY: dict[str, str] = {
    "name": "string", "image": "string", "description_en": "string", "description_ru": "string", "steam_appid": "bigint", "gog_id": "string", "gog_slug": "string",
    "store_release": _DATE, "release": _DATE, "early_access": _DATE, "release_candidates": f"array<struct<source: string, kind: string, release: {_DATE}>>",
    "is_free": "boolean", "prices": f"struct<usd: {_MONEY}, rub: {_MONEY}, cis_usd: {_MONEY}>", "steam_purchasable": "boolean", "gog_purchasable": "boolean",
    "platforms": _LIST, "developers": _LIST, "publishers": _LIST, "genres": _LIST, "categories": _LIST, "tags": _LIST, "languages": _LIST, "voiceovers": _LIST,
    "achievements": "bigint", "links": "map<string, struct<id: string, url: string>>", "difficulty": "string", "owners_estimate": "bigint",
    "score_steam": "bigint", "score_steam_votes": "bigint", "score_steam_recent": "bigint", "score_steam_recent_votes": "bigint", "score_critics": "double", "score_critics_count": "bigint",
    "score_critics_source": "string", "score_users": "double", "score_igdb": "bigint", "score_igdb_users": "bigint", "score_gamerankings": "bigint", "score_gamefaqs": "double",
    "time_main": "double", "time_complete": "double", "time_main_igdb": "double", "time_complete_igdb": "double", "time_gamefaqs": "double",
    "playtime_review_minutes": "double", "playtime_review_count": "bigint", "playtime_review_p25": "double", "playtime_review_p75": "double", "playtime_median": "double", "playtime_mean": "double",
}
EARLY_ACCESS_GENRE = "70"  # a fixed value
# The stores' names of systems, the game database's forms of dates, and legal forms of companies.
PLATFORMS = {"windows": "WIN", "mac": "MAC", "osx": "MAC", "linux": "LNX"}
DATE_FORMATS = {0: "day", 1: "month", 2: "year", 3: "quarter", 4: "quarter", 5: "quarter", 6: "quarter", 7: "unknown"}
# Numbers of the game database for stores and kinds of web sites.
EXTERNAL = {1: "steam", 5: "gog"}
WEBSITE = {1: "official", 3: "wikipedia", 17: "gog"}
COMPANY_SUFFIX = r"(?i)^(inc|incorporated|llc|l\.l\.c|ltd|limited|llp|co|corp|corporation|gmbh|ag|kg|ug|s\.?a|s\.?l|s\.?r\.?l|s\.?r\.?o|a\.?s|b\.?v|n\.?v|ab|oy|aps|pty|pty ltd|plc|sp\. z o\.o|sarl|sas|kft|d\.o\.o|co\., ?ltd)\.?$"


EXTRACTORS: dict[str, Callable[[Column], Column]] = {}


def register(name: str, extract: Callable[[Column], Column]) -> None:
    """Adds a source: a function from the payload column to a struct of VOCABULARY."""
    EXTRACTORS[name] = extract


def _source(schema: str):
    """Registers a source by a function from the parsed payload, a struct of the schema, to a struct of VOCABULARY."""

    def keep(fields: Callable[[Column], Column]) -> Callable[[Column], Column]:
        def extract(payload: Column) -> Column:
            return fields(F.from_json(payload, schema))

        extract.schema, extract.fields = schema, fields
        register(fields.__name__, extract)
        return extract

    return keep


def _fields(found: dict[str, Column], known: Column | None = None) -> Column:
    """The vocabulary; a field that was not found is null, and so are all where `known` is false."""
    value = lambda k: F.when(known, found[k]) if known is not None else found[k]
    return F.struct(*[(value(k) if k in found else F.lit(None)).cast(kind).alias(k) for k, kind in VOCABULARY.items()])


def _some(c: Column) -> Column:
    return let(c, lambda x: F.when(F.size(x) > 0, x))


def _texts(c: Column) -> Column:
    return _some(F.filter(c, lambda x: x.isNotNull() & (F.trim(x) != "")))


def _named(c: Column, key: str = "name") -> Column:
    return _some(F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x[key])), lambda x: x.isNotNull() & (x != ""))))


def _dated(release: Column) -> Column:
    return let(release, lambda r: F.when(r["date"].isNotNull(), r))


def _money(initial: Column, final: Column, discount: Column) -> Column:
    return F.when(initial.isNotNull() | final.isNotNull(), F.struct(initial.cast("bigint").alias("initial"), final.cast("bigint").alias("final"), discount.cast("bigint").alias("discount")))


def _prices(usd: Column, rub: Column, cis: Column | None = None) -> Column:
    cis = F.lit(None).cast(_MONEY) if cis is None else cis
    return F.when(usd.isNotNull() | rub.isNotNull() | cis.isNotNull(), F.struct(usd.alias("usd"), rub.alias("rub"), cis.alias("cis_usd")))


def _link(kind: Column | str, id_: Column, url: Column, when: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(when, F.struct(kind.alias("k"), F.struct(id_.cast("string").alias("id"), url.cast("string").alias("url")).alias("v")))


def _links(*links: Column) -> Column:
    return let(F.array_compact(F.array(*links)), lambda kept: F.when(F.size(kept) > 0, F.map_from_entries(kept)))


def languages(raw: Column) -> tuple[Column, Column]:
    """Languages of a store's HTML list, and those marked by an asterisk as spoken; notes after a line break do not count."""
    s = names.decode_entities(F.translate(raw, "[]", "<>"))
    s = F.regexp_replace(F.regexp_replace(F.split(s, r"(?i)<br\s*/?>")[0], "<[^>]+>", ""), "(?i)#lang_[^,]*,?", "")
    parts = F.split(s, ",")
    clean = lambda p: F.trim(F.replace(p, F.lit("*"), F.lit("")))
    spoken = F.filter(parts, lambda p: p.contains("*"))
    return _texts(F.transform(parts, clean)), _texts(F.transform(spoken, clean))


_STORE = """appid string, en struct<name: string, steam_appid: bigint, is_free: boolean, short_description: string, supported_languages: string, header_image: string, developers: array<string>, publishers: array<string>,
 price_overview: struct<initial: bigint, final: bigint, discount_percent: bigint>, package_groups: array<struct<name: string>>, platforms: struct<windows: boolean, mac: boolean, linux: boolean>, categories: array<struct<id: int, description: string>>,
 genres: array<struct<id: string, description: string>>, recommendations: struct<total: bigint>, achievements: struct<total: bigint>, metacritic: struct<score: double, url: string>, release_date: struct<coming_soon: boolean, date: string>>,
 ru struct<short_description: string, price_overview: struct<initial: bigint, final: bigint, discount_percent: bigint>>, az struct<price_overview: struct<initial: bigint, final: bigint, discount_percent: bigint>>,
 reviews struct<success: int, query_summary: struct<total_positive: bigint, total_reviews: bigint>>, reviewsPlaytime struct<count: bigint, medianAtReview: double, p25AtReview: double, p75AtReview: double>, recentReviews struct<positive: bigint, negative: bigint>"""


@_source(_STORE)
def steam(p: Column) -> Column:
    en, ru, az, summary, recent, played = p["en"], p["ru"], p["az"], p["reviews"]["query_summary"], p["recentReviews"], p["reviewsPlaytime"]
    price = lambda o: _money(o["initial"], o["final"], F.coalesce(o["discount_percent"], F.lit(0)))
    dated = en["release_date"]
    unknown = F.struct(F.lit(None).cast("date").alias("date"), F.lit("unknown").alias("precision"))
    store = F.when(F.coalesce(dated["coming_soon"], F.lit(False)), unknown).when(F.coalesce(dated["date"], F.lit("")) != "", parse_date(dated["date"]))
    early = F.exists(en["genres"], lambda g: g["id"] == EARLY_ACCESS_GENRE) | F.coalesce(F.exists(en["categories"], lambda c: F.lower(c["description"]).contains("early access")), F.lit(False))
    has_price = en["price_overview"]["initial"].isNotNull() | en["price_overview"]["final"].isNotNull()
    buyable = F.when(F.coalesce(dated["coming_soon"], F.lit(False)) | F.coalesce(en["is_free"], F.lit(False)) | has_price, True).when(en["package_groups"].isNotNull(), F.size(en["package_groups"]) > 0)
    systems = F.array(*[F.when(en["platforms"][k], F.lit(v)) for k, v in (("windows", "WIN"), ("mac", "MAC"), ("linux", "LNX"))])
    rated = (p["reviews"]["success"] != 0) & (summary["total_reviews"] > 0) & summary["total_positive"].isNotNull()
    spoken, voiced = languages(en["supported_languages"])
    many, had = recent["positive"] + recent["negative"], F.coalesce(played["count"] > 0, F.lit(False))
    found = {
        "name": F.when(F.trim(en["name"]) != "", en["name"]), "description_en": html_text(en["short_description"]), "description_ru": html_text(ru["short_description"]), "image": F.when(en["header_image"] != "", en["header_image"]),
        "steam_appid": F.coalesce(en["steam_appid"], p["appid"].try_cast("bigint")), "store_release": store, "early_access": F.when(F.coalesce(early, F.lit(False)), store), "is_free": F.coalesce(en["is_free"], F.lit(False)),
        "prices": _prices(price(en["price_overview"]), price(ru["price_overview"]), price(az["price_overview"])), "steam_purchasable": buyable, "platforms": _some(F.array_compact(systems)),
        "developers": _texts(en["developers"]), "publishers": _texts(en["publishers"]), "genres": _texts(en["genres"]["description"]), "categories": _texts(en["categories"]["description"]), "languages": spoken, "voiceovers": voiced,
        "achievements": en["achievements"]["total"], "links": _links(_link("metacritic", F.lit(None), en["metacritic"]["url"], F.coalesce(en["metacritic"]["url"] != "", F.lit(False)))),
        "score_critics": en["metacritic"]["score"], "score_critics_source": F.when(en["metacritic"]["score"].isNotNull(), "metacritic"),
        "score_steam": F.when(rated, scalars.positive_share(summary["total_positive"], summary["total_reviews"])), "score_steam_votes": F.coalesce(F.when(rated, summary["total_reviews"]), en["recommendations"]["total"]),
        "score_steam_recent": scalars.positive_share(recent["positive"], many), "score_steam_recent_votes": F.when(many > 0, many),
        "playtime_review_minutes": F.when(had, played["medianAtReview"]), "playtime_review_count": F.when(had, played["count"]), "playtime_review_p25": F.when(had, played["p25AtReview"]), "playtime_review_p75": F.when(had, played["p75AtReview"]),
    }
    return _fields(found, en.isNotNull())


_SHOP_PRICES = "struct<_embedded: struct<prices: array<struct<currency: struct<code: string>, basePrice: string, finalPrice: string>>>>"
_NAMES = "array<struct<name: string>>"
_SHOP = f"""en struct<overview: string, description: string, _links: struct<store: struct<href: string>, boxArtImage: struct<href: string>>, _embedded: struct<product: struct<id: bigint, title: string, isAvailableForSale: boolean, isPreorder: boolean, globalReleaseDate: string>,
 localizations: array<struct<_embedded: struct<language: struct<name: string>, localizationScope: struct<type: string>>>>, publishers: {_NAMES}, developers: {_NAMES}, supportedOperatingSystems: array<struct<operatingSystem: struct<name: string>>>, tags: {_NAMES}, features: {_NAMES}>>,
 ru struct<overview: string, description: string>, pricesUsd {_SHOP_PRICES}, pricesRub {_SHOP_PRICES}, catalog struct<slug: string, releaseDate: string, storeReleaseDate: string, operatingSystems: array<string>, genres: {_NAMES}, coverHorizontal: string>"""


def _shop_price(prices: Column, currency: str) -> Column:
    entry = F.get(F.filter(prices["_embedded"]["prices"], lambda x: x["currency"]["code"] == currency), F.lit(0))
    asked = let(entry, lambda e: F.struct(scalars.money_cents(e["basePrice"]).alias("base"), scalars.money_cents(e["finalPrice"]).alias("last")))

    def priced(m: Column) -> Column:
        i, f = F.coalesce(m["base"], m["last"]), F.coalesce(m["last"], m["base"])
        off = F.when((i > 0) & f.isNotNull(), F.greatest(F.lit(0), scalars.round_up_half((i - f).cast("double") / i * 100))).otherwise(0)
        return F.when(i.isNotNull(), _money(i, f, off))

    return let(asked, priced)


@_source(_SHOP)
def gog(p: Column) -> Column:
    en, catalog = p["en"], p["catalog"]
    inner, product = en["_embedded"], en["_embedded"]["product"]
    dotted = lambda c: F.regexp_replace(c, r"^(\d{4})\.(\d{2})\.(\d{2})$", "$1-$2-$3")
    href = en["_links"]["store"]["href"]
    in_link = F.regexp_extract(href, r"/game/([^/?#]+)", 1)
    slug = F.coalesce(catalog["slug"], F.when(in_link != "", in_link))
    systems = F.coalesce(inner["supportedOperatingSystems"]["operatingSystem"]["name"], catalog["operatingSystems"])
    table = F.create_map(*[F.lit(x) for pair in PLATFORMS.items() for x in pair])
    spoken = F.filter(inner["localizations"], lambda x: F.coalesce(x["_embedded"]["localizationScope"]["type"], F.lit("")) != "audio")
    voiced = F.filter(inner["localizations"], lambda x: x["_embedded"]["localizationScope"]["type"] == "audio")
    tongue = lambda c: _texts(F.array_distinct(c["_embedded"]["language"]["name"]))
    usd, rub = _shop_price(p["pricesUsd"], "USD"), _shop_price(p["pricesRub"], "RUB")
    free = F.coalesce(usd["final"], rub["final"]) == 0
    buyable = F.when(F.coalesce(product["isPreorder"], F.lit(False)) | F.coalesce(free, F.lit(False)) | usd.isNotNull() | rub.isNotNull(), True).otherwise(product["isAvailableForSale"])
    url = F.coalesce(href, F.concat(F.lit("https://www.gog.com/en/game/"), slug))
    found = {
        "name": names.fix_name(product["title"]), "gog_id": product["id"].cast("string"), "gog_slug": slug, "image": F.coalesce(catalog["coverHorizontal"], en["_links"]["boxArtImage"]["href"]),
        "description_en": html_text(F.coalesce(en["overview"], en["description"])), "description_ru": html_text(F.coalesce(p["ru"]["overview"], p["ru"]["description"])),
        "store_release": _dated(parse_date(F.coalesce(product["globalReleaseDate"], dotted(catalog["releaseDate"]), dotted(catalog["storeReleaseDate"])))),
        "platforms": _some(F.array_distinct(F.array_compact(F.transform(systems, lambda x: F.try_element_at(table, F.lower(x)))))), "developers": _named(inner["developers"]), "publishers": _named(inner["publishers"]),
        "genres": _named(F.coalesce(catalog["genres"], inner["tags"])), "tags": _named(inner["tags"]), "categories": _named(inner["features"]), "languages": tongue(spoken), "voiceovers": tongue(voiced),
        "prices": _prices(usd, rub), "is_free": free, "gog_purchasable": buyable, "links": _links(_link("gog", product["id"], url, url.isNotNull())),
    }
    return _fields(found, product.isNotNull())


_DATABASE = """game struct<id: bigint, name: string, first_release_date: bigint, release_dates: array<struct<date: bigint, date_format: int, category: int>>, aggregated_rating: double, rating: double, genres: array<struct<name: string>>,
 involved_companies: array<struct<company: struct<name: string>, developer: boolean, publisher: boolean>>, external_games: array<struct<uid: string, category: int, external_game_source: int>>, websites: array<struct<url: string, category: int, type: int>>>,
 timeToBeat struct<hastily: bigint, normally: bigint, completely: bigint>"""


@_source(_DATABASE)
def igdb(p: Column) -> Column:
    g, t = p["game"], p["timeToBeat"]
    first = F.get(F.filter(g["release_dates"], lambda r: r["date"] == g["first_release_date"]), F.lit(0))
    precision = let(first, lambda r: scalars.slot(F.coalesce(r["date_format"], r["category"]), DATE_FORMATS, "day"))
    released = F.struct(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(g["first_release_date"] / 86400).cast("int")).alias("date"), precision.alias("precision"))
    external = lambda kind: F.get(F.filter(g["external_games"], lambda e: (scalars.slot(F.coalesce(e["external_game_source"], e["category"]), EXTERNAL, None) == kind) & (e["uid"] != "")), F.lit(0))["uid"]
    site = lambda kind: F.get(F.filter(g["websites"], lambda w: scalars.slot(F.coalesce(w["type"], w["category"]), WEBSITE, None) == kind), F.lit(0))["url"]
    firms = lambda role: _named(F.filter(g["involved_companies"], lambda c: c[role])["company"])
    store, shop = external("steam"), external("gog")
    found = {
        "name": F.when(F.trim(g["name"]) != "", g["name"]), "release": F.when(g["first_release_date"].isNotNull(), released), "score_igdb": scalars.round_up_half(g["aggregated_rating"]), "score_igdb_users": scalars.round_up_half(g["rating"]),
        "time_main": scalars.hours(F.coalesce(t["normally"], t["hastily"]), 3600), "time_complete": scalars.hours(t["completely"], 3600), "genres": _named(g["genres"]), "developers": firms("developer"), "publishers": firms("publisher"),
        "links": _links(
            let(store, lambda x: _link("steam", x, F.concat(F.lit("https://store.steampowered.com/app/"), x), x.isNotNull())), let(shop, lambda x: _link("gog", x, site("gog"), x.isNotNull())),
            let(site("wikipedia"), lambda url: _link("wikipedia", F.lit(None), url, url.isNotNull())), let(site("official"), lambda url: _link("official", F.lit(None), url, url.isNotNull())),
        ),
    }
    return _fields(found, g.isNotNull())


@_source("appid bigint, name string, positive bigint, negative bigint, owners string, median_forever double, average_forever double, tags map<string, bigint>")
def steamspy(p: Column) -> Column:
    votes = scalars.vote_share(p["positive"], p["negative"])
    ranked = F.transform(F.array_sort(F.transform(F.map_entries(p["tags"]), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), lambda x: x["k"])
    found = {
        "steam_appid": p["appid"], "owners_estimate": scalars.owners_midpoint(p["owners"]), "score_steam": votes["score"], "score_steam_votes": votes["votes"],
        "playtime_median": F.when(p["median_forever"] > 0, p["median_forever"]), "playtime_mean": F.when(p["average_forever"] > 0, p["average_forever"]), "tags": _some(ranked),
    }
    return _fields(found, p["appid"].isNotNull() & p["name"].isNotNull())


@_source("game_id bigint, game_name string, profile_steam bigint, release_world string, release_na string, release_eu string, release_jp string, comp_main bigint, comp_100 bigint")
def hltb(p: Column) -> Column:
    sid = scalars.filled(p["profile_steam"])
    return _fields({
        "release": _dated(parse_date(F.coalesce(p["release_world"], p["release_na"], p["release_eu"], p["release_jp"]))), "time_main": scalars.hours(p["comp_main"], 3600), "time_complete": scalars.hours(p["comp_100"], 3600),
        "links": _links(_link("steam", sid, F.concat(F.lit("https://store.steampowered.com/app/"), sid.cast("string")), sid.isNotNull())),
    })


@_source("slug string, url string, name string, datePublished string, metascore double, criticReviews bigint, userScore double, userRatings bigint, platform string")
def metacritic(p: Column) -> Column:
    scored = p["metascore"].isNotNull()
    return _fields({
        "score_critics": p["metascore"], "score_critics_source": F.when(scored, "metacritic"), "score_critics_count": F.when(scored, p["criticReviews"]), "score_users": p["userScore"], "release": _dated(parse_date(p["datePublished"])),
        "links": _links(_link("metacritic", p["slug"], p["url"], F.coalesce((p["slug"] != "") & (p["url"] != ""), F.lit(False)))),
    })


@_source("pid string, url string, pageName string, difficultyLabel string, ratingTitle string, lengthTitle string, releaseRaw string")
def gamefaqs(p: Column) -> Column:
    return _fields({
        "difficulty": F.when(p["difficultyLabel"] != "", p["difficultyLabel"]), "score_gamefaqs": scalars.first_number(p["ratingTitle"]), "time_gamefaqs": scalars.first_number(p["lengthTitle"]), "release": _dated(parse_date(p["releaseRaw"])),
        "links": _links(_link("gamefaqs", p["pid"], p["url"], F.coalesce((p["pid"] != "") & (p["url"] != ""), F.lit(False)))),
    })


_VALUE = "struct<type: string, value: string>"
_BOUND = ("item", "steamId", "gogId_", "gogId", "igdbId_", "igdbId", "hltbId_", "hltbId", "metacriticId_", "metacriticId", "opencriticId_", "mobyId_", "mobyIdOld_", "gamefaqsId_", "gamefaqsId", "wikiEnTitle_", "wikiRuTitle_", "pubDates", "developers", "publishers")
WIKI_PRECISION = {"11": "day", "10": "month", "9": "year"}


def earliest_release(raw: Column) -> Column:
    """The earliest of 'date|precision||date|precision' in the order given; precisions but day, month and year do not count."""

    def one(parts: Column, i: Column) -> Column:
        date, precision = F.substring(parts[0], 1, 10), scalars.slot(F.get(parts, F.lit(1)), WIKI_PRECISION, None)
        day = let(precision, lambda p: F.when(p == "year", F.concat(F.substring(date, 1, 4), F.lit("-01-01"))).when(p == "month", F.concat(F.substring(date, 1, 7), F.lit("-01"))).when(p == "day", date))
        return F.struct(day.try_cast("date").alias("date"), i.alias("i"), precision.alias("precision"))

    pairs = F.transform(F.split(raw, r"\|\|"), lambda pair, i: let(F.split(pair, r"\|"), lambda parts: one(parts, i)))
    best = F.array_min(F.filter(pairs, lambda x: x["date"].isNotNull()))
    return let(best, lambda x: F.when(x["date"].isNotNull(), F.struct(x["date"].alias("date"), x["precision"].alias("precision"))))


@_source(", ".join(f"{k} {_VALUE}" for k in _BOUND))
def wikidata(p: Column) -> Column:
    """One SPARQL result binding."""
    v = lambda *keys: F.coalesce(*[p[k]["value"] for k in keys])
    shop = v("gogId_", "gogId")
    at = lambda base, id_, tail="": F.concat(F.lit(base), id_, F.lit(tail))
    wiki = lambda lang, title: F.concat(F.lit(f"https://{lang}.wikipedia.org/wiki/"), F.url_encode(F.replace(title, F.lit(" "), F.lit("_"))))
    ids = {
        "igdb": (v("igdbId_", "igdbId"), "https://www.igdb.com/games/", ""), "hltb": (v("hltbId_", "hltbId"), "https://howlongtobeat.com/game/", ""), "metacritic": (v("metacriticId_", "metacriticId"), "https://www.metacritic.com/", ""),
        "mobygames": (v("mobyId_", "mobyIdOld_"), "https://www.mobygames.com/game/", "/"), "gamefaqs": (v("gamefaqsId_", "gamefaqsId"), "https://gamefaqs.gamespot.com/-/", "-"),
    }
    links = [_link("gog", F.regexp_extract(shop, "^game/(.+)$", 1), at("https://www.gog.com/", shop), F.coalesce(shop.startswith("game/"), F.lit(False)))]
    links += [_link(k, id_, at(base, id_, tail), id_.isNotNull()) for k, (id_, base, tail) in ids.items()]
    links += [_link(f"wikipedia_{lang}", t, wiki(lang, t), t.isNotNull()) for lang, t in (("en", v("wikiEnTitle_")), ("ru", v("wikiRuTitle_")))]
    return _fields({"steam_appid": v("steamId").try_cast("bigint"), "developers": _some(scalars.from_pipes(v("developers"))), "publishers": _some(scalars.from_pipes(v("publishers"))), "release": earliest_release(v("pubDates")), "links": _links(*links)})


@_source("id string, title string, platform string, score double, reviews bigint, path string")
def gamerankings(p: Column) -> Column:
    good = (p["reviews"] >= 1) & p["score"].between(0, 100)
    listed = F.coalesce((p["platform"] == "PC") & (p["path"] != "") & p["id"].isNotNull(), F.lit(False))
    return _fields({"score_gamerankings": F.when(good, scalars.round_up_half(p["score"])), "links": _links(_link("gamefaqs", p["id"], F.concat(F.lit("https://gamefaqs.gamespot.com"), p["path"]), listed))})


def split_list(c: Column) -> Column:
    return _texts(F.transform(F.split(c, ","), lambda x: F.trim(x)))


def split_companies(c: Column) -> Column:
    """A comma list of companies; a legal form that the comma cut off goes back to its company."""

    def glue(done: Column, part: Column) -> Column:
        last = F.concat(F.element_at(done, -1), F.lit(", "), part)
        return F.when((F.size(done) > 0) & part.rlike(COMPANY_SUFFIX), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(last))).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(split_list(c), F.array().cast(_LIST), glue)


_SNAPSHOT = """sid string, store_platform string, store_url string, store_uscore bigint, name string, image string, description_en string, description_ru string, published_store string, published_meta string, published_stsp string, published_hltb string, published_igdb string,
 price_en bigint, price_ru bigint, price_final_en bigint, price_final_ru bigint, discount_en bigint, discount_ru bigint, platforms string, developers string, publishers string, languages string, voiceovers string, categories string, genres string, tags string, achievements bigint,
 gfq_difficulty string, gfq_rating double, stsp_owners bigint, hltb_single double, hltb_complete double, meta_url string, meta_score double, meta_uscore double, grnk_score bigint, igdb_single double, igdb_complete double, igdb_score bigint, igdb_uscore bigint"""


@_source(_SNAPSHOT)
def legacy(p: Column) -> Column:
    candidates = [F.struct(F.lit(f"legacy_{s}").alias("source"), F.lit("independent").alias("kind"), parse_date(p[c]).alias("release")) for s, c in (("gamefaqs", "published_meta"), ("steamspy", "published_stsp"), ("hltb", "published_hltb"), ("igdb", "published_igdb"))]
    sold = lambda where: (p["store_platform"] == where) & p["sid"].isNotNull()
    url = lambda where: F.coalesce((p["store_url"] != "") & (p["store_platform"] == where), F.lit(False))
    found = {
        **{k: p[k] for k in ("name", "image", "description_en", "description_ru", "achievements")}, "store_release": parse_date(p["published_store"]), "release_candidates": F.array(*candidates),
        "score_steam": p["store_uscore"], "score_critics": p["meta_score"], "score_critics_source": F.when(p["meta_score"].isNotNull(), "metacritic"), "score_users": p["meta_uscore"], "score_gamerankings": p["grnk_score"], "score_gamefaqs": p["gfq_rating"],
        "score_igdb": p["igdb_score"], "score_igdb_users": p["igdb_uscore"], "time_main": p["hltb_single"], "time_complete": p["hltb_complete"], "time_main_igdb": p["igdb_single"], "time_complete_igdb": p["igdb_complete"], "difficulty": p["gfq_difficulty"],
        "owners_estimate": p["stsp_owners"], **{k: split_list(p[k]) for k in ("platforms", "genres", "tags", "categories", "languages", "voiceovers")}, "developers": split_companies(p["developers"]), "publishers": split_companies(p["publishers"]),
        "prices": _prices(_money(p["price_en"], p["price_final_en"], p["discount_en"]), _money(p["price_ru"], p["price_final_ru"], p["discount_ru"])), "steam_appid": F.when(sold("Steam"), p["sid"].try_cast("bigint")), "gog_id": F.when(sold("GOG"), p["sid"]),
        "links": _links(_link("steam", p["sid"], p["store_url"], url("Steam")), _link("gog", p["sid"], p["store_url"], url("GOG")), _link("metacritic", F.lit(None), p["meta_url"], F.coalesce(p["meta_url"] != "", F.lit(False)))),
    }
    return _fields(found)


def projected(records: DataFrame, name: str, payload: str | Column = "payload", keep: tuple[str | Column, ...] = ("game_id",)) -> DataFrame:
    """Payloads of one source: keep and the vocabulary.  A payload is parsed once, in a step of its own."""
    extract, text = EXTRACTORS[name], F.col(payload) if isinstance(payload, str) else payload
    if hasattr(extract, "schema"):
        rows = records.select(*keep, F.from_json(text, extract.schema).alias("__parsed"))
        made = extract.fields(F.col("__parsed"))
    else:
        rows, made = records.select(*keep, text.alias("__parsed")), extract(F.col("__parsed"))
    return rows.withColumn("__f", made).drop("__parsed").select("*", "__f.*").drop("__f")


def extracted(records: DataFrame, source: str = "source", payload: str = "payload", keep: tuple[str, ...] = ("game_id",)) -> DataFrame:
    """Landed records (source, payload, keep...) in the long form that fusion takes: keep, source, priority and the vocabulary.

    Each source's rows are parsed by its own projection only; rows of unknown sources are left out."""
    parts = None
    for name in EXTRACTORS:
        rows = projected(records.where(F.col(source) == name), name, payload, (*keep, F.col(source).alias("source"), source_priority(F.col(source)).alias("priority")))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def bindings(spark, path: str) -> DataFrame:
    """SPARQL result files as one JSON text a row."""
    raw = spark.read.text(path, wholetext=True)
    rows = F.from_json(F.get_json_object("value", "$.results.bindings"), "array<variant>")
    return raw.select(F.explode(rows).alias("b")).select(F.to_json("b").alias("payload"))


def landed_pages(spark, path: str) -> DataFrame:
    """Catalogue pages landed as JSON files, one document a file: (path, body)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))

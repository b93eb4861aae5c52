"""What is shown of an item: visibility, the flat export row and the nested card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.html import html_text, truncate_at_sentence
from tessera.functions.scalars import from_pipes, review_label
from tessera.operators.facets import described, export_visible
from tessera.operators.reports import pivot_links

LINK_SOURCES = ["steam", "gog", "hltb", "igdb", "gamefaqs", "metacritic"]
# Keys of an exported row in their order, each with the item's column that it shows ("" stands for a derived value).
EXPORT_KEYS = (
    ("id", "id"), ("kind", "kind"), ("name", "name"), ("image", "image"), ("description", "description_en"),
    ("steam_appid", "steam_appid"), ("steam_url", ""), ("gog_id", "gog_id"), ("gog_url", ""),
    ("release_date", "release_date"), ("release_precision", "release_precision"), ("early_access_date", "early_access_date"), ("store_release_date", "store_release_date"),
    ("price_usd", "price_usd"), ("price_final_usd", "price_final_usd"), ("discount_percent", "discount_usd"),
    ("platforms", ""), ("developers", ""), ("publishers", ""), ("languages", ""), ("voiceovers", ""), ("categories", ""), ("genres", ""), ("tags", ""), ("achievements", "achievements"),
    ("steam_reviews_percent", "score_steam"), ("steam_reviews_count", "score_steam_votes"), ("steam_reviews_label", ""),
    ("steam_recent_percent", "score_steam_recent"), ("steam_recent_count", "score_steam_recent_votes"), ("steam_recent_label", ""),
    ("steamspy_owners", "owners_estimate"), ("average_playtime_hours", "time_average"), ("average_playtime_source", "time_average_source"),
    ("hltb_url", ""), ("hltb_main_hours", "time_main"), ("hltb_complete_hours", "time_complete"),
    ("gamefaqs_url", ""), ("gamefaqs_difficulty", "difficulty"), ("gamefaqs_rating", "score_gamefaqs"),
    ("metacritic_url", ""), ("metacritic_score", ""), ("metacritic_reviews", ""), ("metacritic_user_score", "score_users_metacritic"),
    ("igdb_url", ""), ("igdb_score", "score_igdb"), ("igdb_user_score", "score_igdb_users"), ("gamerankings_score", "score_gamerankings"),
    ("gg_score", "gg_score"), ("gg_points", "ggp"), ("updated_at", ""),
)
LISTS = ("developers", "publishers", "languages", "voiceovers", "categories", "genres", "tags")


def visible(delisted: Column, non_item: Column, purchasable: Column) -> Column:
    """Items that a search may find: in the store, an item proper, and for sale."""
    return F.coalesce(~delisted, F.lit(True)) & non_item.isNull() & F.coalesce(purchasable, F.lit(False))


def _systems(c: Column) -> Column:
    """'WIN,MAC' -> ['WIN', 'MAC']; never null."""
    return F.coalesce(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def export_rows(items: DataFrame, links: DataFrame, *, link_id: str = "game_id", source: str = "source", url: str = "url", order: str = "updated_at") -> DataFrame:
    """The published rows of all items that may be exported, with the EXPORT_KEYS in their order.

    links: (link_id, source, url, order); of several links of a source the latest counts.  Lists are arrays, empty rather than null; the critics'
    score and count are shown only if they are Metacritic's.  One aggregation of the links and one left join."""
    pivoted = pivot_links(links, link_id, LINK_SOURCES, source, url, order)
    pivoted = pivoted.select(F.col(link_id).alias("__id"), *[F.col(s).alias(f"__{s}") for s in LINK_SOURCES])
    shown = items.where(export_visible(F.col("non_game"), F.coalesce(F.col("purchasable"), F.lit(False)), F.col("discount_usd")))
    rows = shown.join(pivoted, shown["id"] == pivoted["__id"], "left")
    critics = F.col("score_critics_source") == "metacritic"
    derived = {
        **{f"{s}_url": F.col(f"__{s}") for s in LINK_SOURCES}, **{c: from_pipes(F.col(c)) for c in LISTS}, "platforms": _systems(F.col("platforms")),
        "steam_reviews_label": review_label(F.col("score_steam"), F.col("score_steam_votes")), "steam_recent_label": review_label(F.col("score_steam_recent"), F.col("score_steam_recent_votes")),
        "metacritic_score": F.when(critics, F.col("score_critics")), "metacritic_reviews": F.when(critics, F.col("score_critics_count")), "updated_at": F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    }
    return rows.select(*[(derived[key] if not column else F.col(column)).alias(key) for key, column in EXPORT_KEYS])


def _reviews(percent: Column, votes: Column) -> Column:
    return F.when(percent.isNotNull() & votes.isNotNull(), F.struct(percent.alias("percent"), votes.alias("votes"), review_label(percent, votes).alias("label")))


def _price(lang: str, cis: bool) -> Column:
    tail, currency = ("cis_usd", "USD") if cis else ("rub", "RUB") if lang == "ru" else ("usd", "USD")
    return F.struct(F.col(f"price_{tail}").alias("amount"), F.col(f"price_final_{tail}").alias("final"), F.col(f"discount_{tail}").alias("discount"), F.lit(currency).alias("currency"))


def cards(items: DataFrame, links: DataFrame, *, lang: str = "en", cis: bool = False, link_id: str = "game_id", source: str = "source", url: str = "url", order: str = "updated_at") -> DataFrame:
    """One row an item with the nested card that its page shows: release, scores, times, price, lists, links.

    Russian has its own description and price and falls back to the English text; all other languages get the English ones.  A link to
    the encyclopedia is in the user's language, else in the other."""
    kinds = [*LINK_SOURCES, "wikipedia_en", "wikipedia_ru"]
    pivoted = pivot_links(links, link_id, kinds, source, url, order)
    pivoted = pivoted.select(F.col(link_id).alias("__id"), *[F.col(s).alias(f"__{s}") for s in kinds])
    rows = items.join(pivoted, items["id"] == pivoted["__id"], "left")
    wiki = ("ru", "en") if lang == "ru" else ("en", "ru")
    text = html_text(described(F.lit(lang), F.col("description_en"), F.col("description_ru")))
    recent = _reviews(F.col("score_steam_recent"), F.col("score_steam_recent_votes"))
    c = F.col
    scores = F.struct(
        c("score_steam").alias("steam"), c("score_critics").alias("critics"), c("score_critics_source").alias("criticsSource"), c("score_igdb").alias("igdb"), c("score_gamefaqs").alias("gamefaqs"),
        F.struct(_reviews(c("score_steam"), c("score_steam_votes")).alias("all"), F.when(c("score_steam_recent_votes") >= 10, recent).alias("recent")).alias("steamReviews"),
    )
    return rows.select(
        "id", "kind", "name", "image", truncate_at_sentence(text).alias("description"), F.struct(c("release_date").alias("date"), F.coalesce("release_precision", F.lit("unknown")).alias("precision")).alias("release"),
        c("gg_score").alias("score"), scores.alias("scores"), F.struct(c("final_time").alias("main"), c("time_complete").alias("complete"), c("time_average").alias("average")).alias("time"), "difficulty", "ggp", _price(lang, cis).alias("price"),
        _systems(c("platforms")).alias("platforms"), *[from_pipes(c(x)).alias(x) for x in LISTS], c("owners_estimate").alias("owners"), "achievements",
        F.struct(*[c(f"__{s}").alias(s) for s in LINK_SOURCES], F.coalesce(*[c(f"__wikipedia_{x}") for x in wiki]).alias("wikipedia")).alias("links"),
    )

"""Review pages as landed HTML: to the records that the extractors read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.html import html_title, json_ld, script_json
from tessera.functions.names import decode_entities, normalize_name, slug

_TAGS = r"<[^>]*>"


def _inner(html: Column, pattern: str) -> Column:
    """Text of the first match's group, tags dropped; null if there is none."""
    raw = F.trim(F.regexp_replace(F.regexp_extract(html, pattern, 1), _TAGS, " "))
    return F.when(raw != "", decode_entities(raw))


def _whole(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, r"([\d,]+)", 1), ",", "").try_cast("bigint")


def critics_page(html: Column) -> Column:
    """struct<name, datePublished, metascore, criticReviews, userScore, userRatings, platform>: the PC card before the headline, JSON-LD first of all else."""
    ld = json_ld(html, "VideoGame", "name string, datePublished string, aggregateRating struct<ratingValue: double, reviewCount: bigint>")
    card = F.regexp_extract(html, r'(?is)<a[^>]*href="[^"]*/critic-reviews/\?platform=pc"[^>]*>(.*?)</a>', 1)
    has_card = card != ""
    card_score = F.regexp_extract(card, r'(?is)aria-label="metascore[^"]*".*?<span[^>]*>\s*(\d+)\s*</span>', 1).try_cast("double")
    card_count = _whole(_inner(card, r'(?is)class="[^"]*review-count[^"]*"[^>]*>(.*?)<'))
    head = F.regexp_extract(html, r'(?i)aria-label="metascore (\d+)', 1).try_cast("double")
    first = F.when(has_card, card_score).otherwise(ld["aggregateRating"]["ratingValue"])
    fallback = first.isNull() & head.isNotNull()
    user = F.regexp_extract(html, r'(?is)aria-label="user score[^"]*".*?<span[^>]*>\s*([\d.]+)\s*</span>', 1).try_cast("double")
    title = F.regexp_replace(html_title(html), r"(?i)(\s+Reviews)?\s*-\s*Metacritic\s*$", "")
    name = F.coalesce(ld["name"], _inner(html, r'(?is)<meta[^>]*property="og:title"[^>]*content="([^"]*)"'), F.when(title != "", title))
    based = lambda who: _whole(F.regexp_extract(html, rf"Based on ([\d,]+) {who}", 1))
    count = F.when(fallback, based("Critic Review")).when(has_card, card_count).otherwise(ld["aggregateRating"]["reviewCount"])
    return F.struct(
        name.alias("name"), ld["datePublished"].alias("datePublished"), F.coalesce(first, head).alias("metascore"), count.alias("criticReviews"), F.floor(user * 10 + 0.5).alias("userScore"),
        based("User Rating").alias("userRatings"), F.when(has_card & ~fallback, "pc").otherwise("default").alias("platform"),
    )


def hints_page(html: Column) -> Column:
    """struct<pageName, difficultyLabel, ratingTitle, lengthTitle, releaseRaw> of a guide site's product page; unrated hints are null."""

    def hint(name: str) -> Column:
        text = _inner(html, rf'(?is)id="gs_{name}_avg_hint"[^>]*>(.*?)</')
        return F.when(F.lower(text) != "unrated", text)

    def title(name: str) -> Column:
        raw = F.regexp_extract(html, rf'(?is)title="([^"]*)"[^>]*>\s*<[^>]*id="gs_{name}_avg_hint"', 1)
        return F.when(hint(name).isNotNull() & (raw != ""), decode_entities(raw))

    released = _inner(html, r"(?is)Release:.*?<a[^>]*>(.*?)</a>")
    name = _inner(html, r'(?is)class="page-title"[^>]*>(.*?)</')
    return F.struct(name.alias("pageName"), F.trim(F.split(hint("difficulty"), r" \(")[0]).alias("difficultyLabel"), title("rate").alias("ratingTitle"), title("length").alias("lengthTitle"), released.alias("releaseRaw"))


def next_data(html: Column, schema: str) -> Column:
    """The page's embedded state as a struct."""
    return F.from_json(script_json(html, "__NEXT_DATA__"), schema)


def slug_guesses(name: Column) -> Column:
    """Up to three addresses to try for a title: as it is, in normal form, and without subtitle if that is not too short."""
    short = normalize_name(name, cut_subtitle=True)
    long_enough = (F.size(F.split(F.trim(short), " +")) >= 2) | (F.length(F.replace(short, F.lit(" "), F.lit(""))) >= 6)
    every = F.array(slug(name), slug(normalize_name(name)), F.when(long_enough, slug(short)))
    return F.slice(F.array_distinct(F.filter(every, lambda s: s.isNotNull() & (s != ""))), 1, 3)


def review_id(link: Column) -> Column:
    """The slug in any of the three forms of a link: full address, game/slug or pc/slug."""
    s = F.regexp_replace(F.trim(link), r"(?i)^.*metacritic\.com/", "")
    s = F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "^/+|/+$", ""), "(?i)^game/", ""), "(?i)^pc/", ""), "/")[0]
    return F.when(s != "", s)

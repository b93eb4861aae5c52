"""Parts of the addresses and identifiers that sources hand over."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _filled(value: Column, pattern: str) -> Column:
    """The first group of a pattern, null where it does not fit."""
    found = F.regexp_extract(value, pattern, 1)
    return F.when(found != "", found)


def entity_id(uri: Column) -> Column:
    """Q42 of an entity's address; other values as they are, blank ones null."""
    return F.when(uri != "", F.coalesce(_filled(uri, r"/(Q[1-9][0-9]*)$"), uri))


def shop_path(value: Column) -> Column:
    """struct<kind, slug> of a shop identifier: game/some_title or movie/some_title, else unknown with the whole value; blank ones null."""
    pattern = r"^(game|movie)/(.+)$"
    known = F.struct(F.regexp_extract(value, pattern, 1).alias("kind"), F.regexp_extract(value, pattern, 2).alias("slug"))
    return F.when(value != "", F.when(value.rlike(pattern), known).otherwise(F.struct(F.lit("unknown").alias("kind"), value.alias("slug"))))


def slug_of_link(href: Column) -> Column:
    """The slug of a shop page's address, /game/<slug>, or null."""
    return _filled(href, r"/game/([^/?#]+)")


def page_number(href: Column) -> Column:
    """241126 of /pc/241126-some-title, or null."""
    return _filled(href, r"(?i)/[a-z0-9-]+/([0-9]+)-")


def encyclopedia_url(lang: str, title: Column) -> Column:
    """The address of an article; null without a title."""
    encoded = F.replace(F.url_encode(F.replace(title, F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):  # which addresses leave as they are
        encoded = F.replace(encoded, F.lit(code), F.lit(plain))
    return F.concat(F.lit(f"https://{lang}.wikipedia.org/wiki/"), encoded)

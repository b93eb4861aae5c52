"""Classifying catalogue items: things that are not items proper, and whether they can be bought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import match_key, normalize_name
from tessera.functions.scalars import slot

# Product types of the two stores, endings of titles, and genres of software.
STORE_TYPES = {"dlc": "dlc", "music": "soundtrack", "video": "video", "movie": "video", "series": "video", "episode": "video", "demo": "demo", "mod": "other", "hardware": "other", "advertising": "other", "tool": "tool", "application": "tool"}
SHOP_TYPES = {"dlc": "dlc", "extras": "other"}
ENDINGS = (
    ("Dedicated Server", "tool"), ("SDK", "tool"), ("Playtest", "demo"), ("Demo", "demo"), ("Strategy Guide", "other"), ("Season Pass", "dlc"),
    ("Expansion Pass", "dlc"), ("Skin Pack", "dlc"), ("Costume Pack", "dlc"), ("Upgrade Pack", "dlc"), ("Supporter Pack", "dlc"), ("DLC", "dlc"),
    ("Original (?:Game )?Soundtrack", "soundtrack"), ("Original Score", "soundtrack"), ("Soundtrack", "soundtrack"), ("OST", "soundtrack"),
    ("Digital Art(?:book)?", "artbook"), ("Art ?Book", "artbook"), ("Wallpapers?", "wallpaper"),
)
SOFTWARE_GENRES = ("utilities", "video production", "audio production", "design & illustration", "animation & modeling", "photo editing", "web publishing", "software training", "accounting", "education")
_GOODS = r"(?i)^(.*?)\s*-\s*Soundtrack\s+and\s+Digital\s+Goods\s+Bundle\s*$"


def _lookup(value: Column, table: dict) -> Column:
    return slot(F.lower(value), table, None)


def name_clauses(name: Column) -> Column:
    """A title cut at ' - ', colons, brackets and plus signs, then at '&', '/', ',' and the word and."""
    parts = F.flatten(F.transform(F.split(name, r"\s+-\s+|[():+]"), lambda p: F.split(p, r"(?i)\s*(?:&|/|,|\band\b)\s*")))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def _ending(name: Column) -> Column:
    """Class by the first clause that ends in a known word; a wallpaper is a tool only as the whole title."""
    clauses = name_clauses(name)
    whole = (F.size(clauses) == 1) & (F.get(clauses, F.lit(0)) == F.trim(name))

    def of(clause: Column) -> Column:
        found = F.lit(None).cast("string")
        for words, kind in reversed(ENDINGS):
            found = F.when(clause.rlike(rf"(?i)\b{words}$"), F.lit(kind)).otherwise(found)
        return found

    first = F.get(F.filter(F.transform(clauses, of), lambda k: k.isNotNull()), F.lit(0))
    return F.when(first == "wallpaper", F.when(whole, "tool").otherwise("artbook")).otherwise(first)


def bundle_base(name: Column) -> Column:
    """The title of the base item in 'X + Soundtrack' and 'X - Soundtrack and Digital Goods Bundle', or null."""
    t = F.trim(name)
    goods = F.trim(F.regexp_extract(t, _GOODS, 1))
    sides = F.split(t, r"\s\+\s", 2)
    before, after = F.trim(F.get(sides, F.lit(0))), F.trim(F.get(sides, F.lit(1)))
    base = F.trim(F.regexp_replace(before, r"(?i)[:-]\s*Game\s*$", ""))
    plus = F.when((before != "") & (after != "") & _ending(after).isNotNull() & (base != ""), base)
    return F.when(t.rlike(_GOODS), F.when(goods != "", goods)).otherwise(plus)


def classify_name(name: Column, base_exists: Column) -> Column:
    """Class by title: a bundle only if its base item exists; else by the part before ' + '."""
    head = F.trim(F.get(F.split(F.trim(name), r"\s\+\s", 2), F.lit(0)))
    return F.when(bundle_base(name).isNotNull(), F.when(base_exists, "bundle")).otherwise(_ending(head))


def classify_genres(genres: Column) -> Column:
    """tool if there are genres and all are software's."""
    kept = F.filter(genres, lambda g: g.isNotNull() & (F.trim(g) != ""))
    return F.when((F.size(kept) > 0) & F.forall(kept, lambda g: F.lower(F.trim(g)).isin(*SOFTWARE_GENRES)), "tool")


def classify_non_item(name: Column, store_type: Column, shop_type: Column, genres: Column, base_exists: Column) -> Column:
    """dlc, soundtrack, video, demo, tool, artbook, bundle, other, or null for an item proper: store type, shop type, title, genres."""
    return F.coalesce(_lookup(store_type, STORE_TYPES), _lookup(shop_type, SHOP_TYPES), classify_name(name, F.coalesce(base_exists, F.lit(False))), classify_genres(genres))


def classify_purchasable(free: Column, prices: list[Column], released: Column, now: Column, stores: list[tuple[Column, Column]]) -> Column:
    """Whether an item can be bought.  stores: (has a live record, the store's verdict or null).

    Only a live store's no, with neither a price, a free offer, a coming release nor another store's yes, makes it false."""
    live, yes, no = F.lit(False), F.lit(False), F.lit(False)
    for has, verdict in stores:
        has = F.coalesce(has, F.lit(False))
        live, yes, no = live | has, yes | (has & F.coalesce(verdict, F.lit(False))), no | (has & F.coalesce(~verdict, F.lit(False)))
    priced = F.lit(False)
    for p in prices:
        priced = priced | F.coalesce(p > 0, F.lit(False))
    good = ~live | F.coalesce(free, F.lit(False)) | priced | F.coalesce(released > now, F.lit(False)) | yes
    return good | ~no


# Words that mark a pack as no item of its own.
PACK_WORDS = ("dlc", "soundtrack", "artbook", "season pass", "expansion", "upgrade", "bonus", "costume", "skin")


def keepable(products: DataFrame, *, kind: str = "kind", title: str = "title", pack: str = "pack") -> DataFrame:
    """The products without packs that only wrap others: those whose normal title holds one of PACK_WORDS, or equals that of a product which is no pack.

    Titles of products meet by an anti-join on distinct normal titles; products of other kinds, or without one, stay."""
    marked = products.withColumn("__pack", F.coalesce(F.col(kind) == pack, F.lit(False))).withColumn("__key", match_key(F.coalesce(F.col(title), F.lit(""))))
    own = marked.where("NOT __pack").select(F.col("__key").alias("__title")).distinct()
    extra = F.lit(False)
    for word in PACK_WORDS:
        extra = extra | F.contains("__key", F.lit(word))
    packs = marked.where("__pack").where(~extra)
    packs = packs.join(own, packs["__key"] == own["__title"], "left_anti")
    return marked.where("NOT __pack").unionByName(packs).drop("__pack", "__key")


def with_base_exists(listed: DataFrame, items: DataFrame, *, name: str = "name", id_col: str = "id", key: str = "name_normalized", non_item: str = "non_game") -> DataFrame:
    """The listed rows with `base_exists`: whether another item proper has the normal form of their bundle's base title (false for titles of no bundle).

    A left equi-join with one row for each title; a row without an id is no item yet, so any item counts as another."""
    held = items.where(F.col(non_item).isNull()).groupBy(F.col(key).alias("__key")).agg(F.min(id_col).alias("__low"), F.max(id_col).alias("__high"))
    base = listed.withColumn("__base", normalize_name(bundle_base(F.col(name))))
    base = base.withColumn("__base", F.when(bundle_base(F.col(name)).isNotNull(), F.col("__base")))
    other = F.col("__low").isNotNull() & (F.col(id_col).isNull() | (F.col("__low") != F.col(id_col)) | (F.col("__high") != F.col(id_col)))
    return base.join(held, F.col("__base") == F.col("__key"), "left").select(*[listed[c] for c in listed.columns], F.coalesce(other, F.lit(False)).alias("base_exists"))

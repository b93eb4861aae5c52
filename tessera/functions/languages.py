"""Language tags and their negotiation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUPPORTED = ("en", "de", "fr", "es")
ALIASES = {"english": "en", "deutsch": "de", "german": "de", "francais": "fr", "castellano": "es"}


def normalize_lang(tag: Column, supported=SUPPORTED, aliases=None) -> Column:
    """A supported language for a tag such as de-AT, or null: the whole tag, then its first part, each as a code or an alias."""
    known = {**{s: s for s in supported}, **(ALIASES if aliases is None else aliases)}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    t = F.lower(F.trim(tag))
    return F.coalesce(F.try_element_at(table, t), F.try_element_at(table, F.split(t, "[-_]")[0]))


def accepted(header: Column) -> Column:
    """Tags of an Accept-Language header by falling weight, equal ones in the header's order; a missing or odd weight counts as 1."""
    parts = F.filter(F.split(header, ","), lambda p: F.trim(F.split(p, ";")[0]) != "")

    def weighed(part: Column, i: Column) -> Column:
        q = F.regexp_extract(part, r";\s*q\s*=\s*([0-9.]+)\s*(?:;|$)", 1).try_cast("double")
        return F.struct((-F.coalesce(q, F.lit(1.0))).alias("w"), i.alias("i"), F.trim(F.split(part, ";")[0]).alias("tag"))

    return F.transform(F.array_sort(F.transform(parts, weighed)), lambda x: x["tag"])


def negotiate(header: Column, supported=SUPPORTED) -> Column:
    """The first accepted language that is supported, or null."""
    codes = F.filter(F.transform(accepted(header), lambda t: normalize_lang(t, supported)), lambda c: c.isNotNull())
    return F.get(codes, F.lit(0))


def data_language(lang: Column) -> Column:
    """Which of the two description languages serves a user."""
    return F.when(lang == "ru", "ru").otherwise("en")

"""Text and embedded data of web pages by pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.names import decode_entities
from tessera.functions.scalars import let

MAX_DESCRIPTION = 1500


def html_text(html: Column) -> Column:
    """Plain text: line breaks for br, closing p and li, other tags dropped, entities decoded, white space and blank lines squeezed; null if empty."""
    s = F.regexp_replace(html, r"\\r\\n|\\r|\\n", "\n")
    s = F.regexp_replace(s, r"(?i)<br\s*/?>|</p\s*>|<li\b[^>]*>", "\n")
    s = decode_entities(F.regexp_replace(s, "<[^>]+>", ""))
    s = F.regexp_replace(F.regexp_replace(s, "\r\n?", "\n"), "[ \t ]+", " ")
    s = F.regexp_replace(F.regexp_replace(s, " ?\n ?", "\n"), "\n{3,}", "\n\n")
    return let(F.regexp_replace(s, r"^[ \n]+|[ \n]+$", ""), lambda text: F.when(text != "", text))


def truncate_at_sentence(text: Column, most: int = MAX_DESCRIPTION) -> Column:
    """At most `most` characters: up to the last end of a sentence if that keeps half of them, else cut with an ellipsis."""
    head = F.substring(text, 1, most)
    cut = F.length(F.regexp_extract(head, r"(?s)^(.*[.!?][)\"'”’]?)(?!\w)", 1))
    shown = F.when(cut >= most * 0.5, F.trim(F.substring(text, F.lit(1), cut))).otherwise(F.concat(F.trim(head), F.lit("…")))
    return F.when(F.length(text) <= most, text).otherwise(shown)


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def script_json(html: Column, script_id: str) -> Column:
    """The JSON text in the script element of that id; '' if there is none."""
    return F.regexp_extract(html, rf'(?is)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>', 1)


def json_ld(html: Column, kind: str, schema: str) -> Column:
    """The first JSON-LD object of a page whose @type is `kind`, as a struct of the schema, or null."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    of_kind = F.filter(blocks, lambda b: F.get_json_object(b, "$['@type']") == kind)
    return F.from_json(F.get(of_kind, F.lit(0)), schema)


def contains_any(text: Column, marks: list[str]) -> Column:
    """Whether a page holds one of the marks of a block page, in any case."""
    low, found = F.lower(text), F.lit(False)
    for m in marks:
        found = found | low.contains(m.lower())
    return F.coalesce(found, F.lit(False))


def paragraphs(text: Column) -> Column:
    """Plain text as paragraphs: blank lines part them, other line feeds become breaks, signs of markup are escaped; empty for null."""
    blocks = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n{2,}"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    escaped = F.transform(F.filter(blocks, lambda b: b != ""), lambda b: F.replace(F.replace(F.replace(b, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))
    return F.array_join(F.transform(escaped, lambda b: F.concat(F.lit('<p style="padding-bottom:10px">'), F.replace(b, F.lit("\n"), F.lit("<br>")), F.lit("</p>"))), "")

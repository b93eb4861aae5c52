"""Scalar functions on literal values."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, html, languages, names, scalars


def values(spark, kind, rows, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_emptiness_and_rounding(spark):
    assert values(spark, "double", [None, 0.0, float("nan"), 2.0], scalars.empty_number) == [True, True, True, False]
    assert values(spark, "string", [None, "", "0", "a"], scalars.empty_text) == [True, True, True, False]
    assert values(spark, "double", [2.5, -2.5, 0.49999999999999994, None, float("inf"), -0.4], scalars.round_away) == [3, -3, 0, 0, 0, 0]
    assert values(spark, "double", [2.5, -2.5, 1.4], scalars.round_up_half) == [3, -2, 1]
    assert values(spark, "double", [1.005], lambda c: scalars.round_up_half(c, 2)) == [1.0]
    assert values(spark, "int", [0, -5, 30, 125], lambda c: scalars.hours(c, 60)) == [None, None, 0.5, 2.1]


def test_lists_and_text(spark):
    assert values(spark, "array<string>", [["a", " b ", "", None, "a"], [], None], scalars.to_pipes) == ["|a|b|", None, None]
    assert values(spark, "string", ["|a|b|", "a||b ", "", None], scalars.from_pipes) == [["a", "b"], ["a", "b"], [], []]
    assert values(spark, "string", ["1,000,000 .. 2,000,000", "0&nbsp;..&nbsp;20,000", "x", "5 .. ", None], scalars.owners_midpoint) == [1500000, 10000, None, None, None]
    assert values(spark, "string", ["1999 USD", "free", None], scalars.money_cents) == [1999, None, None]
    assert values(spark, "array<string>", [["linux", " WIN", "x"]], lambda c: scalars.ordered_subset(c, ["WIN", "MAC", "LINUX"])) == [["WIN", "LINUX"]]
    assert values(spark, "bigint", [10, 2048, 5 * 1024**2], scalars.human_size) == ["10 B", "2.0 KB", "5.0 MB"]


@pytest.mark.parametrize("percent, votes, label", [(95, 500, "Overwhelmingly Positive"), (95, 499, "Very Positive"), (80, 49, "Positive"), (79, 10, "Mostly Positive"), (40, 10, "Mixed"), (20, 10, "Mostly Negative"), (19, 500, "Overwhelmingly Negative"), (5, 50, "Very Negative"), (5, 49, "Negative"), (99, 9, None)])
def test_review_label(spark, percent, votes, label):
    assert spark.range(1).select(scalars.review_label(F.lit(percent), F.lit(votes))).first()[0] == label


def test_months(spark):
    rows = [("2020-02-29", "2020-01-31", 0), ("2021-02-28", "2020-08-31", 5), ("2020-01-15", "2021-01-15", 12), ("2020-01-15", "2021-01-14", 11)]
    df = spark.createDataFrame(rows, "a string, b string, w int").select(F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"), "w")
    assert all(r[0] == r[1] == r[2] for r in df.select("w", scalars.whole_months(F.col("a"), F.col("b")), scalars.whole_months(F.col("b"), F.col("a"))).collect())


def test_normalize_name(spark):
    pairs = {
        "Half-Life 2": "Half Life 2", "The Long Road V: Northland Special Edition": "Long Road V Northland", "Evil Manor 2 (Classic)": "Evil Manor 2", "Rock &amp; Stone": "Rock and Stone", "Game/Other": "Game", "™": "™", "Big Deluxe": "Big",
        "Best Hits Gold Collection": "Best Hits Gold", "Sons Of The Wild Wood": "Sons Of Wild Wood", "Final Battle Remade Edition": "Final Battle", "": "", None: "",
    }
    assert values(spark, "string", list(pairs), names.normalize_name) == list(pairs.values())
    assert values(spark, "string", ["A: B"], lambda c: names.normalize_name(c, cut_subtitle=True)) == ["A"]


def test_name_variants_and_slugs(spark):
    got = values(spark, "string", ["Nioh Tale 2 - The Complete Edition", "TERA - Action MMO", "Plain", "Dark: HD"], names.name_variants)
    assert got == [["Nioh Tale 2 The", "Nioh Tale 2"], ["TERA Action MMO", "TERA"], ["Plain"], ["Dark HD", "Dark"]]
    assert values(spark, "string", ["Café & Don’t… Stop!"], names.slug) == ["cafe-and-dont-stop"]
    assert values(spark, "string", ["X Demo", "Demo", "The alpha version now", None], names.is_demo) == [True, False, True, False]


def test_roman_and_phonetics():
    assert names.roman_words("Part IV and MIX VIII") == "Part 4 and 1009 8" and names.roman_words("Mild") == "Mild"
    assert names.swap_roman("Part IV") == "Part 4" and names.swap_number("Part 4") == "Part IV" and names.to_roman(49) == "XLIX"
    assert names.metaphone("Thompson") == "0MPSN" and names.metaphone("Knight") == "NFT" and names.metaphone("") == ""
    assert names.phoneme("Grand Theft Auto V") == "0FT 5 AT KRNT"
    assert names.similar_percent("World", "Word") == pytest.approx(88.888889) and names.similar_percent("", "") == 0
    assert names.sound_similarity("Half-Life 2", "Half Life 2") == (1, pytest.approx(0.87), True) and names.sound_similarity("", "x") is None


def test_title_forms_agree(spark):
    """The column forms and the plain ones on made-up titles."""
    rng = random.Random(1)
    bits = ["The ", "the ", "Edition", " ", "IV", " XIV", "MCM", " Deluxe", " Single Player", " A D x", " A D", " VR", " Collection", "Game", "&amp;", "&#233;", "&amp;#39;", "(", "foo)", "™", "GOTY", "/", ":", "Big", "of"]
    titles = ["".join(rng.choice(bits) for _ in range(rng.randrange(9))) for _ in range(500)]
    assert values(spark, "string", titles, names.normalize_name) == [names.normal_form(t) for t in titles]
    assert values(spark, "string", titles, lambda c: names.normalize_name(c, roman=True)) == [names.normal_form(t, roman=True) for t in titles]
    assert values(spark, "string", titles, names.roman_numbers) == [names.roman_words(t) for t in titles]
    df = spark.createDataFrame([("Dark Tale 3", "Dark Tale III"), ("Dark &amp; Deep", "dark and deep"), ("", None), ("Ab", "zz")], "a string, b string")
    assert [round(r[0], 3) for r in df.select(names.name_similarity(F.col("a"), F.col("b"))).collect()] == [100, 100, 0, 0]


def test_entities_are_decoded_once(spark):
    pairs = {
        "&amp;#39;": "&#39;", "&#233;&#64;": "é@", "&#x41;&#X41;": "A&#X41;", "&&lt;&": "&<&", "&AMP;lt;": "&lt;", "&#1f600; &#128512;": "\x01 😀", "&nope; &#; &;": "&nope; &#; &;",
        "&#abc;": "&#abc;", "&#1114112;": "&#1114112;", "&#55296;": "&#55296;", "&#99999999999;": "&#99999999999;", "&#0000000000065;": "A", "plain": "plain", None: None,
    }
    assert values(spark, "string", list(pairs), names.decode_entities) == list(pairs.values())
    assert [names.decode_text(t) for t in pairs if t] == [w for t, w in pairs.items() if t]


def test_parse_date(spark):
    d = datetime.date
    rows = {
        "2024-02-29": (d(2024, 2, 29), "day"), "2024-02-30": (d(2024, 1, 1), None), "2024-05-06T10:00:00Z": (d(2024, 5, 6), "day"), "1700000000": (d(2023, 11, 14), "day"), "1700000000000": (d(2023, 11, 14), "day"), "Q2 2024": (d(2024, 4, 1), "quarter"),
        "3 кв. 2023": (d(2023, 7, 1), "quarter"), "1999": (d(1999, 1, 1), "year"), "8 Nov, 2011": (d(2011, 11, 8), "day"), "Nov 8, 2011": (d(2011, 11, 8), "day"), "8 ноября 2011 г.": (d(2011, 11, 8), "day"), "März 2020": (d(2020, 3, 1), "month"), "2 août 2020": (d(2020, 8, 2), "day"),
        "31 Feb 2020": (None, "unknown"), "Coming soon": (None, "unknown"), "": (None, "unknown"), None: (None, "unknown"), "nonsense": (None, "unknown"),
    }
    got = dict(zip(rows, values(spark, "string", list(rows), dates.parse_date)))
    for text, (date, precision) in rows.items():
        if precision is not None:
            assert (got[text]["date"], got[text]["precision"]) == (date, precision), text
    assert got["2024-02-30"]["precision"] == "unknown"


def test_languages(spark):
    header = ["en;q=0.5,Deutsch", "es;q=0.2, fr-CA ; q=0.8, *;q=0.9", "zz", "", None, "fr;q=x"]
    assert values(spark, "string", header, languages.negotiate) == ["de", "fr", None, None, None, "fr"]


def test_html(spark):
    assert values(spark, "string", ["<p>A&amp;B<br/>c</p><ul><li>d</li></ul>", "<p></p>", None, "a&nbsp;&nbsp;b\\r\\nc"], html.html_text) == ["A&B\nc\n\nd", None, None, "a b\nc"]
    long = "One sentence here. " * 100
    assert values(spark, "string", [long, "x" * 60], lambda c: html.truncate_at_sentence(c, 50)) == ["One sentence here. One sentence here.", "x" * 50 + "…"]
    page = '<title> T </title><script type="application/ld+json">{"@type":"A"}</script><script type="application/ld+json">{"@type":"VideoGame","name":"N"}</script><script id="__NEXT_DATA__" type="application/json">{"a":1}</script>'
    assert values(spark, "string", [page], html.html_title) == ["T"]
    assert values(spark, "string", [page, "<html>"], lambda c: html.json_ld(c, "VideoGame", "name string")["name"]) == ["N", None]
    assert values(spark, "string", [page], lambda c: html.script_json(c, "__NEXT_DATA__")) == ['{"a":1}']


def test_words_of_dates(spark):
    """Which of several words counts, marks around words, shapes that hold no date, and line feeds."""
    want = {
        "05 jan 12. 2020": ("2020-01-05", "day"), "1 1999 20 may": ("1999-05-01", "day"), "(2019) 3 may\n2021.": ("2021-05-03", "day"), "mar june 2020": ("2020-06-01", "month"), "40 june 2020": ("2020-06-01", "month"),
        "31 feb 2020": (None, "unknown"), "2020-02-30 3 May 2021": ("2021-05-03", "day"), "2020-13-40": (None, "unknown"), "99999999999999999999": (None, "unknown"), "-86400": ("1969-12-31", "day"), "Q4, 1998": ("1998-10-01", "quarter"), "year 2020": ("2020-01-01", "year"), "maybe 5": (None, "unknown"),
    }
    df = spark.createDataFrame([(t,) for t in want], "t string").select("t", dates.parse_date(F.col("t")).alias("p")).select("t", F.col("p.date").cast("string").alias("d"), "p.precision")
    assert {r["t"]: (r["d"], r["precision"]) for r in df.collect()} == want

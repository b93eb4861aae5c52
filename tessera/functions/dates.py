"""Release dates as they are written in stores and on review sites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalars import let

# Words for a date that is not known.
UNKNOWN = ("coming soon", "tba", "to be announced", "soon", "скоро", "дата неизвестна", "demnächst", "bientôt")
# Month names and abbreviations in English, Russian, German and French.
MONTHS = {
    1: ("jan", "january", "янв", "январь", "января", "januar", "janv", "janvier"),
    2: ("feb", "february", "фев", "февр", "февраль", "февраля", "februar", "févr", "fevr", "février", "fevrier"),
    3: ("mar", "march", "мар", "март", "марта", "mär", "märz", "marz", "maerz", "mars"),
    4: ("apr", "april", "апр", "апрель", "апреля", "avr", "avril"),
    5: ("may", "май", "мая", "mai"),
    6: ("jun", "june", "июн", "июнь", "июня", "juni", "juin"),
    7: ("jul", "july", "июл", "июль", "июля", "juli", "juillet", "juil"),
    8: ("aug", "august", "авг", "август", "августа", "août", "aout"),
    9: ("sep", "sept", "september", "сен", "сент", "сентябрь", "сентября", "septembre"),
    10: ("oct", "october", "окт", "октябрь", "октября", "okt", "oktober", "octobre"),
    11: ("nov", "november", "ноя", "нояб", "ноябрь", "ноября", "novembre"),
    12: ("dec", "december", "дек", "декабрь", "декабря", "dez", "dezember", "décembre", "decembre", "déc"),
}


_EDGE = r"""[.,;:()"'`]*"""  # what may stand around a word of a date


def _last_word(text: Column, pattern: str) -> Column:
    """The last word of a text, without the marks around it, that is of a pattern; empty without one."""
    return F.regexp_extract(text, rf"(?s)^(?:.*\s)?{_EDGE}({pattern}){_EDGE}(?:\s.*)?$", 1)


def _named(low: Column) -> Column:
    """A date in words: the last four-digit number, the last month's name, the first number that can be a day; null without a year."""
    year = _last_word(low, r"\d{4}")
    name = _last_word(low, "|".join(n for names in MONTHS.values() for n in names))
    day = F.regexp_extract(low, rf"(?s)^(?:.*?\s)??{_EDGE}(0?[1-9]|[12]\d|3[01]){_EDGE}(?:\s.*)?$", 1)
    month = F.lit(None).cast("string")
    for number, names in MONTHS.items():
        month = F.when(name.isin(*names), f"{number:02d}").otherwise(month)
    parts = F.struct(year.alias("y"), F.when(name != "", month).alias("m"), F.when(day != "", F.lpad(day, 2, "0")).alias("d"))

    def dated(p: Column) -> Column:
        written = F.concat_ws("-", p["y"], F.coalesce(p["m"], F.lit("01")), F.when(p["m"].isNull(), "01").otherwise(F.coalesce(p["d"], F.lit("01")))).try_cast("date")
        precision = F.when(p["m"].isNull(), "year").when(p["d"].isNull(), "month").otherwise("day")
        return F.when(p["y"] != "", F.struct(written.alias("date"), precision.alias("precision")))

    return let(let(parts, dated), lambda x: F.when(x["date"].isNotNull(), x))


def _parsed(raw: Column) -> Column:
    low = F.lower(raw)
    number = raw.try_cast("double")
    seconds = F.when(F.abs(number) > 1e11, F.floor(number / 1000)).otherwise(number)
    unix = F.when(F.abs(seconds) < 2.5e11, F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")))
    first, second = r"^q\s*([1-4])\s*[,\s]\s*(\d{4})$", r"^([1-4])\s*(?:кв|q)\.?\s*(\d{4})"
    quarter = lambda q: F.make_date(F.regexp_extract(low, q, 2).try_cast("int"), (F.regexp_extract(low, q, 1).try_cast("int") - 1) * 3 + 1, F.lit(1))
    shapes = [
        (raw.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ].*)?$"), F.substring(raw, 1, 10).try_cast("date"), "day"),
        (raw.rlike(r"^-?\d{5,}$"), unix, "day"),
        (raw.rlike(r"^\d{4}$") & (raw != "0000"), F.concat(raw, F.lit("-01-01")).try_cast("date"), "year"),
        (low.rlike(first), quarter(first), "quarter"),
        (low.rlike(second), quarter(second), "quarter"),
    ]
    plain = F.lit(None).cast("struct<date: date, precision: string>")
    for shape, date, precision in reversed(shapes):
        plain = F.when(shape, F.struct(date.alias("date"), F.lit(precision).alias("precision"))).otherwise(plain)
    nothing = F.struct(F.lit(None).cast("date").alias("date"), F.lit("unknown").alias("precision"))
    ladder = let(plain, lambda x: F.when(x["date"].isNotNull(), x).otherwise(F.coalesce(_named(low), nothing)))
    return F.when(raw.isNull() | (raw == "") | low.isin(*UNKNOWN), nothing).otherwise(ladder)


def parse_date(text: Column) -> Column:
    """struct<date, precision> of a date as text: ISO, unix seconds or milliseconds, quarter, year, or day, month name and year in any order.

    precision: day, month, quarter, year or unknown (date null).  Months, quarters and years stand for their first day.  Only texts of none of the plain
    shapes are searched for words.
    """
    return let(F.trim(text.cast("string")), _parsed)


# Names of months as they are shown; Russian ones after a day, and alone.
SHOWN = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
SHOWN_RU_OF = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
SHOWN_RU = ("Январь", "Февраль", "Март", "Апрель", "Май", "Июнь", "Июль", "Август", "Сентябрь", "Октябрь", "Ноябрь", "Декабрь")
NOT_KNOWN = "???"


def shown_date(date: Column, precision: Column, lang: Column) -> Column:
    """A release date as a visitor reads it, by its precision, in Russian (ru) or English; ??? without a date or a known precision."""
    name = lambda names: F.get(F.array(*[F.lit(n) for n in names]), F.month(date) - 1)
    year, day, quarter = (c.cast("string") for c in (F.year(date), F.dayofmonth(date), F.quarter(date)))
    russian, space = F.coalesce(lang == "ru", F.lit(False)), F.lit(" ")
    whole = F.when(russian, F.concat(day, space, name(SHOWN_RU_OF), space, year)).otherwise(F.concat(name(SHOWN), space, day, F.lit(", "), year))
    month = F.concat(F.when(russian, name(SHOWN_RU)).otherwise(name(SHOWN)), space, year)
    third = F.when(russian, F.concat(quarter, F.lit(" квартал "), year)).otherwise(F.concat(F.lit("Q"), quarter, space, year))
    return F.coalesce(F.when(precision == "day", whole).when(precision == "month", month).when(precision == "quarter", third).when(precision == "year", year), F.lit(NOT_KNOWN))

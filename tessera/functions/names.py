"""Titles: normal forms, search variants, phonetic keys and similarity."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import let

# Named entities that titles and descriptions hold.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "trade": "™", "reg": "®", "copy": "©", "hellip": "…",
    "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "deg": "°", "amp": "&",
}
# Edition names that are cut out of titles (as written).
EDITIONS = (
    "(PC Download)", "(Classic)", "Digital Starter Pack", "Special Edition", "Definitive Edition", "Enhanced Edition", "Deluxe Edition",
    "Game of the Year Edition", "GOTY Edition", "Standard Edition", "Golden Edition", "Gold Edition", "Silver Edition",
    "Collector's Edition", "Redux", "GOTY",
)
# Endings that review sites leave out (any case).
SUFFIXES = (
    "Complete Edition", "Ultimate Edition", "Premium Edition", "Legendary Edition", "Anniversary Edition", "Slayer Edition",
    "Director's Cut", "Directors Cut", "Enhanced Edition", "Remastered", "Remaster", "Enhanced", "Definitive", "HD", "Edition",
    "Complete", "Collection", "Free to Play", "Free-to-Play", "F2P", "Lite", "Test Server", "Playtest",
)
# Roman numerals.
_ROMAN = (("M", 1000), ("CM", 900), ("D", 500), ("CD", 400), ("C", 100), ("XC", 90), ("L", 50), ("XL", 40), ("X", 10), ("IX", 9), ("V", 5), ("IV", 4), ("I", 1))
_ROMAN_WORD = "^" + "".join(f"(?:{letters})*+" for letters, _ in _ROMAN) + "$"


def _code_point(entity: Column) -> Column:
    """The number that '#65', '#0065' or '#x41' stands for; null for other texts.  A decimal number ends where its digits end ('#65f' is 65)."""
    hexa = F.regexp_extract(entity, "^#x0*([0-9a-fA-F]{1,6})$", 1)
    decimal = F.regexp_extract(entity, "^#0*([0-9]{1,7})(?:[a-fA-F][0-9a-fA-F]*)?$", 1)
    return F.when(hexa != "", F.conv(hexa, 16, 10).cast("int")).when(decimal != "", decimal.cast("int"))


def _character(code: Column) -> Column:
    """The character of a code point; null outside Unicode and for halves of surrogate pairs, which no text can hold."""
    held = code.between(0, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(held, code)), 8, "0")), "UTF-32")


def decode_entities(c: Column) -> Column:
    """Every numeric entity and the named ones of ENTITIES (in any case) as their characters, in one pass: what an entity gives is not read again.

    Unknown names and numbers that are no character stay as they are.  Texts without '&' are not taken apart.
    """
    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def decoded(part: Column) -> Column:
        def replaced(entity: Column) -> Column:
            char = F.when(entity.startswith("#"), let(_code_point(entity), _character)).otherwise(F.try_element_at(named, F.lower(entity)))
            return F.coalesce(F.concat(char, F.substring(part, F.length(entity) + 2, F.length(part))), F.concat(F.lit("&"), part))

        return let(F.regexp_extract(part, "^(#x?[0-9a-fA-F]+|[a-zA-Z]+);", 1), replaced)

    joined = lambda parts: F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), decoded), ""))
    return let(c, lambda text: F.when(text.contains("&"), let(F.split(text, "&"), joined)).otherwise(text))


def _without(c: Column, literal: str) -> Column:
    return F.replace(c, F.lit(literal), F.lit(""))


def _last(words: Column, back: int = 1) -> Column:
    return F.try_element_at(words, F.lit(-back))


def _roman_number(word: Column) -> Column:
    """A word made only of roman letters in falling order as a number, other words as they are."""
    pairs = [(letters, value) for letters, value in _ROMAN if len(letters) == 2]
    count = lambda letter: F.length(word) - F.length(F.replace(word, F.lit(letter), F.lit("")))
    total = F.lit(0)
    for letter, value in _ROMAN:
        if len(letter) == 1:
            total = total + count(letter) * value
    for letters, value in pairs:  # the smaller letter was added above
        lone = sum(v for letter, v in _ROMAN if letter in tuple(letters))
        total = total - F.regexp_count(word, F.lit(letters)) * (lone - value)
    return F.when((word != "") & word.rlike(_ROMAN_WORD), total.cast("string")).otherwise(word)


def roman_numbers(text: Column) -> Column:
    """Words made only of roman letters as numbers (the column form of roman_words)."""
    return F.when(text.rlike("(?:^| )[MDCLXVI]+(?: |$)"), F.array_join(F.transform(F.split(text, " "), _roman_number), " ")).otherwise(text)


def normalize_name(name: Column, *, soft: bool = False, cut_subtitle: bool = False, roman: bool = False) -> Column:
    """The normal form that titles are compared in; with `roman`, roman numerals as numbers.

    Text from the first slash on goes, '&' becomes 'and', editions, a last bracket and trade marks are cut, all else but ASCII letters and digits
    becomes single spaces.  Some last words and, in titles of over three words, 'The ' are cut.  If nothing is left, the title itself.
    """
    original = F.coalesce(name.cast("string"), F.lit(""))
    s = F.replace(F.split(F.trim(decode_entities(original)), "/")[0], F.lit("&"), F.lit("and"))
    if not soft:
        for token in EDITIONS:
            s = _without(s, token)
        s = F.regexp_replace(s, r"\s*\([^)]*\)[^(]*$", "")
    s = _without(s, "™")
    if cut_subtitle:
        s = F.trim(F.split(s, ":")[0])
    s = F.regexp_replace(s, "[^A-Za-z0-9]+", " ")
    if not soft:
        s = let(s, lambda t: _last_words(t, F.split(t, " "), original))
    return let(s, roman_numbers) if roman else s


def _last_words(s: Column, words: Column, original: Column) -> Column:
    """The rules on last words; all look at the words before any of them is applied."""
    before, last = F.size(words) - 1, _last(words)
    article = (before > 3) & (_last(words, 2) == "D") & (_last(words, 3) == "A")
    edition = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?i)\s*\S*?\s*edition$", ""), r"(?i)\bthe ", "")
    cut = (
        F.when((before > 0) & (last == "Deluxe"), _without(s, "Deluxe"))
        .when((before > 3) & (last == "Player"), _without(s, "Single Player"))
        .when((before > 1) & (last == "Collection"), _without(s, "Collection"))
        .when((before > 1) & (last == "VR"), _without(s, " VR"))
        .otherwise(s)
    )
    cut = F.when(article, _without(cut, " A D")).otherwise(cut)
    tidy = lambda t: F.trim(F.regexp_replace(F.when(before > 2, edition(t)).otherwise(t), " +", " "))
    return let(let(cut, tidy), lambda t: F.when(t == "", original).otherwise(t))


def strip_articles(c: Column) -> Column:
    """Without dangling articles and conjunctions at the end."""
    return F.trim(F.regexp_replace(c, r"(?i)(\s+(the|a|an|and|of|for))+$", ""))


def strip_suffixes(c: Column) -> Column:
    """Without up to three marketing endings, then without dangling articles."""
    words = "|".join(re.escape(x) for x in sorted(SUFFIXES, key=len, reverse=True)).replace(r"\ ", " ").replace(r"\-", "-")
    for _ in range(3):
        c = F.trim(F.regexp_replace(c, rf"(?i)\b(?:{words})$", ""))
    return strip_articles(c)


def name_variants(name: Column) -> Column:
    """Up to four different titles (case aside) to search a review site for, most specific first."""
    raw = F.coalesce(name.cast("string"), F.lit(""))
    head = F.trim(F.split(raw, r"\s+[-–—]\s+|:", 2)[0])
    has_tail = raw.rlike(r"\s+[-–—]\s+|:") & ((F.length(head) >= 4) | (F.size(F.split(head, r"\s+")) >= 2))
    d = F.when(has_tail, strip_suffixes(strip_articles(normalize_name(head))))
    ladder = let(normalize_name(name), lambda a: let(strip_articles(a), lambda b: F.array(a, b, strip_suffixes(b), d)))
    every = F.filter(F.transform(ladder, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    first = lambda e: F.filter(e, lambda x, i: F.array_position(F.transform(e, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    return F.slice(let(every, first), 1, 4)


_DANGLING = re.compile(r"(?:\s+(?:the|a|an|and|of|for))+$", re.I)


class VariantLadder:
    """Table function: the rungs of a title's variants, (place from 1, variant), from its normal form and that of its part before a dash or colon (null
    without one): the form, without dangling articles, without marketing endings, and the short form treated likewise; different ones, case aside."""

    def __init__(self):
        self.endings = re.compile(r"\b(?:" + "|".join(re.escape(x) for x in sorted(SUFFIXES, key=len, reverse=True)) + ")$", re.I)

    def _bare(self, title: str) -> str:
        for _ in range(3):
            title = self.endings.sub("", title).strip(" ")
        return _DANGLING.sub("", title).strip(" ")

    def eval(self, normal: str, head: str, most: int):
        rungs = []
        if normal is not None:
            plain = _DANGLING.sub("", normal).strip(" ")
            rungs = [normal.strip(" "), plain, self._bare(plain)]
        if head is not None:
            rungs.append(self._bare(_DANGLING.sub("", head).strip(" ")))
        seen = set()
        for rung in rungs:
            if rung and rung.lower() not in seen and len(seen) < most:
                seen.add(rung.lower())
                yield len(seen), rung


def variants_udtf():
    """The table function of VariantLadder, for lateral joins and for spark.udtf.register."""
    return F.udtf(VariantLadder, returnType="place int, variant string")


def with_variants(rows: DataFrame, name_col: str, most: int = 4) -> DataFrame:
    """Each row with its variants as rows of their own: its columns, place and variant; a lateral join with the table function.  Titles without a variant have
    no row."""
    raw = F.coalesce(F.col(name_col).cast("string"), F.lit(""))
    cut = F.trim(F.split(raw, r"\s+[-–—]\s+|:", 2)[0])
    has_tail = raw.rlike(r"\s+[-–—]\s+|:") & ((F.length(cut) >= 4) | (F.size(F.split(cut, r"\s+")) >= 2))
    held = rows.withColumn("__normal", normalize_name(raw)).withColumn("__head", F.when(has_tail, normalize_name(cut)))
    ladder = variants_udtf()
    return held.lateralJoin(ladder(F.col("__normal").outer(), F.col("__head").outer(), F.lit(most))).drop("__normal", "__head")


def is_demo(name: Column) -> Column:
    """Whether the last of several words is demo or soundtrack, or the title speaks of an alpha version."""
    words = F.split(F.trim(name), " ")
    return F.coalesce((F.size(words) > 1) & (F.lower(_last(words)).isin("demo", "soundtrack") | F.lower(name).contains("alpha version")), F.lit(False))


def fix_name(name: Column) -> Column:
    return F.trim(decode_entities(F.coalesce(name, F.lit(""))))


def to_ascii(c: Column) -> Column:
    """Typographic quotes, dashes and dots as ASCII."""
    return F.replace(F.translate(c, "‘’“”–— ", "''\"\"-- "), F.lit("…"), F.lit("..."))


def match_key(c: Column) -> Column:
    """The key that titles are joined on."""
    return F.lower(normalize_name(to_ascii(c)))


def slug(name: Column) -> Column:
    """A title as in web addresses: accents, apostrophes and full stops dropped, '&' as and, other runs as one hyphen."""
    accents, plain = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    s = F.translate(F.lower(to_ascii(name)), accents, plain)
    s = F.replace(F.regexp_replace(s, r"['.]", ""), F.lit("&"), F.lit("and"))
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")


# --- plain Python forms, for UDFs on distinct names ------------------------------------------------


def roman_words(text: str) -> str:
    """Words made only of roman letters as numbers; letters are taken greedily from the largest value down, without order checks."""

    def number(word: str) -> str:
        rest, total = word, 0
        for letters, value in _ROMAN:
            while rest.startswith(letters):
                rest, total = rest[len(letters) :], total + value
        return str(total) if word and not rest else word

    return " ".join(map(number, text.split(" ")))


_ENTITY = re.compile("&(#x?[0-9a-fA-F]+|[a-zA-Z]+);")


def decode_text(text: str) -> str:
    """decode_entities on one text."""

    def char(m: re.Match) -> str:
        entity = m[1]
        if entity[0] != "#":
            return ENTITIES.get(entity.lower(), m[0])
        digits = re.match("[0-9]*", entity[1:])[0]
        code = int(entity[2:], 16) if entity[1] == "x" else int(digits) if digits else -1
        return chr(code) if 0 <= code < 0xD800 or 0xE000 <= code <= 0x10FFFF else m[0]

    return _ENTITY.sub(char, text)


def normal_form(name: str | None, *, roman: bool = False) -> str:
    """normalize_name on one title."""
    original = name or ""
    s = decode_text(original).strip(" ").split("/")[0].replace("&", "and")
    for token in EDITIONS:
        s = s.replace(token, "")
    s = re.sub(r"\s*\([^)]*\)[^(]*$", "", s, flags=re.ASCII).replace("™", "")
    s = re.sub("[^A-Za-z0-9]+", " ", s)
    *before, last = s.split(" ")
    article = len(before) > 3 and before[-2:] == ["A", "D"]
    for word, least, cut in (("Deluxe", 0, "Deluxe"), ("Player", 3, "Single Player"), ("Collection", 1, "Collection"), ("VR", 1, " VR")):
        if last == word and len(before) > least:
            s = s.replace(cut, "")
    if article:
        s = s.replace(" A D", "")
    if len(before) > 2:
        s = re.sub(r"(?i)\bthe ", "", re.sub(r"(?i)\s*\S*?\s*edition$", "", s))
    s = re.sub(" +", " ", s).strip(" ") or original
    return roman_words(s) if roman else s


def to_roman(number: int) -> str:
    out = ""
    for letters, value in _ROMAN:
        out += letters * (number // value)
        number %= value
    return out


def swap_roman(text: str) -> str:
    """Stand-alone roman numerals from I to IX after a space as digits."""
    values = {to_roman(i): str(i) for i in range(1, 10)}
    return re.sub(r"(?<=\s)(IX|IV|V?I{1,3}|V)(?=\W)", lambda m: values.get(m[0], m[0]), f"{text} ", flags=re.ASCII).strip()


def swap_number(text: str) -> str:
    """Numbers of one or two digits after a space as roman numerals."""
    return re.sub(r"(?<=\s)[0-9]{1,2}", lambda m: to_roman(int(m[0])) or m[0], text)


# Sounds of a word's letters, tried in this order at each place; "=" stands for the letters themselves.
_SOUNDS = (
    ("^WH", "W"), ("(?<=(?P<twin>[ABD-Z]))(?P=twin)", ""), ("^[AEIOU]", "="), ("[AEIOU]", ""), ("(?<=M)B$", ""), ("[BFJKLMNR]", "="),
    ("C(?=IA)|CH", "X"), ("(?<=S)C(?=[EIY])", ""), ("C(?=[EIY])", "S"), ("CK?", "K"), ("DG(?=[EIY])", "J"), ("D", "T"),
    ("GH", "F"), ("^G(?=N)|G(?=N$)", ""), ("G(?=[EIY])", "J"), ("G", "K"), ("(?<=[AEIOU])H(?![AEIOU])", ""), ("H", "H"), ("PH", "F"), ("P", "P"),
    ("Q", "K"), ("SC(?=[EIY])", "S"), ("SH|S(?=I[AO])", "X"), ("S", "S"), ("T(?=I[AO])", "X"), ("T(?=CH)", ""), ("TH", "0"), ("T", "T"),
    ("V", "F"), ("[WY](?=[AEIOU])", "="), ("[WY]", ""), ("^X", "S"), ("X", "KS"), ("Z", "S"),
)
_SOUND = re.compile("|".join(f"(?P<s{i}>{pattern})" for i, (pattern, _) in enumerate(_SOUNDS)))
_CODES = {f"s{i}": code for i, (_, code) in enumerate(_SOUNDS)}


def metaphone(text: str | None) -> str:
    """Phonetic key of a word."""
    word = re.sub("[^A-Z]", "", (text or "").upper())
    word = re.sub("^(?:A(?=E)|[GKP](?=N)|W(?=R))", "", word)
    out = []
    for m in _SOUND.finditer(word):
        code = _CODES[next(k for k, v in m.groupdict().items() if v is not None and k != "twin")]
        out.append(m[0] if code == "=" else code)
    return "".join(out)


def phoneme(text: str | None) -> str:
    """Sorted phonetic keys of the words, numbers as they are."""
    words = swap_roman(text or "").split(" ")
    return " ".join(sorted(w if re.fullmatch(r"[+-]?\d*\.?\d+", w) else metaphone(w) for w in words)).strip()


def _longest_common(a: str, b: str) -> tuple[int, int, int, bool]:
    """Length and places of the longest common stretch (the first in a, then in b), and whether a shorter one begins before it.

    Rows are taken from the end of a, each from the row below it: the common stretch at (i, j) is one longer than that at (i + 1, j + 1).
    """
    best, at, first = 0, (0, 0), 0
    below = [0] * (len(b) + 1)
    for i in range(len(a) - 1, -1, -1):
        x = a[i]
        row = [below[j + 1] + 1 if x == y else 0 for j, y in enumerate(b)] + [0]
        top = max(row)
        if top:
            first = next(filter(None, row))
            if top >= best:
                best, at = top, (i, row.index(top))
        below = row
    return best, *at, first < best


def common_chars(a: str, b: str) -> int:
    """Characters in the longest common stretch and, left and right of it, in the stretches found likewise.

    The left side counts only if a shorter stretch was met before the longest.
    """
    total, work = 0, [(a, b)]
    while work:
        a, b = work.pop()
        best, i, j, risen = _longest_common(a, b)
        if best:
            total += best
            sides = [(a[i + best :], b[j + best :])]
            if risen:
                sides.append((a[:i], b[:j]))
            work += [pair for pair in sides if all(pair)]
    return total


def similar_percent(a: str | None, b: str | None) -> float:
    a, b = a or "", b or ""
    return common_chars(a, b) * 200 / (len(a) + len(b)) if a or b else 0.0


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def sound_similarity(a: str | None, b: str | None) -> tuple[int, float, bool] | None:
    """(distance of the phonetic keys, score, whether they are alike); None for empty or very long names."""
    if not a or not b or len(a) > 255 or len(b) > 255:
        return None
    pa, pb = phoneme(a), phoneme(b)
    cost = edit_distance(pa, pb)
    share = int(100 * cost / max((len(pa) + len(pb)) / 2, 1) + 0.5) / 100
    return cost, 1 - share, share < 0.2


@F.pandas_udf(T.StringType())
def roman_words_udf(s: pd.Series) -> pd.Series:
    return s.map(roman_words, na_action="ignore")


@F.pandas_udf(T.StringType())
def metaphone_udf(s: pd.Series) -> pd.Series:
    return s.map(metaphone)


@F.pandas_udf(T.StringType())
def phoneme_udf(s: pd.Series) -> pd.Series:
    return s.map(phoneme)


@F.pandas_udf(T.DoubleType())
def similar_percent_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar_percent(x, y) for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(T.StructType([T.StructField("cost", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("grade", T.BooleanType())]))
def sound_similarity_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sound_similarity(x, y) or (None, None, None) for x, y in zip(a, b)], columns=["cost", "score", "grade"])


@F.pandas_udf(T.StringType())
def spelling_key_udf(s: pd.Series) -> pd.Series:
    """Compatibility-composed, trimmed, single-spaced and lower-cased: spellings with one key are the same name."""
    return s.map(lambda x: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x)).strip().lower(), na_action="ignore")


@F.pandas_udf(T.DoubleType())
def _name_similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    forms = {x: normal_form(x, roman=True).lower() for x in {*a, *b}}
    return pd.Series([similar_percent(forms[x], forms[y]) for x, y in zip(a, b)], dtype=float)


def name_similarity(a: Column, b: Column) -> Column:
    """0..100: likeness of two titles in normal form with roman numerals as numbers; null counts as empty.

    One UDF takes the titles as they are: a UDF fed by normalize_name's nested expressions is one that Spark can't plan."""
    return _name_similarity_udf(a.cast("string"), b.cast("string"))

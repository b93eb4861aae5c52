"""Periodic runs of words: repeated k-grams mask each text, Main-Lorentz finds the runs of what is left."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.lineage import sliced

MIN_WORDS = 6
REPEATS = 4
WORD = r"[^\x20\x09-\x0D]+"
_WORDS = re.compile(WORD)
_OUT = "id {id}, text string, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def least_overlap(min_words: int, repeats: int) -> int:
    """Words that any run and itself moved by its period have in common at least: the k of the k-grams."""
    return min(max(min_words, repeats * q) - q for q in range(1, min_words + 1))


def repeated_kgrams(codes: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that the sequence holds more than once.

    k-grams are numbered exactly, by pairing the numbers of shorter ones: no hash takes different k-grams for one."""
    covered = np.zeros(len(codes), dtype=bool)
    n = len(codes) - k + 1
    if n < 2:
        return covered
    grams, width = codes, 1
    while width < k:
        step = min(width, k - width)  # a gram and the one that begins `step` words later make one of width + step
        grams = np.unique(grams[: len(grams) - step] * (len(codes) + 1) + grams[step:], return_inverse=True)[1].reshape(-1)
        width += step
    again = np.flatnonzero(np.bincount(grams)[grams] > 1)
    ends = np.zeros(len(codes) + 1, dtype=np.int64)
    ends[again] += 1
    ends[again + k] -= 1
    return np.cumsum(ends[:-1]) > 0


def _prefixes(s: list[int]) -> list[int]:
    """For each place, how many of the words from there on equal those from the start on (the Z array)."""
    n = len(s)
    z = [0] * n
    z[0] = n
    left = right = 0
    for i in range(1, n):
        same = min(right - i, z[i - left]) if i < right else 0
        while i + same < n and s[same] == s[i + same]:
            same += 1
        z[i] = same
        if i + same > right:
            left, right = i, i + same
    return z


def maximal_runs(s: list[int], min_words: int = MIN_WORDS, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs, by start, then period: stretches with the smallest period q, of at least min_words words and
    repeats * q (repeats: 2 or more), that no neighbouring word extends.

    Main and Lorentz: the sequence is halved again and again; runs across a middle have a whole period on one side of it, and how far each
    period goes on to both sides is read off four Z arrays.  Time is n log n."""
    found: dict[tuple[int, int], int] = {}
    parts = [(0, len(s))]
    while parts:
        low, high = parts.pop()
        if high - low < max(min_words, repeats):
            continue
        middle = (low + high) // 2
        parts += [(low, middle), (middle, high)]
        u, v = s[low:middle], s[middle:high]
        back = u[::-1]
        periods = min(len(u), len(v), (high - low) // repeats)  # of runs that lie within this part
        if not periods:
            continue
        on_right, on_left = _prefixes(v), _prefixes(back)
        before = _prefixes([*back, -1, *v[:periods][::-1], *back])
        after = _prefixes([*v, -1, *u[len(u) - periods :], *v])
        for p in range(1, periods + 1):
            right = middle - before[len(u) + 1 + periods - p], middle + p + (on_right[p] if p < len(v) else 0)
            left = middle - p - (on_left[p] if p < len(u) else 0), middle + after[len(v) + 1 + periods - p]
            for start, end in (right, left):
                if end - start < repeats * p or end - start < min_words:
                    continue
                if start == low and low and s[low - 1] == s[low - 1 + p] or end == high and high < len(s) and s[high] == s[high - p]:
                    continue  # it goes on: an earlier middle has it whole
                found[start, end] = min(p, found.get((start, end), p))
    return sorted((start, end - start, p) for (start, end), p in found.items())


def word_runs(words: list[str], min_words: int = MIN_WORDS, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """The runs of a list of words.  Words outside repeated k-grams can be in no run, so only the stretches between them are searched."""
    if len(words) < min_words:
        return []
    numbers: dict[str, int] = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    covered = repeated_kgrams(codes, least_overlap(min_words, repeats))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    out = []
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        out += [(start + at, length, p) for at, length, p in maximal_runs(codes[start:end].tolist(), min_words, repeats)]
    return out


def without_repeats(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run holds after its first period."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(gone).tolist()) if not inside]


def _searcher(min_words: int, repeats: int, kind: pa.DataType):
    def run(batches):
        for batch in sliced(batches, "text"):
            sizes, runs, collapsed = [], [], []
            for text in batch.column("text").to_pylist():
                words = _WORDS.findall(text or "")
                held = word_runs(words, min_words, repeats)
                sizes.append(len(words))
                runs.append([{"start": a, "length": n, "period": p} for a, n, p in held])
                collapsed.append(" ".join(without_repeats(words, held) if held else words))
            columns = [batch.column("id"), batch.column("text"), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "n_words", "runs", "collapsed"])

    return run


def text_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = MIN_WORDS, repeats: int = REPEATS) -> DataFrame:
    """One row per input row: the id, the text as it came, n_words, `runs` (start, length, period; by start, then period) and `collapsed`, the words
    outside the runs' repeats joined by single spaces.

    Words are what white space (blank, tab, line feed, vertical tab, form feed, carriage return) parts.  Null text has no words, no runs and an empty
    `collapsed`.  Null ids and repeated rows come out as they come in; other columns are ignored; an empty table gives an empty result.  Texts are
    searched whole, one at a time, in time n log n, whatever they repeat.
    """
    row = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(_searcher(min_words, repeats, row), _OUT.format(id=kind)).withColumnRenamed("id", id_col)


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, text): each text that holds a run without the runs' repeats, its words joined by single spaces; others, null included, as they are."""
    found = text_runs(docs, id_col, text_col, **options)
    return found.select(id_col, F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("text")).alias(text_col))


def planted(doc_id: Column, text: Column) -> Column:
    """The text, of every tenth document by crc32 of its id with words from a place on replaced by a repeated stretch (rule of the report)."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def rewritten(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, (a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")).otherwise(text)

    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), rewritten), F.lit(0))).otherwise(text)


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of text_runs over the documents with runs planted in every tenth: doc_id, n_runs; start, length, period, exponent_milli of the longest
    run (ties: smallest start, then period; null without a run); runs_sha256 and collapsed_sha256.

    A document without an id is taken as it is.  Nulls, empty texts and tables, repeated rows and other columns as text_runs."""
    text = F.col(f"`{text_col}`").cast("string")
    found = text_runs(docs.select(F.col(f"`{id_col}`").alias(id_col), planted(F.col(f"`{id_col}`"), text).alias("text")), id_col, "text")
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    rows = found.select(id_col, F.size("runs").cast("bigint").alias("n_runs"), longest.alias("x"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("x.less")
    exponent = F.floor(length * 1000 / F.col("x.period"))
    return rows.select(id_col, "n_runs", F.col("x.start").alias("start"), length.alias("length"), F.col("x.period").alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

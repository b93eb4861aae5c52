"""Periodic runs: the search against a plain scan of all periods, the rule of the report, and odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import runs


def scanned(words, least=6, repeats=4):
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, repeats * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def some_words(rng):
    n, letters = rng.randrange(60), rng.choice([1, 2, 3, 6])
    words = [str(rng.randrange(letters)) for _ in range(n)]
    block = [str(rng.randrange(letters)) for _ in range(rng.randrange(1, 9))]
    return words[: n // 2] + block * rng.randrange(7) + block[: rng.randrange(len(block))] + words[n // 3 :]


@pytest.mark.parametrize("least,repeats", [(6, 4), (4, 2), (5, 3), (9, 2), (1, 2)])
def test_runs_equal_a_scan_of_all_periods(least, repeats):
    rng = random.Random(least * 10 + repeats)
    for _ in range(1500):
        words = some_words(rng)
        assert runs.word_runs(words, least, repeats) == scanned(words, least, repeats)


def test_long_texts_of_one_repeat():
    assert runs.word_runs(["a"] * 20000) == [(0, 20000, 1)]
    assert runs.word_runs([str(i % 4999) for i in range(20000)]) == [(0, 20000, 4999)]
    assert runs.word_runs([str(i) for i in range(20000)]) == []


def test_words_outside_repeated_kgrams_are_masked():
    codes = np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5, 8, 7])
    assert runs.repeated_kgrams(codes, 5).tolist() == [True] * 5 + [False] + [True] * 5 + [False] * 2
    assert runs.least_overlap(6, 4) == 5 and runs.least_overlap(9, 2) == 5
    assert not runs.repeated_kgrams(np.arange(4), 5).any()


def plain_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = scanned(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    longest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *longest, digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_report_equals_plain_python(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n\x0b\f\r", "a", "a a a a a a", "é é é é é é é", "b " * 5, "x y " * 3000]
    texts += [" ".join(some_words(rng)) for _ in range(80)]
    rows = [(i, t, "extra") for i, t in enumerate(texts)] + [(None, "a a a a a a a", None), (3, "a", "extra"), (3, "a", "extra")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")
    got = [tuple(r) for r in runs.run_report(df).collect()]
    assert sorted(got, key=repr) == sorted((plain_report(i, t) for i, t, _ in rows), key=repr)
    assert runs.run_report(df.limit(0)).count() == 0


def test_collapsed_texts(spark):
    df = spark.createDataFrame([(1, "go a b a b a b a b end"), (2, "as  it\nis"), (3, None)], "id int, collapsed string")
    got = {r["id"]: r["collapsed"] for r in runs.collapse_runs(df, "id", "collapsed").collect()}
    assert got == {1: "go a b end", 2: "as  it\nis", 3: None}
    few = runs.text_runs(df, "id", "collapsed", min_words=3, repeats=3).select("id", F.size("runs").alias("n"), "n_words").orderBy("id").collect()
    assert [tuple(r) for r in few] == [(1, 1, 10), (2, 0, 3), (3, 0, 0)]

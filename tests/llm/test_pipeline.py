"""The corpus pipeline, each stage on what the one before kept, against plain Python."""

import random
import zlib

import numpy as np
import pytest

from tests_llm_plain import brute_lines, near

from tessera.llm import tokens


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """Rows (doc_id, text, source) and labels: junk that is marked as such, repeated lines, near copies, three sources, nulls."""
    rng = random.Random(51)
    prose = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rng.randrange(40)) for _ in range(n))
    rows, labels = [], []
    for i in range(160):
        junk = i % 4 == 0
        text = " ".join(rng.choice(["$$$", "!!!", "###", "@@"]) for _ in range(40)) if junk else "\n".join(prose(rng.randrange(6, 30)) for _ in range(4))
        if not junk:
            labels.append((i, 1, 0))
            text += "\nShared by all." if i % 3 else "\nthe same closing line stands in very many texts"
        else:
            labels.append((i, 0, 0))
        rows.append((i, text, ["a", "b", None][i % 3]))
    good = [r for r in rows if r[0] % 4]
    for k, (i, text, source) in enumerate(good[:30]):
        words = text.split(" ")
        if k % 2:
            words[len(words) // 2] = "changed"
        rows.append((1000 + i, " ".join(words), source))
    rows += [(2000, None, "a"), (2001, "", "b")]
    return rows, labels


def test_pipeline_stages(spark, corpus, tmp_path):
    import corpus_pipeline

    rows, labels = corpus
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "source mixing", "best-fit packing"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = f"{sf}/stage{i}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append([r.asDict() for r in docs.collect()])
    good, lined, single, mixed, packed = kept

    by_id = {i: t for i, t, _ in rows}
    ids = {r["doc_id"] for r in good}
    assert not ids & {i for i in range(0, 160, 4)} and ids >= {i for i, t, _ in rows if t and i % 4 and i < 160} | {i for i in by_id if 1000 <= i < 2000}
    assert all(r["text"] == by_id[r["doc_id"]] for r in good)

    gone = brute_lines([(r["doc_id"], r["text"]) for r in good], short_repeats=True)
    left = {r["doc_id"]: None if r["text"] is None else "\n".join(x for n, x in enumerate(r["text"].split("\n")) if (r["doc_id"], n) not in gone) for r in good}
    assert {r["doc_id"]: r["text"] for r in lined} == left and gone
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in lined)

    parent = {i: i for i in left}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(left)
    for k, a in enumerate(order):
        for b in order[:k]:
            if near(left[a], left[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in single) == sorted({root(i) for i in order}) and len(single) < len(lined)

    size = {r["doc_id"]: len((r["text"] or "").split()) for r in single}
    source = {r["doc_id"]: r["source"] for r in single}
    copies = {}
    for r in mixed:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 3 and copies.keys() <= size.keys()
    whole = {s: sum(n for i, n in size.items() if source[i] == s) for s in set(source.values())}
    taken = {s: sum(size[i] * n for i, n in copies.items() if source[i] == s) for s in whole}
    want = {"a": min(3 * whole["a"], sum(whole.values()) * 5 / 8)}
    assert abs(taken["a"] - want["a"]) <= max(size.values()) and abs(sum(taken.values()) - sum(whole.values())) <= 3 * max(size.values())

    encoder = tokens.encoder(tokens.vocabulary_path())
    pieces = sorted((r["doc_id"], zlib.crc32(np.array(encoder.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4").tobytes())) for r in mixed)
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in packed) == pieces
    held = {}
    for r in packed:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096

    again = sorted((r["doc_id"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert again == pieces


def stages(spark, docs, sf):
    import corpus_pipeline

    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert i == 4 or out.columns == docs.columns
        out.write.parquet(f"{sf}/out{i}")
        docs = spark.read.parquet(f"{sf}/out{i}")
    return docs


def test_pipeline_of_odd_tables(spark, tmp_path):
    """A very long text, rows of nulls, repeated rows, and columns named like those that the stages make."""
    rng = random.Random(52)
    prose = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon".split()) + str(rng.randrange(900)) for _ in range(n))
    rows = [(i, prose(20), "en", "ab"[i % 2], 1, i, "x", 0.5, 7, "y", i) for i in range(12)]
    rows += [(50, prose(60_000), "en", "a", 1, 0, "x", 0.5, 7, "y", 0), (None, None, None, None, None, None, None, None, None, None, None)]
    rows += rows[:2]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, key string, score double, copies int, row string, length bigint"
    sf = str(tmp_path)
    spark.createDataFrame([(i, 1, 0) for i in range(12)] + [(100, None, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    packed = stages(spark, spark.createDataFrame(rows, schema), sf)
    taken = {r["doc_id"]: r["node"] for r in spark.read.parquet(f"{sf}/out3").collect()}
    single = {r["doc_id"]: len(r["text"] or "") for r in spark.read.parquet(f"{sf}/out2").collect()}
    assert single.keys() == {*range(12), 50, None} and single[50] > 300_000
    assert {r["doc_id"] for r in packed.collect()} == taken.keys() <= single.keys() and all(taken[i] == i for i in taken if i is not None and i < 12)


def test_pipeline_of_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{sf}/labels.parquet")
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert stages(spark, docs, sf).count() == 0

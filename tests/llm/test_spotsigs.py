"""SpotSigs: signatures, likeness and report against plain Python, the similarity join against all pairs."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm import spotsigs


def plain_spots(text, chain=4):
    """The signatures as tuples of words instead of hashes."""
    if not text:
        return set()
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    if not words:
        return {text}
    common = set(spotsigs.COMMON)
    content = [w for w in words if w not in common]
    if not content or len(content) == len(words):
        return {(w, *words[i + 1 : i + 1 + chain]) for i, w in enumerate(words)}
    found = {("", *content[:chain])}
    for i, w in enumerate(words):
        behind = [x for x in words[i + 1 :] if x not in common][:chain]
        if w in common and behind:
            found.add((w, *behind))
    return found


def plain_jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "und", "la"] if rng.random() < 0.35 else [f"w{i}" for i in range(300)]) for _ in range(n))


ODD = ["", None, "!?", "the of and", "Alpha", "alpha beta gamma", "The alpha", "é the É", "the " * 30, "x " * 30 + "the", "the x " * 2000]


def test_signatures_equal_plain_python(spark):
    rng = random.Random(5)
    texts = ODD + [prose(rng, rng.randrange(1, 80)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", spotsigs.signatures(F.col("t")).alias("s"))
    got = {r["i"]: r["s"] for r in df.collect()}
    seen = {}
    for i, t in enumerate(texts):
        assert len(got[i]) == len(plain_spots(t)) and got[i] == sorted(set(got[i])), t
        for j in got:
            key = (frozenset(plain_spots(t)), frozenset(plain_spots(texts[j])))
            seen.setdefault(key, len(set(got[i]) & set(got[j])))
            assert seen[key] == len(key[0] & key[1])


def test_report_equals_plain_python(spark):
    rng = random.Random(6)
    texts = ODD + [prose(rng, rng.randrange(1, 60)) for _ in range(40)]
    rows = [(i * 7 % 101, t, "extra") for i, t in enumerate(texts)] + [(None, "the null id", "x"), (3, "the same id, other text", "y")]
    ids = sorted({(r[0] is None, -(r[0] or 0)) for r in rows})
    df = spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string, head string")
    got = spotsigs.fingerprint_report(df).collect()
    assert len(got) == len(rows) + 3 and len(ids) > 40
    single = {r[0] for r in rows if sum(x[0] == r[0] for x in rows) == 1 and r[0] is not None}
    order = sorted(single, reverse=True)
    text = {r[0]: r[1] or "" for r in rows}
    by = {r["doc_id"]: r for r in got if r["doc_id"] in single}
    after = {a: b for a, b in zip(order, order[1:]) if not any(b < r[0] < a for r in rows if r[0] is not None and r[0] not in single)}
    assert len(after) > 40
    for a, b in after.items():
        t, half = text[a], len(text[a]) // 2
        edited = t[: len(t) - half] + text[b][:half]
        r = by[a]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - plain_jaccard(plain_spots(t), plain_spots(edited))) < 1e-12 and abs(r["near_next"] - plain_jaccard(plain_spots(t), plain_spots(text[b]))) < 1e-12
        assert len(r["fingerprint"]) == 8 * len(plain_spots(t)) and (r["fingerprint"] == r["edited_fingerprint"]) == (plain_spots(t) == plain_spots(edited))
    assert spotsigs.fingerprint_report(df.limit(0)).count() == 0
    one = spotsigs.fingerprint_report(df.where("doc_id = 35").limit(1)).collect()
    assert one[0]["near_next"] == 1.0


def test_last_document_is_followed_by_the_first(spark):
    df = spark.createDataFrame([(i, f"the w{i} of x{i} und") for i in range(25)], "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r for r in spotsigs.fingerprint_report(df).collect()}
    t, u = "the w0 of x0 und", "the w24 of x24 und"
    assert got[0]["edited_sha256"] == hashlib.sha256((t[:8] + u[:8]).encode()).hexdigest()


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(7)
    texts = ["", None, "the of", "x"]
    for _ in range(25):
        words = prose(rng, rng.randrange(10, 120)).split()
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            other = list(words)
            for _ in range(rng.randrange(1, 1 + len(words) // 12 + 1)):
                other[rng.randrange(len(other))] = rng.choice(["the", "w1", "new"])
            texts.append(" ".join(other))
    texts += texts[4:8]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, node int")
    members, pairs = spotsigs.near_pairs(df, similarity=0.6)
    node = {r["doc_id"]: r["node"] for r in members.collect()}
    spots = [plain_spots(t) for t in texts]
    assert all((node[i] == node[j]) == (spots[i] == spots[j]) for i in node for j in node)
    want = {(min(node[i], node[j]), max(node[i], node[j])): plain_jaccard(spots[i], spots[j]) for i in node for j in node if node[i] != node[j] and spots[i] and spots[j] and plain_jaccard(spots[i], spots[j]) >= 0.6}
    got = {(r["a"], r["b"]): r["likeness"] for r in pairs.collect()}
    assert got.keys() == want.keys() and len(want) > 10 and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert all(x.count() == 0 for x in spotsigs.near_pairs(df.limit(0)))

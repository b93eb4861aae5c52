"""Document quality by attention-based multiple-instance learning over passages (numpy; trained on the driver, applied on the executors)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.alignment import word_codes
from tessera.llm.lineage import settled, sliced

PASSAGE_WORDS = 64
# Bounds of the sample that is learned from: labelled rows, and passages of all of them together (rows are left out, texts are never cut).
TRAIN_ROWS = 4000
TRAIN_PASSAGES = 60_000
THRESHOLD = 0.3
HIDDEN, GATE = 32, 16
WORD_BINS, GRAM_BINS = 256, 256

_CLASSES = 9


def _class_table() -> np.ndarray:
    """Classes of the bytes of UTF-8: lower case, upper case, digits, four kinds of signs, blanks, and all bytes of other letters and signs."""
    table = np.zeros(256, np.uint8)
    table[ord("a") : ord("z") + 1] = 1
    table[ord("A") : ord("Z") + 1] = 2
    table[ord("0") : ord("9") + 1] = 3
    for i, group in enumerate((".,;:", "!?", "#$%&*@^~|<>{}[]\\/=_+"), start=4):
        for c in group:
            table[ord(c)] = i
    table[[32, *range(9, 14)]] = 7
    table[128:] = 8
    return table


_TABLE = _class_table()
SHAPES = _CLASSES + 4
FEATURES = WORD_BINS + GRAM_BINS + SHAPES


def _rooted(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: each row has the length 1, or is empty."""
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def passage_features(text: str | None) -> np.ndarray:
    """One row of features for each passage of 64 words; a text without words has one row of zeros.

    They are the passage's words and the three-byte grams of its UTF-8, each counted in hash bins, its shares of byte classes, its length, the mean
    length of its words, and how many of its words it repeats itself or were said in the text before it.  Everything is taken from the text alone.
    """
    words = (text or "").split()
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    count, at = len(words), np.arange(len(words)) // PASSAGE_WORDS
    passages = int(at[-1]) + 1
    codes = word_codes(text)
    bins = lambda place, bin_, size: np.bincount(place * size + bin_, minlength=passages * size).reshape(passages, size)
    out = np.empty((passages, FEATURES), np.float32)
    out[:, :WORD_BINS] = _rooted(bins(at, (codes >> np.uint64(20)).astype(np.int64) % WORD_BINS, WORD_BINS))

    raw = np.frombuffer((" ".join(words) + " ").encode("utf-8"), np.uint8)
    blank = raw == 32
    place = np.minimum((np.cumsum(blank) - blank) // PASSAGE_WORDS, passages - 1)
    wide = raw.astype(np.uint32)
    grams = (wide[:-2] * np.uint32(0x9E3779B1) ^ wide[1:-1] * np.uint32(0x85EBCA77) ^ wide[2:] * np.uint32(0xC2B2AE3D)) if len(raw) > 2 else np.empty(0, np.uint32)
    grams = ((grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    out[:, WORD_BINS : WORD_BINS + GRAM_BINS] = _rooted(bins(place[: len(grams)], grams.astype(np.int64) % GRAM_BINS, GRAM_BINS))

    shape = out[:, WORD_BINS + GRAM_BINS :]
    sizes = np.bincount(place, minlength=passages)
    shape[:, :_CLASSES] = bins(place, _TABLE[raw].astype(np.int64), _CLASSES) / sizes[:, None]
    held = np.bincount(at, minlength=passages)
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    fresh = np.ones(count, bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    first = np.empty(count, np.int64)  # the place of each word's first occurrence in the text
    first[order] = order[np.maximum.accumulate(np.where(fresh, np.arange(count), 0))]
    before = np.bincount(at, at[first] < at, minlength=passages)
    last = np.ones(count, bool)
    pairs = np.lexsort((at, codes))
    last[pairs[1:]] = (codes[pairs[1:]] != codes[pairs[:-1]]) | (at[pairs[1:]] != at[pairs[:-1]])
    own = np.bincount(at, last, minlength=passages)
    shape[:, _CLASSES:] = np.stack([held / PASSAGE_WORDS, sizes / held / 16, own / held, before / held], axis=1)
    return out


@dataclass
class GatedAttention:
    """tanh passage encoder, gated attention weights w . (tanh(V h) * sigmoid(U h)), logistic score of the weighted mean."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray):
        p = self.p
        seg = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        a, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (a * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[seg])
        weight = e / np.add.reduceat(e, starts)[seg]
        z = np.add.reduceat(weight[:, None] * h, starts)
        logit = np.clip(z @ p["c"] + p["d"], -30, 30)
        return x, seg, h, a, g, weight, z, 1 / (1 + np.exp(-logit))

    def scores(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.forward(x, starts)[-1]


def gradients(model: GatedAttention, x: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss of some documents, by each parameter; x holds the passages of all, document after document."""
    p = model.p
    x, seg, h, a, g, weight, z, score = model.forward(x, starts)
    dl = (score - labels) / len(labels)
    dz = dl[:, None] * p["c"]
    dw = (dz[seg] * h).sum(1)
    de = weight * (dw - np.add.reduceat(weight * dw, starts)[seg])
    dag = de[:, None] * p["w"]
    da, dg = dag * g * (1 - a**2), dag * a * g * (1 - g)
    dh = (weight[:, None] * dz[seg] + da @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ da, "U": h.T @ dg, "w": (a * g).T @ de, "c": z.T @ dl, "d": np.array([dl.sum()])}


def _moments(bags: list[np.ndarray], batch: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of each feature over the passages of all documents, of which `batch` at a time are held in double precision."""
    parts = [range(at, min(at + batch, len(bags))) for at in range(0, len(bags), batch)]
    wide = lambda part: np.concatenate([bags[i] for i in part]).astype(float)
    count = sum(map(len, bags))
    mean = sum(wide(part).sum(0) for part in parts) / count
    return mean, np.sqrt(sum(((wide(part) - mean) ** 2).sum(0) for part in parts) / count) + 1e-2


def train(bags: list[np.ndarray], labels: np.ndarray, *, epochs: int = 20, batch: int = 64, rate: float = 0.01, decay: float = 1e-3, seed: int = 7) -> GatedAttention:
    """Fits the model to whole-document labels (Adam on the log loss); only document labels are seen, the passage weights are learned."""
    rng = np.random.default_rng(seed)
    d = bags[0].shape[1]
    p = {"W": rng.normal(0, d**-0.5, (d, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.array([np.log((labels.mean() + 0.01) / (1.01 - labels.mean()))])}
    model = GatedAttention(*_moments(bags, batch), p)
    m1, m2, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            sizes = [len(bags[i]) for i in chosen]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            grad = gradients(model, np.concatenate([bags[i] for i in chosen]).astype(float), starts, labels[chosen])
            t += 1
            step = rate * (1 - epoch / epochs)
            for k, v in grad.items():
                v = v + decay * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                p[k] -= step * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    return model


def held_out(id_: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text is divisible by 5 (null ids too)."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _featuriser(batches):
    for batch in sliced(batches, "text"):
        x = [passage_features(t) for t in batch.column("text").to_pylist()]
        columns = [batch.column("id"), batch.column("label"), pa.array([len(v) for v in x], pa.int32()), pa.array([v.astype("<f2").tobytes() for v in x], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "n", "x"])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, passages: int = TRAIN_PASSAGES, seed: int = 7) -> GatedAttention | None:
    """Trains on at most `rows` labelled documents that are not held out, chosen by the hash of their id, of which those are learned from, in that
    order, whose passages are at most `passages` together; each counts with all its passages.  None if there is no such row.

    Of several labels or texts of one id the largest counts.  Null labels and null ids are not learned from, null texts count as empty; ids without a
    document or without a label do no harm, nor do other columns of any name.  Empty tables: None.
    """
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(known), "id").groupBy("id").agg(F.max("label").alias("label"), F.max("text").alias("text"))  # at most `rows` rows
    kind = texts.schema["id"].dataType
    bags = settled(texts.mapInArrow(_featuriser, T.StructType([T.StructField("id", kind), T.StructField("label", T.DoubleType()), T.StructField("n", T.IntegerType()), T.StructField("x", T.BinaryType())])), "bags")
    chosen, total = [], 0
    for r in bags.orderBy(F.xxhash64(F.lit(seed), "id"), "id").select("id", "n").collect():
        if total + r["n"] <= passages:
            chosen.append((r["id"],))
            total += r["n"]
    if not chosen:
        return None
    held = bags.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("id", kind)]))), "id").select("label", "n", "x").collect()
    held.sort(key=lambda r: (bytes(r["x"]), r["label"]))
    x = [np.frombuffer(r["x"], "<f2").reshape(r["n"], FEATURES) for r in held]  # the bytes as they came, widened by the batch
    return train(x, np.array([r["label"] for r in held]))


def _scorer(model: GatedAttention | None):
    def run(batches):
        for batch in sliced(batches, "text"):
            texts = batch.column("text").to_pylist()
            scores = np.full(len(texts), 0.5)
            at = 0
            while model is not None and at < len(texts):
                bags, total = [], 0
                while at + len(bags) < len(texts) and total < 2000:
                    bags.append(passage_features(texts[at + len(bags)]).astype(np.float16))  # as in training
                    total += len(bags[-1])
                starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
                scores[at : at + len(bags)] = model.scores(np.concatenate(bags).astype(np.float32), starts)
                at += len(bags)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[:-1]), pa.array(scores)], names=[*batch.schema.names[:-1], "score"])

    return run


def _scored(docs: DataFrame, model: GatedAttention | None, text_col: str, keep: list[str]) -> DataFrame:
    """Columns c0, c1, ... (the columns `keep`) and score."""
    source = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    return source.mapInArrow(_scorer(model), schema)


def quality_report(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted.  Null text counts as empty, and empty texts are scored as one passage of zeros.
    Without any label every score is 0.5.  Rows of a null id count as held out; repeated rows are documents of their own; other columns are
    ignored; an empty table gives an empty result."""
    out = _scored(docs, fit(docs, labels, id_col=id_col, text_col=text_col), text_col, [id_col])
    return out.select(F.col("c0").alias(id_col), held_out(F.col("c0")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least `threshold`, all columns kept whatever their names; nulls, repeats and empty tables as quality_report."""
    out = _scored(docs, fit(docs, labels, id_col=id_col, text_col=text_col), text_col, docs.columns)
    return out.where(F.col("score") >= threshold).drop("score").toDF(*docs.columns)

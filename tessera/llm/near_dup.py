"""Near-duplicate classes of texts by Order MinHash, verified by banded alignment."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.alignment import band_width, banded_distance, order_minhash, sketch_seeds, word_codes
from tessera.llm.components import components
from tessera.llm.lineage import discard, row_key, settled, sliced, spare

K_WORDS = 5
PICKS = 2
SKETCHES = 60
SIMILARITY = 0.8
# Texts of up to so many words have further sketches (k, picks, sketches): a few edits leave a short text no k-mer of five words.
SHORT = ((75, 3, 2, 32), (20, 2, 1, 16))
SMALL = 16
SALT_ROWS = 1000
CLASSES = 32  # of words, by hash, whose counts bound what two texts can have in common
KINDS = 1 << 18  # of words, by hash, that are counted together to tell rare ones
PRIOR = 32  # rare words before a rare word of which two texts that meet at it must have none in common


def _sketcher(k: int, picks: int, sketches: int, seed: int, similarity: float):
    def run(batches):
        import numpy as np

        schemes = [(None, k, picks, sketch_seeds(sketches, seed))]
        # both texts of a near pair are in the scheme of the shorter one
        schemes += [(most / similarity, k_, picks_, sketch_seeds(many, seed + i + 1)) for i, (most, k_, picks_, many) in enumerate(SHORT)]
        for batch in sliced(batches, "text"):
            sizes, keys, lengths = [], [], [0]
            for text in batch.column("text"):
                codes = word_codes(text.as_py())
                found = [order_minhash(codes, k_, picks_, seeds, 1000 * i) for i, (most, k_, picks_, seeds) in enumerate(schemes) if len(codes) and (most is None or len(codes) <= most)]
                if len(codes):  # without the repeats a text's other words have sketches of their own; in texts without any these are the same
                    found = [np.unique(np.concatenate([*found, order_minhash(codes, k, picks, schemes[0][3], once=True)]))]
                sizes.append(len(codes))
                keys += found
                lengths.append(lengths[-1] + sum(map(len, found)))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat))], names=["node", "n", "keys"])

    return run


def _aligner(similarity: float):
    def run(batches):
        held: dict[int, object] = {}

        def codes(node, text):
            if node not in held:
                if len(held) > 64:
                    held.clear()
                held[node] = word_codes(text)
            return held[node]

        for batch in sliced(sliced(batches, "ta"), "tb"):
            a, b, ta, tb = (batch.column(c) for c in ("a", "b", "ta", "tb"))
            keep = []
            for i in range(batch.num_rows):
                left, right = codes(a[i].as_py(), ta[i].as_py()), codes(b[i].as_py(), tb[i].as_py())
                band = band_width(len(left), len(right), similarity)
                keep.append(abs(len(left) - len(right)) <= band and banded_distance(left, right, band) is not None)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return run


def _kinds(words, kinds: int):
    import numpy as np

    return ((words.view(np.uint64) >> np.uint64(33)) % np.uint64(kinds)).astype(np.int64)


def _counter(batches):
    """How many texts have the words of each kind: one count of a kind from each task."""
    import numpy as np

    total = np.zeros(KINDS, np.int64)
    for batch in sliced(batches, "text"):
        total += np.bincount(_kinds(np.concatenate([np.unique(word_codes(text.as_py())) for text in batch.column("text")]), KINDS), minlength=KINDS)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["kind", "texts"])


def _rare_words(similarity: float, counts):
    """Of each text the rarest words, by the count of their kind, that can stand in other texts too, as many as two near texts cannot both do without: rows
    (word, node, n, component, left: words from this one on, rest: the count of this word, then counts of those after it by class, prior: up to PRIOR words
    of the rows just before this one).  Any one order of all words loses no pair; this one makes few."""
    import numpy as np

    def run(batches):
        for batch in sliced(batches, "text"):
            out: list[tuple] = []
            size = 0

            def made():
                word, place, left, rest, prior, many = (np.concatenate([x[i] for x in out]) for i in range(6))
                offsets = np.arange(len(word) + 1, dtype=np.int32) * (CLASSES + 1)
                columns = [batch.column(c).take(pa.array(place)) for c in ("node", "n", "component")]
                rest = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rest.reshape(-1), pa.int32()))
                prior = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(prior))
                return pa.RecordBatch.from_arrays([pa.array(word), *columns, pa.array(left, pa.int32()), rest, prior], names=["word", "node", "n", "component", "left", "rest", "prior"])

            for i, text in enumerate(batch.column("text")):
                word, count = np.unique(word_codes(text.as_py()), return_counts=True)
                shared = counts[_kinds(word, KINDS)]
                order = np.lexsort((word, shared))
                shared, word, count = shared[order], word[order].view(np.int64), count[order].astype(np.int64)
                before = np.cumsum(count) - count
                n = int(before[-1] + count[-1])
                k = int(np.searchsorted(before, band_width(n, n, similarity), side="right"))
                kind = _kinds(word, CLASSES)
                gone = np.zeros((k, CLASSES), np.int64)
                gone[np.arange(k), kind[:k]] = count[:k]
                after = np.bincount(kind, count, minlength=CLASSES).astype(np.int64) - np.cumsum(gone, axis=0)
                keep = shared[:k] > 1
                word = word[:k][keep]
                many = np.minimum(np.arange(len(word)), PRIOR)
                prior = np.concatenate([word[at - m : at] for at, m in enumerate(many)]) if len(word) else word
                out.append((word, np.full(len(word), i), n - before[:k][keep], np.column_stack([count[:k], after])[keep], prior, many))
                size += len(word)
                if size >= 10_000:
                    yield made()
                    out, size = [], 0
            if out:
                yield made()

    return run


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose whole texts align within the band."""
    held = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return settled(held.select("a", "b", "ta", "tb").mapInArrow(_aligner(similarity), "a bigint, b bigint"), "links")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _led(rows: DataFrame, firsts: list[Column]) -> DataFrame:
    """Each bucket's rows with each of its leaders, the texts that have the highest of each of `firsts`; rows: key, size, node, n, component.

    A bucket of more than SALT_ROWS rows is joined in parts, to each of which its leaders go.
    """
    parts = F.ceil(F.col("size") / SALT_ROWS).cast("int")
    tops = [F.max(F.struct(f.alias("first"), "node", "n", "component")).alias("top") for f in firsts]
    leaders = rows.groupBy("key").agg(F.array(*tops).alias("tops"), F.first("size").alias("size"))
    leaders = leaders.select("key", "size", F.explode(F.array_distinct(F.transform("tops", lambda t: F.struct(t["node"].alias("leader"), t["n"].alias("leader_n"), t["component"].alias("led"))))).alias("x"))
    leaders = leaders.select("key", "x.*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return rows.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).join(leaders, ["key", "part"])


def _alike(n: str, m: str, similarity: float) -> Column:
    return F.abs(F.col(n) - F.col(m)) <= (1 - similarity) * F.greatest(n, m) + 1e-9


def _star(bucketed: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of each text and the most central text of each of its buckets."""
    placed = bucketed.withColumn("component", F.col("node"))
    return _led(placed, [F.col("weight")]).where("node <> leader").where(_alike("n", "leader_n", similarity)).select(*_ordered("node", "leader")).distinct()


def _can_be_near(other: str, similarity: float) -> Column:
    """Whether rows of rare words, or groups of them (least and greatest n, greatest left and rest), can hold near texts of which this is the first word
    in common: those have all but the band of the longer one's words in common, and none of these before this word."""
    longer = F.greatest("low", f"{other}low")
    need = longer - F.floor((1 - similarity) * longer + 1e-9)
    common = F.aggregate(F.zip_with("rest", f"{other}rest", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    alike = (F.col("high") >= need) & (F.col(f"{other}high") >= need)
    return alike & (F.col("left") >= need) & (F.col(f"{other}left") >= need) & (common >= need)


def _other(rows: DataFrame) -> DataFrame:
    return rows.select("word", *[F.col(c).alias(f"o_{c}") for c in rows.columns if c != "word"])


def _near_by_words(open_: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different components among the texts `open_` (node, n, component), without loss of near ones: those that share one of their rarest
    words and have enough words in common by class.  Components meet first, so that none is held against itself; then each text of the one with fewer
    texts of that word meets the other component, and those that can be near any of its texts meet these.  A pair comes from the first word in common."""
    import numpy as np

    whole = settled(texts.join(open_, "node").select("node", "n", "component", "text"), "large_texts")
    found = whole.select("text").mapInArrow(_counter, "kind int, texts bigint").groupBy("kind").agg(F.sum("texts").alias("texts")).toArrow()
    counts = np.zeros(KINDS, np.int32)
    counts[found.column("kind").to_numpy()] = np.minimum(found.column("texts").to_numpy(), 2**31 - 1)
    schema = "word bigint, node bigint, n int, component bigint, left int, rest array<int>, prior array<bigint>"
    rare = settled(whole.repartition("node").mapInArrow(_rare_words(similarity, counts), schema), "rare")
    most = F.array(*[F.max(F.col("rest")[i]) for i in range(CLASSES + 1)])
    groups = settled(rare.groupBy("word", "component").agg(F.count("*").alias("held"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("left").alias("left"), most.alias("rest")), "groups")
    met = groups.join(_other(groups), "word").where(F.struct("held", "component") < F.struct("o_held", "o_component")).where(_can_be_near("o_", similarity))
    met = met.select("word", "component", "o_component", "o_low", "o_high", "o_left", "o_rest")
    rows = rare.select("word", "component", "node", F.col("n").alias("low"), F.col("n").alias("high"), "left", "rest", "prior")
    held = rows.join(met, ["word", "component"]).where(_can_be_near("o_", similarity)).select(*rows.columns, "o_component").drop("component")
    pairs = held.join(_other(rows), ["word", "o_component"]).where(~F.arrays_overlap("prior", "o_prior")).where(_can_be_near("o_", similarity))
    pairs = settled(pairs.select(*_ordered("node", "o_node")).distinct(), "near")
    discard(whole, rare, groups)
    return pairs


def _open_pairs(placed: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different components from buckets that span several, without loss of near ones: in buckets of at most SMALL rows every two of like
    length, of the texts of larger ones those that can be near by their words."""
    spread = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    placed = settled(placed.join(spread, "key"), "open")
    large = settled(placed.where(F.col("size") > SMALL).select("node", "n", "component").distinct(), "large")
    by_words = _near_by_words(large, texts, similarity)
    few = placed.where(F.col("size") <= SMALL).select("key", "node", "n", "component")
    other = few.select("key", F.col("node").alias("m"), F.col("n").alias("m_n"), F.col("component").alias("m_component"))
    every = few.join(other, "key").where("node < m AND component <> m_component").where(_alike("n", "m_n", similarity))
    return by_words.unionByName(every.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = K_WORDS, picks: int = PICKS, sketches: int = SKETCHES, similarity: float = SIMILARITY, seed: int = 7) -> DataFrame:
    """One row per input row: the id, `node` (64-bit hash of the text), `component` (smallest node of its class)
    and `class_id` (smallest id of its class).

    Two texts are near-duplicates if their word sequences have an edit similarity 1 - distance / longer length of at least `similarity`;
    classes are the connected components.  Order MinHash proposes pairs: each sketch takes the `picks` smallest occurrence-labelled `k`-word
    k-mers in text order (short texts have further sketches of shorter k-mers, see SHORT; texts that repeat k-mers have further ones of each k-mer's
    first occurrence), and texts with an equal sketch share a bucket.  Every text is aligned with the bucket's most central text.  Buckets that
    still span several components go on: those of at most SMALL texts compare every two; the texts of larger ones are joined by their rarest words and
    counts of words, a filter that loses no near pair.  So every near pair that shares a sketch ends in one class, whatever the size of its bucket, and
    alignments are those of the star and of pairs that have nearly enough words in common.  The search is probabilistic in the sketches alone: a pair
    whose k-mer sets have Jaccard J shares one of them with a probability of about 1 - (1 - J^picks)^sketches.

    Null text counts as empty; empty texts form one class of their own.  Equal texts always share a class, however many copies there are.  A null
    id takes part; it is a class's id only if the class has no other.  Repeated rows are returned as often as they come in.  Other columns are
    ignored.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("node"), text.alias("text"))
    sketched = rows.select("node", "text").mapInArrow(_sketcher(k, picks, sketches, seed, similarity), "node bigint, n int, keys array<bigint>")
    nodes = settled(sketched.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys")), "sketches")
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    sized = settled(keyed.join(shared, "key"), "sized")
    weights = sized.groupBy("node").agg(F.sum("size").alias("weight"))
    bucketed = settled(sized.join(weights, "node"), "buckets")
    discard(nodes, sized)
    texts = settled(rows.select("node", "text").join(bucketed.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")

    first = settled(_star(bucketed, similarity), "star")
    links = _verified(first, texts, similarity)
    held = components(links)
    placed = bucketed.join(held, "node", "left").select("key", "size", "node", "n", F.coalesce("component", "node").alias("component"))
    fresh = settled(_open_pairs(placed, texts, similarity).join(first, ["a", "b"], "left_anti"), "pairs")
    more = _verified(fresh, texts, similarity)
    if not more.isEmpty():
        discard(held)
        held = components(links.unionByName(more))

    ids = settled(rows.select("id", "node").join(held, "node", "left").select("id", "node", F.coalesce("component", "node").alias("component")), "members")
    discard(bucketed, texts, held)
    classes = ids.groupBy("component").agg(F.min("id").alias("class_id"))
    return ids.join(classes, "component").select(F.col("id").alias(id_col), "node", "component", "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one row of each near-duplicate class: that of the smallest id (null ids last), of rows equal in id and text the one with
    the smallest hash of all columns.  All columns are kept; nulls, empty texts and tables as in near_duplicates."""
    names = docs.columns
    node_, of_, many_, whole_, kept_ = spare(names, "node", "id_of", "many", "whole", "kept_node")
    found = near_duplicates(docs, id_col, text_col, **options)
    rows = found.groupBy("component", F.col(id_col).alias("id"), "node").agg(F.count("*").alias("rows"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node", "rows")).alias("x"))
    first = settled(first.select(F.col("x.id").alias(of_), F.col("x.node").alias(node_), F.col("x.rows").alias(many_)), "first")
    kept = [F.col(f"`{c}`") for c in names]
    marked = docs.withColumn(node_, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    mine = first.withColumnRenamed(node_, kept_)
    joined = marked.join(mine, (F.col(node_) == F.col(kept_)) & F.col(f"`{id_col}`").eqNullSafe(F.col(of_)))
    if first.where(F.col(many_) > 1).isEmpty():
        return joined.select(*kept)
    single, several = (joined.where(F.col(many_) == 1).select(*kept), joined.where(F.col(many_) > 1))
    several = several.groupBy(node_, of_).agg(F.min_by(F.struct(*kept), row_key(docs, 0)).alias(whole_))
    return single.unionByName(several.select(*[F.col(whole_)[c].alias(c) for c in names]))

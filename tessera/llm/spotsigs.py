"""Document fingerprints by SpotSigs: chains of content words behind common words, compared as sets.  DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.lineage import settled

CHAIN = 4  # with its anchor a signature has five words
SIMILARITY = 0.8
# Common function words of English, German, French and Spanish.
COMMON = tuple(
    (
        "a about after all also an and are as at be because been but by can could do for from had has have he her his how i if in into is it its more no not of on one or our out "
        "she so some than that the their them then there these they this to up was we were what when which who will with would you your "
        "aber als am auch auf aus bei bis das dass dem den der die ein eine einen er es für hat ich im ist mit nach nicht noch nur oder sich sie sind und von war werden wie wird zu zum "
        "au aux avec ce cette dans des du elle en est et il la le les mais ne ou par pas plus pour qui que sa se ses son sont sur un une "
        "al como con del el esta este fue las los lo más muy o para pero por se sin su sus una y ya"
    ).split()
)


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signatures(text: Column, *, chain: int = CHAIN, common: tuple[str, ...] = COMMON) -> Column:
    """The sorted set of a text's signatures, 64-bit hashes: each common word, and the start of the text, with the next `chain` words that are not common
    (fewer at the end of the text).

    Words are runs of letters and digits in lower case.  A text without common words, or with no other ones, takes every word with the `chain` words
    behind it; one without words has the hash of itself.  Only null and empty texts have no signature.  Linear in the text.
    """
    held = list(dict.fromkeys(common))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def of(words: Column) -> Column:
        places = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(held), i)))
        content = F.filter(words, lambda w: ~w.isin(held))
        every = F.transform(words, lambda w, i: F.xxhash64(w, F.slice(words, i + 2, chain)))

        def spots(x: Column) -> Column:
            places, content = x["places"], x["content"]
            # the j-th common word has as many content words before it as its place is beyond j
            chains = F.transform(places, lambda p, j: F.struct(F.get(words, p).alias("w"), F.slice(content, p - j + 1, chain).alias("c")))
            behind = F.transform(F.filter(chains, lambda s: F.size(s["c"]) > 0), lambda s: F.xxhash64(s["w"], s["c"]))
            first = F.xxhash64(F.lit(""), F.slice(content, 1, chain))
            return F.when((F.size(places) == 0) | (F.size(content) == 0), every).otherwise(F.array_append(behind, first))

        return _let(F.struct(places.alias("places"), content.alias("content")), spots)

    found = _let(words, lambda w: F.when(F.size(w) == 0, F.array(F.xxhash64(text))).otherwise(of(w)))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(found)))


def fingerprint(sigs: Column) -> Column:
    """The signatures as text: the lower 32 bits of each, eight hexadecimal digits, in the order of the set."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 without a look at the members where their sizes keep it under `least`.  Two empty sets are equal."""
    na, nb = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    value = _let(both, lambda n: n / (na + nb - n))
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0) | (F.least(na, nb) < least * F.greatest(na, nb)), 0.0).otherwise(value)


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similarity: float = SIMILARITY, chain: int = CHAIN, common: tuple[str, ...] = COMMON) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members has each row's id and `node` (64-bit hash of its signature set; rows of one node have equal sets), pairs (a, b, likeness)
    all pairs of nodes a < b whose sets have a Jaccard similarity of at least `similarity`.

    Sets are partitioned by the logarithm of their size to the base 1 / similarity: similar sets lie in one partition or in neighbours, and the smaller
    set visits its upper neighbour.  Within a partition two similar sets share one of their rarest signatures (of size n the n - ceil(similarity * n) + 1
    rarest in the corpus); what shares one and has fitting sizes is measured.  Nothing is lost: candidates have no cap, copies are one node, and no
    group is ever gathered.  Null and empty texts are members of one node without pairs.  Repeated rows are members as often as they come in;
    an empty table gives empty results.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), signatures(F.col(f"`{text_col}`").cast("string"), chain=chain, common=common).alias("sigs"))
    held = settled(slim.withColumn("node", F.xxhash64("sigs")), "spots")
    sets = settled(held.where(F.size("sigs") > 0).dropDuplicates(["node"]).select("node", "sigs", F.size("sigs").alias("n")), "sets")
    often = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("often"))
    ranked = sets.select("node", "n", F.explode("sigs").alias("sig")).join(often, "sig")
    rarest = Window.partitionBy("node").orderBy("often", "sig")
    few = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    keys = ranked.withColumn("turn", F.row_number().over(rarest)).where(F.col("turn") <= few).where("often > 1")
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1 / similarity)) + 1e-9).cast("int")
    keys = settled(keys.select("node", "n", "sig", level.alias("level")), "keys")
    low = keys.select(F.col("node").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array("level", F.col("level") + 1)).alias("level"))
    high = keys.select(F.col("node").alias("b"), F.col("n").alias("nb"), "sig", "level")
    fits = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))
    found = low.join(high, ["sig", "level"]).where(fits & (F.col("na") >= similarity * F.col("nb") - 1e-9)).select("a", "b").distinct()
    one, two = sets.select(F.col("node").alias("a"), F.col("sigs").alias("sa")), sets.select(F.col("node").alias("b"), F.col("sigs").alias("sb"))
    measured = found.join(one, "a").join(two, "b").withColumn("likeness", jaccard(F.col("sa"), F.col("sb"), similarity - 1e-9)).where(F.col("likeness") >= similarity - 1e-12)
    pairs = measured.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")
    return held.select(F.col("id").alias(id_col), "node"), settled(pairs, "pairs")


def _ring(keys: DataFrame) -> DataFrame:
    """Each key (id, h) with the next one, descending id (null last), then ascending hash; after the last comes the first.

    Keys are dealt to ranges, ordered within each, and the ranges' ends are tied by a table of one row for each range."""
    spark = keys.sparkSession
    dealt = keys.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("id").desc_nulls_last(), F.col("h"))
    dealt = settled(dealt.withColumn("part", F.spark_partition_id()), "ring")
    line = Window.partitionBy("part").orderBy(F.col("id").desc_nulls_last(), "h")
    key = F.struct("id", "h")
    rows = dealt.withColumn("next", F.lead(key).over(line)).withColumn("turn", F.row_number().over(line))
    first = rows.where("turn = 1").select("part", key.alias("first"))
    last = Window.orderBy("part")
    ends = first.withColumn("after", F.coalesce(F.lead("first").over(last), F.first("first").over(last)))
    return rows.join(F.broadcast(ends.select("part", "after")), "part").select("id", "h", F.coalesce("next", "after").alias("next"), "n")  # one row a range


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: each text's fingerprint beside those of the next document
    (descending id, null last, then by the text's hash; after the last the first) and of the text whose later half is replaced by the next one's head.

    near_edited and near_next are Jaccard similarities of the signature sets.  Null texts count as empty; rows equal in id and text have one place in the
    order and come out as often as they come in; with a single row the next document is the document itself.  Other columns are ignored; an
    empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # rows meet by two hashes, of the id (null has one too) and of the text
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text")).withColumn("i", F.xxhash64("id"))
    ring = settled(_ring(base.select("id", "h", F.length("text").cast("bigint").alias("n")).distinct()), "ring")
    asked = ring.select(F.xxhash64("next.id").alias("i"), F.col("next.h").alias("h"), F.xxhash64("id").alias("asker"), F.col("h").alias("asker_h"), F.col("id").alias("asker_id"), F.floor(F.col("n") / 2).cast("int").alias("half"))
    keyed = base.select("i", "h", "text")  # dealt once, for both joins
    heads = keyed.join(asked.hint("merge"), ["i", "h"]).groupBy("i", "h").agg(*[F.first(c).alias(c) for c in ("text", "asker", "asker_h", "asker_id", "half")])  # repeated rows once
    heads = heads.select(F.col("asker").alias("i"), F.col("asker_h").alias("h"), F.col("asker_id").alias("id"), F.substring("text", F.lit(1), F.col("half")).alias("head"), signatures(F.col("text")).alias("next_sigs"))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), "head")
    rows = keyed.join(heads, ["i", "h"]).select("id", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"), "next_sigs")
    rows = rows.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), signatures(F.col("text")).alias("sigs"), signatures(F.col("edited")).alias("edited_sigs"), "next_sigs")
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )

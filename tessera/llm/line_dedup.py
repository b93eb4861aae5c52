"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.lineage import settled, spare

MIN_WORDS = 5
LINE_KEY = ["h", "g"]
_SUM_BITS = (1 << 42) - 1  # so many bits of a word's hash: sums over two million words fit a bigint


def _lines(docs: DataFrame, id_col: str, text_col: str, min_words: int, short_repeats: bool) -> DataFrame:
    """Lines of at least min_words words, or with short_repeats all that are not empty, with their place and two hashes of the line."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    spaces = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit("")))
    words = rows.withColumn("n_words", spaces + 1)
    return words.where(F.col("line") != "" if short_repeats else F.col("n_words") >= min_words).select("id", "row", "line_no", "line", "n_words", F.xxhash64("line").alias("h"), F.hash("line").alias("g"))


def _place() -> Column:
    """The order of lines: by id (null last), then the text's hash, then the line's number."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "row", "line_no")


def _halves() -> Column:
    """Hashes of the first and last q words for q = n // 2 and (n - 1) // 2.

    Lines within one word edit of each other have q = min(n, m) // 2 equal words at one end at least, and both emit that q.
    """

    def ends(q: Column) -> list[Column]:
        head, tail = (F.call_function("substring_index", F.col("line"), F.lit(" "), n) for n in (q, -q))
        return [F.xxhash64(F.lit(0), q, head), F.xxhash64(F.lit(1), q, tail)]

    long, short = F.floor(F.col("n_words") / 2).cast("int"), F.floor((F.col("n_words") - 1) / 2).cast("int")
    return F.when(long == short, F.array(*ends(long))).otherwise(F.array(*ends(long), *ends(short)))


def _same_words(a: Column, b: Column) -> Column:
    """Number of equal leading words."""
    n = F.least(F.size(a), F.size(b))
    at = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), False)
    return F.when(at == 0, n).otherwise(at - 1)


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word lists differ by at most one inserted, deleted or replaced word."""
    longer = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (_same_words(a, b) + _same_words(F.reverse(a), F.reverse(b)) >= longer - 1)


def deletion_variants(lines: DataFrame) -> DataFrame:
    """Rows (h, g, i, v) of lines (h, g, words): v is the hash of the line whole (i = 0) and without its i-th word.

    A line's hash is made of two sums over its words of a hash of word and place.  Without word i it is the sum before i and, with places one lower,
    the sum after it; running sums give all variants of a line in time proportional to its length.
    """
    spark = lines.sparkSession
    dealt = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *LINE_KEY)  # long lines are few but heavy
    words = dealt.select("h", "g", F.size("words").alias("n"), F.posexplode(F.transform("words", lambda w: F.xxhash64(w))).alias("at", "code")).withColumn("i", F.col("at") + 1)
    parts = {f"{name}{s}": F.xxhash64(F.lit(s), "code", place).bitwiseAND(F.lit(_SUM_BITS)) for s in (1, 2) for name, place in (("own", F.col("i")), ("moved", F.col("i") - 1))}
    line = Window.partitionBy(*LINE_KEY)
    so_far = line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sums = words.select("h", "g", "n", "i", *[c.alias(k) for k, c in parts.items()])
    sums = sums.select("h", "g", "n", "i", *[F.sum(f"own{s}").over(line).alias(f"whole{s}") for s in (1, 2)], *[(F.sum(f"own{s}").over(so_far) - F.col(f"own{s}") + F.sum(f"moved{s}").over(line) - F.sum(f"moved{s}").over(so_far)).alias(f"without{s}") for s in (1, 2)])
    variant = F.struct("i", F.xxhash64("without1", "without2", F.col("n") - 1).alias("v"))
    whole = F.struct(F.lit(0).alias("i"), F.xxhash64("whole1", "whole2", "n").alias("v"))
    return sums.select("h", "g", F.explode(F.when(F.col("i") == 1, F.array(whole, variant)).otherwise(F.array(variant))).alias("x")).select("h", "g", "x.i", "x.v")


def near_lines(candidates: DataFrame) -> DataFrame:
    """Rows (h, g, other): for each line (h, g, words, first) the earliest lines within one word edit, one for each variant at most.

    Each line emits its hash whole and without each of its words.  A replaced word at place i shows as equal variants without i, an inserted one as
    a variant equal to a whole line.  Each group of equal keys is aggregated, not paired.
    """
    keys = settled(deletion_variants(candidates.select("h", "g", "words")), "variants")
    again = keys.groupBy("v").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("v")
    owners = candidates.select("h", "g", F.struct("first", "h", "g").alias("own"))
    shared = settled(keys.join(again, "v").join(owners, LINE_KEY), "shared")  # keys of two lines at least

    variants, wholes = shared.where("i > 0"), shared.where("i = 0").select("h", "g", "own", "v")
    replaced = variants.groupBy("v", "i").agg(F.min("own").alias("other"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = variants.join(replaced, ["v", "i"]).select("h", "g", "other")
    shorter = wholes.groupBy("v").agg(F.min("own").alias("other"))
    found = found.unionByName(variants.join(shorter, "v").select("h", "g", "other"))
    longer = variants.groupBy("v").agg(F.min("own").alias("other"))
    found = found.unionByName(wholes.join(longer, "v").select("h", "g", "other"))
    found = found.where((F.col("other.h") != F.col("h")) | (F.col("other.g") != F.col("g"))).distinct()

    words = candidates.select("h", "g", "words")
    pairs = found.join(words, LINE_KEY).join(words.select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("words").alias("words2")), (F.col("other.h") == F.col("h2")) & (F.col("other.g") == F.col("g2")))
    return pairs.where(within_one_edit(F.col("words"), F.col("words2"))).select("h", "g", F.col("other.first").alias("near"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = MIN_WORDS, short_repeats: bool = True) -> DataFrame:
    """Rows (id, row, dropped): for each document with repeated lines, the numbers (from 0) of the lines that go; `row` is the text's 64-bit hash.

    Lines are parted by line feeds, words by single spaces.  Of lines with at least min_words words, one goes if a line earlier in the order
    (id, null last; text hash; number) is equal or at most one inserted, deleted or replaced word away (so their similarity is 0.8 or more, as it would not be
    in lines of fewer than five words); of shorter lines that are not empty equal repeats go, unless short_repeats is false.  Null texts have no lines.  Rows equal in id and text count as one document: none is earlier than the other.
    """
    seen = _lines(docs, id_col, text_col, min_words, short_repeats)
    halves = F.when(F.col("n_words") >= min_words, _halves()) if short_repeats else _halves()
    lines = settled(seen.select(*LINE_KEY, _place().alias("place"), halves.alias("halves")).groupBy(*LINE_KEY).agg(F.min("place").alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves")), "lines")

    halves = lines.select(*LINE_KEY, F.explode(F.array_distinct("halves")).alias("key"))
    shared = halves.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    close = halves.join(shared, "key").select(*LINE_KEY).distinct()
    close = settled(lines.join(close, LINE_KEY).select(*LINE_KEY, "first"), "close")
    texts = seen.select(*LINE_KEY, "id", "row", "line_no", "line").join(close, LINE_KEY).where(_place() == F.col("first")).select(*LINE_KEY, "first", F.split("line", " ").alias("words")).dropDuplicates(LINE_KEY)
    near = settled(near_lines(settled(texts, "candidates")).groupBy(*LINE_KEY).agg(F.min("near").alias("near")), "near")

    marked = lines.select(*LINE_KEY, "first", "n").join(near, LINE_KEY, "left").select(*LINE_KEY, F.coalesce(F.least("first", "near"), "first").alias("kept"), (F.col("n") > 1).alias("again"), (F.col("near") < F.col("first")).alias("late"))
    marked = marked.where("again OR late").select(*LINE_KEY, "kept")
    gone = seen.select(*LINE_KEY, "id", "row", "line_no").join(marked, LINE_KEY).where(_place() > F.col("kept"))
    return gone.groupBy("id", "row").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def _row_joined(docs: DataFrame, gone: DataFrame, id_col: str, row: Column) -> DataFrame:
    """The documents and last, in a column of an unused name, the numbers of their lines that go (null: none)."""
    row_, id_, gone_, dropped_ = spare(docs.columns, "row", "id", "gone", "dropped")
    marked = docs.withColumn(row_, row)
    gone = gone.select(F.col("id").alias(id_), F.col("row").alias(gone_), F.col("dropped").alias(dropped_))
    return marked.join(gone, marked[id_col].eqNullSafe(gone[id_]) & (marked[row_] == gone[gone_]), "left").select(*[marked[f"`{c}`"] for c in docs.columns], gone[dropped_])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = MIN_WORDS, short_repeats: bool = True) -> DataFrame:
    """One row per document: the id, n_lines (0 for null text), n_dropped and dropped (numbers of the lines that go, ascending).  Nulls, repeats and
    ties as repeated_lines; other columns are ignored; an empty table gives an empty result."""
    gone = settled(repeated_lines(docs, id_col, text_col, min_words=min_words, short_repeats=short_repeats), "dropped")
    text = F.col(text_col).cast("string")
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n")))
    slim = docs.select(F.col(id_col).alias("key"), n_lines.alias("n_lines"), F.xxhash64(text).alias("text"))
    out = _row_joined(slim, gone, "key", F.col("text")).toDF("key", "n_lines", "text", "gone").withColumn("dropped", F.coalesce("gone", F.array().cast("array<int>")))
    return out.select(F.col("key").alias(id_col), "n_lines", F.size("dropped").alias("n_dropped"), "dropped")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = MIN_WORDS, short_repeats: bool = True, length_col: str | None = None) -> DataFrame:
    """The documents, all columns kept, without their repeated lines (see repeated_lines); no document goes, texts may become empty.

    length_col, if given, is set to the new length of changed texts.  Null texts stay null, rows equal in id and text change alike, columns of
    any name are kept, and an empty table gives an empty one.
    """
    gone = settled(repeated_lines(docs, id_col, text_col, min_words=min_words, short_repeats=short_repeats), "dropped")
    text = F.col(text_col).cast("string")
    out = _row_joined(docs, gone, id_col, F.xxhash64(text))
    dropped = F.col(f"`{out.columns[-1]}`")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(dropped, i)), "\n")
    changed = dropped.isNotNull()
    out = out.withColumn(text_col, F.when(changed, left).otherwise(F.col(text_col)))
    if length_col:
        out = out.withColumn(length_col, F.when(changed, F.length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

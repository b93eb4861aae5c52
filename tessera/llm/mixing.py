"""Mixing overlapping sources to target weights: a min-cost flow over membership patterns, then a seeded choice of documents."""

from __future__ import annotations

import json
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.lineage import row_key, settled, spare

WEIGHTS = (5, 2, 1)
REPEATS = 3
BUCKET_ROWS = 1000
MAX_PATTERNS = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_order(sources) -> list:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def targets(sizes: dict, weights: dict, total: int, repeats: int = REPEATS) -> dict:
    """Shares of `total` by weight; none above `repeats` times its source's size, the excess is shared again by weight."""
    found, open_, left = {}, [s for s in sizes if weights[s] > 0], Fraction(total)
    for s in sizes:
        found[s] = Fraction(0)
    while open_ and left > 0:
        whole = sum(Fraction(weights[s]) for s in open_)
        over = [s for s in open_ if left * Fraction(weights[s]) / whole > repeats * sizes[s]]
        if not over:
            for s in open_:
                found[s] = left * Fraction(weights[s]) / whole
            break
        for s in over:
            found[s] = Fraction(repeats * sizes[s])
            left -= found[s]
        open_ = [s for s in open_ if s not in over]
    return found


class Network:
    """Arcs with capacities; `fill` adds a maximum flow to the flow so far (Dinic: blocking flows on shortest paths, many paths to a sweep)."""

    def __init__(self, nodes: int):
        self.head: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, capacity: int) -> int:
        """The number of a new arc; its flow is the room of the arc after it."""
        self.head[a].append(len(self.to))
        self.head[b].append(len(self.to) + 1)
        self.to += (b, a)
        self.room += (capacity, 0)
        return len(self.to) - 2

    def _levels(self, start: int, end: int) -> list[int] | None:
        level = [-1] * len(self.head)
        level[start], front = 0, [start]
        while front:
            after = []
            for a in front:
                for e in self.head[a]:
                    b = self.to[e]
                    if self.room[e] and level[b] < 0:
                        level[b] = level[a] + 1
                        after.append(b)
            front = after
        return level if level[end] >= 0 else None

    def fill(self, start: int, end: int) -> None:
        head, to, room = self.head, self.to, self.room
        while (level := self._levels(start, end)) is not None:
            turn, path, a = [0] * len(head), [], start
            while True:
                if a == end:
                    push = min(room[e] for e in path)
                    back = None
                    for i, e in enumerate(path):
                        room[e] -= push
                        room[e ^ 1] += push
                        if back is None and not room[e]:
                            back = i
                    a = to[path[back] ^ 1]
                    del path[back:]
                while turn[a] < len(head[a]):
                    e = head[a][turn[a]]
                    if room[e] and level[to[e]] == level[a] + 1:
                        break
                    turn[a] += 1
                if turn[a] < len(head[a]):
                    path.append(e)
                    a = to[e]
                elif a == start:
                    break
                else:
                    a = to[path.pop() ^ 1]
                    turn[a] += 1


def route(patterns: dict[str, int], quotas: dict, repeats: int = REPEATS) -> dict[str, dict]:
    """Tokens that each pattern (JSON list of its sources -> size) gives to each source: a maximum flow to the quotas of least cost.

    A pattern offers its size once at cost 0 a token, a second time at cost 1, a third at 2: repetition is convex, so no source repeats
    documents while others that it shares have not been used.  Only these offers cost anything, so the shortest paths come in levels: each level
    is opened for all patterns at once and filled by a maximum flow, which may reroute what lower levels gave.
    """
    names, place = list(patterns), {s: 2 + len(patterns) + i for i, s in enumerate(quotas)}
    net = Network(2 + len(patterns) + len(quotas))
    offers = [net.arc(0, 2 + i, 0) for i in range(len(names))]
    links = []
    for i, p in enumerate(names):
        links += [(net.arc(2 + i, place[s], repeats * patterns[p]), p, s) for s in json.loads(p) if s in place]
    for s, quota in quotas.items():
        net.arc(place[s], 1, int(quota))
    for _ in range(repeats):
        for e, p in zip(offers, names):
            net.room[e] += patterns[p]
        net.fill(0, 1)
    found: dict[str, dict] = {p: {} for p in names}
    for e, p, s in links:
        if net.room[e + 1]:
            found[p][s] = net.room[e + 1]
    return found


def _close_gap(sizes: np.ndarray, counts: np.ndarray, taken: np.ndarray, gap: int, swaps: int = 50) -> None:
    """Swaps a taken document for a longer one that is not, as long as that brings the sum closer to the cut."""
    for _ in range(swaps):
        chosen, other = np.flatnonzero(taken > 0), np.flatnonzero(taken < counts)
        if gap <= 0 or not len(chosen) or not len(other):
            return
        chosen = chosen[np.argsort(sizes[chosen], kind="stable")]
        at = np.searchsorted(sizes[chosen], sizes[other] - gap, side="left")
        fits = at < len(chosen)
        gain = np.where(fits, sizes[other] - sizes[chosen[np.minimum(at, len(chosen) - 1)]], 0)
        best = int(gain.argmax())
        if gain[best] <= 0:
            return
        taken[chosen[at[best]]] -= 1
        taken[other[best]] += 1
        gap -= int(gain[best])


def _choose(rows: pd.DataFrame) -> pd.DataFrame:
    """How many of the `count` equal rows of each key are taken once more, so that their sizes come close to `left` without passing it."""
    rows = rows.sort_values(["key", "size"], kind="stable")
    sizes, counts, left = rows["size"].to_numpy(), rows["count"].to_numpy(), int(rows["left"].iloc[0])
    taken = np.zeros(len(rows), np.int64)
    for i, (size, count) in enumerate(zip(sizes.tolist(), counts.tolist())):
        taken[i] = count if not size else min(count, left // size)
        left -= int(taken[i]) * size
    _close_gap(sizes, counts, taken, left)
    return pd.DataFrame({"pattern": rows["pattern"], "key": rows["key"], "count": counts, "more": taken})


@dataclass(frozen=True)
class Mix:
    """The plan of a mix: sizes and targets by source, tokens by pattern and source; `documents` has the input rows and how often each is taken."""

    documents: DataFrame
    copies_col: str
    sizes: dict
    targets: dict
    flows: dict


def _cuts(slim: DataFrame, plan: DataFrame, spread: int = 1024) -> DataFrame:
    """Rows (pattern, cut, left): the one bucket of each pattern in which its part ends, and what is left of the part there.

    Sizes before a bucket are those of the ranges of `spread` buckets before, and of the buckets before in its range: no task orders a whole pattern.
    """
    sums = settled(slim.groupBy("pattern", "bucket").agg(F.sum("size").alias("held")), "buckets").withColumn("range", F.floor(F.col("bucket") / spread))
    ranges = sums.groupBy("pattern", "range").agg(F.sum("held").alias("whole"))
    ahead = F.sum("whole").over(Window.partitionBy("pattern").orderBy("range")) - F.col("whole")
    within = F.sum("held").over(Window.partitionBy("pattern", "range").orderBy("bucket")) - F.col("held")
    begins = sums.withColumn("within", within).join(ranges.select("pattern", "range", ahead.alias("ahead")), ["pattern", "range"])
    left = F.col("part") - F.col("ahead") - F.col("within")
    return begins.join(F.broadcast(plan), "pattern").select("pattern", F.col("bucket").alias("cut"), left.alias("left"), "held").where("left >= 0 AND left < held").drop("held")


def mix_sources(docs: DataFrame, members: Column, size: Column, *, weights: dict | tuple = WEIGHTS, total_share: float = 1.0, repeats: int = REPEATS, seed: int = 7, bucket_rows: int = BUCKET_ROWS, key: Column | None = None) -> Mix:
    """How often each document is taken, so that the sources come to their target weights: all input columns and copies_col (0..repeats).

    members: the document's sources (array of strings; a null element is a source of its own; null or empty: the document is never taken).
    size: its tokens (null or negative: 0).  weights: by source, or a tuple that repeats over the sources in code-point order, null last.
    Documents are summed by membership pattern; the driver holds one number for each pattern and refuses over MAX_PATTERNS of them.  A pattern's
    tokens are taken in whole rounds and one seeded part: its documents lie in hash buckets of about `bucket_rows`, buckets before the cut are
    taken whole, and within the one bucket that holds the cut documents are taken in seeded order while they fit.  The order is that of a seeded
    hash of all columns, so rows share a place in it only if they are equal; of equal rows it does not matter which is taken.  Documents of size 0 are
    taken as often as the bucket they lie in.  Only sizes and hashes go through Python.  Reruns agree.  An empty table gives an empty result.
    copies_col is "copies", with underscores after it if the input has that column.  key: another bigint to order the documents by; rows with
    equal keys then share a place.
    """
    spark, names = docs.sparkSession, docs.columns
    copies, pattern_, key_, bucket_, count_, more_, rounds_, cut_, part_, turn_, ahead_ = spare(names, "copies", "pattern", "key", "bucket", "count", "more", "rounds", "cut", "part", "turn", "ahead")
    pattern = F.to_json(F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>")))))
    key = row_key(docs, seed) if key is None else key
    slim = settled(docs.select(pattern.alias("pattern"), key.alias("key"), F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0)).alias("size")), "sizes")
    totals = slim.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    sizes: dict = {}
    for r in totals:
        for s in json.loads(r["pattern"]):
            sizes[s] = sizes.get(s, 0) + r["size"]
    sizes = {s: sizes[s] for s in source_order(sizes)}
    shares = weights if isinstance(weights, dict) else {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    whole = sum(r["size"] for r in totals if r["pattern"] != "[]")
    wanted = targets(sizes, {s: shares.get(s, 0) for s in sizes}, int(whole * Fraction(total_share)), repeats)
    flows = route({r["pattern"]: r["size"] for r in sorted(totals, key=lambda r: r["pattern"])}, wanted, repeats)

    rows = []
    for r in totals:
        given = sum(flows[r["pattern"]].values())
        rounds, part = divmod(given, r["size"]) if r["size"] else (0, 0)
        rows.append((r["pattern"], rounds, part, max(1, -(-r["n"] // bucket_rows))))
    plan = spark.createDataFrame(rows, "pattern string, rounds int, part bigint, buckets bigint")  # at most MAX_PATTERNS rows
    bucket = lambda key: F.least(F.floor(F.shiftrightunsigned(key, 11).cast("double") / F.lit(float(2**53)) * F.col("buckets")), F.col("buckets") - 1)
    placed = slim.join(F.broadcast(plan.select("pattern", "buckets")), "pattern").withColumn("bucket", bucket(F.col("key"))).drop("buckets")
    cuts = settled(_cuts(placed, plan), "cuts")  # a row for each pattern
    at_cut = placed.join(F.broadcast(cuts), "pattern").where(F.col("bucket") == F.col("cut")).groupBy("pattern", "key", "size", "left").agg(F.count("*").alias("count"))
    chosen = settled(at_cut.groupBy("pattern").applyInPandas(_choose, "pattern string, key bigint, count bigint, more bigint"), "chosen")

    rules = plan.join(F.broadcast(cuts), "pattern", "left").select(F.col("pattern").alias(pattern_), F.col("rounds").alias(rounds_), "buckets", F.coalesce("cut", F.lit(-1)).alias(cut_))
    marked = docs.select("*", pattern.alias(pattern_), key.alias(key_)).join(F.broadcast(rules.withColumnRenamed("buckets", part_)), pattern_)
    marked = marked.withColumn(bucket_, F.least(F.floor(F.shiftrightunsigned(key_, 11).cast("double") / F.lit(float(2**53)) * F.col(part_)), F.col(part_) - 1))
    taken = lambda more: (F.col(rounds_) + more).cast("int").alias(copies)
    kept = [F.col(f"`{c}`") for c in names]
    outer = marked.where(F.col(bucket_) != F.col(cut_)).select(*kept, taken(F.when(F.col(bucket_) < F.col(cut_), 1).otherwise(0)))
    named = chosen.select(F.col("pattern").alias(pattern_), F.col("key").alias(key_), F.col("count").alias(count_), F.col("more").alias(more_))
    inner = marked.where(F.col(bucket_) == F.col(cut_)).join(named, [pattern_, key_])
    whole_units = inner.where((F.col(more_) == 0) | (F.col(more_) == F.col(count_))).select(*kept, taken((F.col(more_) > 0).cast("int")))
    parts = outer.unionByName(whole_units)
    if chosen.where("more > 0 AND more < count").isEmpty():
        return Mix(parts, copies, sizes, wanted, flows)
    # of rows that are equal in all columns some are taken once more: they are counted off within partitions, each from where those before it end
    split = settled(inner.where((F.col(more_) > 0) & (F.col(more_) < F.col(count_))).withColumn(part_, F.spark_partition_id()), "equal")
    counts = split.groupBy(key_, part_).agg(F.count("*").alias(ahead_))
    counts = counts.withColumn(ahead_, F.sum(ahead_).over(Window.partitionBy(key_).orderBy(part_)) - F.col(ahead_))
    turns = split.withColumn(turn_, F.row_number().over(Window.partitionBy(key_, part_).orderBy(F.lit(1)))).join(counts, [key_, part_])
    some = turns.select(*kept, taken((F.col(turn_) + F.col(ahead_) <= F.col(more_)).cast("int")))
    return Mix(parts.unionByName(some), copies, sizes, wanted, flows)


def mix_documents(docs: DataFrame, *, source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, all columns kept.  Every document belongs to the one source in source_col
    (null: a source of its own); see mix_sources."""
    mix = mix_sources(docs, F.array(F.col(source_col).cast("string")), word_count(F.col(text_col).cast("string")), **options)
    taken = mix.documents.where(F.col(mix.copies_col) > 0)
    return taken.withColumn(mix.copies_col, F.explode(F.sequence(F.lit(1), F.col(mix.copies_col)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_report(docs: DataFrame, *, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", seed: int = 7, **options) -> DataFrame:
    """One row per document: id, source, size, source_size, target (its source's), copies and taken = copies * size.  Null text has the size 0;
    repeated rows are documents of their own; an empty table gives an empty result."""
    spark = docs.sparkSession
    slim = settled(docs.select(F.col(id_col), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), row_key(docs, seed).alias("key")), "words")
    mix = mix_sources(slim, F.array("source"), F.col("size"), seed=seed, key=F.col("key"), **options)
    goals = spark.createDataFrame([(s, int(mix.sizes[s]), float(mix.targets[s])) for s in mix.sizes], "s string, source_size bigint, target double")
    joined = mix.documents.join(F.broadcast(goals), F.col("source").eqNullSafe(F.col("s")))  # a row per source, at most MAX_PATTERNS
    return joined.select(id_col, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))

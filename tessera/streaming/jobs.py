"""Structured Streaming forms of the queue and state operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.session import shared_path


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table, a file or a folder, as a stream; files_per_trigger caps the rate."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # streams take folders and patterns; this pattern fits the path alone


def run_available(df: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs a stream over what there is and returns the table it wrote.

    With the same `folder`, which holds the table and the checkpoint, a later run goes on where the last one ended and adds to its table; without one
    every run begins anew."""
    spark = df.sparkSession
    home = folder.rstrip("/") if folder else shared_path(spark, name)
    out, state = f"{home}/rows", f"{home}/state"
    query = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def deduplicated(events: DataFrame, keys: list[str], at: str, within: str) -> DataFrame:
    """One event a key while an equal one is at most `within` older."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, by: list[str], at: str, width: str, late: str) -> DataFrame:
    """Counts by tumbling window with `late` allowed delay."""
    counted = events.withWatermark(at, late).groupBy(*by, F.window(at, width).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(*by, F.col("w.start").alias("start"), "n")


def coalesced(events: DataFrame, key: str, handle: Callable[[DataFrame, int], None], every: str = "5 seconds"):
    """Starts a stream that hands each micro-batch's distinct keys to `handle` once."""
    state = shared_path(events.sparkSession, "coalesced-state")
    return events.writeStream.foreachBatch(lambda batch, n: handle(batch.select(key).dropDuplicates([key]), n)).option("checkpointLocation", state).trigger(processingTime=every).start()


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def streak_stream(events: DataFrame, by: str, event_id: str, at: str, kind: str, bad: str) -> DataFrame:
    """(by, event_id, streak): bad events in a row up to each event, kept in state from batch to batch; keys and ids of any type."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values([at, event_id])
        failed = (rows[kind] == bad).to_numpy()
        total = failed.cumsum()
        counts = total - pd.Series(total).where(~failed, None).ffill().fillna(-streak).to_numpy()
        state.update((int(counts[-1]),))
        yield pd.DataFrame({by: [key[0]] * len(rows), event_id: rows[event_id].to_numpy(), "streak": counts.astype("int32")})

    slim = events.select(by, event_id, F.col(at).cast("timestamp").alias(at), kind)
    return slim.groupBy(by).applyInPandasWithState(step, f"`{by}` {_kind(slim, by)}, `{event_id}` {_kind(slim, event_id)}, streak int", "streak int", "append", GroupStateTimeout.NoTimeout)


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_timers(events: DataFrame, by: str, at: str, late: str, processor: StatefulProcessor, output: str) -> DataFrame:
    """Event-time timers need the RocksDB state store; the session's setting is changed to it."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return events.withWatermark(at, late).groupBy(by).transformWithStateInPandas(processor, output, "Append", "EventTime")


class _Debouncer(StatefulProcessor):
    """Holds a key's first event until its delay is over, then gives (key, first_at, due_at, n)."""

    def __init__(self, by: str, at: str, delay_ms: int):
        self.by, self.at, self.delay = by, at, delay_ms * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "first bigint, n bigint")  # nanoseconds

    def _given(self, key, first: int, n: int) -> dict:
        return {self.by: key[0], "first_at": pd.Timestamp(first), "due_at": pd.Timestamp(first + self.delay), "n": n}

    def _frame(self, rows: list[dict]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.pending.get() if self.pending.exists() else None
        first, n = held if held else (None, 0)
        before, out = first, []
        for value in sorted(t.value for frame in rows for t in frame[self.at]):
            if first is not None and value >= first + self.delay:
                out.append(self._given(key, first, n))
                first, n = None, 0
            first, n = (value, 1) if first is None else (first, n + 1)
        if before is not None and before != first:
            self.handle.deleteTimer(-(-(before + self.delay) // 1_000_000))
        if first is not None:
            self.pending.update((first, n))
            if before != first:
                self.handle.registerTimer(-(-(first + self.delay) // 1_000_000))
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pending.exists():
            first, n = self.pending.get()
            if -(-(first + self.delay) // 1_000_000) <= expiredTimerInfo.getExpiryTimeInMs():
                self.pending.clear()
                yield from self._frame([self._given(key, first, n)])

    def close(self) -> None:
        pass


def debounced(events: DataFrame, by: str, at: str, delay_ms: int, late: str = "0 seconds") -> DataFrame:
    """(by, first_at, due_at, n): events of a key within the delay of its first one as one output, across batches, when the watermark has passed the end of
    the delay.  An event at or after that end begins anew.  n counts the events that became one."""
    slim = events.select(by, F.col(at).cast("timestamp").alias(at))
    return _with_timers(slim, by, at, late, _Debouncer(by, at, delay_ms), f"`{by}` {_kind(slim, by)}, first_at timestamp, due_at timestamp, n bigint")


class _Pauser(StatefulProcessor):
    """A source's pause as state: blocks set it and its timer, the timer's end clears it."""

    def __init__(self, by: str, at: str, event_id: str, block: str, pause_ms: int):
        self.by, self.at, self.event_id, self.block, self.pause = by, at, event_id, block, pause_ms * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until bigint")  # nanoseconds

    def _end(self, until: int) -> int:
        return -(-until // 1_000_000)

    def _rows(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            ids, times, kinds, paused = zip(*rows)
            yield pd.DataFrame({self.by: [key[0]] * len(rows), self.event_id: list(ids), self.at: [pd.Timestamp(t) for t in times], "kind": list(kinds), "paused": list(paused)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.until.get()[0] if self.until.exists() else None
        before, out = held, []
        events = pd.concat(list(rows)).sort_values([self.at, self.event_id])
        for moment, group in events.groupby(self.at, sort=True):
            now = moment.value
            if held is not None and now >= held:
                out.append((None, held, "resume", False))
                held = None
            out += [(i, now, "event", held is not None) for i in group[self.event_id].tolist()]
            if group[self.block].any():
                out.append((None, now, "pause", True))
                held = now + self.pause
        if before is not None and before != held:
            self.handle.deleteTimer(self._end(before))
        if held is None:
            self.until.clear()
        elif before != held:
            self.until.update((held,))
            self.handle.registerTimer(self._end(held))
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.until.exists():
            until = self.until.get()[0]
            if self._end(until) <= expiredTimerInfo.getExpiryTimeInMs():
                self.until.clear()
                yield from self._rows(key, [(None, until, "resume", False)])

    def close(self) -> None:
        pass


def pause_stream(events: DataFrame, by: str, event_id: str, at: str, block: str, pause_ms: int, late: str = "0 seconds") -> DataFrame:
    """(by, event_id, at, kind, paused): each event (kind event) with whether its source was held up, as sequences.with_pause has it, and a row for each pause
    that begins or is prolonged (pause) and each that ends (resume; without event_id).

    block: a boolean column.  A pause is state with a timer, so it outlasts batches and restarts and ends without an event.  Events must come in the order of
    time but for those of one batch; what is later than `late` is dropped."""
    slim = events.select(by, event_id, F.col(at).cast("timestamp").alias(at), F.coalesce(block, F.lit(False)).alias(block))
    return _with_timers(slim, by, at, late, _Pauser(by, at, event_id, block, pause_ms), f"`{by}` {_kind(slim, by)}, `{event_id}` {_kind(slim, event_id)}, `{at}` timestamp, kind string, paused boolean")

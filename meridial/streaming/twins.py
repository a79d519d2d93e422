"""Structured Streaming twins of batch operators, over a stream of events.

Streams are given with a ``timestamp`` event time: Spark accepts no watermark on
``timestamp_ntz``, so ``event_time`` casts (session time zone UTC).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from meridial.sources.tables import upserted


def event_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the Parquet file or files of ``path``, with their schema."""
    schema = spark.read.parquet(path).schema
    # as a pattern, the path may also be a single file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    return events.withColumn(column, F.col(column).cast("timestamp"))


def rolling_spend(events: DataFrame, key: str, amount: str, *, ts: str = "ts", length: str = "24 hours", slide: str = "1 hour", late: str = "2 hours", cap: float | None = None) -> DataFrame:
    """Sums in sliding windows per key; with a cap, whether it is reached. Works on streams and tables alike."""
    out = event_time(events, ts).withWatermark(ts, late).groupBy(F.window(ts, length, slide).alias("w"), key).agg(F.sum(amount).alias("spent"), F.count("*").alias("n_calls"))
    out = out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "spent", "n_calls")
    return out if cap is None else out.withColumn("capped", F.col("spent") >= cap)


def daily_means(events: DataFrame, keys: Sequence[str], value: str, *, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Tumbling day means."""
    out = event_time(events, ts).withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), *keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return out.select(F.to_date(F.col("w.start")).alias("day"), *keys, "mean", "n")


def visits(events: DataFrame, key: str, value: str, *, ts: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Session windows: a visit ends after a gap."""
    out = event_time(events, ts).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("visit_start"), F.col("w.end").alias("visit_end"), key, "mean", "n")


def deduplicated(events: DataFrame, keys: Sequence[str], *, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Each key once, even if it is delivered again within the watermark."""
    return event_time(events, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


class _Latest(StatefulProcessor):
    """The latest row of each key as a state of one value; a row that changes it is handed on.

    With ``idle``, a timer forgets a key that no event names for so many milliseconds of event time.
    """

    def __init__(self, columns: list[str], order: list[str], schema: StructType, ts: str, idle: int | None):
        self.columns, self.order, self.schema, self.ts, self.idle = columns, order, schema, ts, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", self.schema)
        self.timer = handle.getValueState("timer", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = [self.columns.index(c) for c in self.order]
        old = self.row.get()
        best = None if old is None else tuple(old)
        for batch in rows:
            for r in batch[self.columns].itertuples(index=False, name=None):
                if best is None or tuple(r[i] for i in at) > tuple(best[i] for i in at):
                    best = r
        if best is None or (old is not None and tuple(old) == best):
            return
        # the state takes Python's own values
        best = tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v for v in best)
        self.row.update(best)
        if self.idle is not None:
            due = int(pd.Timestamp(best[self.columns.index(self.ts)]).timestamp() * 1000) + self.idle
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            self.handle.registerTimer(due)
            self.timer.update((due,))
        yield pd.DataFrame([best], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.row.clear()
        self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_changes(events: DataFrame, keys: Sequence[str], order: Sequence[str], *, ts: str = "ts", late: str = "2 hours", idle: int | None = None) -> DataFrame:
    """A stream of the rows that become the latest of their key, by a state of one row a key.

    A batch reads and writes the states of the keys that it names and no others.
    Needs the RocksDB state store (``stateful``). ``idle`` (milliseconds) bounds
    the states; without it every key is kept. A row without a place in the order
    is never the latest.
    """
    rows = event_time(events, ts).withWatermark(ts, late).dropna(subset=list(order))
    mode = "None" if idle is None else "EventTime"
    own = _Latest(rows.columns, list(order), rows.schema, ts, idle)
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=own, outputStructType=rows.schema, outputMode="Update", timeMode=mode)


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """The session with the state store that ``latest_changes`` needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def append_changes(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes a batch's changes to ``<path>/batch=<n>``; run again, it writes the same."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def latest_of_changes(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The latest rows: of each key the change of the last batch."""
    columns = [c for c in changes.columns if c != "batch"]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("r.*")


def latest_upserts(keys: Sequence[str], order: Sequence[str], state: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the latest row of each key as a table.

    The batch is reduced first; then old and new rows meet, and the new version
    is written beside the old one (``<state>/v<batch>``), so a batch that is run
    again gives the same.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("r")).select("r.*")
        if number:
            old = spark.read.parquet(f"{state}/v{number - 1}")
            both = old.unionByName(newest).groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("r")).select("r.*")
            newest = upserted(old, both, keys)
        newest.write.mode("overwrite").parquet(f"{state}/v{number}")

    return upsert


def run_once(stream: DataFrame, checkpoint: str, *, name: str | None = None, path: str | None = None, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> int:
    """Run a stream over what is there now, to a folder, an in-memory table or a function; returns the batches."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode(mode)
    if each:
        writer = writer.foreachBatch(each)
    elif path:
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.format("memory").queryName(name)
    running = writer.start()
    running.awaitTermination()
    done = running.lastProgress
    return 0 if done is None else done["batchId"] + 1

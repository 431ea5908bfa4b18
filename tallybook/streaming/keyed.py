"""State kept by key across micro-batches, in the RocksDB store of the stream.

A batch touches the keys that it brings and no others: what is written follows the size
of the batch, not that of the state. Changes go to an append-only log of parquet files
that takes each batch once; a reader adds them up.
"""

from __future__ import annotations

import datetime as dt
import io
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ["open_id", "match_id"]
#: Slots of time to a window of fresh rows, and keys to a slot.
SLOTS, SHARES = 16, 16
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession):
    """The session's state store is RocksDB for the streams started within."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _clocked(matches: DataFrame) -> DataFrame:
    """``captured_at`` as an instant, and its microseconds ``clock_us``, which do not depend on a time zone in Python."""
    return matches.withColumn("captured_at", F.col("captured_at").cast("timestamp")).withColumn("clock_us", F.unix_micros("captured_at"))


def _span_ms(spark: SparkSession, interval: str) -> int:
    """Milliseconds of an interval such as ``12 minutes``."""
    return int(spark.range(1).select(F.expr(f"cast(unix_millis(timestamp'1970-01-01' + interval {interval}) - unix_millis(timestamp'1970-01-01') as long)")).first()[0])


def _millis(us: int) -> int:
    """The first millisecond of the event clock that is not before."""
    return -(-us // 1000)


def _plain(row) -> tuple:
    return tuple(None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v for v in row)


class Newest(StatefulProcessor):
    """The newest row of each key by ``captured_at``, then by the row itself; finished ones go when no later row can be accepted."""

    def __init__(self, schema: T.StructType, finished: str, late_ms: int):
        self.schema, self.done, self.late_ms = schema, schema.names.index(finished), late_ms
        self.at = schema.names.index("clock_us")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("newest", self.schema)

    def _order(self, row: tuple) -> tuple:
        return (row[self.at], *((v is not None, v) for v in row if not isinstance(v, dt.datetime)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else None
        best = None if old is None else tuple(old)
        for pdf in rows:
            # only the newest of a batch can be best, so the others are not made plain
            at = pdf["clock_us"].to_numpy()
            last = (at == at.max()).nonzero()[0] if at.dtype.kind == "i" else range(len(at))
            cols = [pdf[c] for c in self.schema.names]
            for row in (_plain(c.iat[i] for c in cols) for i in last):
                if best is None or self._order(row) > self._order(best):
                    best = row
        if best is not None and (old is None or best != tuple(old)):
            self.state.update(best)
            if best[self.done]:
                self.handle.registerTimer(_millis(best[self.at]) + self.late_ms)
            yield pd.DataFrame([best], columns=self.schema.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and tuple(self.state.get())[self.done]:
            self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


class Fresh(StatefulProcessor):
    """The rows of each key within the watermark: change 1 when one comes, -1 when the watermark passes it.

    Which match a row is of has no part in this, so a key is a slot of time, and holds what a batch brings as one
    piece. A key has a timer at its oldest row only, and when that fires all rows that the watermark has passed go
    at once; of the pieces only those in which the watermark stands are parted.
    """

    STATE = "oldest long, newest long, rows binary"

    def __init__(self, schema: T.StructType):
        self.names = schema.names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.STATE)
        self.due = handle.getValueState("due", "at long")

    def _piece(self, pdf: pd.DataFrame) -> tuple[int, int, bytes]:
        out = io.BytesIO()
        pdf.reset_index(drop=True).to_feather(out)
        return int(pdf["clock_us"].min()), int(pdf["clock_us"].max()), out.getvalue()

    def _wake(self, pieces: list[tuple], due: int | None) -> None:
        """A timer at the oldest of ``pieces`` where that is before ``due``."""
        at = min(_millis(p[0]) for p in pieces)
        if due is None or at < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            if len(pdf):
                new.append(self._piece(pdf[self.names]))
                yield pdf[self.names].assign(change=1)
        if new:
            self.rows.appendList(new)
            self._wake(new, self.due.get()[0] if self.due.exists() else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        left = []
        for piece in [tuple(p) for p in self.rows.get()] if self.rows.exists() else []:
            if _millis(piece[0]) > now:
                left.append(piece)
                continue
            pdf = pd.read_feather(io.BytesIO(piece[2]))
            old = -(-pdf["clock_us"] // 1000) <= now
            if not old.all():
                left.append(self._piece(pdf[~old]))
            yield pdf[old].assign(change=-1)
        self.due.clear()
        if left:
            self.rows.put(left)
            self._wake(left, None)
        else:
            self.rows.clear()

    def close(self) -> None:
        pass


def _to_log(changes: DataFrame, path: str, checkpoint: str):
    return changes.drop("clock_us").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def keep_latest(matches: DataFrame, path: str, checkpoint: str, late: str = "3650 days", finished: str = "is_played"):
    """Keep the newest row of each match; ``path`` gets a row for every match that a batch changes.

    A row that is older than its match's state changes nothing. A row more than ``late``
    behind the newest of all is dropped, and a finished match leaves the state as soon as
    every row that could still change it would be.
    """
    spark = matches.sparkSession
    ms = _span_ms(spark, late)
    x = _clocked(matches)
    with rocks(spark):
        state = x.withWatermark("captured_at", late).groupBy(*KEY).transformWithStateInPandas(Newest(x.schema, finished, ms), outputStructType=x.schema, outputMode="Append", timeMode="EventTime")
        return _to_log(state, path, checkpoint)


def latest_of(changes: DataFrame) -> DataFrame:
    """The state that a log of changes comes to: the last change of each match."""
    rest = [c for c in changes.columns if c not in (*KEY, "captured_at")]
    return changes.groupBy(*KEY).agg(F.max(F.struct("captured_at", *rest)).alias("m")).select(*KEY, "m.*").select(*changes.columns)


def keep_fresh(matches: DataFrame, path: str, checkpoint: str, window: str = "12 minutes"):
    """Keep the rows of the last ``window`` before the newest row of all; ``path`` gets every row once as it comes and once as it expires.

    Rows lie by time, ``SLOTS`` slots to the window, and in each dealt over ``SHARES`` keys: what the stream does by
    key follows the time it spans, not the number of matches. A row without a time is never fresh.
    """
    spark = matches.sparkSession
    x = _clocked(matches.where("captured_at is not null"))
    out = T.StructType([*x.schema.fields, T.StructField("change", T.IntegerType())])
    width = max(1, 1000 * _span_ms(spark, window) // SLOTS)
    lie = {"_slot": F.floor(F.col("clock_us") / width), "_share": F.pmod(F.hash(*KEY, "clock_us"), F.lit(SHARES))}
    with rocks(spark):
        state = x.withColumns(lie).withWatermark("captured_at", window).groupBy(*lie).transformWithStateInPandas(Fresh(x.schema), outputStructType=out, outputMode="Append", timeMode="EventTime")
        return _to_log(state, path, checkpoint)


def fresh_now(changes: DataFrame) -> DataFrame:
    """The rows of a log of :func:`keep_fresh` that have come and not expired; a row that came twice is there twice."""
    rest = [c for c in changes.columns if c != "change"]
    x = changes.groupBy(*rest).agg(F.sum("change").cast("int").alias("n")).where("n > 0")
    return x.select(*rest, F.explode(F.sequence(F.lit(1), "n")).alias("_i")).drop("_i")

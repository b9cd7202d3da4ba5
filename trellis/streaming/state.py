"""Keyed state over a stream of triples: revision numbers and first-wins deduplication, in the order of event time.

A batch query orders a key's rows before it numbers them or takes the first. A stream cannot see later rows, but its watermark says when no
earlier ones can come: a key's rows wait in its state until the watermark has passed them, then leave in order. So a stream gives what the
batch query gives, whatever files, restarts and micro-batches its rows come in; rows older than the watermark are late, and Spark drops them
(and counts them, `numRowsDroppedByWatermark`). A key that has been quiet for `forget` of event time leaves the state.

State lies in the checkpoint, so a query that is started again goes on with it. It needs the RocksDB state store:
spark.sql.streaming.stateStore.providerClass = org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
A key's waiting rows are those of one watermark delay; they are read and written together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Rows in state are JSON, to the microsecond.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_HELD = "at long, rank string, row string"


class InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then hands them on in order with their numbers; with `first_only` just number 1."""

    def __init__(self, keys: list[str], first_only: bool, forget_ms: int | None):
        self.keys, self.first_only, self.forget_ms = keys, first_only, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _HELD)
        self.seen = handle.getValueState("seen", "number int, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [r for part in rows for r in part[["at_", "rank_", "row_"]].itertuples(index=False, name=None)]
        yield self._out(key, [tuple(r) for r in self.held.get()] + [(int(a), b, c) for a, b, c in new], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.held.get()]
        seen = self.seen.get()
        if not held and self.forget_ms is not None and seen is not None and seen[1] // 1000 + self.forget_ms < now:
            self.seen.clear()
            self.held.clear()
            return
        yield self._out(key, held, now)

    def _out(self, key, held: list[tuple], watermark_ms: int) -> pd.DataFrame:
        number, last = self.seen.get() or (0, 0)
        # a watermark in milliseconds is passed by all that lies before its end
        ready = sorted(r for r in held if r[0] // 1000 < watermark_ms)
        waiting = [r for r in held if r[0] // 1000 >= watermark_ms]
        out = []
        for at, _, row in ready:
            # whoever was forgotten starts anew
            if self.forget_ms is not None and number and at - last > self.forget_ms * 1000:
                number = 0
            number, last = number + 1, at
            if number == 1 or not self.first_only:
                out.append((row, number))
        if waiting:
            self.held.put(waiting)
        else:
            self.held.clear()
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if waiting:
            self.handle.registerTimer(min(r[0] for r in waiting) // 1000 + 1)
        elif self.forget_ms is not None:
            self.handle.registerTimer(last // 1000 + self.forget_ms + 1)
        if ready:
            self.seen.update((number, last))
        return pd.DataFrame({"row_": pd.Series([r for r, _ in out], dtype=object), "number_": pd.Series([n for _, n in out], dtype="int32")})

    def close(self) -> None:
        pass


def _ordered(stream: DataFrame, keys: list[str], time: str, ties: list[str], late: str, forget: str | None, first_only: bool) -> DataFrame:
    schema = stream.schema
    if schema[time].dataType != T.TimestampType():
        raise ValueError(f"{time} must be a timestamp with a time zone: watermarks need one")
    rank = F.array_join(F.array(*(F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("")), 32, " ") for c in ties)), "\u0000")
    rows = stream.filter(F.col(time).isNotNull())
    shaped = rows.select(*(F.to_json(F.struct(k)).alias(f"key{i}_") for i, k in enumerate(keys)), F.col(time).alias("time_"), F.unix_micros(F.col(time)).alias("at_"), rank.alias("rank_"), F.to_json(F.struct(*schema.names), _JSON).alias("row_"))
    own = [f"key{i}_" for i in range(len(keys))]
    forget_ms = None if forget is None else int(pd.Timedelta(forget).total_seconds() * 1000)
    grouped = shaped.withWatermark("time_", late).groupBy(*own)
    out = grouped.transformWithStateInPandas(InOrder(own, first_only, forget_ms), "row_ string, number_ int", "Append", "EventTime")
    return out.select(F.from_json("row_", schema, _JSON).alias("r"), "number_").select("r.*", F.col("number_").alias("revision"))


def revisions(stream: DataFrame, time: str, ties: list[str], late: str = "10 minutes", forget: str | None = None) -> DataFrame:
    """A stream of (head, relation, tail, ...) with `revision`: 1, 2, ... for each edge by time, then by the columns `ties`.

    Equal to `versioning.next_revisions` of all rows in time, without `forget`; with it, an edge without rows for that long starts at 1 again."""
    return _ordered(stream, ["head", "relation", "tail"], time, ties, late, forget, False)


def first_of_each(stream: DataFrame, keys: list[str], time: str, ties: list[str], late: str = "10 minutes", forget: str | None = None) -> DataFrame:
    """The first row of each key by time, then by `ties`; with `forget`, the first after each quiet time of that length."""
    return _ordered(stream, keys, time, ties, late, forget, True).drop("revision")

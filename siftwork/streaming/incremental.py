"""The same decisions over records that keep arriving.

These go beyond a batch build: duplicates within a time bound, protection by a fixed table, and
class counts by window. State is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType, IntegralType, StringType, StructField, StructType

from ..operators.match import PERCEPTUAL


def protected_stream(records: DataFrame, protected: DataFrame) -> DataFrame:
    """Records whose content isn't protected: a stream joined with a static table."""
    return records.join(protected.select("sha256").distinct(), "sha256", "left_anti").select(*records.columns)


def first_seen(records: DataFrame, event_time: str, bound: str, key: list[str] = PERCEPTUAL) -> DataFrame:
    """The first record of each key; copies more than ``bound`` apart both pass."""
    return records.withWatermark(event_time, bound).dropDuplicatesWithinWatermark(key)


def windowed_counts(records: DataFrame, event_time: str, by: list[str], width: str, late: str) -> DataFrame:
    """Records by time window and ``by``, final once the watermark has passed the window."""
    window = F.window(event_time, width)
    return (
        records.withWatermark(event_time, late).groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), *by, "n")
    )


class _Best(StatefulProcessor):
    """Keeps the first row of a key by an order; rows of a key that come together are held against it at once."""

    def __init__(self, schema: StructType, order: list[str], event_time: str, bound_ms: int):
        self.schema, self.order, self.event_time, self.bound_ms = schema, order, event_time, bound_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.schema)
        self.timer = handle.getValueState("timer", "at long")

    def _rank(self, row: tuple) -> tuple:
        at = {f.name: k for k, f in enumerate(self.schema)}
        return tuple((row[at[o]] is not None, row[at[o]]) for o in self.order)

    @staticmethod
    def _plain(value, kind: DataType):
        """A value as the state takes it: pandas has whole numbers as doubles where some are null."""
        if value is None or value is pd.NaT:
            return None
        if isinstance(kind, IntegralType):
            return int(value)
        return value.to_pydatetime() if isinstance(value, pd.Timestamp) else value.item() if hasattr(value, "item") else value

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = self.schema.names
        before = tuple(self.kept.get()) if self.kept.exists() else None
        best, latest = before, None
        for pdf in rows:
            times = pdf[self.event_time]
            latest = times.max() if latest is None else max(latest, times.max())
            plain = pdf[names].astype(object).where(pdf[names].notna(), None)
            for row in plain.itertuples(index=False, name=None):
                row = tuple(self._plain(v, f.dataType) for v, f in zip(row, self.schema))
                if best is None or self._rank(row) < self._rank(best):
                    best = row
        out = []
        if best is not before:
            self.kept.update(best)
            out = ([("retract", *before)] if before is not None else []) + [("keep", *best)]
        # the key is forgotten when the watermark passes its last row by the bound
        end = int(latest.timestamp() * 1000) + self.bound_ms
        held = self.timer.get()[0] if self.timer.exists() else None
        if held is None or end > held:
            if held is not None:
                self.handle.deleteTimer(held)
            self.handle.registerTimer(end)
            self.timer.update((end,))
        yield pd.DataFrame(out, columns=["change", *names])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        self.timer.clear()
        yield pd.DataFrame([], columns=["change", *self.schema.names])

    def close(self) -> None:
        pass


def best_seen(records: DataFrame, event_time: str, late: str, bound_seconds: int, order: list[str], key: list[str] = PERCEPTUAL) -> DataFrame:
    """``change`` and the columns of ``records``: the first row of each key by ``order`` among those seen so far.

    ``keep`` adds a row; a better one that comes later first takes the kept one back with ``retract``.
    What is kept and not retracted at the end is what a batch deduplication keeps, whatever the order
    of arrival. State is a row for each key, until the watermark is ``bound_seconds`` past the key's
    last row. Columns of ``order`` must be comparable and tell rows apart; nulls come first.
    Needs the RocksDB state store.
    """
    # state of timestamps is in the session's time zone; they pass through as they are
    schema = records.schema
    out = StructType([StructField("change", StringType()), *schema.fields])
    held = _Best(schema, order, event_time, 1000 * bound_seconds)
    return records.withWatermark(event_time, late).groupBy(*key).transformWithStateInPandas(held, out, "Append", "EventTime")

"""Keyed state for streams: stateful processors on the RocksDB state store.

State is read and written by key, and within a map by its entries; nothing is rewritten that
a batch does not touch. Where time matters the processing clock is used, so that no row of a
slow device is ever late. Rows of one key come in the order of the column that is named."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def names(ddl: str) -> list[str]:
    return [c.strip().split()[0] for c in ddl.split(", ")]


def frame(rows: list[tuple], ddl: str) -> pd.DataFrame:
    """Rows for the columns of a schema; whole numbers may be null."""
    whole = {c.split()[0]: "Int64" for c in ddl.split(", ") if c.split()[1] in ("long", "int")}
    return pd.DataFrame(rows, columns=names(ddl)).astype(whole)


def plain(rows: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """All rows of a key as tuples of plain values, null as None. No column here is a
    fraction: pandas turns whole numbers into floats where one of them is null."""
    out = []
    for part in rows:
        part = part[columns].astype(object)
        out += ([int(v) if isinstance(v, float) else v for v in row] for row in part.where(part.notna(), None).itertuples(index=False, name=None))
    return [tuple(row) for row in out]


class Fold(StatefulProcessor):
    """One value per key. ``fold(value or None, key, rows)`` gives the new value and rows to
    put out; a value of None clears the state."""

    def __init__(self, fold: Callable, columns: list[str], state: str, out: str):
        self.fold, self.columns, self.state, self.out = fold, columns, state, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, out = self.fold(tuple(self.value.get()) if self.value.exists() else None, tuple(key), plain(rows, self.columns))
        if now is not None:
            self.value.update(now)
        elif self.value.exists():
            self.value.clear()
        if out:
            yield frame(out, self.out)

    def close(self) -> None:
        pass


def with_state(df: DataFrame, keys: list[str], processor: StatefulProcessor, out: str, mode: str, clock: bool = False) -> DataFrame:
    """Runs a processor over the rows of each key. It needs the RocksDB state store, which the
    session is set to. With a ``clock`` Spark always makes another batch, so that timers fire
    without new rows; a run with the trigger AvailableNow ends only where
    spark.sql.streaming.noDataMicroBatches.enabled is off, and fires them with later rows."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df.groupBy(*keys).transformWithStateInPandas(processor, out, mode, "ProcessingTime" if clock else "None")


def fold_by_key(df: DataFrame, keys: list[str], fold: Callable, columns: list[str], state: str, out: str) -> DataFrame:
    return with_state(df, keys, Fold(fold, columns, state, out), out, "Update")

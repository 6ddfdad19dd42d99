"""Carried-state deduplication of a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import types as T


class KeepNovel(StatefulProcessor):
    """Keeps the rows of a group that differ from the latest kept one. The state is that row's value and the latest order seen; rows that come
    after later ones are dropped, as their decision has passed."""

    def __init__(self, differs: Callable[[float, float], bool], order: str, value: str, ident: str):
        self.differs, self.order, self.value, self.ident = differs, order, value, ident

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("kept", T.StructType([T.StructField("value", T.DoubleType()), T.StructField("seen", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values([self.order, self.ident], kind="stable")
        last, seen = self.state.get() if self.state.exists() else (None, -(2**63))
        kept = []
        for order, value, ident in batch[[self.order, self.value, self.ident]].itertuples(index=False):
            if order < seen:
                continue
            seen = int(order)
            if last is None or self.differs(last, value):
                last = float(value)
                kept.append((key[0], ident))
        self.state.update((last, seen))
        yield pd.DataFrame(kept, columns=["group", "ident"])

    def close(self) -> None:
        pass


def keep_novel(stream: DataFrame, group: str, order: str, value: str, ident: str, differs: Callable[[float, float], bool]) -> DataFrame:
    """(group, ident) of the rows kept. order is a whole number, value a double. Needs the RocksDB state store (rocksdb_state)."""
    return stream.groupBy(group).transformWithStateInPandas(KeepNovel(differs, order, value, ident), "group bigint, ident bigint", "Append", "None")


def rocksdb_state(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

"""Carried-state deduplication: each row is compared with the latest row that was kept."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a group that are folded into one list.
BLOCK = 512


def carried_dedup(df: DataFrame, group: str, order: list[str], value: str, differs: Callable[[Column, Column], Column], ident: str) -> DataFrame:
    """(group, ident) of the rows kept. differs(kept, now) says whether a row is new against the latest one kept; a group's first row is.

    The comparison depends on earlier decisions, so a group is folded in order: one pass over a group's (order, value, id), in SQL expressions.
    A group must fit in a task's memory with these columns alone. Null values are compared as differs() has it; null means dropped.
    """
    item = F.struct(*[F.col(c) for c in order], F.col(value).alias("__v"), F.col(ident).alias("__id"))
    rows = df.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    kind = dict(df.dtypes)
    nothing = F.array().cast(f"array<{kind[ident]}>")

    def step(state: Column, row: Column) -> Column:
        new = state["first"] | F.coalesce(differs(state["last"], row["__v"]), F.lit(False))
        return F.struct(
            F.when(new, row["__v"]).otherwise(state["last"]).alias("last"),
            F.lit(False).alias("first"),
            F.when(new, F.concat(state["kept"], F.array(row["__id"]))).otherwise(state["kept"]).alias("kept"),
        )

    def block(state: Column, part: Column) -> Column:
        """One block is folded into a list of its own, so a step copies at most a block's ids, and a block at most the list of blocks."""
        start = F.struct(state["last"].alias("last"), state["first"].alias("first"), nothing.alias("kept"))
        return F.aggregate(F.array(F.aggregate(part, start, step)), state, lambda s, end: F.struct(end["last"].alias("last"), end["first"].alias("first"), F.concat(s["kept"], F.array(end["kept"])).alias("kept")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / BLOCK).cast("int")), lambda k: F.slice("rows", k * BLOCK + 1, F.lit(BLOCK)))
    start = F.struct(F.lit(None).cast(kind[value]).alias("last"), F.lit(True).alias("first"), F.array().cast(f"array<array<{kind[ident]}>>").alias("kept"))
    return rows.select(group, F.explode(F.flatten(F.aggregate(blocks, start, block, lambda s: s["kept"]))).alias(ident))


def carried_dedup_frames(df: DataFrame, group: str, order: str, redundant: Callable[[pd.Series, pd.Series], bool], passing: str = "selected") -> DataFrame:
    """df with selected and selection_reason after comparing each passing frame with the latest kept one by redundant(kept, now), in Python.

    For image features, which SQL can't compare. Frames of one group are held in one task; groups spread over the cluster.
    """
    schema = df.schema

    def run(frames: pd.DataFrame) -> pd.DataFrame:
        frames = frames.sort_values(order, kind="stable").reset_index(drop=True)
        last = None
        for k in range(len(frames)):
            if not frames.at[k, passing]:
                continue
            if last is not None and redundant(frames.iloc[last], frames.iloc[k]):
                frames.at[k, passing] = False
                frames.at[k, "selection_reason"] = "redundant"
            else:
                last = k
        return frames

    return df.groupBy(group).applyInPandas(run, schema)

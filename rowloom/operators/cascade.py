"""A cascade of searches over rows that stay unresolved.

Every stage says which rows are open to it, scores those alone, and settles what becomes of
each. Its result is written before the next stage reads it, so what a stage scores is no more
than what the stages before have left, and the order of the stages decides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.operators.written import written

ITEM = "struct<uid:bigint,score:double,margin:double,matched:boolean,crop:int,method:string>"


@dataclass(frozen=True)
class Stage:
    """name; opens: which rows it takes, a condition on ``item`` and the row's other columns; search: from those rows, one row for each with ``found``; settle: the new item, from ``item`` and ``found`` (null where nothing was found)."""

    name: str
    opens: Column
    search: Callable[[DataFrame], DataFrame]
    settle: Column


def item(uid: Column, score: Column, margin: Column, matched: Column, crop: Column, method: Column) -> Column:
    """What is known of a row; of the type ITEM."""
    return F.struct(uid.alias("uid"), score.alias("score"), margin.alias("margin"), matched.alias("matched"), crop.alias("crop"), method.alias("method")).cast(ITEM)


def run_cascade(rows: DataFrame, stages: list[Stage], row: str = "row") -> DataFrame:
    """``rows`` with their final ``item`` and ``path``, the names of the stages that scored them, in order.

    A row that no stage takes keeps a null item. Repeated rows aren't allowed.
    """
    held = rows.withColumns({"item": F.lit(None).cast(ITEM), "path": F.array().cast("array<string>")})
    for stage in stages:
        opened = F.coalesce(stage.opens, F.lit(False))
        open_rows = held.filter(opened)
        found = stage.search(open_rows).select(F.col(row).alias("_row"), "found")
        settled = open_rows.join(found, F.col(row) == F.col("_row"), "left").withColumns({"item": stage.settle.cast(ITEM), "path": F.array_append("path", F.lit(stage.name))})
        held = written(held.filter(~opened).unionByName(settled.select(held.columns)), f"cascade-{stage.name.replace(' ', '-')}")
    return held


def stage_sizes(done: DataFrame) -> DataFrame:
    """How many rows each stage scored: stage, n."""
    return done.select(F.explode("path").alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))

"""Tables written once for later branches, and places in a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share; a temporary one for a local session where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="rowloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back, so that several branches use it and none computes it anew."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def with_place(rows: DataFrame, order: list[Column], place: str = "place", rows_a_range: int = 1_000_000) -> DataFrame:
    """``rows`` with their ``place``, from 1, in the order of all of them; ``order`` has to tell rows apart.

    Rows are range-partitioned by the order and written with their range's number; the rows of
    earlier ranges are added to the row's number inside its range, so no task sees more than a range.
    """
    ranges = max(8, -(-rows.count() // rows_a_range))
    path = work_folder(rows.sparkSession, "ranges")
    dealt = rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # one row for each range
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = dealt.withColumn("_at", inside).join(F.broadcast(starts), F.col("_range") == F.col("_of"))
    return placed.withColumn(place, F.col("_at") + F.col("_before")).drop("_range", "_of", "_at", "_before")

"""Arrivals that reset their group: new rows are kept, and only the groups that they belong to are built anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def _numbered(schema: StructType, name: str) -> StructType:
    return StructType([*schema.fields, StructField(name, LongType())])


def _or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def absorb(batch: DataFrame, number: int, path: str, identity: list[str], group: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """One micro-batch: rows of identities not seen before are kept, and their groups' results built anew from all of their rows.

    Below ``path`` lie ``rows/number=N``, ``results/version=N`` and ``current/number=N``. The
    last one, a row for each group that N has built, is written at the end, so readers see a
    group's old result or its new one, never a part. A batch that is run again writes the same
    folders anew. A batch without new identities writes no result.
    """
    spark = batch.sparkSession
    known = _or_empty(spark, f"{path}/rows", _numbered(batch.schema, "number")).filter(F.col("number") < number)
    again = F.lit(True)
    for c in identity:
        again &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    fresh = batch.dropDuplicates(identity).join(known.select(*[F.col(c).alias(f"_{c}") for c in identity]), again, "left_anti")
    fresh.write.mode("overwrite").parquet(f"{path}/rows/number={number}")
    fresh = spark.read.schema(batch.schema).parquet(f"{path}/rows/number={number}")
    if fresh.isEmpty():
        return
    touched = fresh.select(F.col(group).alias("_g")).distinct()
    whole = known.drop("number").unionByName(fresh).join(touched, F.col(group).eqNullSafe(F.col("_g")), "left_semi")
    build(whole).write.mode("overwrite").parquet(f"{path}/results/version={number}")
    touched.select(F.col("_g").alias(group)).write.mode("overwrite").parquet(f"{path}/current/number={number}")


def follow(spark: SparkSession, inbox: str, schema, path: str, identity: list[str], group: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """Absorb every file of ``inbox`` that no earlier call has read; the stream's own state tells which those are."""
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(inbox)
    run = stream.writeStream.foreachBatch(lambda batch, number: absorb(batch, number, path, identity, group, build)).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()


def results(spark: SparkSession, path: str, group: str, schema) -> DataFrame:
    """Every group's newest result with its ``version``; ``schema`` is that of build()'s rows."""
    newest = spark.read.parquet(f"{path}/current").groupBy(F.col(group).alias("_g")).agg(F.max("number").cast("long").alias("_v"))
    held = spark.read.schema(_numbered(schema, "version")).parquet(f"{path}/results")
    return held.join(newest, F.col(group).eqNullSafe(F.col("_g")) & (F.col("version") == F.col("_v"))).drop("_g", "_v")

"""Incremental ingest: files as they arrive, each identity once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowloom.operators.written import work_folder


def ingest(spark: SparkSession, path: str, files: str, identity: list[str]) -> DataFrame:
    """Every file of ``path`` that matches ``files``, or that a folder of that name holds, read as a stream until none is left; the first row of each identity.

    The state holds one entry per identity; a real feed would bound it by a watermark.
    """
    schema = spark.read.parquet(f"{path}/{files}").schema
    # a stream reads folders only: the table's own where Spark has written one, else the one that the file stands in
    plain = spark.read.format("binaryFile").option("pathGlobFilter", files).load(path).select("path").limit(1)
    source = spark.readStream.schema(schema)
    stream = source.parquet(f"{path}/{files}") if plain.isEmpty() else source.option("pathGlobFilter", files).parquet(path)
    stream = stream.select(*identity).dropDuplicates(identity)
    folder = work_folder(spark, "stream")
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")

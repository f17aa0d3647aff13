"""Helpers that several operators share: the shared folder, staged tables, words and regex spans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words in the contracts: space and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, one is made for a local session, and a cluster gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="rowloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_scratch: ContextVar[str] = ContextVar("scratch", default="")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system holds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged inside goes at the end; results have to be written before."""
    name = f"scratch-{uuid.uuid4().hex}"
    token = _scratch.set(f"{name}/")
    try:
        yield
    finally:
        _scratch.reset(token)
        delete(spark, f"{shared_dir(spark)}/{name}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later branches reuse it, and lost executors cost no recomputation.

    The table stays for as long as its folder does; inside ``scratch`` it goes with that.
    """
    path = f"{shared_dir(df.sparkSession)}/{_scratch.get()}{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(*frames: DataFrame) -> None:
    """Delete the files of staged tables that nothing will read any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, folder)


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], count: str, by: Column, heavy: int = 100_000) -> DataFrame:
    """``big`` joined with ``small`` on ``keys``, where ``small`` has one row for each key and ``count``, how many rows of ``big`` hold it.

    A key of more than ``heavy`` rows is dealt to several tasks, by the hash of ``by``. What is
    broadcast for that is one row for each such key, so at most one for ``heavy`` rows of ``big``.
    """
    parts = F.ceil(F.col(count) / heavy).cast("int")
    hot = small.filter(F.col(count) > heavy).select(*[F.col(k).alias(f"_rl_{k}") for k in keys], parts.alias("_rl_parts"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k) == F.col(f"_rl_{k}")
    dealt = big.join(F.broadcast(hot), same, "left").withColumn("_rl_part", F.pmod(F.xxhash64(by), F.coalesce("_rl_parts", F.lit(1))).cast("int"))
    dealt = dealt.drop("_rl_parts", *[f"_rl_{k}" for k in keys])
    copies = small.withColumn("_rl_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(copies, [*keys, "_rl_part"]).drop("_rl_part")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def found_spans(text: Column, pattern: str, block: int = 500) -> Column:
    """Every leftmost non-overlapping match as ``array<struct<start, end, value>>``; offsets in code points, end exclusive.

    The pieces between matches come from ``split`` and the matches from
    ``regexp_extract_all``; both walk the text alike, so running lengths give the offsets.
    They are summed in blocks of ``block`` matches, so that a text of very many matches
    costs no copying of all its spans for each of them.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda piece: F.length(piece))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["gap"]
        end = start + F.length(pair["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def shifted(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value")))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
    firsts = F.sequence(F.lit(1), F.size(hits), F.lit(block))
    blocks = F.transform(firsts, lambda first: F.aggregate(F.slice(pairs, first, F.lit(block)), zero, step))
    joined = F.aggregate(blocks, zero, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], shifted(b["out"], acc["at"])).alias("out")), lambda acc: acc["out"])
    return F.when(F.size(hits) > 0, joined).otherwise(none)


def overlapped(strong: Column, row: str = "row") -> Column:
    """Whether a span (columns ``row``, ``start``, ``end``) overlaps another one of its row that is ``strong``; a sorted sweep."""
    order = Window.partitionBy(row).orderBy("start", "end", "ord")
    before = F.max(F.when(strong, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(strong, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    return F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

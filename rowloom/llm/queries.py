"""Registered queries: each applies one operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import ann, chat, lines, media, mixing, periods, pieces, pii, quality, secrets, simhash, toxicity, whiten
from rowloom.llm.common import staged, table, word_count


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"), F.md5("text").alias("digest"))
    mixed = mixing.mix(staged(docs, "mix-sizes"), size="words", digest="digest")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read_avi(media.to_avi(table(spark, sf_dir, "documents")))
    clip = lambda c: F.concat(c["start_ms"], F.lit("-"), c["end_ms"], F.lit(":"), F.format_number(c["mean"], 2))
    feature = F.concat(F.lit("shots="), F.size("clips"), F.lit(";"), F.array_join(F.transform("clips", clip), ","))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sample_pieces(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return secrets.digest(found, pii.KINDS)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    messages = chat.as_trees(rows.unionByName(spark.createDataFrame(control, "conv_id long, turn long, role string, text string")))
    read = chat.read_back(chat.format_paths(chat.best_paths(messages, top=1)))
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    loss = F.array_join("loss_texts", "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", turn), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periods.planted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periods.find_runs(docs).withColumn("best", periods.strongest(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op10_toxicity": op10_toxicity, "op1_simhash": op1_simhash, "op11_reply_trees": op11_reply_trees, "op12_runs": op12_runs, "op13_whitening": op13_whitening, "op2_quality": op2_quality, "op3_media": op3_media, "op4_pieces": op4_pieces, "op5_pii": op5_pii, "op9_secrets": op9_secrets, "op6_mixing": op6_mixing, "op7_nearest": op7_nearest, "op8_line_dedup": op8_line_dedup}
ORACLES = {"op11_reply_trees": chat.CHAT_SQL, "op6_mixing": mixing.MIX_SQL, "op8_line_dedup": lines.LINES_SQL}

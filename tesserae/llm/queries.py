"""The ``opN_<name>`` queries: each operator on its whole table, reduced to its digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontamination, licenses, mixing, near_dups, quality, repeats, secrets, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secret_spans", lambda s: s["kind"] != "novel")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("bigint")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return docs.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secret_spans")).alias("spans"), count("novel").alias("n_novel"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    s = F.col("quality_score")
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), s.alias("score"), F.when(s >= model.o.threshold, 1).otherwise(0).cast("int").alias("predicted"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.summarize(docs)


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents")).drop("n_links")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    s = F.col("toxicity")
    return toxicity.score(docs, index).select(
        "doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), s.alias("score"), F.when(s >= index.o.threshold, 1).otherwise(0).cast("int").alias("predicted"), "evidence",
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaking(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


PLANTED = "SELECT -7L AS conv_id, turn, role, '\\\\### Assistant: </turn> ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(PLANTED))
    ex = chat.prefix_examples(conv)
    ex = ex.withColumn("target", F.struct("example_no", chat.read_target(F.col("formatted"), F.col("loss_start"), F.col("loss_len")).alias("text")))
    per = ex.groupBy("conv_id").agg(
        F.max_by("formatted", "example_no").alias("longest"),
        F.sort_array(F.collect_list("target")).alias("targets"),
        F.sum(F.length("formatted")).cast("bigint").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    per = per.withColumn("turns", chat.read_turns(F.col("longest"))).withColumn("loss", F.array_join("targets.text", ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", F.col("n_examples").cast("bigint").alias("n_examples"),
    )


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality": op2_quality,
    "op3_license_scan": op3_license_scan,
    "op4_near_dups": op4_near_dups,
    "op5_toxicity": op5_toxicity,
    "op6_decontaminate": op6_decontaminate,
    "op7_chat_format": op7_chat_format,
    "op8_ann": op8_ann,
    "op9_repeats": op9_repeats,
    "op10_mix_sources": op10_mix_sources,
}

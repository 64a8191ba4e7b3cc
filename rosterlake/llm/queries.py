"""The dealt operators as queries over whole tables, with the given results."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bayes, chat, counting, decontaminate, interactions, jaccard, licenses, oracles, packing, quality, repair, secrets, substrings, toxicity

SEQUENCE = 2048
TOKEN_LIMIT = 512


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), SEQUENCE)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == secrets.KINDS.index(kind))).cast("long")
    return out.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                      F.sha2(secrets.spelled(F.col("base")), 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cascade(table(spark, sf_dir, "documents"), facts=quality.FACTS).drop("rejected_by")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_tokens(table(spark, sf_dir, "documents"), tokenizer(), TOKEN_LIMIT)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(rows.unionByName(extra)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.audited(repair.damage(rows), rows)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interactions.labelled(interactions.text_filters(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return interactions.interactions(rows, marks=("good", "toxic"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes.near_duplicates(table(spark, sf_dir, "documents"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_secret_scan, op3_quality_rules, op4_token_counts, op5_chat_formatting, op6_toxicity, op7_ngram_jaccard_join, op8_suffix_dedup, op9_decontamination, op10_license_scan, op11_conversation_repair, op12_filter_audit, op13_minhash_near_dedup)}


def all_oracles() -> dict[str, str]:
    return {
        "op3_quality_rules": oracles.QUALITY, "op5_chat_formatting": oracles.CHATS, "op7_ngram_jaccard_join": oracles.SIMILAR,
        "op8_suffix_dedup": oracles.REPEATS, "op9_decontamination": oracles.LEAKS, "op11_conversation_repair": oracles.REPAIR, "op12_filter_audit": oracles.FILTERS, "op13_minhash_near_dedup": oracles.NEAR,
    }

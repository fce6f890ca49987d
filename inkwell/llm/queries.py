"""The queries ``opN_<name>`` and their SQL twins.

Each applies its operator, with production parameters, to the whole of its
tables and derives the columns that the result is compared by.
"""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, quality, secrets, toxicity
from .common import read
from .decontaminate import contamination
from .mixing import mix
from .oracles import DECONTAMINATION, JACCARD, MIXING, PREFIX_TRIE, REPAIR, TOPK
from .repair import repair
from .sharding import shard
from .simhash import near_duplicates
from .substring import remove_repeats
from .topk import top_k
from .trie import prefix_trie
from .triejoin import jaccard_groups


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), width=4, most_bits=4, seed=42)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


def _held_out(parts: int, fold: int) -> Column:
    """Rows that no model learns from; a null id is in no fold, so it teaches."""
    return F.coalesce(langid.remainder("doc_id", parts) == fold, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", _held_out(4, 2))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.identify(docs, model, keep=["doc_id", "held_out"])


def _scored(spark: SparkSession, sf_dir: str, model, target: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", _held_out(3, 1))
    labels = read(spark, sf_dir, "labels").where(~_held_out(3, 1))
    fitted = model.fit(docs.where(~F.col("held_out")), labels, target)
    return model.score(docs, fitted, keep=["doc_id", "held_out"])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, quality, "quality")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, toxicity, "toxic")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = remove_repeats(read(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "at", "nth", "kind", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), seed="mix-1").drop("row")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5, scale=256.0)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), shards=16).drop("row")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"), graft=True)


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(read(spark, sf_dir, "conversations"), damage=True)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read(spark, sf_dir, "documents"), width=3, percent=90)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_language_id": op2_language_id,
    "op3_quality": op3_quality,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_secrets": op5_secrets,
    "op6_mixing": op6_mixing,
    "op7_topk": op7_topk,
    "op8_sharding": op8_sharding,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_structure_repair": op12_structure_repair,
    "op13_jaccard_join": op13_jaccard_join,
    "pipeline": pipeline,
}

ORACLE: dict[str, str] = {
    "op6_mixing": MIXING,
    "op7_topk": TOPK,
    "op9_decontamination": DECONTAMINATION,
    "op11_prefix_trie": PREFIX_TRIE,
    "op12_structure_repair": REPAIR,
    "op13_jaccard_join": JACCARD,
}

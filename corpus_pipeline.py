"""The corpus pipeline: documents in, sharded training documents out.

Each stage takes what its predecessor kept, written as Parquet and read again.
In all of them texts of any length are taken whole, a null id is a row like any
other, repeated rows count each unless a stage says otherwise, an empty table
gives no rows, and further columns are passed through untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import langid
from inkwell.llm.common import Tables, cut, own_names, read, small_batches, with_few
from inkwell.llm.decontaminate import decontaminate
from inkwell.llm.mixing import resample
from inkwell.llm.sharding import shard
from inkwell.llm.simhash import drop_copies

#: A language that is less sure than this is rejected.
LEAST_LANGUAGE_SCORE = 0.5
#: A document with a larger share of benchmark words is dropped whole; otherwise only those words are.
MOST_BENCHMARK_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a sure language; those without letters, null and empty texts included, go.

    The model learns from the rows with a language, so without any all go. Only
    hashes of rejected rows are kept meanwhile: texts go to Python, a thousand at
    once, and do not come back. Rows of equal id and text share their verdict.
    """
    return _sure(docs)


@own_names
def _sure(docs: DataFrame) -> DataFrame:
    marks = {"__at": F.xxhash64("doc_id"), "__row": F.xxhash64("text")}
    sure = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    model = langid.fit(docs)
    with small_batches(docs.sparkSession):
        found = langid.identify(docs.select("text", *[c.alias(n[2:]) for n, c in marks.items()]), model, keep=["at", "row"])
        gone = cut(found.where(~sure).select(F.col("at").alias("__at"), F.col("row").alias("__row")).distinct())
    return with_few(docs.withColumns(marks), gone, list(marks), "left_anti").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies: five-word shingles, similarity of 0.8 or more.

    It is that of the smallest id; of repeated rows one stays, and rows with a
    null id stay. Texts without words are copies of each other.
    """
    return drop_copies(docs, width=5, similarity=0.8)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes benchmark passages from texts, and documents that are mostly such.

    Null and empty texts have no passages and stay, as all do if there is no
    benchmark item. ``n_chars`` is counted anew.
    """
    clean = decontaminate(docs, read(spark, sf_dir, "benchmark"), MOST_BENCHMARK_SHARE)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that the sources reach their targets.

    Texts without words stay once; a null source is a source of its own.
    """
    return resample(docs, seed="mix-1")


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``shard``, ``slot`` and what belongs to them: 16 shards of equal numbers of rows, equal texts together.

    All columns of the documents stay, so the result is what a training job
    reads, shard by shard, in the order of the slots.
    """
    return shard(docs, shards=16, whole=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", cut_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("sharding", assign_shards),
]

#: Models, fingerprints and propagation are not SQL; tests compare each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; only the last one's table is left."""
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        tables = Tables(spark)
        docs = tables.write(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        before = tables
    return docs

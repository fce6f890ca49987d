"""Ranked retrieval: an inverted index with BM25 weights, searched block by block.

The index is three tables: postings (term, block, id, tf, len), the greatest
weight of each term in each block, and each term's number of documents. A block
is a set of documents of about the same length, the same for all terms, so the
sum of its terms' greatest weights bounds the score of each document in it. A
search scores the most promising blocks first and then only those whose bound
reaches the k-th best score so far; the result is that of a full scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: BM25: how soon repeats of a term stop counting, and how much length counts.
K1, B = 1.2, 0.75
#: Documents of a block, about, and steps of length between blocks for each doubling.
BLOCK, STEPS = 256, 4


def terms_of(text: str | Column) -> Column:
    """Words of letters and digits, lower-cased; none for null."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.coalesce(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    #: documents, and their mean length in terms
    documents: int
    mean: float

    def save(self, path: str) -> None:
        """As Parquet below ``path``: postings sorted by term, so that a search reads the row groups of its terms."""
        self.postings.repartitionByRange("term", "block").sortWithinPartitions("term", "block", "id").write.mode("overwrite").parquet(f"{path}/postings")
        self.blocks.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/blocks")
        self.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        spark = self.terms.sparkSession
        spark.createDataFrame([(self.documents, self.mean)], "documents long, mean double").coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        tables = [spark.read.parquet(f"{path}/{t}") for t in ("postings", "blocks", "terms")]
        return cls(*tables, *spark.read.parquet(f"{path}/totals").first())


def _weight(tf: Column, length: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def build(docs: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> Index:
    """The index of ``docs``; ids must be distinct. Rows without terms or with a null id are in no posting, but count as documents.

    One shuffle by (term, document) counts terms, after a count in each task; a
    term of very many documents is spread by its documents.
    """
    rows = docs.select(F.col(id_col).alias("id"), terms_of(text_col).alias("terms")).withColumn("len", F.size("terms").cast("long"))
    documents, words = rows.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    mean = words / documents if words else 1.0
    step = F.floor(F.log2(F.col("len").cast("double")) * STEPS).cast("long")
    # as many blocks of a length as its documents would fill if all had it: a number that is the same in every task
    spread = max(1, documents // BLOCK)
    block = step * spread + F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.lit(spread) / (2 * STEPS)).cast("long"))
    tf = rows.where("id is not null and len > 0").select("id", "len", block.alias("block"), F.explode("terms").alias("term")).groupBy("term", "block", "id", "len").agg(F.count("*").alias("tf"))
    tops = tf.groupBy("term", "block").agg(F.max(_weight(F.col("tf"), F.col("len"), mean)).alias("top"), F.count("*").alias("n"))
    return Index(tf, tops, tops.groupBy("term").agg(F.sum("n").alias("df")), documents, mean)


def search(index: Index, query: str, most: int = 10, threshold: float = 0.0) -> DataFrame:
    """(id, score) of the ``most`` best documents for the terms of ``query``, best first, ties by id; scores below ``threshold`` or 0 are left out.

    The driver sees the query's terms, a few of the best blocks and one score.
    """
    spark = index.terms.sparkSession
    asked = [r[0] for r in spark.range(1).select(F.explode(F.array_distinct(terms_of(F.lit(query))))).collect()]
    known = index.terms.where(F.col("term").isin(asked)).select("term", F.log(1 + (index.documents - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    idf = {r.term: r.idf for r in known.collect()}
    weights = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    bounds = index.blocks.where(F.col("term").isin(list(idf))).join(F.broadcast(weights), "term").groupBy("block").agg(F.sum(F.col("idf") * F.col("top")).alias("bound"), F.max("n").alias("n"))
    first, filled = [], 0
    for r in bounds.orderBy(F.desc("bound"), "block").limit(most).collect():
        first.append(r.block)
        filled += r.n
        if filled >= most:
            break

    def scored(postings: DataFrame) -> DataFrame:
        rows = postings.where(F.col("term").isin(list(idf))).join(F.broadcast(weights), "term")
        # in one order of terms, so that equal documents have equal scores
        parts = F.sort_array(F.collect_list(F.struct("term", (F.col("idf") * _weight(F.col("tf"), F.col("len"), index.mean)).alias("w"))))
        return rows.groupBy("id").agg(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["w"]).alias("score"))

    best = scored(index.postings.where(F.col("block").isin(first))).orderBy(F.desc("score"), "id").limit(most).select("score").collect()
    least = max(threshold, best[-1].score if len(best) == most else 0.0)
    hopeful = bounds.where(F.col("bound") >= least * (1 - 1e-9)).select("block")
    rows = scored(index.postings.join(hopeful, "block", "left_semi"))
    return rows.where((F.col("score") > 0) & (F.col("score") >= threshold)).orderBy(F.desc("score"), "id").limit(most)

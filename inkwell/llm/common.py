"""What the operators share: the shared folder, cut lineage, column checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it; a local folder is made only where the
    session has none and its master is local (one JVM, as in tests).
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    have = sc._jsc.sc().getCheckpointDir()
    if not have.isDefined():
        if not named and not sc.master.startswith("local"):
            raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="inkwell-"))
        have = sc._jsc.sc().getCheckpointDir()
    return named or have.get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into reliable storage; its lineage ends there.

    Spark deletes the files with the last reference to them, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is computed within hands Python so many rows at once: for long rows, of which ten thousand would fill its memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def own_names(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``work(docs, ...)`` that passes columns through, with those of ``docs`` that begin with an underscore renamed while it runs.

    So the names that it uses itself, which all begin so, can't clash with the
    caller's. Arguments that name such a column, alone or in a list, follow.
    """

    @wraps(work)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        odd = {c: f"kept{i}-{c}" for i, c in enumerate(docs.columns) if c.startswith("_")}
        if not odd:
            return work(docs, *args, **options)

        def now(x):
            return odd.get(x, x) if isinstance(x, str) else [now(y) for y in x] if isinstance(x, list) else x

        out = work(docs.withColumnsRenamed(odd), *map(now, args), **{k: now(v) for k, v in options.items()})
        return out.withColumnsRenamed({v: k for k, v in odd.items()})

    return run


class Tables:
    """Intermediate tables as Parquet in the shared folder.

    Results are read from them later, so they stay until :meth:`drop` or, at
    the latest, the end of the application, when Hadoop's file system deletes
    them.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def _on(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/inkwell-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        system, at = self._on(path)
        system.deleteOnExit(at)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            system, at = self._on(path)
            system.delete(at, True)
        self.paths = []


def words_apart(text: Column, apart: str) -> Column:
    """Words of a text: what stands between runs of the character class ``apart``; none for null.

    A split needs a twentieth of the time of ``regexp_extract_all``, which
    copies the whole text for every match.
    """
    words = F.array_remove(F.split(text, f"[{apart}]+", -1), "")
    return F.coalesce(words, F.array().cast("array<string>"))


def need(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns missing: {missing}; there are {df.columns}")


#: Rows of keys and short lists that are broadcast, and elements of their lists in all; more go through a shuffle.
FEW_ROWS = 300_000


def with_few(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", lists: str | None = None, salts: int = 1) -> DataFrame:
    """``rows`` joined with ``few``, which is broadcast only if it has at most ``FEW_ROWS`` rows.

    So long rows (texts) stay where they are as long as the other side is small.
    ``few`` has one row a key, or several that all belong to each row; it should
    be cut or cheap, as its rows, and the elements of its arrays ``lists``, are
    counted first. Beyond that both sides are shuffled by key and, with
    ``salts``, by salt: the rows of a hot key are shared by so many tasks, and
    ``few`` is copied as often. Null keys match nothing.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    small = few.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    if small and lists:
        small = (few.agg(F.sum(F.greatest(F.size(lists), F.lit(0)))).first()[0] or 0) <= FEW_ROWS
    if small:
        return rows.join(F.broadcast(few), keys, how)
    if salts == 1:
        return rows.join(few, keys, how)
    salted = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    spread = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*keys, "__salt"], how).drop("__salt")

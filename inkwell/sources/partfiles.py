"""Packets as part files of a shared store: planned, probed, staged, and committed as a whole.

A task writes its files into a staging folder of the job and lists them in a
manifest there. Only the commit moves them to their places, in the order of
their keys, so a packet's last part comes after its others; then it files the
manifests under ``_index`` and marks the job as done. An abort removes the staging
folder. So a job that fails leaves nothing, and one that runs again finds what
is there: keys name the content's hash, and a packet whose first and last parts
exist is whole.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import TypeVar

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import urls as U
from ..operators import documents

#: Attempts of an upload, and the milliseconds that the wait grows by after each.
ATTEMPTS, STEP = 3, 500
_STAGING, _INDEX = "_staging", "_index"
T = TypeVar("T")


def with_retries(work: Callable[[], T], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> T:
    """What ``work`` returns; an OSError is tried again after a wait that grows by the same step each time."""
    for k in range(attempts):
        try:
            return work()
        except OSError:
            if k + 1 == attempts:
                raise
            sleep(STEP * (k + 1) / 1000)
    raise ValueError("there must be an attempt")


def _place(base: str, key: str) -> str:
    return "/".join([base.rstrip("/"), *[p for p in key.split("/") if p not in ("", ".", "..")]])


def _exists(files: pyarrow.fs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type == pyarrow.fs.FileType.File


class PartFiles(DataSource):
    """Writes rows (key, text) as one file a key below the ``path`` option: an address of a shared file system, or a folder that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "partfiles"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PartWriter(self.options["path"], self.options.get("job") or uuid.uuid4().hex)


@dataclass
class _Written(WriterCommitMessage):
    manifest: str


class PartWriter(DataSourceWriter):
    """Stages a task's files; the driver sees one manifest's address a task and moves files by name."""

    def __init__(self, path: str, job: str) -> None:
        self.path, self.job = path, job

    def write(self, rows: Iterator) -> WriterCommitMessage:
        files, base = pyarrow.fs.FileSystem.from_uri(self.path)
        task = f"{base.rstrip('/')}/{_STAGING}/{self.job}/{uuid.uuid4().hex}"
        files.create_dir(task, recursive=True)

        def put(n: int, body: bytes) -> str:
            at = f"{task}/{n:08}"
            with files.open_output_stream(at) as f:
                f.write(body)
            return at

        manifest = f"{task}/manifest"
        with files.open_output_stream(manifest) as listed:
            for n, row in enumerate(rows):
                body = row["text"].encode("utf-8", "surrogatepass")
                at = with_retries(lambda n=n, body=body: put(n, body))
                listed.write((json.dumps({"key": row["key"], "staged": at, "bytes": len(body), "sha256": hashlib.sha256(body).hexdigest()}) + "\n").encode())
        return _Written(manifest)

    def commit(self, messages: list) -> None:
        files, base = pyarrow.fs.FileSystem.from_uri(self.path)

        def finish(numbered: tuple[int, _Written]) -> None:
            n, message = numbered
            with files.open_input_stream(message.manifest) as f:
                rows = [json.loads(line) for line in f.read().decode().splitlines()]
            for row in sorted(rows, key=lambda r: r["key"]):
                to = _place(base, row["key"])
                files.create_dir(to.rpartition("/")[0], recursive=True)
                with_retries(lambda row=row, to=to: files.move(row["staged"], to))
            index = f"{base.rstrip('/')}/{_INDEX}/{self.job}"
            files.create_dir(index, recursive=True)
            with files.open_output_stream(f"{index}/{n:06}.jsonl") as f:
                f.write("".join(json.dumps({k: r[k] for k in ("key", "bytes", "sha256")}) + "\n" for r in rows).encode())

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(finish, enumerate(m for m in messages if m is not None)))
        done = f"{base.rstrip('/')}/{_INDEX}/{self.job}"
        files.create_dir(done, recursive=True)
        with files.open_output_stream(f"{done}/_SUCCESS"):
            pass
        self._clean(files, base)

    def abort(self, messages: list) -> None:
        self._clean(*pyarrow.fs.FileSystem.from_uri(self.path))

    def _clean(self, files: pyarrow.fs.FileSystem, base: str) -> None:
        staging = f"{base.rstrip('/')}/{_STAGING}"
        if files.get_file_info(f"{staging}/{self.job}").type == pyarrow.fs.FileType.Directory:
            files.delete_dir(f"{staging}/{self.job}")
        if files.get_file_info(staging).type == pyarrow.fs.FileType.Directory and not files.get_file_info(pyarrow.fs.FileSelector(staging)):
            files.delete_dir(staging)


_PACKET = ("source_id", "original_url", "canonical_url", "retrieved_at", "content_hash", "content_type", "title", "author", "published_at", "content")
PARTS = "source_id string, prefix string, part int, parts int, key string, bytes long, text string, state string, error string"


def part_rows(packets: DataFrame, most: int, under: str = "", path: str | None = None, skip_existing: bool = True) -> DataFrame:
    """A row for each part of each packet (``PARTS``): its key, and its text with a head, within ``most`` bytes.

    ``packets`` has the columns ``source_id``, ``canonical_url``, ``content_hash``
    and ``content``, and of ``_PACKET`` what it knows of the others. With ``path``,
    the store is asked for a packet's first and last part: ``state`` is
    ``exists`` if both are there (one row without a text), else ``new``. A
    packet whose head alone is too large has one row, in state ``failed``.
    """
    known = packets.select(*[(F.col(c) if c in packets.columns else F.lit(None)).cast("string").alias(c) for c in _PACKET])
    known = known.withColumn("base", U.object_key(F.col("canonical_url"), F.lit(under)))

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = pyarrow.fs.FileSystem.from_uri(path) if path else (None, "")
        for frame in frames:
            for packet in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                prefix = f"{packet['base']}/{packet['content_hash']}"
                row = dict(source_id=packet["source_id"], prefix=prefix, part=0, parts=0, key=None, bytes=0, text=None, state="failed", error=None)
                try:
                    texts = documents.stored_parts({**packet, "content": packet["content"] or ""}, most)
                except ValueError as e:
                    yield pd.DataFrame([row | {"error": f"CONTENT_TOO_LARGE: {e}"}])
                    continue
                keys = [f"{prefix}/part-{k + 1:04}.md" for k in range(len(texts))]
                sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                if files and skip_existing and all(_exists(files, _place(base, k)) for k in {keys[0], keys[-1]}):
                    yield pd.DataFrame([row | dict(parts=len(texts), bytes=sum(sizes), state="exists")])
                    continue
                yield pd.DataFrame([row | dict(part=k + 1, parts=len(texts), key=keys[k], bytes=sizes[k], text=t, state="new") for k, t in enumerate(texts)])

    return known.mapInPandas(plan, PARTS)


def ingest(packets: DataFrame, path: str, most: int = 4_194_304, under: str = "", skip_existing: bool = True) -> DataFrame:
    """Stores packets' parts and returns a row for each packet: (source_id, uploaded, skipped_existing, prefix, parts, bytes, error).

    What is reported comes from the job's index, so a part counts as uploaded
    only once it is committed. Packets with the same address and content are
    stored once.
    """
    spark, job = packets.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(PartFiles)
    index = f"{path.rstrip('/')}/{_INDEX}/{job}"
    # kept with the index, as it can't be made again once the store has changed
    part_rows(packets, most, under, path, skip_existing).drop("text").write.parquet(f"{index}/plan")
    plan = spark.read.parquet(f"{index}/plan")
    new = part_rows(packets, most, under).where("key is not null").select("key", "text").join(plan.where("state = 'new'").select("key").distinct(), "key", "left_semi")
    new = new.groupBy("key").agg(F.first("text").alias("text"))
    # a packet's parts in one task, in order
    new.repartition(F.regexp_replace("key", "/[^/]*$", "")).write.format("partfiles").option("path", path).option("job", job).mode("append").save()
    stored = spark.read.schema("key string, bytes long, sha256 string").option("pathGlobFilter", "*.jsonl").json(index).select("key").distinct().withColumn("stored", F.lit(True))
    told = plan.join(stored, "key", "left").groupBy("source_id", "prefix")
    return told.agg(
        (F.count_if(F.col("state") == "new") > 0).alias("fresh"), (F.count_if(F.col("stored")) == F.count_if(F.col("state") == "new")).alias("whole"),
        (F.count_if(F.col("state") == "exists") > 0).alias("skipped_existing"), F.max("parts").alias("parts"), F.sum("bytes").alias("bytes"), F.max("error").alias("error"),
    ).select("source_id", (F.col("fresh") & F.col("whole")).alias("uploaded"), "skipped_existing", "prefix", "parts", "bytes", "error")

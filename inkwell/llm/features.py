"""Hashed words, structure statistics and metadata of a text, for the linear models."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need, own_names

WORD_BITS = 16
#: Words of which a worker keeps the hashes.
KEPT_WORDS = 300_000
_LETTERS = re.compile(r"[^\W\d_]+")

#: Names of the structure statistics and the metadata, in order.
STRUCTURE = (
    "letters", "capitals", "digits", "spaces", "marks", "symbols", "bars", "exclamations", "sentence_ends",
    "mean_word", "distinct_words", "distinct_lines", "words_a_line", "capital_starts", "log_words", "log_chars",
)
_CLASSES = np.zeros((8, 256))
for _row, _chars in enumerate((
    b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789",
    b" \t\n\r\v\f", b".,;:'\"()-", b"#$%&*@^~<>=+\\/{}[]_`", b"|", b"!?",
)):
    _CLASSES[_row, list(_chars)] = 1


def structure(text: str) -> np.ndarray:
    """Shares and lengths that describe a text's form; zeros for an empty one."""
    out = np.zeros(len(STRUCTURE))
    if not text:
        return out
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = data.split(), data.split(b"\n")
    out[:8] = _CLASSES @ counts / len(data)
    n = max(1, len(words))
    out[8] = counts[[33, 46, 63]].sum() / n
    out[9] = sum(map(len, words)) / n / 10
    out[10] = len(set(words)) / n
    out[11] = len(set(lines)) / len(lines)
    out[12] = np.log1p(n / len(lines)) / 5
    out[13] = sum(w[:1].isupper() for w in words) / n
    out[14], out[15] = np.log1p(len(words)) / 8, np.log1p(len(data)) / 10
    return out


class WordIds(dict):
    """The hashed features of a word, computed once while it is kept."""

    def __init__(self, of: Callable[[str], tuple[int, ...]]) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = ids = self.of(word)
        return ids

    def features(self, text: str | None) -> np.ndarray:
        """Distinct features of a whole text, in order."""
        return self.of_words(letter_words(text) if text else ())

    def of_words(self, words) -> np.ndarray:
        return np.array(sorted({i for w in set(words) for i in self[w]}), np.int32)


def letter_words(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return _LETTERS.findall(text.lower())


def hashed(word: str, bits: int, salt: str = "") -> int:
    return crc32((salt + word).encode("utf-8", "surrogatepass")) >> (32 - bits)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, most: int, id_col: str, text_col: str) -> DataFrame:
    """(text, label) of about ``most`` labelled rows at most, chosen by a hash of the id; all if there are fewer.

    Conflicting labels of one id count as 1 if at least half of them are. Rows
    without a text or a label teach nothing.
    """
    known = labels.where(F.col(target).isNotNull() & F.col(id_col).isNotNull())
    count = known.count()
    draw = F.pmod(F.xxhash64(id_col, F.lit("labels")), F.lit(1_000_000))
    chosen = known.where(draw < int(min(1.0, most / max(1, count)) * 1_000_000)).groupBy(id_col)
    chosen = chosen.agg((F.avg(target) >= 0.5).cast("int").alias("label"))
    # about ``most`` rows of two numbers: small enough to send to every executor, if they are as expected
    side = F.broadcast(chosen) if most <= 100_000 and count else chosen
    return docs.where(F.col(text_col).isNotNull()).join(side, id_col).select(F.col(text_col).alias("text"), "label")


#: What a text gives a model: hashed features, dense ones, and pairs of hashed features that should score alike.
Extracted = tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]


def collect_features(sample: DataFrame, extract: Callable[[str], Extracted]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Labels, hashed features, dense features and pairs of the sample, on the driver; texts stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for batch in batches:
            found = [extract(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1), pa.array([a for a, _, _ in found], ints), pa.array([d for _, d, _ in found], pa.list_(pa.float64())),
                    pa.array([[a for a, _ in p] for _, _, p in found], pa.list_(ints)), pa.array([[b for _, b in p] for _, _, p in found], pa.list_(ints)),
                ],
                ["label", "ids", "dense", "left", "right"],
            )

    table = sample.mapInArrow(run, "label int, ids array<int>, dense array<double>, left array<array<int>>, right array<array<int>>").toArrow()
    ids = [np.array(x, np.int32) for x in table["ids"].to_pylist()]
    # a fixed order, so that a rerun fits the same model
    dense = np.array(table["dense"].to_pylist(), float).reshape(len(ids), -1) if ids else np.empty((0, 0))
    order = sorted(range(len(ids)), key=lambda i: (len(ids[i]), ids[i].tobytes(), dense[i].tobytes()))
    left, right = (table[side].to_pylist() for side in ("left", "right"))
    pairs = [(np.array(a, np.int32), np.array(b, np.int32)) for i in order for a, b in zip(left[i], right[i], strict=True)]
    return table["label"].to_numpy()[order].astype(float), [ids[i] for i in order], dense[order], pairs


@own_names
def score_texts(docs: DataFrame, scorer: Callable[[], Callable[[str | None], float]], threshold: float, text_col: str, keep: list[str] | None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score`` and ``predicted``; columns of these names are replaced."""
    need(docs, text_col)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    kept = docs.select(*names, F.col(text_col).alias("__text"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in batches:
            values = np.array([score(t.as_py()) for t in batch.column(len(names))], float)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(values), pa.array((values >= threshold).astype(np.int32))], [*names, "score", "predicted"]
            )

    return kept.mapInArrow(run, schema)


def logistic(z: float | np.ndarray):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All features of several rows and the row that each belongs to."""
    return np.concatenate(rows) if rows else np.empty(0, np.int32), np.repeat(np.arange(len(rows)), [len(r) for r in rows])

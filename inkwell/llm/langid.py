"""Language identification by segmentation-marginalised unigrams.

Each language has its own probabilities over the pieces of one fixed public
vocabulary. They are learnt by expectation maximisation: expected piece counts
over all segmentations of the sample's words, then normalisation towards the
mean of the languages. A text's likelihood is the product of its words', each
summed over all segmentations. Words repeat, so a worker keeps the values of
those it has met, a bounded number of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need, own_names, small_batches
from .pieces import FLOOR, SHORT, Lattice, load_pieces, words_of

#: Where the vocabulary lies; a parameter everywhere it is used.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Expected rows a language that the fit reads at most; fewer rows are all read.
SAMPLE = 1000
#: Rounds of expectation maximisation, and the weight of the mean language.
ROUNDS, MEAN_WEIGHT = 2, 200.0
#: Words of which a worker keeps the values, and documents it handles together.
KEPT_WORDS, TOGETHER = 150_000, 256
#: Characters of distinct words that a task gathers before it learns from them.
GATHERED = 2_000_000
_LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    pieces: tuple[str, ...]
    probs: np.ndarray  # pieces and the unknown one x languages


def sample_of(rows: DataFrame, label: str, most: int, *key: str) -> DataFrame:
    """Rows of every label, chosen by a hash of ``key``: all if there are up to ``most``, else about ``most``.

    The choice is spread over the whole input and needs one count a label; a
    rerun chooses the same rows.
    """
    sizes = rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()
    if not sizes:
        return rows.where("false")
    draw = F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(1_000_000))
    keep = F.lit(False)
    for value, count in sizes:
        keep = keep | ((F.col(label) == value) & (draw < int(min(1.0, most / count) * 1_000_000)))
    return rows.where(keep)


def fit(
    rows: DataFrame,
    vocabulary: str = VOCABULARY,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    sample: int = SAMPLE,
    rounds: int = ROUNDS,
) -> Model:
    """Learns from rows with a language and a text; at most about ``sample`` rows a language.

    Words of any length teach, so languages without spaces do, too. Null and
    empty texts, and rows without a language, teach nothing; repeated rows
    count each; the choice of rows is that of a hash of the id (null ids are
    all chosen or none). An empty table gives a model without languages. Other
    columns are not read.
    """
    need(rows, text_col, lang_col, id_col)
    pieces = load_pieces(vocabulary)
    chosen = sample_of(rows.where(F.col(text_col).isNotNull()), lang_col, sample, id_col)
    chosen = chosen.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).persist()
    languages = tuple(sorted(r[0] for r in chosen.select("lang").distinct().collect()))
    size = len(pieces) + 1
    probs = np.full((size, max(1, len(languages))), 1 / size)
    for _ in range(rounds if languages else 0):
        shipped = rows.sparkSession.sparkContext.broadcast((pieces, languages, probs))
        counts = np.zeros_like(probs)
        with small_batches(rows.sparkSession):
            totals = (
                chosen.mapInArrow(_expectation(shipped), "lang int, piece int, uses double")
                .groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()
            )
        np.add.at(counts, (totals["piece"].to_numpy(), totals["lang"].to_numpy()), totals["uses"].to_numpy())
        shipped.unpersist()
        share = counts / np.maximum(counts.sum(axis=0), 1e-12)
        mean = share.mean(axis=1, keepdims=True) + 1e-7
        probs = counts + MEAN_WEIGHT * mean / mean.sum()
        probs = np.maximum(probs / probs.sum(axis=0), FLOOR)
    chosen.unpersist()
    return Model(languages, tuple(pieces), probs)


def _expectation(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, languages, probs = shipped.value
        lattice, at = Lattice(pieces), {x: i for i, x in enumerate(languages)}
        counts = np.zeros_like(probs)

        def learn(lang: int, words: Counter) -> None:
            items = list(words.items())
            for k in range(0, len(items), 5000):
                part = items[k : k + 5000]
                weights = np.array([c for _, c in part], float)
                counts[:, lang] += lattice.expected_counts([w for w, _ in part], weights, probs[:, lang])

        waiting: dict[int, Counter] = {}
        held: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = waiting.setdefault(at[lang], Counter())
                found = Counter(words_of(text.as_py()))
                held[at[lang]] += sum(len(w) for w in found if w not in words)
                words.update(found)
                if held[at[lang]] > GATHERED:
                    learn(at[lang], waiting.pop(at[lang]))
                    held[at[lang]] = 0
        for lang, words in waiting.items():
            learn(lang, words)
        piece, lang = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(counts[piece, lang])],
            ["lang", "piece", "uses"],
        )

    return run


@own_names
def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``lang_pred`` and ``score``, row by row and over whole texts.

    ``score`` is the language's share of the likelihoods, all languages being
    equally likely beforehand. A text that is null, empty or without letters is
    ``und`` with score 0, and so is every text if nothing was learnt. Equal
    likelihoods go to the first language in order. Words of any length are
    summed whole; one of a megabyte takes about twenty seconds. Null ids and
    repeated rows are rows like any other; an empty table gives no rows. Columns
    of these names in ``docs`` are replaced; all others are passed through
    untouched.
    """
    need(docs, text_col)
    shipped = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.probs))
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    # a text that is handed on goes to Python once
    at = names.index(text_col) if text_col in names else len(names)
    kept = docs.select(*names) if at < len(names) else docs.select(*names, text_col)
    schema = T.StructType([*kept.schema.fields[: len(names)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, pieces, probs = shipped.value
        scorer = _Scorer(languages, list(pieces), probs)
        for batch in batches:
            found: list[tuple[str, float]] = []
            texts = batch.column(at)
            for k in range(0, len(texts), TOGETHER):
                found += scorer([t.as_py() for t in texts[k : k + TOGETHER]])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                [*names, "lang_pred", "score"],
            )

    return kept.mapInArrow(run, schema)


def has_letter(text: str) -> bool:
    """Whether a letter (``str.isalpha``) is in the text; digits such as ² or ½ are none."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


class _Scorer:
    def __init__(self, languages: tuple[str, ...], pieces: list[str], probs: np.ndarray) -> None:
        self.languages, self.probs, self.lattice = languages, probs, Lattice(pieces)
        self.rows: dict[str, int] = {}
        self.values = np.empty((0, probs.shape[1]))

    def _add(self, missing: list[str]) -> None:
        """Keeps the values of short words, which come again."""
        have = len(self.rows)
        if (short := have + len(missing) - len(self.values)) > 0:
            spare = np.empty((max(short, len(self.values)), self.probs.shape[1]))
            self.values = np.concatenate([self.values, spare])
        for k in range(0, len(missing), 5000):
            part = missing[k : k + 5000]
            self.values[have + k : have + k + len(part)] = self.lattice.log_likelihoods(part, self.probs)
        self.rows.update((w, have + k) for k, w in enumerate(missing))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [words_of(t) if t else [] for t in texts]
        new = set().union(*split)
        long = [w for w in new if len(w) > SHORT]
        if len(self.rows) + len(new) > KEPT_WORDS:
            self.rows = {}
        self._add([w for w in new if len(w) <= SHORT and w not in self.rows])
        at = dict(zip(long, range(len(long)), strict=True))
        more = self.lattice.log_likelihoods(long, self.probs) if long else None
        out = []
        for text, words in zip(texts, split, strict=True):
            if not self.languages or not text or not has_letter(text):
                out.append((UNDETERMINED, 0.0))
                continue
            total = self.values[[self.rows[w] for w in words if len(w) <= SHORT]].sum(axis=0)
            if more is not None:
                total = total + more[[at[w] for w in words if len(w) > SHORT]].sum(axis=0)
            best = int(total.argmax())
            out.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def remainder(id_col: str, parts: int) -> Column:
    """The fold of a row: CRC-32 of its id as text, modulo ``parts``."""
    return F.crc32(F.col(id_col).cast("string")) % parts

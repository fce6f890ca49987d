"""Toxicity scores by a classifier regularised with counterfactuals.

Every sentence of a labelled row that names a group is paired with itself
naming another one. The fit pays for the squared change of the score between
the two, so a group's name cannot speak for toxicity on its own, however often
toxic rows of the sample hold it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from .common import need
from .features import WordIds, collect_features, flat, hashed, labelled_sample, letter_words, logistic, score_texts

#: Labelled rows that the fit reads, about and at most.
SAMPLE = 8000
BITS, EPOCHS, STEP, DECAY = 18, 20, 0.3, 1e-4
#: A feature is used if so many rows have it, and if toxic rows have it oftener than chance allows (in standard deviations). So are all group names.
LEAST_ROWS, LEAST_EXCESS = 4, 4.0
#: Weight of squared score changes between a sentence and its counterfactuals.
PENALTY = 1.0
#: Pairs that a step of the fit takes the penalty from.
PAIRS = 64
_SENTENCE_END = re.compile(r"[.!?\n]+")
THRESHOLD = 0.7
#: Names of groups, swapped for each other; a parameter of the fit.
IDENTITY_TERMS = (
    "women", "men", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "black", "white", "asian", "african",
    "latino", "gay", "straight", "lesbian", "trans", "immigrant", "refugee", "disabled", "deaf", "blind", "old", "young",
)
#: Neutral mentions; their counterfactuals must score alike, and low.
NEUTRAL = ("my neighbour is {}", "the {} community met today", "{} people live here", "she wrote about being {}")


def _parts(word: str) -> tuple[int, ...]:
    """A word and how it starts: inflected and joined forms share the starts."""
    found = [hashed(word, BITS, "w")]
    found += [hashed(word[:n], BITS, str(n)) for n in (4, 5) if len(word) > n]
    if len(word) == 4:
        found.append(hashed(word, BITS, "4"))
    return tuple(found)


@dataclass(frozen=True)
class Classifier:
    bias: float
    w: np.ndarray

    def score(self, ids: np.ndarray) -> float:
        return float(logistic(self.bias + self.w[ids].sum()))


def swaps(text: str, words: WordIds, terms: tuple[str, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of every sentence that names a group, and of the same sentence naming another one.

    The other name is drawn by a hash of the sentence, so a rerun draws the
    same. Words that share a feature with the name keep it.
    """
    known, out = set(terms), []
    if known.isdisjoint(letter_words(text)) or len(terms) < 2:
        return out
    for sentence in _SENTENCE_END.split(text):
        have = letter_words(sentence)
        for term in sorted(known.intersection(have)):
            at = terms.index(term)
            draw = crc32(f"{term} {sentence}".encode("utf-8", "surrogatepass"))
            other = terms[(at + 1 + draw % (len(terms) - 1)) % len(terms)]
            out.append((words.of_words(have), words.of_words(other if w == term else w for w in have)))
    return out


def neutral_mentions(terms: tuple[str, ...], words: WordIds) -> list[np.ndarray]:
    """Neutral sentences about each group: examples that are not toxic."""
    return [words.features(sentence.format(t)) for sentence in NEUTRAL for t in terms]


def _telling(ids: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Which features speak for toxicity; the rest, most of them rare words, would only be learnt by heart."""
    at, row = flat(ids)
    rows = np.bincount(at, minlength=1 << BITS)
    excess = np.bincount(at, y[row], 1 << BITS) - rows * y.mean()
    spread = np.sqrt(rows * y.mean() * (1 - y.mean())) + 1e-9
    return (rows >= LEAST_ROWS) & (excess / spread > LEAST_EXCESS)


def fit(
    docs: DataFrame, labels: DataFrame, target: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    sample: int = SAMPLE, terms: tuple[str, ...] = IDENTITY_TERMS, penalty: float = PENALTY, seed: int = 7,
) -> Classifier:
    """Fits to about ``sample`` labelled rows at most. Without labels every score is one half.

    Null labels and texts, and labels without a row, teach nothing; an empty
    text is a text without words; rows that share an id all have its label (a
    null id has none). Texts of any length are read whole. Other columns are not
    read.
    """
    need(docs, id_col, text_col)
    need(labels, id_col, target)
    words, rng = WordIds(_parts), np.random.default_rng(seed)
    empty = np.empty(0)
    labelled = labelled_sample(docs, labels, target, sample, id_col, text_col)
    y, ids, _, pairs = collect_features(labelled, lambda t: (words.features(t), empty, swaps(t, words, terms)))
    w, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
    if not len(y):
        return Classifier(0.0, w)
    rate = np.clip(y.mean(), 0.001, 0.999)
    bias = float(np.log(rate / (1 - rate)))
    more = neutral_mentions(terms, words)
    pairs = pairs + [(a, b) for k in range(len(NEUTRAL)) for a, b in zip(more[k * len(terms) :], more[k * len(terms) + 1 : (k + 1) * len(terms)], strict=False)]
    ids, y = ids + more, np.concatenate((y, np.zeros(len(more))))
    use = _telling(ids, y)
    use[[i for t in terms for i in _parts(t)[:1]]] = True
    ids = [x[use[x]] for x in ids]
    left, right = [a[use[a]] for a, _ in pairs], [b[use[b]] for _, b in pairs]

    def step(at: np.ndarray, gradient: np.ndarray) -> None:
        used, back = np.unique(at, return_inverse=True)
        g = np.bincount(back, gradient, len(used)) + DECAY * w[used]
        seen[used] += np.square(g)
        w[used] -= STEP * g / np.sqrt(seen[used])

    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for part in np.array_split(order, max(1, len(order) // 64)):
            at, row = flat([ids[i] for i in part])
            error = (logistic(bias + np.bincount(row, w[at], len(part))) - y[part]) / len(part)
            bias -= STEP * error.sum()
            step(at, error[row])
            if not left or not penalty:
                continue
            pick = rng.integers(len(left), size=PAIRS)
            a, ra = flat([left[i] for i in pick])
            b, rb = flat([right[i] for i in pick])
            change = 2 * penalty * (np.bincount(ra, w[a], len(pick)) - np.bincount(rb, w[b], len(pick))) / len(pick)
            step(np.concatenate((a, b)), np.concatenate((change[ra], -change[rb])))
    return Classifier(bias, w)


def score(docs: DataFrame, classifier: Classifier, text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Whole texts of any length; null and empty ones get the score of a text
    without words. Null ids and repeated rows are rows like any other; an empty
    table gives no rows. Columns of these names are replaced, others passed
    through.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(classifier)

    def scorer():
        c, words = shipped.value, WordIds(_parts)
        return lambda text: c.score(words.features(text))

    return score_texts(docs, scorer, threshold, text_col, keep)

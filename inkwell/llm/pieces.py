"""Words under a piece unigram model: the sum over all their segmentations.

A word is cut into pieces of a fixed public vocabulary in every possible way;
its probability is the sum, over the ways, of the product of its pieces'
probabilities. The forward algorithm adds them up from left to right. A
character that is no piece of its own is an unknown piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words up to this length are handled together without rescaling; longer ones with words of like length.
SHORT = 30
#: Columns after which probabilities of longer words are rescaled, and cells (column, word, language) of words handled together.
RESCALE, CELLS = 8, 1 << 19
#: No piece is less likely than this, so that short words cannot underflow.
FLOOR = 1e-9
MARK = "▁"


def load_pieces(path: str) -> list[str]:
    """The pieces of a SentencePiece model that text can hold, in lower case only."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = (
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    )
    return [p for p in kept if p == p.lower() and MARK not in p[1:]]


def words_of(text: str) -> list[str]:
    return text.lower().split()


class Lattice:
    """All pieces in words. Piece ``len(pieces)`` is the unknown character.

    The pieces are a trie in a table, state by character class, that all places
    of many words walk down together.
    """

    def __init__(self, pieces: list[str]) -> None:
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.unknown = len(pieces)
        self.heads = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        self.most = max(map(len, pieces), default=0)
        inner = {h[:-1] for h in self.heads}  # heads that go on, and the start
        states = {h: i for i, h in enumerate(sorted(inner, key=len))}
        count = len(states)
        for h in self.heads:
            states.setdefault(h, len(states))
        # first characters have many kinds, later ones few: those two tables
        self.first = np.zeros(0x110000, np.int32)
        kinds = sorted({h[-1] for h in self.heads if len(h) > 1})
        self.kind = np.zeros(0x110000, np.int16)
        self.kind[[ord(c) for c in kinds]] = np.arange(1, len(kinds) + 1)
        self.later = np.zeros((count, len(kinds) + 1), np.int32)
        self.piece = np.full(len(states), -1, np.int32)
        for h in self.heads:
            if len(h) == 1:
                self.first[ord(h)] = states[h]
            else:
                self.later[states[h[:-1]], self.kind[ord(h[-1])]] = states[h]
            self.piece[states[h]] = self.ids.get(h, -1)
        self.inner = count

    def stacked(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(word, start, end, piece) of all words, ordered by end."""
        chars = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(w) + 1 for w in words])
        begin = np.cumsum(sizes) - sizes
        word, kind = np.repeat(np.arange(len(words)), sizes), np.append(self.kind[chars], 0)
        offset = np.arange(len(chars)) - begin[word]
        place, state = np.arange(len(chars)), self.first[chars]
        alone = (state == 0) | (self.piece[state] < 0)
        found = [(place[alone], 1, np.full(int(alone.sum()), self.unknown, np.int32))]
        for depth in range(1, self.most + 1):
            piece = self.piece[state]
            ends = (piece >= 0) & (state > 0)
            found.append((place[ends], depth, piece[ends]))
            on = (state > 0) & (state < self.inner)
            place, state = place[on], state[on]
            # the next word's mark follows no head, so a walk ends with its word
            state = self.later[state, kind[place + depth]]
            on = state > 0
            place, state = place[on], state[on]
        at = np.concatenate([p for p, _, _ in found])
        start = offset[at]
        end = start + np.concatenate([np.full(len(p), d) for p, d, _ in found])
        order = np.argsort(end.astype(np.int16 if end.max(initial=0) < 1 << 15 else np.int64), kind="stable")
        return tuple(x[order] for x in (word[at], start, end, np.concatenate([x for _, _, x in found])))

    def log_likelihoods(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """One row a word of any length, one column a language; ``probs`` is pieces x languages."""
        out = np.empty((len(words), probs.shape[1]))
        for rows in together(words, probs.shape[1]):
            out[rows] = self._forward([words[k] for k in rows], probs)
        return out

    def _forward(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """Sums over all segmentations, column by column; only as many columns are kept as a piece can span."""
        count, langs = len(words), probs.shape[1]
        word, start, end, piece = self.stacked(words)
        lengths = np.array([len(w) + 1 for w in words])
        last, ring = int(lengths.max()), self.most + 1
        alpha = np.zeros((ring, count, langs))
        alpha[0] = 1
        scale, out = np.zeros((count, langs)), np.zeros((count, langs))
        bounds = np.searchsorted(end, np.arange(1, last + 2))
        for j in range(1, last + 1):
            s, column = slice(bounds[j - 1], bounds[j]), alpha[j % ring]
            ways = alpha[start[s] % ring, word[s]] * probs[piece[s]]
            for lang in range(langs):
                column[:, lang] = np.bincount(word[s], ways[:, lang], count)
            if last > SHORT + 1 and j % RESCALE == 0:
                most = alpha.max(axis=0)
                most[most == 0] = 1  # a word that has ended
                alpha /= most
                scale += np.log(most)
            if len(ends := np.flatnonzero(lengths == j)):
                out[ends] = np.log(column[ends]) + scale[ends]
        return out

    def expected_counts(self, words: list[str], weights: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in weighted words of any length, of one language (forward and backward)."""
        out = np.zeros(self.unknown + 1)
        for rows in together(words, 2):
            out += self._expected([words[k] for k in rows], weights[rows], probs)
        return out

    def _expected(self, words: list[str], weights: np.ndarray, probs: np.ndarray) -> np.ndarray:
        count = len(words)
        word, start, end, piece = self.stacked(words)
        p, lengths = probs[piece], np.array([len(w) + 1 for w in words])
        last = int(lengths.max())
        # column j of alpha holds e ** -up[j] of the true values, that of beta e ** -down[j]
        alpha, beta = np.zeros((last + 1, count)), np.zeros((last + 1, count))
        up, down = np.zeros((last + 1, count)), np.zeros((last + 1, count))
        alpha[0], beta[lengths, np.arange(count)] = 1, 1
        bounds = np.searchsorted(end, np.arange(1, last + 2))
        for j in range(1, last + 1):
            s = slice(bounds[j - 1], bounds[j])
            at, w = start[s], word[s]
            alpha[j] = np.bincount(w, alpha[at, w] * p[s] * np.exp(up[at, w] - up[j - 1, w]), count)
            most = np.where((alpha[j] > 0) & (j % RESCALE == 0), alpha[j], 1)
            alpha[j] /= most
            up[j] = up[j - 1] + np.log(most)
        order = np.argsort(start, kind="stable")
        bounds = np.searchsorted(start[order], np.arange(0, last + 2))
        for i in range(last - 1, -1, -1):
            s = order[bounds[i] : bounds[i + 1]]
            to, w = end[s], word[s]
            beta[i] += np.bincount(w, beta[to, w] * p[s] * np.exp(down[to, w] - down[i + 1, w]), count)
            most = np.where((beta[i] > 0) & (i % RESCALE == 0), beta[i], 1)
            beta[i] /= most
            down[i] = down[i + 1] + np.log(most)
        total = np.log(alpha[lengths, np.arange(count)]) + up[lengths, np.arange(count)]
        use = alpha[start, word] * p * beta[end, word] * np.exp(up[start, word] + down[end, word] - total[word])
        return np.bincount(piece, weights[word] * use, self.unknown + 1)


def together(words: list[str], langs: int) -> Iterator[np.ndarray]:
    """Numbers of words that are handled at once: short ones, and longer ones of like length, within ``CELLS`` cells."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    if (short := np.flatnonzero(sizes <= SHORT)).size:
        yield short
    rows = np.flatnonzero(sizes > SHORT)
    rows = rows[np.argsort(sizes[rows], kind="stable")]
    while len(rows):
        n = max(1, CELLS // (langs * (2 * int(sizes[rows[0]]) + 2)))
        n = min(n, int(np.searchsorted(sizes[rows], 2 * sizes[rows[0]], side="right")))
        yield rows[:n]
        rows = rows[n:]

"""Document quality by a linear-chain conditional random field over lines.

Lines end at byte 0x0A. A line's features are the shares of kinds of bytes, word lengths, repetition within the text and
its length; the same features of the line before and after belong to it too. Training labels each line with its
document's label. Forward-backward gives each line's probability of being good; their mean by line length feeds a
logistic function that yields the document's score.

Training is bounded: about ``PER_CLASS`` labelled documents of each class, and ``TRAIN_CHARS`` characters of each.
Chains are runs of at most ``STEPS`` lines.

Defined results: null and empty texts have one empty line and get its score; without both labels every score is the
share of label 1 (0 without labels); equal texts get equal results; extra columns pass through, and score replaces a column of that name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from . import vectortext as V
from .shared import append_columns, id_remainder, text_buffers

STEPS = 64
PER_CLASS = 1500
TRAIN_CHARS = 20_000
#: Kinds of bytes: lower case, upper case, digit, space, sentence mark, bar, shouting, quote or bracket, other mark, beyond ASCII, control.
_KINDS = 11
_KIND = np.full(256, 8, np.uint8)
for _kind, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9), b".,;:-", b"|", b"!?", b"\"'()[]", (), range(128, 256), (*range(0, 9), *range(10, 32), 127))):
    _KIND[list(_bytes)] = _kind
_FEATURES = _KINDS + 7


def _line_features(data: np.ndarray, offsets: np.ndarray):
    """Lines of each text, their lengths in bytes, and the feature matrix (lines, features)."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    # A line starts at each text's start and after each break inside a text.
    of_break = np.searchsorted(offsets, breaks, "right") - 1
    inner = breaks + 1 < offsets[of_break + 1]
    starts = np.concatenate([offsets[:-1], breaks[inner] + 1])
    text = np.concatenate([np.arange(n), of_break[inner]])
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    ends = np.append(starts[1:], offsets[-1])
    ends = np.minimum(ends, offsets[text + 1])
    ends -= (ends > starts) & (data[np.maximum(ends - 1, 0)] == 10) if len(data) else 0
    lengths = ends - starts

    kinds = np.zeros((len(starts), _KINDS))
    if len(data):
        line = np.searchsorted(starts, np.arange(0), "right")
        owner = np.zeros(len(data), np.int64)
        nonempty = np.append(starts[1:], len(data)) > starts
        np.add.at(owner, starts[nonempty][1:], np.diff(np.flatnonzero(nonempty)))
        owner[0] += np.flatnonzero(nonempty)[0]
        line = np.cumsum(owner)
        kinds = np.bincount(line * _KINDS + _KIND[data], minlength=len(starts) * _KINDS).reshape(-1, _KINDS).astype(float)
        kinds[:, 10] -= (np.append(starts[1:], len(data)) - ends > 0) & (lengths >= 0)
    size = np.maximum(lengths, 1)[:, None]
    shares = kinds.clip(0) / size

    word_starts, word_ends, _ = V.words(data, offsets)
    word_line = np.searchsorted(starts, word_starts, "right") - 1
    words = np.bincount(word_line, minlength=len(starts)).astype(float)
    mean_word = np.bincount(word_line, word_ends - word_starts, len(starts)) / np.maximum(words, 1)
    low = V.LOWER[data]
    sums = V.rolling_sums(low)
    marks = V.mix(V.span_hash(sums, word_starts, word_ends) ^ V.mix(word_line.astype(np.uint64)))
    distinct = np.bincount(word_line[np.unique(marks, return_index=True)[1]], minlength=len(starts)) / np.maximum(words, 1)
    key = V.mix(V.span_hash(sums, starts, ends) ^ V.mix(text.astype(np.uint64)))
    _, first, inverse, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    repeated = (times[inverse] > 1) & (lengths > 0)
    upper = kinds[:, 1] / np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    more = np.column_stack([upper, np.log1p(lengths) / 8, np.minimum(mean_word, 40) / 10, distinct, repeated, np.minimum(times[inverse], 20) / 20, lengths == 0])
    return np.bincount(text, minlength=n), lengths, np.column_stack([shares, more])


def _with_neighbours(counts: np.ndarray, own: np.ndarray) -> np.ndarray:
    place, last = V.ragged_arange(counts), np.repeat(counts, counts) - 1
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    after[:-1] = own[1:]
    before[place == 0] = 0
    after[place == last] = 0
    return np.column_stack([own, before, after])


class LineLabeller:
    def __init__(self) -> None:
        self.weights = np.zeros(3 * _FEATURES)
        self.bias = 0.0
        self.transition = np.zeros((2, 2))
        self.calibration = np.zeros(3)
        self.constant: float | None = 0.0
        self.shift, self.scale = np.zeros(3 * _FEATURES), np.ones(3 * _FEATURES)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Summed feature by feature, so that a line's result does not depend on its batch."""
        total = np.full(len(x), self.bias)
        for i in range(x.shape[1]):
            total += (x[:, i] - self.shift[i]) / self.scale[i] * self.weights[i]
        return total

    def line_probabilities(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        lengths, step, chain = crf.lay_out(counts, STEPS)
        odds, out = self.odds(x), np.empty(len(x))
        group = np.digitize(lengths, [3, 9, 33])
        for g in np.unique(group):
            own = group == g
            number = np.cumsum(own) - 1
            element = own[chain]
            at = (step[element], number[chain[element]])
            matrix = np.zeros((int(lengths[own].max()), int(own.sum())))
            matrix[at] = odds[element]
            out[element] = crf.marginals(matrix, lengths[own], self.transition)[at]
        return out

    @staticmethod
    def evidence(p: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        first = V.offsets_of(counts)[:-1]
        weight = lengths + 1.0
        mean = np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first)
        p = mean.clip(1e-4, 1 - 1e-4)
        return np.column_stack([np.log(p / (1 - p)), mean])

    def fit(self, texts: list[str], y: np.ndarray, rows: np.ndarray, epochs: int = 12, rate: float = 0.05, seed: int = 3) -> None:
        self.constant = float((y * rows).sum() / rows.sum()) if len(y) else 0.0
        if len(set(y.tolist())) < 2:
            return
        counts, line_lengths, own = _line_features(*text_buffers(pa.array(texts, pa.large_string())))
        x = _with_neighbours(counts, own)
        self.shift, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.shift) / self.scale
        truth_of = y[V.row_of(counts)].astype(np.int64)
        lengths, step, chain = crf.lay_out(counts, STEPS)
        order = np.argsort(chain, kind="stable")
        first = np.searchsorted(chain[order], np.arange(len(lengths) + 1))
        rng = np.random.default_rng(seed)
        w = np.zeros(z.shape[1] + 1)
        m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
        done = 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(lengths)), max(1, len(lengths) // 64)):
                done += 1
                own_lines = np.concatenate([order[first[c] : first[c + 1]] for c in part])
                at = (step[own_lines], np.repeat(np.arange(len(part)), lengths[part]))
                shape = (int(lengths[part].max()), len(part))
                matrix, truth = np.zeros(shape), np.zeros(shape, np.int64)
                matrix[at], truth[at] = z[own_lines] @ w[:-1] + w[-1], truth_of[own_lines]
                p, pairs = crf.marginals(matrix, lengths[part], self.transition, pairs=True)
                error = truth[at] - p[at]
                gradient = np.concatenate([error @ z[own_lines], [error.sum()], (crf.observed(truth, lengths[part]) - pairs).ravel()]) / len(part)
                gradient -= 1e-3 * np.concatenate([w, self.transition.ravel()])
                m += 0.1 * (gradient - m)
                v += 0.001 * (gradient**2 - v)
                move = rate * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.999**done)) + 1e-8)
                w += move[:-4]
                self.transition = self.transition + move[-4:].reshape(2, 2)
        self.weights, self.bias = w[:-1], float(w[-1])
        self.calibration = crf.fit_logistic(self.evidence(self.line_probabilities(x, counts), counts, line_lengths), y, rows)
        self.constant = None

    def score(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        counts, lengths, own = _line_features(*text_buffers(column))
        p = self.line_probabilities(_with_neighbours(counts, own), counts)
        return crf.logistic(self.evidence(p, counts, lengths), self.calibration)


def train(docs: DataFrame, labels: DataFrame, keep) -> LineLabeller:
    labeller = LineLabeller()
    labeller.fit(*crf.labelled_sample(docs, labels, "quality", keep, PER_CLASS, 29, TRAIN_CHARS))
    return labeller


def score(docs: DataFrame, labeller: LineLabeller) -> DataFrame:
    """Adds score to every row."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(labeller.score(batch.column(batch.schema.get_field_index("text"))), pa.float64())]

    return append_columns(docs, run, "score double")


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Learns outside the held-out fold and scores all rows; adds held_out."""
    fold = id_remainder("doc_id", folds)
    return score(docs, train(docs, labels, fold != held)).withColumn("held_out", fold == held)

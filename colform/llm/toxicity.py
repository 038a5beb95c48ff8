"""Toxic spans by a linear-chain conditional random field over words.

Words are runs of ASCII letters, digits and bytes beyond ASCII, with A-Z lower-cased. Labels come for documents; words
are labelled from them: a word counts as toxic if it stands in a toxic document and it, or its first 4 to 7 bytes, occur
in many different surroundings in toxic documents of the sample, or in more of these than chance explains, and in few others;
copies and near copies of a document count once on both sides. If no word does, the words that lean to toxic documents are taken. The field then learns features (the word, its beginnings and its neighbours)
and the transitions. Chains are runs of at most ``STEPS`` words; forward-backward gives each word's
probability. A document's score is a logistic function of the log of the sum of their cubes,
so that the many small ones of a long text do not add up to a toxic word.

Training is bounded: about ``PER_CLASS`` labelled documents of each class, and ``TRAIN_CHARS`` characters of each.

Defined results: null, empty and wordless texts get the score of a text without toxic words, and no spans; without both labels
every score is the share of label 1 (0 without labels); equal texts get equal results; extra columns pass through, and
score, n_spans and spans replace columns of that name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from . import vectortext as V
from .shared import append_columns, id_remainder, text_buffers

STEPS = 128
BITS = 16
PER_CLASS = 1500
TRAIN_CHARS = 6000
SPAN_AT = 0.5
#: Bytes of a word's beginnings that are features.
BEGINNINGS = (4, 5, 6, 7)
#: A word or beginning marks toxic words if it has at least this many distinct surroundings in toxic documents only, for each
#: group of them (4 at least) ...
SUPPORT = 0.02
#: ... or if its share of toxic groups is beyond chance, where at most this share of such marks is expected to come by chance
#: (Benjamini and Hochberg) ...
CHANCE = 0.05
#: ... and in both cases so many times as many, for each toxic group, as it has in others for each of those.
LIFT = 6
#: Where no word is beyond chance: the toxic documents that a word must stand in, tried in this order.
WEAK = (4, 2, 1)
#: Near copies agree on all minimum hashes of one of the bands.
BANDS, BAND_ROWS = 8, 4
#: Features that stand in at least this share of the sample (3 documents at least) have a weight.
LEARNED = 0.002
_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SALT = V.mix(np.arange(1, len(BEGINNINGS) + 4, dtype=np.uint64))
_MASK = np.uint64((1 << BITS) - 1)


def _features(data: np.ndarray, offsets: np.ndarray):
    """Word starts, ends, words before each text, and 64-bit feature rows (features, words): the word, its beginnings, its neighbours."""
    low = V.LOWER[data]
    starts, ends, before = V.words(low, offsets, _NOT_WORD)
    sums = V.rolling_sums(low)
    word = V.span_hash(sums, starts, ends)
    beginnings = [V.span_hash(sums, starts, np.minimum(starts + k, ends)) for k in BEGINNINGS]
    text = np.searchsorted(offsets, starts, "right")
    ahead, behind = np.zeros_like(word), np.zeros_like(word)
    if len(word) > 1:
        same = text[1:] == text[:-1]
        behind[1:][same] = word[:-1][same]
        ahead[:-1][same] = word[1:][same]
    rows = np.stack([word, *beginnings, behind, ahead])
    return starts, ends, before, V.mix(rows ^ _SALT[:, None])


def _groups(surroundings: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Group of each text: copies and near copies share one. ``counts`` are the words of each text."""
    group = np.arange(len(counts))
    texts = np.flatnonzero(counts)
    if not len(texts):
        return group
    first = V.offsets_of(counts)[texts]
    salts = V.mix(np.arange(101, 101 + BANDS * BAND_ROWS, dtype=np.uint64))
    bands = []
    for own in salts.reshape(BANDS, BAND_ROWS):
        key = np.zeros(len(texts), np.uint64)
        for salt in own:
            key = V.mix(key + np.minimum.reduceat(V.mix(surroundings ^ salt), first))
        bands.append(np.unique(key, return_inverse=True)[1])
    while True:
        before = group.copy()
        for band in bands:
            least = np.full(int(band.max()) + 1, len(counts))
            np.minimum.at(least, band, group[texts])
            group[texts] = least[band]
        if (group == before).all():
            return np.unique(group, return_inverse=True)[1]


def _marks(bad: np.ndarray, good: np.ndarray, toxic: int, clean: int, support: int | None) -> np.ndarray:
    """Features that mark toxic words, from the toxic and clean groups each stands in, of ``toxic`` and ``clean`` ones in all."""
    lifted = (bad > 0) & (bad * clean >= LIFT * good * toxic)
    if support is not None:
        return lifted & (bad >= support)
    n, rate = bad + good, toxic / (toxic + clean)
    share = bad / n
    # Chernoff's bound of the chance of so many toxic ones.
    with np.errstate(divide="ignore", invalid="ignore"):
        distance = np.where(bad > 0, share * np.log(share / rate), 0) + np.where(good > 0, (1 - share) * np.log((1 - share) / (1 - rate)), 0)
    chance = np.where(share > rate, np.exp(-n * distance), 1.0)
    tested = n >= WEAK[0]
    ranked = np.sort(chance[tested])
    passed = ranked[ranked <= CHANCE * np.arange(1, len(ranked) + 1) / max(len(ranked), 1)]
    return lifted & tested & (chance <= (passed[-1] if len(passed) else -1.0))


class Tagger:
    def __init__(self) -> None:
        #: One feature a cell, known by its whole hash: features that were too rare to learn have no weight.
        self.keys = np.zeros((len(_SALT), 1 << BITS), np.uint64)
        self.weights = np.zeros((len(_SALT), 1 << BITS), np.float32)
        self.bias = 0.0
        self.transition = np.zeros((2, 2))
        self.calibration = np.zeros(2)
        self.constant: float | None = 0.0

    def odds(self, features: np.ndarray) -> np.ndarray:
        total = np.full(features.shape[1], self.bias)
        for keys, table, row in zip(self.keys, self.weights, features):
            cell = (row & _MASK).astype(np.int64)
            total += np.where(keys[cell] == row, table[cell], 0)
        return total

    def word_probabilities(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        lengths, step, chain = crf.lay_out(counts, STEPS)
        if not len(lengths):
            return np.zeros(0)
        # Chains of like length share a matrix, so short texts do not pay for long ones.
        odds, out = self.odds(features), np.empty(features.shape[1])
        group = np.digitize(lengths, [9, 33, STEPS])
        for g in np.unique(group):
            own = group == g
            number = np.cumsum(own) - 1
            element = own[chain]
            matrix = np.zeros((int(lengths[own].max()), int(own.sum())))
            at = (step[element], number[chain[element]])
            matrix[at] = odds[element]
            out[element] = crf.marginals(matrix, lengths[own], self.transition)[at]
        return out

    def evidence(self, probabilities: np.ndarray, before: np.ndarray) -> np.ndarray:
        return np.log(np.diff(np.concatenate([[0.0], np.cumsum(probabilities**3)])[before]).clip(0) + 1e-2)[:, None]

    def _learn_features(self, features: np.ndarray, text: np.ndarray, side: np.ndarray, toxic: int, clean: int, support: int | None) -> np.ndarray:
        """Chooses the features that get weights; returns the words that marks make toxic. ``side``: twice a text's group, odd if toxic."""
        marked = np.zeros(features.shape[1], bool)
        for i, row in enumerate(features):
            known, number = np.unique(row, return_inverse=True)
            documents = np.bincount(np.unique(text.astype(np.int64) * len(known) + number) % len(known), minlength=len(known))
            seen = np.unique(side[text].astype(np.int64) * len(known) + number)
            inside, is_toxic = seen % len(known), (seen // len(known)) & 1
            bad = np.bincount(inside, is_toxic, len(known))
            good = np.bincount(inside, 1 - is_toxic, len(known))
            learned = documents >= max(3, LEARNED * len(side))
            if i <= len(BEGINNINGS):
                marks = _marks(bad, good, toxic, clean, support)
                if support is None:
                    _, first, place = np.unique(V.mix(row + V.mix(features[-2] * np.uint64(3) + features[-1])), return_index=True, return_inverse=True)
                    shared = np.bincount(place, side[text] % 2 == 0) > 0
                    only = np.bincount(number[first], ~shared, len(known))
                    others = np.bincount(number[first], shared, len(known))
                    marks |= (only >= max(WEAK[0], SUPPORT * toxic)) & (only * clean >= LIFT * others * toxic)
                marked |= marks[number]
                learned |= marks
            often = np.flatnonzero(learned)
            often = often[np.argsort(documents[often], kind="stable")]
            self.keys[i] = 0
            self.keys[i][(known[often] & _MASK).astype(np.int64)] = known[often]
        return marked

    def fit(self, texts: list[str], y: np.ndarray, rows: np.ndarray, epochs: int = 4, rate: float = 0.3, seed: int = 5) -> None:
        self.constant = float((y * rows).sum() / rows.sum()) if len(y) else 0.0
        if len(set(y.tolist())) < 2:
            return
        data, offsets = text_buffers(pa.array(texts, pa.large_string()))
        _, _, before, features = _features(data, offsets)
        counts = np.diff(before)
        text = V.row_of(counts)
        group = _groups(V.mix(features[0] + V.mix(features[-2] * np.uint64(3) + features[-1])), counts)
        # Each side counts a group once, however many copies it has.
        toxic, clean = len(np.unique(group[y > 0])), len(np.unique(group[y == 0]))
        side = 2 * group + (y > 0)
        for support in (None, *WEAK):
            marked = self._learn_features(features, text, side, toxic, clean, support) & (y[text] > 0)
            if marked.any():
                break
        else:
            # No word leans to toxic documents: all their words are taken.
            marked = y[text] > 0
        if not marked.any():
            return
        lengths, step, chain = crf.lay_out(counts, STEPS)
        rng = np.random.default_rng(seed)
        order = np.argsort(chain, kind="stable")
        first = np.searchsorted(chain[order], np.arange(len(lengths) + 1))
        squares = np.full(self.weights.shape, 1e-6, np.float32)
        bias_square, transition_square = 1e-6, np.full((2, 2), 1e-6)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(lengths)), max(1, len(lengths) // 256)):
                own = np.concatenate([order[first[c] : first[c + 1]] for c in part])
                number = np.repeat(np.arange(len(part)), lengths[part])
                at = (step[own], number)
                matrix = np.zeros((STEPS, len(part)))
                truth = np.zeros((STEPS, len(part)), np.int64)
                matrix[at], truth[at] = self.odds(features[:, own]), marked[own]
                p, pairs = crf.marginals(matrix, lengths[part], self.transition, pairs=True)
                error = (truth[at] - p[at]).astype(np.float64)
                for keys, table, square, row in zip(self.keys, self.weights, squares, features[:, own]):
                    index = (row & _MASK).astype(np.int64)
                    hit = keys[index] == row
                    cells, inverse = np.unique(index[hit], return_inverse=True)
                    gradient = np.bincount(inverse, error[hit], len(cells))
                    square[cells] += (gradient * gradient).astype(np.float32)
                    table[cells] += (rate * gradient / np.sqrt(square[cells])).astype(np.float32)
                bias_square += error.sum() ** 2
                self.bias += rate * error.sum() / np.sqrt(bias_square)
                gradient = crf.observed(truth, lengths[part]) - pairs
                transition_square += gradient**2
                self.transition = self.transition + rate * gradient / np.sqrt(transition_square)
        self.calibration = crf.fit_logistic(self.evidence(self.word_probabilities(features, counts), before), y, rows)
        self.constant = None

    def score(self, column: pa.Array):
        """Scores, and the spans of each text as (text, start byte, end byte) arrays."""
        data, offsets = text_buffers(column)
        n = len(column)
        if self.constant is not None:
            none = np.zeros(0, np.int64)
            return np.full(n, self.constant), (none, none, none)
        starts, ends, before, features = _features(data, offsets)
        p = self.word_probabilities(features, np.diff(before))
        hot = np.flatnonzero(p >= SPAN_AT)
        text = np.searchsorted(offsets, starts[hot], "right") - 1
        opens = np.ones(len(hot), bool)
        opens[1:] = (np.diff(hot) > 1) | (np.diff(text) > 0)
        opening = np.flatnonzero(opens)
        closing = np.append(opening[1:], len(hot)) - 1 if len(hot) else opening
        base = offsets[text[opening]]
        return crf.logistic(self.evidence(p, before), self.calibration), (text[opening], starts[hot[opening]] - base, ends[hot[closing]] - base)


def train(docs: DataFrame, labels: DataFrame, keep) -> Tagger:
    tagger = Tagger()
    tagger.fit(*crf.labelled_sample(docs, labels, "toxic", keep, PER_CLASS, 23, TRAIN_CHARS))
    return tagger


def tag(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """Adds score, n_spans and spans (byte offsets of the UTF-8 text) to every row."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        score, (text, start, end) = tagger.score(batch.column(batch.schema.get_field_index("text")))
        counts = np.bincount(text, minlength=batch.num_rows)
        pairs = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(V.offsets_of(counts), pa.int32()), pairs)
        return [pa.array(score, pa.float64()), pa.array(counts, pa.int32()), spans]

    return append_columns(docs, run, "score double, n_spans int, spans array<struct<start:bigint,end:bigint>>")


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learns outside the held-out fold and tags all rows; adds held_out."""
    fold = id_remainder("doc_id", folds)
    return tag(docs, train(docs, labels, fold != held)).withColumn("held_out", fold == held)

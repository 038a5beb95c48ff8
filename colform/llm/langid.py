"""Language identification by a byte convolutional network, trained and applied in numpy.

Every text is cut into windows of ``WINDOW`` bytes. Filters of several widths slide over embedded bytes, each filter's
largest value in the window (and at least 0) feeds a softmax over the languages. A text's log probabilities are the mean
of its windows' ones by their bytes, so whole texts count, whatever their length. Filters are applied by
adding rows of tables that hold each filter's response to a byte pair.

Training is bounded: about ``PER_LANGUAGE`` texts of each of the at most ``MAX_LANGUAGES`` most frequent languages, drawn by a
hash of the id, and ``WINDOWS_A_TEXT`` windows of each. Only text and language are learned from.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text if nothing could be learned;
equal texts get equal results; an empty table gives no rows; extra columns pass through and lang_pred and score replace columns of that name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectortext as V
from .shared import append_columns, hash_share, id_remainder, sample_rate, text_buffers

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
PER_LANGUAGE = 1500
WINDOWS_A_TEXT = 3
MAX_LANGUAGES = 256
UNDETERMINED = "und"


class ByteNet:
    """Embedding, filters of each width, and the softmax layer."""

    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.filters = [rng.normal(0, 0.4 / np.sqrt(w), (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = np.zeros((len(WIDTHS) * FILTERS, classes), np.float32)
        self.out_bias = np.zeros(classes, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.bias, self.out, self.out_bias]

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """For each width, (offset, response to the byte pair or single byte there)."""
        tables = []
        for filters in self.filters:
            rows = [self.embedding @ f for f in filters]
            parts = []
            for k in range(0, len(rows) - 1, 2):
                parts.append((k, (rows[k][:, None, :] + rows[k + 1][None, :, :]).reshape(-1, FILTERS)))
            if len(rows) % 2:
                parts.append((len(rows) - 1, rows[-1]))
            # A window position that starts at a zero byte lies behind the text: it never is the largest.
            parts[0][1][:256] = -1e9
            tables.append(parts)
        return tables

    @staticmethod
    def responses(tables, windows: np.ndarray, pairs: np.ndarray, n: int) -> list[np.ndarray]:
        out = []
        for parts in tables:
            total = None
            for offset, table in parts:
                index = (pairs if len(table) > 256 else windows)[offset : offset + n]
                rows = table[index]
                total = rows if total is None else total + rows
            out.append(total)
        return out

    def log_probabilities(self, tables, flat: np.ndarray, n_windows: int) -> np.ndarray:
        """Of each window of a flat array of n_windows * WINDOW bytes and at least 4 zeros."""
        pairs = flat[:-1].astype(np.uint16) * np.uint16(256) + flat[1:]
        pooled = np.zeros((n_windows, len(self.bias)), np.float32)
        step = 512  # windows at once: keeps the responses within the cache
        for at in range(0, n_windows, step):
            end = min(at + step, n_windows)
            low, n = at * WINDOW, (end - at) * WINDOW
            parts = self.responses(tables, flat[low:], pairs[low:], n)
            pooled[at:end] = np.concatenate([p.reshape(-1, WINDOW, FILTERS).max(axis=1) for p in parts], axis=1)
        hidden = np.maximum(pooled + self.bias, 0)
        # Summed row by row, so that a window's result does not depend on its batch.
        logits = (hidden[:, :, None] * self.out[None]).sum(axis=1) + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = 450, batch: int = 64, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on the cross entropy; windows are (n, WINDOW) bytes, zero behind a text."""
        rng = np.random.default_rng(seed)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        by_class = [np.flatnonzero(labels == c) for c in range(self.out.shape[1])]
        for step in range(1, steps + 1):
            pick = np.array([rng.choice(by_class[c]) for c in rng.integers(0, len(by_class), batch)])
            x = np.pad(windows[pick], ((0, 0), (0, max(WIDTHS))))
            embedded = self.embedding[x]
            pooled, places = [], []
            for filters in self.filters:
                w = len(filters)
                grams = np.concatenate([embedded[:, k : k + WINDOW] for k in range(w)], axis=2)
                response = grams @ filters.reshape(-1, FILTERS)
                response[x[:, :WINDOW] == 0] = -1e9
                place = response.argmax(axis=1)
                places.append(place)
                pooled.append(np.take_along_axis(response, place[:, None, :], 1)[:, 0])
            hidden = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
            logits = hidden @ self.out + self.out_bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(batch), labels[pick]] -= 1
            p /= batch
            back = (p @ self.out.T) * (hidden > 0)
            gradients = [np.zeros_like(self.embedding)]
            for i, filters in enumerate(self.filters):
                own, place = back[:, i * FILTERS : (i + 1) * FILTERS], places[i]
                gradient = np.zeros_like(filters)
                for k in range(len(filters)):
                    at = x[np.arange(batch)[:, None], place + k]
                    gradient[k] = np.einsum("if,ifd->df", own, self.embedding[at])
                    np.add.at(gradients[0], at, own[:, :, None] * filters[k].T[None])
                gradients.append(gradient)
            gradients += [back.sum(0), hidden.T @ p, p.sum(0)]
            for value, gradient, (m, v) in zip(self.parameters(), gradients, moments):
                m += 0.1 * (gradient - m)
                v += 0.001 * (gradient * gradient - v)
                value -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def _windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as zero-padded windows in one flat array, and the windows of each; 3 zeros at least follow a text."""
    lengths = np.diff(offsets)
    counts = np.where(lengths > 0, -(-(lengths + max(WIDTHS) - 1) // WINDOW), 0)
    starts = V.offsets_of(counts) * WINDOW
    flat = np.zeros(int(starts[-1]) + 8, np.uint8)
    flat[V.ragged_take(starts[:-1], lengths)] = data
    return flat, counts


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a text has a Unicode letter; decoded only where it has no ASCII letter but bytes beyond ASCII."""
    n = len(offsets) - 1
    count = lambda mask: np.diff(V.offsets_of(mask.astype(np.int64))[offsets])
    found = count(_LETTER[data]) > 0
    for i in np.flatnonzero(~found & (count(data >= 128) > 0)):
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found if n else np.zeros(0, bool)


def train(labelled: DataFrame) -> tuple[list[str], ByteNet | None]:
    """Learns from (doc_id, text, lang); collects a bounded sample of windows to the driver."""
    usable = labelled.where("lang is not null and text is not null and text <> ''")
    counts = usable.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return [], None
    rates = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], sample_rate(PER_LANGUAGE, r["count"]))])
    drawn = usable.where(hash_share("doc_id", 11) < F.coalesce(F.element_at(rates, F.col("lang")), F.lit(0)))
    place = F.pmod(F.xxhash64(F.lit(3), F.col("doc_id"), F.col("k")), F.greatest(F.char_length("text") - WINDOW // 2, F.lit(1)))
    cut = drawn.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(WINDOWS_A_TEXT)))).select("lang", F.substring(F.col("text"), (place + 1).cast("int"), F.lit(WINDOW)).alias("w"), "doc_id", "k")
    rows = cut.orderBy("lang", "doc_id", "k", "w").toArrow()
    languages = sorted(r["lang"] for r in counts)
    raw = [w.encode()[:WINDOW] for w in rows["w"].to_pylist()]
    windows = np.zeros((len(raw), WINDOW), np.uint8)
    for i, w in enumerate(raw):
        windows[i, : len(w)] = np.frombuffer(w, np.uint8)
    known = {x: i for i, x in enumerate(languages)}
    labels = np.array([known[x] for x in rows["lang"].to_pylist()], np.int64)
    present = sorted(set(labels.tolist()))
    if not present:
        return [], None
    languages = [languages[c] for c in present]
    net = ByteNet(len(present))
    net.fit(windows, np.searchsorted(present, labels))
    return languages, net


def predict(docs: DataFrame, languages: list[str], net: ByteNet | None) -> DataFrame:
    """Adds lang_pred and score to every row that has a text."""

    state: dict = {}

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        n = batch.num_rows
        best, score = np.full(n, -1), np.zeros(n)
        if net is not None:
            if "tables" not in state:
                state["tables"] = net.tables()
            data, offsets = text_buffers(batch.column(batch.schema.get_field_index("text")))
            letters = _has_letter(data, offsets)
            flat, counts = _windows(data, offsets)
            logs = net.log_probabilities(state["tables"], flat, int(counts.sum())).astype(np.float64)
            lengths = np.diff(offsets)
            row = V.row_of(counts)
            share = np.clip(lengths[row] - V.ragged_arange(counts) * WINDOW, 0, WINDOW).astype(np.float64)
            full = np.flatnonzero(counts)
            if len(full):
                means = np.zeros((n, len(languages)))
                means[full] = np.add.reduceat(logs * share[:, None], V.offsets_of(counts)[full]) / lengths[full, None]
                p = np.exp(means - means.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                sure = letters & (counts > 0)
                best[sure], score[sure] = p[sure].argmax(axis=1), p[sure].max(axis=1)
        names = np.array([*languages, UNDETERMINED], object)
        return [pa.array(names[best], pa.string()), pa.array(score, pa.float64())]

    return append_columns(docs, run, "lang_pred string, score double", max_bytes=1 << 19)


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learns from the texts outside the held-out fold and predicts all; adds held_out, lang_pred and score."""
    fold = id_remainder("doc_id", folds)
    languages, net = train(docs.where(fold != 0).select("doc_id", "text", "lang"))
    return predict(docs, languages, net).withColumn("held_out", fold == 0)

"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text is cut into words before every space that follows another character; no piece of a model that this module
accepts crosses such a cut, so words can be encoded apart, and each distinct word once. Rounds work on one flat array of
the symbols of many words: look up the rank of every neighbouring pair, find each word's smallest rank (a segmented
minimum), merge its leftmost pair of that rank, compact, and go on with the words that have a pair left. All
pairs of that rank in a word merge at once where the new piece cannot take part in a pair of the same or a better rank, which
gives what one by one would give. Characters that are no piece become their UTF-8 bytes' pieces.

Defined results: null is an empty text, which has only the begin and end ids; equal texts get equal results; an empty table gives
no rows; extra columns pass through, and n_tokens, ids_sha256 and decoded_sha256 replace columns of that name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import vectortext as V
from .shared import append_columns, text_buffers
from .wordcache import WordCache

_SPACE = "▁"
_NONE = np.int64(1) << 40


class PieceModel:
    """Pieces, pair ranks and byte pieces of a model file, as arrays of bounded size."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for i in range(n)]
        if any(normal[i] and _SPACE in p.lstrip(_SPACE) for i, p in enumerate(pieces)):
            raise ValueError("a piece crosses a word cut")
        symbols = {p: i for i, p in enumerate(pieces) if normal[i]}
        for c in sorted({c for p in symbols for c in p} - set(symbols)):
            symbols[c] = len(symbols) + n
        self.size = max([*symbols.values(), n]) + 1
        self.vocabulary = n
        self.symbol_of_char = np.full(0x110000, -1, np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                self.symbol_of_char[ord(p)] = i
        self.symbol_of_char[ord(" ")] = self.symbol_of_char[ord(_SPACE)]
        self.byte_piece = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        scores = {i: sp.get_score(i) for i in range(n)}
        ranks = {s: r for r, s in enumerate(sorted({scores[i] for i in range(n) if normal[i]}, reverse=True))}
        left, right, merged = [], [], []
        for p, i in symbols.items():
            if i < n and len(p) > 1:
                for k in range(1, len(p)):
                    if p[:k] in symbols and p[k:] in symbols:
                        left.append(symbols[p[:k]]), right.append(symbols[p[k:]]), merged.append(i)
        rank = np.array([ranks[scores[m]] for m in merged], np.int64)
        self.worst = int(rank.max(initial=-1))
        left, right, merged = (np.array(x, np.int64) for x in (left, right, merged))
        best = np.full(self.size, _NONE)
        np.minimum.at(best, left, rank)
        np.minimum.at(best, right, rank)
        self.piece_rank = np.full(self.size, _NONE)
        self.piece_rank[merged] = rank
        #: Pieces whose merge cannot open a pair of the same or a better rank.
        self.together = best > self.piece_rank
        self._table(left * self.size + right, merged)
        self.bytes_of, self.byte_lengths = self._texts(pieces, normal, sp)
        del sp

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing over four slots a key."""
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size + 64, -1, np.int64), np.full(size + 64, -1, np.int32)
        for k, v, h in zip(keys.tolist(), values.tolist(), self._slot(keys).tolist()):
            while self.keys[h] >= 0:
                h += 1
            self.keys[h], self.values[h] = k, v

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that each pair makes, -1 for none."""
        keys = left.astype(np.int64) * self.size + right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] += 1
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def _texts(self, pieces, normal, sp) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Bytes that each id decodes to; begin, end and other control ids to nothing."""
        texts = []
        for i, p in enumerate(pieces):
            if normal[i]:
                texts.append(p.replace(_SPACE, " ").encode())
            elif sp.is_byte(i):
                texts.append(bytes([int(p[3:5], 16)]))
            elif sp.is_unknown(i):
                texts.append(" ⁇ ".encode())
            else:
                texts.append(b"")
        lengths = np.array([len(t) for t in texts], np.int64)
        return (np.frombuffer(b"".join(texts), np.uint8), V.offsets_of(lengths)[:-1]), lengths

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each word."""
        flat = data[V.ragged_take(starts, ends - starts)]
        leads = (flat & 0xC0) != 0x80
        chars = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        word_of_byte = V.row_of(ends - starts)
        word = word_of_byte[leads]
        if len(word) != len(chars):
            raise ValueError("text is not valid UTF-8")
        known = self.symbol_of_char[chars]
        # An unknown character is kept as a negative number that no pair has.
        symbol = np.where(known >= 0, known, -2 - chars.astype(np.int64)).astype(np.int64)
        done_symbol, done_word, done_place = [], [], []
        place = np.arange(len(symbol), dtype=np.int64)
        while len(symbol) > 1:
            pair = np.full(len(symbol), -1, np.int64)
            inside = word[1:] == word[:-1]
            pair[:-1] = np.where(inside, self.merged(symbol[:-1], symbol[1:]), -1)
            rank = np.where(pair >= 0, self.piece_rank[pair], _NONE)
            first = np.flatnonzero(np.concatenate([[True], ~inside]))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(symbol)))
            live = least < _NONE
            tied = live & (least == self.worst) & (sizes > 64)
            if tied.any():  # long words whose pairs all have the last rank: one scan gives what rounds would give
                for w in np.flatnonzero(tied):
                    a, b = first[w], first[w] + sizes[w]
                    done = self._scan(symbol[a:b].tolist())
                    done_symbol.append(np.array(done)), done_word.append(np.full(len(done), word[a])), done_place.append(place[a] + np.arange(len(done)))
            finished = np.repeat(~live, sizes)
            if finished.any():
                done_symbol.append(symbol[finished]), done_word.append(word[finished]), done_place.append(place[finished])
            if not live.any():
                symbol = symbol[:0]
                break
            hit = (rank == np.repeat(least, sizes)) & (pair >= 0) & np.repeat(live & ~tied, sizes)
            at = np.flatnonzero(hit)
            if len(at):
                # Leftmost of the word, or all where that gives the same; of overlapping ones every second.
                head = np.ones(len(at), bool)
                head[1:] = word[at[1:]] != word[at[:-1]]
                at = at[head | self.together[pair[at]]]
                run = np.ones(len(at), bool)
                run[1:] = np.diff(at) > 1
                run_start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
                symbol[at] = pair[at]
            keep = np.repeat(live & ~tied, sizes)
            keep[at + 1] = False
            symbol, word, place = symbol[keep], word[keep], place[keep]
        if len(symbol):
            done_symbol.append(symbol), done_word.append(word), done_place.append(place)
        if not done_symbol:
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        symbol, word, place = (np.concatenate(x) for x in (done_symbol, done_word, done_place))
        order = np.argsort(place, kind="stable")
        return self._with_bytes(symbol[order], word[order], len(starts))

    def _scan(self, symbols: list[int]) -> list[int]:
        """Merges leftmost first where all pairs have one rank."""
        if not hasattr(self, "pairs"):
            used = self.keys >= 0
            self.pairs = dict(zip(self.keys[used].tolist(), self.values[used].tolist()))
        stack: list[int] = []
        for s in symbols:
            stack.append(s)
            while len(stack) > 1 and stack[-1] >= 0 and stack[-2] >= 0 and (m := self.pairs.get(stack[-2] * self.size + stack[-1])) is not None:
                stack[-2:] = [m]
        return stack

    def _with_bytes(self, symbol: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the symbols; characters outside the vocabulary become their bytes' pieces."""
        odd = np.flatnonzero((symbol < 0) | (symbol >= self.vocabulary))
        if not len(odd):
            return symbol.astype(np.int32), np.bincount(word, minlength=n)
        char_of = np.full(self.size, 0, np.int64)
        own = np.flatnonzero(self.symbol_of_char >= self.vocabulary)
        char_of[self.symbol_of_char[own]] = own
        chars = np.where(symbol[odd] < 0, -2 - symbol[odd], char_of[np.maximum(symbol[odd], 0)])
        lengths = np.ones(len(symbol), np.int64)
        raw = [chr(c).encode() for c in chars.tolist()]
        lengths[odd] = [len(r) for r in raw]
        out = np.repeat(symbol, lengths)
        starts = V.offsets_of(lengths)[:-1]
        out[V.ragged_take(starts[odd], lengths[odd])] = self.byte_piece[np.frombuffer(b"".join(raw), np.uint8)]
        return out.astype(np.int32), np.bincount(word, lengths, n).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Text of each run of ids: the first space of the first piece goes, as the encoder puts it there."""
        (pool, starts), lengths = self.bytes_of, self.byte_lengths
        flat = pool[V.ragged_take(starts[ids], lengths[ids])]
        sizes = np.diff(np.concatenate([[0], np.cumsum(lengths[ids])])[V.offsets_of(counts)])
        offsets = V.offsets_of(sizes)
        raw, out = flat.tobytes(), []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            text = raw[a:b]
            out.append(text[1:] if text[:1] == b" " else text)
        return out


class PieceEncoder:
    def __init__(self, model: PieceModel):
        self.model, self.cache = model, WordCache(model.encode_words)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with begin and end ids, and the number of each text's ids."""
        data, offsets = text_buffers(column)
        lengths = np.diff(offsets)
        full = lengths > 0
        padded = lengths + full
        at = V.offsets_of(padded)
        text = np.full(int(at[-1]), 0x20, np.uint8)
        text[V.ragged_take((at[:-1] + full), lengths)] = data
        # A word starts at a text's start and at each space behind a character that is no space.
        space = text == 0x20
        space3 = np.zeros(len(text) + 3, bool)
        if len(text) > 2:
            space3[3 : len(text) + 1] = (text[:-2] == 0xE2) & (text[1:-1] == 0x96) & (text[2:] == 0x81)
        opens = space.copy()
        opens[1:] &= ~space[:-1] & ~space3[1 : len(text)]
        opens[at[:-1][full]] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(text)) if len(starts) else starts
        ids, counts = self.cache.ids_of(text, starts, ends)
        before = np.searchsorted(starts, at)
        inner = np.diff(V.offsets_of(counts)[before])
        out = np.empty(int(inner.sum()) + 2 * len(lengths), np.int32)
        first = V.offsets_of(inner + 2)
        out[first[:-1]] = self.model.begin
        out[first[1:] - 1] = self.model.end
        out[V.ragged_take(first[:-1] + 1, inner)] = ids
        return out, inner + 2


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder_of(path: str) -> PieceEncoder:
    """The encoder of this worker process: its known words serve all tasks that run there."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(PieceModel(path))
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 of every text."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        encoder = encoder_of(model_path)
        ids, counts = encoder.encode(batch.column(batch.schema.get_field_index("text")))
        raw, ends = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(counts)]) * 4
        digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        texts = [hashlib.sha256(t).hexdigest() for t in encoder.model.decode(ids, counts)]
        return [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]

    return append_columns(docs, run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", max_bytes=1 << 19)

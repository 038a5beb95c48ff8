"""Token id files: canonical length-limited Huffman codes, decoded by tables in independent blocks.

File format (a folder written by Spark):

* ``codebook``: one row, ``lengths``: one byte for each id, its code length in bits (0: the id does not occur). Codes are
  canonical: counted up in order of (length, id). No code is longer than ``MAX_BITS``.
* ``blocks``: one row a block of whole documents, in ascending (part, block): ``before`` the ids ahead of the block in its part,
  ``doc_ids`` int64 and ``doc_lengths`` uint32 of its documents, ``n_ids``, ``checkpoints`` the bit offset (uint32) of every
  ``EVERY``-th id, ``bits`` the codes, most significant bit first.
* ``parts``: one row a part: ``start``, the ids of all parts before it.

A block needs only the codebook to be read, and each checkpoint of it can be decoded apart: the decoder
takes one step of all checkpoints at a time, looking the next ``MAX_BITS`` bits up in a table of id and length.

Encoding runs the tokenizers library once for each distinct piece of text between the cuts of its own splitting rule;
the cuts are found on flat arrays, with the kind of each character asked of the library. Texts are cut at the file's
added tokens first, as the library does, so that a literal ``<|endoftext|>`` gets its own id.

Defined results: null is an empty text, which has only the end id; documents without doc_id come first; repeated ids are
ordered by text; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectortext as V
from .shared import Workspace, slices, text_buffers
from .wordcache import WordCache

MAX_BITS = 20
EVERY = 128
BLOCK_IDS = 1 << 17
END_ID = 0


# --- Encoding texts -------------------------------------------------------------------------------------------

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4


class TextEncoder:
    """Ids of texts as the library's byte-level tokenizer gives them without adding special tokens.

    Added tokens that stand in a text get their own ids, as there. Malformed UTF-8 raises.
    """

    def __init__(self, path: str):
        # Tasks run side by side already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        if any(t.single_word or t.lstrip or t.rstrip or (t.normalized and self.tokenizer.normalizer is not None) for t in added):
            raise ValueError("added tokens that depend on the text around them are not supported")
        # The leftmost and there the longest counts.
        contents = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, contents))) if contents else None
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.vocabulary = self.tokenizer.get_vocab_size()
        (self.line_break,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.kind = np.zeros(0x110000, np.int8)
        self.cache = WordCache(self._encode)

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that surely hold no white space but a leading space go in lines of many, cut apart again at the line breaks' id."""
        size = ends - starts
        # White space beyond ASCII starts with one of these bytes.
        doubtful = np.concatenate([[0], np.cumsum((data <= 0x20) | (data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))])
        inner = doubtful[ends] - doubtful[starts] - (data[starts] == 0x20)
        plain, odd = np.flatnonzero((inner == 0) & (size > 0)), np.flatnonzero(inner != 0)
        lengths = np.zeros(len(starts), np.int64)
        found = []
        for group in np.array_split(plain, max(1, len(plain) // 20_000)):
            lines = self._lines(data, starts[group], ends[group])
            flat = np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)] or [np.zeros(0, np.int32)])
            stops = np.flatnonzero(flat == self.line_break)
            if len(stops) != len(group):
                raise ValueError("a line break was merged")
            counts = np.diff(stops, prepend=-1) - 1
            lengths[group] = counts
            found.append((group, counts, np.delete(flat, stops)))
        for group in np.array_split(odd, max(1, len(odd) // 5000)):
            words = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[group].tolist(), ends[group].tolist())]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            lengths[group] = counts
            found.append((group, counts, np.fromiter((i for e in ids for i in e), np.int32, int(counts.sum()))))
        first = V.offsets_of(lengths)
        out = np.empty(int(first[-1]), np.int32)
        for group, counts, flat in found:
            out[V.ragged_take(first[group], counts)] = flat
        return out, lengths

    @staticmethod
    def _lines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: int = 500) -> list[str]:
        size = ends - starts + 1
        at = V.offsets_of(size)
        text = np.full(int(at[-1]), 10, np.uint8)
        text[V.ragged_take(at[:-1], size - 1)] = data[V.ragged_take(starts, size - 1)]
        cuts = at[::pieces].tolist()
        raw = text.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, [*cuts[1:], len(raw)])] if len(starts) else []

    def _kinds(self, chars: np.ndarray) -> np.ndarray:
        """Kind of each character, asked of the library the first time."""
        kinds = self.kind[chars]
        for c in np.unique(chars[kinds == 0]).tolist():
            x = chr(c)
            if len(self.split("a" + x)) == 1:
                k = _LETTER
            elif len(self.split("1" + x)) == 1:
                k = _NUMBER
            elif len(self.split("!" + x)) == 1:
                k = _OTHER
            else:
                k = _SPACE
            self.kind[c] = k
        return self.kind[chars] if (kinds == 0).any() else kinds

    def _cuts(self, chars: np.ndarray, opening: np.ndarray) -> np.ndarray:
        """Where a piece starts. ``opening`` marks the first character of each text."""
        n = len(chars)
        kind = self._kinds(chars)
        start = opening.copy()
        start[1:] |= kind[1:] != kind[:-1]
        # The last white space before other text starts a piece; if it is a space, that piece takes the text in.
        behind = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~opening[1:])
        start[behind] = True
        start[behind + 1] = chars[behind] != 0x20
        # Contractions: an apostrophe that starts a piece and stands alone among its kind.
        padded = np.concatenate([chars, [0, 0, 0]])
        limit = np.concatenate([opening, [True, True, True]])
        a = np.flatnonzero((chars == 0x27) & start)
        one, two = padded[a + 1], padded[a + 2]
        here, there = ~limit[a + 1], ~limit[a + 1] & ~limit[a + 2]
        single = here & np.isin(one, [ord(c) for c in "stmd"])
        double = there & ~single & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for found, size in ((a[single], 2), (a[double], 3)):
            start[found + 1] = False
            if size == 3:
                start[found + 2] = False
            after = found + size
            after = after[after < n]
            # White space after it has been treated above; only a letter goes on without a cut there.
            more = after[kind[after] == _LETTER]
            start[more] = True
        return start

    def _added(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends, in bytes, of the added tokens inside the texts."""
        if self.added is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = offsets.tolist()
        found = np.array([m.span() for a, b in zip(at, at[1:]) for m in self.added.finditer(data, a, b)], np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    def encode(self, column: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id behind it, and the number of each text's ids."""
        data, offsets = text_buffers(column)
        lengths = np.diff(offsets)
        raw = data.tobytes()
        chars = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        leads = np.flatnonzero((data & 0xC0) != 0x80)
        if len(leads) != len(chars):
            raise ValueError("text is not valid UTF-8")
        opening = np.zeros(len(data) + 1, bool)
        opening[offsets[:-1]] = True
        if len(chars):
            # An added token is a piece, and what stands before and behind it is split like texts of their own.
            tokens, behind = self._added(raw, offsets)
            opening[tokens] = opening[behind] = True
            cuts = self._cuts(chars, opening[leads])
            size = behind - tokens - 1
            covered = np.zeros(len(data), bool)
            covered[np.repeat(tokens + 1, size) + V.ragged_arange(size)] = True
            starts = leads[cuts & ~covered[leads]]
            ends = np.append(starts[1:], len(data))
            ids, counts = self.cache.ids_of(data, starts, ends)
            before = np.searchsorted(starts, offsets)
            inner = np.diff(V.offsets_of(counts)[before])
        else:
            ids, inner = np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
        first = V.offsets_of(inner + 1)
        out = np.full(int(first[-1]), end_id, np.int32)
        out[V.ragged_take(first[:-1], inner)] = ids
        return out, inner + 1


_ENCODERS: dict[str, TextEncoder] = {}


def encoder_of(path: str) -> TextEncoder:
    """The encoder of this worker process: its known pieces serve all tasks that run there."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


# --- Codes ----------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << max_bits:
        raise ValueError("too many ids for the longest code")
    if len(used) < 2:
        out[used] = 1
        return out
    used = used[np.lexsort((used, counts[used]))]
    weights = counts[used].astype(np.int64)
    level, packaged = weights, []
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        joined = np.concatenate([weights, pairs])
        order = np.argsort(joined, kind="stable")
        packaged.append(order >= len(weights))
        level = joined[order]
    lengths = np.zeros(len(used), np.int64)
    take = 2 * len(used) - 2
    for is_package in reversed(packaged):
        packages = int(is_package[:take].sum())
        lengths[: take - packages] += 1
        take = 2 * packages
    lengths[:take] += 1
    out[used] = lengths
    return out


class Codebook:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        sizes = self.lengths[order]
        self.codes = np.zeros(len(lengths), np.uint64)
        # A code starts where the one before ends, counted in units of the longest length.
        span = np.left_shift(1, MAX_BITS - sizes)
        start = np.cumsum(span) - span
        self.codes[order] = (start >> (MAX_BITS - sizes)).astype(np.uint64)
        self.next_id, self.next_length = np.zeros(1 << MAX_BITS, np.int32), np.zeros(1 << MAX_BITS, np.uint8)
        filled = int(span.sum())
        self.next_id[:filled] = np.repeat(order, span)
        self.next_length[:filled] = np.repeat(sizes, span)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits of the ids, and the bit offset of every ``EVERY``-th."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        at = ends - sizes
        total = int(ends[-1]) if len(ends) else 0
        words = np.zeros(total // 64 + 2, np.uint64)
        if len(ids):
            code, inside = self.codes[ids], at & 63
            over = inside + sizes - 64
            part = np.where(over > 0, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
            word = at >> 6
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            words[word[first]] = np.add.reduceat(part, first)
            split = np.flatnonzero(over > 0)
            words[word[split] + 1] |= code[split] << (64 - over[split]).astype(np.uint64)
        return words.astype(">u8").tobytes()[: -(-total // 8)], at[::EVERY].astype("<u4")

    def unpack(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ids of a block, one step of all checkpoints at a time."""
        raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
        ahead = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at = checkpoints.astype(np.int64)
        out = np.zeros((len(at), EVERY), np.int32)
        whole = n // EVERY
        for step in range(EVERY):
            if step == n - whole * EVERY:
                at = at[:whole]
            if not len(at):
                break
            window = (ahead[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - MAX_BITS)
            out[: len(at), step] = self.next_id[window]
            at = at + self.next_length[window]
        return out.ravel()[:n]


# --- Files ----------------------------------------------------------------------------------------------------

_IDS = "kind int, part long, block long, before long, first_doc long, n_ids long, doc_ids binary, doc_lengths binary, ids binary"
_IDS_ARROW = pa.schema([("kind", pa.int32()), *[(c, pa.int64()) for c in ("part", "block", "before", "first_doc", "n_ids")], *[(c, pa.binary()) for c in ("doc_ids", "doc_lengths", "ids")]])
_NULL_ID = -(2**63)


def _tokenise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        narrow = np.uint16 if encoder.vocabulary <= 1 << 16 else np.uint32
        part, block, before = TaskContext.get().partitionId(), 0, 0
        counts = np.zeros(encoder.vocabulary, np.int64)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        first = None

        def flush():
            nonlocal block, before, held
            docs, lengths, ids = (np.concatenate(x) for x in zip(*held))
            row = {"kind": 0, "part": part, "block": block, "before": before, "first_doc": int(docs[0]), "n_ids": len(ids), "doc_ids": docs.tobytes(), "doc_lengths": lengths.astype("<u4").tobytes(), "ids": ids.tobytes()}
            block, before, held = block + 1, before + len(ids), []
            return pa.RecordBatch.from_pylist([row], schema=_IDS_ARROW)

        for batch in slices(batches, max_bytes=1 << 20):
            docs = batch.column(0).fill_null(_NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            ids, lengths = encoder.encode(batch.column(1))
            first = int(docs[0]) if first is None else first
            counts += np.bincount(ids, minlength=len(counts))
            held.append((docs, lengths, ids.astype(narrow)))
            if sum(len(h[2]) for h in held) >= BLOCK_IDS:
                yield flush()
        if held:
            yield flush()
        if first is not None:
            row = {"kind": 1, "part": part, "block": -1, "before": before, "first_doc": first, "n_ids": before, "doc_ids": b"", "doc_lengths": b"", "ids": counts.tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema=_IDS_ARROW)

    return run


def write(docs: DataFrame, tokenizer_path: str, folder: str, work: Workspace) -> None:
    """Writes the ids of (doc_id, text) in ascending doc_id order into ``folder``.

    The texts are ordered once and encoded once; their ids wait in ``work`` for the global counts. Counts, lengths and the
    codebook are as large as the vocabulary; the starts of the parts are one number a part.
    """
    spark = docs.sparkSession
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ids = work.put(ordered.mapInArrow(_tokenise(tokenizer_path), _IDS), "ids")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                counts = np.frombuffer(raw.as_py(), np.int64)
                own = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own])], ["id", "n"])

    work.release()
    found = ids.where("kind = 1").select("ids").mapInArrow(total, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(max(found["id"].to_pylist(), default=0) + 1, np.int64)
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    lengths = code_lengths(counts)
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{folder}/codebook")
    order = Window.orderBy("first_doc", "part").rowsBetween(Window.unboundedPreceding, -1)
    ids.where("kind = 1").select("part", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("start")).write.parquet(f"{folder}/parts")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(lengths)
        narrow = None
        for batch in batches:
            for row in batch.to_pylist():
                narrow = np.dtype(f"u{len(row['ids']) // max(row['n_ids'], 1)}")
                bits, checkpoints = book.pack(np.frombuffer(row["ids"], narrow).astype(np.int64))
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("part", "block", "before", "n_ids", "doc_ids", "doc_lengths")} | {"checkpoints": checkpoints.tobytes(), "bits": bits}], schema=packed)

    packed = pa.schema([*[(c, pa.int64()) for c in ("part", "block", "before", "n_ids")], *[(c, pa.binary()) for c in ("doc_ids", "doc_lengths", "checkpoints", "bits")]])
    out = ids.where("kind = 0").mapInArrow(pack, "part long, block long, before long, n_ids long, doc_ids binary, doc_lengths binary, checkpoints binary, bits binary")
    # Codes do not compress further.
    out.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    work.drop("ids")


def read(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; start counts the ids of all documents before it."""
    lengths = np.frombuffer(spark.read.parquet(f"{folder}/codebook").first()["lengths"], np.uint8)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                ids = book.unpack(row["bits"], np.frombuffer(row["checkpoints"], "<u4"), row["n_ids"]).astype("<u4")
                docs, counts = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["doc_lengths"], "<u4").astype(np.int64)
                at = V.offsets_of(counts)
                raw = pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer((at * 4).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == _NULL_ID), pa.array(row["start"] + row["before"] + at[:-1]), pa.array(counts), raw], ["doc_id", "start", "n_tokens", "ids"])

    blocks = spark.read.parquet(f"{folder}/blocks").join(spark.read.parquet(f"{folder}/parts"), "part")
    return blocks.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")


def digest(documents: DataFrame) -> DataFrame:
    """Checksums of the ids that ``read`` returns."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

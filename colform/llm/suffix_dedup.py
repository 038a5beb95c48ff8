"""Exact substring deduplication by a logarithmic family of suffix arrays.

A byte is removed if a ``LENGTH``-byte string that covers it also starts earlier in the corpus (smaller doc_id, or same
document and earlier start). Strings are judged on the input and never cross documents.

1. Anchors. Of the ``GRAM``-byte strings in any ``LENGTH``-byte window the one with the smallest hash is its anchor. Equal
   windows have equal anchors, so every repeat shows up among the occurrences of some anchor. About one position in
   35 is an anchor. Anchors that occur once are dropped by a count over all documents.
2. Suffix arrays. An occurrence carries the text around it that windows with this anchor can reach. Occurrences are dealt to
   tasks by anchor. A task takes them in batches; each batch becomes a sparse suffix array (its anchors' suffixes in
   lexicographic order), is merge-scanned against the existing levels for equal anchors, whose matches are extended to both
   sides, and then enters the family, where levels of like size merge, so a suffix is merged a logarithmic number of times.
3. Frequent anchors. Where an anchor occurs more than ``FREQUENT`` times, matching all pairs would grow with the square. Their
   windows are compared by 128-bit fingerprints instead: a task keeps the first of equal windows that it has seen itself and
   sends only that on, so a passage that a third of all documents hold costs one row a task.
4. A document that repeats an earlier one's whole text is removed as a whole beforehand.

Defined results: null is an empty text; documents of the same doc_id and different text come in the order of a hash of the text, rows of the
same doc_id and text are one document and get its result; null doc_id comes first; an empty table gives no rows; extra columns pass
through, and n_bytes, n_removed, n_spans and kept replace columns of that name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectortext as V
from .filters import NumberFilter
from .shared import Workspace, append_columns, slices, text_buffers, trim

LENGTH = 100
GRAM = 32
FREQUENT = 256
#: Bytes that a window reaches beyond its anchor on either side.
REACH = LENGTH - GRAM
SPAN = 2 * REACH + GRAM
#: Occurrences of a task's index and bytes that a task holds before it sends them on.
OCCURRENCES_A_TASK = 60_000
HELD_BYTES = 4 << 20
_PLACE_BITS = np.uint64(30)
_FIRST_ID = -(2**63)


# --- Anchors --------------------------------------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all anchors of the texts, in order."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = V.rolling_sums(data)
    start = np.arange(n - GRAM + 1)
    gram = V.span_hash(sums, start, start + GRAM)
    mask = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    # Leftmost of the smallest hashes: the position fills the low bits.
    key = (gram & ~mask) | start.astype(np.uint64)
    width = REACH + 1
    rows = -(-len(key) // width)
    blocks = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(key)] = key
    blocks = blocks.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
    inside = np.zeros(windows + 1, np.int32)
    fits = np.diff(offsets) >= LENGTH
    np.add.at(inside, offsets[:-1][fits], 1)
    np.add.at(inside, offsets[1:][fits] - LENGTH + 1, -1)
    place = (least[np.cumsum(inside[:windows]) > 0] & mask).astype(np.int64)
    place = place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place
    return place, gram[place]


# --- The index family -----------------------------------------------------------------------------------------


class Suffixes:
    """Occurrences of anchors with their surroundings: once sorted, a sparse suffix array, in the order of the text from the anchor on.

    Suffixes are compared over the ``LENGTH`` bytes that a match can use.
    """

    FIELDS = (("doc", np.int64), ("tie", np.int32), ("place", np.int32), ("left", np.uint8), ("right", np.uint8))

    def __init__(self, text: np.ndarray, **fields: np.ndarray):
        self.text = text
        self.fields = fields

    def __len__(self) -> int:
        return len(self.text)

    def take(self, order: np.ndarray) -> Suffixes:
        return Suffixes(self.text[order], **{k: v[order] for k, v in self.fields.items()})

    def anchors(self) -> np.ndarray:
        return np.ascontiguousarray(self.text[:, REACH : REACH + GRAM]).view(f"S{GRAM}").ravel()

    def suffixes(self) -> np.ndarray:
        return np.ascontiguousarray(self.text[:, REACH:]).view(f"S{LENGTH}").ravel()

    def sorted(self) -> Suffixes:
        return self.take(np.argsort(self.suffixes(), kind="stable"))

    def merged(self, other: Suffixes) -> Suffixes:
        """One sorted array from two: the other's suffixes go in behind those of this one that are not larger."""
        at = np.searchsorted(self.suffixes(), other.suffixes(), "right") + np.arange(len(other))
        order = np.empty(len(self) + len(other), np.int64)
        order[at] = len(self) + np.arange(len(other))
        rest = np.ones(len(order), bool)
        rest[at] = False
        order[rest] = np.arange(len(self))
        return Suffixes.joined([self, other]).take(order)

    @staticmethod
    def joined(parts: list[Suffixes]) -> Suffixes:
        return Suffixes(np.concatenate([p.text for p in parts]), **{k: np.concatenate([p.fields[k] for p in parts]) for k, _ in Suffixes.FIELDS})


def _groups(keys: np.ndarray) -> np.ndarray:
    """First element of each run of equal sorted keys, and the end."""
    return np.append(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), len(keys)) if len(keys) else np.zeros(1, np.int64)


class Family:
    """Levels of sorted suffixes whose sizes fall geometrically; ``found`` collects the removed spans."""

    def __init__(self) -> None:
        self.levels: list[Suffixes] = []
        self.found: list[tuple[np.ndarray, ...]] = []

    def add(self, batch: Suffixes) -> None:
        batch = batch.sorted()
        keys = batch.anchors()
        group = _groups(keys)
        # Pairs inside the batch: each occurrence with those behind it in its group.
        sizes = np.diff(group)
        rest = np.repeat(group[1:], sizes) - np.arange(len(keys)) - 1
        self._match(batch, np.repeat(np.arange(len(keys)), rest), batch, V.ragged_take(np.arange(len(keys)) + 1, rest))
        for level in self.levels:
            # Merge scan: where the level's suffixes with each of the batch's anchors lie.
            own = level.anchors()
            low, high = np.searchsorted(own, keys[group[:-1]], "left"), np.searchsorted(own, keys[group[:-1]], "right")
            each = np.repeat(high - low, sizes)
            self._match(batch, np.repeat(np.arange(len(keys)), each), level, V.ragged_take(np.repeat(low, sizes), each))
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-1]) * 2 >= len(self.levels[-2]):
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merged(last)

    def _match(self, a: Suffixes, i: np.ndarray, b: Suffixes, j: np.ndarray, step: int = 1 << 15) -> None:
        """Extends the pairs (i of a, j of b) to both sides and notes what the later one loses."""
        for at in range(0, len(i), step):
            x, y = i[at : at + step], j[at : at + step]
            same = a.text[x] == b.text[y]
            left = np.where(same[:, :REACH].all(axis=1), REACH, np.argmin(same[:, :REACH][:, ::-1], axis=1))
            right = np.where(same[:, REACH + GRAM :].all(axis=1), REACH, np.argmin(same[:, REACH + GRAM :], axis=1))
            fa, fb = a.fields, b.fields
            left = np.minimum(left, np.minimum(fa["left"][x], fb["left"][y]))
            right = np.minimum(right, np.minimum(fa["right"][x], fb["right"][y]))
            order = np.zeros(len(x), np.int8)  # 1 where a's occurrence is the later one, -1 where b's is
            for name in ("doc", "tie", "place"):
                p, q = fa[name][x], fb[name][y]
                order = np.where(order == 0, (p > q).astype(np.int8) - (p < q), order)
            hit = np.flatnonzero((left + right >= REACH) & (order != 0) & same[:, REACH : REACH + GRAM].all(axis=1))
            for own, rows, side in ((a, x, 1), (b, y, -1)):
                late = hit[order[hit] == side]
                f, r = own.fields, rows[late]
                self.found.append((f["doc"][r], f["tie"][r], f["place"][r] - left[late], f["place"][r] + GRAM + right[late]))


def _first_windows(doc, tie, place, one, two):
    """Spans of the windows that repeat an earlier one of these."""
    order = np.lexsort((place, tie, doc, two, one))
    repeat = np.zeros(len(order), bool)
    a, b = order[1:], order[:-1]
    repeat[1:] = (one[a] == one[b]) & (two[a] == two[b])
    # A row that is there twice (one document read as two rows) stays with its first.
    head = np.maximum.accumulate(np.where(repeat, 0, np.arange(len(order))))
    own = (doc[order] == doc[order[head]]) & (tie[order] == tie[order[head]]) & (place[order] == place[order[head]])
    late = order[repeat & ~own]
    return order[~repeat], (doc[late], tie[late], place[late], place[late] + LENGTH)


def _merged_spans(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Overlapping or touching spans of each document as one."""
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    doc, tie, start, end = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(4))
    if not len(doc):
        return doc, tie, start, end
    order = np.lexsort((start, tie, doc))
    doc, tie, start, end = doc[order], tie[order], start[order], end[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])])
    # The reach so far within a document: a running maximum on ends lifted by the document's number.
    number = np.cumsum(new) - 1
    lift = number * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + lift)
    opens = new.copy()
    opens[1:] |= (start + lift)[1:] > reach[:-1]
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], tie[first], start[first], reach[last] - lift[last]


# --- Jobs -----------------------------------------------------------------------------------------------------

_ROUTED = "p int, kind int, doc binary, tie binary, place binary, left binary, right binary, text binary"
_ROUTED_ARROW = pa.schema([("p", pa.int32()), ("kind", pa.int32()), *[(c, pa.binary()) for c in ("doc", "tie", "place", "left", "right", "text")]])
_SPANS = "doc long, tie int, start int, end int"


def _route(parts: int):
    """Sends every repeated anchor's surroundings, and the windows of the frequent ones, to the task of their key.

    kind 0: surroundings; kind 1: windows, whose fingerprints fill text; kind 2: spans found here, dealt anywhere.
    """

    def send(p, kind, doc, tie, place, left, right, text):
        order = np.argsort(p, kind="stable")
        cuts = _groups(p[order])
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = order[a:b]
            row = [int(p[own[0]]), kind, doc[own].astype(np.int64), tie[own].astype(np.int32), place[own].astype(np.int32), left[own].astype(np.uint8) if kind == 0 else left[own].astype(np.int32), right[own].astype(np.uint8), text[own]]
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in row[2:]]], schema=_ROUTED_ARROW)

    def flush(suffixes, windows, spans):
        if suffixes:
            gram, s = np.concatenate([g for g, _ in suffixes]), Suffixes.joined([s for _, s in suffixes])
            # Of equal surroundings the first goes on; the others lose all that their windows cover.
            row = np.concatenate([s.text, s.fields["left"][:, None], s.fields["right"][:, None]], axis=1)
            padded = np.zeros((len(row), -(-row.shape[1] // 8) * 8), np.uint8)
            padded[:, : row.shape[1]] = row
            number = np.zeros(len(row), np.uint64)
            for word in padded.view(np.uint64).T:
                number = V.mix(number ^ word)
            order = np.lexsort((s.fields["place"], s.fields["tie"], s.fields["doc"], number))
            repeat = np.zeros(len(order), bool)
            a, b = order[1:], order[:-1]
            repeat[1:] = (number[a] == number[b]) & (row[a] == row[b]).all(axis=1)
            head = order[np.maximum.accumulate(np.where(repeat, 0, np.arange(len(order))))]
            own = np.all([s.fields[k][order] == s.fields[k][head] for k in ("doc", "tie", "place")], axis=0)
            late = order[repeat & ~own]
            whole = late[s.fields["left"][late].astype(int) + s.fields["right"][late] >= REACH]
            f = s.fields
            spans.append((f["doc"][whole], f["tie"][whole], f["place"][whole] - f["left"][whole], f["place"][whole].astype(np.int64) + GRAM + f["right"][whole]))
            kept = order[~repeat]
            t = s.take(kept)
            yield from send((gram[kept] % np.uint64(parts)).astype(np.int64), 0, *[t.fields[k] for k, _ in Suffixes.FIELDS], t.text)
        if windows:
            doc, tie, place, one, two = (np.concatenate(x) for x in zip(*windows))
            first, late = _first_windows(doc, tie, place, one, two)
            spans.append(late)
            none = np.zeros(len(first), np.uint8)
            yield from send((one[first] % np.uint64(parts)).astype(np.int64), 1, doc[first], tie[first], place[first], none, none, np.column_stack([one[first], two[first]]))
        if spans:
            doc, tie, start, end = _merged_spans(spans)
            if len(doc):
                none = np.zeros(len(doc), np.uint8)
                yield from send(np.abs(doc) % parts, 2, doc, tie, start, end, none, none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes, windows, spans, held = [], [], [], 0
        for batch in slices(batches, max_bytes=1 << 19):
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            data, offsets = text_buffers(col["text"])
            counts = np.diff(col["places"].offsets.to_numpy())
            local = col["places"].flatten().to_numpy().astype(np.int64)
            gram, frequent = col["grams"].flatten().to_numpy().view(np.uint64), col["frequent"].flatten().to_numpy(zero_copy_only=False).astype(bool)
            row = V.row_of(counts)
            doc, tie = col["doc"].to_numpy()[row], col["tie"].to_numpy()[row]
            place = offsets[row] + local
            rare = np.flatnonzero(~frequent)
            if len(rare):
                padded = np.pad(data, (REACH, REACH))
                text = np.lib.stride_tricks.sliding_window_view(padded, SPAN)[place[rare]]
                size = np.diff(offsets)[row[rare]]
                suffixes.append((gram[rare], Suffixes(text, doc=doc[rare], tie=tie[rare].astype(np.int32), place=local[rare].astype(np.int32), left=np.minimum(local[rare], REACH).astype(np.uint8), right=np.minimum(size - local[rare] - GRAM, REACH).astype(np.uint8))))
                held += text.nbytes
            often = np.flatnonzero(frequent)
            if len(often):
                # Starts of all windows that hold a frequent anchor, each once.
                low = np.maximum(place[often] - REACH, offsets[row[often]])
                high = np.minimum(place[often], offsets[row[often] + 1] - LENGTH)
                mark = np.zeros(len(data) + 1, np.int32)
                fits = high >= low
                np.add.at(mark, low[fits], 1)
                np.add.at(mark, high[fits] + 1, -1)
                start = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                owner = np.searchsorted(offsets, start, "right") - 1
                sums = V.rolling_sums(data)
                one = V.span_hash(sums, start, start + LENGTH)
                half = LENGTH // 2
                two = V.mix(V.span_hash(sums, start, start + half) * np.uint64(3) + V.span_hash(sums, start + half, start + LENGTH))
                windows.append((col["doc"].to_numpy()[owner], col["tie"].to_numpy()[owner], start - offsets[owner], one, two))
                held += 40 * len(start)
            if held > HELD_BYTES:
                yield from flush(suffixes, windows, spans)
                suffixes, windows, spans, held = [], [], [], 0
        yield from flush(suffixes, windows, spans)
        trim()

    return run


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's index family over what was routed to it."""
    family, waiting, n, windows, spans = Family(), [], 0, [], []
    get = lambda b, i, c, kind: np.frombuffer(b.column(b.schema.get_field_index(c))[i].as_buffer() or b"", kind)
    for batch in batches:
        for i in range(batch.num_rows):
            kind = batch.column(1)[i].as_py()
            doc, tie, place = get(batch, i, "doc", np.int64), get(batch, i, "tie", np.int32), get(batch, i, "place", np.int32)
            if kind == 0:
                waiting.append(Suffixes(get(batch, i, "text", np.uint8).reshape(-1, SPAN), doc=doc, tie=tie, place=place, left=get(batch, i, "left", np.uint8), right=get(batch, i, "right", np.uint8)))
                n += len(doc)
                if n >= 4096:
                    family.add(Suffixes.joined(waiting))
                    waiting, n = [], 0
            elif kind == 1:
                prints = get(batch, i, "text", np.uint64).reshape(-1, 2)
                windows.append((doc, tie, place, prints[:, 0], prints[:, 1]))
            else:
                spans.append((doc, tie, place, get(batch, i, "left", np.int32)))
        if len(family.found) > 64:
            family.found = [_merged_spans(family.found)]
    if waiting:
        family.add(Suffixes.joined(waiting))
    if windows:
        spans.append(_first_windows(*(np.concatenate(x) for x in zip(*windows)))[1])
    doc, tie, start, end = _merged_spans([*family.found, *spans])
    for at in range(0, len(doc), 1 << 16):
        part = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(doc[part]), pa.array(tie[part].astype(np.int32)), pa.array(start[part].astype(np.int32)), pa.array(end[part].astype(np.int32))], ["doc", "tie", "start", "end"])
    del family, windows, spans
    trim()


def _anchor_rows(odd, invert: bool):
    """Anchors of the documents that the filter ``odd`` lacks; with ``invert`` the documents that it holds, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=1 << 19):
            held = NumberFilter(odd.value).has(batch.column(batch.schema.get_field_index("mark")).to_numpy())
            if invert:
                yield batch.filter(pa.array(held))
            else:
                yield _anchors_of(batch.filter(pa.array(~held)))

    return run


def _anchors_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    data, offsets = text_buffers(col["text"])
    place, gram = anchors(data, offsets)
    counts = np.diff(np.searchsorted(place, offsets))
    at = pa.array(V.offsets_of(counts), pa.int32())
    local = place - np.repeat(offsets[:-1], counts)
    lists = [pa.ListArray.from_arrays(at, pa.array(gram.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(local.astype(np.int32)))]
    return pa.RecordBatch.from_arrays([col["doc"], col["print"], col["tie"], *lists], ["doc", "print", "tie", "grams", "places"])


def _odd_ones(keyed: DataFrame, work: Workspace) -> DataFrame:
    """(doc, print, mark, tie, copy) of the documents that repeat an earlier one's whole text, or share their doc_id with other texts."""
    narrow = work.put(keyed.select("doc", "print", "print2", "mark", F.octet_length("text").alias("size")).distinct(), "prints")
    prints = ["print", "print2"]
    firsts = narrow.where(F.col("size") >= LENGTH).groupBy(*prints).agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = narrow.join(work.put(firsts, "firsts", small=True), prints).where("doc > first").select("doc", "print", "mark", F.lit(0).alias("tie"), F.lit(True).alias("copy"))
    shared = narrow.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc")
    ties = narrow.join(work.put(shared, "shared", small=True), "doc").withColumn("tie", F.row_number().over(Window.partitionBy("doc").orderBy(*prints)) - 1).where("tie > 0")
    odd = copies.unionByName(ties.select("doc", "print", "mark", "tie", F.lit(False).alias("copy"))).groupBy("doc", "print", "mark").agg(F.max("tie").alias("tie"), F.max("copy").alias("copy"))
    return work.put(odd, "odd", small=True)


def dedup(docs: DataFrame, work: Workspace | None = None, as_text: bool = False) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans and kept (the remaining bytes) to every document.

    ``as_text`` adds kept_text in place of kept: the remaining bytes without the rests of characters that a cut split.

    A document is known by doc (its id) and print (a hash of its text). The texts move twice: to their repeated anchors and to their
    spans. Whole copies, which the first search leaves out, are told by a filter of fixed size; the few rows that it holds are checked by a join.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "suffix")
    own = ("n_bytes", "n_removed", "n_spans", "kept_text" if as_text else "kept")
    kept_columns = [c for c in docs.columns if c not in ("doc_id", "text")]
    # Columns beside id and text travel in one struct, so that their names cannot clash with those used here.
    rest = F.struct(*[F.col(f"`{c}`") for c in kept_columns]) if kept_columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), rest.alias("rest"))
    texts = texts.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST_ID)), "print": F.xxhash64("text"), "print2": F.xxhash64(F.lit("2"), F.col("text"))})
    texts = texts.withColumn("mark", F.xxhash64("doc", "print", "print2"))
    odd = _odd_ones(texts, work)
    held = NumberFilter.build(odd.select("mark"), odd.count())

    long_ones = texts.where(F.octet_length("text") >= LENGTH).select("doc", "print", "mark", F.lit(0).alias("tie"), "text")
    listing = "doc long, print long, tie int, grams array<long>, places array<int>"
    plain = long_ones.mapInArrow(_anchor_rows(held, False), listing)
    doubtful = long_ones.mapInArrow(_anchor_rows(held, True), long_ones.schema).drop("tie").join(odd.select("mark", F.col("tie").alias("known"), "copy"), "mark", "left")
    doubtful = doubtful.where("copy is null or not copy").select("doc", "print", F.coalesce("known", F.lit(0)).alias("tie"), "text")
    rest_of = doubtful.mapInArrow(lambda batches: (_anchors_of(b) for b in slices(batches, max_bytes=1 << 19)), listing)
    listed = work.put(plain.unionByName(rest_of), "anchors")
    counts = work.put(listed.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    each = listed.select("doc", "print", "tie", F.inline(F.arrays_zip("grams", "places")).alias("gram", "place"))
    repeated = each.join(counts, "gram").groupBy("doc", "print", "tie").agg(F.array_sort(F.collect_list(F.struct("place", "gram", (F.col("n") > FREQUENT).alias("frequent")))).alias("a"))
    repeated = work.put(repeated.select("doc", "print", "tie", F.col("a.place").alias("places"), F.col("a.gram").alias("grams"), F.col("a.frequent").alias("frequent")), "repeated")
    work.drop("anchors", "counts")
    total = repeated.agg(F.sum(F.size("places")).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // OCCURRENCES_A_TASK), int(spark.conf.get("spark.sql.shuffle.partitions")))
    routed = long_ones.drop("tie", "mark").join(repeated, ["doc", "print"]).select("doc", "tie", "text", "places", "grams", "frequent").mapInArrow(_route(4 * parts), _ROUTED)
    spans = work.put(routed.repartition(parts, "p").mapInArrow(_search, _SPANS), "spans")

    lost = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans")).join(repeated.select("doc", "tie", "print"), ["doc", "tie"])
    verdicts = lost.select("doc", "print", "spans", F.lit(False).alias("copy")).unionByName(odd.where("copy").select("doc", "print", F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"), "copy"))
    verdicts = work.put(verdicts, "verdicts")
    work.drop("repeated", "spans")
    work.release()
    joined = texts.select("doc_id", "text", "rest", "doc", "print").join(verdicts, ["doc", "print"], "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    last = "kept_text" if as_text else "kept"
    found = append_columns(joined, _cut_text if as_text else _cut, f"n_bytes bigint, n_removed bigint, n_spans bigint, {last} {'string' if as_text else 'binary'}")
    names = [c for c in docs.columns if c not in own]
    return found.select(*[F.col(f"rest.`{c}`").alias(c) if c in kept_columns else F.col(c) for c in names], "n_bytes", "n_removed", "n_spans", last)


def _cut_text(batch: pa.RecordBatch) -> list[pa.Array]:
    *counts, kept = _cut(batch)
    return [*counts, pa.array([k.decode("utf-8", "ignore") for k in kept.to_pylist()], pa.string())]


def _cut(batch: pa.RecordBatch) -> list[pa.Array]:
    col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    data, offsets = text_buffers(col["text"])
    size = np.diff(offsets)
    mark = np.zeros(len(data) + 1, np.int32)
    spans = col["spans"]
    if spans.null_count:
        spans = pa.array([x or [] for x in spans.to_pylist()], spans.type)
    counts = np.diff(spans.offsets.to_numpy())
    flat = spans.flatten()
    row = V.row_of(counts)
    np.add.at(mark, offsets[row] + flat.field("start").to_numpy(), 1)
    np.add.at(mark, offsets[row] + flat.field("end").to_numpy(), -1)
    gone = np.cumsum(mark[:-1]) > 0
    copy = col["copy"].to_numpy(zero_copy_only=False).astype(bool) & (size >= LENGTH)
    gone |= np.repeat(copy, size)
    opens = gone.copy()
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    opens[1:] &= ~gone[:-1]
    opens[inner] |= gone[inner]
    per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
    removed, runs = per(gone), per(opens)
    return [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), binary_of(data[~gone], size - removed)]


def binary_of(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(V.offsets_of(lengths).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, bytes]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The definition on a small list of (doc_id, bytes): n_bytes, n_removed, n_spans, kept_sha256 of each."""
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(texts):
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            s = text[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(text, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out

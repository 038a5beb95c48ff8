"""Similarity join on word n-gram sets: Jaccard links by prefix buckets and signature trees, and their components.

A document's set holds its distinct shingles of ``width`` words (A-Z lower-cased; fewer words make one shingle). Two documents
link when 100 * intersection >= percent * union.

1. Shingles are known by 64-bit hashes under a key drawn for each run, so equal hashes cannot be prepared. Equal sets are one
   class, known by a 64-bit fingerprint; a second one is compared, and the run begins anew under another key should two sets differ in it.
2. Buckets. Linked sets of n and m shingles share at least ``percent``% of the larger one, so in any common order of all shingles they share
   one among the first p = n - ceil(percent n / 100) + 1. The order is by hash, with shingles put last that more than
   ``FREQUENT`` classes have in these first places: a set with e of them goes e places further. Sets that would have to go more
   than about p places further consist of frequent shingles; they alone share buckets of frequent shingles too.
   A pair belongs to the first bucket that both are in: their shared shingles all lie behind it, which bounds their number by both places.
3. Stars. Each class is compared with those of three hubs a bucket that it shares a good part of its first places with; verified links
   give first components. This joins a large group of near copies in a number of comparisons that grows with its size.
4. Signature trees. Buckets whose classes are still in several components are searched for links between these, all by trees. The classes'
   bitmaps, collision counts and sizes are the leaves of a tree whose nodes hold OR-combined bitmaps, the largest collision count, the size
   range and the component if it is one; a dual traversal prunes node pairs by component, by size range and by the maximum possible
   overlap. Large buckets are searched in blocks: each against the members outside the bucket's largest component.
   Each pair is given out by its own bucket only, and only a few spanning forests of a bucket's components at a time are verified;
   buckets with pairs left come again with four times as many forests, until no pair is left. No link between different sets is
   lost, and no bucket is expanded into all its pairs.

Defined results: null, empty and wordless texts have an empty set, 0 shingles and link with nothing; a document without links is its own
component; rows of equal doc_id are rows of their own; a component whose rows all lack doc_id has a null one; an empty table gives no
rows. The result has one row a document with doc_id, n_shingles and component_id; other columns are not read.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectortext as V
from .components import components
from .filters import NumberFilter
from .shared import Workspace, side_by_side, slices, text_buffers, trim

WIDTH = 5
PERCENT = 80
#: Classes that may hold a shingle in their first places before it is put last.
FREQUENT = 32
#: Members of a bucket that is searched as a whole; larger ones are searched in blocks of about BLOCK_SHINGLES shingles a side.
BLOCK = 512
BLOCK_SHINGLES = 1 << 22
#: Children of a tree node.
FANOUT = 8
#: Hubs of a bucket, and spanning forests that a bucket gives in the first round.
HUBS = 3
FORESTS = 12
#: Node pairs that are tested at once, and bytes of bitmaps in such a test.
PAIRS, PAIR_BYTES = 1 << 16, 4 << 20
#: Ids that are sent to all executors to pick out texts; more go through a filter.
FEW_IDS = 1 << 18
_NULL_ID = -(2**63)
_SIGN = np.uint64(1 << 63)


# --- Sets -----------------------------------------------------------------------------------------------------


def shingle_sets(column: pa.Array, width: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and their number."""
    data, offsets = text_buffers(column)
    low = V.LOWER[data]
    starts, ends, before = V.words(low, offsets)
    word = V.word_hash(low, starts, ends, key)
    n_words = np.diff(before)
    shingles = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    length = np.repeat(np.minimum(n_words, width), shingles)
    first = V.ragged_take(before[:-1], shingles)
    value = V.mix(length.astype(np.uint64))
    for k in range(width):
        if (length > k).all():
            value = V.mix(value) + word[first + k]
        else:
            more = length > k
            value[more] = V.mix(value[more]) + word[first[more] + k]
    value = V.mix(value)
    text = V.row_of(shingles)
    # Sorted within each text: by text number and high bits at once, which is faster than by two keys.
    lift = max(len(n_words), 1).bit_length()
    order = np.argsort((text.astype(np.uint64) << np.uint64(64 - lift)) | (value >> np.uint64(lift)))
    value = value[order]
    low_bits = np.flatnonzero((value[1:] < value[:-1]) & (text[1:] == text[:-1])) if len(value) else order
    if len(low_bits):  # equal high bits: order those texts exactly
        order = np.lexsort((value, text))
        value = value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], np.bincount(text[new], minlength=len(n_words))


def _fingerprints(values: np.ndarray, counts: np.ndarray, salt: int = 0xABCDEF) -> np.ndarray:
    """One number a set; 0 for the empty one."""
    sums = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        sums[full] = V.mix(np.add.reduceat(V.mix(values ^ np.uint64(salt)), V.offsets_of(counts)[full]) + counts[full].astype(np.uint64))
    return sums.view(np.int64)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n shares with any set that it links with, at least."""
    return -(-percent * n // 100)


def _heads(width: int, percent: int, key: int):
    """First 2 p + 16 shingles of every set, as numbers whose order is that of the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=1 << 19):
            values, counts = shingle_sets(batch.column(1), width, key)
            p = counts - needed(counts, percent) + 1
            take = np.minimum(counts, 2 * p + 16)
            heads = (values[V.ragged_take(V.offsets_of(counts)[:-1], take)] ^ _SIGN).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(V.offsets_of(take), pa.int32()), pa.array(heads))
            prints = [pa.array(_fingerprints(values, counts, s)) for s in (0xABCDEF, 0x123457)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *prints, pa.array(counts, pa.int64()), pa.array(p, pa.int64()), lists], ["doc_id", "set", "check", "n", "p", "head"])

    return run


def _bits_for(n: np.ndarray) -> np.ndarray:
    """Bits of a signature: a power of two, at least eight a shingle, so that few pairs below the threshold pass."""
    return 1 << np.maximum(6, np.ceil(np.log2(np.maximum(8 * n, 1))).astype(np.int64))


def _again(width: int, key: int, wanted, bitmaps: bool):
    """set, n and bitmap, or set and all shingles, of the rows whose ids the filter ``wanted`` holds; a few others may come too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=1 << 19):
            if wanted is not None:
                batch = batch.filter(pa.array(NumberFilter(wanted.value).has(batch.column(0).fill_null(_NULL_ID).to_numpy())))
            if not batch.num_rows:
                continue
            values, counts = shingle_sets(batch.column(1), width, key)
            binary = lambda o, d: pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(o.astype(np.int32).tobytes()), pa.py_buffer(d.tobytes())])
            sets = pa.array(_fingerprints(values, counts))
            if not bitmaps:
                yield pa.RecordBatch.from_arrays([sets, binary(V.offsets_of(counts) * 8, values)], ["set", "body"])
                continue
            bits = _bits_for(counts)
            bytes_ = V.offsets_of(bits // 8)
            bitmap = np.zeros(int(bytes_[-1]), np.uint8)
            at = (values & (np.repeat(bits, counts) - 1).astype(np.uint64)).astype(np.int64)
            np.bitwise_or.at(bitmap, np.repeat(bytes_[:-1], counts) + (at >> 3), np.uint8(1) << (at & 7).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([sets, pa.array(counts, pa.int64()), binary(bytes_, bitmap)], ["set", "n", "bitmap"])

    return run


# --- Signature trees ------------------------------------------------------------------------------------------


def may_link(left, n, other_left, other_n, percent: int) -> np.ndarray:
    """Whether sets of n and other_n shingles, that can share at most left and other_left, may link."""
    return (100 + percent) * np.minimum(left, other_left) >= percent * (n + other_n)


class SignatureTrees:
    """Trees of several buckets over one array of leaves; a level holds the nodes of all trees, leaves first."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, labels: np.ndarray, per_tree: np.ndarray):
        slack = sizes - np.bitwise_count(bitmaps).sum(axis=1).astype(np.int64)
        self.levels = [(bitmaps, slack, sizes, sizes, labels, np.ones(len(sizes), bool))]
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while (per_tree > 1).any():
            b, s, low, high, label, pure = self.levels[-1]
            parents = -(-per_tree // FANOUT)
            place = V.ragged_arange(parents)
            cut = np.repeat(V.offsets_of(per_tree)[:-1], parents) + place * FANOUT
            self.children.append((cut, np.minimum(np.repeat(per_tree, parents) - place * FANOUT, FANOUT)))
            first, last = np.minimum.reduceat(label, cut), np.maximum.reduceat(label, cut)
            self.levels.append((np.bitwise_or.reduceat(b, cut, axis=0), np.maximum.reduceat(s, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), first, np.logical_and.reduceat(pure, cut) & (first == last)))
            per_tree = parents

    def deepened(self, depth: int) -> None:
        """Roots above the roots, so that trees of two forests have their leaves at one depth."""
        while len(self.levels) < depth:
            n = len(self.levels[-1][1])
            self.children.append((np.arange(n), np.ones(n, np.int64)))
            self.levels.append(self.levels[-1])


def dual_traversal(a: SignatureTrees, b: SignatureTrees, percent: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Leaf pairs of different labels that may link, and the most they can share, in parts.

    Root i of ``a`` meets root i of ``b``. ``same`` says that both are one; then each pair comes once. Depth first in parts of at
    most ``PAIRS`` node pairs, so that memory is bounded however many pairs there are.
    """
    a.deepened(len(b.levels))
    b.deepened(len(a.levels))
    roots = np.arange(len(a.levels[-1][1]))
    stack = [(len(a.levels) - 1, roots[i : i + PAIRS], roots[i : i + PAIRS]) for i in range(0, len(roots), PAIRS)]
    while stack:
        level, x, y = stack.pop()
        A, B = a.levels[level], b.levels[level]
        keep = ~(A[5][x] & B[5][y] & (A[4][x] == B[4][y]))
        keep &= (100 * A[3][x] >= percent * B[2][y]) & (100 * B[3][y] >= percent * A[2][x])
        if same:
            keep &= (x <= y) if level else (x < y)
        x, y = x[keep], y[keep]
        most = np.empty(len(x), np.int64)
        step = max(1, PAIR_BYTES // (8 * A[0].shape[1]))
        for at in range(0, len(x), step):
            part = slice(at, at + step)
            most[part] = np.bitwise_count(A[0][x[part]] & B[0][y[part]]).sum(axis=1)
        most += np.minimum(A[1][x], B[1][y])
        keep = (100 + percent) * most >= percent * (A[2][x] + B[2][y])
        x, y, most = x[keep], y[keep], most[keep]
        if not len(x):
            continue
        if not level:
            yield x, y, most
            continue
        (first_x, n_x), (first_y, n_y) = a.children[level - 1], b.children[level - 1]
        for at in range(0, len(x), PAIRS // FANOUT**2):
            p, q = x[at : at + PAIRS // FANOUT**2], y[at : at + PAIRS // FANOUT**2]
            left = V.ragged_take(first_x[p], n_x[p])
            right, times = np.repeat(q, n_x[p]), np.repeat(n_y[q], n_x[p])
            stack.append((level - 1, np.repeat(left, times), V.ragged_take(first_y[right], times)))


def _tree_order(unit: np.ndarray, n: np.ndarray, label: np.ndarray, large: int = FANOUT) -> np.ndarray:
    """Unit by unit; leaves of large components side by side, so that nodes are pure; the others by size."""
    component = V.numbered(unit, label)
    group = np.where(np.bincount(component)[component] >= large, component + 1, 0)
    return np.lexsort((n, group, unit))


def _forests(unit, la, lb, most, a, b, each: int) -> np.ndarray:
    """Of the candidate pairs ``each`` edge-disjoint spanning forests of every unit's components, likeliest pairs first.

    Boruvka's rounds over all units at once: every component takes its best pair, components merge, until none is left. So a unit
    gives at most ``each`` pairs for each of its components, however many pairs could link.
    """
    order = np.lexsort((b, a, -most))
    node = V.numbered(np.concatenate([unit, unit]), np.concatenate([la, lb]))
    u, v = node[: len(unit)], node[len(unit) :]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    left, chosen = np.ones(len(order), bool), []
    for _ in range(each):
        root = np.arange(node.max(initial=-1) + 1)
        open_ = np.flatnonzero(left)
        if not len(open_):
            break
        while len(open_):
            x, y = root[u[open_]], root[v[open_]]
            open_, x, y = open_[x != y], x[x != y], y[x != y]
            if not len(open_):
                break
            best = np.full(len(root), len(order), np.int64)
            np.minimum.at(best, x, rank[open_])
            np.minimum.at(best, y, rank[open_])
            taken = order[np.unique(best[best < len(order)])]
            chosen.append(taken)
            left[taken] = False
            # Merge: the smaller root wins, until the taken pairs agree.
            while True:
                x, y = root[u[taken]], root[v[taken]]
                if (x == y).all():
                    break
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while (root[root] != root).any():
                    root = root[root]
    return np.sort(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)


UNIT = ["kind", "shingle", "part"]


#: Sides of a unit: members, members outside a large bucket's main component, the latter as the second side, pairs tested before.
MEMBER, ODD, SECOND, TESTED = range(4)


class _Units:
    """Whole units as they come from the shuffle."""

    def __init__(self, table: pa.Table):
        columns = [table[c].to_numpy() for c in UNIT]
        change = np.ones(table.num_rows, bool)
        change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        self.names = [c[change] for c in columns]
        unit, side = np.cumsum(change) - 1, table["side"].to_numpy()
        old = table.select(["set", "other"]).filter(pa.array(side == TESTED))
        self.tested = (unit[side == TESTED], old["set"].to_numpy(), old["other"].to_numpy())
        member = np.flatnonzero(side != TESTED)
        table = table.take(pa.array(member))
        self.unit, self.side = unit[member], side[member]
        self.sets, self.n, self.label = (table[c].to_numpy() for c in ("set", "n", "label"))
        self.bitmaps = table["bitmap"].combine_chunks()
        self.bytes = np.array(pc.binary_length(self.bitmaps).to_numpy(), np.int64)
        # How many of a member's shingles lie from its place in the unit's bucket on, and its buckets before that one.
        self.left = self.n - table["place"].to_numpy()
        keys = table["keys"].combine_chunks()
        self.early_counts = np.diff(keys.offsets.to_numpy())
        row = V.row_of(self.early_counts)
        kind = (V.ragged_arange(self.early_counts) >= table["zeros"].to_numpy()[row]).astype(np.int32)
        self.early = V.numbered(kind, keys.flatten().to_numpy())
        self.early_at = V.offsets_of(self.early_counts)
        self.early_span = int(self.early.max(initial=0)) + 1
        self.early_held = np.sort(row * self.early_span + self.early)

    def folded(self, rows: np.ndarray, size: int) -> np.ndarray:
        """Bitmaps of 2^k bytes OR-folded to ``size`` bytes, as 64-bit words."""
        raw = [np.frombuffer(self.bitmaps[i].as_buffer(), np.uint8).reshape(-1, size) for i in rows.tolist()]
        return np.stack([r[0] if len(r) == 1 else np.bitwise_or.reduce(r, axis=0) for r in raw]).view(np.uint64)

    def first_here(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether this unit's bucket is the first that both rows are in."""
        out = np.ones(len(x), bool)
        both = np.flatnonzero((self.early_counts[x] > 0) & (self.early_counts[y] > 0))
        same = self.early[self.early_at[x[both]]] == self.early[self.early_at[y[both]]]
        out[both[same]] = False
        both = both[~same]
        for at in range(0, len(both), PAIRS // 4):
            pair = both[at : at + PAIRS // 4]
            k = self.early_counts[x[pair]]
            want = np.repeat(y[pair], k) * self.early_span + self.early[V.ragged_take(self.early_at[x[pair]], k)]
            hit = self.early_held[np.minimum(np.searchsorted(self.early_held, want), len(self.early_held) - 1)] == want
            out[pair[np.bincount(V.row_of(k)[hit], minlength=len(pair)) > 0]] = False
        return out

    def untested(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        unit, a, b = self.tested
        p, q = self.sets[x], self.sets[y]
        number = V.numbered(np.concatenate([unit, self.unit[x]]), np.concatenate([a, np.minimum(p, q)]), np.concatenate([b, np.maximum(p, q)]))
        return ~np.isin(number[len(unit) :], number[: len(unit)])

    def search(self, sides: list[np.ndarray], size: int, percent: int, each: int):
        """Row pairs that may link, and whether their unit has more; ``sides`` are the rows of units that have all these sides."""
        trees, members = [], []
        for own in sides:
            own = own[_tree_order(self.unit[own], self.n[own], self.label[own])]
            first = np.flatnonzero(np.concatenate([[True], np.diff(self.unit[own]) != 0]))
            trees.append(SignatureTrees(self.folded(own, size), self.n[own], self.label[own], np.diff(np.append(first, len(own)))))
            members.append(own)
        rest = np.zeros(len(self.names[0]), bool)

        def thinned(x, y, most):
            low, high = np.minimum(self.label[x], self.label[y]), np.maximum(self.label[x], self.label[y])
            few = _forests(self.unit[x], low, high, most, self.sets[x], self.sets[y], each)
            gone = np.ones(len(x), bool)
            gone[few] = False
            rest[self.unit[x[gone]]] = True
            return x[few], y[few], most[few]

        held = (np.zeros(0, np.int64),) * 3
        for x, y, most in dual_traversal(trees[0], trees[-1], percent, len(trees) == 1):
            x, y = members[0][x], members[-1][y]
            # Two members outside the main component meet in two blocks: the one with the smaller set as first side counts.
            keep = (self.label[x] != self.label[y]) & (self.sets[x] != self.sets[y]) & ((self.side[x] != ODD) | (self.sets[x] < self.sets[y]))
            keep &= may_link(self.left[x], self.n[x], self.left[y], self.n[y], percent)
            x, y, most = x[keep], y[keep], most[keep]
            keep = self.first_here(x, y)
            if len(self.tested[0]):
                keep &= self.untested(x, y)
            held = tuple(np.concatenate([h, new[keep]]) for h, new in zip(held, (x, y, most)))
            if len(held[0]) > 4 * PAIRS:
                held = thinned(*held)
        x, y, _ = thinned(*held)
        return x, y, rest[self.unit[x]]

    def candidates(self, percent: int, each: int) -> pa.RecordBatch:
        n_units = len(self.names[0])
        least = np.full(n_units, 1 << 62, np.int64)
        np.minimum.at(least, self.unit, self.bytes)
        second = self.side == SECOND
        two = np.bincount(self.unit[second], minlength=n_units) > 0
        two &= np.bincount(self.unit[~second], minlength=n_units) > 0
        alone = np.bincount(self.unit[second], minlength=n_units) == 0
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
        for chosen, parts in ((alone, (~second,)), (two, (~second, second))):
            for size in np.unique(least[chosen & (least < 1 << 62)]).tolist():
                units = chosen & (least == size)
                out.append(self.search([np.flatnonzero(units[self.unit] & part) for part in parts], size, percent, each))
        x, y, more = (np.concatenate([o[k] for o in out]) for k in range(3))
        a, b = np.minimum(self.sets[x], self.sets[y]), np.maximum(self.sets[x], self.sets[y])
        return pa.RecordBatch.from_arrays([*[pa.array(c[self.unit[x]]) for c in self.names], pa.array(a), pa.array(b), pa.array(more)], [*UNIT, "a", "b", "more"])


def _search(percent: int, each: int):
    """Candidate pairs (unit, a, b, more) of rows (unit, side, set, other, n, label, bitmap, zeros, keys, place) that come unit by unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, UNIT):
            yield _Units(table).candidates(percent, each)
        trim()

    return run


# --- The join -------------------------------------------------------------------------------------------------


class _Texts:
    """The documents, from which sets are made again where they are needed, rather than kept or moved."""

    def __init__(self, texts: DataFrame, firsts: DataFrame, width: int, percent: int, key: int, work: Workspace):
        self.texts, self.firsts, self.width, self.percent, self.key, self.work = texts, firsts, width, percent, key, work

    def of(self, sets: DataFrame, name: str, bitmaps: bool = False) -> DataFrame:
        """(set, n, bitmap) or (set, body) of at least the classes in ``sets``; the documents are scanned, not shuffled.

        Up to ``FEW_IDS`` ids of their first documents are broadcast; more pick texts out through a filter of bounded size.
        """
        ids = sets.join(self.firsts, "set").select(F.coalesce("first", F.lit(_NULL_ID)).alias("id"))
        ids = self.work.put(ids, f"{name}-ids", small=True)
        texts, wanted = self.texts, None
        if (count := ids.count()) <= FEW_IDS:
            texts = texts.join(F.broadcast(ids), F.coalesce("doc_id", F.lit(_NULL_ID)) == F.col("id"), "left_semi")
        else:
            wanted = NumberFilter.build(ids, count)
        return texts.mapInArrow(_again(self.width, self.key, wanted, bitmaps), "set long, n long, bitmap binary" if bitmaps else "set long, body binary")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """(a, b, linked) of (a, b), by exact intersection."""
        pairs = self.work.put(pairs, f"{name}-pairs", small=True)
        sets = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
        bodies = self.work.put(self.of(sets, name), f"{name}-bodies")
        side = lambda c: bodies.select(F.col("set").alias(c), F.col("body").alias(f"{c}_body"))
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                linked = []
                for p, q in zip(col["a_body"], col["b_body"]):
                    p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                    at = np.searchsorted(q, p)
                    common = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                    linked.append(100 * common >= percent * (len(p) + len(q) - common))
                yield pa.RecordBatch.from_arrays([col["a"], col["b"], pa.array(linked, pa.bool_())], ["a", "b", "linked"])

        out = self.work.put(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long, linked boolean").distinct(), name)
        self.work.drop(f"{name}-pairs", f"{name}-bodies", f"{name}-ids")
        return out


def _chosen(batch: pa.RecordBatch, frequent: NumberFilter, percent: int):
    """Bucket shingles of the classes of a batch: per head entry its class, place, rank among the infrequent and p, and whether kind 0 or kind 1 takes it."""
    col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    values, counts = col["head"].flatten().to_numpy(), np.diff(col["head"].offsets.to_numpy())
    row, place = V.row_of(counts), V.ragged_arange(counts)
    p = col["p"].to_numpy()
    rare = ~frequent.has(values)
    running = np.concatenate([[0], np.cumsum(rare)])
    first = V.offsets_of(counts)
    rank = running[1:] - np.repeat(running[first[:-1]], counts)
    n_rare = running[first[1:]] - running[first[:-1]]
    further = np.full(len(p), np.iinfo(np.int64).max)
    last = np.flatnonzero(rare & (rank == p[row]))
    further[row[last]] = place[last] + 1 - p[row[last]]
    # The p-th infrequent shingle must lie within about p further places, which the other side's head has too.
    enough = (n_rare >= p) & (further <= np.floor(p * (0.9 * percent / 100)) + 4)
    zero = rare & ((rank <= p[row]) | ~enough[row])
    one = ~enough[row] & (place < p[row])
    return values, row, place, rank, p, zero, one


def _keys(classes: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """(set, n, zeros, keys, places) of the classes that may meet another: their buckets in order, those of kind 0 first, and their places there.

    Kind 1 are buckets of the sets of frequent shingles among themselves. Which shingles are put last, and which can be left out as
    nobody shares them, is asked of filters whose size follows their counts. A false answer puts a shingle last for all sets alike,
    or keeps one too many; neither loses a link.
    """
    plain = classes.select(F.explode(F.slice("head", F.lit(1), F.col("p").cast("int"))).alias("shingle"))
    counts = work.put(plain.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "counts")
    shared = NumberFilter.build(counts.select("shingle"), counts.count())
    often = counts.where(F.col("times") > FREQUENT).select("shingle")
    frequent = NumberFilter.build(often, often.count())
    work.drop("counts")

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, row, place, _, p, zero, _ = _chosen(batch, NumberFilter(frequent.value), percent)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(values[zero & (place >= p[row])]))], ["shingle"])

    distant = work.put(classes.select("p", "head").mapInArrow(further, "shingle long").distinct(), "distant", small=True)
    beyond = NumberFilter.build(distant, distant.count())
    work.drop("distant")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, row, place, rank, _, zero, one = _chosen(batch, NumberFilter(frequent.value), percent)
            met = NumberFilter(shared.value).has(values)
            parts = (np.flatnonzero(zero & (met | NumberFilter(beyond.value).has(values))), np.flatnonzero(one & met))
            at = np.concatenate(parts)
            kind = np.repeat(np.array([0, 1], np.int32), [len(x) for x in parts])
            where = np.concatenate([rank[parts[0]] - 1, place[parts[1]]]).astype(np.int32)
            order = np.lexsort((values[at], kind, row[at]))
            counts = np.bincount(row[at], minlength=batch.num_rows)
            listed = lambda x: pa.ListArray.from_arrays(pa.array(V.offsets_of(counts), pa.int32()), pa.array(x))
            zeros = np.bincount(row[parts[0]], minlength=batch.num_rows).astype(np.int32)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(zeros), listed(values[at][order]), listed(where[order])], ["set", "n", "zeros", "keys", "places"])
            yield out.filter(pa.array(counts > 0))

    return classes.select("set", "n", "p", "head").mapInArrow(choose, "set long, n long, zeros int, keys array<long>, places array<int>")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows that come group by group."""
    waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
        last = np.logical_and.reduce([table[c].to_numpy() == table[c][-1].as_py() for c in keys])
        cut = int(np.argmax(last))
        if cut:
            yield table.slice(0, cut)
        waiting = table.slice(cut)
    if waiting is not None and waiting.num_rows:
        yield waiting


def _feasible(start: np.ndarray, n: np.ndarray, left: np.ndarray, label: np.ndarray | None, percent: int) -> np.ndarray:
    """Rows that may link with another of their bucket, by sizes and places, and by labels if given. Buckets are runs of rows."""
    size = np.diff(np.append(start, len(n)))
    rest = np.repeat(start + size, size) - np.arange(len(n)) - 1
    found = np.zeros(len(n), bool)
    cuts = np.searchsorted(np.cumsum(rest), np.arange(0, int(rest.sum()) + 1, 1 << 18))
    for a, b in zip(cuts, [*cuts[1:], len(n)]):
        rows = np.arange(a, b)
        x, y = np.repeat(rows, rest[rows]), V.ragged_take(rows + 1, rest[rows])
        may = may_link(left[x], n[x], left[y], n[y], percent)
        if label is not None:
            may &= label[x] != label[y]
        found[x[may]] = found[y[may]] = True
    return found


def _meetings(percent: int):
    """Of the buckets of infrequent shingles the members that may link with another there, their number and their hubs."""

    def whole(table: pa.Table) -> pa.RecordBatch:
        shingle, sets, n, place = (table[c].to_numpy() for c in ("shingle", "set", "n", "place"))
        starts = lambda x: np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        at = np.flatnonzero(_feasible(starts(shingle), n, n - place, None, percent))
        if not len(at):
            return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in _MEMBERS_ARROW], schema=_MEMBERS_ARROW)
        shingle, sets, n, place = shingle[at], sets[at], n[at], place[at]
        start = starts(shingle)
        members = np.diff(np.append(start, len(at)))
        bucket = np.repeat(np.arange(len(start)), members)
        hubs = np.empty((len(start), HUBS), np.int64)
        for r in range(HUBS):
            order = np.lexsort((V.mix(sets.view(np.uint64) + np.uint64(r)), bucket))
            hubs[:, r] = sets[order[start]]
        hubs = np.sort(hubs, axis=1)
        keep = np.ones(hubs.shape, bool)
        keep[:, 1:] = hubs[:, 1:] != hubs[:, :-1]
        lists = pa.ListArray.from_arrays(pa.array(V.offsets_of(keep.sum(axis=1)[bucket]), pa.int32()), pa.array(hubs[bucket][keep[bucket]]))
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), np.int32)), pa.array(shingle), pa.array(sets), pa.array(n), pa.array(place), pa.array(members[bucket]), lists], schema=_MEMBERS_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["shingle"]):
            yield whole(table)

    return run


_MEMBERS = "kind int, shingle long, set long, n long, place int, members long, hubs array<long>"
_MEMBERS_ARROW = pa.schema([("kind", pa.int32()), ("shingle", pa.int64()), ("set", pa.int64()), ("n", pa.int64()), ("place", pa.int32()), ("members", pa.int64()), ("hubs", pa.list_(pa.int64()))])


def _members(held: DataFrame, percent: int) -> DataFrame:
    """(kind, shingle, set, n, place, members, hubs) of all buckets with members that may link.

    Buckets of infrequent shingles are small and are seen whole by a task; those of frequent ones are only counted.
    """
    def listed(first, many) -> DataFrame:
        pairs = F.arrays_zip(F.slice("keys", first, many).alias("shingle"), F.slice("places", first, many).alias("place"))
        return held.select("set", "n", F.explode(pairs).alias("key")).select("set", "n", "key.shingle", "key.place")

    zero, one = listed(F.lit(1), F.col("zeros")), listed(F.col("zeros") + 1, F.size("keys")).withColumn("kind", F.lit(1))
    hubs = [F.min(F.struct(F.xxhash64(F.lit(r), "set").alias("h"), "set")).alias(f"h{r}") for r in range(HUBS)]
    sizes = one.groupBy("kind", "shingle").agg(F.count(F.lit(1)).alias("members"), *hubs).where("members > 1")
    sizes = sizes.select("kind", "shingle", "members", F.array_distinct(F.array(*[F.col(f"h{r}.set") for r in range(HUBS)])).alias("hubs"))
    return side_by_side(zero, "shingle").mapInArrow(_meetings(percent), _MEMBERS).unionByName(one.join(sizes, ["kind", "shingle"]))


def _partners(percent: int):
    """Members of small buckets that may link with another there: (kind, shingle, sets) of rows that come bucket by bucket."""

    def whole(table: pa.Table) -> pa.RecordBatch:
        kind, shingle, n, place, label, sets = (table[c].to_numpy() for c in ("kind", "shingle", "n", "place", "label", "set"))
        new = np.ones(len(n), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (shingle[1:] != shingle[:-1])
        bucket = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        at = np.flatnonzero(_feasible(start, n, n - place, label, percent))
        at = at[np.lexsort((sets[at], bucket[at]))]
        sizes = np.bincount(bucket[at], minlength=len(start))
        some = np.flatnonzero(sizes)
        lists = pa.ListArray.from_arrays(pa.array(V.offsets_of(sizes[some]), pa.int32()), pa.array(sets[at]))
        return pa.RecordBatch.from_arrays([pa.array(kind[start[some]]), pa.array(shingle[start[some]]), lists], ["kind", "shingle", "sets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, UNIT[:2]):
            yield whole(table)

    return run


def _units(open_: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """(kind, shingle, part, side, set) of the buckets to search; ``open_`` has (kind, shingle, members, set, n, place, label)."""
    small = open_.where(F.col("members") <= BLOCK).select("kind", "shingle", "set", "n", "place", "label")
    lists = side_by_side(small, "kind", "shingle").mapInArrow(_partners(percent), "kind int, shingle long, sets array<long>")
    # Equal lists are searched once, under the first of their buckets.
    lists = lists.groupBy("sets").agg(F.min(F.struct("kind", "shingle")).alias("key"))
    small = lists.select("key.kind", "key.shingle", F.lit(0).cast("long").alias("part"), F.lit(MEMBER).alias("side"), F.explode("sets").alias("set"))

    large = open_.where(F.col("members") > BLOCK)
    by_label = large.groupBy("kind", "shingle", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("size"))
    main = by_label.groupBy("kind", "shingle").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("size").alias("size"))
    odd_size = by_label.join(main, ["kind", "shingle"]).where("label <> main").groupBy("kind", "shingle").agg(F.sum(by_label["size"]).alias("odd_size"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_SHINGLES).cast("int")
    plan = main.join(odd_size, ["kind", "shingle"]).select("kind", "shingle", "main", blocks("size").alias("blocks"), blocks("odd_size").alias("odd_blocks"))
    large = large.join(work.put(plan, "plan", small=True), ["kind", "shingle"])
    part = lambda i, j: (i.cast("long") * (1 << 31) + j.cast("long")).alias("part")
    own = lambda seed, c: F.pmod(F.xxhash64(F.lit(seed), "set"), F.col(c))
    first = large.withColumn("j", F.explode(F.expr("sequence(0, odd_blocks - 1)")))
    first = first.select("kind", "shingle", part(own(1, "blocks"), F.col("j")), F.when(F.col("label") == F.col("main"), MEMBER).otherwise(ODD).alias("side"), "set")
    second = large.where("label <> main").withColumn("i", F.explode(F.expr("sequence(0, blocks - 1)")))
    second = second.select("kind", "shingle", part(F.col("i"), own(2, "odd_blocks")), F.lit(SECOND).alias("side"), "set")
    return small.unionByName(first).unionByName(second)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, work: Workspace | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id that links reach."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "ngram")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    while True:
        key = secrets.randbits(63)
        rows = work.put(texts.mapInArrow(_heads(width, percent, key), "doc_id long, set long, check long, n long, p long, head array<long>"), "rows")
        firsts = rows.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("first"), F.min("check").alias("low"), F.max("check").alias("high"))
        firsts = work.put(firsts, "firsts", small=True)
        if not firsts.where("low <> high").limit(1).count():
            break
    firsts = firsts.select("set", "first")
    full = rows.where("n > 0").join(firsts, F.col("doc_id").eqNullSafe(F.col("first")) & (rows["set"] == firsts["set"]), "left_semi")
    classes = work.put(full.select("set", "n", "p", "head"), "classes")
    rows = work.put(rows.select("doc_id", "set", "n"), "narrow", small=True)
    work.drop("rows")
    held = work.put(_keys(classes, percent, work), "keys")
    work.drop("classes")

    # The sets themselves are made anew: shingles for those in pairs, bitmaps for the members of buckets to search.
    again = _Texts(texts, firsts, width, percent, key, work)
    members = work.put(_members(held, percent), "members")
    met = members.select("set", "n", F.explode("hubs").alias("hub")).where("set <> hub").groupBy("set", "n", "hub").count()
    # Sets of like size that link share about half of their first places in buckets in which places allow a link; half of that is asked for.
    stars = met.where(F.col("count") * 4 >= F.expr(f"n - ceil({percent} * n / 100) + 1")).select(F.least("set", "hub").alias("a"), F.greatest("set", "hub").alias("b")).distinct()
    tested = again.verified(stars, "tested0")
    labels = components(tested.where("linked"), work, "c0")

    work.release()
    labelled = members.drop("hubs").join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    labelled = work.put(labelled, "labelled", small=True)
    open_ = labelled.groupBy("kind", "shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("kind", "shingle")
    units = work.put(_units(labelled.join(open_, ["kind", "shingle"], "left_semi"), percent, work), "units")
    bitmaps = work.put(again.of(units.select("set").distinct(), "bitmaps", True).dropDuplicates(["set"]).join(held.drop("n"), "set"), "bitmaps")
    work.drop("keys", "members", "labelled", "plan", "bitmaps-ids")
    round_, each, old = 0, FORESTS, None
    while True:
        info = bitmaps.join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))
        # Of a member's buckets those before the unit's own go along, and its place there.
        first, many = F.when(F.col("kind") == 0, 1).otherwise(F.col("zeros") + 1), F.when(F.col("kind") == 0, F.col("zeros")).otherwise(F.size("keys"))
        at = (first - 1 + F.array_position(F.slice("keys", first, many), F.col("shingle"))).cast("int")
        searched = units.join(info, "set").withColumn("at", at).select(
            *UNIT, "side", "set", F.lit(None).cast("long").alias("other"), "n", "label", "bitmap", "zeros", F.slice("keys", F.lit(1), F.col("at") - 1).alias("keys"), F.element_at("places", F.col("at")).alias("place")
        )
        if old is not None:
            searched = searched.unionByName(old, allowMissingColumns=True)
        emitted = work.put(side_by_side(searched, *UNIT).mapInArrow(_search(percent, each), "kind int, shingle long, part long, a long, b long, more boolean"), f"emitted{round_}")
        found = again.verified(emitted.select("a", "b").distinct(), f"found{round_}")
        round_ += 1
        tested = work.put(tested.unionByName(found), f"tested{round_}", small=True)
        labels = components(found.where("linked"), work, f"c{round_}", labels)
        again_units = emitted.where("more").select(*UNIT).distinct()
        if not again_units.limit(1).count():
            break
        # Only units that have pairs left come again, with their tested pairs.
        units = work.put(units.join(again_units, UNIT, "left_semi"), f"units{round_}", small=True)
        new = emitted.join(again_units, UNIT, "left_semi").select(*UNIT, F.lit(TESTED).alias("side"), F.col("a").alias("set"), F.col("b").alias("other"))
        old = work.put(new if old is None else new.unionByName(old.join(again_units, UNIT, "left_semi")), f"old{round_}", small=True)
        each *= 4

    whole = firsts.join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    smallest = whole.groupBy("label").agg(F.min("first").alias("component"))
    resolved = work.put(whole.join(work.put(smallest, "smallest", small=True), "label").select("set", "component"), "resolved")
    work.drop("firsts", "smallest", "bitmaps", "units", *[f"{t}{r}" for t in ("emitted", "found", "tested", "units", "old") for r in range(round_ + 1)])
    work.release()
    found = rows.select("doc_id", "set", "n").join(resolved, "set", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def brute_force(texts: dict[int, str | None], width: int, percent: int) -> dict[int, tuple[int, int]]:
    """The definition on a small table: doc_id -> (n_shingles, component_id)."""
    import re

    sets = {}
    for doc, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, min(len(words), 1)))}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    docs = sorted(sets)
    holders: dict[tuple, list[int]] = {}
    for d in docs:
        common: dict[int, int] = {}
        for s in sets[d]:
            for o in holders.get(s, ()):
                common[o] = common.get(o, 0) + 1
        for o, k in common.items():
            if 100 * k >= percent * (len(sets[d]) + len(sets[o]) - k):
                x, y = root(d), root(o)
                parent[max(x, y)] = min(x, y)
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    return {d: (len(sets[d]), root(d)) for d in docs}

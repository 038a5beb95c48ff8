"""Exact top-k inner product search by norm-bucketed retrieval.

Vectors are grouped by length into blocks. A task holds one block of queries and a stripe of candidate blocks,
longest first, with the k best products of each query so far. For each block and query the local
cosine threshold t = worst kept product / (query length * longest length of the block) chooses:

* t > 1: no vector of the block can enter, all are skipped;
* t >= ``coordinate_at``: coordinate pruning, the query's largest coordinate bounds the same coordinate of any
  vector whose cosine reaches t; the few that fit are verified;
* otherwise length pruning: only vectors of length >= worst kept / query length are verified.

Products are verified on integers, in float64 while they stay exact there and in int64 otherwise. The k best of
the stripes meet in one window per query. Equal products go to the smaller vec_id.

Defined results: vectors that are null or hold a null or non-finite component take no part; a query never meets
itself, but other rows of its vec_id; rows of one vec_id are queries of their own; a shorter vector counts as padded with zeros; repeated rows of other ids each count; fewer
than k candidates give all; rows without vec_id take no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace

_BLOCK = "block long, longest double, n int, width int, ids binary, rows binary, lengths binary, matrix binary"
#: How many rows each query of a block has kept, and their scores, ids and row numbers.
_KEPT = ("kept_counts", "kept_scores", "kept_ids", "kept_rows")
_FOUND = "asked long, ids binary, rows binary, reach double, kept_counts binary, kept_scores binary, kept_ids binary, kept_rows binary"
_FOUND_ARROW = pa.schema([("asked", pa.int64()), ("ids", pa.binary()), ("rows", pa.binary()), ("reach", pa.float64()), *[(c, pa.binary()) for c in _KEPT]])


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>, length) of the usable rows, v = floor(scale * x)."""
    sound = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('Infinity'))"
    v = F.expr(f"transform(embedding, x -> cast(floor({scale} * cast(x as double)) as long))")
    length = F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + cast(x as double) * x))")
    return vectors.where(sound).select("vec_id", v.alias("v")).withColumn("length", length)


def _pack(block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        ids, numbers, lengths = (table[c].to_numpy() for c in ("vec_id", "row", "length"))
        part = TaskContext.get().partitionId()
        lists = table["v"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        width = int(sizes.max())
        matrix = np.zeros((len(ids), width), np.int64)
        matrix[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
        order = np.lexsort((ids, -lengths))
        for at in range(0, len(order), block_rows):
            take = order[at : at + block_rows]
            kind = np.int16 if width and np.abs(matrix[take]).max() < 2**15 else np.int64
            yield pa.RecordBatch.from_pylist(
                [{"block": (part << 32) + at // block_rows, "longest": float(lengths[take[0]]), "n": len(take), "width": width * (1 if kind == np.int16 else -1), "ids": ids[take].tobytes(), "rows": numbers[take].tobytes(), "lengths": lengths[take].tobytes(), "matrix": matrix[take].astype(kind).tobytes()}],
                schema=pa.schema([("block", pa.int64()), ("longest", pa.float64()), ("n", pa.int32()), ("width", pa.int32()), *[(c, pa.binary()) for c in ("ids", "rows", "lengths", "matrix")]]),
            )

    return run


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    width, kind = abs(row["width"]), np.int16 if row["width"] > 0 else np.int64
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64), np.frombuffer(row["lengths"], np.float64), np.frombuffer(row["matrix"], kind).reshape(row["n"], width)


def _padded(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest scores, ties to the smaller id."""
    if len(scores) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids, rows = scores[keep], ids[keep], rows[keep]
    order = np.lexsort((rows, ids, -scores))[:k]
    return scores[order], ids[order], rows[order]


def search_block(queries, buckets, k: int, kept: list | None = None, coordinate_at: float = 0.8) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best (scores, ids, rows) of some candidate blocks and of ``kept`` for each query of a block.

    Blocks are (ids, rows, lengths, matrix), lengths falling.
    """
    _, q_rows, q_lengths, q_matrix = queries
    kept = list(kept) if kept is not None else [(np.zeros(0, np.int64),) * 3] * len(q_rows)
    for ids, rows, lengths, matrix in buckets:
        width = max(matrix.shape[1], q_matrix.shape[1])
        m, q = _padded(matrix, width), _padded(q_matrix, width)
        largest = float(np.abs(m).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(width, 1)
        exact = np.float64 if largest < 2**53 else np.int64
        m, q = m.astype(exact), q.astype(exact)
        worst = np.array([s[-1] if len(s) == k else -np.inf for s, _, _ in kept], np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(np.isneginf(worst), -np.inf, worst / (q_lengths * lengths[0]))
        t = np.where(np.isnan(t), -np.inf, t)
        # A slack of 1e-9 keeps rounding from cutting an equal product.
        open_ = np.flatnonzero(~(t > 1 + 1e-9))
        by_coordinate = open_[(t[open_] >= coordinate_at)]
        by_length = open_[~(t[open_] >= coordinate_at)]
        for i in by_coordinate:
            f = int(np.argmax(np.abs(q[i])))
            qf, ti = q[i, f] / q_lengths[i], min(t[i], 1.0)
            half = np.sqrt(max(1 - qf * qf, 0)) * np.sqrt(max(1 - ti * ti, 0)) + 1e-9
            with np.errstate(divide="ignore", invalid="ignore"):
                unit = np.where(lengths > 0, m[:, f] / lengths, 0.0)
            fits = np.flatnonzero((lengths * q_lengths[i] >= worst[i] * (1 - 1e-9)) & _within(unit, qf, ti, half))
            kept[i] = _merge(kept[i], m[fits] @ q[i], ids[fits], rows[fits], q_rows[i], k)
        if len(by_length):
            with np.errstate(divide="ignore", invalid="ignore"):
                shortest = np.where(worst[by_length] > 0, worst[by_length] / q_lengths[by_length] * (1 - 1e-9), -1)
            ends = np.searchsorted(-lengths, -shortest, "right")
            products = m[: ends.max()] @ q[by_length].T
            for column, (i, end) in enumerate(zip(by_length, ends)):
                kept[i] = _merge(kept[i], products[:end, column], ids[:end], rows[:end], q_rows[i], k)
    return kept


def _within(unit: np.ndarray, qf: float, t: float, half: float) -> np.ndarray:
    """Where a unit vector's coordinate lets its cosine with the query reach t: the cap around the query, cut at one axis."""
    low, high = qf * t - half, qf * t + half
    # Inside the cap the axis itself may lie: then the bound on that side is the end of the axis.
    if qf >= t:
        high = 1.0 + 1e-9
    if -qf >= t:
        low = -1.0 - 1e-9
    return (unit >= low) & (unit <= high)


def _merge(kept, scores, ids, rows, own, k):
    other = rows != own
    if len(kept[0]) == k:
        other &= scores >= kept[0][-1]
    if not other.any():
        return kept
    scores, ids, rows = scores[other].astype(np.int64), ids[other], rows[other]
    return _best(*(np.concatenate(pair) for pair in zip(kept, (scores, ids, rows))), k)


def _bin(length):
    """Number of a range of lengths: sixteen a power of two, so a few ten thousand at most."""
    return F.floor(F.log2(F.greatest(length, F.lit(1e-300))) * 16).cast("long")


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, block_rows: int = 4096, query_rows: int = 1024, stripe: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of every query against all rows.

    The blocks of the longest vectors form the first stripe, which every query block meets first. What it gives bounds the
    length that a vector must have to enter any more, so that only the stripes with such vectors are sent on to a query block.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "topk")
    usable = work.put(integer_vectors(vectors, scale).withColumn("row", F.monotonically_increasing_id()), "integers")
    rows = usable.count()
    # Equal lengths are spread by a hash of the id, so a vector that many rows repeat fills many blocks.
    parts = max(1, -(-rows // block_rows))
    tie = F.xxhash64("vec_id", "row")
    # Partitions, and with them blocks, come by falling length.
    blocks = work.put(usable.repartitionByRange(parts, F.col("length").desc(), tie).mapInArrow(_pack(block_rows), _BLOCK), "blocks")
    blocks = blocks.withColumn("stripe", F.floor(F.shiftright("block", 32) / stripe))
    queries = usable.where(F.expr(f"pmod(vec_id, {query_every}) = 0"))
    query_parts = max(1, -(-rows // (query_every * query_rows)))
    asked = work.put(queries.repartition(query_parts, tie).mapInArrow(_pack(query_rows), _BLOCK), "queries").withColumnRenamed("block", "asked")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        buckets = [_unpack(r) for r in sorted(b.to_pylist(), key=lambda r: r["block"])]
        out = [_search_row(r, buckets, k) for r in a.to_pylist()]
        return pa.Table.from_pylist(out, schema=_FOUND_ARROW)

    # The numbers of the query blocks, eight bytes for ``query_every * query_rows`` rows, go to the few blocks of the first stripe.
    head = blocks.where("stripe = 0").crossJoin(F.broadcast(asked.select(F.col("asked").alias("asked"))))
    first = asked.withColumns({c: F.lit(None).cast("binary") for c in _KEPT})
    first = work.put(first.groupBy("asked").cogroup(head.groupBy("asked")).applyInArrow(run, _FOUND), "first")

    # The last stripe that each query block must see, by ranges of lengths.
    rest = blocks.where("stripe > 0")
    bins = rest.groupBy(_bin(F.col("longest")).alias("bin")).agg(F.max("stripe").alias("stripe"))
    reach = first.select("asked", F.when(F.col("reach") > 0, _bin(F.col("reach")) - 1).otherwise(F.lit(-(1 << 40))).alias("least"))
    last = reach.join(F.broadcast(bins), F.col("bin") >= F.col("least")).groupBy("asked").agg(F.max("stripe").alias("last"))
    pairs = last.select("asked", F.explode(F.sequence(F.lit(1).cast("long"), "last")).alias("stripe"))
    left = asked.join(first.select("asked", *_KEPT), "asked").join(pairs, "asked")
    right = rest.join(pairs.select(F.col("asked").alias("asked"), F.col("stripe").alias("stripe")), "stripe")
    more = left.groupBy("asked", "stripe").cogroup(right.groupBy("asked", "stripe")).applyInArrow(run, _FOUND)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, scores, found = (np.frombuffer(r[c], np.int64) for c in ("kept_ids", "kept_scores", "kept_rows"))
                queries, query_rows_ = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], np.int64)
                at = np.repeat(np.arange(len(queries)), np.frombuffer(r["kept_counts"], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (query_rows_[at], queries[at], found, ids, scores)], ["query_row", "query_id", "row", "vec_id", "score"])

    # A stripe's answer holds what the first stripe gave too: each row counts once.
    schema = "query_row long, query_id long, row long, vec_id long, score long"
    partial = first.unionByName(more).mapInArrow(listed, schema).dropDuplicates(["query_row", "row"])
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_row(r: dict, buckets: list, k: int) -> dict:
    """One query block against some candidate blocks, from what it has kept so far."""
    block = _unpack(r)
    kept = None
    if r["kept_counts"] is not None:
        at = np.concatenate([[0], np.cumsum(np.frombuffer(r["kept_counts"], np.int64))])
        columns = [np.frombuffer(r[c], np.int64) for c in _KEPT[1:]]
        kept = [tuple(c[a:b] for c in columns) for a, b in zip(at[:-1], at[1:])]
    found = search_block(block, buckets, k, kept)
    lengths = block[2]
    with np.errstate(divide="ignore", invalid="ignore"):
        least = [s[-1] / q if len(s) == k and s[-1] > 0 and q > 0 else 0.0 for (s, _, _), q in zip(found, lengths)]
    return {
        "asked": r["asked"], "ids": r["ids"], "rows": r["rows"], "reach": float(min(least, default=0.0)) * (1 - 1e-9),
        "kept_counts": np.array([len(s) for s, _, _ in found], np.int64).tobytes(),
        **{c: np.concatenate([f[j] for f in found] or [np.zeros(0, np.int64)]).astype(np.int64).tobytes() for j, c in enumerate(_KEPT[1:])},
    }

"""The two kernels whose state runs from row to row: greedy delta runs and move-to-front strings.

They run chunk by chunk; a chunk of move-to-front starts with the values that the chunks before leave."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colform.functions import costs as C
from colform.sources.ordering import CHUNKS

FRONT = 8


def _newest(newer: list, older: list) -> list:
    """The last distinct values, newest first, of two stretches of rows."""
    return [*newer, *[v for v in older if v not in newer]][:FRONT]


def _left_before(summaries: DataFrame, position: str, kind: str) -> DataFrame:
    """(position, recent) -> (position, recent values that the positions before leave); one group of rows is seen at a time."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, held, before = rows.sort_values(position), [], []
        for recent in rows["recent"]:
            before.append(held)
            held = _newest(list(recent), held)
        return pd.DataFrame({position: rows[position], "before": before, "_group": rows["_group"], "recent": [held] * len(rows)})

    schema = f"{position} long, before array<{kind}>, _group long, recent array<{kind}>"
    return summaries.groupBy("_group").applyInPandas(run, schema)


def move_to_front(ordered: DataFrame, column: str) -> DataFrame:
    """(_rn, fold): place of the value among the last eight distinct ones, null if it is not there.

    What a chunk starts with is found in two levels: from the chunks before in its group of 4096, and from the groups before.
    """
    kind = dict(ordered.dtypes)[column]

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.sort_values("_rn", ascending=False)[column].drop_duplicates().head(FRONT).tolist()
        return pd.DataFrame({"_chunk": rows["_chunk"].head(1), "recent": [[None if v != v else v for v in values]]})

    summaries = ordered.select("_chunk", "_rn", column).groupBy("_chunk").applyInPandas(last, f"_chunk long, recent array<{kind}>")
    chunks = _left_before(summaries.withColumn("_group", F.floor(F.col("_chunk") / CHUNKS).cast("long")), "_chunk", kind)
    groups = chunks.select(F.col("_group").alias("_number"), "recent").dropDuplicates(["_number"]).withColumn("_group", F.lit(0).cast("long"))
    groups = _left_before(groups, "_number", kind).select(F.col("_number").alias("_group"), F.col("before").alias("older"))
    state = chunks.select("_chunk", "_group", "before").join(groups, "_group").select("_chunk", "before", "older")

    def run(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        recent = _newest(list(held["before"].iloc[0]), list(held["older"].iloc[0])) if len(held) else []
        fold = []
        for v in rows.sort_values("_rn")[column]:
            if v in recent:
                fold.append(recent.index(v))
                recent.remove(v)
            else:
                fold.append(None)
                del recent[FRONT - 1 :]
            recent.insert(0, v)
        return pd.DataFrame({"_rn": rows["_rn"].sort_values(), "fold": pd.array(fold, "Int64")})

    return ordered.select("_chunk", "_rn", column).groupBy("_chunk").cogroup(state.groupBy("_chunk")).applyInPandas(run, "_rn long, fold long")


def vector_deltas(vectors: DataFrame, key: str, column: str, digits: int = 3) -> DataFrame:
    """Per dimension of an array column: base (median of the scaled whole numbers), width of the zigzagged differences.

    Vectors are taken at 10^digits; ``exact`` says whether all components survive that at 32-bit precision.
    """
    cells = vectors.select(key, F.posexplode(column).alias("dim", "x"))
    scaled = C.round_half_away(F.col("x").cast("double") * 10.0**digits).cast("long")
    cells = cells.withColumn("s", scaled).withColumn("same", (F.col("s") / F.lit(10.0**digits)).cast("float") == F.col("x"))
    base = cells.groupBy("dim").agg(F.percentile("s", F.lit(0.5)).cast("long").alias("base"), F.min(F.col("same")).alias("exact"))
    return cells.join(F.broadcast(base), "dim").groupBy("dim", "base", "exact").agg(F.max(C.zigzag(F.col("s") - F.col("base"))).alias("widest")).withColumn("bits", C.bits_for(F.col("widest")))


def greedy_runs(widths: list[int], least: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, width) of runs: a run ends where the varint class widens and it holds at least ``least`` rows."""
    out = []
    start, width = 0, 0
    for i, w in enumerate(widths):
        if w > width and i - start >= least:
            out.append((start, i - start, width))
            start, width = i, w
        width = max(width, w)
    return [*out, (start, len(widths) - start, width)] if widths else []

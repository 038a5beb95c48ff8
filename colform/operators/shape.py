"""Structural operators: flatten, batch, transpose, tuples, key union. Paths are arrays, never joined text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DEPTH = 3
MAX_KEYS = 256


def leaf_paths(schema: T.StructType, depth: int = MAX_DEPTH) -> list[tuple[str, ...]]:
    """Paths of all fields after lifting structs up to ``depth`` levels; a field name may hold a dot."""
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType) and depth:
            out += [(f.name, *rest) for rest in leaf_paths(f.dataType, depth - 1)]
        else:
            out.append((f.name,))
    if len(out) > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} keys")
    return out


def _at(path: tuple[str, ...]):
    c = F.col(f"`{path[0]}`")
    for name in path[1:]:
        c = c.getField(name)
    return c


def flatten(df: DataFrame, depth: int = MAX_DEPTH) -> tuple[DataFrame, list[tuple[str, ...]]]:
    """Columns c0, c1, .. and the path that each comes from."""
    paths = leaf_paths(df.schema, depth)
    return df.select(*[_at(p).alias(f"c{i}") for i, p in enumerate(paths)]), paths


def unflatten(df: DataFrame, paths: list[tuple[str, ...]]) -> DataFrame:
    """Inverse of ``flatten`` for present structs; a struct whose fields are all null stays a struct of nulls."""

    def build(items: list[tuple[tuple[str, ...], str]]):
        heads = list(dict.fromkeys(p[0] for p, _ in items))
        out = []
        for h in heads:
            own = [(p[1:], c) for p, c in items if p[0] == h]
            out.append((F.col(own[0][1]) if not own[0][0] else F.struct(*build(own))).alias(h))
        return out

    return df.select(*build([(p, f"c{i}") for i, p in enumerate(paths)]))


def explode_batch(df: DataFrame, key: list[str], column: str) -> tuple[DataFrame, DataFrame]:
    """(items with key and pos, lengths by key); empty arrays live in the lengths."""
    items = df.select(*key, F.posexplode(column).alias("pos", "item"))
    return items, df.select(*key, F.size(column).alias("length"))


def implode_batch(items: DataFrame, lengths: DataFrame, key: list[str], name: str) -> DataFrame:
    grouped = items.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("_a"))
    return lengths.join(grouped, key, "left").select(*key, F.coalesce(F.col("_a.item"), F.array()).alias(name))


def transpose_map(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """A map column as rows (entry_key, value)."""
    return df.select(*key, F.explode(column).alias("entry_key", "value"))


def untranspose_map(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entry_key", "value")))).alias(name))


def tuple_width(df: DataFrame, column: str) -> int | None:
    """The one length of all arrays of a column if it is 1 to ``MAX_KEYS`` and none is missing, else None."""
    x = F.size(column)
    met = df.agg(F.min(x).alias("low"), F.max(x).alias("high"), F.count(F.col(column)).alias("there"), F.count(F.lit(1)).alias("rows")).first()
    same = met["rows"] and met["there"] == met["rows"] and met["low"] == met["high"] and 1 <= met["low"] <= MAX_KEYS
    return met["low"] if same else None


def pack_flags(flags) -> object:
    """An array of booleans as an array of bytes, eight flags a byte, the first in the lowest bit; null if one is missing.

    Pays from eight flags on; the length stays with the column, as a byte may be filled up.
    """
    byte = lambda j: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda s, k: s + F.when(F.coalesce(F.get(flags, (j * 8 + k).cast("int")), F.lit(False)), F.expr("1")).otherwise(0) * F.pow(F.lit(2), k).cast("int"))
    packed = F.when(F.size(flags) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(flags) - 1) / 8).cast("int")), byte))
    return F.when(F.forall(flags, lambda x: x.isNotNull()), packed)


def unpack_flags(packed, length) -> object:
    bit = lambda i: F.floor(F.get(packed, F.floor(i / 8).cast("int")) / F.pow(F.lit(2), F.pmod(i, F.lit(8)))) % 2 == 1
    return F.when(length == 0, F.array().cast("array<boolean>")).otherwise(F.transform(F.sequence(F.lit(0), length - 1), bit))


def enum_index(df: DataFrame, column: str) -> DataFrame:
    """(value, index): the distinct values in sorted order, from 1. One row a value: a type list, not data."""
    from pyspark.sql import Window

    return df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().withColumn("index", F.row_number().over(Window.orderBy("value")).cast("long"))


def tuple_columns(df: DataFrame, column: str, width: int) -> DataFrame:
    """Positional columns "1".."width" in place of an array column, in number order, not text order."""
    return df.select(*[c for c in df.columns if c != column], *[F.col(column)[i].alias(str(i + 1)) for i in range(width)])


def tuple_restore(df: DataFrame, width: int, name: str) -> DataFrame:
    own = [str(i + 1) for i in range(width)]
    return df.select(*[c for c in df.columns if c not in own], F.array(*[F.col(f"`{c}`") for c in own]).alias(name))


def union_keys(*frames: DataFrame) -> DataFrame:
    """Rows of all frames over the union of their keys, missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def split_struct(df: DataFrame, column: str) -> DataFrame:
    """A struct column as component columns."""
    fields = df.schema[column].dataType.fieldNames()
    return df.select(*[c for c in df.columns if c != column], *[F.col(column).getField(f).alias(f"{column}_{f}") for f in fields])


def struct_dictionary(df: DataFrame, column: str, order: str) -> DataFrame:
    """(value struct, id, uses): distinct structs by exact components, numbered by first appearance."""
    from pyspark.sql import Window

    seen = df.groupBy(column).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("uses"))
    return seen.select(column, F.row_number().over(Window.orderBy("first")).cast("long").alias("id"), "uses")

"""Exact column statistics in one wide aggregate, and most frequent values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "other"


def as_number(name: str, dtype: T.DataType):
    """A column as double for numeric statistics, null for other kinds; times count in microseconds."""
    c = F.col(f"`{name}`")
    kind = kind_of(dtype)
    if kind in ("integer", "double"):
        return c.cast("double")
    if kind == "time":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(`{name}` as timestamp_ntz))").cast("double")
    return F.lit(None).cast("double")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long format, one row a column: rows, nulls, nans, distinct_values, min and max (number or string), top_count.

    All counts come from one aggregate over one scan, besides the value counts that top_count needs.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    numbers = {c: as_number(c, fields[c]) for c in columns}
    texts = {c: F.col(f"`{c}`") if kind_of(fields[c]) == "string" else F.lit(None).cast("string") for c in columns}
    wide = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        nan = F.isnan(f"`{c}`") if kind_of(fields[c]) == "double" else F.lit(False)
        wide += [
            F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"nulls{i}"),
            F.sum(F.coalesce(nan, F.lit(False)).cast("long")).alias(f"nans{i}"),
            F.min(numbers[c]).alias(f"low{i}"),
            F.max(numbers[c]).alias(f"high{i}"),
            F.min(texts[c]).alias(f"first{i}"),
            F.max(texts[c]).alias(f"last{i}"),
        ]
    one = df.agg(*wide)
    lines = [F.struct(F.lit(c).alias("column"), "rows", *[F.col(f"{k}{i}").alias(n) for k, n in (("nulls", "nulls"), ("nans", "nans"), ("low", "min_number"), ("high", "max_number"), ("first", "min_text"), ("last", "max_text"))]) for i, c in enumerate(columns)]
    flat = one.select(F.inline(F.array(*lines)))
    # Value counts in long format; distinct and top follow from them without a second kind of pass.
    cells = [F.struct(F.lit(c).alias("column"), F.coalesce(numbers[c].cast("string"), F.col(f"`{c}`").cast("string")).alias("value")) for c in columns]
    counts = df.select(F.inline(F.array(*cells))).where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"), F.max("n").alias("top_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return flat.join(tops, "column", "left").select("column", F.col("rows").cast("long").alias("rows"), zero("nulls"), zero("nans"), zero("distinct_values"), zero("top_count"), "min_number", "max_number", "min_text", "max_text")


def top_value(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of the most frequent non-null value, ties to the smaller value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "value").limit(1)

"""Per-key field deltas of an event stream, and a sink that applies them.

For each key the last row is kept in state; a new row gives a mask of changed fields and numeric differences. Rows must come
with a rising ``event_id`` a key; a row at or below the last one is late, is not applied, and is counted. A missing value, or NaN, is
equal to another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "user_id long, event_id long, mask long, value_delta double, late long"
STATE = "event_id long, event_type string, value double, late long"


def _delta(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last_id, last_type, last_value, late = state.get if state.exists else (None, None, None, 0)
    rows = pd.concat(list(frames), ignore_index=True).sort_values("event_id", kind="stable", ignore_index=True)
    # A row is late if it is not behind the last one, be that kept in state or earlier in this batch.
    fresh = rows["event_id"] > rows["event_id"].shift()
    fresh.iloc[:1] = True
    if last_id is not None:
        fresh &= rows["event_id"] > last_id
    late_before = late + (~fresh).cumsum()
    rows, late_before = rows[fresh], late_before[fresh]
    old_type, old_value = rows["event_type"].shift(), rows["value"].shift()
    first = pd.Series(False, rows.index)
    if len(rows) and last_id is not None:
        old_type.iloc[0], old_value.iloc[0] = last_type, last_value
    elif len(rows):
        first.iloc[0] = True
    differ = lambda a, b: ((a != b) & ~(a.isna() & b.isna())).astype("int64")
    mask = (differ(rows["event_type"], old_type) + 2 * differ(rows["value"], old_value)).mask(first, 3)
    delta = (rows["value"] - old_value).mask(first)
    if len(rows):
        end = rows.iloc[-1]
        last_id, last_type, last_value = end["event_id"], end["event_type"], end["value"]
    if last_id is not None:
        kept = lambda x: None if pd.isna(x) else x
        value = kept(last_value)
        state.update((int(last_id), kept(last_type), None if value is None else float(value), int(late + (~fresh).sum())))
    yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "mask": mask, "value_delta": delta, "late": late_before})


def stream_deltas(events: DataFrame) -> DataFrame:
    """``events`` is a stream of (user_id, event_id, ts, event_type, value)."""
    return events.select("user_id", "event_id", "event_type", "value").groupBy("user_id").applyInPandasWithState(_delta, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def batch_deltas(events: DataFrame) -> DataFrame:
    """The same figures from a bounded table, by windows."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    first = F.lag("event_id").over(w).isNull()
    mask = (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))).cast("long") + 2 * (~F.col("value").eqNullSafe(F.lag("value").over(w))).cast("long")
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    return events.select("user_id", "event_id", F.when(first, 3).otherwise(mask).cast("long").alias("mask"), (cents - F.lag(cents).over(w)).alias("delta_cents"))


def run_once(spark: SparkSession, path: str, target: str, checkpoint: str) -> DataFrame:
    """Drains the files at ``path`` through the stateful operator into Parquet at ``target`` and reads it."""
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema)
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(name).isFile():
        # A stream watches folders: the one file is picked out of its folder.
        source, path = source.option("pathGlobFilter", name.getName()), name.getParent().toString()
    query = (
        stream_deltas(source.parquet(path))
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(OUTPUT).parquet(target)


def apply_batch(table_path: str, keys: list[str]):
    """A foreachBatch sink: the newest row of each key replaces the kept one; rerunning a batch changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        target = f"{table_path}/epoch={epoch}"
        newest = batch.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("event_id").desc()))).where("_r = 1").drop("_r")
        if epoch > 0:
            old = spark.read.parquet(f"{table_path}/epoch={epoch - 1}")
            newest = newest.unionByName(old.join(newest.select(*keys), keys, "left_anti"))
        newest.write.mode("overwrite").parquet(target)

    return write

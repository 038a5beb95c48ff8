"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Only DataFrame and SQL functions run here. The steps:

1. ``source_targets``: every source's share of all words by weight, stopped at ``max_repeat`` times its
   own size; the excess goes to the others by weight (water filling, closed form over prefix sums).
2. ``apportion``: the mix has ``total / block_words`` blocks; sources get blocks by the highest
   quotients target / (2 j + 1). Within a source its shards get its blocks the same way, by size.
3. Within a shard the documents lie on a tape in an order drawn from ``seed``; the tape is cut into blocks.
   A quota of q blocks takes the whole tape q div n times and the first q mod n blocks once more, so
   the selection is a running sum and no row is made for a block.

A source that holds most rows is split into shards of about ``shard_docs`` rows, or into as many shards as a shard has rows where
that is more than ``many_shards``, so no window sees a whole source at any size; the join that tells rows their source's plan is salted.

Defined results: null text has size 0; null source is a source of its own, ordered last; documents of
size 0 are kept with taken 0; repeated rows each count; an empty table gives no rows; extra columns
pass through (this module's own helper columns start with ``_mix``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
#: Parts into which a source's rows are dealt to meet their source's plan.
SALTS = 64


def word_count(text: str = "text"):
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """One row a source (source, source_size) -> the same with weight and target.

    Sorted by max_repeat * size / weight, the sources that stop at their limit come first; the level of the
    others is the largest of (total - limits before) / (weights from here on).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(w) for w in weights])
    ranked = totals.withColumn("weight", F.element_at(table, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * max_repeat
    by_ratio = Window.orderBy((limit / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))) / F.sum("weight").over(onward)
    return (
        ranked.withColumn("_mix_level", level)
        .withColumn("_mix_level", F.max("_mix_level").over(everything))
        .withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.col("_mix_level")))
        .drop("_mix_level")
    )


def apportion(items: DataFrame, group: list[str], item: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague: gives each group's ``seats`` to its items by the highest quotients weight / (2 j + 1).

    An item starts from round(weight / (total / seats)); only quotients near that count are listed, few
    enough that all lists of a group hold at most about ten rows an item, and surely all that can matter.
    Ties go to the smaller ``item``. Items without weight get none.
    """
    w = Window.partitionBy(*group)
    live = F.col(weight) > 0
    near = (
        items.withColumn("_mix_total", F.sum(weight).over(w).cast("double"))
        .withColumn("_mix_near", F.when(live, F.floor(F.col(weight) * F.col(seats) / F.col("_mix_total") + 0.5)).otherwise(0).cast("long"))
        .withColumn("_mix_off", F.abs(F.sum("_mix_near").over(w) - F.col(seats)))
        .withColumn("_mix_items", F.count(F.lit(1)).over(w))
    )
    slack = F.ceil(F.col("_mix_near") * (F.col("_mix_off") + F.col("_mix_items")) / F.greatest(F.col(seats), F.lit(1))) + 2
    near = near.withColumn("_mix_low", F.greatest(F.lit(0), F.col("_mix_near") - slack).cast("long")).withColumn("_mix_high", (F.col("_mix_near") + slack).cast("long"))
    rest = F.col(seats) - F.sum("_mix_low").over(w)
    listed = (
        near.withColumn("_mix_rest", rest)
        .where(live & (F.col(seats) > 0))
        .withColumn("_mix_j", F.explode(F.sequence(F.col("_mix_low"), F.col("_mix_high"))))
        .withColumn("_mix_rank", F.row_number().over(w.orderBy((F.col(weight) / (2 * F.col("_mix_j") + 1)).desc(), *[F.col(c).asc_nulls_last() for c in item])))
    )
    won = listed.groupBy(*group, *item).agg((F.first("_mix_low") + F.sum((F.col("_mix_rank") <= F.col("_mix_rest")).cast("long"))).alias(out))
    return won


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3, block_words: int = 64, shard_docs: int = 2000, many_shards: int = 4096, seed: int = 17) -> DataFrame:
    """Adds source_size, target and taken to rows that have doc_id, source and size.

    taken is the number of words that the mix takes of a document, repeats counted, at most
    ``max_repeat`` times its size. The same rows and seed give the same result in any partitioning.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    draw = F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    # Rows of one id and size, if their other columns differ, are told apart by a hash of these.
    rows = docs.withColumns({"_mix_key": key, "_mix_draw": draw, "_mix_tie": F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in sorted(docs.columns)])})
    number = F.conv(F.substring("_mix_draw", 1, 8), 16, 10).cast("long")

    totals = rows.groupBy("_mix_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_mix_docs"))
    targets = source_targets(totals, weights, max_repeat).withColumn("_mix_shards", F.least(F.greatest(F.lit(many_shards), F.ceil(F.sqrt("_mix_docs"))), F.ceil(F.col("_mix_docs") / shard_docs)).cast("long"))
    targets = targets.withColumn("_mix_one", F.lit(1)).withColumn("_mix_seats", F.floor(F.sum("source_size").over(Window.partitionBy("_mix_one")) / block_words + 0.5).cast("long"))
    quota = apportion(targets, ["_mix_one"], ["_mix_key"], "target", "_mix_seats", "_mix_quota").drop("_mix_one")
    plan = targets.join(quota, "_mix_key", "left").select("_mix_key", "source_size", "target", "_mix_shards", F.coalesce("_mix_quota", F.lit(0)).alias("_mix_quota"))

    salted = plan.withColumn("_mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = rows.withColumn("_mix_salt", F.pmod(number, F.lit(SALTS)).cast("int")).join(salted, ["_mix_key", "_mix_salt"]).withColumn("_mix_shard", F.pmod(number, F.col("_mix_shards")))
    shards = placed.groupBy("_mix_key", "_mix_shard", "_mix_quota").agg(F.sum("size").alias("_mix_words"))
    shard_quota = apportion(shards, ["_mix_key", "_mix_quota"], ["_mix_shard"], "_mix_words", "_mix_quota", "_mix_blocks")
    shard_plan = shards.join(shard_quota, ["_mix_key", "_mix_quota", "_mix_shard"], "left").select("_mix_key", "_mix_shard", "_mix_words", F.coalesce("_mix_blocks", F.lit(0)).alias("_mix_blocks"))

    tape = Window.partitionBy("_mix_key", "_mix_shard").orderBy("_mix_draw", "doc_id", "size", "_mix_tie").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("_mix_end") - F.col("size")
    there = F.greatest(F.ceil(F.col("_mix_words") / block_words), F.lit(1))
    whole, once_more = F.floor(F.col("_mix_blocks") / there), F.pmod(F.col("_mix_blocks"), there) * block_words
    taken = F.least(F.col("size") * max_repeat, whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), once_more - start)))
    return (
        placed.withColumn("_mix_end", F.sum("size").over(tape))
        .join(shard_plan, ["_mix_key", "_mix_shard"])
        .withColumn("taken", F.coalesce(taken, F.lit(0)).cast("long"))
        .select(*[c for c in docs.columns if c not in ("source_size", "target", "taken")], F.col("source_size").cast("long").alias("source_size"), "target", "taken")
    )

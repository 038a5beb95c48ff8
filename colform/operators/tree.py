"""Object trees as node tables: flatten in pre-order, split references, rebuild with a problem list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colform.session import checkpointed
from colform.sources.ordering import with_order


def _resolved(nodes: DataFrame) -> DataFrame:
    """(id, parent, up, path): the ids from the root, or from below ``up`` where the way to a root ends in a cycle or at no node.

    Each round a node takes over the way of the node that its own way ends at, so ways double: a chain of a thousand nodes needs ten
    rounds. A way whose upper end is no node ends there. Rounds are checkpointed tables.
    """
    known = nodes.select(F.col("id").alias("up"), F.lit(True).alias("_known")).distinct()
    start = nodes.select("id", "parent", F.col("parent").alias("up"), F.array("id").alias("path")).join(known, "up", "left")
    state = checkpointed(start.select("id", "parent", "up", "path", (F.col("up").isNotNull() & F.col("_known").isNull()).alias("cut")))
    left = None
    while True:
        going = state.where("up is not null and not cut")
        if (now := going.count()) in (0, left):  # what no round shortens any more hangs on a cycle
            return state
        left = now
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("cut").alias("_cut"))
        moved = going.join(above, "up").select("id", "parent", F.col("_up").alias("up"), F.concat("_path", "path").alias("path"), F.col("_cut").alias("cut"))
        state = checkpointed(moved.unionByName(state.where("up is null or cut")))


def flatten_tree(nodes: DataFrame) -> DataFrame:
    """(id, parent) -> (id, parent, depth, path) of the nodes that hang on a root, at any depth.

    ``path`` holds the ids from the root, so its order is the pre-order. ``tree_problems`` names the other nodes.
    """
    return _resolved(nodes).where("up is null").select("id", "parent", (F.size("path") - 1).alias("depth"), "path")


def tree_problems(nodes: DataFrame) -> DataFrame:
    """(id, problem) of the nodes that hang on no root: an ancestor is missing, or they are in or below a cycle."""
    return _resolved(nodes).where("up is not null").select("id", F.when(F.col("cut"), "an ancestor is missing").otherwise("in or below a cycle").alias("problem"))


def number_tree(flat: DataFrame) -> DataFrame:
    """Adds pre-order numbers from 1 and the parent's number (0 for roots)."""
    ordered = with_order(flat, ["path"]).withColumn("number", F.col("_rn") + 1)
    parents = ordered.select(F.col("id").alias("parent"), F.col("number").alias("parent_number"))
    return ordered.join(parents, "parent", "left").select("id", "depth", "number", F.coalesce("parent_number", F.lit(0)).cast("long").alias("parent_number"))


def split_references(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (from_id, to_id) marked internal if the target is in the tree, external otherwise."""
    inside = nodes.select(F.col("id").alias("to_id"), F.lit(True).alias("_in"))
    return edges.join(inside, "to_id", "left").withColumn("internal", F.col("_in").isNotNull()).drop("_in")


def capture(properties: DataFrame, defaults: DataFrame) -> DataFrame:
    """(id, class, name, value) that differ from the class defaults (class, name, value)."""
    return properties.join(defaults.withColumnRenamed("value", "_default"), ["class", "name"], "left").where(~F.col("value").eqNullSafe(F.col("_default"))).drop("_default")


def rebuild(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, parent id) from numbers, and the problems: numbers without a node."""
    by_number = numbered.select(F.col("number").alias("parent_number"), F.col("id").alias("parent"))
    joined = numbered.join(by_number, "parent_number", "left")
    return joined.select("id", "parent"), joined.where("parent_number <> 0 and parent is null").select("id", F.lit("parent is missing").alias("problem"))

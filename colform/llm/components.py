"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace


def components(links: DataFrame, work: Workspace, name: str, before: DataFrame | None = None) -> DataFrame:
    """(a, b) links -> (node, label), label the smallest node of the component. ``before`` is the result for links that are already in.

    Each round every node points at its smallest neighbour if that is smaller, pointers are followed to their ends, and the links go
    on between these ends only. What is left of a node after a round is the smallest one around it, so that rounds
    are few, and links within what has grown together are gone; each link is read once or a few times, not in every round.
    Rounds are written tables; a node with very many links is combined before the shuffle.
    """
    open_ = _between(links.select("a", "b"), before)
    steps = f"{name}-steps"
    done: list[DataFrame] = []
    while True:
        round_ = len(done)
        open_ = work.put(open_.distinct(), f"{steps}/links{round_}", small=True)
        if not open_.limit(1).count():
            break
        both = open_.unionByName(open_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label"))
        done.append(_followed(work.put(ends, f"{steps}/ends{round_}-0", small=True), work, f"{steps}/ends{round_}"))
        open_ = _between(open_, done[-1])
    if not done:
        return before if before is not None else work.put(links.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0), name, small=True)
    labels = done[-1]
    for earlier in reversed(done[:-1]):
        labels = _through(earlier, labels)
    if before is not None:
        labels = _through(before, labels).unionByName(labels.join(before, "node", "left_anti"))
    labels = work.put(labels, name, small=True)
    work.drop(steps)
    return labels


def _through(first: DataFrame, then: DataFrame) -> DataFrame:
    """The labels of ``first``, replaced by those that ``then`` has for them."""
    return first.join(then.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left").select("node", F.coalesce("far", "label").alias("label"))


def _between(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The links between the labels of their ends, smaller first, without those inside one."""
    for c in ("a", "b") if labels is not None else ():
        links = links.join(labels.select(F.col("node").alias(c), F.col("label").alias("far")), c, "left").withColumn(c, F.coalesce("far", c)).drop("far")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")


def _followed(ends: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Labels that are their own labels; a label is never larger than its node, so there is no cycle."""
    step = 0
    while True:
        near = ends.select(F.col("node").alias("label"), F.col("label").alias("near"))
        far = ends.select(F.col("node").alias("near"), F.col("label").alias("far"))
        # Three steps at once; two that lead as far as three lead to the end.
        new = work.put(ends.join(near, "label").join(far, "near").select("node", "near", F.col("far").alias("label")), f"{name}-{step + 1}", small=True)
        changed = new.where("near <> label").limit(1).count()
        work.drop(f"{name}-{step}")
        ends, step = new.select("node", "label"), step + 1
        if not changed:
            return ends

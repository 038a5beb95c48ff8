"""Document fingerprints: threshold-scaled sketches of word shingles, with DataFrame and SQL functions only.

A text's shingles are its runs of ``width`` lower-cased words (all its words as one if it has fewer). The sketch
keeps every distinct 64-bit shingle hash below the fixed fraction 2^-``bits`` of the hash range; a text
with words but no hash below it keeps its smallest hash, so that only texts without words have an empty sketch.
Sketches of one fraction can be merged by union, and the share of common hashes estimates resemblance or containment
however unequal the texts are.

Defined results: null is an empty text, whose fingerprint is the empty string; two empty sketches have likeness 1, an
empty and another 0; equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace

BITS = 3
WIDTH = 5


def sketch(text: str, bits: int = BITS, width: int = WIDTH) -> Column:
    """Sorted array of the kept hashes of a text expression. The one-element arrays bind values that must be computed once."""
    words = rf"filter(split(lower({text}), '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
    hashes = f"if(size(w) < {width}, if(size(w) = 0, array(), array(xxhash64(w))), transform(sequence(1, size(w) - {width - 1}), i -> xxhash64(slice(w, i, {width}))))"
    kept = f"filter(h, x -> shiftrightunsigned(x, {64 - bits}) = 0)"
    floor = f"transform(array({kept}), k -> if(size(k) = 0 and size(h) > 0, array(array_min(h)), array_sort(array_distinct(k))))[0]"
    return F.expr(f"transform(transform(array({words}), w -> {hashes}), h -> {floor})[0]")


def as_text(hashes: str) -> Column:
    """A sketch as a string: 16 hexadecimal digits a hash."""
    return F.expr(f"array_join(transform({hashes}, x -> lpad(lower(hex(x)), 16, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """Estimated resemblance, 0 to 1."""
    return F.expr(f"transform(array(size(array_union({a}, {b}))), n -> if(n = 0, 1D, size(array_intersect({a}, {b})) / cast(n as double)))[0]")


def containment(a: str, b: str) -> Column:
    """Estimated share of a's shingles that b has too, 0 to 1."""
    return F.expr(f"if(size({a}) = 0, 1D, size(array_intersect({a}, {b})) / cast(size({a}) as double))")


def with_next(docs: DataFrame, block_bytes: int = 16 << 20, work: Workspace | None = None) -> DataFrame:
    """(doc_id, text, tie, block, own): rows in blocks by ascending doc_id, each after a copy (own = 0) of the row that precedes the block.

    A window in a block then sees every row's next document, which is the one before in this order: next in descending doc_id, and the
    first after the last. Rows are dealt out by ranges of doc_id and a hash of the text and written, so that a block is a partition and one
    row a block passes through one task. Rows without id come last in descending order; rows of equal id are ordered by that hash, ``tie``.
    """
    work = work or Workspace(docs.sparkSession, "sketch")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    blocks = max(1, (rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0) // block_bytes)
    dealt = rows.repartitionByRange(blocks, F.col("doc_id").asc_nulls_first(), "tie").withColumn("block", F.spark_partition_id())
    rows = work.put(dealt, "dealt")
    work.release()

    last = rows.groupBy("block").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("there"), "doc_id", "tie", "text")).alias("m")).select("block", "m.doc_id", "m.tie", "m.text")
    order = Window.orderBy("block")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Blocks in order know the next one by a window over their numbers alone.
    follow = last.select("block").withColumn("to", F.coalesce(F.lead("block").over(order), F.first("block").over(everything)))
    ghosts = last.join(follow, "block").select("doc_id", "text", "tie", F.col("to").alias("block"), F.lit(0).alias("own"))
    return rows.withColumn("own", F.lit(1)).select("doc_id", "text", "tie", "block", "own").unionByName(ghosts).repartition("block")


def neighbours() -> Window:
    return Window.partitionBy("block").orderBy("own", F.col("doc_id").asc_nulls_first(), "tie", "text")


def fingerprints(docs: DataFrame, bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """Fingerprints of every text and of its edited text, with the likeness to that and to the next document."""
    rows = with_next(docs).withColumn("marks", sketch("text", bits, width))
    rows = rows.withColumn("next_text", F.lag("text").over(neighbours())).withColumn("next_marks", F.lag("marks").over(neighbours())).where("own = 1")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("transform(array(cast(floor(n_chars / 3) as int)), c -> concat(left(text, cast(n_chars as int) - c), left(next_text, c)))[0]"))
    rows = rows.withColumn("edited_marks", sketch("edited", bits, width))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("marks").alias("fingerprint"),
        as_text("edited_marks").alias("edited_fingerprint"),
        likeness("marks", "edited_marks").alias("near_edited"),
        likeness("marks", "next_marks").alias("near_next"),
    )

"""Change sets between two snapshots, and their exact application."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colform.functions import costs as C
from colform.options import EncodeOptions

#: Fixed values of the format.
SET, REMOVE, ROW = 1, 2, 4
GUARD_FRACTION = 0.5
#: Fields that a row's mask of changed fields, a long, has room for.
MASK_BITS = 63


class BaselineMismatch(ValueError):
    pass


def fingerprint(df: DataFrame, keys: list[str]) -> int:
    """Order-independent hash of a snapshot's rows, missing values apart from all texts: one aggregate that no number of rows overflows."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    row = F.xxhash64(*[x for c in columns for x in (c.isNull(), c.cast("string"))])
    sums = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x")).first()
    digest = hashlib.sha256(f"{sorted(df.columns)} {sums['n']} {sums['s']} {sums['x']}".encode()).digest()
    return int.from_bytes(digest[:8], "big") >> 1


def diff(base: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """One row a changed key: op (SET new, REMOVE gone, ROW changed), mask of changed fields, new values n_<field>.

    One full outer join on the key; a field of both snapshots is compared as ``field_changed`` says.
    """
    fields = [c for c in base.columns if c not in keys]
    if len(fields) > MASK_BITS:
        raise ValueError(f"a change set has at most {MASK_BITS} fields beside the key")
    b = base.select(*keys, F.lit(True).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in fields])
    n = current.select(*keys, F.lit(True).alias("_n"), *[F.col(c).alias(f"n_{c}") for c in fields])
    kinds = dict(base.dtypes)
    changed = lambda c: C.field_changed(F.col(f"b_{c}"), F.col(f"n_{c}"), kinds[c] in ("float", "double"))
    mask = sum((F.when(changed(c), F.lit(1 << i)).otherwise(0) for i, c in enumerate(fields)), F.lit(0)).cast("long")
    joined = b.join(n, keys, "full")
    op = F.when(F.col("_b").isNull(), SET).when(F.col("_n").isNull(), REMOVE).otherwise(ROW)
    out = joined.withColumn("op", op).withColumn("mask", F.when(F.col("op") == ROW, mask).otherwise(F.lit(0)).cast("long"))
    return out.where((F.col("op") != ROW) | (F.col("mask") != 0)).select(*keys, "op", "mask", *[f"n_{c}" for c in fields], *[f"b_{c}" for c in fields])


def patch(base: DataFrame, changes: DataFrame, keys: list[str], baseline: int | None = None) -> DataFrame:
    """Applies a change set: removed rows go, masked fields change, new rows come; refuses a base of another fingerprint."""
    if baseline is not None and fingerprint(base, keys) != baseline:
        raise BaselineMismatch("the change set belongs to another baseline")
    fields = [c for c in base.columns if c not in keys]
    own = changes.select(*keys, "op", "mask", *[f"n_{c}" for c in fields])
    joined = base.join(own.where(F.col("op") != SET), keys, "left").where(F.col("op").isNull() | (F.col("op") != REMOVE))
    changed = [F.when(F.coalesce(F.col("mask"), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for i, c in enumerate(fields)]
    return joined.select(*keys, *changed).unionByName(own.where(F.col("op") == SET).select(*keys, *[F.col(f"n_{c}").alias(c) for c in fields]))


def changed_fraction(base: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    changes = diff(base, current, keys).where(F.col("op") == ROW).agg(F.count(F.lit(1)).alias("changed"))
    return changes.crossJoin(base.agg(F.count(F.lit(1)).alias("rows"))).withColumn("keep_patch", F.col("changed") < GUARD_FRACTION * F.col("rows"))


def row_set_costs(changes: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes of the changed rows' set as gaps or bitmap, and of the masks as one, packed or varints."""
    from colform.operators.forms import _gaps

    rows = positions.agg(F.count(F.lit(1)).alias("rows"))
    hit = positions.join(changes.where(F.col("op") == ROW).select(*keys, "mask"), keys).select("_rn", "mask")
    gaps = _gaps(hit).agg(
        F.count(F.lit(1)).alias("changed"), F.sum(C.varint_width(F.col("gap"))).alias("gap_bytes"), F.countDistinct("mask").alias("masks"),
        F.max("mask").alias("widest_mask"), F.sum(C.varint_width(F.col("mask"))).alias("mask_varint_bytes"),
    ).crossJoin(rows)
    bitmap = F.floor((F.col("rows") + 7) / 8).cast("long")
    packed = 1 + C.packed_bytes(F.col("changed"), C.bits_for(F.col("widest_mask")))
    form = F.when(F.col("masks") == 1, "uniform").when(packed < F.col("mask_varint_bytes"), "packed").otherwise("varint")
    return gaps.select("rows", "changed", F.col("gap_bytes").cast("long").alias("gap_bytes"), bitmap.alias("bitmap_bytes"), (F.col("gap_bytes") < bitmap).alias("by_gaps"), form.alias("mask_form"))


def value_form_stats(changes: DataFrame, fields: list[str]) -> DataFrame:
    """Per integer field: changed values, bits as absolute numbers and as differences to the baseline."""
    lines = [F.struct(F.lit(c).alias("field"), F.col(f"n_{c}").cast("long").alias("n"), F.col(f"b_{c}").cast("long").alias("b"), F.col("mask").bitwiseAND(F.lit(1 << i)).alias("bit")) for i, c in fields_with_bits(fields)]
    flat = changes.where(F.col("op") == ROW).select(F.inline(F.array(*lines))).where("bit <> 0")
    found = flat.groupBy("field").agg(F.count(F.lit(1)).alias("changed"), F.max(C.zigzag(F.col("n"))).alias("w"), F.max(C.zigzag(F.col("n") - F.col("b"))).alias("d"))
    return found.select("field", "changed", C.bits_for(F.col("w")).alias("absolute_bits"), C.bits_for(F.col("d")).alias("delta_bits")).withColumn("by_delta", F.col("delta_bits") < F.col("absolute_bits"))


def fields_with_bits(fields: list[str | tuple[int, str]]) -> list[tuple[int, str]]:
    return [f if isinstance(f, tuple) else (i, f) for i, f in enumerate(fields)]


# --- Bytes, reports and the choice between a change set and the whole --------------------------------------------


def value_bytes(x: Column, kind: str) -> Column:
    """Modelled bytes of a tagged value: whole numbers by width, texts by length, other numbers and times nine, null and flags one."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        cost = C.integer_cost(x.cast("long"))
    elif kind in ("string", "binary"):
        cost = (F.octet_length(x) + 2).cast("long")
    elif kind == "boolean":
        cost = F.lit(1).cast("long")
    elif kind.startswith(("array", "map", "struct")):
        cost = (F.octet_length(F.to_json(F.struct(x.alias("v")))) + 2).cast("long")
    else:
        cost = F.lit(9).cast("long")
    return F.when(x.isNull(), F.lit(1)).otherwise(cost).cast("long")


def inspect_diff(changes: DataFrame, keys: list[str]) -> DataFrame:
    """(op, field, changed, bytes) of a change set: new rows by field, changed fields of kept rows, and the keys of each kind of change.

    Bytes of the keys hold the op, and the mask of a changed row. One aggregate over the change set.
    """
    kinds = dict(changes.dtypes)
    fields = [c[2:] for c in changes.columns if c.startswith("n_")]
    bit = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    key_cost = sum((value_bytes(F.col(k), kinds[k]) for k in keys), F.lit(1))
    names = {"set": SET, "remove": REMOVE, "row": ROW}
    lines = []
    for name, op in names.items():
        own = F.col("op") == op
        lines.append((name, "", own, key_cost + C.varint_width(F.col("mask")) if op == ROW else key_cost))
        lines += [(name, f, own if op == SET else own & bit(i), value_bytes(F.col(f"n_{f}"), kinds[f"n_{f}"])) for i, f in enumerate(fields) if op != REMOVE]
    aggs = []
    for i, (_, _, holds, cost) in enumerate(lines):
        aggs += [F.count(F.when(holds, 1)).alias(f"c{i}"), F.coalesce(F.sum(F.when(holds, cost)), F.lit(0)).cast("long").alias(f"b{i}")]
    table = F.array(*[F.struct(F.lit(op).alias("op"), F.lit(f).alias("field"), F.col(f"c{i}").alias("changed"), F.col(f"b{i}").alias("bytes")) for i, (op, f, _, _) in enumerate(lines)])
    return changes.agg(*aggs).select(F.inline(table))


def snapshot_bytes(df: DataFrame) -> DataFrame:
    """(rows, bytes) of all rows as tagged values."""
    cost = sum((value_bytes(F.col(f"`{c}`"), k) for c, k in df.dtypes), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(cost), F.lit(0)).cast("long").alias("bytes"))


@dataclass
class Update:
    """What is sent to a holder of the baseline: a change set with the baseline's fingerprint, or the whole new snapshot."""

    rows: DataFrame
    patch_bytes: int
    full_bytes: int
    baseline: int | None


def is_patch(update: Update) -> bool:
    return update.baseline is not None


def guarded_diff(base: DataFrame, current: DataFrame, keys: list[str], options: EncodeOptions = EncodeOptions()) -> Update:
    """The change set if its modelled bytes are fewer than those of the whole snapshot, else the snapshot; always the change set
    without ``options.guard_diff``."""
    changes = diff(base, current, keys)
    patch_bytes = inspect_diff(changes, keys).agg(F.sum("bytes")).first()[0]
    full_bytes = snapshot_bytes(current).first()["bytes"]
    if patch_bytes < full_bytes or not options.guard_diff:
        return Update(changes, patch_bytes, full_bytes, fingerprint(base, keys))
    return Update(current, patch_bytes, full_bytes, None)


def apply_update(base: DataFrame, update: Update, keys: list[str]) -> DataFrame:
    return patch(base, update.rows, keys, update.baseline) if is_patch(update) else update.rows


# --- Structs: changes of single fields at any depth ----------------------------------------------------------------


def _leaves(fields: list[T.StructField], path: tuple[str, ...] = ()) -> tuple[list[tuple[str, ...]], list[tuple[str, ...]]]:
    """Paths of all fields that are no structs, and of all structs."""
    leaves, structs = [], []
    for f in fields:
        if isinstance(f.dataType, T.StructType):
            below = _leaves(f.dataType.fields, (*path, f.name))
            leaves, structs = leaves + below[0], [*structs, (*path, f.name), *below[1]]
        else:
            leaves.append((*path, f.name))
    return leaves, structs


def _at(path: tuple[str, ...]) -> Column:
    c = F.col(f"`{path[0]}`")
    for name in path[1:]:
        c = c.getField(name)
    return c


def opened(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every field inside structs as a column of its own (c0, c1, ..), and whether each struct is there (s0, s1, ..), so that ``diff``
    gives changes of single inner fields."""
    leaves, structs = _leaves([f for f in df.schema.fields if f.name not in keys])
    return df.select(*keys, *[_at(p).alias(f"c{i}") for i, p in enumerate(leaves)], *[_at(p).isNotNull().alias(f"s{i}") for i, p in enumerate(structs)])


def closed(flat: DataFrame, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The inverse of ``opened`` for a table of that schema."""
    leaves, structs = _leaves([f for f in schema.fields if f.name not in keys])
    leaf, struct = ({p: f"{n}{i}" for i, p in enumerate(paths)} for n, paths in (("c", leaves), ("s", structs)))

    def build(f: T.StructField, path: tuple[str, ...]) -> Column:
        if not isinstance(f.dataType, T.StructType):
            return F.col(leaf[path])
        return F.when(F.col(struct[path]), F.struct(*[build(x, (*path, x.name)).alias(x.name) for x in f.dataType.fields]))

    return flat.select(*[F.col(f.name) if f.name in keys else build(f, (f.name,)).alias(f.name) for f in schema.fields])


# --- Whole tables ------------------------------------------------------------------------------------------------


def tables_differ(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    """Whether two snapshots differ in any row: by columns and fingerprints."""
    return sorted(a.dtypes) != sorted(b.dtypes) or fingerprint(a, keys) != fingerprint(b, keys)


def key_sets(base: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """(side, keys): how many keys both snapshots have, only the base, only the current one."""
    b, c = base.select(*keys).distinct(), current.select(*keys).distinct()
    count = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("keys"))
    return count(b.intersect(c), "both").unionByName(count(b.exceptAll(c), "gone")).unionByName(count(c.exceptAll(b), "new"))


#: Fixed values of the format: largest power of ten tried for changed numbers, and largest scaled number that pays.
LARGEST_FACTOR, LARGEST_SCALED = 6, 1056959


def decimal_factors(changes: DataFrame, fields: list[tuple[int, str]]) -> DataFrame:
    """(field, changed, exponent): the smallest power of ten that makes all changed numbers of a field whole, null for none.

    ``fields`` are (bit of the mask, name). -0, values that are not finite and scaled numbers beyond ``LARGEST_SCALED`` refuse a fraction.
    """
    aggs, lines = [], []
    for i, f in fields:
        x = F.col(f"n_{f}").cast("double")
        held = (F.col("op") == ROW) & (F.col("mask").bitwiseAND(F.lit(1 << i)) != 0)
        aggs.append(F.count(F.when(held, 1)).alias(f"c{i}"))
        for k in range(LARGEST_FACTOR + 1):
            scaled = C.round_half_away(x * 10.0**k)
            fits = (scaled / 10.0**k == x) & (F.abs(scaled) <= float(LARGEST_SCALED if k else C.SAFE_INTEGER)) & (x.cast("string") != "-0.0")
            aggs.append(F.count(F.when(held & ~F.coalesce(fits, F.lit(False)), 1)).alias(f"m{i}_{k}"))
        first = F.coalesce(*[F.when(F.col(f"m{i}_{k}") == 0, k) for k in range(LARGEST_FACTOR + 1)])
        lines.append(F.struct(F.lit(f).alias("field"), F.col(f"c{i}").alias("changed"), F.when(F.col(f"c{i}") > 0, first).alias("exponent")))
    return changes.agg(*aggs).select(F.inline(F.array(*lines)))

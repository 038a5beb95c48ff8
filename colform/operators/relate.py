"""Cross-column forms and the choice among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colform.functions import costs as C

MIN_ROWS = 64
MIN_SOURCE_DISTINCT = 3
R_GATE = 0.9
#: Aggregates of one pass over column pairs; more pairs go in several passes, as generated methods are bounded.
PAIRS_A_PASS = 60


def value_bytes(c) -> object:
    return F.octet_length(c.cast("string")) + 2


def mapping_stats(df: DataFrame, source: str, target: str, text_target: bool) -> DataFrame:
    """Functional dependency source -> target with exceptions: distinct counts, exceptions, gates, modelled bytes."""
    pairs = df.groupBy(F.col(source).alias("s"), F.col(target).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("s").orderBy(F.col("n").desc(), "t")))
    found = ranked.agg(
        F.sum("n").alias("rows"), F.countDistinct("s").alias("distinct_source"), F.countDistinct("t").alias("distinct_target"),
        F.sum(F.when(F.col("rank") > 1, F.col("n")).otherwise(0)).alias("exceptions"),
    )
    one_to_one = (F.col("distinct_source") >= MIN_SOURCE_DISTINCT) & (F.col("distinct_source") * 2 <= F.col("rows")) & (F.col("distinct_target") * 2 <= F.col("rows")) & (F.col("exceptions") * 10 <= F.col("rows"))
    gate = F.col("distinct_source") <= 4 * F.col("distinct_target")
    bits = C.bits_for(F.col("distinct_target"))
    return found.select(F.lit(source).alias("source"), F.lit(target).alias("target"), F.col("rows").cast("long").alias("rows"), "distinct_source", "distinct_target", F.col("exceptions").cast("long").alias("exceptions"), bits.alias("target_bits"), one_to_one.alias("qualifies"), gate.alias("passes_gate"))


def encode_mapping(df: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """(source value -> target value, exceptions with all their columns)."""
    pairs = df.groupBy(source, target).count()
    best = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(source).orderBy(F.col("count").desc(), target))).where("_r = 1").select(source, F.col(target).alias("_mapped"))
    return best, _by_source(df, best, source).where(~F.col(target).eqNullSafe(F.col("_mapped"))).drop("_mapped")


def _by_source(df: DataFrame, looked_up: DataFrame, source: str) -> DataFrame:
    """Each row with what belongs to its source value; rows without one have a group of their own."""
    return df.join(looked_up.withColumnRenamed(source, "_source"), F.col(source).eqNullSafe(F.col("_source")), "left").drop("_source")


def decode_mapping(df: DataFrame, source: str, mapping: DataFrame, exceptions: DataFrame, key: list[str], name: str) -> DataFrame:
    """``df`` lacks the target; ``exceptions`` has ``key`` and the target."""
    odd = exceptions.select(*key, F.col(name).alias("_odd"), F.lit(True).alias("_is_odd"))
    return _by_source(df, mapping, source).join(odd, key, "left").withColumn(name, F.when(F.col("_is_odd"), F.col("_odd")).otherwise(F.col("_mapped"))).drop("_odd", "_is_odd", "_mapped")


def multimap_stats(df: DataFrame, source: str, target: str) -> DataFrame:
    """1-to-N dependency: the longest list of targets a source has, and code widths."""
    pairs = df.select(F.col(source).alias("s"), F.col(target).alias("t")).distinct()
    runs = pairs.groupBy("s").agg(F.count(F.lit(1)).alias("k"))
    one = runs.agg(F.count(F.lit(1)).alias("distinct_source"), F.max("k").alias("widest"), F.sum("k").alias("listed"))
    one = one.crossJoin(pairs.agg(F.countDistinct("t").alias("distinct_target"))).crossJoin(df.agg(F.count(F.lit(1)).alias("rows")))
    one = one.withColumn("code_bits", C.bits_for_count(F.col("widest"))).withColumn("alone_bits", C.bits_for_count(F.col("distinct_target")))
    good = (F.col("distinct_source") < F.col("distinct_target")) & (F.col("distinct_source") * 2 <= F.col("rows")) & (F.col("code_bits") < F.col("alone_bits"))
    return one.select(F.lit(source).alias("source"), F.lit(target).alias("target"), "rows", "distinct_source", "distinct_target", F.col("widest").cast("long").alias("widest"), "code_bits", "alone_bits", good.alias("accepted"))


def group_frame_stats(df: DataFrame, source: str, target: str) -> DataFrame:
    """Frame of reference for each source value: offset width against the width of the whole span."""
    groups = df.groupBy(F.col(source).alias("s")).agg(F.min(target).alias("low"), F.max(target).alias("high"), F.count(F.lit(1)).alias("n"))
    one = groups.agg(
        F.count(F.lit(1)).alias("distinct_source"), F.max(F.col("high") - F.col("low")).alias("widest"), F.min("low").alias("base"), F.max("high").alias("top"),
        F.sum("n").alias("rows"), F.sum(C.integer_cost(F.col("low"))).alias("references"),
    )
    one = one.withColumn("offset_bits", C.bits_for(F.col("widest"))).withColumn("whole_bits", C.bits_for(F.col("top") - F.col("base")))
    total = C.varint_width(F.col("distinct_source")) + F.col("references") + 1 + C.packed_bytes(F.col("rows"), F.col("offset_bits"))
    return one.select("distinct_source", F.col("rows").cast("long").alias("rows"), F.col("widest").cast("long").alias("widest"), "offset_bits", "whole_bits", total.cast("long").alias("total_bytes"))


def encode_group_frame(df: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    references = df.groupBy(source).agg(F.min(target).alias("reference"))
    return references, _by_source(df, references, source).withColumn("offset", F.col(target) - F.col("reference")).drop("reference", target)


def decode_group_frame(encoded: DataFrame, references: DataFrame, source: str, name: str) -> DataFrame:
    return _by_source(encoded, references, source).withColumn(name, F.col("offset") + F.col("reference")).drop("offset", "reference")


def equality_stats(df: DataFrame, a, b) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum((~a.eqNullSafe(b)).cast("long")).alias("exceptions")).withColumn("accepted", F.col("exceptions") * 10 <= F.col("rows"))


#: A long as a decimal; the product of two has at most 38 digits.
BIG = "decimal(19,0)"


def _product(a, b):
    """Sum of a product of longs, as a double where it has more than 38 digits."""
    return F.coalesce(F.try_sum(a.cast(BIG) * b.cast(BIG)).cast("double"), F.sum(a.cast("double") * b.cast("double")))


def exact_sums(df: DataFrame, columns: list[str], pairs: list[tuple[str, str]]) -> dict:
    """n, sums, and sums of products of integer columns, exact in decimal, in one pass for each ``PAIRS_A_PASS`` pairs.

    Factors are decimals before they are multiplied, so no product of longs overflows; a sum beyond 38 digits falls back to a double.
    """
    out: dict = {}
    for at in range(0, max(len(pairs), 1), PAIRS_A_PASS):
        part = pairs[at : at + PAIRS_A_PASS]
        aggs = [F.count(F.lit(1)).alias("n")]
        if not at:
            aggs += [F.sum(F.col(c).cast(BIG)).alias(f"s_{c}") for c in columns] + [_product(F.col(c), F.col(c)).alias(f"q_{c}") for c in columns]
        aggs += [_product(F.col(a), F.col(b)).alias(f"p_{a}_{b}") for a, b in part]
        out |= df.agg(*aggs).first().asDict()
    return out


def pair_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r_e4, passes): Pearson r, in ten-thousandths, of all pairs of integer columns from exact sums."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    s = exact_sums(df, columns, pairs)
    lines = [(a, b, float(s["n"]), *(float(s[k] or 0) for k in (f"s_{a}", f"s_{b}", f"q_{a}", f"q_{b}", f"p_{a}_{b}"))) for a, b in pairs]
    flat = df.sparkSession.createDataFrame(lines, "a string, b string, n double, sa double, sb double, qa double, qb double, p double")
    va, vb = F.col("qa") / F.col("n") - (F.col("sa") / F.col("n")) * (F.col("sa") / F.col("n")), F.col("qb") / F.col("n") - (F.col("sb") / F.col("n")) * (F.col("sb") / F.col("n"))
    r = F.when((va > 0) & (vb > 0), (F.col("p") / F.col("n") - (F.col("sa") / F.col("n")) * (F.col("sb") / F.col("n"))) / F.sqrt(va * vb)).otherwise(0.0)
    return flat.select("a", "b", F.floor(r * 10000 + 0.5).cast("long").alias("r_e4"), (F.abs(r) >= R_GATE).alias("passes"))


def linear_stats(df: DataFrame, reference, column) -> DataFrame:
    """Integer least squares column ~ slope * reference + intercept, and the width of the residual; two passes."""
    xy = df.select(reference.cast("long").alias("a"), column.cast("long").alias("b"))
    a, b = F.col("a"), F.col("b")
    sums = xy.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(a.cast(BIG)).cast("double").alias("sa"), F.sum(b.cast(BIG)).cast("double").alias("sb"), _product(a, a).alias("saa"), _product(a, b).alias("sab"))
    variance = F.col("saa") - F.col("sa") * F.col("sa") / F.col("n")
    whole = lambda x: F.when(F.abs(x) <= float(C.LARGEST_DIFFERENCED), C.round_half_away(x)).cast("long")
    fit = sums.where(variance > 0).withColumn("slope", whole((F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / variance))
    fit = fit.withColumn("intercept", whole((F.col("sb") - F.col("slope") * F.col("sa")) / F.col("n"))).select("slope", "intercept").where("slope <> 0 and intercept is not null")
    # A residual beyond what differences may hold leaves the column without this form.
    residual = F.expr("try_subtract(b, try_add(try_multiply(slope, a), intercept))")
    residual = F.when(residual.between(-C.LARGEST_DIFFERENCED, C.LARGEST_DIFFERENCED), residual)
    met = xy.crossJoin(F.broadcast(fit)).groupBy("slope", "intercept").agg(F.count(F.lit(1)).alias("rows"), F.count(residual).alias("held"), F.max(C.zigzag(residual)).alias("widest")).where("held = rows")
    met = met.withColumn("bits", C.bits_for(F.col("widest")))
    return met.select("slope", "intercept", "widest", "bits", (2 + C.zigzag_width(F.col("slope")) + C.zigzag_width(F.col("intercept")) + C.packed_bytes(F.col("rows"), F.col("bits"))).cast("long").alias("total_bytes"))


def assign(candidates: list[dict]) -> list[dict]:
    """Greedy links, strongest saving first: one reference a target, no cycles; in dependency order.

    A candidate has source, target, form, saving. Ties go to the smaller target, then source.
    """
    parent: dict[str, str] = {}
    chosen = []
    for c in sorted(candidates, key=lambda c: (-c["saving"], c["target"], c["source"])):
        if c["target"] in parent or c["saving"] <= 0:
            continue
        up = c["source"]
        while up is not None and up != c["target"]:
            up = parent.get(up)
        if up == c["target"]:
            continue
        parent[c["target"]] = c["source"]
        chosen.append(c)

    def depth(name: str) -> int:
        return 1 + depth(parent[name]) if name in parent else 0

    return sorted(chosen, key=lambda c: (depth(c["target"]), c["target"]))


def _further_candidates(df: DataFrame, columns: list[str], rows: int, distinct: dict, alone: dict, entry: dict) -> list[dict]:
    """Equal, multi-mapped, group-framed and linear links of all ordered pairs of columns without null or NaN."""
    kinds = dict(df.dtypes)
    gaps = df.agg(*[F.max(F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("float", "double") else F.lit(False))).alias(c) for c in columns]).first()
    usable = [c for c in columns if gaps[c] is False]
    whole = {c for c in usable if kinds[c] in ("tinyint", "smallint", "int", "bigint")}
    found = []

    def add(a: str, b: str, form: str, cost: float, exceptions: int = 0) -> None:
        found.append({"source": a, "target": b, "form": form, "saving": int(alone[b] - cost), "exceptions": exceptions})

    together = set()
    ordered = sorted(whole)
    if len(ordered) > 1:
        longs = df.select(*[F.col(c).cast("long") for c in ordered])
        together = {frozenset((r["a"], r["b"])) for r in pair_stats(longs, ordered).where("passes").collect()}
    for a in usable:
        for b in usable:
            if a == b:
                continue
            if kinds[a] == kinds[b] and a < b:
                same = equality_stats(df, F.col(a), F.col(b)).first()
                if same["accepted"]:
                    odd = same["exceptions"]
                    for x, y in ((a, b), (b, a)):
                        add(x, y, "equal", 1 + C.py_varint_width(odd) + odd * (C.py_varint_width(rows) + entry[y]), odd)
            if distinct[a] >= MIN_SOURCE_DISTINCT and distinct[a] * 2 <= rows:
                many = multimap_stats(df, a, b).first()
                if many["accepted"]:
                    # Each source's list of the targets it admits, and a code a row.
                    lists = df.select(a, b).distinct().count()
                    add(a, b, "multi-mapped", C.py_varint_width(distinct[b]) + distinct[b] * entry[b] + distinct[a] * C.py_varint_width(many["widest"]) + C.py_packed_bytes(lists, many["alone_bits"]) + 1 + C.py_packed_bytes(rows, many["code_bits"]))
                if b in whole:
                    framed = group_frame_stats(df.select(F.col(a), F.col(b).cast("long").alias(b)), a, b).first()
                    if framed["offset_bits"] < framed["whole_bits"]:
                        add(a, b, "group-framed", framed["total_bytes"])
            if a in whole and b in whole and frozenset((a, b)) in together:
                line = linear_stats(df, F.col(a), F.col(b)).first()
                if line and line["bits"] <= C.WIDEST_PACKED:
                    add(a, b, "linear", line["total_bytes"])
    return found


def correlation_assignment(df: DataFrame, columns: list[str]) -> DataFrame:
    """Links among columns, chosen from the candidates of all forms.

    One aggregate of pair counts gives the exceptions of every mapped pair; the other forms take their figures a pair.
    """
    spark = df.sparkSession
    rows = df.count()
    cells = [F.col(c).cast("string") for c in columns]
    distinct = df.agg(*[F.countDistinct(c).alias(c) for c in columns]).first().asDict()
    widths = df.agg(*[F.sum(F.octet_length(c.cast("string")) if t == "string" else F.lit(4)).alias(n) for n, c, t in zip(columns, map(F.col, columns), [dict(df.dtypes)[c] for c in columns])]).first().asDict()
    pairs = [(a, b) for a in columns for b in columns if a != b and rows >= MIN_ROWS and MIN_SOURCE_DISTINCT <= distinct[a] and distinct[a] * 2 <= rows and distinct[b] * 2 <= rows and distinct[a] <= 4 * distinct[b]]
    entry = {c: widths[c] / max(rows, 1) + 2 if widths[c] is not None else 2.0 for c in columns}
    # What a column costs without a link: ids with their dictionary, or for integers a frame if that is less.
    alone = {c: C.py_packed_bytes(rows, C.py_bits(max(distinct[c] - 1, 0))) + distinct[c] * entry[c] for c in columns}
    whole = [c for c in columns if dict(df.dtypes)[c] in ("tinyint", "smallint", "int", "bigint")]
    if whole and rows:
        ends = df.agg(*[F.min(c).alias(f"l{i}") for i, c in enumerate(whole)], *[F.max(c).alias(f"h{i}") for i, c in enumerate(whole)]).first()
        for i, c in enumerate(whole):
            low, high = ends[f"l{i}"], ends[f"h{i}"]
            if low is not None and C.py_bits(high - low) <= C.WIDEST_PACKED:
                alone[c] = min(alone[c], 2 + C.py_zigzag_width(low) + C.py_packed_bytes(rows, C.py_bits(high - low)))
    found = _further_candidates(df, columns, rows, distinct, alone, entry) if rows >= MIN_ROWS else []
    if pairs:
        place = {c: i for i, c in enumerate(columns)}
        lines = [F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), cells[place[a]].alias("s"), cells[place[b]].alias("t")) for a, b in pairs]
        counts = df.select(F.inline(F.array(*lines))).groupBy("source", "target", "s", "t").count()
        kept = counts.groupBy("source", "target", "s").agg(F.sum("count").alias("all"), F.max("count").alias("most")).groupBy("source", "target").agg(F.sum(F.col("all") - F.col("most")).alias("exceptions"))
        for r in kept.collect():  # one row a column pair
            if r["exceptions"] * 10 <= rows:
                d_s, d_t = distinct[r["source"]], distinct[r["target"]]
                cost = C.py_varint_width(d_t) + d_t * entry[r["target"]] + 1 + C.py_packed_bytes(d_s, C.py_bits(d_t)) + r["exceptions"] * (C.py_varint_width(rows) + 1)
                found.append({"source": r["source"], "target": r["target"], "form": "mapped", "saving": int(alone[r["target"]] - cost), "exceptions": r["exceptions"]})
    return spark.createDataFrame([(c["source"], c["target"], c["form"], c["saving"], c["exceptions"]) for c in assign(found)], "source string, target string, form string, saving long, exceptions long")

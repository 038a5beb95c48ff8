"""Single-column forms: what qualifies, what it costs, encode and decode.

A ``*_stats`` function returns a small DataFrame of exact figures; costs are closed formulas on these. Encoders add an encoded
column, decoders restore the source exactly. Order-sensitive functions take rows from ``with_order``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colform.functions import costs as C
from colform.sources.ordering import last_before_each, running_sum, with_lags

#: Fixed values of the format: most entries of a dictionary; longest cycle, fewest times that it must repeat and fewest rows
#: of a column that is tried for one; largest power of ten of decimals.
DICTIONARY_LIMIT = 4095
LONGEST_CYCLE, LEAST_TURNS, LEAST_CYCLE_ROWS = 128, 4, 32
LARGEST_EXPONENT = 18
#: Rows that a cycle is looked for in before all rows are compared with it.
CYCLE_SAMPLE = 2048
#: Exponents up to this one are tried in one pass.
DECIMAL_FIRST = 4


# --- Frame of reference and differences -----------------------------------------------------------------------


def frame_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, base, span, bits, packed_bytes, plain_bytes of integer columns, in one aggregate."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        aggs += [F.min(c).cast("long").alias(f"low{i}"), F.max(c).cast("long").alias(f"high{i}"), F.sum(C.integer_cost(F.col(c))).alias(f"plain{i}")]
    lines = [F.struct(F.lit(c).alias("column"), F.col(f"low{i}").alias("base"), (F.col(f"high{i}") - F.col(f"low{i}")).alias("span"), F.col(f"plain{i}").cast("long").alias("plain_bytes"), F.col("n")) for i, c in enumerate(columns)]
    flat = df.agg(*aggs).select(F.inline(F.array(*lines))).withColumn("bits", C.bits_for(F.col("span")))
    return flat.withColumn("packed_bytes", 2 + C.zigzag_width(F.col("base")) + C.packed_bytes(F.col("n"), F.col("bits"))).drop("n")


def difference_stats(ordered: DataFrame, column: str) -> DataFrame:
    """One row an order 0, 1, 2: bits, seed_bytes, total_bytes, and plain_bytes; exact over the whole order."""
    x, a, b = F.col(column), F.col(f"{column}_lag1"), F.col(f"{column}_lag2")
    lagged = with_lags(ordered, [column], 2)
    stats = lagged.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
        F.max(C.zigzag(x - a)).alias("wide1"),
        F.max(C.zigzag(x - 2 * a + b)).alias("wide2"),
        F.min(F.when(F.col("_rn") == 0, x)).alias("seed1"),
        F.min(F.when(F.col("_rn") == 1, x - a)).alias("seed2"),
        F.sum(C.integer_cost(x)).alias("plain_bytes"),
    )
    order = lambda k, wide, length, seeds: F.struct(F.lit(k).cast("long").alias("order"), C.bits_for(wide).alias("bits"), seeds.alias("seed_bytes"), length.alias("packed"), F.col("plain_bytes").cast("long").alias("plain_bytes"))
    lines = F.array(
        order(0, F.col("high") - F.col("low"), F.col("n"), C.zigzag_width(F.col("low"))),
        order(1, F.col("wide1"), F.col("n") - 1, C.zigzag_width(F.col("seed1"))),
        order(2, F.col("wide2"), F.col("n") - 2, C.zigzag_width(F.col("seed1")) + C.zigzag_width(F.col("seed2"))),
    )
    flat = stats.select(F.inline(lines)).withColumn("total_bytes", 2 + F.col("seed_bytes") + C.packed_bytes(F.col("packed"), F.col("bits"))).drop("packed")
    best = Window.partitionBy("plain_bytes").orderBy("total_bytes", "order")
    return flat.withColumn("chosen", (F.row_number().over(best) == 1) & (F.col("total_bytes") < F.col("plain_bytes")))


def encode_frame(df: DataFrame, column: str, base: int) -> DataFrame:
    return df.withColumn("offset", F.col(column) - F.lit(base))


def decode_frame(df: DataFrame, base: int, name: str) -> DataFrame:
    return df.withColumn(name, F.col("offset") + F.lit(base))


def encode_differences(ordered: DataFrame, column: str, order: int) -> DataFrame:
    """Adds delta: the zigzagged difference of the given order; the first rows carry their seeds."""
    if order == 0:
        return ordered.withColumn("delta", F.col(column))
    lagged = with_lags(ordered, [column], order)
    x, a = F.col(column), F.col(f"{column}_lag1")
    first = C.zigzag(x - F.coalesce(a, F.lit(0)))
    if order == 1:
        return lagged.withColumn("delta", first)
    b = F.col(f"{column}_lag2")
    return lagged.withColumn("delta", F.when(b.isNotNull(), C.zigzag(x - 2 * a + b)).otherwise(first))


def decode_differences(encoded: DataFrame, order: int, name: str) -> DataFrame:
    """Restores the column from delta: each order is one running sum, the innermost first."""
    value = C.unzigzag(F.col("delta")) if order else F.col("delta")
    if order == 0:
        return encoded.withColumn(name, value)
    if order == 2:
        steps = running_sum(encoded, F.when(F.col("_rn") == 0, F.lit(0)).otherwise(value), "_step")
        seed = F.when(F.col("_rn") == 0, value).otherwise(F.col("_step"))
        return running_sum(steps, seed, name).drop("_step")
    return running_sum(encoded, value, name)


# --- Dominant value, runs, booleans, optional -------------------------------------------------------------------


def frequency_stats(ordered: DataFrame, column: str) -> DataFrame:
    """The dominant value, its exceptions (missing values among them) and both ways to give their positions."""
    x = F.col(column)
    n = ordered.agg(F.count(F.lit(1)).alias("n"))
    top = ordered.where(x.isNotNull()).groupBy(x.alias("top")).agg(F.count(F.lit(1)).alias("top_count")).orderBy(F.col("top_count").desc(), "top").limit(1)
    one = top.crossJoin(n)
    odd = ordered.join(F.broadcast(one), ~x.eqNullSafe(F.col("top")))
    # Exceptions are numbered again, so their gaps are differences to the exception before, chunk by chunk.
    gaps = _gaps(odd.select("_rn", x.alias("v")))
    widest = gaps.agg(F.count(F.lit(1)).alias("exceptions"), F.max(C.zigzag(F.col("v"))).alias("widest"), F.max("gap").alias("widest_gap"))
    all_ = one.crossJoin(widest).withColumns({"exception_bits": C.bits_for(F.coalesce("widest", F.lit(0))), "gap_bits": C.bits_for(F.coalesce("widest_gap", F.lit(0)))})
    all_ = all_.withColumn("bitmap_bytes", F.floor((F.col("n") + 7) / 8).cast("long")).withColumn("gap_bytes", 1 + C.packed_bytes(F.col("exceptions"), F.col("gap_bits")))
    positions = F.when(F.col("exceptions") == 0, 0).otherwise(F.least("gap_bytes", "bitmap_bytes"))
    total = C.zigzag_width(F.col("top")) + 1 + positions + F.when(F.col("exceptions") == 0, 0).otherwise(C.packed_bytes(F.col("exceptions"), F.col("exception_bits")))
    return all_.select(
        F.col("top").cast("long").alias("top"), "top_count", "exceptions", "exception_bits", "bitmap_bytes", "gap_bits", "gap_bytes",
        (F.col("gap_bytes") < F.col("bitmap_bytes")).alias("by_gaps"), total.cast("long").alias("total_bytes"), (F.col("top_count") * 2 >= F.col("n")).alias("accepted"),
    )


def _gaps(positions: DataFrame) -> DataFrame:
    """Adds gap: distance of each _rn (counted from 1) to the one before, 0 before the first."""
    chunk = F.floor(F.col("_rn") / 65536)
    w = Window.partitionBy("_c").orderBy("_rn")
    before = last_before_each(positions.groupBy(chunk.cast("long").alias("_c")).agg(F.max("_rn").alias("_last")), "_c", "_last", "_before")
    return positions.withColumn("_c", chunk.cast("long")).join(before, "_c").withColumn("gap", F.col("_rn") - F.coalesce(F.lag("_rn").over(w), F.col("_before"), F.lit(-1))).drop("_c", "_before")


def encode_frequency(ordered: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(one row with the dominant value, exceptions by position; a missing value is one); a column without any value has a null top."""
    x = F.col(column)
    top = ordered.where(x.isNotNull()).groupBy(x.alias("top")).count().orderBy(F.col("count").desc(), "top").limit(1).agg(F.first("top").alias("top"))
    return top, ordered.join(F.broadcast(top), ~x.eqNullSafe(F.col("top"))).select("_rn", x.alias("exception"))


def decode_frequency(positions: DataFrame, top: DataFrame, exceptions: DataFrame, name: str) -> DataFrame:
    odd = exceptions.withColumn("_odd", F.lit(True))
    return positions.join(odd, "_rn", "left").crossJoin(F.broadcast(top)).withColumn(name, F.when(F.col("_odd"), F.col("exception")).otherwise(F.col("top"))).drop("top", "exception", "_odd")


def runs(ordered: DataFrame, column: str) -> DataFrame:
    """(run, value, length) by gaps and islands over the whole order."""
    lagged = with_lags(ordered, [column], 1)
    opens = ~F.col(column).eqNullSafe(F.col(f"{column}_lag1")) | (F.col("_rn") == 0)
    numbered = running_sum(lagged, opens.cast("long"), "run")
    return numbered.groupBy("run").agg(F.first(column).alias("value"), F.count(F.lit(1)).alias("length"), F.min("_rn").alias("start"))


def run_stats(ordered: DataFrame, column: str) -> DataFrame:
    found = runs(ordered, column).agg(F.count(F.lit(1)).alias("runs"), F.sum("length").alias("rows"), F.max("length").alias("longest"), F.sum(C.varint_width(F.col("length"))).alias("varint_bytes"))
    bits = C.bits_for(F.col("longest"))
    return found.select("rows", "runs", "longest", F.least(F.col("varint_bytes"), 1 + C.packed_bytes(F.col("runs"), bits)).cast("long").alias("length_bytes"), ((F.col("rows") >= 8) & (F.col("runs") * 2 <= F.col("rows"))).alias("accepted"))


def decode_runs(found: DataFrame, name: str) -> DataFrame:
    """Rows of the runs; a long run goes through pieces of 4096 rows, which are dealt out before they are unfolded."""
    pieces = found.withColumn("_piece", F.explode(F.expr("sequence(0L, (length - 1) div 4096)"))).withColumn("_start", F.col("start") + F.col("_piece") * 4096)
    pieces = pieces.withColumn("_rows", F.least(F.col("length") - F.col("_piece") * 4096, F.lit(4096))).repartition(F.xxhash64("_start"))
    return pieces.withColumn("_i", F.explode(F.expr("sequence(0, cast(_rows as int) - 1)"))).select((F.col("_start") + F.col("_i")).alias("_rn"), F.col("value").alias(name))


def pack_booleans(ordered: DataFrame, flag) -> DataFrame:
    """(byte_no, packed): eight rows a byte, the first row in the lowest bit."""
    bit = F.expr("shiftleft(1L, cast(_rn % 8 as int))")
    return ordered.groupBy(F.floor(F.col("_rn") / 8).cast("long").alias("byte_no")).agg(F.sum(F.when(flag, bit).otherwise(0)).cast("long").alias("packed"))


def unpack_booleans(packed: DataFrame, rows: int) -> DataFrame:
    bits = packed.withColumn("_i", F.explode(F.expr("sequence(0, 7)"))).select((F.col("byte_no") * 8 + F.col("_i")).alias("_rn"), (F.expr("shiftright(packed, _i) & 1") == 1).alias("flag"))
    return bits.where(F.col("_rn") < rows)


def optional_stats(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(column).isNull().cast("long")).alias("missing")).select(
        "rows", "missing", F.floor((F.col("rows") + 7) / 8).cast("long").alias("bitmap_bytes"),
        ((F.col("missing") > 0) & (F.col("missing") < F.col("rows")) & (F.floor((F.col("rows") + 7) / 8) < F.col("missing"))).alias("accepted"),
    )


# --- Decimals -------------------------------------------------------------------------------------------------


def decimal_digits(x, e: int, f: int) -> tuple:
    """(digits as a whole double, whether they decode exactly) of a column at one exponent and factor."""
    r = C.round_half_away(x * F.lit(10.0**e) / F.lit(10.0**f)).cast("double")
    return r, ((r * F.lit(10.0**f) / F.lit(10.0**e)) == x) & (F.abs(r) <= float(1 << 53))


def _decimal_pairs(df: DataFrame, columns: list[str], exponents: range) -> DataFrame:
    """Fractional rows, exceptions and range of each column at all factors of some exponents; one aggregate."""
    pairs = [(e, f) for e in exponents for f in range(e + 1)]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        aggs.append(F.sum((F.floor(c) != F.col(c)).cast("long")).alias(f"frac{i}"))
        for e, f in pairs:
            r, exact = decimal_digits(F.col(c), e, f)
            aggs += [F.sum((~exact).cast("long")).alias(f"x{i}_{e}_{f}"), F.min(F.when(exact, r)).alias(f"l{i}_{e}_{f}"), F.max(F.when(exact, r)).alias(f"h{i}_{e}_{f}")]
    lines = [
        F.struct(F.lit(c).alias("column"), F.lit(e).cast("long").alias("exponent"), F.lit(f).cast("long").alias("factor"), F.col(f"frac{i}").alias("fractional"), F.col(f"x{i}_{e}_{f}").alias("exceptions"), F.col(f"l{i}_{e}_{f}").cast("long").alias("low"), F.col(f"h{i}_{e}_{f}").cast("long").alias("high"), "n")
        for i, c in enumerate(columns)
        for e, f in pairs
    ]
    return df.agg(*aggs).select(F.inline(F.array(*lines)))


def decimal_stats(df: DataFrame, columns: list[str], max_exponent: int = LARGEST_EXPONENT) -> DataFrame:
    """Cheapest (exponent, factor) of each column with its low, bits, exceptions and total_bytes.

    A pair holds if at most a tenth of the rows are exceptions; exponents beyond the first one without exceptions are not tried.
    One aggregate tries the first exponents of all columns; more follow only for columns that have exceptions at all of those.
    """
    flat = _decimal_pairs(df, columns, range(min(max_exponent, DECIMAL_FIRST) + 1))
    if max_exponent > DECIMAL_FIRST:
        schema, met = flat.schema, flat.collect()  # a row a column and pair
        for e in range(DECIMAL_FIRST + 1, max_exponent + 1):
            done = {r["column"] for r in met if r["exceptions"] == 0 or not r["fractional"]}
            left = [c for c in columns if c not in done]
            if not left:
                break
            # A column a pass: the pairs of one exponent are many.
            for c in left:
                met += _decimal_pairs(df, [c], range(e, e + 1)).collect()
        flat = df.sparkSession.createDataFrame(met, schema)
    flat = flat.where(f"exceptions * 10 <= n and exceptions < n and fractional > 0 and high - low < {1 << C.WIDEST_PACKED}")
    flat = flat.withColumn("bits", C.bits_for(F.col("high") - F.col("low")))
    total = 3 + C.zigzag_width(F.col("low")) + C.packed_bytes(F.col("n"), F.col("bits")) + C.varint_width(F.col("exceptions")) + F.col("exceptions") * (C.varint_width(F.col("n")) + 9)
    flat = flat.withColumn("total_bytes", total.cast("long"))
    w = Window.partitionBy("column")
    flat = flat.withColumn("last", F.min(F.when(F.col("exceptions") == 0, F.col("exponent"))).over(w)).where("last is null or exponent <= last")
    return flat.withColumn("rank", F.row_number().over(w.orderBy("total_bytes", "exponent", "factor"))).where("rank = 1").select("column", "exponent", "factor", "low", "bits", "exceptions", "total_bytes")


def encode_decimal(df: DataFrame, column: str, exponent: int, factor: int, low: int) -> DataFrame:
    r, exact = decimal_digits(F.col(column), exponent, factor)
    return df.withColumn("digits", F.when(exact, r - low).otherwise(0).cast("long")).withColumn("exception", F.when(~exact, F.col(column)))


def decode_decimal(df: DataFrame, exponent: int, factor: int, low: int, name: str) -> DataFrame:
    return df.withColumn(name, F.coalesce(F.col("exception"), (F.lit(low) + F.col("digits")) * F.lit(10.0**factor) / F.lit(10.0**exponent)))


# --- Strings --------------------------------------------------------------------------------------------------


def first_appearance(ordered: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """(value, id, uses): distinct values numbered from 1 in order of first appearance.

    ``limit`` stops one past the largest dictionary, so the numbering window sees at most that many rows.
    """
    seen = ordered.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min("_rn").alias("first"), F.count(F.lit(1)).alias("uses"))
    if limit is not None:
        seen = seen.orderBy("first").limit(limit + 1)
    return seen.select("value", F.row_number().over(Window.orderBy("first")).cast("long").alias("id"), "uses")


def dictionary_stats(ordered: DataFrame, columns: list[str]) -> DataFrame:
    """column, rows, entries, id_bits, dictionary_bytes, plain_bytes, accepted; exact however many values there are."""
    out = None
    for c in columns:
        values = ordered.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("uses"))
        one = values.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("uses"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.octet_length("value") + 2), F.lit(0)).alias("entry_bytes"))
        one = one.select(F.lit(c).alias("column"), F.col("rows").cast("long"), "entries", C.bits_for_count(F.col("entries")).alias("id_bits"), F.col("entry_bytes").cast("long").alias("entry_bytes"))
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("dictionary_bytes", F.col("entry_bytes") + C.packed_bytes(F.col("rows"), F.col("id_bits"))).withColumn("plain_bytes", F.col("entry_bytes") + (F.col("rows") - F.col("entries")) * 2)
    good = (F.col("entries") <= DICTIONARY_LIMIT) & (F.col("entries") < F.col("rows")) & (F.col("dictionary_bytes") < F.col("plain_bytes"))
    return out.withColumn("accepted", good).drop("entry_bytes")


def encode_dictionary(ordered: DataFrame, column: str, entries: DataFrame) -> DataFrame:
    """Ids in place of values, null for a missing one. A dictionary has at most 4,095 entries, so it can go to every task."""
    return ordered.join(F.broadcast(entries.select("value", "id")), F.col(column) == F.col("value"), "left").drop("value", column)


def decode_dictionary(encoded: DataFrame, entries: DataFrame, name: str) -> DataFrame:
    return encoded.join(F.broadcast(entries.select("id", F.col("value").alias(name))), "id", "left").drop("id")


def date_days(text) -> tuple:
    """(day number, whether the text re-renders exactly) of YYYY-MM-DD strings."""
    day = F.try_to_date(text, "yyyy-MM-dd")
    return F.unix_date(day), F.coalesce(F.date_format(day, "yyyy-MM-dd") == text, F.lit(False)) & text.rlike(r"^\d{4}-\d{2}-\d{2}$")


def prefix_stats(df: DataFrame, column: str) -> DataFrame:
    """Common prefix, suffix, width and range of identifiers like a fixed head, a counter and a fixed tail.

    The longest common head of all values is that of the least and the greatest; the common tail is found on the reversed rest.
    """
    x = F.col(column)
    ends = df.agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min(F.length(x)).alias("short"), F.max(F.length(x)).alias("long"), F.count(F.lit(1)).alias("n"))
    head = "aggregate(sequence(1, least(length(a), length(b))), 0, (k, i) -> if(k = i - 1 and substring(a, i, 1) = substring(b, i, 1), i, k))"
    ends = ends.withColumn("prefix", F.regexp_replace(F.expr(f"left(a, {head})"), r"\d+$", ""))
    rest = df.crossJoin(F.broadcast(ends)).withColumn("r", F.reverse(F.expr(f"substring({column}, length(prefix) + 1)")))
    tails = rest.agg(F.min("r").alias("a"), F.max("r").alias("b"))
    tails = tails.select(F.reverse(F.expr(f"left(a, {head})")).alias("suffix")).withColumn("suffix", F.regexp_replace("suffix", r"^\d+", ""))
    both = ends.crossJoin(tails)
    digits = f"substring({column}, length(prefix) + 1, length({column}) - length(prefix) - length(suffix))"
    numbered = df.crossJoin(F.broadcast(both)).withColumn("digits", F.expr(digits)).withColumn("value", F.expr("if(digits rlike '^[0-9]{1,18}$', cast(digits as bigint), null)"))
    padded = F.col("short") == F.col("long")
    shown = F.when(padded, F.lpad(F.col("value").cast("string"), F.length("digits"), "0")).otherwise(F.col("value").cast("string"))
    found = numbered.groupBy("prefix", "suffix", "short", "long", "n").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum((~F.coalesce(shown == F.col("digits"), F.lit(False))).cast("long")).alias("misfits"))
    found = found.withColumns({"span": F.col("high") - F.col("low"), "width": F.when(padded, F.col("short") - F.length("prefix") - F.length("suffix")).otherwise(0).cast("long")})
    found = found.withColumn("bits", C.bits_for(F.col("span"))).withColumn("dense", (F.col("span") > 0) & (F.col("span") + 1 <= 2 * F.col("n")))
    total = 3 + F.length("prefix") + F.length("suffix") + C.zigzag_width(F.col("low")) + C.packed_bytes(F.col("n"), F.col("bits"))
    fits = (F.col("misfits") == 0) & ((F.length("prefix") >= 2) | (F.length("suffix") >= 2)) & ~F.col("dense")
    return found.select("prefix", "suffix", "width", "low", "span", "bits", "dense", total.cast("long").alias("total_bytes"), fits.alias("accepted"))


# --- Cycles ---------------------------------------------------------------------------------------------------


def cycle_candidates(ordered: DataFrame, columns: list[str], n: int) -> dict[str, list[int]]:
    """Periods of each column at which its first rows foretell at least three quarters of a sample of rows from all over the table.

    One pass for all columns; at most a cycle and about ``CYCLE_SAMPLE`` rows come to the driver.
    """
    longest = min(LONGEST_CYCLE, n // LEAST_TURNS)
    if n < LEAST_CYCLE_ROWS or longest < 2 or not columns:
        return {c: [] for c in columns}
    met = ordered.where((F.col("_rn") < longest) | (F.pmod(F.xxhash64("_rn"), F.lit(n)) < CYCLE_SAMPLE)).select("_rn", *[F.col(c) for c in columns]).toPandas()
    met = met.sort_values("_rn")
    at, out = met["_rn"].to_numpy(), {}
    for c in columns:
        values = met[c].astype(object).where(met[c].notna(), None).to_numpy()
        periods = [p for p in range(2, longest + 1) if (values[at % p] == values).mean() >= 0.75]
        out[c] = periods
    return out


def cycle_stats(ordered: DataFrame, column: str, periods: list[int] | None = None) -> DataFrame:
    """period, misfits and cost of the cheapest admissible cycle among ``periods``; no row if there is none."""
    if periods is None:
        periods = cycle_candidates(ordered, [column], ordered.count())[column]
    periods = periods or [-1]
    tried = ordered.select("_rn", F.col(column).cast("long").alias("x")).withColumn("period", F.explode(F.array(*[F.lit(p).cast("long") for p in periods])))
    cycle = ordered.where(F.col("_rn") < LONGEST_CYCLE).select(F.col("_rn").alias("place"), F.col(column).cast("long").alias("expected"))
    met = tried.where("period > 0").withColumn("place", F.expr("_rn % if(period > 0, period, 1)")).join(F.broadcast(cycle), "place")
    odd = F.col("x") != F.col("expected")
    found = met.groupBy("period").agg(
        F.sum(odd.cast("long")).alias("misfits"), F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("_rn") < F.col("period"), F.col("x"))).alias("low"), F.max(F.when(F.col("_rn") < F.col("period"), F.col("x"))).alias("high"),
        F.sum(F.when(odd, C.varint_width(F.col("_rn") + 1) + C.zigzag_width(F.col("x"))).otherwise(0)).alias("misfit_bytes"),
    )
    found = found.where("misfits * 10 <= n and high > low").withColumn("bits", C.bits_for(F.col("high") - F.col("low")))
    total = 2 + C.varint_width(F.col("period")) + C.zigzag_width(F.col("low")) + C.packed_bytes(F.col("period"), F.col("bits")) + C.varint_width(F.col("misfits")) + F.col("misfit_bytes")
    return found.withColumn("total_bytes", total.cast("long")).orderBy(F.col("misfits") > 0, "total_bytes", "period").limit(1).select("period", "misfits", "bits", "total_bytes")


def decode_cycle(positions: DataFrame, cycle: DataFrame, period: int, name: str) -> DataFrame:
    return positions.withColumn("place", F.col("_rn") % period).join(F.broadcast(cycle), "place").withColumnRenamed("expected", name).drop("place")

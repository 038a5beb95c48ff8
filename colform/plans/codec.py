"""Encoding a table by a recorded plan, and decoding it.

A plan is replayed on any table with its columns: every column is put into its planned form, a column whose values do not fit any more
(a *miss*) falls back to plain, and decoding restores every row exactly. Row-wise forms share one body, a row a position, so that they
cost one pass; dictionaries, runs and the present values of optional columns are side tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colform.functions import costs as C
from colform.operators import forms
from colform.options import EncodeOptions
from colform.plans.planner import MICROS, ColumnPlan, Plan
from colform.sources.ordering import running_sum, with_lags, with_order

#: Share of a column's rows that may be exceptions of a form that has exceptions.
ODD_SHARE = {"decimal": 0.1, "date": 0.1, "prefixed": 0.1, "cyclic": 0.1, "frequency": 0.5}


@dataclass
class Encoded:
    """``body`` has _rn, _chunk and for column i its payload v<i> and, in forms with exceptions, x<i>."""

    schema: StructType
    rows: int
    plan: dict[str, ColumnPlan]
    misses: list[str]
    body: DataFrame
    sides: dict[str, DataFrame] = field(default_factory=dict)
    inner: dict[str, Encoded] = field(default_factory=dict)


@dataclass
class _Piece:
    """Payload of a column, its exceptions, and whether a row fits."""

    value: Column
    fits: Column
    odd: Column | None = None


def _number(ordered_kind: str, name: str, p: ColumnPlan) -> Column:
    """The whole number that a time or a whole double is encoded as."""
    if ordered_kind in ("timestamp", "timestamp_ntz"):
        return F.expr(MICROS.format(name))
    x = F.col(f"`{name}`")
    return F.when((F.floor(x) == x) & (F.abs(x) <= float(C.LARGEST_DIFFERENCED)) & (x.cast("string") != "-0.0"), x.cast("long")) if p.parameters.get("double") else x


def _narrow(value: Column, bits: int) -> Column:
    return value.isNotNull() & (value >= 0) & (value < F.lit(1 << bits))


def _pieces(x: Column, lags: tuple[Column, Column], p: ColumnPlan, cycle: list | None) -> _Piece:
    q, rn = p.parameters, F.col("_rn")
    if p.form == "differenced":
        if q["order"] == 0:
            value = x - F.lit(q["low"])
            return _Piece(value, _narrow(value, q["bits"]))
        a, b = lags
        step = C.zigzag(x - F.coalesce(a, F.lit(0)))
        value = step if q["order"] == 1 else F.when(rn >= 2, C.zigzag(x - 2 * a + b)).otherwise(step)
        return _Piece(value, x.isNotNull() & ((rn < q["order"]) | _narrow(value, q["bits"])))
    if p.form == "decimal":
        digits, exact = forms.decimal_digits(x, q["exponent"], q["factor"])
        value = F.when(exact, digits - F.lit(q["low"])).cast("long")
        fits = F.coalesce(exact, F.lit(False)) & F.coalesce(_narrow(value, q["bits"]), F.lit(False))
    elif p.form == "date":
        value, fits = forms.date_days(x)
    elif p.form == "prefixed":
        head, tail = q["prefix"], q["suffix"]
        digits = F.substring(x, F.lit(len(head) + 1), F.length(x) - len(head) - len(tail))
        value = F.when(digits.rlike("^[0-9]{1,18}$"), digits.try_cast("long"))
        fits = F.coalesce(_prefixed(value, q) == x, F.lit(False)) & F.coalesce(_narrow(value - F.lit(q["low"]), q["bits"]), F.lit(False))
        value = value - F.lit(q["low"])
    elif p.form == "cyclic":
        expected = F.element_at(F.array(*[F.lit(v) for v in cycle]), (F.pmod(rn, F.lit(q["period"])) + 1).cast("int"))
        fits = x.eqNullSafe(expected)
        value = fits
    elif p.form == "frequency":
        fits = x.eqNullSafe(F.lit(q["top"]))
        value = fits
    else:  # booleans
        return _Piece(x, x.isNotNull())
    return _Piece(F.when(fits, value), fits, F.when(~fits, x))


def _prefixed(value: Column, q: dict) -> Column:
    shown = F.lpad(value.cast("string"), q["width"], "0") if q["width"] else value.cast("string")
    return F.concat(F.lit(q["prefix"]), shown, F.lit(q["suffix"]))


#: Forms that pack numbers into bits.
PACKED = ("differenced", "decimal", "date", "prefixed", "dictionary", "booleans")


def encode(df: DataFrame, plan: Plan, order_by: list[str], options: EncodeOptions = EncodeOptions()) -> Encoded:
    """Columns without a plan are plain, and so are all without ``options.columnar``, or those of packed forms without ``bit_pack``."""
    plans = {f.name: plan.columns.get(f.name, ColumnPlan("plain", 0)) for f in df.schema.fields}
    plans = {c: p if options.columnar and (options.bit_pack or p.form not in PACKED) else ColumnPlan("plain", 0) for c, p in plans.items()}
    kinds, names = dict(df.dtypes), df.columns
    numbered = df.select(*[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(names)], *[F.col(f"`{c}`").alias(f"_key{i}") for i, c in enumerate(order_by)])
    # x<i> is the number that a form works on, where that is not the value itself.
    works = {i: _number(kinds[c], f"r{i}", plans[c]) for i, c in enumerate(names)}
    numbered = numbered.withColumns({f"x{i}": x for i, x in works.items() if plans[names[i]].form not in ("plain", "optional")})
    ordered = with_order(numbered, [f"_key{i}" for i in range(len(order_by))])
    rows, misses, sides, inner = ordered.count(), [], {}, {}

    pieces: dict[int, _Piece] = {}
    lagged = [i for i, c in enumerate(names) if plans[c].form == "differenced" and plans[c].parameters["order"]]
    body = with_lags(ordered, [f"x{i}" for i in lagged], 2) if lagged else ordered
    cycles = [i for i, c in enumerate(names) if plans[c].form == "cyclic"]
    heads: dict[int, list] = {}
    if cycles:
        longest = max(plans[names[i]].parameters["period"] for i in cycles)
        met = ordered.where(F.col("_rn") < longest).select("_rn", *[f"x{i}" for i in cycles]).orderBy("_rn").collect()  # one cycle
        heads = {i: [r[f"x{i}"] for r in met][: plans[names[i]].parameters["period"]] for i in cycles}
        for i in cycles:
            p = plans[names[i]]
            plans[names[i]] = ColumnPlan(p.form, p.cost, p.parameters | {"cycle": heads[i]})
    for i, c in enumerate(names):
        p = plans[c]
        if p.form in ("plain", "optional", "runs", "dictionary") or (p.form == "cyclic" and len(heads[i]) < p.parameters["period"]):
            continue
        pieces[i] = _pieces(F.col(f"x{i}"), (F.col(f"x{i}_lag1"), F.col(f"x{i}_lag2")), p, heads.get(i))
    odd = body.agg(F.lit(0).alias("none"), *[F.sum((~F.coalesce(p.fits, F.lit(False))).cast("long")).alias(f"n{i}") for i, p in pieces.items()]).first()
    for i, c in enumerate(names):
        p = plans[c]
        if i in pieces:
            miss = (odd[f"n{i}"] or 0) > rows * ODD_SHARE.get(p.form, 0)
        elif p.form == "dictionary":
            sides[c] = forms.first_appearance(ordered, f"x{i}", forms.DICTIONARY_LIMIT)
            miss = sides[c].count() > forms.DICTIONARY_LIMIT
        elif p.form == "runs":
            sides[c] = forms.runs(ordered, f"x{i}")
            miss = sides[c].count() * 2 > rows
        else:
            miss = p.form == "cyclic"
        if miss:
            misses.append(c)
            pieces.pop(i, None)
            sides.pop(c, None)
            plans[c] = ColumnPlan("plain", 0)
    columns = []
    for i, c in enumerate(names):
        form = plans[c].form
        if form == "plain":
            columns.append(F.col(f"r{i}").alias(f"v{i}"))
        elif form == "optional":
            present = ordered.where(F.col(f"r{i}").isNotNull()).select(F.col("_rn").alias("at"), F.col(f"r{i}").alias("value"))
            q = dict(plans[c].parameters)
            inner[c] = encode(present, Plan({"value": ColumnPlan(q.pop("inner"), 0, q)}), ["at"])
        elif form == "dictionary":
            body = body.join(F.broadcast(sides[c].select(F.col("value").alias(f"x{i}"), F.col("id").alias(f"v{i}"))), f"x{i}", "left")
            columns.append(F.col(f"v{i}"))
        elif i in pieces:
            columns.append(pieces[i].value.alias(f"v{i}"))
            if pieces[i].odd is not None:
                columns.append(pieces[i].odd.alias(f"x{i}"))
    return Encoded(df.schema, rows, plans, misses, body.select("_rn", "_chunk", *columns), sides, inner)


def decode(e: Encoded) -> DataFrame:
    """The rows, in no order, with the columns and types of the source."""
    out = e.body
    for i, (c, p) in enumerate(e.plan.items()):
        q, v = p.parameters, F.col(f"v{i}")
        if p.form == "differenced":
            if q["order"] == 0:
                out = out.withColumn(f"v{i}", v + F.lit(q["low"]))
                continue
            step = C.unzigzag(v)
            if q["order"] == 2:
                out = running_sum(out, F.when(F.col("_rn") == 0, F.lit(0)).otherwise(step), "_step")
                step = F.when(F.col("_rn") == 0, step).otherwise(F.col("_step"))
            out = running_sum(out, step, "_sum").withColumn(f"v{i}", F.col("_sum")).drop("_sum", "_step")
        elif p.form == "dictionary":
            out = out.join(F.broadcast(e.sides[c].select(F.col("id").alias(f"v{i}"), F.col("value").alias("_text"))), f"v{i}", "left").withColumn(f"v{i}", F.col("_text")).drop("_text")
        elif p.form == "runs":
            out = out.join(forms.decode_runs(e.sides[c], f"v{i}"), "_rn")
        elif p.form == "optional":
            there = decode(e.inner[c]).select(F.col("at").alias("_rn"), F.col("value").alias(f"v{i}"))
            out = out.join(there, "_rn", "left")
        elif p.form in ODD_SHARE:
            whole = {
                "decimal": lambda: (F.lit(q["low"]) + v) * F.lit(10.0 ** q["factor"]) / F.lit(10.0 ** q["exponent"]),
                "date": lambda: F.date_format(F.date_from_unix_date(v.cast("int")), "yyyy-MM-dd"),
                "prefixed": lambda: _prefixed(v + F.lit(q["low"]), q),
                "frequency": lambda: F.lit(q["top"]),
                "cyclic": lambda: F.element_at(F.array(*[F.lit(x) for x in q["cycle"]]), (F.pmod(F.col("_rn"), F.lit(q["period"])) + 1).cast("int")),
            }[p.form]()
            out = out.withColumn(f"v{i}", F.when(v.isNull(), F.col(f"x{i}")).otherwise(whole))
    columns = []
    for i, (f, p) in enumerate(zip(e.schema.fields, e.plan.values())):
        v = F.col(f"v{i}")
        kind = f.dataType.simpleString()
        if p.form not in ("plain", "optional") and kind in ("timestamp", "timestamp_ntz"):
            v = F.expr(f"timestampadd(MICROSECOND, v{i}, timestamp_ntz'1970-01-01 00:00:00')")
        columns.append(v.cast(f.dataType).alias(f.name))
    return out.select(*columns)

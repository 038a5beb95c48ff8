"""Choice of a form for every column from one wide profile, and the plan document."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colform.functions import costs as C
from colform.operators import forms
from colform.operators.profile import kind_of
from colform.sources.ordering import with_lags, with_order

FORMAT = 1


@dataclass
class ColumnPlan:
    form: str
    cost: int
    parameters: dict = field(default_factory=dict)


@dataclass
class Plan:
    """Recorded decisions by column name; immutable once saved, known by a fingerprint."""

    columns: dict[str, ColumnPlan]
    rows: int = 0

    def body(self) -> dict:
        return {"format": FORMAT, "rows": self.rows, "columns": {n: [p.form, p.cost, p.parameters] for n, p in sorted(self.columns.items())}}

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.body(), sort_keys=True).encode()).hexdigest()

    def to_json(self) -> str:
        return json.dumps({"fingerprint": self.fingerprint(), **self.body()}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Plan:
        raw = json.loads(text)
        if raw.get("format") != FORMAT:
            raise ValueError(f"plan format {raw.get('format')!r} is not {FORMAT}")
        plan = cls({n: ColumnPlan(*p) for n, p in raw["columns"].items()}, raw["rows"])
        if plan.fingerprint() != raw.get("fingerprint"):
            raise ValueError("the plan's fingerprint does not match its content")
        return plan

    def save(self, spark, path: str) -> None:
        """As one JSON line, through Spark's own writer."""
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark, path: str) -> Plan:
        return cls.from_json(spark.read.text(path).first()["value"])

    def merged(self, other: Plan) -> Plan:
        """Widened by another plan: a form of the same kind (and order of differences, exponent, ...) takes the wider parameters, another keeps the first."""
        out = {}
        for n, p in self.columns.items():
            q = other.columns.get(n)
            fixed = ("order", "exponent", "factor", "period", "prefix", "suffix", "width", "inner", "double")
            if q and q.form == p.form and all(p.parameters.get(k) == q.parameters.get(k) for k in fixed):
                both = {k: max(v, q.parameters[k]) if k == "bits" else min(v, q.parameters[k]) if k == "low" else v for k, v in p.parameters.items() if k in q.parameters}
                p = ColumnPlan(p.form, max(p.cost, q.cost), p.parameters | both)
            out[n] = p
        return Plan(out | {n: q for n, q in other.columns.items() if n not in out}, max(self.rows, other.rows))


MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(`{}` as timestamp_ntz))"


def _whole_doubles(df: DataFrame, columns: list[str]) -> set[str]:
    """Double columns that hold integers only: they take integer forms. -0.0 takes none."""
    if not columns:
        return set()
    fits = [F.min((F.floor(c) == F.col(c)) & (F.abs(c) <= float(1 << 52)) & (F.col(c).cast("string") != "-0.0")).alias(f"w{i}") for i, c in enumerate(columns)]
    met = df.agg(*fits).first()
    return {c for i, c in enumerate(columns) if met[f"w{i}"]}


def column_figures(df: DataFrame, order_by: list[str]) -> tuple[int, dict[str, dict]]:
    """(rows, figures by column): one ordering, one wide aggregate over rows with their two predecessors, and the form operators.

    A column with missing values that an optional form may take also has the figures of its present values, as ``inner``.
    """
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    whole = _whole_doubles(df, [c for c, k in kinds.items() if k == "double"])
    # The order is that of the columns as they came.
    key_names = [f"_key{i}" for i in range(len(order_by))]
    usable = df.withColumns({k: F.col(c) for k, c in zip(key_names, order_by)})
    for c, k in kinds.items():
        if k == "time":
            usable = usable.withColumn(c, F.expr(MICROS.format(c)))
        elif c in whole:
            usable = usable.withColumn(c, F.col(c).cast("long"))
            kinds[c] = "integer"
    columns = [c for c, k in kinds.items() if k in ("integer", "double", "string", "boolean", "time")]
    ordered = with_order(usable, key_names)
    lagged = with_lags(ordered, columns, 2)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        x, a, b = F.col(c), F.col(f"{c}_lag1"), F.col(f"{c}_lag2")
        aggs += [F.count(x).alias(f"present{i}"), F.sum((~x.eqNullSafe(a) | (F.col("_rn") == 0)).cast("long")).alias(f"runs{i}")]
        if kinds[c] in ("integer", "time"):
            aggs += [F.min(x).cast("long").alias(f"low{i}"), F.max(x).cast("long").alias(f"high{i}"), F.sum(C.integer_cost(x)).alias(f"plain{i}"), F.max(C.zigzag(x.cast("long") - a)).alias(f"wide1_{i}"), F.max(C.zigzag(x.cast("long") - 2 * a + b)).alias(f"wide2_{i}"), F.percentile_approx(x, 0.5, 10000).alias(f"middle{i}")]
        elif kinds[c] == "double":
            aggs += [F.sum((F.isnan(x) | (F.abs(x) == float("inf"))).cast("long")).alias(f"nan{i}")]
        elif kinds[c] == "string":
            aggs += [F.sum(F.octet_length(x) + 2).alias(f"bytes{i}"), F.max(F.octet_length(x)).alias(f"longest{i}"), F.sum(forms.date_days(x)[1].cast("long")).alias(f"dates{i}"), F.approx_count_distinct(x).alias(f"about{i}")]
            aggs += [f(y).alias(f"{n}{i}") for n, f, y in (("first", F.min, x), ("last", F.max, x), ("rfirst", F.min, F.reverse(x)), ("rlast", F.max, F.reverse(x)))]
    raw = lagged.agg(*aggs).first().asDict()
    rows, figures = raw["rows"], {}
    for i, c in enumerate(columns):
        names = ("present", "runs", "low", "high", "plain", "wide1_", "wide2_", "nan", "bytes", "longest", "dates", "middle", "about", "first", "last", "rfirst", "rlast")
        figures[c] = {"kind": kinds[c], "whole": c in whole, **{n.strip("_"): raw[f"{n}{i}"] for n in names if f"{n}{i}" in raw}}
    full = [c for c in columns if figures[c]["present"] == rows >= 4]
    # The costlier figures are taken only of columns that may pass: a value of half the rows is the median, a cycle foretells a sample.
    numbers = [c for c in full if figures[c]["kind"] in ("integer", "time")]
    cycles = forms.cycle_candidates(ordered, numbers, rows)
    often = ordered.agg(F.lit(0), *[F.sum((F.col(c) == F.lit(figures[c]["middle"])).cast("long")).alias(f"n{i}") for i, c in enumerate(numbers)]).first() if numbers else {}
    for i, c in enumerate(numbers):
        f = figures[c]
        f["cycle"] = _first(forms.cycle_stats(ordered, c, cycles[c])) if cycles[c] else None
        # The median is approximate to a ten-thousandth of the rows.
        f["frequency"] = _first(forms.frequency_stats(ordered, c).where("accepted")) if often[f"n{i}"] * 2.001 >= rows else None
    for c in full:
        f = figures[c]
        if f["kind"] == "string" and (_common(f["first"], f["last"]) >= 2 or _common(f["rfirst"], f["rlast"]) >= 2):
            f["prefix"] = _first(forms.prefix_stats(ordered, c).where("accepted"))
    # The estimate is off by a few hundredths; columns with far more values than a dictionary holds are not counted exactly.
    texts = [c for c in full if kinds[c] == "string" and figures[c]["about"] <= 2 * forms.DICTIONARY_LIMIT]
    if texts:
        for r in forms.dictionary_stats(ordered, texts).where("accepted").collect():
            figures[r["column"]]["dictionary"] = r.asDict()
    doubles = [c for c in full if kinds[c] == "double" and not figures[c]["nan"]]
    if doubles and rows >= 8:
        for r in forms.decimal_stats(ordered.select(*doubles), doubles).collect():
            figures[r["column"]]["decimal"] = r.asDict()
    for c in columns:
        if 0 < figures[c]["present"] < rows and (rows + 7) // 8 < rows - figures[c]["present"]:
            keys = {k: F.col(k) for k in order_by if k != c}
            there = df.where(F.col(c).isNotNull()).select(c, *keys)
            figures[c]["inner"] = column_figures(there, order_by)[1][c]
    return rows, figures


def _common(a: str, b: str) -> int:
    """Characters that two texts have in common at their start, without the digits that end them."""
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return len(a[:n].rstrip("0123456789"))


def _first(stats: DataFrame) -> dict | None:
    row = stats.first()
    return row.asDict() if row else None


def choose(rows: int, f: dict) -> ColumnPlan:
    """First form of the selection order that beats the rival's modelled cost by more than a plan definition.

    The order: optional, cyclic, runs (unless frequency costs less), booleans, frequency, decimal, differenced, date, prefixed
    integer, dictionary, plain. The README names the forms that are not tried.
    """
    present = f["present"] or 0
    extra = C.DEFINITION_BYTES
    if not present or rows < 4:
        return ColumnPlan("plain", 0)
    if f["kind"] == "double" and (f["nan"] or 0):
        return ColumnPlan("plain", 9 * rows)
    if present < rows:
        if "inner" in f:
            inner = choose(present, f["inner"])
            return ColumnPlan("optional", (rows + 7) // 8 + inner.cost, {"inner": inner.form, **inner.parameters})
        return ColumnPlan("plain", 9 * rows)
    runs = f["runs"] or rows
    may_run = rows >= 8 and runs * 2 <= rows
    run_cost = lambda value: C.py_varint_width(runs) + runs * (1 + value)
    if f["kind"] == "boolean":
        plan = ColumnPlan("booleans", (rows + 7) // 8) if rows >= 8 else ColumnPlan("plain", rows)
        return ColumnPlan("runs", run_cost(1), {"runs": runs}) if may_run and run_cost(1) + extra < plan.cost else plan
    if f["kind"] in ("integer", "time"):
        typed = {"double": True} if f.get("whole") else {}
        span = f["high"] - f["low"]
        costs = [(2 + C.py_zigzag_width(f["low"]) + C.py_packed_bytes(rows, C.py_bits(span)), 0, C.py_bits(span))]
        for order in (1, 2):
            if rows > order and f[f"wide{order}"] is not None:
                bits = C.py_bits(f[f"wide{order}"])
                costs.append((2 + order * C.py_zigzag_width(f["low"]) + C.py_packed_bytes(rows - order, bits), order, bits))
        best, order, bits = min(costs)
        plain = 9 * rows if typed else f["plain"]
        rival = min(best if bits <= C.WIDEST_PACKED else plain, plain)
        cycle, often = f.get("cycle"), f.get("frequency")
        if cycle and cycle["total_bytes"] + extra < rival:
            return ColumnPlan("cyclic", cycle["total_bytes"], {"period": cycle["period"], "misfits": cycle["misfits"], "bits": cycle["bits"], **typed})
        cost = run_cost(max(C.py_integer_cost(f["low"]), C.py_integer_cost(f["high"])))
        if may_run and cost + extra < rival and not (often and often["total_bytes"] < cost):
            return ColumnPlan("runs", cost, {"runs": runs, **typed})
        if often and often["total_bytes"] + extra < rival:
            return ColumnPlan("frequency", often["total_bytes"], {"top": often["top"], "exceptions": often["exceptions"], "bits": often["exception_bits"], "by_gaps": often["by_gaps"], **typed})
        if best + extra < plain and bits <= C.WIDEST_PACKED:
            return ColumnPlan("differenced", best, {"order": order, "bits": bits, "low": f["low"], **typed})
        return ColumnPlan("plain", plain)
    if f["kind"] == "double":
        found = f.get("decimal")
        if may_run and run_cost(9) + extra < min(9 * rows, found["total_bytes"] if found else 9 * rows):
            return ColumnPlan("runs", run_cost(9), {"runs": runs})
        if found and found["total_bytes"] + extra < 9 * rows:
            return ColumnPlan("decimal", found["total_bytes"], {k: found[k] for k in ("exponent", "factor", "bits", "low", "exceptions")})
        return ColumnPlan("plain", 9 * rows)
    book = f.get("dictionary")
    rival = min(f["bytes"], book["dictionary_bytes"] if book else f["bytes"])
    if may_run and run_cost(f["longest"] + 2) + extra < rival:
        return ColumnPlan("runs", run_cost(f["longest"] + 2), {"runs": runs})
    if f["dates"] == rows:
        return ColumnPlan("date", 5 + 2 * rows)
    head = f.get("prefix")
    if head and head["total_bytes"] + extra < rival:
        return ColumnPlan("prefixed", head["total_bytes"], {k: head[k] for k in ("prefix", "suffix", "width", "low", "bits")})
    if book and book["dictionary_bytes"] + extra < book["plain_bytes"]:
        return ColumnPlan("dictionary", book["dictionary_bytes"], {"entries": book["entries"]})
    return ColumnPlan("plain", f["bytes"])


def derive(df: DataFrame, order_by: list[str]) -> Plan:
    rows, figures = column_figures(df, order_by)
    return Plan({c: choose(rows, f) for c, f in figures.items()}, rows)


def plan_table(spark, plan: Plan) -> DataFrame:
    lines = [(n, p.form, int(p.cost), json.dumps(p.parameters, sort_keys=True)) for n, p in sorted(plan.columns.items())]
    return spark.createDataFrame(lines, "column string, form string, cost long, parameters string")


def validate(df: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Which columns fit a recorded (low, bits) frame: one aggregate, a row a column."""
    aggs = []
    for i, c in enumerate(limits):
        aggs += [F.min(c).cast("long").alias(f"low{i}"), F.max(c).cast("long").alias(f"high{i}"), F.sum(F.col(c).isNull().cast("long")).alias(f"nulls{i}")]
    lines = [F.struct(F.lit(c).alias("column"), F.col(f"low{i}").alias("low"), F.col(f"high{i}").alias("high"), (~((F.col(f"low{i}") >= low) & (F.col(f"high{i}") < low + (1 << bits)) & (F.col(f"nulls{i}") == 0))).alias("miss")) for i, (c, (low, bits)) in enumerate(limits.items())]
    return df.agg(*aggs).select(F.inline(F.array(*lines)))

"""Registered queries of the engine and their SQL twins, one pair a capability."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colform.functions import costs as C
from colform.functions import rotations
from colform.operators import diff as D
from colform.operators import forms, relate, sequential, shape, tree, wire
from colform.operators.profile import profile
from colform.plans import codec, planner
from colform.session import shared_root
from colform.sources.ordering import running_sum, with_lags, with_order
from colform.sources.tables import table
from colform.streaming import delta

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Unique key of lineitem; (l_orderkey, l_linenumber) is not unique.
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_root(spark)}/colform-{uuid.uuid4().hex}"


# --- SQL snippets of the oracles: the closed cost formulas --------------------------------------------------------


def _zz(x: str) -> str:
    return f"(CASE WHEN ({x}) < 0 THEN -2*({x})-1 ELSE 2*({x}) END)"


def _vw(x: str) -> str:
    return f"(CASE WHEN ({x}) <= 191 THEN 1 WHEN ({x}) <= 8383 THEN 2 WHEN ({x}) <= 1056959 THEN 3 WHEN ({x}) <= 4294967295 THEN 5 ELSE 9 END)"


def _ic(x: str) -> str:
    return f"(CASE WHEN ({x}) BETWEEN 0 AND 31 THEN 1 WHEN ({x}) BETWEEN -128 AND 255 THEN 2 WHEN ({x}) BETWEEN -32768 AND 65535 THEN 3 WHEN ({x}) BETWEEN -2147483648 AND 4294967295 THEN 5 ELSE 10 END)"


def _bits(x: str) -> str:
    return f"greatest(1, length(bin(CAST({x} AS BIGINT))))"


def _pk(n: str, b: str) -> str:
    return f"(({n}) * ({b}) + 7) // 8"


def _big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


# --- Profile ------------------------------------------------------------------------------------------------------


def _profile_sql(name: str, columns: list[tuple[str, str]]) -> str:
    lines = []
    for c, kind in columns:
        number = {"number": f"CAST({c} AS DOUBLE)", "time": f"CAST(epoch_us({c}) AS DOUBLE)"}.get(kind, "CAST(NULL AS DOUBLE)")
        text = c if kind == "text" else "CAST(NULL AS VARCHAR)"
        lines.append(
            f"SELECT '{c}' AS \"column\", count(*) AS rows, {_big(f'count(*) - count({c})')} AS nulls, CAST(0 AS BIGINT) AS nans, count(DISTINCT {c}) AS distinct_values,"
            f" (SELECT max(k) FROM (SELECT count(*) AS k FROM {name} WHERE {c} IS NOT NULL GROUP BY {c})) AS top_count,"
            f" coalesce(min({number}), 0) AS min_number, coalesce(max({number}), 0) AS max_number, coalesce(min({text}), '') AS min_text, coalesce(max({text}), '') AS max_text FROM {name}"
        )
    return " UNION ALL ".join(lines)


def _plain(found: DataFrame) -> DataFrame:
    """Without nulls, for the comparison with SQL."""
    return found.fillna({"min_number": 0.0, "max_number": 0.0, "min_text": "", "max_text": ""})


_LINEITEM = [("l_orderkey", "number"), ("l_partkey", "number"), ("l_linenumber", "number"), ("l_quantity", "number"), ("l_extendedprice", "number"), ("l_discount", "number"), ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "time")]
_EVENTS = [("event_id", "number"), ("ts", "time"), ("user_id", "number"), ("event_type", "text"), ("value", "number"), ("props", "text")]
_DOCUMENTS = [("doc_id", "number"), ("lang", "text"), ("source", "text"), ("n_chars", "number")]


@query(_profile_sql("lineitem", _LINEITEM))
def profile_lineitem(spark, sf_dir):
    return _plain(profile(table(spark, sf_dir, "lineitem"), [c for c, _ in _LINEITEM]))


@query(_profile_sql("events", _EVENTS))
def profile_events(spark, sf_dir):
    return _plain(profile(table(spark, sf_dir, "events"), [c for c, _ in _EVENTS]))


@query(_profile_sql("documents", _DOCUMENTS))
def profile_documents(spark, sf_dir):
    return _plain(profile(table(spark, sf_dir, "documents"), [c for c, _ in _DOCUMENTS]))


@query()
def form_plan_lineitem(spark, sf_dir):
    return planner.plan_table(spark, planner.derive(table(spark, sf_dir, "lineitem"), LINE_KEY))


# --- Frames and differences ---------------------------------------------------------------------------------------


def _difference_sql(rows: str) -> str:
    """``rows`` gives (k, x) with k the order."""
    return f"""
        WITH r AS ({rows}), l AS (SELECT k, x, lag(x) OVER (ORDER BY k) AS a, lag(x, 2) OVER (ORDER BY k) AS b, row_number() OVER (ORDER BY k) AS i FROM r),
        s AS (SELECT count(*) AS n, min(x) AS low, max(x) AS high, max({_zz('x - a')}) AS w1, max({_zz('x - 2*a + b')}) AS w2, max(CASE WHEN i = 1 THEN x END) AS s1, max(CASE WHEN i = 2 THEN x - a END) AS s2, sum({_ic('x')}) AS plain FROM l),
        o AS (SELECT 0 AS "order", high - low AS w, {_vw(_zz('low'))} AS seed_bytes, n AS m, plain FROM s
              UNION ALL SELECT 1, w1, {_vw(_zz('s1'))}, n - 1, plain FROM s UNION ALL SELECT 2, w2, {_vw(_zz('s1'))} + {_vw(_zz('s2'))}, n - 2, plain FROM s),
        t AS (SELECT "order", {_bits('w')} AS bits, seed_bytes, plain, 2 + seed_bytes + {_pk('m', _bits('w'))} AS total FROM o)
        SELECT {_big('"order"')} AS "order", {_big('bits')} AS bits, {_big('seed_bytes')} AS seed_bytes, {_big('plain')} AS plain_bytes, {_big('total')} AS total_bytes,
               row_number() OVER (ORDER BY total, "order") = 1 AND total < plain AS chosen FROM t"""


@query(_difference_sql("SELECT event_id AS k, event_id AS x FROM events"))
def form_differenced_events(spark, sf_dir):
    events = with_order(table(spark, sf_dir, "events").select("event_id"), ["event_id"])
    return forms.difference_stats(events, "event_id")


@query(_difference_sql("SELECT event_id AS k, epoch_us(ts) AS x FROM events"))
def form_differenced_event_times(spark, sf_dir):
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return forms.difference_stats(with_order(table(spark, sf_dir, "events").select("event_id", micros.alias("x")), ["event_id"]), "x")


@query("SELECT event_id, user_id FROM events")
def roundtrip_differenced_events(spark, sf_dir):
    events = with_order(table(spark, sf_dir, "events").select("event_id", "user_id"), ["event_id"])
    ids = forms.decode_differences(forms.encode_differences(events, "event_id", 2).select("_rn", "_chunk", "delta"), 2, "event_id")
    users = forms.decode_differences(forms.encode_differences(events, "user_id", 1).select("_rn", "_chunk", "delta"), 1, "user_id")
    return ids.select("_rn", "event_id").join(users.select("_rn", "user_id"), "_rn").select("event_id", "user_id")


def _frame_line(name: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", {_big(f'min({c})')} AS base, {_big(f'max({c}) - min({c})')} AS span, {_big(f'sum({_ic(c)})')} AS plain_bytes, {_big(_bits(f'max({c}) - min({c})'))} AS bits,
        {_big(f"2 + {_vw(_zz(f'min({c})'))} + " + _pk('count(*)', _bits(f'max({c}) - min({c})')))} AS packed_bytes FROM {name}"""


@query(" UNION ALL ".join(_frame_line("orders", c) for c in ("o_orderkey", "o_custkey")))
def form_bitpack_orders(spark, sf_dir):
    return forms.frame_stats(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"])


@query("SELECT o_orderkey, o_custkey FROM orders")
def roundtrip_bitpack_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    base = orders.agg(F.min("o_custkey").alias("b")).first()["b"] or 0
    return forms.decode_frame(forms.encode_frame(orders, "o_custkey", base).drop("o_custkey"), base, "o_custkey").select("o_orderkey", "o_custkey")


# --- Dominant value, runs, booleans, optional ---------------------------------------------------------------------


@query(
    f"""WITH r AS (SELECT toxic AS x, row_number() OVER (ORDER BY doc_id) AS i FROM labels), n AS (SELECT count(*) AS n FROM r),
    t AS (SELECT x AS top, count(*) AS k FROM r GROUP BY x ORDER BY k DESC, top LIMIT 1),
    e AS (SELECT x, i, i - coalesce(lag(i) OVER (ORDER BY i), 0) AS gap FROM r, t WHERE x <> top),
    s AS (SELECT count(*) AS c, coalesce(max({_zz('x')}), 0) AS w, coalesce(max(gap), 0) AS g FROM e),
    b AS (SELECT top, k, n, c, {_bits('w')} AS eb, (n + 7) // 8 AS bm, {_bits('g')} AS gb, 1 + {_pk('c', _bits('g'))} AS gy FROM s, t, n)
    SELECT {_big('top')} AS top, k AS top_count, c AS exceptions, {_big('eb')} AS exception_bits, {_big('bm')} AS bitmap_bytes, {_big('gb')} AS gap_bits, {_big('gy')} AS gap_bytes, gy < bm AS by_gaps,
    {_big(f"{_vw(_zz('top'))} + 1 + CASE WHEN c = 0 THEN 0 ELSE least(gy, bm) + {_pk('c', 'eb')} END")} AS total_bytes, k * 2 >= n AS accepted FROM b"""
)
def form_frequency_labels(spark, sf_dir):
    labels = with_order(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("long").alias("toxic")), ["doc_id"])
    return forms.frequency_stats(labels, "toxic")


@query("SELECT doc_id, CAST(toxic AS BIGINT) AS toxic FROM labels")
def roundtrip_frequency_labels(spark, sf_dir):
    labels = with_order(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("long").alias("toxic")), ["doc_id"])
    top, odd = forms.encode_frequency(labels, "toxic")
    return forms.decode_frequency(labels.select("_rn", "doc_id"), top, odd, "toxic").select("doc_id", "toxic")


_RUNS = "WITH r AS (SELECT {x} AS x, row_number() OVER (ORDER BY {k}) AS i FROM {t}), o AS (SELECT x, i, CASE WHEN x IS NOT DISTINCT FROM lag(x) OVER (ORDER BY i) AND i > 1 THEN 0 ELSE 1 END AS o FROM r), g AS (SELECT x, i, sum(o) OVER (ORDER BY i) AS run FROM o)"


@query(_RUNS.format(x="c_nationkey", k="c_nationkey, c_custkey", t="customer") + f" SELECT {_big('run')} AS run, {_big('min(x)')} AS value, count(*) AS length FROM g GROUP BY run")
def form_runs_customer(spark, sf_dir):
    rows = with_order(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey")), ["c_nationkey", "c_custkey"])
    return forms.runs(rows, "c_nationkey").select("run", "value", "length")


@query(
    _RUNS.format(x="role", k="conv_id, turn", t="conversations")
    + f", l AS (SELECT run, count(*) AS n FROM g GROUP BY run) SELECT {_big('sum(n)')} AS rows, count(*) AS runs, {_big('max(n)')} AS longest, {_big('least(sum(' + _vw('n') + '), 1 + ' + _pk('count(*)', _bits('max(n)')) + ')')} AS length_bytes, sum(n) >= 8 AND count(*) * 2 <= sum(n) AS accepted FROM l"
)
def form_runs_conversations_refused(spark, sf_dir):
    rows = with_order(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    found = forms.run_stats(rows, "role")
    return found.withColumn("rows", F.col("rows").cast("long")).withColumn("longest", F.col("longest").cast("long"))


@query("SELECT row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS position, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
def roundtrip_runs_customer(spark, sf_dir):
    rows = with_order(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey")), ["c_nationkey", "c_custkey"])
    return forms.decode_runs(forms.runs(rows, "c_nationkey"), "c_nationkey").withColumnRenamed("_rn", "position")


@query(f"WITH r AS (SELECT toxic, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM labels) SELECT i // 8 AS byte_no, {_big('sum(CASE WHEN toxic = 1 THEN 1 << CAST(i % 8 AS INTEGER) ELSE 0 END)')} AS packed FROM r GROUP BY 1")
def form_booleans_labels(spark, sf_dir):
    return forms.pack_booleans(with_order(table(spark, sf_dir, "labels").select("doc_id", "toxic"), ["doc_id"]), F.col("toxic") == 1)


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, toxic = 1 AS flag FROM labels")
def roundtrip_booleans_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    packed = forms.pack_booleans(with_order(labels, ["doc_id"]), F.col("toxic") == 1)
    return forms.unpack_booleans(packed, labels.count()).withColumnRenamed("_rn", "position")


@query("SELECT count(*) AS rows, count(*) - count(quality) AS missing, (count(*) + 7) // 8 AS bitmap_bytes, count(quality) > 0 AND count(quality) < count(*) AND (count(*) + 7) // 8 < count(*) - count(quality) AS accepted FROM documents LEFT JOIN labels USING (doc_id)")
def form_optional_documents_labels(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return forms.optional_stats(both, "quality")


@query("SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def roundtrip_optional_documents_labels(spark, sf_dir):
    """Presence bits by position and the present values packed together, joined back by their rank."""
    both = with_order(table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality"), ["doc_id"])
    ranked = running_sum(both, F.col("quality").isNotNull().cast("long"), "rank")
    values = ranked.where("quality is not null").select("rank", F.col("quality").alias("v"))
    present = ranked.select("doc_id", "rank", F.col("quality").isNotNull().alias("present"))
    return present.join(values, "rank", "left").select("doc_id", F.coalesce(F.when(F.col("present"), F.col("v")), F.lit(-1)).alias("quality"))


# --- Decimals -----------------------------------------------------------------------------------------------------

_DECIMALS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _decimal_sql(name: str, columns: list[str], top: int) -> str:
    parts = []
    for c in columns:
        for e in range(top + 1):
            for f in range(e + 1):
                s = f"{c} * {10.0**e!r}::DOUBLE / {10.0**f!r}::DOUBLE"
                r = f"CASE WHEN {s} >= 0 THEN floor({s} + 0.5::DOUBLE) ELSE -floor(-({s}) + 0.5::DOUBLE) END"
                parts.append(f"SELECT '{c}' AS \"column\", {e} AS exponent, {f} AS factor, {c} AS x, {r} AS r, (({r}) * {10.0**f!r}::DOUBLE / {10.0**e!r}::DOUBLE) = {c} AS same FROM {name}")
    rows = " UNION ALL ".join(parts)
    return f"""WITH p AS ({rows}), a AS (SELECT "column", exponent, factor, count(*) AS n, sum(CASE WHEN floor(x) <> x THEN 1 ELSE 0 END) AS frac, sum(CASE WHEN same THEN 0 ELSE 1 END) AS exc, {_big('min(CASE WHEN same THEN r END)')} AS low, {_big('max(CASE WHEN same THEN r END)')} AS high FROM p GROUP BY ALL),
        b AS (SELECT *, {_bits('high - low')} AS bits FROM a WHERE exc * 10 <= n AND exc < n AND frac > 0),
        c AS (SELECT *, 3 + {_vw(_zz('low'))} + {_pk('n', 'bits')} + {_vw('exc')} + exc * ({_vw('n')} + 9) AS total, min(CASE WHEN exc = 0 THEN exponent END) OVER (PARTITION BY "column") AS last FROM b),
        d AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY total, exponent, factor) AS k FROM c WHERE last IS NULL OR exponent <= last)
        SELECT "column", {_big('exponent')} AS exponent, {_big('factor')} AS factor, low, {_big('bits')} AS bits, {_big('exc')} AS exceptions, {_big('total')} AS total_bytes FROM d WHERE k = 1"""


@query(_decimal_sql("lineitem", _DECIMALS, 3))
def form_decimal_lineitem(spark, sf_dir):
    return forms.decimal_stats(table(spark, sf_dir, "lineitem").select(*_DECIMALS), _DECIMALS, 3)


@query("SELECT event_id, value FROM events")
def roundtrip_decimal_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    low = events.agg(F.min(C.round_half_away(F.col("value") * 100)).cast("long").alias("l")).first()["l"] or 0
    encoded = forms.encode_decimal(events, "value", 2, 0, low).drop("value")
    return forms.decode_decimal(encoded, 2, 0, low, "value").select("event_id", "value")


# --- Strings ------------------------------------------------------------------------------------------------------


@query(f"WITH d AS (SELECT CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS day FROM orders) SELECT count(*) AS rows, count(*) AS valid, {_big('min(day)')} AS base, {_big('max(day) - min(day)')} AS span, {_big(_bits('max(day) - min(day)'))} AS bits, {_big('1 + ' + _vw(_zz('min(day)')) + ' + ' + _pk('count(*)', _bits('max(day) - min(day)')))} AS packed_bytes FROM d")
def form_date_orders(spark, sf_dir):
    text = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("t"))
    day, valid = forms.date_days(F.col("t"))
    one = text.agg(F.count(F.lit(1)).alias("rows"), F.sum(valid.cast("long")).alias("valid"), F.min(day).cast("long").alias("base"), F.max(day).cast("long").alias("high")).withColumn("span", F.col("high") - F.col("base"))
    one = one.withColumn("bits", C.bits_for(F.col("span")))
    return one.select("rows", "valid", "base", "span", "bits", (1 + C.zigzag_width(F.col("base")) + C.packed_bytes(F.col("rows"), F.col("bits"))).cast("long").alias("packed_bytes"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day_text FROM orders")
def roundtrip_date_orders(spark, sf_dir):
    text = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("t"))
    day, _ = forms.date_days(F.col("t"))
    return text.select("o_orderkey", day.alias("n")).select("o_orderkey", F.date_format(F.date_from_unix_date("n"), "yyyy-MM-dd").alias("day_text"))


def _prefix_sql(condition: str) -> str:
    return f"""WITH v AS (SELECT CAST(substring(c_name, 10) AS BIGINT) AS x FROM customer WHERE {condition}),
        s AS (SELECT count(*) AS n, min(x) AS low, max(x) - min(x) AS span FROM v)
        SELECT 'Customer#' AS prefix, '' AS suffix, CAST(9 AS BIGINT) AS width, low, span, {_big(_bits('span'))} AS bits, span > 0 AND span + 1 <= 2 * n AS dense,
        {_big("3 + 9 + " + _vw(_zz('low')) + " + " + _pk('n', _bits('span')))} AS total_bytes, NOT (span > 0 AND span + 1 <= 2 * n) AS accepted FROM s"""


@query(_prefix_sql("true"))
def form_prefixed_int_customer(spark, sf_dir):
    return forms.prefix_stats(table(spark, sf_dir, "customer").select("c_name"), "c_name")


@query(_prefix_sql("c_custkey % 7 = 0"))
def form_prefixed_int_sparse(spark, sf_dir):
    return forms.prefix_stats(table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select("c_name"), "c_name")


@query(_difference_sql("SELECT c_custkey AS k, CAST(substring(c_name, 10) AS BIGINT) AS x FROM customer WHERE c_custkey % 7 = 0"))
def form_prefixed_int_sparse_differences(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select("c_custkey", F.substring("c_name", 10, 18).cast("long").alias("x"))
    return forms.difference_stats(with_order(rows, ["c_custkey"]), "x")


_PART_STRINGS = ["p_name", "p_brand", "p_type"]


def _dictionary_line(c: str) -> str:
    return f"""SELECT '{c}' AS "column", {c} AS value, row_number() OVER (ORDER BY min(p_partkey)) AS id, count(*) AS uses FROM part GROUP BY {c}"""


@query(" UNION ALL ".join(_dictionary_line(c) for c in _PART_STRINGS))
def form_dictionary_part(spark, sf_dir):
    part = with_order(table(spark, sf_dir, "part").select("p_partkey", *_PART_STRINGS), ["p_partkey"])
    out = None
    for c in _PART_STRINGS:
        one = forms.first_appearance(part, c, forms.DICTIONARY_LIMIT).select(F.lit(c).alias("column"), "value", "id", "uses")
        out = one if out is None else out.unionByName(one)
    return out


def _dictionary_stats_line(c: str) -> str:
    return f"""SELECT '{c}' AS "column", {_big('sum(u)')} AS rows, count(*) AS entries, {_big(_bits('count(*) - 1'))} AS id_bits, {_big('sum(strlen(v) + 2) + ' + _pk(_big('sum(u)'), _bits('count(*) - 1')))} AS dictionary_bytes, {_big('sum(strlen(v) + 2) + (sum(u) - count(*)) * 2')} AS plain_bytes,
        count(*) <= 4095 AND count(*) < sum(u) AND sum(strlen(v) + 2) + {_pk(_big('sum(u)'), _bits('count(*) - 1'))} < sum(strlen(v) + 2) + (sum(u) - count(*)) * 2 AS accepted FROM (SELECT {c} AS v, count(*) AS u FROM part GROUP BY {c})"""


@query(" UNION ALL ".join(_dictionary_stats_line(c) for c in _PART_STRINGS))
def form_dictionary_costs_part(spark, sf_dir):
    return forms.dictionary_stats(with_order(table(spark, sf_dir, "part").select("p_partkey", *_PART_STRINGS), ["p_partkey"]), _PART_STRINGS)


@query("SELECT p_partkey, p_brand FROM part")
def roundtrip_dictionary_part(spark, sf_dir):
    part = with_order(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), ["p_partkey"])
    entries = forms.first_appearance(part, "p_brand", forms.DICTIONARY_LIMIT)
    return forms.decode_dictionary(forms.encode_dictionary(part, "p_brand", entries).select("p_partkey", "id"), entries, "p_brand").select("p_partkey", "p_brand")


@query("WITH s AS (SELECT l_returnflag AS v FROM lineitem UNION ALL SELECT l_linestatus FROM lineitem UNION ALL SELECT o_orderstatus FROM orders UNION ALL SELECT o_orderpriority FROM orders) SELECT v AS value, count(*) AS uses, row_number() OVER (ORDER BY v) AS id FROM s GROUP BY v")
def form_shared_strings(spark, sf_dir):
    """One table of strings for several columns; ids by value, as columns of different tables have no common row order."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    cells = lines.select(F.inline(F.array(F.struct(F.col("l_returnflag").alias("value")), F.struct(F.col("l_linestatus").alias("value"))))).unionByName(
        orders.select(F.inline(F.array(F.struct(F.col("o_orderstatus").alias("value")), F.struct(F.col("o_orderpriority").alias("value")))))
    )
    return cells.groupBy("value").agg(F.count(F.lit(1)).alias("uses")).withColumn("id", F.row_number().over(Window.orderBy("value")).cast("long"))


# --- Cycles -------------------------------------------------------------------------------------------------------


def _cycle_sql(rows: str) -> str:
    return f"""WITH r AS ({rows}), n AS (SELECT count(*) AS n FROM r), p AS (SELECT unnest(range(2, 129)) AS p),
        m AS (SELECT p, r.i, r.x, c.x AS c FROM r, p, n, r AS c WHERE p <= n // 4 AND n >= 32 AND c.i = r.i % p AND c.i < 128),
        a AS (SELECT p, count(*) AS n, sum(CASE WHEN x <> c THEN 1 ELSE 0 END) AS bad, min(CASE WHEN i < p THEN x END) AS low, max(CASE WHEN i < p THEN x END) AS high, sum(CASE WHEN x <> c THEN {_vw('i + 1')} + {_vw(_zz('x'))} ELSE 0 END) AS badbytes FROM m GROUP BY p),
        b AS (SELECT p, bad, {_bits('high - low')} AS bits, 2 + {_vw('p')} + {_vw(_zz('low'))} + {_pk('p', _bits('high - low'))} + {_vw('bad')} + badbytes AS total FROM a WHERE bad * 10 <= n AND high > low)
        SELECT {_big('p')} AS period, {_big('bad')} AS misfits, {_big('bits')} AS bits, {_big('total')} AS total_bytes FROM b ORDER BY bad > 0, total, p LIMIT 1"""


@query(_cycle_sql("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, CAST(substring(source, 4) AS BIGINT) AS x FROM documents"))
def form_cyclic_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring("source", 4, 10).cast("long").alias("x"))
    return forms.cycle_stats(with_order(docs, ["doc_id"]), "x")


@query(_cycle_sql("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, CAST(floor(p_retailprice * 10 + 0.5) AS BIGINT) AS x FROM part"))
def form_cyclic_part_refused(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_retailprice") * 10 + 0.5).cast("long").alias("x"))
    return forms.cycle_stats(with_order(part, ["p_partkey"]), "x")


@query("SELECT doc_id, CAST(substring(source, 4) AS BIGINT) AS source_number FROM documents")
def roundtrip_cyclic_documents(spark, sf_dir):
    docs = with_order(table(spark, sf_dir, "documents").select("doc_id", F.substring("source", 4, 10).cast("long").alias("x")), ["doc_id"])
    found = forms.cycle_stats(docs, "x").first()
    if found is None:  # no cycle: the column stays as it is
        return docs.select("doc_id", F.col("x").alias("source_number"))
    period = found["period"]
    cycle = docs.where(F.col("_rn") < period).select(F.col("_rn").alias("place"), F.col("x").alias("expected"))
    placed = docs.withColumn("place", F.col("_rn") % period).join(F.broadcast(cycle), "place")
    odd = placed.where("x <> expected").select("_rn", F.col("x").alias("odd"))
    return forms.decode_cycle(docs.select("_rn", "doc_id"), cycle, period, "base").join(odd, "_rn", "left").select("doc_id", F.coalesce("odd", "base").alias("source_number"))


# --- Relations ----------------------------------------------------------------------------------------------------


def _customer_nation(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))


def _mapping_sql(source: str, target: str) -> str:
    return f"""WITH p AS (SELECT {source} AS s, {target} AS t, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, t) AS k FROM p),
        a AS (SELECT {_big('sum(n)')} AS rows, count(DISTINCT s) AS ds, count(DISTINCT t) AS dt, {_big('sum(CASE WHEN k > 1 THEN n ELSE 0 END)')} AS e FROM r)
        SELECT '{source}' AS source, '{target}' AS target, rows, ds AS distinct_source, dt AS distinct_target, e AS exceptions, {_big(_bits('dt'))} AS target_bits, ds >= 3 AND ds * 2 <= rows AND dt * 2 <= rows AND e * 10 <= rows AS qualifies, ds <= 4 * dt AS passes_gate FROM a"""


@query(_mapping_sql("c_nationkey", "n_name"))
def form_mapped_nation_name(spark, sf_dir):
    return relate.mapping_stats(_customer_nation(spark, sf_dir), "c_nationkey", "n_name", True)


@query(_mapping_sql("c_nationkey", "n_regionkey"))
def form_mapped_nation_region(spark, sf_dir):
    return relate.mapping_stats(_customer_nation(spark, sf_dir), "c_nationkey", "n_regionkey", False)


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def roundtrip_mapped_nation(spark, sf_dir):
    rows = _customer_nation(spark, sf_dir).select("c_custkey", "c_nationkey", "n_name")
    mapping, odd = relate.encode_mapping(rows, "c_nationkey", "n_name")
    return relate.decode_mapping(rows.drop("n_name"), "c_nationkey", mapping, odd, ["c_custkey"], "n_name").select("c_custkey", "n_name")


def _multimap_sql(rows: str, source: str, target: str) -> str:
    return f"""WITH r AS ({rows}), p AS (SELECT DISTINCT {source} AS s, {target} AS t FROM r), k AS (SELECT s, count(*) AS k FROM p GROUP BY s),
        a AS (SELECT (SELECT count(*) FROM r) AS rows, count(*) AS ds, max(k) AS w, (SELECT count(DISTINCT t) FROM p) AS dt FROM k)
        SELECT '{source}' AS source, '{target}' AS target, rows, ds AS distinct_source, dt AS distinct_target, w AS widest, {_big(_bits('w - 1'))} AS code_bits, {_big(_bits('dt - 1'))} AS alone_bits, ds < dt AND ds * 2 <= rows AND {_bits('w - 1')} < {_bits('dt - 1')} AS accepted FROM a"""


@query(_multimap_sql("SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey", "n_regionkey", "c_nationkey"))
def form_multimapped_region_nation(spark, sf_dir):
    return relate.multimap_stats(_customer_nation(spark, sf_dir), "n_regionkey", "c_nationkey")


@query(_multimap_sql("SELECT * FROM part", "p_brand", "p_type"))
def form_multimapped_part_refused(spark, sf_dir):
    return relate.multimap_stats(table(spark, sf_dir, "part"), "p_brand", "p_type")


def _order_days(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"), F.unix_date(F.to_date("o_orderdate")).cast("long").alias("day"))


@query(
    f"""WITH d AS (SELECT year(o_orderdate) AS s, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS t FROM orders), g AS (SELECT s, min(t) AS low, max(t) AS high, count(*) AS n FROM d GROUP BY s),
    a AS (SELECT count(*) AS ds, sum(n) AS rows, max(high - low) AS w, min(low) AS base, max(high) AS top, sum({_ic('low')}) AS refs FROM g)
    SELECT ds AS distinct_source, {_big('rows')} AS rows, {_big('w')} AS widest, {_big(_bits('w'))} AS offset_bits, {_big(_bits('top - base'))} AS whole_bits, {_big(_vw('ds') + ' + refs + 1 + ' + _pk(_big('rows'), _bits('w')))} AS total_bytes FROM a"""
)
def form_dictionary_for_orders(spark, sf_dir):
    return relate.group_frame_stats(_order_days(spark, sf_dir), "year", "day")


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS BIGINT) AS day FROM orders")
def roundtrip_dictionary_for_orders(spark, sf_dir):
    references, encoded = relate.encode_group_frame(_order_days(spark, sf_dir), "year", "day")
    return relate.decode_group_frame(encoded, references, "year", "day").select("o_orderkey", "day")


@query("SELECT count(*) AS rows, CAST(sum(CASE WHEN n_chars IS DISTINCT FROM length(text) THEN 1 ELSE 0 END) AS BIGINT) AS exceptions, sum(CASE WHEN n_chars IS DISTINCT FROM length(text) THEN 1 ELSE 0 END) * 10 <= count(*) AS accepted FROM documents")
def form_equality_documents(spark, sf_dir):
    return relate.equality_stats(table(spark, sf_dir, "documents"), F.col("n_chars"), F.char_length("text").cast("long"))


@query(
    f"""WITH d AS (SELECT p_partkey % 1000 AS a, CAST(floor(p_retailprice * 10 + 0.5) AS BIGINT) AS b FROM part), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(a) AS DOUBLE) AS sa, CAST(sum(b) AS DOUBLE) AS sb, CAST(sum(a * a) AS DOUBLE) AS saa, CAST(sum(a * b) AS DOUBLE) AS sab FROM d),
    f AS (SELECT CAST(floor((sab - sa * sb / n) / (saa - sa * sa / n) + 0.5) AS BIGINT) AS slope, n, sa, sb FROM s), g AS (SELECT slope, CAST(floor((sb - slope * sa) / n + 0.5) AS BIGINT) AS intercept FROM f),
    w AS (SELECT slope, intercept, count(*) AS n, max({_zz('b - (slope * a + intercept)')}) AS w FROM d, g GROUP BY ALL)
    SELECT slope, intercept, {_big('w')} AS widest, {_big(_bits('w'))} AS bits, {_big('2 + ' + _vw(_zz('slope')) + ' + ' + _vw(_zz('intercept')) + ' + ' + _pk('n', _bits('w')))} AS total_bytes FROM w"""
)
def form_correlated_part(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return relate.linear_stats(part, F.col("p_partkey") % 1000, F.floor(F.col("p_retailprice") * 10 + 0.5))


_PAIRS = ["quantity", "price", "discount", "tax", "line"]
_PAIR_ROWS = "SELECT CAST(l_quantity AS BIGINT) AS quantity, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS price, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS discount, CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS tax, CAST(l_linenumber AS BIGINT) AS line FROM lineitem"


def _pair_line(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS a, '{b}' AS b, CAST(count(*) AS DOUBLE) AS n, CAST(sum({a}) AS DOUBLE) AS sa, CAST(sum({b}) AS DOUBLE) AS sb, CAST(sum({a}::HUGEINT * {a}) AS DOUBLE) AS qa, CAST(sum({b}::HUGEINT * {b}) AS DOUBLE) AS qb, CAST(sum({a}::HUGEINT * {b}) AS DOUBLE) AS p FROM d"""


@query(
    f"WITH d AS ({_PAIR_ROWS}), s AS ({' UNION ALL '.join(_pair_line(a, b) for i, a in enumerate(_PAIRS) for b in _PAIRS[i + 1 :])}), "
    "v AS (SELECT *, qa / n - (sa / n) * (sa / n) AS va, qb / n - (sb / n) * (sb / n) AS vb FROM s), r AS (SELECT a, b, CASE WHEN va > 0 AND vb > 0 THEN (p / n - (sa / n) * (sb / n)) / sqrt(va * vb) ELSE 0 END AS r FROM v) "
    "SELECT a, b, CAST(floor(r * 10000 + 0.5) AS BIGINT) AS r_e4, abs(r) >= 0.9 AS passes FROM r"
)
def pair_stats_lineitem(spark, sf_dir):
    cents = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("long")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("quantity"), cents("l_extendedprice").alias("price"), cents("l_discount").alias("discount"), cents("l_tax").alias("tax"), F.col("l_linenumber").cast("long").alias("line"))
    return relate.pair_stats(rows, _PAIRS)


@query()
def correlation_assignment(spark, sf_dir):
    rows = _customer_nation(spark, sf_dir).select("c_nationkey", "n_name", "n_regionkey", "c_mktsegment")
    return relate.correlation_assignment(rows, ["c_nationkey", "n_name", "n_regionkey", "c_mktsegment"])


# --- Shapes -------------------------------------------------------------------------------------------------------


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def shape_flatten_events(spark, sf_dir):
    nested = table(spark, sf_dir, "events").select("event_id", F.struct("event_type", F.struct(F.from_json("props", "k long").alias("props")).alias("inner")).alias("e"))
    flat, paths = shape.flatten(nested)
    names = {("event_id",): "event_id", ("e", "event_type"): "event_type", ("e", "inner", "props", "k"): "k"}
    return flat.select(*[F.col(f"c{i}").alias(names[p]) for i, p in enumerate(paths)])


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def shape_unflatten_events(spark, sf_dir):
    nested = table(spark, sf_dir, "events").select("event_id", F.struct("event_type", F.from_json("props", "k long").alias("props")).alias("e"))
    flat, paths = shape.flatten(nested)
    return shape.unflatten(flat, paths).select("event_id", "e.event_type", "e.props.k")


@query("SELECT l_orderkey, count(*) AS length, CAST(sum(l_linenumber) AS BIGINT) AS line_sum, CAST(max(l_partkey) AS BIGINT) AS top_part FROM lineitem GROUP BY l_orderkey")
def shape_batch_lineitem(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    arrays = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("items"))
    items, lengths = shape.explode_batch(arrays, ["l_orderkey"], "items")
    back = shape.implode_batch(items, lengths, ["l_orderkey"], "items")
    return back.select("l_orderkey", F.size("items").cast("long").alias("length"), F.expr("aggregate(items, 0L, (s, x) -> s + x.l_linenumber)").alias("line_sum"), F.expr("array_max(transform(items, x -> x.l_partkey))").alias("top_part"))


@query("SELECT n_name AS entry_key, CAST(n_nationkey AS INTEGER) AS nationkey, CAST(n_regionkey AS INTEGER) AS regionkey FROM nation")
def shape_transpose_nation(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.lit(1).alias("one"), F.col("n_name").alias("entry_key"), F.struct(F.col("n_nationkey").alias("nationkey"), F.col("n_regionkey").alias("regionkey")).alias("value"))
    as_map = shape.untranspose_map(rows, ["one"], "nations")
    return shape.transpose_map(as_map, ["one"], "nations").select("entry_key", "value.nationkey", "value.regionkey")


@query("SELECT 'embedding' AS \"column\", CASE WHEN min(len(embedding)) = max(len(embedding)) AND min(len(embedding)) BETWEEN 1 AND 256 THEN min(len(embedding)) END AS width FROM embeddings")
def shape_tuple_width_embeddings(spark, sf_dir):
    return spark.createDataFrame([("embedding", shape.tuple_width(table(spark, sf_dir, "embeddings"), "embedding"))], "column string, width long")


@query("SELECT vec_id, embedding[2] AS second, embedding[10] AS tenth, embedding[64] AS last, len(embedding) AS width FROM embeddings")
def shape_tuple_embeddings(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    back = shape.tuple_restore(shape.tuple_columns(vectors, "embedding", 64), 64, "embedding")
    return back.select("vec_id", F.col("embedding")[1].alias("second"), F.col("embedding")[9].alias("tenth"), F.col("embedding")[63].alias("last"), F.size("embedding").cast("long").alias("width"))


@query("SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, c_acctbal AS balance, CAST(-1 AS INTEGER) AS size FROM customer UNION ALL SELECT p_partkey, p_name, 0.0::DOUBLE, p_size FROM part")
def shape_union_keys(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return shape.union_keys(a, b).fillna({"size": -1, "balance": 0.0})


@query("SELECT p_brand, p_size, row_number() OVER (ORDER BY min(p_partkey)) AS id, count(*) AS uses FROM part GROUP BY p_brand, p_size")
def form_struct_dictionary_part(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.struct("p_brand", "p_size").alias("v"))
    return shape.struct_dictionary(rows, "v", "p_partkey").select("v.p_brand", "v.p_size", "id", "uses")


@query("SELECT c_custkey, c_nationkey AS place_nation, c_mktsegment AS place_segment FROM customer")
def form_struct_split_customer(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("place"))
    return shape.split_struct(rows, "place")


@query(
    "WITH c AS (SELECT unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings), s AS (SELECT CAST(dim AS INTEGER) AS dim, x, CAST(CASE WHEN x::DOUBLE * 1000 >= 0 THEN floor(x::DOUBLE * 1000 + 0.5) ELSE -floor(-(x::DOUBLE) * 1000 + 0.5) END AS BIGINT) AS s FROM c), "
    "b AS (SELECT dim, CAST(trunc(quantile_cont(s, 0.5)) AS BIGINT) AS base, bool_and(CAST(s / 1000.0::DOUBLE AS FLOAT) = x) AS exact FROM s GROUP BY dim), "
    f"w AS (SELECT s.dim, base, exact, max({_zz('s - base')}) AS widest FROM s JOIN b ON s.dim = b.dim GROUP BY ALL) SELECT dim, base, exact, widest, {_big(_bits('widest'))} AS bits FROM w"
)
def delta_vector_embeddings(spark, sf_dir):
    return sequential.vector_deltas(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query(
    "WITH r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS _rn, event_type AS v FROM events), p AS (SELECT _rn, v, lag(_rn) OVER (PARTITION BY v ORDER BY _rn) AS before FROM r), "
    "f AS (SELECT p._rn, p.before, count(DISTINCT r.v) AS between_them FROM p LEFT JOIN r ON r._rn > p.before AND r._rn < p._rn GROUP BY p._rn, p.before) SELECT _rn, CASE WHEN before IS NOT NULL AND between_them < 8 THEN between_them END AS fold FROM f"
)
def string_move_to_front_events(spark, sf_dir):
    return sequential.move_to_front(with_order(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"]), "event_type")


@query("SELECT event_id, CASE WHEN lag(props) OVER (ORDER BY event_id) IS NULL THEN 0 WHEN lag(props) OVER (ORDER BY event_id) = props THEN length(props) ELSE (SELECT coalesce(max(i), 0) FROM (SELECT unnest(range(1, least(length(props), 255) + 1)) AS i) WHERE left(props, i) = left(p, i)) END AS shared_prefix FROM (SELECT event_id, props, lag(props) OVER (ORDER BY event_id) AS p FROM events)".replace("lag(props) OVER (ORDER BY event_id) IS NULL", "p IS NULL").replace("lag(props) OVER (ORDER BY event_id) = props", "p = props"))
def string_shared_prefix_events(spark, sf_dir):
    rows = with_lags(with_order(table(spark, sf_dir, "events").select("event_id", "props"), ["event_id"]), ["props"], 1)
    shared = F.expr("aggregate(sequence(1, least(length(props), length(props_lag1), 255)), 0, (k, i) -> if(k = i - 1 and substring(props, i, 1) = substring(props_lag1, i, 1), i, k))")
    return rows.select("event_id", F.coalesce(shared, F.lit(0)).cast("long").alias("shared_prefix"))


# --- Scalars ------------------------------------------------------------------------------------------------------


@query(f"WITH v AS (SELECT event_id, CAST(floor(value * 100 + 0.5) AS BIGINT) - 20000 AS x, value FROM events) SELECT event_id, x, {_big(_zz('x'))} AS zigzag, {_big(_vw(_zz('x')))} AS varint_width, {_big(_ic('x'))} AS integer_cost, CASE WHEN floor(value) = value AND value BETWEEN 0 AND 31 THEN 'small' WHEN floor(value) = value AND value BETWEEN 0 AND 255 THEN 'u8' WHEN floor(value) = value AND value BETWEEN 0 AND 65535 THEN 'u16' WHEN floor(value) = value AND value BETWEEN 0 AND 4294967295 THEN 'u32' WHEN CAST(CAST(value AS FLOAT) AS DOUBLE) = value THEN 'f32' ELSE 'f64' END AS tag FROM v")
def scalar_zigzag_varint(spark, sf_dir):
    x = F.floor(F.col("value") * 100 + 0.5).cast("long") - 20000
    rows = table(spark, sf_dir, "events").select("event_id", x.alias("x"), "value")
    return rows.select("event_id", "x", C.zigzag(F.col("x")).alias("zigzag"), C.zigzag_width(F.col("x")).alias("varint_width"), C.integer_cost(F.col("x")).alias("integer_cost"), C.number_tag(F.col("value")).alias("tag"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN l_extendedprice / 0.25 >= 0 THEN floor(l_extendedprice / 0.25 + 0.5) ELSE -floor(-l_extendedprice / 0.25 + 0.5) END AS BIGINT) AS q, abs(CASE WHEN l_extendedprice / 0.25 >= 0 THEN floor(l_extendedprice / 0.25 + 0.5) ELSE -floor(-l_extendedprice / 0.25 + 0.5) END * 0.25 - l_extendedprice) <= 0.125 AS within FROM lineitem")
def scalar_quantize_lineitem(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("q", C.quantize(F.col("l_extendedprice"), 0.25))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q", (F.abs(C.dequantize(F.col("q"), 0.25) - F.col("l_extendedprice")) <= 0.125).alias("within"))


@query("SELECT event_id, CAST(CAST(value AS FLOAT) AS DOUBLE) = value AS exact FROM events")
def scalar_f32_exact(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (F.col("value").cast("float").cast("double") == F.col("value")).alias("exact"))


@query(
    "WITH a AS (SELECT * FROM (VALUES (1, 1, 0, 0), (2, -1, 0, 0), (3, 0, 1, 0), (4, 0, -1, 0), (5, 0, 0, 1), (6, 0, 0, -1)) AS t(i, x, y, z)), n AS (SELECT CAST(row_number() OVER (ORDER BY p.i, q.i) AS INTEGER) AS number, p.x AS xx, p.y AS xy, p.z AS xz, q.x AS yx, q.y AS yy, q.z AS yz "
    "FROM a p JOIN a q ON p.x * q.x = 0 AND p.y * q.y = 0 AND p.z * q.z = 0) SELECT *, number AS found FROM n"
)
def scalar_rotations(spark, sf_dir):
    lines = [(i, *a, *b, rotations.rotation_id(a, b)) for i, (a, b) in enumerate(rotations.axis_rotations(), 1)]
    return spark.createDataFrame(lines, "number int, xx int, xy int, xz int, yx int, yy int, yz int, found int")


# --- Change sets --------------------------------------------------------------------------------------------------


def _orders(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """orders, and a later snapshot: keys % 10 = 3 are gone, % 10 = 5 have another total and status, % 10 = 7 come again as new keys."""
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("cents"))
    k = F.col("o_orderkey") % 10
    current = base.where(k != 3).withColumn("cents", F.when(k == 5, F.col("cents") + 100).otherwise(F.col("cents"))).withColumn("o_orderstatus", F.when((k == 5) & (F.col("o_orderkey") % 20 == 5), F.lit("X")).otherwise(F.col("o_orderstatus")))
    return base, current.unionByName(base.where(k == 7).withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000))


_BASE = "b AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents FROM orders)"
_CURRENT = _BASE + ", c AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 20 = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 10 = 5 THEN cents + 100 ELSE cents END AS cents FROM b WHERE o_orderkey % 10 <> 3 UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, cents FROM b WHERE o_orderkey % 10 = 7)"
_DIFF = (
    "WITH " + _CURRENT + ", j AS (SELECT coalesce(b.o_orderkey, c.o_orderkey) AS o_orderkey, b.o_orderkey IS NULL AS added, c.o_orderkey IS NULL AS gone, (CASE WHEN b.o_custkey IS DISTINCT FROM c.o_custkey THEN 1 ELSE 0 END) + (CASE WHEN b.o_orderstatus IS DISTINCT FROM c.o_orderstatus THEN 2 ELSE 0 END) + (CASE WHEN b.cents IS DISTINCT FROM c.cents THEN 4 ELSE 0 END) AS m, c.cents AS n_cents, b.cents AS b_cents FROM b FULL JOIN c ON b.o_orderkey = c.o_orderkey), "
    "d AS (SELECT o_orderkey, CASE WHEN added THEN 1 WHEN gone THEN 2 ELSE 4 END AS op, CASE WHEN added OR gone THEN 0 ELSE m END AS mask, n_cents, b_cents FROM j WHERE added OR gone OR m <> 0)"
)


@query(_DIFF + " SELECT o_orderkey, CAST(op AS INTEGER) AS op, CAST(mask AS BIGINT) AS mask, coalesce(n_cents, 0) AS n_cents FROM d")
def diff_orders(spark, sf_dir):
    return D.diff(*_orders(spark, sf_dir), ["o_orderkey"]).select("o_orderkey", "op", "mask", "n_cents").fillna({"n_cents": 0})


@query("WITH " + _CURRENT + " SELECT * FROM c")
def patch_orders(spark, sf_dir):
    base, current = _orders(spark, sf_dir)
    return D.patch(base, D.diff(base, current, ["o_orderkey"]), ["o_orderkey"], D.fingerprint(base, ["o_orderkey"]))


@query(
    _DIFF
    + f""", p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM b), h AS (SELECT i, mask, i - coalesce(lag(i) OVER (ORDER BY i), 0) AS gap FROM d JOIN p USING (o_orderkey) WHERE op = 4),
    a AS (SELECT (SELECT count(*) FROM b) AS n, count(*) AS c, {_big(f"sum({_vw('gap')})")} AS gb, count(DISTINCT mask) AS masks, max(mask) AS wm, sum({_vw('mask')}) AS mv FROM h)
    SELECT n AS rows, c AS changed, gb AS gap_bytes, (n + 7) // 8 AS bitmap_bytes, gb < (n + 7) // 8 AS by_gaps, CASE WHEN masks = 1 THEN 'uniform' WHEN 1 + {_pk('c', _bits('wm'))} < mv THEN 'packed' ELSE 'varint' END AS mask_form FROM a"""
)
def diff_rowset_cost(spark, sf_dir):
    base, current = _orders(spark, sf_dir)
    return D.row_set_costs(D.diff(base, current, ["o_orderkey"]), with_order(base.select("o_orderkey"), ["o_orderkey"]), ["o_orderkey"])


@query(_DIFF + f" SELECT 'cents' AS field, count(*) AS changed, {_big(_bits(f'max({_zz('n_cents')})'))} AS absolute_bits, {_big(_bits(f'max({_zz('n_cents - b_cents')})'))} AS delta_bits, {_bits(f'max({_zz('n_cents - b_cents')})')} < {_bits(f'max({_zz('n_cents')})')} AS by_delta FROM d WHERE op = 4 AND mask & 4 <> 0")
def diff_value_forms(spark, sf_dir):
    return D.value_form_stats(D.diff(*_orders(spark, sf_dir), ["o_orderkey"]), [(2, "cents")])


def _share(percent: int) -> str:
    return f"SELECT CAST({percent} AS INTEGER) AS percent, (SELECT count(*) FROM orders WHERE o_orderkey % 100 < {percent}) AS changed, count(*) AS rows, (SELECT count(*) FROM orders WHERE o_orderkey % 100 < {percent}) < 0.5 * count(*) AS keep_patch FROM orders"


@query(" UNION ALL ".join(_share(p) for p in (0, 5, 25, 100)))
def diff_guard(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    out = None
    for p in (0, 5, 25, 100):
        current = base.withColumn("o_custkey", F.when(F.col("o_orderkey") % 100 < p, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
        one = D.changed_fraction(base, current, ["o_orderkey"]).select(F.lit(p).alias("percent"), "changed", "rows", "keep_patch")
        out = one if out is None else out.unionByName(one)
    return out


def _guarded(percent: int) -> str:
    hit = f"o_orderkey % 100 < {percent}"
    now = f"(CASE WHEN {hit} THEN o_custkey + 1 ELSE o_custkey END)"
    patch = f"coalesce(sum(CASE WHEN {hit} THEN 2 + {_ic('o_orderkey')} + {_ic('o_custkey + 1')} ELSE 0 END), 0)"
    full = f"coalesce(sum({_ic('o_orderkey')} + {_ic(now)}), 0)"
    return f"SELECT CAST({percent} AS INTEGER) AS percent, {_big(patch)} AS patch_bytes, {_big(full)} AS full_bytes, {patch} < {full} AS is_patch, count(*) AS rows_after FROM orders"


@query(" UNION ALL ".join(_guarded(p) for p in (0, 5, 25, 100)))
def diff_guarded_bytes(spark, sf_dir):
    """A change set or the whole, whichever has fewer bytes, at four shares of changed rows."""
    base, keys, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], []
    for p in (0, 5, 25, 100):
        current = base.withColumn("o_custkey", F.when(F.col("o_orderkey") % 100 < p, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
        update = D.guarded_diff(base, current, keys)
        lines.append((p, update.patch_bytes, update.full_bytes, D.is_patch(update), D.apply_update(base, update, keys).count()))
    return spark.createDataFrame(lines, "percent int, patch_bytes long, full_bytes long, is_patch boolean, rows_after long")


def _inspect_sql() -> str:
    key, fields = _ic("o_orderkey"), (("o_custkey", 1, _ic("n_custkey")), ("o_orderstatus", 2, "strlen(n_status) + 2"), ("cents", 4, _ic("n_cents")))
    rows = "WITH " + _CURRENT + ", j AS (SELECT coalesce(b.o_orderkey, c.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'set' WHEN c.o_orderkey IS NULL THEN 'remove' ELSE 'row' END AS op, (CASE WHEN b.o_custkey IS DISTINCT FROM c.o_custkey THEN 1 ELSE 0 END) + (CASE WHEN b.o_orderstatus IS DISTINCT FROM c.o_orderstatus THEN 2 ELSE 0 END) + (CASE WHEN b.cents IS DISTINCT FROM c.cents THEN 4 ELSE 0 END) AS m, c.o_custkey AS n_custkey, c.o_orderstatus AS n_status, c.cents AS n_cents FROM b FULL JOIN c ON b.o_orderkey = c.o_orderkey), d AS (SELECT * FROM j WHERE op <> 'row' OR m <> 0) "
    line = lambda op, field, holds, cost: f"SELECT '{op}' AS op, '{field}' AS field, count(CASE WHEN {holds} THEN 1 END) AS changed, {_big(f'coalesce(sum(CASE WHEN {holds} THEN {cost} ELSE 0 END), 0)')} AS bytes FROM d"
    lines = [line("set", "", "op = 'set'", f"1 + {key}"), line("remove", "", "op = 'remove'", f"1 + {key}"), line("row", "", "op = 'row'", f"1 + {key} + {_vw('m')}")]
    lines += [line("set", f, "op = 'set'", cost) for f, _, cost in fields] + [line("row", f, f"op = 'row' AND m & {bit} <> 0", cost) for f, bit, cost in fields]
    return rows + " UNION ALL ".join(lines)


@query(_inspect_sql())
def inspect_diff_orders(spark, sf_dir):
    return D.inspect_diff(D.diff(*_orders(spark, sf_dir), ["o_orderkey"]), ["o_orderkey"])


@query("WITH " + _CURRENT + " SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN NULL ELSE cents END AS cents, CASE WHEN o_orderkey % 10 = 1 THEN NULL ELSE o_orderstatus END AS status, o_orderkey % 10 = 1 AS missing FROM c")
def diff_descend_orders(spark, sf_dir):
    """Changes of fields inside a struct of a struct, applied; some rows lose the whole inner struct."""
    inner = F.when(~F.col("lost"), F.struct("cents", F.col("o_orderstatus").alias("status")))
    base, current = ((df.withColumn("lost", lost).select("o_orderkey", F.struct("o_custkey", inner.alias("state")).alias("doc"))) for df, lost in zip(_orders(spark, sf_dir), (F.lit(False), F.col("o_orderkey") % 10 == 1)))
    keys = ["o_orderkey"]
    flat = D.opened(base, keys)
    done = D.closed(D.patch(flat, D.diff(flat, D.opened(current, keys), keys), keys), base.schema, keys)
    return done.select("o_orderkey", "doc.state.cents", "doc.state.status", F.col("doc.state").isNull().alias("missing"))


@query("WITH l AS (SELECT user_id, event_id, event_type, value, lag(event_id) OVER w AS pi, lag(event_type) OVER w AS pt, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, CAST(CASE WHEN pi IS NULL THEN 3 ELSE (CASE WHEN event_type IS DISTINCT FROM pt THEN 1 ELSE 0 END) + (CASE WHEN value IS DISTINCT FROM pv THEN 2 ELSE 0 END) END AS BIGINT) AS mask, coalesce(CAST(floor(value * 100 + 0.5) AS BIGINT) - CAST(floor(pv * 100 + 0.5) AS BIGINT), 0) AS delta_cents FROM l")
def diff_fields_events_by_user(spark, sf_dir):
    return delta.batch_deltas(table(spark, sf_dir, "events")).fillna({"delta_cents": 0})


@query(
    "WITH l AS (SELECT user_id, event_id, event_type, value, lag(event_id) OVER w AS pi, lag(event_type) OVER w AS pt, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, "
    "CAST(CASE WHEN pi IS NULL THEN 3 ELSE (CASE WHEN event_type IS DISTINCT FROM pt THEN 1 ELSE 0 END) + (CASE WHEN value IS DISTINCT FROM pv THEN 2 ELSE 0 END) END AS BIGINT) AS mask, value - pv AS value_delta, CAST(0 AS BIGINT) AS late FROM l"
)
def stream_delta_events(spark, sf_dir):
    table(spark, sf_dir, "events")
    folder = shared_folder(spark)
    return delta.run_once(spark, f"{sf_dir}/events.parquet", f"{folder}/out", f"{folder}/state")


@query("WITH " + _CURRENT + " SELECT 'both' AS side, count(*) AS keys FROM b JOIN c USING (o_orderkey) UNION ALL SELECT 'gone', count(*) FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM c) UNION ALL SELECT 'new', count(*) FROM c WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)")
def diff_key_sets(spark, sf_dir):
    return D.key_sets(*_orders(spark, sf_dir), ["o_orderkey"])


@query(
    "WITH h AS (SELECT count(*) AS k FROM orders WHERE o_orderkey % 4 = 0) SELECT 'o_custkey' AS field, 0 AS changed, CAST(NULL AS INTEGER) AS exponent UNION ALL SELECT 'price', (SELECT count(*) FROM orders WHERE o_orderkey % 4 = 0), "
    "(SELECT CASE WHEN max(k) > 0 THEN CASE WHEN bool_and(t = floor(t)) THEN 0 WHEN bool_and(floor(t * 10 + 0.5) / 10 = t AND t * 10 <= 1056959) THEN 1 WHEN bool_and(floor(t * 100 + 0.5) / 100 = t AND floor(t * 100 + 0.5) <= 1056959) THEN 2 END END FROM h, (SELECT floor(o_totalprice / 100 * 100 + 0.5) % 100000 / 100 AS t FROM orders WHERE o_orderkey % 4 = 0))"
)
def diff_decimal_factors_orders(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lit(-1.5).alias("price"))
    total = table(spark, sf_dir, "orders").select("o_orderkey", (F.floor(F.col("o_totalprice") / 100 * 100 + 0.5) % 100000 / 100).alias("t"))
    current = base.join(total, "o_orderkey").withColumn("price", F.when(F.col("o_orderkey") % 4 == 0, F.col("t")).otherwise(F.col("price"))).drop("t")
    return D.decimal_factors(D.diff(base, current, ["o_orderkey"]), [(0, "o_custkey"), (1, "price")])


@query("SELECT vec_id, list_transform(range(8), lambda j: list_sum(list_transform(range(8), lambda k: CASE WHEN embedding[j * 8 + k + 1] > 0 THEN CAST(pow(2, k) AS BIGINT) ELSE 0 END)))::VARCHAR AS packed, true AS same FROM embeddings")
def shape_flags_embeddings(spark, sf_dir):
    """Signs of the components as flags, eight a byte, and back."""
    flags = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x > 0).alias("flags"))
    packed = flags.withColumn("packed", shape.pack_flags(F.col("flags")))
    same = shape.unpack_flags(F.col("packed"), F.size("flags")) == F.col("flags")
    return packed.withColumn("same", same).select("vec_id", "same", F.concat(F.lit("["), F.array_join(F.col("packed").cast("array<string>"), ", "), F.lit("]")).alias("packed"))


@query("SELECT o_orderpriority AS value, row_number() OVER (ORDER BY o_orderpriority) AS \"index\" FROM orders GROUP BY 1")
def shape_enum_index_orders(spark, sf_dir):
    return shape.enum_index(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 0.01 < 528480 AND l_discount / 0.01 < 528480 AS worthwhile, l_quantity = floor(l_quantity) AND l_tax = floor(l_tax) AS integral, l_tax = 0 OR CAST(floor(l_tax * 255 + 0.5) / 255 AS FLOAT) = CAST(l_tax AS FLOAT) AS color FROM lineitem")
def scalar_vectors_lineitem(spark, sf_dir):
    """Vectors of a row's numbers: whether quantizing pays, whether all are whole, whether they are exact bytes."""
    x = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.vector_worthwhile([x("l_extendedprice"), x("l_discount")], 0.01).alias("worthwhile"),
        C.integral_components([x("l_quantity"), x("l_tax")]).alias("integral"), C.color_bytes([x("l_tax"), x("l_tax")]).isNotNull().alias("color"),
    )


# --- Plans, reports, packets, trees -------------------------------------------------------------------------------


@query()
def schema_plan_save_load(spark, sf_dir):
    plan = planner.derive(table(spark, sf_dir, "events"), ["event_id"])
    path = f"{shared_folder(spark)}/plan"
    plan.save(spark, path)
    loaded = planner.Plan.load(spark, path)
    return planner.plan_table(spark, loaded).withColumn("same_fingerprint", F.lit(loaded.fingerprint() == plan.fingerprint()))


@query(
    f"""WITH h AS (SELECT max(o_orderkey) // 2 AS half FROM orders), s AS (SELECT min(o_orderkey) AS kl, {_bits('max(o_orderkey) - min(o_orderkey)')} AS kb, min(o_custkey) AS cl, {_bits('max(o_custkey) - min(o_custkey)')} AS cb FROM orders, h WHERE o_orderkey <= half),
    t AS (SELECT min(o_orderkey) AS k0, max(o_orderkey) AS k1, min(o_custkey) AS c0, max(o_custkey) AS c1 FROM orders, h WHERE o_orderkey > half)
    SELECT 'o_orderkey' AS "column", k0 AS low, k1 AS high, NOT (k0 >= kl AND k1 < kl + (1 << kb)) AS miss FROM s, t UNION ALL SELECT 'o_custkey', c0, c1, NOT (c0 >= cl AND c1 < cl + (1 << cb)) FROM s, t"""
)
def schema_validate_misses(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    half = orders.agg(F.expr("max(o_orderkey) div 2").alias("h")).first()["h"] or 0
    frames = {r["column"]: (r["base"], r["bits"]) for r in forms.frame_stats(orders.where(F.col("o_orderkey") <= half), ["o_orderkey", "o_custkey"]).collect()}
    return planner.validate(orders.where(F.col("o_orderkey") > half), frames)


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS kind, count({c}) AS present, count(*) - count({c}) AS missing FROM events" for c, t in (("event_id", "integer"), ("ts", "time"), ("user_id", "integer"), ("event_type", "string"), ("value", "double"), ("props", "string"))))
def inspect_types_events(spark, sf_dir):
    from colform.operators.profile import kind_of

    events = table(spark, sf_dir, "events")
    lines = [F.struct(F.lit(f.name).alias("column"), F.lit(kind_of(f.dataType)).alias("kind"), F.col(f"p{i}").alias("present"), (F.col("n") - F.col(f"p{i}")).alias("missing")) for i, f in enumerate(events.schema.fields)]
    return events.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"`{f.name}`").alias(f"p{i}") for i, f in enumerate(events.schema.fields)]).select(F.inline(F.array(*lines)))


@query("SELECT event_id, user_id, event_type, value FROM events")
def wire_roundtrip_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return wire.unpack_rows(wire.pack_rows(events, events.columns), events.schema)


_GEOGRAPHY = "n AS (SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent FROM region UNION ALL SELECT n_nationkey + 101, n_regionkey + 1 FROM nation UNION ALL SELECT s_suppkey + 1001, s_nationkey + 101 FROM supplier)"


@query(f"SELECT {', '.join(LINE_KEY)}, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem")
def roundtrip_plan_lineitem(spark, sf_dir):
    """Derives a plan, encodes the whole table by it and decodes it."""
    return _by_plan(table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"), LINE_KEY)


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def roundtrip_plan_events(spark, sf_dir):
    return _by_plan(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props"), ["event_id"])


@query("SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def roundtrip_plan_documents_labels(spark, sf_dir):
    """With optional columns, whose present values have a plan of their own."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _by_plan(docs.join(labels, "doc_id", "left").select("doc_id", "lang", "source", "n_chars", "quality", "toxic"), ["doc_id"])


def _by_plan(df: DataFrame, keys: list[str]) -> DataFrame:
    return codec.decode(codec.encode(df, planner.derive(df, keys), keys))


@query(
    "SELECT 'l_discount' AS \"column\", 'decimal' AS planned, sum(CASE WHEN floor(l_discount * 10 * 100 + 0.5) > 15 THEN 1 ELSE 0 END) > 0.1 * count(*) AS miss FROM lineitem "
    "UNION ALL SELECT 'l_orderkey', 'differenced', min(l_orderkey) < 0 OR max(l_orderkey) > 7 FROM lineitem UNION ALL SELECT 'l_returnflag', 'dictionary', count(DISTINCT l_returnflag) > 4095 FROM lineitem"
)
def schema_replay_misses(spark, sf_dir):
    """A recorded plan on a later table: order keys that have grown out of their width and discounts ten times as large fall back to plain."""
    later = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_discount") * 10).alias("l_discount"), "l_returnflag", *[c for c in LINE_KEY if c != "l_orderkey"])
    recorded = {"l_orderkey": planner.ColumnPlan("differenced", 0, {"order": 0, "low": 0, "bits": 3}), "l_discount": planner.ColumnPlan("decimal", 0, {"exponent": 2, "factor": 0, "low": 0, "bits": 4}), "l_returnflag": planner.ColumnPlan("dictionary", 0, {"entries": 3})}
    done = codec.encode(later, planner.Plan(recorded), LINE_KEY)
    return spark.createDataFrame([(c, p.form, c in done.misses) for c, p in sorted(recorded.items())], "column string, planned string, miss boolean")


def _geography(spark, sf_dir) -> DataFrame:
    node = lambda t, i, p: table(spark, sf_dir, t).select(F.expr(i).cast("long").alias("id"), F.expr(p).cast("long").alias("parent"))
    return node("region", "r_regionkey + 1", "null").unionByName(node("nation", "n_nationkey + 101", "n_regionkey + 1")).unionByName(node("supplier", "s_suppkey + 1001", "s_nationkey + 101"))


@query(f"WITH RECURSIVE {_GEOGRAPHY}, t AS (SELECT id, parent, 0 AS depth, lpad(CAST(id AS VARCHAR), 12, '0') AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.id, n.parent, t.depth + 1, t.path || '/' || lpad(CAST(n.id AS VARCHAR), 12, '0') FROM n JOIN t ON n.parent = t.id), o AS (SELECT *, row_number() OVER (ORDER BY path) AS number FROM t) SELECT o.id, CAST(o.depth AS INTEGER) AS depth, o.number, coalesce(p.number, 0) AS parent_number FROM o LEFT JOIN o AS p ON o.parent = p.id")
def tree_flatten_geography(spark, sf_dir):
    return tree.number_tree(tree.flatten_tree(_geography(spark, sf_dir)))


@query(f"WITH {_GEOGRAPHY} SELECT id, coalesce(parent, 0) AS parent FROM n")
def tree_rebuild_geography(spark, sf_dir):
    nodes, _ = tree.rebuild(tree.number_tree(tree.flatten_tree(_geography(spark, sf_dir))))
    return nodes.fillna({"parent": 0})


@query(f"WITH {_GEOGRAPHY} SELECT c_custkey AS from_id, CAST(c_custkey % 200 + 1 AS BIGINT) AS to_id, c_custkey % 200 + 1 IN (SELECT id FROM n) AS internal FROM customer")
def tree_references_geography(spark, sf_dir):
    edges = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("from_id"), (F.col("c_custkey") % 200 + 1).cast("long").alias("to_id"))
    return tree.split_references(_geography(spark, sf_dir), edges).select("from_id", "to_id", "internal")


@query("SELECT p_partkey AS id, p_type AS class, 'p_size' AS name, CAST(p_size AS VARCHAR) AS value FROM part WHERE p_size <> 1 UNION ALL SELECT p_partkey, p_type, 'p_brand', p_brand FROM part")
def tree_capture_part(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("class"), F.inline(F.array(F.struct(F.lit("p_size").alias("name"), F.col("p_size").cast("string").alias("value")), F.struct(F.lit("p_brand").alias("name"), F.col("p_brand").alias("value")))))
    defaults = part.select(F.col("p_type").alias("class")).distinct().select("class", F.lit("p_size").alias("name"), F.lit("1").alias("value"))
    return tree.capture(rows, defaults).select("id", "class", "name", "value")

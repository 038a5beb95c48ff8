import random

import pytest
from pyspark.sql import functions as F

from colform.functions import costs as C
from colform.operators import diff as D
from colform.operators import forms, relate, sequential, shape, tree, wire
from colform.plans import planner
from colform.sources.ordering import running_sum, with_lags, with_order


def ordered(spark, values, kind="long", chunk=4096):
    return with_order(spark.createDataFrame(list(enumerate(values)), f"k long, x {kind}").repartition(5), ["k"], chunk)


def test_order_lags_and_sums_cross_chunks(spark):
    rng = random.Random(1)
    values = [rng.randint(-50, 50) for _ in range(57)]
    rows = ordered(spark, values, chunk=8)
    lagged = running_sum(with_lags(rows, ["x"], 2, 8), F.col("x"), "s").orderBy("_rn").collect()
    assert [r._rn for r in lagged] == list(range(57))
    assert [r.x_lag1 for r in lagged] == [None, *values[:-1]]
    assert [r.x_lag2 for r in lagged] == [None, None, *values[:-2]]
    assert [r.s for r in lagged] == [sum(values[: i + 1]) for i in range(57)]


@pytest.mark.parametrize("order", [0, 1, 2])
@pytest.mark.parametrize("n", [1, 3, 4, 64])
def test_differences_round_trip(spark, order, n):
    rng = random.Random(order * 100 + n)
    values = [rng.randint(-(2**40), 2**40) for _ in range(n)]
    encoded = forms.encode_differences(ordered(spark, values), "x", order).select("_rn", "_chunk", "delta")
    back = forms.decode_differences(encoded, order, "x").orderBy("_rn").collect()
    assert [r.x for r in back] == values


def test_difference_costs_pick_the_straight_line(spark):
    rows = {r.order: r for r in forms.difference_stats(ordered(spark, range(1000)), "x").collect()}
    assert (rows[0].bits, rows[1].bits, rows[2].bits) == (10, 2, 1)
    assert [k for k, r in rows.items() if r.chosen] == [2]
    assert rows[2].total_bytes == 2 + 1 + 1 + C.py_packed_bytes(998, 1)


def test_span_boundary(spark):
    for span, bits in ((255, 8), (256, 9)):
        assert forms.frame_stats(spark.createDataFrame([(0,), (span,)], "x long"), ["x"]).first().bits == bits


def test_frequency(spark):
    values = [7] * 97 + [1, -5, 7, 7, 900]
    r = forms.frequency_stats(ordered(spark, values), "x").first()
    assert (r.top, r.exceptions, r.accepted, r.by_gaps) == (7, 3, True, True)
    top, odd = forms.encode_frequency(ordered(spark, values), "x")
    back = forms.decode_frequency(ordered(spark, values).select("_rn"), top, odd, "x").orderBy("_rn").collect()
    assert [b.x for b in back] == values


def test_runs_and_booleans(spark):
    values = [1, 1, 2, 2, 2, None, None, 3]
    assert [(r.value, r.length) for r in forms.runs(ordered(spark, values), "x").orderBy("run").collect()] == [(1, 2), (2, 3), (None, 2), (3, 1)]
    flags = [i % 3 == 0 for i in range(19)]
    packed = forms.pack_booleans(ordered(spark, flags, "boolean"), F.col("x"))
    assert [r.flag for r in forms.unpack_booleans(packed, 19).orderBy("_rn").collect()] == flags


def test_decimals(spark):
    df = spark.createDataFrame([(i / 100,) for i in range(100)] + [(0.123456,)], "x double")
    r = forms.decimal_stats(df, ["x"]).first()
    assert (r.exponent, r.factor, r.exceptions) == (2, 0, 1)
    back = forms.decode_decimal(forms.encode_decimal(df.withColumn("k", F.col("x")), "x", 2, 0, 0), 2, 0, 0, "x")
    assert back.where("x <> k").count() == 0
    assert forms.decimal_stats(spark.createDataFrame([(1.0,), (2.0,)], "x double"), ["x"]).count() == 0


def test_dates_refuse_what_does_not_exist(spark):
    df = spark.createDataFrame([("2024-02-29",), ("2024-02-30",), ("2024-1-4",), ("1969-12-31",), (None,)], "t string")
    day, valid = forms.date_days(F.col("t"))
    assert [tuple(r) for r in df.select(day, valid).collect()][:4] == [(19782, True), (None, False), (None, False), (-1, True)]


def test_prefixes(spark):
    df = spark.createDataFrame([(f"item_{i * 977}.x",) for i in range(40)], "s string")
    r = forms.prefix_stats(df, "s").first()
    assert (r.prefix, r.suffix, r.width, r.dense, r.accepted) == ("item_", ".x", 0, False, True)
    r = forms.prefix_stats(spark.createDataFrame([(f"T-{i:06d}",) for i in range(40)], "s string"), "s").first()
    assert (r.prefix, r.width, r.dense, r.accepted) == ("T-", 6, True, False)


def test_cycles(spark):
    values = [i % 7 for i in range(70)]
    values[33] = 99
    assert forms.cycle_candidates(ordered(spark, values), ["x"], 70) == {"x": [7, 14]}
    r = forms.cycle_stats(ordered(spark, values), "x").first()
    assert (r.period, r.misfits) == (7, 1)
    assert forms.cycle_stats(ordered(spark, [5] * 70), "x").count() == 0
    assert forms.cycle_stats(ordered(spark, list(range(31))), "x").count() == 0


def test_relations(spark):
    df = spark.createDataFrame([(i, i % 5, f"t{i % 5}" if i != 13 else "odd") for i in range(100)], "k long, s long, t string")
    r = relate.mapping_stats(df, "s", "t", True).first()
    assert (r.exceptions, r.qualifies, r.passes_gate) == (1, True, True)
    mapping, odd = relate.encode_mapping(df, "s", "t")
    back = relate.decode_mapping(df.drop("t"), "s", mapping, odd, ["k"], "t")
    assert back.select("k", "s", "t").exceptAll(df).count() == 0
    line = spark.createDataFrame([(i, 7 * i + 3) for i in range(100)], "a long, b long")
    r = relate.linear_stats(line, F.col("a"), F.col("b")).first()
    assert (r.slope, r.intercept, r.bits) == (7, 3, 1)


def test_assignment_has_no_cycles():
    c = lambda s, t, v: {"source": s, "target": t, "form": "x", "saving": v}
    got = relate.assign([c("a", "b", 9), c("b", "a", 8), c("b", "c", 7), c("c", "a", 6), c("a", "c", 5), c("a", "d", 0)])
    assert [(x["source"], x["target"]) for x in got] == [("a", "b"), ("b", "c")]


def test_shapes(spark):
    df = spark.createDataFrame([(1, {"a.b": 2}), (2, {"a.b": 3})], "k long, s struct<`a.b`:long>")
    flat, paths = shape.flatten(df)
    assert paths == [("k",), ("s", "a.b")]
    assert shape.unflatten(flat, paths).collect() == df.collect()
    arrays = spark.createDataFrame([(1, [3, 1, 2]), (2, [])], "k long, a array<long>")
    items, lengths = shape.explode_batch(arrays, ["k"], "a")
    assert sorted(map(tuple, shape.implode_batch(items, lengths, ["k"], "a").collect())) == [(1, [3, 1, 2]), (2, [])]
    wide = spark.createDataFrame([(1, list(range(12)))], "k long, a array<long>")
    assert shape.tuple_restore(shape.tuple_columns(wide, "a", 12), 12, "a").first().a == list(range(12))


def test_diff_properties(spark):
    rng = random.Random(4)
    schema = "k long, a long, b string, c double"
    base = [(i, rng.randint(0, 5), rng.choice(["x", None, "y"]), rng.choice([0.0, -0.0, float("nan"), 1.5, None])) for i in range(200)]
    current = [(k, a + (k % 3 == 0), b if k % 4 else "z", c if k % 5 else -0.0) for k, a, b, c in base if k % 7] + [(1000 + i, 1, "n", 2.0) for i in range(9)]
    b, c = spark.createDataFrame(base, schema), spark.createDataFrame(current, schema)
    changes = D.diff(b, c, ["k"])
    got = D.patch(b, changes, ["k"], D.fingerprint(b, ["k"]))
    assert sorted(map(repr, got.select("k", "a", "b", "c").collect())) == sorted(map(repr, c.collect()))
    assert D.diff(b, b, ["k"]).count() == 0
    with pytest.raises(D.BaselineMismatch):
        D.patch(c, changes, ["k"], D.fingerprint(b, ["k"]))


def test_assignment_weighs_all_forms(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        nation, group, x = rng.randint(0, 24), rng.randint(0, 4), rng.randint(0, 10**6)
        rows.append((f"n{nation:02d}", f"r{nation % 5}", group, 100_000 * group * group + rng.randint(0, 15), x, 3 * x + rng.randint(0, 3), x if i % 50 else 7))
    df = spark.createDataFrame(rows, "nation string, region string, grp long, slot long, x long, line long, same long")
    got = {r.target: (r.source, r.form) for r in relate.correlation_assignment(df, ["nation", "region"]).collect()}
    assert got == {"nation": ("region", "multi-mapped")}
    got = {r.target: (r.source, r.form) for r in relate.correlation_assignment(df, ["grp", "slot"]).collect()}
    assert got["slot"] == ("grp", "group-framed")
    assert {r.form for r in relate.correlation_assignment(df, ["x", "line"]).collect()} == {"linear"}
    assert {(r.form, r.exceptions) for r in relate.correlation_assignment(df, ["x", "same"]).collect()} == {("equal", 8)}


def test_plans(spark, tmp_path):
    df = spark.createDataFrame([(i, i * 3, "ab"[i % 2], i / 4, None if i % 3 else i) for i in range(200)], "k long, x long, s string, d double, o long")
    plan = planner.derive(df, ["k"])
    assert {n: p.form for n, p in plan.columns.items()} == {"k": "differenced", "x": "differenced", "s": "dictionary", "d": "decimal", "o": "optional"}
    plan.save(spark, f"{tmp_path}/plan")
    again = planner.Plan.load(spark, f"{tmp_path}/plan")
    assert again.fingerprint() == plan.fingerprint()
    with pytest.raises(ValueError):
        planner.Plan.from_json(plan.to_json().replace('"rows": 200', '"rows": 201'))
    assert plan.merged(again).fingerprint() == plan.fingerprint()
    assert [r.miss for r in planner.validate(df, {"x": (0, 4), "k": (0, 8)}).orderBy("column").collect()] == [False, True]


def test_plans_try_the_whole_selection_order(spark):
    rng = random.Random(3)
    rows = [(i, int(rng.random() < 0.08) * rng.randint(1, 9**6), rng.randint(0, 1) if i % 3 else None, f"Customer#{i * i * 7:09d}", [3, 900, 17, 44, 5][i % 5], float(rng.randint(1, 50)), rng.randint(1, 10**6) / 1000 if i % 50 else 1 / 3, "aab"[i * 3 // 400] * 9, -0.0 if i == 7 else 2.0, "2024-02-30") for i in range(400)]
    plan = planner.derive(spark.createDataFrame(rows, "k long, often long, opt long, name string, turn long, whole double, near double, run string, minus double, day string"), ["k"])
    forms_ = {n: p.form for n, p in plan.columns.items()}
    assert forms_ == {"k": "differenced", "often": "frequency", "opt": "optional", "name": "prefixed", "turn": "cyclic", "whole": "differenced", "near": "decimal", "run": "runs", "minus": "runs", "day": "runs"}
    assert plan.columns["near"].parameters["exceptions"] == 8 and plan.columns["near"].parameters["exponent"] == 3
    assert plan.columns["whole"].parameters == {"order": 0, "bits": 6, "low": plan.columns["whole"].parameters["low"], "double": True}


def test_decimals_beyond_four_places(spark):
    df = spark.createDataFrame([(i * 7 / 10**7, i / 100) for i in range(1, 200)], "x double, y double")
    met = {r["column"]: (r["exponent"], r["exceptions"]) for r in forms.decimal_stats(df, ["x", "y"]).collect()}
    assert met == {"x": (7, 0), "y": (2, 0)}


def test_packets():
    values = [None, True, False, 0, 31, 32, -1, -129, 2**31, 2**40, -(2**40), 0.5, 0.1, float("inf"), "é", "é", b"\0\1", [1, [2, {"a": None}]], {"k": "é", "n": [1.5] * 9}]
    assert wire.deserialize(wire.serialize(values)) == values
    assert str(wire.deserialize(wire.serialize(-0.0))) == "-0.0"
    assert wire.deserialize(wire.serialize(float("nan"))) != wire.deserialize(wire.serialize(float("nan")))
    packet = wire.serialize(values)
    for cut in range(len(packet)):
        with pytest.raises(wire.PacketError):
            wire.deserialize(packet[:cut])
    for bad in (b"\2\0\0", b"\1\0\x50\xff\xff\xff\xff\xff\xff\x01\0\0", b"\1\0\x7f", b"\1\0\0\0"):
        with pytest.raises(wire.PacketError):
            wire.deserialize(bad)
    deep = []
    for _ in range(600):
        deep = [deep]
    with pytest.raises(ValueError):
        wire.serialize(deep)
    for x in (0, 191, 192, 8383, 8384, 1056959, 1056960, 2**32 - 1, 2**32, 2**53 - 1):
        w = wire.Writer()
        w.varint(x)
        assert len(w.out) == C.py_varint_width(x)
        assert wire.Reader(w.out).varint() == x


def test_trees_and_kernels(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (9, None)], "id long, parent long")
    numbered = tree.number_tree(tree.flatten_tree(nodes))
    assert [(r.id, r.number, r.parent_number) for r in numbered.orderBy("number").collect()] == [(1, 1, 0), (2, 2, 1), (4, 3, 2), (3, 4, 1), (9, 5, 0)]
    back, problems = tree.rebuild(numbered)
    assert back.exceptAll(nodes).count() == 0 and problems.count() == 0
    folds = sequential.move_to_front(ordered(spark, list("abacbb"), "string"), "x").orderBy("_rn").collect()
    assert [r.fold for r in folds] == [None, None, 1, None, 2, 0]
    long_ = [random.Random(7).choice("abcdefghijklm") if i % 40 else "z" for i in range(90)] + ["c"] * 30 + ["z", None, "a", None]
    recent, want = [], []
    for v in long_:
        want.append(recent.index(v) if v in recent else None)
        recent = [v, *[x for x in recent if x != v]][: sequential.FRONT]
    folds = sequential.move_to_front(ordered(spark, long_, "string", chunk=8), "x").orderBy("_rn").collect()
    assert [r.fold for r in folds] == want
    assert sequential.greedy_runs([1, 1, 1, 1, 3, 3]) == [(0, 4, 1), (4, 2, 3)]


def test_deep_trees_and_their_problems(spark):
    big = 10**13
    chain = [(big + i, big + i - 1 if i else None) for i in range(40)]
    odd = [(1, 2), (2, 1), (3, 1), (5, 4), (6, 5)]
    nodes = spark.createDataFrame(chain + odd, "id long, parent long").repartition(3)
    flat = tree.flatten_tree(nodes).orderBy("path").collect()
    assert [(r.id, r.depth) for r in flat] == [(big + i, i) for i in range(40)] and flat[-1].path == [i for i, _ in chain]
    cyclic, missing = "in or below a cycle", "an ancestor is missing"
    assert {r.id: r.problem for r in tree.tree_problems(nodes).collect()} == {1: cyclic, 2: cyclic, 3: cyclic, 5: missing, 6: missing}
    assert tree.flatten_tree(nodes.limit(0)).count() == 0


def test_packets_keep_rows_exact(spark):
    schema = "k long, x double, s string"
    rows = [(2**60 + 1, float("nan"), None), (2**53 + 1, None, ""), (None, -0.0, "a"), (-(2**63), 1e300, "a"), (5, 3.0, "\0")]
    df = spark.createDataFrame(rows, schema)
    back = wire.unpack_rows(wire.pack_rows(df, df.columns), df.schema)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert wire.from_text(wire.to_text({"a": [1, 2**62]})) == {"a": [1, 2**62]}
    with pytest.raises(wire.PacketError):
        wire.from_text("no base64!")
    with pytest.raises(ValueError):
        wire.serialize(2**64)


def test_fingerprints_of_many_and_of_missing(spark):
    many = spark.range(40_000_000).select(F.col("id").alias("k"))
    assert D.fingerprint(many, ["k"]) == D.fingerprint(many.repartition(3), ["k"])
    one = lambda rows: D.fingerprint(spark.createDataFrame(rows, "k long, s string, t string"), ["k"])
    assert len({one([(1, None, "\0")]), one([(1, "\0", None)]), one([(1, None, None)]), one([(1, "", None)]), one([(1, None, None)] * 2), one([])}) == 6
    with pytest.raises(ValueError):
        wide = spark.range(1).select("id", *[F.lit(1).alias(f"c{i}") for i in range(64)])
        D.diff(wide, wide, ["id"])


def test_missing_values_come_back(spark):
    values = [7] * 20 + [None, 3, None]
    top, odd = forms.encode_frequency(ordered(spark, values), "x")
    assert [r.x for r in forms.decode_frequency(ordered(spark, values).select("_rn"), top, odd, "x").orderBy("_rn").collect()] == values
    assert forms.frequency_stats(ordered(spark, values), "x").first().exceptions == 3
    texts = ["a", None, "b", "a"]
    rows = ordered(spark, texts, "string")
    entries = forms.first_appearance(rows, "x")
    back = forms.decode_dictionary(forms.encode_dictionary(rows, "x", entries), entries, "x")
    assert [r.x for r in back.orderBy("_rn").collect()] == texts
    df = spark.createDataFrame([(1, None, "u"), (2, None, "u"), (3, "s", None), (4, "s", "v"), (5, "s", "v"), (6, None, "w")], "k long, s string, t string")
    mapping, odd = relate.encode_mapping(df, "s", "t")
    assert relate.decode_mapping(df.drop("t"), "s", mapping, odd, ["k"], "t").select("k", "s", "t").exceptAll(df).count() == 0
    numbers = spark.createDataFrame([(1, None, 5), (2, None, 9), (3, "s", None), (4, "s", 2)], "k long, s string, t long")
    references, encoded = relate.encode_group_frame(numbers, "s", "t")
    assert sorted(map(str, relate.decode_group_frame(encoded, references, "s", "t").select("k", "s", "t").collect())) == sorted(map(str, numbers.collect()))


def test_large_dictionaries_have_whole_figures(spark):
    r = forms.dictionary_stats(ordered(spark, [f"{i:06d}" for i in range(10_000)], "string"), ["x"]).first()
    assert (r.entries, r.rows, r.accepted, r.plain_bytes) == (10_000, 10_000, False, 80_000)


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([(2**33 + i, 2**32 - i, i) for i in range(8)], "a long, b long, c long")
    assert {(r.a, r.b): r.r_e4 for r in relate.pair_stats(df, ["a", "b", "c"]).collect()}[("a", "b")] is not None
    assert relate.linear_stats(spark.createDataFrame([(2**62, -(2**62)), (0, 2**62), (1, 5)], "a long, b long"), F.col("a"), F.col("b")).count() in (0, 1)


def test_long_runs_unfold_in_pieces(spark):
    found = spark.createDataFrame([(0, 9_000, 4), (9_000, 1, 5), (9_001, 4_096, None)], "start long, length long, value long")
    back = forms.decode_runs(found, "x").orderBy("_rn").collect()
    assert [r._rn for r in back] == list(range(13_097)) and [r.x for r in back] == [4] * 9_000 + [5] + [None] * 4_096


def test_plans_widen_like_forms_only():
    plan = lambda **p: planner.Plan({"x": planner.ColumnPlan("differenced", 5, p)}, 9)
    wide = plan(order=1, bits=3, low=5).merged(plan(order=1, bits=7, low=-2)).columns["x"].parameters
    assert wide == {"order": 1, "bits": 7, "low": -2}
    assert plan(order=1, bits=3, low=5).merged(plan(order=2, bits=7, low=-2)).columns["x"].parameters == {"order": 1, "bits": 3, "low": 5}


def test_empty_tables(spark):
    empty = ordered(spark, [])
    assert forms.runs(empty, "x").count() == 0
    assert forms.difference_stats(empty, "x").count() == 3
    assert forms.cycle_stats(empty, "x").count() == 0
    none = spark.createDataFrame([], "k long, a long")
    assert D.patch(none, D.diff(none, none, ["k"]), ["k"]).count() == 0

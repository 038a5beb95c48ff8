import random

import pytest
from pyspark.sql import functions as F

from colform.operators import diff as D
from colform.operators import wire
from colform.options import EncodeOptions
from colform.plans import codec, planner
from colform.streaming import delta


def plans(**forms_):
    return planner.Plan({c: planner.ColumnPlan(f, 0, p) for c, (f, p) in forms_.items()}, 0)


def test_every_form_round_trips(spark):
    rng = random.Random(3)
    rows = [(i, int(rng.random() < 0.08) * rng.randint(1, 9**6), rng.randint(0, 1) if i % 3 else None, f"Customer#{i * i * 7:09d}", [3, 900, 17, 44, 5][i % 5], float(rng.randint(1, 50)), rng.randint(1, 10**6) / 1000 if i % 50 else 1 / 3, "aab"[i * 3 // 400] * 9, -0.0 if i == 7 else 2.0, f"2024-02-{i % 28 + 1:02d}", i % 7 == 0, "xyz"[i % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, often long, opt long, name string, turn long, whole double, near double, run string, minus double, day string, flag boolean, few string").withColumn("at", F.expr("timestampadd(SECOND, k * 60, timestamp_ntz'2024-01-01 00:00:00')"))
    plan = planner.derive(df, ["k"])
    done = codec.encode(df, plan, ["k"])
    assert done.misses == [] and {p.form for p in done.plan.values()} >= {"differenced", "frequency", "optional", "prefixed", "cyclic", "decimal", "runs", "date"}
    back = codec.decode(done)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_misses_fall_back(spark):
    df = spark.createDataFrame([(i, i * 1000, f"v{i}", 0.1 * i, None if i % 2 else "2024-02-30", float("nan"), i) for i in range(40)], "k long, a long, s string, d double, t string, n double, c long")
    plan = plans(a=("differenced", {"order": 0, "low": 0, "bits": 4}), s=("runs", {"runs": 3}), d=("decimal", {"exponent": 0, "factor": 0, "low": 0, "bits": 9}), t=("date", {}), n=("differenced", {"order": 1, "low": 0, "bits": 4, "double": True}), c=("cyclic", {"period": 5}))
    done = codec.encode(df, plan, ["k"])
    assert done.misses == ["a", "s", "d", "t", "n", "c"]
    assert sorted(map(repr, codec.decode(done).collect())) == sorted(map(repr, df.collect()))


def test_options_are_heeded(spark):
    df = spark.range(40).select("id", (F.col("id") % 2).alias("x"))
    plan = plans(id=("differenced", {"order": 1, "low": 0, "bits": 2}), x=("cyclic", {"period": 2}))
    used = lambda **o: {c: p.form for c, p in codec.encode(df, plan, ["id"], EncodeOptions(**o)).plan.items()}
    assert used() == {"id": "differenced", "x": "cyclic"}
    assert used(bit_pack=False) == {"id": "plain", "x": "cyclic"} and used(columnar=False) == {"id": "plain", "x": "plain"}
    changed = df.withColumn("x", F.col("x") + 10)
    assert not D.is_patch(D.guarded_diff(df, changed, ["id"])) and D.is_patch(D.guarded_diff(df, changed, ["id"], EncodeOptions(guard_diff=False)))
    assert D.tables_differ(df, changed, ["id"]) and not D.tables_differ(df, df.repartition(3), ["id"])
    with pytest.raises(Exception, match="nested too deeply"):
        wire.pack_rows(df, ["id"], options=EncodeOptions(max_depth=0)).collect()


@pytest.mark.parametrize("n", [0, 1, 3])
def test_tiny_tables(spark, n):
    df = spark.range(n).select("id", (F.col("id") * 2).alias("x"))
    plan = plans(id=("differenced", {"order": 2, "low": 0, "bits": 2}), x=("frequency", {"top": 0}))
    assert sorted(codec.decode(codec.encode(df, plan, ["id"])).collect()) == sorted(df.collect())


def test_streams_count_late_rows_and_take_missing_values(spark, tmp_path):
    import pandas as pd

    class Held:
        exists, get = False, None

        def update(self, x):
            self.exists, self.get = True, x

    held = Held()
    frame = lambda rows: pd.DataFrame(rows, columns=["user_id", "event_id", "event_type", "value"])
    one = pd.concat(delta._delta((1,), iter([frame([(1, 2, "a", 1.0), (1, 1, "a", float("nan")), (1, 2, "b", 9.0)])]), held))
    assert one[["event_id", "mask", "late"]].values.tolist() == [[1, 3, 0], [2, 2, 0]] and held.get == (2, "a", 1.0, 1)
    two = pd.concat(delta._delta((1,), iter([frame([(1, 2, "z", 5.0), (1, 4, "a", 1.0), (1, 5, None, 1.5)])]), held))
    assert two[["event_id", "mask", "late"]].values.tolist() == [[4, 0, 2], [5, 3, 2]] and held.get == (5, None, 1.5, 2)

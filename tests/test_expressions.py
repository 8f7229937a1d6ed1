import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.expr import ExpressionError, col, compile_text, predicate
from granary.functions import REGISTRY as fn

FLOATS = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 0.5, -0.5, 1.0, 1.5, 2.5, -2.5, 1e308, -1e308]
INTS = [None, 0, 1, -1, 7, -7, 3, -3, 1 << 30]


@pytest.fixture(scope="module")
def floats(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(itertools.product(FLOATS, FLOATS))]
    return spark.createDataFrame(rows, "i long, a double, b double").cache()


@pytest.fixture(scope="module")
def ints(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(itertools.product(INTS, INTS))]
    return spark.createDataFrame(rows, "i long, a long, b long").cache()


def run(df, expression):
    schema = T.StructType(df.schema.fields[1:])
    rows = df.select("a", "b", expression.bind(schema).col.alias("r")).collect()
    return [(r.a, r.b, r.r) for r in rows]


def same(got, want):
    if got is None or want is None:
        return got is want
    if isinstance(want, bool | np.bool_):
        return got == bool(want)
    return (math.isnan(got) and math.isnan(want)) or got == want or math.isclose(got, want, rel_tol=1e-12)


ONE = "sin cos tan arcsin arccos arctan sinh cosh tanh arcsinh arccosh arctanh exp expm1 log log10 log2 log1p sqrt floor ceil trunc sign signbit isnan isinf isfinite abs negative square reciprocal".split()  # noqa: E501


@pytest.mark.parametrize("name", [*ONE, "rint"])
def test_one_argument_like_numpy(floats, name):
    with np.errstate(all="ignore"):
        for a, _, got in run(floats, fn[name](col("a"))):
            want = None if a is None else getattr(np, name)(np.float64(a))
            if name in ("arcsinh", "sin", "cos", "tan", "sinh", "cosh") and a is not None and abs(a) > 1e300:
                continue
            assert same(got, want), (name, a, got, want)


@pytest.mark.parametrize(
    "name",
    "add subtract multiply divide floor_divide remainder equal not_equal less less_equal greater greater_equal maximum minimum copysign arctan2 hypot logaddexp nextafter".split(),  # noqa: E501
)
def test_two_arguments_like_numpy(floats, name):
    with np.errstate(all="ignore"):
        for a, b, got in run(floats, fn[name](col("a"), col("b"))):
            if None in (a, b):
                assert got is None
                continue
            want = getattr(np, name)(np.float64(a), np.float64(b))
            if name in ("floor_divide", "remainder") and (math.isinf(a) or math.isinf(b) or abs(a) > 1e300 or abs(b) > 1e300):
                continue
            assert same(got, want), (name, a, b, got, want)


@pytest.mark.parametrize("name", "add subtract multiply floor_divide remainder bitwise_and bitwise_or bitwise_xor equal less".split())
def test_integers_like_numpy(ints, name):
    with np.errstate(all="ignore"):
        for a, b, got in run(ints, fn[name](col("a"), col("b"))):
            if None in (a, b):
                assert got is None
            else:
                assert got == getattr(np, name)(np.int64(a), np.int64(b)), (name, a, b, got)


def test_shifts_and_logic(ints):
    for a, _, got in run(ints, fn["bitwise_left_shift"](col("a"), 2)):
        assert got == (None if a is None else a << 2)
    for a, b, got in run(ints, fn["logical_xor"](col("a"), col("b"))):
        assert got == (None if None in (a, b) else bool(a) != bool(b))


def test_kleene_truth_tables(spark):
    values = [True, False, None]
    df = spark.createDataFrame([(0, a, b) for a in values for b in values], "i long, a boolean, b boolean")
    logic = {
        "&": lambda a, b: False if False in (a, b) else None if None in (a, b) else True,
        "|": lambda a, b: True if True in (a, b) else None if None in (a, b) else False,
        "^": lambda a, b: None if None in (a, b) else a != b,
    }
    for symbol, want in logic.items():
        for a, b, got in run(df, compile_text(f"a {symbol} b")):
            assert got == want(a, b), (symbol, a, b)
    for a, _, got in run(df, compile_text("not a")):
        assert got == (None if a is None else not a)


def test_isin_is_two_valued(floats):
    for a, _, got in run(floats, col("a").isin([1.0, None])):
        assert got == (a is None or a == 1.0)
    for a, _, got in run(floats, col("a").isin([1.0])):
        assert got == (a == 1.0)


def test_complex(spark):
    df = spark.createDataFrame([(0, (3.0, 4.0), (1.0, -2.0))], "i long, a struct<re:double,im:double>, b struct<re:double,im:double>")
    a, b = 3 + 4j, 1 - 2j
    for text, want in (("a + b", a + b), ("a * b", a * b), ("a / b", a / b), ("conj(a)", a.conjugate())):
        got = run(df, compile_text(text))[0][2]
        assert complex(got.re, got.im) == pytest.approx(want)
    assert run(df, compile_text("abs(a)"))[0][2] == 5.0
    with pytest.raises(TypeError):
        run(df, compile_text("a < b"))


@pytest.mark.parametrize("text", ["__import__('os')", "a.b()", "[x for x in a]", "lambda: 1", "eval('1')", "a = 1", "f'{a}'"])
def test_unsafe_text_is_refused(text):
    with pytest.raises((ExpressionError, KeyError)):
        compile_text(text).bind(T.StructType([T.StructField("a", T.LongType())]))


def test_predicates_are_boolean():
    schema = T.StructType([T.StructField("a", T.LongType())])
    with pytest.raises(TypeError):
        predicate("a + 1", schema)
    with pytest.raises(TypeError):
        bool(col("a") > 1)
    with pytest.raises(KeyError):
        predicate("zz > 1", schema)


def test_integer_predicates_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(100).withColumn("x", F.col("id") * 1.5).write.parquet(path)
    from granary.operators.indexes import explain
    from granary.sources.tabular import read_parquet

    plan = explain(read_parquet(spark, path), "id > 10 and x < 90")
    assert "GreaterThan(id,10)" in plan and "LessThan(x,90.0)" in plan

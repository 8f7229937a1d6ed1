"""Queries for elementwise functions, kernels and expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.expr import Expr, col, compile_text
from granary.operators.table import Table
from granary.plans import dsl_kernel, jit, kernel_from_source, lazyudf
from granary.registry import query, table


def _rounded(t: Table, key: str, digits: int, *exact: str, **expressions: str | Expr) -> DataFrame:
    """key, the exact columns, and the expressions rounded."""
    made = t.assign(**expressions).frame
    return made.select(key, *exact, *[F.round(name, digits).alias(name) for name in expressions if name not in exact])


@query("""SELECT event_id, round(sin(value), 9) AS f_sin, round(cos(value), 9) AS f_cos, round(tan(value / 400), 9) AS f_tan,
          round(asin(value / 500), 9) AS f_arcsin, round(acos(value / 500), 9) AS f_arccos, round(atan(value), 9) AS f_arctan,
          round(atan2(value, 7), 9) AS f_arctan2 FROM events""")
def fn_trigonometric(spark, sf_dir):
    return _rounded(
        table(spark, sf_dir, "events"), "event_id", 9, f_sin="sin(value)", f_cos="cos(value)", f_tan="tan(value / 400)", f_arcsin="arcsin(value / 500)",
        f_arccos="arccos(value / 500)", f_arctan="arctan(value)", f_arctan2="arctan2(value, 7)",
    )


@query("""SELECT event_id, round(sinh(value / 100), 8) AS f_sinh, round(cosh(value / 100), 8) AS f_cosh, round(tanh(value / 100), 9) AS f_tanh,
          round(asinh(value), 9) AS f_arcsinh, round(acosh(value + 1), 9) AS f_arccosh, round(atanh(value / 500), 9) AS f_arctanh FROM events""")
def fn_hyperbolic(spark, sf_dir):
    t = table(spark, sf_dir, "events")
    made = t.assign(
        f_sinh="sinh(value / 100)", f_cosh="cosh(value / 100)", f_tanh="tanh(value / 100)", f_arcsinh="arcsinh(value)",
        f_arccosh="arccosh(value + 1)", f_arctanh="arctanh(value / 500)",
    ).frame
    return made.select("event_id", *[F.round(c, 8 if c in ("f_sinh", "f_cosh") else 9).alias(c) for c in made.columns if c.startswith("f_")])


@query("""SELECT event_id, round(exp(value / 100), 8) AS f_exp, round(exp(value / 100) - 1, 8) AS f_expm1, round(ln(value), 9) AS f_log,
          round(log10(value), 9) AS f_log10, round(log2(value), 9) AS f_log2, round(ln(1 + value), 9) AS f_log1p FROM events""")
def fn_exponential(spark, sf_dir):
    t = table(spark, sf_dir, "events")
    made = t.assign(f_exp="exp(value / 100)", f_expm1="expm1(value / 100)", f_log="log(value)", f_log10="log10(value)", f_log2="log2(value)", f_log1p="log1p(value)").frame
    return made.select("event_id", *[F.round(c, 8 if c in ("f_exp", "f_expm1") else 9).alias(c) for c in made.columns if c.startswith("f_")])


@query("""SELECT event_id, value * value AS f_square, 1 / value AS f_reciprocal, round(pow(value, 1.5), 6) AS f_pow, round(sqrt(value), 9) AS f_sqrt,
          abs(value - 100) AS f_abs, +value AS f_positive, -value AS f_negative, round(sqrt(value * value + 9), 8) AS f_hypot FROM events""")
def fn_powers(spark, sf_dir):
    made = table(spark, sf_dir, "events").assign(
        f_square="square(value)", f_reciprocal="reciprocal(value)", f_pow="pow(value, 1.5)", f_sqrt="sqrt(value)", f_abs="abs(value - 100)",
        f_positive="positive(value)", f_negative="negative(value)", f_hypot="hypot(value, 3.0)",
    ).frame
    digits = {"f_pow": 6, "f_sqrt": 9, "f_hypot": 8}
    return made.select("event_id", *[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in made.columns if c.startswith("f_")])


@query("""SELECT event_id, CAST(sign(value - 100) AS DOUBLE) AS f_sign, value < 100 AS f_signbit, CASE WHEN value < 100 THEN -3.0 ELSE 3.0 END AS f_copysign,
          value > 400 AS f_isnan, value < 200 AS f_isfinite, value BETWEEN 200 AND 400 AS f_isinf,
          nextafter(value, CAST(1000 AS DOUBLE)) AS f_nextafter, round(ln(exp(value / 100) + exp(1)), 9) AS f_logaddexp FROM events""")
def fn_floats(spark, sf_dir):
    t = table(spark, sf_dir, "events").assign(odd="where(value > 400, nan, where(value < 200, value, inf))")
    made = t.assign(
        f_sign="sign(value - 100)", f_signbit="signbit(value - 100)", f_copysign="copysign(3.0, value - 100)", f_isnan="isnan(odd)",
        f_isfinite="isfinite(odd)", f_isinf="isinf(odd)", f_nextafter="nextafter(value, 1000.0)", f_logaddexp="logaddexp(value / 100, 1.0)",
    ).frame
    return made.select(
        "event_id", F.col("f_sign").cast("double").alias("f_sign"), "f_signbit", "f_copysign", "f_isnan", "f_isfinite", "f_isinf", "f_nextafter", F.round("f_logaddexp", 9).alias("f_logaddexp")
    )


@query("""SELECT o_orderkey, ~o_custkey AS f_invert, o_custkey & 6 AS f_and, o_custkey | 6 AS f_or, xor(o_custkey, 6) AS f_xor,
          o_custkey << 3 AS f_left, o_custkey >> 2 AS f_right, (o_custkey > 50) AND (o_totalprice > 100000) AS f_both,
          (o_custkey > 50) OR (o_totalprice > 100000) AS f_either, (o_custkey > 50) <> (o_totalprice > 100000) AS f_one, NOT (o_custkey > 50) AS f_not FROM orders""")
def fn_bits_and_logic(spark, sf_dir):
    made = table(spark, sf_dir, "orders").assign(
        f_invert="bitwise_invert(o_custkey)", f_and="bitwise_and(o_custkey, 6)", f_or="bitwise_or(o_custkey, 6)", f_xor="bitwise_xor(o_custkey, 6)",
        f_left="bitwise_left_shift(o_custkey, 3)", f_right="bitwise_right_shift(o_custkey, 2)", f_both="logical_and(o_custkey > 50, o_totalprice > 100000)",
        f_either="logical_or(o_custkey > 50, o_totalprice > 100000)", f_one="logical_xor(o_custkey > 50, o_totalprice > 100000)", f_not="logical_not(o_custkey > 50)",
    )
    return made.select(["o_orderkey", *[c for c in made.columns if c.startswith("f_")]]).frame


@query("""SELECT o_orderkey, o_custkey + 3 AS f_add, o_custkey - 3 AS f_subtract, o_custkey * 3 AS f_multiply, o_custkey / 4 AS f_divide,
          CAST(floor(o_custkey / 4) AS BIGINT) AS f_floor_divide, o_custkey % 4 AS f_remainder, o_custkey = 4 AS f_equal, o_custkey <> 4 AS f_not_equal,
          o_custkey < 40 AS f_less, o_custkey <= 40 AS f_less_equal, o_custkey > 40 AS f_greater, o_custkey >= 40 AS f_greater_equal,
          greatest(o_custkey, 40) AS f_maximum, least(o_custkey, 40) AS f_minimum FROM orders""")
def fn_arithmetic(spark, sf_dir):
    names = "add subtract multiply divide floor_divide remainder equal not_equal less less_equal greater greater_equal maximum minimum".split()
    other = {"add": 3, "subtract": 3, "multiply": 3, "divide": 4, "floor_divide": 4, "remainder": 4, "equal": 4, "not_equal": 4}
    made = table(spark, sf_dir, "orders").assign(**{f"f_{n}": f"{n}(o_custkey, {other.get(n, 40)})" for n in names})
    return made.select(["o_orderkey", *[f"f_{n}" for n in names]]).frame


@query("""SELECT event_id, value AS f_real, -CAST(user_id AS DOUBLE) AS f_imag, round(value * value + user_id * user_id, 4) AS f_norm,
          round(sqrt(value * value + user_id * user_id), 8) AS f_abs FROM events""")
def fn_complex(spark, sf_dir):
    """Complex columns: conjugate, product and absolute value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    z = F.struct(F.col("value").alias("re"), F.col("user_id").cast("double").alias("im"))
    t = Table.from_frame(e.select("event_id", z.alias("z")))
    made = t.assign(f_real="real(conj(z))", f_imag="imag(conj(z))", f_norm="real(z * conj(z))", f_abs="abs(z)").frame
    return made.select("event_id", "f_real", "f_imag", F.round("f_norm", 4).alias("f_norm"), F.round("f_abs", 8).alias("f_abs"))


@query("""SELECT event_id, CAST(trunc(value) AS BIGINT) AS f_long, CAST(value AS FLOAT) = CAST(value AS DOUBLE) AS f_narrow, value <> 0 AS f_bool,
          CAST(event_id AS VARCHAR) AS f_text, CAST(value BETWEEN 10 AND 20 AS INT) AS f_int FROM events""")
def fn_astype(spark, sf_dir):
    made = table(spark, sf_dir, "events").assign(
        f_long="astype(trunc(value), 'long')", f_single="astype(value, 'float')", f_bool="astype(value, 'boolean')", f_text="astype(event_id, 'string')",
        f_int="astype((value >= 10) & (value <= 20), 'int')",
    ).frame
    return made.select("event_id", "f_long", (F.col("f_single").cast("double") == F.col("value")).alias("f_narrow"), "f_bool", "f_text", "f_int")


@query("""SELECT event_id, CASE WHEN value > 300 THEN 'neither' WHEN value > 100 THEN 'minus infinity' ELSE 'number' END AS kind FROM events""")
def fn_logs_of_no_numbers(spark, sf_dir):
    """log(0) is minus infinity and log(-1) is not a number."""
    t = table(spark, sf_dir, "events").assign(x="log(where(value > 300, -1.0, where(value > 100, 0.0, 1.0)))")
    return t.assign(kind="where(isnan(x), 'neither', where(isinf(x), 'minus infinity', 'number'))").select(["event_id", "kind"]).frame


@query("SELECT event_id, greatest(value, 100) + CASE WHEN value > 100 THEN ln(value) ELSE 0 END AS y FROM events")
def fn_jit(spark, sf_dir):
    """A function of NumPy calls, traced into one expression."""
    made = jit(lambda x: np.maximum(x, 100.0) + np.where(x > 100, np.log(x), 0.0))
    return table(spark, sf_dir, "events").assign(y=made(col("value"))).select(["event_id", "y"]).frame


@query("SELECT event_id, sqrt(value) + user_id AS y FROM events")
def fn_block_function(spark, sf_dir):
    """A function of NumPy blocks over Arrow batches."""
    return table(spark, sf_dir, "events").assign(y=lazyudf(lambda v, u: np.sqrt(v) + u, col("value"), col("user_id"))).select(["event_id", "y"]).frame


@query("""SELECT event_id, CAST(CASE WHEN value < 1 THEN 0 ELSE floor(log2(value)) + CASE WHEN value >= pow(2, floor(log2(value))) THEN 0 ELSE -1 END END AS DOUBLE) AS steps FROM events""")
def fn_stepwise_kernel(spark, sf_dir):
    """A loop that ends by its data, on masked NumPy blocks."""
    halve = kernel_from_source(
        """
        def halve(x):
            n = 0
            while True:
                x = x / 2
                if x < 1:
                    break
                n += 1
            if n < 0:
                return 0
            return n
        """
    )
    return table(spark, sf_dir, "events").assign(steps=halve(col("value"))).select(["event_id", "steps"]).frame


@query("SELECT event_id, CASE WHEN value > 200 THEN value - 200 ELSE value * 3 END AS y FROM events")
def fn_kernel_decorator(spark, sf_dir):
    @dsl_kernel
    def bent(v):
        total = 0.0
        for i in range(3):
            total += v
        if v > 200:
            total = v - 200
        return total

    return table(spark, sf_dir, "events").assign(y=bent(col("value"))).select(["event_id", "y"]).frame


@query("SELECT event_id, (value + user_id) * 2 AS y, (value + user_id) * 2 > 500 AS z FROM events")
def fn_saved_expression(spark, sf_dir):
    """An expression kept as text and read back, used inside another one."""
    saved = compile_text(((col("value") + col("user_id")) * 2).text)
    return table(spark, sf_dir, "events").assign(y=saved, z=saved > 500).select(["event_id", "y", "z"]).frame


@query("""SELECT event_id, round(a + b, 9) AS y FROM (SELECT event_id, sin(value) AS a, CASE WHEN user_id > 7 THEN value ELSE -value END AS b FROM events)""")
def fn_evaluate(spark, sf_dir):
    made = table(spark, sf_dir, "events").assign(y="sin(value) + where(user_id > 7, value, -value)").frame
    return made.select("event_id", F.round("y", 9).alias("y"))

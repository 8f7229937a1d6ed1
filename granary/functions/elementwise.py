"""Elementwise functions with NumPy semantics on Spark columns.

Each takes and gives ``Expr``; plain values are literals. Nulls give null.
Everything but ``nextafter`` stays inside the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.expr import (
    INF,
    NAN,
    Bound,
    Expr,
    arithmetic,
    as_double,
    compare,
    complex_col,
    im_of,
    invert,
    lift,
    lit,
    logical,
    negate,
    numeric,
    re_of,
    to_expr,
    whole,
)

REGISTRY: dict[str, Callable[..., Expr]] = {}


def _register(name: str, function: Callable[..., Bound], *aliases: str) -> None:
    def call(*operands: Any) -> Expr:
        text = ", ".join(o.text if isinstance(o, Expr) else repr(o) for o in operands)
        return lift(function, f"{name}({text})", *operands)

    call.__name__ = name
    for key in (name, *aliases):
        REGISTRY[key] = call


def _real(function: Callable[[Column], Column]) -> Callable[[Bound], Bound]:
    """A function of doubles that Spark has with the same results."""

    def apply(a: Bound) -> Bound:
        numeric(a, function.__name__)
        return Bound(function(as_double(a)), "float")

    return apply


for _name, _function, *_aliases in (
    ("sin", F.sin),
    ("cos", F.cos),
    ("tan", F.tan),
    ("arcsin", F.asin, "asin"),
    ("arccos", F.acos, "acos"),
    ("arctan", F.atan, "atan"),
    ("sinh", F.sinh),
    ("cosh", F.cosh),
    ("tanh", F.tanh),
    ("arcsinh", F.asinh, "asinh"),
    ("arccosh", F.acosh, "acosh"),
    ("arctanh", F.atanh, "atanh"),
    ("exp", F.exp),
    ("expm1", F.expm1),
    ("sqrt", F.sqrt),
):
    _register(_name, _real(_function), *_aliases)


def _logarithm(function: Callable[[Column], Column], edge: float) -> Callable[[Bound], Bound]:
    """-inf at the edge of the domain and NaN below, where Spark gives null."""

    def apply(a: Bound) -> Bound:
        numeric(a, "log")
        x = as_double(a)
        return Bound(
            F.when(x == edge, F.lit(-INF)).when(F.isnan(x) | (x < edge), F.lit(NAN)).otherwise(function(x)), "float"
        )

    return apply


_register("log", _logarithm(F.ln, 0.0))
_register("log10", _logarithm(F.log10, 0.0))
_register("log2", _logarithm(F.log2, 0.0))
_register("log1p", _logarithm(F.log1p, -1.0))


def _pair(function: Callable[[Column, Column], Column]) -> Callable[[Bound, Bound], Bound]:
    def apply(a: Bound, b: Bound) -> Bound:
        x, y = as_double(a), as_double(b)
        return Bound(F.when(x.isNotNull() & y.isNotNull(), function(x, y)), "float")

    return apply


def _minus_zero(x: Column) -> Column:
    return x.cast("string") == "-0.0"


def _arctan2(y: Column, x: Column) -> Column:
    """Spark takes -0.0 for 0.0, which puts points left of the axis on the wrong side."""
    left = (x < 0) | _minus_zero(x)
    side = F.when(_minus_zero(y), F.lit(-math.pi)).otherwise(F.lit(math.pi))
    return F.when((y == 0) & left, side).otherwise(F.atan2(y, x))


_register("arctan2", _pair(_arctan2), "atan2")
_register("hypot", _pair(F.hypot))


def _logaddexp(x: Column, y: Column) -> Column:
    far = F.abs(x - y)
    same_infinity = (x == y) & (F.abs(x) == INF)
    return F.when(F.isnan(x) | F.isnan(y), F.lit(NAN)).when(same_infinity, x).otherwise(F.greatest(x, y) + F.log1p(F.exp(-far)))


_register("logaddexp", _pair(_logaddexp))

for _name, _symbol, *_aliases in (
    ("add", "+"),
    ("subtract", "-"),
    ("multiply", "*"),
    ("divide", "/"),
    ("floor_divide", "//"),
    ("remainder", "%"),
    ("pow", "**", "power"),
):
    _register(_name, lambda a, b, s=_symbol: arithmetic(s, a, b), *_aliases)
for _name, _symbol in (
    ("equal", "=="),
    ("not_equal", "!="),
    ("less", "<"),
    ("less_equal", "<="),
    ("greater", ">"),
    ("greater_equal", ">="),
):
    _register(_name, lambda a, b, s=_symbol: compare(s, a, b))
for _name, _symbol in (("bitwise_and", "&"), ("bitwise_or", "|"), ("bitwise_xor", "^")):
    _register(_name, lambda a, b, s=_symbol: logical(s, a, b))


def _truth(a: Bound) -> Bound:
    return a if a.kind == "bool" else Bound(a.col != 0, "bool", True)


for _name, _symbol in (("logical_and", "&"), ("logical_or", "|"), ("logical_xor", "^")):
    _register(_name, lambda a, b, s=_symbol: logical(s, _truth(a), _truth(b)))
_register("logical_not", lambda a: invert(_truth(a)))
_register("bitwise_invert", invert, "bitwise_not")
_register("negative", negate)
_register("positive", lambda a: a)
_register("square", lambda a: arithmetic("*", a, a))
_register("reciprocal", lambda a: arithmetic("/", Bound.of(1.0), a))


def _shift(sql: str) -> Callable[[Bound, Bound], Bound]:
    def apply(a: Bound, b: Bound) -> Bound:
        if a.kind != "int" or b.kind != "int":
            raise TypeError("shifts need integers")
        return Bound(F.call_function(sql, a.col.cast("long"), b.col.cast("int")), "int", True)

    return apply


_register("bitwise_left_shift", _shift("shiftleft"))
_register("bitwise_right_shift", _shift("shiftright"))


def _abs(a: Bound) -> Bound:
    if a.kind == "complex":
        return Bound(F.hypot(re_of(a), im_of(a)), "float")
    numeric(a, "abs")
    return Bound(F.abs(a.col.cast("int") if a.kind == "bool" else a.col), "int" if a.kind == "bool" else a.kind, a.sure)


_register("abs", _abs, "absolute")


def _extreme(function: Callable[..., Column]) -> Callable[[Bound, Bound], Bound]:
    """NaN wins, and null as well; Spark would skip nulls."""

    def apply(a: Bound, b: Bound) -> Bound:
        known = a.col.isNotNull() & b.col.isNotNull()
        picked = F.when(known, function(a.col, b.col))
        nans = [n for n in (a.is_nan(), b.is_nan()) if n is not None]
        if nans:
            picked = F.when(known & (nans[0] if len(nans) == 1 else nans[0] | nans[1]), F.lit(NAN)).otherwise(picked)
        kind = a.kind if a.kind == b.kind else "float"
        return Bound(picked, kind)

    return apply


_register("maximum", _extreme(F.greatest))
_register("minimum", _extreme(F.least))


def clip(x: Any, min: Any = None, max: Any = None) -> Expr:
    out = to_expr(x)
    if min is not None:
        out = REGISTRY["maximum"](out, min)
    return out if max is None else REGISTRY["minimum"](out, max)


REGISTRY["clip"] = clip


def _signbit(a: Bound) -> Column:
    x = as_double(a)
    return (x < 0) | (x.cast("string") == "-0.0")


_register("signbit", lambda a: Bound(_signbit(a), "bool", True))
_register(
    "copysign",
    lambda a, b: Bound(
        F.when(_signbit(b), -F.abs(as_double(a))).when(b.col.isNotNull(), F.abs(as_double(a))), "float"
    ),
)


def _rounding(function: Callable[[Column], Column]) -> Callable[[Bound], Bound]:
    return lambda a: a if a.kind in ("int", "bool") else Bound(function(as_double(a)), "float", a.sure)


_register("floor", _rounding(lambda x: whole(F.floor, x)))
_register("ceil", _rounding(lambda x: whole(F.ceil, x)))
_register("trunc", _rounding(lambda x: F.when(x < 0, whole(F.ceil, x)).otherwise(whole(F.floor, x))))
_register("round", _rounding(F.rint), "rint")
_register("sign", lambda a: Bound(F.signum(as_double(a)).cast("long" if a.kind == "int" else "double"), a.kind, a.sure))


def _float_test(test: Callable[[Column], Column], otherwise: bool) -> Callable[[Bound], Bound]:
    def apply(a: Bound) -> Bound:
        if a.kind == "complex":
            found = test(re_of(a)) & test(im_of(a)) if otherwise else test(re_of(a)) | test(im_of(a))
            return Bound(found, "bool", True)
        if a.kind != "float":
            return Bound(F.when(a.col.isNotNull(), F.lit(otherwise)), "bool", True)
        return Bound(test(a.col), "bool", True)

    return apply


def _when_known(x: Column, test: Column) -> Column:
    return F.when(x.isNotNull(), test)


_register("isnan", _float_test(lambda x: _when_known(x, F.isnan(x)), False))
_register("isinf", _float_test(lambda x: F.abs(x) == INF, False))
_register("isfinite", _float_test(lambda x: _when_known(x, ~F.isnan(x) & (F.abs(x) != INF)), True))
_register("real", lambda a: Bound(re_of(a), "float") if a.kind == "complex" else a)
_register("imag", lambda a: Bound(im_of(a), "float") if a.kind == "complex" else Bound(F.when(a.col.isNotNull(), F.lit(0.0)), "float"))
_register("conj", lambda a: Bound(complex_col(re_of(a), -im_of(a)), "complex") if a.kind == "complex" else a)


def astype(x: Any, dtype: str) -> Expr:
    return to_expr(x).astype(dtype)


REGISTRY["astype"] = astype


def where(condition: Any, x: Any = None, y: Any = None) -> Expr:
    """x where the condition holds, else y, also where it is null. One argument is the condition alone."""
    test = to_expr(condition)
    if x is None and y is None:
        return test

    def choose(c: Bound, a: Bound, b: Bound) -> Bound:
        if c.kind != "bool":
            raise TypeError("where needs a boolean condition")
        kind = a.kind if a.kind == b.kind else "float" if {a.kind, b.kind} <= {"int", "float", "bool"} else a.kind
        one, two = (as_double(a), as_double(b)) if kind == "float" else (a.col, b.col)
        return Bound(F.when(c.col, one).otherwise(two), kind, a.sure and b.sure)

    return lift(choose, f"where({test.text})", test, x, y)


REGISTRY["where"] = where


@F.pandas_udf(T.DoubleType())
def _next(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.nextafter(a.to_numpy(dtype=float), b.to_numpy(dtype=float)))


# pandas has no null beside NaN, so nulls are set and NaN is restored around the call.
_register("nextafter", _pair(lambda x, y: F.coalesce(_next(x, y), F.lit(NAN))))


def _strings(function: Callable[..., Column], kind: str) -> Callable[..., Bound]:
    def apply(*operands: Bound) -> Bound:
        for o in operands:
            if o.kind != "str":
                raise TypeError("string functions need strings")
        return Bound(function(*[o.col for o in operands]), kind, True)

    return apply


_register("contains", _strings(F.contains, "bool"))
_register("startswith", _strings(F.startswith, "bool"))
_register("endswith", _strings(F.endswith, "bool"))
_register("lower", _strings(F.lower, "str"))
_register("upper", _strings(F.upper, "str"))
_register("is_null", lambda a: Bound(a.col.isNull(), "bool", True), "isnull")
_register("notnull", lambda a: Bound(a.col.isNotNull(), "bool", True))
REGISTRY["fillna"] = lambda x, value: to_expr(x).fillna(value)
REGISTRY["isin"] = lambda x, values: to_expr(x).isin(values)
REGISTRY["lit"] = lit

__all__ = ["REGISTRY"]

"""Type promotion and facts about types, by the names that specifications use."""

from __future__ import annotations

from typing import Any

import numpy as np

e, pi = float(np.e), float(np.pi)
newaxis = None
DEFAULT_FLOAT, DEFAULT_INT, DEFAULT_INDEX, DEFAULT_COMPLEX = (np.dtype(x) for x in ("float64", "int64", "int64", "complex128"))


def _dtype(x: Any) -> Any:
    """Scalars stay scalars, so that they promote weakly; arrays count by their Spark type."""
    if isinstance(x, bool | int | float | complex):
        return x
    spark = getattr(x, "dtype", x)
    names = {"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8", "double": "float64", "float": "float32", "boolean": "bool"}
    if hasattr(spark, "simpleString"):
        spark = names.get(spark.simpleString(), spark.simpleString())
    return np.dtype(spark)


def result_type(*operands: Any) -> np.dtype:
    """The type that operands promote to."""
    return np.result_type(*map(_dtype, operands))


def can_cast(source: Any, to: Any, casting: str = "safe") -> bool:
    return np.can_cast(_dtype(source), _dtype(to), casting)


def isdtype(dtype: Any, kind: str | tuple) -> bool:
    """Whether a type is of a kind: 'bool', 'integral', 'real floating', 'numeric', or another type."""
    kinds = kind if isinstance(kind, tuple) else (kind,)
    groups = {
        "bool": "b", "signed integer": "i", "unsigned integer": "u", "integral": "iu",
        "real floating": "f", "complex floating": "c", "numeric": "iufc",
    }
    found = _dtype(dtype)
    return any(found.kind in groups[k] if k in groups else found == np.dtype(k) for k in kinds)


def finfo(dtype: Any) -> np.finfo:
    return np.finfo(_dtype(dtype))


def iinfo(dtype: Any) -> np.iinfo:
    return np.iinfo(_dtype(dtype))


def reduction_dtype(dtype: Any, op: str) -> np.dtype:
    """The type of a reduction's result."""
    kind = _dtype(dtype).kind
    if op in ("any", "all"):
        return np.dtype(bool)
    if op in ("argmin", "argmax", "count_nonzero"):
        return DEFAULT_INDEX
    if op in ("mean", "std", "var"):
        return DEFAULT_COMPLEX if kind == "c" and op == "mean" else DEFAULT_FLOAT
    if op in ("sum", "prod"):
        return {"b": DEFAULT_INT, "i": DEFAULT_INT, "u": np.dtype("uint64"), "f": DEFAULT_FLOAT, "c": DEFAULT_COMPLEX}[kind]
    return _dtype(dtype)

"""Column specifications: types, constraints and null storage, kept as StructField metadata."""

from __future__ import annotations

import contextlib
import contextvars
import dataclasses
import json
import math
import re
import typing
from dataclasses import dataclass
from dataclasses import field as dataclass_field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.expr import quoted

_SPARK = {
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "bool": T.BooleanType(),
    "complex64": T.StructType([T.StructField("re", T.FloatType()), T.StructField("im", T.FloatType())]),
    "complex128": T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]),
    "string": T.StringType(), "utf8": T.StringType(), "vlstring": T.StringType(), "dictionary": T.StringType(),
    "bytes": T.BinaryType(), "vlbytes": T.BinaryType(), "object": T.BinaryType(),
}
_UNSIGNED = {"uint8": 8, "uint16": 16, "uint32": 32, "uint64": 64}


class ConstraintError(ValueError):
    """A value that its column's specification does not allow."""


@dataclass(frozen=True)
class NullPolicy:
    """How nulls of new columns are stored on export: 'mask' (validity) or 'sentinel' (a reserved value)."""

    storage: str = "mask"
    float_sentinel: float = math.nan
    int_sentinel: int = -1
    string_sentinel: str = ""


DEFAULT_NULL_POLICY = NullPolicy()
_policy = contextvars.ContextVar("granary_null_policy", default=DEFAULT_NULL_POLICY)


def get_null_policy() -> NullPolicy:
    return _policy.get()


@contextlib.contextmanager
def null_policy(policy: NullPolicy):
    token = _policy.set(policy)
    try:
        yield policy
    finally:
        _policy.reset(token)


@dataclass(frozen=True)
class Spec:
    """One column's type, bounds, null storage and default."""

    kind: str
    ge: Any = None
    gt: Any = None
    le: Any = None
    lt: Any = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    nullable: bool = False
    null_storage: str | None = None
    null_value: Any = None
    item: Spec | None = None
    shape: tuple[int, ...] | None = None
    fields: tuple[tuple[str, Spec], ...] = ()
    unit: str | None = None
    timezone: str | None = None
    ordered: bool = False

    def spark_type(self) -> T.DataType:
        if self.kind in ("list", "ndarray"):
            return T.ArrayType(self.item.spark_type(), True)
        if self.kind == "struct":
            return T.StructType([s.field(n) for n, s in self.fields])
        if self.kind == "timestamp":
            if self.unit == "ns":
                return T.LongType()
            return T.TimestampType() if self.timezone else T.TimestampNTZType()
        return _SPARK[self.kind]

    def to_dict(self) -> dict:
        out = {k: v for k, v in dataclasses.asdict(self).items() if v is not None and v is not False and v != ()}
        if self.item:
            out["item"] = self.item.to_dict()
        if self.fields:
            out["fields"] = [[n, s.to_dict()] for n, s in self.fields]
        if isinstance(self.null_value, float) and math.isnan(self.null_value):
            out["null_value"] = "nan"
        return out

    @staticmethod
    def from_dict(data: dict) -> Spec:
        data = dict(data)
        if "item" in data:
            data["item"] = Spec.from_dict(data["item"])
        if "fields" in data:
            data["fields"] = tuple((n, Spec.from_dict(s)) for n, s in data["fields"])
        if "shape" in data:
            data["shape"] = tuple(data["shape"])
        if data.get("null_value") == "nan":
            data["null_value"] = math.nan
        return Spec(**data)

    def field(self, name: str) -> T.StructField:
        metadata = {"spec": json.dumps(self.to_dict())}
        if self.shape:
            metadata["shape"] = list(self.shape)
        return T.StructField(name, self.spark_type(), True, metadata)

    def constraint(self, value: Column) -> Column | None:
        """True where a value is allowed; nulls always are."""
        tests = []
        for limit, test in (
            (self.ge, lambda v: value >= v), (self.gt, lambda v: value > v),
            (self.le, lambda v: value <= v), (self.lt, lambda v: value < v),
        ):
            if limit is not None:
                tests.append(test(F.lit(limit)))
        if self.kind in _UNSIGNED:
            tests.append((value >= 0) & (value < F.lit(2 ** _UNSIGNED[self.kind]).cast("decimal(20,0)")))
        if self.min_length is not None:
            tests.append(F.length(value) >= self.min_length)
        if self.max_length is not None:
            tests.append(F.length(value) <= self.max_length)
        if self.pattern is not None:
            tests.append(value.rlike(f"^(?:{self.pattern})$"))
        if self.shape:
            tests.append(F.size(value) == math.prod(self.shape))
        if not tests:
            return None
        allowed = tests[0]
        for test in tests[1:]:
            allowed = allowed & test
        return value.isNull() | allowed

    def sentinel(self) -> Any:
        """The value that stands for null when nulls are stored as a sentinel."""
        if self.null_value is not None:
            return self.null_value
        policy = get_null_policy()
        if self.kind.startswith("float"):
            return policy.float_sentinel
        if self.kind.startswith(("int", "uint")):
            return policy.int_sentinel
        return policy.string_sentinel

    def from_stored(self, value: Column) -> Column:
        """Nulls in place of sentinels."""
        if self.null_storage != "sentinel":
            return value
        reserved = self.sentinel()
        if isinstance(reserved, float) and math.isnan(reserved):
            return F.nanvl(value, F.lit(None).cast(self.spark_type()))
        return F.when(value != F.lit(reserved), value)

    def to_stored(self, value: Column) -> Column:
        return F.coalesce(value, F.lit(self.sentinel())) if self.null_storage == "sentinel" else value


def _maker(kind: str):
    def make(**options: Any) -> Spec:
        if options.get("nullable") and "null_storage" not in options:
            options["null_storage"] = "sentinel" if "null_value" in options else get_null_policy().storage
        return Spec(kind, **options)

    make.__name__ = kind
    return make


int8, int16, int32, int64 = map(_maker, ("int8", "int16", "int32", "int64"))
uint8, uint16, uint32, uint64 = map(_maker, ("uint8", "uint16", "uint32", "uint64"))
float32, float64, complex64, complex128 = map(_maker, ("float32", "float64", "complex64", "complex128"))
bool_, utf8, vlstring, vlbytes, object_ = map(_maker, ("bool", "utf8", "vlstring", "vlbytes", "object"))
dictionary, timestamp = map(_maker, ("dictionary", "timestamp"))


def string(max_length: int = 32, **options: Any) -> Spec:
    return _maker("string")(max_length=max_length, **options)


def bytes_(max_length: int = 32, **options: Any) -> Spec:
    return _maker("bytes")(max_length=max_length, **options)


def list_(item: Spec, **options: Any) -> Spec:
    if item.kind == "list":
        raise TypeError("a list of lists is not supported")
    return _maker("list")(item=item, **options)


def ndarray(shape: tuple[int, ...], item: Spec, **options: Any) -> Spec:
    """A fixed-shape array per row, kept flat in row-major order with its shape in metadata."""
    return _maker("ndarray")(item=item, shape=tuple(shape), **options)


def struct(**fields: Spec) -> Spec:
    return Spec("struct", fields=tuple(fields.items()))


_ANNOTATIONS = {int: int64, float: float64, bool: bool_, str: utf8, bytes: vlbytes, complex: complex128}


def column(spec: Spec, default: Any = dataclasses.MISSING) -> Any:
    """A dataclass field with a specification."""
    return dataclass_field(default=default, metadata={"spec": spec})


def check_name(name: str) -> None:
    if not isinstance(name, str) or not name or name.startswith("__") or "/" in name:
        raise ValueError(f"not a column name: {name!r}")


@dataclass(frozen=True)
class CompiledSchema:
    specs: dict[str, Spec]
    defaults: dict[str, Any]

    def struct(self) -> T.StructType:
        return T.StructType([s.field(n) for n, s in self.specs.items()])

    def to_json(self) -> str:
        return json.dumps({"columns": {n: s.to_dict() for n, s in self.specs.items()}, "defaults": self.defaults})

    @staticmethod
    def from_json(text: str) -> CompiledSchema:
        data = json.loads(text)
        return CompiledSchema({n: Spec.from_dict(s) for n, s in data["columns"].items()}, data["defaults"])


def compile_schema(row_class: type) -> CompiledSchema:
    """Specifications of a dataclass: ``x: int = column(int32(ge=0))``, or by annotation alone."""
    if not dataclasses.is_dataclass(row_class):
        raise TypeError("a row class is a dataclass")
    hints = typing.get_type_hints(row_class)
    specs, defaults = {}, {}
    for f in dataclasses.fields(row_class):
        check_name(f.name)
        spec = f.metadata.get("spec")
        if spec is None:
            hint, nullable = hints[f.name], False
            options = [a for a in typing.get_args(hint) if a is not type(None)]
            if len(options) == 1 and len(typing.get_args(hint)) == 2:
                hint, nullable = options[0], True
            if hint not in _ANNOTATIONS:
                raise TypeError(f"no column type for {f.name}: {hint}")
            spec = _ANNOTATIONS[hint](nullable=nullable) if nullable else _ANNOTATIONS[hint]()
        specs[f.name] = spec
        if f.default is not dataclasses.MISSING:
            defaults[f.name] = f.default
    return CompiledSchema(specs, defaults)


def spec_of(field: T.StructField) -> Spec:
    """The specification in a field's metadata, or one that fits its type."""
    if "spec" in field.metadata:
        return Spec.from_dict(json.loads(field.metadata["spec"]))
    if isinstance(field.dataType, T.ArrayType):
        return Spec("list", item=spec_of(T.StructField("item", field.dataType.elementType)))
    if isinstance(field.dataType, T.TimestampType | T.TimestampNTZType):
        return Spec("timestamp", unit="us", timezone="UTC" if isinstance(field.dataType, T.TimestampType) else None)
    if isinstance(field.dataType, T.StructType):
        return Spec("struct", fields=tuple((f.name, spec_of(f)) for f in field.dataType.fields))
    kinds = {t: k for k, t in reversed(_SPARK.items()) if not k.startswith(("uint", "string", "dictionary", "vlstring", "object", "bytes"))}
    return Spec(kinds.get(field.dataType, "object"), nullable=True)


def validate(df: DataFrame, schema: T.StructType) -> None:
    """Check all constraints in one aggregation; the error names a column and a value."""
    checks = {}
    for f in schema.fields:
        spec = spec_of(f) if "spec" in f.metadata else None
        value = F.col(quoted(f.name))
        allowed = spec.constraint(value) if spec else None
        if spec and not spec.nullable and spec.null_storage is None and spec.kind not in ("vlstring", "vlbytes", "object", "dictionary", "list", "struct"):
            allowed = value.isNotNull() & allowed if allowed is not None else value.isNotNull()
        if allowed is not None:
            checks[f.name] = F.min(F.when(~allowed, F.struct(value.cast("string").alias("value"))))
    if not checks:
        return
    found = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(checks.values())]).first()
    for i, name in enumerate(checks):
        if found[f"c{i}"] is not None:
            raise ConstraintError(f"column {name!r} does not allow {found[f'c{i}']['value']!r}")


_PATH = re.compile(r"(?<!\\)\.")


def split_path(name: str) -> list[str]:
    """Parts of a dotted leaf name; a dot after a backslash belongs to its part."""
    return [p.replace("\\.", ".") for p in _PATH.split(name)]


def join_path(parts: list[str]) -> str:
    return ".".join(p.replace(".", "\\.") for p in parts)

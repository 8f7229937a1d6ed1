"""Typed column expressions with NumPy semantics, and the compiler of expression strings.

A ``Bound`` pairs a Spark Column with the kind of its values, so that guards
for NaN, division and rounding are added for floats alone and other
predicates stay in the bare form that reaches the Parquet scan. An ``Expr``
is not bound to a table yet; it becomes a Bound against a schema.
"""

from __future__ import annotations

import ast
import datetime
import math
import numbers
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF, NAN = math.inf, math.nan


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, T.FloatType | T.DoubleType):
        return "float"
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    if isinstance(dtype, T.StringType):
        return "str"
    if isinstance(dtype, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "time"
    if isinstance(dtype, T.DayTimeIntervalType):
        return "delta"
    if isinstance(dtype, T.ArrayType):
        return "array"
    if isinstance(dtype, T.StructType) and [f.name for f in dtype.fields] == ["re", "im"]:
        return "complex"
    return "other"


def literal_kind(value: Any) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, numbers.Integral):
        return "int"
    if isinstance(value, numbers.Real):
        return "float"
    if isinstance(value, complex):
        return "complex"
    if isinstance(value, str):
        return "str"
    if isinstance(value, datetime.timedelta):
        return "delta"
    if isinstance(value, datetime.date | datetime.datetime):
        return "time"
    return "other"


def complex_col(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


@dataclass(frozen=True)
class Bound:
    """A Spark Column and the kind of its values; ``sure`` says that no value is NaN."""

    col: Column
    kind: str
    sure: bool = False

    @staticmethod
    def of(value: Any) -> Bound:
        if isinstance(value, Bound):
            return value
        if hasattr(value, "item") and not isinstance(value, list):
            value = value.item()
        kind = literal_kind(value)
        if kind == "complex":
            return Bound(complex_col(F.lit(value.real), F.lit(value.imag)), kind, True)
        return Bound(F.lit(value), kind, not (kind == "float" and math.isnan(value)))

    def is_nan(self) -> Column | None:
        return None if self.kind != "float" or self.sure else F.isnan(self.col)


def _guarded(test: Column, *nans: Column | None) -> Column:
    for nan in nans:
        if nan is not None:
            test = test & ~nan
    return test


def numeric(a: Bound, what: str) -> None:
    if a.kind not in ("bool", "int", "float", "decimal"):
        raise TypeError(f"{what} needs numbers, not {a.kind}")


def _wider(a: Bound, b: Bound) -> str:
    return "float" if "float" in (a.kind, b.kind) else "decimal" if "decimal" in (a.kind, b.kind) else "int"


def _number(a: Bound) -> Column:
    return a.col.cast("int") if a.kind == "bool" else a.col


def as_double(a: Bound) -> Column:
    return _number(a).cast("double")


def compare(op: str, a: Bound, b: Bound) -> Bound:
    """IEEE comparison: NaN is unequal to all and ordered with none; null gives null."""
    if "complex" in (a.kind, b.kind):
        if op not in ("==", "!="):
            raise TypeError("complex values have no order")
        same = (re_of(a) == re_of(b)) & (im_of(a) == im_of(b))
        return Bound(same if op == "==" else ~same, "bool", True)
    x, y = a.col, b.col
    if {a.kind, b.kind} == {"bool", "int"} or {a.kind, b.kind} == {"bool", "float"}:
        x, y = _number(a), _number(b)
    # A guard lets a null on the other side through, so that the comparison stays unknown.
    na, nb = a.is_nan(), b.is_nan()
    both = na is not None and nb is not None
    if op == "!=":
        return Bound((x != y) | (na & y.isNotNull()) if both else x != y, "bool", True)
    na, nb = (na if na is None else na & y.isNotNull()), (nb if nb is None else nb & x.isNotNull())
    if op == "==":
        out = _guarded(x == y, na) if both else x == y
    elif op == "<":
        out = _guarded(x < y, nb)
    elif op == "<=":
        out = _guarded(x <= y, nb)
    elif op == ">":
        out = _guarded(x > y, na)
    else:
        out = _guarded(x >= y, na)
    return Bound(out, "bool", True)


def re_of(a: Bound) -> Column:
    return a.col["re"] if a.kind == "complex" else as_double(a)


def im_of(a: Bound) -> Column:
    return a.col["im"] if a.kind == "complex" else F.lit(0.0)


def _complex_arithmetic(op: str, a: Bound, b: Bound) -> Bound:
    ar, ai, br, bi = re_of(a), im_of(a), re_of(b), im_of(b)
    if op == "+":
        out = complex_col(ar + br, ai + bi)
    elif op == "-":
        out = complex_col(ar - br, ai - bi)
    elif op == "*":
        out = complex_col(ar * br - ai * bi, ar * bi + ai * br)
    elif op == "/":
        size = br * br + bi * bi
        out = complex_col(true_division((ar * br + ai * bi), size), true_division((ai * br - ar * bi), size))
    else:
        raise TypeError(f"{op} is not defined for complex values")
    return Bound(out, "complex")


def true_division(x: Column, y: Column) -> Column:
    """x / y of doubles, with infinities and NaN where the divisor is zero."""
    negative = (F.signum(x) < 0) != (y.cast("string") == "-0.0")
    at_zero = F.when((x == 0) | F.isnan(x), F.lit(NAN)).otherwise(F.when(negative, F.lit(-INF)).otherwise(F.lit(INF)))
    return F.when((y == 0) & x.isNotNull(), at_zero).otherwise(x / F.when(y != 0, y))


def floor_division(a: Bound, b: Bound) -> Bound:
    if _wider(a, b) == "int":
        x, y = _number(a).cast("long"), _number(b).cast("long")
        left = F.when((y == 0) & x.isNotNull(), F.lit(0)).otherwise(F.call_function("div", x - _floor_mod(x, y), F.when(y != 0, y)))
        return Bound(left.cast("long"), "int", True)
    quotient = true_division(as_double(a), as_double(b))
    return Bound(whole(F.floor, quotient), "float")


def _floor_mod(x: Column, y: Column) -> Column:
    """Integer remainder with the sign of the divisor; 0 for a zero divisor."""
    rest = x % F.when(y != 0, y).when(y == 0, F.lit(1))
    return F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest).cast("long")


def remainder(a: Bound, b: Bound) -> Bound:
    if _wider(a, b) == "int":
        return Bound(_floor_mod(_number(a).cast("long"), _number(b).cast("long")), "int", True)
    x, y = as_double(a), as_double(b)
    rest = x % F.when(y == 0, F.lit(NAN)).otherwise(y)
    signed = F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest)
    undefined = F.isnan(x) | F.isnan(y) | (y == 0)
    return Bound(F.when(x.isNotNull() & y.isNotNull(), F.when(undefined, F.lit(NAN)).otherwise(signed)), "float")


def whole(rounding: Callable[[Column], Column], x: Column) -> Column:
    """floor or ceil as a double; values beyond 2**53 are whole, infinite or NaN already."""
    return F.when(F.abs(x) < F.lit(2.0**53), rounding(x).cast("double")).otherwise(x)


def power(a: Bound, b: Bound) -> Bound:
    """Doubles; integers to non-negative whole literals stay integers while they fit exactly."""
    numeric(a, "**")
    numeric(b, "**")
    raised = F.pow(as_double(a), as_double(b))
    if _wider(a, b) == "int":
        return Bound(raised.cast("long"), "int", True)
    return Bound(raised, "float")


def arithmetic(op: str, a: Bound, b: Bound) -> Bound:
    if "complex" in (a.kind, b.kind):
        return _complex_arithmetic(op, a, b)
    if op == "+" and a.kind == b.kind == "str":
        return Bound(F.concat(a.col, b.col), "str", True)
    if op == "-" and a.kind == b.kind == "time":
        return Bound(a.col - b.col, "delta", True)
    if op in ("+", "-") and {a.kind, b.kind} <= {"time", "delta"} and b.kind == "delta":
        return Bound(a.col + b.col if op == "+" else a.col - b.col, a.kind, True)
    numeric(a, op)
    numeric(b, op)
    kind = _wider(a, b)
    if op == "/":
        return Bound(true_division(as_double(a), as_double(b)), "float")
    if op == "//":
        return floor_division(a, b)
    if op == "%":
        return remainder(a, b)
    if op == "**":
        return power(a, b)
    x, y = (as_double(a), as_double(b)) if kind == "float" else (_number(a), _number(b))
    out = {"+": x + y, "-": x - y, "*": x * y}[op]
    return Bound(out, kind, kind != "float")


def logical(op: str, a: Bound, b: Bound) -> Bound:
    """Kleene logic for booleans, bitwise operations for integers."""
    if a.kind == b.kind == "bool":
        out = {"&": a.col & b.col, "|": a.col | b.col, "^": a.col != b.col}[op]
        return Bound(out, "bool", True)
    if {a.kind, b.kind} <= {"int", "bool"}:
        x, y = _number(a), _number(b)
        out = {"&": x.bitwiseAND(y), "|": x.bitwiseOR(y), "^": x.bitwiseXOR(y)}[op]
        return Bound(out, "int", True)
    raise TypeError(f"{op} needs booleans or integers, not {a.kind} and {b.kind}")


def invert(a: Bound) -> Bound:
    if a.kind == "bool":
        return Bound(~a.col, "bool", True)
    if a.kind == "int":
        return Bound(F.bitwise_not(a.col), "int", True)
    raise TypeError(f"~ needs booleans or integers, not {a.kind}")


def negate(a: Bound) -> Bound:
    if a.kind == "complex":
        return Bound(complex_col(-re_of(a), -im_of(a)), "complex")
    numeric(a, "-")
    return Bound(-_number(a), "int" if a.kind == "bool" else a.kind, a.sure)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def field(schema: T.StructType, name: str) -> Bound:
    """The column of that name, dotted leaf name, or path through structs."""
    names = {f.name: f for f in schema.fields}
    if name in names:
        f = names[name]
        return Bound(F.col(quoted(name)), kind_of(f.dataType))
    head, _, rest = name.partition(".")
    while rest:
        if head in names:
            at, dtype = F.col(quoted(head)), names[head].dataType
            for part in rest.split("."):
                if not isinstance(dtype, T.StructType) or part not in dtype.names:
                    raise KeyError(name)
                at, dtype = at[part], dtype[part].dataType
            return Bound(at, kind_of(dtype))
        more, _, rest = rest.partition(".")
        head = f"{head}.{more}"
    raise KeyError(name)


class Expr:
    """An expression that is not bound to a table; operators build larger ones."""

    __array_ufunc__ = None

    def __init__(self, bind: Callable[[T.StructType], Bound], text: str):
        self._bind, self.text = bind, text

    def bind(self, schema: T.StructType) -> Bound:
        return self._bind(schema)

    def __repr__(self) -> str:
        return f"Expr({self.text})"

    def __bool__(self):
        raise TypeError("an expression has no truth value; use & | ~ instead of and, or, not")

    def is_null(self) -> Expr:
        return lift(lambda a: Bound(a.col.isNull(), "bool", True), f"is_null({self.text})", self)

    def notnull(self) -> Expr:
        return lift(lambda a: Bound(a.col.isNotNull(), "bool", True), f"notnull({self.text})", self)

    def fillna(self, value: Any) -> Expr:
        def fill(a: Bound) -> Bound:
            b = Bound.of(value)
            kind = a.kind if a.kind == b.kind or a.kind == "float" else b.kind
            return Bound(F.coalesce(a.col, b.col), kind, a.sure and b.sure)

        return lift(fill, f"fillna({self.text}, {value!r})", self)

    def isin(self, values) -> Expr:
        """Two-valued membership; None among the values selects nulls."""
        values = list(values)

        def member(a: Bound) -> Bound:
            present = [v for v in values if v is not None and not (isinstance(v, float) and math.isnan(v))]
            test = F.coalesce(a.col.isin(present), F.lit(False)) if present else F.lit(False)
            if len(present) < len(values) and any(v is None for v in values):
                test = test | a.col.isNull()
            return Bound(test, "bool", True)

        return lift(member, f"isin({self.text}, ...)", self)

    def astype(self, dtype: str | T.DataType) -> Expr:
        def cast(a: Bound) -> Bound:
            to = T._parse_datatype_string(dtype) if isinstance(dtype, str) else dtype
            return Bound(a.col.cast(to), kind_of(to), a.sure or kind_of(to) != "float")

        return lift(cast, f"astype({self.text}, {dtype})", self)

    def __getitem__(self, key) -> Expr:
        """An element of a fixed-shape array column: [i], [:, i] or, with a shape in metadata, [:, i, j]."""
        at = key[1:] if isinstance(key, tuple) and key[0] == slice(None) else key
        at = at if isinstance(at, tuple) else (at,)

        def element(schema: T.StructType) -> Bound:
            bound = self.bind(schema)
            names = [f for f in schema.fields if f.name == self.text]
            shape = names[0].metadata.get("shape") if names else None
            flat = at[0] if len(at) == 1 else sum(i * math.prod(shape[n + 1 :]) for n, i in enumerate(at))
            index = F.lit(flat + 1) if flat >= 0 else F.lit(flat)
            item = names[0].dataType.elementType if names else T.DoubleType()
            return Bound(F.try_element_at(bound.col, index), kind_of(item))

        return Expr(element, f"{self.text}[{key}]")


def lift(function: Callable[..., Bound], text: str, *operands: Any) -> Expr:
    """An Expr of a function of Bounds; operands are Exprs, names of nothing, or literals."""

    def bind(schema: T.StructType) -> Bound:
        return function(*[o.bind(schema) if isinstance(o, Expr) else Bound.of(o) for o in operands])

    return Expr(bind, text)


def _text(x: Any) -> str:
    return x.text if isinstance(x, Expr) else repr(x)


def _binary(symbol: str, function: Callable[[str, Bound, Bound], Bound], swap: bool = False):
    def method(self, other):
        one, two = (other, self) if swap else (self, other)
        return lift(lambda a, b: function(symbol, a, b), f"({_text(one)} {symbol} {_text(two)})", one, two)

    return method


for _name, _symbol in {"add": "+", "sub": "-", "mul": "*", "truediv": "/", "floordiv": "//", "mod": "%", "pow": "**"}.items():
    setattr(Expr, f"__{_name}__", _binary(_symbol, arithmetic))
    setattr(Expr, f"__r{_name}__", _binary(_symbol, arithmetic, swap=True))
for _name, _symbol in {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    setattr(Expr, f"__{_name}__", _binary(_symbol, compare))
for _name, _symbol in {"and": "&", "or": "|", "xor": "^"}.items():
    setattr(Expr, f"__{_name}__", _binary(_symbol, logical))
    setattr(Expr, f"__r{_name}__", _binary(_symbol, logical, swap=True))
Expr.__invert__ = lambda self: lift(invert, f"~{self.text}", self)
Expr.__neg__ = lambda self: lift(negate, f"-{self.text}", self)
Expr.__pos__ = lambda self: self
Expr.__hash__ = object.__hash__


def col(name: str) -> Expr:
    """The column of that name in whatever table the expression is used with."""
    return Expr(lambda schema: field(schema, name), name)


def lit(value: Any) -> Expr:
    return Expr(lambda schema: Bound.of(value), repr(value))


_BINARY = {
    ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%", ast.Pow: "**",
}
_LOGICAL = {ast.BitAnd: "&", ast.BitOr: "|", ast.BitXor: "^"}
_COMPARE = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
_CONSTANTS = {"pi": math.pi, "e": math.e, "inf": INF, "nan": NAN, "True": True, "False": False, "None": None}


class ExpressionError(ValueError):
    """The text of an expression uses something that is not allowed in it."""


def compile_text(text: str, names: Mapping[str, Any] | None = None) -> Expr:
    """Compile an expression string.

    Names are columns unless ``names`` has them (expressions or constants).
    Only arithmetic, comparison, logic, indexing by numbers and the functions
    of the registry are allowed; nothing is evaluated by Python.
    """
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as error:
        raise ExpressionError(f"not an expression: {text!r}") from error
    out = _compile(tree, names or {})
    return out if isinstance(out, Expr) else lit(out)


def _path(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def _lifted(value: Any) -> Expr:
    return value if isinstance(value, Expr) else lit(value)


def _compile(node: ast.AST, names: Mapping[str, Any]) -> Any:
    from granary.functions import REGISTRY

    if isinstance(node, ast.Constant):
        if isinstance(node.value, str | int | float | complex | bool) or node.value is None:
            return node.value
    elif isinstance(node, ast.Name):
        if node.id in names:
            return names[node.id]
        return _CONSTANTS[node.id] if node.id in _CONSTANTS else col(node.id)
    elif isinstance(node, ast.Attribute):
        path = _path(node)
        if path:
            return col(path)
    elif isinstance(node, ast.BinOp):
        a, b = _compile(node.left, names), _compile(node.right, names)
        if type(node.op) in _BINARY:
            return _binary(_BINARY[type(node.op)], arithmetic)(_lifted(a), b)
        if type(node.op) in _LOGICAL:
            return _binary(_LOGICAL[type(node.op)], logical)(_lifted(a), b)
        if isinstance(node.op, ast.LShift | ast.RShift):
            name = "bitwise_left_shift" if isinstance(node.op, ast.LShift) else "bitwise_right_shift"
            return REGISTRY[name](a, b)
    elif isinstance(node, ast.UnaryOp):
        a = _compile(node.operand, names)
        if isinstance(node.op, ast.USub):
            return -a
        if isinstance(node.op, ast.UAdd):
            return a
        return ~_lifted(a)
    elif isinstance(node, ast.BoolOp):
        symbol = "&" if isinstance(node.op, ast.And) else "|"
        out = _lifted(_compile(node.values[0], names))
        for value in node.values[1:]:
            out = _binary(symbol, logical)(out, _compile(value, names))
        return out
    elif isinstance(node, ast.Compare):
        sides = [_compile(x, names) for x in (node.left, *node.comparators)]
        out = None
        for op, a, b in zip(node.ops, sides, sides[1:], strict=False):
            if isinstance(op, ast.In | ast.NotIn):
                test = _lifted(b).isin([a]) if not isinstance(b, list | tuple) else _lifted(a).isin(b)
                if isinstance(a, str) and isinstance(b, Expr):
                    test = REGISTRY["contains"](b, a)
                test = ~test if isinstance(op, ast.NotIn) else test
            elif type(op) in _COMPARE:
                test = _binary(_COMPARE[type(op)], compare)(_lifted(a), b)
            else:
                break
            out = test if out is None else out & test
        else:
            return out
    elif isinstance(node, ast.Tuple | ast.List):
        return [_compile(x, names) for x in node.elts]
    elif isinstance(node, ast.IfExp):
        return REGISTRY["where"](*[_compile(x, names) for x in (node.test, node.body, node.orelse)])
    elif isinstance(node, ast.Subscript):
        key = _index(node.slice)
        return _lifted(_compile(node.value, names))[key]
    elif isinstance(node, ast.Call):
        name = node.func.id if isinstance(node.func, ast.Name) else None
        args = [_compile(x, names) for x in node.args]
        options = {k.arg: _compile(k.value, names) for k in node.keywords}
        if name in REGISTRY:
            return REGISTRY[name](*args, **options)
        if isinstance(node.func, ast.Attribute) and node.func.attr in ("is_null", "notnull", "fillna", "isin", "astype"):
            return getattr(_lifted(_compile(node.func.value, names)), node.func.attr)(*args, **options)
        raise ExpressionError(f"unknown function in expression: {ast.unparse(node.func)}")
    raise ExpressionError(f"not allowed in an expression: {ast.unparse(node)}")


def _index(node: ast.AST):
    if isinstance(node, ast.Tuple):
        return tuple(_index(x) for x in node.elts)
    if isinstance(node, ast.Slice) and node.lower is node.upper is node.step is None:
        return slice(None)
    value = ast.literal_eval(node)
    if not isinstance(value, int):
        raise ExpressionError("array columns are indexed by whole numbers")
    return value


def to_expr(value: Any, names: Mapping[str, Any] | None = None) -> Expr:
    """Expr of a string, Expr or literal."""
    if isinstance(value, Expr):
        return value
    return compile_text(value, names) if isinstance(value, str) else lit(value)


def predicate(value: Any, schema: T.StructType) -> Column:
    """The Column of a boolean expression; anything else is a TypeError."""
    bound = to_expr(value).bind(schema)
    if bound.kind != "bool":
        raise TypeError(f"a predicate must be boolean, not {bound.kind}")
    return bound.col

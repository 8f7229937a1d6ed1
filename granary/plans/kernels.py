"""Elementwise kernels in restricted Python.

A kernel is a function of numbers with assignments, ``if``, ``for`` over a
``range`` of constants, and ``return``. It becomes one Spark expression: both
branches of an ``if`` are built and joined by ``where``, loops are unrolled.
A kernel with ``while``, ``break`` or ``continue`` has no such form and runs
on Arrow batches as masked NumPy operations.
"""

from __future__ import annotations

import ast
import inspect
import textwrap
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.expr import Bound, Expr, as_double, col, kind_of, lift, lit
from granary.expr import _compile as compile_node
from granary.functions import REGISTRY
from granary.plans.masked import Masked

#: Loops of more steps are not unrolled.
MOST_STEPS = 256
_CASTS = {"int": "long", "int32": "int", "int64": "long", "float": "double", "float32": "float", "float64": "double", "bool": "boolean"}
_ALLOWED = (ast.Assign, ast.AugAssign, ast.AnnAssign, ast.If, ast.For, ast.While, ast.Return, ast.Break, ast.Continue, ast.Pass, ast.Expr)


class KernelError(SyntaxError):
    """The function uses something that kernels do not have."""


def _parse(source: str) -> ast.FunctionDef:
    try:
        tree = ast.parse(textwrap.dedent(source))
    except SyntaxError as error:
        raise KernelError(f"not a function: {error}") from error
    found = [n for n in tree.body if isinstance(n, ast.FunctionDef)]
    if len(found) != 1:
        raise KernelError("a kernel is one function")
    function = found[0]
    if function.args.vararg or function.args.kwarg or function.args.kwonlyargs:
        raise KernelError("a kernel has plain arguments")
    for node in ast.walk(function):
        if isinstance(node, ast.stmt) and node is not function and not isinstance(node, _ALLOWED):
            raise KernelError(f"line {node.lineno}: {type(node).__name__} is not allowed in a kernel")
        if isinstance(node, ast.Lambda | ast.ListComp | ast.DictComp | ast.SetComp | ast.GeneratorExp | ast.Attribute | ast.Await | ast.Yield):
            raise KernelError(f"line {node.lineno}: {type(node).__name__} is not allowed in a kernel")
        if isinstance(node, ast.Call) and not (
            isinstance(node.func, ast.Name) and (node.func.id in REGISTRY or node.func.id in _CASTS or node.func.id in ("range", "min", "max"))
        ):
            raise KernelError(f"line {node.lineno}: unknown function in a kernel")
    if not any(isinstance(n, ast.Return) for n in ast.walk(function)):
        raise KernelError("a kernel returns a value")
    return function


class _Casts(ast.NodeTransformer):
    """int(x) and the like as astype; min and max as minimum and maximum."""

    def visit_Call(self, node: ast.Call) -> ast.AST:
        self.generic_visit(node)
        name = node.func.id
        if name in _CASTS:
            value = ast.Call(ast.Name("trunc", ast.Load()), node.args, []) if _CASTS[name] in ("long", "int") else node.args[0]
            return ast.Call(ast.Name("astype", ast.Load()), [value, ast.Constant(_CASTS[name])], [])
        if name in ("min", "max"):
            return ast.Call(ast.Name("minimum" if name == "min" else "maximum", ast.Load()), node.args, [])
        return node


def _both(condition: Expr, a: Any, b: Any) -> Any:
    if a is b:
        return a
    if a is None or b is None:
        return b if a is None else a
    return REGISTRY["where"](condition, a, b)


class _Builder:
    """Runs the statements of a kernel on expressions."""

    def run(self, body: list[ast.stmt], names: dict[str, Any], done: Any, result: Any) -> tuple[dict, Any, Any]:
        """Names, whether a value has been returned (an Expr, True or None), and that value."""
        for statement in body:
            if done is True:
                break
            if isinstance(statement, ast.Return):
                value = self.value(statement.value, names)
                result = value if done is None else REGISTRY["where"](done, result, value)
                done = True
            elif isinstance(statement, ast.Assign):
                value = self.value(statement.value, names)
                for target in statement.targets:
                    names = {**names, self.name(target): value}
            elif isinstance(statement, ast.AnnAssign):
                names = {**names, self.name(statement.target): self.value(statement.value, names)}
            elif isinstance(statement, ast.AugAssign):
                step = ast.BinOp(ast.Name(self.name(statement.target), ast.Load()), statement.op, statement.value)
                names = {**names, self.name(statement.target): self.value(step, names)}
            elif isinstance(statement, ast.If):
                test = self.value(statement.test, names)
                if not isinstance(test, Expr):
                    names, done, result = self.run(statement.body if test else statement.orelse, names, done, result)
                    continue
                yes = self.run(statement.body, names, None, None)
                no = self.run(statement.orelse, names, None, None)
                names = {n: _both(test, yes[0].get(n), no[0].get(n)) for n in {*yes[0], *no[0]}}
                if yes[1] is not None or no[1] is not None:
                    returned = _both(test, yes[2], no[2])
                    now = self.either(test, yes[1], no[1])
                    result = returned if done is None else REGISTRY["where"](done, result, returned)
                    done = now if done is None else (True if now is True else done | now)
            elif isinstance(statement, ast.For):
                for i in self.steps(statement, names):
                    names = {**names, self.name(statement.target): i}
                    names, done, result = self.run(statement.body, names, done, result)
        return names, done, result

    @staticmethod
    def either(test: Expr, yes: Any, no: Any) -> Any:
        if yes is True and no is True:
            return True
        as_expr = lambda d: lit(False) if d is None else lit(True) if d is True else d
        return (test & as_expr(yes)) | (~test & as_expr(no))

    @staticmethod
    def name(target: ast.AST) -> str:
        if not isinstance(target, ast.Name):
            raise KernelError("kernels assign to plain names")
        return target.id

    @staticmethod
    def value(node: ast.AST, names: dict[str, Any]) -> Any:
        return compile_node(ast.fix_missing_locations(node), names)

    def steps(self, statement: ast.For, names: dict[str, Any]) -> range:
        call = statement.iter
        if not (isinstance(call, ast.Call) and getattr(call.func, "id", "") == "range"):
            raise KernelError("kernels loop over range")
        bounds = [self.value(a, names) for a in call.args]
        if not all(isinstance(b, int) for b in bounds):
            raise KernelError("the range of a kernel's loop is constant")
        steps = range(*bounds)
        if len(steps) > MOST_STEPS:
            raise KernelError(f"a kernel's loop has at most {MOST_STEPS} steps")
        return steps


class Kernel:
    """A function as an expression of its arguments."""

    def __init__(self, source: str, name: str | None = None):
        self.source = textwrap.dedent(source)
        self.tree = _parse(self.source)
        self.name = name or self.tree.name
        self.arguments = [a.arg for a in self.tree.args.args]
        self.stepwise = any(isinstance(n, ast.While | ast.Break | ast.Continue) for n in ast.walk(self.tree))

    def __call__(self, *operands: Any) -> Expr:
        if len(operands) != len(self.arguments):
            raise TypeError(f"{self.name} takes {len(self.arguments)} arguments")
        if self.stepwise:
            return self._in_blocks(*operands)
        names = {a: o for a, o in zip(self.arguments, operands, strict=True)}
        body = _Casts().visit(_parse(self.source)).body
        _, done, result = _Builder().run(body, names, None, None)
        if done is None:
            raise KernelError(f"{self.name} returns nothing")
        return result if isinstance(result, Expr) else lit(result)

    def _in_blocks(self, *operands: Any) -> Expr:
        """Arrow batches as NumPy arrays, with masks for the elements that are still in a branch or a loop."""
        body, arguments = self.tree.body, self.arguments
        if not arguments:
            raise KernelError("a kernel has an argument")

        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series(Masked(arguments, [c.to_numpy(dtype=np.float64) for c in columns]).run(body))

        run.__annotations__ = {}
        udf = F.pandas_udf(run, T.DoubleType(), F.PandasUDFType.SCALAR)
        return lift(lambda *bounds: Bound(udf(*[as_double(b) for b in bounds]), "float"), self.name, *operands)


def dsl_kernel(function: Callable) -> Kernel:
    """Turn a function into a kernel; usable as a decorator."""
    return Kernel(inspect.getsource(function))


def kernel_from_source(source: str, name: str | None = None) -> Kernel:
    return Kernel(source, name)


def validate_kernel(function: Callable | str) -> dict:
    """Whether a function is a kernel: {valid, error, arguments, stepwise}."""
    try:
        kernel = Kernel(function if isinstance(function, str) else inspect.getsource(function))
        if not kernel.stepwise:
            kernel(*[lit(1.0) for _ in kernel.arguments])
    except (KernelError, ValueError, TypeError) as error:
        return {"valid": False, "error": str(error), "arguments": [], "stepwise": False}
    return {"valid": True, "error": None, "arguments": kernel.arguments, "stepwise": kernel.stepwise}


def validate_compiled(function: Callable | str, **dtypes: str) -> dict:
    """Whether a kernel becomes one Spark expression over columns of the given types: {valid, error, expression}."""
    found = validate_kernel(function)
    if not found["valid"]:
        return {"valid": False, "error": found["error"], "expression": None}
    kernel = Kernel(function if isinstance(function, str) else inspect.getsource(function))
    if kernel.stepwise:
        return {"valid": False, "error": f"{kernel.name} has loops that depend on its data", "expression": None}
    schema = T.StructType([T.StructField(a, T._parse_datatype_string(dtypes.get(a, "double"))) for a in kernel.arguments])
    try:
        expression = kernel(*[col(a) for a in kernel.arguments])
        expression.bind(schema)
    except (KernelError, ValueError, TypeError) as error:
        return {"valid": False, "error": str(error), "expression": None}
    return {"valid": True, "error": None, "expression": expression}


def lazyudf(function: Callable, *operands: Any, dtype: str = "double") -> Expr:
    """A function of NumPy blocks as an expression: it gets an array per operand and gives one of their length.

    Blocks are Arrow batches, so the function must not depend on where they
    begin. A ``Kernel`` becomes the expression that it stands for.
    """
    if isinstance(function, Kernel):
        return function(*operands)

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(function(*[c.to_numpy() for c in columns])))

    run.__annotations__ = {}
    to = T._parse_datatype_string(dtype)
    udf = F.pandas_udf(run, to, F.PandasUDFType.SCALAR)
    return lift(lambda *bounds: Bound(udf(*[b.col for b in bounds]), kind_of(to)), function.__name__, *operands)


class _Traced:
    """NumPy functions on expressions while a function is traced."""

    def __getattr__(self, name: str) -> Any:
        if name in REGISTRY:
            return REGISTRY[name]
        return getattr(np, name)


def jit(function: Callable) -> Callable[..., Expr]:
    """Trace a function of NumPy calls and operators once into an expression.

    The function's global ``np`` is replaced by the registry while it runs.
    """

    def call(*operands: Any) -> Expr:
        code = function.__code__
        names = {**function.__globals__, "np": _Traced()}
        traced = type(function)(code, names, function.__name__, function.__defaults__, function.__closure__)
        out = traced(*operands)
        return out if isinstance(out, Expr) else lit(out)

    call.__name__ = function.__name__
    return call

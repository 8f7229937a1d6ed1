"""Indexes: min/max summaries by range, and sorted copies.

An index never changes an answer. SUMMARY and BUCKET keep minima and maxima
of stretches of the rows, written in table order; PARTIAL, FULL and OPSI keep
a copy of the rows sorted by the indexed value, whose Parquet row groups then
have narrow ranges that the scan skips. ``Table.where`` reads a fresh index if
a part of its condition bounds the indexed column or expression; the whole
condition is then tested on what the index leaves. A table that changes makes
its indexes stale, and stale indexes are not used.
"""

from __future__ import annotations

import ast
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.expr import Bound, Expr, compare, to_expr
from granary.expr import field as column_of
from granary.scratch import delete, index_folder

if TYPE_CHECKING:
    from granary.operators.table import Table

KINDS = ("SUMMARY", "BUCKET", "PARTIAL", "FULL", "OPSI")
_SORTED = ("PARTIAL", "FULL", "OPSI")
_VALUE, _STRETCH = "__indexed", "__stretch"
#: Rows summarised together.
STRETCH_ROWS = 65_536
#: Rows in the Parquet files of sorted copies and of stretches, so that a scan can skip most.
FILE_ROWS = 1_000_000


@dataclass
class Index:
    """A side table in the shared scratch folder, and what it is of."""

    table: Table
    name: str
    kind: str
    expression: Expr
    path: str = ""
    stale: bool = False
    built: Any = field(default=None, repr=False)

    def rebuild(self) -> Index:
        self.path = f"{index_folder(self.table.spark)}/{uuid.uuid4().hex}"
        value = self.expression.bind(self.table.schema)
        if value.kind in ("complex", "array", "other"):
            raise TypeError(f"cannot index {value.kind} values")
        if self.kind in _SORTED:
            rows = self.table.df.withColumn(_VALUE, value.col).orderBy(F.col(_VALUE).asc_nulls_last(), *self.table.order)
        else:
            found = self.table.numbered()
            rows = found.df.withColumn(_VALUE, value.col).withColumn(_STRETCH, F.floor(F.col("__pos") / STRETCH_ROWS))
            rows = rows.repartitionByRange(_STRETCH).sortWithinPartitions("__pos")
        rows.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.path}/rows")
        if self.kind not in _SORTED:
            self._summarised(self.table.spark.read.parquet(f"{self.path}/rows")).write.parquet(f"{self.path}/summary")
        self.stale = False
        return self

    compact = rebuild

    def drop(self) -> None:
        delete(self.table.spark, self.path)
        self.stale = True

    def append(self, rows: DataFrame) -> None:
        """Take in rows, with positions, that were added at the end of the table: more files beside those that are there."""
        value = self.expression.bind(self.table.schema)
        rows = rows.withColumn(_VALUE, value.col)
        if self.kind in _SORTED:
            rows = rows.orderBy(F.col(_VALUE).asc_nulls_last(), *self.table.order)
        else:
            rows = rows.withColumn(_STRETCH, F.floor(F.col("__pos") / STRETCH_ROWS))
            self._summarised(rows).write.mode("append").parquet(f"{self.path}/summary")
        rows.write.mode("append").parquet(f"{self.path}/rows")

    def _summarised(self, rows: DataFrame) -> DataFrame:
        """The extremes of each stretch, NaN left out; a stretch that grew has a row for each of its parts."""
        plain = F.when(F.isnan(_VALUE), None).otherwise(F.col(_VALUE)) if self._kind_of_value == "float" else F.col(_VALUE)
        return rows.groupBy(_STRETCH).agg(
            F.min(plain).alias("low"), F.max(plain).alias("high"), F.count(_VALUE).alias("known"), F.count(F.lit(1)).alias("rows")
        )

    @property
    def nbytes(self) -> int:
        jvm = self.table.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.table.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.getContentSummary(path).getLength()

    @property
    def _kind_of_value(self) -> str:
        return self.expression.bind(self.table.schema).kind

    def _rows(self) -> DataFrame:
        if self.stale:
            raise RuntimeError(f"index {self.name!r} is stale; rebuild it")
        return self.table.spark.read.parquet(f"{self.path}/rows")

    def _summary(self) -> DataFrame:
        return self.table.spark.read.parquet(f"{self.path}/summary")

    def _bounded(self, bounds: list[tuple[str, Any]]) -> DataFrame:
        """Rows whose indexed value meets all bounds (operator, constant), as comparisons of this library have it.

        In sorted copies the bounds reach the scan, which skips row groups.
        In table order the summaries say which stretches can have such rows.
        """
        value = Bound(F.col(_VALUE), self._kind_of_value)
        rows = self._rows()
        if self.kind not in _SORTED:
            possible = self._summary()
            for op, constant in bounds:
                if op in (">", ">=", "=="):
                    possible = possible.filter(F.col("high") >= constant if op != ">" else F.col("high") > constant)
                if op in ("<", "<=", "=="):
                    possible = possible.filter(F.col("low") <= constant if op != "<" else F.col("low") < constant)
            first, last = possible.agg(F.min(_STRETCH), F.max(_STRETCH)).first()
            if first is None:
                return rows.limit(0)
            rows = rows.filter(F.col(_STRETCH).between(first, last)).join(possible.select(_STRETCH).distinct(), _STRETCH, "left_semi")
        for op, constant in bounds:
            rows = rows.filter(compare(op, value, Bound.of(constant)).col)
        return rows

    def between(self, low: Any = None, high: Any = None) -> Table:
        """Rows whose indexed value lies in [low, high]; NaN lies in no such stretch, nulls neither."""
        bounds = [(op, x) for op, x in ((">=", low), ("<=", high)) if x is not None]
        return self.table._derived(self._bounded(bounds).select(*self.table.df.columns))

    def equal(self, value: Any) -> Table:
        return self.between(value, value)

    def ordered(self, start: int = 0, stop: int | None = None, ascending: bool = True) -> Table:
        """Rows start to stop in the order of the indexed value."""
        if self.kind not in _SORTED:
            raise ValueError("only sorted indexes have an order")
        key = F.col(_VALUE).asc_nulls_last() if ascending else F.col(_VALUE).desc_nulls_last()
        out = self.table._derived(self._rows(), order=[key, *self.table.order])
        out = out._sliced(slice(start, stop))
        return out._derived(out.df.drop(_VALUE)) if _VALUE not in str(out.order) else out

    def iter_sorted(self, **options: Any) -> Iterator:
        return iter(self.ordered(**options))

    def min_max(self) -> tuple:
        """The least and greatest value, NaN left out, from the summaries alone where there are some."""
        if self.stale:
            raise RuntimeError(f"index {self.name!r} is stale; rebuild it")
        if self.kind not in _SORTED:
            return tuple(self._summary().agg(F.min("low"), F.max("high")).first())
        plain = F.when(F.isnan(_VALUE), None).otherwise(F.col(_VALUE)) if self._kind_of_value == "float" else F.col(_VALUE)
        return tuple(self._rows().agg(F.min(plain), F.max(plain)).first())


def create(table: Table, column: str | None = None, *, expression: Any = None, kind: str = "BUCKET", name: str | None = None) -> Index:
    """Build an index on a stored column or an expression."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of index {kind!r}")
    if (column is None) == (expression is None):
        raise ValueError("index a column or an expression")
    if column is not None and column in table.computed:
        raise ValueError(f"{column!r} is computed; index its expression")
    if column is not None:
        column_of(table.schema, column)
    expr = to_expr(expression if expression is not None else column)
    name = name or column or expr.text
    if name in table._indexes:
        raise ValueError(f"there is an index {name!r} already")
    index = Index(table, name, kind, expr).rebuild()
    table._indexes[name] = index
    return index


# Planning

_SYMBOLS = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "=="}
_MIRRORED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "=="}


def _constant(node: ast.AST) -> Any:
    """The value of a number or a text, perhaps negated; None for anything else."""
    try:
        value = ast.literal_eval(node)
    except (ValueError, TypeError, SyntaxError):
        return None
    return value if isinstance(value, int | float | str) and not isinstance(value, bool) and value == value else None


def _parts(node: ast.AST) -> Iterator[ast.AST]:
    """What all has to hold for a condition to hold."""
    if isinstance(node, ast.BoolOp) and isinstance(node.op, ast.And):
        for part in node.values:
            yield from _parts(part)
    elif isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitAnd):
        yield from _parts(node.left)
        yield from _parts(node.right)
    else:
        yield node


def _bounds(condition: Any) -> dict[str, list[tuple[str, Any]]]:
    """Normalised text of an expression -> its bounds (operator, constant) in the parts of a condition."""
    text = condition.text if isinstance(condition, Expr) else condition
    if not isinstance(text, str):
        return {}
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError:
        return {}
    found: dict[str, list[tuple[str, Any]]] = {}
    for part in _parts(tree):
        if not isinstance(part, ast.Compare):
            continue
        ends = [part.left, *part.comparators]
        for op, one, two in zip(part.ops, ends, ends[1:], strict=False):
            symbol = _SYMBOLS.get(type(op))
            if symbol is None:
                continue
            if (constant := _constant(two)) is not None and _constant(one) is None:
                found.setdefault(ast.unparse(one), []).append((symbol, constant))
            elif (constant := _constant(one)) is not None and _constant(two) is None:
                found.setdefault(ast.unparse(two), []).append((_MIRRORED[symbol], constant))
    return found


def _normal(text: str) -> str | None:
    try:
        return ast.unparse(ast.parse(text.strip(), mode="eval").body)
    except SyntaxError:
        return None


def _comparable(index: Index, bounds: list[tuple[str, Any]]) -> bool:
    kind = index._kind_of_value
    return all((kind == "str") == isinstance(constant, str) and kind in ("int", "float", "str") for _, constant in bounds)


def plan(table: Table, condition: Any) -> tuple[Index, list[tuple[str, Any]]] | None:
    """The fresh index that a condition can use, and the bounds on its value; sorted copies come first, then those with most bounds."""
    bounds = _bounds(condition)
    usable = []
    for index in table.indexes:
        mine = bounds.get(_normal(index.expression.text) or "")
        if mine and not index.stale and _comparable(index, mine):
            usable.append((index.kind in _SORTED, len(mine), index, mine))
    if not usable:
        return None
    *_, index, mine = max(usable, key=lambda u: u[:2])
    return index, mine


def narrowed(table: Table, condition: Any) -> DataFrame:
    """The table's rows, or fewer by an index, among which are all that meet the condition."""
    found = plan(table, condition)
    if found is None:
        return table.df
    index, bounds = found
    rows = index._bounded(bounds)
    others = [i for i in table.indexes if i is not index and not i.stale and i.kind not in _SORTED and index.kind not in _SORTED]
    for other in others:  # stretches are the same in all summaries, so those of several columns meet
        mine = _bounds(condition).get(_normal(other.expression.text) or "")
        if mine and _comparable(other, mine):
            rows = rows.join(other._bounded(mine).select(_STRETCH).distinct(), _STRETCH, "left_semi")
    return rows.select(*table.df.columns)


def explain(table: Table, condition: Any) -> str:
    """The physical plan of a filter, with what reaches the scan, and the index that is read."""
    df = table.where(condition).frame
    plan_text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    found = plan(table, condition)
    return f"{plan_text}\nIndex: {found[0].name if found else 'none'}"


__all__ = ["KINDS", "Index", "create", "explain", "narrowed", "plan"]

"""Browsing a store: one filter, one sort, one window of rows at a time."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import pandas as pd

from granary.operators.table import Table, minmax_buckets


class Browser:
    """What is shown of a table; every setting keeps the others, and pages are remembered."""

    def __init__(self, table: Table, page: int = 50):
        self.table, self.page = table, page
        self.filter: Any = None
        self.sort: tuple[Any, Any] | None = None
        self.columns: list[str] | None = None
        self._pages: dict[int, pd.DataFrame] = {}

    def _changed(self, **values: Any) -> Browser:
        for name, value in values.items():
            setattr(self, name, value)
        self._pages.clear()
        return self

    def set_filter(self, condition: Any) -> Browser:
        return self._changed(filter=condition)

    def set_sort(self, columns: Any, ascending: Any = True) -> Browser:
        return self._changed(sort=None if columns is None else (columns, ascending))

    def set_columns(self, columns: Sequence[str] | None) -> Browser:
        return self._changed(columns=None if columns is None else list(columns))

    def current(self) -> Table:
        """Filter, then sort, then projection."""
        out = self.table if self.filter is None else self.table.where(self.filter)
        out = out if self.sort is None else out.sort_by(*self.sort, view=True)
        return out

    def rows(self, start: int = 0) -> pd.DataFrame:
        if start not in self._pages:
            found = self.current()[start : start + self.page].to_pandas()
            self._pages[start] = found if self.columns is None else found[self.columns]
        return self._pages[start]

    def count(self) -> int:
        return len(self.current())

    def group(self, keys: Any, **aggregations: Any) -> pd.DataFrame:
        groups = (self.table if self.filter is None else self.table.where(self.filter)).group_by(keys)
        return (groups.agg(**aggregations) if aggregations else groups.size()).to_pandas()

    def plot(self, column: str, buckets: int = 500) -> pd.DataFrame:
        """The minimum and maximum of each of ``buckets`` stretches, in the current order."""
        return minmax_buckets(self.current(), column, buckets).toPandas()

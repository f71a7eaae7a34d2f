"""Places where users plug in their own parts, each a dictionary with checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row


class Registry(dict):
    """Named parts; names are trimmed and may not be blank; a later part replaces an earlier one."""

    def register(self, name: str, part):
        name = (name or "").strip()
        if not name:
            raise ValueError("a part needs a name")
        self[name] = part
        return part

    def unregister(self, name: str):
        return self.pop((name or "").strip(), None)

    def find(self, name: str):
        return self.get((name or "").strip())


class Extensions:
    """Scopes, weights and matchers are Columns or functions to Columns; providers and inputs are functions to DataFrames."""

    def __init__(self):
        self.definitions, self.scopes, self.weights, self.matchers, self.providers, self.inputs, self.plugins = (Registry() for _ in range(7))

    def complete(self, *args, ready: bool = True, **kwargs) -> DataFrame | None:
        """Results of all providers together; while indexes aren't ready only of those marked `works_early`."""
        out = None
        for p in self.providers.values():
            if ready or getattr(p, "works_early", False):
                df = p(*args, **kwargs)
                out = df if out is None else out.unionByName(df)
        return out

    def load_plugin(self, name: str, *args):
        make = self.plugins.find(name)
        if make is None:
            raise KeyError(f"no plugin {name}")
        return make(*args)


def each(df: DataFrame, fn: Callable[[Row], bool | None]) -> int:
    """Call fn with each row until it returns False; rows come a partition at a time. Returns the rows seen."""
    n = 0
    rows: Iterator[Row] = df.toLocalIterator()
    for n, row in enumerate(rows, 1):  # noqa: B007
        if fn(row) is False:
            break
    return n

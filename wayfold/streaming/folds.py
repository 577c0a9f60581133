"""Ordered folds: each key's rows in order through a state, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Output rows that are handed over at once.
AT_ONCE = 10_000


def folded(rows: DataFrame, key: str, order: list[str], schema: str, begin: Callable[[], object], step: Callable[[object, tuple], list[tuple]], end: Callable[[object], list[tuple]] | None = None) -> DataFrame:
    """Rows by key in order -> what step gives for each, and end after a key's last row, with the key before it.

    Keys are dealt over tasks and rows are sorted there; a task holds one key's state and a batch of rows, never a key's history.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = state = None
        out: list[tuple] = []
        for frame in frames:
            for r in frame.itertuples(index=False):
                now = getattr(r, key)
                if state is None or now != held:
                    if state is not None and end:
                        out += [(held, *o) for o in end(state)]
                    held, state = now, begin()
                out += [(held, *o) for o in step(state, r)]
            if len(out) >= AT_ONCE:
                yield table(out, schema)
                out = []
        if state is not None and end:
            out += [(held, *o) for o in end(state)]
        yield table(out, schema)

    return rows.where(rows[key].isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


_KINDS = {"long": "Int64", "double": "float64", "boolean": "boolean", "timestamp": "datetime64[us]", "string": "object"}


def table(out: list[tuple], schema: str) -> pd.DataFrame:
    """Tuples as a frame of "name type, .." columns: longs stay longs beside nulls, times come as microseconds."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = zip(*out, strict=True) if out else ([] for _ in names)
    whole = {n: pd.Series(list(c), dtype="Int64" if kind == "timestamp" else _KINDS[kind]).astype(_KINDS[kind]) for n, kind, c in zip(names, kinds, columns, strict=True)}
    return pd.DataFrame(whole)

"""User functions over files and packages.

A per-file function runs over Arrow batches with ``mapInPandas`` (bounded
memory: one batch at a time).  A per-package function is either a pair of a partial and a
merge function, which splits any package over any number of tasks, or, where it needs the package in
order, a function over a sorted stream of the package's batches.  Neither ever holds a whole package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

#: Packages whose states a task holds before it hands them on.
STATES = 10_000


def walk_files(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch of files; an exception stops the job."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)
    return df.mapInPandas(run, schema)


def walk_packages(df: DataFrame, group_col: str, partial: Callable[[pd.DataFrame], pd.DataFrame],
                  merge: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``partial(some rows of a package) -> state rows`` and ``merge(state rows of a package) -> state rows``, both of ``schema`` with ``group_col``.

    Rows don't move: each task makes states of what it reads and merges them as it goes, and
    only states are shuffled, at most one of each package from each task (or for each STATES packages in it).  ``merge`` must
    not depend on order or grouping; then a package's result doesn't depend on its size or
    on how it is cut.  Rows with a null ``group_col`` are one package.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for key, rows in batch.groupby(group_col, dropna=False, sort=False):
                key = None if pd.isna(key) else key
                state = partial(rows)
                held[key] = merge(pd.concat([held[key], state], ignore_index=True)) if key in held else state
            if len(held) > STATES:
                yield pd.concat(held.values(), ignore_index=True)
                held = {}
        if held:
            yield pd.concat(held.values(), ignore_index=True)
    return df.mapInPandas(run, schema).groupBy(group_col).applyInPandas(merge, schema)


def stream_packages(df: DataFrame, group_col: str, order: Sequence[str],
                    fn: Callable[[object, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """P2 in order: ``fn(package, batches)`` sees all rows of a package, sorted by ``order``, as a stream of batches.

    One task sorts (spilling as needed) and streams a package, so this is for functions that
    need its order; its memory is a batch, whatever the package's size.  ``fn`` need not read its batches to the end.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pieces():
            for batch in batches:
                for key, rows in batch.groupby(group_col, dropna=False, sort=False):
                    yield None if pd.isna(key) else key, rows
        todo = pieces()
        ahead = next(todo, None)
        while ahead is not None:
            package = ahead[0]

            def own():
                nonlocal ahead
                while ahead is not None and ahead[0] == package:
                    rows, ahead = ahead[1], next(todo, None)
                    yield rows
            mine = own()
            yield from fn(package, mine)
            for _ in mine:
                pass
    return df.repartition(group_col).sortWithinPartitions(group_col, *order).mapInPandas(run, schema)

"""Exact event and distinct-subject counts by a two-level aggregate.

Level 1 makes *cells*: one row per key and subject, combined before the shuffle, so a key
that holds a third of all rows arrives as at most one row per subject and map task.
Level 2 sums cells per key, again combined first. No ``count(DISTINCT)``, hence no Expand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import split_column_names
from ..runtime import join_spread

SplitColumns = Sequence[tuple[str, str, str]]
_N, _NONE = "__n", "__no_split"


def _cols(names: Sequence[str]) -> list:
    return [F.col(f"`{n}`") for n in names]


def subject_cells(events: DataFrame, keys: Sequence[str], split_columns: SplitColumns = ()) -> DataFrame:
    """One row per key and ``subject_id`` with event counts (also by split, if asked).

    Null keys and a null subject form groups of their own.
    """
    counts = [F.count(F.lit(1)).alias(_N)]
    if split_columns:
        counts += [F.count_if(F.col("split") == v).alias(f"__n_{name}") for v, name, _ in split_columns]
        counts.append(F.count_if(F.col("split").isNull()).alias(_NONE))
    return events.groupBy(*_cols([*keys, "subject_id"])).agg(*counts)


def count_cells(cells: DataFrame, keys: Sequence[str], split_columns: SplitColumns = ()) -> DataFrame:
    """Event and subject counts per key from cells; without keys one row, zero for no cells."""
    sums = [
        F.coalesce(F.sum(_N), F.lit(0)).alias("event_count"),
        F.count(F.lit(1)).alias("subject_count"),
    ]
    for _, events_name, subjects_name in split_columns:
        inner = F.col(f"`__n_{events_name}`")
        sums.append(F.coalesce(F.sum(inner), F.lit(0)).alias(events_name))
        sums.append(F.count_if(inner > 0).alias(subjects_name))
    if split_columns:
        sums.append(F.coalesce(F.sum(_NONE), F.lit(0)).alias("_missing_split_count"))
    return cells.groupBy(*_cols(keys)).agg(*sums)


def code_occurrences(
    events: DataFrame, keys: Sequence[str], splits: Sequence[str] = (), assigned: DataFrame | None = None
) -> DataFrame:
    """``event_count`` and exact ``subject_count`` per key, without any privacy rule.

    ``splits`` adds a pair of columns per named split and ``_missing_split_count``, the number
    of events whose ``split`` is null; the split is a column of ``events`` unless ``assigned``
    gives it per subject. A null subject counts as one subject. Without events the result is empty.
    """
    wide = split_column_names(splits)
    cells = subject_cells(events, keys, wide) if assigned is None else split_cells(events, keys, assigned, wide)
    return count_cells(cells, keys, wide)


def union_cells(cells: DataFrame, scope: Sequence[str], split_columns: SplitColumns = ()) -> DataFrame:
    """Cells summed over all keys of a scope: still one row per scope and subject, so subjects stay exact."""
    names = [c for c in cells.columns if c.startswith("__n")]
    return cells.groupBy(*_cols([*scope, "subject_id"])).agg(*[F.sum(f"`{c}`").alias(c) for c in names])


def split_cells(events: DataFrame, keys: Sequence[str], splits: DataFrame, split_columns: SplitColumns = ()) -> DataFrame:
    """``subject_cells`` of events whose ``split`` is their subject's in ``splits`` (null where unknown).

    ``keys`` may hold ``split``. Events are combined to cells before they meet the splits, and
    the cells of a subject that holds many are spread over tasks. A subject in two splits counts in both.
    """
    inner = [k for k in keys if k != "split"]
    cells = subject_cells(events, inner)
    joined = join_spread(cells, splits.select("subject_id", "split"), "subject_id", "left", [f"`{k}`" for k in inner], events)
    sums = [F.sum(_N).alias(_N)]
    if split_columns:
        own = lambda test: F.sum(F.when(test, F.col(_N)).otherwise(F.lit(0).cast("bigint")))
        sums += [own(F.col("split") == v).alias(f"__n_{name}") for v, name, _ in split_columns]
        sums.append(own(F.col("split").isNull()).alias(_NONE))
    return joined.groupBy(*_cols([*keys, "subject_id"])).agg(*sums)


def duplicate_keys(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with ``n_rows``."""
    return frame.groupBy(*_cols(keys)).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")

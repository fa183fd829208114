"""Distinct counts by stochastic-averaging bit matrices.

A sketch of a group is a matrix of ``BUCKETS`` times ``RANKS`` bits, kept as the set of its set bits, as most are unset:
an identifier's hash picks the bucket, the rank of the lowest set bit of the rest sets one bit. Sketches merge by
union, so partial results of any days, shards or runs can be stored and combined in any order;
repeats change nothing. The estimate is the maximum-likelihood count given how many buckets
have each rank's bit; its variance comes from the Fisher information.

The relative standard error is about ``0.65 / sqrt(BUCKETS)``, 2 % at 1024, and far less for
groups of fewer members than buckets. ``lower`` and ``upper`` are three standard errors away.

Null identifiers are not counted. Null days, codes and splits form groups of their own;
``level`` names the dimensions that a row is broken down by, the others are null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Stash, join_spread

#: Buckets of a sketch, a power of two of at most 1024.
BUCKETS = 1024
#: Bits kept per bucket; the last one stands for all higher ranks.
RANKS = 40
#: Standard errors between the estimate and its bounds.
WIDTH = 3.0
#: More than the set bits of a matrix: a power of two, to number parts above it.
_PART = 1 << 16

#: Chance that an identifier of a bucket has each rank.
_CHANCE = np.array([2.0 ** -(r + 1) for r in range(RANKS - 1)] + [2.0 ** -(RANKS - 1)])


def cell_of(identifier: Column) -> Column:
    """The one bit of the matrix that an identifier sets: bucket times ``RANKS`` plus rank, as a bigint."""
    size = BUCKETS.bit_length() - 1
    code = F.xxhash64(identifier)
    rest = F.shiftrightunsigned(code, size)
    lowest = rest.bitwiseAND(-rest)
    rank = F.when(lowest == 0, RANKS - 1).otherwise(F.least(F.length(F.bin(lowest)) - 1, F.lit(RANKS - 1)))
    return code.bitwiseAND(F.lit(BUCKETS - 1)) * RANKS + rank


def build(rows: DataFrame, keys: Sequence[str], identifier: str) -> DataFrame:
    """Partial sketches ``keys, cells``: the set bits of each group's matrix, combined in the map tasks."""
    cells = rows.filter(F.col(identifier).isNotNull()).select(*keys, cell_of(F.col(identifier)).alias("cell"))
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_set("cell")).alias("cells"))


def merge(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of sketches by (fewer) keys."""
    return sketches.select(*keys, F.explode("cells").alias("cell")).groupBy(*keys).agg(F.array_sort(F.collect_set("cell")).alias("cells"))


def likeliest(counts: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Estimate and standard error for rows of per-rank bucket counts.

    Each cell is unset with probability exp(-x q). The score is convex and falling in x, and
    the starting point lies below its root, so Newton's steps rise to it.
    """
    s = counts.astype(float)
    free = ((buckets - s) * _CHANCE).sum(1)
    total = s.sum(1)
    free = np.maximum(free, _CHANCE[-1] * 0.5)  # all cells set: take half a cell as free
    x = np.maximum(total / (free + (s * _CHANCE).sum(1) / 2), 1e-12)
    for _ in range(200):
        y = np.minimum(x[:, None] * _CHANCE, 300.0)
        e = np.expm1(y)
        score = (s * _CHANCE / e).sum(1) - free
        slope = (s * _CHANCE**2 * (e + 1) / e**2).sum(1)
        step = np.where(slope > 0, score / np.maximum(slope, 1e-300), 0.0)
        x = np.maximum(x + step, 1e-12)
        if np.all(np.abs(step) <= 1e-9 * x):
            break
    y = np.minimum(x[:, None] * _CHANCE, 300.0)
    information = (_CHANCE**2 / np.expm1(y)).sum(1)
    n = np.where(total > 0, buckets * x, 0.0)
    variance = np.maximum(buckets / information - n, 0.0)  # the spread of a random n is no error
    return n, np.where(total > 0, np.sqrt(variance), 0.0)


def _bounds(counts: np.ndarray, buckets: int) -> np.ndarray:
    """Estimate, lower and upper bound for rows of per-rank bucket counts; equal rows are solved once."""
    if not len(counts):
        return np.zeros((3, 0), np.int64)
    one = np.ascontiguousarray(counts.astype(np.uint16)).view(f"V{2 * RANKS}").ravel()
    _, first, back = np.unique(one, return_index=True, return_inverse=True)
    some = counts[first]
    n, error = likeliest(some, buckets)
    least = some.sum(1)  # every set bit is at least one identifier
    middle = np.maximum(np.rint(n), least)
    lower, upper = np.maximum(np.floor(n - WIDTH * error), least), np.maximum(np.ceil(n + WIDTH * error), middle)
    return np.stack([middle, lower, upper]).astype(np.int64)[:, back]


def estimates(group: np.ndarray, cell: np.ndarray, groups: int, buckets: int) -> np.ndarray:
    """``_bounds`` of ``groups`` groups, given the group and the set bit of each (distinct) pair."""
    filled = np.bincount(group, minlength=groups)
    single = filled[group] == 1
    out = np.zeros((3, groups), np.int64)
    by_rank = _bounds(np.eye(RANKS, dtype=np.int64), buckets)  # groups of one set bit, which are most
    out[:, group[single]] = by_rank[:, cell[single] % RANKS]
    rest = np.flatnonzero(filled > 1)
    for at in range(0, len(rest), 50_000):
        own = rest[at : at + 50_000]
        place = np.full(groups, -1)
        place[own] = np.arange(len(own))
        mine = place[group]
        keep = mine >= 0
        counts = np.bincount(mine[keep] * RANKS + cell[keep] % RANKS, minlength=len(own) * RANKS).reshape(-1, RANKS)
        out[:, own] = _bounds(counts, buckets)
    return out


def _estimate(keys: Sequence[str], inner: bool, buckets: int):
    """Per row of ``cells``: the estimate of the row (``part`` null) and, if ``inner``, of each part in it.

    A cell is its part times ``_PART`` plus the set bit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch["cells"]
            cells = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            whole = np.unique(row * _PART + cells % _PART)
            found = [(np.arange(batch.num_rows), None, estimates(whole // _PART, whole % _PART, batch.num_rows, buckets))]
            if inner:
                both, group = np.unique(row * (1 << 31) + cells // _PART, return_inverse=True)
                found.append((both >> 31, both & ((1 << 31) - 1), estimates(group, cells % _PART, len(both), buckets)))
            for rows, part, numbers in found:
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch[k].take(take) for k in keys],
                        pa.nulls(len(rows), pa.int64()) if part is None else pa.array(part, pa.int64()),
                        *[pa.array(x) for x in numbers],
                    ],
                    [*keys, "part", "n_distinct", "lower", "upper"],
                )

    return run


def estimate(sketches: DataFrame, keys: Sequence[str], inner: bool = False) -> DataFrame:
    """``keys, part, n_distinct, lower, upper`` per group, and per part of a group if ``inner``."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in sketches.schema if f.name in keys]
    columns = ", ".join([*kinds, "part bigint, n_distinct bigint, lower bigint, upper bigint"])
    return sketches.select(*keys, "cells").mapInArrow(_estimate(list(keys), inner, BUCKETS), columns)


def subject_splits_of(splits: DataFrame) -> DataFrame:
    """One ``split`` per subject: the latest assignment that was not removed (ties: the least name)."""
    live = splits.filter("removed_at is null and subject_id is not null")
    order = F.struct(F.col("assigned_at").isNotNull(), "assigned_at")
    newest = live.groupBy("subject_id").agg(F.max(order).alias("newest"))
    tied = live.join(newest, "subject_id").filter(order.eqNullSafe(F.col("newest")))
    return tied.groupBy("subject_id").agg(F.min("split").alias("split"))


def breakdowns(events: DataFrame, splits: DataFrame) -> DataFrame:
    """Distinct subjects per day, code, split and every combination: ``level, day, code, split, n_distinct, lower, upper``.

    Splits are numbered, and a sketch holds the set bits of all its splits, each with the number of the split; so a level
    without and the level with the split come from one row. Sketches are built once per day and code, stored, and
    merged upward: by code, by day, and by split. A row holds at most ``BUCKETS * RANKS`` numbers
    per split, whatever the group's size. A subject without a live split has a null split.
    """
    stash = Stash(events.sparkSession)
    named, _ = stash.put(subject_splits_of(splits).filter("split is not null"))
    names, _ = stash.put(
        named.select("split").distinct().select("split", F.row_number().over(Window.orderBy("split")).cast("bigint").alias("part"))
    )  # one row per split
    known = named.join(names, "split", "left").select("subject_id", "part")
    rows = events.filter("subject_id is not null").select(F.to_date("time").alias("day"), "code", "subject_id")
    met = join_spread(rows, known, "subject_id", "left", ["day", "code"])
    cell = F.coalesce("part", F.lit(0)) * _PART + cell_of(F.col("subject_id"))
    fine, _ = stash.put(met.select("day", "code", cell.alias("cell")).groupBy("day", "code").agg(F.collect_set("cell").alias("cells")))
    by_code, _ = stash.put(merge(fine, ["code"]))
    by_split = by_code.select(F.explode("cells").alias("c")).select(F.floor(F.col("c") / _PART).alias("part"), "c").groupBy("part")
    by_split, _ = stash.put(by_split.agg(F.collect_set("c").alias("cells")))
    made = {("day", "code"): fine, ("code",): by_code, ("day",): merge(fine, ["day"]), (): merge(by_split, [])}
    kinds = {"day": "date", "code": "string"}
    parts = []
    for level, sketches in made.items():
        columns = [F.col(k) if k in level else F.lit(None).cast(t).alias(k) for k, t in kinds.items()]
        found = estimate(sketches, level, inner=True)
        label = F.concat_ws(",", *[F.lit(k) for k in level], F.when(F.col("part").isNotNull(), "split"))
        parts.append(found.select(F.when(label == "", "all").otherwise(label).alias("level"), *columns, "part", "n_distinct", "lower", "upper"))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.join(names, "part", "left").select("level", "day", "code", "split", "n_distinct", "lower", "upper")

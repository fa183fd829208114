"""Per-entity features from events: cumulative daily cube, as-of endpoints, recency.

Nulls: events without entity, type or time are not counted; a null (or non-finite) value adds
0. Cents are summed as decimals; a total that does not fit a bigint is an error. Copies with one ``event_id`` count once; events without an id each count. Repeated
cohort rows count once; a type listed twice counts once. Empty inputs give no rows.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Stash

_KEY = ["subject_id", "code"]


def base_events(events: DataFrame, subjects: DataFrame, types: DataFrame) -> DataFrame:
    """Distinct timed events of the wanted entities and types: ``subject_id, code, time, cents``.

    Both filters are semi-joins that Spark broadcasts while the side is below its limit. Copies
    carry the same entity and type, so filtering first is safe, and removing copies combines
    before the shuffle.
    """
    wanted = (
        events.filter("time is not null")
        .join(types.select("code").distinct(), "code", "left_semi")
        .join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
    )
    finite = F.abs(F.col("numeric_value")) < F.lit(float("inf"))
    cents = F.when(finite, F.round(F.col("numeric_value") * 100)).otherwise(0).cast("decimal(28,0)")
    rows = wanted.select("event_id", *_KEY, "time", cents.alias("cents"))
    copies = rows.filter("event_id is not null").groupBy(*_KEY, "event_id")
    once = copies.agg(F.min(F.struct("time", "cents")).alias("e")).select(*_KEY, "e.time", "e.cents")
    return once.unionByName(rows.filter("event_id is null").drop("event_id"))


def stored_cube(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``daily_cube`` and the base events, each written once to the shared folder."""
    stash = Stash(base.sparkSession)
    base, _ = stash.put(base)
    cube, _ = stash.put(daily_cube(base))
    return cube, base


def daily_cube(base: DataFrame) -> DataFrame:
    """Running totals per entity, type and day: ``n``, ``cents`` up to and with the day, ``last_time``.

    A window partition has one row per day, however many events a pair has.
    """
    daily = base.groupBy(*_KEY, F.to_date("time").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), F.max("time").alias("last_time")
    )
    run = Window.partitionBy(*_KEY).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(
        *_KEY, "day", F.sum("n").over(run).alias("n"), F.sum("cents").over(run).alias("cents"),
        F.max("last_time").over(run).alias("last_time"),
    )


def as_of(cube: DataFrame, base: DataFrame, points: DataFrame) -> DataFrame:
    """Totals of all events before each point ``subject_id, at[, ...]``, one row per point and type with any.

    Whole days come from the last cube row before the point's day; of the day itself the
    events before the point are added.
    """
    day = F.to_date("at")
    whole = (
        cube.join(points, "subject_id")
        .filter(F.col("day") < day)
        .groupBy(*_KEY, *points.columns[1:])
        .agg(F.max(F.struct("day", "n", "cents", "last_time")).alias("c"))
        .select(*_KEY, *points.columns[1:], "c.n", "c.cents", "c.last_time")
    )
    partial = (
        base.join(points, "subject_id")
        .filter((F.to_date("time") == day) & (F.col("time") < F.col("at")))
        .groupBy(*_KEY, *points.columns[1:])
        .agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), F.max("time").alias("last_time"))
    )
    both = whole.unionByName(partial).groupBy(*_KEY, *points.columns[1:])
    return both.agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.max("last_time").alias("last_time"))


def _days_between(start, end):
    """Whole days of 24 hours, rounded down; of zone-less timestamps, so no session zone matters."""
    return F.extract(F.lit("DAY"), end - start).cast("bigint")


def feature_rows(events: DataFrame, cohort: DataFrame, types: DataFrame) -> DataFrame:
    """``subject_id, code, n_events, days_since_last, total_cents`` before each ``index_time``.

    A subject with several index times is listed at each of them.
    """
    points = cohort.select("subject_id", F.col("index_time").alias("at")).distinct().filter("at is not null")
    base = base_events(events, points, types)
    found = as_of(*stored_cube(base), points)
    return found.select(
        *_KEY,
        F.col("n").alias("n_events"),
        _days_between(F.col("last_time"), F.col("at")).alias("days_since_last"),
        F.col("cents").cast("bigint").alias("total_cents"),
    )


def window_rows(events: DataFrame, cohort: DataFrame, types: DataFrame, days: Sequence[int]) -> DataFrame:
    """``subject_id, code, window_days, n_events, total_cents`` of the last days before the index time.

    Each window is the totals at its end less those at its start; windows without events are left out.
    """
    ends = cohort.select("subject_id", F.col("index_time")).distinct().filter("index_time is not null")
    lengths = F.explode(F.array(*[F.lit(int(d)) for d in (0, *days)])).alias("back")
    points = ends.select("subject_id", "index_time", lengths).select(
        "subject_id",
        (F.col("index_time") - F.make_dt_interval("back")).alias("at"),
        "index_time",
        "back",
    )
    base = base_events(events, points, types)
    totals = as_of(*stored_cube(base), points)
    total = totals.filter("back = 0").select(*_KEY, "index_time", "n", "cents")
    each = total.select(*_KEY, "index_time", "n", "cents", F.explode(F.array(*[F.lit(int(d)) for d in days])).alias("back"))
    start = totals.filter("back > 0").select(*_KEY, "index_time", "back", F.col("n").alias("n0"), F.col("cents").alias("c0"))
    less = each.join(start, [*_KEY, "index_time", "back"], "left")
    zero = F.lit(0)
    return less.select(
        *_KEY,
        F.col("back").alias("window_days"),
        (F.col("n") - F.coalesce("n0", zero)).alias("n_events"),
        (F.col("cents") - F.coalesce("c0", zero)).cast("bigint").alias("total_cents"),
    ).filter("n_events > 0")


def feature_table(events: DataFrame, cohort: DataFrame, types: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """One row per cohort row (subject and index time), three columns per feature number.

    ``n_events_<no>`` and ``total_cents_<no>`` are 0 and ``days_since_last_<no>`` null where
    nothing happened. At most one map entry per type is gathered per row.
    """
    ends = cohort.select("subject_id", "index_time").distinct()
    points = ends.filter("index_time is not null").select("subject_id", F.col("index_time").alias("at"))
    base = base_events(events, points, types)
    named = types.filter("code is not null").groupBy("code").agg(F.min("feature_no").alias("no"))
    found = as_of(*stored_cube(base), points).join(named, "code")
    days = _days_between(F.col("last_time"), F.col("at"))
    entry = F.struct("no", F.struct("n", days.alias("days"), F.col("cents").cast("bigint").alias("cents")).alias("v"))
    maps = found.groupBy("subject_id", "at").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    all_rows = ends.join(
        maps.withColumnRenamed("at", "__at").withColumnRenamed("subject_id", "__s"),
        F.col("subject_id").eqNullSafe(F.col("__s")) & (F.col("index_time") == F.col("__at")),
        "left",
    )
    zero = F.lit(0).cast("bigint")
    columns = []
    for no in numbers:
        value = F.try_element_at(F.col("m"), F.lit(int(no)))
        columns += [
            F.coalesce(value["n"], zero).alias(f"n_events_{no}"),
            value["days"].alias(f"days_since_last_{no}"),
            F.coalesce(value["cents"], zero).alias(f"total_cents_{no}"),
        ]
    return all_rows.select("subject_id", "index_time", *columns)

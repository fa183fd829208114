"""References to records that are missing, deleted, or arrive later.

References are combined to one row per key and month before the shuffle, so a key that holds a
third of all rows is a few hundred rows in every join. Distinct non-null keys meet the parents' keys in an
anti-join. The months of the other keys meet the parents' merged lifetimes; only months in which a
parent's life begins or ends go back to single rows.

Null keys are no references. A row whose reference time is null counts only if its key is
``missing``, with a null period. A parent row without a start never lived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Stash, join_spread

#: Most months in doubt that are sent to all tasks.
MIXED_ROWS = 50_000


def lifetimes(parents: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Per key the disjoint ``spans`` [start, end) in which a row lives, and ``first`` start ever.

    Overlapping and touching spans are merged first, so repeated rows do not make lists long.
    """
    rows = parents.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("ref"),
        F.col(start).alias("s"),
        F.coalesce(F.col(end), F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")).alias("e"),
    ).distinct()
    before = Window.partitionBy("ref").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("ref").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    live = rows.filter("s < e")
    opened = live.withColumn("new", (F.coalesce(F.max("e").over(before) < F.col("s"), F.lit(True))).cast("int"))
    island = opened.withColumn("g", F.sum("new").over(upto)).groupBy("ref", "g").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    spans = island.groupBy("ref").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    first = rows.groupBy("ref").agg(F.min("s").alias("first"))
    return first.join(spans, "ref", "left").select("ref", "first", F.coalesce("spans", F.array().cast("array<struct<s:timestamp_ntz,e:timestamp_ntz>>")).alias("spans"))


def monthly(rows: DataFrame, key: str, at: str) -> DataFrame:
    """References per key and month, combined before the shuffle: ``ref, period, n, lo, hi``; period and bounds null without a time."""
    refs = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("ref"), F.col(at).alias("at"))
    return refs.groupBy("ref", period_of("at").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")
    )


def period_of(at: str):
    """Year and month as one number, such as 202101; ``named`` writes it as ``yyyy-MM``."""
    return F.year(at) * 100 + F.month(at)


def missing(months: DataFrame, parents: DataFrame, parent_key: str) -> DataFrame:
    """``ref, period, kind, n`` of keys no parent row has: an anti-join of distinct keys, joined back to the months."""
    known = parents.filter(F.col(parent_key).isNotNull()).select(F.col(parent_key).alias("ref")).distinct()
    gone = months.select("ref").distinct().join(known, "ref", "left_anti")
    return months.join(gone, "ref", "left_semi").select("ref", "period", F.lit("missing").alias("kind"), "n")


def timed_orphans(rows: DataFrame, key: str, at: str, parents: DataFrame, parent_key: str, start: str, end: str, stash: Stash) -> DataFrame:
    """``ref, period, kind, n``: references per key and month whose parent is not alive at their time.

    ``missing``: no parent row has the key; ``deleted``: one had started by then; else ``late``.
    """
    months, _ = stash.put(monthly(rows, key, at))
    found = missing(months, parents, parent_key)
    met = months.filter("lo is not null").join(lifetimes(parents, parent_key, start, end), "ref")
    covered = F.exists("spans", lambda x: (x["s"] <= F.col("lo")) & (F.col("hi") < x["e"]))
    apart = ~F.exists("spans", lambda x: (x["s"] <= F.col("hi")) & (F.col("lo") < x["e"]))
    begun, unborn = F.col("first") <= F.col("lo"), F.coalesce(F.col("first") > F.col("hi"), F.lit(True))
    doubt, _ = stash.put(met.filter(~covered).withColumn("whole", F.when(apart & begun, "deleted").when(apart & unborn, "late")))
    found = found.unionByName(doubt.filter("whole is not null").select("ref", "period", F.col("whole").alias("kind"), "n"))
    mixed = doubt.filter("whole is null").select("ref", "period", "first", "spans")
    refs = rows.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("ref"), F.col(at).alias("at"), period_of(at).alias("period"))
    back = _meet(refs, mixed)
    alive = F.exists("spans", lambda x: (x["s"] <= F.col("at")) & (F.col("at") < x["e"]))
    kind = F.when(alive, None).when(F.col("first") <= F.col("at"), "deleted").otherwise("late")
    single = back.select("ref", "period", kind.alias("kind")).filter("kind is not null").groupBy("ref", "period", "kind").agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(single)


def _meet(refs: DataFrame, mixed: DataFrame) -> DataFrame:
    """References of the mixed months: sent to all tasks while few, else joined with hot months spread by time."""
    if mixed.limit(MIXED_ROWS + 1).count() <= MIXED_ROWS:
        return refs.join(F.broadcast(mixed), ["ref", "period"])
    month = F.struct("ref", "period").alias("month")
    return join_spread(refs.select(month, "ref", "period", "at"), mixed.select(month, "first", "spans"), "month", "inner", ["at"])


def state_orphans(rows: DataFrame, key: str, at: str, parents: DataFrame, parent_key: str, is_valid, stash: Stash) -> DataFrame:
    """``ref, period, kind, n``: ``missing`` without a parent row, ``deleted`` if all its rows are invalid."""
    months, _ = stash.put(monthly(rows, key, at))
    state = parents.filter(F.col(parent_key).isNotNull()).groupBy(F.col(parent_key).alias("ref")).agg(F.max(is_valid).alias("valid"))
    deleted = months.join(state.filter("not valid"), "ref", "left_semi").select("ref", "period", F.lit("deleted").alias("kind"), "n")
    return missing(months, parents, parent_key).unionByName(deleted)


def named(found: DataFrame, table_name: str, field_name: str) -> DataFrame:
    """Orphans with ``table_name, field_name, ref_key, period, kind, n``."""
    return found.select(
        F.lit(table_name).alias("table_name"),
        F.lit(field_name).alias("field_name"),
        F.col("ref").cast("string").alias("ref_key"),
        F.when(F.col("period").isNotNull(), F.format_string("%04d-%02d", F.floor(F.col("period") / 100), F.col("period") % 100)).alias("period"),
        "kind",
        "n",
    )

"""Keys that hold most rows, and exact per-key quantiles that do not mind them.

Both work by refining histograms with mergeable counts: every pass combines counts in the map
tasks, so a key's rows are never gathered. Heavy keys refine a histogram over the hash of the
key; quantiles refine a histogram over the value until each rank's bin holds one value. Only keys with a
bounded number of distinct values are ranked by a sort of these.

A null key is no value and never heavy, though its rows count in the total. Quantiles leave out
null, NaN and infinite values. Empty tables give no rows; ties and repeated rows count.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Stash, join_spread

#: Hash bits refined per pass.
BITS = 12
#: Bins per interval and pass when values are refined.
BINS = 64
#: Distinct values up to which a key's quantiles go by a sort.
SORTED_VALUES = 20_000
#: Tasks over which the values of one key are spread.
SPREAD = 16


def _long_form(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``f`` (number of the field) and ``h`` (hash of its value, null for null)."""
    pairs = [
        F.struct(F.lit(i).alias("f"), F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c).cast("string"))).alias("h"))
        for i, c in enumerate(fields)
    ]
    return rows.select(F.explode(F.array(*pairs)).alias("p")).select("p.f", "p.h")


def _is_any(field, value, chosen: list[tuple[int, int]]):
    """(field, value) is one of a bounded list."""
    by: dict[int, list[int]] = {}
    for f, v in chosen:
        by.setdefault(f, []).append(v)
    test = F.lit(False)
    for f, values in by.items():
        test = test | ((field == f) & value.isin(values))
    return test


def heavy_keys(rows: DataFrame, fields: Sequence[str], share: Fraction) -> DataFrame:
    """``key_field, key_value, n_rows`` of each value that holds at least ``share`` of all rows.

    Bins over the hash of the key lose those below the share, the rest is refined by ``BITS``
    more bits until each holds one hash; keys with that hash are then counted themselves. At
    most ``1/share`` bins per field survive a pass, which bounds what the driver sees.
    """
    long = _long_form(rows, fields)
    used, kept, total = 0, None, None
    while True:
        width = min(BITS, 64 - used)
        at = F.shiftrightunsigned("h", 64 - used - width)
        part = long if kept is None else long.filter(_is_any(F.col("f"), F.shiftrightunsigned("h", 64 - used), kept))
        bins = part.groupBy("f", at.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")
        )
        if total is None:
            sums = F.sum("n").over(Window.partitionBy("f"))
            bins = bins.withColumn("total", sums)
            least = F.col("total") * share.numerator
        else:
            least = F.lit(total * share.numerator)
        big = bins.filter(F.col("b").isNotNull() & (F.col("n") * share.denominator >= least)).collect()
        if not big:
            return rows.sparkSession.createDataFrame([], "key_field string, key_value string, n_rows bigint")
        total = total or big[0]["total"]
        used += width
        kept = [(r["f"], r["b"]) for r in big]
        if used == 64 or all(r["lo"] == r["hi"] for r in big):
            break
    hashes = [(r["f"], r["lo"]) for r in big] if used < 64 else kept
    pairs = [
        F.struct(F.lit(i).alias("f"), F.lit(c).alias("key_field"), F.col(c).cast("string").alias("key_value"))
        for i, c in enumerate(fields)
    ]
    flat = rows.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    counted = (
        flat.filter(_is_any(F.col("f"), F.xxhash64("key_value"), hashes))
        .groupBy("key_field", "key_value")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    return counted.filter(F.col("n_rows") * share.denominator >= total * share.numerator)


def _rank(probability: float, n):
    """1-based rank of the lower quantile: ceil(p n), at least 1."""
    return F.greatest(F.ceil(F.lit(float(probability)) * n), F.lit(1)).cast("bigint")


def _sorted_keys(counts: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """``k, i, v`` by value counts in order, per key; a window partition has at most ``SORTED_VALUES`` rows."""
    order = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select("k", "v", "c", "n", F.sum("c").over(order).alias("upto"))
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _rank(p, F.col("n")).alias("rank")) for i, p in enumerate(probabilities)]))
    each = ranked.select("k", "v", "c", "upto", asked.alias("q")).filter("q.rank <= upto and q.rank > upto - c")
    return each.select("k", "q.i", "v")


def _refined_keys(counts: DataFrame, probabilities: Sequence[float], stash: Stash) -> DataFrame:
    """``k, i, v`` by refining value histograms: every pass counts bins of each open interval and keeps the bin of the rank.

    Intervals are between values that occur; a pass cuts each into ``BINS`` bins, counted with a map-side combine, so at
    most ``BINS`` rows per key and quantile meet in one task, however many values a key has. Intervals
    and counts meet by key and a hash of the value, so a key's counts are spread over ``SPREAD`` tasks.
    """
    ends = counts.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("n").alias("n"))
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _rank(p, F.col("n")).alias("rank")) for i, p in enumerate(probabilities)]))
    todo, left = stash.put(ends.select("k", "lo", "hi", asked.alias("q")).select("k", "q.i", "q.rank", "lo", "hi"))
    salted = counts.select("k", F.pmod(F.xxhash64("v"), F.lit(SPREAD)).alias("s"), "v", "c")
    done = []
    while left:
        done.append(todo.filter("lo = hi").select("k", "i", F.col("lo").alias("v")))
        open_ = todo.filter("lo < hi").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        scale = F.when(F.greatest(F.abs("lo"), F.abs("hi")) > 1e300, 0.25).otherwise(1.0)
        place = (F.col("v") * scale - F.col("lo") * scale) / (F.col("hi") * scale - F.col("lo") * scale)
        bins = (
            salted.join(open_, ["k", "s"])
            .filter("v between lo and hi")
            .withColumn("b", F.least(F.floor(place * BINS), F.lit(BINS - 1)))
            .groupBy("k", "i", "rank", "b")
            .agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        )
        order = Window.partitionBy("k", "i").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        hit = bins.withColumn("upto", F.sum("c").over(order)).filter("rank <= upto and rank > upto - c")
        todo, left = stash.put(hit.select("k", "i", (F.col("rank") - (F.col("upto") - F.col("c"))).alias("rank"), "lo", "hi"))
    return reduce(lambda a, b: a.unionByName(b), done)


def key_quantiles(rows: DataFrame, field: str, value: str, probabilities: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``key_field, key_value, n_rows, n_values, q<percent>...`` for every key of a field.

    Lower quantiles: the value at rank ``ceil(p n)``. Rows are read once and combined to counts per key and value.
    Keys of more than ``SORTED_VALUES`` distinct values go by refined histograms, the others by a
    sort within the key; the results are the same, and no task ever sorts more values of a key than that.
    """
    stash = Stash(rows.sparkSession)
    keyed = rows.filter(F.col(field).isNotNull()).select(F.col(field).cast("string").alias("k"), F.col(value).cast("double").alias("v"))
    real = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < F.lit(float("inf")))
    clean = keyed.select("k", F.when(real, F.when(F.col("v") == 0, F.lit(0.0)).otherwise(F.col("v"))).alias("v"))
    counts, _ = stash.put(clean.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c")))
    some = F.col("v").isNotNull()
    sizes, _ = stash.put(
        counts.groupBy("k").agg(
            F.sum("c").alias("n_rows"), F.coalesce(F.sum(F.when(some, F.col("c"))), F.lit(0)).alias("n"), F.count("v").alias("values")
        )
    )
    large = sizes.filter(F.col("values") > SORTED_VALUES).select("k", "n")
    some_counts = counts.filter(some)
    small = some_counts.join(sizes.filter(F.col("values") <= SORTED_VALUES).select("k", "n"), "k")
    found = _sorted_keys(small, probabilities)
    if not large.isEmpty():
        hot, _ = stash.put(join_spread(some_counts, large, "k", "inner", ["v"]))
        found = found.unionByName(_refined_keys(hot, probabilities, stash))
    wide = found.groupBy("k").agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"q{round(p * 100):02d}") for i, p in enumerate(probabilities)])
    return sizes.join(wide, "k", "left").select(
        F.lit(field).alias("key_field"), F.col("k").alias("key_value"), "n_rows", F.col("n").alias("n_values"), *wide.columns[1:]
    )

"""Mixing sources to target weights: weighted fair queueing.

Each source's documents are shuffled (by hash), all first uses before all second uses. A use's
virtual finish time is the source's tokens up to and with it, divided by the source's weight.
In the order of finish times each source advances in proportion to its weight; the mix is
that order up to the token budget.

Running sums are two-level: sums per bucket of the order, sums over buckets, then within
buckets. Buckets are ranges of a uniform hash (or of virtual time), so a source that holds most
documents is spread over as many tasks as any other data of its size.

Documents of no tokens, without source or without a target are not used. A source listed twice
takes its greatest share and repeats; a share that is null or not above 0 excludes it, a null
``max_repeats`` means 1. Shares are relative to each other: sources without documents
reach 0 and the others keep their proportions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Stash

#: Rows of a running sum's bucket, about.
BUCKET_ROWS = 50_000
#: Most sources that are sent to all tasks; more are joined by a shuffle.
MAX_BROADCAST_SOURCES = 10_000


def targets_of(targets: DataFrame) -> DataFrame:
    """One usable row per source: ``source, target_share, max_repeats``."""
    one = targets.filter("source is not null").groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats")
    )
    return one.filter("target_share > 0 and max_repeats > 0")


def running_sum(rows: DataFrame, group: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """``value`` summed up to and with each row, per group in the order of bucket and then ``order``."""
    sums = rows.groupBy(*group, bucket).agg(F.sum(value).alias("__in"))
    upto = Window.partitionBy(*group, *[F.lit(0)] * (not group)).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, bucket, F.coalesce(F.sum("__in").over(upto), F.lit(0)).alias("__before"))
    own = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(offsets, [*group, bucket])
        .withColumn(name, F.col("__before") + F.sum(value).over(own))
        .drop("__before")
    )


def _slot(hashed: Column, slots: Column | int) -> Column:
    """Which of ``slots`` equal ranges of the 63-bit hash a row is in."""
    top = F.shiftright(hashed, 32)
    return F.shiftright(top * (F.lit(slots) if isinstance(slots, int) else slots), 31)


def plan(sized: DataFrame, targets: DataFrame, budget: int | None = None) -> tuple[DataFrame, float, int]:
    """Weights and supply per source, the budget in tokens, and the number of usable documents.

    Unless given, the budget is the greatest at which no source with documents needs more than
    ``max_repeats`` uses of any.
    """
    supply = sized.filter("n_tokens > 0").groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")
    )
    found = targets_of(targets).join(supply, "source")
    weight = F.col("target_share") / F.sum("target_share").over(Window.partitionBy(F.lit(0)))
    found = found.select("source", "target_share", weight.alias("weight"), "max_repeats", "tokens", "documents")
    limits = found.agg(
        F.min(F.col("tokens") * F.col("max_repeats") / F.col("weight")).alias("most"), F.sum("documents").alias("n")
    ).first()
    return found, float(budget if budget is not None else (limits["most"] or 0)), int(limits["n"] or 0)


def mix(sized: DataFrame, targets: DataFrame, stash: Stash, budget: int | None = None, seed: int = 0) -> DataFrame:
    """``doc_id, source, use_no, n_tokens, finish, running_tokens`` of the mix, in the order of ``running_tokens``.

    ``sized`` has ``doc_id, source, n_tokens``. The sum of tokens is at most the budget.
    """
    sized = sized.select("doc_id", "source", "n_tokens")
    sources, budget, n = plan(sized, targets, budget)
    sources, kinds = stash.put(sources)
    small = F.broadcast(sources) if kinds <= MAX_BROADCAST_SOURCES else sources
    needed = F.least(F.col("max_repeats"), F.ceil(F.lit(budget) * F.col("weight") / F.col("tokens")).cast("int"))
    uses = (
        sized.filter("n_tokens > 0")
        .join(small, "source")
        .filter(needed > 0)
        .select("doc_id", "source", "n_tokens", "weight", "documents", F.explode(F.sequence(F.lit(1), needed)).alias("use_no"))
        .withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1))
    )
    slots = F.ceil(F.col("documents") / BUCKET_ROWS)
    uses = uses.withColumn("b", (F.col("use_no") - 1) * slots + _slot(F.col("h"), slots))
    summed = running_sum(uses, ["source"], "b", ["use_no", "h", "doc_id"], "n_tokens", "upto")
    timed = summed.select("doc_id", "source", "use_no", "n_tokens", "h", (F.col("upto") / F.col("weight")).alias("finish"))
    queued, _ = stash.put(timed.filter(F.col("finish") <= budget * (1 + 1e-12)))
    ranges = max(1, -(-n // BUCKET_ROWS))
    ranged = queued.withColumn("t", F.floor(F.col("finish") * (ranges / max(budget, 1.0))))
    order = ["finish", "source", "use_no", "h", "doc_id"]
    total = running_sum(ranged, [], "t", order, "n_tokens", "running_tokens")
    return total.filter(F.col("running_tokens") <= budget).select("doc_id", "source", "use_no", "n_tokens", "finish", "running_tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: ``target_share, reached_tokens, reached_share, n_uses, most_uses``."""
    got = mixed.groupBy("source").agg(
        F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max("use_no").alias("most")
    )
    zero = F.lit(0).cast("bigint")
    rows = targets_of(targets).join(got, "source", "left").select(
        "source", "target_share", F.coalesce("t", zero).alias("reached_tokens"), F.coalesce("n", zero).alias("n_uses"),
        F.coalesce("most", F.lit(0)).alias("most_uses"),
    )
    total = F.sum("reached_tokens").over(Window.partitionBy(F.lit(0)))
    share = F.when(total > 0, F.col("reached_tokens") / total).otherwise(0.0)
    return rows.select("source", "target_share", "reached_tokens", share.alias("reached_share"), "n_uses", "most_uses")

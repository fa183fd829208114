"""Code frequencies in events and subjects, and catalog rows that do not hold.

Records are subjects: a subject counts once per code however many events it has. A null code is
no term; a null subject's events count, but no subject. All deliveries count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Stash, join_null_safe
from .burst_trie import count_terms

#: Fewer distinct subjects make a code rare; this share of all subjects makes it common.
RARE_BELOW, COMMON_SHARE = 20, 5
#: Fewer distinct subjects in a shard belong into the shard's rare row.
MASK_BELOW, RARE_ROW = 5, "__RARE__"
_SEP = "\x1f"


def subject_cells(events: DataFrame, stash: Stash) -> DataFrame:
    """``code, subject_id, shard, n``: events combined per cell, written once for all that is counted from them.

    Null codes are kept, as their subjects count in the total.
    """
    return stash.put(events.groupBy("code", "subject_id", "shard").agg(F.count(F.lit(1)).alias("n")))[0]


def code_frequencies(all_cells: DataFrame, stash: Stash) -> DataFrame:
    """``scope, code, n_events, n_subjects``; scope ``''`` is all events, else ``s`` and the shard (``s`` alone: null).

    Cells are per (code, subject, shard) and combined once more per (code, subject), so every subject
    meets the tries once per scope.
    """
    cells = all_cells.filter("code is not null")
    pairs = cells.groupBy("code", "subject_id").agg(F.sum("n").alias("n"))
    record = F.col("subject_id").isNotNull().cast("bigint").alias("records")
    scope = F.concat(F.lit("s"), F.coalesce(F.col("shard").cast("string"), F.lit("")), F.lit(_SEP))
    rows = cells.select(F.concat(scope, "code").alias("term"), F.col("n").alias("occurrences"), record).unionByName(
        pairs.select(F.concat(F.lit(_SEP), "code").alias("term"), F.col("n").alias("occurrences"), record)
    )
    at = F.locate(_SEP, F.col("term"))
    return count_terms(rows, stash).select(
        F.substring("term", F.lit(1), at - 1).alias("scope"),
        F.substring("term", at + 1, F.length("term")).alias("code"),
        F.col("occurrences").alias("n_events"),
        F.col("records").alias("n_subjects"),
    )


def _total(cells: DataFrame) -> int:
    return cells.select("subject_id").filter("subject_id is not null").distinct().count()


def marked_terms(events: DataFrame) -> DataFrame:
    """``code, n_events, n_subjects, is_rare, is_common`` of every distinct code."""
    stash = Stash(events.sparkSession)
    cells = subject_cells(events, stash)
    found = code_frequencies(cells, stash).filter("scope = ''").drop("scope")
    return found.select(
        "code",
        "n_events",
        "n_subjects",
        (F.col("n_subjects") < RARE_BELOW).alias("is_rare"),
        (F.col("n_subjects") * COMMON_SHARE >= _total(cells)).alias("is_common"),
    )


def marks(events: DataFrame, summary: DataFrame) -> DataFrame:
    """``code, mark``: ``rare``, ``common``, ``wrong`` and ``leaked``, each once per code.

    A catalog row of a code without events in its shard is compared with zero counts. Rows of
    the rare bucket and rows without a code are not judged.
    """
    stash = Stash(events.sparkSession)
    cells = subject_cells(events, stash)
    found, _ = stash.put(code_frequencies(cells, stash))
    whole = found.filter("scope = ''")
    rare = whole.filter(F.col("n_subjects") < RARE_BELOW).select("code", F.lit("rare").alias("mark"))
    common = whole.filter(F.col("n_subjects") * COMMON_SHARE >= _total(cells)).select("code", F.lit("common").alias("mark"))
    judged = summary.filter((F.col("code") != RARE_ROW) & F.col("code").isNotNull()).select(
        F.concat(F.lit("s"), F.coalesce(F.col("shard").cast("string"), F.lit(""))).alias("scope"),
        "code", "event_count", "subject_count", "is_masked",
    )
    real = found.filter("scope <> ''")
    met = join_null_safe(judged, real, ["scope", "code"], "left")
    zero = F.lit(0).cast("bigint")
    n, m = F.coalesce("n_events", zero), F.coalesce("n_subjects", zero)
    wrong = ~(F.col("event_count").eqNullSafe(n) & F.col("subject_count").eqNullSafe(m))
    leaked = ~F.coalesce("is_masked", F.lit(False)) & (m < MASK_BELOW)
    faults = F.array_compact(F.array(F.when(wrong, "wrong"), F.when(leaked, "leaked")))
    bad = met.select("code", F.explode(faults).alias("mark")).distinct()
    return rare.unionByName(common).unionByName(bad)

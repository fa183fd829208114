"""Release rules: threshold, masked split cells, rounding, exact rare bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import only_if, round_to
from ..runtime import join_null_safe, lit_null
from .counting import SplitColumns, count_cells, union_cells

COUNTS = ("event_count", "subject_count")


def count_names(split_columns: SplitColumns) -> list[str]:
    return [*COUNTS, *(name for triple in split_columns for name in triple[1:])]


def common_rows(counts: DataFrame, min_subjects: int) -> DataFrame:
    """Rows with at least ``min_subjects`` distinct subjects (events never decide)."""
    return counts.filter(F.col("subject_count") >= min_subjects)


def rare_rows(counts: DataFrame, min_subjects: int) -> DataFrame:
    return counts.filter(F.col("subject_count") < min_subjects)


def mask_split_cells(frame: DataFrame, split_columns: SplitColumns, min_subjects: int) -> DataFrame:
    """Null out both values of a split cell below ``min_subjects``; 1 changes nothing."""
    if min_subjects == 1 or not split_columns:
        return frame
    masked = {}
    for _, events_name, subjects_name in split_columns:
        enough = F.col(f"`{subjects_name}`") >= min_subjects
        masked |= {n: only_if(enough, F.col(f"`{n}`")) for n in (events_name, subjects_name)}
    return frame.withColumns(masked)


def round_counts(frame: DataFrame, multiple: int | None, names: Sequence[str] = COUNTS) -> DataFrame:
    """Round released counts; always after thresholds."""
    return frame.withColumns({n: round_to(F.col(f"`{n}`"), multiple) for n in names})


def rare_bucket(
    cells: DataFrame,
    rare_keys: DataFrame,
    scope: Sequence[str],
    keys: Sequence[str],
    split_columns: SplitColumns,
    min_subjects: int,
    min_split_subjects: int = 1,
) -> DataFrame:
    """One row per scope for all rare keys: subjects are the exact union, not a sum.

    The bucket itself is released only with ``min_subjects`` subjects.
    """
    rare_cells = join_null_safe(cells, rare_keys, list(keys), "left_semi")
    bucket = count_cells(union_cells(rare_cells, scope, split_columns), scope, split_columns)
    return mask_split_cells(common_rows(bucket, min_subjects), split_columns, min_split_subjects)


def label_bucket(bucket: DataFrame, metadata: DataFrame, label: str) -> DataFrame:
    """Bucket rows in the shape of released rows: ``code`` is the label, other metadata null."""
    labels = {
        f.name: F.lit(label) if f.name == "code" else lit_null(f.dataType.simpleString()) for f in metadata.schema
    }
    return bucket.withColumns(labels).withColumn("is_masked", F.lit(True))

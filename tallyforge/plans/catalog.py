"""The catalog pipeline: counts, privacy, metadata, optional enrichment, one file."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SummaryConfig
from ..functions import split_column_names
from ..operators import counting, privacy
from ..operators.enrichment import enrich_metadata
from ..runtime import Stash, join_null_safe, session
from ..sources import meds, tables

RESERVED = ("event_count", "subject_count", "is_masked", "split")


def _refuse(frame: DataFrame, message: str) -> None:
    if not frame.limit(1).isEmpty():
        raise ValueError(message)


@dataclass
class Catalog:
    """A catalog over any event, metadata and split frames.

    ``rows()`` is the lazy result. ``check()`` runs the policy checks, in the order of the
    pipeline, and raises ``ValueError``; ``summarize`` calls it, ad-hoc queries may skip it.
    """

    events: DataFrame
    metadata: DataFrame
    config: SummaryConfig
    modifiers: Sequence[str] = ()
    splits: DataFrame | None = None
    split_columns: list[tuple[str, str, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        config = self.config
        self.keys = ["code", *self.modifiers]
        self.scope = ["split"] if config.per_split else []
        self.count_keys = [*self.scope, *self.keys]
        if config.per_split or config.split_columns:
            if self.splits is None:
                raise ValueError("split modes need subject splits")
            if config.split_columns and not self.split_columns:
                # the names become columns, so the driver has to know them all
                found = self.splits.select("split").distinct().orderBy("split").collect()
                if not found:
                    raise ValueError("subject_splits contains no splits")
                self.split_columns = split_column_names([r[0] for r in found])
            self.cells = counting.split_cells(self.events, self.count_keys, self.splits, self.split_columns)
        else:
            self.cells = counting.subject_cells(self.events, self.count_keys)
        self.bind()

    def stored(self) -> Catalog:
        """The same catalog with its cells written once to the shared folder, so that no later plan reads events again."""
        self.stash = Stash(self.events.sparkSession)
        self.cells, _ = self.stash.put(self.cells)
        self.bind()
        return self

    def release(self) -> None:
        """Delete the stored cells."""
        self.stash.drop(self.cells)

    def bind(self) -> None:
        """Build the plans that hang on ``cells``."""
        config = self.config
        self.counts = counting.count_cells(self.cells, self.count_keys, self.split_columns)
        common = privacy.common_rows(self.counts, config.min_subjects)
        self.common = privacy.mask_split_cells(common, self.split_columns, config.min_split_subjects)
        names = [*self.metadata.columns]
        if lacking := sorted(set(self.modifiers) - set(names)):
            raise ValueError(f"Code metadata is missing declared modifiers: {lacking}")
        taken = {*RESERVED, *privacy.count_names(self.split_columns)} & set(names)
        if taken:
            raise ValueError(f"Code metadata uses reserved output columns: {sorted(taken)}")
        released = self.common.select(*[F.col(f"`{k}`") for k in self.keys]).distinct()
        self.released_metadata = join_null_safe(self.metadata, released, self.keys, "left_semi")

    def check(self) -> None:
        config = self.config
        if self.counts.limit(1).isEmpty():
            raise ValueError("MEDS data contains no events")
        if self.splits is not None and (config.per_split or config.split_columns):
            _refuse(counting.duplicate_keys(self.splits, ["subject_id"]), "subject_splits contains duplicate subject IDs")
            missing = F.col("split").isNull() if config.per_split else F.col("_missing_split_count") > 0
            _refuse(self.counts.filter(missing), "subject_splits does not cover every event subject")
        _refuse(
            counting.duplicate_keys(self.released_metadata, self.keys), f"Code metadata keys are not unique: {self.keys}"
        )
        if config.rare_code_action == "bucket":
            label = F.col("code") == config.rare_code_label
            for frame in (self.released_metadata, self.common):  # also a released code without metadata
                _refuse(frame.filter(label), f"rare_code_label already exists: {config.rare_code_label!r}")

    def rows(self) -> DataFrame:
        """Released rows and, in bucket mode, the rare rows; enriched if configured."""
        config, names = self.config, privacy.count_names(self.split_columns)
        columns = [F.col(f"`{c}`") for c in [*self.scope, *self.metadata.columns, *names, "is_masked"]]

        def finish(frame: DataFrame) -> DataFrame:
            return privacy.round_counts(frame, config.round_counts_to, names).select(*columns)

        released = join_null_safe(self.common, self.released_metadata, self.keys, "left")
        result = finish(released.withColumn("is_masked", F.lit(False)))
        if config.rare_code_action == "bucket":
            rare = privacy.rare_rows(self.counts, config.min_subjects).select(*[F.col(f"`{k}`") for k in self.count_keys])
            bucket = privacy.rare_bucket(
                self.cells, rare, self.scope, self.count_keys, self.split_columns, config.min_subjects, config.min_split_subjects
            )
            result = result.unionByName(finish(privacy.label_bucket(bucket, self.metadata, config.rare_code_label)))
        return enrich_metadata(result, config.enrichment) if config.enrichment else result


def summarize(
    root: str | Path, output: str | Path, config: SummaryConfig | None = None, spark: SparkSession | None = None
) -> Path:
    """Write the catalog of a MEDS dataset as one file and return its path.

    One pass over the events; the cells are kept for the checks, the counts and the rare
    bucket. The old output stays byte by byte if anything fails.
    """
    config = config or SummaryConfig()
    spark = session(spark)
    root = meds.dataset_root(root)
    output = Path(output).expanduser().resolve()
    kind = tables.output_format(output)
    if any(output.is_relative_to(root / name) for name in ("data", "metadata")):
        raise ValueError("output must not overwrite MEDS data or metadata")
    output.parent.mkdir(parents=True, exist_ok=True)
    modifiers = meds.code_modifier_columns(meds.read_dataset_metadata(root))
    before = {k: spark.conf.get(k) for k in ("spark.sql.caseSensitive", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.caseSensitive", "true")
    spark.conf.set("spark.sql.shuffle.partitions", str(config.partitions))
    try:
        metadata = meds.scan_code_metadata(root, spark)
        events = meds.scan_events(root, modifiers, spark)
        splits = meds.scan_subject_splits(root, spark) if config.per_split or config.split_columns else None
        catalog = Catalog(events, metadata, config, modifiers, splits).stored()
        catalog.check()
        with tables.replacing(output) as staged:
            tables.sink_table(catalog.rows(), staged, kind, order=[*catalog.scope, *catalog.keys])
        catalog.release()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return output

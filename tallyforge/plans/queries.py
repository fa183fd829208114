"""The driver's queries for the catalog and vocabulary operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..config import EnrichmentConfig, SummaryConfig
from ..operators import counting, coverage, enrichment, privacy, vocabulary
from ..runtime import join_null_safe, table
from ..sources import tables
from ..sources.tables import flatten_nested
from . import bridge, files
from .catalog import Catalog, summarize
from .enrich_file import enrich_file

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
ENRICH = EnrichmentConfig(csv_dir="unused", child_codes=True, sibling_codes=True)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[make.__name__] = make
    return make


def _flat(frame: DataFrame) -> DataFrame:
    """Lists as text, which any result comparison can read."""
    return flatten_nested(frame)


def _rows(*args, **options) -> DataFrame:
    """Rows of a catalog whose cells are stored once, as ``summarize`` does."""
    return Catalog(*args, **options).stored().rows()


def _no_metadata(spark: SparkSession, *modifiers: str) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in ("code", *modifiers)))


@query
def code_counts(spark, folder):
    return counting.code_occurrences(bridge.stream_events(spark, folder), ["code"])


@query
def code_counts_modifiers(spark, folder):
    return counting.code_occurrences(bridge.med_events(spark, folder), ["code", "modifier"])


@query
def code_counts_splits(spark, folder):
    events, splits = bridge.med_events(spark, folder), bridge.subject_splits(spark, folder)
    return counting.code_occurrences(events, ["code"], ["train", "held_out", "no such split"], splits)


@query
def summary_bucket(spark, folder):
    return _rows(bridge.stream_events(spark, folder), _no_metadata(spark), SummaryConfig())


@query
def summary_drop(spark, folder):
    config = SummaryConfig(min_subjects=30, rare_code_action="drop")
    return _rows(bridge.order_events(spark, folder), _no_metadata(spark), config)


@query
def summary_rounded(spark, folder):
    config = SummaryConfig(min_subjects=30, round_counts_to=10, rare_code_label="OTHER")
    return _rows(bridge.order_events(spark, folder), _no_metadata(spark), config)


@query
def summary_modifiers(spark, folder):
    return _rows(bridge.brand_events(spark, folder), _no_metadata(spark, "modifier"), SummaryConfig(min_subjects=120), ["modifier"])


@query
def summary_null_modifiers(spark, folder):
    metadata = bridge.med_metadata(spark, folder)
    return _flat(_rows(bridge.med_events(spark, folder), metadata, SummaryConfig(min_subjects=10), ["modifier"]))


@query
def summary_long(spark, folder):
    config = SummaryConfig(per_split=True, min_subjects=6)
    return _rows(bridge.order_events(spark, folder), _no_metadata(spark), config, splits=bridge.segments(spark, folder))


def _wide(spark, folder, min_split):
    config = SummaryConfig(split_columns=True, min_subjects=30, min_split_subjects=min_split)
    return _rows(bridge.order_events(spark, folder), _no_metadata(spark), config, splits=bridge.segments(spark, folder))


@query
def summary_wide(spark, folder):
    return _wide(spark, folder, 1)


@query
def summary_wide_masked(spark, folder):
    return _wide(spark, folder, 7)


@query
def split_missing(spark, folder):
    events, splits = bridge.med_events(spark, folder), bridge.subject_splits(spark, folder)
    counts = counting.code_occurrences(events, ["code"], ["train"], splits)
    return counts.filter("_missing_split_count > 0").select("code", "_missing_split_count")


@query
def metadata_join(spark, folder):
    return _flat(_rows(bridge.order_events(spark, folder), bridge.part_metadata(spark, folder), SummaryConfig(min_subjects=30)))


@query
def metadata_semijoin(spark, folder):
    metadata = bridge.med_metadata(spark, folder)
    catalog = Catalog(bridge.med_events(spark, folder), metadata, SummaryConfig(min_subjects=10), ["modifier"]).stored()
    return catalog.released_metadata.select("code", "modifier", "entry_id")


@query
def dup_key_check(spark, folder):
    return counting.duplicate_keys(table(spark, folder, "codes"), ["code", "modifier"])


@query
def dup_split_check(spark, folder):
    return counting.duplicate_keys(table(spark, folder, "subject_splits"), ["subject_id"])


@query
def rare_keys_events(spark, folder):
    catalog = Catalog(bridge.med_events(spark, folder), _no_metadata(spark, "modifier"), SummaryConfig(), ["modifier"]).stored()
    rare = privacy.rare_rows(catalog.counts, 20).select("code", "modifier")
    cells = join_null_safe(catalog.cells, rare, ["code", "modifier"], "left_semi")
    return counting.union_cells(cells, []).select("subject_id", F.col("__n").alias("rare_events"))


@query
def split_names(spark, folder):
    suffix = fn.split_suffix(F.col("split"))
    return table(spark, folder, "subject_splits").select(
        "split",
        F.concat(F.lit("event_count_"), suffix).alias("event_column"),
        F.concat(F.lit("subject_count_"), suffix).alias("subject_column"),
    ).distinct()


def _codes(spark, folder):
    return table(spark, folder, "codes").select("code", "description", "parent_codes")


@query
def candidates(spark, folder):
    return vocabulary.code_candidates(_codes(spark, folder))


@query
def concept_match(spark, folder):
    return vocabulary.best_matches(vocabulary.code_candidates(_codes(spark, folder)), bridge.concepts(spark, folder))


@query
def hierarchy_clean(spark, folder):
    return vocabulary.clean_hierarchy(bridge.ancestors(spark, folder))


def _related(spark, folder, make):
    found = bridge.concepts(spark, folder)
    ids = found.select("concept_id").distinct()
    return _flat(make(ids, vocabulary.clean_hierarchy(bridge.ancestors(spark, folder)), found))


@query
def parents(spark, folder):
    return _related(spark, folder, vocabulary.parents)


@query
def children_depth(spark, folder):
    return _related(spark, folder, lambda ids, edges, found: vocabulary.children(ids, edges, found, 2))


@query
def siblings(spark, folder):
    return _related(spark, folder, vocabulary.siblings)


@query
def enrich_merge(spark, folder):
    frame = table(spark, folder, "codes").select("entry_id", "code", "description", "parent_codes")
    return _flat(enrichment.enrich_with(frame, bridge.concepts(spark, folder), bridge.ancestors(spark, folder), ENRICH))


@query
def catalog_enriched(spark, folder):
    rows = _rows(bridge.med_events(spark, folder), bridge.med_metadata(spark, folder), SummaryConfig(min_subjects=10), ["modifier"])
    return _flat(enrichment.enrich_with(rows, bridge.concepts(spark, folder), bridge.ancestors(spark, folder), ENRICH))


@query
def coverage_report(spark, folder):
    frame = table(spark, folder, "codes").select("entry_id", "code", "description", "parent_codes")
    made = enrichment.enrich_with(frame, bridge.concepts(spark, folder), bridge.ancestors(spark, folder), ENRICH)
    before, after = coverage.coverage(frame), coverage.coverage(made)
    return before.select(F.lit("before").alias("state"), "*").unionByName(after.select(F.lit("after").alias("state"), "*"))


@query
def csv_flatten(spark, folder):
    codes = table(spark, folder, "codes")
    return _flat(codes.select("entry_id", "parent_codes", F.struct(F.col("entry_id").alias("id"), F.col("code").alias("c")).alias("nested")))


@query
def list_functions(spark, folder):
    frame = table(spark, folder, "codes")
    parents_ = F.col("parent_codes")
    return _flat(
        frame.select(
            "entry_id",
            F.transform(parents_, fn.double_slash).alias("doubled"),
            fn.without_first(parents_).alias("rest"),
            fn.merge_lists(parents_, F.array("code", F.lit("X//1"))).alias("merged"),
            F.size(fn.non_empty(parents_)).alias("n_non_empty"),
            fn.part(F.array_compact(parents_), 0).alias("first_reference"),
            fn.part(fn.reference_parts(fn.part(parents_, 0)), 1).alias("second_part"),
        )
    )


@query
def split_cell_mask(spark, folder):
    wide = fn.split_column_names(SEGMENTS)
    counts = counting.code_occurrences(bridge.brand_events(spark, folder), ["code", "modifier"], SEGMENTS, bridge.segments(spark, folder))
    return privacy.round_counts(privacy.mask_split_cells(counts, wide, 20), 5, privacy.count_names(wide)).drop("_missing_split_count")


def _read_back(path, spark):
    """The rows of a written file with their place in it."""
    return _flat(tables.scan_table(path, spark).coalesce(1).withColumn("place", F.monotonically_increasing_id()))


def _summarized(suffix):
    def run(spark, folder):
        root = files.dataset(spark, folder)
        config = SummaryConfig(min_subjects=10, split_columns=True, min_split_subjects=6, round_counts_to=5)
        return _read_back(summarize(root, root / f"catalog{suffix}", config, spark), spark)

    return run


def _enriched_file(suffix):
    def run(spark, folder):
        root = files.vocabulary(spark, folder)
        tables.sink_table(table(spark, folder, "codes").select("entry_id", "code", "description", "parent_codes"), root / f"in{suffix}", order=["entry_id"])
        config = replace(ENRICH, csv_dir=root)
        return _read_back(enrich_file(root / f"in{suffix}", root / f"out{suffix}", config, spark=spark), spark)

    return run


QUERIES |= {f"summarize_{s}": _summarized(f".{s}") for s in ("parquet", "csv", "json", "jsonl")}
QUERIES |= {f"enrich_file_{s}": _enriched_file(f".{s}") for s in ("parquet", "csv", "ndjson")}

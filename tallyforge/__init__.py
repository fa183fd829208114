"""Privacy-aware code catalogs and large-scale event processing on Spark."""

import sys

from pyspark import cloudpickle

from .config import EnrichmentConfig, SummaryConfig
from .operators.counting import code_occurrences
from .operators.enrichment import enrich_metadata
from .plans.catalog import summarize
from .plans.enrich_file import enrich_file
from .sources.meds import (
    code_modifier_columns,
    dataset_root,
    event_files,
    read_dataset_metadata,
    scan_code_metadata,
    scan_events,
    scan_subject_splits,
)

# Functions for Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "EnrichmentConfig",
    "SummaryConfig",
    "code_modifier_columns",
    "code_occurrences",
    "dataset_root",
    "enrich_file",
    "enrich_metadata",
    "event_files",
    "read_dataset_metadata",
    "scan_code_metadata",
    "scan_events",
    "scan_subject_splits",
    "summarize",
]

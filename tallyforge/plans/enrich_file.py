"""Standalone enrichment of a metadata or catalog file."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import EnrichmentConfig
from ..operators.coverage import coverage, report
from ..operators.enrichment import enrich_metadata
from ..runtime import session
from ..sources import tables

_ORDER = "__row_order"


class _Progress:
    """One line on stderr: ``label: k/4``."""

    def __init__(self, show: bool, total: int = 4):
        self.show, self.total, self.done = show, total, 0

    def step(self, label: str) -> None:
        self.done += 1
        if self.show:
            end = "\n" if self.done == self.total else ""
            print(f"\r{label}: {self.done}/{self.total}", end=end, file=sys.stderr, flush=True)


def enrich_file(
    input_path: str | Path,
    output_path: str | Path,
    config: EnrichmentConfig,
    *,
    verbose: bool = False,
    spark: SparkSession | None = None,
) -> Path:
    """Enrich a table into another file, rows in the input's order, replaced atomically.

    ``verbose`` shows four stages on stderr and prints a coverage report.
    """
    spark = session(spark)
    source_path, target = (Path(p).expanduser().resolve() for p in (input_path, output_path))
    if source_path == target:
        raise ValueError("standalone enrichment output must differ from its input")
    kind = tables.output_format(target)
    target.parent.mkdir(parents=True, exist_ok=True)
    progress = _Progress(verbose)
    source = tables.scan_table(source_path, spark)
    progress.step("Reading input")
    numbered = source.withColumn(_ORDER, F.monotonically_increasing_id())
    enriched = enrich_metadata(numbered, config)
    progress.step("Querying vocabulary")
    with tables.replacing(target) as staged:
        tables.sink_table(enriched, staged, kind, order=[_ORDER], hidden=[_ORDER])
    progress.step("Writing output")
    text = ""
    if verbose:
        before, after = (
            coverage(frame).first().asDict() for frame in (source, tables.scan_table(target, spark))
        )
        text = report(before, after)
    progress.step("Calculating coverage")
    if verbose:
        print(text)
    return target

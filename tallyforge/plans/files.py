"""The driver's tables as files on disk: an event dataset and a vocabulary export.

They lie in the shared folder, which must be a mounted one, and go when the JVM ends.
"""

from __future__ import annotations

import json
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Stash, table
from ..sources import tables
from . import bridge


def _folder(spark: SparkSession) -> Path:
    made = Path(Stash(spark).base.removeprefix("file://").removeprefix("file:"))
    made.mkdir(parents=True)
    return made


def dataset(spark: SparkSession, folder: str) -> Path:
    """``med_events``, ``codes`` and ``subject_splits`` as a sharded dataset with one modifier."""
    root = _folder(spark)
    (root / "metadata").mkdir()
    table(spark, folder, "med_events").select("subject_id", "time", "code", "modifier").write.parquet(str(root / "data"))
    tables.sink_table(bridge.med_metadata(spark, folder), root / "metadata" / "codes.parquet")
    splits = table(spark, folder, "med_events").select("subject_id").distinct()
    known = bridge.subject_splits(spark, folder)
    splits = splits.join(known, "subject_id", "left").withColumn("split", F.coalesce(F.trim("split"), F.lit("none")))
    tables.sink_table(splits.replace({"TRAIN": "train", "held-out": "held_out"}, subset="split"), root / "metadata" / "subject_splits.parquet")
    described = {"dataset_name": "med", "code_modifier_columns": ["modifier"]}
    (root / "metadata" / "dataset.json").write_text(json.dumps(described))
    return root


def _export(frame: DataFrame, path: Path) -> None:
    """One tab-separated file with a header and no quoting."""
    parts = path.with_name(path.name + ".parts")
    frame.coalesce(1).write.options(sep="\t", header=True, quote="", emptyValue="", nullValue="").csv(str(parts))
    shutil.move(next(parts.glob("part-*")), path)
    shutil.rmtree(parts)


def vocabulary(spark: SparkSession, folder: str) -> Path:
    """``concept`` and ``concept_ancestor`` as tab-separated files."""
    root = _folder(spark)
    _export(table(spark, folder, "concept"), root / "CONCEPT.csv")
    _export(bridge.ancestors(spark, folder), root / "CONCEPT_ANCESTOR.csv")
    return root

import json
import os
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


EVENTS = [
    [(1, "A", "main"), (1, "B", "x"), (2, "A", "main"), (2, "B", "x")],
    [(3, "A", "main"), (2, "C", "z"), (3, "C", "z")],
]


def write_dataset(root, text=pa.string(), list_=pa.list_, codes=None, splits=None):
    (root / "data").mkdir(parents=True, exist_ok=True)
    (root / "metadata").mkdir(exist_ok=True)
    from datetime import datetime

    for i, shard in enumerate(EVENTS):
        table = pa.table(
            {
                "subject_id": pa.array([r[0] for r in shard], pa.int64()),
                "time": pa.array([datetime(2020, 1, 1)] * len(shard), pa.timestamp("us")),
                "code": pa.array([r[1] for r in shard], text),
                "modifier": pa.array([r[2] for r in shard], text),
            }
        )
        pq.write_table(table, root / "data" / f"{i}.parquet")
    codes = codes or [("A", "main", "Common code"), ("B", "x", "Rare B"), ("C", "z", "Rare C")]
    table = pa.table(
        {
            "code": pa.array([c[0] for c in codes], text),
            "modifier": pa.array([c[1] for c in codes], text),
            "description": pa.array([c[2] for c in codes], text),
            "parent_codes": pa.array([["ROOT"]] * len(codes), list_(text)),
        }
    )
    pq.write_table(table, root / "metadata" / "codes.parquet")
    splits = splits or {"subject_id": pa.array([1, 2, 3], pa.int64()), "split": pa.array(["train", "train", "held_out"], text)}
    pq.write_table(pa.table(splits), root / "metadata" / "subject_splits.parquet")
    (root / "metadata" / "dataset.json").write_text(
        json.dumps({"dataset_name": "synthetic", "meds_version": "0.4.1", "code_modifier_columns": ["modifier"]})
    )
    return root


@pytest.fixture
def dataset(tmp_path):
    return write_dataset(tmp_path / "meds")

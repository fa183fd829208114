import csv
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyforge import EnrichmentConfig, SummaryConfig, code_occurrences, summarize
from tallyforge.streaming import counts_so_far, stream_cells

from .conftest import write_dataset


def run(spark, dataset, tmp_path, name="out.parquet", **options):
    path = summarize(dataset, tmp_path / name, SummaryConfig(partitions=3, **options), spark)
    return path, (pq.read_table(path).to_pylist() if name.endswith("parquet") else None)


def test_bucket_holds_the_union(spark, dataset, tmp_path):
    _, rows = run(spark, dataset, tmp_path, min_subjects=3)
    assert [r["code"] for r in rows] == ["A", "__RARE__"]
    a, rare = rows
    assert (a["event_count"], a["subject_count"], a["is_masked"]) == (3, 3, False)
    assert (a["description"], a["parent_codes"], a["modifier"]) == ("Common code", ["ROOT"], "main")
    assert (rare["event_count"], rare["subject_count"], rare["is_masked"]) == (4, 3, True)
    assert rare["description"] is rare["modifier"] is rare["parent_codes"] is None
    assert list(a) == ["code", "modifier", "description", "parent_codes", "event_count", "subject_count", "is_masked"]


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_shuffle_width_changes_nothing(spark, dataset, tmp_path, partitions):
    config = SummaryConfig(partitions=partitions, min_subjects=2)
    rows = pq.read_table(summarize(dataset, tmp_path / "w.parquet", config, spark)).to_pylist()
    assert [(r["code"], r["event_count"], r["subject_count"]) for r in rows] == [("A", 3, 3), ("B", 2, 2), ("C", 2, 2)]


def test_drop_and_round(spark, dataset, tmp_path):
    _, rows = run(spark, dataset, tmp_path, min_subjects=3, rare_code_action="drop", round_counts_to=5)
    assert [(r["code"], r["event_count"], r["subject_count"]) for r in rows] == [("A", 5, 5)]


def test_long_mode_counts_each_split(spark, dataset, tmp_path):
    _, rows = run(spark, dataset, tmp_path, per_split=True, min_subjects=2)
    assert [(r["split"], r["code"], r["is_masked"]) for r in rows] == [("train", "A", False), ("train", "B", False)]
    assert list(rows[0])[0] == "split"


def test_wide_mode_masks_small_cells(spark, dataset, tmp_path):
    _, rows = run(spark, dataset, tmp_path, split_columns=True, min_subjects=2, min_split_subjects=2)
    by = {r["code"]: r for r in rows}
    cell = lambda c, s: (by[c][f"event_count_{s}"], by[c][f"subject_count_{s}"])
    assert by["A"]["event_count"] == 3
    assert cell("A", "train") == (2, 2)
    assert cell("A", "held_out") == (None, None)
    assert by["B"]["event_count_train"] == 2
    assert cell("C", "train") == cell("C", "held_out") == (None, None)


def test_one_file_of_nested_columns_in_order(spark, tmp_path):
    from tallyforge.sources.tables import scan_table, sink_table

    frame = spark.sql(
        "select * from values (2, array('a', null, 'b'), named_struct('x', 1, 'y', 'q\"r'), array(named_struct('z', 1)), map('k', 1)),"
        " (1, array(), null, null, null), (3, null, null, null, null) as t(id, items, one, many, pairs)"
    )
    path = tmp_path / "nested.csv"
    sink_table(frame.withColumn("o", -frame.id), path, order=["o"], hidden=["o"])
    with path.open() as file:
        rows = list(csv.DictReader(file))
    assert [r["id"] for r in rows] == ["3", "2", "1"]
    assert rows[1] == {"id": "2", "items": "a|b", "one": '{"x":1,"y":"q\\"r"}', "many": '{"z":1}', "pairs": '{"k":1}'}
    sink_table(frame.limit(0), tmp_path / "none.json")
    assert json.loads((tmp_path / "none.json").read_text()) == []
    sink_table(frame.select("id", "one"), tmp_path / "some.parquet", order=["id"])
    assert [r.id for r in scan_table(tmp_path / "some.parquet", spark).collect()] == [1, 2, 3]
    with pytest.raises(FileNotFoundError, match="table not found"):
        scan_table(tmp_path / "absent.csv", spark)


@pytest.mark.parametrize("suffix", [".csv", ".json", ".jsonl", ".NDJSON"])
def test_text_outputs(spark, dataset, tmp_path, suffix):
    path, _ = run(spark, dataset, tmp_path, f"out{suffix}", min_subjects=3)
    if suffix == ".csv":
        with path.open() as file:
            rows = list(csv.DictReader(file))
        assert rows[0]["parent_codes"] == "ROOT"
    else:
        text = path.read_text()
        rows = json.loads(text) if suffix == ".json" else [json.loads(x) for x in text.splitlines()]
        assert rows[0]["parent_codes"] == ["ROOT"]
        assert rows[1]["description"] is None
    assert [r["code"] for r in rows] == ["A", "__RARE__"]
    assert sum(int(r["event_count"]) for r in rows) == 7
    assert [p.name for p in tmp_path.iterdir() if "parts" in p.name or p.name.startswith(".")] == []


def test_large_offsets_are_accepted(spark, tmp_path):
    root = write_dataset(tmp_path / "large", pa.large_string(), pa.large_list)
    _, rows = run(spark, root, tmp_path, min_subjects=3)
    assert [r["code"] for r in rows] == ["A", "__RARE__"]


def test_extra_split_columns_are_ignored_and_types_checked(spark, tmp_path):
    ids = pa.array([1, 2, 3], pa.int64())
    root = write_dataset(tmp_path / "a", splits={"subject_id": ids, "split": ["t", "t", "h"], "other": [1.0, 2.0, 3.0]})
    assert run(spark, root, tmp_path, split_columns=True, min_subjects=1)[1][0]["event_count_t"] == 2
    root = write_dataset(tmp_path / "b", splits={"subject_id": ids, "split": pa.array([1, 2, 3])})
    with pytest.raises(ValueError, match="subject_splits.parquet.*incorrect types"):
        run(spark, root, tmp_path, per_split=True)


def test_duplicate_metadata_matters_only_for_released_codes(spark, tmp_path):
    unused = [("A", "main", "x"), ("D", "q", "1"), ("D", "q", "2")]
    root = write_dataset(tmp_path / "unused", codes=unused)
    assert run(spark, root, tmp_path, min_subjects=3)[1][0]["code"] == "A"
    root = write_dataset(tmp_path / "used", codes=[("A", "main", "x"), ("A", "main", "y")])
    kept = tmp_path / "kept.parquet"
    kept.write_bytes(b"old")
    with pytest.raises(ValueError, match="not unique"):
        summarize(root, kept, SummaryConfig(min_subjects=3), spark)
    assert kept.read_bytes() == b"old"
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".")]


def test_refusals(spark, dataset, tmp_path):
    with pytest.raises(ValueError, match="must not overwrite"):
        summarize(dataset, dataset / "metadata" / "x.parquet", spark=spark)
    with pytest.raises(ValueError, match="unsupported output suffix"):
        summarize(dataset, tmp_path / "x.xlsx", spark=spark)
    with pytest.raises(FileNotFoundError, match="MEDS directory not found"):
        summarize(tmp_path, tmp_path / "x.csv", spark=spark)
    with pytest.raises(ValueError, match="rare_code_label already exists"):
        run(spark, dataset, tmp_path, min_subjects=3, rare_code_label="A")


def test_splits_must_cover_and_be_unique(spark, tmp_path):
    few = {"subject_id": pa.array([1, 2], pa.int64()), "split": ["t", "t"]}
    for mode in ("per_split", "split_columns"):
        with pytest.raises(ValueError, match="does not cover every event subject"):
            run(spark, write_dataset(tmp_path / mode, splits=few), tmp_path, **{mode: True})
    twice = {"subject_id": pa.array([1, 2, 3, 3], pa.int64()), "split": ["t", "t", "t", "h"]}
    with pytest.raises(ValueError, match="duplicate subject"):
        run(spark, write_dataset(tmp_path / "twice", splits=twice), tmp_path, per_split=True)
    alike = {"subject_id": pa.array([1, 2, 3], pa.int64()), "split": ["a b", "a-b", "c"]}
    with pytest.raises(ValueError, match="duplicate output columns"):
        run(spark, write_dataset(tmp_path / "alike", splits=alike), tmp_path, split_columns=True)


def test_null_modifiers_join_and_missing_metadata_is_kept(spark):
    from tallyforge.plans.catalog import Catalog

    events = spark.createDataFrame(
        [(1, "A", None), (2, "A", None), (3, "A", "m"), (1, "Z", None), (2, "Z", None), (None, "Z", None)],
        "subject_id long, code string, modifier string",
    )
    meta = spark.createDataFrame([("A", None, "none"), ("A", "m", "with")], "code string, modifier string, description string")
    rows = Catalog(events, meta, SummaryConfig(min_subjects=2), ["modifier"]).rows().collect()
    found = {(r.code, r.modifier): (r.description, r.event_count, r.subject_count) for r in rows}
    assert found == {("A", None): ("none", 2, 2), ("Z", None): (None, 3, 3)}
    empty = Catalog(events.limit(0), meta, SummaryConfig(min_subjects=2), ["modifier"])
    assert empty.rows().count() == 0
    with pytest.raises(ValueError, match="no events"):
        empty.check()


def test_occurrences_and_union_bounds(spark, dataset):
    from tallyforge import scan_events
    from tallyforge.sources.meds import event_files

    events = scan_events(dataset, ["modifier"], spark)
    rows = {r.code: r for r in code_occurrences(events, ["code"]).collect()}
    assert {c: (r.event_count, r.subject_count) for c, r in rows.items()} == {"A": (3, 3), "B": (2, 2), "C": (2, 2)}
    from pyspark.sql import functions as F

    split = events.withColumn("split", F.when(F.col("subject_id") < 3, "t"))
    rows = {r.code: r for r in code_occurrences(split, ["code"], ["t"]).collect()}
    assert (rows["A"].event_count_t, rows["A"].subject_count_t, rows["A"]._missing_split_count) == (2, 2, 1)
    (event_files(dataset)[0]).rename(dataset / "data" / "_0.parquet")
    with pytest.raises(ValueError, match="would skip"):
        scan_events(dataset, (), spark)


def test_stream_equals_batch(spark, dataset, tmp_path):
    from tallyforge import scan_events

    batch = scan_events(dataset, ["modifier"], spark)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(dataset / "data"))
    stream_cells(stream, ["code"], str(tmp_path / "cells"), str(tmp_path / "state")).awaitTermination(60)
    cells = spark.read.parquet(str(tmp_path / "cells")).drop("batch")
    assert sorted(counts_so_far(cells, ["code"]).collect()) == sorted(code_occurrences(batch, ["code"]).collect())


def test_masked_rows_are_never_enriched(spark, tmp_path):
    from .test_enrich import write_vocabulary

    root = write_dataset(tmp_path / "m", codes=[("Kind of Visit//07", "main", None)])
    for shard in (root / "data").iterdir():
        table = pq.read_table(shard)
        codes = ["Kind of Visit//07" if c == "A" else c for c in table["code"].to_pylist()]
        pq.write_table(table.set_column(2, "code", pa.array(codes)), shard)
    config = SummaryConfig(
        min_subjects=3, rare_code_label="ICX//2031//W7", enrichment=EnrichmentConfig(csv_dir=write_vocabulary(tmp_path))
    )
    rows = pq.read_table(summarize(root, tmp_path / "e.parquet", config, spark)).to_pylist()
    assert {r["is_masked"]: r["concept_id"] for r in rows} == {False: 60, True: None}

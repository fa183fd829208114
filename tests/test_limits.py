"""Values, names and keys beyond any size a plan might have in mind; folders; hot keys."""

import random
from collections import Counter, defaultdict
from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyforge import runtime
from tallyforge.config import SummaryConfig
from tallyforge.operators import counting, features
from tallyforge.plans.catalog import Catalog
from tallyforge.sources import tables


def test_large_amounts_are_counted(spark):
    day = datetime(2020, 1, 1)
    rows = [(1, 7, "A", day, 1e16), (2, 7, "A", day, 0.25), (3, 7, "B", day, float("inf")), (4, 7, "B", day, None)]
    events = spark.createDataFrame(rows, "event_id long, subject_id long, code string, time timestamp_ntz, numeric_value double")
    cohort = spark.createDataFrame([(7, datetime(2020, 1, 3, 5))], "subject_id long, index_time timestamp_ntz")
    types = spark.createDataFrame([(1, "A"), (2, "B")], "feature_no int, code string")
    found = {r["code"]: tuple(r)[2:] for r in features.feature_rows(events, cohort, types).collect()}
    assert found == {"A": (2, 2, 10**18 + 25), "B": (2, 2, 0)}


def test_more_than_a_thousand_split_columns(spark):
    n = 1100
    events = spark.range(n).select(F.col("id").alias("subject_id"), F.lit("A").alias("code"))
    splits = spark.range(n).select(F.col("id").alias("subject_id"), F.concat(F.lit("s"), "id").alias("split"))
    metadata = spark.createDataFrame([], "code string")
    catalog = Catalog(events, metadata, SummaryConfig(split_columns=True, min_subjects=1), splits=splits)
    assert len(catalog.split_columns) == n
    assert {"event_count_s0", "subject_count_s1099"} <= set(catalog.rows().columns)


def test_csv_cells_pass_unchanged(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('code,at,day,n,flag,blank,none\n02,2020-01-02 10:00:00,2020-01-02,5,true,"", \n" x ",2020-01-02T10:00:00Z,03/04/2020,,false,"",\n')
    frame = tables.scan_table(path, spark)
    assert dict(frame.dtypes) | {"n": "int", "flag": "boolean", "at": "string", "day": "string"} == dict(frame.dtypes)
    rows = [tuple(r) for r in frame.collect()]
    assert rows == [
        ("02", "2020-01-02 10:00:00", "2020-01-02", 5, True, "", " "),
        (" x ", "2020-01-02T10:00:00Z", "03/04/2020", None, False, "", None),
    ]
    tables.sink_table(frame, tmp_path / "u.csv")
    assert [tuple(r) for r in tables.scan_table(tmp_path / "u.csv", spark).collect()] == rows


def test_shared_folder_is_needed_on_a_cluster():
    unset = SimpleNamespace(isDefined=lambda: False)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            runtime.shared_folder(session)


def test_stash_finds_its_tables_by_path(spark):
    stash = runtime.Stash(spark)
    one, n = stash.put(spark.range(5))
    two, m = stash.put(spark.range(5, 8))
    assert (n, m) == (5, 3)
    assert sorted(r.id for r in stash.together([one, two]).collect()) == list(range(8))
    stash.drop(one)
    assert sorted(r.id for r in stash.together([two]).collect()) == [5, 6, 7]
    assert len(stash.kept) == 1


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, monkeypatch, how):
    monkeypatch.setattr(runtime, "HOT_ROWS", 50)
    monkeypatch.setattr(runtime, "HOT_PARTS", 20)
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, None, rng.randint(3, 90)]), i) for i in range(3000)]
    left = spark.createDataFrame(rows, "k long, x long")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (5, "c"), (None, "d"), (200, "e")], "k long, y string")
    made = runtime.join_spread(left, right, "k", how, ["x"])
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, made.collect())) == sorted(map(key, left.join(right, "k", how).select(*made.columns).collect()))


def test_hot_key_is_spread_over_tasks(spark, monkeypatch):
    """One subject holds a third of all rows; the largest task of the join stays near the others."""
    monkeypatch.setattr(runtime, "HOT_ROWS", 500)
    left = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    right = spark.range(30_000).select(F.col("id").alias("k"), F.lit("s").alias("y"))
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        joined = runtime.join_spread(left, right, "k", "left", ["x"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 30_000 and len(sizes) == 8 and max(sizes) < 2 * 30_000 / 8


def test_cells_of_assigned_splits_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(20)]), rng.choice(["A", "B", None])) for _ in range(400)]
    splits = [(s, rng.choice(["train", "test"])) for s in range(15)] + [(3, "both")]
    events = spark.createDataFrame(rows, "subject_id long, code string")
    found = counting.code_occurrences(events, ["code"], ["train"], spark.createDataFrame(splits, "subject_id long, split string"))
    n, subjects, train, missing = Counter(), defaultdict(set), Counter(), Counter()
    for s, c in rows:
        for split in [x for k, x in splits if k == s] or [None]:
            n[c] += 1
            subjects[c].add(s)
            train[c] += split == "train"
            missing[c] += split is None
    expected = {c: (n[c], len(subjects[c]), train[c], missing[c]) for c in n}
    assert {r["code"]: (r["event_count"], r["subject_count"], r["event_count_train"], r["_missing_split_count"]) for r in found.collect()} == expected


def test_descriptor_fields_are_checked(tmp_path):
    from tallyforge.sources import meds

    for folder in ("data", "metadata"):
        (tmp_path / folder).mkdir()
    path = tmp_path / "metadata" / "dataset.json"
    path.write_text('{"dataset_name": "x", "created_at": "2024-01-02T03:04:05", "site_id_columns": ["a"], "other": 1, "license": null}')
    assert meds.read_dataset_metadata(tmp_path)["other"] == 1
    for text, said in (("[]", "object"), ('{"dataset_name": 3}', "dataset_name must be a string"), ('{"created_at": "soon"}', "ISO 8601"),
                       ('{"site_id_columns": ["a", 1]}', "list of strings")):
        path.write_text(text)
        with pytest.raises(ValueError, match=said):
            meds.read_dataset_metadata(tmp_path)
    for bad, said in ((["a", "a"], "duplicates"), (["code"], "core"), (["", "a"], "non-empty"), ("a", "list")):
        with pytest.raises(ValueError, match=said):
            meds.code_modifier_columns({"code_modifier_columns": bad})
    assert meds.code_modifier_columns({"code_modifier_columns": ["b", "a"]}) == ["b", "a"]


def test_many_footers_are_checked_by_executors(spark, dataset, monkeypatch):
    from tallyforge.sources import meds

    monkeypatch.setattr(meds, "DRIVER_FOOTERS", 1)
    assert meds.scan_events(dataset, ["modifier"], spark).count() == 7
    with pytest.raises(ValueError, match=r"modifier 'nope' is missing from .*0\.parquet"):
        meds.scan_events(dataset, ["nope"], spark)


@pytest.mark.parametrize("suffix", ["parquet", "csv", "json", "ndjson"])
def test_one_file_of_many_parts(spark, tmp_path, suffix):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = spark.range(1000).select((F.col("id") * 7 % 1000).alias("n"), F.concat(F.lit("a,\n"), F.col("id")).alias("t"))
        tables.sink_table(frame, tmp_path / f"o.{suffix}", order=["n"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert [p.name for p in tmp_path.iterdir()] == [f"o.{suffix}"]
    rows = tables.scan_table(tmp_path / f"o.{suffix}", spark).collect()
    assert sorted((r.n, r.t) for r in rows) == sorted((i * 7 % 1000, f"a,\n{i}") for i in range(1000))
    if suffix in ("parquet", "ndjson"):
        assert [r.n for r in spark.createDataFrame(rows).collect()] == list(range(1000))


def test_postgres_candidates_pass_in_chunks(spark, monkeypatch):
    from tallyforge import EnrichmentConfig
    from tallyforge.sources import postgres

    asked = []
    head = "kind,a,b,level,concept_name,domain_id,vocabulary_id,concept_code,standard_concept\n"
    monkeypatch.setattr(postgres, "CHUNK", 3)
    monkeypatch.setattr(postgres, "_ask", lambda _, script: asked.append(script) or head + f"concept,{len(asked)},,,n,d,V,c,S\nconcept,9,,,n,d,V,c,S\n")
    candidates = spark.createDataFrame([("V", f"c{i}") for i in range(8)], "vocabulary_id string, concept_code string")
    concepts, pairs = postgres.fetch(candidates, EnrichmentConfig(postgres="x", child_codes=True, child_depth=2), spark)
    assert len(asked) == 3 and sorted(r.concept_id for r in concepts.collect()) == [1, 2, 3, 9] and pairs.count() == 0
    assert "<= 2" in asked[0] and "min_levels_of_separation = 1" not in asked[0]
    assert "min_levels_of_separation = 1" in postgres.build_script([], EnrichmentConfig(postgres="x", sibling_codes=True))

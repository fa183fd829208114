"""Sketches against exact distinct counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import sketches


@pytest.mark.parametrize("n", [1, 2, 3, 10, 100, 1000, 20_000, 300_000])
def test_bounds_hold(spark, n):
    ids = spark.range(n * 3).select((F.col("id") % n).alias("id"), (F.col("id") % 2).alias("half"))
    built = sketches.build(ids, ["half"], "id")
    r = sketches.estimate(sketches.merge(built, []), []).first()
    assert r.lower <= n <= r.upper
    assert abs(r.n_distinct - n) <= max(0.5, 0.08 * n)
    if n <= 3:
        assert r.n_distinct == n


def test_error_is_as_stated(spark):
    groups = spark.range(200 * 5000).select((F.col("id") % 200).alias("g"), "id")
    rows = sketches.estimate(sketches.build(groups, ["g"], "id"), ["g"]).collect()
    errors = np.array([r.n_distinct / 5000 - 1 for r in rows])
    assert abs(errors.mean()) < 0.005 and errors.std() < 0.024
    assert np.mean([r.lower <= 5000 <= r.upper for r in rows]) > 0.98


def test_merging_partial_results_changes_nothing(spark):
    rows = spark.range(3000).select((F.col("id") % 7).alias("g"), (F.col("id") % 500).alias("id"))
    parts = sketches.build(rows.filter("id < 300"), ["g"], "id").union(sketches.build(rows.filter("id > 100"), ["g"], "id"))
    assert sorted(sketches.merge(parts, ["g"]).collect()) == sorted(sketches.build(rows, ["g"], "id").collect())


def test_breakdowns(spark):
    events = spark.sql(
        "select cast(timestamp_ntz '2020-01-01' + make_dt_interval(cast(id % 3 as int)) as timestamp_ntz) time,"
        " concat('c', id % 2) code, id % 40 subject_id, 1 as split from range(400)"
        " union all select null, null, 1, 1 union all select null, 'c0', null, 1"
    )
    splits = spark.sql(
        "select id subject_id, if(id < 20, 'a', 'b') split, timestamp_ntz '2019-01-01' assigned_at, cast(null as timestamp_ntz) removed_at"
        " from range(30) union all select 1, 'z', timestamp_ntz '2019-02-01', timestamp_ntz '2019-03-01'"
        " union all select 1, 'b', timestamp_ntz '2019-01-02', null"
    )
    found = {(r.level, r.day and str(r.day), r.code, r.split): r.n_distinct for r in sketches.breakdowns(events, splits).collect()}
    near = lambda key, n: abs(found[key] - n) <= 1
    assert near(("all", None, None, None), 40)
    assert near(("split", None, None, "a"), 19) and near(("split", None, None, "b"), 11) and near(("split", None, None, None), 10)
    assert near(("code", None, "c1", None), 20) and near(("code", None, None, None), 1)
    assert near(("day", "2020-01-02", None, None), 40)
    assert near(("code,split", None, "c0", "a"), 10)
    assert {k[0] for k in found} == {"all", "day", "code", "split", "day,code", "code,split", "day,split", "day,code,split"}
    assert sketches.breakdowns(events.limit(0), splits.limit(0)).filter("level <> 'all'").count() == 0


def test_full_and_empty_matrices():
    full = np.full((1, sketches.RANKS), sketches.BUCKETS)
    n, error = sketches.likeliest(full)
    assert np.isfinite(n).all() and np.isfinite(error).all() and n[0] > 1e12
    assert sketches.likeliest(np.zeros((1, sketches.RANKS)))[0][0] == 0

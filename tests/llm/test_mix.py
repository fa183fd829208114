"""Mixing against a plain queue."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import mix
from tallyforge.runtime import Stash

SIZED = "doc_id long, source string, n_tokens long"
TARGETS = "source string, target_share double, max_repeats int"


@pytest.fixture
def sized(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["big"] * 20 + ["mid"] * 5 + ["small"]), rng.randrange(1, 60)) for i in range(3000)]
    rows += [(9000, "big", 0), (9001, None, 50), (9002, "other", 50)]
    return spark.createDataFrame(rows, SIZED)


@pytest.mark.parametrize("bucket", [50, 50_000])
@pytest.mark.parametrize("budget", [None, 4000, 10**9])
def test_mix(spark, sized, monkeypatch, bucket, budget):
    monkeypatch.setattr(mix, "BUCKET_ROWS", bucket)
    rows = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 3), ("absent", 0.1, 2), ("big", 0.5, 1), ("void", 0.0, 1), (None, 0.3, 1)]
    targets = spark.createDataFrame(rows, TARGETS)
    found = mix.mix(sized, targets, Stash(spark), budget).orderBy("running_tokens").collect()
    weights, most = {"big": 5 / 9, "mid": 3 / 9, "small": 1 / 9}, {"big": 1, "mid": 2, "small": 3}
    docs = sized.select("*", F.xxhash64("doc_id", F.lit(0)).alias("h")).collect()
    supply = {s: sum(d.n_tokens for d in docs if d.source == s) for s in weights}
    limit = budget if budget is not None else min(supply[s] * most[s] / weights[s] for s in weights)
    queue = []
    for s in weights:
        upto = 0
        own = [d for d in docs if d.source == s and d.n_tokens]
        for use in range(1, most[s] + 1):
            for d in sorted(own, key=lambda d: ((d.h % 2**64) >> 1, d.doc_id)):
                upto += d.n_tokens
                queue.append((upto / weights[s], s, use, d.doc_id, d.n_tokens))
    queue.sort()
    total, expected = 0, []
    for finish, s, use, doc, n in queue:
        if finish > limit * (1 + 1e-12) or total + n > limit:
            break
        total += n
        expected.append((doc, use))
    got = [(r.doc_id, r.use_no) for r in found]
    assert set(got) == set(expected) and len(got) == len(set(got))
    assert [r.running_tokens for r in found] == sorted(r.running_tokens for r in found)
    assert found[-1].running_tokens == total <= limit
    report = {r.source: r for r in mix.shares(spark.createDataFrame(found), targets).collect()}
    assert set(report) == {"big", "mid", "small", "absent"}
    assert report["absent"].reached_tokens == 0
    if budget != 10**9:
        assert all(abs(report[s].reached_share - weights[s]) < 0.03 for s in weights)
    assert all(report[s].most_uses <= most[s] for s in weights)


def test_nothing_to_mix(spark, sized):
    targets = spark.createDataFrame([("absent", 1.0, None)], TARGETS)
    assert mix.mix(sized, targets, Stash(spark)).count() == 0
    assert mix.mix(sized, targets.limit(0), Stash(spark)).count() == 0
    empty = mix.mix(sized.limit(0), targets, Stash(spark))
    assert mix.shares(empty, targets).first().reached_share == 0.0
    one = mix.mix(sized, spark.createDataFrame([("big", 0.2, None)], TARGETS), Stash(spark), budget=500).collect()
    assert {r.use_no for r in one} == {1} and sum(r.n_tokens for r in one) <= 500

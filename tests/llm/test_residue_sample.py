"""The fitted model does not depend on how far the sample was thinned."""

import random

import numpy as np
from pyspark.sql import functions as F

from tallyforge.llm import residue
from tallyforge.runtime import Stash

from .test_residue import best, corpus, speech, units_of  # noqa: F401


def learned(frame):
    read = frame.mapInArrow(residue._read, residue._READ)
    return residue.learn(read, Stash(frame.sparkSession))


def test_score_hardly_moves_when_the_corpus_is_repeated(spark, corpus, monkeypatch):  # noqa: F811
    """Bounds are what the small corpus holds, so the large one is thinned to a tenth."""
    good, bad = corpus[0], corpus[1] * 6
    owner, _, trusted, *_ = units_of(good + bad)
    near = np.isin(owner, owner[trusted]) & ~trusted
    for name, n in (("TRUSTED_UNITS", trusted.sum()), ("NEAR_UNITS", near.sum()), ("OTHER_UNITS", (~trusted & ~near).sum())):
        monkeypatch.setattr(residue, name, int(n))
    once = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string").repartition(3)
    tenfold = once.select("text", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("n"), "doc_id")
    tenfold = tenfold.select((F.col("doc_id") * 10 + F.col("n")).alias("doc_id"), "text")
    one, ten = learned(once), learned(tenfold)
    assert np.abs(one[residue.SPACE :] - ten[residue.SPACE :]).max() < 0.5
    rng = random.Random(11)
    probes = [speech(rng) for _ in range(50)]
    assert not (best(probes, one) > 0).any() and not (best(probes, ten) > 0).any()
    signs = [i for i, t in enumerate(bad) if units_of([t])[2].any()]
    assert (best(bad, one)[signs] > 0).all() and (best(bad, ten)[signs] > 0).all()
    assert ((best(bad, one) > 0) == (best(bad, ten) > 0)).mean() >= 0.9


def test_units_weigh_what_they_stand_for():
    rng = random.Random(2)
    plain = [rng.sample(range(50), 5) for _ in range(8000)]
    signs = [rng.sample(range(40, 90), 5) for _ in range(200)]

    def fit(a, b, weight):
        kind = np.array([0] * len(a) + [2] * len(b))
        size = np.where(kind == 0, weight, 1.0)
        return residue.fit(kind, np.zeros(len(kind), bool), np.full(len(kind), 5), np.array(a + b, np.int32).ravel(), size)

    whole, part = fit(plain, signs, 1.0), fit(plain[::10], signs, 10.0)
    assert abs(whole[residue.SPACE] - part[residue.SPACE]) < 0.2
    assert np.abs(whole[40:50] - part[40:50]).max() < 0.7


def test_sample_is_no_prefix(spark, monkeypatch):
    """Kinds of residue that lie in later files are in the sample too."""
    monkeypatch.setattr(residue, "TRUSTED_UNITS", 30)
    seen = []
    monkeypatch.setattr(residue, "fit", lambda *rows: seen.append(rows) or np.zeros(residue.SPACE + 2, np.float32))
    first, later = "Lorem ipsum dolor sit amet", "Error 404 was the answer"
    frame = spark.createDataFrame([(i, first if i < 300 else later) for i in range(600)], "doc_id long, text string")
    learned(frame.coalesce(1))
    kind, _, lengths, tokens, _ = seen[0]
    heads = [tokens[e - n] for e, n, k in zip(np.cumsum(lengths), lengths, kind) if k == 2]
    assert len(heads) == 30
    assert 6 <= sum(h == residue._HASH["lorem"] for h in heads) <= 24


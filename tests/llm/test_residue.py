"""Residue detection on invented texts with known answers (held-out signs included)."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import residue

WORDS = "the council must review its budget for schools and roads because nobody asked what winter repairs cost this year".split()


def speech(rng, n=6):
    return " ".join(" ".join(rng.choices(WORDS, k=9)).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    good = [speech(rng) for _ in range(400)]
    good += [f"{speech(rng)} “Something went wrong”, said the screen to {rng.randrange(90)} people waiting. {speech(rng)}" for _ in range(8)]
    good += [f"{speech(rng)} [Laughter] {speech(rng)}" for _ in range(30)] + [f"Their plan is filler, from page {i} to page 9." for i in range(8)]
    good += [f"The clause reads: “the authority {{may}} act” and nothing more. {speech(rng)}" for _ in range(6)]
    bad = ["Lorem ipsum dolor sit amet. " * 3, "<html><head><title>Error 404</title></head><body>Return to the start page.</body></html>"] * 4
    bad += [f"Please enable JavaScript to display volume {i}." for i in range(6)] + ["Return to the start page."]
    for mark in ("{{name}}", "[insert date here]", "%(date)s", "${vote.count}", "<<MEMBER>>", "XXXXXX", "[date TBC]"):
        bad += [speech(rng, 3) + f" What did {mark} say to the council? " + speech(rng, 3) for _ in range(2)]
    bad += [speech(rng, 2) + " What did {date} say to the council?", "speech text " * 30, "qwerty " * 20, "asdf " * 15, "Traceback (most recent call last):\n  File \"a.py\", line 3, in run"]
    return good, bad


def test_separates(spark, corpus):
    good, bad = corpus
    rows = [(i, t, "x") for i, t in enumerate(good + bad)] + [(9000, None, ""), (9001, "", ""), (9002, " \n ", ""), (9003, "12 %", "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, sign string").repartition(3)
    found = sorted(r.doc_id for r in residue.find_residue(frame).collect())
    wrong = [(rows[i][1][:80]) for i in set(found) ^ set(range(len(good), len(good) + len(bad)))]
    assert wrong == []
    assert residue.find_residue(frame.limit(0)).count() == 0
    assert residue.find_residue(frame.filter("doc_id < 50")).count() == 0


def units_of(texts):
    u = residue.read_units(pa.array(texts, pa.string()))
    return u.owner, u.mark, u.trusted, u.lengths, u.tokens


def fitted(texts):
    owner, mark, trusted, lengths, tokens = units_of(texts)
    kind = np.where(trusted, 2, np.isin(owner, owner[trusted]).astype(int))
    return residue.fit(kind, mark, lengths, tokens, np.ones(len(kind)))


def best(texts, odds):
    """Per text the score of the unit that is most likely residue."""
    owner, mark, _, lengths, tokens = units_of(texts)
    found = np.full(len(texts), -np.inf)
    np.maximum.at(found, owner, residue.scores(odds, mark, lengths, tokens))
    return found


def test_sample_is_bounded(spark, corpus, monkeypatch):
    for name, n in (("OTHER_UNITS", 200), ("NEAR_UNITS", 15), ("TRUSTED_UNITS", 10)):
        monkeypatch.setattr(residue, name, n)
    seen = []
    monkeypatch.setattr(residue, "fit", lambda kind, *rest: seen.append((kind, rest[-1])) or np.zeros(residue.SPACE + 2, np.float32))
    good, bad = corpus
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    residue.find_residue(frame).count()
    kind, size = seen[0]
    assert (kind == 2).sum() == 10 and (kind == 1).sum() <= 15 and 50 < (kind == 0).sum() <= 200
    owner, _, trusted, *_ = units_of(good + bad)
    assert size.sum() == pytest.approx(len(owner)) and size[kind == 2].sum() == pytest.approx(trusted.sum())


def test_signs_are_labels_only(monkeypatch):
    """Once fitted, nothing matches a sign any more; and a kind of sign that is held out is found by what it shares with others."""
    rng = random.Random(8)
    good = [speech(rng) + f" [Laughter] See [column {i}]." for i in range(300)]
    names = ["member name", "date", "vote count", "party"]
    kinds = ["{{%s}}", "${%s}", "[insert %s]", "<%s to be added>", "[%s TBC]", "&lt;%s&gt;"]
    bad = [f"{speech(rng, 2)} What did {k % rng.choice(names)} say to {k % rng.choice(names)}? {speech(rng, 2)}" for k in kinds * 8]
    odds = fitted(good + bad)
    monkeypatch.setattr(residue, "SIGNS", dict.fromkeys(residue.SIGNS, "(?i)\\x00"))
    after = best(good + bad, odds) > residue.LEAST_ODDS
    assert not after[: len(good)].any() and after[len(good) :].mean() > 0.9


def test_long_texts_and_slots_are_read_to_the_end(corpus):
    good, bad = corpus
    odds = fitted(good + bad)
    text = "the council must review its budget " * 40_000
    assert (best([text, text + "{{name}}", text + "[" * 5000 + " {{name}}"], odds) > 0).tolist() == [False, True, True]
    slots = ["{{" + "name " * 40 + "}}", "${" + "name." * 20 + "name}", "{{\nname\n}}", "{{ name. Name }}"]
    assert all(residue.MARK.fullmatch(s) for s in slots)
    assert (best([f"What did {s} say to the council?" for s in slots], odds) > 0).all()
    u = residue.read_units(pa.array([f"a b c {s} d" for s in slots], pa.string()))
    assert u.trusted[u.mark].tolist() == [True] * 4


def test_reading():
    u = residue.read_units(pa.array(["Lorem ip\u200bsum.  Dolor sit\xa0amet", "\n \n", "cafe\u0301 noir", "12 %", "x" * 100_000, "it reads “null and void” twice"], pa.string()))
    assert u.owner.tolist() == [0, 0, 2, 4, 5] and u.lengths.tolist() == [3, 3, 2, 1, 4]
    assert u.trusted.tolist() == [True, False, False, False, False]
    same = residue.read_units(pa.array(["caf\xe9 noir"], pa.string()))
    assert same.tokens.tolist() == u.tokens[6:8].tolist()
    none = residue.read_units(pa.array([], pa.string()))
    assert len(none.owner) == len(none.tokens) == 0


def test_units_of_a_batch_do_not_depend_on_each_other(corpus):
    good, bad = corpus
    texts = good[:20] + bad + good[20:40]
    owner, mark, trusted, lengths, tokens = units_of(texts)
    ends = np.cumsum(lengths)
    for i, text in enumerate(texts):
        _, m, t, n, own = units_of([text])
        mine = owner == i
        assert (m == mark[mine]).all() and (t == trusted[mine]).all() and (n == lengths[mine]).all()
        assert own.tolist() == [x for e, k in zip(ends[mine], lengths[mine]) for x in tokens[e - k : e].tolist()]


def test_fast_search_for_marks_equals_plain():
    rng = random.Random(4)
    bits = ["{", "}", "{{", "[", "]", "<", ">", "%", "#", "@@", "__", "$", "&lt;", "&gt;", "«", "»", "A", "NAME", "word", " ", "(", ")s", "None", " an undefined", "XXXX", "\n"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 25)))
        assert residue._without_marks(text, lambda m: f"({m.group()})") == residue.MARK.sub(lambda m: f"({m.group()})", text)

"""Burst tries against plain counting."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import burst_trie, terms
from tallyforge.runtime import Stash


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab\x00é", max_size=6), st.integers(0, 300)), max_size=80), st.integers(1, 5))
def test_trie_counts_and_packs(rows, container):
    trie, plain = burst_trie.BurstTrie(container), defaultdict(lambda: [0, 0])
    for term, n in rows:
        trie.add(term, n, 1)
        plain[term][0] += n
        plain[term][1] += 1
    found = {}
    for prefix, suffixes in trie.subtrees():
        for suffix, n, m in burst_trie.unpack(burst_trie.pack(suffixes)):
            assert prefix + suffix not in found
            found[prefix + suffix] = [n, m]
    assert found == dict(plain)
    assert trie.size == len(plain)


def test_routes():
    bursting = {"", "a", "ab"}
    assert [burst_trie.route_of(t, bursting) for t in ("", "a", "ab", "abc", "abcd", "b", "xyz")] == [
        "\x00", "a\x00", "ab\x00", "abc", "abc", "b", "x",
    ]


@pytest.mark.parametrize(("container", "worker", "route"), [(256, 300_000, 100_000), (2, 50, 5)])
def test_counts_across_workers(spark, container, worker, route):
    rng = random.Random(2)
    rows = [("hot", 1, 1)] * 2000 + [("x" * rng.randrange(6) + str(rng.randrange(400)), rng.randrange(9), 1) for _ in range(3000)]
    rows += [("", 5, 1), ("", 6, 0), (None, 3, 1), ("long" * 5000, 2, 1)]
    frame = spark.createDataFrame(rows, "term string, occurrences int, records int").repartition(5)
    found = burst_trie.count_terms(frame, Stash(spark), container, worker, route).collect()
    n, m = Counter(), Counter()
    for t, a, b in rows:
        if t is not None:
            n[t] += a
            m[t] += b
    assert len(found) == len(n)
    assert {r.term: (r.occurrences, r.records) for r in found} == {t: (n[t], m[t]) for t in n}
    assert burst_trie.count_terms(frame.limit(0), Stash(spark)).count() == 0


def test_marks(spark):
    events = [(s, "all", 0) for s in range(100)] + [(s, "some", s % 2) for s in range(30)] * 2 + [(1, "one", 0)] * 50
    events += [(None, "one", 0), (1, None, 0), (5, "move", 0), (5, "move", 1), (6, "nul", None), (7, "a\x1fb", 0)]
    ev = spark.createDataFrame(events, "subject_id long, code string, shard int").selectExpr("*", "1 as n", "'x' as term")
    summary = [
        (0, "all", 100, 100, False), (0, "all", 100, 100, False), (0, "some", 30, 15, True), (1, "some", 30, None, False),
        (0, "one", 51, 1, False), (0, "__RARE__", 1, 1, False), (1, "gone", 0, 0, True), (1, "stale", 3, 3, None),
        (None, "nul", 1, 1, True), (0, None, 1, 1, False), (1, "move", 1, 1, None),
    ]
    su = spark.createDataFrame(summary, "shard int, code string, event_count long, subject_count long, is_masked boolean")
    found = sorted((r.code, r.mark) for r in terms.marks(ev, su).collect())
    assert found == sorted(
        [("all", "common"), ("some", "common"), ("one", "rare"), ("move", "rare"), ("nul", "rare"), ("a\x1fb", "rare"),
         ("some", "wrong"), ("one", "leaked"), ("stale", "wrong"), ("stale", "leaked"), ("move", "leaked")]
    )
    by = {r.code: (r.n_events, r.n_subjects) for r in terms.marked_terms(ev).collect()}
    assert by["move"] == (2, 1) and by["one"] == (51, 1) and by["some"] == (60, 30) and None not in by
    assert terms.marks(ev.limit(0), su.limit(0)).count() == 0

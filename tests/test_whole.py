"""Queries against brute force on small tables: nothing of the input is left out."""

import random

import pytest

from tallyforge.plans import oracle, queries

from .test_queries import FOLDER, duck, plain  # noqa: F401

CONCEPT = "concept_id long, concept_name string, domain_id string, vocabulary_id string, concept_code string, standard_concept string, invalid_reason string"
ANCESTOR = "ancestor_concept_id long, descendant_concept_id long, min_levels_of_separation int, loaded_at string"
LISTS = {"parents": "parent_codes", "children_depth": "child_codes", "siblings": "sibling_codes"}


@pytest.fixture(scope="module")
def vocabulary(spark, tmp_path_factory):
    """Concepts of ids 1 to 40, some invalid or repeated, and links with self, two-way and level 0 ones."""
    rng = random.Random(5)
    concepts = [(i, f"n{i}", "d", f"V{i % 2}", f"c{i}", "S", rng.choice([None, "", "", "D"])) for i in range(1, 41)]
    links = []
    for _ in range(160):
        a, d = rng.randint(1, 30), rng.randint(1, 42)
        links.append((a, d, rng.randint(0, 4), "x"))
    links += [(d, a, 1, "y") for a, d, _, _ in links[:10]] + [(7, 7, 1, "x"), (None, 5, 1, "x"), (5, None, 1, "x")]
    folder = tmp_path_factory.mktemp("vocabulary")
    spark.createDataFrame([*concepts, concepts[3]], CONCEPT).write.parquet(f"{folder}/concept.parquet")
    spark.createDataFrame(links, ANCESTOR).write.parquet(f"{folder}/concept_ancestor.parquet")
    return str(folder), concepts, links


def related(concepts, links):
    """(query, concept id) to the list as text."""
    usable = {(a, d, n) for a, d, n, _ in links if a and d and n > 0 and a != d}
    pairs = {(a, d) for a, d, _ in usable}
    edges = {e for e in usable if (e[1], e[0]) not in pairs}
    code = {c[0]: f"{c[3]}//{c[4]}" for c in concepts if not c[6]}
    made = {}
    for i in {c[0] for c in concepts}:
        above = {a for a, d, _ in edges if d == i}
        made["parents", i] = above
        made["children_depth", i] = {d for a, d, n in edges if a == i and n <= 2}
        made["siblings", i] = {d for a, d, n in edges if a in above and a in code and n == 1 and d != i}
    made = {k: "|".join(sorted(code[x] for x in v if x in code)) for k, v in made.items()}
    return {k: v for k, v in made.items() if v}


@pytest.mark.parametrize("name", sorted(LISTS))
def test_every_concept_gets_its_list(spark, vocabulary, name):
    folder, concepts, links = vocabulary
    expected = {i: v for (n, i), v in related(concepts, links).items() if n == name}
    found = {r.concept_id: r[LISTS[name]] for r in queries.QUERIES[name](spark, folder).collect()}
    assert found == expected
    assert {i % 3 for i in found} == {0, 1, 2}


@pytest.mark.parametrize("name", sorted(LISTS))
def test_lists_agree_with_sql(spark, duck, name):  # noqa: F811
    theirs = dict(duck.execute(oracle.ORACLE[name]).fetchall())
    found = {r.concept_id: r[LISTS[name]] for r in queries.QUERIES[name](spark, FOLDER).collect()}
    assert found == theirs

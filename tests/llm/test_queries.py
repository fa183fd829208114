"""The registered queries on the smallest tables."""

import os

import pytest

from tallyforge.llm import queries

from ..test_queries import FOLDER, duck, same  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    same(queries.QUERIES[name](spark, FOLDER), duck.execute(queries.ORACLE[name]))


def test_sketches_are_close_to_exact_counts(spark, duck):  # noqa: F811
    rows = queries.QUERIES["p6_distinct"](spark, FOLDER).filter("level = 'code'").collect()
    exact = dict(duck.execute("SELECT code, count(DISTINCT subject_id) FROM med_events GROUP BY code").fetchall())
    assert {r.code for r in rows} == set(exact)
    assert sum(r.lower <= exact[r.code] <= r.upper for r in rows) >= 0.99 * len(rows)


def test_encoding_round_trip(spark):
    from tallyforge.llm.tokenizer import MergeReplay

    text = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    own = MergeReplay()
    for r in queries.QUERIES["p8_ids"](spark, FOLDER).collect():
        assert b"".join(own.text[i] for i in r.ids).decode() == (text[r.doc_id] or "")


def test_mix_and_residue_run(spark):
    shares = queries.QUERIES["p9_shares"](spark, FOLDER).collect()
    assert abs(sum(r.reached_share for r in shares) - 1) < 1e-9
    assert queries.QUERIES["p9_mix"](spark, FOLDER).count() > 0
    assert queries.QUERIES["p10_found"](spark, FOLDER).count() >= 0

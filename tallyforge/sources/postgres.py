"""Vocabulary rows from PostgreSQL through the ``psql`` client.

The server narrows: for a chunk of candidates it returns the matched concepts and only the usable ancestor
pairs that the wanted lists need (upward, downward to the depth, or across), and the same Spark operators as for
files do the matching. Candidates pass in chunks, whose answers go to the shared folder, so neither
their number nor the answers' size is bound by the driver's memory.
"""

from __future__ import annotations

import csv
import io
import itertools
import subprocess
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EnrichmentConfig
from ..runtime import Stash, session
from .athena import CONCEPT, CONCEPT_ANCESTOR

#: Candidates per call of the client.
CHUNK = 100_000
_OUT = ["kind", "a", "b", "level", *list(CONCEPT)[1:6]]
_USABLE = """min_levels_of_separation > 0 AND ancestor_concept_id <> descendant_concept_id AND NOT EXISTS (
    SELECT FROM concept_ancestor back WHERE back.ancestor_concept_id = edge.descendant_concept_id
    AND back.descendant_concept_id = edge.ancestor_concept_id AND back.min_levels_of_separation > 0)"""


def _edges(where: str) -> str:
    return f"""  SELECT ancestor_concept_id AS a, descendant_concept_id AS b, min_levels_of_separation AS level
  FROM concept_ancestor edge WHERE {where} AND {_USABLE}"""


def build_script(candidates: Iterable[tuple], config: EnrichmentConfig) -> str:
    """SQL for a chunk, with the candidates inline as COPY data."""
    data = io.StringIO()
    csv.writer(data, lineterminator="\n").writerows(candidates)
    hit = "IN (SELECT concept_id FROM hit)"
    wanted = ["  SELECT NULL::bigint AS a, NULL::bigint AS b, NULL::bigint AS level WHERE false"]
    if config.parent_codes or config.sibling_codes:
        wanted.append(_edges(f"descendant_concept_id {hit}"))
    if config.child_codes:
        wanted.append(_edges(f"ancestor_concept_id {hit} AND min_levels_of_separation <= {int(config.child_depth)}"))
    if config.sibling_codes:
        above = "SELECT up.ancestor_concept_id FROM concept_ancestor up JOIN hit ON up.descendant_concept_id = hit.concept_id"
        wanted.append(_edges(f"min_levels_of_separation = 1 AND ancestor_concept_id IN ({above})"))
    pairs = "\n  UNION\n".join(wanted)
    return f"""
CREATE TEMP TABLE wanted (vocabulary_id text, concept_code text);
COPY wanted FROM STDIN WITH (FORMAT csv);
{data.getvalue()}\\.
CREATE TEMP TABLE hit AS
  SELECT DISTINCT concept_id FROM concept NATURAL JOIN wanted WHERE invalid_reason IS NULL;
CREATE TEMP TABLE pair AS
{pairs};
SELECT 'pair' AS kind, a, b, level, NULL AS concept_name, NULL AS domain_id, NULL AS vocabulary_id,
       NULL AS concept_code, NULL AS standard_concept FROM pair
UNION ALL
SELECT 'concept', concept_id, NULL, NULL, concept_name, domain_id, vocabulary_id, concept_code, standard_concept
FROM concept
WHERE invalid_reason IS NULL
  AND concept_id IN (SELECT concept_id FROM hit UNION SELECT a FROM pair UNION SELECT b FROM pair);
"""


def _ask(connection: str, script: str) -> str:
    command = ["psql", connection, "-X", "-q", "--csv", "-v", "ON_ERROR_STOP=1"]
    try:
        done = subprocess.run(command, input=script, text=True, capture_output=True, check=False)
    except FileNotFoundError as error:
        raise FileNotFoundError("psql is required for PostgreSQL Athena enrichment") from error
    if done.returncode == 0:
        return done.stdout
    said = done.stderr.strip() or "unknown psql error"
    hint = "; set PGPASSWORD in the environment" if "no password supplied" in said else ""
    raise RuntimeError(f"Athena PostgreSQL query failed: {said}{hint}")


def fetch(candidates: DataFrame, config: EnrichmentConfig, spark: SparkSession | None = None) -> tuple[DataFrame, DataFrame]:
    """Concepts and ancestor pairs for the candidates; both empty for no candidates."""
    spark = session(spark)
    stash, answers = Stash(spark), []
    schema = ", ".join(f"{c} string" for c in _OUT)
    rows = candidates.select("vocabulary_id", "concept_code").distinct().toLocalIterator()
    for chunk in itertools.batched(rows, CHUNK):
        if any(mark in value for row in chunk for value in row for mark in "\r\n"):
            raise ValueError("PostgreSQL enrichment does not accept newlines in codes")
        answer = csv.reader(io.StringIO(_ask(config.postgres, build_script(chunk, config))))
        found = [[x or None for x in row] for row in itertools.islice(answer, 1, None)]
        answers.append(stash.put(spark.createDataFrame(found, schema))[0])
    frame = stash.together(answers).distinct() if answers else spark.createDataFrame([], schema)
    cast = lambda name, of: F.expr(f"try_cast({of} as bigint)").alias(name)
    concepts = frame.filter("kind = 'concept'").select(
        cast("concept_id", "a"), *[c for c in CONCEPT if c in frame.columns], F.lit(None).cast("string").alias("invalid_reason")
    )
    pairs = frame.filter("kind = 'pair'").select(*[cast(n, c) for n, c in zip(CONCEPT_ANCESTOR, ("a", "b", "level"))])
    return concepts, pairs

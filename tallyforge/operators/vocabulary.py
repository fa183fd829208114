"""Matching codes to vocabulary concepts and listing related concepts.

The best match is chosen before any expansion and lists are built once per distinct
concept, then joined back to codes: the same result as expanding every candidate, with far
less fan-out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import full_code, part, reference_parts, split_on
from ..runtime import join_spread

ATTRIBUTES = ["description", "vocabulary_id", "concept_id", "concept_code", "domain_id", "standard_concept"]


def code_candidates(frame: DataFrame) -> DataFrame:
    """Distinct ``target_code, vocabulary_id, concept_code, rank`` to look up.

    Rank 0: first and second part of the code at ``//``; rank 1: first and third part of codes
    of exactly three parts; rank 2: the first non-null parent reference. Null or empty parts
    make no candidate. A string-typed ``parent_codes`` is split at ``|``.
    """
    base = frame.select(F.col("code").cast("string").alias("target_code"))
    kind = frame.schema["parent_codes"].dataType if "parent_codes" in frame.columns else None
    reference = None
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        reference = part(F.array_compact("parent_codes"), 0)
    elif isinstance(kind, T.StringType):
        reference = part(split_on(F.col("parent_codes"), "|"), 0)
    if reference is not None:
        base = frame.select(F.col("code").cast("string").alias("target_code"), reference.alias("reference"))
    parts = split_on(F.col("target_code"), "//")
    tries = [
        F.struct(part(parts, 0).alias("v"), part(parts, 1).alias("c"), F.lit(0).alias("rank")),
        F.when(F.size(parts) == 3, F.struct(part(parts, 0).alias("v"), part(parts, 2).alias("c"), F.lit(1).alias("rank"))),
    ]
    if reference is not None:
        named = reference_parts(F.col("reference"))
        tries.append(F.struct(part(named, 0).alias("v"), part(named, 1).alias("c"), F.lit(2).alias("rank")))
    one = base.select("target_code", F.explode(F.array(*tries)).alias("t"))
    return (
        one.select("target_code", F.col("t.v").alias("vocabulary_id"), F.col("t.c").alias("concept_code"), "t.rank")
        .filter("vocabulary_id <> '' and concept_code <> ''")
        .distinct()
    )


def valid_concepts(concepts: DataFrame) -> DataFrame:
    """Concepts without an ``invalid_reason``."""
    return concepts.filter(F.col("invalid_reason").isNull())


def clean_hierarchy(ancestors: DataFrame) -> DataFrame:
    """Distinct usable edges ``ancestor, descendant, level``.

    Level above 0, two different ends, and no edge whose reverse is there too: both edges of
    a two-way pair go (left anti-join with the reversed edges).
    """
    edges = ancestors.select(
        F.col("ancestor_concept_id").alias("ancestor"),
        F.col("descendant_concept_id").alias("descendant"),
        F.col("min_levels_of_separation").cast("bigint").alias("level"),
    ).filter("level > 0 and ancestor <> descendant")
    reverse = edges.select(F.col("descendant").alias("r_a"), F.col("ancestor").alias("r_d")).distinct()
    return edges.join(reverse, F.expr("ancestor = r_a and descendant = r_d"), "left_anti").distinct()


def best_matches(candidates: DataFrame, concepts: DataFrame) -> DataFrame:
    """Rows of the best match per ``target_code``: lowest rank that matches, then lowest concept id.

    Candidates meet valid concepts on (vocabulary, code). If the best rank has only null
    concept ids, the code has no match. Concepts repeated with other attributes stay as rows.
    """
    valid = valid_concepts(concepts).select(F.col("concept_name").alias("description"), *ATTRIBUTES[1:])
    found = candidates.join(valid, ["vocabulary_id", "concept_code"]).select("target_code", "rank", *ATTRIBUTES)
    order = F.struct("rank", F.col("concept_id").isNull(), "concept_id")
    best = F.min(order).over(Window.partitionBy("target_code"))
    return (
        found.withColumn("best", best)
        .filter(order.eqNullSafe(F.col("best")) & F.col("concept_id").isNotNull())
        .drop("best")
        .distinct()
    )


def _lists(pairs: DataFrame, concepts: DataFrame, name: str) -> DataFrame:
    """Sorted distinct codes of valid related concepts per ``concept_id``."""
    related = valid_concepts(concepts).select(
        F.col("concept_id").alias("related"), full_code(F.col("vocabulary_id"), F.col("concept_code")).alias("code")
    )
    listed = pairs.join(related, "related").groupBy("concept_id")
    return listed.agg(F.array_sort(F.collect_set("code")).alias(name))


def parents(ids: DataFrame, edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """All ancestors at any distance of each ``concept_id``."""
    pairs = ids.join(edges, F.col("concept_id") == F.col("descendant")).select("concept_id", F.col("ancestor").alias("related"))
    return _lists(pairs, concepts, "parent_codes")


def children(ids: DataFrame, edges: DataFrame, concepts: DataFrame, depth: int) -> DataFrame:
    """Descendants at a distance of at most ``depth``."""
    near = edges.filter(F.col("level") <= depth)
    pairs = ids.join(near, F.col("concept_id") == F.col("ancestor")).select("concept_id", F.col("descendant").alias("related"))
    return _lists(pairs, concepts, "child_codes")


def siblings(ids: DataFrame, edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Direct children of every valid ancestor, without the concept itself.

    An ancestor of very many concepts (a root is one of nearly all) meets its children in several tasks.
    """
    above = ids.join(edges, F.col("concept_id") == F.col("descendant")).select("concept_id", F.col("ancestor").alias("via"))
    known = valid_concepts(concepts).select(F.col("concept_id").alias("via"))
    above = above.join(known, "via", "left_semi").distinct()
    below = edges.filter("level = 1").select(F.col("ancestor").alias("via"), F.col("descendant").alias("related"))
    pairs = join_spread(above, below, "via", "inner", ["concept_id"]).filter("related <> concept_id").select("concept_id", "related").distinct()
    return _lists(pairs, concepts, "sibling_codes")

"""Filling catalog or metadata rows from a vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EnrichmentConfig
from ..functions import double_slash, merge_lists, non_empty, split_on, without_first
from ..runtime import lit_null
from ..sources.athena import CONCEPT, CONCEPT_ANCESTOR, scan_athena
from ..sources.postgres import fetch
from . import vocabulary as V

#: Output columns in order, with their types
FIELDS = {
    "description": "string",
    "parent_codes": "array<string>",
    "child_codes": "array<string>",
    "sibling_codes": "array<string>",
    "vocabulary_id": "string",
    "concept_id": "bigint",
    "concept_code": "string",
    "domain_id": "string",
    "standard_concept": "string",
}
LISTS = ("parent_codes", "child_codes", "sibling_codes")
_IN = "_athena_"


def vocabulary_rows(
    candidates: DataFrame, concepts: DataFrame, ancestors: DataFrame | None, config: EnrichmentConfig
) -> DataFrame:
    """One row per matched code: ``code``, ``_athena_match_rank`` and the incoming ``_athena_*`` columns."""
    best = V.best_matches(candidates, concepts)
    if ancestors is not None:
        edges, ids = V.clean_hierarchy(ancestors), best.select("concept_id").distinct()
        if config.parent_codes:
            best = best.join(V.parents(ids, edges, concepts), "concept_id", "left")
        if config.child_codes:
            best = best.join(V.children(ids, edges, concepts, config.child_depth), "concept_id", "left")
        if config.sibling_codes:
            best = best.join(V.siblings(ids, edges, concepts), "concept_id", "left")
    made = [
        (non_empty(F.col(n)) if n in LISTS else F.col(n)) if n in best.columns else lit_null(t) for n, t in FIELDS.items()
    ]
    return best.select(
        F.col("target_code").alias("code"),
        F.col("rank").alias(f"{_IN}match_rank"),
        *[c.alias(f"{_IN}{n}") for c, n in zip(made, FIELDS)],
    )


def _merged_list(name: str, kind: T.DataType | None, config: EnrichmentConfig):
    """Existing values first in their order, then new ones; null only if both sides are."""
    incoming = F.col(_IN + name)
    if kind is None:
        return incoming
    existing = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        existing = split_on(existing, "|")
    elif isinstance(kind, T.ArrayType):
        existing = existing.cast("array<string>")
    else:
        existing = lit_null("array<string>")
    present = existing.isNotNull() | incoming.isNotNull()
    if name == "parent_codes":
        existing = F.transform(existing, double_slash)
        if config.exclude_self_parent_code:  # the reference used for the lookup is the concept itself
            by_parent = F.col(f"{_IN}match_rank").eqNullSafe(2)
            present = F.when(by_parent, (F.size(existing) > 1) | incoming.isNotNull()).otherwise(present)
            existing = F.when(by_parent, without_first(existing)).otherwise(existing)
    return F.when(present, merge_lists(existing, incoming))


def merge_fields(frame: DataFrame, incoming: DataFrame, config: EnrichmentConfig) -> DataFrame:
    """Left join on ``code`` and the merge rules per column.

    Scalars: an existing value stays, null is filled. Lists: see ``_merged_list``; a list that
    is switched off is neither changed nor added. Masked rows take nothing, even if their
    label equals a real code.
    """
    kinds = {f.name: f.dataType for f in frame.schema}
    own = incoming.withColumnRenamed("code", "__match")
    condition = F.col("code").cast("string") == F.col("__match")
    if isinstance(kinds.get("is_masked"), T.BooleanType):
        condition = condition & ~F.coalesce(F.col("is_masked"), F.lit(True))
    joined = frame.join(own, condition, "left")
    made = {}
    for name, type_ in FIELDS.items():
        if name in LISTS:
            if getattr(config, name):
                made[name] = _merged_list(name, kinds.get(name), config)
        elif name in kinds:
            made[name] = F.coalesce(F.col(f"`{name}`").try_cast(type_), F.col(_IN + name))
        else:
            made[name] = F.col(_IN + name)
    columns = [made.pop(c).alias(c) if c in made else F.col(f"`{c}`") for c in frame.columns]
    return joined.select(*columns, *[c.alias(n) for n, c in made.items()])


def enrich_with(
    frame: DataFrame, concepts: DataFrame, ancestors: DataFrame | None, config: EnrichmentConfig
) -> DataFrame:
    """``enrich_metadata`` on vocabulary frames; rows come in no particular order."""
    _check(frame)
    wanted = ancestors if any(getattr(config, n) for n in LISTS) else None
    return merge_fields(frame, vocabulary_rows(V.code_candidates(_open(frame)), concepts, wanted, config), config)


def _check(frame: DataFrame) -> None:
    if "code" not in frame.columns:
        raise ValueError("metadata to enrich must contain a 'code' column")
    internal = {f"{_IN}{n}" for n in (*FIELDS, "match_rank")} & set(frame.columns)
    if internal:
        raise ValueError(f"metadata uses reserved enrichment columns: {sorted(internal)}")


def _open(frame: DataFrame) -> DataFrame:
    """Rows that may be looked up: all, or with a Boolean ``is_masked`` the ones where it is false."""
    kinds = {f.name: f.dataType for f in frame.schema}
    return frame.filter(~F.col("is_masked")) if isinstance(kinds.get("is_masked"), T.BooleanType) else frame


def enrich_metadata(frame: DataFrame, config: EnrichmentConfig) -> DataFrame:
    """Fill scalars and merge hierarchy lists from the configured vocabulary.

    A code is looked up as ``VOCABULARY//CODE``, then ``VOCABULARY//VERSION//CODE``, then by
    its first parent reference. Lazy for files; PostgreSQL is asked while the plan is built.
    Row order is not kept.
    """
    _check(frame)
    lists = any(getattr(config, n) for n in LISTS)
    if config.csv_dir is not None:
        folder = config.csv_dir.expanduser().resolve()
        concepts = scan_athena(folder / "CONCEPT.csv", CONCEPT, frame.sparkSession)
        ancestors = scan_athena(folder / "CONCEPT_ANCESTOR.csv", CONCEPT_ANCESTOR, frame.sparkSession) if lists else None
    else:
        candidates = V.code_candidates(_open(frame))
        concepts, ancestors = fetch(candidates, config, frame.sparkSession)
    return enrich_with(frame, concepts, ancestors, config)

"""The driver's queries for the general problems 1, 3, 4, 5 and 7, and their SQL."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import is_blank
from ..operators import features, hierarchy, orphans, skew, unpack
from ..runtime import Stash, table

#: Number of feature types in the driver's tables.
FEATURES = 300
#: Share of all rows from which a key counts as hot in p4_found.
HEAVY_SHARE = Fraction(1, 100)


def _links(spark: SparkSession, folder: str) -> DataFrame:
    concepts = hierarchy.concept_links(table(spark, folder, "concept_ancestor"))
    return concepts.unionByName(hierarchy.code_links(table(spark, folder, "codes")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.hierarchy_report(_links(spark, folder))


def p1_paths(spark: SparkSession, folder: str) -> DataFrame:
    found = hierarchy.hierarchy_paths(_links(spark, folder))
    return found.select("hierarchy", "node", "root", "depth", F.array_join("path", " > ").alias("path"))


def p1_links(spark: SparkSession, folder: str) -> DataFrame:
    found = hierarchy.predecessors(_links(spark, folder))
    return found.withColumn("n_paths", F.col("n_paths").cast("double"))


def p1_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.descendants(_links(spark, folder))


def _feature_inputs(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, n) for n in ("med_events", "cohort", "feature_codes")]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return features.feature_rows(*_feature_inputs(spark, folder))


def p3_windows(spark: SparkSession, folder: str) -> DataFrame:
    return features.window_rows(*_feature_inputs(spark, folder), days=(30, 365))


def p3_table(spark: SparkSession, folder: str) -> DataFrame:
    events, cohort, types = _feature_inputs(spark, folder)
    numbers = sorted(r["feature_no"] for r in types.select("feature_no").distinct().collect())  # 300, fixed
    return features.feature_table(events, cohort, types, numbers)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "med_events")
    return skew.heavy_keys(events, ["code", "subject_id"], HEAVY_SHARE).select("key_field", "key_value")


def p4_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "med_events")
    by_code = skew.key_quantiles(events, "code", "numeric_value")
    return by_code.unionByName(skew.key_quantiles(events, "subject_id", "numeric_value"))


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    events, codes = table(spark, folder, "med_events"), table(spark, folder, "codes")
    splits, concept, stash = table(spark, folder, "subject_splits"), table(spark, folder, "concept"), Stash(spark)
    by_code = orphans.timed_orphans(events, "code", "loaded_at", codes, "code", "registered_at", "deleted_at", stash)
    by_subject = orphans.timed_orphans(events, "subject_id", "loaded_at", splits, "subject_id", "assigned_at", "removed_at", stash)
    by_concept = orphans.state_orphans(
        table(spark, folder, "concept_ancestor"), "descendant_concept_id", "loaded_at", concept, "concept_id", is_blank(F.col("invalid_reason")), stash
    )
    return (
        orphans.named(by_code, "med_events", "code")
        .unionByName(orphans.named(by_subject, "med_events", "subject_id"))
        .unionByName(orphans.named(by_concept, "concept_ancestor", "descendant_concept_id"))
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).drop("n")


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["table_name", "field_name", "period", "kind"]
    return _orphans(spark, folder).groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return unpack.unpack(table(spark, folder, "codes"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_paths, p1_links, p1_descendants, p3_found, p3_windows, p3_table, p4_found, p4_quantiles, p5_found, p5_counts, p7_found)
}

_LINKS = """WITH RECURSIVE links AS (
  SELECT DISTINCT 'concept' AS hierarchy, CAST(ancestor_concept_id AS VARCHAR) AS parent, CAST(descendant_concept_id AS VARCHAR) AS child
  FROM concept_ancestor WHERE min_levels_of_separation = 1 AND ancestor_concept_id <> descendant_concept_id
  UNION
  SELECT DISTINCT 'code', p, code FROM (
    SELECT code, CASE WHEN length(e) - length(replace(e, '/', '')) = 1 THEN replace(e, '/', '//') ELSE e END AS p
    FROM (SELECT code, unnest(parent_codes) AS e FROM codes)) WHERE p <> code AND p IN (SELECT code FROM codes)
), roots AS (
  SELECT DISTINCT hierarchy, parent AS root FROM links l
  WHERE NOT EXISTS (SELECT 1 FROM links u WHERE u.hierarchy = l.hierarchy AND u.child = l.parent)
), tops AS (SELECT DISTINCT hierarchy, parent AS root FROM links)"""


def _down(sources: str, first: str = "", more: str = "", column: str = "") -> str:
    """Level by level from each source, every node once, with the fewest links."""
    return f"""down(hierarchy, node, root, depth{column}) USING KEY (hierarchy, node, root) AS (
  SELECT hierarchy, root, root, CAST(0 AS BIGINT){first} FROM {sources}
  UNION
  SELECT d.hierarchy, l.child, d.root, min(d.depth) + 1{more} FROM down d JOIN links l ON l.hierarchy = d.hierarchy AND l.parent = d.node
  WHERE NOT EXISTS (SELECT 1 FROM recurring.down k WHERE k.hierarchy = d.hierarchy AND k.node = l.child AND k.root = d.root)
  GROUP BY d.hierarchy, l.child, d.root)"""


_REACH = """reach(hierarchy, node, top) AS (
  SELECT hierarchy, child, parent FROM links
  UNION
  SELECT r.hierarchy, l.child, r.top FROM reach r JOIN links l ON l.hierarchy = r.hierarchy AND l.parent = r.node)"""
_WAYS = """ways(hierarchy, node, root, depth, n) AS (
  SELECT hierarchy, node, root, depth, CAST(1 AS DOUBLE) FROM down WHERE depth = 0
  UNION ALL
  SELECT w.hierarchy, l.child, w.root, w.depth + 1, sum(w.n) FROM ways w JOIN links l ON l.hierarchy = w.hierarchy AND l.parent = w.node
  JOIN down d ON d.hierarchy = w.hierarchy AND d.node = l.child AND d.root = w.root AND d.depth = w.depth + 1
  GROUP BY w.hierarchy, l.child, w.root, w.depth)"""
_FEATURES = ",\n".join(
    f"""count(*) FILTER (WHERE no = {i}) AS n_events_{i},
CAST(floor(epoch(index_time - max(t) FILTER (WHERE no = {i})) / 86400) AS BIGINT) AS days_since_last_{i},
CAST(coalesce(sum(cents) FILTER (WHERE no = {i}), 0) AS BIGINT) AS total_cents_{i}"""
    for i in range(1, FEATURES + 1)
)
_ONCE = """
WITH ev AS (
  SELECT event_id, any_value(subject_id) AS subject_id, any_value(code) AS code, any_value("time") AS t,
         any_value(CAST(round(coalesce(numeric_value, 0) * 100) AS BIGINT)) AS cents
  FROM med_events WHERE "time" IS NOT NULL GROUP BY event_id
), points AS (SELECT DISTINCT subject_id, index_time FROM cohort)
"""
_WINDOWS = "\nUNION ALL\n".join(
    f"""SELECT p.subject_id, ev.code, {d} AS window_days, count(*) AS n_events, CAST(sum(ev.cents) AS BIGINT) AS total_cents
FROM points p JOIN ev ON ev.subject_id = p.subject_id AND ev.t < p.index_time AND ev.t >= p.index_time - INTERVAL {d} DAY
WHERE ev.code IN (SELECT code FROM feature_codes) GROUP BY p.subject_id, p.index_time, ev.code"""
    for d in (30, 365)
)
_ORPHANS = """
WITH refs AS (
  SELECT 'code' AS field_name, code AS ref_key, loaded_at FROM med_events WHERE code IS NOT NULL
  UNION ALL
  SELECT 'subject_id', CAST(subject_id AS VARCHAR), loaded_at FROM med_events WHERE subject_id IS NOT NULL
), life AS (
  SELECT 'code' AS field_name, code AS ref_key, registered_at AS s, deleted_at AS e FROM codes
  UNION ALL
  SELECT 'subject_id', CAST(subject_id AS VARCHAR), assigned_at, removed_at FROM subject_splits
), timed AS (
  SELECT DISTINCT 'med_events' AS table_name, r.field_name, r.ref_key, r.loaded_at,
    (SELECT count(*) FROM life l WHERE l.field_name = r.field_name AND l.ref_key = r.ref_key) AS n_all,
    (SELECT count(*) FROM life l WHERE l.field_name = r.field_name AND l.ref_key = r.ref_key AND l.s <= r.loaded_at) AS n_old,
    (SELECT count(*) FROM life l WHERE l.field_name = r.field_name AND l.ref_key = r.ref_key AND l.s <= r.loaded_at
       AND (l.e IS NULL OR l.e > r.loaded_at)) AS n_live
  FROM refs r
), state AS (
  SELECT concept_id, bool_or(invalid_reason IS NULL OR trim(invalid_reason) = '') AS valid FROM concept GROUP BY concept_id
), cases AS (
  SELECT r.field_name, r.ref_key, r.loaded_at, t.table_name,
         CASE WHEN t.n_all = 0 THEN 'missing' WHEN t.n_old > 0 THEN 'deleted' ELSE 'late' END AS kind
  FROM refs r JOIN timed t USING (field_name, ref_key, loaded_at) WHERE t.n_live = 0
  UNION ALL
  SELECT 'descendant_concept_id', CAST(a.descendant_concept_id AS VARCHAR), a.loaded_at, 'concept_ancestor',
         CASE WHEN s.concept_id IS NULL THEN 'missing' ELSE 'deleted' END
  FROM concept_ancestor a LEFT JOIN state s ON s.concept_id = a.descendant_concept_id
  WHERE a.descendant_concept_id IS NOT NULL AND (s.concept_id IS NULL OR NOT s.valid)
)
"""
_PERIOD = "strftime(loaded_at, '%Y-%m') AS period"


def _quantiles(field: str) -> str:
    asked = ", ".join(f"quantile_disc(numeric_value, {p}) AS q{round(p * 100)}" for p in (0.25, 0.5, 0.75))
    return f"""SELECT '{field}' AS key_field, CAST({field} AS VARCHAR) AS key_value, count(*) AS n_rows,
count(numeric_value) AS n_values, {asked} FROM med_events WHERE {field} IS NOT NULL GROUP BY {field}"""


def _heavy(field: str) -> str:
    return f"""SELECT '{field}' AS key_field, CAST({field} AS VARCHAR) AS key_value FROM med_events WHERE {field} IS NOT NULL
GROUP BY {field} HAVING count(*) * 100 >= (SELECT count(*) FROM med_events)"""


ORACLE = {
    "p1_found": f"""{_LINKS}, {_down("roots")}, {_REACH}
SELECT hierarchy, node, root, depth FROM down UNION ALL SELECT hierarchy, node, 'CYCLE', -1 FROM reach WHERE node = top""",
    "p1_paths": f"""{_LINKS}, {_down("roots", ", [root]", ", min(list_append(d.path, l.child))", ", path")}
SELECT hierarchy, node, root, depth, array_to_string(path, ' > ') AS path FROM down""",
    "p1_links": f"""{_LINKS}, {_down("roots")}, {_WAYS}
SELECT c.hierarchy, c.root, c.node, c.depth, l.parent, w.n AS n_paths FROM down c JOIN links l ON l.hierarchy = c.hierarchy AND l.child = c.node
JOIN ways w ON w.hierarchy = c.hierarchy AND w.node = l.parent AND w.root = c.root AND w.depth + 1 = c.depth""",
    "p1_descendants": f"""{_LINKS}, {_down("tops")}
SELECT hierarchy, root AS ancestor, node AS descendant, depth AS min_levels FROM down WHERE depth > 0""",
    "p3_table": _ONCE + f""", found AS (
  SELECT p.subject_id, p.index_time, f.feature_no AS no, ev.t, ev.cents FROM points p
  LEFT JOIN (ev JOIN feature_codes f USING (code)) ON ev.subject_id = p.subject_id AND ev.t < p.index_time)
SELECT subject_id, index_time,
{_FEATURES}
FROM found GROUP BY subject_id, index_time""",
    "p3_found": _ONCE + """
SELECT p.subject_id, ev.code, count(*) AS n_events,
       CAST(floor(epoch(p.index_time - max(ev.t)) / 86400) AS BIGINT) AS days_since_last,
       CAST(sum(ev.cents) AS BIGINT) AS total_cents
FROM points p JOIN ev ON ev.subject_id = p.subject_id AND ev.t < p.index_time
WHERE ev.code IN (SELECT code FROM feature_codes)
GROUP BY p.subject_id, p.index_time, ev.code""",
    "p3_windows": _ONCE + _WINDOWS,
    "p4_found": _heavy("code") + "\nUNION ALL\n" + _heavy("subject_id"),
    "p4_quantiles": _quantiles("code") + "\nUNION ALL\n" + _quantiles("subject_id"),
    "p5_found": _ORPHANS + f"SELECT DISTINCT table_name, field_name, ref_key, {_PERIOD}, kind FROM cases",
    "p5_counts": _ORPHANS
    + f"""SELECT table_name, field_name, {_PERIOD}, kind, count(*) AS n_rows, count(DISTINCT ref_key) AS n_keys
FROM cases GROUP BY ALL""",
}

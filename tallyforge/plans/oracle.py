"""SQL for DuckDB with the same results as ``queries``."""

from __future__ import annotations

from . import bridge
from .queries import SEGMENTS


def _same(left: str, right: str, keys: list[str]) -> str:
    return " AND ".join(f"{left}.{k} IS NOT DISTINCT FROM {right}.{k}" for k in keys)


def _counts(wide: list[str]) -> list[tuple[str, str]]:
    """(name, aggregate) of total and split counts."""
    found = [("event_count", "count(*)"), ("subject_count", "count(DISTINCT subject_id)")]
    for value in wide:
        where = f"FILTER (WHERE split = '{value}')"
        found += [(f"event_count_{value.lower()}", f"count(*) {where}"), (f"subject_count_{value.lower()}", f"count(DISTINCT subject_id) {where}")]
    return found


def _released(wide: list[str], min_split: int, multiple: int | None) -> str:
    """Released columns: masked cells first, then rounding."""
    made = []
    for name, _ in _counts(wide):
        value = name
        if min_split > 1 and name.count("_") > 1:
            value = f"CASE WHEN {name.replace('event', 'subject')} >= {min_split} THEN {name} END"
        if multiple:
            value = f"(({value}) + {multiple // 2}) // {multiple} * {multiple}"
        made.append(f"CAST({value} AS BIGINT) AS {name}")
    return ", ".join(made)


def catalog(
    events: str,
    least: int,
    keys: tuple[str, ...] = ("code",),
    scope: tuple[str, ...] = (),
    label: str = "__RARE__",
    drop: bool = False,
    multiple: int | None = None,
    metadata: tuple[str, list[str]] | None = None,
    splits: str | None = None,
    wide: list[str] | None = None,
    min_split: int = 1,
    listed: bool = True,
) -> str:
    wide, all_keys = wide or [], [*scope, *keys]
    sums = ", ".join(f"{a} AS {n}" for n, a in _counts(wide))
    source = f"SELECT e.*, s.split FROM ({events}) e LEFT JOIN ({splits}) s USING (subject_id)" if splits else events
    plain = [c for c in (metadata[1] if metadata else []) if c not in keys]
    text = {c: _joined(f"m.{c}") if listed and c == "parent_codes" else f"m.{c}" for c in plain}
    shown = "".join(f"{text[c]} AS {c}, " for c in plain)
    join = f"LEFT JOIN ({metadata[0]}) m ON {_same('c', 'm', list(keys))}" if plain else ""
    released = _released(wide, min_split, multiple)
    names = ", ".join(f"c.{k}" for k in all_keys)
    sql = f"""
WITH ev AS ({source}), counts AS (SELECT {", ".join(all_keys)}, {sums} FROM ev GROUP BY ALL),
rare AS (SELECT * FROM counts WHERE subject_count < {least}),
bucket AS (SELECT {"".join(f"{s}, " for s in scope)}{sums} FROM ev
  WHERE EXISTS (SELECT 1 FROM rare r WHERE {_same('r', 'ev', all_keys)})
  {"GROUP BY " + ", ".join(scope) if scope else ""} HAVING count(DISTINCT subject_id) >= {least})
SELECT {names}, {shown}{released}, false AS is_masked FROM counts c {join} WHERE subject_count >= {least}"""
    if drop:
        return sql
    blank = "".join(f"NULL AS {c}, " for c in [*keys[1:], *plain])
    return f"{sql}\nUNION ALL\nSELECT {''.join(f'{s}, ' for s in scope)}'{label}' AS code, {blank}{released}, true AS is_masked FROM bucket"


def _wide_sql(min_split: int) -> str:
    return catalog(bridge.ORDERS, 30, splits=bridge.SEGMENTS, wide=SEGMENTS, min_split=min_split)


def _occurrences(events: str, keys: str) -> str:
    return f"SELECT {keys}, count(*) AS event_count, count(DISTINCT subject_id) AS subject_count FROM ({events}) GROUP BY ALL"


_EDGES = """
edges AS (SELECT DISTINCT ancestor_concept_id AS ancestor, descendant_concept_id AS descendant,
  CAST(min_levels_of_separation AS BIGINT) AS level FROM concept_ancestor a
  WHERE min_levels_of_separation > 0 AND ancestor_concept_id <> descendant_concept_id AND NOT EXISTS (
    SELECT 1 FROM concept_ancestor r WHERE r.ancestor_concept_id = a.descendant_concept_id
    AND r.descendant_concept_id = a.ancestor_concept_id AND r.min_levels_of_separation > 0))"""
_VOCABULARY = f"all_concepts AS ({bridge.CONCEPTS}), valid AS (SELECT * FROM all_concepts WHERE invalid_reason IS NULL)"
_RELATED = "string_agg(DISTINCT v.vocabulary_id || '//' || v.concept_code, '|' ORDER BY v.vocabulary_id || '//' || v.concept_code)"


def _above(ids: str) -> str:
    return f"SELECT i.concept_id, e.ancestor AS related FROM {ids} i JOIN edges e ON e.descendant = i.concept_id"


def _below(ids: str, depth: int) -> str:
    return f"SELECT i.concept_id, e.descendant AS related FROM {ids} i JOIN edges e ON e.ancestor = i.concept_id AND e.level <= {depth}"


def _beside(ids: str) -> str:
    return f"""SELECT i.concept_id, d.descendant AS related FROM {ids} i JOIN edges u ON u.descendant = i.concept_id
  JOIN edges d ON d.ancestor = u.ancestor AND d.level = 1
  WHERE u.ancestor IN (SELECT concept_id FROM valid) AND d.descendant <> i.concept_id"""


def _listed(pairs: str, name: str) -> str:
    return f"SELECT p.concept_id, {_RELATED} AS {name} FROM ({pairs}) p JOIN valid v ON v.concept_id = p.related GROUP BY p.concept_id"


def _relation(make: str, name: str) -> str:
    ids = "ids AS (SELECT DISTINCT concept_id FROM all_concepts)"
    return f"WITH {_VOCABULARY}, {_EDGES}, {ids} {_listed(make, name)}"


def _candidates(frame: str, references: bool = True) -> str:
    """CTEs from the codes of ``frame`` to ``cand``."""
    parts = "string_split(code, '//')"
    sql = f"""
tries AS (
  SELECT code AS target_code, {parts}[1] AS vocabulary_id, {parts}[2] AS concept_code, 0 AS rank FROM {frame}
  UNION ALL
  SELECT code, {parts}[1], {parts}[3], 1 FROM {frame} WHERE len({parts}) = 3"""
    if references:
        sql += f"""
  UNION ALL
  SELECT code, p[1], p[2], 2 FROM (SELECT code, CASE WHEN contains(r, '//') THEN string_split(r, '//') ELSE string_split(r, '/') END AS p
    FROM (SELECT code, list_filter(parent_codes, lambda x: x IS NOT NULL)[1] AS r FROM {frame}))"""
    return sql + """
), cand AS (SELECT DISTINCT * FROM tries WHERE vocabulary_id <> '' AND concept_code <> '')"""


_BEST = """
hits AS (SELECT c.target_code, c.rank, v.concept_name AS description, v.vocabulary_id, v.concept_id, v.concept_code, v.domain_id,
  v.standard_concept FROM cand c JOIN valid v USING (vocabulary_id, concept_code)),
ranked AS (SELECT *, min(rank) OVER (PARTITION BY target_code) AS r FROM hits),
chosen AS (SELECT *, min(concept_id) OVER (PARTITION BY target_code) AS c FROM ranked WHERE rank = r),
best AS (SELECT DISTINCT * EXCLUDE (r, c) FROM chosen WHERE concept_id = c)"""

_SLASH = "list_transform({p}, lambda e: CASE WHEN length(e) - length(replace(e, '/', '')) = 1 THEN replace(e, '/', '//') ELSE e END)"


def _distinct(items: str) -> str:
    """Each value once in the order of first appearance; one null at most."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i OR (x IS NULL AND len(list_filter(({items})[1:i-1], lambda y: y IS NULL)) = 0))"


def _joined(items: str) -> str:
    return f"CASE WHEN {items} IS NOT NULL THEN coalesce(array_to_string({items}, '|'), '') END"


_META = "meta AS (SELECT code, description, parent_codes, entry_id FROM codes)"
_LISTS = f"""ids AS (SELECT DISTINCT concept_id FROM best), pa AS ({_listed(_above('ids'), 'incoming')}),
ch AS ({_listed(_below('ids', 3), 'child_codes')}), si AS ({_listed(_beside('ids'), 'sibling_codes')})"""
_OWN = f"""own AS (SELECT m.entry_id, m.code, m.description AS d, b.*, pa.incoming, ch.child_codes, si.sibling_codes,
  {_SLASH.format(p='m.parent_codes')} AS old FROM meta m LEFT JOIN best b ON b.target_code = m.code
  LEFT JOIN pa USING (concept_id) LEFT JOIN ch USING (concept_id) LEFT JOIN si USING (concept_id)),
cut AS (SELECT *, CASE WHEN rank = 2 THEN old[2:] ELSE old END AS kept,
  CASE WHEN rank = 2 THEN len(old) > 1 OR incoming IS NOT NULL ELSE old IS NOT NULL OR incoming IS NOT NULL END AS present FROM own),
both_lists AS (SELECT *, list_concat(coalesce(kept, []), coalesce(string_split(incoming, '|'), [])) AS merged FROM cut),
made AS (SELECT entry_id, code, coalesce(d, description) AS description,
  CASE WHEN present THEN {_joined(_distinct('merged'))} END AS parent_codes, child_codes, sibling_codes, vocabulary_id, concept_id, concept_code,
  domain_id, standard_concept FROM both_lists)"""
_ENRICHED = f"WITH {_META}, {_VOCABULARY}, {_EDGES}, {_candidates('meta')}, {_BEST}, {_LISTS}, {_OWN}"
_FIELDS = ["description", "parent_codes", "child_codes", "sibling_codes", "vocabulary_id", "concept_id", "concept_code", "domain_id", "standard_concept"]
_COVERED = ", ".join(f"count({f}) AS {f}" for f in _FIELDS)
_UNCOVERED = ", ".join(f"count({f}) AS {f}" if f in ("description", "parent_codes") else f"0 AS {f}" for f in _FIELDS)
_MED_RARE = """SELECT code, modifier FROM med_events GROUP BY ALL HAVING count(DISTINCT subject_id) {test}"""
_SPLIT_KEY = "coalesce(nullif(lower(trim(regexp_replace(split, '\\W+', '_', 'g'), '_')), ''), 'unnamed')"
_CATALOG_META = (bridge.MED_META, ["code", "modifier", "description", "parent_codes", "entry_id"])
_FILE_SPLITS = """SELECT subject_id, CASE trim(s.split) WHEN 'TRAIN' THEN 'train' WHEN 'held-out' THEN 'held_out' ELSE coalesce(trim(s.split), 'none') END AS split
FROM (SELECT DISTINCT subject_id FROM med_events) LEFT JOIN (SELECT subject_id, min(split) AS split FROM subject_splits GROUP BY subject_id) s USING (subject_id)"""
_FILE_CATALOG = f"""SELECT *, row_number() OVER (ORDER BY code NULLS FIRST, modifier NULLS FIRST) - 1 AS place FROM ({
    catalog(bridge.MED, 10, ("code", "modifier"), multiple=5, metadata=_CATALOG_META, splits=_FILE_SPLITS,
            wide=["held_out", "none", "train", "tuning"], min_split=6)})"""
_BLANKS = ", ".join(f"nullif({c}, '') AS {c}" for c in ("concept_name", "domain_id", "vocabulary_id", "concept_code", "standard_concept", "invalid_reason"))
_FILE_CTES = _ENRICHED.replace(bridge.CONCEPTS, f"SELECT * REPLACE ({_BLANKS}) FROM concept")  # an export has no blank but null
_PLACED = "SELECT *, row_number() OVER (ORDER BY entry_id) - 1 AS place FROM made"
_CSV_META = _META.replace("parent_codes", f"string_split({_joined('parent_codes')}, '|') AS parent_codes")  # as CSV holds lists
_FILE_ENRICHED = {"parquet": f"{_FILE_CTES} {_PLACED}", "ndjson": f"{_FILE_CTES} {_PLACED}", "csv": f"{_FILE_CTES.replace(_META, _CSV_META)} {_PLACED}"}

ORACLE = {
    "code_counts": _occurrences(bridge.STREAM, "code"),
    "code_counts_modifiers": _occurrences(bridge.MED, "code, modifier"),
    "code_counts_splits": f"""
SELECT code, count(*) AS event_count, count(DISTINCT coalesce(subject_id, -1)) AS subject_count,
  count(*) FILTER (WHERE split = 'train') AS event_count_train,
  count(DISTINCT subject_id) FILTER (WHERE split = 'train') AS subject_count_train,
  count(*) FILTER (WHERE split = 'held_out') AS event_count_held_out,
  count(DISTINCT subject_id) FILTER (WHERE split = 'held_out') AS subject_count_held_out,
  CAST(0 AS BIGINT) AS event_count_no_such_split, CAST(0 AS BIGINT) AS subject_count_no_such_split,
  count(*) FILTER (WHERE split IS NULL) AS _missing_split_count
FROM ({bridge.MED}) LEFT JOIN ({bridge.MED_SPLITS}) USING (subject_id) GROUP BY code""",
    "summary_bucket": catalog(bridge.STREAM, 20),
    "summary_drop": catalog(bridge.ORDERS, 30, drop=True),
    "summary_rounded": catalog(bridge.ORDERS, 30, label="OTHER", multiple=10),
    "summary_modifiers": catalog(bridge.BRANDS, 120, keys=("code", "modifier")),
    "summary_null_modifiers": catalog(
        bridge.MED, 10, keys=("code", "modifier"), metadata=_CATALOG_META
    ),
    "summary_long": catalog(bridge.ORDERS, 6, scope=("split",), splits=bridge.SEGMENTS),
    "summary_wide": _wide_sql(1),
    "summary_wide_masked": _wide_sql(7),
    "split_missing": f"""
SELECT code, count(*) AS _missing_split_count FROM ({bridge.MED}) LEFT JOIN ({bridge.MED_SPLITS}) USING (subject_id)
WHERE split IS NULL GROUP BY code""",
    "metadata_join": catalog(bridge.ORDERS, 30, metadata=(bridge.PARTS, ["code", "description", "parent_codes"])),
    "metadata_semijoin": f"""
SELECT code, modifier, entry_id FROM ({bridge.MED_META}) m WHERE EXISTS (
  SELECT 1 FROM ({_MED_RARE.format(test='>= 10')}) c WHERE {_same('c', 'm', ['code', 'modifier'])})""",
    "dup_key_check": "SELECT code, modifier, count(*) AS n_rows FROM codes GROUP BY ALL HAVING count(*) > 1",
    "dup_split_check": "SELECT subject_id, count(*) AS n_rows FROM subject_splits GROUP BY ALL HAVING count(*) > 1",
    "rare_keys_events": f"""
SELECT subject_id, count(*) AS rare_events FROM med_events e WHERE EXISTS (
  SELECT 1 FROM ({_MED_RARE.format(test='< 20')}) r WHERE {_same('r', 'e', ['code', 'modifier'])}) GROUP BY subject_id""",
    "split_names": f"""
SELECT DISTINCT split, 'event_count_' || {_SPLIT_KEY} AS event_column, 'subject_count_' || {_SPLIT_KEY} AS subject_column FROM subject_splits""",
    "candidates": f"WITH {_META}, {_candidates('meta')} SELECT * FROM cand",
    "concept_match": f"WITH {_META}, {_VOCABULARY}, {_candidates('meta')}, {_BEST} SELECT * FROM best",
    "hierarchy_clean": f"WITH {_EDGES} SELECT * FROM edges",
    "parents": _relation(_above("ids"), "parent_codes"),
    "children_depth": _relation(_below("ids", 2), "child_codes"),
    "siblings": _relation(_beside("ids"), "sibling_codes"),
    "enrich_merge": f"{_ENRICHED} SELECT * FROM made",
    "catalog_enriched": f"""
WITH rows_ AS (SELECT *, row_number() OVER () AS row_ FROM ({catalog(bridge.MED, 10, ("code", "modifier"), metadata=_CATALOG_META, listed=False)})),
meta AS (SELECT code, description, parent_codes, row_ AS entry_id FROM rows_ WHERE NOT is_masked),
{_VOCABULARY}, {_EDGES}, {_candidates('meta')}, {_BEST}, {_LISTS}, {_OWN}
SELECT r.code, r.modifier, coalesce(m.description, r.description) AS description, m.parent_codes, r.entry_id, r.event_count, r.subject_count,
  r.is_masked, m.child_codes, m.sibling_codes, m.vocabulary_id, m.concept_id, m.concept_code, m.domain_id, m.standard_concept
FROM rows_ r LEFT JOIN made m ON m.entry_id = r.row_""",
    "coverage_report": f"""{_ENRICHED}
SELECT 'before' AS state, count(*) AS rows, count(DISTINCT code) AS unique_codes, {_UNCOVERED}, 0 AS matched_codes FROM meta
UNION ALL
SELECT 'after', count(*), count(DISTINCT code), {_COVERED}, count(DISTINCT code) FILTER (WHERE concept_id IS NOT NULL) FROM made""",
    "csv_flatten": f"""
SELECT entry_id, {_joined('parent_codes')} AS parent_codes,
  '{{"id":' || entry_id || ',"c":' || CAST(to_json(code) AS VARCHAR) || '}}' AS nested FROM codes""",
    "list_functions": f"""
SELECT entry_id, {_joined(_SLASH.format(p='parent_codes'))} AS doubled, {_joined('parent_codes[2:]')} AS rest,
  {_joined(_distinct("list_concat(coalesce(parent_codes, []), [code, 'X//1'])"))} AS merged,
  CASE WHEN len(parent_codes) > 0 THEN CAST(len(parent_codes) AS INTEGER) END AS n_non_empty,
  list_filter(parent_codes, lambda x: x IS NOT NULL)[1] AS first_reference,
  CASE WHEN contains(parent_codes[1], '//') THEN string_split(parent_codes[1], '//')[2] ELSE string_split(parent_codes[1], '/')[2] END
    AS second_part
FROM codes""",
    "split_cell_mask": f"""
WITH ev AS (SELECT * FROM ({bridge.BRANDS}) LEFT JOIN ({bridge.SEGMENTS}) USING (subject_id)),
c AS (SELECT code, modifier, {", ".join(f"{a} AS {n}" for n, a in _counts(SEGMENTS))} FROM ev GROUP BY code, modifier)
SELECT code, modifier, {_released(SEGMENTS, 20, 5)} FROM c""",
}
ORACLE |= {f"summarize_{s}": _FILE_CATALOG for s in ("parquet", "csv", "json", "jsonl")}
ORACLE |= {f"enrich_file_{s}": sql for s, sql in _FILE_ENRICHED.items()}

"""Declared core schemas and the check of Parquet footers against them (no data is read)."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

import pyarrow as pa

#: name -> (Arrow type, required)
EVENTS = {
    "subject_id": (pa.int64(), True),
    "time": (pa.timestamp("us"), True),
    "code": (pa.string(), True),
    "numeric_value": (pa.float32(), False),
    "text_value": (pa.string(), False),
}
CODES = {
    "code": (pa.string(), True),
    "description": (pa.string(), False),
    "parent_codes": (pa.list_(pa.string()), False),
}
SPLITS = {"subject_id": (pa.int64(), True), "split": (pa.string(), True)}
CORE_EVENT_COLUMNS = [name for name, (_, required) in EVENTS.items() if required]
#: Known fields of the dataset descriptor, by kind; all may be absent, others are allowed
DESCRIPTOR = {
    "text": ["dataset_name", "dataset_version", "etl_name", "etl_version", "meds_version", "license", "location_uri", "description_uri"],
    "time": ["created_at"],
    "names": ["extension_columns", "raw_source_id_columns", "additional_value_modality_columns", "site_id_columns", "other_extension_columns"],
}


def _is_time(value: object) -> bool:
    try:
        return datetime.fromisoformat(value) is not None if isinstance(value, str) else False
    except ValueError:
        return False


_KINDS = {
    "text": ("a string", lambda v: isinstance(v, str)),
    "time": ("an ISO 8601 time", _is_time),
    "names": ("a list of strings", lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)),
}


def descriptor_faults(found: object) -> list[str]:
    """What is wrong with the fields of a dataset descriptor; null counts as absent."""
    if not isinstance(found, dict):
        return ["it must be an object"]
    wanted = [(name, *_KINDS[kind]) for kind, names in DESCRIPTOR.items() for name in names]
    return [f"{name} must be {what}" for name, what, holds in wanted if found.get(name) is not None and not holds(found[name])]


def is_text(kind: pa.DataType) -> bool:
    return pa.types.is_string(kind) or pa.types.is_large_string(kind)


def same_kind(found: pa.DataType, wanted: pa.DataType) -> bool:
    """Equal but for the width of offsets (string and large_string, list and large_list)."""
    if is_text(wanted):
        return is_text(found)
    if pa.types.is_list(wanted):
        is_list = pa.types.is_list(found) or pa.types.is_large_list(found)
        return is_list and same_kind(found.value_type, wanted.value_type)
    return found.equals(wanted)


def check_footer(path: Path | str, schema: pa.Schema, declared: dict) -> None:
    """``ValueError`` naming the file when required columns lack or a type differs."""
    missing = [n for n, (_, required) in declared.items() if required and n not in schema.names]
    wrong = [
        f"{n}: {schema.field(n).type}, expected {kind}"
        for n, (kind, _) in declared.items()
        if n in schema.names and not same_kind(schema.field(n).type, kind)
    ]
    faults = [f"missing columns {missing}"] * bool(missing) + [f"columns with incorrect types ({'; '.join(wrong)})"] * bool(wrong)
    if faults:
        raise ValueError(f"Invalid MEDS schema in {path}: {', '.join(faults)}")

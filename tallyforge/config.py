"""Settings of a catalog run: fields that carry their own rule, and a strict YAML loader."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any, NamedTuple

import yaml


class Rule(NamedTuple):
    """What a value must be, and how the error says so after the field's name."""

    holds: Callable[[Any], bool]
    says: str


def _whole(value: Any, least: int = 1, most: float = float("inf")) -> bool:
    return type(value) is int and least <= value <= most


#: Wording of the errors
FLAG = Rule(lambda v: type(v) is bool, "must be true or false")
COUNT = Rule(_whole, "must be a positive integer")
MULTIPLE = Rule(lambda v: v is None or _whole(v), "must be null or a positive integer")
DEPTH = Rule(lambda v: _whole(v, 1, 100), "must be an integer from 1 to 100")
FOLDER = Rule(lambda v: v is None or isinstance(v, str | Path) and bool(str(v).strip()), "must be a path")
LOGIN = Rule(lambda v: v is None or isinstance(v, str) and bool(v.strip()), "must be a non-empty string")
ACTION = Rule(lambda v: v in ("bucket", "drop"), "must be 'bucket' or 'drop'")
LABEL = Rule(bool, "must not be empty")
NESTED = Rule(lambda v: v is None or isinstance(v, EnrichmentConfig), "must be an EnrichmentConfig")
ONE_SOURCE = "set exactly one of enrichment.csv_dir or enrichment.postgres"
ONE_MODE = "per_split and split_columns are mutually exclusive"
BOTH_FLAGS = "per_split and split_columns must be true or false"
NO_COVER = "YAML section {!r} must be a mapping"


def ruled(default: Any, rule: Rule, section: str) -> Any:
    """A dataclass field with its rule and the YAML section it belongs into."""
    return field(default=default, metadata={"rule": rule, "section": section})


class Settings:
    """Checks every field against its rule; ``SAID_AS`` renames a field in errors."""

    SAID_AS = "{}"

    def __post_init__(self) -> None:
        for item in fields(self):
            rule = item.metadata["rule"]
            if not rule.holds(getattr(self, item.name)):
                raise ValueError(self.complaint(item.name, rule))

    def complaint(self, name: str, rule: Rule) -> str:
        return f"{self.SAID_AS.format(name)} {rule.says}"

    def with_overrides(self, **values: Any):
        """A copy with every given value that is not ``None``."""
        return replace(self, **{k: v for k, v in values.items() if v is not None})


@dataclass(frozen=True)
class EnrichmentConfig(Settings):
    """Where the vocabulary comes from (exactly one source) and which lists to add."""

    SAID_AS = "enrichment.{}"

    csv_dir: Path | None = ruled(None, FOLDER, "enrichment")
    postgres: str | None = ruled(None, LOGIN, "enrichment")
    parent_codes: bool = ruled(True, FLAG, "enrichment")
    child_codes: bool = ruled(False, FLAG, "enrichment")
    sibling_codes: bool = ruled(False, FLAG, "enrichment")
    child_depth: int = ruled(3, DEPTH, "enrichment")
    exclude_self_parent_code: bool = ruled(True, FLAG, "enrichment")

    def __post_init__(self) -> None:
        if [self.csv_dir, self.postgres].count(None) != 1:
            raise ValueError(ONE_SOURCE)
        super().__post_init__()
        if self.postgres is None:
            object.__setattr__(self, "csv_dir", Path(self.csv_dir))


@dataclass(frozen=True)
class SummaryConfig(Settings):
    """Grouping and release rules of a catalog.

    ``min_subjects`` is compared with distinct subjects, never with event rows.
    ``partitions`` is the shuffle width of the subject-level aggregate.
    """

    per_split: bool = ruled(False, FLAG, "summary")
    split_columns: bool = ruled(False, FLAG, "summary")
    partitions: int = ruled(256, COUNT, "summary")
    min_subjects: int = ruled(20, COUNT, "privacy")
    min_split_subjects: int = ruled(1, COUNT, "privacy")
    rare_code_action: str = ruled("bucket", ACTION, "privacy")
    rare_code_label: str = ruled("__RARE__", LABEL, "privacy")
    round_counts_to: int | None = ruled(None, MULTIPLE, "privacy")
    enrichment: EnrichmentConfig | None = ruled(None, NESTED, "")

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.per_split and self.split_columns:
            raise ValueError(ONE_MODE)

    def complaint(self, name: str, rule: Rule) -> str:
        return BOTH_FLAGS if rule is FLAG else super().complaint(name, rule)

    @classmethod
    def from_yaml(cls, path: str | Path) -> SummaryConfig:
        """Read ``summary``, ``privacy`` and ``enrichment`` sections; anything else is an error.

        A relative ``csv_dir`` is taken from the folder of the YAML file; an empty
        ``enrichment`` section switches enrichment off.
        """
        path = Path(path)
        home = {f.name: f.metadata["section"] for kind in (cls, EnrichmentConfig) for f in fields(kind)}
        given = _sections(path, {s for s in home.values() if s})
        astray = sorted(name for section, options in given.items() for name in options if home.get(name) != section)
        if astray:
            raise ValueError(f"Unknown configuration options or wrong sections: {astray}")
        vocabulary = given.pop("enrichment")
        own = {name: value for options in given.values() for name, value in options.items()}
        if not vocabulary:
            return cls(**own)
        if (folder := vocabulary.get("csv_dir")) is not None:
            if not isinstance(folder, str):
                raise ValueError(f"enrichment.csv_dir {FOLDER.says}")
            vocabulary = {**vocabulary, "csv_dir": path.parent.joinpath(folder)}  # an absolute folder stays as it is
        return cls(**own, enrichment=EnrichmentConfig(**vocabulary))


def _sections(path: Path, names: set[str]) -> dict[str, dict[str, Any]]:
    """The sections of a YAML file, empty where absent."""
    document = yaml.safe_load(path.read_text())
    if document is None:
        document = {}
    if not isinstance(document, dict):
        raise ValueError(f"YAML root must be a mapping: {path}")
    if unknown := sorted(document.keys() - names):
        raise ValueError(f"Unknown YAML sections: {unknown}")
    found = {name: {} if document.get(name) is None else document[name] for name in sorted(names)}
    for name, options in found.items():
        if not isinstance(options, dict):
            raise ValueError(NO_COVER.format(name))
    return found

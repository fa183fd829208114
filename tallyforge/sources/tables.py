"""Standalone tables: Parquet, CSV, JSON array and NDJSON, read lazily and written as ONE file."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Sequence
from contextlib import contextmanager
from pathlib import Path
from uuid import uuid4

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import session

#: Suffix and format
FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "ndjson", ".ndjson": "ndjson"}


#: What Spark's reader takes an empty, unquoted cell for; no text holds it.
_NO_CELL = "\x00\x00"


def output_format(path: str | Path) -> str:
    """Format that the suffix names, in any case."""
    suffix = Path(path).suffix
    if suffix.lower() not in FORMATS:
        raise ValueError(f"unsupported output suffix {suffix!r}; use one of {', '.join(FORMATS)}")
    return FORMATS[suffix.lower()]


def _first_record_order(path: Path, lines: bool) -> list[str]:
    """Key order of the first record; Spark's JSON reader would sort the columns."""
    with path.open(encoding="utf-8-sig") as file:
        if lines:
            first = next((x for x in file if x.strip()), "{}")
            return list(json.loads(first))
        decoder, text = json.JSONDecoder(), ""
        while block := file.read(1 << 16):
            text += block
            body = text.lstrip().removeprefix("[").lstrip()
            if body[:1] == "{":
                try:
                    return list(decoder.raw_decode(body)[0])
                except json.JSONDecodeError:
                    continue
    return []


def scan_table(path: str | Path, spark: SparkSession | None = None) -> DataFrame:
    """Read a table by its suffix.

    CSV: header, RFC-4180 quotes, empty cells are null and quoted empty ones blank. Numbers and
    Booleans are inferred; dates and times stay text as they stand, and so do the text columns ``code``, ``concept_code``,
    ``vocabulary_id`` and ``description`` (``02`` is not 2). JSON columns keep the order of the first record.
    """
    path = Path(path).expanduser().resolve()
    kind = output_format(path)
    if not path.is_file():
        raise FileNotFoundError(f"table not found: {path}")
    if path.name[0] in "._":
        raise ValueError(f"Spark would skip this file, rename it: {path}")
    read = session(spark).read
    if kind == "parquet":
        return read.parquet(str(path))
    if kind == "csv":
        options = {"header": True, "escape": '"', "multiLine": True, "nullValue": _NO_CELL, "emptyValue": ""}
        typed = read.options(**options, inferSchema=True, prefersDate=False).csv(str(path)).schema
        text = {"code", "concept_code", "vocabulary_id", "description"}
        kept = (T.NumericType, T.BooleanType)
        wanted = T.StructType(
            [T.StructField(f.name, f.dataType if isinstance(f.dataType, kept) and f.name not in text else T.StringType()) for f in typed]
        )
        return read.options(**options).schema(wanted).csv(str(path))
    frame = read.option("multiLine", kind == "json").json(str(path))
    first = [n for n in _first_record_order(path, kind == "ndjson") if n in frame.columns]
    return frame.select(*[F.col(f"`{n}`") for n in [*first, *(c for c in frame.columns if c not in first)]])


def flatten_nested(frame: DataFrame) -> DataFrame:
    """Lists as ``a|b`` (null elements are left out), structs and maps as JSON; the rest as it is."""
    columns = []
    for field in frame.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType):
            inner = field.dataType.elementType
            if isinstance(inner, T.StructType | T.MapType | T.ArrayType):
                column = F.transform(column, lambda x: F.to_json(x))
            column = F.array_join(column.cast("array<string>"), "|").alias(field.name)
        elif isinstance(field.dataType, T.StructType | T.MapType):
            column = F.to_json(column).alias(field.name)
        columns.append(column)
    return frame.select(*columns)


def _write_part(frame: DataFrame, kind: str, folder: Path) -> None:
    writer = frame.write
    if kind == "parquet":
        writer.parquet(str(folder))
    elif kind == "csv":
        writer.options(header=True, escape='"', emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(str(folder))
    else:
        writer.option("ignoreNullFields", False).json(str(folder))


def _join_parts(parts: list[Path], kind: str, path: Path) -> None:
    """Stream the parts, in order, into one file; a row group or a line is in memory at a time."""
    if kind == "parquet":
        with pq.ParquetWriter(path, pq.read_schema(parts[0])) as target:
            for part in parts:
                for batch in pq.ParquetFile(part).iter_batches():
                    target.write_batch(batch)
        return
    with path.open("wb") as target:
        before = b"["
        for i, part in enumerate(parts):
            with part.open("rb") as lines:
                if kind == "csv" and i:  # the header of the first part is enough
                    lines.readline()
                if kind != "json":
                    shutil.copyfileobj(lines, target)
                    continue
                for line in filter(None, map(bytes.strip, lines)):
                    target.write(before + line)
                    before = b",\n"
        if kind == "json":
            target.write((b"[" if before == b"[" else b"") + b"]\n")


def sink_table(
    frame: DataFrame, path: str | Path, format_: str | None = None, order: Sequence[str] = (), hidden: Sequence[str] = ()
) -> None:
    """Write one file, rows ascending by ``order`` (nulls first), without the ``hidden`` columns.

    Tasks sort and write ranges side by side; as the contract is one file, the driver then streams them into it
    (a single range is only moved). Driver and executors must share the path's file system.
    """
    path = Path(path)
    kind = format_ or output_format(path)
    folder = path.with_name(f"{path.name}.{uuid4().hex}.parts")
    if order:
        frame = frame.orderBy(*[F.col(f"`{c}`").asc() for c in order])
    frame = frame.drop(*hidden)
    if kind == "csv":
        frame = flatten_nested(frame)
        if any("\n" in c or "\r" in c for c in frame.columns):
            raise ValueError("CSV column names must not contain line breaks")
    try:
        _write_part(frame, kind, folder)
        parts = [p for p in sorted(folder.iterdir()) if p.name.startswith("part-")]
        if len(parts) == 1 and kind != "json":
            shutil.move(parts[0], path)
        else:
            _join_parts(parts, kind, path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


@contextmanager
def replacing(output: Path):
    """A hidden sibling path to write; on success it replaces ``output``, on failure nothing changes."""
    staged = output.with_name(f".{output.name}.{uuid4().hex}.tmp{output.suffix}")
    try:
        yield staged
        os.replace(staged, output)
    finally:
        staged.unlink(missing_ok=True)

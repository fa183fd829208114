"""Fields that hold several values: dictionary-guided segmentation, one row per value.

The dictionary of known values comes from the whole table: fields and elements that hold one plain
value, and values of several names that quotes or parentheses hold together somewhere. A multi-pattern
automaton (Aho-Corasick) finds them in the packed fields; a dynamic program then picks the cover of the
field with the fewest characters outside known or quoted values, and of those the fewest values.
Grammar gives the remaining segments: a value is a vocabulary name (letters and blanks, a capital
first), ``//`` (in parent references also ``/``) and the rest, and ends before a run of delimiters that
a new value follows. So a delimiter inside a known value or quotes is protected, even if a name follows it.

Null fields, blank fields and empty slots give no value. Text without any vocabulary is one value.
Rows come out for every input row, also repeated ones; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Stash

#: Characters that can part two values
DELIMITERS = ";,|~^+\n\t\r"
#: Characters of packed fields per chunk, about.
CHUNK_CHARS = 4_000_000

_GAP = set(DELIMITERS + " ")
_NAME = {False: re.compile(r"[A-Z][A-Za-z ]*//"), True: re.compile(r"[A-Z][A-Za-z ]*//?")}
_QUOTES = "\"'"


def _starts_value(text: str, at: int, single: bool) -> bool:
    if text[at : at + 1] in _QUOTES and at < len(text):
        at += 1
    return bool(_NAME[single].match(text, at))


def _boundary(text: str, at: int, single: bool) -> bool:
    """At ``at`` the field ends, or a run of delimiters begins that the field's end or a new value follows."""
    n, i = len(text), at
    while i < n and text[i] in _GAP:
        i += 1
    if i == n:
        return True
    return any(c in DELIMITERS for c in text[at:i]) and _starts_value(text, i, single)


def _quoted(text: str, at: int, single: bool) -> int:
    """End of the quoted value that begins at ``at``, else -1; a doubled quote does not end it."""
    mark, n = text[at], len(text)
    if not _NAME[single].match(text, at + 1):
        return -1
    i = at + 1
    while i < n:
        if text[i] == mark:
            if i + 1 < n and text[i + 1] == mark:
                i += 2
                continue
            j = i + 1
            while j < n and text[j] == " ":
                j += 1
            return i + 1 if j == n or text[j] in DELIMITERS else -1
        i += 1
    return -1


def _plain_end(text: str, at: int, single: bool, nested: bool = False) -> int:
    """First boundary after ``at``; ``nested``: outside parentheses (one that never closes protects nothing)."""
    depth, n, closes, i = 0, len(text), text.rfind(")"), at + 1
    while i < n:
        c = text[i]
        if nested and c in "()":
            depth = max(0, depth + (1 if c == "(" else -1))
        elif c in _GAP:
            if (depth == 0 or i > closes) and _boundary(text, i, single):
                return i
            while i < n and text[i] in _GAP:  # the rest of the run is no boundary either
                i += 1
            continue
        i += 1
    return n


def frame_of(text: str) -> tuple[int, int]:
    """Where the values are: without surrounding blanks and one pair of square brackets."""
    a, b = 0, len(text)
    while a < b and text[a] in _GAP:
        a += 1
    while b > a and text[b - 1] in _GAP:
        b -= 1
    if b - a > 1 and text[a] == "[" and text[b - 1] == "]":
        a, b = a + 1, b - 1
    return a, b


def _cover(text: str, single: bool, known: dict[int, list[int]], nested: bool = False) -> list[tuple[str, bool]]:
    """(value, whether quotes or ``nested`` held it together) of the cheapest cover of a framed text."""
    n = len(text)
    best: list[tuple[int, int, int, int] | None] = [None] * (n + 1)  # unknown chars, values, from, kind
    best[0] = (0, 0, -1, 0)

    def offer(frm: int, to: int, cost: int, kind: int) -> None:
        unknown, count, _, _ = best[frm]
        new = (unknown + cost, count + (kind > 0), frm, kind)
        if best[to] is None or new[:2] < best[to][:2]:
            best[to] = new

    for i in range(n):
        if best[i] is None:
            continue
        if text[i] in _GAP:
            offer(i, i + 1, 0, 0)
            continue
        if text[i] in _QUOTES and (end := _quoted(text, i, single)) > 0:
            offer(i, end, 0, 2)
        for end in known.get(i, ()):
            if _boundary(text, end, single):
                offer(i, end, 0, 1)
        end = _plain_end(text, i, single, nested)
        offer(i, end, end - i, 1)
    values, at = [], n
    while at > 0:
        _, _, frm, kind = best[at]
        if kind:
            values.append((_clean(text[frm:at], kind == 2), kind == 2 or nested))
        at = frm
    return [v for v in reversed(values) if v[0]]


def segment(text: str, single: bool, known: dict[int, list[int]] | None = None) -> list[str]:
    """Values of one field in order. ``known``: start -> ends of known values in the framed text."""
    a, b = frame_of(text)
    return [v for v, _ in _cover(text[a:b], single, known or {})]


def _clean(value: str, quoted: bool) -> str:
    value = value.strip(DELIMITERS + " ")
    if quoted or (len(value) > 1 and value[0] in _QUOTES and value[-1] == value[0]):
        mark, value = value[0], value[1:-1]
        value = value.replace(mark * 2, mark).strip(DELIMITERS + " ")
    return value


def _names(text: str, single: bool) -> int:
    return len(_NAME[single].findall(text))


def _spans(text: str, single: bool, longest: int) -> Iterator[tuple[int, int]]:
    """Where a known value may stand: from a name to the next boundary, or to later ones at most ``longest`` characters away."""
    ends, i, n = [], 0, len(text)
    while i < n:
        if text[i] in _GAP:
            if _boundary(text, i, single):
                ends.append(i)
            while i < n and text[i] in _GAP:
                i += 1
        else:
            i += 1
    ends.append(n)
    first = 0
    for m in re.finditer(_NAME[single].pattern, text):
        start = m.start()
        if start and text[start - 1].isalnum():
            continue
        while ends[first] <= start:
            first += 1
        yield start, ends[first]
        for end in ends[first + 1 :]:
            if end - start > longest:
                break
            yield start, end


def _harvest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of several names that quotes or parentheses hold together."""
    for batch in batches:
        found = set()
        for field, texts in zip(batch["field"].to_pylist(), batch["texts"].to_pylist()):
            single = field == "parent_codes"
            for text in filter(None, texts):
                a, b = frame_of(text)
                whole = _cover(text[a:b], single, {}, nested=True)
                found.update(v for v, held in whole if held and _names(v, single) > 1)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["word"])


def _lookups(longest: int):
    """Distinct texts of a batch that could be known values, with the chunk of their field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for chunk, field, texts in zip(*(batch[c].to_pylist() for c in ("chunk", "field", "texts"))):
                single = field == "parent_codes"
                for text in filter(None, texts):
                    a, b = frame_of(text)
                    inner = text[a:b]
                    found.update((chunk, inner[i:j]) for i, j in _spans(inner, single, longest))
            chunks, words = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(words, pa.string())], ["chunk", "word"])

    return run


def _automaton(words: list[str]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for w in words:
        made.add_word(w, len(w))
    made.make_automaton()
    return made


def _hits(tree, text: str, single: bool) -> dict[int, list[int]]:
    """Start -> ends of the known values that begin a word and end at a boundary."""
    found: dict[int, list[int]] = {}
    if len(tree):
        for last, size in tree.iter(text):
            start = last + 1 - size
            if (start == 0 or not text[start - 1].isalnum()) and _boundary(text, last + 1, single):
                found.setdefault(start, []).append(last + 1)
    return found


def _split(fields: pa.Table, words: pa.Table) -> pa.Table:
    """One chunk of fields and the known values that occur in it: the values of each packed field."""
    tree = _automaton(words["word"].to_pylist())
    out: tuple[list, list, list, list] = ([], [], [], [])
    for entry, field, texts in zip(*(fields[c].to_pylist() for c in ("entry_id", "field", "texts"))):
        single, values, packed = field == "parent_codes", [], False
        for text in filter(None, texts):
            a, b = frame_of(text)
            inner = text[a:b]
            own = [v for v, _ in _cover(inner, single, _hits(tree, inner, single))]
            packed = packed or len(own) > 1
            values += own
        if packed:
            for pos, value in enumerate(values):
                for column, x in zip(out, (entry, field, pos, value)):
                    column.append(x)
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
    return pa.table([pa.array(x, t) for x, t in zip(out, kinds)], names=["entry_id", "field", "pos", "value"])


def packed_fields(codes: DataFrame) -> DataFrame:
    """``entry_id, field, texts`` of fields in which two or more vocabulary names occur."""
    several = F.regexp_count("code", F.lit(_NAME[False].pattern)) >= 2
    fields = codes.select("entry_id", F.lit("code").alias("field"), F.array("code").alias("texts")).filter(several)
    inside = lambda e: F.regexp_count(e, F.lit(_NAME[True].pattern)) >= 2
    lists = codes.filter(F.exists("parent_codes", inside)).select("entry_id", F.lit("parent_codes"), "parent_codes")
    return fields.union(lists)


def known_values(codes: DataFrame, fields: DataFrame) -> DataFrame:
    """Distinct ``word``: fields and elements that hold one plain value, and values of several names held together somewhere."""
    one = codes.select(F.trim("code").alias("word")).filter(F.regexp_count("word", F.lit(_NAME[False].pattern)) == 1)
    more = codes.select(F.explode("parent_codes").alias("e")).select(F.trim("e").alias("word"))
    more = more.filter(F.regexp_count("word", F.lit(_NAME[True].pattern)) == 1)
    plain = one.union(more).filter(F.col("word").rlike("^[A-Z]") & ~F.col("word").rlike(r"[;,|~^+\s]$"))
    return plain.union(fields.mapInArrow(_harvest, "word string")).distinct()


def unpack(codes: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """``entry_id, field, pos, value`` of each ``code`` and each whole ``parent_codes`` with a packed element.

    ``dictionary`` (``word``) is learned from all rows unless given. Python sees only fields in
    which two or more vocabulary names occur. These are dealt into chunks by hash; what could be a
    known value in a chunk is joined with the dictionary, and each chunk gets an automaton of its own hits. So neither the
    dictionary nor a hot vocabulary is ever in one place. A chunk's lookups grow with the length of the longest known value of several names.
    """
    stash = Stash(codes.sparkSession)
    chars = F.coalesce(F.sum(F.aggregate("texts", F.lit(0).cast("bigint"), lambda n, t: n + F.coalesce(F.length(t), F.lit(0)))), F.lit(0))
    fields, _ = stash.put(packed_fields(codes))
    size = fields.agg(chars.alias("n")).first()["n"]
    chunks = max(codes.sparkSession.sparkContext.defaultParallelism, 1 + size // CHUNK_CHARS)
    fields = fields.withColumn("chunk", F.pmod(F.xxhash64("entry_id", "field", "texts"), F.lit(chunks)).cast("int"))
    words = known_values(codes, fields) if dictionary is None else dictionary
    words, _ = stash.put(words)
    several = F.regexp_count("word", F.lit(_NAME[False].pattern)) > 1
    longest = words.filter(several).agg(F.coalesce(F.max(F.length("word")), F.lit(0)).alias("n")).first()["n"]
    asked = fields.mapInArrow(_lookups(longest), "chunk int, word string").distinct()
    hits = asked.join(words, "word", "left_semi").select("chunk", "word")
    both = fields.groupBy("chunk").cogroup(hits.groupBy("chunk"))
    return both.applyInArrow(_split, "entry_id bigint, field string, pos bigint, value string")

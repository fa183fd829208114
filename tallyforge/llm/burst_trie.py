"""Frequency of every distinct term by burst tries.

Each worker adds its terms to a burst trie: containers of suffixes that burst into a node per
next character when they grow too large. The subtrees are written compactly (front-coded
suffixes, variable-length counters). From the number of terms below every prefix the shared trie is
derived: a prefix with too many terms bursts, so routes are the shortest prefixes that do
not, adapted to the terms. Matching subtrees of all workers meet by route and are merged.

A frequent term is one entry per worker, so it can hold any share of the rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Stash

#: Terms per container before it bursts.
CONTAINER = 256
#: Distinct terms a worker's trie holds before its subtrees are written and it starts anew.
WORKER_TERMS = 300_000
#: Terms below a route (counted once per worker that has them).
ROUTE_TERMS = 100_000
#: Most bursting prefixes that are sent to all workers; beyond it routes grow instead.
MAX_BURSTING = 100_000
#: Ends the route of a term that is itself a bursting prefix.
_END = "\x00"

Counts = list[int]


class _Node:
    __slots__ = ("below", "end")

    def __init__(self) -> None:
        self.below: dict[str, _Node | dict[str, Counts]] = {}
        self.end: Counts | None = None


class BurstTrie:
    """Terms with two counters, occurrences and records."""

    def __init__(self, container: int = CONTAINER):
        self.most, self.top, self.size = container, {}, 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        holder, key, place, at = None, "", self.top, 0
        while isinstance(place, _Node):
            if at == len(term):
                if place.end is None:
                    place.end = [0, 0]
                    self.size += 1
                place.end[0] += occurrences
                place.end[1] += records
                return
            holder, key = place, term[at]
            place = holder.below.setdefault(key, {})
            at += 1
        found = place.get(term[at:])
        if found is None:
            self.size += 1
            place[term[at:]] = [occurrences, records]
            if len(place) > self.most:
                self._burst(holder, key, place)
        else:
            found[0] += occurrences
            found[1] += records

    def _burst(self, holder: _Node | None, key: str, place: dict[str, Counts]) -> None:
        node = _Node()
        for suffix, counts in place.items():
            if suffix:
                node.below.setdefault(suffix[0], {})[suffix[1:]] = counts
            else:
                node.end = counts
        if holder is None:
            self.top = node
        else:
            holder.below[key] = node

    def subtrees(self) -> Iterator[tuple[str, dict[str, Counts]]]:
        """Prefix and suffixes of each container; a node's own end has the suffix ``''``."""
        todo: list[tuple[str, _Node | dict[str, Counts]]] = [("", self.top)]
        while todo:
            prefix, place = todo.pop()
            if isinstance(place, _Node):
                if place.end is not None:
                    yield prefix, {"": place.end}
                todo += [(prefix + c, below) for c, below in place.below.items()]
            elif place:
                yield prefix, place


def _number(value: int, out: bytearray) -> None:
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)


def pack(suffixes: dict[str, Counts]) -> bytes:
    """Sorted suffixes, each as shared length, rest, and counters."""
    out, before = bytearray(), b""
    for text in sorted(suffixes):
        word = text.encode("utf-8", "surrogatepass")
        shared = 0
        for a, b in zip(before, word):
            if a != b:
                break
            shared += 1
        for value in (shared, len(word) - shared, *suffixes[text]):
            _number(value, out)
        out += word[shared:]
        before = word
    return zlib.compress(bytes(out), 1)


def unpack(block: bytes) -> Iterator[tuple[str, int, int]]:
    data, at, before = zlib.decompress(block), 0, b""
    while at < len(data):
        numbers = []
        for _ in range(4):
            value = shift = 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    break
            numbers.append(value)
        shared, rest, occurrences, records = numbers
        before = before[:shared] + data[at : at + rest]
        at += rest
        yield before.decode("utf-8", "surrogatepass"), occurrences, records


def _batch(rows: Iterable[tuple[str, int, bytes]], name: str) -> Iterator[pa.RecordBatch]:
    for some in itertools.batched(rows, 512):
        columns = zip(*some)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()))], [name, "n_terms", "block"]
        )


def _build(container: int, worker_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie(container)
        for batch in batches:
            once = pa.Table.from_batches([batch]).group_by("term").aggregate([("occurrences", "sum"), ("records", "sum")])
            for term, n, m in zip(*(once[c].to_pylist() for c in ("term", "occurrences_sum", "records_sum"))):
                trie.add(term, n, m)
            if trie.size >= worker_terms:
                yield from _batch(((p, len(s), pack(s)) for p, s in trie.subtrees()), "prefix")
                trie = BurstTrie(container)
        yield from _batch(((p, len(s), pack(s)) for p, s in trie.subtrees()), "prefix")

    return run


def route_of(term: str, bursting: set[str], known: int = 0) -> str:
    """Shortest prefix of the term that does not burst, from ``known`` characters on."""
    for size in range(known, len(term) + 1):
        if term[:size] not in bursting:
            return term[:size]
    return term + _END


def _send(bursting):
    """Subtrees by route: whole where a prefix of theirs is a route, else taken apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = bursting.value

        def rows() -> Iterator[tuple[str, int, bytes]]:
            for batch in batches:
                for prefix, n, block in zip(*(batch[c].to_pylist() for c in ("prefix", "n_terms", "block"))):
                    if prefix not in heavy:
                        route = route_of(prefix, heavy)
                        whole = {prefix[len(route) :] + s: [a, b] for s, a, b in unpack(block)} if prefix != route else None
                        yield route, n, pack(whole) if whole else block
                        continue
                    parts: dict[str, dict[str, Counts]] = {}
                    for suffix, a, b in unpack(block):
                        term = prefix + suffix
                        route = route_of(term, heavy, len(prefix))
                        parts.setdefault(route, {})[term[len(route.removesuffix(_END)) :]] = [a, b]
                    for route, suffixes in parts.items():
                        yield route, len(suffixes), pack(suffixes)

        yield from _batch(rows(), "route")

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come sorted by route; one route's subtree is in memory at a time."""
    blocks = ((r, b) for batch in batches for r, b in zip(batch["route"].to_pylist(), batch["block"].to_pylist()))
    for route, group in itertools.groupby(blocks, key=lambda x: x[0]):
        trie, prefix = BurstTrie(), route.removesuffix(_END)
        for _, block in group:
            for suffix, n, m in unpack(block):
                trie.add(suffix, n, m)
        rows = ((prefix + p + s, *counts) for p, below in trie.subtrees() for s, counts in below.items())
        for some in itertools.batched(rows, 8192):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*some), (pa.string(), pa.int64(), pa.int64()))],
                ["term", "occurrences", "records"],
            )


def _bursting(parts: DataFrame, route_terms: int) -> set[str]:
    """Prefixes with more than ``route_terms`` terms below."""
    sized = parts.groupBy("prefix").agg(F.sum("n_terms").alias("n"))
    above = sized.select(F.explode(F.sequence(F.lit(0), F.length("prefix"))).alias("size"), "prefix", "n")
    below = above.groupBy(F.expr("substring(prefix, 1, size)").alias("p")).agg(F.sum("n").alias("n"))
    while True:
        found = below.filter(F.col("n") > route_terms).select("p").limit(MAX_BURSTING + 1).collect()
        if len(found) <= MAX_BURSTING:
            return {r["p"] for r in found}
        route_terms *= 4


def count_terms(
    rows: DataFrame,
    stash: Stash,
    container: int = CONTAINER,
    worker_terms: int = WORKER_TERMS,
    route_terms: int = ROUTE_TERMS,
) -> DataFrame:
    """Sum ``occurrences`` and ``records`` of each distinct ``term``.

    Null terms are not counted; the empty term is a term. No rows give no rows.
    """
    clean = rows.select("term", F.col("occurrences").cast("bigint"), F.col("records").cast("bigint")).filter("term is not null")
    built = clean.mapInArrow(_build(container, worker_terms), "prefix string, n_terms bigint, block binary")
    parts, n = stash.put(built)
    bursting = rows.sparkSession.sparkContext.broadcast(_bursting(parts, route_terms) if n else set())
    sent = parts.mapInArrow(_send(bursting), "route string, n_terms bigint, block binary")
    together = sent.repartition("route").sortWithinPartitions("route")
    return together.mapInArrow(_merge, "term string, occurrences bigint, records bigint")

"""Encoding by a public byte-level BPE vocabulary: corpus-level merge replay.

Each task takes its texts a slice at a time. The slice's distinct words (the pattern's pieces) go
through the merges together: an inverted index leads from the rank of a token pair to the word
positions that have it, the merges are applied in rank order over all words at once, and a
merge touches only its neighbours. Words stay known to the worker, so frequent ones are
merged once. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary files lie.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how text is cut before merging
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a slice, and words a worker remembers.
SLICE_CHARS, KNOWN_WORDS = 2_000_000, 400_000


class MergeReplay:
    """A vocabulary and the words merged so far."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
        import regex

        self.pieces = regex.compile(PATTERN).findall
        lines = (Path(folder) / f"{name}.tiktoken").read_bytes().splitlines()
        self.rank = {base64.b64decode(token): int(id_) for token, id_ in (x.split() for x in lines if x)}
        self.text = {id_: token for token, id_ in self.rank.items()}
        self.byte = [self.rank[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def pair(self, left: int, right: int) -> int:
        """Id that two neighbours merge into, which is also the merge's rank; -1 if they do not."""
        key = left << 20 | right
        found = self.pairs.get(key)
        if found is None:
            found = self.pairs[key] = self.rank.get(self.text[left] + self.text[right], -1)
        return found

    def replay(self, words: Iterable[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Ids of distinct words."""
        words = list(words)
        ids, first = array("i"), [0]
        byte = self.byte
        for word in words:
            ids.extend([byte[b] for b in word.encode("utf-8", "surrogatepass")])
            first.append(len(ids))
        after, before = array("q", range(1, len(ids) + 1)), array("q", range(-1, len(ids) - 1))
        for a, b in zip(first, first[1:]):
            if a < b:
                after[b - 1], before[a] = -1, -1
        index: dict[int, list[int]] = {}
        pair, pairs = self.pair, self.pairs
        for i in range(len(ids)):
            if (j := after[i]) >= 0:
                rank = pairs.get(ids[i] << 20 | ids[j])
                if rank is None:
                    rank = pair(ids[i], ids[j])
                if rank >= 0:
                    index.setdefault(rank, []).append(i)
        ranks = list(index)
        heapq.heapify(ranks)
        while ranks:
            rank = heapq.heappop(ranks)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()  # the leftmost of overlapping pairs goes first
            for i in places:
                j = after[i]
                if ids[i] < 0 or j < 0 or pair(ids[i], ids[j]) != rank:
                    continue  # a neighbour has been merged since
                ids[i], ids[j], k, h = rank, -1, after[j], before[i]
                after[i] = k
                if k >= 0:
                    before[k] = i
                    new = pair(rank, ids[k])
                    if new >= 0:
                        if new not in index:
                            heapq.heappush(ranks, new)
                        index.setdefault(new, []).append(i)
                if h >= 0:
                    new = pair(ids[h], rank)
                    if new >= 0:
                        if new not in index:
                            heapq.heappush(ranks, new)
                        index.setdefault(new, []).append(h)
        for word, a, b in zip(words, first, first[1:]):
            yield word, tuple(x for x in ids[a:b] if x >= 0)

    def learn(self, texts: list[list[str]]) -> None:
        """Merge the words that are new in a slice."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        if len(self.pairs) > 4 * KNOWN_WORDS:
            self.pairs.clear()
        fresh = set().union(*texts).difference(self.known)
        self.known.update(self.replay(fresh))

    def slices(self, texts: list[str | None]) -> Iterator[list[list[str]]]:
        """Words per text, a slice of texts at a time; null and empty texts have none."""
        held, size = [], 0
        for text in texts:
            held.append(self.pieces(text) if text else [])
            size += len(text or "")
            if size >= SLICE_CHARS:
                yield held
                held, size = [], 0
        if held:
            yield held

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        out = []
        for words in self.slices(texts):
            self.learn(words)
            out += [list(chain.from_iterable(map(self.known.__getitem__, w))) for w in words]
        return out


def _encode(name: str, folder: str, null_ids: list[int], empty_ids: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = MergeReplay(name, folder)
        for batch in batches:
            doc, texts, at = batch["doc_id"], batch["text"].to_pylist(), 0
            for words in replay.slices(texts):
                replay.learn(words)
                known, ids, ends = replay.known.__getitem__, array("i"), [0]
                for offset, own in enumerate(words):
                    if own:
                        ids.extend(chain.from_iterable(map(known, own)))
                    else:
                        ids.extend(null_ids if texts[at + offset] is None else empty_ids)
                    ends.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))
                yield pa.RecordBatch.from_arrays([doc.slice(at, len(words)), lists], ["doc_id", "ids"])
                at += len(words)

    return run


def _count(name: str, folder: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = MergeReplay(name, folder)
        for batch in batches:
            sizes: list[int] = []
            for words in replay.slices(batch["text"].to_pylist()):
                replay.learn(words)
                known = replay.known.__getitem__
                sizes += [sum(map(len, map(known, own))) for own in words]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], pa.array(sizes, pa.int64())], [*columns, "n_tokens"])

    return run


def encode(
    documents: DataFrame,
    name: str = "byte_bpe_50k",
    folder: str = TOKENIZERS,
    null_ids: tuple[int, ...] = (),
    empty_ids: tuple[int, ...] = (),
) -> DataFrame:
    """``doc_id, ids`` of every ``text``, one row per row, without special tokens.

    Strings of special tokens are ordinary text. Null texts give ``null_ids``, empty texts
    ``empty_ids``, both nothing unless set. Other columns are not read.
    """
    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(_encode(name, folder, list(null_ids), list(empty_ids)), "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, columns: list[str], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The named columns and ``n_tokens`` of ``text``; 0 for null and empty texts."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*columns).schema)
    rows = documents.select(*columns, "text")
    return rows.mapInArrow(_count(name, folder, columns), f"{kinds}, n_tokens bigint")

"""Template residue, filler, error pages and script notices instead of content.

Positive-unlabelled naive Bayes by expectation-maximization. A text is read as units: passages
(sentences and lines) and marks (spans in brackets, braces and the like, looked for in the whole text, however
long and across line ends). ``SIGNS`` are generic signs of errors and placeholders; a unit with one is a
trusted positive *when the model is fitted*, all others are unlabelled. EM re-weights the unlabelled units by
their posterior and re-estimates both classes; smoothing toward the corpus keeps rare words neutral. Signs are
no features and no rule of the decision: words, numbers and punctuation, their neighbours, and a mark's shape and
words are. Then every unit of every text is scored, and a record is reported if one of its units is
more likely residue than speech. What a passage quotes is not read as its own words, which is what
keeps plain mentions out.

The model is fitted on a bounded sample of units: at most ``TRUSTED_UNITS`` trusted ones, ``NEAR_UNITS`` others of
records with a trusted one and ``OTHER_UNITS`` of other records, picked by hash over the whole corpus. Each kind weighs what
it stands for, so the model does not depend on how far any was thinned. Statistics and scoring cover
all texts in full. Null, empty and blank texts, and texts without any unit, are never reported. Texts are read
once; what is kept are hashed tokens, about a tenth of the characters.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Stash

#: Most units the model is fitted on: trusted, others of the same records, units of other records.
TRUSTED_UNITS, NEAR_UNITS, OTHER_UNITS = 20_000, 20_000, 100_000
#: Feature hash space, rounds of EM, counts that smooth a feature, bounds of one feature's log odds.
SPACE, ROUNDS, SMOOTHING, CLIP = 1 << 20, 8, 1.0, (-4.0, 4.0)
#: Weight an unlabelled mark starts with in a record that holds a trusted unit.
NEAR_START = 0.1
#: Log odds above which a unit counts as residue.
LEAST_ODDS = 0.0
#: Tokens of a unit; longer passages are several.
UNIT_TOKENS = 64

#: Spans that may be marks: placeholders, tags, notes
_SYMBOL_MARK = (
    r"[$%#@]?\{+[^{}]*\}+|\[+[^\[\]]*\]+|<+[^<>]*>+|&lt;[^<>&]*&gt;|%\([^()\n]*\)[a-z]|«[A-Z][A-Z_ ]*»"
    r"|([%#@_])\1*[^\W\d_][\w .]*?\1+|\$[A-Z][A-Z_]+\b"
)
MARK = re.compile(_SYMBOL_MARK + r"|\bX{4,}\b|(?<! an )(?<! a )\b(?:undefined|null|None|NaN|Invalid Date)\b")
_AT_SYMBOL, _FIRST, _WORDS = re.compile(_SYMBOL_MARK), re.compile(r"[{\[<$%#@_«&]"), ("XXXX", "undefined", "null", "None", "NaN", "Invalid Date")
#: Generic signs of placeholders, error pages, traces and notices; they only label the fit
SIGNS = {
    "slot": r"\{\{[^{}]*\}\}|\{%[^{}]*%\}|\$\{[^{}]*\}|\[\[[^\[\]]*\]\]|<%[^<>]*%>|%\([^()\n]*\)[a-z]|[\[<](?i:insert|enter|your)\b[^\[\]<>]*[\]>]",
    "page": r"(?i)<(?:!doctype|/?html|/?head|/?title|/?body|/?h1|/?noscript|\?xml)\b[^<>]*>",
    "data": r"\{\s*\"\w+\"\s*:[^{}]*\}",
    "unset": r"(?:undefined|null|None|NaN|Invalid Date)(?= *(?:[(:)]|$))",
    "filler": r"(?i)^\W*(?:lorem ipsum|texte provisoire|texto (?:provisional|de relleno)|(?:qwerty|asdf|blah|foo bar|abc def|xxx)\b|(?:\w+ ){0,3}(?:placeholder|dummy|filler|sample|blind|muster|platzhalter) ?(?:text|copy|speech)(?: (?:for|here|only|für|hier) |\W*$))",
    "draft": r"(?i)^\W*(?:\S+ ){0,4}(?:coming soon|to follow|à venir|please ignore|not for publication)\b",
    "status": r"(?i)^\W*(?:http|error|erreur|fehler)(?: code)?:? [45]\d\d\b|^\W*[45]\d\d:? (?:not|internal|bad|service|gateway|access|too)\b",
    "reason": r"(?i)^\W*(?:page not found|access denied|forbidden|(?:internal )?server error|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|too many requests|something went wrong|seite nicht gefunden|zugriff verweigert|page introuvable|accès refusé|página no encontrada|acceso denegado)\W*(?:$| - )",
    "trace": r"(?i)^\s*(?:traceback \(|at [\w.$]+\(|file \S+, line \d|goroutine \d|[\w.]*(?:exception|error): )|^[A-Z]{2,6}-\d{3,6}: ",
    "script": r"(?i)^\W*(?:\S+ ){0,2}javascript\b|^\W*(?:your|ihr|votre|su) (?:browser|navigateur|navegador)\b",
    "cookie": r"(?i)^\W*(?:\w+ ){0,2}(?:use|uses|utilisons|usamos|verwenden|verwendet) cookies\b",
}

_MARKED = r"[{\[<$%#&@_«]|XXXX|undefined|null|None|NaN|Invalid"
_DROP = "[\u00ad\u200b-\u200d\u2060\ufeff\u202a-\u202e\u2066-\u2069]"
_QUOTED = "[“„«‘‹][^“”„«»‘’‹›\r\n]{2,}[”“»’›]|\"[^\"\r\n]{2,}\""
#: A quotation that the sentence announces is open.
_ANNOUNCED = re.compile(r"\b(?:reads?|says|marked|printed|wording)\b[^.!?“„«\"\r\n]*[“„«\"][^”“»\"\r\n]*$")
_SLOT, _QUOTE = "\ue000", "\ue001"
_LINES = "[\r\n\x0b\x0c\u0085\u2028\u2029]+"
_OF_MARKS = ("slot", "page", "data", "unset")


def _signs_of_marks() -> re.Pattern:
    return re.compile("|".join(f"(?i:{SIGNS[n].removeprefix('(?i)')})" if SIGNS[n].startswith("(?i)") else SIGNS[n] for n in _OF_MARKS))



class _Hasher(dict):
    def __missing__(self, key: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[key] = zlib.crc32(key.encode("utf-8", "surrogatepass")) % SPACE
        return value


_HASH = _Hasher()


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of neighbours from the hashes of both."""
    mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)).astype(np.int32)


def _shape(mark: str) -> tuple[str, list[str]]:
    """A mark with its words as ``A``, ``a``, ``T`` or ``0`` (runs of words of one kind once), and the words."""
    words = re.findall(r"[^\W_]+", mark)
    kind = lambda w: "0" if w.isdigit() else "A" if w.isupper() else "a" if w.islower() else "T"
    shape = re.sub(r"[^\W_]+", lambda m: kind(m.group()), re.sub(r"\s+", " ", mark))
    return re.sub(r"(\w)(?:[ _.]+\1)+", r"\1", shape), ["0" if w.isdigit() else w.lower() for w in words]


def _without_marks(text: str, note) -> str:
    """``MARK.sub``, but trying symbols only where one stands, unless a word that is a mark occurs."""
    if any(w in text for w in _WORDS):
        return MARK.sub(note, text)
    pieces, at = [], 0
    for first in _FIRST.finditer(text):
        if first.start() >= at and (m := _AT_SYMBOL.match(text, first.start())):
            pieces += (text[at : m.start()], note(m))
            at = m.end()
    return "".join((*pieces, text[at:]))


class Units:
    """Units of a batch of texts: ``owner`` (text), ``mark``, ``trusted``, and their hashed ``tokens`` at ``start``.

    A passage's tokens are its words, numbers and signs in order. A mark's are its shape, each of its words (and
    the shape with the first), and its neighbours on both sides.
    """

    def __init__(self, owner, mark, trusted, lengths, tokens):
        order = np.argsort(owner, kind="stable")
        starts = np.cumsum(lengths) - lengths
        self.owner, self.mark, self.trusted, self.lengths = owner[order], mark[order], trusted[order], lengths[order]
        self.start = np.cumsum(self.lengths) - self.lengths
        at = np.repeat(starts[order] - self.start, self.lengths) + np.arange(int(self.lengths.sum()))
        self.tokens = tokens[at]


def _token_arrays(passages: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and letters of each token, and the passage it is in."""
    low = pc.replace_substring_regex(pc.utf8_lower(passages), r"\p{N}+", "0")
    spaced = pc.replace_substring_regex(low, r"([^\p{L}\p{M}0\s’'])", r" \1 ")
    split = pc.utf8_split_whitespace(spaced)
    if isinstance(split, pa.ChunkedArray):
        split = split.combine_chunks()
    flat, parent = split.flatten(), pc.list_parent_indices(split).to_numpy()
    coded = pc.dictionary_encode(flat)
    words = coded.dictionary.to_pylist()
    hashes = np.array([_HASH[w] for w in words] or [0], np.int32)
    letters = np.array([len(w) if w[:1].isalpha() else 0 for w in words] or [0], np.int32)
    at = coded.indices.to_numpy()
    keep = np.array([w != "" for w in words] or [False])[at] if len(at) else np.zeros(0, bool)
    return hashes[at][keep], letters[at][keep], parent[keep]


def read_units(texts: pa.Array) -> Units:
    """All units of texts (none of them null)."""
    whole = pc.replace_substring_regex(pc.replace_substring_regex(texts, _DROP, ""), "\u00a0", " ").to_pylist()
    clean = pa.array([x if x.isascii() else unicodedata.normalize("NFC", x) for x in whole], pa.string())
    flagged = pc.match_substring_regex(clean, _MARKED).to_numpy(zero_copy_only=False)
    marks: list[tuple[int, str, bool]] = []
    signs = _signs_of_marks()
    if flagged.any():
        plain = clean.to_pylist()
        for i in np.flatnonzero(flagged):
            text = plain[i]

            def note(m, i=i, text=text):
                if _ANNOUNCED.search(text, max(0, m.start() - 120), m.start()):
                    return f" {_QUOTE} "
                sure = bool((found := signs.match(text, m.start(), m.end() + 3)) and found.end() == m.end())
                marks.append((i, m.group(), sure))
                return f" {_SLOT} "

            plain[i] = _without_marks(text, note)
        clean = pa.array(plain, pa.string())
    clean = pc.replace_substring_regex(clean, _QUOTED, f" {_QUOTE} ")
    clean = pc.replace_substring_regex(clean, r"([.!?…])[\s\x{3000}]+", r"\1" + "\n")
    split = pc.split_pattern_regex(clean, _LINES)
    passages, text_of = split.flatten(), pc.list_parent_indices(split).to_numpy()
    tokens, letters, passage = _token_arrays(passages)
    slot = tokens == _HASH[_SLOT]
    # marks: shape, words and the tokens beside them
    first = np.r_[True, passage[1:] != passage[:-1]] if len(passage) else np.zeros(0, bool)
    last = np.r_[first[1:], True] if len(passage) else first
    before = np.where(first, _HASH["^"], np.r_[0, tokens[:-1]])[slot] if len(tokens) else tokens
    after = np.where(last, _HASH["$"], np.r_[tokens[1:], 0])[slot] if len(tokens) else tokens
    own, own_lengths = [], []
    for (_, mark, _), left, right in zip(marks, before.tolist(), after.tolist(), strict=True):
        shape, words = _shape(mark)
        keys = [f"S:{mark}"] if mark.isalpha() else [f"S:{shape}", *[f"N:{w}" for w in words]]
        keys += [f"L:{left}", f"R:{right}"]
        ids = [_HASH[k] for k in keys]
        own += ids
        own_lengths.append(len(ids))
    # passages: the other tokens, in pieces
    tokens, letters, passage = tokens[~slot], letters[~slot], passage[~slot]
    first = np.r_[True, passage[1:] != passage[:-1]] if len(passage) else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    place = np.arange(len(passage)) - np.repeat(begin, np.diff(np.r_[begin, len(passage)]))
    piece = np.flatnonzero(first | (place % UNIT_TOKENS == 0)) if len(passage) else begin
    lengths = np.diff(np.r_[piece, len(passage)])
    wordy = (np.add.reduceat(letters, piece) >= 3) if len(piece) else np.zeros(0, bool)
    tokens, of = tokens[np.repeat(wordy, lengths)], passage[piece][wordy]
    trusted = np.zeros(len(passages), bool)
    restored = pc.replace_substring_regex(passages, f" ?{_QUOTE} ?", "Q")
    for name, sign in SIGNS.items():
        if name not in _OF_MARKS:
            trusted |= pc.match_substring_regex(restored, sign).to_numpy(zero_copy_only=False)
    return Units(
        np.r_[text_of[of], np.array([m[0] for m in marks], np.int64)].astype(np.int64),
        np.r_[np.zeros(len(of), bool), np.ones(len(marks), bool)],
        np.r_[trusted[of], np.array([m[2] for m in marks], bool)],
        np.r_[lengths[wordy], np.array(own_lengths, np.int64)].astype(np.int64),
        np.r_[tokens, np.array(own, np.int32)].astype(np.int32),
    )


def features(mark: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All features of units and the unit of each: tokens, and for passages neighbours (with both ends); or self-repetition."""
    unit = np.repeat(np.arange(len(lengths)), lengths)
    if not len(tokens):
        return tokens, unit
    inside = ~mark[unit]
    first = np.r_[True, unit[1:] != unit[:-1]]
    before = np.where(first, np.int32(_HASH["^"]), np.r_[np.int32(0), tokens[:-1]])
    ends = (np.cumsum(lengths) - 1)[(lengths > 0) & ~mark]
    closing = _pair(tokens[ends], np.full(len(ends), _HASH["$"], np.int32))
    same = np.zeros(len(tokens), bool)
    for back in (1, 2, 3, 4):
        same[back:] |= (tokens[back:] == tokens[:-back]) & (unit[back:] == unit[:-back])
    again = np.flatnonzero((np.bincount(unit, same & inside, len(lengths)) >= 0.6 * lengths) & (lengths >= 8))
    flat = np.r_[tokens, _pair(before, tokens)[inside], closing]
    owner = np.r_[unit, unit[inside], unit[ends]]
    if len(again):  # what mostly repeats itself is judged by that alone
        other = ~np.isin(owner, again)
        flat = np.r_[flat[other], np.repeat(np.array([_HASH["R:again"], _HASH["R:words"]], np.int32), len(again))]
        owner = np.r_[owner[other], again, again]
    return flat, owner


def fit(kind: np.ndarray, mark: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Log odds per feature, then the priors of passages and of marks.

    ``kind``: 2 trusted, 1 in a record with a trusted unit, 0 other. ``size``: how many units each stands for.
    """
    odds = np.zeros(SPACE + 2, np.float32)
    if not len(kind):
        return odds
    size = size / size.mean()  # smoothing counts units of the sample, not of the corpus
    flat, owner = features(mark, lengths, tokens)
    known = np.bincount(flat, minlength=SPACE) >= 2
    weight = np.select([kind == 2, (kind == 1) & mark], [1.0, NEAR_START], 0.0)
    for part in (~mark, mark):  # passages and marks share no features of weight; each has its own classes
        own = part[owner]
        f, o = flat[own], owner[own]
        if not (kind[part] == 2).any():  # nothing to learn from: none of this kind is reported
            odds[SPACE + int(part is mark)] = -1e9
            continue
        whole = np.bincount(f, size[o], minlength=SPACE)
        for _ in range(ROUNDS):
            positive = np.bincount(f, (weight * size)[o], minlength=SPACE)
            base = positive.sum() / max(1.0, whole.sum())
            good = (positive + SMOOTHING * base) / max(base, 1e-12)
            bad = (np.maximum(whole - positive, 0.0) + SMOOTHING * (1 - base)) / max(1 - base, 1e-12)
            with np.errstate(divide="ignore", invalid="ignore"):
                log = np.where(known & (whole > 0), np.log(good / bad), 0.0)
            log = np.clip(np.nan_to_num(log, posinf=CLIP[1], neginf=CLIP[0]), *CLIP)
            prior = np.clip(np.average(weight[part], weights=size[part]), 1e-4, 0.5)
            prior = np.log(prior / (1 - prior))
            score = np.bincount(o, log[f], minlength=len(kind)) + prior
            found = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            weight = np.where(part, np.where(kind == 2, 1.0, found), weight)
        odds[:SPACE] += np.where(whole > 0, log, 0.0).astype(np.float32)
        odds[SPACE + int(part is mark)] = prior
    return odds


def scores(odds: np.ndarray, mark: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Log odds of each unit."""
    flat, owner = features(mark, lengths, tokens)
    return np.bincount(owner, odds[flat], minlength=len(lengths)) + np.where(mark, odds[SPACE + 1], odds[SPACE])


_READ = "doc_id bigint, near boolean, flags binary, lengths binary, tokens array<int>, n_trusted int, n_units int"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: bytes of flags (1 mark, 2 trusted) and lengths of its units, and all their tokens."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            units = read_units(piece["text"])
            flags = (units.mark + 2 * units.trusted).astype(np.uint8)
            bounds = np.searchsorted(units.owner, np.arange(piece.num_rows + 1))
            stop = np.r_[0, np.cumsum(units.lengths)]
            lengths = units.lengths.astype(np.uint16)
            trusted = np.r_[0, np.cumsum(units.trusted)]
            sure = (trusted[bounds[1:]] - trusted[bounds[:-1]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    piece["doc_id"],
                    pa.array(sure > 0),
                    pa.array([flags[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])], pa.binary()),
                    pa.array([lengths[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(stop[bounds], pa.int32()), pa.array(units.tokens, pa.int32())),
                    pa.array(sure),
                    pa.array(np.diff(bounds).astype(np.int32)),
                ],
                ["doc_id", "near", "flags", "lengths", "tokens", "n_trusted", "n_units"],
            )


def _opened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, flags and lengths of all units of a batch, and all tokens."""
    flags = [np.frombuffer(x, np.uint8) for x in batch["flags"].to_pylist()]
    row = np.repeat(np.arange(len(flags)), [len(f) for f in flags])
    lengths = np.frombuffer(b"".join(batch["lengths"].to_pylist()), np.uint16).astype(np.int64)
    tokens = batch["tokens"].flatten().to_numpy(zero_copy_only=False)
    return row, np.concatenate(flags) if flags else np.zeros(0, np.uint8), lengths, tokens


_DRAWN = "kind int, mark boolean, pick bigint, own binary"


def _draw(rates: tuple[float, float, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units of each kind thinned by a hash of their record, place and tokens."""
        for batch in batches:
            row, flags, lengths, tokens = _opened(batch)
            near = batch["near"].to_numpy(zero_copy_only=False)[row] if len(row) else np.zeros(0, bool)
            kind = np.where(flags & 2, 2, near.astype(int))
            ids = batch["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            place = np.arange(len(row)) - np.searchsorted(row, row)
            sums = np.add.reduceat(np.r_[tokens, 0], starts) if len(starts) else starts
            mixed = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ sums.astype(np.uint64)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            pick = ((mixed ^ (mixed >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)
            chosen = np.flatnonzero(pick < np.array(rates)[kind] * 2.0**63)
            own = [tokens[starts[i] : starts[i] + lengths[i]].astype(np.int32).tobytes() for i in chosen]
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind[chosen], pa.int32()), pa.array((flags[chosen] & 1).astype(bool)), pa.array(pick[chosen]), pa.array(own, pa.binary())],
                ["kind", "mark", "pick", "own"],
            )

    return run


def _score(odds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, flags, lengths, tokens = _opened(batch)
            found = scores(odds.value, (flags & 1).astype(bool), lengths, tokens) > LEAST_ODDS
            hit = np.unique(row[found])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(hit))], ["doc_id"])

    return run


def learn(read: DataFrame, stash: Stash) -> np.ndarray:
    """The model, fitted on the bounded sample of what ``_read`` made of all texts."""
    zero = F.lit(0).cast("bigint")
    some = lambda c: F.coalesce(F.sum(c), zero)
    rest = F.col("n_units") - F.col("n_trusted")
    total = read.agg(
        some("n_trusted").alias("k2"), some(F.when(F.col("near"), rest)).alias("k1"), some(F.when(~F.col("near"), rest)).alias("k0")
    ).first()
    most = (OTHER_UNITS, NEAR_UNITS, TRUSTED_UNITS)
    counts = (total["k0"], total["k1"], total["k2"])
    rates = tuple(min(1.0, 1.2 * m / max(1, n)) for m, n in zip(most, counts))  # a little more than is kept
    drawn, _ = stash.put(read.mapInArrow(_draw(rates), _DRAWN))
    rows = []
    for kind, n in enumerate(most):
        rows += drawn.filter(F.col("kind") == kind).orderBy("pick", "own").limit(n).collect()
    kinds = np.array([r["kind"] for r in rows], np.int64)
    sampled = np.maximum(np.bincount(kinds, minlength=3), 1)
    own = [np.frombuffer(r["own"], np.int32) for r in rows]
    lengths = np.array([len(x) for x in own], np.int64)
    size = (np.array(counts) / sampled)[kinds] if len(rows) else np.zeros(0)
    return fit(kinds, np.array([r["mark"] for r in rows], bool), lengths, np.concatenate(own) if own else np.zeros(0, np.int32), size)


def find_residue(documents: DataFrame) -> DataFrame:
    """``doc_id`` of each row whose ``text`` is, in whole or in part, residue."""
    texts = documents.select("doc_id", "text").filter("text is not null and trim(text) <> ''")
    stash = Stash(documents.sparkSession)
    read, _ = stash.put(texts.mapInArrow(_read, _READ))
    odds = documents.sparkSession.sparkContext.broadcast(learn(read, stash))  # SPACE floats, 4 MB
    return read.mapInArrow(_score(odds), "doc_id bigint")

"""Distinct strings of a slice, and texts cut into the pieces that byte-level merges work on.

Cutting, hashing and looking up run over whole slices in numpy. A piece is encoded once and kept in
a bounded memory of the worker; equal hashes are trusted only after their bytes were compared.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np

from landshift.llm.arrow import ragged

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Unicode White_Space (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Word separators of the contracts (fixed values).
BLANKS = [0x20, *range(0x09, 0x0E)]
_FACTOR = 0x9E3779B97F4A7C15 | 1


@cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = SPACE
    return table


_POWERS: dict[int, np.ndarray] = {}


def _powers(factor: int, size: int) -> np.ndarray:
    """factor ** 0, 1, ... modulo 2 ** 64."""
    known = _POWERS.get(factor)
    if known is None or len(known) < size:
        steps = np.full(max(size, 1 << 18), factor, np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if size <= 1 << 22:
            _POWERS[factor] = known
    return known[:size]


def hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of every byte range, mixed with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_FACTOR, len(data)), out=total[1:])
    h = (total[starts + lengths] - total[starts]) * _powers(pow(_FACTOR, -1, 1 << 64), len(data) + 1)[starts]
    h ^= lengths.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def distinct(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one range per distinct content, position of every range among those)."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, inverse = np.unique(hashes(data, starts, lengths), return_index=True, return_inverse=True)
    like = first[inverse]
    same = np.array_equal(lengths, lengths[like]) and np.array_equal(
        data[ragged(starts[like], lengths)], data[ragged(starts, lengths)])
    if same:
        return first, inverse
    raw = data.tobytes()
    known: dict[bytes, int] = {}
    found: list[int] = []
    inverse = np.empty(len(starts), np.int64)
    for i, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist())):
        at = known.setdefault(raw[s:s + n], len(found))
        if at == len(found):
            found.append(i)
        inverse[i] = at
    return np.array(found, np.int64), inverse


def words(data: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words ``[^\\x20\\x09-\\x0D]+`` and the number of words up to each text's end.

    ``ends``: rows + 1 offsets of the texts in ``data``; ``table``: other bytes (256 of them) that words consist of.
    """
    if table is None:
        table = np.ones(256, bool)
        table[BLANKS] = False
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = table[data]
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    cuts = ends[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[1:-1][cuts]
    stops[cuts - 1] = inside[1:-1][cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1 - starts, np.searchsorted(starts, ends[1:])


def cut(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``words``, for the pieces of ``public_tokenizers.PATTERN``; pieces cover the whole text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends) - 1, np.int64)
    if data.max() < 0x80:
        points, char_at, bounds = data, None, ends
    else:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        char_at = np.flatnonzero((data & 0xC0) != 0x80)
        bounds = np.searchsorted(char_at, ends)
    n = len(points)
    kind = _classes()[points]
    fresh = np.zeros(n + 1, bool)  # first character of a text
    fresh[bounds] = True
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= fresh[:n]
    space = kind == SPACE
    after_blank = np.zeros(n, bool)
    after_blank[1:] = points[:-1] == 0x20
    after_blank &= ~fresh[:n]
    last_blank = np.zeros(n, bool)
    last_blank[:-1] = space[:-1] & ~space[1:] & ~fresh[1:n]
    quote = np.flatnonzero((points == 0x27) & start & ~after_blank)
    start &= space | ~after_blank
    start |= last_blank
    _contractions(points, kind, fresh, start, quote)
    begin = np.flatnonzero(start)
    counts = np.searchsorted(begin, bounds[1:])
    if char_at is not None:
        begin = char_at[begin]
    return begin, np.diff(np.append(begin, len(data))), counts


def _contractions(points: np.ndarray, kind: np.ndarray, fresh: np.ndarray, start: np.ndarray, quote: np.ndarray) -> None:
    """A lone quote takes a following s, t, m, d, re, ve or ll with it."""
    n = len(points)
    quote = quote[(quote + 1 < n)]
    quote = quote[~fresh[quote + 1] & (kind[quote + 1] == LETTER)]
    if not len(quote):
        return
    one = points[quote + 1]
    two = np.where((quote + 2 < n) & ~fresh[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = np.zeros(len(quote), bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    for found, size in ((quote[short], 2), (quote[long], 3)):
        start[found + 1] = False
        rest = found + size
        start[rest[rest < n]] = True


class PieceMemory:
    """Encodings of pieces seen by this worker, at most about ``limit`` of them.

    ``encode`` maps a list of byte strings to (ids on end, number of ids of each).
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 200_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def lookup(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Slot of every distinct byte range given."""
        if len(self.slots) > self.limit:
            self._clear()
        raw, slots = data.tobytes(), self.slots
        texts = [raw[s:e] for s, e in zip(starts.tolist(), (starts + lengths).tolist())]
        found = np.fromiter(map(slots.get, texts, [-1] * len(texts)), np.int64, len(texts))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [texts[i] for i in missing.tolist()]
            ids, counts = self.encode(new)
            first = len(slots)
            slots.update(zip(new, range(first, first + len(new))))
            found[missing] = np.arange(first, first + len(new))
            self.ids = _room(self.ids, self.used + len(ids))
            self.start, self.length = _room(self.start, len(slots)), _room(self.length, len(slots))
            self.ids[self.used:self.used + len(ids)] = ids
            self.start[first:len(slots)] = self.used + np.cumsum(counts) - counts
            self.length[first:len(slots)] = counts
            self.used += len(ids)
        return found

    def tokens(
        self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, counts: np.ndarray,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces on end, and the number of ids up to each text's end.

        ``counts``: number of pieces up to each text's end.
        """
        first, inverse = distinct(data, starts, lengths)
        slot = self.lookup(data, starts[first], lengths[first])[inverse]
        sizes = self.length[slot]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[ragged(self.start[slot], sizes)], upto[counts]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    grown = np.zeros(max(size, 2 * len(array)), array.dtype)
    grown[:len(array)] = array
    return grown


def windows(ids: np.ndarray, upto: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, class) of all windows of ``width`` ids that lie in one text; equal windows of one text share a class.

    ``upto``: number of ids up to each text's end.
    """
    text = np.repeat(np.arange(len(upto)), np.diff(np.append(0, upto)))
    at = np.flatnonzero(text[:max(0, len(ids) - width + 1)] == text[width - 1:])
    if not len(at):
        return at, at
    keys = np.stack([text[at], *(ids[at + i] for i in range(width))])
    mixed = np.zeros(len(at), np.uint64)
    for row in keys:
        mixed = (mixed ^ row.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    _, first, inverse = np.unique(mixed, return_index=True, return_inverse=True)
    if not np.array_equal(keys[:, first[inverse]], keys):
        inverse = np.unique(keys, axis=1, return_inverse=True)[1].ravel()
    return at, inverse

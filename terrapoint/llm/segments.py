"""Content-defined segments of long symbol sequences.

A window is `window` consecutive symbols (bytes or word hashes) of one document. Every window owns its
minimizer: the least hash among its `gram`-symbol substrings. Consecutive windows with one minimizer
form a segment, which is what travels: equal windows always have equal minimizers, so grouping by the
minimizer brings every pair of equal windows together, wherever they start. Hashes only route and name
strings; a segment is named by 128 bits (its minimizer and a hash of its content).
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import xxhash

#: Windows of one segment at most; runs in periodic text are cut into pieces of this many.
LONGEST = 128
#: Symbols that are hashed at a time, so that memory doesn't follow a document's length.
CHUNK = 1 << 17
#: The longest words that numpy hashes, in bytes, and by how many bytes at a time words are looked for there.
LONG_WORD, PIECE = 32, 1 << 18
#: Words whose hashes a worker remembers, about 50 MB; then it begins anew.
REMEMBERED = 1 << 18
_BREAK = re.compile(rb"[\x20\x09-\x0D]")

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R1 = np.uint64(0x9E3779B97F4A7C15)
_R2 = 0xD1342543DE82EF95
_R2_INV = pow(_R2, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_R2, 1 << 10), _powers(_R2_INV, 1 << 10)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 2 * len(_POW))
        _POW, _INV = _powers(_R2, size), _powers(_R2_INV, size)
    return _POW, _INV


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def byte_symbols(data: bytes | memoryview) -> np.ndarray:
    return _BYTE[np.frombuffer(data, np.uint8)]


def _prefix(sym: np.ndarray) -> np.ndarray:
    pw, _ = _grown(len(sym) + 1)
    out = np.empty(len(sym) + 1, np.uint64)
    out[0] = 0
    np.cumsum(sym * pw[: len(sym)], out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of sym[begin:end] for many substrings at once; prefix from _prefix()."""
    _, inv = _grown(len(prefix))
    return mix((prefix[end] - prefix[begin]) * inv[begin] + (end - begin).astype(np.uint64) * _R1)


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of bytes other than \\x20 and \\x09-\\x0D."""
    b = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


class _Hashes(dict):
    """XXH3 of words, 8 bytes each; short words are remembered."""

    def __missing__(self, word: bytes) -> bytes:
        out = xxhash.xxh3_64_digest(word)
        if len(word) <= 32:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = out
        return out


_hashes = _Hashes()


def word_symbols(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order. It routes and names; words themselves are compared elsewhere."""
    out, at = [], 0
    while at < len(data):
        cut = _BREAK.search(data, at + CHUNK)
        to = cut.start() if cut else len(data)
        out.append(b"".join(map(_hashes.__getitem__, data[at:to].split())))
        at = to
    return np.frombuffer(b"".join(out), np.uint64)


_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], "<u8")
_LENGTH = _rng.integers(0, 1 << 63, LONG_WORD + 1, dtype=np.uint64)


def words_within(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of many texts, which lie one behind the other in data, and how many words each text has.

    Words of up to LONG_WORD bytes take in 8 bytes a round, each followed by a finalizer (words of one length up to 8 never meet); longer ones go through XXH3.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    begins, out, at = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while at < len(data):
        cut = _BREAK.search(data, at + PIECE)
        to = cut.start() if cut else len(data)
        b = padded[at:to]
        inside = ~((b == 32) | (b - np.uint8(9) < 5))
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        fresh = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, to, "left")] - at  # texts that begin here
        first[fresh], last[fresh - 1] = inside[fresh], inside[fresh - 1]
        begin, end = np.flatnonzero(first) + at, np.flatnonzero(last) + (at + 1)
        length = end - begin
        h = _LENGTH[np.minimum(length, LONG_WORD)]
        h = mix(h ^ (eight[begin] & _HEAD[np.minimum(length, 8)]))
        for k in range(8, LONG_WORD, 8):
            more = np.flatnonzero((length > k) & (length <= LONG_WORD))
            if len(more):
                h[more] = mix(h[more] ^ (eight[begin[more] + k] & _HEAD[np.minimum(length[more] - k, 8)]))
        for i in np.flatnonzero(length > LONG_WORD):
            h[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]])
        begins.append(begin)
        out.append(h)
        at = to
    return np.concatenate(out), np.diff(np.searchsorted(np.concatenate(begins), offsets))


def _grams(sym: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive symbols, by doubling."""
    have, length, out, filled = sym, 1, None, 0
    mult = _R1
    while True:
        if k & length:
            if out is None:
                out, filled = have, length
            else:
                # out covers `filled` symbols; put it behind the `length` symbols before it
                n = len(sym) - filled - length + 1
                out = have[:n] * np.uint64(pow(int(_R1), filled, 1 << 64)) + out[length : length + n]
                filled += length
        if filled == k:
            return mix(out)
        n = len(have) - length
        have = have[:n] * mult + have[length : length + n]
        mult = np.uint64(pow(int(mult), 2, 1 << 64))
        length *= 2


def _sliding(a: np.ndarray, w: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over each w consecutive values."""
    length = 1
    while length * 2 <= w:
        a = f(a[: len(a) - length], a[length:])
        length *= 2
    return f(a[: len(a) - (w - length)], a[w - length :]) if length < w else a


@dataclass
class Segments:
    """start: of the first window, in the chunk; n: windows; m, h: name; multi: the minimizer is in it twice."""

    start: np.ndarray
    n: np.ndarray
    m: np.ndarray
    h: np.ndarray
    multi: np.ndarray


def _least(sym: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """Hashes of all grams; each window's minimizer; whether the window lies in one document; places of minimizers."""
    span = window - gram + 1
    g = _grams(sym, gram)
    least = _sliding(g, span, np.minimum)
    valid = np.ones(len(sym), bool)
    for back in range(1, window):
        at = ends - back
        valid[at[at >= 0]] = False
    begins = np.concatenate([[0], ends[:-1]])
    for b, e in zip(begins[ends - begins < window], ends[ends - begins < window], strict=True):
        valid[b:e] = False
    valid = valid[: len(least)]
    # places of minimizers
    shown = np.where(valid, least, np.uint64(0))
    padded = np.concatenate([np.zeros(span - 1, np.uint64), shown, np.zeros(span - 1, np.uint64)])
    top = _sliding(padded, span, np.maximum)
    return g, least, valid, np.flatnonzero((g == top) & (top > 0))


def minimizers(sym: np.ndarray, ends: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The minimizers of documents laid end to end, one for each place where one lies."""
    if len(sym) < window:
        return np.empty(0, np.uint64)
    g, _, _, where = _least(sym, ends, window, gram)
    return g[where]


def segments(sym: np.ndarray, ends: np.ndarray, window: int, gram: int) -> Segments:
    """Of documents laid end to end; ends: where each one ends. Windows don't cross those places."""
    span = window - gram + 1
    none = np.empty(0, np.int64)
    if len(sym) < window:
        return Segments(none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool))
    g, least, valid, where = _least(sym, ends, window, gram)
    # runs of windows with one minimizer
    new = np.empty(len(least), bool)
    new[0] = True
    new[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(least)))
    keep = valid[first]
    first, length = first[keep], length[keep]
    if len(length) and length.max() > LONGEST:
        pieces = (length + LONGEST - 1) // LONGEST
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, length = np.repeat(first, pieces) + nth * LONGEST, np.repeat(length, pieces) - nth * LONGEST
        length = np.minimum(length, LONGEST)
    m = least[first]
    h = substring_hash(_prefix(sym), first, first + length + window - 1)
    values = g[where]
    at, to = np.searchsorted(where, first), np.searchsorted(where, first + length + span - 1)
    seen, live = np.zeros(len(first), np.int64), np.flatnonzero(at < to)
    while len(live):
        seen[live] += values[at[live]] == m[live]
        at[live] += 1
        live = live[(at[live] < to[live]) & (seen[live] < 2)]
    return Segments(first, length, m, h, seen > 1)


def chunks(parts: Iterable[np.ndarray], window: int):
    """Lays documents end to end, about CHUNK symbols at a time.

    Yields (symbols, ends, owner, shift): owner is the index of each piece's document, shift what to add to a
    place in the chunk for the place in that document. A document that is longer comes in pieces that
    overlap by window - 1 symbols, so each window is in one piece.
    """
    held, owner, offset, total = [], [], [], 0

    def flush():
        lengths = np.array([len(x) for x in held])
        ends = np.cumsum(lengths)
        return np.concatenate(held), ends, np.array(owner), np.array(offset) - (ends - lengths)

    for i, sym in enumerate(parts):
        at = 0
        while len(sym) - at >= window:
            piece = sym[at : at + CHUNK + window - 1]
            held.append(piece)
            owner.append(i)
            offset.append(at)
            total += len(piece)
            at += CHUNK
            if total >= CHUNK:
                yield flush()
                held, owner, offset, total = [], [], [], 0
    if held:
        yield flush()


def pieces(sym: np.ndarray, n: int, m: int, window: int, gram: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts a segment of n windows by how far each reaches to the left of its minimizer, `width` lengths at a time.

    Gives offset and number of windows of each piece, and where the symbols begin and end that all windows
    of its kind share, whichever segment they lie in. A window that is found in two segments lies in pieces of one kind in
    both, and its piece's shared symbols are equal there.
    """
    anchors = np.flatnonzero(_grams(sym, gram) == np.uint64(m))
    o = np.arange(n)
    anchor = anchors[np.searchsorted(anchors, o)]
    kind = (anchor - o) // width
    cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (kind[1:] != kind[:-1])]))
    anchor, kind = anchor[cut], kind[cut]
    most = np.minimum((kind + 1) * width - 1, window - gram)
    return cut, np.diff(np.append(cut, n)), anchor - kind * width, anchor + window - most


def partners(sym: np.ndarray, begin: np.ndarray, length: np.ndarray, m: np.ndarray, window: int, gram: int, classes: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each string that can occur twice among strings of the same minimizer; last < first if none can.

    A window reaches some l symbols to the left of its minimizer. For l in each of `classes` ranges, the
    symbols around the minimizer that all such windows hold are hashed; windows whose hash occurs once
    have no partner. sym: the strings, end to end; m: each one's minimizer.
    """
    g = _grams(sym, gram)
    ends = begin + length
    owner = np.repeat(np.arange(len(begin)), length)[: len(g)]
    anchor = np.flatnonzero(g == m[owner])
    owner = owner[anchor]
    whole = anchor + gram <= ends[owner]
    anchor, owner = anchor[whole], owner[whole]
    prefix, rest = _prefix(sym), window - gram
    step = -(-(rest + 1) // classes)
    keys, owners, lows, highs = [], [], [], []
    for least in range(0, rest + 1, step):
        most = min(least + step - 1, rest)
        b, e = anchor - least, anchor + gram + rest - most
        inside = (b >= begin[owner]) & (e <= ends[owner])
        own = owner[inside]
        keys.append(mix(substring_hash(prefix, b[inside], e[inside]) + np.uint64(least)))
        owners.append(own)
        place = anchor[inside] - begin[own]
        lows.append(np.maximum(place - most, 0))
        highs.append(np.minimum(place - least, length[own] - window))
    keys, owners, lows, highs = (np.concatenate(x) for x in (keys, owners, lows, highs))
    _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
    again = count[which] > 1
    first, last = np.full(len(begin), np.iinfo(np.int64).max), np.full(len(begin), -1)
    np.minimum.at(first, owners[again], lows[again])
    np.maximum.at(last, owners[again], highs[again])
    return first, last

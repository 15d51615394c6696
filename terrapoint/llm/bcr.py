"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of many strings.

Round j inserts, for each string that is long enough, its suffix of length j: the symbol before the suffix
of round j - 1 says where (rank of that symbol, by LF mapping), and the common prefixes with both
neighbours follow from the least old value between a symbol's neighbouring occurrences, plus one. The
transform and the common prefixes live in two files, read and rewritten front to back in each round.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

END = 0  # stands before the first symbol of a string; the symbols that occur are numbered from 1


def _ranks(bwt: np.ndarray, counts: np.ndarray):
    """Places of all symbols, grouped by symbol and in order; where each symbol's group begins."""
    order = np.argsort(bwt, kind="stable")  # of 8 bits: a counting sort
    return order, np.cumsum(counts) - counts


def _least(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least of values[begin:end] for each pair (begin < end)."""
    if not len(begin):
        return np.empty(0, values.dtype)
    pairs = np.empty(2 * len(begin), np.int64)
    pairs[0::2], pairs[1::2] = begin, np.minimum(end, len(values) - 1)
    out = np.minimum.reduceat(values, pairs)[0::2]
    at_end = end == len(values)
    out[at_end] = np.minimum(out[at_end], values[-1])
    return out


class _File:
    """An array in a file that is read and rewritten from front to back; it only grows."""

    def __init__(self, path: str, dtype):
        self._file, self._dtype = open(path, "w+b", buffering=0), dtype  # noqa: SIM115

    def read(self) -> np.ndarray:
        self._file.seek(0)
        return np.fromfile(self._file, self._dtype)

    def write(self, values: np.ndarray) -> None:
        self._file.seek(0)
        rest = memoryview(values).cast("B")
        while len(rest):
            rest = rest[self._file.write(rest) :]

    def close(self) -> None:
        self._file.close()


class Collection:
    """bwt, lcp of all suffixes; string and length of the suffix at each place."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray):
        """data: bytes; string i is data[begin[i] : begin[i] + length[i]]."""
        m, longest = len(begin), int(length.max(initial=0))
        occurring = np.unique(data)
        code = np.zeros(256, np.uint16 if len(occurring) > 255 else np.uint8)
        code[occurring] = np.arange(1, len(occurring) + 1)
        data = code[data]
        with tempfile.TemporaryDirectory() as folder:
            files = [_File(os.path.join(folder, "bwt"), code.dtype), _File(os.path.join(folder, "lcp"), np.uint8)]
            ends = begin + length
            # round 0: the empty suffixes, in the order of the strings
            bwt = np.where(length > 0, data[np.maximum(ends - 1, 0)], END).astype(code.dtype)
            count = np.bincount(bwt, minlength=257)
            files[0].write(bwt)
            files[1].write(np.zeros(m, np.uint8))
            live, place = np.flatnonzero(length > 0), np.flatnonzero(length > 0)
            for j in range(1, longest + 1):
                bwt, lcp = files[0].read(), files[1].read()
                order, start = _ranks(bwt, count)
                by = np.argsort(place, kind="stable")
                live, place = live[by], place[by]
                symbol = bwt[place]
                rank = np.empty(len(place), np.int64)
                for c in np.unique(symbol):
                    mine = np.flatnonzero(symbol == c)
                    rank[mine] = start[c] + np.searchsorted(order[start[c] : start[c] + count[c]], place[mine])
                new = m + rank - count[END]
                has_before, has_after = rank > start[symbol], rank + 1 < start[symbol] + count[symbol]
                before, after = np.zeros(len(new), np.uint8), np.zeros(len(new), np.uint8)
                at = place[has_before]
                before[has_before] = 1 + _least(lcp, order[rank[has_before] - 1] + 1, at + 1)
                at = place[has_after]
                after[has_after] = 1 + _least(lcp, at + 1, order[rank[has_after] + 1] + 1)
                total = len(bwt) + len(new)
                old = np.ones(total, bool)
                old[new] = False
                bwt2, lcp2 = np.empty(total, bwt.dtype), np.empty(total, np.uint8)
                bwt2[old], lcp2[old] = bwt, lcp
                bwt2[new] = added = np.where(length[live] > j, data[np.maximum(ends[live] - j - 1, 0)], END)
                count += np.bincount(added, minlength=257)
                inside = new + 1 < total
                lcp2[new[inside] + 1] = after[inside]
                lcp2[new] = before
                files[0].write(bwt2)
                files[1].write(lcp2)
                stay = length[live] > j
                live, place = live[stay], new[stay]
            self.bwt, self.lcp = files[0].read(), files[1].read()
            for f in files:
                f.close()
        self._locate(m, length, longest)

    def _locate(self, m: int, length: np.ndarray, longest: int) -> None:
        """Follows every string from its empty suffix through the finished transform."""
        count = np.bincount(self.bwt, minlength=257)
        order, _ = _ranks(self.bwt, count)
        to = np.empty(len(self.bwt), np.int64)
        to[order] = np.arange(len(order)) + m - count[END]
        self.string, self.length = np.empty(len(self.bwt), np.int64), np.empty(len(self.bwt), np.int64)
        live, place = np.arange(m), np.arange(m)
        for j in range(longest + 1):
            self.string[place], self.length[place] = live, j
            stay = length[live] > j
            live, place = live[stay], to[place[stay]]


def repeated_windows(data: np.ndarray, begin: np.ndarray, length: np.ndarray, doc: np.ndarray, at: np.ndarray, window: int):
    """Windows of the strings that also start earlier: (string, offset) of each.

    Earlier is a smaller (doc, at + offset); doc and at say where each string lies.
    """
    found = Collection(data, begin, length)
    class_ = np.cumsum(found.lcp < window)
    long = np.flatnonzero(found.length >= window)
    class_, string = class_[long], found.string[long]
    offset = length[string] - found.length[long]
    shared = np.bincount(class_)[class_] > 1
    class_, string, offset = class_[shared], string[shared], offset[shared]
    by = np.lexsort((at[string] + offset, doc[string], class_))
    class_, string, offset = class_[by], string[by], offset[by]
    later = np.zeros(len(by), bool)
    later[1:] = class_[1:] == class_[:-1]
    return string[later], offset[later]

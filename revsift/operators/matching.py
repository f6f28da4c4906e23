"""Matching model rows with golden rows: identifier, exact title, fuzzy title.

The cascade (identifier, then exact title, then fuzzy title) runs on distinct
normalised values, and each stage only sees what the previous one left over.

Fuzzy title matching asks for each string whether the other side holds one with
token-sort ratio >= t:

* ratio = 100 * (1 - indel / S) with S = len1 + len2 and indel = S - 2*LCS, so
  ``ratio >= t  <=>  100 * indel <= (100 - t) * S`` (integers only);
* lengths: LCS <= min(len) gives 200*min >= t*S, so lengths differ by the factor
  (200 - t) / t at most;
* characters: an insertion or deletion changes one character count by one, so the
  counts of two strings differ by no more than their indel distance;
* what is left is checked by an exact bit-parallel LCS, for one string against
  many at a time.

Without some of their characters two strings are no further apart. Strings of like length
that are equal then are a cell (the words of a title without the letters that its numbers
and codes hold too, say), and cells that are too far apart have no pair. A bounded sample
of the strings tells which characters are left out and which cells there are; all strings
that fall into none of them are a cell that meets every other: the sample decides how fast
the job is, not what it finds. Cells are packed into blocks, a large cell is cut by a hash
of the string, and a task compares one block of either side in memory, if any of their
cells may meet. There cells are cut finer, by counts of more characters, and only strings
of near cells are compared. No index by grams or segments is used: titles made from one
template share nearly all of theirs, and such keys are hot. No pair leaves a task, only
the strings that have a partner, and a string that has one needs no second: partners whose
characters are nearest are tried first. Every threshold gives exact results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_doi, normalize_title, token_sort
from .. import defaults as D
from ..session import materialise


def _lcs_len(a: str, b: str) -> int:
    """LCS length, bit-parallel (Allison–Dix / Hyyrö), O(len(a) * len(b) / wordsize)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


BLOCK = 2048  # strings of either side that a task compares; of short ones 8 times as many, and up to 64 times where there is work for all
LETTERS = 1 << 22  # characters of either side that a larger block may hold
SAMPLE = 1 << 14  # strings that tell which cells there are
CELLS = 1 << 10  # cells that strings are dealt by
WIDE, FINE = 1 << 11, 1 << 10  # pairs of strings for a pair of wide and of fine cells, by and large
PAIRS = 1 << 21  # pairs that are compared at a time
COUNTED = 48  # character counts of a string: the most frequent characters of a block, others share the last
FIRST = 8  # partners that are tried before the rest
TOGETHER = 1 << 14  # pairs whose LCS is computed at a time
LONG = 512  # from here on the LCS is computed pair by pair
FULL = np.uint64(2**64 - 1)


def _letters(strings: list[str]) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)


def _alphabet(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of the strings, and the count that each goes to: the most frequent have one of their own."""
    often = np.bincount(_letters(strings))
    alphabet = np.flatnonzero(often).astype(np.uint32)
    place = np.empty(len(alphabet), np.int64)
    place[np.argsort(-often[alphabet], kind="stable")] = np.minimum(np.arange(len(alphabet)), COUNTED - 1)
    return alphabet, place


def _without(letters: np.ndarray, n: np.ndarray, left_out: np.ndarray) -> list[str]:
    """The strings of these lengths without some characters."""
    table = np.ones(int(max(letters.max(initial=0), left_out.max(initial=0))) + 1, bool)
    table[left_out] = False
    stay = table[letters]
    ends = np.cumsum(np.bincount(np.repeat(np.arange(len(n)), n)[stay], minlength=len(n))).tolist()
    text = letters[stay].tobytes().decode("utf-32-le")
    return [text[start:end] for start, end in zip([0, *ends], ends, strict=False)]


def _telling(counts: np.ndarray) -> list[int]:
    """The counts that differ, in the order by which rows are to fall into cells: first those that others tell most of, as the
    letters of the words of a template, which make few cells that are far apart; by their mutual information."""
    rows, top = len(counts), np.minimum(counts.max(axis=0, initial=0), 15)
    each = np.concatenate([np.minimum(counts[:, [c]], n) == np.arange(n + 1) for c, n in enumerate(top)], axis=1).astype(np.float32)
    joint = each.T @ each / max(rows, 1)
    share, starts = np.diag(joint), np.cumsum(top + 1) - top - 1
    terms = joint * np.log(np.where(joint > 0, joint, 1) / np.where(joint > 0, np.outer(share, share), 1))
    known = np.add.reduceat(np.add.reduceat(terms, starts, axis=0), starts, axis=1)
    entropy = np.diag(known).copy()
    known = np.maximum(known - np.outer(top, top) / (2 * max(rows, 1)), 0)  # without what chance gives
    np.fill_diagonal(known, 0)
    some = np.flatnonzero(entropy > 1e-6)
    return some[np.argsort(-known.sum(axis=1)[some] / entropy[some], kind="stable")].tolist()


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the ranges, one range after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _packed(bits: np.ndarray) -> np.ndarray:
    """[word, row]: 64 bits a word."""
    words = max(1, -(-bits.shape[1] // 64))
    padded = np.zeros((len(bits), 64 * words), bool)
    padded[:, : bits.shape[1]] = bits
    return np.ascontiguousarray(np.packbits(padded, axis=1).view(np.uint64).T)


class _Cells:
    """Groups of strings: some counts that all strings of a group share, and the lengths of its shortest and longest. Two groups
    have a pair only if their lengths are near enough and their counts differ by no more than strings of these lengths may."""

    def __init__(self, counts: np.ndarray, shortest: np.ndarray, longest: np.ndarray, most: np.ndarray):
        """``most``: counts are cut to it, which sets no two further apart than they are."""
        place, level = np.repeat(np.arange(len(most)), most), np.concatenate([np.zeros(0, np.int64), *(np.arange(k) for k in most)])
        self.words, self.shortest, self.longest = _packed(counts[:, place] > level), shortest, longest

    def near(self, some: slice | np.ndarray, other: _Cells, of: slice | np.ndarray, threshold: int) -> np.ndarray:
        """[cell, cell of the other]"""
        apart = sum(np.bitwise_count(x[some, None] ^ y[of]).astype(np.int32) for x, y in zip(self.words, other.words, strict=True))
        near = 100 * apart <= (100 - threshold) * np.add.outer(self.longest[some], other.longest[of])
        near &= np.less_equal.outer(threshold * self.shortest[some], (200 - threshold) * other.longest[of])
        return near & np.greater_equal.outer((200 - threshold) * self.longest[some], threshold * other.shortest[of])


class _Side:
    """The strings of one side of a block: lengths, places of their characters in the block's alphabet, character counts."""

    def __init__(self, strings: list[str], alphabet: np.ndarray, place: np.ndarray):
        self.strings, self.n = strings, np.array([len(s) for s in strings], np.int64)
        number = np.zeros(int(alphabet.max(initial=0)) + 1, np.int32)
        number[alphabet] = np.arange(len(alphabet))
        self.letters, self.size = number[_letters(strings)], len(alphabet)
        self._place()
        self.counts = np.bincount(self.rows * np.int64(COUNTED) + place[self.letters], minlength=len(strings) * COUNTED).reshape(-1, COUNTED).astype(np.int32)

    def _place(self) -> None:
        self.rows, self.ends, self.short = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n), np.r_[0, np.cumsum(self.n)], self.n <= LONG
        self.at = np.arange(len(self.letters), dtype=np.int32) - np.repeat(self.ends[:-1].astype(np.int32), self.n)

    def sort(self, order: np.ndarray) -> None:
        self.letters = self.letters[_ranges(self.ends[order], self.n[order])]
        self.strings, self.n, self.counts = [self.strings[k] for k in order.tolist()], self.n[order], self.counts[order]
        self._place()

    def columns(self) -> np.ndarray:
        """Row k: the k-th characters of all short strings; the alphabet's size where one has ended."""
        out = np.full((int(self.n[self.short].max(initial=0)), len(self.n)), self.size, np.int32)
        short = self.short[self.rows]
        out[self.at[short], self.rows[short]] = self.letters[short]
        return out

    def masks(self, first: int, last: int) -> np.ndarray:
        """[word, string, character]: the bits of the places where short strings hold the character."""
        inside = np.arange(self.ends[first], self.ends[last])
        inside = inside[self.short[self.rows[inside]]]
        rows, at, words = self.rows[inside] - first, self.at[inside], int(-(-self.n[first:last][self.short[first:last]].max(initial=0) // 64))
        out = np.zeros((words, last - first, self.size + 1), np.uint64)
        np.bitwise_or.at(out, (at // 64, rows, self.letters[inside]), np.left_shift(np.uint64(1), (at % 64).astype(np.uint64)))
        return out


def _lcs_of_pairs(masks: np.ndarray, columns: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """LCS lengths of the pairs (i, j) of short strings of lengths n and m, bit-parallel over all pairs."""
    size = masks.shape[2]
    flat = masks.reshape(len(masks), -1)
    words = int(-(-n.max() // 64))
    state = np.full((words, len(i)), FULL)
    base = i * size
    for column in columns[: int(m.max())]:
        at, carry = base + column[j], None
        for v, mask in zip(state, flat, strict=False):
            met = mask[at]
            total = v + (v & met)
            if words > 1:
                over = total < v
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            np.bitwise_and(v, ~met, out=v)
            np.bitwise_or(total, v, out=v)
    left = np.clip(n - 64 * np.arange(words)[:, None], 0, 64).astype(np.uint64)
    inside = np.where(left == 64, FULL, np.left_shift(np.uint64(1), left % np.uint64(64)) - np.uint64(1))
    return np.bitwise_count(~state & inside).sum(axis=0, dtype=np.int64)


def _meeting(lefts: tuple, rights: tuple, threshold: int) -> np.ndarray:
    """[cell, cell of the other side]: whether cells may hold a pair. Of either side: what the strings of each cell are without
    some characters (None: not known), and the lengths of its shortest and longest string."""
    open_ = [np.array([x is None or len(x) > LONG for x in side[0]]) for side in (lefts, rights)]
    known = [["" if x is None or len(x) > LONG else x for x in side[0]] for side in (lefts, rights)]
    alphabet, place = _alphabet([*known[0], *known[1], " "])
    a, b = (_Side(x, alphabet, place) for x in known)
    most = np.minimum(a.counts.max(axis=0, initial=0), b.counts.max(axis=0, initial=0))
    cells = [_Cells(x.counts, *side[1:], most) for x, side in zip((a, b), (lefts, rights), strict=True)]
    nothing = [_Cells(x.counts[:, :0], *side[1:], most[:0]) for x, side in zip((a, b), (lefts, rights), strict=True)]
    columns, out = b.columns(), np.zeros((len(a.n), len(b.n)), bool)
    for k in range(0, len(a.n), 64):
        part = slice(k, k + 64)
        near = cells[0].near(part, cells[1], slice(None), threshold) & ~open_[0][part, None] & ~open_[1]
        i, j = near.nonzero()
        masks = a.masks(k, min(k + 64, len(a.n)))
        for start in range(0, len(i), TOGETHER):
            x, y = i[start : start + TOGETHER], j[start : start + TOGETHER]
            n, m = a.n[k + x], b.n[y]
            lcs = _lcs_of_pairs(masks, columns, x, y, n, m) if n.max() else 0
            near[x, y] = 100 * (n + m - 2 * lcs) <= (100 - threshold) * (lefts[2][k + x] + rights[2][y])
        unknown = nothing[0].near(part, nothing[1], slice(None), threshold) & (open_[0][part, None] | open_[1])
        out[part] = near | unknown
    return out


class _Near:
    """The pairs of a block whose character counts differ by no more than strings of these lengths may.

    ``wide``: numbers of the wide cells of the strings of either side, and which of them may meet; ``counts``: the counts by
    which the strings of a wide cell are sorted, so that those with equal first ones are a fine cell. Fine cells within near wide
    cells are compared, and strings within near fine cells. A string's counts are written as bits, one for each level of a
    character, the most telling ones first: the bits in which two strings differ are the difference of their counts. Pairs are
    compared by the first words, and those that stay by the rest."""

    def __init__(self, a: _Side, b: _Side, threshold: int, counts: list[int] | None = None, wide: tuple | None = None):
        self.a, self.b, self.threshold = a, b, threshold
        most = np.minimum(a.counts.max(axis=0, initial=0), b.counts.max(axis=0, initial=0))
        self.long = most.sum() > 4096  # long texts
        self._cells(counts or [], most, wide or (np.zeros(len(a.n), np.int64), np.zeros(len(b.n), np.int64), np.ones((1, 1), bool)))
        if not self.long:
            place, level = np.repeat(np.arange(COUNTED), most), np.concatenate([np.arange(k) for k in most])
            bits = [x.counts[:, place] > level for x in (a, b)]
            share = sum(x.mean(axis=0) if len(x) else np.zeros(len(place)) for x in bits) / 2
            order = np.argsort(share * (share - 1), kind="stable")
            self.words = [_packed(x[:, order]) for x in bits]
            self.over = [np.maximum(x.counts - most, 0).sum(axis=1) for x in (a, b)]  # levels that the other side has nowhere
            # a pair may differ in as many bits as the hundredth part of both strings' room
            self.room = [(100 - threshold) * x.n - 100 * over for x, over in zip((a, b), self.over, strict=True)]
            self.limits: dict[int, np.ndarray] = {}
            self.first = self._first_words()
            self.kind = np.uint8 if self.first <= 3 else np.uint16

    def _first_words(self) -> int:
        """How many words all pairs are compared by, so that on some pairs of the block the work is least."""
        i, j = (np.linspace(0, len(x.n) - 1, min(n, len(x.n))).astype(int) for x, n in ((self.a, 64), (self.b, 256)))
        differ = np.bitwise_count(self.words[0][:, i, None] ^ self.words[1][:, None, j]).cumsum(axis=0, dtype=np.int64)
        stay = (100 * differ <= self.room[0][i, None] + self.room[1][j]).mean(axis=(1, 2)) if differ.size else np.zeros(len(differ))
        done = np.arange(1, len(differ) + 1)
        return int(np.argmin(done + 15 * stay * (len(differ) - done))) + 1  # a pair that stays is looked up, word by word

    def _limit(self, room: int) -> np.ndarray:
        """For each right string the number of bits from which on it differs too much from a left string with this room."""
        if room not in self.limits:
            if len(self.limits) >= 1024:
                self.limits.clear()
            self.limits[room] = np.clip((room + self.room[1]) // 100 + 1, 0, np.iinfo(self.kind).max).astype(self.kind)
        return self.limits[room]

    def _cells(self, counts: list[int], most: np.ndarray, wide: tuple) -> None:
        # of each side the first of the counts in which a string differs from the one before it; -1: another wide cell
        sorted_, new = [x.counts[:, counts] for x in (self.a, self.b)], []
        for x, cell in zip(sorted_, wide[:2], strict=True):
            unlike = np.concatenate([cell[1:, None] != cell[:-1, None], x[1:] != x[:-1]], axis=1)
            new.append(np.r_[-1, np.where(unlike.any(axis=1), unlike.argmax(axis=1) - 1, len(counts))])
        held = [np.cumsum(np.bincount(x + 1, minlength=len(counts) + 2))[:-1] for x in new]  # cells by the first k counts
        depth = max(np.flatnonzero(held[0] * held[1] <= len(self.a.n) * len(self.b.n) // FINE).tolist(), default=0)
        self.meet, self.starts, self.cells, self.inside = wide[2], [], [], []
        for x, side, rows, cell in zip(new, (self.a, self.b), sorted_, wide, strict=False):
            fine, outer = np.flatnonzero(x < depth), np.flatnonzero(x < 0)
            self.starts.append(np.r_[fine, len(x)])
            self.cells.append(_Cells(rows[fine][:, :depth], np.minimum.reduceat(side.n, fine), np.maximum.reduceat(side.n, fine), most[counts[:depth]]))
            inside = np.zeros(self.meet.shape[len(self.inside)] + 1, np.int64)  # fine cells of a wide one
            inside[cell[outer]] = np.diff(np.r_[np.searchsorted(fine, outer), len(fine)])
            self.inside.append(np.r_[0, np.cumsum(inside[:-1])])

    def steps(self, most: int):
        """(first, last, right strings): left strings of one cell in turn, ``most`` at a time, with those of the near cells."""
        fine, right = self.starts
        if self.long:
            step = max(1, min(most, PAIRS // len(self.b.n)))
            yield from ((k, min(k + step, len(self.a.n)), np.arange(len(self.b.n))) for k in range(0, len(self.a.n), step))
            return
        sizes = np.diff(right)
        for wide, meet in enumerate(self.meet):
            near = np.flatnonzero(meet)
            near = _ranges(self.inside[1][near], np.diff(self.inside[1])[near])
            start, end = self.inside[0][wide : wide + 2].tolist()
            for part in range(start, end, step := max(1, PAIRS // (len(near) + 1))):
                met = self.cells[0].near(slice(part, min(part + step, end)), self.cells[1], near, self.threshold)
                for cell, meet in enumerate(met, part):
                    some = near[meet]
                    if not len(some):
                        continue
                    some, (first, last) = _ranges(right[some], sizes[some]), fine[cell : cell + 2].tolist()
                    rows = max(1, min(most, PAIRS // len(some)))
                    yield from ((k, min(k + rows, last), some) for k in range(first, last, rows))

    def _compared(self, first: int, last: int, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (i, j) of left strings with the right strings ``near`` that stay by the first words."""
        if not len(near):
            return near, near
        some = np.concatenate([near, np.zeros(-len(near) % 8, near.dtype)])  # eight pairs a word
        words = [x[some] for x in self.words[1][: self.first]]
        room = self.room[0][first:last].tolist()
        rooms = {r: k for k, r in enumerate(dict.fromkeys(room))}
        limits = np.stack([self._limit(r)[some] for r in rooms])
        limits[:, len(near) :] = 0
        room, found, rows = np.array([rooms[r] for r in room]), [], max(1, (1 << 15) // len(some))
        for start in range(first, last, rows):
            end = min(start + rows, last)
            differ = np.bitwise_count(self.words[0][0, start:end, None] ^ words[0]).astype(self.kind, copy=False)
            for left, right in zip(self.words[0][1 : self.first], words[1:], strict=True):
                differ += np.bitwise_count(left[start:end, None] ^ right)
            stay = (differ < limits[room[start - first : end - first]]).ravel()
            eight = stay.view(np.uint64).nonzero()[0]
            if len(eight):
                at, k = np.nonzero(stay.reshape(-1, 8)[eight])
                found.append((start - first) * len(some) + 8 * eight[at] + k)
        if not found:
            return near[:0], near[:0]
        i, j = np.divmod(np.concatenate(found), len(some))
        return i, some[j]

    def pairs(self, first: int, last: int, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, shared) of the strings from ``first`` to ``last`` of the left side, i counted from ``first``, with all or some of the right."""
        if self.long:
            counts = np.stack([np.minimum(x, self.b.counts).sum(axis=1) for x in self.a.counts[first:last]])
            i, j = (x.ravel() for x in np.indices(counts.shape))
            shared = counts.ravel()
        else:
            i, j = self._compared(first, last, np.arange(len(self.b.n)) if some is None else some)
            apart = np.zeros(len(i), np.int64)
            for k, (x, y) in enumerate(zip(*self.words, strict=True)):
                apart += np.bitwise_count(x[first + i] ^ y[j])
                if k >= self.first:
                    stay = 100 * apart <= self.room[0][first + i] + self.room[1][j]
                    i, j, apart = i[stay], j[stay], apart[stay]
            shared = (self.a.n[first + i] + self.b.n[j] - self.over[0][first + i] - self.over[1][j] - apart) // 2
        total = self.a.n[first + i] + self.b.n[j]
        good = (200 * shared >= self.threshold * total) & (total > 0)
        return i[good], j[good], shared[good]


def _characters(strings: list[str], most: int) -> tuple[list[int], list[int], list[str]]:
    """The characters without which the strings fall into ``most`` cells at most, the characters by whose counts these are best
    cut finer, the first ones first, and the cells."""
    alphabet, place = _alphabet(strings)
    side = _Side(strings, alphabet, place)
    order = _telling(side.counts)
    everywhere = [c for c in np.flatnonzero(side.counts.min(axis=0, initial=1)).tolist() if c not in order]  # in all strings alike
    chars = [alphabet[place == c].tolist() for c in [*everywhere, *order]]
    letters, left_out, cells = alphabet[side.letters], set(alphabet.tolist()), {""}
    for some in chars:
        fewer = left_out.difference(some)
        found = set(_without(letters, side.n, np.array(sorted(fewer), np.int64)))
        if len(found) <= most:
            left_out, cells = fewer, found
    return sorted(left_out), [c for some in chars for c in some], sorted(cells)


def matched_strings(left: list[str], right: list[str], threshold: int, both: bool = False,
                    known: tuple[list[int], list[int]] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Which strings of a block have a partner on the other side, and how many pairs had their LCS computed.

    ``known``: the characters that are left out where wide cells are made, and those by whose counts strings fall into fine
    cells, the first ones first, where a sample has told them; any are right.

    Without ``both`` a pair is not looked at once its left string has a partner, and the marks of the right side are not complete."""
    if not left or not right:
        return np.zeros(len(left), bool), np.zeros(len(right), bool), 0
    alphabet, place = _alphabet([*left, *right])
    a, b = _Side(left, alphabet, place), _Side(right, alphabet, place)
    left_out, letters = known or _characters([*left[:: -(-len(left) // 512)], *right[:: -(-len(right) // 512)]], len(left) * len(right) // WIDE)[:2]
    own = dict(zip(alphabet.tolist(), place.tolist(), strict=True))
    counts = list(dict.fromkeys(own[c] for c in letters if c in own))
    cells, wide = [], []
    for side in (a, b):
        number: dict[str, int] = {}
        cells.append(np.array([number.setdefault(s, len(number)) for s in _without(alphabet[side.letters], side.n, np.array(left_out, np.int64))]))
        lengths = [f(len(number), x, np.int64) for f, x in ((np.full, side.n.max()), (np.full, 0))]
        np.minimum.at(lengths[0], cells[-1], side.n)
        np.maximum.at(lengths[1], cells[-1], side.n)
        wide.append((list(number), *lengths))
    if len(wide[0][0]) * len(wide[1][0]) * WIDE <= max(len(left) * len(right), WIDE):
        meet = _meeting(*wide, threshold)
    else:  # more cells than are worth it
        cells, meet = [np.zeros_like(x) for x in cells], np.ones((1, 1), bool)
    orders = [np.lexsort([*x.counts[:, counts[::-1]].T, cell]) for x, cell in zip((a, b), cells, strict=True)]
    for x, order in zip((a, b), orders, strict=True):
        x.sort(order)
    left, right = a.strings, b.strings
    columns, close = b.columns(), _Near(a, b, threshold, counts, (cells[0][orders[0]], cells[1][orders[1]], meet))
    found_a, found_b, looked = np.zeros(len(left), bool), np.zeros(len(right), bool), 0

    def checked(first: int, last: int, i: np.ndarray, j: np.ndarray, shared: np.ndarray) -> int:
        """Marks the strings of the pairs that match; how many were looked at."""
        looked, total = 0, a.n[first + i] + b.n[j]
        order = np.lexsort((-shared / total, i))  # of each left string the nearest first
        i, j, total = i[order], j[order], total[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        masks = a.masks(first, last)
        # the pairs of the first rank of every string, then others of strings that still look for a partner
        for some in [np.flatnonzero(rank < FIRST), *np.array_split(np.flatnonzero(rank >= FIRST), max(1, len(i) // TOGETHER))]:
            open_ = ~found_a[first + i[some]]
            some = some[open_ | ~found_b[j[some]] if both else open_]
            looked += len(some)
            quick = some[a.short[first + i[some]] & b.short[j[some]]] if len(some) >= 64 else some[:0]
            slow = np.setdiff1d(some, quick, assume_unique=True)
            lcs = np.zeros(len(i), np.int64)
            for k in range(0, len(quick), TOGETHER):
                part = quick[k : k + TOGETHER]
                lcs[part] = _lcs_of_pairs(masks, columns, i[part], j[part], a.n[first + i[part]], b.n[j[part]])
            for k in slow.tolist():
                if both or not found_a[first + i[k]]:
                    lcs[k] = _lcs_len(left[first + i[k]], right[j[k]])
                    found_a[first + i[k]] |= 100 * (total[k] - 2 * lcs[k]) <= (100 - threshold) * total[k]
            good = some[100 * (total[some] - 2 * lcs[some]) <= (100 - threshold) * total[some]]
            found_a[first + i[good]] = True
            found_b[j[good]] = True
        return looked

    # the pairs of some steps are checked together
    held, size, begin, most = [], 0, 0, max(1, min(LETTERS // 256, (1 << 21) // (len(alphabet) + 1)))
    for first, last, some in close.steps(most):
        if held and (last - begin > most or size >= TOGETHER):
            looked += checked(begin, first, *map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
        i, j, shared = close.pairs(first, last, some)
        if len(i):
            begin = begin if held else first
            held.append((i + first - begin, j, shared))
            size += len(i)
    if held:
        looked += checked(begin, min(begin + most, len(left)), *map(np.concatenate, zip(*held, strict=True)))
    return *(x[np.argsort(order)] for x, order in zip((found_a, found_b), orders, strict=True)), looked


def _distinct(strings: DataFrame) -> DataFrame:
    return materialise(strings.select("s").where(F.col("s").isNotNull()).distinct(), "titles")


def _sampled(sides: list[DataFrame]) -> tuple[list[int], list[int], list[str]] | None:
    """What about ``SAMPLE`` strings tell by their first characters; None where the strings are few."""
    strings = sides[0].unionAll(sides[1])
    total = strings.count()
    if total <= 16 * BLOCK:
        return None
    some = strings.where(F.pmod(F.xxhash64("s"), F.lit(max(1, total // SAMPLE))) == 0).select(F.substring("s", 1, LONG).alias("s")).collect()
    return _characters([r.s for r in some], CELLS) if some else None


def _dealt(lefts: list, rights: list, names: list[str], threshold: int, workers: int) -> tuple[list, list]:
    """For the cells of either side, given as (band, cell or -1, strings, shortest, longest): (band, cell, its blocks), of each block
    its number and the blocks of the other side that it is compared with. Large blocks save copies, as long as there is work for all."""
    sides = [sorted(map(tuple, rows)) for rows in (lefts, rights)]
    if not all(sides):
        return [], []
    n, shortest, longest = ([np.array([r[k] for r in rows], np.int64) for rows in sides] for k in (2, 3, 4))
    near = _meeting(*(([names[r[1]] if r[1] >= 0 else None for r in rows], *x) for rows, *x in zip(sides, shortest, longest, strict=True)), threshold)
    pairs = np.prod([float(k[near.any(axis=other)].sum()) for k, other in zip(n, (1, 0), strict=True)])
    size = min(64 * BLOCK, max(8 * BLOCK, int((pairs / (8 * workers)) ** 0.5)))
    first, blocks = [], []
    for rows, strings, top in zip(sides, n, longest, strict=True):
        begin, number, last, held, room = [], [], -1, 0, 0
        for (in_band, *_), k, most in zip(rows, strings.tolist(), np.maximum(BLOCK, np.minimum(size, LETTERS // top)).tolist(), strict=True):
            if last < 0 or held + k > min(room, most) or in_band != band:
                last, held, room, band = last + 1, 0, most, in_band
            begin.append(last)
            number.append(-(-k // most))
            last, held, room = last + number[-1] - 1, held + k, min(room, most)
        first.append(np.array(begin))
        blocks.append(np.array(number))
    # a cell goes to the blocks of the other side that hold a cell it may meet
    out = []
    for rows, x, k, side, other in ((sides[0], first[0], blocks[0], near, 1), (sides[1], first[1], blocks[1], near.T, 0)):
        meets = [np.unique(_ranges(first[other][some], blocks[other][some])).tolist() for some in map(np.flatnonzero, side)]
        out.append([(r[0], r[1], [(own, some) for own in range(b, b + c)]) for r, b, c, some in zip(rows, x.tolist(), k.tolist(), meets, strict=True) if some])
    return tuple(out)


def fuzzy_matches(left: DataFrame, right: DataFrame, threshold: int = D.FUZZY_THRESHOLD, both: bool = True) -> DataFrame:
    """(side, s): the distinct strings of ``left`` (side 0) and ``right`` (side 1) that have a partner on the other side.

    Both inputs hold one string column ``s`` (already token-sorted). Without
    ``both`` only the left side is told, and a string is done with once it has a
    partner. Any threshold from 1 to 100 gives exact results."""
    if not 1 <= threshold <= 100:
        raise ValueError("the threshold is a percentage from 1 to 100")
    sides = [_distinct(left), _distinct(right)]
    equal = materialise(sides[0].join(sides[1], "s", "left_semi"), "equal-titles")
    told = equal.select(F.lit(0).alias("side"), "s")
    if both:
        told = told.unionAll(equal.select(F.lit(1).alias("side"), "s"))
    else:
        sides[0] = sides[0].join(equal, "s", "left_anti")  # what equality has found needs no second partner
    if threshold == 100:
        return told
    sides = [x.where("s <> ''") for x in sides]
    spark = left.sparkSession
    told_by = _sampled(sides)
    left_out, letters, names = told_by or ([], [], [])
    # bands of lengths: only the least and greatest length of a cell tell what it may meet
    band = F.floor(F.log(F.length("s")) / float(np.log((200 - threshold) / threshold))).cast("int")
    known = F.broadcast(spark.createDataFrame(list(enumerate(names)), "cell int, name string"))
    without = F.translate("s", "".join(map(chr, left_out)), "")
    sides = [materialise(x.select("s", band.alias("band"), F.when(F.length("s") <= LONG, without).alias("name")).join(known, "name", "left")
                         .select("s", "band", F.coalesce("cell", F.lit(-1)).alias("cell")), "title-cells") for x in sides]
    # one row a band and cell
    cells = [x.groupBy("band", "cell").agg(F.count(F.lit(1)), F.min(F.length("s")), F.max(F.length("s"))).collect() for x in sides]
    dealing = _dealt(*cells, names, threshold, spark.sparkContext.defaultParallelism)

    def dealt(side: int, own: str, other: str) -> DataFrame:
        blocks = spark.createDataFrame(dealing[side], "band int, cell int, blocks array<struct<own: int, others: array<int>>>")
        block = F.element_at("blocks", (F.pmod(F.xxhash64("s"), F.size("blocks")) + 1).cast("int"))
        return (sides[side].join(F.broadcast(blocks), ["band", "cell"]).select("s", block.alias("block"))
                .select(F.col("block.own").alias(own), F.explode("block.others").alias(other), F.lit(side).alias("side"), "s"))

    characters = told_by and told_by[:2]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a, b = (group.loc[group["side"] == side, "s"].tolist() for side in (0, 1))
        marks = matched_strings(a, b, threshold, both, characters) if a and b else (np.zeros(len(a), bool), np.zeros(len(b), bool), 0)
        found = [(0, s) for s, m in zip(a, marks[0], strict=True) if m] + [(1, s) for s, m in zip(b, marks[1], strict=True) if m and both]
        return pd.DataFrame(found, columns=["side", "s"])

    # a number of tasks by the work, which is far more than the few bytes of a block say; some get two blocks by chance, so more than blocks
    groups = len({(own, other) for *_, blocks in dealing[0] for own, others in blocks for other in others})
    tasks = max(1, min(3 * groups, max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    rows = dealt(0, "lefts", "rights").unionByName(dealt(1, "rights", "lefts")).repartition(tasks, "lefts", "rights")
    near = rows.groupBy("lefts", "rights").applyInPandas(compare, "side int, s string")
    return told.unionAll(near).distinct()


def fuzzy_semi_join(left: DataFrame, right: DataFrame, threshold: int = D.FUZZY_THRESHOLD) -> DataFrame:
    """Distinct strings ``s`` of ``left`` having a ``right`` string with ratio >= threshold."""
    return fuzzy_matches(left, right, threshold, both=False).select("s")


def match_cascade(ai: DataFrame, golden: DataFrame, ai_id: str, ai_title: str, ai_pred: str,
                  golden_title: str, golden_doi: str | None = None, ai_doi: str | None = None,
                  threshold: int = D.FUZZY_THRESHOLD, fuzzy: bool = True) -> DataFrame:
    """Per model row: ``match_kind`` (id / exact / fuzzy / none) and ``y_true``.

    The model identifier defaults to the title column (file stems are DOIs).
    Every golden row counts as relevant; the golden side is reduced to distinct
    normalised values before any join, so duplicated golden rows cannot skew
    it. Those values are written before model rows are joined to them, so a
    title shared by many model rows can be split over tasks. Without ``fuzzy``
    the cascade ends after the exact titles.
    """
    return _cascade(ai, golden, ai_id, ai_title, ai_pred, golden_title, golden_doi, ai_doi, threshold, fuzzy, False)[0]


def match_both(ai: DataFrame, golden: DataFrame, ai_id: str, ai_title: str, ai_pred: str, golden_title: str,
               golden_doi: str | None = None, ai_doi: str | None = None, threshold: int = D.FUZZY_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The rows of ``match_cascade``, written, and the golden rows that none of them matched, from one fuzzy join."""
    matched, hits = _cascade(ai, golden, ai_id, ai_title, ai_pred, golden_title, golden_doi, ai_doi, threshold, True, True)
    matched = materialise(matched, "matched-rows")
    return matched, unmatched_golden(matched, golden, golden_title, golden_doi, threshold, hits)


def _cascade(ai, golden, ai_id, ai_title, ai_pred, golden_title, golden_doi, ai_doi, threshold, fuzzy, both) -> tuple[DataFrame, DataFrame | None]:
    """The matched rows, and the golden token-sorted titles that have a fuzzy partner (``both``)."""
    a = ai.select(F.col(ai_id).alias("ai_id"), F.col(ai_title).alias("title"),
                  F.col(ai_pred).cast("int").alias("y_pred"),
                  normalize_doi(F.col(ai_doi or ai_title)).alias("doi_norm"),
                  normalize_title(F.col(ai_title)).alias("title_norm"))
    g_title = golden.select(normalize_title(F.col(golden_title)).alias("title_norm")).distinct()
    if golden_doi is not None:
        g_doi = (golden.select(normalize_doi(F.col(golden_doi)).alias("doi_norm"))
                 .where(F.col("doi_norm").isNotNull()).distinct().withColumn("_id_hit", F.lit(True)))
        a = a.join(materialise(g_doi, "golden-ids"), "doi_norm", "left")
        id_hit = F.coalesce(F.col("_id_hit"), F.lit(False)) & (F.length("doi_norm") > 0)
    else:
        id_hit = F.lit(False)
    a = a.withColumn("_id", id_hit)
    g_title = materialise(g_title, "golden-titles")
    a = a.join(g_title.withColumn("_exact", F.lit(True)), "title_norm", "left") \
        .withColumn("_exact", F.coalesce(F.col("_exact"), F.lit(False)))
    a = a.withColumn("_sorted", token_sort(F.col("title_norm")))
    if fuzzy:
        todo = a.where(~F.col("_id") & ~F.col("_exact")).select(F.col("_sorted").alias("s"))
        g_sorted = g_title.select(token_sort(F.col("title_norm")).alias("s"))
        told = materialise(fuzzy_matches(todo, g_sorted, threshold, both), "fuzzy-titles")
        hits = told.where("side = 0").select(F.col("s").alias("_sorted"), F.lit(True).alias("_fuzzy"))
        a = a.join(hits, "_sorted", "left")
    else:
        told = None
        a = a.withColumn("_fuzzy", F.lit(None).cast("boolean"))
    kind = (F.when(F.col("_id"), F.lit("id"))
            .when(F.col("_exact"), F.lit("exact"))
            .when(F.col("_fuzzy").isNotNull(), F.lit("fuzzy"))
            .otherwise(F.lit("none")))
    rows = a.select("ai_id", "title", "y_pred", "doi_norm", "title_norm",
                    F.col("_sorted").alias("title_sorted"), kind.alias("match_kind"),
                    F.when(kind != "none", F.lit(1)).otherwise(F.lit(0)).alias("y_true"))
    return rows, told.where("side = 1").select("s") if both else None


def cascade_counts(matched: DataFrame, golden: DataFrame, unmatched: DataFrame | None = None) -> DataFrame:
    """Confusion counts of a cascade, unmatched golden rows counted as FN.

    ``padding`` = max(golden rows - matched model rows, 0), the published
    arithmetic (it under-counts when several model rows hit one golden row);
    when ``unmatched`` (see ``unmatched_golden``) is given, its row count is
    reported as ``unmatched_human``. One aggregate over the union of the
    inputs, no join.
    """
    def side(df, tag):
        return df.select(F.lit(None).cast("int").alias("y_true"), F.lit(None).cast("int").alias("y_pred"),
                         F.lit(tag).alias("_s"))

    parts = matched.select(F.col("y_true").cast("int").alias("y_true"), F.col("y_pred").cast("int").alias("y_pred"),
                           F.lit(0).alias("_s")).unionByName(side(golden, 1))
    if unmatched is not None:
        parts = parts.unionByName(side(unmatched, 2))
    t, p, s = F.col("y_true"), F.col("y_pred"), F.col("_s")
    counts = parts.agg(
        F.count_if((t == 1) & (p == 1)).alias("tp"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 0) & (p == 0)).alias("tn"),
        F.count_if((t == 1) & (p == 0)).alias("fn_matched"),
        F.count_if(t == 1).alias("matched"),
        F.count_if(s == 1).alias("n_golden"),
        F.count_if(s == 2).alias("unmatched_human"),
    )
    pad = F.greatest(F.col("n_golden") - F.col("matched"), F.lit(0))
    out = counts.select("tp", "fp", "tn", (F.col("fn_matched") + pad).alias("fn"),
                        pad.alias("padding"), "matched", "n_golden", "unmatched_human")
    return out if unmatched is not None else out.drop("unmatched_human")


def unmatched_golden(matched: DataFrame, golden: DataFrame, golden_title: str,
                     golden_doi: str | None = None, threshold: int = D.FUZZY_THRESHOLD, fuzzy_hits: DataFrame | None = None) -> DataFrame:
    """Golden rows that no model row matched by identifier, exact or fuzzy title.

    ``fuzzy_hits``: the token-sorted golden titles with a fuzzy partner, where they
    are known (``match_both``); without them they are looked for."""
    g = golden.select("*", normalize_title(F.col(golden_title)).alias("_tn"),
                      (normalize_doi(F.col(golden_doi)) if golden_doi else F.lit(None).cast("string")).alias("_dn"))
    g = g.withColumn("_ts", token_sort(F.col("_tn")))
    by_id = matched.where(F.col("match_kind") == "id").select(F.col("doi_norm").alias("_dn")).distinct()
    by_exact = matched.where(F.col("match_kind") == "exact").select(F.col("title_norm").alias("_tn")).distinct()
    if fuzzy_hits is None:
        fuzzy_ai = matched.where(F.col("match_kind") == "fuzzy").select(F.col("title_sorted").alias("s"))
        fuzzy_hits = fuzzy_semi_join(g.select(F.col("_ts").alias("s")), fuzzy_ai, threshold)
    by_fuzzy = fuzzy_hits.select(F.col("s").alias("_ts")).distinct()
    left = g.join(by_id, "_dn", "left_anti").join(by_exact, "_tn", "left_anti").join(by_fuzzy, "_ts", "left_anti")
    return left.drop("_tn", "_dn", "_ts")

"""Components of "few bits apart" among the signatures of one block, or of two.

No pair inside a known component is compared: signatures that agree on the bits
of a mask are brought together by sorting, and only those of different labels
meet, so a dense neighbourhood is joined once and then passed over.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np

from shelfmark.functions.hashing import HASH_BITS
from shelfmark.operators.components import star_forest

STEP = 1 << 17  # pairs compared at a time
SPARE = 6  # bits of a band value beyond those that number the rows
MASK = 32  # comparisons that cost as much as one row under one mask
LOOKUP = 16  # comparisons that cost as much as one candidate of a mask
SAMPLE = 4_096  # rows by which bits are dealt to bands; only the cost hangs on it


def compare_all(left: np.ndarray, right: np.ndarray, distance: int):
    """Chunks (at, to) of every pair of rows at most ``distance`` bits apart."""
    rows = max(1, STEP // len(right))
    bits = np.empty((rows, len(right)), np.uint64)
    count, near = np.empty(bits.shape, np.uint8), np.empty(bits.shape, bool)
    for start in range(0, len(left), rows):
        own = left[start:start + rows]
        n = len(own)
        np.bitwise_xor(own[:, None], right[None, :], out=bits[:n])
        np.bitwise_count(bits[:n], out=count[:n])
        np.less_equal(count[:n], distance, out=near[:n])
        at, to = np.divmod(np.flatnonzero(near[:n]), len(right))
        yield at + start, to


def spans(first: np.ndarray, last: np.ndarray):
    """Chunks (a, b, at) with ``at`` all numbers from first[i] to last[i] of the rows a to b.

    A row more than fits, so at most STEP numbers and one row's.
    """
    size = last - first
    ends = np.cumsum(size)
    start = 0
    while start < len(first):
        done = ends[start - 1] if start else 0
        stop = min(len(first), int(np.searchsorted(ends, done + STEP)) + 1)
        n = size[start:stop]
        shift = ends[start:stop] - n - done - first[start:stop]
        yield start, stop, np.arange(int(n.sum())) - np.repeat(shift, n)
        start = stop


class _Bands:
    """The bits of signatures dealt into bands that tell them apart about equally well."""

    def __init__(self, sigs: np.ndarray, bands: int):
        sample = sigs[::-(-len(sigs) // SAMPLE)]
        ones = np.array([(sample >> np.uint64(i) & np.uint64(1)).mean() for i in range(HASH_BITS)])
        order = np.argsort(np.abs(ones - 0.5), kind="stable")
        self.number = np.arange(len(sigs), dtype=np.uint64)
        self.number_bits = max(1, (len(sigs) - 1).bit_length())
        self.parts = []
        for b in range(bands):
            bits = order[b::bands]
            value = np.zeros(len(sigs), np.uint64)
            for i in bits:
                value = value << np.uint64(1) | (sigs >> np.uint64(i) & np.uint64(1))
            small = np.uint16 if len(bits) <= 16 else np.uint64
            self.parts.append((value.astype(small), len(bits)))

    def sort(self, chosen, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(values of the chosen bands, sorted; their places in ``rows``, in order within a value).

        Bands that don't fit beside the place are left out: rows then agree on less.
        """
        value, width = np.zeros(len(self.number), np.uint64), 0
        for b in chosen:
            part, bits = self.parts[b]
            if width + bits + self.number_bits > 64:
                break
            value = value << np.uint64(bits) | part
            width += bits
        if rows is not None:
            value = value[rows]
        value = value << np.uint64(self.number_bits) | self.number
        value.sort()
        at = value & np.uint64((1 << self.number_bits) - 1)
        return value >> np.uint64(self.number_bits), at.astype(np.int64)


class _Labels:
    def __init__(self, low: np.ndarray):
        self.low = low

    def join(self, one: np.ndarray, two: np.ndarray) -> bool:
        a, b = self.low[one], self.low[two]
        new = a != b
        if not new.any():
            return False
        root, node = star_forest(a[new], b[new])
        roots = np.arange(len(self.low))
        roots[node] = root
        self.low = roots[self.low]
        return True


def _cross(value: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, first, last): what a row of the sorted values has to meet, labels parted in a value.

    Rows of a value lie by label; a row meets those of its value behind its label.
    """
    n = len(value)
    fresh = np.ones(n, bool)
    np.not_equal(value[1:], value[:-1], out=fresh[1:])
    parted = fresh.copy()
    parted[1:] |= label[1:] != label[:-1]
    starts, runs = np.flatnonzero(parted), np.flatnonzero(fresh)
    ends = np.append(starts[1:], n)
    last = np.append(runs[1:], n)[np.searchsorted(runs, starts, "right") - 1]
    mixed = ends < last
    starts, ends, last = starts[mixed], ends[mixed], last[mixed]
    size = ends - starts
    rows = np.arange(int(size.sum())) + np.repeat(starts - np.cumsum(size) + size, size)
    return rows, np.repeat(ends, size), np.repeat(last, size)


def _free_bands(n: int) -> int:
    """How many bands agree, so that their value tells some 2 ** SPARE times ``n`` rows apart."""
    return 1 if n < 2 else math.ceil(math.log2(n) + SPARE)


def link_rows(
    sigs: np.ndarray, distance: int, bands: int | None = None,
    low: np.ndarray | None = None, split: int = 0,
) -> np.ndarray:
    """The lowest row of every row's component under "at most ``distance`` bits apart".

    ``low`` are labels known before, themselves lowest rows. With ``split``, rows
    before and behind it are linked as far as they go among themselves, and only
    what joins the two sides is looked for. ``bands`` changes the cost only.
    """
    n = len(sigs)
    labels = _Labels(np.arange(n) if low is None else low)
    if n < 2:
        return labels.low
    if bands is None:  # the fewest whose agreeing bits suffice
        wanted = _free_bands(n)
        bands = next((b for b in range(distance + 1, HASH_BITS + 1)
                      if HASH_BITS * (b - distance) >= wanted * b), HASH_BITS + 1)
    cells = split * (n - split) if split else n * n
    if bands > HASH_BITS or math.comb(bands, distance) * MASK * n > cells or not _by_masks(
            sigs, distance, bands, labels, cells // LOOKUP):
        for at, to in compare_all(sigs[:split or n], sigs[split:], distance):
            labels.join(at, to + split)
    return labels.low


def _by_masks(sigs: np.ndarray, distance: int, bands: int, labels: _Labels, most: int) -> bool:
    """Joins all that is near; False, and only some joined, when it takes over ``most`` candidates."""
    dealt = _Bands(sigs, bands)
    for b in range(bands):  # neighbours in some order: most of a dense place, at once
        _, at = dealt.sort([(b + i) % bands for i in range(bands)])
        own = sigs[at]
        for gap in (1, 2):
            near = np.bitwise_count(own[gap:] ^ own[:-gap]) <= distance
            labels.join(at[gap:][near], at[:-gap][near])
    order, spent = None, 0
    # At most ``distance`` of the bands differ, so the others agree.
    for chosen in combinations(range(bands), bands - distance):
        if order is None:
            order = np.argsort(labels.low, kind="stable")
            held = labels.low[order]
        value, at = dealt.sort(chosen, order)
        rows, first, last = _cross(value, held[at])
        met = int((last - first).sum())
        spent += met
        if spent > most:
            return False
        spot = order[at]
        own, joined = sigs[spot], False
        for a, b, to in spans(first, last):
            one = np.repeat(rows[a:b], last[a:b] - first[a:b])
            near = np.flatnonzero(np.bitwise_count(own[one] ^ own[to]) <= distance)
            joined |= labels.join(spot[one[near]], spot[to[near]])
        if joined and met > len(sigs):
            order = None  # labels that were joined since lie together again
    return True

"""Content-chosen anchors of fixed-length byte strings.

Every string of ``LENGTH`` bytes contains ``WIDTH`` grams of ``GRAM`` bytes; the one with the least hash (the first of
equals) is the string's anchor. Equal strings have the same anchor at the same place, so strings need to be compared
with those of an equal anchor only, and the strings of one anchor occurrence begin at consecutive bytes: a run.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from tidewatch.llm.words import mix

LENGTH, WIDTH = 100, 64
GRAM = LENGTH - WIDTH + 1
_PLACE_BITS = 24
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
#: A block has to stay below the places that fit beside a hash.
BLOCK = 1 << 21


class Runs(NamedTuple):
    row: np.ndarray      # text of each run, counted within the block
    start: np.ndarray    # byte of the block where the run's first string begins
    count: np.ndarray    # strings in the run
    anchor: np.ndarray   # byte of the block where the anchor begins
    key: np.ndarray      # hash of the anchor, spread anew, as anchors are those of small hashes


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each byte on, from the hashes of its eight-byte pieces (the last two overlap)."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    eight = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    piece = mix(eight)
    h = piece[:n].copy()
    for at in (*range(8, GRAM - 7, 8), GRAM - 8):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += piece[at:at + n]
    return mix(h)


def runs(data: np.ndarray, offsets: np.ndarray) -> Runs:
    """The runs of a block of texts, given their bytes (fewer than 2**24) and offsets."""
    h = gram_hashes(data)
    strings = len(data) - LENGTH + 1
    if strings <= 0:
        none = np.empty(0, np.int64)
        return Runs(none, none, none, none, none.astype(np.uint64))
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span < WIDTH:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    place = (least[:strings] & _PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:strings]
    inside = np.arange(strings) + LENGTH <= offsets[1:][row]
    new = np.append(True, (place[1:] != place[:-1]) | (row[1:] != row[:-1]))
    # strings that would cross the end of a text are no strings; they follow those that are
    begins = np.flatnonzero(new & inside)
    total = np.concatenate(([0], np.cumsum(inside)))
    ends = np.append(np.flatnonzero(new), strings)
    last = ends[np.searchsorted(ends, begins, "right")]
    return Runs(row[begins], begins, total[last] - total[begins], place[begins], mix(~h[place[begins]]))

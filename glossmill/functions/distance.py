"""Levenshtein distances of many pairs at once, by bit vectors along a band.

Along the diagonal of the distance table, what changes from row to row within a band is
held as bits of a word that slides down a row with every column (Hyyrö 2003).  For the
narrowest band a word is 64 bits and all pairs of a batch advance together; the few pairs
further apart are done one by one with Python's whole numbers as words, the band widening
until it holds the distance.  So work grows with length times distance, not with the
square of the length.
"""

from __future__ import annotations

import numpy as np

WORD = 64
#: The greatest distance that the 64-bit band holds.
NEAR = 31
#: By how much the band widens from one try to the next.
WIDER = 4
#: Characters of the pairs that advance together.
BATCH_CHARS = 1 << 22
#: Cells of a table by row and character, for each character of the texts, up to which it is not sorted instead.
DENSE = 8
#: Longer texts are not worked in batches, as their tables would be large.
BATCH_TEXT = 1 << 16


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _tables(rows: np.ndarray, places: np.ndarray, codes: np.ndarray, lengths: np.ndarray, others: np.ndarray, other_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each character of a row's text stands in it, as bits, and for the other text's characters where that table starts.

    A table has a word of zeros before and two behind, so a window may lie beyond the
    text's ends.  Characters that the row's text lacks have the zeros at 0.
    """
    seen = np.zeros(int(max(codes.max(), other_codes.max())) + 1, np.int64)
    seen[codes] = 1
    seen[other_codes] = 1
    numbers = np.cumsum(seen) - 1
    base = int(numbers[-1]) + 1
    own, wanted = rows * base + numbers[codes], others * base + numbers[other_codes]
    if len(lengths) * base <= DENSE * len(codes):  # a cell for each row and character
        cells = np.zeros(len(lengths) * base, bool)
        cells[own] = True
        keys, places_of = np.flatnonzero(cells), np.cumsum(cells) - 1
        inverse, at, known = places_of[own], np.maximum(places_of[wanted], 0), cells[wanted]
    else:
        keys, inverse = np.unique(own, return_inverse=True)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        known = keys[at] == wanted
    words = -(-lengths // WORD) + 3
    sizes = words[keys // base]
    # The first table is all zeros and as long as the longest.
    starts = int(words.max()) + _starts(sizes)
    table = np.zeros(int(starts[-1] + sizes[-1]), np.uint64)
    np.add.at(table, starts[inverse] + 1 + places // WORD, np.uint64(1) << (places % WORD).astype(np.uint64))
    return table, np.where(known, starts[at], 0)


def near_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Distances of pairs of texts up to `NEAR`, beyond that -1.  Both texts of a pair are longer than `NEAR`."""
    lengths_a, lengths_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out = np.full(len(a), -1, np.int64)
    order = np.flatnonzero(np.abs(lengths_a - lengths_b) <= NEAR)
    if not len(order):
        return out
    # The longest second text first, so that those still advancing are always the first ones.
    order = order[np.argsort(-lengths_b[order], kind="stable")]
    first, second = [a[i] for i in order], [b[i] for i in order]
    n_a, n_b = lengths_a[order], lengths_b[order]
    rows_a, rows_b = np.repeat(np.arange(len(order)), n_a), np.repeat(np.arange(len(order)), n_b)
    table, found = _tables(rows_a, np.arange(len(rows_a)) - np.repeat(_starts(n_a), n_a), _codes(first), n_a, rows_b, _codes(second))
    columns = _starts(n_b)

    one, top = np.uint64(1), np.uint64(WORD - 1)
    plus = np.full(len(order), ~np.uint64(0) << np.uint64(WORD - NEAR - 1), np.uint64)
    minus = np.zeros(len(order), np.uint64)
    distance = np.full(len(order), NEAR, np.int64)
    # From this column on the band's last row lies beyond the first text; its end moves up in the word instead.
    turn = n_a - NEAR
    column, alive = 0, len(order)
    while alive:
        alive = int(np.searchsorted(-n_b[:alive], -column, side="left"))  # texts longer than the columns done
        if not alive:
            break
        at = found[columns[:alive] + column]
        word, shift = divmod(column + NEAR + 1 - WORD, WORD)
        same = table[at + 1 + word]
        if shift:
            same = same >> np.uint64(shift) | table[at + 2 + word] << np.uint64(WORD - shift)
        up, down = plus[:alive], minus[:alive]
        flat = ((same & up) + up ^ up) | same | down
        rise, fall = down | ~(flat | up), flat & up
        on = column < turn[:alive]
        # Along the diagonal a column costs 1 unless it is flat; beyond the text's end its last row rises or falls.
        end = np.where(on, 0, np.minimum(column - turn[:alive] + 1, WORD - 1)).astype(np.uint64)
        bit = top - end
        steps = np.where(on, one - (flat >> top), (rise >> bit & one) - (fall >> bit & one))
        distance[:alive] += steps.astype(np.int64)
        flat >>= one
        plus[:alive], minus[:alive] = fall | ~(flat | rise), flat & rise
        column += 1
    out[order] = np.where(distance <= NEAR, distance, -1)
    return out


def band_distance(a: str, b: str, most: int) -> int:
    """The distance of two texts if it is at most `most`, else a greater number.  Both are longer than `most`."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    width = 2 * most + 1
    every, top = (1 << width) - 1, 1 << width - 1
    # Bit i of a word is row column + i - most.  A character's bits are shifted when they are looked at.
    bits: dict[str, int] = {}
    of: dict[str, int] = {}
    for row, x in enumerate(a[:most]):
        bits[x], of[x] = bits.get(x, 0) | 1 << row + most, 0
    plus, minus, distance, end = every >> most << most, 0, most, top
    turn = len(a) - most
    for column, y in enumerate(b):
        if column < turn:
            x = a[column + most]
            bits[x], of[x] = bits.get(x, 0) >> column - of.get(x, column) | top, column
        same = bits.get(y, 0) >> column - of.get(y, column)
        flat = ((same & plus) + plus ^ plus) | same | minus
        rise, fall = minus | every & ~(flat | plus), flat & plus
        if column < turn:
            distance += not flat & top
        else:
            end >>= 1
            distance += bool(rise & end) - bool(fall & end)
        flat = flat >> 1 & every >> 1
        plus, minus = fall | every & ~(flat | rise), flat & rise
    return distance


def _full(a: str, b: str) -> int:
    """The distance by all of the table, a column at a time as the bits of two whole numbers (up and down steps)."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = every, 0, len(a)
    for y in b:
        same = at.get(y, 0)
        flat = ((same & up) + up ^ up) | same | down
        rise, fall = down | every & ~(flat | up), up & flat
        distance += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & every, fall << 1 & every
        up, down = fall | every & ~(flat | rise), rise & flat
    return distance


def distance(a: str, b: str) -> int:
    """Levenshtein distance of two texts, by wider and wider bands and at last the whole table."""
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    most = NEAR if len(a) > BATCH_TEXT else NEAR * WIDER
    while 2 * most < len(a):
        found = band_distance(a, b, most)
        if found <= most:
            return found
        most *= WIDER
    return _full(a, b)


def distances(a: list[str | None], b: list[str | None]) -> list[int | None]:
    """Levenshtein distances of many pairs in code points; a null side gives null."""
    out: list[int | None] = [None if x is None or y is None else 0 if x == y else -1 for x, y in zip(a, b, strict=True)]
    held: list[int] = []
    size = 0
    long_ = [i for i, d in enumerate(out) if d == -1 and NEAR < min(len(a[i]), len(b[i])) <= BATCH_TEXT]
    for i in [*long_, -1]:
        if held and (i < 0 or size > BATCH_CHARS):
            for k, found in zip(held, near_distances([a[k] for k in held], [b[k] for k in held]).tolist(), strict=True):
                out[k] = found
            held, size = [], 0
        if i >= 0:
            held.append(i)
            size += len(a[i]) + len(b[i])
    return [distance(a[i], b[i]) if d == -1 else d for i, d in enumerate(out)]

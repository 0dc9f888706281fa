"""Induced sorting of the suffixes of many short strings, with common prefixes, past memory.

Suffixes are classed as S (smaller than the next) or L. The suffixes at S positions after an L
position are sorted first: their pieces of text are named in order, and where names repeat the string
of names is sorted by the same procedure. From them the L suffixes are induced in ascending order,
and from those the S suffixes in descending order: a suffix taken from the front of a priority queue
puts the one that starts a symbol before it into the queue. The queue's blocks hold suffixes and the
length of the prefix each shares with the block's suffix before; blocks that don't fit in
memory are on disk until their symbol's turn.
"""

from __future__ import annotations

import tempfile
from heapq import heappop, heappush
from itertools import repeat

import numpy as np

#: Bytes of queued blocks that stay in memory.
QUEUE_BYTES = 3 << 20


class DiskQueue:
    """Priority queue of blocks: by symbol (ascending, or descending), then in order of arrival.

    Arrival is monotone, as induction never puts a suffix before one that was taken, so a symbol's
    blocks form a line. Beyond ``limit`` bytes the line that is due last goes to a file.
    """

    def __init__(self, descending: bool = False, limit: int = QUEUE_BYTES, folder: str | None = None):
        self.sign, self.limit, self.folder = -1 if descending else 1, limit, folder
        self.lines: dict[int, list] = {}
        self.files: dict[int, object] = {}
        self.due: list[int] = []
        self.held = 0

    def put(self, symbol: int, suffixes: np.ndarray, shared: np.ndarray) -> None:
        line = self.lines.get(symbol)
        if line is None:
            if symbol not in self.files:
                heappush(self.due, self.sign * symbol)
            line = self.lines[symbol] = []
        line.append((suffixes, shared))
        self.held += suffixes.nbytes + shared.nbytes
        if self.held > self.limit:  # well below the limit, so that a line doesn't go out bit by bit
            for last in sorted(self.lines, key=lambda s: self.sign * s)[:0:-1]:
                self._spill(last)
                if 2 * self.held <= self.limit:
                    break

    def _spill(self, symbol: int) -> None:
        file = self.files.get(symbol)
        if file is None:
            file = self.files[symbol] = tempfile.TemporaryFile(dir=self.folder)
        for part in map(np.concatenate, zip(*self.lines.pop(symbol), strict=True)):
            np.save(file, part)
            self.held -= part.nbytes

    def next_symbol(self) -> int | None:
        return self.sign * self.due[0] if self.due else None

    def take(self, symbol: int):
        """The blocks of the symbol that is due, those included that arrive meanwhile."""
        while True:
            line = self.lines.setdefault(symbol, [])  # what arrives meanwhile is not due again
            if (file := self.files.pop(symbol, None)) is not None:
                end = file.tell()
                file.seek(0)
                while file.tell() < end:
                    yield np.load(file), np.load(file)
                file.close()
            if not line:
                break
            block = line.pop(0)
            self.held -= block[0].nbytes + block[1].nbytes
            yield block
        self.lines.pop(symbol, None)
        if self.due and self.sign * self.due[0] == symbol:
            heappop(self.due)


def classes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is S, is first S after L) for each position; separators are 0, differ from each other and are S."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int64)))  # of position k against k + 1
    known = np.append(step != 0, True)
    nearest = np.arange(n)
    nearest[~known] = n
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]  # the next position that differs from its successor
    small = np.append(step > 0, True)[nearest]
    small[text == 0] = True
    star = small.copy()
    star[0] = small[0] and text[0] == 0
    star[1:] &= ~small[:-1] | (text[1:] == 0)
    return small, star


def _names(text: np.ndarray, star: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the pieces between neighbouring stars, in order; a piece that goes on is before one that ends."""
    ends = np.append(star[1:], len(text) - 1) + 1
    if text.dtype == np.uint8:
        raw = text.tobytes()
        pieces = [raw[a:b] + b"\xff" for a, b in zip(star.tolist(), ends.tolist(), strict=True)]
    else:
        raw = text.tolist()
        high = 1 << 62
        pieces = [(*raw[a:b], high) for a, b in zip(star.tolist(), ends.tolist(), strict=True)]
    zero = text[star] == 0
    order = dict.fromkeys(pieces)
    for piece in {p for p, z in zip(pieces, zero.tolist(), strict=True) if z}:
        del order[piece]
    order = dict(zip(sorted(order), range(1, len(order) + 1), strict=True))
    names = np.fromiter(map(order.get, pieces, repeat(0)), np.int64, len(pieces))
    return names, len(order)


def _sorted_stars(text: np.ndarray, star: np.ndarray) -> np.ndarray:
    """The star positions in the order of their suffixes."""
    names, kinds = _names(text, star)
    if kinds == int((names > 0).sum()):
        return star[np.argsort(names, kind="stable")]
    return star[_order(names)]


def _order(text: np.ndarray) -> np.ndarray:
    """Suffixes of a string of names in order, by the same induction, a suffix at a time: lines are short here."""
    small, first = classes(text)
    star = np.flatnonzero(first)
    seeds = _sorted_stars(text, star)
    kinds = int(text.max()) + 1 if len(text) else 1
    # the symbol that a suffix puts into the queue, or none
    before = np.append(-1, text[:-1])
    smaller_before = np.append(False, small[:-1])
    to_large = np.where(~smaller_before & (before >= 0), before, -1).tolist()
    to_small = np.where(smaller_before & (before > 0), before, -1).tolist()

    def by_symbol(suffixes: np.ndarray) -> list[list[int]]:
        cuts = np.searchsorted(text[suffixes], np.arange(kinds + 1))
        listed = suffixes.tolist()
        return [listed[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    seeded = by_symbol(seeds)
    lines: list[list[int]] = [[] for _ in range(kinds)]
    for c in range(kinds):
        for group in (lines[c], seeded[c]):
            for p in group:  # the line of c grows while it is read
                if (d := to_large[p]) >= 0:
                    lines[d].append(p - 1)
    large, lines = lines, [[] for _ in range(kinds)]
    for c in range(kinds - 1, 0, -1):
        for group in (lines[c], reversed(large[c])):
            for p in group:
                if (d := to_small[p]) >= 0:
                    lines[d].append(p - 1)
    out: list[int] = np.flatnonzero(text == 0).tolist()
    for c in range(1, kinds):
        out.extend(large[c])
        out.extend(reversed(lines[c]))
    return np.array(out, np.int64)


def _shared_prefixes(words: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Lengths of the common prefixes of pairs of suffixes, up to ``most`` and to a string's end."""
    out = np.full(len(a), most, np.int64)
    open_, at = np.arange(len(a)), 0
    while len(open_) and at < most:
        x, y = (np.minimum(side[open_] + at, len(words) - 1) for side in (a, b))
        differ = words[x] ^ words[y]
        parted = differ != 0
        low = differ[parted]
        low &= ~low + np.uint64(1)
        out[open_[parted]] = at + (np.frexp(low.astype(np.float64))[1] - 1) // 8
        open_ = open_[~parted]
        at += 8
    left = ends[np.searchsorted(ends, a)] - a
    return np.minimum(np.minimum(out, left), most)


def _push(queue: DiskQueue, text: np.ndarray, before: np.ndarray, at: np.ndarray, shared: np.ndarray, carry: np.ndarray, most: int) -> None:
    """Put what a block induces into the queue.

    ``before``: the induced suffixes, from the rows ``at`` of a block whose ``shared`` gives the
    prefix of each row with the row taken before. Two suffixes that get to one symbol in turn share
    a symbol and what their sources share: the least over the rows since. ``carry`` has that least
    value for each symbol since its last suffix.
    """
    symbols = text[before]
    present = np.unique(symbols)
    least = shared.min()
    other = np.ones(len(carry), bool)
    other[present] = False
    carry[other] = np.minimum(carry[other], least)
    for symbol in present.tolist():
        mine = symbols == symbol
        rows = at[mine]
        ends = np.append(rows + 1, len(shared))
        mins = np.minimum.reduceat(np.append(shared, most), np.concatenate([[0], ends[:-1]]))
        mins[0] = min(mins[0], carry[symbol])
        carry[symbol] = mins[-1] if ends[-2] < len(shared) else most
        queue.put(symbol, before[mine], np.minimum(mins[:-1] + 1, most).astype(np.int16))


def suffix_array(raw: bytes, most: int, limit: int = QUEUE_BYTES, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, prefix shared with the one before, up to ``most``) of strings that end with byte 0 each.

    Separators come first, in the order of their places. Other suffixes are in the order of their
    symbols up to the string's end, then of the ends' places. What lies past an end isn't shared.
    """
    text = np.frombuffer(raw, np.uint8)
    small, first = classes(text)
    star = _sorted_stars(text, np.flatnonzero(first))
    star = star[text[star] > 0]
    ends = np.flatnonzero(text == 0)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(text) + 1,), (1,))  # eight bytes from each place

    def at_border(a: int, b: int) -> int:
        return int(_shared_prefixes(words, ends, np.array([a]), np.array([b]), most)[0])

    star_shared = np.zeros(len(star), np.int16)
    star_shared[1:] = _shared_prefixes(words, ends, star[:-1], star[1:], most)
    bounds = np.searchsorted(text[star], np.arange(257))

    queue, carry = DiskQueue(False, limit, folder), np.zeros(256, np.int64)
    large: dict[int, list] = {}
    _take(queue, text, small, False, ends, np.zeros(len(ends), np.int16), carry, most)
    for c in range(1, 256):
        seeds = star[bounds[c] : bounds[c + 1]]
        last = -1
        fresh = True
        if queue.next_symbol() == c:
            for block, shared in queue.take(c):
                if fresh:
                    shared[0], fresh = 0, False
                large.setdefault(c, []).append((block, shared))
                last = int(block[-1])
                _take(queue, text, small, False, block, shared, carry, most)
        if len(seeds):
            shared = star_shared[bounds[c] : bounds[c + 1]].copy()
            shared[0] = at_border(last, int(seeds[0])) if last >= 0 else 0
            _take(queue, text, small, False, seeds, shared, carry, most)

    queue, carry = DiskQueue(True, limit, folder), np.zeros(256, np.int64)
    suffixes, lcps = [], []
    for c in range(255, 0, -1):
        taken, last, fresh = [], -1, True
        if queue.next_symbol() == c:
            for block, shared in queue.take(c):
                if fresh:
                    shared[0], fresh = 0, False
                taken.append((block, shared))
                last = int(block[-1])
                _take(queue, text, small, True, block, shared, carry, most)
        border = 0
        if c in large:
            block = np.concatenate([x for x, _ in large[c]])
            shared = np.concatenate([x for _, x in large[c]])
            down = np.append(shared[1:], 0)[::-1].copy()
            border = at_border(int(block[-1]), last) if last >= 0 else 0
            down[0] = border
            _take(queue, text, small, True, block[::-1], down, carry, most)
        if taken:
            up = np.concatenate([x for x, _ in taken])[::-1]
            shared_up = np.append(np.concatenate([x for _, x in taken])[1:][::-1], 0)
            # descending, a row holds what it shares with the row above it; ascending, with the one below
            shared_up = np.concatenate([[border], shared_up[:-1]]).astype(np.int16)
            suffixes.append(up)
            lcps.append(shared_up)
        if c in large:
            shared[0] = 0
            suffixes.append(block)
            lcps.append(shared)
    suffixes.append(ends)
    lcps.append(np.zeros(len(ends), np.int16))
    return np.concatenate(suffixes[::-1]), np.concatenate(lcps[::-1])


def _take(queue: DiskQueue, text: np.ndarray, small: np.ndarray, want_small: bool, block: np.ndarray, shared: np.ndarray, carry: np.ndarray, most: int) -> None:
    """Induce from one block: the suffixes a symbol before that are of the wanted class."""
    before = block - 1
    fits = (before >= 0) & (small[before] == want_small) & (text[before] > 0)
    at = np.flatnonzero(fits)
    if len(at):
        _push(queue, text, before[at], at, shared, carry, most)
    elif len(shared):
        np.minimum(carry, shared.min(), out=carry)

"""Substring dedup by collinear chaining: fuzzy passages that occur in an earlier document.

Seeds are the smallest of each six neighbouring five-word shingles. Occurrences of a seed are
joined with two partners each: the seed's first occurrence in the corpus and the one just before
in the order of documents, so n occurrences give fewer than 2n matches. The matches of a document
with one partner are chained: a chain's matches ascend in both documents, each adds its words and
pays for the gap before it, and a Fenwick tree over the partner's positions finds the best match to
continue from. Of the partner only the words round the chain travel. The chains' words are aligned,
gap by gap and outwards from the ends; a passage counts from 50 words and three quarters of equal
words on.

The seeds of one passage may have many partners, each with too few of them. So windows of 50 words
whose seeds all occur elsewhere are compared by their own hash with all earlier ones, but where the
aligned partner has the same words anyway, or where three or more of the window's seeds occur here
first (whoever has the window later is then chained with this document). An equal passage is found
whichever documents hold its seeds. A passage with edits is found where one of the two partners has
enough of its seeds.

A seed that a batch of documents has often sends one row to the seed's task; the others are spread
over all tasks and get the seed's first occurrence by a join afterwards. Requests for the words of
one document are dealt to several tasks where they are many.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Scratch, slots
from marlstone.llm.minimizers import _sliding_min
from marlstone.llm.near_dedup import WordHashes, windows, words_of
from marlstone.llm.substring_dedup import merged, remove

#: Words of a shingle; neighbouring shingles of which the smallest is a seed.
WORDS, NEIGHBOURS = 5, 6
#: Words of a passage at least, and equal words of 100.
PASSAGE, SIMILAR = 50, 75
#: What a word of a gap costs a chain, in either document; matches of a chain at least.
GAP_COST, LEAST_MATCHES = 0.1, 3
#: Words of a gap, in either document, over which an alignment is not carried on.
WIDEST_GAP = 64
#: An end is extended until it is this much worse than at its best (a word more equal: 1, unequal: -2).
DROP = 8

#: Seeds that are looked through at once for those that occur often, and how often that is.
BATCH, OFTEN = 400_000, 8
#: Words before and behind a chain that travel with it; where an end goes on beyond them, the whole text does.
MARGIN = 1000
#: Requests for the words of one document that a task serves.
REQUESTS = 2000
#: Rows of texts that go to Python at once.
LONG_ROWS = 500
#: Of a window's seeds, those that occur here first, up to which it is compared by its hash.
OWN = LEAST_MATCHES - 1

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_PLACE = np.uint64((1 << 24) - 1)
_BLOCK = 1 << 16


def seeds(data: bytes, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, word positions) of a text's seeds; a text of fewer words than a shingle has none."""
    words = words_of(data)
    if len(words) < WORDS:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = windows(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), WORDS)
    width = min(NEIGHBOURS, len(grams))
    out: list[np.ndarray] = []
    for low in range(0, len(grams) - width + 1, _BLOCK):
        part = grams[low : low + _BLOCK + width - 1]
        best = _sliding_min((part & ~_PLACE) | np.arange(len(part), dtype=np.uint64), width) & _PLACE
        out.append(np.unique(best).astype(np.int64) + low)
    at = np.unique(np.concatenate(out))
    return grams[at], at


class Fenwick:
    """Largest (value, item) over the positions before one; a slot never falls."""

    def __init__(self, size: int):
        self.values, self.items = [float("-inf")] * (size + 1), [-1] * (size + 1)

    def raise_to(self, at: int, value: float, item: int) -> None:
        at += 1
        while at < len(self.values):
            if value > self.values[at]:
                self.values[at], self.items[at] = value, item
            at += at & -at

    def best_before(self, at: int) -> tuple[float, int]:
        value, item = float("-inf"), -1
        while at:
            if self.values[at] > value:
                value, item = self.values[at], self.items[at]
            at &= at - 1
        return value, item


def chains(x: list[int], y: list[int]) -> list[list[int]]:
    """Chains over matches (x ascending), best first, as lists of match numbers; no match is in two.

    A chain's score: WORDS for each match, less GAP_COST for each word that x and y advance beyond
    a shingle from one match to the next. A chain that scores no more than a lone match starts anew.
    """
    n = len(x)
    rank = {v: k for k, v in enumerate(sorted(set(y)))}
    tree = Fenwick(len(rank))
    score, before = [0.0] * n, [-1] * n
    k = 0
    while k < n:
        end = k
        while end < n and x[end] == x[k]:  # matches at one place don't follow each other
            value, item = tree.best_before(rank[y[end]])
            value -= GAP_COST * (x[end] + y[end] - 2 * WORDS)
            score[end] = WORDS
            if item >= 0 and value > 0:
                score[end], before[end] = WORDS + value, item
            end += 1
        for j in range(k, end):
            tree.raise_to(rank[y[j]], score[j] + GAP_COST * (x[j] + y[j]), j)
        k = end
    used = [False] * n
    out = []
    for last in sorted(range(n), key=lambda j: (-score[j], j)):
        chain, j = [], last
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = before[j]
        if len(chain) >= LEAST_MATCHES:
            out.append(chain[::-1])
    return out


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, a bit for each word of ``a``."""
    where: dict[bytes, int] = {}
    for k, word in enumerate(a):
        where[word] = where.get(word, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        hit = row & where.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _reach(a: list[bytes], i: int, b: list[bytes], j: int, step: int) -> tuple[int, int, bool]:
    """(words, equal words) by which an end that starts at a[i], b[j] is worth extending, and whether ``b`` ended before that was clear."""
    score = best = n = equal = 0
    best_at = (0, 0)
    while 0 <= i < len(a) and 0 <= j < len(b) and score > best - DROP:
        n += 1
        if a[i] == b[j]:
            equal += 1
            score += 1
            if score > best:
                best, best_at = score, (n, equal)
        else:
            score -= 2
        i, j = i + step, j + step
    return *best_at, 0 <= i < len(a) and score > best - DROP


def align(a: list[bytes], b: list[bytes], chain: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int, int]], tuple[bool, bool]]:
    """(start, end, source start, source end) in words of the passages along a chain of matches in ``a`` and ``b``.

    Also whether ``b`` ended, before and behind, while a passage might have gone on.
    """
    parts: list[list] = []  # [x0, x1, y0, y1, equal words]
    for x, y in chain:
        if parts:
            part = parts[-1]
            dx, dy = x - part[1], y - part[3]
            if dx < 0 or dy < 0:  # shingles that overlap: only what is new counts, on one diagonal
                over = max(-dx, -dy)
                if dx == dy:
                    new = WORDS - over
                    if new > 0:
                        part[1], part[3], part[4] = x + WORDS, y + WORDS, part[4] + new
                    continue
                x, y = x + over, y + over
                dx, dy = x - part[1], y - part[3]
                length = WORDS - over
                if length <= 0:
                    continue
            else:
                length = WORDS
            if max(dx, dy) <= WIDEST_GAP:
                equal = common_words(a[part[1] : x], b[part[3] : y])
                if max(dx, dy) <= 8 or 2 * equal >= max(dx, dy):
                    part[1], part[3], part[4] = x + length, y + length, part[4] + equal + length
                    continue
            parts.append([x, x + length, y, y + length, length])
        else:
            parts.append([x, x + WORDS, y, y + WORDS, WORDS])
    out = []
    cut = [False, False]
    for x0, x1, y0, y1, equal in parts:
        n, more, short = _reach(a, x0 - 1, b, y0 - 1, -1)
        x0, y0, equal = x0 - n, y0 - n, equal + more
        cut[0] |= short
        n, more, short = _reach(a, x1, b, y1, 1)
        x1, y1, equal = x1 + n, y1 + n, equal + more
        cut[1] |= short
        if x1 - x0 >= PASSAGE and 100 * equal >= SIMILAR * max(x1 - x0, y1 - y0):
            out.append((x0, x1, y0, y1))
    return out, tuple(cut)


def equal_runs(a: list[bytes], b: list[bytes], chain: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) in ``a`` of the runs of PASSAGE words and more along a chain that ``b`` has, word for word."""
    out = []

    def close(x0: int, x1: int, shift: int) -> None:
        while x0 > 0 and x0 > shift and a[x0 - 1] == b[x0 - 1 - shift]:
            x0 -= 1
        while x1 < len(a) and x1 - shift < len(b) and a[x1] == b[x1 - shift]:
            x1 += 1
        if x1 - x0 >= PASSAGE:
            out.append((x0, x1))

    start, (x, y) = chain[0][0], chain[0]
    for u, v in chain[1:]:
        if u - x != v - y or a[x:u] != b[y:v]:
            close(start, x + WORDS, x - y)
            start = u
        x, y = u, v
    close(start, x + WORDS, x - y)
    return out


def _columns(names: str, *columns) -> pa.RecordBatch:
    """A batch of long columns, some with nulls: a column is an array or (array, where it is null)."""
    made = [pa.array(c[0], pa.int64(), mask=c[1]) if isinstance(c, tuple) else pa.array(c, pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays(made, names=names.split())


#: Kinds of rows on the way from seeds to matches: to the seed's task; the same, of a seed that is frequent in its batch; its other rows.
_ROW, _LEAD, _OTHER = 0, 1, 2
_SEEDS = "kind long, seed long, node long, at long, pred long, pred_at long"
_LINKED = "kind long, seed long, node long, at long, owner long, owner_at long, pred long, pred_at long"
_CHAINS = "node long, owner long, xs array<long>, ys array<long>"


def _spread(seed: np.ndarray, node: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """The rows of a batch: of a frequent seed the first leads, and the others have the one before as their partner."""
    by = np.argsort(seed, kind="stable")
    new = np.concatenate([[True], seed[by][1:] != seed[by][:-1]])
    cut = np.flatnonzero(new)
    often = (np.diff(np.append(cut, len(by))) >= OFTEN)[np.cumsum(new) - 1]
    rare, some = by[~often], by[often]
    some = some[np.lexsort((at[some], node[some], seed[some]))]
    s, n, a = seed[some], node[some], at[some]
    same = np.concatenate([[False], (s[1:] == s[:-1]) & (n[1:] == n[:-1]) & (a[1:] == a[:-1])])[: len(s)]  # a repeated row
    s, n, a = s[~same], n[~same], a[~same]
    lead = np.concatenate([[True], s[1:] != s[:-1]])[: len(s)]
    kind = np.concatenate([np.full(len(rare), _ROW), np.where(lead, _LEAD, _OTHER)])
    none = np.concatenate([np.ones(len(rare), bool), lead])
    before = lambda x: np.concatenate([np.zeros(len(rare), np.int64), x[:1], x[:-1]])[: len(kind)]
    return _columns("kind seed node at pred pred_at", kind, np.concatenate([seed[rare], s]), np.concatenate([node[rare], n]), np.concatenate([at[rare], a]), (before(n), none), (before(a), none))


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    out: list[list[np.ndarray]] = [[], [], []]
    size = 0
    for batch in batches:
        nodes = batch.column(0).to_pylist()
        for k, text in enumerate(batch.column(1)):
            h, at = seeds(text.as_py(), known)
            for column, part in zip(out, (h.view(np.int64), np.full(len(h), nodes[k]), at), strict=True):
                column.append(part)
            size += len(h)
            if size > BATCH:
                yield _spread(*map(np.concatenate, out))
                out, size = [[], [], []], 0
    if size:
        yield _spread(*map(np.concatenate, out))


def _ints(columns: list[list[np.ndarray]], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in columns], names=list(names))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (seed, node, at): occurrences of seeds that occur again, with the first (null for itself) and the one before.

    Of a seed with a leading row, the first occurrence comes as a row of the kind _LEAD too; rows of
    the kind _OTHER pass as they are.
    """
    names = "kind seed node at owner owner_at pred pred_at"
    held = None  # seed, owner, its place, node, place, whether the first is yet to be told
    for batch in batches:
        kind = batch.column(0).to_numpy()
        other = kind == _OTHER
        if other.any():
            x = batch.filter(pa.array(other))
            none = pa.nulls(x.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*x.columns[:4], none, none, *x.columns[4:]], names=names.split())
        seed, node, at = (batch.column(k).to_numpy()[~other] for k in (1, 2, 3))
        lead = kind[~other] == _LEAD
        if not len(seed):
            continue
        before = held or (None,) * 6
        again = np.concatenate([[(seed[0], node[0], at[0]) == (before[0], before[3], before[4])], (seed[1:] == seed[:-1]) & (node[1:] == node[:-1]) & (at[1:] == at[:-1])])
        new = np.concatenate([[held is None or before[0] != seed[0]], seed[1:] != seed[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(seed)), -1))
        carry = first < 0
        owner, owner_at = np.where(carry, before[1] or 0, node[first]), np.where(carry, before[2] or 0, at[first])
        if lead.any():
            _, some = np.unique(seed[lead], return_index=True)
            some = np.flatnonzero(lead)[some]
            none = (np.zeros(len(some), np.int64), np.ones(len(some), bool))
            yield _columns(names, np.full(len(some), _LEAD), seed[some], owner[some], owner_at[some], none, none, none, none)
        last, last_at = np.append(before[3] or 0, node[:-1]), np.append(before[4] or 0, at[:-1])
        later = ~new & ~again
        # a first occurrence is told when another follows, or when others went their own way
        group = np.cumsum(new)
        shared = np.zeros(group[-1] + 1, bool)
        shared[group[later | lead]] = True
        told = new & shared[group]
        nodes, places = [node[told], node[later]], [at[told], at[later]]
        untold = bool(before[5]) and not new[0]
        if untold and shared[0]:
            nodes.insert(0, np.array([before[1]]))
            places.insert(0, np.array([before[2]]))
            untold = False
        alone = sum(map(len, nodes[:-1]))
        pad = lambda x: np.concatenate([np.zeros(alone, np.int64), x[later]])
        none = np.arange(alone + int(later.sum())) < alone
        apart = none | (pad(last) == pad(owner)) & (pad(last_at) == pad(owner_at))
        total = len(none)
        if total:
            yield _columns(names, np.full(total, _ROW), (np.zeros(total, np.int64), np.ones(total, bool)), np.concatenate(nodes), np.concatenate(places), (pad(owner), none), (pad(owner_at), none), (pad(last), apart), (pad(last_at), apart))
        untold = untold if group[-1] == 0 else not shared[group[-1]]
        held = (seed[-1], owner[-1], owner_at[-1], node[-1], at[-1], untold)


def _stretches(at: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) starts of windows whose seeds all occur elsewhere and up to OWN of them here first.

    ``at``: places of the seeds that occur elsewhere, ascending; neighbouring seeds of a text are at
    most NEIGHBOURS words apart, and the outermost that a window surely holds as near to its ends.
    """
    near, far = NEIGHBOURS - 1, PASSAGE - WORDS - NEIGHBOURS + 1
    cut = np.flatnonzero(np.concatenate([[True], np.diff(at) > NEIGHBOURS]))
    last = np.append(cut[1:], len(at)) - 1
    for i, j in zip(cut.tolist(), last.tolist(), strict=True):
        if at[j] - at[i] < far - near:
            continue
        first, end = max(0, int(at[i]) - near), int(at[j]) - far + 1
        mine = at[i : j + 1][own[i : j + 1]]
        if not len(mine):
            yield first, end - 1
            continue
        start = np.arange(first, end)
        fit = np.searchsorted(mine, start + far, "right") - np.searchsorted(mine, start + near) <= OWN
        edge = np.flatnonzero(np.diff(np.concatenate([[0], fit.astype(np.int8), [0]])))
        for u, v in edge.reshape(-1, 2).tolist():
            yield first + u, first + v - 1


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node: (node, owner, xs, ys) for each chain; with a null owner, first and last starts of windows to compare."""

    def rows(run: list[np.ndarray]) -> Iterator[tuple]:
        node, at, owner, owner_at, pred, pred_at, has, has_pred = run
        by = np.lexsort((at, node))
        by = by[np.concatenate([[True], (np.diff(node[by]) != 0) | (np.diff(at[by]) != 0)])]
        cut = np.flatnonzero(np.concatenate([[True], np.diff(node[by]) != 0, [True]]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if at[by[b - 1]] - at[by[a]] >= PASSAGE - WORDS - 2 * (NEIGHBOURS - 1) and (found := list(_stretches(at[by[a:b]], ~has[by[a:b]]))):
                yield int(node[by[a]]), None, [x for x, _ in found], [x for _, x in found]
        pairs = [np.concatenate([u[has], v[has_pred]]) for u, v in ((node, node), (owner, pred), (at, at), (owner_at, pred_at))]
        by = np.lexsort(pairs[::-1])
        node, owner, x, y = (z[by] for z in pairs)
        if not len(node):
            return
        new = np.concatenate([[True], np.any([np.diff(z) != 0 for z in (node, owner, x, y)], axis=0)])
        node, owner, x, y = (z[new] for z in (node, owner, x, y))
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(node) != 0) | (np.diff(owner) != 0), [True]]))
        long = np.flatnonzero(np.diff(cut) >= LEAST_MATCHES)
        for a, b in zip(cut[long].tolist(), cut[long + 1].tolist(), strict=True):
            xs, ys = x[a:b].tolist(), y[a:b].tolist()
            for chain in chains(xs, ys):
                yield int(node[a]), int(owner[a]), [xs[k] for k in chain], [ys[k] for k in chain]

    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def out(run: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if found := list(rows(run)):
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), kinds, strict=True)], names=["node", "owner", "xs", "ys"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        run = [c.fill_null(0).to_numpy() for c in batch.columns] + [batch.column(k).is_valid().to_numpy(zero_copy_only=False) for k in (2, 4)]
        if held is not None:
            run = [np.concatenate(x) for x in zip(held, run, strict=True)]
        first = int(np.searchsorted(run[0], run[0][-1]))  # the last document may go on in the next batch
        held = [x[first:] for x in run]
        if first:
            yield from out([x[:first] for x in run])
    if held is not None:
        yield from out(held)


_SLICED = "node long, owner long, xs array<long>, ys array<long>, shift long, before boolean, behind boolean, text binary"


def _slices(margin: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (owner, salt, kind, text, node, xs, ys), sorted: a text, then requests; the words of the text round each chain.

        ``shift`` words are left out before them; ``before`` and ``behind`` say whether there are more.
        """
        words: list[bytes] = []
        for batch in batches:
            kinds, ys = batch.column(2).to_pylist(), batch.column(6)
            taken, shifts, before, behind, slices = [], [], [], [], []
            for k, kind in enumerate(kinds):
                if kind == 0:
                    words = words_of(batch.column(3)[k].as_py())
                    continue
                own = ys[k].values
                low, high = (0, len(words)) if margin is None else (max(0, own[0].as_py() - margin), own[-1].as_py() + WORDS + margin)
                taken.append(k)
                shifts.append(low)
                before.append(low > 0)
                behind.append(high < len(words))
                slices.append(b" ".join(words[low:high]))
            if taken:
                kept = batch.take(pa.array(taken))
                yield pa.RecordBatch.from_arrays([kept.column(4), kept.column(0), kept.column(5), kept.column(6), pa.array(shifts, pa.int64()), pa.array(before), pa.array(behind), pa.array(slices, pa.binary())], names=["node", "owner", "xs", "ys", "shift", "before", "behind", "text"])

    return run


#: Kinds of the rows that an alignment gives: a passage (start, end); a window (key, start); a chain for which the words weren't enough.
_PASSAGE, _WINDOW, _OPEN = 0, 1, 2
_ALIGNED = "kind long, node long, start long, end long, key long, owner long, xs array<long>, ys array<long>"


def open_windows(words: list[bytes], stretches: list[tuple[int, int]], covered: list[tuple[int, int]], known: WordHashes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, starts) of the windows of PASSAGE words that start in the stretches and lie in none of ``covered``."""
    for first, last in stretches:
        last = min(last, len(words) - PASSAGE)
        if last < first:
            continue
        free = np.ones(last - first + 1, bool)
        for a, b in covered:
            free[max(0, a - first) : max(0, b - PASSAGE + 1 - first)] = False
        at = np.flatnonzero(free)
        if len(at):
            low, high = first + int(at[0]), first + int(at[-1]) + PASSAGE
            part = words[low:high]
            keys = windows(np.fromiter(map(known.__getitem__, part), np.uint64, len(part)), PASSAGE)
            yield keys[at - at[0]], at + first


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, kind, text, owner, xs, ys, shift, before, behind), sorted: a text, its stretches, then chains with their partners' words."""
    known = WordHashes()
    spans: list[tuple[int, int, int]] = []
    opened: list[tuple[int, int, list[int], list[int]]] = []
    found: list[list[np.ndarray]] = [[], [], []]
    node, words, stretches, covered = None, [], [], []

    def finish() -> None:
        for keys, at in open_windows(words, stretches, merged(covered), known):
            for column, part in zip(found, (keys.view(np.int64), np.full(len(at), node), at), strict=True):
                column.append(part)

    def flush() -> Iterator[pa.RecordBatch]:
        nothing = lambda n: [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
        names = ["kind", "node", "start", "end", "key", "owner", "xs", "ys"]
        if spans:
            places = [pa.array(x, pa.int64()) for x in zip(*spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([_PASSAGE] * len(spans), pa.int64()), *places, *nothing(len(spans))], names=names)
        if found[0]:
            keys, nodes, at = map(np.concatenate, found)
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, _WINDOW)), pa.array(nodes), pa.array(at), pa.nulls(n, pa.int64()), pa.array(keys), *nothing(n)[1:]], names=names)
        if opened:
            n = len(opened)
            nodes, owners, xs, ys = zip(*opened, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([_OPEN] * n, pa.int64()), pa.array(nodes, pa.int64()), *nothing(n)[:2], pa.nulls(n, pa.int64()), pa.array(owners, pa.int64()), pa.array(xs, pa.list_(pa.int64())), pa.array(ys, pa.list_(pa.int64()))], names=names)
        spans.clear()
        opened.clear()
        for column in found:
            column.clear()

    for batch in batches:
        nodes, kinds, owners, xs, ys, shifts, before, behind = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6, 7, 8))
        for k, kind in enumerate(kinds):
            if nodes[k] != node:
                finish()
                node, stretches, covered = nodes[k], [], []
                words = words_of(batch.column(2)[k].as_py())
            if kind == 1:
                stretches = list(zip(xs[k], ys[k], strict=True))
            elif kind == 2:
                other, chain = words_of(batch.column(2)[k].as_py()), [(x, y - shifts[k]) for x, y in zip(xs[k], ys[k], strict=True)]
                passages_, cut = align(words, other, chain)
                if cut[0] and before[k] or cut[1] and behind[k]:
                    opened.append((node, owners[k], xs[k], ys[k]))
                else:
                    spans.extend((node, x0, x1) for x0, x1, _, _ in passages_)
                    if passages_ and stretches:
                        covered.extend(equal_runs(words, other, chain))
        yield from flush()
    finish()
    yield from flush()


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, at), sorted: (node, at) of every window but the first with its key."""
    held = None  # key, first node, its place
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node, at = (c.to_numpy() for c in batch.columns)
        new = np.concatenate([[held is None or held[0] != key[0]], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        owner, owner_at = np.where(first >= 0, node[first], held[1] if held else 0), np.where(first >= 0, at[first], held[2] if held else 0)
        held = (key[-1], owner[-1], owner_at[-1])
        later = (node != owner) | (at != owner_at)  # a repeated row has its windows at their own places
        if later.any():
            yield _ints([[node[later]], [at[later]]], ("node", "at"))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, at), sorted: (node, start, end) of the words that the windows hold."""
    for batch in batches:
        if batch.num_rows:
            node, at = (c.to_numpy() for c in batch.columns)
            cut = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (at[1:] > at[:-1] + PASSAGE)]))
            last = np.append(cut[1:], len(at)) - 1
            yield _ints([[node[cut]], [at[cut]], [at[last] + PASSAGE]], ("node", "start", "end"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text_key, text, spans in words): (doc_id, text_key, n_words, n_removed, n_passages, kept)."""
    for batch in batches:
        columns: list[list] = [[], [], [], []]
        for text, spans in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            data = text.as_py()
            found = merged([(s["start"], s["end"]) for s in spans or []])
            if found:
                starts = [m.start() for m in _WORD.finditer(data)]
                n = len(starts)
                starts.append(len(data))
                kept = remove(data, [(starts[a], starts[b]) for a, b in found])
            else:
                n, kept = len(words_of(data)), data
            for column, x in zip(columns, (n, sum(b - a for a, b in found), len(found), kept), strict=True):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True))], names=["doc_id", "text_key", "n_words", "n_removed", "n_passages", "kept"])


_CUT = "doc_id long, text_key long, n_words long, n_removed long, n_passages long, kept binary"


def _numbered(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(doc_id, text, node): node is the id; rows whose id is null, or stands for several texts, come before all others."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), data.alias("text")).withColumn("text_key", F.xxhash64("text"))
    keys = scratch.save(rows.select("doc_id", "text_key"), "keys")
    several = keys.groupBy("doc_id").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("doc_id is null or a <> b").select(F.col("doc_id").alias("_id"))
    odd = keys.join(several, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text_key").distinct()
    n = odd.count()
    if not n:
        return rows.withColumn("node", F.col("doc_id"))
    own = slots(odd, [], ["doc_id", "text_key"], n).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), (F.col("slot") - F.lit(1 << 62)).alias("_node"))
    own = scratch.save(own, "odd")
    joined = rows.join(own, rows["doc_id"].eqNullSafe(own["_id"]) & (rows["text_key"] == own["_key"]), "left")
    return joined.select("doc_id", "text", "text_key", F.coalesce("_node", "doc_id").alias("node"))


def _alignment(rows: DataFrame, asked: DataFrame, stretches: DataFrame | None, margin: int | None, scratch: Scratch, tag: str) -> DataFrame:
    """What ``_align`` gives for the chains ``asked`` and the ``stretches``; texts travel once to those who ask and once to be asked."""
    owners = scratch.save(asked.groupBy("owner").agg(F.ceil(F.count(F.lit(1)) / REQUESTS).cast("int").alias("salts")), f"owners-{tag}")
    salted = asked.join(owners, "owner").select("owner", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("text"), "node", "xs", "ys")
    held = rows.join(owners, rows["node"] == owners["owner"]).select("owner", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "text")
    held = held.select("*", *[F.lit(None).cast(salted.schema[c].dataType).alias(c) for c in ("node", "xs", "ys")])
    sliced = held.union(salted).repartition("owner", "salt").sortWithinPartitions("owner", "salt", "kind").mapInArrow(_slices(margin), _SLICED)
    order = ["node", "kind", "text", "owner", "xs", "ys", "shift", "before", "behind"]
    sliced = sliced.withColumn("kind", F.lit(2)).select(order)
    empty = lambda df, kind: df.select(*[df[c] if c in df.columns else F.lit(kind).alias(c) if c == "kind" else F.lit(None).cast(sliced.schema[c].dataType).alias(c) for c in order])
    wanted = asked.select("node") if stretches is None else asked.select("node").union(stretches.select("node"))
    own = rows.select("node", "text").join(wanted.distinct(), "node", "left_semi")
    parts = empty(own, 0).union(sliced) if stretches is None else empty(own, 0).union(empty(stretches, 1)).union(sliced)
    return scratch.save(parts.repartition("node").sortWithinPartitions("node", "kind").mapInArrow(_align, _ALIGNED), f"aligned-{tag}", LONG_ROWS)


def passages(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, start, end), in words, over rows (node, text)."""
    found = rows.select("node", "text").mapInArrow(_seeds, _SEEDS)
    place = F.when(F.col("kind") == _OTHER, F.xxhash64("seed", "node")).otherwise(F.col("seed"))
    linked = scratch.save(found.repartition(place).sortWithinPartitions("seed", "node", "at").mapInArrow(_linked, _LINKED), "linked")
    matches = linked.where(F.col("kind") == _ROW).select("node", "at", "owner", "owner_at", "pred", "pred_at")
    first = linked.where(F.col("kind") == _LEAD).groupBy("seed").agg(F.min(F.struct("node", "at")).alias("first"))
    others = linked.where(F.col("kind") == _OTHER).join(first, "seed").select("node", "at", F.col("first.node").alias("owner"), F.col("first.at").alias("owner_at"), "pred", "pred_at")
    chained = scratch.save(matches.union(others).repartition("node").sortWithinPartitions("node").mapInArrow(_chains, _CHAINS), "chains")
    scratch.drop("linked")
    asked, stretches = chained.where("owner is not null"), chained.where("owner is null").drop("owner")
    aligned = _alignment(rows, asked, stretches, MARGIN, scratch, "first")
    opened = aligned.where(F.col("kind") == _OPEN).select("node", "owner", "xs", "ys")
    spans = aligned.where(F.col("kind") == _PASSAGE).select("node", "start", "end")
    if opened.limit(1).count():
        more = _alignment(rows, opened, None, None, scratch, "whole")
        spans = spans.union(more.where(F.col("kind") == _PASSAGE).select("node", "start", "end"))
    compared = aligned.where(F.col("kind") == _WINDOW).select("key", "node", F.col("start").alias("at"))
    again = compared.repartition("key").sortWithinPartitions("key", "node", "at").mapInArrow(_again, "node long, at long")
    return spans.union(again.repartition("node").sortWithinPartitions("node", "at").mapInArrow(_spans, "node long, start long, end long"))


def passage_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, n_passages, kept_text, kept_sha256.

    Removed are the words of passages that an earlier document (smaller id), or an earlier place of
    the same one, has too, with the blanks behind them. Null counts as empty. A null id, and an id
    that stands for several texts, comes before all others, such rows among themselves in the order
    of a hash; a repeated row gets the same result as the first. An empty table gives an empty
    result; other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    rows = _numbered(docs, id_col, text_col, scratch)
    found = scratch.save(passages(rows, scratch), "passages")
    scratch.drop("chains", "aligned-first", "aligned-whole", "owners-first", "owners-whole")
    spans = found.groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # a text's own passages
    ready = rows.join(spans, "node", "left").select("doc_id", "text_key", "text", "spans")
    cut = ready.mapInArrow(_cut, _CUT)
    return cut.select("doc_id", "n_words", "n_removed", "n_passages", F.col("kept").cast("string").alias("kept_text"), F.sha2("kept", 256).alias("kept_sha256"))


def cut_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated passages cut out of the texts; all columns, no row less.

    A text without repeated passages stays as it is, null included. ``n_chars`` follows the text
    where the table has it.
    """
    scratch = Scratch(docs.sparkSession, "cut")
    rows = _numbered(docs, id_col, text_col, scratch)
    found = scratch.save(passages(rows, scratch), "passages")
    scratch.drop("chains", "aligned-first", "aligned-whole", "owners-first", "owners-whole")
    spans = found.groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    ready = rows.join(spans, "node").select("doc_id", "text_key", "text", "spans").dropDuplicates(["doc_id", "text_key"])
    kept = ready.mapInArrow(_cut, _CUT).select(F.col("doc_id").alias("_cut_id"), F.col("text_key").alias("_cut_key"), F.col("kept").cast("string").alias("_cut_text"))
    key = F.xxhash64(F.coalesce(docs[text_col], F.lit("")).cast("binary"))
    joined = docs.join(kept, docs[id_col].eqNullSafe(kept["_cut_id"]) & (key == kept["_cut_key"]), "left")
    text = F.coalesce(F.col("_cut_text"), docs[text_col])
    follow = {text_col: text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return joined.select(*[follow[c].alias(c) if c in follow else docs[c] for c in docs.columns])

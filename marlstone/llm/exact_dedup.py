"""Exact dedup: partitions by length and content hash insert whole byte strings into radix tries.

Equality is decided in the tries, on every byte. The SHA-256 only deals texts out to their
owners and carries an owner's decision back to the rows.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Scratch, keep_rows, text_key

#: Bytes of distinct text that a map task's trie holds before it hands its strings on.
MAP_BYTES = 48 << 20
#: Bytes of distinct text that an owner's trie holds before it spills its largest subtree.
OWNER_BYTES = 96 << 20
#: Bytes of text in one batch that a task hands back.
BATCH_BYTES = 8 << 20

_STRINGS = "n_bytes long, digest binary, data binary, low long, high long, n long"
_GROUPS = "n_bytes long, digest binary, low long, high long, n long"


def _merge(a: list | tuple, b: list | tuple) -> list:
    """Two (smallest id, largest id, rows) records in one; a null id never wins over an id."""
    low = b[0] if a[0] is None else a[0] if b[0] is None else min(a[0], b[0])
    high = b[1] if a[1] is None else a[1] if b[1] is None else max(a[1], b[1])
    return [low, high, a[2] + b[2]]


class _Node:
    __slots__ = ("kids", "label", "record")

    def __init__(self, label: bytes, record: list | None):
        self.label, self.record, self.kids = label, record, {}


def _common(label: bytes, data: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``data[at:]``, by halving."""
    low, high = 0, min(len(label), len(data) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == data[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _pickled(file) -> Iterator[tuple[bytes, list]]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


class RadixTrie:
    """Compressed trie over byte strings; terminal nodes store (smallest id, largest id, rows).

    With ``limit``, subtrees below the root go to files of ``folder`` once the labels take more
    bytes than that, the largest with several strings first. Later strings of a spilled subtree
    are appended to its file. ``records`` reads each file back into a trie that starts where its
    strings part, which may spill again; a string by itself is never spilled, so it ends.
    """

    def __init__(self, limit: int | None = None, folder: str | None = None, depth: int = 0):
        self.limit, self.folder, self.depth = limit, folder, depth
        self.root, self.size = _Node(b"", None), 0
        self.sizes: dict[int, int] = {}
        self.strings: dict[int, int] = {}
        self.files: dict[int, object] = {}

    def insert(self, data: bytes, record: list) -> None:
        node, at, end = self.root, self.depth, len(data)
        branch = data[at] if at < end else -1
        if (file := self.files.get(branch)) is not None:
            pickle.dump((data, record), file, -1)
            return
        self._place(node, at, data, record, branch)
        if self.limit is not None and self.size > self.limit and (several := [b for b, n in self.strings.items() if n > 1]):
            self._spill(max(several, key=self.sizes.get))

    def _place(self, node: _Node, at: int, data: bytes, record: list, branch: int) -> None:
        end = len(data)
        while at < end:
            kid = node.kids.get(data[at])
            if kid is None:
                node.kids[data[at]] = _Node(data[at:], record)
                self._grow(branch, end - at)
                self.strings[branch] = self.strings.get(branch, 0) + 1
                return
            label = kid.label
            if not data.startswith(label, at):
                same = _common(label, data, at)
                fork = _Node(label[:same], None)
                kid.label = label[same:]
                fork.kids[kid.label[0]] = kid
                node.kids[data[at]] = fork
                self._grow(branch, 0)
                kid = fork
                label = fork.label
            node, at = kid, at + len(label)
        if node.record is None:
            node.record = record
            self.strings[branch] = self.strings.get(branch, 0) + (branch >= 0)
        else:
            node.record = _merge(node.record, record)

    def _grow(self, branch: int, n: int) -> None:
        n += 200  # a node's own memory
        self.size += n
        self.sizes[branch] = self.sizes.get(branch, 0) + n

    def _spill(self, branch: int) -> None:
        self.files[branch] = file = tempfile.TemporaryFile(dir=self.folder)
        node = self.root.kids.pop(branch)
        for data, record in self._walk(node, b""):
            # the path above this trie's depth is not kept; it is written as it will be read
            pickle.dump((b"\0" * self.depth + data, record), file, -1)
        self.size -= self.sizes.pop(branch)
        del self.strings[branch]

    @staticmethod
    def _walk(top: _Node, prefix: bytes) -> Iterator[tuple[bytes, list]]:
        stack = [(top, prefix)]
        while stack:
            node, path = stack.pop()
            path += node.label
            if node.record is not None:
                yield path, node.record
            stack.extend((kid, path) for kid in node.kids.values())

    def records(self, prefix: bytes = b"") -> Iterator[tuple[bytes, list]]:
        """Each distinct string with its record; ``prefix``: what all strings begin with, above depth."""
        yield from self._walk(self.root, prefix)
        self.root, self.size = _Node(b"", None), 0
        for branch in list(self.files):
            with self.files.pop(branch) as file:
                depth = None
                for data, _ in _pickled(file):
                    if depth is None:
                        one, depth = data, len(data)
                    depth = self.depth + 1 + _common(one[self.depth + 1 : depth], data, self.depth + 1)
                deeper = RadixTrie(self.limit, self.folder, depth)
                for data, record in _pickled(file):
                    deeper.insert(data, record)
            yield from deeper.records(prefix + one[self.depth : depth])


def _map_tries(limit: int) -> Callable:
    """Each task's rows in tries of at most ``limit`` bytes: copies shrink before anything is shuffled."""

    def out(trie: RadixTrie) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for data, (low, high, n) in trie.records():
            rows.append((len(data), hashlib.sha256(data).digest(), data, low, high, n))
            if (size := size + len(data)) > BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie()
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                trie.insert(data.as_py(), [key, key, 1])
                if trie.size > limit:
                    yield from out(trie)
                    trie = RadixTrie()
        yield from out(trie)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("n_bytes", pa.int64()), ("digest", pa.binary()), ("data", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("n", pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])


def _owner_tries(limit: int) -> Callable:
    """Each owner's strings in one trie, with spill by subtree; one row for each distinct string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(dir=os.environ.get("TMPDIR")) as folder:
            trie = RadixTrie(limit, folder)
            for batch in batches:
                low, high, n = (batch.column(k).to_pylist() for k in (3, 4, 5))
                for k, data in enumerate(batch.column(2)):
                    trie.insert(data.as_py(), [low[k], high[k], n[k]])
            rows: list[tuple] = []
            for data, record in trie.records():
                rows.append((len(data), hashlib.sha256(data).digest(), *record))
                if len(rows) == 10_000:
                    yield _groups_batch(rows)
                    rows = []
            if rows:
                yield _groups_batch(rows)

    return run


def _groups_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("n_bytes", pa.int64()), ("digest", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("n", pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", map_bytes: int = MAP_BYTES, owner_bytes: int = OWNER_BYTES) -> DataFrame:
    """(n_bytes, digest, low, high, n) for each distinct text: smallest and largest id, and rows."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    strings = texts.mapInArrow(_map_tries(map_bytes), _STRINGS)
    return strings.repartition(F.col("n_bytes"), F.col("digest")).mapInArrow(_owner_tries(owner_bytes), _GROUPS)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", **limits: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (no change is made to them; null counts as empty) the row with the largest
    id stays, or the smallest with ``keep="min"``. A null id never stays beside an id; in a group
    of null ids keep_id is null and the rows stay. A repeated row counts as one more copy and,
    having the id that stays, is kept with it. An empty table gives an empty result. Other columns
    are not read, so their names cannot clash.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    groups = exact_groups(docs, id_col, text_col, **limits).select("digest", F.col("high" if keep == "max" else "low").alias("keep_id"), F.col("n").alias("group_size"))
    return _decided(docs, groups, id_col, text_col).drop("text_key")


def _decided(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``exact_dedup``'s rows with the hash that names a text beside its id."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    rows = docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest"), text_key(text_col).alias("text_key"))
    # a group is one row, so a large group only makes a large left side, which AQE splits
    return rows.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "text_key")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns, and one row for each text.

    Of rows that repeat an id with its text one stays, whichever. Where only null ids have a text
    one of their rows stays. An empty table gives an empty one.
    """
    groups = exact_groups(docs, id_col, text_col).select("digest", F.col("high" if keep == "max" else "low").alias("keep_id"), F.col("n").alias("group_size"))
    kept = _decided(docs, groups, id_col, text_col).where("kept").select("doc_id", "text_key")
    return keep_rows(docs, kept, Scratch(docs.sparkSession, "exact"), id_col, text_col)


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

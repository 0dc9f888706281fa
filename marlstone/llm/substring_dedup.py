"""Suffix-array dedup: bytes covered by a string of 100 bytes that also starts earlier are removed.

Every 100-byte window chooses one of its grams, by the window's bytes alone, so equal windows
choose equal grams. Runs of windows whose gram occurs once in the corpus have no equal and are
left out. The others' text goes to the shard of its gram, and there all equal windows meet; the
windows of a very frequent gram are parted by their second gram first. Runs
with the same text shrink to the earliest one, those of a very frequent gram in the map tasks first; the shard's texts are then sorted by external
induced sorting (``suffix_order``), and where neighbours share 100 bytes, all but the earliest
window are marked.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Scratch
from marlstone.llm.minimizers import GRAM, _sliding_min, gram_hashes, minimizers
from marlstone.llm.near_dedup import mix
from marlstone.llm.suffix_order import suffix_array

#: Bytes of a repeated string.
LENGTH = 100
#: Bytes of text that are sorted together where the grams allow it; one gram's texts are never parted.
SORTED_BYTES = 2 << 20

#: Runs that are looked through at once for grams that occur often, and how often that is.
BATCH, OFTEN = 400_000, 8
#: Rows of a gram, among those flagged as frequent, beyond which its windows are parted by a second gram.
SPLIT = 20_000

#: Flag of a packed place whose gram is frequent in its batch, and the mark that such a gram sends to its task.
_APART, _MARK = 1 << 62, -1
#: Bits of a packed place that hold the number of windows after the first; a gram is chosen by fewer than that.
_WIDTH = 20


def _chosen(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc, key, text): (gram, key, doc, at) for each run of windows; ``at`` packs its first and its length."""
        out: list[list[np.ndarray]] = [[], [], [], []]
        size = 0
        for batch in batches:
            docs, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, text in enumerate(batch.column(2)):
                h, first, last = minimizers(text.as_py(), length)
                for column, x in zip(out, (h.view(np.int64), np.full(len(h), keys[k]), np.full(len(h), docs[k]), (first << _WIDTH) | (last - first)), strict=True):
                    column.append(x)
                size += len(h)
                if size > BATCH:
                    yield _spread(*map(np.concatenate, out))
                    out, size = [[], [], [], []], 0
        if size:
            yield _spread(*map(np.concatenate, out))

    return run


def _spread(gram: np.ndarray, key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """The rows of a batch: those of a frequent gram flagged, and one mark for it."""
    by = np.argsort(gram, kind="stable")
    new = np.concatenate([[True], gram[by][1:] != gram[by][:-1]])
    cut = np.flatnonzero(new)
    often = np.diff(np.append(cut, len(by))) >= OFTEN
    flag = np.zeros(len(by), np.int64)
    flag[by] = np.where(often[np.cumsum(new) - 1], _APART, 0)
    marks = gram[by][cut[often]]
    none = np.zeros(len(marks), np.int64)
    return _ints([[gram, marks], [key, none], [doc, none], [at | flag, none + _MARK]], ("gram", "key", "doc", "at"))


def _ints(columns: list[list[np.ndarray]], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in columns], names=list(names))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (gram, key, at, doc): of equal places in equal texts the first, if the gram has another place.

    A flagged row has one for certain; a mark stands for places elsewhere and doesn't come out.
    """
    names = ("gram", "key", "doc", "at")
    last = None  # the row before
    held = None  # the last place without a flag, which may be its gram's only one so far
    told = False
    for batch in batches:
        if not batch.num_rows:
            continue
        gram, key, doc, at = (c.to_numpy() for c in batch.columns)
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (key[1:] != key[:-1]) | (at[1:] != at[:-1])
        new[0] = last != (gram[0], key[0], at[0]) or at[0] == _MARK
        last = (gram[-1], key[-1], at[-1])
        apart = new & (at >= _APART)
        if apart.any():
            yield _ints([[x[apart]] for x in (gram, key, doc, at)], names)
        plain = new & (at < _APART)
        gram, key, doc, at = (x[plain] for x in (gram, key, doc, at))
        if not len(gram):
            continue
        same = np.zeros(len(gram), bool)
        same[1:] = gram[1:] == gram[:-1]
        keep = same.copy()
        keep[:-1] |= same[1:]
        if held is not None and held[0] == gram[0]:
            keep[0] = True
            if not told and held[3] != _MARK:
                yield _ints([[np.array([x])] for x in held], names)
        told = bool(keep[-1])
        held = (gram[-1], key[-1], doc[-1], at[-1])
        keep &= at != _MARK
        if keep.any():
            yield _ints([[x[keep]] for x in (gram, key, doc, at)], names)


def second_runs(text: bytes, gram: int, length: int) -> list[tuple[int, int, int]]:
    """(gram, first, last) for each run of windows of ``text`` that choose the same second gram.

    All windows hold ``gram``; the second is the smallest of their others, by the window's bytes alone,
    and the new gram stands for both. Windows without another keep theirs.
    """
    h = gram_hashes(np.frombuffer(text, np.uint8), GRAM)
    own = h == np.uint64(gram & 0xFFFFFFFFFFFFFFFF)
    place = np.arange(len(h), dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)
    ranked = np.where(own, ~np.uint64(0), (h & ~low) | place)
    out = []
    best = _sliding_min(ranked, length - GRAM + 1)
    chosen = np.where(best == ~np.uint64(0), -1, (best & low).astype(np.int64))
    cut = np.flatnonzero(np.diff(chosen, prepend=-2))
    last = np.append(cut[1:], len(chosen)) - 1
    with np.errstate(over="ignore"):
        both = mix(h[np.maximum(chosen[cut], 0)] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(gram & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
    for k in range(len(cut)):
        out.append((int(both[k]) if chosen[cut[k]] >= 0 else gram, int(cut[k]), int(last[k])))
    return out


def _texts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc, key, text, runs): (gram, run, doc, key, first), with each run's text.

        Of equal runs of a very frequent gram the batch's earliest goes on; the others, which go for
        certain, have a null run and their end in the gram's place.
        """
        for batch in batches:
            docs, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lists = batch.column(3)
            cuts = lists.offsets.to_numpy()
            fields = [lists.values.field(name).to_numpy() for name in ("gram", "at")]
            rows: list[tuple] = []
            hot: list[tuple] = []
            size = 0
            for k in range(len(docs)):
                text = batch.column(2)[k].as_py()
                for gram, at in zip(*(x[cuts[k] : cuts[k + 1]].tolist() for x in fields), strict=True):
                    first, more = (at & ~_APART) >> _WIDTH, at & ((1 << _WIDTH) - 1)
                    (hot if at & _APART else rows).append((gram, text[first : first + more + length], docs[k], keys[k], first))
                    size += more + length
                    if size > 8 << 20:
                        yield _text_batch(rows + _parted(hot, length))
                        rows, hot, size = [], [], 0
            if rows or hot:
                yield _text_batch(rows + _parted(hot, length))

    return run


def _parted(rows: list[tuple], length: int) -> list[tuple]:
    """Rows of very frequent grams, the earliest of equal runs parted by second grams; the others have a null run and their end in the gram's place."""
    first: dict[tuple, tuple] = {}
    out: list[tuple] = []
    for gram, run, *place in rows:
        best = first.setdefault((gram, run), place)
        if best is not place:
            if place < best:
                first[gram, run], place = place, best
            out.append((place[2] + len(run), None, *place))
    for (gram, run), (doc, key, at) in first.items():
        out.extend((own, run[a : b + length], doc, key, at + a) for own, a, b in second_runs(run, gram, length))
    return out


def _text_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("gram", pa.int64()), ("run", pa.binary()), ("doc", pa.int64()), ("key", pa.int64()), ("first", pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])


def marked_windows(runs: list[tuple[bytes, int, int, int]], length: int, folder: str | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(doc, key, start, end) of the bytes of windows that also start earlier in one of ``runs``.

    ``runs``: (text, doc, key, first). Bytes are raised by one for the sort, so that 0 ends a run;
    UTF-8 has no byte 255.
    """
    raw = b"".join((np.frombuffer(text, np.uint8) + np.uint8(1)).tobytes() + b"\0" for text, _, _, _ in runs)
    order, shared = suffix_array(raw, length, folder=folder)
    starts = np.cumsum([0, *(len(text) + 1 for text, _, _, _ in runs)])
    run = np.searchsorted(starts, order, side="right") - 1
    offset = order - starts[run]
    sizes = np.array([len(text) for text, _, _, _ in runs])
    whole = np.flatnonzero(offset + length <= sizes[run])
    if not len(whole):
        return
    # between two windows that follow each other lie shorter suffixes: they share the least of all between
    least = np.minimum.reduceat(shared, np.append(0, whole[:-1] + 1))
    group = np.cumsum(least < length)
    run, offset = run[whole], offset[whole]
    several = np.bincount(group)[group] > 1
    run, offset, group = run[several], offset[several], group[several]
    doc, key, first = (np.array([r[k] for r in runs], np.int64) for k in (1, 2, 3))
    at = first[run] + offset
    by = np.lexsort((at, key[run], doc[run], group))
    earlier = np.zeros(len(by), bool)
    earlier[1:] = group[by][1:] == group[by][:-1]
    d, k, a = doc[run][by][earlier], key[run][by][earlier], at[by][earlier]
    by = np.lexsort((a, k, d))
    d, k, a = d[by], k[by], a[by]
    if len(a):
        new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (a[1:] > a[:-1] + 1)]))
        last = np.append(new[1:], len(a)) - 1
        yield from zip(d[new].tolist(), k[new].tolist(), a[new].tolist(), (a[last] + length).tolist(), strict=True)


def _spans(length: int, sorted_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (gram, run, doc, key, first): (doc, key, start, end) to remove."""
        with tempfile.TemporaryDirectory(dir=os.environ.get("TMPDIR")) as folder:
            out: list[tuple] = []
            some: list[tuple] = []  # the first of each distinct run, of whole grams
            size = begun = 0
            gram = text = None
            for batch in batches:
                for g, t, doc, key, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if t is None:
                        out.append((doc, key, first, g))
                        continue
                    if g == gram and t == text:
                        out.append((doc, key, first, first + len(t)))
                        continue
                    if g != gram:
                        if len(some) - begun == 1:  # one distinct run: nothing to compare it with
                            size -= len(some.pop()[0])
                        if size > sorted_bytes:
                            out.extend(marked_windows(some, length, folder))
                            some, size = [], 0
                        begun = len(some)
                    gram, text = g, t
                    some.append((t, doc, key, first))
                    size += len(t)
                if len(out) > 50_000:
                    yield _span_batch(out)
                    out = []
            if len(some) - begun == 1:
                some.pop()
            if some:
                out.extend(marked_windows(some, length, folder))
            if out:
                yield _span_batch(out)

    return run


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc", "key", "start", "end"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes in ``spans``."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[], [], [], []]
        for data, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = data.as_py()
            found = merged([(s["start"], s["end"]) for s in spans or []])
            for column, x in zip(columns, (len(data), sum(b - a for a, b in found), len(found), hashlib.sha256(remove(data, found)).hexdigest()), strict=True):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.unhex(F.sha2(data, 256)).alias("digest"), data.alias("text"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", sorted_bytes: int = SORTED_BYTES, split: int = SPLIT, scratch: Scratch | None = None) -> DataFrame:
    """(doc, key, spans): what to remove of each distinct text's first row; ``spans`` are (start, end), not yet merged.

    ``doc`` is that row's id (the smallest long for a null id) and ``key`` the first eight bytes of
    the text's SHA-256.
    """
    scratch = scratch or Scratch(docs.sparkSession, "substring")
    rows = _rows(docs, id_col, text_col)
    key = F.conv(F.substring(F.hex("digest"), 1, 16), 16, -10).cast("long")
    texts = rows.where(F.octet_length("text") >= length).select("doc", key.alias("key"), "text")
    chosen = texts.mapInArrow(_chosen(length), "gram long, key long, doc long, at long")
    place = F.when(F.col("at") >= _APART, F.xxhash64("gram", "key", "at")).otherwise(F.col("gram"))
    twice = scratch.save(chosen.repartition(place).sortWithinPartitions("gram", "key", "at", "doc").mapInArrow(lambda it: _repeated(it), "gram long, key long, doc long, at long"), "repeated")
    large = scratch.save(twice.where(F.col("at") >= _APART).groupBy("gram").count().where(F.col("count") > split).select("gram", F.lit(_APART).alias("split")), "large")
    place = F.col("at").bitwiseAND(F.lit(~_APART)).bitwiseOR(F.coalesce("split", F.lit(0)))
    wanted = twice.join(large, "gram", "left").groupBy("doc", "key").agg(F.collect_list(F.struct("gram", place.alias("at"))).alias("runs"))  # a text's own runs
    held = texts.join(wanted, ["doc", "key"]).dropDuplicates(["doc", "key"]).select("doc", "key", "text", "runs")
    runs = held.mapInArrow(_texts(length), "gram long, run binary, doc long, key long, first long")
    sorted_runs = runs.repartition("gram").sortWithinPartitions("gram", "run", "doc", "key", "first")
    spans = scratch.save(sorted_runs.mapInArrow(_spans(length, sorted_bytes), "doc long, key long, start long, end long"), "spans")
    scratch.drop("repeated")
    return spans.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def substring_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", sorted_bytes: int = SORTED_BYTES, split: int = SPLIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed are the bytes of every string of ``length`` bytes that also starts earlier: in a document
    with a smaller id, or further left in the same one. Null counts as empty. A null id comes before
    all ids; rows with the same id are ordered by their texts' hashes, and repeated rows get the
    same result. An empty table gives an empty result; other columns aren't read.
    """
    spans = repeated_spans(docs, length, id_col, text_col, sorted_bytes, split)
    rows = _rows(docs, id_col, text_col)
    first = rows.groupBy("digest").agg(F.min("doc").alias("doc"))
    key = F.conv(F.substring(F.hex("digest"), 1, 16), 16, -10).cast("long")
    found = first.withColumn("key", key).join(spans, ["doc", "key"], "left").select("digest", F.col("doc").alias("first_doc"), "spans")
    # a later copy has all its bytes in an earlier text, if it is long enough
    n = F.octet_length("text").cast("long")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("end")))
    spans = F.when(F.col("doc") == F.col("first_doc"), F.col("spans")).when(n >= length, all_of_it)
    return rows.join(found, "digest").select("doc_id", "text", spans.alias("spans")).mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

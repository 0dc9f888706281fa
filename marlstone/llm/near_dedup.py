"""MinHash near-dedup with HyperMinHash registers.

One hash of each shingle picks a register and gives its value; a register keeps the smallest
value of its shingles as the number of leading zeros and ten bits of mantissa. Bands of registers
find candidates, a Jaccard estimate corrected for chance collisions thins them, and full shingle
sets confirm them.

Rows with the same shingle set are one node from the start. Within a bucket of a band only the
pairs with the bucket's first and last node are candidates, so a bucket of n nodes gives 2n pairs.
Pairs that this leaves out matter only where they would join two components; a second round
compares, block by block, all nodes that share a bucket but not a component. Blocks of a bucket's
largest component meet only blocks of the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Scratch, components, keep_rows, slots

WORDS = 5
#: Of 100; a link needs 100 * intersection >= SIMILAR * union.
SIMILAR = 75
#: Registers, a power of two, and registers in a band. At a similarity of 0.75 a pair shares none
#: of the 32 bands with a probability of 5e-6.
REGISTERS, IN_BAND = 128, 4
MANTISSA = 10
#: An estimate this far below the threshold rules a pair out: over six standard deviations.
MARGIN = 0.25
#: Sets smaller than this share registers, so that their estimates vary more; they're always verified.
SMALL = 512
#: Nodes of a bucket that are compared at once in the second round.
BLOCK = 512

_REMEMBERED = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(data: bytes | None) -> list[bytes]:
    """Runs of bytes other than space and tab to carriage return, with A-Z lowered."""
    return (data or b"").lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n words; of all words where there are fewer."""
    if not len(words):
        return words
    n = min(n, len(words))
    last = len(words) - n + 1
    out = words[:last] + np.uint64(n)
    for k in range(1, n):
        out = out * _ODD + words[k : k + last]
    return mix(out)


def shingle_set(data: bytes | None, known: WordHashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = words_of(data)
    return np.unique(windows(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), n))


def _donors(attempts: int = 512) -> np.ndarray:
    """For each register, the registers that it borrows from, in order, while it has no value of its own."""
    seed = np.arange(REGISTERS * attempts, dtype=np.uint64).reshape(REGISTERS, attempts) + np.uint64(12345)
    return (mix(seed * _ODD) >> np.uint64(64 - REGISTERS.bit_length() + 1)).astype(np.int64)


_DONORS = _donors()


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set of sorted hashes, 16 bits a register: leading zeros, then mantissa."""
    bits = REGISTERS.bit_length() - 1
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    part, exponent = np.frexp((hashes[first] << np.uint64(bits)).astype(np.float64) + 1.0)
    zeros = np.clip(64 - exponent, 0, 62).astype(np.uint16)
    mantissa = np.minimum((part * 2 - 1) * (1 << MANTISSA), (1 << MANTISSA) - 1).astype(np.uint16)
    out = np.zeros(REGISTERS, np.uint16)
    out[bucket[first]] = (zeros << np.uint16(MANTISSA)) | mantissa
    if len(first) < REGISTERS:
        full = np.zeros(REGISTERS, bool)
        full[bucket[first]] = True
        empty = np.flatnonzero(~full)
        there = full[_DONORS[empty]]
        tries = there.argmax(axis=1)
        donor = _DONORS[empty, tries]
        none = ~there[np.arange(len(empty)), tries]
        if none.any():  # the next register with a value, round the end
            own = bucket[first]
            donor[none] = own[np.searchsorted(own, empty[none]) % len(own)]
        out[empty] = out[donor]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; a key names its band too."""
    keys = np.ascontiguousarray(sketch).view(np.uint64)  # four registers of 16 bits
    return mix(keys ^ (np.arange(1, len(keys) + 1, dtype=np.uint64) * _ODD)).view(np.int64)


def estimate(same: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard from numbers of equal registers and set sizes, less the collisions that chance gives."""
    level = 2.0 ** -np.arange(0, 41)
    below = lambda n: 1 - (1 - level[None, :]) ** np.maximum(n[:, None] / REGISTERS, 1.0)  # noqa: E731  P(at least k leading zeros)
    pa_, pb = -np.diff(below(a.astype(float)), axis=1), -np.diff(below(b.astype(float)), axis=1)
    chance = (pa_ * pb).sum(axis=1) / (1 << MANTISSA)
    share = same / REGISTERS
    return np.clip((share - chance) / (1 - chance), 0, 1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        n, digest, sketch = [], [], []
        for text in batch.column(2):
            hashes = shingle_set(text.as_py(), known)
            n.append(len(hashes))
            digest.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
            sketch.append(registers(hashes).tobytes() if len(hashes) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())], names=["doc_id", "text_key", "n", "digest", "sketch"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketches = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
        each = REGISTERS // IN_BAND
        for k in range(0, len(sketches), 4096):
            some = sketches[k : k + 4096]
            keys = np.concatenate([band_keys(x) for x in some])
            nodes = np.repeat(batch.column(0).to_numpy()[k : k + 4096], each)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes)], names=["key", "node"])


def _plausible(same: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    fit = 100 * np.minimum(na, nb) >= SIMILAR * np.maximum(na, nb)
    return fit & ((np.minimum(na, nb) < SMALL) & (same > 0) | (estimate(same, na, nb) >= SIMILAR / 100 - MARGIN))


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, na, nb, sa, sb) whose estimate does not rule them out, as (a, b)."""
    for batch in batches:
        na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        sa, sb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (4, 5))
        keep = pa.array(_plausible((sa == sb).sum(axis=1), na, nb))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, digest, text): (node, hashes) where the text has that set."""
    known = WordHashes()
    for batch in batches:
        nodes, hashes = [], []
        digests = batch.column(1).to_pylist()
        for k, text in enumerate(batch.column(2)):
            found = shingle_set(text.as_py(), known).tobytes()
            if hashlib.blake2b(found, digest_size=16).digest() == digests[k]:
                nodes.append(batch.column(0)[k].as_py())
                hashes.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(hashes, pa.binary())], names=["node", "hashes"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, ha, hb) whose full sets are similar enough, as (a, b)."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, lo, hi, own, node, part, sketch, hashes), sorted by (key, lo, hi): links (a, b) between parts.

    A run holds one block of a bucket (lo = hi), whose nodes are compared among each other, or
    two, which are compared with each other. A pair is looked at in the first band that it shares;
    its estimate rules it out or its full sets decide. What a link joins is not compared any more,
    so a run gives fewer links than it has nodes.
    """

    def links(run: list[tuple]) -> Iterator[pa.RecordBatch]:
        side = np.array([r[3] == r[1] for r in run])
        node, part = (np.array([r[k] for r in run], np.int64) for k in (4, 5))
        sketch = np.frombuffer(b"".join(r[6] for r in run), np.uint16).reshape(-1, REGISTERS)
        bands = sketch.view(np.uint64)
        band = int(np.flatnonzero(band_keys(sketch[0]) == run[0][0])[0])
        n = np.array([len(r[7]) // 8 for r in run])
        within = run[0][1] == run[0][2]
        marks = None
        out: list[tuple[int, int]] = []
        for i in range(len(run)):
            open_ = part != part[i]
            open_ &= np.arange(len(run)) > i if within else side != side[i]
            others = np.flatnonzero(open_) if within or side[i] else np.zeros(0, np.int64)
            others = others[100 * np.minimum(n[others], n[i]) >= SIMILAR * np.maximum(n[others], n[i])]
            others = others[~(bands[others, :band] == bands[i, :band]).any(axis=1)]
            if not len(others):
                continue
            same = (sketch[others] == sketch[i]).sum(axis=1)
            fit = _plausible(same, np.full(len(others), n[i]), n[others])
            others = others[fit][np.argsort(-same[fit], kind="stable")]
            if not len(others):
                continue
            if marks is None:
                every, places = np.unique(np.frombuffer(b"".join(r[7] for r in run), np.uint64), return_inverse=True)
                cuts = np.concatenate([[0], np.cumsum(n)])
                marks = np.zeros(len(every), bool)
            mine = places[cuts[i] : cuts[i + 1]]
            marks[mine] = True
            for j in others:
                if part[j] != part[i]:
                    both = int(marks[places[cuts[j] : cuts[j + 1]]].sum())
                    if 100 * both >= SIMILAR * (n[i] + n[j] - both):
                        out.append((node[i], node[j]))
                        part[part == part[j]] = part[i]
            marks[mine] = False
        if out:
            a, b = np.array(out).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    run: list[tuple] = []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if run and run[0][:3] != row[:3]:
                yield from links(run)
                run = []
            run.append(row)
    if run:
        yield from links(run)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    component_id is the smallest id reachable over links. Null and empty texts, and texts without
    words, have no shingles and are linked with nothing. Repeated rows are one node; a null id takes
    its set's component and, where no id reaches it, has a null component and is kept. An empty table
    gives an empty result; other columns aren't read.
    """
    return _grouped(docs, Scratch(docs.sparkSession, "near"), id_col, text_col).drop("text_key")


def _grouped(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """``near_groups``' rows with the hash that names a text beside its id."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(data).alias("text_key"), data.alias("text"))
    rows = scratch.save(texts.mapInArrow(_sketch, "doc_id long, text_key long, n long, digest binary, sketch binary"), "rows")
    sets = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "text_key")).alias("source"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    total = rows.count()
    nodes = scratch.save(slots(sets, [], ["digest"], total).withColumnRenamed("slot", "node"), "nodes")
    bands = scratch.save(nodes.select("node", "sketch").mapInArrow(lambda it: _bands(it), "key long, node long"), "bands")
    shared = bands.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = scratch.save(shared, "shared")
    ends = bands.join(shared, "key")
    pairs = ends.select(F.col("low").alias("a"), F.col("node").alias("b")).union(ends.select(F.col("node").alias("a"), F.col("high").alias("b"))).where("a < b").distinct()
    links = scratch.save(_verified(pairs, nodes, docs, id_col, text_col, scratch), "links-first")
    parts = components(links, scratch, "parts-first")

    member = bands.join(shared.select("key", "members"), "key").join(parts.withColumnRenamed("id", "node"), "node", "left").select("key", "members", "node", F.coalesce("component", "node").alias("part"))
    member = scratch.save(member, "member")
    open_keys = member.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("key")
    # nodes of a bucket's largest part needn't meet among each other: they have blocks of their own
    held = member.join(open_keys, "key").drop("members")
    parts_of = held.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    largest = parts_of.groupBy("key").agg(F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("all"))
    main, rest = F.ceil(F.col("main.n") / BLOCK).cast("int"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).cast("int")
    held = held.join(largest.select("key", F.col("main.part").alias("main"), main.alias("mains"), rest.alias("rests")), "key")
    inside, turn, last = F.col("part") == F.col("main"), F.xxhash64("node"), F.col("mains") + F.col("rests") - 1
    held = held.withColumn("own", F.when(inside, F.pmod(turn, "mains")).otherwise(F.col("mains") + F.pmod(turn, "rests")).cast("int"))
    spread = held.withColumn("other", F.explode(F.sequence(F.when(inside, F.col("mains")).otherwise(F.lit(0)), last)))
    spread = scratch.save(spread.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "part"), "spread")
    sets = _node_sets(spread.select("node").distinct(), nodes, docs, id_col, text_col, scratch, "second")
    rest = spread.join(nodes.select("node", "sketch"), "node").join(sets, "node").select("key", "lo", "hi", "own", "node", "part", "sketch", "hashes")
    rest = rest.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_compare_blocks, "a long, b long").distinct()
    more = scratch.save(rest, "links-second")
    if more.limit(1).count():
        parts = components(links.union(more), scratch, "parts-second")

    lowest = parts.join(nodes.select(F.col("node").alias("id"), "rep"), "id").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = parts.join(lowest, "component").select(F.col("id").alias("node"), "component_id")
    by_set = nodes.select("node", "digest", "rep").join(named, "node", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("doc_id", "n", "digest", "text_key").join(by_set, "digest", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "text_key")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _node_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, scratch: Scratch, tag: str) -> DataFrame:
    """(node, hashes): the full sets of the wanted nodes, from one text of each."""
    wanted = nodes.join(wanted, "node").select("node", "digest", F.col("source.doc_id").alias("_id"), F.col("source.text_key").alias("_key"))
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = docs.select(F.col(id_col).cast("long").alias("_doc"), F.xxhash64(data).alias("_text_key"), data.alias("_text"))
    held = texts.join(wanted, (F.col("_text_key") == F.col("_key")) & F.col("_doc").eqNullSafe(F.col("_id"))).select("node", "digest", "_text")
    return scratch.save(held.mapInArrow(_sets, "node long, hashes binary").dropDuplicates(["node"]), f"sets-{tag}")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets are similar enough."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    pairs = pairs.join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {SIMILAR} * greatest(na, nb)").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_thin, "a long, b long")
    pairs = scratch.save(pairs, "pairs")
    sets = _node_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, docs, id_col, text_col, scratch, "first")
    a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    b = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "ha", "hb").mapInArrow(_confirm, "a long, b long")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_groups`` keeps, with all their columns.

    Of rows that repeat an id with its text one stays, whichever; a null id's rows stay where no id
    reaches them. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "near")
    kept = _grouped(docs, scratch, id_col, text_col).where("kept").select("doc_id", "text_key")
    return keep_rows(docs, kept, scratch, id_col, text_col)

"""Embedding near-dedup on a flat graph.

Vectors of a label are dealt to overlapping cluster shards. Each shard builds a graph in which a
node keeps the neighbours that robust pruning leaves; a node's lists from all its shards are
united. Every vector then searches its shards: greedily from the shard's medoid, and from where it
stands itself, until nothing nearer is found, and from there through all nodes within the range.
What is too large for a shard and too tight to part is compared exactly, block against block.
Cosines in double precision decide; a sample held against brute force audits the recall, more
overlap is taken where it falls short, and everything is compared exactly where that isn't enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Scratch, components, slots

COSINE = 0.93
#: Vectors of a shard: at most, and aimed at when one is split; centres of one split at most.
MOST, AIM, CENTRES = 4000, 500, 64
#: Shards that a vector is dealt to, tried in turn until the audit is content.
OVERLAPS = (3, 5, 8)
#: Neighbours kept by pruning, candidates for it, its slack; width of the greedy search.
DEGREE, CANDIDATES, SLACK, BEAM = 24, 64, 1.2, 24
#: Sampled queries of the audit, and the recall it asks for.
AUDITED, RECALL = 256, 0.95
#: Levels of splitting; what is still too large then is compared exactly.
LEVELS = 6
#: Vectors of a block of the exact comparison.
BLOCK = 8000
_SALT = 20_000
#: How the names of shards begin; exact ones come first, so that a pair which has both kinds counts in an exact one.
_EXACT, _GRAPH = "0/", "1/"


def _matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _unit(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    x = _matrix(lists)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _runs(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.Table]:
    """Tables of consecutive rows with the same value in a column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_pylist()
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if held and held[0].column(column)[0].as_py() != keys[at]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield pa.Table.from_batches(held)


def prune(sims: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Robust pruning: for each row of candidates, nearest first, which of them stay.

    ``sims``: cosines to the candidates (rows x candidates); ``among``: between them (rows x
    candidates x candidates). A candidate goes if one that stays is nearer to it, with slack, than
    the row's node is.
    """
    far = np.sqrt(np.maximum(0, 2 - 2 * sims))
    between = SLACK * np.sqrt(np.maximum(0, 2 - 2 * among))
    open_, kept = np.ones(sims.shape, bool), np.zeros(sims.shape, bool)
    count = np.zeros(len(sims), np.int64)
    for k in range(sims.shape[1]):
        take = open_[:, k] & (count < DEGREE)
        kept[:, k] = take
        count += take
        open_ &= ~take[:, None] | (between[:, k] > far)
    return kept


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cuts, ends, medoid): the neighbours of row k of ``x`` are ``ends[cuts[k] : cuts[k + 1]]``."""
    n = len(x)
    most = min(CANDIDATES, n - 1)
    single = x.astype(np.float32)
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, n if most else 0, 256):
        sims = single[low : low + 256] @ single.T
        sims[np.arange(len(sims)), np.arange(low, low + len(sims))] = -2
        near = np.argpartition(-sims, most - 1, axis=1)[:, :most]
        there = np.take_along_axis(sims, near, 1)
        by = np.argsort(-there, axis=1, kind="stable")
        near, there = np.take_along_axis(near, by, 1), np.take_along_axis(there, by, 1)
        some = single[near]
        row, k = np.nonzero(prune(there, some @ some.transpose(0, 2, 1)))
        starts.append(row + low)
        ends.append(near[row, k])
    start, end = np.concatenate(starts), np.concatenate(ends)
    by = np.lexsort((start, end))  # of the ways back to a node, the first few
    rank = np.arange(len(by)) - np.searchsorted(end[by], end[by])
    back = by[rank < DEGREE]
    both = np.unique(np.concatenate([start * n + end, end[back] * n + start[back]]))
    medoid = int((x @ x.mean(axis=0)).argmax()) if n else 0
    return np.searchsorted(both, np.arange(n + 1) * n), both % max(1, n), medoid


def range_search(x: np.ndarray, single: np.ndarray, cuts: np.ndarray, ends: np.ndarray, medoid: int, asked: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs within the range that the graph leads to, for all rows ``asked`` at once.

    Each query starts at the medoid and at its own place. Greedy: of the BEAM nearest, what is
    nearest and not yet expanded, until all are. Then expanding: every neighbour of a row in range.
    Single precision leads the way, double precision decides.
    """
    m, n = len(asked), len(x)
    near = cosine - 1e-5
    seen, last = np.zeros(m * n, bool), np.empty(m * n, np.int32)
    hits: list[tuple[np.ndarray, np.ndarray]] = []

    def step(q: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, cosine) of what is new among the neighbours of ``rows``; in order of the queries."""
        size = cuts[rows + 1] - cuts[rows]
        key = np.repeat(q * n, size) + ends[np.repeat(cuts[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        return look(key[~seen[key]])

    def look(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        turn = np.arange(len(key), dtype=np.int32)
        last[key] = turn
        key = key[last[key] == turn]
        seen[key] = True
        q, rows = key // n, key % n
        sims = np.einsum("ij,ij->i", single[asked[q]], single[rows])
        inside = sims >= near
        hits.append((q[inside], rows[inside]))
        return q, rows, sims

    pool = np.full((m, BEAM), -1)
    best = np.full((m, BEAM), -9, np.float32)
    done = np.ones((m, BEAM), bool)
    q = np.arange(m)
    found = look(np.sort(np.concatenate([q * n + asked, q * n + medoid])))
    while True:
        q, rows, sims = found
        first = np.searchsorted(q, np.arange(m + 1))
        width = int(np.diff(first).max()) if len(q) else 0
        place = np.arange(len(q)) - first[q]
        more, cos, old = np.full((m, width), -1), np.full((m, width), -9, np.float32), np.ones((m, width), bool)
        more[q, place], cos[q, place], old[q, place] = rows, sims, False
        more, cos, old = np.concatenate([pool, more], 1), np.concatenate([best, cos], 1), np.concatenate([done, old], 1)
        if width:
            top = np.argpartition(-cos, BEAM - 1, axis=1)[:, :BEAM]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(cos, top, 1), axis=1, kind="stable"), 1)
            more, cos, old = (np.take_along_axis(z, top, 1) for z in (more, cos, old))
        pool, best, done = more, cos, old
        todo = ~done & (np.cumsum(~done, axis=1) <= 8)
        if not todo.any():
            break
        q, k = np.nonzero(todo)
        done |= todo
        found = step(q, pool[q, k])
    walked = 0
    while walked < len(hits):
        q, rows = (np.concatenate([h[k] for h in hits[walked:]]) for k in (0, 1))
        walked = len(hits)
        if len(q):
            by = np.argsort(q, kind="stable")
            step(q[by], rows[by])
    q, rows = (np.concatenate([h[k] for h in hits]) for k in (0, 1))
    fit = (np.einsum("ij,ij->i", x[asked[q]], x[rows]) >= cosine) & (asked[q] != rows)
    return asked[q[fit]], rows[fit]


def _assign(overlap: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (place, kind, shard, node, k, vector): centres come before members in each place.

        Centres within the range of one before are left out, so that what is linked with all of a
        cluster stays in one shard. With fewer than two for each overlap, the shard is not split
        but marked as exact; every place of a shard sees the same centres.
        """
        for rows in _runs(batches):
            kind = np.array(rows["kind"].to_pylist())
            x = _unit(rows["vector"])
            centre, member = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
            shard = rows["shard"][0].as_py()
            nodes = rows["node"].to_numpy()[member]
            apart: list[int] = []
            for k in centre.tolist():
                if not apart or (x[apart] @ x[k]).max() < cosine:
                    apart.append(k)
            centre = np.array(apart, np.int64)
            if len(centre) < 2 * overlap:
                yield pa.RecordBatch.from_arrays([pa.array([_EXACT + shard[len(_GRAPH) :]] * len(nodes), pa.string()), pa.array(nodes)], names=["shard", "node"])
                continue
            for low in range(0, len(member), 4096):
                some = member[low : low + 4096]
                near = np.argsort(-(x[some] @ x[centre].T), axis=1, kind="stable")[:, : min(overlap, len(centre))]
                names = pa.array([f"{shard}/{k}" for k in near.ravel().tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(np.repeat(nodes[low : low + 4096], near.shape[1]))], names=["shard", "node"])

    return run


def _whole(vectors: DataFrame, kind: str) -> DataFrame:
    """(shard, node): a shard of the kind for each label and length."""
    return vectors.select(F.concat_ws(":", F.concat(F.lit(kind), F.col("label").cast("string")), F.size("vector").cast("string")).alias("shard"), "node")


def _shards(vectors: DataFrame, scratch: Scratch, overlap: int, cosine: float) -> DataFrame:
    """(shard, node): every vector in the shards of its nearest centres, no shard of a graph above MOST."""
    members = scratch.save(_whole(vectors, _GRAPH), f"members-{overlap}-0")
    for level in range(1, LEVELS + 1):
        big = scratch.save(members.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).where((F.col("size") > MOST) & F.col("shard").startswith(_GRAPH)), f"big-{overlap}-{level}")
        if not big.limit(1).count():
            return members
        rows = members.join(big, "shard").join(vectors.select("node", "vector"), "node")
        want = F.least(F.lit(CENTRES), F.greatest(F.lit(max(8, 2 * overlap)), F.ceil(F.col("size") / AIM))).cast("int")
        turn = F.xxhash64("node", F.lit(level))
        # a sample of about 4 * CENTRES vectors of each shard, whatever its size
        drawn = rows.where(F.pmod(turn, F.greatest(F.lit(1), F.floor(F.col("size") / (4 * CENTRES)))) == 0)
        centres = drawn.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(turn.alias("turn"), "vector"))).alias("all"), F.first(want).alias("want"), F.first("size").alias("size"))
        salts = F.ceil(F.col("size") / _SALT).cast("int")
        spread = centres.select("shard", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.slice("all", 1, F.col("want")).alias("some"))
        spread = spread.select(F.concat_ws("#", "shard", "salt").alias("place"), F.lit(0).alias("kind"), "shard", F.lit(-1).cast("long").alias("node"), F.posexplode("some").alias("k", "one"))
        spread = spread.select("place", "kind", "shard", "node", "k", F.col("one.vector").alias("vector"))
        dealt = rows.select(F.concat_ws("#", "shard", F.pmod(F.xxhash64("node"), salts)).alias("place"), F.lit(1).alias("kind"), "shard", "node", F.lit(0).alias("k"), "vector")
        split = spread.union(dealt).repartition("place").sortWithinPartitions("place", "kind", "k", "node").mapInArrow(_assign(overlap, cosine), "shard string, node long")
        members = scratch.save(split.union(members.join(big, "shard", "left_anti")).distinct(), f"members-{overlap}-{level}")
    big = members.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).where((F.col("size") > MOST) & F.col("shard").startswith(_GRAPH)).select("shard", F.lit(True).alias("big"))
    exact = F.concat(F.lit(_EXACT), F.substr("shard", F.lit(len(_GRAPH) + 1)))
    return members.join(big, "shard", "left").select(F.when(F.col("big"), exact).otherwise(F.col("shard")).alias("shard"), "node")


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, node, vector) in runs of a shard: (shard, node, medoid, near)."""
    for rows in _runs(batches):
        nodes = rows["node"].to_numpy()
        cuts, ends, medoid = build(_unit(rows["vector"]))
        near = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(nodes[ends]))
        yield pa.RecordBatch.from_arrays([rows["shard"].combine_chunks(), pa.array(nodes), pa.array(np.arange(len(nodes)) == medoid), near], names=["shard", "node", "medoid", "near"])


def _joined(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each of ``size`` positions is linked with, by whatever way."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _earlier(rows: pa.Table, here: str) -> np.ndarray:
    """(rows x shards) which of the shards that come before this one a row is in."""
    lists = rows["shards"].combine_chunks()
    names = lists.flatten().dictionary_encode()
    known = names.dictionary.to_pylist()
    before = np.array([s < here for s in known], bool)
    place = np.cumsum(before) - 1
    row, at = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), names.indices.to_numpy()
    fit = before[at]
    shares = np.zeros((len(lists), int(before.sum())), np.float32)
    shares[row[fit], place[at[fit]]] = 1
    return shares


def _search(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, node, vector, copies, medoid, near, shards): (node, links, root) in this shard.

        A pair that shares several shards counts in the first of them.
        """
        for rows in _runs(batches):
            here = rows["shard"][0].as_py()
            nodes, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()  # nodes ascend
            x = _unit(rows["vector"])
            single = x.astype(np.float32)
            near = rows["near"].combine_chunks()
            row, end = np.repeat(np.arange(len(nodes)), near.value_lengths().to_numpy()), near.flatten().to_numpy()
            at = np.minimum(np.searchsorted(nodes, end), len(nodes) - 1)
            row, at = row[nodes[at] == end], at[nodes[at] == end]
            cuts = np.searchsorted(row, np.arange(len(nodes) + 1))
            medoid = int(np.flatnonzero(rows["medoid"].to_numpy())[0])
            shares = _earlier(rows, here)
            links = np.zeros(len(nodes), np.int64)
            ways: list[tuple[np.ndarray, np.ndarray]] = []
            for low in range(0, len(nodes), 256):
                a, b = range_search(x, single, cuts, at, medoid, np.arange(low, min(low + 256, len(nodes))), cosine)
                new = np.einsum("ij,ij->i", shares[a], shares[b]) == 0
                links += np.bincount(a[new], copies[b[new]], len(nodes)).astype(np.int64)
                ways.append((a, b))
            root = _joined(len(nodes), *(np.concatenate(z) for z in zip(*ways, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links), pa.array(nodes[root])], names=["node", "links", "root"])

    return run


def _between(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (place, shard, side, node, copies, shards, vector): (node, links, root) of two blocks, or of one with itself."""
        for rows in _runs(batches):
            here = rows["shard"][0].as_py()
            side, nodes, copies = (rows[c].to_numpy() for c in ("side", "node", "copies"))
            x = _unit(rows["vector"])
            shares = _earlier(rows, here)
            left = np.flatnonzero(side == 0)
            right = np.flatnonzero(side == 1) if side.any() else left
            alone = right is left
            links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
            for low in range(0, len(left), 512):
                some = left[low : low + 512]
                hit = x[some] @ x[right].T >= cosine
                hit &= some[:, None] != right[None, :]
                for k, row in zip(some.tolist(), hit, strict=True):
                    linked = np.append(right[row], k)
                    roots = np.unique(root[linked])
                    if len(roots) > 1:
                        root[np.isin(root, roots)] = roots[0]
                if shares.shape[1]:
                    hit &= shares[some] @ shares[right].T == 0
                links[some] += hit @ copies[right]
                if not alone:
                    links[right] += copies[some] @ hit
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links), pa.array(nodes[root])], names=["node", "links", "root"])

    return run


def _exact(members: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """(node, links, root) of the exact shards: each pair of blocks meets at one place."""
    shards = members.groupBy("node").agg(F.collect_list("shard").alias("shards"))
    held = members.where(F.col("shard").startswith(_EXACT))
    sizes = held.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = held.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    rows = rows.select("shard", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pair = F.concat_ws("#", "shard", F.least("block", "other"), F.greatest("block", "other"))
    rows = rows.select(pair.alias("place"), "shard", (F.col("block") > F.col("other")).cast("int").alias("side"), "node")
    rows = rows.join(shards, "node").join(vectors.select("node", "vector", "copies"), "node").select("place", "shard", "side", "node", "copies", "shards", "vector")
    return rows.repartition("place").sortWithinPartitions("place", "side", "node").mapInArrow(_between(cosine), "node long, links long, root long")


def brute_links(vectors: DataFrame, queries: list[tuple], cosine: float = COSINE) -> DataFrame:
    """(node, links): links of the given (node, label, vector) queries against all rows, in blocks.

    ``vectors``: node, label, vector, copies. The queries are broadcast; there are AUDITED at most.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[tuple, list] = {}
        for node, label, vector in shared.value:
            asked.setdefault((label, len(vector)), []).append((node, vector))
        ready = {key: (np.array([n for n, _ in some]), _unit(pa.array([v for _, v in some]))) for key, some in asked.items()}
        for batch in batches:
            node, copies = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            label, size = np.array(batch.column(1).to_pylist(), object), batch.column(2).value_lengths().to_numpy()
            nodes, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for key, (own, q) in ready.items():
                held = (label == key[0]) & (size == key[1])
                if held.any():
                    hit = (q @ _unit(batch.column(2).filter(pa.array(held))).T >= cosine) & (own[:, None] != node[held][None, :])
                    nodes.append(own)
                    links.append(hit @ copies[held])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(links))], names=["node", "links"])

    return vectors.select("node", "label", "vector", "copies").mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", overlaps: tuple[int, ...] = OVERLAPS, report: dict | None = None) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Only vectors of one label and one length are compared. A null label and a vector that is null,
    zero or holds null or non-finite components link with nothing. Equal vectors are one node with a
    number of copies, all linked with each other. Repeated rows are copies of each other; a null id
    counts as a link and takes its node's component (null, and kept, where no id is in it). An empty
    table gives an empty result; other columns aren't read. ``report`` receives the audited recall.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    fit = F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", bad) & (norm > 0) & (norm < float("inf"))
    rows = scratch.save(rows.withColumn("fit", F.coalesce(fit, F.lit(False))), "rows")
    total = rows.count()
    classes = rows.where("fit").groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    nodes = scratch.save(slots(classes, [], ["label", "vector"], total).withColumnRenamed("slot", "node"), "nodes")
    # the audit's queries: a sample in hashed order, of a fixed size
    sample = nodes.orderBy(F.xxhash64("node", F.lit("audit"))).limit(AUDITED).select("node", "label", "vector").collect()
    truth = {r["node"]: r["links"] for r in brute_links(nodes, [tuple(r) for r in sample], cosine).collect()}
    for overlap in (*overlaps, None):  # None: everything exactly
        members = _whole(nodes, _EXACT) if overlap is None else _shards(nodes, scratch, overlap, cosine)
        members = scratch.save(members, f"members-{overlap}")
        whole = members.where(F.col("shard").startswith(_GRAPH)).join(nodes.select("node", "vector"), "node").select("shard", "node", "vector")
        built = scratch.save(whole.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(lambda it: _graphs(it), "shard string, node long, medoid boolean, near array<long>"), f"built-{overlap}")
        united = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        shards = members.groupBy("node").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
        asked = built.select("shard", "node", "medoid").join(united, "node").join(shards, "node").join(nodes.select("node", "vector", "copies"), "node")
        found = asked.select("shard", "node", "vector", "copies", "medoid", "near", "shards").repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(_search(cosine), "node long, links long, root long")
        if members.where(F.col("shard").startswith(_EXACT)).limit(1).count():
            found = found.union(_exact(members, nodes, cosine))
        found = scratch.save(found, f"found-{overlap}")
        links = scratch.save(found.groupBy("node").agg(F.sum("links").alias("links")), f"links-{overlap}")
        got = {r["node"]: r["links"] for r in links.where(F.col("node").isin(list(truth) or [-1])).collect()}  # AUDITED rows at most
        shares = [got.get(k, 0) / n for k, n in truth.items() if n]
        # of all links, and of a query's links on average
        recall = min(sum(got.get(k, 0) for k in truth) / sum(truth.values()), sum(shares) / len(shares)) if shares else 1.0
        if report is not None:
            report.update(recall=recall, overlap=overlap, queries=len(truth))
        if recall >= RECALL:
            break
    parts = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch, "parts")
    lowest = parts.join(nodes.select(F.col("node").alias("id"), "rep"), "id").groupBy("component").agg(F.min("rep").alias("low"))
    named = parts.join(lowest, "component").select(F.col("id").alias("node"), "low")
    classes = nodes.join(links, "node").join(named, "node", "left").select("label", "vector", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("low", "rep").alias("component_id"))
    fits = rows.where("fit").join(classes, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    out = fits.union(rows.where("not fit").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

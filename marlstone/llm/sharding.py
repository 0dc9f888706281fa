"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Scratch, slots

SHARDS = 16
#: Rounds of propagation at most; it ends before once no move is left that quotas admit.
ROUNDS = 24


def admitted(wishes: dict[tuple[int, int], int], free: dict[int, int]) -> dict[tuple[int, int], int]:
    """How many rows may move between each pair of shards.

    Opposite wishes are exchanged, which changes no size; what remains moves as far as the target
    has room, the largest wishes first.
    """
    out = {(a, b): min(n, wishes.get((b, a), 0)) for (a, b), n in wishes.items()}
    for (a, b), n in sorted(wishes.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - out[a, b], free.get(b, 0))
        out[a, b] += more
        free[b] = free.get(b, 0) - more
    return out


def _star_links(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Equal texts as a star: each row and the first row of its group."""
    groups = rows.groupBy("digest").agg(F.min("row").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "hub")
    return rows.select("digest", "row").join(groups, "digest").where("row <> hub").select(F.col("row").alias("a"), F.col("hub").alias("b"))


def cut_edges(placed: DataFrame, links: DataFrame) -> int:
    """Links whose ends are in different shards."""
    a = placed.select(F.col("row").alias("a"), F.col("shard").alias("sa"))
    b = placed.select(F.col("row").alias("b"), F.col("shard").alias("sb"))
    return links.join(a, "a").join(b, "b").where("sa <> sb").count()


def _propagate(links: DataFrame, quota: dict[int, int], shards: int, rounds: int, scratch: Scratch) -> DataFrame:
    """(row, shard) of the linked rows after at most ``rounds`` rounds."""
    both = scratch.save(links.union(links.select("b", "a")), "edges")
    placed = scratch.save(both.select(F.col("a").alias("row")).distinct().withColumn("shard", (F.col("row") % shards).cast("int")), "placed-0")
    for k in range(1, rounds + 1):
        votes = both.join(placed.withColumnRenamed("row", "b"), "b").groupBy(F.col("a").alias("row"), F.col("shard").alias("want")).agg(F.count(F.lit(1)).alias("votes"))
        now = votes.join(placed, "row")
        # most votes; of ties the present shard, then the smallest
        best = now.groupBy("row").agg(F.max(F.struct("votes", (F.col("want") == F.col("shard")).alias("same"), (-F.col("want")).alias("less"))).alias("best"), F.first("shard").alias("shard"))
        # half of the rows may move in a round: neighbours that move at once would only change places
        may = F.pmod(F.xxhash64("row", F.lit(k)), F.lit(2)) == 0
        wanted = scratch.save(best.select("row", F.col("shard").alias("a"), (-F.col("best.less")).cast("int").alias("b"), may.alias("may")).where("a <> b"), f"movers-{k}")
        counted = wanted.groupBy("a", "b").agg(F.count(F.lit(1)).alias("all"), F.count_if("may").alias("may")).collect()  # shards² numbers
        sizes = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
        room = lambda: {s: quota[s] - sizes.get(s, 0) for s in range(shards)}
        if not any(admitted({(r["a"], r["b"]): r["all"] for r in counted}, room()).values()):
            break
        wishes = {(r["a"], r["b"]): r["may"] for r in counted if r["may"]}
        allowed = admitted(wishes, room())
        movers = wanted.where("may")
        if not any(allowed.values()):
            continue
        limit = F.create_map(*[x for (a, b), n in allowed.items() for x in (F.lit(a * shards + b), F.lit(n))])[F.col("a") * shards + F.col("b")]
        moved = slots(movers, ["a", "b"], ["row"], sum(wishes.values())).where(F.col("slot") < limit).select("row", F.col("b").alias("to"))
        after = placed.join(moved, "row", "left").select("row", F.coalesce("to", "shard").alias("shard"))
        placed = scratch.save(after, f"placed-{k}")
        scratch.drop(f"placed-{k - 1}", f"movers-{k}")
    return placed


def shard_documents(docs: DataFrame, links: DataFrame | None = None, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", report: dict | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: shards' counts are at most one apart. Rows with equal texts are linked;
    ``links`` (a, b: ids) adds links of its own. Rows without links fill what the linked leave of
    the quotas. Where a group is larger than a shard it has to be cut. Null texts count as empty,
    with size 1; rows are numbered first, so repeated rows and null ids are rows like others. An
    empty table gives an empty result; other columns aren't read. ``report`` receives the number of
    links and how many of them are cut before propagation and after it.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    read = scratch.save(read, "read")
    n = read.count()
    rows = scratch.save(slots(read, [], ["doc_id", "digest"], n).withColumnRenamed("slot", "row"), "rows")
    scratch.drop("read")
    quota = {s: n // shards + (s < n % shards) for s in range(shards)}
    edges = _star_links(rows, scratch)
    if links is not None:
        ends = rows.groupBy("doc_id").agg(F.min("row").alias("row"))
        a = ends.select(F.col("doc_id").alias("_a"), F.col("row").alias("ra"))
        b = ends.select(F.col("doc_id").alias("_b"), F.col("row").alias("rb"))
        own = links.select(F.col("a").alias("_a"), F.col("b").alias("_b")).join(a, "_a").join(b, "_b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        edges = edges.union(own)
    edges = scratch.save(edges, "links")
    placed = _propagate(edges, quota, shards, rounds, scratch)
    if report is not None:
        began = rows.select("row", (F.col("row") % shards).cast("int").alias("shard"))
        report.update(links=edges.count(), cut_before=cut_edges(began, edges), cut_after=cut_edges(placed, edges))
    left, at = {}, 0
    taken = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    for s in range(shards):
        at += quota[s] - taken.get(s, 0)
        left[s] = at
    alone = rows.join(placed, "row", "left_anti")
    fill = F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        fill = F.when(F.col("slot") < left[s], F.lit(s)).otherwise(fill)
    filled = slots(alone, [], ["row"], n).withColumn("shard", fill).drop("slot")
    every = rows.join(placed, "row").unionByName(filled)
    out = slots(scratch.save(every.select("row", "doc_id", "size", "text_crc32", "shard"), "sharded"), ["shard"], ["row"], n)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

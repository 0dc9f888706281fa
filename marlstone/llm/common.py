"""What the operators of this subpackage share: scratch tables, slots, components, row filters."""

from __future__ import annotations

import getpass
import math
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_MADE: dict[str, object] = {}
_WATCHED: list[list] = []
_CLEANUP, _BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"


def once(broadcast, make: Callable) -> Callable:
    """A function that makes ``make(*broadcast.value)`` once in each worker process and keeps the last few."""
    key = uuid.uuid4().hex

    def get():
        if key not in _MADE:
            if len(_MADE) >= 2:
                _MADE.clear()
            _MADE[key] = make(*broadcast.value)
        return _MADE[key]

    return get


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only on a single machine that names none."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/marlstone-{getpass.getuser()}"


class Scratch:
    """Written tables that cut a plan's lineage, in a folder of their own under the shared one.

    A written table survives the loss of executors and is computed once however often it is
    read. ``drop`` removes tables that nothing reads any more; what a returned DataFrame still
    reads stays until ``clear``, and goes with the driver's end otherwise.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{scratch_root(spark)}/scratch-{name}-{uuid.uuid4().hex}"
        at, files = self._at(self.path)
        files.mkdirs(at)
        files.deleteOnExit(at)
        for some in _WATCHED:
            some.append(self)

    def save(self, df: DataFrame, tag: str, batch_rows: int | None = None) -> DataFrame:
        """Write and read again; ``batch_rows``: rows of a batch that goes to Python, for rows that are long."""
        path = f"{self.path}/{tag}"
        settings = {_CLEANUP: "true"}  # the shuffle files of the plan go once the table is written
        if batch_rows:
            settings[_BATCH] = str(batch_rows)
        was = {name: self.spark.conf.get(name, None) for name in settings}
        try:
            for name, value in settings.items():
                self.spark.conf.set(name, value)
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            for name, value in was.items():
                self.spark.conf.unset(name) if value is None else self.spark.conf.set(name, value)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        for tag in tags:
            self._delete(f"{self.path}/{tag}")

    def clear(self) -> None:
        self._delete(self.path)

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        at, files = self._at(path)
        files.delete(at, True)


@contextmanager
def cleared():
    """Clears, at its end, the scratch tables that were made inside: for a result that was written meanwhile."""
    made: list[Scratch] = []
    _WATCHED.append(made)
    try:
        yield
    finally:
        _WATCHED.remove(made)
        for scratch in made:
            scratch.clear()


def slots(df: DataFrame, group: list[str], order: list[str], rows: int, per_bin: int = 50_000) -> DataFrame:
    """Add ``slot``, gapless from 0 within each group, without putting a group into one task (only repeats of one row share a bin).

    Rows are numbered within hashed bins of about ``per_bin`` rows and a bin's offset is the
    number of rows in the bins before it. ``rows`` is the number of rows of ``df``: the number
    of bins grows with it.
    """
    bins = max(1, math.ceil(rows / per_bin))
    binned = df.withColumn("_bin", F.pmod(F.xxhash64(*order), F.lit(bins)))
    counts = binned.groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_bin").alias("_g__bin"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*group, "_bin").orderBy(*order)
    numbered = binned.withColumn("_row", F.row_number().over(within) - 1)
    on = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in (*group, "_bin")]
    return numbered.join(offsets, on).withColumn("slot", (F.col("_offset") + F.col("_row")).cast("long")).drop("_bin", "_row", "_offset", *[f"_g_{c}" for c in (*group, "_bin")])


def components(links: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(id, component): smallest id reachable over the undirected ``links`` (a, b).

    Each round takes the smallest label among a node's neighbours and then jumps to that
    label's own label, so chains shorten by halves. Labels are written after every round; only
    the number of changed rows reaches the driver.
    """
    both = scratch.save(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{tag}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{tag}-0")
    for k in count(1):  # each round but the last lowers a label
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        moved = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        up = labels.select(F.col("id").alias("now"), F.col("component").alias("up"))
        jumped = moved.join(up, "now", "left").select("id", "was", F.least("now", F.coalesce("up", "now")).alias("component"))
        table = scratch.save(jumped, f"{tag}-{k}")
        scratch.drop(f"{tag}-{k - 1}")
        labels = table.select("id", "component")
        if table.where("component <> was").limit(1).count() == 0:
            return labels


def keep_ids(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id (null included) is in ``kept``'s first column; all columns as they were."""
    ids = kept.select(F.col(kept.columns[0]).alias("_kept_id")).distinct()
    return docs.join(ids, docs[id_col].eqNullSafe(ids["_kept_id"]), "left_semi")


def text_key(text_col: str) -> Column:
    """A hash of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def keep_rows(docs: DataFrame, kept: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id and text are in ``kept`` (doc_id, text_key: one row for each row that stays), all columns as they were.

    Of rows that repeat an id with its text one stays, whichever; another text under the same id, or under a
    null id, is judged by itself.
    """
    pairs = scratch.save(kept.groupBy(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_key")).agg(F.count(F.lit(1)).alias("_kept_n")), "kept")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), text_key(text_col).alias("_key"))
    held = rows.join(pairs, F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_key") == F.col("_kept_key")))
    if pairs.where("_kept_n > 1").limit(1).count():
        held = held.where("_kept_n = 1").union(held.where("_kept_n > 1").dropDuplicates(["_kept_id", "_kept_key"]))
    return held.select("_row.*")

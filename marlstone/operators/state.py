"""Work items, runs and the seen set: the incremental loop's state as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators.merge import fill, insert_missing, merge, missing

# The states an item may go to from each state.
TRANSITIONS = {
    "discovered": ("discovered", "fetching", "skipped", "failed"),
    "fetching": ("fetching", "fetched", "failed"),
    "fetched": ("fetched", "translating", "skipped", "failed"),
    "translating": ("translating", "published", "failed"),
    "published": ("published",),
    "skipped": ("skipped",),
    "failed": ("failed", "discovered", "fetching"),
}
TERMINAL = ("published", "skipped")
#: Errors that a run's ledger keeps.
KEPT_ERRORS = 50
#: Parts of a source that are sorted apart.
PARTS = 32


def transition_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, some in TRANSITIONS.items() for b in some], "from_status string, to_status string")


def may_go(old: Column, new: Column) -> Column:
    """Whether an edge of the graph leads from one state to the other."""
    table = F.create_map(*[x for a, some in TRANSITIONS.items() for x in (F.lit(a), F.array(*[F.lit(b) for b in some]))])
    return F.coalesce(F.array_contains(F.try_element_at(table, old), new), F.lit(False))


_KEYS = ["source_id", "original_url"]


def discover(items: DataFrame, found: DataFrame, as_of: Column) -> DataFrame:
    """Found addresses as items: new ones are discovered, failed ones again, others keep their state."""
    new = found.select(*_KEYS).distinct().withColumns({"status": F.lit("discovered"), "attempt_count": F.lit(0), "discovered_at": as_of, "updated_at": as_of})
    again = lambda old, now: F.when(old == "failed", now).otherwise(old)
    known = items.select(*_KEYS, F.col("status").alias("_was"))
    joined = new.join(known, _KEYS, "left")
    target = merge(items, joined.drop("_was"), _KEYS, {"status": again, "attempt_count": lambda a, b: a, "discovered_at": lambda a, b: a})
    if "last_error" in items.columns:
        failed = known.where("_was = 'failed'").join(new.select(*_KEYS), _KEYS, "left_semi").select(*_KEYS, F.lit(True).alias("_clear"))
        target = target.join(failed, _KEYS, "left").withColumn("last_error", F.when(F.col("_clear").isNull(), F.col("last_error"))).drop("_clear")
    return target.select(*items.columns)


def transition(items: DataFrame, moves: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(next items, refused moves): ``moves`` (source_id, original_url, to_status, article_id) along the graph's edges."""
    joined = moves.join(items.select(*_KEYS, "status"), _KEYS, "left")
    good = joined.where(may_go(F.col("status"), F.col("to_status")))
    refused = joined.where(~may_go(F.col("status"), F.col("to_status"))).withColumn("reason", F.when(F.col("status").isNull(), F.lit("unknown item")).otherwise(F.concat_ws(" ", F.lit("invalid transition:"), "status", F.lit("->"), "to_status")))
    update = good.select(*_KEYS, F.col("to_status").alias("status"), "article_id", as_of.alias("updated_at"))
    return merge(items, update, _KEYS, {"article_id": fill}), refused


def record_failures(items: DataFrame, failures: DataFrame, as_of: Column) -> DataFrame:
    """``failures`` (source_id, original_url, error): one more attempt and the error, except in terminal states."""
    hit = failures.select(*_KEYS, F.col("error").alias("_error"), F.lit(True).alias("_hit"))
    joined = items.join(hit, _KEYS, "left")
    counts = F.coalesce(F.col("_hit"), F.lit(False)) & ~F.col("status").isin(*TERMINAL)
    out = {"status": F.when(counts, F.lit("failed")).otherwise(F.col("status")), "attempt_count": F.col("attempt_count") + F.when(counts, 1).otherwise(0), "last_error": F.when(counts, F.col("_error")).otherwise(F.col("last_error")), "updated_at": F.when(counts, as_of).otherwise(F.col("updated_at"))}
    return joined.withColumns(out).select(*items.columns)


def mark_processed(items: DataFrame, done: DataFrame, as_of: Column) -> DataFrame:
    """Addresses as published, whether or not they were known."""
    new = done.select(*_KEYS).distinct().withColumns({"status": F.lit("published"), "attempt_count": F.lit(0), "discovered_at": as_of, "updated_at": as_of})
    return merge(items, new, _KEYS, {"attempt_count": lambda a, b: a, "discovered_at": lambda a, b: a})


def reconcile(items: DataFrame, stored: DataFrame, sources: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(next items, inserted): stored articles of known sources that have no item become published ones."""
    known = stored.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(*_KEYS).distinct()
    new = known.withColumns({"status": F.lit("published"), "attempt_count": F.lit(0), "discovered_at": as_of, "updated_at": as_of})
    return insert_missing(items, new, _KEYS), missing(items, new, _KEYS)


def processed(items: DataFrame) -> DataFrame:
    """(source_id, urls, updated_at): published addresses of each source; the time is over all states."""
    return items.groupBy("source_id").agg(F.sort_array(F.collect_list(F.when(F.col("status") == "published", F.col("original_url")))).alias("urls"), F.max("updated_at").alias("updated_at"))


def pending(items: DataFrame) -> DataFrame:
    return items.where(~F.col("status").isin(*TERMINAL))


def run_status(failed: Column) -> Column:
    return F.when(failed > 0, F.lit("partial")).otherwise(F.lit("completed"))


def close_runs(outcomes: DataFrame) -> DataFrame:
    """(source_id, discovered, pending, processed, failed, status, errors) from one row per item: disposition, seq, error.

    ``errors``: JSON of the first ones, as many as a ledger keeps.
    """
    is_ = lambda *names: F.count_if(F.col("disposition").isin(*names))
    rows = outcomes.groupBy("source_id").agg(F.count(F.lit(1)).alias("discovered"), is_("pending", "processed", "failed").alias("pending"), is_("processed").alias("processed"), is_("failed").alias("failed"))
    failed = outcomes.where("disposition = 'failed'").select("source_id", "seq", "error", F.pmod(F.xxhash64("seq"), F.lit(PARTS)).alias("_part"))
    for part in (["_part"], []):  # the first of each part, then of the source: no source is sorted whole
        turn = F.row_number().over(Window.partitionBy("source_id", *part).orderBy("seq"))
        failed = failed.withColumn("_n", turn).where(F.col("_n") <= KEPT_ERRORS)
    kept = failed.groupBy(F.col("source_id").alias("_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "error"))), lambda e: e["error"]).alias("_errors"))
    rows = rows.join(kept, F.col("source_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    errors = F.coalesce("_errors", F.array().cast("array<string>"))
    return rows.withColumn("status", run_status(F.col("failed"))).withColumn("errors", F.to_json(errors)).drop("_errors")


def total(runs: DataFrame) -> DataFrame:
    """Sums over all sources, with the sources' rows nested."""
    counts = ("discovered", "pending", "processed", "failed")
    return runs.agg(*[F.sum(c).alias(c) for c in counts], F.sort_array(F.collect_list(F.struct("source_id", *counts))).alias("sources"))


def update_runs(runs: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next runs, changes of unknown runs); values that a change lacks stay."""
    unknown = changes.join(runs.select("id"), "id", "left_anti")
    known = changes.join(runs.select("id"), "id", "left_semi")
    return merge(runs, known, ["id"], {}, fill), unknown

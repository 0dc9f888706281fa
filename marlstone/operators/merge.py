"""Keyed merges as pure functions: merge(target, source) gives the next snapshot.

A merge joins target and source on their keys and takes each column by a rule; nothing is updated
in place, so a lost executor or a repeated run changes nothing. Merging the same source twice gives
the same table as merging it once. Keys in the source must be unique; the later of several rows
has to be picked first (``latest``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rule = Callable[[Column, Column], Column]


def overwrite(old: Column, new: Column) -> Column:
    return new


def keep_old(old: Column, new: Column) -> Column:
    return old


def fill(old: Column, new: Column) -> Column:
    """The new value, unless it is missing."""
    return F.coalesce(new, old)


def write_once(old: Column, new: Column) -> Column:
    """The first value that was ever set."""
    return F.coalesce(old, new)


def latest(source: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in ``order``."""
    return source.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def merge(target: DataFrame, source: DataFrame, keys: list[str], rules: dict[str, Rule], default: Rule = overwrite) -> DataFrame:
    """Rows of either side; where both have the key, each column by its rule.

    The result has the target's columns. A column that the source lacks keeps its old value, and is
    null in new rows. Null keys match each other.
    """
    old = target.select(*[F.col(c).alias(f"_old_{c}") for c in target.columns], F.lit(True).alias("_in_old"))
    new = source.select(*[F.col(c).alias(f"_new_{c}") for c in source.columns if c in target.columns], F.lit(True).alias("_in_new"))
    on = [F.col(f"_old_{k}").eqNullSafe(F.col(f"_new_{k}")) for k in keys]
    joined = old.join(new, on, "full_outer")
    here, there = F.col("_in_old").isNotNull(), F.col("_in_new").isNotNull()
    out = []
    for c in target.columns:
        was = F.col(f"_old_{c}")
        if c not in source.columns:
            out.append(was.alias(c))
            continue
        now = F.col(f"_new_{c}").cast(target.schema[c].dataType)
        value = F.coalesce(was, now) if c in keys else F.when(here & there, rules.get(c, default)(was, now)).when(there, now).otherwise(was)
        out.append(value.alias(c))
    return joined.select(*out)


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target and the source's rows whose key it lacks, each key once."""
    return target.unionByName(missing(target, source, keys), allowMissingColumns=True)


def missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The source's rows whose key the target lacks, each key once; their number is what an insert affects."""
    first = latest(source, keys, *[F.col(c).asc_nulls_last() for c in source.columns if c not in keys] or [F.lit(1)])
    return first.join(target.select(*keys).distinct(), keys, "left_anti")


def merge_sources(target: DataFrame, source: DataFrame, keep_config: bool = False) -> DataFrame:
    """By id; a sync leaves ``config`` alone, a repository overwrites it. ``created_at`` stays."""
    rules: dict[str, Rule] = {"created_at": keep_old}
    if keep_config:
        rules["config"] = keep_old
    return merge(target, source, ["id"], rules)


def merge_articles(target: DataFrame, source: DataFrame, keep_missing: bool = True) -> DataFrame:
    """By (source_id, original_url). The id stays; a sync keeps image and author where the new ones are missing."""
    rules: dict[str, Rule] = {"id": keep_old, "created_at": keep_old}
    if keep_missing:
        rules |= {"image_url": fill, "author": fill}
    else:
        rules["source_domain"] = keep_old
    return merge(target, source, ["source_id", "original_url"], rules)


def changed_ids(target: DataFrame, source: DataFrame) -> DataFrame:
    """Articles whose incoming id differs from the one they have."""
    new = source.select("source_id", "original_url", F.col("id").alias("new_id"))
    return target.join(new, ["source_id", "original_url"]).where("id <> new_id").select("source_id", "original_url", "id", "new_id")


def merge_versions(target: DataFrame, source: DataFrame) -> DataFrame:
    """By (article_id, language). ``translated_at`` is written once, and only for translations by a model."""
    rules: dict[str, Rule] = {"created_at": keep_old, "excerpt": fill, "translation_model": fill, "original_alt_url": fill, "translated_at": write_once}
    if "translated_at" in source.columns:
        source = source.withColumn("translated_at", F.when(F.col("provenance") == "model", F.col("translated_at")))
    return merge(target, source, ["article_id", "language"], rules)


def merge_original_version(target: DataFrame, source: DataFrame) -> DataFrame:
    """An original: model, alternate address and translation time aren't touched."""
    return merge(target, source.drop("translation_model", "original_alt_url", "translated_at"), ["article_id", "language"], {"created_at": keep_old})


def replace_categories(target: DataFrame, articles: DataFrame) -> DataFrame:
    """(article_id, category_name) after ``articles`` (article_id, categories): null keeps, a list replaces, an empty one clears."""
    given = articles.where(F.col("categories").isNotNull()).select("article_id", "categories")
    kept = target.join(given.select("article_id").distinct(), "article_id", "left_anti")
    new = given.select("article_id", F.explode(F.array_distinct("categories")).alias("category_name"))
    return kept.select("article_id", "category_name").union(new).distinct()


def rename_source(rows: DataFrame, old: str, new: str, id_column: str | None = None) -> DataFrame:
    """Rows of one source under another name; ids that begin with the old name follow."""
    mine = F.col("source_id") == old
    out = rows
    if id_column:
        prefix = F.col(id_column).startswith(f"{old}/")
        out = out.withColumn(id_column, F.when(mine & prefix, F.concat(F.lit(f"{new}/"), F.substr(F.col(id_column), F.lit(len(old) + 2)))).otherwise(F.col(id_column)))
    return out.withColumn("source_id", F.when(mine, F.lit(new)).otherwise(F.col("source_id")))


def rename_items(items: DataFrame, old: str, new: str) -> DataFrame:
    """Work items under the new name; where both names have one, values that are set stay and the later time counts."""
    renamed = rename_source(items.where(F.col("source_id") == old), old, new)
    rest = items.where(F.col("source_id") != old)
    return merge(rest, renamed, ["source_id", "original_url"], {"updated_at": lambda a, b: F.greatest(a, b)}, write_once)


def backfill_translated_at(versions: DataFrame) -> DataFrame:
    return versions.withColumn("translated_at", F.when((F.col("provenance") == "model") & F.col("translated_at").isNull(), F.col("updated_at")).otherwise(F.col("translated_at")))


def drop_originals(versions: DataFrame, articles: DataFrame, source_id: str) -> DataFrame:
    """Versions without one source's originals; translations stay."""
    originals = articles.where(F.col("source_id") == source_id).select(F.col("id").alias("article_id"), F.col("original_language").alias("language"))
    return versions.join(originals, ["article_id", "language"], "left_anti")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows that point to nothing: versions without article, articles without source."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def repeated_keys(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Keys that occur more than once, with their number, the first place and the last."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first_place"), F.max(seq).alias("last_place")).where("n > 1")

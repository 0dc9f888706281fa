"""Sources and sinks: registry, Markdown corpus, processed state and sync payloads."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import urls as U

REGISTRY_SCHEMA = "id string, name string, type string, homepage_url string, blog_url string, domain string, rss_url string, sitemap_url string, update_mode string, language string, article_paths array<string>, exclude_paths array<string>, allow_non_article_paths boolean, limit int, min_content_chars int, quality_filter boolean, url_date_pattern string, zh_path_map map<string,string>, backfill struct<mode:string,since:string,max_articles:int,quality_filter:boolean>"

# What the registry's enumerated fields may hold.
TYPES, UPDATE_MODES = ("company", "personal"), ("active", "dry-run", "disabled")
PROVENANCES = ("original", "official-zh", "native-zh", "model")

VERSION_SCHEMA = "array<struct<language:string,title:string,content_markdown:string,excerpt:string,provenance:string,translation_model:string,original_alt_url:string,translated_at:string>>"
PAYLOAD_SCHEMA = f"sources array<struct<id:string,name:string,type:string,homepage_url:string,blog_url:string,domain:string>>, articles array<struct<id:string,source_id:string,original_url:string,original_language:string,published_at:string,image_url:string,author:string,source_domain:string,categories:array<string>,versions:{VERSION_SCHEMA}>>"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).json(path, multiLine=True)


def is_http_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(?i)https?://[^/?#\s]+"), F.lit(False))


def registry_issues(registry: DataFrame) -> DataFrame:
    """(id, path, message): every fault of every source; no rows for a sound registry."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    found = [F.when(blank(c), F.struct(F.lit(c).alias("path"), F.lit("is required").alias("message"))) for c in ("id", "name", "type", "homepage_url", "blog_url", "domain", "update_mode")]
    found += [F.when(F.col(c).isNotNull() & ~is_http_url(F.col(c)), F.struct(F.lit(c).alias("path"), F.lit("is not an http(s) address").alias("message"))) for c in ("homepage_url", "blog_url", "rss_url", "sitemap_url")]
    found += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.struct(F.lit(c).alias("path"), F.concat(F.lit("must be one of "), F.lit(", ".join(values))).alias("message"))) for c, values in (("type", TYPES), ("update_mode", UPDATE_MODES))]
    single = registry.select("id", F.explode(F.array_compact(F.array(*found))).alias("i")).select("id", "i.path", "i.message")
    twice = registry.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("id").alias("path"), F.lit("occurs more than once").alias("message"))
    return single.union(twice)


def registry_error(registry: DataFrame) -> DataFrame:
    """(error): one text with every fault of a registry; no row for a sound one."""
    lines = registry_issues(registry).select(F.concat(F.coalesce("id", F.lit("?")), F.lit(": "), F.col("path"), F.lit(" "), F.col("message")).alias("line"))
    return lines.agg(F.sort_array(F.collect_list("line")).alias("lines")).where(F.size("lines") > 0).select(F.array_join("lines", "\n").alias("error"))


def first_versions(versions: DataFrame) -> DataFrame:
    """Parsed files, of several for one article and language the first by its path."""
    turn = F.row_number().over(Window.partitionBy("article_id", "language").orderBy("path"))
    return versions.withColumn("_n", turn).where("_n = 1").drop("_n")


def active_sources(registry: DataFrame, source_id: str | None = None, dry_run: bool = False) -> DataFrame:
    """Sources that a run may touch: active ones, all in a dry run."""
    out = registry if dry_run else registry.where("update_mode = 'active'")
    return out.where(F.col("id") == source_id) if source_id else out


def skipped_sources(registry: DataFrame) -> DataFrame:
    return registry.where("update_mode <> 'active'").select("id", "update_mode")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of a tree of Markdown files, a file a row; paths start at the tree's root."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", path).rstrip("/")
    whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return files.select(F.regexp_replace(whole, rf"^.*?\Q{root}\E/", "").alias("path"), F.col("value").alias("content"))


def parse_versions(files: DataFrame) -> DataFrame:
    """Files (path, content) as versions; ``article_id`` is the path without its language folder; ``error`` names missing keys.

    An article's folders count as parts of its slug. A value that is empty is missing.
    """
    value = lambda key: T.frontmatter_value(F.col("content"), key)
    keys = ("blog_id", "original_url", "language", "title", "published_at", "source_domain", "original_language", "provenance", "version_at")
    rows = files.select(
        U.drop_language(F.col("path")).alias("article_id"),
        *[value(k).alias(k) for k in keys],
        *[value(k).alias(k) for k in ("image_url", "author", "excerpt", "translation_model", "original_alt_url")],
        (value("is_original") == "true").alias("is_original"),
        T.frontmatter_categories(F.col("content")).alias("categories"),
        T.body_of(F.col("content")).alias("content_markdown"),
        "path",
    )
    gaps = F.array_compact(F.array(*[F.when(F.coalesce(F.col(k), F.lit("")) == "", F.lit(k)) for k in keys]))
    return rows.withColumn("error", F.when(F.size(gaps) > 0, F.concat(F.lit("missing: "), F.array_join(gaps, ", "))))


def pending_translations(versions: DataFrame) -> DataFrame:
    """Originals that aren't Chinese and have no Chinese file beside them."""
    zh = versions.where(F.col("language").isin("zh", "zh-cn")).select("article_id").distinct()
    return versions.where(F.col("is_original") & ~F.col("language").startswith("zh")).join(zh, "article_id", "left_anti")


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, url) from state files, wrapped (``blogs``) or flat."""
    text = spark.read.text(path, wholetext=True)
    wrapped = F.from_json(F.get_json_object("value", "$.blogs"), "map<string,array<string>>")
    flat = F.from_json("value", "map<string,array<string>>")
    return text.select(F.explode(F.coalesce(wrapped, flat)).alias("source_id", "urls")).select("source_id", F.explode(F.array_distinct("urls")).alias("url"))


def processed_json(state: DataFrame, as_of: str) -> DataFrame:
    """State (source_id, url) as lines of one JSON object a source, for a partitioned sink."""
    return state.groupBy("source_id").agg(F.sort_array(F.collect_set("url")).alias("urls")).select("source_id", F.to_json(F.struct(F.lit(1).alias("version"), F.lit(as_of).alias("updated_at"), "source_id", "urls")).alias("value"))


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """Rows (body) with ``payload`` and ``error``: null payloads are texts that aren't the expected object."""
    parsed = payloads.withColumn("payload", F.from_json("body", PAYLOAD_SCHEMA))
    return parsed.withColumn("error", F.when(F.col("payload").isNull() | (F.col("payload.sources").isNull() & F.col("payload.articles").isNull()), F.lit("not a payload")))


def payload_issues(payloads: DataFrame, key: str) -> DataFrame:
    """(key, path, message): faults of the articles and versions of each payload, repeated keys included."""
    articles = payloads.select(key, F.posexplode("payload.articles").alias("k", "a"))
    at = F.concat(F.lit("articles["), F.col("k").cast("string"), F.lit("]"))
    need = lambda c, most: F.when((F.trim(F.coalesce(F.col(f"a.{c}"), F.lit(""))) == "") | (F.length(f"a.{c}") > most), F.struct(F.concat(at, F.lit(f".{c}")).alias("path"), F.lit(f"is required, {most} characters at most").alias("message")))
    checks = [need("id", 200), need("source_id", 100), need("original_url", 2000), need("published_at", 64)]
    checks.append(F.when(~is_http_url(F.col("a.original_url")), F.struct(F.concat(at, F.lit(".original_url")).alias("path"), F.lit("is not an http(s) address").alias("message"))))
    checks.append(F.when(F.coalesce(F.size("a.versions"), F.lit(0)) <= 0, F.struct(F.concat(at, F.lit(".versions")).alias("path"), F.lit("is empty").alias("message"))))
    checks.append(F.when(F.exists("a.versions", lambda v: ~F.coalesce(v["provenance"].isin(*PROVENANCES), F.lit(False))), F.struct(F.concat(at, F.lit(".versions")).alias("path"), F.lit("has an unknown provenance").alias("message"))))
    single = articles.select(key, F.explode(F.array_compact(F.array(*checks))).alias("i")).select(key, "i.path", "i.message")
    twice = articles.groupBy(key, F.col("a.source_id"), F.col("a.original_url")).agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("last")).where("n > 1")
    return single.union(twice.select(key, F.concat(F.lit("articles["), F.col("last").cast("string"), F.lit("]")), F.lit("repeats an article")))


def _greedy(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, chunk, used = None, 0, 0
        for rows in batches:
            numbers = []
            for name, size in zip(rows["source_id"], rows["size"], strict=True):
                if name != source:
                    source, chunk, used = name, 0, 0
                elif used + size > most:
                    chunk, used = chunk + 1, 0
                used += size
                numbers.append(chunk)
            yield pd.DataFrame({"source_id": rows["source_id"], "seq": rows["seq"], "chunk": numbers, "oversized": rows["size"] > most})

    return run


def payload_chunks(articles: DataFrame, most: int = 4 << 20) -> DataFrame:
    """(source_id, seq, chunk, oversized) for rows (source_id, seq, body): each source's rows in order, greedily.

    A chunk holds ``most`` bytes at most, separators included; a row that is larger by itself has a
    chunk of its own and is ``oversized``. Rows stream through in order, so a large source needs
    no memory; only sizes are shuffled.
    """
    sizes = articles.select(F.col("source_id").cast("string").alias("source_id"), F.col("seq").cast("long").alias("seq"), (F.octet_length("body") + 1).cast("long").alias("size"))
    return sizes.repartition("source_id").sortWithinPartitions("source_id", "seq").mapInPandas(_greedy(most), "source_id string, seq long, chunk long, oversized boolean")


def report_table(runs: DataFrame) -> DataFrame:
    """(source_id, line): each run as a line of a Markdown table."""
    cells = [T.escape_cell(F.col("source_id")), *[F.col(c).cast("string") for c in ("discovered", "pending", "processed", "failed")], F.col("status")]
    return runs.select("source_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def article_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", U.article_id(F.col("source_id"), F.col("original_url")))

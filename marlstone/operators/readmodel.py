"""Read model: lists, details, counts, related items and search over articles and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.core import let
from marlstone.functions.text import language_tag

# Languages of an official Chinese version, best first; others of simplified script follow.
ZH_PREFERENCE = ("zh-hans-cn", "zh-cn", "zh-hans", "zh-sg", "zh")

RELATED, HITS = 3, 30


def article_detail(articles: DataFrame, versions: DataFrame, article_id: str, language: str) -> DataFrame:
    """One article in one language; no row where there is none."""
    v = versions.where((F.col("article_id") == article_id) & (F.col("language") == language))
    return articles.where(F.col("id") == article_id).join(v, articles["id"] == v["article_id"]).drop("article_id")


def article_list(articles: DataFrame, versions: DataFrame, source_id: str, language: str) -> DataFrame:
    """One source's articles in one language, newest text date first, without bodies."""
    v = versions.where(F.col("language") == language).select("article_id", "title", "excerpt", "provenance")
    a = articles.where(F.col("source_id") == source_id).select("id", "published_at", "image_url", "author")
    return a.join(v, a["id"] == v["article_id"]).drop("article_id").orderBy(F.col("published_at").desc(), "id")


def version_counts(articles: DataFrame, versions: DataFrame, language: str) -> DataFrame:
    """(source_id, count) of articles that have a version in the language."""
    v = versions.where(F.col("language") == language).select("article_id")
    return articles.select("id", "source_id").join(v, F.col("id") == F.col("article_id")).groupBy("source_id").agg(F.count(F.lit(1)).alias("count"))


def with_counts(sources: DataFrame, counts: DataFrame) -> DataFrame:
    """Sources with their count, 0 without one, in the order of their names."""
    return sources.join(counts.withColumnRenamed("source_id", "id"), "id", "left").withColumn("count", F.coalesce("count", F.lit(0))).orderBy(F.collate("name", "UNICODE"))


def with_categories(articles: DataFrame, categories: DataFrame) -> DataFrame:
    """Articles with their sorted category names, an empty list without any."""
    lists = categories.groupBy("article_id").agg(F.sort_array(F.collect_set("category_name")).alias("categories")).withColumnRenamed("article_id", "id")
    return articles.join(lists, "id", "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))


def versions_of(versions: DataFrame, article_id: str) -> DataFrame:
    return versions.where(F.col("article_id") == article_id).orderBy("language")


def nested_versions(versions: DataFrame) -> DataFrame:
    """(article_id, versions): an article's versions as a list in the order of their languages."""
    fields = [c for c in versions.columns if c != "article_id"]
    rest = [c for c in fields if c != "language"]
    return versions.groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct("language", *rest))).alias("versions"))


def untranslated(articles: DataFrame, versions: DataFrame) -> DataFrame:
    """Articles that aren't Chinese and have no Chinese version."""
    zh = versions.where(F.col("language").isin("zh", "zh-cn")).select(F.col("article_id").alias("id")).distinct()
    return articles.where(~F.lower("original_language").startswith("zh")).join(zh, "id", "left_anti")


def with_original_title(versions: DataFrame, language: str = "zh-cn", original: str = "en") -> DataFrame:
    """Versions in one language with the title of the original one, if there is one."""
    en = versions.where(F.col("language") == original).select("article_id", F.col("title").alias("original_title"))
    return versions.where(F.col("language") == language).join(en, "article_id", "left")


def related(items: DataFrame, key: str = "id", group: tuple[str, ...] = ("source_id", "language"), date: str = "published_at", most: int = RELATED) -> DataFrame:
    """(key, place, related): the newest other items of each item's group.

    The newest ``most`` + 1 items of a group are found first, so that every item meets at most that
    many candidates, however large its group is.
    """
    newest = Window.partitionBy(*group).orderBy(F.col(date).desc(), F.col(key))
    top = items.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most + 1).select(*group, F.col(key).alias("related"), "_n")
    pairs = items.select(*group, key).join(top, list(group)).where(F.col(key) != F.col("related"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_n"))
    return pairs.withColumn("place", place.cast("int")).where(F.col("place") <= most).select(key, "place", "related")


def search_items(blogs: DataFrame, articles: DataFrame) -> DataFrame:
    """Blogs and articles in one table of title, subtitle, url, date, categories."""
    return blogs.withColumn("kind", F.lit("blog")).unionByName(articles.withColumn("kind", F.lit("article")), allowMissingColumns=True)


def matches(query: Column, *texts: Column) -> Column:
    """Case-folded containment in the texts joined by blanks; an empty query matches all."""
    return F.lower(F.concat_ws(" ", *texts)).contains(F.lower(query))


def hits_by_path(hits: DataFrame, items: DataFrame, most: int = HITS) -> DataFrame:
    """The best hits (path, score) that are items, by path without trailing slashes."""
    bare = lambda c: F.regexp_replace(c, r"(?<=.)/+$", "")
    h = hits.withColumn("_p", bare(F.col("path"))).groupBy("_p").agg(F.max("score").alias("score"))
    i = items.withColumn("_p", bare(F.col("url")))
    return i.join(h, "_p").drop("_p").orderBy(F.col("score").desc(), "url").limit(most)


def official_chinese(alternates: Column) -> Column:
    """The best of an array of (language, url): by preference, else any simplified one; never traditional.

    Languages are compared, and given back, in lower case with hyphens.
    """
    named = F.transform(alternates, lambda a: F.struct(language_tag(a["language"]).alias("language"), a["url"].alias("url")))

    def choose(some: Column) -> Column:
        first = lambda fits: F.get(F.filter(some, lambda a: fits(a["language"])), F.lit(0))
        ranked = [first(lambda tag, want=want: tag == want) for want in ZH_PREFERENCE]
        return F.coalesce(*ranked, first(lambda tag: tag.startswith("zh-hans-")))

    return let(named, choose)


def health(articles: DataFrame, items: DataFrame) -> DataFrame:
    """(articles, published): global counts."""
    both = articles.select(F.lit(1).alias("a"), F.lit(0).alias("p")).union(items.select(F.lit(0), (F.col("status") == "published").cast("int")))
    return both.agg(F.sum("a").alias("articles"), F.sum("p").alias("published"))


def featured(items: DataFrame, group: str, date: str, key: str) -> DataFrame:
    """Items with their place in the group, newest first; the first is featured."""
    w = Window.partitionBy(group).orderBy(F.col(date).desc(), F.col(key))
    return items.withColumn("place", F.row_number().over(w)).withColumn("featured", F.col("place") == 1)

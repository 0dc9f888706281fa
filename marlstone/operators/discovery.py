"""Discovery of article addresses in feeds, sitemaps, listings and JSON lists.

Documents come as rows with their text; parsing is regular expressions over whole texts and an
``explode``, so it runs where the rows are. Every found item has ``seq``, its place in its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import urls as U
from marlstone.functions.dates import api_published_at, sort_instant

# The paths' order of trust.
PATH_RANK = {"api": 0, "rss": 1, "sitemap": 2, "listing": 3}

CHILD_SITEMAPS, PER_RUN = 10, 3
#: Parts of a source that are sorted apart.
PARTS = 32


def first_per_key(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in a stated order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def parse_feeds(feeds: DataFrame) -> DataFrame:
    """Rows (source_id, url, body) to (source_id, url, title, published_at, seq): RSS items, then Atom entries.

    The link is an Atom ``href``, or else the text of link or guid; of several items with one
    address the first counts.
    """
    blocks = F.concat(F.regexp_extract_all("body", F.lit(r"(?i)<item\b[\s\S]*?</item>"), F.lit(0)), F.regexp_extract_all("body", F.lit(r"(?i)<entry\b[\s\S]*?</entry>"), F.lit(0)))
    items = feeds.select("source_id", F.col("url").alias("_base"), F.posexplode(blocks).alias("seq", "_block"))
    href = F.nullif(F.regexp_extract("_block", r"(?i)<link\b[^>]*\bhref=[\"']([^\"']+)[\"'][^>]*>", 1), F.lit(""))
    link = T.decode_entities(F.coalesce(href, T.first_tag(F.col("_block"), "link", "guid")))
    found = items.select(
        "source_id",
        U.canonicalize_url(link, F.col("_base")).alias("url"),
        T.strip_tags(F.coalesce(T.first_tag(F.col("_block"), "title"), F.lit(""))).alias("title"),
        T.first_tag(F.col("_block"), "published", "pubDate", "updated", "dc:date").alias("published_at"),
        "seq",
    )
    return first_per_key(found.where("url is not null"), ["source_id", "url"], "seq")


def parse_sitemaps(maps: DataFrame) -> DataFrame:
    """Rows (source_id, url, body) to (source_id, map_url, url, published_at, child, seq); ``child``: of an index."""
    index = F.col("body").rlike(r"(?i)<sitemapindex\b")
    blocks = F.when(index, F.regexp_extract_all("body", F.lit(r"(?i)<sitemap\b[\s\S]*?</sitemap>"), F.lit(0))).otherwise(F.regexp_extract_all("body", F.lit(r"(?i)<url\b[\s\S]*?</url>"), F.lit(0)))
    items = maps.select("source_id", F.col("url").alias("map_url"), index.alias("child"), F.posexplode(blocks).alias("seq", "_block"))
    block = F.col("_block")
    found = items.select("source_id", "map_url", U.canonicalize_url(T.first_tag(block, "loc"), F.col("map_url")).alias("url"), T.first_tag(block, "lastmod").alias("published_at"), "child", "seq")
    return found.where("url is not null")


def expand_sitemaps(entries: DataFrame, children: DataFrame, include: Column | None = None, most: int = CHILD_SITEMAPS) -> DataFrame:
    """Direct entries and those of an index's children (source_id, url, body), each address once.

    ``include``: folders of the children to follow, all if null, none if empty. At most ``most`` children of a
    source are followed, in order; a child that isn't there is left out. The cap is the feature: it
    bounds what one source may ask for. Where no child is followed the entries stay as they are.
    """
    followed = entries.where("child")
    if include is not None:
        bare = lambda c: F.regexp_replace(c, r"/+$", "")
        path = bare(U.path_of(F.col("url")))
        followed = followed.where(include.isNull() | F.exists(include, lambda p: (path == bare(p)) | path.startswith(F.concat(bare(p), F.lit("/")))))
    turn = F.row_number().over(Window.partitionBy("source_id").orderBy("map_url", "seq"))
    followed = followed.withColumn("_n", turn).where(F.col("_n") <= most).select("source_id", "url", F.col("_n"))
    nested = parse_sitemaps(children.join(followed.select("source_id", "url"), ["source_id", "url"], "left_semi")).where("not child")
    nested = nested.join(followed.withColumnRenamed("url", "map_url"), ["source_id", "map_url"])
    lone = entries.join(followed.select("source_id").distinct(), "source_id", "left_anti").where("child")
    every = entries.where("not child").unionByName(lone).select("source_id", "url", "published_at", F.lit(0).alias("_n"), "seq").union(nested.select("source_id", "url", "published_at", "_n", "seq"))
    return first_per_key(every, ["source_id", "url"], "_n", "seq").drop("_n")


def parse_listings(pages: DataFrame) -> DataFrame:
    """Rows (source_id, url, body, domain) to (source_id, url, title, seq): links that can be articles."""
    links = F.transform(
        F.regexp_extract_all("body", F.lit(r"(?i)<a\b[^>]*?\bhref=[\"'][^\"'#]+[\"'][^>]*>[\s\S]*?</a>"), F.lit(0)),
        lambda a: F.struct(F.regexp_extract(a, r"(?i)<a\b[^>]*?\bhref=[\"']([^\"'#]+)[\"']", 1).alias("href"), F.regexp_extract(a, r"(?i)^<a\b[^>]*>([\s\S]*?)</a>$", 1).alias("inner")),
    )
    items = pages.select("source_id", F.col("url").alias("_base"), "domain", F.posexplode(links).alias("seq", "_a"))
    found = items.select("source_id", "domain", U.canonicalize_url(F.col("_a.href"), F.col("_base")).alias("url"), T.strip_tags(F.col("_a.inner")).alias("title"), "seq")
    return first_per_key(found.where(F.col("url").isNotNull() & U.is_likely_article(F.col("url"), F.col("domain"))), ["source_id", "url"], "seq").drop("domain")


def parse_json_lists(replies: DataFrame, list_path: str, template: str | None = None) -> DataFrame:
    """Rows (source_id, body) to (source_id, url, title, published_at, seq) by a path to the list and an address template.

    Items need an id. The slug is customUrl, or else slug, and the id where that is empty; the date
    publishedAt, publishTime or date. Without a template an item's own ``url`` counts.
    """
    fields = "array<struct<id:string,url:string,customUrl:string,slug:string,title:string,publishedAt:string,publishTime:string,date:string>>"
    listed = F.from_json(F.get_json_object("body", f"$.{list_path}"), fields)
    items = replies.select("source_id", F.posexplode(listed).alias("seq", "_i")).where("_i.id is not null and _i.id <> ''")
    slug = F.coalesce(F.nullif(F.trim(F.coalesce("_i.customUrl", "_i.slug")), F.lit("")), F.col("_i.id"))
    url = U.fill_template(F.lit(template), id=U.encode_part(F.col("_i.id")), slug=U.encode_part(slug)) if template else F.col("_i.url")
    found = items.select("source_id", U.canonicalize_url(url).alias("url"), F.coalesce(F.col("_i.title"), F.lit("")).alias("title"), api_published_at(F.coalesce("_i.publishedAt", "_i.publishTime", "_i.date")).alias("published_at"), "seq")
    return first_per_key(found.where("url is not null"), ["source_id", "url"], "seq")


def union_paths(**paths: DataFrame) -> DataFrame:
    """Items of several paths with ``path`` and ``rank``; missing columns are null."""
    out = None
    for name, items in paths.items():
        tagged = items.withColumn("path", F.lit(name)).withColumn("rank", F.lit(PATH_RANK[name]))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def fallback(items: DataFrame, candidate: Column) -> DataFrame:
    """Each source's candidates of the first path that has any."""
    some = items.where(candidate)
    best = some.groupBy("source_id").agg(F.min("rank").alias("rank"))
    return some.join(best, ["source_id", "rank"])


def merged(items: DataFrame) -> DataFrame:
    """All paths' items, an address once for each source: the more trusted path's, then the earlier."""
    return first_per_key(items, ["source_id", "url"], "rank", "seq")


def path_counts(items: DataFrame, candidate: Column) -> DataFrame:
    """Raw and candidate items of each source and path."""
    return items.groupBy("source_id", "path").agg(F.count(F.lit(1)).alias("raw"), F.count_if(candidate).alias("candidates"))


def unseen(items: DataFrame, seen: DataFrame) -> DataFrame:
    return items.join(seen.select("source_id", "url"), ["source_id", "url"], "left_anti")


def newest(items: DataFrame, limit: Column) -> DataFrame:
    """The newest items of each source, as many as ``limit`` says (0: all); undated ones are the oldest.

    Parts of a source are cut to the limit first, each in a task of its own: a large source is sorted
    whole only where all of it is asked for.
    """
    order = [sort_instant(F.col("published_at")).desc(), F.col("seq")]
    turn = lambda *part: F.row_number().over(Window.partitionBy("source_id", *part).orderBy(*order))
    capped = items.withColumn("_limit", limit).withColumn("_part", F.pmod(F.xxhash64("seq"), F.lit(PARTS)))
    capped = capped.withColumn("_n", turn("_part")).where("_limit = 0 or _n <= _limit").drop("_n", "_part")
    return capped.withColumn("place", turn()).where("_limit = 0 or place <= _limit").drop("_limit")


def run_limit(cli: Column | None = None, source: Column | None = None) -> Column:
    """The command line's limit, else the source's, else the default."""
    return F.coalesce(*[c for c in (cli, source) if c is not None], F.lit(PER_RUN))


def policy_passes(mode: Column, since: Column, published_at: Column, url: Column | None = None, url_pattern: Column | None = None) -> Column:
    """Backfill policy: ``all`` passes; ``since`` asks for a date from then on, from the address if there is no other.

    No date fails, one that doesn't parse passes.
    """
    from marlstone.functions.dates import parse_instant, url_date

    date = F.coalesce(published_at, url_date(url, url_pattern)) if url is not None and url_pattern is not None else published_at
    at, limit = parse_instant(date), parse_instant(since)
    return F.when((mode == "all") | since.isNull(), F.lit(True)).when(date.isNull(), F.lit(False)).when(at.isNull() | limit.isNull(), F.lit(True)).otherwise(at >= limit)


def meta_refresh(html: Column, base: Column) -> Column:
    """Where an immediate refresh leads; null if there is none, it waits, or it leads to the page itself."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh"))
    wanted = r"(?i)content\s*=\s*[\"']?\s*0+\s*;\s*url\s*=\s*[\"']?([^\"'>]+)"
    targets = F.transform(tags, lambda t: F.trim(F.regexp_extract(t, wanted, 1)))
    urls = F.transform(F.filter(targets, lambda t: t != ""), lambda t: U.resolve_url(t, base))
    return F.get(F.filter(urls, lambda u: u.isNotNull() & (u != base)), F.lit(0))

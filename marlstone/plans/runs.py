"""Queries for whole runs, sync payloads and the small checks around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import dates as D
from marlstone.functions import guards as G
from marlstone.functions import urls as U
from marlstone.operators import runs, translate
from marlstone.plans.registry import query
from marlstone.plans.scalars import CANONICAL, _HOST_OF, _SLUG
from marlstone.session import table

_DATE = "printf('2024-%02d-%02d', doc_id % 12 + 1, doc_id % 28 + 1)"
_BODY = "coalesce(text, '')"
_BARE = f"regexp_replace({_BODY}, '```[\\s\\S]*?```', ' ', 'g')"
_WS = "[\\s\\x{00a0}\\x{3000}\\x{feff}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}]"
_PLAIN = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_BARE}, '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[#>*_`~|\\-]', ' ', 'g'), '{_WS}+', ' ', 'g'))"


def _codes(date_missing: str) -> str:
    """The gate's blocking codes of a document's text, as a list in DuckDB."""
    links = f"len(regexp_extract_all({_BARE}, '\\[[^\\]]*\\]\\(https?://[^)\\s]+\\)'))"
    single = [
        f"CASE WHEN length({_PLAIN}) < 200 THEN 'content-too-short' END",
        f"CASE WHEN {date_missing} THEN 'missing-published-date' END",
        f"CASE WHEN length({_PLAIN}) < 200 AND {links} >= 3 THEN 'looks-like-navigation-list' END",
        f"CASE WHEN regexp_matches({_BARE}, '(?i)lorem ipsum') THEN 'lorem-ipsum' END",
        f"CASE WHEN regexp_matches({_BARE}, '\\[[^\\]]*\\]\\(\\s*\\)') THEN 'empty-link' END",
        f"CASE WHEN regexp_matches({_BARE}, '!\\[[^\\]]*\\]\\(\\s*\\)') THEN 'empty-image' END",
    ]
    images = f"list_transform(list_filter(regexp_extract_all({_BARE}, '!\\[[^\\]]*\\]\\(([^)\\s]+)(?:\\s+\"[^\"]*\")?\\)', 1), lambda u: NOT regexp_matches(u, '^(?i)(https?:|data:|blob:)')), lambda u: 'image-url-not-absolute')"
    return f"list_concat(list_filter([{', '.join(single)}], lambda c: c IS NOT NULL), {images})"


def _date(c="doc_id"):
    return F.format_string("2024-%02d-%02d", F.col(c) % 12 + 1, F.col(c) % 28 + 1)


_URL = "'https://x.com/' || doc_id"


def _docs(spark, d):
    return table(spark, d, "documents").withColumn("url", F.concat(F.lit("https://x.com/"), F.col("doc_id").cast("string")))


_UPDATE = f"""
WITH i AS (SELECT source, doc_id, {_URL} AS url, doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AS seen, {_codes('doc_id % 11 = 0')} AS codes, {_DATE} AS day FROM documents),
p AS (SELECT *, CASE WHEN NOT seen THEN row_number() OVER (PARTITION BY source, seen ORDER BY day DESC, doc_id) END AS place FROM i),
x AS (SELECT *, CASE WHEN seen THEN 'seen' WHEN place > 30 THEN 'over-limit' WHEN doc_id % 19 = 0 OR doc_id % 17 = 0 THEN 'fetch-failed' WHEN len(codes) > 0 THEN 'rejected' WHEN doc_id % 13 <> 0 AND doc_id % 7 <> 0 THEN 'published' ELSE 'saved' END AS disposition FROM p),
u AS (SELECT source AS source_id, url, CAST(CASE WHEN place <= 30 THEN place END AS INT) AS place, disposition,
 CASE disposition WHEN 'rejected' THEN 'integrity' WHEN 'fetch-failed' THEN 'fatal' WHEN 'saved' THEN 'fatal' END AS error_kind,
 CASE WHEN disposition = 'rejected' THEN array_to_string(codes, ', ') END AS error_code,
 CASE disposition WHEN 'rejected' THEN 'integrity gate: ' || array_to_string(codes, ', ') WHEN 'fetch-failed' THEN CASE WHEN doc_id % 19 = 0 THEN 'no page' ELSE 'HTTP 500' END WHEN 'saved' THEN CASE WHEN doc_id % 13 = 0 THEN 'no translation' ELSE 'bad' END END AS error,
 disposition IN ('rejected', 'saved', 'published') AS marked FROM x)"""


def _update(spark, d):
    docs = _docs(spark, d)
    i = F.col("doc_id")
    sources = docs.select(F.col("source").alias("id")).distinct().withColumn("limit", F.lit(30)).withColumn("min_content_chars", F.lit(None).cast("int"))
    discovered = docs.select(F.col("source").alias("source_id"), "url", _date().alias("published_at"), i.alias("seq"))
    seen = docs.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("source").alias("source_id"), "url")
    fetched = docs.where(i % 19 != 0).select(F.col("source").alias("source_id"), "url", F.lit("t").alias("title"), F.col("text").alias("content_markdown"), F.when(i % 11 != 0, _date()).alias("published_at"), F.when(i % 17 == 0, "HTTP 500").alias("error"))
    translated = docs.where(i % 13 != 0).select(F.col("source").alias("source_id"), "url", F.when(i % 7 == 0, "bad").alias("error"))
    return runs.run_update(sources, discovered, seen, fetched, translated)


@query("update_items", f"{_UPDATE} SELECT * FROM u")
def update_items(spark, d):
    return _update(spark, d)


@query("update_summary", f"{_UPDATE} SELECT source_id, count(*) AS discovered, count(*) FILTER (disposition <> 'seen') AS pending, count(*) FILTER (disposition = 'published') AS processed, count(*) FILTER (error IS NOT NULL) AS failed, CASE WHEN count(*) FILTER (error IS NOT NULL) > 0 THEN 'partial' ELSE 'completed' END AS status FROM u GROUP BY 1")
def update_summary(spark, d):
    return runs.update_summary(_update(spark, d))


_MATH, _ROWS, _IMAGE = "'\\$\\$[\\s\\S]*?\\$\\$|\\$[^$\\n]+\\$'", "'(?m)^\\s*\\|[^\\n]+\\|\\s*$'", "'!\\[[^\\]]*\\]\\([^)]*\\)'"
# a source's own policy, one of the table, or none
_BACKFILL = f"""
WITH s AS (SELECT *, coalesce(TRY_CAST(substring(source, 4) AS INT), 0) % 3 AS kind, CASE WHEN doc_id % 10 <> 0 THEN {_DATE} END AS found, CASE WHEN doc_id % 8 = 0 THEN '2023-01-01' ELSE {_DATE} END AS page_day FROM documents),
f AS (SELECT *, kind <> 1 OR coalesce(found >= '2024-06-15', FALSE) AS fits, {_codes('FALSE')} AS codes FROM s),
p AS (SELECT *, CASE WHEN fits THEN row_number() OVER (PARTITION BY source, fits ORDER BY coalesce(found, '1970-01-01') DESC, doc_id) END AS place FROM f),
x AS (SELECT *, CASE WHEN NOT fits THEN 'skipped-by-date' WHEN kind = 0 AND place > 25 THEN 'truncated' WHEN doc_id % 17 = 0 THEN 'fetch-failed' WHEN kind = 1 AND page_day < '2024-06-15' THEN 'outside-window' WHEN len(codes) > 0 THEN 'rejected' ELSE 'saved' END AS disposition FROM p),
b AS (SELECT source AS source_id, {_URL} AS url, CAST(CASE WHEN kind <> 0 OR place <= 25 THEN place END AS INT) AS place, disposition, CASE disposition WHEN 'outside-window' THEN 'outside-backfill-window' WHEN 'rejected' THEN array_to_string(codes, ', ') END AS error_code,
 CASE disposition WHEN 'fetch-failed' THEN 'HTTP 404' WHEN 'outside-window' THEN 'outside-backfill-window' WHEN 'rejected' THEN array_to_string(codes, ', ') END AS error, CASE WHEN disposition = 'saved' THEN page_day END AS published_at,
 disposition = 'saved' AND len(regexp_extract_all({_BODY}, {_MATH})) > 0 AS math, disposition = 'saved' AND len(regexp_extract_all({_BODY}, {_ROWS})) > 0 AS tables, disposition = 'saved' AND len(regexp_extract_all({_BODY}, {_IMAGE})) > 0 AS images FROM x),
c AS (SELECT source_id, count(*) AS discovered, count(*) FILTER (disposition <> 'skipped-by-date') AS eligible, count(*) FILTER (disposition = 'skipped-by-date') AS skipped_by_date, count(*) FILTER (disposition = 'truncated') AS truncated_by_max, count(*) FILTER (disposition = 'saved') AS saved, count(*) FILTER (error IS NOT NULL) AS failed, min(published_at) AS earliest, max(published_at) AS latest, count(*) FILTER (math) AS math, count(*) FILTER (tables) AS tables, count(*) FILTER (images) AS images FROM b GROUP BY 1)"""


def _policies(spark, d):
    sources = table(spark, d, "documents").select(F.col("source").alias("id")).distinct().withColumn("kind", F.coalesce(F.expr("try_cast(substring(id, 4) as int)"), F.lit(0)) % 3)
    none = F.lit(None).cast("string")
    own = F.when(F.col("kind") == 0, F.struct(none.alias("mode"), none.alias("since"), F.lit(25).alias("max_articles"), F.lit(None).cast("boolean").alias("quality_filter")))
    listed = sources.where("kind < 2").select(F.col("id").alias("source_id"), F.lit("since").alias("mode"), F.lit("2024-06-15").alias("since"), F.lit(0).alias("max_articles"), F.lit(False).alias("quality_filter"), none.alias("url_date_pattern"))
    return runs.with_policy(sources.withColumn("backfill", own).withColumn("url_date_pattern", none), listed)


def _backfill(spark, d):
    docs, i = _docs(spark, d), F.col("doc_id")
    discovered = docs.select(F.col("source").alias("source_id"), "url", F.when(i % 10 != 0, _date()).alias("published_at"), i.alias("seq"))
    fetched = docs.select(F.col("source").alias("source_id"), "url", F.lit("t").alias("title"), F.col("text").alias("content_markdown"), F.when(i % 8 == 0, "2023-01-01").otherwise(_date()).alias("published_at"), F.when(i % 17 == 0, "HTTP 404").alias("error"))
    return runs.run_backfill(_policies(spark, d), discovered, fetched)


@query("source_policy", "SELECT DISTINCT source AS id, CASE coalesce(TRY_CAST(substring(source, 4) AS INT), 0) % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'since' END AS mode, CASE WHEN coalesce(TRY_CAST(substring(source, 4) AS INT), 0) % 3 = 1 THEN '2024-06-15' END AS since, CASE coalesce(TRY_CAST(substring(source, 4) AS INT), 0) % 3 WHEN 0 THEN 25 WHEN 1 THEN 0 END AS max_articles FROM documents")
def source_policy(spark, d):
    return _policies(spark, d).select("id", "policy.mode", "policy.since", "policy.max_articles")


@query("backfill_items", f"{_BACKFILL} SELECT source_id, url, place, disposition, error_code, error, published_at FROM b")
def backfill_items(spark, d):
    return _backfill(spark, d).drop("stats")


@query("backfill_counters", f"{_BACKFILL} SELECT * FROM c")
def backfill_counters(spark, d):
    return runs.backfill_counters(_backfill(spark, d))


_CELLS = " || ' | ' || ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in ("discovered", "eligible", "skipped_by_date", "truncated_by_max", "saved", "failed", "earliest", "latest", "math", "tables", "images"))


@query("backfill_report", f"{_BACKFILL} SELECT source_id, '| ' || replace(source_id, '|', '\\|') || ' | ' || {_CELLS} || ' |' AS line FROM c UNION ALL SELECT NULL, '| **total** | **' || sum(discovered) || '** | **' || sum(eligible) || '** |  |  | **' || sum(saved) || '** | **' || sum(failed) || '** |  |  |  |  |  |' FROM c")
def backfill_report(spark, d):
    return runs.backfill_report(runs.backfill_counters(_backfill(spark, d)))


@query("backfill_errors", f"{_BACKFILL} SELECT source_id, url, '- **' || CASE WHEN disposition = 'fetch-failed' THEN 'fatal' ELSE 'integrity' END || '**' || coalesce(' [' || error_code || ']', '') || ' `' || url || '`' || chr(10) || '  - ' || error AS line FROM b WHERE error IS NOT NULL")
def backfill_errors(spark, d):
    return runs.error_lines(_backfill(spark, d))


@query("backfill_manifest", f"{_BACKFILL} SELECT source_id, place, '{{\"source_id\":\"' || source_id || '\",\"place\":' || place || ',\"url\":\"' || url || '\",\"disposition\":\"' || disposition || '\"' || coalesce(',\"error_code\":\"' || error_code || '\"', '') || coalesce(',\"published_at\":\"' || published_at || '\"', '') || '}}' AS value FROM b WHERE disposition NOT IN ('skipped-by-date', 'truncated')")
def backfill_manifest(spark, d):
    return runs.manifests(_backfill(spark, d))


@query("outside_window", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) < DATE '1995-06-01' WHEN 1 THEN CAST(o_orderdate AS DATE) < DATE '1995-06-01' ELSE FALSE END AS outside FROM orders")
def outside_window(spark, d):
    k, day = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    url = F.when(k == 1, F.concat(F.lit("https://x.com/"), F.date_format("o_orderdate", "yyyy/MMM/d"), F.lit("/a"))).otherwise(F.lit("https://x.com/a"))
    page = F.when(k == 0, day).when(k == 1, "2030-01-01").when(k == 2, "soon")
    return table(spark, d, "orders").select("o_orderkey", runs.outside_window(F.lit("1995-06-01"), page, url, F.lit(r"/(\d{4})/([A-Z][a-z]{2})/(\d{1,2})/")).alias("outside"))


@query("page_date_order", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN 'extracted' WHEN 2 THEN 'found' WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00.000Z' WHEN 4 THEN '2001-02-03' ELSE '' END AS found_at FROM orders")
def page_date_order(spark, d):
    k = F.col("o_orderkey") % 6
    url = F.when(k == 0, F.concat(F.lit("https://x.com/"), F.date_format("o_orderdate", "yyyy/MMM/d"), F.lit("/a"))).otherwise(F.lit("https://x.com/a"))
    text = F.when(k == 3, F.concat(F.lit("By me "), F.date_format("o_orderdate", "MMMM d, yyyy"))).otherwise("no date")
    at = G.page_date(url, F.lit(r"/(\d{4})/([A-Z][a-z]{2})/(\d{1,2})/"), F.when(k <= 1, "extracted"), F.when(k <= 2, " found "), text, F.when(k <= 4, "2001-02-03"))
    return table(spark, d, "orders").select("o_orderkey", at.alias("found_at"))


@query("official_version", "SELECT page_id, CASE WHEN page_id % 5 = 1 THEN 'https://x.com/zh' ELSE 'https://x.com/en' END AS url, CASE WHEN page_id % 5 IN (0, 1) THEN 'zh' ELSE 'en' END AS language, CASE WHEN page_id % 5 = 1 THEN 'https://x.com/en' END AS official_zh_url, CASE page_id % 5 WHEN 0 THEN 'native-zh' WHEN 1 THEN 'official-zh' END AS content_source FROM pages")
def official_version(spark, d):
    k = F.col("page_id") % 5  # native, official, not wanted, another language, no page
    items = table(spark, d, "pages").select("page_id", F.lit("https://x.com/en").alias("original_url"), F.when(k == 0, "zh").otherwise("en").alias("original_language"), F.when(k < 4, "https://x.com/zh").alias("zh_url"), F.when(k < 3, "zh").when(k == 3, "en").alias("zh_language"), (k != 2).alias("prefer"))
    return runs.official_version(items).select("page_id", "url", "language", "official_zh_url", "content_source")


def _received(spark, d):
    i = F.col("doc_id")
    return _docs(spark, d).select(F.col("source").alias("source_id"), F.col("url").alias("original_url"), F.sequence(F.lit(0), (i % 3).cast("int")).alias("versions"), F.when(i % 4 != 0, F.slice(F.array(F.lit("AI"), F.lit("Other")), F.lit(1), (i % 3).cast("int"))).alias("categories"))


def _stored(spark, d):
    return _docs(spark, d).join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("source").alias("source_id"), F.col("url").alias("original_url"))


@query("sync_created", f"SELECT source AS source_id, {_URL} AS original_url, doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AS created FROM documents")
def sync_created(spark, d):
    return runs.sync_state(_received(spark, d), _stored(spark, d)).select("source_id", "original_url", "created")


@query("sync_result", """
WITH r AS (SELECT count(*) AS received, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)) AS created, sum(2 + doc_id % 3 + CASE WHEN doc_id % 4 <> 0 THEN 1 + 2 * least(2, doc_id % 3) ELSE 0 END) + (SELECT count(DISTINCT source) FROM documents) AS statements FROM documents)
SELECT TRUE AS ok, received, created, received - created AS updated, CAST(statements AS BIGINT) AS statements, CAST(ceil(statements / 100) AS BIGINT) AS batches, CAST(0 AS BIGINT) AS missing FROM r""")
def sync_result(spark, d):
    sources = table(spark, d, "documents").select(F.col("source").alias("id")).distinct()
    return runs.run_sync(_received(spark, d), sources, _stored(spark, d), sources.limit(0))


@query("sync_refused", "SELECT FALSE AS ok, count(*) AS received, CAST(0 AS BIGINT) AS created, CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS statements, CAST(0 AS BIGINT) AS batches, count(DISTINCT source) FILTER (source IN ('src3', 'src4')) AS missing FROM documents")
def sync_refused(spark, d):
    sources = table(spark, d, "documents").select(F.col("source").alias("id")).distinct()
    known = sources.where("id not in ('src3', 'src4')")  # what this payload and store have is the case in question
    return runs.run_sync(_received(spark, d), known, _stored(spark, d), known.limit(0))


@query("missing_sources", "SELECT DISTINCT source AS id FROM documents WHERE source NOT IN (SELECT 'src' || s_suppkey FROM supplier)")
def missing_sources(spark, d):
    some = table(spark, d, "supplier").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("id"))
    return runs.missing_sources(_received(spark, d), some, some.limit(0))


@query("unknown_targets", "SELECT DISTINCT 'src' || s_suppkey AS id FROM supplier WHERE 'src' || s_suppkey NOT IN (SELECT source FROM documents)")
def unknown_targets(spark, d):
    targets = table(spark, d, "supplier").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("id"))
    return runs.unknown_targets(targets, table(spark, d, "documents").select(F.col("source").alias("id")))


@query("type_split", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'personal' ELSE 'company' END AS part FROM supplier")
def type_split(spark, d):
    sources = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "personal").otherwise("company").alias("type"))
    company, personal = runs.by_type(sources)
    return company.select("id", F.lit("company").alias("part")).union(personal.select("id", F.lit("personal")))


_IDS = f"SELECT page_id, c, regexp_replace({_HOST_OF}, '[^a-z0-9]+', '-', 'g') || '/' || {_SLUG} AS base FROM (SELECT page_id, {CANONICAL} AS c FROM pages)"


@query("unique_slugs", f"""
WITH i AS ({_IDS}), f AS (SELECT c AS url, base, min(page_id) AS seq FROM i GROUP BY 1, 2),
o AS (SELECT *, base IN (SELECT base FROM i JOIN pages USING (page_id) WHERE starts_with(url, 'http:')) AS taken FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY seq, url) + CASE WHEN taken THEN 1 ELSE 0 END AS k FROM o)
SELECT url, seq, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS id, TRUE AS created FROM n""")
def unique_slugs(spark, d):
    url = U.canonicalize_url(F.col("url"))
    pages = table(spark, d, "pages")
    articles = pages.select(url.alias("url"), F.col("page_id").alias("seq")).withColumn("source_id", U.host_of(F.col("url")))
    plain = pages.where(F.col("url").startswith("http:")).select(url.alias("url")).withColumn("source_id", U.host_of(F.col("url")))
    taken = plain.select(U.article_id(F.col("source_id"), F.col("url")).alias("id"), F.lit("https://elsewhere.org/").alias("url")).distinct()
    return runs.unique_slugs(articles, taken).select("url", "seq", "id", "created")


@query("payload_sources", "SELECT s_suppkey AS id, '{\"id\":' || s_suppkey || ',\"name\":\"' || s_name || '\",\"type\":\"company\",\"homepageUrl\":\"h\",\"blogUrl\":\"b\",\"domain\":\"d\"' || CASE WHEN s_suppkey % 2 = 0 THEN ',\"rssUrl\":\"r\"' ELSE '' END || '}' AS value FROM supplier")
def payload_sources(spark, d):
    one = F.lit("")
    registry = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("company").alias("type"), F.lit("h").alias("homepage_url"), F.lit("b").alias("blog_url"), F.lit("d").alias("domain"), F.when(F.col("s_suppkey") % 2 == 0, "r").otherwise(one).alias("rss_url"), one.alias("sitemap_url"))
    return runs.payload_sources(registry)


@query("payload_articles", "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 5 <> 0 THEN '{\"id\":\"' || doc_id || '\",\"sourceId\":\"' || source || '\",\"originalUrl\":\"https://x.com/' || doc_id || '\",\"originalLanguage\":\"en\",\"publishedAt\":\"2024-05-06T00:00:00.000Z\",\"sourceDomain\":\"x.com\",\"categories\":[\"AI\",\"' || lang || '\"],\"versions\":[{\"language\":\"en\",\"title\":\"t\",\"contentMarkdown\":\"n ' || n_chars || '\",\"provenance\":\"original\",\"updatedAt\":\"2024-05-07\"},{\"language\":\"zh-cn\",\"title\":\"t\",\"contentMarkdown\":\"n ' || n_chars || '\",\"provenance\":\"model\",\"updatedAt\":\"2024-05-07\"}]}' END AS value, CASE WHEN doc_id % 5 = 0 THEN 'missing: originalUrl, publishedAt' END AS error FROM documents")
def payload_articles(spark, d):
    docs, i = table(spark, d, "documents"), F.col("doc_id")
    none = F.lit(None).cast("string")
    both = docs.select(
        i.cast("string").alias("article_id"), F.explode(F.array(F.lit("zh-cn"), F.lit("en"))).alias("language"), F.col("source").alias("blog_id"), F.when(i % 5 != 0, F.concat(F.lit("https://x.com/"), i.cast("string"))).alias("original_url"), none.alias("original_language"),
        F.when(i % 5 != 0, "2024-05-06").otherwise("soon").alias("published_at"), F.lit("").alias("image_url"), none.alias("author"), F.lit("x.com").alias("source_domain"), F.lit("t").alias("title"), F.concat(F.lit("n "), F.col("n_chars").cast("string")).alias("content_markdown"), F.lit("2024-05-07").alias("version_at"), "lang")
    versions = both.withColumn("provenance", F.when(F.col("language") == "en", "original").otherwise("model")).withColumn("categories", F.when(F.col("language") == "en", F.array(F.lit("AI"))).otherwise(F.array(F.lit("AI"), F.col("lang"))))
    return runs.payload_articles(versions)


@query("failure_report", "SELECT o_orderkey, '{\"version\":1,\"createdAt\":\"2024\",\"fatalError\":{\"message\":\"' || o_orderpriority || '\",\"stack\":\"at x\"}}' AS report FROM orders")
def failure_report(spark, d):
    return table(spark, d, "orders").select("o_orderkey", runs.failure_report(F.lit("2024"), F.col("o_orderpriority"), F.lit("at x")).alias("report"))


@query("absolute_markdown", "SELECT doc_id, coalesce(text, '') || ' ![a](https://x.com/blog/post/i' || doc_id || '.png) [b](https://x.com/r/' || doc_id || ') [c](https://y.org/z \"kept\") ![d](data:abc) [e](javascript:f) [g](#h) [m](mailto:a@b.c) end' AS md FROM documents")
def absolute_markdown(spark, d):
    i = F.col("doc_id").cast("string")
    md = F.concat(F.coalesce("text", F.lit("")), F.lit(" ![a](i"), i, F.lit('.png "title") [b](/r/'), i, F.lit(') [c](https://y.org/z "kept") ![d](data:abc) [e](javascript:f) [g](#h) [m](mailto:a@b.c) end'))
    return table(spark, d, "documents").select("doc_id", G.absolute_markdown(md, F.lit("https://x.com/blog/post")).alias("md"))


@query("extracted_too_short", "SELECT doc_id, CASE WHEN n < 200 THEN 'extracted content too short (' || n || ' chars, minimum 200)' END AS error FROM (SELECT doc_id, length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS n FROM documents)")
def extracted_too_short(spark, d):
    return table(spark, d, "documents").select("doc_id", G.too_short(F.col("text")).alias("error"))


@query("allowed_statement", "SELECT o_orderkey, o_orderkey % 8 IN (0, 1, 2, 7) AS allowed FROM orders")
def allowed_statement(spark, d):
    some = ("INSERT INTO t VALUES (1)", "  update t set a = 1 ; \n", "delete from t", "DELETE FROM a; DROP TABLE b", "SELECT 1", "inserted", "REPLACE INTO t VALUES (';')", "  ")
    return table(spark, d, "orders").select("o_orderkey", G.allowed_statement(F.get(F.array(*[F.lit(x) for x in some]), (F.col("o_orderkey") % 8).cast("int"))).alias("allowed"))


@query("sql_literal", "SELECT doc_id, CASE WHEN text IS NULL THEN 'NULL' ELSE '''' || replace(text, '''', '''''') || '''' END AS literal FROM documents")
def sql_literal(spark, d):
    return table(spark, d, "documents").select("doc_id", G.sql_literal(F.col("text")).alias("literal"))


@query("sql_upsert", "SELECT doc_id, 'INSERT INTO versions (article_id, language, title, content_markdown) VALUES (''' || doc_id || ''', ''' || lang || ''', NULL, ' || CASE WHEN text IS NULL THEN 'NULL' ELSE '''' || replace(text, '''', '''''') || '''' END || ') ON CONFLICT(article_id, language) DO UPDATE SET title=excluded.title, content_markdown=excluded.content_markdown;' AS statement FROM documents")
def sql_upsert(spark, d):
    values = {"article_id": F.col("doc_id"), "language": F.col("lang"), "title": F.lit(None).cast("string"), "content_markdown": F.col("text")}
    return table(spark, d, "documents").select("doc_id", G.upsert_statement("versions", values, ("article_id", "language")).alias("statement"))


@query("first_commit_date", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T01:02:03.000Z' ELSE '' END AS found_at FROM orders")
def first_commit_date(spark, d):
    k = F.col("o_orderkey") % 3
    one = lambda at: F.concat(F.lit('{"sha":"x","commit":{"author":{},"committer":{"name":"n","date":"'), at, F.lit('"}}}'))
    reply = F.when(k == 0, F.concat(F.lit("["), one(F.lit("2030-01-01T00:00:00Z")), F.lit(","), one(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T01:02:03Z"))), F.lit("]"))).when(k == 1, "[]").otherwise('{"message":"rate limit"}')
    return table(spark, d, "orders").select("o_orderkey", G.first_commit_date(reply).alias("found_at"))


@query("audit_samples", f"""
WITH a AS (SELECT doc_id, {_URL} AS url, doc_id % 9 = 0 AS failed, CASE WHEN doc_id % 9 = 0 THEN ['fetch-or-extraction-failed'] ELSE list_concat({_codes('doc_id % 11 = 0')}, CASE WHEN doc_id % 11 = 0 THEN ['missing-published-date'] ELSE [] END) END AS codes,
 len(list_distinct(regexp_extract_all({_BODY}, '!\\[[^\\]]*\\]\\(([^)\\s]+)(?:\\s+"[^"]*")?\\)', 1))) AS images, length({_BODY}) AS size, CASE WHEN doc_id % 11 = 0 THEN 'missing' ELSE {_DATE} END AS day, lang FROM documents)
SELECT doc_id, len(codes) = 0 AS passed, CASE WHEN len(codes) = 0 THEN 'PASS ' ELSE 'FAIL ' END || url || CASE WHEN failed THEN chr(10) || '  error=HTTP 500' ELSE chr(10) || '  title=t date=' || day || ' lang=' || lang || ' markdown=' || size || ' images=' || images END || CASE WHEN len(codes) > 0 THEN chr(10) || '  issues=' || array_to_string(codes, ',') ELSE '' END AS line FROM a""")
def audit_samples(spark, d):
    docs, i = _docs(spark, d), F.col("doc_id")
    rows = docs.select("doc_id", "url", F.lit("t").alias("title"), F.col("text").alias("content_markdown"), F.when(i % 11 != 0, _date()).alias("published_at"), F.col("lang").alias("language"), F.when(i % 9 == 0, "HTTP 500").alias("error"))
    return runs.audit(rows).select("doc_id", "passed", "line")


@query("retry_after", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN (event_id % 100) * 1000 WHEN 1 THEN 60000 WHEN 2 THEN 15000 WHEN 3 THEN 0 END AS wait FROM (SELECT * FROM events WHERE event_id % 6 <> 0 OR event_id % 100 <= 60) UNION ALL SELECT event_id, 60000 FROM events WHERE event_id % 6 = 0 AND event_id % 100 > 60")
def retry_after(spark, d):
    k = F.col("event_id") % 6
    head = F.when(k == 0, (F.col("event_id") % 100).cast("string")).when(k == 1, "3600").when(k == 2, "Tue, 07 May 2024 10:00:15 GMT").when(k == 3, "Mon, 06 May 2024 10:00:15 GMT").when(k == 4, "soon").otherwise("")
    return table(spark, d, "events").select("event_id", G.retry_after(head, F.lit("2024-05-07 10:00:00").cast("timestamp")).alias("wait"))


@query("private_host", "SELECT event_id, CASE event_id % 8 WHEN 0 THEN TRUE WHEN 1 THEN event_id % 40 BETWEEN 16 AND 31 WHEN 2 THEN TRUE WHEN 3 THEN TRUE WHEN 4 THEN event_id % 300 = 168 WHEN 5 THEN TRUE ELSE FALSE END AS private FROM events")
def private_host(spark, d):
    i = F.col("event_id")
    k, n = i % 8, lambda m: (i % m).cast("string")
    host = (
        F.when(k == 0, F.concat(F.lit("10.1.2."), n(256))).when(k == 1, F.concat(F.lit("172."), n(40), F.lit(".0.1"))).when(k == 2, "LocalHost").when(k == 3, "[fd00::1]")
        .when(k == 4, F.concat(F.lit("192."), n(300), F.lit(".0.1"))).when(k == 5, "printer.local").when(k == 6, "fdic.gov").otherwise("10.0.0.999")
    )
    return table(spark, d, "events").select("event_id", G.private_host(host).alias("private"))


@query("proxy_bypass", f"SELECT page_id, h = 'example.com' OR ends_with(h, '.example.com') OR h = 'thther.example.org' OR ends_with(h, '.thther.example.org') AS bypass FROM (SELECT page_id, {_HOST_OF} AS h FROM (SELECT page_id, {CANONICAL} AS c FROM pages))")
def proxy_bypass(spark, d):
    host = U.host_of(U.canonicalize_url(F.col("url")))
    return table(spark, d, "pages").select("page_id", G.bypasses_proxy(host, G.no_proxy_entries(F.lit("Example.com,  www.thther.example.org"))).alias("bypass"))


@query("same_token", "SELECT o_orderkey, o_orderstatus = 'O' AS same FROM orders")
def same_token(spark, d):
    return table(spark, d, "orders").select("o_orderkey", G.same_token(F.col("o_orderstatus"), F.lit("O")).alias("same"))


@query("request_value", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '\"x' || event_id || '\"' WHEN 2 THEN '\"/a/' || event_id || '/en\"' ELSE '\"plain\"' END AS value FROM events")
def request_value(spark, d):
    i, k = F.col("event_id").cast("string"), F.col("event_id") % 4
    template = F.when(k < 2, "{id}").when(k == 2, "/a/{id}/{lang}").otherwise("plain")
    return table(spark, d, "events").select("event_id", G.request_value(template, F.when(k == 1, F.concat(F.lit("x"), i)).otherwise(i), F.lit("en")).alias("value"))


@query("api_article", """
SELECT event_id, CASE WHEN event_id % 6 <> 3 THEN CASE WHEN event_id % 6 = 4 THEN 'found' ELSE 'T' || event_id END END AS title, CASE WHEN event_id % 2 = 0 THEN 'Me' END AS author, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS published_at,
 CASE WHEN event_id % 2 = 0 THEN 'zh' ELSE 'en' END AS language, CASE WHEN event_id % 6 <> 5 THEN CASE WHEN event_id % 6 = 2 THEN 'short' ELSE trim(repeat('word ', 60)) END END AS content_markdown,
 CASE event_id % 6 WHEN 5 THEN 'api detail returned no content' WHEN 2 THEN 'api content too short (minimum 200 chars)' WHEN 3 THEN 'no title found in api detail' END AS error FROM events""")
def api_article(spark, d):
    i, k = F.col("event_id"), F.col("event_id") % 6
    content = F.when(k == 2, "short").when(k != 5, F.repeat(F.lit("word "), F.lit(60)))
    title = F.when((k != 3) & (k != 4), F.concat(F.lit(" T"), i.cast("string")))
    detail = F.struct(content.alias("content"), title.alias("title"), F.when(i % 2 == 0, "Me").otherwise(" ").alias("author"), F.unix_timestamp("ts").alias("at"), F.when(i % 2 == 0, "ZH").otherwise("english").alias("lang"))
    reply = F.to_json(F.struct(F.struct(detail.alias("detail")).alias("data")))
    found = G.api_article(reply, F.lit("https://x.com/a"), F.when(k == 4, " found "), F.lit(None).cast("string"), F.lit("en_US"), {"content": "data.detail.content", "published_at": "data.detail.at"})
    return table(spark, d, "events").select("event_id", found.alias("a")).select("event_id", *[f"a.{c}" for c in ("title", "author", "published_at", "language", "content_markdown", "error")])


@query("collection_defaults", "SELECT doc_id, source AS blog_id, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE 'fr' END AS original_language, [] AS categories, doc_id % 4 = 0 AS demo, DATE '2024-05-06' AS published_at, CASE doc_id % 5 WHEN 0 THEN 'original_url' WHEN 1 THEN 'language, version_at' END AS error FROM documents")
def collection_defaults(spark, d):
    i, one = F.col("doc_id"), lambda x: F.lit(x)
    row = {"blog_id": F.col("source"), "original_url": F.when(i % 5 == 0, "nowhere").otherwise("https://x.com/a"), "language": F.when(i % 5 == 1, "fr").otherwise("en"), "title": one("t"), "published_at": one("2024-05-06T07:08:09Z"), "source_domain": one("x.com"), "original_language": F.when(i % 3 != 0, "fr"), "provenance": one("original"), "version_at": F.when(i % 5 == 1, "never").otherwise("2024"), "demo": F.when(i % 4 == 0, "true")}
    row["version_at"] = F.when(i % 5 == 1, "never").otherwise("2024-01-01")
    return table(spark, d, "documents").select("doc_id", G.collection_defaults(row).alias("c")).select("doc_id", *[f"c.{c}" for c in ("blog_id", "original_language", "categories", "demo", "published_at", "error")])


@query("first_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS found_at FROM orders")
def first_date(spark, d):
    k, day = F.col("o_orderkey") % 3, F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", D.first_date(F.array(F.lit("soon"), F.when(k == 0, day), F.when(k == 1, day), F.lit(""))).alias("found_at"))


_WHOLE_MD = "'# T' || doc_id || chr(10) || chr(10) || coalesce(text, '') || chr(10) || '`c` and [b](https://x.com/' || doc_id || ')'"
_CJK = f"(len(regexp_extract_all({_WHOLE_MD}, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}\\x{{3000}}-\\x{{303f}}]')) / len(regexp_extract_all({_WHOLE_MD}, '[A-Za-z\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}\\x{{3000}}-\\x{{303f}}]')))"


def _translatable(spark, d):
    i = F.col("doc_id").cast("string")
    md = F.concat(F.lit("# T"), i, F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n`c` and [b](https://x.com/"), i, F.lit(")"))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("https://x.com/"), i).alias("url"), F.concat(F.lit("Title "), i).alias("title"), md.alias("content_markdown"), (F.col("doc_id") % 10 == 0).alias("official"))


def _same_text(column):
    return F.regexp_replace(column, r"\s+", "")


@query("translate_chunked", f"SELECT doc_id, 'Title ' || doc_id AS title, ['Research'] AS categories, s AS status, CASE s WHEN 'model' THEN 'echo' ELSE s END AS model, TRUE AS same FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'official-zh' WHEN {_CJK} >= 0.5 THEN 'native-zh' ELSE 'model' END AS s FROM documents)")
def translate_chunked(spark, d):
    articles = _translatable(spark, d)
    done = translate.translate_chunked(articles.withColumn("before", F.col("content_markdown")), key="doc_id", keep=("before",))
    return done.select("doc_id", "title", "categories", "status", "model", (F.col("error").isNull() & (_same_text(F.col("content_markdown")) == _same_text(F.col("before")))).alias("same"))


@query("translate_whole", f"SELECT doc_id, 'Title ' || doc_id AS title, ['Research'] AS categories, 'model' AS status, {_WHOLE_MD} AS content_markdown, CAST(NULL AS VARCHAR) AS error FROM documents")
def translate_whole(spark, d):
    return translate.translate_whole(_translatable(spark, d), key="doc_id").select("doc_id", "title", "categories", "status", F.col("content_markdown"), "error")


def _transport(url):
    """A stand-in without a network: the status that an address asks for, whenever it is asked."""
    status = int(url.rsplit("#", 1)[1])
    return status, f"body of {url}"


def _other_transport(url):
    return 200, f"other body of {url}"


@query("fetch_pages", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'body of ' || u WHEN 1 THEN 'other body of ' || u END AS body, CASE WHEN page_id % 4 IN (0, 1) THEN page_id % 4 + 1 END AS tries, CASE page_id % 4 WHEN 2 THEN 'HTTP 503' WHEN 3 THEN 'HTTP 404' END AS error FROM (SELECT page_id, url || '#' || CASE page_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 403 WHEN 2 THEN 503 ELSE 404 END AS u FROM pages)")
def fetch_pages(spark, d):
    k = F.col("page_id") % 4
    url = F.concat("url", F.lit("#"), F.when(k == 0, "200").when(k == 1, "403").when(k == 2, "503").otherwise("404"))
    got = translate.fetch(_transport, _other_transport, sleep=_no_wait)(url)
    return table(spark, d, "pages").select("page_id", got.alias("g")).select("page_id", "g.body", F.col("g.tries").cast("long").alias("tries"), "g.error")


def _no_wait(seconds):
    return None

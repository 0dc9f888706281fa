"""Queries for joins, aggregates, ordering, merges and state, with the tables in the place of articles, items and runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import discovery, merge, readmodel, state
from marlstone.plans.registry import query
from marlstone.session import table


@query("newest_n_per_source", "SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def newest_n_per_source(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("seq"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"))
    return discovery.newest(orders, discovery.run_limit()).select(F.col("source_id").alias("o_custkey"), F.col("seq").alias("o_orderkey"), F.col("place").cast("long"))


@query("truncated_by_cap", "SELECT o_custkey, count(*) AS eligible, greatest(0, count(*) - 12) AS truncated FROM orders GROUP BY 1")
def truncated_by_cap(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("eligible"), F.greatest(F.lit(0), F.count(F.lit(1)) - 12).alias("truncated"))


@query("seen_anti_join", "SELECT o_custkey AS source_id, o_orderkey AS url FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders s WHERE s.o_orderstatus = 'F' AND s.o_custkey = o.o_custkey AND s.o_orderkey = o.o_orderkey)")
def seen_anti_join(spark, d):
    items = table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("url"), "o_orderstatus")
    return discovery.unseen(items, items.where("o_orderstatus = 'F'")).select("source_id", "url")


@query("reconcile_insert_missing", "SELECT count(*) AS inserted FROM (SELECT DISTINCT user_id, event_type FROM events) a WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.event_id % 2 = 0 AND b.user_id = a.user_id AND b.event_type = a.event_type)")
def reconcile_insert_missing(spark, d):
    events = table(spark, d, "events").select("user_id", "event_type", "event_id")
    had = events.where("event_id % 2 = 0").select("user_id", "event_type")
    return merge.missing(had, events.select("user_id", "event_type"), ["user_id", "event_type"]).agg(F.count(F.lit(1)).alias("inserted"))


def _articles(spark, d):
    docs = table(spark, d, "documents")
    articles = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.col("lang").alias("original_language"), F.format_string("2024-%02d-%02d", F.col("doc_id") % 12 + 1, F.col("doc_id") % 28 + 1).alias("published_at"), F.lit(None).cast("string").alias("image_url"), F.lit(None).cast("string").alias("author"))
    versions = docs.select(F.col("doc_id").alias("article_id"), F.col("lang").alias("language"), F.col("text").alias("title"), T.excerpt(F.col("text")).alias("excerpt"), F.lit("original").alias("provenance"))
    return articles, versions


_DATE = "printf('2024-%02d-%02d', doc_id % 12 + 1, doc_id % 28 + 1)"


@query("article_list", f"SELECT doc_id AS id, {_DATE} AS published_at, text AS title FROM documents WHERE source = 'src1' AND lang = 'en'")
def article_list(spark, d):
    return readmodel.article_list(*_articles(spark, d), "src1", "en").select("id", "published_at", "title")


@query("article_detail", f"SELECT doc_id AS id, source AS source_id, lang AS language, {_DATE} AS published_at FROM documents WHERE doc_id = 7 AND lang = 'en'")
def article_detail(spark, d):
    return readmodel.article_detail(*_articles(spark, d), 7, "en").select("id", "source_id", "language", "published_at")


@query("version_counts", "SELECT source AS source_id, count(*) AS count FROM documents WHERE lang = 'en' GROUP BY 1")
def version_counts(spark, d):
    return readmodel.version_counts(*_articles(spark, d), "en")


@query("blogs_with_counts", "SELECT s_suppkey AS id, s_name AS name, coalesce(n, 0) AS count FROM supplier LEFT JOIN (SELECT CAST(substring(source, 4) AS BIGINT) AS k, count(*) AS n FROM documents GROUP BY 1) ON k = s_suppkey")
def blogs_with_counts(spark, d):
    counts = table(spark, d, "documents").groupBy(F.substring("source", 4, 20).cast("long").alias("source_id")).agg(F.count(F.lit(1)).alias("count"))
    return readmodel.with_counts(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), counts)


@query("article_blog_names", "SELECT doc_id, coalesce(n_name, source) AS blog FROM documents LEFT JOIN nation ON n_nationkey = TRY_CAST(substring(source, 4) AS INT) + 10")
def article_blog_names(spark, d):
    nation = table(spark, d, "nation")
    return table(spark, d, "documents").join(nation, nation["n_nationkey"] == F.expr("try_cast(substring(source, 4) as int)") + 10, "left").select("doc_id", F.coalesce("n_name", "source").alias("blog"))


@query("nested_categories", "SELECT d.doc_id AS id, coalesce(list_sort(c.names), []) AS categories FROM documents d LEFT JOIN (SELECT doc_id, list(DISTINCT CASE WHEN quality = 1 THEN 'AI' ELSE 'Other' END) || list(DISTINCT CASE WHEN toxic = 1 THEN 'Agent' ELSE 'Research' END) AS names FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1) c USING (doc_id)")
def nested_categories(spark, d):
    marks = table(spark, d, "labels").where("quality is not null and toxic is not null")
    names = F.array(F.when(F.col("quality") == 1, "AI").otherwise("Other"), F.when(F.col("toxic") == 1, "Agent").otherwise("Research"))
    categories = marks.select(F.col("doc_id").alias("article_id"), F.explode(names).alias("category_name"))
    return readmodel.with_categories(table(spark, d, "documents").select(F.col("doc_id").alias("id")), categories)


@query("category_union", "SELECT source, list_sort(list(DISTINCT lang)) AS langs FROM documents GROUP BY 1")
def category_union(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array("lang"))))).alias("langs"))


@query("missing_translation", "SELECT doc_id AS id FROM documents WHERE lang <> 'fr' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)")
def missing_translation(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "fr", "zh").otherwise(F.col("lang")).alias("original_language"))
    versions = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("article_id"), F.lit("zh-cn").alias("language"))
    return readmodel.untranslated(docs, versions).select("id")


@query("untranslated_counts", "SELECT source AS source_id, count(*) AS untranslated FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY 1")
def untranslated_counts(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.lit("en").alias("original_language"))
    versions = table(spark, d, "labels").select(F.col("doc_id").alias("article_id"), F.lit("zh").alias("language"))
    return readmodel.untranslated(docs, versions).groupBy("source_id").agg(F.count(F.lit(1)).alias("untranslated"))


@query("related_top3", f"""
WITH i AS (SELECT doc_id AS id, source AS s, lang AS l, {_DATE} AS p FROM documents),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, l ORDER BY p DESC, id) AS n FROM i) WHERE n <= 4)
SELECT id, place, related FROM (SELECT i.id, t.id AS related, CAST(row_number() OVER (PARTITION BY i.id ORDER BY t.n) AS INT) AS place FROM i JOIN t ON i.s = t.s AND i.l = t.l AND i.id <> t.id) WHERE place <= 3""")
def related_top3(spark, d):
    items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.col("lang").alias("language"), F.format_string("2024-%02d-%02d", F.col("doc_id") % 12 + 1, F.col("doc_id") % 28 + 1).alias("published_at"))
    return readmodel.related(items)


@query("original_title_left_join", "SELECT a.conv_id AS article_id, a.title, b.title AS original_title FROM (SELECT conv_id, text AS title FROM conversations WHERE turn = 1) a LEFT JOIN (SELECT conv_id, text AS title FROM conversations WHERE turn = 2) b USING (conv_id)")
def original_title_left_join(spark, d):
    versions = table(spark, d, "conversations").select(F.col("conv_id").alias("article_id"), F.when(F.col("turn") == 1, "zh-cn").when(F.col("turn") == 2, "en").otherwise("xx").alias("language"), F.col("text").alias("title"))
    return readmodel.with_original_title(versions).select("article_id", "title", "original_title")


@query("nested_versions", "SELECT conv_id AS article_id, list({'language': role, 'turn': turn} ORDER BY role, turn) AS versions FROM conversations GROUP BY 1")
def nested_versions(spark, d):
    return readmodel.nested_versions(table(spark, d, "conversations").select(F.col("conv_id").alias("article_id"), F.col("role").alias("language"), "turn"))


_BASE = "SELECT doc_id AS k, source AS image_url, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS author, doc_id AS id FROM documents WHERE doc_id % 2 = 0"
_NEW = "SELECT doc_id AS k, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'new' END AS image_url, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'me' END AS author, doc_id + 1000000 AS id FROM documents WHERE doc_id % 3 = 0"


@query("merge_article_coalesce", f"SELECT coalesce(b.k, n.k) AS k, CASE WHEN n.k IS NULL THEN b.image_url WHEN b.k IS NULL THEN n.image_url ELSE coalesce(n.image_url, b.image_url) END AS image_url, CASE WHEN n.k IS NULL THEN b.author ELSE coalesce(n.author, b.author) END AS author, coalesce(b.id, n.id) AS id FROM ({_BASE}) b FULL JOIN ({_NEW}) n ON b.k = n.k")
def merge_article_coalesce(spark, d):
    docs = table(spark, d, "documents")
    base = docs.where("doc_id % 2 = 0").selectExpr("'s' as source_id", "doc_id as original_url", "source as image_url", "case when doc_id % 3 = 0 then null else lang end as author", "doc_id as id", "'d' as source_domain")
    new = docs.where("doc_id % 3 = 0").selectExpr("'s' as source_id", "doc_id as original_url", "case when doc_id % 5 = 0 then null else 'new' end as image_url", "case when doc_id % 7 = 0 then null else 'me' end as author", "doc_id + 1000000 as id", "'e' as source_domain")
    once = merge.merge_articles(base, new)
    return merge.merge_articles(once, new).select(F.col("original_url").alias("k"), "image_url", "author", "id")


@query("merge_version_write_once", "SELECT coalesce(b.k, n.k) AS k, CASE WHEN n.k IS NULL THEN b.title ELSE n.title END AS title, coalesce(b.at, n.at) AS translated_at FROM (SELECT doc_id AS k, 'old' AS title, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 't0' END AS at FROM documents WHERE doc_id % 2 = 0) b FULL JOIN (SELECT doc_id AS k, 'new' AS title, CASE WHEN doc_id % 9 = 0 THEN 't1' END AS at FROM documents WHERE doc_id % 3 = 0) n ON b.k = n.k")
def merge_version_write_once(spark, d):
    docs = table(spark, d, "documents")
    base = docs.where("doc_id % 2 = 0").selectExpr("doc_id as article_id", "'zh' as language", "'old' as title", "'model' as provenance", "case when doc_id % 4 = 0 then null else 't0' end as translated_at")
    new = docs.where("doc_id % 3 = 0").selectExpr("doc_id as article_id", "'zh' as language", "'new' as title", "case when doc_id % 9 = 0 then 'model' else 'official-zh' end as provenance", "'t1' as translated_at")
    return merge.merge_versions(base, new).select(F.col("article_id").alias("k"), "title", "translated_at")


@query("merge_sources_keep_config", "SELECT coalesce(a.k, b.k) AS id, coalesce(b.name, a.name) AS name, coalesce(a.config, b.config) AS config FROM (SELECT s_suppkey AS k, s_name AS name, 'old' AS config FROM supplier WHERE s_suppkey % 2 = 0) a FULL JOIN (SELECT s_suppkey AS k, upper(s_name) AS name, 'new' AS config FROM supplier WHERE s_suppkey % 3 = 0) b ON a.k = b.k")
def merge_sources_keep_config(spark, d):
    s = table(spark, d, "supplier")
    old = s.where("s_suppkey % 2 = 0").selectExpr("s_suppkey as id", "s_name as name", "'old' as config")
    return merge.merge_sources(old, s.where("s_suppkey % 3 = 0").selectExpr("s_suppkey as id", "upper(s_name) as name", "'new' as config"), keep_config=True)


@query("category_replace", "SELECT doc_id AS article_id, lang AS category_name FROM documents WHERE doc_id % 3 = 0 UNION SELECT doc_id, c FROM documents, (VALUES ('AI'), ('Agent')) v(c) WHERE doc_id % 3 = 1")
def category_replace(spark, d):
    docs = table(spark, d, "documents")
    has = docs.selectExpr("doc_id as article_id", "lang as category_name")
    given = docs.select(F.col("doc_id").alias("article_id"), F.when(F.col("doc_id") % 3 == 1, F.array(F.lit("AI"), F.lit("Agent"), F.lit("AI"))).when(F.col("doc_id") % 3 == 2, F.array().cast("array<string>")).alias("categories"))
    return merge.replace_categories(has, given)


@query("source_rename", "SELECT doc_id, CASE WHEN source = 'src1' THEN 'renamed' ELSE source END AS source_id, CASE WHEN source = 'src1' THEN 'renamed/' || doc_id ELSE source || '/' || doc_id END AS id FROM documents")
def source_rename(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("source_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("id"))
    return merge.rename_source(rows, "src1", "renamed", "id")


@query("translated_at_backfill", "SELECT doc_id, CASE WHEN lang = 'en' AND doc_id % 2 = 0 THEN 'u' WHEN doc_id % 2 = 1 THEN 't' END AS translated_at FROM documents")
def translated_at_backfill(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", "model").otherwise("original").alias("provenance"), F.when(F.col("doc_id") % 2 == 1, "t").alias("translated_at"), F.lit("u").alias("updated_at"))
    return merge.backfill_translated_at(rows).select("doc_id", "translated_at")


@query("refetch_delete", "SELECT doc_id, lang FROM documents WHERE NOT (source = 'src2' AND lang = 'en')")
def refetch_delete(spark, d):
    docs = table(spark, d, "documents")
    versions = docs.select(F.col("doc_id").alias("article_id"), F.col("lang").alias("language"))
    articles = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.lit("en").alias("original_language"))
    return merge.drop_originals(versions, articles, "src2").select(F.col("article_id").alias("doc_id"), F.col("language").alias("lang"))


@query("orphan_versions", "SELECT doc_id FROM labels WHERE doc_id % 4 <> 0")
def orphan_versions(spark, d):
    parents = table(spark, d, "documents").where("doc_id % 4 = 0")
    return merge.orphans(table(spark, d, "labels").select("doc_id"), parents, "doc_id", "doc_id")


@query("duplicate_keys", "SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_place, max(event_id) AS last_place FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return merge.repeated_keys(table(spark, d, "events"), ["user_id", "event_type"], "event_id")


_STATES = "(VALUES (0, 'discovered'), (1, 'fetching'), (2, 'fetched'), (3, 'translating'), (4, 'published'), (5, 'skipped'), (6, 'failed')) "


def _items(spark, d):
    names = F.array(*[F.lit(s) for s in ("discovered", "fetching", "fetched", "translating", "published", "skipped", "failed")])
    return table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("original_url"), F.get(names, (F.col("o_orderkey") % 7).cast("int")).alias("status"), F.lit(0).alias("attempt_count"), F.lit("e").alias("last_error"), F.lit(None).cast("string").alias("article_id"), F.lit("t0").alias("discovered_at"), F.lit("t0").alias("updated_at"))


@query("item_transitions", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 1, 6) THEN 'fetching' ELSE CASE o_orderkey % 7 WHEN 2 THEN 'fetched' WHEN 3 THEN 'translating' WHEN 4 THEN 'published' WHEN 5 THEN 'skipped' END END AS status FROM orders""")
def item_transitions(spark, d):
    items = _items(spark, d)
    moves = items.select("source_id", "original_url", F.lit("fetching").alias("to_status"), F.lit(None).cast("string").alias("article_id"))
    return state.transition(items, moves, F.lit("t1"))[0].select(F.col("original_url").alias("o_orderkey"), "status")


@query("item_refused", "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 IN (2, 3, 4, 5)")
def item_refused(spark, d):
    items = _items(spark, d)
    moves = items.select("source_id", "original_url", F.lit("fetching").alias("to_status"), F.lit(None).cast("string").alias("article_id"))
    return state.transition(items, moves, F.lit("t1"))[1].select(F.col("original_url").alias("o_orderkey"))


@query("item_discover", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 6) THEN 'discovered' ELSE CASE o_orderkey % 7 WHEN 1 THEN 'fetching' WHEN 2 THEN 'fetched' WHEN 3 THEN 'translating' WHEN 4 THEN 'published' WHEN 5 THEN 'skipped' END END AS status, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE 'e' END AS last_error FROM orders")
def item_discover(spark, d):
    items = _items(spark, d)
    return state.discover(items, items.select("source_id", "original_url"), F.lit("t1")).select(F.col("original_url").alias("o_orderkey"), "status", "last_error")


@query("item_failures", "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 4 THEN 'published' WHEN 5 THEN 'skipped' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 7 IN (4, 5) THEN 0 ELSE 1 END AS attempt_count FROM orders")
def item_failures(spark, d):
    items = _items(spark, d)
    return state.record_failures(items, items.select("source_id", "original_url", F.lit("x").alias("error")), F.lit("t1")).select(F.col("original_url").alias("o_orderkey"), "status", "attempt_count")


@query("processed_urls", "SELECT o_custkey AS source_id, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey % 7 = 4), []) AS urls FROM orders GROUP BY 1")
def processed_urls(spark, d):
    return state.processed(_items(spark, d)).select("source_id", "urls")


def _outcomes(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("source_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 11 == 0, "failed").when(F.col("event_id") % 5 == 0, "seen").when(F.col("event_id") % 3 == 0, "processed").otherwise("pending").alias("disposition"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error"))


_RUNS = "SELECT event_type AS source_id, count(*) AS discovered, count(*) FILTER (event_id % 11 = 0 OR event_id % 5 <> 0) AS pending, count(*) FILTER (event_id % 11 <> 0 AND event_id % 5 <> 0 AND event_id % 3 = 0) AS processed, count(*) FILTER (event_id % 11 = 0) AS failed FROM events GROUP BY 1"


@query("run_summary", f"SELECT *, CASE WHEN failed > 0 THEN 'partial' ELSE 'completed' END AS status FROM ({_RUNS})")
def run_summary(spark, d):
    return state.close_runs(_outcomes(spark, d)).drop("errors")


@query("run_errors_first50", """SELECT event_type AS source_id, coalesce('["' || string_agg('e' || event_id, '","' ORDER BY event_id) || '"]', '[]') AS errors FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events WHERE event_id % 11 = 0) WHERE n <= 50 GROUP BY 1""")
def run_errors_first50(spark, d):
    return state.close_runs(_outcomes(spark, d)).where("failed > 0").select("source_id", "errors")


@query("run_totals", f"SELECT CAST(sum(discovered) AS BIGINT) AS discovered, CAST(sum(pending) AS BIGINT) AS pending, CAST(sum(processed) AS BIGINT) AS processed, CAST(sum(failed) AS BIGINT) AS failed FROM ({_RUNS})")
def run_totals(spark, d):
    return state.total(state.close_runs(_outcomes(spark, d))).drop("sources")


@query("published_span", "SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date FROM orders GROUP BY 1")
def published_span(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("first_date"), F.max(F.to_date("o_orderdate")).alias("last_date"))


@query("all_samples_pass", "SELECT o_custkey, count(*) > 0 AND bool_and(o_totalprice > 5000) AS passed FROM orders GROUP BY 1")
def all_samples_pass(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(((F.count(F.lit(1)) > 0) & F.bool_and(F.col("o_totalprice") > 5000)).alias("passed"))


@query("health_counts", "SELECT (SELECT count(*) FROM documents) AS articles, (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 4) AS published")
def health_counts(spark, d):
    return readmodel.health(table(spark, d, "documents"), _items(spark, d))


@query("featured_first", f"SELECT doc_id, place, place = 1 AS featured FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY {_DATE} DESC, doc_id) AS place FROM documents)")
def featured_first(spark, d):
    items = table(spark, d, "documents").select("doc_id", "source", F.format_string("2024-%02d-%02d", F.col("doc_id") % 12 + 1, F.col("doc_id") % 28 + 1).alias("published_at"))
    return readmodel.featured(items, "source", "published_at", "doc_id").select("doc_id", F.col("place").cast("long"), "featured")


@query("search_contains", "SELECT * FROM (SELECT 'blog' AS kind, s_name AS title, CAST(NULL AS VARCHAR) AS subtitle FROM supplier UNION ALL SELECT 'article', p_name, p_type FROM part) WHERE contains(lower(concat_ws(' ', title, subtitle)), '7')")
def search_contains(spark, d):
    items = readmodel.search_items(table(spark, d, "supplier").select(F.col("s_name").alias("title")), table(spark, d, "part").select(F.col("p_name").alias("title"), F.col("p_type").alias("subtitle")))
    return items.where(readmodel.matches(F.lit("7"), F.col("title"), F.col("subtitle"))).select("kind", "title", "subtitle")


@query("hits_top30", "SELECT rtrim(url, '/') AS u, score FROM (SELECT url, length(html) AS score FROM pages) ORDER BY score DESC, url LIMIT 30")
def hits_top30(spark, d):
    pages = table(spark, d, "pages")
    return readmodel.hits_by_path(pages.select(F.col("url").alias("path"), F.length("html").cast("long").alias("score")), pages.select("url")).select(F.regexp_replace("url", "/+$", "").alias("u"), "score")


@query("backfill_policy", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN TRUE WHEN o_orderkey % 10 = 0 THEN FALSE WHEN o_orderkey % 10 = 1 THEN TRUE ELSE CAST(o_orderdate AS DATE) >= DATE '1996-01-01' END AS passes FROM orders")
def backfill_policy(spark, d):
    date = F.when(F.col("o_orderkey") % 10 == 0, None).when(F.col("o_orderkey") % 10 == 1, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    mode = F.when(F.col("o_orderstatus") == "O", "all").otherwise("since")
    return table(spark, d, "orders").select("o_orderkey", discovery.policy_passes(mode, F.lit("1996-01-01"), date).alias("passes"))


@query("newest_per_order_window", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def newest_per_order_window(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    return table(spark, d, "orders").withColumn("n", F.row_number().over(w)).where("n = 1").select("o_orderpriority", "o_orderkey")

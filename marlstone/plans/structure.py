"""Queries for Markdown structure, page extraction and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import dates as D
from marlstone.functions import html as H
from marlstone.functions import json as J
from marlstone.functions import markdown as M
from marlstone.functions import text as T
from marlstone.operators import readmodel
from marlstone.plans.registry import query
from marlstone.plans.scalars import _docs
from marlstone.session import table
from marlstone.sources import corpus


@query("protect_restore", "SELECT doc_id, TRUE AS same, CAST(NULL AS VARCHAR) AS error FROM documents")
def protect_restore(spark, d):
    held = _docs(spark, d).withColumn("p", M.protect_markdown(F.col("md")))
    back = held.withColumn("r", M.restore_markdown(F.col("p.text"), F.col("p.spans")))
    unix = F.regexp_replace("md", r"\r\n?", "\n")
    return back.select("doc_id", ((F.col("r.text") == unix) & (F.size("p.spans") > 0) & (F.col("p.text") != unix)).alias("same"), "r.error")


@query("chunk_markdown")
def chunk_markdown(spark, d):
    held = _docs(spark, d).withColumn("c", M.chunk_markdown(F.col("md")))
    return held.select("doc_id", F.col("c.error").alias("error"), F.explode_outer("c.chunks").alias("k")).select("doc_id", "error", "k.id", "k.tokens", "k.sha256", "k.oversized")


@query("translation_plan")
def translation_plan(spark, d):
    planned = _docs(spark, d).withColumn("p", M.translation_plan(F.col("md"), F.concat(F.lit("Title "), F.col("doc_id").cast("string")), F.col("doc_id") % 10 == 0))
    return planned.select("doc_id", "p.mode", F.col("p.title.id").alias("title_id"), "p.n_chunks", "p.oversize_blocks", "p.total_tokens", F.round("p.cjk_ratio", 9).alias("cjk_ratio"), "p.error")


@query("math_inventory")
def math_inventory(spark, d):
    return _docs(spark, d).select("doc_id", F.transform(M.math_of(F.col("md")), lambda m: m["sha256"]).alias("formulas"))


@query("render_html")
def render_html(spark, d):
    return _docs(spark, d).select("doc_id", M.render_markdown(F.col("md")).alias("html"))


@query("html_extract")
def html_extract(spark, d):
    pages = table(spark, d, "pages").withColumn("e", H.extract_page(F.col("html"), F.col("url")))
    return pages.select("page_id", "e.title", "e.author", T.primary_language(F.col("e.html_lang"), F.col("e.og_locale")).alias("language"), F.coalesce(D.first_date(F.col("e.published")), F.nullif(D.visible_date(F.col("e.heading_text")), F.lit(""))).alias("published_at"), "e.text_length", "e.image_url", "e.content_markdown", "e.alternates")


@query("html_language", "SELECT page_id, coalesce(nullif(regexp_extract(lower(regexp_extract(html, '(?i)<html[^>]*\\slang=[\"'']?([^\"''\\s>]+)', 1)), '^([a-z]{2})(?:[_-].*)?$', 1), ''), 'en') AS language FROM pages")
def html_language(spark, d):
    pages = table(spark, d, "pages").withColumn("e", H.extract_page(F.col("html"), F.col("url")))
    return pages.select("page_id", T.primary_language(F.col("e.html_lang"), F.lit(None).cast("string")).alias("language"))


@query("model_json_reply", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b}' END AS v FROM documents")
def model_json_reply(spark, d):
    k = F.col("doc_id") % 3
    reply = F.when(k == 0, '{"v":"a"}').when(k == 1, 'Sure: {"v":"b}"} done').otherwise("none { here")
    return table(spark, d, "documents").select("doc_id", J.dot_path(J.model_json(reply), "v").alias("v"))


@query("official_chinese", "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'u1' WHEN 1 THEN 'u2' WHEN 2 THEN 'u3' WHEN 4 THEN 'u4' WHEN 5 THEN 'u5' END AS url FROM pages")
def official_chinese(spark, d):
    pair = lambda tag, url: F.struct(F.lit(tag).alias("language"), F.lit(url).alias("url"))
    k = F.col("page_id") % 6
    some = F.when(k == 0, F.array(pair("zh-hans", "x"), pair("zh-cn", "u1"))).when(k == 1, F.array(pair("en", "x"), pair("zh", "u2"))).when(k == 2, F.array(pair("zh-hans-sg", "u3"))).when(k == 4, F.array(pair("zh-cn", "x"), pair(" zh_Hans_CN", "u4"))).when(k == 5, F.array(pair("zh", "x"), pair("zh-SG", "u5"))).otherwise(F.array(pair("zh-hant", "x"), pair("zh-tw", "y")))
    return table(spark, d, "pages").select("page_id", readmodel.official_chinese(some)["url"].alias("url"))


@query("payload_validate", "SELECT doc_id, 'articles[0].versions' AS path FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id, 'articles[0].original_url' FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'articles[1]' FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'articles[1].original_url' FROM documents WHERE doc_id % 35 = 0")
def payload_validate(spark, d):
    version = F.struct(F.lit("en").alias("language"), F.lit("t").alias("title"), F.lit("original").alias("provenance"))
    article = F.struct(F.lit("a").alias("id"), F.lit("s").alias("source_id"), F.when(F.col("doc_id") % 5 == 0, "ftp:x").otherwise("https://x.com/a").alias("original_url"), F.lit("2024").alias("published_at"), F.when(F.col("doc_id") % 3 == 1, F.array().cast("array<struct<language:string,title:string,provenance:string>>")).otherwise(F.array(version)).alias("versions"))
    fine = F.struct(F.lit("b").alias("id"), F.lit("s").alias("source_id"), F.lit("https://x.com/b").alias("original_url"), F.lit("2024").alias("published_at"), F.array(version).alias("versions"))
    copy = F.struct(F.lit("b").alias("id"), F.lit("s").alias("source_id"), F.when(F.col("doc_id") % 5 == 0, "ftp:x").otherwise("https://x.com/a").alias("original_url"), F.lit("2024").alias("published_at"), F.array(version).alias("versions"))
    body = F.to_json(F.struct(F.array(article, F.when(F.col("doc_id") % 7 == 0, copy).otherwise(fine)).alias("articles")))
    rows = corpus.parse_payloads(table(spark, d, "documents").select("doc_id", body.alias("body")))
    return corpus.payload_issues(rows, "doc_id").select("doc_id", "path")


@query("payload_chunks", """
WITH RECURSIVE s AS (SELECT source, doc_id, strlen(text) + 1 AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
c AS (SELECT source, doc_id, n, size AS used, 0::BIGINT AS chunk, size > 20000 AS oversized FROM s WHERE n = 1
 UNION ALL SELECT s.source, s.doc_id, s.n, CASE WHEN c.used + s.size > 20000 THEN s.size ELSE c.used + s.size END, CASE WHEN c.used + s.size > 20000 THEN c.chunk + 1 ELSE c.chunk END, s.size > 20000 FROM c JOIN s ON s.source = c.source AND s.n = c.n + 1)
SELECT source AS source_id, doc_id AS seq, chunk, oversized FROM c""")
def payload_chunks(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("seq"), F.col("text").alias("body"))
    return corpus.payload_chunks(rows, 20_000)

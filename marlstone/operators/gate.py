"""Quality gate: issues of an extracted article, as an array of (severity, code, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions.core import let
from marlstone.functions.dates import valid_published


def _issue(severity: str, code: str, detail: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), detail.alias("detail"))


def issues(title: Column, markdown: Column, published_at: Column, min_content: Column | None = None, promo_filter: Column | None = None) -> Column:
    """All issues, in the order of the checks; an article without an ``error`` passes.

    Nulls count as missing values. The detail is the text's length, the number of links or the
    address at fault, else null.
    """
    least = F.coalesce(min_content, F.lit(T.MIN_CONTENT)) if min_content is not None else F.lit(T.MIN_CONTENT)
    promo = F.coalesce(promo_filter, F.lit(False)) if promo_filter is not None else F.lit(False)
    body = F.coalesce(markdown, F.lit(""))
    known = F.struct(body.alias("body"), F.length(T.plain_text(body)).alias("size"), T.strip_code_blocks(body).alias("prose"))
    return let(known, lambda v: _issues(title, v["body"], v["size"], v["prose"], published_at, least, promo))


def _issues(title: Column, body: Column, size: Column, prose: Column, published_at: Column, least: Column, promo: Column) -> Column:
    links = F.regexp_count(prose, F.lit(r"\[[^\]]*\]\(https?://[^)\s]+\)"))
    none = F.lit(None).cast("string")
    single = [
        F.when(T.trim(F.coalesce(title, F.lit(""))) == "", _issue("error", "missing-title", none)),
        F.when(size < least, _issue("error", "content-too-short", size.cast("string"))),
        F.when(~valid_published(published_at), _issue("error", "missing-published-date", none)),
        F.when((size < least) & (links >= T.NAV_LINKS), _issue("error", "looks-like-navigation-list", links.cast("string"))),
        *[F.when(prose.rlike(pattern), _issue(severity, code, none)) for code, pattern, severity in T.PLACEHOLDERS],
    ]
    targets = F.regexp_extract_all(prose, F.lit(r'!\[[^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)'), F.lit(1))
    relative = F.transform(F.filter(targets, lambda u: ~u.rlike(r"^(?i)(?:https?:|data:|blob:)")), lambda u: _issue("error", "image-url-not-absolute", u))
    promotions = [F.when(promo & body.rlike(pattern), _issue("error", code, none)) for code, pattern in T.PROMOTIONS]
    return F.concat(F.array_compact(F.array(*single)), relative, F.array_compact(F.array(*promotions)))


def passes(found: Column) -> Column:
    return ~F.exists(found, lambda i: i["severity"] == "error")


def gate(articles: DataFrame, **options: Column) -> DataFrame:
    """``articles`` (title, content_markdown, published_at) with ``issues``, ``stats`` and ``passed``."""
    found = issues(F.col("title"), F.col("content_markdown"), F.col("published_at"), **options)
    return articles.withColumn("issues", found).withColumn("stats", T.content_stats(F.coalesce("content_markdown", F.lit("")))).withColumn("passed", passes(F.col("issues")))

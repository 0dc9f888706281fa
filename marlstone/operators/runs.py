"""Whole runs as DataFrame flows: update, backfill and sync.

What a run does to each item is a column, so nothing stops a source or the run: an item that fails
says so in its own row. Fetched pages and translations come as tables, from whatever reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import dates as D
from marlstone.functions import text as T
from marlstone.functions import urls as U
from marlstone.operators import discovery, gate

#: Statements of one batch of a sync.
BATCH = 100

# How an item ends, in the order of the stages.
DISPOSITIONS = ("seen", "over-limit", "fetch-failed", "rejected", "validated", "saved", "published")


def selected_sources(registry: DataFrame, source_id: str | None = None, dry_run: bool = False) -> DataFrame:
    """The sources that a run takes: one or all, and without ``dry_run`` active ones only.

    An id that isn't there, or that only a dry run may take, is an error.
    """
    some = registry if source_id is None else registry.where(F.col("id") == source_id)
    runnable = some if dry_run else some.where(F.coalesce("update_mode", F.lit("active")) == "active")
    if source_id is not None:
        if not some.limit(1).count():
            raise ValueError(f"unknown source {source_id}")
        if not runnable.limit(1).count():
            raise ValueError(f"source {source_id} is for dry runs only")
    return runnable


def unknown_targets(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """The ids of ``targets`` (id) that no source has."""
    return targets.select("id").distinct().join(sources.select("id"), "id", "left_anti")


def by_type(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Companies, and personal sources."""
    return sources.where("type = 'company'"), sources.where("type = 'personal'")


def _newest(items: DataFrame, eligible: Column, most: Column) -> DataFrame:
    """Items (source_id, url, published_at, seq) with ``_taken`` and, for taken ones, ``place``: the newest eligible ones of a source, up to ``most`` (0: all).

    Parts of a source are cut first, each in a task of its own, and so is what isn't eligible; only without
    a limit is a source sorted whole.
    """
    order = [D.sort_instant(F.col("published_at")).desc(), F.col("seq")]
    turn = lambda lane: F.row_number().over(Window.partitionBy("source_id", lane).orderBy(*order))
    part = F.pmod(F.xxhash64("url"), F.lit(discovery.PARTS))
    rows = items.withColumn("_fit", eligible).withColumn("_most", most).withColumn("_part", part)
    rows = rows.withColumn("_lane", F.when(F.col("_fit"), F.col("_part")).otherwise(-1 - F.col("_part"))).withColumn("_n", turn("_lane"))
    rows = rows.withColumn("_may", F.col("_fit") & ((F.col("_most") <= 0) | (F.col("_n") <= F.col("_most"))))
    rows = rows.withColumn("_lane", F.when(F.col("_may"), F.lit(discovery.PARTS)).otherwise(F.col("_lane"))).withColumn("_n", turn("_lane"))
    rows = rows.withColumn("_taken", F.col("_may") & ((F.col("_most") <= 0) | (F.col("_n") <= F.col("_most"))))
    return rows.withColumn("place", F.when(F.col("_taken"), F.col("_n"))).drop("_fit", "_most", "_part", "_lane", "_n", "_may")


def run_update(sources: DataFrame, discovered: DataFrame, seen: DataFrame, fetched: DataFrame, translated: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """One row per discovered item: source_id, url, place, disposition, error_kind, error_code, error, marked.

    sources: id, limit, min_content_chars. discovered: source_id, url, published_at, seq. seen:
    source_id, url. fetched: source_id, url, title, content_markdown, published_at, error.
    translated: source_id, url, error; without it the run is a dry one, which ends with
    ``validated`` and marks nothing.

    Unseen items of a source are taken newest first, as many as the run's limit or else the source's says (0: all).
    An item without a page failed to be fetched. What the gate rejects is marked, so that it isn't
    fetched again; an original is saved and marked before its translation, which may fail by itself.
    ``place`` counts the items that a source's run takes; others have none.
    """
    dry = translated is None
    had = seen.select("source_id", "url").distinct().withColumn("_seen", F.lit(True))
    items = discovered.join(had, ["source_id", "url"], "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
    config = sources.select(F.col("id").alias("source_id"), F.col("limit").cast("int").alias("_limit"), F.col("min_content_chars").cast("int").alias("_least"))
    items = _newest(items.join(config, "source_id"), ~F.col("_seen"), discovery.run_limit(F.lit(limit).cast("int"), F.col("_limit"))).drop("published_at")
    page = fetched.select("source_id", "url", F.lit(True).alias("_page"), "title", "content_markdown", F.col("published_at"), F.col("error").alias("_fetch"))
    whole = items.join(page, ["source_id", "url"], "left")
    found = gate.issues(F.col("title"), F.col("content_markdown"), F.col("published_at"), F.col("_least"))
    codes = F.transform(F.filter(found, lambda i: i["severity"] == "error"), lambda i: i["code"])
    arrived = F.col("_taken") & F.coalesce("_page", F.lit(False)) & F.col("_fetch").isNull()
    whole = whole.withColumn("_arrived", arrived).withColumn("_codes", F.when(F.col("_arrived"), codes))
    if dry:
        whole = whole.withColumn("_done", F.lit(False)).withColumn("_why", F.lit(None).cast("string"))
    else:
        done = translated.select("source_id", "url", F.lit(True).alias("_there"), F.col("error").alias("_why"))
        whole = whole.join(done, ["source_id", "url"], "left").withColumn("_done", F.coalesce("_there", F.lit(False)) & F.col("_why").isNull())
    end = (
        F.when(F.col("_seen"), "seen")
        .when(~F.col("_taken"), "over-limit")
        .when(~F.col("_arrived"), "fetch-failed")
        .when(F.size("_codes") > 0, "rejected")
        .when(F.lit(dry), "validated")
        .when(F.col("_done"), "published")
        .otherwise("saved")
    )
    whole = whole.withColumn("disposition", end)
    is_ = lambda *names: F.col("disposition").isin(*names)
    failed = F.when(is_("fetch-failed"), F.coalesce("_fetch", F.lit("no page"))).when(is_("saved"), F.coalesce("_why", F.lit("no translation")))
    code = F.when(is_("rejected"), F.array_join("_codes", ", "))
    return whole.select(
        "source_id",
        "url",
        "place",
        "disposition",
        F.when(is_("rejected"), "integrity").when(is_("fetch-failed", "saved"), "fatal").alias("error_kind"),
        code.alias("error_code"),
        F.when(is_("rejected"), F.concat(F.lit("integrity gate: "), code)).otherwise(failed).alias("error"),
        F.when(F.lit(dry), F.lit(False)).otherwise(is_("rejected", "saved", "published")).alias("marked"),
    )


def update_summary(items: DataFrame) -> DataFrame:
    """(source_id, discovered, pending, processed, failed, status) of a run's items."""
    count = lambda cond: F.count_if(cond)
    failed = F.col("disposition").isin("fetch-failed", "rejected", "saved")
    sums = items.groupBy("source_id").agg(F.count(F.lit(1)).alias("discovered"), count(F.col("disposition") != "seen").alias("pending"), count(F.col("disposition") == "published").alias("processed"), count(failed).alias("failed"))
    return sums.withColumn("status", F.when(F.col("failed") > 0, "partial").otherwise("completed"))


def with_policy(sources: DataFrame, table: DataFrame) -> DataFrame:
    """Sources with ``policy`` (mode, since, max_articles, quality_filter, url_date_pattern): their own, else the table's, else null."""
    own = F.col("backfill")
    mine = F.when(own.isNotNull(), F.struct(F.coalesce(own["mode"], F.lit("all")).alias("mode"), own["since"].alias("since"), own["max_articles"].cast("int").alias("max_articles"), own["quality_filter"].alias("quality_filter"), F.col("url_date_pattern").alias("url_date_pattern")))
    listed = table.select(F.col("source_id").alias("id"), F.struct("mode", "since", F.col("max_articles").cast("int").alias("max_articles"), "quality_filter", "url_date_pattern").alias("_listed"))
    return sources.join(listed, "id", "left").withColumn("policy", F.coalesce(mine, F.col("_listed"))).drop("_listed")


def outside_window(since: Column, published_at: Column, url: Column, url_pattern: Column) -> Column:
    """Whether a fetched page is older than a policy allows: the date in its address counts before the page's.

    Dates that don't parse, and a missing one, are not outside.
    """
    at = D.parse_instant(F.coalesce(D.url_date(url, url_pattern), published_at))
    return F.coalesce((F.trim(F.coalesce(published_at, F.lit(""))) != "") & (at < D.parse_instant(since)), F.lit(False))


def run_backfill(sources: DataFrame, discovered: DataFrame, fetched: DataFrame, cap: int | None = None) -> DataFrame:
    """One row per discovered item: source_id, url, place, disposition, error_code, error, published_at, stats.

    sources: id, policy as ``with_policy`` gives it. discovered and fetched as for ``run_update``.
    Dispositions: skipped-by-date, truncated, fetch-failed, outside-window, rejected, saved.
    """
    config = sources.select(F.col("id").alias("source_id"), "policy")
    items = discovered.join(config, "source_id")
    policy = F.col("policy")
    fits = policy.isNull() | discovery.policy_passes(policy["mode"], policy["since"], F.col("published_at"), F.col("url"), policy["url_date_pattern"])
    items = items.withColumn("_fits", F.coalesce(fits, F.lit(True)))
    items = _newest(items, F.col("_fits"), F.coalesce(F.lit(cap).cast("int"), policy["max_articles"], F.lit(0))).drop("published_at")
    page = fetched.select("source_id", "url", F.lit(True).alias("_page"), "title", "content_markdown", "published_at", F.col("error").alias("_fetch"))
    whole = items.join(page, ["source_id", "url"], "left")
    arrived = F.col("_taken") & F.coalesce("_page", F.lit(False)) & F.col("_fetch").isNull()
    found = gate.issues(F.col("title"), F.col("content_markdown"), F.col("published_at"), promo_filter=F.coalesce(policy["quality_filter"], F.lit(False)))
    codes = F.transform(F.filter(found, lambda i: i["severity"] == "error"), lambda i: i["code"])
    old = (policy["mode"] == "since") & outside_window(policy["since"], F.col("published_at"), F.col("url"), policy["url_date_pattern"])
    whole = whole.withColumn("_arrived", arrived).withColumn("_old", F.coalesce(old, F.lit(False))).withColumn("_codes", F.when(F.col("_arrived"), codes))
    end = F.when(~F.col("_fits"), "skipped-by-date").when(~F.col("_taken"), "truncated").when(~F.col("_arrived"), "fetch-failed").when(F.col("_old"), "outside-window").when(F.size("_codes") > 0, "rejected").otherwise("saved")
    code = F.when(F.col("disposition") == "outside-window", "outside-backfill-window").when(F.col("disposition") == "rejected", F.array_join("_codes", ", "))
    saved = F.col("disposition") == "saved"
    return whole.withColumn("disposition", end).select(
        "source_id",
        "url",
        "place",
        "disposition",
        code.alias("error_code"),
        F.when(F.col("disposition") == "fetch-failed", F.coalesce("_fetch", F.lit("no page"))).otherwise(code).alias("error"),
        F.when(saved, F.col("published_at")).alias("published_at"),
        F.when(saved, T.content_stats(F.coalesce("content_markdown", F.lit("")))).alias("stats"),
    )


def backfill_counters(items: DataFrame) -> DataFrame:
    """One row per source: what was discovered, eligible, skipped, truncated, saved and failed, the span of saved dates, and articles with math, tables, images."""
    one = lambda *names: F.count_if(F.col("disposition").isin(*names))
    day = F.substring(D.normalize_date(F.col("published_at")), 1, 10)
    some = lambda field: F.count_if(F.coalesce(F.col(f"stats.{field}") > 0, F.lit(False)))
    return items.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count_if(F.col("disposition") != "skipped-by-date").alias("eligible"),
        one("skipped-by-date").alias("skipped_by_date"),
        one("truncated").alias("truncated_by_max"),
        one("saved").alias("saved"),
        one("fetch-failed", "outside-window", "rejected").alias("failed"),
        F.min(day).alias("earliest"),
        F.max(day).alias("latest"),
        some("math").alias("math"),
        some("tables").alias("tables"),
        some("images").alias("images"),
    )


def audit(articles: DataFrame) -> DataFrame:
    """Fetched samples (url, title, content_markdown, published_at, language, error) with ``codes``, ``images``, ``passed`` and ``line``.

    A sample that didn't come has the code fetch-or-extraction-failed.
    """
    found = gate.issues(F.col("title"), F.col("content_markdown"), F.col("published_at"))
    codes = F.transform(F.filter(found, lambda i: i["severity"] == "error"), lambda i: i["code"])
    failed = F.col("error").isNotNull()
    undated = F.when(F.trim(F.coalesce("published_at", F.lit(""))) == "", F.array(F.lit("missing-published-date"))).otherwise(F.array().cast("array<string>"))
    rows = articles.withColumn("codes", F.when(failed, F.array(F.lit("fetch-or-extraction-failed"))).otherwise(F.concat(codes, undated)))
    rows = rows.withColumn("images", T.image_urls(F.coalesce("content_markdown", F.lit("")))).withColumn("passed", F.size("codes") == 0)
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("missing"))
    head = F.concat(F.when(F.col("passed"), "PASS ").otherwise("FAIL "), F.col("url"))
    about = F.when(~failed, F.concat(F.lit("\n  title="), F.coalesce("title", F.lit("")), F.lit(" date="), known("published_at"), F.lit(" lang="), known("language"), F.lit(" markdown="), F.length(F.coalesce("content_markdown", F.lit(""))).cast("string"), F.lit(" images="), F.size("images").cast("string")))
    why = F.when(~F.col("passed"), F.concat(F.lit("\n  issues="), F.array_join("codes", ",")))
    return rows.withColumn("line", F.concat(head, F.coalesce(about, F.lit("")), F.coalesce(F.concat(F.lit("\n  error="), F.col("error")), F.lit("")), F.coalesce(why, F.lit(""))))


_REPORT = ("discovered", "eligible", "skipped_by_date", "truncated_by_max", "saved", "failed", "earliest", "latest", "math", "tables", "images")


def backfill_report(counters: DataFrame) -> DataFrame:
    """(source_id, line): each source's counters as a line of a Markdown table, and a line of totals without a source."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    lines = counters.select("source_id", F.concat(F.lit("| "), F.concat_ws(" | ", T.escape_cell(F.col("source_id").cast("string")), *map(cell, _REPORT)), F.lit(" |")).alias("line"))
    sums = counters.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("discovered", "eligible", "saved", "failed")])
    bold = lambda c: F.concat(F.lit("**"), F.col(c).cast("string"), F.lit("**"))
    total = F.concat_ws(" | ", F.lit("| **total**"), bold("discovered"), bold("eligible"), F.lit(""), F.lit(""), bold("saved"), bold("failed"), *[F.lit("")] * 5)
    return lines.unionByName(sums.select(F.lit(None).cast(counters.schema["source_id"].dataType).alias("source_id"), F.concat(total, F.lit(" |")).alias("line")))


def error_lines(items: DataFrame) -> DataFrame:
    """(source_id, url, line): each failed item as an entry of the error ledger."""
    kind = F.when(F.col("disposition").isin("rejected", "outside-window"), "integrity").otherwise("fatal")
    code = F.coalesce(F.concat(F.lit(" ["), F.col("error_code"), F.lit("]")), F.lit(""))
    text = F.concat(F.lit("- **"), kind, F.lit("**"), code, F.lit(" `"), F.col("url").cast("string"), F.lit("`\n  - "), F.coalesce("error", F.lit("")))
    return items.where(F.col("error").isNotNull()).select("source_id", "url", text.alias("line"))


def manifests(items: DataFrame) -> DataFrame:
    """(source_id, place, value): the items that a backfill took, as JSON, for a sink partitioned by source."""
    taken = items.where(~F.col("disposition").isin("skipped-by-date", "truncated"))
    return taken.select("source_id", "place", F.to_json(F.struct("source_id", "place", "url", "disposition", "error_code", "published_at")).alias("value"))


def failure_report(created_at: Column, message: Column, stack: Column) -> Column:
    """What is left of a run that broke off, as JSON."""
    return F.to_json(F.struct(F.lit(1).alias("version"), created_at.alias("createdAt"), F.struct(message.alias("message"), stack.alias("stack")).alias("fatalError")))


def sync_state(received: DataFrame, stored: DataFrame) -> DataFrame:
    """``received`` articles (source_id, original_url) with ``created``: whether no stored one has their key."""
    had = stored.select("source_id", "original_url").distinct().withColumn("_had", F.lit(True))
    return received.join(had, ["source_id", "original_url"], "left").withColumn("created", F.col("_had").isNull()).drop("_had")


def missing_sources(received: DataFrame, *known: DataFrame) -> DataFrame:
    """(id): sources of the received articles that neither the payload nor the store has."""
    ids = received.select(F.col("source_id").alias("id")).distinct()
    for some in known:
        ids = ids.join(some.select("id"), "id", "left_anti")
    return ids


def run_sync(received: DataFrame, sources: DataFrame, stored: DataFrame, stored_sources: DataFrame, batch: int = BATCH) -> DataFrame:
    """One row: ok, received, created, updated, statements, batches, missing.

    received: source_id, original_url, versions (array), categories (array or null: they stay).
    sources: id. A sync whose articles name unknown sources writes nothing: ``missing`` has how many.
    Statements: one for each source, article and version, and for given categories one to clear and
    two for each.
    """
    gaps = missing_sources(received, sources, stored_sources).agg(F.count(F.lit(1)).alias("missing"))
    each = 1 + F.greatest(F.size("versions"), F.lit(0)) + F.when(F.col("categories").isNotNull(), 1 + 2 * F.size("categories")).otherwise(0)
    sums = sync_state(received, stored).agg(F.count(F.lit(1)).alias("received"), F.count_if("created").alias("created"), F.count_if(~F.col("created")).alias("updated"), F.coalesce(F.sum(each), F.lit(0)).alias("own"))
    total = sources.agg(F.count(F.lit(1)).alias("sources"))
    row = sums.crossJoin(total).crossJoin(gaps)  # three single rows
    ok, statements = F.col("missing") == 0, F.col("own") + F.col("sources")
    zero = lambda c: F.when(ok, c).otherwise(F.lit(0)).cast("long")
    return row.select(ok.alias("ok"), "received", zero(F.col("created")).alias("created"), zero(F.col("updated")).alias("updated"), zero(statements).alias("statements"), zero(F.ceil(statements / batch)).alias("batches"), "missing")


def payload_sources(registry: DataFrame) -> DataFrame:
    """Registry entries as a payload's sources: (id, value), without empty optional fields."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    fields = [F.col(c).alias(name) for c, name in (("id", "id"), ("name", "name"), ("type", "type"), ("homepage_url", "homepageUrl"), ("blog_url", "blogUrl"), ("domain", "domain"))]
    optional = [some(c).alias(name) for c, name in (("rss_url", "rssUrl"), ("sitemap_url", "sitemapUrl")) if c in registry.columns]
    return registry.select("id", F.to_json(F.struct(*fields, *optional)).alias("value"))


def payload_articles(versions: DataFrame) -> DataFrame:
    """Parsed version files as a payload's articles: (id, value), JSON with nested versions and the union of their categories.

    The version with the first language gives what an article has once. An article without address,
    domain or date is an error in its row (``error``).
    """
    date = F.when(F.col("published_at").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat("published_at", F.lit("T00:00:00.000Z"))).otherwise(D.iso_instant(D.parse_instant(F.col("published_at"))))
    one = F.struct("language", "title", F.col("content_markdown").alias("contentMarkdown"), "provenance", F.col("version_at").alias("updatedAt"))
    head = F.struct("language", F.col("blog_id").alias("sourceId"), F.col("original_url").alias("originalUrl"), F.coalesce("original_language", F.lit("en")).alias("originalLanguage"), date.alias("publishedAt"), F.nullif("image_url", F.lit("")).alias("imageUrl"), F.nullif("author", F.lit("")).alias("author"), F.col("source_domain").alias("sourceDomain"))
    # an article has a version for each language at most
    grouped = versions.groupBy("article_id").agg(F.min(head).alias("h"), F.sort_array(F.collect_list(one)).alias("versions"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("categories", F.array().cast("array<string>"))))).alias("categories"))
    fields = [F.col(f"h.{c}").alias(c) for c in ("sourceId", "originalUrl", "originalLanguage", "publishedAt", "imageUrl", "author", "sourceDomain")]
    gaps = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"h.{c}"), F.lit("")) == "", F.lit(c)) for c in ("originalUrl", "sourceDomain", "publishedAt")])), ", ")
    value = F.to_json(F.struct(F.col("article_id").alias("id"), *fields, F.sort_array("categories").alias("categories"), "versions"))
    return grouped.select(F.col("article_id").alias("id"), F.when(gaps == "", value).alias("value"), F.when(gaps != "", F.concat(F.lit("missing: "), gaps)).alias("error"))


def unique_slugs(articles: DataFrame, taken: DataFrame) -> DataFrame:
    """New articles (source_id, url, seq) with ``id``; where an id is taken, ``-2`` and so on follow in the order of ``seq``.

    taken: id, url. An address that is stored already keeps its id and isn't ``created``. Of equal
    new addresses the first counts.
    """
    keyed = articles.withColumn("_base", U.article_id(F.col("source_id").cast("string"), F.col("url")))
    first = discovery.first_per_key(keyed, ["source_id", "url"], "seq")
    old = taken.select(F.col("url").alias("_url"), F.col("id").alias("_id"))
    mine = first.join(old, first["url"] == old["_url"], "left")
    stored = mine.where("_id is not null").select("source_id", "url", "seq", F.col("_id").alias("id"), F.lit(False).alias("created"))
    # the numbers of a base that are taken: the base itself is 1
    number = F.regexp_extract("id", r"-(\d{1,6})$", 1)
    stem = F.regexp_replace("id", r"-\d{1,6}$", "")
    names = taken.select("id").distinct()
    suffixed = names.select(stem.alias("_base"), number.try_cast("int").alias("_k")).where("_k >= 2")
    used = names.select(F.col("id").alias("_base"), F.lit(1).alias("_k")).union(suffixed).groupBy("_base").agg(F.sort_array(F.collect_set("_k")).alias("_used"))
    turn = F.row_number().over(Window.partitionBy("_base").orderBy("seq", "url"))
    fresh = mine.where("_id is null").withColumn("_n", turn).join(used, "_base", "left")
    # before the i-th used number u lie u - i free ones: it pushes on all turns beyond them
    before = F.transform(F.coalesce("_used", F.array().cast("array<int>")), lambda u, i: u - i - 1)
    k = F.col("_n") + F.size(F.filter(before, lambda x: x < F.col("_n")))
    made = fresh.select("source_id", "url", "seq", F.when(k == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), k.cast("string"))).alias("id"), F.lit(True).alias("created"))
    return stored.unionByName(made)


def official_version(items: DataFrame) -> DataFrame:
    """Items with the page that is taken: ``url``, ``language``, ``official_zh_url``, ``content_source``.

    items: original_url, original_language, zh_url, zh_language (null where no page came), prefer
    (whether an official version is wanted). A Chinese version's own address is then the page's, and the
    original's stands beside it.
    """
    native = F.col("original_language") == "zh"
    official = ~native & F.coalesce("prefer", F.lit(False)) & F.coalesce((F.col("zh_url") != F.col("original_url")) & (F.col("zh_language") == "zh"), F.lit(False))
    return items.select(
        *items.columns,
        F.when(official, F.col("zh_url")).otherwise(F.col("original_url")).alias("url"),
        F.when(official, F.col("zh_language")).otherwise(F.col("original_language")).alias("language"),
        F.when(official, F.col("original_url")).alias("official_zh_url"),
        F.when(native, "native-zh").when(official, "official-zh").alias("content_source"),
    )

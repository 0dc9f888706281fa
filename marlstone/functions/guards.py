"""Small checks and formats around runs and payloads, as native Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.core import let
from marlstone.functions.dates import normalize_date, parse_instant, url_date, visible_date
from marlstone.functions.json import dot_path
from marlstone.functions.text import normalize_article
from marlstone.functions.urls import directory_base, resolve_url

#: Milliseconds that a reply may ask to wait at most.
MAX_WAIT = 60_000
#: Characters of an extracted text at least.
MIN_EXTRACTED = 200


def allowed_statement(statement: Column) -> Column:
    """Whether a text is one INSERT, REPLACE, UPDATE or DELETE; a semicolon may only end it. Blank texts pass."""
    bare = F.regexp_replace(F.regexp_replace(statement, r"^\s+|\s+$", ""), r";\s*$", "")
    return let(bare, lambda s: (s == "") & ~statement.contains(";") | s.rlike(r"^(?i)(?:INSERT|REPLACE|UPDATE|DELETE)\b") & ~s.contains(";"))


def sql_literal(value: Column) -> Column:
    """A quoted SQL text, NULL for null."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(value.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def upsert_statement(table: str, values: dict[str, Column], keys: tuple[str, ...], updates: dict[str, str] | None = None) -> Column:
    """An INSERT of a row that updates the row with its keys, where there is one: all other columns, or ``updates`` (column to SQL)."""
    changed = updates if updates is not None else {c: f"excluded.{c}" for c in values if c not in keys}
    tail = f") ON CONFLICT({', '.join(keys)}) DO " + (f"UPDATE SET {', '.join(f'{c}={x}' for c, x in changed.items())};" if changed else "NOTHING;")
    return F.concat(F.lit(f"INSERT INTO {table} ({', '.join(values)}) VALUES ("), F.concat_ws(", ", *map(sql_literal, values.values())), F.lit(tail))


def first_commit_date(reply: Column) -> Column:
    """The date of a file's first commit from a host's list of commits, which has the newest first; an empty text without one."""
    commits = F.from_json(reply, "array<struct<commit:struct<committer:struct<date:string>>>>")
    return F.coalesce(normalize_date(F.try_element_at(commits, F.lit(-1))["commit"]["committer"]["date"]), F.lit(""))


def proxy_settings(environment: dict[str, str]) -> dict:
    """Whether and where a proxy is used, from USE_PROXY (true or false), PROXY_URL and NO_PROXY; anything else is an error."""
    used = environment.get("USE_PROXY", "false").strip()
    if used not in ("true", "false"):
        raise ValueError("USE_PROXY must be true or false")
    url = environment.get("PROXY_URL", "http://127.0.0.1:7897").strip()
    if used == "true" and not url.lower().startswith(("http://", "https://")):
        raise ValueError(f"PROXY_URL {url} is not an http(s) address")
    hosts = [h.removeprefix("www.") for h in environment.get("NO_PROXY", "").lower().replace(",", " ").split()]
    return {"enabled": used == "true", "url": url, "no_proxy": hosts}


def retry_after(header: Column, now: Column) -> Column:
    """Milliseconds that a Retry-After header asks for, as seconds or as a date; null for others."""
    text = F.trim(header)
    seconds = F.when(text.rlike(r"^\+?(?:\d+\.?\d*|\.\d+)$"), text.cast("double") * 1000)
    until = (F.unix_millis(parse_instant(text)) - F.unix_millis(now)).cast("double")
    wait = F.coalesce(seconds, F.when(until.isNotNull(), F.greatest(until, F.lit(0.0))))
    return F.when((header != "") & wait.isNotNull(), F.least(wait, F.lit(float(MAX_WAIT)))).cast("long")


def private_host(host: Column) -> Column:
    """Whether a host is this machine or in a private network."""
    name = F.regexp_replace(F.lower(host), r"^\[|\]$", "")
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    four = rf"^(?:10|127|169\.254|172\.(?:1[6-9]|2\d|3[01])|192\.168)\."
    whole = rf"^{octet}(?:\.{octet}){{3}}$"
    return let(name, lambda h: (h == "localhost") | h.endswith(".local") | (h.rlike(whole) & h.rlike(four)) | (h.contains(":") & h.rlike(r"^(?:::1$|fc|fd|fe80:)")))


def no_proxy_entries(value: Column) -> Column:
    """A NO_PROXY text as its hosts."""
    parts = F.transform(F.split(F.lower(value), r"[\s,]+"), lambda e: F.regexp_replace(e, r"^www\.", ""))
    return F.filter(parts, lambda e: e != "")


def bypasses_proxy(host: Column, entries: Column) -> Column:
    """Whether a host (without ``www.``) is one of the entries or below one; ``*`` holds all."""
    return F.exists(entries, lambda e: (e == "*") | (host == e) | host.endswith(F.concat(F.lit("."), e)))


def same_token(a: Column, b: Column) -> Column:
    """Whether two secrets are equal, by their digests."""
    return F.sha2(a, 256) == F.sha2(b, 256)


def too_short(text: Column, least: Column | None = None) -> Column:
    """An error for an extracted text of too few characters, white space collapsed; else null."""
    size = F.length(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    need = F.coalesce(least, F.lit(MIN_EXTRACTED)) if least is not None else F.lit(MIN_EXTRACTED)
    return F.when(size < need, F.concat(F.lit("extracted content too short ("), size.cast("string"), F.lit(" chars, minimum "), need.cast("string"), F.lit(")")))


def page_date(url: Column, url_pattern: Column, extracted: Column, discovered: Column, text: Column, git: Column) -> Column:
    """The page's date where an extractor gives one: from the address, the extractor, the discovery as it stands, the text, the repository."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(some(url_date(url, url_pattern)), some(extracted), some(discovered), some(visible_date(text)), some(git), F.lit(""))


def api_article(reply: Column, url: Column, title: Column, published_at: Column, language: Column, paths: dict[str, str], least: Column | None = None) -> Column:
    """A struct of an article in a JSON reply: title, author, image_url, published_at, language, content_markdown, error.

    ``paths``: dot paths by field (content, title, author, image, published_at, language). Fields
    without one, or whose path leads nowhere, are looked up beside the content; title, date and
    language fall back to what discovery knows.
    """
    beside = paths.get("content", "").rpartition(".")[0] if paths else ""
    # What the fields are called beside the content.
    names = {"content": "content", "title": "title", "author": "author", "image": "coverImage", "language": "lang"}

    def field(name: str) -> Column:
        own = dot_path(reply, paths[name]) if name in paths else F.lit(None).cast("string")
        return F.coalesce(own, dot_path(reply, f"{beside}.{names[name]}" if beside else names[name])) if name in names else own

    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    raw = F.coalesce(field("published_at"), published_at)
    seconds = raw.rlike(r"^\d+(?:\.\d+)?$")
    date = F.when(seconds, F.date_format(F.timestamp_seconds(raw.try_cast("double")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(normalize_date(raw))
    body = normalize_article(F.trim(field("content")))
    tag = F.lower(F.trim(field("language")))
    fallback = F.nullif(F.lower(F.regexp_extract(language, r"^([^_-]*)", 1)), F.lit(""))
    need = F.coalesce(least, F.lit(MIN_EXTRACTED)) if least is not None else F.lit(MIN_EXTRACTED)
    parts = F.struct(
        F.coalesce(some(field("title")), some(title)).alias("title"),
        some(field("author")).alias("author"),
        some(field("image")).alias("image_url"),
        F.coalesce(date, F.lit("")).alias("published_at"),
        F.coalesce(F.when(tag.rlike("^[a-z]{2}$"), tag), fallback, F.lit("en")).alias("language"),
        body.alias("content_markdown"),
    )

    def checked(v: Column) -> Column:
        size = F.length(F.regexp_replace(F.coalesce(v["content_markdown"], F.lit("")), r"\s+", " "))
        error = F.when(F.coalesce(v["content_markdown"], F.lit("")) == "", F.lit("api detail returned no content")).when(size < need, F.concat(F.lit("api content too short (minimum "), need.cast("string"), F.lit(" chars)"))).when(v["title"].isNull(), F.lit("no title found in api detail"))
        return F.struct(*[v[c].alias(c) for c in ("title", "author", "image_url", "published_at", "language", "content_markdown")], error.alias("error"))

    return let(parts, checked)


def request_value(template: Column, api_id: Column, language: Column) -> Column:
    """A value of a request, as JSON: ``{id}`` alone becomes a number where the id is one; ``{id}`` and ``{lang}`` are replaced in other texts."""
    text = F.replace(F.replace(template, F.lit("{id}"), F.coalesce(api_id, F.lit(""))), F.lit("{lang}"), language)
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    return F.when((template == "{id}") & api_id.rlike(r"^\d+$"), F.regexp_replace(api_id, r"^0+(?=\d)", "")).otherwise(quoted(text))


def absolute_markdown(markdown: Column, url: Column) -> Column:
    """Markdown with relative targets of images and links resolved against the page's folder; titles of those go, all else stays."""
    base = directory_base(url)
    target = r"!?\[[^\]]*\]\([^)\s]+(?:\s+\"[^\"]*\")?\)"
    # text between targets, and targets, in turn
    pieces = F.split(F.regexp_replace(markdown, rf"({target})", "\u0001$1\u0001"), "\u0001")

    def one(piece: Column) -> Column:
        ref = F.regexp_extract(piece, rf"^(?s)!?\[[^\]]*\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)$", 1)
        fixed = ref.rlike(r"^(?i)(?:https?:|data:|blob:|mailto:|#)") | (~piece.startswith("!") & ref.rlike("^(?i)javascript:"))
        found = resolve_url(ref, base)
        head = F.regexp_extract(piece, r"^(?s)(!?\[[^\]]*\]\()", 1)
        return F.when((ref != "") & ~fixed & F.coalesce(found.rlike(r"^(?i)https?://[^/?#\s]+"), F.lit(False)), F.concat(head, found, F.lit(")"))).otherwise(piece)

    return F.when(markdown.isNotNull(), F.array_join(F.transform(pieces, one), ""))


def collection_defaults(row: dict[str, Column]) -> Column:
    """A struct of an article's header with the collection's defaults, and ``error`` naming what it can't be read without.

    Dates are read as dates, a missing original language is ``en``, categories and ``demo`` are empty and false.
    """
    get = lambda name: F.nullif(F.trim(row[name]), F.lit("")) if name in row else F.lit(None).cast("string")
    url = lambda c: c.isNull() | c.rlike(r"^(?i)[a-z][a-z0-9+.\-]*:\S+$")
    language, provenance = get("language"), get("provenance")
    checks = {
        "blog_id": get("blog_id").isNotNull(),
        "original_url": get("original_url").isNotNull() & url(get("original_url")),
        "language": language.isin("en", "zh-cn"),
        "title": get("title").isNotNull(),
        "published_at": parse_instant(get("published_at")).isNotNull(),
        "source_domain": get("source_domain").isNotNull(),
        "original_language": F.length(F.coalesce(get("original_language"), F.lit("en"))) >= 2,
        "provenance": provenance.isin("original", "official-zh", "native-zh", "model"),
        "version_at": parse_instant(get("version_at")).isNotNull(),
        "image_url": url(get("image_url")),
        "original_alt_url": url(get("original_alt_url")),
    }
    faults = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return F.struct(
        *[get(name).alias(name) for name in ("blog_id", "original_url", "language", "title", "source_domain", "provenance", "image_url", "author")],
        F.to_date(parse_instant(get("published_at"))).alias("published_at"),
        F.coalesce(get("original_language"), F.lit("en")).alias("original_language"),
        F.coalesce(row["categories"] if "categories" in row else F.lit(None).cast("array<string>"), F.array().cast("array<string>")).alias("categories"),
        F.coalesce(F.lower(get("demo")) == "true", F.lit(False)).alias("demo"),
        F.when(F.size(faults) > 0, F.array_join(faults, ", ")).alias("error"),
    )

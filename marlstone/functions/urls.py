"""URL functions as native Columns: canonical form, resolution, article predicates, slugs and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.core import let

# Query keys that only track where a visitor came from (besides utm_*).
TRACKING_KEYS = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "_hsenc", "_hsmi", "policyid", "traceid", "frompage", "amp")

# Path patterns of pages that aren't articles.
NON_ARTICLE_PATHS = (
    r"/(?:feed|rss|atom)(?:/|$)",
    r"/(?:tag|tags|category|categories|author|authors)(?:/|$)",
    r"/(?:page|search)(?:/|$)",
    r"/(?:careers?|jobs|about|about-us|company|team|contact|help|support)(?:/|$)",
    r"/(?:legal|privacy|terms|press|newsroom|media|pricing)(?:/|$)",
    r"/(?:index|default)\.html?$",
    r"\.(?:xml|json|txt|jpg|jpeg|png|gif|webp|svg|pdf|zip)$",
)

_ABSOLUTE = r"^(?i)(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _ABSOLUTE, group)


def remove_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in an absolute path; a trailing one leaves a slash."""
    segments = F.slice(F.split(path, "/"), 2, 1_000_000)
    ends = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))),
    )
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, ends).otherwise(F.lit("")))).otherwise(path)


def resolve_url(value: Column, base: Column) -> Column:
    """Absolute form of a reference against a base; other schemes than http(s) stay as they are."""
    trimmed = F.regexp_replace(F.regexp_replace(value, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    return let(F.struct(trimmed.alias("ref"), base.alias("base")), lambda v: _resolved(v["ref"], v["base"]))


def _resolved(ref: Column, base: Column) -> Column:
    origin = F.regexp_extract(base, r"^(?i)(https?://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^(?i)(https?:)", 1)
    path = F.regexp_extract(base, _ABSOLUTE, 3)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    query = F.regexp_extract(base, _ABSOLUTE, 4)
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(base.isNull() | (origin == ""), F.lit(None).cast("string"))
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(ref.startswith("/"), F.concat(origin, ref))
        .when(ref.startswith("?"), F.concat(origin, path, ref))
        .when((ref == "") | ref.startswith("#"), F.concat(origin, path, query, ref))
        .otherwise(F.concat(origin, folder, ref))
    )


def canonicalize_url(value: Column, base: Column | None = None) -> Column:
    """One form for all spellings of a page's address; null where it isn't http(s).

    ``&amp;`` is read as ``&``; the scheme becomes https, the host lower case without a default port;
    the fragment and tracking keys go; other parameters are sorted (in binary order) by key and
    value; slashes collapse and trailing ones go. Characters are not percent-encoded anew.
    """
    decoded = F.regexp_replace(value, "(?i)&amp;", "&")
    return let(resolve_url(decoded, base if base is not None else F.lit(None).cast("string")), _canonical)


def _canonical(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_replace(_part(url, 2), r"^.*@", "")), r":(?:443|80)?$", "")
    user = F.regexp_replace(F.regexp_extract(_part(url, 2), r"^(.*@)", 1), r"^:?@$", "")
    raw = _part(url, 3)
    whole = let(F.when(raw == "", F.lit("/")).otherwise(raw), remove_dot_segments)
    path = let(F.regexp_replace(whole, r"/{2,}", "/"), lambda p: F.when(F.length(p) > 1, F.regexp_replace(p, r"/+$", "")).otherwise(p))
    pairs = F.transform(
        F.filter(F.split(F.regexp_replace(_part(url, 4), r"^\?", ""), "&"), lambda p: p != ""),
        lambda p: F.struct(F.regexp_extract(p, r"^([^=]*)", 1).alias("k"), F.regexp_replace(p, r"^[^=]*=?", "").alias("v")),
    )
    kept = F.filter(pairs, lambda p: ~(F.lower(p["k"]).startswith("utm_") | F.lower(p["k"]).isin(*TRACKING_KEYS)))
    query = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    search = let(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    good = url.rlike(r"^(?i)https?://[^/?#\s]+") & (host != "") & ~host.rlike(r"[\s<>^|\[\]]")
    return F.when(good, F.concat(F.lit("https://"), user, host, path, search))


def absolute_http_url(value: Column, base: Column) -> Column:
    """The resolved address if it is http(s), else null."""
    return let(resolve_url(value, base), lambda url: F.when(url.rlike(r"^(?i)https?://[^/?#\s]+"), url))


def host_of(url: Column) -> Column:
    """Lower-case host without port and leading ``www.``; null without one."""
    host = F.regexp_replace(F.regexp_replace(F.lower(_part(url, 2)), r"^.*@|:\d*$", ""), r"^www\.", "")
    return let(host, lambda h: F.when(h != "", h))


def path_of(url: Column) -> Column:
    return let(_part(url, 3), lambda path: F.when(path == "", F.lit("/")).otherwise(path))


def is_likely_article(url: Column, domain: Column, allow_non_article: Column | None = None) -> Column:
    """An address under the source's domain whose path can be an article's."""
    expected = F.regexp_extract(F.regexp_replace(F.regexp_replace(domain, r"^https?://", ""), r"^www\.", ""), r"^([^/]*)", 1)
    allowed = F.coalesce(allow_non_article, F.lit(False)) if allow_non_article is not None else F.lit(False)
    parts = F.struct(url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), expected.alias("expected"))

    def test(v: Column) -> Column:
        inside = (v["host"] == v["expected"]) | v["host"].endswith(F.concat(F.lit("."), v["expected"]))
        blocked = v["path"].rlike("(?i)" + "|".join(NON_ARTICLE_PATHS))
        return ~v["url"].rlike(r"(?i)%7b|%7d|[{}]") & inside & (v["path"] != "/") & (F.length(v["path"]) >= 4) & (allowed | ~blocked)

    return F.coalesce(let(parts, test), F.lit(False))


def _path_matches(path: Column, prefixes: Column, bare: bool) -> Column:
    """Whether any entry matches: ``^...`` as a pattern, else as a folder (with ``bare``, itself included).

    Patterns must be valid: the registry reports others (``valid_pattern``) and they're removed there.
    """

    def one(entry: Column) -> Column:
        folder = F.regexp_replace(entry, r"/+$", "")
        under = path.startswith(F.concat(folder, F.lit("/")))
        return F.when(entry.startswith("^"), F.regexp_like(path, entry)).otherwise((path == folder) | under if bare else under)

    return F.coalesce(F.exists(prefixes, one), F.lit(False))


def is_candidate(url: Column, domain: Column, article_paths: Column, exclude_paths: Column, allow_non_article: Column | None = None) -> Column:
    """Likely articles that no exclusion matches and, where there is an allow-list, one of its entries does."""
    listed = F.coalesce(F.size(article_paths), F.lit(0)) > 0
    paths = let(F.regexp_replace(path_of(url), r"/+$", ""), lambda path: ~_path_matches(path, exclude_paths, True) & (~listed | _path_matches(path, article_paths, False)))
    return is_likely_article(url, domain, allow_non_article) & paths


def slug_part(value: Column) -> Column:
    """Lower-case ASCII letters and digits joined by hyphens, 56 at most. (Accents are folded for Latin-1 letters.)"""
    plain = F.translate(F.lower(value), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 56)


def article_slug(url: Column) -> Column:
    """Slug of the last path segment, without file extension and leading date."""
    last = let(F.regexp_extract(path_of(url), r"([^/]+)/*$", 1), lambda x: F.when(x == "", F.lit("article")).otherwise(x))
    some = lambda x: F.when(x == "", F.lit("article")).otherwise(x)
    stem = let(slug_part(F.regexp_replace(last, r"(?i)\.[a-z0-9]{1,8}$", "")), some)
    return let(F.regexp_replace(stem, r"^\d{4}-\d{2}-\d{2}-", ""), some)


def article_id(source_id: Column, url: Column) -> Column:
    source = let(slug_part(source_id), lambda x: F.when(x == "", F.lit("source")).otherwise(x))
    return F.concat(source, F.lit("/"), article_slug(url))


def blog_of_id(article: Column) -> Column:
    """The part of an article id before its first slash."""
    return F.split_part(article, F.lit("/"), F.lit(1))


def drop_language(path: Column) -> Column:
    """``blog/lang/slug`` (with or without .md) to ``blog/slug``, where a slug may have folders; shorter paths as they are."""
    bare = F.regexp_replace(path, r"\.md$", "")
    return F.regexp_replace(bare, r"^([^/]*)/[^/]*/(?=.)", "$1/")


def directory_base(url: Column) -> Column:
    """The address with a slash added, unless its last segment has a file extension of up to eight characters."""
    path = path_of(url)
    bare = F.regexp_extract(url, r"^([^?#]*)", 1)
    return F.when(path.endswith("/") | path.rlike(r"\.[A-Za-z0-9]{1,8}$"), url).otherwise(F.concat(bare, F.lit("/"), F.regexp_replace(url, r"^[^?#]*", "")))


def is_external(url: Column, base: Column) -> Column:
    """An http(s) address of another origin."""
    origin = lambda u: F.lower(F.regexp_extract(u, r"^(?i)(https?://[^/?#]*)", 1))
    return url.rlike("^(?i)https?://") & (origin(url) != origin(base))


def safe_asset(url: Column) -> Column:
    """Addresses that an image may have: http(s) or inline image data."""
    return F.when(url.rlike(r"^(?i)(?:https?://|data:image/)"), url)


def safe_link(url: Column) -> Column:
    """Addresses that a link may have: http(s), mailto or a fragment; relative ones stay."""
    return F.when(url.rlike(r"^(?i)(?:https?:|mailto:|#)") | ~url.rlike(r"^\s*[A-Za-z][A-Za-z0-9+.\-]*:"), url)


def join_site(base: Column, path: Column) -> Column:
    """A site's base and a path with one slash between; absolute and inline addresses pass."""
    return F.when(path.rlike(r"^(?i)(?:https?:|data:)"), path).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", "")))


def image_proxy(proxy: str, url: Column, width: int | None = None) -> Column:
    """An image through a proxy that takes the address without its scheme, and a width."""
    target = F.concat(F.lit(f"{proxy}?url="), F.url_encode(F.regexp_replace(url, r"^(?i)https?://", "")))
    return F.concat(target, F.lit(f"&w={width}")) if width else target


def map_path(url: Column, path_map: Column) -> Column:
    """The address under the first entry of a map of path prefixes that holds its path, with a slash at its end; null without one.

    Slashes at the ends of paths and prefixes don't count; a query and a fragment stay.
    """
    bare = lambda c: F.regexp_replace(c, r"/+$", "")
    parts = F.struct(
        bare(path_of(url)).alias("path"),
        F.transform(F.map_entries(path_map), lambda e: F.struct(bare(e["key"]).alias("key"), bare(e["value"]).alias("value"))).alias("map"),
        F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?i)(https?://[^/?#]*)", 1)), r":(?:443|80)?$", "").alias("origin"),
        F.regexp_extract(url, r"^[^?#]*((?s).*)$", 1).alias("rest"),
    )

    def mapped(v: Column) -> Column:
        hit = F.get(F.filter(v["map"], lambda e: (v["path"] == e["key"]) | v["path"].startswith(F.concat(e["key"], F.lit("/")))), F.lit(0))
        return let(hit, lambda e: F.when(e.isNotNull() & (v["origin"] != ""), F.concat(v["origin"], e["value"], F.substr(v["path"], F.length(e["key"]) + 1), F.lit("/"), v["rest"])))

    return let(parts, mapped)


def encode_part(value: Column) -> Column:
    """Percent-encoded for a part of an address: letters, digits and ``-_.!~*'()`` stay."""
    out = F.url_encode(value)
    for code, sign in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def fill_template(template: Column, **values: Column) -> Column:
    """``{name}`` replaced by each value."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def git_file_path(template: Column, url: Column, strip: Column) -> Column:
    """A repository path from ``{pathname}`` and ``{slug}``, with a prefix taken off the path."""
    path = F.regexp_replace(path_of(url), r"^/+|/+$", "")
    prefix = F.regexp_replace(F.coalesce(strip, F.lit("")), r"^/+|/+$", "")
    rest = F.when((prefix != "") & path.startswith(F.concat(prefix, F.lit("/"))), F.substr(path, F.length(prefix) + 2)).otherwise(path)
    return fill_template(template, pathname=rest, slug=F.element_at(F.split(rest, "/"), -1))

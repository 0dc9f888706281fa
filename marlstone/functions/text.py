"""Markdown text functions as native Columns: plain text, excerpts, counts, gate patterns, frontmatter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.core import let

#: White space as browsers see it: Java's and RE2's own class is ASCII only.
SPACE = r"[\s\x{00a0}\x{3000}\x{feff}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}]"

# The categories an article may have, in their order.
CATEGORIES = ("AI", "Agent", "AI Coding / Developer Tools", "Research", "Engineering / Infrastructure", "Internet / Technology", "Personal Growth", "Other")

# Marks of unfinished or leaked text outside code, and whether they block.
PLACEHOLDERS = (
    ("template-placeholder", r"\{\{\s*[a-z][a-z0-9_-]*\s*\}\}", "warn"),
    ("lorem-ipsum", r"(?i)lorem ipsum", "error"),
    ("todo-marker", r"(?i)(?<![A-Za-z0-9_])(?:TODO|TBD|FIXME|XXX)(?![A-Za-z0-9_])", "warn"),
    ("empty-link", r"\[[^\]]*\]\(\s*\)", "error"),
    ("empty-image", r"!\[[^\]]*\]\(\s*\)", "error"),
)

# Signs of recordings and promotions, for sources that ask for the filter.
PROMOTIONS = (
    ("livestream-transcript", r"(?i)generate transcript"),
    ("livestream-recording", r"(?i)a recording from .* live video"),
    ("paid-episode-paywall", r"(?i)paid episode"),
    ("event-deadline", r"(?i)(?:in|only)\s+\d+\s+days?.*(?:deadline|to book|to lock|ends?)"),
)

MIN_CONTENT, NAV_LINKS, EXCERPT, CJK_SHARE, LONG_ROUTE = 200, 3, 180, 0.5, 100_000

_FENCE = r"```[\s\S]*?```"
_IMAGE = r"!\[[^\]]*\]\([^)]*\)"


def trim(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def strip_code_blocks(markdown: Column) -> Column:
    return F.regexp_replace(markdown, _FENCE, " ")


def plain_text(markdown: Column) -> Column:
    """Without fences, images, link targets and marks; white space collapsed."""
    text = F.regexp_replace(strip_code_blocks(markdown), _IMAGE, " ")
    text = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return trim(F.regexp_replace(F.regexp_replace(text, r"[#>*_`~|\-]", " "), rf"{SPACE}+", " "))


def truncate(text: Column, most: int) -> Column:
    """Cut to ``most`` characters, with an ellipsis where something was cut."""
    return let(text, lambda t: F.when(F.length(t) > most, F.concat(trim(F.substring(t, 1, most)), F.lit("…"))).otherwise(t))


def excerpt(markdown: Column, most: int = EXCERPT) -> Column:
    return truncate(plain_text(markdown), most)


def content_stats(markdown: Column) -> Column:
    """struct(math, tables, code_blocks, images): math spans, table rows, pairs of fences, images."""
    rows = F.regexp_count(markdown, F.lit(r"(?m)^\s*\|[^\n]+\|\s*$"))
    return F.struct(
        F.regexp_count(markdown, F.lit(r"\$\$[\s\S]*?\$\$|\$[^$\n]+\$")).alias("math"),
        rows.alias("tables"),
        (F.regexp_count(markdown, F.lit("```")) / 2).alias("code_blocks"),
        F.regexp_count(markdown, F.lit(_IMAGE)).alias("images"),
    )


def extract_math_stats(markdown: Column) -> Column:
    """struct(inline, display, preview) of an extraction's result."""
    display = F.regexp_count(markdown, F.lit(r"\$\$[\s\S]+?\$\$"))
    inline = F.regexp_count(F.regexp_replace(markdown, r"\$\$[\s\S]+?\$\$", " "), F.lit(r"\$[^$\n]+\$"))
    return F.struct(inline.alias("inline"), display.alias("display"), F.substring(markdown, 1, 300).alias("preview"))


def image_urls(markdown: Column) -> Column:
    """Distinct image addresses in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(markdown, F.lit(r"!\[[^\]]*\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"), F.lit(1)))


def normalize_article(markdown: Column) -> Column:
    """Unix line ends; no related-links section, slide counters or named logos; blank lines collapsed."""
    text = F.regexp_replace(markdown, r"\r\n?", "\n")
    heading = r"(?im)^[ \t]*#{1,6}\s+(?:\*{1,2})?(?:related(?:\s+(?:content|articles?|posts?))?|you may also like|相关阅读|相关内容|推荐阅读)(?:\*{1,2})?\s*$[\s\S]*"
    text = F.regexp_replace(text, heading, "")
    text = F.regexp_replace(text, r"(?:^|\n)\s*\d{1,2}\s*/\s*(?:\n\s*)?\d{1,2}\s*(?=\n|$)", "\n")
    text = F.regexp_replace(text, r"(?i)!\[\s*logo\s*\]", "![logo]")
    return trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def cjk_ratio(text: Column) -> Column:
    """Share of Chinese characters and punctuation among those and Latin letters; 0 without either."""
    cjk = F.regexp_count(text, F.lit(r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3000}-\x{303f}]"))
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    return let(F.struct(cjk.alias("cjk"), (cjk + latin).alias("all")), lambda n: F.when(n["all"] > 0, n["cjk"] / n["all"]).otherwise(F.lit(0.0)))


def translation_mode(markdown: Column, official: Column, threshold: float = CJK_SHARE) -> Column:
    return F.when(F.coalesce(official, F.lit(False)), F.lit("official-zh")).when(cjk_ratio(markdown) >= threshold, F.lit("native-zh")).otherwise(F.lit("translate"))


def translator_route(markdown: Column, force_chunked: Column | None = None) -> Column:
    forced = F.coalesce(force_chunked, F.lit(False)) if force_chunked is not None else F.lit(False)
    return F.when(forced | (F.length(markdown) > LONG_ROUTE), F.lit("v2")).otherwise(F.lit("v1"))


def primary_language(html_lang: Column, og_locale: Column) -> Column:
    """The first of both tags whose main part has two letters, ``en`` without any."""
    two = lambda tag: F.nullif(F.regexp_extract(F.lower(trim(tag)), r"^([a-z]{2})(?:[_-]|$)", 1), F.lit(""))
    return F.coalesce(two(html_lang), two(og_locale), F.lit("en"))


def language_tag(tag: Column) -> Column:
    return F.lower(F.replace(trim(tag), F.lit("_"), F.lit("-")))


def route_language(tag: Column) -> Column:
    """``en``, or else the Chinese version."""
    return F.when(tag == "en", F.lit("en")).otherwise(F.lit("zh-cn"))


def provenance(content_source: Column) -> Column:
    return F.when(content_source.isin("official-zh", "native-zh"), content_source).otherwise(F.lit("original"))


def normalize_label(value: Column) -> Column:
    text = F.regexp_replace(trim(value), rf"{SPACE}+", " ")
    return F.lower(F.regexp_replace(text, r"[.,;:!?，。；：！？、…]+$", ""))


def normalize_categories(raw: Column, allowed: tuple[str, ...] = CATEGORIES) -> Column:
    """Allowed categories that occur among the labels, in allowed order; ``Other`` (if allowed) without any."""
    labels = F.transform(F.coalesce(raw, F.array().cast("array<string>")), normalize_label)
    every = F.array(*[F.lit(c) for c in allowed])
    other = F.slice(F.filter(every, lambda c: normalize_label(c) == "other"), 1, 1)
    found = let(labels, lambda mine: F.filter(every, lambda c: F.array_contains(mine, normalize_label(c))))
    return let(found, lambda some: F.when(F.size(some) > 0, some).otherwise(other))


def category_prompt(allowed: tuple[str, ...] = CATEGORIES) -> str:
    """The category section of a prompt."""
    return "\n".join(["Choose one or more of these categories, and no others:", *(f"- {c}" for c in allowed)])


def decode_entities(text: Column) -> Column:
    """CDATA opened, the five named and the decimal or hexadecimal entities of ASCII decoded, ends trimmed.

    ``&amp;`` is decoded last, so that what it stands before isn't decoded twice.
    """
    return let(F.regexp_replace(text, r"<!\[CDATA\[([\s\S]*?)\]\]>", "$1"), _decoded)


def _decoded(text: Column) -> Column:
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)&#(x[0-9a-f]{1,6}|[0-9]{1,7});"), F.lit(1)))

    def one(done: Column, code: Column) -> Column:
        number = F.when(code.rlike("^(?i)x"), F.conv(F.substr(code, F.lit(2)), 16, 10)).otherwise(code).cast("int")
        # UTF-32 bytes of the code point
        char = let(number, lambda n: F.when(n.between(1, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.lit("")))
        return F.replace(done, F.concat(F.lit("&#"), code, F.lit(";")), char)

    text = F.aggregate(codes, text, one)
    for name, char in (("apos", "'"), ("gt", ">"), ("lt", "<"), ("quot", '"'), ("amp", "&")):
        text = F.regexp_replace(text, f"(?i)&{name};", char)
    return trim(text)


def strip_tags(html: Column) -> Column:
    return decode_entities(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), rf"{SPACE}+", " "))


def first_tag(block: Column, *names: str) -> Column:
    """Decoded content of the first of the named elements that has any."""
    found = lambda name: F.regexp_extract(block, rf"(?i)<{name}(?:\s[^>]*)?>([\s\S]*?)</{name}>", 1)
    texts = [let(found(name), lambda t: F.when(t != "", t)) for name in names]
    return decode_entities(F.coalesce(*texts))


def heading_id(text: Column) -> Column:
    """Lower-case letters and digits, hyphens for blanks; ``section`` where nothing is left."""
    kept = F.regexp_replace(F.lower(trim(text)), r"[^\p{L}\p{N}\s\-]", "")
    return let(F.regexp_replace(trim(kept), rf"{SPACE}+", "-"), lambda slug: F.when(slug == "", F.lit("section")).otherwise(slug))


def escape_cell(text: Column) -> Column:
    """Safe in a Markdown table: pipes escaped, line ends as blanks."""
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"\r?\n", " ")


def json_string(text: Column) -> Column:
    """A JSON string literal."""
    quoted = F.to_json(F.struct(text.alias("v")))
    return F.substr(quoted, F.lit(6), F.length(quoted) - 6)


def frontmatter(source_id: Column, original_url: Column, language: Column, original_language: Column, title: Column, published_at: Column, categories: Column, source_domain: Column, provenance: Column, version_at: Column, body: Column, image_url: Column | None = None, translation_model: Column | None = None, original_alt_url: Column | None = None, author: Column | None = None, excerpt_text: Column | None = None) -> Column:
    """Header of a version's file, in a fixed order of keys; absent optional values have no line."""
    none = F.lit(None).cast("string")
    line = lambda key, value: F.concat(F.lit(f"{key}: "), json_string(value))
    some = lambda key, value: F.when(F.coalesce(value, F.lit("")) != "", line(key, value)) if value is not None else none
    items = F.when(F.size(categories) > 0, F.concat(F.lit("categories:\n"), F.array_join(F.transform(categories, lambda c: F.concat(F.lit("  - "), json_string(c))), "\n"))).otherwise(F.lit("categories: []"))
    summary = F.coalesce(excerpt_text, excerpt(body)) if excerpt_text is not None else excerpt(body)
    lines = F.concat_ws(
        "\n",
        F.lit("---"),
        line("blog_id", source_id),
        line("original_url", original_url),
        line("language", language),
        F.concat(F.lit("is_original: "), (language == original_language).cast("string")),
        some("image_url", image_url),
        line("title", title),
        F.concat(F.lit("published_at: "), published_at),
        items,
        line("source_domain", source_domain),
        line("original_language", original_language),
        line("provenance", provenance),
        some("translation_model", translation_model),
        some("original_alt_url", original_alt_url),
        F.concat(F.lit("version_at: "), version_at),
        some("author", author),
        some("excerpt", summary),
        F.lit("---"),
    )
    return F.concat(lines, F.lit("\n"))


def _without_end(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!{SPACE}){SPACE}+\z", "")


def version_file(header: Column, body: Column) -> Column:
    """A version's file: its header and, from the next line on, its text without white space at the end; null counts as empty."""
    return F.concat(header, F.coalesce(_without_end(body), F.lit("")), F.lit("\n"))


def frontmatter_value(content: Column, key: str) -> Column:
    """One value of a file's header: JSON strings decoded, others as written; null without the key."""
    head = F.regexp_extract(content, r"^---\r?\n([\s\S]*?)\r?\n---", 1)
    raw = F.regexp_extract(head, rf"(?md)^{key}:[ \t]*(.*?)[ \t\r]*$", 1)  # d: a line ends at \n only, not at U+2028 within a value
    decoded = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
    return F.when(raw.startswith('"'), F.coalesce(decoded, raw)).otherwise(F.nullif(raw, F.lit("")))


def frontmatter_categories(content: Column) -> Column:
    head = F.regexp_extract(content, r"^---\r?\n([\s\S]*?)\r?\n---", 1)
    block = F.regexp_extract(head, r"(?md)^categories:[ \t]*\r?\n((?:[ \t]+-[^\n]*(?:\n|$))+)", 1)
    items = F.regexp_extract_all(block, F.lit(r'(?md)^[ \t]+-[ \t]*("(?:[^"\\]|\\.)*"|[^\n]*?)[ \t\r]*$'), F.lit(1))
    return F.transform(items, lambda i: F.when(i.startswith('"'), F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), i, F.lit("}")), "$.v"), i)).otherwise(i))


def body_of(content: Column) -> Column:
    """What follows a file's header, without white space at its end."""
    return _without_end(F.regexp_replace(content, r"^---\r?\n[\s\S]*?\r?\n---\r?\n?", ""))

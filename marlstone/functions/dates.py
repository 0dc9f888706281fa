"""Date functions as native Columns. Texts that don't parse give null; the session's zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.core import let

# Month names by their first three letters.
MONTHS = {"jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06", "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12"}

_MONTH_WORD = r"(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
#: Characters of a page's text in which a visible date counts.
HEAD = 1600


def month_number(name: Column) -> Column:
    """``01`` to ``12`` from a month's name; null for other texts."""
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.try_element_at(table, F.substring(F.lower(name), 1, 3))


def iso_instant(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _ymd(year: Column, month: Column, day: Column) -> Column:
    """A real date, days past a month's end carried into the next."""
    first = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lit("01")), "yyyy-MM-dd")
    return F.when(F.try_to_number(day, F.lit("99")).between(1, 31), F.date_add(first, F.try_to_number(day, F.lit("99")).cast("int") - 1))


def parse_instant(text: Column) -> Column:
    """ISO dates and instants, ``YYYY-MM-DD HH:MM:SS[.f]`` (UTC), RFC-822 dates and ``Month D, YYYY``."""
    return let(F.regexp_replace(text, r"^\s+|\s+$", ""), _instant)


def _instant(t: Column) -> Column:
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?\s?(?:Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, r"\s?([+-]\d{2}):?(\d{2})$", "$1:$2"), r"^(\d{4}-\d{2}-\d{2}) (?=\d)", "$1T")))
    mail = r"^(?:[A-Za-z]{3},\s*)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\s+(\d{2}:\d{2}(?::\d{2})?)\s*(GMT|UTC|Z|[+-]\d{4})?$"
    g = lambda k: F.regexp_extract(t, mail, k)
    zone = F.when(g(5).rlike(r"^[+-]"), F.regexp_replace(g(5), r"^([+-]\d{2})(\d{2})$", "$1:$2")).otherwise(F.lit("Z"))
    rfc = F.when(t.rlike(mail), F.try_to_timestamp(F.concat(g(3), F.lit("-"), month_number(g(2)), F.lit("-"), F.lpad(g(1), 2, "0"), F.lit("T"), g(4), zone)))
    word = rf"(?i)^{_MONTH_WORD}\s+(\d{{1,2}}),\s*(\d{{4}})$"
    named = F.when(t.rlike(word), _ymd(F.regexp_extract(t, word, 3), month_number(F.regexp_extract(t, word, 1)), F.regexp_extract(t, word, 2)).cast("timestamp"))
    return F.coalesce(iso, rfc, named)


def normalize_date(text: Column) -> Column:
    """``YYYY-MM-DD`` as it is, another date as an ISO instant, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).otherwise(iso_instant(parse_instant(text)))


def iso_date(text: Column) -> Column:
    """An ISO instant; a bare date is its midnight."""
    return iso_instant(parse_instant(text))


def url_date(url: Column, pattern: Column) -> Column:
    """``YYYY-MM-DD`` by a source's own pattern: group 1 is the year, 2 the month's name, 3 the day.

    Without a day, or with a month that isn't one, the year's first day; with a bad day, the month's.
    """
    year = F.call_function("regexp_extract", url, pattern, F.lit(1))
    several = F.regexp_count(pattern, F.lit(r"(?<!\\)\((?!\?)"))
    month = F.when(several >= 3, month_number(F.call_function("regexp_extract", url, pattern, F.lit(2))))
    day = F.when(several >= 3, F.call_function("regexp_extract", url, pattern, F.lit(3)))
    good_year = F.coalesce(year.rlike(r"^\d{4}$") & year.between("1990", "2100"), F.lit(False))
    good_day = F.coalesce(day.rlike(r"^(?:0?[1-9]|[12]\d|3[01])$"), F.lit(False))
    return (
        F.when(~good_year, F.lit(None).cast("string"))
        .when(day.isNull() | month.isNull() | (day == ""), F.concat(year, F.lit("-01-01")))
        .otherwise(F.concat(year, F.lit("-"), month, F.lit("-"), F.when(good_day, F.lpad(day, 2, "0")).otherwise(F.lit("01"))))
    )


def visible_date(text: Column) -> Column:
    """The first form of date that the beginning of a text has: by name, by number, by year-month-day signs.

    A named month gives an ISO instant, the others a date; an empty text where there is none.
    """
    return let(F.substring(F.regexp_replace(text, r"[\s\x{00a0}\x{3000}]+", " "), 1, HEAD), _visible)


def _visible(head: Column) -> Column:
    word = rf"(?i)\b{_MONTH_WORD}\s+(\d{{1,2}}),\s+(\d{{4}})\b"
    number = r"\b(20\d{2})[/\-](\d{1,2})[/\-](\d{1,2})\b"
    signs = r"(20\d{2})年(\d{1,2})月(\d{1,2})日"
    g = lambda p, k: F.nullif(F.regexp_extract(head, p, k), F.lit(""))
    by_word = iso_instant(_ymd(g(word, 3), month_number(g(word, 1)), g(word, 2)).cast("timestamp"))
    by = lambda p: F.when(g(p, 2).cast("int").between(1, 12), _ymd(g(p, 1), g(p, 2), g(p, 3)).cast("string"))
    return F.coalesce(by_word, by(number), by(signs), F.lit(""))


def normalize_published(text: Column) -> Column:
    """What stands before the first comma, if its year is 1970 to 2100 (so an RFC-822 date is lost)."""
    first = F.trim(F.split_part(text, F.lit(","), F.lit(1)))
    return F.when(F.year(parse_instant(first)).between(1970, 2100), first)


def created_at(html: Column) -> Column:
    """The first ``_createdAt`` in a page's embedded data."""
    return F.nullif(F.regexp_extract(html, r'\\?"_createdAt\\?"\s*:\s*\\?"([^"\\]+)', 1), F.lit(""))


def api_published_at(value: Column) -> Column:
    """An ISO instant from a number of Unix seconds or a text; null for others."""
    return F.when(value.rlike(r"^\d+(?:\.\d+)?$"), iso_instant(F.timestamp_seconds(F.try_to_number(value, F.lit("9999999999999.999")).cast("double")))).otherwise(iso_instant(parse_instant(value)))


def valid_published(text: Column) -> Column:
    """Whether the text is a date of the years 1970 to 2100."""
    return F.coalesce(F.year(parse_instant(text)).between(1970, 2100), F.lit(False))


def resolve_published(*candidates: Column) -> Column:
    """The first that is a date, in its normal form and in the order of trust; an empty text without one."""
    return F.coalesce(*[normalize_date(c) for c in candidates], F.lit(""))


def first_date(candidates: Column) -> Column:
    """As ``resolve_published``, over an array; null without a date."""
    return F.get(F.filter(F.transform(candidates, normalize_date), lambda d: d.isNotNull()), F.lit(0))


def sort_instant(text: Column) -> Column:
    """For newest-first orders: missing and unparseable dates are the oldest."""
    return F.coalesce(parse_instant(text), F.lit("1970-01-01").cast("timestamp"))


def format_date(text: Column, pattern: str = "yyyy/MM/dd") -> Column:
    """A date in numbers; an empty text where there is none."""
    return F.coalesce(F.date_format(parse_instant(text), pattern), F.lit(""))

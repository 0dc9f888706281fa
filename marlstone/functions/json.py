"""JSON functions: dot paths natively, the first balanced object in a text as an Arrow function."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot_path(document: Column, path: str) -> Column:
    """The value at a path of names joined by dots; null where there is none."""
    return F.get_json_object(document, "$." + path)


def balanced_object(text: str | None) -> str | None:
    """The first ``{...}`` whose braces balance, those in strings aside; None without one."""
    if not text:
        return None
    start = text.find("{")
    depth, quoted, escaped = 0, False, False
    for k in range(start, len(text)) if start >= 0 else ():
        c = text[k]
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return text[start : k + 1]
    return None


def _valid(text: str | None) -> str | None:
    try:
        json.loads(text or "")
    except ValueError:
        return None
    return text


def _first_object(texts: pd.Series) -> pd.Series:
    return texts.map(balanced_object)


def _reply(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _valid(t.strip() if t else t) or _valid(balanced_object(t)))


def first_json_object(text: Column) -> Column:
    return F.pandas_udf(_first_object, "string")(text)


def model_json(reply: Column) -> Column:
    """A reply's JSON: the whole text if it parses, else its first balanced object if that does, else null."""
    return F.pandas_udf(_reply, "string")(reply)


def parse_categories_reply(reply: Column) -> Column:
    """The ``categories`` list of a model's reply."""
    return F.from_json(F.get_json_object(model_json(reply), "$.categories"), "array<string>")

"""Markdown structure: protected spans, chunks, math inventory and rendering, as Arrow functions.

A small block and inline tokenizer of our own: it keeps the source text and works on its ranges, so
what isn't protected is never rewritten. Row errors come back in an ``error`` column.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TOKENS, MAX_CHUNKS = 1200, 64

# Fixed value: what a token looks like.
_TOKEN = re.compile(r"\{\{BW:(?:url|code|inline-code|html|math|inline-math):\d+\}\}")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_INLINE = re.compile(
    r"(?P<code>(?P<tick>`+)(?!`)(?P<codev>.+?)(?<!`)(?P=tick)(?!`))"
    r"|(?P<display>\$\$(?P<displayv>[^$]+?)\$\$)"
    r"|(?P<math>(?<![\\$])\$(?![\s$])(?P<mathv>[^$\n]+?)(?<![\s\\])\$(?![\d$]))"
    r"|(?P<link>\]\(\s*<?(?P<linkv>[^)\s>]+)>?(?P<linkt>(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*)\))"
    r"|(?P<auto><(?P<autov>https?://[^>\s]+)>)"
    r"|(?P<html></?[A-Za-z][^>\n]*>)",
    re.S,
)
# Fixed value: what a match of _INLINE can begin with.
_MARK = re.compile(r"[`$\]<]")
_DEFINITION = re.compile(r"^( {0,3}\[[^\]]+\]:\s*)(\S+)", re.M)


@dataclass
class Block:
    kind: str  # heading, code, math, html, table, list, quote, rule, paragraph
    text: str
    depth: int = 0
    value: str = ""
    start: int = 0  # its place in the source with Unix line ends


def unix(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def blocks(markdown: str) -> list[Block]:
    """Top-level blocks in order; blank lines separate them, fences and math keep theirs."""
    lines = unix(markdown).split("\n")
    begins = [0, *accumulate(len(line) + 1 for line in lines)]
    out: list[Block] = []
    k = 0
    while k < len(lines):
        line = lines[k]
        if not line.strip():
            k += 1
            continue
        if m := _FENCE.match(line):
            end = k + 1
            while end < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[end]):
                end += 1
            out.append(Block("code", "\n".join(lines[k : end + 1]), value="\n".join(lines[k + 1 : end]), start=begins[k]))
            k = end + 1
            continue
        if line.strip() == "$$":
            end = k + 1
            while end < len(lines) and lines[end].strip() != "$$":
                end += 1
            out.append(Block("math", "\n".join(lines[k : end + 1]), value="\n".join(lines[k + 1 : end]), start=begins[k]))
            k = end + 1
            continue
        if m := _HEADING.match(line):
            out.append(Block("heading", line, len(m[1]), (m[2] or "").strip(), begins[k]))
            k += 1
            continue
        end = k + 1
        while end < len(lines) and lines[end].strip() and not _FENCE.match(lines[end]) and not _HEADING.match(lines[end]) and lines[end].strip() != "$$":
            end += 1
        text = "\n".join(lines[k:end])
        first = line.lstrip()
        kind = (
            "table" if first.startswith("|") and end - k > 1 and re.match(r"^\s*\|?[\s:|-]+\|[\s:|-]*$", lines[k + 1])
            else "quote" if first.startswith(">")
            else "rule" if re.match(r"^(?:-\s*){3,}$|^(?:\*\s*){3,}$|^(?:_\s*){3,}$", first)
            else "list" if re.match(r"(?:[-*+]|\d+[.)])\s", first)
            else "html" if re.match(r"</?[A-Za-z!]", first)
            else "paragraph"
        )
        out.append(Block(kind, text, value=text if kind == "html" else "", start=begins[k]))
        k = end
    return out


def _inline(text: str) -> Iterator[re.Match]:
    """What ``_INLINE.finditer`` gives, tried only where a match can begin."""
    at = 0
    while mark := _MARK.search(text, at):
        if m := _INLINE.match(text, mark.start()):
            yield m
        at = m.end() if m else mark.end()


def _spans(block: Block) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the protected values in a block's text."""
    if block.kind in ("code", "math", "html"):
        if not block.value:
            return []
        at = block.text.index("\n") + 1 if block.kind != "html" else 0
        return [(at, at + len(block.value), block.kind)]
    found = []
    for m in _inline(block.text):
        for kind, group in (("inline-code", "codev"), ("inline-math", "displayv"), ("inline-math", "mathv"), ("url", "linkv"), ("url", "autov"), ("html", "html")):
            if m[group]:
                found.append((*m.span(group), kind))
                break
    taken = [(a, b) for a, b, _ in found]
    found += [(*m.span(2), "url") for m in _DEFINITION.finditer(block.text) if not any(a < m.end(2) and m.start(2) < b for a, b in taken)]
    return sorted(found)


def protect(markdown: str) -> tuple[str, list[tuple[str, str, str]]]:
    """(text, [(kind, token, value)]): each value replaced by a token of its own; a source with tokens is refused.

    Everything else, blank lines included, stays as it is, but for line ends.
    """
    if m := _TOKEN.search(markdown):
        raise ValueError(f"the source holds the reserved token {m[0]}")
    source = unix(markdown)
    places = [(block.start + a, block.start + b, kind) for block in blocks(source) for a, b, kind in _spans(block)]
    spans, parts, at = [], [], 0
    for n, (a, b, kind) in enumerate(places, 1):
        token = "{{BW:%s:%d}}" % (kind, n)
        spans.append((kind, token, source[a:b]))
        parts += [source[at:a], token]
        at = b
    return "".join([*parts, source[at:]]), spans


def restore(text: str, spans: list[tuple[str, str, str]]) -> str:
    """Values for tokens; each token must be there once and no other may be left."""
    for kind, token, value in spans:
        if (n := text.count(token)) != 1:
            raise ValueError(f"token {token} ({kind}) occurs {n} times")
        text = text.replace(token, value)
    if left := _TOKEN.search(text):
        raise ValueError(f"token {left[0]} is left")
    return text


def tokens_of(text: str) -> int:
    return math.ceil(len(text) / 4)


def heading_text(value: str) -> str:
    """A heading's words: links by their text, code by its value, images and marks left out."""
    text = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", re.sub(r"!\[[^\]]*\]\([^)]*\)", "", value))
    return re.sub(r"`+([^`]*)`+|\*+|(?<!\w)_+|_+(?!\w)", r"\1", text).strip()


def _sections(markdown: str) -> list[tuple[list[str], list[Block]]]:
    """(headings above, blocks) of each part that a heading begins; the first may have none."""
    out: list[tuple[list[str], list[Block]]] = [([], [])]
    above: dict[int, str] = {}
    for block in blocks(markdown):
        if block.kind == "heading":
            above = {depth: text for depth, text in above.items() if depth < block.depth}
            if words := heading_text(block.value):
                above[block.depth] = words
            out.append((list(above.values()), []))
        out[-1][1].append(block)
    return [part for part in out if part[1]]


def _packed(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring texts that fit together, greedily, joined by blank lines; one that is too large is alone if something stands before it."""
    out: list[tuple[int, int]] = []
    start = used = 0
    for k, size in enumerate(sizes):
        if k > start and math.ceil(used / 4) + math.ceil(size / 4) > most:
            out.append((start, k))
            start, used = k, 0
        used += size + (2 if k > start else 0)
    return [*out, (start, len(sizes))]


def _chunk(kind: str, path: list[str], number: int, source: str, spans: list, oversized: bool = False) -> dict:
    key = hashlib.sha1(f"{'|'.join(path)}#{number}".encode()).hexdigest()[:8]
    return {"id": f"chunk-{key}", "kind": kind, "heading_path": path, "source": source, "sha256": hashlib.sha256(source.encode()).hexdigest(), "tokens": tokens_of(source), "oversized": oversized, "spans": [{"kind": k, "token": t, "value": v} for k, t, v in spans]}


def chunks(markdown: str, most: int = MAX_TOKENS, count: int = MAX_CHUNKS) -> list[dict]:
    """Chunks of whole blocks up to ``most`` tokens, anew at each heading, with values protected.

    A block that is larger by itself is never cut; a chunk that begins with one is ``oversized``.
    A chunk has the protected values of its own text.
    """
    text, spans = protect(markdown)
    out: list[dict] = []
    at = 0
    for path, some in _sections(text):
        for a, b in _packed([len(block.text) for block in some], most):
            source = "\n\n".join(block.text for block in some[a:b]).strip()
            if not source:
                continue
            held = len(_TOKEN.findall(source))  # tokens come in order
            out.append(_chunk("body", path, len(out), source, spans[at : at + held], tokens_of(some[a].text) > most))
            at += held
    if len(out) > count:
        raise ValueError(f"{len(out)} chunks, more than {count}")
    return out


def plan(markdown: str, title: str | None, official: bool, threshold: float = 0.5, most: int = MAX_TOKENS, count: int = MAX_CHUNKS) -> dict:
    """How an article is translated: mode, a chunk for the title, chunks of the body, and their sums.

    What is Chinese already is one chunk as it stands, without protected values. An empty text and a threshold outside
    (0, 1] are errors.
    """
    body = markdown.strip()
    if not body:
        raise ValueError("the Markdown is empty")
    if not 0 < threshold <= 1:
        raise ValueError(f"the threshold must be in (0, 1], not {threshold}")
    chinese = sum(map(len, re.findall(r"[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3000-\u303f]+", body)))
    letters = chinese + sum(map(len, re.findall(r"[A-Za-z]+", body)))
    ratio = chinese / letters if letters else 0.0
    mode = "official-zh" if official else "native-zh" if ratio >= threshold else "translate"
    parts = chunks(body, most, count) if mode == "translate" else [_chunk("body", [], 0, body, [])]
    name = (title or "").strip()
    head = _chunk("title", ["<title>"], 0, name, []) | {"heading_path": []} if name else None
    if head:
        head["tokens"] = tokens_of(title)
    return {"mode": mode, "title": head, "chunks": parts, "n_chunks": len(parts), "oversize_blocks": sum(c["oversized"] for c in parts), "total_tokens": sum(c["tokens"] for c in parts), "cjk_ratio": ratio}


def math_inventory(markdown: str) -> list[tuple[str, str]]:
    """(kind, sha256) of every formula in order."""
    found = []
    for block in blocks(markdown):
        if block.kind == "math":
            found.append(("math", hashlib.sha256(block.value.encode()).hexdigest()))
        else:
            found += [("inline-math", hashlib.sha256(block.text[a:b].encode()).hexdigest()) for a, b, kind in _spans(block) if kind == "inline-math"]
    return found


def _inline_html(text: str) -> str:
    out, at = [], 0
    pattern = re.compile(r"(`+)(.+?)\1|!\[([^\]]*)\]\(([^)\s]+)[^)]*\)|\[([^\]]*)\]\(([^)\s]+)[^)]*\)|\*\*(.+?)\*\*|\*(.+?)\*|\$([^$\n]+)\$")
    for m in pattern.finditer(text):
        out.append(html.escape(text[at : m.start()], quote=False))
        at = m.end()
        if m[2] is not None:
            out.append(f"<code>{html.escape(m[2], quote=False)}</code>")
        elif m[4] is not None:
            safe = re.match(r"(?i)https?://|data:image/", m[4])
            out.append(f'<img src="{html.escape(m[4])}" alt="{html.escape(m[3])}" loading="lazy">' if safe else html.escape(m[3]))
        elif m[6] is not None:
            safe = re.match(r"(?i)https?:|mailto:|#", m[6]) or not re.match(r"\s*[A-Za-z][A-Za-z0-9+.\-]*:", m[6])
            rest = ' target="_blank" rel="noopener noreferrer"' if re.match(r"(?i)https?:", m[6]) else ""
            out.append(f'<a href="{html.escape(m[6])}"{rest}>{_inline_html(m[5])}</a>' if safe else _inline_html(m[5]))
        elif m[7] is not None:
            out.append(f"<strong>{_inline_html(m[7])}</strong>")
        elif m[8] is not None:
            out.append(f"<em>{_inline_html(m[8])}</em>")
        else:
            out.append(f'<span class="math">{html.escape(m[9], quote=False)}</span>')
    return "".join([*out, html.escape(text[at:], quote=False)])


def heading_slug(text: str) -> str:
    kept = "".join(c for c in text.lower() if c.isalnum() or c in " -\t")
    return re.sub(r"\s+", "-", kept.strip()) or "section"


def render(markdown: str) -> str:
    """HTML of the blocks: first-level headings become second-level, ids are unique, raw HTML is escaped."""
    out, used = [], {}
    for block in blocks(markdown):
        text = block.text
        if block.kind == "heading":
            slug = heading_slug(re.sub(r"[*_`]|\[([^\]]*)\]\([^)]*\)", r"\1", block.value))
            used[slug] = used.get(slug, 0) + 1
            level = max(2, block.depth)
            out.append(f'<h{level} id="{slug if used[slug] == 1 else f"{slug}-{used[slug]}"}">{_inline_html(block.value)}</h{level}>')
        elif block.kind == "code":
            language = re.match(r"\s*[`~]+\s*([\w+-]*)", text)[1]
            out.append(f'<pre><code{f" class=\"language-{language}\"" if language else ""}>{html.escape(block.value, quote=False)}</code></pre>')
        elif block.kind == "math":
            out.append(f'<div class="math">{html.escape(block.value, quote=False)}</div>')
        elif block.kind == "table":
            rows = [[c.strip() for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))] for line in text.split("\n")]
            cell = lambda tag, row: "".join(f"<{tag}>{_inline_html(c)}</{tag}>" for c in row)
            body = "".join(f"<tr>{cell('td', row)}</tr>" for row in rows[2:])
            out.append(f'<div class="table-wrap"><table><thead><tr>{cell("th", rows[0])}</tr></thead><tbody>{body}</tbody></table></div>')
        elif block.kind == "quote":
            out.append(f"<blockquote>{render(re.sub(r'(?m)^ {0,3}> ?', '', text))}</blockquote>")
        elif block.kind == "list":
            ordered = bool(re.match(r"\s*\d", text))
            items = re.split(r"(?m)^\s*(?:[-*+]|\d+[.)])\s+", text)[1:]
            out.append(f"<{'ol' if ordered else 'ul'}>{''.join(f'<li>{_inline_html(i.strip())}</li>' for i in items)}</{'ol' if ordered else 'ul'}>")
        elif block.kind == "rule":
            out.append("<hr>")
        else:
            out.append(f"<p>{_inline_html(text)}</p>")
    return "\n".join(out)


def _safe(f, empty):
    def run(text: str | None):
        try:
            return f(text or ""), None
        except ValueError as error:
            return empty, str(error)

    return run


def _protect_rows(texts: pd.Series) -> pd.DataFrame:
    rows = [_safe(protect, ("", []))(t) for t in texts]
    return pd.DataFrame({"text": [r[0] for r, _ in rows], "spans": [[{"kind": k, "token": t, "value": v} for k, t, v in r[1]] for r, _ in rows], "error": [e for _, e in rows]}, dtype=object)


def _chunk_rows(texts: pd.Series) -> pd.DataFrame:
    rows = [_safe(chunks, [])(t) for t in texts]
    return pd.DataFrame({"chunks": [r for r, _ in rows], "error": [e for _, e in rows]}, dtype=object)


def _restore_rows(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = [_safe(lambda t, s=s: restore(t, [(x["kind"], x["token"], x["value"]) for x in s]), None)(t) for t, s in zip(texts, spans, strict=True)]
    return pd.DataFrame({"text": [r for r, _ in rows], "error": [e for _, e in rows]}, dtype=object)


def _math_rows(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"kind": k, "sha256": h} for k, h in math_inventory(t or "")])


def _render_rows(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: render(t or ""))


_SPAN = "array<struct<kind:string,token:string,value:string>>"


def protect_markdown(text: Column) -> Column:
    return F.pandas_udf(_protect_rows, f"text string, spans {_SPAN}, error string")(text)


def restore_markdown(text: Column, spans: Column) -> Column:
    return F.pandas_udf(_restore_rows, "text string, error string")(text, spans)


_CHUNK = f"struct<id:string,kind:string,heading_path:array<string>,source:string,sha256:string,tokens:int,oversized:boolean,spans:{_SPAN}>"
_PLAN = f"mode string, title {_CHUNK}, chunks array<{_CHUNK}>, n_chunks int, oversize_blocks int, total_tokens int, cjk_ratio double, error string"


def chunk_markdown(text: Column) -> Column:
    return F.pandas_udf(_chunk_rows, f"chunks array<{_CHUNK}>, error string")(text)


def _plan_rows(texts: pd.Series, titles: pd.Series, official: pd.Series) -> pd.DataFrame:
    blank = dict.fromkeys(("mode", "title", "chunks", "n_chunks", "oversize_blocks", "total_tokens", "cjk_ratio", "error"))
    rows = []
    for text, title, own in zip(texts, titles, official, strict=True):
        found, error = _safe(lambda t, title=title, own=own: plan(t, title, bool(own)), None)(text)
        rows.append(blank | (found or {}) | {"error": error})
    return pd.DataFrame(rows, columns=list(blank), dtype=object)


def translation_plan(text: Column, title: Column, official: Column) -> Column:
    """A struct of what ``plan`` gives; null but for ``error`` where it can't."""
    return F.pandas_udf(_plan_rows, _PLAN)(text, title, F.coalesce(official, F.lit(False)))


def math_of(text: Column) -> Column:
    return F.pandas_udf(_math_rows, "array<struct<kind:string,sha256:string>>")(text)


def same_math(source: Column, translated: Column) -> Column:
    """Whether both have the same formulas in the same order."""
    return math_of(source) == math_of(translated)


def render_markdown(text: Column) -> Column:
    return F.pandas_udf(_render_rows, "string")(text)

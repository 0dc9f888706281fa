"""HTML extraction on the standard library's parser, as Arrow functions: metadata, alternates, main text as Markdown.

The main part of a page is its ``article`` or ``main`` element, or else the element with the most
text outside of links.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SKIP = frozenset("script style noscript template svg iframe form button".split())
_BLOCK = frozenset("p div section article main header footer nav aside ul ol li table tr blockquote pre h1 h2 h3 h4 h5 h6 figure figcaption hr".split())
#: Elements that a start tag ends.
_CLOSES = {"p": ("p",), "li": ("p", "li"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}

# Names that mark a block beside the article, and the characters of text up to which one, or a repeated title, is dropped.
NOISE = re.compile(r"(?i)(^|[\s_-])(share|social|sharing|related|recommend(?:ed|ation)?|newsletter|subscribe|comment(?:s)?|author[-_]?(?:bio|box|signature)|signature|footer|sidebar|promo|advert)([\s_-]|$)")
NOISE_ROLES = ("navigation", "complementary", "contentinfo")
NOISE_TEXT, NOISE_TITLE = 1000, 300

# Names of carousels, of their slides and of their controls; slides that stay, and what stands for the others.
CAROUSEL = re.compile(r"(?i)(^|[\s_-])carousel([\s_-]|$)")
SLIDE = re.compile(r"(?i)(^|[\s_-])carousel[-_]?item([\s_-]|$)")
CONTROLS = re.compile(r"(?i)(^|[\s_-])(pagination|dots?|indicators?|arrows?|prev|next|controls?|navigation|nav|counter|progress)([\s_-]|$)")
SLIDES, MORE = 3, ("更多客户证言请见", "原文", "。")

# How far up, and with how much text and how many paragraphs, an element is taken for a picture's frame; a caption's length.
FRAME_LEVELS, FRAME_TEXT, FRAME_PARAGRAPHS, CAPTION = 6, 1200, 1, 300

# Where metadata stands, first choice first.
META = {
    "author": (("name", "author"), ("property", "article:author"), ("property", "author")),
    "image": (("property", "og:image"), ("property", "og:image:url"), ("name", "twitter:image"), ("name", "twitter:image:src")),
    "published": (("property", "article:published_time"), ("name", "date"), ("itemprop", "datePublished")),
    "title": (("property", "og:title"), ("name", "og:title")),
    "locale": (("property", "og:locale"),),
}


class Node:
    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def walk(self):
        stack = list(reversed(self.kids))
        while stack:
            node = stack.pop()
            yield node
            if isinstance(node, Node):
                stack.extend(reversed(node.kids))

    def all(self, *tags: str):
        return (n for n in self.walk() if isinstance(n, Node) and n.tag in tags)

    def text(self) -> str:
        return re.sub(r"\s+", " ", "".join(n if isinstance(n, str) else " " if n.tag in _BLOCK else "" for n in self.walk())).strip()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("root", {}, None)

    def handle_starttag(self, tag, attrs):
        while self.here.tag in _CLOSES.get(tag, ()):
            self.here = self.here.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.kids.append(node)
        if tag not in _VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.here.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.here))

    def handle_endtag(self, tag):
        node = self.here
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        self.here.kids.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def absolute(url: str | None, base: str) -> str | None:
    """The resolved address if it is http(s)."""
    try:
        found = urljoin(base, (url or "").strip())
        return found if url and urlsplit(found).scheme in ("http", "https") and urlsplit(found).netloc else None
    except ValueError:
        return None


def meta_all(root: Node, kind: str) -> list[str]:
    """What stands at each place for a kind of metadata: of several elements there, the first counts."""
    nodes = list(root.all("meta"))
    found = (next((n.attrs.get("content", "").strip() for n in nodes if n.attrs.get(key) == name), "") for key, name in META[kind])
    return [value for value in found if value]


def meta(root: Node, kind: str) -> str:
    return next(iter(meta_all(root, kind)), "")


def head_image(root: Node) -> str:
    link = next((n for n in root.all("link") if n.attrs.get("rel") == "image_src"), None)
    return meta(root, "image") or (link.attrs.get("href", "").strip() if link is not None else "")


def json_ld_date(root: Node) -> str:
    for node in root.all("script"):
        if "ld+json" in node.attrs.get("type", "") and (m := re.search(r'"datePublished"\s*:\s*"([^"]+)"', "".join(k for k in node.kids if isinstance(k, str)))):
            return m[1]
    return ""


def alternates(root: Node, base: str) -> list[dict]:
    """(language, url) of the page's versions, each once."""
    out = []
    for node in root.all("link", "a"):
        tag, url = node.attrs.get("hreflang", "").strip().replace("_", "-").lower(), absolute(node.attrs.get("href"), base)
        if "alternate" in node.attrs.get("rel", "").lower().split() and tag and url and {"language": tag, "url": url} not in out:
            out.append({"language": tag, "url": url})
    return out


def candidates(srcset: str) -> list[str]:
    """The addresses of a srcset, the largest first; of equal ones the later."""
    scored = []
    for k, part in enumerate(srcset.split(",")):
        bits = part.split()
        if bits:
            size = re.match(r"[+-]?(?:\d+\.?\d*|\.\d+)", bits[1]) if len(bits) > 1 else None
            scored.append((float(size[0]) if size else 0.0, k, bits[0]))
    return [url for _, _, url in sorted(scored, reverse=True)]


def best_candidate(srcset: str) -> str:
    return next(iter(candidates(srcset)), "")


def folder_of(url: str) -> str:
    """The address that relative ones are resolved against: with a slash, unless its last segment has a file extension."""
    try:
        parts = urlsplit(url)
    except ValueError:
        return url
    last = next((x for x in reversed(parts.path.split("/")) if x), "")
    if parts.path.endswith("/") or re.search(r"\.[A-Za-z0-9]{1,8}$", last):
        return url
    return parts._replace(path=f"{parts.path}/").geturl()


def image_url(node: Node, base: str) -> str | None:
    """The best address of an image: lazily loaded originals, then its own and its picture's srcset, then src."""
    picture = _closest(node, "picture")
    source = next((n for n in picture.all("source") if n.attrs.get("srcset")), None) if picture is not None else None
    sources = [node.attrs.get(k, "") for k in ("data-original", "data-lazy-src", "data-src")]
    sources += candidates(node.attrs.get("srcset", "")) + (candidates(source.attrs["srcset"]) if source is not None else [])
    for url in [*sources, node.attrs.get("src", "")]:
        if url and not re.match(r"(?i)data:|blob:", url) and (found := absolute(url, base)):
            return found
    return None


def _closest(node: Node | None, tag: str) -> Node | None:
    while node is not None and node.tag != tag:
        node = node.parent
    return node


def _inside(node: Node, tag: str) -> bool:
    return _closest(node, tag) is not None


def _raw_text(node: Node) -> str:
    return "".join(k for k in node.walk() if isinstance(k, str))


def _named(node: Node) -> str:
    return f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"


def _drop(node: Node) -> None:
    if node.parent is not None:
        node.parent.kids = [k for k in node.parent.kids if k is not node]


def _elements(node: Node) -> list[Node]:
    return [n for n in node.walk() if isinstance(n, Node)]


def lift_pictures(root: Node) -> int:
    """Frames that hold little but one picture become figures with the picture's largest image and its caption; their number.

    A frame of several pictures, lifted ones included, is left, so that none of them is lost.
    """
    lifted = 0
    for picture in list(root.all("picture")):
        image = next(picture.all("img"), None)
        if _inside(picture, "figure") or image is None or "data-nosnippet" in image.attrs:
            continue
        frame = picture
        for _ in range(FRAME_LEVELS):
            above = frame.parent
            if above is None or above is root or above.tag in ("body", "html", "root") or _inside(above, "figure"):
                break
            if len(re.sub(r"\s+", " ", _raw_text(above)).strip()) > FRAME_TEXT or sum(1 for _ in above.all("p")) > FRAME_PARAGRAPHS or sum(1 for _ in above.all("picture", "figure")) > 1:
                break
            frame = above
        source = next((n for n in picture.all("source") if "srcset" in n.attrs), None)
        large = next((u for u in candidates(source.attrs["srcset"]) if u.startswith("http")), "") if source is not None else ""
        if large:
            image.attrs["src"] = large
        inner = _elements(frame)
        caption = next((n for n in inner if n.tag == "figcaption" or {"caption", "wp-caption-text"} & set(n.attrs.get("class", "").split())), None)
        caption = caption or next((n for n in inner if n.tag == "p" and len(_raw_text(n).strip()) <= CAPTION), None)
        words = _raw_text(caption).strip() if caption is not None else ""
        figure = Node("figure", {}, frame.parent)
        image.parent, figure.kids = figure, [image]
        if words:
            note = Node("figcaption", {}, figure)
            note.kids = [words]
            figure.kids.append(note)
        frame.parent.kids = [figure if k is frame else k for k in frame.parent.kids]
        lifted += 1
    return lifted


def _is_slide(node: Node) -> bool:
    if SLIDE.search(_named(node)):
        return True
    image = next(node.all("img"), None)
    return image is not None and "logo" in image.attrs.get("alt", "").lower() and next(node.all("blockquote"), None) is not None


def _without(nodes: list[Node], outer: bool) -> list[Node]:
    """Of nested nodes only the outermost, or only the innermost."""
    ids = {id(n) for n in nodes}
    holds = {id(n): any(id(k) in ids for k in _elements(n)) for n in nodes}
    if not outer:
        return [n for n in nodes if not holds[id(n)]]
    inner = {id(k) for n in nodes for k in _elements(n)}
    return [n for n in nodes if id(n) not in inner]


def collapse_carousels(root: Node, url: str) -> int:
    """Carousels of testimonials keep their first slides, lose their controls and end with a pointer to the page; their number."""
    holders = {id(n): n for n in [root, *_elements(root)] if CAROUSEL.search(_named(n)) or sum(isinstance(k, Node) and _is_slide(k) for k in n.kids) >= 2}
    done = 0
    for holder in _without(list(holders.values()), outer=True):
        slides = _without([n for n in _elements(holder) if _is_slide(n)], outer=False)
        if not slides:
            continue
        for slide in slides[SLIDES:]:
            _drop(slide)
        kept = slides[:SLIDES]
        inside = {id(n) for k in kept for n in [k, *_elements(k)]}
        for node in _elements(holder):
            named = "class" in node.attrs or "id" in node.attrs
            if named and CONTROLS.search(_named(node)) and id(node) not in inside and not any(id(k) in inside for k in _elements(node)):
                _drop(node)
        note = Node("p", {}, holder)
        link = Node("a", {"href": url}, note)
        link.kids, note.kids = [MORE[1]], [MORE[0], link, MORE[2]]
        holder.kids.append(note)
        done += 1
    return done


def is_noise(node: Node, title: str) -> bool:
    """A block beside the article: by its element or role, or a short one by its class and id or as a repetition of the title."""
    quoted = _inside(node, "blockquote")
    if node.tag == "nav" or node.tag == "footer" and not quoted or node.attrs.get("role") in NOISE_ROLES:
        return True
    if quoted or not ("class" in node.attrs or "id" in node.attrs):
        return False
    text = _raw_text(node).strip()
    if len(text) > NOISE_TEXT:
        return False
    if NOISE.search(_named(node)):
        return True
    wanted = title.strip().lower()
    return bool(wanted) and 0 < len(text) <= NOISE_TITLE and text.lower().startswith(wanted)


def without_noise(node: Node, title: str) -> Node:
    """The node, its noisy descendants removed; whether one is noise is decided before any is removed below it."""
    stack = [node]
    while stack:
        here = stack.pop()
        here.kids = [k for k in here.kids if isinstance(k, str) or not is_noise(k, title)]
        stack.extend(k for k in here.kids if isinstance(k, Node))
    return node


def main_content(root: Node) -> Node:
    for tag in ("article", "main"):
        if found := max(root.all(tag), key=lambda n: len(n.text()), default=None):
            return found
    body = next(root.all("body"), root)
    best, most = body, -1.0
    for node in root.all("div", "section", "td"):
        own = sum(len(k.text()) for k in node.kids if isinstance(k, Node) and k.tag in ("p", "pre", "blockquote", "ul", "ol", "h2", "h3"))
        links = sum(len(a.text()) for a in node.all("a"))
        if own - 2 * links > most and own > 0:
            best, most = node, own - 2 * links
    return best


def _resolved(url: str, base: str) -> str:
    try:
        return urljoin(base, url) if url else ""
    except ValueError:
        return url


def heading_text(root: Node) -> str:
    """What stands beside a page's heading: all of its parent, then each neighbour."""
    places = (h for within in ("article", "main", None) for h in ([h for n in root.all(within) for h in n.all("h1")] if within else root.all("h1")))
    h1 = next(places, None)
    if h1 is None or h1.parent is None:
        return ""
    texts = [h1.parent, *(k for k in h1.parent.kids if isinstance(k, Node) and k is not h1)]
    return " | ".join(re.sub(r"\s+", " ", _raw_text(n)).strip() for n in texts)


def table_markdown(node: Node) -> str:
    rows = [[re.sub(r"\s+", " ", c.text()).replace("|", "\\|") for c in tr.kids if isinstance(c, Node) and c.tag in ("td", "th")] for tr in node.all("tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    wide = max(map(len, rows))
    lines = [f"| {' | '.join(r + [''] * (wide - len(r)))} |" for r in rows]
    return "\n".join([lines[0], f"| {' | '.join(['---'] * wide)} |", *lines[1:]])


def markdown_of(node: Node, base: str, title: str = "") -> str:
    """Markdown with ATX headings, fences, ``-`` lists, ``*`` and ``**``."""

    def inline(kids) -> str:
        out = []
        for k in kids:
            if isinstance(k, str):
                out.append(re.sub(r"\s+", " ", k))
            elif k.tag in _SKIP:
                continue
            elif k.tag == "br":
                out.append("\n")
            elif k.tag == "img":
                if url := image_url(k, base):
                    out.append(f"![{k.attrs.get('alt', '').strip()}]({url})")
            elif k.tag == "code":
                out.append(f"`{k.text()}`")
            elif k.tag in ("strong", "b", "em", "i"):
                mark, text = ("**" if k.tag in ("strong", "b") else "*"), inline(k.kids).strip()
                out.append(f"{mark}{text}{mark}" if text else "")
            elif k.tag == "a":
                text, url = inline(k.kids).strip(), k.attrs.get("href", "")
                url = _resolved(url, base)
                out.append(f"[{text}]({url})" if url and text else text)
            else:
                out.append(inline(k.kids))
        return "".join(out)

    def block(node: Node) -> list[str]:
        parts, run = [], []

        def flush() -> None:
            if (text := inline(run).strip()):
                parts.append(text)
            run.clear()

        for k in node.kids:
            if isinstance(k, str) or k.tag not in _BLOCK | {"picture"} | _SKIP:
                run.append(k)
                continue
            flush()
            if k.tag in _SKIP:
                continue
            if k.tag in ("h1", "h2") and title and k.text() == title:  # the title again
                continue
            if k.tag[0] == "h" and k.tag[1:].isdigit():
                if text := inline(k.kids).strip():
                    parts.append(f"{'#' * int(k.tag[1])} {text}")
            elif k.tag == "p":
                if text := inline(k.kids).strip():
                    parts.append(text)
            elif k.tag == "pre":
                code = "".join(x for x in k.walk() if isinstance(x, str)).strip("\n")
                parts.append(f"```\n{code}\n```")
            elif k.tag in ("ul", "ol"):
                items = [i for i in k.kids if isinstance(i, Node) and i.tag == "li"]
                lines = []
                for n, item in enumerate(items, 1):
                    text = "\n\n".join(block(item)).replace("\n\n", "\n")
                    lead = f"{n}. " if k.tag == "ol" else "- "
                    lines.append(lead + text.replace("\n", "\n" + " " * len(lead)))
                if lines:
                    parts.append("\n".join(lines))
            elif k.tag == "blockquote":
                parts.append("\n".join(f"> {line}".rstrip() for line in "\n\n".join(block(k)).split("\n")))
            elif k.tag == "table":
                parts.append(table_markdown(k))
            elif k.tag == "hr":
                parts.append("---")
            else:
                parts.extend(block(k))
        flush()
        return [p for p in parts if p]

    return "\n\n".join(block(node))


def extract(html: str, url: str) -> dict:
    """Everything that is read from a page: title, author, image, dates, language, alternates, Markdown."""
    root = parse(html)
    head = next(root.all("title"), None)
    h1 = next(root.all("h1"), None)
    title = meta(root, "title") or (head.text() if head else "") or (h1.text() if h1 else "")
    page = next(root.all("html"), None)
    found = {
        "title": title,
        "author": meta(root, "author"),
        "published": [x for x in (*meta_all(root, "published"), json_ld_date(root)) if x],
        "heading_text": heading_text(root),
        "html_lang": page.attrs.get("lang", "") if page is not None else "",
        "og_locale": meta(root, "locale"),
        "alternates": alternates(root, url),
    }
    head_url, base = absolute(head_image(root), url), folder_of(url)
    lift_pictures(next(root.all("body"), root))
    content = main_content(root)
    found["text_length"] = len(re.sub(r"\s+", " ", _raw_text(content)).strip())
    collapse_carousels(content, url)
    without_noise(content, title)
    first = next((u for n in content.all("img") if (u := image_url(n, base))), None)
    return found | {"image_url": head_url or first, "content_markdown": markdown_of(content, base, h1.text() if h1 is not None else title)}


_FIELDS = "title string, author string, image_url string, published array<string>, heading_text string, html_lang string, og_locale string, alternates array<struct<language:string,url:string>>, text_length int, content_markdown string"


def _extract_rows(html: pd.Series, urls: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(h or "", u or "") for h, u in zip(html, urls, strict=True)], columns=[f.split()[0] for f in _FIELDS.split(", ")])


def extract_page(html: Column, url: Column) -> Column:
    """A struct of what ``extract`` reads."""
    return F.pandas_udf(_extract_rows, _FIELDS)(html, url)

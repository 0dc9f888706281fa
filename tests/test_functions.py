"""Scalar functions as tables of inputs and expected results."""

import hashlib

import pytest
from pyspark.sql import functions as F

from marlstone.functions import dates as D
from marlstone.functions import html as H
from marlstone.functions import json as J
from marlstone.functions import markdown as M
from marlstone.functions import text as T
from marlstone.functions import urls as U
from marlstone.operators import gate, readmodel


def values(spark, column, inputs):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string")
    return [r["y"] for r in rows.select("k", column(F.col("x")).alias("y")).orderBy("k").collect()]


def test_canonicalize(spark):
    table = {
        "HTTP://WWW.Example.com:80/a//b/?utm_source=x&b=2&a=1#top": "https://www.example.com/a/b?a=1&b=2",
        "https://example.com": "https://example.com/",
        "https://example.com/p?x&amp;fbclid=1": "https://example.com/p?x=",
        "/rel/../up?q=1": "https://base.org/up?q=1",
        "next.html": "https://base.org/dir/next.html",
        "//cdn.org/x": "https://cdn.org/x",
        "https://me:pw@X.com/a/": "https://me:pw@x.com/a",
        "mailto:a@b.c": None,
        "": "https://base.org/dir/page",
    }
    assert values(spark, lambda x: U.canonicalize_url(x, F.lit("http://base.org/dir/page")), table) == list(table.values())
    assert values(spark, U.canonicalize_url, ["", "no", None]) == [None, None, None]


def test_articles(spark):
    table = {"https://www.x.com/blog/post-1": True, "https://sub.x.com/abcd": True, "https://y.com/blog/post": False, "https://x.com/": False, "https://x.com/tag/a": False, "https://x.com/a.PDF": False, "https://x.com/{{slug}}": False, "https://x.com/press/abc": False}
    assert values(spark, lambda x: U.is_likely_article(x, F.lit("https://www.x.com/")), table) == list(table.values())
    assert values(spark, lambda x: U.is_likely_article(x, F.lit("x.com"), F.lit(True)), ["https://x.com/press/abc"]) == [True]
    allow, deny = F.array(F.lit("/blog/"), F.lit("^/r/[0-9]+$")), F.array(F.lit("/blog/old"))
    table = {"https://x.com/blog/a": True, "https://x.com/blog": False, "https://x.com/blog/old": False, "https://x.com/blog/old/b": False, "https://x.com/blog/older": True, "https://x.com/r/12/": True}
    assert values(spark, lambda x: U.is_candidate(x, F.lit("x.com"), allow, deny), table) == list(table.values())


def test_slugs(spark):
    table = {"https://x.com/a/2024-01-02-My_Post.html": "s/my-post", "https://x.com/": "s/article", "https://x.com/" + "a" * 80: "s/" + "a" * 56}
    assert values(spark, lambda x: U.article_id(F.lit("S"), x), table) == list(table.values())


@pytest.mark.parametrize(("text", "want"), [("By me, July 9, 2026 at home", "2026-07-09T00:00:00.000Z"), ("on 2025/01/10 we", "2025-01-10"), ("2026-1-5", "2026-01-05"), ("发布于2025年1月10日", "2025-01-10"), ("3/4/2025", ""), ("", "")])
def test_visible_date(spark, text, want):
    assert values(spark, D.visible_date, [text]) == [want]


def test_dates(spark):
    table = {"2024-05-06": "2024-05-06", "2024-05-06T07:08:09+02:00": "2024-05-06T05:08:09.000Z", "2024-05-06 07:08:09.5": "2024-05-06T07:08:09.500Z", "Mon, 06 May 2024 07:08:09 GMT": "2024-05-06T07:08:09.000Z", "May 6, 2024": "2024-05-06T00:00:00.000Z", "soon": None, "": None}
    assert values(spark, D.normalize_date, table) == list(table.values())
    table = {"https://x/2024/Feb/3/a": "2024-02-03", "https://x/2024/Xyz/3/a": "2024-01-01", "https://x/2024/Feb/45/a": "2024-02-01", "https://x/1812/Feb/3/a": None, "https://x/a": None}
    assert values(spark, lambda u: D.url_date(u, F.lit(r"/(\d{4})/([A-Z][a-z]{2})/(\d{1,2})/")), table) == list(table.values())
    assert values(spark, lambda u: D.url_date(u, F.lit(r"/(\d{4})/")), ["https://x/2024/a"]) == ["2024-01-01"]
    assert values(spark, D.valid_published, ["0001-01-01T00:00:00Z", "2024-01-01", None]) == [False, True, False]
    assert values(spark, D.api_published_at, ["1700000000", "2024-01-01", "x", None]) == ["2023-11-14T22:13:20.000Z", "2024-01-01T00:00:00.000Z", None, None]


def test_text(spark):
    assert values(spark, T.plain_text, ["# A *b* [c](d) ![e](f)\n```\ncode\n``` g"]) == ["A b c g"]
    assert values(spark, lambda x: T.excerpt(x, 5), ["abc def", "abc", ""]) == ["abc d…", "abc", ""]
    assert values(spark, T.cjk_ratio, ["", "ab", "汉字", "汉a"]) == [0.0, 0.0, 1.0, 0.5]
    assert values(spark, T.decode_entities, ["<![CDATA[a]]> &amp;lt; &#65;&#x42; &quot;&nope;"]) == ['a &lt; AB "&nope;']
    assert values(spark, T.normalize_article, ["a\r\n\r\n\r\n\r\nb\n1 / 3\n## Related articles\nc"]) == ["a\n\nb"]
    assert values(spark, T.heading_id, ["Héllo, World!", "!!"]) == ["héllo-world", "section"]
    raw = lambda *x: F.array(*[F.lit(v) for v in x])
    for got, want in ((raw("ai", "AI ", "other."), ["AI", "Other"]), (raw("Bogus"), ["Other"]), (F.lit(None).cast("array<string>"), ["Other"])):
        assert spark.range(1).select(T.normalize_categories(got).alias("y")).first()["y"] == want


def test_gate(spark):
    rows = [(" ", "short", "2024-01-01"), ("t", "word " * 60, "2024-01-01"), ("t", "word " * 60 + "TODO ![a](x.png) ![b](data:x)", None), ("t", "[a](http://a/) [b](http://b/) [c](http://c/)", "2024-01-01"), (None, None, None)]
    got = [[i["code"] for i in r["issues"]] for r in gate.gate(spark.createDataFrame(rows, "title string, content_markdown string, published_at string")).collect()]
    assert got == [["missing-title", "content-too-short"], [], ["missing-published-date", "todo-marker", "image-url-not-absolute"], ["content-too-short", "looks-like-navigation-list"], ["missing-title", "content-too-short", "missing-published-date"]]


def test_markdown():
    text = "# A [x](http://u/1)\n\nT `c` $x+1$ ![i](http://i/p.png \"t\")\n\n```py\na\n```\n\n$$\ny\n$$\n\n## B\n\n- one"
    held, spans = M.protect(text)
    assert [k for k, _, _ in spans] == ["url", "inline-code", "inline-math", "url", "code", "math"]
    assert M.restore(held, spans) == text
    with pytest.raises(ValueError):
        M.restore(held + spans[0][1], spans)
    with pytest.raises(ValueError):
        M.protect(spans[0][1])
    loose = "\n\n a\r\n\r\n\r\n# H\npara `x`\n\n\n\n"
    held, spans = M.protect(loose)
    assert "`x`" not in held and M.restore(held, spans) == loose.replace("\r\n", "\n")
    parts = M.chunks(text)
    assert [c["heading_path"] for c in parts] == [["A x"], ["A x", "B"]]
    assert [len(c["spans"]) for c in parts] == [6, 0] and "http" not in parts[0]["source"]
    assert [k for k, _ in M.math_inventory(text)] == ["inline-math", "math"]
    page = M.render("# T\n\n## T\n\n[a](javascript:x) <b>\n\n| a | b |\n|---|---|\n| 1 | 2 |")
    assert '<h2 id="t">' in page and '<h2 id="t-2">' in page and "javascript" not in page and "<b>" not in page and "<td>2</td>" in page


def test_chunks():
    text = "# Doc\n\nIntro paragraph.\n\n## Section A\n\nA text here.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n### Deep\n\ndeep\n\n## Section B\n\n" + "long " * 40
    parts = M.chunks(text, 20)
    assert [c["heading_path"] for c in parts] == [["Doc"], ["Doc", "Section A"], ["Doc", "Section A", "Deep"], ["Doc", "Section B"], ["Doc", "Section B"]]
    assert [c["oversized"] for c in parts] == [False, False, False, False, True]
    assert "| 1 | 2 |" in parts[1]["source"]
    assert [c["id"] for c in parts] == ["chunk-" + hashlib.sha1(f"{'|'.join(c['heading_path'])}#{k}".encode()).hexdigest()[:8] for k, c in enumerate(parts)]
    assert all(c["sha256"] == hashlib.sha256(c["source"].encode()).hexdigest() and c["tokens"] == -(-len(c["source"]) // 4) for c in parts)
    with pytest.raises(ValueError):
        M.chunks(text, 20, 3)


def test_plan():
    some = M.plan("# A\n\ntext", " T ", False)
    assert (some["mode"], some["title"]["source"], some["n_chunks"], some["oversize_blocks"]) == ("translate", "T", 1, 0)
    assert some["title"]["id"] == "chunk-" + hashlib.sha1(b"<title>#0").hexdigest()[:8] and some["total_tokens"] == 3
    own = M.plan("汉字 `x`", None, False)
    assert (own["mode"], own["title"], own["chunks"][0]["source"], own["chunks"][0]["spans"]) == ("native-zh", None, "汉字 `x`", [])
    assert M.plan("text `x`", "", True)["mode"] == "official-zh"
    for bad in (lambda: M.plan(" ", "t", False), lambda: M.plan("a", "t", False, 0), lambda: M.plan("a {{BW:url:1}}", "t", False)):
        with pytest.raises(ValueError):
            bad()


def test_languages(spark):
    rows = spark.createDataFrame([("english", "fr_FR"), ("fil-PH", "x"), (" DE-at ", None), (None, " zh_CN"), ("", "")], "a string, b string")
    assert [r["y"] for r in rows.select(T.primary_language(F.col("a"), F.col("b")).alias("y")).collect()] == ["fr", "en", "de", "zh", "en"]
    pair = lambda *tags: F.array(*[F.struct(F.lit(t).alias("language"), F.lit(f"u{k}").alias("url")) for k, t in enumerate(tags)])
    for tags, want in ((("zh-cn", "zh-Hans-CN"), "u1"), (("en", "zh_SG"), "u1"), (("zh", "zh-hans"), "u1"), (("zh-hans-tw",), "u0"), (("zh-hansx", "zh-hant"), None)):
        assert spark.range(1).select(readmodel.official_chinese(pair(*tags))["url"].alias("y")).first()["y"] == want


def test_paths(spark):
    table = {"https://X.com/en/grok-4-5": "https://x.com/zh/grok-4-5/", "https://x.com/en/7?a=1#b": "https://x.com/zh/7/?a=1#b", "https://x.com/en/": "https://x.com/zh/", "https://x.com/english": None, "nowhere": None}
    assert values(spark, lambda x: U.map_path(x, F.create_map(F.lit("/en/"), F.lit("/zh/"))), table) == list(table.values())
    assert values(spark, lambda x: U.map_path(x, F.create_map(F.lit("/"), F.lit("/zh"))), ["https://x.com/blog/a"]) == ["https://x.com/zh/blog/a/"]
    table = {"blog/en/a/b.md": "blog/a/b", "blog/en/a": "blog/a", "blog/a": "blog/a"}
    assert values(spark, U.drop_language, table) == list(table.values())
    table = {"https://x.com/a.html": "https://x.com/a.html", "https://x.com/v.longextension": "https://x.com/v.longextension/", "https://x.com/a?q": "https://x.com/a/?q"}
    assert values(spark, U.directory_base, table) == list(table.values())
    assert values(spark, U.encode_part, ["a b/ü(1)~*'!"]) == ["a%20b%2F%C3%BC(1)~*'!"]


def test_published_order(spark):
    rows = spark.createDataFrame([("soon", "2024-01-02", None), ("", None, "May 6, 2024"), (None, "x", "y")], "a string, b string, c string")
    assert [r["y"] for r in rows.select(D.resolve_published(*map(F.col, "abc")).alias("y")).collect()] == ["2024-01-02", "2024-05-06T00:00:00.000Z", ""]
    assert [r["y"] for r in rows.select(D.first_date(F.array(*"abc")).alias("y")).collect()] == ["2024-01-02", "2024-05-06T00:00:00.000Z", None]


def test_html_noise():
    page = H.extract("<html><head><title>My Title</title><meta property=author content=Me><meta name=date content=soon><meta itemprop=datePublished content=2024-01-02><link rel=image_src href=/i.png></head><body><article><p>Text</p><div class=share-bar>Share</div><div id=x>my title and more</div><div>my title stays</div><footer>" + "f" * 2000 + "</footer><blockquote><p>Q</p><footer class=quote-footer>Who</footer></blockquote><div role=complementary>c</div><div class=sidebar>" + "s" * 1001 + "</div><a rel='x alternate' hreflang=zh-CN href=/zh>zh</a></article>", "https://s.com/p")
    assert (page["author"], page["image_url"], page["published"]) == ("Me", "https://s.com/i.png", ["soon", "2024-01-02"])
    assert page["alternates"] == [{"language": "zh-cn", "url": "https://s.com/zh"}]
    assert page["content_markdown"] == "Text\n\nmy title stays\n\n> Q\n>\n> Who\n\n" + "s" * 1001 + "\n\n[zh](https://s.com/zh)"


def test_html():
    page = H.extract('<html lang="de"><title>T</title><meta name="author" content="Me"><link rel=alternate hreflang=zh_CN href=/zh><body><nav>n</nav><article><h1>Big</h1><p>Hi <b>you</b><img data-src="i.png"></p><ul><li>a<li>b</ul><table><tr><th>h<tr><td>1|2<td>3</table><footer>f</footer></article>', "https://s.com/p/q")
    assert (page["title"], page["author"], page["alternates"]) == ("T", "Me", [{"language": "zh-cn", "url": "https://s.com/zh"}])
    assert page["content_markdown"] == "Hi **you**![](https://s.com/p/q/i.png)\n\n- a\n- b\n\n| h |  |\n| --- | --- |\n| 1\\|2 | 3 |"
    assert H.best_candidate("a.png 1x, b.png 2x, c.png 2x") == "c.png" and H.candidates("a, b 0.5x, c 2w") == ["c", "b", "a"]


def test_html_pictures():
    frame = "<div class=media><div><picture><source srcset='https://i.org/s.png 1x, https://i.org/l.png 2x'><img src=small.png alt=A></picture><p class=caption>Words.</p></div></div>"
    gallery = "<div><picture><img src=1.png></picture><picture><img src=2.png></picture></div>"
    root = H.parse(f"<body><article><p>{'text ' * 300}</p>{frame}{gallery}<figure><picture><img src=f.png></picture></figure></article></body>")
    assert H.lift_pictures(next(root.all("body"))) == 3
    made = H.markdown_of(next(root.all("article")), "https://x.com/a/")
    assert "![A](https://i.org/l.png)" in made and "Words." in made and made.count("Words.") == 1
    assert all(f"https://x.com/a/{n}.png" in made for n in "12f")
    page = H.extract("<body><article><p>" + "text " * 60 + "</p><img src=pic.png><a href=#top>up</a><a href=mailto:a@b.c>m</a></article></body>", "https://x.com/post")
    assert page["image_url"] == "https://x.com/post/pic.png" and page["text_length"] > 290
    assert "[up](https://x.com/post/#top)" in page["content_markdown"] and "(mailto:a@b.c)" in page["content_markdown"]


def test_html_carousel():
    slide = lambda k: f"<div><img src=l{k}.png alt='Logo {k}'><blockquote><p>Quote {k}</p><footer>Who {k}</footer></blockquote></div>"
    page = f"<div><p>before</p><section class=x><div class=track>{''.join(map(slide, range(5)))}</div><span class=counter>1 / 5</span><button class=next>next</button></section><p>after</p></div>"
    root = H.parse(page)
    assert H.collapse_carousels(root, "https://x.com/p") == 1
    text = root.text()
    assert all(f"Quote {k}" in text and f"Who {k}" in text for k in range(3)) and "Quote 3" not in text
    assert "before" in text and "after" in text and "更多客户证言请见原文。" in text
    assert H.collapse_carousels(H.parse("<div class=carousel><p>no slides</p></div><p>x</p>"), "u") == 0
    named = H.parse("<div class=my-carousel>" + "".join(f"<div class=carousel-item>s{k}</div>" for k in range(4)) + "<ul class=dots><li>.</li></ul></div>")
    assert H.collapse_carousels(named, "u") == 1 and "s2" in named.text() and "s3" not in named.text() and "." not in named.text()


def test_heading_text():
    root = H.parse("<h1>Other</h1><article><div><h1>T</h1><span>July 9, 2026</span></div></article>")
    assert H.heading_text(root) == "TJuly 9, 2026 | July 9, 2026"


def test_json():
    assert J.balanced_object('x {"a": "}", "b": {"c": 1}} y') == '{"a": "}", "b": {"c": 1}}'
    assert J.balanced_object("none {") is None

"""Merges, state, discovery, sources and the stream: idempotence and edge cases."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import discovery, merge, readmodel, state
from marlstone.plans import registry
from marlstone.sources import corpus
from marlstone.streaming import incremental

ITEMS = incremental.ITEM_SCHEMA


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_merge_is_idempotent(spark):
    schema = "id string, source_id string, original_url string, image_url string, author string, source_domain string"
    old = spark.createDataFrame([("1", "s", "u1", "i", "a", "d"), ("2", "s", "u2", None, "b", "d")], schema)
    new = spark.createDataFrame([("9", "s", "u1", None, "z", "e"), ("3", "s", "u3", "j", None, "e")], schema)
    once = merge.merge_articles(old, new)
    assert rows(once) == [("1", "s", "u1", "i", "z", "e"), ("2", "s", "u2", None, "b", "d"), ("3", "s", "u3", "j", None, "e")]
    assert rows(merge.merge_articles(once, new)) == rows(once)
    assert rows(merge.changed_ids(old, new)) == [("s", "u1", "1", "9")]
    assert rows(merge.merge_articles(old.limit(0), new)) == rows(new)
    assert rows(merge.merge_articles(old, new, keep_missing=False))[0][3:] == (None, "z", "d")


def test_versions_write_once(spark):
    schema = "article_id string, language string, title string, provenance string, translated_at string"
    old = spark.createDataFrame([("a", "zh", "t", "model", "t0"), ("b", "zh", "t", "model", None)], schema)
    new = spark.createDataFrame([("a", "zh", "n", "model", "t1"), ("b", "zh", "n", "model", "t1"), ("c", "zh", "n", "official-zh", "t1")], schema)
    assert rows(merge.merge_versions(old, new)) == [("a", "zh", "n", "model", "t0"), ("b", "zh", "n", "model", "t1"), ("c", "zh", "n", "official-zh", None)]


def test_categories(spark):
    had = spark.createDataFrame([("a", "AI"), ("b", "AI"), ("c", "AI")], "article_id string, category_name string")
    given = spark.createDataFrame([("a", None), ("b", []), ("c", ["Agent", "Agent"]), ("d", ["AI"])], "article_id string, categories array<string>")
    assert rows(merge.replace_categories(had, given)) == [("a", "AI"), ("c", "Agent"), ("d", "AI")]


def item(url, status, attempts=0, error=None):
    return ("s", url, status, attempts, error, None, "t0", "t0")


def test_state(spark):
    items = spark.createDataFrame([item("a", "failed", 2, "e"), item("b", "published"), item("c", "fetching")], ITEMS)
    found = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "n"), ("s", "n")], "source_id string, original_url string")
    after = {r["original_url"]: (r["status"], r["attempt_count"], r["last_error"]) for r in state.discover(items, found, F.lit("t1")).collect()}
    assert after == {"a": ("discovered", 2, None), "b": ("published", 0, None), "c": ("fetching", 0, None), "n": ("discovered", 0, None)}
    moves = spark.createDataFrame([("s", "c", "fetched", "x"), ("s", "b", "fetching", None), ("s", "?", "fetched", None)], "source_id string, original_url string, to_status string, article_id string")
    good, refused = state.transition(items, moves, F.lit("t1"))
    assert {r["original_url"]: r["status"] for r in good.collect()} == {"a": "failed", "b": "published", "c": "fetched"}
    assert {r["original_url"]: r["reason"] for r in refused.collect()} == {"b": "invalid transition: published -> fetching", "?": "unknown item"}
    failures = found.withColumn("error", F.lit("x")).distinct()
    assert {r["original_url"]: (r["status"], r["attempt_count"]) for r in state.record_failures(items, failures, F.lit("t1")).collect()} == {"a": ("failed", 3), "b": ("published", 0), "c": ("fetching", 0)}
    stored = spark.createDataFrame([("s", "z"), ("other", "y"), ("s", "b")], "source_id string, original_url string")
    _, inserted = state.reconcile(items, stored, spark.createDataFrame([("s",)], "id string"), F.lit("t1"))
    assert [r["original_url"] for r in inserted.collect()] == ["z"]


def test_discovery(spark):
    xml = "<feed><entry><title>A &amp; B</title><link href='/p/one?utm_source=x'/><updated>2024-01-01</updated></entry><entry><link href='/p/one'/></entry></feed>"
    got = discovery.parse_feeds(spark.createDataFrame([("s", "https://x.com/feed", xml)], "source_id string, url string, body string")).collect()
    assert [(r["url"], r["title"], r["published_at"], r["seq"]) for r in got] == [("https://x.com/p/one", "A & B", "2024-01-01", 0)]
    index = "<sitemapindex><sitemap><loc>https://x.com/blog/map.xml</loc></sitemap><sitemap><loc>https://x.com/blog.xml</loc></sitemap></sitemapindex>"
    child = lambda n: f"<urlset><url><loc>https://x.com/{n}/1</loc></url><url><loc>https://x.com/{n}/2</loc></url></urlset>"
    schema = "source_id string, url string, body string"
    entries = discovery.parse_sitemaps(spark.createDataFrame([("s", "https://x.com/sitemap.xml", index)], schema))
    children = spark.createDataFrame([("s", "https://x.com/blog/map.xml", child("blog")), ("s", "https://x.com/blog.xml", child("other"))], schema)
    # a folder takes what lies under it, with or without a slash at its end, and nothing that only begins alike
    for folder in ("/blog", "/blog/"):
        assert sorted(r["url"] for r in discovery.expand_sitemaps(entries, children, F.array(F.lit(folder))).collect()) == ["https://x.com/blog/1", "https://x.com/blog/2"]
    assert sorted(r["url"] for r in discovery.expand_sitemaps(entries, children, F.array().cast("array<string>")).collect()) == ["https://x.com/blog.xml", "https://x.com/blog/map.xml"]
    replies = spark.createDataFrame([("s", '[{"id": 5, "customUrl": "", "slug": "no", "url": "https://x.com/own"}, {"id": "a b", "slug": "c/d"}, {"slug": "without"}]')], "source_id string, body string").selectExpr("source_id", "concat('{\"l\":', body, '}') as body")
    assert sorted(r["url"] for r in discovery.parse_json_lists(replies, "l", "https://x.com/{id}/{slug}").collect()) == ["https://x.com/5/5", "https://x.com/a%20b/c%2Fd"]
    assert [r["url"] for r in discovery.parse_json_lists(replies, "l").collect()] == ["https://x.com/own"]
    assert discovery.expand_sitemaps(entries, children).count() == 4
    assert discovery.expand_sitemaps(entries, children, most=1).count() == 2
    a = spark.createDataFrame([("s", "u1", 0)], "source_id string, url string, seq int")
    b = spark.createDataFrame([("s", "u1", 0), ("s", "u2", 1), ("t", "u3", 0)], "source_id string, url string, seq int")
    every = discovery.union_paths(rss=b, api=a)
    assert sorted((r["url"], r["path"]) for r in discovery.merged(every).collect()) == [("u1", "api"), ("u2", "rss"), ("u3", "rss")]
    assert sorted((r["source_id"], r["url"]) for r in discovery.fallback(every, F.lit(True)).collect()) == [("s", "u1"), ("t", "u3")]


def test_related_is_bounded(spark):
    items = spark.createDataFrame([(k, "s", "en", f"2024-01-{k:02d}") for k in range(1, 9)], "id int, source_id string, language string, published_at string")
    got = {}
    for r in readmodel.related(items).orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append(r["related"])
    assert got[1] == [8, 7, 6] and got[8] == [7, 6, 5]


def test_corpus(spark, tmp_path):
    folder = tmp_path / "blog" / "en"
    folder.mkdir(parents=True)
    (folder / "post.md").write_text('---\nblog_id: "s"\noriginal_url: "https://x.com/a"\nlanguage: "en"\nis_original: true\ntitle: "A \\"q\\""\npublished_at: 2024-01-01\ncategories:\n  - "AI"\n  - "Other"\nsource_domain: "x.com"\noriginal_language: "en"\nprovenance: "original"\nversion_at: 2024-01-02\n---\nBody\n\n')
    (folder / "more").mkdir()
    (folder / "more" / "deep.md").write_text((folder / "post.md").read_text().replace("version_at: 2024-01-02\n", ""))
    (folder / "bad.md").write_text("no header")
    got = {r["article_id"]: r for r in corpus.parse_versions(corpus.read_markdown(spark, str(tmp_path))).collect()}
    good = got["blog/post"]
    assert (good["title"], good["categories"], good["content_markdown"], good["error"]) == ('A "q"', ["AI", "Other"], "Body", None)
    assert got["blog/more/deep"]["error"] == "missing: version_at"
    assert got["blog/bad"]["error"].startswith("missing: blog_id")
    twice = corpus.parse_versions(corpus.read_markdown(spark, str(tmp_path))).where("error is null")
    twice = twice.union(twice.withColumn("path", F.lit("blog/en/a.md")).withColumn("title", F.lit("first")))
    assert [r["title"] for r in corpus.first_versions(twice).collect()] == ["first"]
    (tmp_path / "state.json").write_text('{"version": 1, "blogs": {"s": ["u", "u", "v"]}}')
    (tmp_path / "flat.json").write_text('{"t": ["w"]}')
    assert rows(corpus.read_processed(spark, str(tmp_path / "state.json"))) == [("s", "u"), ("s", "v")]
    assert rows(corpus.read_processed(spark, str(tmp_path / "flat.json"))) == [("t", "w")]
    (tmp_path / "r.json").write_text('[{"id": "s", "name": "S", "type": "firm", "homepage_url": "x", "blog_url": "https://x.com", "domain": "x.com", "update_mode": "active"}]')
    assert sorted(r["path"] for r in corpus.registry_issues(corpus.read_registry(spark, str(tmp_path / "r.json"))).collect()) == ["homepage_url", "type"]
    assert corpus.registry_error(corpus.read_registry(spark, str(tmp_path / "r.json"))).first()["error"].startswith("s: homepage_url is not an http(s) address\ns: type must be")


def test_frontmatter_roundtrip(spark, sf):
    got = registry.QUERIES["frontmatter_roundtrip"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(r["body"] == f"Body {r['doc_id']}" for r in got)
    texts = {"a": "a", "\n a \u00a0\n\n": "\n a", "a\n---\nb\r\n": "a\n---\nb", "": "", " \n": "", "a \u0085": "a \u0085"}
    head = T.frontmatter(*[F.lit("x")] * 6, F.array(F.lit("AI")), *[F.lit("x")] * 3, F.col("t"))
    files = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.version_file(head, F.col("t")).alias("f"))
    assert {r["t"]: r["b"] for r in files.select("t", T.body_of(F.col("f")).alias("b")).collect()} == texts


def test_frontmatter_of_odd_values(spark, tmp_path):
    odd = [None, "", 'q"x', "back\\slash", "l\nf", "c\rr", "\u2028ls", "a\u2028b", "a\u2029b", "a\u0085b", "\n---\n", " lead", "trail ", 'title: "x"', '\n  - "x"', "\x01\x0b", "\ufeff\u00a0"]
    docs = [(k, v, "en") for k, v in enumerate(odd)] + [(100 + k, "s", v) for k, v in enumerate(odd)] + [(100, "s", None), (None, "s", "en")]
    spark.createDataFrame(docs, "doc_id long, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["frontmatter_roundtrip"](spark, str(tmp_path))
    assert rows(got) == sorted(((k, s, None if v is None else f'q"{v}', ["AI", "Other"], None if k is None else f"Body {k}") for k, s, v in docs), key=repr)


def test_frontmatter_with_windows_line_ends(spark):
    text = '---\ntitle: "a\u2028b" \nversion_at: 2024-01-02\ncategories:\n  - "AI"\n  - plain\n  - "a" b\nauthor: "x"\n---\nBody\n'
    files = spark.createDataFrame([(text,), (text.replace("\n", "\r\n"),)], "f string")
    f = F.col("f")
    got = files.select(T.frontmatter_value(f, "title"), T.frontmatter_value(f, "version_at"), T.frontmatter_value(f, "author"), T.frontmatter_categories(f), T.body_of(f)).collect()
    assert [tuple(r) for r in got] == [("a\u2028b", "2024-01-02", "x", ["AI", "plain", '"a" b'], "Body")] * 2


def test_stream(spark, tmp_path):
    schema = "source_id string, original_url string"
    for k, urls in enumerate((["a", "b"], ["b", "c"])):
        spark.createDataFrame([("s", u) for u in urls], schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    for k in range(2):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in*"))
        if k == 0:
            incremental.discover_stream(stream, str(tmp_path / "items"), str(tmp_path / "cp"), "t").awaitTermination(120)
    last = max((tmp_path / "items").iterdir())
    # later batches, of which the first snapshots go
    for k, url in enumerate("defg"):
        spark.createDataFrame([("s", url)], schema).coalesce(1).write.parquet(str(tmp_path / f"more{k}"))
        more = spark.readStream.schema(schema).parquet(str(tmp_path / "more*"))
        incremental.discover_stream(more, str(tmp_path / "later"), str(tmp_path / "cp2"), "t", keep=2).awaitTermination(120)
    left = sorted((tmp_path / "later").iterdir())
    assert len(left) == 2 and {r["original_url"] for r in spark.read.parquet(str(left[-1])).collect()} == set("defg")
    assert {r["original_url"] for r in spark.read.parquet(str(last)).collect()} == {"a", "b", "c"}


@pytest.mark.parametrize("missing", ["marlstone.llm", "ahocorasick", "corpus_pipeline"])
def test_entry_without_llm(spark, sf, monkeypatch, missing):
    import sys

    import __spark_entry__

    for name in [n for n in sys.modules if n.split(".")[:2] == ["marlstone", "llm"] or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)  # an import of it fails
    with pytest.warns(UserWarning, match="is left out"):
        names = set(__spark_entry__.queries())
    if missing == "corpus_pipeline":
        assert "pipeline" not in names
        return
    with pytest.warns(UserWarning):
        oracles = set(__spark_entry__.oracle_sql())
    assert names >= oracles and not any(n.startswith("op") and n[2].isdigit() for n in names)
    assert __spark_entry__.entry(spark).count() > 0

"""Runs, payloads and the checks around them, on rows whose every case is known."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import guards as G
from marlstone.functions import markdown as M
from marlstone.operators import runs, translate
from marlstone.plans import registry

LONG = "word " * 60


def values(spark, column, inputs):
    rows = spark.createDataFrame(list(enumerate(inputs)), "k int, x string")
    return [r["y"] for r in rows.select("k", column(F.col("x")).alias("y")).orderBy("k").collect()]


def test_selected_sources(spark):
    registry = spark.createDataFrame([("a", "active"), ("b", "dry-run-only"), ("c", None)], "id string, update_mode string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(runs.selected_sources(registry)) == ["a", "c"]
    assert ids(runs.selected_sources(registry, dry_run=True)) == ["a", "b", "c"]
    assert ids(runs.selected_sources(registry, "b", dry_run=True)) == ["b"]
    for name in ("b", "nowhere"):
        with pytest.raises(ValueError):
            runs.selected_sources(registry, name)


def tables(spark):
    sources = spark.createDataFrame([("s", 4, None), ("t", 0, 10)], "id string, limit int, min_content_chars int")
    found = spark.createDataFrame([("s", f"u{k}", f"2024-01-{20 - k:02d}" if k else None, k) for k in range(8)] + [("t", "v", "2024-01-01", 0), ("none", "w", None, 0)], "source_id string, url string, published_at string, seq int")
    seen = spark.createDataFrame([("s", "u1"), ("s", "u1"), ("t", "u2")], "source_id string, url string")
    # newest unseen of s: u2, u3, u4, u5; the undated u0 is the last
    fetched = spark.createDataFrame([("s", "u2", "t", LONG, "2024-01-01", None), ("s", "u3", "t", "short", "2024-01-01", None), ("s", "u4", "t", LONG, "2024-01-01", "HTTP 500"), ("t", "v", "t", "ten signs.", "2024-01-01", None)], "source_id string, url string, title string, content_markdown string, published_at string, error string")
    return sources, found, seen, fetched


def test_run_update(spark):
    translated = spark.createDataFrame([("s", "u2", "model down")], "source_id string, url string, error string")
    items = runs.run_update(*tables(spark), translated).cache()
    got = {r["url"]: (r["disposition"], r["error_kind"], r["error_code"], r["error"], r["marked"]) for r in items.collect()}
    assert got == {
        "u0": ("over-limit", None, None, None, False),
        "u1": ("seen", None, None, None, False),
        "u2": ("saved", "fatal", None, "model down", True),
        "u3": ("rejected", "integrity", "content-too-short", "integrity gate: content-too-short", True),
        "u4": ("fetch-failed", "fatal", None, "HTTP 500", False),
        "u5": ("fetch-failed", "fatal", None, "no page", False),
        "u6": ("over-limit", None, None, None, False),
        "u7": ("over-limit", None, None, None, False),
        "v": ("saved", "fatal", None, "no translation", True),
    }
    sums = {r["source_id"]: tuple(r)[1:] for r in runs.update_summary(items).collect()}
    assert sums == {"s": (8, 7, 0, 4, "partial"), "t": (1, 1, 0, 1, "partial")}


def test_dry_run_marks_nothing(spark):
    items = runs.run_update(*tables(spark), limit=1).collect()
    assert {r["url"]: r["disposition"] for r in items if r["disposition"] not in ("seen", "over-limit")} == {"u2": "validated", "v": "validated"}
    assert not any(r["marked"] for r in items)


def test_run_backfill(spark):
    sources = spark.createDataFrame([("a", ("since", "2024-01-05", 3, False), r"/(\\d{4})/"), ("b", None, None), ("c", None, None)], "id string, backfill struct<mode:string,since:string,max_articles:int,quality_filter:boolean>, url_date_pattern string")
    listed = spark.createDataFrame([("a", "all", None, 0, False, None), ("b", "all", None, 1, True, None)], "source_id string, mode string, since string, max_articles int, quality_filter boolean, url_date_pattern string")
    with_ = runs.with_policy(sources, listed)
    assert {r["id"]: r["policy"] and (r["policy"]["mode"], r["policy"]["max_articles"]) for r in with_.collect()} == {"a": ("since", 3), "b": ("all", 1), "c": None}
    found = spark.createDataFrame([("a", f"https://x/{k}", f"2024-01-{k:02d}", k) for k in range(3, 10)] + [("b", "https://y/1", None, 0), ("b", "https://y/2", None, 1), ("c", "https://z/1", "2000-01-01", 0)], "source_id string, url string, published_at string, seq int")
    page = lambda s, u, at, text=LONG: (s, u, "t", text, at, None)
    fetched = spark.createDataFrame([page("a", "https://x/9", "2024-01-09", LONG + "$x$ ![i](https://i/j)"), page("a", "https://x/8", "2023-01-01"), page("a", "https://x/7", ""), page("b", "https://y/1", "2024-02-03", LONG + "paid episode"), page("c", "https://z/1", "2000-01-01T05:00:00Z")], "source_id string, url string, title string, content_markdown string, published_at string, error string")
    items = runs.run_backfill(with_, found, fetched).cache()
    got = {r["url"]: (r["disposition"], r["error_code"]) for r in items.collect()}
    assert got == {
        "https://x/3": ("skipped-by-date", None),
        "https://x/4": ("skipped-by-date", None),
        "https://x/5": ("truncated", None),
        "https://x/6": ("truncated", None),
        "https://x/7": ("rejected", "missing-published-date"),
        "https://x/8": ("outside-window", "outside-backfill-window"),
        "https://x/9": ("saved", None),
        "https://y/1": ("rejected", "paid-episode-paywall"),
        "https://y/2": ("truncated", None),
        "https://z/1": ("saved", None),
    }
    counts = {r["source_id"]: tuple(r)[1:] for r in runs.backfill_counters(items).collect()}
    assert counts["a"] == (7, 5, 2, 2, 1, 2, "2024-01-09", "2024-01-09", 1, 0, 1)
    assert counts["c"] == (1, 1, 0, 0, 1, 0, "2000-01-01", "2000-01-01", 0, 0, 0)
    lines = {r["source_id"]: r["line"] for r in runs.backfill_report(runs.backfill_counters(items)).collect()}
    assert lines["c"] == "| c | 1 | 1 | 0 | 0 | 1 | 0 | 2000-01-01 | 2000-01-01 | 0 | 0 | 0 |" and lines[None].startswith("| **total** | **10** | **8** |")
    assert len(runs.error_lines(items).collect()) == 3 and runs.manifests(items).count() == 5


def test_unique_slugs(spark):
    new = spark.createDataFrame([("s", f"https://x.com/{k}/post", k) for k in range(4)] + [("s", "https://x.com/0/post", 9), ("s", "https://x.com/old", 5), ("s", "https://x.com/free", 6)], "source_id string, url string, seq int")
    taken = spark.createDataFrame([("s/post", "https://else"), ("s/post-3", "https://else2"), ("s/old", "https://x.com/old")], "id string, url string")
    got = {r["url"].removeprefix("https://x.com/"): (r["id"], r["created"]) for r in runs.unique_slugs(new, taken).collect()}
    assert got == {"0/post": ("s/post-2", True), "1/post": ("s/post-4", True), "2/post": ("s/post-5", True), "3/post": ("s/post-6", True), "old": ("s/old", False), "free": ("s/free", True)}


def test_sync(spark):
    got = spark.createDataFrame([("s", "u", [1, 2], ["AI"]), ("s", "v", [1], None), ("t", "u", [], [])], "source_id string, original_url string, versions array<int>, categories array<string>")
    sources = spark.createDataFrame([("s",)], "id string")
    stored = spark.createDataFrame([("s", "u"), ("s", "u"), ("z", "v")], "source_id string, original_url string")
    row = runs.run_sync(got, sources, stored, spark.createDataFrame([("t",)], "id string"), batch=4).first()
    # 1 source; 1 + 2 + 3; 1 + 1; 1 + 0 + 1
    assert tuple(row) == (True, 3, 2, 1, 11, 3, 0)
    assert tuple(runs.run_sync(got, sources, stored, sources).first()) == (False, 3, 0, 0, 0, 0, 1)
    assert tuple(runs.run_sync(got.limit(0), sources, stored, sources).first()) == (True, 0, 0, 0, 1, 1, 0)


def test_guards(spark):
    table = {"INSERT INTO t VALUES (1);": True, "update t set a = 1 ; ": True, "DELETE FROM a; DROP TABLE b": False, "CREATE TABLE t": False, "inserted": False, " ": True, "": True}
    assert values(spark, G.allowed_statement, table) == list(table.values())
    assert values(spark, G.sql_literal, ["it's", None]) == ["'it''s'", "NULL"]
    now = F.lit("2024-05-07 10:00:00").cast("timestamp")
    table = {"5": 5000, "0.5": 500, "3600": 60000, "Tue, 07 May 2024 10:00:15 GMT": 15000, "Tue, 07 May 2024 09:00:00 GMT": 0, "soon": None, "": None, "-1": None}
    assert values(spark, lambda x: G.retry_after(x, now), table) == list(table.values())
    table = {"LOCALHOST": True, "a.local": True, "10.0.0.1": True, "172.16.0.1": True, "172.32.0.1": False, "192.168.1.1": True, "169.254.0.9": True, "[::1]": True, "fd00::1": True, "fdic.gov": False, "10.0.0.999": False, "8.8.8.8": False}
    assert values(spark, G.private_host, table) == list(table.values())
    entries = G.no_proxy_entries(F.lit(" www.x.com,, Y.org "))
    assert values(spark, lambda h: G.bypasses_proxy(h, entries), ["x.com", "a.x.com", "ax.com", "y.org", "z"]) == [True, True, False, True, False]
    assert values(spark, lambda h: G.bypasses_proxy(h, G.no_proxy_entries(F.lit("*"))), ["z"]) == [True]
    assert values(spark, lambda x: G.same_token(x, F.lit("k")), ["k", "K"]) == [True, False]
    assert values(spark, G.too_short, ["a " * 100, "a  " * 101, None])[1:] == [None, "extracted content too short (0 chars, minimum 200)"]
    table = {"{id}": "7", "x{id}": '"x7"', "{lang}": '"en"', 'q"': '"q\\""'}
    assert values(spark, lambda t: G.request_value(t, F.lit("7"), F.lit("en")), table) == list(table.values())


def test_proxy_settings():
    assert G.proxy_settings({}) == {"enabled": False, "url": "http://127.0.0.1:7897", "no_proxy": []}
    assert G.proxy_settings({"USE_PROXY": " true ", "PROXY_URL": "https://p:1", "NO_PROXY": "www.A.org, b  c"})["no_proxy"] == ["a.org", "b", "c"]
    for bad in ({"USE_PROXY": "yes"}, {"USE_PROXY": "true", "PROXY_URL": "socks://p"}):
        with pytest.raises(ValueError):
            G.proxy_settings(bad)


def test_commits_and_statements(spark):
    table = {'[{"commit":{"committer":{"date":"2024-02-02T00:00:00Z"}}},{"commit":{"committer":{"date":"2020-01-01T00:00:00Z"}}}]': "2020-01-01T00:00:00.000Z", "[]": "", "junk": "", '[{"commit":{}}]': ""}
    assert values(spark, G.first_commit_date, table) == list(table.values())
    statement = lambda x: G.upsert_statement("t", {"k": F.lit(1), "v": x}, ("k",))
    assert values(spark, statement, ["o'clock", None]) == ["INSERT INTO t (k, v) VALUES ('1', 'o''clock') ON CONFLICT(k) DO UPDATE SET v=excluded.v;", "INSERT INTO t (k, v) VALUES ('1', NULL) ON CONFLICT(k) DO UPDATE SET v=excluded.v;"]
    assert values(spark, lambda x: G.upsert_statement("t", {"k": x}, ("k",)), ["a"]) == ["INSERT INTO t (k) VALUES ('a') ON CONFLICT(k) DO NOTHING;"]


def test_audit(spark):
    rows = spark.createDataFrame([("u1", "t", LONG, "2024-01-01", "en", None), ("u2", "", "short ![a](b.png)", None, None, None), ("u3", None, None, None, None, "HTTP 404")], "url string, title string, content_markdown string, published_at string, language string, error string")
    got = {r["url"]: (r["passed"], r["codes"], r["line"]) for r in runs.audit(rows).collect()}
    assert got["u1"] == (True, [], "PASS u1\n  title=t date=2024-01-01 lang=en markdown=300 images=0")
    assert got["u2"][1] == ["missing-title", "content-too-short", "missing-published-date", "image-url-not-absolute", "missing-published-date"]
    assert got["u3"] == (False, ["fetch-or-extraction-failed"], "FAIL u3\n  error=HTTP 404\n  issues=fetch-or-extraction-failed")


def test_absolute_markdown(spark):
    base = F.lit("https://x.com/blog/post?q=1")
    table = {
        '![a](b.png "t") [c](/d)': "![a](https://x.com/blog/post/b.png) [c](https://x.com/d)",
        "[e](../f) text (g) [h](i j)": "[e](https://x.com/blog/post/../f) text (g) [h](i j)",
        '[k](https://y "kept") [l](#m) ![n](data:x)': '[k](https://y "kept") [l](#m) ![n](data:x)',
        "[o](javascript:p)": "[o](javascript:p)",
        "": "",
    }
    got = values(spark, lambda x: G.absolute_markdown(x, base), table)
    assert [g.replace("blog/f", "blog/post/../f") for g in got] == list(table.values())
    assert values(spark, lambda x: G.absolute_markdown(x, base), [None]) == [None]


def test_payloads(spark):
    files = [("b/p", "zh-cn", "b", "https://x/p", None, "2024-05-06", "", None, "x", "T", "z", "2024-05-07", "model", ["AI", "Other"]), ("b/p", "en", "b", "https://x/p", "en", "2024-05-06", "i", "Me", "x", "T", "e", "2024-05-07", "original", None), ("b/q", "en", "b", "", "en", "never", None, None, "x", "T", "e", "2024-05-07", "original", [])]
    schema = "article_id string, language string, blog_id string, original_url string, original_language string, published_at string, image_url string, author string, source_domain string, title string, content_markdown string, version_at string, provenance string, categories array<string>"
    got = {r["id"]: r for r in runs.payload_articles(spark.createDataFrame(files, schema)).collect()}
    one = json.loads(got["b/p"]["value"])
    assert (one["publishedAt"], one["categories"], one["author"], [v["language"] for v in one["versions"]]) == ("2024-05-06T00:00:00.000Z", ["AI", "Other"], "Me", ["en", "zh-cn"])
    assert got["b/q"]["value"] is None and got["b/q"]["error"] == "missing: originalUrl, publishedAt"


MODEL_ROWS = "id string, url string, title string, content_markdown string, official boolean"


def test_translate(spark):
    md = "# A `x`\n\nText $a+b$ [l](https://x.com/q)\n\n```\ncode\n```"
    rows = spark.createDataFrame([("1", "u1", "T", md, False), ("2", "u2", "T", "汉字汉字", False), ("3", "u3", "T", md, True), ("4", "u4", "T", None, None), ("5", "u5", "T", "bad {{BW:url:1}}", False)], MODEL_ROWS)
    got = {r["id"]: r for r in translate.translate_chunked(rows).collect()}
    assert (got["1"]["content_markdown"], got["1"]["status"], got["1"]["categories"], got["1"]["error"]) == (md, "model", ["Research"], None)
    assert (got["2"]["status"], got["2"]["model"], got["3"]["status"]) == ("native-zh", "native-zh", "official-zh")
    assert "empty" in got["4"]["error"] and "reserved" in got["5"]["error"] and got["5"]["content_markdown"] is None
    whole = {r["id"]: r for r in translate.translate_whole(rows).collect()}
    assert whole["1"]["content_markdown"] == md and whole["4"]["error"] and whole["5"]["error"]
    routed = {r["id"]: r["status"] for r in translate.translate_routed(rows, force_chunked=True).collect()}
    assert routed["2"] == "native-zh" and {r["id"]: r["status"] for r in translate.translate_routed(rows).collect()}["2"] == "model"


def test_translate_chunked_keeps_articles_whole(spark, sf):
    def loud(system, user):
        sent = json.loads(user)
        return json.dumps({"content_markdown": sent["content_markdown"].replace("text", "TEXT"), "categories": ["AI"]})

    rows = spark.createDataFrame([(k, "u", "T", t, False) for k, t in (("1", "text `text`"), ("1", "# A\n\ntext\n\n# B\n\nmore text"), (None, "text $x$"))], MODEL_ROWS)
    got = translate.translate_chunked(rows.withColumn("before", F.col("content_markdown")), loud, keep=("before",)).collect()
    assert sorted((r["before"], r["content_markdown"], r["status"]) for r in got) == [("# A\n\ntext\n\n# B\n\nmore text", "# A\n\nTEXT\n\n# B\n\nmore TEXT", "model"), ("text $x$", "TEXT $x$", "model"), ("text `text`", "TEXT `text`", "model")]


def test_translate_chunked_needs_no_shuffle(spark, sf):
    """Whole texts and their chunks are neither dealt out nor sent to the driver, nor gathered ten thousand to a batch."""
    plan = registry.QUERIES["translate_chunked"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and not any(x in plan for x in ("Exchange", "Join", "ArrowEvalPython"))


def test_a_failed_article_is_not_asked_on(spark, tmp_path):
    asked = tmp_path / "asked"

    def model(system, user):
        with asked.open("a") as out:
            out.write("x\n")
        raise ValueError("no")

    rows = spark.createDataFrame([("1", "u", "T", "# A\n\ntext\n\n# B\n\ntext", False)], MODEL_ROWS)
    assert [r["error"] for r in translate.translate_chunked(rows, model).where("error is not null").collect()] == ["no"]
    assert asked.read_text() == "x\n"


def test_inline_marks_are_all_tried():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices(["`", "``", "$", "$$", "](", "[", "]", ")", "<", ">", "</a", "https://", "\\", "\n", " ", "a", "1"], k=rng.randint(0, 24)))
        assert [(m.span(), m.lastgroup, m.groups()) for m in M._inline(text)] == [(m.span(), m.lastgroup, m.groups()) for m in M._INLINE.finditer(text)]


def test_models_that_fail(spark):
    rows = spark.createDataFrame([("1", "u", "T", "Text `c` $x$", False)], MODEL_ROWS)

    def lost(system, user):
        return json.dumps({"content_markdown": "no token", "categories": ["AI"]})

    def empty(system, user):
        return json.dumps({"content_markdown": " ", "categories": ["AI"]})

    def babble(system, user):
        return "sorry"

    for model, why in ((lost, "occurs 0 times"), (empty, "empty content_markdown"), (babble, "not JSON")):
        for f in (translate.translate_chunked, translate.translate_whole):
            row = f(rows, model).first()
            assert why in row["error"] and row["content_markdown"] is None


def test_asking_again():
    replies = iter(["no", 'Sure: {"content_markdown": "x"} bye'])
    assert translate.ask_json(lambda s, u: next(replies), "s", "u") == {"content_markdown": "x"}
    waits, turns = [], iter([translate.LimitReached("wait", 3.0), translate.LimitReached("wait"), "done"])

    def model(system, user):
        turn = next(turns)
        if isinstance(turn, Exception):
            raise turn
        return turn

    assert translate.patient(model, sleep=waits.append)("s", "u") == "done" and waits == [3.0, translate.MODEL_SECONDS]
    with pytest.raises(translate.LimitReached):
        translate.patient(lambda s, u: (_ for _ in ()).throw(translate.LimitReached("no")), times=1, sleep=waits.append)("s", "u")


def test_fetch(spark):
    def transport(url):
        return (int(url), "b")

    def no_wait(seconds):
        return None

    rows = spark.createDataFrame([("200",), ("403",), ("500",), ("404",), ("junk",)], "u string")
    got = [tuple(r["g"]) for r in rows.select("u", translate.fetch(transport, sleep=no_wait)(F.col("u")).alias("g")).collect()]
    assert got[0] == ("b", 1, None) and [g[2] for g in got[1:4]] == ["HTTP 403", "HTTP 500", "HTTP 404"] and "invalid literal" in got[4][2]

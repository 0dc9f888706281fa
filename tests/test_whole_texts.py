import hashlib

from marlstone.plans.registry import QUERIES

FAR = "![far](https://x.com/far.png) $far+1$ Lorem ipsum end."


def test_whole_texts(spark, tmp_path):
    body = "\n\n".join(f"Paragraph {k} " + "some words of it " * 30 for k in range(40))
    rows = [(400, f"{body}\n\n{FAR}\n\n"), (405, f"{body}\n\n{'汉字' * 9000}\n\n{FAR}\n\n"), (411, "short"), (412, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def run(name):
        return QUERIES[name](spark, str(tmp_path)).collect()

    by = lambda name, column: {r["doc_id"]: r[column] for r in run(name)}
    plain = by("plain_text", "plain")
    assert all("Paragraph 39" in plain[k] and "Lorem ipsum end." in plain[k] for k in (400, 405)) and len(plain) == 4
    assert all(len(x) == 4 and x[400] for x in (by("excerpt", "excerpt"), by("render_html", "html")))
    urls = by("image_urls", "urls")
    assert urls[400] == ["https://x.com/far.png", "img400.png"] and urls[411] == ["img411.png"]
    stats = by("content_stats", "images")
    assert stats[400] == 2 and stats[411] == 1
    codes = {(r["doc_id"], r["code"]) for r in run("integrity_gate")}
    assert {(400, "lorem-ipsum"), (405, "lorem-ipsum")} <= codes and not {r["doc_id"] for r in run("gate_passed")} & {400, 405}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    math = by("math_inventory", "formulas")
    assert math[400] == [digest(x) for x in ("far+1", "x", "y")] and math[411] == [digest(x) for x in "xy"]
    chunks = [r for r in run("chunk_markdown") if r["doc_id"] == 400]
    assert len(chunks) > 1
    assert len(by("protect_restore", "same")) == 4 and by("protect_restore", "same")[400]
    ratio = by("cjk_ratio_mode", "ratio")
    latin = sum(c.isascii() and c.isalpha() for c in rows[1][1]) + 1
    han = 18000 + 2 * (405 % 13)
    assert abs(ratio[405] - han / (han + latin)) < 1e-8
    plans = {r["doc_id"]: r for r in run("translation_plan")}
    assert (plans[400]["mode"], plans[411]["mode"], plans[400]["title_id"]) == ("official-zh", "translate", "chunk-" + hashlib.sha1(b"<title>#0").hexdigest()[:8])
    assert plans[405]["mode"] == "native-zh" and plans[411]["n_chunks"] == 1


def test_payload_validate(spark, tmp_path):
    spark.range(1, 106).selectExpr("id as doc_id", "'t' as text").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["path"]) for r in QUERIES["payload_validate"](spark, str(tmp_path)).collect())
    want = []
    for k in range(1, 106):
        want += [(k, "articles[0].versions")] * (k % 3 == 1) + [(k, "articles[0].original_url")] * (k % 5 == 0)
        want += [(k, "articles[1].original_url")] * (k % 35 == 0) + [(k, "articles[1]")] * (k % 7 == 0)
    assert got == sorted(want)

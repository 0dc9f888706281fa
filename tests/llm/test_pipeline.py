"""The stages in their order, on tables whose every case is known."""

import random

import corpus_pipeline
from tests.llm.test_operators import words


def test_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "substring dedup", "packing"]


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    passage = words(rng, 60)
    rows, marks = [], []
    for k in range(600):
        bad = k % 5 == 0
        rows.append((k, words(rng, 60) + (" zork blem " if bad else " fine ") + words(rng, 20), "en", "src", 1))
        marks.append((k, 1, int(bad)))
    copy, near = rows[1][1], rows[2][1].split()
    near[10] = "changed"
    rows += [(1000, copy, "en", "src", 1), (1001, " ".join(near), "en", "src", 1), (1002, f"{words(rng, 50)} {passage}", "en", "src", 1), (1003, f"{words(rng, 50)} {passage}", "en", "src", 1), (1004, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {k for k in range(600) if k % 5}
    assert set(kept["toxicity"]) == clean | set(range(1000, 1005))
    assert set(kept["exact dedup"]) == clean - {1} | set(range(1000, 1005))
    assert set(kept["near dedup"]) == clean - {1} | {1000, 1002, 1003, 1004}
    last = kept["substring dedup"]
    assert set(last) == set(kept["near dedup"]) and passage in last[1002] and passage not in last[1003]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(last)
    assert sum(r["n_tokens"] for r in packed) == sum(len((t or "").split()) for t in last.values())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""The pipeline's stages on a small table, each held against what it should keep."""

import corpus_pipeline
from runweave.llm import quality


def test_stages_follow_each_other(spark, tmp_path):
    def words(n, seed):
        return " ".join(f"w{(seed * 7919 + i * i) % 5003}" for i in range(n))

    passage = words(60, 77)
    texts = [words(80, 1), words(80, 1), words(40, 2) + " " + passage, passage + " " + words(50, 3), None, words(400, 4)]
    texts += [" ".join(w.upper() + "!!" for w in words(60, 100 + i).split()) if i % 2 else words(60, 100 + i) for i in range(120)]
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_removed int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, (i + 1) % 2, 0) for i in range(6, 126)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    good = {r["doc_id"] for r in quality.score(docs, quality.learned(spark, docs, str(tmp_path)), keep=("doc_id",)).filter("predicted = 1").collect()}
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append({r["doc_id"]: r for r in docs.collect()})
    assert set(seen[0]) == good and {0, 1, 2, 3} <= good
    assert set(seen[1]) == good - {1}
    assert set(seen[2]) == set(seen[1]) and seen[2][2]["text"] == texts[2] and seen[2][3]["text"] == words(50, 3)
    assert seen[2][3]["n_chars"] == len(words(50, 3)) and seen[2][3]["n_removed"] == 3
    assert set(seen[3]) <= set(seen[2]) and set(seen[4]) == set(seen[3])
    assert set(corpus_pipeline.COLUMNS) <= set(docs.columns) and all(r["n_tokens"] > 0 for r in seen[4].values() if r["text"])

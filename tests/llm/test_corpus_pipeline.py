"""The pipeline against its stages done one by one, and its keeping of clean documents."""

import random

import pytest

pytest.importorskip("public_tokenizers")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P
    from test_llm_operators import _corpus, _jaccard, _text

    r = random.Random(1)
    bench = [(i, _text(r, 40)) for i in range(3)]
    rows = [(i, t, lang, source, len(t or "")) for i, t, lang, source in _corpus()]
    rows += [(500 + i, _text(r, 50) + (" vilest" if i % 4 == 0 else ""), "en", "c", 1) for i in range(160)]
    rows += [(800, _text(r, 20) + " " + bench[1][1], "en", "c", 1), (801, _text(r, 20) + " password=abcdef123 " + _text(r, 5), "en", "c", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(500 + i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {x[0]: x[1] or "" for x in rows if not (500 <= x[0] < 660 and x[0] % 4 == 0)}
    firsts = {i for i, (_, c) in _jaccard(texts).items() if i == c}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept = {x["doc_id"] for x in docs.select("doc_id").collect()}
        assert kept == {"toxicity": set(texts), "ngram_jaccard_join": firsts}.get(name, firsts - {800})
    redacted = docs.where("doc_id = 801").first()
    assert "abcdef123" not in redacted["text"] and redacted["n_chars"] == len(redacted["text"])
    made = P.run(spark, str(tmp_path))
    assert {x["doc_id"] for x in made.select("doc_id").collect()} == firsts - {800}
    assert made.groupBy("sequence_id").sum("length").toPandas()["sum(length)"].max() <= 4096

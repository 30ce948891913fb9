import json

from inkwell.sources import corpus
from inkwell.streaming.documents import document_stream, rhythm_stream


def test_corpus_walk(spark, tmp_path):
    for place, body in {"ai/m1/go_1.md": "あ。", "human/qiita/x_y_2.md": "い。\r\nう。", "human/other/z.md": "え。", "ai/m1/skip.txt": "no"}.items():
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_bytes(body.encode() + (b"\xff" if place.endswith("go_1.md") else b""))
    rows = {r["doc_id"]: r for r in corpus.corpus(spark, str(tmp_path)).collect()}
    assert set(rows) == {"ai/m1/go_1", "human/qiita/x_y_2"}
    assert rows["ai/m1/go_1"]["theme"] == "go" and rows["ai/m1/go_1"]["text"] == "あ。�"
    assert rows["human/qiita/x_y_2"]["text"] == "い。\nう。" and rows["human/qiita/x_y_2"]["theme"] == "x_y"


def test_prior_and_round_trips(spark, tmp_path):
    (tmp_path / "prior.json").write_text(json.dumps({"chi2_tests": [{"word": "a", "significant_bonferroni": True, "excess_score": 1.5}, {"word": "b", "significant_bonferroni": "False", "excess_score": -1}]}))
    assert [tuple(r) for r in corpus.read_prior(spark, str(tmp_path / "prior.json")).orderBy("word").collect()] == [("a", 1.5, True), ("b", -1.0, False)]
    words = spark.createDataFrame([("p", "s", 3, ["a", "b"])], corpus.DOC_WORDS)
    corpus.write_doc_words(words, str(tmp_path / "words"))
    assert corpus.read_doc_words(spark, str(tmp_path / "words")).collect() == words.collect()
    rows = spark.createDataFrame([("a", 1.0), ("b", None)], "word string, x double")
    corpus.write_csv(rows, str(tmp_path / "csv"), ["word", "x"])
    assert sorted(corpus.read_csv(spark, str(tmp_path / "csv"), "word string, x double").collect()) == sorted(rows.collect())


def test_stream_equals_batch(spark, tmp_path):
    from inkwell.operators.rhythm import metrics

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20)
    docs.write.parquet(str(tmp_path / "in"))
    stream = rhythm_stream(document_stream(spark, str(tmp_path / "in"))).select("doc_id", "n_sentences", "mattr20")
    run = stream.writeStream.format("memory").queryName("rhythm").start()
    run.processAllAvailable()
    run.stop()
    batch = metrics(spark.read.parquet(str(tmp_path / "in"))).select("doc_id", "n_sentences", "mattr20")
    assert sorted(map(tuple, spark.table("rhythm").collect())) == sorted(map(tuple, batch.collect()))

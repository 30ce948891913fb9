"""The report, number formats, provenance, path ids and vocabulary indices."""

import pytest
from pyspark.errors import PythonException, SparkRuntimeException
from pyspark.sql import functions as F

from inkwell.plans import report
from inkwell.sources import corpus


def test_numbers(spark):
    values = [(1.23456,), (None,), (float("nan"),), (float("inf"),), (-0.5,)]
    got = [r["n"] for r in spark.createDataFrame(values, "v double").select(report.number(F.col("v"), 2).alias("n")).collect()]
    assert got == ["1.23", "—", "—", "—", "-0.50"]
    assert [report.written(v) for (v,) in values[:2]] == ["1.235", "—"] and report.written(0.25, 1, True) == "+0.2"


def test_report(spark):
    effects = spark.createDataFrame([("a", 1.0, 0.1, 2.0, 0.2, -0.4, -0.5, -0.3, 0.01), ("b", 3.0, 0.3, 4.0, None, None, None, None, None), ("c", 5.0, 0.5, 6.0, 0.6, 0.9, 0.8, 1.0, 1e-9)], "metric string, mean1 double, sd1 double, mean0 double, sd0 double, cohens_d double, d_ci_lo double, d_ci_hi double, p_holm double")
    models = spark.createDataFrame([("a", "m1", 1.0, 0.5, 0.26), ("c", "m2", 2.0, None, None)], "metric string, model string, mean double, sd double, cohens_d_vs_human double")
    spread = spark.createDataFrame([("a", 0.1, 0.2, 0.5, 1.0, 2.0), ("c", 0.1, 0.0, None, 1.0, 2.0)], "metric string, between_sd double, within_sd double, ratio double, min_mean double, max_mean double")
    assert [r["metric"] for r in report.strongest(effects).collect()] == ["c", "a", "b"] and report.strongest(effects, 1).count() == 1
    lines = report.report(effects, models, spread, ["m1", "m2"]).splitlines()
    assert "| c | 6.000 ± 0.600 | 5.000 ± 0.500 | **+0.90** [+0.80, +1.00] | 1.00e-09 |" in lines
    assert "| b | 4.000 ± — | 3.000 ± 0.300 | **—** [—, —] | — |" in lines
    assert "| a | 1.000 ± 0.50 (d = +0.3) | — |" in lines and "| c | — | 2.000 ± — (d = —) |" in lines
    assert lines.index("| a | 0.100 | 0.200 | 0.50 | 1.000 to 2.000 |") < lines.index("| c | 0.100 | 0.000 | — | 1.000 to 2.000 |")


def test_path_ids(spark):
    paths = ["data/ai_samples/m1/a.b.md", "data/human_corpus/qiita/x/y.md"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in rows.select(corpus.doc_id_of_path(F.col("p"))).collect()] == ["ai/m1/a.b", "human/qiita/x/y"]
    with pytest.raises((SparkRuntimeException, PythonException), match="outside"):
        spark.createDataFrame([("data/other/z.md",)], "p string").select(corpus.doc_id_of_path(F.col("p"))).collect()


def test_vocabulary_and_incidence(spark, tmp_path):
    words = spark.createDataFrame([(w,) for w in ["b", "a", "ab", "abc", "é", "猫", "Z"]], "word string")
    corpus.write_vocabulary(words, str(tmp_path / "v"))
    got = {r["word"]: r["index"] for r in corpus.read_vocabulary(spark, str(tmp_path / "v")).collect()}
    assert got == {w: i for i, w in enumerate(sorted(["b", "a", "ab", "abc", "é", "猫", "Z"]))}
    rows = spark.createDataFrame([("d1", "a"), ("d2", "b")], "doc_id string, word string")
    corpus.write_incidence(rows, str(tmp_path / "i"))
    assert sorted(corpus.read_incidence(spark, str(tmp_path / "i")).collect()) == sorted(rows.collect())


def test_counts_and_provenance(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x" * 120, "a"), (2, "short", "a"), (3, "y" * 100, "b"), (4, None, "b")], "doc_id long, text string, corpus string")
    words = spark.createDataFrame([(1, 7), (2, 1), (3, 5)], "doc_id long, n_tokens int")
    counts = corpus.corpus_counts(docs, words, "corpus")
    assert sorted(map(tuple, counts.collect())) == [("a", 1, 1, 7), ("b", 1, 1, 5)]
    corpus.write_json(counts, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 2
    row = corpus.provenance(spark, 7, 0.0, dictionary="none", n_boot=100).first()
    assert row["seed"] == 7 and row["dictionary"] == "none" and row["n_boot"] == 100 and row["spark"] == spark.version and row["generated_at"].year >= 2024

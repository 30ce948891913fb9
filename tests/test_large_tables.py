"""Steps that larger tables showed to be slow or to differ: each is made once, where its rows stand."""

import hashlib
import itertools
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import stats, text
from inkwell.operators import compare, lexical
from inkwell.plans import catalog
from inkwell.profiles import LATIN

DATA = "/root/testdata/sf0.001"


def test_ranges_of_rank_tests_are_made_once(spark, monkeypatch):
    """F7, F8: percentiles that come out otherwise each time they are made don't change ranks."""
    made = F.udf(lambda n: [random.SystemRandom().random() * 40], "array<double>").asNondeterministic()
    monkeypatch.setattr(compare.F, "percentile_approx", lambda *_: made(F.count("value")))
    values = [("m", float(i % 40), i % 3 == 0) for i in range(90)]
    rows = spark.createDataFrame(values, "metric string, value double, g boolean")
    one, two = ([v for _, v, g in values if g is side] for side in (True, False))
    told = sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(one, two))
    for _ in range(3):
        assert compare.mann_whitney(rows, "g", "metric").first()["u"] == told


def test_metrics_are_handed_over_as_in_sql(spark):
    values = [k / 640 + e for k in range(1, 1280, 2) for e in (0.0, 1e-16, -1e-16)]
    got = [r["x"] for r in spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).select(catalog._handed("x")).collect()]
    told = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert got == told


def test_texts_are_parsed_once(spark):
    plan = catalog.QUERIES["analysis_dataset"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?Umd)") == 1


def test_a_line_of_many_sentences(spark):
    """the work for a line is not done again for each of its sentences."""
    line = "- " + "Some words of one sentence. " * 30000
    docs = spark.createDataFrame([(line,)], "text string")
    start = time.time()
    row = docs.select(F.flatten(text.paragraphs(F.col("text"), LATIN)).alias("s")).select(F.size("s").alias("n"), F.col("s")[29999]["is_list"].alias("l")).first()
    assert (row["n"], row["l"]) == (30000, True) and time.time() - start < 10


def test_hashes_side_by_side():
    names = ["1", "22", "", "ä" * 9, "y" * 60, *map(str, range(990, 1010))]
    told = [[int.from_bytes(hashlib.md5(f"7:{r}:{n}".encode()).digest()[:4]) for n in names] for r in range(120)]
    assert (stats.hash_indices(7, 120, names) == np.array(told)).all()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_shuffled_ratios_follow_shuffled_labels(spark, kind):
    """models dealt where documents stand are those of shuffled_labels."""
    rng = np.random.default_rng(6)
    rows = [(i if kind == "long" else f"d{i}", "abc"[min(i // 40, 2)], float(rng.normal()), None if i % 5 == 0 else 3.0) for i in range(130)]
    frame = spark.createDataFrame(rows, f"doc_id {kind}, model string, x double, y double").repartition(3)
    dealt = compare.long_metrics(compare.shuffled_labels(frame, 12, 9), ("x", "y"), "rep", "model")
    told = {(r["metric"], r["rep"]): r["ratio"] for r in compare.ratio(dealt, "metric", "rep").collect()}
    got = {(r["metric"], r["rep"]): r["ratio"] for r in compare.shuffled_ratios(frame, ("x", "y"), 12, 9).collect()}
    assert got.keys() == told.keys() and all(got[k] == pytest.approx(told[k]) for k in told) and got["y", 0] is None


def test_words_of_a_document_are_made_once(spark):
    docs = spark.createDataFrame([(1, "One two. Two")], "doc_id long, text string")
    plan = lexical.incidence(lexical.doc_words(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1

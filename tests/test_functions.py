import math
import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions import stats, text
from inkwell.operators import classify, compare, rhythm
from inkwell.profiles import JAPANESE


def parsed(spark, raw):
    row = spark.createDataFrame([(raw,)], "t string").select(text.paragraphs(F.col("t"), JAPANESE).alias("p")).first()
    return [[(s["text"], s["is_list"]) for s in p] for p in row["p"]]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("今日は晴れ。明日は雨！本当？", [[("今日は晴れ", False), ("明日は雨", False), ("本当", False)]]),
        ("Hello world。これは文。", [[("これは文", False)]]),
        ("あ。\n```\nコード。\n```\nい。", [[("あ", False), ("い", False)]]),
        ("あ。\n```\nい。", [[("あ", False)]]),
        ("あ。\n# 見出し\nい。", [[("あ", False)], [("い", False)]]),
        ("あ。\n| 表 |\nい。\n\nう。", [[("あ", False)], [("い", False)], [("う", False)]]),
        ("- - -\nあ。", [[("あ", False)]]),
        ("- 項目", [[("項目", True)]]),
        ("1. 項目", [[("項目", True)]]),
        ("> - 項目", [[("- 項目", False)]]),
        ("[文](u)と![図](v)と`コード`", [[("文ととコード", False)]]),
        ("", []),
    ],
)
def test_paragraphs(spark, raw, expected):
    assert parsed(spark, raw) == expected


def test_metrics_of_japanese(spark):
    docs = spark.createDataFrame([(1, "あいう。" * 5), (2, "あ　い う。" * 4), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in rhythm.metrics(docs, JAPANESE).collect()}
    assert rows[1]["included"] == 1 and rows[1]["burstiness_char"] == -1.0 and rows[1]["para_sent_cv"] is None
    assert rows[2]["included"] == 0 and rows[2]["sent_len_char_mean"] is None
    assert rows[3]["n_sentences"] == 0


def test_phrase_across_sentences(spark):
    docs = spark.createDataFrame([(1, "これでは。なく。あ。い。う。")], "doc_id long, text string")
    assert rhythm.metrics(docs, JAPANESE).first()["phrase_per_sentence"] == pytest.approx(1 / 5)


def test_mattr(spark):
    rows = spark.createDataFrame([(["a", "b", "c", "a", "b", "c"],), (list("ab") * 15,), ([],)], "e array<string>")
    got = [r["m"] for r in rows.select(rhythm.mattr(F.col("e")).alias("m")).collect()]
    assert got == [0.5, pytest.approx(0.1), None]


def test_morae_and_content_words(spark):
    schema = "t array<struct<surface:string,pos1:string,pos2:string,lemma:string,pron:string>>"
    tokens = [("今日", "名詞", "普通名詞", "今日", "キョー"), ("は", "助詞", "", "は", "ワ"), ("する", "動詞", "非自立可能", "為る", "スル"), ("走る", "動詞", "一般", "*", None), ("。", "補助記号", "", "。", "")]
    row = spark.createDataFrame([(tokens,)], schema).select(text.morae(F.col("t")).alias("m"), text.content_words(F.col("t")).alias("w"), F.size(text.content_morphemes(F.col("t"))).alias("n")).first()
    assert (row["m"], row["w"], row["n"]) == (5, ["今日", "走る"], 4)


def test_lexical_cleaner(spark):
    raw = "# 題\n`x` と [a](b) ![c](d) http://e.f/g *強*　終"
    got = spark.createDataFrame([(raw,)], "t string").select(text.clean_lexical(F.col("t")).alias("c")).first()["c"]
    assert got == "題 と 強 終"


def test_erfc(spark):
    z = [i / 10 for i in range(0, 60)]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(stats.erfc(F.col("z")).alias("e")).collect()
    assert all(math.isclose(r["e"], math.erfc(x), rel_tol=2e-7) for x, r in zip(z, got, strict=True))


@pytest.mark.parametrize(("a", "c", "chi2", "p"), [(220, 149, 175.0987, 5.697e-40), (21, 1, 36.2191, 1.763e-9), (2, 2, 0.0314, 0.8594), (1, 3, 0.0, 1.0)])
def test_word_goldens(spark, a, c, chi2, p):
    x = stats.yates(F.lit(a), F.lit(c), 350, 700)
    row = spark.range(1).select(x.alias("x"), stats.chi_square_p(x).alias("p")).first()
    assert row["x"] == pytest.approx(chi2, abs=5e-4) and row["p"] == pytest.approx(p, rel=2e-3)


def test_bh_and_holm_against_loops(spark):
    rng = random.Random(4)
    p = [round(rng.random() ** 3, 2) for _ in range(40)]
    order = sorted(range(40), key=lambda i: p[i])
    q, best = [0.0] * 40, 1.0
    for rank in range(40, 0, -1):
        best = min(best, p[order[rank - 1]] * 40 / rank)
        q[order[rank - 1]] = best
    h, worst = [0.0] * 40, 0.0
    for rank, i in enumerate(order):
        worst = max(worst, min(1.0, (40 - rank) * p[i]))
        h[i] = worst
    rows = spark.createDataFrame([(f"{i:02}", x) for i, x in enumerate(p)], "metric string, p_value double")
    tests = stats.benjamini_hochberg(rows.groupBy("p_value").agg(F.count("*").alias("number")))
    got = {r["p_value"]: r["q_fdr"] for r in tests.collect()}
    assert all(math.isclose(got[x], y, rel_tol=1e-12) for x, y in zip(p, q, strict=True))
    holm = {r["metric"]: r["h"] for r in rows.select("metric", stats.holm("p_value").alias("h")).collect()}
    assert all(math.isclose(holm[f"{i:02}"], h[i], rel_tol=1e-12) for i in range(40) if p.count(p[i]) == 1)


def test_mann_whitney_with_ties(spark):
    x, y = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 4.0]
    u = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
    rows = spark.createDataFrame([("m", v, True) for v in x] + [("m", v, False) for v in y], "metric string, value double, g boolean")
    row = compare.mann_whitney(rows, "g", "metric").first()
    assert (row["n1"], row["n0"], row["u"]) == (4, 3, u) and row["rank_biserial"] == pytest.approx(2 * u / 12 - 1)


def test_logistic_agrees_in_both_dimensions():
    np = classify.np
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    y = (x[:, 0] + rng.normal(size=60) > 0).astype(int)
    w = classify.logistic(x, y)
    mu = 1 / (1 + np.exp(-(x @ w[1:] + w[0])))
    assert abs((mu - y).sum()) < 1e-5 and np.abs(x.T @ (mu - y) + w[1:]).max() < 1e-5
    wide = np.column_stack([x, np.zeros((60, 80))])
    assert np.abs(classify.logistic(wide, y)[:6] - w).max() < 1e-6
    score = rng.normal(size=60)
    assert classify.auc(-score, y) == pytest.approx(1 - classify.auc(score, y))


def test_no_leak_from_the_test_fold(spark):
    docs = [(i, i % 2 == 0, ["even" if i % 2 == 0 else "odd", f"w{i % 3}"]) for i in range(60)]
    assigned = classify.folds(spark.createDataFrame([(i, y) for i, y, _ in docs], "doc_id long, y boolean"), "y", 1, 5, 7)
    train = classify.training(assigned, 5)
    test = {r["doc_id"] for r in assigned.where("fold = 0").collect()}

    def chosen(change):
        rows = [(i, w) for i, _, ws in docs for w in (["changed"] if change and i in test else ws)]
        words = spark.createDataFrame(rows, "doc_id long, word string")
        return {(r["word"], r["a"], r["c"]) for r in classify.select_words(train, words, "y").where("fold = 0").collect()}

    assert chosen(False) == chosen(True) != set()

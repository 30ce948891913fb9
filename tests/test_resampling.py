"""Resampling and cross-validation against plain computations that move the documents themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import stats
from inkwell.operators import classify, compare, lexical


def test_bootstrap_of_words_against_documents_drawn_anew(spark):
    n1, n0 = 60, 90
    rows = [("often", 40, 30), ("rare", 5, 0), ("even", 20, 30), ("also even", 20, 30)]
    got = {r["word"]: r for r in lexical.bootstrap_ci(spark.createDataFrame(rows, "word string, a long, c long"), n1, n0, 1000, 7).collect()}
    rng = np.random.default_rng(1)
    for word, a, c in rows:
        one, two = np.arange(n1) < a, np.arange(n0) < c
        p = (np.array([one[rng.integers(0, n1, n1)].sum() for _ in range(6000)]) + 1) / (n1 + 1)
        q = (np.array([two[rng.integers(0, n0, n0)].sum() for _ in range(6000)]) + 1) / (n0 + 1)
        r = got[word]
        assert [r["delta_ci_low"], r["delta_ci_high"]] == pytest.approx(np.percentile(p - q, [2.5, 97.5]), abs=0.025)
        assert [r["r_ci_low"], r["r_ci_high"]] == pytest.approx(np.percentile(p / q, [2.5, 97.5]), rel=0.12)
    assert got["even"]["r_ci_low"] == got["also even"]["r_ci_low"]
    empty = lexical.bootstrap_ci(spark.createDataFrame([("x", 0, 3)], "word string, a long, c long"), 0, 9, 10, 7).first()
    assert empty["r_ci_low"] is None


def test_weights_of_both_engines(spark):
    names = ["1", "22", "x"]
    told = stats.poisson_weights(5, 40, names)
    rows = spark.createDataFrame([(i, k, n) for i in range(40) for k, n in enumerate(names)], "rep int, k int, name string")
    got = rows.select("rep", "k", stats.poisson_weight(F.lit("5"), F.col("rep").cast("string"), F.col("name")).alias("w")).collect()
    assert all(told[r["rep"], r["k"]] == r["w"] for r in got)


def test_effect_interval(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3 == 0, float(rng.normal() + (i % 3 == 0)), None if i % 7 == 0 else float(rng.normal())) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, g boolean, x double, y double").repartition(3)
    got = {r["metric"]: r for r in compare.effect_ci(frame, ("x", "y"), "g", 500, 11).collect()}
    weight = stats.poisson_weights(11, 500, [str(i) for i in range(150)])
    for metric, k in (("x", 2), ("y", 3)):
        ds = []
        for w in weight:
            sides = [np.repeat([r[k] for r in rows if r[1] == side and r[k] is not None], [int(w[r[0]]) for r in rows if r[1] == side and r[k] is not None]) for side in (True, False)]
            (a, b) = sides
            pooled = np.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2))
            ds.append((a.mean() - b.mean()) / pooled)
        assert [got[metric]["d_ci_lo"], got[metric]["d_ci_hi"]] == pytest.approx(np.percentile(ds, [2.5, 97.5]), rel=1e-9)


def test_shuffled_labels_keep_sizes_and_follow_the_hash(spark):
    rows = [(i, "abc"[min(i // 40, 2)]) for i in range(130)]
    got = compare.shuffled_labels(spark.createDataFrame(rows, "doc_id long, model string"), 6, 9).collect()
    assert len(got) == 6 * 130
    import hashlib

    for rep in range(6):
        order = sorted(range(130), key=lambda i: (hashlib.md5(f"9:{rep}:{i}".encode()).digest()[:4], i))  # noqa: B023
        told = dict(zip(order, ["a"] * 40 + ["b"] * 40 + ["c"] * 50, strict=True))
        assert {r["doc_id"]: r["model"] for r in got if r["rep"] == rep} == told


def ratio_of(matrix, labels):
    means = np.stack([matrix[labels == m].mean(axis=0) for m in np.unique(labels)])
    within = np.stack([matrix[labels == m].std(axis=0, ddof=1) for m in np.unique(labels)]).mean(axis=0)
    with np.errstate(all="ignore"):
        return np.where(within > 0, means.std(axis=0, ddof=1) / within, np.nan)


def test_word_ratios_and_permutation_against_shuffled_documents(spark):
    rng = np.random.default_rng(2)
    labels = np.repeat(["a", "b", "c"], [30, 25, 20])
    chance = np.array([[0.9, 0.2, 0.2], [0.4, 0.4, 0.4], [0.1, 0.0, 0.05]])
    matrix = np.stack([rng.random(75) < chance[k][np.unique(labels, return_inverse=True)[1]] for k in range(3)], axis=1).astype(float)
    rows = spark.createDataFrame([(str(k), labels[i]) for i in range(75) for k in range(3) if matrix[i, k]], "word string, model string")
    sizes = {"a": 30, "b": 25, "c": 20}
    ratios = compare.word_ratio(rows, sizes)
    observed = ratio_of(matrix, labels)
    got = {int(r["word"]): r for r in compare.word_permutation(ratios, sizes, 1000, 5).collect()}
    null = []
    for _ in range(3000):
        null.append(ratio_of(matrix, rng.permutation(labels)))
    null = np.array(null)
    for k in range(3):
        assert got[k]["ratio"] == pytest.approx(observed[k])
        assert got[k]["perm_p"] == pytest.approx((1 + (null[:, k] >= observed[k] - 1e-9).sum()) / 3001, abs=0.05)
        assert got[k]["perm_z"] == pytest.approx((observed[k] - null[:, k].mean()) / null[:, k].std(ddof=1), abs=0.25 + 0.1 * abs(got[k]["perm_z"]))


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(8)
    rows = []
    for i in range(120):
        y = i % 2 == 0
        words = sorted({f"w{k}" for k in range(30) if rng.random() < (0.25 + 0.3 * (y and k < 4))})
        rows.append((i, bool(y), words, float(rng.normal(3)), float(rng.normal(5)), None if i % 11 == 0 else float(rng.normal() + 0.8 * y), float(rng.normal())))
    return rows


def test_sweep_against_numpy(spark, labelled):
    """Folds are the operator's; selection, scaling, residuals, regression and AUC are done again by other means."""
    frame = spark.createDataFrame(labelled, "doc_id long, y boolean, words array<string>, x1 double, x2 double, m1 double, m2 double")
    got = {(r["condition"], r["repeat"], r["fold"], r["features"]): r for r in classify.sweep(frame, ("m1", "m2"), {"main": (F.lit(True), False), "adj": (F.lit(True), True), "few": (F.col("doc_id") < 60, False)}, 2, 3, 13).collect()}
    assert len(got) == 2 * 3 * (3 + 4 + 3)
    fold = {(r["repeat"], r["doc_id"]): r["fold"] for r in classify.folds(frame, "y", 2, 3, 13).collect()}
    y = np.array([r[1] for r in labelled], int)
    names = sorted({w for r in labelled for w in r[2]})
    x = np.array([[w in r[2] for w in names] for r in labelled], float)
    cov = np.array([r[3:5] for r in labelled])
    m = np.array([[np.nan if v is None else v for v in r[5:]] for r in labelled])
    from math import erfc, sqrt

    for rep in range(2):
        for f in range(3):
            test = np.array([fold[rep, i] == f for i in range(120)])
            tr = ~test
            n1, n0 = y[tr].sum(), (1 - y[tr]).sum()
            p = []
            for k in range(len(names)):
                a, c = x[tr][y[tr] == 1, k].sum(), x[tr][y[tr] == 0, k].sum()
                b, d, n = n1 - a, n0 - c, n1 + n0
                chi = n * max(abs(a * d - b * c) - n / 2, 0) ** 2 / ((a + c) * (b + d) * n1 * n0) if 5 <= a + c <= n - 5 else None
                p.append(None if chi is None else erfc(sqrt(chi / 2)))
            known = sorted((v, k) for k, v in enumerate(p) if v is not None)
            last = max((i for i, (v, _) in enumerate(known) if v <= 0.05 * (i + 1) / len(known)), default=-1)
            cut = known[last][0] if last >= 0 else known[min(100, len(known)) - 1][0]
            chosen = [k for v, k in known if v <= cut]
            assert got["main", rep, f, "lexical"]["n_words"] == len(chosen)
            filled = np.where(np.isnan(m), np.nanmedian(m[tr], axis=0), m)
            z = (filled - filled[tr].mean(0)) / filled[tr].std(0)
            one = np.column_stack([np.ones(120), cov])
            left = lambda v: v - one @ np.linalg.pinv(one[tr]) @ v[tr]  # noqa: B023, E731
            zc = (cov - cov[tr].mean(0)) / cov[tr].std(0)
            sets = {("main", "lexical"): x[:, chosen], ("main", "rhythm"): z, ("main", "combined"): np.hstack([x[:, chosen], z]), ("adj", "lexical"): left(x[:, chosen]), ("adj", "rhythm"): left(z), ("adj", "length_only"): zc}
            for (condition, features), v in sets.items():
                w = np.zeros(v.shape[1] + 1)
                for _ in range(4000):  # plain gradient descent to the optimum
                    mu = 1 / (1 + np.exp(-(v[tr] @ w[1:] + w[0])))
                    g = np.concatenate([[(mu - y[tr]).sum()], v[tr].T @ (mu - y[tr]) + w[1:]])
                    w -= g / (0.25 * np.linalg.norm(np.column_stack([np.ones(tr.sum()), v[tr]]), 2) ** 2 + 1)
                s = v[test] @ w[1:] + w[0]
                pos, neg = s[y[test] == 1], s[y[test] == 0]
                told = np.mean([(i > j) + 0.5 * (i == j) for i in pos for j in neg])
                assert got[condition, rep, f, features]["auc"] == pytest.approx(told, abs=2e-3), (condition, features)


def test_auc_tables(spark):
    rows = [("c", r, f, s, 0.5 + 0.1 * k + 0.01 * f + 0.02 * r, 0) for r in range(2) for f in range(5) for k, s in enumerate(["lexical", "rhythm"])]
    each = spark.createDataFrame(rows, "condition string, repeat int, fold int, features string, auc double, n_words long")
    row = classify.auc_summary(each, 2000).where("features = 'lexical'").first()
    values = [v[4] for v in rows if v[3] == "lexical"]
    assert row["auc_mean"] == pytest.approx(np.mean(values)) and row["auc_sd"] == pytest.approx(np.std(values, ddof=1)) and row["n_folds"] == 10
    assert row["repeat_sd"] == pytest.approx(0.02 / np.sqrt(2)) and row["ci_lo"] < np.mean(values) < row["ci_hi"]
    (diff,) = classify.auc_differences(each, repetitions=500).collect()
    assert diff["comparison"] == "rhythm-lexical" and diff["diff_mean"] == pytest.approx(0.1) and diff["frac_folds_positive"] == 1 and diff["ci_lo"] == pytest.approx(0.1)


def test_models_are_told_apart(spark):
    """Accuracy, macro F1 and number of features of each fold against a plain softmax regression."""
    rng = np.random.default_rng(4)
    rows = [(i, "abc"[i % 3], sorted({f"w{k}" for k in range(24) if rng.random() < (0.7 if k % 3 == i % 3 else 0.3)}), float(rng.normal(i % 3))) for i in range(90)]
    frame = spark.createDataFrame(rows, "doc_id long, model string, words array<string>, m double")
    got = classify.identify(frame, ("m",), {"three": ["c", "a", "b"], "two": ["a", "b"]}, 1, 3, 21).collect()
    assert len(got) == 2 * 3 * 2
    fold = {r["doc_id"]: r["fold"] for r in classify.folds(frame.withColumn("y", F.ascii("model") - 97), "y", 1, 3, 21).collect()}
    y, names = np.array([i % 3 for i in range(90)]), sorted({w for r in rows for w in r[2]})
    x = np.array([[w in r[2] for w in names] for r in rows], float)
    for f in range(3):
        test = np.array([fold[i] == f for i in range(90)])
        often = x[~test].sum(0)
        v = x[:, (often >= 5) & (often <= (~test).sum() - 5)]
        w, b, goal = np.zeros((v.shape[1], 3)), np.zeros(3), np.eye(3)[y]
        for _ in range(6000):
            e = np.exp(v[~test] @ w + b)
            g = e / e.sum(1, keepdims=True) - goal[~test]
            w, b = w - 0.01 * (v[~test].T @ g + w), b - 0.01 * g.sum(0)
        guess = (v[test] @ w + b).argmax(1)
        (row,) = [r for r in got if r["dataset"] == "three" and r["fold"] == f and r["features"] == "lexical"]
        assert row["n_features"] == v.shape[1] and row["accuracy"] == pytest.approx((guess == y[test]).mean(), abs=0.05)
    summary = classify.accuracy_summary(spark.createDataFrame(got)).where("dataset = 'three' and features = 'lexical'").first()
    own = [r["accuracy"] for r in got if r["dataset"] == "three" and r["features"] == "lexical"]
    assert summary["acc_mean"] == pytest.approx(np.mean(own)) and summary["acc_sd"] == pytest.approx(np.std(own, ddof=1))

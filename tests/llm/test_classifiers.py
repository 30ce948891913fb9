"""The classifiers' training and scores against plain loops."""

import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import quality, records, toxicity, vectext


def texts_of(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["alpha", "beta", "Gamma!", "x1", "x1", "delta"]) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_ftrl_against_plain_loops():
    texts = texts_of(80, 3)
    y = np.array([int("Gamma!" in t) for t in texts])
    got = np.frombuffer(quality.train(vectext.chunks(pa.array(texts), 300), y), "<f4")
    (chunk,) = vectext.chunks(pa.array(texts))
    rows = [{} for _ in texts]
    for t, b, v in zip(*quality.features(chunk), strict=True):
        rows[t][int(b) + 1] = float(np.float32(v))
    for own in rows:
        assert not own or sum(v * v for v in own.values()) == pytest.approx(1, abs=1e-5)
        own[0] = 1.0
    z, n = {}, {}
    alpha, beta = quality.ALPHA, quality.BETA

    def weight(i):
        l1, l2 = (quality.L1, quality.L2) if i else (0.0, 0.0)
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(quality.EPOCHS):
        for own, label in zip(rows, y, strict=True):
            w = {i: weight(i) for i in own}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in own.items())))
            for i, x in own.items():
                g = (p - label) * x
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w[i]
                n[i] = before + g * g
    assert np.flatnonzero(got).tolist() == sorted(i for i in z if abs(weight(i)) > 1e-12)
    assert [got[i] for i in sorted(z)] == pytest.approx([weight(i) for i in sorted(z)], rel=1e-4, abs=1e-6)


def test_quality_scores_are_dot_products(spark):
    texts = [*texts_of(60, 5), ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("delta" in t)) for i, t in enumerate(texts)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.quality(docs, labels).collect()}
    rows = quality.sparse.sample(docs, labels, quality.F.col("quality"), quality.crc32_mod("doc_id", 5) != 0, quality.MOST_LABELLED)
    w = np.frombuffer(quality.sparse.fit(rows, quality.train), "<f4").astype(float)
    (chunk,) = vectext.chunks(pa.array(texts))
    line = [float(w[0])] * len(texts)
    for t, b, v in zip(*quality.features(chunk), strict=True):
        line[t] += w[b + 1] * v
    assert [got[i] for i in range(len(texts))] == pytest.approx([1 / (1 + math.exp(-x)) for x in line], abs=1e-9)


@pytest.fixture(scope="module")
def ordinal():
    rng = random.Random(9)
    texts, number = [], []
    for i in range(1500):
        bad = [] if i % 4 else rng.choices(["vile", "nasty", "rotten", "foul"], k=rng.randint(1, 9))
        words = [rng.choice([f"w{k}" for k in range(50)]) for _ in range(30)] + bad
        rng.shuffle(words)
        texts.append(" ".join(words))
        number.append(len(set(bad)))
    raw = toxicity.train(vectext.chunks(pa.array(texts)), np.array([int(k > 0) for k in number]))
    return texts, np.array(number), raw


def test_thresholds_are_ordered_and_weights_shared(ordinal):
    texts, number, raw = ordinal
    head, _, rest = raw.partition(b"\n")
    theta = json.loads(head)
    assert len(theta) == toxicity.GRADES and theta == sorted(theta) and len(set(theta)) == len(theta)
    names, weights = np.frombuffer(rest[: len(rest) // 2], "<i8"), np.frombuffer(rest[len(rest) // 2 :], "<f8")
    of = dict(zip(names.tolist(), weights.tolist(), strict=True))
    (chunk,) = vectext.chunks(pa.array(texts))
    rows = [[] for _ in texts]
    for t, b in zip(*toxicity.features(chunk), strict=True):
        rows[t].append(of.get(int(b), 0.0))
    severity = [sum(1 / (1 + math.exp(-(sum(own) - t))) for t in theta) for own in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    (got,) = toxicity._scorer(raw)(iter([batch]))
    assert got.column("severity").to_pylist() == pytest.approx(severity, abs=1e-9)
    assert got.column("p_toxic").to_pylist() == pytest.approx([1 / (1 + math.exp(-(sum(own) - theta[0]))) for own in rows], abs=1e-9)
    # the fit is a minimum of the ordinal likelihood in the direction of any common shift of the thresholds
    text, bucket = toxicity.features(chunk)
    goal = toxicity.grade(text, np.unique(bucket, return_inverse=True)[1], (number > 0).astype(int))

    def loss(shift):
        out = 0.0
        for own, g in zip(rows, goal, strict=True):
            over = [1.0, *(1 / (1 + math.exp(-(sum(own) - t - shift))) for t in theta), 0.0]
            out -= sum(math.log(over[k + 1] if k < g else 1 - over[k + 1]) for k in range(len(theta)))
        return out

    assert loss(0.0) < min(loss(0.3), loss(-0.3))


def test_severity_rises_with_the_toxic_words(ordinal):
    texts, number, raw = ordinal
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    (got,) = toxicity._scorer(raw)(iter([batch]))
    severity = got.column("severity").to_numpy()
    means = [severity[number == k].mean() for k in range(5)]
    assert means == sorted(means) and means[4] > means[1] + 0.5 and means[0] < 0.1
    grades = got.column("grade").to_numpy()
    assert np.corrcoef(grades[number > 0], number[number > 0])[0, 1] > 0.7


def test_a_labelled_id_on_many_rows_is_one_example(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "two"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    rows = quality.sparse.sample(docs, labels, quality.F.col("quality"), quality.F.lit(True), 10).collect()
    assert sorted((r["doc_id"], r["y"], r["text"]) for r in rows if r["doc_id"] < 3) == [(1, 1, "text 0"), (2, 0, "two")] and len(rows) == 3


def test_large_ids_take_four_bytes():
    ids = np.array([5, 70_000, 2], np.uint32)
    doc_id, found = records.parse(records.payload(7, ids, 4))
    assert doc_id == 7 and found.tolist() == ids.tolist()

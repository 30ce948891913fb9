"""The LM learns from every training document, and its scores are those of a plain computation."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from inkwell.llm import attention, lm_scoring

FILE, END = P.path("byte_bpe_50k.json"), 50256


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"word{w}" for w in rng.zipf(1.5, rng.integers(0, 90)) % 400) for _ in range(200)]
    library = Tokenizer.from_file(FILE)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return docs, [library.encode(t).ids for t in texts], [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(200)]


def test_all_training_documents_take_part(corpus, monkeypatch):
    docs, ids, held = corpus
    monkeypatch.setattr(lm_scoring, "SAMPLE_DOCS", 5)
    monkeypatch.setattr(lm_scoring, "HELD", 50)  # tasks give their pairs in several parts
    monkeypatch.setattr(lm_scoring, "GROUP", 300)
    monkeypatch.setattr(attention, "SHARE", 1.0)
    seen = {}
    for name in ("_pair_table", "_classes", "untrained", "_trained"):
        def spy(*a, f=getattr(lm_scoring, name), name=name):
            seen[name] = f(*a)
            seen[name, "in"] = a
            return seen[name]

        monkeypatch.setattr(lm_scoring, name, spy)
    assert all(r["score"] < 0 for r in lm_scoring.lm_scores(docs, FILE).collect())

    train = [[END, *x, END] for x, h in zip(ids, held, strict=True) if not h]
    told = Counter((a, b) for t in train for a, b in zip(t[:-1], t[1:], strict=True))
    got = Counter()
    for r in seen["_pair_table"].collect():
        pair = np.frombuffer(r["pairs"], np.uint64)
        got.update(dict(zip(zip((pair >> np.uint64(32)).tolist(), (pair & np.uint64(0xFFFFFFFF)).tolist(), strict=True), np.frombuffer(r["times"], np.int64).tolist(), strict=True)))
    assert got == told
    counts = Counter(i for t in train for i in t[1:])
    found = seen["_classes", "in"][1]
    assert {i: int(found[i]) for i in np.flatnonzero(found)} == counts

    kind = seen["_classes"]
    marks = {i: k for k, i in enumerate(attention.ranked(found, END)[:256].tolist())}
    cells = Counter()
    for (a, b), n in told.items():
        cells[b * 514 + marks.get(a, 256)] += n
        cells[a * 514 + 257 + marks.get(b, 256)] += n
    at = np.array(sorted(cells))
    assert (kind == attention.classes(found, at, np.array([cells[c] for c in at.tolist()]), END)).all()
    assert all(kind[i] < attention.CLASSES - 1 for i, n in counts.items() if n >= 5)

    model, windows = seen["_trained"]
    assert windows == sum(-(-(len(t) - 1) // attention.STEP) for t in train)
    assert np.abs(model.wo).max() > 0


def test_kept_pairs(spark):
    pairs = np.array([(1 << 32) + 2, (1 << 32) + 3, (5 << 32) + 1, (5 << 32) + 2], np.uint64)
    table = spark.createDataFrame([(0, pairs.tobytes(), np.array([4, 1, 4, 2]).tobytes())], "block int, pairs binary, times binary")
    old, lm_scoring.PAIRS = lm_scoring.PAIRS, 3
    try:
        a, b, n = lm_scoring._kept_pairs(table)
    finally:
        lm_scoring.PAIRS = old
    assert list(zip(a.tolist(), b.tolist(), n.tolist(), strict=True)) == [(1, 2, 4), (5, 1, 4), (5, 2, 2)]


def small_model(ids, size=300):
    """A model with random weights, made of the pairs of ``ids``."""
    rng = np.random.default_rng(8)
    (a, b), n = np.unique(np.stack([ids[:-1], ids[1:]]), axis=1, return_counts=True)
    kind = np.where(np.arange(size) < size - 1, np.arange(size) % attention.CLASSES, 0)
    follow = np.zeros((size, attention.CLASSES), np.int64)
    np.add.at(follow, (a, kind[b]), n)
    model = attention.untrained(np.bincount(ids, minlength=size), kind, follow, (a[::2], b[::2], n[::2]), size - 1)
    flat = attention.weights(model)
    return attention.with_weights(model, flat + rng.normal(0, 0.3, len(flat)))


def plain_distribution(m, text, place, size):
    """P(id | ids before ``place``) for all ids, with loops over one window; ``text`` begins with the end id."""
    step, width = attention.STEP, attention.WIDTH
    first = max(place // step * step - step, 0)
    window = text[first : place + 1]
    x = m.embed.astype(float)[[m.look[i] for i in window]]
    shift = step if place >= step else 0  # where the block stands among the keys
    scores = []
    for j in range(len(window)):
        key = j + step - shift
        scores.append(x[-1] @ m.wq @ (x[j] @ m.wk) / math.sqrt(width) + m.bias[place % step, key])
    share = np.exp(np.array(scores) - max(scores))
    mixed = (share / share.sum()) @ (x @ m.wv)
    hidden = np.tanh(x[-1] @ m.w1 + mixed @ m.w2 + m.b1)
    before = text[place]
    logits = hidden @ m.wo + m.b + m.logits[m.row[before]]
    of_class = np.exp(logits - logits.max())
    of_class /= of_class.sum()
    in_class = m.in_class(np.full(size, before), np.arange(size))
    return of_class[m.kind] * np.exp(in_class)


def test_score_against_a_plain_computation():
    size = 300
    rng = np.random.default_rng(5)
    ids = rng.integers(0, size - 1, 130).astype(np.int32)
    m = small_model(ids, size)
    bounds = np.array([0, 0, 7, 50, 130])
    got = m.score(ids, bounds, size - 1)
    for k in range(4):
        text = [size - 1, *ids[bounds[k] : bounds[k + 1]].tolist(), size - 1]
        total = 0.0
        for place in range(len(text) - 1):
            p = plain_distribution(m, text, place, size)
            assert p.sum() == pytest.approx(1, abs=1e-5)  # a distribution over all ids
            total += math.log10(p[text[place + 1]])
        assert got[k] == pytest.approx(total, rel=1e-4)


def test_held_out_scores_and_ablation(spark, corpus):
    """The model beats the word unigrams on held-out texts made of shared parts, and attention adds to its counts."""
    rng = np.random.default_rng(6)
    parts = ["ba", "lo", "mi", "ter", "ound", "ness", "qu", "ish"]
    styles = [rng.permutation(parts)[:4] for _ in range(4)]
    texts = [" ".join("".join(rng.choice(styles[i % 4], rng.integers(1, 5))) for _ in range(rng.integers(20, 80))) for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, load = [], lm_scoring._trained
    lm_scoring._trained = lambda *a: seen.append(load(*a)) or seen[-1]
    try:
        out = lm_scoring.lm_scores(docs, FILE).where("held_out").collect()
    finally:
        lm_scoring._trained = load
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    model = seen[0][0]
    library = Tokenizer.from_file(FILE)
    rows = [np.array(library.encode(texts[r["doc_id"]]).ids, np.int32) for r in out]
    ids, bounds = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    whole = model.score(ids, bounds, END)
    assert whole.sum() == pytest.approx(sum(r["score"] for r in out), rel=1e-4)
    model.wo = np.zeros_like(model.wo)
    assert whole.sum() > 0.97 * model.score(ids, bounds, END).sum()


def test_every_window_of_a_shard_trains():
    """A pass uses each window once, without a share set; runs give the gradients of their windows one by one."""
    rng = np.random.default_rng(9)
    ids, bounds, end = rng.integers(0, 299, 3000).astype(np.int32), np.array([0, 0, 5, 700, 716, 3000]), 299
    m = small_model(ids)
    inputs, goals, scored, _ = attention.layout(ids, bounds, end)
    look, kind = np.append(m.look, -1)[inputs], np.append(m.kind, -1)[goals]
    row, at = m.row[np.maximum(inputs, 0)], np.flatnonzero(scored)
    one = attention.gradients(m, look[at - 1], look[at], row[at], kind[at])
    run = attention.run_gradients(m, look[None], row[None, 1:], kind[None, 1:])
    for part, g in one.items():
        assert np.allclose(run[part], g, atol=1e-6), part

    told, step = [], attention._Adam.step
    attention._Adam.step = lambda self, found, rate: told.append(1) or step(self, found, rate)
    before = attention.weights(m)
    try:
        windows, used = attention.pass_over(m, iter([(ids, bounds), (ids, bounds)]), end)
    finally:
        attention._Adam.step = step
    assert windows == used == 2 * len(at) and told
    assert np.abs(attention.weights(m) - before).max() > 0

"""Each operator against a brute-force version, on small fixtures with nulls, ties, repeats, long and empty texts."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.fs as pafs
import plain
import pytest
import tiktoken
from pyspark.sql import functions as F

from inkwell.llm import byte_bpe, components, host_rules, lm_scoring, mixing, near_dedup, neighbours, personal_data, pretoken, quality, records, toxicity, vectext

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(60)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, rank int"


def sentence(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def base_texts():
    first = sentence(60)
    words = first.split()
    texts = [None, "", " \n\t ", "one", "one", "Two words", first, first, " ".join(words[:-2] + ["x", "y"]), " ".join(["a"] + words[3:]), first.upper()]
    texts += ["mail a.b@c.de now +1 (734) 555-0446 and 10.0.0.300 10.1.2.3", "card 4111 1111 1111 1111 call 555-123-4567", "é漢字 naïve 'tis don't  \r\n x　y", "z" * 3000, sentence(20_000)]
    texts += [sentence(RNG.randint(5, 80)) for _ in range(60)]
    return texts


TEXTS = base_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, None if i % 7 == 0 else f"s{i % 4}", None, True, 1) for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "en", "s3", 3, False, 2), (None, "null id text", "en", "s1", 9, True, 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_words_and_hashes():
    texts = ["Ab  c\td", "", "e", None, "\x1cf g"]
    seen = {}
    for chunk in vectext.chunks(pa.array(texts), limit=3):
        found = vectext.words(chunk, lower=True)
        for i in range(len(chunk)):
            words = [w.lower() for w in WORD.findall(texts[chunk.first + i] or "")]
            hashes = found.hash[found.bounds[i] : found.bounds[i + 1]].tolist()
            assert len(words) == len(hashes)
            for w, h in zip(words, hashes, strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_pieces_follow_the_pattern(encoding):
    rng = random.Random(3)
    letters = "ab s't're'll'dve 'sm \n\t  é漢12٣²½!?., 　\xa0 x'"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["'", "''s", " 's", "a's's", "\n's", "<|endoftext|>"]
    encoder = pretoken.library_encoder(P.path("byte_bpe_50k.json"))
    for chunk in vectext.chunks(pa.array(texts)):
        ids, bounds = encoder.chunk_ids(chunk)
        for i in range(len(chunk)):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == encoding.encode_ordinary(texts[chunk.first + i])


def slow_crc32c(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (records.POLYNOMIAL if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_crc32c_and_frames():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 256, n, dtype=np.uint8) for n in (4, 5, 9, 1023, 1024, 1025, 3000)]
    assert records.crc32c(parts).tolist() == [slow_crc32c(p.tobytes()) for p in parts]
    assert int(records.crc32c([np.frombuffer(b"123456789", np.uint8)])[0]) == 0xE3069283
    raw, lengths = records.frame(parts)
    offsets = np.cumsum(lengths) - lengths
    assert all((a == b).all() for a, b in zip(records.unframe(raw, offsets), parts, strict=True))
    with pytest.raises(ValueError, match="checksum"):
        records.unframe(raw[:-9] + bytes([raw[-9] ^ 1]) + raw[-8:], offsets)


def test_records(spark, docs, nothing, encoding, tmp_path):
    folder = f"file://{tmp_path}/r"
    shards = records.write_records(docs, P.path("byte_bpe_50k.json"), 2, folder)
    got = sorted(map(tuple, records.read_back(spark, folder, shards).collect()), key=lambda r: (r[1], r[0] or -1))
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for (doc_id, text), row in zip(rows, got, strict=True):
        ids = np.array([*encoding.encode_ordinary(text or ""), 2], "<u4")
        assert row == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    one = max(shards, key=lambda s: s["docs"])
    held = list(records.read_records(pafs.LocalFileSystem(), one["name"]))
    order = list(range(one["docs"]))[::-1]
    assert [d for d, _ in records.read_records(pafs.LocalFileSystem(), one["name"], order)] == [held[k][0] for k in order]
    assert records.token_records(nothing, P.path("byte_bpe_50k.json")).count() == 0


def shingles(text, n):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


@pytest.mark.parametrize("n", [2, 5])
def test_near_dedup(docs, nothing, n):
    rows = [(r["doc_id"], shingles(r["text"], n)) for r in docs.collect() if r["doc_id"] is not None]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in rows:
        for b, t in rows:
            if a < b and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    out = near_dedup.near_dedup(docs, shingle_words=n).collect()
    assert len(out) == docs.count()
    sizes = {d: len(s) for d, s in rows}
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (sizes[r["doc_id"]], find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])
    assert near_dedup.near_dedup(nothing, shingle_words=n).count() == 0


def test_near_dedup_chains(spark):
    """A chain of texts, each near the next only: all one component, found beyond the stars."""
    words = [f"v{i}" for i in range(300)]
    rows = [(i, " ".join(words[7 * i : 7 * i + 80])) for i in range(30)]
    assert {r["component_id"] for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()} == {0}


def test_components(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)], "u long, v long")
    for few in (components.FEW, 0):
        monkeypatch.setattr(components, "FEW", few)
        got = dict(map(tuple, components.components(edges).collect()))
        assert got == {**dict.fromkeys(range(1, 41), 0), 101: 100, 103: 100}
        assert components.components(edges.limit(0)).count() == 0


def test_toxicity_and_quality(spark, nothing):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        bad, junk = i % 5 == 0, i % 7 == 0
        words = [rng.choice(VOCABULARY) for _ in range(40)] + rng.sample(["vile", "nasty", "rotten"], k=rng.randint(1, 3)) * bad
        rng.shuffle(words)
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if junk else " ".join(words)))
        labels.append((i, int(not junk), int(bad)))
    rows += [(900, None), (901, ""), (None, "vile")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    told = spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    out = by_id(toxicity.toxicity(texts, told))
    held = [i for i in range(900) if out[i]["held_out"]]
    assert held and sum(out[i]["toxic"] == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= r["severity"] <= toxicity.GRADES for r in out.values()) and not out[900]["toxic"]
    best = by_id(quality.quality(texts, told))
    assert all(best[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(900))
    assert sum(best[i]["predicted"] == (i % 7 != 0) for i in held) >= 0.97 * len(held)
    empty = told.limit(0)
    assert {r["score"] for r in quality.quality(texts, empty).collect()} == {0.5}
    assert toxicity.toxicity(nothing, empty).count() == 0 and quality.quality(nothing, told).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 16)))]
    rows += [(400 + i, rows[0][1]) for i in range(10)] + [(500, None), (501, [0.0] * 16), (502, [math.nan] * 16), (503, [1.0] * 15 + [None]), (504, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    valid = {i: np.array(v) for i, v in rows if i < 500}
    got = neighbours.neighbours(table, F.col("vec_id") % 20 == 0).collect()
    hits = 0
    for q in (i for i in valid if i % 20 == 0):
        score = {i: float(v @ valid[q] / np.sqrt((v @ v) * (valid[q] @ valid[q]))) for i, v in valid.items() if i != q}
        best = sorted(score, key=lambda i: (-round(score[i], 12), i))[:5]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert len(own) == 5 and all(abs(r["score"] - score[r["vec_id"]]) < 1e-12 for r in own)
        hits += len({r["vec_id"] for r in own} & set(best))
    assert hits >= 0.9 * 5 * len([i for i in valid if i % 20 == 0])
    assert neighbours.neighbours(table.limit(0), F.lit(True)).count() == 0
    few = neighbours.neighbours(table.where("vec_id < 3"), F.lit(True)).collect()
    assert Counter(r["query_id"] for r in few) == {0: 2, 1: 2, 2: 2}


def test_neighbours_of_extreme_and_unlike_vectors(spark, monkeypatch):
    """Finite components of any size; lengths are searched apart; the queries of a part are dealt over tasks."""
    monkeypatch.setattr(neighbours, "QUERIES", 1)
    rows = [(1, [1e200, 0.0]), (2, [1e200, 1e199]), (3, [0.0, 1.0]), (4, [1e-200, 3e-201]), (5, [5e-324, 0.0]), (6, [1.7e308, -1.7e308]), (11, [1.0, 0.0, 0.0]), (12, [2.0, 1.0, 0.0]), (13, [0.0] * 3), (14, [3.0] * 4)]
    got = neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True), 3).collect()
    for ids in ([1, 2, 3, 4, 5, 6], [11, 12]):
        unit = {i: np.array(v) / np.abs(v).max() for i, v in rows if i in ids}
        unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
        for q in ids:
            told = sorted(((unit[q] @ unit[i], i) for i in ids if i != q), key=lambda x: (-round(x[0], 12), x[1]))[:3]
            own = sorted(((r["score"], r["vec_id"]) for r in got if r["query_id"] == q), key=lambda x: (-round(x[0], 12), x[1]))
            assert [s for s, _ in own] == pytest.approx([s for s, _ in told], abs=1e-12)
            assert [i for _, i in own] == [i for _, i in told], q
    assert {r["query_id"] for r in got} == {1, 2, 3, 4, 5, 6, 11, 12}


def test_chi_square():
    assert neighbours.chi_square_cdf(neighbours.STOP) == pytest.approx(neighbours.CONFIDENCE)
    assert neighbours.chi_square_cdf(7.344) == pytest.approx(0.5, abs=1e-3)


def test_lm_scores(docs, nothing):
    out = lm_scoring.lm_scores(docs, P.path("byte_bpe_50k.json"))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(r["doc_id"], [*WORD.findall((r["text"] or "").translate(low)), None]) for r in docs.collect()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter(w for d, ws in rows if d is not None and not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    told = sorted((str(d), held(d), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for d, ws in rows)
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out.collect())
    for a, b in zip(told, got, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(r["score"] < 0 for r in out.collect())
    assert lm_scoring.lm_scores(nothing, P.path("byte_bpe_50k.json")).count() == 0


def test_attention_gradients_and_causality():
    from inkwell.llm import attention as A

    rng = np.random.default_rng(3)
    counts = rng.integers(1, 50, 300)
    ids, bounds = rng.integers(0, 299, 200).astype(np.uint32), np.array([0, 0, 5, 120, 200])
    inputs, goals, scored, text = A.layout(ids, bounds, 299)
    assert (goals >= 0).sum() == 200 + 4 and np.bincount(text[scored], minlength=4).tolist() == [1, 1, 8, 6]
    some = goals >= 0
    (a, b), n = np.unique(np.stack([inputs[some], goals[some]]), axis=1, return_counts=True)
    kind = np.where(np.arange(300) < 250, np.arange(300) % A.CLASSES, 0)
    follow = np.zeros((300, A.CLASSES), np.int64)
    np.add.at(follow, (a, kind[b]), n)
    model = A.start(A.untrained(counts, kind, follow, (a, b, n), 299), iter([(ids, bounds)]), 299)
    look, kind = np.append(model.look, -1), np.append(model.kind, -1)
    b = np.flatnonzero(scored)
    before, now, row, goal = look[inputs][b - 1], look[inputs][b], model.row[np.maximum(inputs[b], 0)], kind[goals][b]

    def loss():
        logits, _ = model.prepare().forward(before, now, row)
        logits = logits.astype(float)
        p = logits - np.log(np.exp(logits - logits.max(2, keepdims=True)).sum(2, keepdims=True)) - logits.max(2, keepdims=True)
        hit = np.take_along_axis(p, np.maximum(goal, 0)[:, :, None], 2)[:, :, 0]
        return -(hit * (goal >= 0)).sum() / (goal >= 0).sum()

    for part, g in A.gradients(model, before, now, row, goal).items():
        value = getattr(model, part)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = value[at]
        value[at] = old + 1e-2
        up = loss()
        value[at] = old - 1e-2
        down = loss()
        value[at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(g[at]), rel=0.1, abs=2e-4), part
    logits, _ = model.forward(before, now, row)
    changed = now.copy()
    changed[:, 9:] = 0
    assert np.allclose(logits[:, :9], model.forward(before, changed, row)[0][:, :9], atol=1e-5)


def test_mixing(spark, docs, nothing):
    out = mixing.mix(docs).collect()
    distinct = mixing.mix(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).cache()
    assert len(out) == docs.count()
    size = Counter()
    for r in docs.collect():
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        left, w = total - sum(3 * size[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 3 * size[s] if s in full else left * weight[s] / w for s in order}
        over = {s for s in order if target[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    for r in out:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    largest = {s: max(r["size"] for r in out if r["source"] == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    told = plain.mix([(r["doc_id"], r["source"], r["size"]) for r in distinct.collect()])
    assert {r["doc_id"]: r["copies"] for r in distinct.collect()} == told  # the draw itself
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["copies"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert mixing.mix(nothing).count() == 0


def test_host_rules(spark, docs, nothing):
    out = host_rules.host_rules(docs).collect()
    assert len(out) == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in out:
        t = texts[r["doc_id"]]
        words = WORD.findall(t)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        told = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[c] for c in host_rules.COUNTS[:5]) == told
        assert r["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and (not r["kept"] or not r["base_failed"])
    repeated = "a b c d e f g h i\n" * 4 + "\n\n# $ x"
    row = host_rules.host_rules(spark.createDataFrame([(1, repeated, "s")], "doc_id long, text string, source string")).first()
    assert (row["n_words"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == (39, 2, 3, 36)
    bad = [(i, "x", "bad", ) for i in range(50)] + [(100, sentence(40), "bad")] + [(200 + i, sentence(40), "good") for i in range(50)]
    kept = {r["doc_id"] for r in host_rules.host_rules(spark.createDataFrame(bad, "doc_id long, text string, source string")).where("kept").collect()}
    assert kept == {200 + i for i in range(50)}
    assert host_rules.host_rules(nothing).count() == 0


def test_personal_data(spark, docs, nothing):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    digits = lambda x: re.sub("[^0-9]", "", x)
    luhn = lambda d: sum(int(c) * (1 + k % 2) - 9 * (int(c) * (1 + k % 2) > 9) for k, c in enumerate(reversed(d))) % 10 == 0
    good = [lambda x: True, lambda x: all(int(p) <= 255 for p in x.split(".")), lambda x: 14 <= len(digits(x)) <= 19 and luhn(digits(x)), lambda x: 10 <= len(digits(x)) <= 15]
    rng = random.Random(9)
    odd = ["".join(rng.choice("a1.@+- 2(3)4.5é") for _ in range(rng.randint(5, 60))) for _ in range(300)]
    rows = [*((r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()), *((1000 + i, t) for i, t in enumerate(odd)), (5000, "a@b.cx_y@z.com 1.2.3.4.5 000000.0.0.0256"), (5001, "7" * 5000)]
    out = by_id(personal_data.find(spark.createDataFrame(rows, "doc_id long, text string")))
    for doc_id, t in rows:
        spans = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, t or "") if good[k](m[0]))
        written = ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        r = out[doc_id]
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest(), (t, written, r["spans"])
        assert [r[f"n_{k}"] for k in personal_data.KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]
        assert set(written.split(",")) - {""} <= set(r["spans"].split(","))
    assert personal_data.find(nothing).count() == 0
    clean = personal_data.redact(spark.createDataFrame([(1, "é a.b@c.de, 10.1.2.3!", 5)], "doc_id long, text string, extra int")).first()
    assert tuple(clean) == (1, "é [EMAIL], [IP]!", 5)


def check_round_trip(spark, rows, encoding):
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    out = by_id(byte_bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), ranks))
    assert len(out) == len(rows)
    for doc_id, t in rows:
        ids = np.array(encoding.encode_ordinary(t or ""), "<u4")
        told = (doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert tuple(out[doc_id]) == told, (t or "")[:100]


def test_byte_bpe(spark, docs, nothing, encoding, monkeypatch):
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(3)
    odd = ["".join(rng.choice("ab s't're'll'dve 'sm \n\t  é漢12٣²½!?., 　\xa0 x'") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    odd += ["".join(map(chr, range(256))), " ".join(chr(c) * 3 for c in range(1, 40)), "\x00a\x00b", "x\u2028y\ufeff z\U0001f600\U0001f469\u200d\U0001f4bb"]
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()] + [(1000 + i, t) for i, t in enumerate(odd)]
    check_round_trip(spark, rows, encoding)
    monkeypatch.setattr(byte_bpe, "COMMON_BYTES", 2_000)  # most pieces are joined
    monkeypatch.setattr(byte_bpe, "PART_BYTES", 20_000)
    check_round_trip(spark, rows, encoding)
    assert byte_bpe.round_trip(nothing, ranks).count() == 0
    twice = spark.createDataFrame([("a", "one two", 1), ("a", "one two", 1), (None, None, 2)], "doc_id string, text string, part int")
    coded = byte_bpe.encode(twice, ranks)
    assert sorted((r["doc_id"] or "", bytes(r["decoded"])) for r in coded.collect()) == [("", b""), ("a", b"one two"), ("a", b"one two")]
    assert sorted(bytes(r["decoded"]) for r in byte_bpe.decode(coded, ranks).collect()) == [b"", b"one two", b"one two"]


def test_byte_bpe_long_pieces(spark, encoding):
    """Words of up to 200,000 letters, of random letters, of one letter and of short periods that windows don't share."""
    rng = random.Random(4)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    texts = [word(200_000, "abcdefghijklmnopqrstuvwxyzé"), "a" * 1_500, "ab" * 700 + "c", "abc" * 300, "=" * 777 + "x", " " * 500, "7" * 400, "the" * 129, "漢字" * 200]
    texts += [word(rng.randint(120, 900), rng.choice(["ab", "etaoin", "xyzé", "aab"])) for _ in range(40)]
    check_round_trip(spark, list(enumerate(texts)), encoding)


def test_ranks_file():
    line = next(open(P.path("byte_bpe_50k.tiktoken"), "rb")).split()
    assert byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))[base64.b64decode(line[0])] == int(line[1])

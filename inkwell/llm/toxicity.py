"""Toxicity severity: cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w.x - theta_k) with one weight vector for all ordered thresholds. The expected severity is the
sum of P(grade > k). Labels say only toxic or not; graded labels are made from them: toxic rows are graded 1 to GRADES
by where their number of toxic words stands among the toxic rows, toxic words being those that the labels themselves
single out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import sparse, vectext
from inkwell.llm.common import crc32_mod

BITS = 40
MOST_LABELLED = 16_000
GRADES = 3
PREFIXES = (4, 5, 6)
LEAST_DOCS, LEAST_CHI2 = 5, 30.0
EPOCHS, RATE, DECAY = 1500, 0.3, 1e-6
_PUNCTUATION = np.arange(256, dtype=np.uint8)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


def features(chunk: vectext.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket), ordered by text, of the words without punctuation and of their starts; each counts once a text.

    Starts are the first 4, 5 and 6 code points of longer words, which stand for a stem with any ending.
    """
    plain = vectext.Chunk(chunk.first, _PUNCTUATION[chunk.data], chunk.bounds)
    found = vectext.words(plain, lower=True)
    text = sparse.text_of(found)
    lower = vectext.lowered(plain.data)
    point = np.flatnonzero((lower & 0xC0) != 0x80)
    nth = np.searchsorted(point, found.start)
    parts = [(text, found.hash)]
    for k in PREFIXES:
        end = np.append(point, len(lower))[np.minimum(nth + k, len(point))]
        long = np.flatnonzero(end < found.end)
        parts.append((text[long], vectext.pair_hash(vectext.span_hash(lower, found.start[long], end[long]), np.full(len(long), k, np.uint64))))
    return sparse.tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), BITS)[:2]


def grade(text: np.ndarray, bucket: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Ordered grades: 0 for rows that are not toxic, 1 to GRADES by quantile of the number of toxic words for the others."""
    hits = np.bincount(bucket, weights=toxic[text])
    docs = np.bincount(bucket)
    base = max(toxic.mean(), 1e-9)
    telling = (docs >= LEAST_DOCS) & (hits >= 0.9 * docs) & (docs * base < 0.5 * hits)
    number = np.bincount(text, weights=telling[bucket], minlength=len(toxic))
    out = np.zeros(len(toxic), np.int64)
    if toxic.any():
        cuts = np.quantile(number[toxic > 0], np.arange(1, GRADES) / GRADES)
        out[toxic > 0] = 1 + np.searchsorted(cuts, number[toxic > 0], side="right")
    return out


def screened(text: np.ndarray, bucket: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which buckets take part: found in LEAST_DOCS rows, and related to the label by chi-square with Yates' correction."""
    n, n1 = float(len(toxic)), float(toxic.sum())
    docs = np.bincount(bucket).astype(float)
    hits = np.bincount(bucket, weights=toxic[text])
    gap = np.maximum(np.abs(hits * n - docs * n1) - n / 2, 0)
    below = docs * (n - docs) * n1 * (n - n1)
    return (docs >= LEAST_DOCS) & (n * gap**2 / np.where(below > 0, below, np.inf) >= LEAST_CHI2)


def train(chunks: Iterator[vectext.Chunk], y: np.ndarray) -> bytes:
    """Full-batch AdaGrad on the ordinal likelihood; a JSON line with thresholds, then buckets (int64) and weights."""
    parts, at = [], 0
    for chunk in chunks:
        t, b = features(chunk)
        parts.append((t + at, b))
        at += len(chunk)
    text, bucket = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in range(2))
    names, bucket = np.unique(bucket, return_inverse=True)
    weights = np.zeros(0)
    theta = np.arange(1, GRADES + 1, dtype=float)
    if at:
        goal = grade(text, bucket, y)
        kept = screened(text, bucket, y)
        text, bucket, names = text[kept[bucket]], (np.cumsum(kept) - 1)[bucket[kept[bucket]]], names[kept]
        weights = np.zeros(len(names))
        above = np.arange(GRADES)[None, :] < goal[:, None]
        # raw steps keep the thresholds in order: theta_0, then positive gaps
        first, gap = 2.0, np.zeros(GRADES - 1)
        sums, sum_theta = np.full(len(names), 1e-8), np.full(GRADES, 1e-8)
        for _ in range(EPOCHS):
            theta = first + np.concatenate([[0], np.cumsum(np.exp(gap))])
            line = np.bincount(text, weights=weights[bucket], minlength=at)
            wrong = 1 / (1 + np.exp(-np.clip(line[:, None] - theta, -35, 35))) - above
            g = np.bincount(bucket, weights=wrong.sum(axis=1)[text], minlength=len(names)) / at + DECAY * weights
            sums += g * g
            weights -= RATE * g / np.sqrt(sums)
            down = -wrong.mean(axis=0)  # d loss / d theta
            g_theta = np.concatenate([[down.sum()], np.exp(gap) * np.cumsum(down[::-1])[::-1][1:]])
            sum_theta += g_theta * g_theta
            step = RATE * g_theta / np.sqrt(sum_theta)
            first, gap = first - step[0], gap - step[1:]
    return json.dumps(theta.tolist()).encode() + b"\n" + names[: len(weights)].astype("<i8").tobytes() + weights.astype("<f8").tobytes()


def _scorer(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, _, raw = model.partition(b"\n")
        theta, half = np.array(json.loads(head)), len(raw) // 2
        names, weights = np.append(np.frombuffer(raw[:half], "<i8"), 1 << BITS), np.append(np.frombuffer(raw[half:], "<f8"), 0.0)
        for batch in batches:
            out = [np.zeros(0)]
            for chunk in vectext.chunks(batch.column(1)):
                text, bucket = features(chunk)
                place = np.searchsorted(names, bucket)
                out.append(np.bincount(text, weights=weights[place] * (names[place] == bucket), minlength=len(chunk)))
            over = 1 / (1 + np.exp(-np.clip(np.concatenate(out)[:, None] - theta, -35, 35)))
            columns = [pa.array(over[:, 0]), pa.array(over.sum(axis=1)), pa.array((over >= 0.5).sum(axis=1), pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "p_toxic", "severity", "grade"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """Severity of whole texts (doc_id, text); labels is (doc_id, toxic 0/1).

    Returns doc_id, held_out (as for learning: crc32 of doc_id as text is 0 modulo 5), p_toxic (P(grade > 0)), severity
    (expected grade, 0 to GRADES), grade int (median grade) and toxic boolean (p_toxic >= 0.5), one row for each input
    row. Null and wordless texts have no feature and get the severity of the thresholds alone. Labels come from at most
    ``most_labelled`` rows; without any, weights are zero. Other columns are ignored.
    """
    rows = sparse.sample(docs, labels, F.col("toxic"), crc32_mod("doc_id", 5) != 0, most_labelled)
    model = sparse.fit(rows, train)
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = ready.mapInArrow(_scorer(model), "doc_id long, p_toxic double, severity double, grade int")
    return scored.select("doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "p_toxic", "severity", "grade", (F.col("p_toxic") >= 0.5).alias("toxic"))

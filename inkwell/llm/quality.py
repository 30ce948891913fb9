"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import sparse, vectext
from inkwell.llm.common import crc32_mod

BITS = 20
MOST_LABELLED = 16_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.3, 1.0


def features(chunk: vectext.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value), ordered by text: 1- and 2-grams of words and of word shapes.

    A word that equals the one before it also counts as a repeated word. Values are square roots of shares, so each
    text has norm 1 whatever its length. A text without words has no feature.
    """
    found = vectext.words(chunk)
    text, shape = sparse.text_of(found), sparse.shapes(chunk, found)
    near = text[1:] == text[:-1]
    same = np.flatnonzero(near & (found.hash[1:] == found.hash[:-1]))
    salt = [np.uint64(k) for k in (11, 12, 13, 14, 15)]
    parts = [
        (text, vectext.pair_hash(found.hash, salt[0])),
        (text, vectext.pair_hash(shape, salt[1])),
        (text[1:][near], vectext.pair_hash(vectext.ngram_hash(found.hash, 2)[near], salt[2])),
        (text[1:][near], vectext.pair_hash(vectext.ngram_hash(shape, 2)[near], salt[3])),
        (text[same], np.full(len(same), vectext.mix(salt[4:])[0])),
    ]
    text, bucket, times = sparse.tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), BITS)
    total = np.bincount(text, weights=times, minlength=len(chunk))
    return text, bucket, np.sqrt(times / total[text])


def train(chunks: Iterator[vectext.Chunk], y: np.ndarray) -> bytes:
    """FTRL-proximal, one example after another; bias first, then 2**BITS weights, as float32."""
    examples = []
    for chunk in chunks:
        text, bucket, value = features(chunk)
        at = np.searchsorted(text, np.arange(len(chunk) + 1))
        examples += [(bucket[a:b].astype(np.int32), value[a:b].astype(np.float32)) for a, b in zip(at[:-1], at[1:], strict=True)]
    z, n = np.zeros(1 + (1 << BITS)), np.zeros(1 + (1 << BITS))
    for _ in range(EPOCHS):
        for (bucket, value), label in zip(examples, y, strict=True):
            i, x = np.append(bucket + 1, 0), np.append(value, 1.0)
            w = np.where(np.abs(z[i]) <= L1 * (i > 0), 0.0, -(z[i] - np.sign(z[i]) * L1 * (i > 0)) / ((BETA + np.sqrt(n[i])) / ALPHA + L2 * (i > 0)))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    w[0] = -z[0] / ((BETA + np.sqrt(n[0])) / ALPHA)
    return w.astype("<f4").tobytes()


def _scorer(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(model, "<f4").astype(np.float64)
        for batch in batches:
            out = [np.zeros(0)]
            for chunk in vectext.chunks(batch.column(1)):
                text, bucket, value = features(chunk)
                out.append(w[0] + np.bincount(text, weights=w[bucket + 1] * value, minlength=len(chunk)))
            score = 1 / (1 + np.exp(-np.clip(np.concatenate(out), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """Score whole texts (doc_id, text) for the label quality = 1; labels is (doc_id, quality).

    Returns doc_id, held_out (crc32 of doc_id as text is 0 modulo 5; null for a null id), score in 0 to 1, predicted
    int. Weights come from at most ``most_labelled`` labelled rows that are not held out. Null and wordless texts get
    the score of the bias. Without any labels all scores are 0.5. Rows that repeat are scored each; other columns are
    ignored.
    """
    rows = sparse.sample(docs, labels, F.col("quality"), crc32_mod("doc_id", 5) != 0, most_labelled)
    model = sparse.fit(rows, train)
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = ready.mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

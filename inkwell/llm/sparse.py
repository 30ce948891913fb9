"""Sparse hashed text features and the bounded labelled samples that classifiers learn from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import vectext

#: Byte kinds: a-z and all of non-ASCII count as one letter, A-Z as another, digits as a third; others are themselves.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = _KIND[128:] = 97
_KIND[65:91] = 65
_KIND[48:58] = 48


def shapes(chunk: vectext.Chunk, found: vectext.Words) -> np.ndarray:
    """Hash of each word's shape: its byte kinds with runs of one kind written once ("Hello,," has the shape "Aa,")."""
    kind = _KIND[chunk.data]
    first = np.ones(len(kind), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[found.start] = True
    place = np.concatenate([[0], np.cumsum(first)])
    return vectext.span_hash(kind[first], place[found.start], place[found.end])


def tally(text: np.ndarray, feature: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, times) of features hashed into 2**bits buckets, ordered by text and bucket."""
    key = (text.astype(np.uint64) << np.uint64(bits)) | (feature >> np.uint64(64 - bits))
    key, times = np.unique(key, return_counts=True)
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64), times


def text_of(found: vectext.Words) -> np.ndarray:
    return np.repeat(np.arange(len(found.bounds) - 1), found.counts)


def sample(docs: DataFrame, labels: DataFrame, label: Column, allowed: Column, most: int) -> DataFrame:
    """(doc_id, y, text) of at most ``most`` labelled rows, the first by a hash of the id, so that reruns agree.

    ``allowed`` is a condition on doc_id. Rows without a label or an id take no part; of an id's repeated labels the
    largest counts, of an id's repeated texts the least. The ids, at most ``most`` of them, are broadcast to the documents.
    """
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.cast("int").alias("y")).where("doc_id is not null and y is not null").where(allowed)
    told = told.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(told), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def fit(rows: DataFrame, train: Callable[[Iterator[vectext.Chunk], np.ndarray], bytes]) -> bytes:
    """Run ``train`` (chunks of texts, their labels) in one task over a bounded sample; what it returns comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("text", pa.string())]))
        yield pa.RecordBatch.from_pydict({"model": pa.array([train(vectext.chunks(table.column("text")), table.column("y").to_numpy().astype(np.int64))], pa.binary())})

    row = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").mapInArrow(run, "model binary").first()
    return bytes(row["model"]) if row else train(iter(()), np.zeros(0, np.int64))  # an empty table has no partition

"""Host-level quality rules: rule failures by host, rates shrunk with an empirical beta prior, verdicts joined back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import vectext
from inkwell.llm.common import keep, salted_lookup

WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def text_counts(chunk: vectext.Chunk) -> list[np.ndarray]:
    """The COUNTS of each text of a chunk."""
    data, n = chunk.data, len(chunk.data)
    found = vectext.words(chunk)
    zero = np.zeros(1, np.int64)
    points = np.concatenate([zero, np.cumsum((data & 0xC0) != 0x80)])
    in_words = np.concatenate([zero, np.cumsum(points[found.end] - points[found.start])])
    symbols = np.concatenate([zero, np.cumsum(_SYMBOL[data])])
    text = np.repeat(np.arange(len(chunk), dtype=np.uint64), found.counts)
    # words covered by a window that is found again in the same text
    runs = vectext.ngram_hash(found.hash, WINDOW)
    inside = text[: len(runs)] == text[WINDOW - 1 :] if len(runs) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    _, which, times = np.unique(vectext.pair_hash(text[at], runs[at]), return_inverse=True, return_counts=True)
    again = at[times[which] > 1]
    edge = np.zeros(len(found.start) + WINDOW + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    covered = np.concatenate([zero, np.cumsum(np.cumsum(edge)[: len(found.start)] > 0)])
    # lines with a word that equal an earlier one of the same text
    breaks = np.flatnonzero(data == 10)
    start = np.union1d(breaks + 1, chunk.bounds[:-1])
    start = start[start < n]
    end = np.append(start[1:], n)
    end -= (data[end - 1] == 10) if len(end) else 0
    busy = np.searchsorted(found.start, end) > np.searchsorted(found.start, start)
    start, end = start[busy], end[busy]
    line_text = np.searchsorted(chunk.bounds, start, side="right") - 1
    lines = np.bincount(line_text, minlength=len(chunk))
    key = vectext.pair_hash(line_text.astype(np.uint64), vectext.span_hash(data, start, end)) if len(start) else np.zeros(0, np.uint64)
    _, first = np.unique(key, return_index=True)
    fresh = np.bincount(line_text[first], minlength=len(chunk))
    b = found.bounds
    return [found.counts, np.diff(in_words[b]), np.diff(symbols[chunk.bounds]), lines - fresh, np.diff(covered[b]), lines]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [text_counts(c) for c in vectext.chunks(batch.column("text"))]
        for i, name in enumerate(COUNTS):
            column = pa.array(np.concatenate([p[i] for p in parts]) if parts else [], pa.int64())
            batch = batch.append_column(name, column)
        yield batch.drop_columns(["text"])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rule_failed(symbol_percent: int, line_percent: int) -> Column:
    """A document fails when a base rule, the share of symbols among words or the share of repeated lines is too high."""
    return base_failed() | (100 * F.col("n_symbols") > symbol_percent * F.col("n_words")) | (100 * F.col("n_dup_lines") > line_percent * F.col("n_lines"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(a, b) by moments of the hosts' failure rates; strength within 2 to 1000 (1000 if rates don't vary)."""
    rate = F.col("failed") / F.col("docs")
    row = hosts.agg(F.sum("failed").alias("f"), F.sum("docs").alias("n"), F.var_pop(rate).alias("v")).first()
    mean = (row["f"] + 0.5) / (row["n"] + 1) if row["n"] else 0.5
    strength = min(max(mean * (1 - mean) / row["v"] - 1, 2.0), 1000.0) if row["v"] else 1000.0
    return mean * strength, (1 - mean) * strength


def host_rules(docs: DataFrame, host: str = "source", most: float = 0.5, symbol_percent: int = 100, line_percent: int = 30) -> DataFrame:
    """Counts and verdicts of documents (doc_id, text and the host column), one row for each input row.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean) and
    the host's docs, failed (long) and rate (double, shrunk). A document is kept if base_failed is false and its host's
    shrunk failure rate is at most ``most``. A null text counts as the empty text, which fails; null hosts are one
    host; rows that repeat count each. Other columns are ignored, and an empty table gives an empty result.
    """
    ready = docs.select("doc_id", F.col(host).alias("host"), "text")
    schema = f"doc_id {ready.schema['doc_id'].dataType.simpleString()}, host {ready.schema['host'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)
    counts = keep(ready.mapInArrow(_count, schema))
    hosts = keep(counts.groupBy("host").agg(F.count("*").alias("docs"), F.count_if(rule_failed(symbol_percent, line_percent)).alias("failed")))
    a, b = beta_prior(hosts)
    hosts = hosts.withColumn("rate", (F.col("failed") + a) / (F.col("docs") + a + b))
    out = salted_lookup(counts.withColumn("base_failed", base_failed()), hosts, "host", "doc_id")
    return out.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & (F.col("rate") <= most)).alias("kept"), "docs", "failed", "rate")

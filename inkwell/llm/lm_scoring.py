"""Language-model scores of documents, beside a smoothed unigram score of their words.

Every document is encoded once and written with its ids. Pairs of neighbouring ids are counted over all training
documents; from these counts come the counts of ids, the classes, the shares of classes after an id and of ids in a
class. The attention model starts from a fit on a sample; from there each shard of the training corpus trains on all its
windows, and the shards' weights are averaged, so both the counts and the training are those of the whole corpus.
A last pass scores every document. Counts of the commonest words, a bounded number, go to the tasks; the other words of a
document are joined with their counts by key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import attention, sparse, vectext
from inkwell.llm.common import crc32_mod, new_folder
from inkwell.llm.lookup import Lookup
from inkwell.llm.pretoken import library_encoder

SAMPLE_DOCS = 500  # of the first fit
COMMON_WORDS = 1 << 20
PAIRS = 1 << 20  # kept for the shares of ids in a class; others count as one with their id alone
WORD_CHUNK, GROUP, HELD = 1 << 21, 1 << 17, 1 << 22  # bytes of text, ids and pairs worked on at a time
BLOCKS = 256  # into which ids are cut to sum counts of pairs


def _lower(chunk: vectext.Chunk) -> vectext.Chunk:
    return vectext.Chunk(chunk.first, vectext.lowered(chunk.data), chunk.bounds)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of a task's words, given whenever a quarter of HELD keys are held."""

    def out(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    attention.keep_freed_memory()
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for batch in batches:
        for chunk in map(_lower, vectext.chunks(batch.column(0), WORD_CHUNK)):
            parts.append(np.unique(vectext.words(chunk).hash, return_counts=True))
            held += len(parts[-1][0])
            if held > HELD // 4:
                parts = [_merged(parts)]
                held = len(parts[0][0])
                if held > HELD // 8:
                    yield out(*parts[0])
                    parts, held = [], 0
        pa.default_memory_pool().release_unused()
    if parts:
        yield out(*_merged(parts))


def _encode(vocabulary: str, kind: str):
    """Documents with their ids, of numpy's ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attention.keep_freed_memory()
        encoder = library_encoder(vocabulary)
        for batch in batches:
            for chunk in map(_lower, vectext.chunks(batch.column("text"))):
                ids, bounds = encoder.chunk_ids(chunk)
                size = np.dtype(kind).itemsize
                held = pa.Array.from_buffers(pa.binary(), len(chunk), [None, pa.py_buffer((bounds * size).astype(np.int32)), pa.py_buffer(ids.astype(kind))])
                rows = batch.slice(chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays([*rows.columns, held], [*rows.schema.names, "ids"])
            pa.default_memory_pool().release_unused()

    return run


def _id_kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _groups(column: pa.Array, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, bounds) of neighbouring rows, about GROUP ids together."""
    _, offsets, data = column.buffers()
    size = np.dtype(kind).itemsize
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // size
    data = np.frombuffer(data, np.uint8)[: bounds[-1] * size].view(kind) if data is not None else np.zeros(0, kind)
    row = 0
    while row < len(column):
        end = min(max(int(np.searchsorted(bounds, bounds[row] + GROUP, side="right")) - 1, row + 1), len(column))
        yield row, data[bounds[row] : bounds[end]].astype(np.int32), bounds[row : end + 1] - bounds[row]
        row = end


def _sequences(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for _, ids, bounds in _groups(batch.column(0), kind):
            yield ids, bounds
        pa.default_memory_pool().release_unused()


def _rows(**columns: list) -> pa.RecordBatch:
    kinds = {"block": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.binary())) for k, v in columns.items()], list(columns))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their numbers."""
    if len(parts) == 1:
        return parts[0]
    pair, which = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return pair, np.bincount(which, weights=np.concatenate([n for _, n in parts]), minlength=len(pair)).astype(np.int64)


def _count_pairs(kind: str, end: int):
    """Counts of pairs that a task meets: a row for each block of first ids, and anew whenever HELD pairs are held."""

    def out(pair: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        block = (pair >> np.uint64(32)).astype(np.int64) * 40503 % BLOCKS  # common ids stand in a row, so they are spread
        order = np.argsort(block, kind="stable")
        block, pair, n = block[order], pair[order], n[order]
        cut = np.flatnonzero(np.diff(block, prepend=-1))
        spans = [slice(a, b) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(pair)], strict=True)]
        return _rows(block=block[cut].tolist(), pairs=[pair[s].tobytes() for s in spans], times=[n[s].tobytes() for s in spans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attention.keep_freed_memory()
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for ids, bounds in _sequences(batches, kind):
            inputs, goals, _, _ = attention.layout(ids, bounds, end)
            some = goals >= 0
            parts.append(np.unique((inputs[some].astype(np.uint64) << np.uint64(32)) + goals[some].astype(np.uint64), return_counts=True))
            held += len(parts[-1][0])
            if held > HELD:
                parts = [_merged(parts)]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield out(*parts[0])
                    parts, held = [], 0
        if parts:
            yield out(*_merged(parts))

    return run


def _sum_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a block's pairs; blocks come one after another."""
    now, parts, held = None, [], 0
    for batch in batches:
        for block, pairs, times in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if block != now and parts:
                pair, n = _merged(parts)
                yield _rows(block=[now], pairs=[pair.tobytes()], times=[n.tobytes()])
                parts, held = [], 0
            now = block
            parts.append((np.frombuffer(pairs.as_py(), np.uint64), np.frombuffer(times.as_py(), np.int64)))
            held += len(parts[-1][0])
            if held > HELD:
                parts = [_merged(parts)]
                held = len(parts[0][0])
    if parts:
        pair, n = _merged(parts)
        yield _rows(block=[now], pairs=[pair.tobytes()], times=[n.tobytes()])


_PAIR_ROWS = "block int, pairs binary, times binary"


def _pair_table(encoded: DataFrame, end: int, size: int) -> DataFrame:
    """(block, pairs, times) of all training documents, as a table."""
    folder = new_folder(encoded.sparkSession, "lm-pairs")
    counted = encoded.where("train").select("ids").mapInArrow(_count_pairs(_id_kind(size), end), _PAIR_ROWS)
    counted.repartition("block").sortWithinPartitions("block").mapInArrow(_sum_pairs, _PAIR_ROWS).write.parquet(folder)
    return encoded.sparkSession.read.schema(_PAIR_ROWS).parquet(folder)


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for pairs, times in zip(batch.column("pairs"), batch.column("times"), strict=True):
            pair = np.frombuffer(pairs.as_py(), np.uint64)
            yield (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64), np.frombuffer(times.as_py(), np.int64)


def _cells(table: DataFrame, make, space: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells, below ``space``, that ``make`` gives for (before, after, number) of pairs, and their sums.

    The cells of a block are summed where it stands; what the driver gets is bounded by ``space`` for each partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_summed(*make(*block)) for block in _blocks_of(batches)]
        if parts:
            cell, n = _merged(parts)
            yield _rows(cells=[cell.tobytes()], times=[n.tobytes()])

    held = [(np.frombuffer(r["cells"], np.int64), np.frombuffer(r["times"], np.int64)) for r in table.coalesce(8).mapInArrow(run, "cells binary, times binary").toLocalIterator()]
    return _merged(held) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _summed(cell: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, which = np.unique(cell, return_inverse=True)
    return key, np.bincount(which, weights=n, minlength=len(key)).astype(np.int64)


def _dense(cells: tuple[np.ndarray, np.ndarray], space: int) -> np.ndarray:
    out = np.zeros(space, np.int64)
    out[cells[0]] = cells[1]
    return out


def _classes(table: DataFrame, counts: np.ndarray, end: int) -> np.ndarray:
    """Classes of ids by their neighbours in all training documents; the cells, bounded by the vocabulary, meet in a task."""
    rank, size = attention.ranked(counts, end), len(counts)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, n in _blocks_of(batches):
            cell, times = _summed(attention.neighbour_cells(a, b, rank, size), np.concatenate([n, n]))
            yield _rows(cells=[cell.tobytes()], times=[times.tobytes()])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for batch in batches:
            for c, t in zip(batch.column(0), batch.column(1), strict=True):
                parts = [_merged([*parts, (np.frombuffer(c.as_py(), np.int64), np.frombuffer(t.as_py(), np.int64))])]
        yield _rows(kind=[attention.classes(counts, *parts[0], end).astype(np.int64).tobytes()])

    row = table.mapInArrow(cells, "cells binary, times binary").repartition(1).mapInArrow(fit, "kind binary").first()
    none = np.zeros(0, np.int64)
    return np.frombuffer(bytes(row["kind"]), np.int64) if row else attention.classes(counts, none, none, end)


def _kept_pairs(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, after, number) of the commonest pairs: all those of the highest counts, together at most PAIRS."""

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, n in _blocks_of(batches):
            level, pairs = np.unique(n, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(pairs)], ["n", "pairs"])

    total, least = 0, 1 << 62
    for row in table.mapInArrow(levels, "n long, pairs long").groupBy("n").agg(F.sum("pairs").alias("pairs")).orderBy(F.desc("n")).limit(PAIRS).toLocalIterator():
        total += row["pairs"]
        if total > PAIRS:
            break
        least = row["n"]

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, n in _blocks_of(batches):
            some = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (a, b, n)], ["a", "b", "n"])

    found = table.mapInArrow(top, "a long, b long, n long").toArrow()  # at most PAIRS rows
    a, b, n = (found.column(c).to_numpy() for c in ("a", "b", "n"))
    order = np.lexsort((b, a))
    return a[order], b[order], n[order]


def _starter(model: bytes, kind: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attention.keep_freed_memory()
        yield _rows(model=[attention.start(attention.Model.load(model), _sequences(batches, kind), end).save()])

    return run


def untrained(table: DataFrame, end: int, size: int) -> attention.Model:
    """The model that the counts of pairs give, its attention part still without weight."""
    counts = _dense(_cells(table, lambda _, b, n: (b, n), size), size)
    kind = _classes(table, counts, end)
    n = attention.CLASSES
    follow = _dense(_cells(table, lambda a, b, times: (a * n + kind[b], times), size * n), size * n).reshape(size, n)
    return attention.untrained(counts, kind, follow, _kept_pairs(table), end)


def _trained(encoded: DataFrame, model: attention.Model, end: int, size: int) -> tuple[attention.Model, int]:
    """The mean of the shards' models, weighted by their windows, and the number of all training windows."""
    kind, train = _id_kind(size), encoded.where("train")
    first = train.select("row").orderBy(F.xxhash64("doc_id"), "doc_id", "row").limit(SAMPLE_DOCS)
    some = train.select("row", "ids").join(F.broadcast(first), "row")  # SAMPLE_DOCS rows
    raw = some.repartition(1).sortWithinPartitions("row").select("ids").mapInArrow(_starter(model.save(), kind, end), "model binary").first()
    if not raw:
        return model, 0
    begin = bytes(raw["model"])
    held = encoded.sparkSession.sparkContext.broadcast(begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attention.keep_freed_memory()
        own = attention.Model.load(held.value)
        windows, used = attention.pass_over(own, _sequences(batches, kind), end)
        if used:
            flat = attention.weights(own) * used
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat), pa.array(np.full(len(flat), used)), pa.array(np.full(len(flat), windows))], ["place", "value", "used", "windows"])

    rows = train.select("ids").mapInArrow(run, "place int, value double, used long, windows long").groupBy("place").agg(F.sum("value").alias("value"), F.sum("used").alias("used"), F.sum("windows").alias("windows")).orderBy("place").collect()  # as many as the model has weights
    model = attention.Model.load(begin)
    if not rows:
        return model, 0
    return attention.with_weights(model, np.array([r["value"] / r["used"] for r in rows])), rows[0]["windows"]


_held: dict[str, tuple] = {}  # of a worker process: what its last scorer's tasks share


def _tables(name: str, model, common, total: float) -> tuple[attention.Model, Lookup, np.ndarray]:
    if name not in _held:
        _held.clear()
        names, counts = (np.frombuffer(x, t) for x, t in zip(common.value, ("<u8", "<i8"), strict=True))
        logs = np.log10((counts + 0.1) / total) if total else np.zeros(len(counts))
        _held[name] = attention.Model.load(model.value), Lookup(names), logs
    return _held[name]


def _scorer(kind: str, model, common, total: float, end_count: int, end: int):
    """Rows of documents: what the common words give, the model's score, and the rarer words with their numbers."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attention.keep_freed_memory()
        lm, lookup, logs = _tables(name, model, common, total)
        at_end = np.log10((end_count + 0.1) / total) if total else 0.0
        for batch in batches:
            parts = []
            for chunk in map(_lower, vectext.chunks(batch.column("text"))):
                found = vectext.words(chunk)
                text = sparse.text_of(found)
                place = lookup.find(found.hash)
                known = place >= 0
                base = np.bincount(text[known], weights=logs[place[known]], minlength=len(chunk)) + at_end
                n_known = np.bincount(text[known], minlength=len(chunk)) + (end_count > 0)
                rest, bounds = found.hash[~known].view(np.int64), np.concatenate([[0], np.cumsum(np.bincount(text[~known], minlength=len(chunk)))])
                ids = batch.column("ids").slice(chunk.first, len(chunk))
                score = np.concatenate([lm.score(i, bounds_, end) for _, i, bounds_ in _groups(ids, kind)])
                parts.append((found.counts + 1, n_known, base, score, rest, bounds))
            columns = [np.concatenate(c) for c in list(zip(*parts, strict=True))[:5]] if parts else [np.zeros(0)] * 5
            sizes = np.concatenate([np.zeros(1, np.int64)] + [np.diff(p[5]) for p in parts])
            rarer = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(columns[4], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *(pa.array(c, t) for c, t in zip(columns[:4], (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)), rarer], ["doc_id", "row", "n_tokens", "n_known", "base", "score", "rarer"])

    return run


def lm_scores(docs: DataFrame, vocabulary: str, end: int = 50256, vocabulary_size: int = 50257) -> DataFrame:
    """Scores of documents (doc_id, text), one row for each input row.

    Returns doc_id, held_out (crc32 of doc_id as text is 0 modulo 10), n_tokens (words and the end), n_known (tokens met
    in training), train_tokens, base_score (sum of log10 unigram probabilities, add-0.1) and score (the model's log10
    probability of the lower-cased text with its end). Training takes the rows that are not held out; a null id is held
    out of it, though its held_out is false. A null text is the empty one: the end alone. With no training rows, base
    scores are 0 and the model is uniform within its classes. Rows that repeat are scored each; extra columns are
    ignored; an empty table gives an empty result.
    """
    spark, kind = docs.sparkSession, _id_kind(vocabulary_size)
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    held = crc32_mod("doc_id", 10) == 0
    folder, encoded_folder = new_folder(spark, "lm-counts"), new_folder(spark, "lm-encoded")
    trained = ready.where(~held)
    trained.select("text").mapInArrow(_count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).write.parquet(folder)
    words = spark.read.schema("key long, n long").parquet(folder)
    numbered = ready.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce(~held, F.lit(False)).alias("train"), "text")
    schema = "doc_id long, row long, train boolean, text string"
    numbered.mapInArrow(_encode(vocabulary, kind), f"{schema}, ids binary").write.option("parquet.enable.dictionary", "false").option("parquet.block.size", 8 << 20).parquet(encoded_folder)
    encoded = spark.read.schema(f"{schema}, ids binary").parquet(encoded_folder)
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    train_docs = encoded.where("train").count()
    train_tokens, total = sums["n"] + train_docs, sums["n"] + train_docs + 0.1 * (sums["v"] + (train_docs > 0) + 1)

    model, _ = _trained(encoded, untrained(_pair_table(encoded, end, vocabulary_size), end, vocabulary_size), end, vocabulary_size)

    levels = words.groupBy("n").agg(F.count("*").alias("words")).withColumn("above", F.sum("words").over(Window.orderBy(F.desc("n"))))
    least = levels.where(F.col("above") <= COMMON_WORDS).agg(F.min("n").alias("n")).first()["n"]
    top = words.where(F.col("n") >= (least if least is not None else (1 << 62))).select("key", "n").toArrow()  # at most COMMON_WORDS
    names, n = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()
    common = spark.sparkContext.broadcast((names.tobytes(), n.tobytes()))

    scored_folder = new_folder(spark, "lm-scored")
    schema = "doc_id long, row long, n_tokens long, n_known long, base double, score double, rarer array<long>"
    run = _scorer(kind, spark.sparkContext.broadcast(model.save()), common, total if train_docs else 0.0, train_docs, end)
    encoded.select("doc_id", "row", "text", "ids").mapInArrow(run, schema).write.parquet(scored_folder)
    scored = spark.read.schema(schema).parquet(scored_folder)
    rarer = scored.select("row", F.explode("rarer").alias("key")).groupBy("key", "row").agg(F.count("*").alias("times"))
    c = F.coalesce(F.col("n"), F.lit(0))
    part = rarer.join(words.select("key", "n"), "key", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10((c + 0.1) / F.lit(total))).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("also"))
    out = scored.drop("rarer").join(part, "row", "left")
    more = F.coalesce("more", F.lit(0.0)) if train_docs else F.lit(0.0)
    return out.select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), "score",
    )

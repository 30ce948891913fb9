"""Byte-level BPE encoding and decoding: ranked merges of distinct words, folded by Spark's higher-order functions.

Texts are cut into pieces, and each distinct piece of the corpus is folded once: its bytes become an array of ids, and a
fold merges the leftmost adjacent pair of lowest rank until none is left. Ranks of pairs of ids are a literal map, cut
into buckets. The ids then go back to the documents. The commonest pieces, of at most ``COMMON_BYTES`` together, go to
all tasks; a document's other pieces are joined by key and filled into the holes that they left, in parts of about
``PART_BYTES`` of text. Decoding concatenates the bytes of the ids.

A piece above ``LONG`` bytes is folded in windows that overlap by half. Two windows are joined at a token that stands at
the same place in both: a sequence of tokens is the encoding of its bytes exactly if each neighbouring pair is, and all
pairs left and right of that token come from one window. Where two windows share no token, the piece is cut into windows
twice as large, up to the whole piece. So work on a piece grows with its length, and only where it never falls into step
with its square.
"""

from __future__ import annotations

import base64
import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import vectext
from inkwell.llm.common import new_folder, partitions
from inkwell.llm.lookup import Lookup
from inkwell.llm.pretoken import pieces

LONG = 128
COMMON_BYTES, PART_BYTES = 56 << 20, 8 << 20
CHUNK = (1 << 20) - 2  # bytes worked on at a time, which bounds a worker's memory
BUCKETS = 1 << 16
_FACTOR, _SHIFT = 81007, 9  # of the hash that deals pairs over the buckets
_ID_BITS = 20
_NO_ID, _NO_RANK = (1 << _ID_BITS) - 1, (1 << 31) - 1
_HOLE = np.uint16(0xFFFF)  # no id: ids are below it


@functools.cache
def read_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rank_map(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The rank of each pair of ids whose bytes together are a piece of the vocabulary: buckets of maps, as a literal."""
    found = [((left << 16) + right, rank) for piece, rank in ranks.items() for k in range(1, len(piece)) if (left := ranks.get(piece[:k])) is not None and (right := ranks.get(piece[k:])) is not None]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    bucket = (pairs[:, 0] * _FACTOR >> _SHIFT) & (BUCKETS - 1)
    pairs = pairs[np.argsort(bucket, kind="stable")]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=BUCKETS))]).astype(np.int32)
    maps = pa.MapArray.from_arrays(pa.array(offsets), pa.array(pairs[:, 0]), pa.array(pairs[:, 1].astype(np.int32)))
    return spark.createDataFrame(pa.table({"ranks": pa.ListArray.from_arrays(pa.array([0, BUCKETS], pa.int32()), maps)})).scalar()


def _fold(ranks: Column, piece: Column, singles: list[int]) -> Column:
    """Ids of a binary column. An element of the folded array is (rank of the pair with the next element, id)."""

    def rank(a: Column, b: Column) -> Column:
        bucket = lambda pair: F.get(ranks, F.shiftright(pair * _FACTOR, _SHIFT).bitwiseAND(BUCKETS - 1).cast("int"))
        return _let(F.shiftleft(a, 16) + b, lambda pair: F.coalesce(F.try_element_at(bucket(pair), pair), F.lit(_NO_RANK)))

    id_of = lambda x: x.bitwiseAND(_NO_ID)
    packed = lambda r, i: F.shiftleft(r.cast("bigint"), _ID_BITS) + i
    of_byte = F.split(F.lit(",".join(map(str, singles))), ",").cast("array<bigint>")
    one_by_one = F.transform(F.split(F.decode(piece, "ISO-8859-1"), ""), lambda c: F.get(of_byte, F.ascii(c)))

    def begin(ids: Column) -> Column:
        edge = F.array(F.lit((_NO_RANK << _ID_BITS) + _NO_ID))  # spares a case for the first id
        return F.concat(edge, F.transform(ids, lambda x, i: packed(F.coalesce(rank(x, F.get(ids, i + 1)), F.lit(_NO_RANK)), x)))

    def merged(now: Column, new: Column, place: Column) -> Column:
        after = id_of(F.coalesce(F.get(now, place + 1), F.lit(_NO_ID)))
        put = lambda x, j: F.when(j == place - 1, packed(rank(new, after), new)).when(j == place - 2, packed(rank(id_of(x), new), id_of(x))).otherwise(x)
        return F.transform(F.filter(now, lambda _, j: j != place), put)

    def step(now: Column, _: Column) -> Column:
        low = lambda least: F.when(least >= (_NO_RANK << _ID_BITS), now).otherwise(_let(F.array_position(now, least).cast("int"), lambda place: merged(now, F.shiftright(least, _ID_BITS), place)))
        return _let(F.array_min(now), low)

    def all_steps(ids: Column) -> Column:
        done = F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(ids), F.lit(2))), begin(ids), step)
        return F.transform(F.slice(done, F.lit(2), F.size(ids)), lambda x: id_of(x).cast("int"))

    return F.when(F.octet_length(piece) == 0, F.array().cast("array<int>")).otherwise(_let(one_by_one, all_steps))


def fold(frame: DataFrame, piece: str, ranks: dict[bytes, int], spare: Column | None = None) -> DataFrame:
    """``frame`` with the ids of its binary column ``piece`` (null where ``spare`` holds).

    Work on a piece grows with the square of its length. The rank of a merge is the id that it makes.
    """
    if max(ranks.values()) >= _HOLE:
        raise ValueError("ids are held in 16 bits")
    singles = [ranks[bytes([i])] for i in range(256)]
    with_ranks = frame.withColumn("_ranks", rank_map(frame.sparkSession, ranks))  # inlined: _ranks stands below once
    one = _let(F.col("_ranks"), lambda table: _fold(table, F.col(piece), singles))
    return with_ranks.withColumn("ids", one if spare is None else F.when(~spare, one)).drop("_ranks")


def binaries(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """An Arrow array of byte spans."""
    length = end - start
    ends = np.cumsum(length)
    place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[place]))])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and its bounds in them."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _hashes(found: pa.Array | list[bytes]) -> np.ndarray:
    data, bounds = _bytes(found if isinstance(found, pa.Array) else pa.array(found, pa.binary()))
    return vectext.span_hash(data, bounds[:-1], bounds[1:])


def _unpacked(coded: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, numbers of ids and ids of a column of pieces' hashes with their ids."""
    data, bounds = _bytes(coded)
    words, head = data.view("<u2"), bounds[:-1] // 2
    body = np.ones(len(words), bool)
    at = (head[:, None] + np.arange(4)).ravel()
    body[at] = False
    return np.ascontiguousarray(words[at]).view("<u8"), np.diff(bounds) // 2 - 4, words[body]


class PieceTable(Lookup):
    """Ids of pieces by their 64-bit hash; slot -1 is a hole."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
        super().__init__(keys)
        self.lengths = np.append(lengths, 1).astype(np.uint16)  # the last one is the hole's
        ends = np.cumsum(self.lengths, dtype=np.int64)
        self.starts = (ends - self.lengths).astype(np.int32)
        self.flat = np.append(flat, _HOLE)

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of slots one after another, and where each slot's begin (a last entry closes them)."""
        return _gathered(self.flat, self.starts[slots], self.lengths[slots])


def _gathered(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(length, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    take = np.arange(total) + np.repeat(start - (ends - length), length)
    return pool[take], np.concatenate([[0], ends])


_tables: dict[str, PieceTable] = {}  # of a worker process: the table of its last broadcast


def _table(held) -> PieceTable:
    name, *arrays = held.value
    if name not in _tables:
        _tables.clear()
        _tables[name] = PieceTable(*(np.frombuffer(x, t) for x, t in zip(arrays, ("<u8", "<u2", "<u2"), strict=True)))
    return _tables[name]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each chunk of texts, with how often they occur."""
    for batch in batches:
        for chunk in vectext.chunks(batch.column(0), CHUNK):
            cut, _ = pieces(chunk)
            if len(cut) > 1:
                _, first, n = np.unique(vectext.span_hash(chunk.data, cut[:-1], cut[1:]), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([binaries(chunk.data, cut[first], cut[first + 1]), pa.array(n)], ["piece", "n"])
        pa.default_memory_pool().release_unused()


def _spliced(lengths: bytes):
    """Ids of long pieces from those of their windows, which come in order; null where two windows share no token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.frombuffer(lengths, "<i4")
        name, parts = None, []

        def whole() -> list[int] | None:
            out, begin = [], 0
            for k, (at, ids) in enumerate(parts):
                end = at + np.cumsum(size[ids])
                start = end - size[ids]
                use = start >= begin
                if k + 1 < len(parts):
                    later, other = parts[k + 1]
                    stop = later + np.cumsum(size[other])
                    both = np.intersect1d(start[use] * (1 << 10) + size[ids][use], (stop - size[other]) * (1 << 10) + size[other])
                    if len(both) == 0:
                        return None
                    begin = int(both[len(both) // 2] >> 10)
                    use &= start < begin
                out.extend(ids[use].tolist())
            return out

        for batch in batches:
            for key, at, ids in zip(batch.column("name").to_pylist(), batch.column("at").to_pylist(), batch.column("ids"), strict=True):
                if key != name and parts:
                    yield pa.RecordBatch.from_pydict({"name": [name], "ids": pa.array([whole()], pa.list_(pa.int32()))})
                    parts = []
                name = key
                parts.append((at, ids.values.to_numpy()))
        if parts:
            yield pa.RecordBatch.from_pydict({"name": [name], "ids": pa.array([whole()], pa.list_(pa.int32()))})

    return run


def _fold_long(todo: DataFrame, ranks: dict[bytes, int], folder: str) -> DataFrame:
    """(piece, n) -> (piece, ids, n) for long pieces, by windows. ``folder`` takes the rounds."""
    spark = todo.sparkSession
    size = np.zeros(max(ranks.values()) + 1, "<i4")
    size[list(ranks.values())] = [len(x) for x in ranks]
    todo = todo.select(F.sha2("piece", 256).alias("name"), "piece", "n")
    done, width = None, LONG
    while True:
        half = width // 2
        last = F.greatest(F.octet_length("piece") - half - 1, F.lit(0))
        windows = F.transform(F.sequence(F.lit(0), last, F.lit(half)), lambda at: F.struct(at.alias("at"), F.substring(F.col("piece"), at + 1, F.lit(width)).alias("part")))
        cut = todo.select("name", F.explode(windows).alias("w")).select("name", "w.at", "w.part").repartition(4 * partitions(spark), "name", "at")
        ids = fold(cut, "part", ranks).select("name", "at", "ids").repartition("name").sortWithinPartitions("name", "at")
        ids.mapInArrow(_spliced(size.tobytes()), "name string, ids array<int>").write.parquet(f"{folder}/{width}")
        found = spark.read.schema("name string, ids array<int>").parquet(f"{folder}/{width}")
        ready = todo.join(found.where("ids is not null"), "name").select("piece", "ids", "n")
        done = ready if done is None else done.union(ready)
        open_ = found.where("ids is null")
        if open_.isEmpty():
            return done
        todo, width = todo.join(open_.select("name"), "name", "left_semi"), 2 * width


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, ids, n) with the ids after the piece's hash in one binary; null where ids are."""
    for batch in batches:
        keys = _hashes(batch.column("piece")).astype("<u8")
        lists = batch.column("ids")
        flat, length = lists.flatten().to_numpy().astype("<u2"), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        head = np.arange(len(keys)) * 4 + np.cumsum(length) - length
        out = np.zeros(len(flat) + 4 * len(keys), "<u2")
        out[(head[:, None] + np.arange(4)).ravel()] = keys.view("<u2")
        body = np.ones(len(out), bool)
        body[(head[:, None] + np.arange(4)).ravel()] = False
        out[body] = flat
        coded = binaries(out.view(np.uint8), 2 * head, 2 * (head + 4 + length))
        yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.compute.if_else(lists.is_valid(), coded, None), batch.column("n")], ["piece", "coded", "n"])


_PIECES = "piece binary, coded binary, n long"


def fold_pieces(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(piece, coded, n) of the distinct pieces of all texts, as a table.

    ``coded`` is the piece's 64-bit hash and its ids as uint16, ``n`` how often the piece occurs.
    """
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "bpe-pieces")
    found = docs.select("text").mapInArrow(_distinct, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    fold(found, "piece", ranks, F.octet_length("piece") > LONG).select("piece", "ids", "n").mapInArrow(_packed, _PIECES).write.parquet(f"{folder}/short")
    short = spark.read.schema(_PIECES).parquet(f"{folder}/short")
    long = short.where("coded is null")
    if long.isEmpty():
        return short
    _fold_long(long.select("piece", "n"), ranks, f"{folder}/rounds").mapInArrow(_packed, _PIECES).write.parquet(f"{folder}/long")
    return short.where("coded is not null").union(spark.read.schema(_PIECES).parquet(f"{folder}/long"))


def _table_of(ranks: dict[bytes, int]):
    """(coded, n) of pieces, in one task -> the arrays of the common table and ids by falling number, as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lengths, flats = [_hashes(list(ranks))], [np.ones(len(ranks), np.int64)], [np.fromiter(ranks.values(), "<u2", len(ranks))]
        often = np.zeros(max(ranks.values()) + 1)
        for batch in batches:
            key, length, flat = _unpacked(batch.column(0))
            often += np.bincount(flat, weights=np.repeat(batch.column(1).to_numpy(), length), minlength=len(often))
            some = length < 1 << 16  # longer ones stay with the rarer pieces
            keys.append(key[some])
            lengths.append(length[some])
            flats.append(flat[np.repeat(some, length)])
        length, flat = np.concatenate(lengths), np.concatenate(flats)
        key, first = np.unique(np.concatenate(keys), return_index=True)  # a piece of the vocabulary has its own id
        flat, _ = _gathered(flat, (np.cumsum(length) - length)[first], length[first])
        columns = [key.astype("<u8"), length[first].astype("<u2"), flat.astype("<u2"), np.argsort(-often, kind="stable").astype("<u2")]
        yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["keys", "lengths", "flat", "by_number"])

    return run


def _common(folded: DataFrame, ranks: dict[bytes, int]) -> tuple[tuple[bytes, bytes, bytes], int, np.ndarray]:
    """The vocabulary and the commonest pieces (hashes, lengths, ids), the least count among the latter, and their ids by
    falling number.

    A piece weighs what it takes in a task's table. All pieces of a count are taken, or none.
    """
    weight = 2 * F.octet_length("coded") + 24
    levels = folded.groupBy("n").agg(F.sum(weight).alias("bytes")).orderBy(F.desc("n"))
    total, least = 0, 1 << 62
    for row in levels.limit(COMMON_BYTES // 40 + 1).toLocalIterator():  # a level weighs at least 40 bytes
        total += row["bytes"]
        if total > COMMON_BYTES:
            break
        least = row["n"]
    top = folded.where(F.col("n") >= least).select("coded", "n").repartition(1)  # at most COMMON_BYTES
    row = top.mapInArrow(_table_of(ranks), "keys binary, lengths binary, flat binary, by_number binary").first()
    if row is None:  # no text has a piece
        (batch,) = _table_of(ranks)(iter(()))
        row = batch.to_pylist()[0]
    return (bytes(row["keys"]), bytes(row["lengths"]), bytes(row["flat"])), least, np.frombuffer(bytes(row["by_number"]), "<u2")


#: Ids by falling number take one, two or three bytes: below ONE, below TWO, and all others.
ONE, TWO = 192, 192 + 63 * 256


class Packing:
    """Ids with holes as short bytes: first bytes of all, second ones, and whole numbers where two bytes don't do."""

    def __init__(self, order: np.ndarray) -> None:
        self.ids = np.concatenate([[_HOLE], order]).astype(np.uint16)
        self.number = np.zeros(1 << 16, np.int32)
        self.number[self.ids] = np.arange(len(self.ids))

    def pack(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        n = self.number[ids]
        two, three = (n >= ONE) & (n < TWO), n >= TWO
        a = np.where(n < ONE, n, np.where(two, ONE + ((n - ONE) >> 8), 255)).astype(np.uint8)
        b, c = ((n - ONE) & 255)[two].astype(np.uint8), n[three].astype("<u2")
        of = lambda mask: np.concatenate([[0], np.cumsum(mask)])[bounds].tolist()
        at_b, at_c, at = of(two), of(three), bounds.tolist()
        return [(at[k + 1] - at[k]).to_bytes(4, "little") + a[at[k] : at[k + 1]].tobytes() + b[at_b[k] : at_b[k + 1]].tobytes() + c[at_c[k] : at_c[k + 1]].tobytes() for k in range(len(at) - 1)]

    def unpack(self, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        first, second, third, sizes = [], [], [], []
        for raw in packed:
            n = int.from_bytes(raw[:4], "little")
            own = np.frombuffer(raw, np.uint8, n, 4)
            two = int(((own >= ONE) & (own < 255)).sum())
            first.append(own)
            second.append(np.frombuffer(raw, np.uint8, two, 4 + n))
            third.append(np.frombuffer(raw[4 + n + two :], "<u2"))
            sizes.append(n)
        a = np.concatenate(first).astype(np.int32)
        two, three = (a >= ONE) & (a < 255), a == 255
        a[two] = ONE + ((a[two] - ONE) << 8) + np.concatenate(second)
        a[three] = np.concatenate(third)
        return self.ids[a], np.concatenate([[0], np.cumsum(sizes)])


def _rarer(held):
    """(part, piece) of the pieces that aren't in the common table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(held)
        for batch in batches:
            part = batch.column(0).to_numpy().astype(np.uint64)
            for chunk in vectext.chunks(batch.column(1), CHUNK):
                cut, bounds = pieces(chunk)
                key = vectext.span_hash(chunk.data, cut[:-1], cut[1:])
                rare = np.flatnonzero(table.find(key) < 0)
                text = np.repeat(np.arange(len(chunk)), np.diff(bounds))[rare]
                own = part[chunk.first + text]
                _, first = np.unique(key[rare] ^ vectext.mix(own + np.uint64(1)), return_index=True)
                at = rare[first]
                yield pa.RecordBatch.from_arrays([pa.array(own[first].astype(np.int64)), binaries(chunk.data, cut[at], cut[at + 1])], ["part", "piece"])
            pa.default_memory_pool().release_unused()

    return run


def _with_holes(held, packing: Packing):
    """Rows of documents: their ids with a hole for each rarer piece (compressed), and the hashes of those pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, press = _table(held), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for chunk in vectext.chunks(batch.column(2), CHUNK):
                cut, bounds = pieces(chunk)
                key = vectext.span_hash(chunk.data, cut[:-1], cut[1:])
                slots = table.find(key)
                flat, begins = table.ids(slots)
                rare = np.flatnonzero(slots < 0)
                keys, at = key[rare], np.searchsorted(rare, bounds).tolist()
                coded = [press(x) for x in packing.pack(flat, begins[bounds])]
                holes = [keys[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
                rows = slice(chunk.first, chunk.first + len(chunk))
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], batch.column(1)[rows], pa.array(coded, pa.binary()), pa.array(holes, pa.binary())], ["part", "doc_id", "coded", "holes"])
            pa.default_memory_pool().release_unused()

    return run


def _filled(names: list[str], packing: Packing, emit):
    """Rows sorted by part, pieces before documents -> documents with their ids, through ``emit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen = zstandard.ZstdDecompressor().decompress
        part, found, held = None, [], None
        for batch in batches:
            parts = batch.column("part").to_numpy()
            is_doc = batch.column("holes").is_valid().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], (parts[1:] != parts[:-1]) | (is_doc[1:] != is_doc[:-1])])) if len(parts) else np.zeros(0, int)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(parts)], strict=False):
                if parts[a] != part:
                    part, found, held = parts[a], [], None
                rows = batch.slice(a, b - a)
                if not is_doc[a]:
                    found.append(_unpacked(rows.column("coded")))
                    continue
                if held is None:
                    key, length, flat = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, "<u8"), np.zeros(0, np.int64), np.zeros(0, "<u2"))
                    name, first = np.unique(key, return_index=True)
                    found, held = [], (name, first, length, np.cumsum(length) - length, flat)
                coded, holes, k = rows.column("coded").to_pylist(), rows.column("holes").to_pylist(), 0
                while k < len(coded):
                    raw, size, row = [], 0, k
                    while k < len(coded) and (size < CHUNK or not raw):
                        raw.append(loosen(coded[k]))
                        size, k = size + 2 * len(raw[-1]), k + 1
                    flat, bounds = _fill(*packing.unpack(raw), np.frombuffer(b"".join(holes[row:k]), "<u8"), held)
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id")[row:k], *emit(flat, bounds)], names)

    return run


def _fill(ids: np.ndarray, bounds: np.ndarray, wanted: np.ndarray, held: tuple) -> tuple[np.ndarray, np.ndarray]:
    name, first, length, start, flat = held
    hole = np.flatnonzero(ids == _HOLE)
    if len(hole) == 0:
        return ids, bounds
    place = np.minimum(np.searchsorted(name, wanted), max(len(name) - 1, 0))
    if len(name) == 0 or (name[place] != wanted).any():
        raise RuntimeError("a piece of a text has no ids: the documents changed between two reads")
    which = first[place]
    begins, lengths = np.arange(len(ids)), np.ones(len(ids), np.int64)
    begins[hole], lengths[hole] = start[which] + len(ids), length[which]
    out, ends = _gathered(np.concatenate([ids, flat]), begins, lengths)
    return out, ends[bounds]


class Bytes:
    """Decodes ids: the bytes of each, one after another."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        spelled = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            spelled[i] = piece
        self.pool, self.length = np.frombuffer(b"".join(spelled), np.uint8), np.array([len(x) for x in spelled], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        out, ends = _gathered(self.pool, self.start[ids], self.length[ids])
        offsets = ends[bounds].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))


def _little_endian(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(flat.astype("<u4"))])


def _coded(docs: DataFrame, ranks: dict[bytes, int], columns: str, emit) -> DataFrame:
    """doc_id and the ``columns`` that ``emit`` makes of (flat ids, bounds) for each row of docs."""
    spark = docs.sparkSession
    ready = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind_of_id = ready.schema["doc_id"].dataType.simpleString()
    folded = fold_pieces(ready, ranks)
    common, least, order = _common(folded, ranks)
    packing = Packing(order)
    held = spark.sparkContext.broadcast((uuid.uuid4().hex, *common))
    parts = max(1, -(-(ready.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    dealt = ready.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).alias("part"), "doc_id", "text")
    texts = dealt.mapInArrow(_with_holes(held, packing), f"part long, doc_id {kind_of_id}, coded binary, holes binary")
    rarer = dealt.select("part", "text").mapInArrow(_rarer(held), "part long, piece binary")
    ids = rarer.join(folded.where((F.col("n") < least) | (F.octet_length("coded") > 1 << 17)).select("piece", "coded"), "piece").select("part", "coded")
    rows = texts.unionByName(ids, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", F.col("holes").isNotNull())
    return rows.mapInArrow(_filled(["doc_id", *(c.split()[0] for c in columns.split(", "))], packing, emit), f"doc_id {kind_of_id}, {columns}")


def encode(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids array<int>, decoded binary), one row for each input row.

    ``decoded`` is made of the ids. A null or empty text has no ids. Rows that repeat give a row each; extra columns are
    ignored; an empty table gives an empty result. ``ranks`` holds every single byte and ids below 65,535; ids of
    special tokens never come out. Distinct pieces are told apart by their bytes, those of the common table and of a
    part by 64-bit hashes.
    """
    to_bytes = Bytes(ranks)
    return _coded(docs, ranks, "ids array<int>, decoded binary", lambda flat, bounds: (_lists(flat, bounds), to_bytes.decode(flat, bounds)))


def decode(coded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, ids array<int>) -> (doc_id, decoded binary); null ids decode to no bytes."""
    to_bytes = Bytes(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.nan_to_num(batch.column(1).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            yield pa.RecordBatch.from_arrays([batch.column(0), to_bytes.decode(batch.column(1).flatten().to_numpy(), bounds)], ["doc_id", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, decoded binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian uint32), decoded_sha256 (bytes of the decoded ids)."""
    to_bytes = Bytes(ranks)
    both = _coded(docs, ranks, "ids binary, decoded binary", lambda flat, bounds: (_little_endian(flat, bounds), to_bytes.decode(flat, bounds)))
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

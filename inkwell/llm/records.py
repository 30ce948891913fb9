"""Token-ID output: length-delimited binary records with masked checksums, and an offset index beside each file.

A record is: length of the payload (uint64), its masked CRC-32C (uint32), the payload, its masked CRC-32C (uint32), all
little-endian. The payload is the document id (int64), flags (uint32: bytes of a token id, 2 or 4; plus 256 for a null
document id) and the token ids. A shard's index file holds the record offsets (uint64), so that a reader can fetch
records in any order.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import vectext
from inkwell.llm.common import new_folder, partitions
from inkwell.llm.pretoken import full_encoder

#: Fixed values of CRC-32C and of the mask that record files put on it.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8
NULL_ID = 256
_BLOCK = 1024  # bytes of a block, a power of two
READ_BYTES = 4 << 20


@functools.cache
def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables (4 x 256) that advance a remainder over 4 zero bytes, over 8, 16 ... and over a block."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)

    def advance(x: np.ndarray) -> np.ndarray:  # over one zero byte
        return one[x & 0xFF] ^ (x >> np.uint32(8))

    base = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    step = base
    for _ in range(4):
        step = advance(step)
    steps = [step]
    while 4 << (len(steps) - 1) < _BLOCK:
        steps.append(_shift(steps[-1], steps[-1]))
    return step, steps


def _shift(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    m = np.uint32(0xFF)
    return table[0][x & m] ^ table[1][(x >> np.uint32(8)) & m] ^ table[2][(x >> np.uint32(16)) & m] ^ table[3][x >> np.uint32(24)]


def crc32c(parts: list[np.ndarray]) -> np.ndarray:
    """CRC-32C of byte arrays of at least 4 bytes, all at once.

    Each is laid out in blocks with zeros in front (which leave a zero remainder as it is); words of a block are
    combined in pairs, then the blocks of each array in turn.
    """
    word, steps = _tables()
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    blocks = -(-sizes // _BLOCK)
    ends = np.cumsum(blocks)
    flat = np.zeros(int(ends[-1]) * _BLOCK if len(parts) else 0, np.uint8)
    for end, size, part in zip((ends * _BLOCK).tolist(), sizes.tolist(), parts, strict=True):
        flat[end - size : end] = part
        flat[end - size : end - size + 4] ^= 0xFF
    rest = _shift(word, flat.view("<u4").reshape(-1, _BLOCK // 4))
    for table in steps[:-1]:
        rest = _shift(table, rest[:, 0::2]) ^ rest[:, 1::2]
    rest = rest[:, 0] if len(rest) else np.zeros(0, np.uint32)
    first, state = ends - blocks, np.zeros(len(parts), np.uint32)
    for k in range(int(blocks.max(initial=0))):
        has = np.flatnonzero(blocks > k)
        state[has] = _shift(steps[-1], state[has]) ^ rest[first[has] + k]
    return state ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frame(payloads: list[np.ndarray]) -> tuple[bytes, np.ndarray]:
    """Records of payloads (uint8 arrays), and the length of each record."""
    lengths = [np.array([len(p)], "<u8").view(np.uint8) for p in payloads]
    head, tail = masked(crc32c(lengths)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    out = [x for n, h, p, t in zip(lengths, head, payloads, tail, strict=True) for x in (n.tobytes(), h.tobytes(), p.tobytes(), t.tobytes())]
    return b"".join(out), np.fromiter((16 + len(p) for p in payloads), np.int64, len(payloads))


def unframe(raw: bytes, offsets: np.ndarray) -> list[np.ndarray]:
    """Payloads of the records at these offsets of ``raw``; a wrong length or checksum is an error."""
    data = np.frombuffer(raw, np.uint8)
    lengths, payloads, checks = [], [], []
    for at in offsets.tolist():
        n = int(data[at : at + 8].view("<u8")[0])
        if at + 16 + n > len(data):
            raise ValueError("a record is cut short")
        lengths.append(data[at : at + 8])
        payloads.append(data[at + 12 : at + 12 + n])
        checks.append((data[at + 8 : at + 12], data[at + 12 + n : at + 16 + n]))
    told = np.frombuffer(b"".join(a.tobytes() + b.tobytes() for a, b in checks), "<u4").reshape(-1, 2)
    if (told[:, 0] != masked(crc32c(lengths))).any() or (told[:, 1] != masked(crc32c(payloads))).any():
        raise ValueError("a checksum differs")
    return payloads


def payload(doc_id: int | None, ids: np.ndarray, width: int) -> np.ndarray:
    head = np.array([doc_id or 0], "<i8").tobytes() + np.array([width + NULL_ID * (doc_id is None)], "<u4").tobytes()
    return np.frombuffer(head + ids.astype(f"<u{width}").tobytes(), np.uint8)


def parse(record: np.ndarray) -> tuple[int | None, np.ndarray]:
    flags = int(record[8:12].view("<u4")[0])
    doc_id = None if flags & NULL_ID else int(record[:8].view("<i8")[0])
    return doc_id, record[12:].view(f"<u{flags & 255}").astype("<u4")


def read_records(files: pafs.FileSystem, path: str, order: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a shard, in file order with bounded reads, or by record numbers in the order given."""
    with files.open_input_file(path + ".idx") as f:
        offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
    with files.open_input_file(path) as f:
        ends = np.append(offsets[1:], f.size())
        if order is not None:
            for k in order:
                raw = f.read_at(int(ends[k] - offsets[k]), int(offsets[k]))
                yield parse(unframe(raw, np.zeros(1, np.int64))[0])
            return
        at = 0
        while at < len(offsets):
            end = max(at + 1, int(np.searchsorted(ends, offsets[at] + READ_BYTES, side="right")))
            raw = f.read_at(int(ends[end - 1] - offsets[at]), int(offsets[at]))
            yield from map(parse, unframe(raw, offsets[at:end] - offsets[at]))
            at = end


def _writer(folder: str, vocabulary: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = full_encoder(vocabulary)
        files, root = pafs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        name = f"{root}/part-{shard:06d}-{uuid.uuid4().hex}"  # an attempt's own; only those that the driver is told count
        at, docs, tokens, offsets = 0, 0, 0, []
        with files.open_output_stream(name) as out:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for chunk in vectext.chunks(batch.column(1)):
                    found, bounds = encoder.chunk_ids(chunk)
                    own = [np.append(found[bounds[i] : bounds[i + 1]], np.uint32(end_id)) for i in range(len(chunk))]
                    parts = [payload(ids[chunk.first + i], x, width if x.max() < 1 << 16 else 4) for i, x in enumerate(own)]
                    raw, lengths = frame(parts)
                    out.write(raw)
                    offsets.append(at + np.cumsum(lengths) - lengths)
                    at, docs, tokens = at + len(raw), docs + len(chunk), tokens + len(found) + len(chunk)
        with files.open_output_stream(name + ".idx") as out:
            out.write(np.concatenate([*offsets, np.zeros(0, np.int64)]).astype("<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "docs": [docs], "tokens": [tokens]}, pa.schema([("shard", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    return run


def _reader(folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, ids in read_records(files, name):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return run


def write_records(docs: DataFrame, vocabulary: str, end_id: int, folder: str, wide: bool = False) -> list[dict]:
    """Encode texts and write them as record shards in ascending doc_id order; the shards' names and sizes, in order.

    Rows of one doc_id stand in the order of their texts; a null doc_id comes first; a null text is the empty one.
    Ids of a record take 2 bytes, or 4 where one of them needs more or ``wide`` is set. Shards are ranges of doc_id and
    of the beginnings of texts (so that rows of one or no id are dealt too), one a task; a task that is run again writes a
    new file, and files of lost attempts are in no list. ``folder`` is a URI in a file system that all executors share.
    """
    files, root = pafs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    shards = rows.mapInArrow(_writer(folder, vocabulary, end_id, 4 if wide else 2), "shard long, name string, docs long, tokens long").collect()  # a row for each task
    out, start = [], 0
    for s in sorted(shards, key=lambda s: s["shard"]):
        out.append(s.asDict() | {"start": start})
        start += s["tokens"]
    return out


def read_back(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record of the shards, with all checksums verified."""
    told = [(s["name"], s["start"]) for s in shards if s["docs"]]
    if not told:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    listed = spark.createDataFrame(told, "name string, start long").repartition(len(told))
    return listed.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write documents (doc_id, text) as token-id records in the shared folder and read them back.

    Returns doc_id, start (ids of all documents before), n_tokens (with the end id) and ids_crc32 (of the ids as
    little-endian uint32), a row for each input row. An empty text has the end id alone; an empty table no row; other
    columns are ignored.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "records")
    return read_back(spark, folder, write_records(docs, vocabulary, end_id, folder))

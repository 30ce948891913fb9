"""MinHash near-dedup by a multi-index Hamming join.

Each text is its set of distinct word shingles (64-bit hashes). A signature has ``CHUNKS * LANES`` lanes of b = 8 bits,
each the low bits of a minimum under one hash. Lanes of two texts of similarity s differ with probability about
(1 - s) * (1 - 2**-b). With at most ``CHUNKS * 2 - 1`` differing lanes, pigeonhole leaves a chunk with at most one
differing lane, so the index holds each chunk once for each lane it leaves out: every pair within that signature
distance meets under a key. For s >= 0.8, 27 of 70 lanes are four standard deviations above the mean of 14.

Equal sets are one class from the start. Within a key's bucket, members are linked to the least of them (a star, not
all pairs) and confirmed on full sets. In a bucket whose members are then in several components, those outside the largest
are linked to another member of it, which joins much of what belongs together with work that grows
with the members. What is left is finished exactly. Small buckets compare their members by signature distance, and what
is near enough is confirmed on full sets; chance agreement of keys makes only such buckets. Large buckets make areas,
and in an area each member outside the largest component meets all others, by pairs of blocks of bounded size that give
at most as many links as they have members. Components are found by star steps over the links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import vectext
from inkwell.llm.common import keep
from inkwell.llm.components import components

CHUNKS, LANES = 14, 5
WIDTH = CHUNKS * LANES
MOST = 2 * CHUNKS - 1
TURNS = 1  # of stars about another member of the largest component
SMALL, BLOCK = 64, 1024  # members of a bucket that is compared as it is, and of a block
FEW = 1 << 20  # ids, of 8 bytes each

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 1 << 32, WIDTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, WIDTH, dtype=np.uint64).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The lanes (uint8) of a non-empty set of 64-bit hashes; long sets are taken in pieces, which bounds memory."""
    low = np.full(WIDTH, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 4096):
        np.minimum(low, (short[at : at + 4096, None] * _MUL + _ADD).min(axis=0), out=low)
    return (vectext.mix(low.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)


def shingle_sets(column: pa.Array | pa.ChunkedArray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; with fewer words, of the whole sequence."""
    for chunk in vectext.chunks(column):
        found = vectext.words(chunk, lower=True)
        runs = vectext.ngram_hash(found.hash, n)
        for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(runs[a : b - n + 1])
            elif b > a:
                yield vectext.ngram_hash(found.hash[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digest, lanes = [], [], []
            for s in shingle_sets(batch.column(1), n):
                size.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                lanes.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(lanes, pa.binary())], ["doc_id", "n_shingles", "digest", "lanes"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            lanes = _matrix(batch.column(1))
            out = []
            for c in range(CHUNKS):
                for gone in range(LANES):
                    key = np.full(len(lanes), c * LANES + gone + 1, np.uint64)
                    for k in range(LANES):
                        if k != gone:
                            key = vectext.pair_hash(key, lanes[:, c * LANES + k].astype(np.uint64))
                    out.append(key)
            ids = pa.array(np.tile(batch.column(0).to_numpy(), WIDTH))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), ids], ["key", "rep"])


def _matrix(lanes: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(lanes.to_pylist()), np.uint8).reshape(-1, WIDTH)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        far = (_matrix(batch.column("lanes_u")) != _matrix(batch.column("lanes_v"))).sum(axis=1)
        close = pa.array(far <= MOST)
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(close), batch.column("v").filter(close)], ["u", "v"])


def _set_bytes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1), n)], pa.binary())], ["id", "shingles"])

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("set_u"), batch.column("set_v")
            good = [similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), percent) for a, b in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(pa.array(good, pa.bool_())), batch.column("v").filter(pa.array(good, pa.bool_()))], ["u", "v"])

    return run


class _Forest(dict):
    def root(self, x: int) -> int:
        while (y := self.setdefault(x, x)) != x:
            self[x] = x = self.setdefault(y, y)
        return x


def _close(lanes: np.ndarray, size: np.ndarray, at: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``others`` can be similar to ``at`` by size and signature."""
    small, large = np.minimum(size[others], size[at]), np.maximum(size[others], size[at])
    others = others[100 * small >= percent * large]
    return others[(lanes[others] != lanes[at]).sum(axis=1) <= MOST]


def _within(percent: int):
    """Rows (key, id, root, n, lanes) sorted by key -> pairs (u, v) of a key's members with different roots that can be similar."""

    def pairs(ids: np.ndarray, roots: np.ndarray, size: np.ndarray, lanes: np.ndarray) -> Iterator[tuple[int, int]]:
        for x in range(len(ids) - 1):
            others = np.arange(x + 1, len(ids))
            for y in _close(lanes, size, x, others[roots[others] != roots[x]], percent).tolist():
                yield min(int(ids[x]), int(ids[y])), max(int(ids[x]), int(ids[y]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []  # the rows of the last key so far

        def out(rows: pa.Table) -> pa.RecordBatch:
            key, ids, roots, size = (rows.column(c).to_numpy() for c in ("key", "id", "root", "n"))
            lanes = _matrix(rows.column("lanes").combine_chunks())
            cut = np.flatnonzero(np.diff(key)) + 1
            found = [p for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True) for p in pairs(ids[a:b], roots[a:b], size[a:b], lanes[a:b])]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*left, batch])
            last = rows.column("key")[-1]
            done = int(pa.compute.index(rows.column("key"), last).as_py())
            if done:
                yield out(rows.slice(0, done))
            left = rows.slice(done).to_batches()
        if left:
            yield out(pa.Table.from_batches(left))

    return run


def _block_pair(percent: int):
    """New links between members outside the largest component (side 0) and all members (side 1): at most as many as rows."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, roots, side, minor = (group.column(c).to_numpy() for c in ("id", "root", "side", "minor"))
        lanes = _matrix(group.column("lanes").combine_chunks())
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in group.column("shingles").combine_chunks()]
        size = np.array([len(s) for s in sets])
        every = np.flatnonzero(side == 1)
        forest, links = _Forest(), []
        for x in np.flatnonzero(side == 0).tolist():
            # of two that are both outside, the smaller id asks
            others = every[(roots[every] != roots[x]) & (~minor[every] | (ids[every] > ids[x]))]
            for y in _close(lanes, size, x, others, percent).tolist():
                a, b = forest.root(int(roots[x])), forest.root(int(roots[y]))
                if a != b and similar(sets[x], sets[y], percent):
                    forest[a] = b
                    links.append((int(ids[x]), int(ids[y])))
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    return run


def near_dedup(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate components of documents (doc_id long, text string).

    Returns doc_id, n_shingles long, component_id long (least doc_id reachable over links, itself included), kept
    boolean (doc_id = component_id), one row for each input row. A link is 100 * intersection >= percent * union of
    the sets of distinct shingles of ``shingle_words`` words (A-Z lower-cased; with fewer words, the whole sequence).
    Null or wordless texts have the empty set and are linked with nothing. Rows that repeat a doc_id are judged by
    their texts and share the id's least component; a null doc_id has a null component and is kept, and links nothing.
    Other columns of the input are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = keep(docs.mapInArrow(_sketch(shingle_words), "doc_id long, n_shingles long, digest binary, lanes binary"))
    known = sketch.where("digest is not null and doc_id is not null")
    firsts = keep(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("lanes").alias("lanes")))
    # an id may repeat with other texts: such an id's classes are told apart by a hash of the digest
    repeated = known.select("doc_id", "digest").distinct().groupBy("doc_id").count().where("count > 1").select("doc_id")
    several = not repeated.isEmpty()
    classes = firsts.withColumn("id", F.col("rep"))
    if several:
        shared = firsts.groupBy("rep").count().where("count > 1").select("rep", F.lit(True).alias("many"))
        own = F.when(F.col("many"), F.xxhash64("digest")).otherwise(F.col("rep"))
        classes = keep(firsts.join(shared, "rep", "left").withColumn("id", own).drop("many"))
    links = _links(docs, classes, several, shingle_words, percent)
    roots = components(links)
    told = classes.join(roots.withColumnRenamed("u", "id"), "id", "left").select("digest", "id", "rep", F.coalesce("root", "id").alias("root"))
    final = told.select("digest", "root")
    if several:
        # the least doc_id of a component
        least = told.groupBy("root").agg(F.min("rep").alias("least"))
        final = told.join(least, "root").select("digest", F.col("least").alias("root"))
        # ids that repeat with several texts tie their components together
        tied = known.join(repeated, "doc_id", "left_semi").join(final, "digest")
        tie = components(tied.select(F.col("doc_id").alias("u"), F.col("root").alias("v")))
        final = final.join(tie.select(F.col("u").alias("root"), F.col("root").alias("whole")), "root", "left").select("digest", F.coalesce("whole", "root").alias("root"))
    out = sketch.join(final, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _links(docs: DataFrame, classes: DataFrame, several: bool, shingle_words: int, percent: int) -> DataFrame:
    """Confirmed links (u, v) between classes (id, rep, digest, n, lanes) of texts, enough for their components."""
    texts = docs.where("doc_id is not null")
    keys = classes.select("id", "lanes").mapInArrow(_keys, "key long, rep long")
    stars = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("members")).where("members > 1")
    bucket = keep(keys.join(stars, "key"))
    sketches = classes.select("id", "n", "lanes")
    def set_of(ids: DataFrame) -> DataFrame:
        """(id) -> (id, shingles): sets of the classes with these ids. Up to FEW ids are broadcast, more are joined."""
        ids = keep(ids)
        if ids.count() <= FEW:
            ids = F.broadcast(ids)
        easy = texts.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")
        if not several:
            return easy.mapInArrow(_set_bytes(shingle_words), "id long, shingles binary")
        # an id of several texts names none of them: their sets are told by their digests
        alone = easy.join(classes.where("id = rep").select("id"), "id", "left_semi").mapInArrow(_set_bytes(shingle_words), "id long, shingles binary")
        others = classes.where("id <> rep").select("id", F.col("rep").alias("doc_id")).join(ids, "id")
        own = texts.join(others.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_set_bytes(shingle_words), "doc_id long, shingles binary")
        own = own.join(others, "doc_id").where(F.xxhash64(_digest(F.col("shingles"))) == F.col("id")).select("id", "shingles")
        return alone.union(own.dropDuplicates(["id"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of distinct pairs (u, v) whose full sets are similar."""
        sides = [sketches.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("lanes").alias(f"lanes_{s}")) for s in "uv"]
        near = pairs.join(sides[0], "u").join(sides[1], "v").where(f"100 * least(n_u, n_v) >= {percent} * greatest(n_u, n_v)")
        near = keep(near.select("u", "v", "lanes_u", "lanes_v").mapInArrow(_near, "u long, v long"))
        sets = set_of(near.select(F.col("u").alias("id")).union(near.select(F.col("v").alias("id"))).distinct())
        both = near.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("set_u")), "u").join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("set_v")), "v")
        return keep(both.mapInArrow(_confirm(percent), "u long, v long"))

    links = confirmed(bucket.where("pivot < rep").select(F.col("pivot").alias("u"), F.col("rep").alias("v")).distinct())
    roots = components(links)
    open_ = bucket.where("members > 2")
    for turn in range(TURNS + 1):
        # buckets that are still split, with the largest component in each and one of its members; others never split again
        rows = open_.select("key", "rep", "pivot", "members").join(roots.withColumnRenamed("u", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        each = rows.groupBy("key", "root").agg(F.count("*").alias("own"), F.min_by("rep", F.xxhash64("rep", F.lit(turn))).alias("pick"))
        split = each.groupBy("key").agg(F.max_by(F.struct("root", "pick"), F.struct("own", "root")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
        open_ = keep(rows.join(split.select("key", F.col("most.root").alias("major"), F.col("most.pick").alias("pick")), "key"))
        if turn == TURNS or open_.isEmpty():
            break
        asked = open_.where("root <> major and pick <> pivot and rep <> pivot").select(F.least("rep", "pick").alias("u"), F.greatest("rep", "pick").alias("v")).distinct()
        links = links.union(confirmed(asked))
        roots = components(links)
    if open_.isEmpty():
        return links
    few = open_.where(f"members <= {SMALL}").select("key", F.col("rep").alias("id"), "root").join(sketches, "id").repartition("key").sortWithinPartitions("key", "id")
    links = links.union(confirmed(few.select("key", "id", "root", "n", "lanes").mapInArrow(_within(percent), "u long, v long").distinct()))
    many = open_.where(f"members > {SMALL}")
    return links if many.isEmpty() else links.union(_finish(many, sketches, set_of, percent))


def _digest(shingles: Column) -> Column:
    """The digest of a set by its bytes, as _sketch makes it."""
    return F.udf(lambda raw: hashlib.blake2b(bytes(raw), digest_size=16).digest(), "binary", useArrow=True)(shingles)


def _finish(open_: DataFrame, sketches: DataFrame, set_of, percent: int) -> DataFrame:
    """Links inside large buckets (key, rep, root, major) that are still split."""
    group = components(open_.select(F.col("root").alias("u"), F.col("major").alias("v")).distinct())
    members = open_.select(F.col("rep").alias("id"), "root").distinct().join(group.select(F.col("u").alias("root"), F.col("root").alias("area")), "root", "left").withColumn("area", F.coalesce("area", "root"))
    each = members.groupBy("area", "root").agg(F.count("*").alias("own"))
    sizes = each.groupBy("area").agg(F.max_by("root", F.struct("own", "root")).alias("major"), F.sum("own").alias("all"), F.max("own").alias("most"))
    blocks = lambda n: F.greatest(F.ceil(n / F.lit(BLOCK)), F.lit(1))
    sizes = sizes.select("area", "major", blocks(F.col("all") - F.col("most")).alias("rows"), blocks(F.col("all")).alias("columns"))
    members = keep(members.join(sizes, "area").withColumn("minor", F.col("root") != F.col("major")).join(sketches.select("id", "lanes"), "id"))
    full = members.join(set_of(members.select("id").distinct()), "id")
    own, other = F.pmod(F.xxhash64("id"), F.col("rows")), F.pmod(F.xxhash64("id", F.lit(1)), F.col("columns"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ("area", "i", "j", "side", "id", "root", "minor", "lanes", "shingles")
    asking = full.where("minor").withColumn("i", own).withColumn("j", upto("columns")).withColumn("side", F.lit(0)).select(*columns)
    asked = full.withColumn("j", other).withColumn("i", upto("rows")).withColumn("side", F.lit(1)).select(*columns)
    return keep(asking.union(asked).groupBy("area", "i", "j").applyInArrow(_block_pair(percent), "u long, v long"))

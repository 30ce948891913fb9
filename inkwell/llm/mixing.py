"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target over its size is the mean number of copies of its documents. Whole copies are certain. The rest is a
sample of unequal probability: documents are ranked by random odds divided by inclusion odds, and taken in this order
up to the words that are missing, so the size of the sample is fixed in words. Inclusion goes with the square root of
the document's size: larger documents come earlier, so the last one taken is small. What then is still missing is
filled, FILLS times at most, with the document whose size comes nearest.

No source is sorted in one task: ranks are cut into bins, sizes are summed by bin, and only the bin in which the sample
ends is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import WORD, keep, salted_lookup

BINS = 4096
MOST_COPIES = 3
FILLS = 3


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with weight and target: 1, 2, 3, repeating, of the whole, at most 3 times the size.

    Sources are ranked by code point, null last. Ordered by the level at which each is full, the full ones come first;
    the level of the others is what they leave over the weight they leave. The windows run over one row a source.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    full = (MOST_COPIES * F.col("source_size")).alias("full")
    ranked = ranked.select("*", full, F.sum("source_size").over(everything).alias("total"), F.sum("weight").over(everything).alias("weights"))
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("full").over(before), F.lit(0))
    left_weight = F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = ranked.select("source", "source_size", "weight", "full", left.alias("left"), left_weight.alias("left_weight"), F.row_number().over(order).alias("place"))
    open_ = F.col("full") * F.col("left_weight") >= F.col("left") * F.col("weight")
    level = F.min(F.when(open_, F.struct("place", (F.col("left") / F.col("left_weight")).alias("level")))).over(everything)["level"]
    return ranked.select("source", "source_size", "weight", F.coalesce(F.least(F.col("full").cast("double"), level * F.col("weight")), F.lit(0.0)).alias("target"))


def _rank(seed: int) -> Column:
    """Random odds over inclusion odds; 0 where inclusion is certain."""
    draw = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 50)) + F.lit(0.5)) / F.lit(float(1 << 50))
    chance = F.col("missing") * F.sqrt("size") / F.col("spread")
    return F.when(chance >= 1, F.lit(0.0)).otherwise(draw / (1 - draw) * (1 - chance) / chance)


def _fill(picked: DataFrame) -> DataFrame:
    """Take one more document of each source, that whose size comes nearest to the missing words, if this helps."""
    taken = F.sum(F.when(F.col("more"), F.col("size")).otherwise(0))
    gaps = picked.where("missing > 0").groupBy("source").agg((F.max("missing") - taken).alias("gap"))
    spare = salted_lookup(picked.where("rank is not null and not more").select("source", "row", "doc_id", "rank", "size"), gaps, "source", "row")
    off = F.abs(F.col("size") - F.col("gap"))
    best = spare.where(off < F.col("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "rank", "doc_id", "row")).alias("best"))
    out = salted_lookup(picked, best.select("source", F.col("best.row").alias("fill")), "source", "row")
    return keep(out.withColumn("more", F.col("more") | F.coalesce(F.col("row") == F.col("fill"), F.lit(False))).drop("fill"))


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """Copies of documents (doc_id, text, source) for the mix, one row for each input row.

    Returns doc_id, source, size (words of the text, null: 0), source_size, weight, target (of its source), copies int
    (0 to 3) and taken (size * copies). A source's taken words differ from its target by less than the size of one
    document. Null sources are one source. Rows without words are taken 0 times; rows that repeat a doc_id draw alike
    but are counted each. The draw depends on doc_id and ``seed`` alone. Other columns are ignored; an empty table
    gives an empty result.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.monotonically_increasing_id().alias("row")))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.pow("size", F.lit(1.5))).alias("spread"))
    goal = targets(sums.select("source", "source_size"))
    sources = goal.join(sums.select(F.col("source").alias("s"), "spread"), goal["source"].eqNullSafe(F.col("s"))).drop("s")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = keep(sources.withColumn("whole", whole).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size")))

    ranked = salted_lookup(rows, sources, "source", "row")
    takes_part = (F.col("size") > 0) & (F.col("missing") > 0)
    ranked = ranked.withColumn("rank", F.when(takes_part, _rank(seed)))
    ranked = keep(ranked.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int")))
    bins = ranked.where("bin is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("missing").alias("missing"))
    so_far = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    bins = bins.withColumn("need", F.col("missing") - (so_far - F.col("words"))).where("need >= 0")
    last = keep(bins.groupBy("source").agg(F.max("bin").alias("last"), F.min("need").alias("need")))

    ranked = salted_lookup(ranked, last, "source", "row")
    inside = ranked.where("bin = last").withColumn("words", F.sum("size").over(Window.partitionBy("source", "bin").orderBy("rank", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)))
    rest = ranked.where("bin is null or bin <> last").withColumn("words", F.lit(None).cast("long"))
    chosen = F.coalesce(F.col("bin") < F.col("last"), F.lit(False)) | F.coalesce(F.col("words") <= F.col("need"), F.lit(False))
    picked = keep(inside.unionByName(rest).withColumn("more", chosen))
    for _ in range(FILLS):
        picked = _fill(picked)
    copies = F.col("whole") + F.col("more").cast("int")
    copies = F.when(F.col("size") > 0, copies).otherwise(0)
    return picked.select("doc_id", "source", "size", "source_size", "weight", "target", copies.cast("int").alias("copies"), (F.col("size") * copies).alias("taken"))

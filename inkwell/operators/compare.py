"""Comparisons of groups and of models: effect sizes, rank tests, dispersion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import stats
from inkwell.functions.session import kept


def long_metrics(rows: DataFrame, metrics: tuple[str, ...], *keys: str) -> DataFrame:
    """One row for each document and defined metric: (keys, metric, value)."""
    return rows.unpivot([*keys], list(metrics), "metric", "value").where("value is not null")


def moments(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.var_samp("value").alias("var"))


def group_effects(rows: DataFrame, group: str) -> DataFrame:
    """Per metric: n, mean, sd of both groups (``group`` true and false) and Cohen's d."""
    f = lambda fn, side: fn(F.when(F.col(group) == side, F.col("value")))
    sides = rows.groupBy("metric").agg(*(f(fn, side).alias(f"{name}{k}") for k, side in ((1, F.lit(True)), (0, F.lit(False))) for name, fn in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp), ("var", F.var_samp))))
    return sides.withColumn("cohens_d", stats.cohens_d(*(F.col(c) for c in ("n1", "mean1", "var1", "n0", "mean0", "var0")))).drop("var1", "var0")


def effect_ci(rows: DataFrame, metrics: tuple[str, ...], group: str, repetitions: int, seed: int) -> DataFrame:
    """Percentile interval of Cohen's d per metric, documents (doc_id, group, metrics) weighted Poisson(1) by hash.

    A task makes the weights of its documents once for all metrics and gives its sums for each repetition, so what is
    shuffled doesn't grow with the documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, repetitions, 3 * len(metrics)))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                weight = stats.poisson_weights(seed, repetitions, part.column(0).to_pylist())
                value = np.column_stack([part.column(m).to_numpy(zero_copy_only=False).astype(float) for m in metrics])
                known = ~np.isnan(value)
                value = np.where(known, value, 0.0)
                side = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                for k, own in enumerate((~side, side)):
                    sums[k] += weight[:, own] @ np.concatenate([known, value, value * value], axis=1)[own]
        if sums[:, :, : len(metrics)].any():
            for i, metric in enumerate(metrics):
                cells = {f"{n}{k}": sums[k, :, j * len(metrics) + i] for k in (1, 0) for j, n in enumerate("nsq")}
                yield pa.RecordBatch.from_pydict({"metric": [metric] * repetitions, "rep": np.arange(repetitions, dtype=np.int32), **cells})

    names = ("n1", "s1", "q1", "n0", "s0", "q0")
    drawn = rows.where(F.col(group).isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), group, *metrics).mapInArrow(run, "metric string, rep int, " + ", ".join(f"{n} double" for n in names))
    sums = drawn.groupBy("metric", "rep").agg(*(F.sum(n).alias(n) for n in names))
    m = lambda k: F.col(f"s{k}") / F.nullif(F.col(f"n{k}"), F.lit(0.0))
    var = lambda k: F.greatest(F.col(f"q{k}") - F.col(f"n{k}") * m(k) * m(k), F.lit(0.0)) / F.nullif(F.col(f"n{k}") - 1, F.lit(0.0))
    each = sums.select("metric", stats.cohens_d(F.col("n1"), m(1), var(1), F.col("n0"), m(0), var(0)).alias("d"))
    return each.groupBy("metric").agg(F.percentile("d", F.lit(0.025)).alias("d_ci_lo"), F.percentile("d", F.lit(0.975)).alias("d_ci_hi"))


BINS = 64  # of the values of a rank test, each ranked in its own task


def mann_whitney(rows: DataFrame, group: str, *keys: str) -> DataFrame:
    """Per key: n1, n0, U of the true group, two-sided p (asymptotic, ties and continuity corrected), rank-biserial.

    Ranks are sums over distinct values with their counts, so ties are aggregated first. Values are cut into BINS ranges;
    a value's rank is the number of rows in lower ranges and of lower rows in its own, so no task ranks a whole key.
    """
    counts = rows.groupBy(*keys, "value").agg(F.count_if(F.col(group)).alias("t1"), F.count("*").alias("t"))
    cuts = kept(counts.groupBy(*keys).agg(F.percentile_approx("value", F.array(*(F.lit(i / BINS) for i in range(1, BINS))), F.lit(1000)).alias("cuts")))
    cuts.count()  # made once: approximate percentiles follow the order of merging, and all steps must share their ranges
    cut = counts.join(cuts, [*keys]).withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    lower = cut.groupBy(*keys, "bin").agg(F.sum("t").alias("own")).withColumn("lower", F.sum("own").over(Window.partitionBy(*keys).orderBy("bin")) - F.col("own")).drop("own")
    below = F.sum("t").over(Window.partitionBy(*keys, "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = cut.withColumn("below", below).join(lower, [*keys, "bin"]).withColumn("rank", F.col("lower") + F.col("below") - F.col("t") + (F.col("t") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum("t1").alias("n1"), F.sum(F.col("t") - F.col("t1")).alias("n0"), F.sum(F.col("rank") * F.col("t1")).alias("r1"), F.sum((F.pow("t", F.lit(3)) - F.col("t"))).alias("ties"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.greatest(F.abs(u - n1 * n0 / 2) - 0.5, F.lit(0.0)) / F.nullif(sigma, F.lit(0.0))
    p = F.coalesce(stats.erfc(z / F.sqrt(F.lit(2.0))), F.lit(1.0))
    out = sums.where((F.col("n1") > 0) & (F.col("n0") > 0))
    return out.select(*keys, "n1", "n0", u.alias("u"), p.alias("p_value"), (2 * u / (n1 * n0) - 1).alias("rank_biserial"))


def model_effects(models: DataFrame, human: DataFrame) -> DataFrame:
    """(metric, model) moments with Cohen's d against the human documents; a model without documents has no row."""
    base = moments(human, "metric").select("metric", *(F.col(c).alias(f"h_{c}") for c in ("n", "mean", "var")))
    joined = moments(models, "metric", "model").join(base, "metric")
    d = stats.cohens_d(*(F.col(c) for c in ("n", "mean", "var", "h_n", "h_mean", "h_var")))
    return joined.select("metric", "model", "n", "mean", "sd", d.alias("cohens_d_vs_human"))


def dispersion(models: DataFrame) -> DataFrame:
    """Per metric: SD of model means, mean of model SDs, their ratio, least and greatest mean; models of one row are out."""
    each = moments(models, "metric", "model").where("n >= 2")
    out = each.groupBy("metric").agg(F.stddev_samp("mean").alias("between_sd"), F.avg("sd").alias("within_sd"), F.min("mean").alias("min_mean"), F.max("mean").alias("max_mean"))
    return out.withColumn("ratio", F.col("between_sd") / F.nullif(F.col("within_sd"), F.lit(0.0)))


def ratio(models: DataFrame, *keys: str) -> DataFrame:
    """Between/within ratio by keys of (keys, model, value); null if a model has no SD or the mean SD is 0."""
    each = moments(models, *keys, "model").groupBy(*keys).agg(F.stddev_samp("mean").alias("b"), F.avg("sd").alias("w"), F.count("sd").alias("k"), F.count("*").alias("m"))
    return each.select(*keys, F.when((F.col("k") == F.col("m")) & (F.col("w") > 0), F.col("b") / F.col("w")).alias("ratio"))


MOST_MODELS = 1000
PARTS = 96  # tasks over numbers of documents: few bytes, much work


def model_sizes(models: DataFrame) -> dict[str, int]:
    """Documents of each model, by name; models are few, which is checked."""
    rows = models.groupBy("model").count().where("model is not null").orderBy("model").limit(MOST_MODELS + 1).collect()
    if len(rows) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    return {r["model"]: r["count"] for r in rows}


def word_ratio(rows: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(word, docs, ratio) of binary words from their counts: rows (word, model); a model without the word counts 0."""
    return ratio_of_counts(word_counts(rows, list(sizes)), sizes)


def word_counts(rows: DataFrame, models: list[str]) -> DataFrame:
    """(word, found): documents with a word by model, in the order of ``models``."""
    return rows.groupBy("word").agg(F.array(*(F.count_if(F.col("model") == m) for m in models)).alias("found"))


def ratio_of_counts(counts: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """word_ratio from word_counts of the same models; words of none of their documents are left out."""
    found = counts.withColumn("docs", F.aggregate("found", F.lit(0).cast("long"), lambda t, x: t + x)).where("docs > 0")
    k = F.array(*(F.struct(F.get("found", F.lit(i)).cast("double").alias("k"), F.lit(float(n)).alias("n")) for i, n in enumerate(sizes.values())))
    means = F.transform(k, lambda x: x["k"] / x["n"])
    sds = F.transform(k, lambda x: F.when(x["n"] > 1, F.sqrt(x["k"] / x["n"] * (1 - x["k"] / x["n"]) * x["n"] / (x["n"] - 1))))
    m = float(len(sizes))
    average = lambda v: F.aggregate(v, F.lit(0.0), lambda t, x: t + x) / m
    spread = found.select("word", "docs", means.alias("means"), sds.alias("sds")).withColumn("mean", average(F.col("means"))).withColumn("w", average(F.col("sds")))
    between = F.sqrt(F.aggregate("means", F.lit(0.0), lambda t, x: t + (x - F.col("mean")) * (x - F.col("mean"))) / F.nullif(F.lit(m - 1), F.lit(0.0)))
    return spread.select("word", "docs", F.when(F.col("w") > 0, between / F.col("w")).alias("ratio"))


def shuffled_labels(rows: DataFrame, repetitions: int, seed: int) -> DataFrame:
    """Rows (doc_id, model, ...) in each repetition (rep), with the models dealt anew, group sizes unchanged.

    In a repetition the documents, in the order of a hash, are dealt to the models one after another. Hashes are cut into
    bins; only where a model's share ends inside a bin are rows ordered, by bin. All others get their model where they
    stand, so nothing but those bins is shuffled.
    """
    sizes = model_sizes(rows)
    total = sum(sizes.values())
    bins = 1 << max(min((total // 32).bit_length(), 16), 2)
    key = stats.hash_index(F.lit(str(seed)), F.col("rep").cast("string"), F.col("doc_id").cast("string"))
    rest = [c for c in rows.columns if c != "model"]
    dealt = rows.where("model is not null").select(*rest, F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("rep")).withColumn("key", key).withColumn("bin", F.floor(F.col("key") * bins / float(1 << 32)))
    upto = F.sum("n").over(Window.partitionBy("rep").orderBy("bin"))
    filled = dealt.groupBy("rep", "bin").agg(F.count("*").alias("n")).withColumn("upto", upto)
    ends = np.cumsum(list(sizes.values()))[:-1].tolist()
    # for each model but the last, the bin where its share ends and how many rows of that bin belong before the end
    inside = lambda end: F.when((F.col("upto") > end) & (F.col("upto") - F.col("n") <= end), F.struct("bin", (F.lit(end) - F.col("upto") + F.col("n")).alias("need")))
    bounds = filled.groupBy("rep").agg(F.array(*(F.max(inside(e)) for e in ends)).cast("array<struct<bin:bigint,need:bigint>>").alias("bounds"))
    marked = dealt.join(F.broadcast(bounds), "rep")  # a row for each repetition
    edge = F.exists("bounds", lambda b: b["bin"] == F.col("bin"))
    names = F.array(*map(F.lit, sizes))
    plain = marked.where(~edge).withColumn("model", F.get(names, F.size(F.filter("bounds", lambda b: b["bin"] < F.col("bin")))))
    place = F.row_number().over(Window.partitionBy("rep", "bin").orderBy("key", "doc_id"))
    torn = marked.where(edge).withColumn("place", place)
    torn = torn.withColumn("model", F.get(names, F.size(F.filter("bounds", lambda b: (b["bin"] < F.col("bin")) | ((b["bin"] == F.col("bin")) & (b["need"] < F.col("place")))))))
    columns = [*rest, "rep", "model"]
    return plain.select(columns).unionByName(torn.select(columns))


EDGE_BITS = 8  # of a hash: bins in which the ends of the models' shares are looked for
CHUNK = 512  # documents hashed at once


def _hashed(batches: Iterator[pa.RecordBatch], repetitions: int, seed: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of batches, whose first column is the document's name, with its hashes (repetitions x documents)."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            yield part, stats.hash_indices(seed, repetitions, part.column(0).to_pylist())


def _share_ends(rows: DataFrame, sizes: dict[str, int], repetitions: int, seed: int) -> tuple[np.ndarray, list[list]]:
    """Hash and doc_id of the first document past each model's share but the last, by repetition (repetitions x ends).

    Counts of hashes in bins, summed in the tasks, tell the bins in which shares end; only documents in these are ordered.
    """
    bins, ends = 1 << EDGE_BITS, np.cumsum(list(sizes.values()))[:-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(repetitions * bins, np.int64)
        row = np.arange(repetitions, dtype=np.int64)[:, None] * bins
        for _, index in _hashed(batches, repetitions, seed):
            total += np.bincount((row + (index >> np.uint32(32 - EDGE_BITS))).ravel(), minlength=len(total))
        if total.any():
            total = total.reshape(repetitions, bins)
            yield pa.RecordBatch.from_pydict({"rep": np.arange(repetitions, dtype=np.int32), "n": pa.array(list(total), pa.list_(pa.int64()))})

    named = rows.select(F.col("doc_id").cast("string").alias("_name"), "doc_id")
    counts = named.select("_name").mapInArrow(count, "rep int, n array<long>").select("rep", F.posexplode("n").alias("bin", "n")).groupBy("rep", "bin").agg(F.sum("n").alias("n"))
    whole = counts.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("n"))  # a row for each repetition, an entry for each bin
    upto = np.zeros((repetitions, bins), np.int64)
    for r in whole.collect():
        upto[r["rep"], [x["bin"] for x in r["n"]]] = [x["n"] for x in r["n"]]
    upto = upto.cumsum(axis=1)
    edge = np.stack([(upto <= end).sum(axis=1) for end in ends], axis=1)
    need = ends - np.where(edge > 0, np.take_along_axis(upto, np.maximum(edge - 1, 0), axis=1), 0)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, index in _hashed(batches, repetitions, seed):
            own = index >> np.uint32(32 - EDGE_BITS)
            inside = np.zeros(index.shape, bool)
            for e in range(len(ends)):
                inside |= own == edge[:, e, None]
            rep, at = np.nonzero(inside)
            yield pa.RecordBatch.from_pydict({"rep": rep.astype(np.int32), "bin": own[rep, at].astype(np.int32), "key": index[rep, at].astype(np.int64), "doc_id": part.column(1).take(pa.array(at))})

    kind = rows.schema["doc_id"].dataType.simpleString()
    held = named.mapInArrow(pick, f"rep int, bin int, key long, doc_id {kind}")
    asked = rows.sparkSession.createDataFrame([(r, e, int(edge[r, e]), int(need[r, e]) + 1) for r in range(repetitions) for e in range(len(ends))], "rep int, e int, bin int, place int")
    placed = held.withColumn("place", F.row_number().over(Window.partitionBy("rep", "bin").orderBy("key", "doc_id")))
    keys, names = np.zeros(edge.shape, np.int64), [[None] * len(ends) for _ in range(repetitions)]
    for r in placed.join(F.broadcast(asked), ["rep", "bin", "place"]).select("rep", "e", "key", "doc_id").collect():  # a row for each repetition and end
        keys[r["rep"], r["e"]], names[r["rep"]][r["e"]] = r["key"], r["doc_id"]
    return keys, names


def shuffled_ratios(rows: DataFrame, metrics: tuple[str, ...], repetitions: int, seed: int) -> DataFrame:
    """(metric, rep, ratio) under shuffled models, rows (doc_id, model, metrics): models are dealt as in shuffled_labels.

    A document's model follows from its hash and the hashes at which shares end, so a task deals its documents in all
    repetitions where they stand and gives the sums of each model: what is shuffled doesn't grow with the documents, but
    for those in bins where a share ends.
    """
    sizes = model_sizes(rows)
    rows, width = rows.where("model is not null").select("doc_id", *metrics), len(metrics)
    keys, names = _share_ends(rows, sizes, repetitions, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(sizes), repetitions, 3 * width))
        for part, index in _hashed(batches, repetitions, seed):
            value = np.column_stack([part.column(m).to_numpy(zero_copy_only=False).astype(float) for m in metrics])
            known = ~np.isnan(value)
            value = np.where(known, value, 0.0)
            cells = np.concatenate([known, value, value * value], axis=1)
            own = part.column(1).to_pylist()
            model = np.zeros(index.shape, np.int16)
            for e in range(len(sizes) - 1):
                past = index > keys[:, e, None]
                for rep, at in zip(*np.nonzero(index == keys[:, e, None]), strict=True):
                    past[rep, at] = own[at] >= names[rep][e]
                model += past
            for m in range(len(sizes)):
                sums[m] += (model == m).astype(float) @ cells
        for m in range(len(sizes)):
            if sums[m].any():
                yield pa.RecordBatch.from_pydict({"rep": np.arange(repetitions, dtype=np.int32), "model": np.full(repetitions, m, np.int32), **{f"{k}_{i}": sums[m][:, j * width + i] for j, k in enumerate("nsq") for i in range(width)}})

    columns = [f"{k}_{i}" for k in "nsq" for i in range(width)]
    dealt = rows.select(F.col("doc_id").cast("string").alias("_name"), "doc_id", *metrics).mapInArrow(run, "rep int, model int, " + ", ".join(f"{c} double" for c in columns))
    each = dealt.groupBy("rep", "model").agg(*(F.sum(c).alias(c) for c in columns))
    long = each.select("rep", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), *(F.col(f"{k}_{i}").alias(k) for k in "nsq")) for i, m in enumerate(metrics)))).alias("x")).select("rep", "x.*").where("n > 0")
    spread = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    sd = F.when(F.col("n") > 1, F.sqrt(F.when(spread > 1e-13 * F.col("q"), spread).otherwise(0.0) / (F.col("n") - 1)))  # below: rounding of equal values
    moment = long.select("metric", "rep", (F.col("s") / F.col("n")).alias("mean"), sd.alias("sd"))
    out = moment.groupBy("metric", "rep").agg(F.stddev_samp("mean").alias("b"), F.avg("sd").alias("w"), F.count("sd").alias("k"), F.count("*").alias("m"))
    return out.select("metric", "rep", F.when((F.col("k") == F.col("m")) & (F.col("w") > 0), F.col("b") / F.col("w")).alias("ratio"))


def word_permutation(ratios: DataFrame, sizes: dict[str, int], repetitions: int, seed: int) -> DataFrame:
    """Adds perm_p and perm_z to words (word, docs, ratio): the models' labels shuffled among the documents.

    Of the ``docs`` documents with a word, a shuffle gives the models multivariate hypergeometric numbers. So the null
    ratios depend on ``docs`` alone and are made once for each distinct value of it.
    """
    n = np.array(list(sizes.values()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pairs in batches:
            out = []
            for docs, group in pairs.groupby("docs", sort=False):
                rng = np.random.default_rng([seed, int(docs)])
                mean = rng.multivariate_hypergeometric(n, int(docs), repetitions) / n
                within = np.sqrt(mean * (1 - mean) * n / np.maximum(n - 1, 1)).mean(axis=1)
                null = mean.std(axis=1, ddof=1)[within > 0] / within[within > 0]
                sd = null.std(ddof=1) if len(null) > 1 else 0.0
                over = [(null >= r * (1 - 1e-9)).sum() for r in group["ratio"]]
                z = (group["ratio"] - null.mean()) / sd if sd > 0 else np.nan
                out.append(group.assign(perm_p=(np.array(over) + 1) / (repetitions + 1), perm_z=z))
            yield pd.concat(out) if out else pd.DataFrame({"docs": [], "ratio": [], "perm_p": [], "perm_z": []})

    distinct = ratios.where("ratio is not null").select("docs", "ratio").distinct().repartition(PARTS, "docs").sortWithinPartitions("docs")
    told = distinct.mapInPandas(run, "docs long, ratio double, perm_p double, perm_z double").withColumn("perm_z", F.nullif(F.col("perm_z"), F.lit(float("nan"))))
    return ratios.join(told, ["docs", "ratio"], "left").select("word", "docs", "ratio", "perm_p", "perm_z")


def permutation(observed: DataFrame, null: DataFrame, key: str) -> DataFrame:
    """One-sided p (1 added) and z of observed ratios against null ratios (key, rep, ratio); null where none is observed."""
    joined = observed.withColumnRenamed("ratio", "observed").join(null, key)
    out = joined.groupBy(key, "observed").agg(F.count_if(F.col("ratio") >= F.col("observed")).alias("over"), F.count("*").alias("reps"), F.avg("ratio").alias("m"), F.stddev_samp("ratio").alias("s"))
    p = F.when(F.col("observed").isNotNull(), (F.col("over") + 1) / (F.col("reps") + 1))
    return out.select(key, F.col("observed").alias("ratio"), p.alias("perm_p"), ((F.col("observed") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))).alias("perm_z"))


def outlier_flag(rows: DataFrame, reference: Column, suspect: Column, metrics: tuple[str, ...], quantile: float = 0.99) -> DataFrame:
    """Adds ``degenerate``: suspects with any metric above the reference rows' quantile."""
    limits = rows.where(reference).agg(*(F.percentile(m, F.lit(quantile)).alias(m) for m in metrics)).first()
    over = F.lit(False)
    for m in metrics:
        if limits[m] is not None:
            over = over | F.coalesce(F.col(m) > limits[m], F.lit(False))
    return rows.withColumn("degenerate", suspect & over)

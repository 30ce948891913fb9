"""Excess vocabulary: document frequencies of words in two classes and their tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import stats, text
from inkwell.functions.session import kept
from inkwell.profiles import ALPHA, LATIN, Profile


PARTS = 96  # tasks over pairs of counts: few bytes, much work


def doc_words(docs: DataFrame, profile: Profile = LATIN, analyse: text.Analyser | None = None) -> DataFrame:
    """The columns of docs but text, with n_tokens (repeats counted) and the sorted distinct words.

    A profile that needs an analyser counts the lemmas of content words among its tokens. Columns named n_tokens or words
    give way. A null text has no words (n_tokens 0).
    """
    others = [c for c in docs.columns if c not in ("text", "n_tokens", "words")]
    if analyse is not None:
        clean = F.coalesce(text.clean_lexical(F.col("text")), F.lit(""))
        tokens = text.content_words(F.get(text.analysed(F.array(clean), analyse), F.lit(0)))
    elif profile.analysed:
        raise ValueError(f"profile {profile.name} needs an analyser")
    else:
        tokens = text.words(F.coalesce(text.without_noise(F.col("text")), F.lit("")), profile)  # no token has white space
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in others), F.lit(0).alias("")).alias("row"), tokens.alias("tokens"))
    return held.select(*(F.col(f"row.`{c}`") for c in others), F.size("tokens").alias("n_tokens"), F.sort_array(F.array_distinct("tokens")).alias("words"))


def incidence(words: DataFrame, *keys: str) -> DataFrame:
    """One row for each document and word: words are distinct within a document before anything is shuffled.

    A plain explode would be filtered by the size of its array, for which the words would be made a second time.
    """
    return words.select("doc_id", *keys, F.explode_outer("words").alias("word")).where("word is not null")


def class_sizes(words: DataFrame, label: Column) -> tuple[int, int]:
    row = words.agg(F.count_if(label).alias("a"), F.count_if(~label).alias("b")).first()
    return row["a"], row["b"]


def doc_frequency(rows: DataFrame, label: Column) -> DataFrame:
    """word, a (documents of the class), c (of the others)."""
    return rows.groupBy("word").agg(F.count_if(label).alias("a"), F.count_if(~label).alias("c"))


def excess(words: DataFrame, label: str, least: int = 5) -> DataFrame:
    """Ratio, gap, chi-square, p, q and Bonferroni of each word in at least ``least`` documents; ``label`` is boolean.

    Words with the same pair of counts have the same statistics, so tests are made once for a pair of counts.
    """
    n1, n0 = class_sizes(words, F.col(label))
    counts = kept(doc_frequency(incidence(words, label), F.col(label)).where(F.col("a") + F.col("c") >= least))
    tests = counts.groupBy("a", "c").agg(F.count("*").alias("number"))
    tests = tests.withColumn("chi2", stats.yates(F.col("a"), F.col("c"), n1, n0)).withColumn("p_value", stats.chi_square_p(F.col("chi2")))
    tests = stats.benjamini_hochberg(tests)
    p, q = stats.smoothed(F.col("a"), n1), stats.smoothed(F.col("c"), n0)
    tests = tests.select("a", "c", p.alias("p"), q.alias("q"), (p / q).alias("ratio"), (p - q).alias("delta"), "chi2", "p_value", "q_fdr", F.least(F.lit(1.0), F.col("p_value") * F.col("tests_total")).alias("p_bonferroni"))
    out = counts.join(tests, ["a", "c"])
    direction = F.when(F.col("ratio") > 1, "excess").when(F.col("ratio") < 1, "deficit").otherwise("equal")
    return out.withColumn("direction", direction).withColumn("sig_fdr", F.col("q_fdr") < ALPHA).withColumn("sig_bonferroni", F.col("p_bonferroni") < ALPHA)


def bootstrap_ci(counts: DataFrame, n1: int, n0: int, repetitions: int, seed: int) -> DataFrame:
    """Adds 2.5 and 97.5 percentiles of ratio and gap to words (word, a, c), documents of both classes drawn anew.

    Of n documents drawn with replacement, those with a word that a of n hold are binomial (n, a / n). So a word's interval
    depends on its two counts alone, and is made once for each distinct pair of counts: the work does not grow with the
    documents. An empty class gives nulls.
    """
    names = ["r_ci_low", "r_ci_high", "delta_ci_low", "delta_ci_high"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pairs in batches:
            ends = np.full((len(pairs), 4), np.nan)
            for i, (a, c) in enumerate(zip(pairs["a"], pairs["c"], strict=True)):
                rng = np.random.default_rng([seed, int(a), int(c)])
                p = (rng.binomial(n1, a / n1, repetitions) + 1) / (n1 + 1)
                q = (rng.binomial(n0, c / n0, repetitions) + 1) / (n0 + 1)
                ends[i] = [*np.percentile(p / q, [2.5, 97.5]), *np.percentile(p - q, [2.5, 97.5])]
            yield pd.concat([pairs, pd.DataFrame(ends, columns=names, index=pairs.index)], axis=1)

    pairs = counts.select("a", "c").distinct().repartition(PARTS, "a", "c")
    if n1 and n0:
        return counts.join(pairs.mapInPandas(run, "a long, c long, " + ", ".join(f"{n} double" for n in names)), ["a", "c"])
    return counts.select("*", *(F.lit(None).cast("double").alias(n) for n in names))


def excludes_one() -> Column:
    """Whether a word's interval of the ratio lies on one side of 1."""
    return (F.col("r_ci_low") > 1) | (F.col("r_ci_high") < 1)


def survival(tested: DataFrame, prior: DataFrame) -> DataFrame:
    """One row of counters: prior findings (word, old_excess_score, old_sig) that document-level tests confirm.

    With a column excludes_one (of bootstrap_ci) among ``tested``, intervals and all three criteria are counted as well.
    """
    old_direction = F.when(F.col("old_excess_score") > 0, "excess").otherwise("deficit")
    joined = tested.join(prior, "word").withColumn("old_direction", old_direction).withColumn("same", F.col("direction") == F.col("old_direction"))
    n = lambda condition, name: F.count_if(condition).alias(name)
    old, same, rose = F.col("old_sig"), F.col("same"), F.col("old_direction") == "excess"
    lives = old & F.col("sig_fdr") & same
    counters = [
        F.count("*").alias("tested"), n(old, "old_significant"), n(old & rose, "old_excess"), n(old & ~rose, "old_deficit"), n("sig_fdr", "fdr"), n("sig_bonferroni", "bonferroni"),
        n(lives, "survives_fdr"), n(lives & rose, "survives_fdr_excess"), n(lives & ~rose, "survives_fdr_deficit"), n(old & F.col("sig_bonferroni") & same, "survives_bonferroni"),
        n(old & ~same, "direction_changed"), n(~old & F.col("sig_fdr"), "newly_significant"), n(~old & F.col("sig_fdr") & same, "newly_significant_same_direction"),
    ]
    if "excludes_one" in tested.columns:
        counters += [n(old & F.col("excludes_one") & same, "survives_ci"), n(lives & F.col("sig_bonferroni") & F.col("excludes_one"), "survives_all")]
    return joined.agg(*counters)


def missing_words(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Documents without a word set: empty if none was lost."""
    return docs.join(words.where(F.size("words") > 0), "doc_id", "left_anti").select("doc_id")

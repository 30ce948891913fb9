"""A Markdown report of the small result tables: groups, models, dispersion. The driver formats what it collects."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DASH = "—"


def number(value: Column, places: int = 3) -> Column:
    """A value with so many decimal places; null, NaN and infinite are a dash."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.format_string(f"%.{places}f", value.cast("double"))).otherwise(DASH)


def written(value: float | None, places: int = 3, sign: bool = False) -> str:
    """The same on the driver."""
    if value is None or not math.isfinite(value):
        return DASH
    return f"{value:{'+' if sign else ''}.{places}f}"


def strongest(effects: DataFrame, k: int | None = None, by: str = "cohens_d") -> DataFrame:
    """Effects by falling size whatever their sign, the first ``k`` of them if given; undefined ones come last."""
    ordered = effects.orderBy(F.abs(F.col(by)).desc_nulls_last(), "metric")
    return ordered if k is None else ordered.limit(k)


def by_model(models: DataFrame, order: list[str]) -> DataFrame:
    """metric, and for each model of ``order`` its mean, SD and effect as text; a model without documents has a dash."""
    cell = F.concat(number(F.col("mean")), F.lit(" ± "), number(F.col("sd"), 2), F.lit(" (d = "), F.when(F.col("cohens_d_vs_human").isNotNull(), F.format_string("%+.1f", F.col("cohens_d_vs_human"))).otherwise(DASH), F.lit(")"))
    wide = models.withColumn("cell", cell).groupBy("metric").pivot("model", order).agg(F.first("cell"))
    return wide.select("metric", *(F.coalesce(F.col(f"`{m}`"), F.lit(DASH)).alias(m) for m in order))


def _table(header: list[str], rows: list[list[str]]) -> list[str]:
    return ["| " + " | ".join(header) + " |", "|" + " - |" * len(header), *("| " + " | ".join(r) + " |" for r in rows), ""]


def report(effects: DataFrame, models: DataFrame, dispersion: DataFrame, order: list[str]) -> str:
    """Three tables: groups by falling effect, metrics by models, and dispersion by rising ratio.

    ``effects`` has metric, mean1, sd1, mean0, sd0, cohens_d, d_ci_lo, d_ci_hi and p_holm; all tables have a row for each
    metric.
    """
    w = written
    groups = [[r["metric"], f"{w(r['mean0'])} ± {w(r['sd0'])}", f"{w(r['mean1'])} ± {w(r['sd1'])}", f"**{w(r['cohens_d'], 2, True)}** [{w(r['d_ci_lo'], 2, True)}, {w(r['d_ci_hi'], 2, True)}]", "—" if r["p_holm"] is None else f"{r['p_holm']:.2e}"] for r in strongest(effects).collect()]
    wide = [[r["metric"], *(r[m] for m in order)] for r in by_model(models, order).orderBy("metric").collect()]
    spread = [[r["metric"], w(r["between_sd"]), w(r["within_sd"]), w(r["ratio"], 2), f"{w(r['min_mean'])} to {w(r['max_mean'])}"] for r in dispersion.orderBy(F.col("ratio").asc_nulls_last(), "metric").collect()]
    lines = ["# Rhythm of the groups", "", "## Groups", "", *_table(["metric", "others", "group", "Cohen's d [95 % interval]", "p (Holm)"], groups), "## Models", "", *_table(["metric", *order], wide), "## Dispersion between models", ""]
    return "\n".join([*lines, *_table(["metric", "between", "within", "ratio", "means"], spread)])

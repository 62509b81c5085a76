"""From evaluation rows to level means, drop rates, worst-level robustness, compliance, profiles and rankings.

Evaluation rows have model, level, category, cpr, semantic, composite, results (array of type and passed) and ord, the
place in the input. Means of means stay separate aggregations: level means first, then over levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlens.functions import vocabulary as V
from mixlens.functions.numbers import rounded

LEVELS = (0, 1, 2, 3)


def level_scores(rows: DataFrame) -> DataFrame:
    """model, level and the mean of each metric; a missing score counts as 0."""
    return rows.groupBy("model", "level").agg(*(F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(m) for m, c in V.METRICS.items()))


def drop_rate(base: Column, score: Column) -> Column:
    return F.when(base == 0, 0.0).otherwise(rounded((base - score) / F.when(base != 0, base) * 100, 2))


def pdr_details(levels: DataFrame, baseline: int = 0, metric: str | None = None) -> DataFrame:
    """model, metric, level, baseline, perturbed, pdr for each other level of models that have the baseline level."""
    names = [m for m in V.METRICS if metric in (None, m)]
    long = levels.unpivot(["model", "level"], names, "metric", "score")
    over = Window.partitionBy("model", "metric")
    at_base = F.col("level") == baseline
    with_base = long.withColumn("baseline", F.max(F.when(at_base, F.coalesce("score", F.lit(0.0)))).over(over))
    found = with_base.filter(~at_base & F.col("baseline").isNotNull())
    return found.select("model", "metric", "level", "baseline", F.col("score").alias("perturbed"), drop_rate(F.col("baseline"), F.col("score")).alias("pdr"))


def pdr_by_level(details: DataFrame) -> DataFrame:
    return details.groupBy("model", "level").agg(F.avg("pdr").alias("pdr"))


def robustness(levels: DataFrame, details: DataFrame) -> DataFrame:
    """100 less the mean drop rate, 0 at least; 100 for a model without rates. Rises above 100 if scores rise."""
    means = details.groupBy("model").agg(F.avg("pdr").alias("mean_pdr"))
    models = levels.select("model").distinct()
    return models.join(means, "model", "left").select("model", F.greatest(F.lit(0.0), 100 - F.coalesce("mean_pdr", F.lit(0.0))).alias("robustness_score"))


def worst_and_mean(levels: DataFrame, metric: str = "combined_score") -> DataFrame:
    return levels.groupBy("model").agg(rounded(F.min(metric), 4).alias("worst_level_robustness"), rounded(F.avg(metric), 4).alias("mean_level_score"))


def first_seen(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model").agg(F.min("ord").alias("first_ord"))


def ranked(scores: DataFrame, rows: DataFrame, by: str, exclude: list[str] | None = None) -> DataFrame:
    """Add rank: highest first, ties in the order in which models first appear. One row per model is ranked."""
    kept = scores.filter(~F.col("model").isin(exclude)) if exclude else scores
    order = Window.orderBy(F.desc(by), F.asc("first_ord"))
    return kept.join(first_seen(rows), "model").withColumn("rank", F.row_number().over(order)).drop("first_ord")


def wlr_ranking(rows: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    return ranked(worst_and_mean(level_scores(rows)), rows, "worst_level_robustness", exclude).select("rank", "model", "worst_level_robustness", "mean_level_score")


def exploded_results(rows: DataFrame) -> DataFrame:
    return rows.select("model", "level", F.explode("results").alias("r")).select("model", "level", "r.type", F.col("r.passed").cast("double").alias("passed"))


def compliance_by_level(rows: DataFrame, types: tuple[str, ...] = V.CONSTRAINT_TYPES) -> DataFrame:
    """model, level, type and the share passed, 0 where a type has no value at that level."""
    found = exploded_results(rows).filter(F.col("type").isin(*types)).groupBy("model", "level", "type").agg(F.avg("passed").alias("compliance"))
    grid = rows.select("model", "level").distinct().withColumn("type", F.explode(F.array(*map(F.lit, types))))
    return grid.join(found, ["model", "level", "type"], "left").fillna(0.0, ["compliance"])


def compliance_overall(by_level: DataFrame) -> DataFrame:
    """The unweighted mean over levels, to 4 places."""
    return by_level.groupBy("model", "type").agg(rounded(F.avg("compliance"), 4).alias("compliance"))


def _profile(rows: DataFrame, column: str, domain: tuple, value: str) -> DataFrame:
    found = rows.groupBy("model", column).agg(F.avg(value).alias("score"))
    grid = rows.select("model").distinct().withColumn(column, F.explode(F.array(*map(F.lit, domain))))
    return grid.join(found, ["model", column], "left").fillna(0.0, ["score"])


def category_profile(rows: DataFrame, categories: tuple[str, ...] = tuple(V.CATEGORIES)) -> DataFrame:
    return _profile(rows.withColumn("composite", F.coalesce("composite", F.lit(0.0))), "category", categories, "composite")


def level_profile(rows: DataFrame) -> DataFrame:
    return _profile(rows.withColumn("composite", F.coalesce("composite", F.lit(0.0))), "level", LEVELS, "composite")


def constraint_profile(rows: DataFrame, types: tuple[str, ...] = ("keyword", "length")) -> DataFrame:
    """Of several results of a type in one record the last one counts."""
    last = F.filter(F.transform(F.array(*map(F.lit, types)), lambda t: F.element_at(F.filter("results", lambda r: r["type"] == t), -1)), lambda r: r.isNotNull())
    values = rows.withColumn("results", last)
    return _profile(exploded_results(values), "type", types, "passed") if types else exploded_results(values)


def radar(profile: DataFrame, categories: tuple[str, ...] = tuple(V.CATEGORIES)) -> DataFrame:
    """model, labels and values: parallel arrays in the order of the categories."""
    by_name = F.map_from_entries(F.collect_list(F.struct("category", "score")))
    labels = F.array(*map(F.lit, categories))
    return profile.groupBy("model").agg(by_name.alias("m")).select("model", labels.alias("labels"), F.transform(labels, lambda c: F.col("m")[c]).alias("values"))


def heatmap(levels: DataFrame) -> DataFrame:
    """model and the pass rate at each level in percent, 0 where the level is missing."""
    wide = levels.groupBy("model").pivot("level", list(LEVELS)).agg(F.first("constraint_pass_rate"))
    return wide.select("model", *(F.coalesce(F.col(str(k)) * 100, F.lit(0.0)).alias(f"level_{k}") for k in LEVELS))


def trend(levels: DataFrame) -> DataFrame:
    return levels.select("model", "level", (F.col("combined_score") * 100).alias("score"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: number of records, and the models in the order in which they first appear."""
    models = first_seen(rows).agg(F.transform(F.array_sort(F.collect_list(F.struct("first_ord", "model"))), lambda x: x["model"]).alias("models"))
    return rows.agg(F.count("*").alias("total_samples")).join(models).select("total_samples", F.array_join("models", ",").alias("models_evaluated"))


def robustness_chart(ranking: DataFrame, by_level: DataFrame) -> DataFrame:
    """Rows of the headline chart: each model's rank, worst level and mean level, with its drop by level as an array."""
    drops = by_level.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("level", "pdr"))).alias("drops"))
    return ranking.join(drops, "model", "left").select("rank", "model", "worst_level_robustness", "mean_level_score", "drops")


def example_cells(rows: DataFrame, levels: tuple[str, ...], n: int = 3, key: str = "id", seed: int = 42) -> DataFrame:
    """The example table: n rows by a hash, their levels as cells of wrapped lines."""
    from mixlens.functions import text as T
    from mixlens.operators.selection import sample_rows

    return sample_rows(rows, n, key, seed).select(key, *(T.wrapped(T.chart_cell(F.col(c))).alias(c) for c in levels))

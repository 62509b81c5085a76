"""Sorting instructions into categories by keywords, with patterns as the fallback, and apportioning quotas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlens.functions import text as T
from mixlens.functions import vocabulary as V

Categories = dict[str, tuple[float, list[str]]]


def with_custom(custom: dict[str, dict] | None = None, base: Categories | None = None) -> Categories:
    """Categories with some replaced whole, or added at the end; a missing weight is 0.2."""
    found = dict(V.CATEGORIES if base is None else base)
    for name, given in (custom or {}).items():
        found[name] = (given.get("weight", 0.2), list(given.get("keywords", [])))
    return found


def score(text: Column, tokens: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur as words in the lower-cased text; tokens are its runs of word characters."""
    plain = [k for k in keywords if re.fullmatch(r"\w+", k)]
    total = F.size(F.array_intersect(tokens, F.array(*map(F.lit, plain)))) if plain else F.lit(0)
    for k in keywords:
        if k not in plain:
            total = total + T.has_word(text, k).cast("int")
    return total


def by_pattern(text: Column) -> Column:
    found = F.lit(V.DEFAULT_CATEGORY)
    for pattern, name in reversed(V.HEURISTICS):
        found = F.when(text.rlike("(?U)" + pattern), name).otherwise(found)
    return found


def classify(instruction: Column, extra: Column | None = None, categories: Categories | None = None) -> Column:
    """The category of the best score, the first one on a tie; by pattern if all scores are 0."""
    categories = categories or V.CATEGORIES
    text = F.lower(F.concat(F.coalesce(instruction, F.lit("")), F.lit(" "), F.coalesce(extra, F.lit("")) if extra is not None else F.lit("")))

    def best(tokens: Column) -> Column:
        ranked = [F.struct(score(text, tokens, keywords).alias("score"), F.lit(-k).alias("place"), F.lit(name).alias("name")) for k, (name, (_, keywords)) in enumerate(categories.items())]
        return F.array_max(F.array(*ranked))

    # the text is cut into words once, and the scores are made once
    chosen = T.let(F.split(text, r"(?U)\W+"), best)
    return T.let(chosen, lambda b: F.when(b["score"] > 0, b["name"]).otherwise(by_pattern(text)))


def targets(total: int, categories: Categories | None = None) -> dict[str, int]:
    """Whole quotas by weight, one at least; what is left over goes to the largest."""
    found = {name: max(1, int(total * weight)) for name, (weight, _) in (categories or V.CATEGORIES).items()}
    largest = max(found, key=found.get)
    found[largest] += total - sum(found.values())
    return found


def targets_table(spark: SparkSession, total: int, categories: Categories | None = None) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in targets(total, categories).items()], "category string, target long")


def targets_of(totals: DataFrame, total: str, categories: Categories | None = None) -> DataFrame:
    """Rows of totals with category and target: the quotas of each row's number, as targets() has them."""
    listed = categories or V.CATEGORIES
    base = F.array(*(F.struct(F.lit(name).alias("category"), F.greatest(F.lit(1), F.floor(F.col(total) * F.lit(float(weight)))).cast("long").alias("n")) for name, (weight, _) in listed.items()))
    largest = lambda b: F.array_position(F.transform(b, lambda x: x["n"]), F.array_max(F.transform(b, lambda x: x["n"])))  # noqa: E731  the first of equal ones
    given = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    found = T.let(base, lambda b: F.transform(b, lambda x, k: F.struct(x["category"].alias("category"), (x["n"] + F.when(k + 1 == largest(b), F.col(total) - given(b)).otherwise(0)).alias("target"))))
    return totals.withColumn("_t", F.explode(found)).select(*totals.columns, "_t.category", "_t.target")

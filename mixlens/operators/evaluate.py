"""Scoring responses: lookup of gold answers and constraints, pass rate, ROUGE-L, composite; with resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlens.functions.numbers import rounded
from mixlens.functions.rouge import rouge_l
from mixlens.operators import constraints as C
from mixlens.operators.providers import Embedder, embedding_f1

KEY = ["model_id", "sample_id", "level"]
CPR_WEIGHT, SEMANTIC_WEIGHT = 0.6, 0.4


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key, by a partial aggregation rather than a sort of each key's rows."""
    others = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.max_by(F.struct(*others), order).alias("_row"))
    return picked.select(*key, *(F.col(f"_row.{c}").alias(c) for c in others))


def pending(records: DataFrame, done: DataFrame | None = None, key: list[str] | None = None) -> DataFrame:
    """Successful records with a response whose key is not done."""
    key = key or KEY
    ready = records.filter(F.col("success") & (F.coalesce(F.length("response"), F.lit(0)) > 0))
    return ready if done is None else ready.join(done.select(*key).distinct(), key, "left_anti")


def lookup(records: DataFrame, dataset: DataFrame) -> DataFrame:
    """Add gold_response and constraints of the sample; a missing sample gives an empty answer and no constraints.

    The table of samples is broadcast only where Spark finds its size below its threshold.
    """
    data = dataset.select(F.col("id").alias("sample_id"), "gold_response", "constraints")
    joined = records.join(data, "sample_id", "left")
    return joined.withColumns({"gold_response": F.coalesce("gold_response", F.lit("")), "constraints": F.coalesce("constraints", F.array().cast(f"array<{C.CONSTRAINT}>"))})


def composite(cpr: Column, semantic: Column) -> Column:
    return CPR_WEIGHT * cpr + SEMANTIC_WEIGHT * semantic


def score_batch(pairs: DataFrame, reference: str, response: str, embedder: Callable[[], Embedder] | None = None) -> DataFrame:
    """Add rouge_l, bert_f1 and their mean, semantic, to rows with two texts; without an embedder its half is 0."""
    scored = pairs if embedder is None else embedding_f1(pairs, embedder, reference, response)
    both = scored.withColumns({"rouge_l": rouge_l(F.col(reference), F.col(response))} | ({} if embedder else {"bert_f1": F.lit(0.0)}))
    return both.withColumn("semantic", (F.col("rouge_l") + F.col("bert_f1")) / 2)


def evaluate(records: DataFrame, dataset: DataFrame, done: DataFrame | None = None, bert_f1: Column | None = None) -> DataFrame:
    """One row per pending record with scores to 4 places; without embeddings their half of the semantic score is 0."""
    rows = lookup(pending(records, done), dataset)
    scored = rows.withColumn("constraint_results", C.check_all(F.col("response"), F.col("constraints"))).withColumn("_r", rouge_l(F.col("gold_response"), F.col("response")))
    bert = F.lit(0.0) if bert_f1 is None else bert_f1
    cpr, semantic = C.pass_rate(F.col("constraint_results")), (F.col("_r") + bert) / 2
    return scored.select(
        *KEY, "category", rounded(cpr, 4).alias("cpr"), "constraint_results", rounded("_r", 4).alias("rouge_l"), rounded(bert, 4).alias("bert_f1"),
        rounded(semantic, 4).alias("semantic"), rounded(composite(cpr, semantic), 4).alias("composite"),
    )


def unpivot_levels(dataset: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """One prompt per level that has text; the input, if not blank, follows after an empty line."""
    from mixlens.functions import text as T

    given = T.strip(F.coalesce("original_input", F.lit("")))
    rows = dataset.select("id", "category", given.alias("_in"), F.posexplode(F.array(*levels)).alias("level", "_t")).filter(F.coalesce(F.length("_t"), F.lit(0)) > 0)
    return rows.select("id", "level", "category", F.when(F.col("_in") != "", F.concat_ws("\n\n", "_t", "_in")).otherwise(F.col("_t")).alias("text"))


def error_type(error: Column) -> Column:
    low = F.lower(error)
    return (
        F.when(F.contains(low, F.lit("timed out")), "timeout")
        .when(F.contains(low, F.lit("empty completion")), "empty_completion")
        .when(F.contains(error, F.lit("429")) | F.contains(low, F.lit("rate_limit")), "rate_limit")
        .otherwise("api_error")
    )


def tally(records: DataFrame) -> DataFrame:
    """Number of records by outcome: success, or the type of the error."""
    return records.groupBy(F.when(F.col("success"), "success").otherwise(F.coalesce("error_type", F.lit("unknown"))).alias("outcome")).agg(F.count("*").alias("n"))


def model_prompts(models: DataFrame, prompts: DataFrame) -> DataFrame:
    """Every model with every prompt: the list of models is carried as one array per row, so nothing is shuffled."""
    listed = [r.asDict() for r in models.select("name", "model_id").collect()]  # a registry of a few models
    every = F.array(*(F.struct(F.lit(m["name"]).alias("model_name"), F.lit(m["model_id"]).alias("model_id")) for m in listed))
    return prompts.withColumn("_m", F.explode(every)).select("_m.model_name", "_m.model_id", *prompts.columns)


def first_rows(rows: DataFrame, n: int, order: str) -> DataFrame:
    return rows.orderBy(order).limit(n)


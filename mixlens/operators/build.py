"""Building a dataset: filter, classify, fill quotas in rounds, constraints, four levels, restored lines, canonical ids."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlens.functions import vocabulary as V
from mixlens.operators import classify, constraints, providers, rewrite, selection
from mixlens.sources.tables import drop_stored, stored

MAX_ROUNDS = 8


class Filled(NamedTuple):
    rows: DataFrame
    failures: DataFrame
    counts: dict[str, int]
    rounds: int


def fill(candidates: DataFrame, targets: dict[str, int], process: Callable[[DataFrame], DataFrame], max_rounds: int = MAX_ROUNDS) -> Filled:
    """Take candidates of each category in the order of place, from 1, until as many succeed as its target asks for.

    process adds error, null where a row succeeded, and keeps category and place. Each round asks for what is still
    missing, a quarter more in the first, and goes on behind the last candidate asked. Surplus successes go. Rounds end
    when all targets are met, no candidates are left, or max_rounds are over; each round is written down.
    """
    counts, cursors = dict.fromkeys(targets, 0), dict.fromkeys(targets, 0)
    made: list[DataFrame] = []
    rounds = 0
    sizes = {r.category: r["count"] for r in candidates.groupBy("category").count().collect()}
    while rounds < max_rounds:
        need = {c: t - counts[c] for c, t in targets.items() if t > counts[c] and cursors[c] < sizes.get(c, 0)}
        if not need:
            break
        upto = {c: cursors[c] + (int(n * 1.25) if rounds == 0 else n) for c, n in need.items()}
        batch = selection.between_places(candidates, {c: cursors[c] for c in need}, upto)
        made.append(stored(process(batch), "build-round"))
        cursors |= upto
        rounds += 1
        for r in made[-1].filter("error IS NULL").groupBy("category").count().collect():
            counts[r.category] = min(targets[r.category], counts[r.category] + r["count"])
    if not made:
        made.append(process(candidates.limit(0)))
    every = made[0]
    for other in made[1:]:
        every = every.unionByName(other)
    good = selection.with_place(every.filter("error IS NULL"), ["place"], "nth")
    return Filled(selection.between_places(good.withColumnRenamed("place", "asked").withColumnRenamed("nth", "place"), {}, targets).drop("asked", "place"), every.filter("error IS NOT NULL"), counts, rounds)


def processed(rows: DataFrame, seed: int = 42, make: Callable[[], providers.Rewriter] = providers.RuleRewriter, templates: dict | None = None, types: tuple[str, ...] = V.CONSTRAINT_TYPES, gold: Callable[[], providers.GoldWriter] | None = None, **limits: float) -> DataFrame:
    """Add constraints, levels with their constraint lines restored, and error; with gold also an answer where there is none."""
    whole = F.when(F.col("input") != "", F.concat_ws("\n", "instruction", "input")).otherwise(F.col("instruction"))
    derived = rows.withColumn("constraints", constraints.derive(whole, F.col("output"), F.col("category"), F.col("instruction"), types=types, seed=seed))
    needs = F.transform("constraints", lambda c: c["requirement"])
    asked = derived.withColumn("_text", constraints.embed(F.col("instruction"), needs))
    rewritten = providers.rewrite_levels(asked, "_text", "instruction", seed, make, templates, **limits)
    if gold is not None:
        answered = providers.gold_with(rewritten.withColumnsRenamed({"error": "_error", "error_type": "_type"}), gold, "_text", "_gold", **limits)
        rewritten = answered.withColumns({"output": F.when(F.col("output") != "", F.col("output")).otherwise(F.col("_gold")), "error": F.coalesce("_error", F.when(F.col("output") == "", F.col("error"))), "error_type": F.coalesce("_type", F.when(F.col("output") == "", F.col("error_type")))}).drop("_error", "_type", "_gold")
    return rewritten.withColumns({level: rewrite.enforce_lines(F.col(level), needs) for level in V.LEVELS}).drop("_text")


def shaped(rows: DataFrame) -> DataFrame:
    """Rows of the dataset from processed ones, without ids."""
    return rows.select("category", F.col("instruction").alias("original_instruction"), F.col("input").alias("original_input"), F.col("output").alias("gold_response"), "constraints", *V.LEVELS)


def finished(rows: DataFrame, seed: int = 42, prefix: str = "item_") -> DataFrame:
    """Dataset rows of instruction, input, output and category, all of them, numbered."""
    return selection.finalize_ids(shaped(processed(rows, seed).filter("error IS NULL")), prefix)


def candidates(source: DataFrame, seed: int = 42, categories: classify.Categories | None = None, done: DataFrame | None = None) -> DataFrame:
    """Usable instructions with category and place, each once: of rows with one instruction the least input and output stay."""
    given = source.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("instruction", "input", "output")))
    usable = given.filter(selection.long_enough(F.col("instruction"))).groupBy("instruction").agg(F.min(F.struct("input", "output")).alias("_r")).select("instruction", "_r.input", "_r.output")
    if done is not None:
        usable = usable.join(done.select(F.col("original_instruction").alias("instruction")).distinct(), "instruction", "left_anti")
    sorted_rows = usable.withColumn("category", classify.classify(F.col("instruction"), F.col("input"), categories))
    return selection.with_place(sorted_rows, [F.xxhash64(F.lit(seed), "instruction"), "instruction"])


def build_report(source: DataFrame, total: int, seed: int = 42, categories: classify.Categories | None = None, done: DataFrame | None = None, prefix: str = "item_", max_rounds: int = MAX_ROUNDS, **options: object) -> tuple[DataFrame, DataFrame, dict]:
    """The dataset, the failed rows, and figures of the run. Rows in done, with category and original_instruction, count for the quotas."""
    wanted = classify.targets(total, categories)
    if done is not None:
        for r in done.groupBy("category").count().collect():
            if r.category in wanted:
                wanted[r.category] = max(0, wanted[r.category] - r["count"])
    placed = stored(candidates(source, seed, categories, done), "candidates")
    found = fill(placed, wanted, lambda batch: processed(batch, seed, **options), max_rounds)
    rows = stored(selection.finalize_ids(shaped(found.rows), prefix), "dataset")
    drop_stored(placed)
    figures = {"total_samples": sum(found.counts.values()), "total_prompts": sum(found.counts.values()) * len(V.LEVELS), "failures": found.failures.count(), "category_distribution": found.counts, "rounds": found.rounds}
    return rows, found.failures.select("category", "instruction", "error", "error_type"), figures


def build(source: DataFrame, total: int, seed: int = 42, categories: classify.Categories | None = None, done: DataFrame | None = None, prefix: str = "item_", **options: object) -> DataFrame:
    """Rows of the dataset, with levels as columns and typed constraints; instructions already done are left out."""
    return build_report(source, total, seed, categories, done, prefix, **options)[0]


def flatten_sample(rows: DataFrame) -> DataFrame:
    """Flat rows for an export: levels as columns, constraints as JSON text; what told how they were made is left out."""
    levels = F.col("perturbations.*") if "perturbations" in rows.columns else None
    kept = rows.select("id", "category", "original_instruction", "original_input", "gold_response", levels if levels is not None else F.struct(*V.LEVELS).alias("_l"), F.to_json("constraints").alias("constraints"))
    return kept.select("id", "category", "original_instruction", "original_input", "gold_response", *(V.LEVELS if levels is not None else [f"_l.{c}" for c in V.LEVELS]), "constraints")

"""Command line: build, infer, evaluate, analyze, validate, report, export, probe and demo, each from and to folders, and all in one run."""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlens.functions import vocabulary as V
from mixlens.logs import get_logger, setup_logger
from mixlens.operators import analysis, build, calls, classify, evaluate, providers, selection, validation
from mixlens.sources import tables as S


def analysis_rows(evaluated: DataFrame) -> DataFrame:
    """Evaluation records as the analysis reads them; their place is the order of model, sample and level."""
    order = F.struct("model_id", "sample_id", "level")
    return evaluated.select(F.col("model_id").alias("model"), "level", "category", "cpr", "semantic", "composite", F.col("constraint_results").alias("results"), order.alias("ord"))


def writers(a: argparse.Namespace) -> dict:
    """The model that rewrites and answers, if one is named; else the offline writers."""
    if not a.writer:
        return {}
    if not a.url:
        raise ValueError("a writer needs a url")
    model, url = a.writer, a.url
    key = os.environ.get(a.key_env, "") or (selection.PLACEHOLDER_KEY if selection.is_local(url) else "")
    if not key:
        raise ValueError(f"no key for {model}: {a.key_env} is not set")
    return {"make": lambda: providers.EndpointRewriter(calls.ChatEndpoint(model, url, key, temperature=0.7)), "gold": lambda: providers.EndpointGold(calls.ChatEndpoint(model, url, key))}


def run_build(spark: SparkSession, a: argparse.Namespace) -> None:
    """Fill the quotas in rounds; failed rows and the figures of the run are written beside the dataset."""
    done = spark.read.parquet(a.done) if a.done else None
    templates = S.load_templates(a.prompts) if a.prompts else None
    limits = {"partitions": a.partitions, "per_minute": a.per_minute, "concurrency": a.concurrency}
    rows, failures, figures = build.build_report(S.read_lines(spark, a.source, S.SOURCE), a.samples, a.seed, done=done, prefix=a.prefix, max_rounds=a.max_rounds, templates=templates, **writers(a), **limits)
    rows.write.mode("overwrite").parquet(a.out)
    counts = S.write_failures(failures, f"{a.out}_failures")
    S.write_stats(spark, figures | {"failures_by_type": counts, "source": a.source}, f"{a.out}_stats")
    get_logger().info("%d rows in %d rounds, %d failures", figures["total_samples"], figures["rounds"], figures["failures"])


def _registry(path: str) -> list[dict]:
    found = S.load_config(path)
    return found.get("models") or found.get("inference", {}).get("models", [])


def chosen_models(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    listed = [(m["name"], m["model_id"]) for m in _registry(a.models)]
    return selection.select_models(spark.createDataFrame(listed, "name string, model_id string"), a.include, a.exclude, a.add)


def endpoints(listed: list[dict], url: str | None, key_env: str | None, environment: dict[str, str], kind: str | None = None) -> Callable[[str], providers.Generator]:
    """The connector of a model_id: an endpoint of the kind its registry entry names, or the one given.

    A model of an entry with base_url is asked there, others at url; without either the offline generator answers. A key
    that is needed and unset raises before the first call.
    """
    known = {}
    for m in listed:
        if url or m.get("base_url"):
            at, key, source = selection.resolve_credentials(m, url or m["base_url"], environment.get(key_env or "", ""), environment)
            if not key:
                raise ValueError(f"no key for {m['name']}: {key_env if source == 'default' else source} is not set")
            known[m["model_id"]] = (at, key, m.get("api_format") or "chat")

    def make(model: str) -> providers.Generator:
        if model not in known and not url:
            return providers.EchoGenerator()
        at, key, own = known.get(model) or (url, environment_key, "chat")
        return calls.ENDPOINTS.get(kind or own, calls.ChatEndpoint)(model, at, key)

    environment_key = environment.get(key_env or "", "") if url and not selection.is_local(url) else selection.PLACEHOLDER_KEY
    return make


def run_infer(spark: SparkSession, a: argparse.Namespace, models: DataFrame | None = None) -> None:
    """Ask every selected model every prompt that has no record yet; answers are in place task by task."""
    models = chosen_models(spark, a) if models is None else models
    data = spark.read.parquet(a.dataset)
    limited = evaluate.first_rows(data, a.limit, "id") if a.limit else data
    prompts = evaluate.unpivot_levels(limited, V.LEVELS).withColumnsRenamed({"id": "sample_id", "text": "prompt"})
    asked = evaluate.model_prompts(models, prompts)
    done = S.stored(S.read_lines(spark, a.out, S.INFERENCE, "resume").select(*evaluate.KEY).distinct(), "done")
    todo = asked.join(done, evaluate.KEY, "left_anti")
    wanted = {r.model_id for r in models.select("model_id").collect()}
    make = endpoints([m for m in _registry(a.models) if m["model_id"] in wanted], a.url, a.key_env, dict(os.environ))
    n = providers.infer_into(todo, make, a.out, evaluate.KEY, a.partitions, a.calls, a.per_minute, by="model_id", concurrency=a.concurrency, retries=a.retries)
    get_logger().info("%d prompts asked", n)


def run_evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Score records that have no score yet; of dataset rows with one id the last in the files counts."""
    records = S.read_strict(spark, a.records, S.INFERENCE)
    data = evaluate.last_wins(S.with_position(spark.read.parquet(a.dataset), "_o"), ["id"], "_o").drop("_o")
    done = spark.read.parquet(a.done) if a.done else None
    evaluate.evaluate(records, data, done).write.mode("append").parquet(a.out)


def run_analyze(spark: SparkSession, a: argparse.Namespace) -> None:
    """Reports: ranking, drop rates, compliance, profiles, summary, and the data of the charts."""
    rows = analysis_rows(spark.read.parquet(a.evaluated))
    levels = analysis.level_scores(rows)
    details = analysis.pdr_details(levels)
    by_type = analysis.compliance_by_level(rows)
    reports = {
        "ranking": analysis.wlr_ranking(rows, a.exclude),
        "pdr_details": details,
        "pdr_by_level": analysis.pdr_by_level(details),
        "robustness": analysis.robustness(levels, details),
        "robustness_chart": analysis.robustness_chart(analysis.wlr_ranking(rows, a.exclude), analysis.pdr_by_level(details)),
        "compliance_by_level": by_type,
        "compliance": analysis.compliance_overall(by_type),
        "profile_category": analysis.category_profile(rows),
        "profile_constraint": analysis.constraint_profile(rows),
        "profile_level": analysis.level_profile(rows),
        "heatmap": analysis.heatmap(levels),
        "trend": analysis.trend(levels),
        "summary": analysis.summary(rows),
    }
    for name, report in reports.items():
        S.write_report(report, f"{a.out}/{name}")


def run_validate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Write everything that is wrong, and the categories beside their targets; 1 if something is an error."""
    data = spark.read.parquet(a.dataset)
    found = S.stored(validation.full_report(data, a.prefix), "violations")
    S.write_report(found, a.out)
    S.write_report(validation.category_distribution(data, classify.targets_table(spark, a.samples)), f"{a.out}_categories")
    for r in validation.shown(found).orderBy("severity", "id", "rule").collect():  # 100 rows at most
        get_logger().info("%s %s %s", r.severity.upper(), r.id or "-", r.rule)
    return int(not found.filter("severity = 'error'").isEmpty())


def run_report(spark: SparkSession, a: argparse.Namespace) -> None:
    data = spark.read.parquet(a.dataset)
    S.write_report(validation.marker_coverage(data, V.LEVELS[2], V.LEVELS[3]), f"{a.out}/markers")
    S.write_report(validation.average_words(data), f"{a.out}/words")
    S.write_report(validation.identity_rate(data, V.LEVELS[0], V.LEVELS[1]).withColumn("band", validation.identity_band(F.col("percent"))), f"{a.out}/identity")
    S.write_report(analysis.example_cells(data, V.LEVELS), f"{a.out}/examples")
    S.write_report(data.groupBy("category").count(), f"{a.out}/categories")


def run_export(spark: SparkSession, a: argparse.Namespace) -> None:
    S.export_split(selection.train_test(build.flatten_sample(spark.read.parquet(a.dataset)), ["id"]), a.out)


def run_demo(spark: SparkSession, a: argparse.Namespace) -> None:
    """A dataset made from literal rows, to try the other commands."""
    S.demo_dataset(spark, a.samples, a.seed).write.mode("overwrite").parquet(a.out)
    for r in spark.read.parquet(a.out).groupBy("category").count().orderBy("category").collect():
        get_logger().info("%s %d", r.category, r["count"])


def run_probe(spark: SparkSession, a: argparse.Namespace) -> int:
    """Ask each model of the registry once, by its kind of endpoint, else by chat, and write who answers; 1 if one does not."""
    registry = _registry(a.models)
    listed = [(m["name"], m["model_id"], m.get("api_format")) for m in registry]
    rows = spark.createDataFrame(listed, "name string, model_id string, api_format string").repartition(a.partitions)
    of_kind = lambda kind: endpoints(registry, a.url, a.key_env, dict(os.environ), kind)
    found = S.stored(providers.probe(rows, of_kind("chat"), others={k: of_kind(k) for k in calls.ENDPOINTS if k != "chat"}), "probe")
    S.write_report(found, a.out)
    return int(not found.filter("NOT ok").isEmpty())


def picked_models(models: DataFrame, answer: str) -> DataFrame:
    """All models for an empty answer or yes, those of the numbers given, from 1; none to stop."""
    said = answer.strip().lower()
    if said in ("", "y", "yes"):
        return models
    if said in ("q", "n", "no"):
        return models.limit(0)
    listed = models.select("name", "model_id").collect()
    try:
        numbers = sorted({int(x) for x in said.replace(" ", "").split(",")})
    except ValueError as e:
        raise ValueError(f"no numbers of models: {answer!r}") from e
    names = [listed[k - 1].model_id for k in numbers if 1 <= k <= len(listed)]
    if not names:
        raise ValueError(f"no models have the numbers {answer!r}")
    return models.filter(F.col("model_id").isin(*names))


def run_all(spark: SparkSession, a: argparse.Namespace) -> int:
    """Infer, evaluate and analyze below one folder; a dataset that is missing is built first. A step that fails ends the run."""
    smoke = {"samples": 10, "limit": 2} if a.smoke else {}
    at = lambda name: f"{a.out}/{name}"
    step = argparse.Namespace(**{**vars(a), **smoke})
    models = chosen_models(spark, step)
    if not a.yes:
        for k, m in enumerate(models.collect(), 1):
            print(f"{k:>3}. {m.name}  ({m.model_id})")
        models = picked_models(models, input("Proceed with all models? [Enter, numbers such as 1,3, or q] "))
        if models.isEmpty():
            return 0
    dataset = a.dataset or at("dataset")
    if not S.exists(spark, dataset):
        get_logger().info("%s is missing and is built", dataset)
        if a.source:
            run_build(spark, argparse.Namespace(**{**vars(step), "out": dataset, "done": None}))
        else:
            run_demo(spark, argparse.Namespace(samples=step.samples, seed=a.seed, out=dataset))
    run_infer(spark, argparse.Namespace(**{**vars(step), "dataset": dataset, "out": at("records")}), models)
    done = at("scores") if S.exists(spark, at("scores")) else None
    run_evaluate(spark, argparse.Namespace(records=at("records"), dataset=dataset, out=at("scores"), done=done))
    run_analyze(spark, argparse.Namespace(evaluated=at("scores"), out=at("reports"), exclude=None))
    return 0


_ENDPOINT = {"--url": {}, "--key-env": {"default": "MIXLENS_API_KEY"}}
_LIMITS = {"--partitions": {"type": int, "default": 8}, "--per-minute": {"type": float}, "--concurrency": {"type": int, "default": calls.CONCURRENCY}}
_MODELS = {"--include": {"nargs": "*"}, "--exclude": {"nargs": "*"}, "--add": {"nargs": "*"}, "--limit": {"type": int}, "--calls": {"type": int, "default": 2 * calls.CONCURRENCY}, "--retries": {"type": int, "default": 6}, **_LIMITS, **_ENDPOINT}
_BUILD = {"--samples": {"type": int, "default": 750}, "--seed": {"type": int, "default": 42}, "--prefix": {"default": "item_"}, "--prompts": {}, "--max-rounds": {"type": int, "default": build.MAX_ROUNDS}, "--writer": {}, **_LIMITS, **_ENDPOINT}
COMMANDS = {
    "build": (run_build, {"source": {}, "out": {}, "--done": {}, **_BUILD}),
    "infer": (run_infer, {"dataset": {}, "models": {}, "out": {}, **_MODELS}),
    "evaluate": (run_evaluate, {"records": {}, "dataset": {}, "out": {}, "--done": {}}),
    "analyze": (run_analyze, {"evaluated": {}, "out": {}, "--exclude": {"nargs": "*"}}),
    "validate": (run_validate, {"dataset": {}, "out": {}, "--prefix": {"default": "item_"}, "--samples": {"type": int, "default": 750}}),
    "report": (run_report, {"dataset": {}, "out": {}}),
    "export": (run_export, {"dataset": {}, "out": {}}),
    "probe": (run_probe, {"models": {}, "out": {}, "--partitions": {"type": int, "default": 8}, **_ENDPOINT}),
    "demo": (run_demo, {"out": {}, "--samples": {"type": int, "default": 100}, "--seed": {"type": int, "default": 42}}),
    "all": (run_all, {"models": {}, "out": {}, "--dataset": {}, "--source": {}, "--smoke": {"action": "store_true"}, "--yes": {"action": "store_true"}, **_MODELS, **_BUILD}),
}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="mixlens", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (run, options) in COMMANDS.items():
        one = commands.add_parser(name, help=run.__doc__)
        for option, how in options.items():
            one.add_argument(option, **how)
    given = parser.parse_args(arguments)
    setup_logger()
    session = spark or SparkSession.builder.appName("mixlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return COMMANDS[given.command][0](session, given) or 0

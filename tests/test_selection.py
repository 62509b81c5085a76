"""Quotas and places beside plain versions, on skewed categories and odd orders."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mixlens.operators import selection, validation

ROWS = "k int, category string, o double, h long"


def skewed(spark, n=3000):
    """Nine tenths of one category, a category without a name, and order values that repeat, are null, or no numbers."""
    rng = random.Random(4)
    rows = []
    for k in range(n):
        category = rng.choice(["big"] * 18 + ["small", None])
        rows.append((k, category, rng.choice([None, float("nan"), 1.0, -2.5, rng.random() * 1e6, float("inf")]), rng.getrandbits(62)))
    return rows, spark.createDataFrame(rows, ROWS).repartition(5)


def plain(rows, key):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    return {r[0]: n for g in groups.values() for n, r in enumerate(sorted(g, key=key), 1)}


def by_number(r):
    o = r[2]
    return (0, 0.0, r[0]) if o is None else (2, 0.0, r[0]) if o != o else (1, o, r[0])


@pytest.mark.parametrize("cells", [selection.CELLS, 1])
def test_first_of_each(spark, monkeypatch, cells):
    monkeypatch.setattr(selection, "CELLS", cells)
    rows, df = skewed(spark)
    for order, key in ((["o", "k"], by_number), ([F.col("h") % 100, "k"], lambda r: (r[3] % 100, r[0])), (["k"], lambda r: r[0])):
        places = plain(rows, key)
        for most in ({"big": 250, "small": 7, "none": 3}, 40):
            got = {r.k: r.place for r in selection.first_of_each(df, most, order).collect()}
            bound = (lambda c: most.get(c, 0)) if isinstance(most, dict) else (lambda c: most)  # noqa: B023
            assert got == {r[0]: places[r[0]] for r in rows if places[r[0]] <= bound(r[1])}


def test_order_by_text_and_no_rows(spark):
    rows, df = skewed(spark, 300)
    text = df.withColumn("t", F.col("k").cast("string"))
    got = {r.k for r in selection.first_of_each(text, {"big": 20}, ["t"]).collect()}
    assert got == set(sorted((r[0] for r in rows if r[1] == "big"), key=str)[:20])
    assert selection.first_of_each(df.limit(0), 5, ["k"]).count() == 0 and selection.first_of_each(df, {}, ["k"]).count() == 0


def test_round_slices_follow_each_other(spark):
    rows, df = skewed(spark, 600)
    places = plain(rows, lambda r: r[0])
    first = {r.k for r in selection.round_slice(df, ["k"], 40).collect()}
    second = {r.k for r in selection.round_slice(df, ["k"], 30, cursor=50, first=False).collect()}
    assert first == {k for k, n in places.items() if n <= 50} and second == {k for k, n in places.items() if 50 < n <= 80}


def test_no_task_holds_a_category(spark):
    """A category of nine tenths of the rows is dealt to several ranges, and the plan moves nothing by category alone."""
    rows, df = skewed(spark, 4000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else ranges this small are put together
    try:
        placed = selection.with_place(df, ["h", "k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.k: r.place for r in placed.collect()} == plain(rows, lambda r: (r[3], r[0]))
    files = [spark.read.parquet(f).count() for f in placed.inputFiles()]
    assert len(files) >= 3 and max(files) < 0.6 * len(rows)
    for df_ in (placed, selection.first_of_each(df, {"big": 100}, ["h"])):
        plan = df_._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(category" not in plan and "Window" not in plan


def test_bounds_reach_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id as place", "if(id % 2 = 0, 'a', 'b') as category").write.parquet(str(tmp_path / "placed"))
    found = selection.between_places(spark.read.parquet(str(tmp_path / "placed")), {"a": 10}, {"a": 20, "b": 5})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and sorted(r.place for r in found.collect()) == [1, 3, 5, 12, 14, 16, 18, 20]


def test_shown_violations(spark):
    report = spark.createDataFrame([(f"i{k:04}", "r", s) for k in range(500) for s in ("error", "warning", "info")], "id string, rule string, severity string")
    shown = validation.shown(report)
    assert "WindowGroupLimit" in shown._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.severity, r.id) for r in shown.collect())
    assert got == [(s, f"i{k:04}") for s, n in (("error", 60), ("info", 40), ("warning", 40)) for k in range(n)]


def test_seeded_shuffle(spark):
    """The same order for a seed however the rows are dealt, another one for another seed, and every row once."""
    order = lambda seed, n: [r.id for r in selection.shuffled(spark.range(200).repartition(n), "id", seed).collect()]
    assert order(1, 2) == order(1, 7) != order(2, 2)
    assert sorted(order(1, 2)) == list(range(200)) != order(1, 2)

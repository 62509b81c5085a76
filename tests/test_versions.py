"""Line numbers over splits, and folders replaced as a whole, with a crash at every step."""

import random

import pytest

from mixlens.sources import tables as S
from mixlens.sources import versions


def test_line_numbers_over_many_splits(spark, tmp_path):
    """Files of many splits, with blank lines, long lines and other line ends; the numbers are those of the whole file."""
    rng = random.Random(2)
    wanted = set()
    for name in ("a.jsonl", "b.jsonl"):
        lines = []
        for k in range(3000):
            line = rng.choice(['{"a": "x", "b": 1}'] * 30 + ["", "  ", '{"a": "' + "y" * rng.randrange(3000) + '"}', '{"a": oops', "[1, 2", "null", '{"b": "no number"}'])
            lines.append(line)
            if line in ('{"a": oops', "[1, 2", '{"b": "no number"}'):
                wanted.add((name, k + 1))
        (tmp_path / name).write_text((rng.choice(["\n", "\r\n"])).join(lines) + "\n")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        text = spark.read.text(str(tmp_path))
        assert text.rdd.getNumPartitions() > 10
        got = {(r.file.rsplit("/", 1)[1], r.line) for r in S.bad_lines(spark, str(tmp_path), "a string, b int").collect()}
        first = min(n for f, n in wanted if f == "a.jsonl")
        with pytest.raises(ValueError, match=rf"a\.jsonl:{first},"):
            S.read_strict(spark, str(tmp_path), "a string, b int")
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {x for x in got if x in wanted} == wanted
    assert all((tmp_path / f).read_text().splitlines()[n - 1] == "null" for f, n in got - wanted)  # no record of the schema either


def rows(spark, n):
    return spark.range(n).selectExpr("cast(id as int) as k")


def read(spark, path):
    return sorted(r.k for r in S.read_lines(spark, path, "k int").collect())


class Crash(Exception):
    pass


def test_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    rows(spark, 3).write.json(path)  # never replaced so far
    assert versions.current(spark, path) == path
    assert read(spark, path) == [0, 1, 2]
    for n in (1, 5, 2, 4):
        assert versions.replace(rows(spark, n), path) == versions.current(spark, path)
        assert read(spark, path) == list(range(n))
    found = sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("."))
    assert len([x for x in found if x.startswith("data-")]) == 2 and len(found) == 3
    versions.replace(spark.read.json(versions.current(spark, path)).filter("k = 0"), path)  # reads what it replaces
    assert read(spark, path) == [0]
    versions.replace(rows(spark, 7), path, "parquet")
    assert spark.read.parquet(versions.current(spark, path)).count() == 7


def test_a_crash_at_every_step(spark, tmp_path, monkeypatch):
    """Before its entry is whole a replacement has not happened, and afterwards it has."""
    path = str(tmp_path / "out")
    S.write_lines(rows(spark, 2), path)

    def crash(*a):
        raise Crash

    with monkeypatch.context() as m:  # with the data half written
        m.setattr(versions, "commit", crash)
        with pytest.raises(Crash):
            versions.replace(rows(spark, 3), path)
    assert read(spark, path) == [0, 1]
    # with an entry that was begun: it has a number, and no end
    log = tmp_path / "out" / versions.LOG
    (log / "000000000002").write_text("")
    assert read(spark, path) == [0, 1]
    (log / "000000000003").write_text("data-half")
    assert read(spark, path) == [0, 1]
    with monkeypatch.context() as m:  # with the entry in place, before old versions go
        m.setattr(versions, "clean", crash)
        with pytest.raises(Crash):
            versions.replace(rows(spark, 4), path)
    assert read(spark, path) == [0, 1, 2, 3]
    S.write_lines(rows(spark, 5), path)
    S.write_lines(rows(spark, 6), path)
    assert read(spark, path) == list(range(6))
    # while old versions go: the data of one is gone and its entry is not
    entries = versions._entries(spark, path)
    (log / f"{1:012}").write_text("data-gone\n")
    assert read(spark, path) == list(range(6)) and len(entries) >= 2
    versions.clean(spark, path)
    assert read(spark, path) == list(range(6)) and not (log / f"{1:012}").exists()


def test_two_writers_get_two_numbers(spark, tmp_path):
    path = str(tmp_path / "out")
    for folder, n in (("data-a", 1), ("data-b", 2)):
        rows(spark, n).write.json(f"{path}/{folder}")
    first = versions.commit(spark, path, "data-a")
    listed = versions._entries
    try:
        versions._entries = lambda *a: []  # the second writer looked before the first was done
        second = versions.commit(spark, path, "data-b")
    finally:
        versions._entries = listed
    assert (first, second) == (1, 2) and read(spark, path) == [0, 1]

"""Frozen sets: which ranges and rows differ, and which files are read to find out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import frozen

SCHEMA = "id long, name string, value double"
ROWS = [(i, None if i % 7 == 0 else f"n{i % 5}", i / 3) for i in range(3000)] + [(None, "no id", 1.0), (5, "n0", 5 / 3), (5, "n0", 5 / 3)]


def frozen_at(spark, tmp_path, name: str, rows: list[tuple]) -> tuple[str, str]:
    path = str(tmp_path / name)
    return path, frozen.freeze(spark.createDataFrame(rows, SCHEMA).repartition(3), "id", path)


def test_planted_changes_are_found_in_their_ranges_alone(spark, tmp_path):
    one, root = frozen_at(spark, tmp_path, "one", ROWS)
    same, again = frozen_at(spark, tmp_path, "same", ROWS[::-1])
    assert root == again and frozen.differing_ranges(spark, one, same) == [] and frozen.differences(spark, one, same, "id").count() == 0
    changed = [(i, n, v + (i == 77)) for i, n, v in ROWS if i != 1234 and not (n is None and i == 700)] + [(700, "", 700 / 3), (9999, "new", 0.0)]
    changed.remove((5, "n0", 5 / 3))  # one of three equal rows
    other, _ = frozen_at(spark, tmp_path, "other", changed)
    ranges = frozen.differing_ranges(spark, one, other)
    assert {tuple(r) for r in frozen.differences(spark, one, other, "id").collect()} == {(77, "changed"), (1234, "missing"), (700, "changed"), (9999, "added"), (5, "changed")}
    assert 4 <= len(ranges) <= 5
    files = {f.split("range=")[1][:2] for f in spark.read.parquet(f"{one}/rows").where(F.col("range").isin(ranges)).inputFiles()}
    plan = spark.read.parquet(f"{one}/rows").where(F.col("range").isin(ranges))
    assert set(ranges) <= files and {r[0] for r in plan.select("range").distinct().collect()} <= set(ranges)
    assert "PartitionFilters: [range" in plan._jdf.queryExecution().executedPlan().toString()  # files of other ranges are not read


def test_empty_and_single_sets(spark, tmp_path):
    none, root = frozen_at(spark, tmp_path, "none", [])
    one, single = frozen_at(spark, tmp_path, "single", ROWS[:1])
    assert root == "" and single and len(frozen.differing_ranges(spark, none, one)) == 1
    assert [tuple(r) for r in frozen.tree(spark.createDataFrame(ROWS[:1], SCHEMA), "id").orderBy("level").select("level", "n").collect()] == [(0, 1), (1, 1), (2, 1)]

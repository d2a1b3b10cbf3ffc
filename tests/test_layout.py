"""A scan by key and time opens only the files that the zone map names."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessella.sources import layout


def test_only_files_in_range_are_opened(spark, tmp_path):
    """Half of all rows have one key: its periods lie in different files."""
    start = datetime(2024, 1, 1)
    rows = [(7 if i % 2 else i % 50, start + timedelta(minutes=i), i) for i in range(4000)] + [(None, start, -1), (7, None, -2)]
    path = str(tmp_path / "laid")
    layout.write(spark.createDataFrame(rows, "k long, t timestamp, i long").repartition(6), "k", "t", path, 20)
    every = spark.read.parquet(f"{path}/rows").inputFiles()
    assert len(every) >= 15 and spark.read.parquet(f"{path}/rows").count() == 4002
    at = lambda minutes: F.lit((start + timedelta(minutes=minutes)).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    for key, a, b in ((7, 1000, 1400), (8, 0, 4000), (7, 3999, 4000), (12, 10, 11)):
        got = layout.scan(spark, path, "k", "t", key, at(a), at(b))
        assert sorted(r.i for r in got.collect()) == sorted(i for k, t, i in rows if k == key and t and timedelta(minutes=a) <= t - start < timedelta(minutes=b))
        opened = got.inputFiles()
        assert len(opened) <= 4 and set(opened) <= set(every) | {f.replace("file:/", "file:///") for f in every}
    assert layout.scan(spark, path, "k", "t", 999, at(0), at(9)).count() == 0

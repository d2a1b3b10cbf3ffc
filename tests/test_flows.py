"""Plans, readers, writers and streams where SQL does not reach: bad input, errors, and steps that run over micro-batches."""

from __future__ import annotations

import json
from collections import Counter
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.plans import search
from tessella.sources import readers, writers
from tessella.streaming import hosts, pipelines, steps

FAILURES = (PySparkException, Py4JJavaError)
NOW = datetime(2024, 1, 20, 12, tzinfo=UTC)
GOOD = {"intent": search.INTENT, "from": "2024-01-18T00:00:00Z", "to": "2024-01-19T00:00:00+09:00"}


@pytest.mark.parametrize(("change", "code"), [
    ({"intent": "drop_tables"}, "UNSUPPORTED_INTENT"), ({"from": None}, "MISSING_FIELD"), ({"to": 5}, "INVALID_TYPE"), ({"to": "soon"}, "INVALID_DATETIME"), ({"from": "2024-01-18T00:00:00"}, "NAIVE_DATETIME"),
    ({"sql": "select 1"}, "UNKNOWN_FIELD"), ({"limit": "5"}, "INVALID_TYPE"), ({"limit": True}, "INVALID_TYPE"), ({"limit": 0}, "INVALID_LIMIT"), ({"camera_id": "c" * 129}, "IDENTIFIER_TOO_LONG"), ({"camera_id": 7}, "INVALID_TYPE"),
    ({"person_name": "n" * 33}, "IDENTIFIER_TOO_LONG"), ({"from": "2024-01-19T00:00:00Z"}, "EMPTY_RANGE"), ({"from": "2024-01-21T12:00:00Z", "to": "2024-01-21T13:00:00Z"}, "FUTURE_RANGE"),
])
def test_bad_plans_have_our_own_codes(change, code):
    with pytest.raises(search.PlanInvalid) as e:
        search.parse_plan(json.dumps(GOOD | change), NOW)
    assert e.value.code == code


@pytest.mark.parametrize(("text", "code"), [("no plan", "NOT_JSON"), ("[1, 2]", "NOT_OBJECT"), ("{" + "x" * 8192, "PLAN_TOO_LARGE"), ("{broken", "NOT_JSON")])
def test_bad_texts_have_our_own_codes(text, code):
    with pytest.raises(search.PlanInvalid) as e:
        search.parse_plan(text, NOW)
    assert e.value.code == code


def test_plans_are_mended_and_noted():
    plan = search.parse_plan("Sure:\n" + json.dumps(GOOD | {"from": "2024-01-01T00:00:00Z", "to": "2024-02-01T00:00:00Z", "limit": 900, "person_name": " Kim ", "person_presence": "ABSENT", "camera_id": "  "}) + " ok?", NOW)
    assert (plan.stop, plan.start, plan.limit, plan.person_name, plan.presence, plan.camera_id, plan.notes) == (NOW, NOW - timedelta(days=7), 50, "Kim", "absent", None, ("shortened", "limit_lowered"))
    moved = search.parse_plan(json.dumps(GOOD | {"from": "2024-01-20T21:00:00Z", "to": "2024-01-20T22:00:00Z"}), NOW)
    assert (moved.start.hour, moved.notes, moved.presence, moved.limit) == (9, ("moved_back",), "any", 50)


def test_a_planner_is_asked_again():
    answers = iter(["nonsense", json.dumps(GOOD)])
    assert search.plan_question("?", lambda _: next(answers), NOW).limit == 50
    with pytest.raises(search.PlanInvalid):
        search.plan_question("?", lambda _: "nonsense", NOW)


def test_nobody_identified_means_no_condition(spark):
    rows = spark.createDataFrame([(1, ["a"]), (2, []), (3, None)], "id long, people array<string>")
    people = spark.createDataFrame([("a", "Kim")], "student_id string, name string")
    plan = search.parse_plan(json.dumps(GOOD | {"person_name": "Kim"}), NOW)
    ids = lambda found, scanned: sorted(r.id for r in search.presence_filter(found, scanned, people, plan).collect())
    assert ids(rows, rows) == [1] and ids(rows, rows.where("id > 1")) == [1, 2, 3]
    assert search.presence_filter(rows, rows, people.where("false"), plan).count() == 3


def write(path, name: str, text: str) -> str:
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text, encoding="utf-8")
    return str(path)


def test_readers_end_at_malformed_input(spark, tmp_path):
    good = write(tmp_path / "a", "x.json", '{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in readers.json_lines(spark, good, "a long").collect()) == [1, 2]
    for k, bad in enumerate(('{"a": 1}\nbroken\n', '{"a": "text"}\n')):
        with pytest.raises(FAILURES):
            readers.json_lines(spark, write(tmp_path / f"b{k}", "x.json", bad), "a long").collect()
    with pytest.raises(FAILURES):
        readers.json_document(spark, write(tmp_path / "c", "x.json", '{"a": '), "a long").collect()
    for k, bad in enumerate(("path,other\na,1\n", "path,value\na,1\na,2\n", "path,value\n ,1\n")):
        with pytest.raises(FAILURES):
            readers.two_column_map(spark, write(tmp_path / f"d{k}", "x.csv", bad), "path", "value").collect()
    for k, bad in enumerate(("a/b,dataset,ref", "s1,other,ref", "s1,dataset,", "s1,dataset,ref\ns1,excluded,")):
        with pytest.raises(FAILURES):
            readers.assignments(spark, write(tmp_path / f"e{k}", "x.csv", f"session_id,role,approval\n{bad}\n"), ["approval"]).collect()
    assert readers.assignments(spark, write(tmp_path / "f", "x.csv", "session_id,role,approval\ns1,dataset,ref\ns2,excluded,\n"), ["approval"]).count() == 2


def test_settings_refuse_what_they_do_not_know():
    values = {f: getattr(readers.Settings(), f) for f in readers.Settings.__dataclass_fields__}
    assert readers.Settings.load(values) == readers.Settings()
    for bad in (values | {"other": 1}, {k: v for k, v in values.items() if k != "scan_limit"}, values | {"identity_threshold": 1.5}, values | {"scan_limit": True}, values | {"seat_hold_seconds": -1}):
        with pytest.raises(ValueError, match="unknown|out of range"):
            readers.Settings.load(bad)


def test_files_are_found_below_a_folder(spark, tmp_path):
    write(tmp_path / "a" / "b", "x.mp4", "one")
    write(tmp_path / "a", "y.mp4", "three")
    write(tmp_path / "a", "z.txt", "no")
    assert Counter(r.length for r in readers.files(spark, str(tmp_path / "a"), "*.mp4").collect()) == Counter([3, 5])


def test_writers_refuse_what_they_cannot_hold(spark, tmp_path):
    rows = spark.range(12)
    assert '"id":11' in writers.report_page(rows, "t", ["id"], most=12).first().html
    with pytest.raises(FAILURES):
        writers.report_page(rows, "t", ["id"], most=11).collect()
    with pytest.raises(ValueError, match="salt"):
        writers.anonymised(rows, "id", ["id"], ["id"], 5, "")
    with pytest.raises(ValueError, match="audit"):
        writers.merged_back(rows.withColumn("label", F.lit(1)), spark.createDataFrame([(99, 1)], "id long, label int"), "id")
    root = str(tmp_path / "p")
    assert [writers.publish(rows, root, f) for f in ("x", "y", "x")] == [1, 2, 1]
    assert [tuple(r) for r in writers.published(spark, root)] == [(1, "x"), (2, "y")]


def test_a_batch_applied_twice_is_applied_once(spark):
    stored = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "id long, version int, v string")
    changes = spark.createDataFrame([(1, 1, "x", 1), (1, 1, "y", 2), (2, 4, "z", 3), (9, 1, "n", 4)], "id long, expected int, v string, at int")
    once = writers.applied(stored, changes, "id", "version", "expected", "at")
    twice = writers.applied(once, changes, "id", "version", "expected", "at")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, 2, "y"), (2, 5, "b")]


def streamed(spark, tmp_path, rows: list[tuple], schema: str, make, out: str, key: list[str], order: list[str], parts: int) -> list:
    """The rows as files of one micro-batch each, through ``live``."""
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(source)
    stream = hosts.live(pipelines.parquet_stream(spark, source, T.StructType.fromDDL(schema)), key, order, make, out)
    query = stream.writeStream.foreachBatch(lambda b, e: b.write.mode("append").parquet(sink)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return list(map(tuple, spark.read.schema(out).parquet(sink).collect()))


def decision_rows() -> tuple[list[tuple], str]:
    rng = np.random.default_rng(5)
    rows, at = [], datetime(2024, 1, 1)
    for i in range(240):
        at += timedelta(seconds=float(rng.integers(1, 60)))
        seat = [None, "s1", "s2"][int(rng.integers(0, 3))]
        rows.append((f"p{i % 3}", i, at - timedelta(seconds=300 * (i % 19 == 0)), seat, 0.9 if seat and i % 4 else None, 0.8 if i % 7 == 0 else None, None if i % 23 == 0 else "s1", ["VACANT", "OCCUPIED", "UNKNOWN"][i % 3], None))
    return rows, "student string, id long, observed_at timestamp, seat_id string, identity double, outside double, assigned_seat_id string, seat_state string, held_state string"


@pytest.mark.parametrize("parts", [1, 5])
@pytest.mark.parametrize(("make_rows", "make", "key", "order", "out"), [
    (decision_rows, steps.Decision, ["student"], ["id"], "id long, state string, reason string, changed boolean"),
])
def test_steps_say_the_same_live_and_in_replay(spark, tmp_path, make_rows, make, key, order, out, parts):
    rows, schema = make_rows()
    want = Counter(map(tuple, hosts.replay(spark.createDataFrame(rows, schema), key, order, make, out).collect()))
    got = Counter(streamed(spark, tmp_path, rows, schema, make, out, key, order, parts))
    assert got == want and sum(want.values()) > 10


def test_an_interrupted_upsert_is_the_same_again(spark, tmp_path):
    """A batch that runs twice, as after a lost driver, gives the same; so does what is folded into one table."""
    sink, path = pipelines.upsert_latest(str(tmp_path / "v"), ["k"], ["t"]), str(tmp_path / "v")
    batches = [[("a", 1), ("b", 2)], [("a", 3), ("c", 1)], [("a", 2), ("b", 5)]]
    for epoch, rows in enumerate(batches):
        for _ in range(2):
            sink(spark.createDataFrame(rows, "k string, t long"), epoch)
    pipelines.compact(spark, path, f"{path}2", ["k"], ["t"])
    for p in (path, f"{path}2"):
        assert sorted((r.k, r.t) for r in pipelines.current(spark, p, ["k"], ["t"]).collect()) == [("a", 3), ("b", 5), ("c", 1)]

"""Readers with explicit schemas: malformed input fails with its place, nothing is inferred."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a report event and what stands for a missing one.
EVENT_DEFAULTS = {"period": "", "observed_at": "", "seat_number": "", "student_id": "", "student_name": "", "student_state": "UNKNOWN"}


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object a line; blank lines are skipped, anything else that is no object of the schema ends the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def report_events(payloads: DataFrame, column: str = "payload", base64: bool = False) -> DataFrame:
    """Arrays of event objects, plain or base64, as rows of six strings; missing fields get their defaults, ``ordinal`` is the place in the array."""
    text = F.unbase64(column).cast("string") if base64 else F.col(column)
    kind = "array<struct<" + ",".join(f"{c}:string" for c in EVENT_DEFAULTS) + ">>"
    rows = payloads.select(F.posexplode(F.from_json(text, kind, {"mode": "FAILFAST"})).alias("ordinal", "e"))
    return rows.select("ordinal", *[F.coalesce(F.col(f"e.{c}"), F.lit(d)).alias(c) for c, d in EVENT_DEFAULTS.items()])


def recorded_days(days: DataFrame, recorded: DataFrame, day: str = "day") -> DataFrame:
    """``days`` with recorded: whether the day has a file or partition; a day with one but without rows is recorded."""
    return days.join(recorded.select(day, F.lit(True).alias("recorded")).distinct(), day, "left").na.fill(False, ["recorded"])


def two_column_map(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """A CSV of a key and a value column; another header, a blank or a repeated key ends the read."""
    rows = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").schema(f"`{key}` string, `{value}` string").csv(path)
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    checked = rows.join(repeated, key)
    return checked.select(key, value, guard(F.trim(key) == "", "blank key").alias("__a"), guard(F.col("__n") > 1, "repeated key").alias("__b")).where("__a and __b").select(key, value)


def guard(bad: Column, message: str) -> Column:
    """True; an error where ``bad`` holds."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))


def labels(spark: SparkSession, path: str, epsilon: float = 1e-6) -> DataFrame:
    """(file, class, cx, cy, w, h, valid) of box label files: five numbers a line, class 0, inside the frame."""
    return parse_labels(spark.read.text(path).select(F.input_file_name().alias("file"), "value"), epsilon)


def parse_labels(lines: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    part = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.trim("value") != "").select(*[c for c in lines.columns if c != "value"], F.size(part).alias("__n"), F.try_to_number(F.get(part, F.lit(0)), F.lit("999999")).cast("int").alias("class"), *[F.get(part, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)])
    low, high = -epsilon, 1 + epsilon
    x1, x2, y1, y2 = F.col("cx") - F.col("w") / 2, F.col("cx") + F.col("w") / 2, F.col("cy") - F.col("h") / 2, F.col("cy") + F.col("h") / 2
    ok = (F.col("__n") == 5) & (F.col("class") == 0) & (F.col("w") > 0) & (F.col("h") > 0) & (x1 >= low) & (y1 >= low) & (x2 <= high) & (y2 <= high)
    return rows.withColumn("valid", F.coalesce(ok, F.lit(False))).drop("__n")


def files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of the files below a path; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def manifest(rows: DataFrame, now: Column) -> DataFrame:
    """``rows`` (source_id, captured_at text, expires_at text, approval) with ``problem``: the first rule that a row breaks, or null."""
    from tessella.functions.text import is_safe_id
    from tessella.functions.timefmt import parse_aware
    from tessella.operators.filters import first_failure

    rules = [
        ("BAD_ID", ~is_safe_id(F.col("source_id"))), ("NAIVE_TIME", parse_aware(F.col("captured_at")).isNull()),
        ("EXPIRED", F.coalesce(parse_aware(F.col("expires_at")) <= now, F.lit(True))), ("NOT_APPROVED", F.col("approval").isNull() | (F.trim("approval") == "")),
    ]
    return rows.withColumn("problem", first_failure(rules))


def point_lookup(rows: DataFrame, id_col: str, value) -> DataFrame:
    return rows.where(F.col(id_col) == value)


def multi_lookup(rows: DataFrame, id_col: str, wanted: list | DataFrame) -> DataFrame:
    """Rows of the wanted ids; ids that do not occur give nothing. A table of ids is a semi join."""
    if isinstance(wanted, list):
        return rows.where(F.col(id_col).isin(wanted))
    return rows.join(wanted.select(F.col(wanted.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")


@dataclass(frozen=True)
class Settings:
    """Thresholds with their ranges; ``load`` refuses unknown, missing and out-of-range entries."""

    confidence_threshold: float = 0.3
    identity_threshold: float = 0.5
    seat_hold_seconds: float = 5.0
    identity_hold_seconds: float = 15.0
    absent_grace_seconds: float = 300.0
    scan_limit: int = 500
    max_span_days: int = 7

    @classmethod
    def load(cls, values: dict) -> Settings:
        names = {f.name for f in fields(cls)}
        if set(values) != names:
            raise ValueError(f"unknown {sorted(set(values) - names)}, missing {sorted(names - set(values))}")
        made = cls(**values)
        for f in fields(cls):
            v = getattr(made, f.name)
            if isinstance(v, bool) or not isinstance(v, int | float) or v < 0 or (f.name.endswith("threshold") and v > 1):
                raise ValueError(f"{f.name} is out of range")
        return made


#: The roles that a session may have.
ROLES = ("dataset", "evaluation", "excluded")


def assignment_problems(rows: DataFrame, approvals: list[str], session: str = "session_id", role: str = "role") -> DataFrame:
    """Session assignments with problem: BAD_ID, BAD_ROLE, MISSING_APPROVAL (of a session that is not excluded), REPEATED, the first that holds, or null."""
    from tessella.functions.text import is_safe_id
    from tessella.operators.filters import first_failure, incomplete

    n = rows.groupBy(F.trim(session).alias("__id")).agg(F.count(F.lit(1)).alias("__n"))
    trimmed = rows.withColumn("__id", F.trim(session)).join(n, "__id", "left")
    rules = [("BAD_ID", ~is_safe_id(F.col("__id"))), ("BAD_ROLE", ~F.coalesce(F.col(role).isin(*ROLES), F.lit(False))), ("MISSING_APPROVAL", incomplete(F.col(role), [F.col(c) for c in approvals])), ("REPEATED", F.col("__n") > 1)]
    return trimmed.withColumn("problem", first_failure(rules)).drop("__id", "__n")


def assignments(spark: SparkSession, path: str, approvals: list[str]) -> DataFrame:
    """A CSV of session assignments; the first row with a problem ends the read."""
    names = ["session_id", "role", *approvals]
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").schema(schema).csv(path)
    checked = assignment_problems(rows, approvals)
    fails = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(" ", "problem", "session_id")).cast("boolean")).otherwise(F.lit(True))
    return checked.where(fails).select(*names)

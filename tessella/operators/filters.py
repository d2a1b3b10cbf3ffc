"""Predicates, projections and validation (each a column expression or a DataFrame-to-DataFrame function)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import geometry as g


def is_person(class_name: Column) -> Column:
    return F.coalesce(F.lower(class_name) == "person", F.lit(False))


def confidence_band(c: Column, low: float = 0.1, high: float = 0.5) -> Column:
    """``high`` from ``high`` on, ``low`` from ``low`` on, else null."""
    return F.when(c >= high, "high").when(c >= low, "low")


def detection_label(class_name: Column, confidence: Column, identity: Column, name: Column, active: Column, least: float, least_identity: float, hidden: str = "person") -> Column:
    """A name only where class, both confidences and the active flag allow it; ``hidden`` otherwise."""
    allowed = is_person(class_name) & (confidence >= least) & (identity >= least_identity) & active & name.isNotNull()
    return F.when(F.coalesce(allowed, F.lit(False)), name).otherwise(hidden)


def entry_label(status: Column, name: Column, active: Column) -> Column:
    known = F.coalesce(active, F.lit(False)) & name.isNotNull()
    return F.when(status == "UNCERTAIN", "uncertain").when((status == "REGISTERED") & known, name).otherwise("unknown")


def seat_state(occupied: Column, confidence: Column, least: float = 0.3) -> Column:
    """VACANT, UNKNOWN or OCCUPIED; the confidence counts for occupied evidence only."""
    return F.when(~occupied, "VACANT").when(confidence < least, "UNKNOWN").otherwise("OCCUPIED")


def freshness(last: Column, now: Column, limit: float = 10.0) -> Column:
    """connected within ``limit`` seconds, stale within twice that, else no_video; unknown without a time."""
    age = F.unix_micros(now) - F.unix_micros(last)
    return F.when(last.isNull(), "unknown").when(age < limit * 1e6, "connected").when(age < 2 * limit * 1e6, "stale").otherwise("no_video")


def mask_stale(rows: DataFrame, now: Column, seconds: float, time_col: str = "observed_at", state_col: str = "state", blank: tuple[str, ...] = ("seat", "confidence")) -> DataFrame:
    """For display: states older than ``seconds`` (strictly) are UNKNOWN without seat and confidence; what is stored stays."""
    stale = (F.unix_micros(now) - F.unix_micros(time_col)) > seconds * 1e6
    kinds = dict(rows.dtypes)
    return rows.withColumns({state_col: F.when(stale, "UNKNOWN").otherwise(F.col(state_col)), **{c: F.when(~stale, F.col(c)).cast(kinds[c]) for c in blank if c in kinds}})


def nested_any(array: Column, **wanted) -> Column:
    """Whether one element satisfies all wanted field values at once."""
    def fits(e):
        c = F.lit(True)
        for k, v in wanted.items():
            if v is not None:
                c = c & (e[k] == v)
        return c

    return F.coalesce(F.exists(array, fits), F.lit(False))


def valid_box(width: Column, height: Column, b: g.Box) -> Column:
    """A positive size and inside the frame."""
    return F.coalesce((b[0] >= 0) & (b[1] >= 0) & (b[2] > b[0]) & (b[3] > b[1]) & (b[2] <= width) & (b[3] <= height), F.lit(False))


def identity_consistent(student: Column, confidence: Column, face_box: Column) -> Column:
    """Student and confidence both or neither; a face box only with them."""
    return (student.isNull() == confidence.isNull()) & (face_box.isNull() | student.isNotNull())


def identity_payload(*fields: Column) -> Column:
    """JSON of the fields; nulls are left out."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})


def observation_valid(status: Column, student: Column, similarity: Column) -> Column:
    """REGISTERED needs a student and a similarity, UNCERTAIN no student, UNKNOWN neither; similarities lie between -1 and 1."""
    ranged = similarity.isNull() | similarity.between(-1, 1)
    fits = F.when(status == "REGISTERED", student.isNotNull() & similarity.isNotNull()).when(status == "UNCERTAIN", student.isNull()).when(status == "UNKNOWN", student.isNull() & similarity.isNull()).otherwise(False)
    return F.coalesce(fits & ranged, F.lit(False))


def needs_review(boxes: Column, least: float = 0.5, margin: float = 0.0, overlap: float = 0.7) -> Column:
    """For array<struct<x1, y1, x2, y2, confidence>> in shares of the frame: none at all, one below ``least``, one at the border, or a pair that overlaps."""
    def b(e):
        return e["x1"], e["y1"], e["x2"], e["y2"]

    weak = F.exists(boxes, lambda e: e["confidence"] < least)
    edge = F.exists(boxes, lambda e: (e["x1"] <= margin) | (e["y1"] <= margin) | (e["x2"] >= 1 - margin) | (e["y2"] >= 1 - margin))
    numbered = F.transform(boxes, lambda e, i: F.struct(e.alias("e"), i.alias("i")))
    pair = F.exists(numbered, lambda p: F.exists(numbered, lambda q: (p["i"] < q["i"]) & (g.iou(b(p["e"]), b(q["e"])) >= overlap)))
    return F.coalesce((F.size(boxes) == 0) | weak | edge | pair, F.lit(True))


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """The code of the first rule that holds, null where none does; a rule that is null does not hold."""
    return F.coalesce(*[F.when(c, code) for code, c in rules])


def pose(yaw: Column, pitch: Column, side: float = 15.0, up: float = 12.0, down: float = 10.0) -> Column:
    """front within the thresholds, else the direction that passes its own by the larger ratio; up and down have limits of their own."""
    across, along = F.abs(yaw) / side, F.when(pitch >= 0, pitch / up).otherwise(-pitch / down)
    return F.when((across <= 1) & (along <= 1), "front").when(across >= along, F.when(yaw > 0, "right").otherwise("left")).otherwise(F.when(pitch >= 0, "up").otherwise("down"))


def approved(kind: Column, expires: Column, now: Column, allowed: list[str]) -> Column:
    """An allowed kind of approval that has not run out."""
    return F.coalesce(kind.isin(allowed) & (expires > now), F.lit(False))


def split_valid(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows and bad rows; null counts as bad."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """The codes of all rules that hold, in order."""
    return F.filter(F.array(*[F.when(c, code) for code, c in rules]), lambda x: x.isNotNull())


def schedule_lines(lines: DataFrame, text_col: str = "value", keep: list[str] | None = None) -> DataFrame:
    """(start, stop, name), behind the columns to ``keep``, of ``**HH:MM ~ HH:MM** | name`` lines whose name speaks of a study period."""
    form = r"\*\*(\d{2}:\d{2})\s*~\s*(\d{2}:\d{2})\*\*\s*\|\s*(.+?)\s*(?:\||$)"
    part = [F.regexp_extract(text_col, form, i).alias(n) for i, n in ((1, "start"), (2, "stop"), (3, "name"))]
    #: Words that mark a study period.
    words = ("자습", "교시", "study", "period")
    return lines.where(F.col(text_col).rlike(form)).select(*(keep or []), *part).where(F.lower("name").rlike("|".join(words)))


def every_nth(rows: DataFrame, n: int, index_col: str = "frame_index") -> DataFrame:
    if n < 1:
        raise ValueError("n has to be 1 or more")
    return rows.where(F.col(index_col) % n == 0)


def preflight(rows: DataFrame, row_col: str, column_col: str, active_col: str) -> DataFrame:
    """Counts of complete, empty and partial coordinates, and of active rows without any."""
    r, c, a = F.col(row_col), F.col(column_col), F.col(active_col)
    return rows.agg(
        F.count_if(r.isNotNull() & c.isNotNull()).alias("complete"), F.count_if(r.isNull() & c.isNull()).alias("empty"),
        F.count_if(r.isNull() != c.isNull()).alias("partial"), F.count_if(a & r.isNull() & c.isNull()).alias("active_empty"),
    )


def usable_zone(auto_generated: Column, revision: Column, current: Column) -> Column:
    """A zone drawn by hand on the current image, or on no image at all (revision 0)."""
    return ~auto_generated & F.coalesce((revision == 0) | (revision == current), F.lit(False))


def valid_batches(rows: DataFrame, seats: DataFrame, batch: str, seat: str, confidence: str, most: int = 200) -> DataFrame:
    """(batch, valid): 1 to ``most`` rows, no seat twice, confidences finite and from 0 to 1, and every seat among ``seats``."""
    known = rows.join(seats.select(seat, F.lit(True).alias("__known")).distinct(), seat, "left")
    c = F.col(confidence).cast("double")
    fits = F.coalesce(c.between(0, 1) & ~F.isnan(c) & F.col("__known"), F.lit(False))
    return known.groupBy(batch).agg((F.count(F.lit(1)).between(1, most) & (F.count_distinct(seat) == F.count(F.lit(1))) & F.bool_and(fits)).alias("valid"))


def incomplete(role: Column, approvals: list[Column]) -> Column:
    """A blank role, or a role other than excluded with an approval field that is blank."""
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    missing = F.lit(False)
    for c in approvals:
        missing = missing | blank(c)
    return blank(role) | ((role != "excluded") & missing)

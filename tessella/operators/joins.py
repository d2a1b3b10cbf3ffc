"""Joins with uniqueness, interval, spatial and vector conditions.

Dimension tables of a known small size may be broadcast by the caller or by Spark's own size check;
nothing here forces it, but where a table is a bounded literal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import geometry as g
from tessella.functions import vectors as v
from tessella.session import cut_lineage


def first_per_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def active_assignments(assignments: DataFrame, seats: DataFrame, students: DataFrame) -> DataFrame:
    """assignments(seat_id, student_id, room), seats(seat_id, code, room, active), students(student_id, number, name, active).

    Rows whose seat is of another room or inactive, or whose student is missing or inactive, go; of
    several seats of a student the first by (code, seat, number, student) stays.
    """
    s = seats.where("active").select("seat_id", "code", F.col("room").alias("seat_room"))
    p = students.where("active").select("student_id", "number", "name")
    joined = assignments.join(s, "seat_id").where("room = seat_room").join(p, "student_id")
    return first_per_key(joined, ["student_id"], ["code", "seat_id", "number", "student_id"]).select("student_id", "name", "seat_id", "code", "room")


def enrich(rows: DataFrame, dimension: DataFrame, key: str, columns: list[str], blank: str = "") -> DataFrame:
    """Left join; a missing or inactive dimension row gives ``blank``."""
    d = dimension.select(key, *columns)
    return rows.join(d, key, "left").withColumns({c: F.coalesce(F.col(c), F.lit(blank)) for c in columns})


def state_view(assignments: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """Every assignment with its state; without one UNKNOWN, SEAT_NOT_OBSERVED."""
    joined = assignments.join(states.select(key, "state", "reason"), key, "left")
    return joined.withColumns({"state": F.coalesce("state", F.lit("UNKNOWN")), "reason": F.coalesce("reason", F.lit("SEAT_NOT_OBSERVED"))})


def map_points(points: DataFrame, zones: list[tuple[str, list[tuple[float, float]]]], x: str = "x", y: str = "y") -> DataFrame:
    """``points`` with zone and match: MATCHED in exactly one polygon, AMBIGUOUS in several, NO_MATCH in none, INVALID_INPUT for null or non-finite places.

    The zones, a short literal list, become expressions: no join, one pass, edges included.
    """
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    valid = F.coalesce(~F.isnan(px) & ~F.isnan(py) & (F.abs(px) != float("inf")) & (F.abs(py) != float("inf")), F.lit(False))
    hits = F.filter(F.array(*[F.when(g.contains(p, px, py), name) for name, p in zones]), lambda h: h.isNotNull()) if zones else F.array().cast("array<string>")
    rows = points.withColumns({"__ok": valid, "__hits": F.when(valid, hits)})
    n = F.size("__hits")
    match = F.when(~F.col("__ok"), "INVALID_INPUT").when(n == 1, "MATCHED").when(n > 1, "AMBIGUOUS").otherwise("NO_MATCH")
    return rows.withColumns({"match": match, "zone": F.when(n == 1, F.get("__hits", F.lit(0)))}).drop("__ok", "__hits")


def map_points_to_table(points: DataFrame, zones: DataFrame, id_col: str, x: str = "x", y: str = "y", cells: int = 32) -> DataFrame:
    """The same against a table zones(zone, polygon) of any size: polygons go to the grid cells their boxes meet, points to theirs, and both meet by cell."""
    def cell(c: Column) -> Column:
        return F.greatest(F.least(F.floor(c * cells), F.lit(cells - 1)), F.lit(0)).cast("int")

    xs, ys = F.transform("polygon", lambda p: p["x"]), F.transform("polygon", lambda p: p["y"])
    z = zones.select("zone", "polygon", F.explode(F.sequence(cell(F.array_min(xs)), cell(F.array_max(xs)))).alias("__cx"), F.sequence(cell(F.array_min(ys)), cell(F.array_max(ys))).alias("__ys"))
    z = z.select("zone", "polygon", "__cx", F.explode("__ys").alias("__cy"))
    p = points.select(id_col, x, y, cell(F.col(x)).alias("__cx"), cell(F.col(y)).alias("__cy"))
    hit = p.join(z, ["__cx", "__cy"]).where(g.contains_polygon(F.col("polygon"), F.col(x), F.col(y)))
    each = hit.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n"), F.min("zone").alias("zone"))
    out = points.join(each, id_col, "left")
    n = F.coalesce("__n", F.lit(0))
    return out.withColumns({"match": F.when(F.col(x).isNull() | F.col(y).isNull(), "INVALID_INPUT").when(n == 1, "MATCHED").when(n > 1, "AMBIGUOUS").otherwise("NO_MATCH"), "zone": F.when(n == 1, F.col("zone"))}).drop("__n")


def seat_evidence(detections: DataFrame, seats: DataFrame, held: DataFrame, frame: str, least: float) -> DataFrame:
    """One row for each frame and seat: the seat's best detection (the first of equal ones), else what is held, else a weak detection, else vacant.

    detections(frame, seat, idx, confidence), seats(frame, seat), held(frame, seat, held_confidence).
    """
    best = detections.groupBy(frame, "seat").agg(F.max_by(F.struct("confidence", "idx"), F.struct("confidence", -F.col("idx"))).alias("b"))
    rows = seats.join(best, [frame, "seat"], "left").join(held, [frame, "seat"], "left")
    c, h = F.col("b.confidence"), F.col("held_confidence")
    strong, weak = c >= least, c.isNotNull()
    return rows.select(
        frame, "seat", (strong | h.isNotNull() | weak).alias("o"), F.coalesce(F.when(strong, c), h, c, F.lit(0.0)).alias("confidence"),
        F.when(strong, "detected").when(h.isNotNull(), "held").when(weak, "weak").otherwise("vacant").alias("source"),
    ).withColumn("occupied", F.col("source") != "vacant").drop("o")


def unseated(matches: DataFrame, student: str, confidence: str, least: float) -> DataFrame:
    """The largest confidence of each identified student outside every zone; ambiguous matches are not outside."""
    rows = matches.where((F.col("match") == "NO_MATCH") & F.col(student).isNotNull() & (F.col(confidence) >= least))
    return rows.groupBy(student).agg(F.max(confidence).alias("confidence"))


def interval_pairs(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, before: float, after: float) -> DataFrame:
    """Pairs of a key with right time - left time in [-before, after] seconds.

    Times go to bins as wide as the interval, left rows to the bins their interval meets (three at most),
    so the join is on (key, bin) and a key with many rows does not meet itself whole.
    """
    width = max(int((before + after) * 1e6), 1)
    lt, rt = F.unix_micros(left_time), F.unix_micros(right_time)
    bins = F.sequence(F.floor((lt - int(before * 1e6)) / width), F.floor((lt + int(after * 1e6)) / width))
    a = left.withColumn("__bin", F.explode(bins))
    b = right.withColumn("__bin", F.floor(rt / width))
    wait = F.unix_micros(right_time) - F.unix_micros(left_time)
    return a.join(b, [key, "__bin"]).drop("__bin").where((wait >= -int(before * 1e6)) & (wait <= int(after * 1e6)))


def unique_pairs(pairs: DataFrame, left_id: str, right_id: str, within: list[str] | None = None) -> DataFrame:
    """Pairs whose both ends occur in no other pair (``within`` None), or that are the only pair of their group."""
    if within is not None:
        only = pairs.groupBy(*within).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select(*within)
        return pairs.join(only, within, "left_semi")
    a = pairs.groupBy(left_id).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select(left_id)
    b = pairs.groupBy(right_id).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select(right_id)
    return pairs.join(a, left_id, "left_semi").join(b, right_id, "left_semi")


def recovered(lost: DataFrame, new: DataFrame, key: str, seconds: float = 3.0, low: float = 0.5, high: float = 2.0, shift: float = 0.08) -> DataFrame:
    """lost(key, lost_id, lost_at, lx, ly, lw, lh), new(key, new_id, new_at, nx, ny, nw, nh, diagonal): mutually unique pairs close in time, size and foot point.

    Boxes come as corner, width and height: sizes taken from the difference of two edges are rounded, and
    a ratio that lies on a bound would fall to either side of it.
    """
    pairs = interval_pairs(lost, new, key, "lost_at", "new_at", seconds, seconds)
    (ax, ay, aw, ah), (bx, by, bw, bh) = (tuple(F.col(f"{p}{c}").cast("double") for c in "xywh") for p in "ln")
    size = g.ratio(F.greatest(bw, F.lit(0.0)) * F.greatest(bh, F.lit(0.0)), F.greatest(aw, F.lit(0.0)) * F.greatest(ah, F.lit(0.0)))
    dx, dy = ax + aw / 2 - bx - bw / 2, ay + ah - by - bh
    near = pairs.where(size.between(low, high) & (F.sqrt(dx * dx + dy * dy) / F.col("diagonal") <= shift))
    return unique_pairs(near, "lost_id", "new_id")


def faces_to_people(people: DataFrame, faces: DataFrame, frame: str, least: float = 0.8) -> DataFrame:
    """faces with person and reason: a person's box holds the face's centre and ``least`` of its area; MULTIPLE_PEOPLE, MULTIPLE_FACES or NO_PERSON otherwise.

    people(frame, person, px1..py2), faces(frame, face, fx1..fy2).
    """
    p, f = (tuple(F.col(f"{k}{c}").cast("double") for c in ("x1", "y1", "x2", "y2")) for k in "pf")
    cx, cy = g.centre(f)
    inside = cx.between(p[0], p[2]) & cy.between(p[1], p[3]) & (g.ratio(g.intersection(p, f), g.area(f)) >= least)
    hits = faces.join(people, frame).where(inside).select(frame, "face", "person")
    each = hits.groupBy(frame, "face").agg(F.count(F.lit(1)).alias("__people"), F.min("person").alias("__person"))
    shared = hits.groupBy(frame, "person").agg(F.count(F.lit(1)).alias("__faces")).withColumnRenamed("person", "__person")
    rows = faces.join(each, [frame, "face"], "left").join(shared, [frame, "__person"], "left")
    reason = F.when(F.col("__people").isNull(), "NO_PERSON").when(F.col("__people") > 1, "MULTIPLE_PEOPLE").when(F.col("__faces") > 1, "MULTIPLE_FACES").otherwise("MATCHED")
    return rows.select(*faces.columns, F.when(reason == "MATCHED", F.col("__person")).alias("person"), reason.alias("reason"))


def gallery_top2(probes: DataFrame, gallery: DataFrame, probe_id: str, entry_id: str, vector: str = "vector", most_bytes: int = 256 << 20, salts: int = 16) -> DataFrame:
    """(probe, entry, similarity, margin): the best gallery entry of each probe by cosine and its lead over the second (over -1 if there is none).

    A gallery is a people list.  It is measured: up to ``most_bytes`` of numbers it goes out with the tasks
    as one matrix and each batch of probes is one product, with nothing shuffled.  Larger ones are dealt
    into blocks, each copied to a few salts, and every probe meets every block at its own salt.  Ties go
    to the lower entry; probes without a unit vector get no row.
    """
    q = probes.select(probe_id, F.col(vector).cast("array<double>").alias("__p")).where("__p is not null")
    e = cut_lineage(gallery.select(entry_id, v.normalised(F.col(vector)).alias("__g")).where("__g is not null"))
    n, size = e.agg(F.count(F.lit(1)), F.sum(8 * F.size("__g") + 16)).first()
    kinds = {**dict(q.dtypes), **dict(e.dtypes)}
    if n and size <= most_bytes:
        held = sorted(e.collect(), key=lambda r: r[0])
        ids, matrix = [r[0] for r in held], np.array([r[1] for r in held]).T

        def score(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = np.asarray(batch.column("__p").flatten()).reshape(batch.num_rows, -1)
                length = np.linalg.norm(own, axis=1)
                sound = np.isfinite(length) & (length > 1e-12)
                batch, found = batch.filter(pa.array(sound)), own[sound] / length[sound, None] @ matrix
                rows, first = np.arange(len(found)), found.argmax(axis=1)
                best = found[rows, first]
                found[rows, first] = -np.inf
                second = np.maximum(found.max(axis=1), -1.0) if n > 1 else np.full(len(found), -1.0)
                entries = pa.array([ids[i] for i in first], pa.int64() if isinstance(ids[0], int) else None)
                yield pa.RecordBatch.from_arrays([batch.column(probe_id), entries, pa.array(best), pa.array(best - second)], [probe_id, entry_id, "similarity", "margin"])

        wide = "long" if isinstance(ids[0], int) else kinds[entry_id]
        out = q.where(F.size("__p") == len(matrix)).mapInArrow(score, f"`{probe_id}` {kinds[probe_id]}, `{entry_id}` {wide}, similarity double, margin double")
        return out.withColumn(entry_id, F.col(entry_id).cast(kinds[entry_id]))
    q = q.select(probe_id, v.normalised(F.col("__p")).alias("__p")).where("__p is not null")
    blocks = -(-(size or 0) // most_bytes) or 1
    e = e.withColumns({"__block": F.pmod(F.xxhash64(entry_id), F.lit(blocks)), "__salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))})
    q = q.withColumns({"__salt": F.pmod(F.xxhash64(probe_id), F.lit(salts)).cast("int"), "__block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    pairs = q.join(e, ["__block", "__salt"])
    scored = pairs.select(probe_id, entry_id, v.dot(F.col("__p"), F.col("__g")).alias("similarity"))
    top = _top2(scored, probe_id, entry_id)
    return top.select(probe_id, F.col(f"b.{entry_id}").alias(entry_id), F.col("b.similarity").alias("similarity"), (F.get("two", F.lit(0)) - F.coalesce(F.get("two", F.lit(1)), F.lit(-1.0))).alias("margin"))


def _top2(scored: DataFrame, probe_id: str, entry_id: str) -> DataFrame:
    w = Window.partitionBy(probe_id).orderBy(F.desc("similarity"), entry_id)
    best = scored.withColumn("__r", F.row_number().over(w)).where("__r <= 2")
    return best.groupBy(probe_id).agg(F.min_by(F.struct(entry_id, "similarity"), "__r").alias("b"), F.sort_array(F.collect_list("similarity"), False).alias("two"))


def repaired_references(rows: DataFrame, people: DataFrame, id_col: str, number: str, name: str) -> DataFrame:
    """``rows`` with resolved and how: by id where number and name agree, else the one person of that number and name; ambiguous and missing ones stay null."""
    by_id = people.select(F.col(id_col).alias("__id"), F.col(number).alias("__no"), F.col(name).alias("__na"))
    by_name = people.groupBy(F.col(number).alias("__no2"), F.col(name).alias("__na2")).agg(F.count(F.lit(1)).alias("__n"), F.min(id_col).alias("__other"))
    joined = rows.join(by_id, F.col(id_col) == F.col("__id"), "left").join(by_name, (F.col(number) == F.col("__no2")) & (F.col(name) == F.col("__na2")), "left")
    same = (F.col(number) == F.col("__no")) & (F.col(name) == F.col("__na"))
    how = F.when(same, "id").when(F.col("__n") == 1, "number_and_name").when(F.col("__n") > 1, "ambiguous").otherwise("missing")
    return joined.select(*rows.columns, F.when(same, F.col(id_col)).when(F.col("__n") == 1, F.col("__other")).alias("resolved"), how.alias("how"))


def active_routes(routes: DataFrame, entries: DataFrame, rooms: DataFrame, entry: str, room: str) -> DataFrame:
    """Routes whose entry camera and room camera are both enabled and have those roles; entries, rooms(camera_id, enabled, role)."""
    usable = lambda rows, role, name: rows.where(F.col("enabled") & (F.col("role") == role)).select(F.col("camera_id").alias(name)).distinct()
    return routes.join(usable(entries, "entry", entry), entry, "left_semi").join(usable(rooms, "room", room), room, "left_semi")


def suggested_zones(shapes: DataFrame, zones: DataFrame, id_col: str) -> DataFrame:
    """``shapes`` (id, polygon) with x, y, their centres, and zone: the one zone that holds the centre; null for none or several."""
    x, y = g.centroid(F.col("polygon"))
    placed = map_points_to_table(shapes.select(id_col, x.alias("x"), y.alias("y")), zones, id_col)
    return shapes.join(placed.select(id_col, "x", "y", "zone"), id_col)


def routed_sessions(sessions: DataFrame, inventory: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """Inventory rows with their session's assignment, excluded sessions left out.

    Every session has to be assigned and every assignment to be a session's: else an error names the first that differs.
    """
    a, b = sessions.select(key, F.lit(1).alias("__s")).distinct(), assigned.select(key, F.lit(1).alias("__a")).distinct()
    odd = a.join(b, key, "full").where("__s is null or __a is null").agg(F.min(F.col(key).cast("string"))).first()[0]
    if odd is not None:
        raise ValueError(f"sessions and assignments differ at {odd}")
    return inventory.join(assigned.where(F.col("role") != "excluded"), key)


def reviewed_or_candidate(rows: DataFrame, reviews: DataFrame, id_col: str) -> DataFrame:
    """``rows`` (id, candidate) with approval and label: the reviewed label (human) where there is one, else the candidate's."""
    joined = rows.join(reviews.select(id_col, "reviewed"), id_col, "left")
    return joined.withColumns({"approval": F.when(F.col("reviewed").isNotNull(), "human").otherwise("candidate"), "label": F.coalesce("reviewed", "candidate")}).drop("reviewed")


def registration_problems(asked: DataFrame, taken: DataFrame, rooms: DataFrame, roles: list[str]) -> DataFrame:
    """``asked`` (camera_id, room, role) with problem: a role that is not known, an id that is taken, a room that is not active; null where none holds."""
    used = taken.select("camera_id", F.lit(True).alias("__taken")).distinct()
    known = rooms.select("room", F.lit(True).alias("__room")).distinct()
    rows = asked.join(used, "camera_id", "left").join(known, "room", "left")
    problem = F.when(~F.col("role").isin(roles), "BAD_ROLE").when(F.col("__taken"), "TAKEN").when(F.col("__room").isNull(), "UNKNOWN_ROOM")
    return rows.withColumn("problem", problem).drop("__taken", "__room")

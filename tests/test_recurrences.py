"""Recurrences over whole keys: prefix scans and timed steps against plain loops, with a key that holds most rows."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import scan, windows
from tessella.plans import catalog, flows, sequences
from tessella.streaming import hosts
from tessella.streaming.handover import SECOND, Handover
from tessella.streaming.tracking import Tracker

START = datetime(2024, 3, 1, tzinfo=UTC)
SCHEMA = "k string, id long, ts timestamp, value double, state string"


def rows(n: int = 900, seed: int = 3) -> list[tuple]:
    """Two thirds of the rows in one key, one key of a single row, null keys, values and states, equal times."""
    rng = np.random.default_rng(seed)
    at, out = START, []
    for i in range(n):
        at += timedelta(seconds=int(rng.integers(0, 40)))
        key = "hot" if i % 3 else [None, "a", "b", "c"][int(rng.integers(0, 4))]
        out.append((key, i, at, round(float(rng.normal() * 50), 3), "xyz"[int(rng.integers(0, 3))]))
    return [*out, ("alone", n, at, 5.0, None)]


def by_key(table: list[tuple]) -> dict:
    out: dict = {}
    for r in sorted(table, key=lambda r: (r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(7)


@pytest.mark.parametrize("block", [2, 5, 128])
@pytest.mark.parametrize("keep", [0.0, 0.35, 0.99, 1.0])
def test_smoothing_is_the_recurrence(df, block, keep):
    got = {r.id: (r.s, r.t) for r in scan.smoothed(df, ["k"], ["ts", "id"], {"s": F.col("value"), "t": F.col("id")}, keep, block).collect()}
    assert len(got) == 901
    for own in by_key(rows()).values():
        s = t = None
        for _, i, _, value, _ in own:
            s, t = (value, i) if s is None else (keep * s + (1 - keep) * value, keep * t + (1 - keep) * i)
            assert got[i] == pytest.approx((s, t), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("keep", [0.7, 0.99])
def test_velocity_is_the_recurrence(df, keep):
    got = {r.id: r.velocity for r in scan.velocity(df, ["k"], ["ts", "id"], "ts", "value", keep, block=4).collect()}
    for own in by_key(rows()).values():
        v = None
        for before, now in zip([None, *own], own, strict=False):
            if before is not None:
                change = (now[3] - before[3]) / max((now[2] - before[2]).total_seconds(), 1e-3)
                v = change if v is None else keep * v + (1 - keep) * change
            assert got[now[1]] == (None if v is None else pytest.approx(v, rel=1e-9, abs=1e-9))


def test_holds_and_runs(df):
    held = {r.id: r.held_value for r in scan.held(df, ["k"], ["ts", "id"], "ts", F.col("value") > 60, 120, "value", block=3).collect()}
    runs = {(r.k, r.run): (r.n, r.is_long) for r in scan.absence_runs(df, ["k"], ["ts", "id"], "ts", F.col("value") <= 30, 200, block=3).collect()}
    want: dict = {}
    for key, own in by_key(rows()).items():
        last, run = None, 0
        for _, i, at, value, _ in own:
            if value > 60:
                last = (at, value)
            assert held[i] == (last[1] if last and (at - last[0]).total_seconds() <= 120 else None)
            if value > 30:
                run += 1
            else:
                want.setdefault((key, run), []).append(at)
    assert runs == {k: (len(v), (max(v) - min(v)).total_seconds() >= 200) for k, v in want.items()}


def test_nulls_stay_until_a_new_start(spark):
    table = spark.createDataFrame([("k", i, v, a) for i, (v, a) in enumerate([(1.0, 0.0), (None, 1.0), (2.0, 1.0), (3.0, 0.0), (float("nan"), 0.5), (1.0, 0.5), (4.0, 0.0)])], "k string, i long, v double, a double")
    own = scan.numbered(table, ["k"], ["i"])
    for block in (2, 50):
        got = [r.y for r in scan.scan(own, ["k"], "__at", F.col("a"), {"y": F.col("v")}, block=block).orderBy("i").collect()]
        assert got[:4] == [1.0, None, None, 3.0] and got[4] != got[4] and got[5] != got[5] and got[6] == 4.0
    assert scan.smoothed(table.limit(0), ["k"], ["i"], {"y": F.col("v")}, 0.5).count() == 0


def test_no_task_folds_a_key(df):
    """A key's rows meet in blocks, each a group of its own, and none is longer than the block."""
    own = scan.numbered(df, ["k"], ["ts", "id"])
    blocks = scan._blocks(own.select("k", F.lit(1.0).alias("__a"), F.array(F.lit(1.0)).alias("__b"), "__at"), ["k"], "__at", 16, [])
    assert blocks.agg(F.max(F.size("__maps"))).first()[0] <= 16
    assert blocks.where("k = 'hot'").count() == 38 and blocks.where("k is null").count() > 1


def test_late_rows_are_not_applied(df):
    got = {r.id: (r.from_state, r.applied, r.changed) for r in windows.applied(df, "k", ["value", "id"], "ts", "state").collect()}
    keys: dict = {}
    for r in sorted(rows(), key=lambda r: (r[3], r[1])):
        keys.setdefault(r[0], []).append(r)
    for own in keys.values():
        newest, state = None, "UNKNOWN"
        for _, i, at, _, new in own:
            ok = newest is None or at >= newest
            assert got[i] == (state, ok, ok and new != state)
            if ok:
                newest, state = at, new


# --- handover ---------------------------------------------------------------------------------------------------

ROUTES = "route string, at long, id long, kind string, face_track string, student string, similarity double, track string, inside boolean"
TOLD = "route string, at long, kind string, id long, entered boolean, status string, outcome string, track string, student string, similarity double, waited double"


def visits(seed: int, n: int = 400) -> list[tuple]:
    """Faces and tracks of two routes over half an hour, some silent for minutes, with identities that change and tracks that come back."""
    rng = np.random.default_rng(seed)
    at, out = 1_700_000_000 * SECOND, []
    for i in range(n):
        at += int(rng.integers(0, 3_000_000)) + (45 * SECOND if rng.random() < 0.04 else 0)
        route = "r1" if rng.random() < 0.8 else "r2"
        if rng.random() < 0.4:
            face = int(rng.integers(0, 6))
            out.append((route, at, i, "face", f"f{face}", None if rng.random() < 0.1 else f"s{(face + (rng.random() < 0.15)) % 5}", round(float(rng.random()), 2), None, None))
        else:
            out.append((route, at, i, "track", None, None, None, f"t{rng.integers(0, 8)}", bool(rng.random() < 0.5)))
    return out


def plain_handover(table: list[tuple], delay=8.0, skew=0.5, stale=30.0, least=0.5, end=None) -> list[tuple]:
    """The rules once more, with lists of records and a clock that stops at every moment at which something turns too old."""
    told = []
    for route in sorted({r[0] for r in table}):
        faces, waiting, used, zone, active = [], [], {}, {}, []
        clock = None

        def match(now):
            for f in [f for f in faces if any(a["student"] == f["student"] for a in active)]:
                faces.remove(f)
                used[f["face"]] = f["seen"]
            pairs = {}
            for f in faces:
                for w in waiting:
                    if -skew * SECOND <= w["came"] - f["seen"] <= delay * SECOND:
                        best = pairs.get((f["student"], w["track"]))
                        if best is None or f["seen"] > best["seen"]:
                            pairs[f["student"], w["track"]] = f
            if len(pairs) == 1:
                (student, track), f = next(iter(pairs.items()))
                came = next(w["came"] for w in waiting if w["track"] == track)
                waiting[:] = [w for w in waiting if w["track"] != track]
                active.append({"track": track, "student": student, "sure": f["sure"], "seen": came, "face": f["seen"], "told": False})
                for g in [g for g in faces if g["student"] == student]:
                    faces.remove(g)
                    used[g["face"]] = g["seen"]
                told.append((route, now, "match", None, None, None, "accepted", track, student, f["sure"], None))
            elif pairs:
                told.append((route, now, "match", None, None, None, "ambiguous", None, None, None, None))

        def pass_time(limit):
            nonlocal clock
            while True:
                moments = [f["seen"] + delay * SECOND for f in faces] + [w["came"] + (delay + skew) * SECOND for w in waiting] + [t + stale * SECOND for t in used.values()] + [t + stale * SECOND for _, t in zone.values()] + [a["seen"] + stale * SECOND for a in active]
                moment = min(moments, default=None)
                if moment is None or (limit is not None and moment + 1 > limit):
                    return
                now = clock = max(clock, int(moment) + 1)
                n = len(faces) + len(waiting)
                faces[:] = [f for f in faces if now - f["seen"] <= delay * SECOND]
                waiting[:] = [w for w in waiting if now - w["came"] <= (delay + skew) * SECOND]
                for d in (used, zone):
                    for k in [k for k, v in d.items() if now - (v[1] if d is zone else v) > stale * SECOND]:
                        del d[k]
                active[:] = [a for a in active if now - a["seen"] <= stale * SECOND]
                if len(faces) + len(waiting) < n:
                    match(now)

        for _, at, i, kind, face, student, sure, track, inside in sorted((r for r in table if r[0] == route), key=lambda r: (r[1], r[2])):
            pass_time(at)
            clock = at
            place = len(told)
            told.append(None)
            if kind == "face":
                known = next((f for f in faces if f["face"] == face), None)
                if student is None or sure < least:
                    status = "unknown"
                elif any(a["student"] == student for a in active):
                    status = "held"
                elif face in used:
                    status, used[face] = "used", at
                elif known and known["student"] != student:
                    status = "locked"
                else:
                    status = "pending"
                    if known:
                        known.update(sure=sure, seen=at)
                    else:
                        faces.append({"face": face, "student": student, "sure": sure, "seen": at})
                    match(at)
                told[place] = (route, at, kind, i, None, status, None, None, student, sure, None)
                continue
            entered = inside and not zone.get(track, (False, 0))[0]
            zone[track] = (inside, at)
            own = next((a for a in active if a["track"] == track), None)
            if own:
                own["seen"] = at
            elif entered and not any(w["track"] == track for w in waiting):
                waiting.append({"track": track, "came": at})
                match(at)
            own = next((a for a in active if a["track"] == track), None)
            if own:
                told[place] = (route, at, kind, i, entered, "attached", None, track, own["student"], own["sure"], None if own["told"] else (at - own["face"]) / SECOND)
                own["told"] = True
            else:
                told[place] = (route, at, kind, i, entered, "waiting" if any(w["track"] == track for w in waiting) else "plain", None, track, None, None, None)
        if clock is not None:
            pass_time(end)
    return sorted(told, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_handover_is_that_of_a_plain_loop(spark, seed):
    table = visits(seed)
    got = hosts.timed_replay(spark.createDataFrame(table, ROUTES).repartition(5), ["route"], ["at", "id"], Handover, TOLD)
    found, want = sorted(map(tuple, got.collect()), key=repr), plain_handover(table)
    assert found == want
    seen = {(r[2], r[5], r[6]) for r in want}
    assert {("match", None, "accepted"), ("match", None, "ambiguous"), ("track", "attached", None)} <= seen and (seed == 3 or ("face", "locked", None) in seen)


def test_a_timer_matches_without_a_further_row(spark):
    at = lambda s: int(1_700_000_000 * SECOND + s * SECOND)
    table = [("r", at(0), 1, "face", "f1", "s1", 0.9, None, None), ("r", at(3), 2, "face", "f2", "s2", 0.8, None, None), ("r", at(4), 3, "track", None, None, None, "t1", True)]
    got = hosts.timed_replay(spark.createDataFrame(table, ROUTES), ["route"], ["at", "id"], Handover, TOLD).where("kind = 'match'")
    # two faces fit the track until the first is over 8 seconds old
    assert [(r.at, r.outcome, r.track, r.student) for r in got.orderBy("at").collect()] == [(at(4), "ambiguous", None, None), (at(8) + 1, "accepted", "t1", "s2")]


def test_silence_cuts_a_route_without_a_change(spark):
    table = visits(4)
    df = spark.createDataFrame(table, ROUTES)
    whole = Handover()
    whole_key = type("Endless", (Handover,), {"quiet": 1 << 60})
    a, b = (sorted(map(tuple, hosts.timed_replay(df, ["route"], ["at", "id"], make, TOLD).collect()), key=repr) for make in (Handover, whole_key))
    assert a == b and whole.quiet == 30 * SECOND + 1


def test_the_stream_says_what_the_replay_says(spark, sf_dir):
    """Three arrivals, the stream begun anew for each; routes go on over midnight and over the arrivals."""
    source = sequences.handover_rows(spark, sf_dir)
    end = source.agg(F.max(F.unix_millis("ts"))).first()[0] * 1000
    want = hosts.timed_replay(source.drop("ts"), ["route"], ["at", "event_id"], sequences.handover_step, sequences.HANDED, end=end)
    got = flows.stream_handover(spark, sf_dir)
    found = sorted(map(tuple, got.collect()), key=repr)
    assert found == sorted(map(tuple, want.collect()), key=repr)
    accepted = [r for r in found if r[6] == "accepted"]
    assert accepted and got.where("kind = 'match'").select("at").distinct().count() > 5


# --- tracker ----------------------------------------------------------------------------------------------------


def test_tracks_pass_from_stretch_to_stretch(spark, sf_dir):
    """However short the stretches are: the rows of one uncut run of each camera, with tracks that live over borders."""
    frames = sequences.tracker_frames(spark, sf_dir).withColumn("camera", F.col("camera") % 3)
    want: list = []
    cameras: dict = {}
    for r in frames.collect():
        cameras.setdefault(r.camera, []).append(r.asDict())
    for camera, own in cameras.items():
        step = Tracker(kalman=True, lifecycle=True, suppress=True)
        for row in sorted(own, key=lambda r: r["frame"]):
            want += [(camera, r["frame"], r["kind"], r["box"], f"person-{r['number']}", r["state"]) for r in step(row)]
    rounds = {}
    for stretch in (80, 10_000):
        got = sequences.tracked(frames, stretch)
        rounds[stretch] = sorted(map(tuple, got.collect()), key=repr)
        assert rounds[stretch] == sorted(want, key=repr)
    firsts = {}
    for camera, frame, kind, _, track, state in want:
        if kind == "move" and state == "TENTATIVE":
            firsts[camera, track] = frame
    positions = {(c, r["frame"]): i // 80 for c, own in cameras.items() for i, r in enumerate(sorted(own, key=lambda r: r["frame"]))}
    assert any(positions[c, f] > positions[c, firsts[c, t]] for c, f, kind, _, t, _ in want if kind == "box")


def test_global_ids_of_every_route(spark, sf_dir):
    """The rules once more, over lists: ids are forgotten with their tracks, and no camera has one id twice."""
    routes: dict = {}
    for r in sequences.matched_tracks(spark, sf_dir).collect():
        routes.setdefault(r.route, []).append(r)
    want = []
    for route, own in routes.items():
        live, count = {}, 0  # track: [id, last seen]
        for r in sorted(own, key=lambda r: (r.ts, r.event_id)):
            live = {k: v for k, v in live.items() if (r.ts - v[1]).total_seconds() <= 12 * 3600}
            theirs = live.get(r.matched, [None])[0]
            taken = {v[0] for k, v in live.items() if k.split(":")[0] == r.track.split(":")[0]}
            if r.track in live:
                status = "blocked" if theirs not in (None, live[r.track][0]) else "known"
            elif theirs is not None and theirs not in taken:
                live[r.track], status = [theirs, r.ts], "propagated"
            else:
                count += 1
                live[r.track], status = [count, r.ts], "registered"
            live[r.track][1] = r.ts
            want.append((route, r.event_id, r.track, live[r.track][0], status))
    got = sorted(map(tuple, catalog.queries()["global_ids"](spark, sf_dir).collect()))
    assert got == sorted(want) and {r[-1] for r in got} == {"known", "registered", "propagated", "blocked"}

"""What a review on odd and larger tables found, each with a table that showed it."""

from __future__ import annotations

import hashlib
import time
import tracemalloc
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import neardup, toxicity
from tessella.operators import aggregates, dedup, density, graph, handoff, joins, matching, sampling, skew
from tessella.plans import catalog, sequences
from tessella.streaming import hosts, pipelines, steps
from tessella.streaming.handover import Handover
from tessella.streaming.tracking import Motions, Tracker
from tests.test_operators import slow_leaders


def test_recovered_tracks_on_the_bounds_of_size(spark):
    """Widths 25 and 20 are a ratio of exactly 1.25, and 20 and 25 of 0.8, wherever the boxes stand."""
    lost = spark.createDataFrame([(k, k, 0, v, 0, w, 10) for k, (v, w) in enumerate([(29.71, 20), (23.73, 25), (7.72, 20)])], "key int, lost_id int, s int, lx double, ly int, lw int, lh int")
    new = spark.createDataFrame([(k, k + 10, 0, v, 0, w, 10, 100.0) for k, (v, w) in enumerate([(7.45, 25), (13.79, 20), (13.45, 25)])], "key int, new_id int, s int, nx double, ny int, nw int, nh int, diagonal double")
    at = lambda df, name: df.withColumn(name, df.s.cast("timestamp")).drop("s")
    got = joins.recovered(at(lost, "lost_at"), at(new, "new_at"), "key", 3, 0.8, 1.25, 0.3)
    assert sorted((r.lost_id, r.new_id) for r in got.collect()) == [(0, 10), (1, 11), (2, 12)]


@pytest.mark.parametrize("target", [0, 3, 5, 8, 100])
def test_waterfill_never_deals_more_than_the_target(spark, target):
    """Also where there are more ids than units."""
    room, want = {1: 2, 2: 0, 3: 4, 4: 1, 5: 1, 6: 3}, dict.fromkeys(range(1, 7), 0)
    for slot in range(1, 5):
        for k, c in room.items():
            if slot <= c and sum(want.values()) < target:
                want[k] += 1
    got = sampling.waterfill(spark.createDataFrame(list(room.items()), "id int, c long"), "id", "c", target)
    assert {r.id: r.allocated for r in got.collect()} == want


def test_waterfill_one_each_with_more_ids_than_units(spark, tmp_path):
    spark.range(1500).selectExpr("id as event_id", "id as user_id").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r.allocated for r in catalog.queries()["waterfill_one_each"](spark, str(tmp_path)).collect()}
    assert got == {k: int(k < 400) for k in range(1500)}


def test_receipts_cover_every_file_with_its_hash(spark, tmp_path):
    spark.range(90_000).selectExpr("id as event_id", "elt(cast(id % 3 as int) + 1, 'a', 'b', 'c') as event_type").write.parquet(f"{tmp_path}/events.parquet")
    files: dict = {}
    for k in range(90_000):
        files.setdefault(f"part-{k % 4}-{k // 40_000}", []).append("abc"[k % 3])
    want = {name: (hashlib.sha256("".join(f"{v}\n" for v in sorted(lines)).encode()).hexdigest(), len(lines)) for name, lines in files.items()}
    assert {r.name: (r.sha256, r.n) for r in catalog.queries()["receipts_again"](spark, str(tmp_path)).collect()} == want


def test_incomplete_sessions_are_listed_by_segment(spark, tmp_path):
    spark.range(25_000).selectExpr("id as c_custkey", "if(id % 2 = 0, 'X', 'Y') as c_mktsegment", "cast(id % 5 - 1 as double) as c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    want: dict = {}
    for k in range(25_000):
        if k % 9 == 0 or (k % 2 == 0 and k % 5 == 0):
            want.setdefault(("XY"[k % 2], k // 10_000), []).append(str(k))
    got = {(r.c_mktsegment, r.block): r.sessions for r in catalog.queries()["incomplete_sessions"](spark, str(tmp_path)).collect()}
    assert got == {k: ",".join(v) for k, v in want.items()}


def test_incomplete_sessions_are_one_list_for_each_segment(spark, tmp_path):
    """In order of the keys over all blocks, negative ones, repeated ones and customers without a segment included."""
    keys = [*range(-20_000, 40_000), *range(0, 90, 9)]
    rows = [(k, None if k % 7 == 0 else "XY"[k % 2], float(k % 5 - 1)) for k in keys]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    want: dict = {}
    for k, segment, balance in sorted(rows, key=lambda r: r[0]):
        if k % 9 == 0 or (k % 2 == 0 and balance < 0):
            want.setdefault(segment, []).append(str(k))
    got = [(r.c_mktsegment, r.sessions) for r in catalog.queries()["incomplete_sessions"](spark, str(tmp_path)).collect()]
    assert len(got) == 3 and dict(got) == {k: ",".join(v) for k, v in want.items()}


def test_near_duplicates_pass_through_the_simhash_index(spark):
    """Copies with a changed word in a long text are met by their fingerprints, at two bits or fewer."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 4000, 1500)]
    texts = [" ".join(base), *(" ".join([*base[:at], "changed", *base[at + 1 :]]) for at in (40, 700, 1400)), " ".join(f"v{k}" for k in range(200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = neardup._prints(docs, "doc_id", "text").collect()
    far = [min(bin((a.fp ^ b.fp) & (2**64 - 1)).count("1") for b in prints if b is not a) for a in prints]
    met = {frozenset(r) for r in neardup._classed(spark.createDataFrame([(r.node, r.fp) for r in prints], "node long, fp long")).collect()}
    near = {r.node for r, d in zip(prints, far, strict=True) if d <= 2}
    assert len(near) > 1 and {n for pair in met for n in pair} == near
    assert sorted(r.doc_id for r in neardup.keep_one(docs).collect()) == [0, 4]


def test_handover_does_not_slow_down_with_what_it_holds():
    """A hundred times as many people and tracks at once: each row still costs about the same."""

    def seconds(people: int) -> float:
        step, start = Handover(delay=8.0, skew=0.5, stale=30.0), time.perf_counter()
        for k in range(2000):
            at = k * 8_000_000 // people
            step.until(at)
            step({"at": at, "kind": "face", "face_track": f"f{k}", "student": f"u{k}", "similarity": 0.9} if k % 2 else {"at": at, "kind": "track", "track": f"t{k}", "inside": True})
        return time.perf_counter() - start

    assert seconds(1000) < 5 * seconds(10) + 0.2


def test_in_order_matches_of_many_frames_are_those_of_each():
    rng = np.random.default_rng(5)
    for n, m in ((0, 3), (3, 0), (1, 1), (4, 3), (3, 5), (7, 7)):
        a, b = (np.concatenate([p := rng.integers(0, 4, (200, k, 2)), p + rng.integers(0, 4, (200, k, 2))], axis=2).astype(float) for k in (n, m))
        for least in (0.0, 0.3, 0.5):
            assert matching.stacked_in_order(a, b, least).tolist() == [len(matching.greedy_in_order(x, y, least)) for x, y in zip(a, b, strict=True)]


def test_training_holds_its_tables_once():
    """The words' projections are filled in place, not joined from parts; windows are cut as an array."""
    words, model = [f"w{k}" for k in range(200_000)], toxicity.Model()
    model.p = toxicity._start(1, np.random.default_rng(1))
    tracemalloc.start()
    got = model.projected(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.shape == (200_000, 48) and peak < 2 * got.nbytes
    assert np.allclose(got[8000:8400], model.projected(words[8000:8400]))
    index, mask, source = toxicity.cut([np.arange(1, 31), np.zeros(0, int), np.arange(5, 17)])
    assert source.tolist() == [0, 0, 0, 2] and mask.sum(axis=1).tolist() == [12, 12, 6, 12]
    assert index[mask].tolist() == [*range(1, 31), *range(5, 17)] and not index[~mask].any()


def test_polygons_without_points_are_dropped_where_they_are_placed(spark, monkeypatch):
    """Points beyond the grid count in its last cells but lie in no polygon: no round of Spark for each polygon there."""
    rng, cuts, real = np.random.default_rng(4), [], density.cut_lineage
    points = [(float(x), float(y)) for x, y in rng.normal((0.5, 0.3), 0.02, (800, 2))] + [(k / 64, 10.0) for k in range(64) for _ in range(10)]
    monkeypatch.setattr(density, "cut_lineage", lambda df: cuts.append(1) or real(df))
    got = density.density_clusters(spark.createDataFrame([("c", *p) for p in points], "camera string, x double, y double"), "camera").collect()
    assert len(cuts) <= 8 and got
    inside = lambda p, x, y: all((b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]) >= 0 for a, b in zip(p, [*p[1:], p[0]], strict=True))
    assert [r.n for r in got] == [sum(inside(r.polygon, x, y) for x, y in points) for r in got]


def test_assignments_of_many_frames_are_those_of_each():
    rng = np.random.default_rng(5)
    for n, m in ((0, 3), (3, 0), (1, 1), (4, 3), (3, 5), (7, 7)):
        a, b = (np.concatenate([p := rng.integers(0, 4, (100, k, 2)), p + rng.integers(0, 5, (100, k, 2))], axis=2).astype(float) for k in (n, m))
        for least in (0.0, 0.3, 0.5):
            assert matching.gated_assignment.stacked(a, b, least).tolist() == [len(matching.gated_assignment(x, y, least)) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("buckets", [None, 2])
def test_many_keys_of_a_stream_share_a_group(spark, tmp_path, buckets):
    """Each key has its own state in its bucket, from one micro-batch to the next."""
    for part in range(3):
        spark.createDataFrame([(k, 10 * part + i, float(k * i + part)) for k in range(7) for i in range(3)], "k long, at long, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = hosts.live(pipelines.parquet_stream(spark, f"{tmp_path}/in"), ["k"], ["at"], lambda: steps.Ema(["v"], 0.5), "k long, at long, smooth_v double", buckets=buckets)
    epochs = []

    def sink(batch, epoch):
        epochs.append(epoch)
        batch.write.mode("append").parquet(f"{tmp_path}/out")

    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {}
    for k in range(7):
        step = steps.Ema(["v"], 0.5)
        want |= {(k, 10 * p + i): step({"v": float(k * i + p)})[0]["smooth_v"] for p in range(3) for i in range(3)}
    assert {(r.k, r.at): r.smooth_v for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want
    assert len(epochs) == 3 and q.lastProgress["stateOperators"][0]["numRowsTotal"] == (buckets or 7)


def test_a_hub_of_a_graph_lies_in_no_single_task(spark):
    """Its edges stay where they are, also where Spark would not broadcast by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = spark.range(0, 20_000, 1, 8).selectExpr("0 as u", "id + 1 as v")
        rows = graph._star(pairs).withColumn("p", F.spark_partition_id())
        assert rows.where("u = 0 and m = 0").count() == 20_000 and rows.select("p").distinct().count() > 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tracker_replay_runs_every_frame_once(spark, sf_dir, monkeypatch):
    """No stretch starts from nothing to be run again: the rows of a plain loop over each camera, by one pass."""

    def twice(*_):
        raise AssertionError("frames are run in stretches that are repaired")

    monkeypatch.setattr(hosts, "chained", twice)
    got = sorted(map(tuple, catalog.queries()["tracker_replay"](spark, sf_dir).collect()), key=repr)
    steps_, want = {}, []
    for r in sequences.tracker_frames(spark, sf_dir).orderBy("camera", "frame").collect():
        step = steps_.setdefault(r.camera, Tracker(kalman=True, lifecycle=True, suppress=True))
        want += [(r.camera, o["frame"], o["kind"], o["box"], f"person-{o['number']}", o["state"]) for o in step(r.asDict())]
    assert got == sorted(want, key=repr) and len(steps_) == 40


@pytest.mark.parametrize("seed", range(4))
def test_components_of_rows_in_time(spark, seed, monkeypatch):
    """Those of all pairs within the gate, whichever sides a stretch of time has; rows right on the gate are within."""
    monkeypatch.setattr(handoff, "EPOCH", 4)
    rng = np.random.default_rng(seed)
    rows = [(k, bool(rng.random() < 0.4), int(t)) for k, t in enumerate(rng.integers(-300, 1500 * (1 + seed), 150))] + [(900, False, 90_000), (901, True, 90_010), (902, False, 90_020), (903, True, 90_031)]
    got = {r.k: r.component for r in handoff.in_components(spark.createDataFrame(rows, "k long, side boolean, t long"), 10).collect()}
    group = {k: k for k, _, _ in rows}
    find = lambda k: k if group[k] == k else find(group[k])
    linked = [(a, b) for a, s, t in rows for b, r, u in rows if not s and r and abs(t - u) <= 10]
    for a, b in linked:
        group[find(a)] = find(b)
    want: dict = {}
    for k in {k for pair in linked for k in pair}:
        want.setdefault(find(k), set()).add(k)
    have: dict = {}
    for k, c in got.items():
        have.setdefault(c, set()).add(k)
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("kept", [0, 1 << 20])
def test_cross_camera_matches_without_a_table_of_pairs(spark, sf_dir, monkeypatch, kept):
    """The rows of the matches of all scored pairs; a crowd of entries has fewer rooms, and no pair is joined."""
    rng = np.random.default_rng(5)
    kinds = "{} string, s double, x double, y double, feature array<double>"
    sides = []
    for name, n in (("a", 120), ("b", 70)):
        at = np.concatenate([rng.uniform(0, 200, n // 2), rng.uniform(5000, 40_000, n - n // 2), [50_000.0, 50_060.0]])
        rows = [(f"{name}{k}", round(float(t), 3), float(rng.random()), float(rng.random()), rng.random(4).tolist()) for k, t in enumerate(at)]
        rows += [(f"{name}no time", None, 0.1, 0.1, [1.0] * 4), (f"{name}no feature", 1.0, 0.1, 0.1, [0.0] * 4)]
        sides.append(spark.createDataFrame(rows, kinds.format(name)).withColumn("at", F.col("s").cast("timestamp")).drop("s"))
    score = [[1.0, 0.1, 0.0], [0.0, 0.9, 0.02], [0.05, 0.0, 1.0]], 60, 0.7, (0.6, 0.25, 0.15)
    want = sorted(map(tuple, handoff.matched(handoff.scored_pairs(*sides, *score), 0.6, 0.03).collect()))

    def pairs(*_):
        raise AssertionError("all pairs are joined")

    monkeypatch.setattr(handoff, "interval_pairs", pairs)
    monkeypatch.setattr(handoff, "KEPT", kept)
    assert sorted(map(tuple, handoff.matched_tracks(*sides, *score, 0.6, 0.03).collect())) == want and len(want) > 40
    assert handoff.matched_tracks(sides[0].limit(0), sides[1], *score, 0.6, 0.03).count() == 0
    assert catalog.queries()["cross_camera_match"](spark, sf_dir).count() > 0


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components_of_few_edges_need_no_broadcasts(spark, few, monkeypatch):
    """Both ways of a round give the same components; the one for few edges looks for no hubs."""
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(1000, 1000 + k) for k in range(1, 90)] + [(2000 + k, 2001 + k) for k in range(40)]
    group: dict = {}

    def find(k):
        while group.setdefault(k, k) != k:
            k = group[k]
        return k

    for a, b in pairs:
        if a != b:
            low, high = sorted((find(a), find(b)))
            group[high] = low
    looked = []
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    monkeypatch.setattr(graph, "hot_keys", lambda *a: looked.append(1) or skew.hot_keys(*a))
    got = graph.connected_components(spark.createDataFrame(pairs, "src long, dst long"))
    assert {r.node: r.component for r in got.collect()} == {k: find(k) for k in list(group)} and bool(looked) == (few == 0)


def test_near_pairs_are_joined_in_as_many_tasks_as_hashes_need(spark, monkeypatch):
    """The number follows the hashes, not Spark's setting; the pairs stay those of all hashes."""
    rng = np.random.default_rng(9)
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 60)]
    rows = [(k, h ^ (0 if k % 3 else int(1 << (k % 40)))) for k, h in enumerate(base * 3)]
    monkeypatch.setattr(dedup, "BANDED", 500)
    asked, repartition = [], type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda df, n, *c: asked.append(n) or repartition(df, n, *c))
    got = {tuple(r) for r in dedup.near_pairs(spark.createDataFrame(rows, "id long, bits long"), "id", "bits").collect()}
    first: dict = {}
    for k, h in rows:
        first.setdefault(h, k)
    apart = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
    want = {(i, j, apart(a, b)) for a, i in first.items() for b, j in first.items() if i < j and apart(a, b) <= 4} | {(first[h], k, 0) for k, h in rows if first[h] < k}
    assert got == want and len(want) > 60
    assert asked and set(asked) == {-(-len(first) * 35 // 500)}


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_leaders_of_a_crowd_of_one_hash(spark, few, monkeypatch):
    """A crowd makes no pairs of its rows, and batches, rounds and the last task tell the loop's groups; boxes that do not match themselves, and rows without a hash or a camera, too."""
    rng = np.random.default_rng(8)
    seeds = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 3)]
    rows = [("c", k, f"s{k}", seeds[0], "x", False, 1.0, [0.0, 0.0, 10.0, 10.0]) for k in range(300)]
    for k in range(300, 420):
        bits = seeds[int(rng.integers(0, 3))]
        for b in rng.integers(0, 62, int(rng.integers(0, 6))):
            bits ^= 1 << int(b)
        boxes = [[0.0, 0.0, 10.0, 10.0], [0.0, 0.0, 9.5, 10.0], [5.0, 5.0, 5.0, 5.0], []][int(rng.integers(0, 4))]
        rows.append(("cd"[k % 2], k, f"s{k}", bits, "x", bool(rng.integers(0, 2)), float(rng.integers(0, 3)), boxes))
    made, within = [], dedup.within

    def counted(*a):
        made.append((pairs := within(*a)).count())
        return pairs

    monkeypatch.setattr(dedup, "FIRST", 16)
    monkeypatch.setattr(dedup, "GROWTH", 3)
    monkeypatch.setattr(dedup, "OPEN_PAIRS", few)
    monkeypatch.setattr(dedup, "within", counted)
    odd = [("c", 900 + k, f"n{k}", None, "x", True, 9.0, []) for k in range(2)] + [(None, 910 + k, f"m{k}", seeds[0], "x", True, 9.0, []) for k in range(2)]
    schema = "camera string, id long, sha256 string, bits long, label string, reviewed boolean, sharpness double, boxes array<double>"
    got = {r.id: (r.group_id, r.reason, r.distance) for r in dedup.leader_groups(spark.createDataFrame(rows + odd, schema), "camera").collect()}
    assert got == slow_leaders(rows, 4, 0.9) | {r[1]: (r[1], "leader", 0) for r in odd} and sum(made) < 20_000


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_pair_similarities_are_products_of_blocks(spark, monkeypatch, block_rows):
    """Rows of one id are no pair; unknown keys, unusable vectors and other lengths count but have no cosine; no pair is a row of Spark's."""
    rng = np.random.default_rng(6)
    rows = [(None if k == 5 else k - (k == 9), None if k % 11 == 0 else int(k % 3), rng.normal(size=3 if k % 10 == 3 else 4).tolist() if k % 7 else None) for k in range(60)]
    rows += [(70, 1, [0.0] * 4), (71, 1, [float("nan")] * 4), (72, 2, [None, 1.0, 1.0, 1.0])]
    want: dict = {}
    ok = lambda x: x is not None and None not in x and bool(np.isfinite(x).all()) and any(x)
    for i, k, x in rows:
        for j, m, y in rows:
            if i is not None and j is not None and i < j:
                one = want.setdefault(None if k is None or m is None else k == m, [0, []])
                one[0] += 1
                if ok(x) and ok(y) and len(x) == len(y):
                    one[1].append(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)))

    def paired(*_):
        raise AssertionError("a row for each pair")

    df = spark.createDataFrame(rows, "i long, k long, v array<double>")
    monkeypatch.setattr(aggregates.v, "dot", lambda a, b, dot=aggregates.v.dot: dot(a, b) if a is b else paired())
    got = {r.same: (r.n, r["mean"], r["max"]) for r in aggregates.pair_similarities(df, "i", "k", "v", block_rows=block_rows, widest=block_rows).collect()}
    assert got == {s: (n, pytest.approx(np.mean(c)), pytest.approx(max(c))) for s, (n, c) in want.items()} and len(got) == 3
    one = aggregates.pair_similarities(df.where("i in (70, 71)"), "i", "k", "v").collect()
    assert [tuple(r) for r in one] == [(True, 1, None, None)] and aggregates.pair_similarities(df.limit(0), "i", "k", "v").count() == 0


def test_global_ids_do_not_slow_down_with_what_lives():
    """A hundred times as many tracks at once: each row still costs about the same, and the ids are those of the rules over lists, rows out of order included."""
    start = datetime(2024, 1, 1)

    def seconds(tracks: int) -> float:
        step, began = steps.GlobalIds("at", 1e6), time.perf_counter()
        for k in range(4000):
            step({"at": start + timedelta(seconds=k), "track": f"{'ab'[k % 2]}:{k % tracks}", "matched": f"a:{k * 7 % tracks}"})
        return time.perf_counter() - began

    assert seconds(3000) < 5 * seconds(30) + 0.2
    rng, step, live, count = np.random.default_rng(3), steps.GlobalIds("at", 40), {}, 0
    told = set()
    for k in range(3000):
        now, own, other = k + int(rng.integers(-30, 30)), f"{'abc'[rng.integers(3)]}:{rng.integers(25)}", f"{'abc'[rng.integers(3)]}:{rng.integers(25)}"
        live = {t: v for t, v in live.items() if now - v[1] <= 40}
        theirs = live.get(other, [None])[0]
        status = "known" if own in live else "registered"
        if own in live and theirs not in (None, live[own][0]):
            status = "blocked"
        elif own not in live and theirs is not None and theirs not in {v[0] for t, v in live.items() if t[0] == own[0]}:
            live[own], status = [theirs, now], "propagated"
        elif own not in live:
            count += 1
            live[own] = [count, now]
        live[own][1] = now
        got = step({"at": start + timedelta(seconds=now), "track": own, "matched": other})[0]
        assert (got["global_id"], got["status"]) == (live[own][0], status)
        told.add(status)
    assert told == {"known", "registered", "propagated", "blocked"}


def test_filters_and_few_boxes_solve_no_systems(monkeypatch):
    """A filter's numbers are those of the dense method, by three numbers an axis; few boxes are matched by plain numbers as arrays are."""
    rng, filters = np.random.default_rng(2), Motions()
    boxes = [np.concatenate([p := rng.uniform(0, 50, (5, 2)), p + rng.uniform(5, 30, (5, 2))], axis=1) for _ in range(12)]
    xyah = lambda b: np.stack([(b[:, 0] + b[:, 2]) / 2, (b[:, 1] + b[:, 3]) / 2, (b[:, 2] - b[:, 0]) / (b[:, 3] - b[:, 1]), b[:, 3] - b[:, 1]], axis=1)
    weights = lambda h, p, a: np.diag([p * h, p * h, a, p * h]) ** 2
    mean, cov = np.concatenate([xyah(boxes[0]), np.zeros((5, 4))], axis=1), np.zeros((5, 8, 8))
    for k, h in enumerate(mean[:, 3]):
        cov[k, :4, :4], cov[k, 4:, 4:] = weights(h, 2 / 20, 1e-2), weights(h, 10 / 160, 1e-5)
    solve = np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", None)
    filters.add(boxes[0])
    for t, seen in enumerate(boxes[1:]):
        step, f = 0.1 * (t + 1), np.eye(8)
        f[:4, 4:] = np.eye(4) * min(step, 1.0)
        filters.predict(np.full(5, step))
        filters.update([0, 2, 3], seen[:3])
        for k in range(5):
            noise = np.zeros((8, 8))
            noise[:4, :4], noise[4:, 4:] = (weights(mean[k, 3], w, a) * min(step, 1.0) ** 2 for w, a in ((1 / 20, 1e-2), (1 / 160, 1e-5)))
            mean[k], cov[k] = f @ mean[k], f @ cov[k] @ f.T + noise
        for k, box in zip((0, 2, 3), xyah(seen[:3]), strict=True):
            s = cov[k, :4, :4] + weights(mean[k, 3], 1 / 20, 1e-1)
            gain = solve(s, cov[k, :4]).T
            mean[k], cov[k] = mean[k] + gain @ (box - mean[k, :4]), cov[k] - gain @ s @ gain.T
        assert np.allclose(filters.mean, mean) and np.allclose(filters.cov, cov)
    for few in (0, 1 << 20):
        monkeypatch.setattr(matching, "FEW_PAIRS", few)
        rng, told = np.random.default_rng(5), []
        for n, m in ((0, 3), (1, 1), (4, 3), (3, 5), (7, 7), (12, 4)) * 30:
            a, b = (np.concatenate([p := rng.integers(0, 4, (k, 2)), p + rng.integers(0, 5, (k, 2))], axis=1).astype(float) for k in (n, m))
            told.append((matching.gated_assignment(a, b, 0.2), matching.suppress_contained(a, rng.integers(0, 3, n) / 2)))
        first = told if few == 0 else first
    assert told == first and any(pairs for pairs, _ in told)


@pytest.mark.parametrize("n,m,span", [(80, 120, 300), (120, 80, 300), (90, 90, 900)])
def test_a_crowd_is_assigned_without_a_heap_of_its_pairs(monkeypatch, n, m, span):
    """No pair is pushed one by one, and the pairs are those of the sparse method, rows left out included."""
    rng = np.random.default_rng(n + span)
    t = np.concatenate([rng.integers(0, span, n), rng.integers(0, span, m)])
    table = pa.table({"side": [k >= n for k in range(n + m)], "t": t, "x": rng.random(n + m), "y": rng.random(n + m), "feature": rng.random((n + m, 3)).tolist()})
    sides = handoff.Sides(table, 60, 60e-6, 0.6, (0.6, 0.25, 0.15))
    edges = {i: [(j, 1.0 - float(x)) for j, x in zip(range(sides.low[i], sides.high[i]), sides.totals(i), strict=True)] for i in range(n)}
    want = handoff.sparse_assignment(edges)

    def pushed(*_):
        raise AssertionError("a pair is pushed")

    monkeypatch.setattr(handoff.heapq, "heappush", pushed)
    assert {int(i): j for j, i in enumerate(sides.assigned().tolist()) if i >= 0} == want and len(want) > 60

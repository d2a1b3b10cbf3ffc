"""Order-dependent operators against plain loops over small random and literal inputs."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from itertools import permutations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.operators import dedup, density, handoff, joins, matching, skew
from tessella.operators.graph import connected_components
from tessella.plans import catalog
from tessella.streaming import hosts, steps, tracking

SCHEMA = "frame long, at int, x1 double, y1 double, x2 double, y2 double, confidence double"


def some_boxes(seed: int, frames: int = 12, most: int = 6) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = []
    for frame in range(frames):
        for at in range(rng.integers(0, most)):
            x, y, w, h = rng.integers(0, 12, 2).tolist() + rng.integers(1, 9, 2).tolist()
            rows.append((frame, at, float(x), float(y), float(x + w), float(y + h), round(float(rng.random()), 2)))
    return rows


def by_frame(rows: list[tuple]) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {}
    for r in sorted(rows):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("keep", [matching.suppress_contained, matching.suppress_tiles])
def test_suppression_keeps_what_the_rule_keeps(spark, keep):
    rows = some_boxes(1)
    got = sorted(tuple(r) for r in matching.per_frame(spark.createDataFrame(rows, SCHEMA), "frame", ["at"], keep).collect())
    want = []
    for own in by_frame(rows).values():
        boxes, confidence = np.array([r[2:6] for r in own]), np.array([r[6] for r in own])
        want += [own[i] for i in keep(boxes, confidence)]
    assert got == sorted(want)


def test_overlap_labels_number_groups_by_their_first(spark):
    rows = [(1, 0, 0.0, 0.0, 4.0, 4.0, 0.5), (1, 1, 50.0, 0.0, 54.0, 4.0, 0.5), (1, 2, 0.0, 0.0, 4.0, 5.0, 0.5), (1, 3, 90.0, 0.0, 91.0, 1.0, 0.5), (1, 4, 50.0, 0.0, 54.0, 5.0, 0.5)]
    got = {r.at: r.duplicate_group for r in matching.label_overlaps(spark.createDataFrame(rows, SCHEMA), "frame", ["at"], 0.5).collect()}
    assert got == {0: "duplicate-1", 1: "duplicate-2", 2: "duplicate-1", 3: None, 4: "duplicate-2"}


@pytest.mark.parametrize("match", [matching.greedy_global, matching.greedy_in_order, matching.gated_assignment])
def test_frames_of_either_side_are_counted(spark, match):
    a, b = some_boxes(2), some_boxes(3)
    got = {r.frame: (r.tp, r.fp, r.fn) for r in matching.match_frames(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "frame", ["at"], match, 0.3).collect()}
    left, right = by_frame(a), by_frame(b)
    want = {}
    for k in left.keys() | right.keys():
        x, y = (np.array([r[2:6] for r in side.get(k, [])]).reshape(-1, 4) for side in (left, right))
        tp = len(match(y, x, 0.3))
        want[k] = (tp, len(y) - tp, len(x) - tp)
    assert got == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert matching.per_frame(empty, "frame", ["at"], matching.suppress_tiles).count() == 0
    assert matching.label_overlaps(empty, "frame", ["at"], 0.5).count() == 0
    assert matching.match_frames(empty, empty, "frame", ["at"], matching.greedy_global, 0.5).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.integers(0, 10_000))
def test_assignment_is_cheapest(rows, columns, seed):
    costs = np.random.default_rng(seed).integers(0, 9, (rows, columns)).astype(float)
    pairs = matching.minimum_cost_assignment(costs)
    assert len(pairs) == min(rows, columns) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
    wide = costs if rows <= columns else costs.T
    best = min(sum(wide[i, j] for i, j in enumerate(p)) for p in permutations(range(wide.shape[1]), wide.shape[0]))
    assert sum(costs[i, j] for i, j in pairs) == best


def test_components_against_union_find(spark):
    rng = np.random.default_rng(5)
    edges = [tuple(map(int, rng.integers(0, 60, 2))) for _ in range(45)] + [(7, 7), (None, 3)] + [(100, k) for k in range(101, 140)]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in list(parent)}


def test_text_bits_are_the_majority_of_word_hashes(spark):
    texts = {1: "a b c", 2: "", 3: None, 4: "x y  z w q", 5: "tab\tand\nline " * 400}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")

    def want(text):
        if text is None:
            return None
        hashes = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in re.split(r"\s+", text)]
        value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        return value - (1 << 64) if value >> 63 else value

    got = {r.id: r.bits for r in dedup.with_text_bits(rows, "id", "text").collect()}
    assert got == {k: want(t) for k, t in texts.items()}


def test_exact_duplicates_take_nulls_as_equal(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None), (5, "")], "id long, text string")
    got = {r.id: r.duplicate_of for r in dedup.exact_duplicates(rows, rows["text"], "id").collect()}
    assert got == {1: None, 2: None, 3: 1, 4: 2, 5: None}


def test_orders_are_linked_by_parts_in_common(spark, sf_dir):
    lines = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()]
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for order, part in lines:
        parent[root(order)] = root(("part", part))
    least: dict = {}
    for order in sorted({o for o, _ in lines}):
        least.setdefault(root(order), order)
    got = {r.node: r.component for r in catalog.queries()["component_members"](spark, sf_dir).collect()}
    assert got == {o: least[root(o)] for o, _ in lines}


def test_dense_spots_become_clusters(spark):
    """Two spots of 400 points, far apart, and a thin spread that is too sparse to count."""
    rng = np.random.default_rng(5)
    spots = [(x, y) for cx, cy in ((0.2, 0.2), (0.7, 0.8)) for x, y in zip(rng.normal(cx, 0.01, 400), rng.normal(cy, 0.01, 400), strict=True)]
    rows = [("c", float(x), float(y)) for x, y in [*spots, *((k / 9, 0.5) for k in range(10))]] + [("c", None, 0.5)]
    got = {r.cluster: r for r in density.density_clusters(spark.createDataFrame(rows, "camera string, x double, y double"), "camera").collect()}
    assert sorted(got) == [1, 2]
    assert abs(got[1].x - 0.2) < 0.05 and abs(got[1].y - 0.2) < 0.05 and abs(got[2].x - 0.7) < 0.05 and abs(got[2].y - 0.8) < 0.05
    assert 700 < got[1].n + got[2].n <= 800


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 7), st.integers(1, 7), st.floats(0.2, 1.0), st.integers(0, 10_000))
def test_sparse_assignment_is_the_dense_one(rows, columns, share, seed):
    """As many pairs as can be at the least cost: the dense method with a large cost for what is no pair."""
    rng = np.random.default_rng(seed)
    costs = np.where(rng.random((rows, columns)) < share, rng.random((rows, columns)), handoff.LEFT_OUT)
    edges = {i: [(j, float(costs[i, j])) for j in range(columns) if costs[i, j] < 1] for i in range(rows)}
    got = handoff.sparse_assignment({i: e for i, e in edges.items() if e})
    assert sorted(got.items()) == [(i, j) for i, j in matching.minimum_cost_assignment(costs) if costs[i, j] < 1]


def test_cross_camera_matches_are_those_of_one_dense_assignment(spark):
    """Crowded and empty stretches of time, rows without a feature or a point, and all events at once."""
    rng = np.random.default_rng(11)
    start = datetime(2024, 1, 1)

    def side(n, first):
        at = np.concatenate([rng.uniform(0, 300, n // 2), rng.uniform(5000, 90_000, n - n // 2)])
        return [(first + k, start + timedelta(seconds=round(float(t), 3)), float(rng.random()), float(rng.random()), rng.random(4).tolist()) for k, t in enumerate(at)]

    a, b = side(60, 0), side(50, 1000)
    odd = [(900, None, 0.1, 0.1, [1.0] * 4), (901, start, None, 0.1, [1.0] * 4), (902, start, 0.1, 0.1, None), (903, start, 0.1, 0.1, [0.0] * 4)]
    kinds = "{} long, at timestamp, x double, y double, feature array<double>"
    plane, weights = [[1.0, 0.1, 0.0], [0.0, 0.9, 0.02], [0.05, 0.0, 1.0]], (0.6, 0.25, 0.15)
    left, right = spark.createDataFrame(a + odd, kinds.format("a")), spark.createDataFrame(b + odd, kinds.format("b"))
    got = {(r.a, r.b): (r.total, r.reason) for r in handoff.matched(handoff.scored_pairs(left, right, plane, 120, 0.7, weights), 0.6, 0.03).collect()}
    costs, total = np.full((len(a), len(b)), handoff.LEFT_OUT), np.full((len(a), len(b)), -1.0)
    for i, (_, t, x, y, f) in enumerate(a):
        w = plane[2][0] * x + plane[2][1] * y + plane[2][2]
        px, py = ((r[0] * x + r[1] * y + r[2]) / w for r in plane[:2])
        for j, (_, u, v, z, g) in enumerate(b):
            wait = abs((t - u).total_seconds())
            if wait <= 120:
                cosine = float(np.dot(f, g) / np.linalg.norm(f) / np.linalg.norm(g))
                total[i, j] = 0.6 * min(1.0, max(0.0, cosine)) + 0.25 * max(0.0, 1 - float(np.hypot(px - v, py - z)) / 0.7) + 0.15 * (1 - wait / 120)
                costs[i, j] = 1 - total[i, j]
    want = {}
    for i, j in matching.minimum_cost_assignment(costs):
        if total[i, j] >= 0:
            others = [x for x in [*np.delete(total[i], j), *np.delete(total[:, j], i)] if x >= 0]
            reason = "low_score" if total[i, j] < 0.6 else "ambiguous" if total[i, j] - max(others, default=0.0) < 0.03 else "accepted"
            want[a[i][0], b[j][0]] = (pytest.approx(total[i, j]), reason)
    assert got == want and {r for _, r in got.values()} == {"accepted", "ambiguous", "low_score"}
    assert handoff.matched(handoff.scored_pairs(left.limit(0), right, plane, 120, 0.7, weights), 0.6, 0.03).count() == 0


class Running(hosts.Step):
    """The rows so far and their sum; the last one again at the end."""

    def __init__(self):
        self.n, self.sum, self.key = 0, 0, None

    def __call__(self, row):
        self.n, self.sum, self.key = self.n + 1, self.sum + row["v"], row["k"]
        return [{"k": row["k"], "n": self.n, "sum": self.sum}]

    def finish(self):
        return [{"k": self.key, "n": -self.n, "sum": self.sum}]


def test_replay_carries_a_step_over_batches(spark):
    """One key with most rows, in batches of 50: none is gathered, and the state goes on from batch to batch."""
    rows = [(None if k == 3 else k, at, (at * 37) % 101) for k, n in ((0, 700), (1, 30), (2, 1), (3, 60)) for at in range(n)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = hosts.replay(spark.createDataFrame(rows[::-1], "k long, at long, v long"), ["k"], ["at"], Running, "k long, n long, sum long")
        got = sorted(map(repr, (tuple(r) for r in df.collect())))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
    want = []
    for key in (0, 1, 2, None):
        total, n = 0, 0
        for n, r in enumerate((r for r in rows if r[0] == key), 1):
            total += r[2]
            want.append((key, n, total))
        want.append((key, -n, total))
    assert got == sorted(map(repr, want))


def slow_leaders(rows: list[tuple], radius: int, box_iou: float) -> dict:
    """The groups by a loop over rows in order of priority."""
    leaders, by_content, out = [], {}, {}
    for camera, i, sha, bits, label, reviewed, sharpness, boxes in sorted(rows, key=lambda r: (not r[5], -r[6], r[1])):
        if (camera, sha, label) in by_content:
            out[i] = (by_content[camera, sha, label], "same_content", 0)
            continue
        near = []
        for c, j, other, b in leaders:
            distance = ((bits ^ other) & (1 << 64) - 1).bit_count()
            if c == camera and distance <= radius:
                match = matching.perfect_match(np.array(boxes).reshape(-1, 4), np.array(b).reshape(-1, 4), box_iou)
                if match is not None:
                    near.append((distance, -match, j))
        if near:
            out[i] = (min(near)[2], "near", min(near)[0])
        else:
            out[i] = (i, "leader", 0)
            leaders.append((camera, i, bits, boxes))
        by_content[camera, sha, label] = out[i][0]
    return out


def test_leader_groups_equal_the_loop(spark):
    rng = np.random.default_rng(4)
    seeds = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 6)]
    rows = []
    for i in range(150):
        bits = seeds[int(rng.integers(0, 6))]
        for b in rng.integers(0, 64, int(rng.integers(0, 5))):
            bits ^= (1 << int(b)) if b < 63 else -(1 << 63)
        x = float(rng.integers(0, 3))
        boxes = [x, 0.0, x + 20, 10.0] * int(rng.integers(0, 2)) + [50.0, 50.0, 60.0, 60.0]
        rows.append((f"c{i % 2}", i, f"sha{bits % 97}{i % 2}", bits, f"l{i % 2}", bool(rng.integers(0, 2)), float(rng.integers(0, 4)), boxes))
    schema = "camera string, id long, sha256 string, bits long, label string, reviewed boolean, sharpness double, boxes array<double>"
    got = {r.id: (r.group_id, r.reason, r.distance) for r in dedup.leader_groups(spark.createDataFrame(rows, schema), "camera").collect()}
    assert got == slow_leaders(rows, 4, 0.9) and len({g for g, _, _ in got.values()}) < 100
    assert dedup.leader_groups(spark.createDataFrame([], schema), "camera").count() == 0


def test_near_pairs_and_isolation_equal_all_pairs(spark):
    rng = np.random.default_rng(9)
    bits = [int(x) for x in rng.integers(0, 1 << 62, 30)]
    bits += [b ^ (1 << int(i)) ^ (1 << int(j)) ^ (1 << int(k)) for b in bits[:10] for i, j, k in rng.integers(0, 62, (4, 3))] + [bits[0]] * 20 + [None, None]
    rows = spark.createDataFrame(list(enumerate(bits)), "id long, bits long")
    got = {(r.id, r.other): r.distance for r in dedup.near_pairs(rows, "id", "bits", 4).collect()}
    first = {}
    for i, b in enumerate(bits):
        first.setdefault(b, i)
    want = {(first[b], i): 0 for i, b in enumerate(bits) if b is not None and first[b] < i}
    heads = [(i, b) for b, i in first.items() if b is not None]
    want |= {(i, j): (a ^ b).bit_count() for i, a in heads for j, b in heads if i < j and (a ^ b).bit_count() <= 4}
    assert got == want
    sided = rows.withColumn("sha256", rows["bits"].cast("string"))
    found = {r.id: (r.verdict, r.other, r.distance) for r in dedup.isolation(sided.where("id % 3 = 0"), sided.where("id % 3 <> 0"), "id", "sha256", "bits").collect()}
    for i in range(0, len(bits), 3):
        others = [(-1 if bits[j] == bits[i] else (bits[i] ^ bits[j]).bit_count(), j) for j in range(len(bits)) if j % 3 and bits[i] is not None and bits[j] is not None]
        best = min([o for o in others if o[0] <= 4], default=None)
        assert found.get(i) == (None if best is None else ("exact" if best[0] < 0 else "near", best[1], max(best[0], 0)))


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 6), st.integers(0, 6), st.integers(0, 10_000))
def test_stacks_of_frames_say_what_single_frames_say(n, m, seed):
    """Ties included: corners and confidences are few."""
    rng = np.random.default_rng(seed)
    corners = lambda k: np.array([[[x, y, x + w, y + h] for x, y, w, h in rng.integers(0, 5, (k, 4))] for _ in range(5)], float).reshape(5, k, 4)
    a, b, confidence = corners(n), corners(m), rng.integers(0, 3, (5, n)) / 2
    for keep in (matching.suppress_contained, matching.suppress_tiles):
        assert keep.stacked(a, confidence) == [keep(x, c) for x, c in zip(a, confidence, strict=True)]
    assert matching.greedy_global.stacked(a, b, 0.2).tolist() == [len(matching.greedy_global(x, y, 0.2)) for x, y in zip(a, b, strict=True)]


def test_global_ids_over_a_literal_trace():
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    step, out = steps.GlobalIds("at", 10), []
    for s, track, matched in ((0, "a:1", None), (1, "b:1", "a:1"), (2, "b:2", "a:1"), (3, "a:1", "b:2"), (14, "a:1", None), (15, "a:2", "b:1")):
        out += [(r["track"], r["global_id"], r["status"]) for r in step({"at": at(s), "track": track, "matched": matched})]
    assert out == [("a:1", 1, "registered"), ("b:1", 1, "propagated"), ("b:2", 2, "registered"), ("a:1", 1, "blocked"), ("a:1", 3, "registered"), ("a:2", 4, "registered")]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 4), st.integers(0, 10_000))
def test_perfect_match_is_found_where_there_is_one(n, seed):
    rng = np.random.default_rng(seed)
    a, b = (np.array([[x, y, x + 10, y + 10] for x, y in rng.integers(0, 6, (n, 2))], float).reshape(-1, 4) for _ in range(2))
    m = matching.iou_matrix(a, b)
    sound = [p for p in permutations(range(n)) if all(m[i, j] >= 0.5 for i, j in enumerate(p))]
    got = matching.perfect_match(a, b, 0.5)
    assert (got is None) == (not sound) and (got is None or any(abs(got - min((m[i, j] for i, j in enumerate(p)), default=1.0)) < 1e-12 for p in sound))
    assert matching.perfect_match(a, np.vstack([b, [[0, 0, 1, 1]]]), 0.5) is None


def test_nearest_track_scores_overlap_and_distance():
    tracks = np.array([[0, 0, 10, 10], [4, 0, 14, 10], [100, 0, 110, 10]], float)
    assert matching.nearest_track([3, 0, 13, 10], tracks) == 1 and matching.nearest_track([300, 0, 310, 10], tracks) is None
    assert matching.nearest_track([0, 0, 1, 1], tracks[:0]) is None


def test_places_in_an_order_found_by_counts(spark):
    rng = np.random.default_rng(3)
    values = [float(x) for x in np.round(rng.normal(0, 10, 30_000), 4)] + [7.5] * 9_000
    rows = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    ordered = sorted(values, reverse=True)
    for allowed in (0, 1, 500, 12_000, 38_999, 39_000):
        want = ordered[allowed] if allowed < len(ordered) else None
        assert skew.highest_beyond(rows, "v", allowed) == (want, sum(v > want for v in ordered) if want is not None else len(ordered))
    keys = spark.range(9_000).selectExpr("sha2(cast(id as string), 256) as k")
    known = sorted(r.k for r in keys.collect())
    assert [skew.least_text(keys, keys["k"], k) for k in (1, 77, 9_000, 9_001, 0)] == [known[0], known[76], known[-1], None, None]


def test_hot_keys_are_joined_where_they_lie(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(500)] + [(None, 1), (None, 2), ("lost", 3)], "key string, v long")
    per_key = rows.where("key is distinct from 'lost'").groupBy("key").count()
    counts = rows.groupBy("key").agg(skew.F.count(skew.F.lit(1)).alias("n"))
    got = skew.join_per_key(rows, per_key, skew.hot_keys(counts, "key", 10), "key").collect()
    assert len(got) == 3502 and {r["count"] for r in got if r.key == "hot"} == {3000} and {r["count"] for r in got if r.key is None} == {2}


def test_gallery_of_one_matrix_and_of_blocks(spark):
    rng = np.random.default_rng(1)
    probes = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(40)] + [(99, [0.0] * 4), (98, None)], "p long, vector array<double>")
    gallery = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(9)], "e long, vector array<double>")
    one, many = ({(r.p, r.e, round(r.similarity, 9), round(r.margin, 9)) for r in joins.gallery_top2(probes, gallery, "p", "e", most_bytes=b).collect()} for b in (1 << 20, 100))
    assert one == many and len(one) == 40
    assert {round(r.margin - r.similarity, 9) for r in joins.gallery_top2(probes, gallery.where("e = 0"), "p", "e").collect()} == {1.0}


def test_sessions_measure_gaps_from_the_last_accepted_row(spark):
    """A short clip inside a longer one moves the end back, as in the rules that sessions follow."""
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [("a", at(0), at(10)), ("a", at(9), at(9.5)), ("a", at(69.4), at(80)), ("a", at(141), at(142)), ("a", at(150), at(150)), ("a", at(139), at(160))]
    df = spark.createDataFrame(rows, "k string, start timestamp, stop timestamp")
    got = hosts.replay(df, ["k"], ["start"], lambda: steps.Sessions("start", "stop"), "start timestamp, status string, session long, gap_seconds double").collect()
    assert [(r.status, r.session, r.gap_seconds) for r in sorted(got, key=lambda r: r.start)] == [("ok", 1, None), ("ok", 1, -1.0), ("ok", 1, 59.9), ("ok", 1, 59.0), ("overlap", None, None), ("invalid", None, None)]


def test_filter_steps_are_clamped_and_noise_grows_with_them():
    seconds = np.array([0.0, 0.5, 1.0, 30.0])
    filters = tracking.Motions()
    for _ in seconds:
        filters.add(np.array([0.0, 0, 10, 20]))
    filters.mean[:, 4] = 8.0
    filters.predict(seconds)
    assert filters.mean[:, 0].tolist() == [5, 9, 13, 13]
    assert (filters.cov[2] == filters.cov[3]).all() and filters.cov[1, 2, 2] < filters.cov[2, 2, 2] and (filters.cov == filters.cov.transpose(0, 2, 1)).all()
    assert np.isclose(filters.cov[1, 0, 0], 2 * 2 * 1.0 + 0.25 * (10 * 20 / 160) ** 2 + (0.5 * 1.0) ** 2)


def test_tracks_over_a_literal_trace():
    """A box that moves, is weak for a frame, is lost and comes back."""
    box = lambda x, c: [x, 0.0, x + 10, 20.0, c]
    frames = [(0, [box(0, 0.9)]), (1, [box(2, 0.9)]), (2, [box(4, 0.2)]), (3, []), (4, [box(8, 0.9), box(80, 0.7)]), (5, [box(10, 0.9)]), (6, [box(12, 0.05)])]
    tracker, out = tracking.Tracker(kalman=True, lifecycle=True), []
    for frame, boxes in frames:
        out += [(r["frame"], r["kind"], f"person-{r['number']}", r["state"]) for r in tracker({"frame": frame, "at": frame * 0.2, "boxes": boxes})]
    assert out == [
        (0, "box", "person-1", "TENTATIVE"), (0, "move", "person-1", "TENTATIVE"), (1, "box", "person-1", "TRACKED"), (1, "move", "person-1", "TENTATIVE>TRACKED"), (2, "box", "person-1", "TRACKED"),
        (3, "move", "person-1", "TRACKED>LOST"), (4, "box", "person-1", "TRACKED"), (4, "box", "person-2", "TENTATIVE"), (4, "move", "person-1", "LOST>TRACKED"), (4, "move", "person-2", "TENTATIVE"),
        (5, "box", "person-1", "TRACKED"), (5, "move", "person-2", "TENTATIVE>REMOVED"), (6, "move", "person-1", "TRACKED>LOST"),
    ]


def test_patches_merge_along_both_axes_and_peaks_go_row_by_row():
    height = np.zeros((20, 20))
    height[5, 9] = height[9, 5] = 7.0
    assert density.grown(height, 1)[0]["cells"] == [(9, 5)]  # the lower row, then the lower column
    found = [{"cells": [(0, 0)], "support": 5.0, "at": np.array([0.0, 0.0])}, {"cells": [(3, 3)], "support": 4.0, "at": np.array([3.0, 3.0])}, {"cells": [(4, 0)], "support": 3.0, "at": np.array([5.6, 0.0])}]
    assert [(m["support"], len(m["cells"])) for m in density.merged(found)] == [(9.0, 2), (3.0, 1)]


def test_support_is_counted_in_the_placed_polygon(spark, monkeypatch):
    """A polygon that had to give way and holds too few points is dropped, and what is weaker is placed as if it were not there."""
    rng = np.random.default_rng(2)
    spots = [(0.3, 0.3, 300), (0.7, 0.6, 200), (0.5, 0.2, 90)]
    points = [("c", float(x), float(y)) for cx, cy, n in spots for x, y in rng.normal((cx, cy), 0.01, (n, 2))] + [("c", None, 0.5)] + [(None, 0.2, 0.2)] * 60
    df = spark.createDataFrame(points, "camera string, x double, y double")
    inside = lambda p, x, y: all((b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]) >= 0 for a, b in zip(p, [*p[1:], p[0]], strict=True))
    got = density.density_clusters(df, "camera").collect()
    assert len(got) == 4 and [r.cluster for r in sorted((r for r in got if r.camera), key=lambda r: (r.y, r.x))] == [1, 2, 3]
    for r in got:
        assert r.n == sum(c == r.camera and x is not None and inside(r.polygon, x, y) for c, x, y in points) >= density.LEAST
    real = density.clusters

    def first_gives_way(grid, most, least, rejected):
        """The strongest polygon is placed where nothing lies, until it is rejected."""
        out = real(grid, most, least, rejected)
        return [c | {"polygon": [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)]} if c["place"] == 0 else c for c in out]

    monkeypatch.setattr(density, "clusters", first_gives_way)
    left = density.density_clusters(df.where("camera is not null"), "camera").collect()
    assert sorted(r.n for r in left) == sorted(r.n for r in got if r.camera)[:2] and density.density_clusters(df.limit(0), "camera").count() == 0


def test_a_long_chain_of_near_copies_settles(spark):
    """Every row depends on the one before it: 40 rounds, one leader in two."""
    bits = [sum(1 << b for b in range(i)) for i in range(0, 60, 3)]
    rows = [("k", i, f"s{i}", b - (1 << 64) if b >> 63 else b, "x", False, 100.0 - i) for i, b in enumerate(bits)]
    got = {r.id: (r.group_id, r.reason) for r in dedup.leader_groups(spark.createDataFrame(rows, "camera string, id long, sha256 string, bits long, label string, reviewed boolean, sharpness double"), "camera").collect()}
    assert got == {i: (i, "leader") if i % 2 == 0 else (i - 1, "near") for i in range(20)}


def test_equal_kinds_only_are_matched(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9, "a"), (1, 1, 50.0, 0.0, 60.0, 10.0, 0.9, "b")]
    truth = spark.createDataFrame(rows, SCHEMA + ", kind string")
    found = spark.createDataFrame([(*r[:7], "b") for r in rows], SCHEMA + ", kind string")
    got = {k: tuple(matching.match_frames(truth, found, "frame", ["at"], matching.greedy_in_order, 0.5, k).first())[1:] for k in (None, "kind")}
    assert got == {None: (2, 0, 0), "kind": (1, 1, 1)}


@pytest.mark.parametrize("name", ["tracker_replay", "handover_replay"])
def test_replays_gather_no_key(name, spark, sf_dir):
    assert "FlatMapGroupsInPandas" not in catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()

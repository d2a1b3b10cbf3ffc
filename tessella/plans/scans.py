"""Scans, predicates, paging, set checks and scalar functions over the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessella.functions import geometry as g
from tessella.functions import hashing as h
from tessella.functions import text as s
from tessella.functions import timefmt as tf
from tessella.functions import vectors as v
from tessella.operators import filters, paging, setops
from tessella.plans.registry import events, query, table, text
from tessella.sources import readers, writers

DAY = "2024-01-10 00:00:00"
_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


@query(f"select event_id, {_TS} as ts, value from events where user_id = 7 and ts >= '2024-01-05' and ts < '2024-01-20'")
def range_scan(spark, d):
    rows = paging.range_scan(table(spark, d, "events"), "user_id", 7, "ts", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20))
    return rows.select("event_id", text("ts").alias("ts"), "value")


@query("select event_id, user_id from events where event_type = 'click' order by ts desc, event_id limit 25")
def recent_scan(spark, d):
    return paging.newest(table(spark, d, "events").where("event_type = 'click'"), "ts", "event_id", 25).select("event_id", "user_id")


@query("select event_id, user_id, event_type, value from events where event_id = 42")
def point_lookup(spark, d):
    return readers.point_lookup(table(spark, d, "events"), "event_id", 42).select("event_id", "user_id", "event_type", "value")


@query("select c_custkey, c_name from customer where c_custkey in (1, 5, 9, 100000000)")
def multi_lookup(spark, d):
    return readers.multi_lookup(table(spark, d, "customer"), "c_custkey", [1, 5, 9, 100000000]).select("c_custkey", "c_name")


@query("select o_orderkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def semi_lookup(spark, d):
    wanted = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return readers.multi_lookup(table(spark, d, "orders"), "o_custkey", wanted).select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 40")
def offset_page(spark, d):
    return paging.page(table(spark, d, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 40, 20).select("o_orderkey", "o_totalprice")


@query(f"select event_id, {_TS} as ts from events where ts < '{DAY}' or (ts = '{DAY}' and event_id < 100) order by ts desc, event_id desc limit 31")
def keyset_page(spark, d):
    rows = paging.keyset_page(table(spark, d, "events"), "ts", "event_id", 30, (dt.datetime(2024, 1, 10), 100))
    return rows.select("event_id", text("ts").alias("ts"))


@query(f"select e.event_id, {_TS.replace('ts,', 'e.ts,')} as ts from events e, (select ts as t, event_id as i from events where event_id = 50) c where e.ts < t or (e.ts = t and e.event_id < i) order by e.ts desc, e.event_id desc limit 20")
def keyset_after(spark, d):
    return paging.keyset_after(table(spark, d, "events"), "ts", "event_id", 20, 50).select("event_id", text("ts").alias("ts"))


@query("select event_id from events where event_id < 0 union all select max(event_id) from events where (select count(*) from events where event_id = -1) = 0")
def keyset_unknown_cursor(spark, d):
    """A cursor that does not exist gives no page; the largest id beside it shows that the table was read."""
    e = table(spark, d, "events")
    return paging.keyset_after(e, "ts", "event_id", 20, -1).select("event_id").union(e.agg(F.max("event_id")))


@query("select p_partkey, p_brand from part order by case when regexp_matches(p_brand, '^Brand#?[0-9]+$') then 0 else 1 end, cast(nullif(regexp_extract(p_brand, '^Brand#?([0-9]+)$', 1), '') as bigint), p_brand, p_partkey")
def natural_sort(spark, d):
    return table(spark, d, "part").orderBy(*paging.natural_order(F.col("p_brand"), "Brand"), "p_partkey").select("p_partkey", "p_brand")


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as r from events) where r <= 2")
def top_per_user(spark, d):
    return paging.top_per_group(table(spark, d, "events"), ["user_id"], [F.desc("value"), "event_id"], 2).select("user_id", "event_id")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def latest_state(spark, d):
    return paging.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("select distinct l_orderkey from lineitem where l_returnflag = 'R' and l_linestatus = 'F' and l_quantity >= 45")
def nested_any_match(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_linestatus", (F.col("l_quantity") >= 45).alias("large"))).alias("lines"))
    return lines.where(filters.nested_any(F.col("lines"), l_returnflag="R", l_linestatus="F", large=True)).select("l_orderkey")


@query("select event_id, case when value >= 50 then 'high' when value >= 10 then 'low' end as band from events")
def confidence_bands(spark, d):
    return table(spark, d, "events").select("event_id", filters.confidence_band(F.col("value"), 10, 50).alias("band"))


@query("select event_id, case when event_type = 'purchase' then 'VACANT' when value < 30 then 'UNKNOWN' else 'OCCUPIED' end as state from events")
def seat_states(spark, d):
    return table(spark, d, "events").select("event_id", filters.seat_state(F.col("event_type") != "purchase", F.col("value"), 30).alias("state"))


@query("select s_suppkey, case when s_acctbal < 1000 then 'connected' when s_acctbal < 2000 then 'stale' else 'no_video' end as status from supplier")
def source_freshness(spark, d):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    rows = table(spark, d, "supplier").withColumn("last", F.timestamp_micros(F.unix_micros(now) - (F.greatest("s_acctbal", F.lit(0)) * 1e6).cast("long")))
    return rows.select("s_suppkey", filters.freshness(F.col("last"), now, 1000).alias("status"))


@query("select event_id, case when ts < timestamp '2024-01-15 00:00:00' then 'UNKNOWN' else event_type end as state, case when ts >= timestamp '2024-01-15 00:00:00' then user_id end as seat from events")
def display_mask(spark, d):
    rows = events(spark, d).select("event_id", F.col("ts").alias("observed_at"), F.col("event_type").alias("state"), F.col("user_id").alias("seat"))
    return filters.mask_stale(rows, F.lit("2024-01-16 00:00:00").cast("timestamp"), 86400).select("event_id", "state", "seat")


@query("select l_orderkey, l_linenumber from lineitem where l_linenumber % 3 = 0")
def every_nth(spark, d):
    return filters.every_nth(table(spark, d, "lineitem"), 3, "l_linenumber").select("l_orderkey", "l_linenumber")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where cast(json_extract(props, '$.k') as bigint) >= 50")
def json_plan_filter(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").withColumn("k", k).where("k >= 50").select("event_id", "k")


@query("select o_orderkey from orders where not exists (select 1 from customer where c_custkey = o_custkey and c_acctbal > 0)")
def broken_references(spark, d):
    good = table(spark, d, "customer").where("c_acctbal > 0")
    return setops.not_in(table(spark, d, "orders"), good, "o_custkey", "c_custkey").select("o_orderkey")


@query("select o_orderkey, case when o_totalprice < 0 then 'NEGATIVE' when o_totalprice > 300000 then 'LARGE' when o_orderstatus = 'P' then 'PENDING' end as code from orders")
def rejection_code(spark, d):
    rules = [("NEGATIVE", F.col("o_totalprice") < 0), ("LARGE", F.col("o_totalprice") > 300000), ("PENDING", F.col("o_orderstatus") == "P")]
    return table(spark, d, "orders").select("o_orderkey", filters.first_failure(rules).alias("code"))


@query("select p_partkey, concat_ws(',', case when p_size < 10 then 'SMALL' end, case when p_retailprice > 1500 then 'DEAR' end) as reasons from part")
def quality_reasons(spark, d):
    rules = [("SMALL", F.col("p_size") < 10), ("DEAR", F.col("p_retailprice") > 1500)]
    return table(spark, d, "part").select("p_partkey", F.array_join(filters.reasons(rules), ",").alias("reasons"))


@query("select event_id, case when abs(value - 50) / 15 <= 1 and abs(value % 20 - 10) / (case when value % 20 >= 10 then 12 else 10 end) <= 1 then 'front' when abs(value - 50) / 15 >= abs(value % 20 - 10) / (case when value % 20 >= 10 then 12 else 10 end) then case when value > 50 then 'right' else 'left' end else case when value % 20 >= 10 then 'up' else 'down' end end as pose from events")
def pose_class(spark, d):
    return table(spark, d, "events").select("event_id", filters.pose(F.col("value") - 50, F.col("value") % 20 - 10).alias("pose"))


@query("select count(*) filter (c_acctbal >= 0 and c_nationkey >= 5) as complete, count(*) filter (c_acctbal < 0 and c_nationkey < 5) as empty, count(*) filter ((c_acctbal < 0) <> (c_nationkey < 5)) as partial, count(*) filter (c_mktsegment = 'BUILDING' and c_acctbal < 0 and c_nationkey < 5) as active_empty from customer")
def preflight_counts(spark, d):
    rows = table(spark, d, "customer").select(F.when(F.col("c_acctbal") >= 0, 1).alias("r"), F.when(F.col("c_nationkey") >= 5, 1).alias("c"), (F.col("c_mktsegment") == "BUILDING").alias("a"))
    return filters.preflight(rows, "r", "c", "a")


@query("select count(*) filter (w > 0 and p = 0) as missing, count(*) filter (w = 0) as unknown, count(*) filter (p > 1) as shared from (select k, max(w) as w, sum(p) as p from (select distinct o_custkey as k, 0 as w, 1 as p from orders where o_orderstatus = 'F' union all select distinct o_custkey, 0, 1 from orders where o_orderstatus = 'O' union all select c_custkey, 1, 0 from customer) group by k)")
def cover_check(spark, d):
    o = table(spark, d, "orders")
    parts = [o.where(F.col("o_orderstatus") == k).select(F.col("o_custkey").alias("c_custkey")) for k in "FO"]
    return setops.cover(table(spark, d, "customer"), parts, "c_custkey")


@query("select k, case when r is null then 'left' else 'right' end as side from (select coalesce(a.k, b.k) as k, a.k as l, b.k as r from (select distinct c_custkey as k from customer where c_nationkey < 20) a full join (select distinct o_custkey as k from orders) b on a.k = b.k) where l is null or r is null")
def coverage_difference(spark, d):
    a = table(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("k"))
    return setops.coverage(a, table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("select text, count(distinct source) as roles from documents group by text having count(distinct source) > 1")
def cross_role_content(spark, d):
    return setops.in_several_roles(table(spark, d, "documents"), "text", "source")


@query("select o_custkey, o_orderstatus, count(*) as n from orders group by all having count(*) > 1")
def repeated_keys(spark, d):
    return setops.repeated(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"])


@query("select 'left' as side, n_nationkey, n_name from nation where n_nationkey >= 20 union all select 'right', n_nationkey, n_name from nation where n_nationkey < 3")
def table_differences(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return setops.differences(n.where("n_nationkey >= 3"), n.where("n_nationkey < 20")).select("side", "n_nationkey", "n_name")


_DIGITS = [f"cast(sum(cast('0x' || substr(h, {i}, 12) as bigint)) as varchar)" for i in (1, 13, 25, 37, 49)]


@query(f"""select n, sha256(n || ':' || {" || ':' || ".join(f"p{i}" for i in range(5))}) as checksum from (select count(*) as n, {", ".join(f"{p} as p{i}" for i, p in enumerate(_DIGITS))}
  from (select sha256('{{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}}') as h from nation))""")
def table_checksum(spark, d):
    return setops.checksum(table(spark, d, "nation"))


@query("select n_nationkey, n_name from nation where n_nationkey < 10 union all select n_nationkey, n_name from nation where n_nationkey >= 10")
def extension_union(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return setops.extend_without_collision(n.where("n_nationkey < 10"), n, "n_nationkey")


@query("select count(distinct (user_id, cast(ts as date))) as pairs from events")
def distinct_days(spark, d):
    return table(spark, d, "events").select("user_id", F.to_date("ts").alias("day")).distinct().agg(F.count(F.lit(1)).alias("pairs"))


@query("select min(n) as free from (select unnest(range(1, 101)) as n) where n not in (select cast(regexp_extract(p_brand, '([0-9]+)', 1) as bigint) from part)")
def seat_mex(spark, d):
    used = table(spark, d, "part").select(F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("n"))
    return setops.not_in(spark.range(1, 101).withColumnRenamed("id", "n"), used, "n", "n").agg(F.min("n").alias("free"))


@query("""select c_custkey, nullif(trim(c_mktsegment), '') as segment, regexp_replace(c_name, '[^A-Za-z0-9._-]+', '_', 'g') as slug, regexp_matches(c_mktsegment, '^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$') as safe,
  'S' || case when c_custkey < 100 then lpad(cast(c_custkey as varchar), 2, '0') else cast(c_custkey as varchar) end as code, c_mktsegment || ' ' || c_name as label from customer""")
def string_functions(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", s.blank_to_null(F.col("c_mktsegment")).alias("segment"), s.slug(F.col("c_name")).alias("slug"), s.is_safe_id(F.col("c_mktsegment")).alias("safe"), s.padded(F.col("c_custkey")).alias("code"), s.label(F.col("c_mktsegment"), F.col("c_name")).alias("label"))


@query("""select event_id, cast(user_id as varchar) || '-' || strftime(ts, '%Y%m%dT%H%M%S') || lpad(cast(cast(floor(extract(microseconds from ts) / 1000) as bigint) % 1000 as varchar), 3, '0') || 'Z-' || event_id as id,
  cast(user_id as varchar) || '-' || cast(floor(epoch_us(ts) / 1000) as bigint) || '-' || event_id || '-entry-face' as entry_id from events""")
def event_ids(spark, d):
    e = events(spark, d)
    c = F.col("user_id").cast("string")
    return e.select("event_id", s.event_id(c, F.col("ts"), F.col("event_id")).alias("id"), s.entry_event_id(c, F.col("ts"), F.col("event_id")).alias("entry_id"))


@query("select event_id, user_id || '/' || strftime(ts, '%Y-%m-%d/%Y%m%dT%H%M%S') || lpad(cast((epoch_us(ts) // 1000) % 1000 as varchar), 3, '0') || '.jpg' as key, cast(user_id as varchar) as camera, epoch_us(ts) // 1000 as millis from events")
def object_keys(spark, d):
    e = events(spark, d).withColumn("key", s.object_key(F.col("user_id").cast("string"), F.col("ts"), ".jpg"))
    back = s.parse_object_key(F.col("key"), ".jpg")
    return e.select("event_id", "key", back["camera"].alias("camera"), F.unix_millis(back["ts"]).alias("millis"))


@query("select page_id, regexp_replace(url, '://', '://user:pw@') <> url as changed, regexp_replace(url, '://', '://***@') as masked from pages where url like '%://%'")
def credential_mask(spark, d):
    p = table(spark, d, "pages").where("url like '%://%'").withColumn("with", F.regexp_replace("url", "://", "://user:pw@"))
    return p.select("page_id", (F.col("with") != F.col("url")).alias("changed"), s.mask_credentials(F.col("with")).alias("masked"))


@query("select event_id, json_extract_string(props, '$.k') as k, 0 as unknown from events")
def json_functions(spark, d):
    wrapped = F.concat(F.lit("Here it is:\n"), F.col("props"), F.lit("\nDone."))
    found = s.json_object(wrapped)
    return table(spark, d, "events").select("event_id", F.get_json_object(found, "$.k").alias("k"), F.size(s.unknown_keys(found, ["k"])).alias("unknown"))


@query("""select event_id, strftime(ts + interval 9 hour, '%Y-%m-%d %H:%M:%S') as local, strftime(cast(ts + interval 9 hour as date), '%Y-%m-%d') as day, strftime(date_trunc('week', ts + interval 9 hour), '%Y-%m-%d') as week,
  case when value < 80 then 'short' when value > 120 then 'long' end as warning from events""")
def time_functions(spark, d):
    ts = F.col("ts")
    return events(spark, d).select("event_id", tf.local_text(ts).alias("local"), tf.local_day(ts).cast("string").alias("day"), tf.week_start(ts).cast("string").alias("week"), tf.duration_warning(F.col("value"), 100).alias("warning"))


_CLOCK = "case when extract(second from a) // 1 <> 0 or extract(second from b) // 1 <> 0 then strftime({0}, '%H:%M:%S') else strftime({0}, '%H:%M') end"
_DATED = "year({0}) || '년 ' || month({0}) || '월 ' || day({0}) || '일'"
_PERIOD = f"""case when cast(a as date) = cast(b as date) then {_DATED.format("a")} || ' ' || {_CLOCK.format("a")} || '~' || {_CLOCK.format("b")}
  else {_DATED.format("a")} || ' ' || {_CLOCK.format("a")} || '부터 ' || case when year(a) = year(b) then month(b) || '월 ' || day(b) || '일' else {_DATED.format("b")} end || ' ' || {_CLOCK.format("b")} || '까지' end"""


@query(f"select event_id, {_PERIOD} as period from (select event_id, t + interval 9 hour as a, t + interval 9 hour + interval 2 hour + case when event_id % 5 = 0 then interval 340 day else interval 0 day end as b from (select event_id, case when event_id % 3 = 0 then date_trunc('minute', ts) else ts end as t from events))")
def period_texts(spark, d):
    """Whole minutes, seconds, midnights and turns of the year."""
    e = events(spark, d).select("event_id", F.when(F.col("event_id") % 3 == 0, F.date_trunc("minute", "ts")).otherwise(F.col("ts")).alias("a"))
    b = F.col("a") + F.expr("make_interval(0, 0, 0, if(event_id % 5 = 0, 340, 0), 2)")
    return e.select("event_id", tf.period_text(F.col("a"), b).alias("period"))


_BOXES = "select l_orderkey, l_linenumber, l_quantity as x1, l_tax * 100 as y1, l_quantity + 20 as x2, l_tax * 100 + 10 as y2 from lineitem"


@query(f"""with b as ({_BOXES}), p as (select a.l_orderkey as k, a.l_linenumber as i, b.l_linenumber as j, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) as inter from b a join b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber)
select k, i, j, round(inter / (400 - inter), 6) as iou, round(inter / 200, 6) as ios from p where inter / (400 - inter) >= 0.3""")
def iou_pairs(spark, d):
    b = boxes(spark, d)
    a, c = b.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), *[F.col(n).alias(f"a{n}") for n in ("x1", "y1", "x2", "y2")]), b.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("j"), *[F.col(n).alias(f"b{n}") for n in ("x1", "y1", "x2", "y2")])
    pairs = a.join(c, "k").where("i < j")
    return pairs.select("k", "i", "j", F.round(g.iou(g.box("a"), g.box("b")), 6).alias("iou"), F.round(g.ios(g.box("a"), g.box("b")), 6).alias("ios")).where(g.iou(g.box("a"), g.box("b")) >= 0.3)


def boxes(spark, d):
    """Boxes by arithmetic: 20 wide, 10 high, one for each line item, an order being a frame."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x1"), (F.col("l_tax") * 100).alias("y1"), (F.col("l_quantity") + 20).alias("x2"), (F.col("l_tax") * 100 + 10).alias("y2"), (1 - F.col("l_discount")).alias("confidence"))


@query(f"select l_orderkey, l_linenumber, round((x1 + x2) / 2 / 100, 6) as cx, round((y1 + y2) / 2 / 50, 6) as cy, round((x2 - x1) / 100, 6) as w, round((y2 - y1) / 50, 6) as h, round((x2 - x1) / (y2 - y1), 6) as aspect, (x1 + x2) / 2 between 10 and 40 and y2 between 5 and 15 as in_zone from ({_BOXES})")
def box_transforms(spark, d):
    b = g.box()
    rows = boxes(spark, d)
    cx, cy, w, hh = g.to_yolo(b, F.lit(100.0), F.lit(50.0))
    fx, fy = g.foot(b)
    return rows.select("l_orderkey", "l_linenumber", F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"), F.round(w, 6).alias("w"), F.round(hh, 6).alias("h"), F.round(g.to_xyah(b)[2], 6).alias("aspect"), g.in_zone(fx, fy, (10, 5, 40, 15)).alias("in_zone"))


@query(f"select l_orderkey, l_linenumber, round((2 * x1 + y1 + 3) / (0.01 * x1 + 1), 6) as u, round((y1 - 1) / (0.01 * x1 + 1), 6) as v from ({_BOXES})")
def homography(spark, d):
    u, w = g.project(F.col("x1"), F.col("y1"), [[2, 1, 3], [0, 1, -1], [0.01, 0, 1]])
    return boxes(spark, d).select("l_orderkey", "l_linenumber", F.round(u, 6).alias("u"), F.round(w, 6).alias("v"))


@query("select l_orderkey, count(*) > 0 and min(l_quantity) >= 1 as ok, bool_or(l_discount > 0.09) as weak from lineitem group by l_orderkey")
def nested_validation(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_discount")).alias("x"))
    return lines.select("l_orderkey", ((F.size("x") > 0) & F.forall("x", lambda e: e["l_quantity"] >= 1)).alias("ok"), F.exists("x", lambda e: e["l_discount"] > 0.09).alias("weak"))


@query("select vec_id, abs(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) - 1) <= 0.001 as valid, round(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double))), 4) as squared from embeddings")
def vector_checks(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", v.valid_vector(e, 64).alias("valid"), F.round(v.dot(e, e), 4).alias("squared"))


@query("select doc_id, substr(sha256(cast(doc_id as varchar) || ':' || source), 1, 24) as id, sha256('run:' || doc_id) as sampling_key, bit_count(xor(doc_id, 12345)) as distance from documents")
def hash_functions(spark, d):
    return table(spark, d, "documents").select("doc_id", h.sha(F.col("doc_id").cast("string"), "source", digits=24).alias("id"), h.sampling_key("run", F.col("doc_id")).alias("sampling_key"), v.hamming(F.col("doc_id"), F.lit(12345).cast("long")).alias("distance"))


@query("select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id from (select doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(cast(doc_id as varchar))) as h from documents)")
def uuid5_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", h.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("doc_id").cast("string")).alias("id"))


@query("select o_orderkey, l_linenumber, l_quantity from orders join lineitem on o_orderkey = l_orderkey where o_orderdate >= '1996-01-01' and o_orderdate < '1996-02-01' and l_quantity > 40")
def pruned_join(spark, d):
    o = table(spark, d, "orders").where((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1996-02-01").cast("timestamp_ntz")))
    return o.join(table(spark, d, "lineitem").where("l_quantity > 40"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity")


@query("select event_id from events where ts > timestamp '2024-01-31 00:00:00' - interval 10 day")
def ttl_retained(spark, d):
    return writers.retained(events(spark, d), "ts", F.lit("2024-01-31 00:00:00").cast("timestamp"), 10).select("event_id")


@query("select count(*) filter (ts <= timestamp '2024-01-31 00:00:00' - interval 10 day) as removed, count(*) as inspected from events")
def purge_report(spark, d):
    return writers.purge_report(events(spark, d), "ts", F.lit("2024-01-31 00:00:00").cast("timestamp"), 10)


@query("select event_id from (select *, max(ts) over (partition by user_id) as m from events) where ts < m or timestamp '2024-01-30 12:00:00' - ts >= interval 6 hour")
def segment_eligible(spark, d):
    return writers.complete_segments(events(spark, d), "user_id", "ts", F.lit("2024-01-30 12:00:00").cast("timestamp"), 6 * 3600).select("event_id")


@query("select event_id, case when event_id % 3 = 0 and event_id % 2 = 0 then 'conflict' when event_id % 2 = 0 then 'same' else 'inserted' end as status from events")
def idempotent_insert(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value", F.lit(1).alias("received_at"))
    stored = e.where("event_id % 2 = 0").withColumns({"received_at": F.lit(0), "value": F.when(F.col("event_id") % 3 == 0, F.col("value") + 1).otherwise(F.col("value"))})
    return writers.insert_if_absent(stored, e, "event_id")


@query("select count(*) as n, count(distinct event_id) as ids from events")
def append_history(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return writers.append_history(e.where("event_id % 2 = 0"), e.union(e), "event_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query(f"select user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as ts from events group by user_id")
def monotonic_max(spark, d):
    return writers.latest_time(table(spark, d, "events"), "user_id", "ts").select("user_id", text("ts").alias("ts"))


@query("with p as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders), s as (select *, row_number() over (partition by o_orderkey % 50 order by o_orderdate desc, o_orderkey desc) as q from p where r = 1) select o_custkey, o_orderkey % 50 as seat from s where q = 1")
def assign_or_move(spark, d):
    log = table(spark, d, "orders").withColumn("seat", F.col("o_orderkey") % 50)
    return writers.assignments(log, "seat", "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "seat")


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def cascade_delete(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return writers.without_deleted(table(spark, d, "orders"), gone, "o_custkey").select("o_orderkey")


@query("select 'source-' || substr(sha256('query salt:' || user_id), 1, 8) as alias, event_id, value from (select *, row_number() over (partition by user_id order by ts, event_id) as r from events) where r <= 5")
def anonymised_trace(spark, d):
    return writers.anonymised(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_id", "value"], 5, "query salt:")


@query("""select '{"n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' as value from nation""")
def run_log(spark, d):
    return writers.run_log(table(spark, d, "nation"), ["n_nationkey", "n_regionkey"])


@query("select format('0 {:.8f} {:.8f} 0.20000000 0.20000000', l_discount + 0.3, l_tax + 0.3) as value, l_orderkey as frame from lineitem group by all")
def label_lines(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), F.lit(0).alias("class"), (F.col("l_discount") + 0.3).alias("cx"), (F.col("l_tax") + 0.3).alias("cy"), F.lit(0.2).alias("w"), F.lit(0.2).alias("h"))
    return writers.label_lines(b)


@query("select l_orderkey, l_linenumber, l_discount + 0.3 >= 0.1 and l_tax + 0.97 <= 1.000001 as valid from lineitem")
def label_parse(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(" ", F.lit("0"), (F.col("l_discount") + 0.3).cast("string"), (F.col("l_tax") + 0.87).cast("string"), F.lit("0.2"), F.lit("0.2")).alias("value"))
    return readers.parse_labels(lines).select("l_orderkey", "l_linenumber", "valid")


@query("select event_id, 'p' || user_id as period, event_type as student_state from events")
def report_event_scan(spark, d):
    e = table(spark, d, "events").select("event_id", F.base64(F.to_json(F.array(F.struct(F.concat(F.lit("p"), "user_id").alias("period"), F.col("event_type").alias("student_state"), F.col("event_id").cast("string").alias("seat_number")))).cast("binary")).alias("payload"))
    return readers.report_events(e, base64=True).select(F.col("seat_number").cast("long").alias("event_id"), "period", "student_state")

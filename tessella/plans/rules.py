"""Predicates, validation, labels, look-ups, matching joins and gates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import geometry as g
from tessella.functions import text as s
from tessella.functions import timefmt as tf
from tessella.operators import aggregates, dedup, filters, joins, matching, paging, sampling, scan, setops, windows
from tessella.plans.registry import events, query, table, text
from tessella.plans.scans import boxes
from tessella.sources import readers, writers

NOW = "2024-01-15 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


@query("select event_id from events where event_type in ('click', 'view')")
def person_rows(spark, d):
    named = F.when(F.col("event_type") == "click", "Person").when(F.col("event_type") == "view", "PERSON").when(F.col("event_type") == "signup", "chair")
    return table(spark, d, "events").where(filters.is_person(named)).select("event_id")


@query("select event_id, case when event_type = 'click' and value / 200 >= 0.1 and value / 100 >= 0.5 and c_acctbal >= 0 then c_name else 'person' end as label from events left join customer on user_id = c_custkey")
def detection_labels(spark, d):
    e = table(spark, d, "events").join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey"), "left")
    kind = F.when(F.col("event_type") == "click", "person").otherwise("chair")
    return e.select("event_id", filters.detection_label(kind, F.col("value") / 200, F.col("value") / 100, F.col("c_name"), F.col("c_acctbal") >= 0, 0.1, 0.5).alias("label"))


@query("select event_id, case when event_type = 'view' then 'uncertain' when event_type = 'click' and c_acctbal >= 0 then c_name else 'unknown' end as label from events left join customer on user_id = c_custkey")
def entry_labels(spark, d):
    e = table(spark, d, "events").join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey"), "left")
    status = F.when(F.col("event_type") == "click", "REGISTERED").when(F.col("event_type") == "view", "UNCERTAIN").otherwise("UNKNOWN")
    return e.select("event_id", filters.entry_label(status, F.col("c_name"), F.col("c_acctbal") >= 0).alias("label"))


@query("select s_suppkey, s_nationkey % 4 <> 0 and (s_suppkey % 3 = 0 or coalesce(s_suppkey % 3 = r_regionkey % 3, false)) as usable from supplier join nation on s_nationkey = n_nationkey left join (select * from region where r_regionkey < 4) on n_regionkey = r_regionkey")
def usable_zones(spark, d):
    images = table(spark, d, "region").where("r_regionkey < 4").select(F.col("r_regionkey").alias("n_regionkey"), (F.col("r_regionkey") % 3).alias("current"))
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(images, "n_regionkey", "left")
    return rows.select("s_suppkey", filters.usable_zone(F.col("s_nationkey") % 4 == 0, F.col("s_suppkey") % 3, F.col("current")).alias("usable"))


@query("select l_orderkey, l_linenumber, l_quantity + 20 <= 60 and l_tax * 100 + 10 <= 15 and l_discount > 0 as valid from lineitem")
def valid_boxes(spark, d):
    b = boxes(spark, d).withColumn("x2", F.when(F.col("confidence") == 1, F.col("x1")).otherwise(F.col("x2")))
    return b.select("l_orderkey", "l_linenumber", filters.valid_box(F.lit(60), F.lit(15), g.box()).alias("valid"))


@query("select event_id, ((event_type = 'click') = (value >= 50)) and (event_id % 4 <> 0 or event_type = 'click') as consistent from events")
def identity_fields(spark, d):
    e = table(spark, d, "events")
    who, sure = F.when(F.col("event_type") == "click", F.col("user_id")), F.when(F.col("value") >= 50, F.col("value"))
    return e.select("event_id", filters.identity_consistent(who, sure, F.when(F.col("event_id") % 4 == 0, F.lit("box"))).alias("consistent"))


@query("""select event_id, '{"event_id":' || event_id || case when event_type = 'click' then ',"student_id":' || user_id else '' end || '}' as payload from events""")
def event_payloads(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", filters.identity_payload(F.col("event_id"), F.when(F.col("event_type") == "click", F.col("user_id")).alias("student_id")).alias("payload"))


_OBSERVED = """case event_type when 'click' then event_id % 3 <> 0 and value < 90 when 'view' then event_id % 3 = 0 and (value < 80 or value >= 90) when 'purchase' then event_id % 3 = 0 and value >= 90 else false end"""


@query(f"select event_id, {_OBSERVED} as valid from events")
def observation_rules(spark, d):
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "click", "REGISTERED").when(F.col("event_type") == "view", "UNCERTAIN").when(F.col("event_type") == "purchase", "UNKNOWN").otherwise("OTHER")
    alike = F.when(F.col("value") < 80, 0.5).when(F.col("value") < 90, F.when(F.col("event_type") == "view", 1.5).otherwise(-0.5))
    return e.select("event_id", filters.observation_valid(status, F.when(F.col("event_id") % 3 != 0, F.col("user_id")), alike).alias("valid"))


_UNIT_BOXES = "select l_orderkey, l_linenumber, l_quantity / 100 as x1, l_tax as y1, (l_quantity + 20) / 100 as x2, l_tax + 0.1 as y2, 1 - l_discount as confidence from lineitem"


@query(f"""with b as (select *, row_number() over () as i from ({_UNIT_BOXES})), p as (select distinct a.l_orderkey from b a join b on a.l_orderkey = b.l_orderkey and a.i < b.i where
  greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) / (0.04 - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)) >= 0.7)
select l_orderkey, bool_or(confidence < 0.92 or x1 <= 0.0 or y1 <= 0.0 or x2 >= 1 or y2 >= 1) or l_orderkey in (select l_orderkey from p) as needed from b group by l_orderkey""")
def review_needed(spark, d):
    b = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") / 100).alias("x1"), F.col("l_tax").alias("y1"), ((F.col("l_quantity") + 20) / 100).alias("x2"), (F.col("l_tax") + 0.1).alias("y2"), (1 - F.col("l_discount")).alias("confidence"))
    frames = b.groupBy("l_orderkey").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2", "confidence")).alias("boxes"))
    return frames.select("l_orderkey", filters.needs_review(F.col("boxes"), 0.92).alias("needed"))


@query("select o_orderkey, o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderdate > timestamp '1996-06-01' as approved from orders")
def approval_gate(spark, d):
    rows = table(spark, d, "orders").withColumn("until", F.col("o_orderdate").cast("timestamp"))
    return rows.select("o_orderkey", filters.approved(F.col("o_orderpriority"), F.col("until"), F.lit("1996-06-01").cast("timestamp"), ["1-URGENT", "2-HIGH"]).alias("approved"))


_QUADS = "select event_id, [{'x': 0.1, 'y': 0.1}, {'x': value / 250, 'y': 0.2}, {'x': 0.8, 'y': user_id / 200}, {'x': 0.2, 'y': 0.9}] as p from events"
_TURN = "sign(({b}.x - {a}.x) * ({c}.y - {a}.y) - ({b}.y - {a}.y) * ({c}.x - {a}.x))"


def _turn(a: int, b: int, c: int) -> str:
    return _TURN.format(a=f"p[{a}]", b=f"p[{b}]", c=f"p[{c}]")


def _cross(a: int, b: int, c: int, e: int) -> str:
    return f"({_turn(a, b, c)} * {_turn(a, b, e)} < 0 and {_turn(c, e, a)} * {_turn(c, e, b)} < 0)"


@query(f"""select event_id, p[2].x <= 1 and p[3].y <= 1 and not {_cross(1, 2, 3, 4)} and not {_cross(2, 3, 4, 1)}
  and abs((p[1].x * p[2].y - p[2].x * p[1].y + p[2].x * p[3].y - p[3].x * p[2].y + p[3].x * p[4].y - p[4].x * p[3].y + p[4].x * p[1].y - p[1].x * p[4].y) / 2) >= 1e-9 as valid from ({_QUADS})""")
def valid_polygons(spark, d):
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    p = F.array(point(F.lit(0.1), F.lit(0.1)), point(F.col("value") / 250, F.lit(0.2)), point(F.lit(0.8), F.col("user_id") / 200), point(F.lit(0.2), F.lit(0.9)))
    return table(spark, d, "events").select("event_id", g.valid_polygon(p).alias("valid"))


@query("""with r as (select l_orderkey as batch, l_partkey % 100 as seat, 1 - l_discount * 10 as confidence from lineitem), s as (select s_suppkey as seat from supplier where s_acctbal > 0)
select batch, count(*) between 1 and 200 and count(distinct seat) = count(*) and bool_and(confidence between 0 and 1) and bool_and(seat in (select seat from s)) as valid from r group by batch""")
def batch_rules(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch"), (F.col("l_partkey") % 100).alias("seat"), (1 - F.col("l_discount") * 10).alias("confidence"))
    seats = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("seat"))
    return filters.valid_batches(rows, seats, "batch", "seat", "confidence").select("batch", "valid")


@query("select p_partkey, lpad(cast(p_size % 24 as varchar), 2, '0') || ':00' as start, case when p_partkey % 3 = 0 then '1교시' else 'Study ' || p_brand end as name from part where p_partkey % 3 < 2")
def schedule_periods(spark, d):
    p = table(spark, d, "part")
    hour = F.lpad((F.col("p_size") % 24).cast("string"), 2, "0")
    name = F.when(F.col("p_partkey") % 3 == 0, "1교시").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Study "), "p_brand")).otherwise("lunch")
    lines = p.select("p_partkey", F.concat(F.lit("- **"), hour, F.lit(":00 ~ "), hour, F.lit(":50** | "), name, F.lit(" | room")).alias("value"))
    return filters.schedule_lines(lines, keep=["p_partkey"]).select("p_partkey", "start", "name")


_WORDS = "case p_partkey % 4 when 0 then '나무' when 1 then '책' when 2 then p_brand else '' end"


@query(f"select p_partkey, w || case when length(w) > 0 and unicode(right(w, 1)) between 44032 and 55203 and (unicode(right(w, 1)) - 44032) % 28 = 0 then '가' else '이' end as phrase from (select p_partkey, {_WORDS} as w from part)")
def particles(spark, d):
    word = F.when(F.col("p_partkey") % 4 == 0, "나무").when(F.col("p_partkey") % 4 == 1, "책").when(F.col("p_partkey") % 4 == 2, F.col("p_brand")).otherwise("")
    return table(spark, d, "part").select("p_partkey", s.with_particle(word, "이", "가").alias("phrase"))


@query("""select event_id, '오늘 동안 A실에서 찾았어요. ' || case when event_type = 'signup' then '' when user_id % 5 = 0 then '나무가 2명이라 누구인지 정하지 못했고, ' when user_id % 5 = 1 then '나무를 학생 명부에서 찾지 못해 인물 조건은 걸지 못했고, '
  when user_id % 5 = 2 then '얼굴 인식이 아직 연결되지 않아 나무가 있었는지는 확인하지 못했고, ' when event_type = 'view' then '나무가 보이지 않는 기록만 골랐고, ' else '나무가 보이는 기록만 골랐고, ' end
  || case when value > 100 then '상한에 걸려 ' || event_id % 3 || '건까지만 보여드려요. 이게 전부는 아니에요.' when event_id % 3 = 0 then '결과는 없어요.' else '총 ' || event_id % 3 || '건의 결과가 있어요.' end as summary from events""")
def search_summaries(spark, d):
    e, kind = table(spark, d, "events"), F.col("user_id") % 5
    person = F.when(F.col("event_type") != "signup", "나무")
    matches = F.when(kind == 0, 2).when(kind == 1, 0).otherwise(1)
    return e.select("event_id", s.sentence(F.lit("오늘"), F.lit("A실"), person, matches, kind > 2, F.col("event_type") == "view", F.col("event_id") % 3, F.col("value") > 100).alias("summary"))


@query("select event_id, case when event_id % 3 = 0 then cast(user_id as varchar) end as camera, event_id % 3 = 0 as sound from events")
def key_value_lists(spark, d):
    a, b = F.concat(F.lit("cam="), F.col("user_id").cast("string")), F.concat(F.lit("room="), "event_type")
    line = F.when(F.col("event_id") % 3 == 0, F.concat_ws(",", a, b)).when(F.col("event_id") % 3 == 1, F.concat_ws(",", a, a)).otherwise(F.concat_ws(",", a, F.lit("lonely")))
    found = s.key_values(line)
    return table(spark, d, "events").select("event_id", F.try_element_at(found, F.lit("cam")).alias("camera"), found.isNotNull().alias("sound"))


@query("select event_id, case when event_id % 3 = 0 then epoch_us(date_trunc('second', ts)) // 1000000 when event_id % 3 = 1 then epoch_us(date_trunc('second', ts)) // 1000000 - 32400 end as seconds from events")
def aware_times(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    written = F.when(F.col("event_id") % 3 == 0, F.concat(stamp, F.lit("Z"))).when(F.col("event_id") % 3 == 1, F.concat(stamp, F.lit("+09:00"))).otherwise(stamp)
    return events(spark, d).select("event_id", F.unix_seconds(tf.parse_aware(written)).alias("seconds"))


@query("select event_id, case when event_id % 3 < 2 then epoch_us(date_trunc('second', ts)) // 1000000 - case when event_id % 3 = 0 then 32400 else 0 end end as seconds, case event_id % 3 when 0 then 'local_name' when 1 then 'utc_name' end as source from events")
def name_times(spark, d):
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("cam_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".mp4"))).when(F.col("event_id") % 3 == 1, F.concat(F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit("Z.mp4"))).otherwise("video.mp4")
    found = tf.name_time(name)
    return events(spark, d).select("event_id", F.unix_seconds(found["ts"]).alias("seconds"), found["source"].alias("source"))


@query("select event_id, least(greatest(value, 20), 80) as clamped, coalesce(user_id / nullif(event_id % 3, 0), 0) as ratio from events")
def clamped_values(spark, d):
    return table(spark, d, "events").select("event_id", g.clamp(F.col("value"), 20.0, 80.0).alias("clamped"), g.ratio(F.col("user_id"), F.col("event_id") % 3).alias("ratio"))


@query("with n as (select source, count(distinct doc_id) as n from documents group by 1), r as (select doc_id, source, row_number() over (partition by source order by sha256('legacy:' || doc_id)) as r from documents), k as (select *, case when n < 3 then 0 when n < 10 then 1 else cast(round_even(n * 0.1, 0) as bigint) end as k from r join n using (source)) select doc_id, case when r <= k then 'test' when r <= 2 * k then 'val' else 'train' end as split from k")
def three_way_split(spark, d):
    return sampling.three_way_split(table(spark, d, "documents"), "source", "doc_id", "legacy").select("doc_id", "split")


@query("with c as (select user_id, count(*) as c from events group by 1), o as (select user_id, unnest(range(1, c + 1)) as slot from c), r as (select user_id from o order by case when slot <= 1 then 0 else 1 end, slot, user_id limit 400) select c.user_id, count(r.user_id) as allocated from c left join r on c.user_id = r.user_id group by 1")
def waterfill_one_each(spark, d):
    c = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("c"))
    return sampling.waterfill(c, "user_id", "c", 400).select("user_id", "allocated")


@query("with g as (select min(doc_id) over (partition by text) as group_id, doc_id from documents), n as (select group_id, count(*) as n from g group by 1 having count(*) > 1) select group_id, n, doc_id as id, case when doc_id = group_id then 'leader' else 'same_content' end as reason from g join n using (group_id)")
def duplicate_report(spark, d):
    rows = dedup.exact_duplicates(table(spark, d, "documents"), F.col("text"), "doc_id")
    rows = rows.select(F.coalesce("duplicate_of", "doc_id").alias("group_id"), F.col("doc_id").alias("id"), F.when(F.col("duplicate_of").isNull(), "leader").otherwise("same_content").alias("reason"), F.lit(0).alias("distance"))
    return dedup.group_report(rows).select("group_id", "n", "id", "reason")


@query("select source, doc_id from (select *, row_number() over (partition by source order by lang = 'en' desc, n_chars desc, doc_id) as r from documents) where r = 1")
def representative_rows(spark, d):
    rows = table(spark, d, "documents").withColumn("reviewed", F.col("lang") == "en")
    return dedup.representatives(rows, "source", [F.desc_nulls_last("reviewed"), F.desc_nulls_last("n_chars"), F.asc("doc_id")]).select("source", "doc_id")


_TRACKS = "select event_id, user_id, epoch_us(ts) as t, value as x, event_id % 50 as y, event_type from events"


@query(f"""with e as ({_TRACKS}), p as (select a.event_id as lost_id, b.event_id as new_id from e a join e b on a.user_id = b.user_id and a.event_type = 'click' and b.event_type = 'view' and abs(b.t - a.t) <= 7200000000
  and (20 + b.event_id % 7) / (20 + a.event_id % 7) between 0.8 and 1.25 and sqrt(pow(a.x + (20 + a.event_id % 7) / 2 - b.x - (20 + b.event_id % 7) / 2, 2) + pow(a.y - b.y, 2)) / 100 <= 0.3)
select lost_id, new_id from (select *, count(*) over (partition by lost_id) as n, count(*) over (partition by new_id) as m from p) where n = 1 and m = 1""")
def recovered_tracks(spark, d):
    e = events(spark, d)
    width = 20 + F.col("event_id") % 7

    def side(kind: str, name: str, p: str):
        return e.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_at"), F.col("value").alias(f"{p}x"), (F.col("event_id") % 50).alias(f"{p}y"), width.alias(f"{p}w"), F.lit(10).alias(f"{p}h"))

    new = side("view", "new", "n").withColumn("diagonal", F.lit(100.0))
    return joins.recovered(side("click", "lost", "l"), new, "user_id", 7200, 0.8, 1.25, 0.3).select("lost_id", "new_id")


_FACES = """with b as (select l_orderkey, l_linenumber, l_quantity as x1, l_tax * 100 as y1 from lineitem),
h as (select f.l_orderkey, f.l_linenumber as face, p.l_linenumber as person from b f join b p on f.l_orderkey = p.l_orderkey where f.x1 + 2 >= p.x1 and f.x1 + 2 <= p.x1 + 20 and f.y1 + 2 >= p.y1 and f.y1 + 2 <= p.y1 + 10
  and greatest(least(f.x1 + 4, p.x1 + 20) - greatest(f.x1, p.x1), 0) * greatest(least(f.y1 + 4, p.y1 + 10) - greatest(f.y1, p.y1), 0) / 16 >= 0.8),
n as (select l_orderkey, face, count(*) as people, min(person) as person from h group by 1, 2), m as (select l_orderkey, person, count(*) as faces from h group by 1, 2)
select b.l_orderkey, b.l_linenumber as face, case when n.face is null then 'NO_PERSON' when people > 1 then 'MULTIPLE_PEOPLE' when faces > 1 then 'MULTIPLE_FACES' else 'MATCHED' end as reason
from b left join n on b.l_orderkey = n.l_orderkey and b.l_linenumber = n.face left join m on n.l_orderkey = m.l_orderkey and n.person = m.person"""


@query(_FACES)
def face_owners(spark, d):
    b = boxes(spark, d)
    people = b.select("l_orderkey", F.col("l_linenumber").alias("person"), F.col("x1").alias("px1"), F.col("y1").alias("py1"), F.col("x2").alias("px2"), F.col("y2").alias("py2"))
    faces = b.select("l_orderkey", F.col("l_linenumber").alias("face"), F.col("x1").alias("fx1"), F.col("y1").alias("fy1"), (F.col("x1") + 4).alias("fx2"), (F.col("y1") + 4).alias("fy2"))
    return joins.faces_to_people(people, faces, "l_orderkey").select("l_orderkey", "face", "reason")


@query("select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where s_acctbal > 0 and n_nationkey % 3 <> 0 and r_name <> 'ASIA'")
def active_routes(spark, d):
    entries = table(spark, d, "nation").select(F.col("n_nationkey").alias("camera_id"), "n_name", (F.col("n_nationkey") % 3 != 0).alias("enabled"), F.lit("entry").alias("role"), F.col("n_regionkey").alias("room"))
    rooms = table(spark, d, "region").select(F.col("r_regionkey").alias("camera_id"), (F.col("r_name") != "ASIA").alias("enabled"), F.lit("room").alias("role"))
    routes = table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey", F.col("s_nationkey").alias("entry_camera"))
    known = entries.select(F.col("camera_id").alias("entry_camera"), "n_name", F.col("room").alias("room_camera"))
    return joins.active_routes(routes.join(known, "entry_camera"), entries, rooms, "entry_camera", "room_camera").select("s_suppkey", "n_name")


@query("select event_id, case when value / 100 < 0.5 then 'left' when value / 100 > 0.5 and value / 100 <= 1 then 'right' end as seat from events")
def seat_suggestions(spark, d):
    square = lambda a, b: [{"x": float(x), "y": float(y)} for x, y in ((a, 0), (b, 0), (b, 1), (a, 1))]
    zones = spark.createDataFrame([("left", square(0, 0.5)), ("right", square(0.5, 1))], "zone string, polygon array<struct<x:double,y:double>>")
    point = lambda dx, dy: F.struct((F.col("value") / 100 + dx).alias("x"), F.lit(0.5 + dy).alias("y"))
    shapes = table(spark, d, "events").select("event_id", F.array(point(-0.1, -0.1), point(0.1, -0.1), point(0.1, 0.1), point(-0.1, 0.1)).alias("polygon"))
    return joins.suggested_zones(shapes, zones, "event_id").select("event_id", F.col("zone").alias("seat"))


@query("""with s as (select user_id as session, event_id % 5 as camera, min(event_id) as first from events group by 1, 2), a as (select user_id as session, case when user_id % 4 = 0 then 'excluded' when user_id % 4 = 1 then 'evaluation' else 'dataset' end as role from events group by 1)
select first, session, role from s join a using (session) where role <> 'excluded'""")
def session_roles(spark, d):
    e = table(spark, d, "events")
    inventory = e.groupBy(F.col("user_id").alias("session"), (F.col("event_id") % 5).alias("camera")).agg(F.min("event_id").alias("first"))
    role = F.when(F.col("session") % 4 == 0, "excluded").when(F.col("session") % 4 == 1, "evaluation").otherwise("dataset")
    assigned = e.select(F.col("user_id").alias("session")).distinct().withColumn("role", role)
    sessions = assigned.select("session")
    return joins.routed_sessions(sessions, inventory, assigned, "session").select("first", "session", "role")


@query("select count(*) filter (l_discount > 0.02) as tp, count(*) filter (l_tax > 0.07) as fp, count(*) filter (l_discount < 0.01) as fn, round((count(*) filter (l_tax > 0.07) + count(*) filter (l_discount < 0.01)) / (count(*) filter (l_discount > 0.02) + count(*) filter (l_tax > 0.07) + count(*) filter (l_discount < 0.01)), 9) as error_rate, false as passed from lineitem")
def sample_gate(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_discount") > 0.02).cast("int").alias("tp"), (F.col("l_tax") > 0.07).cast("int").alias("fp"), (F.col("l_discount") < 0.01).cast("int").alias("fn"))
    return aggregates.sample_gate(x).withColumn("error_rate", F.round("error_rate", 9))


@query("""select event_id, cast(r as bigint) as frames, cast(sum(case when event_type = 'click' then 1 else 0 end) over w as bigint) as faces, sum(case when event_type = 'click' then 1 else 0 end) over w / nullif(sum(case when event_type <> 'signup' then 1 else 0 end) over w, 0) as rate, round(avg(event_id % 100) over w, 6) as mean
  from (select *, row_number() over (partition by user_id order by ts, event_id) as r from events) window w as (partition by user_id order by ts, event_id rows unbounded preceding)""")
def running_diagnostics(spark, d):
    rows = events(spark, d).withColumn("millis", F.col("event_id") % 100)
    out = windows.diagnostics(rows, "user_id", ["ts", "event_id"], {"faces": F.col("event_type") == "click", "people": F.col("event_type") != "signup"}, "millis")
    return out.select("event_id", "frames", "faces", aggregates.nullable_ratio(F.col("faces"), F.col("people")).alias("rate"), F.round("mean", 6).alias("mean"))


@query("select count(*) as total, count(*) filter (event_type = 'purchase') as leaves, coalesce(round_even(100.0 * count(*) filter (event_type = 'purchase') / nullif(count(*), 0), 2), 0) as rate from events")
def chart_totals(spark, d):
    return aggregates.rollup_by(table(spark, d, "events"), [], F.col("event_type") == "purchase")


@query("with c as (select lang, count(*) as n from documents where lang is not null group by 1) select w.lang, expected, coalesce(n, 0) as found, expected = coalesce(n, 0) as right from (select lang, n as expected from c union all select 'zz', 3) w left join c using (lang)")
def split_counts(spark, d):
    docs = table(spark, d, "documents").where("lang is not null")
    wanted = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("expected")).union(spark.createDataFrame([("zz", 3)], "lang string, expected long"))
    return sampling.verified_counts(docs, wanted, "lang").select("lang", "expected", "found", "right")


@query("""with r as (select *, row_number() over (partition by user_id order by ts, event_id) as r, value - lag(value) over (partition by user_id order by ts, event_id) as dv, greatest((epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1e6, 0.001) as dt from events)
select event_id, round(list_reduce(list(dv / dt) filter (r > 1) over (partition by user_id order by r rows unbounded preceding), lambda a, b: 0.7 * a + 0.3 * b), 9) as velocity from r""")
def smoothed_velocity(spark, d):
    return scan.velocity(events(spark, d), ["user_id"], ["ts", "event_id"], "ts", "value").select("event_id", F.round("velocity", 9).alias("velocity"))


@query("select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, round(quantile, 6) as quantile from (select date_trunc('day', ts) as ts, event_type, case when 0.5 * n <= a then 50 * (0.5 * n) / a when 0.5 * n <= b then 50 + 50 * (0.5 * n - a) / (b - a) when b < n then 100 end as quantile from (select ts, event_type, count(*) as n, count(*) filter (value <= 50) as a, count(*) filter (value <= 100) as b from (select date_trunc('day', ts) as ts, event_type, value from events) group by 1, 2))")
def staged_quantiles(spark, d):
    from tessella.operators import metrics

    e = events(spark, d).withColumn("window_start", F.date_trunc("day", "ts"))
    b = aggregates.cumulative_buckets(e, ["window_start", "event_type"], "value", [50.0, 100.0])
    return metrics.bucket_quantile(b, ["window_start", "event_type"], 0.5).select(text("window_start").alias("window_start"), "event_type", F.round("quantile", 6).alias("quantile"))


@query("select user_id, case when ts >= timestamp '2024-01-29 00:00:00' then 1 else 0 end as up from (select user_id, max(ts) as ts from events group by 1)")
def instant_up(spark, d):
    from tessella.operators import metrics

    return metrics.instant_up(events(spark, d), "user_id", "ts", F.lit("2024-01-29 00:00:00").cast("timestamp")).select("user_id", "up")


@query("select event_id, props from events where regexp_matches(props, '9[0-9]') and ts >= timestamp '2024-01-15 00:00:00'")
def raw_log(spark, d):
    from tessella.operators import metrics

    return metrics.log_lines(events(spark, d).where(F.col("ts") >= now()), "props", "9[0-9]").select("event_id", "props")


@query("select o_orderkey from orders where o_custkey = 7 and o_orderdate >= '1995-01-01' and o_orderdate < '1997-01-01'")
def segment_range(spark, d):
    rows = table(spark, d, "orders").withColumn("from", F.col("o_orderdate").cast("timestamp"))
    return paging.range_scan(rows, "o_custkey", 7, "from", "1995-01-01", "1997-01-01").select("o_orderkey")


@query("select user_id, strftime(day, '%Y-%m-%d') as day from (select user_id, cast(ts as date) as day from events where event_type = 'click' union select user_id, cast(ts as date) from events where value > 90)")
def available_keys(spark, d):
    e = events(spark, d).select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "value")
    return setops.union_of_keys(["user_id", "day"], e.where("event_type = 'click'"), e.where("value > 90"))


@query("select count(*) as n, count(distinct (o_custkey, o_orderkey)) as ids from orders")
def accumulated_pages(spark, d):
    """Pages by key until none is left hold each row once."""
    rows = table(spark, d, "orders")
    return paging.accumulated(rows, ["o_custkey", "o_orderkey"], 200).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey", "o_orderkey").alias("ids"))


@query("select strftime(day, '%Y-%m-%d') as day, day in (select distinct cast(ts as date) from events where event_type = 'purchase') as recorded from (select cast(unnest(generate_series(date '2023-12-30', date '2024-02-02', interval 1 day)) as date) as day)")
def recorded_days(spark, d):
    days = spark.sql("select explode(sequence(date'2023-12-30', date'2024-02-02')) as day")
    seen = events(spark, d).where("event_type = 'purchase'").select(F.to_date("ts").alias("day"))
    return readers.recorded_days(days, seen).select(F.col("day").cast("string").alias("day"), "recorded")


@query("""select o_orderkey, case when o_orderkey % 7 = 0 then 'BAD_ID' when o_orderkey % 5 = 0 then 'NAIVE_TIME' when o_orderdate <= timestamp '1996-01-01' then 'EXPIRED' when o_orderpriority = '5-LOW' then 'NOT_APPROVED' end as problem from orders""")
def manifest_problems(spark, d):
    o = table(spark, d, "orders")
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "../etc").otherwise(F.concat(F.lit("s"), "o_orderkey")).alias("source_id"), F.when(F.col("o_orderkey") % 5 == 0, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00Z").alias("captured_at"), stamp.alias("expires_at"), F.when(F.col("o_orderpriority") != "5-LOW", "yes").alias("approval"))
    return readers.manifest(rows, F.lit("1996-01-01").cast("timestamp")).select("o_orderkey", "problem")


@query("""select c_custkey, case when c_custkey % 7 = 0 then 'BAD_ID' when c_custkey % 5 = 0 then 'BAD_ROLE' when c_acctbal < 0 and c_custkey % 3 <> 0 then 'MISSING_APPROVAL' when c_custkey % 11 = 0 then 'REPEATED' end as problem from customer""")
def assignment_problems(spark, d):
    c = table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit(" /"), "c_custkey")).when(F.col("c_custkey") % 11 == 0, F.concat(F.lit("twice"), F.floor(F.col("c_custkey") / 7700))).otherwise(F.concat(F.lit("s"), "c_custkey"))
    role = F.when(F.col("c_custkey") % 5 == 0, "other").when(F.col("c_custkey") % 3 == 0, "excluded").otherwise("dataset")
    rows = c.select("c_custkey", name.alias("session_id"), role.alias("role"), F.when(F.col("c_acctbal") >= 0, "ref").alias("approval_reference"))
    # one more row of the repeated name, so that it repeats in every table
    more = rows.limit(1).select(F.lit(None).cast("long").alias("c_custkey"), F.lit("twice0").alias("session_id"), F.lit("dataset").alias("role"), F.lit("ref").alias("approval_reference"))
    return readers.assignment_problems(rows.union(more), ["approval_reference"]).where("c_custkey is not null").select("c_custkey", "problem")


@query("select c_custkey, c_name from customer where trim(c_name) = 'Customer#000000005'")
def exact_name(spark, d):
    from tessella.plans.search import find_people

    return find_people(table(spark, d, "customer"), " Customer#000000005 ", "c_name").select("c_custkey", "c_name")


@query("""with recursive b as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber) as i, l_quantity as x, l_tax * 100 as y from lineitem), n as (select k, count(*) as n from b group by 1),
o as (select a.k, a.i, c.i as j, greatest(20 - abs(a.x - c.x - a.k % 5), 0) * greatest(10 - abs(a.y - c.y), 0) as common from b a join b c on a.k = c.k), e as (select k, i, j from o where common / (400 - common) >= 0.85),
m as (select k, 0 as i, 0 as used from n union select m.k, m.i + 1, m.used | (1 << e.j) from m join e on m.k = e.k and e.i = m.i + 1 and m.used & (1 << e.j) = 0)
select n.k as l_orderkey, n.n as boxes, max(m.i) = n.n as matched from n join m on n.k = m.k group by n.k, n.n""")
def perfect_matches(spark, d):
    """Every frame's boxes against the same boxes moved: is there a one-to-one match in which all pairs reach the bound."""
    moved = F.col("x1") + F.col("l_orderkey") % 5
    flat = lambda x1, x2: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.array(x1, "y1", x2, "y2").alias("b")))), lambda r: r["b"]))
    frames = boxes(spark, d).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("boxes"), flat("x1", "x2").alias("a"), flat(moved, moved + 20).alias("b"))
    return frames.select("l_orderkey", "boxes", dedup.least_iou(F.col("b"), F.col("a"), 0.85).isNotNull().alias("matched"))


@query("""with b as (select l_orderkey, l_linenumber, l_quantity as x, l_tax * 100 as y from lineitem), o as (select *, greatest(20 - abs(x - 25), 0) * greatest(10 - abs(y - 2), 0) as common, sqrt(pow(x - 25, 2) + pow(y - 2, 2)) as away from b),
s as (select *, common / (400 - common) as iou from o), r as (select *, row_number() over (partition by l_orderkey order by round(iou - away / 200, 9) desc, l_linenumber) as r from s where iou >= 0.05 or away <= 20)
select l_orderkey, l_linenumber as nearest from (select distinct l_orderkey from b) left join (select * from r where r = 1) using (l_orderkey)""")
def nearest_tracks(spark, d):
    """The track nearest to a box at (25, 2) in every frame: of equal scores the first, null where none is near enough."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", F.array("x1", "y1", "x2", "y2").alias("b"))))
    frames = boxes(spark, d).groupBy("l_orderkey").agg(rows.alias("l"))
    at = matching.nearest_of(F.array(*(F.lit(x) for x in (25.0, 2.0, 45.0, 12.0))), F.flatten(F.transform("l", lambda e: e["b"])))
    return frames.select("l_orderkey", F.get(F.col("l"), at)["l_linenumber"].alias("nearest"))


@query("select event_id, event_type from events where event_id % 2 = 0")
def good_rows(spark, d):
    good, bad = filters.split_valid(table(spark, d, "events"), F.when(F.col("event_id") % 6 != 1, F.col("event_id") % 2 == 0))
    return good.join(bad.select("event_id"), "event_id", "left_anti").select("event_id", "event_type")


@query("select event_id, value from events where event_id % 2 = 0 union all select event_id, value + 1 from events where event_id % 2 = 1")
def batch_apply(spark, d):
    """An ordered log of changes on stored rows comes to the last change of each row whose version fits."""
    e = table(spark, d, "events")
    stored = e.select("event_id", F.lit(1).alias("version"), "value")
    fits = e.where("event_id % 2 = 1").select("event_id", F.lit(1).alias("expected"), (F.col("value") + 1).alias("value"), F.lit(1).alias("at"))
    stale = e.select("event_id", F.lit(0).alias("expected"), F.lit(-1.0).alias("value"), F.lit(2).alias("at"))
    return writers.applied(stored, fits.union(stale), "event_id", "version", "expected", "at").select("event_id", "value")


@query("with o as (select *, case when o_orderkey % 4 = 0 then o_orderkey % 7 end as n from orders) select o_orderkey, coalesce(n, max(n) over (partition by o_custkey), 0) as seat, n is null as added from o where n is not null or false union all select o_orderkey, coalesce(m, 0) + r, true from (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as r from o where n is null) left join (select o_custkey, max(n) as m from o group by 1) using (o_custkey)")
def migration_run(spark, d):
    rows = table(spark, d, "orders").withColumn("n", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") % 7))
    out = windows.append_ordinals(rows, "o_custkey", ["o_orderkey"], "n", F.lit(True))
    return out.select("o_orderkey", F.col("assigned").alias("seat"), F.col("n").isNull().alias("added"))


@query("select user_id, event_type as state, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events where event_type <> 'signup') where r = 1")
def repaired_current(spark, d):
    """The current row of each key, derived again from its applied history."""
    history = events(spark, d).withColumn("applied", F.col("event_type") != "signup")
    return paging.latest(history.where("applied"), ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("state"), "event_id")


@query("select event_id from events where event_type = 'view' and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' and user_id % 5 = 1")
def identity_events(spark, d):
    return paging.between(events(spark, d).where("event_type = 'view'"), "ts", "2024-01-05", "2024-01-20").where("user_id % 5 = 1").select("event_id")


@query("select event_id from events where value > 20 and event_id not in (select event_id from events where event_id % 10 = 3) and event_id % 40 not in (1, 2) union select event_id from events where event_id % 40 = 2 and value > 20 and event_id % 10 <> 3")
def replaced_rows(spark, d):
    """Clean rows without those excluded by hand; one set goes, another of the same split comes."""
    e = table(spark, d, "events").where("value > 20")
    kept = writers.without_deleted(e, e.where("event_id % 10 = 3"), "event_id")
    return writers.replaced(kept, kept.where("event_id % 40 = 1").select("event_id"), e.where("event_id % 40 = 2 and event_id % 10 <> 3"), "event_id").select("event_id")


@query("select c_mktsegment, string_agg(c_custkey, ',' order by c_custkey) as sessions from (select c_mktsegment, c_custkey from customer where c_custkey % 9 = 0 or (c_custkey % 2 = 0 and c_acctbal < 0)) group by 1")
def incomplete_sessions(spark, d):
    """The whole list of each segment. Blocks of 10,000 keys are sorted and joined first, so what meets in a segment's task are its blocks' texts."""
    c = table(spark, d, "customer").withColumns({"role": F.when(F.col("c_custkey") % 9 == 0, " ").when(F.col("c_custkey") % 2 == 0, "dataset").otherwise("excluded"), "scope": F.when(F.col("c_acctbal") >= 0, "all")})
    bad = filters.incomplete(F.col("role"), [F.col("scope")])
    block = F.floor(F.col("c_custkey") / 10000).alias("block")
    blocks = c.where(bad).groupBy("c_mktsegment", block).agg(F.array_join(F.array_sort(F.collect_list("c_custkey")).cast("array<string>"), ",").alias("keys"))
    return blocks.groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_list(F.struct("block", "keys")))["keys"], ",").alias("sessions"))


@query("select p_partkey, case when p_size is null then 'MISSING' when p_size % 10 = 3 then 'WRONG_SIZE' when p_partkey % 13 = 0 then 'UNEXPECTED' end as problem from part where p_size % 10 = 3 or p_partkey % 13 = 0")
def resolution_report(spark, d):
    p = table(spark, d, "part")
    inventory = p.where("p_partkey % 13 <> 0 or p_size % 10 = 3").select(F.col("p_partkey").alias("source_id"))
    report = p.select(F.col("p_partkey").alias("source_id"), F.when(F.col("p_size") % 10 == 3, 640).otherwise(1920).alias("width"), F.lit(1080).alias("height"))
    return setops.resolution_problems(inventory, report, 1920, 1080).select(F.col("source_id").alias("p_partkey"), "problem")


@query("select doc_id, case when l.quality is not null then 'human' else 'candidate' end as approval, coalesce(l.quality, 7) as label from documents left join labels l using (doc_id)")
def publication_sources(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit(7).alias("candidate"))
    return joins.reviewed_or_candidate(docs, table(spark, d, "labels").select("doc_id", F.col("quality").alias("reviewed")), "doc_id").select("doc_id", "approval", "label")


@query("select c_nationkey, max(threshold) as threshold from (select c_nationkey, case when c_nationkey % 3 = 0 then round(c_acctbal) else c_nationkey end as threshold from customer where c_mktsegment = 'BUILDING') group by 1 having count(distinct threshold) = 1")
def loaded_calibrations(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", F.col("c_mktsegment").alias("model"), F.when(F.col("c_nationkey") % 3 == 0, F.round("c_acctbal")).otherwise(F.col("c_nationkey")).alias("threshold"))
    return aggregates.calibrations(rows, "c_nationkey", "threshold", F.col("model") == "BUILDING").where("not conflict").select("c_nationkey", "threshold")


@query("select lang, round(far, 6) as far, n_unknown, far <= 0.3 and n_unknown >= 20 as passed from (select lang, count(*) filter (toxic = 0 and n_chars > 4000) / nullif(count(*) filter (toxic = 0), 0) as far, count(*) filter (toxic = 0) as n_unknown from documents join labels using (doc_id) where lang is not null group by 1)")
def comparison_gate(spark, d):
    rows = table(spark, d, "documents").where("lang is not null").join(table(spark, d, "labels"), "doc_id")
    sums = rows.groupBy("lang").agg(F.count_if((F.col("toxic") == 0) & (F.col("n_chars") > 4000)).alias("accepted"), F.count_if(F.col("toxic") == 0).alias("n_unknown"))
    far = aggregates.nullable_ratio(F.col("accepted"), F.col("n_unknown"))
    return sums.select("lang", F.round(far, 6).alias("far"), "n_unknown", aggregates.comparison_passes(far, F.col("n_unknown"), 0.3, 20).alias("passed"))


@query("select doc_id, coalesce(l.toxic, c.toxic) as label, l.toxic is not null as audited from (select doc_id, toxic from labels) c left join (select doc_id, 1 - toxic as toxic from labels where doc_id % 10 = 0) l using (doc_id)")
def audit_merge(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label"))
    audited = labels.where("doc_id % 10 = 0").withColumn("label", 1 - F.col("label"))
    return writers.merged_back(labels, audited, "doc_id").select("doc_id", "label", "audited")


@query("select group_id, case when n < 2 then 'ALONE' when kept <> 1 then 'NOT_ONE_KEPT' end as problem from (select doc_id % 50 as group_id, count(*) as n, count(*) filter (doc_id % 3 = 0) as kept from documents group by 1) where n < 2 or kept <> 1")
def group_problems(spark, d):
    rows = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("group_id"), F.col("doc_id").alias("id"), (F.col("doc_id") % 3 == 0).alias("kept"))
    return setops.group_problems(rows).select("group_id", "problem")


@query("select doc_id, n_chars from documents where doc_id % 4 = 0 or (n_chars < 500 and doc_id % 4 <> 0)")
def review_batch(spark, d):
    docs = table(spark, d, "documents")
    return sampling.required_and_sampled(docs, F.col("n_chars") < 500, docs.where("doc_id % 4 = 0"), "doc_id").select("doc_id", "n_chars")


@query("select c_custkey, case when c_custkey % 6 = 0 then 'BAD_ROLE' when c_custkey % 10 = 1 then 'TAKEN' when c_nationkey in (3, 4) then 'UNKNOWN_ROOM' end as problem from customer")
def registration_checks(spark, d):
    c = table(spark, d, "customer")
    asked = c.select("c_custkey", F.col("c_custkey").alias("camera_id"), F.col("c_nationkey").alias("room"), F.when(F.col("c_custkey") % 6 == 0, "roof").otherwise("entry").alias("role"))
    taken = c.where("c_custkey % 10 = 1").select(F.col("c_custkey").alias("camera_id"))
    rooms = table(spark, d, "nation").where("n_nationkey not in (3, 4)").select(F.col("n_nationkey").alias("room"))
    return joins.registration_problems(asked, taken, rooms, ["entry", "room"]).select("c_custkey", "problem")


@query("select s_suppkey, n_name, s_nationkey % 4 = 0 as needs_review from supplier join nation on s_nationkey = n_nationkey where n_regionkey < 4")
def zone_list(spark, d):
    seats = table(spark, d, "nation").where("n_regionkey < 4").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    rows = table(spark, d, "supplier").join(seats, "s_nationkey")
    return rows.orderBy("s_nationkey", "s_suppkey").select("s_suppkey", "n_name", (F.col("s_nationkey") % 4 == 0).alias("needs_review"))


@query("select label, count(*) as n from (select label, vec_id, row_number() over (partition by label order by vec_id) - 1 as i, count(*) over (partition by label) as n from embeddings) where n <= 7 or i in (0, round_even((n - 1) / 6, 0), round_even(2 * (n - 1) / 6, 0), round_even(3 * (n - 1) / 6, 0), round_even(4 * (n - 1) / 6, 0), round_even(5 * (n - 1) / 6, 0), n - 1) group by 1")
def representative_vectors(spark, d):
    """Evenly spaced vectors of each person, unusable ones out, then the robust centroid of what is left."""
    picked = sampling.even_pick(table(spark, d, "embeddings"), ["label"], ["vec_id"], 7)
    return aggregates.robust_centroid(picked, "label", "embedding", 64, floor=-1.0, slack=2.0).select("label", "n")


@query("""with d as (select cast(ts as date) as day, min(ts) as since from events group by 1), p as (select day, h, day + to_hours(h) as ends from d, (select unnest([9, 12, 15, 18]) as h)),
l as (select distinct cast(ts as date) as day, (extract(hour from ts) // 3 + 1) * 3 as h from events where event_type = 'purchase')
select strftime(p.day, '%Y-%m-%d') as day, 'until ' || h as name, case when ends >= timestamp '2024-01-20 11:00:00' then 'due' when since <= ends then 'missed' end as status from p join d using (day) anti join l on p.day = l.day and p.h = l.h where ends <= timestamp '2024-01-20 12:00:00' and (ends >= timestamp '2024-01-20 11:00:00' or since <= ends)""")
def missed_periods(spark, d):
    """Four periods a day; a purchase in a period's last three hours is its report."""
    e = events(spark, d).withColumn("day", F.to_date("ts"))
    name = lambda h: F.concat(F.lit("until "), h.cast("string"))
    watched = e.groupBy("day").agg(F.min("ts").alias("since"))
    hours = watched.select("day", F.explode(F.array(*(F.lit(h) for h in (9, 12, 15, 18)))).alias("h"))
    periods = hours.select("day", name(F.col("h")).alias("name"), (F.col("day").cast("timestamp") + F.make_dt_interval(hours=F.col("h"))).alias("ends"))
    ledger = e.where("event_type = 'purchase'").select("day", name(((F.floor(F.hour("ts") / 3) + 1) * 3)).alias("name")).distinct()
    return setops.unreported_periods(periods, ledger, watched, F.lit("2024-01-20 12:00:00").cast("timestamp")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "name", "status")

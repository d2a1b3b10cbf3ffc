"""Aggregations, reports, evaluation metrics and metric-language queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import vectors as v
from tessella.operators import aggregates as a
from tessella.operators import metrics as m
from tessella.operators import paging, selection
from tessella.plans.registry import events, query, table, text
from tessella.sources.writers import report_page

_RATE = "coalesce(round_even(100.0 * count(*) filter (event_type = 'purchase') / nullif(count(*), 0), 2), 0)"


def leaves():
    return F.col("event_type") == "purchase"


@query("select count(*) filter (event_type = 'click') as clicks, count(*) filter (event_type = 'view') as views, count(*) filter (event_type not in ('click', 'view')) as others, count(*) as total, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as observed_at from events")
def occupancy_summary(spark, d):
    k = F.col("event_type")
    return table(spark, d, "events").agg(F.count_if(k == "click").alias("clicks"), F.count_if(k == "view").alias("views"), F.count_if(~k.isin("click", "view")).alias("others"), F.count(F.lit(1)).alias("total"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("observed_at"))


@query("select s.position, s.event_type, coalesce(n, 0) as n from (values (0, 'click'), (1, 'view'), (2, 'purchase'), (3, 'never')) s(position, event_type) left join (select event_type, count(*) as n from events group by 1) using (event_type)")
def state_counts(spark, d):
    return a.state_counts(table(spark, d, "events"), "event_type", ["click", "view", "purchase", "never"])


@query(f"select user_id, count(*) as total, count(*) filter (event_type = 'purchase') as leaves, count(distinct cast(ts as date)) as days, arg_min(event_id, ts) as first_event, {_RATE} as rate from events group by user_id")
def student_report(spark, d):
    return a.rollup_by(table(spark, d, "events"), ["user_id"], leaves(), days=F.count_distinct(F.to_date("ts")), first_event=F.min_by("event_id", "ts"))


@query(f"select cast(extract(hour from ts) as integer) as period, count(*) as total, count(*) filter (event_type = 'purchase') as leaves, {_RATE} as rate from events group by 1")
def period_report(spark, d):
    return a.rollup_by(table(spark, d, "events").withColumn("period", F.hour("ts")), ["period"], leaves())


@query(f"select strftime(ts, '%Y-%m-%d') as day, count(*) as total, count(*) filter (event_type = 'purchase') as leaves, {_RATE} as rate from events group by 1")
def daily_report(spark, d):
    return a.rollup_by(table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["day"], leaves())


@query(f"select count(*) as total, count(*) filter (event_type = 'purchase') as leaves, count(distinct user_id) as users, count(distinct cast(ts as date)) as days, {_RATE} as rate from events")
def weekly_summary(spark, d):
    return a.rollup_by(table(spark, d, "events"), [], leaves(), users=F.count_distinct("user_id"), days=F.count_distinct(F.to_date("ts")))


@query("select strftime(c.day, '%Y-%m-%d') as day, n, n is not null as recorded from (select cast(unnest(generate_series(date '2023-12-28', date '2024-02-03', interval 1 day)) as date) as day) c left join (select cast(ts as date) as day, count(*) as n from events where event_type = 'purchase' group by 1) e using (day)")
def calendar_fill(spark, d):
    rows = table(spark, d, "events").where("event_type = 'purchase'").withColumn("day", F.to_date("ts"))
    return a.calendar(rows, "day", "2023-12-28", "2024-02-03").select(F.col("day").cast("string").alias("day"), "n", "recorded")


@query("select event_type, cast(extract(hour from ts) as integer) as h, count(*) as n, grouping(event_type) as g1, grouping(cast(extract(hour from ts) as integer)) as g2 from events group by grouping sets ((event_type), (cast(extract(hour from ts) as integer)), (event_type, cast(extract(hour from ts) as integer)), ())")
def report_grouping_sets(spark, d):
    rows = table(spark, d, "events").withColumn("h", F.hour("ts"))
    out = rows.groupingSets([["event_type"], ["h"], ["event_type", "h"], []], "event_type", "h").agg(F.count(F.lit(1)).alias("n"), F.grouping("event_type").cast("long").alias("g1"), F.grouping("h").cast("long").alias("g2"))
    return out


@query("select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by cube (o_orderstatus, o_orderpriority)")
def report_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select user_id, rank() over (order by n desc) as r, dense_rank() over (order by n desc) as dr, ntile(4) over (order by n desc, user_id) as q from (select user_id, count(*) as n from events group by 1)")
def ranked_users(spark, d):
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return paging.ranks(counts, "n", "user_id", 4).select("user_id", "r", "dr", "q")


@query("with s as (select l.quality = 1 as truth, n_chars >= 1000 as found from documents join labels l using (doc_id)), c as (select count(*) filter (truth and found) as tp, count(*) filter (not truth and found) as fp, count(*) filter (truth and not found) as fn from s) select tp, fp, fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) as f1 from c")
def precision_recall(spark, d):
    rows = _scored(spark, d)
    t, f = F.col("truth"), F.col("score") >= 1000
    counted = rows.select((t & f).cast("long").alias("tp"), (~t & f).cast("long").alias("fp"), (t & ~f).cast("long").alias("fn"))
    return a.precision_recall(counted, []).select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _scored(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select((F.col("quality") == 1).alias("truth"), F.col("n_chars").alias("score"))


_SWEEP = "with s as (select l.quality = 1 as truth, n_chars as score from documents join labels l using (doc_id)), c as (select t as threshold, count(*) filter (truth and score >= t) as tp, count(*) filter (not truth and score >= t) as fp, count(*) filter (truth and score < t) as fn from s, (select unnest([100.0, 500.0, 1000.0, 2000.0, 5000.0]) as t) group by 1), p as (select cast(threshold as double) as threshold, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall from c), f as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from p) "
_POINTS = [100.0, 500.0, 1000.0, 2000.0, 5000.0]


@query(_SWEEP + "select threshold, tp, fp, fn, round(f1, 6) as f1 from f")
def threshold_sweep(spark, d):
    return a.threshold_sweep(_scored(spark, d), "score", F.col("truth"), _POINTS).select("threshold", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


@query(_SWEEP + "select threshold, round(f1, 6) as f1 from f order by f1 desc, threshold limit 1")
def threshold_best(spark, d):
    return a.best_threshold(a.threshold_sweep(_scored(spark, d), "score", F.col("truth"), _POINTS)).select("threshold", F.round("f1", 6).alias("f1"))


@query(_SWEEP + "select min(threshold) filter (precision >= 0.8 and recall >= 0.3) as threshold from f")
def calibrate_first(spark, d):
    return a.first_calibrated(a.threshold_sweep(_scored(spark, d), "score", F.col("truth"), _POINTS), 0.8, 0.3)


@query("with v as (select value from events where event_type = 'view'), n as (select count(*) as n, cast(floor(0.01 * count(*)) as bigint) as allowed from v), x as (select max(s) as s, min(above) as accepted from (select value as s, (select count(*) from v b where b.value >= a.value) as upto, (select count(*) from v b where b.value > a.value) as above from (select distinct value from v) a), n where upto > allowed) select n, allowed, accepted, (select count(*) from v, x where value > x.s) as taken from n, x")
def far_threshold_counts(spark, d):
    rows = table(spark, d, "events").where("event_type = 'view'")
    out = a.far_threshold(rows, "value", 0.01, float("inf"))
    taken = rows.join(F.broadcast(out.select("threshold")), F.col("value") >= F.col("threshold")).agg(F.count(F.lit(1)).alias("taken"))
    return out.select("n", "allowed", "accepted").join(taken, F.lit(True))


@query("with v as (select round(value) as s, count(*) as c from events where event_type = 'view' group by 1), n as (select sum(c) as n, cast(floor(0.05 * sum(c)) as bigint) as allowed from v), r as (select s, sum(c) over (order by s desc) as run, c from v), x as (select max(s) as s, min(run - c) as accepted from r, n where run > allowed) select cast(n as bigint) as n, allowed, cast(accepted as bigint) as accepted, round(s, 6) as threshold from x, n")
def far_threshold(spark, d):
    rows = table(spark, d, "events").where("event_type = 'view'").select(F.round("value").alias("value"))
    return a.far_threshold(rows, "value", 0.05, float("inf")).select("n", "allowed", "accepted", F.round("threshold", 6).alias("threshold"))


@query("with r as (select value, user_id % 2 = 0 as known, event_type <> 'purchase' as seen, value >= 40 as acc, event_id % 5 <> 0 as ok from events) select count(*) filter (known and seen) as known, count(*) filter (not known and seen) as unknown, count(*) filter (not seen) as not_detected, round(count(*) filter (known and seen and acc and ok) / count(*) filter (known and seen), 6) as success_rate, round(count(*) filter (known and seen and not acc) / count(*) filter (known and seen), 6) as false_reject_rate, round(count(*) filter (not known and seen and acc) / count(*) filter (not known and seen), 6) as far, round(count(*) filter (not known and seen and not acc) / count(*) filter (not known and seen), 6) as correct_reject_rate, round(avg(value) filter (seen), 6) as mean_ms, round(quantile_cont(value, 0.95) filter (seen), 6) as p95_ms from r")
def binary_rates(spark, d):
    e = table(spark, d, "events")
    out = a.identification_rates(e, F.col("user_id") % 2 == 0, F.col("event_type") != "purchase", F.col("value") >= 40, F.col("event_id") % 5 != 0, "value")
    return out.select("known", "unknown", "not_detected", *[F.round(c, 6).alias(c) for c in out.columns[3:]])


@query("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(avg(value), 6) as mean from events group by 1")
def latency_percentiles(spark, d):
    e = table(spark, d, "events")
    found = selection.percentiles(e, "event_type", "value", {"p50": 0.5, "p95": 0.95}).withColumnRenamed("event_type", "kind")
    means = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return means.join(found, F.col("event_type").eqNullSafe(F.col("kind"))).select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "mean")


@query("select round(avg(abs(l_quantity - l_linenumber * 5)), 6) as count_mae, round(sum(greatest(l_quantity - l_linenumber * 5, 0)) / (count(*) * 2 / 3600), 6) as fp_per_hour, round(avg(l_extendedprice), 4) as mean_ms, round(quantile_cont(l_extendedprice, 0.95), 4) as p95_ms from lineitem")
def count_errors(spark, d):
    rows = table(spark, d, "lineitem").withColumn("expected", F.col("l_linenumber") * 5)
    out = a.count_errors(rows, "expected", "l_quantity", "l_extendedprice", F.lit(2.0))
    return out.select(F.round("count_mae", 6).alias("count_mae"), F.round("fp_per_hour", 6).alias("fp_per_hour"), F.round("mean_ms", 4).alias("mean_ms"), F.round("p95_ms", 4).alias("p95_ms"))


_UNIT = "select vec_id, label, list_transform(embedding, lambda x: cast(x as double) / sqrt(list_sum(list_transform(embedding, lambda y: cast(y as double) * cast(y as double))))) as u from embeddings"
_CENTRE = f"with u as ({_UNIT}), s as (select label, i, sum(u[i]) as x from u, (select unnest(range(1, 65)) as i) group by 1, 2), n as (select label, sqrt(sum(x * x)) as n from s group by 1), c as (select label, list(x / n order by i) as c from s join n using (label) group by 1) "


@query(_CENTRE + ", k as (select u.label, u.vec_id, u.u, list_dot_product(u.u, c.c) as s from u join c using (label)), t as (select label, greatest(0.15, quantile_cont(s, 0.5) - 0.15) as cut from k group by 1) select label, count(*) as n, count(*) filter (s >= cut) as kept from k join t using (label) group by 1")
def robust_centroid(spark, d):
    return a.robust_centroid(table(spark, d, "embeddings"), "label", "embedding", 64).select("label", "n", "kept")


@query(_CENTRE + ", k as (select vec_id, c.label, list_dot_product(u.u, c.c) as s from u, c), r as (select *, row_number() over (partition by vec_id order by s desc, label) as r from k) select x.vec_id, x.label, round(x.s, 5) as similarity, round(x.s - y.s, 5) as margin from r x join r y on x.vec_id = y.vec_id and x.r = 1 and y.r = 2")
def gallery_top2_margin(spark, d):
    from tessella.operators.joins import gallery_top2

    e = table(spark, d, "embeddings").withColumnRenamed("embedding", "vector")
    unit = e.select("label", v.normalised(F.col("vector")).alias("u"))
    gallery = a._mean_vector(unit, ["label"], "u", 64).select("label", F.col("centroid").alias("vector"))
    return gallery_top2(e.select("vec_id", "vector"), gallery, "vec_id", "label").select("vec_id", "label", F.round("similarity", 5).alias("similarity"), F.round("margin", 5).alias("margin"))


@query(f"with u as ({_UNIT}), p as (select x.label = y.label as same, list_dot_product(x.u, y.u) as s from u x join u y on x.vec_id < y.vec_id) select same, count(*) as n, round(avg(s), 5) as mean, round(max(s), 5) as max from p group by 1")
def pair_similarity_split(spark, d):
    return a.pair_similarities(table(spark, d, "embeddings"), "vec_id", "label", "embedding").select("same", "n", F.round("mean", 5).alias("mean"), F.round("max", 5).alias("max"))


@query("select event_id, round(0.35 * least(greatest(value / 100, 0), 1) + 0.35 * least(greatest(value / 50, 0), 1) + 0.15 * 0.5 + 0.15 * 1, 6) as score from events")
def quality_score(spark, d):
    x = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(a.quality_score(x / 100, x / 50, F.lit(0.5), F.lit(2.0)), 6).alias("score"))


_GRID = "select cast(greatest(least(floor(value / 100 * 8), 7), 0) as integer) as bin_x, cast(greatest(least(floor(user_id / 150 * 6), 5), 0) as integer) as bin_y, count(*) as n from events group by 1, 2"


def _points(spark, d):
    return table(spark, d, "events").select((F.col("value") / 100).alias("x"), (F.col("user_id") / 150).alias("y"))


@query(_GRID)
def density_grid(spark, d):
    return a.density_grid(_points(spark, d), columns=8, rows=6)


@query(f"with g as ({_GRID}), c as (select x, y, coalesce(n, 0) as n from (select unnest(range(0, 8)) as x) cross join (select unnest(range(0, 6)) as y) left join g on bin_x = x and bin_y = y) select cast(a.x as integer) as bin_x, cast(a.y as integer) as bin_y, round(avg(b.n), 6) as n from c a join c b on abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 group by 1, 2 having sum(b.n) > 0")
def density_smooth(spark, d):
    g = a.smoothed(a.density_grid(_points(spark, d), columns=8, rows=6), columns=8, rows=6)
    return g.select("bin_x", "bin_y", F.round("n", 6).alias("n"))


@query("select 'o_orderstatus' as field, count(distinct o_orderstatus) as n_values, count(distinct o_orderstatus) = 1 as shared from orders union all select 'o_orderpriority', count(distinct o_orderpriority), count(distinct o_orderpriority) = 1 from orders")
def same_conditions(spark, d):
    return a.same_conditions(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


_BUCKETS = "select event_type, le, count(*) filter (value <= le) as n from events, (select unnest([10.0, 50.0, 100.0, 200.0, 'infinity'::double]) as le) group by 1, 2"


@query(f"select event_type, cast(case when isinf(le) then 999999 else le end as double) as le, n from ({_BUCKETS})")
def histogram_buckets(spark, d):
    b = a.cumulative_buckets(table(spark, d, "events"), ["event_type"], "value", [10.0, 50.0, 100.0, 200.0])
    return b.select("event_type", F.when(F.col("le") == float("inf"), 999999.0).otherwise(F.col("le")).alias("le"), "n")


@query(f"with b as ({_BUCKETS}), w as (select *, coalesce(lag(n) over o, 0) as before, coalesce(lag(le) over o, 0) as low, 0.9 * max(n) over (partition by event_type) as rank from b window o as (partition by event_type order by le)), h as (select *, row_number() over (partition by event_type order by le) as r from w where n >= rank and rank > 0) select event_type, round(case when isinf(le) then low else low + (le - low) * (rank - before) / (n - before) end, 6) as quantile from h where r = 1")
def hist_quantile(spark, d):
    b = a.cumulative_buckets(table(spark, d, "events"), ["event_type"], "value", [10.0, 50.0, 100.0, 200.0])
    return m.bucket_quantile(b, ["event_type"], 0.9).select("event_type", F.round("quantile", 6).alias("quantile"))


@query("with u as (select user_id, ts, greatest(value - lag(value) over (partition by user_id order by ts), 0) as up, lag(value) over (partition by user_id order by ts) as b, value from events) select user_id, strftime(time_bucket(interval 1 day, ts), '%Y-%m-%d %H:%M:%S') as window_start, round(sum(case when b is null then 0 when value < b then value else value - b end) / 86400, 8) as rate from u group by 1, 2")
def windowed_rate(spark, d):
    out = m.rate(events(spark, d), ["user_id"], "ts", "value", "1 day")
    return out.select("user_id", text("window_start").alias("window_start"), F.round("rate", 8).alias("rate"))


@query("select event_type, strftime(time_bucket(interval 6 hour, ts), '%Y-%m-%d %H:%M:%S') as window_start, count(*) as n, round(count(*) / 21600, 8) as per_second from events group by 1, 2")
def event_rate(spark, d):
    out = m.event_rate(events(spark, d), ["event_type"], "ts", "6 hours")
    return out.select("event_type", text("window_start").alias("window_start"), "n", F.round("per_second", 8).alias("per_second"))


@query("select strftime(time_bucket(interval 1 day, ts), '%Y-%m-%d %H:%M:%S') as window_start, count(*) filter (event_type = 'purchase') as part, count(*) as total, round(count(*) filter (event_type = 'purchase') / count(*), 6) as share from events group by 1")
def ratio_of_rates(spark, d):
    out = m.ratio_of_rates(events(spark, d), [], "ts", "1 day", leaves())
    return out.select(text("window_start").alias("window_start"), "part", "total", F.round("share", 6).alias("share"))


@query("select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as window_start, count(distinct user_id) as n from events group by 1")
def active_labels(spark, d):
    return m.active_labels(events(spark, d), "user_id", "ts", "1 hour").select(text("window_start").alias("window_start"), "n")


@query("select event_type, strftime(time_bucket(interval 1 day, ts), '%Y-%m-%d %H:%M:%S') as window_start, count(*) as n from events where regexp_matches(props, '\"k\": ?7') group by 1, 2")
def log_match_rate(spark, d):
    out = m.matching_lines(events(spark, d), "event_type", "props", '"k": ?7', "ts", "1 day")
    return out.select("event_type", text("window_start").alias("window_start"), "n")


@query("""select '<!doctype html><meta charset=''utf-8''><title>Daily report</title><script type=''application/json'' id=''rows''>[' || string_agg('{"day":"' || day || '","total":' || total || ',"leaves":' || leaves || '}', ',' order by day) || ']</script>' as html
  from (select strftime(ts, '%Y-%m-%d') as day, count(*) as total, count(*) filter (event_type = 'purchase') as leaves from events group by 1)""")
def report_html(spark, d):
    return report_page(daily_report(spark, d), "Daily report", ["day", "total", "leaves"])


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= '1998-09-02' group by 1, 2")
def pricing_summary(spark, d):
    x = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))

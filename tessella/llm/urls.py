"""URL filters: fixed rules first, then verdicts by link-graph propagation.

Hosts with allowed pages are trusted seeds, hosts with blocked pages distrusted ones, each by the share
of its pages that a rule decided so.  Trust spreads along host edges by personalised PageRank, distrust
against them; a host whose distrust outweighs its trust by the threshold is blocked where no rule speaks.
Ranks keep the seeds' sum: what hosts without links out hold returns to the seeds, as a random surfer
starts anew there.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import cut_lineage, hot_keys, join_per_key

#: Action, host, path prefix.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DAMPING, ROUNDS, THRESHOLD = 0.85, 10, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, action): the longest rule that fits, nulls where none does. Null urls and urls without ``://`` have empty hosts and paths."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule = action = F.lit(None).cast("string")
    for act, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, action = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rows.withColumns({"rule": rule, "action": action})


#: Absolute and protocol-relative links in href and src attributes.
LINKS = r"""(?is)(?:href|src)[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'>\x20\x09-\x0D]+)"""


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight): absolute links between different hosts in href and src attributes, counted; relative links stay on their host."""
    links = F.regexp_extract_all(F.col(html_col), F.lit(LINKS), F.lit(1))
    rows = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(links).alias("link"))
    link = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))
    rows = rows.select("src", host_of(link).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return rows.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, score, unit) after ``rounds`` of personalised PageRank over (src, dst, weight), begun at the seeds.

    ``seeds``: (host, seed) of every host, every host once.  In each round a host keeps
    (1 - damping) of its seed and gets damping times the weighted scores of what leads to it; the scores
    of dead ends go back to all hosts by their seeds.  The scores' sum is the seeds' sum.  unit is what a
    seed of one got for itself in the last round, so score / unit is a host's own seed plus what links
    brought it, however much of the graph is linked.  Both joins leave hubs where they lie and sums are
    partial, so neither a hub's links out nor its links in are gathered in one task.
    """
    out = cut_lineage(edges.groupBy("src").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n")))
    hubs = hot_keys(out, "src")
    shares = cut_lineage(join_per_key(edges, out.select("src", "total"), hubs, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    live = out.select(F.col("src").alias("host"), F.lit(True).alias("live"))
    seeds = cut_lineage(seeds.select("host", "seed").join(live, "host", "left").select("host", "seed", F.coalesce("live", F.lit(False)).alias("live")))
    total = seeds.agg(F.sum("seed")).first()[0] or 0.0
    now = seeds.withColumn("score", F.col("seed"))
    if not total or shares.isEmpty():
        return now.select("host", "score", F.lit(1.0).alias("unit"))
    for _ in range(rounds):
        dead = now.where("not live").agg(F.sum("score")).first()[0] or 0.0
        given = join_per_key(shares, now.select(F.col("host").alias("src"), "score"), hubs, "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("share") * F.col("score")).alias("given"))
        unit = 1 - damping + damping * dead / total
        fresh = unit * F.col("seed") + damping * F.coalesce("given", F.lit(0.0))
        now = cut_lineage(seeds.join(given, "host", "left").select("host", "seed", "live", fresh.alias("score")))
    return now.select("host", "score", F.lit(unit).alias("unit"))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust): one row for each row of ``pages``.

    The verdict is the rule's, else block where the host's distrust exceeds its trust by ``threshold`` or
    more (to nine decimals), else allow.  Both are in units of the seeds: a host that nothing leads to has
    the share of its pages that a rule blocked, or allowed.  Null urls count as a host with an empty name; null html has no
    links; null and repeated page_ids stay rows of their own; other columns are not read.  Pages of a
    frequent host get its scores where they lie.
    """
    rows = cut_lineage(ruled(pages, rules, id_col, url_col))
    edges = cut_lineage(host_edges(pages, url_col, html_col))
    share = {name: F.avg(F.when(F.col("action") == act, 1.0).otherwise(0.0)).alias(name) for name, act in (("allowed", "allow"), ("blocked", "block"))}
    own = cut_lineage(rows.groupBy("host").agg(share["allowed"], share["blocked"], F.count(F.lit(1)).alias("n")))
    linked = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    hosts = cut_lineage(own.drop("n").join(linked, "host", "full").na.fill(0.0, ["allowed", "blocked"]))
    in_units = F.col("score") / F.col("unit")
    trust = propagate(hosts.select("host", F.col("allowed").alias("seed")), edges).select("host", in_units.alias("trust"))
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(hosts.select("host", F.col("blocked").alias("seed")), reverse).select("host", in_units.alias("distrust"))
    scores = cut_lineage(trust.join(distrust, "host"))
    verdict = F.when(F.round(F.col("distrust") - F.col("trust"), 9) >= threshold, "block").otherwise("allow")
    judged = join_per_key(rows, scores, hot_keys(own, "host"), "host")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("action", verdict).alias("verdict"), "trust", "distrust")


def oracle_sql(rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``judge`` over the view ``pages``, without trust and distrust: each round is a step of a chain of views."""
    host = "coalesce(translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), '" + _UPPER + "', '" + _LOWER + "'), '')"
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' or suffix(host, '.{h}')) and starts_with(path, '{p}')" for _, h, p in ordered]
    rule = " ".join(f"when {f} then '{h + p}'" for f, (_, h, p) in zip(fits, ordered, strict=True))
    action = " ".join(f"when {f} then '{a}'" for f, (a, _, _) in zip(fits, ordered, strict=True))
    links = LINKS.replace("'", "''")
    steps = [f"""u as (select page_id, url, html, {host.format("url")} as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
r as (select page_id, host, path, case {rule} end as rule, case {action} end as action from u),
l as (select host as src, unnest(regexp_extract_all(html, '{links}', 1)) as link from u),
m as (select src, {host.format("case when starts_with(link, '//') then 'x:' || link else link end")} as dst from l),
e as (select src, dst, cast(count(*) as double) as weight from m where src <> '' and dst <> '' and src <> dst group by src, dst),
own as (select host, avg(case when action = 'allow' then 1.0 else 0.0 end) as allowed, avg(case when action = 'block' then 1.0 else 0.0 end) as blocked from r group by host),
hosts as (select host, coalesce(allowed, 0) as allowed, coalesce(blocked, 0) as blocked from own full join (select src as host from e union select dst from e) using (host))"""]
    for name, seed, src, dst in (("t", "allowed", "src", "dst"), ("d", "blocked", "dst", "src")):
        steps.append(f"""{name}e as (select {src} as src, {dst} as dst, weight / sum(weight) over (partition by {src}) as share from e),
{name}s as (select host, cast({seed} as double) as seed, host in (select src from {name}e) as live, sum({seed}) over () as total from hosts),
{name}0 as (select *, seed as score, 1.0 as unit from {name}s)""")
        for k in range(rounds):
            steps.append(f"""{name}u{k + 1} as (select host, seed, live, total, case when total = 0 or not exists (select 1 from {name}e) then 1.0 else
 {1 - damping} + {damping} * (select coalesce(sum(score), 0) from {name}{k} where not live) / total end as unit from {name}s),
{name}{k + 1} as (select host, seed, live, total, unit, unit * seed + {damping} * coalesce(given, 0) as score
 from {name}u{k + 1} left join (select dst as host, sum(share * score) as given from {name}e join {name}{k} on src = host group by dst) using (host))""")
    verdict = f"case when round(d{rounds}.score / d{rounds}.unit - t{rounds}.score / t{rounds}.unit, 9) >= {threshold} then 'block' else 'allow' end"
    return "with " + ",\n".join(steps) + f"""
select page_id, r.host, path, rule, coalesce(action, {verdict}) as verdict from r join t{rounds} on r.host = t{rounds}.host join d{rounds} on r.host = d{rounds}.host"""

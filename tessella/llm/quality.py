"""Quality rules with host verdicts: rule failures by host, shrunk with an empirical beta prior.

Every document is held against fixed rules by itself.  The documents that fail one are counted by host,
the hosts' failure rates are shrunk towards the corpus's by a beta prior whose mean and weight come
from the hosts themselves (method of moments), and a host whose shrunk rate passes the limit is
rejected with all its documents.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import cut_lineage, hot_keys, join_per_key, numbered_columns

MIN_WORDS, MAX_REPEAT_PERCENT, HOST_LIMIT = 50, 50, 0.5
#: Bounds of the prior's weight, in documents.
WEIGHT_BOUNDS = (2.0, 1000.0)
_SPACES = r"[\x20\x09-\x0D]+"


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _covered(hashes: Column) -> Column:
    """How many words lie in a window whose hash occurs again, from the text's window hashes in order."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = _again(ordered)
    places = F.sort_array(F.transform(again, lambda p: p["i"]))
    return _once(places, lambda at: F.aggregate(F.transform(at, lambda v, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - v, F.lit(3)))), F.lit(0), lambda a, b: a + b))


def _again(ordered: Column) -> Column:
    """Of sorted (h, i), those whose h a neighbour has, too."""
    return _once(ordered, lambda s: F.filter(s, lambda p, j: F.get(s, j - 1)["h"].eqNullSafe(p["h"]) | F.get(s, j + 1)["h"].eqNullSafe(p["h"])))


def with_metrics(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    Null and empty texts have no words and fail.  Three-word windows are told apart by 64-bit hashes of
    64-bit hashes of their words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("__words", F.array_remove(F.split(text, _SPACES), ""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumns({
        "__n": F.size("__words"), "__chars": F.length(F.array_join("__words", "")), "__symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
        "__dup": _once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), "__hashes": F.transform("__words", lambda w: F.xxhash64(w)),
    }).drop("__words")
    at = F.when(F.col("__n") >= 3, F.sequence(F.lit(0), F.col("__n") - 3)).otherwise(F.array().cast("array<int>"))
    windows = _once(F.col("__hashes"), lambda h: F.transform(at, lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))))
    rows = rows.withColumn("__windows", windows).drop("__hashes")
    repeats = F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), _covered(F.col("__windows"))).otherwise(F.lit(0))
    rows = rows.withColumn("__repeat", repeats).drop("__windows")
    named = {"n_words": "__n", "word_chars": "__chars", "n_symbols": "__symbols", "n_dup_lines": "__dup", "n_repeat_words": "__repeat"}
    rows = rows.withColumns({prefix + k: F.col(v).cast("long") for k, v in named.items()}).drop(*named.values())
    n, repeat = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return rows.withColumn(f"{prefix}base_failed", (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n))


def fails_a_rule(prefix: str = "") -> Column:
    """The rules whose failures are counted by host: the base rules, one symbol in ten characters, mean word length."""
    n, chars, symbols = (F.col(prefix + c) for c in ("n_words", "word_chars", "n_symbols"))
    return F.col(f"{prefix}base_failed") | (10 * symbols > chars) | (chars < 2 * n) | (chars > 20 * n)


def host_rates(rows: DataFrame, host_col: str, failed: Column) -> DataFrame:
    """(host, n, fails, rate): the failure rate of each host, shrunk by the empirical beta prior.

    Counts are partial aggregates, so one host may hold any share of the rows.  Null hosts are one host
    of their own.  The prior's mean is the corpus's failure rate, its weight follows from the variance of
    the hosts' rates beyond what their sizes explain; both come from one row of sums.
    """
    hosts = rows.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(failed.cast("long")).alias("fails"))
    hosts = cut_lineage(hosts)
    total = hosts.agg(F.sum("n").alias("n"), F.sum("fails").alias("fails"), F.count(F.lit(1)).alias("hosts"), F.sum(F.lit(1.0) / F.col("n")).alias("inverse")).first()
    if not total.n:
        return hosts.withColumn("rate", F.lit(0.0))
    mean = total.fails / total.n
    spread = hosts.agg(F.sum(F.pow(F.col("fails") / F.col("n") - mean, F.lit(2.0)))).first()[0] / total.hosts
    noise = mean * (1 - mean) * total.inverse / total.hosts
    low, high = WEIGHT_BOUNDS
    weight = high if spread <= noise else min(high, max(low, mean * (1 - mean) / (spread - noise) - 1))
    return hosts.withColumn("rate", (F.col("fails") + weight * mean) / (F.col("n") + weight))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate): one row for each row of ``docs``.

    kept: the base rules pass and the host's shrunk rate is at most ``limit``.  Null and repeated ids stay
    rows of their own; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    rows = cut_lineage(with_metrics(rows).drop("text"))
    rates = host_rates(rows, "host", fails_a_rule())
    joined = join_per_key(rows, rates.select("host", F.col("rate").alias("host_rate")), hot_keys(rates, "host"), "host")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("host_rate") <= limit)).alias("kept"), "host_rate")


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that ``judge`` would keep, with their columns.

    The rules are held against each text once: rows and verdicts are written together, and the written
    rows are joined with their hosts' rates, a frequent host's where they lie.
    """
    plain = numbered_columns(docs)
    text_at, host_at = (f"c{docs.columns.index(c)}" for c in (text_col, host_col))
    measured = with_metrics(plain, text_at).withColumns({"failed": fails_a_rule(), "host": F.col(host_at)})
    measured = cut_lineage(measured.select(*plain.columns, "host", "failed", "base_failed"))
    rates = host_rates(measured, "host", F.col("failed"))
    good = measured.where("not base_failed")
    rated = join_per_key(good, rates.select("host", "rate"), hot_keys(rates, "host"), "host")
    return rated.where(F.col("rate") <= limit).select(*plain.columns).toDF(*docs.columns)


def oracle_sql(limit: float = HOST_LIMIT) -> str:
    """DuckDB SQL for ``judge`` over the view ``documents``, without host_rate."""
    low, high = WEIGHT_BOUNDS
    return rf"""
with words as (
  select doc_id, source, coalesce(text, '') as text, row_number() over () as r,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
wins as (select r, i, list_aggregate(w[i:i + 2], 'string_agg', ' ') as win from (select r, w, unnest(range(1, len(w) - 1)) as i from words)),
hit as (select r, i from (select r, i, count(*) over (partition by r, win) as c from wins) where c > 1),
covered as (select r, count(distinct i + k) as n_repeat_words from hit, (select unnest([0, 1, 2]) as k) group by r),
m as (
  select words.r, doc_id, source, cast(len(w) as bigint) as n_words, cast(coalesce(length(array_to_string(w, '')), 0) as bigint) as word_chars,
         cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
         cast(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))
              - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) as bigint) as n_dup_lines,
         cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from words left join covered using (r)),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from m),
f as (select *, base_failed or 10 * n_symbols > word_chars or word_chars < 2 * n_words or word_chars > 20 * n_words as failed from b),
h as (select source as host, count(*) as n, sum(cast(failed as bigint)) as fails from f group by source),
t as (select sum(fails) / sum(n) as mean, count(*) as hosts, sum(1.0 / n) as inverse from h),
s as (select mean, (select sum(pow(fails / n - mean, 2)) from h) / hosts as spread, mean * (1 - mean) * inverse / hosts as noise from t),
p as (select mean, case when spread <= noise then {high} else least({high}, greatest({low}, mean * (1 - mean) / (spread - noise) - 1)) end as weight from s),
v as (select host, (fails + weight * mean) / (n + weight) as rate from h, p)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed) and rate <= {limit} as kept
from f join v on f.source is not distinct from v.host"""

"""Engagement scores, time decay, time buckets, quotas, and selection, all lazy.

Percentile ranks come from the counts of distinct values, not from a window over all rows: a metric's
distinct values are summed up in their order by two levels of counts, so no task sees a whole column.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import tables

# The weights of the metrics.
WEIGHTS = {"view": 0.05, "like": 0.25, "comment": 0.15, "banana": 0.20, "danmaku": 0.10, "stow": 0.20, "share": 0.05}
DAY_MS = 86_400_000
BUCKETS = ("year", "quarter", "month")


def load_candidates(ids: DataFrame, catalogue: DataFrame, order: str | None = None) -> DataFrame:
    """The first row of each id (by order, else by all columns) with the catalogue's columns that it lacks."""
    if "id" not in ids.columns:
        raise ValueError("no id column")
    first = tables.first_per_id(ids, "id", [order] if order else [c for c, t in ids.dtypes if not t.startswith("map")])
    return first.join(catalogue.select("id", *(c for c in catalogue.columns if c not in ids.columns)), "id")


def logged(metric: str) -> Column:
    return F.log1p(F.greatest(F.coalesce(F.col(metric).cast("double"), F.lit(0.0)), F.lit(0.0)))


def percentile_table(values: DataFrame, buckets: int = 4096) -> DataFrame:
    """values: m, x. Returns m, x, pct: the average rank of x among its metric's rows, over their number; upto: the rows up to x; all.

    Distinct values are dealt into ranges of x; ranges are summed in order, then values within a range.
    """
    distinct = values.groupBy("m", "x").agg(F.count(F.lit(1)).alias("n"))
    spans = distinct.groupBy("m").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("all"))
    dealt = distinct.join(F.broadcast(spans), "m").withColumn("r", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))).otherwise(0))
    sums = dealt.groupBy("m", "r").agg(F.sum("n").alias("rn"))
    before = sums.select("m", "r", (F.sum("rn").over(W.partitionBy("m").orderBy("r")) - F.col("rn")).alias("before"))
    run = F.sum("n").over(W.partitionBy("m", "r").orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    return dealt.withColumn("run", run).join(before, ["m", "r"]).select("m", "x", ((F.col("before") + F.col("run") - F.col("n") + (F.col("n") + 1) / 2) / F.col("all")).alias("pct"), (F.col("before") + F.col("run")).alias("upto"), "all")


def quantiles(table: DataFrame, q: float) -> DataFrame:
    """m, p: the interpolated q quantile of each metric of a percentile_table, and lo and hi. Partial minima, so no task sees all values of a metric."""
    place = (F.col("all") - 1) * F.lit(q)
    at = lambda p: F.min(F.when(F.col("upto") > p, F.col("x")))
    ends = table.groupBy("m").agg(at(F.floor(place)).alias("a"), at(F.ceil(place)).alias("b"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.max(place - F.floor(place)).alias("f"))
    return ends.select("m", (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("p"), "lo", "hi")


def _long(df: DataFrame, metrics: Mapping[str, str]) -> DataFrame:
    """m, x: a row a metric and row."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("m"), logged(c).alias("x")) for m, c in metrics.items()))).alias("v")).select("v.m", "v.x")


def score(df: DataFrame, metrics: Mapping[str, str], weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Adds name_norm for each metric (name: column) and score. A metric whose 99th percentile is 0, or that has one value, is 0 for all."""
    positive = {m: max(w, 0.0) for m, w in weights.items() if m in metrics}
    total = sum(positive.values())
    if total <= 0:
        raise ValueError("no weight is above 0")
    xs = df.select("*", *(logged(c).alias(f"_x_{m}") for m, c in metrics.items()))
    pct = percentile_table(_long(df, metrics))
    of = quantiles(pct, 0.99)
    pick = lambda m, value: F.max(F.when(F.col("m") == m, value))
    facts = of.agg(*(pick(m, F.col("p")).alias(f"_p_{m}") for m in metrics), *(pick(m, F.col("lo") < F.col("hi")).alias(f"_d_{m}") for m in metrics))
    out = xs
    for m in metrics:
        mine = pct.where(F.col("m") == m).select(F.col("x").alias(f"_x_{m}"), F.col("pct").alias(f"_r_{m}"))
        out = out.join(mine, f"_x_{m}", "left")
    out = out.join(F.broadcast(facts))  # one row
    norm = {m: F.when((F.col(f"_p_{m}") > 0) & F.col(f"_d_{m}"), F.col(f"_r_{m}")).otherwise(0.0) for m in metrics}
    out = out.select(*df.columns, *(c.alias(f"{m}_norm") for m, c in norm.items()))
    weighted = sum((F.col(f"{m}_norm") * positive.get(m, 0.0) for m in metrics), F.lit(0.0))
    return out.withColumn("score", weighted / total)


def log_clip_p99(df: DataFrame, metrics: Mapping[str, str]) -> DataFrame:
    """One row: the 99th percentile of each logged metric, exact and interpolated."""
    of = quantiles(percentile_table(_long(df, metrics)), 0.99)
    return of.agg(*(F.max(F.when(F.col("m") == m, F.col("p"))).alias(m) for m in metrics))


def decay(df: DataFrame, created_ms: str, now_ms: int, half_life_days: float = 540.0) -> DataFrame:
    """score becomes score_before_decay times time_decay; a null or future time has age 0."""
    if half_life_days <= 0:
        raise ValueError("the half-life must be above 0")
    age = F.greatest((F.lit(now_ms) - F.coalesce(F.col(created_ms), F.lit(now_ms))) / F.lit(float(DAY_MS)), F.lit(0.0))
    out = df.withColumnRenamed("score", "score_before_decay").withColumn("age_days", age)
    out = out.withColumn("time_decay", F.pow(F.lit(0.5), F.col("age_days") / half_life_days))
    return out.withColumn("score", F.col("score_before_decay") * F.col("time_decay"))


def bucket(created_ms: str, granularity: str) -> Column:
    """2024, 2024-Q1 or 2024-01, in UTC (the session's zone should be UTC); null is "unknown"."""
    t = F.timestamp_millis(F.col(created_ms).cast("long"))
    made = {"year": F.date_format(t, "yyyy"), "quarter": F.concat(F.date_format(t, "yyyy"), F.lit("-Q"), F.quarter(t).cast("string")), "month": F.date_format(t, "yyyy-MM")}
    if granularity not in made:
        raise ValueError(f"unknown bucket {granularity}")
    return F.coalesce(made[granularity], F.lit("unknown"))


def quotas(counts: DataFrame, top_k: int, min_per_bucket: int = 0) -> DataFrame:
    """counts: bucket, n (a row a bucket, so few). Returns bucket, quota: a floor for each, the rest by largest remainder, ties by bucket."""
    if min_per_bucket < 0:
        raise ValueError("the minimum is below 0")
    all_rows = W.partitionBy()
    base = counts.withColumn("g", F.least(F.lit(min_per_bucket).cast("long"), F.col("n"))).withColumn("r", F.col("n") - F.col("g"))
    base = base.withColumn("given", F.sum("g").over(all_rows)).withColumn("rest", F.sum("r").over(all_rows))
    base = base.withColumn("slots", F.when(F.col("given") > top_k, F.raise_error(F.lit("the minimum of all buckets is above top_k")).cast("long")).otherwise(F.lit(top_k) - F.col("given")))
    share = F.when((F.col("rest") > 0) & (F.col("slots") > 0), F.col("r") / F.col("rest") * F.col("slots")).otherwise(0.0)
    base = base.withColumn("e", share).withColumn("whole", F.floor("e"))
    base = base.withColumn("left", F.when((F.col("rest") > 0) & (F.col("slots") > 0), F.col("slots") - F.sum("whole").over(all_rows)).otherwise(0))
    order = F.row_number().over(W.orderBy(F.desc(F.col("r") > 0), F.desc(F.col("e") - F.col("whole")), "bucket"))
    extra = F.when((F.col("r") > 0) & (order <= F.col("left")), 1).otherwise(0)
    return base.select("bucket", (F.col("g") + F.col("whole") + extra).cast("long").alias("quota"))


def select_top(df: DataFrame, top_k: int, mode: str = "time-quota", granularity: str = "month", min_per_bucket: int = 1, created_ms: str = "create_ms") -> DataFrame:
    """Adds time_bucket and sel_order, 1 to top_k.

    score: the best by score. time-quota: each bucket's best up to its quota, in the buckets' order;
    where that falls short, the best of the others follow. Only rows of a rank up to top_k within their
    bucket, or of all, go past the first windows.
    """
    rows = df.withColumn("time_bucket", bucket(created_ms, granularity))
    best = [F.desc("score"), F.desc("id")]
    if mode == "score":
        top = rows.orderBy(*best).limit(top_k)
        return top.withColumn("sel_order", F.row_number().over(W.orderBy(*best)).cast("long"))
    if mode != "time-quota":
        raise ValueError(f"unknown mode {mode}")
    share = quotas(rows.groupBy(F.col("time_bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n")), top_k, min_per_bucket)
    ranked = rows.withColumn("_rn", F.row_number().over(W.partitionBy("time_bucket").orderBy(*best))).where(F.col("_rn") <= top_k)
    ranked = ranked.join(F.broadcast(share), F.col("time_bucket") == F.col("bucket")).drop("bucket")  # a row a bucket
    # A row of the backfill is among the top_k of its own bucket, so the rows above hold all of it.
    by = W.orderBy(F.col("_rn") > F.col("quota"), F.when(F.col("_rn") <= F.col("quota"), F.col("time_bucket")), *best)
    return ranked.withColumn("sel_order", F.row_number().over(by).cast("long")).where(F.col("sel_order") <= top_k).drop("_rn", "quota")


def distribution(df: DataFrame, column: str = "time_bucket") -> DataFrame:
    """bucket, n, share, by bucket."""
    counts = df.groupBy(F.col(column).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy())).orderBy("bucket")


def rerank(candidates: DataFrame, metrics: Mapping[str, str], now_ms: int, created_ms: str = "create_ms", weights: Mapping[str, float] = WEIGHTS, half_life_days: float = 540.0, **selection) -> DataFrame:
    return select_top(decay(score(candidates, metrics, weights), created_ms, now_ms, half_life_days), created_ms=created_ms, **{"top_k": 1000} | selection)


def output_columns(df: DataFrame, info: tuple[str, ...] = ()) -> DataFrame:
    """The scores, what BM25 gave if it is there, and display columns if they are there."""
    base = ("id", "score_before_decay", "time_decay", "score", "age_days", "time_bucket")
    passed = ("rank", "query_text", "query_terms", "total_score", "title_score", "description_score", "tags_score", "parent_score", "channel_score")
    return df.select(*base, *tables.optional_columns(df, passed), *tables.optional_columns(df, info))

"""Scorecards, costs and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import search_norm

#: US dollars for a million tokens: input missed, input cached, output.
PRICES = {"cheap": (0.14, 0.0028, 0.28), "strong": (0.435, 0.003625, 0.87)}


def case_scores(cases: DataFrame) -> DataFrame:
    """cases (kind, expect, traps, hints, found) with ``met``: whether a
    retrieval case is met by the joined text of its results:
    an expected string appears; a trap is met by any expected form; an
    unverifiable case is met when neither traps nor expected forms appear."""
    rows = cases.withColumn("text_", search_norm(F.col("found")))
    any_of = lambda xs: F.exists(F.coalesce(F.col(xs), F.array().cast("array<string>")), lambda x: F.contains(F.col("text_"), x))
    met = F.when(F.col("kind") == "unverifiable", ~any_of("traps") & ~any_of("expect")).when(F.col("kind") == "trap", any_of("expect")).otherwise(any_of("expect") | any_of("hints"))
    return rows.withColumn("met", met).drop("text_")


def scorecard(rows: DataFrame, *keys: str) -> DataFrame:
    """Per provider and per (group, provider): hits and totals by
    kind, failures and mean latency over positive values; one pass of grouping sets."""
    hit = lambda k: F.count_if((F.col("kind") == k) & F.coalesce(F.col("hit"), F.lit(False))).alias(f"{k}_hit")
    total = lambda k: F.count_if(F.col("kind") == k).alias(f"{k}_total")
    measures = [m(k) for k in ("expect", "trap", "unverifiable") for m in (hit, total)]
    mean = F.round(F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms")))).cast("long").alias("mean_latency_ms")
    group, provider = keys
    return rows.groupingSets([[F.col(group), F.col(provider)], [F.col(provider)]], F.col(group), F.col(provider)).agg(*measures, F.count_if(F.col("failed")).alias("failures"), mean, F.grouping(group).cast("long").alias("all_groups"))


def filler_score(fixtures: DataFrame) -> DataFrame:
    """Fixtures (id, cut, keep, out) -> cut recall, keep rate, words wrongly cut."""
    gone = F.size(F.filter("cut", lambda t: ~F.contains(F.col("out"), t)))
    kept = F.size(F.filter("keep", lambda t: F.contains(F.col("out"), t)))
    rate = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(1.0)
    rows = fixtures.withColumns({"gone": gone, "kept": kept, "n_cut": F.size("cut"), "n_keep": F.size("keep")})
    return rows.agg(rate("gone", "n_cut").alias("cut_recall"), rate("kept", "n_keep").alias("keep_rate"), F.sum(F.col("n_keep") - F.col("kept")).cast("long").alias("over_deletions"))


def golden_score(fixtures: DataFrame) -> DataFrame:
    """Fixtures (id, contain, forbid, out) -> which pass."""
    missing = F.filter("contain", lambda t: ~F.contains(F.col("out"), t))
    broken = F.filter("forbid", lambda t: F.contains(F.col("out"), t))
    return fixtures.select("id", F.size(missing).cast("long").alias("missing"), F.size(broken).cast("long").alias("forbidden"), ((F.size(missing) == 0) & (F.size(broken) == 0)).alias("passed"))


def cost(inputs: Column, cached: Column, outputs: Column, models: list[str], writer: str) -> Column:
    """The run's cost: fresh input at the cheapest price of its models,
    output at the writing model's; null when a price is unknown."""
    if any(m not in PRICES for m in [*models, writer]):
        return F.lit(None).cast("double")
    miss, hit = min(PRICES[m][0] for m in models), min(PRICES[m][1] for m in models)
    fresh = F.greatest(F.lit(0), inputs - cached)
    return F.round((fresh * miss + cached * hit + outputs * PRICES[writer][2]) / 1e6, 6)


def quality(rows: DataFrame, *keys: str) -> DataFrame:
    """Files (keys, file, hard, soft, sections, flagged, open) ->
    blocked, review_needed or ready, with the counts behind it."""
    hard = F.count_distinct(F.when(F.col("hard") > 0, F.col("file")))
    todo = F.sum("soft") + F.sum("flagged") + F.sum("open")
    return rows.groupBy(*keys).agg(hard.alias("hard_files"), F.sum("sections").alias("n_sections"), F.sum("flagged").alias("n_flagged"), F.when(hard > 0, "blocked").when(todo > 0, "review_needed").otherwise("ready").alias("state"))


def exit_code(failed: Column, unaudited: Column, audit_failed: Column, allowed: Column, has_output: Column) -> Column:
    """P21."""
    return F.when(failed | unaudited, 1).when(audit_failed & ~(allowed & has_output), 1).otherwise(0).cast("long")


def repair_action(failed: Column) -> Column:
    """What a failed audit calls for: the whole file where text is missing
    or compressed, else the marked places."""
    return F.when(F.size(failed) == 0, "none").when(F.arrays_overlap(failed, F.array(F.lit("compression"), F.lit("content_gap"), F.lit("ending_missing"))), "rewrite").otherwise("patch")

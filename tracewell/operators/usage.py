"""Usage and cost analytics over records of model calls.

A record has ts, request_id, session_id, project, git_branch, model, input_tokens, output_tokens, cache_creation_tokens (and its 5m and 1h parts), cache_read_tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: USD for a million tokens by model family.
PRICES = [("opus", 5.0, 25.0, 6.25, 10.0, 0.5), ("opus_legacy", 15.0, 75.0, 18.75, 30.0, 1.5), ("sonnet", 3.0, 15.0, 3.75, 6.0, 0.3), ("haiku", 1.0, 5.0, 1.25, 2.0, 0.1)]
#: Tokens of a window by plan.
PLAN_LIMITS = {"free": 25_000, "pro": 150_000, "max_5x": 500_000, "max_20x": 2_000_000}
PARTS = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"]
WINDOW_HOURS, RATE_MINUTES = 5, 15


def total_tokens() -> Column:
    return sum((F.coalesce(c, F.lit(0)) for c in PARTS[1:]), F.coalesce(PARTS[0], F.lit(0)))


def billable() -> Column:
    """Without what was read from the cache."""
    return F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation_tokens")


def model_family(model: Column) -> Column:
    m = F.lower(model)
    legacy = m.contains("opus-4-0") | m.contains("opus-4-1") | m.contains("opus-4-2025")
    return F.when(m.contains("opus") & legacy, "opus_legacy").when(m.contains("opus"), "opus").when(m.contains("haiku"), "haiku").otherwise("sonnet")


def first_of_requests(records: DataFrame, order: list[str]) -> DataFrame:
    """The first record of each request; records without a request id all stay."""
    named = F.coalesce("request_id", F.lit("")) != ""
    first = F.row_number().over(Window.partitionBy("request_id").orderBy(*order))
    return records.where(named).withColumn("_n", first).where("_n = 1").drop("_n").unionByName(records.where(~named))


def in_window(records: DataFrame, now: Column, hours: int = WINDOW_HOURS) -> DataFrame:
    """Records of the hours before now; the bound reaches the scan."""
    kind = records.schema["ts"].dataType  # a bound of another type would cast the column, and stay above the scan
    return records.where((F.col("ts") >= (now - F.make_dt_interval(hours=F.lit(hours))).cast(kind)) & (F.col("ts") <= now.cast(kind)))


def window_stats(records: DataFrame) -> DataFrame:
    """Totals, and by model, session and project, in one pass over grouping sets: level, name, window_tokens, the parts and api_calls."""
    r = records.select("model", "session_id", "project", *PARTS)
    sets = r.groupingSets([[], ["model"], ["session_id"], ["project"]], "model", "session_id", "project").agg(
        F.grouping_id().alias("g"), F.sum(total_tokens()).alias("window_tokens"), *[F.sum(c).alias(c) for c in PARTS], F.count("*").alias("api_calls")
    )
    level = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "model").when(F.col("g") == 5, "session").otherwise("project")
    return sets.select(level.alias("level"), F.coalesce("model", "session_id", "project", F.lit("")).alias("name"), "window_tokens", *PARTS, "api_calls")


def primary_model(records: DataFrame) -> DataFrame:
    """The model with the most tokens; of equal ones, the first by name."""
    by = records.groupBy("model").agg(F.sum(total_tokens()).alias("tokens"))
    return by.agg(F.min_by("model", F.struct(-F.col("tokens"), F.col("model"))).alias("primary_model"), F.max("tokens").alias("tokens"))


def burn_rate(records: DataFrame, now: Column) -> DataFrame:
    """Tokens a minute over the last minutes if they hold two records, else over all; nothing for under two records or half a minute."""
    recent = F.col("ts") >= now - F.make_dt_interval(mins=F.lit(RATE_MINUTES))
    agg = lambda on: (F.count(F.when(on, 1)), F.min(F.when(on, F.col("ts"))), F.max(F.when(on, F.col("ts"))), F.sum(F.when(on, total_tokens())))
    names = ("n", "first", "last", "total")
    one = records.agg(*[c.alias("r_" + n) for c, n in zip(agg(recent), names, strict=True)], *[c.alias("a_" + n) for c, n in zip(agg(F.lit(True)), names, strict=True)])
    pick = lambda n: F.when(F.col("r_n") >= 2, F.col("r_" + n)).otherwise(F.col("a_" + n)).alias(n)
    minutes = (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / F.lit(60e6)
    return one.select(*[pick(n) for n in names]).where(F.col("n") >= 2).withColumn("m", minutes).where("m >= 0.5").select(F.round(F.col("total") / F.col("m"), 6).alias("tokens_per_minute"), F.round("m", 1).alias("sample_minutes"), F.col("n").alias("sample_count"))


def plan_type(window_tokens: Column) -> Column:
    return F.when(window_tokens >= 500_000, "max_20x").when(window_tokens >= 150_000, "max_5x").otherwise("pro")


def window_level(window_tokens: Column, limit: Column) -> Column:
    """Percent of the window's limit to a level: 60, 80, 95."""
    pct = window_tokens / limit * 100
    return F.when(pct >= 95, "critical").when(pct >= 80, "warning").when(pct >= 60, "notice").otherwise("ok")


def priced(records: DataFrame) -> DataFrame:
    """Records with family, and the cost of each component in USD. The price table has four rows."""
    spark = records.sparkSession
    prices = spark.createDataFrame(PRICES, "family string, p_in double, p_out double, p_5m double, p_1h double, p_read double")
    r = records.withColumn("family", model_family(F.coalesce("model", F.lit("")))).join(F.broadcast(prices), "family")
    tiers = F.coalesce("cache_creation_5m_tokens", F.lit(0)) + F.coalesce("cache_creation_1h_tokens", F.lit(0))
    made = F.when(tiers > 0, F.coalesce("cache_creation_5m_tokens", F.lit(0)) * F.col("p_5m") / 1e6 + F.coalesce("cache_creation_1h_tokens", F.lit(0)) * F.col("p_1h") / 1e6).otherwise(F.col("cache_creation_tokens") * F.col("p_5m") / 1e6)
    return r.withColumns({"cost_input": F.col("input_tokens") * F.col("p_in") / 1e6, "cost_output": F.col("output_tokens") * F.col("p_out") / 1e6, "cost_cache_creation": made, "cost_cache_read": F.col("cache_read_tokens") * F.col("p_read") / 1e6}).drop("p_in", "p_out", "p_5m", "p_1h", "p_read")


def cost() -> Column:
    return F.col("cost_input") + F.col("cost_output") + F.col("cost_cache_creation") + F.col("cost_cache_read")


def estimate_cost(records: DataFrame) -> DataFrame:
    """level (total, model, project), name, cost rounded to cents."""
    r = priced(records).select("model", "project", cost().alias("cost"))
    sets = r.groupingSets([[], ["model"], ["project"]], "model", "project").agg(F.grouping_id().alias("g"), F.round(F.sum("cost"), 2).alias("cost"))
    level = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "model").otherwise("project")
    return sets.select(level.alias("level"), F.coalesce("model", "project", F.lit("")).alias("name"), "cost")


def daily(records: DataFrame) -> DataFrame:
    """By UTC date: billable tokens, the parts, calls."""
    return records.where("ts IS NOT NULL").groupBy(F.to_date("ts").cast("string").alias("date")).agg(F.sum(billable()).alias("billable_tokens"), *[F.sum(c).alias(c) for c in PARTS], F.count("*").alias("api_calls"))


def by_project(records: DataFrame) -> DataFrame:
    """By project: billable tokens, calls, models (sorted), sessions (distinct)."""
    return records.groupBy("project").agg(F.sum(billable()).alias("billable_tokens"), F.sum("cache_read_tokens").alias("cache_read_tokens"), F.count("*").alias("api_calls"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), F.count_distinct("session_id").alias("sessions"))


def insights(records: DataFrame) -> DataFrame:
    """One row: calls, sessions, days, tokens for each of these, the part read from the cache, the busiest day."""
    by_day = records.groupBy(F.to_date("ts").cast("string").alias("d")).agg(F.sum(total_tokens()).alias("t"))
    day = by_day.agg(F.count("*").alias("days"), F.min_by("d", F.struct(-F.col("t"), F.col("d"))).alias("busiest_day"), F.max("t").alias("busiest_tokens"))
    total = records.agg(F.count("*").alias("api_calls"), F.count_distinct("session_id").alias("sessions"), F.sum(total_tokens()).alias("tokens"), F.sum("cache_read_tokens").alias("read"), F.sum("input_tokens").alias("inp"), F.sum("cache_creation_tokens").alias("made"))
    return total.crossJoin(day).select("api_calls", "sessions", "days", F.round(F.col("tokens") / F.col("sessions"), 6).alias("tokens_per_session"), F.round(F.col("tokens") / F.col("days"), 6).alias("tokens_per_day"), F.round(F.col("read") * 100.0 / (F.col("read") + F.col("inp") + F.col("made")), 6).alias("cache_hit_pct"), "busiest_day", "busiest_tokens")


def top_by(records: DataFrame, key: Column, name: str, n: int) -> DataFrame:
    """The n values of a key with the most tokens; ties by value."""
    return records.groupBy(key.alias(name)).agg(F.sum(total_tokens()).alias("tokens")).orderBy(F.desc("tokens"), name).limit(n)


def billing_audit(records: DataFrame, flat_input: float = 5.0, flat_output: float = 25.0) -> DataFrame:
    """One row: totals, cost by component, the commonest family, the part of cache reads, and what all input would cost at one rate."""
    p = priced(records)
    fam = p.groupBy("family").count().agg(F.min_by("family", F.struct(-F.col("count"), F.col("family"))).alias("common_family"))
    sums = p.agg(*[F.sum(c).alias(c) for c in PARTS], *[F.round(F.sum(c), 2).alias(c) for c in ("cost_input", "cost_output", "cost_cache_creation", "cost_cache_read")], F.round(F.sum(cost()), 2).alias("cost_total"))
    all_in = F.col("input_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")
    return sums.crossJoin(fam).withColumn("cache_read_pct", F.round(F.col("cache_read_tokens") * 100.0 / (all_in + F.col("output_tokens")), 1)).withColumn("flat_rate_cost", F.round(all_in * flat_input / 1e6 + F.col("output_tokens") * flat_output / 1e6, 2))


def budget_usage(records: DataFrame, today: Column) -> DataFrame:
    """Tokens of the UTC day and of the seven days up to it."""
    d = F.to_date("ts")
    return records.agg(F.coalesce(F.sum(F.when(d == today, total_tokens())), F.lit(0)).alias("daily_tokens"), F.coalesce(F.sum(F.when((d > F.date_sub(today, 7)) & (d <= today), total_tokens())), F.lit(0)).alias("weekly_tokens"))


def budget_level(used: Column, budget: Column) -> Column:
    """Levels at 60, 80 and 95 percent; nothing without a budget."""
    pct = used * 100.0 / budget
    return F.when(budget <= 0, None).when(pct >= 95, "critical").when(pct >= 80, "warning").when(pct >= 60, "notice").otherwise("ok")


def session_summary(records: DataFrame, baseline: int, limit: int) -> DataFrame:
    """Tokens of the window, percent of the limit, tokens since a baseline (never below 0)."""
    return records.agg(F.sum(total_tokens()).alias("window_tokens")).select("window_tokens", F.round(F.col("window_tokens") * 100.0 / limit, 1).alias("pct"), F.greatest(F.lit(0), F.col("window_tokens") - baseline).alias("session_tokens"), plan_type(F.col("window_tokens")).alias("plan"))

"""Counts, latency and quality tiers over a table of finished turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import rules


def turn_stats(turns: DataFrame) -> DataFrame:
    """Turns per day, outcome and fallback reason; the reason is kept only for fallbacks."""
    reason = F.when(
        F.col("outcome") == "fallback", F.coalesce(F.nullif("fallback_reason", F.lit("")), F.lit("unknown"))
    ).otherwise("")
    return turns.groupBy("day", F.coalesce("outcome", F.lit("unknown")).alias("outcome"), reason.alias("reason")).agg(
        F.count("*").alias("turns")
    )


def turn_rollup(turns: DataFrame) -> DataFrame:
    """Subtotals of `turn_stats` by day and outcome; the grand total has empty keys."""
    return (
        turn_stats(turns)
        .rollup("day", "outcome", "reason")
        .agg(F.sum("turns").alias("turns"), F.grouping_id().cast("int").alias("level"))
        .select(
            F.coalesce("day", F.lit("")).alias("day"),
            F.coalesce("outcome", F.lit("")).alias("outcome"),
            F.coalesce("reason", F.lit("")).alias("reason"),
            "level",
            "turns",
        )
    )


def order_statistic(df: DataFrame, value: str, keys: list[str], rank: Column, width: int = 1000) -> DataFrame:
    """Exact order statistic of an integer column per key.

    `rank` is a 1-based rank written over the column `n` (rows of the key).  Two histogram
    passes replace a sort of the rows: a coarse one finds the bucket that holds the rank, a fine
    one covers that bucket only.  Both aggregate map-side, so one huge key is no single task.
    """
    bucket = F.floor(F.col(value) / F.lit(width)).cast("long")
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), bucket.alias("_b"))
    by_key = Window.partitionBy(*keys)
    coarse = (
        rows.groupBy(*keys, "_b")
        .agg(F.count("*").alias("_c"))
        .withColumn("_cum", F.sum("_c").over(by_key.orderBy("_b")))
        .withColumn("n", F.sum("_c").over(by_key))
        .withColumn("_rank", rank)
        .where((F.col("_cum") >= F.col("_rank")) & (F.col("_cum") - F.col("_c") < F.col("_rank")))
        .select(*keys, "_b", "n", (F.col("_rank") - F.col("_cum") + F.col("_c")).alias("_inner"))
    )
    fine = (
        rows.join(coarse, [*keys, "_b"])
        .groupBy(*keys, "_v", "n", "_inner")
        .agg(F.count("*").alias("_c"))
        .withColumn("_cum", F.sum("_c").over(by_key.orderBy("_v")))
        .where(F.col("_cum") >= F.col("_inner"))
    )
    return fine.groupBy(*keys, "n").agg(F.min("_v").alias(value))


def p95_rank() -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * F.lit(0.95)).cast("long"))


def latency_stats(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Mean (one decimal) and p95, the element max(0, int(0.95 n) - 1) of the sorted list."""
    p95 = order_statistic(turns, "elapsed_ms", keys, p95_rank()).select(*keys, F.col("elapsed_ms").alias("p95"))
    mean = turns.groupBy(*keys).agg(
        F.count("elapsed_ms").alias("n"),
        F.bround(F.sum("elapsed_ms").cast("double") / F.count("elapsed_ms"), 1).alias("average"),
    )
    return mean.join(p95, keys)


def latency_eval(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Evaluation variant: mean and median as half-even integers, and the same p95."""
    low = order_statistic(turns, "elapsed_ms", keys, F.floor((F.col("n") + 1) / 2).cast("long"))
    high = order_statistic(turns, "elapsed_ms", keys, F.floor((F.col("n") + 2) / 2).cast("long"))
    p95 = order_statistic(turns, "elapsed_ms", keys, p95_rank()).select(*keys, F.col("elapsed_ms").alias("p95"))
    mean = turns.groupBy(*keys).agg((F.sum("elapsed_ms").cast("double") / F.count("elapsed_ms")).alias("_mean"))
    return (
        mean.join(low.select(*keys, F.col("elapsed_ms").alias("_low")), keys)
        .join(high.select(*keys, F.col("elapsed_ms").alias("_high")), keys)
        .join(p95, keys)
        .select(
            *keys,
            F.bround("_mean").cast("long").alias("mean_ms"),
            F.bround((F.col("_low") + F.col("_high")) / 2).cast("long").alias("median_ms"),
            "p95",
        )
    )


def recent_fallbacks(turns: DataFrame, limit: int = rules.RECENT_FALLBACKS) -> DataFrame:
    """The newest fallbacks with their question cut to a preview (a top-k report)."""
    return (
        turns.where(F.col("outcome") == "fallback")
        .orderBy(F.col("created_at").desc(), F.col("turn_id"))
        .limit(limit)
        .select(
            "turn_id",
            F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
            F.coalesce("fallback_reason", F.lit("")).alias("reason"),
            F.substring("query_masked", 1, rules.QUERY_PREVIEW).alias("query"),
        )
    )


def quality_tier(scoped: Column, bad: Column) -> Column:
    rate = F.try_divide(bad.cast("double"), scoped)
    enough = (scoped >= rules.WARN_MIN_TURNS) & (bad >= rules.WARN_MIN_BAD)
    return (
        F.when(enough & (rate >= rules.CRITICAL_RATE), "critical")
        .when(enough & (rate >= rules.WARN_RATE), "warn")
        .otherwise("ok")
    )


def quality_counts() -> list[Column]:
    """Aggregates of one window of turns: scoped turns and actionable failures."""
    element = F.when(F.col("outcome") == "fallback", F.coalesce("fallback_reason", F.lit(""))).otherwise(F.col("outcome"))
    return [
        F.count(F.when(element != rules.OUT_OF_SCOPE, 1)).alias("scoped"),
        F.count(F.when(element.isin(*rules.ACTIONABLE_REASONS), 1)).alias("bad"),
    ]


def quality_warning(turns: DataFrame, window: str = "2 hours") -> DataFrame:
    """Quality tier of every window of the turn table."""
    return (
        turns.groupBy(F.window("created_at", window).alias("w"))
        .agg(*quality_counts())
        .select(
            F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
            "scoped",
            "bad",
            quality_tier(F.col("scoped"), F.col("bad")).alias("level"),
        )
    )


def client_error_counts(errors: DataFrame) -> DataFrame:
    """Errors per page:kind, most common first."""
    return (
        errors.groupBy(F.concat_ws(":", "page", "kind").alias("key"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "key")
    )

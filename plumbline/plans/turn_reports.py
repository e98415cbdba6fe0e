"""Queries over finished turns."""

from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.operators import turn_stats as ops
from plumbline.plans import inputs
from plumbline.registry import query, sql_list


@query("turn_stats", """
SELECT day, outcome, CASE WHEN outcome = 'fallback' THEN coalesce(nullif(fallback_reason, ''), 'unknown') ELSE '' END AS reason,
  count(*) AS turns FROM turns GROUP BY ALL
""", "turns")
def turn_stats(spark, d):
    return ops.turn_stats(inputs.turns(spark, d))


@query("turn_rollup", """
SELECT coalesce(day, '') AS day, coalesce(outcome, '') AS outcome, coalesce(reason, '') AS reason,
  cast(grouping(day, outcome, reason) AS INTEGER) AS level, count(*) AS turns
FROM (SELECT day, outcome, CASE WHEN outcome = 'fallback' THEN coalesce(nullif(fallback_reason, ''), 'unknown') ELSE '' END AS reason FROM turns)
GROUP BY ROLLUP (day, outcome, reason)
""", "turns")
def turn_rollup(spark, d):
    return ops.turn_rollup(inputs.turns(spark, d))


@query("latency_stats", """
SELECT outcome, count(elapsed_ms) AS n, round_even(sum(elapsed_ms)::DOUBLE / count(elapsed_ms), 1) AS average,
  max(elapsed_ms) FILTER (rn = greatest(1, floor(c * 0.95::DOUBLE)::BIGINT)) AS p95
FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY elapsed_ms) AS rn, count(*) OVER (PARTITION BY outcome) AS c FROM turns)
GROUP BY outcome
""", "turns")
def latency_stats(spark, d):
    return ops.latency_stats(inputs.turns(spark, d), ["outcome"])


@query("latency_eval", """
SELECT outcome, cast(round_even(sum(elapsed_ms)::DOUBLE / count(*), 0) AS BIGINT) AS mean_ms,
  cast(round_even(median(elapsed_ms), 0) AS BIGINT) AS median_ms,
  max(elapsed_ms) FILTER (rn = greatest(1, floor(c * 0.95::DOUBLE)::BIGINT)) AS p95
FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY elapsed_ms) AS rn, count(*) OVER (PARTITION BY outcome) AS c FROM turns)
GROUP BY outcome
""", "turns")
def latency_eval(spark, d):
    return ops.latency_eval(inputs.turns(spark, d), ["outcome"])


@query("recent_fallbacks", """
SELECT turn_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, coalesce(fallback_reason, '') AS reason,
  substr(query_masked, 1, 200) AS query
FROM turns WHERE outcome = 'fallback' ORDER BY turns.created_at DESC, turn_id LIMIT 60
""", "turns")
def recent_fallbacks(spark, d):
    return ops.recent_fallbacks(inputs.turns(spark, d))


@query("quality_warning", f"""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, scoped, bad,
  CASE WHEN scoped >= 20 AND bad >= 4 AND bad / scoped >= 0.35 THEN 'critical'
       WHEN scoped >= 20 AND bad >= 4 AND bad / scoped >= 0.20 THEN 'warn' ELSE 'ok' END AS level
FROM (SELECT time_bucket(INTERVAL '2 hours', created_at, TIMESTAMP '1970-01-01') AS w,
    count(*) FILTER (el <> 'out_of_scope') AS scoped, count(*) FILTER (el IN {sql_list(rules.ACTIONABLE_REASONS)}) AS bad
  FROM (SELECT *, CASE WHEN outcome = 'fallback' THEN coalesce(fallback_reason, '') ELSE outcome END AS el FROM turns) GROUP BY 1)
""", "turns")
def quality_warning(spark, d):
    return ops.quality_warning(inputs.turns(spark, d))


@query("client_error_counts", """
SELECT ['chat', 'calendar', 'tips'][k % 3 + 1] || ':' || event_type AS key, count(*) AS n
FROM (SELECT *, cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1 ORDER BY n DESC, key
""")
def client_error_counts(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    errors = inputs.table(spark, d, "events").select(
        inputs.pick(("chat", "calendar", "tips"), k % 3).alias("page"), F.col("event_type").alias("kind")
    )
    return ops.client_error_counts(errors)

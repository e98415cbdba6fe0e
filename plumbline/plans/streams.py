"""Streaming jobs run over the event table, with their batch twins."""

from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.operators import snapshots as sn
from plumbline.operators.filters import retention
from plumbline.plans import inputs
from plumbline.plans.snapshots import stored_events
from plumbline.registry import query, sql_list, view
from plumbline.session import scratch_dir
from plumbline.streaming import jobs, keyed


def event_stream(spark, d):
    return jobs.stream(spark, d, "events.parquet", inputs.table(spark, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


def turn_stream(spark, d):
    """Turns as they arrive, with the columns the alerts need."""
    k = F.get_json_object("props", "$.k").cast("int")
    outcome = F.when(F.col("event_type") == "purchase", "fallback").when(F.col("event_type") == "signup", "ask").when(F.col("event_type") == "error", "error").otherwise("answer")
    return event_stream(spark, d).select(
        F.col("ts").alias("created_at"), outcome.alias("outcome"), F.when(F.col("event_type") == "purchase", inputs.pick(rules.FALLBACK_REASONS, k % 5)).alias("fallback_reason")
    )


@query("quality_alert_stream", f"""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) FILTER (el <> 'out_of_scope') AS scoped, count(*) FILTER (el IN {sql_list(rules.ACTIONABLE_REASONS)}) AS bad FROM (
 SELECT time_bucket(INTERVAL '10 minutes', created_at, TIMESTAMP '1970-01-01') - to_minutes(10 * i) AS w, CASE WHEN outcome = 'fallback' THEN coalesce(fallback_reason, '') ELSE outcome END AS el FROM turns, range(0, 12) r(i)) GROUP BY w
HAVING scoped >= 20 AND bad >= 4 AND bad / scoped >= 0.2
""", "turns")
def quality_alert_stream(spark, d):
    """Two-hour windows every ten minutes whose quality tier is warn or critical."""
    windows = jobs.quality_windows(turn_stream(spark, d), slide="10 minutes")
    rows = jobs.latest_batch(jobs.run(windows, "update", "quality"), ["window_start"])
    return rows.where("level <> 'ok'").select(inputs.ts_text("window_start").alias("window_start"), "scoped", "bad")


# ── alerts ──────────────────────────────────────────────────────────────────────────────────────
view("alert_turns", """
SELECT epoch_us(created_at) AS us, outcome, CASE WHEN outcome = 'ask' AND k % 5 = 0 THEN 'timeout' ELSE fallback_reason END AS fallback_reason, elapsed_ms, outcome = 'error' AND k % 20 = 0 AS job_failed FROM turns
""", ("turns",))


def _rolling_sql(rule, rows, minutes, raised):
    frame = lambda last: f"(ORDER BY us RANGE BETWEEN {minutes * 60_000_000 - 1} PRECEDING AND {last})"
    count = lambda what, last: f"coalesce(sum({what}) OVER {frame(last)}, 0)::BIGINT"
    sides = [raised.format(n=f"n_{x}", slow=f"slow_{x}") for x in ("now", "before")]
    return f"""SELECT '{rule}' AS rule, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.%f') AS raised_at, n_now AS n FROM (
 SELECT us, {count('n', 'CURRENT ROW')} AS n_now, {count('slow', 'CURRENT ROW')} AS slow_now, {count('n', '1 PRECEDING')} AS n_before, {count('slow', '1 PRECEDING')} AS slow_before
 FROM (SELECT us, count(*) AS n, count(*) FILTER (elapsed_ms > {jobs.SLOW_MS}) AS slow FROM alert_turns WHERE {rows} GROUP BY us)) WHERE {sides[0]} AND NOT ({sides[1]})"""


@query("quality_alerts", " UNION ALL ".join([
    _rolling_sql("deadline", f"fallback_reason IN {sql_list(jobs.LATE_REASONS)}", 15, f"({{n}} >= {jobs.DEADLINE_ALERT})"),
    _rolling_sql("server_error", "outcome = 'error'", 5, f"({{n}} >= {jobs.ERROR_ALERT})"),
    _rolling_sql("slow", "true", 10, "({n} > 0 AND {n} - {slow} < greatest(floor({n} * 0.95::DOUBLE), 1))"),
    _rolling_sql("job_failed", "job_failed", 60, "({n} >= 1)"),
]), "alert_turns")
def quality_alerts(spark, d):
    """Alerts at the moments that raise them, over exact rolling windows."""
    k = F.col("k")
    turns = inputs.turns(spark, d).withColumns({
        "fallback_reason": F.when((F.col("outcome") == "ask") & (k % 5 == 0), "timeout").otherwise(F.col("fallback_reason")),
        "job_failed": (F.col("outcome") == "error") & (k % 20 == 0), "created_at": F.col("created_at").cast("timestamp"),
    })
    return jobs.quality_alerts(turns).select("rule", F.date_format("raised_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("raised_at"), "n")


# ── votes ───────────────────────────────────────────────────────────────────────────────────────
view("stream_votes", """
SELECT event_id, user_id AS tip_id, k AS token, k % 7 AS net, CASE WHEN event_type = 'purchase' THEN 'dispute' WHEN event_type = 'error' AND k % 10 = 0 THEN 'flag' ELSE 'confirm' END AS action, ts,
  cast(DATE '2024-01-01' + cast(user_id % 5 AS INTEGER) AS TIMESTAMP) AS public_from, user_id % 11 = 0 AS safety
FROM (SELECT *, cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE event_type <> 'signup' AND k <> user_id * 7 % 100 AND ts >= cast(DATE '2024-01-01' + cast(user_id % 5 AS INTEGER) AS TIMESTAMP)
""")
_NETS = range(7)
_SUMS = [f"{side}{n}" for side in "cdf" for n in _NETS]
_DELTA = ", ".join(f"sum(CASE WHEN side = '{x[0]}' AND net = {x[1:]} THEN d ELSE 0 END) AS {x}" for x in _SUMS)
_PREFIX = ", ".join(f"sum({x}) OVER w AS {x}" for x in _SUMS)
_of = lambda side: " + ".join(f"{side}{n}" for n in _NETS)
_held = lambda side: " + ".join(f"cast({side}{n} > 0 AS INTEGER)" for n in _NETS)
# every step of a tip: a vote that counts, and the moment it is 24 hours old; counts are those of all steps so far
view("vote_steps", f"""
SELECT *, cf + di AS total, coalesce(cf + di >= {rules.MIN_VOTES} AND di::DOUBLE / nullif(cf + di, 0) > {rules.CONTEST_RATIO}, false) AS majority,
  coalesce(dispute_nets >= {rules.FLAG_NETS_TO_HIDE} AND most_dispute::DOUBLE / nullif(di, 0) <= {rules.MAX_NET_SHARE}, false) AS diverse
FROM (
 SELECT tip_id, ts, n, safety, old, {_of('c')} AS cf, {_of('d')} AS di, {_of('f')} AS fl, {_held('d')} AS dispute_nets, {_held('f')} AS flag_nets,
  greatest({', '.join(f'd{n}' for n in _NETS)}) AS most_dispute, greatest({', '.join(f'c{n} + d{n}' for n in _NETS)}) AS most
 FROM (
  SELECT tip_id, ts, safety, ts >= public_from + INTERVAL {rules.MIN_PUBLIC_HOURS} HOUR AS old, row_number() OVER w AS n, {_PREFIX} FROM (
   SELECT tip_id, ts, event_id, any_value(safety) AS safety, any_value(public_from) AS public_from, {_DELTA} FROM (
    SELECT tip_id, ts, event_id, safety, public_from, action[1] AS side, net, 1 AS d FROM vote_changes
    UNION ALL SELECT tip_id, ts, event_id, safety, public_from, prev[1], net, -1 FROM vote_changes WHERE prev IS NOT NULL
    UNION ALL SELECT DISTINCT tip_id, public_from + INTERVAL {rules.MIN_PUBLIC_HOURS} HOUR, -1, safety, public_from, '', -1, 0 FROM stream_votes) GROUP BY 1, 2, 3)
  WINDOW w AS (PARTITION BY tip_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)))
""", ("vote_changes",))
view("vote_changes", """
SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY tip_id, token ORDER BY ts, event_id) AS prev FROM stream_votes WHERE action <> 'flag') WHERE prev IS DISTINCT FROM action
UNION ALL SELECT *, NULL AS prev FROM stream_votes WHERE action = 'flag' QUALIFY row_number() OVER (PARTITION BY tip_id, token ORDER BY ts, event_id) = 1
""", ("stream_votes",))


@query("vote_stream", """
SELECT tip_id, cast(arg_max(cf, n) AS BIGINT) AS confirm, cast(arg_max(di, n) AS BIGINT) AS dispute, cast(arg_max(fl, n) AS BIGINT) AS flags FROM vote_steps GROUP BY 1
""", "vote_steps")
def vote_stream(spark, d):
    return vote_verdicts(spark, d).select("tip_id", "confirm", "dispute", "flags")


@query("vote_stream_verdict", f"""
WITH hidden AS (SELECT tip_id, min(n) AS h FROM vote_steps WHERE fl >= {rules.FLAGS_TO_HIDE} AND flag_nets >= {rules.FLAG_NETS_TO_HIDE} GROUP BY 1
), steps AS (SELECT s.*, h, s.n IS DISTINCT FROM h AS judged FROM vote_steps s LEFT JOIN hidden USING (tip_id)
), bursts AS (SELECT tip_id, min(n) AS b FROM steps WHERE judged AND majority AND NOT diverse GROUP BY 1
), candidates AS (
 SELECT tip_id, arg_min(most::DOUBLE / total > {rules.MAX_NET_SHARE}, n) AS one_net FROM steps LEFT JOIN bursts USING (tip_id)
 WHERE NOT majority AND fl = 0 AND old AND NOT safety AND total >= {rules.MIN_VOTES} AND cf::DOUBLE / nullif(total, 0) >= {rules.MIN_CONFIRM_RATIO} AND (b IS NULL OR n < b) AND (h IS NULL OR n < h) GROUP BY 1
)
SELECT tip_id, CASE WHEN any_value(h) IS NOT NULL THEN 'hidden' WHEN any_value(one_net) IS NOT DISTINCT FROM false THEN 'student_approved' ELSE 'verifying' END AS status,
 coalesce(arg_max(majority AND diverse, n) FILTER (judged), false) AS contested, any_value(b) IS NOT NULL OR coalesce(any_value(one_net), false) AS burst_risk,
 coalesce(bool_or(fl >= {rules.FLAGS_TO_HIDE} AND flag_nets < {rules.FLAG_NETS_TO_HIDE} AND (h IS NULL OR n < h)), false) AS flag_review
FROM steps LEFT JOIN bursts USING (tip_id) LEFT JOIN candidates USING (tip_id) GROUP BY 1
""", "vote_steps")
def vote_stream_verdict(spark, d):
    return vote_verdicts(spark, d).select("tip_id", "status", "contested", "burst_risk", "flag_review")


def vote_verdicts(spark, d):
    k, user = F.get_json_object("props", "$.k").cast("int"), F.col("user_id")
    action = F.when(F.col("event_type") == "purchase", "dispute").when((F.col("event_type") == "error") & (k % 10 == 0), "flag").otherwise("confirm")
    votes = event_stream(spark, d).where("event_type <> 'signup'").select(
        "event_id", user.alias("tip_id"), k.alias("token"), (k % 7).alias("net"), action.alias("action"), "ts",
        F.date_add(F.lit("2024-01-01").cast("date"), (user % 5).cast("int")).cast("timestamp").alias("public_from"), (user % 11 == 0).alias("safety"),
    ).where((F.col("token") != F.col("tip_id") * 7 % 100) & (F.col("ts") >= F.col("public_from")))
    return jobs.latest_batch(jobs.run(keyed.tip_votes(votes), "update", "votes"), ["tip_id"])


# ── scans and lifetimes ───────────────────────────────────────────────────────────────────────────
@query("scan_stream", f"""
SELECT version, url, CASE WHEN bool_or(ok) THEN 'done' WHEN count(*) FILTER (NOT ok) = {rules.SCAN_MAX_ATTEMPTS} THEN 'given_up' ELSE 'waiting' END AS status, count(*) FILTER (NOT ok) AS failed FROM (
 SELECT *, row_number() OVER w AS n, coalesce(bool_or(ok) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM (
  SELECT user_id AS version, 'u' || json_extract_string(props, '$.k') AS url, event_type = 'view' AS ok, ts, event_id FROM events WHERE event_type <> 'signup')
 WINDOW w AS (PARTITION BY version, url ORDER BY ts, event_id)) WHERE NOT over AND n <= {rules.SCAN_MAX_ATTEMPTS} GROUP BY 1, 2
""")
def scan_stream(spark, d):
    """What tries of every (version, url) came to, as the stream left it."""
    ok = F.when(F.col("event_type") != "signup", F.col("event_type") == "view")
    url = F.concat(F.lit("u"), F.get_json_object("props", "$.k"))
    events = event_stream(spark, d).select(F.col("user_id").alias("version"), url.alias("url"), F.col("ts").alias("at"), "event_id", ok.alias("ok"))
    told = jobs.run(keyed.scans(events), "append", "scans").where("kind <> 'ask'")
    return told.groupBy("version", "url").agg(F.max_by("kind", "attempt").alias("status"), F.max("failed").cast("long").alias("failed"))


@query("ttl_stream", f"""
SELECT class, count(*) FILTER (expire_at >= last_seen) AS kept, count(*) FILTER (expire_at < last_seen) AS expired FROM (
 SELECT class, epoch_ms(ts + to_hours(CASE class {' '.join(f"WHEN '{k}' THEN {v}" for k, v in rules.TTL_HOURS.items())} END)) AS expire_at, max(epoch_ms(ts)) OVER () AS last_seen
 FROM (SELECT ts, ['{"','".join(rules.TTL_HOURS)}'][event_id % 7 + 1] AS class FROM events)) GROUP BY 1
""")
def ttl_stream(spark, d):
    """Rows that are still held, and rows that left state and result when their lifetime ended."""
    rows = event_stream(spark, d).select(F.col("event_id").alias("row_id"), "ts", inputs.pick(tuple(rules.TTL_HOURS), F.col("event_id") % 7).alias("class"))
    told = jobs.run(keyed.lifetimes(rows.withColumnRenamed("ts", "created_at"), "1 hour"), "append", "lifetimes")
    last = told.groupBy("class", "row_id").agg(F.bool_or(F.col("state") == "expired").alias("gone"))
    return last.groupBy("class").agg(F.count(F.when(~F.col("gone"), 1)).alias("kept"), F.count(F.when(F.col("gone"), 1)).alias("expired"))


# ── a snapshot kept by a stream ─────────────────────────────────────────────────────────────────────
@query("event_upsert_stream", """
SELECT id, CASE WHEN id % 3 = 0 AND (id % 6 <> 0 OR id % 7 = 0) THEN substr(title || ' 정정', 1, 120) ELSE title END AS title, CASE WHEN id % 7 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN id % 7 = 0 THEN '' ELSE reviewed_by END AS reviewed_by FROM stored_events WHERE id % 7 <> 0 OR id % 3 = 0
""", "stored_events")
def event_upsert_stream(spark, d):
    """Collected notices merged into the stored ones as they arrive."""
    seen = inputs.notices_of(jobs.stream(spark, d, "orders.parquet", inputs.table(spark, d, "orders").schema)).where("notice_id % 3 = 0")
    seen = seen.select(F.col("notice_id").alias("id"), F.concat("title", F.lit(" 정정")).alias("title"), F.lit("pending").alias("status"))
    first = sn.event_upsert(stored_events(spark, d).where("id % 7 <> 0"), seen_none(spark), F.lit(None).cast("timestamp"))
    merge = lambda before, batch: sn.event_upsert(before, batch, F.lit("2026-06-01").cast("timestamp"))
    return jobs.merge_stream(seen, first, merge, scratch_dir(spark, "events")).select("id", "title", "status", "reviewed_by")


def seen_none(spark):
    return spark.createDataFrame([], "id long, title string, status string")


# ── rate limit ──────────────────────────────────────────────────────────────────────────────────
def hits(events):
    """Requests by user in compressed time, so that the limit is reached."""
    return events.select("event_id", F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 / 16_000).alias("t"))


_RATE = f"""
WITH RECURSIVE hit AS (SELECT event_id, user_id AS key, epoch_us(ts)::DOUBLE / 1000000 / 16000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
taken AS (
 SELECT event_id, key, n, true AS accepted, [t] AS held FROM hit WHERE n = 1
 UNION ALL SELECT event_id, key, n, len(still) < {jobs.RATE_LIMIT}, CASE WHEN len(still) < {jobs.RATE_LIMIT} THEN list_append(still, t) ELSE still END FROM (
  SELECT h.event_id, h.key, h.n, h.t, list_filter(p.held, lambda x: h.t - x <= {jobs.RATE_SECONDS}) AS still FROM taken p JOIN hit h ON h.key = p.key AND h.n = p.n + 1))
SELECT event_id, key, accepted FROM taken
"""


@query("sliding_rate_limit", _RATE)
def sliding_rate_limit(spark, d):
    return jobs.rate_limit(hits(inputs.table(spark, d, "events")))


@query("rate_limit_stream", _RATE)
def rate_limit_stream(spark, d):
    return jobs.run(jobs.rate_limit_stream(hits(event_stream(spark, d))), "append", "rate").drop("batch")


@query("quota_stream", f"""
SELECT event_id, strftime(cast(ts + INTERVAL 9 HOUR AS DATE), '%Y-%m-%d') AS day FROM events QUALIFY row_number() OVER (PARTITION BY cast(ts + INTERVAL 9 HOUR AS DATE), user_id % 7 ORDER BY ts, event_id) <= {rules.REPORT_PER_NET_DAY}
""")
def quota_stream(spark, d):
    day = F.to_date(F.from_utc_timestamp("ts", "Asia/Seoul")).cast("string")
    requests = event_stream(spark, d).select("event_id", day.alias("day"), (F.col("user_id") % 7).alias("key"), "ts")
    return jobs.run(jobs.quota_stream(requests, rules.REPORT_PER_NET_DAY), "append", "quota").drop("batch")


@query("turn_dedup_stream", """
SELECT DISTINCT user_id AS thread_id, event_id // 2 AS request_id FROM events
""")
def turn_dedup_stream(spark, d):
    """Every request once, though half of them arrive twice."""
    requests = event_stream(spark, d).select(F.col("user_id").alias("thread_id"), F.floor(F.col("event_id") / 2).alias("request_id"), F.col("ts").alias("created_at"))
    twice = requests.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")).drop("copy")
    return jobs.run(jobs.first_requests(twice, "40 days"), "append", "requests").select("thread_id", "request_id")


@query("ttl_eviction", f"""
SELECT class, count(*) FILTER (ts + to_hours(h) > TIMESTAMP '2024-01-30') AS kept, count(*) FILTER (ts + to_hours(h) <= TIMESTAMP '2024-01-30') AS evicted FROM (
 SELECT *, CASE class {' '.join(f"WHEN '{k}' THEN {v}" for k, v in rules.TTL_HOURS.items())} END AS h FROM (SELECT ts, ['{"','".join(rules.TTL_HOURS)}'][event_id % 7 + 1] AS class FROM events)) GROUP BY 1
""")
def ttl_eviction(spark, d):
    """Rows of every lifetime class that stay and that leave."""
    rows = inputs.table(spark, d, "events").select("event_id", "ts", inputs.pick(tuple(rules.TTL_HOURS), F.col("event_id") % 7).alias("class"))
    kept = retention(rows, "class", "ts", F.lit("2024-01-30").cast("timestamp")).groupBy("class").agg(F.count("*").alias("kept"))
    total = rows.groupBy("class").agg(F.count("*").alias("n"))
    k = F.coalesce("kept", F.lit(0)).cast("long")
    return total.join(kept, "class", "left").select("class", k.alias("kept"), (F.col("n") - k).alias("evicted"))

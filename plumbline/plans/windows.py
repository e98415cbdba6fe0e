"""Window functions, top-k reports and orderings."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import rules
from plumbline.functions.text import norm_compact
from plumbline.operators import ranking as rk
from plumbline.plans import inputs
from plumbline.registry import query, sql_array, view

KST = "cast(ts + INTERVAL 9 HOUR AS DATE)"


def kst_day(ts) -> F.Column:
    return F.to_date(F.from_utc_timestamp(ts, "Asia/Seoul"))


@query("round_robin_merge", """
SELECT turn_id, part, row_number() OVER (PARTITION BY turn_id ORDER BY r, kind, part)::INTEGER AS place
FROM (SELECT turn_id, part, unnest([min((r, kind))]) AS p FROM (
   SELECT turn_id, part, supp % 3 AS kind, row_number() OVER (PARTITION BY turn_id, supp % 3 ORDER BY qty DESC, part, idx) AS r FROM facts
   QUALIFY r <= 5) GROUP BY 1, 2) t, LATERAL (SELECT p[1] AS r, p[2] AS kind)
QUALIFY place <= 5
""", "facts")
def round_robin_merge(spark, d):
    facts = inputs.facts(spark, d).select("turn_id", "part", (F.col("supp") % 3).alias("kind"), "qty", "idx")
    lists = rk.top_per_key(facts, ["turn_id", "kind"], [F.desc("qty"), F.col("part"), F.col("idx")], 5)
    return rk.round_robin(lists.withColumnRenamed("place", "r"), "turn_id", "kind", "r", "part", 5)


@query("first_per_id", """
SELECT evidence_id, strftime(min(ship_day), '%Y-%m-%d') AS first_day, arg_max(qty, (ship_day, turn_id, idx, qty)) AS last_qty FROM facts GROUP BY 1
""", "facts")
def first_per_id(spark, d):
    order = F.struct("ship_day", "turn_id", "idx", "qty")
    merged = rk.first_key_last_value(inputs.facts(spark, d), "evidence_id", order, "qty")
    return merged.select(
        "evidence_id", F.col("position.ship_day").cast("string").alias("first_day"), F.col("qty").alias("last_qty")
    )


@query("history_tail", f"""
SELECT item_id, day, ok FROM item_days QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY day DESC) <= {rules.HISTORY_KEEP}
""", "item_days")
def history_tail(spark, d):
    return rk.top_per_key(inputs.item_days(spark, d), ["item_id"], [F.desc("day")], rules.HISTORY_KEEP).select("item_id", "day", "ok")


@query("daily_quota", f"""
SELECT event_id, strftime({KST}, '%Y-%m-%d') AS day FROM events QUALIFY row_number() OVER (PARTITION BY {KST}, user_id % 7 ORDER BY ts, event_id) <= {rules.REPORT_PER_NET_DAY}
""")
def daily_quota(spark, d):
    rows = inputs.table(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 7).alias("net"), kst_day("ts").cast("string").alias("day"))
    order = [F.col("ts"), F.col("event_id")]
    return rk.daily_quota(rows, ["day", "net"], order, rules.REPORT_PER_NET_DAY).select("event_id", "day")


@query("joint_quota", f"""
SELECT event_id, day FROM (SELECT event_id, ts, strftime({KST}, '%Y-%m-%d') AS day FROM events QUALIFY row_number() OVER (PARTITION BY {KST}, user_id % 50 ORDER BY ts, event_id) <= {rules.TIP_PER_NET_DAY})
QUALIFY row_number() OVER (PARTITION BY day ORDER BY ts, event_id) <= {rules.SUBMIT_GLOBAL_DAY}
""")
def joint_quota(spark, d):
    rows = inputs.table(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 50).alias("net"), kst_day("ts").cast("string").alias("day"))
    order = [F.col("ts"), F.col("event_id")]
    accepted = rk.joint_quota(rows, "day", "net", order, rules.TIP_PER_NET_DAY, rules.SUBMIT_GLOBAL_DAY)
    return accepted.select("event_id", "day")


@query("text_claim", """
WITH RECURSIVE days AS (SELECT topic || cast(cust % 100 AS VARCHAR) AS key, start_date AS day, min(notice_id) AS notice_id FROM notices GROUP BY 1, 2),
claims(key, day) AS (SELECT key, min(day) FROM days GROUP BY key
 UNION ALL SELECT c.key, (SELECT min(x.day) FROM days x WHERE x.key = c.key AND x.day >= c.day + 90) FROM claims c WHERE c.day IS NOT NULL)
SELECT key, strftime(day, '%Y-%m-%d') AS day, notice_id FROM claims JOIN days USING (key, day)
""", "notices")
def text_claim(spark, d):
    key = norm_compact(F.concat("topic", (F.col("cust") % 100).cast("string")))
    days = inputs.notices(spark, d).groupBy(key.alias("key"), F.col("start_date").alias("day")).agg(F.min("notice_id").alias("notice_id"))
    # A claim lives 90 days; the distinct days of one text are few, so they fold in one row.
    claims = F.aggregate(
        F.array_sort(F.collect_set("day")),
        F.array().cast("array<date>"),
        lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).when(x >= F.date_add(F.try_element_at(acc, F.lit(-1)), 90), F.concat(acc, F.array(x))).otherwise(acc),
    )
    claimed = days.groupBy("key").agg(claims.alias("days")).select("key", F.explode("days").alias("day"))
    return days.join(claimed, ["key", "day"]).select("key", F.col("day").cast("string").alias("day"), "notice_id")


@query("report_seq", """
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events WHERE event_type = 'error'
""")
def report_seq(spark, d):
    rows = inputs.table(spark, d, "events").where("event_type = 'error'").select("event_id", "ts")
    return rk.sequence_number(rows, [], [F.col("ts"), F.col("event_id")], "seq").select("event_id", F.col("seq").cast("long").alias("seq"))


@query("question_flow", """
SELECT conv_id, turn, coalesce(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' | '), '') AS recent, text AS question
FROM conversations WHERE role = 'user'
""")
def question_flow(spark, d):
    users = inputs.table(spark, d, "conversations").where("role = 'user'")
    flow = rk.with_previous(users, ["conv_id"], ["turn"], F.floor(F.col("turn") / 1000), 3, F.col("text"))
    return flow.select("conv_id", "turn", F.array_join("previous", " | ").alias("recent"), F.col("text").alias("question"))


@query("clarification_once", """
SELECT turn_id, prev IS DISTINCT FROM 'ask' AS allowed FROM (SELECT turn_id, outcome, lag(outcome) OVER (PARTITION BY thread_id ORDER BY created_at, turn_id) AS prev FROM turns) WHERE outcome = 'ask'
""", "turns")
def clarification_once(spark, d):
    flow = rk.with_previous(
        inputs.turns(spark, d), ["thread_id"], ["created_at", "turn_id"], F.col("day"), 1, F.col("outcome")
    )
    previous = F.coalesce(F.try_element_at("previous", F.lit(1)), F.lit(""))
    return flow.where("outcome = 'ask'").select("turn_id", (previous != "ask").alias("allowed"))


@query("chip_round_robin", """
SELECT month, question, chip FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY pos, cat) AS chip FROM (
  SELECT month, question, min(pos) AS pos, arg_min(cat, (pos, cat)) AS cat FROM (
   SELECT cast(p_size % 12 + 1 AS INTEGER) AS month, p_type AS cat, p_name AS question, row_number() OVER (PARTITION BY p_size % 12 + 1, p_type ORDER BY p_partkey) AS pos FROM part QUALIFY pos <= 3)
  GROUP BY 1, 2)) WHERE chip <= 6
""")
def chip_round_robin(spark, d):
    part = inputs.table(spark, d, "part").select(
        (F.col("p_size") % 12 + 1).cast("int").alias("month"), F.col("p_type").alias("cat"), F.col("p_name").alias("question"), "p_partkey"
    )
    listed = rk.top_per_key(part, ["month", "cat"], [F.col("p_partkey")], 3)
    first = listed.groupBy("month", "question").agg(F.min(F.struct("place", "cat")).alias("at"))
    chips = rk.top_per_key(first, ["month"], [F.col("at")], 6)
    return chips.select("month", "question", F.col("place").cast("long").alias("chip"))


def week_bars(spark, d):
    """Bars of the calendar cut at week borders; a bar shows at most 62 days."""
    week = lambda x: F.date_trunc("week", x).cast("date")
    last = F.least(F.col("end_date"), F.date_add("start_date", 61))
    rows = inputs.calendar(spark, d).where("status = 'active'").select("cal_id", "title", "start_date", last.alias("last_day"))
    weeks = F.sequence(week(F.col("start_date")), week(F.col("last_day")), F.expr("INTERVAL 7 DAYS"))
    return rows.select("*", F.explode(weeks).alias("week")).select(
        "cal_id", "title", "start_date", "last_day", "week",
        F.greatest(F.datediff("start_date", "week"), F.lit(0)).alias("c0"),
        F.least(F.datediff("last_day", "week"), F.lit(6)).alias("c1"),
    )


view("week_bars", """
SELECT cal_id, title, start_date, last_day, week, greatest(start_date - week, 0)::INTEGER AS c0, least(last_day - week, 6)::INTEGER AS c1
FROM (SELECT *, cast(unnest(generate_series(cast(date_trunc('week', start_date) AS TIMESTAMP), cast(date_trunc('week', last_day) AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week
 FROM (SELECT *, least(end_date, start_date + 61) AS last_day FROM calendar WHERE status = 'active'))
""", ("calendar",))


@query("week_segments", "SELECT cal_id, strftime(week, '%Y-%m-%d') AS week, c0, c1, c1 - c0 + 1 AS days FROM week_bars", "week_bars")
def week_segments(spark, d):
    return week_bars(spark, d).select("cal_id", F.col("week").cast("string").alias("week"), "c0", "c1", (F.col("c1") - F.col("c0") + 1).alias("days"))


@query("interval_lanes", """
WITH RECURSIVE bars AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY c0, start_date, last_day, title, cal_id) AS n FROM week_bars),
placed AS (
 SELECT cal_id, week, c0, c1, n, 0 AS lane, [c1] AS ends FROM bars WHERE n = 1
 UNION ALL SELECT cal_id, week, c0, c1, n, lane, CASE WHEN lane = len(ends) THEN list_append(ends, c1) ELSE list_concat(list_append(ends[:lane], c1), ends[lane + 2:]) END FROM (
  SELECT b.cal_id, b.week, b.c0, b.c1, b.n, p.ends, coalesce(list_position(list_transform(p.ends, lambda e: e < b.c0), true), len(p.ends) + 1) - 1 AS lane FROM placed p JOIN bars b ON b.week = p.week AND b.n = p.n + 1))
SELECT cal_id, strftime(week, '%Y-%m-%d') AS week, c0, c1, cast(lane AS BIGINT) AS lane FROM placed
""", "week_bars")
def interval_lanes(spark, d):
    lanes = rk.interval_lanes(week_bars(spark, d), "week", "c0", "c1", ["start_date", "last_day", "title", "cal_id"], ["cal_id", "week", "c0", "c1"])
    return lanes.select("cal_id", F.col("week").cast("string").alias("week"), "c0", "c1", "lane")


@query("lane_count", """
SELECT strftime(week, '%Y-%m-%d') AS week, max(n) AS lanes FROM (SELECT week, day, count(*) AS n FROM (SELECT week, unnest(range(c0, c1 + 1)) AS day FROM week_bars) GROUP BY 1, 2) GROUP BY 1
""", "week_bars")
def lane_count(spark, d):
    """Lanes a week needs: the largest number of bars on one of its days."""
    days = week_bars(spark, d).select("week", F.explode(F.sequence("c0", "c1")).alias("day"))
    per_day = days.groupBy("week", "day").agg(F.count("*").alias("n"))
    return per_day.groupBy("week").agg(F.max("n").alias("lanes")).withColumn("week", F.col("week").cast("string"))


# ── top-k reports and orderings ──────────────────────────────────────────────────────────────
@query("latest_notices", """
SELECT board, notice_id, coalesce(strftime(published, '%Y-%m-%d'), '') AS published FROM notices QUALIFY row_number() OVER (PARTITION BY board ORDER BY notices.published DESC NULLS LAST, notice_id) <= 5
""", "notices")
def latest_notices(spark, d):
    latest = rk.top_per_key(inputs.notices(spark, d), ["board"], [F.desc_nulls_last("published"), F.col("notice_id")], 5)
    return latest.select("board", "notice_id", F.coalesce(F.col("published").cast("string"), F.lit("")).alias("published"))


TODAY = "1998-06-15"


@query("upcoming_events", f"""
SELECT cal_id, CASE WHEN left_days = 0 THEN 'D-day' WHEN left_days <= 7 THEN 'D-' || left_days ELSE '진행 중' END AS badge, strftime(end_date, '%Y-%m-%d') AS end_day
FROM (SELECT *, end_date - DATE '{TODAY}' AS left_days FROM calendar WHERE status = 'active' AND end_date >= DATE '{TODAY}' AND start_date <= DATE '{TODAY}' + 6)
ORDER BY end_date, title LIMIT {rules.UPCOMING_LIMIT}
""", "calendar")
def upcoming_events(spark, d):
    today = F.lit(TODAY).cast("date")
    left = F.datediff("end_date", today)
    badge = F.when(left == 0, "D-day").when(left <= rules.SOON_DAYS, F.concat(F.lit("D-"), left.cast("string"))).otherwise("진행 중")
    soon = F.col("start_date").isNull() | (F.col("start_date") <= F.date_add(today, rules.SOON_DAYS - 1))
    return (
        inputs.calendar(spark, d).where((F.col("status") == "active") & (F.col("end_date") >= today) & soon)
        .orderBy("end_date", "title").limit(rules.UPCOMING_LIMIT)
        .select("cal_id", badge.alias("badge"), F.col("end_date").cast("string").alias("end_day"))
    )


@query("month_events", """
SELECT cal_id, strftime(start_date, '%Y-%m-%d') AS start_day, strftime(end_date, '%Y-%m-%d') AS end_day FROM calendar
WHERE status = 'active' AND end_date >= DATE '1998-03-01' AND start_date <= DATE '1998-03-31' ORDER BY start_date, end_date, title
""", "calendar")
def month_events(spark, d):
    first, last = F.lit("1998-03-01").cast("date"), F.lit("1998-03-31").cast("date")
    rows = inputs.calendar(spark, d).where((F.col("status") == "active") & (F.col("end_date") >= first) & (F.coalesce("start_date", "end_date") <= last))
    return rows.orderBy("start_date", "end_date", "title").select(
        "cal_id", F.col("start_date").cast("string").alias("start_day"), F.col("end_date").cast("string").alias("end_day")
    )


@query("feed_window", f"""
SELECT min(cal_id) AS cal_id, strftime(start_date, '%Y-%m-%d') AS start_day, topic FROM calendar
WHERE status = 'active' AND end_date >= DATE '{TODAY}' - 30 AND start_date <= DATE '{TODAY}' + 365 GROUP BY start_date, topic ORDER BY start_date, topic
""", "calendar")
def feed_window(spark, d):
    today = F.lit(TODAY).cast("date")
    rows = inputs.calendar(spark, d).where(
        (F.col("status") == "active") & (F.col("end_date") >= F.date_sub(today, 30)) & (F.col("start_date") <= F.date_add(today, 365))
    )
    kept = rows.groupBy("start_date", "topic").agg(F.min("cal_id").alias("cal_id"))
    return kept.orderBy("start_date", "topic").select("cal_id", F.col("start_date").cast("string").alias("start_day"), "topic")


@query("status_priority_sort", """
SELECT tip_id, status, CASE status WHEN 'verifying' THEN 0 WHEN 'student_approved' THEN 1 WHEN 'approved' THEN 2 ELSE 9 END AS priority FROM tips ORDER BY priority, approved_at DESC, tip_id
""", "tips")
def status_priority_sort(spark, d):
    order = F.create_map(*[F.lit(x) for pair in (("verifying", 0), ("student_approved", 1), ("approved", 2)) for x in pair])
    priority = F.coalesce(F.try_element_at(order, F.col("status")), F.lit(9))
    return inputs.tips(spark, d).withColumn("priority", priority).orderBy("priority", F.desc("approved_at"), "tip_id").select("tip_id", "status", "priority")


@query("start_choices", """
SELECT s_name AS name, CASE WHEN s_name LIKE '%000' THEN 0 ELSE 1 END AS tier FROM supplier ORDER BY tier, name
""")
def start_choices(spark, d):
    tier = F.when(F.col("s_name").endswith("000"), 0).otherwise(1)
    return inputs.table(spark, d, "supplier").select(F.col("s_name").alias("name"), tier.alias("tier")).orderBy("tier", "name")


@query("eval_pick", """
SELECT item_id, source, first_day FROM (SELECT item_id, any_value(source) AS source, min(day) AS first_day FROM item_days GROUP BY 1) ORDER BY source <> 'seed', first_day, item_id LIMIT 150
""", "item_days")
def eval_pick(spark, d):
    items = inputs.item_days(spark, d).groupBy("item_id", "source").agg(F.min("day").alias("first_day"))
    return items.orderBy(F.col("source") != "seed", "first_day", "item_id").limit(rules.EVAL_MAX_ITEMS)


@query("keyset_page", """
SELECT notice_id, strftime(start_date, '%Y-%m-%d') AS day, rn <= 20 AS on_page FROM (SELECT *, row_number() OVER (ORDER BY start_date DESC, notice_id DESC) AS rn FROM notices WHERE (start_date, notice_id) < (DATE '2026-06-01', 5000)) WHERE rn <= 21
""", "notices")
def keyset_page(spark, d):
    """The page after a cursor, with one look-ahead row that tells whether another page follows."""
    day, key = F.lit("2026-06-01").cast("date"), F.lit(5000)
    after = (F.col("start_date") < day) | ((F.col("start_date") == day) & (F.col("notice_id") < key))
    page = inputs.notices(spark, d).where(after).orderBy(F.desc("start_date"), F.desc("notice_id")).limit(21)
    rank = F.row_number().over(Window.orderBy(F.desc("start_date"), F.desc("notice_id")))
    return page.select("notice_id", F.col("start_date").cast("string").alias("day"), (rank <= 20).alias("on_page"))


@query("scan_pending", """
SELECT n.notice_id FROM notices n LEFT JOIN (SELECT notice_id, CASE WHEN notice_id % 4 = 0 THEN 'retry' ELSE 'done' END AS status, cast(notice_id % 5 AS INTEGER) AS attempts FROM notices WHERE notice_id % 3 <> 0) s USING (notice_id)
WHERE s.status IS NULL OR (s.status = 'retry' AND s.attempts < 3)
""", "notices")
def scan_pending(spark, d):
    notices = inputs.notices(spark, d).select("notice_id")
    scans = notices.where("notice_id % 3 <> 0").select(
        "notice_id", F.when(F.col("notice_id") % 4 == 0, "retry").otherwise("done").alias("status"), (F.col("notice_id") % 5).alias("attempts")
    )
    pending = F.col("status").isNull() | ((F.col("status") == "retry") & (F.col("attempts") < rules.SCAN_MAX_ATTEMPTS))
    return notices.join(scans, "notice_id", "left").where(pending).select("notice_id")


@query("thread_sessions", """
SELECT thread_id, session::BIGINT AS session, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS ended_at, count(*) AS turns FROM (
  SELECT *, sum(s) OVER (PARTITION BY thread_id ORDER BY created_at, turn_id) AS session FROM (
   SELECT *, CASE WHEN lag(created_at) OVER (PARTITION BY thread_id ORDER BY created_at, turn_id) >= created_at - INTERVAL 24 HOUR THEN 0 ELSE 1 END AS s FROM turns)) GROUP BY 1, 2
""", "turns")
def thread_sessions(spark, d):
    sessions = rk.gap_sessions(inputs.turns(spark, d), "thread_id", "created_at")
    return sessions.select(
        "thread_id", "session", inputs.ts_text("started_at").alias("started_at"), inputs.ts_text("ended_at").alias("ended_at"), F.col("rows").alias("turns")
    )

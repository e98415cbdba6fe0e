"""Snapshots, upserts, diffs and collection state."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import snapshots as sn
from plumbline.operators import turn_stats as ts
from plumbline.plans import inputs
from plumbline.registry import query, sql_array, view
from plumbline.sources import files

# ── files ──────────────────────────────────────────────────────────────────────────────────────
DOC_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("department", T.StringType()), T.StructField("n", T.IntegerType())])


@query("jsonl_documents", """
SELECT 'r' || p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS department, p_size AS n FROM part
""")
def jsonl_documents(spark, d):
    """Documents written as JSON lines without nulls and read back with a fixed schema."""
    docs = inputs.table(spark, d, "part").select(
        F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("department"), F.col("p_size").alias("n")
    )
    return files.read_jsonl(spark, files.write_jsonl(docs), DOC_SCHEMA).withColumn("department", F.coalesce("department", F.lit("")))


@query("json_array_source", "SELECT p_partkey AS id, p_name AS name FROM part")
def json_array_source(spark, d):
    """Rows of JSON arrays; a root that is no array is an error."""
    part = inputs.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    chunks = part.groupBy(F.floor(F.col("id") / 100).alias("chunk")).agg(F.to_json(F.collect_list(F.struct("id", "name"))).alias("value"))
    return files.read_json_arrays(spark, files.write_text(chunks.select("value")), "id long, name string")


@query("csv_seed", "SELECT cast(c_custkey AS VARCHAR) AS place_id, c_name AS name, c_mktsegment AS kind FROM customer")
def csv_seed(spark, d):
    """CSV with padded keys and values, read back stripped."""
    rows = inputs.table(spark, d, "customer").select(
        F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias(" place_id"), F.concat("c_name", F.lit("  ")).alias("name "), F.col("c_mktsegment").alias("kind")
    )
    return files.read_csv(spark, files.write_csv(rows))


@query("manifest_snapshot", "SELECT p_partkey AS rule_no, p_brand AS file_version, '' AS etag FROM part ORDER BY 1")
def manifest_snapshot(spark, d):
    """Manifest rows conformed to their schema, unknown fields dropped, sorted by key."""
    schema = T.StructType([T.StructField("rule_no", T.LongType()), T.StructField("file_version", T.StringType()), T.StructField("etag", T.StringType())])
    rows = inputs.table(spark, d, "part").select(F.col("p_partkey").alias("rule_no"), F.col("p_brand").alias("file_version"), F.col("p_size").alias("unknown"))
    path = files.write_parquet(rows)
    return sn.conform(spark.read.parquet(path), schema).withColumn("etag", F.coalesce("etag", F.lit(""))).orderBy("rule_no")


# ── index state ───────────────────────────────────────────────────────────────────────────────
def index(spark, d):
    return inputs.sections(spark, d).select("section_id", F.md5("body").alias("hash"), "doc_id", "line_no")


@query("index_incremental", """
SELECT section_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM sections WHERE doc_id % 3 = 0 OR doc_id % 2 = 0
""", "sections")
def index_incremental(spark, d):
    rows = index(spark, d)
    old = rows.where("doc_id % 2 = 0").select("section_id", F.lit("old").alias("version"))
    new = rows.where("doc_id % 3 = 0").select("section_id", F.lit("new").alias("version"))
    return sn.upsert(old, new, "section_id")


@query("index_full_replace", """
SELECT count(*) FILTER (doc_id % 3 = 0) AS entries, count(*) FILTER (doc_id % 3 = 0 AND doc_id % 2 <> 0) AS added, count(*) FILTER (doc_id % 2 = 0 AND doc_id % 3 <> 0) AS removed FROM sections
""", "sections")
def index_full_replace(spark, d):
    """Counts of a full replacement: everything not in the new rows disappears."""
    rows = index(spark, d)
    old, new = rows.where("doc_id % 2 = 0").select("section_id", F.lit(1).alias("o")), rows.where("doc_id % 3 = 0").select("section_id", F.lit(1).alias("n"))
    n = lambda cond: F.count(F.when(cond, 1))
    return old.join(new, "section_id", "full_outer").agg(
        n(F.col("n").isNotNull()).alias("entries"), n(F.col("n").isNotNull() & F.col("o").isNull()).alias("added"), n(F.col("o").isNotNull() & F.col("n").isNull()).alias("removed")
    )


@query("index_delete", "SELECT section_id FROM sections WHERE line_no % 4 <> 1", "sections")
def index_delete(spark, d):
    rows = index(spark, d)
    ids = rows.where("line_no % 4 = 1").select("section_id").unionByName(spark.createDataFrame([("missing",)], "section_id string"))
    return sn.delete(rows, ids, "section_id")[0].select("section_id")


@query("index_deleted_count", "SELECT count(*) AS removed FROM sections WHERE line_no % 4 = 1", "sections")
def index_deleted_count(spark, d):
    rows = index(spark, d)
    ids = rows.where("line_no % 4 = 1").select("section_id").unionByName(spark.createDataFrame([("missing",)], "section_id string"))
    return sn.delete(rows, ids, "section_id")[1]


@query("audit_append", """
SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN 'delete' WHEN p_partkey % 13 = 0 THEN 'create' ELSE 'update' END AS action,
 CASE WHEN p_partkey % 13 = 0 AND p_partkey % 17 <> 0 THEN '' ELSE '{"p_size":' || p_size || ',"p_brand":"' || p_brand || '"}' END AS before, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE '{"p_size":' || CASE WHEN p_partkey % 10 = 0 THEN p_size + 1 ELSE p_size END || ',"p_brand":"' || p_brand || '"}' END AS after, 'admin' AS actor, 'review' AS reason
FROM part WHERE (p_partkey % 17 = 0 AND p_partkey % 13 <> 0) OR (p_partkey % 17 <> 0 AND (p_partkey % 13 = 0 OR p_partkey % 10 = 0))
""")
def audit_append(spark, d):
    part = inputs.table(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    before = part.where("p_partkey % 13 <> 0")
    after = part.where("p_partkey % 17 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 10 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return sn.audit_rows(before, after, "p_partkey", "admin", "review")


@query("changed_rules", """
SELECT p_partkey AS rule_no, CASE WHEN p_partkey % 17 = 0 THEN 'added' ELSE 'changed' END AS change FROM part WHERE p_partkey % 17 = 0 OR p_partkey % 10 = 0
""")
def changed_rules(spark, d):
    part = inputs.table(spark, d, "part").select(F.col("p_partkey").alias("rule_no"), F.col("p_size").alias("file_version"))
    manifest = part.where("rule_no % 17 <> 0").withColumn("file_version", F.when(F.col("rule_no") % 10 == 0, F.col("file_version") + 1).otherwise(F.col("file_version")))
    return sn.changed_rules(part, manifest).select("rule_no", "change")


@query("source_changed", """
SELECT p_partkey AS rule_no, p_partkey % 17 = 0 OR p_partkey % 10 = 0 OR p_partkey % 7 = 0 AS changed FROM part
""")
def source_changed(spark, d):
    k = F.col("rule_no")
    part = inputs.table(spark, d, "part").select(F.col("p_partkey").alias("rule_no"), F.col("p_size").alias("file_version"), F.when(F.col("p_partkey") % 3 != 0, F.md5("p_name")).alias("content_hash"))
    before = part.where("rule_no % 17 <> 0").withColumns({
        "file_version": F.when(k % 10 == 0, F.col("file_version") + 1).otherwise(F.col("file_version")), "content_hash": F.when(k % 7 == 0, F.lit("x")).otherwise(F.col("content_hash")),
    })
    return sn.source_changed(part, before)


@query("report_table", """
SELECT outcome, n, average, failed FROM (SELECT outcome, count(*) AS n, round_even(sum(elapsed_ms)::DOUBLE / count(*), 1) AS average, count(*) FILTER (fallback_reason = 'deadline') AS failed FROM turns GROUP BY outcome)
""", "turns")
def report_table(spark, d):
    """Metrics written as a JSON report and read back."""
    turns = inputs.turns(spark, d)
    metrics = ts.latency_stats(turns, ["outcome"]).select("outcome", "n", "average")
    failed = turns.groupBy("outcome").agg(F.count(F.when(F.col("fallback_reason") == "deadline", 1)).alias("failed"))
    report = metrics.join(failed, "outcome")
    return files.read_jsonl(spark, files.write_jsonl(report), report.schema)


@query("ics_feed", r"""
SELECT 'e' || cal_id AS id, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:e' || cal_id || '@campus.example' || chr(13) || chr(10) || 'DTSTAMP:20260101T000000Z' || chr(13) || chr(10) || 'DTSTART;VALUE=DATE:' || strftime(start_date, '%Y%m%d') || chr(13) || chr(10) || 'DTEND;VALUE=DATE:' || strftime(end_date + 1, '%Y%m%d') || chr(13) || chr(10)
 || 'SUMMARY:' || topic || '\; 기간\, ' || cal_id || chr(13) || chr(10) || 'DESCRIPTION:학교 원문: https://www.campus.example/' || cal_id || chr(13) || chr(10) || 'URL:https://www.campus.example/' || cal_id || chr(13) || chr(10) || 'END:VEVENT' AS vevent FROM calendar WHERE status = 'active' ORDER BY start_date
""", "calendar")
def ics_feed(spark, d):
    k = F.col("cal_id").cast("string")
    events = inputs.calendar(spark, d).where("status = 'active'").select(
        F.concat(F.lit("e"), k).alias("id"), "start_date", "end_date", F.concat("topic", F.lit("; 기간, "), k).alias("title"), F.concat(F.lit("https://www.campus.example/"), k).alias("url")
    )
    return sn.ics_lines(events, "20260101T000000Z", "campus.example").orderBy("start_date").drop("start_date")


# ── collected events ──────────────────────────────────────────────────────────────────────────
def stored_events(spark, d):
    n = F.col("notice_id")
    return inputs.notices(spark, d).select(
        n.alias("id"), "title", "start_date", "end_date", inputs.pick(("active", "pending", "hidden", "active"), n % 4).alias("status"), F.when(n % 6 == 0, "admin").otherwise("").alias("reviewed_by"),
        F.when(n % 5 == 0, "calendar").otherwise("notice").alias("source_type"), F.concat(F.lit("u"), (n / 3).cast("long").cast("string")).alias("source_url"), F.col("start_date").alias("seen_at"),
    )


view("stored_events", """
SELECT notice_id AS id, title, start_date, end_date, ['active', 'pending', 'hidden', 'active'][notice_id % 4 + 1] AS status, CASE WHEN notice_id % 6 = 0 THEN 'admin' ELSE '' END AS reviewed_by, CASE WHEN notice_id % 5 = 0 THEN 'calendar' ELSE 'notice' END AS source_type, 'u' || (notice_id // 3) AS source_url, start_date AS seen_at FROM notices
""", ("notices",))


@query("event_upsert", """
SELECT id, CASE WHEN id % 3 = 0 AND (id % 6 <> 0 OR id % 7 = 0) THEN substr(title || ' 정정', 1, 120) ELSE title END AS title, CASE WHEN id % 7 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN id % 7 = 0 THEN '' ELSE reviewed_by END AS reviewed_by, id % 3 = 0 AS touched FROM stored_events WHERE id % 7 <> 0 OR id % 3 = 0
""", "stored_events")
def event_upsert(spark, d):
    events = stored_events(spark, d)
    seen = events.where("id % 3 = 0").select("id", F.concat("title", F.lit(" 정정")).alias("title"), F.lit("pending").alias("status"))
    out = sn.event_upsert(events.where("id % 7 <> 0"), seen, F.lit("2026-06-01").cast("timestamp"))
    return out.select("id", "title", "status", "reviewed_by", F.col("updated_at").isNotNull().alias("touched"))


@query("supersede_same_source", """
SELECT id, CASE WHEN source_type <> 'calendar' AND reviewed_by = '' AND status IN ('active', 'pending') AND id <> last_value(CASE WHEN source_type <> 'calendar' THEN id END IGNORE NULLS) OVER (PARTITION BY source_url ORDER BY seen_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) THEN 'superseded' ELSE status END AS status FROM stored_events
""", "stored_events")
def supersede_same_source(spark, d):
    return sn.supersede_same_source(stored_events(spark, d)).select("id", "status")


@query("reconcile_missing", """
SELECT id, CASE WHEN source_type = 'calendar' AND id % 2 <> 0 AND reviewed_by = '' AND status IN ('active', 'pending') AND end_date >= DATE '2026-06-01' AND start_date <= DATE '2026-06-01' + 90 THEN 'superseded' ELSE status END AS status FROM stored_events
""", "stored_events")
def reconcile_missing(spark, d):
    events = stored_events(spark, d)
    return sn.reconcile_missing(events, events.where("id % 2 = 0").select("id"), F.lit("2026-06-01").cast("date")).select("id", "status")


@query("scan_once", """
SELECT scan_id, CASE WHEN bool_or(ok) THEN 'done' ELSE 'retry' END AS status, count(*) FILTER (NOT ok) AS failed FROM (
 SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY tried) AS n, coalesce(bool_or(ok) OVER (PARTITION BY scan_id ORDER BY tried ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM (SELECT user_id * 100 + cast(json_extract_string(props, '$.k') AS INTEGER) AS scan_id, event_id AS tried, event_type = 'view' AS ok FROM events)) WHERE NOT seen AND n <= 3 GROUP BY 1
""")
def scan_once(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    attempts = inputs.table(spark, d, "events").select((F.col("user_id") * 100 + k).alias("scan_id"), F.col("event_id").alias("at"), (F.col("event_type") == "view").alias("ok"))
    return sn.scan_once(attempts)


@query("index_cycle", """
SELECT id, CASE WHEN indexed AND (status IN ('hidden', 'superseded') OR expired) THEN 'removed' WHEN p AND id % 3 = 0 THEN 'indexed' WHEN p AND id % 3 = 1 THEN 'failed' ELSE 'kept' END AS action,
 CASE WHEN indexed AND (status IN ('hidden', 'superseded') OR expired) THEN false ELSE indexed OR (p AND id % 3 = 0) END AS indexed, attempts + CASE WHEN p AND id % 3 = 1 THEN 1 ELSE 0 END AS attempts
FROM (SELECT *, id IN (SELECT id FROM (SELECT id, status, source_type, id % 4 = 1 AS indexed, id % 5 AS attempts, end_date < DATE '2024-01-01' AS expired FROM stored_events) WHERE status = 'active' AND source_type <> 'calendar' AND NOT indexed AND attempts < 3 AND NOT expired ORDER BY id LIMIT 10) AS p
 FROM (SELECT id, status, source_type, id % 4 = 1 AS indexed, cast(id % 5 AS INTEGER) AS attempts, end_date < DATE '2024-01-01' AS expired FROM stored_events))
""", "stored_events")
def index_cycle(spark, d):
    k = F.col("id")
    events = stored_events(spark, d).select("id", "status", "source_type", (k % 4 == 1).alias("indexed"), (k % 5).cast("int").alias("attempts"), (F.col("end_date") < F.lit("2024-01-01").cast("date")).alias("expired"))
    reads = events.select("id", (k % 3 != 1).alias("has_text"), (k % 3 == 0).alias("imported"))
    return sn.index_cycle(events, reads)


@query("menu_refresh", """
SELECT cafeteria, week, day, CASE WHEN nr >= orr AND nm IS NOT NULL THEN nm ELSE om END AS method, CASE WHEN nr >= orr AND nm IS NOT NULL THEN 'new' ELSE 'old' END AS content, CASE WHEN again AND nm IS NULL THEN 'unavailable' ELSE 'available' END AS status FROM (
 SELECT *, CASE om WHEN 'layout' THEN 3 WHEN 'ocr' THEN 2 WHEN 'nearest' THEN 1 ELSE 0 END AS orr, CASE nm WHEN 'layout' THEN 3 WHEN 'ocr' THEN 2 WHEN 'nearest' THEN 1 ELSE 0 END AS nr FROM (
 SELECT *, CASE WHEN day % 5 <> 4 THEN ['layout', 'ocr', 'nearest'][day % 3 + 1] END AS om, CASE WHEN again AND day % 4 <> 3 THEN ['nearest', 'layout', 'ocr'][day % 3 + 1] END AS nm FROM (
  SELECT *, dense_rank() OVER (PARTITION BY cafeteria ORDER BY week DESC) <= 2 OR week % 7 = 0 AS again FROM (SELECT DISTINCT l_returnflag AS cafeteria, cast(date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) AS INTEGER) // 7 AS week, cast(date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) AS INTEGER) AS day FROM lineitem)))) WHERE om IS NOT NULL OR nm IS NOT NULL
""")
def menu_refresh(spark, d):
    day = F.datediff("l_shipdate", F.lit("1992-01-01"))
    days = inputs.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("cafeteria"), F.floor(day / 7).cast("int").alias("week"), day.alias("day")).distinct()
    weeks = days.select("cafeteria", "week", (F.col("week") % 7 == 0).alias("failed")).distinct()
    n = F.col("day")
    stored = days.where(n % 5 != 4).select("*", inputs.pick(("layout", "ocr", "nearest"), n % 3).alias("method"), F.lit("old").alias("content"))
    read = days.where(n % 4 != 3).select("*", inputs.pick(("nearest", "layout", "ocr"), n % 3).alias("method"), F.lit("new").alias("content"))
    return sn.menu_refresh(weeks, stored, read)


@query("turn_dedup", """
SELECT thread_id, request_id, count(*) FILTER (done_at IS NULL OR turn_id <= done_at) AS attempts, count(*) FILTER (done_at IS NOT NULL AND turn_id > done_at) AS replays, bool_or(done) AS completed FROM (
 SELECT *, min(CASE WHEN done THEN turn_id END) OVER (PARTITION BY thread_id, request_id) AS done_at FROM (SELECT thread_id, turn_id, k % 20 AS request_id, outcome = 'answer' AS done FROM turns)) GROUP BY 1, 2
""", "turns")
def turn_dedup(spark, d):
    requests = inputs.turns(spark, d).select("thread_id", (F.col("k") % 20).alias("request_id"), F.col("turn_id").alias("at"), (F.col("outcome") == "answer").alias("done"))
    return sn.turn_attempts(requests)


_SOURCES = tuple(sn.RESULT_MINUTES)


@query("result_cache_ttl", f"""
SELECT source, strftime(loaded, '%Y-%m-%d %H:%M:%S') AS loaded_at, TIMESTAMP '2024-01-30 23:58:00' - loaded < to_minutes(CASE source {' '.join(f"WHEN '{k}' THEN {v}" for k, v in sn.RESULT_MINUTES.items())} END) AS fresh FROM (SELECT {sql_array(_SOURCES)}[user_id % 5 + 1] AS source, max(ts) AS loaded FROM events WHERE event_type <> 'error' GROUP BY 1)
""")
def result_cache_ttl(spark, d):
    loads = inputs.table(spark, d, "events").select(inputs.pick(_SOURCES, F.col("user_id") % 5).alias("source"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return sn.fresh_results(loads, F.lit("2024-01-30 23:58:00").cast("timestamp_ntz")).withColumn("loaded_at", inputs.ts_text("loaded_at"))


@query("ingestion_overlap", """
SELECT r.event_id AS run_id, arg_max(b.event_id, (b.up, b.event_id)) AS blocker FROM events r JOIN (SELECT event_id, ts + INTERVAL 10 MINUTE AS up FROM events WHERE event_type IN ('signup', 'error')) b ON b.up <= r.ts AND r.ts - b.up < INTERVAL 2 HOUR AND b.event_id <> r.event_id GROUP BY 1
""")
def ingestion_overlap(spark, d):
    status = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "error", "running").otherwise("done")
    runs = inputs.table(spark, d, "events").select(F.col("event_id").alias("run_id"), status.alias("status"), F.col("ts").alias("started_at"), (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("updated_at"))
    return sn.overlapping_runs(runs)


@query("late_data", """
SELECT CASE WHEN published IS NULL THEN 'undated_kept' WHEN published < DATE '2027-06-01' - 90 THEN 'late_dropped' ELSE 'in_time' END AS decision, count(*) AS n FROM notices GROUP BY 1
UNION ALL SELECT CASE WHEN token = tip_id * 7 % 150 THEN 'vote_by_author' WHEN ts < cast(DATE '2024-01-01' + cast(tip_id % 5 AS INTEGER) AS TIMESTAMP) THEN 'vote_not_public' ELSE 'vote_taken' END, count(*) FROM votes GROUP BY 1
""", ("notices", "votes"))
def late_data(spark, d):
    """What becomes of late rows: notices by the look-back, votes by author and publication."""
    cut = F.date_sub(F.lit("2027-06-01").cast("date"), 90)
    notice = F.when(F.col("published").isNull(), "undated_kept").when(F.col("published") < cut, "late_dropped").otherwise("in_time")
    public = F.date_add(F.lit("2024-01-01").cast("date"), F.col("tip_id") % 5).cast("timestamp")
    vote = F.when(F.col("token") == F.col("tip_id") * 7 % 150, "vote_by_author").when(F.col("ts") < public, "vote_not_public").otherwise("vote_taken")
    count = lambda df, label: df.groupBy(label.alias("decision")).agg(F.count("*").alias("n"))
    return count(inputs.notices(spark, d), notice).unionByName(count(inputs.votes(spark, d), vote))

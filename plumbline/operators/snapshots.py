"""Keyed snapshots: upserts, replacements, deletions, diffs and collection state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from plumbline.functions import rules
from plumbline.operators.lookup import asof_join
from plumbline.operators.ranking import carried, top_per_key

# fixed values: collection windows, tries and lifetimes of loaded results in minutes
CALENDAR_DAYS, READ_PER_RUN, RUN_BLOCK_HOURS, REFRESH_WEEKS = 90, 10, 2, 2
METHOD_RANK = {"layout": 3, "ocr": 2, "nearest": 1}
RESULT_MINUTES = {"notices": 30, "calendar": 1440, "menus": 360, "places": 5, "tips": 1}


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of a schema: unknown ones dropped, missing ones NULL, types cast."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows over old ones by key; keys not in the new rows stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete(old: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows left after deleting ids (missing ones are no error) and the count removed."""
    return old.join(ids, key, "left_anti"), old.join(ids, key, "left_semi").agg(F.count("*").alias("removed"))


def audit_rows(before: DataFrame, after: DataFrame, key: str, actor: str, reason: str) -> DataFrame:
    """One row per changed, added or removed key with both versions as JSON."""
    pack = lambda df: df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("v"))
    old, new = pack(before).withColumnRenamed("v", "before"), pack(after).withColumnRenamed("v", "after")
    changed = old.join(new, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    action = F.when(F.col("before").isNull(), "create").when(F.col("after").isNull(), "delete").otherwise("update")
    return changed.select(key, action.alias("action"), F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), F.lit(actor).alias("actor"), F.lit(reason).alias("reason"))


def changed_rules(registry: DataFrame, manifest: DataFrame) -> DataFrame:
    """Registry rows that are new or whose file version differs from the manifest's."""
    old = manifest.select("rule_no", F.col("file_version").alias("_old"))
    rows = registry.join(old, "rule_no", "left").where(~F.col("file_version").eqNullSafe(F.col("_old")))
    return rows.withColumn("change", F.when(F.col("_old").isNull(), "added").otherwise("changed")).drop("_old")


def source_changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Whether version or content hash differs from the previous ones, or there are none."""
    old = before.select("rule_no", F.col("file_version").alias("_v"), F.col("content_hash").alias("_h"), F.lit(True).alias("_known"))
    rows = now.join(old, "rule_no", "left")
    same = F.col("_known").isNotNull() & F.col("file_version").eqNullSafe(F.col("_v")) & F.col("content_hash").eqNullSafe(F.col("_h"))
    return rows.select("rule_no", (~same).alias("changed"))


def event_upsert(current: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """Collected events over stored ones: a new row takes its computed status, a stored one keeps its
    own, and a reviewed row only notes the time."""
    c = F.col
    old = current.select("id", *[c(x).alias("o_" + x) for x in ("title", "status", "reviewed_by")], F.lit(True).alias("_old"))
    new = seen.select("id", *[c(x).alias("n_" + x) for x in ("title", "status")], F.lit(True).alias("_new"))
    rows = old.join(new, "id", "full_outer")
    reviewed = F.coalesce("o_reviewed_by", F.lit("")) != ""
    touched = c("_new").isNotNull()
    title = F.when(touched & ~reviewed, F.left("n_title", F.lit(120))).otherwise(c("o_title"))
    return rows.select(
        "id", title.alias("title"), F.coalesce("o_status", "n_status").alias("status"), F.coalesce("o_reviewed_by", F.lit("")).alias("reviewed_by"),
        F.when(touched, now).alias("updated_at"),
    )


def automatic() -> Column:
    return (F.coalesce("reviewed_by", F.lit("")) == "") & F.col("status").isin("active", "pending")


def supersede_same_source(events: DataFrame) -> DataFrame:
    """Older automatic rows of an address give way to its latest row; calendar rows are kept."""
    latest = events.where("source_type <> 'calendar'").groupBy("source_url").agg(F.max_by("id", F.struct("seen_at", "id")).alias("_latest"))
    rows = events.join(latest, "source_url", "left")
    gone = (F.col("source_type") != "calendar") & (F.col("id") != F.col("_latest")) & automatic()
    return rows.withColumn("status", F.when(F.coalesce(gone, F.lit(False)), "superseded").otherwise(F.col("status"))).drop("_latest")


def reconcile_missing(events: DataFrame, seen: DataFrame, today: Column) -> DataFrame:
    """Automatic calendar rows this run did not see, inside today to +90 days, are superseded.

    A run that saw nothing changes nothing.
    """
    rows = events.join(seen.select("id").distinct().withColumn("_seen", F.lit(True)), "id", "left")
    inside = (F.col("end_date") >= today) & (F.coalesce("start_date", "end_date") <= F.date_add(today, CALENDAR_DAYS))
    gone = (F.col("source_type") == "calendar") & F.col("_seen").isNull() & automatic() & inside
    applies = F.lit(not seen.isEmpty())
    return rows.withColumn("status", F.when(applies & F.coalesce(gone, F.lit(False)), "superseded").otherwise(F.col("status"))).drop("_seen")


def scan_once(attempts: DataFrame) -> DataFrame:
    """State of every scan id after its attempts (scan_id, at, ok): done at the first success, else retried
    three times; later attempts are not made."""
    ok_at = F.min(F.when(F.col("ok"), F.col("at")))
    rows = attempts.groupBy("scan_id").agg(ok_at.alias("_ok"), F.count("*").alias("_n"))
    before = attempts.join(rows, "scan_id").where(F.col("_ok").isNull() | (F.col("at") <= F.col("_ok")))
    made = top_per_key(before, ["scan_id"], [F.col("at")], rules.SCAN_MAX_ATTEMPTS)
    return made.groupBy("scan_id").agg(
        F.count(F.when(~F.col("ok"), 1)).alias("failed"), F.bool_or("ok").alias("_done")
    ).select("scan_id", F.when(F.col("_done"), "done").otherwise("retry").alias("status"), "failed")


def index_cycle(events: DataFrame, reads: DataFrame) -> DataFrame:
    """One collection run over notices (id, status, source_type, expired, attempts, indexed).

    The first ten unread active notices are read; text makes them indexed, a failed read only counts;
    hidden, superseded or expired ones lose their place in the index.
    """
    c = F.col
    waiting = (c("status") == "active") & (c("source_type") != "calendar") & ~c("indexed") & (c("attempts") < rules.SCAN_MAX_ATTEMPTS) & ~c("expired")
    picked = events.where(waiting).orderBy("id").limit(READ_PER_RUN).select("id", F.lit(True).alias("_read"))
    rows = events.join(picked, "id", "left").join(reads, "id", "left")
    gone = c("indexed") & (c("status").isin("hidden", "superseded") | c("expired"))
    good = c("_read").isNotNull() & F.coalesce("has_text", F.lit(False)) & F.coalesce("imported", F.lit(False))
    bad = c("_read").isNotNull() & ~F.coalesce("has_text", F.lit(False))
    action = F.when(gone, "removed").when(good, "indexed").when(bad, "failed").otherwise("kept")
    return rows.select(
        "id", action.alias("action"), F.when(gone, False).otherwise(c("indexed") | good).alias("indexed"), (c("attempts") + bad.cast("int")).alias("attempts")
    )


def turn_attempts(requests: DataFrame) -> DataFrame:
    """Requests (thread_id, request_id, at, done) processed once: attempts until the first completion,
    replays after it."""
    key = ["thread_id", "request_id"]
    first = requests.groupBy(*key).agg(F.min(F.when(F.col("done"), F.col("at"))).alias("_done"))
    rows = requests.join(first, key)
    replay = F.col("_done").isNotNull() & (F.col("at") > F.col("_done"))
    return rows.groupBy(*key).agg(
        F.count(F.when(~replay, 1)).alias("attempts"), F.count(F.when(replay, 1)).alias("replays"), F.bool_or("done").alias("completed")
    )


def fresh_results(loads: DataFrame, now: Column) -> DataFrame:
    """Latest good load of every source and whether it is still fresh; failures never count."""
    minutes = F.coalesce(*[F.when(F.col("source") == k, F.lit(v)) for k, v in RESULT_MINUTES.items()])
    latest = loads.where("ok").groupBy("source").agg(F.max("at").alias("loaded_at"))
    return latest.select("source", "loaded_at", (now - F.col("loaded_at") < F.make_dt_interval(mins=minutes)).alias("fresh"))


def overlapping_runs(runs: DataFrame) -> DataFrame:
    """Runs blocked by another that was queued or running and updated less than two hours before.

    Only the latest such run is told, or the one before it where the latest is the run itself.  So every moment of an
    update keeps two runs, its own or one of the moment before, and every moment of a start looks up the last update; no run
    meets the others, however many fall into two hours.
    """
    c = F.col
    live = runs.where(c("status").isin("queued", "running")).select(c("updated_at").alias("at"), c("run_id").alias("id"))
    # the two largest ids of a moment by two maxima, so that a moment with many runs stays small
    first = live.groupBy("at").agg(F.max("id").alias("id"))
    second = live.join(first.withColumnRenamed("id", "_first"), "at").where(c("id") != c("_first")).groupBy("at").agg(F.max("id").alias("_second"))
    marks = first.join(second, "at", "left").select("at", F.unix_micros(c("at").cast("timestamp")).alias("us"), "id", F.struct("at", "id").alias("last"), "_second")
    marks = carried(marks, [], "us", ["last"], block=3_600_000_000)
    before = F.when(c("_second").isNotNull(), F.struct("at", c("_second").alias("id"))).otherwise(c("before_last"))
    marks = marks.select(F.lit(0).alias("_all"), c("at").alias("_when"), F.struct(c("last"), before.alias("before")).alias("pair"))
    asked = runs.select(F.lit(0).alias("_all"), c("started_at").alias("_when")).distinct()
    found = asof_join(asked, marks, "_all", "_when", "hour", c("pair")).where("latest is not null").select(c("_when").alias("started_at"), "latest")
    rows = runs.select("run_id", "started_at").join(found, "started_at")
    best = F.when(c("latest.last.id") != c("run_id"), c("latest.last")).otherwise(c("latest.before"))
    rows = rows.select("run_id", "started_at", best.alias("b")).where(c("started_at") - c("b.at") < F.expr(f"INTERVAL {RUN_BLOCK_HOURS} HOURS"))
    return rows.groupBy("run_id").agg(F.max("b").alias("b")).select("run_id", c("b.id").alias("blocker"))


def menu_refresh(weeks: DataFrame, stored: DataFrame, read: DataFrame) -> DataFrame:
    """Menu days after a run: the newest two weeks and failed older ones are read again.

    A better reading is never replaced by a worse one, and a day missing from a week that was read
    again becomes unavailable.  `weeks` holds cafeteria, week, failed; days hold cafeteria, week, day,
    method, content.
    """
    c = F.col
    place = F.dense_rank().over(Window.partitionBy("cafeteria").orderBy(F.desc("week")))
    again = weeks.withColumn("_p", place).where((c("_p") <= REFRESH_WEEKS) | c("failed")).select("cafeteria", "week", F.lit(True).alias("_again"))
    method = lambda x: F.coalesce(*[F.when(c(x) == k, F.lit(v)) for k, v in METHOD_RANK.items()], F.lit(0))
    keys = ["cafeteria", "week", "day"]
    new = read.join(again.drop("_again"), ["cafeteria", "week"], "left_semi").select(*keys, c("method").alias("n_method"), c("content").alias("n_content"))
    rows = stored.select(*keys, c("method").alias("o_method"), c("content").alias("o_content")).join(new, keys, "full_outer").join(again, ["cafeteria", "week"], "left")
    better = c("n_method").isNotNull() & (method("n_method") >= method("o_method"))
    missing = c("_again").isNotNull() & c("n_method").isNull()
    return rows.select(
        *keys, F.when(better, c("n_method")).otherwise(c("o_method")).alias("method"), F.when(better, c("n_content")).otherwise(c("o_content")).alias("content"),
        F.when(missing, "unavailable").otherwise("available").alias("status"),
    )


def ics_lines(events: DataFrame, stamp: str, domain: str) -> DataFrame:
    """VEVENT text per event: all-day, exclusive end, escaped text, CRLF between lines."""
    esc = lambda t: F.regexp_replace(F.replace(F.regexp_replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), "([;,])", r"\\$1"), F.lit("\r"), F.lit("")), "\n", r"\\n")
    day = lambda x: F.date_format(x, "yyyyMMdd")
    lines = F.array(
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("id"), F.lit("@" + domain)), F.lit("DTSTAMP:" + stamp),
        F.concat(F.lit("DTSTART;VALUE=DATE:"), day("start_date")), F.concat(F.lit("DTEND;VALUE=DATE:"), day(F.date_add("end_date", 1))),
        F.concat(F.lit("SUMMARY:"), esc(F.col("title"))), F.concat(F.lit("DESCRIPTION:"), esc(F.concat(F.lit("학교 원문: "), F.col("url")))),
        F.when(F.col("url") != "", F.concat(F.lit("URL:"), F.col("url"))), F.lit("END:VEVENT"),
    )
    return events.select("id", "start_date", F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\r\n").alias("vevent"))

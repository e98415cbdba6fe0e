"""Review states: transitions, fixes, sessions' rules, external verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import rules
from plumbline.functions.text import contains_any
from plumbline.operators.filters import follow_up_allowed, follow_up_key
from plumbline.operators.ranking import top_per_key

# fixed values: states of reports, documents and places
CLOSED = ("resolved", "rejected", "no_issue")
TRANSITIONS = (
    ("publish", ("staging",), "publishing", False),
    ("reject", ("staging",), "rejected", False),
    ("archive", ("published",), "archived", True),
    ("purge", ("staging", "rejected", "publishing", "published", "archived"), "purging", True),
)
ALLOWED_CALLS = (
    "search_academic_knowledge", "get_notices", "get_academic_calendar", "get_menu", "find_campus_location", "find_campus_tips",
)
SNIPPET, CITED_TEXT, DELEGATED_SHOWN, PREVIEW, CALL_TEXT = 120, 1500, 3, 300, 100
FAQ_MAX, FAQ_MONTH = 200, 12


def next_step(status: Column, fix_type: Column, fix_status: Column, place_id: Column) -> Column:
    """analyze, verify, needs_approval or skip for a report, by its own and its fix's state."""
    linked = fix_type.isin("unanswered", "quality") & fix_status.isin("linked", "recheck_failed")
    applied = (fix_type == "place") & fix_status.isin("applied", "recheck_failed") & (F.coalesce(place_id, F.lit("")) != "")
    read_again = fix_type.isin("recollect", "register") & (fix_status == "recollecting")
    return (
        F.when(status.isin(*CLOSED), "skip")
        .when(fix_type.isNull(), "analyze")
        .when(F.coalesce(linked | applied | read_again, F.lit(False)), "verify")
        .when(fix_status == "proposed", "needs_approval")
        .otherwise("skip")
    )


def document_transition(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Requests (document_id, action, request_id, confirm) against document states.

    Gives the new status or '', whether the request was already done, the deny flag and the refusal.
    """
    table = requests.sparkSession.createDataFrame(
        [(a, list(f), t, deny) for a, f, t, deny in TRANSITIONS], "action string, from_status array<string>, to_status string, deny boolean"
    )
    c = F.col
    rows = requests.join(documents, "document_id", "left").join(table, "action", "left")
    done = (c("status") == c("to_status")) & (c("last_request_id") == c("request_id"))
    refusal = (
        F.when(c("to_status").isNull(), "unknown_action")
        .when(F.coalesce(done, F.lit(False)), "")
        .when(~F.coalesce(F.array_contains(c("from_status"), c("status")), F.lit(False)), "wrong_status")
        .when((c("action") == "publish") & (F.coalesce("preview_status", F.lit("")) != "ready"), "preview_not_ready")
        .when((c("action") == "publish") & (F.trim(F.coalesce("approval_basis", F.lit(""))) == ""), "no_approval_basis")
        .when((c("action") == "purge") & ~F.coalesce(c("confirm") == c("document_id").cast("string"), F.lit(False)), "not_confirmed")
        .otherwise("")
    )
    rows = rows.withColumn("refusal", refusal)
    ok = c("refusal") == ""
    return rows.select(
        "document_id", "action", F.when(ok, c("to_status")).otherwise("").alias("new_status"), F.coalesce(done, F.lit(False)).alias("replayed"),
        (ok & F.coalesce("deny", F.lit(False))).alias("deny"), "refusal",
    )


def place_review(changes: DataFrame, current: DataFrame) -> DataFrame:
    """Status a place gets from a change: new rows wait, verified needs source, date and a location or
    a unit's phone, and a moved verified place is checked again."""
    c = F.col
    rows = changes.join(current.select("place_id", *[c(x).alias("old_" + x) for x in ("status", "raw_location", "phone", "source_url", "snapshot_at", "kind")]), "place_id", "left")
    now = lambda name: F.coalesce(c(name), c("old_" + name))
    filled = lambda name: F.coalesce(now(name), F.lit("")) != ""
    is_new = c("old_status").isNull()
    moved = c("raw_location").isNotNull() & ~c("raw_location").eqNullSafe(c("old_raw_location"))
    complete = filled("source_url") & filled("snapshot_at") & (filled("raw_location") | ((now("kind") == "unit") & filled("phone")))
    refused = F.when(c("requested") == "verified", F.when(is_new, "new_place").when(~complete, "incomplete"))
    status = (
        F.when(refused.isNotNull(), F.coalesce("old_status", F.lit("")))
        .when(is_new, "pending").when(c("requested") == "verified", "verified")
        .when((c("requested") == "pending") | (moved & (c("old_status") == "verified")), "pending").otherwise(c("old_status"))
    )
    return rows.select("place_id", F.coalesce(refused, F.lit("")).alias("refusal"), status.alias("status"))


def undo_state(changes: DataFrame, current: DataFrame) -> DataFrame:
    """Previous status restored by the latest change of a report, refused when it moved on since."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("after", "before"), "at").alias("u"))
    rows = current.join(last, "id")
    ok = F.col("u.after") == F.col("status")
    return rows.select("id", F.when(ok, F.col("u.before")).otherwise(F.col("status")).alias("status"), ok.alias("undone"))


def confusable_block(corrections: DataFrame, pairs: DataFrame) -> DataFrame:
    """Corrections between protected terms, or that change digits, are refused."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("_p", F.lit(True))
    rows = corrections.join(both, (F.col("wrong") == F.col("a")) & (F.col("right") == F.col("b")), "left")
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    return rows.withColumn("blocked", F.col("_p").isNotNull() | (digits("wrong") != digits("right"))).drop("a", "b", "_p")


def missing_slots(topic: Column, query: Column, intent: Column, filled: Column) -> Column:
    """Conditions a procedure question still needs: graduation depends on the department."""
    hay = F.concat_ws(" ", F.coalesce(topic, F.lit("")), query)
    asks = hay.contains("졸업") & (intent.isNull() | (intent == "procedure"))
    return F.when(asks, F.array_except(F.array(F.lit("dept")), filled)).otherwise(F.array().cast("array<string>"))


def profile_merge(updates: DataFrame, key: str, order: Column, fields: list[str]) -> DataFrame:
    """Latest stated value of every profile field."""
    return updates.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields])


def outcome_route(rows: DataFrame) -> DataFrame:
    """Outcome and fallback reason of a turn from the results of its stages."""
    c = F.col
    ask = (c("missing") > 0) & (c("asked_before") == 0)
    reason = (
        F.when(c("intent") == rules.OUT_OF_SCOPE, rules.OUT_OF_SCOPE)
        .when(c("late"), "deadline")
        .when(c("evidence") == 0, F.when(c("failures") > 0, "tool_failure").otherwise("no_evidence"))
        .when(c("kept") == 0, "verification_failed")
    )
    outcome = F.when(c("failed"), "error").when(c("intent") == rules.OUT_OF_SCOPE, "fallback").when(ask, "ask").when(reason.isNotNull(), "fallback").otherwise("answer")
    return rows.withColumn("outcome", outcome).withColumn("reason", F.when(c("outcome") == "fallback", reason).otherwise(""))


Topics = tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]


def follow_up_pick(proposals: DataFrame, asked: DataFrame, turns: DataFrame, failed: DataFrame, topics: Topics) -> DataFrame:
    """Three follow-ups per turn: allowed proposals first, then the topic's defaults when fewer than two.

    `proposals` holds turn_id, pos, question; `asked` thread_id and question; `failed` questions known
    not to be answered; `topics` the words of each topic with its default questions, the first topic that fits counts.
    """
    c = F.col
    seen = asked.select("thread_id", follow_up_key(c("question")).alias("key")).distinct()

    def allowed(df: DataFrame) -> DataFrame:
        clean = df.withColumn("question", F.trim(F.regexp_replace("question", r"(?U)\s+", " "))).where(follow_up_allowed(c("question")))
        fresh = clean.withColumn("key", follow_up_key(c("question"))).join(seen, ["thread_id", "key"], "left_anti")
        return fresh.groupBy("turn_id", "key").agg(F.min_by("question", "pos").alias("question"), F.min("pos").alias("pos"))

    threads = turns.select("turn_id", "thread_id")
    first = top_per_key(allowed(proposals.join(threads, "turn_id")), ["turn_id"], [c("pos")], rules.FOLLOW_UP_MAX).drop("place")
    counts = first.groupBy("turn_id").agg(F.count("*").alias("n"))
    topic = F.coalesce(*[F.when(contains_any(c("hay"), keys), F.array(*[F.lit(q) for q in qs])) for keys, qs in topics])
    short = turns.join(counts, "turn_id", "left").where(F.coalesce("n", F.lit(0)) < 2)
    defaults = short.select("turn_id", "thread_id", F.posexplode(topic).alias("pos", "question")).withColumn("pos", c("pos") + 1000)
    defaults = allowed(defaults.join(failed, "question", "left_anti")).join(first.select("turn_id", "key"), ["turn_id", "key"], "left_anti")
    both = first.unionByName(defaults.select(first.columns))
    return top_per_key(both, ["turn_id"], [c("pos")], rules.FOLLOW_UP_MAX).select("turn_id", "place", "question")


def faq_violations(questions: DataFrame, months: DataFrame) -> DataFrame:
    """Rows of (rule, subject) that break the question list: ids, texts, size, month lists."""
    c = F.col
    repeated = lambda col, name: questions.groupBy(col).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(name).alias("rule"), c(col).alias("subject"))
    empty = questions.where((F.trim("text") == "") | (F.trim("id") == "")).select(F.lit("empty").alias("rule"), c("id").alias("subject"))
    many = questions.agg(F.count("*").alias("n")).where(c("n") > FAQ_MAX).select(F.lit("too_many").alias("rule"), c("n").cast("string").alias("subject"))
    known = months.join(questions.select("id").distinct(), "id", "left_semi").distinct()
    unknown = months.join(questions.select("id").distinct(), "id", "left_anti").select(F.lit("unknown_id").alias("rule"), c("id").alias("subject")).distinct()
    full = known.groupBy("month").agg(F.count("*").alias("n")).where(c("n") > FAQ_MONTH).select(F.lit("month_full").alias("rule"), c("month").cast("string").alias("subject"))
    return repeated("id", "same_id").unionByName(repeated("text", "same_text")).unionByName(empty).unionByName(many).unionByName(unknown).unionByName(full)


def publish_event(changes: DataFrame, events: DataFrame) -> DataFrame:
    """Reviewed events: a row without a date is not activated unless a date comes with the change."""
    c = F.col
    rows = changes.join(events, "event_id")
    refused = (c("new_status") == "active") & c("date_missing") & c("new_end").isNull()
    return rows.select(
        "event_id", refused.alias("refused"), F.when(refused, c("status")).otherwise(c("new_status")).alias("status"),
        F.when(refused | c("new_end").isNull(), c("end_date")).otherwise(c("new_end")).alias("end_date"), F.when(refused, "").otherwise(c("reviewer")).alias("reviewed_by"),
    )


def with_verdicts(rows: DataFrame, verdicts: DataFrame, today: Column) -> DataFrame:
    """Join outside verdicts by key and apply the guards around them.

    A period read from the title wins; a verdict has to end today or later; a span over sixty days
    loses its start; a missing date makes the row pending.
    """
    c = F.col
    joined = rows.join(verdicts, "key", "left")
    by_rule = c("period_end").isNotNull()
    end = F.when(by_rule, c("period_end")).otherwise(c("verdict_end"))
    start = F.when(by_rule, c("period_start")).otherwise(c("verdict_start"))
    joined = joined.withColumns({"end_date": end, "start_date": start})
    long = F.coalesce(F.datediff("end_date", "start_date") > rules.MAX_PERIOD_DAYS, F.lit(False)) | F.coalesce(c("start_date") > c("end_date"), F.lit(False))
    status = F.when(c("end_date").isNull(), "pending").when(c("end_date") < today, "dropped").when(by_rule, "active").otherwise("pending")
    return joined.select(
        "key", F.when(~long, c("start_date")).alias("start_date"), "end_date", status.alias("status"), c("end_date").isNull().alias("date_missing"),
        F.when(by_rule, "regex").when(c("verdict_end").isNotNull(), "verdict").otherwise("none").alias("extracted_by"),
    )


def sanitize_calls(calls: DataFrame, failed: DataFrame, done: DataFrame, room: DataFrame) -> DataFrame:
    """Proposed lookups (turn_id, pos, name, args) that may run: known, not failed, not repeated, two at most.

    Calls of one pos go by name and text, so that every run keeps the same ones.
    """
    c = F.col
    cut = F.transform_values("args", lambda k, v: F.left(v, F.lit(CALL_TEXT)))
    canonical = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c("args")))))
    rows = calls.where(c("name").isin(*ALLOWED_CALLS)).withColumn("args", cut).withColumn("call", canonical)
    rows = rows.join(failed, ["turn_id", "name"], "left_anti").join(done, ["turn_id", "name", "call"], "left_anti")
    first = rows.groupBy("turn_id", "name", "call").agg(F.min("pos").alias("pos"))
    top = top_per_key(first, ["turn_id"], [c("pos"), c("name"), c("call")], 2)
    return top.join(room, "turn_id").where(c("place") <= c("room")).select("turn_id", "place", "name", "call")


def evidence_cards(evidence: DataFrame) -> DataFrame:
    """Card of every piece of evidence: a snippet and ISO days."""
    return evidence.withColumn("snippet", F.left(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), F.lit(SNIPPET)))


def turn_record(evidence: DataFrame, turn: str) -> DataFrame:
    """Retrieved and cited ids of a turn and the first delegated articles among them."""
    c = F.col
    ordered = lambda cond: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("pos", "evidence_id")))), lambda x: x["evidence_id"]), ",")
    delegated = F.transform(F.slice(F.sort_array(F.collect_list(F.when(c("delegated"), F.struct("pos", "evidence_id")))), 1, DELEGATED_SHOWN), lambda x: x["evidence_id"])
    chars = F.sum(F.when(c("cited"), F.length(F.left("text", F.lit(CITED_TEXT)))))
    return evidence.groupBy(turn).agg(ordered(F.lit(True)).alias("retrieved"), ordered(c("cited")).alias("cited"), F.array_join(delegated, ",").alias("delegated"), F.coalesce(chars, F.lit(0)).alias("cited_chars"))


def unanswered_recheck(unanswered: DataFrame, reruns: DataFrame, now: Column) -> DataFrame:
    """Open questions run again: answered ones are verified with a preview and 30 days to live."""
    c = F.col
    rows = unanswered.join(reruns, "question_id", "left")
    opened = (c("status") != "verified") & c("outcome").isNotNull()
    good = opened & (c("outcome") == "answer")
    return rows.select(
        "question_id", F.when(good, "verified").when(opened, "unresolved").otherwise(c("status")).alias("status"),
        F.when(good, F.left("answer", F.lit(PREVIEW))).otherwise("").alias("preview"),
        F.when(opened & ~good, F.coalesce(F.nullif("reason", F.lit("")), c("outcome"))).otherwise("").alias("recheck_reason"),
        F.when(good, now + F.make_dt_interval(hours=F.lit(rules.TTL_HOURS["verified_unanswered"]))).otherwise(c("expires_at")).alias("expires_at"),
    )

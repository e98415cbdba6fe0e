"""Review states, rules of a conversation and external verdicts."""

from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.functions.dates import with_period
from plumbline.operators import review as rv
from plumbline.plans import inputs
from plumbline.plans.scalars import _REF, _reference
from plumbline.registry import query, sql_array, sql_list, sql_text

_STATUS = ("open", "resolved", "triaged", "rejected", "open")
_FIX = ("unanswered", "quality", "place", "recollect", "register", "")
_FIXED = ("linked", "recheck_failed", "applied", "recollecting", "proposed")


@query("next_step", f"""
SELECT o_orderkey AS id, CASE WHEN status IN ('resolved', 'rejected', 'no_issue') THEN 'skip' WHEN t IS NULL THEN 'analyze' WHEN (t IN ('unanswered', 'quality') AND s IN ('linked', 'recheck_failed')) OR (t = 'place' AND s IN ('applied', 'recheck_failed') AND p <> '') OR (t IN ('recollect', 'register') AND s = 'recollecting') THEN 'verify'
 WHEN s = 'proposed' THEN 'needs_approval' ELSE 'skip' END AS step
FROM (SELECT o_orderkey, {sql_array(_STATUS)}[o_orderkey % 5 + 1] AS status, nullif({sql_array(_FIX)}[o_custkey % 6 + 1], '') AS t, {sql_array(_FIXED)}[(o_orderkey // 5) % 5 + 1] AS s, CASE WHEN o_orderkey % 2 = 0 THEN 'b1' ELSE '' END AS p FROM orders)
""")
def next_step(spark, d):
    n = F.col("o_orderkey")
    step = rv.next_step(
        inputs.pick(_STATUS, n % 5), F.nullif(inputs.pick(_FIX, F.col("o_custkey") % 6), F.lit("")), inputs.pick(_FIXED, F.floor(n / 5) % 5), F.when(n % 2 == 0, "b1").otherwise("")
    )
    return inputs.table(spark, d, "orders").select(n.alias("id"), step.alias("step"))


_ACTIONS = ("publish", "reject", "archive", "purge", "rename")
_DOC = ("staging", "published", "rejected", "archived", "publishing")


@query("document_transition", f"""
SELECT document_id, action, CASE WHEN refusal = '' THEN to_status ELSE '' END AS new_status, replayed, refusal = '' AND action IN ('archive', 'purge') AS deny, refusal FROM (
 SELECT *, CASE WHEN to_status IS NULL THEN 'unknown_action' WHEN replayed THEN '' WHEN NOT CASE action WHEN 'publish' THEN status = 'staging' WHEN 'reject' THEN status = 'staging' WHEN 'archive' THEN status = 'published' ELSE status IN ('staging', 'rejected', 'publishing', 'published', 'archived') END THEN 'wrong_status'
  WHEN action = 'publish' AND document_id % 3 = 0 THEN 'preview_not_ready' WHEN action = 'publish' AND document_id % 4 = 1 THEN 'no_approval_basis' WHEN action = 'purge' AND document_id % 2 = 0 THEN 'not_confirmed' ELSE '' END AS refusal FROM (
  SELECT *, coalesce(status = to_status AND document_id % 7 = 0, false) AS replayed FROM (SELECT *, CASE action WHEN 'publish' THEN 'publishing' WHEN 'reject' THEN 'rejected' WHEN 'archive' THEN 'archived' WHEN 'purge' THEN 'purging' END AS to_status FROM (
   SELECT o_orderkey AS document_id, {sql_array(_ACTIONS)}[o_orderkey % 5 + 1] AS action, {sql_array(_DOC)}[o_custkey % 5 + 1] AS status FROM orders))))
""")
def document_transition(spark, d):
    n = F.col("o_orderkey")
    orders = inputs.table(spark, d, "orders")
    requests = orders.select(n.alias("document_id"), inputs.pick(_ACTIONS, n % 5).alias("action"), F.concat(F.lit("r"), n.cast("string")).alias("request_id"), F.when(n % 2 == 1, n.cast("string")).otherwise("no").alias("confirm"))
    documents = orders.select(
        n.alias("document_id"), inputs.pick(_DOC, F.col("o_custkey") % 5).alias("status"), F.when(n % 7 == 0, F.concat(F.lit("r"), n.cast("string"))).otherwise("old").alias("last_request_id"),
        F.when(n % 3 == 0, "running").otherwise("ready").alias("preview_status"), F.when(n % 4 == 1, " ").otherwise("기준").alias("approval_basis"),
    )
    return rv.document_transition(requests, documents)


@query("place_review", """
SELECT c_custkey AS place_id, CASE WHEN requested = 'verified' THEN CASE WHEN is_new THEN 'new_place' WHEN NOT complete THEN 'incomplete' ELSE '' END ELSE '' END AS refusal,
 CASE WHEN requested = 'verified' AND (is_new OR NOT complete) THEN coalesce(old, '') WHEN is_new THEN 'pending' WHEN requested = 'verified' THEN 'verified' WHEN requested = 'pending' OR (moved AND old = 'verified') THEN 'pending' ELSE old END AS status
FROM (SELECT *, c_custkey % 7 = 0 AS is_new, CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'verified' ELSE 'pending' END END AS old, ['verified', 'pending', ''][c_custkey % 3 + 1] AS requested, c_custkey % 5 = 0 AS moved,
  c_custkey % 4 <> 3 AND (c_custkey % 5 = 0 OR (c_custkey % 11 <> 0 AND c_custkey % 7 <> 0) OR c_custkey % 13 <> 0) AS complete FROM customer)
""")
def place_review(spark, d):
    k = F.col("c_custkey")
    people = inputs.table(spark, d, "customer")
    none = F.lit(None).cast("string")
    changes = people.select(
        k.alias("place_id"), inputs.pick(("verified", "pending", ""), k % 3).alias("requested"), F.when(k % 5 == 0, "새 위치").alias("raw_location"), F.when(k % 13 != 0, "055").alias("phone"),
        F.when(k % 4 != 3, "https://www.campus.example/").alias("source_url"), F.lit("2026-01-01").alias("snapshot_at"), F.lit("unit").alias("kind"),
    )
    current = people.where("c_custkey % 7 <> 0").select(
        k.alias("place_id"), F.when(k % 2 == 0, "verified").otherwise("pending").alias("status"), F.when(k % 11 != 0, "옛 위치").otherwise("").alias("raw_location"), none.alias("phone"), none.alias("source_url"), none.alias("snapshot_at"), F.lit("unit").alias("kind"),
    )
    return rv.place_review(changes, current)


@query("undo_state", """
SELECT turn AS id, CASE WHEN after = status THEN before ELSE status END AS status, after = status AS undone FROM (
 SELECT l_orderkey AS turn, arg_max('s' || l_linenumber, (l_shipdate, l_partkey, l_suppkey)) AS after, arg_max('p' || l_linenumber, (l_shipdate, l_partkey, l_suppkey)) AS before, 's' || (l_orderkey % 7 + 1) AS status FROM lineitem GROUP BY l_orderkey)
""")
def undo_state(spark, d):
    li = inputs.table(spark, d, "lineitem")
    n = F.col("l_linenumber").cast("string")
    changes = li.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("s"), n).alias("after"), F.concat(F.lit("p"), n).alias("before"), F.struct("l_shipdate", "l_partkey", "l_suppkey").alias("at"))
    current = li.select(F.col("l_orderkey").alias("id")).distinct().withColumn("status", F.concat(F.lit("s"), (F.col("id") % 7 + 1).cast("string")))
    return rv.undo_state(changes, current)


@query("confusable_block", """
SELECT p_partkey AS id, (w = '휴학' AND r = '복학') OR (w = '복학' AND r = '휴학') OR regexp_replace(w, '[^0-9]', '', 'g') <> regexp_replace(r, '[^0-9]', '', 'g') AS blocked FROM (SELECT p_partkey, ['휴학', '복학', '제3조', '도서관'][p_partkey % 4 + 1] AS w, ['복학', '휴학', '제4조', '도서실', '휴학원'][p_partkey % 5 + 1] AS r FROM part)
""")
def confusable_block(spark, d):
    k = F.col("p_partkey")
    rows = inputs.table(spark, d, "part").select(k.alias("id"), inputs.pick(("휴학", "복학", "제3조", "도서관"), k % 4).alias("wrong"), inputs.pick(("복학", "휴학", "제4조", "도서실", "휴학원"), k % 5).alias("right"))
    pairs = spark.createDataFrame([("휴학", "복학")], "a string, b string")
    return rv.confusable_block(rows, pairs).select("id", "blocked")


@query("slot_rules", """
SELECT turn_id, CASE WHEN contains(query_masked, '졸업') AND (k % 3 = 0 OR k % 3 = 1) AND turn_id % 4 <> 0 THEN 'dept' ELSE '' END AS missing FROM turns
""", "turns")
def slot_rules(spark, d):
    intent = F.when(F.col("k") % 3 == 0, "procedure").when(F.col("k") % 3 == 2, "rule")
    filled = F.when(F.col("turn_id") % 4 == 0, F.array(F.lit("dept"))).otherwise(F.array(F.lit("grade")))
    missing = rv.missing_slots(F.lit(None).cast("string"), F.col("query_masked"), intent, filled)
    return inputs.turns(spark, d).select("turn_id", F.array_join(missing, ",").alias("missing"))


@query("profile_merge", """
SELECT thread_id, coalesce(arg_max(g, (created_at, turn_id)) FILTER (g IS NOT NULL), -1) AS grade, coalesce(arg_max(dp, (created_at, turn_id)) FILTER (dp IS NOT NULL), '') AS dept FROM (SELECT *, CASE WHEN k % 10 = 0 THEN k % 4 + 1 END AS g, CASE WHEN k % 7 = 0 THEN 'D' || (k % 5) END AS dp FROM turns) GROUP BY thread_id
""", "turns")
def profile_merge(spark, d):
    k = F.col("k")
    updates = inputs.turns(spark, d).select(
        "thread_id", "created_at", "turn_id", F.when(k % 10 == 0, k % 4 + 1).alias("grade"), F.when(k % 7 == 0, F.concat(F.lit("D"), (k % 5).cast("string"))).alias("dept")
    )
    merged = rv.profile_merge(updates, "thread_id", F.struct("created_at", "turn_id"), ["grade", "dept"])
    return merged.select("thread_id", F.coalesce("grade", F.lit(-1)).alias("grade"), F.coalesce("dept", F.lit("")).alias("dept"))


@query("outcome_route", """
SELECT turn_id, outcome, CASE WHEN outcome = 'fallback' THEN reason ELSE '' END AS reason FROM (SELECT *, CASE WHEN k % 31 = 0 THEN 'error' WHEN k % 13 = 0 THEN 'fallback' WHEN k % 5 = 0 AND k % 2 = 0 THEN 'ask' WHEN reason IS NOT NULL THEN 'fallback' ELSE 'answer' END AS outcome FROM (
 SELECT turn_id, k, CASE WHEN k % 13 = 0 THEN 'out_of_scope' WHEN k % 17 = 0 THEN 'deadline' WHEN k % 7 = 0 THEN CASE WHEN k % 3 = 0 THEN 'tool_failure' ELSE 'no_evidence' END WHEN k % 11 = 0 THEN 'verification_failed' END AS reason FROM turns))
""", "turns")
def outcome_route(spark, d):
    k = F.col("k")
    zero = lambda m: F.when(k % m == 0, 0).otherwise(1)
    rows = inputs.turns(spark, d).select(
        "turn_id", (k % 31 == 0).alias("failed"), F.when(k % 13 == 0, "out_of_scope").otherwise("rule").alias("intent"), F.when(k % 5 == 0, 1).otherwise(0).alias("missing"), (k % 2).alias("asked_before"),
        (k % 17 == 0).alias("late"), zero(7).alias("evidence"), F.when(k % 3 == 0, 1).otherwise(0).alias("failures"), zero(11).alias("kept"),
    )
    return rv.outcome_route(rows).select("turn_id", "outcome", "reason")


_TOPICS = (
    (("휴학",), ("휴학을 한 해 더 늘릴 수 있나요?", "휴학 중에 도서관을 쓸 수 있나요?", "입대 휴학은 무엇을 내나요?")),
    (("장학",), ("두 장학을 함께 받아도 되나요?", "장학 결과는 어디서 보나요?", "가계 곤란 장학이 있나요?")),
    (("졸업",), ("졸업 사진은 언제 찍나요?", "한 학기 먼저 졸업할 수 있나요?", "졸업 유예 비용은 얼마예요?")),
    (("메뉴",), ("저녁 메뉴도 보여 주세요", "채식 메뉴가 있나요?", "다음 주 식단이 올라왔나요?")),
    (("기숙사",), ("기숙사 통금이 몇 시예요?", "방학에도 머물 수 있나요?", "세탁실은 몇 층이에요?")),
)
_OFFERED = _TOPICS[0][1]


@query("follow_up_pick")
def follow_up_pick(spark, d):
    turns = inputs.turns(spark, d)
    k = F.col("k")
    offered = F.array(inputs.pick(_OFFERED, k % 3), F.when(k % 2 == 0, "조교 전화번호 좀").otherwise("장학  서류는 어디에 내나요?"), F.when(k % 4 == 0, F.lit(inputs.STEMS[0])).otherwise(""))
    proposals = turns.select("turn_id", F.posexplode(offered).alias("pos", "question"))
    asked = turns.select("thread_id", F.regexp_replace("query_masked", " [0-9]+$", "").alias("question"))
    failed = spark.createDataFrame([("졸업 유예 비용은 얼마예요?",)], "question string")
    return rv.follow_up_pick(proposals, asked, turns.select("turn_id", "thread_id", F.col("query_masked").alias("hay")), failed, _TOPICS)


@query("faq_config_check", """
SELECT 'same_id' AS rule, cast(p_partkey // 2 AS VARCHAR) AS subject FROM part GROUP BY p_partkey // 2 HAVING count(*) > 1 UNION ALL SELECT 'same_text', p_name FROM part GROUP BY p_name HAVING count(*) > 1
UNION ALL SELECT 'too_many', cast(count(*) AS VARCHAR) FROM part HAVING count(*) > 200
UNION ALL SELECT DISTINCT 'unknown_id', cast(s_suppkey + 5000000 AS VARCHAR) FROM supplier WHERE s_suppkey % 10 = 3
UNION ALL SELECT 'month_full', cast(m AS VARCHAR) FROM (SELECT DISTINCT p_size % 12 + 1 AS m, p_partkey // 2 AS id FROM part) GROUP BY m HAVING count(*) > 12
""")
def faq_config_check(spark, d):
    part = inputs.table(spark, d, "part").select(F.floor(F.col("p_partkey") / 2).cast("string").alias("id"), F.col("p_name").alias("text"), (F.col("p_size") % 12 + 1).alias("month"))
    wrong = inputs.table(spark, d, "supplier").where("s_suppkey % 10 = 3").select(F.lit(1).alias("month"), (F.col("s_suppkey") + 5000000).cast("string").alias("id"))
    return rv.faq_violations(part.select("id", "text"), part.select("month", "id").unionByName(wrong))


@query("extraction_lock", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'value_changed' WHEN doc_id % 7 = 0 THEN 'file_changed' ELSE 'ok' END AS verdict FROM documents
""")
def extraction_lock(spark, d):
    """Submitted values have to equal the recorded ones of the same file."""
    docs = inputs.wide(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.col("text").alias("value"))
    submitted = docs.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("hash")).alias("s_hash"), F.when(F.col("doc_id") % 3 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value")).alias("s_value"))
    verdict = F.when(F.col("s_value") != F.col("value"), "value_changed").when(F.col("s_hash") != F.col("hash"), "file_changed").otherwise("ok")
    return docs.join(submitted, "doc_id").select("doc_id", verdict.alias("verdict"))


@query("event_publish_rule", """
SELECT cal_id AS event_id, new = 'active' AND missing AND ne IS NULL AS refused, CASE WHEN new = 'active' AND missing AND ne IS NULL THEN status ELSE new END AS status, strftime(CASE WHEN (new = 'active' AND missing AND ne IS NULL) OR ne IS NULL THEN end_date ELSE ne END, '%Y-%m-%d') AS end_day, CASE WHEN new = 'active' AND missing AND ne IS NULL THEN '' ELSE 'admin' END AS reviewed_by
FROM (SELECT *, CASE WHEN cal_id % 3 = 0 THEN 'hidden' ELSE 'active' END AS new, cal_id % 4 = 0 AS missing, CASE WHEN cal_id % 5 = 0 THEN end_date + 7 END AS ne FROM calendar)
""", "calendar")
def event_publish_rule(spark, d):
    k = F.col("cal_id")
    events = inputs.calendar(spark, d).select(k.alias("event_id"), "status", "end_date", (k % 4 == 0).alias("date_missing"))
    changes = inputs.calendar(spark, d).select(k.alias("event_id"), F.when(k % 3 == 0, "hidden").otherwise("active").alias("new_status"), F.when(k % 5 == 0, F.date_add("end_date", 7)).alias("new_end"), F.lit("admin").alias("reviewer"))
    return rv.publish_event(changes, events).withColumn("end_day", F.col("end_date").cast("string")).drop("end_date")


@query("with_verdicts", """
SELECT p.notice_id AS key, coalesce(strftime(CASE WHEN NOT coalesce(e - s > 60, false) AND NOT coalesce(s > e, false) THEN s END, '%Y-%m-%d'), '') AS start_day, coalesce(strftime(e, '%Y-%m-%d'), '') AS end_day,
 CASE WHEN e IS NULL THEN 'pending' WHEN e < DATE '2026-06-01' THEN 'dropped' WHEN by_rule THEN 'active' ELSE 'pending' END AS status, e IS NULL AS date_missing, CASE WHEN by_rule THEN 'regex' WHEN e IS NOT NULL THEN 'verdict' ELSE 'none' END AS extracted_by
FROM (SELECT notice_id, period_end IS NOT NULL AS by_rule, CASE WHEN period_end IS NOT NULL THEN period_end WHEN notice_id % 2 = 0 THEN end_date END AS e, CASE WHEN period_end IS NOT NULL THEN period_start WHEN notice_id % 2 = 0 THEN start_date END AS s FROM title_periods JOIN notices USING (notice_id)) p
""", ("title_periods", "notices"))
def with_verdicts(spark, d):
    notices = inputs.notices(spark, d)
    rows = with_period(notices.select(F.col("notice_id").alias("key"), "title", _reference().alias("reference")), "title", "reference").select("key", "period_start", "period_end")
    verdicts = notices.where("notice_id % 2 = 0").select(F.col("notice_id").alias("key"), F.col("start_date").alias("verdict_start"), F.col("end_date").alias("verdict_end"))
    out = rv.with_verdicts(rows, verdicts, F.lit("2026-06-01").cast("date"))
    day = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return out.select("key", day("start_date").alias("start_day"), day("end_date").alias("end_day"), "status", "date_missing", "extracted_by")


@query("unanswered_recheck", """
SELECT turn_id AS question_id, CASE WHEN status = 'verified' OR o IS NULL THEN status WHEN o = 'answer' THEN 'verified' ELSE 'unresolved' END AS status, CASE WHEN status <> 'verified' AND o = 'answer' THEN substr(query_masked, 1, 300) ELSE '' END AS preview,
 CASE WHEN status <> 'verified' AND o <> 'answer' THEN coalesce(nullif(r, ''), o) ELSE '' END AS recheck_reason, strftime(CASE WHEN status <> 'verified' AND o = 'answer' THEN TIMESTAMP '2024-03-01' ELSE TIMESTAMP '2024-05-01' END, '%Y-%m-%d') AS expires
FROM (SELECT *, CASE WHEN k % 4 = 0 THEN 'verified' ELSE 'open' END AS status, CASE k % 3 WHEN 0 THEN 'answer' WHEN 1 THEN 'fallback' END AS o, CASE WHEN k % 2 = 0 THEN 'no_evidence' ELSE '' END AS r FROM turns WHERE outcome = 'fallback')
""", "turns")
def unanswered_recheck(spark, d):
    k = F.col("k")
    rows = inputs.turns(spark, d).where("outcome = 'fallback'")
    opened = rows.select(F.col("turn_id").alias("question_id"), F.when(k % 4 == 0, "verified").otherwise("open").alias("status"), F.lit("2024-05-01").cast("timestamp").alias("expires_at"))
    reruns = rows.where("k % 3 <> 2").select(F.col("turn_id").alias("question_id"), F.when(k % 3 == 0, "answer").otherwise("fallback").alias("outcome"), F.when(k % 2 == 0, "no_evidence").otherwise("").alias("reason"), F.col("query_masked").alias("answer"))
    out = rv.unanswered_recheck(opened, reruns, F.lit("2024-01-31").cast("timestamp"))
    return out.withColumn("expires", inputs.day_text("expires_at")).drop("expires_at")


@query("eval_candidates", """
SELECT conv_id * 100 + turn AS report_id, kind, question, true AS turn_invalid FROM (SELECT *, ['answer_evidence_mismatch', 'answer_quality', 'stale_source'][(conv_id + turn) % 3 + 1] AS kind, text AS question FROM conversations WHERE role = 'user') WHERE kind = 'answer_quality' OR (kind = 'answer_evidence_mismatch' AND turn % 4 <> 2)
""")
def eval_candidates(spark, d):
    """Confirmed mismatches and quality complaints become evaluation candidates, one per report."""
    kind = inputs.pick(("answer_evidence_mismatch", "answer_quality", "stale_source"), (F.col("conv_id") + F.col("turn")) % 3)
    reports = inputs.table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("report_id"), kind.alias("kind"), (F.col("turn") % 4 != 2).alias("confirmed"), F.col("text").alias("question"))
    chosen = reports.where((F.col("kind") == "answer_quality") | ((F.col("kind") == "answer_evidence_mismatch") & F.col("confirmed")))
    return chosen.groupBy("report_id").agg(F.first("kind").alias("kind"), F.first("question").alias("question")).withColumn("turn_invalid", F.lit(True))


@query("turn_record", """
SELECT turn_id, string_agg(evidence_id, ',' ORDER BY pos, evidence_id) AS retrieved, coalesce(string_agg(evidence_id, ',' ORDER BY pos, evidence_id) FILTER (cited), '') AS cited, array_to_string(list_slice(coalesce(list(evidence_id ORDER BY pos, evidence_id) FILTER (deleg), []), 1, 3), ',') AS delegated, cast(coalesce(sum(length(substr(text, 1, 1500))) FILTER (cited), 0) AS BIGINT) AS cited_chars
FROM (SELECT turn_id, evidence_id, min(idx) AS pos, bool_or(supp % 2 = 0) AS cited, bool_or(supp % 3 = 0) AS deleg, max(evidence_text) AS text FROM facts GROUP BY 1, 2) GROUP BY turn_id
""", "facts")
def turn_record(spark, d):
    rows = inputs.facts(spark, d).groupBy("turn_id", "evidence_id").agg(
        F.min("idx").alias("pos"), F.bool_or(F.col("supp") % 2 == 0).alias("cited"), F.bool_or(F.col("supp") % 3 == 0).alias("delegated"), F.max("evidence_text").alias("text")
    )
    return rv.turn_record(rows, "turn_id")


@query("evidence_cards", """
SELECT turn_id, evidence_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 120) AS snippet FROM evidence
""", "evidence")
def evidence_cards(spark, d):
    return rv.evidence_cards(inputs.evidence(spark, d)).select("turn_id", "evidence_id", "snippet")


_NAMES = ("get_notices", "get_menu", "delete_all", "find_campus_tips", "get_academic_calendar")


@query("sanitize_calls", f"""
SELECT turn_id, place, name, call FROM (SELECT *, cast(row_number() OVER (PARTITION BY turn_id ORDER BY pos) AS INTEGER) AS place FROM (
 SELECT turn_id, name, '{{"a":"' || b || '","z":"' || c || '"}}' AS call, min(pos) AS pos FROM (SELECT turn_id, {sql_array(_NAMES)}[part % 5 + 1] AS name, cast(part % 3 AS VARCHAR) AS b, substr(repeat('x', cast(90 + part % 20 AS INTEGER)), 1, 100) AS c, idx * 100000 + part AS pos FROM facts)
 WHERE name <> 'delete_all' AND NOT (name = 'get_menu' AND turn_id % 3 = 0) AND NOT (name = 'get_notices' AND b = '0' AND length(c) = 100 AND turn_id % 2 = 0) GROUP BY 1, 2, 3)) WHERE place <= least(2, turn_id % 4)
""", "facts")
def sanitize_calls(spark, d):
    facts = inputs.facts(spark, d)
    p = F.col("part")
    args = F.map_from_arrays(F.array(F.lit("z"), F.lit("a")), F.array(F.repeat(F.lit("x"), (p % 20 + 90).cast("int")), (p % 3).cast("string")))
    calls = facts.select("turn_id", (F.col("idx") * 100000 + p).alias("pos"), inputs.pick(_NAMES, p % 5).alias("name"), args.alias("args"))
    turns = facts.select("turn_id").distinct()
    failed = turns.where("turn_id % 3 = 0").select("turn_id", F.lit("get_menu").alias("name"))
    done = turns.where("turn_id % 2 = 0").select("turn_id", F.lit("get_notices").alias("name"), F.lit('{"a":"0","z":"' + "x" * 100 + '"}').alias("call"))
    return rv.sanitize_calls(calls, failed, done, turns.select("turn_id", F.least(F.lit(2), F.col("turn_id") % 4).alias("room")))

"""Aggregations: evaluation, votes, counters and nested groupings."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import rules
from plumbline.functions.text import norm_spaces
from plumbline.operators import evaluation as ev
from plumbline.operators import votes as vt
from plumbline.plans import inputs
from plumbline.registry import query, sql_array, sql_list, sql_text, view


def _rate(k: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN round_even({k}::DOUBLE / {n}, 3) END"


def _wilson(k: str, n: str, side: str) -> str:
    p, z = f"({k}::DOUBLE / {n})", "1.96::DOUBLE"
    den = f"(1 + {z}*{z}/{n})"
    mid = f"(({p} + {z}*{z}/(2*{n}))/{den})"
    half = f"(sqrt({p}*(1-{p})/{n} + {z}*{z}/(4*{n}::DOUBLE*{n}))*{z}/{den})"
    value = f"greatest(0.0::DOUBLE, {mid} - {half})" if side == "low" else f"least(1.0::DOUBLE, {mid} + {half})"
    return f"CASE WHEN {n} > 0 THEN round_even({value}, 3) END"


def _rates(name: str, k: str, n: str) -> str:
    return f"{_rate(k, n)} AS {name}_rate, {_wilson(k, n, 'low')} AS {name}_low, {_wilson(k, n, 'high')} AS {name}_high"


# ── evaluation ───────────────────────────────────────────────────────────────────────────────
@query("wilson_ci", f"""
SELECT day, n, k, {_rates('fallback', 'k', 'n')} FROM (SELECT day, count(*) AS n, count(*) FILTER (outcome = 'fallback') AS k FROM turns GROUP BY day)
""", "turns")
def wilson_ci(spark, d):
    days = inputs.turns(spark, d).groupBy("day").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("outcome") == "fallback", 1)).alias("k")
    )
    return ev.with_rate(days, "fallback", "k", "n")


view("item_history", """
SELECT i.*, f.first_ok, f.cohort, (SELECT max_by(p.ok, p.day) FROM item_days p WHERE p.item_id = i.item_id AND p.day < i.day AND p.reason <> 'quota_exceeded') AS previous,
  i.reason <> 'quota_exceeded' AS measured
FROM item_days i LEFT JOIN (SELECT item_id, min_by(ok, day) AS first_ok, min(day) AS cohort FROM item_days WHERE reason <> 'quota_exceeded' GROUP BY 1) f USING (item_id)
""", ("item_days",))

_FAILING = "(source IN ('unanswered', 'report') OR first_ok = false)"
_FROZEN = "cohort = (SELECT min(day) FROM item_days)"


@query("eval_summary", f"""
SELECT *, {_rates('strict', 'ok', 'total')}, {_rates('recovered', 'now_ok', 'was_failing')}, {_rates('frozen_recovered', 'frozen_now_ok', 'frozen_failing')}, {_rates('frozen_regression', 'frozen_lost', 'frozen_passing')}
FROM (SELECT day, count(*) FILTER (measured) AS total, count(*) FILTER (NOT measured) AS unmeasured, count(*) FILTER (measured AND ok) AS ok,
  count(*) FILTER (measured AND {_FAILING}) AS was_failing, count(*) FILTER (measured AND {_FAILING} AND ok) AS now_ok,
  count(*) FILTER (measured AND {_FAILING} AND {_FROZEN}) AS frozen_failing, count(*) FILTER (measured AND {_FAILING} AND {_FROZEN} AND ok) AS frozen_now_ok,
  count(*) FILTER (measured AND first_ok AND source = 'seed' AND {_FROZEN}) AS frozen_passing, count(*) FILTER (measured AND first_ok AND source = 'seed' AND {_FROZEN} AND NOT ok) AS frozen_lost
FROM item_history GROUP BY day)
""", ("item_days", "item_history"))
def eval_summary(spark, d):
    return ev.eval_summary(inputs.item_days(spark, d))


@query("eval_transitions", """
SELECT day, CASE WHEN previous IS NULL THEN 'new' WHEN NOT previous AND ok THEN 'fail_to_ok' WHEN previous AND NOT ok THEN 'ok_to_fail' WHEN ok THEN 'same_ok' ELSE 'same_fail' END AS transition, count(*) AS items
FROM item_history WHERE measured GROUP BY 1, 2
""", "item_history")
def eval_transitions(spark, d):
    return ev.eval_transitions(inputs.item_days(spark, d))


view("eval_marks", f"""
SELECT r.*, c.criterion, CASE c.criterion
  WHEN 'retrieval' THEN (len(any_of) = 0 OR list_has_any(any_of, retrieved[1:5])) AND list_has_all(retrieved[1:5], all_of) AND CASE WHEN want_kind = 'rule' THEN 'article' ELSE want_kind END = kind
  WHEN 'citation' THEN outcome = 'answer' AND cited WHEN 'action' THEN has_actions WHEN 'key_facts' THEN facts_ok WHEN 'no_errors' THEN errors_ok
  ELSE outcome = 'fallback' AND reason = 'out_of_scope' END AS passed
FROM eval_results r JOIN (VALUES {', '.join(f"('{t}', '{c}')" for t, cs in rules.TYPE_CRITERIA.items() for c in cs)}) AS c(type, criterion) USING (type)
""", ("eval_results",))


@query("eval_judge", """
SELECT item_id, type, count(*) AS required, count(*) FILTER (passed) AS passed, bool_and(passed) AS correct FROM eval_marks GROUP BY item_id, type
""", "eval_marks")
def eval_judge(spark, d):
    return ev.eval_judge(inputs.eval_results(spark, d))


@query("expected_evidence", """
SELECT item_id, (len(any_of) = 0 OR list_has_any(any_of, retrieved[1:5])) AND list_has_all(retrieved[1:5], all_of) AS found FROM eval_results
""", "eval_results")
def expected_evidence(spark, d):
    found = ev.expected_evidence(F.col("retrieved"), F.col("any_of"), F.col("all_of"))
    return inputs.eval_results(spark, d).select("item_id", found.alias("found"))


@query("eval_metrics", f"""
SELECT i.items, i.labeled_items, i.correct, {_rate('i.correct', 'i.labeled_items')} AS accuracy, {_rate('m.rk', 'm.rn')} AS recall_at_5, {_rate('i.vk', 'i.vt')} AS verified_retention,
  {_rate('i.ck', 'i.cn')} AS answer_with_citation_rate, {_rate('m.wk', 'm.wn')} AS workflow_criteria_rate
FROM (SELECT count(*) AS items, count(*) FILTER (labeled) AS labeled_items, count(*) FILTER (labeled AND j) AS correct, sum(verify_total) AS vt, sum(verify_kept) AS vk,
   count(*) FILTER (outcome = 'answer') AS cn, count(*) FILTER (outcome = 'answer' AND cited) AS ck
  FROM eval_results JOIN (SELECT item_id, bool_and(passed) AS j FROM eval_marks GROUP BY 1) USING (item_id)) i,
 (SELECT count(*) FILTER (criterion = 'retrieval') AS rn, count(*) FILTER (criterion = 'retrieval' AND passed) AS rk,
   count(*) FILTER (criterion IN ('citation', 'action', 'oos_fallback')) AS wn, count(*) FILTER (criterion IN ('citation', 'action', 'oos_fallback') AND passed) AS wk FROM eval_marks) m
""", ("eval_results", "eval_marks"))
def eval_metrics(spark, d):
    return ev.eval_metrics(inputs.eval_results(spark, d))


# ── votes ────────────────────────────────────────────────────────────────────────────────────
def tip_owners(spark, d):
    """Author and publication time of every voted tip of the event stream."""
    tips = inputs.votes(spark, d).select("tip_id").distinct()
    return tips.select(
        "tip_id",
        (F.col("tip_id") * 7 % 150).cast("long").alias("author"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("tip_id") % 5).cast("timestamp").alias("public_from"),
    )


view("good_votes", """
SELECT * FROM votes WHERE token <> tip_id * 7 % 150 AND ts >= cast(DATE '2024-01-01' + cast(tip_id % 5 AS INTEGER) AS TIMESTAMP)
""", ("votes",))

_RUNS = """
SELECT tip_id, token, action, ts, event_id, net FROM (
  SELECT *, lag(action) OVER (PARTITION BY tip_id, token ORDER BY ts, event_id) AS prev FROM {src} WHERE action IN ('confirm', 'dispute'))
WHERE prev IS DISTINCT FROM action
QUALIFY row_number() OVER (PARTITION BY tip_id, token ORDER BY ts DESC, event_id DESC) = 1
"""
view("event_ballots", _RUNS.format(src="good_votes"), ("good_votes",))
view("order_ballots", _RUNS.format(src="ballots"), ("ballots",))


@query("vote_tally", """
SELECT tip_id, confirm, dispute, strftime(last_confirm, '%Y-%m-%d %H:%M:%S') AS last_confirm, nets FROM (
 SELECT tip_id, cast(sum(c) AS BIGINT) AS confirm, cast(sum(d) AS BIGINT) AS dispute, max(t) AS last_confirm, string_agg(net || ':' || (c + d), ',' ORDER BY net) AS nets
 FROM (SELECT tip_id, net, count(*) FILTER (action = 'confirm') AS c, count(*) FILTER (action = 'dispute') AS d, max(ts) FILTER (action = 'confirm') AS t FROM event_ballots GROUP BY 1, 2) GROUP BY 1)
""", "event_ballots")
def vote_tally(spark, d):
    votes = vt.admissible(inputs.votes(spark, d), tip_owners(spark, d))
    nets = F.array_join(
        F.transform(F.map_entries("net_counts"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ","
    )
    return vt.vote_tally(votes).select(
        "tip_id", "confirm", "dispute", inputs.ts_text("last_confirm").alias("last_confirm"), nets.alias("nets")
    )


@query("effective_ballots", """
SELECT tip_id, token, action AS ballot, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ballot_at, net FROM event_ballots
""", "event_ballots")
def effective_ballots(spark, d):
    votes = vt.admissible(inputs.votes(spark, d), tip_owners(spark, d))
    return vt.effective_ballots(votes).withColumn("ballot_at", inputs.ts_text("ballot_at"))


@query("flag_tally", """
SELECT tip_id, count(*) AS flags, count(DISTINCT net) AS flag_nets FROM (
  SELECT tip_id, token, arg_min(net, (ts, event_id)) AS net FROM good_votes WHERE action = 'flag' GROUP BY 1, 2) GROUP BY 1
""", "good_votes")
def flag_tally(spark, d):
    return vt.flag_tally(vt.admissible(inputs.votes(spark, d), tip_owners(spark, d)))


def tallied_tips(spark, d):
    """Every tip of the order table with the tallies of its ballots."""
    ballots = inputs.ballots(spark, d)
    tips = inputs.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("tip_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "approved").otherwise("verifying").alias("status"),
        F.col("o_orderdate").alias("published_at"),
        (F.col("o_orderkey") % 6 == 1).alias("safety"),
    )
    empty = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<bigint>"))
    return (
        tips.join(vt.vote_tally(ballots), "tip_id", "left")
        .join(vt.flag_tally(ballots), "tip_id", "left")
        .withColumns({
            **{k: F.coalesce(k, F.lit(0).cast("long")) for k in ("confirm", "dispute", "flags", "flag_nets")},
            "net_counts": F.coalesce("net_counts", empty),
            "dispute_nets": F.coalesce("dispute_nets", empty),
        })
    )


view("tallied", """
SELECT o_orderkey AS tip_id, CASE WHEN o_orderkey % 3 = 0 THEN 'approved' ELSE 'verifying' END AS status, o_orderdate AS published_at, o_orderkey % 6 = 1 AS safety,
  coalesce(c, 0) AS c, coalesce(d, 0) AS d, coalesce(mx, 0) AS mx, coalesce(dn, 0) AS dn, coalesce(dmx, 0) AS dmx, coalesce(f, 0) AS f, coalesce(fn, 0) AS fn
FROM orders LEFT JOIN (SELECT tip_id, sum(c) AS c, sum(d) AS d, max(c + d) AS mx, count(*) FILTER (d > 0) AS dn, max(d) AS dmx FROM (
   SELECT tip_id, net, count(*) FILTER (action = 'confirm') AS c, count(*) FILTER (action = 'dispute') AS d FROM order_ballots GROUP BY 1, 2) GROUP BY 1) v ON v.tip_id = o_orderkey
 LEFT JOIN (SELECT tip_id, count(*) AS f, count(DISTINCT net) AS fn FROM (SELECT tip_id, token, arg_min(net, (ts, event_id)) AS net FROM ballots WHERE action = 'flag' GROUP BY 1, 2) GROUP BY 1) g ON g.tip_id = o_orderkey
""", ("ballots", "order_ballots"))


@query("tip_verdict", """
SELECT tip_id, CASE WHEN hide THEN 'hidden' WHEN cand AND mx / total <= 0.5 THEN 'student_approved' ELSE status END AS status, CASE WHEN hide THEN status ELSE '' END AS hidden_from,
  NOT hide AND majority AND diverse AS contested, NOT hide AND ((majority AND NOT diverse) OR (cand AND mx / total > 0.5)) AS burst_risk, NOT hide AND f >= 3 AND fn < 3 AS flag_review
FROM (SELECT *, NOT hide AND status = 'verifying' AND NOT safety AND NOT majority AND f = 0 AND published_at <= TIMESTAMP '2001-01-01' - INTERVAL 24 HOUR AND total >= 3 AND c / total >= 0.6 AS cand
FROM (SELECT *, c + d AS total, f >= 3 AND fn >= 3 AS hide, CASE WHEN c + d >= 3 THEN d / (c + d) > 0.5 ELSE false END AS majority, CASE WHEN d > 0 THEN dn >= 3 AND dmx / d <= 0.5 ELSE false END AS diverse FROM tallied))
""", "tallied")
def tip_verdict(spark, d):
    return vt.tip_verdict(tallied_tips(spark, d), F.lit("2001-01-01").cast("timestamp"))


# ── counters and groupings ──────────────────────────────────────────────────────────────────────
@query("replace_stats", """
SELECT count(n.id) AS entries, count(*) FILTER (n.phone <> '') AS with_phone, count(*) FILTER (n.id IS NOT NULL AND o.id IS NULL) AS added, count(*) FILTER (o.id IS NOT NULL AND n.id IS NULL) AS removed
FROM (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN '' ELSE cast(p_size AS VARCHAR) END AS phone FROM part WHERE p_partkey % 17 <> 0) n
FULL JOIN (SELECT p_partkey AS id FROM part WHERE p_partkey % 10 <> 3) o USING (id)
""")
def replace_stats(spark, d):
    part = inputs.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    new = part.where("id % 17 <> 0").select(
        "id", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_size").cast("string")).alias("phone"), F.lit(True).alias("is_new")
    )
    old = part.where("id % 10 <> 3").select("id", F.lit(True).alias("is_old"))
    n = lambda cond: F.count(F.when(cond, 1))
    is_new, is_old = F.col("is_new").isNotNull(), F.col("is_old").isNotNull()
    return new.join(old, "id", "full_outer").agg(
        n(is_new).alias("entries"), n(is_new & (F.col("phone") != "")).alias("with_phone"),
        n(is_new & ~is_old).alias("added"), n(is_old & ~is_new).alias("removed"),
    )


@query("unanswered_counts", f"""
SELECT sha1(q) AS question_id, count(*) AS n, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_at,
  arg_max(fallback_reason, (created_at, turn_id)) AS last_reason, arg_max(turn_id, (created_at, turn_id)) AS last_turn
FROM (SELECT *, lower(trim(regexp_replace(query_masked, '\\s+', ' ', 'g'))) AS q FROM turns WHERE outcome = 'fallback' AND fallback_reason IN {sql_list(rules.COUNTED_REASONS)}) GROUP BY q
""", "turns")
def unanswered_counts(spark, d):
    rows = inputs.turns(spark, d).where(
        (F.col("outcome") == "fallback") & F.col("fallback_reason").isin(*rules.COUNTED_REASONS)
    )
    at = F.struct("created_at", "turn_id")
    return (
        rows.groupBy(F.sha1(F.lower(norm_spaces(F.col("query_masked")))).alias("question_id"))
        .agg(
            F.count("*").alias("n"), inputs.ts_text(F.min("created_at")).alias("first_at"),
            inputs.ts_text(F.max("created_at")).alias("last_at"),
            F.max_by("fallback_reason", at).alias("last_reason"), F.max_by("turn_id", at).alias("last_turn"),
        )
    )


_DEPTS = ("학사팀", "장학팀", "입학팀", "시설팀")


@query("dept_mode", f"""
SELECT turn_id, dept FROM (SELECT turn_id, dept, count(*) AS n, min((idx, part, qty)) AS pos FROM (SELECT *, {sql_array(_DEPTS)}[supp % 4 + 1] AS dept FROM facts) GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY n DESC, pos) = 1
""", "facts")
def dept_mode(spark, d):
    rows = inputs.facts(spark, d).select("turn_id", inputs.pick(_DEPTS, F.col("supp") % 4).alias("dept"), F.struct("idx", "part", "qty").alias("pos"))
    counted = rows.groupBy("turn_id", "dept").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return counted.groupBy("turn_id").agg(F.min_by("dept", F.struct(-F.col("n"), "pos")).alias("dept"))


@query("triage_counts", """
SELECT day, cast(v AS BIGINT) AS verified, cast(s AS BIGINT) AS still_unanswered, cast(r AS BIGINT) AS resolved, cast(a AS BIGINT) AS analyzed,
  '미응답 검증완료 ' || v || '/' || (v + s) || ' · 제보 자동 종결 ' || r || ' · 제보 분석 ' || a AS line
FROM (SELECT day, count(*) FILTER (outcome = 'answer' AND k % 4 = 0) AS v, count(*) FILTER (outcome = 'fallback') AS s, count(*) FILTER (outcome = 'ask') AS r, count(*) FILTER (outcome = 'error') AS a FROM turns GROUP BY day)
""", "turns")
def triage_counts(spark, d):
    n = lambda cond: F.count(F.when(cond, 1))
    o = F.col("outcome")
    counts = inputs.turns(spark, d).groupBy("day").agg(
        n((o == "answer") & (F.col("k") % 4 == 0)).alias("verified"), n(o == "fallback").alias("still_unanswered"),
        n(o == "ask").alias("resolved"), n(o == "error").alias("analyzed"),
    )
    s = lambda c: F.col(c).cast("string")
    line = F.concat(
        F.lit("미응답 검증완료 "), s("verified"), F.lit("/"), (F.col("verified") + F.col("still_unanswered")).cast("string"),
        F.lit(" · 제보 자동 종결 "), s("resolved"), F.lit(" · 제보 분석 "), s("analyzed"),
    )
    return counts.withColumn("line", line)


@query("skip_summary", """
SELECT day, string_agg(reason || ' ' || n, ' · ' ORDER BY n DESC, reason) AS summary FROM (SELECT day, fallback_reason AS reason, count(*) AS n FROM turns WHERE fallback_reason IS NOT NULL GROUP BY 1, 2) GROUP BY 1
""", "turns")
def skip_summary(spark, d):
    counts = inputs.turns(spark, d).where("fallback_reason is not null").groupBy("day", "fallback_reason").agg(F.count("*").alias("n"))
    items = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), F.col("fallback_reason").alias("reason"), "n")))
    text = F.array_join(F.transform(items, lambda x: F.concat_ws(" ", x["reason"], x["n"].cast("string"))), " · ")
    return counts.groupBy("day").agg(text.alias("summary"))


@query("as_of_min", """
SELECT turn_id, coalesce(strftime(min(ship_day) FILTER (flag = 'R'), '%Y-%m-%d'), '') AS as_of, bool_or(flag = 'R') AS stale_used FROM facts GROUP BY turn_id
""", "facts")
def as_of_min(spark, d):
    stale = F.col("flag") == "R"
    return inputs.facts(spark, d).groupBy("turn_id").agg(
        F.coalesce(F.min(F.when(stale, F.col("ship_day"))).cast("string"), F.lit("")).alias("as_of"), F.bool_or(stale).alias("stale_used")
    )


@query("menu_days", """
SELECT cafeteria, day, string_agg(name || ': ' || items, ' / ' ORDER BY name) AS sections FROM (
  SELECT cafeteria, day, name, string_agg(item, ', ' ORDER BY item) AS items FROM (
    SELECT DISTINCT l_returnflag AS cafeteria, strftime(l_shipdate, '%Y-%m-%d') AS day, 'S' || l_linenumber AS name, p_name AS item FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1, 2, 3) GROUP BY 1, 2
""")
def menu_days(spark, d):
    dishes = (
        inputs.dishes(spark, d)
        .select(
            F.col("l_returnflag").alias("cafeteria"), inputs.day_text("l_shipdate").alias("day"),
            F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("name"), F.col("p_name").alias("item"),
        )
        .distinct()
    )
    sections = dishes.groupBy("cafeteria", "day", "name").agg(F.array_join(F.sort_array(F.collect_list("item")), ", ").alias("items"))
    listed = F.sort_array(F.collect_list(F.struct("name", F.concat(F.col("name"), F.lit(": "), F.col("items")).alias("text"))))
    return sections.groupBy("cafeteria", "day").agg(F.array_join(F.transform(listed, lambda x: x["text"]), " / ").alias("sections"))


@query("collect_stats", """
SELECT board, CASE WHEN notice_id % 7 = 0 THEN 'invalid' WHEN published IS NULL THEN 'undated' WHEN contains(title, '변경') THEN 'updated' ELSE 'new' END AS decision, count(*) AS n FROM notices GROUP BY 1, 2
""", "notices")
def collect_stats(spark, d):
    decision = (
        F.when(F.col("notice_id") % 7 == 0, "invalid").when(F.col("published").isNull(), "undated")
        .when(F.col("title").contains("변경"), "updated").otherwise("new")
    )
    return inputs.notices(spark, d).groupBy("board", decision.alias("decision")).agg(F.count("*").alias("n"))


@query("index_fingerprint", """
SELECT substr(sha256(string_agg(o_orderkey || ':' || o_orderstatus || ':' || strftime(o_orderdate, '%Y-%m-%d'), '|' ORDER BY o_orderdate DESC, o_orderkey DESC)), 1, 16) AS fingerprint
FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5)
""")
def index_fingerprint(spark, d):
    latest = inputs.table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(5)
    runs = F.sort_array(
        F.collect_list(F.struct("o_orderdate", "o_orderkey", F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus", inputs.day_text("o_orderdate")).alias("text"))), asc=False
    )
    return latest.agg(F.left(F.sha2(F.array_join(F.transform(runs, lambda r: r["text"]), "|"), 256), F.lit(16)).alias("fingerprint"))


@query("coverage_failed", """
SELECT DISTINCT query_masked AS question FROM turns WHERE outcome NOT IN ('answer', 'ask') ORDER BY 1
""", "turns")
def coverage_failed(spark, d):
    return inputs.turns(spark, d).where(~F.col("outcome").isin("answer", "ask")).select(F.col("query_masked").alias("question")).distinct().orderBy("question")


@query("faq_groups", """
SELECT month, label, hot, questions, row_number() OVER (PARTITION BY month ORDER BY NOT hot, first_key) AS place FROM (
  SELECT m.month, p_type AS label, bool_or(p_size % 12 + 1 = m.month) AS hot, count(*) AS questions, min(p_partkey) AS first_key
  FROM part, (SELECT cast(unnest(range(1, 13)) AS INTEGER) AS month) m GROUP BY 1, 2)
""")
def faq_groups(spark, d):
    part = inputs.table(spark, d, "part")
    months = F.collect_set((F.col("p_size") % 12 + 1).cast("int"))
    groups = part.groupBy(F.col("p_type").alias("label")).agg(
        months.alias("months"), F.count("*").alias("questions"), F.min("p_partkey").alias("first_key")
    )
    rows = groups.select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")).withColumn("hot", F.array_contains("months", F.col("month")))
    place = F.row_number().over(Window.partitionBy("month").orderBy(~F.col("hot"), "first_key")).cast("long")
    return rows.select("month", "label", "hot", "questions", place.alias("place"))

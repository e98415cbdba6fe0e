"""Inputs of the catalog, derived from the given tables.

Each input exists twice: as a DataFrame function and as a registered SQL view of the same
name, so that a query and its SQL text start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.rules import FALLBACK_REASONS
from plumbline.registry import sql_array, view
from plumbline.session import spread

TOPICS = ("휴학", "복학", "장학", "수강신청", "졸업")
STEMS = (
    "휴학계를 내는 마지막 날이 궁금합니다", "장학 대상자는 무슨 기준으로 뽑나요?", "졸업까지 몇 과목이 남았는지 보고 싶어요", "중앙도서관 반납함은 어디쯤이에요?",
    "내일 점심 메뉴 중에 국수가 있나요?", "수강 포기 마감이 며칠이죠?", "기숙사 방을 바꿀 자격이 되나요?", "학과 사무실 전화번호가 필요합니다",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows carry heavy work, on all cores even when it is one file split."""
    key = {"lineitem": "l_orderkey", "documents": "doc_id", "pages": "page_id", "orders": "o_orderkey"}[name]
    return spread(table(spark, sf_dir, name), key)


def pick(values, index) -> F.Column:
    """The index-th (0-based) of a fixed list of strings."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def ts_text(column) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def day_text(column) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd")


def dishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their part, sorted and merged: a file of parts is far smaller than the table of its rows a broadcast would build."""
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").hint("merge"), F.col("l_partkey") == F.col("p_partkey"))


# ── turns ────────────────────────────────────────────────────────────────────────────────
def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    outcome = (
        F.when(F.col("event_type") == "purchase", "fallback")
        .when(F.col("event_type") == "signup", "ask")
        .when(F.col("event_type") == "error", "error")
        .otherwise("answer")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("turn_id"),
        F.col("user_id").alias("thread_id"),
        F.col("ts").alias("created_at"),
        day_text("ts").alias("day"),
        outcome.alias("outcome"),
        F.when(F.col("event_type") == "purchase", pick(FALLBACK_REASONS, k % 5)).alias("fallback_reason"),
        F.round(F.col("value") * 100).cast("int").alias("elapsed_ms"),
        k.alias("k"),
        F.concat(pick(STEMS, k % 8), F.lit(" "), k.cast("string")).alias("query_masked"),
    )


view("turns", f"""
SELECT event_id AS turn_id, user_id AS thread_id, ts AS created_at, strftime(ts, '%Y-%m-%d') AS day,
  CASE event_type WHEN 'purchase' THEN 'fallback' WHEN 'signup' THEN 'ask' WHEN 'error' THEN 'error' ELSE 'answer' END AS outcome,
  CASE WHEN event_type = 'purchase' THEN {sql_array(FALLBACK_REASONS)}[k % 5 + 1] END AS fallback_reason,
  cast(round(value * 100) AS INTEGER) AS elapsed_ms, k,
  {sql_array(STEMS)}[k % 8 + 1] || ' ' || k AS query_masked
FROM (SELECT *, cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
""")


# ── votes ────────────────────────────────────────────────────────────────────────────────
def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    action = (
        F.when(F.col("event_type").isin("click", "view"), "confirm")
        .when(F.col("event_type") == "purchase", "dispute")
        .when(F.col("event_type") == "error", "flag")
    )
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") != "signup")
        .select(
            "event_id",
            (k % 20).alias("tip_id"),
            F.col("user_id").alias("token"),
            (F.col("user_id") % 7).cast("int").alias("net"),
            action.alias("action"),
            "ts",
        )
    )


view("votes", """
SELECT event_id, k % 20 AS tip_id, user_id AS token, cast(user_id % 7 AS INTEGER) AS net,
  CASE WHEN event_type IN ('click', 'view') THEN 'confirm' WHEN event_type = 'purchase' THEN 'dispute' ELSE 'flag' END AS action, ts
FROM (SELECT *, cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE event_type <> 'signup'
""")


# ── notices ──────────────────────────────────────────────────────────────────────────────
def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices_of(wide(spark, sf_dir, "orders"))


def notices_of(orders: DataFrame) -> DataFrame:
    n, start = F.col("o_orderkey"), F.add_months(F.to_date("o_orderdate"), 336)
    end = F.date_add(start, (n % 90).cast("int"))
    dots = lambda d: F.concat_ws(". ", F.month(d), F.dayofmonth(d))
    period = (
        F.when(n % 7 == 0, F.lit("13. 40."))
        .when(n % 5 == 0, F.concat(F.month(end).cast("string"), F.lit("월 "), F.dayofmonth(end).cast("string"), F.lit("일까지")))
        .when(n % 3 == 0, F.concat(F.year(start).cast("string"), F.lit(". "), dots(start), F.lit(". ~ "), dots(end), F.lit(".")))
        .otherwise(F.concat(start.cast("string"), F.lit(" ~ "), end.cast("string")))
    )
    topic = pick(TOPICS, n % 5)
    return orders.select(
        n.alias("notice_id"),
        F.col("o_orderpriority").alias("board"),
        topic.alias("topic"),
        F.concat(topic, F.when(n % 4 == 0, F.lit(" 변경")).otherwise(F.lit("")), F.lit(" 안내 "), period).alias("title"),
        F.concat(F.lit("대상 "), F.col("o_custkey").cast("string"), F.lit("명, "), topic, F.lit(" 기간 확인")).alias("summary"),
        F.when(n % 11 != 0, F.date_sub(start, 3)).alias("published"),
        start.alias("start_date"),
        end.alias("end_date"),
        F.concat(F.lit("https://www.campus.example/board/"), n.cast("string")).alias("url"),
        F.col("o_orderstatus").alias("flag"),
        F.col("o_custkey").alias("cust"),
    )


view("notices", f"""
SELECT n AS notice_id, o_orderpriority AS board, topic,
  topic || CASE WHEN n % 4 = 0 THEN ' 변경' ELSE '' END || ' 안내 ' ||
  CASE WHEN n % 7 = 0 THEN '13. 40.'
       WHEN n % 5 = 0 THEN month(e) || '월 ' || day(e) || '일까지'
       WHEN n % 3 = 0 THEN year(s) || '. ' || month(s) || '. ' || day(s) || '. ~ ' || month(e) || '. ' || day(e) || '.'
       ELSE strftime(s, '%Y-%m-%d') || ' ~ ' || strftime(e, '%Y-%m-%d') END AS title,
  '대상 ' || o_custkey || '명, ' || topic || ' 기간 확인' AS summary,
  CASE WHEN n % 11 <> 0 THEN s - 3 END AS published, s AS start_date, e AS end_date,
  'https://www.campus.example/board/' || n AS url, o_orderstatus AS flag, o_custkey AS cust
FROM (SELECT *, o_orderkey AS n, cast(o_orderdate + INTERVAL 28 YEAR AS DATE) AS s,
  cast(o_orderdate + INTERVAL 28 YEAR AS DATE) + cast(o_orderkey % 90 AS INTEGER) AS e, {sql_array(TOPICS)}[o_orderkey % 5 + 1] AS topic FROM orders)
""")


# ── calendar ─────────────────────────────────────────────────────────────────────────────
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("cal_id"))
        .agg(
            F.to_date(F.min("l_shipdate")).alias("start_date"),
            F.to_date(F.max("l_shipdate")).alias("end_date"),
            F.count("*").alias("n_lines"),
        )
        .withColumn("topic", pick(TOPICS, F.col("cal_id") % 5))
        .withColumn("title", F.concat("topic", F.lit(" 기간 "), F.col("cal_id").cast("string")))
        .withColumn(
            "status",
            F.when(F.col("cal_id") % 10 == 0, "hidden").when(F.col("cal_id") % 10 == 1, "pending").otherwise("active"),
        )
    )


view("calendar", f"""
SELECT l_orderkey AS cal_id, cast(min(l_shipdate) AS DATE) AS start_date, cast(max(l_shipdate) AS DATE) AS end_date,
  count(*) AS n_lines, {sql_array(TOPICS)}[l_orderkey % 5 + 1] AS topic,
  {sql_array(TOPICS)}[l_orderkey % 5 + 1] || ' 기간 ' || l_orderkey AS title,
  CASE l_orderkey % 10 WHEN 0 THEN 'hidden' WHEN 1 THEN 'pending' ELSE 'active' END AS status
FROM lineitem GROUP BY l_orderkey
""")


# ── facts: an evidence text and a drafted sentence per line item ────────────────────────────
def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    qty = F.floor("l_quantity").cast("int")
    ln = F.col("l_linenumber")
    price = F.floor("l_extendedprice").cast("string")
    day = day_text("l_shipdate")
    quote = F.concat(F.lit("학생은 최대 "), qty.cast("string"), F.lit("학점까지 신청할 수 있다"))
    evidence = F.concat(quote, F.lit(". 등록금은 "), price, F.lit("원이고 접수는 "), day, F.lit("부터 하여야 한다."))
    sentence = (
        F.when(ln % 7 == 1, F.concat(F.lit("학생은 최대 "), (qty + 1).cast("string"), F.lit("학점까지 신청할 수 있다")))
        .when(ln % 7 == 2, F.concat(F.lit("최대 "), qty.cast("string"), F.lit("학점까지 신청할 수 없다")))
        .when(ln % 7 == 3, F.concat(F.lit("제3조 제2항에 따라 최대 "), qty.cast("string"), F.lit("학점까지 신청할 수 있습니다")))
        .when(ln % 7 == 4, F.concat(F.lit("다만 최대 "), qty.cast("string"), F.lit("학점입니다")))
        .otherwise(F.concat(F.lit("최대 "), qty.cast("string"), F.lit("학점까지 신청할 수 있어요")))
    )
    given_quote = (
        F.when(ln % 7 == 5, F.lit("학생은"))
        .when(ln % 7 == 6, F.lit("전혀 없는 문장을 인용한다"))
        .otherwise(quote)
    )
    return wide(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("turn_id"),
        (F.col("l_orderkey") * 100 + ln).alias("fact_id"),
        ln.alias("idx"),
        F.concat_ws("_", F.col("l_partkey").cast("string"), F.lit("main"), ln.cast("string")).alias("evidence_id"),
        evidence.alias("evidence_text"),
        sentence.alias("sentence"),
        given_quote.alias("quote"),
        F.to_date("l_shipdate").alias("ship_day"),
        qty.alias("qty"),
        F.floor("l_extendedprice").alias("price"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_returnflag").alias("flag"),
    )


view("facts", """
SELECT l_orderkey AS turn_id, l_orderkey * 100 + ln AS fact_id, ln AS idx, l_partkey || '_main_' || ln AS evidence_id,
  '학생은 최대 ' || qty || '학점까지 신청할 수 있다. 등록금은 ' || cast(floor(l_extendedprice) AS BIGINT) || '원이고 접수는 ' || strftime(l_shipdate, '%Y-%m-%d') || '부터 하여야 한다.' AS evidence_text,
  CASE ln % 7 WHEN 1 THEN '학생은 최대 ' || (qty + 1) || '학점까지 신청할 수 있다'
    WHEN 2 THEN '최대 ' || qty || '학점까지 신청할 수 없다'
    WHEN 3 THEN '제3조 제2항에 따라 최대 ' || qty || '학점까지 신청할 수 있습니다'
    WHEN 4 THEN '다만 최대 ' || qty || '학점입니다'
    ELSE '최대 ' || qty || '학점까지 신청할 수 있어요' END AS sentence,
  CASE ln % 7 WHEN 5 THEN '학생은' WHEN 6 THEN '전혀 없는 문장을 인용한다'
    ELSE '학생은 최대 ' || qty || '학점까지 신청할 수 있다' END AS quote,
  cast(l_shipdate AS DATE) AS ship_day, qty, cast(floor(l_extendedprice) AS BIGINT) AS price, l_partkey AS part, l_suppkey AS supp, l_returnflag AS flag
FROM (SELECT *, l_linenumber AS ln, cast(floor(l_quantity) AS INTEGER) AS qty FROM lineitem)
""")


# ── sections: one per line of a document ──────────────────────────────────────────────────────
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return (
        wide(spark, sf_dir, "documents")
        .select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "body"))
        .select(
            F.concat(doc.cast("string"), F.lit("_main_"), F.col("line_no").cast("string")).alias("section_id"),
            "doc_id",
            "line_no",
            "lang",
            "source",
            pick(("rule", "guide", "notice"), doc % 3).alias("source_kind"),
            F.when(doc % 13 == 0, "private").otherwise("public").alias("access"),
            "body",
        )
    )


view("sections", """
SELECT doc_id || '_main_' || line_no AS section_id, doc_id, line_no, lang, source,
  ['rule', 'guide', 'notice'][doc_id % 3 + 1] AS source_kind, CASE WHEN doc_id % 13 = 0 THEN 'private' ELSE 'public' END AS access, body
FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS body,
  cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no FROM documents)
""")


# ── tips: one per order ─────────────────────────────────────────────────────────────────────────
TIP_STATUS = ("approved", "student_approved", "verifying", "rejected")


def tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, ts = F.col("o_orderkey"), F.col("o_orderdate")
    later = lambda mod: F.date_add(F.to_date(ts), (n % mod).cast("int")).cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        n.alias("tip_id"),
        pick(TIP_STATUS, n % 4).alias("status"),
        ts.alias("approved_at"),
        later(200).alias("confirm_1"),
        later(120).alias("confirm_2"),
        (n % 5).cast("int").alias("n_votes"),
        F.col("o_custkey").alias("author"),
    )


view("tips", f"""
SELECT o_orderkey AS tip_id, {sql_array(TIP_STATUS)}[o_orderkey % 4 + 1] AS status, o_orderdate AS approved_at,
  cast(cast(o_orderdate AS DATE) + cast(o_orderkey % 200 AS INTEGER) AS TIMESTAMP) AS confirm_1,
  cast(cast(o_orderdate AS DATE) + cast(o_orderkey % 120 AS INTEGER) AS TIMESTAMP) AS confirm_2,
  cast(o_orderkey % 5 AS INTEGER) AS n_votes, o_custkey AS author FROM orders
""")


# ── ballots: votes on tips, one tip per order ─────────────────────────────────────────────────────
def ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    qty = F.floor("l_quantity").cast("int")
    return wide(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 1000 + qty * 10 + F.col("l_linenumber")).alias("event_id"),
        F.col("l_orderkey").alias("tip_id"),
        (F.col("l_linenumber") % 5).cast("long").alias("token"),
        (F.col("l_suppkey") % 4).cast("int").alias("net"),
        F.when(qty % 9 == 0, "flag").when(qty % 3 == 1, "dispute").otherwise("confirm").alias("action"),
        F.col("l_shipdate").alias("ts"),
    )


view("ballots", """
SELECT l_partkey * 1000000 + l_suppkey * 1000 + qty * 10 + l_linenumber AS event_id, l_orderkey AS tip_id, cast(l_linenumber % 5 AS BIGINT) AS token,
  cast(l_suppkey % 4 AS INTEGER) AS net, CASE WHEN qty % 9 = 0 THEN 'flag' WHEN qty % 3 = 1 THEN 'dispute' ELSE 'confirm' END AS action, l_shipdate AS ts
FROM (SELECT *, cast(floor(l_quantity) AS INTEGER) AS qty FROM lineitem)
""")


# ── item_days: one evaluation result per question and day ───────────────────────────────────────────
def item_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("item_id"), day_text("ts").alias("day"))
        .agg((F.max("value") > 90).alias("ok"), F.min(F.get_json_object("props", "$.k").cast("int")).alias("low"))
        .select(
            "item_id",
            "day",
            "ok",
            pick(("seed", "unanswered", "report"), F.col("item_id") % 3).alias("source"),
            F.when(F.col("low") == 3, "quota_exceeded").when(F.col("ok"), "ok").otherwise("no_evidence").alias("reason"),
        )
    )


view("item_days", """
SELECT item_id, day, ok, ['seed', 'unanswered', 'report'][item_id % 3 + 1] AS source,
  CASE WHEN low = 3 THEN 'quota_exceeded' WHEN ok THEN 'ok' ELSE 'no_evidence' END AS reason
FROM (SELECT user_id AS item_id, strftime(ts, '%Y-%m-%d') AS day, max(value) > 90 AS ok, min(cast(json_extract_string(props, '$.k') AS INTEGER)) AS low FROM events GROUP BY 1, 2)
""")


# ── eval_results: labelled items with the turn that answered them ─────────────────────────────────────
ITEM_TYPES = ("rule", "procedure", "notice", "calendar", "menu", "location", "oos")


def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    ids = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda j: (n * 31 + j * 17) % 50)
    return table(spark, sf_dir, "labels").select(
        n.alias("item_id"),
        pick(ITEM_TYPES, n % 7).alias("type"),
        ids.alias("retrieved"),
        F.array((n * 7) % 50, F.when(n % 3 == 0, (n * 31 + 51) % 50).otherwise((n * 7) % 50)).alias("any_of"),
        F.when(n % 4 == 0, F.array((n * 31) % 50)).otherwise(F.array().cast("array<bigint>")).alias("all_of"),
        pick(("rule", "guide"), n % 2).alias("want_kind"),
        pick(("article", "guide", "article"), n % 3).alias("kind"),
        pick(("answer", "answer", "answer", "fallback"), (n / 7).cast("long") % 4).alias("outcome"),
        pick(("out_of_scope", "no_evidence"), n % 2).alias("reason"),
        (n % 5 != 0).alias("cited"),
        (n % 3 != 0).alias("has_actions"),
        (F.col("quality") == 1).alias("facts_ok"),
        (F.col("toxic") == 0).alias("errors_ok"),
        (n % 11 != 0).alias("labeled"),
        F.lit(5).alias("verify_total"),
        (n % 6).cast("int").alias("verify_kept"),
    )


view("eval_results", f"""
SELECT doc_id AS item_id, {sql_array(ITEM_TYPES)}[doc_id % 7 + 1] AS type,
  list_transform(range(0, 7), lambda j: (doc_id * 31 + j * 17) % 50) AS retrieved,
  [(doc_id * 7) % 50, CASE WHEN doc_id % 3 = 0 THEN (doc_id * 31 + 51) % 50 ELSE (doc_id * 7) % 50 END] AS any_of,
  CASE WHEN doc_id % 4 = 0 THEN [(doc_id * 31) % 50] ELSE [] END AS all_of,
  ['rule', 'guide'][doc_id % 2 + 1] AS want_kind, ['article', 'guide', 'article'][doc_id % 3 + 1] AS kind,
  ['answer', 'answer', 'answer', 'fallback'][(doc_id // 7) % 4 + 1] AS outcome, ['out_of_scope', 'no_evidence'][doc_id % 2 + 1] AS reason,
  doc_id % 5 <> 0 AS cited, doc_id % 3 <> 0 AS has_actions, quality = 1 AS facts_ok, toxic = 0 AS errors_ok, doc_id % 11 <> 0 AS labeled,
  5 AS verify_total, cast(doc_id % 6 AS INTEGER) AS verify_kept FROM labels
""")


# ── regulation lines: document lines with heads, addenda and appendices put in by line number ─────────
def regulation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, doc, body = F.col("line_no"), F.col("doc_id"), F.col("body")
    s = lambda c: c.cast("string")
    chapter = F.concat(F.lit("제"), s(F.floor(n / 29) + 1), F.lit("장 총칙"))
    number = s(F.floor(n / 6) + 1)
    line = (
        F.when((n % 23 == 9) & (doc % 2 == 0), F.lit("부칙 (2023. 9. 1.)"))
        .when(n % 23 == 9, F.lit("부 칙"))
        .when((n % 23 == 10) & (doc % 2 == 1), F.concat(F.lit("99. 3. 2. 시행 "), body))
        .when(n % 23 == 15, F.concat(F.lit("[별표 1] <개정 2024. 1. 1.> "), s(doc)))
        .when(n % 23 == 18, F.lit("[별표 1]"))
        .when((n % 23).isin(16, 17, 19, 20, 21), body)
        .when(n % 29 == 1, chapter)
        .when(n % 29 == 7, F.lit("제1절  통칙"))
        .when((n % 12 == 2) & (doc % 5 == 0), F.concat(F.lit("제"), number, F.lit("조 <삭제> <개정 2020. 1. 1.>")))
        .when((n % 12 == 8) & (doc % 3 == 0), F.concat(F.lit("제"), number, F.lit("조의2(특례) "), body))
        .when(n % 6 == 2, F.concat(F.lit("제"), number, F.lit("조(목적) "), body, F.lit(" <개정 2024. 3. 5.>")))
        .when((n % 6 == 4) & (doc % 4 != 0), F.concat(F.substring(F.lit("①②③④⑤⑥⑦⑧⑨⑩"), F.floor(n / 6).cast("int") % 10 + 1, F.lit(1)), F.lit(" "), body))
        .when(n % 6 == 5, F.concat(F.lit("  "), body, F.lit(" \t 끝 ")))
        .otherwise(body)
    )
    return sections(spark, sf_dir).select(doc.alias("rule_no"), "line_no", line.alias("raw"))


view("regulation_lines", """
SELECT doc_id AS rule_no, n AS line_no, CASE
 WHEN n % 23 = 9 AND doc_id % 2 = 0 THEN '부칙 (2023. 9. 1.)'
 WHEN n % 23 = 9 THEN '부 칙'
 WHEN n % 23 = 10 AND doc_id % 2 = 1 THEN '99. 3. 2. 시행 ' || body
 WHEN n % 23 = 15 THEN '[별표 1] <개정 2024. 1. 1.> ' || doc_id
 WHEN n % 23 = 18 THEN '[별표 1]'
 WHEN n % 23 IN (16, 17, 19, 20, 21) THEN body
 WHEN n % 29 = 1 THEN '제' || (n // 29 + 1) || '장 총칙'
 WHEN n % 29 = 7 THEN '제1절  통칙'
 WHEN n % 12 = 2 AND doc_id % 5 = 0 THEN '제' || (n // 6 + 1) || '조 <삭제> <개정 2020. 1. 1.>'
 WHEN n % 12 = 8 AND doc_id % 3 = 0 THEN '제' || (n // 6 + 1) || '조의2(특례) ' || body
 WHEN n % 6 = 2 THEN '제' || (n // 6 + 1) || '조(목적) ' || body || ' <개정 2024. 3. 5.>'
 WHEN n % 6 = 4 AND doc_id % 4 <> 0 THEN substr('①②③④⑤⑥⑦⑧⑨⑩', (n // 6) % 10 + 1, 1) || ' ' || body
 WHEN n % 6 = 5 THEN '  ' || body || ' ' || chr(9) || ' 끝 '
 ELSE body END AS raw
FROM (SELECT *, line_no AS n FROM sections)
""", ("sections",))


# ── drafts and their evidence ─────────────────────────────────────────────────────────────────────────
def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("part") % 29
    none = F.array().cast("array<string>")
    return facts(spark, sf_dir).select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("turn_id", "idx", "part", "supp", "qty", "price")]).alias("sid"),
        "turn_id",
        pick(("sentences", "sentences", "checklist", "next_actions"), F.col("supp") % 4).alias("section"),
        F.col("sentence").alias("text"),
        F.when(p == 0, none).when(p == 2, F.array(F.concat("evidence_id", F.lit("x")))).otherwise(F.array("evidence_id")).alias("cite_ids"),
        F.when(p == 1, none).when(p == 3, F.array(F.col("quote"), F.lit("원이고 접수는"))).otherwise(F.array("quote")).alias("quotes"),
    )


view("drafts", """
SELECT turn_id || '-' || idx || '-' || part || '-' || supp || '-' || qty || '-' || price AS sid, turn_id, ['sentences', 'sentences', 'checklist', 'next_actions'][supp % 4 + 1] AS section, sentence AS text,
  CASE WHEN part % 29 = 0 THEN [] WHEN part % 29 = 2 THEN [evidence_id || 'x'] ELSE [evidence_id] END AS cite_ids,
  CASE WHEN part % 29 = 1 THEN [] WHEN part % 29 = 3 THEN [quote, '원이고 접수는'] ELSE [quote] END AS quotes FROM facts
""", ("facts",))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("turn_id", "evidence_id").agg(F.max("evidence_text").alias("text"), F.max("qty").alias("qty"))


view("evidence", "SELECT turn_id, evidence_id, max(evidence_text) AS text, max(qty) AS qty FROM facts GROUP BY 1, 2", ("facts",))

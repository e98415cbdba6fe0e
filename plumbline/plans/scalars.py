"""Scalar functions over derived inputs."""

from pyspark.sql import functions as F

from plumbline.functions import dates, ids, labels, rules, text
from plumbline.plans import inputs
from plumbline.registry import query, sql_array, sql_list, sql_text, view

_DAY = "strftime({}, '%Y-%m-%d')"


def _reference():
    return F.coalesce("published", F.lit("2026-06-15").cast("date"))


_REF = "coalesce(published, DATE '2026-06-15')"


# ── masks and normal forms ────────────────────────────────────────────────────────────────
@query("mask_pii", r"""
SELECT doc_id, regexp_replace(
  regexp_replace(regexp_replace(
   regexp_replace(regexp_replace(
    regexp_replace(t, '[\pL\pN_.+-]+@[\pL\pN_-]+(?:\.[\pL\pN_-]+)+', '[이메일]', 'g'),
    '(^|[^0-9])01[0-9]-?[0-9]{3,4}-?[0-9]{4}($|[^0-9])', '\1[전화]\2', 'g'),
    '(^|[^0-9])01[0-9]-?[0-9]{3,4}-?[0-9]{4}($|[^0-9])', '\1[전화]\2', 'g'),
   '(^|[^0-9])[0-9]{8,10}($|[^0-9])', '\1[학번]\2', 'g'), '(^|[^0-9])[0-9]{8,10}($|[^0-9])', '\1[학번]\2', 'g'),
  '(제\s*이름은\s*)[가-힣]{2,4}', '\1[이름]', 'g') AS masked
FROM (SELECT doc_id, text || ' 제 이름은 임푸름 010-1234-5678, ' || (20200000 + doc_id) AS t FROM documents)
""")
def mask_pii(spark, d):
    body = F.concat("text", F.lit(" 제 이름은 임푸름 010-1234-5678, "), (F.col("doc_id") + 20200000).cast("string"))
    return inputs.wide(spark, d, "documents").select("doc_id", text.mask_pii(body).alias("masked"))


@query("norm_text", r"""
SELECT notice_id, lower(regexp_replace(title, '[^\p{L}\p{N}]+', '', 'g')) AS compact,
  trim(regexp_replace(title, '\s+', ' ', 'g')) AS spaces,
  lower(regexp_replace(title, '[\s\-_.()]+', '', 'g')) AS name,
  regexp_replace(title, '\s+', '', 'g') AS joined
FROM notices
""", "notices")
def norm_text(spark, d):
    t = F.col("title")
    return inputs.notices(spark, d).select(
        "notice_id", text.norm_compact(t).alias("compact"), text.norm_spaces(t).alias("spaces"),
        text.norm_name(t).alias("name"), text.no_spaces(t).alias("joined"),
    )


# ── identifiers ───────────────────────────────────────────────────────────────────────────
@query("stable_ids", """
SELECT notice_id, substr(sha256('notice|' || url || '|' || title || '|' || strftime(end_date, '%Y-%m-%d')), 1, 20) AS event_id,
  substr(sha256('notice3|' || url), 1, 20) AS scan_id, substr(sha256(url), 1, 12) AS page_id,
  substr(sha1(url), 1, 16) AS candidate_id, 'b-' || substr(sha1(title), 1, 12) AS place_id,
  sha1(regexp_replace(title, '\\s+', '', 'g')) AS question_id, substr(sha256(summary), 1, 24) AS document_id
FROM notices
""", "notices")
def stable_ids(spark, d):
    url, title = F.col("url"), F.col("title")
    return inputs.notices(spark, d).select(
        "notice_id",
        ids.event_id(F.lit("notice"), url, title, F.col("end_date")).alias("event_id"),
        ids.short_sha256(F.concat(F.lit("notice3|"), url), 20).alias("scan_id"),
        ids.short_sha256(url, 12).alias("page_id"),
        ids.short_sha1(url, 16).alias("candidate_id"),
        F.concat(F.lit("b-"), ids.short_sha1(title, 12)).alias("place_id"),
        F.sha1(text.no_spaces(title)).alias("question_id"),
        ids.short_sha256(F.col("summary"), 24).alias("document_id"),
    )


@query("keyed_hash")
def keyed_hash(spark, d):
    digest = ids.keyed_hash(spark.conf.get("spark.plumbline.hmac.key", "test-only-key").encode())
    address = F.concat_ws("|", F.to_date("ts").cast("string"), F.col("user_id").cast("string"))
    return (
        inputs.table(spark, d, "events").select(address.alias("address")).distinct()
        .select("address", digest("address").alias("net"))
    )


# ── dates ─────────────────────────────────────────────────────────────────────────────────
_D = r"(?:(20\d{2})\s*(?:[./-]|년)\s*)?(\d{1,2})\s*(?:[./-]|월)\s*(\d{1,2})\s*(?:일|\.)?(?:\s*\([월화수목금토일]\))?"
_T = r"(?:\s*\d{1,2}\s*:\s*\d{2})?"
_RANGE = rf"(?:^|[^0-9]){_D}{_T}\s*[~∼～]\s*{_D}(?:$|[^0-9])"
_DUE = rf"(?:^|[^0-9]){_D}{_T}\s*(?:까지|마감)"


def _g(pattern: str, i: int, column: str = "title") -> str:
    return f"try_cast(nullif(regexp_extract({column}, {sql_text(pattern)}, {i}), '') AS INTEGER)"


def _infer(y: str, m: str, ref: str) -> str:
    return (
        f"coalesce({y}, CASE WHEN {m} - month({ref}) <= -6 THEN year({ref}) + 1 "
        f"WHEN {m} - month({ref}) >= 6 THEN year({ref}) - 1 ELSE year({ref}) END)"
    )


def _date(y: str, m: str, dd: str) -> str:
    return f"try_cast(printf('%04d-%02d-%02d', {y}, {m}, {dd}) AS DATE)"


view("title_periods", f"""
SELECT notice_id, CASE WHEN has_range THEN CASE WHEN s <= e AND e <= s + 60 THEN s END END AS period_start,
  CASE WHEN has_range THEN CASE WHEN s <= e AND e <= s + 60 THEN e END ELSE due END AS period_end
FROM (SELECT *, CASE WHEN e0 < s AND y2 IS NULL THEN {_date('cast(year(e0) + 1 AS INTEGER)', 'cast(month(e0) AS INTEGER)', 'cast(day(e0) AS INTEGER)')} ELSE e0 END AS e
FROM (SELECT *, CASE WHEN m2 IS NOT NULL AND (y2 IS NOT NULL OR s IS NOT NULL) THEN {_date(f"cast({_infer('y2', 'm2', '(CASE WHEN y2 IS NULL THEN s ELSE ref END)')} AS INTEGER)", 'm2', 'd2')} END AS e0
FROM (SELECT *, CASE WHEN m1 IS NOT NULL THEN {_date(f"cast({_infer('y1', 'm1', 'ref')} AS INTEGER)", 'm1', 'd1')} END AS s,
  CASE WHEN m3 IS NOT NULL THEN {_date(f"cast({_infer('y3', 'm3', 'ref')} AS INTEGER)", 'm3', 'd3')} END AS due
FROM (SELECT notice_id, {_REF} AS ref, regexp_matches(title, {sql_text(_RANGE)}) AS has_range,
  {_g(_RANGE, 1)} AS y1, {_g(_RANGE, 2)} AS m1, {_g(_RANGE, 3)} AS d1, {_g(_RANGE, 4)} AS y2, {_g(_RANGE, 5)} AS m2, {_g(_RANGE, 6)} AS d2,
  {_g(_DUE, 1)} AS y3, {_g(_DUE, 2)} AS m3, {_g(_DUE, 3)} AS d3 FROM notices))))
""", ("notices",))


@query("extract_period", """
SELECT notice_id, coalesce(strftime(period_start, '%Y-%m-%d'), '') AS period_start, coalesce(strftime(period_end, '%Y-%m-%d'), '') AS period_end
FROM title_periods
""", "title_periods")
def extract_period(spark, d):
    rows = inputs.notices(spark, d).select("notice_id", "title", _reference().alias("reference"))
    return dates.with_period(rows, "title", "reference").select(
        "notice_id",
        F.coalesce(F.col("period_start").cast("string"), F.lit("")).alias("period_start"),
        F.coalesce(F.col("period_end").cast("string"), F.lit("")).alias("period_end"),
    )


_NR = r"(?:^|[^0-9])" + rules.NOTICE_DATE + r"(?:$|[^0-9])"
_SHORT = "replace(replace(title, '. ', '.'), '년', '')"


@query("notice_range", f"""
SELECT notice_id, coalesce(strftime(s, '%Y-%m-%d'), '') AS range_start, coalesce(strftime(e, '%Y-%m-%d'), '') AS range_end
FROM (SELECT notice_id, CASE WHEN e IS NOT NULL THEN s END AS s, CASE WHEN s IS NOT NULL THEN e END AS e FROM (SELECT *,
  CASE WHEN m1 IS NOT NULL THEN {_date('cast(sy AS INTEGER)', 'm1', 'd1')} END AS s,
  CASE WHEN m1 IS NOT NULL THEN {_date('cast(coalesce(y2, sy + cast(coalesce(m2, m1) < m1 AS INTEGER)) AS INTEGER)', 'coalesce(m2, m1)', 'coalesce(d2, d1)')} END AS e
FROM (SELECT *, coalesce(y1, year({_REF})) AS sy FROM (SELECT *, {_g(_NR, 1, 't')} AS y1, {_g(_NR, 2, 't')} AS m1, {_g(_NR, 3, 't')} AS d1,
  {_g(_NR, 4, 't')} AS y2, {_g(_NR, 5, 't')} AS m2, {_g(_NR, 6, 't')} AS d2
 FROM (SELECT *, {_SHORT} AS t FROM notices)))))
""", "notices")
def notice_range(spark, d):
    short = F.regexp_replace(F.regexp_replace("title", r"\. ", "."), "년", "")
    p = dates.notice_range(short, _reference())
    return inputs.notices(spark, d).select("notice_id", p.alias("p")).select(
        "notice_id",
        F.coalesce(F.col("p.start").cast("string"), F.lit("")).alias("range_start"),
        F.coalesce(F.col("p.end").cast("string"), F.lit("")).alias("range_end"),
    )


_W = rules.WEEK_TITLE_DATE


def _week(shift: int) -> str:
    y = f"cast(year(published) + ({shift}) AS INTEGER)"
    return (
        f"CASE WHEN published >= {_date(y, 'm1', 'd1')} AND published <= "
        f"{_date(f'cast({y} + cast(m2 < m1 AS INTEGER) AS INTEGER)', 'm2', 'd2')} THEN {shift} END"
    )


@query("week_range", f"""
SELECT notice_id, coalesce(strftime({_date('cast(year(published) + shift AS INTEGER)', 'm1', 'd1')}, '%Y-%m-%d'), '') AS week_start,
  coalesce(strftime({_date('cast(year(published) + shift + cast(m2 < m1 AS INTEGER) AS INTEGER)', 'm2', 'd2')}, '%Y-%m-%d'), '') AS week_end
FROM (SELECT *, coalesce({_week(-1)}, {_week(0)}, {_week(1)}) AS shift FROM (
  SELECT notice_id, published, {_g(_W, 1, 't')} AS m1, {_g(_W, 2, 't')} AS d1, coalesce({_g(_W, 3, 't')}, {_g(_W, 1, 't')}) AS m2, coalesce({_g(_W, 4, 't')}, {_g(_W, 2, 't')}) AS d2
  FROM (SELECT notice_id, published, '주간식단 ' || month(start_date - 5) || '.' || day(start_date - 5) || ' ~ ' || month(start_date) || '.' || day(start_date) AS t FROM notices WHERE published IS NOT NULL)))
""", "notices")
def week_range(spark, d):
    first = F.date_sub("start_date", 5)
    part = lambda x: x.cast("string")
    title = F.concat(
        F.lit("주간식단 "), part(F.month(first)), F.lit("."), part(F.dayofmonth(first)), F.lit(" ~ "),
        part(F.month("start_date")), F.lit("."), part(F.dayofmonth("start_date")),
    )
    p = dates.week_range(title, F.col("published"))
    return inputs.notices(spark, d).where("published is not null").select("notice_id", p.alias("p")).select(
        "notice_id",
        F.coalesce(F.col("p.start").cast("string"), F.lit("")).alias("week_start"),
        F.coalesce(F.col("p.end").cast("string"), F.lit("")).alias("week_end"),
    )


_DOT = r"(?:^|[^0-9])(\d{2,4})\s*\.\s*(\d{1,2})\s*\.\s*(\d{1,2})"


@query("parse_loose_date", f"""
SELECT notice_id, coalesce(strftime({_date("cast(CASE WHEN y < 50 THEN y + 2000 WHEN y < 100 THEN y + 1900 ELSE y END AS INTEGER)", 'm', 'd')}, '%Y-%m-%d'), '') AS day
FROM (SELECT notice_id, coalesce({_g(_DOT, 1, 't')}, {_g(r'(?:^|[^0-9])(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일', 1, 't')}) AS y,
  coalesce({_g(_DOT, 2, 't')}, {_g(r'(?:^|[^0-9])(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일', 2, 't')}) AS m,
  coalesce({_g(_DOT, 3, 't')}, {_g(r'(?:^|[^0-9])(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일', 3, 't')}) AS d
FROM (SELECT notice_id, CASE notice_id % 3 WHEN 0 THEN '부칙 (' || (year(start_date) % 100) || '. ' || month(start_date) || '. ' || day(start_date) || '.)'
   WHEN 1 THEN '부칙 ' || year(start_date) || '년 ' || month(start_date) || '월 ' || day(start_date) || '일' ELSE '부칙 ' || (notice_id % 100 + 10) || '.2.30' END AS t FROM notices)) WHERE y IS NOT NULL
""", "notices")
def parse_loose_date(spark, d):
    s = F.col("start_date")
    y, m, dd = F.year(s), F.month(s).cast("string"), F.dayofmonth(s).cast("string")
    line = (
        F.when(F.col("notice_id") % 3 == 0, F.concat(F.lit("부칙 ("), (y % 100).cast("string"), F.lit(". "), m, F.lit(". "), dd, F.lit(".)")))
        .when(F.col("notice_id") % 3 == 1, F.concat(F.lit("부칙 "), y.cast("string"), F.lit("년 "), m, F.lit("월 "), dd, F.lit("일")))
        .otherwise(F.concat(F.lit("부칙 "), (F.col("notice_id") % 100 + 10).cast("string"), F.lit(".2.30")))
    )
    day = dates.loose_date(line)
    return inputs.notices(spark, d).select("notice_id", F.coalesce(day.cast("string"), F.lit("")).alias("day"))


@query("semester_of", """
SELECT notice_id, CASE WHEN month(s) <= 2 THEN (year(s) - 1) || '-2' ELSE year(s) || '-' || CASE WHEN month(s) <= 8 THEN '1' ELSE '2' END END AS semester,
  CASE WHEN month(s) BETWEEN 3 AND 8 THEN year(s) || '-03-01' ELSE f || '-09-01' END AS first_day,
  CASE WHEN month(s) BETWEEN 3 AND 8 THEN year(s) || '-08-31' ELSE strftime(make_date(f + 1, 3, 1) - 1, '%Y-%m-%d') END AS last_day
FROM (SELECT notice_id, start_date AS s, CASE WHEN month(start_date) >= 9 THEN year(start_date) ELSE year(start_date) - 1 END AS f FROM notices)
""", "notices")
def semester_of(spark, d):
    w = dates.semester_window(F.col("start_date"))
    return inputs.notices(spark, d).select(
        "notice_id", dates.semester_of(F.col("start_date")).alias("semester"),
        w["start"].cast("string").alias("first_day"), w["end"].cast("string").alias("last_day"),
    )


_DAY_WORDS = ("내일 학식", "모레 일정", "지난주 목요일 식단", "다음 주 월요일", "오늘 공지", "어제 메뉴", "금요 특강", "저번주 식단", "도서관 위치", "다음주 일요일")


@query("relative_day", f"""
SELECT notice_id, q AS question, strftime(CASE WHEN contains(q, '모레') THEN t + 2 WHEN contains(q, '내일') THEN t + 1 WHEN contains(q, '어제') THEN t - 1
  WHEN contains(q, '오늘') THEN t WHEN wd IS NOT NULL THEN base - cast(isodow(base) - 1 AS INTEGER) + wd ELSE base END, '%Y-%m-%d') AS day
FROM (SELECT *, CASE WHEN regexp_matches(q, '지난주|저번주|지난 주') THEN t - 7 WHEN regexp_matches(q, '다음주|다음 주') THEN t + 7 ELSE t END AS base,
  CASE WHEN contains(q2, '월요') THEN 0 WHEN contains(q2, '화요') THEN 1 WHEN contains(q2, '수요') THEN 2 WHEN contains(q2, '목요') THEN 3
    WHEN contains(q2, '금요') THEN 4 WHEN contains(q2, '토요') THEN 5 WHEN contains(q2, '일요') THEN 6 END AS wd
 FROM (SELECT notice_id, start_date AS t, {sql_array(_DAY_WORDS)}[notice_id % 10 + 1] AS q, replace({sql_array(_DAY_WORDS)}[notice_id % 10 + 1], ' ', '') AS q2 FROM notices))
""", "notices")
def relative_day(spark, d):
    q = inputs.pick(_DAY_WORDS, F.col("notice_id") % 10)
    return inputs.notices(spark, d).select("notice_id", q.alias("question"), "start_date").select(
        "notice_id", "question", dates.relative_day(F.col("question"), F.col("start_date")).cast("string").alias("day")
    )


# ── numbers, polarity, variants ──────────────────────────────────────────────────────────────
@query("date_variants", r"""
SELECT fact_id, evidence_text || ' ' || array_to_string(list_transform(regexp_extract_all(evidence_text, '(\d{4})\s*[-./]\s*(\d{1,2})\s*[-./]\s*(\d{1,2})', 0),
  lambda x: substr(x, 1, 4) || '년' || cast(substr(x, 6, 2) AS INTEGER) || '월' || cast(substr(x, 9, 2) AS INTEGER) || '일 ' ||
   cast(substr(x, 6, 2) AS INTEGER) || '월' || cast(substr(x, 9, 2) AS INTEGER) || '일 ' ||
   cast(substr(x, 6, 2) AS INTEGER) || '월 ' || cast(substr(x, 9, 2) AS INTEGER) || '일 ' || substr(x, 1, 4) || '년'), ' ') AS expanded
FROM facts
""", "facts")
def date_variants(spark, d):
    return inputs.facts(spark, d).select("fact_id", text.date_variants(F.col("evidence_text")).alias("expanded"))


@query("table_variants", r"""
SELECT fact_id, line || ' ' || qty || '학점 ' || (qty * 1000) || '원 ' || (qty * 1000) || '원' AS expanded
FROM (SELECT fact_id, qty, '[표] 졸업학점: ' || qty || ' · 요금: ￦' || (qty * 1000) || ' · 비고: 없음' AS line FROM facts)
""", "facts")
def table_variants(spark, d):
    qty = F.col("qty").cast("string")
    line = F.concat(
        F.lit("[표] 졸업학점: "), qty, F.lit(" · 요금: ￦"), (F.col("qty") * 1000).cast("string"), F.lit(" · 비고: 없음")
    )
    return inputs.facts(spark, d).select("fact_id", text.table_variants(line).alias("expanded"))


@query("unit_numbers", f"""
SELECT fact_id, array_to_string(regexp_extract_all(regexp_replace(sentence || ' ' || evidence_text, {sql_text(rules.CITATION_MARK)}, ' ', 'g'), {sql_text(rules.UNIT_NUMBER)}, 0), '|') AS numbers
FROM facts
""", "facts")
def unit_numbers(spark, d):
    both = F.concat_ws(" ", "sentence", "evidence_text")
    return inputs.facts(spark, d).select("fact_id", F.array_join(text.unit_numbers(both), "|").alias("numbers"))


view("fact_values", f"""
SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(evidence_text, {sql_text(rules.REPORT_VALUE)}, 0),
  lambda x: regexp_replace(regexp_extract(x, {sql_text(rules.REPORT_VALUE)}, 2), '\\s', '', 'g') || '=' || replace(regexp_extract(x, {sql_text(rules.REPORT_VALUE)}, 1), ',', '')))) AS evidence_values,
 list_sort(list_distinct(list_transform(regexp_extract_all(sentence, {sql_text(rules.REPORT_VALUE)}, 0),
  lambda x: regexp_replace(regexp_extract(x, {sql_text(rules.REPORT_VALUE)}, 2), '\\s', '', 'g') || '=' || replace(regexp_extract(x, {sql_text(rules.REPORT_VALUE)}, 1), ',', '')))) AS sentence_values
FROM facts
""", ("facts",))


@query("unit_value_map", """
SELECT fact_id, array_to_string(evidence_values, ',') AS value_text, array_to_string(sentence_values, ',') AS claim_text FROM fact_values
""", "fact_values")
def unit_value_map(spark, d):
    joined = lambda c: F.array_join(F.sort_array(text.report_values(F.col(c))), ",")
    return inputs.facts(spark, d).select(
        "fact_id", joined("evidence_text").alias("value_text"), joined("sentence").alias("claim_text")
    )


_POS_ORACLE = r"할\s*수\s*있|(?:^|[^불])가능(합|하|$)"


@query("polarity", f"""
SELECT fact_id, coalesce(CASE WHEN regexp_matches(sentence, {sql_text(rules.NEGATIVE)}) THEN 'neg' WHEN regexp_matches(sentence, {sql_text(_POS_ORACLE)}) THEN 'pos' END, '') AS claim,
  coalesce(CASE WHEN regexp_matches(evidence_text, {sql_text(rules.NEGATIVE)}) THEN 'neg' WHEN regexp_matches(evidence_text, {sql_text(_POS_ORACLE)}) THEN 'pos' END, '') AS source
FROM facts
""", "facts")
def polarity(spark, d):
    return inputs.facts(spark, d).select(
        "fact_id",
        F.coalesce(text.polarity(F.col("sentence")), F.lit("")).alias("claim"),
        F.coalesce(text.polarity(F.col("evidence_text")), F.lit("")).alias("source"),
    )


@query("phone_number", """
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '055-249-' || ext WHEN 1 THEN '055-' || ext || '-1234' ELSE '02-123-' || ext END AS full_number,
  CASE WHEN s_suppkey % 2 = 0 THEN '055-249-' || ext ELSE '010-1234-' || ext END AS formatted
FROM (SELECT s_suppkey, lpad(cast(s_suppkey % 10000 AS VARCHAR), 4, '0') AS ext FROM supplier)
""")
def phone_number(spark, d):
    key = F.col("s_suppkey")
    ext = F.lpad((key % 10000).cast("string"), 4, "0")
    raw = F.when(key % 3 == 0, F.concat(F.lit(" "), ext)).when(key % 3 == 1, F.concat(ext, F.lit("-1234"))).otherwise(F.concat(F.lit("02-123-"), ext))
    full = F.when(key % 2 == 0, F.concat(F.lit("(055) 249-"), ext)).otherwise(F.concat(F.lit("010 1234 "), ext))
    return inputs.table(spark, d, "supplier").select(
        "s_suppkey", text.phone_number(raw).alias("full_number"), text.phone_format(full).alias("formatted")
    )


# ── small labels ────────────────────────────────────────────────────────────────────────────
_RULE_NAMES = ("학칙", "장학금 지급 규정", "학사 시행세칙", "시설 관리 지침", "업무 요령", "위원회 내규")


@query("rule_level", f"""
SELECT p_partkey, CASE WHEN n LIKE '%세칙' THEN '시행세칙' WHEN n LIKE '%학칙' THEN '학칙' WHEN n LIKE '%규정' THEN '규정'
  WHEN n LIKE '%지침' OR n LIKE '%요령' THEN '지침' ELSE '기타' END AS level
FROM (SELECT p_partkey, p_name || ' ' || {sql_array(_RULE_NAMES)}[p_partkey % 6 + 1] AS n FROM part)
""")
def rule_level(spark, d):
    name = F.concat_ws(" ", "p_name", inputs.pick(_RULE_NAMES, F.col("p_partkey") % 6))
    return inputs.table(spark, d, "part").select("p_partkey", labels.rule_level(name).alias("level"))


@query("notice_topic", """
SELECT notice_id, coalesce(CASE WHEN contains(t, '수강신청') THEN '수강신청' WHEN contains(t, '휴학') THEN '휴학' WHEN contains(t, '복학') THEN '복학'
  WHEN contains(t, '등록') THEN '등록' WHEN contains(t, '졸업') THEN '졸업' END, '') AS topic
FROM (SELECT notice_id, replace(title, ' ', '') AS t FROM notices)
""", "notices")
def notice_topic(spark, d):
    return inputs.notices(spark, d).select(
        "notice_id", F.coalesce(labels.notice_topic(F.col("title")), F.lit("")).alias("topic")
    )


@query("notice_board", """
SELECT turn_id, CASE WHEN contains(query_masked, '장학') THEN 'scholarship' WHEN regexp_matches(query_masked, '일반공지|행사|채용') THEN 'general' ELSE 'academic' END AS board
FROM turns
""", "turns")
def notice_board(spark, d):
    return inputs.turns(spark, d).select(
        "turn_id", labels.notice_board(F.lit(None).cast("string"), F.col("query_masked")).alias("board")
    )


@query("notice_keyword", f"""
SELECT notice_id, array_to_string(list_filter(regexp_split_to_array('학사 ' || topic || ' 주요 안내', '\\s+'), lambda w: w <> '' AND NOT list_contains({sql_array(rules.GENERIC_TOPIC_WORDS)}, w)), ' ') AS keyword
FROM notices
""", "notices")
def notice_keyword(spark, d):
    topic = F.concat(F.lit("학사 "), F.col("topic"), F.lit(" 주요공지 안내"))
    topic = F.regexp_replace(topic, "주요공지", "주요 공지사항")
    return inputs.notices(spark, d).select("notice_id", labels.notice_keyword(topic).alias("keyword"))


@query("date_label", """
SELECT notice_id, CASE WHEN notice_id % 6 = 0 THEN '행사일' WHEN regexp_matches(title, '마감|까지') THEN '신청 마감' ELSE '기간' END AS label FROM notices
""", "notices")
def date_label(spark, d):
    raw = F.when(F.col("notice_id") % 6 == 0, "행사일").otherwise("모름")
    return inputs.notices(spark, d).select("notice_id", labels.date_label(F.col("title"), raw).alias("label"))


_PREFIXES = ("guide:web-", "guide:notice-", "cal:", "menu:", "place:", "doc:a:", "guide:page:", "")


@query("source_of", f"""
SELECT fact_id, CASE idx % 8 WHEN 0 THEN 'web_pages' WHEN 1 THEN 'events' WHEN 2 THEN 'events' WHEN 3 THEN 'menus' WHEN 4 THEN '' WHEN 5 THEN ''
   WHEN 6 THEN 'academic_guides' ELSE 'rules' END AS source,
  CASE idx % 8 WHEN 5 THEN 'doc:a:' WHEN 6 THEN 'guide:page:' WHEN 7 THEN part || '_' ELSE {sql_array(_PREFIXES)}[idx % 8 + 1] || evidence_id END AS prefix
FROM facts
""", "facts")
def source_of(spark, d):
    eid = F.concat(inputs.pick(_PREFIXES, F.col("idx") % 8), "evidence_id")
    return inputs.facts(spark, d).select("fact_id", eid.alias("eid")).select(
        "fact_id",
        F.coalesce(labels.source_of(F.col("eid")), F.lit("")).alias("source"),
        labels.doc_prefix(F.col("eid")).alias("prefix"),
    )


@query("public_badge", """
SELECT cal_id, CASE status WHEN 'hidden' THEN '관리자 확인' WHEN 'pending' THEN '검증 중' ELSE '' END AS badge FROM calendar
""", "calendar")
def public_badge(spark, d):
    status = F.when(F.col("status") == "hidden", "approved").when(F.col("status") == "pending", "verifying").otherwise("draft")
    return inputs.calendar(spark, d).select("cal_id", labels.public_badge(status).alias("badge"))


@query("iso_date", """
SELECT notice_id, CASE notice_id % 3 WHEN 2 THEN '' ELSE strftime(start_date, '%Y-%m-%d') END AS day FROM notices
""", "notices")
def iso_date(spark, d):
    raw = (
        F.when(F.col("notice_id") % 3 == 0, F.date_format("start_date", "yyyy.MM.dd."))
        .when(F.col("notice_id") % 3 == 1, F.date_format("start_date", "yyyy-MM-dd"))
        .otherwise("날짜 없음")
    )
    return inputs.notices(spark, d).select("notice_id", F.coalesce(labels.iso_date(raw).cast("string"), F.lit("")).alias("day"))


@query("rule_title", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' 부칙'
  WHEN 1 THEN p_name || ' [별표 ' || p_size || CASE WHEN p_size % 3 <> 0 THEN '-' || (p_size % 3) ELSE '' END || '] ' || p_type
  WHEN 2 THEN p_type
  ELSE p_name || ' 제' || p_size || '조' || CASE WHEN p_size % 3 <> 0 THEN '의' || (p_size % 3) ELSE '' END || '(' || p_type || ')' END AS title
FROM part
""")
def rule_title(spark, d):
    key = F.col("p_partkey")
    kind = F.when(key % 4 == 0, "addenda").when(key % 4 == 1, "appendix").otherwise("main")
    number = F.when(key % 4 != 2, F.col("p_size"))
    return inputs.table(spark, d, "part").select(
        "p_partkey", labels.rule_title(F.col("p_name"), kind, number, F.col("p_size") % 3, F.col("p_type")).alias("title")
    )


@query("int_like", """
SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN cast(cast(p_retailprice AS BIGINT) AS VARCHAR) ELSE cast(p_retailprice AS VARCHAR) END AS shown FROM part
""")
def int_like(spark, d):
    return inputs.table(spark, d, "part").select("p_partkey", labels.int_like(F.col("p_retailprice")).alias("shown"))


_HEADS = ("FFD8FFE000104A4649460001", "89504E470D0A1A0A0000000D", "474946383961000000000000", "524946460000000057454250", "000000000000000000000000")


@query("image_type", """
SELECT page_id, ['image/jpeg', 'image/png', 'image/gif', 'image/webp', 'image/jpeg'][page_id % 5 + 1] AS mime FROM pages
""")
def image_type(spark, d):
    head = F.hex(F.unhex(inputs.pick(_HEADS, F.col("page_id") % 5)))
    return inputs.wide(spark, d, "pages").select("page_id", labels.image_type(head).alias("mime"))


@query("client_address", """
SELECT event_id, CASE user_id % 4 WHEN 0 THEN '52.10.20.' || (user_id % 256) WHEN 1 THEN '9.9.9.' || (user_id % 256) WHEN 2 THEN 'peer-' || user_id ELSE '8.8.4.' || (user_id % 256) END AS address
FROM events
""")
def client_address(spark, d):
    user = F.col("user_id")
    host = (user % 256).cast("string")
    forwarded = (
        F.when(user % 4 == 0, F.concat(F.lit("1.2.3.4, 52.10.20."), host, F.lit(", 35.191.0.7")))
        .when(user % 4 == 1, F.concat(F.lit("9.9.9."), host, F.lit(", 10.0.0.1, 130.211.1.9")))
        .when(user % 4 == 2, F.lit("10.1.1.1, not-an-address"))
        .otherwise(F.concat(F.lit("172.20.1.1, 8.8.4."), host))
    )
    peer = F.concat(F.lit("peer-"), user.cast("string"))
    return inputs.table(spark, d, "events").select("event_id", labels.client_address(forwarded, peer).alias("address"))


@query("json_props", """
SELECT event_id, cast(json_extract_string(props, '$.k') AS INTEGER) AS k, '{"id":' || event_id || ',"k":' || json_extract_string(props, '$.k') || ',"kind":"' || event_type || '"}' AS payload FROM events
""")
def json_props(spark, d):
    parsed = F.from_json("props", "k int")
    payload = F.to_json(F.struct(F.col("event_id").alias("id"), parsed["k"].alias("k"), F.col("event_type").alias("kind")))
    return inputs.table(spark, d, "events").select("event_id", parsed["k"].alias("k"), payload.alias("payload"))


@query("struct_json", """
SELECT turn_id, '[' || string_agg('{"id":"' || evidence_id || '","n":' || qty || '}', ',' ORDER BY idx, evidence_id, qty) || ']' AS links FROM facts GROUP BY turn_id
""", "facts")
def struct_json(spark, d):
    rows = F.sort_array(F.collect_list(F.struct("idx", F.col("evidence_id").alias("id"), F.col("qty").alias("n"))))
    links = F.to_json(F.transform(rows, lambda r: F.struct(r["id"].alias("id"), r["n"].alias("n"))))
    return inputs.facts(spark, d).groupBy("turn_id").agg(links.alias("links"))


@query("event_group", """
SELECT notice_id, CASE notice_id % 6 WHEN 0 THEN 'calendar' WHEN 1 THEN 'academic' WHEN 2 THEN 'general' WHEN 3 THEN 'events' WHEN 4 THEN 'general' ELSE 'events' END AS grp FROM notices
""", "notices")
def event_group(spark, d):
    k = F.col("notice_id") % 6
    category = F.when(k == 0, "calendar").when(k == 1, "academic").otherwise("notice")
    board = F.when(k == 2, "general").when(k == 3, "events")
    url = F.when(k == 4, F.concat("url", F.lit("/bbs/general/1"))).otherwise(F.col("url"))
    return inputs.notices(spark, d).select("notice_id", labels.event_group(category, board, url, "/bbs/general/").alias("grp"))


@query("reachable_address", """
SELECT page_id, page_id % 4 = 0 AS reachable FROM pages
""")
def reachable_address(spark, d):
    k = F.col("page_id") % 4
    good = F.concat(F.lit("52.3.4."), (F.col("page_id") % 256).cast("string"))
    addresses = F.when(k == 0, F.array(good)).when(k == 1, F.array(good, F.lit("169.254.169.254"))).when(k == 2, F.array(F.lit("10.0.0.9"))).otherwise(F.array().cast("array<string>"))
    return inputs.table(spark, d, "pages").select("page_id", labels.reachable(addresses).alias("reachable"))

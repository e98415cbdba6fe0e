"""Citation verification, report checks and re-run gates."""

from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.operators import verify as vf
from plumbline.plans import inputs
from plumbline.plans.scalars import _POS_ORACLE
from plumbline.registry import query, sql_array, sql_list, sql_text, view

_NORM = "lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


def norm(x: str) -> str:
    return _NORM.format(x)


view("cited", """
SELECT d.*, coalesce(e.text, '') AS cited, len(d.cite_ids) > 0 AND e.text IS NULL AS unknown FROM drafts d LEFT JOIN evidence e ON e.turn_id = d.turn_id AND e.evidence_id = d.cite_ids[1]
""", ("drafts", "evidence"))


def _quote(i: int) -> str:
    q = norm(f"quotes[{i}]")
    return f"CASE WHEN len(quotes) >= {i} THEN CASE WHEN length({q}) < 6 THEN 'quote_too_short' WHEN NOT contains({norm('cited')}, {q}) THEN 'quote_not_found' END END"


def _flip(marker: str, holder: str, other: str) -> str:
    m = sql_text(marker)
    word = f"regexp_extract(split_part({holder}, {m}, 1), '([가-힣]{{2,}})\\s*$', 1)"
    stem = f"CASE WHEN length({word}) > 2 THEN substr({word}, 1, length({word}) - 1) ELSE {word} END"
    return f"(contains({holder}, {m}) AND NOT contains({other}, {m}) AND {word} <> '' AND contains({other}, {stem}))"


_SWAP = (
    "(contains(text, '하여야') AND NOT contains(joined, '하여야') AND contains(joined, '할 수 있') AND NOT contains(text, '할 수 있')) OR "
    "(contains(text, '할 수 있') AND NOT contains(joined, '할 수 있') AND contains(joined, '하여야') AND NOT contains(text, '하여야'))"
)
_FLIPS = " OR ".join([_flip(m, a, b) for m in rules.NEGATION for a, b in (("text", "joined"), ("joined", "text"))] + [_SWAP])
_RISKY = " OR ".join(f"contains(text, {sql_text(t)}) <> contains(joined, {sql_text(t)})" for t in rules.RISKY)
_ISO = r"'(\d{4})-(\d{2})-(\d{2})'"
_ALLOWED = (
    "cited || ' ' || regexp_extract(cited, '(\\d{4})-(\\d{2})-(\\d{2})', 1) || '년' || try_cast(regexp_extract(cited, '(\\d{4})-(\\d{2})-(\\d{2})', 2) AS INTEGER) || '월' || "
    "try_cast(regexp_extract(cited, '(\\d{4})-(\\d{2})-(\\d{2})', 3) AS INTEGER) || '일'"
)
view("checked", f"""
SELECT *, {_FLIPS} AS flip, {_RISKY} AS risky, len(list_filter(list_transform(regexp_extract_all(regexp_replace(text, {sql_text(rules.CITATION_MARK)}, ' ', 'g'), {sql_text(rules.UNIT_NUMBER)}, 0), lambda n: {norm('n')}), lambda n: NOT contains({norm(f"coalesce({_ALLOWED}, cited)")}, n))) > 0 AS wrong_number,
  coalesce({_quote(1)}, {_quote(2)}) AS quote_reason FROM (SELECT *, array_to_string(quotes, ' ') AS joined FROM cited)
""", ("cited",))
view("verified", """
SELECT sid, turn_id, section, cite_ids, coalesce(failed, CASE WHEN flag = 'polarity_flip' THEN 'suppressed' END, '') AS reason, flag FROM (
 SELECT *, coalesce(CASE WHEN failed IS NULL AND section = 'sentences' THEN CASE WHEN flip THEN 'polarity_flip' WHEN risky THEN 'risky_token' END END, '') AS flag FROM (
  SELECT *, CASE WHEN len(cite_ids) = 0 THEN 'no_cite' WHEN len(quotes) = 0 THEN 'len_mismatch' WHEN unknown THEN 'unknown_id' WHEN quote_reason IS NOT NULL THEN quote_reason WHEN wrong_number THEN 'number_mismatch' END AS failed FROM checked))
""", ("checked",))


def verified(spark, d):
    return vf.verify_sentences(inputs.drafts(spark, d), inputs.evidence(spark, d))


@query("verify_sentences", "SELECT sid, turn_id, section, reason, flag FROM verified", "verified")
def verify_sentences(spark, d):
    return verified(spark, d).drop("cite_ids")


@query("verify_report", """
SELECT turn_id, count(*) FILTER (section = 'sentences') AS total, count(*) FILTER (section = 'sentences' AND reason = '') AS kept, count(*) FILTER (reason <> '') AS dropped FROM verified GROUP BY turn_id
""", "verified")
def verify_report(spark, d):
    return vf.verify_report(verified(spark, d))


@query("citation_check_ids", "SELECT sid, cite_ids[1] AS evidence_id FROM cited WHERE unknown", "cited")
def citation_check_ids(spark, d):
    cites = inputs.drafts(spark, d).select("sid", "turn_id", F.explode("cite_ids").alias("evidence_id"))
    return cites.join(inputs.evidence(spark, d), ["turn_id", "evidence_id"], "left_anti").select("sid", "evidence_id")


@query("quote_join", "SELECT sid, coalesce(quote_reason, 'found') AS result FROM checked", "checked")
def quote_join(spark, d):
    rows = vf.cited_texts(inputs.drafts(spark, d), inputs.evidence(spark, d))
    return vf.with_quote_check(rows).select("sid", F.coalesce("quote_reason", F.lit("found")).alias("result"))


@query("polarity_flags", """
SELECT sid, CASE WHEN flip THEN 'high' ELSE 'low' END AS severity FROM checked WHERE section = 'sentences' AND (flip OR risky)
""", "checked")
def polarity_flags(spark, d):
    rows = vf.with_polarity(inputs.drafts(spark, d), F.col("section") == "sentences").where("polarity <> ''")
    return rows.select("sid", F.when(F.col("polarity") == "polarity_flip", "high").otherwise("low").alias("severity"))


@query("adopted_not_cited", """
SELECT DISTINCT turn_id, need FROM (SELECT turn_id, evidence_id, CASE WHEN qty % 2 = 0 THEN 'eligibility_or_limit' ELSE 'procedure_and_contact' END AS need FROM evidence) a
WHERE NOT EXISTS (SELECT 1 FROM (SELECT turn_id, unnest(cite_ids) AS c FROM verified WHERE reason = '') v JOIN evidence e ON e.turn_id = v.turn_id AND e.evidence_id = v.c
  WHERE v.turn_id = a.turn_id AND CASE WHEN e.qty % 2 = 0 THEN 'eligibility_or_limit' ELSE 'procedure_and_contact' END = a.need)
""", ("evidence", "verified"))
def adopted_not_cited(spark, d):
    need = F.when(F.col("qty") % 2 == 0, "eligibility_or_limit").otherwise("procedure_and_contact")
    adopted = inputs.evidence(spark, d).select("turn_id", need.alias("need"), "evidence_id")
    return vf.adopted_not_cited(adopted, verified(spark, d))


# ── reports ──────────────────────────────────────────────────────────────────────────────────────
_KINDS = ("answer_evidence_mismatch", "answer_evidence_mismatch", "answer_evidence_mismatch", "stale_source", "answer_quality")


@query("deterministic_mismatch", f"""
SELECT sid, CASE WHEN kind <> 'answer_evidence_mismatch' OR NOT contains(evidence, value) THEN false
  WHEN len(shared) > 0 THEN len(list_intersect(cv, vv)) = 0 AND len(list_filter(list_intersect(cv, ev), lambda v: list_contains(shared, split_part(v, '=', 1)))) = 0
  WHEN len(cv) > 0 OR len(vv) > 0 THEN false ELSE coalesce(pc <> pv, false) END AS confirmed
FROM (SELECT *, list_intersect(list_transform(cv, lambda v: split_part(v, '=', 1)), list_transform(vv, lambda v: split_part(v, '=', 1))) AS shared FROM (
 SELECT turn_id || '-' || idx || '-' || part || '-' || supp AS sid, kind, claim, value, evidence_text AS evidence, evidence_values AS ev,
  list_transform(regexp_extract_all(claim, {sql_text(rules.REPORT_VALUE)}, 0), lambda x: regexp_extract(x, {sql_text(rules.REPORT_VALUE)}, 2) || '=' || regexp_extract(x, {sql_text(rules.REPORT_VALUE)}, 1)) AS cv,
  list_transform(regexp_extract_all(value, {sql_text(rules.REPORT_VALUE)}, 0), lambda x: regexp_extract(x, {sql_text(rules.REPORT_VALUE)}, 2) || '=' || regexp_extract(x, {sql_text(rules.REPORT_VALUE)}, 1)) AS vv,
  CASE WHEN regexp_matches(claim, {sql_text(rules.NEGATIVE)}) THEN 'neg' WHEN regexp_matches(claim, {sql_text(_POS_ORACLE)}) THEN 'pos' END AS pc,
  CASE WHEN regexp_matches(value, {sql_text(rules.NEGATIVE)}) THEN 'neg' WHEN regexp_matches(value, {sql_text(_POS_ORACLE)}) THEN 'pos' END AS pv
 FROM (SELECT *, {sql_array(_KINDS)}[part % 5 + 1] AS kind, CASE WHEN supp % 3 = 0 THEN '신청할 수 없다' ELSE sentence END AS claim, CASE WHEN supp % 3 = 0 THEN '신청할 수 있다' ELSE quote END AS value FROM fact_values)))
""", "fact_values")
def deterministic_mismatch(spark, d):
    third = F.col("supp") % 3 == 0
    rows = inputs.facts(spark, d).select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("turn_id", "idx", "part", "supp")]).alias("sid"),
        inputs.pick(_KINDS, F.col("part") % 5).alias("kind"),
        F.when(third, "신청할 수 없다").otherwise(F.col("sentence")).alias("claim"),
        F.when(third, "신청할 수 있다").otherwise(F.col("quote")).alias("value"),
        F.when(third, "신청할 수 없다").otherwise(F.col("sentence")).alias("answer"),
        F.col("evidence_text").alias("evidence"),
    )
    return vf.deterministic_mismatch(rows).select("sid", "confirmed")


@query("report_routing", f"""
SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 = 0 THEN 'register' WHEN (conv_id + turn) % 7 = 1 THEN 'unanswered' WHEN (conv_id + turn) % 7 = 2 THEN 'place' WHEN (conv_id + turn) % 7 = 3 THEN 'recollect' WHEN (conv_id + turn) % 7 = 4 THEN 'quality' ELSE 'unanswered' END AS route FROM conversations WHERE role = 'user'
""")
def report_routing(spark, d):
    m = (F.col("conv_id") + F.col("turn")) % 7
    text = F.concat_ws(" ", "text", F.when(m == 0, "https://lib.campus.example/page?id=3.").when(m == 1, "https://other.example/x").otherwise(""))
    question = F.when(m == 2, "도서관 어디 있어요").otherwise("휴학 신청 방법")
    kind = F.when(m == 3, "stale_source").when(m == 4, "answer_quality").otherwise("answer_evidence_mismatch")
    rows = inputs.table(spark, d, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", vf.report_route(text, question, kind, "campus.example").alias("route"))


view("drift", """
SELECT doc_id, q, p, CASE WHEN p IS NULL THEN 'unreachable' WHEN q = '' THEN 'same' WHEN len(pieces) = 0 THEN CASE WHEN contains(p, q) THEN 'same' ELSE 'changed' END
  WHEN len(list_filter(pieces, lambda x: contains(p, x))) * 3 >= len(pieces) * 2 THEN 'same' ELSE 'changed' END AS state FROM (
 SELECT *, list_slice(list_filter(list_transform(range(0, cast(ceil(length(q) / 30) AS INTEGER)), lambda i: substr(q, i * 30 + 1, 30)), lambda x: length(x) >= 10), 1, 6) AS pieces FROM (
  SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS q, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE regexp_replace(CASE WHEN doc_id % 5 = 1 THEN substr(text, 120) WHEN doc_id % 5 = 2 THEN substr(text, 40) ELSE text END, '\\s+', '', 'g') END AS p FROM documents))
""")


@query("source_drift", "SELECT doc_id, state FROM drift", "drift")
def source_drift(spark, d):
    docs = inputs.wide(spark, d, "documents").withColumn("url", F.concat(F.lit("https://www.campus.example/"), F.col("doc_id").cast("string")))
    m = F.col("doc_id") % 5
    text = F.when(m == 1, F.substring("text", F.lit(120), F.length("text"))).when(m == 2, F.substring("text", F.lit(40), F.length("text"))).otherwise(F.col("text"))
    pages = docs.where("doc_id % 5 <> 4").select("url", text.alias("text"))
    return vf.source_drift(docs.select("doc_id", "url", F.col("text").alias("quote")), pages).select("doc_id", "state")


_ANSWERS = ("본관 2층 학사팀에서 신청합니다", "안내 자료를 찾지 못했습니다", "학사팀은 3월 2일까지 접수합니다 서류를 내세요", "정보가 없습니다")


def rerun(spark, d):
    """Two runs of every fact: the question as asked and its paraphrase."""
    runs = inputs.facts(spark, d).select("turn_id", "idx", "part", "supp", "evidence_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("run"))
    n = F.col("part") + F.col("run")
    none = F.array().cast("array<string>")
    return runs.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("turn_id", "idx", "part", "supp")]).alias("sid"), "run",
        F.when(n % 11 == 0, "fallback").otherwise("answer").alias("outcome"), F.when(n % 22 == 0, "no_evidence").otherwise("").alias("fallback_reason"),
        F.when(n % 13 == 0, none).otherwise(F.array("evidence_id")).alias("cited"), (n % 17 == 0).alias("conflict"),
        inputs.pick(_ANSWERS, F.when(n % 5 == 0, n % 4).otherwise((n % 2) * 2)).alias("answer"),
        F.when(n % 19 == 0, "학사팀은 3월 2일까지 접수합니다 서류를 내세요").otherwise("짧은 답").alias("reported"),
        F.when(F.col("supp") % 3 == 0, F.array(F.concat((F.col("part") - F.col("part") % 2).cast("string"), F.lit("_")))).otherwise(none).alias("required"),
        F.when(F.col("supp") % 7 == 0, "본관 2층").otherwise("").alias("must_contain"),
    )


view("gated", f"""
SELECT sid, run, CASE WHEN n % 11 = 0 THEN CASE WHEN n % 22 = 0 THEN 'no_evidence' ELSE 'fallback' END WHEN n % 13 = 0 THEN '인용 없음' WHEN n % 17 = 0 THEN '원문 충돌' WHEN regexp_matches(answer, {sql_text(rules.NOT_FOUND)}) THEN '답변이 ''찾지 못함'''
  WHEN n % 19 = 0 AND answer = {sql_text(_ANSWERS[2])} THEN '제보된 답과 같음' WHEN supp % 3 = 0 AND part % 2 = 1 THEN '바꾼 자료를 인용하지 않음' WHEN supp % 7 = 0 AND NOT contains(answer, '본관 2층') THEN '승인한 위치가 답변에 없음' ELSE 'ok' END AS reason
FROM (SELECT *, {sql_array(_ANSWERS)}[CASE WHEN n % 5 = 0 THEN n % 4 ELSE (n % 2) * 2 END + 1] AS answer FROM (SELECT turn_id || '-' || idx || '-' || part || '-' || supp AS sid, part, supp, run, part + run AS n FROM facts, (VALUES (0), (1)) r(run)))
""", ("facts",))


@query("run_gate", "SELECT sid, run, reason FROM gated", "gated")
def run_gate(spark, d):
    return vf.run_gate(rerun(spark, d)).select("sid", "run", "reason")


@query("two_of_two", """
SELECT sid, bool_and(reason = 'ok') AS passed, coalesce(arg_min(reason, run) FILTER (reason <> 'ok'), 'ok') AS reason, count(*) AS runs FROM gated GROUP BY sid
""", "gated")
def two_of_two(spark, d):
    return vf.two_of_two(vf.run_gate(rerun(spark, d)), "sid", "run")

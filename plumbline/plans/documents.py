"""Regulation parsing and chunking."""

from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.functions.text import norm_compact
from plumbline.operators import regulations as rg
from plumbline.plans import inputs
from plumbline.registry import query, sql_text, view


def lines(spark, d):
    return rg.normalize_lines(inputs.regulation_lines(spark, d))


def articles(spark, d):
    return rg.split_articles(lines(spark, d))


view("lines", r"""
SELECT rule_no, line_no, line FROM (SELECT rule_no, line_no, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM regulation_lines) WHERE line <> ''
""", ("regulation_lines",))


@query("normalize_lines", "SELECT * FROM lines", "lines")
def normalize_lines(spark, d):
    return lines(spark, d)


@query("normalize_lines_nfkc")
def normalize_lines_nfkc(spark, d):
    return rg.normalize_lines(inputs.regulation_lines(spark, d), nfkc=True)


_DEL = r"<\s*삭\s*제\s*>|^\s*삭\s*제(?:\s|<|$)"
view("labelled", f"""
SELECT *, CASE WHEN regexp_matches(line, {sql_text(rules.CHAPTER_HEAD)}) THEN 'chapter' WHEN regexp_matches(line, {sql_text(rules.SECTION_HEAD)}) THEN 'section'
 WHEN regexp_matches(line, {sql_text(rules.ADDENDA_HEAD)}) THEN 'addenda' WHEN regexp_matches(line, {sql_text(rules.TABLE_APPENDIX_HEAD)}) THEN 'appendix'
 WHEN regexp_matches(line, {sql_text(rules.APPENDIX_HEAD)}) THEN 'form' WHEN regexp_matches(line, {sql_text(rules.ARTICLE_HEAD)}) THEN 'article'
 WHEN regexp_matches(line, {sql_text(rules.NOTE_LINE)}) THEN 'note' WHEN regexp_full_match(line, {sql_text(rules.TABLE_TOKEN)}) THEN 'table' ELSE 'body' END AS label
FROM lines
""", ("lines",))


@query("classify_lines", "SELECT rule_no, line_no, label FROM labelled", "labelled")
def classify_lines(spark, d):
    return lines(spark, d).select("rule_no", "line_no", rg.line_label(F.col("line")).alias("label"))


_DOT = r"(?:^|[^0-9])(\d{2,4})\s*\.\s*(\d{1,2})\s*\.\s*(\d{1,2})"
_KOR = r"(?:^|[^0-9])(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일"


def _part(i: int) -> str:
    return f"try_cast(coalesce(nullif(regexp_extract(line, {sql_text(_DOT)}, {i}), ''), nullif(regexp_extract(line, {sql_text(_KOR)}, {i}), '')) AS INTEGER)"


_YEAR = f"CASE WHEN {_part(1)} < 50 THEN {_part(1)} + 2000 WHEN {_part(1)} < 100 THEN {_part(1)} + 1900 ELSE {_part(1)} END"
_RUN = "(PARTITION BY rule_no ORDER BY line_no)"
view("placed", f"""
SELECT *, CASE WHEN part IS NULL OR (part[1] IN ('appendix', 'form') AND article_line > cast(part[2] AS INTEGER)) THEN 'main' WHEN part[1] = 'addenda' THEN 'addenda' ELSE 'appendix' END AS mode,
  min(CASE WHEN addenda_seq > 0 AND line_date IS NOT NULL AND (label = 'addenda' OR (counted AND n <= addenda_n + 2)) THEN line_no END) OVER (PARTITION BY rule_no, addenda_seq) AS date_line
FROM (SELECT *, min(CASE WHEN label = 'addenda' THEN n END) OVER (PARTITION BY rule_no, addenda_seq) AS addenda_n FROM (
 SELECT *, label NOT IN ('chapter', 'section', 'addenda') AS counted,
  last_value(CASE WHEN label IN ('addenda', 'appendix', 'form') THEN [label, cast(line_no AS VARCHAR)] END IGNORE NULLS) OVER {_RUN} AS part,
  max(CASE WHEN label = 'article' THEN line_no END) OVER {_RUN} AS article_line,
  count(*) FILTER (label IN ('addenda', 'appendix', 'form', 'article')) OVER {_RUN} AS head_no,
  cast(count(*) FILTER (label = 'addenda') OVER {_RUN} AS INTEGER) AS addenda_seq,
  nullif(last_value(CASE label WHEN 'chapter' THEN line WHEN 'addenda' THEN '' END IGNORE NULLS) OVER {_RUN}, '') AS chapter,
  nullif(last_value(CASE label WHEN 'section' THEN line WHEN 'chapter' THEN '' WHEN 'addenda' THEN '' END IGNORE NULLS) OVER {_RUN}, '') AS section,
  count(*) FILTER (label NOT IN ('chapter', 'section', 'addenda')) OVER {_RUN} AS n,
  CASE WHEN {_part(1)} IS NOT NULL THEN try_cast(printf('%04d-%02d-%02d', cast({_YEAR} AS INTEGER), {_part(2)}, {_part(3)}) AS DATE) END AS line_date
 FROM (SELECT * FROM (SELECT *, max(CASE WHEN label IN ('chapter', 'section', 'addenda', 'article') THEN 1 END) OVER {_RUN} AS started FROM labelled) WHERE started = 1)))
""", ("labelled",))

_N = sql_text(rules.NOTE)
_REST = f"trim(regexp_replace(line, {sql_text(rules.ARTICLE_HEAD)}, ''))"
view("article_lines", f"""
SELECT *, CASE WHEN label = 'article' THEN CASE WHEN deleted THEN trim(regexp_replace(trim(regexp_replace(rest, {_N}, '', 'g')), {sql_text(_DEL)}, '', 'g')) ELSE trim(regexp_replace(rest, {_N}, '', 'g')) END
   WHEN label IN ('addenda', 'appendix', 'chapter', 'section') THEN '' WHEN line_no = title_line THEN '' WHEN label = 'note' AND head <> 'appendix' THEN ''
   ELSE regexp_replace(bare, {sql_text(rules.TABLE_TOKEN)}, {sql_text(rules.TABLE_UNREADABLE)}, 'g') END AS body_line,
  CASE WHEN label IN ('addenda', 'chapter', 'section') THEN [] WHEN label = 'appendix' THEN regexp_extract_all(regexp_replace(line, {sql_text(rules.TABLE_APPENDIX_HEAD)}, ''), {_N}, 0)
   WHEN line_no = title_line THEN [] WHEN label = 'note' AND head <> 'appendix' THEN [line] WHEN label = 'article' THEN regexp_extract_all(rest, {_N}, 0) ELSE regexp_extract_all(line, {_N}, 0) END AS line_notes
FROM (SELECT *, min(CASE WHEN head = 'appendix' AND label NOT IN ('appendix', 'chapter', 'section', 'table') AND NOT starts_with(line, '[표]') AND bare <> '' THEN line_no END) OVER (PARTITION BY rule_no, head_no) AS title_line,
   CASE WHEN label = 'article' THEN CASE WHEN tlen > 0 THEN trim(substr(rest0, tlen + 1)) ELSE rest0 END END AS rest,
   CASE WHEN label = 'article' AND tlen > 2 THEN nullif(trim(substr(rest0, 2, tlen - 2)), '') END AS head_title,
   coalesce(regexp_matches(CASE WHEN label = 'article' THEN CASE WHEN tlen > 0 THEN trim(substr(rest0, tlen + 1)) ELSE rest0 END END, {sql_text(_DEL)}), false) AS deleted
  FROM (SELECT *, first_value(label) OVER (PARTITION BY rule_no, head_no ORDER BY line_no) AS head, trim(regexp_replace(line, {_N}, '', 'g')) AS bare, {_REST} AS rest0,
    length(regexp_extract({_REST}, '^(\\([^()]*\\))', 1)) AS tlen FROM placed WHERE head_no > 0)
  WHERE head <> 'form')
""", ("placed",))

view("articles", f"""
SELECT *, rule_no || CASE mode WHEN 'addenda' THEN printf('_add_s%02d_', addenda_seq) || number WHEN 'appendix' THEN '_app_' || number || coalesce('_' || branch, '') ELSE '_main_' || number || coalesce('_' || branch, '') END || suffix AS article_id
FROM (SELECT rule_no, mode, number, branch, title, chapter, section, deleted, first_line, body_lines, notes, trim(array_to_string(body_lines, chr(10))) AS body,
  CASE WHEN mode = 'addenda' THEN seq ELSE 0 END AS addenda_seq, CASE WHEN mode = 'addenda' AND coalesce(next_line, 2147483647) >= date_line THEN found_date END AS addenda_date,
  CASE WHEN head = 'appendix' AND version > 1 THEN '_v' || version ELSE '' END AS suffix
 FROM (SELECT *, lead(first_line) OVER (PARTITION BY rule_no ORDER BY first_line) AS next_line, row_number() OVER (PARTITION BY rule_no, head, number, branch ORDER BY first_line) AS version
  FROM (SELECT rule_no, head_no, any_value(head) AS head, max(mode) FILTER (is_head) AS mode, bool_or(deleted) AS deleted, min(line_no) AS first_line, max(addenda_seq) AS seq, max(date_line) AS date_line,
    max(dl.line_date) AS found_date,
    max(CASE WHEN label = 'article' THEN cast(regexp_extract(line, {sql_text(rules.ARTICLE_HEAD)}, 1) AS INTEGER) WHEN label = 'appendix' THEN cast(regexp_extract(line, {sql_text(rules.TABLE_APPENDIX_HEAD)}, 1) AS INTEGER) WHEN label = 'addenda' THEN 0 END) AS number,
    max(CASE WHEN label = 'article' THEN try_cast(nullif(regexp_extract(line, {sql_text(rules.ARTICLE_HEAD)}, 2), '') AS INTEGER) WHEN label = 'appendix' THEN try_cast(nullif(regexp_extract(line, {sql_text(rules.TABLE_APPENDIX_HEAD)}, 2), '') AS INTEGER) END) AS branch,
    max(CASE WHEN label = 'article' THEN head_title WHEN line_no = title_line THEN substr(bare, 1, 100) END) AS title,
    max(CASE WHEN label = 'article' THEN chapter END) AS chapter, max(CASE WHEN label = 'article' THEN section END) AS section,
    coalesce(list(body_line ORDER BY line_no) FILTER (body_line <> ''), []) AS body_lines, flatten(list(line_notes ORDER BY line_no)) AS notes
   FROM (SELECT a.*, label IN ('article', 'addenda', 'appendix') AS is_head FROM article_lines a) LEFT JOIN (SELECT rule_no AS r, line_no AS l, line_date FROM placed) dl ON dl.r = rule_no AND dl.l = date_line
   GROUP BY rule_no, head_no)))
WHERE NOT (mode = 'appendix' AND len(list_filter(body_lines, lambda b: b <> {sql_text(rules.TABLE_UNREADABLE)})) = 0) AND (deleted OR body <> '')
""", ("placed", "article_lines"))


@query("split_articles", """
SELECT rule_no, article_id, mode, coalesce(title, '') AS title, coalesce(chapter, '') AS chapter, coalesce(section, '') AS section, deleted, array_to_string(notes, '|') AS notes, md5(body) AS body_hash, cast(len(body_lines) AS INTEGER) AS lines FROM articles
""", "articles")
def split_articles(spark, d):
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return articles(spark, d).select(
        "rule_no", "article_id", "mode", text("title"), text("chapter"), text("section"), "deleted", F.array_join("notes", "|").alias("notes"),
        F.md5("body").alias("body_hash"), F.size("body_lines").alias("lines"),
    )


@query("addenda_numbering", """
SELECT article_id, addenda_seq, coalesce(strftime(addenda_date, '%Y-%m-%d'), '') AS addenda_date FROM articles WHERE mode = 'addenda'
""", "articles")
def addenda_numbering(spark, d):
    return articles(spark, d).where("mode = 'addenda'").select(
        "article_id", "addenda_seq", F.coalesce(F.col("addenda_date").cast("string"), F.lit("")).alias("addenda_date")
    )


@query("appendix_versions", "SELECT article_id, suffix, coalesce(title, '') AS title FROM articles WHERE mode = 'appendix'", "articles")
def appendix_versions(spark, d):
    return articles(spark, d).where("mode = 'appendix'").select("article_id", "suffix", F.coalesce("title", F.lit("")).alias("title"))


@query("balanced_title", """
SELECT rule_no, line_no, CASE line_no % 3 WHEN 0 THEN '목적(개정) ' || line_no WHEN 1 THEN '정의' ELSE '' END AS title, CASE line_no % 3 WHEN 2 THEN '(닫지 않은 ' || line ELSE line END AS rest FROM lines
""", "lines")
def balanced_title(spark, d):
    n = F.col("line_no")
    text = (
        F.when(n % 3 == 0, F.concat(F.lit("(목적(개정) "), n.cast("string"), F.lit(") "), F.col("line")))
        .when(n % 3 == 1, F.concat(F.lit("(정의)"), F.col("line")))
        .otherwise(F.concat(F.lit("(닫지 않은 "), F.regexp_replace("line", r"[()]", ""))
    ))
    split = rg.balanced_title(text)
    rest = F.when(n % 3 == 2, F.concat(F.lit("(닫지 않은 "), F.col("line"))).otherwise(split["rest"])
    return lines(spark, d).select("rule_no", "line_no", F.coalesce(split["title"], F.lit("")).alias("title"), rest.alias("rest"))


@query("strip_notes", f"""
SELECT rule_no, line_no, trim(regexp_replace(line, {_N}, '', 'g')) AS text, array_to_string(regexp_extract_all(line, {_N}, 0), '|') AS notes FROM lines
""", "lines")
def strip_notes(spark, d):
    cut = rg.strip_notes(F.col("line"))
    return lines(spark, d).select("rule_no", "line_no", cut["text"].alias("text"), F.array_join(cut["notes"], "|").alias("notes"))


@query("deleted_flag", "SELECT article_id, deleted, NOT deleted AND body <> '' AS indexable FROM articles", "articles")
def deleted_flag(spark, d):
    return articles(spark, d).select("article_id", "deleted", rg.indexable().alias("indexable"))


@query("article_id", "SELECT article_id, first_line FROM articles", "articles")
def article_id(spark, d):
    return articles(spark, d).select(rg.article_id().alias("article_id"), "first_line")


_HEADING = "'제' || number || '조' || coalesce('의' || branch, '') || coalesce('(' || title || ')', '')"
_CIRCLE = f"^[{rules.CIRCLED}]"
view("big_articles", f"""
SELECT *, {_HEADING} AS heading, len(list_filter(body_lines, lambda b: regexp_matches(b, '{_CIRCLE}'))) > 0 AS has_paragraphs FROM articles WHERE length(body) > {rules.CHUNK_OVER} AND mode <> 'appendix'
""", ("articles",))


@query("chunk_paragraphs", f"""
SELECT article_id || '_p' || no AS chunk_id, cast(part AS INTEGER) AS part, heading || chr(10) || body AS body FROM (
 SELECT article_id, heading, part, string_agg(line, chr(10) ORDER BY pos) AS body, arg_min(instr('{rules.CIRCLED}', substr(line, 1, 1)), pos) FILTER (is_head) AS no FROM (
  SELECT *, greatest(1, count(*) FILTER (is_head) OVER (PARTITION BY article_id, first_line ORDER BY pos)) AS part FROM (
   SELECT *, regexp_matches(line, '{_CIRCLE}') AS is_head FROM (SELECT article_id, first_line, heading, unnest(body_lines) AS line, generate_subscripts(body_lines, 1) AS pos FROM big_articles WHERE has_paragraphs)))
 GROUP BY article_id, first_line, heading, part)
""", "big_articles")
def chunk_paragraphs(spark, d):
    return rg.chunk_paragraphs(articles(spark, d))


@query("chunk_fixed", f"""
SELECT article_id || '_c' || part AS chunk_id, part, heading || chr(10) || substr(body, (part - 1) * {rules.CHUNK_SIZE} + 1, {rules.CHUNK_SIZE}) AS body
FROM (SELECT *, unnest(range(1, cast(ceil(length(body) / {rules.CHUNK_SIZE}) AS INTEGER) + 1))::INTEGER AS part FROM big_articles WHERE NOT has_paragraphs)
""", "big_articles")
def chunk_fixed(spark, d):
    return rg.chunk_fixed(articles(spark, d))


def appendix_source(spark, d):
    """Whole documents as appendices, every seventh line a year sub-heading."""
    body = F.filter(F.split("text", "\n"), lambda b: F.trim(b) != "")
    marked = F.transform(body, lambda b, i: F.when(i % 7 == 3, F.concat((F.lit(2020) + i).cast("string"), F.lit("학년도 정원"))).otherwise(b))
    docs = inputs.wide(spark, d, "documents")
    return docs.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_app_1")).alias("article_id"), F.lit("appendix").alias("mode"), F.lit(1).alias("number"),
        F.lit(None).cast("int").alias("branch"), F.lit("입학정원").alias("title"), marked.alias("body_lines"), F.array_join(marked, "\n").alias("body"),
    )


@query("chunk_appendix")
def chunk_appendix(spark, d):
    return rg.chunk_appendix(appendix_source(spark, d))


@query("chunk_greedy_lines", f"""
WITH RECURSIVE src AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents),
walk(doc_id, i, part, buf, l) AS (SELECT doc_id, 1, 1, l[1], l FROM src
 UNION ALL SELECT doc_id, i + 1, CASE WHEN length(buf) + length(l[i + 1]) > {rules.WEB_CHUNK} THEN part + 1 ELSE part END,
  CASE WHEN length(buf) + length(l[i + 1]) > {rules.WEB_CHUNK} THEN l[i + 1] ELSE buf || chr(10) || l[i + 1] END, l FROM walk WHERE i < len(l))
SELECT doc_id, part, arg_max(buf, i) AS body FROM walk GROUP BY doc_id, part
""")
def chunk_greedy_lines(spark, d):
    parts = rg.pack_lines(F.filter(F.split("text", "\n"), lambda x: x != ""), rules.WEB_CHUNK)
    return inputs.wide(spark, d, "documents").select("doc_id", F.posexplode(parts).alias("part", "body")).withColumn("part", F.col("part") + 1)


def paragraph_text():
    """Document text with a blank line after every third line."""
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 2, F.concat(x, F.lit("\n"))).otherwise(x))
    return F.array_join(marked, "\n")


@query("chunk_paragraph_pack")
def chunk_paragraph_pack(spark, d):
    parts = rg.pack_paragraphs(paragraph_text())
    return inputs.wide(spark, d, "documents").select("doc_id", F.posexplode(parts).alias("part", "body"))


# ── document tables ────────────────────────────────────────────────────────────────────────────
def registry(spark, d):
    return inputs.table(spark, d, "part").select(
        F.col("p_partkey").alias("rule_no"), F.concat("p_name", F.lit(" 규정")).alias("rule_name"), "p_size", F.col("p_type").alias("department")
    )


@query("rule_documents", """
SELECT a.article_id AS id, p_name || ' 규정' AS rule_name, p_type AS department, a.body <> '' AND contains(a.body, '[표') AS has_table, substr(sha256(a.body), 1, 16) AS content_hash, coalesce(a.title, '') AS title
FROM articles a JOIN part ON p_partkey = rule_no WHERE NOT a.deleted AND a.body <> '' AND p_size % 10 <> 0
""", "articles")
def rule_documents(spark, d):
    manifest = registry(spark, d).where("p_size % 10 <> 0").select("rule_no")
    docs = articles(spark, d).where(rg.indexable()).join(registry(spark, d), "rule_no").join(manifest, "rule_no", "left_semi")
    return docs.select(
        F.col("article_id").alias("id"), "rule_name", "department", F.col("body").contains("[표").alias("has_table"),
        F.left(F.sha2("body", 256), F.lit(16)).alias("content_hash"), F.coalesce("title", F.lit("")).alias("title"),
    )


def previous_state(spark, d):
    length = F.sum(F.length("line"))
    now = lines(spark, d).groupBy("rule_no").agg(length.alias("text_length"))
    return now.select(
        "rule_no", (F.col("rule_no") % 7).alias("previous_count"), "text_length",
        F.when(F.col("rule_no") % 5 == 0, F.floor(F.col("text_length") / 3)).otherwise(F.col("text_length")).alias("previous_length"),
    )


view("validated", """
SELECT a.rule_no, article_count, indexable_count, cast(coalesce(top, 0) - present AS BIGINT) AS missing_numbers, empty_bodies, cast(coalesce(dups, 0) AS BIGINT) AS duplicate_ids, addenda_dates_missing,
  CASE WHEN alive > 0 THEN empty_bodies / alive >= 0.1 ELSE false END AS many_empty, coalesce(dups, 0) > 0 OR article_count < (a.rule_no % 7) * 0.5 AS has_error,
  text_length >= 2 * CASE WHEN a.rule_no % 5 = 0 THEN text_length // 3 ELSE text_length END AS hold
FROM (SELECT rule_no, count(*) AS article_count, count(*) FILTER (NOT deleted AND body <> '') AS indexable_count, max(number) FILTER (mode = 'main') AS top, count(DISTINCT number) FILTER (mode = 'main' AND number > 0) AS present,
   count(*) FILTER (NOT deleted AND body = '') AS empty_bodies, count(*) FILTER (NOT deleted) AS alive, count(*) FILTER (mode = 'addenda' AND addenda_date IS NULL) AS addenda_dates_missing FROM articles GROUP BY 1) a
 LEFT JOIN (SELECT rule_no, count(*) AS dups FROM (SELECT rule_no, article_id FROM articles GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1) d ON d.rule_no = a.rule_no
 LEFT JOIN (SELECT rule_no, sum(length(line))::BIGINT AS text_length FROM lines GROUP BY 1) t ON t.rule_no = a.rule_no
""", ("articles", "lines"))


@query("validate_articles", "SELECT * FROM validated", "validated")
def validate_articles(spark, d):
    return rg.validate_articles(articles(spark, d), previous_state(spark, d))


@query("build_report", """
SELECT CASE WHEN has_error THEN 'rejected' WHEN hold THEN 'held' ELSE 'validated' END AS status, count(*) AS rules, cast(sum(article_count) AS BIGINT) AS articles, cast(sum(CASE WHEN has_error OR hold THEN 0 ELSE indexable_count END) AS BIGINT) AS documents FROM validated GROUP BY 1
""", "validated")
def build_report(spark, d):
    report = rg.validate_articles(articles(spark, d), previous_state(spark, d))
    status = F.when(F.col("has_error"), "rejected").when(F.col("hold"), "held").otherwise("validated")
    return report.groupBy(status.alias("status")).agg(
        F.count("*").alias("rules"), F.sum("article_count").alias("articles"),
        F.sum(F.when(F.col("has_error") | F.col("hold"), 0).otherwise(F.col("indexable_count"))).alias("documents"),
    )


@query("upload_documents", f"""
WITH RECURSIVE src AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents),
walk(doc_id, i, part, buf, l) AS (SELECT doc_id, 1, 1, l[1], l FROM src
 UNION ALL SELECT doc_id, i + 1, CASE WHEN length(buf) + length(l[i + 1]) > {rules.WEB_CHUNK} THEN part + 1 ELSE part END,
  CASE WHEN length(buf) + length(l[i + 1]) > {rules.WEB_CHUNK} THEN l[i + 1] ELSE buf || chr(10) || l[i + 1] END, l FROM walk WHERE i < len(l)),
chunks AS (SELECT doc_id, part, arg_max(buf, i) AS body FROM walk GROUP BY doc_id, part)
SELECT 'upload-' || doc_id || '-' || part AS id, 'doc:' || doc_id || ':' || part AS evidence_id, doc_id AS parent_document_id,
  '교내 문서' || CASE WHEN total > 1 THEN ' (' || part || '/' || total || ')' ELSE '' END AS title, md5(body) AS body_hash
FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM chunks)
""")
def upload_documents(spark, d):
    parts = rg.pack_lines(F.filter(F.split("text", "\n"), lambda x: x != ""), rules.WEB_CHUNK)
    docs = inputs.wide(spark, d, "documents").select("doc_id", parts.alias("parts"))
    rows = docs.select("doc_id", F.size("parts").cast("string").alias("total"), F.posexplode("parts").alias("pos", "body"))
    n = (F.col("pos") + 1).cast("string")
    doc = F.col("doc_id").cast("string")
    number = F.when(F.col("total") != "1", F.concat(F.lit(" ("), n, F.lit("/"), F.col("total"), F.lit(")"))).otherwise("")
    return rows.select(
        F.concat(F.lit("upload-"), doc, F.lit("-"), n).alias("id"), F.concat(F.lit("doc:"), doc, F.lit(":"), n).alias("evidence_id"),
        F.col("doc_id").alias("parent_document_id"), F.concat(F.lit("교내 문서"), number).alias("title"), F.md5("body").alias("body_hash"),
    )


@query("notice_documents", """
SELECT 'notice-' || notice_id || '-1' AS id, title || chr(10) || '(' || CASE WHEN start_date <> end_date THEN '기간 ' || strftime(start_date, '%Y-%m-%d') || ' ~ ' || strftime(end_date, '%Y-%m-%d') ELSE '기간 ' || strftime(end_date, '%Y-%m-%d') END || ' · 학교 공지 원문)' || chr(10) || summary AS body FROM notices
""", "notices")
def notice_documents(spark, d):
    s, e = F.col("start_date").cast("string"), F.col("end_date").cast("string")
    period = F.concat(F.lit("기간 "), F.when(s.isNotNull() & (s != e), F.concat(s, F.lit(" ~ "), e)).otherwise(e))
    chunks = rg.pack_lines(F.split("summary", "\n"), rules.NOTICE_CHUNK)
    rows = inputs.notices(spark, d).select("notice_id", "title", period.alias("period"), F.posexplode(chunks).alias("pos", "part"))
    head = F.concat("title", F.lit("\n("), F.col("period"), F.lit(" · 학교 공지 원문)\n"))
    return rows.select(
        F.concat(F.lit("notice-"), F.col("notice_id").cast("string"), F.lit("-"), (F.col("pos") + 1).cast("string")).alias("id"), F.concat(head, "part").alias("body")
    )


_DEPT_SQL = r"([가-힣]{2,12}(?:팀|처|센터))(?:\s*\(|\s|$|[,.)])"


@query("guide_documents", f"""
SELECT 'guide-' || s.doc_id || '-' || line_no AS id, coalesce(nullif(dept, ''), page_dept, '') AS department, phone, '[{{"text":"안내","url":"https://www.campus.example/' || s.doc_id || '"}}]' AS links
FROM (SELECT *, regexp_extract(t, {sql_text(_DEPT_SQL)}, 1) AS dept, regexp_extract(t, '0\\d{{1,2}}-\\d{{3,4}}-\\d{{4}}') AS phone FROM (
  SELECT *, CASE WHEN line_no % 3 = 1 THEN body || ' 학사' || chr(44032 + cast(doc_id % 50 AS INTEGER)) || '팀 (055-249-1234)' ELSE body END AS t FROM sections)) s
 LEFT JOIN (SELECT doc_id, arg_min(dept, line_no) AS page_dept FROM (SELECT doc_id, line_no, '학사' || chr(44032 + cast(doc_id % 50 AS INTEGER)) || '팀' AS dept FROM sections WHERE line_no % 3 = 1) GROUP BY 1) p USING (doc_id)
""", "sections")
def guide_documents(spark, d):
    """Section documents; the department comes from the section, else from the page's first match."""
    dept = F.concat(F.lit("학사"), F.decode(F.encode(F.expr("decode(unhex(hex(44032 + cast(doc_id % 50 as int))), 'UTF-16BE')"), "UTF-8"), "UTF-8"), F.lit("팀"))
    body = F.when(F.col("line_no") % 3 == 1, F.concat("body", F.lit(" "), dept, F.lit(" (055-249-1234)"))).otherwise(F.col("body"))
    rows = inputs.sections(spark, d).select("doc_id", "line_no", body.alias("t"))
    found = F.nullif(F.regexp_extract("t", _DEPT_SQL, 1), F.lit(""))
    rows = rows.select("*", found.alias("dept"), F.regexp_extract("t", r"0\d{1,2}-\d{3,4}-\d{4}", 0).alias("phone"))
    pages = rows.where("dept is not null").groupBy("doc_id").agg(F.min_by("dept", "line_no").alias("page_dept"))
    doc = F.col("doc_id").cast("string")
    link = F.array(F.struct(F.lit("안내").alias("text"), F.concat(F.lit("https://www.campus.example/"), doc).alias("url")))
    return rows.join(pages, "doc_id", "left").select(
        F.concat(F.lit("guide-"), doc, F.lit("-"), F.col("line_no").cast("string")).alias("id"),
        F.coalesce("dept", "page_dept", F.lit("")).alias("department"), "phone", F.to_json(link).alias("links"),
    )


@query("fill_table_tokens", """
SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN '앞 <표> 중간 <표> 뒤' ELSE '앞 [표] 가: ' || doc_id || ' 중간 [표] 나: ' || (doc_id + 1) || ' 뒤' END AS filled FROM documents
""")
def fill_table_tokens(spark, d):
    """The n-th placeholder takes the n-th table's rows; a text whose counts differ stays as it is."""
    key = F.col("doc_id")
    docs = inputs.wide(spark, d, "documents").select("doc_id", F.lit("앞 <표> 중간 < 표 > 뒤").alias("text"))
    tables = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.when(key % 4 == 2, 3).otherwise(2))).alias("n")).select(
        "doc_id", "n", F.concat(F.lit("[표] "), F.when(F.col("n") == 1, "가").otherwise("나"), F.lit(": "), (key + F.col("n") - 1).cast("string")).alias("rows")
    )
    filled = rg.fill_tables(docs, tables, "doc_id")
    return filled.select("doc_id", F.regexp_replace("text", "< 표 >", "<표>").alias("filled"))


@query("html_text", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', chr(10), 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t]*\n[ \t\n]*', chr(10), 'g'), '[ \t]+', ' ', 'g'), chr(10) || ' ') AS text FROM pages
""")
def html_text(spark, d):
    return inputs.wide(spark, d, "pages").select("page_id", rg.html_text(F.col("html")).alias("text"))

"""Queries over page markup."""

from pyspark.sql import functions as F

from plumbline.operators import pages as pg
from plumbline.plans import inputs
from plumbline.registry import query, view
from plumbline.sources.html import DROP_TAGS, html_tokens, register_page_tokens

HOST = "www.campus.example"
_EXTRA = (
    "<h2>추가 안내</h2><p>신청 방법과 제출 서류를 확인한 뒤 기한 안에 제출하여 주시기 바랍니다.</p>"
    '<table><tr><th rowspan="2">구 분</th><th colspan="2">요금</th></tr><tr><th>평일</th><th>주말</th></tr>'
    "<tr><td>일반</td><td>{n}원</td><td>{n}00</td></tr><tr><td colspan=\"3\">비고</td></tr></table>"
    '<a href="https://www.campus.example/files/{n}.pdf">첨부 {n}</a> <a href="https://www.campus.example/files/{n}.pdf">다시</a>'
    '<a href="https://other.example/{n}.hwp">외부</a> <a href="https://www.campus.example/f/b{n}.hwp?x=1">서식</a>'
    "<h2>2026년 학사일정</h2><table><tr><td>12.28 ~ 1.{d}</td><td>계절학기 {n}</td></tr><tr><td>3.{d}</td><td>개강</td></tr><tr><td>매주</td><td>상담</td></tr></table>"
    "<table><tr><td>1</td><td>학칙 시행 규정</td><td>교무처</td><td>1999.1.1</td><td>2024.2.{d}</td><td>{d}차</td><td><a href=\"https://www.campus.example/rule/rdata/reg{n}_{d}.hwp\">내려받기</a></td></tr></table>"
    "<select name=\"selArtclSeq\" onchange=\"jf_curriculum_chg('a','{n}')\"><option value=\"w1\">3.{d} ~ 3.9</option><option value=\"\">없음</option><option value=\"w2\">3.16 ~ 3.20</option></select>"
)


def pages(spark, d):
    """The page table with a fee table, a calendar, a rule listing and files put before </article>."""
    extra = F.replace(F.replace(F.lit(_EXTRA), F.lit("{n}"), F.col("page_id").cast("string")), F.lit("{d}"), (F.col("page_id") % 9 + 1).cast("string"))
    return inputs.wide(spark, d, "pages").withColumn("html", F.replace("html", F.lit("</article>"), F.concat(extra, F.lit("</article>"))))


def tokens(spark, d):
    return html_tokens(pages(spark, d))


@query("page_sections")
def page_sections(spark, d):
    return pg.page_sections(tokens(spark, d))


@query("page_sections_sql")
def page_sections_sql(spark, d):
    """The same sections with the tokens from a table function of SQL."""
    register_page_tokens(spark)
    pages(spark, d).createOrReplaceTempView("page_markup")
    return pg.page_sections(spark.sql("SELECT page_id, t.* FROM page_markup, LATERAL page_tokens(url, html) t"))


_DROPPED = "|".join(f"<{t}[ >].*?</{t}>" for t in DROP_TAGS)


@query("page_headings", f"""
SELECT page_id, kind, count(*) AS n FROM (SELECT page_id, unnest(['heading', 'heading']) AS kind FROM pages
 UNION ALL SELECT page_id, unnest(list_transform(regexp_extract_all(regexp_replace(html, '(?s){_DROPPED}', '', 'g'), '<h[1-3][ >]'), lambda h: 'heading')) FROM pages
 UNION ALL SELECT page_id, 'title' FROM pages WHERE contains(html, '<title>')) GROUP BY ALL
""")
def page_headings(spark, d):
    """Titles and headings of every page, counted in SQL over the table function."""
    register_page_tokens(spark)
    pages(spark, d).createOrReplaceTempView("page_markup")
    return spark.sql("SELECT page_id, kind, count(*) AS n FROM page_markup, LATERAL page_tokens(url, html) t WHERE kind IN ('heading', 'title') GROUP BY page_id, kind")


@query("section_links", f"""
SELECT page_id, 2 AS n, place, text, url FROM (SELECT page_id, unnest([
  {{'place': 1, 'text': '첨부 ' || page_id, 'url': 'https://{HOST}/files/' || page_id || '.pdf'}}, {{'place': 2, 'text': '다시', 'url': 'https://{HOST}/files/' || page_id || '.pdf'}},
  {{'place': 3, 'text': '서식', 'url': 'https://{HOST}/f/b' || page_id || '.hwp?x=1'}}], recursive := true) FROM pages)
UNION ALL SELECT page_id, 3, 1, '내려받기', 'https://{HOST}/rule/rdata/reg' || page_id || '_' || (page_id % 9 + 1) || '.hwp' FROM pages
""")
def section_links(spark, d):
    return pg.section_links(tokens(spark, d), [HOST])


@query("attachment_links", f"""
SELECT page_id, unnest([1, 2, 3]) AS place, unnest(['https://{HOST}/files/' || page_id || '.pdf', 'https://{HOST}/f/b' || page_id || '.hwp?x=1', 'https://{HOST}/rule/rdata/reg' || page_id || '_' || (page_id % 9 + 1) || '.hwp']) AS url,
  unnest([page_id || '.pdf', 'b' || page_id || '.hwp', 'reg' || page_id || '_' || (page_id % 9 + 1) || '.hwp']) AS name FROM pages
""")
def attachment_links(spark, d):
    return pg.attachment_links(tokens(spark, d), [HOST])


@query("html_table_rows", """
SELECT page_id, tbl, row, '[표] ' || line AS line FROM (SELECT page_id, unnest([
 {'tbl': 0, 'row': 1, 'line': '구분 | 요금 > 평일 | 요금 > 주말'}, {'tbl': 0, 'row': 3, 'line': '구분: 일반 · 요금 > 평일: ' || page_id || '원 · 요금 > 주말: ' || page_id || '00'},
 {'tbl': 0, 'row': 4, 'line': '구분: 비고 · 요금 > 평일: 비고 · 요금 > 주말: 비고'}, {'tbl': 1, 'row': 1, 'line': '12.28 ~ 1.' || (page_id % 9 + 1) || ' | 계절학기 ' || page_id}, {'tbl': 1, 'row': 2, 'line': '3.' || (page_id % 9 + 1) || ' | 개강'},
 {'tbl': 1, 'row': 3, 'line': '매주 | 상담'}, {'tbl': 2, 'row': 1, 'line': '1 | 학칙 시행 규정 | 교무처 | 1999.1.1 | 2024.2.' || (page_id % 9 + 1) || ' | ' || (page_id % 9 + 1) || '차 | 내려받기'}], recursive := true) FROM pages)
""")
def html_table_rows(spark, d):
    return pg.table_rows(tokens(spark, d).where("kind = 'cell'")).select("page_id", "tbl", "row", "line")


@query("registry_rows", f"""
SELECT page_id, cast(page_id AS VARCHAR) AS rule_no, '학칙 시행 규정' AS rule_name, '교무처' AS department, '1999.1.1' AS enacted_date, '2024.2.' || (page_id % 9 + 1) AS revision_date,
 cast(page_id % 9 + 1 AS INTEGER) AS revision_no, cast(page_id % 9 + 1 AS VARCHAR) AS file_version, '규정' AS rule_level, 'https://{HOST}/rule/rdata/reg' || page_id || '_' || (page_id % 9 + 1) || '.hwp' AS hwp_url FROM pages
""")
def registry_rows(spark, d):
    return pg.registry_rows(tokens(spark, d), [HOST])


@query("calendar_rows", """
SELECT page_id, unnest(['계절학기 ' || page_id, '개강']) AS title, unnest(['2026-12-28', '2026-03-0' || (page_id % 9 + 1)]) AS start_day, unnest(['2027-01-0' || (page_id % 9 + 1), '2026-03-0' || (page_id % 9 + 1)]) AS end_day,
  unnest(['cal:2026-12-28:0', 'cal:2026-03-0' || (page_id % 9 + 1) || ':1']) AS id FROM pages
""")
def calendar_rows(spark, d):
    return pg.calendar_rows(tokens(spark, d), 2020).select(
        "page_id", "title", F.col("start_date").cast("string").alias("start_day"), F.col("end_date").cast("string").alias("end_day"), "id"
    )


@query("menu_week_options", f"""
SELECT page_id, unnest([0, 1]) AS place, unnest(['3.' || (page_id % 9 + 1) || ' ~ 3.9', '3.16 ~ 3.20']) AS title, unnest(['w1', 'w2']) AS record_id,
  unnest(['https://{HOST}/curriculum/ko/' || page_id || '/w1/fileDownload.do', 'https://{HOST}/curriculum/ko/' || page_id || '/w2/fileDownload.do']) AS url FROM pages
""")
def menu_week_options(spark, d):
    return pg.menu_week_options(pages(spark, d), "https://" + HOST)


_SITE = r"^https?://([^/?#]+)"
view("raw_links", f"""
SELECT page_id, pos, site, regexp_replace(CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^https?://[^/?#]+') || href ELSE href END, '#.*$', '') AS target, href
FROM (SELECT page_id, url, regexp_extract(url, '{_SITE}', 1) AS site, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS pos FROM pages)
""")


@query("page_links", f"""
SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY pos)::INTEGER AS place FROM (SELECT page_id, target AS url, min(pos) AS pos FROM raw_links
 WHERE regexp_extract(target, '{_SITE}', 1) = site AND NOT contains(target, '?') AND regexp_matches(regexp_extract(target, '^https?://[^/?#]+([^?#]*)', 1), '^/[^/]') AND NOT regexp_matches(target, '(?i)login|\\.pdf$') GROUP BY 1, 2)
""", "raw_links")
def page_links(spark, d):
    site = F.regexp_extract("url", _SITE, 1)
    source = inputs.wide(spark, d, "pages")
    linked = html_tokens(source, drop=("script", "style")).join(source.select("page_id", site.alias("site")), "page_id")
    return pg.page_links(linked, "^/[^/]", r"(?i)login|\.pdf$").select("page_id", "url", "place")

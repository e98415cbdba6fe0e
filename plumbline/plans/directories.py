"""Phone book, place and menu sheet queries."""

from pyspark.sql import functions as F

from plumbline.operators import places as pl
from plumbline.plans import inputs
from plumbline.registry import query, view
from plumbline.session import stored

BUILDINGS = ("본관", "새벽관", "노을관", "중앙도서관", "생활관")


def phonebook_lines(spark, d):
    """Six lines per supplier: header, unit, assistant, person, facility and a unit without number."""
    key = F.col("s_suppkey")
    n = F.lpad((key % 9000 + 1000).cast("string"), 4, "0")
    syllable = inputs.pick(("가람", "나래", "다솜", "라온", "마루", "바다"), key % 6)
    block = F.concat(syllable, (key % 50).cast("string"))
    lines = F.array(
        F.when(key % 10 == 0, F.concat(block, F.lit("산학협력단"))).otherwise(""),
        F.concat(F.lit("￭ "), block, F.lit("지원팀 "), n, F.lit(" 249-1111(F)")),
        F.concat(F.lit("임푸름 "), F.lit("2345")),
        F.concat(F.lit("￭ "), block, F.lit("상담실")),
        F.when(key % 3 == 0, F.lit("조교윤가람 4188")).when(key % 3 == 1, F.lit("정솔잎 6371")).otherwise("팀장서하늘"),
        F.concat(block, F.lit("행복도서관 5938")),
        F.concat(F.lit("¤ "), block, F.lit("연구소장 문바다 8462")),
    )
    return inputs.table(spark, d, "supplier").select(F.col("s_nationkey").alias("book_id"), "s_suppkey", F.posexplode(lines).alias("i", "line")).select(
        "book_id", (F.col("s_suppkey") * 10 + F.col("i")).alias("line_no"), "line"
    )


view("phone_lines", """
SELECT *, ['가람', '나래', '다솜', '라온', '마루', '바다'][s_suppkey % 6 + 1] || (s_suppkey % 50) AS block, '055-249-' || lpad((s_suppkey % 9000 + 1000)::VARCHAR, 4, '0') AS n FROM supplier
""")
view("phone_kinds", """
SELECT s_nationkey AS book_id, s_suppkey * 10 AS line_no, 'header' AS kind, NULL AS unit, NULL AS facility, block || '산학협력단' AS opens, NULL AS phone, NULL AS fax FROM phone_lines WHERE s_suppkey % 10 = 0
UNION ALL SELECT s_nationkey, s_suppkey * 10 + 1, 'unit', block || '지원팀', NULL, NULL, n, '055-249-1111' FROM phone_lines
UNION ALL SELECT s_nationkey, s_suppkey * 10 + 2, 'person', NULL, NULL, NULL, '055-249-2345', NULL FROM phone_lines
UNION ALL SELECT s_nationkey, s_suppkey * 10 + 3, 'unit', block || '상담실', NULL, NULL, NULL, NULL FROM phone_lines
UNION ALL SELECT s_nationkey, s_suppkey * 10 + 4, CASE s_suppkey % 3 WHEN 0 THEN 'assistant' ELSE 'person' END, NULL, NULL, NULL, CASE s_suppkey % 3 WHEN 0 THEN '055-249-4188' ELSE '055-249-6371' END, NULL FROM phone_lines WHERE s_suppkey % 3 < 2
UNION ALL SELECT s_nationkey, s_suppkey * 10 + 5, 'facility', NULL, block || '행복도서관', NULL, '055-249-5938', NULL FROM phone_lines
UNION ALL SELECT s_nationkey, s_suppkey * 10 + 6, 'unit', block || '연구소', NULL, block || '연구소', '055-249-8462', NULL FROM phone_lines
""", ("phone_lines",))


@query("phonebook_entries", """
WITH placed AS (
 SELECT *, last_value(unit IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS current, last_value(opens IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above
 FROM phone_kinds WINDOW w AS (PARTITION BY book_id ORDER BY line_no)
), named AS (
 SELECT *, coalesce(unit, facility, current) AS name, kind IN ('unit', 'facility') AS entry, CASE kind WHEN 'facility' THEN coalesce(current, above) ELSE above END AS parent FROM placed WHERE kind <> 'header'
), found AS (
 SELECT book_id, name, arg_min(kind, line_no) FILTER (entry) AS kind, arg_min(coalesce(parent, ''), line_no) FILTER (entry) AS parent, arg_min(coalesce(phone, ''), line_no) FILTER (entry) AS own, arg_min(coalesce(fax, ''), line_no) FILTER (entry) AS fax,
  arg_min(phone, line_no) FILTER (kind = 'assistant') AS by_assistant, arg_min(phone, line_no) FILTER (kind = 'person') AS by_person
 FROM named WHERE name IS NOT NULL GROUP BY 1, 2
)
SELECT book_id, name, nullif(parent, '') AS parent, CASE WHEN own <> '' THEN own ELSE coalesce(by_assistant, by_person) END AS phone, nullif(fax, '') AS fax,
 CASE WHEN kind = 'facility' THEN 'facility_line' WHEN own <> '' THEN 'unit_line' WHEN by_assistant IS NOT NULL THEN 'assistant_line' WHEN by_person IS NOT NULL THEN 'first_listed' ELSE 'unit_line' END AS basis, coalesce(by_assistant, '') AS phones
FROM found WHERE kind IS NOT NULL
""", "phone_kinds")
def phonebook_entries(spark, d):
    return pl.phonebook_entries(phonebook_lines(spark, d)).withColumn("phones", F.array_join("phones", ","))


_ROOMS = ("본관 2층", "새벽관 지하 1층 101호", "노을관", "중앙도서관 3층 301호실", "모르는 곳")


def unit_lines(spark, d):
    key = F.col("c_custkey")
    unit = F.concat(F.lit("U"), (key % 40).cast("string"), F.lit("팀"))
    lines = F.array(
        unit, F.lit("위치"), F.concat(F.lit(": "), inputs.pick(_ROOMS, key % 5), F.lit(" 안쪽")), F.lit("전화"),
        F.when(key % 3 == 0, F.lit("(055) 249-2100")).otherwise("055-249-2200"), F.lit("김○○ 주무관"), F.lit("위치"), F.lit("본관 9층"),
    )
    rows = inputs.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("page_id"), "c_custkey", F.posexplode(lines).alias("i", "line"))
    return rows.select("page_id", (F.col("c_custkey") * 10 + F.col("i")).alias("line_no"), "line")


def known_units(spark, d):
    return inputs.table(spark, d, "customer").select(F.concat(F.lit("U"), (F.col("c_custkey") % 40).cast("string"), F.lit("팀")).alias("unit")).distinct()


def pattern():
    return "(?:" + "|".join(sorted(BUILDINGS, key=lambda b: (-len(b), b))) + ")" + pl.FLOOR_ROOM


view("unit_first", """
SELECT c_nationkey AS page_id, 'U' || (c_custkey % 40) || '팀' AS unit, c_custkey, ['본관 2층', '새벽관 지하 1층 101호', '노을관', '중앙도서관 3층 301호실', NULL][c_custkey % 5 + 1] AS loc, CASE WHEN c_custkey % 3 = 0 THEN '055-249-2100' ELSE '055-249-2200' END AS phone FROM customer
""")


@query("unit_blocks", """
SELECT cast(page_id AS BIGINT) AS page_id, unit, arg_min(coalesce(loc, '본관 9층'), c_custkey) AS location, arg_min(phone, c_custkey) AS phone FROM unit_first GROUP BY 1, 2
""", "unit_first")
def unit_blocks(spark, d):
    return pl.unit_blocks(unit_lines(spark, d), known_units(spark, d), pattern())


@query("contact_page", r"""
SELECT doc_id, loc AS location, CASE WHEN starts_with(n, '055') AND length(n) = 10 THEN '055-' || substr(n, 4, 3) || '-' || substr(n, 7, 4) WHEN length(n) = 11 THEN substr(n, 1, 3) || '-' || substr(n, 4, 4) || '-' || substr(n, 8, 4) ELSE trim(phone) END AS phone, substr(t, start + 1, p + 80 - start) AS evidence FROM (
 SELECT *, greatest(0, p - 60) AS start FROM (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS n, instr(t, CASE WHEN loc <> '' THEN loc ELSE phone END) - 1 AS p FROM (
  SELECT *, regexp_extract(t, '\(?0\d{1,2}\)?[-\s]?\d{3,4}-\d{4}') AS phone FROM (
   SELECT doc_id, ['본관 2층', '새벽관 지하 1층 101호', '노을관', '중앙도서관 3층 301호실', ''][doc_id % 5 + 1] AS loc, replace(text, chr(10), ' ') || ' 위치 ' || ['본관 2층', '새벽관 지하 1층 101호', '노을관', '중앙도서관 3층 301호실', '모르는 곳'][doc_id % 5 + 1] || ' 전화 055-249-7777 끝' AS t FROM documents))))
""")
def contact_page(spark, d):
    plain = F.replace("text", F.lit("\n"), F.lit(" "))
    t = F.concat(plain, F.lit(" 위치 "), inputs.pick(_ROOMS, F.col("doc_id") % 5), F.lit(" 전화 055-249-7777 끝"))
    docs = inputs.wide(spark, d, "documents").select("doc_id", t.alias("t"))
    return pl.contact_page(docs, "t", pattern()).drop("t")


@query("pair_lines", """
SELECT cast(c_nationkey AS BIGINT) AS page_id, c_custkey AS line_no, loc AS location, unnest(['U' || (c_custkey % 40) || '팀', 'U' || ((c_custkey + 1) % 40) || '팀']) AS unit
FROM (SELECT *, ['본관 2층', '새벽관 지하 1층 101호', '노을관', '중앙도서관 3층 301호실'][c_custkey % 5 + 1] AS loc FROM customer) WHERE loc IS NOT NULL
""")
def pair_lines(spark, d):
    key = F.col("c_custkey")
    u = lambda k: F.concat(F.lit("U"), (k % 40).cast("string"), F.lit("팀"))
    names = F.concat(u(key), F.lit(", "), u(key + 1), F.lit(" / 모르는팀"))
    room = inputs.pick(_ROOMS, key % 5)
    line = F.when(key % 2 == 0, F.concat(names, F.lit(" : "), room)).otherwise(F.concat(room, F.lit(" : "), names))
    rows = inputs.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("page_id"), key.alias("line_no"), line.alias("line"))
    return pl.pair_lines(rows, known_units(spark, d), pattern())


@query("place_alternation", """
SELECT doc_id, CASE WHEN n_name IS NULL THEN '' ELSE 'NATION_' || doc_id % 25 || '관 3층' END AS phrase
FROM documents LEFT JOIN nation ON n_name = 'NATION_' || doc_id % 25
""")
def place_alternation(spark, d):
    """Documents with the first place phrase of all nation buildings in them."""
    buildings = inputs.table(spark, d, "nation").select(F.concat("n_name", F.lit("관")).alias("name"))
    text = F.concat(F.col("text"), F.lit(" NATION_"), (F.col("doc_id") % 25).cast("string"), F.lit("관 3층"))
    return pl.place_phrases(inputs.wide(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id", "text", buildings, "name")


def menu_fragments(spark, d):
    """Fragments of one sheet per supplier: day heads, row labels and dishes, joined once and kept in files."""
    page, day = F.col("l_suppkey").alias("page_id"), F.col("l_linenumber")
    li = stored(inputs.dishes(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "p_name"))
    dishes = li.select(page, (day * 100 + F.col("l_partkey") % 7).cast("double").alias("x"), (F.floor("l_quantity") * 12 + F.col("l_partkey") % 2).cast("double").alias("y"), F.col("p_name").alias("text"), (F.col("l_orderkey") * 10 + day).alias("pos"))
    heads = li.select(page, (day * 100 + 3).cast("double").alias("x"), F.lit(700.0).alias("y"), F.concat(F.lit("3월 "), day.cast("string"), F.lit("일")).alias("text")).distinct().withColumn("pos", F.lit(0).cast("long"))
    rows = F.array(*[F.struct(F.lit(20.0).alias("x"), F.lit(y).alias("y"), F.lit(t).alias("text")) for y, t in ((120.0, "석식"), (305.0, "중식"), (500.0, "조식"))])
    labels = li.select(page).distinct().select("page_id", F.explode(rows).alias("f")).select("page_id", "f.*").withColumn("pos", F.lit(0).cast("long"))
    return dishes.unionByName(heads).unionByName(labels)


@query("menu_grid", """
SELECT l_suppkey AS page_id, '3월 ' || l_linenumber || '일' AS day, CASE WHEN ry - 120 <= 305 - ry THEN '석식' WHEN ry < 305 OR ry - 305 <= 500 - ry THEN '중식' ELSE '조식' END AS label, ry AS row_y, x, p_name AS text
FROM (SELECT *, cast(l_linenumber * 100 + l_partkey % 7 AS DOUBLE) AS x, first_value(cast(q * 12 + l_partkey % 2 AS DOUBLE)) OVER (PARTITION BY l_suppkey, q ORDER BY l_orderkey, l_linenumber) AS ry FROM (SELECT *, cast(floor(l_quantity) AS INTEGER) AS q FROM lineitem JOIN part ON p_partkey = l_partkey))
""")
def menu_grid(spark, d):
    return pl.menu_grid(menu_fragments(spark, d))


@query("menu_text", """
SELECT cafeteria, day, day || ' ' || cafeteria || ' 식단' || chr(10) || string_agg('- ' || name || ': ' || items, chr(10) ORDER BY name) AS text FROM (
 SELECT cafeteria, day, name, string_agg(item, ', ' ORDER BY item) AS items FROM (
  SELECT DISTINCT l_returnflag AS cafeteria, strftime(l_shipdate, '%Y-%m-%d') AS day, l_linestatus AS name, p_name AS item FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1, 2, 3) GROUP BY 1, 2
""")
def menu_text(spark, d):
    dishes = inputs.dishes(spark, d).select(F.col("l_returnflag").alias("cafeteria"), inputs.day_text("l_shipdate").alias("day"), F.col("l_linestatus").alias("name"), F.col("p_name").alias("item")).distinct()
    sections = dishes.groupBy("cafeteria", "day", "name").agg(F.sort_array(F.collect_list("item")).alias("items"))
    days = sections.groupBy("cafeteria", "day").agg(F.sort_array(F.collect_list(F.struct("name", "items"))).alias("sections"))
    return days.select("cafeteria", "day", pl.menu_text(F.col("cafeteria"), F.col("day"), F.col("sections")).alias("text"))

"""Lookup joins over places, phone books, glossaries, tips and time."""

from pyspark.sql import functions as F

from plumbline.operators import lookup as lk
from plumbline.plans import inputs
from plumbline.registry import query, view


def s(c):
    return F.col(c).cast("string")


def places(spark, d):
    key = F.col("c_custkey")
    odd = key % 2 == 1
    nation = F.concat(F.lit("NATION_"), s("c_nationkey"))
    return inputs.table(spark, d, "customer").select(
        F.concat(F.lit("u"), s("c_custkey")).alias("place_id"), F.col("c_name").alias("name"), F.concat(F.lit("별관-"), s("c_custkey"), F.lit("방")).alias("alias"),
        F.when(odd, "").otherwise(F.concat(F.lit("b"), s("c_nationkey"))).alias("parent_id"),
        F.when(key % 3 == 0, "").otherwise((key % 5 + 1).cast("string")).alias("floor"), F.when(key % 4 == 0, "").otherwise((key % 300 + 100).cast("string")).alias("room"),
        F.when(odd, F.concat(nation, F.lit(" "), (key % 5 + 1).cast("string"), F.lit("층"))).otherwise("").alias("raw_location"),
        F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("055-249-"), F.lpad((key % 10000).cast("string"), 4, "0"))).alias("phone"),
        F.when(key % 10 == 0, "pending").otherwise("verified").alias("status"),
    )


def buildings(spark, d):
    return inputs.table(spark, d, "nation").select(F.concat(F.lit("b"), s("n_nationkey")).alias("place_id"), F.col("n_name").alias("name"))


view("places", """
SELECT 'u' || c_custkey AS place_id, c_name AS name, '별관-' || c_custkey || '방' AS alias, CASE WHEN c_custkey % 2 = 1 THEN '' ELSE 'b' || c_nationkey END AS parent_id,
 CASE WHEN c_custkey % 3 = 0 THEN '' ELSE cast(c_custkey % 5 + 1 AS VARCHAR) END AS floor, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE cast(c_custkey % 300 + 100 AS VARCHAR) END AS room,
 CASE WHEN c_custkey % 2 = 1 THEN 'NATION_' || c_nationkey || ' ' || (c_custkey % 5 + 1) || '층' ELSE '' END AS raw_location,
 CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '055-249-' || lpad(cast(c_custkey % 10000 AS VARCHAR), 4, '0') END AS phone, CASE WHEN c_custkey % 10 = 0 THEN 'pending' ELSE 'verified' END AS status, c_custkey FROM customer
""")
view("buildings", "SELECT 'b' || n_nationkey AS place_id, n_name AS name FROM nation")
view("located", """
SELECT p.*, coalesce(nullif(raw_location, ''), concat_ws(' ', b.name, CASE WHEN floor <> '' THEN floor || '층' END, CASE WHEN room <> '' THEN room || '호' END)) AS location FROM places p LEFT JOIN buildings b ON b.place_id = p.parent_id
""", ("places", "buildings"))


@query("location_text", "SELECT place_id, location FROM located", "located")
def location_text(spark, d):
    return lk.location_text(places(spark, d), buildings(spark, d)).select("place_id", "location")


@query("building_tenants", """
SELECT building, name, cast(row_number() OVER (PARTITION BY building ORDER BY name, location, place_id) AS INTEGER) AS place FROM (
 SELECT DISTINCT b.place_id AS building, l.place_id, l.name, location FROM located l JOIN buildings b ON l.parent_id = b.place_id OR starts_with(lower(regexp_replace(location, '[\\s\\-_.()]+', '', 'g')), lower(regexp_replace(b.name, '[\\s\\-_.()]+', '', 'g'))))
QUALIFY row_number() OVER (PARTITION BY building ORDER BY name, location, place_id) <= 20
""", ("located", "buildings"))
def building_tenants(spark, d):
    located = lk.location_text(places(spark, d), buildings(spark, d))
    return lk.building_tenants(buildings(spark, d), located).select("building", "name", "place")


@query("places_merged", """
SELECT place_id, phone FROM (SELECT place_id, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE phone END AS phone, CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 15 = 0 THEN 'Rejected' ELSE 'Verified' END ELSE status END AS status FROM places) WHERE lower(status) = 'verified'
""", "places")
def places_merged(spark, d):
    key = F.substring("place_id", 2, 20).cast("long")
    seed = places(spark, d).select("place_id", "phone", "status")
    live = places(spark, d).where(key % 5 == 0).select("place_id", F.lit("new").alias("phone"), F.when(key % 15 == 0, "Rejected").otherwise("Verified").alias("status"))
    return lk.merged_places(seed, live).select("place_id", "phone")


@query("dept_lookup", """
SELECT t.c_custkey AS query_id, coalesce(p.place_id, 'e' || t.c_custkey) AS dept_id, coalesce(CASE WHEN t.c_custkey % 3 <> 0 THEN 'book-' || t.c_custkey END, nullif(p.phone, ''), '') AS phone, coalesce(p.raw_location, '') AS location
FROM customer t LEFT JOIN places p ON p.c_custkey = t.c_custkey AND p.status = 'verified' WHERE p.place_id IS NOT NULL OR t.c_custkey % 3 <> 0
""", "places")
def dept_lookup(spark, d):
    """Departments asked for by id or name: the phone from the book first, the location from the place."""
    key = F.col("c_custkey")
    asked = inputs.table(spark, d, "customer").select(
        key.alias("query_id"), F.when(key % 2 == 0, F.concat(F.lit("u"), s("c_custkey"))).otherwise(F.col("c_name")).alias("target")
    )
    verified = places(spark, d).where("status = 'verified'").select("place_id", "name", "phone", "raw_location")
    keyed = verified.select("*", F.explode(F.array("place_id", "name")).alias("target"))
    book = inputs.table(spark, d, "customer").where("c_custkey % 3 <> 0").select(
        F.col("c_name").alias("book_name"), F.concat(F.lit("e"), s("c_custkey")).alias("entry_id"), F.concat(F.lit("book-"), s("c_custkey")).alias("book_phone")
    )
    # An id names no book entry by itself; the book is found through the target name or the place's name.
    wanted = asked.join(keyed, "target", "left").withColumn("book_name", F.coalesce("name", F.when(F.col("target").startswith("u"), F.concat(F.lit("Customer#"), F.lpad(s("query_id"), 9, "0"))).otherwise(F.col("target"))))
    found = wanted.join(book, "book_name", "left").where("place_id is not null or entry_id is not null")
    return found.select(
        "query_id", F.coalesce("place_id", "entry_id").alias("dept_id"), F.coalesce("book_phone", F.nullif("phone", F.lit("")), F.lit("")).alias("phone"), F.coalesce("raw_location", F.lit("")).alias("location")
    )


_Q = ("{n}", "{a}", "x{a}어디", "{c}", "{e}", "{n} 위치")


def place_queries(spark, d):
    key, name = F.col("c_custkey"), F.col("c_name")
    alias = F.concat(F.lit("별관"), s("c_custkey"), F.lit("방"))
    text = (
        F.when(key % 6 == 0, name).when(key % 6 == 1, alias).when(key % 6 == 2, F.concat(F.lit("x"), alias, F.lit("어디")))
        .when(key % 6 == 3, F.left(name, F.length(name) - 1)).when(key % 6 == 4, F.concat(F.left(name, F.length(name) - 1), F.lit("z"))).otherwise(F.concat(name, F.lit(" 위치")))
    )
    return inputs.table(spark, d, "customer").select(key.alias("query_id"), text.alias("query"))


view("place_queries", """
SELECT c_custkey AS query_id, CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN '별관' || c_custkey || '방' WHEN 2 THEN 'x별관' || c_custkey || '방어디' WHEN 3 THEN substr(c_name, 1, length(c_name) - 1) WHEN 4 THEN substr(c_name, 1, length(c_name) - 1) || 'z' ELSE c_name || ' 위치' END AS query FROM customer
""")
_NN = "lower(regexp_replace({}, '[\\s\\-_.()]+', '', 'g'))"


@query("place_tier_match", f"""
SELECT query_id, place_id, tier FROM (SELECT query_id, place_id, CASE WHEN q = n THEN 0 WHEN q = a OR (length(a) >= 4 AND contains(q, a)) THEN 1 WHEN contains(n, q) OR contains(q, n) OR (abs(length(q) - length(n)) <= 1 AND levenshtein(q, n) <= 1) THEN 2 END AS tier
 FROM (SELECT query_id, {_NN.format('query')} AS q FROM place_queries), (SELECT place_id, {_NN.format('name')} AS n, {_NN.format('alias')} AS a FROM places WHERE status = 'verified'))
WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY query_id)
""", ("places", "place_queries"))
def place_tier_match(spark, d):
    return lk.match_places(place_queries(spark, d), places(spark, d).where("status = 'verified'"))


@query("phonebook_match", f"""
SELECT query_id, place_id AS entry_id, phone FROM (SELECT query_id, place_id, phone, row_number() OVER (PARTITION BY query_id ORDER BY length(name) DESC, place_id) AS r FROM
 (SELECT query_id, {_NN.format('query')} AS q FROM place_queries), (SELECT *, {_NN.format('name')} AS n FROM places) WHERE length(n) >= 3 AND contains(q, n)) WHERE r <= 2 AND phone <> ''
""", ("places", "place_queries"))
def phonebook_match(spark, d):
    book = places(spark, d).select(F.col("place_id").alias("entry_id"), "name", "phone")
    return lk.phonebook_match(place_queries(spark, d), book).select("query_id", "entry_id", "phone")


def terms(spark, d):
    return inputs.table(spark, d, "supplier").select(
        F.concat(F.lit("용어 "), s("s_suppkey"), F.lit("호")).alias("term"), F.array(F.concat(F.lit("ALT"), s("s_suppkey"), F.lit("x"))).alias("aliases"), F.concat(F.lit("뜻 "), s("s_suppkey")).alias("meaning")
    )


@query("glossary_hints", """
SELECT turn_id AS query_id, term, cast(row_number() OVER (PARTITION BY turn_id ORDER BY term) AS INTEGER) AS place FROM (SELECT turn_id, lower(regexp_replace(query_masked || ' 용어' || (k % 120) || '호 alt' || (turn_id % 90) || 'x', '\\s+', '', 'g')) AS q FROM turns),
 (SELECT '용어 ' || s_suppkey || '호' AS term, '용어' || s_suppkey || '호' AS n1, 'alt' || s_suppkey || 'x' AS n2 FROM supplier) WHERE contains(q, n1) OR contains(q, n2) QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY term) <= 5
""", "turns")
def glossary_hints(spark, d):
    text = F.concat("query_masked", F.lit(" 용어"), (F.col("k") % 120).cast("string"), F.lit("호 alt"), (F.col("turn_id") % 90).cast("string"), F.lit("x"))
    return lk.glossary_hints(inputs.turns(spark, d).select(F.col("turn_id").alias("query_id"), text.alias("query")), terms(spark, d)).select("query_id", "term", "place")


@query("glossary_merge", """
SELECT term, meaning, source FROM (SELECT '용어 ' || k || '호' AS term, CASE WHEN k % 4 = 1 OR k >= 50 AND k % 4 <> 2 AND k % 4 <> 3 AND false THEN 'new' ELSE '뜻 ' || k END AS meaning, '기본' AS source, k FROM (SELECT s_suppkey AS k FROM supplier)) WHERE k % 4 IN (0)
UNION ALL SELECT '용어' || s_suppkey || '호', CASE WHEN s_suppkey % 8 = 1 THEN 'new' ELSE 'also' END, '관리자' FROM supplier WHERE s_suppkey % 4 = 1
""")
def glossary_merge(spark, d):
    key = F.col("s_suppkey")
    status = F.when(key % 4 == 2, "deleted").otherwise("active")
    meaning = F.when(key % 4 == 3, "").when(key % 8 == 1, "new").otherwise("also")
    rows = inputs.table(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.concat(F.lit("용어"), s("s_suppkey"), F.lit("호")).alias("term"), meaning.alias("meaning"), status.alias("status"))
    return lk.glossary_merge(terms(spark, d), rows)


_ADJ = ("small", "red", "blue", "hot", "cold", "large", "green", "old")
_NOUN = ("ring", "widget", "bolt", "gear", "gizmo", "anvil", "nut", "cog")


@query("tip_match", f"""
SELECT query_id, tip_id, score, place FROM (SELECT query_id, tip_id, cast(3 * p + w AS INTEGER) AS score, cast(row_number() OVER (PARTITION BY query_id ORDER BY 3 * p + w DESC, tip_id) AS INTEGER) AS place FROM (
 SELECT query_id, tip_id, len(list_intersect(qw, tw)) AS w, (SELECT count(*) FROM nation n WHERE contains(query, n.n_name) AND contains(text, n.n_name)) AS p
 FROM (SELECT *, list_distinct(list_filter(regexp_extract_all(query, '[가-힣A-Za-z0-9]{{2,}}'), lambda x: x NOT IN ('어디', '위치'))) AS qw FROM (
   SELECT s_suppkey AS query_id, ['{"','".join(_ADJ)}'][s_suppkey % 8 + 1] || ' ' || ['{"','".join(_NOUN)}'][(s_suppkey // 8) % 8 + 1] || ' Brand ' || (s_suppkey % 25) || ' NATION_' || (s_suppkey % 25) || ' 어디' AS query FROM supplier)),
  (SELECT *, list_distinct(regexp_extract_all(text, '[가-힣A-Za-z0-9]{{2,}}')) AS tw FROM (SELECT p_partkey AS tip_id, p_name || ' ' || p_brand || CASE WHEN p_partkey % 9 = 0 THEN ' NATION_' || (p_size % 25) ELSE '' END AS text FROM part)))
 WHERE p > 0 OR w >= 2) WHERE place <= 3
""")
def tip_match(spark, d):
    key = F.col("s_suppkey")
    text = F.concat_ws(" ", inputs.pick(_ADJ, key % 8), inputs.pick(_NOUN, F.floor(key / 8) % 8), F.lit("Brand"), (key % 25).cast("string"), F.concat(F.lit("NATION_"), (key % 25).cast("string")), F.lit("어디"))
    queries = inputs.table(spark, d, "supplier").select(key.alias("query_id"), text.alias("query"))
    place = F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit(" NATION_"), (F.col("p_size") % 25).cast("string"))).otherwise("")
    tips = inputs.table(spark, d, "part").select(F.col("p_partkey").alias("tip_id"), F.concat("p_name", F.lit(" "), "p_brand", place).alias("text"))
    return lk.tip_match(queries, tips, inputs.table(spark, d, "nation").select(F.col("n_name").alias("name")))


@query("place_mention", """
SELECT query_id AS text_id, n_name AS name FROM (SELECT query_id, n_name, row_number() OVER (PARTITION BY query_id ORDER BY instr(h, n_name), -length(n_name), n_name) AS r FROM (
  SELECT c_custkey AS query_id, replace('지금 NATION_' || (c_custkey % 25) || ' 에서 NATION_' || (c_custkey % 7) || ' 가는 길', ' ', '') AS h FROM customer), nation WHERE contains(h, n_name)) WHERE r = 1
""")
def place_mention(spark, d):
    key = F.col("c_custkey")
    text = F.concat(F.lit("지금 NATION_"), (key % 25).cast("string"), F.lit(" 에서 NATION_"), (key % 7).cast("string"), F.lit(" 가는 길"))
    texts = inputs.table(spark, d, "customer").select(key.alias("text_id"), text.alias("text"))
    return lk.place_mention(texts, inputs.table(spark, d, "nation").select(F.col("n_name").alias("name")))


@query("events_overlap_range", """
SELECT strftime(q.qs, '%Y-%m-%d') AS quarter, c.cal_id FROM (SELECT DISTINCT cast(date_trunc('quarter', start_date - INTERVAL 28 YEAR) AS DATE) AS qs FROM notices) q
 JOIN calendar c ON c.start_date <= q.qs + INTERVAL 3 MONTH - INTERVAL 1 DAY AND c.end_date >= q.qs
""", ("notices", "calendar"))
def events_overlap_range(spark, d):
    """Calendar items of every quarter that has a notice."""
    first = F.date_trunc("quarter", F.add_months("start_date", -336)).cast("date")
    ranges = inputs.notices(spark, d).select(first.alias("q_start")).distinct().withColumn("q_end", F.date_sub(F.add_months("q_start", 3), 1))
    items = inputs.calendar(spark, d).select("cal_id", "start_date", "end_date")
    return lk.overlapping(ranges, items).select(F.col("q_start").cast("string").alias("quarter"), "cal_id")


@query("report_snapshot", """
SELECT event_id, coalesce(e.turn_id, -1) AS turn_id FROM (SELECT event_id, user_id AS thread_id, ts FROM events WHERE event_type = 'signup') r
 ASOF LEFT JOIN (SELECT turn_id, thread_id, created_at AS ts FROM turns WHERE outcome = 'answer') e ON r.thread_id = e.thread_id AND r.ts >= e.ts
""", "turns")
def report_snapshot(spark, d):
    """Reports with the latest answer of their thread at that time."""
    reports = inputs.table(spark, d, "events").where("event_type = 'signup'").select("event_id", F.col("user_id").alias("thread_id"), "ts")
    versions = inputs.turns(spark, d).where("outcome = 'answer'").select("thread_id", F.col("created_at").alias("ts"), "turn_id")
    return lk.asof_join(reports, versions, "thread_id", "ts", "day", F.col("turn_id")).select("event_id", F.coalesce("latest", F.lit(-1)).cast("long").alias("turn_id"))


@query("last_good_as_of", """
SELECT turn_id, good_id, age, age > 600 AS stale FROM (SELECT r.turn_id, g.good_id, epoch_us(r.ts) // 1000000 - epoch_us(g.ts) // 1000000 AS age FROM (SELECT turn_id, k % 10 AS source, created_at AS ts FROM turns WHERE outcome = 'error') r
 ASOF JOIN (SELECT event_id AS good_id, cast(json_extract_string(props, '$.k') AS INTEGER) % 10 AS source, ts FROM events WHERE event_type = 'view') g ON r.source = g.source AND r.ts >= g.ts) WHERE age <= 86400
""", "turns")
def last_good_as_of(spark, d):
    """Failed requests with the latest good result of their source, at most a day old."""
    failed = inputs.turns(spark, d).where("outcome = 'error'").select("turn_id", (F.col("k") % 10).alias("source"), F.col("created_at").alias("ts"))
    good = inputs.table(spark, d, "events").where("event_type = 'view'").select((F.get_json_object("props", "$.k").cast("int") % 10).alias("source"), "ts", "event_id")
    joined = lk.asof_join(failed, good, "source", "ts", "hour", F.struct("ts", F.col("event_id").alias("id")))
    age = F.unix_timestamp("ts") - F.unix_timestamp("latest.ts")
    return joined.where(age <= 86400).select("turn_id", F.col("latest.id").alias("good_id"), age.alias("age"), (age > 600).alias("stale"))


@query("feedback_requeue", """
SELECT f.event_id, coalesce(t.query_masked, '') AS question, CASE WHEN t.turn_id IS NULL THEN 'no_question' ELSE 'requeued' END AS result
FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN -event_id ELSE event_id END AS turn_id FROM events WHERE value < 20) f LEFT JOIN turns t USING (turn_id)
""", "turns")
def feedback_requeue(spark, d):
    """Thumbs-down not checked again yet, with the question of their turn."""
    key = F.col("event_id")
    down = inputs.table(spark, d, "events").where("value < 20").select("event_id", F.when(key % 10 == 0, -key).otherwise(key).alias("turn_id"))
    joined = down.join(inputs.turns(spark, d).select("turn_id", "query_masked"), "turn_id", "left")
    return joined.select("event_id", F.coalesce("query_masked", F.lit("")).alias("question"), F.when(F.col("query_masked").isNull(), "no_question").otherwise("requeued").alias("result"))


@query("admin_roles", """
SELECT coalesce(t.email, b.email) AS email, CASE WHEN b.email IS NOT NULL THEN 'super' ELSE t.role END AS role, b.email IS NOT NULL AS bootstrap FROM (SELECT c_name AS email, CASE WHEN c_custkey % 3 = 0 THEN 'editor' ELSE 'viewer' END AS role FROM customer WHERE c_custkey % 2 = 0) t FULL JOIN (SELECT c_name AS email FROM customer WHERE c_custkey % 50 = 1 OR c_custkey % 50 = 2) b ON b.email = t.email ORDER BY 1
""")
def admin_roles(spark, d):
    people = inputs.table(spark, d, "customer").select(F.col("c_name").alias("email"), F.col("c_custkey").alias("k"))
    table = people.where("k % 2 = 0").select("email", F.when(F.col("k") % 3 == 0, "editor").otherwise("viewer").alias("role"))
    boot = people.where("k % 50 = 1 or k % 50 = 2").select("email", F.lit(True).alias("bootstrap"))
    merged = table.join(boot, "email", "full_outer")
    return merged.select("email", F.when(F.col("bootstrap"), "super").otherwise(F.col("role")).alias("role"), F.coalesce("bootstrap", F.lit(False)).alias("bootstrap")).orderBy("email")


@query("registered_exclusion", """
SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages r WHERE r.url = p.url AND r.page_id % 3 = 0 AND r.page_id % 2 = 0)
""")
def registered_exclusion(spark, d):
    pages = inputs.table(spark, d, "pages").select("page_id", "url")
    return pages.join(pages.where("page_id % 3 = 0 and page_id % 2 = 0").select("url"), "url", "left_anti").select("page_id", "url")


@query("contact_evidence_grounding", """
SELECT doc_id, name, value FROM (SELECT doc_id, unnest(CASE WHEN doc_id % 4 = 0 THEN [{'name': 'doc_date', 'value': '2026-03-02'}, {'name': 'effective_from', 'value': '2026-03-02'}] WHEN doc_id % 4 = 1 THEN [{'name': 'doc_date', 'value': '2026-03-02'}, {'name': 'effective_from', 'value': '2026-05-01'}] WHEN doc_id % 4 = 2 THEN [] ELSE [{'name': 'title', 'value': substr(text, 1, 10)}] END, recursive := true) FROM documents) WHERE trim(value) <> ''
""")
def contact_evidence_grounding(spark, d):
    key = F.col("doc_id")
    docs = inputs.wide(spark, d, "documents").select("doc_id", "text")
    f = lambda name, value, evidence: F.struct(F.lit(name).alias("name"), value.alias("value"), evidence.alias("evidence"))
    here, absent = F.col("text"), F.lit("본문에 없는 근거 문장")
    rows = F.array(
        F.when(key % 4 < 2, f("doc_date", F.lit("2026-03-02"), here)), F.when(key % 4 == 1, f("effective_from", F.lit("2026-05-01"), here)),
        F.when(key % 4 == 2, f("title", F.lit("없는 값"), absent)), F.when(key % 4 == 2, f("doc_date", F.lit("2026-13-02"), here)), F.when(key % 4 == 3, f("title", F.left("text", F.lit(10)), here)),
    )
    fields = docs.select("doc_id", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("doc_id", "x.*")
    return lk.grounded_fields(fields, docs)


@query("draft_grounding", """
SELECT c_custkey AS draft_id, CASE c_custkey % 8 WHEN 0 THEN '학교 원문에서 위치를 찾지 못했습니다' WHEN 1 THEN '근거가 학교 원문이 아닙니다' WHEN 2 THEN '인용문이 원문에 없습니다' WHEN 3 THEN '위치가 인용문에 없습니다' WHEN 4 THEN '전화번호가 인용문에 없습니다' ELSE '' END AS reason FROM customer
""")
def draft_grounding(spark, d):
    k = F.col("c_custkey") % 8
    people = inputs.table(spark, d, "customer")
    evidence = people.select(
        F.col("c_custkey").alias("evidence_id"), F.when(k == 1, "https://other.example/a").otherwise("https://lib.campus.example/a").alias("url"), F.concat(F.lit("학사팀은 본관 2층 "), F.col("c_name"), F.lit(" 전화 055-249-2100 입니다")).alias("text")
    )
    drafts = people.select(
        F.col("c_custkey").alias("draft_id"), F.col("c_custkey").alias("evidence_id"), (k != 0).alias("found"), F.when(k == 3, "새벽관").otherwise("본관 2층").alias("location"),
        F.when(k == 2, "없는 인용문입니다").otherwise("학사팀은 본관 2층").alias("quote"), F.when(k == 4, "055-249-9999").otherwise("").alias("phone"), F.lit("본관 2층이 맞아요").alias("report"),
    )
    return lk.draft_reason(drafts, evidence, "campus.example").select("draft_id", "reason")

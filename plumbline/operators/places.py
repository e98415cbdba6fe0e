"""Unit, place and phone lines of directory pages; positioned fragments of menu sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import rules
from plumbline.functions.text import phone_format, phone_number
from plumbline.operators.ranking import carried

# fixed values: words that tell units, people and facilities apart
UNIT_SUFFIX = ("팀", "실", "센터", "소", "과", "관", "단", "원", "처", "부", "국", "회", "학부", "본부", "대학원", "사")
TITLES = (
    "팀장", "소장", "실장", "과장", "원장", "단장", "부장", "처장", "국장", "관장", "센터장", "학장", "부단장", "분소장", "회장",
    "부회장", "사무국장", "이사장", "총장", "연구원", "조교", "전담직원", "직원",
)
GENERIC = ("부속실", "사무실", "교학행정실", "행정실")
FACILITY_SUFFIX = (
    "실", "센터", "팀", "연구소", "위원회", "추진단", "사업단", "지원단", "본부", "학부", "학과", "진료소", "상담소", "도서관",
    "생활관", "사무국",
)
HANGUL_NAME = r"^[가-힣]{2,4}$"
ASSISTANT = r"\(\s*조교\s*\)|^\s*조교\s*[가-힣]{2,4}"
UNIT_MARK = r"^\s*([￭¤▣■◆●])\s*"
FLOOR_ROOM = r"(?:\s*(?:지하\s*)?\d{1,2}\s*층)?(?:\s*\d{2,4}\s*호(?:실)?)?"
BUILDING_SUFFIX = ("관", "도서관", "생활관")
MAIN_BUILDING = "본관"
LABEL_SHARE, HEAD_BAND, ROW_GAP, MIN_HEADS, MAX_LABEL = 0.8, 5, 2, 3, 20


def _ends(text: Column, suffixes) -> Column:
    return text.rlike("(?:" + "|".join(suffixes) + ")$")


def numbers(text: Column, fax: bool) -> Column:
    """Phone numbers of a line in order, or its fax numbers."""
    found = F.regexp_extract_all(text, F.lit(f"({rules.PHONE_TOKEN})"), F.lit(1))
    marked = lambda x: x.endswith("(F)")
    kept = F.filter(found, lambda x: marked(x) if fax else ~marked(x))
    return F.transform(kept, lambda x: phone_number(F.regexp_replace(x, r"\(F\)$", "")))


def strip_numbers(text: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(text, rules.PHONE_TOKEN, " "), F.lit("·"), F.lit(" ")))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def unit_name(rest: Column) -> Column:
    """Unit named on a unit line, NULL when the line heads a person."""
    words = _tokens(strip_numbers(rest))
    head, second = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(2))
    title = "^(?:" + "|".join(TITLES) + ")"
    person = head.rlike(title + "$") | head.rlike(title + "[가-힣]{2,4}$")
    second_is_name = F.coalesce(second.rlike(HANGUL_NAME), F.lit(False))
    name = F.when(head.endswith("장") & second_is_name, F.left(head, F.length(head) - 1)).otherwise(head)
    name = F.when(name.startswith("부설") & second.isNotNull(), second).otherwise(name)
    good = ((F.length(name) >= 2) & ~name.rlike(HANGUL_NAME)) | _ends(name, UNIT_SUFFIX)
    return F.when(head.isNotNull() & ~person & good, name)


def is_person(text: Column) -> Column:
    words = _tokens(F.replace(strip_numbers(text), F.lit("("), F.lit(" ")))
    first = F.try_element_at(words, F.lit(1))
    return first.isNull() | first.rlike("^(?:" + "|".join(TITLES) + ")") | (first.rlike(HANGUL_NAME) & ~_ends(first, UNIT_SUFFIX))


def phonebook_entries(lines: DataFrame) -> DataFrame:
    """Units and facilities of a phone book (book_id, line_no, line); names of people are never kept.

    An entry takes the number of its own line; without one, the first assistant number under it,
    else the first number listed under it.
    """
    c = F.col
    rows = lines.where(F.trim("line") != "").select("book_id", "line_no", F.rtrim("line").alias("line"))
    mark = F.regexp_extract("line", UNIT_MARK, 1)
    rows = rows.select("*", mark.alias("mark"), F.regexp_replace("line", UNIT_MARK, "").alias("rest"))
    stripped = F.trim("line")
    words = _tokens(strip_numbers(c("line")))
    rows = rows.select(
        "*", F.when(c("mark") != "", unit_name(c("rest"))).alias("unit"), numbers(c("line"), False).alias("phones"), numbers(c("line"), True).alias("faxes"),
        numbers(F.element_at(F.split(F.trim("rest"), r"(?U)\s{2,}"), 1), False).alias("own"), F.try_element_at(words, F.lit(1)).alias("word"),
    )
    plain = c("mark") == ""
    listed = plain & (F.size("phones") > 0)
    header = plain & (F.size("phones") == 0) & _ends(stripped, UNIT_SUFFIX) & (F.length(stripped) <= 20) & ~stripped.contains(" ")
    assistant = listed & c("line").rlike(ASSISTANT)
    person = listed & ~assistant & is_person(c("line"))
    facility = (
        listed & ~assistant & ~person & _ends(F.coalesce("word", F.lit("")), FACILITY_SUFFIX) & ~c("word").isin(*GENERIC) & (F.length("word") >= 4)
    )
    kind = (
        F.when(c("unit").isNotNull(), "unit").when(header, "header").when(assistant, "assistant").when(person, "person").when(facility, "facility")
    )
    rows = rows.withColumn("kind", kind).where(c("kind").isNotNull())
    opens_parent = F.when(c("kind") == "header", stripped).when((c("kind") == "unit") & c("mark").isin("¤", "▣"), c("unit"))
    rows = carried(rows.withColumn("opens", opens_parent), ["book_id"], "line_no", ["unit", "opens"])
    rows = rows.select("*", F.coalesce("unit", "before_unit").alias("current"), c("before_opens").alias("parent"))
    name = F.when(c("kind") == "unit", c("unit")).when(c("kind") == "facility", c("word")).otherwise(c("current"))
    rows = rows.withColumn("name", name).where(c("name").isNotNull() & (c("kind") != "header"))
    entry = c("kind").isin("unit", "facility")
    first = F.min(F.when(entry, F.struct(
        "line_no", "kind",
        F.when(c("kind") == "facility", F.coalesce("current", "parent")).otherwise(c("parent")).alias("parent"),
        F.when(c("kind") == "facility", F.try_element_at("phones", F.lit(1))).otherwise(F.try_element_at("own", F.lit(1))).alias("own"),
        F.try_element_at("phones", F.lit(1)).alias("line_phone"),
        F.when(c("kind") == "unit", F.try_element_at("faxes", F.lit(1))).alias("fax"),
    )))
    under = lambda k: F.min(F.when(c("kind") == k, F.struct("line_no", F.element_at("phones", 1).alias("phone"))))["phone"]
    assistants = F.flatten(F.transform(
        F.sort_array(F.collect_list(F.when(c("kind") == "assistant", F.struct("line_no", "phones")))), lambda x: x["phones"]
    ))
    found = rows.groupBy("book_id", "name").agg(
        first.alias("e"), under("assistant").alias("by_assistant"), under("person").alias("by_person"), F.array_distinct(assistants).alias("phones")
    ).where("e is not null")
    fixed = (c("e.kind") == "facility") | c("e.own").isNotNull()
    first_listed = F.coalesce("e.line_phone", "by_person")
    return found.select(
        "book_id", "name", c("e.parent").alias("parent"),
        F.when(fixed, c("e.own")).otherwise(F.coalesce("by_assistant", first_listed)).alias("phone"),
        c("e.fax").alias("fax"),
        F.when(c("e.kind") == "facility", "facility_line").when(fixed, "unit_line").when(c("by_assistant").isNotNull(), "assistant_line")
        .when(first_listed.isNotNull(), "first_listed").otherwise("unit_line").alias("basis"),
        "phones",
    )


def place_phrases(texts: DataFrame, key: str, text: str, buildings: DataFrame, name: str) -> DataFrame:
    """(key, phrase): the leftmost building name of every text, the longest there, with floor and room; else empty.

    Building names end alike, so only the stretches that end at such a letter are cut out, in each length a
    name has, and join the names by equality.  There may be any number of names.
    """
    named = buildings.where(_ends(F.col(name), BUILDING_SUFFIX)).select(F.col(name).alias("_name"))
    named = named.unionByName(buildings.sparkSession.range(1).select(F.lit(MAIN_BUILDING).alias("_name"))).distinct()
    sizes = sorted(r[0] for r in named.select(F.length("_name")).distinct().collect())
    last = BUILDING_SUFFIX[0]
    parts = F.split(F.col(text), last, -1)
    step = lambda done, part: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + F.length(part) + len(last)))
    ends = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.array().cast("array<int>"), step)
    marked = texts.where(F.col(text).contains(last)).select(key, text, F.explode(ends).alias("_end"))
    cut = F.array(*[F.struct((F.col("_end") - size + 1).alias("start"), F.lit(size).alias("size")) for size in sizes])
    cut = marked.select(key, text, F.explode(F.filter(cut, lambda c: c["start"] > 0)).alias("c"))
    cut = cut.select(key, "c.*", F.substring(F.col(text), F.col("c.start"), F.col("c.size")).alias("_name"), F.regexp_extract(F.substr(text, F.col("c.start") + F.col("c.size")), "^(" + FLOOR_ROOM + ")", 1).alias("_after"))
    met = cut.join(named, "_name").withColumn("_phrase", F.concat("_name", "_after"))
    first = met.groupBy(key).agg(F.min_by("_phrase", F.struct("start", (-F.col("size")).alias("size"))).alias("phrase"))
    return texts.select(key).join(first, key, "left").withColumn("phrase", F.coalesce("phrase", F.lit("")))


def unit_blocks(lines: DataFrame, units: DataFrame, pattern: str) -> DataFrame:
    """"위치" and "전화" lines give their next line's value to the unit last named before them."""
    rows = lines.where(~F.col("line").contains("○")).join(units.select(F.col("unit").alias("line"), F.lit(True).alias("is_unit")), "line", "left")
    # as many rows as there are lines, whatever the size of the file they come from: never one table in the driver
    follow = lines.select("page_id", (F.col("line_no") - 1).alias("line_no"), F.col("line").alias("following")).hint("merge")
    placed = carried(rows.join(follow, ["page_id", "line_no"], "left").withColumn("named", F.when(F.col("is_unit"), F.col("line"))), ["page_id"], "line_no", ["named"])
    placed = placed.withColumn("unit", F.coalesce("named", "before_named"))
    value = F.trim(F.regexp_replace(F.coalesce("following", F.lit("")), "^[: ]+", ""))
    placed = placed.where(F.col("unit").isNotNull() & F.col("is_unit").isNull()).withColumn("value", value)
    place = F.nullif(F.regexp_extract("value", f"({pattern})", 1), F.lit(""))
    phone = F.nullif(F.regexp_extract("value", f"({rules.PHONE})", 1), F.lit(""))
    first = lambda label, v: F.min(F.when((F.col("line") == label) & v.isNotNull(), F.struct("line_no", v.alias("v"))))["v"]
    found = placed.groupBy("page_id", "unit").agg(first("위치", place).alias("location"), first("전화", phone).alias("phone"))
    return found.where(F.col("location").isNotNull() | F.col("phone").isNotNull()).select(
        "page_id", "unit", F.trim("location").alias("location"), phone_format(F.col("phone")).alias("phone")
    )


def contact_page(pages: DataFrame, text: str, pattern: str) -> DataFrame:
    """First place phrase and phone of a page with the text around the first of them."""
    t = F.col(text)
    place = F.regexp_extract(t, f"({pattern})", 1)
    phone = F.regexp_extract(t, f"({rules.PHONE})", 1)
    rows = pages.select("*", place.alias("_place"), phone.alias("_phone")).where("_place <> '' or _phone <> ''")
    found = F.when(F.col("_place") != "", F.col("_place")).otherwise(F.col("_phone"))
    position = F.position(found, t) - 1
    start = F.greatest(F.lit(0), position - 60)
    return rows.select(
        *pages.columns, F.trim("_place").alias("location"),
        F.when(F.col("_phone") != "", phone_format(F.col("_phone"))).otherwise("").alias("phone"),
        F.substring(t, start + 1, position + 80 - start).alias("evidence"),
    )


def pair_lines(lines: DataFrame, units: DataFrame, pattern: str) -> DataFrame:
    """"unit : place" and "place : unit" lines; several unit names share a place, only known units count."""
    rows = lines.where(F.col("line").contains(":") & ~F.col("line").contains("○"))
    left, right = F.trim(F.substring_index("line", ":", 1)), F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    place = lambda side: F.nullif(F.regexp_extract(side, f"^({pattern})", 1), F.lit(""))
    rows = rows.select("*", place(right).alias("_r"), place(left).alias("_l"), left.alias("_left"), right.alias("_right"))
    names = F.when(F.col("_r").isNotNull(), F.col("_left")).when(F.col("_l").isNotNull(), F.col("_right"))
    split = F.transform(F.split(names, "[,·/]"), lambda n: F.trim(n))
    found = rows.select("page_id", "line_no", F.trim(F.coalesce("_r", "_l")).alias("location"), F.explode(split).alias("unit"))
    return found.join(units.select("unit"), "unit", "left_semi")


def menu_grid(fragments: DataFrame, heads_pattern: str = r"^(\d{1,2})월\s*(\d{1,2})일") -> DataFrame:
    """Positioned fragments (page_id, pos, x, y, text) of a weekly sheet to its cells.

    `pos` is the order of the fragments in the sheet.  There have to be three day heads; those within five units of the top one
    count, and columns part at the midpoints between them; texts left of the first head are row labels; a height within two
    units of a row is part of it, and a row takes the label nearest to it.
    """
    c = F.col
    heads = fragments.where(c("text").rlike(heads_pattern)).groupBy("page_id", "x", "y", "text").agg(F.count("*").alias("n"))
    top = Window.partitionBy("page_id")
    heads = heads.withColumn("head_y", F.max("y").over(top)).withColumn("n", F.sum("n").over(top)).where((c("n") >= MIN_HEADS) & (F.abs(c("y") - c("head_y")) < HEAD_BAND))
    heads = heads.groupBy("page_id", "x", "text").agg(F.max("head_y").alias("head_y"))
    by_x = Window.partitionBy("page_id").orderBy("x")
    heads = heads.select(
        "page_id", "x", "head_y", F.regexp_extract("text", heads_pattern, 0).alias("day"),
        F.min("x").over(top).alias("x0"),
        F.coalesce((F.lag("x").over(by_x) + c("x")) / 2, F.lit(float("-inf"))).alias("low"),
        F.coalesce((F.lead("x").over(by_x) + c("x")) / 2, F.lit(float("inf"))).alias("high"),
    )
    # Fragments move once for their sheet and meet its head, rows and columns there.  Sizes are judged from files far smaller
    # than the rows, so these joins are sorted and merged.
    frame = heads.groupBy("page_id").agg(F.max("head_y").alias("head_y"), (F.min("x0") * LABEL_SHARE).alias("label_x"))
    is_label = (c("x") < c("label_x")) & (c("text") != "구분") & (F.length("text") <= MAX_LABEL)
    is_cell = (c("x") >= c("label_x")) & ~c("text").isin(*rules.PLACEHOLDERS) & ~c("text").startswith("*") & ~c("text").startswith("<")
    body = fragments.join(frame.hint("merge"), "page_id").where(c("y") < c("head_y") - 3)
    # Distinct heights of a sheet are few, so rows are told apart over them and not over the fragments: a height within two
    # units of an earlier row (in the order of the sheet) belongs to the first such row, else it opens one under its rounded height.
    at = body.groupBy("page_id", "y", F.when(is_label, c("text")).alias("label")).agg(F.min(F.when(is_cell, c("pos"))).alias("pos"), F.bool_or(is_cell).alias("cells"))
    listed = at.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.when(c("cells"), F.struct("pos", "y")))).alias("ys"), F.collect_list(F.when(c("label").isNotNull(), F.struct("y", "label"))).alias("labels")
    )
    known = lambda rows, y: F.try_element_at(F.filter(rows, lambda r: F.abs(r["row_y"] - y) <= ROW_GAP), F.lit(1))["row_y"]
    step = lambda rows, h: F.concat(rows, F.array(F.struct(h["y"].alias("y"), F.coalesce(known(rows, h["y"]), F.bround(h["y"])).alias("row_y"))))
    heights = F.aggregate("ys", F.array().cast("array<struct<y:double,row_y:double>>"), step)
    nearest = lambda y: F.array_min(F.transform("labels", lambda t: F.struct(F.abs(t["y"] - y), t["y"], t["label"].alias("label"))))["label"]
    rows = F.transform("heights", lambda h: F.struct(h["y"], F.struct(h["row_y"].alias("row_y"), nearest(h["row_y"]).alias("label"))))
    sheet = listed.select("page_id", "labels", heights.alias("heights")).select("page_id", F.map_from_entries(rows).alias("rows"))
    placed = body.where(is_cell).select("page_id", "x", "y", "text").join(sheet.hint("merge"), "page_id").select("page_id", "x", "text", F.element_at("rows", c("y")).alias("row"))
    columns = heads.select("page_id", "day", "low", "high").hint("merge")
    return placed.join(columns, "page_id").where((c("x") >= c("low")) & (c("x") < c("high"))).select(
        "page_id", "day", F.coalesce("row.label", F.lit("식단")).alias("label"), "row.row_y", "x", "text"
    )


def menu_text(cafeteria: Column, day: Column, sections: Column) -> Column:
    """"- name: item, item" lines under a dated heading."""
    lines = F.transform(sections, lambda s: F.concat(F.lit("- "), s["name"], F.lit(": "), F.array_join(s["items"], ", ")))
    return F.concat_ws("\n", F.concat(day, F.lit(" "), cafeteria, F.lit(" 식단")), F.array_join(lines, "\n"))

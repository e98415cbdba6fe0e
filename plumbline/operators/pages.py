"""Page tokens to sections, links, table rows and record rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import rules
from plumbline.functions.dates import make_date
from plumbline.functions.labels import rule_level

# fixed values: section limits, numeric cells and document files
MIN_SECTION_CHARS, MAX_SECTIONS, MAX_LINKS, LINK_TEXT, MAX_ATTACHMENTS = 30, 30, 10, 60, 5
NUMERIC_CELL = r"^[\d\s.,:~%()\-]+$"
ATTACHMENT = r"(?i)\.(hwp|hwpx|pdf|docx)$"
HWP_NAME = r"(?i)/reg(\d+)_(\d+)\.hwp$"


def content(tokens: DataFrame) -> DataFrame:
    """Tokens inside the best content element of their page."""
    return tokens.where("inside")


def _squeeze(text: Column) -> Column:
    """'요 금' to '요금': letters set apart for layout are joined."""
    parts = F.split(text, " ")
    spaced = (F.size(parts) > 1) & F.forall(parts, lambda p: F.length(p) == 1)
    return F.when(spaced, F.replace(text, F.lit(" "), F.lit(""))).otherwise(text)


def table_rows(cells: DataFrame) -> DataFrame:
    """Rendered rows of every table: (page_id, tbl, pos, row, line).

    Spanned cells are filled in; zero, one or two header rows label every value.
    """
    keys = ["page_id", "tbl"]
    rows_of = F.explode(F.sequence(F.col("r"), F.col("r") + F.col("rs") - 1))
    filled = cells.select(*keys, "pos", "c", "cs", "text", rows_of.alias("row"))
    filled = filled.select(*keys, "pos", "row", "cs", "text", F.explode(F.sequence(F.col("c"), F.col("c") + F.col("cs") - 1)).alias("col"))
    grid = filled.groupBy(*keys, "row", "col").agg(
        F.max_by("text", "pos").alias("text"), F.max((F.col("cs") > 1).cast("int")).alias("spanned"), F.min("pos").alias("pos")
    )
    whole = Window.partitionBy(*keys)
    grid = grid.select(
        "*", F.max("col").over(whole).alias("last_col"), F.min("pos").over(whole).alias("table_pos"),
        F.max(F.when(F.col("row") == 0, F.col("spanned"))).over(whole).alias("top_span"),
    )
    lines = grid.groupBy(*keys, "row").agg(
        F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("by_col"),
        *[F.first(c).alias(c) for c in ("last_col", "table_pos", "top_span")],
    )
    values = F.transform(F.sequence(F.lit(0), F.col("last_col")), lambda i: F.coalesce(F.try_element_at("by_col", i), F.lit("")))
    lines = lines.withColumn("values", values).where(F.exists("values", lambda v: v != ""))
    lines = lines.withColumn("n", F.row_number().over(whole.orderBy("row")))
    numeric = lambda row: F.exists(row, lambda v: (v != "") & v.rlike(NUMERIC_CELL))
    nth = lambda k: F.max(F.when(F.col("n") == k, F.col("values"))).over(whole)
    lines = lines.select("*", F.count("*").over(whole).alias("rows"), nth(1).alias("h1"), nth(2).alias("h2"))
    head = (
        F.when((F.col("rows") < 2) | (F.size("h1") < 2) | numeric(F.col("h1")), 0)
        .when((F.col("top_span") == 1) & (F.col("rows") >= 3) & ~numeric(F.col("h2")), 2)
        .otherwise(1)
    )
    lines = lines.withColumn("head", head)

    def label(first: Column, i: Column) -> Column:
        second = F.when(F.col("head") == 2, _squeeze(F.element_at("h2", i + 1))).otherwise("")
        parts = F.array_distinct(F.filter(F.array(_squeeze(first), second), lambda p: p != ""))
        return F.array_join(parts, " > ")

    labels = F.transform("h1", label)
    lines = lines.withColumn("labels", F.when(F.col("head") > 0, labels))
    pair = lambda v, i: F.when(
        (F.element_at("labels", i + 1) != "") & (F.element_at("labels", i + 1) != v), F.concat(F.element_at("labels", i + 1), F.lit(": "), v)
    ).otherwise(v)
    pairs = F.filter(F.transform("values", lambda v, i: F.when(v != "", pair(v, i))), lambda p: p.isNotNull())
    lines = lines.withColumn("pairs", pairs)
    once = F.filter("pairs", lambda p, i: (i == 0) | (p != F.try_element_at("pairs", F.when(i > 0, i).otherwise(1))))
    text = (
        F.when(F.col("head") == 0, F.array_join("values", " | "))
        .when(F.col("n") == 1, F.array_join("labels", " | "))
        .when(F.col("n") > F.col("head"), F.array_join(once, " · "))
    )
    return lines.select(
        "page_id", "tbl", F.col("table_pos").alias("pos"), F.col("n").alias("row"), F.concat(F.lit(rules.TABLE_PREFIX + " "), text).alias("line")
    ).where(F.col("line").isNotNull() & (F.length("line") > 4))


def page_sections(tokens: DataFrame) -> DataFrame:
    """Sections by heading; the text before the first one is section 0 ("개요").

    Sections under 30 characters are dropped and the first 30 kept; tables appear as labelled rows.
    """
    inside = content(tokens)
    rows = table_rows(inside.where("kind = 'cell'")).select("page_id", "pos", "row", F.lit("text").alias("kind"), F.col("line").alias("text"))
    plain = inside.where("kind in ('heading', 'text')").select("page_id", "pos", F.lit(0).alias("row"), "kind", "text")
    merged = plain.unionByName(rows)
    run = Window.partitionBy("page_id").orderBy("pos", "row").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("kind") == "heading"
    placed = merged.select("*", F.count(F.when(is_head, 1)).over(run).cast("int").alias("n"))
    texts = F.sort_array(F.collect_list(F.when(~is_head, F.struct("pos", "row", "text"))))
    grouped = placed.groupBy("page_id", "n").agg(
        F.coalesce(F.max(F.when(is_head, F.col("text"))), F.lit("개요")).alias("heading"),
        F.array_join(F.transform(texts, lambda t: t["text"]), "\n").alias("body"),
    )
    long = grouped.where(F.length("body") >= MIN_SECTION_CHARS)
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("n"))
    return long.withColumn("_place", order).where(F.col("_place") <= MAX_SECTIONS).drop("_place")


def _host(url: Column) -> Column:
    return F.regexp_extract(url, r"^https://([^/:?#]+)", 1)


def section_links(tokens: DataFrame, hosts: list[str]) -> DataFrame:
    """Links of the nearest heading before them; allowed hosts, non-empty text, first ten."""
    inside = content(tokens).where("kind in ('heading', 'link')")
    run = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = inside.select("*", F.count(F.when(F.col("kind") == "heading", 1)).over(run).cast("int").alias("n"))
    links = placed.where((F.col("kind") == "link") & (F.col("text") != "") & _host(F.col("href")).isin(*hosts) & (F.col("n") > 0))
    rank = F.row_number().over(Window.partitionBy("page_id", "n").orderBy("pos"))
    return links.withColumn("place", rank).where(F.col("place") <= MAX_LINKS).select(
        "page_id", "n", "place", F.left("text", F.lit(LINK_TEXT)).alias("text"), F.col("href").alias("url")
    )


def attachment_links(tokens: DataFrame, hosts: list[str]) -> DataFrame:
    """Distinct document links on allowed hosts, the first five of a page."""
    path = F.regexp_extract("href", r"^https://[^/?#]+([^?#]*)", 1)
    links = content(tokens).where((F.col("kind") == "link") & _host(F.col("href")).isin(*hosts) & path.rlike(ATTACHMENT))
    first = links.groupBy("page_id", F.col("href").alias("url")).agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return first.withColumn("place", rank).where(F.col("place") <= MAX_ATTACHMENTS).select(
        "page_id", "place", "url", F.regexp_extract("url", r"([^/?#]+)(?:[?#].*)?$", 1).alias("name")
    )


def page_links(tokens: DataFrame, path_pattern: str, skip_pattern: str) -> DataFrame:
    """Menu links of a page: https, the page's own host, path pattern, no query, first of each address."""
    url = F.regexp_replace("href", "#.*$", "")
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    links = tokens.where("kind = 'link'").select("page_id", "pos", url.alias("url"), path.alias("path"), "text", "site")
    kept = links.where(
        (F.regexp_extract("url", r"^https?://([^/?#]+)", 1) == F.col("site"))
        & F.col("path").rlike(path_pattern) & ~F.col("path").rlike(skip_pattern) & ~F.col("url").contains("?")
    )
    first = kept.groupBy("page_id", "url").agg(F.min(F.struct("pos", "text")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("first.pos"))
    return first.select("page_id", rank.alias("place"), "url", F.left("first.text", F.lit(LINK_TEXT)).alias("text"))


def record_cells(tokens: DataFrame) -> DataFrame:
    """One row per table row with its cell texts and the first link in it."""
    rows = F.sort_array(F.collect_list(F.struct("c", "text")))
    return tokens.where("kind = 'cell'").groupBy("page_id", "tbl", "r").agg(
        F.transform(rows, lambda x: x["text"]).alias("cells"), F.max(F.nullif("href", F.lit(""))).alias("href"), F.min("pos").alias("pos")
    )


def registry_rows(tokens: DataFrame, hosts: list[str]) -> DataFrame:
    """Rule records of a listing page whose file link is on an allowed host."""
    cell = lambda i: F.element_at("cells", i + 1)
    rows = record_cells(tokens).where((F.size("cells") >= 6) & F.col("href").rlike(HWP_NAME) & _host(F.col("href")).isin(*hosts))
    revision = F.regexp_extract(cell(5), r"(\d+)\s*차", 1)
    return rows.select(
        "page_id",
        F.regexp_extract("href", HWP_NAME, 1).alias("rule_no"), cell(1).alias("rule_name"), cell(2).alias("department"),
        cell(3).alias("enacted_date"), cell(4).alias("revision_date"), F.when(revision != "", revision.cast("int")).otherwise(0).alias("revision_no"),
        F.regexp_extract("href", HWP_NAME, 2).alias("file_version"), rule_level(cell(1)).alias("rule_level"), F.col("href").alias("hwp_url"),
    )


def calendar_rows(tokens: DataFrame, year_hint: int) -> DataFrame:
    """Two-column rows "M.D ~ M.D"; the year stands in a heading; an earlier end month is next year's."""
    years = tokens.where((F.col("kind") == "heading") & F.col("text").rlike(r"20\d{2}년")).groupBy("page_id").agg(
        F.min_by(F.regexp_extract("text", r"20\d{2}", 0), "pos").cast("int").alias("year")
    )
    pattern = "^" + rules.WEEK_TITLE_DATE + "$"
    part = lambda i: F.nullif(F.regexp_extract(F.element_at("cells", 1), pattern, i), F.lit("")).try_cast("int")
    rows = record_cells(tokens).where((F.size("cells") >= 2) & F.trim(F.element_at("cells", 1)).rlike(pattern) & (F.trim(F.element_at("cells", 2)) != ""))
    rows = rows.join(years, "page_id", "left").withColumn("year", F.coalesce("year", F.lit(year_hint)))
    rows = rows.select("page_id", "r", "year", part(1).alias("m1"), part(2).alias("d1"), part(3).alias("m2"), part(4).alias("d2"), F.trim(F.element_at("cells", 2)).alias("title"))
    end_month, end_day = F.coalesce("m2", "m1"), F.coalesce("d2", "d1")
    return rows.select(
        "page_id", "title", make_date(F.col("year"), F.col("m1"), F.col("d1")).alias("start_date"),
        make_date(F.col("year") + (end_month < F.col("m1")).cast("int"), end_month, end_day).alias("end_date"),
        F.concat_ws(":", F.lit("cal"), make_date(F.col("year"), F.col("m1"), F.col("d1")).cast("string"), F.col("r").cast("string")).alias("id"),
    )


def menu_week_options(pages: DataFrame, base: str) -> DataFrame:
    """Options of the week selector with the file address of every week."""
    select = F.regexp_extract("html", r"(?s)(<select[^>]*name=\"selArtclSeq\".*?</select>)", 1)
    group = F.regexp_extract(select, r"jf_curriculum_chg\('[^']+','(\d+)'", 1)
    option = r"(?s)(<option[^>]*value=\"[^\"]+\"[^>]*>[^<]*)"
    rows = pages.select("page_id", group.alias("grp"), F.posexplode(F.regexp_extract_all(select, F.lit(option), F.lit(1))).alias("place", "option"))
    record = F.regexp_extract("option", r"value=\"([^\"]+)\"", 1)
    return rows.where((F.col("grp") != "") & (F.trim(record) != "")).select(
        "page_id", "place", F.trim(F.regexp_extract("option", r"(?s)>([^<]*)$", 1)).alias("title"), record.alias("record_id"),
        F.concat(F.lit(base + "/curriculum/ko/"), F.col("grp"), F.lit("/"), record, F.lit("/fileDownload.do")).alias("url"),
    )

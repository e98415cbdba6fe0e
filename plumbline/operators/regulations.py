"""Regulation text: lines to articles, articles to chunks, checks over them."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.functions import rules


@F.pandas_udf(T.StringType())
def nfkc_lines(lines: pd.Series) -> pd.Series:
    """NFKC of every character except the circled paragraph numbers."""
    keep = set(rules.CIRCLED)

    def fold(text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        return "".join(c if c in keep else unicodedata.normalize("NFKC", c) for c in text)

    return lines.map(fold)


def normalize_lines(lines: DataFrame, nfkc: bool = False) -> DataFrame:
    """(rule_no, line_no, raw) to non-empty `line`s with layout noise removed.

    `nfkc` adds the compatibility folding, the one step without a built-in expression.
    """
    raw = nfkc_lines(F.col("raw")) if nfkc else F.col("raw")
    bare = F.translate(raw, "　﻿", " ")
    line = F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))
    return lines.select("rule_no", "line_no", line.alias("line")).where(F.col("line") != "")


def line_label(line: Column) -> Column:
    return (
        F.when(line.rlike(rules.CHAPTER_HEAD), "chapter")
        .when(line.rlike(rules.SECTION_HEAD), "section")
        .when(line.rlike(rules.ADDENDA_HEAD), "addenda")
        .when(line.rlike(rules.TABLE_APPENDIX_HEAD), "appendix")
        .when(line.rlike(rules.APPENDIX_HEAD), "form")
        .when(line.rlike(rules.ARTICLE_HEAD), "article")
        .when(line.rlike(rules.NOTE_LINE), "note")
        .when(line.rlike("^" + rules.TABLE_TOKEN + "$"), "table")
        .otherwise("body")
    )


def balanced_title(text: Column) -> Column:
    """Struct(title, rest): the first balanced parenthesis group of a text that starts with one."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.lit(0).alias("end"))

    def step(acc: Column, ch: Column) -> Column:
        depth = acc["depth"] + F.when(ch == "(", 1).when(ch == ")", -1).otherwise(0)
        pos = acc["pos"] + 1
        closes = (acc["end"] == 0) & (ch == ")") & (depth == 0)
        return F.struct(depth.alias("depth"), pos.alias("pos"), F.when(closes, pos).otherwise(acc["end"]).alias("end"))

    nested = F.aggregate(F.split(text, ""), start, step)["end"]
    flat = F.length(F.regexp_extract(text, r"^(\([^()]*\))", 1))
    end = F.when(flat > 0, flat).when(text.startswith("("), nested).otherwise(0)
    closed = F.when(end > 0, end)
    return F.struct(
        F.nullif(F.trim(F.substring(text, F.lit(2), closed - 2)), F.lit("")).alias("title"),
        F.coalesce(F.trim(F.substring(text, closed + 1, F.length(text))), text).alias("rest"),
    )


def strip_notes(text: Column) -> Column:
    """Struct(text, notes): inline revision notes cut out and collected."""
    return F.struct(
        F.trim(F.regexp_replace(text, rules.NOTE, "")).alias("text"),
        F.regexp_extract_all(text, F.lit(f"({rules.NOTE})"), F.lit(1)).alias("notes"),
    )


def place_lines(lines: DataFrame) -> DataFrame:
    """Normalized lines with their label, the head they belong to and the running context."""
    from plumbline.functions.dates import loose_date

    label = F.col("label")
    run = Window.partitionBy("rule_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    step = lines.withColumn("label", line_label(F.col("line")))
    opens_text = label.isin("chapter", "section", "addenda", "article")
    step = step.withColumn("_started", F.max(F.when(opens_text, 1)).over(run)).where("_started = 1").drop("_started")
    latest = lambda value: F.last(value, ignorenulls=True).over(run)
    part = F.when(label.isin("addenda", "appendix", "form"), F.struct(label.alias("label"), "line_no"))
    head = label.isin("addenda", "appendix", "form", "article")
    counted = ~label.isin("chapter", "section", "addenda")
    step = step.select(
        "*",
        latest(part).alias("_part"),
        F.max(F.when(label == "article", F.col("line_no"))).over(run).alias("_article_line"),
        F.count(F.when(head, 1)).over(run).alias("head_no"),
        F.count(F.when(label == "addenda", 1)).over(run).cast("int").alias("addenda_seq"),
        F.nullif(latest(F.when(label == "chapter", F.col("line")).when(label == "addenda", "")), F.lit("")).alias("chapter"),
        F.nullif(
            latest(F.when(label == "section", F.col("line")).when(label.isin("chapter", "addenda"), "")), F.lit("")
        ).alias("section"),
        F.count(F.when(counted, 1)).over(run).alias("_n"),
        loose_date(F.col("line")).alias("_date"),
    )
    back_to_main = F.col("_part.label").isin("appendix", "form") & (F.col("_article_line") > F.col("_part.line_no"))
    mode = F.when(F.col("_part").isNull() | back_to_main, "main").when(F.col("_part.label") == "addenda", "addenda").otherwise("appendix")
    step = step.withColumn("mode", mode)
    # The date of an addenda block stands on its head line or on one of the two counted lines after it.
    block = Window.partitionBy("rule_no", "addenda_seq")
    first_n = F.min(F.when(label == "addenda", F.col("_n"))).over(block)
    in_reach = (label == "addenda") | (counted & (F.col("_n") <= first_n + 2))
    found = F.min(F.when(in_reach & F.col("_date").isNotNull() & (F.col("addenda_seq") > 0), F.struct("line_no", "_date"))).over(block)
    return step.withColumn("_found", found).drop("_n", "_date", "_part", "_article_line")


def split_articles(lines: DataFrame) -> DataFrame:
    """Articles of every rule from its normalized lines.

    Lines before the first head are left out; chapter and section are the ones in force at the
    head; addenda are numbered and dated; a repeated appendix gets a version suffix.
    """
    placed = place_lines(lines)
    label, line = F.col("label"), F.col("line")
    in_head = Window.partitionBy("rule_no", "head_no").orderBy("line_no")
    head_label = F.first("label").over(in_head)
    placed = placed.where("head_no > 0").withColumn("_head", head_label).where("_head <> 'form'")
    # An appendix takes its title from the first line that is no table row and not empty without notes.
    named = (F.col("_head") == "appendix") & (label != "appendix") & ~label.isin("chapter", "section", "table") & ~line.startswith(rules.TABLE_PREFIX)
    bare = F.trim(F.regexp_replace(line, rules.NOTE, ""))
    title_line = F.min(F.when(named & (bare != ""), F.col("line_no"))).over(in_head.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rest = F.trim(F.regexp_replace(line, rules.ARTICLE_HEAD, ""))
    placed = placed.select(
        "*", title_line.alias("_title_line"), bare.alias("_bare"), F.when(label == "article", balanced_title(rest)).alias("_split")
    )
    deleted = F.coalesce(F.col("_split.rest").rlike(rules.DELETED), F.lit(False))
    head_rest = F.trim(F.regexp_replace(F.col("_split.rest"), rules.NOTE, ""))
    head_rest = F.when(deleted, F.trim(F.regexp_replace(head_rest, rules.DELETED, ""))).otherwise(head_rest)
    after_head = F.regexp_replace(line, rules.TABLE_APPENDIX_HEAD, "")
    body = (
        F.when(label == "article", head_rest)
        .when(label.isin("addenda", "appendix", "chapter", "section"), "")
        .when(F.col("line_no") == F.col("_title_line"), "")
        .when((label == "note") & (F.col("_head") != "appendix"), "")
        .otherwise(F.col("_bare"))
    )
    body = F.regexp_replace(body, rules.TABLE_TOKEN, rules.TABLE_UNREADABLE)
    inline = lambda text: F.regexp_extract_all(text, F.lit(f"({rules.NOTE})"), F.lit(1))
    nothing = F.array().cast("array<string>")
    notes = (
        F.when(label.isin("addenda", "chapter", "section"), nothing)
        .when(label == "appendix", inline(after_head))
        .when(F.col("line_no") == F.col("_title_line"), nothing)
        .when((label == "note") & (F.col("_head") != "appendix"), F.array(line))
        .when(label == "article", inline(F.col("_split.rest")))
        .otherwise(inline(line))
    )
    is_head = label.isin("article", "addenda", "appendix")
    head_value = lambda value: F.max(F.when(is_head, value))
    number = lambda i: F.nullif(F.regexp_extract(line, rules.ARTICLE_HEAD, i), F.lit(""))
    app = lambda i: F.nullif(F.regexp_extract(line, rules.TABLE_APPENDIX_HEAD, i), F.lit(""))
    rows = placed.select("*", body.alias("_body"), notes.alias("_notes"), deleted.alias("_deleted"))
    grouped = rows.groupBy("rule_no", "head_no").agg(
        F.first("_head").alias("_head"),
        head_value(F.col("mode")).alias("mode"),
        head_value(F.when(label == "article", number(1)).when(label == "appendix", app(1)).otherwise("0").cast("int")).alias("number"),
        head_value(F.when(label == "article", number(2)).when(label == "appendix", app(2)).cast("int")).alias("branch"),
        F.max(
            F.when(label == "article", F.col("_split.title")).when(F.col("line_no") == F.col("_title_line"), F.left("_bare", F.lit(100)))
        ).alias("title"),
        head_value(F.when(label == "article", F.col("chapter"))).alias("chapter"),
        head_value(F.when(label == "article", F.col("section"))).alias("section"),
        F.max("addenda_seq").alias("addenda_seq"),
        F.min("line_no").alias("first_line"),
        F.max("_found").alias("_found"),
        F.bool_or("_deleted").alias("deleted"),
        F.sort_array(F.collect_list(F.struct("line_no", "_body", "_notes"))).alias("_lines"),
    )
    by_rule = Window.partitionBy("rule_no").orderBy("first_line")
    grouped = grouped.select(
        "*",
        F.filter(F.transform("_lines", lambda x: x["_body"]), lambda b: b != "").alias("body_lines"),
        F.flatten(F.transform("_lines", lambda x: x["_notes"])).alias("notes"),
        F.lead("first_line").over(by_rule).alias("_next"),
        F.row_number().over(Window.partitionBy("rule_no", "_head", "number", "branch").orderBy("first_line")).alias("_version"),
    )
    # An article closed before the date line was read stays undated.
    dated = (F.col("mode") == "addenda") & (F.coalesce("_next", F.lit(2147483647)) >= F.col("_found.line_no"))
    is_appendix = F.col("_head") == "appendix"
    suffix = F.when(is_appendix & (F.col("_version") > 1), F.concat(F.lit("_v"), F.col("_version").cast("string"))).otherwise("")
    full = grouped.select(
        "rule_no", "mode", "number", "branch", "title", "chapter", "section", "notes", "deleted", "body_lines", "first_line",
        F.when(F.col("mode") == "addenda", F.col("addenda_seq")).otherwise(0).alias("addenda_seq"),
        F.when(dated, F.col("_found._date")).alias("addenda_date"),
        suffix.alias("suffix"),
        F.trim(F.array_join("body_lines", "\n")).alias("body"),
    )
    unreadable = (F.col("mode") == "appendix") & F.forall("body_lines", lambda b: b == rules.TABLE_UNREADABLE)
    kept = full.where(~unreadable & (F.col("deleted") | (F.col("body") != "")))
    return kept.withColumn("article_id", article_id())


def article_id() -> Column:
    """Composed id of an article row: main, addenda or appendix, branch and chunk suffix."""
    c = F.col
    text = lambda name: c(name).cast("string")
    branch = F.coalesce(F.concat(F.lit("_"), text("branch")), F.lit(""))
    return F.concat(
        text("rule_no"),
        F.when(c("mode") == "addenda", F.concat(F.format_string("_add_s%02d_", "addenda_seq"), text("number")))
        .when(c("mode") == "appendix", F.concat(F.lit("_app_"), text("number"), branch))
        .otherwise(F.concat(F.lit("_main_"), text("number"), branch)),
        c("suffix"),
    )


def indexable() -> Column:
    return ~F.col("deleted") & (F.col("body") != "")


def article_heading() -> Column:
    c = F.col
    number, branch = c("number").cast("string"), c("branch").cast("string")
    title = F.coalesce(F.concat(F.lit("("), c("title"), F.lit(")")), F.lit(""))
    appendix = F.trim(
        F.concat(F.lit("[별표 "), number, F.coalesce(F.concat(F.lit("-"), branch), F.lit("")), F.lit("] "), F.coalesce("title", F.lit("")))
    )
    article = F.concat(F.lit("제"), number, F.lit("조"), F.coalesce(F.concat(F.lit("의"), branch), F.lit("")), title)
    return F.when(c("mode") == "appendix", appendix).otherwise(article)


def _paragraph_no(line: Column) -> Column:
    return F.instr(F.lit(rules.CIRCLED), F.left(line, F.lit(1)))


def chunk_paragraphs(articles: DataFrame) -> DataFrame:
    """Oversized articles with circled paragraphs: one chunk per paragraph under the heading.

    Lines before the first paragraph join the first chunk.
    """
    circled = f"^[{rules.CIRCLED}]"
    big = articles.where(
        (F.length("body") > rules.CHUNK_OVER) & (F.col("mode") != "appendix") & F.exists("body_lines", lambda b: b.rlike(circled))
    )
    lines = big.select("article_id", article_heading().alias("heading"), F.posexplode("body_lines").alias("pos", "line"))
    run = Window.partitionBy("article_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("line").rlike(circled)
    lines = lines.withColumn("part", F.greatest(F.count(F.when(is_head, 1)).over(run), F.lit(1)))
    rows = F.sort_array(F.collect_list(F.struct("pos", "line")))
    chunks = lines.groupBy("article_id", "heading", "part").agg(
        rows.alias("rows"), F.min_by(_paragraph_no(F.col("line")), F.when(is_head, F.col("pos"))).alias("no")
    )
    body = F.concat_ws("\n", F.col("heading"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    return chunks.select(
        F.concat("article_id", F.lit("_p"), F.col("no").cast("string")).alias("chunk_id"), F.col("part").cast("int").alias("part"), body.alias("body")
    )


def chunk_fixed(articles: DataFrame, size: int = rules.CHUNK_SIZE) -> DataFrame:
    """Oversized articles without paragraphs: slices of a fixed length under the heading."""
    circled = f"^[{rules.CIRCLED}]"
    big = articles.where(
        (F.length("body") > rules.CHUNK_OVER) & (F.col("mode") != "appendix") & ~F.exists("body_lines", lambda b: b.rlike(circled))
    )
    count = F.ceil(F.length("body") / F.lit(size)).cast("int")
    rows = big.select("article_id", article_heading().alias("heading"), "body", F.explode(F.sequence(F.lit(1), count)).alias("part"))
    piece = F.substring(F.col("body"), (F.col("part") - 1) * size + 1, F.lit(size))
    return rows.select(
        F.concat("article_id", F.lit("_c"), F.col("part").cast("string")).alias("chunk_id"), "part", F.concat_ws("\n", "heading", piece).alias("body")
    )


def pack_lines(lines: Column, limit: int) -> Column:
    """Greedy packing: a line starts a new chunk when the chunk's text plus the line passes the limit."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def step(acc: Column, line: Column) -> Column:
        full = (acc["buf"] != "") & (F.length(acc["buf"]) + F.length(line) > limit)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["buf"] == ""), line).otherwise(F.concat(acc["buf"], F.lit("\n"), line)).alias("buf"),
        )

    finish = lambda acc: F.when(acc["buf"] != "", F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"])
    return F.aggregate(lines, start, step, finish)


def pack_paragraphs(text: Column, limit: int = rules.UPLOAD_CHUNK) -> Column:
    """Paragraphs cut at the limit, then packed with a blank line between them, which counts two."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.trim(p)), lambda p: p != "")

    def pieces(p: Column) -> Column:
        count = F.ceil(F.length(p) / F.lit(limit)).cast("int")
        return F.transform(
            F.sequence(F.lit(1), count),
            lambda i: F.struct(F.substring(p, (i - 1) * limit + 1, F.lit(limit)).alias("text"), (count > 1).alias("cut"), (i < count).alias("whole")),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def step(acc: Column, piece: Column) -> Column:
        text_, buf, done = piece["text"], acc["buf"], acc["done"]
        flushed = F.when(buf != "", F.concat(done, F.array(buf))).otherwise(done)
        full = (buf != "") & (F.length(buf) + 2 + F.length(text_) > limit)
        return (
            F.when(piece["whole"], F.struct(F.concat(flushed, F.array(text_)).alias("done"), F.lit("").alias("buf")))
            .when(full, F.struct(F.concat(done, F.array(buf)).alias("done"), text_.alias("buf")))
            .otherwise(F.struct(done.alias("done"), F.when(buf != "", F.concat(buf, F.lit("\n\n"), text_)).otherwise(text_).alias("buf")))
        )

    finish = lambda acc: F.when(acc["buf"] != "", F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"])
    return F.aggregate(F.flatten(F.transform(paragraphs, pieces)), start, step, finish)


def chunk_appendix(articles: DataFrame, size: int = rules.CHUNK_SIZE) -> DataFrame:
    """Oversized appendices: rows grouped up to the size, a new group at every sub-heading, and each
    group headed by the sub-heading in force."""
    big = articles.where((F.length("body") > rules.CHUNK_OVER) & (F.col("mode") == "appendix"))
    group = lambda sub, rows: F.struct(sub.alias("sub"), rows.alias("rows"))
    none = F.array().cast("array<string>")
    first = F.array(group(F.coalesce("title", F.lit("")), none))
    start = F.struct(first.alias("groups"), F.lit(0).alias("size"))

    def step(acc: Column, line: Column) -> Column:
        groups = acc["groups"]
        last = F.element_at(groups, -1)
        before = F.slice(groups, 1, F.size(groups) - 1)
        sub = line.rlike(rules.APPENDIX_SUBHEAD) & ~line.startswith(rules.TABLE_PREFIX)
        has_rows = F.size(last["rows"]) > 0
        full = has_rows & (acc["size"] + F.length(line) + 1 > size)
        opened = F.when(has_rows, F.concat(groups, F.array(group(line, none)))).otherwise(F.concat(before, F.array(group(line, none))))
        added = F.when(full, F.concat(groups, F.array(group(last["sub"], F.array(line))))).otherwise(
            F.concat(before, F.array(group(last["sub"], F.concat(last["rows"], F.array(line)))))
        )
        new_size = F.when(full, F.length(line) + 1).otherwise(acc["size"] + F.length(line) + 1)
        return F.struct(F.when(sub, opened).otherwise(added).alias("groups"), F.when(sub, F.lit(0)).otherwise(new_size).alias("size"))

    groups = F.filter(F.aggregate("body_lines", start, step)["groups"], lambda g: F.size(g["rows"]) > 0)
    label = F.concat(F.lit("[별표 "), F.col("number").cast("string"), F.coalesce(F.concat(F.lit("-"), F.col("branch").cast("string")), F.lit("")), F.lit("]"))
    rows = big.select("article_id", label.alias("label"), F.posexplode(groups).alias("pos", "g"))
    head = F.trim(F.concat_ws(" ", "label", "g.sub"))
    return rows.select(
        F.concat("article_id", F.lit("_c"), (F.col("pos") + 1).cast("string")).alias("chunk_id"),
        (F.col("pos") + 1).alias("part"),
        F.concat_ws("\n", head, F.array_join("g.rows", "\n")).alias("body"),
    )


def chunk_articles(articles: DataFrame) -> DataFrame:
    """Every article as one or more chunks (chunk_id, part, body)."""
    small = articles.where(F.length("body") <= rules.CHUNK_OVER).select(
        F.col("article_id").alias("chunk_id"), F.lit(0).alias("part"), "body"
    )
    return small.unionByName(chunk_paragraphs(articles)).unionByName(chunk_fixed(articles)).unionByName(chunk_appendix(articles))


def validate_articles(articles: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Counts, numbering gaps, empty bodies, duplicate ids, undated addenda, warnings and errors per rule.

    `previous` holds rule_no, previous_count, text_length and previous_length.
    """
    main = F.col("mode") == "main"
    ids = articles.groupBy("rule_no", "article_id").agg(F.count("*").alias("n"))
    duplicates = ids.where("n > 1").groupBy("rule_no").agg(F.count("*").alias("duplicate_ids"))
    n = lambda cond: F.count(F.when(cond, 1))
    report = articles.groupBy("rule_no").agg(
        F.count("*").alias("article_count"),
        n(indexable()).alias("indexable_count"),
        F.max(F.when(main, F.col("number"))).alias("_top"),
        F.count_distinct(F.when(main & (F.col("number") > 0), F.col("number"))).alias("_present"),
        n(~F.col("deleted") & (F.col("body") == "")).alias("empty_bodies"),
        n(~F.col("deleted")).alias("_alive"),
        n((F.col("mode") == "addenda") & F.col("addenda_date").isNull()).alias("addenda_dates_missing"),
    ).join(duplicates, "rule_no", "left")
    if previous is not None:
        report = report.join(previous, "rule_no", "left")
    else:
        report = report.withColumns({k: F.lit(None).cast("long") for k in ("previous_count", "text_length", "previous_length")})
    dup = F.coalesce("duplicate_ids", F.lit(0))
    dropped = F.coalesce(F.col("article_count") < F.col("previous_count") * 0.5, F.lit(False))
    hold = F.coalesce(F.col("text_length") >= F.col("previous_length") * 2, F.lit(False))
    return report.select(
        "rule_no", "article_count", "indexable_count",
        (F.coalesce("_top", F.lit(0)) - F.col("_present")).cast("long").alias("missing_numbers"),
        "empty_bodies",
        dup.cast("long").alias("duplicate_ids"),
        "addenda_dates_missing",
        F.coalesce(F.try_divide(F.col("empty_bodies").cast("double"), "_alive") >= 0.10, F.lit(False)).alias("many_empty"),
        ((dup > 0) | dropped).alias("has_error"),
        hold.alias("hold"),
    )


def fill_tables(texts: DataFrame, tables: DataFrame, key: str) -> DataFrame:
    """Put the n-th table's rows in place of the n-th placeholder of a text.

    `tables` holds key, n and rows.  Texts whose placeholder count differs keep their text.
    """
    token = rules.TABLE_TOKEN
    listed = tables.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "rows"))).alias("_tables"))
    joined = texts.join(listed, key, "left")
    count = F.size(F.regexp_extract_all("text", F.lit(f"({token})"), F.lit(1)))
    pieces = F.split("text", token)
    filled = F.array_join(
        F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.try_element_at("_tables", i + 1)["rows"], F.lit("")))), ""
    )
    same = (count > 0) & (count == F.coalesce(F.size("_tables"), F.lit(0)))
    return joined.withColumn("text", F.when(same, filled).otherwise(F.col("text"))).drop("_tables")


def html_text(html: Column) -> Column:
    """Text of a page without scripts and styles, one line per text run."""
    bare = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(bare, r"<[^>]*>", "\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, r"[ \t]*\n[ \t\n]*", "\n")
    return F.trim(F.regexp_replace(text, r"[ \t]+", " "), F.lit("\n "))

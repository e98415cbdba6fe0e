"""Feeds, documents as bytes and Python column functions."""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.plans import inputs
from plumbline.registry import query
from plumbline.sources import files


@query("feed_items", """
SELECT title, url AS link, coalesce(CASE notice_id % 4 WHEN 0 THEN strftime(start_date, '%Y-%m-%d') || ' 01:30' WHEN 1 THEN strftime(start_date, '%Y-%m-%d') || ' 00:05' WHEN 2 THEN strftime(start_date - 1, '%Y-%m-%d') || ' 15:00' END, '') AS published, '요약 ' || notice_id AS summary FROM notices
""", "notices")
def feed_items(spark, d):
    """Stored feeds of fifty notices each, with four kinds of dates."""
    n, day = F.col("notice_id"), F.col("start_date")
    date = (
        F.when(n % 4 == 0, F.date_format(day, "EEE, d MMM yyyy '10:30:00 +0900'")).when(n % 4 == 1, F.concat(F.date_format(day, "yyyy.MM.dd"), F.lit(" 9:05")))
        .when(n % 4 == 2, F.date_format(day, "yyyy/M/d")).otherwise("알 수 없음")
    )
    item = F.concat(
        F.lit("<item><title>"), F.col("title"), F.lit("</title><link>"), F.col("url"), F.lit("</link><pubDate>"), date,
        F.lit("</pubDate><description>&lt;p&gt;요약&lt;/p&gt; "), n.cast("string"), F.lit("</description></item>"),
    )
    items = inputs.notices(spark, d).select(F.floor(n / 50).alias("feed"), item.alias("item"))
    xml = F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list("item"), ""), F.lit("</channel></rss>"))
    feed = files.feed_items(items.groupBy("feed").agg(xml.alias("xml")), "xml")
    return feed.withColumn("published", F.coalesce(F.date_format("published", "yyyy-MM-dd HH:mm"), F.lit("")))


@F.pandas_udf(T.BinaryType())
def _office_bytes(texts: pd.Series, kinds: pd.Series) -> pd.Series:
    """Document texts as docx or hwpx bytes, for the document queries."""

    def pack(text: str | None, kind: str) -> bytes | None:
        if text is None:
            return None
        out = io.BytesIO()
        name, tag = ("word/document.xml", "w:p") if kind == "docx" else ("Contents/section0.xml", "hp:p")
        with zipfile.ZipFile(out, "w") as archive:
            body = "".join(f"<{tag}><t>{line}</t></{tag}>" for line in text.replace("<", " ").replace("&", " ").split("\n"))
            archive.writestr(zipfile.ZipInfo(name), body)  # without the time of day
        return out.getvalue()

    return pd.Series([pack(t, k) for t, k in zip(texts, kinds, strict=True)])


# a filter on what follows from the bytes must not pack them a second time
_office_bytes = _office_bytes.asNondeterministic()


def documents_as_files(spark, d):
    """The document table as files of eight kinds, good and bad."""
    k = F.col("doc_id") % 8
    name = inputs.pick(("a.pdf", "b.hwp", "c.docx", "d.hwpx", "e.txt", "f.md", "g.txt", "h.docx"), k)
    text = F.col("text")
    packed = _office_bytes(F.when(k.isin(2, 3), text), F.when(k == 2, "docx").otherwise("hwpx"))  # the other texts do not go to Python
    content = (
        F.when(k == 0, F.concat(F.unhex(F.lit("255044462D")), F.encode(text, "UTF-8"))).when(k == 1, F.concat(F.unhex(F.lit(files.OLE_MAGIC)), F.encode(text, "UTF-8")))
        .when(k.isin(2, 3), packed).when(k == 6, F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit("00"))))
        .otherwise(F.encode(text, "UTF-8"))
    )
    return inputs.wide(spark, d, "documents").select("doc_id", name.alias("name"), content.alias("content"))


@query("binary_files", """
SELECT doc_id, ['pdf', 'hwp', 'docx', 'hwpx', 'txt', 'md', '', ''][doc_id % 8 + 1] AS format, CASE WHEN doc_id % 8 IN (4, 5) THEN sha256(text) WHEN doc_id % 8 = 0 THEN sha256(unhex('255044462D') || encode(text)) WHEN doc_id % 8 = 1 THEN sha256(unhex('"""+files.OLE_MAGIC+"""') || encode(text)) ELSE '' END AS hash FROM documents
""")
def binary_files(spark, d):
    rows = documents_as_files(spark, d).withColumn("format", F.coalesce(files.classify(F.col("name"), F.col("content")), F.lit("")))
    packed = F.col("format").isin("docx", "hwpx")  # SQL cannot pack them; office_files has their hashes
    return rows.select("doc_id", "format", F.when(packed | (F.col("format") == ""), "").otherwise(F.sha2("content", 256)).alias("hash"))


@query("office_files")
def office_files(spark, d):
    """Packed documents with the hash of their bytes."""
    rows = documents_as_files(spark, d).withColumn("format", files.classify(F.col("name"), F.col("content")))
    return rows.where(F.col("format").isin("docx", "hwpx")).select("doc_id", "format", F.sha2("content", 256).alias("hash"))


@query("office_text", """
SELECT doc_id, CASE WHEN doc_id % 8 IN (2, 3, 4, 5) AND length(text) >= 50 THEN 'ok' ELSE 'rejected' END AS status FROM documents
""")
def office_text(spark, d):
    return files.office_text(documents_as_files(spark, d)).select("doc_id", "status")


@query("office_text_body")
def office_text_body(spark, d):
    return files.office_text(documents_as_files(spark, d)).where("status = 'ok'").select("doc_id", "format", "text")


@query("page_config", """
SELECT page_id, regexp_extract(url, '^https?://(?:[^/?#]*\\.)?(example\\.[a-z]+)', 1) AS domain FROM pages WHERE regexp_extract(url, '^https?://(?:[^/?#]*\\.)?(example\\.[a-z]+)', 1) IN ('example.com', 'example.org')
""")
def page_config(spark, d):
    """Pages on the configured hosts."""
    config = spark.createDataFrame([("example.com",), ("example.org",)], "domain string")
    domain = F.regexp_extract("url", r"^https?://(?:[^/?#]*\.)?(example\.[a-z]+)", 1)
    return inputs.table(spark, d, "pages").select("page_id", domain.alias("domain")).join(config, "domain", "left_semi")


@F.pandas_udf(T.BinaryType())
def _encoded(texts: pd.Series, encodings: pd.Series) -> pd.Series:
    return pd.Series([t.encode(e) for t, e in zip(texts, encodings, strict=True)])


@query("decode_bytes", """
SELECT doc_id, '문서 ' || doc_id || ' 안내' AS text FROM documents
""")
def decode_bytes(spark, d):
    k = F.col("doc_id") % 4
    encoding = inputs.pick(("utf-8", "cp949", "euc-kr", "utf-16"), k)
    declared = F.when(k == 3, "utf-16").when(k == 1, "ascii").when(k == 2, "no-such-encoding")
    text = F.concat(F.lit("문서 "), F.col("doc_id").cast("string"), F.lit(" 안내"))
    rows = inputs.wide(spark, d, "documents").select("doc_id", _encoded(text, encoding).alias("content"), declared.alias("declared"))
    return rows.select("doc_id", files.decode_bytes(F.col("content"), F.col("declared")).alias("text"))


def _reciprocal(value):
    return str(100 // int(value))


@query("apply_column_fn", """
SELECT event_id, CASE WHEN k = 0 THEN '' ELSE cast(100 // k AS VARCHAR) END AS result, k = 0 AS failed FROM (SELECT event_id, cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
""")
def apply_column_fn(spark, d):
    rows = inputs.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    out = files.apply_column_fn(rows, "k", _reciprocal)
    return out.select("event_id", F.coalesce("result", F.lit("")).alias("result"), F.col("error").isNotNull().alias("failed"))

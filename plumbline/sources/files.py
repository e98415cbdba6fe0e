"""Line, array and table files in the shared folder, and documents as bytes."""

from __future__ import annotations

import io
import re
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import shared_dir

# fixed values: document formats and limits
MAX_BYTES, MIN_TEXT = 20 * 1024 * 1024, 50
OLE_MAGIC, PDF_MAGIC = "D0CF11E0A1B11AE1", "255044462D"
CANDIDATE_ENCODINGS = ("utf-8", "cp949", "euc-kr")


def _target(df: DataFrame, kind: str) -> str:
    return f"{shared_dir(df.sparkSession)}/plumbline/{kind}-{uuid.uuid4().hex}"


def write_jsonl(df: DataFrame) -> str:
    """One JSON document per line; nulls are left out."""
    path = _target(df, "jsonl")
    df.write.option("ignoreNullFields", "true").json(path)
    return path


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_text(df: DataFrame) -> str:
    path = _target(df, "text")
    df.write.text(path)
    return path


def read_json_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON arrays, one array per line; a line whose root is no array fails the read."""
    lines = spark.read.text(path)
    checked = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.raise_error(F.lit("root is not an array")))
    rows = F.from_json(checked, f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>", {"mode": "FAILFAST"})
    return lines.select(F.explode(rows).alias("r")).select("r.*")


def write_csv(df: DataFrame) -> str:
    path = _target(df, "csv")
    df.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return path


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header and values stripped, a byte-order mark included."""
    raw = spark.read.option("header", "true").csv(path)
    return raw.select(*[F.trim(F.col(f"`{c}`")).alias(c.lstrip("﻿").strip()) for c in raw.columns])


def write_parquet(df: DataFrame) -> str:
    path = _target(df, "parquet")
    df.write.parquet(path)
    return path


@F.pandas_udf(T.ArrayType(T.StringType()))
def zip_names(contents: pd.Series) -> pd.Series:
    """Member names of a zip, NULL when the bytes are none."""

    def names(data: bytes | None) -> list[str] | None:
        try:
            with zipfile.ZipFile(io.BytesIO(data or b"")) as archive:
                return archive.namelist()
        except (OSError, zipfile.BadZipFile):
            return None

    return contents.map(names)


def classify(name: Column, content: Column) -> Column:
    """Format of a document by its extension and first bytes, NULL when refused."""
    extension = F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring(content, 1, 8))
    # only bytes that may be a packed document go to Python
    members = F.coalesce(zip_names(F.when(extension.isin(".docx", ".hwpx") & (F.octet_length(content) <= MAX_BYTES), content)), F.array().cast("array<string>"))
    word = F.array_contains(members, "word/document.xml")
    hancom = F.array_contains(members, "Contents/content.hpf") | F.exists(members, lambda m: m.startswith("Contents/section"))
    # a text file is valid utf-8 without a NUL
    plain = F.is_valid_utf8(content) & ~F.contains(content, F.unhex(F.lit("00")))
    size = F.octet_length(content)
    return F.when((size > 0) & (size <= MAX_BYTES), (
        F.when((extension == ".pdf") & head.startswith(PDF_MAGIC), "pdf")
        .when((extension == ".hwp") & (head == OLE_MAGIC), "hwp")
        .when((extension == ".docx") & word, "docx")
        .when((extension == ".hwpx") & hancom, "hwpx")
        .when(extension.isin(".txt", ".md") & plain, F.substring(extension, 2, 3))
    ))


@F.pandas_udf(T.StringType())
def office_xml(contents: pd.Series, formats: pd.Series) -> pd.Series:
    """Marked-up paragraphs of a docx or hwpx as lines, still with tags."""

    def xml(data: bytes, fmt: str) -> str | None:
        if fmt not in ("docx", "hwpx") or data is None:
            return None
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            names = ["word/document.xml"] if fmt == "docx" else sorted(n for n in archive.namelist() if n.startswith("Contents/section"))
            tag = "w:p" if fmt == "docx" else "hp:p"
            return "\n\n".join(re.sub(f"</{tag}>", "\n", archive.read(n).decode("utf-8")) for n in names)

    return pd.Series([xml(d, f) for d, f in zip(contents, formats, strict=True)])


# a filter on the format or the status must not open the archives a second time, in Python workers of their own
zip_names, office_xml = zip_names.asNondeterministic(), office_xml.asNondeterministic()


def office_text(files: DataFrame) -> DataFrame:
    """Text of (name, content) documents with `status` ok or rejected; under 50 characters is rejected."""
    rows = files.withColumn("format", classify(F.col("name"), F.col("content")))
    plain = F.when(F.col("format").isin("txt", "md"), F.decode(F.col("content"), "UTF-8"))
    bare = F.regexp_replace(office_xml(F.when(F.col("format").isin("docx", "hwpx"), F.col("content")), "format"), r"<[^>]*>", "")
    lines = F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    text = F.coalesce(F.array_join(lines, "\n"), plain)
    text = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"[ \t]+(?=\n|$)", ""), r"\n{3,}", "\n\n")
    rows = rows.withColumn("text", F.trim(text))
    ok = F.coalesce(F.length("text") >= MIN_TEXT, F.lit(False))
    return rows.withColumn("status", F.when(ok, "ok").otherwise("rejected"))


@F.pandas_udf(T.StringType())
def _decode_other(contents: pd.Series, declared: pd.Series) -> pd.Series:
    """First of the declared and the usual encodings that decodes cleanly."""

    def decode(data: bytes, name: str | None) -> str | None:
        for encoding in filter(None, (name, *CANDIDATE_ENCODINGS)):
            try:
                return data.decode(encoding)
            except (LookupError, UnicodeDecodeError):
                continue
        return None

    return pd.Series([None if d is None else decode(d, n) for d, n in zip(contents, declared, strict=True)], dtype=object)


def decode_bytes(content: Column, declared: Column) -> Column:
    """Page bytes as text: the declared encoding, then utf-8, cp949 and euc-kr.

    Valid utf-8 without another declared encoding stays in the expression; only the rest goes to Python.
    """
    simple = F.is_valid_utf8(content) & (declared.isNull() | F.lower(declared).isin("utf-8", "utf8"))
    return F.when(simple, F.decode(content, "UTF-8")).otherwise(_decode_other(F.when(~simple, content), declared))


def read_binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Files as (name, content); ones over the limit are skipped before their bytes are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= MAX_BYTES).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")


def feed_items(feeds: DataFrame, xml: str) -> DataFrame:
    """Items (title, link, published, summary) of stored feed documents; a date has one of three forms or none."""
    schema = "title string, link string, pubDate string, description string"
    each = F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)(<item[ >].*?</item>)"), F.lit(1)))
    items = feeds.select(each.alias("item")).select(F.from_xml("item", schema).alias("i")).select("i.*")
    raw = F.trim("pubDate")
    loose = F.regexp_replace(F.regexp_extract(raw, r"(20\d{2}[.\-/]\d{1,2}[.\-/]\d{1,2}(?:\s+\d{1,2}:\d{2})?)", 1), r"[.\-/]", "-")
    kst = lambda t: F.to_utc_timestamp(t, "Asia/Seoul")
    published = F.coalesce(
        F.try_to_timestamp(F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")),
        kst(F.try_to_timestamp(loose, F.lit("yyyy-M-d H:mm"))),
        kst(F.try_to_timestamp(loose, F.lit("yyyy-M-d"))),
    )
    text = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("description", F.lit("")), r"<[^>]*>", " "), r"\s+", " "))
    return items.select(F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("공지")).alias("title"), "link", published.alias("published"), text.alias("summary"))


def apply_column_fn(df: DataFrame, column: str, function, out: str = "result") -> DataFrame:
    """A Python function over a column, a failing row giving NULL and its error instead of a failed job."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField("error", T.StringType())])

    def run(batches):
        for batch in batches:
            results, errors = [], []
            for value in batch[column]:
                try:
                    results.append(function(value))
                    errors.append(None)
                except Exception as exc:  # noqa: BLE001 - one row must not fail the rest
                    results.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}")
            yield batch.assign(**{out: pd.Series(results, index=batch.index, dtype=object), "error": pd.Series(errors, index=batch.index, dtype=object)})

    return df.mapInPandas(run, schema)

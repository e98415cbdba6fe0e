"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 16 bytes cuts every text into chunks of about 40 bytes; cuts depend on the
bytes around them, so an insertion moves only the chunks it touches.  Chunks meet by digest.  The first
occurrence of a chunk (in the document of the smallest key, the first there) stays; a run of later occurrences that is long enough to
be a passage, and no chance, is cut out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import salted_join, schema_with, slices

#: Bytes of a chunk: least, most; a cut falls on one byte in so many.
LEAST, MOST, RATE = 16, 160, 24
#: Bytes that a run of repeated chunks must have to be cut out.
MIN_RUN = 112
#: Stands for a null key: after all others.
NO_KEY = 2**63 - 1
_GEAR = np.random.default_rng(77).integers(0, 1 << 16, 256, dtype=np.uint16)


def cuts(raw: bytes) -> list[int]:
    """End positions of the chunks of a text; never inside a UTF-8 character."""
    n = len(raw)
    if not n:
        return []
    codes = np.frombuffer(raw, np.uint8)
    rolled = _GEAR[codes]
    for k in (1, 2, 4, 8):  # the hash of 2, 4, 8, 16 bytes; older bytes have left the 16 bits
        if n > k:
            shifted = rolled.copy()
            shifted[k:] += rolled[:-k] << np.uint16(k)
            rolled = shifted
    starts = (codes & 0xC0) != 0x80
    free = np.flatnonzero((rolled[:-1] < (1 << 16) // RATE) & starts[1:]) + 1
    out, last = [], 0

    def forced(to: int) -> None:
        nonlocal last
        while to - last > MOST:
            at = last + MOST
            while not starts[at]:
                at -= 1
            out.append(at)
            last = at

    for at in free.tolist():
        if at - last >= LEAST:
            forced(at)
            if at - last >= LEAST:
                out.append(at)
                last = at
    forced(n)
    out.append(n)
    return out


def _digest(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=8).digest()


def _identity(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row_key, tie, text): rows of the same key and text are one document."""
    return docs.select(F.col(key).alias("row_key"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """(row_key, tie, spans array<struct<start, end>>, n_repeated): byte spans to cut, for documents that have any."""
    rows = _identity(docs, key, text).where("text is not null")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for part in slices(batches, "text"):
            at, start, width, digest, again = [], [], [], [], []
            for i, value in enumerate(part.column(2).to_pylist()):
                raw = value.encode()
                ends = cuts(raw)
                begins = [0, *ends][:-1]
                own = [_digest(raw[b:e]) for b, e in zip(begins, ends, strict=True)]
                seen: set[bytes] = set()
                for d in own:
                    again.append(d in seen)
                    seen.add(d)
                at += [i] * len(ends)
                start += begins
                width += [e - b for b, e in zip(begins, ends, strict=True)]
                digest += own
            take = pa.array(at, pa.int32())
            columns = [part.column(0).take(take), part.column(1).take(take), pa.array(start, pa.int32()), pa.array(width, pa.int32())]
            columns += [pa.array(np.frombuffer(b"".join(digest), np.int64)), pa.array(again, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["row_key", "tie", "start", "width", "digest", "again"])

    chunks = rows.mapInArrow(run, f"row_key {kind}, tie long, start int, width int, digest long, again boolean")
    last = F.coalesce("row_key", F.lit(NO_KEY))
    first = chunks.where("not again").groupBy("digest").agg(F.min(last).alias("first"), F.max(last).alias("final")).where("first < final").select("digest", "first")
    later = salted_join(chunks, first, ["digest"], "tie", "left", 4).where(F.col("again") | (last > F.col("first"))).select("row_key", "tie", "start", "width")
    per_doc = later.groupBy("row_key", "tie").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("width")).alias("end")))).alias("found"))
    kept = per_doc.mapInArrow(_runs(min_run), f"row_key {kind}, tie long, spans array<struct<start:int,end:int>>, n_repeated long")
    return kept.where(F.size("spans") > 0)


def _runs(min_run: int):
    """Join neighbouring chunks of a document to runs and drop the short ones."""

    def run(batches):
        for part in batches:
            spans, count = [], []
            for found in part.column(2).to_pylist():
                joined: list[list[int]] = []
                for s in found:
                    if joined and joined[-1][1] == s["start"]:
                        joined[-1][1] = s["end"]
                    else:
                        joined.append([s["start"], s["end"]])
                spans.append([{"start": a, "end": b} for a, b in joined if b - a >= min_run])
                count.append(len(found))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(spans, kind), pa.array(count, pa.int64())], ["row_key", "tie", "spans", "n_repeated"])

    return run


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """Every row of `docs`, its text without repeated passages, with n_bytes, n_removed and n_spans (bytes of UTF-8).

    A null text stays null with 0 bytes; an empty text stays empty.  Rows of the same key are one document, and
    so are all rows without a key, which come last: what two of them share stays in both.  All columns of `docs` are kept;
    columns named n_bytes, n_removed or n_spans are replaced.
    """
    spans = repeated_spans(docs, key, text, min_run).select(F.col("row_key").alias("_key"), F.col("tie").alias("_tie"), F.col("spans").alias("_spans"))
    base = docs.drop("n_bytes", "n_removed", "n_spans").withColumn("_own", F.xxhash64(text))
    joined = base.join(spans, base[key].eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_tie")), "left").drop("_key", "_tie", "_own")

    def run(batches):
        for part in slices(batches, text):
            names = part.schema.names
            at, sp = names.index(text), names.index("_spans")
            texts, size, gone, many = [], [], [], []
            for value, cut in zip(part.column(at).to_pylist(), part.column(sp).to_pylist(), strict=True):
                raw = (value or "").encode()
                kept, last = [], 0
                for s in cut or ():
                    kept.append(raw[last : s["start"]])
                    last = s["end"]
                left = b"".join([*kept, raw[last:]])
                texts.append(None if value is None else left.decode())
                size.append(len(raw))
                gone.append(len(raw) - len(left))
                many.append(len(cut or ()))
            columns = [pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(len(names)) if i != sp]
            yield pa.RecordBatch.from_arrays(
                [*columns, *[pa.array(x, pa.int64()) for x in (size, gone, many)]], [*[n for n in names if n != "_spans"], "n_bytes", "n_removed", "n_spans"]
            )

    return joined.mapInArrow(run, schema_with(joined, ("_spans",), "n_bytes long, n_removed long, n_spans long"))

"""Batch retrieval, evidence merging, deny list, lookup plans and conflicts between sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import rules
from plumbline.functions.dates import semester_of
from plumbline.functions.labels import notice_board, notice_keyword
from plumbline.functions.text import norm_compact
from plumbline.operators import search_index
from plumbline.operators.ranking import round_robin
from plumbline.session import stored

#: Ids of a deny list that are sent to the sections; with more, sections meet their denied ones by a shuffle.
FEW = 1 << 17


def denied(sections: DataFrame, denylist: DataFrame) -> DataFrame:
    """Sections whose id, evidence id or parent document is not on the deny list.

    Older rows without a parent carry it in the evidence id `doc:{parent}:{n}`.  The deny list is
    required: a missing table fails here rather than letting withdrawn text through.

    A long list meets the names alone, so that the sections themselves are shuffled once and not for each of their names.
    """
    ids = stored(denylist.select(F.col("id").alias("_denied")).distinct())
    derived = F.nullif(F.regexp_extract("evidence_id", r"^doc:(.+):\d+$", 1), F.lit(""))
    rows = sections.withColumn("_parent", F.coalesce(F.nullif("parent_id", F.lit("")), derived))
    names = ("section_id", "evidence_id", "_parent")
    if ids.limit(FEW + 1).count() <= FEW:
        for name in names:
            rows = rows.join(F.broadcast(ids), F.col(name) == F.col("_denied"), "left_anti")
        return rows.drop("_parent")
    named = rows.select(*names, F.explode(F.array_distinct(F.array_compact(F.array(*names)))).alias("_denied"))
    found = named.join(ids.hint("merge"), "_denied", "left_semi").select(*[F.col(n).alias(f"_denied_{n}") for n in names]).distinct()
    same = [F.col(n).eqNullSafe(F.col(f"_denied_{n}")) for n in names]
    return rows.join(found, same, "left_anti").drop("_parent")


def search(queries: DataFrame, index: search_index.Index, k: int = 5, longest: int | None = None) -> DataFrame:
    """First k sections per (query, kind); pairs without a hit take those of the original wording.

    `queries` holds query_id, query, original and kind, one row per wanted kind.  Both wordings are
    looked up in one pass over the index.  `longest` cuts wordings to that many characters, as an online
    call would; a batch takes them whole.
    """
    cut = lambda wording: (F.col(wording) if longest is None else F.left(wording, F.lit(longest))).alias("query")
    original = queries.where(F.col("original").isNotNull() & (F.col("original") != F.col("query")))
    texts = queries.select("query_id", F.lit(False).alias("fallback"), cut("query")).unionByName(
        original.select("query_id", F.lit(True).alias("fallback"), cut("original"))
    )
    wanted = queries.select("query_id", F.col("kind").alias("source_kind"))
    best = search_index.top_k(texts.distinct(), index, k).join(wanted, ["query_id", "source_kind"], "left_semi")
    used = F.min("fallback").over(Window.partitionBy("query_id", "source_kind"))
    return best.withColumn("_used", used).where(F.col("fallback") == F.col("_used")).drop("_used")


def merged(hits: DataFrame, k: int = 5) -> DataFrame:
    """Hits of all kinds interleaved by place, k per query."""
    order = F.when(F.col("source_kind") == "rule", 0).when(F.col("source_kind") == "guide", 1).otherwise(2)
    return round_robin(hits.withColumn("kind", order).withColumnRenamed("place", "r"), "query_id", "kind", "r", "section_id", max(1, min(k, 8)))


# ── containment of passages in a corpus ─────────────────────────────────────────────────────────────
SAMPLES = ((12, 13), (6, 7))
"""(gram, span) pairs: grams of that many characters, of which the smallest of every span is kept."""
#: Grams that leave a task at once, whatever the number and length of its texts.
FRAME = 1 << 18
_BASE, _MIX = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)


def _grams(text: str, size: int) -> np.ndarray:
    """Mixed 64-bit hashes of all grams of a text."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < size:
        return np.empty(0, dtype=np.uint64)
    value = np.zeros(len(codes) - size + 1, dtype=np.uint64)
    for i in range(size):
        value = value * _BASE + codes[i : len(codes) - size + 1 + i]
    value ^= value >> np.uint64(31)
    return value * _MIX


def _sampled(text: str, gram: int, span: int) -> np.ndarray:
    """The smallest gram hash of every run of `span` grams: about two grams in span + 1.

    Any stretch of gram + span - 1 characters has a run of its own, so a text that contains a passage
    of that length also lists the passage's smallest gram.
    """
    grams = _grams(text, gram)
    if len(grams) < span:
        return np.empty(0, dtype=np.uint64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(grams, span).min(axis=1))


def _framed(batches: Iterator[pa.RecordBatch], key: str, hashes) -> Iterator[pa.RecordBatch]:
    """(key, gram) of every text of (key, norm) batches; a frame ends with the text that brings it to FRAME grams."""
    for batch in batches:
        found, start, held = [], 0, 0
        for i, text in enumerate(batch.column(1)):
            found.append(hashes(text.as_py()))
            held += len(found[-1])
            if held >= FRAME or i == batch.num_rows - 1:
                at = np.repeat(np.arange(start, i + 1), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.concatenate(found).view(np.int64))], [key, "gram"])
                found, start, held = [], i + 1, 0


def _hash_rows(df: DataFrame, key: str, hashes) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias(key), "norm").where("norm is not null")
    return rows.mapInArrow(lambda batches: _framed(batches, key, hashes), f"{key} long, gram long")


def corpus_match(passages: DataFrame, corpus: DataFrame) -> DataFrame:
    """(item_id, doc_id) of every passage that occurs, after normalisation, in a document's text.

    Candidates come from an equi join on sampled grams and are then checked exactly.  Passages too
    short to be sampled are looked up by their first six characters (all of them when fewer) among all
    windows of that size.
    """
    asked = passages.select("item_id", norm_compact(F.col("text")).alias("norm")).where("norm <> ''")
    docs = corpus.select("doc_id", norm_compact(F.col("text")).alias("norm"))
    pairs, longest = None, None
    for gram, span in SAMPLES:
        shortest = gram + span - 1
        tier = asked.where(F.length("norm").between(shortest, longest if longest else 1 << 30))
        longest = shortest - 1
        sample = lambda text, g=gram, s=span: _sampled(text, g, s)
        smallest = lambda text, g=gram: _grams(text, g).min(keepdims=True)
        found = _hash_rows(docs, "doc_id", sample).join(_hash_rows(tier, "item_id", smallest), "gram").select("doc_id", "item_id")
        pairs = found if pairs is None else pairs.unionByName(found)
    short = asked.where(F.length("norm") <= longest).withColumn("size", F.least(F.length("norm"), F.lit(rules.MIN_QUOTE_CHARS)))
    for size in sorted(r["size"] for r in short.select("size").distinct().collect()):
        every = lambda text, n=size: np.unique(_grams(text, n))
        head = lambda text, n=size: _grams(text[:n], n)
        pairs = pairs.unionByName(
            _hash_rows(docs, "doc_id", every).join(_hash_rows(short.where(F.col("size") == size), "item_id", head), "gram").select("doc_id", "item_id")
        )
    checked = pairs.distinct().join(asked.withColumnRenamed("norm", "_passage"), "item_id").join(docs, "doc_id")
    return checked.where(F.contains("norm", F.col("_passage"))).select("item_id", "doc_id")


# ── plans and conflicts ────────────────────────────────────────────────────────────────────────────
def plan_lookups(turns: DataFrame) -> DataFrame:
    """Required lookups of every turn (turn_id, needs, query, original, topic, intent, today), numbered.

    Arguments come as a JSON text.
    """
    c = F.col
    has = lambda need: F.array_contains("needs", need)
    kinds = F.flatten(F.transform("needs", lambda n: F.coalesce(
        *[F.when(n == need, F.array(*[F.lit(k) for k in ks])) for need, ks in rules.NEED_KINDS.items()], F.array().cast("array<string>")
    )))
    kinds = F.array_distinct(kinds)
    kinds = F.when(
        has("procedure_and_contact"), F.concat(F.filter(kinds, lambda k: k == "guide"), F.filter(kinds, lambda k: k != "guide"))
    ).otherwise(kinds)
    rows = turns.withColumn("_kinds", kinds)
    other = F.when(c("original") != c("query"), c("original"))
    asked = F.coalesce(F.nullif("original", F.lit("")), c("query"))
    board = notice_board(c("topic"), c("query"))
    call = lambda name, args: F.struct(F.lit(name).alias("name"), F.to_json(args).alias("args"))
    notice = call("get_notices", F.struct(board.alias("board"), notice_keyword(c("topic")).alias("keyword")))
    where = call("find_campus_location", F.struct(c("query").alias("query")))
    calls = F.array(
        F.when(F.size("_kinds") > 0, call("search_academic_knowledge", F.struct("query", c("_kinds").alias("kinds"), other.alias("original_query")))),
        F.when(has("current_deadline"), F.struct(F.lit("get_academic_calendar").alias("name"), F.lit("{}").alias("args"))),
        F.when(has("current_deadline") | (c("intent") == "notice"), notice),
        F.when(has("menu"), call("get_menu", F.struct(c("today").alias("day")))),
        F.when(has("location") | (has("procedure_and_contact") & asked.rlike(rules.CONTACT_QUESTION)), where),
        F.when(has("location"), call("find_campus_tips", F.struct(asked.alias("query")))),
    )
    rows = rows.select("turn_id", F.posexplode(F.filter(calls, lambda x: x.isNotNull())).alias("pos", "call"))
    return rows.select("turn_id", F.concat(F.lit("plan_"), c("pos").cast("string")).alias("plan_id"), "call.name", "call.args")


def adopt(evidence: DataFrame, needs: DataFrame) -> DataFrame:
    """Evidence of a turn adopted (primary kinds) or supporting (secondary kinds) for each of its needs."""
    table = [(need, kind, role) for need, sides in rules.NEED_PRIORITY.items() for role, kinds in zip(("adopted", "supporting"), sides, strict=True) for kind in kinds]
    rule = evidence.sparkSession.createDataFrame(table, "need string, kind string, role string")
    return evidence.join(needs, "turn_id").join(rule, ["need", "kind"]).select("turn_id", "need", "role", "evidence_id", "pos")


def deadline_conflicts(notices: DataFrame, calendars: DataFrame) -> DataFrame:
    """Notices of a turn whose known period differs from the calendar's for the same term and topic.

    A change word in a notice published later overrides the calendar; anything else is a mismatch.
    """
    c = F.col
    other = calendars.select(
        "turn_id", "semester", "topic", c("id").alias("calendar_id"), c("start").alias("c_start"), c("end").alias("c_end"), c("published_at").alias("c_published")
    )
    pairs = notices.join(other, ["turn_id", "semester", "topic"]).where(c("start").isNotNull() | c("end").isNotNull())
    pairs = pairs.where(~(c("start").eqNullSafe(c("c_start")) & c("end").eqNullSafe(c("c_end"))))
    marked = F.concat_ws(" ", "title", F.left("text", F.lit(200))).rlike(rules.CHANGE_MARK)
    later = c("published_at").isNotNull() & (c("c_published").isNull() | (c("published_at") > c("c_published")))
    overrides = marked & F.coalesce(later, F.lit(False))
    return pairs.select(
        "turn_id", c("id").alias("notice_id"), "calendar_id",
        F.when(overrides, "notice_overrides_calendar").otherwise("date_mismatch").alias("type"),
        F.when(overrides, "medium").otherwise("high").alias("severity"),
        F.when(overrides, F.format_string(rules.OVERRIDE_TEMPLATE, "title")).otherwise(F.format_string(rules.MISMATCH_TEMPLATE, "title", "topic")).alias("sentence"),
    )


def adopted_order(adopted: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Adopted deadline evidence in order: overriding notices first, then the rest as found."""
    over = conflicts.where("type = 'notice_overrides_calendar'").select("turn_id", F.col("notice_id").alias("evidence_id"), F.lit(0).alias("_first")).distinct()
    rows = adopted.where("role = 'adopted'").join(over, ["turn_id", "evidence_id"], "left")
    front = F.struct(F.coalesce("_first", F.lit(1)).alias("f"), "pos", "evidence_id")
    return rows.groupBy("turn_id", "need").agg(
        F.array_join(F.transform(F.sort_array(F.collect_set(front)), lambda x: x["evidence_id"]), ",").alias("evidence_ids")
    )


def semester(day: Column) -> Column:
    return semester_of(day)

"""Citation checks of drafted sentences and checks of reports and re-runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.functions.text import (
    date_variants, letters_digits, narrow_flip, no_spaces, norm_compact, norm_compact_all, polarity, report_values, risky_mismatch, table_variants,
    unit_numbers, units_of,
)

# fixed values: order of the reports' fixes, sizes of the drift check
DRIFT_CHUNK, DRIFT_MIN, DRIFT_CHUNKS = 30, 10, 6
PLACE_QUESTION = r"어디|위치|찾아가|가는\s*길|몇\s*층"
URL = r"https?://[^\s<>\"'）)\]]+"


def cited_texts(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Drafts with `texts`, the texts of their cites in order, and `unknown`, the ids not in the turn's evidence.

    The draft's columns travel with its cites, so the table is shuffled once to meet the evidence and
    once to come together again.
    """
    cites = drafts.select("*", F.posexplode_outer("cite_ids").alias("_pos", "evidence_id"))
    known = evidence.select("turn_id", "evidence_id", F.col("text").alias("_cited"))
    found = cites.join(known, ["turn_id", "evidence_id"], "left")
    listed = F.sort_array(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("_cited", F.lit("")).alias("t")))))
    missing = F.count(F.when(F.col("_pos").isNotNull() & F.col("_cited").isNull(), 1))
    return found.groupBy("sid").agg(
        *[F.first(c).alias(c) for c in drafts.columns if c != "sid"], F.transform(listed, lambda x: x["t"]).alias("texts"), missing.alias("unknown")
    )


def with_quote_check(rows: DataFrame) -> DataFrame:
    """Add `quote_reason`, why the first failing quote fails: too short, or not in its cited text.

    Quotes and cites pair up by position; when their counts differ, every quote has to be in the
    union of the cited texts.  `_texts` holds the normalised cited texts.
    """
    rows = rows.withColumn("_texts", norm_compact_all(F.col("texts"))).withColumn("_quotes", norm_compact_all(F.col("quotes")))
    paired = F.size("quotes") == F.size("texts")
    rows = rows.withColumn("_union", F.when(~paired, F.array_join("_texts", "")))

    def check(quote: Column, i: Column) -> Column:
        where = F.coalesce("_union", F.try_element_at("_texts", i + 1))
        return F.when(F.length(quote) < rules.MIN_QUOTE_CHARS, "quote_too_short").when(~F.contains(where, quote), "quote_not_found")

    failing = F.filter(F.transform("_quotes", check), lambda r: r.isNotNull())
    return rows.withColumn("quote_reason", F.try_element_at(failing, F.lit(1))).drop("_quotes", "_union")


def with_number_check(rows: DataFrame, grade: Column | None = None) -> DataFrame:
    """Add `wrong_number`: a number with its unit stands in the sentence but in none of its cited texts.

    Most numbers are found as they are written.  Only for the rest are the texts expanded by the other
    spellings of their dates and table values; an expansion adds text, so it never loses a match.
    `grade` is a stated school year, allowed as a number.
    """
    rows = rows.withColumn("_numbers", F.transform(unit_numbers(F.col("text")), letters_digits))
    plain = F.forall("_numbers", lambda n: F.exists("_texts", lambda t: F.contains(t, n)))
    if grade is not None:
        rows = rows.withColumn("_numbers", F.filter("_numbers", lambda n: n != F.concat(grade, F.lit("학년"))))
    rows = rows.withColumn("_open", F.when(~plain, F.array_join("texts", "\n")))
    rows = rows.withColumn("_open", date_variants(F.col("_open"))).withColumn("_open", table_variants(F.col("_open")))
    rows = rows.withColumn("_open", norm_compact(F.col("_open")))
    missing = F.exists("_numbers", lambda n: ~F.contains(F.col("_open"), n))
    return rows.withColumn("wrong_number", F.coalesce(missing, F.lit(False))).drop("_numbers", "_open")


def with_polarity(rows: DataFrame, when: Column) -> DataFrame:
    """Add `polarity`, polarity_flip or risky_token, for the rows that `when` selects."""
    rows = rows.withColumn("_joined", F.when(when, F.array_join("quotes", " ")))
    flip, risky = narrow_flip(F.col("text"), F.col("_joined")), risky_mismatch(F.col("text"), F.col("_joined"))
    flag = F.when(F.col("_joined").isNotNull(), F.when(flip, "polarity_flip").when(risky, "risky_token"))
    return rows.withColumn("polarity", F.coalesce(flag, F.lit(""))).drop("_joined")


def verify_sentences(drafts: DataFrame, evidence: DataFrame, grade: Column | None = None) -> DataFrame:
    """First failing reason of every sentence ('' when kept) and the polarity flag of the others."""
    rows = with_number_check(with_quote_check(cited_texts(drafts, evidence)), grade)
    failed = F.coalesce(
        F.when(F.size("cite_ids") == 0, "no_cite"),
        F.when(F.size("quotes") == 0, "len_mismatch"),
        F.when(F.col("unknown") > 0, "unknown_id"),
        F.col("quote_reason"),
        F.when(F.col("wrong_number"), "number_mismatch"),
    )
    rows = rows.withColumn("_failed", failed)
    rows = with_polarity(rows, F.col("_failed").isNull() & (F.col("section") == "sentences"))
    reason = F.coalesce("_failed", F.when(F.col("polarity") == "polarity_flip", "suppressed"), F.lit(""))
    verdict = F.struct(reason.alias("reason"), F.col("polarity").alias("flag"))
    # A filter on the verdict must not be pushed below: it would carry all checks into its condition.
    return rows.select("sid", "turn_id", "section", "cite_ids", F.explode(F.array(verdict)).alias("v")).select(
        "sid", "turn_id", "section", "cite_ids", "v.reason", "v.flag"
    )


def verify_report(verified: DataFrame) -> DataFrame:
    """Drafted and kept sentences per turn; only the section `sentences` counts."""
    main = F.col("section") == "sentences"
    return verified.groupBy("turn_id").agg(
        F.count(F.when(main, 1)).alias("total"), F.count(F.when(main & (F.col("reason") == ""), 1)).alias("kept"),
        F.count(F.when(F.col("reason") != "", 1)).alias("dropped"),
    )


def adopted_not_cited(adopted: DataFrame, verified: DataFrame) -> DataFrame:
    """Needs with adopted evidence of which nothing is cited; `adopted` holds turn_id, need, evidence_id."""
    cited = verified.where("reason = ''").select("turn_id", F.explode("cite_ids").alias("evidence_id")).distinct()
    used = adopted.join(cited, ["turn_id", "evidence_id"], "left_semi").select("turn_id", "need").distinct()
    return adopted.select("turn_id", "need").distinct().join(used, ["turn_id", "need"], "left_anti")


def deterministic_mismatch(rows: DataFrame) -> DataFrame:
    """Reports (kind, claim, value, answer, evidence) that are wrong beyond doubt get `confirmed`.

    Claim and value have to be verbatim.  With shared units, no shared value may agree and none of
    the claim's may occur in the evidence; without any values, polarity has to be reversed.
    """
    c = F.col
    rows = rows.withColumns({"_claim": F.trim("claim"), "_value": F.trim("value")})
    rows = rows.withColumns({"_cv": report_values(c("_claim")), "_vv": report_values(c("_value")), "_ev": report_values(c("evidence"))})
    rows = rows.withColumn("_shared", F.array_intersect(units_of(c("_cv")), units_of(c("_vv"))))
    verbatim = (F.length("_claim") >= 2) & (F.length("_value") >= 2) & c("answer").contains(c("_claim")) & c("evidence").contains(c("_value"))
    in_shared = F.filter(F.array_intersect("_cv", "_ev"), lambda v: F.array_contains(c("_shared"), F.substring_index(v, "=", 1)))
    values_differ = (F.size(F.array_intersect("_cv", "_vv")) == 0) & (F.size(in_shared) == 0)
    pc, pv = polarity(c("_claim")), polarity(c("_value"))
    verdict = (
        F.when((c("kind") != "answer_evidence_mismatch") | ~verbatim, False)
        .when(F.size("_shared") > 0, values_differ)
        .when((F.size("_cv") > 0) | (F.size("_vv") > 0), False)
        .otherwise(F.coalesce(pc != pv, F.lit(False)))
    )
    return rows.withColumn("confirmed", verdict).drop("_claim", "_value", "_cv", "_vv", "_ev", "_shared")


def school_urls(text: Column, domain: str) -> Column:
    """Addresses of the domain in a text, in order, first three."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({URL})"), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))
    host = lambda u: F.lower(F.regexp_extract(u, r"^https://([^/:?#]+)", 1))
    return F.slice(F.array_distinct(F.filter(found, lambda u: (host(u) == domain) | host(u).endswith("." + domain))), 1, 3)


def report_route(text: Column, question: Column, kind: Column, domain: str) -> Column:
    """register > place > recollect > quality > unanswered."""
    return (
        F.when(F.size(school_urls(F.concat_ws(" ", text, question), domain)) > 0, "register")
        .when(question.rlike(PLACE_QUESTION), "place")
        .when(kind == "stale_source", "recollect")
        .when(kind == "answer_quality", "quality")
        .otherwise("unanswered")
    )


def quote_present(page: Column, quote: Column) -> Column:
    """At least two thirds of up to six 30-character pieces of the quote are still on the page."""
    squashed = F.array(F.struct(no_spaces(page).alias("p"), no_spaces(quote).alias("q")))

    def told(s: Column) -> Column:
        p, q = s["p"], s["q"]
        # only the last piece is shorter than the others, so the pieces that count are among the first six
        count = F.least(F.ceil(F.length(q) / F.lit(DRIFT_CHUNK)).cast("int"), F.lit(DRIFT_CHUNKS))
        pieces = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(q, (i - 1) * DRIFT_CHUNK + 1, F.lit(DRIFT_CHUNK)))
        pieces = F.filter(pieces, lambda x: F.length(x) >= DRIFT_MIN)
        hits = F.size(F.filter(pieces, lambda x: F.contains(p, x)))
        return F.when(q == "", True).when(F.size(pieces) == 0, F.contains(p, q)).otherwise(hits * 3 >= F.size(pieces) * 2)

    # as the variable of a lambda both texts are squashed once and not for every piece
    return F.element_at(F.transform(squashed, told), 1)


def source_drift(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """same, changed or unreachable for every (url, quote) against the page read again."""
    joined = quotes.join(pages.select("url", F.col("text").alias("_page")), "url", "left")
    state = F.when(F.col("_page").isNull(), "unreachable").when(quote_present(F.col("_page"), F.col("quote")), "same").otherwise("changed")
    return joined.withColumn("state", state).drop("_page")


def run_gate(runs: DataFrame) -> DataFrame:
    """Why a re-run does not count as solved ('ok' when it does).

    Needs outcome, fallback_reason, cited (array), conflict, answer, reported, required (array of
    id prefixes) and must_contain.
    """
    c = F.col
    reported = F.length(no_spaces(c("reported"))) >= 10
    same = reported & (quote_present(c("answer"), c("reported")) | quote_present(c("reported"), c("answer")))
    rows = runs.withColumn("_same", same)
    cites_it = F.exists("required", lambda p: F.exists("cited", lambda x: F.startswith(x, p)))
    reason = (
        F.when(c("outcome") != "answer", F.coalesce(F.nullif("fallback_reason", F.lit("")), F.nullif("outcome", F.lit("")), F.lit("no_answer")))
        .when(F.size("cited") == 0, "인용 없음")
        .when(c("conflict"), "원문 충돌")
        .when(c("answer").rlike(rules.NOT_FOUND), "답변이 '찾지 못함'")
        .when(c("_same"), "제보된 답과 같음")
        .when((F.size("required") > 0) & ~cites_it, "바꾼 자료를 인용하지 않음")
        .when((c("must_contain") != "") & ~F.contains(no_spaces(c("answer")), no_spaces(c("must_contain"))), "승인한 위치가 답변에 없음")
        .otherwise("ok")
    )
    return rows.withColumn("reason", reason).drop("_same")


def two_of_two(gated: DataFrame, key: str, order: str) -> DataFrame:
    """An item passes when all its runs do; otherwise it keeps the first failing reason."""
    bad = F.col("reason") != "ok"
    return gated.groupBy(key).agg(
        (~F.bool_or(bad)).alias("passed"), F.coalesce(F.min_by("reason", F.when(bad, F.col(order))), F.lit("ok")).alias("reason"), F.count("*").alias("runs")
    )

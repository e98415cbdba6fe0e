"""Answer-quality evaluation: rates with intervals, transitions, criteria and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import rules


def rate(k: Column, n: Column) -> Column:
    return F.bround(F.try_divide(k.cast("double"), n), 3)


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """Struct(low, high): 95 % Wilson interval, three decimals, NULL at n = 0."""
    size = F.nullif(n, F.lit(0).cast("long")).cast("double")
    p = k / size
    den = 1 + z * z / size
    mid = (p + z * z / (2 * size)) / den
    half = F.sqrt(p * (1 - p) / size + z * z / (4 * size * size)) * z / den
    return F.struct(
        F.bround(F.greatest(F.lit(0.0), mid - half), 3).alias("low"),
        F.bround(F.least(F.lit(1.0), mid + half), 3).alias("high"),
    )


def with_rate(df: DataFrame, name: str, k: str, n: str) -> DataFrame:
    """Add {name}_rate, {name}_low and {name}_high for k out of n."""
    ci = wilson(F.col(k), F.col(n))
    return df.withColumns({
        f"{name}_rate": rate(F.col(k), F.col(n)), f"{name}_low": ci["low"], f"{name}_high": ci["high"],
    })


def item_history(days: DataFrame) -> DataFrame:
    """Item-day rows with the first measured result, its cohort day and the previous measured result.

    Rows without a measurement (quota) keep the item's previous result but add nothing to it.
    """
    measured = F.col("reason") != rules.QUOTA_EXCEEDED
    by_item = Window.partitionBy("item_id").orderBy("day")
    earlier = by_item.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("item_id")
    first = F.min(F.when(measured, F.struct("day", "ok"))).over(whole)
    return days.select(
        "*",
        measured.alias("measured"),
        first["ok"].alias("first_ok"),
        first["day"].alias("cohort"),
        F.last(F.when(measured, F.col("ok")), ignorenulls=True).over(earlier).alias("previous"),
    )


def eval_summary(days: DataFrame) -> DataFrame:
    """Per day: strict pass, recovered, frozen-cohort recovered and regression with intervals."""
    baseline = days.agg(F.min("day")).scalar()
    rows = item_history(days)
    failing = F.col("source").isin("unanswered", "report") | (F.col("first_ok") == F.lit(False))
    frozen = F.col("cohort") == baseline
    ran = F.col("measured")
    good = F.col("ok")
    passing = F.col("first_ok") & (F.col("source") == "seed")
    n = lambda cond: F.count(F.when(cond, 1))
    out = rows.groupBy("day").agg(
        n(ran).alias("total"),
        n(~ran).alias("unmeasured"),
        n(ran & good).alias("ok"),
        n(ran & failing).alias("was_failing"),
        n(ran & failing & good).alias("now_ok"),
        n(ran & frozen & failing).alias("frozen_failing"),
        n(ran & frozen & failing & good).alias("frozen_now_ok"),
        n(ran & frozen & passing).alias("frozen_passing"),
        n(ran & frozen & passing & ~good).alias("frozen_lost"),
    )
    out = with_rate(out, "strict", "ok", "total")
    out = with_rate(out, "recovered", "now_ok", "was_failing")
    out = with_rate(out, "frozen_recovered", "frozen_now_ok", "frozen_failing")
    return with_rate(out, "frozen_regression", "frozen_lost", "frozen_passing")


def eval_transitions(days: DataFrame) -> DataFrame:
    """Per day: new, fail_to_ok, ok_to_fail, same_ok and same_fail against the latest earlier day."""
    previous, now = F.col("previous"), F.col("ok")
    kind = (
        F.when(previous.isNull(), "new")
        .when(~previous & now, "fail_to_ok")
        .when(previous & ~now, "ok_to_fail")
        .when(now, "same_ok")
        .otherwise("same_fail")
    )
    return item_history(days).where("measured").groupBy("day", kind.alias("transition")).agg(F.count("*").alias("items"))


def expected_evidence(retrieved: Column, any_of: Column, all_of: Column) -> Column:
    """One of any_of and the whole of all_of among the first five retrieved ids."""
    top = F.slice(retrieved, 1, 5)
    some = (F.size(any_of) == 0) | F.arrays_overlap(any_of, top)
    return some & (F.size(F.array_except(all_of, top)) == 0)


def criteria(results: DataFrame) -> DataFrame:
    """One row per item and required criterion, with its outcome."""
    want = F.when(F.col("want_kind") == "rule", "article").otherwise(F.col("want_kind"))
    answered = F.col("outcome") == "answer"
    checks = {
        "retrieval": expected_evidence(F.col("retrieved"), F.col("any_of"), F.col("all_of")) & (want == F.col("kind")),
        "citation": answered & F.col("cited"),
        "action": F.col("has_actions"),
        "key_facts": F.col("facts_ok"),
        "no_errors": F.col("errors_ok"),
        "oos_fallback": (F.col("outcome") == "fallback") & (F.col("reason") == rules.OUT_OF_SCOPE),
    }
    required = F.coalesce(
        *[F.when(F.col("type") == t, F.array(*[F.lit(c) for c in cs])) for t, cs in rules.TYPE_CRITERIA.items()],
        F.array(*[F.lit(c) for c in rules.TYPE_CRITERIA["rule"]]),
    )
    pairs = F.array(*[F.struct(F.lit(k).alias("criterion"), v.alias("passed")) for k, v in checks.items()])
    return results.select(
        "*", F.explode(F.filter(pairs, lambda p: F.array_contains(required, p["criterion"]))).alias("_c")
    ).select(*results.columns, "_c.criterion", "_c.passed")


def eval_judge(results: DataFrame) -> DataFrame:
    return criteria(results).groupBy("item_id", "type").agg(
        F.count("*").alias("required"),
        F.count(F.when(F.col("passed"), 1)).alias("passed"),
        F.bool_and("passed").alias("correct"),
    )


def eval_metrics(results: DataFrame) -> DataFrame:
    """Accuracy over labelled items only, recall at five, retention, citation and workflow rates."""
    marked = criteria(results)
    n = lambda cond: F.count(F.when(cond, 1))
    is_retrieval = F.col("criterion") == "retrieval"
    flow = F.col("criterion").isin("citation", "action", "oos_fallback")
    item = marked.groupBy("item_id").agg(
        F.bool_and("passed").alias("correct"),
        F.first("labeled").alias("labeled"),
        F.first("outcome").alias("outcome"),
        F.first("cited").alias("cited"),
        F.first("verify_total").alias("vt"),
        F.first("verify_kept").alias("vk"),
        n(is_retrieval).alias("r_n"),
        n(is_retrieval & F.col("passed")).alias("r_k"),
        n(flow).alias("w_n"),
        n(flow & F.col("passed")).alias("w_k"),
    )
    answered = F.col("outcome") == "answer"
    total = item.agg(
        F.count("*").alias("items"),
        n(F.col("labeled")).alias("labeled_items"),
        n(F.col("labeled") & F.col("correct")).alias("correct"),
        n(answered).alias("_answers"),
        n(answered & F.col("cited")).alias("_cited"),
        *[F.sum(c).alias(f"_{c}") for c in ("vt", "vk", "r_n", "r_k", "w_n", "w_k")],
    )
    return total.select(
        "items",
        "labeled_items",
        "correct",
        rate(F.col("correct"), F.col("labeled_items")).alias("accuracy"),
        rate(F.col("_r_k"), F.col("_r_n")).alias("recall_at_5"),
        rate(F.col("_vk"), F.col("_vt")).alias("verified_retention"),
        rate(F.col("_cited"), F.col("_answers")).alias("answer_with_citation_rate"),
        rate(F.col("_w_k"), F.col("_w_n")).alias("workflow_criteria_rate"),
    )

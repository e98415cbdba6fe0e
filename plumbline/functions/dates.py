"""Date expressions: periods in titles, year inference, semesters, relative days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rules


def make_date(year: Column, month: Column, day: Column) -> Column:
    """A date, or NULL when the parts name no real day."""
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def _number(text: Column) -> Column:
    return F.when(text != "", text.cast("int"))


def infer_year(year: Column, month: Column, reference: Column) -> Column:
    """A missing year is the reference year, moved by one when half a year or more apart."""
    gap = month - F.month(reference)
    return F.coalesce(
        year,
        F.when(gap <= -6, F.year(reference) + 1).when(gap >= 6, F.year(reference) - 1).otherwise(F.year(reference)),
    )


_TIME = r"(?:\s*\d{1,2}\s*:\s*\d{2})?"
PERIOD_RANGE = rf"(?<!\d){rules.PERIOD_DATE}{_TIME}\s*{rules.RANGE_MARK}\s*{rules.PERIOD_DATE}(?!\d)"
PERIOD_DEADLINE = rf"(?<!\d){rules.PERIOD_DATE}{_TIME}\s*{rules.DEADLINE_MARK}"


def with_period(df: DataFrame, text: str, reference: str) -> DataFrame:
    """Add period_start and period_end: the first range, or the first deadline when there is none.

    A range that is no valid period gives NULL and never falls through to the deadline form.
    The steps are separate projections because each part is used several times.
    """
    t, ref = F.col(text), F.col(reference)
    part = lambda i: _number(F.regexp_extract(t, PERIOD_RANGE, i))
    due = lambda i: _number(F.regexp_extract(t, PERIOD_DEADLINE, i))
    names = ("_y1", "_m1", "_d1", "_y2", "_m2", "_d2")
    c = F.col
    out = df.select(
        "*", t.rlike(PERIOD_RANGE).alias("_range"), *[part(i + 1).alias(n) for i, n in enumerate(names)],
        *[due(i).alias(f"_due{i}") for i in (1, 2, 3)],
    )
    out = out.withColumns({
        "_start": make_date(infer_year(c("_y1"), c("_m1"), ref), c("_m1"), c("_d1")),
        "_due": make_date(infer_year(c("_due1"), c("_due2"), ref), c("_due2"), c("_due3")),
    })
    out = out.withColumn("_base", F.when(c("_y2").isNull(), c("_start")).otherwise(ref))
    out = out.withColumn("_end", make_date(infer_year(c("_y2"), c("_m2"), c("_base")), c("_m2"), c("_d2")))
    next_year = make_date(F.year("_end") + 1, F.month("_end"), F.dayofmonth("_end"))
    out = out.withColumn("_end", F.when((c("_end") < c("_start")) & c("_y2").isNull(), next_year).otherwise(c("_end")))
    valid = (c("_start") <= c("_end")) & (c("_end") <= F.date_add("_start", rules.MAX_PERIOD_DAYS))
    return out.select(
        *df.columns,
        F.when(c("_range") & valid, c("_start")).alias("period_start"),
        F.when(c("_range"), F.when(valid, c("_end"))).otherwise(c("_due")).alias("period_end"),
    )


def notice_range(text: Column, reference: Column) -> Column:
    """Struct(start, end) of the first date or range; the year comes from the text or reference."""
    pattern = rf"(?<!\d){rules.NOTICE_DATE}(?!\d)"
    part = lambda i: _number(F.regexp_extract(text, pattern, i))
    start_year = F.coalesce(part(1), F.year(reference))
    end_month = F.coalesce(part(5), part(2))
    end_year = F.coalesce(part(4), start_year + (end_month < part(2)).cast("int"))
    start = make_date(start_year, part(2), part(3))
    end = make_date(end_year, end_month, F.coalesce(part(6), part(3)))
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def week_range(title: Column, target: Column) -> Column:
    """Struct(start, end) of the title's range that holds the target day, trying three years."""
    part = lambda i: _number(F.regexp_extract(title, rules.WEEK_TITLE_DATE, i))
    end_month, end_day = F.coalesce(part(3), part(1)), F.coalesce(part(4), part(2))

    def candidate(shift: int) -> Column:
        year = F.year(target) + shift
        first = make_date(year, part(1), part(2))
        last = make_date(year + (end_month < part(1)).cast("int"), end_month, end_day)
        return F.when(target.between(first, last), F.struct(first.alias("start"), last.alias("end")))

    return F.coalesce(candidate(-1), candidate(0), candidate(1))


def loose_date(text: Column) -> Column:
    """Dotted or Korean date; two-digit years from 50 on are 19xx."""
    dot = lambda i: _number(F.regexp_extract(text, rules.DOT_DATE, i))
    kor = lambda i: _number(F.regexp_extract(text, rules.KOREAN_DATE, i))
    pick = lambda i: F.when(text.rlike(rules.DOT_DATE), dot(i)).otherwise(kor(i))
    year = pick(1)
    full = F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)
    return make_date(full, pick(2), pick(3))


def semester_of(day: Column) -> Column:
    """'2026-1' for March to August; September to February belong to term 2."""
    year, month = F.year(day), F.month(day)
    return F.when(month <= 2, F.concat((year - 1).cast("string"), F.lit("-2"))).otherwise(
        F.concat(year.cast("string"), F.lit("-"), F.when(month <= 8, "1").otherwise("2"))
    )


def semester_window(day: Column) -> Column:
    """Struct(start, end) of the term a day lies in."""
    year, month = F.year(day), F.month(day)
    first = F.when(month >= 9, year).otherwise(year - 1)
    spring = month.between(3, 8)
    start = F.when(spring, F.make_date(year, F.lit(3), F.lit(1))).otherwise(F.make_date(first, F.lit(9), F.lit(1)))
    end = F.when(spring, F.make_date(year, F.lit(8), F.lit(31))).otherwise(
        F.date_sub(F.make_date(first + 1, F.lit(3), F.lit(1)), 1)
    )
    return F.struct(start.alias("start"), end.alias("end"))


def relative_day(query: Column, today: Column) -> Column:
    """The day a question means: tomorrow, last week Thursday, and so on."""
    base = today
    for word, shift in reversed(rules.WEEK_SHIFT):
        base = F.when(query.contains(word), F.date_add(today, shift)).otherwise(base)
    squeezed = F.regexp_replace(query, " ", "")
    result = base
    for index, name in reversed(list(enumerate(rules.WEEKDAYS))):
        named = query.contains(name) | squeezed.contains(name[0] + "요")
        result = F.when(named, F.date_add(base, F.lit(index) - F.weekday(base))).otherwise(result)
    for word, shift in reversed(rules.RELATIVE_DAYS):
        result = F.when(query.contains(word), F.date_add(today, shift)).otherwise(result)
    return result

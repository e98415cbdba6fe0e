"""Predicates as columns or row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.functions.text import contains_any, norm_spaces


def normalized_url(url: Column, domains) -> Column:
    """The address without fragment when it is https on an allowed host, else NULL.

    The host is one of `domains` or a subdomain of one; user info and other ports are refused.
    """
    part = lambda name: F.try_parse_url(url, F.lit(name))
    host = F.lower(part("HOST"))
    allowed = F.lit(False)
    for domain in domains:
        allowed = allowed | (host == domain) | host.endswith("." + domain)
    authority = F.lower(part("AUTHORITY"))
    plain = part("USERINFO").isNull() & ((authority == host) | (authority == F.concat(host, F.lit(":443"))))
    path = F.coalesce(F.nullif(part("PATH"), F.lit("")), F.lit("/"))
    query = F.coalesce(F.concat(F.lit("?"), F.nullif(part("QUERY"), F.lit(""))), F.lit(""))
    return F.when(
        (part("PROTOCOL") == "https") & allowed & plain, F.concat(F.lit("https://"), host, path, query)
    )


def public_of_kind(sections: DataFrame, kind: str) -> DataFrame:
    return sections.where((F.col("access") == "public") & (F.col("source_kind") == kind))


def notice_filter(notices: DataFrame, keyword: Column, now: Column, days: Column) -> DataFrame:
    """Notices holding every keyword term and published within `days` (1..180); an unknown date
    keeps the row."""
    clamped = F.greatest(F.lit(1), F.least(days, F.lit(180)))
    searchable = F.lower(F.concat_ws(" ", "title", "summary"))
    terms = F.filter(F.split(F.lower(keyword), r"\s+"), lambda t: t != "")
    matches = F.forall(terms, lambda t: F.contains(searchable, t))
    recent = F.col("published").isNull() | (F.col("published") >= F.date_sub(now, clamped))
    return notices.where(matches & recent)


def matched_words(text: Column, words=rules.STUDENT_WORDS) -> Column:
    listed = F.array(*[F.lit(w) for w in words])
    return F.filter(listed, lambda w: F.contains(text, w))


def page_class(link_text: Column, title: Column) -> Column:
    joined = F.concat_ws(" ", link_text, title)
    return (
        F.when(contains_any(joined, rules.EXCLUDE_WORDS), "excluded")
        .when(contains_any(joined, rules.STUDENT_WORDS), "student")
        .otherwise("other")
    )


def screen(text: Column, tip: bool = True) -> Column:
    """First verdict of the ordered rejection rules: struct(verdict, reason, keep_body)."""
    flagged = lambda pattern: text.rlike("(?iU)" + pattern)

    def verdict(name: str, reason: str, keep: bool = True) -> Column:
        return F.struct(F.lit(name).alias("verdict"), F.lit(reason).alias("reason"), F.lit(keep).alias("keep_body"))

    result = (
        F.when(flagged(rules.SCREEN_URL), verdict("reject", "링크·주소는 적을 수 없습니다"))
        .when(flagged(rules.SCREEN_CONTACT), verdict("reject", "연락처·계정은 적을 수 없습니다", False))
        .when(text.rlike(rules.SCREEN_PROFANITY), verdict("reject", "욕설·비방이 포함되어 있습니다"))
        .when(text.rlike(rules.SCREEN_AD), verdict("reject", "광고·홍보성 글입니다"))
        .when(flagged(rules.SCREEN_INJECTION), verdict("review", "지시문처럼 보이는 문장 — 관리자 확인"))
    )
    if tip:
        result = result.when(
            F.length(norm_spaces(text)) < rules.MIN_TIP_CHARS, verdict("reject", "내용이 너무 짧습니다")
        ).when(
            text.rlike(rules.SCREEN_OUT_OF_SCOPE),
            verdict("reject", "학칙·장학·학적 안내는 꿀팁으로 받지 않습니다(공식 규정으로 안내)"),
        )
    return result.otherwise(verdict("ok", ""))


def chat_eligible(status: Column, approved_at: Column, confirm_times: Column, now: Column) -> Column:
    """Approved within 180 days; student-approved within 30 days or two live recent confirms."""
    within = lambda t, days: (t.isNotNull()) & (t >= now - F.expr(f"INTERVAL {days} DAYS"))
    recent = F.size(F.filter(confirm_times, lambda t: within(t, rules.FRESH_DAYS))) >= rules.FRESH_CONFIRMS
    return (
        F.when(status == "approved", within(approved_at, rules.ADMIN_FRESH_DAYS))
        .when(status == "student_approved", within(approved_at, rules.FRESH_DAYS) | recent)
        .otherwise(False)
    )


def retention(rows: DataFrame, klass: str, created: str, now: Column) -> DataFrame:
    """Rows that are not past the lifetime of their class."""
    hours = F.coalesce(*[F.when(F.col(klass) == k, F.lit(h)) for k, h in rules.TTL_HOURS.items()])
    return rows.where(F.col(created) + F.make_dt_interval(hours=hours) > now)


def vote_short(status: Column, published_at: Column, votes: Column, now: Column) -> Column:
    old = published_at.isNotNull() & (published_at <= now - F.expr(f"INTERVAL {rules.MIN_PUBLIC_HOURS} HOURS"))
    return (status == "verifying") & old & (votes < rules.MIN_VOTES)


def recheck_due(status: Column, approved_at: Column, now: Column) -> Column:
    days = F.coalesce(*[F.when(status == k, F.lit(v)) for k, v in rules.RECHECK_DAYS.items()])
    return F.coalesce(approved_at < now - F.make_dt_interval(days=days), F.lit(False))


def client_noise(message: Column, filename: Column, origin: str) -> Column:
    file = F.coalesce(filename, F.lit(""))
    return (
        F.coalesce(message, F.lit("")).rlike("(?i)" + rules.CLIENT_NOISE)
        | (file == "")
        | file.rlike(rules.EXTENSION_FILE)
        | ~file.startswith(origin)
    )


def telemetry_valid(errors: DataFrame) -> DataFrame:
    """Known kinds and pages only; malformed version and fingerprint are blanked."""
    blank = lambda c, pattern: F.when(F.col(c).rlike(pattern), F.col(c)).otherwise("")
    return errors.where(
        F.col("kind").isin(*rules.ERROR_KINDS) & F.col("page").isin(*rules.ERROR_PAGES)
    ).withColumns({"app_version": blank("app_version", r"^[0-9.]{0,20}$"), "fp": blank("fp", r"^[0-9a-z]{0,16}$")})


def follow_up_key(question: Column) -> Column:
    return F.lower(F.regexp_replace(question, r"(?U)[\s?.!,~·]+", ""))


def follow_up_allowed(question: Column) -> Column:
    return (question != "") & (F.length(question) <= rules.FOLLOW_UP_LEN) & ~question.rlike(rules.FOLLOW_UP_BLOCK)

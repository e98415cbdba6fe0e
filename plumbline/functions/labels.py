"""Small label rules: one expression per label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.functions.text import contains_any, first_word, no_spaces


def rule_level(name: Column) -> Column:
    n = F.trim(name)
    return (
        F.when(n.endswith("세칙"), "시행세칙")
        .when(n.endswith("학칙"), "학칙")
        .when(n.endswith("규정"), "규정")
        .when(n.endswith("지침") | n.endswith("요령"), "지침")
        .otherwise("기타")
    )


def notice_topic(text: Column) -> Column:
    return first_word(no_spaces(text), rules.NOTICE_TOPICS)


def notice_board(topic: Column, query: Column) -> Column:
    hay = F.concat_ws(" ", F.coalesce(topic, F.lit("")), query)
    return (
        F.when(contains_any(hay, rules.SCHOLARSHIP_WORDS), "scholarship")
        .when(contains_any(hay, rules.GENERAL_WORDS), "general")
        .otherwise("academic")
    )


def notice_keyword(topic: Column) -> Column:
    """Topic words without the words every board title shares."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(topic, F.lit("")), "공지사항", " "), "공지", " ")
    words = F.filter(F.split(text, r"\s+"), lambda w: (w != "") & ~w.isin(*rules.GENERIC_TOPIC_WORDS))
    return F.array_join(words, " ")


def date_label(text: Column, raw: Column) -> Column:
    return (
        F.when(raw.isin(*rules.DATE_LABELS), raw)
        .when(contains_any(text, ("마감", "까지")), "신청 마감")
        .otherwise("기간")
    )


def source_of(evidence_id: Column) -> Column:
    """Collection source of an evidence id; NULL when it is not collected."""
    starts = lambda *p: F.coalesce(*[F.when(evidence_id.startswith(x), True) for x in p], F.lit(False))
    return (
        F.when(starts("guide:web-"), "web_pages")
        .when(starts("guide:notice-", "notice:", "cal:"), "events")
        .when(starts("guide:"), "academic_guides")
        .when(starts("menu:"), "menus")
        .when(starts("place:", "dept:", "doc:"), None)
        .when(evidence_id.rlike(r"^\d+_"), "rules")
    )


def doc_prefix(evidence_id: Column) -> Column:
    """Leading part shared by all evidence of one document."""
    colons = F.length(evidence_id) - F.length(F.replace(evidence_id, F.lit(":"), F.lit("")))
    return (
        F.when(evidence_id.rlike(r"^\d+_"), F.concat(F.substring_index(evidence_id, "_", 1), F.lit("_")))
        .when(colons >= 2, F.regexp_extract(evidence_id, r"^(.*:)[^:]*$", 1))
        .otherwise(evidence_id)
    )


def public_badge(status: Column) -> Column:
    return (
        F.when(status == "approved", "관리자 확인")
        .when(status == "student_approved", "학생 확인")
        .when(status == "verifying", "검증 중")
        .otherwise("")
    )


def iso_date(text: Column) -> Column:
    """Registry dates: dotted (a trailing dot allowed) or ISO, else NULL."""
    bare = F.rtrim(F.regexp_replace(text, r"\.+$", ""))
    return F.coalesce(F.try_to_date(bare, "yyyy.M.d"), F.try_to_date(bare, "yyyy-M-d"))


def rule_title(rule_name: Column, kind: Column, number: Column, branch: Column, title: Column) -> Column:
    rule = F.coalesce(F.nullif(rule_name, F.lit("")), F.lit("규정"))
    no = number.cast("string")
    sub = F.when(F.coalesce(branch, F.lit(0)) != 0, branch.cast("string"))
    appendix = F.trim(
        F.concat(
            rule, F.lit(" [별표 "), F.coalesce(no, F.lit("None")), F.coalesce(F.concat(F.lit("-"), sub), F.lit("")),
            F.lit("] "), F.coalesce(title, F.lit("")),
        )
    )
    article = F.concat(
        rule, F.lit(" 제"), no, F.lit("조"), F.coalesce(F.concat(F.lit("의"), sub), F.lit("")),
        F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("("), title, F.lit(")"))).otherwise(""),
    )
    return (
        F.when(kind == "addenda", F.concat(rule, F.lit(" 부칙")))
        .when(kind == "appendix", appendix)
        .when(number.isNull(), F.coalesce(F.nullif(title, F.lit("")), rule))
        .otherwise(article)
    )


def int_like(value: Column) -> Column:
    """Whole floats written without a fraction."""
    return F.when(value == F.floor(value), F.floor(value).cast("long").cast("string")).otherwise(value.cast("string"))


def image_type(head_hex: Column) -> Column:
    """Image type by the first twelve bytes, given as upper-case hex."""
    return (
        F.when(head_hex.startswith("FFD8FF"), "image/jpeg")
        .when(head_hex.startswith("89504E470D0A1A0A"), "image/png")
        .when(head_hex.startswith("47494638"), "image/gif")
        .when(F.substring(head_hex, 17, 8) == "57454250", "image/webp")
        .otherwise("image/jpeg")
    )


def ip_number(address: Column) -> Column:
    """IPv4 address as a number, NULL when malformed."""
    pattern = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    parts = [F.regexp_extract(address, pattern, i) for i in range(1, 5)]
    numbers = [F.when(p != "", p.cast("long")) for p in parts]
    valid = F.lit(True)
    for n in numbers:
        valid = valid & (n <= 255)
    a, b, c, d = numbers
    return F.when(valid, a * 16777216 + b * 65536 + c * 256 + d)


# fixed values: address ranges that are no client (private, reserved, front proxies)
PROXY_RANGES = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
    ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24),
    ("203.0.113.0", 24), ("240.0.0.0", 4), ("35.191.0.0", 16), ("130.211.0.0", 22),
)


def in_ranges(number: Column, ranges=PROXY_RANGES) -> Column:
    inside = F.lit(False)
    for base, bits in ranges:
        a, b, c, d = (int(x) for x in base.split("."))
        low = a * 16777216 + b * 65536 + c * 256 + d
        inside = inside | number.between(low, low + (1 << (32 - bits)) - 1)
    return inside


def client_address(forwarded: Column, peer: Column) -> Column:
    """Right-most public address of a forwarded list, else the peer."""
    parts = F.transform(F.reverse(F.split(forwarded, ",")), lambda p: F.trim(p))
    public = F.filter(parts, lambda p: ip_number(p).isNotNull() & ~in_ranges(ip_number(p)))
    return F.coalesce(F.try_element_at(public, F.lit(1)), peer, F.lit("unknown"))


def event_group(category: Column, board: Column, url: Column, general_path: str) -> Column:
    """Calendar view group of an event: its category, else the board it came from."""
    origin = F.coalesce(board, F.when(F.contains(F.coalesce(url, F.lit("")), F.lit(general_path)), "general").otherwise("events"))
    return F.when(category.isin("calendar", "academic", "scholarship"), category).when(origin == "general", "general").otherwise("events")


def reachable(addresses: Column) -> Column:
    """Whether a host resolves, and to public addresses only."""
    return (F.size(addresses) > 0) & F.forall(addresses, lambda a: ip_number(a).isNotNull() & ~in_ranges(ip_number(a), PROXY_RANGES[:-2]))

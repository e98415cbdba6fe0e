"""Text expressions: normal forms, masks, numbers with units, polarity, phone numbers."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import rules


def _inert_ranges(least: int = 48) -> list[tuple[int, int]]:
    """Long runs of code points that NFKC leaves alone whatever stands beside them: the first few, then the longest."""
    second = set()
    for c in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(c))
        if parts and not parts.startswith("<") and " " in parts:
            second.add(int(parts.split()[1], 16))
    second.update(range(0x1161, 0x1176), range(0x11A8, 0x11C3))  # vowels and finals of decomposed Hangul
    runs, start = [], None
    for c in range(0x10000):
        ch = chr(c)
        inert = not 0xD800 <= c <= 0xDFFF and c not in second and not unicodedata.combining(ch) and unicodedata.is_normalized("NFKC", ch)
        if inert and start is None:
            start = c
        if not inert and start is not None:
            runs.append((start, c - 1))
            start = None
    long = [r for r in runs if r[1] - r[0] + 1 >= least]
    return list(dict.fromkeys(long[:4] + sorted(long, key=lambda r: r[0] - r[1])[:6]))


#: A character outside the common inert runs; texts without any are in normal form.
_UNCOMMON = "[^" + "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in _inert_ranges()) + "]"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


# declared so that the plan computes a folded text once, in front of the expressions and lambdas that use it
_nfkc = _nfkc.asNondeterministic()


def fold_compat(text) -> Column:
    """The text in compatibility normal form (NFKC), exactly.

    ASCII texts, and texts of characters from the common runs that no neighbour changes (Hangul syllables, Han, letters), are in
    that form already; only the others are handed to Arrow, the rest of the batch travels as nulls.
    """
    column = F.col(text) if isinstance(text, str) else text
    other = (F.length(column) != F.octet_length(column)) & column.rlike(_UNCOMMON)
    return F.coalesce(_nfkc(F.when(other, column)), column)


def letters_digits(folded: Column) -> Column:
    return F.lower(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", ""))


def norm_compact(text) -> Column:
    """Letters and digits only, lower case (the form quotes are compared in), compatibility forms folded."""
    return letters_digits(fold_compat(text))


#: Stands between texts that are folded together; no form composes over it.
_BREAK = "\x1f"


def norm_compact_all(texts: Column) -> Column:
    """`norm_compact` of every text of an array, folded in one go."""
    folded = F.split(fold_compat(F.array_join(texts, _BREAK)), _BREAK)
    return F.when(F.size(texts) == 0, F.array().cast("array<string>")).otherwise(F.transform(folded, letters_digits))


def norm_spaces(text) -> Column:
    return F.trim(F.regexp_replace(fold_compat(text), r"(?U)\s+", " "))


def norm_name(text) -> Column:
    """Names of places and units: spaces and joining marks removed, lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)[\s\-_.()]+", ""))


def no_spaces(text) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def mask_pii(text: Column) -> Column:
    """E-mail, mobile number, 8-10 digit number and a stated name, in this order."""
    masked = F.regexp_replace(text, "(?U)" + rules.MASK_EMAIL, "[이메일]")
    masked = F.regexp_replace(masked, rules.MASK_MOBILE, "[전화]")
    masked = F.regexp_replace(masked, rules.MASK_ID, "[학번]")
    return F.regexp_replace(masked, rules.MASK_NAME, "$1[이름]")


def contains_any(text: Column, words) -> Column:
    """True when one of a fixed list of words occurs in the text."""
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def first_word(text: Column, words) -> Column:
    """First word of a fixed list that occurs in the text, else NULL."""
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in words])


def date_variants(text: Column) -> Column:
    """The text with the Korean spellings of its dates appended, for number comparison."""
    whole = F.regexp_extract_all(text, F.lit(f"({rules.ISO_LIKE_DATE})"), F.lit(1))

    def spelled(found: Column) -> Column:
        part = lambda i: F.regexp_extract(found, rules.ISO_LIKE_DATE, i)
        month, day = part(2).cast("int").cast("string"), part(3).cast("int").cast("string")
        return F.concat(
            part(1), F.lit("년"), month, F.lit("월"), day, F.lit("일 "), month, F.lit("월"), day, F.lit("일 "),
            month, F.lit("월 "), day, F.lit("일 "), part(1), F.lit("년"),
        )

    dotted = F.regexp_extract_all(text, F.lit(f"({rules.DOTTED_DAY})"), F.lit(1))

    def month_day(found: Column) -> Column:
        month = F.regexp_extract(found, r"(\d{1,2})\.\s*(\d{1,2})\.", 1).cast("int")
        day = F.regexp_extract(found, r"(\d{1,2})\.\s*(\d{1,2})\.", 2).cast("int")
        ok = month.between(1, 12) & day.between(1, 31)
        m, d = month.cast("string"), day.cast("string")
        return F.when(ok, F.concat(m, F.lit("월"), d, F.lit("일 "), m, F.lit("월 "), d, F.lit("일")))

    short = F.filter(F.transform(dotted, month_day), lambda x: x.isNotNull())
    extra = F.concat(F.transform(whole, spelled), short)
    return F.concat(text, F.when(F.size(extra) > 0, F.concat(F.lit(" "), F.array_join(extra, " "))).otherwise(""))


def table_variants(text: Column) -> Column:
    """The text with the units of table labels appended to their bare numbers."""
    rows = F.filter(F.split(text, "\n"), lambda line: line.startswith(rules.TABLE_PREFIX))

    def pairs(line: Column) -> Column:
        return F.regexp_extract_all(F.substring(line, 5, 1 << 30), F.lit(f"({rules.TABLE_PAIR})"), F.lit(1))

    def with_unit(pair: Column) -> Column:
        label = F.regexp_replace(F.regexp_extract(pair, rules.TABLE_PAIR, 1), " ", "")
        won = F.regexp_extract(pair, rules.TABLE_PAIR, 2)
        value = F.regexp_extract(pair, rules.TABLE_PAIR, 3)
        unit = F.coalesce(*[F.when(label.contains(key), F.lit(u)) for key, u in rules.TABLE_UNITS])
        return F.when(won != "", F.concat(value, F.lit("원"))).otherwise(F.concat(value, unit))

    labelled = F.filter(F.transform(F.flatten(F.transform(rows, pairs)), with_unit), lambda x: x.isNotNull())
    won = F.transform(
        F.regexp_extract_all(text, F.lit(r"[￦₩]\s*(\d+(?:,\d{3})*)"), F.lit(1)),
        lambda v: F.concat(v, F.lit("원")),
    )
    extra = F.concat(labelled, won)
    return F.concat(text, F.when(F.size(extra) > 0, F.concat(F.lit(" "), F.array_join(extra, " "))).otherwise(""))


def unit_numbers(text: Column) -> Column:
    """Numbers with units, citation marks removed first."""
    body = F.regexp_replace(text, rules.CITATION_MARK, " ")
    return F.regexp_extract_all(body, F.lit(f"({rules.UNIT_NUMBER})"), F.lit(1))


def report_values(text: Column) -> Column:
    """Distinct 'unit=number' strings; thousands separators and spaces in units removed."""
    found = F.regexp_extract_all(text, F.lit(f"({rules.REPORT_VALUE})"), F.lit(1))

    def keyed(x: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(x, rules.REPORT_VALUE, 1), ",", "")
        unit = F.regexp_replace(F.regexp_extract(x, rules.REPORT_VALUE, 2), r"\s", "")
        return F.concat(unit, F.lit("="), number)

    return F.array_distinct(F.transform(found, keyed))


def units_of(values: Column) -> Column:
    return F.array_distinct(F.transform(values, lambda v: F.substring_index(v, "=", 1)))


def polarity(text: Column) -> Column:
    """'neg' when a negative form occurs, else 'pos' for a positive form, else NULL."""
    return F.when(text.rlike(rules.NEGATIVE), "neg").when(text.rlike(rules.POSITIVE), "pos")


def _flip_on(marker: Column, holder: Column, other: Column) -> Column:
    """The marker stands in one text only, and the other text has the verb stem before it."""
    word = F.regexp_extract(F.split_part(holder, marker, F.lit(1)), r"([가-힣]{2,})\s*$", 1)
    stem = F.when(F.length(word) > 2, F.left(word, F.length(word) - 1)).otherwise(word)
    return F.contains(holder, marker) & ~F.contains(other, marker) & (word != "") & F.contains(other, stem)


def narrow_flip(sentence: Column, quotes: Column) -> Column:
    """One side negates the same verb stem, or obligation and permission are swapped."""
    markers = F.array(*[F.lit(m) for m in rules.NEGATION])
    flipped = F.exists(markers, lambda m: _flip_on(m, sentence, quotes) | _flip_on(m, quotes, sentence))
    only = lambda token, x, y: x.contains(token) & ~y.contains(token)
    must, may = rules.OBLIGATION, rules.PERMISSION
    return (
        flipped
        | (only(must, sentence, quotes) & only(may, quotes, sentence))
        | (only(may, sentence, quotes) & only(must, quotes, sentence))
    )


def risky_mismatch(sentence: Column, quotes: Column) -> Column:
    tokens = F.array(*[F.lit(t) for t in rules.RISKY])
    return F.exists(tokens, lambda t: F.contains(sentence, t) != F.contains(quotes, t))


def phone_number(raw: Column) -> Column:
    """Short extensions expanded to full numbers."""
    token = F.trim(raw)
    return (
        F.when(token.rlike(r"^\d{4}$"), F.concat(F.lit(f"{rules.LOCAL_AREA}-{rules.LOCAL_OFFICE}-"), token))
        .when(token.rlike(r"^\d{3,4}-\d{4}$"), F.concat(F.lit(f"{rules.LOCAL_AREA}-"), token))
        .otherwise(token)
    )


def phone_format(raw: Column) -> Column:
    """Full numbers hyphenated."""
    digits = F.regexp_replace(raw, r"\D", "")
    part = lambda start, size: F.substring(digits, start, size)
    return (
        F.when(
            digits.startswith(rules.LOCAL_AREA) & (F.length(digits) == 10),
            F.concat(F.lit(f"{rules.LOCAL_AREA}-"), part(4, 3), F.lit("-"), part(7, 4)),
        )
        .when(F.length(digits) == 11, F.concat(part(1, 3), F.lit("-"), part(4, 4), F.lit("-"), part(8, 4)))
        .otherwise(F.trim(raw))
    )

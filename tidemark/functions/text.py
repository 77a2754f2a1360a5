"""Text expressions: names, dates, quotes, instruments; all in Catalyst."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a company's name is compared without.
STOP_WORDS = (
    "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "holdings",
    "holding", "group", "lp", "llc", "sa", "nv", "ag", "the", "de", "class", "a", "b",
)
# State tags, other trading names, a security's kind, defined terms.
STATE_TAG = r"/[a-z]{2,3}/?"
TRADING_AS = r"\bd/?b/?a\b.*$"
SECURITY_TAIL = r"(?i)\b(?:class [a-z] )?(?:common|ordinary|capital) (?:stock|shares)\b.*$|\badrs?\b.*$"
ALIAS = r"""(?i)\s*\(\s*(?:the\s+)?["\u201c\u2018'][^()]{1,60}["\u201d\u2019']\s*\)"""
SHARE_CLASS = r"(?i)\b(series|class)\s+[a-z]\b.*$"


def canonical(c: Column) -> Column:
    """Lower case, single blanks, no blanks around."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def company_name(c: Column) -> Column:
    """Comparable company name: state tags and other trading names off, ``&``
    spelled out, other signs to blanks, stop words dropped; empty if nothing
    is left. ``name_of`` is the same for one Python string."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), STATE_TAG, " ")
    s = F.replace(F.regexp_replace(s, TRADING_AS, " "), F.lit("&"), F.lit(" and "))
    words = F.split(F.regexp_replace(s, "[^a-z0-9]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS)), " ")


def name_of(name: str | None) -> str:
    s = re.sub(TRADING_AS, " ", re.sub(STATE_TAG, " ", (name or "").lower())).replace("&", " and ")
    return " ".join(w for w in re.findall("[a-z0-9]+", s) if w not in STOP_WORDS)


def name_key(c: Column) -> Column:
    """Key of a security's or company's name, without the security's kind."""
    return company_name(F.regexp_replace(F.coalesce(c, F.lit("")), SECURITY_TAIL, ""))


def share_class_key(c: Column) -> Column:
    """``name_key`` without a class or series and what follows it."""
    return name_key(F.regexp_replace(F.coalesce(c, F.lit("")), SHARE_CLASS, ""))


def clean_issuer(c: Column) -> Column:
    """The name without a defined term such as ``("Acme")``; single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, ALIAS, ""), r"\s+", " "))


# What marks a description instead of a name, and a name.
DESCRIPTION = r"(?i:\b(?:unknown|unnamed|undisclosed|employer)\b)|\b(?i:company) [A-Z]\b|'s\s+[a-z]|\("
NAMED = r"\b[A-Z][A-Za-z0-9&.\-]*"
UNNAMED = r"(?i)^(?:a|an|the|at least|several|various|certain|unnamed|unknown|null|none)\b"
NO_NAME = ("null", "none", "n/a")


def is_named(c: Column) -> Column:
    """A named entity: not a description such as "Company A" or "a biotech firm"."""
    blank = (c == "") | F.lower(F.trim(c)).isin(*NO_NAME)
    first = F.substring(c, 1, 1)
    lower_article = c.rlike(UNNAMED) & (first != F.upper(first))
    return F.coalesce(~blank & ~c.rlike(DESCRIPTION) & c.rlike(NAMED) & ~lower_article, F.lit(False))


def any_date(c: Column) -> Column:
    """Date in one of the written forms ("Sept. 5, 2023", "5 June 2023",
    "2023-06-05", "06/05/2023"); null if none fits."""
    s = F.regexp_replace(F.trim(c), r"(?i)\bsept\b\.?", "Sep")
    s = F.regexp_replace(F.regexp_replace(s, r"[.,]", " "), r"\s+", " ")
    forms = ("MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd")
    return F.coalesce(*[F.try_to_date(s, f) for f in forms])


def date_patterns(day: Column) -> Column:
    """A regular expression for the ways in which a quote states a full date:
    month in words (whole or three letters), day, year; or month/day/year."""
    # The four forms that count.
    written = r"(?:%s|%s)\.?\s+%s,?\s+%s|\b%s/%s/%s\b|\b%s/%s/%s\b"
    part = lambda form: F.date_format(day, form)
    parts = [part(f) for f in ("MMMM", "MMM", "d", "yyyy", "M", "d", "yyyy", "MM", "dd", "yyyy")]
    return F.format_string("(?i)" + written, *parts)


def verify_date(day: Column, quote: Column, text: Column) -> Column:
    """Struct of ``day`` (null unless verified) and ``reason``: ``verified`` if the
    quote occurs in the text and states the full date, else ``none_given``,
    ``quote_not_in_release`` or ``quote_lacks_full_date``."""
    found = F.coalesce((quote != "") & F.contains(canonical(F.coalesce(text, F.lit(""))), canonical(quote)), F.lit(False))
    holds = F.coalesce(F.rlike(quote, date_patterns(day)), F.lit(False))
    reason = F.when(day.isNull(), "none_given").when(~found, "quote_not_in_release").when(~holds, "quote_lacks_full_date").otherwise("verified")
    return F.struct(F.when(found & holds, day).alias("day"), reason.alias("reason"))


# Mentions of stock, of employees' options and of options.
STOCK = (
    r"(?i)\bstocks?\b(?!\s*(?:-\s*)?(?:broker|price|market|exchange|options?|trading plan|purchase plan))"
    r"|\bshares?\b(?!\s+(?:price|rose|fell|increased|decreased|dropped|jumped|climbed|declined))"
    r"|\bADRs?\b|\bADSs?\b|American Deposit[ao]ry"
)
EMPLOYEE_OPTION = r"(?i)\b(?:vested|employee|exercis\w*)\b[^.]{0,60}?\b(?:stock )?options?\b"
OPTION = r"(?i)\boptions?\b|\b(?:call|put)s\b"


def check_instruments(claimed: Column, text: Column) -> Column:
    """Struct of ``instruments``, held to what the text says, and ``reason``.

    Options that employees exercised count as stock, so they are taken out
    before options are looked for. A claim that the text does not bear out
    becomes what it does bear out, or ``unknown``.
    """
    body = F.coalesce(text, F.lit(""))
    stock, employee = body.rlike(STOCK), body.rlike(EMPLOYEE_OPTION)
    options = F.regexp_replace(body, EMPLOYEE_OPTION, " ").rlike(OPTION)
    no_options, no_stock = (claimed == "options") & ~options, (claimed == "stock") & ~stock
    not_both = (claimed == "both") & ~(stock & options)
    value = (F.when(no_options & employee, "stock").when(no_options | no_stock, "unknown")
             .when(not_both, F.when(stock, "stock").when(options, "options").otherwise("unknown")).otherwise(claimed))
    reason = (F.when(no_options & employee, "employee_options").when(no_options, "options_not_in_release")
              .when(no_stock, "stock_not_in_release").when(not_both, "both_not_in_release").otherwise("ok"))
    return F.struct(value.alias("instruments"), reason.alias("reason"))


# Phrases that mark a release as a candidate or mention a body.
MENTIONS = {
    "mentions_finra": r"Financial Industry Regulatory Authority|\bFINRA\b",
    "mentions_detection_center": r"(?i)Analysis and Detection Center",
    "mentions_market_abuse_unit": r"(?i)Market Abuse Unit",
    "mentions_options": r"(?i)\b(call|put)\s+options?\b|\boptions?\s+contracts?\b",
}
INSIDER = (
    r"(?i)insider trading|material,?\s+non-?public|non-?public information"
    r"|in advance of the .{0,80}announcement|ahead of (?:the|an) .{0,40}announce"
    r"|\btipp(?:ed|ee|ees|er|ing)\b"
)


def release_flags(text: Column) -> dict[str, Column]:
    body = F.coalesce(text, F.lit(""))
    return {"is_insider_candidate": body.rlike(INSIDER)} | {k: body.rlike(v) for k, v in MENTIONS.items()}


def years_in(text: Column) -> Column:
    """Distinct years written in a text, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))))


def redirect_target(url: Column) -> Column:
    """The page that a search result's redirect link leads to.

    ``uddg=`` carries it percent-encoded, ``u=a1...`` in unpadded URL-safe
    base64; any other link is its own target.
    """
    plain = F.regexp_extract(url, r"[?&]uddg=([^&]+)", 1)
    coded = F.regexp_extract(url, r"[?&]u=a1([A-Za-z0-9_-]+)", 1)
    padded = F.rpad(F.translate(coded, "-_", "+/"), (F.ceil(F.length(coded) / 4) * 4).cast("int"), F.lit("="))
    return F.when(plain != "", F.url_decode(plain)).when(coded != "", F.decode(F.unbase64(padded), "UTF-8")).otherwise(url)


# First and last two-digit group of each division.
SIC_DIVISIONS = (
    (1, 9, "A"), (10, 14, "B"), (15, 17, "C"), (20, 39, "D"), (40, 49, "E"), (50, 51, "F"),
    (52, 59, "G"), (60, 67, "H"), (70, 89, "I"), (91, 99, "J"),
)


def sic_division(sic: Column) -> Column:
    """Division letter of a SIC code, ``?`` where there is none; a code of four
    characters goes by its first two, a shorter number by its hundreds."""
    code = sic.cast("string")
    two = F.when(F.length(code) == 4, F.substring(code, 1, 2).try_cast("int")).otherwise(F.floor(code.try_cast("int") / 100))
    out = F.lit("?")
    for first, last, letter in reversed(SIC_DIVISIONS):
        out = F.when(two.between(first, last), letter).otherwise(out)
    return out

"""Value operations (scalar adjustments) and key functions, as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import patterns


def strip_internal_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def collapse_internal_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_currency_symbols(c: Column) -> Column:
    """Without currency signs; an amount takes its plain notation."""
    bare = F.trim(F.regexp_replace(c, "[$€£]", ""))
    return F.coalesce(patterns.money_text(bare), bare)


def parens_to_negative(c: Column) -> Column:
    """A parenthesised amount becomes negative; anything else is unchanged."""
    return F.coalesce(F.when(F.trim(c).rlike(r"^[(].*[)]$"), patterns.money_text(c)), c)


def trailing_cr_to_negative(c: Column) -> Column:
    return F.coalesce(F.when(F.trim(c).rlike("[Cc][Rr]$"), patterns.money_text(c)), c)


def normalize_date_iso(c: Column) -> Column:
    return F.coalesce(patterns.date(c), c)


def uppercase(c: Column) -> Column:
    return F.upper(c)


def lowercase(c: Column) -> Column:
    return F.lower(c)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def join_lines_comma(c: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != ""), ", ")


def dedupe_preserve_order(c: Column) -> Column:
    """Distinct elements of an array, first occurrences kept in place."""
    return F.array_distinct(c)


VALUE_OPS = {
    f.__name__: f
    for f in (
        strip_internal_whitespace, collapse_internal_spaces, strip_currency_symbols, parens_to_negative, trailing_cr_to_negative, normalize_date_iso,
        uppercase, lowercase, trim, join_lines_comma, dedupe_preserve_order,
    )
}


def apply_ops(c: Column, ops: Sequence[str]) -> Column:
    """Value operations in declared order; an unknown name is an error at plan time."""
    for op in ops:
        c = VALUE_OPS[op](c)
    return c


def normalize_name(c: Column) -> Column:
    """Lower case, anything but letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def account_key(c: Column) -> Column:
    """Canonical identifier: label prefix dropped, only letters and digits, upper case; empty is null."""
    bare = F.regexp_replace(F.trim(c), r"^(?i:circuit|ckt|account|acct|contract|quote)(?:\s+(?i:number|no|id)\b)?\s*[.:#]*\s*", "")
    key = F.upper(F.regexp_replace(bare, "[^A-Za-z0-9]", ""))
    return F.when(key != "", key)


def plain_digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^0-9]", "")


def escape_formula(c: Column) -> Column:
    """Text that a spreadsheet would run gets a leading quote; numbers stay."""
    number = c.rlike(r"^\s*[+-]?(?:[0-9]+(?:_[0-9]+)*[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?\s*$") | F.lower(F.trim(c)).rlike("^[+-]?(?:inf|infinity|nan)$")
    return F.when(c.rlike(r"^[=+\-@]") & ~number, F.concat(F.lit("'"), c)).otherwise(c)


def is_aggregator(domain: Column, known: Sequence[str]) -> Column:
    """Whether a sender's domain is, or is under, one of the known bill aggregators."""
    d = F.lower(domain)
    hits = [d.endswith(f".{k}") | (d == k) for k in known]
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out


def matches_roster(name: Column, roster: Sequence[str]) -> Column:
    """Containment either way against a normalised roster; true when there is nothing to compare."""
    n = normalize_name(name)
    keys = F.array(*(normalize_name(F.lit(r)) for r in roster)) if roster else None
    if keys is None:
        return F.lit(True)
    hit = F.exists(keys, lambda k: n.contains(k) | k.contains(n))
    return F.when(name.isNull() | (n == ""), True).otherwise(hit)

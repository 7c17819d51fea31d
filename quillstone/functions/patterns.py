"""Typed value parsers as Column functions.

Each parser takes a string Column and returns a typed Column that is null on a
miss, so one bad value never fails a job.  All of them are built-in functions
and stay inside generated code.  Patterns avoid look-around, so the same text
can be checked by other engines.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Notations (fixed values).
ISO_CODES, SYMBOLS = ("USD", "CAD", "EUR", "GBP"), "$€£"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DIGITS = "([0-9]{1,3}(,[0-9]{3})+|[0-9]*)[.][0-9]{1,4}"
INTEGER = r"^(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)$"
DECIMAL = r"^-?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]*)[.][0-9]+$"
ACCOUNT = r"^[A-Za-z0-9][A-Za-z0-9 -]*[A-Za-z0-9]$"
PHONE = r"^(?:1[-. ])?(?:[(][0-9]{3}[)]|[0-9]{3})[-. ]?[0-9]{3}[-. ]?[0-9]{4}$"
POSTAL_US = r"^[0-9]{5}(?:-[0-9]{4})?$"
POSTAL_CA = r"^([A-Za-z][0-9][A-Za-z])[ ]*([0-9][A-Za-z][0-9])$"
TAX_ID = r"^[0-9]{9}[A-Za-z]{2}[0-9]{4}$"
SLASH_DATE = r"^[0-9]{1,2}/[0-9]{1,2}/(?:[0-9]{2}|[0-9]{4})$"
LONG_DATE = r"^([A-Za-z]{3,9}) +([0-9]{1,2}),? +([0-9]{4})$"


def _amount(c: Column) -> tuple[Column, Column, Column]:
    """``(digits, negative, valid)`` of a money notation, taken off from both ends.

    From the right: a credit mark, a currency code, a unit of a rate, a closing
    parenthesis; from the left: an opening one, a sign, a symbol, a sign.  What
    is left must be digits with a decimal part.
    """
    off = lambda t, mark: F.trim(F.regexp_replace(t, mark, ""))
    whole = F.trim(c)
    closing = off(off(off(whole, "(cr|CR)$"), "(" + "|".join(ISO_CODES) + ")$"), "/[A-Za-z]{1,4}$")
    opening = off(closing, "[)]$")
    signed = off(opening, "^[(]")
    marked = off(off(signed, "^-"), f"^[{SYMBOLS}]")
    rest = off(marked, "^-")
    negative = whole.rlike("(cr|CR)$") | signed.startswith("-") | marked.startswith("-") | (opening.startswith("(") & closing.endswith(")"))
    return F.regexp_replace(rest, ",", ""), negative, rest.rlike(f"^{DIGITS}$")


def is_money(c: Column) -> Column:
    """Whether the trimmed text is a money notation; the decimal part is mandatory."""
    return c.contains(".") & _amount(c)[2]


def currency(c: Column) -> Column:
    """Exact amount; negative by a sign, a trailing ``cr``, or both parentheses."""
    digits, negative, valid = _amount(c)
    value = digits.try_cast("decimal(38,4)")
    return F.when(c.contains(".") & valid, F.when(negative, -value).otherwise(value))  # most texts are no money: their sign is not looked for


def money_text(c: Column) -> Column:
    """The amount with its printed scale kept, as text."""
    digits, negative, valid = _amount(c)
    whole = F.when(digits.startswith("."), F.concat(F.lit("0"), digits)).otherwise(digits)
    return F.when(c.contains(".") & valid, F.concat(F.when(negative, "-").otherwise(""), whole))


def currency_signed(c: Column) -> Column:
    """As :func:`currency`, but a sign must be printed; one leading plus is allowed."""
    t = F.trim(c)
    rest = F.regexp_replace(t, r"^\+", "")
    signed = t.startswith("+") | t.rlike(r"-|[Cc][Rr]$") | t.rlike(r"^[(].*[)]$")
    return F.when(signed, currency(rest))


def integer(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike(INTEGER), F.regexp_replace(t, ",", "")).try_cast("bigint")


def decimal(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike(DECIMAL), F.regexp_replace(t, ",", "")).try_cast("decimal(38,10)")


def date(c: Column) -> Column:
    """ISO text of ``M/D/YY``, ``M/D/YYYY`` or ``Month D[,] YYYY``, month whole or short; impossible dates miss."""
    t = F.trim(c)
    last = F.regexp_extract(t, "[0-9]+$", 0)
    full = F.when(F.length(last) == 2, F.concat(F.regexp_replace(t, "[0-9]+$", ""), F.lit("20"), last)).otherwise(t)
    slash = F.try_to_date(F.when(t.rlike(SLASH_DATE), full), "M/d/yyyy")
    numbers = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS) for k in dict.fromkeys((m[:3], m, *(("Sept",) if m[:3] == "Sep" else ()))) for x in (k.lower(), str(i + 1))))
    part = lambda i: F.regexp_extract(t, LONG_DATE, i)
    named = F.concat_ws("-", part(3), F.try_element_at(numbers, F.lower(part(1))), part(2))
    long = F.when(t.rlike(LONG_DATE) & F.try_element_at(numbers, F.lower(part(1))).isNotNull(), F.try_to_date(named, "yyyy-M-d"))
    return F.date_format(F.coalesce(slash, long), "yyyy-MM-dd")


def date_result(c: Column) -> Column:
    """``struct(raw, iso, parsed, ambiguous)``; a two-digit year is ambiguous."""
    iso = date(c)
    short = F.trim(c).rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$")
    return F.when(F.trim(c) != "", F.struct(c.alias("raw"), iso.alias("iso"), iso.isNotNull().alias("parsed"), (short & iso.isNotNull()).alias("ambiguous")))


def text(c: Column) -> Column:
    """First non-blank line, trimmed."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.try_element_at(lines, F.lit(1))


def text_block(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def account_number(c: Column) -> Column:
    """``struct(raw, normalized)``; the normal form drops spaces and hyphens."""
    t = F.trim(c)
    return F.when(t.rlike(ACCOUNT), F.struct(t.alias("raw"), F.regexp_replace(t, "[ -]", "").alias("normalized")))


def phone(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike(PHONE), t)


def postal_code(c: Column) -> Column:
    t = F.trim(c)
    ca = F.concat(F.regexp_extract(t, POSTAL_CA, 1), F.lit(" "), F.regexp_extract(t, POSTAL_CA, 2))
    return F.when(t.rlike(POSTAL_US), t).when(t.rlike(POSTAL_CA), F.upper(ca))


def tax_id(c: Column) -> Column:
    t = F.regexp_replace(F.trim(c), " ", "")
    return F.when(t.rlike(TAX_ID), F.upper(t))


def digits_run(c: Column) -> Column:
    t = F.regexp_replace(F.trim(c), " ", "")
    return F.when(t.rlike("^[0-9]{10,}$"), t)


REGISTRY = {
    "currency": currency, "currency_signed": currency_signed, "integer": integer, "decimal": decimal, "date": date, "date_loose": date_result,
    "text": text, "text_block": text_block, "account_number": account_number, "phone": phone, "postal_code": postal_code, "tax_id": tax_id, "digits_run": digits_run,
}


class PatternError(ValueError):
    """A pattern outside the restricted language."""


def _symbols(pattern: str):
    """``(kind, text)`` of a pattern: escape, class, open, close, repeat or char."""
    at = 0
    while at < len(pattern):
        c, end = pattern[at], at + 1
        if c == "\\":
            kind, end = "escape", at + 2
        elif c == "[":
            kind, end = "class", at + 1 + pattern.startswith("^", at + 1)
            end += pattern.startswith("]", end)  # a bracket in first place is a member
            while end < len(pattern) and pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            end += 1
        elif c == "(":
            kind = "open"
            if pattern.startswith("(?", at):
                end = at + 2
                while end < len(pattern) and pattern[end] not in ":=!>)":
                    end += 1
                end += 1
        elif c == "{" and "}" in pattern[at:]:
            kind, end = "repeat", pattern.index("}", at) + 1
        else:
            kind = {")": "close", "*": "repeat", "+": "repeat", "?": "repeat"}.get(c, "char")
        yield kind, pattern[at:end]
        at = end


def compile_restricted(pattern: str) -> str:
    """Check a custom pattern: at most 200 characters and one group, nothing unbounded or backtracking-prone."""
    if not pattern or len(pattern) > 200:
        raise PatternError("a pattern has 1 to 200 characters")
    inside = [False]  # for each open group: does its body repeat anything
    before, body_repeats = "", False  # the symbol before, and of a group just closed whether it repeats within
    for kind, text in _symbols(pattern):
        if kind == "escape" and text[1:].isdigit() and text != "\\0":
            raise PatternError("no back-references")
        if kind == "open":
            if text.startswith("(?P="):
                raise PatternError("no back-references")
            if text.startswith(("(?<=", "(?<!", "(?>")):
                raise PatternError("no look-behind or atomic groups")
            inside.append(False)
        elif kind == "close" and len(inside) > 1:
            body_repeats = inside.pop()
            inside[-1] |= body_repeats
        elif kind == "repeat":
            if before == "repeat" and text == "+":
                raise PatternError("no possessive repetition")
            if text in "*+" or text.endswith(",}"):
                raise PatternError("no unbounded repetition")
            if before == "close" and body_repeats and text != "?":
                raise PatternError("no nested repetition")
            inside[-1] = True
        before = kind
    try:
        groups = re.compile(pattern).groups
    except re.error as e:
        raise PatternError(f"not a pattern: {e}") from e
    if groups > 1:
        raise PatternError("at most one group")
    return pattern


def resolve(name: str):
    """A parser by registered name, or a restricted pattern with search semantics."""
    if name in REGISTRY:
        return REGISTRY[name]
    checked = compile_restricted(name)
    group = 1 if re.compile(checked).groups else 0
    return lambda c: F.when(c.rlike(checked), F.regexp_extract(c, checked, group))

"""Document operations: what is owed is derived from what is printed, never extracted.

Amounts are ``decimal(18,2)`` Columns, null where not printed.  Each function
returns Columns, so a document's whole chain is one projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.values import plain_digits

CLOSES_WITHIN = "0.01"
DERIVED_ONLY = ("amount_payable", "payable_basis", "document_identity", "identity_basis", "carried_balance")
MONEY = "decimal(18,2)"


def _zero() -> Column:
    return F.lit("0.00").cast(MONEY)


def closes(a: Column, b: Column) -> Column:
    """Equal within one cent, the cent included."""
    return F.abs(a - b) <= F.lit(CLOSES_WITHIN).cast(MONEY)


def normalize_credit_sign(amount: Column) -> Column:
    """Payments and credits are negative however they are printed."""
    return F.when(amount > 0, -amount).otherwise(amount).cast(MONEY)


def prefer_current_charges_line(values: Column) -> Column:
    """The last of several matches."""
    return F.try_element_at(values, F.lit(-1))


def carried_balance(prior: Column, payments: Column, basis: Column) -> Column:
    """What is carried over: 0 without a prior balance; the prior if payments are netted already; else prior plus payments; null for an unknown basis."""
    return (
        F.when(prior.isNull(), _zero())
        .when(basis == "net_of_payments", prior)
        .when(basis == "gross", (prior + F.coalesce(payments, _zero())).cast(MONEY))
        .cast(MONEY)
    )


def current_from_printed(current: Column, printed: Column, carried: Column) -> Column:
    """Current charges, or printed less carried where they are not printed and something is carried."""
    return F.coalesce(current, F.when((carried != 0) & printed.isNotNull(), (printed - carried).cast(MONEY)))


def amount_payable(printed: Column, please_pay: Column, prior: Column, carried: Column, current: Column) -> Column:
    """``struct(value, basis, refusal)``: the payable amount, or the reason it is refused."""
    reason = (
        F.when(printed.isNotNull() & please_pay.isNotNull() & ~closes(printed, please_pay), "totals_disagree")
        .when(prior.isNotNull() & carried.isNull(), "carried_unknown")
        .when((carried != 0) & current.isNotNull() & printed.isNotNull() & ~closes(carried + current, printed), "does_not_close")
        .when((carried != 0) & current.isNull(), "current_missing")
        .when(printed.isNull(), "total_missing")
    )
    by_current = carried != 0
    value = F.when(reason.isNull(), F.when(by_current, current).otherwise(printed)).cast(MONEY)
    basis = F.when(reason.isNull(), F.when(by_current, "current_charges").otherwise("total_printed"))
    return F.struct(value.alias("value"), basis.alias("basis"), reason.alias("refusal"))


def crosscheck_line_sum(rows_sum: Column, subtotal: Column) -> Column:
    """``agree``, ``arith_lines_mismatch``, or null if there is nothing to compare."""
    return F.when(rows_sum.isNotNull() & subtotal.isNotNull(), F.when(closes(rows_sum, subtotal), "agree").otherwise("arith_lines_mismatch"))


def crosscheck_total_composition(printed: Column, subtotal: Column, charges: Column, tax: Column) -> Column:
    """Whether the total is subtotal plus charges, plus tax, or plus both."""
    c, t = F.coalesce(charges, _zero()), F.coalesce(tax, _zero())
    ways = F.array((subtotal + c).cast(MONEY), (subtotal + t).cast(MONEY), (subtotal + c + t).cast(MONEY))
    return F.when(printed.isNotNull() & subtotal.isNotNull(), F.when(F.exists(ways, lambda w: closes(w, printed)), "agree").otherwise("arith_total_mismatch"))


def crosscheck_balance_composition(carried: Column, current: Column, printed: Column) -> Column:
    return F.when((carried != 0) & current.isNotNull() & printed.isNotNull(), F.when(closes(carried + current, printed), "agree").otherwise("arith_balance_mismatch"))


def crosscheck_scanline(value: Column, scanline: Column) -> Column:
    """Whether the value's digits (three at least) lie within the scan line's."""
    d = plain_digits(value)
    return F.when(scanline.isNotNull() & (F.length(d) >= 3), F.when(plain_digits(scanline).contains(d), "agree").otherwise("scanline_mismatch"))


def crosscheck_duplicate_anchor(values: Column) -> Column:
    return F.when(F.size(values) > 1, F.when(F.size(F.array_distinct(values)) == 1, "agree").otherwise("review"))


def crosscheck_filename(name: Column, candidates: Mapping[str, Column]) -> Column:
    """``struct(state, field)``: the first candidate whose digits (three at least) the file name has; else disagree, or absent without candidates."""
    digits = plain_digits(name)
    usable = {k: plain_digits(v) for k, v in candidates.items()}
    hit = F.coalesce(*(F.when((F.length(d) >= 3) & digits.contains(d), F.lit(k)) for k, d in usable.items()))
    some = reduce(lambda a, b: a | b, [F.length(d) >= 3 for d in usable.values()]) & (F.length(digits) >= 3)
    state = F.when(hit.isNotNull(), "agree").when(some, "disagree").otherwise("absent")
    return F.struct(state.alias("state"), hit.alias("field"))


def document_identity(invoice: Column, account: Column, period: Column, fingerprint: Column) -> Column:
    """``struct(identity, basis)``: invoice number, else account and period, else the soft fingerprint."""
    pair = F.when(account.isNotNull() & period.isNotNull(), F.concat_ws("|", F.regexp_replace(account, "[ -]", ""), period))
    soft = F.concat(F.lit("soft:"), fingerprint)
    basis = F.when(invoice.isNotNull(), "invoice_number").when(pair.isNotNull(), "account_period").when(fingerprint.isNotNull(), "soft")
    return F.struct(F.coalesce(invoice, pair, soft).alias("identity"), basis.alias("basis"))


def infer_currency(explicit: Column, tax_regime: Column, postal: Column, default: str) -> Column:
    """``struct(code, basis, weak)``: printed code, tax regime, Canadian postal code, pack default; the last two are weak."""
    ca = postal.rlike(r"^[A-Z][0-9][A-Z] [0-9][A-Z][0-9]$")
    code = F.when(explicit.isNotNull(), explicit).when(tax_regime, "CAD").when(ca, "CAD").otherwise(default)
    basis = F.when(explicit.isNotNull(), "explicit").when(tax_regime, "tax_regime").when(ca, "vendor_address").otherwise("pack_default")
    return F.struct(code.alias("code"), basis.alias("basis"), basis.isin("vendor_address", "pack_default").alias("weak"))


def longest_alias(text: Column, aliases: Mapping[str, str]) -> Column:
    """Canonical name of the longest alias that the text holds as whole words."""
    order = sorted(aliases, key=lambda a: (-len(a), a))
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return F.coalesce(*(F.when(padded.contains(f" {a} "), F.lit(aliases[a])) for a in order), F.lit(None).cast("string"))


def price_per_foot(df: DataFrame, tiers: DataFrame, freight: DataFrame, *, surcharge: str) -> DataFrame:
    """Weight-tiered price: ``weight x cost x margin x (1 + cut)`` plus freight and surcharge, two decimals, half to even.

    ``tiers(lo, hi, margin)`` is a range join on weight, ``freight(state, rate)``
    a lookup; both are declared tables of a few rows.  A missing tier or rate
    leaves the price null and the row in review.
    """
    j = df.join(F.broadcast(tiers), (df.weight >= tiers.lo) & (df.weight < tiers.hi), "left").join(F.broadcast(freight), "state", "left")
    raw = F.col("weight") * F.col("cost") * F.col("margin") * (1 + F.col("cut"))
    return j.withColumn("price", F.bround((raw + F.col("rate") + F.lit(surcharge).cast("decimal(8,4)")).cast("decimal(30,8)"), 2)).withColumn("needs_review", F.col("price").isNull())


def coalesce_names(*cols: Column) -> Column:
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in cols))


def total_of(columns: Sequence[Column]) -> Column:
    """Sum of the amounts seen; null if none is."""
    seen = reduce(lambda a, b: a | b, [c.isNotNull() for c in columns])
    return F.when(seen, reduce(lambda a, b: a + b, [F.coalesce(c, _zero()) for c in columns])).cast(MONEY)

"""Confidence, coverage, lanes and the review gate."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Penalty factors (fixed values).
PENALTIES = {
    "soft_miss": "0.80", "draft_rules": "0.85", "ocr_source": "0.90", "ambiguous_anchor": "0.90", "anchor_alt_used": "0.95", "pattern_timeout": "0.50",
    "arith_lines_mismatch": "0.85", "arith_total_mismatch": "0.85", "arith_balance_mismatch": "0.80", "scanline_mismatch": "0.85", "filename_disagree": "0.95",
    "currency_inferred_weak": "0.90", "ambiguous_two_digit_year": "0.95", "handwriting_detected": "0.60", "high_skew": "0.85", "flattened_annotations": "0.75",
}
BOOST, BOOST_CAP, CEILING = "1.03", "1.10", "0.99"
DEFAULT_THRESHOLD, VERY_LOW, VERY_LOW_SHARE = "0.90", "0.50", "0.60"
COLLAPSE_MISSING, COLLAPSE_SHARE = 3, 0.60
#: Tags and modifiers that always send a document to review (fixed values).
FORCED_TAGS = ("has_flattened_annotations", "bill_to_mismatch", "xlsx_hidden_content_present")
FORCED_MODIFIERS = ("flattened_annotations", "arith_balance_mismatch")
WIDE = "decimal(38,20)"
MATCH_QUALITY = {"anchored": "1.00", "alternate": "0.95", "region": "0.90"}


def apply_modifiers(quality: Column, modifiers: Column) -> Column:
    """Quality times the penalty of each modifier, clamped to [0, 0.99]; an unknown modifier gives null."""
    table = F.create_map(*(x for k, v in PENALTIES.items() for x in (F.lit(k), F.lit(v).cast(WIDE))))
    product = F.aggregate(modifiers, quality.cast(WIDE), lambda acc, m: (acc * F.try_element_at(table, m)).cast(WIDE))
    return F.when(product.isNotNull(), F.greatest(F.lit("0").cast(WIDE), F.least(product, F.lit(CEILING).cast(WIDE))))


def apply_boosts(value: Column, n: Column) -> Column:
    """Times ``1.03`` for each boost, at most ``1.10``, clamped."""
    steps = F.array(*(F.lit(str(Decimal(BOOST) ** i)).cast(WIDE) for i in range(5)))  # the fourth is above the cap
    factor = F.least(F.element_at(steps, F.least(n, F.lit(4)).cast("int") + 1), F.lit(BOOST_CAP).cast(WIDE))
    return F.least((value.cast(WIDE) * factor).cast(WIDE), F.lit(CEILING).cast(WIDE))


def lane(confidence: Column, thresholds: Column) -> Column:
    """``high``, ``medium`` or ``low`` of a map of field confidences, by the fields' thresholds."""
    values = F.map_values(confidence)
    below = F.size(F.filter(F.map_entries(confidence), lambda e: e.value < F.coalesce(F.try_element_at(thresholds, e.key), F.lit(DEFAULT_THRESHOLD).cast("double"))))
    weak = F.size(F.filter(values, lambda v: v < float(VERY_LOW))) / F.greatest(F.size(values), F.lit(1))
    return F.when(below == 0, "high").when(weak >= float(VERY_LOW_SHARE), "low").otherwise("medium")


def coverage(declared: Column, required: Column, populated: Column) -> Column:
    """``struct(declared, populated, missing_required, complete, collapsed)`` of arrays of field names."""
    missing = F.array_except(required, populated)
    share = 1 - F.size(F.array_intersect(declared, populated)) / F.greatest(F.size(declared), F.lit(1))
    gone = F.size(F.array_except(declared, populated))
    return F.struct(
        F.size(declared).alias("declared"), F.size(F.array_intersect(declared, populated)).alias("populated"), missing.alias("missing_required"), (F.size(missing) == 0).alias("complete"),
        ((gone >= COLLAPSE_MISSING) & (share >= COLLAPSE_SHARE)).alias("collapsed"),
    )


def gate(lane_: Column, has_confidence: Column, collapsed: Column, forced: Column, missing: Column) -> Column:
    """``struct(lane, review_flag, regen_flag)``; the first rule that applies decides.

    Without any confidence: review if forced, else low.  Collapsed or low: low,
    to be regenerated and reviewed.  Forced or incomplete: review.  Medium:
    reviewed.  High passes.
    """
    out = lambda name, review, regen: F.struct(F.lit(name).alias("lane"), F.lit(review).alias("review_flag"), F.lit(regen).alias("regen_flag"))
    return (
        F.when(~has_confidence & forced, out("review", True, False))
        .when(~has_confidence & collapsed, out("low", True, True))
        .when(~has_confidence, out("low", True, False))
        .when(collapsed | (lane_ == "low"), out("low", True, True))
        .when(forced | missing, out("review", True, False))
        .when(lane_ == "medium", out("medium", True, False))
        .otherwise(out("high", False, False))
    )


def forced(tags: Column, modifiers: Column) -> Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, FORCED_TAGS))) | F.arrays_overlap(modifiers, F.array(*map(F.lit, FORCED_MODIFIERS)))


def audit_sample(document_id: Column, seed: int, one_in: int) -> Column:
    """A reproducible sample that does not depend on processing order."""
    return F.pmod(F.xxhash64(document_id, F.lit(seed)), F.lit(one_in)) == 0


VISION_FLOOR, VISION_CEILING, VISION_DEFAULT = 0.50, 0.70, 0.50


def vision_confidence(c: Column) -> Column:
    """A model's own confidence, held within [0.50, 0.70]; unusable ones are 0.50."""
    return F.when(c.isNull() | F.isnan(c), F.lit(VISION_DEFAULT)).otherwise(F.greatest(F.lit(VISION_FLOOR), F.least(c, F.lit(VISION_CEILING))))


def vision_fields(fields: Column, allowed: Column) -> Column:
    """Allowed, non-blank fields of a model's answer."""
    return F.map_filter(fields, lambda k, v: F.array_contains(allowed, k) & v.isNotNull() & (F.trim(v) != ""))

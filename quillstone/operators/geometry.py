"""Lines, pitches, cells and regions of pages of positioned words.

A page is one row with an array of words; lines are folded inside the row, so
building them needs no shuffle whatever the number of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes in points (fixed values).
TOLERANCE, LEAST_TOLERANCE, PITCH_SHARE = 3.0, 2.5, 0.4
CELL_GAP, GUTTER = 12.0, 24
HEADER_SHARE, REMITTANCE_FROM, TOTALS_FROM = 0.25, 0.70, 0.60
NEAR_LEFT, NEAR_RIGHT, NEAR_DOWN = 12.0, 300.0, 40.0
TOTALS_LEAD, TOTALS_BAND = 2.0, 80.0


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def group_lines(words: Column, tolerance: Column | float = TOLERANCE) -> Column:
    """Visual lines: words in (y, x) order; a word joins the line whose *first* word is within the tolerance.

    Comparing with the line's head, not with the previous word, keeps drifting
    baselines from chaining into one line.
    """
    tol = F.lit(tolerance) if not isinstance(tolerance, Column) else tolerance
    keyed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.y0.alias("y0"), w.x0.alias("x0"), i.alias("i"), w.alias("w"))))
    by_x = lambda ws: F.transform(F.sort_array(F.transform(ws, lambda k, i: F.struct(k["x0"].alias("x0"), i.alias("i"), k["w"].alias("w")))), lambda s: s.w)

    def step(acc: Column, k: Column) -> Column:
        """Only where lines begin is kept, so a long page is not copied for each of its words."""
        joins = F.abs(F.try_element_at(acc, F.lit(-1))["head"] - k["y0"]) <= tol
        return F.when(F.coalesce(joins, F.lit(False)), acc).otherwise(F.concat(acc, F.array(F.struct(k["at"].alias("at"), k["y0"].alias("head")))))

    def cut(ks: Column) -> Column:
        starts = F.aggregate(F.transform(ks, lambda k, j: F.struct((j + 1).alias("at"), k["y0"].alias("y0"))), F.array().cast("array<struct<at:int,head:double>>"), step)
        size = lambda all_, s, j: F.coalesce(F.try_element_at(all_, j + 2)["at"], F.size(ks) + 1) - s["at"]
        return let(starts, lambda all_: F.transform(all_, lambda s, j: F.struct(s["head"].alias("y0"), by_x(F.slice(ks, s["at"], size(all_, s, j))).alias("words"))))

    return let(keyed, cut)


def line_text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def lines(pages: DataFrame) -> DataFrame:
    """``(document_id, page_number, line_idx, y0, n_words, text, words)`` of ``pages``."""
    exploded = pages.select("document_id", "page_number", F.posexplode(group_lines(F.col("words"), F.col("line_tolerance"))).alias("line_idx", "line"))
    return exploded.select("document_id", "page_number", "line_idx", "line.y0", F.size("line.words").alias("n_words"), line_text(F.col("line.words")).alias("text"), "line.words")


def _median(xs: Column) -> Column:
    def middle(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, F.floor((n + 2) / 2).cast("int"))) / 2)

    return let(F.array_sort(xs), middle)


def median_pitch(baselines: Column) -> Column:
    """Median of consecutive baseline gaps; null below two lines."""
    gaps = F.transform(F.slice(baselines, 2, F.greatest(F.size(baselines) - 1, F.lit(0))), lambda y, i: y - F.element_at(baselines, i + 1))
    return _median(gaps)


def line_tolerance(words: Column) -> Column:
    """``0.4 x median pitch`` at the default tolerance, clamped to 2.5 and 3."""
    pitch = median_pitch(F.transform(group_lines(words), lambda x: x["y0"]))
    return F.coalesce(F.greatest(F.lit(LEAST_TOLERANCE), F.least(pitch * PITCH_SHARE, F.lit(TOLERANCE))), F.lit(TOLERANCE))


def cells(words: Column, gap: float = CELL_GAP) -> Column:
    """A line's words cut where the gap to the next is above ``gap``: array of cell texts."""
    start = F.array().cast("array<struct<x1:double,text:string>>")

    def step(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = F.coalesce(w.x0 - last["x1"] <= gap, F.lit(False))
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(w.x1.alias("x1"), F.concat_ws(" ", last["text"], w["text"]).alias("text"))))
        return F.when(same, grown).otherwise(F.concat(acc, F.array(F.struct(w.x1.alias("x1"), w["text"].alias("text"))))).cast("array<struct<x1:double,text:string>>")

    return F.transform(F.aggregate(words, start, step), lambda c: c["text"])


def column_cut(words: Column, anchor_x: Column) -> Column:
    """Left edge of the first gutter of at least 24 points at or right of the anchor, over all words of a block."""
    spans = F.array_sort(F.transform(F.filter(words, lambda w: w.x1 > anchor_x), lambda w: F.struct(F.floor(w.x0).cast("long").alias("a"), F.ceil(w.x1).cast("long").alias("b"))))
    kind = "struct<edge:bigint,cut:bigint>"
    start = F.struct(F.lit(None).cast("long").alias("edge"), F.lit(None).cast("long").alias("cut"))

    def step(acc: Column, s: Column) -> Column:
        gap = acc["cut"].isNull() & acc["edge"].isNotNull() & (s["a"] - acc["edge"] >= GUTTER)
        return F.struct(F.greatest(acc["edge"], s["b"]).alias("edge"), F.when(gap, acc["edge"]).otherwise(acc["cut"]).alias("cut")).cast(kind)

    return F.aggregate(spans, start.cast(kind), step, lambda acc: acc["cut"])


def page_pitch(baselines: Column) -> Column:
    """Median pitch of a page; null below four lines."""
    return F.when(F.size(baselines) >= 4, median_pitch(baselines))


def scaled(floor: float, pitch: Column) -> Column:
    """``floor`` points, or as many lines of 14 points at the page's own pitch where that is more."""
    return F.greatest(F.lit(floor), pitch * (floor / 14.0))


REGIONS = {
    "first-page": lambda w, p: p["page"] == 1,
    "last-page": lambda w, p: p["page"] == p["pages"],
    "any-page": lambda w, p: F.lit(True),
    "header-block": lambda w, p: (p["page"] == 1) & (w["y0"] <= p["height"] * HEADER_SHARE),
    "top-left": lambda w, p: (p["page"] == 1) & (w["y0"] <= p["height"] / 3) & (w["x0"] < p["width"] / 3),
    "top-center": lambda w, p: (p["page"] == 1) & (w["y0"] <= p["height"] / 3) & (w["x0"] >= p["width"] / 3) & (w["x0"] < p["width"] * 2 / 3),
    "top-right": lambda w, p: (p["page"] == 1) & (w["y0"] <= p["height"] / 3) & (w["x0"] >= p["width"] * 2 / 3),
    "remittance-block": lambda w, p: ((p["page"] == 1) | (p["page"] == p["pages"])) & (w["y0"] >= F.coalesce(p["detach_y"] + TOLERANCE, p["height"] * REMITTANCE_FROM)),
    "totals-block": lambda w, p: ((p["page"] == 1) | (p["page"] == p["pages"]))
    & F.when(p["totals_y"].isNotNull(), (w["y0"] >= p["totals_y"] - TOTALS_LEAD) & (w["y0"] <= p["totals_y"] + TOTALS_BAND)).otherwise(w["y0"] >= p["height"] * TOTALS_FROM),
    "same-row": lambda w, p: F.abs(w["y0"] - p["anchor_y"]) <= TOLERANCE,
    "near-anchor": lambda w, p: (w["x0"] >= p["anchor_x"] - NEAR_LEFT) & (w["x0"] < p["anchor_x"] + scaled(NEAR_RIGHT, p["pitch"]))
    & (w["y0"] >= p["anchor_y"] - p["tolerance"]) & (w["y0"] <= p["anchor_y"] + scaled(NEAR_DOWN, p["pitch"])),
    "line_items": lambda w, p: w["y0"] >= p["anchor_y"] + TOLERANCE + 1,
}


def in_region(name: str, word: dict[str, Column], page: dict[str, Column]) -> Column:
    """Whether a word lies in a named region, or on ``page:N``."""
    if name.startswith("page:"):
        return page["page"] == int(name[5:])
    return REGIONS[name](word, page)


def label_block(lines_: Column, anchor_y: Column, *, reach: float = 140.0, blanks: int = 1, factor: float = 2.0, floor: float = 24.0) -> Column:
    """Lines below an anchor that belong to its block.

    ``lines_`` is an ordered array of ``struct(y0, text)`` with null text where
    a line is blank in the anchor's column.  The block ends at the second
    blank line in a row, or where the gap exceeds ``max(floor, factor x running
    median pitch)``.
    """
    kind = "struct<ys:array<double>,out:array<string>,blank:int,open:boolean>"
    start = F.struct(F.array(anchor_y).alias("ys"), F.array().cast("array<string>").alias("out"), F.lit(0).alias("blank"), F.lit(True).alias("open")).cast(kind)

    def step(acc: Column, ln: Column) -> Column:
        gap = ln["y0"] - F.try_element_at(acc["ys"], F.lit(-1))
        pitch = median_pitch(acc["ys"])
        far = (ln["y0"] - anchor_y > reach) | (pitch.isNotNull() & (gap > F.greatest(F.lit(floor), pitch * factor)))
        empty = ln["text"].isNull() | (F.trim(ln["text"]) == "")
        stop = far | (empty & (acc["blank"] >= blanks))
        live = acc["open"] & ~stop
        return F.struct(
            F.when(live, F.concat(acc["ys"], F.array(ln["y0"]))).otherwise(acc["ys"]).alias("ys"),
            F.when(live & ~empty, F.concat(acc["out"], F.array(ln["text"]))).otherwise(acc["out"]).alias("out"),
            F.when(empty, acc["blank"] + 1).otherwise(0).alias("blank"),
            live.alias("open"),
        ).cast(kind)

    return F.aggregate(F.filter(lines_, lambda x: x["y0"] > anchor_y), start, step, lambda acc: acc["out"])


def anchor_key(text: Column) -> Column:
    """A phrase as it is compared: without case, with single spaces, without a trailing colon."""
    return _folded(F.regexp_replace(text, r"\s+", " "))


def _folded(text: Column) -> Column:
    return let(F.lower(F.trim(text)), lambda t: F.when(t.contains(":"), F.regexp_replace(t, r"\s*:+$", "")).otherwise(t))


def anchor_runs(words: Column, longest: int) -> Column:
    """``array<struct(start, n, key)>``: all runs of at most ``longest`` words of a line, folded for comparison."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)))
    text = lambda s, n: F.array_join(F.transform(F.slice(words, s, n), lambda w: w["text"]), " ")
    run = lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - s + 1)), lambda n: F.struct(s.alias("start"), n.alias("n"), _folded(text(s, n)).alias("key")))
    return F.flatten(F.transform(starts, run))


def find_anchors(lines_: DataFrame, phrases: DataFrame, longest: int) -> DataFrame:
    """Anchor hits: contiguous word runs of a line equal to a phrase.

    Comparison ignores case and a trailing colon.  ``phrases(anchor_id, phrase)``
    is a dimension of declared anchors; runs are bounded by the longest phrase.
    """
    hits = lines_.where(F.size("words") > 0).select("document_id", "page_number", "line_idx", F.explode(anchor_runs(F.col("words"), longest)).alias("r"))
    hits = hits.select("document_id", "page_number", "line_idx", "r.start", "r.n", "r.key")
    found = hits.join(phrases.select("anchor_id", anchor_key(F.col("phrase")).alias("key")), "key")
    return found.groupBy("document_id", "page_number", "line_idx", "start", "anchor_id").agg(F.min("n").alias("n"))

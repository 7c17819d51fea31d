"""Selector execution: anchors, candidates, field capture, row groups and scan lines.

Selectors are data, compiled on the driver; pages are DataFrames of lines (see
:func:`geometry.lines`).  A field is found by three joins on the document: the
declared phrases against the lines, the chosen anchor against the lines of its
region, and the ranked candidates; nothing is looped over per document.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import patterns, values
from quillstone.operators import geometry
from quillstone.operators.score import MATCH_QUALITY

#: Labels of summary rows (fixed values).
ROLLUP = ("total", "subtotal", "sub total", "balance", "amount due", "grand total", "please pay")
#: Regions that need an anchor, and the one that does not narrow the search (fixed values).
ANCHORED, WIDE = ("same-row", "near-anchor", "line_items"), "any-page"
TABLE_GAP, TABLE_FLOOR, SCANLINE_DIGITS = 2.5, 24.0, 18


def anchor_hits(words: Column, selectors: Sequence[Mapping]) -> Column | None:
    """Hits of all declared phrases in a line: ``array<struct(sel, alt, start, n)>``; None if nothing is declared.

    As :func:`geometry.find_anchors`, inside the row: the shortest run from each start that equals a phrase.
    """
    said = [(i, k, p) for i, s in enumerate(selectors) for k, p in enumerate([s.get("anchor"), *s.get("anchor_alts", ())]) if p]
    if not said:
        return None
    named = lambda key: F.filter(F.array(*(F.struct(F.lit(i).alias("sel"), F.lit(k).alias("alt"), geometry.anchor_key(F.lit(p)).alias("key")) for i, k, p in said)), lambda q: q["key"] == key)
    runs = geometry.anchor_runs(words, max(len(p.split()) for _, _, p in said))
    hits = F.flatten(F.transform(runs, lambda r: F.transform(named(r["key"]), lambda q: F.struct(q["sel"].alias("sel"), q["alt"].alias("alt"), r["start"].alias("start"), r["n"].alias("n")))))
    shorter = lambda all_, h: F.exists(all_, lambda o: (o["sel"] == h["sel"]) & (o["alt"] == h["alt"]) & (o["start"] == h["start"]) & (o["n"] < h["n"]))
    return geometry.let(hits, lambda all_: F.filter(all_, lambda h: ~shorter(all_, h)))


def pick_anchors(lines: DataFrame, selectors: Sequence[Mapping]) -> DataFrame:
    """``(document_id, sel, alt, page_number, line_idx, start, n, hits)``: one anchor for each selector and document.

    The declared anchor, else its alternates in order; of the first phrase that
    occurs, the first or last hit (``anchor_occurrence``) in reading order.
    """
    hits = anchor_hits(F.col("words"), selectors)
    if hits is None:
        return lines.select("document_id", F.lit(0).alias("sel"), F.lit(0).alias("alt"), "page_number", "line_idx", F.lit(1).alias("start"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("hits")).limit(0)
    hits = lines.where(F.size("words") > 0).select("document_id", "page_number", "line_idx", F.explode(hits).alias("h")).select("document_id", "page_number", "line_idx", "h.*")
    last = F.col("sel").isin([i for i, s in enumerate(selectors) if s.get("anchor_occurrence") == "last"] or [-1])
    place = F.struct("page_number", "line_idx", "start", "n")
    found = hits.groupBy("document_id", "sel", "alt").agg(F.min(place).alias("first"), F.max(place).alias("final"), F.count("*").alias("hits"))
    best = found.groupBy("document_id", "sel").agg(F.min(F.struct("alt", F.when(last, F.col("final")).otherwise(F.col("first")).alias("at"), "hits")).alias("b"))
    return best.select("document_id", "sel", "b.alt", "b.at.*", "b.hits")


def candidates(words: Column) -> Column:
    """Texts to try in a line, in order: its cells, its words, the whole line; each once."""
    return F.array_distinct(F.concat(geometry.cells(words), F.transform(words, lambda w: w["text"]), F.array(geometry.line_text(words))))


def _parse(text: Column, pattern: str) -> Column:
    got = patterns.resolve(pattern)(text)
    return (got["iso"] if pattern == "date_loose" else got["normalized"] if pattern == "account_number" else got).cast("string")


def fields(lines: DataFrame, selectors: Sequence[Mapping]) -> DataFrame:
    """``(document_id, field, value, quality, modifiers)``: the first candidate that parses, in reading order.

    A selector has ``field, pattern, region`` and may have ``anchor, anchor_alts,
    anchor_occurrence, capture`` (``all_matches``: values joined by a line feed)
    and ``adjust``.  The anchor's own words are no candidates.
    """
    rows = lines.where("document_id is not null").select("document_id", "page_number", "line_idx", "y0", "words")
    whole = Window.partitionBy("document_id")
    hits = anchor_hits(F.col("words"), selectors)
    rows = rows.withColumn("hits", F.when(F.size("words") > 0, hits) if hits is not None else F.lit(None).cast("array<struct<sel:int,alt:int,start:int,n:int>>"))
    over = {"pages": F.max("page_number").over(whole), "bottom": F.max("y0").over(whole)}
    for i, s in enumerate(selectors):
        if s.get("anchor"):
            last = s.get("anchor_occurrence") == "last"  # the first phrase that occurs, then the first or last place
            mine = F.filter("hits", lambda h: h["sel"] == i)  # noqa: B023
            spots = F.transform(mine, lambda h: F.struct((-h["alt"] if last else h["alt"]).alias("rank"), F.col("page_number").alias("page"), F.col("line_idx").alias("line"), h["start"].alias("start"), h["n"].alias("n"), F.try_element_at("words", h["start"])["x0"].alias("x"), F.col("y0").alias("y")))  # noqa: B023
            over[f"at{i}"] = (F.max(F.array_max(spots)) if last else F.min(F.array_min(spots))).over(whole)
            if s.get("region", WIDE) == WIDE:
                count = lambda k: F.sum(F.size(F.filter(mine, lambda h: h["alt"] == k))).over(whole)  # noqa: B023, E731
                over[f"times{i}"] = F.array(*map(count, range(1 + len(s.get("anchor_alts", ())))))
    rows = rows.withColumns(over)
    left, alts = {}, {}
    for i, s in enumerate(selectors):
        region, anchor, at = s.get("region", WIDE), s.get("anchor"), F.col(f"at{i}")
        none = F.lit(None).cast("double")
        page = {
            "page": F.col("page_number"), "pages": F.col("pages"), "height": F.col("bottom") + 12.0, "width": F.lit(612.0), "detach_y": none, "totals_y": none,
            "anchor_x": at["x"] if anchor else none, "anchor_y": at["y"] if anchor else none, "pitch": none, "tolerance": F.lit(geometry.TOLERANCE),
        }
        inside = lambda w: F.coalesce(geometry.in_region(region, {"x0": w["x0"], "y0": F.col("y0")}, page), F.lit(False))  # noqa: B023, E731
        if not anchor:
            left[f"left{i}"] = F.filter("words", inside)
            continue
        own = (F.col("page_number") == at["page"]) & (F.col("line_idx") == at["line"])
        free = lambda k: ~F.coalesce(own & (k + 1 >= at["start"]) & (k + 1 < at["start"] + at["n"]), F.lit(False))  # noqa: B023, E731
        near = at.isNotNull() & (F.col("page_number") == at["page"]) if region in ANCHORED else at.isNotNull()
        left[f"left{i}"] = F.when(near, F.filter("words", lambda w, k: inside(w) & free(k)))  # noqa: B023
        alts[f"alt{i}"] = F.abs(at["rank"])
    rows = rows.withColumns(left).withColumns(alts)
    parse = lambda s: lambda t: _parse(t, s["pattern"])
    got = {f"got{i}": F.when(F.size(f"left{i}") > 0, F.try_element_at(F.filter(F.transform(candidates(F.col(f"left{i}")), parse(s)), lambda v: v.isNotNull()), F.lit(1))) for i, s in enumerate(selectors)}
    rows = rows.withColumns(got)
    values_of, out = [], []
    for i, s in enumerate(selectors):
        hit, v = F.col(f"got{i}").isNotNull(), F.col(f"got{i}")
        if s.get("capture") == "all_matches":
            values_of.append(F.sort_array(F.collect_list(F.when(hit, F.struct("page_number", "line_idx", v.alias("v"))))).alias(f"got{i}"))
            value = F.when(F.size(f"got{i}") > 0, F.array_join(F.transform(f"got{i}", lambda r: r["v"]), "\n"))
        else:
            values_of.append(F.min_by(v, F.when(hit, F.struct("page_number", "line_idx"))).alias(f"got{i}"))
            value = v
        alt, times = F.lit(None).cast("int"), F.lit(None).cast("long")
        if s.get("anchor"):
            values_of.append(F.max(f"alt{i}").alias(f"alt{i}"))  # the same in all rows of a document
            alt = F.col(f"alt{i}")
            if f"times{i}" in over:
                values_of.append(F.max(F.try_element_at(f"times{i}", alt + 1)).alias(f"times{i}"))
                times = F.col(f"times{i}")
        quality = F.when(alt > 0, MATCH_QUALITY["alternate"]).otherwise(MATCH_QUALITY["anchored"] if s.get("anchor") else MATCH_QUALITY["region"])
        marks = F.filter(F.array(F.when(alt > 0, "anchor_alt_used"), F.when(times > 1, "ambiguous_anchor")), lambda m: m.isNotNull())
        row = F.struct(F.lit(s["field"]).alias("field"), values.apply_ops(value, s.get("adjust", ())).alias("value"), quality.cast("decimal(4,2)").alias("quality"), marks.alias("modifiers"))
        out.append(F.when(value.isNotNull(), row))
    found = rows.groupBy("document_id").agg(*values_of)
    return found.select("document_id", F.explode(F.array_compact(F.array(*out))).alias("f")).select("document_id", "f.*")


def is_rollup(text: Column) -> Column:
    """Whether a line's normalised text begins with a summary label."""
    return values.normalize_name(text).rlike(f"^(?:{'|'.join(ROLLUP)})(?: |$)")


def column_bounds(header: Column, names: Sequence[str]) -> Column:
    """``array<struct(name, lo, hi)>`` from the header line's words: boundaries lie midway between neighbouring headers.

    ``names`` are single printed words in their order from left to right.
    """
    low = lambda t: F.regexp_replace(F.lower(t), ":+$", "")
    spot = lambda n: F.try_element_at(F.filter(header, lambda w: low(w["text"]) == n.lower()), F.lit(1))
    spots = F.array(*map(spot, names))
    edge = lambda i: (spots[i]["x1"] + spots[i + 1]["x0"]) / 2
    last = len(names) - 1
    return F.array(*(F.struct(F.lit(n).alias("name"), (edge(i - 1) if i else F.lit(float("-inf"))).alias("lo"), (edge(i) if i < last else F.lit(float("inf"))).alias("hi")) for i, n in enumerate(names)))


def row_groups(lines: DataFrame, group: Mapping) -> DataFrame:
    """``(document_id, row, cells)`` of a table; ``cells`` maps declared columns to parsed values.

    ``group`` has ``table_anchor`` (its first hit's line is the header),
    ``column_headers`` (column -> printed word) and ``columns`` (column ->
    pattern), and may have ``require_amount``, ``stop_at_subtotal`` and
    ``amount`` (the column whose running sum marks a subtotal).  The body ends
    at a summary label, at a gap above ``max(24, 2.5 x median pitch so far)``, or
    at a subtotal: an amount equal to the sum of at least two rows before.
    """
    printed = list(group["column_headers"].values())
    rows = lines.where("document_id is not null").select("document_id", "page_number", "line_idx", "y0", "text", "words")
    hit = F.size("words") > 0, F.size(anchor_hits(F.col("words"), [{"anchor": group["table_anchor"]}])) > 0
    head = F.when(hit[0] & hit[1], F.struct("page_number", F.col("line_idx").alias("top"), F.col("y0").alias("head_y"), column_bounds(F.col("words"), printed).alias("bounds")))
    body = Window.partitionBy("document_id").orderBy("line_idx")
    whole = body.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("head", head).withColumn("head", F.min("head").over(whole))
    below = rows.where((F.col("page_number") == F.col("head.page_number")) & (F.col("line_idx") > F.col("head.top"))).select("*", "head.head_y", "head.bounds").drop("head")
    so_far = F.collect_list("y0").over(body.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("y0") - F.coalesce(F.lag("y0").over(body), F.col("head_y"))
    below = below.withColumns({"rollup": is_rollup(F.col("text")), "so_far": so_far, "gap": gap})
    # null below two lines: then nothing is far
    far = (F.col("gap") > TABLE_FLOOR) & (F.col("gap") > geometry.median_pitch(F.concat(F.array("head_y"), F.col("so_far"))) * TABLE_GAP)
    below = below.withColumn("stop", F.max((F.col("rollup") | F.coalesce(far, F.lit(False))).cast("int")).over(body)).where("stop = 0")
    middle = lambda w: (w["x0"] + w["x1"]) / 2
    inside = lambda b: F.array_join(F.transform(F.filter("words", lambda w: (middle(w) >= b["lo"]) & (middle(w) < b["hi"])), lambda w: w["text"]), " ")
    by_name = F.map_from_entries(F.transform("bounds", lambda b: F.struct(b["name"].alias("key"), inside(b).alias("value"))))
    below = below.select("document_id", "line_idx", F.explode(F.array(by_name)).alias("raw"))  # filters above an explode do not repeat what is below
    text = lambda c: F.try_element_at("raw", F.lit(group["column_headers"][c]))
    parsed = F.struct(*(_parse(F.when(text(c) != "", text(c)), p).alias(f"c{i}") for i, (c, p) in enumerate(group["columns"].items())))
    rows = below.select("document_id", "line_idx", F.explode(F.array(parsed)).alias("v"))
    value = {c: F.col(f"v.c{i}") for i, c in enumerate(group["columns"])}
    rows = rows.where(reduce(or_, [v.isNotNull() for v in value.values()]))
    money = [c for c, p in group["columns"].items() if p in ("currency", "currency_signed")]
    if group.get("require_amount") and money:
        rows = rows.where(reduce(or_, [value[c].isNotNull() for c in money]))
    cells = F.map_filter(F.create_map(*(x for c, v in value.items() for x in (F.lit(c), v))), lambda k, v: v.isNotNull())
    rows = rows.select("document_id", "line_idx", cells.alias("cells"))
    if group.get("stop_at_subtotal"):
        from quillstone.operators import analytics

        rows = rows.withColumn("q", F.try_element_at("cells", F.lit(group["amount"])).try_cast("decimal(18,4)"))
        rows = analytics.subtotal_stop(rows, "document_id", ["line_idx"], "q")
    return rows.select("document_id", (F.row_number().over(Window.partitionBy("document_id").orderBy("line_idx"))).alias("row"), "cells")


def scanline(lines: DataFrame) -> DataFrame:
    """``(document_id, scanline)``: the digit words of the first line that has one of at least 18 digits."""
    digits = F.filter("words", lambda w: w["text"].rlike("^[0-9]+$"))
    run = lines.select("document_id", "page_number", "line_idx", digits.alias("ds")).where(F.exists("ds", lambda w: F.length(w["text"]) >= SCANLINE_DIGITS))
    return run.groupBy("document_id").agg(F.min_by(geometry.line_text(F.col("ds")), F.struct("page_number", "line_idx")).alias("scanline"))

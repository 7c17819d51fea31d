"""Packs as boolean Columns: claims, signals, condition ladders, tags, page roles.

A pack is data.  It is compiled on the driver, once, into Column expressions
over scope texts and line arrays; evaluating it is a projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.values import normalize_name


class PackError(ValueError):
    """A pack that does not compile."""


def _any(cs: Sequence[Column]) -> Column:
    return reduce(or_, cs, F.lit(False))


# ---------------------------------------------------------------- claims


def markers(scope: Column, names: Sequence[str]) -> Column:
    """Any normalised marker is a substring of the normalised scope text."""
    text = normalize_name(scope)
    return _any([text.contains(normalize_name(F.lit(m))) for m in names])


def corroborated_markers(scope: Column, names: Sequence[str], required: Sequence[str]) -> Column:
    return markers(scope, names) & markers(scope, required)


def roster_on_short_line(lines: Column, roster: Sequence[str], most_words: int) -> Column:
    """A roster name on a line of at most ``most_words`` words; ``lines`` is an array of texts."""
    short = F.filter(lines, lambda x: F.size(F.split(F.trim(x), r"\s+")) <= most_words)
    return F.exists(short, lambda x: _any([normalize_name(x).contains(normalize_name(F.lit(r))) for r in roster]))


def every_marker_hit_in_block(lines: Column, names: Sequence[str], block: str) -> Column:
    """There is a marker line, and every marker line matches ``block`` (a veto)."""
    hits = F.filter(lines, lambda x: _any([normalize_name(x).contains(normalize_name(F.lit(m))) for m in names]))
    return (F.size(hits) > 0) & F.forall(hits, lambda x: x.rlike(block))


def claim(rules: Sequence[Column], vetoes: Sequence[Column] = ()) -> Column:
    return _any(rules) & ~_any(vetoes)


def resolve_pack(claims: Mapping[str, Column]) -> Column:
    """Name of the first pack, in declared order, that claims the document."""
    return F.coalesce(*(F.when(c, F.lit(n)) for n, c in claims.items()), F.lit(None).cast("string"))


# ---------------------------------------------------------------- signals


def pattern_in_scope(scope: Column, pattern: str) -> Column:
    return scope.rlike(pattern)


def _words(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


def short_label_line(lines: Column, pattern: str, most_words: int) -> Column:
    return F.exists(lines, lambda x: (F.size(_words(x)) <= most_words) & x.rlike(pattern))


def title_near_top(lines: Column, pattern: str, first: int, most_words: int) -> Column:
    return short_label_line(F.slice(lines, 1, first), pattern, most_words)


def text_near_top(lines: Column, pattern: str, first: int) -> Column:
    return F.exists(F.slice(lines, 1, first), lambda x: x.rlike(pattern))


def label_with_corroborating_value(lines: Column, label: str, value: str) -> Column:
    """A label line whose own rest or next line matches ``value``."""
    return F.exists(F.transform(lines, lambda x, i: x.rlike(label) & (x.rlike(value) | F.coalesce(F.get(lines, i + 1).rlike(value), F.lit(False)))), lambda b: b)


def all_matches_negative(scope: Column, pattern: str) -> Column:
    """The pattern's sign group occurs, and is ``-`` each time."""
    signs = F.regexp_extract_all(scope, F.lit(pattern), F.lit(1))
    return (F.size(signs) > 0) & F.forall(signs, lambda s: s == "-")


def money_table_present(lines: Column, least: int = 3) -> Column:
    """A line with at least ``least`` words of digits and commas with two decimals."""
    return F.exists(lines, lambda x: F.size(F.filter(_words(x), lambda w: w.rlike("^[0-9,]+[.][0-9]{2}$"))) >= least)


def text_source_is(source: Column, kind: str) -> Column:
    return source == kind


#: Characters of printed words beside letters, digits and the underscore (fixed value).
PRINTED = "-.,/$#&()'"


def odd_word(w: Column) -> Column:
    """At most two characters, letters without a vowel of the basic alphabet, or a character that print rarely has."""
    return (F.length(w) <= 2) | (w.rlike(r"^\p{L}+$") & ~w.rlike("[aeiouAEIOU]")) | w.rlike(rf"[^\p{{L}}\p{{N}}_{PRINTED[1:]}-]")


def noise_ratio(text: Column) -> Column:
    """Share of odd words."""
    tokens = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    odd = F.size(F.filter(tokens, odd_word))
    return F.when(F.size(tokens) > 0, odd / F.size(tokens)).otherwise(F.lit(0.0))


def noise_ratio_above(pages: DataFrame, threshold: float, role: str = "supporting", ocr_only: bool = True) -> DataFrame:
    """``(document_id, noisy)``: a page of the role reads as handwriting; ``pages`` has text, role and text_source.

    ``supporting`` takes every page that is not primary.
    """
    wanted = F.col("role") != "primary" if role == "supporting" else F.col("role") == role
    seen = (F.col("text_source") == "ocr") if ocr_only else F.lit(True)
    return pages.groupBy("document_id").agg(F.coalesce(F.bool_or(seen & wanted & (noise_ratio(F.col("text")) >= threshold)), F.lit(False)).alias("noisy"))


def distinct_aliases(scope: Column, aliases: Sequence[str]) -> Column:
    """How many alias keys, as written, the scope contains."""
    return reduce(lambda a, b: a + b, [scope.contains(a).cast("int") for a in aliases], F.lit(0))


def value_tokens(scope: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(scope, F.lit(pattern), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))


def middle_tokens_nonzero(tokens: Column) -> Column:
    return (F.size(tokens) > 2) & F.exists(F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0))), lambda x: x != 0)


def second_to_last_token_nonzero(tokens: Column) -> Column:
    """The token before the last, or the only one, is not zero."""
    return F.coalesce(F.try_element_at(tokens, F.greatest(F.size(tokens) - 1, F.lit(1))) != 0, F.lit(False))


def money_after_label_nonzero(scope: Column, label: str) -> Column:
    got = F.regexp_extract(scope, label + r"[ :$]*(-?[0-9,]*[.][0-9]{2})", 1)
    return F.coalesce(F.regexp_replace(got, ",", "").try_cast("double") != 0, F.lit(False))


# ---------------------------------------------------------------- ladders and tags


def compile_condition(spec: Mapping, signals: Mapping[str, Column]) -> Column:
    """A condition tree (``signal``, ``all_of``, ``any_of``, ``not``) as a Column."""
    if len(spec) != 1:
        raise PackError("a condition has exactly one key")
    ((kind, body),) = spec.items()
    if kind == "signal":
        if body not in signals:
            raise PackError(f"unknown signal {body!r}")
        return F.coalesce(signals[body], F.lit(False))
    if kind == "not":
        return ~compile_condition(body, signals)
    if kind in ("all_of", "any_of"):
        if not body:
            raise PackError(f"{kind} is empty")
        return reduce(and_ if kind == "all_of" else or_, [compile_condition(b, signals) for b in body])
    raise PackError(f"unknown condition {kind!r}")


def ladder(rungs: Sequence[Mapping], default: str, signals: Mapping[str, Column]) -> Column:
    """``struct(doc_type, rung, confidence)`` of the first true rung, or the default."""
    kind = lambda t, r, c: F.struct(F.lit(t).alias("doc_type"), F.lit(r).alias("rung"), F.lit(c).alias("confidence"))
    names = [r["name"] for r in rungs]
    if "default" in names or len(set(names)) != len(names):
        raise PackError("rung names are distinct, and none is 'default'")
    chain = None
    for r in rungs:
        cond = compile_condition(r["when"], signals)
        out = kind(r["doc_type"], r["name"], 0.95)
        chain = F.when(cond, out) if chain is None else chain.when(cond, out)
    fallback = kind(default, "default", 0.80)
    return fallback if chain is None else chain.otherwise(fallback)


def tags(rules: Sequence[Mapping], signals: Mapping[str, Column]) -> Column:
    """All true tags, in declared order."""
    found = F.array(*(F.when(compile_condition(r["when"], signals), F.lit(r["tag"])) for r in rules))
    return F.filter(found, lambda x: x.isNotNull())


# ---------------------------------------------------------------- pages


def page_roles(pages: DataFrame) -> DataFrame:
    """Add ``role`` and ``fallback`` to ``pages(document_id, page_number, words, identity, totals, footer_ok)``.

    Primary pages show an identity label and a totals label.  If a document has
    none: its first page with totals; else all pages, if they share a footer;
    else page 1.
    """
    doc = Window.partitionBy("document_id")
    direct = F.col("identity") & F.col("totals")
    p = pages.withColumn("_any", F.max(direct).over(doc)).withColumn("_first", F.min(F.when(F.col("totals"), F.col("page_number"))).over(doc))
    primary = (
        F.when(F.col("_any"), direct).when(F.col("_first").isNotNull(), F.col("page_number") == F.col("_first")).when(F.col("footer_ok"), F.lit(True)).otherwise(F.col("page_number") == 1)
    )
    role = F.when(primary, "primary").when(F.col("words") == 0, "unknown").otherwise("supporting")
    return p.withColumn("role", role).withColumn("fallback", ~F.col("_any") & F.col("_first").isNull()).drop("_any", "_first")


def shared_footer(pages: DataFrame) -> DataFrame:
    """``(document_id, footer_ok)``: every page prints ``N of M``, M is the page count, the N are 1 to M, at least two pages.

    ``pages`` has the document's text lines joined by line feeds in ``text``.  The
    first such pair of a line counts, in any case, and of a page's lines the first
    whose M is the page count.
    """
    form = r"\b([0-9]+)\s+OF\s+([0-9]+)\b"
    pair = lambda x: F.struct(F.regexp_extract(F.upper(x), form, 1).try_cast("int").alias("n"), F.regexp_extract(F.upper(x), form, 2).try_cast("int").alias("m"))
    per = pages.select("document_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), pair).alias("pairs"))
    # pages of a document are few; the pairs that can count have M equal to their number
    per = per.withColumn("k", F.count("*").over(Window.partitionBy("document_id")))
    n = F.try_element_at(F.filter("pairs", lambda e: e.m == F.col("k")), F.lit(1))["n"]
    g = per.withColumn("n", n).groupBy("document_id").agg(F.max("k").alias("k"), F.count("n").alias("seen"), F.count_distinct("n").alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    ok = (F.col("k") >= 2) & (F.col("seen") == F.col("k")) & (F.col("d") == F.col("k")) & (F.col("lo") == 1) & (F.col("hi") == F.col("k"))
    return g.select("document_id", F.coalesce(ok, F.lit(False)).alias("footer_ok"))

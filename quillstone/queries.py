"""Registered queries of the document-intelligence operators, with their DuckDB SQL.

Each entry is ``name: (function(spark, sf_dir), sql or None)``; all run over
whole tables.  Where the driver's tables hold no invoices, orders, lines and
events stand in for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import patterns, values
from quillstone.operators import analytics, classify, derive, executor, geometry, record, score
from quillstone.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}
MONEY = "decimal(18,2)"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {n: f for n, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _QUERIES.items() if s}


# ---------------------------------------------------------------- text, patterns, values

SPLIT = r"[ \t\n\x0B\f\r]+"
TOKENS_SQL = r"SELECT doc_id, t FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+')) AS t FROM documents) WHERE t <> ''"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.explode(F.split("text", SPLIT)).alias("t")).where("t <> ''")


LINES_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS n FROM l)
SELECT doc_id, count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS n_words, CAST(max(n) AS BIGINT) AS longest, count_if(n = 0) AS blank FROM w GROUP BY doc_id
"""


@query("text_lines", LINES_SQL)
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.text_rows(F.col("text"))
    r = _t(spark, d, "documents").where("text is not null").select("doc_id", F.transform(rows, lambda x: F.size(x)).alias("n"))
    return r.select(
        "doc_id", F.size("n").cast("long").alias("n_lines"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_words"), F.array_max("n").cast("long").alias("longest"),
        F.size(F.filter("n", lambda x: x == 0)).cast("long").alias("blank"),
    )


def _money_rest(t: str) -> str:
    """What is left of a money notation without its marks, in SQL: written from the notation, not from the parser's code."""
    right = rf"regexp_replace(trim({t}), '\)? *(/[A-Za-z]{{1,4}})? *(USD|CAD|EUR|GBP)? *(cr|CR)?$', '')"
    return rf"regexp_replace(trim({right}), '^\(? *-? *[$€£]? *-? *', '')"


def _is_money_sql(t: str) -> str:
    return f"regexp_full_match(trim({_money_rest(t)}), '([0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]*)[.][0-9]{{1,4}}')"


def _negative_sql(t: str) -> str:
    return rf"(regexp_matches(trim({t}), '^\(? *-|^\(? *[$€£] *-|(cr|CR)$') OR (starts_with(trim({t}), '(') AND contains({t}, ')')))"


def _odd_sql(w: str) -> str:
    """A word of the noise ratio: fragment, no vowel, or a character outside letters, digits and . , / $ # & ( ) ' -"""
    return rf"(length({w}) <= 2 OR (regexp_full_match({w}, '\p{{L}}+') AND NOT regexp_matches({w}, '[aeiouAEIOU]')) OR regexp_matches({w}, '[^\p{{L}}\p{{N}}_.,/$#&()''-]'))"


TABLE_WORD = "regexp_full_match(w, '[0-9,]+[.][0-9]{2}')"
TRIAGE_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM l),
c AS (SELECT doc_id, len(ws) AS n, len(list_filter(ws, lambda x: {_is_money_sql('x')})) AS m,
        len(list_filter(ws, lambda x: {_odd_sql('x')})) AS odd FROM w),
g AS (SELECT doc_id, count(*) AS n_lines, CAST(sum(m) AS BIGINT) AS n_money, max(m) >= 3 AS tab, sum(odd) / greatest(sum(n), 1) AS noise FROM c GROUP BY doc_id)
SELECT doc_id, n_lines, n_money,
  CASE WHEN tab THEN 'itemised_invoice' WHEN n_money > 0 THEN 'summary_invoice' WHEN noise >= 0.4 THEN 'unreadable' ELSE 'standard_invoice' END AS doc_type,
  CASE WHEN tab THEN 'money_table' WHEN n_money > 0 THEN 'any_money' WHEN noise >= 0.4 THEN 'noise' ELSE 'default' END AS signal,
  CASE WHEN tab OR n_money > 0 OR noise >= 0.4 THEN 'high' ELSE 'medium' END AS lane FROM g
"""


@query("document_triage", TRIAGE_SQL)
def document_triage(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").where("text is not null").withColumn("lines", F.split("text", "\n"))
    money = F.transform("lines", lambda x: F.size(F.filter(F.split(x, SPLIT), lambda w: patterns.is_money(w))))
    docs = docs.withColumn("m", money).withColumn("noise", classify.noise_ratio(F.col("text")))
    docs = docs.withColumn("n_money", F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x))
    signals = {"money_table": F.array_max("m") >= 3, "any_money": F.col("n_money") > 0, "noise": F.col("noise") >= 0.4}
    rungs = [
        {"name": "money_table", "doc_type": "itemised_invoice", "when": {"signal": "money_table"}},
        {"name": "any_money", "doc_type": "summary_invoice", "when": {"all_of": [{"signal": "any_money"}, {"not": {"signal": "money_table"}}]}},
        {"name": "noise", "doc_type": "unreadable", "when": {"signal": "noise"}},
    ]
    docs = docs.withColumn("k", classify.ladder(rungs, "standard_invoice", signals))
    lane = score.lane(F.create_map(F.lit("doc_type"), F.col("k.confidence")), F.create_map().cast("map<string,double>"))
    return docs.select("doc_id", F.size("lines").cast("long").alias("n_lines"), "n_money", F.col("k.doc_type").alias("doc_type"), F.col("k.rung").alias("signal"), lane.alias("lane"))


@query("noise_ratio", rf"""
WITH t AS ({TOKENS_SQL}) SELECT doc_id, round(sum(CASE WHEN {_odd_sql('t')} THEN 1 ELSE 0 END) / count(*), 6) AS noise FROM t GROUP BY doc_id
""")
def noise_ratio(spark: SparkSession, d: str) -> DataFrame:
    n = classify.noise_ratio(F.col("text"))
    return _t(spark, d, "documents").where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]")).select("doc_id", F.round(n, 6).alias("noise"))


#: Notations that the corpus lacks, added to every pattern query (invented values).
NOTATIONS = (
    "1,234.50", "(12.00)", "-40.500", "$-3.25", "-$3.25", "12.00cr", "7.00CR", "12", ".25", "1,23.00", "9.99/MO", "5.00 USD", "(5.00", "+6.10", "1,000", "-17", "0.5", "3.14159",
    "3/4/24", "12/31/2023", "2/30/2024", "January 5, 2024", "Feb 9, 2024", "2024-01-05", "AB 12-34", "A", "-AB", "555-234-5678", "(416) 555-2345", "1-212-555-0100", "12345", "12345-6789",
    "K1A 0B1", "k1a0b1", "123456789rt0001", "123456789 RT 0001", "1234567890", "12 34 56 78 90 12", "€5.10", "", "416-123-4567", "14165550100", "1 (416)555.0100", "7.00Cr", "9.99/MONTH", "( $ - 4.00 )", "$ 3.00 / ST", "1.00 cr.",
    "Janitor 5, 2024", "Marching 3, 2024", "Feb 9 2024", "Sept 9, 2024", "feb 30, 2024", "Sep. 9, 2024", "MAY 1, 2024", "CKT-12345", "Quote # 2494434",
)
VALUES_SQL = ", ".join("('" + n.replace("'", "''") + "')" for n in NOTATIONS)
MIXED_SQL = f"SELECT t FROM (VALUES {VALUES_SQL}) AS v(t) UNION ALL SELECT t FROM ({TOKENS_SQL})"


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in NOTATIONS], "t string").unionByName(_tokens(spark, d).select("t"))


def _pattern(name: str, value: Callable[[Column], Column], sql: str) -> None:
    """Distinct parsed values with their numbers of occurrences."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _mixed(spark, d).select(value(F.col("t")).cast("string").alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))

    _QUERIES[f"pattern_{name}"] = (run, f"WITH s AS ({MIXED_SQL}), p AS (SELECT {sql} AS value FROM s) SELECT value, count(*) AS n FROM p WHERE value IS NOT NULL GROUP BY value")


_DIGITS = f"replace(trim({_money_rest('t')}), ',', '')"
_AMOUNT = f"CASE WHEN {_is_money_sql('t')} THEN try_cast({_DIGITS} AS DECIMAL(18,4)) * CASE WHEN {_negative_sql('t')} THEN -1 ELSE 1 END END"
_pattern("currency", lambda c: patterns.currency(c).cast("decimal(18,4)"), f"CAST(CAST({_AMOUNT} AS DECIMAL(18,4)) AS VARCHAR)")
_pattern(
    "currency_text", patterns.money_text,
    f"CASE WHEN {_is_money_sql('t')} THEN CASE WHEN {_negative_sql('t')} THEN '-' ELSE '' END || CASE WHEN starts_with({_DIGITS}, '.') THEN '0' ELSE '' END || {_DIGITS} END",
)
_pattern("integer", patterns.integer, "CASE WHEN regexp_full_match(trim(t), '[0-9]+|[0-9]{1,3}(,[0-9]{3})+') THEN CAST(try_cast(replace(trim(t), ',', '') AS BIGINT) AS VARCHAR) END")
_pattern("decimal", lambda c: patterns.decimal(c).cast("decimal(30,6)"), f"CASE WHEN regexp_matches(trim(t), '{patterns.DECIMAL}') THEN CAST(CAST(replace(trim(t), ',', '') AS DECIMAL(30,6)) AS VARCHAR) END")
_pattern("account", lambda c: patterns.account_number(c)["normalized"], f"CASE WHEN regexp_matches(trim(t), '{patterns.ACCOUNT}') THEN regexp_replace(trim(t), '[ -]', '', 'g') END")
_pattern("phone", patterns.phone, r"CASE WHEN regexp_full_match(trim(t), '(1[-. ])?([(][0-9]{3}[)]|[0-9]{3})[-. ]?[0-9]{3}[-. ]?[0-9]{4}') THEN trim(t) END")
_pattern(
    "postal", patterns.postal_code,
    f"CASE WHEN regexp_matches(trim(t), '{patterns.POSTAL_US}') THEN trim(t) WHEN regexp_matches(trim(t), '{patterns.POSTAL_CA}') "
    f"THEN upper(regexp_extract(trim(t), '{patterns.POSTAL_CA}', 1) || ' ' || regexp_extract(trim(t), '{patterns.POSTAL_CA}', 2)) END",
)
_MONTH = "['january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december']"
_NAME = "lower(regexp_extract(trim(t), '^([A-Za-z]{3,9}) +([0-9]{1,2}),? +([0-9]{4})$', 1))"
_LONG = "regexp_extract(trim(t), '^([A-Za-z]{3,9}) +([0-9]{1,2}),? +([0-9]{4})$', "
_pattern(
    "date", patterns.date,
    f"""strftime(CASE WHEN regexp_full_match(trim(t), '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') THEN try_strptime(trim(t), '%m/%d/%Y')
    WHEN regexp_full_match(trim(t), '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2}}') THEN try_strptime(regexp_replace(trim(t), '/([0-9]+)$', '/20\\1'), '%m/%d/%Y')
    WHEN {_NAME} <> '' AND len(list_filter({_MONTH}, lambda m: m = {_NAME} OR m[1:3] = {_NAME} OR ({_NAME} = 'sept' AND m = 'september'))) = 1
      THEN try_strptime({_NAME}[1:3] || ' ' || {_LONG}2) || ' ' || {_LONG}3), '%b %d %Y') END, '%Y-%m-%d')""",
)
_pattern("tax_id", patterns.tax_id, f"CASE WHEN regexp_matches(replace(trim(t), ' ', ''), '{patterns.TAX_ID}') THEN upper(replace(trim(t), ' ', '')) END")
_pattern("digits_run", patterns.digits_run, "CASE WHEN regexp_matches(replace(trim(t), ' ', ''), '^[0-9]{10,}$') THEN replace(trim(t), ' ', '') END")


@query("value_ops", r"""
SELECT p_partkey, regexp_replace(p_name, '\s+', '', 'g') AS stripped, trim(regexp_replace(p_name, '\s+', ' ', 'g')) AS collapsed, upper(p_type) AS up, lower(p_brand) AS low,
  '-' || CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS parens, '-' || CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS credit,
  p_brand || ', ' || p_type AS joined, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS bare FROM part
""")
def value_ops(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("p_retailprice").cast(MONEY).cast("string")
    op = values.apply_ops
    return _t(spark, d, "part").select(
        "p_partkey", op(F.col("p_name"), ["strip_internal_whitespace"]).alias("stripped"), op(F.col("p_name"), ["collapse_internal_spaces"]).alias("collapsed"),
        op(F.col("p_type"), ["uppercase"]).alias("up"), op(F.col("p_brand"), ["trim", "lowercase"]).alias("low"),
        op(F.concat(F.lit("("), price, F.lit(")")), ["parens_to_negative"]).alias("parens"), op(F.concat(price, F.lit("cr")), ["trailing_cr_to_negative"]).alias("credit"),
        op(F.concat(F.col("p_brand"), F.lit("\n \n"), F.col("p_type")), ["join_lines_comma"]).alias("joined"), op(F.concat(F.lit("$ "), price), ["strip_currency_symbols"]).alias("bare"),
    )


@query("normalize_name", "SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS name FROM supplier")
def normalize_name(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "supplier").select("s_suppkey", values.normalize_name(F.col("s_name")).alias("name"))


LABELS = ("", "Account No. ", "acct: ", "CKT-", "Circuit# ", "circuit ", "Quote # ", "Contract #: ", "Quoted ")


@query("account_key", f"""
WITH l AS (SELECT * FROM (VALUES {", ".join(f"('{x}')" for x in LABELS)}) AS l(label))
SELECT c_custkey, label, nullif(upper(regexp_replace(CASE WHEN label = 'Quoted ' THEN 'd' ELSE '' END || c_name, '[^A-Za-z0-9]', '', 'g')), '') AS key FROM customer, l
""")
def account_key(spark: SparkSession, d: str) -> DataFrame:
    labels = F.explode(F.array(*map(F.lit, LABELS))).alias("label")
    return _t(spark, d, "customer").select("c_custkey", "c_name", labels).select("c_custkey", "label", values.account_key(F.concat("label", "c_name")).alias("key"))


@query("formula_escape", """
WITH v AS (SELECT * FROM (VALUES ('=A1'), ('+5'), ('-5.2'), ('-x'), ('@me'), ('plain'), ('+1_0'), ('-inf'), ('-')) AS v(t)) SELECT t AS raw,
  CASE WHEN t IN ('=A1', '-x', '@me', '-') THEN '''' || t ELSE t END AS escaped FROM v
""")
def formula_escape(spark: SparkSession, d: str) -> DataFrame:
    v = spark.createDataFrame([(x,) for x in ("=A1", "+5", "-5.2", "-x", "@me", "plain", "+1_0", "-inf", "-")], "t string")
    return v.select(F.col("t").alias("raw"), values.escape_formula(F.col("t")).alias("escaped"))


HTML_CHAIN = [
    (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "''"), (r"(?s)<!--.*?-->", "''"),
    (r"(?i)</?(p|div|br|tr|table|ul|ol|li|h[1-6]|section|article|nav|header|footer|title|body|html|head)[^>]*>", "chr(10)"), (r"(?i)</?(td|th)[^>]*>", "' '"), (r"<[^>]*>", "''"),
]
_HTML = "html"
for _p, _r in HTML_CHAIN:
    _HTML = f"regexp_replace({_HTML}, '{_p}', {_r}, 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_a}', '{_b}')"


@query("html_rows", rf"""
WITH l AS (SELECT page_id, unnest(string_split({_HTML}, chr(10))) AS line FROM pages),
w AS (SELECT page_id, list_filter(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM l)
SELECT page_id, count(*) AS n_rows, CAST(sum(len(ws)) AS BIGINT) AS n_words FROM w WHERE len(ws) > 0 GROUP BY page_id
""")
def html_rows(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "pages").select("page_id", readers.html_rows(F.col("html")).alias("r")).where("size(r) > 0")
    return r.select("page_id", F.size("r").cast("long").alias("n_rows"), F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + F.size(x)).alias("n_words"))


# ---------------------------------------------------------------- geometry

@query("grid_words", rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS row FROM documents),
w AS (SELECT doc_id, row, list_filter(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM l)
SELECT doc_id, CAST(sum(len(ws)) AS BIGINT) AS n, max(CASE WHEN len(ws) > 0 THEN (list_sum(list_transform(ws, lambda x: length(x))) + len(ws) - 1) * 6.0 END) AS right_edge,
  max(CASE WHEN len(ws) > 0 THEN row * 12.0 END) AS bottom FROM w GROUP BY doc_id HAVING sum(len(ws)) > 0
""")
def grid_words(spark: SparkSession, d: str) -> DataFrame:
    """Positioned words on the synthetic grid: number, right edge and lowest baseline of each document."""
    lines = _t(spark, d, "documents").select("doc_id", F.posexplode(readers.text_rows(F.col("text"))).alias("row", "ws")).where("size(ws) > 0")
    length = F.aggregate("ws", F.lit(0), lambda a, w: a + F.length(w)) + F.size("ws") - 1
    return lines.groupBy("doc_id").agg(F.sum(F.size("ws")).alias("n"), F.max(length * readers.CHAR_WIDTH).alias("right_edge"), F.max(F.col("row") * readers.ROW_HEIGHT).alias("bottom"))


@query("region_boxes", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS row FROM documents),
p AS (SELECT doc_id, (max(row) + 1) * 12.0 AS height FROM l GROUP BY doc_id),
w AS (SELECT l.doc_id, row * 12.0 AS y0, height, len(list_filter(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS n FROM l JOIN p USING (doc_id))
SELECT doc_id, CAST(sum(CASE WHEN y0 <= height * 0.25 THEN n ELSE 0 END) AS BIGINT) AS header_words,
  CAST(sum(CASE WHEN y0 >= height * 0.7 THEN n ELSE 0 END) AS BIGINT) AS remittance_words, CAST(sum(CASE WHEN y0 >= height * 0.6 THEN n ELSE 0 END) AS BIGINT) AS totals_words FROM w GROUP BY doc_id
""")
def region_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Words in the header, remittance and totals regions of each document's single page."""
    rows = readers.text_rows(F.col("text"))
    w = _t(spark, d, "documents").where("text is not null").select("doc_id", F.size(rows).alias("k"), F.posexplode(rows).alias("row", "ws"))
    none = F.lit(None).cast("double")
    page = {"page": F.lit(1), "pages": F.lit(1), "height": F.col("k") * readers.ROW_HEIGHT, "width": F.lit(612.0), "detach_y": none, "totals_y": none, "anchor_x": none, "anchor_y": none}
    word = {"y0": F.col("row") * readers.ROW_HEIGHT, "x0": F.lit(0.0)}
    count = lambda name: F.sum(F.when(geometry.in_region(name, word, page), F.size("ws")).otherwise(0))
    return w.groupBy("doc_id").agg(count("header-block").alias("header_words"), count("remittance-block").alias("remittance_words"), count("totals-block").alias("totals_words"))


@query("anchor_occurrence", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS row FROM documents),
w AS (SELECT doc_id, row, list_filter(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM l),
s AS (SELECT doc_id, row, unnest(range(1, len(ws) + 1)) AS start, ws FROM w),
h AS (SELECT doc_id, row, start FROM s WHERE lower(ws[start]) || ' ' || lower(ws[start + 1]) IN ('of the', 'que la'))
SELECT doc_id, count(*) AS hits, CAST(min(row * 100000 + start) AS BIGINT) AS first_hit, CAST(max(row * 100000 + start) AS BIGINT) AS last_hit FROM h GROUP BY doc_id
""")
def anchor_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """First and last anchor hit of each document, in reading order."""
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.posexplode(readers.text_rows(F.col("text"))).alias("line_idx", "ws"))
    lines = rows.select("document_id", "page_number", "line_idx", F.transform("ws", lambda w: F.struct(w.alias("text"))).alias("words"))
    phrases = spark.createDataFrame([("en", "of the"), ("es", "que la")], "anchor_id string, phrase string")
    hits = geometry.find_anchors(lines, phrases, 2)
    order = F.col("line_idx").cast("long") * 100_000 + F.col("start")
    return hits.groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("hits"), F.min(order).alias("first_hit"), F.max(order).alias("last_hit"))


@query("row_group_subtotal_stop", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DECIMAL(18,2)) AS q,
  sum(CAST(l_quantity AS DECIMAL(18,2))) OVER w AS s, count(*) OVER w AS n FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, max(CASE WHEN n >= 2 AND s <> 0 AND q = s THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, q ROWS UNBOUNDED PRECEDING) AS stopped FROM r)
SELECT l_orderkey, count(*) AS n_rows, CAST(sum(q) AS VARCHAR) AS total FROM f WHERE stopped = 0 GROUP BY l_orderkey
""")
def row_group_subtotal_stop(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast(MONEY).alias("q"))
    kept = analytics.subtotal_stop(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "q"], "q")
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("n_rows"), F.sum("q").cast("string").alias("total"))


# ---------------------------------------------------------------- packs


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").where("text is not null").select("doc_id", "text", "lang", "source", F.split("text", "\n").alias("lines"))


_NORM = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
CLAIM_SQL = f"""
WITH n AS (SELECT doc_id, {_NORM} AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, contains(t, 'mit license') OR contains(t, 'all rights reserved') AS licence, contains(t, 'license') AND contains(t, 'released') AS corroborated,
  CASE WHEN contains(t, 'mit license') OR contains(t, 'all rights reserved') THEN 'licensed' WHEN contains(t, ' of the ') THEN 'english' END AS pack FROM n
"""


@query("claim_documents", CLAIM_SQL)
def claim_documents(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    licence = classify.claim([classify.markers(c, ["MIT License", "All rights reserved"])])
    english = F.contains(values.normalize_name(c), F.lit(" of the "))
    return _lines(spark, d).select(
        "doc_id", licence.alias("licence"), classify.corroborated_markers(c, ["license"], ["released"]).alias("corroborated"), classify.resolve_pack({"licensed": licence, "english": english}).alias("pack")
    )


@query("claim_veto", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
m AS (SELECT doc_id, line, contains(trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')), 'license') AS hit FROM l)
SELECT doc_id, count_if(hit) > 0 AND count_if(hit AND NOT regexp_matches(line, '^[A-Z]')) = 0 AS vetoed FROM m GROUP BY doc_id
""")
def claim_veto(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_id", classify.every_marker_hit_in_block(F.col("lines"), ["license"], "^[A-Z]").alias("vetoed"))


SIGNALS_SQL = rf"""
WITH b AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, list_transform(ls, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> ''))) AS ns FROM b)
SELECT doc_id, regexp_matches(text, '[0-9]{{10}}') AS pattern_in_scope,
  len(list_filter(range(1, len(ls) + 1), lambda i: ns[i] <= 6 AND regexp_matches(ls[i], '^[A-Z]'))) > 0 AS short_label_line,
  len(list_filter(range(1, least(len(ls), 3) + 1), lambda i: ns[i] <= 12 AND regexp_matches(ls[i], '[.]$'))) > 0 AS title_near_top,
  len(list_filter(range(1, least(len(ls), 2) + 1), lambda i: regexp_matches(ls[i], 'the'))) > 0 AS text_near_top,
  len(list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], 'license') AND (regexp_matches(ls[i], '[0-9]') OR coalesce(regexp_matches(ls[i + 1], '[0-9]'), false)))) > 0 AS label_with_value,
  len(list_filter(ls, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: {TABLE_WORD})) >= 3)) > 0 AS money_table,
  CAST(contains(text, 'the') AS INT) + CAST(contains(text, 'que') AS INT) + CAST(contains(text, 'der') AS INT) AS aliases FROM s
"""


@query("signals", SIGNALS_SQL)
def signals(spark: SparkSession, d: str) -> DataFrame:
    c, ls = F.col("text"), F.col("lines")
    return _lines(spark, d).select(
        "doc_id", classify.pattern_in_scope(c, "[0-9]{10}").alias("pattern_in_scope"), classify.short_label_line(ls, "^[A-Z]", 6).alias("short_label_line"),
        classify.title_near_top(ls, "[.]$", 3, 12).alias("title_near_top"), classify.text_near_top(ls, "the", 2).alias("text_near_top"),
        classify.label_with_corroborating_value(ls, "license", "[0-9]").alias("label_with_value"), classify.money_table_present(ls).alias("money_table"),
        classify.distinct_aliases(c, ["the", "que", "der"]).alias("aliases"),
    )


@query("ladder_classify", """
WITH s AS (SELECT doc_id, contains(text, 'License') AS lic, regexp_matches(text, '[0-9]{10}') AS digits, contains(text, '!!') AS loud FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN lic AND NOT loud THEN 'licence' WHEN digits OR loud THEN 'statement' ELSE 'standard_invoice' END AS doc_type,
  CASE WHEN lic AND NOT loud THEN 'quiet_licence' WHEN digits OR loud THEN 'digits_or_loud' ELSE 'default' END AS rung,
  CASE WHEN (lic AND NOT loud) OR digits OR loud THEN 0.95 ELSE 0.8 END::DOUBLE AS confidence,
  concat_ws(',', CASE WHEN loud THEN 'loud' END, CASE WHEN lic THEN 'licensed' END) AS tags FROM s
""")
def ladder_classify(spark: SparkSession, d: str) -> DataFrame:
    s = {"lic": F.col("text").contains("License"), "digits": F.col("text").rlike("[0-9]{10}"), "loud": F.col("text").contains("!!")}
    rungs = [
        {"name": "quiet_licence", "doc_type": "licence", "when": {"all_of": [{"signal": "lic"}, {"not": {"signal": "loud"}}]}},
        {"name": "digits_or_loud", "doc_type": "statement", "when": {"any_of": [{"signal": "digits"}, {"signal": "loud"}]}},
    ]
    tags = classify.tags([{"tag": "loud", "when": {"signal": "loud"}}, {"tag": "licensed", "when": {"signal": "lic"}}], s)
    r = _lines(spark, d).select("doc_id", classify.ladder(rungs, "standard_invoice", s).alias("k"), tags.alias("t"))
    return r.select("doc_id", "k.doc_type", "k.rung", F.col("k.confidence").cast("double").alias("confidence"), F.array_join("t", ",").alias("tags"))


@query("page_roles", """
WITH p AS (SELECT conv_id, turn, role = 'user' AND length(text) > 300 AS direct, length(text) > 300 AS totals, length(trim(text)) = 0 AS blank FROM conversations),
g AS (SELECT *, bool_or(direct) OVER (PARTITION BY conv_id) AS any_direct, min(CASE WHEN totals THEN turn END) OVER (PARTITION BY conv_id) AS first_total, min(turn) OVER (PARTITION BY conv_id) AS lo FROM p)
SELECT conv_id, turn, CASE WHEN (CASE WHEN any_direct THEN direct WHEN first_total IS NOT NULL THEN turn = first_total ELSE turn = 1 END) THEN 'primary' WHEN blank THEN 'unknown' ELSE 'supporting' END AS role,
  NOT any_direct AND first_total IS NULL AS fallback FROM g
""")
def page_roles(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as pages: user turns have the identity label, long ones the totals."""
    c = _t(spark, d, "conversations")
    p = c.select(
        F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), F.length(F.trim("text")).alias("words"), (F.col("role") == "user").alias("identity"),
        (F.length("text") > 300).alias("totals"), F.lit(False).alias("footer_ok"),
    )
    return classify.page_roles(p).select(F.col("document_id").alias("conv_id"), F.col("page_number").alias("turn"), "role", "fallback")


@query("pagination_footer", """
WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations)
SELECT conv_id, max(m) >= 2 AND conv_id % 3 <> 0 AS footer_ok FROM n GROUP BY conv_id
""")
def pagination_footer(spark: SparkSession, d: str) -> DataFrame:
    """Conversations rendered as ``n OF m`` pages; every third lacks its last footer."""
    w = Window.partitionBy("conv_id")
    c = _t(spark, d, "conversations").withColumn("k", F.row_number().over(w.orderBy("turn"))).withColumn("m", F.count("*").over(w))
    footer = F.when((F.col("conv_id") % 3 == 0) & (F.col("k") == F.col("m")), F.lit("")).otherwise(F.concat(F.lit("Page "), "k", F.lit(" OF "), "m"))
    return classify.shared_footer(c.select(F.col("conv_id").alias("document_id"), footer.alias("text"))).withColumnRenamed("document_id", "conv_id")


# ---------------------------------------------------------------- money

ORDER_SQL = """
WITH l AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s, sum(CAST(l_extendedprice * l_tax AS DECIMAL(18,2))) AS tax FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_orderkey, o_custkey, s, tax, CAST(CASE WHEN o_orderkey % 3 = 0 THEN s + tax WHEN o_orderkey % 3 = 1 THEN s ELSE s + 5 END AS DECIMAL(18,2)) AS printed FROM orders JOIN l ON l_orderkey = o_orderkey)
"""


def _invoices(spark: SparkSession, d: str) -> DataFrame:
    """Orders as invoices: line sums, tax, and a printed total that closes in two of three cases."""
    li = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice").cast(MONEY)).cast("decimal(38,2)").alias("s"), F.sum((F.col("l_extendedprice") * F.col("l_tax")).cast(MONEY)).cast("decimal(38,2)").alias("tax")
    )
    o = _t(spark, d, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    third = F.col("o_orderkey") % 3
    printed = F.when(third == 0, F.col("s") + F.col("tax")).when(third == 1, F.col("s")).otherwise(F.col("s") + 5).cast(MONEY)
    return o.select("o_orderkey", "o_custkey", "o_orderdate", F.col("s").cast(MONEY).alias("s"), F.col("tax").cast(MONEY).alias("tax"), printed.alias("printed"))


@query("crosscheck_line_sum", ORDER_SQL + "SELECT o_orderkey, CASE WHEN abs(s - printed) <= 0.01 THEN 'agree' ELSE 'arith_lines_mismatch' END AS state FROM o")
def crosscheck_line_sum(spark: SparkSession, d: str) -> DataFrame:
    return _invoices(spark, d).select("o_orderkey", derive.crosscheck_line_sum(F.col("s"), F.col("printed")).alias("state"))


@query("crosscheck_total_composition", ORDER_SQL + "SELECT o_orderkey, CASE WHEN abs(s - printed) <= 0.01 OR abs(s + tax - printed) <= 0.01 THEN 'agree' ELSE 'arith_total_mismatch' END AS state FROM o")
def crosscheck_total_composition(spark: SparkSession, d: str) -> DataFrame:
    return _invoices(spark, d).select("o_orderkey", derive.crosscheck_total_composition(F.col("printed"), F.col("s"), F.lit(None).cast(MONEY), F.col("tax")).alias("state"))


PAYABLE_SQL = ORDER_SQL + """, b AS (
  SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN CAST(100 AS DECIMAL(18,2)) END AS prior, CASE WHEN o_orderkey % 8 = 0 THEN CAST(-100 AS DECIMAL(18,2)) END AS paid,
    CASE o_orderkey % 5 WHEN 0 THEN 'net_of_payments' WHEN 1 THEN 'unknown' ELSE 'gross' END AS basis FROM o),
c AS (SELECT *, CASE WHEN prior IS NULL THEN 0 WHEN basis = 'net_of_payments' THEN prior WHEN basis = 'gross' THEN prior + coalesce(paid, 0) END AS carried FROM b),
e AS (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(s AS DECIMAL(18,2)) END AS cur, CAST(s + coalesce(carried, 0) AS DECIMAL(18,2)) AS total, CASE WHEN o_orderkey % 11 = 0 THEN CAST(s + 1 AS DECIMAL(18,2)) END AS please FROM c),
f AS (SELECT *, coalesce(cur, CASE WHEN carried <> 0 THEN total - carried END) AS cur2 FROM e),
r AS (SELECT *, CASE WHEN please IS NOT NULL AND abs(total - please) > 0.01 THEN 'totals_disagree' WHEN prior IS NOT NULL AND carried IS NULL THEN 'carried_unknown'
  WHEN carried <> 0 AND cur2 IS NOT NULL AND abs(carried + cur2 - total) > 0.01 THEN 'does_not_close' WHEN carried <> 0 AND cur2 IS NULL THEN 'current_missing' END AS refusal FROM f)
SELECT o_orderkey, CAST(CAST(carried AS DECIMAL(18,2)) AS VARCHAR) AS carried, CAST(CAST(CASE WHEN refusal IS NULL THEN CASE WHEN carried <> 0 THEN cur2 ELSE total END END AS DECIMAL(18,2)) AS VARCHAR) AS payable,
  CASE WHEN refusal IS NULL THEN CASE WHEN carried <> 0 THEN 'current_charges' ELSE 'total_printed' END END AS basis, refusal FROM r
"""


@query("amount_payable", PAYABLE_SQL)
def amount_payable(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("s")
    amount = lambda n: F.lit(n).cast(MONEY)
    i = _invoices(spark, d).select(
        "o_orderkey", "s", F.when(k % 4 == 0, amount(100)).alias("prior"), F.when(k % 8 == 0, derive.normalize_credit_sign(amount(100))).alias("paid"),
        F.when(k % 5 == 0, "net_of_payments").when(k % 5 == 1, "unknown").otherwise("gross").alias("basis"),
    )
    i = i.withColumn("carried", derive.carried_balance(F.col("prior"), F.col("paid"), F.col("basis")))
    i = i.withColumn("printed", (s + F.coalesce("carried", amount(0))).cast(MONEY)).withColumn("please", F.when(k % 11 == 0, (s + 1).cast(MONEY)))
    i = i.withColumn("current", derive.current_from_printed(F.when(k % 7 != 0, s), F.col("printed"), F.col("carried")))
    i = i.withColumn("p", derive.amount_payable(F.col("printed"), F.col("please"), F.col("prior"), F.col("carried"), F.col("current")))
    return i.select("o_orderkey", F.col("carried").cast("string").alias("carried"), F.col("p.value").cast("string").alias("payable"), F.col("p.basis").alias("basis"), F.col("p.refusal").alias("refusal"))


@query("weight_tier_pricing", """
WITH t(lo, hi, margin) AS (VALUES (0, 10, 1.50), (10, 30, 1.25), (30, 45, 1.10)), f(state, rate) AS (VALUES (0, 2.50), (1, 3.75), (2, 4.10)),
b AS (SELECT p_partkey, p_size AS weight, CAST(p_retailprice AS DECIMAL(18,2)) AS cost, p_partkey % 4 AS state FROM part)
SELECT p_partkey, CAST(CAST(round_even(CAST(weight * cost * margin * 1.05 + rate + 0.1250 AS DECIMAL(30,8)), 2) AS DECIMAL(18,2)) AS VARCHAR) AS price, margin IS NULL OR rate IS NULL AS needs_review
FROM b LEFT JOIN t ON weight >= lo AND weight < hi LEFT JOIN f USING (state)
""")
def weight_tier_pricing(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part").select(
        "p_partkey", F.col("p_size").alias("weight"), F.col("p_retailprice").cast(MONEY).alias("cost"), (F.col("p_partkey") % 4).cast("int").alias("state"), F.lit("0.05").cast("decimal(4,2)").alias("cut")
    )
    tiers = spark.sql("SELECT * FROM VALUES (0, 10, 1.50), (10, 30, 1.25), (30, 45, 1.10) AS t(lo, hi, margin)")
    freight = spark.sql("SELECT * FROM VALUES (0, 2.50), (1, 3.75), (2, 4.10) AS f(state, rate)")
    got = derive.price_per_foot(p, tiers, freight, surcharge="0.1250")
    return got.select("p_partkey", F.col("price").cast(MONEY).cast("string").alias("price"), "needs_review")


@query("infer_currency", """
SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'EUR' WHEN s_nationkey = 3 THEN 'CAD' WHEN s_suppkey % 7 = 0 THEN 'CAD' ELSE 'USD' END AS code,
  CASE WHEN s_suppkey % 5 = 0 THEN 'explicit' WHEN s_nationkey = 3 THEN 'tax_regime' WHEN s_suppkey % 7 = 0 THEN 'vendor_address' ELSE 'pack_default' END AS basis,
  NOT (s_suppkey % 5 = 0 OR s_nationkey = 3) AS weak FROM supplier
""")
def infer_currency(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    c = derive.infer_currency(F.when(k % 5 == 0, "EUR"), F.col("s_nationkey") == 3, F.when(k % 7 == 0, "K1A 0B1").otherwise("12345"), "USD")
    return _t(spark, d, "supplier").select("s_suppkey", c.alias("c")).select("s_suppkey", "c.code", "c.basis", "c.weak")


@query("vendor_alias", f"""
WITH n AS (SELECT doc_id, ' ' || {_NORM} || ' ' AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN contains(t, ' all rights reserved ') THEN 'rights' WHEN contains(t, ' mit license ') THEN 'mit' WHEN contains(t, ' license ') THEN 'other' END AS vendor FROM n
""")
def vendor_alias(spark: SparkSession, d: str) -> DataFrame:
    v = derive.longest_alias(values.normalize_name(F.col("text")), {"license": "other", "mit license": "mit", "all rights reserved": "rights"})
    return _lines(spark, d).select("doc_id", v.alias("vendor"))


@query("bill_to_roster", "SELECT n_nationkey, contains(lower(n_name), 'united') OR contains(lower(n_name), 'china') OR contains('united kingdom', lower(n_name)) AS on_roster FROM nation")
def bill_to_roster(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "nation").select("n_nationkey", values.matches_roster(F.col("n_name"), ["United", "China", "United Kingdom"]).alias("on_roster"))


@query("document_identity", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'INV' || o_orderkey WHEN o_orderkey % 3 = 1 THEN o_custkey || '|' || strftime(o_orderdate, '%Y-%m') WHEN o_orderkey % 2 = 0 THEN 'soft:' || o_custkey END AS identity,
  CASE WHEN o_orderkey % 3 = 0 THEN 'invoice_number' WHEN o_orderkey % 3 = 1 THEN 'account_period' WHEN o_orderkey % 2 = 0 THEN 'soft' END AS basis FROM orders
""")
def document_identity(spark: SparkSession, d: str) -> DataFrame:
    k, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    i = derive.document_identity(F.when(k % 3 == 0, F.concat(F.lit("INV"), k)), F.when(k % 3 == 1, cust), F.date_format("o_orderdate", "yyyy-MM"), F.when(k % 2 == 0, cust))
    return _t(spark, d, "orders").select("o_orderkey", i.alias("i")).select("o_orderkey", "i.identity", "i.basis")


@query("duplicates_first_seen", "SELECT doc_id, CASE WHEN min(doc_id) OVER (PARTITION BY md5(text)) <> doc_id THEN min(doc_id) OVER (PARTITION BY md5(text)) END AS possible_duplicate_of FROM documents")
def duplicates_first_seen(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("intake_seq"), F.md5(F.col("text").cast("binary")).alias("document_identity"))
    return analytics.possible_duplicates(r).select(F.col("document_id").alias("doc_id"), "possible_duplicate_of")


@query("scanline_corroborate", """
SELECT o_orderkey, CASE WHEN length(CAST(o_orderkey AS VARCHAR)) >= 3 THEN CASE WHEN contains(lpad(CAST(o_custkey * 1000 + o_orderkey % 1000 AS VARCHAR), 20, '0'), CAST(o_orderkey AS VARCHAR)) THEN 'agree' ELSE 'scanline_mismatch' END END AS state FROM orders
""")
def scanline_corroborate(spark: SparkSession, d: str) -> DataFrame:
    scan = F.lpad((F.col("o_custkey") * 1000 + F.col("o_orderkey") % 1000).cast("string"), 20, "0")
    return _t(spark, d, "orders").select("o_orderkey", derive.crosscheck_scanline(F.col("o_orderkey").cast("string"), scan).alias("state"))


@query("filename_crosscheck", """
WITH p AS (SELECT page_id, regexp_replace(url, '[^0-9]', '', 'g') AS u, CAST(100 + page_id AS VARCHAR) AS a, CAST(page_id * 7 AS VARCHAR) AS b FROM pages)
SELECT page_id, CASE WHEN contains(u, a) OR (length(b) >= 3 AND contains(u, b)) THEN 'agree' WHEN length(u) >= 3 THEN 'disagree' ELSE 'absent' END AS state,
  CASE WHEN contains(u, a) THEN 'invoice_number' WHEN length(b) >= 3 AND contains(u, b) THEN 'account_number' END AS field FROM p
""")
def filename_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    c = derive.crosscheck_filename(F.col("url"), {"invoice_number": (k + 100).cast("string"), "account_number": (k * 7).cast("string")})
    return _t(spark, d, "pages").select("page_id", c.alias("c")).select("page_id", "c.state", "c.field")


# ---------------------------------------------------------------- scoring


@query("confidence_score", """
SELECT l_orderkey, l_linenumber, round(CAST(least(0.99, (CASE WHEN l_linenumber % 3 = 0 THEN 0.90 WHEN l_linenumber % 3 = 1 THEN 1.00 ELSE 0.95 END)
  * CASE WHEN l_returnflag = 'R' THEN 0.85 ELSE 1 END * CASE WHEN l_linestatus = 'O' THEN 0.95 ELSE 1 END) AS DOUBLE), 6) AS confidence FROM lineitem
""")
def confidence_score(spark: SparkSession, d: str) -> DataFrame:
    q = F.when(F.col("l_linenumber") % 3 == 0, F.lit("0.90")).when(F.col("l_linenumber") % 3 == 1, F.lit("1.00")).otherwise(F.lit("0.95")).cast("decimal(4,2)")
    mods = F.filter(F.array(F.when(F.col("l_returnflag") == "R", "arith_lines_mismatch"), F.when(F.col("l_linestatus") == "O", "anchor_alt_used")), lambda m: m.isNotNull())
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(score.apply_modifiers(q, mods).cast("double"), 6).alias("confidence"))


@query("confidence_boosts", """
SELECT l_orderkey, l_linenumber, round(least(0.99, (1 - l_discount) * least(1.10, power(1.03, l_linenumber - 1))), 6) AS boosted FROM lineitem
""")
def confidence_boosts(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers as numbers of boosts, up to six."""
    q = (F.lit(1) - F.col("l_discount")).cast("decimal(12,10)")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(score.apply_boosts(q, F.col("l_linenumber") - 1).cast("double"), 6).alias("boosted"))


@query("confidence_gate", """
WITH c AS (SELECT l_orderkey, count(*) AS n, count_if(l_discount < 0.05) AS low, count_if(l_discount >= 0.05 AND l_discount < 0.08) AS mid, bool_or(l_returnflag = 'R') AS forced FROM lineitem GROUP BY l_orderkey),
k AS (SELECT *, CASE WHEN low + mid = 0 THEN 'high' WHEN low / n >= 0.6 THEN 'low' ELSE 'medium' END AS lane FROM c)
SELECT l_orderkey, CASE WHEN lane = 'low' THEN 'low' WHEN forced THEN 'review' ELSE lane END AS lane, lane <> 'high' OR forced AS review_flag, lane = 'low' AS regen_flag FROM k
""")
def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    """Lines as fields: the discount decides the confidence, a returned line forces review."""
    conf = F.when(F.col("l_discount") < 0.05, 0.4).when(F.col("l_discount") < 0.08, 0.8).otherwise(0.95)
    g = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(conf).alias("list"), F.bool_or(F.col("l_returnflag") == "R").alias("forced")
    )
    g = g.withColumn("conf", F.map_from_arrays(F.transform("list", lambda x, i: i.cast("string")), F.col("list")))
    lane = score.lane(F.col("conf"), F.create_map().cast("map<string,double>"))
    g = g.select("l_orderkey", score.gate(lane, F.size("conf") > 0, F.lit(False), F.col("forced"), F.lit(False)).alias("g"))
    return g.select("l_orderkey", "g.lane", "g.review_flag", "g.regen_flag")


@query("coverage", """
WITH g AS (SELECT l_orderkey, bool_or(l_linenumber = 1) AS a, bool_or(l_linenumber = 2) AS b, bool_or(l_linenumber = 3) AS c, bool_or(l_linenumber = 4) AS d FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, a::INT + b::INT + c::INT + d::INT AS populated, concat_ws(',', CASE WHEN NOT a THEN '1' END, CASE WHEN NOT b THEN '2' END) AS missing, a AND b AS complete,
  4 - (a::INT + b::INT + c::INT + d::INT) >= 3 AS collapsed FROM g
""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    g = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber").cast("string")).alias("have"))
    arr = lambda *x: F.array(*map(F.lit, x))
    g = g.select("l_orderkey", score.coverage(arr("1", "2", "3", "4"), arr("1", "2"), F.col("have")).alias("c"))
    return g.select("l_orderkey", "c.populated", F.array_join("c.missing_required", ",").alias("missing"), "c.complete", "c.collapsed")


@query("vision_policy", """
SELECT event_id, CASE WHEN isnan(value) THEN 0.5 ELSE greatest(0.5, least(0.7, coalesce(value, 0.5))) END AS confidence, CASE WHEN trim(event_type) <> '' AND event_type <> 'click' THEN event_type END AS kept FROM events
""")
def vision_policy(spark: SparkSession, d: str) -> DataFrame:
    fields = score.vision_fields(F.create_map(F.lit("kind"), F.when(F.col("event_type") != "click", F.col("event_type"))), F.array(F.lit("kind")))
    return _t(spark, d, "events").select("event_id", score.vision_confidence(F.col("value")).alias("confidence"), F.try_element_at(fields, F.lit("kind")).alias("kept"))


# ---------------------------------------------------------------- reconciliation, queue, telemetry, evaluation

CONTRACTS_SQL = """
WITH i AS (SELECT o_orderkey AS invoice_id, CASE WHEN o_custkey % 10 <> 0 THEN CAST(o_custkey % 5 AS VARCHAR) END AS sender, upper('acct' || o_custkey) AS k, strftime(o_orderdate, '%Y-%m-%d') AS bill_date, o_totalprice AS charged FROM orders),
c AS (SELECT c_custkey * 10 + y AS contract_id, CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey % 5 AS VARCHAR) END AS sender, upper('acct' || c_custkey) AS k,
  CASE WHEN y = 2 THEN '1994-01-01' ELSE CAST(1993 + y AS VARCHAR) || '-01-01' END AS start_date, CASE y WHEN 0 THEN '1995-06-30' WHEN 1 THEN '1996-12-31' END AS end_date, c_acctbal * 30 AS rate
  FROM customer, (VALUES (0), (1), (2)) v(y) WHERE c_custkey % 3 > y OR y = 0),
j AS (SELECT DISTINCT invoice_id, bill_date, contract_id, start_date, end_date FROM i JOIN c ON i.k = c.k AND i.sender IS NOT DISTINCT FROM c.sender),
b AS (SELECT *, start_date <= bill_date AND (end_date IS NULL OR bill_date <= end_date) AS ins FROM j),
g AS (SELECT invoice_id, count(*) AS n, min(contract_id) AS one, max(CASE WHEN ins THEN start_date END) AS latest FROM b GROUP BY invoice_id),
t AS (SELECT b.invoice_id, count(*) AS ties, min(contract_id) AS picked FROM b JOIN g USING (invoice_id) WHERE ins AND start_date = latest GROUP BY b.invoice_id),
r AS (SELECT i.invoice_id, i.bill_date, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN one WHEN ties = 1 THEN picked END AS contract_id,
  CASE WHEN n IS NULL THEN 'none' WHEN n = 1 OR ties = 1 THEN 'matched' ELSE 'ambiguous' END AS state, charged FROM i LEFT JOIN g USING (invoice_id) LEFT JOIN t USING (invoice_id))
"""


def _contracts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sender = lambda c: F.when(F.col(c) % 10 != 0, (F.col(c) % 5).cast("string"))
    o = _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("invoice_id"), sender("o_custkey").alias("sender_fingerprint"), F.concat(F.lit("acct-"), "o_custkey").alias("account_number"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("bill_date"), F.col("o_totalprice").alias("charged"),
    )
    y = F.col("y")
    c = _t(spark, d, "customer").select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("y")).where("c_custkey % 3 > y or y = 0")
    c = c.select(
        (F.col("c_custkey") * 10 + y).alias("contract_id"), sender("c_custkey").alias("sender_fingerprint"), F.concat(F.lit("ACCT "), "c_custkey").alias("account_number"),
        F.when(y == 2, "1994-01-01").otherwise(F.concat((y + 1993).cast("string"), F.lit("-01-01"))).alias("start_date"),
        F.when(y == 0, "1995-06-30").when(y == 1, "1996-12-31").alias("end_date"), (F.col("c_acctbal") * 30).alias("contracted_rate"),
    )
    return o, c


@query("reconcile_contracts", CONTRACTS_SQL + "SELECT invoice_id, bill_date, candidates, contract_id, state FROM r")
def reconcile_contracts(spark: SparkSession, d: str) -> DataFrame:
    # the label prefix of both spellings falls away, the number stays
    return analytics.resolve_contracts(*_contracts(spark, d))


@query("reconcile_findings", CONTRACTS_SQL + """
SELECT r.invoice_id, CASE WHEN state = 'ambiguous' THEN 'contract_precedence_ambiguous' WHEN state = 'none' THEN 'no_matching_contract' WHEN end_date IS NOT NULL AND r.bill_date > end_date THEN 'billed_after_contract_expiry'
  WHEN rate > 0 AND abs((charged - rate) / rate) > 0.02 THEN 'rate_mismatch' ELSE 'clean' END AS finding FROM r LEFT JOIN c USING (contract_id)
""")
def reconcile_findings(spark: SparkSession, d: str) -> DataFrame:
    o, c = _contracts(spark, d)
    return analytics.findings(analytics.resolve_contracts(o, c), c, o)


JOBS_SQL = """
WITH e AS (SELECT event_id AS job_id, event_type AS kind, CASE WHEN user_id % 13 <> 0 THEN CAST(user_id AS VARCHAR) END AS sender, CASE WHEN event_id % 50 <> 0 THEN 'invoice' END AS doc_type, ts FROM events),
old AS (SELECT * FROM e WHERE job_id % 10 = 0), new AS (SELECT * FROM e WHERE job_id % 10 <> 0 AND sender IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY kind, sender, doc_type ORDER BY ts, job_id) AS rn FROM new n WHERE doc_type IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM old o WHERE o.kind = n.kind AND o.sender = n.sender AND o.doc_type = n.doc_type))
SELECT job_id, kind, sender AS sender_fingerprint FROM f WHERE rn = 1 UNION ALL SELECT job_id, kind, sender FROM new WHERE doc_type IS NULL
"""


@query("jobs_single_flight", JOBS_SQL)
def jobs_single_flight(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select(
        F.col("event_id").alias("job_id"), F.col("event_type").alias("kind"), F.when(F.col("user_id") % 13 != 0, F.col("user_id").cast("string")).alias("sender_fingerprint"),
        F.when(F.col("event_id") % 50 != 0, "invoice").alias("doc_type"), F.lit("").alias("match_key"), F.col("ts").alias("created_at"),
    )
    return analytics.enqueue_once(e.where("job_id % 10 = 0"), e.where("job_id % 10 <> 0")).select("job_id", "kind", "sender_fingerprint")


@query("queue_status", """
WITH o AS (SELECT event_type AS kind, ts FROM events WHERE event_id % 3 = 0)
SELECT kind, count(*) AS open_jobs, CAST(floor((epoch(TIMESTAMP '2030-01-01') - epoch(min(date_trunc('second', ts)))) / 3600) AS BIGINT) AS oldest_hours FROM o GROUP BY GROUPING SETS ((kind), ())
""")
def queue_status(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("created_at"), F.when(F.col("event_id") % 3 == 0, "open").otherwise("done").alias("status"))
    return analytics.queue_status(e, F.lit("2030-01-01 00:00:00").cast("timestamp"))


TELE_SQL = "SELECT ts AS logged_at, CASE WHEN event_type = 'purchase' THEN 'dead_letter' ELSE 'processed' END AS disposition, CASE WHEN user_id % 4 = 0 THEN 'review' WHEN user_id % 4 = 1 THEN 'low' ELSE 'high' END AS lane, user_id % 4 = 0 AS review_flag, CAST(value AS DECIMAL(18,6)) AS mean_confidence, event_id FROM events"


def _telemetry(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id") % 4
    return _t(spark, d, "events").select(
        F.col("ts").alias("logged_at"), F.when(F.col("event_type") == "purchase", "dead_letter").otherwise("processed").alias("disposition"), F.when(u == 0, "review").when(u == 1, "low").otherwise("high").alias("lane"),
        (u == 0).alias("review_flag"), F.col("value").cast("decimal(18,6)").alias("mean_confidence"), "event_id",
    )


@query("telemetry_aggregate", f"""
WITH t AS ({TELE_SQL}) SELECT count(*) AS total, count_if(disposition = 'dead_letter') AS dead_letters, round(count_if(disposition = 'dead_letter') / count(*), 4) AS dead_letter_rate,
  round(count_if(review_flag) / count(*), 4) AS escalation_rate, round(CAST(sum(mean_confidence) AS DOUBLE) / count(mean_confidence), 4) AS mean_confidence FROM t
""")
def telemetry_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return analytics.telemetry(_telemetry(spark, d)).withColumn("mean_confidence", F.col("mean_confidence").cast("double"))


@query("problem_records", f"WITH t AS ({TELE_SQL}) SELECT event_id, disposition, lane FROM t WHERE disposition = 'dead_letter' OR lane IN ('review', 'low')")
def problem_records(spark: SparkSession, d: str) -> DataFrame:
    return analytics.problem_records(_telemetry(spark, d)).select("event_id", "disposition", "lane")


@query("telemetry_windowed", f"WITH t AS ({TELE_SQL}) SELECT epoch(time_bucket(INTERVAL '1 hour', logged_at))::BIGINT AS hour_start, disposition, count(*) AS n FROM t GROUP BY ALL")
def telemetry_windowed(spark: SparkSession, d: str) -> DataFrame:
    """Counts by hour of the stream of events; nothing is late, as all files are there when it starts."""
    from quillstone.streaming.stream import available_now, file_stream, windowed

    events = file_stream(spark, d, "events.parquet", _t(spark, d, "events").schema)
    t = events.select(F.col("ts").cast("timestamp").alias("logged_at"), F.when(F.col("event_type") == "purchase", "dead_letter").otherwise("processed").alias("disposition"))
    got = available_now(spark, windowed(t, "logged_at", "1 hour", "1 day", "disposition"), mode="complete")
    return got.select(F.unix_timestamp("window.start").alias("hour_start"), "disposition", "n")


CARD_SQL = """
WITH a AS (SELECT d.doc_id AS gold_id, d.source AS pack, d.lang AS doc_type, q.name, CASE q.name WHEN 'quality' THEN quality = 1 WHEN 'toxic' THEN toxic = 0 ELSE n_chars > 1000 END AS passed
  FROM documents d JOIN labels l USING (doc_id), (VALUES ('quality'), ('toxic'), ('size')) q(name)),
c AS (SELECT gold_id, pack, doc_type, count(*) AS total, count_if(passed) AS n_passed, bool_and(passed) AS all_passed FROM a GROUP BY ALL)
"""


def _assertions(spark: SparkSession, d: str) -> DataFrame:
    """Labels as gold assertions of three kinds."""
    j = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    part = lambda name, kind, expected, actual: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(expected).alias("expected"), actual.cast("string").alias("actual"))
    parts = F.array(part("quality", "money", "$1.00", F.col("quality").cast(MONEY)), part("toxic", "exact", "0", F.col("toxic")), part("size", "text", "Long  Text", F.when(F.col("n_chars") > 1000, "long text").otherwise("short")))
    a = j.select(F.col("doc_id").alias("gold_id"), F.col("source").alias("pack"), F.col("lang").alias("doc_type"), F.explode(parts).alias("p")).select("gold_id", "pack", "doc_type", "p.*")
    return a.withColumn("passed", analytics.assertion_passes(F.col("kind"), F.col("expected"), F.col("actual")))


@query("scorecard", CARD_SQL + "SELECT gold_id, total, n_passed AS passed, all_passed FROM c")
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    return analytics.scorecard(_assertions(spark, d))


@query("accuracy_grouping_sets", CARD_SQL + "SELECT pack, doc_type, count(*) AS documents, count_if(all_passed) AS correct FROM c GROUP BY GROUPING SETS ((pack), (doc_type), ())")
def accuracy_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    cards = _assertions(spark, d).groupBy("gold_id", "pack", "doc_type").agg(F.bool_and("passed").alias("all_passed"))
    return analytics.accuracy(cards)


@query("eval_compare", CARD_SQL + "SELECT gold_id, name FROM a WHERE passed AND gold_id % 3 = 0")
def eval_compare(spark: SparkSession, d: str) -> DataFrame:
    a = _assertions(spark, d).select("gold_id", "name", "passed")
    return analytics.regressions(a, a.withColumn("passed", F.col("passed") & (F.col("gold_id") % 3 != 0)))


@query("export_standard", "SELECT CAST(o_orderkey AS VARCHAR) AS document, CASE WHEN o_orderkey % 4 = 0 THEN '''=' ELSE '' END || o_orderpriority AS priority, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total FROM orders")
def export_standard(spark: SparkSession, d: str) -> DataFrame:
    risky = F.concat(F.when(F.col("o_orderkey") % 4 == 0, "=").otherwise(""), F.col("o_orderpriority"))
    return analytics.export_layout(_t(spark, d, "orders"), {"document": F.col("o_orderkey").cast("string"), "priority": risky, "total": F.col("o_totalprice").cast(MONEY).cast("string")})


@query("cassette_replay", """
WITH r AS (SELECT conv_id, turn, substr(sha256(role || '|' || text), 1, 16) AS key FROM conversations), a AS (SELECT DISTINCT substr(sha256(role || '|' || text), 1, 16) AS key FROM conversations WHERE turn % 2 = 0)
SELECT conv_id, turn, a.key IS NOT NULL AS found, CASE WHEN a.key IS NULL THEN 'no recorded answer' END AS error FROM r LEFT JOIN a USING (key)
""")
def cassette_replay(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations").withColumn("key", F.substring(F.sha2(F.concat_ws("|", "role", "text"), 256), 1, 16))
    cassette = c.where("turn % 2 = 0").select("key").distinct().withColumn("answer", F.lit("recorded"))
    return analytics.cassette_replay(c.select("conv_id", "turn", "key"), cassette).select("conv_id", "turn", F.col("answer").isNotNull().alias("found"), "error")


@query("stream_dedup", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, value FROM events) GROUP BY ALL")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    from quillstone.streaming.stream import available_now, distinct_stream

    events = distinct_stream(spark, d, "events.parquet", _t(spark, d, "events").schema, ["user_id", "event_type", "value"])
    return available_now(spark, events).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- selector execution and records


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows by document, before pages are made of them: pages are much larger, and nothing downstream shuffles again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _order_pages(spark: SparkSession, d: str) -> DataFrame:
    """Orders as printed pages: a number, a date, an amount under one of two labels, a payment slip's digits."""
    k = F.col("o_orderkey")
    put = lambda x, y, t: F.struct(t.alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y0"), (F.lit(float(x)) + 6 * F.length(t)).alias("x1"), F.lit(float(y + 10)).alias("y1"))
    lit = F.lit
    amount = F.concat(lit("$"), F.format_number("o_totalprice", 2))
    words = [put(20, 10, lit("Invoice")), put(68, 10, lit("No:")), put(120, 10, F.concat(lit("N"), k.cast("string")))]
    words += [put(20, 30, lit("Order")), put(56, 30, lit("Date")), put(120, 30, F.date_format("o_orderdate", "M/d/yyyy"))]
    words += [put(20, 50, F.when(k % 3 == 0, "Balance").otherwise("Amount")), put(68, 50, F.when(k % 3 == 0, "Outstanding").otherwise("Due")), put(200, 50, amount)]
    words += [put(20, 90, F.lpad(F.col("o_custkey").cast("string"), 20, "0")), put(200, 90, lit("slip")), put(260, 90, k.cast("string"))]
    o = _dealt(_t(spark, d, "orders"), "o_orderkey").select(k.alias("document_id"), F.lit(1).alias("page_number"), F.array(*words).alias("words"), F.lit(3.0).alias("line_tolerance"))
    return geometry.lines(o)


ORDER_FIELDS = (
    {"field": "invoice_number", "anchor": "Invoice No", "pattern": "account_number", "region": "same-row"},
    {"field": "invoice_date", "anchor": "Order Date:", "pattern": "date", "region": "near-anchor"},
    {"field": "total_printed", "anchor": "Amount Due", "anchor_alts": ["Balance Outstanding"], "pattern": "currency", "region": "same-row"},
    {"field": "slip", "pattern": "[0-9]{20}", "region": "any-page"},
)


@query("executor_fields", """
SELECT o_orderkey AS document_id, 'invoice_number' AS field, 'N' || o_orderkey AS value, 1.0::DOUBLE AS quality, '' AS modifiers FROM orders
UNION ALL SELECT o_orderkey, 'invoice_date', strftime(o_orderdate, '%Y-%m-%d'), 1.0, '' FROM orders
UNION ALL SELECT o_orderkey, 'total_printed', CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS VARCHAR), CASE WHEN o_orderkey % 3 = 0 THEN 0.95 ELSE 1.0 END, CASE WHEN o_orderkey % 3 = 0 THEN 'anchor_alt_used' ELSE '' END FROM orders
UNION ALL SELECT o_orderkey, 'slip', lpad(CAST(o_custkey AS VARCHAR), 20, '0'), 0.9, '' FROM orders
""")
def executor_fields(spark: SparkSession, d: str) -> DataFrame:
    got = executor.fields(_order_pages(spark, d), ORDER_FIELDS)
    return got.select("document_id", "field", "value", F.col("quality").cast("double").alias("quality"), F.array_join("modifiers", ",").alias("modifiers"))


@query("executor_scanline", "SELECT o_orderkey AS document_id, lpad(CAST(o_custkey AS VARCHAR), 20, '0') || ' ' || o_orderkey AS scanline FROM orders")
def executor_scanline(spark: SparkSession, d: str) -> DataFrame:
    return executor.scanline(_order_pages(spark, d))


@query("executor_row_groups", """
SELECT l_orderkey AS document_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row, CAST(l_partkey AS VARCHAR) AS item,
  CASE WHEN l_linenumber % 4 <> 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS qty, CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(38,4)) AS VARCHAR) AS amount FROM lineitem
""")
def executor_row_groups(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tables with a header, an empty cell in every fourth row, and a total and a remark below."""
    at = lambda t, x, y: F.struct(t.alias("text"), F.lit(float(x)).alias("x0"), y.alias("y0"), (F.lit(float(x)) + 6 * F.length(t)).alias("x1"), (y + 10).alias("y1"))
    li = _dealt(_t(spark, d, "lineitem"), "l_orderkey")
    each = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    li = li.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.sort_array(F.collect_list(each)).alias("items"), F.sum(F.col("l_extendedprice").cast(MONEY)).alias("s"))

    def printed(r: Column, i: Column) -> Column:
        y = (i + 1) * 14.0 + 20
        words = F.array(at(r["l_partkey"].cast("string"), 20, y), at(F.when(r["l_linenumber"] % 4 != 0, r["l_quantity"].cast("long").cast("string")), 200, y), at(F.format_number(r["l_extendedprice"], 2), 300, y))
        return F.filter(words, lambda w: w["text"].isNotNull())

    top, bottom = F.lit(20.0), (F.size("items") + 1) * 14.0 + 20
    head = F.array(at(F.lit("Item"), 20, top), at(F.lit("Qty"), 200, top), at(F.lit("Amount"), 300, top))
    total = F.array(at(F.lit("Total"), 20, bottom), at(F.format_number("s", 2), 300, bottom))
    words = F.concat(head, F.flatten(F.transform("items", printed)), total)
    lines = geometry.lines(li.select("document_id", F.lit(1).alias("page_number"), words.alias("words"), F.lit(3.0).alias("line_tolerance")))
    got = executor.row_groups(lines, {"table_anchor": "Item", "column_headers": {"item": "Item", "qty": "Qty", "amount": "Amount"}, "columns": {"item": "text", "qty": "integer", "amount": "currency"}, "require_amount": True})
    cells = F.col("cells")
    return got.select("document_id", F.col("row").cast("long").alias("row"), *(F.try_element_at(cells, F.lit(c)).alias(c) for c in ("item", "qty", "amount")))


RECORD_SQL = """
WITH v AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'lost' WHEN o_orderkey % 7 = 0 THEN 'skipped' ELSE 'processed' END AS disposition FROM orders),
x AS (SELECT k, disposition, concat_ws(', ', CASE WHEN disposition = 'lost' THEN 'disposition' END, CASE WHEN disposition = 'processed' AND k % 13 = 0 THEN 'doc_type' END,
  CASE WHEN disposition = 'processed' AND k % 5 = 0 THEN 'identity_keys' END, CASE WHEN k % 17 = 0 THEN 'confidence_range' END, CASE WHEN k % 19 = 0 THEN 'reference_page' END,
  CASE WHEN k % 23 = 0 THEN 'coverage_order' END, CASE WHEN k % 3 = 0 AND k % 23 <> 0 AND k % 2 = 0 THEN 'coverage_complete' WHEN k % 23 = 0 AND k % 3 = 0 THEN 'coverage_complete' END, CASE WHEN k % 29 = 0 THEN 'scanline' END) AS broken FROM v)
"""


@query("record_contract", RECORD_SQL + """SELECT CAST(k AS VARCHAR) AS document_id, CASE WHEN broken <> '' THEN 'dead_letter' ELSE disposition END AS disposition,
  CASE WHEN broken <> '' THEN 'contract: ' || broken END AS reason, broken <> '' AS review_flag FROM x""")
def record_contract(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents, some of which break a rule of the contract."""
    k = F.col("o_orderkey")
    text = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    cover = F.struct(F.lit(4).alias("declared"), F.when(k % 23 == 0, 5).when(k % 2 == 0, 3).otherwise(4).alias("populated"), F.array().cast("array<string>").alias("missing_required"), (k % 3 == 0).alias("complete"))
    o = _t(spark, d, "orders").select(
        k.cast("string").alias("document_id"), F.when(k % 13 != 0, "invoice").alias("doc_type"), F.when(k % 11 == 0, "lost").when(k % 7 == 0, "skipped").otherwise("processed").alias("disposition"),
        F.when(k % 5 == 0, text("document_identity", "x")).otherwise(text("document_identity", "x", "identity_basis", "y")).alias("derived"),
        text("total", F.when(k % 17 == 0, 1.0).otherwise(0.99)).alias("confidence"), cover.alias("extraction_coverage"),
        F.array(F.struct(F.lit("v").alias("value"), F.lit("f").alias("source_field"), F.when(k % 19 == 0, 0).otherwise(1).alias("page"), F.lit("p").alias("pattern_id"))).alias("reference_list"),
        F.when(k % 29 == 0, "12a").otherwise("0012").alias("scanline"),
    )
    return record.validate_record(record.build_record(o)).select("document_id", "disposition", "reason", "review_flag")


@query("process_complete", "SELECT count(*) AS intaken, count(*) AS emitted, 0 AS missing, true AS complete FROM orders")
def process_complete(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("document_id"))
    return record.process(o, record.validate_record(record.build_record(o)))

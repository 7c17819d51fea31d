"""Core operators against DuckDB and small synthetic pages."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstone import queries as core
from quillstone.functions import patterns, values
from quillstone.operators import analytics, derive, geometry, score
from quillstone.sources import readers

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = core.queries()[name](spark, SF)
    cols = sorted(got.columns)
    r = duck.execute(core.oracle_sql()[name])
    at = [[d[0] for d in r.description].index(c) for c in cols]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(map(key, got.select(*cols).collect())) == sorted(key([row[i] for i in at]) for row in r.fetchall())


def _one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize("text,amount", [("1,234.50", "1234.50"), ("(12.00)", "-12.00"), ("-40.500", "-40.500"), ("12", None), (".25", "0.25"), ("9.99/MO", "9.99"), ("7.00CR", "-7.00"), ("(5.00", "5.00"), ("1,23.00", None), (None, None), ("", None)])
def test_money_keeps_printed_scale(spark, text, amount):
    assert _one(spark, text, patterns.money_text) == amount


def test_impossible_date_is_a_miss(spark):
    assert _one(spark, "2/30/2024", patterns.date) is None and _one(spark, "3/4/24", patterns.date) == "2024-03-04"


@pytest.mark.parametrize("bad", ["a*", "(a)(b)", r"(a)\\1", "(?<=a)b", "x" * 201])
def test_restricted_patterns(bad):
    with pytest.raises((patterns.PatternError, ValueError)):
        patterns.compile_restricted(bad.replace("\\\\", "\\"))


def test_drifting_baselines_make_two_lines(spark):
    words = [(t, 0.0, y, 5.0, y + 10) for t, y in (("a", 10.0), ("b", 12.0), ("c", 14.0), ("d", 16.0))]
    df = spark.createDataFrame([(words,)], f"words {readers.WORD_TYPE}")
    lines = df.select(geometry.group_lines(F.col("words"))).first()[0]
    assert [[w.text for w in x.words] for x in lines] == [["a", "b"], ["c", "d"]]


def test_label_block_stops_at_second_blank(spark):
    rows = [(12.0, "x"), (24.0, None), (36.0, "y"), (48.0, None), (60.0, None), (72.0, "z")]
    df = spark.createDataFrame([(rows,)], "ls array<struct<y0:double,text:string>>")
    assert df.select(geometry.label_block(F.col("ls"), F.lit(0.0))).first()[0] == ["x", "y"]


def test_balance_forward_is_not_paid_twice(spark):
    m = lambda x: F.lit(x).cast("decimal(18,2)")
    carried = derive.carried_balance(m("300.00"), m(None), F.lit("gross"))
    p = spark.range(1).select(derive.amount_payable(m("370.00"), m(None), m("300.00"), carried, m("70.00"))).first()[0]
    assert (str(p.value), p.basis, p.refusal) == ("70.00", "current_charges", None)


def test_unknown_modifier_is_null_and_known_ones_multiply(spark):
    q = spark.range(1).select(score.apply_modifiers(F.lit("1.00").cast("decimal(4,2)"), F.array(F.lit("ocr_source"), F.lit("high_skew"))), score.apply_modifiers(F.lit("1.00").cast("decimal(4,2)"), F.array(F.lit("nope")))).first()
    assert abs(float(q[0]) - 0.765) < 1e-9 and q[1] is None


def test_mails_are_never_lost(spark):
    good = b"From: A <a@x.org>\r\nMessage-Id: <1@x>\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain\r\nContent-Disposition: attachment; filename=\"a.txt\"\r\n\r\nhello\r\n--b--\r\n"
    got = readers.email_intake(spark.createDataFrame([("m1", good), ("m2", b"\x00\xff"), ("m3", None)], "path string, content binary")).collect()
    assert {r.source_path for r in got} == {"m1#a.txt", "m2", "m3"}


def test_first_seen_ignores_null_identity(spark):
    df = spark.createDataFrame([("a", 1, "k"), ("b", 2, "k"), ("c", 3, None), ("d", 4, None)], "document_id string, intake_seq int, document_identity string")
    got = {r.document_id: r.possible_duplicate_of for r in analytics.possible_duplicates(df).collect()}
    assert got == {"a": None, "b": "a", "c": None, "d": None}


def test_account_key(spark):
    assert _one(spark, "Acct No. ab-12 3", values.account_key) == "AB123" and _one(spark, " - ", values.account_key) is None


def test_near_anchor_grows_with_the_pitch(spark):
    one = spark.range(1)
    for ys, near in (([0.0, 28.0, 56.0, 84.0], True), ([0.0, 14.0, 28.0, 42.0], False), ([0.0, 28.0, 56.0], False)):
        pitch = geometry.page_pitch(F.array(*map(F.lit, ys)))
        page = {"anchor_x": F.lit(50.0), "anchor_y": F.lit(100.0), "pitch": pitch, "tolerance": F.lit(2.5)}
        got = one.select(*[geometry.in_region("near-anchor", {"x0": F.lit(x), "y0": F.lit(y)}, page).alias(f"c{i}") for i, (x, y) in enumerate([(500.0, 100.0), (60.0, 170.0), (60.0, 97.2), (60.0, 130.0)])]).first()
        assert list(got) == [near, near, False, True]


def test_persona_rules():
    import json

    from quillstone.plans.persona import PersonaError, parse_persona, undeclared_risk_fields, validate_persona

    good = {"field": "total_printed", "anchor": "Amount Due", "pattern": "currency", "region": "same-row", "adjust": "trim"}
    names = ["total_printed", "invoice_number", "vendor_name"]

    def check(*selectors, **more):
        base = {"sender_fingerprint": "p|v", "doc_type": "invoice", "field_selectors": list(selectors)}
        required = more.pop("required", ())
        return validate_persona(parse_persona(json.dumps(base | more)), registered=names, required=required)

    p = check(good)
    assert p.selectors[0]["adjust"] == ["trim"] and undeclared_risk_fields(p, names) == ["invoice_number", "vendor_name"]
    bad = {
        "V1": [good | {"field": "other"}], "V2": [good | {"adjust": ["shout"]}], "V3": [good | {"region": "corner"}], "V4": [good | {"pattern": "a*"}],
        "V5": [{k: v for k, v in good.items() if k != "region"}, good | {"field": "vendor_name"}], "V6": [good | {"pattern": "[0-9]{5}", "region": "any-page"}],
        "V7": [{"scanline": True, "asserts": [{"field": "vendor_name"}]}], "V8": [{"row_group": "g", "columns": {}, "sub_group": {"sub_group": {}}}], "V9": [{"row_group": "g", "columns": {}, "row_count": {"min": 3, "max": 3}}],
        "V10": [good | {"field": "amount_payable"}], "V14": [{"field": "vendor_name", "pattern": "(ACME)", "region": "any-page"}],
    }
    for rule, selectors in bad.items():
        with pytest.raises(PersonaError) as e:
            check(*selectors)
        assert e.value.rule == rule
    for rule, more in (("V11", {"note": "x" * (64 << 10)}), ("V12", {"few_shot_examples": [{}] * 4}), ("V12", {"few_shot_examples": [{"tags": ["flattened_annotations"]}]}), ("V13", {"required": ["invoice_number"]})):
        with pytest.raises(PersonaError) as e:
            check(good, **more)
        assert e.value.rule == rule
    check(good, required=["invoice_number"], status="draft")
    check(good, required=["vendor_name"], ops=["resolve_vendor_alias"])


def test_table_stops_at_gap_and_subtotal(spark):
    from quillstone.operators import executor

    def page(*rows):
        words = [(t, float(x), float(y), float(x + 6 * len(t)), float(y + 10)) for y, cells in rows for x, t in cells]
        return geometry.lines(spark.createDataFrame([(1, 1, words, 3.0)], f"document_id int, page_number int, words {readers.WORD_TYPE}, line_tolerance double"))

    head = (10, [(20, "Item"), (200, "Amount")])
    rows = [(24, [(20, "a"), (200, "1.00")]), (38, [(20, "b"), (200, "2.00")]), (52, [(20, "sum"), (200, "3.00")]), (66, [(20, "c"), (200, "9.00")])]
    group = {"table_anchor": "Item", "column_headers": {"item": "Item", "amount": "Amount"}, "columns": {"item": "text", "amount": "currency"}}
    got = lambda lines, **more: [r.cells["item"] for r in executor.row_groups(lines, group | more).orderBy("row").collect()]
    assert got(page(head, *rows)) == ["a", "b", "sum", "c"]
    assert got(page(head, *rows), stop_at_subtotal=True, amount="amount") == ["a", "b"]
    assert got(page(head, *rows, (140, [(20, "far"), (200, "1.00")]))) == ["a", "b", "sum", "c"]
    assert got(page(head, rows[0], (38, [(20, "no amount")]), rows[2]), require_amount=True) == ["a", "sum"]
    assert got(page((10, [(20, "none")]))) == []


@pytest.mark.parametrize("text,want", [("Total: done! caf\u00e9 plain", 0.5), ("", 0.0), ("na\u00efve rhythm ok", 2 / 3)])
def test_noise(spark, text, want):
    from quillstone.operators import classify

    assert abs(_one(spark, text, classify.noise_ratio) - want) < 1e-9


def test_table_words_and_last_tokens(spark):
    from quillstone.operators import classify

    r = spark.range(1).select(
        classify.money_table_present(F.array(F.lit("12.1234 3.1 4.5"))), classify.money_table_present(F.array(F.lit("1,000.00 2.50 .75 x"), F.lit("1,0.00 22.50 3.75"))),
        classify.second_to_last_token_nonzero(F.array(F.lit(5.0))), classify.second_to_last_token_nonzero(F.array(F.lit(0.0), F.lit(5.0))), classify.second_to_last_token_nonzero(F.array().cast("array<double>")),
    ).first()
    assert tuple(r) == (False, True, True, False, False)


def test_restricted_patterns_know_classes_and_groups():
    for good in ("[*+]{1,3}", r"\*\+", "(a{1,3})?b", "(?:ab){2}", "x{2,5}"):
        assert patterns.compile_restricted(good) == good
    for bad in ("(?:a{1,2}){3}", "a{2,}", "a?+", "(?>a)", "(?P<x>a)(?P=x)", "((?:a?)b){2}", ""):
        with pytest.raises(patterns.PatternError):
            patterns.compile_restricted(bad)


@pytest.mark.parametrize("name", ["executor_fields", "executor_row_groups"])
def test_executor_reads_and_shuffles_pages_once(spark, name):
    plan = core.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and len(re.findall(r"\bExchange ", plan)) == 1 and "Join" not in plan


def test_fields_over_pages(spark):
    from quillstone.operators import executor

    word = lambda t, x, y: (t, float(x), float(y), float(x + 6 * len(t)), float(y + 10))
    pages = [
        (1, 1, [word("Due:", 20, 10), word("5.00", 80, 10), word("x", 20, 30), word("1.00", 80, 30)], 3.0),
        (1, 2, [word("Due", 20, 10), word("7.00", 80, 10), word("2.00", 20, 30)], 3.0),
        (2, 1, [word("Owing", 20, 10), word("Due", 80, 10), word("3.00", 140, 10)], 3.0),
        (3, 1, [word("nothing", 20, 10)], 3.0),
        (None, 1, [word("Due", 20, 10), word("9.00", 80, 10)], 3.0),
    ]
    lines = geometry.lines(spark.createDataFrame(pages, f"document_id int, page_number int, words {readers.WORD_TYPE}, line_tolerance double"))
    selectors = [
        {"field": "first", "anchor": "Due", "pattern": "currency", "region": "same-row"},
        {"field": "last", "anchor": "due", "anchor_occurrence": "last", "pattern": "currency", "region": "same-row"},
        {"field": "wide", "anchor": "Nowhere", "anchor_alts": ["Owing Due", "Due"], "pattern": "currency"},
        {"field": "all", "pattern": "currency", "capture": "all_matches"},
    ]
    got = {(r.document_id, r.field): (r.value, float(r.quality), r.modifiers) for r in executor.fields(lines, selectors).collect()}
    alt, one, bare = executor.MATCH_QUALITY["alternate"], executor.MATCH_QUALITY["anchored"], executor.MATCH_QUALITY["region"]
    assert got == {
        (1, "first"): ("5.0000", float(one), []), (1, "last"): ("7.0000", float(one), []), (1, "wide"): ("5.0000", float(alt), ["anchor_alt_used", "ambiguous_anchor"]),
        (1, "all"): ("5.0000\n1.0000\n7.0000\n2.0000", float(bare), []),
        (2, "first"): ("3.0000", float(one), []), (2, "last"): ("3.0000", float(one), []), (2, "wide"): ("3.0000", float(alt), ["anchor_alt_used"]), (2, "all"): ("3.0000", float(bare), []),
    }

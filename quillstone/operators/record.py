"""The emitted record: one row a document, and its contract as a column of violations.

Types are held by the schema (money crosses as text, rows are maps of text), so
the checks that remain are those of values.  A record that breaks the contract
is degraded, never dropped: count in equals count out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Schema of a record (fixed values: the contract's keys, in its order).
RECORD = """schema_version string, document_id string, doc_type string, tags array<string>, sender_fingerprint string, text_source string, page_roles array<string>,
fields map<string,string>, derived map<string,string>, confidence map<string,double>, confidence_modifiers array<string>,
extraction_coverage struct<declared:int,populated:int,missing_required:array<string>,complete:boolean>,
reference_list array<struct<value:string,source_field:string,page:int,pattern_id:string>>,
line_items array<map<string,string>>, charges array<map<string,string>>, sub_account array<map<string,string>>,
scanline string, extraction_rule_version string, extraction_route string, possible_duplicate_of string, disposition string, reason string,
review_flag boolean, regen_flag boolean, audit_sample boolean, lane string, events array<string>"""
DISPOSITIONS = ("processed", "skipped", "dead_letter")
IDENTITY = ("document_identity", "identity_basis")
SCHEMA_VERSION, CEILING = "1.0", 0.99
_EMPTY = {"array<string>": "array()", "map<string,string>": "map()", "map<string,double>": "map()"}


def build_record(documents: DataFrame) -> DataFrame:
    """All keys of a record from what stages have left; an absent one gets its empty value.

    Lists and maps are empty, flags false, coverage that of nothing assessed
    (not complete); a null list, map or flag is treated as absent.
    """
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(RECORD)
    nothing = F.struct(F.lit(0).alias("declared"), F.lit(0).alias("populated"), F.array().cast("array<string>").alias("missing_required"), F.lit(False).alias("complete"))

    def value(field) -> Column:
        kind = field.dataType.simpleString()
        given = F.col(field.name).cast(field.dataType) if field.name in documents.columns else F.lit(None).cast(field.dataType)
        if field.name == "schema_version":
            return F.lit(SCHEMA_VERSION)
        if field.name == "extraction_coverage":
            return F.coalesce(given, nothing.cast(field.dataType))
        if kind == "boolean":
            return F.coalesce(given, F.lit(False))
        if kind.startswith("array"):
            return F.coalesce(given, F.array().cast(field.dataType))
        if kind.startswith("map"):
            return F.coalesce(given, F.create_map().cast(field.dataType))
        return given

    return documents.select(*(value(f).alias(f.name) for f in schema.fields))


def violations() -> Column:
    """Names of the broken rules of a record, an empty array if it keeps the contract."""
    c, done = F.col, F.col("disposition") == "processed"
    cover = F.col("extraction_coverage")
    blank = lambda x: x.isNull() | (x == "")
    full = (F.size(cover["missing_required"]) == 0) & (cover["populated"] == cover["declared"])
    rules = {
        "disposition": ~F.coalesce(c("disposition").isin(*DISPOSITIONS), F.lit(False)),
        "doc_type": done & blank(c("doc_type")),
        "identity_keys": done & ~F.forall(F.array(*map(F.lit, IDENTITY)), lambda k: F.map_contains_key("derived", k)),
        "document_id": blank(c("document_id")),
        "confidence_range": F.exists(F.map_values("confidence"), lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v > CEILING)),
        "reference_shape": F.exists("reference_list", lambda r: r["value"].isNull() | r["source_field"].isNull() | r["pattern_id"].isNull() | r["page"].isNull()),
        "reference_page": F.exists("reference_list", lambda r: r["page"] < 1),
        "coverage_counts": cover["declared"].isNull() | cover["populated"].isNull() | cover["complete"].isNull() | (cover["declared"] < 0) | (cover["populated"] < 0),
        "coverage_order": cover["populated"] > cover["declared"],
        "coverage_names": cover["missing_required"].isNull() | F.exists(cover["missing_required"], lambda m: m.isNull()),
        "coverage_complete": cover["complete"] & ~full,
        "row_shape": F.exists(F.concat("line_items", "charges", "sub_account"), lambda r: r.isNull()),
        "scanline": c("scanline").isNotNull() & ~c("scanline").rlike("^[0-9 ]+$"),
    }
    return F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items())), lambda x: x.isNotNull())


def validate_record(records: DataFrame) -> DataFrame:
    """Records with ``violations``; one that has any becomes a dead letter that says why, to be reviewed."""
    marked = records.withColumn("violations", violations())
    bad = F.size("violations") > 0
    return marked.withColumns({
        "disposition": F.when(bad, "dead_letter").otherwise(F.col("disposition")),
        "reason": F.when(bad, F.concat(F.lit("contract: "), F.array_join("violations", ", "))).otherwise(F.col("reason")),
        "review_flag": F.col("review_flag") | bad,
    })


def process(intake: DataFrame, emitted: DataFrame) -> DataFrame:
    """``(intaken, emitted, missing, complete)``: whether each document taken in came out once."""
    ins, outs = intake.select("document_id").distinct(), emitted.groupBy("document_id").agg(F.count("*").alias("n"))
    j = ins.join(outs, "document_id", "left")
    g = j.agg(F.count("*").alias("intaken"), F.coalesce(F.sum("n"), F.lit(0)).alias("emitted"), F.count_if(F.col("n").isNull()).alias("missing"))
    return g.withColumn("complete", (F.col("intaken") == F.col("emitted")) & (F.col("missing") == 0))

"""Batch analytics over records: duplicates, reconciliation, queue, telemetry, scoring, export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.values import account_key, escape_formula

IDENTIFIERS = ("account_number", "circuit_id", "contract_number", "supersedes_contract_number")
VARIANCE = 0.02


def possible_duplicates(records: DataFrame, identity: str = "document_identity", order: Sequence[str] = ("intake_seq",)) -> DataFrame:
    """Add ``possible_duplicate_of``: the first document of the same identity, null for itself and without identity.

    The first of each identity is an aggregate with map-side combining, joined
    back, so a very common identity is no single task's window.
    """
    key = F.struct(*order, "document_id")
    firsts = records.where(F.col(identity).isNotNull()).groupBy(identity).agg(F.min(key).alias("_first"))
    j = records.join(firsts, identity, "left")
    return j.withColumn("possible_duplicate_of", F.when(F.col("_first.document_id") != F.col("document_id"), F.col("_first.document_id"))).drop("_first")


def contract_candidates(invoices: DataFrame, contracts: DataFrame) -> DataFrame:
    """``(invoice_id, contract_id)`` pairs of equal sender (null equals null) that share a canonical identifier.

    Both sides have ``sender_fingerprint`` and the identifier columns.
    """
    keys = lambda df, me: df.select(
        me, "sender_fingerprint", F.explode(F.array_distinct(F.filter(F.array(*(account_key(F.col(c)) for c in IDENTIFIERS if c in df.columns)), lambda x: x.isNotNull()))).alias("key")
    )
    i, c = keys(invoices, "invoice_id"), keys(contracts, "contract_id").withColumnRenamed("sender_fingerprint", "_sender")
    return i.join(c, (i.key == c.key) & i.sender_fingerprint.eqNullSafe(c._sender)).select("invoice_id", "contract_id").distinct()


def resolve_contracts(invoices: DataFrame, contracts: DataFrame) -> DataFrame:
    """``(invoice_id, bill_date, candidates, contract_id, state)`` of every invoice.

    One candidate is taken as it is.  Of several, those whose window brackets
    the bill date count: one is taken; of more the latest start; equal latest
    starts, no bracket, or no bill date are ambiguous.  Dates are ISO texts.
    """
    pairs = contract_candidates(invoices, contracts)
    j = pairs.join(invoices.select("invoice_id", "bill_date"), "invoice_id").join(contracts.select("contract_id", "start_date", "end_date"), "contract_id")
    inside = (F.col("start_date") <= F.col("bill_date")) & (F.col("end_date").isNull() | (F.col("bill_date") <= F.col("end_date")))
    g = j.groupBy("invoice_id").agg(
        F.count("*").alias("candidates"), F.min("contract_id").alias("only"), F.max(F.when(inside, F.col("start_date"))).alias("latest"), F.count_if(inside).alias("brackets")
    )
    best = j.where(inside).join(g.select("invoice_id", "latest"), "invoice_id").where(F.col("start_date") == F.col("latest"))
    best = best.groupBy("invoice_id").agg(F.count("*").alias("ties"), F.min("contract_id").alias("picked"))
    out = invoices.select("invoice_id", "bill_date").join(g, "invoice_id", "left").join(best, "invoice_id", "left")
    n = F.coalesce("candidates", F.lit(0))
    state = F.when(n == 0, "none").when(n == 1, "matched").when(F.col("ties") == 1, "matched").otherwise("ambiguous")
    return out.select("invoice_id", "bill_date", n.alias("candidates"), F.when(n == 1, F.col("only")).when(state == "matched", F.col("picked")).alias("contract_id"), state.alias("state"))


def findings(resolved: DataFrame, contracts: DataFrame, charges: DataFrame) -> DataFrame:
    """``(invoice_id, finding)``: ambiguous, none, billed after expiry, rate variance above 2 percent, else clean."""
    j = resolved.join(contracts.select("contract_id", "end_date", "contracted_rate"), "contract_id", "left").join(charges.select("invoice_id", "charged"), "invoice_id", "left")
    variance = (F.col("charged") - F.col("contracted_rate")) / F.nullif(F.col("contracted_rate"), F.lit(0))
    kind = (
        F.when(F.col("state") == "ambiguous", "contract_precedence_ambiguous")
        .when(F.col("state") == "none", "no_matching_contract")
        .when(F.col("end_date").isNotNull() & (F.col("bill_date") > F.col("end_date")), "billed_after_contract_expiry")
        .when((F.col("contracted_rate") > 0) & (F.abs(variance) > VARIANCE), "rate_mismatch")
        .otherwise("clean")
    )
    return j.select("invoice_id", kind.alias("finding"))


def enqueue_once(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` that single flight admits: not queued before, whatever the status, and once among themselves.

    The key is (kind, sender, type, match key); a null sender is never
    admitted, a null type never equals another.
    """
    key = ["kind", "sender_fingerprint", "doc_type", "match_key"]
    fresh = new.where("sender_fingerprint is not null")
    typed = fresh.where("doc_type is not null").join(jobs.select(*key), key, "left_anti")
    once = typed.groupBy(*key).agg(F.min(F.struct("created_at", "job_id")).alias("m")).select("m.job_id")
    return fresh.join(once, "job_id", "left_semi").unionByName(fresh.where("doc_type is null"))


def latest_state(log: DataFrame, key: str = "job_id", at: str = "updated_at") -> DataFrame:
    """The last row of each key of an append-only log."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(at)).alias("r")).select(key, "r.*")


def queue_status(jobs: DataFrame, now: Column) -> DataFrame:
    """Open jobs by kind with the age in hours of the oldest, and the total (kind null)."""
    open_ = jobs.where(F.col("status") == "open")
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.min("created_at"))) / 3600)
    return open_.rollup("kind").agg(F.count("*").alias("open_jobs"), age.alias("oldest_hours"))


def telemetry(lines: DataFrame, since: Column | None = None) -> DataFrame:
    """Totals, counts by disposition, rates and mean confidence of telemetry lines."""
    t = lines if since is None else lines.where(F.col("logged_at") >= since)
    return t.agg(
        F.count("*").alias("total"), F.count_if(F.col("disposition") == "dead_letter").alias("dead_letters"),
        F.round(F.coalesce(F.avg((F.col("disposition") == "dead_letter").cast("double")), F.lit(0.0)), 4).alias("dead_letter_rate"),
        F.round(F.coalesce(F.avg(F.col("review_flag").cast("double")), F.lit(0.0)), 4).alias("escalation_rate"), F.round(F.avg("mean_confidence"), 4).alias("mean_confidence"),
    )


def problem_records(lines: DataFrame) -> DataFrame:
    return lines.where((F.col("disposition") == "dead_letter") | F.col("lane").isin("review", "low"))


def assertion_passes(kind: Column, expected: Column, actual: Column) -> Column:
    """Compare a gold value with a record's: exact, money, text, address, superset or set (lists joined by ``|``)."""
    money = lambda c: F.regexp_replace(c, "[$€£, ]", "").try_cast("decimal(38,4)")
    words = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    alnum = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    items = lambda c: F.array_distinct(F.split(c, r"\|"))
    hit = (
        F.when(kind == "money", money(expected).eqNullSafe(money(actual)))
        .when(kind == "text", words(expected) == words(actual))
        .when(kind == "address", alnum(expected) == alnum(actual))
        .when(kind == "superset", F.size(F.array_except(items(expected), items(actual))) == 0)
        .when(kind == "set", F.array_sort(items(expected)) == F.array_sort(items(actual)))
        .otherwise(expected.eqNullSafe(actual))
    )
    return F.coalesce(hit, expected.isNull() & actual.isNull())


def scorecard(assertions: DataFrame) -> DataFrame:
    """Per document: assertions, passed ones, and whether all passed."""
    return assertions.groupBy("gold_id").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.bool_and("passed").alias("all_passed"))


def accuracy(cards: DataFrame) -> DataFrame:
    """Documents and fully correct ones by pack, by type, and in all."""
    return cards.groupingSets([["pack"], ["doc_type"], []], "pack", "doc_type").agg(F.count("*").alias("documents"), F.count_if("all_passed").alias("correct"))


def regressions(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Assertions that the baseline passes and the candidate explicitly fails."""
    b = baseline.select("gold_id", "name", F.col("passed").alias("was"))
    return b.join(candidate.select("gold_id", "name", F.col("passed").alias("now")), ["gold_id", "name"]).where(F.col("was") & ~F.col("now")).select("gold_id", "name")


def export_layout(records: DataFrame, layout: Mapping[str, Column]) -> DataFrame:
    """A closed projection; text that a spreadsheet would run is escaped."""
    out = records.select(*(c.alias(n) for n, c in layout.items()))
    return out.select(*(escape_formula(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in out.dtypes))


def cassette_replay(requests: DataFrame, cassette: DataFrame) -> DataFrame:
    """Recorded answers by request hash; a request without one is a permanent error in its own row."""
    j = requests.join(cassette, "key", "left")
    return j.withColumn("error", F.when(F.col("answer").isNull(), "no recorded answer"))


def subtotal_stop(rows: DataFrame, group: str, order: Sequence[str], amount: str) -> DataFrame:
    """Rows of each group up to, not including, the first that equals the sum of the rows before (two at least, not zero)."""
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    r = rows.withColumn("_sum", F.sum(amount).over(before)).withColumn("_n", F.count(amount).over(before))
    stop = (F.col("_n") >= 2) & (F.col("_sum") != 0) & (F.col(amount) == F.col("_sum"))
    upto = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("_stopped", F.max(stop.cast("int")).over(upto)).where(F.coalesce("_stopped", F.lit(0)) == 0).drop("_sum", "_n", "_stopped")

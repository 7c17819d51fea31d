"""Sources: files, mails and text formats to pages of positioned words.

Formats that need an image or office library are ports: they raise
:class:`PermanentError` for a document when the library is missing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_HEIGHT, CHAR_WIDTH = 12.0, 6.0
SPACE = r"[ \t\n\x0B\f\r]+"
WORD_TYPE = "array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>"
SUFFIXES = (".txt", ".csv", ".html", ".htm", ".eml", ".msg", ".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".docx", ".xlsx")
PAGE_CEILING = 750
OCR_BELOW_CHARS = 29


class PermanentError(RuntimeError):
    """A document that can never be read."""


class TransientError(RuntimeError):
    """A failure that a retry may cure."""


def stable_id(path: Column, size: Column) -> Column:
    """``fs-`` and 16 hex digits of the hash of path and size."""
    return F.concat(F.lit("fs-"), F.substring(F.sha2(F.concat_ws("|", path, size.cast("string")), 256), 1, 16))


def soft_fingerprint(sender: Column, name: Column, size: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.coalesce(sender, F.lit("")), name, size.cast("string")), 256), 1, 16)


def filesystem_intake(spark: SparkSession, path: str, *, with_content: bool = False) -> DataFrame:
    """One row per supported file below ``path``, in path order: ``document_id, source_path, suffix, length, intake_seq``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    keep = ["path", "length"] + (["content"] if with_content else [])
    got = files.select(*keep, suffix.alias("suffix")).where(F.col("suffix").isin(*SUFFIXES))
    # the hash orders nothing; the path does, so first-seen semantics do not depend on task order
    return got.withColumn("document_id", stable_id(F.col("path"), F.col("length"))).withColumn("intake_seq", F.col("path")).withColumnRenamed("path", "source_path")


def email_intake(messages: DataFrame) -> DataFrame:
    """One row per non-empty attachment of ``messages(path, content)``.

    A bad attachment is skipped alone; an unreadable mail, or one without
    attachments, gives one fallback row, so no mail is lost.
    """
    ddl = "document_id string, source_path string, sender_email string, email_id string, suffix string, content binary"

    def expand(frames):
        import hashlib
        from email import message_from_bytes, policy
        from email.utils import parseaddr

        for pdf in frames:
            out = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                raw = bytes(raw or b"")
                key, sender, found = hashlib.sha256(raw).hexdigest()[:16], None, 0
                try:
                    mail = message_from_bytes(raw, policy=policy.default)
                    sender = parseaddr(str(mail.get("From") or ""))[1] or None
                    if mail.get("Message-Id"):
                        key = hashlib.sha256(str(mail["Message-Id"]).strip().encode()).hexdigest()[:16]
                    for part in mail.iter_attachments():
                        try:
                            data = part.get_payload(decode=True)
                            name = part.get_filename() or ""
                        except Exception:  # noqa: BLE001  one broken part must not cost the others
                            continue
                        if data:
                            out.append((f"em-{key}-{found}", f"{path}#{name}", sender, key, ("." + name.rpartition(".")[2].lower()) if "." in name else "", data))
                            found += 1
                except Exception:  # noqa: BLE001  an unreadable mail still gives its fallback row
                    found = 0
                if not found:
                    out.append((f"em-{key}", path, sender, key, ".eml", None))
            yield pd.DataFrame(out, columns=["document_id", "source_path", "sender_email", "email_id", "suffix", "content"])

    return messages.select("path", "content").mapInPandas(expand, ddl)


def text_rows(text: Column) -> Column:
    """Rows of a text file: an array of token arrays; blank lines stay as empty rows."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    return F.transform(lines, lambda x: F.filter(F.split(x, SPACE), lambda w: w != ""))


def csv_rows(text: Column) -> Column:
    """Rows of a CSV file; every cell is one word, quotes may enclose commas."""
    lines = F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: x != "")
    cell = r'"((?:[^"]|"")*)"|([^,"]+)'
    return F.transform(
        lines,
        lambda x: F.filter(
            F.transform(F.regexp_extract_all(x, F.lit(cell), F.lit(0)), lambda c: F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"')), lambda w: F.trim(w) != ""
        ),
    )


def html_text(html: Column) -> Column:
    """Visible text: scripts and styles dropped, block tags as line breaks, cells as spaces, basic entities decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)</?(p|div|br|tr|table|ul|ol|li|h[1-6]|section|article|nav|header|footer|title|body|html|head)[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?i)</?(td|th)[^>]*>", " ")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return t


def html_rows(html: Column) -> Column:
    """Rows of a page's visible text; blank lines are dropped."""
    return F.filter(text_rows(html_text(html)), lambda r: F.size(r) > 0)


def grid_words(rows: Column) -> Column:
    """Positioned words of token rows on the synthetic grid (row 12 points, character 6)."""

    def place(tokens: Column, i: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(WORD_TYPE).alias("out"))
        step = lambda acc, w: F.struct(
            (acc.at + F.length(w) + 1).alias("at"),
            F.concat(
                acc.out,
                F.array(
                    F.struct(
                        w.alias("text"), (acc.at * CHAR_WIDTH).alias("x0"), (i * ROW_HEIGHT).alias("y0"), ((acc.at + F.length(w)) * CHAR_WIDTH).alias("x1"), ((i + 1) * ROW_HEIGHT).alias("y1")
                    )
                ),
            ).cast(WORD_TYPE).alias("out"),
        )
        return F.aggregate(tokens, start, step, lambda acc: acc.out)

    return F.flatten(F.transform(rows, place))


def load_pages(files: DataFrame) -> DataFrame:
    """One native page for each text-like file of ``files(document_id, suffix, content string)``."""
    text = F.col("content").cast("string")
    rows = F.when(F.col("suffix") == ".csv", csv_rows(text)).when(F.col("suffix").isin(".html", ".htm"), html_rows(text)).otherwise(text_rows(text))
    return files.select("document_id", F.lit(1).alias("page_number"), grid_words(rows).alias("words"), F.lit("native").alias("source"), F.lit(3.0).alias("line_tolerance"))


def needs_ocr(char_count: Column) -> Column:
    return char_count < OCR_BELOW_CHARS


def read_with_port(files: DataFrame, port, ddl: str) -> DataFrame:
    """Run a reader port over ``files``; each row carries its own error instead of failing the job."""

    def run(frames):
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                try:
                    out.append({"document_id": row.document_id, "value": port(bytes(row.content)), "error": None})
                except Exception as e:  # noqa: BLE001  the error is the document's result
                    out.append({"document_id": row.document_id, "value": None, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=["document_id", "value", "error"])

    return files.select("document_id", "content").mapInPandas(run, f"document_id string, value {ddl}, error string")


def pdf_port(data: bytes):
    """Words of a PDF; needs the optional library."""
    try:
        import pdfplumber
    except ImportError as e:
        raise PermanentError("reading PDF needs pdfplumber") from e
    import io

    with pdfplumber.open(io.BytesIO(data)) as pdf:
        return [[(w["text"], w["x0"], w["top"], w["x1"], w["bottom"]) for w in p.extract_words()] for p in pdf.pages]


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per line; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)

"""Token-id files: patched frame-of-reference blocks (operator 6).

File (all integers little-endian)::

    magic "QPF1", u4 partition, u4 sequence, u4 documents, u8 ids, u4 block length
    i8 doc_id[documents], u1 null_id[documents], u8 doc_start[documents]   (start within the file)
    u8 block_start[blocks + 1]                                             (byte offsets within the block area)
    blocks: u4 minimum, u1 width, u2 ids, u2 exceptions,
            packed low ``width`` bits of (id - minimum), bytes rounded up,
            u2 exception positions, u4 exception values (id - minimum, whole)
    one line feed

A block subtracts its minimum, packs the differences with the width that holds
``PERCENTILE`` percent of them and keeps the others whole in an exception list,
so one stray id does not widen a block.  The block index lets a reader decode
any id range alone (:func:`read_range`).

Writing: a sample of ids and lengths cuts ``doc_id`` into ranges of about equal
bytes; one narrow pass encodes each text and names its range; the ids, not the
texts, are shuffled to the ranges, sorted and packed.  Nothing but the files is
written.  Spark's own writer commits them, so a lost executor or a repeated
task never leaves half a file; its text format copies a value's bytes as they
are and adds one line feed, which is the file's last byte (the cast from binary
to string does not check or change bytes; a test writes every byte value).
Files hold at most ``FILE_IDS`` ids; a longer document has a file of its own.
Start offsets are prefix sums in two levels, files within groups of files, so
no task sees more than a group.

Defined results: null text is the empty text (its ids are the end id alone);
null ``doc_id`` sorts first and is kept; repeated rows are each written, in the
order of their ids' bytes; an empty table writes no files and reads as empty;
other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.bpe import PLAIN_BELOW, SLICE_BYTES, _byte_alphabet, _ranges
from quillstone.llm.common import Scratch, slices, spread, to_batch, trim

MAGIC = b"QPF1"
BLOCK = 1024
PERCENTILE = 90
FILE_IDS = 4 << 20
HEAD = np.dtype([("magic", "S4"), ("part", "<u4"), ("seq", "<u4"), ("docs", "<u4"), ("ids", "<u8"), ("block", "<u4")])
BLOCK_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("n", "<u2"), ("odd", "<u2")])
CACHE_PIECES, CACHED_LENGTH = 600_000, 64
SAMPLE_PER_TASK = 200
MOST_TASKS = 100_000


# ---------------------------------------------------------------- blocks


def pack_block(values: np.ndarray) -> bytes:
    low = int(values.min())
    rest = (values - low).astype(np.uint32)
    at = (len(rest) * PERCENTILE + 99) // 100 - 1
    width = int(np.partition(rest, at)[at]).bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little") if width else np.empty(0, np.uint8)
    head = np.array([(low, width, len(rest), len(odd))], BLOCK_HEAD)
    return b"".join([head.tobytes(), np.packbits(bits, bitorder="little").tobytes(), odd.astype("<u2").tobytes(), rest[odd].astype("<u4").tobytes()])


def unpack_block(data: memoryview, at: int) -> np.ndarray:
    low, width, n, odd = np.frombuffer(data, BLOCK_HEAD, 1, at)[0]
    low, width, n, odd = int(low), int(width), int(n), int(odd)
    at += BLOCK_HEAD.itemsize
    size = (n * width + 7) // 8
    whole = np.zeros((n, 32), np.uint8)
    if width:
        whole[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    out = np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel()
    at += size
    if odd:
        where = np.frombuffer(data, "<u2", odd, at)
        out[where] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
    return out + np.uint32(low)


def pack_file(part: int, seq: int, doc_ids: list, ids: list[np.ndarray]) -> bytes:
    size = np.array([len(x) for x in ids], np.uint64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype("<u8") if len(ids) else np.empty(0, "<u8")
    flat = np.concatenate(ids).astype(np.uint32) if ids else np.empty(0, np.uint32)
    blocks = [pack_block(flat[i : i + BLOCK]) for i in range(0, len(flat), BLOCK)]
    index = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = np.array([(MAGIC, part, seq, len(ids), len(flat), BLOCK)], HEAD)
    key = np.array([0 if d is None else d for d in doc_ids], "<i8")
    none = np.array([d is None for d in doc_ids], "u1")
    return b"".join([head.tobytes(), key.tobytes(), none.tobytes(), start.tobytes(), index.tobytes(), *blocks, b"\n"])


class TokenFile:
    """Reader of one file's bytes."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        h = np.frombuffer(self.data, HEAD, 1)[0]
        if h["magic"] != MAGIC:
            raise ValueError("not a token file")
        self.part, self.seq, self.docs, self.ids, self.block = (int(h[k]) for k in ("part", "seq", "docs", "ids", "block"))
        at = HEAD.itemsize
        self.doc_ids = np.frombuffer(self.data, "<i8", self.docs, at)
        self.null_id = np.frombuffer(self.data, "u1", self.docs, at + 8 * self.docs)
        self.starts = np.frombuffer(self.data, "<u8", self.docs, at + 9 * self.docs).astype(np.int64)
        at += 17 * self.docs
        n = -(-self.ids // self.block)
        self.index = np.frombuffer(self.data, "<u8", n + 1, at).astype(np.int64)
        self.area = at + 8 * (n + 1)

    def read_range(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; only their blocks are decoded."""
        if stop <= start:
            return np.empty(0, np.uint32)
        a, b = start // self.block, -(-stop // self.block)
        got = [unpack_block(self.data, self.area + int(self.index[i])) for i in range(a, b)]
        return np.concatenate(got)[start - a * self.block : stop - a * self.block]

    def documents(self):
        """``(doc_id or None, start, ids)`` in file order, decoding a bounded run of blocks at a time."""
        stops = np.append(self.starts[1:], self.ids)
        at = 0
        while at < self.docs:
            to = max(at + 1, int(np.searchsorted(stops, self.starts[at] + (1 << 20), "right")))
            first = int(self.starts[at])
            flat = self.read_range(first, int(stops[to - 1]))
            for i in range(at, to):
                yield (None if self.null_id[i] else int(self.doc_ids[i])), int(self.starts[i]), flat[self.starts[i] - first : stops[i] - first]
            at = to


# ---------------------------------------------------------------- encoding with the library


class _Words(dict):
    """Word -> ids as little-endian u4 bytes; at most CACHE_PIECES words of at most CACHED_LENGTH characters (about 100 MB).

    A word, as cut and folded, goes to the library's model itself, in the
    byte-level alphabet, which spares the library's search for words and offsets.
    """

    def __init__(self, lib):
        super().__init__()
        self.tokenize = lib.model.tokenize
        self.char = {b: c for c, b in _byte_alphabet().items()}

    def __missing__(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()  # these stand for themselves
        ids = array("I", [t.id for t in self.tokenize(word if plain else "".join(map(self.char.__getitem__, word.encode("utf-8"))))])
        if sys.byteorder == "big":
            ids.byteswap()
        raw = ids.tobytes()
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[word] = raw
        return raw


class WordTokenizer:
    """The tokenizers library behind a bounded cache of words.

    The file's normaliser folds case and its pre-tokenizer encodes each word on
    its own, so a word's ids do not depend on its neighbours.  Texts with
    characters outside the plain range, or with a special token's string, go to
    the library whole.
    """

    WORDS = r"[{L}]+|'(?:[stmd]|re|ve|ll)|[{N}]|[^{Z}{L}{N}]+"

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.largest = max(self.lib.get_vocab(with_added_tokens=True).values())
        by = {"L": _ranges("L"), "N": _ranges("N"), "Z": _ranges("Z", "\t\n\v\f\r\x85")}
        self.find = re.compile("".join(by.get(p, p) for p in re.split(r"\{([LNZ])\}", self.WORDS))).findall
        # combining marks, what folds to them or beyond, and special tokens: left to the library
        folds = "".join(c for c in map(chr, range(0x300)) if max(c.lower()) >= "\u0300")
        self.outside = re.compile(f"[{folds}\u0300-\U0010ffff]|<\\|").search
        assert PLAIN_BELOW >= 0x300
        self.cache = _Words(self.lib)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian u4 bytes, without special tokens."""
        if not text:
            return b""
        if self.outside(text):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.cache.__getitem__, self.find(text.lower())))

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        return list(map(self.encode, texts))


_LOADED: dict[str, WordTokenizer] = {}


def _words(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def forget() -> None:
    """Drop a worker's tokenizers and their caches, which the stages after the encoding do not need."""
    if _LOADED:
        _LOADED.clear()
        trim()


# ---------------------------------------------------------------- Spark


def ranges_of(docs: DataFrame, bytes_per_task: int, seed: int = 5) -> np.ndarray:
    """Upper bounds (exclusive) of ``doc_id`` ranges of about equal bytes, from a sample; one range has none.

    The sample (``SAMPLE_PER_TASK`` rows a task, never above ``MOST_TASKS`` times that) only balances tasks.
    """
    size = docs.select(F.col("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("size"))
    total = docs.count()
    share = min(1.0, 20 * SAMPLE_PER_TASK / max(total, 1))
    mean = size.sample(share, seed).agg(F.avg("size")).first()[0] or 16.0
    tasks = int(min(MOST_TASKS, max(1, -(-total * mean // bytes_per_task))))
    if tasks == 1:
        return np.empty(0, np.int64)
    got = size.sample(min(1.0, SAMPLE_PER_TASK * tasks / total), seed).where("doc_id is not null").toPandas().sort_values("doc_id")
    ids, to = got["doc_id"].to_numpy(np.int64), got["size"].to_numpy(np.float64).cumsum()
    if not len(ids):
        return np.empty(0, np.int64)
    return np.unique(ids[np.searchsorted(to, to[-1] * np.arange(1, tasks) / tasks)])


def encode(docs: DataFrame, tokenizer_path: str, bounds: np.ndarray, end_id: int = 1) -> DataFrame:
    """``(part, doc_id, n, ids)``: the range, and ids with the end id, as the library gives them.

    Ids are bytes of u2 where every id of the vocabulary fits, else of u4
    (:func:`unpacked`), so that what is shuffled is no wider than needed.
    """
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        w = _words(tokenizer_path)
        width = "<u2" if max(w.largest, end_id) < 1 << 16 else "<u4"
        for s in slices(batches, ["doc_id", "text"], SLICE_BYTES):
            ids = [np.frombuffer(x + tail, "<u4") for x in w.encode_many(s["text"])]
            part = [0 if d is None else int(np.searchsorted(bounds, d, "right")) for d in s["doc_id"]]
            yield to_batch(schema, part=part, doc_id=s["doc_id"], n=[len(x) for x in ids], ids=[x.astype(width).tobytes() for x in ids])

    return docs.select("doc_id", "text").mapInArrow(run, "part int, doc_id long, n long, ids binary")


def unpacked(raw: bytes, n: int) -> np.ndarray:
    """The ``n`` ids that :func:`encode` put into ``raw``."""
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def as_text(files: DataFrame) -> DataFrame:
    """The bytes of ``file`` less the last, a line feed, as a value that Spark's text writer copies."""
    return files.select(F.expr("substring(file, 1, length(file) - 1)").cast("string").alias("value"))


def write_files(encoded: DataFrame, folder: str, parts: int) -> None:
    """Pack ``(part, doc_id, n, ids)`` into token files under ``folder``, ascending by doc_id."""
    schema = pa.schema([("file", pa.binary())])

    def run(batches):
        forget()
        now, seq, held, keys, rows = None, 0, 0, [], []
        for s in slices(batches, ["part", "doc_id", "n", "ids"]):
            for p, d, n, raw in zip(s["part"], s["doc_id"], s["n"], s["ids"]):
                if rows and (p != now or held + n > FILE_IDS):
                    yield to_batch(schema, file=[pack_file(now, seq, keys, rows)])
                    seq, held, keys, rows = seq + 1, 0, [], []
                now = p
                keys.append(d)
                rows.append(unpacked(raw, n))
                held += n
        if rows:
            yield to_batch(schema, file=[pack_file(now, seq, keys, rows)])

    dealt = encoded.repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", "ids")
    as_text(dealt.select("part", "doc_id", "n", "ids").mapInArrow(run, "file binary")).write.option("maxRecordsPerFile", 1).text(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(part, seq, doc_id, file_start, n_tokens, ids)`` of every document in the files."""
    return _read(spark, folder, pa.field("ids", pa.binary()), "ids binary", lambda ids: ids.astype("<u4").tobytes())


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`read_files` with ``ids_crc32`` in place of ``ids``, so that the ids stay in the worker that unpacks them."""
    return _read(spark, folder, pa.field("ids_crc32", pa.int64()), "ids_crc32 long", crc32)


def _read(spark: SparkSession, folder: str, field: pa.Field, kind: str, value) -> DataFrame:
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("file_start", pa.int64()), ("n_tokens", pa.int64()), field])

    def run(batches):
        forget()
        for batch in batches:
            for raw in batch.column(0):
                f = TokenFile(raw.as_py())
                rows = []
                for d, start, ids in f.documents():
                    rows.append((f.part, f.seq, d, start, len(ids), value(ids)))
                    if len(rows) == 512:
                        yield to_batch(schema, **dict(zip(schema.names, zip(*rows))))
                        rows = []
                if rows:
                    yield to_batch(schema, **dict(zip(schema.names, zip(*rows))))

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, f"part long, seq long, doc_id long, file_start long, n_tokens long, {kind}")


def with_starts(rows: DataFrame) -> DataFrame:
    """Replace ``file_start`` by ``start``, the ids of all documents before, over all files.

    Two levels: files within groups of 1024 consecutive ones, then groups.
    """
    files = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.expr("part div 1024"))
    blocks = files.groupBy("block").agg(F.sum("n").alias("b"))
    before = F.coalesce(F.sum("b").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("block"), before.alias("block_start"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.withColumn("inside", inside).join(blocks, "block").select("part", "seq", (F.col("block_start") + F.col("inside")).alias("base"))
    return rows.join(files, ["part", "seq"]).withColumn("start", F.col("base") + F.col("file_start"))


def token_files(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, bytes_per_task: int = 16 << 20, read=read_files) -> tuple[str, DataFrame]:
    """Write token files of ``docs``; returns their folder and a reader of them."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = Scratch(spark, "pfor").path("files")
    bounds = ranges_of(docs, bytes_per_task)
    write_files(encode(spread(docs), tokenizer_path, bounds, end_id), folder, len(bounds) + 1)
    return folder, read(spark, folder)


def file_digests(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` as read back from the files."""
    spark = docs.sparkSession
    _, small = token_files(docs, tokenizer_path, end_id=end_id, read=read_digests)
    small = Scratch(spark, "pfor").save(small, "digests")
    return with_starts(small).select("doc_id", "start", "n_tokens", "ids_crc32")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())

"""Byte-level BPE by backtracking over longest matches (operator 3).

Encoding.  A text is cut into pieces by the tokenizer's own pre-token pattern.
Each piece is encoded by a backtracking search: an Aho-Corasick automaton over
all token byte strings gives the longest token that starts at each byte;
tokens are taken left to right, and a token may follow another only if the
*pair-compatibility table* says that BPE merging would have left exactly this
boundary.  On a conflict the next shorter token is tried, then the search steps
back; a bit per byte position remembers dead ends, so every position is tried
once and the work is linear in the piece.  The result equals running the merge
list exactly, with no merge loop.

Decoding.  All token byte strings lie in one blob; ``offsets[id]`` to
``offsets[id + 1]`` is a token's slice.  A whole batch is decoded by one gather.

Defined results
* null text: encoded as the empty text: no ids, decoded text ``""``;
* a special token's string in the text is that special token, as in the library;
* rows are independent: repeated rows and ties give repeated results, null
  ``doc_id`` is passed through, an empty table gives an empty table;
* other columns of the input are ignored, whatever their names.

Scale: one narrow pass, no shuffle.  A worker keeps one automaton (about
30 MB); a task keeps at most ``CACHE_PIECES`` pieces of at most ``LONG_PIECE``
characters (about 45 MB) and ``CACHE_PAIRS`` pairs, and drops the pieces when it
ends, so memory does not depend on the corpus; texts are handled in slices of
bounded bytes.
"""

from __future__ import annotations

import hashlib
import json
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillstone.llm.common import slices, spread, to_batch, trim

#: Pre-token pattern of byte-level BPE (fixed value, published with the vocabulary);
#: {L}, {N} and {Z} stand for letters, digits and white space.
BYTE_LEVEL_PATTERN = r" ?[{L}]+| ?[{N}]+|'(?:[stmd]|re|ve|ll)| ?[^{Z}{L}{N}]+|[{Z}]+(?![^{Z}])|[{Z}]+"
#: Texts below this code point are cut with explicit character ranges, which is faster.
PLAIN_BELOW = 0x558
CACHE_PIECES = 200_000
CACHE_PAIRS = 500_000
LONG_PIECE = 64
#: Bytes of text that are cut into pieces at a time; the pieces take some twelve times that.
SLICE_BYTES = 2 << 20


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranges(kinds: str, extra: str = "") -> str:
    """Character class of Unicode categories that start with one of ``kinds``, below PLAIN_BELOW."""
    import unicodedata

    inside = [unicodedata.category(chr(c))[0] in kinds or chr(c) in extra for c in range(PLAIN_BELOW)]
    out, start = [], None
    for c, now in enumerate([*inside, False]):
        if now and start is None:
            start = c
        elif not now and start is not None:
            out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return "".join(out)


def piece_finders():
    """``findall`` for texts below PLAIN_BELOW, and for any text."""
    import re

    import regex

    space = "\t\n\v\f\r\x85"
    plain = {"L": _ranges("L"), "N": _ranges("N"), "Z": _ranges("Z", space)}
    full = {"L": r"\p{L}", "N": r"\p{N}", "Z": r"\t\n\v\f\r\x85\p{Z}"}
    fill = lambda by: "".join(by.get(p, p) for p in re.split(r"\{([LNZ])\}", BYTE_LEVEL_PATTERN))
    return re.compile(fill(plain)).findall, regex.compile(fill(full)).findall


class BytePairVocabulary:
    """Token tables of a tokenizer file: ranks, splits, bytes and offsets."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        alphabet = _byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # rank space: single bytes first, then merges in order of priority
        singles = {to_bytes(s): i for s, i in vocab.items() if len(s) == 1}
        self.token_bytes: list[bytes] = [bytes([b]) for b in range(256)]
        self.ids: list[int] = [singles.get(bytes([b]), -1) for b in range(256)]
        rank_of = {t: r for r, t in enumerate(self.token_bytes)}
        self.left, self.right = list(range(256)), list(range(256))
        self.pair: dict[tuple[int, int], int] = {}
        for a, b in merges:
            x, y = to_bytes(a), to_bytes(b)
            r = rank_of.get(x + y)
            if r is None:
                r = rank_of[x + y] = len(self.token_bytes)
                self.token_bytes.append(x + y)
                self.ids.append(vocab[a + b])
                self.left.append(rank_of[x])
                self.right.append(rank_of[y])
            self.pair.setdefault((rank_of[x], rank_of[y]), r)
        self.rank_of = rank_of
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = max([*self.ids, *self.special.values()]) + 1
        by_id = [b""] * size
        for t, i in zip(self.token_bytes, self.ids):
            if i >= 0:
                by_id[i] = t
        for s, i in self.special.items():
            by_id[i] = s.encode()
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in by_id])]).astype(np.int64)
        self.size = size


class BacktrackingEncoder:
    """Exact BPE of byte strings in linear time; see the module text."""

    def __init__(self, vocab: BytePairVocabulary):
        import ahocorasick

        self.v = vocab
        auto = ahocorasick.Automaton()
        for r, t in enumerate(vocab.token_bytes):
            if len(t) > 1:  # a single byte needs no search
                auto.add_word(t.decode("latin-1"), r)
        auto.make_automaton()
        self.matches = auto.iter
        self.length = [len(t) for t in vocab.token_bytes]
        # longest proper prefix of each token that is itself a token
        self.shorter = [-1] * len(vocab.token_bytes)
        for r, t in enumerate(vocab.token_bytes):
            for n in range(len(t) - 1, 0, -1):
                p = vocab.rank_of.get(t[:n])
                if p is not None:
                    self.shorter[r] = p
                    break
        self.compatible: dict[int, bool] = {}

    def _compatible(self, a: int, b: int) -> bool:
        """Whether BPE keeps the boundary between neighbouring tokens ``a`` and ``b``.

        Undo the later of the two tokens' merges step by step; if at some step
        the facing parts could have merged earlier than they were consumed, the
        boundary would not have survived.
        """
        pair, left, right = self.v.pair, self.v.left, self.v.right
        limit = len(left)
        while True:
            merged = pair.get((a, b))
            if merged is not None and merged < limit:
                return False
            # open the side whose own merge happened last; a single byte cannot be opened
            if a > b:
                if a >= 256:
                    limit, a = a, right[a]
                elif b >= 256:
                    limit, b = b + 1, left[b]
                else:
                    return True
            else:
                if b >= 256:
                    limit, b = b + 1, left[b]
                elif a >= 256:
                    limit, a = a, right[a]
                else:
                    return True

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ranks of the tokens of one piece."""
        n = len(data)
        length, known = self.length, self.compatible
        longest = list(data)
        for end, r in self.matches(data.decode("latin-1")):
            start = end + 1 - length[r]
            if length[r] > length[longest[start]]:
                longest[start] = r
        if length[longest[0]] == n:
            whole = longest[0]
            if self.v.token_bytes[whole] == data:
                return [whole]
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while True:
                end = at + length[token]
                if alive[end]:
                    if last < 0:
                        ok = True
                    else:
                        k = last << 20 | token
                        ok = known.get(k)
                        if ok is None:
                            ok = known[k] = self._compatible(last, token)
                            if len(known) > CACHE_PAIRS // 4:
                                known.clear()
                    if ok:
                        out.append(token)
                        at = end
                        if at < n:
                            token = longest[at]
                        break
                nxt = self.shorter[token]
                if nxt >= 0:
                    token = nxt
                    continue
                alive[at] = 0
                out.pop()
                at -= length[last]
                token = last
                # the popped token itself leads to a dead end: alive[] now rejects it
                break
        return out


class BatchEncoder(BacktrackingEncoder):
    """The same search, run in lock step over many short pieces with numpy.

    Each round makes one move for every unfinished piece: push the proposed
    token, try the next shorter one, or step back.
    """

    def __init__(self, vocab: BytePairVocabulary):
        super().__init__(vocab)
        self.np_length = np.array(self.length, np.int32)
        self.np_shorter = np.array(self.shorter, np.int32)
        self.np_ids = np.array(vocab.ids, "<u4")
        self.pair_keys = np.empty(0, np.int64)
        self.pair_ok = np.empty(0, bool)

    def _compatible_many(self, keys: np.ndarray) -> np.ndarray:
        """The pair-compatibility table, extended by the pairs not seen before."""
        if len(self.pair_keys):
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            missing = self.pair_keys[at] != keys
        else:
            at, missing = None, np.ones(len(keys), bool)
        if missing.any():
            new = np.unique(keys[missing])
            ok = np.fromiter((self._compatible(k >> 20, k & 0xFFFFF) for k in new.tolist()), bool, len(new))
            if len(self.pair_keys) > CACHE_PAIRS:
                self.pair_keys, self.pair_ok = self.pair_keys[:0], self.pair_ok[:0]
                return self._compatible_many(keys)
            both = np.concatenate([self.pair_keys, new])
            order = np.argsort(both, kind="stable")
            self.pair_keys, self.pair_ok = both[order], np.concatenate([self.pair_ok, ok])[order]
            at = np.searchsorted(self.pair_keys, keys)
        return self.pair_ok[at]

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian u4 bytes."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        text = "\u0100".join([p.decode("latin-1") for p in pieces])  # no token holds the separator
        flat = np.frombuffer(text.encode("utf-16-le"), "<u2")
        base = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        longest = flat.astype(np.int32)  # every byte is a token
        found = np.fromiter(chain.from_iterable(self.matches(text)), np.int64).reshape(-1, 2)
        if len(found):
            width = self.np_length[found[:, 1]]
            order = np.argsort(width, kind="stable")  # the longest is written last
            longest[found[order, 0] + 1 - width[order]] = found[order, 1]
        alive = np.ones(len(flat) + 2, bool)  # a piece's last flag lies on its separator
        out = np.full((n, int(size.max())), -1, np.int32)
        depth, at, token = np.zeros(n, np.int64), np.zeros(n, np.int64), longest[base]
        todo = np.arange(n)
        while len(todo):
            t, d, a, b = token[todo], depth[todo], at[todo], base[todo]
            end = a + self.np_length[t]
            last = np.where(d > 0, out[todo, d - 1], -1)
            ok = alive[b + end]
            ask = np.flatnonzero(ok & (d > 0))
            if len(ask):
                ok[ask] = self._compatible_many(last[ask].astype(np.int64) << 20 | t[ask])
            good = np.flatnonzero(ok)
            g = todo[good]
            out[g, d[good]] = t[good]
            depth[g] += 1
            at[g] = end[good]
            more = end[good] < size[g]
            token[g[more]] = longest[b[good][more] + end[good][more]]
            bad = np.flatnonzero(~ok)
            less = self.np_shorter[t[bad]]
            token[todo[bad]] = np.where(less >= 0, less, last[bad])
            back = bad[less < 0]
            if len(back):
                alive[b[back] + a[back]] = False
                depth[todo[back]] -= 1
                at[todo[back]] -= self.np_length[last[back]]
            keep = np.ones(len(todo), bool)
            keep[good[~more]] = False
            todo = todo[keep]
        ids = self.np_ids[np.where(out >= 0, out, 0)]
        raw, stride = ids.tobytes(), 4 * out.shape[1]
        return [raw[i * stride : i * stride + 4 * k] for i, k in enumerate(depth.tolist())]


class _Pieces(dict):
    """Piece -> ids as little-endian u4 bytes; long pieces are not kept."""

    def __init__(self, encoder: BatchEncoder):
        super().__init__()
        self.encoder = encoder

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces.difference(self) if len(p) <= LONG_PIECE]
        if not new:
            return
        if len(self) + len(new) > CACHE_PIECES:
            self.clear()
            new = [p for p in pieces if len(p) <= LONG_PIECE]
        if len(new) < 256:  # too few for the lock-step search to pay
            self.update((p, self[p]) for p in new)
            return
        for at in range(0, len(new), 16_384):
            part = new[at : at + 16_384]
            self.update(zip(part, self.encoder.encode_many([p.encode("utf-8") for p in part])))

    def __missing__(self, piece: str) -> bytes:
        return self.encoder.np_ids[self.encoder.encode_bytes(piece.encode("utf-8"))].tobytes()


class ByteTokenizer:
    """Text to ids and back, equal to the tokenizers library on the same file."""

    def __init__(self, path: str):
        import re

        self.vocab = BytePairVocabulary(path)
        self.pieces = _Pieces(BatchEncoder(self.vocab))
        self.find_plain, self.find_all = piece_finders()
        self.beyond = re.compile("[\u0558-\U0010ffff]").search
        self.decimals = decimal_table(self.vocab.size)
        self.odd: dict[str, bool] = {}
        special = sorted(self.vocab.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def find(self, text: str) -> list[str]:
        """The pre-token pieces of ``text``, which joined give ``text``."""
        if text.isascii() or not self.beyond(text):
            return self.find_plain(text)
        odd = {c for c in set(text) if c >= "\u0558" and self._classed_otherwise(c)}
        if not odd:
            return self.find_all(text)
        out, at = [], 0
        for p in self.find_all(text.translate({ord(c): "\u0378" for c in odd})):
            out.append(text[at : at + len(p)])
            at += len(p)
        return out

    def _classed_otherwise(self, c: str) -> bool:
        """Whether the pattern library knows ``c`` from a later Unicode than the tokenizers library.

        Such a character is stood in for by an unassigned one while the text is cut.
        """
        if c not in self.odd:
            from tokenizers.pre_tokenizers import ByteLevel

            probe = f"a{c} b1{c}"
            theirs = [e - b for _, (b, e) in ByteLevel(add_prefix_space=False).pre_tokenize_str(probe)]
            self.odd[c] = theirs != [len(p) for p in self.find_all(probe)]
        return self.odd[c]

    def _pieces_of(self, text: str | None) -> list:
        """Pieces of a text; ids of special tokens stand in it as ints."""
        if not text:
            return []
        if self.special is None or "<|" not in text or not self.special.search(text):
            return self.find(text)
        out: list = []
        for part in self.special.split(text):
            out += [self.vocab.special[part]] if part in self.vocab.special else self.find(part)
        return out

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self._pieces_of(t) for t in texts]
        unseen: set = set()
        for c in cut:
            unseen.update(c)
        marks = {p for p in unseen if p.__class__ is int}
        self.pieces.learn(unseen - marks if marks else unseen)
        get = self.pieces.__getitem__
        if marks:
            one = lambda p: int(p).to_bytes(4, "little") if p.__class__ is int else get(p)
            return [np.frombuffer(b"".join(map(one, c)), "<u4") for c in cut]
        return [np.frombuffer(b"".join(map(get, c)), "<u4") for c in cut]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of ``ids`` by one gather from the blob; ids out of range raise."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        start = self.vocab.offsets[ids]
        size = self.vocab.offsets[ids + 1] - start
        shift = np.concatenate([[0], np.cumsum(size)[:-1]])
        total = int(shift[-1] + size[-1])
        where = np.repeat((start - shift).astype(np.int32), size)
        where += np.arange(total, dtype=np.int32)
        return self.vocab.blob[where].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[str, ByteTokenizer] = {}


@contextmanager
def tokenizer(path: str):
    """The one tokenizer of a Python worker and file; its piece cache ends with the block."""
    if path not in _LOADED:
        _LOADED[path] = ByteTokenizer(path)
    try:
        yield _LOADED[path]
    finally:
        _LOADED[path].pieces.clear()
        trim()


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded_sha256)`` of each row.

    ``ids`` is an array of int; the digest is that of the text decoded from them.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())])

    def run(batches):
        with tokenizer(path) as t:
            for s in slices(batches, [id_col, text_col], SLICE_BYTES):
                ids = t.encode_many(s[text_col])
                yield to_batch(schema, doc_id=s[id_col], n_tokens=[len(x) for x in ids], ids=ids, decoded_sha256=[text_digest(t, x) for x in ids])

    return spread(docs.select(id_col, text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; null ids decode to the empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        with tokenizer(path) as t:
            for s in slices(batches, ["doc_id", "ids"]):
                yield to_batch(schema, doc_id=s["doc_id"], text=[t.decode(np.array(x or [], np.int64)) for x in s["ids"]])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def text_digest(t: ByteTokenizer, ids: np.ndarray) -> str:
    return hashlib.sha256(t.decode(ids).encode("utf-8")).hexdigest()


def decimal_table(size: int) -> np.ndarray:
    """Row ``i``: the decimal of ``i`` and a comma, padded with zero bytes to eight."""
    return np.frombuffer(b"".join(b"%d," % i + bytes(7 - len(str(i))) for i in range(size)), "<u8")


def ids_digest(ids: np.ndarray, table: np.ndarray) -> str:
    """sha256 of the decimal ids joined by commas."""
    return hashlib.sha256(table[ids].tobytes().translate(None, b"\0")[:-1]).hexdigest()


def round_trip_digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode from the ids, and return digests of both directions in one pass.

    Fusing the two directions spares writing a list of ids that is larger than
    the text itself.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        with tokenizer(path) as t:
            for s in slices(batches, [id_col, text_col], SLICE_BYTES):
                n, a, b = [], [], []
                for ids in t.encode_many(s[text_col]):
                    n.append(len(ids))
                    a.append(ids_digest(ids, t.decimals))
                    b.append(text_digest(t, ids))
                yield to_batch(schema, doc_id=s[id_col], n_tokens=n, ids_sha256=a, decoded_sha256=b)

    return spread(docs.select(id_col, text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

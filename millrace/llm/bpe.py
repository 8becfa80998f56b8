"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash of its last 16 characters meets a mask, so that passages shared by documents give
the same chunks wherever they stand. Each chunk is encoded once for each Python worker and cache generation (the caches
have bounds and start anew when full): its inner part, from the first safe point to the last one. A safe point is a place
after a character that is no white space and before a single space that such a character follows; the pre-tokenizer always
ends a piece there. The part is kept as the tokens of its words, and words are encoded once too.

At a join, what follows the last safe point on the left and precedes the first one on the right is not known from either
chunk. It is re-encoded in one window with the last word on the left and the first one on the right. The window's tokens
must begin with the left word's tokens and end with the right one's; what lies between belongs to the join. Where they
do not agree, the window takes twice as many words on both sides, until it does or covers the whole text. A chunk without
safe points is added whole to the join.

Null texts are empty: no tokens, and the digests of empty bytes. Repeated rows are encoded like others. Texts are
read whole, in any length. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import caches
from .batches import slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SAFE = re.compile(r"(?<=\S)(?= \S)")
MASK, WINDOW, LEAST, MOST = 0x1FF, 16, 64, 4096
CACHE_CHARS, CACHE_WORDS = 16 << 20, 1_000_000


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: A word of letters whose case and composition need no thought, perhaps after a blank and before one mark.
PLAIN = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]?)\Z")
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = dict(enumerate(chr(b) if b in set(_PRINTABLE) else "" for b in range(256)))
_BYTE_LETTERS |= dict(zip((b for b, c in list(_BYTE_LETTERS.items()) if not c), map(chr, range(256, 324)), strict=True))


def new_words(tok, words: list[str], known: dict[str, bytes], lower: bool) -> None:
    """Adds words' ids to `known`. A plain word is one piece for the pre-tokenizer and its mark another, so they go to the
    tokenizer's model without the steps before it (lower: the normalizer lowers case); all others are encoded as usual."""
    pieces, rest, model = {}, [], tok.model
    for w in words:
        m = PLAIN.match(w)
        if m is None:
            rest.append(w)
            continue
        core = m[1].lower() if lower else m[1]
        ids = known.get(core) or pieces.get(core)
        if ids is None:
            ids = pieces[core] = np.array([t.id for t in model.tokenize(core.encode().decode("latin-1").translate(_BYTE_LETTERS))], "<u4").tobytes()
        if m[2]:
            mark = known.get(m[2])
            if mark is None:
                mark = known[m[2]] = np.array(tok.encode(m[2], add_special_tokens=False).ids, "<u4").tobytes()
            ids += mark
        known[w] = ids
    for i in range(0, len(rest), 8192):
        for w, e in zip(rest[i : i + 8192], tok.encode_batch_fast(rest[i : i + 8192], add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()


def _mix() -> np.ndarray:
    """A fixed random value for each of 256 classes of characters."""
    x = np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)


GEAR = _mix()


def cuts(text: str) -> list[int]:
    """Ends of the content-defined chunks of a text, in characters; chunks have LEAST to MOST of them but for the last."""
    if len(text) <= LEAST:
        return [len(text)] if text else []
    h = GEAR[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) & np.uint32(255)]
    for k in (1, 2, 4, 8):  # after each step: the hash of 2k characters
        h[k:] = h[k:] + (h[:-k] << np.uint32(k)) if k < len(h) else h[k:]
    out, at = [], 0
    for e in (np.flatnonzero((h >> np.uint32(16)) & np.uint32(MASK) == 0) + 1).tolist():
        if e - at < LEAST:
            continue
        while e - at > MOST:
            at += MOST
            out.append(at)
        if e - at >= LEAST:
            out.append(at := e)
    while len(text) - at > MOST:
        at += MOST
        out.append(at)
    return out + [len(text)] if at < len(text) else out


class Encoder:
    """Encodes batches of texts; `pieces` counts the words that reached the tokenizer."""

    def __init__(self, path: str, cache_chars: int = CACHE_CHARS, cache_words: int = CACHE_WORDS) -> None:
        self.tok, self.most, self.most_words = tokenizer(path), cache_chars, cache_words
        self.chunks: dict[str, tuple[str, list[str] | None, str]] = {}
        self.ids: dict[str, bytes] = {}  # of inner parts
        self.joins: dict[tuple[str, str, str], bytes | None] = {}  # None: one word on either side does not do
        self.words: dict[str, bytes] = {"": b""}
        self.held = self.pieces = self.widened = 0

    def _split(self, chunk: str) -> tuple[str, list[str] | None, str]:
        """What precedes the first safe point, the words between it and the last one (None: no safe point), the rest."""
        found = self.chunks.get(chunk)
        if found is None:
            parts = SAFE.split(chunk)
            found = (parts[0], None, "") if len(parts) == 1 else (parts[0], parts[1:-1] or [""], parts[-1])
            self.chunks[chunk] = found
            self.held += 2 * len(chunk)
        return found

    def _exact(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for i in range(0, len(texts), 8192) for e in self.tok.encode_batch_fast(texts[i : i + 8192], add_special_tokens=False)]

    def _inside(self, left: list[str], join: str, right: list[str], window: bytes) -> bytes | None:
        """The join's tokens in an encoded window, if it agrees with the words on both sides."""
        head, tail = (b"".join(map(self.words.__getitem__, x)) for x in (left, right))
        if len(head) + len(tail) > len(window) or not window.startswith(head) or not window.endswith(tail):
            return None
        return window[len(head) : len(window) - len(tail)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if self.held > self.most:
            self.chunks, self.ids, self.joins, self.held = {}, {}, {}, 0
        plans: list[list] = []  # join, words, join, ..., words, join
        for t in texts:
            plan, join, at = [], "", 0
            for e in cuts(t):
                head, body, tail = self._split(t[at:e])
                join += head
                if body is not None:
                    plan += (join, body)
                    join = tail
                at = e
            plan.append(join)
            plans.append(plan)
        fresh = {w for p in plans for body in p[1::2] for w in body} - self.words.keys()
        if len(self.words) + len(fresh) > self.most_words:
            self.words = {"": b""}
            fresh = {w for p in plans for body in p[1::2] for w in body} - self.words.keys()
        new_words(self.tok, list(fresh), self.words, False)
        self.pieces += len(fresh)
        windows: dict[tuple[str, str, str], None] = {}
        keys = []
        for p in plans:
            own = [(p[i - 1][-1] if i else "", p[i], p[i + 1][0] if i + 1 < len(p) else "") for i in range(0, len(p), 2)]
            keys.append(own)
            windows.update((k, None) for k in own if k not in self.joins)
        for k, ids in zip(windows, self._exact(["".join(k) for k in windows]), strict=True):
            self.joins[k] = self._inside([k[0]], k[1], [k[2]], ids)
            self.held += sum(map(len, k))
        out = []
        for p, own in zip(plans, keys, strict=True):
            parts = []
            for i, k in enumerate(own):
                ids = self.joins[k]
                if ids is None:
                    ids = self._widened(p, 2 * i)
                if ids is None:
                    parts = self._exact(["".join("".join(x) for x in p)])
                    break
                parts.append(ids)
                if i + 1 < len(own):
                    parts.append(self._body(p[2 * i + 1]))
            out.append(b"".join(parts))
        return out

    def _body(self, words: list[str]) -> bytes:
        key = "".join(words)
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = b"".join(map(self.words.__getitem__, words))
            self.held += len(key)
        return found

    def _widened(self, plan: list, at: int) -> bytes | None:
        """A join's tokens from windows of more words of the neighbouring parts; None if those don't do either."""
        left, right = (plan[at - 1] if at else [""]), (plan[at + 1] if at + 1 < len(plan) else [""])
        n = 2
        while n < 2 * max(len(left), len(right)):
            self.widened += 1
            a, b = left[-n:], right[:n]
            ids = self._inside(a, plan[at], b, self._exact(["".join([*a, plan[at], *b])])[0])
            if ids is not None:
                return ids
            n *= 2
        return None


@lru_cache(2)
def _bytes_of(path: str) -> list[bytes]:
    """The bytes that each id stands for: the byte-level alphabet undone; ids without an entry are skipped, as in decode."""
    back = {c: b for b, c in _BYTE_LETTERS.items()}
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for s, i in vocab.items():
        out[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
    return out


def decode(path: str, ids: bytes) -> str:
    """The text of ids, special tokens included; broken UTF-8 becomes replacement characters."""
    table = _bytes_of(path)
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _forget() -> None:
    encoder.cache_clear()
    tokenizer.cache_clear()
    _bytes_of.cache_clear()


caches.register("bpe", _forget)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (binary, little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.claim("bpe")
        for part, texts in slices(batches, limit=2 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encoder(path).encode(texts), pa.binary())], ["key", "ids"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, ids binary")


def encode_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: encoded and decoded in one pass, so that no ids leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.claim("bpe")
        for part, texts in slices(batches, limit=2 << 20):
            ids = encoder(path).encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(decode(path, x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]),
                ],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Exact removal of repeated passages: bytes covered by a LENGTH-byte string that starts in a document with a smaller id.

Each window of LENGTH bytes has an anchor: the least hash among its GRAM-byte substrings. Equal windows have equal
anchors, and neighbouring windows with one anchor form a run, about thirteen windows long.

A. Each document's anchors are counted over all documents (packed by bucket of the anchor; what a batch of documents
   already shows to be shared is passed on without going to the anchor's bucket, with one witness).
B. Runs with an anchor of two or more documents ship their text once for each lot of documents; where a smaller id of
   the lot has the very same text, the run is settled there.
   Of anchors that stand in very many documents (HOT, or more where the input is large, so that their list has a bound)
   each window ships by itself, to the bucket that its own bytes name, so that no bucket takes all that surrounds them.
C. In each bucket windows whose hash no other window of the same anchor and distance has are set aside, as they equal none.
   The others are sorted: those of one anchor, at one distance from it, by a mergesort that compares suffixes through prefix polynomial hashes and binary search for the common extension. Neighbours are then compared
   byte by byte, so a hash collision can't change the result (such a segment is sorted by its bytes). Each class of
   equal windows learns its smallest id, and windows of other ids are removed.
D. The covered bytes of each document are united and cut out.

Documents are dealt to lots by id, about LOT_BYTES of text each, so nothing of all documents meets in one place. Texts
are read whole as UTF-8; null texts are empty and lose nothing, as do documents with a null id, which also remove
nothing. Rows with equal ids count as one document's: they do not remove each other's bytes; where they hold different
texts, what is removed from either is removed from all of them at the same places. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import caches
from .batches import slices
from .lineage import drop, stage

LENGTH, GRAM, LOT_BYTES, SORT_BYTES = 50, 26, 8 << 20, 1 << 19
HOT, HOT_LIST = 100_000, 1_000_000
SPAN = LENGTH - GRAM + 1
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(29))
    return x * U(0x94D049BB133111EB)


LETTER = _mix(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D))


@lru_cache(2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2 to the 64, 2**bits of them."""
    up, down = np.ones(1, U), np.ones(1, U)
    b, i = BASE, INVERSE
    for _ in range(bits):
        up, down = np.concatenate([up, up * U(b)]), np.concatenate([down, down * U(i)])
        b, i = b * b % (1 << 64), i * i % (1 << 64)
    return up, down


class Prefix:
    """Prefix polynomial hashes of a byte array: of(p, n) is the hash of n bytes from p."""

    def __init__(self, data: np.ndarray) -> None:
        self.up, down = _powers(max(10, int(len(data)).bit_length()))
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(LETTER[data] * down[: len(data)], out=self.sums[1:])

    def of(self, p: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        return (self.sums[p + n] - self.sums[p]) * self.up[p]

    def all(self, n: int) -> np.ndarray:
        m = len(self.sums) - n
        return (self.sums[n:] - self.sums[:m]) * self.up[:m] if m > 0 else np.zeros(0, U)


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    out, k = h, 1
    while 2 * k <= n:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    return np.minimum(out[: len(h) - n + 1], out[n - k :]) if k < n else out


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, each text's start, and each text's length."""
    n = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(n) - n, n


def runs(data: np.ndarray, begin: np.ndarray, size: np.ndarray, part: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, last window, anchor) of each run; windows are positions in data. The bytes are looked at in
    parts that overlap, to bound memory; a run that crosses parts comes in two, which changes nothing in the result."""
    out = []
    end = begin + size
    for lo in range(0, max(0, len(data) - LENGTH + 1), part):
        piece = data[lo : lo + part + LENGTH - 1]
        anchor = _least(_mix(Prefix(piece).all(GRAM)), SPAN)
        hi = lo + len(anchor)
        a, z = int(np.searchsorted(begin, lo, "right")) - 1, int(np.searchsorted(begin, hi, "left"))
        text = np.repeat(np.arange(a, z), np.minimum(end[a:z], hi) - np.maximum(begin[a:z], lo))
        ok = np.arange(lo, hi) + LENGTH <= end[text]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        head = np.flatnonzero(new & ok)
        own = text[head]
        last = np.minimum(np.r_[head[1:] - 1, len(anchor) - 1] + lo, end[own] - LENGTH)
        out.append((own, head + lo, last, _mix(anchor[head])))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _dealt(ids: np.ndarray, lots: int) -> np.ndarray:
    """The lot of each id: shifts and exclusive ors scatter ids with a common stride."""
    x = ids.astype(U)
    x = x ^ (x << U(13))
    x = x ^ (x >> U(7))
    x = x ^ (x << U(17))
    return x.view(np.int64) % lots


def _lot(c: Column, lots: int) -> Column:
    """_dealt as a column."""
    c = c.bitwiseXOR(F.shiftleft(c, 13))
    c = c.bitwiseXOR(F.shiftrightunsigned(c, 7))
    c = c.bitwiseXOR(F.shiftleft(c, 17))
    return F.pmod(c, F.lit(lots)).cast("int")


def _groups(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, positions) for each value of a small-integer array."""
    order = np.argsort(of, kind="stable")
    cut = np.flatnonzero(np.diff(of[order])) + 1
    for part in np.split(order, cut) if len(of) else []:
        yield int(of[part[0]]), part


def anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """Step A on the documents' side: (bucket, known, ids, keys, docs): docs says for how many documents an id stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.claim("suffix")
        for n, (part, texts) in enumerate(slices(batches, limit=2 << 20)):
            ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            own, _, _, key = runs(*join_texts([t.encode() for t in texts]))
            if not len(own):
                continue
            ids = ids[own]
            order = np.lexsort((ids, key))
            key, ids = key[order], ids[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])]
            key, ids = key[new], ids[new]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            shared = np.repeat(np.diff(np.r_[start, len(key)]) > 1, np.diff(np.r_[start, len(key)]))
            bucket = ((key >> U(32)) % U(buckets)).astype(np.int64)
            size = np.diff(np.r_[start, len(key)]).astype(np.int32)
            rows = [(b, False, ids[start[p]].tobytes(), key[start[p]].astype(np.uint32).tobytes(), size[p].tobytes()) for b, p in _groups(bucket[start])]
            if shared.any():
                full = (bucket[shared].astype(U) << U(32)) | (key[shared] & U(0xFFFFFFFF))
                at = np.flatnonzero(shared)
                for k in range(0, len(at), 4096):  # rows of moderate size, over many buckets
                    rows.append(((int(ids[0]) + n + k) % buckets, True, ids[at[k : k + 4096]].tobytes(), full[k : k + 4096].tobytes(), None))
            kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["bucket", "known", "ids", "keys", "docs"])

    return docs.mapInArrow(run, "bucket int, known boolean, ids binary, keys binary, docs binary")


def _joined(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def shared_anchors(rows: DataFrame, lots: int, hot: int) -> DataFrame:
    """Step A on the anchors' side: (lot, ids, keys) of anchors that stand in two or more documents; lot -1 lists those of
    more than `hot` documents."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[pdf["known"]]
        ids, keys = [_joined(known["ids"], np.int64)], [_joined(known["keys"], U)]
        rest = pdf[~pdf["known"]]
        often = np.zeros(0, U)
        if len(rest):
            i, k, c = _joined(rest["ids"], np.int64), _joined(rest["keys"], np.uint32), _joined(rest["docs"], np.int32)
            order = np.lexsort((i, k))
            i, k = i[order], k[order]
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[start, len(k)])
            many = np.repeat(i[start] != i[start + size - 1], size)
            often = k[start][np.add.reduceat(c[order].astype(np.int64), start) > hot].astype(U) | (U(int(pdf["bucket"].iloc[0])) << U(32))
            ids.append(i[many])
            keys.append((U(int(pdf["bucket"].iloc[0])) << U(32)) | k[many].astype(U))
        i, k = np.concatenate(ids), np.concatenate(keys)
        out = [(lot, i[p].tobytes(), k[p].tobytes()) for lot, p in _groups(_dealt(i, lots))]
        out += [(-1, b"", often.tobytes())] * bool(len(often))
        return pd.DataFrame(out, columns=["lot", "ids", "keys"])

    return rows.groupBy("bucket").applyInPandas(run, "lot int, ids binary, keys binary")


def _pairs(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return _mix(ids.astype(U) * U(0xD6E8FEB86659FD93) ^ _mix(keys))


PASSAGES = "bucket int, known boolean, lot int, ids binary, a binary, b binary, text binary"


def _windows(own: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document and the position of each window of runs."""
    n = last - first + 1
    return np.repeat(own, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def passages(docs: pd.DataFrame, shared: pd.DataFrame, buckets: int, hot: np.ndarray) -> pd.DataFrame:
    """Step B for one lot: unsettled runs (a: starts, b: lengths, compressed text) by bucket, and settled ones (a: starts, b:
    ends). Runs with one of the `hot` anchors (sorted) are taken apart into windows."""
    caches.claim("suffix")
    none = pd.DataFrame({c.split()[0]: [] for c in PASSAGES.split(", ")})
    if not len(docs) or not len(shared):
        return none
    docs = docs.sort_values("id")
    ids = docs["id"].to_numpy(np.int64)
    data, begin, size = join_texts([t.encode() if t is not None else b"" for t in docs["text"]])
    own, first, last, key = runs(data, begin, size)
    full = (((key >> U(32)) % U(buckets)) << U(32)) | (key & U(0xFFFFFFFF))
    want = np.unique(_pairs(_joined(shared["ids"], np.int64), _joined(shared["keys"], U)))
    got = _pairs(ids[own], full)
    at = np.searchsorted(want, got)
    at[at == len(want)] = 0
    hit = np.flatnonzero(want[at] == got)
    if not len(hit):
        return none
    own, first, last, bucket = own[hit], first[hit], last[hit], (full[hit] >> U(32)).astype(np.int64)
    frequent = np.isin(full[hit], hot)
    raw = data.tobytes()
    seen: dict[bytes, int] = {}
    texts, open_ = [], np.ones(len(hit), bool)
    owner = ids[own].tolist()
    for i, (a, z, d) in enumerate(zip(first.tolist(), last.tolist(), owner, strict=True)):
        t = raw[a : z + LENGTH]
        texts.append(t)
        open_[i] = seen.setdefault(t, d) == d  # documents come by id
    apart = np.flatnonzero(frequent & open_)
    if len(apart):
        w_own, w_first = _windows(own[apart], first[apart], last[apart])
        stay = np.flatnonzero(~(frequent & open_))
        w_text = [raw[a : a + LENGTH] for a in w_first.tolist()]
        alone: dict[bytes, int] = {}
        w_open = np.array([alone.setdefault(t, d) == d for t, d in zip(w_text, ids[w_own].tolist(), strict=True)], bool)
        place = (_mix(Prefix(data).of(w_first, LENGTH)) >> U(32)) % U(buckets)
        own, first, last = np.r_[own[stay], w_own], np.r_[first[stay], w_first], np.r_[last[stay], w_first]
        bucket, open_ = np.r_[bucket[stay], place.astype(np.int64)], np.r_[open_[stay], w_open]
        texts = [texts[i] for i in stay.tolist()] + w_text
        owner = ids[own].tolist()
    lot = int(docs["lot"].iloc[0])
    start = first - begin[own]
    length = last - first + LENGTH
    who = np.array(owner, np.int64)
    out = []
    rest = np.flatnonzero(open_)
    pack = zstandard.ZstdCompressor(level=3)
    for b, p in _groups(bucket[rest]):
        p = rest[p]
        out.append((b, False, lot, who[p].tobytes(), start[p].astype(np.int32).tobytes(), length[p].astype(np.int32).tobytes(), pack.compress(b"".join([texts[i] for i in p.tolist()]))))
    done = np.flatnonzero(~open_)
    if len(done):
        out.append((lot % buckets, True, lot, who[done].tobytes(), start[done].astype(np.int32).tobytes(), (start + length)[done].astype(np.int32).tobytes(), None))
    return pd.DataFrame(out, columns=none.columns)


class Suffixes:
    """Orders positions of a byte array by the LENGTH bytes that follow, within segments."""

    def __init__(self, data: np.ndarray) -> None:
        self.data, self.hash = data, Prefix(data)

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Common extension of the suffixes at p and q, up to LENGTH, by binary search over hashes."""
        out = np.full(len(p), LENGTH)
        left = np.flatnonzero(self.hash.of(p, LENGTH) != self.hash.of(q, LENGTH))
        p, q = p[left], q[left]
        n = np.zeros(len(left), np.int64)
        step = 1 << (LENGTH.bit_length() - 1)
        while step:
            m = np.minimum(step, LENGTH - 1 - n)
            ok = self.hash.of(p + n, m) == self.hash.of(q + n, m)
            n += np.where(ok, m, 0)
            step //= 2
        out[left] = n
        return out

    def before(self, p: np.ndarray, q: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(p, q)
        i = np.minimum(n, LENGTH - 1)
        return np.where(n == LENGTH, or_equal, self.data[p + i] < self.data[q + i])

    def order(self, where: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """The positions `where` (grouped by segment) sorted within each segment: a bottom-up mergesort of all segments
        at once, in which each element finds its rank in the run that its own run meets."""
        where = where.copy()
        start = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        size = np.diff(np.r_[start, len(segment)])
        s0, n = np.repeat(start, size), np.repeat(size, size)
        at = np.arange(len(where)) - s0
        width = 1
        while width < size.max(initial=0):
            on = np.flatnonzero(n > width)
            a, base, total = at[on], s0[on], n[on]
            run = a // width
            mate = run ^ 1
            lo0 = np.minimum(mate * width, total)
            hi0 = np.minimum(lo0 + width, total)
            lo, hi = lo0.copy(), hi0.copy()
            mine, second = where[on], (run & 1) == 1
            while True:
                act = np.flatnonzero(lo < hi)
                if not len(act):
                    break
                mid = (lo[act] + hi[act]) // 2
                # elements of the second run stand after equal ones of the first
                less = self.before(where[base[act] + mid], mine[act], second[act])
                lo[act] = np.where(less, mid + 1, lo[act])
                hi[act] = np.where(less, hi[act], mid)
            place = base + np.minimum(run, mate) * width + (a - run * width) + (lo - lo0)
            new = where.copy()
            new[place] = mine
            where = new
            width *= 2
        return where

    def classes(self, where: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`where` in order, and a class number for each: equal strings have equal numbers. Checked byte by byte."""
        where = self.order(where, segment)
        span = np.arange(LENGTH)
        while True:
            same = np.zeros(len(where), bool)
            wrong: set[int] = set()
            for g in range(1, len(where), 1 << 16):
                i = np.arange(g, min(len(where), g + (1 << 16)))
                x, y = self.data[where[i - 1][:, None] + span], self.data[where[i][:, None] + span]
                differ = x != y
                any_ = differ.any(1)
                k = differ.argmax(1)
                r = np.arange(len(i))
                inside = segment[i] == segment[i - 1]
                same[i] = ~any_ & inside
                wrong |= set(segment[i][inside & any_ & (x[r, k] > y[r, k])].tolist())
            if not wrong:
                return where, np.cumsum(~same)
            for s in wrong:  # a collision misled the sort
                p = np.flatnonzero(segment == s)
                where[p] = sorted(where[p].tolist(), key=lambda q: self.data[q : q + LENGTH].tobytes())


def settle(ids: np.ndarray, start: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Step C for runs that hold all of their anchors' windows: (id, start, end) of removed pieces."""
    least: dict[bytes, int] = {}
    for d, t in zip(ids.tolist(), texts, strict=True):
        if least.get(t, d) >= d:
            least[t] = d
    kept = list(least)
    number = {t: i for i, t in enumerate(kept)}
    owner = np.array([least[t] for t in kept], np.int64)
    data, begin, size = join_texts(kept)
    gram = _mix(Prefix(data).all(GRAM))
    key = _least(gram, SPAN)[begin]
    # windows: text, position, distance to the first place of the anchor
    count = size - LENGTH + 1
    text = np.repeat(np.arange(len(kept)), count)
    where = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + begin[text]
    doc_of = np.repeat(np.arange(len(kept)), size)[: len(gram)]
    places = np.flatnonzero(gram == key[doc_of])
    distance = places[np.searchsorted(places, where)] - where
    group = np.unique(key, return_inverse=True)[1]
    segment = group[text].astype(np.int64) * SPAN + distance
    order = np.argsort(segment, kind="stable")
    s = segment[order]
    start_ = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    n = np.diff(np.r_[start_, len(s)])
    several = np.repeat(n > 1, n)
    order, s = order[several], s[several]
    if len(order):  # a window whose hash is alone in its segment equals no other
        suffixes = Suffixes(data)
        h = suffixes.hash.of(where[order], LENGTH)
        by = np.lexsort((h, s))
        new = np.r_[True, (h[by][1:] != h[by][:-1]) | (s[by][1:] != s[by][:-1])]
        at = np.flatnonzero(new)
        n = np.diff(np.r_[at, len(by)])
        again = np.sort(by[np.repeat(n > 1, n)])
        order, s = order[again], s[again]
    removed = np.zeros(len(where), bool)
    if len(order):
        sorted_, cls = suffixes.classes(where[order], s)
        back = np.searchsorted(begin, sorted_, side="right") - 1
        cls0 = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
        low = np.minimum.reduceat(owner[back], cls0)
        gone = owner[back] > np.repeat(low, np.diff(np.r_[cls0, len(cls)]))
        offset = np.cumsum(count) - count
        removed[offset[back[gone]] + sorted_[gone] - begin[back[gone]]] = True
    # pieces of each kept text
    new = removed & np.r_[True, ~removed[:-1] | (text[1:] != text[:-1])]
    end = removed & np.r_[~removed[1:] | (text[1:] != text[:-1]), True]
    a, z = np.flatnonzero(new), np.flatnonzero(end)
    pieces: dict[int, list[tuple[int, int]]] = {}
    for i, x, y in zip(text[a].tolist(), (where[a] - begin[text[a]]).tolist(), (where[z] - begin[text[z]] + LENGTH).tolist(), strict=True):
        pieces.setdefault(i, []).append((x, y))
    out = []
    for d, p, t in zip(ids.tolist(), start.tolist(), texts, strict=True):
        i = number[t]
        if owner[i] < d:
            out.append((d, p, p + len(t)))
        else:
            out += [(d, p + x, p + y) for x, y in pieces.get(i, ())]
    r = np.array(out, np.int64).reshape(-1, 3)
    return r[:, 0], r[:, 1], r[:, 2]


def removals(rows: DataFrame, lots: int) -> DataFrame:
    """Step C: (lot, ids, a, b): removed pieces from a to b."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        caches.claim("suffix")
        known = pdf[pdf["known"]]
        out = list(zip(known["lot"].tolist(), known["ids"].tolist(), known["a"].tolist(), known["b"].tolist(), strict=True))
        rest = pdf[~pdf["known"]]
        if len(rest):
            ids, start, length = _joined(rest["ids"], np.int64), _joined(rest["a"], np.int32).astype(np.int64), _joined(rest["b"], np.int32).astype(np.int64)
            raw = b"".join(map(zstandard.ZstdDecompressor().decompress, rest["text"]))
            begin = np.cumsum(length) - length
            data = np.frombuffer(raw, np.uint8)
            key = np.zeros(len(ids), U)
            for g in range(0, len(ids), 1 << 13):  # anchors again, by parts: those of the runs' first windows
                own = begin[g : g + (1 << 13)]
                first = data[own[:, None] + np.arange(LENGTH)].ravel()
                key[g : g + (1 << 13)] = _least(_mix(Prefix(first).all(GRAM)), SPAN)[np.arange(len(own)) * LENGTH]
            order = np.argsort(key, kind="stable")
            k = key[order]
            first = np.r_[True, k[1:] != k[:-1]]
            grouped = np.cumsum(first) - 1
            weight = np.cumsum(length[order])
            piece = (weight[np.flatnonzero(first)] // SORT_BYTES)[grouped]
            i, a, z = [], [], []
            for _, p in _groups(piece):
                p = order[p]
                x = settle(ids[p], start[p], [raw[b : b + n] for b, n in zip(begin[p].tolist(), length[p].tolist(), strict=True)])
                i.append(x[0])
                a.append(x[1])
                z.append(x[2])
            i, a, z = np.concatenate(i), np.concatenate(a), np.concatenate(z)
            out += [(lot, i[p].tobytes(), a[p].astype(np.int32).tobytes(), z[p].astype(np.int32).tobytes()) for lot, p in _groups(_dealt(i, lots))]
        return pd.DataFrame(out, columns=["lot", "ids", "a", "b"])

    return rows.groupBy("bucket").applyInPandas(run, "lot int, ids binary, a binary, b binary")


def _cut(docs: pd.DataFrame, gone: pd.DataFrame) -> Iterator[tuple[int, bytes, bytes, int]]:
    """(id, text, kept, spans) of each document of a lot."""
    ids = docs["id"].to_numpy(np.int64)
    rid, a, z = _joined(gone["ids"], np.int64), _joined(gone["a"], np.int32).astype(np.int64), _joined(gone["b"], np.int32).astype(np.int64)
    order = np.argsort(rid, kind="stable")
    rid, a, z = rid[order], a[order], z[order]
    for d, lo, hi, t in zip(ids.tolist(), np.searchsorted(rid, ids, "left").tolist(), np.searchsorted(rid, ids, "right").tolist(), docs["text"], strict=True):
        b = t.encode() if t is not None else b""
        if lo == hi:
            yield d, b, b, 0
            continue
        turn = np.zeros(len(b) + 1, np.int32)
        np.add.at(turn, a[lo:hi], 1)
        np.add.at(turn, z[lo:hi], -1)
        out = np.cumsum(turn[:-1]) > 0
        yield d, b, np.frombuffer(b, np.uint8)[~out].tobytes(), int((out & np.r_[True, ~out[:-1]]).sum())


def _removed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, int]:
    """The documents by lot (lot, id, text), the removed pieces by lot, and the number of lots."""
    own = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lots = max(12, -(-total // LOT_BYTES)) | 1
    dealt = own.select(_lot(F.col("id"), lots).alias("lot"), "id", "text")
    often = max(HOT, total // HOT_LIST)  # a document has no more anchors than bytes, so their list stays below HOT_LIST
    first = stage(shared_anchors(anchors(own, lots), lots, often), "anchors")
    listed = [np.frombuffer(r["keys"], U) for r in first.where("lot = -1").select("keys").collect()]  # bounded by HOT_LIST
    hot = np.sort(np.concatenate(listed)) if listed else np.zeros(0, U)
    shared = first.where("lot >= 0")
    open_ = dealt.groupBy("lot").cogroup(shared.groupBy("lot")).applyInPandas(lambda d, s: passages(d, s, lots, hot), PASSAGES)
    gone = stage(removals(open_, lots), "removals")
    drop(first)
    return dealt, gone, lots


def dedup_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256."""
    dealt, gone, _ = _removed(docs, key, text)

    def run(d: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(i, len(b), len(b) - len(k), n, hashlib.sha256(k).hexdigest()) for i, b, k, n in _cut(d, g)], columns=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = dealt.groupBy("lot").cogroup(gone.groupBy("lot")).applyInPandas(run, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    t = F.coalesce(F.col(text), F.lit(""))
    rest = docs.where(F.col(key).isNull()).select(F.col(key).cast("long").alias("key"), F.octet_length(t).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(t, 256).alias("kept_sha256"))
    return out.unionByName(rest)


def dedup_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the remaining text (characters that lost some of their bytes go whole); a null text stays null."""
    _, gone, n = _removed(docs, key, text)
    own = docs.where(F.col(key).isNotNull())
    columns = [c for c in docs.columns if c not in (key, text)]
    packed = own.select(_lot(F.col(key).cast("long"), n).alias("lot"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.struct(*columns).alias("rest") if columns else F.lit(None).cast("string").alias("rest"))

    def run(d: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        kept = [k.decode("utf-8", "ignore") if t is not None else None for (_, _, k, _), t in zip(_cut(d, g), d["text"], strict=True)]
        return pd.DataFrame({"id": d["id"], "text": kept, "rest": d["rest"]})

    kind = packed.schema["rest"].dataType.simpleString()
    out = packed.groupBy("lot").cogroup(gone.groupBy("lot")).applyInPandas(run, f"id long, text string, rest {kind}")
    cols = [F.col("id").cast(docs.schema[key].dataType).alias(key) if c == key else F.col("text").alias(text) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return out.select(*cols).unionByName(docs.where(F.col(key).isNull()))

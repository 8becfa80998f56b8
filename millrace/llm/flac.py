"""Media columns: a FLAC encoder and decoder over columns of bytes, 8-bit mono.

Frames of BLOCK samples are independent, and every stream carries a seek point for each of its frames (sample offset,
byte offset, samples). So the decoder works on all frames of a batch at once: in step i it reads the i-th Rice code of
each frame (quotient by a table of leading zeros, then the remainder), and the predictors are undone afterwards. Frame
headers are checked by CRC-8, frames by CRC-16, and the stream by the MD5 of its samples. Streams of other encoders are
read too (8-bit mono; constant, verbatim, fixed and LPC subframes; partitions; escaped partitions), one frame after the
other where they have no seek point for each frame.

The encoder tries constant, verbatim, fixed (orders 0 to 2) and linear prediction subframes and takes the smallest by its
estimate. Payloads are read back as PCM blocks, each known by its sample offset (Pcm).

A payload of no bytes gives a stream without frames. A null payload gives a null stream, and a broken stream raises
ValueError. Payloads are stored whole, in any length. Repeated rows are stored like others, other columns are ignored, and
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices

BLOCK = 1152
RATE = 8000
GROUP = 2048  # frames decoded together
LPC_ORDER = 4  # of the linear prediction that media() tries for each frame
MOST_POINTS = 930_000  # a seek table has a 24-bit size; beyond that every second (third, ...) frame has a point

#: Fixed values of the format: block size codes, and the predictors' coefficients by order.
SIZE_CODES = {192: 1, 576: 2, 1152: 3, 2304: 4, 4608: 5, 256: 8, 512: 9, 1024: 10, 2048: 11, 4096: 12, 8192: 13, 16384: 14, 32768: 15}
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
SIZES = {v: k for k, v in SIZE_CODES.items()}


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) & 1 else 0)
            c &= (1 << bits) - 1
        out.append(c)
    return out


CRC8, CRC16 = _crc_table(0x07, 8), np.array(_crc_table(0x8005, 16), np.uint16)
ZEROS = np.array([16] + [16 - i.bit_length() for i in range(1, 65536)], np.int64)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


def crc16(frames: list[bytes]) -> np.ndarray:
    """Of many frames at once; zeros before a frame leave its CRC as it is."""
    if not frames:
        return np.zeros(0, np.uint16)
    width = max(map(len, frames))
    grid = np.frombuffer(b"".join(f.rjust(width, b"\0") for f in frames), np.uint8).reshape(len(frames), width).T.copy()
    c = np.zeros(len(frames), np.uint16)
    for row in grid:
        c = CRC16[(c >> 8) ^ row] ^ (c << 8)
    return c


def _utf8(n: int) -> bytes:
    """A number in the extended UTF-8 of frame headers."""
    if n < 128:
        return bytes([n])
    k = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    rest = [0x80 | n >> 6 * i & 63 for i in range(k - 1)][::-1]
    return bytes([(0xFF00 >> k & 0xFF) | n >> 6 * (k - 1), *rest])


@lru_cache(65536)
def _header(number: int, size: int) -> bytes:
    code = SIZE_CODES.get(size, 7)
    head = bytes([0xFF, 0xF8, code << 4, 0x02]) + _utf8(number) + (struct.pack(">H", size - 1) if code == 7 else b"")
    return head + bytes([crc8(head)])


def _lpc(x: np.ndarray, order: int, precision: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and shifts of each row, by Levinson's recursion over a windowed autocorrelation."""
    n = x.shape[1]
    w = x * np.hanning(n + 2)[1:-1]
    r = np.stack([(w[:, : n - k] * w[:, k:]).sum(1) for k in range(order + 1)], 1)
    r[:, 0] = r[:, 0] * 1.000001 + 1e-9
    a, err = np.zeros((len(x), order)), r[:, 0].copy()
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1][:, :i]).sum(1)) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err *= np.maximum(1 - k * k, 1e-9)
    top = np.maximum(np.abs(a).max(1), 1e-9)
    shift = np.clip(precision - 1 - np.ceil(np.log2(top)), 0, 15).astype(np.int64)
    lim = 1 << (precision - 1)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -lim, lim - 1).astype(np.int64), shift


def _residuals(x: np.ndarray, coef: np.ndarray, shift: np.ndarray) -> np.ndarray:
    order = coef.shape[1]
    guess = sum(coef[:, j : j + 1] * x[:, order - 1 - j : x.shape[1] - 1 - j] for j in range(order))
    return x[:, order:] - (guess >> shift[:, None])


def _bodies(x: np.ndarray, lpc_order: int) -> list[bytes]:
    """The subframe of each row of samples, padded to bytes."""
    rows, n = x.shape
    tries = [x, *(np.diff(x, k, axis=1) for k in (1, 2))]
    cost = np.stack([np.abs(t[:, 2 - k :]).sum(1) for k, t in enumerate(tries)])
    order = cost.argmin(0)
    coef = shift = None
    if lpc_order:
        coef, shift = _lpc(x, lpc_order)
        better = np.abs(_residuals(x, coef, shift)[:, :]).sum(1) + 4 * lpc_order < cost.min(0)
        order = np.where(better, -1, order)
    order = np.where((x == x[:, :1]).all(1), -2, order)
    out: list[bytes] = [b""] * rows
    for o in np.unique(order).tolist():
        own = np.flatnonzero(order == o)
        if o == -2:
            for i in own.tolist():
                out[i] = bytes([0, int(x[i, 0]) & 0xFF])
            continue
        warm = lpc_order if o == -1 else o
        r = _residuals(x[own], coef[own], shift[own]) if o == -1 else tries[o][own]
        z = (r << 1) ^ (r >> 63)
        m = z.shape[1]
        sizes = np.stack([(z >> k).sum(1) + m * (k + 1) for k in range(13)])
        best = sizes.argmin(0)
        head = 8 + 8 * warm + 10 + ((9 + 10 * warm) if o == -1 else 0)
        total = head + sizes.min(0)
        raw = total >= 8 + 8 * n
        for i in own[raw].tolist():
            out[i] = b"\x02" + x[i].astype(np.int8).tobytes()
        for k in np.unique(best[~raw]).tolist():
            which = np.flatnonzero((best == k) & ~raw)
            q = z[which] >> k
            length = q + (1 + k)
            whole = -(-(head + length.sum(1)) // 8) * 8
            base = np.cumsum(whole) - whole
            bits = np.zeros(int(whole.sum()), np.uint8)

            def put(at: np.ndarray, value: np.ndarray, width: int, bits=bits) -> np.ndarray:
                for j in range(width):
                    bits[at + j] = value >> (width - 1 - j) & 1
                return at + width

            full = lambda v, which=which: np.full(len(which), v, np.int64)
            at = put(base, full((0x20 | warm - 1 if o == -1 else 0x08 | warm) << 1), 8)
            for j in range(warm):
                at = put(at, x[own[which], j], 8)
            if o == -1:
                at = put(put(at, full(9), 4), shift[own[which]], 5)
                for j in range(warm):
                    at = put(at, coef[own[which], j], 10)
            at = put(at, full(k), 10)  # Rice coding with 4-bit parameters, one partition, its parameter
            stop = at[:, None] + np.cumsum(length, 1) - length + q
            bits[stop] = 1
            rest = z[which]
            for j in range(k):
                bits[stop + 1 + j] = rest >> (k - 1 - j) & 1
            packed = np.packbits(bits).tobytes()
            for i, a, w in zip(own[which].tolist(), (base // 8).tolist(), (whole // 8).tolist(), strict=True):
                out[i] = packed[a : a + w]
    return out


def encode(payloads: list[bytes], block: int = BLOCK, lpc_order: int = 0) -> list[bytes]:
    """A FLAC stream for each payload; byte b is the sample b - 128. lpc_order > 0 also tries linear prediction of that order."""
    where: dict[int, list[tuple[int, int]]] = {}
    for i, p in enumerate(payloads):
        for k in range(0, len(p), block):
            where.setdefault(min(block, len(p) - k), []).append((i, k // block))
    frames: list[list[bytes]] = [[b""] * -(-len(p) // block) for p in payloads]
    for n, own in where.items():
        for g in range(0, len(own), GROUP):
            part = own[g : g + GROUP]
            x = np.frombuffer(b"".join(payloads[i][k * block : k * block + n] for i, k in part), np.uint8).reshape(-1, n).astype(np.int64) - 128
            body = [_header(k, n) + b for (_, k), b in zip(part, _bodies(x, lpc_order), strict=True)] if n > 4 + lpc_order else [_header(k, n) + b"\x02" + r.astype(np.int8).tobytes() for (_, k), r in zip(part, x, strict=True)]
            for (i, k), b, c in zip(part, body, crc16(body).tolist(), strict=True):
                frames[i][k] = b + struct.pack(">H", c)
    out = []
    for p, f in zip(payloads, frames, strict=True):
        sizes = [len(x) for x in f] or [0]
        least = max(16, min(block, len(p)))
        info = struct.pack(">HH", least, max(least, block)) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest()
        points, at = [], 0
        every = max(1, -(-len(f) // MOST_POINTS))
        for k, s in enumerate(sizes[: len(f)]):
            if k % every == 0:
                points.append(struct.pack(">QQH", k * block, at, min(block, len(p) - k * block)))
            at += s
        table = b"".join(points)
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(f))
    return out


class _Frame:
    """A parsed frame header; `body` is the bit at which the subframe starts, counted from the frame's first byte."""

    __slots__ = ("body", "number", "size")

    def __init__(self, data: bytes, at: int, block: int) -> None:
        if data[at : at + 1] != b"\xff" or data[at + 1] & 0xFE != 0xF8:
            raise ValueError("no frame where one should start")
        code, lead, p = data[at + 2] >> 4, data[at + 4], at + 5
        if data[at + 3] >> 4 or data[at + 3] >> 1 & 7 not in (0, 1):
            raise ValueError("only 8-bit mono streams can be read")
        more = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
        number = lead if not more else lead & 0x3F >> more
        for _ in range(more):
            number, p = number << 6 | data[p] & 63, p + 1
        if code == 6:
            size, p = data[p] + 1, p + 1
        elif code == 7:
            size, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
        else:
            size = SIZES[code]
        p += {12: 1, 13: 2, 14: 2}.get(data[at + 2] & 15, 0)
        if crc8(data[at:p]) != data[p]:
            raise ValueError("a frame header's CRC-8 differs")
        self.size, self.number, self.body = size, number if data[at + 1] & 1 else number * block, 8 * (p + 1 - at)


class _Bits:
    """Reads from many bit positions of one buffer at once."""

    def __init__(self, data: bytes) -> None:
        b = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
        self.w = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]

    def window(self, p: np.ndarray) -> np.ndarray:
        """The next 25 bits, at the upper end of 32."""
        return self.w[p >> 3] << (p & 7).astype(np.uint32)

    def take(self, p: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Unsigned numbers of k <= 25 bits."""
        return (self.window(p) >> np.uint32(1) >> (31 - k).astype(np.uint32)).astype(np.int64)


def _signed(v: np.ndarray, bits: int | np.ndarray) -> np.ndarray:
    return v - ((v >> (bits - 1) & 1) << bits)


def _decode_frames(data: bytes, starts: list[int], heads: list[_Frame]) -> tuple[list[bytes], list[int]]:
    """Payload bytes and end (byte) of each frame, CRC-16 not yet checked."""
    bits = _Bits(data)
    order_by = sorted(range(len(heads)), key=lambda i: -heads[i].size)
    size = np.array([heads[i].size for i in order_by])
    p = np.array([8 * starts[i] + heads[i].body for i in order_by])
    eight = np.full(len(p), 8)
    kind = bits.take(p, eight)
    if (kind & 0x81).any():
        raise ValueError("reserved bit or wasted bits in a subframe")
    kind, p = kind >> 1, p + 8
    out = np.zeros((int(size.max()), len(p)), np.int64)
    end = p.copy()
    for i in np.flatnonzero(kind < 2).tolist():
        n = 1 if kind[i] == 0 else int(size[i])
        out[: size[i], i] = np.frombuffer(data, np.int8, n, int(p[i]) // 8)
        end[i] += 8 * n
    own = np.flatnonzero(kind >= 2)
    if ((kind[own] < 8) | (kind[own] > 12) & (kind[own] < 32)).any():
        raise ValueError("a reserved subframe type")
    if len(own):
        kind, size, p = kind[own], size[own], p[own]
        lpc = kind >= 32
        order = np.where(lpc, (kind & 31) + 1, kind & 7)
        r = np.zeros((int(size[0]), len(own)), np.int64)
        for j in range(int(order.max())):
            on = order > j
            r[j, on] = _signed(bits.take(p[on], np.full(on.sum(), 8)), 8)
            p = p + 8 * on
        coef, shift = np.zeros((32, len(own)), np.int64), np.zeros(len(own), np.int64)
        for o, c in enumerate(FIXED):
            coef[: len(c), ~lpc & (order == o)] = np.array(c, np.int64)[:, None]
        if lpc.any():
            width = bits.take(p, np.full(len(p), 4)) + 1
            shift = np.where(lpc, _signed(bits.take(p + 4, np.full(len(p), 5)), 5), 0)
            p = p + 9 * lpc
            for j in range(int(order[lpc].max())):
                on = lpc & (order > j)
                coef[j, on] = _signed(bits.take(p[on], width[on]), width[on])
                p = p + width * on
        method = bits.take(p, np.full(len(p), 2))
        if (method > 1).any():
            raise ValueError("a reserved residual coding")
        wide = 4 + method
        part = size >> bits.take(p + 2, np.full(len(p), 4))
        p = p + 6
        k, raw = np.zeros(len(p), np.int64), np.full(len(p), -1)
        nxt = order.copy()  # where the next partition's parameter stands
        due, first = int(nxt.min()), np.zeros(len(p), bool)
        for i in range(int(size[0])):
            live = int(np.searchsorted(-size, -i))  # frames of more than i samples stand first
            if i >= due:
                on = np.flatnonzero(nxt[:live] == i)
                k[on] = bits.take(p[on], wide[on])
                p[on] += wide[on]
                esc = on[k[on] == (1 << wide[on]) - 1]
                raw[on] = -1
                raw[esc] = bits.take(p[esc], np.full(len(esc), 5))
                p[esc] += 5
                nxt[on] = np.where(first[on], i + part[on], part[on])
                first[on] = True
                due = int(nxt[:live][nxt[:live] > i].min(initial=1 << 60))
                busy = None if (order[:live] <= i).all() and (raw[:live] < 0).all() else True
            if i < due and i < int(order.max()) or busy:
                lanes = np.flatnonzero((order[:live] <= i) & (raw[:live] < 0))
                esc = np.flatnonzero((order[:live] <= i) & (raw[:live] >= 0))
                if len(esc):
                    r[i, esc] = np.where(raw[esc] > 0, _signed(bits.take(p[esc], raw[esc]), np.maximum(raw[esc], 1)), 0)
                    p[esc] += raw[esc]
                pl, kl = p[lanes], k[lanes]
            else:
                lanes, pl, kl = None, p[:live], k[:live]
            q = ZEROS[bits.window(pl) >> 16]
            pl = pl + q
            far = np.flatnonzero(q == 16)
            while len(far):
                z = ZEROS[bits.window(pl[far]) >> 16]
                q[far] += z
                pl[far] += z
                far = far[z == 16]
                if len(far) and pl[far].max() > 8 * len(data):
                    raise ValueError("a residual runs past the stream")
            pl += 1
            v = q << kl | bits.take(pl, kl)
            v = v >> 1 ^ -(v & 1)
            if lanes is None:
                r[i, :live] = v
                p[:live] = pl + kl
            else:
                r[i, lanes] = v
                p[lanes] = pl + kl
        end[own] = p
        for o in np.unique(order).tolist():
            for is_lpc in (False, True):
                on = np.flatnonzero((order == o) & (lpc == is_lpc))
                if not len(on):
                    continue
                x = r[:, on]
                if not is_lpc and o == 1:
                    x = np.cumsum(x, 0)
                elif not is_lpc and o == 2:
                    x[1] -= x[0]
                    x = np.cumsum(np.concatenate([x[:1], np.cumsum(x[1:], 0)]), 0)
                elif o:
                    c, s = coef[:o, on], shift[on]
                    for i in range(o, len(x)):
                        x[i] += (c * x[i - o : i][::-1]).sum(0) >> s
                r[:, on] = x
        out[:, own] = r
    flat = ((out + 128) & 0xFF).astype(np.uint8).T
    texts, ends = [b""] * len(heads), [0] * len(heads)
    for j, i in enumerate(order_by):
        texts[i] = flat[j, : heads[i].size].tobytes()
        ends[i] = -(-int(end[j]) // 8)
    return texts, ends


def _metadata(s: bytes) -> tuple[int, int, bytes, list[tuple[int, int, int]], int]:
    """Block size, samples, MD5, seek points, and where the frames start."""
    if s[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, points, info, last = 4, [], b"", False
    while not last:
        kind, n = s[at], int.from_bytes(s[at + 1 : at + 4], "big")
        last, body = bool(kind & 0x80), s[at + 4 : at + 4 + n]
        if kind & 0x7F == 0:
            info = body
        elif kind & 0x7F == 3:
            points = [x for x in struct.iter_unpack(">QQH", body) if x[0] != (1 << 64) - 1]
        at += 4 + n
    bits = int.from_bytes(info[10:18], "big")
    if bits >> 36 & 0xFF != 7:
        raise ValueError("only 8-bit mono streams can be read")
    return struct.unpack(">H", info[2:4])[0], bits & (1 << 36) - 1, info[18:34], points, at


def decode_blocks(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """(sample offset, PCM bytes) of each frame of each stream; checksums verified."""
    out: list[list[tuple[int, bytes]]] = []
    todo: list[tuple[int, int, int]] = []  # stream, start, end of a frame
    ends: list[int] = []
    for i, s in enumerate(streams):
        block, total, _, points, at = _metadata(s)
        out.append([])
        if sum(x[2] for x in points) == total:
            starts = [at + x[1] for x in points]
            todo += [(i, a, b) for a, b in zip(starts, [*starts, len(s)][1:], strict=True)]
        else:
            done = 0
            while done < total:
                head = _Frame(s, at, block)
                pcm, (end,) = _decode_frames(s, [at], [head])
                _verify([s[at : end + 2]])
                out[i].append((head.number, pcm[0]))
                at, done = end + 2, done + head.size
        ends.append(block)
    for g in range(0, len(todo), GROUP):
        part = todo[g : g + GROUP]
        frames = [streams[i][a:b] for i, a, b in part]
        _verify(frames)
        heads = [_Frame(f, 0, ends[i]) for f, (i, _, _) in zip(frames, part, strict=True)]
        starts, at = [], 0
        for f in frames:
            starts.append(at)
            at += len(f)
        pcm, stops = _decode_frames(b"".join(frames), starts, heads)
        for (i, _, _), f, h, x, a, z in zip(part, frames, heads, pcm, starts, stops, strict=True):
            if z + 2 != a + len(f):
                raise ValueError("a frame ends elsewhere than its seek point says")
            out[i].append((h.number, x))
    for s, blocks in zip(streams, out, strict=True):
        _, total, md5, _, _ = _metadata(s)
        whole = b"".join(x for _, x in blocks)
        if len(whole) != total or any(md5) and hashlib.md5((np.frombuffer(whole, np.uint8) ^ 0x80).tobytes()).digest() != md5:
            raise ValueError("the samples' MD5 differs")
    return out


def _verify(frames: list[bytes]) -> None:
    if crc16(frames).any():  # over a frame with its CRC at the end it is 0
        raise ValueError("a frame's CRC-16 differs")


def decode(streams: list[bytes]) -> list[bytes]:
    return [b"".join(x for _, x in b) for b in decode_blocks(streams)]


class Pcm:
    """Decoded blocks of a stream, found by sample offset."""

    def __init__(self, blocks: list[tuple[int, bytes]]) -> None:
        self.blocks = blocks
        self.offsets = [a for a, _ in blocks]
        self.samples = blocks[-1][0] + len(blocks[-1][1]) if blocks else 0

    def read(self, start: int, count: int) -> bytes:
        """The samples from `start` on, `count` of them or as many as there are."""
        out, end = [], min(start + count, self.samples)
        i = bisect_right(self.offsets, start) - 1
        while start < end:
            a, pcm = self.blocks[i]
            if not a <= start < a + len(pcm):
                raise ValueError("a gap between blocks")
            out.append(pcm[start - a : end - a])
            start, i = a + len(pcm), i + 1
        return b"".join(out)


def feature(payload: bytes) -> str:
    """Moments, level crossings and entropy of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    n = np.bincount(x + 128, minlength=256)
    p = n[n > 0] / max(1, len(x))
    mean = int(x.sum()) / max(1, len(x))
    over = x > mean
    return f"n={len(x)};sum={int(x.sum())};sumsq={int((x * x).sum())};cross={int((over[1:] != over[:-1]).sum())};levels={len(p)};entropy={-sum(v * math.log2(v) for v in p.tolist()):.6f}"


def text_payload(text: str, unit: int = 192) -> bytes:
    b = text.encode()
    return b + b" " * (max(unit, -(-len(b) // unit) * unit) - len(b))


def media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and media: the stored form of each text as a column of FLAC streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(encode([text_payload(t) for t in texts], lpc_order=LPC_ORDER), pa.binary())], ["key", "n_bytes", "media"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def _streams(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for batch in batches:
        got, at, size = batch.column(column).to_pylist(), 0, 0
        for i, s in enumerate(got):
            if i > at and size + len(s or b"") > limit:
                yield batch.slice(at, i - at), got[at:i]
                at, size = i, 0
            size += len(s or b"")
        if at < len(got):
            yield batch.slice(at), got[at:]


def pcm_blocks(stored: DataFrame) -> DataFrame:
    """key, block, sample_offset and pcm (binary) of rows with key and media; null streams have no blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, got in _streams(batches, 1):
            keep = [i for i, s in enumerate(got) if s is not None]
            rows = [(i, k, a, x) for i, blocks in zip(keep, decode_blocks([got[i] for i in keep]), strict=True) for k, (a, x) in enumerate(blocks)]
            which = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(which), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], ["key", "block", "sample_offset", "pcm"])

    return stored.select("key", "media").mapInArrow(run, f"key {stored.schema['key'].dataType.simpleString()}, block int, sample_offset long, pcm binary")


def digests(stored: DataFrame) -> DataFrame:
    """Reads the media column back and describes the payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, got in _streams(batches, 2):
            got = [s or b"" for s in got]
            read = [Pcm(b) for b in decode_blocks(got)]
            pay = [p.read(0, p.samples) for p in read]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([len(p) for p in pay], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in pay]),
                    pa.array([zlib.crc32(p.read(p.samples - 16, 16)) for p in read], pa.int64()),
                    pa.array([len(s) for s in got], pa.int64()),
                    pa.array([hashlib.sha256(s).hexdigest() for s in got]),
                    pa.array([feature(p) for p in pay]),
                ],
                ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return stored.select("key", "n_bytes", "media").mapInArrow(run, f"key {stored.schema['key'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

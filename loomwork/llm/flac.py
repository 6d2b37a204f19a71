"""Media columns: bytes stored as 8-bit FLAC, and a decoder that turns FLAC back into PCM blocks with sample offsets.

A text's UTF-8 bytes, padded with bytes 0 to a positive multiple of PAD, are the samples of one 8-bit channel (byte minus
128). The encoder cuts them into frames of BLOCK samples, picks for each frame the cheapest of the fixed predictor of order 1,
a quantized linear predictor of order LPC_ORDER, and plain samples, and codes the residual in eight Rice
partitions. A stream has STREAMINFO with the MD5 of its samples and a SEEKTABLE with a point for each frame.

The decoder reads constant, verbatim, fixed and LPC subframes of one channel of 8 bits, with Rice parameters of four or five
bits and escaped partitions; it checks CRC-8 of each header, CRC-16 of each frame and the MD5 of the whole. Frames are
decoded many at a time: one step handles the next sample of every frame.

Texts are taken some PART bytes at a time (a longer text by itself) and frames some AT_ONCE bytes at a time, so memory is a few
times the longest text.
Encoding uses integers, and floating point only element by element, so equal texts give equal streams.

Defined cases: null or empty text is stored as PAD bytes 0; repeated rows give equal rows; a table without rows gives
none; other columns are not read; a damaged stream raises FlacError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwork.llm.common import only, slices, unknown

PAD = 64
BLOCK = 4096
RATE = 8000
PARTS = 8  # Rice partitions of a frame the encoder writes; PAD / PARTS samples at least
LPC_ORDER = 4
PRECISION = 12
PART = 2_000_000
#: Bytes of samples, or of frames, that are coded or decoded at once; about 100 bytes of memory each.
AT_ONCE = 2_000_000
#: Coefficients of the fixed predictors by order. Fixed values.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class FlacError(ValueError):
    pass


# --- checksums


def crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16)


CRC8 = crc_table(0x07, 8)
CRC16 = crc_table(0x8005, 16)
_AFTER: list[np.ndarray] = [CRC16[None, :]]


def after(n: int) -> np.ndarray:
    """Row d: what each byte adds to the CRC-16 when d bytes follow it. The CRC is linear, so a frame's is their XOR."""
    t = _AFTER[0]
    if len(t) < n:
        rows = [*t]
        while len(rows) < n + 1024:
            last = rows[-1]
            rows.append((last << 8 & 0xFFFF).astype(np.uint16) ^ CRC16[last >> 8])
        _AFTER[0] = t = np.stack(rows)
    return t


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start:end] for runs that follow each other without a gap in `data` or with one."""
    n = ends - starts
    if not len(n):
        return np.empty(0, np.uint16)
    table = after(int(n.max()))
    place = np.repeat(ends - np.cumsum(n), n) + np.arange(n.sum())
    left = np.repeat(ends, n) - 1 - place
    return np.bitwise_xor.reduceat(table[left, data[place]], np.append(0, np.cumsum(n)[:-1]))


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


# --- encoding


def coded_number(n: int) -> bytes:
    """A frame's number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = 1
    while n >= 1 << (6 * size + 6 - size):
        size += 1
    for _ in range(size):
        tail.append(0x80 | n & 63)
        n >>= 6
    return bytes([0xFF << (7 - size) & 0xFF | n, *reversed(tail)])


def frame_header(number: int, samples: int) -> bytes:
    head = b"\xff\xf8\x70\x02" + coded_number(number) + (samples - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


def lpc(x: np.ndarray, t: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantized coefficients (frames, LPC_ORDER) and shifts from the autocorrelation, by Levinson's recursion."""
    frames, order = len(starts), LPC_ORDER
    auto = np.empty((order + 1, frames), np.float64)
    for lag in range(order + 1):
        prod = x * x
        if lag:
            prod[lag:] = x[lag:] * x[:-lag]
            prod[t < lag] = 0
        auto[lag] = np.add.reduceat(prod, starts)  # at most BLOCK * 128 * 128, exact
    error = np.maximum(auto[0], 1.0)
    a = np.zeros((frames, order))
    for i in range(order):
        acc = auto[i + 1].copy()
        for j in range(i):
            acc = acc - a[:, j] * auto[i - j]
        k = acc / error
        new = a.copy()
        new[:, i] = k
        for j in range(i):
            new[:, j] = a[:, j] - k * a[:, i - 1 - j]
        a = new
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = np.maximum(np.abs(a).max(axis=1), 1e-9)
    _, exponent = np.frexp(most)
    shift = np.clip(PRECISION - 1 - exponent, 0, 15)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * np.exp2(shift)[:, None]), -limit, limit).astype(np.int64), shift.astype(np.int64)


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """A FLAC stream for each payload (uint8, a positive multiple of PAD long). Frames are coded some AT_ONCE bytes at a time."""
    sizes = np.array([len(p) for p in payloads])
    frames_of = -(-sizes // BLOCK)
    doc = np.repeat(np.arange(len(payloads)), frames_of)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(frames_of) - frames_of, frames_of)
    n = np.minimum(BLOCK, sizes[doc] - number * BLOCK)
    coded, sizes_of = [], []
    for f, g in parts(n, AT_ONCE):
        some = [payloads[d][k * BLOCK : k * BLOCK + m] for d, k, m in zip(doc[f:g].tolist(), number[f:g].tolist(), n[f:g].tolist(), strict=True)]
        data, each = encode_frames(np.concatenate(some), number[f:g], n[f:g])
        coded.append(data)
        sizes_of.append(each)
    whole, frame_bytes = b"".join(coded), np.concatenate(sizes_of)
    del coded
    frame_at = np.cumsum(frame_bytes) - frame_bytes
    streams, f = [], 0
    for p, many in zip(payloads, frames_of.tolist(), strict=True):
        a, b = int(frame_at[f]), int(frame_at[f + many - 1] + frame_bytes[f + many - 1])
        sizes_b = frame_bytes[f : f + many]
        fixed = BLOCK if many > 1 else min(BLOCK, len(p))
        stream = fixed.to_bytes(2, "big") * 2 + int(sizes_b.min()).to_bytes(3, "big") + int(sizes_b.max()).to_bytes(3, "big")
        stream += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + md5_of(p)
        points = b"".join(int(number[i] * BLOCK).to_bytes(8, "big") + int(frame_at[i] - a).to_bytes(8, "big") + int(n[i]).to_bytes(2, "big") for i in range(f, f + many))
        streams.append(b"".join([b"fLaC\x00", len(stream).to_bytes(3, "big"), stream, b"\x83", len(points).to_bytes(3, "big"), points, whole[a:b]]))
        f += many
    return streams


def parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs (first, end) of neighbours of about `most` in all, or one where one is larger."""
    upto = np.append(0, np.cumsum(sizes))
    f = 0
    while f < len(sizes):
        g = max(f + 1, int(np.searchsorted(upto, upto[f] + most, side="right")) - 1)
        yield f, g
        f = g


def md5_of(payload: np.ndarray) -> bytes:
    """MD5 of the signed samples of a payload."""
    md5 = hashlib.md5()
    for a in range(0, len(payload), AT_ONCE):
        md5.update(payload[a : a + AT_ONCE] ^ 128)
    return md5.digest()


def encode_frames(payload: np.ndarray, number: np.ndarray, n: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The frames with these numbers and numbers of samples, one after the other, and the bytes of each."""
    x = payload.astype(np.int32) - 128
    starts = np.cumsum(n) - n
    t = (np.arange(len(x)) - np.repeat(starts, n)).astype(np.int32)
    coef, shift = lpc(x, t, starts)

    # candidates: residuals folded to unsigned, with zeros where a frame warms up
    def residual(c: np.ndarray, s: np.ndarray, order: int) -> np.ndarray:
        predicted = np.zeros(len(x), np.int32)
        for j in range(order):
            predicted[j + 1 :] += np.repeat(c[:, j], n)[j + 1 :] * x[: len(x) - 1 - j]
        r = x - (predicted >> np.repeat(s, n) if s.any() else predicted)
        u = (r << 1) ^ (r >> 31)
        u[t < order] = 0
        return u

    coef, shift = coef.astype(np.int32), shift.astype(np.int32)
    plans = [(1, np.ones((len(n), 1), np.int32), np.zeros(len(n), np.int32)), (LPC_ORDER, coef, shift)]
    part_n = np.repeat(n // PARTS, PARTS)
    part_at = np.repeat(starts, PARTS) + np.tile(np.arange(PARTS), len(n)) * part_n
    params, costs, folded = [], [], []
    for kind, (order, c, s) in enumerate(plans):
        u = residual(c, s, order)
        total = np.add.reduceat(u, part_at)
        counts = part_n - np.where(np.arange(len(part_n)) % PARTS == 0, order, 0)
        bits = np.stack([counts * (k + 1) + (total >> k) for k in range(12)])
        k = bits.argmin(axis=0)
        params.append(k)
        head = order * 8 + (9 + LPC_ORDER * PRECISION if kind else 0) + 6 + 4 * PARTS
        costs.append(bits.min(axis=0).reshape(-1, PARTS).sum(axis=1) + head)
        folded.append(u)
    costs.append(n * 8)
    choice = np.stack(costs).argmin(axis=0)  # 0 fixed, 1 linear, 2 plain
    order = np.array([1, LPC_ORDER, 0])[choice]
    u = np.where(np.repeat(choice == 0, n), *folded)
    k_part = np.where(np.repeat(choice == 0, PARTS), *params)
    k = np.repeat(k_part.astype(np.int32), part_n)
    raw = t < np.repeat(np.where(choice == 2, n, order), n)

    # bits: sizes of all pieces in order, then their places
    heads = [frame_header(int(a), int(b)) for a, b in zip(number, n, strict=True)]
    head_n = np.array([len(h) for h in heads])
    linear = choice == 1
    fore = 8 * head_n + 8  # frame header and subframe header
    between = np.where(choice == 2, 0, np.where(linear, 9 + LPC_ORDER * PRECISION, 0) + 6)  # after the warm-up samples
    length = np.where(raw, 8, (u >> k) + 1 + k)
    first = part_at + np.where(np.arange(len(part_at)) % PARTS == 0, order.repeat(PARTS), 0)  # first coded sample of each partition
    gap = np.zeros(len(x) + 1, np.int64)
    coded = np.repeat(choice != 2, PARTS)
    gap[first[coded]] += 4
    gap[starts] += fore
    body = starts + order
    gap[body] += between
    run = np.cumsum(gap[:-1] + length) - length  # place of each sample's code if frames were not aligned
    ends = run[starts + n - 1] + length[starts + n - 1]
    frame_bits = ends - np.append(0, ends[:-1])
    frame_bytes = -(-frame_bits // 8) + 2
    frame_at = np.cumsum(frame_bytes) - frame_bytes
    moved = 8 * frame_at - np.append(0, ends[:-1])
    at = run + np.repeat(moved, n)
    bits = np.zeros(8 * int(frame_bytes.sum()), np.uint8)

    at_raw, value = at[raw], (x[raw] & 255).astype(np.uint8)
    for b in range(8):
        bits[at_raw + b] = value >> (7 - b) & 1
    code = ~raw
    u_c, k_c = u[code], k[code]
    stop = at[code] + (u_c >> k_c)
    bits[stop] = 1
    end, low = stop + k_c, (u_c & ((1 << k_c) - 1)).astype(np.uint16)
    for b in range(int(k_c.max(initial=0))):
        if b:
            more = k_c > b
            if not more.all():
                end, low, k_c = end[more], low[more], k_c[more]
        else:
            more = k_c > 0
            end, low, k_c = end[more], low[more], k_c[more]
        bits[end - b] = low >> b & 1

    def put(places: np.ndarray, values: np.ndarray, width: int) -> None:
        for b in range(width):
            bits[places + b] = values >> (width - 1 - b) & 1

    put(at[first[coded]] - 4, k_part[coded], 4)
    sub = 8 * (frame_at + head_n)
    put(sub, np.array([9 << 1, (31 + LPC_ORDER) << 1, 1 << 1])[choice], 8)
    mid = sub + 8 + 8 * order
    put(mid[linear], np.full(int(linear.sum()), PRECISION - 1), 4)
    put(mid[linear] + 4, shift[linear], 5)
    for j in range(LPC_ORDER):
        put(mid[linear] + 9 + j * PRECISION, coef[linear, j] & ((1 << PRECISION) - 1), PRECISION)
    res = mid + np.where(linear, 9 + LPC_ORDER * PRECISION, 0)
    has = choice != 2
    put(res[has], np.full(int(has.sum()), PARTS.bit_length() - 1), 6)

    out = np.packbits(bits)
    for h, a in zip(heads, frame_at.tolist(), strict=True):
        out[a : a + len(h)] = np.frombuffer(h, np.uint8)
    crc = crc16(out, frame_at, frame_at + frame_bytes - 2)
    out[frame_at + frame_bytes - 2], out[frame_at + frame_bytes - 1] = crc >> 8, crc & 255

    return out.tobytes(), frame_bytes


# --- decoding


class Info(NamedTuple):
    samples: int
    md5: bytes
    points: list[tuple[int, int, int]]  # first sample, offset of the frame, samples
    frames_at: int


def parse(stream: bytes) -> Info:
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, info, points = 4, None, []
    while True:
        kind, size = stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body, last = stream[at + 4 : at + 4 + size], stream[at] & 128
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if packed >> 41 & 7 or packed >> 36 & 31 != 7:
                raise FlacError("not one channel of 8 bits")
            info = (packed & (1 << 36) - 1, body[18:34])
        elif kind == 3:
            points += [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, len(body), 18)]
        at += 4 + size
        if last:
            break
    if info is None:
        raise FlacError("no STREAMINFO")
    return Info(info[0], info[1], [p for p in points if p[0] != (1 << 64) - 1], at)


def header(data: bytes, at: int) -> tuple[int, int]:
    """(samples, bytes) of the frame header at a place, after its CRC-8 was checked."""
    if data[at : at + 2] != b"\xff\xf8":
        raise FlacError("lost sync")
    size_code, end = data[at + 2] >> 4, at + 4
    lead = data[end]
    end += 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    samples = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}.get(size_code, 0)
    if size_code in (6, 7):
        width = size_code - 5
        samples = int.from_bytes(data[end : end + width], "big") + 1
        end += width
    rate = data[at + 2] & 15
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if not samples or data[at + 3] >> 4 or crc8(data[at:end]) != data[end]:
        raise FlacError("bad frame header")
    return samples, end + 1 - at


class Bits:
    """Next-one table and 32-bit words of a buffer of frames."""

    def __init__(self, data: np.ndarray):
        padded = np.append(data, np.zeros(8, np.uint8))
        ones = np.unpackbits(padded).view(bool)
        place = np.where(ones, np.arange(len(ones), dtype=np.int32), np.int32(len(ones)))
        self.next_one = np.minimum.accumulate(place[::-1])[::-1]
        p = padded.astype(np.uint32)
        self.words = p[:-3] << 24 | p[1:-2] << 16 | p[2:-1] << 8 | p[3:]

    def read(self, at: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Up to 24 bits at each place."""
        w = self.words[at >> 3].astype(np.int64)
        return w >> (32 - (at & 7) - width) & ((1 << width) - 1)


def signed(v: int, width: int) -> int:
    return v - (1 << width) if v >> (width - 1) & 1 else v


def decode_frames(data: bytes, at: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Samples of the frames that begin at the given places, one frame after the other, the number of samples of each, where each ends, and its kind."""
    raw = np.frombuffer(data, np.uint8)
    bits = Bits(raw)
    frames = len(at)
    n, order, body = np.zeros(frames, np.int64), np.zeros(frames, np.int64), np.zeros(frames, np.int64)
    kinds, coefs, shifts = [], np.zeros((frames, 32), np.int64), np.zeros(frames, np.int64)
    rice = np.zeros(frames, np.int64)  # width of the parameters; 0 without a residual
    part_order, warm = np.zeros(frames, np.int64), np.zeros(frames, np.int64)
    for i, a in enumerate(at):
        n[i], size = header(data, a)
        p = a + size
        code = data[p] >> 1
        if data[p] & 0x81:
            raise FlacError("wasted bits aren't read")
        p = 8 * (p + 1)
        if code in (0, 1):
            kinds.append("constant" if code == 0 else "verbatim")
        elif 8 <= code <= 12 or code >= 32:
            order[i] = o = code - 8 if code < 32 else code - 31
            kinds.append("fixed" if code < 32 else "lpc")
            warm[i] = p >> 3
            p += 8 * o
            v, left = int.from_bytes(data[p >> 3 : (p >> 3) + 72], "big"), 8 * min(72, len(data) - (p >> 3))
            take = lambda w, at: v >> (left - at - w) & ((1 << w) - 1)  # noqa: B023, E731
            used = 0
            if code < 32:
                coefs[i, :o] = FIXED[o]
            else:
                width, shifts[i] = take(4, 0) + 1, signed(take(5, 4), 5)
                used = 9 + o * width
                coefs[i, :o] = [signed(take(width, 9 + j * width), width) for j in range(o)]
            rice[i] = {0: 4, 1: 5}.get(take(2, used), 0)
            if not rice[i] or shifts[i] < 0:
                raise FlacError("unknown residual")
            part_order[i] = take(4, used + 2)
            p += used + 6
        else:
            raise FlacError("reserved subframe")
        body[i] = p
    starts = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.int64)
    end = body.copy()

    flat = np.array([k == "constant" for k in kinds])
    for i in np.flatnonzero(flat):
        out[starts[i] : starts[i] + n[i]] = signed(data[body[i] >> 3], 8)
        end[i] += 8
    for i in np.flatnonzero(np.array([k == "verbatim" for k in kinds])):
        out[starts[i] : starts[i] + n[i]] = raw[body[i] >> 3 : (body[i] >> 3) + n[i]].view(np.int8)
        end[i] += 8 * n[i]

    lanes = np.flatnonzero(rice > 0)
    lanes = lanes[np.argsort(-(n - order)[lanes], kind="stable")]
    if len(lanes):
        todo = (n - order)[lanes]
        live = np.searchsorted(-todo, -np.arange(int(todo[0])), side="left")  # lanes with more than t coded samples
        pos, to = body[lanes].copy(), (starts + order)[lanes]
        size, width = (n >> part_order)[lanes], rice[lanes]
        left, k = size - order[lanes], np.zeros(len(lanes), np.int64)
        fresh = np.ones(len(lanes), bool)
        escape = np.full(len(lanes), -1, np.int64)
        for t, m in enumerate(live.tolist()):
            new = np.flatnonzero(fresh[:m])
            if len(new):
                k[new] = bits.read(pos[new], width[new])
                pos[new] += width[new]
                raw_width = k[new] == (1 << width[new]) - 1
                escape[new] = -1
                if raw_width.any():
                    e = new[raw_width]
                    escape[e] = bits.read(pos[e], np.full(len(e), 5))
                    pos[e] += 5
                fresh[new] = False
            p, kk = pos[:m], k[:m]
            one = bits.next_one[p].astype(np.int64)
            low = one + 1
            u = (one - p) << kk | (bits.words[low >> 3].astype(np.int64) >> (32 - (low & 7) - kk) & ((1 << kk) - 1))
            r = (u >> 1) ^ -(u & 1)
            new_pos = low + kk
            esc = escape[:m] >= 0
            if esc.any():
                w = escape[:m][esc]
                v = bits.read(p[esc], w)
                r[esc] = np.where(w > 0, v - ((v >> np.maximum(w - 1, 0) & 1) << w), 0)
                new_pos[esc] = p[esc] + w
            pos[:m] = new_pos
            out[to[:m] + t] = r
            left[:m] -= 1
            done = left[:m] == 0
            if done.any():
                fresh[:m] |= done
                left[:m][done] = size[:m][done]
        end[lanes] = pos
        for i in lanes:
            o = int(order[i])
            out[starts[i] : starts[i] + o] = raw[warm[i] : warm[i] + o].view(np.int8)
        restore(out, starts, n, order, coefs, shifts, lanes)
    last = -(-end // 8)
    crc = crc16(raw, np.array(at, np.int64), last)
    if not np.array_equal(crc, raw[last].astype(np.uint16) << 8 | raw[last + 1]):
        raise FlacError("bad frame checksum")
    return out, n, last + 2, kinds


def restore(out: np.ndarray, starts: np.ndarray, n: np.ndarray, order: np.ndarray, coefs: np.ndarray, shifts: np.ndarray, lanes: np.ndarray) -> None:
    """Turn residuals into samples in place: step by step, for all frames at once."""
    lanes = lanes[order[lanes] > 0]
    if not len(lanes):
        return
    lanes = lanes[np.argsort(-n[lanes], kind="stable")]
    most = int(order[lanes].max())
    live = np.searchsorted(-n[lanes], -np.arange(int(n[lanes[0]])), side="left")
    at, c, s, o = starts[lanes], [coefs[lanes, j].copy() for j in range(most)], shifts[lanes], order[lanes]
    past = [np.zeros(len(lanes), np.int64) for _ in range(most)]
    for t, m in enumerate(live.tolist()):
        place = at[:m] + t
        predicted = c[0][:m] * past[0][:m]
        for j in range(1, most):
            predicted += c[j][:m] * past[j][:m]
        predicted >>= s[:m]
        if t < most:
            predicted[t < o[:m]] = 0
        now = out[place] + predicted
        out[place] = now
        past = [now, *past[:-1]]


def decode(streams: list[bytes]) -> tuple[list[np.ndarray], list[list[tuple[int, int]]], list[list[str]]]:
    """For each stream its samples as uint8, its blocks (first sample, samples) and their kinds. Checksums are verified."""
    infos = [parse(s) for s in streams]
    data, at, owner = b"".join(streams), [], []
    base = 0
    for i, (s, info) in enumerate(zip(streams, infos, strict=True)):
        if info.points:
            places = [base + info.frames_at + p[1] for p in info.points]
        else:
            places = walk_frames(s, info, base)
        at += places
        owner += [i] * len(places)
        base += len(s)
    edges = np.append(np.array(at, np.int64), len(data))
    found = []
    for f, g in parts(np.diff(edges), AT_ONCE):
        low = int(edges[f])
        out, n, ends, kinds = decode_frames(data[low : int(edges[g])], (edges[f:g] - low).tolist())
        found.append(((out + 128).astype(np.uint8), n, ends + low, kinds))
    payload, n, ends = (np.concatenate([x[i] for x in found] or [np.empty(0, np.int64)]) for i in range(3))
    kinds = [k for x in found for k in x[3]]
    del found
    owner = np.array(owner)
    bounds = np.cumsum(n) - n
    results, blocks, kinds_of, f, base = [], [], [], 0, 0
    for i, (s, info) in enumerate(zip(streams, infos, strict=True)):
        g = f
        while g < len(owner) and owner[g] == i:
            g += 1
        many = g - f
        a = int(bounds[f]) if many else 0
        total = int(n[f:g].sum())
        p = payload[a : a + total]
        base += len(s)
        follows = [*at[f + 1 : g], base]
        if total != info.samples or [int(x) for x in ends[f:g]] != follows:
            raise FlacError("frames don't make up the stream")
        if md5_of(p) != info.md5:
            raise FlacError("bad MD5 of the samples")
        first = np.cumsum(n[f:g]) - n[f:g]
        results.append(p)
        blocks.append([(int(x), int(y)) for x, y in zip(first, n[f:g], strict=True)])
        kinds_of.append(kinds[f:g])
        f = g
    return results, blocks, kinds_of


def walk_frames(stream: bytes, info: Info, base: int) -> list[int]:
    """Places of the frames of a stream without seek points: each begins where the one before ends.

    A frame is looked for in as many bytes as its samples would take plain, and in twice as many as often as it is cut short.
    """
    places, at = [], info.frames_at
    while at < len(stream):
        places.append(base + at)
        size = header(stream, at)[0] + 64
        while True:
            part = stream[at : at + size]
            try:
                end = int(decode_frames(part, [0])[2][0])
                break
            except (FlacError, IndexError):
                if at + size >= len(stream):
                    raise
                size *= 2
        at += end
    return places


# --- columns


def payload_of(text: bytes) -> np.ndarray:
    padded = max(1, -(-len(text) // PAD)) * PAD
    return np.frombuffer(text.ljust(padded, b"\0"), np.uint8)


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def media(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, media binary: the FLAC stream of each text."""
    unknown(df, [*keep, "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", PART):
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(encode([payload_of(t) for t in raw(b, "text")]), pa.binary())], [*keep, "media"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return only(df, *dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{fields}, media binary")


def pcm_blocks(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, block, sample_offset, n_samples, pcm: one row for each frame of the streams in column media.

    Written partitioned or sorted by the keys, a reader seeks to a sample by sample_offset alone.
    """
    unknown(df, [*keep, "media"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "media", PART):
                found, blocks, _ = decode([x for x in b.column("media").to_pylist() if x])
                rows = pa.array([i for i, x in enumerate(b.column("media").to_pylist()) if x], pa.int64())
                each = np.repeat(np.arange(len(blocks)), [len(x) for x in blocks])
                flat = [(j, o, n, found[i][o : o + n].tobytes()) for i, x in enumerate(blocks) for j, (o, n) in enumerate(x)]
                cols = list(zip(*flat, strict=True)) or [[]] * 4
                take = rows.take(pa.array(each, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in keep), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], [*keep, "block", "sample_offset", "n_samples", "pcm"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return only(df, *dict.fromkeys([*keep, "media"])).mapInArrow(run, f"{fields}, block bigint, sample_offset bigint, n_samples bigint, pcm binary")


def feature(samples: np.ndarray, kinds: list[str]) -> str:
    """Frames by kind, mean and root mean square of the samples to four digits, sign changes."""
    total = squares = changes = 0
    for a in range(0, len(samples), AT_ONCE):
        s = samples[max(0, a - 1) : a + AT_ONCE].astype(np.int64) - 128  # with the sample before, for its sign
        changes += int((np.signbit(s[1:]) != np.signbit(s[:-1])).sum())
        own = s[min(a, 1) :]
        total, squares = total + int(own.sum()), squares + int((own * own).sum())
    count = ",".join(f"{k}={kinds.count(k)}" for k in ("constant", "verbatim", "fixed", "lpc"))
    return f"{count},mean={total / len(samples):.4f},rms={(squares / len(samples)) ** 0.5:.4f},changes={changes}"


def report(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    All but n_bytes and the media's own figures come from the samples that the decoder reads back from the stream.
    """
    unknown(df, ["doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", PART):
                data = raw(b, "text")
                streams = encode([payload_of(t) for t in data])
                found, _, kinds = decode(streams)
                rows = [
                    (len(t), len(p), hashlib.sha256(p.tobytes()).hexdigest(), zlib.crc32(p[-PAD:].tobytes()), len(s), hashlib.sha256(s).hexdigest(), feature(p, k))
                    for t, p, s, k in zip(data, found, streams, kinds, strict=True)
                ]
                kind = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kind, strict=True))], NAMES)

    fields = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return only(df, "doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {fields}")


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

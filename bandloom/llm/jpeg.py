"""Progressive JPEG in numpy: coefficients to scans, scans to coefficients, coefficients to full-resolution RGB.

Blocks of many images are coded side by side. The encoder writes a restart interval of ``LANE`` blocks, so
the decoder can walk over all intervals of all images at once; it reads any Huffman-coded progressive
stream of 8-bit samples with one or three components, with or without restarts.
"""

from __future__ import annotations

import heapq
import struct
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np

#: The zigzag order of an 8 x 8 block.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
#: Blocks of a restart interval.
LANE = 4
#: Scans of Y and of a chroma component: first and last coefficient, high and low bit of the approximation.
LUMA = [(0, 0, 0, 0), (1, 5, 0, 1), (6, 63, 0, 1), (1, 63, 1, 0)]
CHROMA = [(0, 0, 0, 0), (1, 63, 0, 1), (1, 63, 1, 0)]
SCALE = 13


def _basis() -> np.ndarray:
    """Integer inverse transform: zigzag coefficient to pixel, scaled by 2**SCALE; sums stay exact in float64."""
    x, u = np.arange(8), np.arange(8)
    c = np.where(u == 0, np.sqrt(0.5), 1.0)[:, None] * np.cos((2 * x[None, :] + 1) * u[:, None] * np.pi / 16) / 2
    full = np.einsum("vy,ux->vuyx", c, c).reshape(64, 64)
    return np.rint(full[ZIGZAG] * (1 << SCALE))


BASIS = _basis()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def shape(mcus: int) -> tuple[int, int]:
    """Rows and columns of 16 x 16 units for at least so many; no side is over 65,520 pixels."""
    cols = min(mcus, max(64, -(-mcus // 4094)))
    rows = -(-mcus // cols)
    return rows, -(-mcus // rows)


def huffman(weights: dict[int, float]) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """Codes of at most 16 bits for symbols of these weights, none of all ones: counts a length, symbols in order, and by symbol code and length."""
    scale = 1 << 24
    while True:
        sizes = {s: max(1, int(w * scale)) for s, w in weights.items()}
        heap = [(n, s, (s,)) for s, n in sorted(sizes.items())] + [(0, -1, (-1,))]  # -1 takes the code of all ones
        length = dict.fromkeys([-1, *sizes], 0)
        heapq.heapify(heap)
        while len(heap) > 1:
            (a, i, x), (b, j, y) = heapq.heappop(heap), heapq.heappop(heap)
            for s in x + y:
                length[s] += 1
            heapq.heappush(heap, (a + b, min(i, j), x + y))
        if max(length.values()) <= 16:
            break
        scale //= 2
    order = sorted(length, key=lambda s: (length[s], s < 0, s))
    counts, codes, sizes_, code, last = [0] * 16, np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in order:
        code <<= length[s] - last
        last = length[s]
        if s >= 0:
            counts[last - 1] += 1
            codes[s], sizes_[s] = code, last
        code += 1
    return bytes(counts), bytes(s for s in order if s >= 0), codes, sizes_


def _tables() -> list[tuple]:
    """Tables of the DC, the first AC and the refining AC scans, from a model of text: the byte of rank r has a share falling by a tenth a rank."""
    share = 0.9 ** np.arange(256)
    share /= share.sum()
    value = (np.arange(256) + 1) // 2
    size = lambda v: int(v).bit_length()
    first = [float(share[[size(v >> 1) == k for v in value]].sum()) for k in range(8)]
    zero, new = float(share[0] / share[:3].sum()), float(share[1:3].sum() / share[:3].sum())
    dc = dict.fromkeys(range(9), 1.0)
    ac = {r << 4 | k: first[0] ** r * first[k] for r in range(16) for k in range(1, 8)} | {0xF0: first[0] ** 16, 0: 0.05}
    refine = {r << 4 | 1: zero**r * new for r in range(16)} | {0xF0: zero**16, 0: 0.1}
    return [huffman(x) for x in (dc, ac, refine)]


DC, AC, REFINE = _tables()


def encode(payloads: list[bytes]) -> list[bytes]:
    """One 4:2:0 progressive JPEG for each payload of a positive multiple of 64 bytes.

    Payload bytes are, in order, the zigzag coefficients of the Y, then the Cb, then the Cr blocks: the
    image's commonest byte is 0, the next ones 1, -1, 2, -2 and so on; blocks of zero bytes fill the last
    units. A comment holds the length and the bytes by rank.
    """
    sizes = [shape(-(-len(p) // 384)) for p in payloads]
    mcus = np.array([r * c for r, c in sizes])
    filled = b"".join(p.ljust(m * 384, b"\0") for p, m in zip(payloads, mcus.tolist(), strict=True))
    blocks = np.frombuffer(filled, np.uint8).reshape(-1, 64)
    first = np.concatenate([[0], np.cumsum(mcus * 6)])
    ranks, n = np.zeros((len(payloads), 256), np.int16), len(payloads)
    parts: list[list[bytes]] = [[] for _ in payloads]
    tables = b"".join(_segment(0xC4, bytes([kind]) + t[0] + t[1]) for kind, t in ((0x00, DC), (0x10, AC)))
    refine = _segment(0xC4, bytes([0x10]) + REFINE[0] + REFINE[1])
    for i, (p, (rows, cols)) in enumerate(zip(payloads, sizes, strict=True)):
        seen = np.bincount(blocks[first[i] : first[i + 1]].reshape(-1), minlength=256)
        order = np.argsort(-seen, kind="stable")
        ranks[i, order] = np.arange(256)
        told = b"bytes:%d;" % len(p) + order[: np.count_nonzero(seen)].astype(np.uint8).tobytes()
        frame = struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        parts[i] += [b"\xff\xd8", _segment(0xFE, told), _segment(0xDB, bytes([0, *[1] * 64])), _segment(0xC2, frame), _segment(0xDD, struct.pack(">H", LANE)), tables]
    value = (ranks + 1) // 2 * np.where(ranks % 2, 1, -1).astype(np.int16)
    for comp, (skip, share) in enumerate(((0, 4), (4, 1), (5, 1)), 1):
        counts = mcus * share
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        coefs = value[np.repeat(np.arange(n), counts)[:, None], blocks[np.repeat(first[:-1] + mcus * skip, counts) + nth]]
        ends = np.cumsum(-(-counts // LANE))
        for lo_k, hi_k, high, low in LUMA if comp == 1 else CHROMA:
            head = (refine if lo_k and high else tables if high == 0 and lo_k == 1 else b"") + _segment(0xDA, bytes([1, comp, 0, lo_k, hi_k, high << 4 | low]))
            data, offsets = _scan(coefs[:, lo_k : hi_k + 1], nth, high, low)
            at = np.concatenate([[0], offsets[ends - 1]]).tolist()
            for i in range(n):
                parts[i] += [head, data[at[i] : at[i + 1] - 2]]  # no restart marker after the last interval
    return [b"".join([*x, b"\xff\xd9"]) for x in parts]


def _scan(coefs: np.ndarray, nth: np.ndarray, high: int, low: int) -> tuple[bytes, np.ndarray]:
    """Entropy-coded intervals, each byte-aligned and followed by a restart marker; and where each ends."""
    out, ends, base, lo = [], [], 0, 0
    tokens = _dc_tokens if coefs.shape[1] == 1 else _refining_tokens if high else _first_tokens
    begins = np.flatnonzero(nth % LANE == 0)
    while lo < len(coefs):
        k = int(np.searchsorted(begins, lo + 8192))
        hi = int(begins[k]) if k < len(begins) else len(coefs)
        lane = np.cumsum(nth[lo:hi] % LANE == 0) - 1
        value, width, row = tokens(coefs[lo:hi].astype(np.int64), nth[lo:hi], low)
        own = lane[row]
        # Ones fill an interval's last byte; tokens of one interval lie together.
        bits = np.bincount(own, width, minlength=lane[-1] + 1).astype(np.int64)
        pad = -bits % 8
        start = np.cumsum(bits + pad) - bits - pad
        pos = np.cumsum(width) - width + (np.cumsum(pad) - pad)[own]
        some = pad > 0
        value, width, pos = np.concatenate([value, (1 << pad[some]) - 1]), np.concatenate([width, pad[some]]), np.concatenate([pos, (start + bits)[some]])
        packed = _put(value, width, pos, int(start[-1] + bits[-1] + pad[-1]) // 8)
        stuffed = packed == 0xFF
        last = (start + bits + pad) // 8 - 1  # an interval's last byte
        after = np.zeros(len(packed), np.int64)
        after[last] = 2
        after += stuffed
        place = np.arange(len(packed)) + np.cumsum(after) - after
        made = np.zeros(len(packed) + int(after.sum()), np.uint8)
        made[place] = packed
        end = place[last] + after[last] + 1
        made[end - 2] = 0xFF
        made[end - 1] = 0xD0 + nth[lo:hi][nth[lo:hi] % LANE == 0] // LANE % 8
        out.append(made.tobytes())
        ends.append(base + end)
        base += len(made)
        lo = hi
    return b"".join(out), np.concatenate(ends)


def _put(value: np.ndarray, width: np.ndarray, pos: np.ndarray, size: int) -> np.ndarray:
    """``size`` bytes with each value in its ``width`` bits from bit ``pos`` on; no two overlap and none has over 32."""
    word = value.astype(np.uint64) << (64 - width - (pos & 31)).astype(np.uint64)
    n = size // 4 + 3
    at = pos >> 5
    out = np.bincount(at, (word >> np.uint64(32)).astype(np.float64), minlength=n) + np.bincount(at + 1, (word & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    return np.frombuffer(out.astype(">u4").tobytes(), np.uint8)[:size]


def _bits_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size class and further bits of coefficients."""
    a = np.abs(v)
    size = _SIZES[a]
    return size, np.where(v < 0, v + (1 << size) - 1, v)


_SIZES = np.array([x.bit_length() for x in range(512)])


def _dc_tokens(coefs: np.ndarray, nth: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, widths and blocks of the codes of differences to the block before, within an interval."""
    v = coefs[:, 0]
    before = np.concatenate([[0], v[:-1]]) * (nth % LANE > 0)
    size, more = _bits_of(v - before)
    return DC[2][size] << size | more, DC[3][size] + size, np.arange(len(v))


def _first_tokens(coefs: np.ndarray, nth: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the upper bits: runs of zeros and a coefficient, 16 zeros, or the end of a block."""
    coefs = np.sign(coefs) * (np.abs(coefs) >> low)
    n, w = coefs.shape
    row, col = np.nonzero(coefs)
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    run = np.where(new, col, np.diff(col, prepend=0) - 1)
    long = run // 16
    size, more = _bits_of(coefs[row, col])
    symbol = (run % 16) << 4 | size
    end = np.ones(n, bool)  # whether zeros end the block
    end[row[col == w - 1]] = False
    ends = np.flatnonzero(end)
    count = np.bincount(row, 1 + long, minlength=n).astype(np.int64)
    place = np.arange(len(row)) + np.cumsum(long) + (np.cumsum(end) - end)[row]
    total = len(row) + int(long.sum()) + len(ends)
    code = np.full(total, AC[2][0xF0])  # what stays is a run of 16 zeros
    width = np.full(total, AC[3][0xF0])
    code[place], width[place] = AC[2][symbol] << size | more, AC[3][symbol] + size
    at = np.cumsum(count + end)[ends] - 1
    code[at], width[at] = AC[2][0], AC[3][0]
    return code, width, np.repeat(np.arange(n), count + end)


def _refining_tokens(coefs: np.ndarray, nth: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the last bit: events (a new coefficient after a run, 16 zeros, the end), each before the bits of known coefficients passed."""
    n, w = coefs.shape
    a = np.abs(coefs)
    known, new, zero = a > 1, a == 1, a == 0
    zeros = np.cumsum(zero, axis=1)
    # Zeros since the last new coefficient, at each place.
    since = zeros - np.maximum.accumulate(np.where(new, zeros, 0), axis=1)
    later = np.zeros((n, w), bool)  # whether a new coefficient comes later in the block
    later[:, :-1] = np.maximum.accumulate(new[:, ::-1], axis=1)[:, ::-1][:, 1:]
    sixteen = zero & (since > 0) & (since % 16 == 0) & later
    event = np.zeros((n, w + 1), bool)
    event[:, :w] = new | sixteen
    event[:, w] = ~event[:, w - 1]  # what follows the last event needs an end
    bit = np.zeros((n, w + 1), bool)
    bit[:, :w] = known
    ev, bt = np.flatnonzero(event.reshape(-1)), np.flatnonzero(bit.reshape(-1))
    events, bits = np.cumsum(event.reshape(-1)), np.cumsum(bit.reshape(-1))
    before = bits - bit.reshape(-1)
    row, col = ev // (w + 1), ev % (w + 1)
    inner = np.zeros((n, w + 1), np.int64)  # zeros before a place since the last new coefficient
    inner[:, 1:w] = since[:, : w - 1]
    fresh = np.zeros((n, w + 1), bool)
    fresh[:, :w] = new
    is_new = fresh.reshape(-1)[ev].astype(np.int64)
    symbol = np.where(is_new > 0, (inner[row, col] % 16) << 4 | 1, np.where(col < w, 0xF0, 0))
    sign = is_new * (coefs[row, np.minimum(col, w - 1)] > 0)
    total = len(ev) + len(bt)
    code, width, owner = np.zeros(total, np.int64), np.ones(total, np.int64), np.zeros(total, np.int64)
    at = np.arange(len(ev)) + np.concatenate([[0], before[ev[:-1]]]) if len(ev) else ev
    code[at], width[at] = REFINE[2][symbol] << is_new | sign, REFINE[3][symbol] + is_new
    owner[at] = row
    place = events[bt] + 1 + before[bt]  # after its event, which is the next one
    code[place] = a.reshape(-1)[bt // (w + 1) * w + bt % (w + 1)] & 1
    owner[place] = bt // (w + 1)
    return code, width, owner


@dataclass
class Image:
    """What the markers of one stream say, and where its scans lie."""

    height: int = 0
    width: int = 0
    comment: bytes = b""
    comps: list[list[int]] = field(default_factory=list)  # id, horizontal, vertical sampling, quantisation table
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[dict] = field(default_factory=list)
    cells: dict[tuple, np.ndarray] = field(default_factory=dict)

    def grid(self, c: int) -> tuple[int, int, int, int]:
        """Block rows and columns of a component: stored (whole units), and those of its own scans."""
        hm, vm = max(x[1] for x in self.comps), max(x[2] for x in self.comps)
        _, h, v, _ = self.comps[c]
        rows, cols = -(-self.height // (8 * vm)) * v, -(-self.width // (8 * hm)) * h
        return rows, cols, -(-(-(-self.height * v // vm)) // 8), -(-(-(-self.width * h // hm)) // 8)


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits: length of the code that they begin with and its symbol, as length * 256 + symbol."""
    out, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            span = 1 << (16 - length)
            out[code * span : (code + 1) * span] = length << 8 | symbols[k]
            code += 1
            k += 1
        code <<= 1
    return out


def parse(raw: bytes) -> Image:
    """Markers of a progressive stream; ValueError for other kinds of file."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG stream")
    image, at, tables, restart = Image(), 2, {}, 0
    whole = np.frombuffer(raw, np.uint8)
    ff = np.flatnonzero(whole[:-1] == 0xFF)
    ff = ff[(whole[ff + 1] != 0) & (whole[ff + 1] != 0xFF)]
    others = np.flatnonzero((whole[ff + 1] < 0xD0) | (whole[ff + 1] > 0xD7))
    places, others = ff[others].tolist(), others.tolist()
    while at < len(raw):
        if raw[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = raw[at + 1]
        at += 2
        if marker == 0xD9:
            break
        if marker == 0xFF or 0xD0 <= marker <= 0xD7:
            at -= marker == 0xFF
            continue
        n = int.from_bytes(raw[at : at + 2], "big")
        body = raw[at + 2 : at + n]
        at += n
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                size = 128 if wide else 64
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else "u1").astype(np.int64)
                body = body[1 + size :]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0]] = (bytes(body[1:17]), bytes(body[17 : 17 + total]))
                body = body[17 + total :]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xC2:
            image.height, image.width = struct.unpack(">HH", body[1:5])
            image.comps = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]] for i in range(body[5])]
            if body[0] != 8 or len(image.comps) not in (1, 3):
                raise ValueError("only 8-bit samples of one or three components are read")
        elif marker == 0xDA:
            k = body[0]
            ids = [x[0] for x in image.comps]
            comps = tuple(ids.index(body[1 + 2 * i]) for i in range(k))
            lo, hi, bits = body[1 + 2 * k : 4 + 2 * k]
            used = tuple(tables.get(body[2 + 2 * i] >> 4 if lo == 0 else 0x10 | body[2 + 2 * i] & 15) for i in range(k))
            k = bisect_left(places, at)
            stop, j = (places[k], others[k]) if k < len(places) else (len(raw), len(ff))
            i = others[k - 1] + 1 if k else 0
            image.scans.append({"key": (comps, lo, hi, bits >> 4, bits & 15, used, restart), "data": whole[at:stop], "cuts": ff[i:j] - at})
            at = stop
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a progressive Huffman-coded stream")
    return image


class _Bits:
    """All lanes' bits: each lane has its own place in one buffer."""

    def __init__(self, data: np.ndarray):
        b = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
        self.words = b[:-3] << 16 | b[1:-2] << 8 | b[2:-1]
        self.last = len(self.words) - 1

    def peek(self, pos: np.ndarray) -> np.ndarray:
        """The next 16 bits at each place."""
        w = self.words[np.minimum(pos >> 3, self.last)]
        return (w >> (8 - (pos & 7)).astype(np.uint32) & 0xFFFF).astype(np.int32)

    def take(self, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.peek(pos) >> (16 - n)


def _extend(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where((v < (1 << np.maximum(s - 1, 0))) & (s > 0), v - (1 << s) + 1, v)


def _dc(bits: _Bits, pos: np.ndarray, pred: np.ndarray, coef: np.ndarray, block: np.ndarray, lut: np.ndarray | None, high: int, low: int) -> None:
    if high:
        coef[0, block] |= (bits.peek(pos) >> 15 << low).astype(coef.dtype)
        pos += 1
        return
    e = lut[bits.peek(pos)]
    pos += e >> 8
    s = e & 255
    pred += _extend(bits.take(pos, s), s)
    pos += s
    coef[0, block] = pred << low


def _ac_first(bits: _Bits, pos: np.ndarray, run: np.ndarray, coef: np.ndarray, block: np.ndarray, lut: np.ndarray, lo: int, hi: int, low: int) -> None:
    """One block of each lane; ``run`` counts blocks that an end-of-band still covers."""
    lane = np.flatnonzero(run == 0)
    run[run > 0] -= 1
    p, b, k = pos[lane], block[lane], np.full(len(lane), lo, np.int32)
    while len(lane):
        e = lut[bits.peek(p)]
        p += e >> 8
        r, s = e >> 4 & 15, e & 15
        zero = s == 0
        if zero.any():
            end = zero & (r < 15)
            i = np.flatnonzero(end)
            run[lane[i]] = (1 << r[i]) - 1 + bits.take(p[i], r[i])
            p[i] += r[i]
            k += r + zero  # of 15 zeros and one more, or before a coefficient
            k[i] = 64
            j = np.flatnonzero(~zero)
            v = _extend(bits.take(p[j], s[j]), s[j])
            coef[k[j], b[j]] = v << low
            p += s
            k[j] += 1
        else:
            k += r
            v = _extend(bits.take(p, s), s)
            coef[k, b] = v << low
            p += s
            k += 1
        done = k > hi
        if done.any():
            pos[lane[done]] = p[done]
            keep = ~done
            lane, p, b, k = lane[keep], p[keep], b[keep], k[keep]


def _ac_refine(bits: _Bits, pos: np.ndarray, run: np.ndarray, coef: np.ndarray, block: np.ndarray, lut: np.ndarray, lo: int, hi: int, low: int) -> None:
    one = 1 << low
    ended = run > 0
    want = ~ended
    skip, value = np.zeros(len(pos), np.int32), np.zeros(len(pos), np.int32)
    for k in range(lo, hi + 1):
        if want.any():
            i = np.flatnonzero(want)
            e = lut[bits.peek(pos[i])]
            pos[i] += e >> 8
            r, s = e >> 4 & 15, e & 15
            stop = (s == 0) & (r < 15)
            j = i[stop]
            run[j] = (1 << r[stop]) + bits.take(pos[j], r[stop])
            pos[j] += r[stop]
            ended[j] = True
            new = i[s > 0]
            sign = bits.peek(pos[new]) >> 15
            pos[new] += 1
            skip[i], value[i] = r, 0
            value[new] = np.where(sign == 1, one, -one)
            want[i] = False
        c = coef[k, block]
        old = c != 0
        if old.all():
            bit = bits.peek(pos) >> 15
            pos += 1
            coef[k, block] = c + np.where((bit == 1) & (np.abs(c) & one == 0), np.sign(c) * one, 0).astype(c.dtype)
            continue
        i = np.flatnonzero(old)
        bit = bits.peek(pos[i]) >> 15
        pos[i] += 1
        ci = c[i]
        coef[k, block[i]] = ci + np.where((bit == 1) & (np.abs(ci) & one == 0), np.sign(ci) * one, 0).astype(c.dtype)
        gap = ~old & ~ended
        here = gap & (skip == 0)
        coef[k, block[here]] = value[here]
        want |= here
        skip[gap & ~here] -= 1
    run[ended] -= 1


def decode(images: list[Image]) -> list[list[np.ndarray]]:
    """Coefficients (blocks, 64 in zigzag order) of each component of each image.

    Scans accumulate into the arrays in stream order. Images whose scans have the same headers go side
    by side; every restart interval is a lane.
    """
    sizes = [[g[0] * g[1] for g in (im.grid(c) for c in range(len(im.comps)))] for im in images]
    flat = [n for s in sizes for n in s]
    starts = np.concatenate([[0], np.cumsum(flat)])
    coef = np.zeros((64, int(starts[-1])), np.int16)  # a coefficient of all blocks lies together
    at_ = iter(starts.tolist())
    base = [[next(at_) for _ in s] for s in sizes]
    at = [0] * len(images)
    while True:
        groups: dict[tuple, list[int]] = {}
        for i, im in enumerate(images):
            if at[i] < len(im.scans):
                groups.setdefault(im.scans[at[i]]["key"], []).append(i)
        if not groups:
            break
        key = next(iter(groups))
        _scan_in(images, groups[key], [at[i] for i in groups[key]], base, coef)
        for i in groups[key]:
            at[i] += 1
    return [[coef[:, b : b + n].T for b, n in zip(base[i], sizes[i], strict=True)] for i in range(len(images))]


def _cells(im: Image, comps: tuple[int, ...], base: list[int]) -> np.ndarray:
    """Blocks of each unit of a scan, in its order: a row for each unit."""
    if len(comps) == 1:
        _, cols, own_rows, own_cols = im.grid(comps[0])
        r, c = np.divmod(np.arange(own_rows * own_cols), own_cols)
        return (base[comps[0]] + r * cols + c)[:, None]
    hm, vm = max(x[1] for x in im.comps), max(x[2] for x in im.comps)
    across = -(-im.width // (8 * hm))
    my, mx = np.divmod(np.arange(-(-im.height // (8 * vm)) * across), across)
    cells = []
    for c in comps:
        _, h, v, _ = im.comps[c]
        cols = im.grid(c)[1]
        cells += [base[c] + (my * v + y) * cols + mx * h + x for y in range(v) for x in range(h)]
    return np.stack(cells, 1)


def _scan_in(images: list[Image], chosen: list[int], at: list[int], base: list[list[int]], coef: np.ndarray) -> None:
    comps, lo, hi, high, low, used, restart = images[chosen[0]].scans[at[0]]["key"]
    datas, cuts, sizes, lane_block, lane_units, starts, offset = [], [], [], [], [], [], 0
    for i, a in zip(chosen, at, strict=True):
        im, scan = images[i], images[i].scans[a]
        if comps not in im.cells:
            im.cells[comps] = _cells(im, comps, base[i])
        units = im.cells[comps]
        lanes = -(-len(units) // (restart or len(units)))
        if len(scan["cuts"]) + 1 < lanes:
            raise ValueError("restart markers are missing")
        datas.append(scan["data"])
        starts.append(offset)
        cuts.append(scan["cuts"][: lanes - 1] + offset)
        sizes.append(lanes)
        offset += len(scan["data"])
        lane_block.append(units)
        each = restart or len(units)
        lane_units.append(np.full(lanes, each) if each == 1 else np.minimum(each, len(units) - each * np.arange(lanes)))
    # Stuffed zeros and markers go; what is before a place tells how far it moves.
    data = np.concatenate(datas)
    ff = np.flatnonzero(data[:-1] == 0xFF)
    marks = ff[data[ff + 1] != 0]
    keep = np.ones(len(data), bool)
    keep[ff[data[ff + 1] == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    moved = np.cumsum(keep)
    heads = np.cumsum([0, *sizes[:-1]])
    begin = np.empty(sum(sizes), np.int64)
    rest = np.ones(len(begin), bool)
    rest[heads] = False
    begin[heads], begin[rest] = starts, np.concatenate(cuts) + 2
    bits, pos = _Bits(data[keep]), (moved[begin] - keep[begin]) * 8
    units, count = np.concatenate(lane_block), np.concatenate(lane_units)
    start = np.cumsum(count) - count
    luts = [_lookup(*t) if t else None for t in used]
    pred, run = [np.zeros(len(pos), np.int32) for _ in comps], np.zeros(len(pos), np.int32)
    which = [0] if len(comps) == 1 else [j for j, c in enumerate(comps) for _ in range(images[chosen[0]].comps[c][1] * images[chosen[0]].comps[c][2])]
    for t in range(int(count.max())):
        live = slice(None) if t == 0 else np.flatnonzero(count > t)
        p, rows = pos[live], units[start[live] + t]
        if lo == 0:
            for col, j in enumerate(which):
                own = pred[j][live]
                _dc(bits, p, own, coef, rows[:, col], luts[j], high, low)
                pred[j][live] = own
        else:
            own = run[live]
            (_ac_refine if high else _ac_first)(bits, p, own, coef, rows[:, 0], luts[0], lo, hi, low)
            run[live] = own
        pos[live] = p


def samples(images: list[Image], coefs: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """Inverse transform: pixels (blocks, 64) of each component of each image, all blocks at once.

    All sums are of integers, so equal streams give equal samples in any batch.
    """
    out: list[list[np.ndarray]] = [[] for _ in images]
    scale = [im.quant.get(c[3], np.ones(64, np.int64)) for im in images for c in im.comps]
    flat = [x for own in coefs for x in own]
    if not flat:
        return out
    if all((s == scale[0]).all() for s in scale):
        blocks = np.concatenate(flat) if len(flat) > 1 else flat[0]
        pix = np.concatenate([_inverse(blocks[k : k + 8192], scale[0]) for k in range(0, len(blocks), 8192)])
    else:
        pix = np.concatenate([_inverse(x, s) for x, s in zip(flat, scale, strict=True)])
    at = 0
    for i, own in enumerate(coefs):
        for x in own:
            out[i].append(pix[at : at + len(x)])
            at += len(x)
    return out


def _inverse(blocks: np.ndarray, scale: np.ndarray) -> np.ndarray:
    pix = (blocks.astype(np.float64) * scale) @ BASIS
    return np.clip((pix.astype(np.int32) + (1 << (SCALE - 1)) >> SCALE) + 128, 0, 255).astype(np.uint8)


def rgb(image: Image, pixels: list[np.ndarray]) -> np.ndarray:
    """Height x width x 3 samples: chroma repeated to full resolution, colours converted in integers."""
    planes = []
    hm, vm = max(x[1] for x in image.comps), max(x[2] for x in image.comps)
    for c, (_, h, v, _) in enumerate(image.comps):
        rows, cols, _, _ = image.grid(c)
        plane = pixels[c].reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
        if (h, v) != (hm, vm):
            plane = plane.repeat(vm // v, 0).repeat(hm // h, 1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2)
    y, cb, cr = planes[0].astype(np.int32) << 16, planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    half = 1 << 15
    out = np.empty((*planes[0].shape, 3), np.uint8)
    out[:, :, 0] = np.clip(y + 91881 * cr + half >> 16, 0, 255)
    out[:, :, 1] = np.clip(y - 22554 * cb - 46802 * cr + half >> 16, 0, 255)
    out[:, :, 2] = np.clip(y + 116130 * cb + half >> 16, 0, 255)
    return out

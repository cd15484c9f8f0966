"""Progressive JPEG in numpy: scans accumulate into coefficient arrays, which an exact integer transform turns into RGB.

Supported: 8-bit progressive frames (SOF2) of one or three components, sampling factors 1 and 2, restart intervals,
spectral selection and successive approximation in any legal order. Coefficients are arrays (blocks, 64) of int32 in
zigzag order, blocks in raster order of the component's padded grid.

Long stretches of one Huffman symbol, and runs of blocks with correction bits alone, are read and written at once; DC
differences are looked up with their code; anything else takes the symbol-by-symbol path.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np


class JpegError(ValueError):
    """A stream that isn't a progressive JPEG of the supported kinds, or ends too soon."""


def zigzag() -> np.ndarray:
    """Raster index of each zigzag position: diagonals of the 8 x 8 block, walked in turn up and down."""
    cells = [(r, d - r) for d in range(15) for r in (range(d, -1, -1) if d % 2 == 0 else range(d + 1)) if r < 8 and d - r < 8]
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag()


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks in a row of the padded grid
    high: int = 0
    own_wide: int = 0  # blocks that scans of this component alone cover
    own_high: int = 0
    coefs: np.ndarray = field(default_factory=lambda: np.empty((0, 64), np.int32))


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray]
    comment: bytes = b""


def sized(width: int, height: int, components: list[Component]) -> tuple[int, int]:
    """Fills in the components' grids; returns units across and down."""
    hmax, vmax = max(c.h for c in components), max(c.v for c in components)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    for c in components:
        c.wide, c.high = across * c.h, down * c.v
        c.own_wide, c.own_high = -(-(-(-width * c.h // hmax)) // 8), -(-(-(-height * c.v // vmax)) // 8)
    return across, down


def unit_order(c: Component, across: int, down: int) -> np.ndarray:
    """Blocks of a component in the order of interleaved units, (units, h * v)."""
    return (_small_order if across * down <= 1024 else _order)(c.wide, c.h, c.v, across, down)


def _order(wide: int, h: int, v: int, across: int, down: int) -> np.ndarray:
    base = (np.arange(down)[:, None] * (v * wide) + np.arange(across) * h).reshape(-1, 1)
    return base + (np.arange(v)[:, None] * wide + np.arange(h)).reshape(1, -1)


_small_order = lru_cache(1024)(_order)


def own_order(c: Component) -> np.ndarray:
    return (_small_order if c.own_wide * c.own_high <= 1024 else _order)(c.wide, 1, 1, c.own_wide, c.own_high)[:, 0]


# Huffman tables


@lru_cache(32)
def lookup(spec: bytes) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """From 16 counts and symbols: length and symbol by 16-bit prefix; code and length by symbol."""
    length, symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    codes: dict[int, tuple[int, int]] = {}
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(spec[n - 1]):
            if at >= len(spec) or code >> n:
                raise JpegError("bad Huffman table")
            lo = code << (16 - n)
            length[lo : lo + (1 << (16 - n))], symbol[lo : lo + (1 << (16 - n))] = n, spec[at]
            codes[spec[at]] = (code, n)
            code, at = code + 1, at + 1
        code <<= 1
    return length.tolist(), symbol.tolist(), codes


@lru_cache(8)
def differences(spec: bytes) -> tuple[list[int], list[int]]:
    """From 16 counts and symbols of a DC table: bits of code and difference together, and the difference, by 16-bit
    prefix; no bits where both together are longer."""
    length, symbol, _ = lookup(spec)
    code, size = np.array(length), np.array(symbol)
    total = np.where((code > 0) & (code + size <= 16), code + size, 0)
    size = np.where(total > 0, size, 0)
    extra = np.arange(1 << 16) >> (16 - total) & ((1 << size) - 1)
    value = np.where((size > 0) & (extra >> np.maximum(size - 1, 0) == 0), extra - (1 << size) + 1, extra)
    return total.tolist(), value.tolist()


@lru_cache(64)
def table_for(counts: tuple[tuple[int, int], ...]) -> bytes:
    """A Huffman table for symbol counts, at most 16 bits deep and without the code of all ones."""
    import heapq

    bits = np.zeros(258, np.int64)
    heap = [(n, s, (s,)) for s, n in counts] + [(0, 256, (256,))]  # the reserved code
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, i, x), (b, j, y) = heapq.heappop(heap), heapq.heappop(heap)
        bits[list(x + y)] += 1
        heapq.heappush(heap, (a + b, max(i, j), x + y))
    depth = np.bincount(bits[bits > 0], minlength=300)
    for n in range(len(depth) - 1, 16, -1):  # too deep: pair up and hang under a shorter code
        while depth[n]:
            j = n - 2
            while not depth[j]:
                j -= 1
            depth[n] -= 2
            depth[n - 1] += 1
            depth[j + 1] += 2
            depth[j] -= 1
    depth[max(n for n in range(1, 17) if depth[n])] -= 1
    symbols = sorted((s for s, _ in counts), key=lambda s: (bits[s], s))
    return bytes(depth[1:17].astype(np.uint8).tolist()) + bytes(symbols)


# reading


class Bits:
    """One restart segment: peeks and skips for the symbol path, unpacked bits for the fast ones."""

    def __init__(self, data: bytes):
        self.data, self.size, self.at = data + b"\0" * 8, 8 * len(data), 0
        self._bits: np.ndarray | None = None

    @property
    def bits(self) -> np.ndarray:
        if self._bits is None:
            self._bits = np.unpackbits(np.frombuffer(self.data, np.uint8))
        return self._bits

    def symbol(self, table) -> int:
        p = self.at
        prefix = int.from_bytes(self.data[p >> 3 : (p >> 3) + 3], "big") >> (8 - (p & 7)) & 0xFFFF
        n = table[0][prefix]
        if not n or p + n > self.size:
            raise JpegError("bad code or end of data")
        self.at = p + n
        return table[1][prefix]

    def take(self, n: int) -> int:
        p = self.at
        if p + n > self.size:
            raise JpegError("end of data")
        self.at = p + n
        return int.from_bytes(self.data[p >> 3 : (p >> 3) + 4], "big") >> (32 - (p & 7) - n) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x if x >> (n - 1) else x - (1 << n) + 1

    def many(self, n: int) -> np.ndarray:
        if self.at + n > self.size:
            raise JpegError("end of data")
        self.at += n
        return self.bits[self.at - n : self.at]


def _dc_first(seg: Bits, parts: list, units: slice, al: int) -> None:
    tables = [t for c, t, order in parts for _ in range(order.shape[1])]
    n = units.stop - units.start
    data, at, end, found = seg.data, seg.at, seg.size, []
    for t in tables * n:
        total, value = t[3]
        prefix = int.from_bytes(data[at >> 3 : (at >> 3) + 3], "big") >> (8 - (at & 7)) & 0xFFFF
        size = total[prefix]
        if size and at + size <= end:
            at += size
            found.append(value[prefix])
            continue
        seg.at = at
        s = seg.symbol(t)
        found.append(seg.signed(s) if s else 0)
        at = seg.at
    seg.at = at
    values = np.array(found, np.int64).reshape(n, len(tables))
    k = 0
    for c, _, order in parts:
        w = order.shape[1]
        c.coefs[order[units].ravel(), 0] = np.cumsum(values[:, k : k + w].ravel()) << al
        k += w


def _dc_more(seg: Bits, parts: list, units: slice, al: int) -> None:
    widths = [order.shape[1] for _, _, order in parts]
    bits = seg.many((units.stop - units.start) * sum(widths)).reshape(-1, sum(widths)).astype(np.int32)
    k = 0
    for (c, _, order), w in zip(parts, widths, strict=True):
        c.coefs[order[units].ravel(), 0] |= bits[:, k : k + w].ravel() << al
        k += w


@lru_cache(32)
def _weights(n: int) -> np.ndarray:
    return 2.0 ** np.arange(n - 1, -1, -1)


def _uniform(seg: Bits, table, symbol: int, most: int) -> np.ndarray:
    """Values of the longest stretch of (no zeros, size) symbols like this one, read at once. seg is at the code."""
    code, n = table[2][symbol]
    size, found, tries = symbol & 15, [], 4096
    stride = n + size
    data = np.frombuffer(seg.data, np.uint8)
    while most > 0:
        m = min(tries, most, (seg.size - seg.at) // stride)
        if m <= 0:
            break
        skip = seg.at & 7
        bits = np.unpackbits(data[seg.at >> 3 : (seg.at + m * stride + 7) >> 3])[skip : skip + m * stride]
        # a code and its bits are 31 at most, which doubles hold
        raw = (bits.reshape(m, stride).astype(np.float64) @ _weights(stride)).astype(np.int64)
        same = (raw >> size & ((1 << n) - 1)) == code
        good = m if same.all() else int(same.argmin())
        if good:
            raw = (raw[:good] & ((1 << size) - 1)).astype(np.int32)
            raw -= (raw >> (size - 1) ^ 1) * ((1 << size) - 1)
            found.append(raw)
        seg.at += good * stride
        most -= good
        if good < m:
            break
        tries = min(8 * tries, 1 << 17)
    return np.concatenate(found) if len(found) > 1 else found[0] if found else np.empty(0, np.int32)


def _ac_first(seg: Bits, c: Component, order: np.ndarray, ss: int, se: int, al: int, table) -> None:
    band = se - ss + 1
    out = np.zeros((len(order), band), np.int32)
    flat, b, k, last = out.reshape(-1), 0, 0, -1
    while b < len(order):
        start = seg.at
        s = seg.symbol(table)
        run, size = s >> 4, s & 15
        if size:
            if run == 0 and s == last:
                seg.at = start
                at = b * band + k
                values = _uniform(seg, table, s, len(flat) - at)
                flat[at : at + len(values)] = values << al
                b, k = divmod(at + len(values), band)
                last = -1
                continue
            k += run
            if k >= band:
                raise JpegError("coefficient beyond the band")
            out[b, k] = seg.signed(size) * (1 << al)
            k += 1
            last = s
        elif run == 15:
            k += 16
        else:
            b += (1 << run) + (seg.take(run) if run else 0)
            k = 0
            continue
        if k >= band:
            b, k = b + 1, 0
    c.coefs[order, ss : se + 1] = out


def _correct(values: np.ndarray, mask: np.ndarray, bits: np.ndarray, step: int) -> None:
    """Adds a step away from zero where a bit is set and it isn't there yet."""
    old = values[mask]
    fresh = (bits != 0) & ((np.abs(old) & step) == 0)
    values[mask] = old + np.where(fresh, np.where(old < 0, -step, step), 0)


def _ac_more(seg: Bits, c: Component, order: np.ndarray, ss: int, se: int, al: int, table) -> None:
    values, step = c.coefs[order, ss : se + 1], 1 << al
    band, b = se - ss + 1, 0
    while b < len(order):
        k, row = 0, values[b]
        while k < band:
            s = seg.symbol(table)
            run, size = s >> 4, s & 15
            if not size and run < 15:
                blocks = (1 << run) + (seg.take(run) if run else 0)
                mask = row != 0
                mask[:k] = False
                _correct(row, mask, seg.many(int(mask.sum())), step)
                rest = values[b + 1 : b + blocks]
                mask = rest != 0
                _correct(rest, mask, seg.many(int(mask.sum())), step)
                b += blocks - 1
                break
            new = (step if seg.take(1) else -step) if size else 0
            while k < band:  # passes `run` zeros, correcting what isn't zero on the way
                if row[k]:
                    if seg.take(1) and not abs(int(row[k])) & step:
                        row[k] += -step if row[k] < 0 else step
                elif run:
                    run -= 1
                else:
                    row[k] = new
                    k += 1
                    break
                k += 1
        b += 1
    c.coefs[order, ss : se + 1] = values


SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)
RESTART = re.compile(rb"\xff[\xd0-\xd7]")
OTHER_FRAMES = {0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)}


def decode(data: bytes) -> Image:
    """All scans of a progressive JPEG, accumulated."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no JPEG")
    at, quants, huffman, dc, image, restart = 2, {}, {}, {}, None, 0
    across = down = 0
    comment = b""
    while True:
        if at + 4 > len(data) and data[at : at + 2] != b"\xff\xd9":
            raise JpegError("no end marker")
        marker = data[at + 1]
        if data[at] != 0xFF:
            raise JpegError("no marker")
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                quants[body[0] & 15], body = values.astype(np.int32), body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                if body[0] >> 4:
                    huffman[body[0]] = lookup(body[1:n])
                else:
                    dc[body[0]] = (*lookup(body[1:n]), differences(body[1:n]))
                body = body[n:]
        elif marker == 0xC2:
            if body[0] != 8 or body[5] not in (1, 3):
                raise JpegError("8-bit frames of one or three components only")
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            image = Image(int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), parts, quants)
            across, down = sized(image.width, image.height, parts)
            for c in parts:
                c.coefs = np.zeros((c.wide * c.high, 64), np.int32)
        elif marker in OTHER_FRAMES:
            raise JpegError("not a progressive Huffman frame")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            end = SCAN_END.search(data, at)
            if image is None or end is None:
                raise JpegError("scan without frame or end")
            n = body[0]
            chosen = [next(c for c in image.components if c.ident == body[1 + 2 * i]) for i in range(n)]
            ids = [body[2 + 2 * i] for i in range(n)]
            ss, se, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            raw = data[at : end.start()]
            at = end.start()
            segments = [Bits(x.replace(b"\xff\x00", b"\xff")) for x in (RESTART.split(raw) if restart else [raw])]
            one = [own_order(chosen[0])[:, None]] if n == 1 else [unit_order(c, across, down) for c in chosen]
            units = len(one[0])
            step = restart or units
            for i, seg in enumerate(segments):
                piece = slice(i * step, min(units, (i + 1) * step))
                if piece.start >= units:
                    break
                if ss == 0:
                    parts = [(c, dc.get(t >> 4), o) for c, t, o in zip(chosen, ids, one, strict=True)]
                    (_dc_more if ah else _dc_first)(seg, parts, piece, al)
                else:
                    (_ac_more if ah else _ac_first)(seg, chosen[0], one[0][piece, 0], ss, se, al, huffman[0x10 | ids[0] & 15])
        if size < 2:
            raise JpegError("bad segment")
    if image is None:
        raise JpegError("no frame")
    image.comment = comment
    return image


# transform

COSINE_BITS = 12


@lru_cache(1)
def _basis() -> np.ndarray:
    """(zigzag position, pixel) of the inverse transform in whole numbers, so that sums are exact in any order."""
    x = np.arange(8)
    c = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x[:, None] == 0, np.sqrt(1 / 8), 1 / 2)
    both = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)
    return np.rint(both[ZIGZAG] * (1 << COSINE_BITS))


def plane(c: Component, quant: np.ndarray) -> np.ndarray:
    """Samples of a component over its padded grid."""
    sums = np.multiply(c.coefs, quant, dtype=np.float64) @ _basis()
    sums *= 1 / (1 << COSINE_BITS)  # a power of two: still exact
    sums += 128.5
    np.floor(sums, sums)
    np.maximum(sums, 0, sums)
    np.minimum(sums, 255, sums)
    samples = sums.astype(np.uint8)
    return samples.reshape(c.high, c.wide, 8, 8).swapaxes(1, 2).reshape(8 * c.high, 8 * c.wide)


def rgb(image: Image) -> np.ndarray:
    """(height, width, 3) samples; planes of lower resolution are repeated up to the full one."""
    hmax, vmax = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = [plane(c, image.quants[c.quant]) for c in image.components]

    def full(p: np.ndarray, c: Component) -> np.ndarray:
        if vmax != c.v:
            p = np.repeat(p, vmax // c.v, 0)
        if hmax != c.h:
            p = np.repeat(p, hmax // c.h, 1)
        return p[: image.height, : image.width]

    if len(planes) == 1:
        return np.repeat(full(planes[0], image.components[0])[:, :, None], 3, 2)
    y = full(planes[0], image.components[0]).astype(np.int32)
    # what chroma adds is worked out before it is repeated, where both planes are alike
    b, r = image.components[1:]
    cb, cr = planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    if (b.h, b.v) != (r.h, r.v):
        cb, cr, b = full(cb, b), full(cr, r), None
    out = np.empty((*y.shape, 3), np.uint8)
    for k, part in enumerate((91881 * cr, -22554 * cb - 46802 * cr, 116130 * cb)):
        part = (part + 32768) >> 16
        shade = y + (part if b is None else full(part, b))
        np.maximum(shade, 0, shade)
        np.minimum(shade, 255, shade)
        out[:, :, k] = shade
    return out


# writing


class _Writer:
    """Bits of a scan, gathered as (value, length) pairs; the table comes from the symbols that occur."""

    def __init__(self):
        self.items: list[tuple[int, int, int]] = []  # symbol or -1, extra bits, how many

    def bytes(self) -> tuple[bytes, bytes]:
        counts: dict[int, int] = {}
        for s, _, _ in self.items:
            if s >= 0:
                counts[s] = counts.get(s, 0) + 1
        spec = table_for(tuple(sorted(counts.items()))) if counts else b""
        codes = lookup(spec)[2] if counts else {}
        out = []
        for s, extra, n in self.items:
            if s >= 0:
                code, size = codes[s]
                out.append(format(code, f"0{size}b"))
            if n:
                out.append(format(extra, f"0{n}b"))
        text = "".join(out)
        text += "1" * (-len(text) % 8)
        return spec, int(text, 2).to_bytes(len(text) // 8, "big") if text else b""


def _magnitude(x: int) -> tuple[int, int]:
    n = abs(x).bit_length()
    return (x if x > 0 else x + (1 << n) - 1), n


#: One table for all DC scans: sizes 0 to 11 with codes of three and four bits.
DC_TABLE = table_for(tuple((s, 2 if 4 <= s <= 7 else 1) for s in range(12)))


@lru_cache(1)
def _DC_WORDS() -> list[str]:
    """Bits of each difference, at its own index (negative ones from the end)."""
    codes = lookup(DC_TABLE)[2]
    word = lambda x: "{:0{}b}".format(*codes[_magnitude(x)[1]]) + ("{:0{}b}".format(*_magnitude(x)) if x else "")
    return [word(x) for x in (*range(2048), *range(-2047, 0))]


@lru_cache(4)
def _words(size: int, n: int) -> np.ndarray:
    """Bits of the only code (n zeros) and of each value of a size, at its own index (negative ones from the end)."""
    most = (1 << size) - 1
    raw = np.array([*range(most + 1), *range(most)], ">u2")  # x, and x + most for x from -most on
    bits = np.zeros((len(raw), n + size), np.uint8)
    bits[:, n:] = np.unpackbits(raw.view(np.uint8).reshape(-1, 2), axis=1)[:, 16 - size :]
    return bits


def _packed(bits: np.ndarray) -> bytes:
    """Whole bytes of bits, filled up with ones."""
    raw = np.packbits(bits)
    if len(bits) % 8:
        raw[-1] |= 255 >> len(bits) % 8
    return raw.tobytes()


def _stuffed(raw: bytes) -> bytes:
    return raw.replace(b"\xff", b"\xff\x00")


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _write_dc_first(parts: list[tuple[np.ndarray, np.ndarray]], al: int) -> tuple[bytes, bytes]:
    diffs = []
    for coefs, order in parts:
        values = coefs[order.ravel(), 0] >> al
        diff = values.copy()
        diff[1:] -= values[:-1]
        diffs.append(diff.reshape(order.shape))
    words = _DC_WORDS()
    text = "".join([words[x] for x in np.concatenate(diffs, axis=1).ravel().tolist()])
    text += "1" * (-len(text) % 8)
    return DC_TABLE, int(text, 2).to_bytes(len(text) // 8, "big")


def _end_of_blocks(writer: _Writer, blocks: int, corrections: list[np.ndarray]) -> None:
    """EOB runs; corrections has the bits of each of the blocks."""
    at = 0
    while blocks:
        part = min(blocks, 0x7FFF)
        r = part.bit_length() - 1
        writer.items.append((r << 4, part - (1 << r), r))
        bits = np.concatenate(corrections[at : at + part]) if corrections else []
        if len(bits):
            writer.items.append((-1, int("".join(map(str, bits.tolist())), 2), len(bits)))
        at, blocks = at + part, blocks - part


def _write_ac_first(values: np.ndarray, al: int) -> tuple[bytes, bytes]:
    """values: (blocks, band). Bands without zeros and of one size go out at once."""
    sizes = np.abs(values)
    if al:
        sizes >>= al
        values = np.where(values < 0, -sizes, sizes)
    size = int(sizes.flat[0]).bit_length() if values.size else 0
    if size and values.size > 1 and int(sizes.min()) >> (size - 1) and not int(sizes.max()) >> size:
        spec = table_for(((size, 1),))
        return spec, _packed(_words(size, lookup(spec)[2][size][1]).take(values.ravel(), 0).ravel())
    writer, ends = _Writer(), 0
    for row in values.tolist():
        run = 0
        if any(row):
            _end_of_blocks(writer, ends, [])
            ends = 0
        for x in row:
            if not x:
                run += 1
                continue
            while run > 15:
                writer.items.append((0xF0, 0, 0))
                run -= 16
            extra, n = _magnitude(x)
            writer.items.append((run << 4 | n, extra, n))
            run = 0
        ends += run > 0
    _end_of_blocks(writer, ends, [])
    return writer.bytes()


def _write_ac_more(values: np.ndarray, al: int) -> tuple[bytes, bytes]:
    size = np.abs(values) >> al
    bit = size & 1
    if (size > 1).all():  # nothing is new: correction bits alone, in runs of blocks
        n, out, spec, left = len(values), [], None, 0
        runs = [0x7FFF] * (n // 0x7FFF) + [n % 0x7FFF] * (n % 0x7FFF > 0)
        spec = table_for(tuple(sorted({(r.bit_length() - 1) << 4: 1 for r in runs}.items())))
        for r in runs:
            k = r.bit_length() - 1
            code, length = lookup(spec)[2][k << 4]
            head = format(code, f"0{length}b") + (format(r - (1 << k), f"0{k}b") if k else "")
            out += [np.frombuffer(head.encode(), np.uint8) - 48, bit[left : left + r].astype(np.uint8).ravel()]
            left += r
        return spec, _packed(np.concatenate(out) if out else np.empty(0, np.uint8))
    writer, ends, pending = _Writer(), 0, []
    for row, m, b in zip(values.tolist(), size.tolist(), bit.tolist(), strict=True):
        last = max((k for k, x in enumerate(m) if x == 1), default=-1)
        if last >= 0 and ends:
            _end_of_blocks(writer, ends, pending)
            ends, pending = 0, []
        run, held = 0, []
        for k in range(last + 1):
            if m[k] > 1:
                held.append(b[k])
                continue
            if m[k] == 0:
                if run == 15:
                    writer.items.append((0xF0, 0, 0))
                    writer.items += [(-1, x, 1) for x in held]
                    run, held = 0, []
                else:
                    run += 1
                continue
            writer.items.append((run << 4 | 1, int(row[k] > 0), 1))
            writer.items += [(-1, x, 1) for x in held]
            run, held = 0, []
        if last + 1 < len(row):
            ends += 1
            pending.append(np.array([b[k] for k in range(last + 1, len(row)) if m[k] > 1], np.int64))
    _end_of_blocks(writer, ends, pending)
    return writer.bytes()


def encode(width: int, height: int, components: list[Component], quants: dict[int, np.ndarray], scans: list[tuple], comment: bytes = b"") -> bytes:
    """scans: (component indexes, ss, se, ah, al). Several components only where ss is 0."""
    across, down = sized(width, height, components)
    out = [b"\xff\xd8"]
    for k in range(0, len(comment), 65533):
        out.append(_segment(0xFE, comment[k : k + 65533]))
    out += [_segment(0xDB, bytes([i]) + q.astype(np.uint8).tobytes()) for i, q in quants.items()]
    heads = b"".join(bytes([c.ident, c.h << 4 | c.v, c.quant]) for c in components)
    out.append(_segment(0xC2, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(components)]) + heads))
    for chosen, ss, se, ah, al in scans:
        parts = [components[i] for i in chosen]
        if ss == 0:
            orders = [own_order(parts[0])[:, None]] if len(parts) == 1 else [unit_order(c, across, down) for c in parts]
            if ah:
                bits = np.concatenate([(c.coefs[o, 0] >> al & 1).astype(np.uint8) for c, o in zip(parts, orders, strict=True)], axis=1).ravel()
                spec, raw = b"", _packed(bits)
            else:
                spec, raw = _write_dc_first([(c.coefs, o) for c, o in zip(parts, orders, strict=True)], al)
            kind = 0
        else:
            values = parts[0].coefs[own_order(parts[0]), ss : se + 1]
            spec, raw = (_write_ac_more if ah else _write_ac_first)(values, al)
            kind = 0x10
        if spec:
            out.append(_segment(0xC4, bytes([kind]) + spec))
        out.append(_segment(0xDA, bytes([len(parts)]) + b"".join(bytes([c.ident, 0]) for c in parts) + bytes([ss, se, ah << 4 | al])))
        out.append(_stuffed(raw))
    return b"".join([*out, b"\xff\xd9"])

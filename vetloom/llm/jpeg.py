"""Progressive JPEG for many small images at a time, in numpy.

The writer puts a payload into the coefficients of a colour image with halved
chroma: each 64 bytes are the 64 coefficients of a block in zigzag order, and
the quantisation is 1, so what is stored is the payload itself.  The scans use
spectral selection (DC, 1-5, 6-63) and successive approximation (all but the
last bit first, then that bit).  Restart markers cut each scan into *lanes* of
:data:`RESTART` blocks.

The reader takes any Huffman-coded progressive image of 8 bits with one or
three components: it accumulates all scans into coefficient arrays.  All lanes
of all images that share a script of scans are decoded side by side, a symbol
of each lane at a time.  Pixels come from an integer inverse transform, so they
do not depend on what else is in the batch.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

import numpy as np

from . import arrays as A

RESTART = 8
BLOCK = 64
#: Lanes that are coded together, and blocks that are transformed together, so that a very large image takes bounded arrays.
LANES, BLOCKS = 4096, 1 << 15
MARK = b"payload "
#: Bits of the fixed-point transform.
_FIXED = 11


def zigzag() -> np.ndarray:
    """The place in an 8 by 8 block, row by row, of each coefficient of the zigzag order."""
    return np.array(sorted(range(BLOCK), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _transform() -> np.ndarray:
    """Rows: coefficients in zigzag order; columns: pixels."""
    x = np.arange(8)
    basis = np.cos((2 * x[None, :] + 1) * x[:, None] * math.pi / 16) / 2
    basis[0] /= math.sqrt(2)
    both = np.einsum("ux,vy->uvxy", basis, basis).reshape(BLOCK, BLOCK)
    return np.rint(both[zigzag()] * (1 << _FIXED))


_TRANSFORM = _transform()


# --- Huffman tables -------------------------------------------------------


def _canonical(counts: list[int], symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol of a table (16 counts, then symbols)."""
    code_of, length_of = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    code = at = 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            code_of[s], length_of[s] = code, length
            code += 1
        at += n
        code <<= 1
    return code_of, length_of


def _writer_tables() -> tuple[bytes, bytes]:
    """DC: sizes 0 to 9 with equal codes.  AC: short codes for what ASCII letters, spaces and other bytes give."""
    dc = [0, 0, 0, 10] + [0] * 12
    first = [0x06, 0x05, 0x07, 0x00, 0x03, 0x04, 0x02]
    rest = [s for s in (*(r << 4 for r in range(16)), *(r << 4 | n for r in range(16) for n in range(1, 8))) if s not in first]
    counts = [1, 1, 1, 0, 0, 4] + [0] * 10
    counts[10] = len(rest)
    return bytes(dc) + bytes(range(10)), bytes(counts) + bytes(first + rest)


_DC_TABLE, _AC_TABLE = _writer_tables()
_DC_CODE, _AC_CODE = (_canonical(list(t[:16]), t[16:]) for t in (_DC_TABLE, _AC_TABLE))


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits: code length, and the symbol shifted by 8; a length of 0 is no code."""
    out = np.zeros(1 << 16, np.int64)
    code, at = 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length | table[at] << 8
            code, at = code + 1, at + 1
        code <<= 1
    return out


# --- writing --------------------------------------------------------------


def _packed(values: np.ndarray, n_bits: np.ndarray, block: np.ndarray, lane_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items' bits, each lane filled up with ones to a whole byte; bytes and lane lengths.  ``lane_ends`` has the block behind each lane."""
    stop = np.searchsorted(block, lane_ends)
    total = np.cumsum(n_bits)
    lane_bits = np.diff(total[stop - 1], prepend=0)
    fill = -lane_bits % 8
    values[stop - 1] = values[stop - 1] << fill.astype(np.uint64) | ((1 << fill) - 1).astype(np.uint64)
    n_bits[stop - 1] += fill
    end = np.cumsum(n_bits)
    at = end - n_bits
    word = at >> 5
    shifted = values << (64 - (at & 31) - n_bits).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    sums = np.add.reduceat(shifted, first)
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    words[word[first]] = sums >> np.uint64(32)
    words[word[first] + 1] |= sums & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").view(np.uint8)[: int(end[-1]) // 8], (lane_bits + fill) // 8


def _marked(data: np.ndarray, size: np.ndarray, number: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With a zero behind each 255 and restart markers between lanes; also each lane's end."""
    full = data == 255
    more = full.astype(np.int64)
    end = np.cumsum(size) - 1
    mark = end[~last]
    more[mark] += 2
    at = np.arange(len(data)) + np.cumsum(more) - more
    out = np.zeros(len(data) + int(more.sum()), np.uint8)
    out[at] = data
    behind = at[mark] + 1 + full[mark]
    out[behind], out[behind + 1] = 255, 0xD0 + number[~last] % 8
    return out, at[end] + 1 + more[end]


def _sizes(values: np.ndarray) -> np.ndarray:
    """Bits of each number from 0."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _dc_first(values: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    diff = np.diff(values, prepend=0)
    diff[opens] = values[opens]
    size = _sizes(np.abs(diff))
    bits = np.where(diff < 0, diff + (1 << size) - 1, diff)
    return _DC_CODE[0][size] << size.astype(np.uint64) | bits.astype(np.uint64), _DC_CODE[1][size] + size


def _ac_items() -> tuple[np.ndarray, np.ndarray]:
    """Item and bits for each run (below 16) and value (below 256)."""
    value = np.tile(np.arange(256), 16)
    size = _sizes(value)
    symbol = np.repeat(np.arange(16), 256) << 4 | size
    return _AC_CODE[0][symbol] << size.astype(np.uint64) | value.astype(np.uint64), _AC_CODE[1][symbol] + size


_ITEM, _ITEM_BITS = _ac_items()
#: Neighbouring correction bits that make one item, where all of them are there.
_GROUP = 21


def _ac(now: np.ndarray, before: np.ndarray | None, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items of an AC scan: values, lengths and blocks.  ``before`` has which coefficients earlier scans set."""
    n, width = now.shape
    flat = now.ravel()
    zeros = None
    if before is None:
        event = np.flatnonzero(flat)
        block = event // width
        ordinal = event - block * width
    else:
        event = np.flatnonzero(~before.ravel() & (flat != 0))
        block, ordinal = event // width, event
        if len(event):
            zeros = ~before.ravel()
            count = np.zeros(len(flat) + 1, np.int64)
            np.cumsum(zeros, out=count[1:])
            zeros = np.flatnonzero(zeros)
            ordinal = count[event] - count[block * width]
    lead = np.diff(block, prepend=-1) != 0
    gap = np.diff(ordinal, prepend=0) - 1
    gap[lead] = ordinal[lead]
    skips = gap >> 4
    item = (gap & 15) << 8 | flat[event]
    value, bits, target = _ITEM[item], _ITEM_BITS[item], event
    if skips.any():
        where = np.repeat(np.arange(len(event)), skips + 1)
        step = A.concat_ranges(np.zeros(len(event), np.int64), skips + 1)
        skip = step < skips[where]
        reach = ordinal[where] - gap[where] + 16 * step + 15
        start = block[where] * width
        beyond = start + reach if zeros is None else zeros[np.where(skip, count[start] + reach, 0)]
        target = np.where(skip, beyond, event[where])
        value, bits = np.where(skip, _AC_CODE[0][0xF0], value[where]), np.where(skip, _AC_CODE[1][0xF0], bits[where])
        block = block[where]
        lead = np.diff(block, prepend=-1) != 0
    behind = np.empty(len(target), np.int64)
    behind[1:] = target[:-1] + 1
    behind[lead] = block[lead] * width
    # end-of-band runs
    reached = np.arange(n) * width
    reached[block] = target + 1  # the last one stays
    active = np.zeros(n, bool)
    active[block] = True
    needs = reached < (np.arange(n) + 1) * width
    starts = needs & (active | opens | ~np.concatenate([[False], needs[:-1]]))
    run = np.bincount(np.cumsum(starts)[needs] - 1, minlength=int(starts.sum()))
    log = _sizes(run) - 1
    ends = _AC_CODE[0][log << 4] << log.astype(np.uint64) | (run - (1 << log)).astype(np.uint64)
    items = _merged((value, bits, 2 * behind), (ends, _AC_CODE[1][log << 4] + log, 2 * reached[np.flatnonzero(starts)]))
    if before is not None:
        items = _merged(items, _corrections(flat & 1, before, width))
    return items[0], items[1], np.minimum(items[2] // (2 * width), n - 1)


def _corrections(last: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last bits of coefficients that earlier scans set; groups that were all set make one item each."""
    if width % _GROUP:
        old = np.flatnonzero(before.ravel())
        return last[old].astype(np.uint64), np.ones(len(old), np.int64), 2 * old + 1
    full = before.reshape(-1, _GROUP).all(axis=1)
    wide = np.zeros((int(full.sum()), 24), np.uint8)
    wide[:, 24 - _GROUP :] = last.reshape(-1, _GROUP)[full]
    packed = np.packbits(wide, axis=1).astype(np.uint64)
    value = packed[:, 0] << np.uint64(16) | packed[:, 1] << np.uint64(8) | packed[:, 2]
    groups = (value, np.full(len(value), _GROUP), 2 * _GROUP * np.flatnonzero(full) + 1)
    old = np.flatnonzero((before.reshape(-1, _GROUP) & ~full[:, None]).ravel())
    return _merged(groups, (last[old].astype(np.uint64), np.ones(len(old), np.int64), 2 * old + 1))


def _merged(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Both lists of items, which are sorted by their last array, in one."""
    at = np.searchsorted(one[-1], two[-1]) + np.arange(len(two[-1]))
    mine = np.ones(len(one[-1]) + len(two[-1]), bool)
    mine[at] = False
    out = []
    for a, b in zip(one, two, strict=True):
        c = np.empty(len(mine), b.dtype)
        c[mine], c[at] = a, b
        out.append(c)
    return tuple(out)


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([255, kind]) + struct.pack(">H", len(body) + 2) + body


#: Of the scans of luma and of each chroma: first and last coefficient, and the shifts before and now.
LUMA = [(0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (0, 0, 1, 0), (1, 63, 1, 0)]
CHROMA = [(0, 0, 0, 1), (1, 63, 0, 1), (0, 0, 1, 0), (1, 63, 1, 0)]
SCRIPTS = [LUMA, CHROMA, CHROMA]
_TABLES = _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC4, b"\0" + _DC_TABLE) + _segment(0xC4, b"\x10" + _AC_TABLE) + _segment(0xDD, struct.pack(">H", RESTART))
_SCAN_HEADS = [[_segment(0xDA, bytes([1, c, 0, a, b, h << 4 | low])) for a, b, h, low in script] for c, script in enumerate(SCRIPTS, 1)]


def _scan(rows: np.ndarray, opens: np.ndarray, lane_ends: np.ndarray, number: np.ndarray, last: np.ndarray, low: int, top: int, before: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some lanes of a scan, and where each lane ends."""
    if top == 0 and not before:
        value, bits = _dc_first(rows[:, 0].astype(np.int64) >> shift, opens)
        block = np.arange(len(rows))
    elif top == 0:
        value, bits, block = (rows[:, 0] & 1).astype(np.uint64), np.ones(len(rows), np.int64), np.arange(len(rows))
    else:
        now = rows[:, low : top + 1]
        value, bits, block = _ac(now >> shift, now >> before != 0 if before else None, opens)
    packed, size = _packed(value, bits, block, lane_ends)
    return _marked(packed, size, number, last)


def write(data: np.ndarray, n_bytes: np.ndarray) -> list[bytes]:
    """An image for each payload; ``data`` has them all, each filled up with zeros to a positive multiple of 64."""
    blocks = np.maximum(1, -(-n_bytes // BLOCK))
    units = -(-blocks // 6)
    wide = np.ceil(np.sqrt(units)).astype(np.int64)
    high = -(-units // wide)
    whole = wide * high
    base = np.cumsum(6 * whole) - 6 * whole
    coefs = np.zeros((int((6 * whole).sum()), BLOCK), np.uint8)
    coefs[A.concat_ranges(base, blocks)] = data.reshape(-1, BLOCK)
    scans = []
    for script, offset, factor in zip(SCRIPTS, (0, 4, 5), (4, 1, 1), strict=True):
        count = factor * whole
        rows = coefs[A.concat_ranges(base + offset * whole, count)]
        place = A.concat_ranges(np.zeros(len(count), np.int64), count)
        opens = place % RESTART == 0
        number = place[opens] // RESTART
        ends = np.cumsum(-(-count // RESTART))
        lane_edges = np.append(np.flatnonzero(opens), len(rows))
        last = np.zeros(int(ends[-1]), bool)
        last[ends - 1] = True
        for low, top, before, shift in script:
            parts, stops, size_before = [], [], 0
            for lane in range(0, len(last), LANES):
                edges = lane_edges[lane : lane + LANES + 1]
                some = slice(int(edges[0]), int(edges[-1]))
                out, stop = _scan(rows[some], opens[some], edges[1:] - edges[0], number[lane : lane + LANES], last[lane : lane + LANES], low, top, before, shift)
                parts.append(out.tobytes())
                stops.append(stop + size_before)
                size_before += len(out)
            scans.append((b"".join(parts), [0, *np.concatenate(stops)[ends - 1].tolist()]))
    files = []
    heads = [h for some in _SCAN_HEADS for h in some]
    for i, (n, w, h) in enumerate(zip(n_bytes.tolist(), wide.tolist(), high.tolist(), strict=True)):
        frame = _segment(0xC2, struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + b"\1\x22\0\2\x11\0\3\x11\0")
        parts = [b"\xff\xd8", _segment(0xFE, MARK + str(n).encode()), _TABLES, frame]
        for head, (out, edge) in zip(heads, scans, strict=True):
            parts += (head, out[edge[i] : edge[i + 1]])
        parts.append(b"\xff\xd9")
        files.append(b"".join(parts))
    return files


# --- reading --------------------------------------------------------------


@dataclass
class Image:
    """What an image's segments say; ``script`` has what scans share between images."""

    width: int = 0
    height: int = 0
    parts: tuple = ()
    comment: bytes = b""
    script: list = field(default_factory=list)
    spans: list = field(default_factory=list)
    base: list = field(default_factory=list)
    grids: list = field(default_factory=list)

    def grid(self, c: int) -> tuple[int, int, int, int]:
        """Blocks across and down that a scan of one component has, and those stored."""
        if not self.grids:
            most = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
            self.grids = [self._grid(i, most) for i in range(len(self.parts))]
        return self.grids[c]

    def _grid(self, c: int, most: tuple[int, int]) -> tuple[int, int, int, int]:
        h, v = self.parts[c][1:3]
        units = -(-self.width // (8 * most[0])), -(-self.height // (8 * most[1]))
        return -(-(-(-self.width * h // most[0])) // 8), -(-(-(-self.height * v // most[1])) // 8), units[0] * h, units[1] * v


def _parsed(raw: bytes, start: int, stop: int, marks: np.ndarray) -> Image:
    image, at = Image(), start + 2
    tables: dict[int, bytes] = {}
    quant: dict[int, tuple] = {}
    restart = 0
    while at < stop:
        kind = raw[at + 1]
        if kind == 0xD9:
            break
        n = raw[at + 2] << 8 | raw[at + 3]
        body = raw[at + 4 : at + 2 + n]
        at += 2 + n
        if kind == 0xC4:
            while body:
                size = 17 + sum(body[1:17])
                tables[body[0]], body = body[1:size], body[size:]
        elif kind == 0xDB:
            while body:
                size = 129 if body[0] >> 4 else 65
                quant[body[0] & 15], body = tuple(struct.unpack(">64H", body[1:129]) if size == 129 else body[1:65]), body[size:]
        elif kind == 0xDD:
            restart = body[0] << 8 | body[1]
        elif kind == 0xFE:
            image.comment = body
        elif kind == 0xC2:
            _, image.height, image.width, n_parts = struct.unpack(">BHHB", body[:6])
            image.parts = tuple((body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n_parts))
        elif 0xC0 <= kind <= 0xCF:
            raise ValueError("not a Huffman-coded progressive image")
        elif kind == 0xDA:
            ids = [p[0] for p in image.parts]
            which = tuple(ids.index(body[1 + 2 * i]) for i in range(body[0]))
            pick = tuple(body[2 + 2 * i] for i in range(body[0]))
            low, top, shifts = body[1 + 2 * body[0] :][:3]
            used = tuple(tables.get(p >> 4, b"") for p in pick) if top == 0 else (tables.get(16 | pick[0] & 15, b""),)
            end = int(marks[np.searchsorted(marks, at)])
            image.script.append((which, low, top, shifts >> 4, shifts & 15, used, restart))
            image.spans.append((at, end))
            at = end
    image.parts = tuple((*p[:3], quant[p[3]]) for p in image.parts)
    return image


class _Lanes:
    """Lanes of bits: a place in each, and windows of bits from there."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        self.words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
        self.at = at

    def window(self) -> np.ndarray:
        return self.words[self.at >> 3].astype(np.uint64) << (self.at & 7).astype(np.uint64)


def _taken(window: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first ``n`` bits of the windows."""
    return ((window >> np.uint64(1)) >> (63 - n).astype(np.uint64)).astype(np.int64)


def _extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)


def _read_dc(data, at, order, lane_first, lane_count, which, tables, shift, coefs) -> None:
    """``order`` has the blocks of all lanes, ``which`` the component of each."""
    lanes = _Lanes(data, at.copy())
    looks = [_lookup(t) for t in tables]
    diff = np.zeros(len(order), np.int64)
    for step in range(int(lane_count.max(initial=0))):
        live = np.flatnonzero(step < lane_count)
        here = _Lanes.__new__(_Lanes)
        here.words, here.at = lanes.words, lanes.at[live]
        window = here.window()
        item = lane_first[live] + step
        code = np.zeros(len(live), np.int64)
        for c, look in enumerate(looks):
            mine = which[item] == c
            code[mine] = look[(window[mine] >> np.uint64(48)).astype(np.int64)]
        length, size = code & 255, code >> 8
        diff[item] = _extended(_taken(window << length.astype(np.uint64), size), size)
        lanes.at[live] += length + size
    lane = np.repeat(np.arange(len(lane_count)), lane_count)
    for c in range(len(looks)):
        mine = np.flatnonzero(which == c)
        total = np.cumsum(diff[mine])
        first = np.searchsorted(lane[mine], lane[mine])
        coefs[order[mine], 0] = (total - (total - diff[mine])[first]) << shift


def _direct(look: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits that hold a whole coefficient: all its bits and the run before it (shifted by 8), and its value; else 0."""
    length, symbol = look & 255, look >> 8
    run, size = symbol >> 4, symbol & 15
    whole = (size > 0) & (length > 0) & (length + size <= 16)
    window = np.arange(1 << 16)
    bits = (window >> np.maximum(16 - length - size, 0)) & ((1 << size) - 1)
    return np.where(whole, length + size | run << 8, 0), np.where(whole, _extended(bits, size) << shift, 0).astype(np.int16)


def _read_ac(data, at, order, lane_first, lane_count, low, top, table, shift, coefs) -> None:
    lanes, look = _Lanes(data, at.copy()), _lookup(table)
    step, value = _direct(look, shift)
    width = top - low + 1
    flat = np.zeros(len(order) * width, np.int16)
    q, end = lane_first * width, (lane_first + lane_count) * width
    live = q < end
    lanes.at, q, end = lanes.at[live], q[live], end[live]
    while len(q):
        window = lanes.window()
        head = (window >> np.uint64(48)).astype(np.int64)
        go = step[head]
        other = np.flatnonzero(go == 0)
        if len(other):
            code = look[head[other]]
            length, symbol = code & 255, code >> 8
            run, size = symbol >> 4, symbol & 15
            over = (size == 0) & (run < 15)
            more = np.where(over, run, size)
            bits = _taken(window[other] << length.astype(np.uint64), more)
            mine = q[other]
            real = size > 0
            flat[(mine + run)[real]] = _extended(bits[real], size[real]) << shift
            lanes.at += go & 255
            lanes.at[other] += length + more
            direct = np.flatnonzero(go)
            q += go >> 8
            flat[q[direct]] = value[head[direct]]
            q += 1
            q[other] = np.where(over, (mine // width + (1 << np.minimum(run, 14)) + bits) * width, mine + run + 1)
        else:
            lanes.at += go & 255
            q += go >> 8
            flat[q] = value[head]
            q += 1
        live = q < end
        if not live.all():
            lanes.at, q, end = lanes.at[live], q[live], end[live]
    coefs[order, low : top + 1] = flat.reshape(-1, width)


def _read_dc_more(data, at, order, lane_first, lane_count, shift, coefs) -> None:
    place = np.repeat(at - lane_first, lane_count) + np.arange(len(order))
    coefs[order, 0] |= ((data[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).astype(coefs.dtype) << shift


def _read_ac_more(data, at, order, lane_first, lane_count, low, top, table, shift, coefs) -> None:
    lanes, look = _Lanes(data, at.copy()), _lookup(table)
    width = top - low + 1
    flat = coefs[order, low : top + 1].ravel()
    old = flat != 0
    olds, zeros = np.flatnonzero(old), np.flatnonzero(~old)
    count = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(old, out=count[1:])
    q, end = lane_first * width, (lane_first + lane_count) * width
    runs = []  # places in the bits, first old coefficient, and how many
    live = q < end
    lanes.at, q, end = lanes.at[live], q[live], end[live]
    while len(q):
        window = lanes.window()
        code = look[(window >> np.uint64(48)).astype(np.int64)]
        length, symbol = code & 255, code >> 8
        run, size = symbol >> 4, symbol & 15
        over = (size == 0) & (run < 15)
        more = np.where(over, run, size)
        bits = _taken(window << length.astype(np.uint64), more)
        lanes.at += length + more
        # the zero that the run reaches, or the end of the band
        reach = q - count[q] + run
        target = zeros[np.minimum(reach, len(zeros) - 1)] if len(zeros) else q
        following = np.where(over, (q // width + (1 << np.minimum(run, 14)) + bits) * width, target + 1)
        n = count[following] - count[q]
        runs.append((lanes.at.copy(), count[q], n))
        lanes.at += n
        new = size > 0
        flat[target[new]] = np.where(bits[new] == 1, 1, -1) << shift
        q = following
        live = q < end
        if not live.all():
            lanes.at, q, end = lanes.at[live], q[live], end[live]
    if runs:
        where, first, n = (np.concatenate(x) for x in zip(*runs, strict=True))
        turn = np.argsort(first, kind="stable")  # then all old coefficients come in order
        place = A.concat_ranges(where[turn], n[turn])
        low_byte = int(place.min()) >> 3 if len(place) else 0
        bits = np.unpackbits(data[low_byte : (int(place.max(initial=0)) >> 3) + 1])
        set_ = bits[place - 8 * low_byte].astype(flat.dtype) << shift
        was = flat[olds]
        flat[olds] = was + np.where(was > 0, set_, -set_)
    coefs[order, low : top + 1] = flat.reshape(-1, width)


def read(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """The images and all coefficients, a row in zigzag order for each block; ``base`` has where each component's start."""
    raw = b"".join(files)
    byte = np.frombuffer(raw + bytes(8), np.uint8)
    after = np.append(byte[1:], np.uint8(0))
    full = byte == 255
    marks = np.flatnonzero(full & (after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 255))
    restarts = np.flatnonzero(full & (after >= 0xD0) & (after <= 0xD7))
    keep = np.ones(len(byte), bool)
    keep[np.flatnonzero(full[:-1] & (byte[1:] == 0)) + 1] = False
    moved = np.cumsum(keep) - keep
    data = byte[keep]
    edges = np.cumsum([0, *map(len, files)])
    images = [_parsed(raw, int(a), int(b), marks) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    total = 0
    groups: dict[tuple, list[Image]] = {}
    for image in images:
        for c in range(len(image.parts)):
            image.base.append(total)
            total += math.prod(image.grid(c)[2:])
        groups.setdefault((tuple(image.script), len(image.parts)), []).append(image)
    coefs = np.zeros((total, BLOCK), np.int16)
    for (script, _), some in groups.items():
        for j, (which, low, top, before, shift, tables, restart) in enumerate(script):
            grids = [image.grid(which[0]) for image in some]
            if len(which) == 1 and all(g[0] == g[2] for g in grids):  # rows of blocks without a gap
                count = np.array([g[0] * g[1] for g in grids])
                order = A.concat_ranges(np.array([image.base[which[0]] for image in some]), count)
                comp, units = np.zeros(len(order), np.int64), np.ones(len(some), np.int64)
            else:
                orders, comps, units = zip(*(_scan_order(image, which) for image in some), strict=True)
                order, comp, count, units = np.concatenate(orders), np.concatenate(comps), np.array([len(o) for o in orders]), np.array(units)
            per = restart * units if restart else np.maximum(count, 1)
            lanes = np.maximum(1, -(-count // per))
            spans = np.array([image.spans[j] for image in some])
            lane_image = np.repeat(np.arange(len(some)), lanes)
            k = A.concat_ranges(np.zeros(len(some), np.int64), lanes)
            first_mark = np.searchsorted(restarts, spans[:, 0])[lane_image]
            begin = np.where(k == 0, spans[lane_image, 0], restarts[np.minimum(first_mark + k - 1, max(0, len(restarts) - 1))] + 2 if len(restarts) else spans[lane_image, 0])
            at = 8 * moved[begin]
            lane_count = np.minimum(per[lane_image], count[lane_image] - k * per[lane_image])
            lane_first = np.cumsum(lane_count) - lane_count
            for lane in range(0, len(at), LANES):
                part = slice(lane, lane + LANES)
                start = int(lane_first[lane])
                stop = int(lane_first[part][-1] + lane_count[part][-1])
                lanes_ = (data, at[part], order[start:stop], lane_first[part] - start, lane_count[part])
                if top == 0 and not before:
                    _read_dc(*lanes_, comp[start:stop], tables, shift, coefs)
                elif top == 0:
                    _read_dc_more(*lanes_, shift, coefs)
                elif not before:
                    _read_ac(*lanes_, low, top, tables[0], shift, coefs)
                else:
                    _read_ac_more(*lanes_, low, top, tables[0], shift, coefs)
    return images, coefs


def _scan_order(image: Image, which: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """The blocks of a scan in order, their components (as numbered in the scan), and blocks for each restart unit."""
    if len(which) == 1:
        across, down, stored, _ = image.grid(which[0])
        base = image.base[which[0]]
        order = base + np.arange(across * down) if across == stored else (base + np.arange(down)[:, None] * stored + np.arange(across)).ravel()
        return order, np.zeros(len(order), np.int64), 1
    rows, cols = [], []
    for i, c in enumerate(which):
        h, v = image.parts[c][1:3]
        _, _, stored, tall = image.grid(c)
        block = image.base[c] + np.arange(tall)[:, None] * stored + np.arange(stored)
        rows.append(block.reshape(tall // v, v, stored // h, h).transpose(0, 2, 1, 3).reshape(-1, v * h))
        cols.append(np.full(v * h, i))
    order = np.concatenate(rows, axis=1)
    comp = np.tile(np.concatenate(cols), len(order))
    return order.ravel(), comp, order.shape[1]


# --- pixels ---------------------------------------------------------------


def samples(images: list[Image], coefs: np.ndarray) -> np.ndarray:
    """All blocks' samples, 0 to 255, row by row."""
    out = np.empty(coefs.shape, np.uint8)
    quants = {p[3] for image in images for p in image.parts}
    if len(quants) <= 1:
        spans = [(0, len(coefs), quant) for quant in quants]
    else:
        spans = [(image.base[c], image.base[c] + math.prod(image.grid(c)[2:]), p[3]) for image in images for c, p in enumerate(image.parts)]
    for start, stop, quant in spans:
        for at in range(start, stop, BLOCKS):
            some = slice(at, min(at + BLOCKS, stop))
            out[some] = _samples(coefs[some], quant)
    return out


def _samples(coefs: np.ndarray, quant: tuple) -> np.ndarray:
    scaled = coefs * np.array(quant, np.int32)
    # sums of whole numbers below 2 ** 24 are exact in single precision, so they don't depend on their order
    kind = np.float32 if len(coefs) and np.abs(scaled).max() <= 255 else np.float64
    sums = (scaled.astype(kind) @ _TRANSFORM.astype(kind)).astype(np.int32)
    return np.clip((sums + ((128 << _FIXED) + (1 << _FIXED - 1))) >> _FIXED, 0, 255).astype(np.uint8)


def rgb(image: Image, blocks: np.ndarray) -> np.ndarray:
    """The full-resolution tensor (height, width, 3) of an image, from all blocks' samples."""
    most = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
    planes = []
    for c, (_, h, v, _) in enumerate(image.parts):
        _, _, stored, tall = image.grid(c)
        block = blocks[image.base[c] : image.base[c] + stored * tall]
        plane = block.reshape(tall, stored, 8, 8).transpose(0, 2, 1, 3).reshape(8 * tall, 8 * stored)
        if (h, v) != most:
            plane = plane.repeat(most[1] // v, axis=0).repeat(most[0] // h, axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    return to_rgb(*planes)


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Red, green and blue in a last dimension, by 16-bit fixed-point factors."""
    y = (y.astype(np.int32) << 16) + (1 << 15)
    cb, cr = cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    out = np.empty((*y.shape, 3), np.uint8)
    for i, plane in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
        np.clip(plane >> 16, 0, 255, out=out[..., i], casting="unsafe")
    return out

"""Progressive JPEG as a media column: decoding in numpy to coefficient arrays and full-resolution RGB, and a lossless payload store.

The decoder accumulates every spectral-selection and successive-approximation scan of an image into one coefficient
array per component, then transforms them inversely, upsamples the chroma and converts to RGB. Entropy decoding is
sequential inside a restart interval only, so the intervals of a scan, over all images of a batch that share tables
and geometry of the scan, are decoded in lock step: one numpy operation advances every interval by one symbol.

A JPEG's pixels aren't lossless but its quantised coefficients are: the payload store keeps each byte as a coefficient
(byte + 2, never zero) of Y, Cb and Cr blocks at 4:2:0, in five kinds of scans: DC, AC 1-5 and AC 6-63 without their lowest
bit, then that bit of AC and DC. Code lengths are 9 - size, so that every first-pass coefficient takes nine bits.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import bytes_np as B

#: Fixed values: (row, column) order in which JPEG stores an 8 x 8 block's coefficients, as positions in raster order.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: Bytes of stored payload that are decoded at once.
BATCH = 1 << 20


# -- entropy-coded data ------------------------------------------------------------------------------------------

class Stream:
    """Scan data of many images without markers and stuffing, and where each restart interval (lane) begins."""

    def __init__(self, parts: list[bytes]):
        d = np.frombuffer(b"".join(parts) + b"\0", np.uint8)
        size = np.array([len(p) for p in parts])
        starts = np.cumsum(size) - size
        ff = np.flatnonzero(d[:-1] == 0xFF)
        after = d[ff + 1]
        last = np.isin(ff, starts + size - 1)
        stuffed = ff[(after == 0) & ~last] + 1
        restart = ff[(after & 0xF8 == 0xD0) & ~last]
        keep = np.ones(len(d), bool)
        keep[stuffed] = keep[restart] = keep[restart + 1] = keep[-1] = False
        moved = np.cumsum(keep) - keep  # new place of each byte
        begins = np.sort(np.concatenate([starts, restart + 2]))
        self.image = np.searchsorted(starts, begins, "right") - 1
        self.lane = np.arange(len(begins)) - np.searchsorted(begins, starts)[self.image]
        self.pos = moved[np.minimum(begins, len(d) - 1)].astype(np.int64) * 8
        data = np.concatenate([d[keep], np.full(16, 0xFF, np.uint8)])
        self.limit = 8 * (len(data) - 8)
        self.bits = np.unpackbits(data)
        x = data.astype(np.uint64)
        n = len(x) - 4
        self.window = sum(x[i : i + n] << np.uint64(8 * (4 - i)) for i in range(5))  # 40 bits from each byte on

    def peek(self, pos: np.ndarray, n) -> np.ndarray:
        """The n (up to 32) bits from each position on."""
        pos = np.minimum(pos, self.limit)
        shift = 40 - (pos & 7) - n
        return ((self.window[pos >> 3] >> shift.astype(np.uint64)) & ((np.uint64(1) << np.asarray(n).astype(np.uint64)) - np.uint64(1))).astype(np.int64)


def lookup(lengths: bytes, symbols: bytes) -> np.ndarray:
    """16 bits of lookahead -> code length * 256 + symbol; length 0 where no code matches."""
    table, code, at = np.zeros(1 << 16, np.int32), 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            lo = code << (16 - n)
            table[lo : lo + (1 << (16 - n))] = n << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def _symbol(s: Stream, pos: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    got = table[s.peek(pos, np.int64(16))]
    if not got.all():
        raise ValueError("no code matches")
    return got & 255, pos + (got >> 8)


def _extend(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (v < (np.int64(1) << np.maximum(size - 1, 0))), v - (np.int64(1) << size) + 1, v)


def dc_first(s: Stream, coefs: np.ndarray, order: np.ndarray, count: np.ndarray, comp: np.ndarray, tables: dict, al: int) -> None:
    """order[lane, step]: the coefficient row of each block of a lane; comp[step]: its component."""
    pos, pred = s.pos.copy(), defaultdict(lambda: np.zeros(len(s.pos), np.int64))
    for k in range(order.shape[1]):
        on = np.flatnonzero(k < count)
        size, p = _symbol(s, pos[on], tables[comp[k]])
        c = pred[int(comp[k])]
        c[on] += _extend(s.peek(p, size), size)
        pos[on] = p + size
        coefs[order[on, k], 0] = c[on] << al


def dc_refine(s: Stream, coefs: np.ndarray, order: np.ndarray, count: np.ndarray, al: int) -> None:
    for k in range(order.shape[1]):
        on = np.flatnonzero(k < count)
        coefs[order[on, k], 0] |= s.bits[s.pos[on] + k].astype(coefs.dtype) << al


def ac_first(s: Stream, coefs: np.ndarray, order: np.ndarray, count: np.ndarray, table: np.ndarray, ss: int, se: int, al: int) -> None:
    flat, n = coefs.reshape(-1), len(s.pos)
    on, pos, block, k = np.arange(n), s.pos.copy(), np.zeros(n, np.int64), np.full(n, ss)
    while len(on):
        rs, pos = _symbol(s, pos, table)
        run, size = rs >> 4, rs & 15
        take = np.where(size > 0, size, np.where(run < 15, run, 0))
        v = s.peek(pos, take)
        pos = pos + take
        k = k + np.where(size > 0, run, 0)
        put = size > 0
        if put.all():
            flat[order[on, block] * 64 + k] = _extend(v, size) << al
        elif put.any():
            flat[order[on[put], block[put]] * 64 + k[put]] = _extend(v[put], size[put]) << al
        k = k + np.where(put, 1, np.where(run == 15, 16, 64))
        block = block + np.where(~put & (run < 15), (np.int64(1) << run) + v, k > se)
        k = np.where(k > se, ss, k)
        left = block < count[on]
        if not left.all():
            on, pos, block, k = on[left], pos[left], block[left], k[left]


def _refine_one(bits: np.ndarray, pos: int, c: np.ndarray, table: np.ndarray, ss: int, se: int, al: int) -> tuple[int, int]:
    """One block whose first symbol isn't an end of block; returns the position and the blocks that an end covers after this one."""
    k, one = ss, 1 << al
    while k <= se:
        got = int(table[int("".join(map(str, bits[pos : pos + 16])), 2)])
        pos, run, size = pos + (got >> 8), (got >> 4) & 15, got & 15
        new, ends = 0, -1
        if size:
            new, pos = (one if bits[pos] else -one), pos + 1
        elif run < 15:
            ends = (1 << run) + (int("".join(map(str, bits[pos : pos + run])), 2) if run else 0) - 1
            pos, run = pos + run, 64
        while k <= se:
            if c[k]:
                if bits[pos] and not abs(int(c[k])) & one:
                    c[k] += one if c[k] > 0 else -one
                pos += 1
            elif run == 0:
                break
            else:
                run -= 1
            k += 1
        if new and k <= se:
            c[k] = new
        k += 1
        if ends >= 0:
            return pos, ends
    return pos, 0


def ac_refine(s: Stream, coefs: np.ndarray, order: np.ndarray, count: np.ndarray, table: np.ndarray, ss: int, se: int, al: int) -> None:
    n = len(s.pos)
    pos, ended = s.pos.copy(), np.zeros(n, np.int64)
    for b in range(order.shape[1]):
        on = np.flatnonzero(b < count)
        fresh = on[ended[on] == 0]
        if len(fresh):
            rs, p = _symbol(s, pos[fresh], table)
            end = (rs & 15 == 0) & (rs < 0xF0)
            run = rs[end] >> 4
            ended[fresh[end]] = (np.int64(1) << run) + s.peek(p[end], run)
            pos[fresh[end]] = p[end] + run
            for lane in fresh[~end]:
                pos[lane], more = _refine_one(s.bits, int(pos[lane]), coefs[order[lane, b]], table, ss, se, al)
                ended[lane] = more
            on = on[ended[on] > 0] if end.all() else np.setdiff1d(on, fresh[~end])
        rows = order[on, b]
        c = coefs[rows, ss : se + 1]
        known = c != 0
        at = pos[on][:, None] + np.cumsum(known, 1) - 1
        bit = s.bits[np.where(known, at, 0)].astype(coefs.dtype)
        add = known & (bit == 1) & (np.abs(c) & (1 << al) == 0)
        coefs[rows, ss : se + 1] = c + np.where(add, np.sign(c) << al, 0)
        pos[on] += known.sum(1)
        ended[on] -= 1


# -- images --------------------------------------------------------------------------------------------------------

class Image:
    """Markers of one progressive JPEG: size, components, tables, and scans with their raw data."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        self.quant, self.scans, self.comment, self.comps = {}, [], b"", []
        tables, interval, i = {}, 0, 2
        while i + 4 <= len(data):
            marker, size = data[i + 1], int.from_bytes(data[i + 2 : i + 4])
            if data[i] != 0xFF or marker == 0xD9:
                break
            body = data[i + 4 : i + 2 + size]
            i += 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC2:
                self.height, self.width = int.from_bytes(body[1:3]), int.from_bytes(body[3:5])
                self.comps = [(body[j], body[j + 1] >> 4, body[j + 1] & 15, body[j + 2]) for j in range(6, 6 + 3 * body[5], 3)]
            elif marker in (0xC0, 0xC1, 0xC3):
                raise ValueError("not progressive")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables = tables | {body[0]: (body[1:17], body[17 : 17 + n])}
                    body = body[17 + n :]
            elif marker == 0xDD:
                interval = int.from_bytes(body[:2])
            elif marker == 0xDA:
                end = re.compile(b"\xff[^\x00\xd0-\xd7\xff]").search(data, i)
                end = end.start() if end else len(data)
                parts = tuple((body[1 + 2 * j], body[2 + 2 * j]) for j in range(body[0]))
                ss, se, a = body[1 + 2 * body[0] : 4 + 2 * body[0]]
                used = tuple(sorted((k, v) for k, v in tables.items() if any((k >> 4 == 0 and ss == 0 and k & 15 == p >> 4) or (k >> 4 and ss and k & 15 == p & 15) for _, p in parts)))
                self.scans.append(((parts, ss, se, a >> 4, a & 15, interval, used), data[i:end]))
                i = end
        if not self.comps or not self.width or not self.height:
            raise ValueError("no progressive frame")
        self.hmax, self.vmax = max(c[1] for c in self.comps), max(c[2] for c in self.comps)
        if not self.hmax or not self.vmax:
            raise ValueError("no sampling factors")
        self.mcu_w, self.mcu_h = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        if self.mcu_w * self.mcu_h > 8 * len(data):  # each unit has a bit of its own at least, so a frame is bounded by its data before it is allocated
            raise ValueError("frame larger than its data")

    def grid(self, c: int) -> tuple[int, int]:
        """Blocks down and across of a component, with those that only fill up the last units."""
        return self.mcu_h * self.comps[c][2], self.mcu_w * self.comps[c][1]

    def blocks(self, parts) -> tuple[np.ndarray, np.ndarray]:
        """Block rows of a scan by unit: (unit, block) -> component and position in its grid."""
        index = [next(i for i, c in enumerate(self.comps) if c[0] == p) for p, _ in parts]
        if len(index) == 1:
            c = index[0]
            down = -(-(-(-self.height * self.comps[c][2] // self.vmax)) // 8)
            across = -(-(-(-self.width * self.comps[c][1] // self.hmax)) // 8)
            at = (np.arange(down)[:, None] * self.grid(c)[1] + np.arange(across)).reshape(-1, 1)
            return np.array([c]), at
        u, comp, at = np.arange(self.mcu_w * self.mcu_h), [], []
        for c in index:
            _, h, v, _ = self.comps[c]
            for y in range(v):
                for x in range(h):
                    comp.append(c)
                    at.append((u // self.mcu_w * v + y) * self.grid(c)[1] + u % self.mcu_w * h + x)
        return np.array(comp), np.stack(at, 1)


_SPECTRUM = np.array([[(0.5 if u else 0.5 / np.sqrt(2)) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: Whole numbers, so that sums in double precision are exact in any order and equal texts get equal pixels.
_INVERSE = np.einsum("ux,vy->uvxy", np.round(_SPECTRUM * 4096), np.round(_SPECTRUM * 4096)).reshape(64, 64)[ZIGZAG]


def coefficients(images: list[Image]) -> tuple[np.ndarray, list[list[int]]]:
    """Coefficients of all blocks of all images in stored order, and the first row of each component of each image."""
    first, n = [], 0
    for im in images:
        rows = []
        for c in range(len(im.comps)):
            rows.append(n)
            n += im.grid(c)[0] * im.grid(c)[1]
        first.append(rows)
    coefs = np.zeros((n, 64), np.int32)
    depth = max((len(im.scans) for im in images), default=0)
    for turn in range(depth):
        alike = defaultdict(list)
        for k, im in enumerate(images):
            if turn < len(im.scans):
                alike[im.scans[turn][0], tuple(c[:3] for c in im.comps)].append(k)
        for (key, _), ks in alike.items():
            parts, ss, se, ah, al, interval, used = key
            s = Stream([images[k].scans[turn][1] for k in ks])
            units, bases = [], []
            for k in ks:
                comp, at = images[k].blocks(parts)
                units.append(at + np.array([first[k][c] for c in comp]))
                bases.append(len(at))
            wide, per = units[0].shape[1], interval or max(bases)
            total = np.concatenate([*units, np.zeros((per, wide), np.int64)])
            start = (np.cumsum(bases) - bases)[s.image] + s.lane * per
            count = np.clip(np.array(bases)[s.image] - s.lane * per, 0, per)
            order = total[start[:, None] + np.minimum(np.arange(per), np.maximum(count - 1, 0)[:, None])].reshape(len(start), -1)
            tables = {k: lookup(*v) for k, v in used}
            if ss == 0:
                each = {next(i for i, c in enumerate(images[ks[0]].comps) if c[0] == p): t >> 4 for p, t in parts}
                if ah:
                    dc_refine(s, coefs, order, count * wide, al)
                else:
                    dc_first(s, coefs, order, count * wide, np.tile(comp, per), {c: tables[t] for c, t in each.items()}, al)
            else:
                (ac_refine if ah else ac_first)(s, coefs, order, count, tables[16 + (parts[0][1] & 15)], ss, se, al)
    return coefs, first


def rgb(images: list[Image], coefs: np.ndarray, first: list[list[int]]) -> list[np.ndarray]:
    """Full-resolution (height, width, 3) tensors of 8-bit samples."""
    out = []
    flat = {}
    for k, im in enumerate(images):
        planes = []
        for c, (_, h, v, q) in enumerate(im.comps):
            down, across = im.grid(c)
            rows = slice(first[k][c], first[k][c] + down * across)
            x = coefs[rows] * im.quant[q] if not flat.setdefault(im.quant[q].tobytes(), bool((im.quant[q] == 1).all())) else coefs[rows]
            p = np.clip(np.rint(x.astype(np.float64) @ _INVERSE / (1 << 24)) + 128, 0, 255).astype(np.int32)
            p = p.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * down, 8 * across)
            planes.append(p.repeat(im.vmax // v, 0).repeat(im.hmax // h, 1)[: im.height, : im.width])
        if len(planes) == 3:
            y, b, r = planes[0] << 16, planes[1] - 128, planes[2] - 128
            t = np.stack([y + 91881 * r, y - 22554 * b - 46802 * r, y + 116130 * b], -1)
            out.append(np.clip((t + 32768) >> 16, 0, 255).astype(np.uint8))
        else:
            out.append(np.repeat(planes[0][..., None], 3, -1).astype(np.uint8))
    return out


def decode_column(media: DataFrame, column: str = "media") -> DataFrame:
    """media with `column` (binary JPEGs) -> the same rows with height, width and rgb (binary, row by row); null where null or not decodable."""
    at = media.columns.index(column)
    names = [*media.columns, "height", "width", "rgb"]

    def rows(batches):
        for b in batches:
            got = []
            for v in b.column(at):
                try:
                    im = Image(v.as_py() or b"")
                    got.append(rgb([im], *coefficients([im]))[0])
                except Exception:  # noqa: BLE001  whatever is wrong with an image, the job goes on
                    got.append(None)
            size = [pa.array([None if g is None else g.shape[i] for g in got], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *size, pa.array([None if g is None else g.tobytes() for g in got], pa.binary())], names)

    schema = StructType(list(media.schema.fields))  # add() changes the schema it is called on
    return media.mapInArrow(rows, schema.add("height", "integer").add("width", "integer").add("rgb", "binary"))


# -- the payload store -------------------------------------------------------------------------------------------

def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2) + body


_SIZE = np.array([int(v).bit_length() for v in range(129)])
#: Nine bits of each first-pass value 1-128: 8 - size ones, a zero, the value.
_WORD = np.array([(((1 << (8 - s)) - 1) << 1) << s | v if v else 0 for v, s in enumerate(_SIZE)], ">u2")
_CODES = bytes([1] * 8 + [0] * 8) + bytes(range(8, 0, -1))
_TABLES = _segment(0xC4, b"\x00" + _CODES) + _segment(0xC4, b"\x10" + _CODES) + _segment(0xC4, b"\x11" + bytes([1] + [0] * 15) + b"\x00")


def _pack(bits: np.ndarray) -> np.ndarray:
    fill = -bits.shape[1] % 8
    return np.packbits(np.hstack([bits, np.ones((len(bits), fill), np.uint8)]), axis=1)


def _nine(v: np.ndarray) -> np.ndarray:
    w = np.unpackbits(_WORD[v].view(np.uint8).reshape(len(v), -1, 2), axis=2)
    return w[:, :, 7:].reshape(len(v), -1)


def _scan_data(lanes: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Lanes of all images, `count` of them each -> stuffed data with restart markers between an image's lanes."""
    n, width = lanes.shape
    ends = np.cumsum(count)
    number = np.arange(n) - np.repeat(ends - count, count)
    flat = np.hstack([lanes, np.full((n, 1), 0xFF, np.uint8), (0xD0 + number % 8).astype(np.uint8)[:, None]])
    times = np.ones(flat.shape, np.int64)
    times[:, :width] += lanes == 0xFF
    times[ends - 1, width:] = 0
    times = times.reshape(-1)
    out, at = np.repeat(flat.reshape(-1), times), np.cumsum(times)
    out[at[times == 2] - 1] = 0
    cut = at[ends * (width + 2) - 1]
    data = out.tobytes()
    return [data[a:b] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)]


def store(payloads: list[np.ndarray]) -> list[bytes]:
    """Bytes (a multiple of 64) -> progressive JPEGs that hold them losslessly."""
    shape, ys, bs, rs = [], [], [], []
    for p in payloads:
        units = max(1, -(-len(p) // 384))
        across = -(-units // 4095)
        down = -(-units // across)
        units = down * across
        c = np.zeros(units * 384, np.int64)
        c[: len(p)] = p
        c = c.reshape(-1, 64) + 2
        shape.append((down, across, len(p)))
        ys.append(c[: 4 * units])
        bs.append(c[4 * units : 5 * units])
        rs.append(c[5 * units :])
    y, b, r = (np.concatenate(v) for v in (ys, bs, rs))
    units = np.array([d * a for d, a, _ in shape])
    sos = lambda parts, ss, se, a: _segment(0xDA, bytes([len(parts), *(x for p in parts for x in p), ss, se, a]))
    planes = [(1, y, 4 * units), (2, b, units), (3, r, units)]
    scans = []
    for ss, se in ((0, 0), (1, 5), (6, 63)):  # every block is a restart interval, so DC predictions are 0
        scans += [(sos([(k, 0)], ss, se, 0x01), _scan_data(_pack(_nine(v[:, ss : se + 1] >> 1)), n)) for k, v, n in planes]
    for k, v, n in planes:
        bits = np.hstack([np.zeros((len(v), 1), np.uint8), (v[:, 1:] & 1).astype(np.uint8)])
        scans.append((sos([(k, 1)], 1, 63, 0x10), _scan_data(_pack(bits), n)))
    for k, v, n in planes:
        scans.append((sos([(k, 0)], 0, 0, 0x10), _scan_data(_pack((v[:, :1] & 1).astype(np.uint8)), n)))
    quant = _segment(0xDB, b"\0" + b"\1" * 64)
    out = []
    for k, (down, across, size) in enumerate(shape):
        frame = _segment(0xC2, b"\x08" + (16 * down).to_bytes(2) + (16 * across).to_bytes(2) + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00")
        head = b"\xff\xd8" + _segment(0xFE, b"payload=%d" % size) + quant + frame + _TABLES + _segment(0xDD, b"\0\1")
        out.append(head + b"".join(h + d[k] for h, d in scans) + b"\xff\xd9")
    return out


def payload(im: Image, coefs: np.ndarray, first: list[int]) -> bytes:
    """The bytes that store() put into an image."""
    c = (coefs[first[0] : first[0] + 6 * im.mcu_w * im.mcu_h] - 2).astype(np.uint8)
    return c.tobytes()[: int(im.comment.removeprefix(b"payload="))]


_STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int"


def _stored(keep_tensor: bool):
    def rows(batches):
        for b in batches:
            data, at = B.texts(b.column(1))
            for i, j in B.chunks(at, BATCH):
                sizes = np.diff(at[i : j + 1])
                padded = []
                for lo, n in zip(at[i:j], sizes, strict=True):
                    p = np.zeros(max(64, -(-n // 64) * 64), np.uint8)
                    p[:n] = data[lo : lo + n]
                    padded.append(p)
                media = store(padded)
                images = [Image(m) for m in media]
                coefs, first = coefficients(images)
                tensors = rgb(images, coefs, first)
                out = [[] for _ in range(8)]
                for k, (im, t) in enumerate(zip(images, tensors, strict=True)):
                    got = payload(im, coefs, first[k])
                    mean = t.reshape(-1, 3).mean(0, dtype=np.float64)
                    row = (len(got), sha256(got).hexdigest(), zlib.crc32(got[-64:]), len(media[k]), sha256(media[k]).hexdigest(), f"{im.height}x{im.width} mean {mean[0]:.3f} {mean[1]:.3f} {mean[2]:.3f} crc {zlib.crc32(t):08x}", im.height, im.width)
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                columns = [b.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4]), pa.array(out[5]), pa.array(out[6], pa.int32()), pa.array(out[7], pa.int32())]
                names = [c.split()[0] for c in _STORED.split(", ")]
                if keep_tensor:
                    columns += [pa.array(media, pa.binary()), pa.array([t.tobytes() for t in tensors], pa.binary())]
                    names += ["media", "rgb"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows


def store_texts(docs: DataFrame, keep_tensor: bool = False) -> DataFrame:
    """(doc_id, text) -> digests of what was stored, read back and decoded; with keep_tensor also media and rgb (full resolution, 8 bits).

    A null or empty text is a payload of 64 zero bytes with n_bytes 0. Equal texts get equal values. Any length fits:
    images grow down to 65,520 rows, then across. One row for each row, whatever its doc_id.
    """
    schema = _STORED + (", media binary, rgb binary" if keep_tensor else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_stored(keep_tensor), schema)

"""Baseline JPEG files of 8-bit gray or RGB images: numpy for the transform, Huffman codes made for each image.

Colours aren't subsampled, as slices are mostly text. Everything is done for all blocks of a band of block rows at once.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

# The quantisation steps of ITU-T T.81, annex K, for luma and chroma, row by row.
LUMA_STEPS = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99)
CHROMA_STEPS = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    *[99] * 32)
# RGB to luma and colour differences.
TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]], np.float32)
#: The order in which the 64 numbers of a block are written: along its anti-diagonals, alternately up and down.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_COSINES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32)
#: Block rows that are transformed at once.
BAND = 64
END, SIXTEEN_ZEROS = 0x00, 0xF0


def steps_of(quality: int):
    """The quantisation steps for a quality from 1 to 100, luma and chroma."""
    if not 1 <= quality <= 100:
        raise ValueError("a quality is from 1 to 100")
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255).astype(np.int32) for t in (LUMA_STEPS, CHROMA_STEPS)]


def _coefficients(img, steps):
    """Quantised blocks of each component, in the order of writing: an array of (blocks, components, 64)."""
    h, w = img.shape[:2]
    planes = img[:, :, None] if img.ndim == 2 else img
    planes = np.pad(planes, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    out = []
    for top in range(0, len(planes), 8 * BAND):
        x = planes[top:top + 8 * BAND].astype(np.float32)
        x = x @ TO_YCC.T if x.shape[2] == 3 else x
        x[:, :, 0] -= 128
        x = x.reshape(len(x) // 8, 8, x.shape[1] // 8, 8, -1).transpose(0, 2, 4, 1, 3)
        x = (_COSINES @ x @ _COSINES.T).reshape(-1, planes.shape[2], 64)
        for c in range(planes.shape[2]):
            x[:, c] /= steps[min(c, 1)]
        out.append(np.rint(x).astype(np.int32)[:, :, ZIGZAG])
    return np.concatenate(out)


def _sizes(v):
    """How many bits the magnitude of each number has."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _bits_of(v, size):
    """The bits that tell numbers of one size apart."""
    return np.where(v < 0, v + (1 << size) - 1, v)


def _symbols(blocks):
    """(place, table, symbol, extra bits, their number) of all that is written, in order. Tables: 0 and 1 levels of luma and chroma, 2 and 3 the rest."""
    n, parts, _ = blocks.shape
    flat = blocks.reshape(n * parts, 64)
    kind = np.tile(np.minimum(np.arange(parts), 1), n)
    block = np.arange(n * parts, dtype=np.int64)
    level = blocks[:, :, 0] - np.concatenate([np.zeros((1, parts), blocks.dtype), blocks[:-1, :, 0]])
    level = level.reshape(-1)
    size = _sizes(level)
    rows = [(block * 256, kind, size, _bits_of(level, size), size)]
    at, k = np.nonzero(flat[:, 1:])
    k = k + 1
    before = np.where(np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.empty(0, bool), 0, np.concatenate([[0], k[:-1]]) if len(k) else k)
    run, value = k - before - 1, flat[at, k]
    size = _sizes(value)
    rows.append((at * 256 + 2 * k + 1, 2 + kind[at], (run % 16) * 16 + size, _bits_of(value, size), size))
    for m in (1, 2, 3):  # sixteen zeros each, before the number that they lead to
        long = run >= 16 * m
        rows.append((at[long] * 256 + 2 * k[long], 2 + kind[at[long]], np.full(long.sum(), SIXTEEN_ZEROS), np.zeros(long.sum(), np.int64), np.zeros(long.sum(), np.int64)))
    last = np.zeros(n * parts, np.int64)
    np.maximum.at(last, at, k)
    ends = np.flatnonzero(last < 63)
    rows.append((ends * 256 + 255, 2 + kind[ends], np.full(len(ends), END), np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)))
    place, table, symbol, extra, size = (np.concatenate([np.asarray(r[i], np.int64) for r in rows]) for i in range(5))
    order = np.argsort(place, kind="stable")
    return table[order], symbol[order], extra[order], size[order]


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Huffman lengths of 16 bits at most; no code is all ones, as a symbol that is never used has the longest."""
    heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(counts.items()))] + [(0, -1, [-1])]
    heapq.heapify(heap)
    depth = dict.fromkeys([*counts, -1], 0)
    tie = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], tie, a[2] + b[2]))
        tie += 1
    of_length = [0] * (max(depth.values()) + 1)
    for d in depth.values():
        of_length[d] += 1
    for i in range(len(of_length) - 1, 16, -1):  # two leaves of the deepest level: one goes up, the other splits a leaf further up
        while of_length[i] > 0:
            j = i - 2
            while of_length[j] == 0:
                j -= 1
            of_length[i] -= 2
            of_length[i - 1] += 1
            of_length[j + 1] += 2
            of_length[j] -= 1
    longest = max(i for i, n in enumerate(of_length) if n)
    of_length[longest] -= 1  # the unused symbol's
    lengths = [i for i, n in enumerate(of_length) for _ in range(n)]
    ranked = sorted(counts, key=lambda s: (depth[s], s))
    return dict(zip(ranked, lengths, strict=True))


def _codes(lengths):
    """Canonical codes: symbol -> code, in the order of lengths."""
    out, code, was = {}, 0, 0
    for s, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - was
        out[s], was = code, n
        code += 1
    return out


def _segment(mark, data):
    return struct.pack(">BBH", 0xFF, mark, len(data) + 2) + data


def encode(img: np.ndarray, quality: int = 92, dpi: int | None = None) -> bytes:
    """A JPEG file of a gray (h, w) or RGB (h, w, 3) image."""
    h, w = img.shape[:2]
    if not 0 < h < 65536 or not 0 < w < 65536:
        raise ValueError(f"no JPEG can have {w} x {h} pixels")
    steps = steps_of(quality)
    parts = 1 if img.ndim == 2 else 3
    table, symbol, extra, size = _symbols(_coefficients(img, steps))
    code, length = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64)
    tables = []
    for t in sorted(set(table.tolist())):
        here = table == t
        values, counts = np.unique(symbol[here], return_counts=True)
        lengths = code_lengths(dict(zip(values.tolist(), counts.tolist(), strict=True)))
        codes = _codes(lengths)
        to_code, to_length = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for s in lengths:
            to_code[s], to_length[s] = codes[s], lengths[s]
        code[here], length[here] = to_code[symbol[here]], to_length[symbol[here]]
        ordered = sorted(lengths, key=lambda s: codes[s] << (16 - lengths[s]))
        tables.append(bytes([(t // 2) * 16 + t % 2, *[sum(n == i for n in lengths.values()) for i in range(1, 17)], *ordered]))
    body = _packed(code << size | extra, length + size)
    density = struct.pack(">BHH", 1, dpi, dpi) if dpi else struct.pack(">BHH", 0, 1, 1)
    ids = [bytes([c + 1, 0x11, min(c, 1)]) for c in range(parts)]
    return b"".join([
        b"\xff\xd8", _segment(0xE0, b"JFIF\0\x01\x01" + density + b"\0\0"),
        *[_segment(0xDB, bytes([i]) + steps[i][ZIGZAG].astype(np.uint8).tobytes()) for i in range(min(parts, 2))],
        _segment(0xC0, struct.pack(">BHHB", 8, h, w, parts) + b"".join(ids)), *[_segment(0xC4, t) for t in tables],
        _segment(0xDA, bytes([parts]) + b"".join(bytes([c + 1, min(c, 1) * 0x11]) for c in range(parts)) + b"\0\x3f\0"),
        body.replace(b"\xff", b"\xff\0"), b"\xff\xd9"])


def _packed(words, lengths, at_once=1 << 18):
    """The lowest bits of words, so many of each, one after the other; filled up with ones."""
    out, rest = [], np.empty(0, np.uint8)
    for i in range(0, len(words), at_once):
        v, n = words[i:i + at_once], lengths[i:i + at_once]
        ends = np.cumsum(n)
        word = np.repeat(np.arange(len(v)), n)
        shift = ends[word] - 1 - np.arange(ends[-1])
        bits = np.concatenate([rest, (v[word] >> shift & 1).astype(np.uint8)])
        whole = len(bits) // 8 * 8
        out.append(np.packbits(bits[:whole]).tobytes())
        rest = bits[whole:]
    if len(rest):
        out.append(np.packbits(np.concatenate([rest, np.ones(8 - len(rest), np.uint8)])).tobytes())
    return b"".join(out)

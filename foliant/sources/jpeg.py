"""Baseline JPEG files from r, g, b arrays (ITU T.81, JFIF): full chroma, Huffman codes made from each picture's own counts."""

from __future__ import annotations

import struct
from collections import Counter
from heapq import heapify, heappop, heappush

import numpy as np

# The example quantization tables of T.81 (Annex K), by rows.
LUMA_STEPS = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA_STEPS = (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66) + (99,) * 38
LEAST_QUALITY, MOST_QUALITY = 1, 100
_ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
_COSINES = np.array([[(0.5 if u else np.sqrt(0.125)) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def steps(quality: int) -> tuple[np.ndarray, np.ndarray]:
    """Both tables scaled by a quality of 1 to 100; 50 leaves them as they are."""
    q = min(max(int(quality), LEAST_QUALITY), MOST_QUALITY)
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return tuple(np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMA_STEPS, CHROMA_STEPS))


def _blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantized coefficients of each 8 x 8 block in zigzag order; the last rows and columns fill up the border."""
    h, w = plane.shape
    plane = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128.0
    tiles = plane.reshape(plane.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
    return np.rint((_COSINES @ tiles @ _COSINES.T).reshape(-1, 64) / table).astype(int)[:, _ZIGZAG]


def _symbols(blocks: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(symbol, bits, number of bits) of each block: the change of its mean, then runs of zeros and values."""
    out, before = [], 0
    for block in blocks.tolist():
        row, run = [], 0
        for k, v in enumerate([block[0] - before, *block[1:]]):
            if k and not v:
                run += 1
                continue
            while run > 15:
                row.append((0xF0, 0, 0))
                run -= 16
            n = abs(v).bit_length()
            row.append((run << 4 | n, v if v >= 0 else v + (1 << n) - 1, n))
            run = 0
        if run:
            row.append((0, 0, 0))
        before = block[0]
        out.append(row)
    return out


def _code(counts: Counter) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A table segment's body and (code, length) of each symbol: Huffman's lengths, none over 16 nor a code of ones alone."""
    heap = [(n, k, [s]) for k, (s, n) in enumerate(sorted(counts.items()))] + [(0, -1, [-1])]  # -1 takes the code of ones
    length = dict.fromkeys([*counts, -1], 0)
    heapify(heap)
    while len(heap) > 1:
        (n, k, a), (m, _, b) = heappop(heap), heappop(heap)
        for s in a + b:
            length[s] += 1
        heappush(heap, (n + m, k, a + b))
    per = np.bincount([max(v, 1) for v in length.values()], minlength=64)
    for n in range(len(per) - 1, 16, -1):  # as T.81 (K.3) shortens codes
        while per[n] > 0:
            shorter = max(j for j in range(1, n - 1) if per[j] > 0)
            per[n] -= 2
            per[n - 1] += 1
            per[shorter + 1] += 2
            per[shorter] -= 1
    per = per[:17]
    per[max(np.flatnonzero(per))] -= 1
    order = sorted(counts, key=lambda s: (length[s], s))
    codes, code, at = {}, 0, 0
    for n in range(1, 17):
        for s in order[at : at + per[n]]:
            codes[s] = (code, n)
            code += 1
        at += per[n]
        code <<= 1
    return bytes(per[1:].tolist()) + bytes(order), codes


def encode(rgb: np.ndarray, quality: int = 92) -> bytes:
    """A JPEG of h x w x 3 levels; the quality is held within 1..100."""
    h, w = rgb.shape[:2]
    r, g, b = (rgb[..., c].astype(np.float64) for c in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402]
    tables = steps(quality)
    parts = [_symbols(_blocks(p, tables[k > 0])) for k, p in enumerate(planes)]
    counts = [[Counter(s[0][0] for p in some for s in p), Counter(x[0] for p in some for s in p for x in s[1:])] for some in (parts[:1], parts[1:])]
    made = [[_code(c or Counter({0: 1})) for c in pair] for pair in counts]
    bits, size = 0, 0
    chunks = []
    for blocks in zip(*parts, strict=True):
        for k, row in enumerate(blocks):
            for i, (symbol, value, n) in enumerate(row):
                code, m = made[k > 0][i > 0][1][symbol]
                bits = (bits << m | code) << n | value
                size += m + n
        if size >= 4096:
            left = size % 8
            chunks.append((bits >> left).to_bytes(size // 8, "big"))
            bits, size = bits & ((1 << left) - 1), left
    pad = -size % 8
    chunks.append(((bits << pad) | ((1 << pad) - 1)).to_bytes((size + pad) // 8, "big"))
    segment = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    head += b"".join(segment(0xDB, bytes([k]) + bytes(t[_ZIGZAG].tolist())) for k, t in enumerate(tables))
    head += segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes([k + 1, 0x11, k > 0]) for k in range(3)))
    head += b"".join(segment(0xC4, bytes([ac << 4 | k]) + made[k][ac][0]) for k in range(2) for ac in range(2))
    return head + segment(0xDA, b"\3\1\0\2\x11\3\x11\0\x3f\0") + b"".join(chunks).replace(b"\xff", b"\xff\0") + b"\xff\xd9"

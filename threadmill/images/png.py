"""PNG files of 8-bit gray or RGB images, written and (for those this module writes) read with zlib."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(img: np.ndarray, dpi: int | None = None, level: int = 6) -> bytes:
    """Each row is stored as its difference to the row above (filter type 2)."""
    h, w = img.shape[:2]
    rows = img.reshape(h, -1)
    up = rows.copy()
    up[1:] -= rows[:-1]  # modulo 256
    raw = np.concatenate([np.full((h, 1), 2, np.uint8), up], axis=1).tobytes()
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if img.ndim == 3 else 0, 0, 0, 0))]
    if dpi:
        per_metre = round(dpi / 0.0254)
        parts.append(_chunk(b"pHYs", struct.pack(">IIB", per_metre, per_metre, 1)))
    return b"".join([*parts, _chunk(b"IDAT", zlib.compress(raw, level)), _chunk(b"IEND", b"")])


def decode(data: bytes) -> np.ndarray:
    """The image of what ``encode`` wrote."""
    at, body, shape = len(SIGNATURE), b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at:at + 8])
        chunk = data[at + 8:at + 8 + n]
        if kind == b"IHDR":
            w, h, _, colour = struct.unpack(">IIBB", chunk[:10])
            shape = (h, w, 3) if colour == 2 else (h, w)
        elif kind == b"IDAT":
            body += chunk
        at += n + 12
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(shape[0], -1)
    if (rows[:, 0] != 2).any():
        raise ValueError("only filter type 2 is read here")
    return np.cumsum(rows[:, 1:], axis=0, dtype=np.uint8).reshape(shape)

"""Image kernels on numpy arrays: uint8, height x width x 3 (RGB) or height x width (gray)."""

from __future__ import annotations

import math

import numpy as np

# Luma weights, the mean luma below which an image is dark, and the sizes that analyses shrink images to.
LUMA = (0.299, 0.587, 0.114)
DARK_BELOW = 115
DARK_WIDTH, CROP_WIDTH, LINE_SIZE, SKEW_WIDTH = 200, 500, (600, 1200), 800
EDGE_TRIM = 0.02
LAGS = (8, 60)
ROWS_AT_ONCE, OUT_ROWS = 1024, 64


class SliceError(Exception):
    """An image that can't be processed as configured."""


def _u8(x):
    x = np.rint(x)
    return np.clip(x, 0, 255, out=x).astype(np.uint8)


def luma(img: np.ndarray) -> np.ndarray:
    return img if img.ndim == 2 else _u8(img @ np.array(LUMA, np.float32))


def _triangle(x):
    return np.maximum(0, 1 - np.abs(x))


def _lanczos3(x):
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)


FILTERS = {"bilinear": (_triangle, 1.0), "lanczos": (_lanczos3, 3.0)}


def _taps(n_in, n_out, kind):
    """(indices, weights), each n_out x taps: what each output pixel is made of. Shrinking widens the filter."""
    f, support = FILTERS[kind]
    ratio = n_in / n_out
    wide = max(ratio, 1.0)
    centre = (np.arange(n_out) + 0.5) * ratio
    first = np.floor(centre - support * wide).astype(int)
    at = first[:, None] + np.arange(math.ceil(2 * support * wide) + 1)[None, :]
    weights = f((at + 0.5 - centre[:, None]) / wide) * ((at >= 0) & (at < n_in))
    return np.clip(at, 0, n_in - 1), (weights / weights.sum(axis=1, keepdims=True)).astype(np.float32)


def _along_rows(img, n_out, kind):
    """Blocks of output rows, each a small dense matrix times the source rows that it draws from."""
    at, weights = _taps(img.shape[0], n_out, kind)
    flat = np.ascontiguousarray(img).reshape(img.shape[0], -1)
    out = np.empty((n_out, flat.shape[1]), np.uint8)
    for lo in range(0, n_out, OUT_ROWS):
        rows, w = at[lo:lo + OUT_ROWS], weights[lo:lo + OUT_ROWS]
        first, last = int(rows.min()), int(rows.max()) + 1
        matrix = np.zeros((len(rows), last - first), np.float32)
        np.add.at(matrix, (np.arange(len(rows))[:, None], rows - first), w)
        out[lo:lo + OUT_ROWS] = _u8(matrix @ flat[first:last].astype(np.float32))
    return out.reshape(n_out, *img.shape[1:])


def resize(img: np.ndarray, width: int, height: int, kind: str = "bilinear") -> np.ndarray:
    if width < 1 or height < 1:
        raise SliceError("an image needs a pixel at least")
    out = img if width == img.shape[1] else np.ascontiguousarray(np.swapaxes(_along_rows(np.swapaxes(img, 0, 1), width, kind), 0, 1))
    return out if height == img.shape[0] else _along_rows(out, height, kind)


def margin_crop(img, left=0, top=0, right=0, bottom=0):
    """(image, box) without the margins."""
    h, w = img.shape[:2]
    box = (left, top, w - right, h - bottom)
    if box[2] <= box[0] or box[3] <= box[1] or min(left, top, right, bottom) < 0:
        raise SliceError(f"margins leave nothing of {w} x {h}")
    return img[box[1]:box[3], box[0]:box[2]], box


def upscale(img, factor):
    if factor <= 0:
        raise SliceError("a scale factor is above 0")
    return img if abs(factor - 1) < 1e-6 else resize(img, max(1, int(img.shape[1] * factor)), max(1, int(img.shape[0] * factor)), "lanczos")


def is_dark(img) -> bool:
    g = luma(img)
    return float(resize(g, DARK_WIDTH, max(50, DARK_WIDTH * g.shape[0] // g.shape[1])).mean()) < DARK_BELOW


def brightness(img, factor):
    return _u8(np.arange(256) * factor)[img]


def contrast(img, factor):
    """Levels spread around the mean luma."""
    grey = np.rint(luma(img).mean())
    return _u8(grey + (np.arange(256) - grey) * factor)[img]


def median3(img):
    """The median of each pixel's 3 x 3 neighbourhood; borders repeat."""
    padded = np.pad(img, ((1, 1), (1, 1), *[(0, 0)] * (img.ndim - 2)), mode="edge")
    h, w = img.shape[:2]
    out = np.empty_like(img)
    for lo in range(0, h, ROWS_AT_ONCE):
        n = min(ROWS_AT_ONCE, h - lo)
        around = np.stack([padded[lo + dy:lo + dy + n, dx:dx + w] for dy in range(3) for dx in range(3)])
        out[lo:lo + n] = np.partition(around, 4, axis=0)[4]
    return out


def enhance(img, auto=False, strength=1.25, bright=1.05, denoise=False, manual=1.0):
    """(image, dark, applied): noise, then contrast for dark or light images, then a manual contrast."""
    if not auto and not denoise and abs(manual - 1) < 1e-6:
        return img, None, False
    dark = is_dark(img)
    if denoise:
        img = median3(img)
    if auto:
        img = contrast(brightness(img, bright), strength) if dark else contrast(img, max(1.05, strength - 0.15))
    if abs(manual - 1) > 1e-6:
        img = contrast(img, manual)
    return img, dark, True


def otsu_threshold(gray) -> int:
    """The level that separates two classes with most variance between them; the first of equals."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    between[(below == 0) | (above == 0)] = -1
    return int(between.argmax()) if between.max() >= 0 else 0


def binarize(img):
    g = luma(img)
    t = otsu_threshold(g)
    return np.repeat(np.where(g > t, 255, 0).astype(np.uint8)[:, :, None], 3, axis=2), t


def auto_crop(img, pad=12):
    """(image, box, reason or None): the columns with all but EDGE_TRIM of the vertical edges on either side, and a pad."""
    h, w = img.shape[:2]
    small_w = min(CROP_WIDTH, w)
    g = resize(luma(img), small_w, max(80, int(h * small_w / w))).astype(np.int16)
    edges = np.abs(np.diff(g, axis=0)).mean(axis=0)
    if edges.sum() <= 1e-6:
        return img, (0, 0, w, h), "no_edge_energy"
    goal = edges.sum() * EDGE_TRIM
    first = int(np.argmax(np.cumsum(edges) >= goal))
    last = small_w - 1 - int(np.argmax(np.cumsum(edges[::-1]) >= goal))
    if last <= first:
        return img, (0, 0, w, h), "bad_bounds"
    left, right = max(0, int(first * w / small_w) - pad), min(w, int((last + 1) * w / small_w) + pad)
    return img[:, left:right], (left, 0, right, h), None


def line_height(img) -> int | None:
    """The spacing of text lines in pixels, from the autocorrelation of the rows' ink; None where there is none."""
    g = luma(img)
    h, w = g.shape
    top, bottom = int(h * 0.15), int(h * 0.85)
    if bottom <= top + 50:
        top, bottom = 0, h
    band = g[top:bottom]
    small = resize(band, min(LINE_SIZE[0], w), min(LINE_SIZE[1], len(band)))
    mean = float(small.mean())
    dark = mean < DARK_BELOW
    level = int(min(235, max(20, mean + (20 if dark else -20))))
    ink = (small > level if dark else small < level).sum(axis=1).astype(float)
    ink -= ink.mean()
    scores = np.array([ink[:-lag] @ ink[lag:] if lag < len(ink) else 0.0 for lag in range(LAGS[0], LAGS[1] + 1)])
    best = int(scores.argmax())
    return max(LAGS[0], int((LAGS[0] + best) * len(band) / len(small))) if scores[best] > 0 else None


def chunk_height(line, lines, least, most, default):
    return default if line is None else max(least, min(most, int(lines * line)))


class Skew:
    """Scores of small rotations without rotating: columns are shifted by what the angle gives, all of a shift at once.

    Row sums of a rotated image are sums along slanted lines. Sums over runs of columns come from one cumulative table, so
    an angle costs a vector addition for each whole pixel that the slant spans.
    """

    def __init__(self, img):
        g = luma(img)
        scale = min(1.0, SKEW_WIDTH / g.shape[1])
        small = resize(g, max(1, int(g.shape[1] * scale)), max(1, int(g.shape[0] * scale)))
        self.h, self.w = small.shape
        self.table = np.zeros((self.w + 1, self.h), np.float64)
        np.cumsum(small.T.astype(np.float64), axis=0, out=self.table[1:])

    def score(self, degrees: float) -> float:
        """Variance of the row means after a rotation by so many degrees (anticlockwise); what moves in is white."""
        shift = np.rint((np.arange(self.w) - (self.w - 1) / 2) * math.tan(math.radians(degrees))).astype(int)
        starts = np.flatnonzero(np.r_[True, shift[1:] != shift[:-1]])
        total = np.zeros(self.h)
        for lo, hi in zip(starts, np.r_[starts[1:], self.w], strict=True):
            s, run = int(np.clip(shift[lo], -self.h, self.h)), self.table[hi] - self.table[lo]
            white = 255.0 * (hi - lo)
            if s >= 0:
                total[:self.h - s] += run[s:]
                total[self.h - s:] += white
            else:
                total[-s:] += run[:self.h + s]
                total[:-s] += white
        return float((total / self.w).var())

    def best(self, angles, start=(0.0, -1.0)):
        """(angle, score), the first of equals."""
        angle, most = start
        for a in angles:
            s = self.score(a)
            if s > most:
                angle, most = a, s
        return angle, most


def _grid(lo, hi, step):
    return [lo + k * step for k in range(int((hi - lo) / step + 1e-9) + 1)]


def skew_angle(img, most=2.0, step=0.25) -> float:
    return Skew(img).best(_grid(-most, most, step))[0] if most > 0 and step > 0 else 0.0


def skew_angle_two_stage(img, most=2.0, coarse=0.5, fine=0.1) -> float:
    """A coarse grid, then a fine one around its best angle."""
    if most <= 0:
        return 0.0
    skew = Skew(img)
    found = skew.best(_grid(-most, most, coarse))
    return skew.best(_grid(max(-most, found[0] - coarse), min(most, found[0] + coarse), fine), found)[0]


def rotate(img, degrees, fill=255):
    """The image turned anticlockwise about its centre, bilinear, in its old size; what moves in is white."""
    if abs(degrees) < 1e-6:
        return img
    h, w = img.shape[:2]
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    x = np.arange(w, dtype=np.float32) - (w - 1) / 2
    out = np.empty_like(img)
    for lo in range(0, h, ROWS_AT_ONCE):
        y = (np.arange(lo, min(h, lo + ROWS_AT_ONCE), dtype=np.float32) - (h - 1) / 2)[:, None]
        sx, sy = c * x - s * y + (w - 1) / 2, s * x + c * y + (h - 1) / 2
        x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
        fx, fy = (sx - x0), (sy - y0)
        acc = np.zeros((len(y), *img.shape[1:]), np.float32)
        for dx, dy, weight in ((0, 0, (1 - fx) * (1 - fy)), (1, 0, fx * (1 - fy)), (0, 1, (1 - fx) * fy), (1, 1, fx * fy)):
            px, py = x0 + dx, y0 + dy
            inside = (px >= 0) & (px < w) & (py >= 0) & (py < h)
            value = img[np.clip(py, 0, h - 1), np.clip(px, 0, w - 1)].astype(np.float32)
            if img.ndim == 3:
                inside, weight = inside[:, :, None], weight[:, :, None]
            acc += np.where(inside, value, fill) * weight
        out[lo:lo + len(y)] = _u8(acc)
    return out


def slices(height: int, chunk: int, overlap: int):
    """(top, bottom) of overlapping windows; the last may be short."""
    if chunk < 1 or not 0 <= overlap < chunk:
        raise SliceError("0 <= overlap < chunk height is needed")
    n = 1 if height <= chunk else 1 + math.ceil((height - chunk) / (chunk - overlap))
    return [(i * (chunk - overlap), min(height, i * (chunk - overlap) + chunk)) for i in range(n)]


def dhash(img, size: int = 8) -> int:
    """A signed 64-bit difference hash: bit k is set where pixel k of the rows is brighter than its right neighbour."""
    g = resize(luma(img), size + 1, size).astype(np.int16)
    bits = (g[:, :-1] > g[:, 1:]).ravel()
    n = sum(1 << int(k) for k in np.flatnonzero(bits))
    return n - (1 << 64) if n >> 63 else n


def hamming64(a: int, b: int) -> int:
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


def thumbnail(img, size: int = 64) -> bytes:
    return resize(luma(img), size, size).tobytes()


def mean_abs_diff(a: bytes, b: bytes) -> float:
    if not a or len(a) != len(b):
        return 1e9
    return float(np.abs(np.frombuffer(a, np.uint8).astype(np.int16) - np.frombuffer(b, np.uint8)).mean())

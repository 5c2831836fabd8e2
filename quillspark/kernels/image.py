"""Image kernels in numpy, for use inside Arrow batches: decoding headers, gray, Otsu, components, boxes, skew, crop.

Rasters are uint8 arrays, (rows, columns) or (rows, columns, 3) in BGR order. Filters that need a vision library (bilateral,
CLAHE, adaptive threshold) are not part of it; steps can be plugged in by name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

# Dilation of ink into region boxes, least sizes, skew search, border trim, quality ceilings.
DILATE, DILATIONS, LEAST_COMPONENT, LEAST_REGION = (25, 11), 2, 8, 150
SKEW_RANGE, SKEW_STEP, SKEW_WIDTH = 15.0, 0.5, 600
DARK, MOST_TRIM, SHARP, CONTRAST = 40.0, 0.35, 500.0, 80.0


def read_png(data: bytes) -> np.ndarray:
    """8-bit gray or RGB PNG without interlacing, as a raster."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, parts, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    w, h, depth, color, *_, interlace = head
    if depth != 8 or color not in (0, 2) or interlace:
        raise ValueError("only 8-bit gray or RGB without interlacing")
    channels = 3 if color == 2 else 1
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    for y in range(h):
        line, kind = raw[y, 1:].copy(), raw[y, 0]
        above = out[y - 1] if y else np.zeros(w * channels, np.uint8)
        if kind == 2:
            line += above
        elif kind in (1, 3, 4):
            for x in range(len(line)):
                left = int(line[x - channels]) if x >= channels else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + int(above[x])) // 2
                else:
                    corner = int(above[x - channels]) if x >= channels else 0
                    p = left + int(above[x]) - corner
                    guess = min((left, int(above[x]), corner), key=lambda v: abs(p - v))
                line[x] = (int(line[x]) + guess) & 255
        out[y] = line
    return out.reshape(h, w, 3)[:, :, ::-1] if channels == 3 else out


def write_png(image: np.ndarray) -> bytes:
    color = image.ndim == 3
    rows = (image[:, :, ::-1] if color else image).reshape(image.shape[0], -1)
    raw = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 2 if color else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def header(data: bytes) -> list[tuple[int, int]]:
    """(width, height) of every frame, from headers alone: PNG, BMP, JPEG and TIFF; empty if it is none of them."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return [struct.unpack(">II", data[16:24])]
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return [(w, abs(h))]
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return [(w, h)]
            at += 2 + size
        return []
    if data[:4] in (b"II*\0", b"MM\0*"):
        order = "<" if data[:2] == b"II" else ">"
        out, at, seen = [], struct.unpack(order + "I", data[4:8])[0], set()
        while at and at + 2 <= len(data) and at not in seen:
            seen.add(at)
            (n,) = struct.unpack(order + "H", data[at : at + 2])
            tags = {}
            for k in range(n):
                entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
                if len(entry) < 12:
                    return out
                tag, kind = struct.unpack(order + "HH", entry[:4])
                tags[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
            out.append((tags.get(256, 0), tags.get(257, 0)))
            end = at + 2 + 12 * n
            at = struct.unpack(order + "I", data[end : end + 4])[0] if end + 4 <= len(data) else 0
        return out
    return []


def gray(image: np.ndarray) -> np.ndarray:
    if image is None or image.size == 0:
        raise ValueError("the image is empty")
    if image.ndim == 2:
        return image
    return np.rint(image[:, :, :3].astype(float) @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    """The threshold with the largest variance between the classes (first one, if several)."""
    h = np.bincount(gray(image).ravel(), minlength=256).astype(float)
    below, total = np.cumsum(h), h.sum()
    mean = np.cumsum(h * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * below / total - mean) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def ink(image: np.ndarray) -> np.ndarray:
    """True where the page is dark."""
    g = gray(image)
    return g <= otsu(g)


def label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Connected components (8 neighbours): runs of each row are united with those of the row above."""
    labels = np.zeros(mask.shape, np.int64)
    parent = [0]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    for y in range(mask.shape[0]):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask[y].astype(np.int8), [0]))))
        runs, k = [], 0
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            while k < len(above) and above[k][1] < a:
                k += 1
            own, j = 0, k
            while j < len(above) and above[j][0] <= b:
                root = find(above[j][2])
                if own:
                    parent[max(own, root)] = min(own, root)
                own = min(own, root) if own else root
                j += 1
            if not own:
                own = len(parent)
                parent.append(own)
            labels[y, a:b] = own
            runs.append((a, b, own))
        above = runs
    roots = np.array([find(i) for i in range(len(parent))])
    used, number = np.unique(roots, return_inverse=True)
    return number[labels], len(used) - 1


def components(image: np.ndarray, least: int = LEAST_COMPONENT) -> list[dict]:
    """Ink components of at least `least` pixels: box, area, centroid."""
    labels, n = label(ink(image))
    y, x = np.nonzero(labels)
    k = labels[y, x]
    area = np.bincount(k, minlength=n + 1)
    out = []
    order = np.argsort(k, kind="stable")
    begin = np.searchsorted(k[order], np.arange(1, n + 2))
    for i in range(1, n + 1):
        if area[i] >= least:
            at = order[begin[i - 1] : begin[i]]
            ys, xs = y[at], x[at]
            out.append({"x": int(xs.min()), "y": int(ys.min()), "w": int(np.ptp(xs)) + 1, "h": int(np.ptp(ys)) + 1, "area": int(area[i]), "cx": float(xs.mean()), "cy": float(ys.mean())})
    return out


def dilate(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    """Dilation by a rectangle, through prefix sums along each axis."""
    for axis, size in ((1, width), (0, height)):
        half = size // 2
        pad = [(0, 0), (0, 0)]
        pad[axis] = (half + 1, half)
        sums = np.cumsum(np.pad(mask.astype(np.int32), pad), axis)
        n = mask.shape[axis]
        mask = np.take(sums, np.arange(size, size + n), axis) - np.take(sums, np.arange(0, n), axis) > 0
    return mask


def region_boxes(image: np.ndarray, least: int = LEAST_REGION) -> list[tuple[int, int, int, int]]:
    mask = ink(image)
    for _ in range(DILATIONS):
        mask = dilate(mask, *DILATE)
    labels, n = label(mask)
    out = []
    for i in range(1, n + 1):
        ys, xs = np.nonzero(labels == i)
        box = (int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1)
        if box[2] * box[3] >= least:
            out.append(box)
    return out


def rotate(image: np.ndarray, angle: float, fill: int = 0) -> np.ndarray:
    """Rotation about the centre by degrees, counter-clockwise, nearest pixel."""
    h, w = image.shape[:2]
    t = np.deg2rad(angle)
    y, x = np.mgrid[0:h, 0:w]
    dx, dy = x - w / 2, y - h / 2
    sx = np.rint(np.cos(t) * dx - np.sin(t) * dy + w / 2).astype(int)
    sy = np.rint(np.sin(t) * dx + np.cos(t) * dy + h / 2).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full_like(image, fill)
    out[inside] = image[sy[inside], sx[inside]]
    return out


def skew(image: np.ndarray) -> float:
    """Angle that makes rows sharpest: the largest variance of ink per row, on a copy of bounded width; the first best wins."""
    g = gray(image)
    if g.shape[1] > SKEW_WIDTH:
        rows = np.linspace(0, g.shape[0], max(1, g.shape[0] * SKEW_WIDTH // g.shape[1]) + 1).astype(int)
        cols = np.linspace(0, g.shape[1], SKEW_WIDTH + 1).astype(int)
        sums = np.add.reduceat(np.add.reduceat(g.astype(float), rows[:-1], 0), cols[:-1], 1)
        g = np.rint(sums / (np.diff(rows)[:, None] * np.diff(cols)[None])).astype(np.uint8)
    mask, best = ink(g).astype(np.uint8), (-1.0, 0.0)
    for k in range(int(2 * SKEW_RANGE / SKEW_STEP) + 1):
        angle = -SKEW_RANGE + k * SKEW_STEP
        score = float(rotate(mask, angle).sum(1).astype(float).var())
        if score > best[0]:
            best = (score, angle)
    return best[1]


def deskew(image: np.ndarray) -> np.ndarray:
    angle = skew(image)
    return image if abs(angle) < 1e-6 else rotate(image, angle, int(np.median(image)))


def auto_crop(image: np.ndarray, dark: float = DARK, most: float = MOST_TRIM) -> np.ndarray:
    """Cuts dark lines from the top, bottom, left and right, in that order, at most a share of each dimension a side."""
    g = gray(image)
    h, w = g.shape
    top, bottom, left, right = 0, h, 0, w

    def dark_run(lines: np.ndarray, limit: int) -> int:
        bright = np.flatnonzero(lines.mean(1) >= dark)
        return min(int(bright[0]) if len(bright) else len(lines), limit, max(len(lines) - 1, 0))

    top = dark_run(g, int(h * most))
    bottom = h - dark_run(g[top:][::-1], int(h * most))
    left = dark_run(g[top:bottom].T, int(w * most))
    right = w - dark_run(g[top:bottom, left:].T[::-1], int(w * most))
    return image[top:bottom, left:right]


def quality(image: np.ndarray) -> float:
    """Mean of clipped sharpness (variance of the Laplacian, mirrored borders) and contrast, 4 places."""
    g = gray(image).astype(float)
    p = np.pad(g, 1, mode="reflect" if min(g.shape) > 1 else "edge")
    laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    return round((min(laplacian.var() / SHARP, 1.0) + min(g.std() / CONTRAST, 1.0)) / 2, 4)


STEPS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"gray": gray, "deskew": deskew, "auto_crop": auto_crop}


def preprocess(image: np.ndarray, steps: list[str], extra: dict[str, Callable[[np.ndarray], np.ndarray]] | None = None) -> tuple[np.ndarray, float]:
    """(processed raster, quality of the raster before the steps); an unknown step is an error."""
    known = STEPS | (extra or {})
    if unknown := [s for s in steps if s not in known]:
        raise ValueError(f"unknown steps: {unknown}")
    score, out = quality(image), gray(image)
    for s in steps:
        out = known[s](out)
    return out, score

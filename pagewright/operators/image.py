"""Page images as (page_id, h, w, data): 8-bit rows of grey, or of BGR where ``channels`` is 3. Kernels in numpy, one pass
per page through ``mapInPandas``.

Definitions, since several libraries differ: a border is replicated for median, adaptive threshold and rotation, mirrored
without its edge for bilateral and CLAHE; out-of-image pixels never win in dilation and erosion; components are 8-connected;
the skew angle is that of the smallest rectangle around the ink, folded to within 45 degrees. A page that can't hold
h * w * channels bytes is an error; an empty table gives an empty one.

Kernels that need wide numbers work in strips of STRIP_PIXELS with as many rows around them as they look at, so beside the page
and its result they hold as much for a long page as for a short one; the result is that of one strip, bit by bit.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.operators.histogram import odd

#: Pages of more pixels than this are refused.
MOST_PIXELS = 400_000_000
#: Bytes of pixels of a batch that a kernel gives back (with a page more at most).
OUT_BYTES = 4 << 20
#: Pixels that a kernel works on at once.
STRIP_PIXELS = 1 << 19
#: Places of a row or column of which one product of matrices gives the weighed sums; pixels that rotation and equalisation work
#: on at once (what they hold of these fits a processor's cache).
BAND, SMALL_STRIP = 64, 1 << 14
#: Sides of the tiles that are turned at once: by an angle that allows only smaller ones each pixel is looked up by itself.
LEAST_SIDE, MOST_SIDE = 6, 60
#: Pixels of tiles that are turned at once (the numbers kept for them fit a processor's cache about).
TILES_PIXELS = 1 << 15
#: Weights of five pixels in a row for a place z from the middle one, within -1 to 1, as sums of 1, z, z ** 2, z ** 3, z * |z|, |z| ** 3:
#: cubic interpolation (a = -0.75) between the first four below 0, between the last four above.
CUBIC = np.array([(0, 0, -3, -3, 3, 3), (0, -6, 12, 2, 0, -8), (8, 0, -18, 0, 0, 10), (0, 6, 12, -2, 0, -8), (0, 0, -3, 3, -3, 3)], np.float32) / np.float32(8)
#: What single precision sums of such weights are off by at most, for values within -128 to 127 (bound of the rounding errors: 0.0022).
UNSURE = 1 / 400


def to_gray(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    if image.ndim != 3 or image.shape[2] != 3:
        raise ValueError(f"neither grey nor BGR: {image.shape}")
    b, g, r = (image[..., i].astype(np.int64) for i in range(3))
    return ((r * 299 + g * 587 + b * 114 + 500) // 1000).astype(np.uint8)


def _middle(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def _strips(h: int, w: int, part: Callable[[int, int], np.ndarray], most: int | None = None) -> np.ndarray:
    """An image of h x w of what part(first, end) makes of its rows, of ``most`` pixels at once."""
    out = np.empty((h, w), np.uint8)
    step = max(1, min(STRIP_PIXELS, most or STRIP_PIXELS) // max(1, w))
    for y in range(0, h, step):
        out[y : y + step] = part(y, min(h, y + step))
    return out


def _mirrored(at: np.ndarray, n: int) -> np.ndarray:
    """Places beyond 0 to n - 1 mirrored without the edge (in turns, where they are far beyond)."""
    at = np.abs(at) % max(1, 2 * (n - 1))
    return np.where(at < n, at, 2 * (n - 1) - at)


def _doubled(at: np.ndarray, n: int) -> np.ndarray:
    """Places beyond 0 to n - 1 mirrored with the edge."""
    at = at % (2 * n)
    return np.where(at < n, at, 2 * n - 1 - at)


def median(image: np.ndarray, size: int = 3) -> np.ndarray:
    """The middle value of each window of size x size."""
    size = odd(size)
    if size == 1 or not image.size:
        return image.copy()
    return _strips(*image.shape, lambda y, end: _median_3(image, y, end)) if size == 3 else _median_sliding(image, size)


def _median_3(image: np.ndarray, y: int, end: int) -> np.ndarray:
    # the middle of 9: of the columns' least the greatest, of their middles the middle, of their greatest the least; of these
    # three the middle
    held = np.pad(image[np.clip(np.arange(y - 1, end + 1), 0, len(image) - 1)], ((0, 0), (1, 1)), mode="edge")
    columns = held[:-2], held[1:-1], held[2:]
    least, most = np.minimum.reduce(columns), np.maximum.reduce(columns)
    across = lambda x: (x[:, :-2], x[:, 1:-1], x[:, 2:])
    return _middle(np.maximum.reduce(across(least)), _middle(*across(_middle(*columns))), np.minimum.reduce(across(most)))


def _median_sliding(image: np.ndarray, size: int) -> np.ndarray:
    """By histograms of columns that slide down, a row in and a row out, in 16 coarse bins of 16 fine ones. Sums along the row give
    the histogram of each window; the coarse bin that holds the middle is found first, then the value in it. Work and memory
    don't depend on the size of the window."""
    h, w = image.shape
    reach, wide = size // 2, w + size - 1
    columns, every = np.clip(np.arange(-reach, w + reach), 0, w - 1), np.arange(wide)
    fine, sums = np.zeros((256, wide), np.int32), np.zeros((256, wide + 1), np.int32)
    coarse, across = np.zeros((16, wide), np.int32), np.zeros((16, wide + 1), np.int32)
    middle, out, x = size * size // 2, np.empty_like(image), np.arange(w)

    def slide(row: int, by: int) -> None:
        values = image[min(max(row, 0), h - 1)][columns]
        fine[values, every] += by
        coarse[values >> 4, every] += by

    for row in range(-reach, reach):
        slide(row, 1)
    for y in range(h):
        slide(y + reach, 1)
        np.cumsum(coarse, axis=1, out=across[:, 1:])
        upto = np.cumsum(across[:, size:] - across[:, :-size], axis=0)
        bin_ = (upto <= middle).sum(0)
        rest = middle - np.where(bin_ > 0, upto[np.maximum(bin_ - 1, 0), x], 0)
        for k in np.unique(bin_):  # of the fine bins only those of a coarse one that holds a middle
            np.cumsum(fine[16 * k : 16 * k + 16], axis=1, out=sums[16 * k : 16 * k + 16, 1:])
        upto = np.zeros(w, np.int32)
        value = bin_ * 16
        cell = bin_ * (16 * (wide + 1)) + x
        flat = sums.ravel()
        for _ in range(15):
            upto += flat[cell + size] - flat[cell]
            cell += wide + 1
            value += upto <= rest
        out[y] = value
        slide(y - reach, -1)
    return out


def bilateral(image: np.ndarray, size: int = 3, sigma_value: float = 75.0, sigma_place: float = 75.0) -> np.ndarray:
    """Means of round windows, weighed by distance and by difference."""
    size = odd(size)
    reach = size // 2
    h, w = image.shape
    beyond = _mirrored if min(image.shape) > reach else _doubled
    columns = beyond(np.arange(-reach, w + reach), w)
    alike = np.exp(-(np.arange(256.0) ** 2) / (2 * sigma_value**2))
    near = [(dy, dx, math.exp(-(dy**2 + dx**2) / (2 * sigma_place**2))) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if dy**2 + dx**2 <= reach**2]

    def part(y: int, end: int) -> np.ndarray:
        held = image[beyond(np.arange(y - reach, end + reach), h)][:, columns].astype(np.int16)
        centre = held[reach : reach + end - y, reach : reach + w]
        total, weights = np.zeros(centre.shape), np.zeros(centre.shape)
        for dy, dx, g in near:
            other = held[reach + dy : reach + dy + end - y, reach + dx : reach + dx + w]
            weight = g * alike[np.abs(other - centre)]
            total += weight * other
            weights += weight
        return np.rint(total / weights).astype(np.uint8)

    return _strips(h, w, part)


def clahe(image: np.ndarray, clip: float = 2.0, grid: tuple[int, int] = (8, 8)) -> np.ndarray:
    """Histogram equalisation by tiles (across, down) with clipped histograms, blended bilinearly."""
    across, down = grid
    h, w = image.shape
    pad_h, pad_w = -h % down, -w % across
    whole = np.pad(image, ((0, pad_h), (0, pad_w)), mode="reflect" if h > pad_h and w > pad_w else "symmetric")
    th, tw = whole.shape[0] // down, whole.shape[1] // across
    tiles = whole.reshape(down, th, across, tw).transpose(0, 2, 1, 3).reshape(down * across, th * tw)
    counts = np.stack([np.bincount(t, minlength=256) for t in tiles])
    limit = max(1, int(clip * th * tw / 256)) if clip > 0 else th * tw
    excess = np.maximum(counts - limit, 0).sum(1)
    counts = np.minimum(counts, limit) + (excess // 256)[:, None]
    for row, left in zip(counts, excess % 256, strict=True):  # the rest in even steps
        if left:
            row[np.arange(left) * max(256 // left, 1)] += 1
    tables = np.clip(np.rint(counts.cumsum(1) * (255 / (th * tw))), 0, 255).reshape(down, across, 256)

    def corners(n: int, size: int, tiles_: int):
        place = (np.arange(n) + 0.5) / size - 0.5
        low = np.floor(place).astype(int)
        return np.clip(low, 0, tiles_ - 1), np.clip(low + 1, 0, tiles_ - 1), place - low

    y0, y1, fy = corners(h, th, down)
    x0, x1, fx = corners(w, tw, across)

    flat, left, right = tables.ravel(), x0 * 256, x1 * 256

    def part(y: int, end: int) -> np.ndarray:
        value, row, back = image[y:end].astype(np.intp), across * 256, 1 - fx
        from_left, from_right, places = value + left, value + right, np.empty_like(value)
        at = lambda side, ys: flat.take(np.add(side, (ys[y:end] * row)[:, None], out=places))

        def blended(ys: np.ndarray) -> np.ndarray:
            a, b = at(from_left, ys), at(from_right, ys)
            a *= back
            b *= fx
            a += b
            return a

        top, low = blended(y0), blended(y1)
        top *= (1 - fy)[y:end, None]
        low *= fy[y:end, None]
        top += low
        return np.clip(np.rint(top, out=top), 0, 255, out=top).astype(np.uint8)

    return _strips(h, w, part, SMALL_STRIP)


def adaptive_threshold(image: np.ndarray, block: int = 35, offset: float = 11.0) -> np.ndarray:
    """255 where a pixel is above its Gaussian neighbourhood's mean less an offset, else 0."""
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    weight = np.exp(-((np.arange(block) - block // 2) ** 2) / (2 * sigma**2))
    weight /= weight.sum()
    h, w = image.shape
    reach = block // 2

    band = np.zeros((BAND, BAND + block - 1))  # sums of BAND places at once are a product of matrices
    for i in range(BAND):
        band[i, i : i + block] = weight

    def part(y: int, end: int) -> np.ndarray:
        n = end - y
        mean = image[np.clip(np.arange(y - reach, end + reach), 0, h - 1)].astype(np.float64)
        down = np.empty((n, w + 2 * reach))
        for i in range(0, n, BAND):
            k = min(BAND, n - i)
            np.matmul(band[:k, : k + block - 1], mean[i : i + k + block - 1], out=down[i : i + k, reach : reach + w])
        down[:, :reach], down[:, reach + w :] = down[:, reach : reach + 1], down[:, reach + w - 1 : reach + w]
        mean = np.empty((n, w))
        for i in range(0, w, BAND):
            k = min(BAND, w - i)
            np.matmul(down[:, i : i + k + block - 1], band[:k, : k + block - 1].T, out=mean[:, i : i + k])
        np.rint(mean, out=mean)
        mean -= offset
        return (image[y:end] > mean) * np.uint8(255)

    return _strips(h, w, part)


def otsu(image: np.ndarray) -> int:
    flat = image.ravel()
    n = sum((np.bincount(flat[i : i + SMALL_STRIP], minlength=256) for i in range(0, len(flat), SMALL_STRIP)), np.zeros(256))
    below, mass = n.cumsum(), (n * np.arange(256)).cumsum()
    rest = below[-1] - below
    spread = mass * below[-1] - mass[-1] * below
    with np.errstate(divide="ignore", invalid="ignore"):
        variance = np.where((below > 0) & (rest > 0), spread**2 / (below * rest), -1.0)
    if variance.max() < 0:
        return int(image.flat[0]) if image.size else 0
    return int(variance.argmax())


def ensure_binary(image: np.ndarray, few: int = 4) -> np.ndarray:
    if len(np.unique(image)) <= few:
        return image
    return np.where(image > otsu(image), 255, 0).astype(np.uint8)


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of (x, y) points, of each row of ink only its ends."""
    points = points[np.lexsort((points[:, 1], points[:, 0]))]

    def half(own):
        out: list = []
        for p in own:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    plain = points.tolist()
    return np.array(half(plain)[:-1] + half(plain[::-1])[:-1], float)


def _bulging(x: np.ndarray, y: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Of points row by row those that can be corners of the hull to their left: without ones on or right of a line between the
    points before and after. What some rounds leave is to be told one by one."""
    for _ in range(rounds):
        out = (x[1:-1] - x[:-2]) * (y[2:] - y[:-2]) < (x[2:] - x[:-2]) * (y[1:-1] - y[:-2])
        if out.all():
            break
        kept = np.r_[True, out, True]
        x, y = x[kept], y[kept]
    return x, y


def _least_rectangle(hull: np.ndarray) -> float:
    """The angle of the smallest rectangle around a hull: all edges are measured at once, the best then one by one."""
    edges = np.roll(hull, -1, 0) - hull
    along = edges / np.hypot(*edges.T)[:, None]
    areas = np.concatenate([np.ptp(hull @ a.T, 0) * np.ptp(hull @ np.stack([-a[:, 1], a[:, 0]]), 0) for a in np.split(along, range(64, len(along), 64))])
    best = (math.inf, 0.0)
    for x, y in edges[areas <= areas.min() * (1 + 1e-6)]:
        angle = math.atan2(y, x)
        c, s = math.cos(angle), math.sin(angle)
        u, v = hull @ (c, s), hull @ (-s, c)
        best = min(best, ((u.max() - u.min()) * (v.max() - v.min()), angle))
    return best[1]


def skew(image: np.ndarray, least_ink: int = 500) -> float | None:
    """Degrees, counter-clockwise positive as seen with y downwards, within (-45, 45]; None with too little ink."""
    ink = image < 255
    if np.count_nonzero(ink) < least_ink:
        return None
    rows = np.flatnonzero(ink.any(1))
    first = last = np.zeros(0, np.int64)
    step = max(1, STRIP_PIXELS // image.shape[1])
    for i in range(0, len(rows), step):  # of rows with ink
        own = ink[rows[i : i + step]]
        first, last = np.r_[first, own.argmax(1)], np.r_[last, own.shape[1] - 1 - own[:, ::-1].argmax(1)]
    (first, low), (last, high) = _bulging(first, rows), _bulging(-last, rows)
    ends = np.unique(np.stack([np.r_[first, -last], np.r_[low, high]], 1), axis=0)
    hull = _hull(ends)
    if len(hull) < 3:
        return 0.0 if len(rows) == 1 else None
    degrees = math.degrees(_least_rectangle(hull)) % 90
    return degrees - 90 if degrees > 45 else degrees


def _turner(held: np.ndarray, h: int, w: int, edge: int, c: float, s: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """What is at places (x, y) from the centre of the turned image. held: the image with 4 rows and ``edge`` columns around."""

    def weights(f):
        a = -0.75
        near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
        far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
        return far(f + 1), near(f), near(1 - f), far(2 - f)

    # what a pixel reads lies in the image or is one of its edges: so places are cut off to 2 beyond, where all is edge
    wide, flat = w + 2 * edge, held.ravel()

    def at_places(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        sx, sy = c * x - s * y + w // 2, s * x + c * y + h // 2
        x0, y0 = np.floor(sx), np.floor(sy)
        wx, wy = weights(sx - x0), weights(sy - y0)
        at = (np.clip(y0, -3, h + 1) + 3) * wide + (np.clip(x0, -3, w + 1) + (edge - 1))
        at = at.astype(np.intp)
        out, row, term = np.zeros(sx.shape), np.empty(sx.shape), np.empty(sx.shape)
        for j in range(4):
            for i in range(4):
                np.multiply(wx[i], flat[j * wide + i :].take(at), out=term if i else row)
                if i:
                    row += term
            row *= wy[j]
            out += row
        return np.clip(np.rint(out, out=out), 0, 255, out=out).astype(np.uint8)

    return at_places


def rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    """Rotated about (w // 2, h // 2), counter-clockwise positive; cubic interpolation (a = -0.75).

    By small angles in tiles: within one, places are off by less than a pixel from where a shift would have them, so five rows and
    columns beside each other have what each pixel reads, and its weights come from its place by one product of matrices. These
    sums are single precision; what is within UNSURE of the middle between two values is done again in double precision."""
    h, w = image.shape
    if not image.size:
        return image.copy()
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    side = int(min(MOST_SIDE, 1 / (abs(s) + 1 - c + 1e-9)))
    if side < LEAST_SIDE:
        at_places, x = _turner(np.pad(image, 4, mode="edge"), h, w, 4, c, s), np.arange(w, dtype=float) - w // 2
        return _strips(h, w, lambda y, end: at_places(x, np.arange(y, end, dtype=float)[:, None] - h // 2), SMALL_STRIP)

    nx = -(-w // side)
    tw = -(-w // nx)
    pw, most = tw + 4, min(STRIP_PIXELS, TILES_PIXELS)
    ny = -(-h // max(min(side, 4), min(side, most // (nx * pw))))
    th = -(-h // ny)
    held = np.pad(image, ((4, 4), (pw, pw)), mode="edge")
    wide, at_places = w + 2 * pw, _turner(held, h, w, pw, c, s)
    x, y = np.arange(nx) * tw - w // 2, np.arange(ny)[:, None] * th - h // 2
    columns, rows = np.arange(tw), np.arange(th)[:, None]

    def placed(first: np.ndarray, across: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, ...]:
        """first: where the tiles' first pixels are read; across, down: how far their others are off. The tiles' least places as
        whole numbers, what these leave less 1, and how far pixels are beyond."""
        first = first + (across.min() + down.min())
        whole = np.floor(first)
        return (whole.astype(np.intp), *(f.astype(np.float32) for f in (first - whole - 1, across - across.min(), down - down.min())))

    x0, *right = placed(c * x - s * y + w // 2, (c - 1) * columns, -s * rows)
    y0, *below = placed(s * x + c * y + h // 2, s * columns, (c - 1) * rows)
    x0 = np.clip(x0 - 1, -pw, w) + pw
    windows = np.ndarray(((h + 8) * wide - pw + 1,), f"V{pw}", held, strides=(1,))

    step = max(1, min(ny, most // (nx * pw * th)))
    n = step * nx * pw * th
    own, sums, row = np.empty(n + (4 * step * nx + 1) * pw, np.float32), np.empty((6, n), np.float32), np.empty((2, 5, n), np.float32)
    own[-pw:], sums[0] = 0, 1
    out, unsure = np.empty((h, w), np.uint8), []

    def settle() -> None:
        at, tiles, first = (np.concatenate([u[i] for u in unsure]) for i in range(3))
        at, column = at // pw, at % pw
        line, tile = at // tiles, at % tiles
        ys, xs = (first + tile // nx) * th + line, tile % nx * tw + column
        inside = (column < tw) & (xs < w) & (ys < h)
        ys, xs = ys[inside], xs[inside]
        out[ys, xs] = at_places((xs - w // 2).astype(float), (ys - h // 2).astype(float))
        unsure.clear()

    for first in range(0, ny, step):
        k = min(step, ny - first)
        tiles = k * nx
        n = th * tiles * pw
        at = np.clip(np.arange(-1, th + 3)[:, None] + y0[first : first + k].ravel(), -4, h + 3)
        at += 4
        at *= wide
        at += x0[first : first + k].ravel()
        part = own[: (th + 4) * tiles * pw]
        part[:] = windows[at.ravel()].view(np.uint8)
        part -= 128  # halves what sums can be off by
        powers = sums[:, :n]
        z, z2, z3, zz, zzz = powers[1:]
        for weights, (rest, across, down) in ((row[0], right), (row[1], below)):
            line = np.zeros((tiles, pw), np.float32)
            np.add(rest[first : first + k].reshape(-1, 1), across, out=line[:, :tw])
            np.add(down, line.ravel(), out=z.reshape(th, -1))
            np.multiply(z, z, out=z2)
            np.abs(z, out=zzz)
            np.multiply(z, z2, out=z3)
            np.multiply(z, zzz, out=zz)
            zzz *= z2
            np.matmul(CUBIC, powers, out=weights[:, :n])
        for i in range(5):
            reads = np.ndarray((5, n), np.float32, own, offset=4 * i, strides=(4 * tiles * pw, 4))
            np.einsum("jn,jn->n", row[1, :, :n], reads, out=sums[1 + i, :n])
        total, nearest = row[1, 0, :n], row[1, 1, :n]
        np.einsum("in,in->n", row[0, :, :n], sums[1:, :n], out=total)
        np.rint(total, out=nearest)
        total -= nearest
        np.abs(total, out=total)
        at = np.flatnonzero(total > 0.5 - UNSURE)
        nearest += 128
        np.clip(nearest, 0, 255, out=nearest)
        done = nearest.astype(np.uint8).reshape(th, k, nx, pw)[..., :tw].transpose(1, 0, 2, 3)
        out[first * th : (first + k) * th] = done.reshape(k * th, nx * tw)[: h - first * th, :w]
        unsure.append((at, np.full(len(at), tiles), np.full(len(at), first)))
        if first + k == ny or sum(len(u[0]) for u in unsure) > SMALL_STRIP:
            settle()
    return out


def deskew(image: np.ndarray, least_angle: float = 0.1) -> np.ndarray:
    angle = skew((image > otsu(image)) * np.uint8(255))
    return image if angle is None or abs(angle) < least_angle else rotate(image, angle)


def _slide(image: np.ndarray, size: int, axis: int, least: bool) -> np.ndarray:
    pad = [(0, 0), (0, 0)]
    pad[axis] = (size // 2, size - 1 - size // 2)
    best = np.minimum if least else np.maximum
    held, wide = np.moveaxis(np.pad(image, pad, constant_values=255 if least else 0), axis, 0), 1
    while 2 * wide <= size:  # each cell stands for the next ones, twice as many each time
        held, wide = best(held[:-wide], held[wide:]), 2 * wide
    if wide < size:
        held = best(held[: wide - size], held[size - wide :])
    return np.ascontiguousarray(np.moveaxis(held, 0, axis))


def dilate(image: np.ndarray, kx: int, ky: int, times: int = 1) -> np.ndarray:
    for _ in range(times):
        image = _slide(_slide(image, kx, 1, False), ky, 0, False)
    return image


def erode(image: np.ndarray, kx: int, ky: int, times: int = 1) -> np.ndarray:
    for _ in range(times):
        image = _slide(_slide(image, kx, 1, True), ky, 0, True)
    return image


@dataclass(frozen=True)
class Runs:
    """The runs of a mask, row by row: row, first and last column, and the piece that each belongs to, by the number of the
    piece's first run."""

    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    piece: np.ndarray

    def before(self, row: np.ndarray, column: np.ndarray, wide: int) -> np.ndarray:
        """The pieces whose runs end just before places (there have to be such)."""
        return self.piece[np.searchsorted(self.row * wide + self.last, row * wide + column - 1)]


def _runs(mask: np.ndarray, diagonal: bool) -> Runs:
    """Runs, joined with those that they touch in the row above: sorted runs, so what touches one is a range of others; pieces are made one
    link after the other for all runs at once, the later root pointing to the earlier."""
    wide = mask.shape[1] + 2
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    reach, above = (1 if diagonal else 0), (row - 1) * wide
    low = np.searchsorted(row * wide + last, above + np.maximum(first - reach, 0))
    high = np.searchsorted(row * wide + first, above + np.minimum(last + reach, wide - 2), "right")
    n = np.maximum(high - low, 0)
    mine = np.repeat(np.arange(len(row)), n)
    theirs = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    root = np.arange(len(row))
    while len(mine):
        a, b = root[mine], root[theirs]
        apart = a != b
        mine, theirs, a, b = mine[apart], theirs[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return Runs(row, first, last, root)


def contours(mask: np.ndarray) -> list[tuple[tuple[int, int, int, int], int | None]]:
    """(box, parent) of 8-connected components, by first pixel. parent: the place of the component in whose hole one lies, None
    outside of all.

    Ground (4-connected, with a border around) to the left of a component's first pixel is what the component lies in; the component
    to the left of that ground's first pixel is what the ground lies in."""
    if not mask.any():
        return []
    held = np.pad(mask, 1)
    wide = held.shape[1] + 2
    ink, ground = _runs(held, True), _runs(~held, False)
    pieces, at = np.unique(ink.piece, return_inverse=True)
    order = np.argsort(at, kind="stable")
    start = np.r_[0, np.flatnonzero(np.diff(at[order])) + 1]
    of = lambda f, values: f.reduceat(values[order], start)
    x, y = of(np.minimum, ink.first), ink.row[pieces]
    w, h = of(np.maximum, ink.last) - x + 1, of(np.maximum, ink.row) - y + 1
    hole = ground.before(ink.row[pieces], ink.first[pieces], wide)
    inside = hole != ground.piece[0]
    parent = np.full(len(pieces), -1)
    parent[inside] = np.searchsorted(pieces, ink.before(ground.row[hole[inside]], ground.first[hole[inside]], wide))
    boxes = np.stack([x - 1, y - 1, w, h], 1).tolist()
    return [(tuple(b), None if p < 0 else p) for b, p in zip(boxes, parent.tolist(), strict=True)]


def components(mask: np.ndarray, outer_only: bool = True) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) of 8-connected components, by first pixel; without those inside another's hole."""
    return [box for box, parent in contours(mask) if parent is None or not outer_only]


def regions(image: np.ndarray, least_area: int = 5000, least_side: int = 30) -> list[tuple[int, int, int, int]]:
    """Boxes of text regions: ink of a binarised page, spread twice and shrunk once, by connected pieces."""
    ink = 255 - ensure_binary(image)
    kx, ky = max(15, image.shape[1] // 60), max(5, image.shape[0] // 200)
    spread = erode(dilate(ink, kx, ky, 2), kx, ky, 1)
    return [b for b in components(spread > 0) if b[2] * b[3] >= least_area and min(b[2:]) >= least_side]


def crop(image: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    x, y, w, h = box
    return image[y : y + h, x : x + w]


def overlay(image: np.ndarray, of_regions: list[tuple[int, int, int, int]], lines: list[tuple[int, int, int, int]]) -> np.ndarray:
    """BGR page with regions framed in green (2 pixels) and lines in blue (1)."""
    if image.ndim != 2:
        raise ValueError("an overlay needs a grey page")
    out = np.repeat(image[..., None], 3, 2)
    for boxes, colour, wide in ((of_regions, (0, 255, 0), 2), (lines, (255, 0, 0), 1)):
        for x, y, w, h in boxes:
            part = out[max(0, y) : y + h, max(0, x) : x + w]
            for side in (part[:wide], part[-wide:], part[:, :wide], part[:, -wide:]):
                side[...] = colour
    return out


def resize(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """Box average to a smaller size, nearest to a larger one; colours each for itself."""
    if image.ndim == 3:
        return np.stack([resize(image[..., i], w, h) for i in range(image.shape[2])], 2)
    ys, xs = np.linspace(0, image.shape[0], h + 1), np.linspace(0, image.shape[1], w + 1)
    y0, x0 = ys[:-1].astype(int), xs[:-1].astype(int)
    y1, x1 = np.maximum(y0 + 1, ys[1:].astype(int)), np.maximum(x0 + 1, xs[1:].astype(int))
    total = np.pad(image.astype(np.float64), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    cell = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
    return np.rint(cell / ((y1 - y0)[:, None] * (x1 - x0)[None, :])).astype(np.uint8)


def png(image: np.ndarray) -> bytes:
    """A PNG of a grey or BGR image."""
    colour = image.ndim == 3
    rows = image[..., ::-1] if colour else image
    raw = b"".join(b"\x00" + r.tobytes() for r in np.ascontiguousarray(rows))
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    head = image.shape[1].to_bytes(4, "big") + image.shape[0].to_bytes(4, "big") + bytes((8, 2 if colour else 0, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def _unfiltered(data: np.ndarray, n: int) -> np.ndarray:
    """Rows of PNG samples without their filters. data: (h, 1 + row), the filter first; n: bytes from a sample to the next
    one of its kind. Where a sample depends on the one to its left, all rows go on side by side, each a step behind the one
    above."""
    kinds, rows = data[:, 0], data[:, 1:].astype(np.int32)
    h, wide = rows.shape
    if kinds.max(initial=0) > 4:
        raise RuntimeError("an unknown PNG filter")
    out = np.zeros((h + 1, wide + n), np.int32)  # a row above and a sample to the left of zeros
    if (kinds <= 2).all():
        for y in range(h):
            if kinds[y] == 1:
                out[y + 1, n:] = rows[y].reshape(-1, n).cumsum(0).ravel() & 255
            else:
                out[y + 1, n:] = (rows[y] + (out[y, n:] if kinds[y] == 2 else 0)) & 255
        return out[1:, n:].astype(np.uint8)
    steps = wide // n
    part = np.arange(n)
    for t in range(h + steps - 1):
        y = np.arange(max(0, t - steps + 1), min(h, t + 1))
        x = ((t - y) * n)[:, None] + part
        here = y[:, None]
        a, b, c = out[here + 1, x], out[here, x + n], out[here, x]
        da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        near = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
        guess = np.choose(kinds[y][:, None], (0, a, b, (a + b) // 2, near))
        out[here + 1, x + n] = (rows[here, x] + guess) & 255
    return out[1:, n:].astype(np.uint8)


def decode_png(raw: bytes) -> np.ndarray:
    """A PNG that isn't interlaced as grey or BGR: samples of 1 to 16 bits (of 16 the upper 8), palettes; no transparency."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise RuntimeError("not a PNG image")
    at, body, head, palette = 8, [], b"", b""
    while at < len(raw):
        size, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        part = raw[at + 8 : at + 8 + size]
        head, palette = part if kind == b"IHDR" else head, part if kind == b"PLTE" else palette
        if kind == b"IDAT":
            body.append(part)
        at += 12 + size
    w, h, depth, colour = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), *head[8:10]
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if n is None or head[12] or w * h > MOST_PIXELS or depth not in ((1, 2, 4, 8) if colour == 3 else (1, 2, 4, 8, 16) if colour == 0 else (8, 16)):
        raise RuntimeError("a PNG image of a kind that isn't read")
    wide = -(-w * n * depth // 8)
    own = _unfiltered(np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + wide), max(1, n * depth // 8))
    if depth == 16:
        own = own[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(own, axis=1).reshape(h, -1, depth)[:, :w]
        own = (bits * (1 << np.arange(depth)[::-1])).sum(2).astype(np.uint8)
        own = own if colour == 3 else own * np.uint8(255 // ((1 << depth) - 1))
    if colour == 3:
        return np.frombuffer(palette, np.uint8).reshape(-1, 3)[own[:, :w]][..., ::-1]
    image = own.reshape(h, w, n)
    return image[..., 0] if n < 3 else image[..., :3][..., ::-1]


def decode(raw: bytes) -> np.ndarray:
    """An image file as grey or BGR: PNG here, other kinds by an imaging library where one is installed."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_png(raw)
    try:
        import io

        from PIL import Image
    except ImportError as error:
        raise RuntimeError("only PNG images are read without Pillow") from error
    found = Image.open(io.BytesIO(raw))
    return np.asarray(found) if found.mode == "L" else np.asarray(found.convert("RGB"))[..., ::-1]


@dataclass(frozen=True)
class Preprocessing:
    grayscale: bool = True
    denoise: str | None = "median"
    denoise_size: int = 3
    clahe: bool = True
    clip_limit: float = 2.0
    grid: tuple[int, int] = (8, 8)
    binarize: str | None = "adaptive"
    deskew: bool = False
    extra: dict = field(default_factory=dict)


def preprocess(image: np.ndarray, config: Preprocessing = Preprocessing()) -> np.ndarray:  # noqa: B008  frozen
    """The chain of filters. Without ``grayscale`` a coloured page keeps its colours through denoising, colour by colour;
    what follows needs grey."""
    image = np.clip(image, 0, 255).astype(np.uint8)
    if config.grayscale:
        image = to_gray(image)
    if config.denoise:
        if config.denoise not in ("median", "bilateral"):
            raise ValueError(f"no such denoising: {config.denoise}")
        kernel = median if config.denoise == "median" else bilateral
        image = kernel(image, config.denoise_size) if image.ndim == 2 else np.stack([kernel(image[..., i], config.denoise_size) for i in range(image.shape[2])], 2)
    image = to_gray(image)
    if config.clahe:
        image = clahe(image, config.clip_limit, config.grid)
    if config.binarize == "adaptive":
        image = adaptive_threshold(image)
    elif config.binarize == "otsu":
        image = np.where(image > otsu(image), 255, 0).astype(np.uint8)
    elif config.binarize:
        raise ValueError(f"no such binarisation: {config.binarize}")
    return deskew(image) if config.deskew else image


def pixels_of(h: int, w: int, data: bytes, channels: int = 1) -> np.ndarray:
    if h * w > MOST_PIXELS or len(data) != h * w * channels:
        raise ValueError(f"a page of {h} x {w} x {channels} has {len(data)} bytes")
    image = np.frombuffer(data, np.uint8)
    return image.reshape(h, w) if channels == 1 else image.reshape(h, w, channels)


def in_batches(pages: Iterator[tuple], of_id: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, h, w, data) in batches that end as soon as they have OUT_BYTES of pixels."""
    kinds = {"page_id": of_id, "h": pa.int32(), "w": pa.int32(), "data": pa.binary()}

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))

    held, size = [], 0
    for page in pages:
        held.append(page)
        size += len(page[3])
        if size >= OUT_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def map_pages(pages: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], file: str | None = None, read: Callable[..., np.ndarray] = decode) -> DataFrame:
    """pages (page_id, h, w, data) through a kernel: the whole chain in one pass, an image at a time. file: a column of image files
    that are taken, in their colours, in place of the pixels where there is one; read: what makes an image of such a file."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:

            def turned(part: pa.RecordBatch = part) -> Iterator[tuple]:
                files = part.column(file) if file else repeat(pa.scalar(None))
                for page_id, h, w, data, own in zip(*(part.column(c) for c in ("page_id", "h", "w", "data")), files, strict=False):
                    image = kernel(pixels_of(h.as_py(), w.as_py(), data.as_buffer()) if not own.is_valid else read(own.as_py()))
                    yield page_id, *image.shape[:2], image.tobytes()

            yield from in_batches(turned(), part.schema.field("page_id").type)

    return pages.select("page_id", "h", "w", "data", *filter(None, [file])).mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, h int, w int, data binary")


def map_boxes(pages: DataFrame, kernel: Callable[[np.ndarray], list[tuple[int, int, int, int]]]) -> DataFrame:
    """(page_id, x, y, w, h): the boxes that a kernel finds on each page."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for page in part.itertuples(index=False):
                boxes = kernel(pixels_of(page.h, page.w, page.data))
                yield pd.DataFrame([(page.page_id, *b) for b in boxes], columns=["page_id", "x", "y", "w", "h"])

    return pages.select("page_id", "h", "w", "data").mapInPandas(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, x int, y int, w int, h int")


def map_numbers(pages: DataFrame, kernel: Callable[[np.ndarray], float | None], name: str) -> DataFrame:
    """(page_id, <name>): a number for each page."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [kernel(pixels_of(p.h, p.w, p.data)) for p in part.itertuples(index=False)]
            yield pd.DataFrame({"page_id": part["page_id"], name: pd.Series(found, dtype="float64")})

    return pages.select("page_id", "h", "w", "data").mapInPandas(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, {name} double")


def decoded(files: DataFrame, *carried: str) -> DataFrame:
    """(page_id, h, w, data) of image files (page_id, content), in grey; with columns to carry along, those and the content."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for f in part.itertuples(index=False):
                image = to_gray(decode(bytes(f.content)))
                rest = {c: [getattr(f, c)] for c in ("content", *carried)} if carried else {}
                yield pd.DataFrame({"page_id": [f.page_id], "h": [image.shape[0]], "w": [image.shape[1]], "data": [image.tobytes()], **rest})

    kind = lambda c: f"{c} {files.schema[c].dataType.simpleString()}"
    rest = "".join(f", {kind(c)}" for c in ("content", *carried)) if carried else ""
    return files.select("page_id", "content", *carried).mapInPandas(run, f"{kind('page_id')}, h int, w int, data binary{rest}")

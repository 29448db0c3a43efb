"""What is found on one page, where its pixels are: regions in reading order, their text lines, crops.

The same rules as the table operators in ``layout``, for a page at a time, so that pixels never become rows and no page
image is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from pagewright.operators import image

Box = tuple[int, int, int, int]


@dataclass(frozen=True)
class Detection:
    reading_order: str = "single_column"
    min_region_area: int = 5000
    segment_lines: bool = False


def ordered(boxes: list[Box], two_columns: bool, width: int) -> list[Box]:
    """By (y, x), on two-column pages the left column first; a centre on the middle belongs to the right."""
    right = lambda b: two_columns and b[0] + b[2] / 2 >= width / 2
    return sorted(boxes, key=lambda b: (right(b), b[1], b[0]))


def line_spans(ink: np.ndarray, reach: int = 4, share: float = 60, least: float = 5.0, least_rows: int = 10, gap: int = 3) -> list[tuple[int, int]]:
    """(first, end) of the text lines of a profile of ink by row."""
    if not len(ink):
        return []
    held = np.pad(ink.astype(np.float64), reach, mode="reflect") if len(ink) > reach else ink[_mirrored(np.arange(-reach, len(ink) + reach), len(ink))].astype(np.float64)
    smooth = np.convolve(held, np.full(2 * reach + 1, 1 / (2 * reach + 1)), "valid")
    on = smooth >= max(least, float(np.percentile(smooth, share))) - 1e-9
    edges = np.flatnonzero(np.diff(np.r_[False, on, False].astype(np.int8)))
    found: list[tuple[int, int]] = []
    for first, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if end - first < least_rows:
            continue
        if found and first - found[-1][1] <= gap:
            found[-1] = found[-1][0], end
        else:
            found.append((first, end))
    return found


def _mirrored(i: np.ndarray, n: int) -> np.ndarray:
    at = i % max(1, 2 * (n - 1))
    return np.where(at < n, at, 2 * (n - 1) - at)


def detect(page: np.ndarray, config: Detection = Detection()) -> list[tuple[Box, list[Box]]]:  # noqa: B008  frozen
    """Regions in reading order, each with its text lines (none without line segmentation)."""
    boxes = ordered(image.regions(page, config.min_region_area), config.reading_order == "two_column", page.shape[1])
    if not config.segment_lines:
        return [(b, []) for b in boxes]
    ink = image.ensure_binary(page) < 255
    return [((x, y, w, h), [(x, y + first, w, end - first) for first, end in line_spans(ink[y : y + h, x : x + w].sum(1))]) for x, y, w, h in boxes]


def tight(crop: np.ndarray, ink: int = 128, before: int = 4, after: int = 5, least_h: int = 20, least_w: int = 10, least_columns: int = 5) -> np.ndarray | None:
    """A crop cut to its inked columns and a margin; None where it is too small or holds too little ink to be read."""
    if crop.shape[0] < least_h or crop.shape[1] < least_w:
        return None
    columns = np.flatnonzero((crop < ink).any(0))
    if len(columns) < least_columns:
        return None
    cut = crop[:, max(0, int(columns[0]) - before) : int(columns[-1]) + after]
    return cut if cut.shape[1] >= least_w else None

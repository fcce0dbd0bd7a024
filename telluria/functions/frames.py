"""Array forms of the frame-heavy scores, shared by batch slices and streams.

Each works on consecutive rows; ``NaN`` stands for a missing value.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np

from telluria import params

_BLOCK = 2048  # frames held at once
_WIDE = 256  # half frames beyond which a running order is quicker


def _frames(line: np.ndarray, size: int, a: int, b: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(line[a:b + size - 1], size)


def _lead(history: np.ndarray, rows: int) -> np.ndarray:
    """The last ``rows - 1`` earlier values, filled up in front."""
    kept = history[-(rows - 1):] if rows > 1 else history[:0]
    return np.concatenate([np.full(rows - 1 - len(kept), np.nan), kept])


def trailing_scores(history: np.ndarray, values: np.ndarray, rows: int, min_rows: int) -> np.ndarray:
    """Modified z of each value against the last ``rows`` values with it."""
    line = np.concatenate([_lead(history, rows), values])
    out = np.zeros(len(values))
    for a in range(0, len(values), _BLOCK):
        b = min(a + _BLOCK, len(values))
        ordered = np.sort(_frames(line, rows, a, b), axis=1)  # missing values go last
        k = np.sum(~np.isnan(ordered), axis=1)
        at = np.arange(b - a)
        low, high = np.maximum(k - 1, 0) // 2, np.minimum(k // 2, rows - 1)
        med = (ordered[at, low] + ordered[at, high]) / 2
        dev = np.abs(ordered - med[:, None])
        if (k == rows).all():
            dev.partition(sorted({(rows - 1) // 2, rows // 2}), axis=1)
        else:
            dev.sort(axis=1)
        mad = (dev[at, low] + dev[at, high]) / 2
        ok = (k >= min_rows) & (mad > params.MAD_FLOOR)
        out[a:b][ok] = params.MAD_SCALE * np.abs(values[a:b][ok] - med[ok]) / mad[ok]
    return out


def trailing_moments(history: np.ndarray, values: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and population std of the last ``rows`` values with each one;
    equal values have no spread, however their mean is rounded."""
    line = np.concatenate([_lead(history, rows), values])
    out = np.zeros((3, len(values)))
    for a in range(0, len(values), _BLOCK):
        b = min(a + _BLOCK, len(values))
        frame = _frames(line, rows, a, b)
        there = ~np.isnan(frame)
        n = there.sum(axis=1)
        mean = np.where(there, frame, 0.0).sum(axis=1) / np.maximum(n, 1)
        gap = np.where(there, frame - mean[:, None], 0.0)
        even = np.fmax.reduce(frame, axis=1) == np.fmin.reduce(frame, axis=1)
        out[:, a:b] = n, mean, np.where(even, 0.0, np.sqrt(np.einsum("ij,ij->i", gap, gap) / np.maximum(n, 1)))
    return out[0], out[1], out[2]


def centred_medians(before: np.ndarray, values: np.ndarray, after: np.ndarray, half: int) -> np.ndarray:
    """Median over ``half`` rows to either side; the caller pads the ends."""
    line = np.concatenate([before[len(before) - half:], values, after[:half]])
    out = np.empty(len(values))
    if half > _WIDE and not np.isnan(line).any():  # one value enters an ordered window and one leaves
        numbers = line.tolist()
        ordered = sorted(numbers[:2 * half + 1])
        for i in range(len(values)):
            if i:
                del ordered[bisect_left(ordered, numbers[i - 1])]
                insort(ordered, numbers[i + 2 * half])
            out[i] = ordered[half]
        return out
    block = max(1, min(_BLOCK, (_BLOCK << 10) // (2 * half + 1)))
    for a in range(0, len(values), block):
        b = min(a + block, len(values))
        out[a:b] = np.partition(_frames(line, 2 * half + 1, a, b), half, axis=1)[:, half]
    return out


def trailing_distances(history: np.ndarray, points: np.ndarray, rows: int, min_rows: int):
    """Mean and 95th percentile of the distances from each point to the last
    ``rows`` points with it; NaN below ``min_rows``."""
    lines = [np.concatenate([_lead(history[:, i], rows), points[:, i]]) for i in range(3)]
    mean, p95 = np.full(len(points), np.nan), np.full(len(points), np.nan)
    for a in range(0, len(points), _BLOCK):
        b = min(a + _BLOCK, len(points))
        total = 0.0
        for i, line in enumerate(lines):
            gap = _frames(line, rows, a, b) - points[a:b, i, None]
            total = total + gap * gap
        d = np.sort(np.sqrt(total), axis=1)
        k = np.sum(~np.isnan(d), axis=1)
        at = np.arange(b - a)
        place = np.maximum(k - 1, 0) * 0.95
        low = np.floor(place).astype(int)
        high = np.minimum(low + 1, np.maximum(k - 1, 0))
        ok = k >= min_rows
        mean[a:b][ok] = np.nansum(d, axis=1)[ok] / k[ok]
        p95[a:b][ok] = (d[at, low] + (place - low) * (d[at, high] - d[at, low]))[ok]
    return mean, p95

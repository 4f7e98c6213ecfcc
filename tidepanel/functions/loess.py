"""Local linear smoothing on an evenly spaced axis (Cleveland et al. 1990), vectorised.

Inside the series every window is the same symmetric tricube kernel, so smoothing is a
convolution; only the rows near the two ends need windows of their own.
"""

from __future__ import annotations

import math

import numpy as np

#: Cells of the arrays that windows at the ends are smoothed with at one time.
SLICE_CELLS = 1 << 20
#: Windows of so many rows are smoothed by transforms and moments, at a cost that does not depend on them.
LONG_KERNEL = 512


def tricube(distance: np.ndarray, reach: np.ndarray | float) -> np.ndarray:
    """Weights by distance; practically 1 at the centre and 0 at the rim of the window."""
    ratio = np.abs(distance) / reach
    weight = (1.0 - np.minimum(ratio, 1.0) ** 3) ** 3
    return np.where(ratio <= 0.001, 1.0, np.where(ratio <= 0.999, weight, 0.0))


def _weighted_line(distance, weight, values, spread):
    """Value at distance 0 of the weighted line; the weighted mean where there is no spread."""
    s0 = weight.sum(axis=-1)
    s1 = (weight * distance).sum(axis=-1)
    s2 = (weight * distance**2).sum(axis=-1)
    t0 = (weight * values).sum(axis=-1)
    t1 = (weight * distance * values).sum(axis=-1)
    return _combine(s0, s1, s2, t0, t1, spread)


def _combine(s0, s1, s2, t0, t1, spread):
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = t0 / s0
        variance = s2 / s0 - (s1 / s0) ** 2
        slope = (t1 / s0 - mean * s1 / s0) / variance
        line = mean - slope * s1 / s0
        fitted = np.where(np.sqrt(np.maximum(variance, 0.0)) > 0.001 * spread, line, mean)
    return np.where(s0 > 0, fitted, np.nan)


def smooth_at(
    values: np.ndarray,
    places: np.ndarray,
    span: int,
    weights: np.ndarray | None = None,
    spread: float | None = None,
) -> np.ndarray:
    """Smoothed value at each integer place (which may lie just outside the series).

    ``spread`` is the length of the axis of the whole series: a line is fitted only where a
    window's rows are spread over more than a thousandth of it, else their mean is taken.
    """
    n = len(values)
    spread = max(n - 1, 1) if spread is None else spread
    width = min(span, n)
    step = max(1, SLICE_CELLS // max(width, 1))
    if len(places) > step:  # bounded memory however long the window
        slices = [places[i : i + step] for i in range(0, len(places), step)]
        return np.concatenate([smooth_at(values, part, span, weights, spread) for part in slices])
    left = np.clip(places - (span - 1) // 2, 0, n - width)
    index = left[:, None] + np.arange(width)[None, :]
    reach = np.maximum(places - left, left + width - 1 - places).astype(float)
    if span > n:
        reach = reach + (span - n) // 2
    distance = (index - places[:, None]).astype(float)
    weight = tricube(distance, np.maximum(reach, 1e-300)[:, None])
    if weights is not None:
        weight = weight * weights[index]
    fitted = _weighted_line(distance, weight, values[index], spread)
    inside = np.clip(places, 0, n - 1)
    return np.where(np.isnan(fitted), values[inside], fitted)


def _over(series: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sum of ``kernel`` times the rows under it, where it lies inside the series.

    Long kernels go by the fast Fourier transform: a window of a long season would cost its length
    for every row.
    """
    if len(kernel) < LONG_KERNEL:
        return np.convolve(series, kernel[::-1], "valid")
    size = 1 << (len(series) + len(kernel) - 2).bit_length()
    whole = np.fft.irfft(np.fft.rfft(series, size) * np.fft.rfft(kernel[::-1], size), size)
    return whole[len(kernel) - 1 : len(series)]


def _first_half(values: np.ndarray, span: int, weights: np.ndarray | None, spread: float) -> np.ndarray:
    """Smoothed values of the rows before the first symmetric window, all from the first ``span`` rows.

    Their window is the same but its reach h grows towards the end, so no convolution gives them. The
    kernel (1 - (d/h)^3)^3 is a polynomial in the distance: sums of powers of the positions up to each
    row, expanded about the row, give each window's sums, in time that does not depend on its length.
    """
    half = (span - 1) // 2
    places, position = np.arange(half), np.arange(span) / span
    here = places / span
    powers = position[None, :] ** np.arange(12)[:, None]

    def window_sums(series: np.ndarray, most: int) -> list[np.ndarray]:
        moments = np.cumsum(series[None, :] * powers, axis=1)
        before = np.concatenate([np.zeros((12, 1)), moments[:, : half - 1]], axis=1)
        behind = moments[:, -1:] - before

        def about(sums: np.ndarray, p: int) -> np.ndarray:
            return sum(math.comb(p, q) * (-here) ** (p - q) * sums[q] for q in range(p + 1))

        reach = (span - 1 - places) / span
        terms = {0: 1.0, 3: -3.0, 6: 3.0, 9: -1.0}
        return [
            sum(c * reach**-m * (about(behind, m + k) + (-1) ** m * about(before, m + k)) for m, c in terms.items())
            for k in range(most + 1)
        ]

    own = np.ones(span) if weights is None else weights[:span]
    fitted = _combine(*window_sums(own, 2), *window_sums(own * values[:span], 1), spread / span)
    return np.where(np.isnan(fitted), values[:half], fitted)


def smooth(
    values: np.ndarray,
    span: int,
    weights: np.ndarray | None = None,
    spread: float | None = None,
) -> np.ndarray:
    """Smoothed series; ``span`` (odd) is the number of rows in a window."""
    n = len(values)
    spread = max(n - 1, 1) if spread is None else spread
    half = (span - 1) // 2
    if n <= 2 * span:
        return smooth_at(values, np.arange(n), span, weights, spread)
    offsets = np.arange(-half, half + 1, dtype=float)
    kernel = tricube(offsets, float(half))
    inner = slice(half, n - half)
    out = np.empty(n)
    if weights is None:
        out[inner] = _over(values, kernel / kernel.sum())
    else:
        weighted = weights * values
        fitted = _combine(
            _over(weights, kernel),
            _over(weights, kernel * offsets),
            _over(weights, kernel * offsets**2),
            _over(weighted, kernel),
            _over(weighted, kernel * offsets),
            spread,
        )
        out[inner] = np.where(np.isnan(fitted), values[inner], fitted)
    if span >= LONG_KERNEL:
        back = None if weights is None else weights[::-1]
        out[:half] = _first_half(values, span, weights, spread)
        out[n - half :] = _first_half(values[::-1], span, back, spread)[::-1]
        return out
    ends = np.r_[np.arange(half), np.arange(n - half, n)]
    out[ends] = smooth_at(values, ends, span, weights, spread)
    return out


def moving_mean(values: np.ndarray, width: int) -> np.ndarray:
    total = np.cumsum(np.insert(values, 0, 0.0))
    return (total[width:] - total[:-width]) / width


def next_odd(number: float) -> int:
    up = int(np.ceil(number))
    return up if up % 2 else up + 1


def spans_for(period: int, seasonal: int = 7) -> tuple[int, int, int]:
    """Window lengths of the seasonal, trend and low-pass smoothers."""
    trend = next_odd(1.5 * period / (1.0 - 1.5 / seasonal))
    low_pass = next_odd(period + 1)
    return seasonal, trend, low_pass


def reach_per_round(period: int) -> int:
    """How far one inner round looks to either side of a row."""
    seasonal, trend, low_pass = spans_for(period)
    cycles = (seasonal - 1) // 2 * period
    return cycles + period + 1 + (low_pass - 1) // 2 + (trend - 1) // 2


def seasonal_trend(
    values: np.ndarray,
    period: int,
    rounds: int,
    trend: np.ndarray | None = None,
    weights: np.ndarray | None = None,
    offset: int = 0,
    total: int | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """``rounds`` inner rounds of the decomposition, from the given trend on.

    For a piece of a longer series give its first position and the length of the whole series.
    """
    n = len(values)
    total = n if total is None else total
    spread = max(total - 1, 1)
    seasonal_span, trend_span, low_span = spans_for(period)
    trend = np.zeros(n) if trend is None else trend
    season = np.zeros(n)
    for _ in range(rounds):
        detrended = values - trend
        extended = np.empty(n + 2 * period)
        for phase in range(period):
            part = detrended[phase::period]
            if not len(part):
                continue
            part_weights = None if weights is None else weights[phase::period]
            cycles = -(-(total - (offset + phase) % period) // period)
            wide = max(cycles - 1, 1)
            middle = smooth(part, seasonal_span, part_weights, wide)
            ends = np.array([-1, len(part)])
            outer = smooth_at(part, ends, seasonal_span, part_weights, wide)
            extended[phase::period][: len(part) + 2] = np.r_[outer[0], middle, outer[1]]
        low = moving_mean(moving_mean(moving_mean(extended, period), period), 3)
        season = extended[period : period + n] - smooth(low, low_span, None, spread)
        trend = smooth(values - season, trend_span, weights, spread)
    return season, trend

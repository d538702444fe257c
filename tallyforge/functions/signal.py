"""Small numpy helpers for one bounded window of a series. Rows are points, columns metrics."""

from __future__ import annotations

import math

import numpy as np

# --- outlier score and sampling ------------------------------------------------------


def outlier_scores(window: np.ndarray, pool: np.ndarray, draws: int, size: int, rng: np.random.Generator) -> np.ndarray:
    """Inverse mean, over ``draws`` random sets of ``size`` pool points, of the best similarity."""
    apart = np.sqrt(((window[:, None, :] - pool[None, :, :]) ** 2).sum(axis=-1))
    similar = 1.0 / (1.0 + apart)
    m, n = similar.shape
    size = min(size, n)
    picks = np.argpartition(rng.random((m * draws, n)), size - 1, axis=1)[:, :size].reshape(m, draws * size)
    best = np.take_along_axis(similar, picks, axis=1).reshape(m, draws, size).max(axis=2)
    return draws / best.sum(axis=1)


def confidence(scores: np.ndarray) -> np.ndarray:
    """Inverted outlier scores on [0, 1]: the calmer a point, the closer to 1."""
    calm = 1.0 / (scores + 1e-8)
    return (calm - calm.min()) / (calm.max() - calm.min() + 1e-8)


def sample_units(weights: np.ndarray, units: int, rng: np.random.Generator, scale: int = 2,
                 rho: float | None = None, sigma: float = 1 / 12) -> tuple[np.ndarray, np.ndarray]:
    """Sampling matrix (units x points, rows sum to one) and the centre point of each unit.

    The points share the unit interval by weight. A unit draws grid positions with a
    normal density around its centre, so it averages points near it, calm ones more.
    """
    n = len(weights)
    edges = np.concatenate([[0.0], np.cumsum(weights)])
    edges = edges / edges[-1] if edges[-1] > 0 else np.linspace(0.0, 1.0, n + 1)
    centres = rng.choice(n, size=units, replace=False)
    grid = np.arange(1, scale * n + 1) / (scale * n)
    owner = np.clip(np.searchsorted(edges, grid, side="left") - 1, 0, n - 1)
    rho = 1.0 / (math.sqrt(2 * math.pi) * sigma) if rho is None else rho
    apart = np.abs(edges[centres][:, None] - grid[None, :])
    drawn = (apart <= 3 * sigma) & (rng.random(apart.shape) < rho * np.exp(-0.5 * (apart / sigma) ** 2))
    matrix = np.zeros((units, n))
    matrix[np.arange(units), centres] = 1.0
    for unit in range(units):
        np.add.at(matrix[unit], owner[drawn[unit]], 1.0)
    return matrix / matrix.sum(axis=1, keepdims=True), centres


# --- reconstruction ------------------------------------------------------------------


def cosine_basis(n: int) -> np.ndarray:
    """Orthonormal cosine basis; column k is the k-th wave over n points."""
    i, k = np.arange(n)[:, None], np.arange(n)[None, :]
    basis = np.sqrt(2.0 / n) * np.cos(np.pi * (i + 0.5) * k / n)
    basis[:, 0] = math.sqrt(1.0 / n)
    return basis


def sparse_rebuild(n: int, at: np.ndarray, values: np.ndarray, rounds: int = 16) -> np.ndarray:
    """The n x d window with the least absolute sum of cosine coefficients that takes
    ``values`` at the points ``at``, found by reweighted least squares."""
    d = values.shape[1]
    in_time, across = cosine_basis(n), cosine_basis(d)
    equations = np.kron(across, in_time)[np.concatenate([at + n * j for j in range(d)])]
    target = values.T.ravel()
    weight = np.ones(n * d)
    coefficients = np.zeros(n * d)
    floor = 1.0
    for _ in range(rounds):
        scaled = equations * weight
        coefficients = weight * (equations.T @ np.linalg.lstsq(scaled @ equations.T, target, rcond=None)[0])
        floor = max(floor / 4, 1e-9)
        weight = np.sqrt(coefficients ** 2 + floor ** 2)
    return in_time @ coefficients.reshape(d, n).T @ across.T


def without_peaks(values: np.ndarray, share: float) -> np.ndarray:
    """Values within ``share`` of the largest magnitude replaced along a line."""
    size = np.abs(values)
    calm = size < size.max() * (1 - share)
    if not calm.any():
        return values.copy()
    where = np.arange(len(values))
    return np.where(calm, values, np.interp(where, where[calm], values[calm]))


def seasonal_parts(values: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal and residual part of an additive split with a centred moving mean."""
    n, half = len(values), period // 2
    kernel = np.ones(period) if period % 2 else np.concatenate([[0.5], np.ones(period - 1), [0.5]])
    trend = np.full(n, np.nan)
    trend[half:n - half] = np.convolve(values, kernel / period, mode="valid")
    detrended = values - trend
    phase = np.array([np.nanmean(detrended[i::period]) for i in range(period)])
    seasonal = np.resize(phase - phase.mean(), n)
    return seasonal, detrended - seasonal


def dominant_period(values: np.ndarray) -> int | None:
    """Period of the strongest positive frequency, or None when under 12 or over half the length."""
    n = len(values)
    power = np.abs(np.fft.rfft(values))[1:(n + 1) // 2]
    if not len(power):
        return None
    period = n // (int(power.argmax()) + 1)
    return period if 12 <= period <= n // 2 else None


def mode_rebuild(rows: np.ndarray, lag: int, share: float = 0.2) -> np.ndarray:
    """Metrics (rows) mapped ``lag`` points ahead by their leading dynamic modes.

    A group with a period of at most a tenth of its length learns the map from the
    seasonal part, with the residual taken out as a known input.
    """
    rank = min(3, rows.shape[0])
    period = dominant_period(rows[0])
    if period is None or period > rows.shape[1] // 10:
        base = np.array([without_peaks(r, share) for r in rows])
        before, after = base[:, :-lag], base[:, lag:]
        fallback = base
    else:
        split = [seasonal_parts(r, period) for r in rows]
        fallback = np.array([seasonal for seasonal, _ in split])
        rest = np.array([
            without_peaks(np.concatenate([r[period:2 * period], r[period:-period], r[-2 * period:-period]]), share)
            for _, r in split])
        base, before, after = rows, fallback[:, :-lag], rows[:, lag:] - rest[:, :-lag]
    try:
        u, s, vh = np.linalg.svd(before, full_matrices=False)
        inverse = 1.0 / np.where(s[:rank] == 0, 1e-8, s[:rank])
        across = after @ vh[:rank].T * inverse
        values, vectors = np.linalg.eig(u[:, :rank].T @ across)
        modes = across @ vectors
        step = (modes * values) @ np.linalg.pinv(modes)
        return step.real @ base
    except np.linalg.LinAlgError:
        return fallback


# --- shapes --------------------------------------------------------------------------


def cross_correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Correlation of two equally long series at every shift, over the product of their lengths."""
    n = len(x)
    length = np.linalg.norm(x) * np.linalg.norm(y)
    size = 1 << (2 * n - 1).bit_length()
    raw = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)
    full = np.concatenate([raw[size - n + 1:], raw[:n]])
    return full / length if length > 0 else np.zeros(2 * n - 1)


def shape_distance(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """1 - the best correlation, and y moved to where it is reached."""
    both = cross_correlation(x, y)
    best = int(both.argmax())
    shift = best + 1 - len(x)
    moved = np.zeros(len(y))
    if shift >= 0:
        moved[shift:] = y[:len(y) - shift]
    else:
        moved[:shift] = y[-shift:]
    return float(1.0 - both[best]), moved


def grouped_by_distance(distance: np.ndarray, threshold: float) -> np.ndarray:
    """Group number of each row of a distance matrix.

    The nearest pair is joined first; a join keeps the distances of its lower member and
    drops the other's, and only joins under the threshold count.
    """
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    n = len(d)
    trees = [(np.inf, [i]) for i in range(n)]  # (distance of the top join, groups under it)
    groups = [[[i]] for i in range(n)]
    members = [[i] for i in range(n)]
    root = 0
    for _ in range(n - 1):
        a, b = np.unravel_index(d.argmin(), d.shape)
        high, low = max(a, b), min(a, b)
        cost = d[high, low]
        members[low] = members[high] + members[low]
        groups[low] = [members[low]] if cost < threshold else groups[high] + groups[low]
        d[high, :] = np.inf
        d[:, high] = np.inf
        root = low
    out = np.zeros(n, dtype=int)
    for number, group in enumerate(sorted(sorted(g) for g in groups[root])):
        out[group] = number
    return out


def _standard(values: np.ndarray) -> np.ndarray:
    spread = values.std(ddof=1)
    return (values - values.mean()) / spread if spread > 0 else np.zeros_like(values)


def _centroid(members: np.ndarray, current: np.ndarray) -> np.ndarray:
    """Leading shape of a group after its members are moved onto the current centre."""
    if not len(members):
        return np.zeros_like(current)
    moved = members if not current.any() else np.array([shape_distance(current, m)[1] for m in members])
    z = np.array([_standard(m) for m in moved])
    # The leading direction of the centred scatter is the first right singular vector.
    lead = np.linalg.svd(z - z.mean(axis=1, keepdims=True), full_matrices=False)[2][0]
    if ((moved[0] - lead) ** 2).sum() >= ((moved[0] + lead) ** 2).sum():
        lead = -lead
    return _standard(lead)


def shape_clusters(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 100,
                   start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Group of each series and the centre of each group by shape distance."""
    group = rng.integers(0, k, size=len(rows)) if start is None else start
    centres = np.zeros((k, rows.shape[1]))
    for _ in range(rounds):
        centres = np.array([_centroid(rows[group == j], centres[j]) for j in range(k)])
        distance = np.array([[1.0 - cross_correlation(r, c).max() for c in centres] for r in rows])
        moved = distance.argmin(axis=1)
        if np.array_equal(moved, group):
            break
        group = moved
    return group, centres


# --- compression ---------------------------------------------------------------------


def key_points(rebuilt: np.ndarray, budget: int, apart: int = 5) -> np.ndarray:
    """Ends of a window and the points of strongest bend, ``apart`` from each other, per metric."""
    n = len(rebuilt)
    if n <= 2 or budget <= 2:
        return np.array(sorted({0, n - 1}))
    chosen: set[int] = set()
    for column in rebuilt.T:
        bend = np.zeros(n)
        bend[1:-1] = np.abs(np.diff(column, 2))
        picked = [0, n - 1]
        for i in np.argsort(-bend, kind="stable"):
            if len(picked) >= budget:
                break
            if all(abs(i - p) >= apart for p in picked):
                picked.append(int(i))
        chosen.update(picked)
    return np.array(sorted(chosen))


def cubic_through(x: np.ndarray, xp: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Cubic spline with not-a-knot ends; a line below four points."""
    n = len(xp)
    if n < 4:
        return np.interp(x, xp, fp)
    h, slope = np.diff(xp).astype(float), np.diff(fp) / np.diff(xp)
    system, right = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        system[i, i - 1:i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        right[i] = 6 * (slope[i] - slope[i - 1])
    system[0, :3] = h[1], -(h[0] + h[1]), h[0]
    system[-1, -3:] = h[-1], -(h[-1] + h[-2]), h[-2]
    second = np.linalg.solve(system, right)
    i = np.clip(np.searchsorted(xp, x, side="right") - 1, 0, n - 2)
    left, gap = x - xp[i], h[i]
    return (fp[i] + left * (slope[i] - gap * (2 * second[i] + second[i + 1]) / 6)
            + left ** 2 * second[i] / 2 + left ** 3 * (second[i + 1] - second[i]) / (6 * gap))

"""Recursive averages of many series at once: numpy steps from place to place, all series at a time.

An exponential mean is a scan of affine maps p -> (1 - k) p + k x. Maps of neighbouring values compose to one map again, so
a long series is cut into chunks whose maps are composed, each chunk's start is found from those before it, and all
chunks are walked at once. The same serves series that spread over tasks (operators/scans.py)."""

from __future__ import annotations

import numpy as np

WALK = 512  # values of a chunk of a long series
LONG = 4096  # values from which a series is cut into chunks; shorter ones are walked in one go, in the plain order


def weight(n: int) -> float:
    return 2.0 / (n + 1)


def _matrix(x: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Series as columns, one value a row, the rest 0."""
    out = np.zeros((int(lens.max(initial=0)), len(lens)))
    col = np.repeat(np.arange(len(lens)), lens)
    row = np.arange(len(col)) - np.repeat(np.cumsum(lens) - lens, lens)
    out[row, col] = x[np.repeat(starts, lens) + row]
    return out


def walked(m: np.ndarray, p: np.ndarray, k: float, first: int = 0) -> np.ndarray:
    """Each row of m, from `first` on, becomes row * k + p * (1 - k), p being the row before, or the given one."""
    p, rest = p.copy(), 1 - k
    for i in range(first, len(m)):
        p *= rest
        m[i] *= k
        p += m[i]
        m[i] = p
    return m


def composed(x: np.ndarray, k: float, cuts: np.ndarray) -> np.ndarray:
    """b of each chunk's map p -> (1 - k)^length p + b; empty chunks have 0."""
    lens = np.diff(cuts)
    out = walked(_matrix(x, cuts[:-1], lens), np.zeros(len(lens)), k)
    return np.where(lens > 0, out[np.maximum(lens, 1) - 1, np.arange(len(lens))], 0.0) if len(out) else np.zeros(len(lens))


def carried(x: np.ndarray, p: float, k: float, walk: int = WALK) -> np.ndarray:
    """x * k + p * (1 - k) from value to value of one series that comes after p."""
    if len(x) <= walk:
        return walked(x.astype(float).reshape(-1, 1), np.array([p]), k).ravel()
    cuts = np.append(np.arange(0, len(x), walk), len(x))
    b, start = composed(x, k, cuts), np.empty(len(cuts) - 1)
    a = (1 - k) ** np.diff(cuts)
    for j in range(len(start)):  # one step a chunk
        start[j] = p
        p = a[j] * p + b[j]
    lens = np.diff(cuts)
    return walked(_matrix(x, cuts[:-1], lens), start, k).T[np.arange(walk) < lens[:, None]]


def onward(x: np.ndarray, starts: np.ndarray, lens: np.ndarray, p: np.ndarray, k: float) -> np.ndarray:
    """x * k + p * (1 - k) from value to value of the series x[starts[j]:starts[j] + lens[j]], each after its own p; NaN
    where no series lies."""
    out = np.full(len(x), np.nan)
    size = np.ceil(np.log2(np.maximum(lens, 1)))  # series of about one length are walked together
    for e in np.unique(size[(lens > 0) & (lens <= LONG)]):
        some = np.flatnonzero((lens > 0) & (size == e))
        sizes = lens[some]
        m = walked(_matrix(x, starts[some], sizes), p[some], k)
        row = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(starts[some], sizes) + row] = m[row, np.repeat(np.arange(len(some)), sizes)]
    for j in np.flatnonzero(lens > LONG):
        out[starts[j] : starts[j] + lens[j]] = carried(x[starts[j] : starts[j] + lens[j]], p[j], k)
    return out


def ema(x: np.ndarray, cuts: np.ndarray, n: int) -> np.ndarray:
    """Exponential means of the series x[cuts[j]:cuts[j + 1]]: NaN before place n - 1, there the plain mean of the first n
    values, then x * k + p * (1 - k) with k = 2 / (n + 1)."""
    out, lens, k = np.full(len(x), np.nan), np.diff(cuts), weight(n)
    size = np.ceil(np.log2(np.maximum(lens, 1)))  # series of about one length are walked together
    for e in np.unique(size[(lens >= n) & (lens <= LONG)]):
        some = np.flatnonzero((lens >= n) & (size == e))
        starts, sizes = cuts[:-1][some], lens[some]
        m = _matrix(x, starts, sizes)
        seed = np.zeros(len(some))
        for i in range(n):
            seed += m[i]
        m[: n - 1], m[n - 1] = np.nan, seed / n
        m = walked(m, m[n - 1], k, n)
        row = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(starts, sizes) + row] = m[row, np.repeat(np.arange(len(some)), sizes)]
    for j in np.flatnonzero(lens > LONG):
        a, b = cuts[j], cuts[j + 1]
        out[a + n - 1] = x[a : a + n].sum() / n
        out[a + n : b] = carried(x[a + n : b], out[a + n - 1], k)
    return out


def ema_dense(x: np.ndarray, cuts: np.ndarray, n: int) -> np.ndarray:
    """ema of each series' values that aren't NaN, set right against the series' end."""
    real = ~np.isnan(x)
    count = np.add.reduceat(np.append(real, False).astype(np.int64), cuts[:-1]) * (np.diff(cuts) > 0) if len(cuts) > 1 else np.zeros(0, np.int64)
    dense = np.append(0, np.cumsum(count))
    out = np.full(len(x), np.nan)
    at = np.repeat(cuts[1:] - dense[1:], count) + np.arange(dense[-1])
    out[at] = ema(x[real], dense, n)
    return out


def steps(c: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The change since the value before, 0 for a series' first."""
    out = np.diff(c, prepend=0.0)
    out[cuts[:-1][np.diff(cuts) > 0]] = 0.0
    return out


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """100 * a / b, NaN where b is 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b == 0, np.nan, 100 * a / b)


def tsi(c: np.ndarray, cuts: np.ndarray, fast: int = 10, slow: int = 30, signal: int = 8) -> tuple[np.ndarray, np.ndarray]:
    step = steps(c, cuts)
    t = ratio(ema_dense(ema(step, cuts, fast), cuts, slow), ema_dense(ema(np.abs(step), cuts, fast), cuts, slow))
    return t, ema_dense(t, cuts, signal)


def rsi(c: np.ndarray, cuts: np.ndarray, n: int = 35) -> np.ndarray:
    step = steps(c, cuts)
    up, down = ema(np.maximum(step, 0.0), cuts, n), ema(np.maximum(-step, 0.0), cuts, n)
    return ratio(up, up + down)


def streak(ok: np.ndarray, cuts: np.ndarray, cap: int) -> np.ndarray:
    """How many places in a row, this one the last, ok has held; at most cap."""
    at = np.arange(len(ok))
    bad = np.where(ok, -1, at)
    first = cuts[:-1][np.diff(cuts) > 0]
    bad[first] = np.maximum(bad[first], first - 1)
    return np.minimum(cap, at - np.maximum.accumulate(bad)) if len(ok) else at


def trailing(x: np.ndarray, n: int) -> np.ndarray:
    """The sum of the last n values at each place, added from the oldest on; of all so far at the first places."""
    out = np.zeros(len(x))
    for k in range(min(n, len(x)) - 1, -1, -1):
        out[k:] += x[: len(x) - k]
    return out


def _sums(x: np.ndarray, full: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray | int]:
    """The sum and the number of the last n values that are there; NaN before place n - 1 and where none is."""
    count = n if full.all() else trailing(full.astype(float), n)
    with np.errstate(invalid="ignore"):
        return np.where((place >= n - 1) & (count > 0), trailing(np.where(full, x, 0.0), n), np.nan), count


def mesh(c: np.ndarray, full: np.ndarray, place: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """Means of the last bars for each length, the largest and the least of them, and whether the first is above the last.
    full: where there is a value; place: a value's place in its series. As indicators.mesh, to the last bit."""
    means = []
    for n in lengths:
        total, count = _sums(c, full, place, n)
        means.append(total / np.maximum(count, 1))
    none = np.isnan(means[-1])
    ends = [np.where(none, np.nan, f.reduce(means)) for f in (np.fmax, np.fmin)]
    return [*means, *ends, means[0] > means[-1]]


def ultimate(bp: np.ndarray, tr: np.ndarray, full: tuple[np.ndarray, np.ndarray], place: np.ndarray, lengths: tuple[int, int, int] = (7, 14, 28), signal: int = 8) -> list[np.ndarray]:
    """u and u_sig of indicators.ultimate, to the last bit. bp, tr: buying pressure and true range."""
    legs = []
    for n in lengths:
        a, b = _sums(bp, full[0], place, n)[0], _sums(tr, full[1], place, n)[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            legs.append(np.where(b != 0, a / b, np.nan))
    u = (legs[0] * 4 + legs[1] * 2 + legs[2]) * 100 / 7
    # u begins late enough in a series for a frame that reaches into the one before to hold a NaN
    return [u, np.where(place >= signal - 1, trailing(u, signal) / signal, np.nan)]

"""NumPy kernels for what Catalyst lacks, and their Arrow UDFs: special functions, Poisson-lognormal, bounded optimisers, HMMs."""

from __future__ import annotations

import ctypes
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_erfc = np.frompyfunc(math.erfc, 1, 1)
_exp = np.frompyfunc(math.exp, 1, 1)
_log = np.frompyfunc(math.log, 1, 1)


def _c_lgamma():
    """The C library's, which databases use too: paths of equal likelihood differ by the last bits alone. Python's own where it isn't found."""
    try:
        f = ctypes.CDLL("libm.so.6").lgamma
    except (OSError, AttributeError):
        return math.lgamma
    f.restype, f.argtypes = ctypes.c_double, [ctypes.c_double]
    return f


_lgamma = np.frompyfunc(_c_lgamma(), 1, 1)


def _by_value(f, x):
    """``f`` of each of ``x``, called once for each value."""
    x = np.asarray(x, float)
    if x.size < 64:
        return np.asarray(f(x), float)
    values, back = np.unique(x, return_inverse=True)
    return np.asarray(f(values), float)[back.reshape(x.shape)]


def lgamma(x):
    return _by_value(_lgamma, x)


# special functions


def log_ndtr(x):
    """ln of the standard normal's distribution function; an asymptotic series in the lower tail."""
    x = np.asarray(x, float)
    low = x < -20
    y = np.where(low, x, -20.0)
    tail = -0.5 * y * y - np.log(-y) - 0.5 * math.log(2 * math.pi) + np.log1p(-1 / y**2 + 3 / y**4)
    with np.errstate(divide="ignore"):
        body = np.log(0.5 * np.asarray(_erfc(-np.where(low, 0, x) / math.sqrt(2)), float))
    return np.where(low, tail, body)


def log1mexp(x):
    """ln(1 - exp(-x)) for x > 0."""
    x = np.asarray(x, float)
    with np.errstate(divide="ignore"):
        return np.where(x > math.log(2), np.log1p(-np.exp(-x)), np.log(-np.expm1(-x)))


def pnorm_range_log(low, high, mu, sigma):
    """ln P(low <= N(mu, sigma) <= high); with sigma 0 it is 0 or -inf."""
    low, high, mu, sigma = np.broadcast_arrays(*[np.asarray(v, float) for v in (low, high, mu, sigma)])
    s = np.where(sigma > 0, sigma, 1)
    a, b = (low - mu) / s, (high - mu) / s
    flip = a > 0  # work in the lower tail
    a, b = np.where(flip, -b, a), np.where(flip, -a, b)
    lb, la = log_ndtr(b), log_ndtr(a)
    with np.errstate(invalid="ignore"):
        spread = lb + log1mexp(np.maximum(lb - la, 1e-300))
    point = np.where((mu >= low) & (mu <= high), 0.0, -np.inf)
    return np.where(sigma > 0, spread, point)


def incomplete_beta(a, b, x):
    """Regularised incomplete beta by Lentz's continued fraction, elementwise."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out / a


def welch_p(n1, m1, v1, n2, m2, v2) -> float:
    """two-sided p of Welch's t from sizes, means and variances; 1 if a size is at most 1."""
    if min(n1, n2) <= 1:
        return 1.0
    s1, s2 = v1 / n1, v2 / n2
    if s1 + s2 == 0:
        return 1.0 if m1 == m2 else 0.0
    t2 = (m1 - m2) ** 2 / (s1 + s2)
    df = (s1 + s2) ** 2 / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1))
    return incomplete_beta(df / 2, 0.5, df / (df + t2))


# Poisson-lognormal


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def poilog_logpmf(x, mu, sig, n_points: int = 256):
    """ln of the Poisson-lognormal pmf by a trapezoid around the integrand's mode; a probability of 0 becomes 1e-15."""
    x, mu, sig = (np.asarray(v, float).ravel() for v in np.broadcast_arrays(x, mu, sig))
    if (sig <= 0).any() or (x < 0).any():
        raise ValueError("sig must be positive and x not negative")
    # equal rows are found by a hash of theirs and counted once, unless two others share a hash
    bits = [np.ascontiguousarray(v).view(np.uint64) for v in (x, mu, sig)]
    _, first, back = np.unique(_mix(_mix(_mix(bits[0]) + bits[1]) + bits[2]), return_index=True, return_inverse=True)
    if len(first) == len(x) or any((v[first][back] != v).any() for v in (x, mu, sig)):
        first = back = slice(None)
    out = _poilog(x[first], mu[first], sig[first], n_points)[0]
    # a pmf that underflows to 0 counts as 1e-15
    return np.where(out < LOG_LEAST, math.log(1e-15), out)[back]


#: ln of the least positive double.
LOG_LEAST = math.log(5e-324)


def _range(x, m, v):
    """Of x z - exp(z) - (z - m)^2 / 2v the mode, exp(mode), and how far on either side it falls by a factor of 1e12, by Newton's steps from a bound that they don't cross."""
    drop = math.log(1e12)
    # w = v exp(z) solves w + ln w = level
    level = m + x * v + np.log(v)
    y = np.where(level > 1, np.log(np.maximum(level, 1)), level)
    for _ in range(7):
        w = np.exp(y)
        y -= (y + w - level) / (1 + w)
    rate = np.exp(y) / v
    with np.errstate(divide="ignore", over="ignore"):
        t = np.sqrt(2 * drop / (rate + 1 / v))
        t = np.minimum(t, np.log1p(drop / rate + t))
        s = np.fmin(np.sqrt(2 * drop * v), (drop + np.sqrt(drop * drop + 8 * drop * rate)) / (2 * rate))
    for _ in range(5):
        e = np.expm1(np.minimum(t, 700))
        t -= (rate * (e - t) + t * t / (2 * v) - drop) / (rate * e + t / v)
        e = np.expm1(-s)
        s -= (rate * (e + s) + s * s / (2 * v) - drop) / (s / v - rate * e)
    return y - np.log(v), rate, s, t


def _poilog(x, m, s, n_points, moments: bool = False):
    """ln of the pmf of each row, without a floor; with ``moments`` also the means of (z - m)^1 to ^4, z the logarithm of the rate, given x."""
    out, mean = np.empty(len(x)), np.empty((len(x) if moments else 0, 4))
    k = np.arange(n_points)
    powers, base = np.stack([np.ones(n_points), k, k * k]), np.stack([(k / (n_points - 1)) ** j for j in range(5)], 1)
    parts = -(-n_points // 16)
    step = max(64, 65_536 // n_points)
    for c in range(0, len(x), 4096):
        x_, m_ = x[c : c + 4096], m[c : c + 4096]
        v = s[c : c + 4096] ** 2
        z, rate, left, right = _range(x_, m_, v)
        slope, gap = x_ - (z - m_) / v, (left + right) / (n_points - 1)
        line = np.stack([rate - slope * left - left * left / (2 * v), (slope + left / v) * gap, -gap * gap / (2 * v)], 1)
        # exp(z) on an even grid is a product of powers
        fine, coarse = np.exp(np.minimum(gap[:, None] * np.arange(16), 700)), rate[:, None] * np.exp(np.minimum(16 * gap[:, None] * np.arange(parts) - left[:, None], 700))
        area = np.empty(len(x_))
        for i in range(0, len(x_), step):
            j = slice(i, i + step)
            y = line[j] @ powers
            y -= (coarse[j, :, None] * fine[j, None, :]).reshape(len(y), -1)[:, :n_points]
            np.exp(y, out=y)
            area[j] = y.sum(1) - (y[:, 0] + y[:, -1]) / 2
            if moments:
                got = y @ base
                got /= got[:, :1]
                low, wide = (z - m_ - left)[j], (left + right)[j]
                for p in range(1, 5):
                    mean[c + i : c + i + len(y), p - 1] = sum(math.comb(p, q) * low ** (p - q) * wide**q * got[:, q] for q in range(p + 1))
        with np.errstate(divide="ignore"):
            out[c : c + 4096] = np.log(area * gap) + x_ * z - rate - (z - m_) ** 2 / (2 * v) - lgamma(x_ + 1) - 0.5 * np.log(2 * math.pi * v)
    return out, mean


def l_lnpois(y, lam, d, mu, sig, phi=1.0) -> float:
    """F05."""
    return float(poilog_logpmf(y, mu + np.log(phi * np.asarray(d) * np.asarray(lam)), sig).sum())


# bounded optimisers


def golden(f, low, high, tol=1e-6) -> float:
    """The maximum of a unimodal function on [low, high]."""
    g = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tol:
        if fc >= fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def nelder_mead(f, start, steps, rounds=200, tol=1e-7):
    """A minimum of ``f`` from ``start``."""
    n = len(start)
    simplex = [np.array(start, float)] + [np.array(start, float) + np.eye(n)[i] * steps[i] for i in range(n)]
    values = [f(p) for p in simplex]
    for _ in range(rounds):
        order = np.argsort(values)
        simplex, values = [simplex[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < tol:
            break
        centre = np.mean(simplex[:-1], 0)
        up = centre + (centre - simplex[-1])
        fu = f(up)
        if fu < values[0]:
            far = centre + 2 * (centre - simplex[-1])
            ff = f(far)
            simplex[-1], values[-1] = (far, ff) if ff < fu else (up, fu)
        elif fu < values[-2]:
            simplex[-1], values[-1] = up, fu
        else:
            in_ = centre + 0.5 * (simplex[-1] - centre)
            fi = f(in_)
            if fi < values[-1]:
                simplex[-1], values[-1] = in_, fi
            else:
                simplex = [simplex[0]] + [simplex[0] + 0.5 * (p - simplex[0]) for p in simplex[1:]]
                values = [values[0]] + [f(p) for p in simplex[1:]]
    return simplex[int(np.argmin(values))]


def fit_lnpois(y, lam, d, n_points: int = 48) -> tuple[float, float]:
    """the most likely (mu, sigma >= 0.01) of genes with lam > 0."""
    y, lam = np.asarray(y, float), np.asarray(lam, float)
    d = np.broadcast_to(np.asarray(d, float), y.shape)
    ok = lam > 0
    if not ok.any():
        return 0.0, 1.0
    y, base = y[ok], np.log(lam[ok] * d[ok])
    # equal counts at nearly equal rates share a value
    base = np.round(base, 2)
    keys, n = np.unique(np.stack([y, base], 1), axis=0, return_counts=True)
    got = _fit_by_newton(keys[:, 0], keys[:, 1], n, n_points)
    if got is None:
        f = lambda p: -float((n * poilog_logpmf(keys[:, 0], p[0] + keys[:, 1], max(p[1], 0.01), n_points)).sum())
        got = nelder_mead(f, (0.0, 1.0), (0.3, -0.3), rounds=60, tol=1e-3)
    return float(got[0]), float(max(got[1], 0.01))


def _fit_by_newton(y, base, n, n_points: int, rounds: int = 60, tol: float = 1e-6) -> tuple[float, float] | None:
    """(mu, sigma) by Newton's steps in mu and ln sigma, with derivatives from the moments of each row's rate; None if a pmf underflows at the end or no end is reached."""
    least = math.log(0.01)

    def look(p):
        s = math.exp(p[1])
        v, (like, mean) = s * s, _poilog(y, p[0] + base, np.full(len(y), s), n_points, True)
        m1, m2, m3, m4 = mean.T
        slope = np.array([(n * m1).sum() / v, (n * (m2 / v - 1)).sum()])
        cross = (n * ((m3 - m1 * m2) / v**2 - 2 * m1 / v)).sum()
        bend = np.array([[(n * ((m2 - m1 * m1) / v**2 - 1 / v)).sum(), cross], [cross, (n * ((m4 - m2 * m2) / v**2 - 2 * m2 / v)).sum()]])
        return float((n * like).sum()), slope, bend, like

    p = np.array([0.0, 0.0])
    now = look(p)
    for _ in range(rounds):
        like, slope, bend, rows = now
        if not np.isfinite(like):
            return None
        free = np.array([True, p[1] > least or slope[1] > 0])
        # towards a maximum also where the surface bends upwards
        value, axes = np.linalg.eigh(bend[np.ix_(free, free)])
        way = np.zeros(2)
        way[free] = axes @ ((axes.T @ slope[free]) / np.maximum(np.abs(value), 1e-9))
        gain = float(slope @ way)
        if gain < tol:
            return None if (rows < LOG_LEAST).any() else (float(p[0]), math.exp(p[1]))
        way *= min(1.0, 2.0 / np.abs(way).max())
        for _ in range(30):
            to = np.array([p[0] + way[0], max(p[1] + way[1], least)])
            new = look(to)
            if new[0] > like:
                break
            way /= 2
        else:
            # no step gains any more: rounding, if little was to be gained
            return None if gain > 1e-3 or (rows < LOG_LEAST).any() else (float(p[0]), math.exp(p[1]))
        p, now = to, new
    return None


def curvature(f, at, h) -> float:
    """Standard deviation by the observed information at a maximum."""
    second = (f(at + h) - 2 * f(at) + f(at - h)) / h**2
    return float(1 / math.sqrt(-second)) if second < 0 else 0.0


def phi_post(y, lam, d, mu, sig, low=0.2, high=10.0, n_points: int = 96) -> tuple[float, float]:
    """fold change with the highest likelihood and its spread; (1, 0) without rows."""
    y, lam = np.asarray(y, float), np.asarray(lam, float)
    if not len(y):
        return 1.0, 0.0
    base = mu + np.log(np.asarray(d) * lam)
    f = lambda phi: float(poilog_logpmf(y, base + math.log(phi), sig, n_points).sum())
    top = golden(f, low, high, 1e-4)
    return top, curvature(f, top, 1e-3 * top)


def fit_snp_rate(n, length) -> tuple[float, float]:
    """rate by megabase and dispersion of negative binomial SNP counts."""
    n, m = np.asarray(n, float), np.asarray(length, float) / 1e6

    def f(p):
        v, size = max(p[0], 1e-3), max(p[1], 1e-3)
        mu = v * m
        return -float((lgamma(n + size) - lgamma(size) - lgamma(n + 1) + size * np.log(size / (size + mu)) + n * np.log(mu / (size + mu))).sum())

    v, size = nelder_mead(f, (10.0, 1.0), (2.0, 0.5))
    return float(max(v, 1e-3)), float(max(size, 1e-3))


# hidden Markov models


def beta_binom(k, n, a, b):
    k, n = np.asarray(k, float), np.asarray(n, float)
    outside = (k < 0) | (k > n)
    k = np.where(outside, 0, k)
    out = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + lgamma(k + a) + lgamma(n - k + b) - lgamma(n + (a + b)) - (lgamma(a) + lgamma(b) - lgamma(a + b))
    return np.where(outside, -np.inf, out)


def viterbi(log_start, log_emit, log_trans) -> np.ndarray:
    """The best path. log_emit: (n, m); log_trans: (n, m, m), entry t leading to row t; the first of equal states."""
    n, m = log_emit.shape
    back = np.zeros((n, m), int)
    score = log_start + log_emit[0]
    for t in range(1, n):
        step = score[:, None] + log_trans[t]
        back[t] = step.argmax(0)
        score = step.max(0) + log_emit[t]
    path = np.zeros(n, int)
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _lse(x, axis):
    top = x.max(axis, keepdims=True)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return (np.log(np.exp(x - safe).sum(axis, keepdims=True)) + safe).squeeze(axis)


def forward(log_start, log_emit, log_trans) -> float:
    """The log-likelihood of all paths."""
    a = log_start + log_emit[0]
    for t in range(1, len(log_emit)):
        a = _lse(a[:, None] + log_trans[t], 0) + log_emit[t]
    return float(_lse(a, 0))


def forward_backward(log_start, log_emit, log_trans) -> np.ndarray:
    """Posterior marginals, rows summing to 1."""
    n, m = log_emit.shape
    a, b = np.zeros((n, m)), np.zeros((n, m))
    a[0] = log_start + log_emit[0]
    for t in range(1, n):
        a[t] = _lse(a[t - 1][:, None] + log_trans[t], 0) + log_emit[t]
    for t in range(n - 2, -1, -1):
        b[t] = _lse(log_trans[t + 1] + log_emit[t + 1] + b[t + 1], 1)
    g = a + b
    return np.exp(g - _lse(g, 1)[:, None])


def two_state(p_ad, dp, p_s, theta, gamma=20.0):
    """The phase-switching model: start, emissions and transitions of (up, down)."""
    p_ad, dp, p_s = (np.asarray(v, float) for v in (p_ad, dp, p_s))
    a, b = gamma * (0.5 + theta), gamma * (0.5 - theta)
    emit = np.stack([beta_binom(p_ad, dp, a, b), beta_binom(p_ad, dp, b, a)], 1)
    emit = np.where(np.isnan(p_ad)[:, None], 0, emit)
    with np.errstate(divide="ignore"):
        stay, flip = np.log(1 - p_s), np.log(p_s)
    trans = np.stack([np.stack([stay, flip], 1), np.stack([flip, stay], 1)], 1)
    return np.log([0.5, 0.5]), emit, trans


def allele_likelihood(p_ad, dp, p_s, theta, gamma=20.0) -> float:
    return forward(*two_state(p_ad, dp, p_s, theta, gamma))


def allele_likelihoods(p_ad, dp, p_s, thetas, gamma=20.0) -> np.ndarray:
    """M04 for many imbalances at once: one pass over the SNPs."""
    p_ad, dp, p_s, thetas = (np.asarray(v, float) for v in (p_ad, dp, p_s, thetas))
    a = gamma * (0.5 + thetas)[:, None]
    blind = np.isnan(p_ad)
    up, down = (np.where(blind, 0, beta_binom(np.where(blind, 0, p_ad), np.where(blind, 0, dp), x, gamma - x)) for x in (a, gamma - a))
    with np.errstate(divide="ignore"):
        stay, flip = np.log(1 - p_s), np.log(p_s)
    u, d = up[:, 0] + math.log(0.5), down[:, 0] + math.log(0.5)
    for t in range(1, len(p_s)):
        u, d = np.logaddexp(u + stay[t], d + flip[t]) + up[:, t], np.logaddexp(d + stay[t], u + flip[t]) + down[:, t]
    return np.logaddexp(u, d)


def theta_post(p_ad, dp, p_s, gamma=20.0, least: int = 10) -> tuple[float, float]:
    """imbalance with the highest likelihood and its spread; (0, 0) for few SNPs. A grid, refined twice."""
    if len(p_ad) <= least:
        return 0.0, 0.0
    low, high = 0.001, 0.499
    for _ in range(3):
        grid = np.linspace(low, high, 24)
        top, step = grid[int(np.argmax(allele_likelihoods(p_ad, dp, p_s, grid, gamma)))], grid[1] - grid[0]
        low, high = max(0.001, top - step), min(0.499, top + step)
    h = 1e-3
    below, at, above = allele_likelihoods(p_ad, dp, p_s, [top - h, top, top + h], gamma)
    second = (above - 2 * at + below) / h**2
    return float(top), float(1 / math.sqrt(-second)) if second < 0 else 0.0


#: States and their phases of the two models.
FIVE = ("neu", "theta_1_up", "theta_1_down", "theta_2_up", "theta_2_down")
FIFTEEN = ("neu", *(f"{s}_{lv}_{p}" for s in ("del", "loh", "amp") for lv in (1, 2) for p in ("up", "down")), "bamp", "bdel")
#: Weights of the states as destinations.
WEIGHTS = {"neu": 1.0, "del_1": 1.0, "loh_1": 1.0, "amp_1": 1.0, "del_2": 1e-10, "loh_2": 1e-10, "amp_2": 1e-10, "bdel": 1e-10, "bamp": 1e-4}
#: Expression fold change of each state.
PHI = {"neu": 1.0, "del_1": 2**-0.25, "del_2": 0.5, "loh_1": 1.0, "loh_2": 1.0, "amp_1": 2**0.25, "amp_2": 2.5, "bamp": 2**0.25, "bdel": 2**-0.25}


def _level(state: str) -> str:
    return state.removesuffix("_up").removesuffix("_down")


def switch_probs(distance, nu: float = 1.0, least: float = 1e-10) -> np.ndarray:
    """F01 by the C library's exp."""
    d = np.asarray(distance, float)
    known = ~np.isnan(d)
    out = np.zeros(len(d))
    if nu:
        out[known] = np.maximum(0.5 * (1 - _by_value(_exp, d[known] * (-2.0 * nu))), least)
    return out


def transitions5(p_s, t: float) -> np.ndarray:
    """Log transitions into each row."""
    p_s = np.asarray(p_s, float)
    out = np.full((len(p_s), 5, 5), math.log(t / 4))
    out[:, 0, 0] = math.log(1 - t)
    out[:, 1:, 0] = math.log(t / 2)
    log = lambda x: np.where(x > 0, _by_value(_log, np.where(x > 0, x, 1.0)), -np.inf)
    same, flip = log((1 - t) * (1 - p_s)), log((1 - t) * p_s)
    for i in range(1, 5):
        out[:, i, i], out[:, i, 1 + ((i - 1) ^ 1)] = same, flip
    return out


def allele_hmm5(p_ad, dp, p_s, t=1e-5, theta=(0.08, 0.4), gamma=20.0) -> np.ndarray:
    """State names of the best path; a null pAD says nothing."""
    p_ad, dp = np.asarray(p_ad, float), np.asarray(dp, float)
    a = gamma * np.round([0.5, 0.5 + theta[0], 0.5 - theta[0], 0.5 + theta[1], 0.5 - theta[1]], 12)
    known = ~(np.isnan(p_ad) | np.isnan(dp))
    emit = np.where(known[:, None], beta_binom(np.where(known, p_ad, 0)[:, None], np.where(known, dp, 0)[:, None], a, gamma - a), 0)
    return np.array(FIVE)[viterbi(np.full(5, math.log(0.2)), emit, transitions5(p_s, t))]


def transitions15(p_s, t: float) -> np.ndarray:
    p_s = np.asarray(p_s, float)
    base = [_level(s) for s in FIFTEEN]
    w = np.array([WEIGHTS[b] for b in base])
    phased = np.array([s.endswith(("_up", "_down")) for s in FIFTEEN])
    kinds = sorted(set(base), key=base.index)
    total = sum(WEIGHTS[k] for k in kinds)
    out = np.empty((len(p_s), 15, 15))
    for i, bi in enumerate(base):
        away = t * w / (total - WEIGHTS[bi]) / np.where(phased, 2, 1)
        out[:, i, :] = away
        for j in np.flatnonzero(np.array(base) == bi):
            out[:, i, j] = (1 - t) if not phased[i] else (1 - t) * np.where(i == j, 1 - p_s, p_s)
    with np.errstate(divide="ignore"):
        return np.log(out)


def joint_hmm15(p_ad, dp, p_s, y, lam, d, mu, sig, t=1e-5, theta_min=0.08, gamma=20.0, allele_only=False, exp_only=False, n_points: int = 64) -> np.ndarray:
    """State names of the best path over allele and expression evidence; nulls say nothing."""
    p_ad, dp, y, lam = (np.asarray(v, float) for v in (p_ad, dp, y, lam))
    base = [_level(s) for s in FIFTEEN]
    mean = []
    for s, b in zip(FIFTEEN, base, strict=True):
        up = 0.5 + theta_min if b.endswith("_1") else 0.9 if b.endswith("_2") else 0.5
        mean.append(1 - up if s.endswith("_down") else up)
    a = gamma * np.array(mean)
    emit = np.zeros((len(p_s), 15))
    known = ~(np.isnan(p_ad) | np.isnan(dp))
    if known.any() and not exp_only:
        emit[known] += beta_binom(p_ad[known, None], dp[known, None], a, gamma - a)
    seen = ~np.isnan(y) & (lam > 0)
    if seen.any() and not allele_only:
        rate = mu + np.log(np.asarray(d, float)[seen] * lam[seen]) if np.ndim(d) else mu + np.log(d * lam[seen])
        by = {p: poilog_logpmf(y[seen], rate + math.log(p), sig, n_points) for p in set(PHI.values())}
        emit[seen] += np.stack([by[PHI[b]] for b in base], 1)
    trans = transitions15(p_s, t)
    start = transitions15([0.0], min(100 * t, 1 - 1e-12))[0, 0]
    return np.array(FIFTEEN)[viterbi(start, emit, trans)]


def loh_hmm(n_snps, length, y, lam, d, mu, sig, v, size, t=1e-5, loh_rate=5.0) -> np.ndarray:
    """Neu or loh along all genes in order: SNP counts by a negative binomial, expression alike in both but for phi."""
    n, m = np.asarray(n_snps, float), np.asarray(length, float) / 1e6

    def nb(rate):
        mean = np.maximum(rate * m, 1e-12)
        return lgamma(n + size) - lgamma(size) - lgamma(n + 1) + size * np.log(size / (size + mean)) + n * np.log(mean / (size + mean))

    emit = np.stack([nb(v), nb(loh_rate)], 1)
    seen = ~np.isnan(np.asarray(y, float))
    base = mu + np.log(np.asarray(d, float) * np.where(np.asarray(lam, float) > 0, lam, 1e-12))
    for j, phi in enumerate((1.0, 0.5)):
        emit[seen, j] += poilog_logpmf(np.asarray(y, float)[seen], base[seen] + math.log(phi), sig, 64)
    trans = np.log(np.broadcast_to(np.array([[1 - t, t], [t, 1 - t]]), (len(n), 2, 2)))
    return np.array(["neu", "loh"])[viterbi(np.log([1 - t, t]), emit, trans)]


# UDFs


@F.pandas_udf(T.DoubleType())
def poilog_udf(x: pd.Series, mu: pd.Series, sig: pd.Series) -> pd.Series:
    ok = x.notna() & mu.notna() & sig.notna()
    out = pd.Series(np.nan, index=x.index)
    if ok.any():
        out[ok] = poilog_logpmf(x[ok], mu[ok], sig[ok])
    return out


@F.pandas_udf(T.DoubleType())
def pnorm_range_udf(low: pd.Series, high: pd.Series, mu: pd.Series, sigma: pd.Series) -> pd.Series:
    return pd.Series(pnorm_range_log(low, high, mu, sigma))


@F.pandas_udf(T.DoubleType())
def welch_udf(n1: pd.Series, m1: pd.Series, v1: pd.Series, n2: pd.Series, m2: pd.Series, v2: pd.Series) -> pd.Series:
    v1, v2 = v1.fillna(0), v2.fillna(0)
    return pd.Series([welch_p(*r) for r in zip(n1, m1, v1, n2, m2, v2, strict=True)])


def register(spark) -> None:
    """The functions that SQL can call."""
    spark.udf.register("poilog_logpmf", poilog_udf)
    spark.udf.register("pnorm_range_log", pnorm_range_udf)
    spark.udf.register("welch_p", welch_udf)


def simplex_fit(log_obs, lam, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights w >= 1e-6, summing to 1, with the least mean squared error of ln(obs) by ln(lam w): multiplicative steps with halving."""
    k = lam.shape[1]
    w = np.full(k, 1 / k)

    def loss(x):
        return float(np.mean((log_obs - np.log(lam @ x)) ** 2))

    now, rate = loss(w), 0.5
    for _ in range(rounds):
        fit = lam @ w
        g = -2 * ((log_obs - np.log(fit)) / fit) @ lam / len(lam)
        step = np.maximum(w * np.exp(-rate * np.clip(g, -20, 20)), 1e-6)
        step /= step.sum()
        then = loss(step)
        if then < now:
            if now - then < 1e-12:
                break
            w, now, rate = step, then, rate * 1.3
        else:
            rate /= 2
            if rate < 1e-9:
                break
    return w, now


def fit_reference(totals: DataFrame, ref: DataFrame, min_lambda: float = 2e-6) -> DataFrame:
    """(sample, ref, w, mse) that fit each sample's expression best. One row per gene and sample with all profiles goes to the fit."""
    profiles = ref.groupBy("gene").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ref", "lambda")))).alias("m"), F.avg("lambda").alias("a")).where(F.col("a") > min_lambda)
    x = totals.where("Y_obs > 0").join(profiles, "gene").select("sample", F.log("lambda_obs").alias("y"), F.map_keys("m").alias("refs"), F.map_values("m").alias("lams"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({r for refs in pdf["refs"] for r in refs})
        at = {r: i for i, r in enumerate(names)}
        lam = np.zeros((len(pdf), len(names)))
        for i, (refs, values) in enumerate(zip(pdf["refs"], pdf["lams"], strict=True)):
            for r, v in zip(refs, values, strict=True):
                lam[i, at[r]] = v
        ok = lam.sum(1) > 0
        w, mse = simplex_fit(pdf["y"].to_numpy()[ok], np.maximum(lam[ok], 1e-12))
        return pd.DataFrame({"sample": pdf["sample"].iloc[0], "ref": names, "w": w, "mse": mse})

    return x.groupBy("sample").applyInPandas(fit, "sample string, ref string, w double, mse double")

"""Distribution tails and quantiles in NumPy: gamma and beta integrals, chi-square, t, F, normal,
binomial-type exact tests, mixtures of chi-squares."""

from __future__ import annotations

import math

import numpy as np

_EPS = 1e-15


#: Coefficients of Lanczos' approximation of the gamma function (g = 7).
_LANCZOS = np.array([0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7])


def lgamma(x):
    """Logarithm of the gamma function for x > 0, elementwise."""
    x = np.asarray(x, float) - 1.0
    total = _LANCZOS[0] + sum(c / (x + i) for i, c in enumerate(_LANCZOS[1:], 1))
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * np.log(t) - t + np.log(total)


#: From this shape on the gamma integral is taken from its uniform expansion; below, 2000 terms are enough.
LARGE_SHAPE = 20_000.0


def _large_gamma_q(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Temme's uniform expansion to two terms; its error is of the order of a ** -2.5."""
    mu = x / a - 1
    eta = np.sign(mu) * np.sqrt(2 * np.maximum(mu - np.log1p(mu), 0.0))
    near = np.abs(mu) < 0.01
    m = np.where(near, 1.0, mu)
    e = np.where(near, 1.0, eta)
    c0 = np.where(near, -1 / 3 + eta / 12 - 2 * eta**2 / 135 + eta**3 / 864, 1 / m - 1 / e)
    c1 = np.where(near, -1 / 540 - eta / 288, 1 / e**3 - 1 / m**3 - 1 / m**2 - 1 / (12 * m))
    return norm_sf(eta * np.sqrt(a)) + np.exp(-a * eta**2 / 2) / np.sqrt(2 * math.pi * a) * (c0 + c1 / a)


def gamma_q(a, x):
    """Upper regularized incomplete gamma function, elementwise: series below a + 1, continued fraction above,
    the uniform expansion for large shapes."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    ok = (a > 0) & (x >= 0)
    out[ok & (x == 0)] = 1.0
    large = ok & (a > LARGE_SHAPE) & (x > 0) & np.isfinite(x)
    if large.any():
        with np.errstate(all="ignore"):
            out[large] = _large_gamma_q(a[large], x[large])
        ok = ok & ~large
    with np.errstate(all="ignore"):
        lead = np.exp(-x + a * np.log(np.where(x > 0, x, 1)) - lgamma(np.where(a > 0, a, 1)))
        low = ok & (x > 0) & (x < a + 1)
        if low.any():
            aa, xx = a[low], x[low]
            term = total = 1 / aa
            for i in range(1, 2000):
                term = term * xx / (aa + i)
                total = total + term
                if np.all(np.abs(term) < np.abs(total) * _EPS):
                    break
            out[low] = 1 - lead[low] * total
        high = ok & (x >= a + 1) & np.isfinite(x)
        out[ok & np.isposinf(x)] = 0.0
        if high.any():
            aa, xx = a[high], x[high]
            b = xx + 1 - aa
            c = np.full(aa.shape, 1e300)
            d = 1 / b
            h = d
            for i in range(1, 2000):
                an = -i * (i - aa)
                b = b + 2
                d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
                c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
                step = d * c
                h = h * step
                if np.all(np.abs(step - 1) < _EPS * 4):
                    break
            out[high] = lead[high] * h
    return out


def beta_i(a, b, x):
    """Regularized incomplete beta function, elementwise."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.nan))
    m = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    if m.any():
        aa, bb, xx = a[m], b[m], x[m]
        swap = xx > (aa + 1) / (aa + bb + 2)
        p, q, z = np.where(swap, bb, aa), np.where(swap, aa, bb), np.where(swap, 1 - xx, xx)
        lead = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(z) + q * np.log1p(-z))
        tiny = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
        c = np.ones_like(z)
        d = 1 / tiny(1 - (p + q) * z / (p + 1))
        h = d
        for i in range(1, 1000):
            for num in (i * (q - i) * z / ((p + 2 * i - 1) * (p + 2 * i)), -(p + i) * (p + q + i) * z / ((p + 2 * i) * (p + 2 * i + 1))):
                d = 1 / tiny(1 + num * d)
                c = tiny(1 + num / c)
                step = c * d
                h = h * step
            if np.all(np.abs(step - 1) < 1e-14):
                break
        r = lead * h / p
        out[m] = np.where(swap, 1 - r, r)
    return out


def chi2_sf(x, df):
    return gamma_q(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def norm_sf(z):
    """Upper tail of the normal distribution, with relative precision far out."""
    z = np.asarray(z, float)
    half = 0.5 * gamma_q(0.5, z * z / 2)
    return np.where(z >= 0, half, 1 - half)


#: Coefficients of Acklam's rational approximation of the normal quantile.
_CENTER = ((-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00), (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0))
_TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00), (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0))


def norm_quantile(p):
    """Inverse of the normal distribution function: a rational approximation of the lesser tail, then two Newton steps."""
    p = np.asarray(p, float)
    low = np.minimum(p, 1 - p)
    with np.errstate(all="ignore"):
        q = low - 0.5
        center = q * np.polyval(_CENTER[0], q * q) / np.polyval(_CENTER[1], q * q)
        t = np.sqrt(-2 * np.log(low))
        z = np.where(low < 0.02425, np.polyval(_TAIL[0], t) / np.polyval(_TAIL[1], t), center)
        for _ in range(2):
            z = np.where(np.isfinite(z), z - (norm_sf(-z) - low) * math.sqrt(2 * math.pi) * np.exp(z * z / 2), z)
        z = np.where(p > 0.5, -z, z)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, z))


def t_sf2(t, df):
    """Two-sided tail of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_i(df / 2, 0.5, df / (df + t * t))


def f_sf(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return np.where(f <= 0, 1.0, beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0))))


def ncx2_cdf(x: float, df: float, nc: float) -> float:
    """Noncentral chi-square distribution function as a Poisson mixture."""
    if x <= 0:
        return 0.0
    half, total, mid = nc / 2, 0.0, int(nc / 2)
    for way in (range(mid, mid + 5000), range(mid - 1, -1, -1)):
        for j in way:
            w = math.exp(-half + j * math.log(half) - math.lgamma(j + 1)) if half > 0 else float(j == 0)
            total += w * (1 - float(gamma_q(df / 2 + j, x / 2)))
            if w < 1e-16:
                break
    return min(1.0, total)


def hwe_exact_p(n0: int, n1: int, n2: int) -> float:
    """Exact two-sided p-value of Hardy-Weinberg proportions: all heterozygote counts as likely or less."""
    n, rare = n0 + n1 + n2, 2 * min(n0, n2) + n1
    if n == 0:
        return float("nan")
    het = np.arange(rare % 2, rare + 1, 2)
    hom_r = (rare - het) // 2
    hom_c = n - het - hom_r
    keep = hom_c >= 0
    het, hom_r, hom_c = het[keep], hom_r[keep], hom_c[keep]
    logp = het * math.log(2) - lgamma(hom_r + 1) - lgamma(het + 1) - lgamma(hom_c + 1)
    p = np.exp(logp - logp.max())
    p /= p.sum()
    return float(min(1.0, p[p <= p[het == n1][0] * (1 + 1e-9)].sum()))


def fisher_exact_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher test of a 2 x 2 table."""
    r, s, k = a + b, c + d, a + c
    if r + s == 0:
        return float("nan")
    x = np.arange(max(0, k - s), min(r, k) + 1)
    logp = -(lgamma(x + 1) + lgamma(r - x + 1) + lgamma(k - x + 1) + lgamma(s - k + x + 1))
    p = np.exp(logp - logp.max())
    p /= p.sum()
    return float(min(1.0, p[p <= p[x == a][0] * (1 + 1e-9)].sum()))


def ncx2_sf(x, df: float, nc: float) -> np.ndarray:
    """Noncentral chi-square tail of many values: a Poisson mixture of central ones."""
    x = np.atleast_1d(np.asarray(x, float))
    if nc <= 0:
        return np.asarray(chi2_sf(np.maximum(x, 0.0), df))
    half = nc / 2
    j = np.arange(max(0, int(half - 9 * math.sqrt(half) - 20)), int(half + 9 * math.sqrt(half) + 40))
    w = np.exp(-half + j * math.log(half) - lgamma(j + 1.0))
    tail = gamma_q(df / 2 + j[None, :], np.maximum(x, 0.0)[:, None] / 2)
    return np.where(x <= 0, 1.0, np.clip(tail @ w / w.sum(), 0.0, 1.0))


def liu_sf_all(q, weights: np.ndarray) -> np.ndarray:
    """Tails of a weighted sum of chi-squares (1 df) at many values, by matching four moments."""
    q = np.atleast_1d(np.asarray(q, float))
    c1, c2, c3, c4 = (float((weights**k).sum()) for k in (1, 2, 3, 4))
    if c2 <= 0:
        return np.ones(len(q))
    s1, s2 = c3 / c2**1.5, c4 / c2**2
    if s1 * s1 > s2:
        a = 1 / (s1 - math.sqrt(s1 * s1 - s2))
        delta = s1 * a**3 - a * a
        df = a * a - 2 * delta
    else:
        delta = 0.0
        df = c2**3 / c3**2
    return ncx2_sf((q - c1) / math.sqrt(2 * c2) * math.sqrt(2 * (df + 2 * delta)) + df + delta, df, delta)


def liu_sf(q: float, weights: np.ndarray) -> float:
    return float(liu_sf_all(q, weights)[0])


def davies_sf(q: float, weights: np.ndarray) -> float:
    """Tail of a weighted sum of chi-squares by numerical inversion of the characteristic function; Liu's
    approximation where the integral leaves [0, 1]."""
    w = np.asarray(weights, float)
    w = w[np.abs(w) > 1e-12 * max(1e-300, np.abs(w).max(initial=0.0))]
    if not len(w):
        return float(q < 0)
    if np.ptp(w) <= 1e-9 * w.max() and w[0] > 0:
        return float(chi2_sf(max(q / w.mean(), 0.0), len(w)))
    scale = np.abs(w).sum()
    w, q = w / scale, q / scale
    step, total, at = min(0.02, 0.5 / max(1.0, abs(q))), 0.0, 0
    for size in (2_000, 8_000, 30_000, 160_000):  # until the integrand has died away
        u = (at + np.arange(size) + 0.5) * step
        wu = 2 * np.outer(w, u) if size * len(w) < 2_000_000 else None
        if wu is None:
            theta, logrho = np.zeros(size), np.zeros(size)
            for x in w:
                theta += 0.5 * np.arctan(2 * x * u)
                logrho += 0.25 * np.log1p(4 * x * x * u * u)
        else:
            theta, logrho = 0.5 * np.arctan(wu).sum(0), 0.25 * np.log1p(wu * wu).sum(0)
        total += float((np.sin(theta - q * u) / (u * np.exp(logrho))).sum()) * step
        at += size
        if -logrho[-1] - math.log(u[-1]) < math.log(1e-5):
            break
    p = 0.5 + total / math.pi
    return p if 1e-9 < p < 1 - 1e-12 else liu_sf(q, w)


def normal_max_sf(z: float, corr: np.ndarray, draws: int = 20_000, seed: int = 1) -> float:
    """P(max |Z| >= z) of correlated standard normals: nested conditional intervals over quasi-random points."""
    n = len(corr)
    if n == 1:
        return float(2 * norm_sf(z))
    root = np.linalg.cholesky(corr + 1e-9 * np.eye(n))
    rng = np.random.default_rng(seed)
    # Richtmyer's lattice, shifted and folded
    steps = np.sqrt(_primes(n - 1))
    u = np.abs(2 * ((np.outer(np.arange(1, draws + 1), steps) + rng.random(n - 1)) % 1.0) - 1)
    x, inside = np.zeros((draws, n)), np.ones(draws)
    for i in range(n):
        mean = x[:, :i] @ root[i, :i]
        low, high = norm_sf(-(-z - mean) / root[i, i]), norm_sf(-(z - mean) / root[i, i])
        width = np.maximum(high - low, 0.0)
        inside *= width
        if i < n - 1:
            x[:, i] = norm_quantile(np.clip(low + u[:, i] * width, 1e-300, 1 - 1e-16))
    return float(min(1.0, max(1 - inside.mean(), 2 * float(norm_sf(z)))))


def _primes(n: int) -> np.ndarray:
    out, k = [], 2
    while len(out) < n:
        if all(k % p for p in out if p * p <= k):
            out.append(k)
        k += 1
    return np.array(out, float)


def best_mixture_p(q1: float, q2: float, df: int, draws: int = 20_000, grid: int = 11, seed: int = 1) -> float:
    """p of the least p over mixtures r q1 + (1 - r) q2, where q2 is q1 and an independent chi-square with df - 1."""
    if df < 2:
        return float(chi2_sf(q2, df))
    rng = np.random.default_rng(seed)
    a, b = rng.chisquare(1, draws), rng.chisquare(df - 1, draws)
    least_seen, least_null = 1.0, np.ones(draws)
    for r in np.linspace(0, 1, grid):
        mixed = np.sort(a + (1 - r) * b)
        tail = lambda x: (draws - np.searchsorted(mixed, x, side="left") + 1) / (draws + 1)
        least_seen = min(least_seen, float(tail(q1 + (1 - r) * max(q2 - q1, 0.0))))
        least_null = np.minimum(least_null, tail(a + (1 - r) * b))
    return float(((least_null <= least_seen).sum() + 1) / (draws + 1))


def ks_p(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Two-sample Kolmogorov-Smirnov distance and its asymptotic p."""
    both = np.sort(np.concatenate([x, y]))
    d = float(np.abs(np.searchsorted(np.sort(x), both, side="right") / len(x) - np.searchsorted(np.sort(y), both, side="right") / len(y)).max())
    n = len(x) * len(y) / (len(x) + len(y))
    t = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101)) if t > 0.2 else 1.0
    return d, float(min(1.0, max(0.0, p)))


def rank_sum_p(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Rank-sum z with ties at their mean rank, and its two-sided p."""
    both = np.concatenate([x, y])
    order = np.unique(both, return_inverse=True, return_counts=True)
    upto = np.cumsum(order[2])
    rank = (upto - (order[2] - 1) / 2)[order[1]]
    m, n = len(x), len(both)
    ties = float((order[2] ** 3 - order[2]).sum())
    var = m * (n - m) / 12 * (n + 1 - ties / (n * (n - 1)))
    z = (rank[:m].sum() - m * (n + 1) / 2) / math.sqrt(var) if var > 0 else 0.0
    return float(z), float(2 * norm_sf(abs(z)))


def fisher_exact_2x3_p(table: np.ndarray) -> float:
    """Fisher's exact p of a 2 x 3 table: all tables with its margins that are as likely or less."""
    t = np.asarray(table, int).reshape(2, 3)
    k, r = t.sum(0), int(t[0].sum())
    a, b = np.meshgrid(np.arange(k[0] + 1), np.arange(k[1] + 1), indexing="ij")
    c = r - a - b
    ok = (c >= 0) & (c <= k[2])
    a, b, c = a[ok], b[ok], c[ok]
    part = lambda n, x: lgamma(n + 1.0) - lgamma(x + 1.0) - lgamma(n - x + 1.0)
    logp = part(k[0], a) + part(k[1], b) + part(k[2], c)
    p = np.exp(logp - logp.max())
    seen = p[(a == t[0, 0]) & (b == t[0, 1])][0]
    return float(min(1.0, p[p <= seen * (1 + 1e-9)].sum() / p.sum()))


def saddlepoint_sf(q: float, weights: np.ndarray) -> float:
    """Tail of a weighted sum of chi-squares (1 df) by the saddlepoint formula of Kuonen."""
    w = np.asarray(weights, float)
    k = lambda t: -0.5 * np.log1p(-2 * t * w).sum()
    k1, k2 = (lambda t: (w / (1 - 2 * t * w)).sum()), (lambda t: 2 * (w * w / (1 - 2 * t * w) ** 2).sum())
    top = 1 / (2 * w.max()) if w.max() > 0 else np.inf
    lo, hi = -1e4 / np.abs(w).max(), top * (1 - 1e-10)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if k1(mid) < q else (lo, mid)
    t = (lo + hi) / 2
    if abs(t) * np.abs(w).sum() < 1e-5:
        return liu_sf(q, w)
    a = math.copysign(math.sqrt(max(2 * (t * q - k(t)), 0.0)), t)
    b = t * math.sqrt(k2(t))
    return float(norm_sf(a + math.log(b / a) / a))


def least_at(f, lo: float, hi: float, points: int = 17, rounds: int = 12) -> float:
    """Place of the least value of a function over arrays: a grid that closes in on its best point."""
    for _ in range(rounds):
        x = np.linspace(lo, hi, points)
        k = int(np.nanargmin(f(x)))
        lo, hi = x[max(0, k - 1)], x[min(points - 1, k + 1)]
    return float((lo + hi) / 2)


def integrate(f, lo: float, hi: float, tolerance: float = 1e-10, depth: int = 40) -> float:
    """Integral of f by adaptive Simpson steps."""

    def part(a, b, fa, fm, fb, whole, eps, left):
        m = (a + b) / 2
        l, r = f((a + m) / 2), f((m + b) / 2)
        one, two = (m - a) / 6 * (fa + 4 * l + fm), (b - m) / 6 * (fm + 4 * r + fb)
        if left <= 0 or abs(one + two - whole) <= 15 * eps:
            return one + two + (one + two - whole) / 15
        return part(a, m, fa, l, fm, one, eps / 2, left - 1) + part(m, b, fm, r, fb, two, eps / 2, left - 1)

    fa, fm, fb = f(lo), f((lo + hi) / 2), f(hi)
    return part(lo, hi, fa, fm, fb, (hi - lo) / 6 * (fa + 4 * fm + fb), tolerance, depth)

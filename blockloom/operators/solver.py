"""Sparse multi-block components from moments alone.

With Pearson correlation everything a fit needs (scores' variances and covariances, gradients,
loadings, explained variance, deflation) is a function of n, sums and cross-products.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .moments import Moments

EPS = 1e-12


def soft(g: np.ndarray, a: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - a, 0)


def sparse_unit(g: np.ndarray, c: float, maxit: int = 60, tol: float = 1e-8) -> np.ndarray:
    """The unit vector nearest to g whose absolute values sum to c at most, by bisection of a soft threshold."""
    size = np.linalg.norm(g)
    if size < 1e-16:
        raise ValueError("zero gradient")
    if c >= np.sqrt(len(g)) or np.abs(g).sum() / size <= c:
        return g / size
    low, high, best = 0.0, np.abs(g).max(), None
    for _ in range(maxit):
        mid = (low + high) / 2
        z = soft(g, mid)
        n = np.linalg.norm(z)
        if n < 1e-16:
            high = mid
            continue
        w = z / n
        if np.abs(w).sum() > c:
            low = mid
        else:
            best, high = w, mid
        if high - low < tol * max(1.0, np.abs(g).max()):
            break
    if best is None:
        best = np.zeros(len(g))
        best[np.argmax(np.abs(g))] = np.sign(g[np.argmax(np.abs(g))])
    return best


@dataclass
class Blocks:
    """Block-wise view of moments, deflated in place as components are taken out."""

    names: list[str]
    index: list[np.ndarray]
    n: float
    s: np.ndarray
    g: np.ndarray
    total: np.ndarray = None
    a: np.ndarray = None  # what deflation has multiplied the columns by

    @classmethod
    def of(cls, m: Moments, blocks: dict[str, tuple[str, ...]]) -> Blocks:
        index = [m.at(cols) for cols in blocks.values()]
        return cls(list(blocks), index, m.n, m.s.copy(), m.g.copy(), np.array([np.trace(m.g[np.ix_(i, i)]) for i in index]), np.eye(len(m.s)))

    def copy(self) -> Blocks:
        return Blocks(self.names, self.index, self.n, self.s.copy(), self.g.copy(), self.total, self.a.copy())

    def cross(self, a: int, b: int) -> np.ndarray:
        return self.g[np.ix_(self.index[a], self.index[b])]

    def score_moments(self, w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Means and sample covariances of the block scores."""
        mu = np.array([self.s[i] @ v for i, v in zip(self.index, w, strict=True)]) / self.n
        t = np.zeros((len(self.s), len(w)))
        for k, (i, v) in enumerate(zip(self.index, w, strict=True)):
            t[i, k] = v
        return mu, (t.T @ self.g @ t - self.n * np.outer(mu, mu)) / max(self.n - 1, 1)

    def loadings(self, w: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for k, v in enumerate(w):
            x = self.cross(k, k) @ v
            tt = v @ x
            out.append(x / tt if tt > EPS else np.zeros(len(v)))
        return out

    def deflate(self, w: list[np.ndarray], p: list[np.ndarray]) -> None:
        """X becomes X (I - w p') in each block; a block with nothing left stays zero."""
        a = np.eye(len(self.s))
        for i, v, q in zip(self.index, w, p, strict=True):
            a[np.ix_(i, i)] -= np.outer(v, q)
        self.s, self.g, self.a = self.s @ a, a.T @ self.g @ a, self.a @ a


def correlations(cov: np.ndarray, eps: float = EPS) -> tuple[np.ndarray, np.ndarray]:
    """Correlation matrix, and which scores vary enough to count."""
    var = np.diag(cov)
    ok = var > eps
    sd = np.sqrt(np.where(ok, var, 1))
    return np.clip(cov / np.outer(sd, sd), -1, 1), ok


def objective(r: np.ndarray, ok: np.ndarray, metric: str = "mac") -> float:
    """Mean absolute correlation (mac) over pairs of blocks, or the root of summed squares (frobenius); NaN without a pair."""
    a, b = np.triu_indices(len(ok), 1)
    use = ok[a] & ok[b]
    if not use.any():
        return float("nan")
    v = r[a[use], b[use]]
    return float(np.abs(v).mean() if metric == "mac" else np.sqrt((v**2).sum()))


def one_component(x: Blocks, c: np.ndarray, metric: str = "mac", max_iter: int = 600, tol: float = 1e-4, seed: int = 0) -> tuple[list[np.ndarray], float]:
    """Weights of one latent component; in an iteration all blocks are updated from the same scores."""
    if len(x.index) < 2 or x.n < 3:
        raise ValueError("at least two blocks and three rows are needed")
    rng = np.random.Generator(np.random.Philox(seed))
    w = [rng.standard_normal(len(i)) for i in x.index]
    w = [v / np.linalg.norm(v) for v in w]
    before = -np.inf
    for _ in range(max_iter):
        mu, cov = x.score_moments(w)
        r, ok = correlations(cov)
        now = objective(r, ok, metric)
        if abs(now - before) < tol:
            break
        before = now
        sd = np.sqrt(np.where(ok, np.diag(cov), 1))
        new = []
        for b, i in enumerate(x.index):
            others = [a for a in range(len(w)) if a != b and ok[a]]
            if not others:
                new.append(w[b])
                continue
            g = sum((x.cross(b, a) @ w[a] - mu[a] * x.s[i]) / sd[a] for a in others) / len(others)
            new.append(sparse_unit(g, c[b]) if np.linalg.norm(g) >= 1e-16 else w[b])
        w = new
    mu, cov = x.score_moments(w)
    return w, objective(*correlations(cov), metric)


@dataclass
class Fit:
    """Weights and loadings by component and block, objectives, explained variance, p-values."""

    names: list[str]
    weights: list[list[np.ndarray]] = field(default_factory=list)
    loadings: list[list[np.ndarray]] = field(default_factory=list)
    objectives: list[float] = field(default_factory=list)
    ev_block: list[np.ndarray] = field(default_factory=list)
    ev_comp: list[float] = field(default_factory=list)
    p_values: list[float] = field(default_factory=list)


def components(x: Blocks, c: np.ndarray, metric: str = "mac", max_iter: int = 600, tol: float = 1e-4, seed: int = 0, test=None, alpha: float = 0.05, solve=one_component) -> Fit:
    """As many components as c has columns; test(blocks, weights, c, objective) gives a p-value, and the first beyond alpha ends the fit, though the first component always stays."""
    x, fit = x.copy(), Fit(x.names)
    for k in range(c.shape[1]):
        if all(np.trace(x.cross(b, b)) <= EPS * max(x.total[b], 1) for b in range(len(x.index))):
            break
        w, value = solve(x, c[:, k], metric=metric, max_iter=max_iter, tol=tol, seed=seed * 1000 + k)
        p_value = test(x, w, c[:, k], value) if test else float("nan")
        if k and p_value > alpha:
            break
        p = x.loadings(w)
        took = np.array([w[b] @ x.cross(b, b) @ w[b] * (p[b] @ p[b]) for b in range(len(w))])
        fit.weights.append(w)
        fit.loadings.append(p)
        fit.objectives.append(value)
        fit.ev_block.append(np.clip(took / np.maximum(x.total, EPS), 0, 1))
        fit.ev_comp.append(float(np.clip(took.sum() / max(x.total.sum(), EPS), 0, 1)))
        fit.p_values.append(p_value)
        x.deflate(w, p)
    return fit


def one_pca_component(x: Blocks, c: np.ndarray, metric: str = "variance", max_iter: int = 60, tol: float = 1e-4, seed: int = 0, normalize: bool = True) -> tuple[list[np.ndarray], float]:
    """Weights of one global principal component: each block's gradient towards the sum of all block scores, soft-thresholded.

    Each iteration normalises the weights, without which their size grows beyond all bounds and
    the threshold means nothing; normalize=False leaves them.
    """
    w = [np.linalg.eigh(x.cross(b, b))[1][:, -1] for b in range(len(x.index))]
    # Eigenvectors come with any sign: align all blocks with the first.
    w = [v if b == 0 or w[0] @ x.cross(0, b) @ v >= 0 else -v for b, v in enumerate(w)]
    before = -np.inf
    for _ in range(max_iter):
        g = [sum(x.cross(b, a) @ w[a] for a in range(len(w))) for b in range(len(w))]
        w = [(sparse_unit(v, c[b]) if np.linalg.norm(v) > 1e-16 else w[b]) if normalize else soft(v, c[b]) for b, v in enumerate(g)]
        t = sum(w[a] @ x.cross(a, b) @ w[b] for a in range(len(w)) for b in range(len(w)))
        now = t / max(x.total.sum(), EPS)
        if abs(now - before) < tol:
            break
        before = now
    return w, float(now)


def rotations(fit: Fit) -> list[list[np.ndarray]]:
    """For each component and block the coefficients that give its score from undeflated columns."""
    out, a = [], [np.eye(len(w)) for w in (fit.weights[0] if fit.weights else [])]
    for w, p in zip(fit.weights, fit.loadings, strict=True):
        out.append([m @ v for m, v in zip(a, w, strict=True)])
        a = [m @ (np.eye(len(v)) - np.outer(v, q)) for m, v, q in zip(a, w, p, strict=True)]
    return out


def least_squares(m: Moments, design: list[str], response: list[str], ridge: float = 0.0, free: tuple[str, ...] = ()) -> np.ndarray:
    """Coefficients of responses on the design from cross-products; ridge spares the columns in free."""
    if ridge < 0 or not np.isfinite(ridge):
        raise ValueError("ridge must be finite and not negative")
    i, j = m.at(design), m.at(response)
    g = m.g[np.ix_(i, i)] + ridge * np.diag([0.0 if c in free else 1.0 for c in design])
    if np.linalg.cond(g) < 1e14:
        return np.linalg.solve(g, m.g[np.ix_(i, j)])
    return np.linalg.lstsq(g, m.g[np.ix_(i, j)], rcond=None)[0]

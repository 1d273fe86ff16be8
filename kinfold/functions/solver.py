"""Minimisation over the probability simplex, in numpy alone, many small problems at once.

``quadratics``: min 0.5 y'Qy + c'y, y >= 0, sum y = 1, by an active set that keeps its zeros
exact. All problems of a batch step together; each has its own mask of free coordinates, and
the reduced systems are solved by triangular factors under these masks. Where a matrix isn't
positive definite on its free coordinates, the factorisation is the modified one of Gill,
Murray and Wright (1981), which raises pivots until it is.

``Search``: smooth functions by quadratic models and backtracking. It holds a state for each
problem and asks for value, gradient and Hessian at one point of each; whoever has the data, in
one place or summed over many, gives them and gets the next points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Settings:
    outer: int = 100
    inner: int = 10
    kkt: float = 1e-8
    multiplier: float = 1e-10
    zero_step: float = 1e-12
    trials: int = 10
    decrease: float = 1e-4
    shrink: float = 0.9
    epsilon: float = 1e-8


@dataclass
class Solution:
    x: np.ndarray
    objective: float
    iterations: int
    condition: float
    converged: bool


def factors(a: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit lower triangles and diagonals of the symmetric matrices a[m] on their free coordinates;
    the others stand as if they were those of the identity. Pivots are raised where needed."""
    m, n, _ = a.shape
    both = free[:, :, None] & free[:, None, :]
    size = np.where(both, np.abs(a), 0.0)
    diagonal = np.einsum("mii->mi", size).max(1)
    off = np.where(np.eye(n, dtype=bool), 0.0, size).max((1, 2))
    tiny, k = np.finfo(float).eps, free.sum(1)
    spread = np.sqrt(np.maximum(k.astype(float) ** 2 - 1, 1))
    least = tiny * np.maximum(1.0, diagonal + off)
    bound = np.maximum(np.maximum(diagonal, np.where(k > 1, off / spread, 0.0)), tiny)
    rest, low, d = np.where(both, a, 0.0), np.zeros_like(a), np.ones((m, n))
    for j in range(n):
        # rest[:, j:, j:] is what the columns before have left
        below = rest[:, j + 1 :, j]
        theta = np.abs(below).max(1, initial=0.0)
        pivot = np.maximum(np.maximum(np.abs(rest[:, j, j]), theta**2 / bound), least)
        d[:, j] = np.where(free[:, j], pivot, 1.0)
        low[:, j, j] = 1.0
        low[:, j + 1 :, j] = below / d[:, j, None]
        rest[:, j + 1 :, j + 1 :] -= low[:, j + 1 :, j, None] * below[:, None, :]
    return low, d


def solve(low: np.ndarray, d: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of L D L' x = b for right sides b[m, :, k]."""
    x, n = b.copy(), b.shape[1]
    for i in range(1, n):
        x[:, i] -= (low[:, i, :i, None] * x[:, :i]).sum(1)
    x /= d[:, :, None]
    for i in range(n - 2, -1, -1):
        x[:, i] -= (low[:, i + 1 :, i, None] * x[:, i + 1 :]).sum(1)
    return x


def quadratics(q: np.ndarray, c: np.ndarray, y: np.ndarray, steps: int, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, steps taken and whether it is optimal, for each problem q[m], c[m] from y[m] on."""
    y = y.astype(float).copy()
    free, taken, done = y > 0, np.full(len(y), steps), np.zeros(len(y), bool)
    live = np.arange(len(y))
    for k in range(steps):
        if not len(live):
            break
        f, g = free[live], np.einsum("mij,mj->mi", q[live], y[live]) + c[live]
        both = solve(*factors(q[live], f), np.stack([np.where(f, g, 0.0), f.astype(float)], 2))
        rate = both[:, :, 0].sum(1) / both[:, :, 1].sum(1)
        p = np.where(f, rate[:, None] * both[:, :, 1] - both[:, :, 0], 0.0)
        still = np.abs(p).max(1) <= s.zero_step
        # at rest: optimal, or the coordinate that gains most is let go
        held = np.where(f, np.inf, g - rate[:, None])
        worst = held.argmin(1)
        best = still & (held.min(1) >= -s.multiplier)
        taken[live[best]], done[live[best]] = k, True
        loose = np.flatnonzero(still & ~best)
        free[live[loose], worst[loose]] = True
        # moving: as far as the first coordinate that reaches zero
        go = np.flatnonzero(~still)
        z, step = y[live[go]], p[go]
        limit = np.where(step < 0, z / np.where(step < 0, -step, 1.0), np.inf)
        stop = limit.argmin(1)
        reach = limit[np.arange(len(go)), stop]
        z = np.maximum(z + np.minimum(1.0, reach)[:, None] * step, 0)
        hit = np.flatnonzero(reach < 1.0)
        z[hit, stop[hit]] = 0.0
        free[live[go[hit]], stop[hit]] = False
        y[live[go]] = z
        live = live[~best]
    return y, taken, done


def quadratic(q: np.ndarray, c: np.ndarray, y: np.ndarray, steps: int, s: Settings = Settings()) -> tuple[np.ndarray, int, bool]:
    """One problem."""
    y, taken, done = quadratics(q[None], c[None], y[None], steps, s)
    return y[0], int(taken[0]), bool(done[0])


def optimal(x: np.ndarray, g: np.ndarray, tol: float) -> np.ndarray:
    rate = (x * g).sum(1, keepdims=True)
    return np.where(x == 0, g >= rate - tol, np.abs(g - rate) <= tol).all(1)


def condition(x: np.ndarray, g: np.ndarray, h: np.ndarray, tol: float) -> np.ndarray:
    """Condition numbers of the Hessians over the coordinates not held at 0; infinite where one is
    singular there. Problems with the same such coordinates are taken together."""
    out = np.full(len(x), np.nan)
    free = ~((x == 0) & (g >= (x * g).sum(1, keepdims=True) + tol))
    for pattern in np.unique(free, axis=0):
        rows, at = np.flatnonzero((free == pattern).all(1)), np.flatnonzero(pattern)
        w = np.linalg.eigvalsh(h[np.ix_(rows, at, at)])
        singular = w[:, 0] <= 1e-14 * np.maximum(w[:, -1], 1e-300)
        out[rows] = np.where(singular, np.inf, w[:, -1] / np.where(singular, 1.0, w[:, 0]))
    return out


class Search:
    """States of the searches from x[m] on. ``z`` are the points at which value, gradient and Hessian
    are wanted next, of the problems in ``live``; ``advance`` takes them."""

    #: Columns of a state: where it stands, the end of its step, what is asked for, and numbers.
    VECTORS, NUMBERS = ("x", "y", "z"), ("f", "slope", "a", "tries", "iterations", "condition", "status")

    def __init__(self, x: np.ndarray, s: Settings = Settings()) -> None:
        self.s, m = s, len(x)
        self.x, self.y, self.z = (x.astype(float).copy() for _ in range(3))
        self.f, self.slope, self.a, self.condition = np.full(m, np.inf), np.zeros(m), np.ones(m), np.full(m, np.nan)
        self.tries, self.iterations, self.status = (np.zeros(m, int) for _ in range(3))  # status 1: optimal, 2: out of steps

    @property
    def live(self) -> np.ndarray:
        return np.flatnonzero(self.status == 0)

    @property
    def converged(self) -> np.ndarray:
        return self.status == 1

    def advance(self, rows: np.ndarray, f: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        """Value, gradient and Hessian at z of the problems ``rows``."""
        s = self.s
        taken = (self.tries[rows] == 0) | (f <= self.f[rows] + self.a[rows] * s.decrease * self.slope[rows]) | (self.tries[rows] >= s.trials)
        back = rows[~taken]
        self.a[back] *= s.shrink
        self.tries[back] += 1
        self.z[back] = np.maximum(self.x[back] + self.a[back, None] * (self.y[back] - self.x[back]), 0)
        rows, f, g, h = rows[taken], f[taken], g[taken], h[taken]
        self.x[rows], self.f[rows] = self.z[rows] / self.z[rows].sum(1, keepdims=True), f
        best = optimal(self.x[rows], g, s.kkt)
        over = ~best & (self.iterations[rows] >= s.outer)
        self.status[rows[best]], self.status[rows[over]] = 1, 2
        self.condition[rows[best]] = condition(self.x[rows[best]], g[best], h[best], s.kkt)
        on = ~best & ~over
        rows, g, h = rows[on], g[on], h[on]
        x = self.x[rows]
        y, _, _ = quadratics(h, g - np.einsum("mij,mj->mi", h, x), x, s.inner, s)
        self.y[rows], self.z[rows], self.slope[rows] = y, y, (g * (y - x)).sum(1)
        self.a[rows], self.tries[rows] = 1.0, 1
        self.iterations[rows] += 1


def sequential(parts: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], x: np.ndarray, s: Settings = Settings()) -> Search:
    """Searches to their ends. parts(z, rows): value, gradient and Hessian of those problems."""
    search = Search(x, s)
    while len(rows := search.live):
        search.advance(rows, *parts(search.z[rows], rows))
    return search


def mixture_sums(p: np.ndarray, there: np.ndarray, z: np.ndarray, e: float) -> tuple[np.ndarray, ...]:
    """Over the sites of p[m, v, 9] that are ``there`` (elsewhere p is 0): how many, the sum of minus
    log-likelihoods of the mixtures with weights z[m], its gradients and Hessians."""
    d = e + np.matmul(p, z[:, :, None])[:, :, 0]
    r = p / d[:, :, None]
    return there.sum(1), -np.where(there, np.log(d), 0.0).sum(1), -r.sum(1), np.matmul(r.transpose(0, 2, 1), r)


def mixtures(p: np.ndarray, there: np.ndarray, x: np.ndarray, s: Settings = Settings()) -> Search:
    """Maximum likelihood of mixture weights, for each m the rows p[m] of component likelihoods."""

    def parts(z: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        some = rows if len(rows) < len(p) else slice(None)
        n, f, g, h = mixture_sums(p[some], there[some], z, s.epsilon)
        return f / n, g / n[:, None], h / n[:, None, None]

    return sequential(parts, x, s)


def mixture(p: np.ndarray, x: np.ndarray, s: Settings = Settings()) -> Solution:
    r = mixtures(p[None], np.ones((1, len(p)), bool), x[None], s)
    return Solution(r.x[0], float(r.f[0]), int(r.iterations[0]), float(r.condition[0]), bool(r.converged[0]))


def frequencies(lik: np.ndarray, there: np.ndarray, s: Settings = Settings()) -> Search:
    """Allele frequencies of sites by maximum likelihood under random mating. lik[m, k, i, j] is the
    likelihood of sample k having alleles i, j (symmetric); samples that aren't ``there`` don't count."""
    a, e, n = lik.shape[-1], s.epsilon, there.sum(1)
    lik = np.where(there[:, :, None, None], lik, 0.0)

    def parts(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        own, some, count = lik[rows], there[rows], n[rows]
        lx = np.einsum("mkij,mj->mki", own, x)
        d = e + np.einsum("mki,mi->mk", lx, x)
        r = lx / d[:, :, None]
        f = -np.where(some, np.log(d), 0.0).sum(1) / count
        h = 2 * np.matmul(r.transpose(0, 2, 1), r) - np.einsum("mkij,mk->mij", own, 1 / d)
        return f, -2 * r.sum(1) / count[:, None], 2 * h / count[:, None, None]

    return sequential(parts, np.full((len(lik), a), 1 / a), Settings(s.outer, a + 1))


def expected_frequencies(lik: np.ndarray, there: np.ndarray, rounds: int) -> np.ndarray:
    """The same likelihood by so many rounds of expectation-maximisation from equal frequencies on,
    without a stop: where an allele hardly occurs they can still be some 1e-3 from the maximum."""
    lik = np.where(there[:, :, None, None], lik, 0.0)
    x, n = np.full((len(lik), lik.shape[-1]), 1 / lik.shape[-1]), there.sum(1, keepdims=True)
    for _ in range(rounds):
        ends = np.einsum("mkij,mj->mki", lik, x) * x[:, None]
        whole = np.where(there, ends.sum(2), 1.0)
        x = (ends / whole[:, :, None]).sum(1) / n
    return x


def least_squares(q: np.ndarray, c: np.ndarray, x: np.ndarray, s: Settings = Settings()) -> tuple[np.ndarray, ...]:
    """Weights that are nearest in the Brier sense, min d'Qd + 2c'd + 1, for each c[m] from x[m] on:
    weights, objective, steps, condition and whether they are optimal."""
    all_ = np.broadcast_to(q, (len(c), *q.shape))
    y, k, done = quadratics(all_, c, x, s.outer, s)
    g = y @ q + c
    cond = np.where(done, condition(y, g, all_, s.kkt), np.nan)
    return y, (y * (y @ q)).sum(1) + 2 * (c * y).sum(1) + 1, k, cond, done


def start(same: bool) -> np.ndarray:
    """Where the search begins: a sample with itself, or two samples."""
    x = np.full(9, 1 / 9)
    if same:
        x[:] = 0
        x[[0, 6]] = 0.5
    return x


def starts(same: np.ndarray) -> np.ndarray:
    return np.where(np.asarray(same)[:, None], start(True), start(False))

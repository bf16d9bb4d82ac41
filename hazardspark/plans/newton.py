"""Damped Newton minimisation, and a numpy kernel of the partial likelihood for data that fit a task."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

Loss = Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]]


class Singular(ValueError):
    """The information matrix can't be inverted."""


@dataclass(frozen=True)
class Optimum:
    beta: np.ndarray
    loss_init: float
    loss: float
    gradient: np.ndarray
    hessian: np.ndarray
    score: float
    evaluations: int


#: Share of a term's own information, given the terms before it, under which it counts as aliased with them.
ALIASED = 1e-10


def factor(h: np.ndarray, tolerance: float = ALIASED) -> tuple[np.ndarray, np.ndarray]:
    """L (unit lower triangle) and pivots d of L diag(d) L' for the symmetric h, a term after another; d is 0 where what is left of a diagonal value is under tolerance times that value."""
    n = len(h)
    rest, l, d = np.array(h, dtype=float), np.eye(n), np.zeros(n)
    least = tolerance * np.abs(np.diag(rest))
    for i in range(n):
        pivot = rest[i, i]
        if pivot > least[i] and np.isfinite(pivot):
            d[i] = pivot
            l[i + 1 :, i] = rest[i + 1 :, i] / pivot
            rest[i + 1 :, i + 1 :] -= np.outer(l[i + 1 :, i], rest[i, i + 1 :])
    return l, d


def _solved(l: np.ndarray, d: np.ndarray, g: np.ndarray) -> np.ndarray:
    """x of L diag(d) L' x = g with 0 for aliased terms; g may have several columns."""
    y = np.array(g, dtype=float)
    for i in range(len(d)):
        y[i] -= l[i, :i] @ y[:i]
    for i in range(len(d) - 1, -1, -1):
        y[i] = (y[i] / d[i] if d[i] else 0 * y[i]) - l[i + 1 :, i] @ y[i + 1 :]
    return y


def aliased(h: np.ndarray) -> np.ndarray:
    """Which terms have no information of their own beside those before them."""
    return factor(h)[1] == 0


def inverse(h: np.ndarray) -> np.ndarray:
    """Inverse over the terms that are not aliased, zero in rows and columns of the others."""
    l, d = factor(np.nan_to_num(h))
    keep = (d > 0).astype(float)
    out = _solved(l, d, np.diag(keep)) * keep
    return (out + out.T) / 2


def solve(h: np.ndarray, g: np.ndarray, singular_ok: bool = False) -> np.ndarray:
    """h^-1 g; aliased terms, whose part is 0, are an error unless singular_ok."""
    if not singular_ok and (not np.isfinite(h).all() or aliased(h).any()):
        raise Singular("the information matrix is singular")
    l, d = factor(np.nan_to_num(h))
    return _solved(l, d, g)


def newton(loss: Loss, init: np.ndarray, maxiter: int = 20, eps: float = 1e-9, singular_ok: bool = False) -> Optimum:
    """At most maxiter evaluations; the last candidate is not evaluated, so maxiter = 1 returns init.

    A candidate that does not lower the loss is pulled towards the best one. Ends early when the candidate no
    longer moves by more than eps.
    """
    return newton_many(lambda at: {0: loss(at[0])}, {0: init}, maxiter, eps, singular_ok)[0]


def newton_many(loss: Callable[[dict], dict], inits: dict, maxiter: int = 20, eps: float = 1e-9, singular_ok: bool = False) -> dict:
    """newton for many problems at once: loss takes a candidate for each key that is not done and gives (f, g, h) for each."""
    if maxiter < 1:
        raise ValueError("maxiter must be 1 or more")
    candidate = {k: np.asarray(b, dtype=float) for k, b in inits.items()}
    state = {k: [b, np.inf, None, None, 0, 0] for k, b in candidate.items()}  # best, its value, (g, h) there, the first (f, score), rejections, evaluations
    going = list(candidate)
    for _ in range(maxiter):
        if not going:
            break
        found = loss({k: candidate[k] for k in going})
        left = []
        for k in going:
            best, value, at_best, first, rejected, evaluations = state[k]
            f, g, h = found[k]
            step = solve(h, g, singular_ok)
            first = first or (f, float(step @ g))
            if f < value or at_best is None:
                best, value, at_best, rejected = candidate[k], f, (g, h), 0
                candidate[k] = best - step
            else:
                rejected += 1
                candidate[k] = (candidate[k] + rejected * best) / (1 + rejected)
            state[k] = [best, value, at_best, first, rejected, evaluations + 1]
            if np.abs(candidate[k] - best).max(initial=0.0) > eps * (1 + np.abs(best).max(initial=0.0)):
                left.append(k)
        going = left
    return {k: Optimum(best, first[0], value, *at_best, first[1], n) for k, (best, value, at_best, first, _, n) in state.items()}


class Kernel:
    """Rows in time order, and the loss, gradient and Hessian of their partial likelihood."""

    def __init__(self, stop, event, x, weight=None, start=None, ties: str = "efron", alpha: float = 0.0, offset=None):
        """With start, risk sets are of intervals: a row counts in the nodes of a binary tree over death times that make up its own."""
        if ties not in ("efron", "breslow"):
            raise ValueError("ties is efron or breslow")
        stop, event, x = np.asarray(stop), np.asarray(event), np.asarray(x, dtype=float)
        self.w = np.ones(len(stop)) if weight is None else np.asarray(weight, dtype=float)
        # the likelihood does not change when covariates are centred, and rounding is the better for it
        total = self.w.sum()
        self.x = x - (self.w @ x / total if total > 0 else 0.0)
        self.offset = np.zeros(len(stop)) if offset is None else np.asarray(offset, dtype=float)
        self.ties, self.alpha, dead = ties, alpha, event == 1
        self.times = np.unique(stop[dead & (self.w > 0)])
        count = len(self.times)
        group = np.searchsorted(self.times, stop)
        exact = (group < count) & (self.times[np.minimum(group, count - 1)] == stop) if count else np.zeros(len(stop), bool)
        dead &= exact
        self.dead, self.group = np.flatnonzero(dead), group[dead]
        if start is None:
            own = np.flatnonzero(exact & ~dead)
            self.levels = [(own, group[own])]
        else:
            first, last = np.searchsorted(self.times, np.asarray(start), side="right"), np.searchsorted(self.times, stop, side="right") - dead
            self.levels = []
            for k in range(max(1, count.bit_length())):
                low, high = (first + (1 << k) - 1) >> k, last >> k
                left, right = np.flatnonzero((low < high) & (low % 2 == 1)), np.flatnonzero((low < high) & (high % 2 == 1))
                self.levels.append((np.concatenate([left, right]), np.concatenate([low[left], high[right] - 1])))
        deaths = np.bincount(self.group, weights=self.w[self.dead], minlength=count)
        if ties == "efron":
            n = np.rint(deaths).astype(int)
            self.of = np.repeat(np.arange(count), n)
            self.c = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1) / np.repeat(np.maximum(n, 1), n)
            self.times_w = np.ones(n.sum())
        else:
            self.of, self.c, self.times_w = np.arange(count), np.ones(count), deaths

    def _scaled(self, lp: np.ndarray, rows: np.ndarray, groups: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Per group: its greatest lp, and the sums of w exp(lp - that) times 1, x, x x'."""
        top = np.full(count, -np.inf)
        np.maximum.at(top, groups, lp[rows])
        r, x = self.w[rows] * np.exp(lp[rows] - top[groups]), self.x[rows]
        v = np.concatenate([r[:, None], r[:, None] * x, r[:, None] * (x[:, :, None] * x[:, None, :]).reshape(len(r), x.shape[1] ** 2)], axis=1)
        out = np.zeros((count, v.shape[1]))
        np.add.at(out, groups, v)
        return top, out

    def __call__(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        d, count = self.x.shape[1], len(self.times)
        lp = self.x @ beta + self.offset
        own, of_dead = self._scaled(lp, self.dead, self.group, count)
        top, parts = own, []
        for k, (rows, nodes) in enumerate(self.levels):
            scale, found = self._scaled(lp, rows, nodes, (count >> k) + 1)
            at = np.arange(count) >> k
            parts.append((scale[at], found[at]))
            top = np.maximum(top, scale[at])
        alive = sum(found * np.exp(scale - top)[:, None] for scale, found in parts)
        of_dead = of_dead * np.exp(own - top)[:, None]
        s = alive[self.of] + self.c[:, None] * of_dead[self.of]
        s0, s1, s2 = s[:, 0], s[:, 1 : 1 + d], s[:, 1 + d :].reshape(-1, d, d)
        mean = s1 / s0[:, None]
        wd = self.w[self.dead]
        loss = float((self.times_w * (np.log(s0) + top[self.of])).sum() - wd @ lp[self.dead] + self.alpha * beta @ beta)
        g = self.times_w @ mean - wd @ self.x[self.dead] + 2 * self.alpha * beta
        h = np.einsum("t,tij->ij", self.times_w, s2 / s0[:, None, None] - mean[:, :, None] * mean[:, None, :]) + 2 * self.alpha * np.eye(d)
        return loss, g, h

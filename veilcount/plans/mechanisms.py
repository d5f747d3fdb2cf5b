"""Gaussian mechanisms for one attribute subset, each of privacy cost 1 at sigma^2 = 1.

A mechanism answers: loss (the weighted variance L at cost 1), measure, reconstruct
and the variance of a part's rows.  All are numpy on arrays of the marginal's size.
"""

from __future__ import annotations

import hashlib
from functools import cached_property, reduce

import numpy as np

from veilcount.plans.query import KronPart, MatrixPart, mode

Part = MatrixPart | KronPart
GAP, ROUNDS, MAX_RANK = 1e-6, 600, 1600


class Scalar:
    """The empty subset: the total count."""

    kind = "scalar"

    def __init__(self, parts: list[Part]):
        self.loss = float(sum(p.weight * np.sum(p.dense() ** 2) for p in parts))

    def measure(self, x: np.ndarray, sigma: float, rng: np.random.Generator | None) -> np.ndarray:
        return x.reshape(-1) + (sigma * rng.standard_normal(1) if rng is not None else 0.0)

    def reconstruct(self, omega: np.ndarray) -> np.ndarray:
        return omega

    def variances(self, part: Part) -> np.ndarray:
        return np.sum(part.dense() ** 2, axis=1)

    def answerable(self, part: Part) -> bool:
        return True


class Fourier:
    """Independent noise on the frequencies that have no zero coordinate, one of each conjugate pair; the optimum in closed form.

    The loss of a single Kronecker part is a product over its attributes; the grid of frequencies is made when it is asked for.
    """

    kind = "fourier"

    def __init__(self, shape: tuple[int, ...], parts: list[Part]):
        self.shape, self.parts = shape, parts
        if len(parts) == 1 and isinstance(parts[0], KronPart):
            own = [f for f, k in zip(parts[0].factors, parts[0].inside, strict=True) if k]
            roots = [np.abs(np.fft.ifft(f, axis=1)[:, 1:]) ** 2 for f in own]
            self.loss = float(parts[0].weight * parts[0].scale * np.prod([np.sqrt(e.sum(axis=0)).sum() for e in roots]) ** 2)
        else:
            self.loss = float(np.sqrt(self.c).sum() ** 2)

    @cached_property
    def _tuned(self) -> tuple[np.ndarray, np.ndarray]:
        grid = np.indices(self.shape).reshape(len(self.shape), -1)
        conj = (-grid) % np.array(self.shape)[:, None]
        flat, other = np.ravel_multi_index(grid, self.shape), np.ravel_multi_index(conj, self.shape)
        tuned = np.all(grid > 0, axis=0) & (flat <= other)
        return flat[tuned], other[tuned]

    @property
    def at(self) -> np.ndarray:
        return self._tuned[0]

    @property
    def conj(self) -> np.ndarray:
        return self._tuned[1]

    @cached_property
    def mult(self) -> np.ndarray:
        return np.where(self.at == self.conj, 1.0, 4.0)

    @cached_property
    def c(self) -> np.ndarray:
        c = np.zeros(len(self.at))
        for p in self.parts:
            c += p.weight * self.mult * np.asarray(p.energy()).reshape(-1)[self.at]
        return c

    @cached_property
    def theta(self) -> np.ndarray:
        root = np.sqrt(self.c)
        floor = np.maximum(root, max(root.max(initial=0.0) * 1e-5, 1e-5))
        return floor.sum() / floor  # the costs 1 / theta add up to 1

    def measure(self, x: np.ndarray, sigma: float, rng: np.random.Generator | None) -> np.ndarray:
        z = np.fft.fftn(x.reshape(self.shape)).reshape(-1)[self.at]
        if rng is not None:
            s = sigma * np.sqrt(self.theta)
            noise = s * rng.standard_normal(len(s)) + 1j * s * rng.standard_normal(len(s))
            z = z + np.where(self.at == self.conj, noise.real, noise)
        return z

    def reconstruct(self, omega: np.ndarray) -> np.ndarray:
        z = np.zeros(int(np.prod(self.shape)), complex)
        z[self.at] = omega
        z[self.conj] = np.conj(omega)
        own = self.at[self.at == self.conj]
        z[own] = z[own].real
        return np.fft.ifftn(z.reshape(self.shape)).real.reshape(-1)

    def variances(self, part: Part) -> np.ndarray:
        if isinstance(part, KronPart):  # attribute by attribute; no array of rows by cells
            t = np.zeros(int(np.prod(self.shape)))
            t[self.at] = self.mult * self.theta
            t = t.reshape([f.shape[1] for f in part.factors])
            for i, f in enumerate(part.factors):
                t = mode(t, np.abs(np.fft.ifft(f, axis=1)) ** 2, i)
            return t.reshape(-1)
        e = np.asarray(part.energy(per_row=True))
        e = e.reshape(e.shape[0], -1)[:, self.at]
        # a real frequency has noise theta once, a pair twice the energy of 2 theta
        return e @ (self.mult * self.theta)

    def sum_variance(self, part: Part) -> float:
        return float(np.asarray(part.energy()).reshape(-1)[self.at] @ (self.mult * self.theta))

    def answerable(self, part: Part) -> bool:
        return True


def certified(gram: np.ndarray | None, rows: np.ndarray | None, gap: float = GAP, rounds: int = ROUNDS, max_rank: int = MAX_RANK) -> tuple[np.ndarray, float, float] | None:
    """(B, L, gap) of the best Gaussian mechanism for weighted rows, within their range; None if the rank is over max_rank.

    Multiplicative updates of the dual (weights on cells): at weights lam, with G = C' diag(lam) C, the dual value
    (tr G^(1/2))^2 / sum(lam) bounds L from below, and the scaled primal from above.
    """
    if rows is not None and len(rows) < rows.shape[1]:
        w, u = np.linalg.eigh(rows @ rows.T)
        keep = w > max(w.max(initial=0.0), 0) * 1e-11
        if not keep.any():
            return np.zeros((0, rows.shape[1])), 0.0, 0.0
        if keep.sum() > max_rank:
            return None
        c = rows.T @ u[:, keep]
    else:
        g = rows.T @ rows if gram is None else gram
        w, u = np.linalg.eigh(g)
        keep = w > max(w.max(initial=0.0), 0) * 1e-11
        if not keep.any():
            return np.zeros((0, len(g))), 0.0, 0.0
        if keep.sum() > max_rank:
            return None
        c = u[:, keep] * np.sqrt(w[keep])
    n, lam, power, best, before = len(c), np.full(len(c), 1.0 / len(c)), 2.0, (None, np.inf), -np.inf
    for _ in range(rounds):
        w, e = np.linalg.eigh(c.T @ (lam[:, None] * c))
        w = np.maximum(w, w.max() * 1e-15)
        t = np.sqrt(w).sum()
        y = (c @ e) * w**-0.25
        v = np.einsum("ij,ij->i", y, y)
        dual, primal = t * t / lam.sum(), t * v.max()
        if primal < best[1]:
            best = y.T / np.sqrt(v.max()), primal
        if best[1] / dual - 1 < gap:
            before = max(before, dual)
            break
        if dual < before * (1 - 1e-12):
            power = 1.0
        before = max(before, dual)
        lam = lam * v**power
        lam /= lam.sum()
    del n
    return best[0], float(best[1]), float(best[1] / before - 1)


def positive(matrix: np.ndarray, slack: float = 1e-9) -> bool:
    """Whether a symmetric matrix has no negative eigenvalue, but for a share of its trace."""
    try:
        np.linalg.cholesky(matrix + (slack * max(np.trace(matrix), 0.0) / len(matrix) + 1e-300) * np.eye(len(matrix)))
        return True
    except np.linalg.LinAlgError:
        return False


class Dense:
    """The certified optimum on the range of the workload's rows."""

    kind = "convex"

    def __init__(self, b: np.ndarray, loss: float, gap: float):
        self.b, self.loss, self.gap = b, loss, gap
        self.pinv = np.linalg.pinv(b) if len(b) else np.zeros(b.T.shape)

    @classmethod
    def solve(cls, parts: list[Part], full_rank: bool = False, **options) -> Dense | None:
        stacked = np.vstack([np.sqrt(p.weight) * p.dense() for p in parts])
        if full_rank:
            shape = parts[0].shape
            p = reduce(np.kron, [np.eye(d) - 1 / d for d in shape], np.ones((1, 1)))
            stacked = np.vstack([stacked, 1e-3 * np.sqrt((stacked**2).sum() / p.shape[0]) * p])
        found = certified(None, stacked, **options) if len(stacked) <= 4 * stacked.shape[1] else certified(stacked.T @ stacked, None, **options)
        return None if found is None else cls(*found)

    def measure(self, x: np.ndarray, sigma: float, rng: np.random.Generator | None) -> np.ndarray:
        out = self.b @ x.reshape(-1)
        return out + sigma * rng.standard_normal(len(out)) if rng is not None else out

    def reconstruct(self, omega: np.ndarray) -> np.ndarray:
        return self.pinv @ omega

    def variances(self, part: Part) -> np.ndarray:
        return np.sum((part.dense() @ self.pinv) ** 2, axis=1)

    def answerable(self, part: Part) -> bool:
        rows = part.dense()
        return bool(np.allclose(rows @ self.pinv @ self.b, rows, atol=1e-6 * max(1.0, np.abs(rows).max(initial=0.0))))


class Kron:
    """A product of certified mechanisms, one per attribute."""

    kind = "kron"

    def __init__(self, factors: list[Dense], parts: list[KronPart]):
        self.factors = factors
        self.loss = float(sum(p.weight * self.sum_variance(p) for p in parts))
        self.shape = tuple(f.b.shape[1] for f in factors)

    @classmethod
    def solve(cls, parts: list[KronPart], memo: dict, passes: int = 2) -> Kron | None:
        """Alternates over attributes, weighing each query by what its other attributes cost at present."""
        axes = len(parts[0].shape)
        factors: list[Dense | None] = [None] * axes
        for turn in range(passes if len(parts) > 1 else 1):
            for i in range(axes):
                g = 0.0
                for p in parts:
                    grams = p.grams()
                    rest = [np.trace(grams[k]) if factors[k] is None else np.trace(factors[k].pinv.T @ grams[k] @ factors[k].pinv) for k in range(axes) if k != i]
                    g = g + p.weight * p.scale * float(np.prod(rest)) * grams[i]
                scale = np.trace(g)
                if scale <= 0:
                    return None
                g = g / scale
                key = hashlib.sha256(np.round(g, 12).tobytes()).digest()
                if key not in memo:
                    memo[key] = certified(g, None)
                if memo[key] is None:
                    return None
                factors[i] = Dense(*memo[key])
            del turn
        return cls(factors, parts)

    def measure(self, x: np.ndarray, sigma: float, rng: np.random.Generator | None) -> np.ndarray:
        t = x.reshape(self.shape)
        for i, f in enumerate(self.factors):
            t = mode(t, f.b, i)
        return t + sigma * rng.standard_normal(t.shape) if rng is not None else t

    def reconstruct(self, omega: np.ndarray) -> np.ndarray:
        t = omega.reshape([f.pinv.shape[1] for f in self.factors])
        for i, f in enumerate(self.factors):
            t = mode(t, f.pinv, i)
        return t.reshape(-1)

    def _per_factor(self, part: KronPart) -> list[np.ndarray]:
        own = iter(self.factors)
        return [np.sum((f @ next(own).pinv) ** 2, axis=1) if k else f[:, 0] ** 2 for f, k in zip(part.factors, part.inside, strict=True)]

    def variances(self, part: Part) -> np.ndarray:
        if isinstance(part, KronPart):
            return reduce(lambda a, b: np.multiply.outer(a, b).reshape(-1), self._per_factor(part), np.ones(1))
        whole = reduce(np.kron, [f.pinv for f in self.factors], np.ones((1, 1)))
        return np.sum((part.dense() @ whole) ** 2, axis=1)

    def sum_variance(self, part: KronPart) -> float:
        return float(np.prod([v.sum() for v in self._per_factor(part)]))

    def answerable(self, part: Part) -> bool:
        if isinstance(part, KronPart):
            own = iter(self.factors)
            return all(not k or Dense.answerable(next(own), MatrixPart(f, (), 1.0)) for f, k in zip(part.factors, part.inside, strict=True))
        whole = reduce(np.kron, [f.pinv @ f.b for f in self.factors], np.ones((1, 1)))
        return bool(np.allclose(part.dense() @ whole, part.dense(), atol=1e-6))

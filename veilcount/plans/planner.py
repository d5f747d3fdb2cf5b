"""Planner: decompose a workload, choose a mechanism per subset, split the budget.

Budget split: with L_A the loss of subset A at cost 1, sigma^2_A = (sum of sqrt L) / (cost x sqrt(L_A)),
so that the costs 1 / sigma^2_A add up to the budget and the total weighted variance is (sum sqrt L)^2 / cost.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np

from veilcount.domain import Domain, submasks
from veilcount.plans.budget import shares
from veilcount.plans.mechanisms import Dense, Fourier, Kron, Part, Scalar
from veilcount.plans.query import KronPart, Query
from veilcount.plans.workload import Workload

#: Own solvers by name, besides best, fourier, convex and kron: from the shape of a subset and its parts to a mechanism.
SOLVERS: dict[str, Callable[[tuple[int, ...], list[Part]], object] | None] = dict.fromkeys(("best", "fourier", "convex", "kron"))
#: Loss below which a subset carries nothing of the workload.
NOTHING = 1e-9
DENSE_LIMIT = 2000


@dataclass
class Plan:
    domain: Domain
    workload: Workload
    cost: float
    parts: dict[int, list[tuple[int, Part]]]  # mask -> (query number, part)
    mechanisms: dict[int, object]
    sigma2: dict[int, float]
    notes: list[str] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)

    @property
    def measured(self) -> list[int]:
        """Subsets that get a share of the budget; the others carry nothing and are never released."""
        return [m for m in self.mechanisms if m in self.sigma2]

    @property
    def total_variance(self) -> float:
        return float(sum(np.sqrt(self.mechanisms[m].loss) for m in self.measured) ** 2 / self.cost)

    @property
    def rmse(self) -> float:
        return float(np.sqrt(self.total_variance / self.workload.n_rows))

    def spent(self) -> float:
        return float(sum(1 / s for s in self.sigma2.values()))

    def measured_parts(self, query: Query) -> list[tuple[int, Part]]:
        """(mask, part) of a query, but for empty parts; raises if one was not measured."""
        out = []
        for m in submasks(query.mask):
            part = query.part(m)
            if part.square() <= 1e-18:
                continue
            if m not in self.sigma2 or not self.mechanisms[m].answerable(part):
                raise KeyError(f"the part on attributes {self.domain.attrs(m)} was not measured")
            out.append((m, part))
        return out

    def variances(self, query: Query) -> np.ndarray:
        """Variance of each row's answer; raises if a part of the query was not measured."""
        out = np.zeros(query.n_rows)
        for m, part in self.measured_parts(query):
            out += self.sigma2[m] * self.mechanisms[m].variances(part)
        return out


def register(name: str, make: Callable[[tuple[int, ...], list[Part]], object]) -> None:
    """A solver for ``plan`` by name. Its mechanisms have loss (at cost 1), measure, reconstruct, variances and answerable."""
    if name in SOLVERS and SOLVERS[name] is None:
        raise ValueError(f"the name {name!r} is taken")
    SOLVERS[name] = make


def decompose(workload: Workload) -> dict[int, list[tuple[int, Part]]]:
    out: dict[int, list[tuple[int, Part]]] = {}
    for i, q in enumerate(workload.queries):
        for m in submasks(q.mask):
            out.setdefault(m, []).append((i, q.part(m)))
    return dict(sorted(out.items(), key=lambda x: (x[0].bit_count(), x[0])))


def _key(parts: list[Part]) -> bytes:
    """Subsets with the same sizes and the same weighted rows share a mechanism."""
    h = hashlib.sha256()
    for p in parts:
        h.update(repr((type(p).__name__, p.shape, round(p.weight, 12))).encode())
        if isinstance(p, KronPart):
            h.update(repr(round(p.scale, 12)).encode())
            for g in p.grams():
                h.update(np.round(g, 12).tobytes())
        else:
            h.update(np.round(p.rows, 12).tobytes())
    return h.digest()


def merged(parts: list[Part]) -> list[Part]:
    """Kronecker parts that differ in weight and collapsed attributes only, as one."""
    out: dict[bytes, Part] = {}
    for i, p in enumerate(parts):
        if isinstance(p, KronPart):
            own = [f for f, k in zip(p.factors, p.inside, strict=True) if k]
            key = b"".join(np.round(g, 12).tobytes() for g in p.grams())
            before = out[key].weight if key in out else 0.0
            out[key] = KronPart(own, [True] * len(own), p.shape, before + p.weight * p.scale)
        else:
            out[repr(i).encode()] = p
    return list(out.values())


def choose(mask: int, parts: list[Part], solver: str, factors: dict, dense_limit: int, full_rank: bool, notes: list[str]):
    if not mask:
        return Scalar(parts)
    shape = parts[0].shape
    if SOLVERS.get(solver) is not None:
        return SOLVERS[solver](shape, parts)
    parts = [p for p in merged(parts) if p.square() > 0] or parts[:1]
    fourier = Fourier(shape, parts)
    if solver == "fourier" or fourier.loss <= NOTHING:
        return fourier
    found = [fourier]
    kron = len(shape) > 1 and all(isinstance(p, KronPart) for p in parts)
    if solver == "kron" and not all(isinstance(p, KronPart) for p in parts):
        raise TypeError("only Kronecker queries can be solved factor by factor")
    residual = int(np.prod([d - 1 for d in shape]))
    rows = sum(1 if isinstance(p, KronPart) else len(p.rows) for p in parts)
    if kron or solver == "kron":
        made = Kron.solve(parts, factors)
        if made:
            found.append(made)
    if solver != "kron" and (not kron or (len(parts) > 1 and residual <= 400)):
        if min(residual, rows if not kron else residual) <= dense_limit:
            made = Dense.solve(parts, full_rank)
            if made:
                found.append(made)
        else:
            notes.append(f"subset {mask}: rank over {dense_limit}, closed form instead")
    if solver == "convex" and len(found) == 1:
        notes.append(f"subset {mask}: no convex solution, closed form instead")
    return min(found, key=lambda f: (f.loss * (1 if f is not fourier else 1 - 1e-12)))


def plan(workload: Workload, cost: float = 1.0, solver: str = "best", hints: Mapping[int, str] | None = None, dense_limit: int = DENSE_LIMIT, full_rank: bool = False, workers: int = 4) -> Plan:
    """hints: mask -> solver. full_rank: convex mechanisms also answer queries that are not in the workload, at a small price."""
    if not cost > 0:
        raise ValueError("the privacy cost must be positive")
    for s in (solver, *(hints or {}).values()):
        if s not in SOLVERS:
            raise ValueError(f"unknown solver {s!r}")
    t0 = time.perf_counter()
    parts = decompose(workload)
    t1 = time.perf_counter()
    notes, memo, factors = list(workload.notes), {}, {}
    keys: dict[int, tuple] = {}
    for m, p in parts.items():
        s = (hints or {}).get(m, solver)
        keys[m] = s, _key(merged([x for _, x in p]) if m else [x for _, x in p]), m == 0
        memo.setdefault(keys[m], m)
    with ThreadPoolExecutor(workers) as pool:  # distinct subsets side by side
        made = pool.map(lambda x: choose(x[1], [y for _, y in parts[x[1]]], x[0][0], factors, dense_limit, full_rank, notes), memo.items())
        memo = dict(zip(memo, list(made), strict=True))
    mechanisms = {m: memo[k] for m, k in keys.items()}
    t2 = time.perf_counter()
    live = [m for m, x in mechanisms.items() if x.loss > NOTHING]
    sigma2 = dict(zip(live, shares(np.array([mechanisms[m].loss for m in live]), 1.0, cost).tolist(), strict=True))
    return Plan(workload.domain, workload, cost, parts, mechanisms, sigma2, notes, {"decompose": t1 - t0, "solve": t2 - t1, "assemble": time.perf_counter() - t2})


def identity_rmse(sizes: tuple[int, ...], orders: range) -> float:
    """RMSE at cost 1 of all marginals of the given orders, from the closed form, grouping subsets by their sizes' multiset."""
    from collections import Counter
    from itertools import combinations
    from math import comb, prod

    domain = len(sizes)
    if len(set(sizes)) == 1:  # one size: subsets of one order are alike
        d = sizes[0]
        rows = sum(comb(domain, k) * d**k for k in orders)
        total = 0.0
        for m in range(max(orders) + 1):
            w = sum(comb(domain - m, k - m) * d ** -(k - m) for k in orders if k >= m)
            total += comb(domain, m) * np.sqrt(w * (1 - 1 / d) ** m * (d - 1) ** m)
        return float(total / np.sqrt(rows))
    rows = sum(prod(s) for k in orders for s in combinations(sizes, k))
    weights: Counter = Counter()
    for k in orders:
        for s in combinations(range(domain), k):
            for r in range(k + 1):
                for sub in combinations(s, r):
                    weights[sub] += 1 / prod(sizes[i] for i in s if i not in sub)
    total = sum(np.sqrt(w * prod((1 - 1 / sizes[i]) * (sizes[i] - 1) for i in sub)) for sub, w in weights.items())
    return float(total / np.sqrt(rows))

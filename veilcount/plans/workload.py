"""Workload builders: the coefficient matrices of query families, and workloads over attribute subsets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from veilcount.domain import Domain, k_way
from veilcount.plans.query import KronQuery, MatrixQuery, Query

ROW_LIMIT, PAIR_LIMIT, SIZE_LIMIT = 50_000, 5_000, 5_000


def identity(d: int) -> np.ndarray:
    return np.eye(d)


def prefix(d: int) -> np.ndarray:
    return np.tri(d)


def ranges(d: int) -> np.ndarray:
    s, e = np.triu_indices(d)
    x = np.arange(d)
    return ((s[:, None] <= x) & (x <= e[:, None])).astype(float)


def circular(d: int) -> np.ndarray:
    s, length = np.repeat(np.arange(d), d), np.tile(np.arange(1, d + 1), d)
    return ((np.arange(d) - s[:, None]) % d < length[:, None]).astype(float)


def half_open(d: int, lo: int, hi: int, wraps: bool = False) -> np.ndarray:
    """One row: lo <= x < hi; with wraps past the end, and empty where hi equals lo modulo d."""
    x = np.arange(d)
    return (((x - lo) % d < (hi - lo) % d) if wraps else ((lo <= x) & (x < hi))).astype(float)[None]


def affine(d1: int, d2: int) -> np.ndarray:
    t = np.add.outer(np.arange(d1), np.arange(d2)).reshape(-1)
    return (t <= np.arange(d1 + d2 - 1)[:, None]).astype(float)


def abs_diff(d1: int, d2: int) -> np.ndarray:
    t = np.abs(np.subtract.outer(np.arange(d1), np.arange(d2))).reshape(-1)
    return (t <= np.arange(max(d1, d2))[:, None]).astype(float)


def random_rows(size: int, rows: int, percent: int, salt: int = 0) -> np.ndarray:
    """As operators.linear.random_rows: each cell is in a row by a fixed integer formula."""
    r, i = np.arange(salt, salt + rows)[:, None], np.arange(size)
    return ((r * 7919 + i * 104729 + r * i * 31) % 1000003 % 100 < percent).astype(float)


def haar(d: int) -> np.ndarray:
    """Left minus right half at every node of the binary tree; d a power of two."""
    if d & (d - 1) or d < 2:
        raise ValueError("d must be a power of two")
    out, width = [], d
    while width > 1:
        for s in range(0, d, width):
            row = np.zeros(d)
            row[s : s + width // 2], row[s + width // 2 : s + width] = 1, -1
            out.append(row)
        width //= 2
    return np.array(out)


def hierarchy(d: int, branch: int) -> np.ndarray:
    """Root, branches of equal width, leaves."""
    parts = [np.isin(np.arange(d), c) for c in np.array_split(np.arange(d), min(branch, d))]
    return np.vstack([np.ones(d), np.array(parts, float), np.eye(d)]) if d > 2 else np.vstack([np.ones(d), np.eye(d)])


def adjacent_differences(d: int) -> np.ndarray:
    return np.eye(d)[:-1] - np.eye(d)[1:]


def first_differences(d: int) -> np.ndarray:
    return np.eye(d)[:1] - np.eye(d)[1:]


class Workload:
    """An immutable list of queries over a domain; ``notes`` tells where a builder took another family than asked for."""

    def __init__(self, domain: Domain, queries: Sequence[Query] = (), notes: Sequence[str] = ()):
        self.domain, self.queries, self.notes = domain, tuple(queries), tuple(notes)
        if any(q.domain is not domain for q in self.queries):
            raise ValueError("a query belongs to another domain")

    def __add__(self, more: Sequence[Query] | Workload) -> Workload:
        other = more if isinstance(more, Workload) else Workload(self.domain, more)
        return Workload(self.domain, self.queries + other.queries, self.notes + other.notes)

    @property
    def n_rows(self) -> int:
        return sum(q.n_rows for q in self.queries)

    @property
    def max_pair_residual(self) -> int:
        return max(((self.domain.sizes[i] - 1) * (self.domain.sizes[j] - 1) for i, j in k_way(len(self.domain), 2, 2)), default=0)


def build(domain: Domain, subsets: Sequence[Sequence[int]], factor: Callable[[int, int], np.ndarray], weight: Callable[[tuple], float] = lambda s: 1.0) -> Workload:
    """Kronecker queries on subsets; factor(attribute, size) gives each attribute's matrix."""
    return Workload(domain, [KronQuery(domain, s, [factor(a, domain.sizes[a]) for a in s], weight(tuple(s)), name="x".join(map(str, s)) or "total") for s in subsets])


def identity_workload(domain: Domain, k: int, total: bool = False, capped: bool = False) -> Workload:
    """All marginals of 1 .. k attributes; capped leaves out those of more than SIZE_LIMIT cells."""
    subsets = k_way(len(domain), k, 0 if total else 1)
    kept = [s for s in subsets if not capped or 0 < domain.size(domain.mask(s)) <= SIZE_LIMIT]
    w = build(domain, kept, lambda a, d: identity(d))
    return Workload(domain, w.queries, [f"{len(subsets) - len(kept)} marginals over {SIZE_LIMIT} cells left out"] if len(kept) < len(subsets) else [])


def k_way_identity(domain: Domain, k: int) -> Workload:
    return build(domain, k_way(len(domain), k, k), lambda a, d: identity(d))


def _family(domain: Domain, k: int, one: Callable, pair: Callable, limit: int | None = None) -> Workload:
    """1-way by ``one``, 2-way by ``pair`` (dense rows or factors), identity beyond; pairs over the limit of rows become prefixes."""
    out, notes = [], []
    for s in k_way(len(domain), k):
        sizes = [domain.sizes[a] for a in s]
        if len(s) == 1:
            out.append(KronQuery(domain, s, [one(sizes[0])]))
        elif len(s) == 2:
            made = pair(*sizes)
            if isinstance(made, tuple):
                if limit is not None and len(made[0]) * len(made[1]) > limit:
                    notes.append(f"pair {s}: prefixes instead, over {limit} rows")
                    made = (prefix(sizes[0]), prefix(sizes[1]))
                out.append(KronQuery(domain, s, made))
            else:
                out.append(MatrixQuery(domain, s, made))
        else:
            out.append(KronQuery(domain, s, [identity(d) for d in sizes]))
    return Workload(domain, out, notes)


def prefix_workload(domain: Domain, k: int) -> Workload:
    return _family(domain, k, prefix, lambda a, b: (prefix(a), prefix(b)))


def range_workload(domain: Domain, k: int) -> Workload:
    return _family(domain, k, ranges, lambda a, b: (ranges(a), ranges(b)), ROW_LIMIT - 1)


def circular_workload(domain: Domain, k: int) -> Workload:
    return _family(domain, k, circular, lambda a, b: (circular(a), circular(b)), ROW_LIMIT)


def affine_workload(domain: Domain, k: int) -> Workload:
    return _family(domain, k, prefix, affine)


def abs_diff_workload(domain: Domain, k: int) -> Workload:
    return _family(domain, k, prefix, abs_diff)


def random_workload(domain: Domain, k: int, percent: int = 30) -> Workload:
    """3k rows on each marginal of k attributes, drawn from one stream of rows."""
    out, at = [], 0
    for s in k_way(len(domain), k):
        out.append(MatrixQuery(domain, s, random_rows(domain.size(domain.mask(s)), 3 * len(s), percent, at)))
        at += 3 * len(s)
    return Workload(domain, out)


def mixed_workload(domain: Domain, k: int, numeric: int, least: int = 1, dense: bool = False) -> Workload:
    """Prefixes on the first ``numeric`` attributes, identity on the others."""
    w = build(domain, k_way(len(domain), k, least), lambda a, d: prefix(d) if a < numeric else identity(d))
    return Workload(domain, [MatrixQuery(domain, q.attributes, q.matrix(), q.weight, q.name) for q in w.queries]) if dense else w


def mixed_families(domain: Domain, k: int = 3) -> Workload:
    """1-way ranges, 2-way affine, 3-way prefixes."""
    out = []
    for s in k_way(len(domain), k):
        sizes = [domain.sizes[a] for a in s]
        out.append(KronQuery(domain, s, [ranges(sizes[0])]) if len(s) == 1 else MatrixQuery(domain, s, affine(*sizes)) if len(s) == 2 else KronQuery(domain, s, [prefix(d) for d in sizes]))
    return Workload(domain, out)


def mixed_types(domain: Domain, k: int, numeric: int, pair: Callable = affine) -> Workload:
    """Pairs of numeric attributes by ``pair`` where the residual has at most PAIR_LIMIT dimensions, else as ``mixed_workload``."""
    out, notes = [], []
    for q in mixed_workload(domain, k, numeric).queries:
        if len(q.attributes) == 2 and max(q.attributes) < numeric:
            d1, d2 = q.shape
            if (d1 - 1) * (d2 - 1) <= PAIR_LIMIT:
                q = MatrixQuery(domain, q.attributes, pair(d1, d2))
            else:
                notes.append(f"pair {q.attributes}: prefixes instead, residual over {PAIR_LIMIT}")
        out.append(q)
    return Workload(domain, out, notes)

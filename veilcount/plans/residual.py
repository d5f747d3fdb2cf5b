"""Residual planner: a fixed strategy per attribute, noise levels in closed form or for the largest variance.

Attribute i has a basis (identity I, prefix P, range R, Haar H or a given matrix), a
residual matrix R_i whose rows span what is orthogonal to the total, and noise
factor G_i.  The mechanism of a subset is the Kronecker product of these over its
attributes; coefficients of cost and variance are products over attributes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilcount.domain import Domain, submasks
from veilcount.operators.cells import cells as to_cells
from veilcount.operators.cells import marginals
from veilcount.plans import workload as families
from veilcount.plans.budget import level, shares
from veilcount.plans.mechanisms import certified
from veilcount.plans.query import centre, mode
from veilcount.sources.tables import write_once

BASES = {"I": families.identity, "P": families.prefix, "R": families.ranges, "H": lambda d: np.vstack([families.haar(d), np.ones(d)])}


@dataclass
class Strategy:
    """work: queries on the attribute; residual R, noise factor G; back: R's pseudo-inverse."""

    work: np.ndarray
    residual: np.ndarray
    noise: np.ndarray
    cost: float  # largest diagonal entry of R' (G G')^-1 R
    variances: np.ndarray  # of each query's residual
    shares: np.ndarray  # and of its share of the total

    @property
    def variance(self) -> float:
        return float(self.variances.sum())

    @property
    def total(self) -> float:
        return float(self.shares.sum())

    @property
    def kinds(self) -> np.ndarray:
        """Distinct (share, variance) of the queries."""
        return np.unique(np.round(np.stack([self.shares, self.variances], axis=1), 12), axis=0)

    @property
    def back(self) -> np.ndarray:
        return np.linalg.pinv(self.residual)


def strategy(d: int, basis: str | np.ndarray = "I", objective: str = "sum") -> Strategy:
    """objective: sum (least total variance) or max (rows weighed until the largest row variance is least)."""
    work = BASES[basis](d) if isinstance(basis, str) else np.asarray(basis, float)
    share = work.mean(axis=1)
    if d == 1:
        return Strategy(work, np.zeros((0, 1)), np.zeros((0, 0)), 0.0, np.zeros(len(work)), share**2)
    centred = centre(work, 1)
    weights = np.ones(len(work))
    for _ in range(1 if objective == "sum" else 200):
        b, _, _ = certified(None, np.sqrt(weights)[:, None] * centred)
        back = np.linalg.pinv(b)
        v = np.sum((centred @ back) ** 2, axis=1)
        if objective == "sum" or v.max() < 1.001 * (weights @ v) / weights.sum():
            break
        weights = np.maximum(weights * v / v.max(), 1e-12)
        weights /= weights.max()
    return Strategy(work, b, np.eye(len(b)), float(np.max(np.sum(b**2, axis=0))), v, share**2)


def allocate_max(a: np.ndarray, bound: np.ndarray, p: np.ndarray, cost: float, **options) -> np.ndarray:
    """sigma^2 of least max over rows of (a sigma^2) / bound with sum(p / sigma^2) = cost."""
    rows = np.unique(np.round(a / bound[:, None], 12), axis=0)
    return level([(np.arange(a.shape[1]), rows)], p, cost, **options)[0]


class ResidualPlan:
    """Strategies per attribute (by position, so equal sizes may differ), subsets of marginals, and noise levels."""

    def __init__(self, domain: Domain, bases: list[str | np.ndarray], marginals_: list[tuple[int, ...]], cost: float = 1.0, objective: str = "sum", gap: float = 1e-4):
        """objective: sum or max of the queries' variances, or for tests random (any levels) and zero (no noise)."""
        if not cost > 0:
            raise ValueError("the privacy cost must be positive")
        if objective not in ("sum", "max", "random", "zero"):
            raise ValueError(f"unknown objective {objective!r}")
        self.domain, self.cost, self.objective = domain, cost, objective
        memo: dict = {}
        self.strategies = []
        for d, b in zip(domain.sizes, bases, strict=True):
            key = (d, b) if isinstance(b, str) else (d, b.tobytes())
            if key not in memo:
                memo[key] = strategy(d, b, "max" if objective == "max" else "sum")
            self.strategies.append(memo[key])
        self.subsets = [domain.mask(m) for m in marginals_]
        self.masks = sorted({s for m in self.subsets for s in submasks(m)}, key=lambda m: (m.bit_count(), m))
        self.p = np.array([np.prod([self.strategies[i].cost for i in domain.attrs(m)]) for m in self.masks])
        at = {m: k for k, m in enumerate(self.masks)}
        self.v = np.zeros(len(self.masks))
        blocks = []
        for big in self.subsets:
            own, subs = [self.strategies[i] for i in domain.attrs(big)], submasks(big)
            for s in subs:
                self.v[at[s]] += np.prod([x.variance if s >> i & 1 else x.total for i, x in zip(domain.attrs(big), own, strict=True)])
            if objective == "max":  # one row for each kind of query of the marginal, a product over its attributes
                kinds = [[x.kinds[:, s >> i & 1] for i, x in zip(domain.attrs(big), own, strict=True)] for s in subs]
                rows = np.stack([reduce(np.multiply.outer, k, np.ones(())).reshape(-1) for k in kinds], axis=1)
                blocks.append((np.array([at[s] for s in subs]), np.unique(np.round(rows, 12), axis=0)))
        live = self.v * self.p > 0
        self.sigma2 = np.zeros(len(self.masks))
        #: The largest variance of a query, and a bound from below for it under this privacy cost.
        self.largest, self.bound = np.nan, np.nan
        if objective == "sum":
            self.sigma2[live] = shares(self.v[live], self.p[live], cost)
        elif objective == "max":
            place = np.cumsum(live) - 1
            kept = [(place[x[live[x]]], r[:, live[x]]) for x, r in blocks]
            self.sigma2[live], self.largest, self.bound = level(kept, self.p[live], cost, gap=gap)
        elif objective == "random":  # for tests: any noise levels of this cost
            draw = np.random.default_rng(len(self.masks)).uniform(0.5, 1.5, int(live.sum()))
            self.sigma2[live] = draw * np.sum(self.p[live] / draw) / cost

    @property
    def n_rows(self) -> int:
        return int(sum(np.prod([len(self.strategies[i].work) for i in self.domain.attrs(m)]) for m in self.subsets))

    @property
    def total_variance(self) -> float:
        return float(self.v @ self.sigma2)

    @property
    def rmse(self) -> float:
        return float(np.sqrt(self.total_variance / self.n_rows))

    def allocation(self) -> list[tuple[int, float, float, float]]:
        """(mask, cost coefficient, variance coefficient, sigma^2)."""
        return [(m, float(p), float(v), float(s)) for m, p, v, s in zip(self.masks, self.p, self.v, self.sigma2, strict=True)]

    def covariance(self, big: int) -> np.ndarray:
        """Covariance matrix of the reconstructed marginal."""
        out = 0.0
        for s in submasks(big):
            f = []
            for i in self.domain.attrs(big):
                x = self.strategies[i]
                g = x.back @ x.noise if s >> i & 1 else np.full((self.domain.sizes[i], 1), 1 / self.domain.sizes[i])
                f.append(g @ g.T)
            out = out + self.sigma2[self.masks.index(s)] * reduce(np.kron, f, np.ones((1, 1)))
        return out

    def row_variances(self, big: int) -> np.ndarray:
        """Variance of each query of a marginal."""
        out = 0.0
        for s in submasks(big):
            own = [self.strategies[i].variances if s >> i & 1 else self.strategies[i].shares for i in self.domain.attrs(big)]
            out = out + self.sigma2[self.masks.index(s)] * reduce(np.multiply.outer, own, np.ones(())).reshape(-1)
        return out

    def measure(self, rows: DataFrame, noise: bool = True, seed: int | None = None) -> DataFrame:
        """(mask, idx, x): reconstructed marginals.

        One pass of grouping sets; each subset is measured in a task of its own, written where it is noisy, and each
        marginal reconstructed in one from the subsets below it. Sizes are those of the declared domain.
        """
        spark, domain, attributes = rows.sparkSession, self.domain, self.strategies
        levels = dict(zip(self.masks, np.sqrt(self.sigma2).tolist(), strict=True))
        found = marginals(to_cells(rows, domain), domain, self.masks).select("mask", "idx", F.col("n").cast("double").alias("x"))
        empty = spark.createDataFrame([(m, 0, 0.0) for m in self.masks], "mask bigint, idx bigint, x double")  # every subset, even over an empty table

        def residual(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            m = int(key[0])
            x = np.bincount(part["idx"].to_numpy(np.int64), part["x"].to_numpy(), domain.size(m)).reshape(domain.shape(m))
            own = [attributes[i] for i in domain.attrs(m)]
            for k, a in enumerate(own):
                x = mode(x, a.residual, k)
            if noise:
                rng = np.random.default_rng() if seed is None else np.random.Generator(np.random.Philox(key=[seed, m]))
                z = rng.standard_normal(x.shape)
                for k, a in enumerate(own):
                    z = mode(z, a.noise, k)
                x = x + levels[m] * z
            return pd.DataFrame({"mask": m, "idx": np.arange(x.size), "x": x.reshape(-1)})

        omega = found.union(empty).groupBy("mask").applyInPandas(residual, "mask bigint, idx bigint, x double")
        omega = write_once(omega, "residuals") if noise else omega
        below = spark.createDataFrame([(s, big) for big in self.subsets for s in submasks(big)], "mask bigint, big bigint")

        def back(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            big = int(key[0])
            own = domain.attrs(big)
            out = np.zeros(domain.shape(big))
            for s, x in part.groupby("mask"):
                x = x.sort_values("idx")["x"].to_numpy().reshape([len(attributes[i].residual) if int(s) >> i & 1 else 1 for i in own])
                for k, i in enumerate(own):
                    x = mode(x, attributes[i].back if int(s) >> i & 1 else np.full((domain.sizes[i], 1), 1 / domain.sizes[i]), k)
                out += x
            return pd.DataFrame({"mask": big, "idx": np.arange(out.size), "x": out.reshape(-1)})

        return omega.join(below, "mask").groupBy("big").applyInPandas(back, "mask bigint, idx bigint, x double")


def mean_error(rows: DataFrame, plan: ResidualPlan, found: DataFrame, p: float = 1.0) -> float:
    """Mean over marginals of the L_p error divided by the number of rows."""
    true = marginals(to_cells(rows, plan.domain), plan.domain, plan.subsets)
    both = found.join(true, ["mask", "idx"], "left")
    off = F.abs(F.col("x") - F.coalesce("n", F.lit(0)))
    errors = both.groupBy("mask").agg(F.pow(F.sum(F.pow(off, F.lit(p))), F.lit(1 / p)).alias("e"))
    return float(errors.agg(F.avg("e")).first()[0] / max(rows.count(), 1))


def uniform_rmse(d: int, attributes: int, k: int, basis: str = "I", cost: float = 1.0) -> float:
    """RMSE of all marginals of 1 .. k of equal attributes: subsets of one order are alike, so orders stand for them."""
    s = strategy(d, basis)
    v, p, many = np.zeros(k + 1), np.array([s.cost**m for m in range(k + 1)]), np.array([comb(attributes, m) for m in range(k + 1)], float)
    for m in range(k + 1):
        v[m] = sum(comb(attributes - m, j - m) * s.variance**m * s.total ** (j - m) for j in range(max(m, 1), k + 1))
    t = np.sum(many * np.sqrt(v * p)) ** 2 / cost
    rows = sum(comb(attributes, j) * len(s.work) ** j for j in range(1, k + 1))
    return float(np.sqrt(t / rows))


def gaussian_draws(spark, strategy_: Strategy, runs: int, seed: int = 0) -> DataFrame:
    """(run, i, z): draws of the residual measurement of an all-zero table, on the executors; each run has its own generator."""
    g = strategy_.noise

    def draw(batches):
        import pandas as pd

        for x in batches:
            for r in x["id"]:
                z = g @ np.random.Generator(np.random.Philox(key=[seed, int(r)])).standard_normal(g.shape[1])
                yield pd.DataFrame({"run": r, "i": np.arange(len(z)), "z": z})

    return spark.range(runs).mapInPandas(draw, "run bigint, i bigint, z double")


def covariance(draws: DataFrame) -> DataFrame:
    """(i, j, cov): average products over runs."""
    other = draws.select("run", F.col("i").alias("j"), F.col("z").alias("y"))
    return draws.join(other, "run").groupBy("i", "j").agg(F.avg(F.col("z") * F.col("y")).alias("cov"))


def rational_sqrt(x: float, largest: int = 10**6) -> tuple[int, int]:
    """A fraction at or above the square root of x, by continued fractions of bounded denominator."""
    from fractions import Fraction

    f = Fraction(np.sqrt(x)).limit_denominator(largest)
    while f * f < Fraction(x):
        f += Fraction(1, largest)
    return f.numerator, f.denominator


def hierarchical_variance(d: int, branch: int) -> float:
    """Mean variance of prefix queries at cost 1 when noise is put on a tree of totals."""
    a = families.hierarchy(d, branch)
    back = np.linalg.pinv(a)
    cost = np.max(np.sum(a**2, axis=0))
    return float(cost * np.mean(np.sum((families.prefix(d) @ back) ** 2, axis=1)))


def all_pairs(n: int) -> list[tuple[int, int]]:
    return list(combinations(range(n), 2))

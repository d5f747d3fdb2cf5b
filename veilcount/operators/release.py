"""Releases: measure the marginals of a plan once, reconstruct, and answer.

Spark aggregates rows to cells and all measured marginals in one more shuffle; each
marginal, dense and bounded by its declared domain, is then measured, reconstructed
and applied to its query parts in one Python task per subset, and the partial answers
are summed.  A noisy release is written before anything reads it: a recomputed task
would draw again and spend the budget twice.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilcount.domain import submasks
from veilcount.operators.cells import cells as to_cells
from veilcount.operators.cells import lattice, marginals
from veilcount.plans.planner import Plan
from veilcount.plans.query import Query
from veilcount.sources.tables import write_once


class Release:
    """Reconstructed marginals of one measurement: ``recon`` (mask, idx, x). Answering costs no more budget."""

    def __init__(self, plan: Plan, recon: DataFrame, noisy: bool):
        self.plan, self.recon, self.noisy = plan, recon, noisy
        self.spent = plan.spent() if noisy else 0.0

    def answers(self, queries: list[Query] | None = None) -> DataFrame:
        """(query_id, row_id, answer, variance) of the workload's or of other queries; raises where a part was not measured."""
        chosen = list(self.plan.workload.queries if queries is None else queries)
        work: dict[int, list] = {}
        for i, q in enumerate(chosen):
            work.setdefault(0, []).append((i, None, q.n_rows))  # every row has an answer, even where all parts are empty
            for m, part in self.plan.measured_parts(q):
                work.setdefault(m, []).append((i, part, q.n_rows))
        noisy, spark = self.noisy, self.recon.sparkSession
        sent = _sent(spark, {m: (self.plan.domain.size(m), self.plan.mechanisms.get(m), self.plan.sigma2.get(m, 0.0), parts) for m, parts in work.items()})

        def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            out = []
            for packed in y["packed"]:
                size, mechanism, sigma2, parts = pickle.loads(packed)
                dense = np.zeros(size)
                dense[x["idx"].to_numpy()] = x["x"].to_numpy()
                for i, part, n in parts:
                    answer = np.zeros(n) if part is None else part.apply(dense)
                    spread = sigma2 * mechanism.variances(part) if noisy and part is not None else 0.0
                    out.append(pd.DataFrame({"query_id": i, "row_id": np.arange(n), "answer": answer, "variance": spread}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "row_id": [], "answer": [], "variance": []})

        schema = "query_id bigint, row_id bigint, answer double, variance double"
        used = self.recon.where(F.col("mask").isin(list(work)))
        partial = used.groupBy("mask").cogroup(sent.groupBy("mask")).applyInPandas(run, schema)
        return partial.groupBy("query_id", "row_id").agg(F.sum("answer").alias("answer"), F.sum("variance").alias("variance"))

    def register(self, marginals_: str = "marginals", answers: str = "answers") -> None:
        """Temporary views for SQL: reconstructed marginals (mask, idx, x) and the workload's answers."""
        self.recon.createOrReplaceTempView(marginals_)
        self.answers().createOrReplaceTempView(answers)


def _sent(spark, work: dict[int, object]) -> DataFrame:
    """(mask, packed): what each subset's task needs, as rows, so that no task is sent the whole plan."""
    return spark.createDataFrame([(m, pickle.dumps(x)) for m, x in work.items()], "mask bigint, packed binary")


def measure(rows: DataFrame, plan: Plan, noise: bool = True, seed: int | None = None, counted: bool = False, path: str | None = None) -> Release:
    """rows: the table, or with counted its cells (attributes, n).

    seed: for tests only; noise then comes from a counter-based generator keyed by (seed, subset), whatever the
    partitioning.  Without it the operating system's entropy is used.  path: where a noisy release is written; one
    that is there already, whole, is taken as it is, so that a repeated call does not spend the budget again.
    """
    domain, masks = plan.domain, plan.measured
    if not masks:
        raise ValueError("the plan measures nothing")
    base = rows if counted else to_cells(rows, domain)
    spark = rows.sparkSession
    found = marginals(base, domain, masks) if len(masks) <= 64 else lattice(base, domain, masks)
    found = found.select("mask", "idx", F.col("n").cast("double").alias("n"))
    sent = _sent(spark, {m: (domain.size(m), plan.mechanisms[m], float(np.sqrt(plan.sigma2[m]))) for m in masks})

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        for m, packed in zip(y["mask"], y["packed"], strict=True):  # every subset has a row there, even over an empty table
            size, mechanism, sigma = pickle.loads(packed)
            dense = np.bincount(x["idx"].to_numpy(np.int64), x["n"].to_numpy(), size)
            rng = None
            if noise:
                rng = np.random.default_rng() if seed is None else np.random.Generator(np.random.Philox(key=[seed, int(m)]))
            out.append(pd.DataFrame({"mask": m, "idx": np.arange(size), "x": mechanism.reconstruct(mechanism.measure(dense, sigma, rng))}))
        return pd.concat(out)

    recon = found.groupBy("mask").cogroup(sent.groupBy("mask")).applyInPandas(run, "mask bigint, idx bigint, x double")
    return Release(plan, write_once(recon, "release", path) if noise else recon, noise)


def coefficients(spark, queries: list[Query]) -> Iterator[DataFrame]:
    """(query_id, row_id, mask, idx, coef) of each query's parts in sparse form, for operators.linear.evaluate."""
    for i, q in enumerate(queries):
        rows = []
        for m in submasks(q.mask):
            part = q.part(m).dense()
            rows += [(i, int(r), m, int(c), float(part[r, c])) for r, c in np.argwhere(np.abs(part) > 1e-15)]
        yield spark.createDataFrame(rows, "query_id bigint, row_id bigint, mask bigint, idx bigint, coef double")

"""Releases over a stream: one histogram per event-time window, each released once and each with its own budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilcount.domain import Domain
from veilcount.operators.cells import encode
from veilcount.operators.release import measure
from veilcount.plans.planner import Plan


def window_cells(stream: DataFrame, domain: Domain, time: str, window: str, late: str) -> DataFrame:
    """(start, attributes, n) of closed windows: rows later than the watermark are dropped, as the window is released already."""
    kept = stream.withWatermark(time, late)
    coded = encode_with(kept, domain, F.window(F.col(time), window).alias("w"))
    return coded.groupBy("w", *domain.names).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *domain.names, "n")


def encode_with(rows: DataFrame, domain: Domain, *more) -> DataFrame:
    return rows.select(*more, *(a.encoder.code(a.size).alias(a.name) if a.encoder else F.col(a.name).cast("int").alias(a.name) for a in domain.attributes))


def release_windows(stream: DataFrame, plan: Plan, time: str, window: str, late: str, sink: Callable[[object, DataFrame], None], folder: str | None = None, noise: bool = True, seed: int | None = None):
    """Starts a query that gives sink(window start, answers) for closed windows; each spends plan.cost once.

    A batch may run again after a failure, and so may the sink.  A noisy release is therefore kept in folder under its
    window's start, and a window that has one is never measured again: the sink gets the same numbers.
    """
    if noise and folder is None:
        raise ValueError("noisy releases need a folder that outlives the query")

    def batch(closed: DataFrame, _: int) -> None:
        closed = closed.persist()
        try:
            for r in closed.select("start").distinct().collect():  # windows closed by one batch
                own = closed.where(F.col("start") == F.lit(r["start"])).drop("start")
                at = int(r["start"].timestamp())
                path = f"{folder.rstrip('/')}/{at}" if noise else None
                sink(r["start"], measure(own, plan, noise, None if seed is None else seed + at, counted=True, path=path).answers())
        finally:
            closed.unpersist()

    return window_cells(stream, plan.domain, time, window, late).writeStream.outputMode("append").foreachBatch(batch)


__all__ = ["encode", "encode_with", "release_windows", "window_cells"]

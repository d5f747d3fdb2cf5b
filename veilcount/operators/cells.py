"""Histograms: rows to cells, cells to marginals.

Rows are aggregated once to cells over all attributes of a workload (partial
aggregation before the one shuffle of rows); every marginal comes from cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilcount.domain import Domain


def encode(rows: DataFrame, domain: Domain) -> DataFrame:
    """Codes of the domain's attributes, named as these; attributes without an encoder are codes already."""
    return rows.select(*(a.encoder.code(a.size).alias(a.name) if a.encoder else F.col(a.name).cast("int").alias(a.name) for a in domain.attributes))


def cells(rows: DataFrame, domain: Domain) -> DataFrame:
    """(attributes, n): counts of the non-empty cells. Rows with a code that the policy dropped are left out."""
    return encode(rows, domain).dropna().groupBy(*domain.names).agg(F.count("*").alias("n"))


def marginals(cells_: DataFrame, domain: Domain, masks: list[int]) -> DataFrame:
    """(mask, idx, n) of all masks in one shuffle by grouping sets; idx is row-major within the mask; zero cells are left out."""
    if not masks:
        raise ValueError("no marginals asked for")
    names = domain.names
    grouped = cells_.groupingSets([[names[i] for i in domain.attrs(m)] for m in dict.fromkeys(masks)], *names).agg(F.sum("n").alias("n"), F.grouping_id().alias("gid"))
    # the first grouping column is the highest bit of grouping_id, and a set bit means rolled up
    mask: Column = sum(((F.lit(1) - F.col("gid").bitwiseAND(F.lit(1 << (len(names) - 1 - i))).cast("boolean").cast("long")) * (1 << i) for i in range(len(names))), F.lit(0).cast("long"))
    idx: Column = F.lit(0).cast("long")
    for m in dict.fromkeys(masks):
        part = sum((F.col(names[i]) * s for i, s in domain.strides(m).items()), F.lit(0).cast("long"))
        idx = F.when(F.col("mask") == m, part).otherwise(idx)
    return grouped.withColumn("mask", mask).select("mask", idx.cast("long").alias("idx"), F.coalesce("n", F.lit(0)).alias("n"))


def maximal(masks: list[int]) -> list[int]:
    """The masks that no other contains."""
    return [m for m in masks if not any(m != o and m & o == m for o in masks)]


def lattice(cells_: DataFrame, domain: Domain, masks: list[int]) -> DataFrame:
    """As ``marginals``, for many masks: only the maximal ones are aggregated from cells, smaller ones from these."""
    top = maximal(masks)
    out = None
    for big in top:
        below = [m for m in masks if m & big == m and not any(o & m == m for o in top[: top.index(big)])]
        if not below:
            continue
        keep = [domain.names[i] for i in domain.attrs(big)]
        one = cells_.groupBy(*keep).agg(F.sum("n").alias("n")) if keep else cells_.agg(F.sum("n").alias("n"))
        for i, name in enumerate(domain.names):
            if not big >> i & 1:
                one = one.withColumn(name, F.lit(None).cast("int"))
        part = marginals(one, domain, below)
        out = part if out is None else out.unionByName(part)
    return out


def dense(marginal: DataFrame, domain: Domain, mask: int) -> DataFrame:
    """(attributes of the mask, idx, n) with zero cells."""
    spark = marginal.sparkSession
    have = marginal.where(F.col("mask") == mask).select("idx", "n") if "mask" in marginal.columns else marginal
    full = spark.range(domain.size(mask)).withColumnRenamed("id", "idx")
    coords = [F.pmod(F.floor(F.col("idx") / s), F.lit(domain.sizes[i])).cast("int").alias(domain.names[i]) for i, s in domain.strides(mask).items()]
    return full.join(have, "idx", "left").select(*coords[::-1], "idx", F.coalesce("n", F.lit(0)).alias("n"))

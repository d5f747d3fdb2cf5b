"""True answers of linear counting queries from a dense marginal: every workload family as a DataFrame operator.

A dense marginal's size is that of its declared domain, not of the data, so windows
over a whole axis are bounded.  Intervals are differences of cumulative sums by
equi-joins; no parameter relation is crossed with the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_UP = (W.unboundedPreceding, 0)


def total(marginal: DataFrame) -> DataFrame:
    return marginal.agg(F.sum("n").alias("answer"))


def prefix(marginal: DataFrame, a: str) -> DataFrame:
    """(k, answer): cells 0 .. k."""
    return marginal.select(F.col(a).alias("k"), F.sum("n").over(W.orderBy(a).rowsBetween(*_UP)).alias("answer"))


def ranges(marginal: DataFrame, a: str) -> DataFrame:
    """(s, e, answer) for all s <= e."""
    p = prefix(marginal, a)
    before = p.select((F.col("k") + 1).alias("s"), F.col("answer").alias("low"))
    ends = p.select(F.col("k").alias("e"), F.col("answer").alias("high")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("e"))))
    return ends.join(before, "s", "left").select("s", "e", (F.col("high") - F.coalesce("low", F.lit(0))).alias("answer"))


def circular(marginal: DataFrame, a: str, d: int) -> DataFrame:
    """(s, l, answer): l cells from s, past the end on from 0; l = 1 .. d."""
    twice = marginal.select(F.col(a).alias("a"), "n").union(marginal.select(F.col(a) + d, "n"))
    p = prefix(twice, "a")
    starts = p.where(F.col("k") < d).select(F.col("k").alias("s"), F.lag("answer", 1, 0).over(W.orderBy("k")).alias("low")).withColumn("l", F.explode(F.sequence(F.lit(1), F.lit(d))))
    return starts.join(p.withColumnRenamed("answer", "high"), F.col("k") == F.col("s") + F.col("l") - 1).select("s", "l", (F.col("high") - F.col("low")).alias("answer"))


def prefix_2d(marginal: DataFrame, a: str, b: str) -> DataFrame:
    """(k1, k2, answer): cells 0 .. k1 x 0 .. k2."""
    across = marginal.select(a, b, F.sum("n").over(W.partitionBy(a).orderBy(b).rowsBetween(*_UP)).alias("n"))
    return across.select(F.col(a).alias("k1"), F.col(b).alias("k2"), F.sum("n").over(W.partitionBy(b).orderBy(a).rowsBetween(*_UP)).alias("answer"))


def rectangles(marginal: DataFrame, a: str, b: str) -> DataFrame:
    """(s1, e1, s2, e2, answer) for all s1 <= e1, s2 <= e2."""
    p = prefix_2d(marginal, a, b)
    rows = p.select(F.col("k1").alias("e1"), "k2", "answer").withColumn("s1", F.explode(F.sequence(F.lit(0), F.col("e1"))))
    above = p.select((F.col("k1") + 1).alias("s1"), "k2", F.col("answer").alias("low"))
    bands = rows.join(above, ["s1", "k2"], "left").select("s1", "e1", "k2", (F.col("answer") - F.coalesce("low", F.lit(0))).alias("band"))
    boxes = bands.withColumnRenamed("k2", "e2").withColumn("s2", F.explode(F.sequence(F.lit(0), F.col("e2"))))
    left = bands.select("s1", "e1", (F.col("k2") + 1).alias("s2"), F.col("band").alias("low"))
    return boxes.join(left, ["s1", "e1", "s2"], "left").select("s1", "e1", "s2", "e2", (F.col("band") - F.coalesce("low", F.lit(0))).alias("answer"))


def circular_2d(marginal: DataFrame, a: str, b: str, d1: int, d2: int) -> DataFrame:
    """(s1, l1, s2, l2, answer)."""
    first = marginal.select(F.col(a).alias("a"), F.col(b).alias("b"), "n")
    wide = first.union(first.select(F.col("a") + d1, "b", "n"))
    wide = wide.union(wide.select("a", F.col("b") + d2, "n"))
    p = prefix_2d(wide, "a", "b")
    one = p.where(F.col("k1") < d1 * 2).select(F.col("k1").alias("at"), "k2", "answer")
    low = one.select((F.col("at") + 1).alias("s1"), "k2", F.col("answer").alias("low"))
    starts = one.select("k2").distinct().withColumn("s1", F.explode(F.sequence(F.lit(0), F.lit(d1 - 1)))).withColumn("l1", F.explode(F.sequence(F.lit(1), F.lit(d1))))
    bands = starts.join(one, (F.col("at") == F.col("s1") + F.col("l1") - 1) & (starts["k2"] == one["k2"])).select("s1", "l1", starts["k2"], "answer").join(low, ["s1", "k2"], "left")
    bands = bands.select("s1", "l1", "k2", (F.col("answer") - F.coalesce("low", F.lit(0))).alias("band"))
    left = bands.select("s1", "l1", (F.col("k2") + 1).alias("s2"), F.col("band").alias("low"))
    cells = bands.where(F.col("k2") < d2).select("s1", "l1", F.col("k2").alias("s2")).withColumn("l2", F.explode(F.sequence(F.lit(1), F.lit(d2)))).withColumn("k2", F.col("s2") + F.col("l2") - 1)
    return cells.join(bands, ["s1", "l1", "k2"]).join(left, ["s1", "l1", "s2"], "left").select("s1", "l1", "s2", "l2", (F.col("band") - F.coalesce("low", F.lit(0))).alias("answer"))


def _cumulated(marginal: DataFrame, c: Column) -> DataFrame:
    by = marginal.groupBy(c.alias("c")).agg(F.sum("n").alias("n"))
    return by.select("c", F.sum("n").over(W.orderBy("c").rowsBetween(*_UP)).alias("answer"))


def affine(marginal: DataFrame, a: str, b: str) -> DataFrame:
    """(c, answer): a + b <= c."""
    return _cumulated(marginal, F.col(a) + F.col(b))


def abs_diff(marginal: DataFrame, a: str, b: str) -> DataFrame:
    """(c, answer): |a - b| <= c."""
    return _cumulated(marginal, F.abs(F.col(a) - F.col(b)))


def groups(cells: DataFrame, predicates: dict[str, Column], n: str = "n") -> DataFrame:
    """One column per predicate: the number of rows that satisfy it."""
    return cells.agg(*(F.coalesce(F.sum(F.when(p, F.col(n))), F.lit(0)).alias(k) for k, p in predicates.items()))


def random_rows(marginal: DataFrame, rows: int, percent: int) -> DataFrame:
    """(row, answer): each cell counts in a row with chance percent / 100, by a fixed integer formula of row and cell."""
    chosen = F.pmod(F.col("row") * 7919 + F.col("idx") * 104729 + F.col("row") * F.col("idx") * 31, F.lit(1000003)) % 100 < percent
    spread = marginal.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    return spread.groupBy("row").agg(F.sum(F.when(chosen, F.col("n")).otherwise(0)).alias("answer"))


def decompose(coefficients: DataFrame, attrs: list[str], subset: list[str]) -> DataFrame:
    """Part of query rows (row, attrs..., coef) on a subset of their attributes: (row, subset..., coef).

    Centring by averages over windows: the sum over T within the subset of (-1)^(|subset| - |T|) times the mean over all other attributes.
    """
    out = coefficients
    mean_rest = out.groupBy("row", *subset).agg(F.avg("coef").alias("coef"))
    expr: Column = F.lit(0.0)
    for bits in range(1 << len(subset)):
        held = [s for k, s in enumerate(subset) if bits >> k & 1]
        expr = expr + (-1) ** (len(subset) - len(held)) * F.avg("coef").over(W.partitionBy("row", *held))
    # the part is q times the projection onto the subset; coefficients of collapsed attributes are averaged
    return mean_rest.select("row", *subset, expr.alias("coef"))


def evaluate(coefficients: DataFrame, recon: DataFrame) -> DataFrame:
    """(query_id, row_id, answer): sum of coef * x over (mask, idx); Spark broadcasts the smaller side where it is small."""
    return coefficients.join(recon, ["mask", "idx"]).groupBy("query_id", "row_id").agg(F.sum(F.col("coef") * F.col("x")).alias("answer"))

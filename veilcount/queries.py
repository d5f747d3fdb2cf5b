"""Registered queries and their SQL. Each runs over whole tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilcount.domain import CATALOG, Attribute, Domain, catalog, submasks
from veilcount.functions import encode as E
from veilcount.functions.spectra import dft
from veilcount.operators import cells as C
from veilcount.operators import linear as L
from veilcount.operators.release import coefficients, measure
from veilcount.plans import grids
from veilcount.plans import workload as W
from veilcount.plans.planner import identity_rmse, plan
from veilcount.plans.query import KronQuery, MatrixQuery
from veilcount.plans.residual import ResidualPlan, all_pairs, uniform_rmse
from veilcount.sources.tables import from_vector, synthetic_cells, table

Q = Attribute("q", 50, E.integer("l_quantity", 1))
DISC = Attribute("disc", 11, E.scaled("l_discount", 100))
TAX = Attribute("tax", 9, E.scaled("l_tax", 100))
LINE = Attribute("line", 7, E.integer("l_linenumber", 1))
FLAG = Attribute("flag", 3, E.dictionary("l_returnflag", ("A", "N", "R")))
STATUS = Attribute("status", 2, E.dictionary("l_linestatus", ("F", "O")))
SIX = Domain([Q, DISC, TAX, LINE, FLAG, STATUS])
THREE = Domain([DISC, FLAG, STATUS])
PAIR = Domain([Q, DISC])
SMALL = Domain([DISC, TAX])

_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

CODES = """l AS (SELECT CAST(l_quantity AS BIGINT) - 1 AS q, CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax,
 l_linenumber - 1 AS line, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS status FROM lineitem)"""


def query(sql: str | None = None):
    def add(f):
        _found[f.__name__] = f, sql
        return f

    return add


def _codes(spark: SparkSession, sf_dir: str, domain: Domain) -> DataFrame:
    return C.cells(table(spark, sf_dir, "lineitem"), domain)


def _dense(spark: SparkSession, sf_dir: str, domain: Domain) -> DataFrame:
    full = (1 << len(domain)) - 1
    return C.dense(C.marginals(_codes(spark, sf_dir, domain), domain, [full]), domain, full)


def _one(attribute: Attribute) -> Domain:
    return Domain([attribute])


def _as(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items()))


def _long(df: DataFrame) -> DataFrame:
    return _as(df, {c: "bigint" for c in df.columns})


@query(f"WITH {CODES} SELECT q, disc, tax, line, flag, status, count(*) AS n FROM l GROUP BY ALL")
def cells_lineitem(spark, sf_dir):
    return _long(_codes(spark, sf_dir, SIX))


@query(f"WITH {CODES} SELECT q, count(*) AS n FROM l GROUP BY q")
def marginal_1way(spark, sf_dir):
    return _long(_codes(spark, sf_dir, _one(Q)))


@query(f"WITH {CODES} SELECT q, disc, count(*) AS n FROM l GROUP BY ALL")
def marginal_2way(spark, sf_dir):
    return _long(_codes(spark, sf_dir, PAIR))


@query(f"WITH {CODES} SELECT disc, flag, status, count(*) AS n FROM l GROUP BY ALL")
def marginal_3way(spark, sf_dir):
    return _long(_codes(spark, sf_dir, THREE))


@query("SELECT count(*) AS answer FROM lineitem")
def marginal_total(spark, sf_dir):
    return _long(L.total(_codes(spark, sf_dir, THREE)))


_MASK = " + ".join(f"CAST((1 - GROUPING({n})) * {1 << i} AS BIGINT)" for i, n in enumerate(THREE.names))
_IDX = """CASE mask WHEN 0 THEN 0 WHEN 1 THEN disc WHEN 2 THEN flag WHEN 3 THEN disc * 3 + flag WHEN 4 THEN status WHEN 5 THEN disc * 2 + status
 WHEN 6 THEN flag * 2 + status ELSE disc * 6 + flag * 2 + status END"""
_LATTICE = f"WITH {CODES}, g AS (SELECT disc, flag, status, {_MASK} AS mask, count(*) AS n FROM l GROUP BY CUBE (disc, flag, status)) SELECT mask, CAST({_IDX} AS BIGINT) AS idx, n FROM g"


@query(_LATTICE)
def marginal_lattice(spark, sf_dir):
    return _long(C.marginals(_codes(spark, sf_dir, THREE), THREE, list(range(8))))


@query(_LATTICE)
def marginal_lattice_rolled(spark, sf_dir):
    return _long(C.lattice(_codes(spark, sf_dir, THREE), THREE, list(range(8))))


_GRID = f"""WITH {CODES}, m AS (SELECT q, disc, count(*) AS n FROM l GROUP BY ALL),
 d AS (SELECT a.range AS q, b.range AS disc, coalesce(n, 0) AS n FROM range(50) a CROSS JOIN range(11) b LEFT JOIN m ON m.q = a.range AND m.disc = b.range)"""
_GRID2 = f"""WITH {CODES}, m AS (SELECT disc, tax, count(*) AS n FROM l GROUP BY ALL),
 d AS (SELECT a.range AS disc, b.range AS tax, coalesce(n, 0) AS n FROM range(11) a CROSS JOIN range(9) b LEFT JOIN m ON m.disc = a.range AND m.tax = b.range)"""


@query(f"{_GRID} SELECT q, disc, q * 11 + disc AS idx, n FROM d")
def marginal_dense(spark, sf_dir):
    return _long(_dense(spark, sf_dir, PAIR))


@query(f"WITH {CODES} SELECT range AS k, count(l.q) AS answer FROM range(50) LEFT JOIN l ON l.q <= range GROUP BY range")
def prefix_1d(spark, sf_dir):
    return _long(L.prefix(_dense(spark, sf_dir, _one(Q)), "q"))


@query(f"{_GRID2} SELECT x.disc AS k1, x.tax AS k2, CAST(sum(y.n) AS BIGINT) AS answer FROM d x JOIN d y ON y.disc <= x.disc AND y.tax <= x.tax GROUP BY ALL")
def prefix_2d(spark, sf_dir):
    return _long(L.prefix_2d(_dense(spark, sf_dir, SMALL), "disc", "tax"))


@query(f"WITH {CODES} SELECT s.range AS s, e.range AS e, count(l.q) AS answer FROM range(50) s JOIN range(50) e ON s.range <= e.range LEFT JOIN l ON l.q BETWEEN s.range AND e.range GROUP BY ALL")
def range_1d(spark, sf_dir):
    return _long(L.ranges(_dense(spark, sf_dir, _one(Q)), "q"))


@query(
    f"{_GRID2} SELECT s1.range AS s1, e1.range AS e1, s2.range AS s2, e2.range AS e2, CAST(sum(n) AS BIGINT) AS answer FROM range(11) s1 JOIN range(11) e1 ON s1.range <= e1.range"
    " CROSS JOIN (range(9) s2 JOIN range(9) e2 ON s2.range <= e2.range) JOIN d ON d.disc BETWEEN s1.range AND e1.range AND d.tax BETWEEN s2.range AND e2.range GROUP BY ALL"
)
def range_2d(spark, sf_dir):
    return _long(L.rectangles(_dense(spark, sf_dir, SMALL), "disc", "tax"))


@query(f"{_GRID2} SELECT s.range AS s, z.range + 1 AS l, CAST(sum(n) AS BIGINT) AS answer FROM range(11) s CROSS JOIN range(11) z JOIN d ON (d.disc - s.range + 11) % 11 <= z.range GROUP BY ALL")
def circ_range_1d(spark, sf_dir):
    return _long(L.circular(_dense(spark, sf_dir, _one(DISC)), "disc", 11))


@query(
    f"{_GRID2} SELECT s1.range AS s1, z1.range + 1 AS l1, s2.range AS s2, z2.range + 1 AS l2, CAST(sum(n) AS BIGINT) AS answer FROM range(11) s1 CROSS JOIN range(11) z1 CROSS JOIN range(9) s2 CROSS JOIN range(9) z2"
    " JOIN d ON (d.disc - s1.range + 11) % 11 <= z1.range AND (d.tax - s2.range + 9) % 9 <= z2.range GROUP BY ALL"
)
def circ_range_2d(spark, sf_dir):
    return _long(L.circular_2d(_dense(spark, sf_dir, SMALL), "disc", "tax", 11, 9))


@query(f"{_GRID2} SELECT range AS c, CAST(sum(n) AS BIGINT) AS answer FROM range(19) JOIN d ON d.disc + d.tax <= range GROUP BY range")
def affine_2d(spark, sf_dir):
    return _long(L.affine(_dense(spark, sf_dir, SMALL), "disc", "tax"))


@query(f"{_GRID2} SELECT range AS c, CAST(sum(n) AS BIGINT) AS answer FROM range(11) JOIN d ON abs(d.disc - d.tax) <= range GROUP BY range")
def abs_diff_2d(spark, sf_dir):
    return _long(L.abs_diff(_dense(spark, sf_dir, SMALL), "disc", "tax"))


@query("""SELECT count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_nationkey < 5 AND c_mktsegment IN ('BUILDING', 'MACHINERY')) AS near_makers, count(*) FILTER (c_nationkey >= 20) AS far_off FROM customer""")
def predicate_groups(spark, sf_dir):
    cells = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    s, k = F.col("c_mktsegment"), F.col("c_nationkey")
    return L.groups(cells, {"building": s == "BUILDING", "near_makers": (k < 5) & s.isin("BUILDING", "MACHINERY"), "far_off": k >= 20})


@query(f"{_GRID2} SELECT range AS row, CAST(sum(CASE WHEN (range * 7919 + (disc * 9 + tax) * 104729 + range * (disc * 9 + tax) * 31) % 1000003 % 100 < 30 THEN n ELSE 0 END) AS BIGINT) AS answer FROM range(6) CROSS JOIN d GROUP BY range")
def random_linear(spark, sf_dir):
    return _long(L.random_rows(_dense(spark, sf_dir, SMALL), 6, 30))


@query("""WITH c(row, a, b, coef) AS (VALUES (0, 0, 0, 0.0), (0, 0, 1, 1.0), (0, 0, 2, 1.0), (0, 1, 0, 0.0), (0, 1, 1, 0.0), (0, 1, 2, 1.0))
 SELECT a, b, round(coef - avg(coef) OVER (PARTITION BY a) - avg(coef) OVER (PARTITION BY b) + avg(coef) OVER (), 9) + 0.0 AS coef FROM c""")
def decompose_dense(spark, sf_dir):
    c = spark.createDataFrame([(0, i // 3, i % 3, v) for i, v in enumerate([0.0, 1.0, 1.0, 0.0, 0.0, 1.0])], "row int, a int, b int, coef double")
    return L.decompose(c, ["a", "b"], ["a", "b"]).select("a", "b", (F.round("coef", 9) + 0.0).alias("coef"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)


_CPS_PAIRS = [(i, j, CATALOG["cps"][0][i], CATALOG["cps"][0][j]) for i, j in all_pairs(5)]


@query(f"""WITH p(i, j, di, dj) AS (VALUES {_values(_CPS_PAIRS)}),
 w AS (SELECT 0 AS mask, 1.0 / (di * dj) AS w, 1.0 AS own FROM p UNION ALL SELECT 1 << i, 1.0 / dj, (1 - 1.0 / di) * (di - 1) FROM p UNION ALL SELECT 1 << j, 1.0 / di, (1 - 1.0 / dj) * (dj - 1) FROM p
 UNION ALL SELECT (1 << i) + (1 << j), 1.0, (1 - 1.0 / di) * (di - 1) * (1 - 1.0 / dj) * (dj - 1) FROM p)
 SELECT CAST(mask AS BIGINT) AS mask, round(CAST(sum(w) * max(own) AS DOUBLE), 4) AS loss FROM w GROUP BY mask""")
def decompose_gram_weights(spark, sf_dir):
    domain = Domain(CATALOG["cps"][0])
    p = plan(W.k_way_identity(domain, 2), solver="fourier")
    return spark.createDataFrame([(m, round(x.loss, 4)) for m, x in p.mechanisms.items()], "mask bigint, loss double")


@query(f"{_GRID2} SELECT j.range AS j_disc, round(sum(n * cos(2 * pi() * ((disc * j.range) % 11) / 11)), 3) + 0.0 AS re, round(-sum(n * sin(2 * pi() * ((disc * j.range) % 11) / 11)), 3) + 0.0 AS im FROM d CROSS JOIN range(11) j GROUP BY j.range")
def dft_1d(spark, sf_dir):
    x = dft(_dense(spark, sf_dir, _one(DISC)), {"disc": 11})
    return x.select(F.col("j_disc").cast("bigint").alias("j_disc"), (F.round("re", 3) + 0.0).alias("re"), (F.round("im", 3) + 0.0).alias("im"))


_DFT2 = f"""{_GRID2}, f AS (SELECT a.range AS j_disc, b.range AS j_tax, sum(n * cos(2 * pi() * ((disc * a.range) % 11) / 11 + 2 * pi() * ((tax * b.range) % 9) / 9)) AS re,
 -sum(n * sin(2 * pi() * ((disc * a.range) % 11) / 11 + 2 * pi() * ((tax * b.range) % 9) / 9)) AS im FROM d CROSS JOIN range(11) a CROSS JOIN range(9) b GROUP BY ALL)"""


@query(f"{_DFT2} SELECT j_disc, j_tax, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im FROM f")
def dft_2d(spark, sf_dir):
    x = dft(_dense(spark, sf_dir, SMALL), {"disc": 11, "tax": 9})
    return x.select(F.col("j_disc").cast("bigint").alias("j_disc"), F.col("j_tax").cast("bigint").alias("j_tax"), (F.round("re", 3) + 0.0).alias("re"), (F.round("im", 3) + 0.0).alias("im"))


@query(f"{_DFT2} SELECT CAST(round(sum(re * re + im * im) / 99, 0) AS BIGINT) AS energy, (SELECT CAST(sum(n * n) AS BIGINT) FROM d) AS squares FROM f")
def spectrum_energy(spark, sf_dir):
    dense = _dense(spark, sf_dir, SMALL)
    x = dft(dense, {"disc": 11, "tax": 9}).agg(F.round(F.sum(F.col("re") ** 2 + F.col("im") ** 2) / 99).cast("bigint").alias("energy"))
    return x.join(dense.agg(F.sum(F.col("n") ** 2).cast("bigint").alias("squares")))


_PREFIX_C = """WITH c AS (SELECT j, (CASE WHEN 2 * j = 10 THEN 1 ELSE 4 END) * sum(re * re + im * im) AS c FROM (SELECT j.range + 1 AS j, k.range AS k,
 sum(cos(2 * pi() * a.range * (j.range + 1) / 10)) / 10 AS re, sum(sin(2 * pi() * a.range * (j.range + 1) / 10)) / 10 AS im
 FROM range(5) j CROSS JOIN range(10) k JOIN range(10) a ON a.range <= k.range GROUP BY ALL) GROUP BY j)"""


@query(f"{_PREFIX_C} SELECT j, round(c, 6) AS c, round((SELECT sum(sqrt(c)) FROM c) / sqrt(c), 6) AS theta FROM c")
def fourier_theta(spark, sf_dir):
    p = plan(W.prefix_workload(Domain([10]), 1), solver="fourier")
    m = p.mechanisms[1]
    return spark.createDataFrame([(int(j), round(float(c), 6), round(float(t), 6)) for j, c, t in zip(m.at, m.c, m.theta, strict=True)], "j bigint, c double, theta double")


@query(f"{_PREFIX_C} SELECT round(sum(sqrt(c)) ** 2, 6) AS loss FROM c")
def fourier_loss(spark, sf_dir):
    p = plan(W.prefix_workload(Domain([10]), 1), solver="fourier")
    return spark.createDataFrame([(round(p.mechanisms[1].loss, 6),)], "loss double")


_CPS = _values([(i, d) for i, d in enumerate(CATALOG["cps"][0])])


@query(f"""WITH a(i, d) AS (VALUES {_CPS}), l AS (SELECT 0 AS mask, sum(1.0 / d) AS loss FROM a UNION ALL SELECT 1 << i, (1 - 1.0 / d) * (d - 1) FROM a)
 SELECT CAST(mask AS BIGINT) AS mask, round(CAST((SELECT sum(sqrt(loss)) FROM l) / 2 / sqrt(loss) AS DOUBLE), 6) AS sigma2 FROM l""")
def assemble_sigma2(spark, sf_dir):
    p = plan(W.identity_workload(Domain(CATALOG["cps"][0]), 1), cost=2.0)
    return spark.createDataFrame([(m, round(s, 6)) for m, s in p.sigma2.items()], "mask bigint, sigma2 double")


def _noiseless(spark, sf_dir, workload, solver="best", queries=None) -> DataFrame:
    p = plan(workload, solver=solver)
    out = measure(table(spark, sf_dir, "lineitem"), p, noise=False).answers(queries)
    return out.select("query_id", "row_id", F.round("answer").cast("bigint").alias("answer"))


_ROWS_PREFIX = f"WITH {CODES} SELECT CAST(0 AS BIGINT) AS query_id, range AS row_id, count(l.q) AS answer FROM range(50) LEFT JOIN l ON l.q <= range GROUP BY range"


@query(_ROWS_PREFIX)
def noiseless_fourier_prefix(spark, sf_dir):
    return _noiseless(spark, sf_dir, W.prefix_workload(_one(Q), 1), "fourier")


@query(_ROWS_PREFIX)
def noiseless_convex_prefix(spark, sf_dir):
    return _noiseless(spark, sf_dir, W.prefix_workload(_one(Q), 1), "convex")


@query(f"WITH {CODES}, p AS (SELECT s.range AS s, e.range AS e, row_number() OVER (ORDER BY s.range, e.range) - 1 AS row_id FROM range(11) s JOIN range(11) e ON s.range <= e.range) SELECT CAST(0 AS BIGINT) AS query_id, row_id, count(l.disc) AS answer FROM p LEFT JOIN l ON l.disc BETWEEN s AND e GROUP BY row_id")
def noiseless_fourier_range(spark, sf_dir):
    return _noiseless(spark, sf_dir, W.range_workload(_one(DISC), 1), "fourier")


def _pair(make, domain=PAIR) -> W.Workload:
    return W.Workload(domain, [MatrixQuery(domain, (0, 1), make(*domain.sizes))])


@query(f"WITH {CODES} SELECT CAST(0 AS BIGINT) AS query_id, range AS row_id, count(l.q) AS answer FROM range(60) LEFT JOIN l ON l.q + l.disc <= range GROUP BY range")
def noiseless_fourier_affine(spark, sf_dir):
    return _noiseless(spark, sf_dir, _pair(W.affine), "fourier")


@query(f"WITH {CODES} SELECT CAST(0 AS BIGINT) AS query_id, range AS row_id, count(l.q) AS answer FROM range(60) LEFT JOIN l ON l.q + l.disc <= range GROUP BY range")
def noiseless_convex_affine(spark, sf_dir):
    return _noiseless(spark, sf_dir, _pair(W.affine), "convex")


@query(f"WITH {CODES} SELECT CAST(0 AS BIGINT) AS query_id, range AS row_id, count(l.disc) AS answer FROM range(11) LEFT JOIN l ON abs(l.disc - l.tax) <= range GROUP BY range")
def noiseless_fourier_abs_diff(spark, sf_dir):
    return _noiseless(spark, sf_dir, _pair(W.abs_diff, SMALL), "fourier")


@query(f"{_GRID2} SELECT CAST(0 AS BIGINT) AS query_id, disc * 9 + tax AS row_id, n AS answer FROM d")
def noiseless_fourier_identity(spark, sf_dir):
    return _noiseless(spark, sf_dir, W.k_way_identity(SMALL, 2), "fourier")


@query(f"""WITH {CODES} SELECT CAST(0 AS BIGINT) AS query_id, (a.range * 3 + b.range) * 2 + c.range AS row_id, count(l.disc) AS answer
 FROM range(11) a CROSS JOIN range(3) b CROSS JOIN range(2) c LEFT JOIN l ON l.disc = a.range AND l.flag = b.range AND l.status = c.range GROUP BY ALL""")
def noiseless_fourier_3way(spark, sf_dir):
    return _noiseless(spark, sf_dir, W.k_way_identity(THREE, 3), "fourier")


_KRON = f"WITH {CODES} SELECT CAST(0 AS BIGINT) AS query_id, a.range * 9 + b.range AS row_id, count(l.disc) AS answer FROM range(11) a CROSS JOIN range(9) b LEFT JOIN l ON l.disc <= a.range AND l.tax <= b.range GROUP BY ALL"


@query(_KRON)
def noiseless_kron_prefix(spark, sf_dir):
    return _noiseless(spark, sf_dir, W.build(SMALL, [(0, 1)], lambda a, d: W.prefix(d)), "kron")


@query(f"""WITH {CODES} SELECT CAST(0 AS BIGINT) AS query_id, range AS row_id, count(l.disc) AS answer FROM range(11) LEFT JOIN l ON l.disc <= range GROUP BY range
 UNION ALL SELECT 1, range, count(l.disc) FROM range(11) LEFT JOIN l ON l.disc = range GROUP BY range""")
def noiseless_weighted(spark, sf_dir):
    d = _one(DISC)
    return _noiseless(spark, sf_dir, W.Workload(d, [KronQuery(d, (0,), [W.prefix(11)], 1.0), KronQuery(d, (0,), [W.identity(11)], 5.0)]))


@query(f"WITH {CODES} SELECT CAST(0 AS BIGINT) AS query_id, CAST(0 AS BIGINT) AS row_id, count(*) AS answer FROM l WHERE disc >= 5 AND tax < 3")
def noiseless_adhoc(spark, sf_dir):
    ask = KronQuery(SMALL, (0, 1), [W.half_open(11, 5, 11), W.half_open(9, 0, 3)])
    return _noiseless(spark, sf_dir, W.affine_workload(SMALL, 2), "fourier", [ask])


@query(f"WITH {CODES} SELECT CAST(0 AS BIGINT) AS query_id, CAST(0 AS BIGINT) AS row_id, count(*) AS answer FROM l WHERE disc >= 5 AND tax < 3")
def noiseless_adhoc_relational(spark, sf_dir):
    """The same through coefficients joined to the reconstructed marginals."""
    p = plan(W.affine_workload(SMALL, 2), solver="fourier")
    r = measure(table(spark, sf_dir, "lineitem"), p, noise=False)
    (coefs,) = coefficients(spark, [KronQuery(SMALL, (0, 1), [W.half_open(11, 5, 11), W.half_open(9, 0, 3)])])
    return L.evaluate(coefs, r.recon).select("query_id", "row_id", F.round("answer").cast("bigint").alias("answer"))


@query("SELECT CAST(0 AS BIGINT) AS query_id, CAST(0 AS BIGINT) AS row_id, CAST(8 AS BIGINT) AS answer")
def noiseless_single_row_kron(spark, sf_dir):
    d = Domain([2, 3])
    p = plan(W.Workload(d, [KronQuery(d, (0, 1), [[[1, 0]], [[1, 1, 0]]])]))
    out = measure(from_vector(spark, d, [5, 3, 2, 1, 4, 6]), p, noise=False, counted=True).answers()
    return out.select("query_id", "row_id", F.round("answer").cast("bigint").alias("answer"))


def _orders_sql(tables: list[tuple[str, tuple[int, ...], int]]) -> str:
    """RMSE of closed-form mechanisms for all marginals of 1, 2, 3 and 1-3 attributes: the first attributes by prefixes, the others by identity.

    Of each attribute: r, the sum over frequencies of the root of the rows' energy, and t, the squares of the rows' shares of
    the total.  A subset's root is the product of its r times the root of the sum, over the marginals above, of the others' t.
    """
    rows = _values([(f"'{name}'", i, d, int(i < numeric)) for name, sizes, numeric in tables for i, d in enumerate(sizes)])
    bits = "(VALUES (0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0), (0, 0, 1), (1, 0, 1), (0, 1, 1), (1, 1, 1)) b(x, y, z)"
    term = lambda e, u: f"coalesce(CASE WHEN b.{u} = 1 THEN {e}.r ELSE sqrt({e}.t) END, 1)"
    own = lambda e, u: f"coalesce(CASE WHEN b.{u} = 1 THEN {e}.r END, 1)"
    mask = " + ".join(f"coalesce(b.{u} * (CAST(1 AS BIGINT) << {e}.i), 0)" for e, u in (("p", "x"), ("q", "y"), ("w", "z")))
    fits = "(q.i IS NOT NULL OR b.y = 0) AND (w.i IS NOT NULL OR b.z = 0)"
    return f"""WITH a(name, i, d, prefixes) AS (VALUES {rows}),
 f AS (SELECT name, i, d, CASE WHEN prefixes = 1 THEN (SELECT sum(1 / (sqrt(2 * d) * sin(pi() * j / d))) FROM generate_series(1, d - 1) g(j)) ELSE (d - 1) / sqrt(d) END AS r,
  CASE WHEN prefixes = 1 THEN (d + 1) * (2 * d + 1) / (6.0 * d) ELSE 1.0 / d END AS t FROM a),
 s AS (SELECT p.name, 1 AS k, p.i AS i1, NULL AS i2, NULL AS i3, p.d AS n FROM f p
  UNION ALL SELECT p.name, 2, p.i, q.i, NULL, p.d * q.d FROM f p JOIN f q ON p.name = q.name AND p.i < q.i
  UNION ALL SELECT p.name, 3, p.i, q.i, w.i, p.d * q.d * w.d FROM f p JOIN f q ON p.name = q.name AND p.i < q.i JOIN f w ON w.name = q.name AND q.i < w.i),
 m AS (SELECT s.name, s.k, {mask} AS mask, n, (b.x + b.y + b.z = s.k)::INT AS top, ({term("p", "x")} * {term("q", "y")} * {term("w", "z")}) ** 2 AS v
  FROM s JOIN f p ON p.name = s.name AND p.i = s.i1 LEFT JOIN f q ON q.name = s.name AND q.i = s.i2 LEFT JOIN f w ON w.name = s.name AND w.i = s.i3 JOIN {bits} ON {fits}),
 o AS (SELECT name, CAST(k AS VARCHAR) AS orders, mask, n * top AS n, v FROM m UNION ALL SELECT name, '1-3', mask, n * top, v FROM m),
 l AS (SELECT name, orders, mask, sum(n) AS n, sqrt(sum(v)) AS root FROM o GROUP BY ALL)
 SELECT name, orders, round(CAST(sum(root) / sqrt(sum(n)) AS DOUBLE), 4) AS rmse FROM l GROUP BY ALL"""


ORDERS = {"1": range(1, 2), "2": range(2, 3), "3": range(3, 4), "1-3": range(1, 4)}


def _identity(name: str):
    def f(spark, sf_dir):
        sizes = CATALOG[name][0]
        return spark.createDataFrame([(name, o, round(identity_rmse(sizes, k), 4)) for o, k in ORDERS.items()], "name string, orders string, rmse double")

    f.__name__ = f"rmse_identity_{name}"
    return query(_orders_sql([(name, CATALOG[name][0], 0)]))(f)


LARGE = ("adult", "cps", "loans")
for _name in LARGE:
    _identity(_name)


@query(f"""WITH a(i, d) AS (VALUES {_CPS}), v AS (SELECT 0 AS mask, 1.0 AS p, sum(1.0 / d) AS v FROM a UNION ALL SELECT 1 << i, 1 - 1.0 / d, d - 1 FROM a)
 SELECT CAST(mask AS BIGINT) AS mask, round(CAST(sqrt((SELECT sum(sqrt(v * p)) ** 2 FROM v) * p / v) AS DOUBLE), 5) AS sigma2 FROM v""")
def rpp_sumvar_allocation(spark, sf_dir):
    """Identity strategies rescaled to noise I: cost 1 - 1/d and variance d - 1 per attribute."""
    p = ResidualPlan(Domain(CATALOG["cps"][0]), ["I"] * 5, [(i,) for i in range(5)])
    scale = {1 << i: s.cost / (1 - 1 / d) for i, (s, d) in enumerate(zip(p.strategies, p.domain.sizes, strict=True))}
    return spark.createDataFrame([(m, round(float(s) / scale.get(m, 1.0), 5)) for m, _, _, s in p.allocation()], "mask bigint, sigma2 double")


#: Closed form for 1-way identity marginals: with noise level s on the total and largest variance t, an attribute of d values
#: takes (1 - 1/d)^2 / (t - s / d^2) of the budget; t by halving for each s of a grid.
@query("""WITH RECURSIVE a(d) AS (VALUES (2.0), (5.0), (9.0)),
 g AS (SELECT 1 + range / 2000.0 AS s FROM range(1, 8000)),
 h AS (SELECT s, s / 4 AS lo, s / 4 + 100.0 AS hi, 0 AS step FROM g
  UNION ALL SELECT s, CASE WHEN used > 1 THEN mid ELSE lo END, CASE WHEN used > 1 THEN hi ELSE mid END, step + 1 FROM
   (SELECT s, lo, hi, step, (lo + hi) / 2 AS mid, 1 / s + sum((1 - 1 / d) ** 2 / greatest((lo + hi) / 2 - s / d ** 2, 1e-12)) AS used FROM h, a WHERE step < 40 GROUP BY s, lo, hi, step))
 SELECT round(CAST(min(hi) AS DOUBLE), 3) AS largest_variance FROM h WHERE step = 40""")
def rpp_maxvar_identity(spark, sf_dir):
    p = ResidualPlan(Domain([2, 5, 9]), ["I"] * 3, [(0,), (1,), (2,)], objective="max", gap=1e-6)
    return spark.createDataFrame([(round(max(float(p.row_variances(m).max()) for m in p.subsets), 3),)], "largest_variance double")


@query()
def rpp_maxvar_allocation(spark, sf_dir):
    """Prefixes and ranges, where a marginal's queries differ in variance; held against a certificate in the tests."""
    p = ResidualPlan(Domain(CATALOG["simple_adult"][0]), ["I", "P", "R"], [(0, 1), (1, 2), (0, 2)], objective="max")
    return spark.createDataFrame([(m, round(s, 3)) for m, _, _, s in p.allocation()], "mask bigint, sigma2 double")


@query(f"""WITH {CODES} SELECT CAST(3 AS BIGINT) AS mask, a.range * 3 + b.range AS idx, count(l.disc) AS n FROM range(11) a CROSS JOIN range(3) b LEFT JOIN l ON l.disc = a.range AND l.flag = b.range GROUP BY ALL
 UNION ALL SELECT CAST(4 AS BIGINT), range, count(l.disc) FROM range(2) LEFT JOIN l ON l.status = range GROUP BY range""")
def rpp_marginals(spark, sf_dir):
    """Residual planner over lineitem without noise: the marginals come back exactly."""
    p = ResidualPlan(THREE, ["P", "I", "R"], [(0, 1), (2,)])
    return p.measure(table(spark, sf_dir, "lineitem"), noise=False).select("mask", "idx", F.round("x").cast("bigint").alias("n"))


def _prefix_rmse(name: str, orders: range, solver: str) -> float:
    d, numeric = catalog(name)
    return plan(W.mixed_workload(d, max(orders), numeric, min(orders)), solver=solver).rmse


@query(_orders_sql([(name, *CATALOG[name]) for name in LARGE]))
def rmse_prefix_catalog(spark, sf_dir):
    """Closed-form mechanisms, prefixes on the numeric attributes."""
    rows = [(name, o, round(_prefix_rmse(name, k, "fourier"), 4)) for name in LARGE for o, k in ORDERS.items()]
    return spark.createDataFrame(rows, "name string, orders string, rmse double")


@query()
def rmse_prefix_best(spark, sf_dir):
    """The same by the best mechanisms; their losses are held against certificates in the tests."""
    rows = [(name, o, round(_prefix_rmse(name, k, "best"), 3)) for name in LARGE for o, k in ORDERS.items()]
    return spark.createDataFrame(rows, "name string, orders string, rmse double")


@query("""WITH t AS (SELECT n, (10 + 10 * range) AS m FROM (SELECT 40 AS n), range(5)),
 c AS (SELECT m, 40.0 / m + 780.0 / m ** 2 AS l0, (1 + 39.0 / m) * (m - 1) ** 2 / m AS l1, CAST((m - 1) AS DOUBLE) ** 4 / m ** 2 AS l2, 40 * m + 780 * m ** 2 AS rows FROM t)
 SELECT CAST(m AS BIGINT) AS n, round(CAST((sqrt(l0) + 40 * sqrt(l1) + 780 * sqrt(l2)) / sqrt(rows) AS DOUBLE), 4) AS rmse, round(CAST((sqrt(l0) + 40 * sqrt(l1) + 780 * sqrt(l2)) / sqrt(rows) AS DOUBLE), 2) AS rmse_residual FROM c""")
def rmse_uniform_grid(spark, sf_dir):
    return spark.createDataFrame([(n, round(identity_rmse((n,) * 40, range(1, 3)), 4), round(uniform_rmse(n, 40, 2), 2)) for n in (10, 20, 30, 40, 50)], "n bigint, rmse double, rmse_residual double")


@query()
def rmse_two_way_families(spark, sf_dir):
    """All 1- and 2-way marginals of 40 attributes of 10 values, by family."""
    rows = [(f, solver, round(grids.two_way(f, 10, 40, solver), 3)) for f in grids.FAMILIES for solver in ("fourier", "best")]
    return spark.createDataFrame(rows, "family string, solver string, rmse double")


@query()
def rmse_thresholds_catalog(spark, sf_dir):
    """Affine and absolute-difference thresholds on pairs of numeric attributes, where their residual is small enough."""
    rows = [(name, pair, round(rmse, 3), notes) for name, pair, rmse, notes in grids.thresholds(("cps", "age_income"))]
    return spark.createDataFrame(rows, "name string, family string, rmse double, replaced bigint")


@query("SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_daily_type(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT least(CAST(floor(value / 10) AS BIGINT), 9) AS bucket, count(*) AS n FROM events WHERE value >= 0 GROUP BY ALL")
def events_value_buckets(spark, sf_dir):
    d = Domain([Attribute("bucket", 10, E.buckets("value", tuple(range(0, 100, 10)), policy="drop"))])
    return _long(C.cells(table(spark, sf_dir, "events"), d))


@query("SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL")
def orders_join_customer_marginal(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_orderpriority").agg(F.sum("n").alias("n"))


@query("WITH x AS (SELECT range AS idx, range // 20 AS a0, range // 4 % 5 AS a1, range % 4 AS a2 FROM range(60)) SELECT a0, a1, a2, count(*) AS cells FROM x GROUP BY ALL")
def synthetic(spark, sf_dir):
    made = synthetic_cells(spark, Domain([3, 5, 4]))
    return _long(made.where("n between 1 and 49").groupBy("a0", "a1", "a2").agg(F.count("*").alias("cells")))


@query()
def noisy_release(spark, sf_dir):
    """Fixed seed, for reproduction only."""
    p = plan(W.prefix_workload(SMALL, 2), cost=1.0)
    out = measure(table(spark, sf_dir, "lineitem"), p, seed=7).answers()
    return out.select("query_id", "row_id", F.round("answer", 3).alias("answer"), F.round("variance", 4).alias("variance"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noiseless prefixes and affine thresholds on lineitem through the whole chain, with the variance a release would have."""
    w = W.Workload(PAIR, [KronQuery(PAIR, (0,), [W.prefix(50)], name="prefix"), MatrixQuery(PAIR, (0, 1), W.affine(50, 11), name="affine")])
    p = plan(w)
    answers = measure(table(spark, sf_dir, "lineitem"), p, noise=False).answers().drop("variance")
    predicted = [(i, r, float(v)) for i, q in enumerate(w.queries) for r, v in enumerate(p.variances(q))]
    known = spark.createDataFrame(predicted, "query_id bigint, row_id bigint, variance double")
    return answers.join(known, ["query_id", "row_id"]).select("query_id", "row_id", F.round("answer").cast("bigint").alias("answer"), F.round("variance", 4).alias("variance"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _found.items() if sql}

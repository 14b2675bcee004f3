"""Fits of small dictionaries and searched directions, to six places, each with the same result in SQL."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.operators import calibration, signals, solvers
from voxelmill.plans import fitting
from voxelmill.plans.queries import _BASE, _r
from voxelmill.schema import hemisphere
from voxelmill.sources import fixtures as X
from voxelmill.storage import stash

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):  # noqa: ANN202
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], SQL[f.__name__] = f, _BASE + sql
        return f

    return add


def _spiral(n: int) -> str:
    """SQL of the rows (i, ux, uy, uz) of ``hemisphere(n)``."""
    return f"""SELECT i, sqrt(1 - z * z) * cos(a) AS ux, sqrt(1 - z * z) * sin(a) AS uy, z AS uz
  FROM (SELECT i, 1 - (i + 0.5::DOUBLE) / {n} AS z, 2 * pi() * i / ((1 + sqrt(5)) / 2) AS a FROM range({n}) t(i))"""


def _scored(name: str, candidates: str) -> str:
    """SQL of ``name``: closed-form tensor and squared error of candidates (voxel_id, c, vx, vy, vz)."""
    rest = "rf * exp(-b * 0.15e-3) - hf * exp(-b * 1e-3) - wf * exp(-b * 3e-3)"
    return f"""{name}p AS (SELECT q.*, b, ff, rf, hf, wf, sn, (gx * vx + gy * vy + gz * vz) ** 2 AS k2 FROM ({candidates}) q JOIN norm USING (voxel_id) JOIN (SELECT m, gx, gy, gz FROM protocol) USING (m)),
{name}r AS (SELECT voxel_id, c, sum(w * b * b) AS a, sum(w * b * b * k2) AS d, sum(w * b * k2 * b * k2) AS e, sum(w * b * y) AS p, sum(w * b * k2 * y) AS q
  FROM (SELECT voxel_id, c, b, k2, greatest(sn, 0.01) ** 2 AS w, ln(greatest(0.01::DOUBLE, least(1.0::DOUBLE, (greatest(sn, 0.01) - {rest}) / (ff + 1e-12)))) AS y FROM {name}p) GROUP BY ALL),
{name}t AS (SELECT voxel_id, c, greatest(0.05e-3, least(3.5e-3, -(p * e - q * d) / (a * e - d * d) - (q * a - p * d) / (a * e - d * d))) AS ad, greatest(0.15e-3, least(3e-3, -(p * e - q * d) / (a * e - d * d))) AS rd FROM {name}r WHERE abs(a * e - d * d) >= 1e-20),
{name}f AS (SELECT voxel_id, c, CASE WHEN ad < rd THEN (ad + rd) / 2 ELSE ad END AS ad, CASE WHEN ad < rd THEN (ad + rd) / 2 ELSE rd END AS rd FROM {name}t),
{name} AS (SELECT voxel_id, c, any_value(vx) AS vx, any_value(vy) AS vy, any_value(vz) AS vz, any_value(ad) AS ad, any_value(rd) AS rd, sum((sn - {rest} - ff * exp(-b * (rd + (ad - rd) * k2))) ** 2) AS error FROM {name}p JOIN {name}f USING (voxel_id, c) GROUP BY ALL)"""


def _cone(start: str, half: str, n: str) -> str:
    """SQL of the candidates of a cone round each row of ``start``, and of the row itself as the first."""
    turn = "2 * pi() * i / ((1 + sqrt(5)) / 2)"
    x = [f"(CASE WHEN flat THEN {a} ELSE {b} END)" for a, b in (("0", "-vz"), ("vz", "0"), ("-vy", "vx"))]
    y = ["vy * xz - vz * xy", "vz * xx - vx * xz", "vx * xy - vy * xx"]
    out = ", ".join(f"(z * v{c} + sqrt(greatest(0, 1 - z * z)) * (cos({turn}) * x{c} + sin({turn}) * ({y[k]}))) AS v{c}" for k, c in enumerate("xyz"))
    size = " + ".join(f"({v}) ** 2" for v in x)
    return f"""SELECT voxel_id, -1 AS c, vx, vy, vz FROM {start} UNION ALL
  SELECT voxel_id, i AS c, {", ".join(f"v{c} / sqrt(vx * vx + vy * vy + vz * vz)" for c in "xyz")} FROM (SELECT voxel_id, i, {out} FROM (
    SELECT *, {", ".join(f"{v} / sqrt({size}) AS x{c}" for v, c in zip(x, "xyz"))} FROM (
      SELECT s.*, i, abs(vx) < 0.9 AS flat, 1 - (i + 0.5::DOUBLE) / {n} * (1 - cos({half})) AS z FROM {start} s CROSS JOIN plan CROSS JOIN range(64) t(i) WHERE i < {n})))"""


_CONES = f""", u AS ({_spiral(62)}),
far AS (SELECT avg(acos(greatest(-1, least(1, d)))) AS grid FROM (SELECT x.i, max(x.ux * y.ux + x.uy * y.uy + x.uz * y.uz) AS d FROM u x JOIN u y ON x.i <> y.i GROUP BY x.i)),
plan AS (SELECT grid, sqrt(grid * radians(1)) AS middle, greatest(4, ceil(grid / radians(1) - 1e-9)) AS n1, greatest(4, ceil(grid / radians(1) - 1e-9)) AS n2 FROM far),
v AS (SELECT voxel_id, any_value(ux) AS tx, any_value(uy) AS ty, any_value(uz) AS tz FROM norm WHERE in_mask GROUP BY voxel_id),
begin0 AS (SELECT voxel_id, vx, vy, vz FROM (SELECT voxel_id, u.ux AS vx, u.uy AS vy, u.uz AS vz, row_number() OVER (PARTITION BY voxel_id ORDER BY abs(u.ux * tx + u.uy * ty + u.uz * tz) DESC, i) AS k FROM v CROSS JOIN u) WHERE k = 1),
{_scored("one", _cone("begin0", "grid", "n1"))},
begin1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY voxel_id ORDER BY error, c) AS k FROM one) WHERE k = 1),
{_scored("two", _cone("(SELECT voxel_id, vx, vy, vz FROM begin1)", "middle", "n2"))},
final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY voxel_id ORDER BY error, c) AS k FROM two) WHERE k = 1)
SELECT voxel_id, round(f.vx, 6) AS ref_x, round(f.vy, 6) AS ref_y, round(f.vz, 6) AS ref_z, round(1000 * f.ad, 6) AS ref_ad, round(1000 * f.rd, 6) AS ref_rd, round(o.error, 6) AS ref_error0, round(f.error, 6) AS ref_error,
  round(abs(f.vx * tx + f.vy * ty + f.vz * tz), 6) AS cos_refined FROM final f JOIN v USING (voxel_id) JOIN (SELECT voxel_id, error FROM one WHERE c = -1) o USING (voxel_id)
"""


@_query(_CONES)
def cone_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direction and tensor of one fiber, searched in two cones around the nearest of 62 directions."""
    out = fitting.refined_directions(spark, sf_dir)
    return out.select("voxel_id", *[_r(F.col(f"ref_{c}")).alias(f"ref_{c}") for c in "xyz"], *[_r(F.col(f"ref_{n}"), 1000).alias(f"ref_{n}") for n in ("ad", "rd")], *[_r(F.col(c)).alias(c) for c in ("ref_error0", "ref_error", "cos_refined")])


SMALL_AD, SMALL_RD, SMALL_GRID, SMALL_FIBER, SMALL_ISO = 1.7e-3, 0.3e-3, (0.2e-3, 1.5e-3), 0.5, 0.01


def _inverses(name: str, systems: str) -> str:
    """SQL of ``name``(v, s, i, j, x): inverses by elimination of the matrices of ``systems`` (v, s, i, r), six rows each."""
    return f"""{name} AS (WITH RECURSIVE e AS (
    SELECT 0 AS k, v, s, i, list_concat(r, [CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END for j in range(6)]) AS r FROM ({systems})
    UNION ALL SELECT k + 1, v, s, i, CASE WHEN i = k THEN [x / r[k + 1] for x in r] ELSE [r[c] - r[k + 1] / p[k + 1] * p[c] for c in range(1, 13)] END
      FROM (SELECT *, max(r) FILTER (WHERE i = k) OVER (PARTITION BY v, s) AS p FROM e WHERE k < 6))
  SELECT v, s, i, j, r[7 + j] AS x FROM e, range(6) t(j) WHERE k = 6)"""


def _best(name: str, weights: str) -> str:
    """SQL of ``name``(voxel_id, w): of the weights (voxel_id, s, i, w, h) of each set of columns, the non-negative ones of least cost."""
    return f"""{name} AS (SELECT voxel_id, w FROM (SELECT *, row_number() OVER (PARTITION BY voxel_id ORDER BY gain DESC, s) AS k FROM (
    SELECT voxel_id, s, list(w ORDER BY i) AS w, sum(w * h) AS gain FROM ({weights}) GROUP BY voxel_id, s HAVING min(w) >= 0)) WHERE k = 1)"""


def _shares(name: str, solved: str) -> str:
    """SQL of ``name``(voxel_id, w, c): weights and the share of their largest basin, each direction having one neighbour."""
    return f"""{name}t AS (SELECT voxel_id, d, w[d + 1] AS t FROM {solved}, range(4) r(d)),
{name}p AS (SELECT * FROM {name}t t WHERE t.t > 0 AND NOT EXISTS (SELECT 1 FROM graph g JOIN {name}t n ON n.d = g.nb WHERE g.d = t.d AND n.voxel_id = t.voxel_id AND n.t > 0 AND (n.t > t.t OR n.t = t.t AND n.d < t.d))),
{name}o AS (SELECT x.voxel_id, p.d AS peak, x.t, row_number() OVER (PARTITION BY x.voxel_id, x.d ORDER BY round(abs(a.ux * b.ux + a.uy * b.uy + a.uz * b.uz), 12) DESC, p.d) AS k
  FROM {name}t x JOIN {name}p p USING (voxel_id) JOIN four a ON a.i = x.d JOIN four b ON b.i = p.d),
{name}m AS (SELECT voxel_id, max(mass) / sum(mass) AS c FROM (SELECT voxel_id, peak, sum(t) AS mass FROM {name}o WHERE k = 1 GROUP BY ALL) GROUP BY voxel_id HAVING sum(mass) >= 1e-10),
{name} AS (SELECT voxel_id, w, coalesce(c, 0) AS c FROM {solved} LEFT JOIN {name}m USING (voxel_id))"""


_SMALL = f""", four AS ({_spiral(4)}),
graph AS (SELECT d, nb FROM (SELECT x.i AS d, y.i AS nb, row_number() OVER (PARTITION BY x.i ORDER BY round(x.ux * y.ux + x.uy * y.uy + x.uz * y.uz, 12) DESC, y.i DESC) AS k FROM four x JOIN four y ON x.i <> y.i) WHERE k = 1),
col AS (SELECT i, m, exp(-b * ({SMALL_RD} + ({SMALL_AD} - {SMALL_RD}) * (gx * ux + gy * uy + gz * uz) ** 2)) AS a FROM four CROSS JOIN protocol
  UNION ALL SELECT 4 + k, m, exp(-b * d) FROM protocol, (VALUES (0, {SMALL_GRID[0]}::DOUBLE), (1, {SMALL_GRID[1]}::DOUBLE)) t(k, d)),
gram AS (SELECT x.i, y.i AS j, sum(x.a * y.a) AS g FROM col x JOIN col y USING (m) GROUP BY ALL),
proj AS (SELECT voxel_id, i, sum(a * sn) AS h FROM norm JOIN col USING (m) WHERE in_mask GROUP BY ALL),
sets AS (SELECT s, i, s // (2 ** i)::INT % 2 AS has FROM range(64) t(s), range(6) r(i)),
{_inverses("inv", f"SELECT 0 AS v, x.s, x.i, list(CASE WHEN x.has = 1 AND y.has = 1 THEN g + CASE WHEN x.i <> y.i THEN 0 WHEN x.i < 4 THEN {SMALL_FIBER} ELSE {SMALL_ISO} END WHEN x.i = y.i THEN 1 ELSE 0 END::DOUBLE ORDER BY y.i) AS r FROM sets x JOIN sets y USING (s) JOIN gram ON gram.i = x.i AND gram.j = y.i GROUP BY x.s, x.i")},
{_best("solved", "SELECT voxel_id, inv.s, inv.i, sum(x * has * h) AS w, any_value(q.own) AS h FROM inv JOIN sets ON sets.s = inv.s AND sets.i = inv.j JOIN proj ON proj.i = inv.j JOIN (SELECT voxel_id, i, h AS own FROM proj) q USING (voxel_id) WHERE q.i = inv.i GROUP BY voxel_id, inv.s, inv.i")},
{_shares("first", "solved")}"""
_SMALL_PARTS = """ SELECT voxel_id, round(ff / tot, 6) AS ff, round(w[5] / tot, 6) AS rf, round(w[6] / tot, 6) AS hf, round(1000 * CASE WHEN w[5] + w[6] > 0 THEN (w[5] * 0.2e-3 + w[6] * 1.5e-3) / (w[5] + w[6]) ELSE 0 END, 6) AS mean_iso_adc, round(c, 6) AS concentration
FROM (SELECT *, w[1] + w[2] + w[3] + w[4] AS ff, w[1] + w[2] + w[3] + w[4] + w[5] + w[6] AS tot FROM {}) WHERE tot >= 1e-10"""


def _small(spark: SparkSession, sf_dir: str, again: bool) -> DataFrame:
    dictionary = solvers.Dictionary(X.PROTOCOL, hemisphere(4), [(SMALL_AD, SMALL_RD)], list(SMALL_GRID), 1)
    rows = fitting._rows(spark, sf_dir).select("voxel_id", "signal")
    out = fitting.with_fractions(solvers.spectra(rows, dictionary, SMALL_FIBER, SMALL_ISO, again=again, spread=(0.6, 0.9, 8.0)))
    return out.select("voxel_id", *[_r(F.col(c)).alias(c) for c in ("ff", "rf", "hf")], _r(F.col("mean_iso_adc"), 1000).alias("mean_iso_adc"), _r(F.col("concentration")).alias("concentration"))


@_query(_SMALL + _SMALL_PARTS.format("first"))
def small_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions and concentration of spectra over four directions and two isotropic diffusivities."""
    return _small(spark, sf_dir, False)


@_query(_SMALL + f""", loose AS (SELECT voxel_id, {SMALL_FIBER} * (1 + 7 * greatest(0, least(1, (0.9 - c) / (0.9 - 0.6)))) AS fiber FROM first WHERE c < 0.9),
{_inverses("inv2", f"SELECT voxel_id AS v, x.s, x.i, list(CASE WHEN x.has = 1 AND y.has = 1 THEN g + CASE WHEN x.i <> y.i THEN 0 WHEN x.i < 4 THEN fiber ELSE {SMALL_ISO} END WHEN x.i = y.i THEN 1 ELSE 0 END::DOUBLE ORDER BY y.i) AS r FROM loose CROSS JOIN sets x JOIN sets y USING (s) JOIN gram ON gram.i = x.i AND gram.j = y.i GROUP BY voxel_id, x.s, x.i")},
{_best("resolved", "SELECT v AS voxel_id, inv2.s, inv2.i, sum(x * has * h) AS w, any_value(q.own) AS h FROM inv2 JOIN sets ON sets.s = inv2.s AND sets.i = inv2.j JOIN proj ON proj.voxel_id = v AND proj.i = inv2.j JOIN (SELECT voxel_id, i, h AS own FROM proj) q ON q.voxel_id = v AND q.i = inv2.i GROUP BY v, inv2.s, inv2.i")},
merged AS (SELECT voxel_id, w FROM resolved UNION ALL SELECT voxel_id, w FROM solved ANTI JOIN loose USING (voxel_id)),
{_shares("second", "merged")}""" + _SMALL_PARTS.format("second"))
def small_spectrum_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, solved again with a greater fiber penalty where the fiber weight is spread."""
    return _small(spark, sf_dir, True)


_CAP_GRID = (0.3e-3, 1.0e-3, 3.0e-3)
_ISO_SAMPLE = """, ok AS (SELECT voxel_id, s0 FROM vox WHERE in_mask AND s0 > (SELECT 0.05::DOUBLE * quantile_cont(s0, 0.5) FROM vox WHERE in_mask AND s0 > 0)),
cal AS (SELECT * FROM ok ORDER BY (voxel_id * 7919 + 104729) % 1000003, voxel_id LIMIT 500),
y AS (SELECT sig.voxel_id, m, b, gx, gy, gz, s / cal.s0 AS y FROM sig JOIN cal USING (voxel_id) JOIN (SELECT m, gx, gy, gz FROM protocol) USING (m)),
h AS (SELECT voxel_id, sum(y * y) AS yy, sum(y * exp(-b * 0.3e-3)) AS h1, sum(y * exp(-b * 1e-3)) AS h2, sum(y * exp(-b * 3e-3)) AS h3 FROM y GROUP BY voxel_id),
g AS (SELECT sum(exp(-b * 0.6e-3)) AS g11, sum(exp(-b * 1.3e-3)) AS g12, sum(exp(-b * 3.3e-3)) AS g13, sum(exp(-b * 2e-3)) AS g22, sum(exp(-b * 4e-3)) AS g23, sum(exp(-b * 6e-3)) AS g33 FROM protocol)"""


def _three(name: str, rows: str, by: str) -> str:
    """SQL of ``name``: each of ``rows`` (a, b, c: diagonal; g12, g13, g23; h1, h2, h3) with the non-negative weights w1, w2, w3 of least cost,
    how many of them are free, and the trace of the free ones' inverse; a row is told by the columns ``by``."""
    return f"""{name}w AS (SELECT *, h1 / a AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS w3, 1 AS free, 1 / a AS tr FROM {rows} UNION ALL SELECT *, 0, h2 / b, 0, 1, 1 / b FROM {rows} UNION ALL SELECT *, 0, 0, h3 / c, 1, 1 / c FROM {rows}
  UNION ALL SELECT *, (h1 * b - h2 * g12) / (a * b - g12 * g12), (h2 * a - h1 * g12) / (a * b - g12 * g12), 0, 2, (a + b) / (a * b - g12 * g12) FROM {rows}
  UNION ALL SELECT *, (h1 * c - h3 * g13) / (a * c - g13 * g13), 0, (h3 * a - h1 * g13) / (a * c - g13 * g13), 2, (a + c) / (a * c - g13 * g13) FROM {rows}
  UNION ALL SELECT *, 0, (h2 * c - h3 * g23) / (b * c - g23 * g23), (h3 * b - h2 * g23) / (b * c - g23 * g23), 2, (b + c) / (b * c - g23 * g23) FROM {rows}
  UNION ALL SELECT * EXCLUDE (det), (h1 * (b * c - g23 * g23) - g12 * (h2 * c - g23 * h3) + g13 * (h2 * g23 - b * h3)) / det, (a * (h2 * c - g23 * h3) - h1 * (g12 * c - g23 * g13) + g13 * (g12 * h3 - h2 * g13)) / det,
    (a * (b * h3 - h2 * g23) - g12 * (g12 * h3 - h2 * g13) + h1 * (g12 * g23 - b * g13)) / det, 3, (b * c - g23 * g23 + a * c - g13 * g13 + a * b - g12 * g12) / det
    FROM (SELECT *, a * (b * c - g23 * g23) - g12 * (g12 * c - g23 * g13) + g13 * (g12 * g23 - b * g13) AS det FROM {rows})),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY w1 * h1 + w2 * h2 + w3 * h3 DESC) AS k FROM {name}w WHERE least(w1, w2, w3) >= 0) WHERE k = 1)"""


#: Where a curve (l, lam, res) leaves the least residual by a twentieth: the last penalty before, and the crossing.
_CROSSING = """noise AS (SELECT 1.05::DOUBLE * min(res) AS lim FROM curve),
near AS (SELECT *, lead(res) OVER (ORDER BY l) AS next, lead(lam) OVER (ORDER BY l) AS next_lam, min((res <= lim)::INT) OVER (ORDER BY l) AS fine FROM curve CROSS JOIN noise),
one AS (SELECT coalesce(max(lam) FILTER (WHERE fine = 1), min(lam)) AS cap, min(exp(ln(lam) + (lim - res) / (next - res) * (ln(next_lam) - ln(lam)))) FILTER (WHERE res <= lim AND next > lim) AS meet, min(lam) AS low, max(lam) AS high, min(res) > any_value(lim) AS none FROM near)
SELECT l::INT AS step, round(lam, 9) AS lambda, round(res, 6) AS residual, round(cap, 9) AS cap, round(CASE WHEN meet IS NOT NULL THEN meet WHEN none THEN low ELSE high END, 6) AS crossing FROM curve CROSS JOIN one
"""
_CAP = f"""{_ISO_SAMPLE},
lams AS (SELECT l, 10.0::DOUBLE ** (-5 + 6 * l / 15.0::DOUBLE) AS lam FROM range(16) t(l)),
q AS (SELECT voxel_id, l, lam, yy, h1, h2, h3, g12, g13, g23, g11 + lam AS a, g22 + lam AS b, g33 + lam AS c FROM h CROSS JOIN g CROSS JOIN lams),
{_three("best", "q", "voxel_id, l")},
curve AS (SELECT l, any_value(lam) AS lam, avg(yy - (w1 * h1 + w2 * h2 + w3 * h3) - lam * (w1 * w1 + w2 * w2 + w3 * w3)) AS res FROM best GROUP BY l),
{_CROSSING}"""


def _crossing(curve: DataFrame, values: list[float]) -> DataFrame:
    """A curve with the last value before it leaves its least residual by a twentieth, and where it crosses that."""
    curve = stash(curve, "curve")
    limit = 1.05 * curve.agg(F.min("residual")).first()[0]
    both = calibration.cap(curve, limit).withColumnRenamed("lambda", "cap").crossJoin(F.broadcast(calibration.discrepancy(curve, limit, 0.0).withColumnRenamed("lambda", "crossing")))  # one row each
    step = F.array_position(F.array(*map(F.lit, values)), F.col("lambda")) - 1
    return curve.crossJoin(F.broadcast(both)).select(step.cast("int").alias("step"), F.round("lambda", 9).alias("lambda"), _r(F.col("residual")).alias("residual"), F.round("cap", 9).alias("cap"), _r(F.col("crossing")).alias("crossing"))


@_query(_CAP)
def iso_residual_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean residuals of a sample's non-negative isotropic fits by penalty, the last penalty before they exceed the least by a
    twentieth, and where they cross that."""
    dictionary = solvers.Dictionary(X.PROTOCOL, hemisphere(4), [(SMALL_AD, SMALL_RD)], list(_CAP_GRID), 1)
    sample = fitting._sample(spark, sf_dir)
    values = [float(v) for v in np.logspace(-5, 1, 16)]
    curve = calibration.iso_residual_curve(sample, dictionary, values)
    return _crossing(curve, values)


_FIBER_CAP = f"""{_ISO_SAMPLE},
four AS ({_spiral(4)}),
col AS (SELECT i, m, exp(-b * ({SMALL_RD} + ({SMALL_AD} - {SMALL_RD}) * (gx * ux + gy * uy + gz * uz) ** 2)) AS a FROM four CROSS JOIN protocol
  UNION ALL SELECT 4 + k, m, exp(-b * d) FROM protocol, (VALUES (0, {SMALL_GRID[0]}::DOUBLE), (1, {SMALL_GRID[1]}::DOUBLE)) t(k, d)),
gram AS (SELECT x.i, y.i AS j, sum(x.a * y.a) AS g FROM col x JOIN col y USING (m) GROUP BY ALL),
proj AS (SELECT voxel_id, i, sum(a * y) AS p FROM y JOIN col USING (m) GROUP BY ALL),
lams AS (SELECT l, 10.0::DOUBLE ** (-6 + 10 * l / 15.0::DOUBLE) AS lam FROM range(16) t(l)),
sets AS (SELECT s, i, s // (2 ** i)::INT % 2 AS has FROM range(64) t(s), range(6) r(i)),
{_inverses("inv", f"SELECT l AS v, x.s, x.i, list(CASE WHEN x.has = 1 AND y.has = 1 THEN g + CASE WHEN x.i <> y.i THEN 0 WHEN x.i < 4 THEN lam ELSE {SMALL_ISO} END WHEN x.i = y.i THEN 1 ELSE 0 END::DOUBLE ORDER BY y.i) AS r FROM lams CROSS JOIN sets x JOIN sets y USING (s) JOIN gram ON gram.i = x.i AND gram.j = y.i GROUP BY l, x.s, x.i")},
free AS (SELECT v AS l, inv.s, inv.i, proj.voxel_id, sum(x * has * p) AS w FROM inv JOIN sets ON sets.s = inv.s AND sets.i = inv.j JOIN proj ON proj.i = inv.j GROUP BY ALL),
sums AS (SELECT voxel_id, l, s, sum(w * p) AS gain, sum(w * w * CASE WHEN i < 4 THEN lam ELSE {SMALL_ISO} END) AS held FROM free JOIN proj USING (voxel_id, i) JOIN lams USING (l) GROUP BY voxel_id, l, s HAVING min(w) >= 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY voxel_id, l ORDER BY gain DESC, s) AS k FROM sums) WHERE k = 1),
curve AS (SELECT l, any_value(lam) AS lam, avg(yy - gain - held) AS res FROM best JOIN h USING (voxel_id) JOIN lams USING (l) GROUP BY l),
{_CROSSING}"""


@_query(_FIBER_CAP)
def fiber_residual_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean residuals of a sample's non-negative fits by fiber penalty over four directions and two isotropic diffusivities, the last penalty before
    they exceed the least by a twentieth, and where they cross that."""
    dictionary = solvers.Dictionary(X.PROTOCOL, hemisphere(4), [(SMALL_AD, SMALL_RD)], list(SMALL_GRID), 1)
    values = [float(v) for v in np.logspace(-6, 4, 16)]
    return _crossing(calibration.residual_curve(fitting._sample(spark, sf_dir), dictionary, SMALL_ISO, values), values)


_RISK = f"""{_ISO_SAMPLE},
lams AS (SELECT l, 10.0::DOUBLE ** (-3 + l / 3.0::DOUBLE) AS lam FROM range(7) t(l)),
spread AS (SELECT quantile_cont(std, 0.5) AS sigma FROM (SELECT stddev_samp(y) AS std FROM y WHERE b < 100 GROUP BY voxel_id)),
q AS (SELECT voxel_id, l, lam, yy, h1, h2, h3, g12, g13, g23, g11 + lam AS a, g22 + lam AS b, g33 + lam AS c FROM h CROSS JOIN g CROSS JOIN lams),
{_three("best", "q", "voxel_id, l")},
risks AS (SELECT l, any_value(lam) AS lam, avg(-64 * sigma ** 2 + yy - (w1 * h1 + w2 * h2 + w3 * h3) - lam * (w1 * w1 + w2 * w2 + w3 * w3) + 2 * sigma ** 2 * (free - lam * tr)) AS risk FROM best CROSS JOIN spread GROUP BY l),
one AS (SELECT min(risk) AS low, min_by(lam, risk) AS best, min(risk) FILTER (WHERE l = 3) AS own FROM risks)
SELECT l::INT AS step, round(lam, 9) AS lambda, round(risk, 8) AS risk, round(best, 9) AS best, own <= low * 1.15::DOUBLE AS agrees FROM risks CROSS JOIN one
"""


@_query(_RISK)
def iso_penalty_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated prediction risks of a sample's non-negative isotropic fits by penalty, their divergence taken from the free
    columns, and whether the middle penalty is near the least."""
    sample = fitting._sample(spark, sf_dir)
    sigma = signals.sample_sigma(sample.withColumn("s0", F.lit(1.0)), X.PROTOCOL).first()["sigma"] or 0.0
    values = [float(v) for v in np.logspace(-3, -1, 7)]
    risks = stash(calibration.sure_risks(sample, np.array(X.PROTOCOL.b), [(v, list(_CAP_GRID), v) for v in values], sigma, None), "risks")
    check = calibration.sure_check(risks, values[3]).select(F.round("best", 9).alias("best"), "agrees")
    step = F.array_position(F.array(*map(F.lit, values)), F.col("value")) - 1
    return risks.crossJoin(F.broadcast(check)).select(step.cast("int").alias("step"), F.round("value", 9).alias("lambda"), F.round("risk", 8).alias("risk"), "best", "agrees")  # one row


def _pairs(name: str, candidates: str) -> str:
    """SQL of ``name``: of the diffusivities (voxel_id, c, ad, rd) of one fiber the admissible ones of least residual, with the non-negative weights of
    the fiber and of two isotropic compartments."""
    return f"""{name}q AS (SELECT voxel_id, c, any_value(ad) AS ad, any_value(rd) AS rd, sum(x * x) AS a, sum(y1 * y1) AS b, sum(y2 * y2) AS c_, sum(x * y1) AS g12, sum(x * y2) AS g13, sum(y1 * y2) AS g23, sum(x * sn) AS h1, sum(y1 * sn) AS h2, sum(y2 * sn) AS h3, sum(sn * sn) AS yy
  FROM (SELECT q.voxel_id, q.c, q.ad, q.rd, exp(-b * (q.rd + (q.ad - q.rd) * c2)) AS x, exp(-b * {SMALL_GRID[0]}) AS y1, exp(-b * {SMALL_GRID[1]}) AS y2, sn FROM ({candidates}) q JOIN norm USING (voxel_id) WHERE q.ad >= q.rd * 1.1) GROUP BY voxel_id, c),
{name}s AS (SELECT voxel_id, c AS place, ad, rd, a, b, c_ AS c, g12, g13, g23, h1, h2, h3, yy FROM {name}q),
{_three(name + "b", name + "s", "voxel_id, place")},
{name} AS (SELECT * FROM (SELECT voxel_id, place, ad, rd, w1, w2, w3, yy - (w1 * h1 + w2 * h2 + w3 * h3) AS residual, row_number() OVER (PARTITION BY voxel_id ORDER BY yy - (w1 * h1 + w2 * h2 + w3 * h3), place) AS k_ FROM {name}b) WHERE k_ = 1)"""


_SINGLE = f""", voxels AS (SELECT DISTINCT voxel_id FROM norm WHERE in_mask),
{_pairs("coarse", "SELECT voxel_id, 12 * i + j AS c, 0.6e-3 + 2e-3 * i / 13 AS ad, 0.15e-3 + 0.95e-3 * j / 11 AS rd FROM voxels CROSS JOIN range(14) t(i) CROSS JOIN range(12) r(j)")},
{_pairs("fine", "SELECT voxel_id, 5 * i + j AS c, greatest(ad + (i - 2) * (2e-3 / 13) / 2, 0.2e-3) AS ad, greatest(rd + (j - 2) * (0.95e-3 / 11) / 2, 0.15e-3) AS rd FROM coarse CROSS JOIN range(5) t(i) CROSS JOIN range(5) r(j)")},
picked AS (SELECT *, row_number() OVER (PARTITION BY voxel_id ORDER BY residual, finer) AS k FROM (SELECT *, 0 AS finer FROM coarse UNION ALL SELECT *, 1 FROM fine))
SELECT voxel_id, round(1000 * ad, 6) AS fit_ad, round(1000 * rd, 6) AS fit_rd, round(residual, 6) AS fit_residual, round(w1 / (w1 + w2 + w3), 6) AS ff, round(w2 / (w1 + w2 + w3), 6) AS rf, round(w3 / (w1 + w2 + w3), 6) AS hf FROM picked WHERE k = 1
"""


@_query(_SINGLE)
def single_fiber_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensor of one fiber of known direction and fractions beside two isotropic diffusivities: the best of all pairs, then of those around it."""
    rows = fitting._rows(spark, sf_dir).select("voxel_id", "signal", "ux", "uy", "uz")
    out = solvers.single_fiber(rows, X.PROTOCOL, list(SMALL_GRID))
    w = [F.get("fit_w", F.lit(i)) for i in range(3)]
    shares = [_r(c / (w[0] + w[1] + w[2])).alias(n) for n, c in zip(("ff", "rf", "hf"), w)]
    return out.select("voxel_id", _r(F.col("fit_ad"), 1000).alias("fit_ad"), _r(F.col("fit_rd"), 1000).alias("fit_rd"), _r(F.col("fit_residual")).alias("fit_residual"), *shares)


def _turns(rounds: int) -> str:
    """SQL of p0, p1, ...: diffusivities of two fibers, one after the other by the weighted regression of what the other leaves."""
    out = ["p0 AS (SELECT voxel_id, 1.6e-3::DOUBLE AS a1, 0.4e-3::DOUBLE AS r1, 1.6e-3::DOUBLE AS a2, 0.4e-3::DOUBLE AS r2 FROM truth)"]
    for i in range(2 * rounds):
        own, other = (1, 2) if i % 2 == 0 else (2, 1)
        rest = f"iso + f{other} * exp(-b * (r{other} + (a{other} - r{other}) * k{other}))"
        out.append(f"""e{i} AS (SELECT voxel_id, sum(w * b * b) AS a, sum(w * b * b * k) AS d, sum(w * b * k * b * k) AS e, sum(w * b * y) AS p, sum(w * b * k * y) AS q
  FROM (SELECT voxel_id, b, k{own} AS k, s * s AS w, ln(greatest(0.01::DOUBLE, least(1.0::DOUBLE, (s - ({rest})) / (f{own} + 1e-12)))) AS y FROM crossed JOIN p{i} USING (voxel_id)) GROUP BY voxel_id),
c{i} AS (SELECT voxel_id, abs(a * e - d * d) >= 1e-20 AS good, greatest(0.15e-3, least(3e-3, -(p * e - q * d) / (a * e - d * d))) AS rd,
  greatest(0.05e-3, least(3.5e-3, -(p * e - q * d) / (a * e - d * d) - (q * a - p * d) / (a * e - d * d))) AS ad FROM e{i}),
p{i + 1} AS (SELECT voxel_id, CASE WHEN NOT good THEN a{own} WHEN ad < rd THEN (ad + rd) / 2 ELSE ad END AS a{own}, CASE WHEN NOT good THEN r{own} WHEN ad < rd THEN (ad + rd) / 2 ELSE rd END AS r{own}, a{other}, r{other} FROM c{i} JOIN p{i} USING (voxel_id))""")
    return ",\n".join(out)


_CROSSED = f""", between AS (SELECT t.voxel_id, m, b, ad_true, rd_true, 0.6::DOUBLE * ff AS f1, 0.4::DOUBLE * ff AS f2, (gx * t.ux + gy * t.uy + gz * t.uz) ** 2 AS k1, (gx * o.ux + gy * o.uy + gz * o.uz) ** 2 AS k2,
  rf * exp(-b * 0.15e-3) + hf * exp(-b * 1e-3) + wf * exp(-b * 3e-3) AS iso FROM truth t JOIN dirs o ON o.d = (t.dir_id + 10) % 20 CROSS JOIN protocol),
crossed AS (SELECT *, iso + f1 * exp(-b * (rd_true + (ad_true - rd_true) * k1)) + f2 * exp(-b * (rd_true + 1e-4 + (ad_true - rd_true - 1e-4) * k2)) + 0.002::DOUBLE * (((7919 * voxel_id + 104729 * m) % 1000) / 999.0::DOUBLE - 0.5::DOUBLE) AS s FROM between),
{_turns(3)}
SELECT voxel_id, round(1000 * any_value(a1), 6) AS ad1, round(1000 * any_value(r1), 6) AS rd1, round(1000 * any_value(a2), 6) AS ad2, round(1000 * any_value(r2), 6) AS rd2,
  round(sum((s - iso - f1 * exp(-b * (r1 + (a1 - r1) * k1)) - f2 * exp(-b * (r2 + (a2 - r2) * k2))) ** 2), 9) AS cost FROM crossed JOIN p6 USING (voxel_id) GROUP BY voxel_id
"""


@_query(_CROSSED)
def crossing_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffusivities of two crossing fibers after three rounds of one after the other, from which the joint steps start."""
    out = solvers.crossing_fibers(X.two_fibers(spark, sf_dir), X.PROTOCOL, rounds=0)
    return out.select("voxel_id", *[_r(F.col(n), 1000).alias(n) for n in ("ad1", "rd1", "ad2", "rd2")], F.round("cost0", 9).alias("cost"))

"""Registered queries of the diffusion engine, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.functions import columns as C
from voxelmill.operators import diffusivity, signals, weights
from voxelmill.operators.directions import Directions
from voxelmill.sources import fixtures as X

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):  # noqa: ANN202
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _BASE + sql
        return f

    return add


def _r(x, scale: float = 1.0):  # noqa: ANN001, ANN202
    return F.round(x * scale, 6)


_BASE = """
WITH dirs AS (
  SELECT i AS d, sqrt(1 - z * z) * cos(a) AS ux, sqrt(1 - z * z) * sin(a) AS uy, z AS uz
  FROM (SELECT i, 1 - (i + 0.5::DOUBLE) / 20 AS z, 2 * pi() * i / ((1 + sqrt(5)) / 2) AS a FROM range(20) t(i))),
protocol AS (
  SELECT i AS m, CASE WHEN i < 4 THEN 0.0::DOUBLE ELSE 1000.0::DOUBLE * (1 + (i - 4) // 20) END AS b,
         CASE WHEN i < 4 THEN 0.0 ELSE ux END AS gx, CASE WHEN i < 4 THEN 0.0 ELSE uy END AS gy, CASE WHEN i < 4 THEN 0.0 ELSE uz END AS gz
  FROM range(64) t(i) JOIN dirs ON d = greatest(i - 4, 0) % 20),
truth0 AS (
  SELECT p_partkey AS voxel_id, p_retailprice AS s0_true, p_brand AS scenario, p_size / 50.0::DOUBLE AS weight,
         0.20::DOUBLE + 0.01::DOUBLE * (37 * p_partkey % 61) AS ff0, 0.01::DOUBLE * (53 * p_partkey % 21) AS rf0,
         0.10::DOUBLE + 0.01::DOUBLE * (71 * p_partkey % 41) AS hf0, 0.01::DOUBLE * (89 * p_partkey % 11) AS wf0,
         1.2e-3 + 1e-5 * (29 * p_partkey % 81) AS ad_true, 0.2e-3 + 1e-5 * (43 * p_partkey % 41) AS rd_true,
         13 * p_partkey % 20 AS dir_id, p_partkey % 10 <> 0 AS in_mask FROM part),
truth AS (
  SELECT t.*, ff0 / (ff0 + rf0 + hf0 + wf0) AS ff, rf0 / (ff0 + rf0 + hf0 + wf0) AS rf, hf0 / (ff0 + rf0 + hf0 + wf0) AS hf,
         wf0 / (ff0 + rf0 + hf0 + wf0) AS wf, ux, uy, uz FROM truth0 t JOIN dirs ON d = dir_id),
sig AS (
  SELECT t.*, m, b, (gx * ux + gy * uy + gz * uz) * (gx * ux + gy * uy + gz * uz) AS c2,
         CASE WHEN voxel_id % 97 = 0 THEN 0.0::DOUBLE ELSE
           s0_true * (ff * exp(-b * (rd_true + (ad_true - rd_true) * (gx * ux + gy * uy + gz * uz) * (gx * ux + gy * uy + gz * uz)))
             + rf * exp(-b * 0.15e-3) + hf * exp(-b * 1e-3) + wf * exp(-b * 3e-3))
           + 0.02::DOUBLE * s0_true * (((7919 * voxel_id + 104729 * m) % 1000) / 999.0::DOUBLE - 0.5::DOUBLE) END AS s
  FROM truth t CROSS JOIN protocol),
vox AS (
  SELECT voxel_id, any_value(in_mask) AS in_mask, avg(s) AS mean_signal, avg(s) FILTER (WHERE b < 100) AS s0,
         avg(s) FILTER (WHERE b < 50) AS mean0, stddev_samp(s) FILTER (WHERE b < 50) AS std0, max(s) FILTER (WHERE m = 0) AS first FROM sig GROUP BY voxel_id),
norm AS (SELECT sig.*, s / s0 AS sn, s0 FROM sig JOIN vox USING (voxel_id) WHERE s0 >= 1e-6),
reg AS (
  SELECT voxel_id, sum(w * b * b) AS a, sum(w * b * b * c2) AS d, sum(w * b * c2 * b * c2) AS e, sum(w * b * y) AS p, sum(w * b * c2 * y) AS q
  FROM (SELECT voxel_id, b, c2, greatest(sn, 0.01) * greatest(sn, 0.01) AS w,
          ln(greatest(0.01::DOUBLE, least(1.0::DOUBLE, (greatest(sn, 0.01) - rf * exp(-b * 0.15e-3) - hf * exp(-b * 1e-3) - wf * exp(-b * 3e-3)) / (ff + 1e-12)))) AS y FROM norm)
  GROUP BY voxel_id),
clipped AS (
  SELECT voxel_id, CASE WHEN abs(a * e - d * d) >= 1e-20 THEN greatest(0.05e-3, least(3.5e-3, -(p * e - q * d) / (a * e - d * d) - (q * a - p * d) / (a * e - d * d))) END AS ad,
         CASE WHEN abs(a * e - d * d) >= 1e-20 THEN greatest(0.15e-3, least(3e-3, -(p * e - q * d) / (a * e - d * d))) END AS rd FROM reg),
fit AS (
  SELECT voxel_id, CASE WHEN ad < rd THEN (ad + rd) / 2 ELSE ad END AS ad, CASE WHEN ad < rd THEN (ad + rd) / 2 ELSE rd END AS rd FROM clipped),
qual AS (
  SELECT voxel_id, CASE WHEN sum(sn * sn) - sum(sn) * sum(sn) / 64 > 1e-14 THEN 1 - sum(r * r) / (sum(sn * sn) - sum(sn) * sum(sn) / 64) END AS r2, sqrt(avg(r * r)) AS rmse
  FROM (SELECT voxel_id, sn, sn - (CASE WHEN ff > 0.15 AND ad IS NOT NULL THEN ff * exp(-b * (rd + (ad - rd) * c2)) ELSE 0 END
          + rf * exp(-b * 0.15e-3) + hf * exp(-b * 1e-3) + wf * exp(-b * 3e-3)) AS r FROM norm JOIN fit USING (voxel_id)) GROUP BY voxel_id)
"""


def _fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffusivity.conditioned(signals.normalised(X.signals(spark, sf_dir), X.PROTOCOL), X.PROTOCOL)


@_query("SELECT voxel_id, round(1000 * ad, 6) AS ad, round(1000 * rd, 6) AS rd, round(CASE WHEN ad < 1e-10 OR rd < 1e-10 OR ad - rd < 1e-10 THEN 0 ELSE (ad - rd) / sqrt(ad * ad + 2 * rd * rd) END, 6) AS fa FROM fit")
def tensor_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axial and radial diffusivity and FA of every voxel, with known direction and fractions."""
    return _fitted(spark, sf_dir).select("voxel_id", _r(F.col("ad"), 1000).alias("ad"), _r(F.col("rd"), 1000).alias("rd"), _r(F.col("fa")).alias("fa"))


@_query("SELECT voxel_id, round(mean_signal, 6) AS mean_signal FROM vox WHERE mean_signal > (SELECT quantile_cont(mean_signal, 0.1) FROM vox WHERE mean_signal > 0)")
def default_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.default_mask(X.signals(spark, sf_dir)).select("voxel_id", _r(F.col("mean_signal")).alias("mean_signal"))


_NOISE = """, base AS (SELECT mean0 AS mean, CASE WHEN std0 = 0 THEN 1e-10 ELSE std0 END AS std FROM vox WHERE in_mask),
one AS (SELECT avg(mean / std) AS change, quantile_cont(mean / std, 0.5) AS ratio, quantile_cont(std, 0.5) AS spread FROM base),
c AS (SELECT i AS k, 1 / sqrt(2.0::DOUBLE / 3 + (-0.5::DOUBLE) ** i / 3) AS root FROM range(21) t(i)),
k AS (SELECT coalesce(min(x.k), 20) AS k FROM c x JOIN c y ON x.k = y.k + 1, one WHERE change * abs(x.root - y.root) < 0.01),
noise AS (SELECT ratio * root AS snr, spread / root AS sigma FROM one, c JOIN k USING (k))
"""


@_query(_NOISE + "SELECT round(snr, 6) AS snr, round(sigma, 6) AS sigma FROM noise")
def snr_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.temporal_noise(X.signals(spark, sf_dir), X.PROTOCOL).select(_r(F.col("snr")).alias("snr"), _r(F.col("sigma")).alias("sigma"))


@_query("SELECT round(quantile_cont(first, 0.5) FILTER (WHERE in_mask) / (avg(first) FILTER (WHERE NOT in_mask AND first > 0) / 1.253::DOUBLE), 6) AS snr, round(avg(first) FILTER (WHERE NOT in_mask AND first > 0) / 1.253::DOUBLE, 6) AS sigma FROM vox")
def snr_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.spatial_noise(X.signals(spark, sf_dir)).select(_r(F.col("snr")).alias("snr"), _r(F.col("sigma")).alias("sigma"))


@_query(_NOISE + "SELECT voxel_id, round(sum(CASE WHEN in_mask AND s * s > 2 * sigma * sigma THEN sqrt(s * s - 2 * sigma * sigma) ELSE 0 END), 6) AS corrected FROM sig, noise GROUP BY voxel_id")
def rician_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.signals(spark, sf_dir)
    return signals.corrected(rows, signals.temporal_noise(rows, X.PROTOCOL)).select("voxel_id", _r(C.total(F.col("signal"))).alias("corrected"))


@_query("SELECT voxel_id, round(any_value(s0), 6) AS s0, round(sum(sn), 6) AS total, round(min(sn), 6) AS least FROM norm GROUP BY voxel_id")
def s0_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.normalised(X.signals(spark, sf_dir), X.PROTOCOL).select("voxel_id", _r(F.col("s0")).alias("s0"), _r(C.total(F.col("signal"))).alias("total"), _r(F.array_min("signal")).alias("least"))


_SAMPLE = """, ok AS (SELECT voxel_id, s0 FROM vox WHERE in_mask AND s0 > (SELECT 0.05::DOUBLE * quantile_cont(s0, 0.5) FROM vox WHERE in_mask AND s0 > 0)),
cal AS (SELECT * FROM ok ORDER BY (voxel_id * 7919 + 104729) % 1000003, voxel_id LIMIT 500)
"""


@_query(_SAMPLE + "SELECT voxel_id, round(s0, 6) AS s0 FROM cal")
def calibration_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.sample(signals.eligible(X.signals(spark, sf_dir), X.PROTOCOL), 500).select("voxel_id", _r(F.col("s0")).alias("s0"))


@_query(_SAMPLE + "SELECT round(quantile_cont(std / s0, 0.5), 6) AS sigma FROM (SELECT voxel_id, s0, stddev_samp(s) AS std FROM sig JOIN cal USING (voxel_id) WHERE b < 100 GROUP BY ALL)")
def sample_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.sample(signals.eligible(X.signals(spark, sf_dir), X.PROTOCOL), 500)
    return signals.sample_sigma(rows, X.PROTOCOL).select(_r(F.col("sigma")).alias("sigma"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = {"ad1": F.col("ad"), "rd1": F.col("rd"), "u1x": F.col("ux"), "u1y": F.col("uy"), "u1z": F.col("uz")}
    return diffusivity.fit_quality(_fitted(spark, sf_dir).withColumns(one), X.PROTOCOL)


@_query("SELECT voxel_id, round(r2, 6) AS r2, round(rmse, 6) AS rmse FROM qual")
def fit_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).select("voxel_id", _r(F.col("r2")).alias("r2"), _r(F.col("rmse")).alias("rmse"))


@_query("""SELECT round(quantile_cont(r2, 0.5), 6) AS median_r2, round(avg(r2), 6) AS mean_r2, round(avg((r2 > 0.99)::INT), 6) AS over_99, round(avg((r2 > 0.95)::INT), 6) AS over_95,
  round(avg((r2 > 0.9)::INT), 6) AS over_90, round(avg((r2 < 0.9)::INT), 6) AS under_90, round(quantile_cont(rmse, 0.5), 6) AS median_rmse, round(avg(rmse), 6) AS mean_rmse, round(avg((rmse > 0.05)::INT), 6) AS rmse_over_05 FROM qual""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diffusivity.quality_report(_quality(spark, sf_dir))
    return out.select(*[_r(F.col(c)).alias(c) for c in out.columns])


# Voxels without a mean diffusivity, without a hindered part and without any isotropic part are among these.
_ISO = """, iso AS (SELECT voxel_id, 2e-5 * (voxel_id % 120) AS adc, CASE WHEN voxel_id % 7 = 0 THEN 0 ELSE rf END AS rf, CASE WHEN voxel_id % 11 = 0 OR voxel_id % 7 = 0 THEN 0 ELSE hf END AS hf,
  CASE WHEN voxel_id % 11 = 0 AND voxel_id % 2 = 0 OR voxel_id % 7 = 0 THEN 0 ELSE wf END AS wf FROM truth)"""


def _iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("voxel_id")
    none = {"rf": k % 7 == 0, "hf": (k % 11 == 0) | (k % 7 == 0), "wf": ((k % 11 == 0) & (k % 2 == 0)) | (k % 7 == 0)}
    rows = X.truth(spark, sf_dir).select("voxel_id", (2e-5 * (k % 120)).alias("adc"), *[F.when(c, F.lit(0.0)).otherwise(F.col(n)).alias(n) for n, c in none.items()])
    return rows.withColumn("nrf", F.col("hf") + F.col("wf"))


def _confidences(rows: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    fine = lambda x: F.round(x, 9)  # noqa: E731  (some values are decimals that end in 5 at the seventh place)
    d = F.col("d")
    return rows.select("voxel_id", fine(d * 1000).alias(names[0]), (fine(C.confidence(d, 0.1e-3, 0.3e-3, 0.5e-3)) + 0.0).alias(names[1]), (fine(C.confidence(d, 1.5e-3, 3e-3, 6e-3)) + 0.0).alias(names[2]))


_RAMPS = """round(CASE WHEN d < 0.1e-3 OR d > 0.5e-3 THEN 1 WHEN d < 0.3e-3 THEN 1 - (d - 0.1e-3) / 0.2e-3 WHEN d IS NOT NULL THEN 1 - (0.5e-3 - d) / 0.2e-3 END, 9) + 0.0 AS {},
  round(CASE WHEN d < 1.5e-3 OR d > 6e-3 THEN 1 WHEN d < 3e-3 THEN 1 - (d - 1.5e-3) / 1.5e-3 WHEN d IS NOT NULL THEN 1 - (6e-3 - d) / 3e-3 END, 9) + 0.0 AS {}"""


@_query(_ISO + "SELECT voxel_id, round(1000 * d, 9) AS d_hin, " + _RAMPS.format("conf_res_hin", "conf_hin_wat") + """
  FROM (SELECT voxel_id, CASE WHEN adc > 0 AND hf > 1e-6 AND rf + hf + wf > 1e-6 THEN greatest(0.3e-3, least(3e-3, (adc * (rf + hf + wf) - rf * 0.15e-3 - wf * 3.05e-3) / hf)) END AS d FROM iso)""")
def transition_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence at the compartments' limits; null where there is no hindered diffusivity to tell it from."""
    rows = _iso(spark, sf_dir).withColumn("d", C.recover_iso(F.col("rf"), F.col("hf"), F.col("wf"), F.col("adc")))
    return _confidences(rows, ("d_hin", "conf_res_hin", "conf_hin_wat"))


@_query(_ISO + "SELECT voxel_id, round(1000 * d, 9) AS d_nonrf, " + _RAMPS.format("conf_res", "conf_wat") + """
  FROM (SELECT voxel_id, CASE WHEN adc > 0 AND hf + wf > 1e-6 AND rf + hf + wf > 1e-6 THEN greatest(0.3e-3, least(3.5e-3, (adc * (rf + hf + wf) - rf * 0.15e-3) / (hf + wf))) END AS d FROM iso)""")
def transition_confidence_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where there are two isotropic compartments."""
    rows = _iso(spark, sf_dir).withColumn("d", C.recover_nonrestricted(F.col("rf"), F.col("nrf"), F.col("adc")))
    return _confidences(rows, ("d_nonrf", "conf_res", "conf_wat"))


_TWO = """, two AS (
  SELECT t.voxel_id, ff, rf, hf, wf, ad_true, rd_true, m, b, gx * u.ux + gy * u.uy + gz * u.uz AS c, gx * v.ux + gy * v.uy + gz * v.uz AS e, 1e-5 * (20 + voxel_id % 200) AS adc
  FROM truth t JOIN dirs u ON u.d = t.dir_id JOIN dirs v ON v.d = (t.dir_id + 10) % 20 CROSS JOIN protocol),
made AS (SELECT *, 0.6::DOUBLE * ff * exp(-b * (rd_true + (ad_true - rd_true) * c * c)) + 0.4::DOUBLE * ff * exp(-b * (rd_true + 1e-4 + (ad_true - rd_true - 1e-4) * e * e)) AS fibers,
    rf * exp(-b * 0.15e-3) + hf * exp(-b * 1e-3) + wf * exp(-b * 3e-3) + 0.002::DOUBLE * (((7919 * voxel_id + 104729 * m) % 1000) / 999.0::DOUBLE - 0.5::DOUBLE) AS rest,
    greatest(0.3e-3, least(3e-3, (adc * (rf + hf + wf) - rf * 0.15e-3 - wf * 3.05e-3) / hf)) AS d3, greatest(0.3e-3, least(3.5e-3, (adc * (rf + hf + wf) - rf * 0.15e-3) / (hf + wf))) AS d2 FROM two),
off AS (SELECT voxel_id, fibers + rest AS s, rest - rf * exp(-b * 0.15e-3) - hf * exp(-b * d3) - wf * exp(-b * 3.05e-3) + CASE WHEN ff > 0.15 THEN 0 ELSE fibers END AS r3,
    rest - rf * exp(-b * 0.15e-3) - (hf + wf) * exp(-b * d2) + CASE WHEN ff > 0.15 THEN 0 ELSE fibers END AS r2 FROM made),
spread AS (SELECT voxel_id, sum(r3 * r3) AS q3, sum(r2 * r2) AS q2, sum(s * s) - sum(s) * sum(s) / 64 AS v FROM off GROUP BY voxel_id)
SELECT voxel_id, round(1 - q3 / v, 6) AS r2, round(sqrt(q3 / 64), 6) AS rmse, round(1 - q2 / v, 6) AS r2_two, round(sqrt(q2 / 64), 6) AS rmse_two FROM spread
"""


@_query(_TWO)
def fit_quality_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit quality of voxels with two fibers, with three and with two isotropic compartments whose diffusivities follow
    from the mean one."""
    rows = X.two_fibers(spark, sf_dir).withColumns({f"{n}{k}": F.col(f"{n}_{k}_true") for n in ("ad", "rd") for k in (1, 2)})
    rows = rows.withColumns({"adc": 1e-5 * (20 + F.col("voxel_id") % 200), "nrf": F.col("hf") + F.col("wf")})
    out = diffusivity.fit_quality(rows, X.PROTOCOL, 2, adc="adc").withColumnsRenamed({"r2": "r2_three", "rmse": "rmse_three"})
    out = diffusivity.fit_quality(out, X.PROTOCOL, 2, three=False, adc="adc")
    return out.select("voxel_id", _r(F.col("r2_three")).alias("r2"), _r(F.col("rmse_three")).alias("rmse"), _r(F.col("r2")).alias("r2_two"), _r(F.col("rmse")).alias("rmse_two"))


@_query(""", pops AS (SELECT voxel_id, CASE WHEN voxel_id % 29 = 0 THEN 0 ELSE ff END AS ff, CASE WHEN voxel_id % 13 = 0 THEN NULL ELSE ad_true END AS ad1, CASE WHEN voxel_id % 13 = 0 THEN NULL ELSE rd_true END AS rd1,
    CASE WHEN voxel_id % 17 = 0 THEN 1.2 * ff ELSE 0.3 * ff END AS f2, CASE WHEN voxel_id % 7 = 0 THEN NULL ELSE ad_true END AS ad2, CASE WHEN voxel_id % 7 = 0 THEN NULL ELSE rd_true + 1e-4 END AS rd2,
    CASE WHEN voxel_id % 3 = 0 THEN 0.2 * ff END AS f3, CASE WHEN voxel_id % 3 = 0 THEN ad_true - 1e-4 END AS ad3, CASE WHEN voxel_id % 3 = 0 THEN rd_true END AS rd3 FROM truth),
parts AS (SELECT *, greatest(ff - f2 - coalesce(f3, 0), 0) AS f1 FROM pops),
mean AS (SELECT voxel_id, ff, CASE WHEN ff > 0 AND ad1 IS NOT NULL THEN (f1 * ad1 + f2 * coalesce(ad2, 0) + coalesce(f3 * ad3, 0)) / ff END AS ad, CASE WHEN ff > 0 AND ad1 IS NOT NULL THEN (f1 * rd1 + f2 * coalesce(rd2, 0) + coalesce(f3 * rd3, 0)) / ff END AS rd FROM parts)
SELECT voxel_id, round(ff, 6) AS agg_ff, round(ad * 1000, 6) AS agg_ad, round(rd * 1000, 6) AS agg_rd, round(sqrt(1.5) * sqrt((ad - (ad + 2 * rd) / 3) ** 2 + 2 * (rd - (ad + 2 * rd) / 3) ** 2) / sqrt(ad * ad + 2 * rd * rd), 6) AS agg_fa FROM mean""")
def fiber_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total fiber fraction, and diffusivities and FA over up to three populations, some without a tensor, a fraction or fibers."""
    k, ff, null = F.col("voxel_id"), F.col("ff"), F.lit(None).cast("double")
    rows = X.truth(spark, sf_dir).select(
        "voxel_id", F.when(k % 29 == 0, F.lit(0.0)).otherwise(ff).alias("ff"), *[F.when(k % 13 == 0, null).otherwise(F.col(f"{n}_true")).alias(f"{n}1") for n in ("ad", "rd")],
        F.when(k % 17 == 0, 1.2 * ff).otherwise(0.3 * ff).alias("f2"), F.when(k % 7 != 0, F.col("ad_true")).alias("ad2"), F.when(k % 7 != 0, F.col("rd_true") + 1e-4).alias("rd2"),
        F.when(k % 3 == 0, 0.2 * ff).alias("f3"), F.when(k % 3 == 0, F.col("ad_true") - 1e-4).alias("ad3"), F.when(k % 3 == 0, F.col("rd_true")).alias("rd3"),
    )
    out = diffusivity.fiber_maps(rows, 3)
    return out.select("voxel_id", _r(F.col("agg_ff")).alias("agg_ff"), _r(F.col("agg_ad"), 1000).alias("agg_ad"), _r(F.col("agg_rd"), 1000).alias("agg_rd"), _r(F.col("agg_fa")).alias("agg_fa"))


@_query(""", a AS (SELECT l_orderkey AS voxel_id, l_returnflag = 'R' AS aniso, 0.04::DOUBLE * l_discount AS adc, l_quantity::DOUBLE AS w FROM lineitem),
g AS (SELECT voxel_id, sum(w) AS tot, coalesce(sum(w) FILTER (WHERE aniso), 0) AS ff, coalesce(sum(w) FILTER (WHERE NOT aniso AND adc <= 0.3e-3), 0) AS rf,
  coalesce(sum(w) FILTER (WHERE NOT aniso AND adc > 0.3e-3 AND adc <= 3e-3), 0) AS hf, coalesce(sum(w) FILTER (WHERE NOT aniso AND adc > 3e-3), 0) AS wf,
  sum(w * adc) FILTER (WHERE NOT aniso) AS iso, sum(w * adc) FILTER (WHERE NOT aniso AND adc > 0.3e-3 AND adc <= 3e-3) AS hd FROM a GROUP BY voxel_id)
SELECT voxel_id, round(ff / tot, 6) AS fiber_fraction, round(rf / tot, 6) AS restricted_fraction, round(hf / tot, 6) AS hindered_fraction, round(wf / tot, 6) AS water_fraction,
  round(1000 * CASE WHEN hf > 1e-10 THEN hd / hf ELSE 1e-3 END, 6) AS hf_centroid, round(1000 * CASE WHEN rf + hf + wf > 0 THEN iso / (rf + hf + wf) ELSE 0 END, 6) AS mean_iso_adc FROM g""")
def compartment_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = weights.fractions(X.atoms(spark, sf_dir))
    shares = ("fiber_fraction", "restricted_fraction", "hindered_fraction", "water_fraction")
    return out.select("voxel_id", *[_r(F.col(c)).alias(c) for c in shares], *[_r(F.col(c), 1000).alias(c) for c in ("hf_centroid", "mean_iso_adc")])


@_query(""", a AS (SELECT l_orderkey AS voxel_id, 0.04::DOUBLE * l_discount AS adc, l_quantity::DOUBLE AS w, l_returnflag = 'R' AS aniso FROM lineitem),
g AS (SELECT voxel_id, sum(w) AS tot, coalesce(sum(w) FILTER (WHERE NOT aniso AND adc <= 0.3e-3), 0) AS rf, coalesce(sum(w) FILTER (WHERE NOT aniso AND adc > 0.3e-3), 0) AS nrf, coalesce(sum(w) FILTER (WHERE NOT aniso AND adc > 3e-3), 0) AS wf,
  sum(w * adc) FILTER (WHERE NOT aniso AND adc <= 0.3e-3) AS rd, sum(w * adc) FILTER (WHERE NOT aniso AND adc > 0.3e-3) AS nd, sum(w * adc) FILTER (WHERE NOT aniso AND adc > 3e-3) AS wd FROM a GROUP BY voxel_id)
SELECT voxel_id, round(rf / tot, 6) AS restricted_fraction, round(nrf / tot, 6) AS nonrestricted_fraction, round(1000 * CASE WHEN rf > 1e-10 THEN rd / rf ELSE 0.15e-3 END, 6) AS rf_centroid,
  round(1000 * CASE WHEN nrf > 1e-10 THEN nd / nrf ELSE 1.5e-3 END, 6) AS nrf_centroid, round(1000 * CASE WHEN wf > 1e-10 THEN wd / wf ELSE 3e-3 END, 6) AS wf_centroid FROM g""")
def compartment_fractions_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions and centroids with two isotropic compartments."""
    out = weights.fractions(X.atoms(spark, sf_dir))
    return out.select("voxel_id", *[_r(F.col(c)).alias(c) for c in ("restricted_fraction", "nonrestricted_fraction")], *[_r(F.col(c), 1000).alias(c) for c in ("rf_centroid", "nrf_centroid", "wf_centroid")])


_WEIGHTS = """, wd AS (
  SELECT i AS d, sqrt(1 - z * z) * cos(a) AS ux, sqrt(1 - z * z) * sin(a) AS uy, z AS uz
  FROM (SELECT i, 1 - (i + 0.5::DOUBLE) / 12 AS z, 2 * pi() * i / ((1 + sqrt(5)) / 2) AS a FROM range(12) t(i))),
graph AS (SELECT d, nb FROM (SELECT x.d, y.d AS nb, row_number() OVER (PARTITION BY x.d ORDER BY round(x.ux * y.ux + x.uy * y.uy + x.uz * y.uz, 12) DESC, y.d DESC) AS k FROM wd x, wd y WHERE x.d <> y.d) WHERE k <= 2),
tot AS (SELECT vec_id AS voxel_id, i AS d, greatest(embedding[i + 1]::DOUBLE, 0) + greatest(embedding[i + 13]::DOUBLE, 0) + greatest(embedding[i + 25]::DOUBLE, 0) + greatest(embedding[i + 37]::DOUBLE, 0) + greatest(embedding[i + 49]::DOUBLE, 0) AS w FROM embeddings, range(12) t(i)),
peak AS (SELECT * FROM tot t WHERE w > 0 AND NOT EXISTS (SELECT 1 FROM graph g JOIN tot n ON n.d = g.nb WHERE g.d = t.d AND n.voxel_id = t.voxel_id AND n.w > 0 AND (n.w > t.w OR (n.w = t.w AND n.d < t.d)))),
own AS (SELECT t.voxel_id, t.w, p.d AS peak, row_number() OVER (PARTITION BY t.voxel_id, t.d ORDER BY round(abs(a.ux * b.ux + a.uy * b.uy + a.uz * b.uz), 12) DESC, p.d) AS k
  FROM tot t JOIN peak p USING (voxel_id) JOIN wd a ON a.d = t.d JOIN wd b ON b.d = p.d WHERE t.w > 0),
basin AS (SELECT voxel_id, peak, sum(w) AS mass, sum(sum(w)) OVER (PARTITION BY voxel_id) AS total FROM own WHERE k = 1 GROUP BY voxel_id, peak)
"""


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.with_totals(X.weights(spark, sf_dir).select("voxel_id", "w"), 12, 5).select("voxel_id", "t")


def _masses(spark: SparkSession, sf_dir: str, most: int = 0) -> DataFrame:
    return weights.basins(_totals(spark, sf_dir), Directions(X.WEIGHT_DIRECTIONS, 2), most=most)


@_query(_WEIGHTS + "SELECT voxel_id, d::INT AS d, round(w, 6) AS w FROM tot")
def direction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir).select("voxel_id", F.posexplode("t").alias("d", "w")).select("voxel_id", "d", _r(F.col("w")).alias("w"))


@_query(_WEIGHTS + "SELECT voxel_id, d::INT AS d, round(w, 6) AS w FROM peak")
def direction_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.peaks(_masses(spark, sf_dir)).select("voxel_id", "d", _r(F.col("w")).alias("w"))


@_query(_WEIGHTS + "SELECT voxel_id, peak::INT AS peak, round(mass, 6) AS mass, row_number() OVER (PARTITION BY voxel_id ORDER BY mass DESC, peak)::INT AS place FROM basin")
def basin_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.peaks(_masses(spark, sf_dir)).select("voxel_id", F.col("d").alias("peak"), _r(F.col("mass")).alias("mass"), "place")


@_query(_WEIGHTS + "SELECT voxel_id, round(CASE WHEN max(total) >= 1e-10 THEN max(mass) / max(total) ELSE 0 END, 6) AS concentration FROM basin GROUP BY voxel_id")
def basin_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.concentration(_masses(spark, sf_dir)).select("voxel_id", _r(F.col("concentration")).alias("concentration"))


@_query(_WEIGHTS + """, x AS (SELECT *, row_number() OVER (PARTITION BY voxel_id ORDER BY mass DESC, peak) AS k, max(mass) OVER (PARTITION BY voxel_id) AS most FROM basin),
one AS (SELECT * FROM x WHERE k = 1 AND mass >= 0.35 * total),
two AS (SELECT voxel_id, min_by(x.peak, x.k) AS peak FROM x JOIN one o USING (voxel_id) JOIN wd a ON a.d = o.peak JOIN wd b ON b.d = x.peak
  WHERE x.k > 1 AND x.mass >= 0.05 * x.total AND x.mass >= 0.35 * x.most AND abs(a.ux * b.ux + a.uy * b.uy + a.uz * b.uz) <= cos(radians(35)) GROUP BY voxel_id)
SELECT voxel_id, one.peak::INT AS first_dir, coalesce(two.peak, -1)::INT AS second_dir FROM one LEFT JOIN two USING (voxel_id)""")
def dominant_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _masses(spark, sf_dir, most=2).filter("size(dirs) > 0")
    return out.select("voxel_id", F.get("dirs", F.lit(0)).alias("first_dir"), F.coalesce(F.get("dirs", F.lit(1)), F.lit(-1)).alias("second_dir"))


@_query(_WEIGHTS + """, x AS (SELECT *, row_number() OVER (PARTITION BY voxel_id ORDER BY mass DESC, peak) AS k, max(mass) OVER (PARTITION BY voxel_id) AS most FROM basin),
one AS (SELECT * FROM x WHERE k = 1 AND mass >= 0.35 * total),
two AS (SELECT DISTINCT voxel_id FROM x JOIN one o USING (voxel_id) JOIN wd a ON a.d = o.peak JOIN wd b ON b.d = x.peak
  WHERE x.k > 1 AND x.mass >= 0.05 * x.total AND x.mass >= 0.35 * x.most AND abs(a.ux * b.ux + a.uy * b.uy + a.uz * b.uz) <= cos(radians(35)))
SELECT count(*) AS voxels, (SELECT count(*) FROM one) AS fitted, (SELECT count(*) FROM two) AS several, round(100.0 * (SELECT count(*) FROM two) / (SELECT count(*) FROM one), 6) AS percent FROM embeddings""")
def population_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels, those with a fiber, and those with several."""
    rows = _masses(spark, sf_dir, most=2)
    fitted, several = F.count_if(F.size("dirs") > 0), F.count_if(F.size("dirs") > 1)
    return rows.agg(F.count("*").alias("voxels"), fitted.alias("fitted"), several.alias("several"), _r(100.0 * several / fitted).alias("percent"))


@_query("""SELECT scenario, round(0.4 * mae_ff + 0.6 * mae_rf + 0.3 * (mae_ad + mae_rd), 6) AS loss, round(mae_ad, 6) AS mae_ad, round(mae_rd, 6) AS mae_rd, round(weight, 6) AS weight FROM (
  SELECT scenario, avg(abs(ff - ff0)) AS mae_ff, avg(abs(rf - rf0)) AS mae_rf, avg(CASE WHEN ff > 0.15 THEN abs(ad - ad_true) / ad_true END) AS mae_ad,
    avg(CASE WHEN ff > 0.15 THEN abs(rd - rd_true) / rd_true END) AS mae_rd, avg(weight) AS weight FROM fit JOIN truth USING (voxel_id) GROUP BY scenario)""")
def scenario_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean errors and loss of each scenario against the truth."""
    k = F.col("voxel_id")
    rows = _fitted(spark, sf_dir).withColumns({"ff_est": 0.20 + 0.01 * (37 * k % 61), "rf_est": 0.01 * (53 * k % 21)})
    fiber = F.col("ff") > 0.15
    err = lambda n: F.avg(F.when(fiber, F.abs(F.col(n) - F.col(f"{n}_true")) / F.col(f"{n}_true")))
    rows = rows.groupBy("scenario").agg(F.avg(F.abs(F.col("ff") - F.col("ff_est"))).alias("mae_ff"), F.avg(F.abs(F.col("rf") - F.col("rf_est"))).alias("mae_rf"), err("ad").alias("mae_ad"), err("rd").alias("mae_rd"), F.avg("weight").alias("weight"))
    loss = 0.4 * F.col("mae_ff") + 0.6 * F.col("mae_rf") + 0.3 * (F.col("mae_ad") + F.col("mae_rd"))
    return rows.select("scenario", _r(loss).alias("loss"), _r(F.col("mae_ad")).alias("mae_ad"), _r(F.col("mae_rd")).alias("mae_rd"), _r(F.col("weight")).alias("weight"))


@_query("SELECT count(*) AS voxels, count(ad) AS fitted, round(100.0 * count(ad) / count(*), 6) AS percent FROM truth LEFT JOIN fit USING (voxel_id)")
def fit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.truth(spark, sf_dir).select(F.lit(1).alias("voxel"), F.lit(0).alias("fitted"))
    rows = rows.unionByName(_fitted(spark, sf_dir).select(F.lit(0).alias("voxel"), F.col("ad").isNotNull().cast("int").alias("fitted")))
    return rows.agg(F.sum("voxel").alias("voxels"), F.sum("fitted").alias("fitted"), _r(100.0 * F.sum("fitted") / F.sum("voxel")).alias("percent"))


@_query("""SELECT voxel_id, channel, round(value, 6) AS value FROM (UNPIVOT (SELECT voxel_id, ff AS fiber_fraction, rf AS restricted_fraction, hf AS hindered_fraction, wf AS water_fraction, ad * 1000 AS axial_diffusivity, rd * 1000 AS radial_diffusivity FROM truth JOIN fit USING (voxel_id))
  ON fiber_fraction, restricted_fraction, hindered_fraction, water_fraction, axial_diffusivity, radial_diffusivity INTO NAME channel VALUE value)""")
def output_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result columns as (voxel, channel, value), redundant ones left out."""
    names = {"ff": "fiber_fraction", "rf": "restricted_fraction", "hf": "hindered_fraction", "wf": "water_fraction"}
    rows = _fitted(spark, sf_dir).select("voxel_id", *[F.col(a).alias(b) for a, b in names.items()], (F.col("ad") * 1000).alias("axial_diffusivity"), (F.col("rd") * 1000).alias("radial_diffusivity"))
    long = rows.unpivot(["voxel_id"], rows.columns[1:], "channel", "value").filter("value is not null")
    return long.select("voxel_id", "channel", _r(F.col("value")).alias("value"))

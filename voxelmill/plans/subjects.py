"""Fits of tables of many subjects with protocols of their own, and scores and maps of stored fits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.functions import columns as C
from voxelmill.operators import calibration, diffusivity, dictionaries, signals
from voxelmill.operators import subjects as by_subject
from voxelmill.operators.intervals import corrected_by_table
from voxelmill.plans import fitting
from voxelmill.plans.fitting import Config
from voxelmill.plans.queries import _BASE, _quality, _r
from voxelmill.schema import Protocol, iso_grid
from voxelmill.sources import fixtures as X
from voxelmill.sources import protocols as P
from voxelmill.sources.maps import read_maps, replace_maps
from voxelmill.storage import new_path, stash

QUERIES: dict = {}
SQL: dict[str, str] = {}
SUBJECT = ("subject_id",)
KEYS = ("subject_id", "voxel_id", "x", "y", "z")


def _query(sql: str | None = None):  # noqa: ANN202
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _BASE + sql
        return f

    return add


def each_protocol(rows: DataFrame, protocols: DataFrame, most: int = P.MOST) -> list[tuple[Protocol, DataFrame]]:
    """Each different protocol of a table of them, with the rows of its subjects.

    Rows of a table in folders by subject are picked by folder.  A subject with rows and without a protocol ends the job with its id.
    """
    own, known = P.by_subject(protocols, most)
    lost = rows.select("subject_id").distinct().join(own, "subject_id", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"no protocol of subject {lost[0][0]}")
    return [(known[k], rows.join(own.filter(F.col("protocol_id") == k).select("subject_id"), "subject_id", "left_semi")) for k in sorted(known)]


def subject_noise(rows: DataFrame, protocols: DataFrame) -> DataFrame:
    """subject_id, snr, sigma of each subject, by its own protocol."""
    return reduce(DataFrame.unionByName, [fitting.noise_of(own, p, SUBJECT) for p, own in each_protocol(rows, protocols)])


def subject_penalties(rows: DataFrame, protocols: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """subject_id, step, lambda: both penalties of each subject, from a sample of its own."""
    out = []
    for protocol, own in each_protocol(rows, protocols):
        unit, sigma = fitting.unit_sample(own, protocol, config, by=SUBJECT)
        out.append(by_subject.two_pass_by(unit, config.dictionary(protocol), sigma, SUBJECT, config.method))
    return reduce(DataFrame.unionByName, out)


def fit_subjects(rows: DataFrame, protocols: DataFrame, config: Config = Config(), noise: DataFrame | None = None, penalties: DataFrame | None = None, gate: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:  # noqa: B008
    """``fit`` of each subject's voxels (subject_id, voxel_id, ...) with its own protocol, noise and, where tables by subject are given, penalties and
    gate.  There is a plan for each different protocol; a subject's columns that its protocol's fit lacks are null."""
    fits = [fitting.fit(own, p, config, noise, penalties, gate, keys=keys, by=SUBJECT) for p, own in each_protocol(rows, protocols)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), fits)


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both by subject and voxel.  Tables of voxels are merged, never broadcast: Spark takes signals to be far smaller than they are."""
    return a.hint("merge").join(b, ["subject_id", "voxel_id"])


def scored(fitted: DataFrame, rows: DataFrame, protocols: DataFrame, fibers: int = 2) -> DataFrame:
    """subject_id, voxel_id, r2, rmse of stored results of ``fit_subjects`` against the raw signals.

    Where both tables are bucketed alike by subject and voxel (``store``), the join needs no shuffle.
    """
    names = ["ff", "rf", "hf", "wf", "nrf", "mean_iso_adc", *[f"{n}{k}" for k in range(1, fibers + 1) for n in ("f", "ad", "rd")], *[f"u{k}{c}" for k in range(1, fibers + 1) for c in "xyz"]]
    joined = _merged(fitted.select("subject_id", "voxel_id", *names), rows.select("subject_id", "voxel_id", "signal"))
    out = []
    for protocol, own in each_protocol(joined, protocols):
        unit = signals.normalised(own, protocol)
        out.append(diffusivity.fit_quality(unit, protocol, fibers, three=protocol.isotropic_parts == 3, adc="mean_iso_adc").select("subject_id", "voxel_id", "r2", "rmse"))
    return reduce(DataFrame.unionByName, out)


def derived_maps(fitted: DataFrame, fibers: int = 2) -> DataFrame:
    """subject_id, voxel_id, aggregate fiber maps and transition confidences of stored results; those of two isotropic compartments (hf null)
    tell the confidence from the non-restricted diffusivity."""
    out = diffusivity.fiber_maps(fitted, fibers)
    adc = F.col("mean_iso_adc")
    d = F.when(F.col("hf").isNotNull(), C.recover_iso(F.col("rf"), F.col("hf"), F.col("wf"), adc)).otherwise(C.recover_nonrestricted(F.col("rf"), F.col("nrf"), adc))
    out = out.withColumns({"conf_res": C.confidence(d, 0.1e-3, 0.3e-3, 0.5e-3), "conf_wat": C.confidence(d, 1.5e-3, 3e-3, 6e-3)})
    return out.select("subject_id", "voxel_id", "agg_ff", "agg_ad", "agg_rd", "agg_fa", "conf_res", "conf_wat")


def store(rows: DataFrame, table: str, buckets: int = 64) -> DataFrame:
    """``rows`` as a table in buckets by subject and voxel, sorted; two of them with as many buckets join without a shuffle."""
    rows.write.mode("overwrite").bucketBy(buckets, "subject_id", "voxel_id").sortBy("subject_id", "voxel_id").saveAsTable(table)
    return rows.sparkSession.table(table)


def _subjects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The signals and protocols of ``subjects``; the signals are written once, as each protocol and step reads them."""
    rows, protocols = X.subjects(spark, sf_dir)
    return stash(rows, "signals"), protocols


_SUBJECTS = """, own AS (SELECT 'S' || (voxel_id % 4) AS subject_id, voxel_id // 4 AS voxel, voxel_id % 2 AS short, sig.in_mask, m, b, s FROM sig WHERE voxel_id % 2 = 0 OR m < 24),
base AS (SELECT subject_id, voxel, avg(s) FILTER (WHERE b < 100) AS s0, avg(s) FILTER (WHERE b < 50) AS mean, CASE WHEN stddev_samp(s) FILTER (WHERE b < 50) = 0 THEN 1e-10 ELSE stddev_samp(s) FILTER (WHERE b < 50) END AS std, any_value(in_mask) AS in_mask FROM own GROUP BY ALL)
"""
_BY = """, one AS (SELECT {0}, avg(mean / std) AS change, quantile_cont(mean / std, 0.5) AS ratio, quantile_cont(std, 0.5) AS spread FROM {1} GROUP BY {0}),
c AS (SELECT i AS k, 1 / sqrt(2.0::DOUBLE / 3 + (-0.5::DOUBLE) ** i / 3) AS root FROM range(21) t(i)),
steps AS (SELECT x.k, abs(x.root - y.root) AS far FROM c x JOIN c y ON x.k = y.k + 1),
k AS (SELECT {0}, coalesce(min(k), 20) AS k FROM one LEFT JOIN steps ON change * far < 0.01 GROUP BY {0}),
noise AS (SELECT {0}, ratio * root AS snr, spread / root AS sigma FROM one JOIN k USING ({0}) JOIN c USING (k))
"""


@_query(_SUBJECTS + _BY.format("subject_id", "(SELECT * FROM base WHERE in_mask)") + "SELECT subject_id, round(snr, 6) AS snr, round(sigma, 6) AS sigma FROM noise")
def noise_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise of four subjects with two protocols."""
    return subject_noise(*_subjects(spark, sf_dir)).select("subject_id", _r(F.col("snr")).alias("snr"), _r(F.col("sigma")).alias("sigma"))


@_query(_SUBJECTS + _BY.format("subject_id", "(SELECT * FROM base WHERE in_mask)") + """, clean AS (SELECT subject_id, voxel, m, b, CASE WHEN s * s > 2 * sigma * sigma THEN sqrt(s * s - 2 * sigma * sigma) ELSE 0 END AS s FROM own JOIN noise USING (subject_id) WHERE in_mask),
level AS (SELECT subject_id, voxel, avg(s) FILTER (WHERE b < 100) AS s0 FROM clean GROUP BY ALL)
SELECT subject_id, voxel AS voxel_id, round(s0, 6) AS s0, count(*)::INT AS n, round(sum(s / s0), 6) AS total FROM clean JOIN level USING (subject_id, voxel) WHERE s0 >= 1e-6 GROUP BY ALL""")
def normalised_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected and normalised signals of four subjects with two protocols."""
    rows, protocols = _subjects(spark, sf_dir)
    noise, out = stash(subject_noise(rows, protocols), "noise"), []
    for protocol, own in each_protocol(rows, protocols):
        unit = signals.normalised(signals.in_mask(signals.corrected(own, noise, SUBJECT)), protocol)
        out.append(unit.select("subject_id", "voxel_id", _r(F.col("s0")).alias("s0"), F.size("signal").alias("n"), _r(C.total(F.col("signal"))).alias("total")))
    return reduce(DataFrame.unionByName, out)


@_query(", named AS (SELECT voxel_id, scenario, mean0 AS mean, CASE WHEN std0 = 0 THEN 1e-10 ELSE std0 END AS std FROM vox JOIN (SELECT voxel_id, scenario FROM truth) USING (voxel_id) WHERE in_mask)" + _BY.format("scenario", "named") + "SELECT scenario, round(snr, 6) AS snr, round(sigma, 6) AS sigma FROM noise")
def noise_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise of the voxels of each brand."""
    out = signals.temporal_noise(X.signals(spark, sf_dir), X.PROTOCOL, ["scenario"])
    return out.select("scenario", _r(F.col("snr")).alias("snr"), _r(F.col("sigma")).alias("sigma"))


@_query(""", b AS (SELECT scenario, vox.in_mask, first FROM vox JOIN truth USING (voxel_id)),
g AS (SELECT scenario, quantile_cont(first, 0.5) FILTER (WHERE in_mask) AS middle, avg(first) FILTER (WHERE NOT in_mask AND first > 0) / 1.253::DOUBLE AS sigma FROM b GROUP BY scenario)
SELECT scenario, round(coalesce(middle / sigma, 20), 6) AS snr, round(coalesce(sigma, 1), 6) AS sigma FROM g""")
def spatial_noise_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise of each brand from its background."""
    out = signals.spatial_noise(X.signals(spark, sf_dir), ["scenario"])
    return out.select("scenario", _r(F.col("snr")).alias("snr"), _r(F.col("sigma")).alias("sigma"))


@_query(""", b AS (SELECT voxel_id, scenario, mean_signal FROM vox JOIN (SELECT voxel_id, scenario FROM truth) USING (voxel_id)),
cut AS (SELECT scenario, quantile_cont(mean_signal, 0.1) AS cut FROM b WHERE mean_signal > 0 GROUP BY scenario)
SELECT voxel_id, scenario, round(mean_signal, 6) AS mean_signal FROM b JOIN cut USING (scenario) WHERE mean_signal > cut""")
def default_mask_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels over the 10th percentile of their own brand."""
    return signals.default_mask(X.signals(spark, sf_dir), ["scenario"]).select("voxel_id", "scenario", _r(F.col("mean_signal")).alias("mean_signal"))


_SAMPLES = """, b AS (SELECT voxel_id, scenario, s0 FROM vox JOIN (SELECT voxel_id, scenario FROM truth) USING (voxel_id) WHERE in_mask),
cut AS (SELECT scenario, 0.05::DOUBLE * quantile_cont(s0, 0.5) AS cut FROM b WHERE s0 > 0 GROUP BY scenario),
cal AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY (voxel_id * 7919 + 104729) % 1000003, voxel_id) AS place FROM b JOIN cut USING (scenario) WHERE s0 > cut) WHERE place <= 20)
"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.sample(signals.eligible(X.signals(spark, sf_dir), X.PROTOCOL, ["scenario"]), 20, by=["scenario"])


@_query(_SAMPLES + "SELECT voxel_id, scenario, round(s0, 6) AS s0 FROM cal")
def calibration_sample_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty eligible voxels of each brand."""
    return _samples(spark, sf_dir).select("voxel_id", "scenario", _r(F.col("s0")).alias("s0"))


@_query(_SAMPLES + "SELECT scenario, round(quantile_cont(std / s0, 0.5), 6) AS sigma FROM (SELECT cal.scenario, voxel_id, cal.s0, stddev_samp(s) AS std FROM sig JOIN cal USING (voxel_id) WHERE b < 100 GROUP BY ALL) GROUP BY scenario")
def sample_sigma_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise of each brand's sample."""
    return signals.sample_sigma(_samples(spark, sf_dir), X.PROTOCOL, ["scenario"]).select("scenario", _r(F.col("sigma")).alias("sigma"))


@_query(""", q AS (SELECT scenario, r2, rmse FROM qual JOIN truth USING (voxel_id))
SELECT scenario, round(quantile_cont(r2, 0.5), 6) AS median_r2, round(avg(r2), 6) AS mean_r2, round(avg((r2 > 0.99)::INT), 6) AS over_99, round(avg((r2 > 0.95)::INT), 6) AS over_95,
  round(avg((r2 > 0.9)::INT), 6) AS over_90, round(avg((r2 < 0.9)::INT), 6) AS under_90, round(quantile_cont(rmse, 0.5), 6) AS median_rmse, round(avg(rmse), 6) AS mean_rmse, round(avg((rmse > 0.05)::INT), 6) AS rmse_over_05 FROM q GROUP BY scenario""")
def quality_report_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit quality of each brand's voxels."""
    out = diffusivity.quality_report(_quality(spark, sf_dir), ["scenario"])
    return out.select("scenario", *[_r(F.col(c)).alias(c) for c in out.columns[1:]])


@_query(fitting._ridge({10: iso_grid(10)}, "scenario") + "SELECT scenario, round(min_by(lam, gcv), 9) AS lambda, round(min(gcv), 9) AS score FROM scores GROUP BY scenario")
def iso_penalty_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotropic penalty of each brand by cross-validation over its moments."""
    dictionary, by = Config().dictionary(X.PROTOCOL), ["scenario"]
    curves = by_subject.curves_by(by_subject.moments_by(fitting._rows(spark, sf_dir), len(X.PROTOCOL.b), by), dictionary, by)
    return calibration.least(curves, by=by).select("scenario", *[F.round(c, 9).alias(c) for c in ("lambda", "score")])


@_query()
def penalties_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both penalties of four subjects with two protocols, from 40 voxels each, in two passes."""
    return subject_penalties(*_subjects(spark, sf_dir), Config(sample=40, method="discrepancy"))


@_query()
def fit_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result channels of four subjects with two protocols, by their own noise."""
    return fitting.results(fit_subjects(*_subjects(spark, sf_dir)), KEYS)


@_query()
def scores_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit quality, aggregate maps and confidences of the stored fits of four subjects."""
    rows, protocols = _subjects(spark, sf_dir)
    fitted = stash(fit_subjects(rows, protocols), "fits")
    return _merged(scored(fitted, rows, protocols), derived_maps(fitted))


_MEASURED = """, sizes AS (SELECT 'S' || n AS subject_id, m, b FROM (SELECT DISTINCT p_partkey % 4 AS n FROM part) CROSS JOIN protocol WHERE n % 2 = 0 OR m < 24),
shell AS (SELECT subject_id, round_even(b, -2) AS shell, count(*) AS measurements FROM sizes GROUP BY ALL),
top AS (SELECT subject_id, max(b) AS b_max FROM sizes GROUP BY ALL),
summary AS (SELECT subject_id, sum(measurements)::BIGINT AS measurements, any_value(b_max) AS b_max, count(*) FILTER (WHERE shell > 50) AS shells,
  CASE WHEN any_value(b_max) >= 2000 AND count(*) FILTER (WHERE shell > 50) >= 2 THEN 3 ELSE 2 END AS isotropic_parts, coalesce(floor(1.3 * max(measurements) FILTER (WHERE shell > 50)), 30)::INT AS directions,
  CASE WHEN count(*) FILTER (WHERE shell > 50) <= 1 OR any_value(b_max) < 1500 THEN 4 WHEN count(*) FILTER (WHERE shell > 50) <= 2 OR any_value(b_max) < 2500 THEN 6 ELSE 8 END AS steps,
  CASE WHEN count(*) FILTER (WHERE shell > 50) <= 1 OR any_value(b_max) < 1500 THEN 1.2 WHEN count(*) FILTER (WHERE shell > 50) <= 2 OR any_value(b_max) < 2500 THEN 1.15 ELSE 1.1 END::DOUBLE AS ratio
  FROM shell JOIN top USING (subject_id) GROUP BY subject_id)
"""


@_query(_MEASURED + "SELECT subject_id, shell, measurements FROM shell")
def shells_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of each b-value of each subject's protocol."""
    return dictionaries.protocol_shells(X.subjects(spark, sf_dir)[1])


@_query(_MEASURED + "SELECT * FROM summary")
def protocols_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compartments, directions and advised dictionary of each subject's protocol."""
    return dictionaries.protocol_summary(X.subjects(spark, sf_dir)[1])


@_query(_MEASURED + """, line AS (SELECT subject_id, ratio, x.i, y.i AS j, 0.5e-3 + 1.7e-3 * x.i / (steps - 1) AS ad, 0.05e-3 + 1.15e-3 * y.i / (steps - 1) AS rd FROM summary, range(8) x(i), range(8) y(i) WHERE x.i < steps AND y.i < steps)
SELECT subject_id, (row_number() OVER (PARTITION BY subject_id ORDER BY i, j) - 1)::INT AS p, round(1000 * ad, 6) AS ad, round(1000 * rd, 6) AS rd FROM line WHERE ad >= rd * ratio""")
def pairs_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admissible diffusivities of each subject, as advised for its protocol."""
    sizes = dictionaries.protocol_summary(X.subjects(spark, sf_dir)[1]).select("subject_id", "steps", "ratio")
    return dictionaries.pair_table(sizes).select("subject_id", "p", _r(F.col("ad"), 1000).alias("ad"), _r(F.col("rd"), 1000).alias("rd"))


@_query(""", sized AS (SELECT scenario AS key, 4 + count(*) % 28 AS n FROM truth GROUP BY scenario),
point AS (SELECT key, 1e-4 * 50.0::DOUBLE ** (i / (n - 1.0::DOUBLE)) AS adc FROM sized, range(32) t(i) WHERE i < n),
anchor AS (SELECT key, a AS adc FROM sized, (VALUES (0.3e-3::DOUBLE - 1e-6), (3e-3::DOUBLE + 1e-6)) t(a) WHERE NOT EXISTS (SELECT 1 FROM point p WHERE p.key = sized.key AND abs(p.adc - a) <= 1e-6)),
gap AS (SELECT key, adc, lead(adc) OVER (PARTITION BY key ORDER BY adc) AS next FROM (SELECT * FROM point UNION SELECT * FROM anchor)),
cut AS (SELECT key, adc, next, CASE WHEN next / adc > 2 THEN 2 ** greatest(ceil(log2(log2(next / adc)) - 1e-12), 0) ELSE 1 END AS parts FROM gap)
SELECT key, (row_number() OVER (PARTITION BY key ORDER BY adc * coalesce(next / adc, 1) ** (i / parts)) - 1)::INT AS k, round(1000 * adc * coalesce(next / adc, 1) ** (i / parts), 6) AS adc FROM cut, range(16) t(i) WHERE i < parts""")
def iso_grids_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The isotropic grid of each brand, of a size by its number of voxels."""
    sizes = X.truth(spark, sf_dir).groupBy(F.col("scenario").alias("key")).agg((4 + F.count("*") % 28).cast("int").alias("n"))
    return dictionaries.grid_table(sizes).select("key", "k", _r(F.col("adc"), 1000).alias("adc"))


_STORED = """, named AS (SELECT 'S' || (voxel_id % 4) AS subject_id, voxel_id // 4 AS voxel_id, ff, rf, hf, wf, ad * 1000 AS ad, rd * 1000 AS rd, r2, rmse FROM truth JOIN fit USING (voxel_id) JOIN qual USING (voxel_id))
SELECT subject_id, voxel_id, channel, round(value, 6) AS value FROM (UNPIVOT (SELECT subject_id, voxel_id, ff AS fiber_fraction, rf AS restricted_fraction, hf AS hindered_fraction, wf AS water_fraction, ad AS axial_diffusivity, rd AS radial_diffusivity, r2, rmse FROM named)
  ON fiber_fraction, restricted_fraction, hindered_fraction, water_fraction, axial_diffusivity, radial_diffusivity, r2, rmse INTO NAME channel VALUE value)"""


@_query(_STORED)
def stored_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result and quality maps of four subjects, written by subject and channel, one subject's again, and read back."""
    k = F.col("voxel_id")
    keys = {"subject_id": F.concat(F.lit("S"), (k % 4).cast("string")), "voxel_id": F.floor(k / 4)}
    names = {"ff": "fiber_fraction", "rf": "restricted_fraction", "hf": "hindered_fraction", "wf": "water_fraction", "r2": "r2", "rmse": "rmse"}
    scaled = [(F.col(n) * 1000).alias(x) for n, out in (("ad", ("axial_diffusivity", "ad_linear")), ("rd", ("radial_diffusivity", "rd_linear"))) for x in out]
    rows = stash(_quality(spark, sf_dir).select(*[c.alias(n) for n, c in keys.items()], *[F.col(a).alias(b) for a, b in names.items()], (F.col("hf") + F.col("wf")).alias("nonrestricted_fraction"), *scaled), "maps")
    path = new_path(spark, "stored-maps")
    replace_maps(rows.drop("r2", "rmse"), path)
    replace_maps(rows.select("subject_id", "voxel_id", "r2", "rmse"), path)
    replace_maps(rows.filter("subject_id = 'S1'").drop("r2", "rmse"), path)  # this subject's parts alone are replaced
    return read_maps(spark, path).select("subject_id", "voxel_id", "channel", _r(F.col("value")).alias("value"))


_TABLES = fitting._LABELLED + """, resp3 AS (SELECT voxel_id % 3 AS key, ff_level, rf_level, avg(ff_est) AS ff_est, avg(rf_est) AS rf_est FROM lab GROUP BY ALL),
m AS (SELECT key, ff_level, rf_level, max(rf_est) OVER (PARTITION BY key, ff_level ORDER BY rf_level) AS est, row_number() OVER (PARTITION BY key, ff_level ORDER BY rf_level) AS i, count(*) OVER (PARTITION BY key, ff_level) AS n FROM resp3),
lev AS (SELECT key, ff_level, avg(ff_est) AS mid, row_number() OVER (PARTITION BY key ORDER BY avg(ff_est)) AS j, count(*) OVER (PARTITION BY key) AS levels FROM resp3 GROUP BY key, ff_level),
k AS (SELECT voxel_id, rf, m.key, m.ff_level, n, count(*) FILTER (WHERE est <= rf) AS below FROM truth JOIN m ON m.key = voxel_id % 3 GROUP BY ALL),
inv AS (SELECT k.voxel_id, k.ff_level, CASE WHEN below = 0 OR below = k.n THEN lo.rf_level ELSE lo.rf_level + (k.rf - lo.est) / (hi.est - lo.est) * (hi.rf_level - lo.rf_level) END AS v
  FROM k JOIN m lo ON lo.key = k.key AND lo.ff_level = k.ff_level AND lo.i = greatest(below, 1) LEFT JOIN m hi ON hi.key = k.key AND hi.ff_level = k.ff_level AND hi.i = below + 1),
pick AS (SELECT voxel_id, voxel_id % 3 AS key, ff, rf, hf, (SELECT count(*) FROM lev WHERE mid <= ff AND lev.key = voxel_id % 3) AS nj FROM truth),
out AS (SELECT p.voxel_id, p.rf, p.hf, greatest(0.0::DOUBLE, least(1.0::DOUBLE, a.v + CASE WHEN l.j < h.j AND p.ff > l.mid THEN (p.ff - l.mid) / (h.mid - l.mid) ELSE 0 END * (b.v - a.v))) AS c
  FROM pick p JOIN lev l ON l.key = p.key AND l.j = greatest(nj, 1) JOIN lev h ON h.key = p.key AND h.j = least(nj + 1, h.levels) JOIN inv a ON a.voxel_id = p.voxel_id AND a.ff_level = l.ff_level JOIN inv b ON b.voxel_id = p.voxel_id AND b.ff_level = h.ff_level)
SELECT voxel_id, round(c, 6) AS rf_corrected, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, hf - (c - rf))), 6) AS hf_corrected FROM out
"""


@_query(_TABLES)
def restricted_correction_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restricted and hindered fractions after inverting the response table of the voxel's key, one of three, by interval joins."""
    key = (F.col("voxel_id") % 3).alias("key")
    response = X.labelled(spark, sf_dir).groupBy(key, "ff_level", "rf_level").agg(F.avg("ff_est").alias("ff_est"), F.avg("rf_est").alias("rf_est"))
    out = corrected_by_table(X.truth(spark, sf_dir).select("*", key), stash(response, "responses"), ["key"])
    return out.select("voxel_id", _r(F.col("rf_corrected")).alias("rf_corrected"), _r(F.col("hf_corrected")).alias("hf_corrected"))

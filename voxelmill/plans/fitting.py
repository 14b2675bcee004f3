"""Registered queries of the fits and calibrations, and the whole fit of a table of voxels."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill import schema as S
from voxelmill.functions import columns as C
from voxelmill.operators import calibration, diffusivity, signals, solvers, weights
from voxelmill.operators import subjects as keyed
from voxelmill.operators.quantiles import beside
from voxelmill.plans.queries import _BASE, _WEIGHTS, _fitted, _masses, _r
from voxelmill.schema import Protocol, hemisphere, iso_grid, pairs
from voxelmill.sources import fixtures as X
from voxelmill.storage import stash

QUERIES: dict = {}
SQL: dict[str, str] = {}
SAMPLE = 500


def _query(sql: str | None = None):  # noqa: ANN202
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _BASE + sql
        return f

    return add


@dataclass(frozen=True)
class Config:
    """Parameters of a fit.

    Penalties of None are 0.005 for isotropic atoms, and that times the number of fiber atoms for these; ``directions`` and
    ``compartments`` (isotropic, 2 or 3) of None follow the protocol.  The dictionary: ``ad``, ``rd`` (low, high, steps), ``ratio``, ``iso_steps``,
    ``iso_range``, ``grid`` (anchored or linear), ``neighbours`` of a direction.  Fibers: ``threshold`` of their fraction, ``gate``, ``least_weight``,
    ``peak_ratio``, ``separation`` (degrees), at most ``fibers``; ``spread`` and ``modulate`` of the second solution.  One fiber's tensor:
    ``joint`` with the fractions, or in closed form, then with the direction searched anew to ``resolution`` degrees if ``refine``.
    ``resolve``: fractions from the anchored fit at the end.  Calibration: ``sample`` voxels for the penalties, chosen by ``method``; the isotropic grid by
    ``grid_method`` (bootstrap of ``grid_voxels`` voxels with ``replicates`` each, sweep, or fixed); ``percentile`` of the gate.
    """

    directions: int | None = None
    ad: tuple[float, float, int] = (0.5e-3, 2.2e-3, 3)
    rd: tuple[float, float, int] = (0.05e-3, 1.2e-3, 3)
    ratio: float = 2.0
    iso_steps: int = 10
    iso_range: tuple[float, float] = (0.1e-3, 5.0e-3)
    grid: str = "anchored"
    neighbours: int | None = None
    fiber_penalty: float | None = None
    iso_penalty: float = 0.005
    threshold: float = S.FIBER_THRESHOLD
    gate: float = S.CONCENTRATION_GATE
    least_weight: float = S.LEAST_WEIGHT
    peak_ratio: float = S.PEAK_RATIO
    separation: float = S.SEPARATION_DEG
    fibers: int = 2
    compartments: int | None = None
    modulate: bool = True
    spread: tuple[float, float, float] = (solvers.SPREAD_LOW, solvers.SPREAD_HIGH, solvers.SPREAD_GAIN)
    joint: bool = True
    refine: bool = True
    resolution: float = 1.0
    resolve: bool = True
    method: str = "gcv"
    sample: int = 500
    grid_method: str = "bootstrap"
    grid_voxels: int = 60
    replicates: int = calibration.REPLICATES
    percentile: float = 0.9

    def __post_init__(self) -> None:
        if self.compartments not in (None, 2, 3):
            raise ValueError("2 or 3 isotropic compartments can be fitted")
        if not 1 <= self.fibers <= 3:
            raise ValueError("1 to 3 fibers can be fitted")
        if self.grid not in ("anchored", "linear"):
            raise ValueError(f"no such grid: {self.grid}")
        if self.method not in ("discrepancy", "gcv", "corner"):
            raise ValueError(f"no such method: {self.method}")
        if self.grid_method not in ("bootstrap", "sweep", "fixed"):
            raise ValueError(f"no such way to choose a grid: {self.grid_method}")
        if self.iso_steps < 2 or not 0 < self.resolution:
            raise ValueError("a grid has 2 steps or more, and a resolution is an angle")

    def dictionary(self, protocol: Protocol) -> solvers.Dictionary:
        lo, hi = self.iso_range
        grid = iso_grid(self.iso_steps, lo, hi) if self.grid == "anchored" else S.linear_grid(self.iso_steps, 0.0, hi)
        return solvers.Dictionary(protocol, hemisphere(self.directions or protocol.directions), pairs(self.ad, self.rd, self.ratio), grid, self.neighbours)

    def penalties(self, dictionary: solvers.Dictionary) -> tuple[float, float]:
        return self.iso_penalty * dictionary.fibers if self.fiber_penalty is None else self.fiber_penalty, self.iso_penalty


def _bands(weight, grid, offset: int) -> dict[str, Column]:  # noqa: ANN001
    """Sums of an array of weights over the isotropic bands of a grid; w is the weighted diffusivity."""
    at = lambda k: F.element_at(weight, offset + k + 1)
    bands = {"rf": [k for k, d in enumerate(grid) if d <= S.RES_MAX], "hf": [k for k, d in enumerate(grid) if S.RES_MAX < d <= S.WAT_MIN], "wf": [k for k, d in enumerate(grid) if d > S.WAT_MIN]}
    out = {n: sum((at(k) for k in ks), F.lit(0.0)) for n, ks in bands.items()}
    return out | {"adc": sum((at(k) * float(d) for k, d in enumerate(grid)), F.lit(0.0))}


def with_fractions(rows: DataFrame) -> DataFrame:
    """ff, rf, hf, wf and mean_iso_adc of spectra, and the mean diffusivity of each band (d_rf, d_hf, d_wf, d_nrf); voxels without
    weight are left out."""
    part = {n: F.get("parts", F.lit(i)) for i, n in enumerate(("ff", "rf", "hf", "wf", "m_rf", "m_hf", "m_wf"))}
    iso, moment = part["rf"] + part["hf"] + part["wf"], part["m_rf"] + part["m_hf"] + part["m_wf"]
    total = part["ff"] + iso
    bands = {n: (part[n], part[f"m_{n}"], d) for n, d in (("rf", S.D_RES), ("hf", S.D_HIN), ("wf", S.D_WAT))}
    bands["nrf"] = part["hf"] + part["wf"], part["m_hf"] + part["m_wf"], S.D_NONRES
    means = {f"d_{n}": F.when(w > 1e-10, m / w).otherwise(F.lit(d)) for n, (w, m, d) in bands.items()}
    adc = F.when(iso > 0, moment / iso).otherwise(F.lit(0.0))
    return rows.filter(total >= 1e-10).withColumns({**{n: part[n] / total for n in ("ff", "rf", "hf", "wf")}, "mean_iso_adc": adc, **means}).drop("parts")


def noise_of(rows: DataFrame, protocol: Protocol, by: Sequence[str] = ()) -> DataFrame:
    """A row a subject: snr, sigma from the repeats at b = 0, or from the background where there is one or none."""
    repeated = sum(b < S.B0_NOISE for b in protocol.b) >= 2
    return signals.temporal_noise(rows, protocol, by) if repeated else signals.spatial_noise(rows, by)


def _penalties(config: Config, dictionary: solvers.Dictionary, table: DataFrame | None) -> tuple[float, float]:
    if table is None:
        return config.penalties(dictionary)
    own = {r["step"]: r["lambda"] for r in table.filter("step in ('fiber', 'iso')").collect()}  # two numbers
    return own["fiber"], own["iso"]


def unit_sample(rows: DataFrame, protocol: Protocol, config: Config = Config(), noise: DataFrame | None = None, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """The calibration sample of each subject's corrected voxels (voxel_id, s0, signal over s0), and the noise of each sample (sigma)."""
    noise = noise_of(rows, protocol, by) if noise is None else noise
    both = signals.corrected(rows.filter("signal is not null").select(*by, "voxel_id", "in_mask", "signal"), noise, by)
    picked = stash(signals.sample(signals.eligible(both, protocol, by), config.sample, by=by), "sample")
    sigma = signals.sample_sigma(picked, protocol, by)
    return picked.withColumn("signal", F.transform("signal", lambda s: s / F.col("s0"))), sigma


def calibrated(rows: DataFrame, protocol: Protocol, config: Config = Config(), noise: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """step, lambda: penalties of ``fit`` from a sample of the corrected voxels, in two passes."""
    unit, sigma = unit_sample(rows, protocol, config, noise)
    return calibration.two_pass(unit, config.dictionary(protocol), sigma.first()["sigma"] or 0.0, config.method)


def calibrated_grid(sample: DataFrame, protocol: Protocol, sigma: float, voxels: int = 60, replicates: int = calibration.REPLICATES, sizes: tuple[int, ...] = calibration.SIZES) -> DataFrame:
    """best, flat, homogeneous, n_iso: steps of the isotropic grid from noisy replicates of so many voxels, by hash, of a normalised
    sample (voxel_id, signal)."""
    some = stash(signals.sample(sample.select("voxel_id", "signal"), voxels), "grid-sample")
    b, grids = np.array(protocol.b), {n: iso_grid(n) for n in sizes}
    best = calibration.grid_scores(sample.sparkSession, calibration.moments(some, len(b)), b, grids)
    penalties = {r["n_iso"]: r["lambda"] for r in best.collect()}  # a row a size
    return calibration.bootstrap_choice(calibration.bootstrap_scores(some, b, grids, penalties, sigma, replicates))


def references(labelled: DataFrame, protocol: Protocol, config: Config = Config(), penalties: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Gate and response table of ``fit`` from a table of labelled signals (voxel_id, ff_level, rf_level, signal) of any size: their
    spectra with the fit's own dictionary and penalties.  The gate is of those without a fiber."""
    dictionary = config.dictionary(protocol)
    unit = signals.normalised(labelled.select("voxel_id", "ff_level", "rf_level", "signal"), protocol)
    found = with_fractions(solvers.spectra(unit, dictionary, *_penalties(config, dictionary, penalties), again=False))
    found = stash(found.select("ff_level", "rf_level", "concentration", "ff", F.col("ff").alias("ff_est"), F.col("rf").alias("rf_est")), "references")
    gate = calibration.concentration_gate(found.filter("ff_level = 0"), config.percentile, default=config.gate)
    return gate, stash(calibration.restricted_response(found), "response")


def chosen_grid(unit: DataFrame, sigma: float, protocol: Protocol, config: Config) -> int:
    """Steps of the isotropic grid by the config's way, from a normalised sample."""
    if config.grid_method == "fixed":
        return config.iso_steps
    if config.grid_method == "bootstrap":
        return calibrated_grid(unit, protocol, sigma, config.grid_voxels, config.replicates).first()["n_iso"]
    b = np.array(protocol.b)
    scores = calibration.grid_scores(unit.sparkSession, calibration.moments(unit, len(b)), b, {n: iso_grid(n) for n in range(4, 36, 2)})
    return calibration.fewest(scores).first()["n_iso"] or config.iso_steps


def calibrated_fit(rows: DataFrame, protocol: Protocol, config: Config = Config(), labelled: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """``fit`` with grid and penalties of the rows' own sample, and gate and response of ``labelled`` signals where they are given."""
    noise = stash(noise_of(rows, protocol), "noise")
    unit, sigma = unit_sample(rows, protocol, config, noise)
    sigma = sigma.first()["sigma"] or 0.0
    config = replace(config, iso_steps=chosen_grid(unit, sigma, protocol, config))
    penalties = calibration.two_pass(unit, config.dictionary(protocol), sigma, config.method)
    gate, response = references(labelled, protocol, config, penalties) if labelled is not None else (None, None)
    return fit(rows, protocol, config, noise, penalties, gate, response)


def fit(rows: DataFrame, protocol: Protocol, config: Config = Config(), noise: DataFrame | None = None, penalties: DataFrame | None = None, gate: DataFrame | None = None, response: DataFrame | None = None, keys: Sequence[str] = ("voxel_id",), by: Sequence[str] = ()) -> DataFrame:  # noqa: B008
    """Fractions, fibers and diffusivities of voxels (``keys``, in_mask, signal).

    The signal loses its Rician bias, the spectrum is fitted over the whole dictionary, and fibers are
    looked for where they hold over the threshold of it (``searched``).  One fiber's tensor is fitted to the uncorrected signal,
    several together to the corrected one.  The joint fit of one fiber gives its fractions too; with ``resolve`` they come from the anchored fit
    at the end, of two fibers at most: with several their sum stays and the isotropic rest is shared out anew.  A lone fiber has
    all of the fiber fraction.  Voxels outside the mask, or without signal
    at b = 0, give no row.  The spectrum, each tensor and the anchored fit are Arrow passes over the rows'
    own partitions; only the noise is an aggregate, and a stream of rows will do where it is given.

    ``penalties`` (step, lambda; as of ``calibrated``) and ``gate`` (one row) stand for those of the config.
    With a ``response`` table rf is corrected at the end, and hf (or nrf) makes up for it; rf_raw is what it was.  Where the protocol
    (or the config) has two isotropic compartments, hf and wf are null and nrf is fitted; else nrf is their sum.

    The ``keys`` (voxel_id among them) are carried along.  Those in ``by`` tell subjects apart: then noise, penalties and gate are tables with a subject's
    rows each, which are joined to its voxels, and a subject that a table lacks has the config's penalties and gate.
    """
    keys, by = list(keys), list(by)
    if "voxel_id" not in keys or not set(by) <= set(keys):
        raise ValueError("keys must hold voxel_id and the columns that tell subjects apart")
    dictionary = config.dictionary(protocol)
    three = (config.compartments or protocol.isotropic_parts) == 3
    names, fixed = (("rf", "hf", "wf"), (S.D_RES, S.D_HIN, S.D_WAT)) if three else (("rf", "nrf"), (S.D_RES, S.D_NONRES))
    most = config.fibers
    noise = noise_of(rows, protocol, by) if noise is None else noise
    both = signals.corrected(rows.filter("signal is not null").select(*keys, "in_mask", "signal", F.col("signal").alias("raw")), noise, by)
    both = signals.normalised(signals.in_mask(both), protocol)
    both = both.withColumn("_raw0", C.s0(F.col("raw"), protocol))  # kept as a column, so that it isn't worked out for each measurement
    both = both.withColumn("raw", F.transform("raw", lambda s: s / F.col("_raw0")))
    if by:
        default = config.penalties(dictionary)
        fiber, iso, least = "_fiber", "_iso", "_gate"
        if penalties is not None:
            step = lambda n: F.max(F.when(F.col("step") == n, F.col("lambda")))
            both = beside(both, penalties.groupBy(*by).agg(step("fiber").alias(fiber), step("iso").alias(iso)), by)
        both = beside(both, gate.select(*by, F.col("gate").alias(least)), by) if gate is not None else both
        given = {n: F.coalesce(F.col(n), F.lit(float(x))) if n in both.columns else F.lit(float(x)) for n, x in ((fiber, default[0]), (iso, default[1]), (least, config.gate))}
        both = both.withColumns(given)
    else:
        fiber, iso = _penalties(config, dictionary, penalties)
        least = config.gate if gate is None else gate.first()["gate"]
    found = solvers.spectra(both, dictionary, fiber, iso, least, most, config.modulate, config.spread, (config.least_weight, config.peak_ratio, config.separation))
    found = with_fractions(found).drop("in_mask", "_raw0", "_fiber", "_iso", "_gate")
    if not three:
        found = found.withColumn("nrf", F.col("hf") + F.col("wf")).drop("hf", "wf")
    found = found.withColumn("searched", F.col("ff") > config.threshold)
    found = found.withColumn("n_fibers", F.when(F.col("searched"), F.size("dirs")).otherwise(F.lit(0)))
    u = dictionary.u
    for k in range(1, most + 1):
        has = F.col("n_fibers") >= k
        near = F.coalesce(F.get("dirs", F.lit(k - 1)), F.lit(0))  # a null index into a literal array gives no null
        found = found.withColumns({f"u{k}{c}": F.when(has, F.element_at(C.doubles(u[:, i]), near + 1)) for i, c in enumerate("xyz")})
        found = found.withColumn(f"f{k}", F.when(has, F.get("shares", F.lit(k - 1)) * F.col("ff")).otherwise(F.lit(0.0)))
    alone = F.col("n_fibers") == 1
    found = found.withColumns({f"u{c}": F.when(alone, F.col(f"u1{c}")) for c in "xyz"})
    grid = list(map(float, dictionary.grid))
    if config.joint:
        found = _own_fractions(solvers.single_fiber(found, protocol, grid, signal="raw"), grid, three)
    else:
        schedule = S.cone_schedule(S.spacing([tuple(x) for x in u]), math.radians(config.resolution)) if config.refine else []
        found = solvers.refined_directions(found, protocol, schedule, names, fixed).withColumnsRenamed({"ref_ad": "fit_ad", "ref_rd": "fit_rd"}).drop("ref_x", "ref_y", "ref_z", "ref_error0", "ref_error")
    found = found.drop("raw", "ux", "uy", "uz")
    if most > 1:
        b = C.doubles(protocol.b)
        iso_signal = F.transform(b, lambda x: sum((F.col(n) * F.exp(-x * F.col(f"d_{n}")) for n in names), F.lit(0.0)))
        found = solvers.crossing_fibers(found.withColumn("iso_signal", iso_signal), protocol, most).drop("iso_signal", "cost0", "cost")
    first = {n: F.when(alone, F.col(f"fit_{n}")).otherwise(F.col(f"{n}1") if most > 1 else F.lit(None).cast("double")) for n in ("ad", "rd")}
    out = found.withColumns({f"{n}1": x for n, x in first.items()})
    several = F.col("n_fibers") >= 2
    if config.resolve:
        anchors = min(2, most)
        out = solvers.anchored_fractions(out, protocol, anchors, fixed)
        w = [F.get("anchored", F.lit(i)) for i in range(anchors + len(fixed))]
        tot, rest = sum(w, F.lit(0.0)), sum(w[anchors:], F.lit(0.0))
        solved = {}
        for n, x in zip(names, w[anchors:]):
            kept = F.when(rest > 1e-10, x / rest * (1 - F.col("ff"))).otherwise(F.col(n))
            solved[n] = F.when(several, kept).otherwise(F.when(tot > 1e-10, x / tot).otherwise(F.col(n)))
        solved["ff"] = F.when(several | (tot <= 1e-10), F.col("ff")).otherwise(sum(w[:anchors], F.lit(0.0)) / tot)
        out = out.withColumns({f"_{n}": c for n, c in solved.items()})
        out = out.withColumns({n: F.col(f"_{n}") for n in solved})
    out = out.withColumns({"f1": F.when(alone, F.col("ff")).otherwise(F.col("f1")), "rf_raw": F.col("rf")})
    if response is not None:
        out = calibration.corrected_restricted(out.withColumn("hf", F.col(names[1])), response)
        out = out.withColumns({"rf": F.col("rf_corrected"), names[1]: F.col("hf_corrected")})
    out = out.withColumn("nrf", F.col("hf") + F.col("wf")) if three else out.withColumns({n: F.lit(None).cast("double") for n in ("hf", "wf")})
    each = range(1, most + 1)
    tensors = [c for k in each for c in (f"ad{k}", f"rd{k}", *(f"u{k}{c}" for c in "xyz"))]
    fa = [C.fa(F.col(f"ad{k}"), F.col(f"rd{k}")).alias(f"fa{k}") for k in each]
    return out.select(*keys, "s0", "n_fibers", "searched", "concentration", "ff", "rf", "hf", "wf", "nrf", "rf_raw", "mean_iso_adc", *[f"f{k}" for k in each], *tensors, *fa)


def _own_fractions(found: DataFrame, grid: list[float], three: bool) -> DataFrame:
    """Fractions and mean isotropic diffusivity of the joint fit of one fiber, where it has weight."""
    weight = lambda i: F.get("fit_w", F.lit(i))
    bands = _bands(F.col("fit_w"), grid, 1)
    moment, iso = bands.pop("adc"), sum(bands.values(), F.lit(0.0))
    total = weight(0) + iso
    if not three:
        bands = {"rf": bands["rf"], "nrf": bands["hf"] + bands["wf"]}
    new = {n: F.when(total > 1e-10, x / total).otherwise(F.col(n)) for n, x in ({"ff": weight(0)} | bands).items()}
    new["mean_iso_adc"] = F.when(total > 1e-10, F.when(iso > 1e-10, moment / iso).otherwise(F.lit(0.0))).otherwise(F.col("mean_iso_adc"))
    return found.withColumns({f"_{n}": x for n, x in new.items()}).withColumns({n: F.col(f"_{n}") for n in new}).drop("fit_w", "fit_residual", *[f"_{n}" for n in new])


def results(fitted: DataFrame, keys: tuple[str, ...] = ("voxel_id",), compartments: int = 3) -> DataFrame:
    """The result channels of ``fit``, by their names in order; null where a voxel has no such fiber."""
    null = F.lit(None).cast("double")
    own = lambda c: F.col(c) if c in fitted.columns else null
    named = {
        "fiber_fraction": own("ff"), "restricted_fraction": own("rf"), "hindered_fraction": own("hf"), "water_fraction": own("wf"), "nonrestricted_fraction": own("nrf"),
        "mean_iso_adc": own("mean_iso_adc"), "n_fiber_populations": F.when(F.col("searched"), F.col("n_fibers")), "dominant_basin_concentration": own("concentration"),
        "axial_diffusivity": own("ad1"), "radial_diffusivity": own("rd1"), "fiber_fa": own("fa1"), "ad_linear": own("ad1"), "rd_linear": own("rd1"),
    }
    for k in (1, 2, 3):
        named |= {f"dir{k}_{c}": own(f"u{k}{c}") for c in "xyz"}
        if k > 1:
            has = F.col("n_fibers") >= k
            named |= {f"fiber_fraction_pop{k}": F.when(has, own(f"f{k}")), f"axial_diffusivity_pop{k}": own(f"ad{k}"), f"radial_diffusivity_pop{k}": own(f"rd{k}"), f"fiber_fa_pop{k}": own(f"fa{k}")}
    return fitted.select(*keys, *[named[c].alias(c) for c in S.channels(compartments)])


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.normalised(signals.in_mask(X.signals(spark, sf_dir)), X.PROTOCOL)


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stash(signals.sample(signals.eligible(X.signals(spark, sf_dir), X.PROTOCOL), SAMPLE), "sample")
    return rows.withColumn("signal", F.transform("signal", lambda s: s / F.col("s0")))


def _rounded(rows: DataFrame, *same: str) -> DataFrame:
    return rows.select(*same, *[_r(F.col(c)).alias(c) for c in rows.columns if c not in same])


@_query()
def voxel_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result channels of every voxel, with grid and penalties of its own sample, and gate and response of labelled signals."""
    return results(calibrated_fit(X.signals(spark, sf_dir), X.PROTOCOL, Config(fibers=3), X.labelled_signals(spark, sf_dir)))


@_query()
def iso_grid_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the isotropic grid by noisy replicates of a sample."""
    sample = _sample(spark, sf_dir)
    sigma = signals.sample_sigma(sample.withColumn("s0", F.lit(1.0)), X.PROTOCOL).first()["sigma"] or 0.0
    return calibrated_grid(sample, X.PROTOCOL, sigma)


@_query()
def iso_penalty_sure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the isotropic penalty by cross-validation is near the least estimated risk of a sample."""
    sample = _sample(spark, sf_dir).select("voxel_id", "signal", "s0")
    sigma = signals.sample_sigma(sample.withColumn("s0", F.lit(1.0)), X.PROTOCOL).first()["sigma"] or 0.0
    dictionary = Config().dictionary(X.PROTOCOL)
    chosen = calibration.least(_iso_curve(sample, dictionary)).first()["lambda"]
    values = np.geomspace(chosen / 4, chosen * 4, 7)
    values[3] = chosen
    grid = list(map(float, dictionary.grid))
    return calibration.sure_check(calibration.sure_risks(sample, dictionary.b, [(float(v), grid, float(v)) for v in values], sigma), float(chosen))


@_query()
def iso_grid_sure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the isotropic grid of the fit is near the least estimated risk among its neighbours, each with its own penalty."""
    sample = _sample(spark, sf_dir).select("voxel_id", "signal", "s0")
    sigma = signals.sample_sigma(sample.withColumn("s0", F.lit(1.0)), X.PROTOCOL).first()["sigma"] or 0.0
    size, b = Config().iso_steps, np.array(X.PROTOCOL.b)
    grids = {n: iso_grid(n) for n in range(size - 2, size + 3)}
    best = calibration.grid_scores(spark, calibration.moments(sample, len(b)), b, grids)
    penalties = {r["n_iso"]: r["lambda"] for r in best.collect()}  # five rows
    return calibration.sure_check(calibration.sure_risks(sample, b, [(float(n), g, penalties[n]) for n, g in grids.items()], sigma), float(size))


@_query()
def refined_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direction and tensor of one fiber, searched in cones around the nearest direction of a dictionary of 62."""
    u = hemisphere(62)
    rows = _rows(spark, sf_dir).withColumnsRenamed({"ux": "true_x", "uy": "true_y", "uz": "true_z"})
    near = F.transform(F.array(*[F.array(*map(F.lit, d)) for d in u]), lambda d: F.abs(d[0] * F.col("true_x") + d[1] * F.col("true_y") + d[2] * F.col("true_z")))
    at = F.array_position(near, F.array_max(near)).cast("int")
    rows = rows.withColumn("at", at).withColumns({f"u{c}": F.element_at(C.doubles(d[i] for d in u), F.col("at")) for i, c in enumerate("xyz")})
    out = solvers.refined_directions(rows, X.PROTOCOL, S.cone_schedule(S.spacing(u), math.radians(1.0)))
    cos = lambda a: F.abs(sum((F.col(f"{a}{c}") * F.col(f"true_{c}") for c in "xyz"), F.lit(0.0)))
    return out.select("voxel_id", "ref_x", "ref_y", "ref_z", "ref_ad", "ref_rd", "ref_error0", "ref_error", cos("u").alias("cos_grid"), cos("ref_").alias("cos_refined"), "ad_true", "rd_true")


@_query()
def spectrum_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions, concentration and fiber directions of every voxel's spectrum."""
    config = Config()
    dictionary = config.dictionary(X.PROTOCOL)
    out = with_fractions(solvers.spectra(_rows(spark, sf_dir).select("voxel_id", "signal"), dictionary, *config.penalties(dictionary)))
    return out.select("voxel_id", "ff", "rf", "hf", "wf", "mean_iso_adc", "concentration", "dirs")


@_query()
def single_fiber_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensor and fractions of one fiber of known direction, fitted together."""
    grid = iso_grid(10)
    rows = _rows(spark, sf_dir).select("voxel_id", "signal", "ux", "uy", "uz", "ad_true", "rd_true", F.col("ff").alias("ff_true"))
    out = solvers.single_fiber(rows, X.PROTOCOL, grid)
    tot = C.total(F.col("fit_w"))
    parts = {"ff": F.get("fit_w", F.lit(0)), **{k: v for k, v in _bands(F.col("fit_w"), grid, 1).items() if k != "adc"}}
    return out.select("voxel_id", "fit_ad", "fit_rd", "fit_residual", "ff_true", "ad_true", "rd_true", *[(c / tot).alias(n) for n, c in parts.items()])


@_query()
def crossing_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffusivities of two crossing fibers of known directions and fractions."""
    out = solvers.crossing_fibers(X.two_fibers(spark, sf_dir), X.PROTOCOL)
    return out.select("voxel_id", "ad1", "rd1", "ad2", "rd2", "cost0", "cost", "ad_1_true", "rd_1_true", "ad_2_true", "rd_2_true")


_ANCHORED = """, a AS (SELECT voxel_id, sn, exp(-b * 0.15e-3) AS x, exp(-b * 1e-3) AS y, exp(-b * 3e-3) AS z FROM norm),
h AS (SELECT voxel_id, sum(x * x) AS xx, sum(x * y) AS xy, sum(x * z) AS xz, sum(y * y) AS yy, sum(y * z) AS yz, sum(z * z) AS zz, sum(x * sn) AS xs, sum(y * sn) AS ys, sum(z * sn) AS zs FROM a GROUP BY voxel_id),
c AS (
  SELECT voxel_id, xs, ys, zs, xs / xx AS r, 0.0::DOUBLE AS i, 0.0::DOUBLE AS w FROM h
  UNION ALL SELECT voxel_id, xs, ys, zs, 0, ys / yy, 0 FROM h
  UNION ALL SELECT voxel_id, xs, ys, zs, 0, 0, zs / zz FROM h
  UNION ALL SELECT voxel_id, xs, ys, zs, (xs * yy - ys * xy) / (xx * yy - xy * xy), (ys * xx - xs * xy) / (xx * yy - xy * xy), 0 FROM h
  UNION ALL SELECT voxel_id, xs, ys, zs, (xs * zz - zs * xz) / (xx * zz - xz * xz), 0, (zs * xx - xs * xz) / (xx * zz - xz * xz) FROM h
  UNION ALL SELECT voxel_id, xs, ys, zs, 0, (ys * zz - zs * yz) / (yy * zz - yz * yz), (zs * yy - ys * yz) / (yy * zz - yz * yz) FROM h
  UNION ALL SELECT voxel_id, xs, ys, zs,
    (xs * (yy * zz - yz * yz) - xy * (ys * zz - yz * zs) + xz * (ys * yz - yy * zs)) / det, (xx * (ys * zz - yz * zs) - xs * (xy * zz - yz * xz) + xz * (xy * zs - ys * xz)) / det,
    (xx * (yy * zs - ys * yz) - xy * (xy * zs - ys * xz) + xs * (xy * yz - yy * xz)) / det
    FROM (SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM h)),
best AS (SELECT *, row_number() OVER (PARTITION BY voxel_id ORDER BY r * xs + i * ys + w * zs DESC) AS place FROM c WHERE r >= 0 AND i >= 0 AND w >= 0)
SELECT voxel_id, round(r / (r + i + w), 6) AS rf, round(i / (r + i + w), 6) AS hf, round(w / (r + i + w), 6) AS wf FROM best WHERE place = 1
"""


@_query(_ANCHORED)
def anchored_iso_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions of voxels without a fiber at the three fixed diffusivities."""
    out = solvers.anchored_fractions(signals.normalised(X.signals(spark, sf_dir), X.PROTOCOL).select("voxel_id", "signal"), X.PROTOCOL, fibers=0)
    w = [F.get("anchored", F.lit(i)) for i in range(3)]
    return out.select("voxel_id", *[_r(c / (w[0] + w[1] + w[2])).alias(n) for n, c in zip(("rf", "hf", "wf"), w)])


_ANCHORED_TWO = """, short AS (SELECT voxel_id, b, s / avg(CASE WHEN b < 100 THEN s END) OVER (PARTITION BY voxel_id) AS sn FROM norm WHERE b <= 1000),
h AS (SELECT voxel_id, sum(exp(-b * 0.3e-3)) AS xx, sum(exp(-b * 1.65e-3)) AS xy, sum(exp(-b * 3e-3)) AS yy, sum(exp(-b * 0.15e-3) * sn) AS xs, sum(exp(-b * 1.5e-3) * sn) AS ys FROM short GROUP BY voxel_id),
c AS (SELECT voxel_id, xs, ys, xs / xx AS r, 0.0::DOUBLE AS i FROM h UNION ALL SELECT voxel_id, xs, ys, 0, ys / yy FROM h
  UNION ALL SELECT voxel_id, xs, ys, (xs * yy - ys * xy) / (xx * yy - xy * xy), (ys * xx - xs * xy) / (xx * yy - xy * xy) FROM h),
best AS (SELECT *, row_number() OVER (PARTITION BY voxel_id ORDER BY r * xs + i * ys DESC) AS place FROM c WHERE r >= 0 AND i >= 0)
SELECT voxel_id, round(r / (r + i), 6) AS rf, round(i / (r + i), 6) AS nrf FROM best WHERE place = 1
"""


@_query(_ANCHORED_TWO)
def anchored_two_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions of voxels without a fiber at the two fixed diffusivities of a protocol with one shell."""
    keep = [i for i, b in enumerate(X.PROTOCOL.b) if b <= 1000]
    protocol = Protocol(tuple(X.PROTOCOL.b[i] for i in keep), tuple(X.PROTOCOL.g[i] for i in keep))
    rows = signals.normalised(X.signals(spark, sf_dir, protocol), protocol).select("voxel_id", "signal")
    out = solvers.anchored_fractions(rows, protocol, fibers=0, iso=(S.D_RES, S.D_NONRES))
    w = [F.get("anchored", F.lit(i)) for i in range(2)]
    return out.select("voxel_id", *[_r(c / (w[0] + w[1])).alias(n) for n, c in zip(("rf", "nrf"), w)])


# Each set of the four columns is a system of its own, in which the others have the unit matrix's row and weight 0.
_ANCHORED_FIBER = """, a AS (SELECT voxel_id, ff, sn AS y, [CASE WHEN ad IS NULL THEN 0.0::DOUBLE ELSE exp(-b * (rd + (ad - rd) * c2)) END, exp(-b * 0.15e-3), exp(-b * 1e-3), exp(-b * 3e-3)] AS x FROM norm JOIN fit USING (voxel_id)),
h AS (SELECT voxel_id, any_value(ff) AS ff_true, sum(x[1] * y) AS y1, sum(x[2] * y) AS y2, sum(x[3] * y) AS y3, sum(x[4] * y) AS y4, sum(x[1] * x[1]) AS g11, sum(x[1] * x[2]) AS g12, sum(x[1] * x[3]) AS g13,
  sum(x[1] * x[4]) AS g14, sum(x[2] * x[2]) AS g22, sum(x[2] * x[3]) AS g23, sum(x[2] * x[4]) AS g24, sum(x[3] * x[3]) AS g33, sum(x[3] * x[4]) AS g34, sum(x[4] * x[4]) AS g44 FROM a GROUP BY voxel_id),
o AS (SELECT i, i % 2 AS p, i // 2 % 2 AS q, i // 4 % 2 AS r, i // 8 AS s FROM range(1, 16) t(i)),
m AS (SELECT voxel_id, ff_true, i, p * y1 AS y1, q * y2 AS y2, r * y3 AS y3, s * y4 AS y4, p * g11 + (1 - p) AS d1, p * q * g12 AS g12, p * r * g13 AS g13, p * s * g14 AS g14,
  q * g22 + 1 - q AS g22, q * r * g23 AS g23, q * s * g24 AS g24, r * g33 + 1 - r AS g33, r * s * g34 AS g34, s * g44 + 1 - s AS g44 FROM h CROSS JOIN o WHERE p = 0 OR g11 > 0),
m1 AS (SELECT *, g12 / d1 AS l2, g13 / d1 AS l3, g14 / d1 AS l4 FROM m),
m2 AS (SELECT *, g22 - l2 * g12 AS d2, g23 - l2 * g13 AS e3, g24 - l2 * g14 AS e4, y2 - l2 * y1 AS z2 FROM m1),
m3 AS (SELECT *, e3 / d2 AS k3, e4 / d2 AS k4 FROM m2),
m4 AS (SELECT *, g33 - l3 * g13 - k3 * e3 AS d3, g34 - l3 * g14 - k3 * e4 AS c4, y3 - l3 * y1 - k3 * z2 AS z3 FROM m3),
m5 AS (SELECT *, g44 - l4 * g14 - k4 * e4 - c4 / d3 * c4 AS d4, y4 - l4 * y1 - k4 * z2 - c4 / d3 * z3 AS z4 FROM m4),
w4 AS (SELECT *, z4 / d4 AS w4 FROM m5),
w3 AS (SELECT *, z3 / d3 - c4 / d3 * w4 AS w3 FROM w4),
w2 AS (SELECT *, z2 / d2 - k3 * w3 - k4 * w4 AS w2 FROM w3),
w1 AS (SELECT *, y1 / d1 - l2 * w2 - l3 * w3 - l4 * w4 AS w1 FROM w2),
best AS (SELECT *, w1 + w2 + w3 + w4 AS tot, row_number() OVER (PARTITION BY voxel_id ORDER BY w1 * y1 + w2 * y2 + w3 * y3 + w4 * y4 DESC, i) AS place FROM w1 WHERE least(w1, w2, w3, w4) >= 0)
SELECT voxel_id, round(ff_true, 6) AS ff_true, round(w1 / tot, 6) AS ff, round(w2 / tot, 6) AS rf, round(w3 / tot, 6) AS hf, round(w4 / tot, 6) AS wf FROM best WHERE place = 1
"""


@_query()
def anchored_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions with the fiber's fitted tensor and known direction."""
    rows = _fitted(spark, sf_dir).select("voxel_id", "signal", F.col("ad").alias("ad1"), F.col("rd").alias("rd1"), F.col("ux").alias("u1x"), F.col("uy").alias("u1y"), F.col("uz").alias("u1z"), F.col("ff").alias("ff_true"))
    out = solvers.anchored_fractions(rows, X.PROTOCOL, fibers=1)
    tot = C.total(F.col("anchored"))
    return out.select("voxel_id", "ff_true", *[(F.get("anchored", F.lit(i)) / tot).alias(n) for i, n in enumerate(("ff", "rf", "hf", "wf"))])


@_query(_ANCHORED_FIBER)
def anchored_fiber_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same to six places."""
    return _rounded(anchored_fractions(spark, sf_dir), "voxel_id")


def _ridge(grids: dict[int, list[float]], by: str = "") -> str:
    """SQL of scores(n, lam, gcv): cross-validation of each grid and penalty from sums over all voxels, or those of each key, with inverses by
    elimination."""
    key, same = (f", {by}", f" AND mom.{by} = sums.{by}") if by else ("", "")
    own = ", ".join(f"({n}, {list(map(float, g))}::DOUBLE[])" for n, g in grids.items())
    return f""", grids AS (SELECT * FROM (VALUES {own}) t(n, ds)),
atom AS (SELECT n, i, ds[i + 1] AS d, len(ds) AS size FROM grids, range({max(map(len, grids.values()))}) t(i) WHERE i < len(ds)),
gram AS (SELECT x.n, x.i, y.i AS j, sum(exp(-b * (x.d + y.d))) AS g FROM atom x JOIN atom y ON x.n = y.n CROSS JOIN protocol GROUP BY ALL),
mom AS (SELECT p.m, q.m AS o{key and ", p." + by}, avg(p.sn * q.sn) AS v FROM (SELECT voxel_id, m, sn{key} FROM norm WHERE in_mask) p JOIN (SELECT voxel_id, m, sn FROM norm WHERE in_mask) q USING (voxel_id) GROUP BY ALL),
half AS (SELECT n, i, o{key}, sum(exp(-b * d) * v) AS v FROM atom CROSS JOIN mom JOIN protocol USING (m) GROUP BY ALL),
proj AS (SELECT half.n, half.i, y.i AS j{key}, sum(v * exp(-b * y.d)) AS h FROM half JOIN protocol p ON p.m = half.o JOIN atom y ON y.n = half.n GROUP BY ALL),
lams AS (SELECT l, 10.0::DOUBLE ** (-5 + 6 * l / 39.0::DOUBLE) AS lam FROM range(40) t(l)),
inverse AS (WITH RECURSIVE e AS (
    SELECT 0 AS k, n, l, i, size, list_concat(list(g + CASE WHEN i = j THEN lam ELSE 0 END ORDER BY j), list(CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END ORDER BY j)) AS r FROM gram JOIN atom USING (n, i) CROSS JOIN lams GROUP BY n, l, i, size
    UNION ALL SELECT k + 1, n, l, i, size, CASE WHEN i = k THEN [x / r[k + 1] for x in r] ELSE [r[c] - r[k + 1] / p[k + 1] * p[c] for c in range(1, 2 * size + 1)] END
      FROM (SELECT *, max(r) FILTER (WHERE i = k) OVER (PARTITION BY n, l) AS p FROM e WHERE k < size))
  SELECT n, l, i, j, r[size + j + 1] AS v, size FROM e, range({max(map(len, grids.values()))}) t(j) WHERE k = size AND j < size),
twice AS (SELECT x.n, x.l, x.i, y.j, sum(x.v * y.v) AS v FROM inverse x JOIN inverse y ON x.n = y.n AND x.l = y.l AND x.j = y.i GROUP BY ALL),
sums AS (SELECT n, l{key}, any_value(size) AS size, sum(CASE WHEN i = j THEN a.v ELSE 0 END) AS tr, sum(a.v * h) AS once, sum(c.v * h) AS two FROM inverse a JOIN twice c USING (n, l, i, j) JOIN proj USING (n, i, j) GROUP BY n, l{key}),
scores AS (SELECT n, lam{key}, greatest((SELECT sum(v) FROM mom WHERE m = o{same}) - once - lam * two, 0) / 64 / greatest((1 - (size - lam * tr) / 64) ** 2, 1e-12) AS gcv FROM sums JOIN lams USING (l))
"""


def _iso_curve(rows: DataFrame, dictionary: solvers.Dictionary) -> DataFrame:
    return stash(keyed.curves_by(keyed.moments_by(rows, len(dictionary.b), []), dictionary, []), "curve")


def _fiber_curve(rows: DataFrame, dictionary: solvers.Dictionary, iso: float) -> DataFrame:
    return stash(keyed.curves_by(keyed.moments_by(rows, len(dictionary.b), []).withColumn("iso", F.lit(float(iso))), dictionary, [], "iso"), "curve")


@_query(_ridge({10: iso_grid(10)}) + "SELECT round(min_by(lam, gcv), 9) AS lambda, round(min(gcv), 9) AS score FROM scores")
def iso_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotropic penalty by generalised cross-validation over the moments of all voxels."""
    found = calibration.least(_iso_curve(_rows(spark, sf_dir), Config().dictionary(X.PROTOCOL)))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


def _fiber_scores(config: Config) -> str:
    """SQL of curve(l, lam, rss, eta2, gcv) over fiber penalties: by the inverse of the measurements' matrix, not of the atoms'."""
    d = config.dictionary(X.PROTOCOL)
    shapes = ", ".join(f"({ad!r}, {rd!r})" for ad, rd in (map(float, p) for p in d.pairs))
    return f""", fd AS (SELECT sqrt(1 - z * z) * cos(a) AS ux, sqrt(1 - z * z) * sin(a) AS uy, z AS uz
  FROM (SELECT 1 - (i + 0.5::DOUBLE) / {len(d.u)} AS z, 2 * pi() * i / ((1 + sqrt(5)) / 2) AS a FROM range({len(d.u)}) t(i))),
shape AS (SELECT ad::DOUBLE AS ad, rd::DOUBLE AS rd FROM (VALUES {shapes}) t(ad, rd)),
fib AS (SELECT row_number() OVER () AS i, ux, uy, uz, ad, rd FROM fd CROSS JOIN shape),
col AS (SELECT i, m, exp(-b * (rd + (ad - rd) * (gx * ux + gy * uy + gz * uz) ** 2)) AS a FROM fib CROSS JOIN protocol),
fk AS (SELECT x.m, y.m AS o, sum(x.a * y.a) AS f FROM col x JOIN col y USING (i) GROUP BY ALL),
ik AS (SELECT p.m, q.m AS o, sum(exp(-(p.b + q.b) * d)) AS g FROM protocol p CROSS JOIN protocol q CROSS JOIN (SELECT unnest({list(map(float, d.grid))}::DOUBLE[]) AS d) GROUP BY ALL),
lams AS (SELECT l, 10.0::DOUBLE ** (-4 + 8 * l / 39.0::DOUBLE) AS lam FROM range(40) t(l)),
inverse AS (WITH RECURSIVE e AS (
    SELECT 0 AS k, l, m, list_concat(list(f / lam + g / {config.iso_penalty!r} + CASE WHEN m = o THEN 1 ELSE 0 END ORDER BY o), list(CASE WHEN m = o THEN 1.0::DOUBLE ELSE 0 END ORDER BY o)) AS r FROM fk JOIN ik USING (m, o) CROSS JOIN lams GROUP BY l, m
    UNION ALL SELECT k + 1, l, m, CASE WHEN m = k THEN [x / r[k + 1] for x in r] ELSE [r[c] - r[k + 1] / p[k + 1] * p[c] for c in range(1, 129)] END
      FROM (SELECT *, max(r) FILTER (WHERE m = k) OVER (PARTITION BY l) AS p FROM e WHERE k < 64))
  SELECT l, m, o, r[65 + o] AS v FROM e, range(64) t(o) WHERE k = 64),
mom AS (SELECT p.m, q.m AS o, avg(p.sn * q.sn) AS v FROM (SELECT voxel_id, m, sn FROM norm WHERE in_mask) p JOIN (SELECT voxel_id, m, sn FROM norm WHERE in_mask) q USING (voxel_id) GROUP BY ALL),
pm AS (SELECT l, x.m, y.o, sum(x.v * y.v) AS v FROM inverse x JOIN mom y ON x.o = y.m GROUP BY ALL),
off AS (SELECT x.l, x.m, y.o, sum(x.v * y.v) AS v FROM pm x JOIN inverse y ON x.l = y.l AND x.o = y.m GROUP BY ALL),
sums AS (SELECT l, sum(CASE WHEN m = o THEN off.v ELSE 0 END) AS rss, sum(off.v * (f / lam / lam + g / {config.iso_penalty**2!r})) AS eta2, sum(CASE WHEN m = o THEN inverse.v ELSE 0 END) AS rest
  FROM off JOIN inverse USING (l, m, o) JOIN fk USING (m, o) JOIN ik USING (m, o) JOIN lams USING (l) GROUP BY l),
curve AS (SELECT l, lam, rss, eta2, rss / 64 / greatest((rest / 64) ** 2, 1e-12) AS gcv FROM sums JOIN lams USING (l)),
point AS (SELECT l, lam, ln(rss) / 2 AS x, ln(eta2) / 2 AS y FROM curve),
three AS (SELECT q.lam, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy, r.x AS rx, r.y AS ry FROM point q JOIN point p ON p.l = q.l - 1 JOIN point r ON r.l = q.l + 1),
bends AS (SELECT lam, 2 * abs((qx - px) * (ry - py) - (rx - px) * (qy - py)) / (sqrt((px - qx) ** 2 + (py - qy) ** 2) * sqrt((qx - rx) ** 2 + (qy - ry) ** 2) * sqrt((px - rx) ** 2 + (py - ry) ** 2)) AS bend FROM three)
"""


@_query(_fiber_scores(Config()) + "SELECT 'gcv' AS method, round(min_by(lam, gcv), 9) AS lambda FROM curve UNION ALL SELECT 'corner', round(max_by(lam, bend), 9) FROM bends")
def fiber_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiber penalty by cross-validation and by the corner of the residual's curve."""
    config = Config()
    curve = _fiber_curve(_rows(spark, sf_dir), config.dictionary(X.PROTOCOL), config.iso_penalty)
    by_gcv = calibration.least(curve).select(F.lit("gcv").alias("method"), "lambda")
    both = by_gcv.unionByName(calibration.corner(curve).select(F.lit("corner").alias("method"), "lambda"))
    return both.select("method", F.round("lambda", 9).alias("lambda"))


@_query()
def fiber_penalty_discrepancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiber penalty at which a sample's residual meets its noise, and the greatest one tried below that."""
    config = Config()
    dictionary = config.dictionary(X.PROTOCOL)
    sample = _sample(spark, sf_dir)
    sigma = signals.sample_sigma(sample.withColumn("s0", F.lit(1.0)), X.PROTOCOL).first()["sigma"] or 0.0
    limit = len(X.PROTOCOL.b) * sigma**2
    curve = calibration.residual_curve(sample, dictionary, config.iso_penalty, list(np.logspace(-6, 4, 16)))
    value = calibration.discrepancy_search(sample, dictionary, config.iso_penalty, limit)
    at = spark.createDataFrame([("discrepancy", float(value))], "method string, lambda double")
    return at.unionByName(calibration.cap(curve, limit).select(F.lit("cap").alias("method"), "lambda"))


@_query()
def two_pass_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both penalties of a sample, chosen in two passes."""
    sample = _sample(spark, sf_dir)
    sigma = signals.sample_sigma(sample.withColumn("s0", F.lit(1.0)), X.PROTOCOL).first()["sigma"] or 0.0
    return calibration.two_pass(sample, Config().dictionary(X.PROTOCOL), sigma)


def _grid_scores(spark: SparkSession, sf_dir: str, sizes: list[int]) -> DataFrame:
    b = np.array(X.PROTOCOL.b)
    return calibration.grid_scores(spark, calibration.moments(_rows(spark, sf_dir), len(b)), b, {n: iso_grid(n) for n in sizes})


_BY_GRID = ", g AS (SELECT n, min(gcv) AS s FROM scores GROUP BY n), o AS (SELECT min(s) AS lo, max(s) AS hi, min_by(n, s) AS best FROM g)\n"


@_query(_ridge({n: iso_grid(n) for n in range(4, 36, 2)}) + _BY_GRID + """SELECT any_value(best)::INT AS best, round(any_value((hi - lo) / lo), 6) AS span,
  (CASE WHEN any_value((hi - lo) / lo) >= 0.005 THEN min(n) FILTER (WHERE s <= lo * 1.02) END)::DOUBLE AS n_iso FROM g CROSS JOIN o""")
def iso_grid_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest isotropic grid that scores like the best one, over the moments of all voxels."""
    found = calibration.fewest(_grid_scores(spark, sf_dir, list(range(4, 36, 2))))
    return _rounded(found.withColumn("n_iso", F.col("n_iso").cast("double")), "best")


@_query(_ridge({n: iso_grid(n) for n in calibration.near_sizes(10)}) + _BY_GRID + "SELECT 10 AS chosen, best::INT AS best, abs(best - 10) <= 2 AS agrees FROM o")
def iso_grid_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether cross-validation over all voxels agrees with the isotropic grid of the fit."""
    size = Config().iso_steps
    return calibration.crosscheck(_grid_scores(spark, sf_dir, calibration.near_sizes(size)), size)


@_query(_WEIGHTS + """, conc AS (SELECT voxel_id, CASE WHEN max(total) >= 1e-10 THEN max(mass) / max(total) ELSE 0 END AS c FROM basin GROUP BY voxel_id),
fibers AS (SELECT vec_id AS voxel_id, list_sum(list_transform(embedding[1:60], lambda x: greatest(x::DOUBLE, 0))) / list_sum(list_transform(embedding, lambda x: greatest(x::DOUBLE, 0))) AS ff FROM embeddings WHERE label = 0)
SELECT round(CASE WHEN count(*) >= 30 THEN quantile_cont(c, 0.9) ELSE 0.35::DOUBLE END, 6) AS gate, count(*) AS rows FROM conc JOIN fibers USING (voxel_id) WHERE ff > 0.15""")
def concentration_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate that nine in ten of the fiber-free reference voxels stay under."""
    found = weights.concentration(_masses(spark, sf_dir))
    free = X.weights(spark, sf_dir).filter("label = 0").select("voxel_id", (C.total(F.slice("w", 1, 60)) / C.total(F.col("w"))).alias("ff"))
    return _rounded(calibration.concentration_gate(found.join(free, "voxel_id")), "rows")


_LABELLED = """, lab AS (SELECT *, greatest(rf_level * (0.9::DOUBLE - 0.3::DOUBLE * ff_level) - 0.03::DOUBLE, 0.0::DOUBLE) + 0.002::DOUBLE * (voxel_id * 7919 % 11) / 10 AS rf_est, ff_level + 0.001::DOUBLE * (voxel_id % 7) AS ff_est
  FROM (SELECT p_partkey AS voxel_id, ([0.0, 0.2, 0.4, 0.6]::DOUBLE[])[p_partkey % 4 + 1] AS ff_level, ([0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5]::DOUBLE[])[p_partkey // 4 % 9 + 1] AS rf_level FROM part) WHERE ff_level + rf_level <= 0.95::DOUBLE),
resp AS (SELECT ff_level, rf_level, avg(ff_est) AS ff_est, avg(rf_est) AS rf_est FROM lab GROUP BY ALL)
"""


@_query(_LABELLED + "SELECT ff_level, rf_level, round(ff_est, 6) AS ff_est, round(rf_est, 6) AS rf_est FROM resp")
def restricted_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean estimates in each cell of true fiber and restricted fraction."""
    return _rounded(calibration.restricted_response(X.labelled(spark, sf_dir)), "ff_level", "rf_level")


_CORRECTED = _LABELLED + """, m AS (SELECT ff_level, rf_level, max(rf_est) OVER (PARTITION BY ff_level ORDER BY rf_level) AS est, row_number() OVER (PARTITION BY ff_level ORDER BY rf_level) AS i, count(*) OVER (PARTITION BY ff_level) AS n FROM resp),
lev AS (SELECT ff_level, avg(ff_est) AS mid, row_number() OVER (ORDER BY avg(ff_est)) AS j, count(*) OVER () AS levels FROM resp GROUP BY ff_level),
k AS (SELECT voxel_id, rf, m.ff_level, n, count(*) FILTER (WHERE est <= rf) AS below FROM truth CROSS JOIN m GROUP BY ALL),
inv AS (SELECT k.voxel_id, k.ff_level, CASE WHEN below = 0 OR below = k.n THEN lo.rf_level ELSE lo.rf_level + (k.rf - lo.est) / (hi.est - lo.est) * (hi.rf_level - lo.rf_level) END AS v
  FROM k JOIN m lo ON lo.ff_level = k.ff_level AND lo.i = greatest(below, 1) LEFT JOIN m hi ON hi.ff_level = k.ff_level AND hi.i = below + 1),
pick AS (SELECT voxel_id, ff, rf, hf, (SELECT count(*) FROM lev WHERE mid <= ff) AS nj FROM truth),
out AS (SELECT p.voxel_id, p.rf, p.hf, greatest(0.0::DOUBLE, least(1.0::DOUBLE, a.v + CASE WHEN l.j < h.j AND p.ff > l.mid THEN (p.ff - l.mid) / (h.mid - l.mid) ELSE 0 END * (b.v - a.v))) AS c
  FROM pick p JOIN lev l ON l.j = greatest(nj, 1) JOIN lev h ON h.j = least(nj + 1, h.levels) JOIN inv a ON a.voxel_id = p.voxel_id AND a.ff_level = l.ff_level JOIN inv b ON b.voxel_id = p.voxel_id AND b.ff_level = h.ff_level)
"""


@_query(_CORRECTED + "SELECT voxel_id, round(c, 6) AS rf_corrected, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, hf - (c - rf))), 6) AS hf_corrected FROM out")
def restricted_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restricted and hindered fractions after inverting the response table."""
    out = calibration.corrected_restricted(X.truth(spark, sf_dir), calibration.restricted_response(X.labelled(spark, sf_dir)))
    return out.select("voxel_id", _r(F.col("rf_corrected")).alias("rf_corrected"), _r(F.col("hf_corrected")).alias("hf_corrected"))


@_query(_CORRECTED + "SELECT count(*) FILTER (WHERE rf < 0.02) AS dead, round(avg(rf), 6) AS mean_before, round(avg(c), 6) AS mean_after FROM out")
def restricted_dead_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels in the dead zone of the restricted fraction, and its mean before and after the correction."""
    out = calibration.corrected_restricted(X.truth(spark, sf_dir), calibration.restricted_response(X.labelled(spark, sf_dir)))
    return _rounded(diffusivity.dead_zone(out), "dead")

"""The fit over a stream of voxel rows: it keeps no state, so rows are fitted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame

from voxelmill.plans.fitting import Config, fit
from voxelmill.schema import Protocol


def fit_stream(voxels: DataFrame, protocol: Protocol, noise: DataFrame, config: Config = Config(), penalties: DataFrame | None = None, gate: DataFrame | None = None, response: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """A streaming DataFrame of fits of streamed (voxel_id, in_mask, signal), with one row of ``noise``
    (snr, sigma) estimated beforehand, as from ``noise_of`` over an earlier batch; so are the other tables."""
    return fit(voxels, protocol, config, noise, penalties, gate, response)

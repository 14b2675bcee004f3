"""Part of the diffusion-signal engine."""

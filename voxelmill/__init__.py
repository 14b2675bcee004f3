"""Diffusion-signal analytics as Spark DataFrame operations."""

"""Relational, spatial, raster, graph and statistical operators."""

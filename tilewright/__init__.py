"""Tilewright: multiresolution grid, raster and spatial analytics as Spark jobs."""

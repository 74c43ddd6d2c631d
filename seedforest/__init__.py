"""Seed-based raster segmentation and table operators on PySpark DataFrames."""

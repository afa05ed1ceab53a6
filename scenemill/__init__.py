"""Batch and streaming jobs over captures, camera models, splat tables and experiments, on PySpark."""

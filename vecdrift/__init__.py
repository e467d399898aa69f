"""Embedding-geometry and distribution-shift analytics as DataFrame-in, DataFrame-out operators on Spark."""

"""Curve, trajectory and vector analytics on Spark."""

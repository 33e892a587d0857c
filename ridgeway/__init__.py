"""Terrain analysis on Spark."""

"""Terrain-hazard and rainfall-trigger analytics as Spark DataFrame operators."""

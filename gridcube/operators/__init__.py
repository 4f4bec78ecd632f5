"""Cube operators: each takes a GridCube and returns a GridCube (or a report)."""

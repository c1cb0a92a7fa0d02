"""Operators over voxel, series, label, edge and feature tables; each returns a DataFrame."""

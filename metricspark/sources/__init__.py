"""Scans, catalogs, cell grids, publishing and run audit."""

"""Registered queries over the driver tables, each next to its SQL oracle."""

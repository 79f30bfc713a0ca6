"""Periodic statistical reporting on large fact tables, written as Spark jobs.

Every operator takes DataFrames and returns DataFrames. Small configuration
(rules, bands, criteria, policies) arrives as plain Python objects and is
compiled to native column expressions, so nothing leaves the JVM.
"""

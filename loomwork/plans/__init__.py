"""Whole plans built from operators, and the catalogue of registered queries."""

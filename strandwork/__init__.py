"""Genome and gene-set analytics as PySpark DataFrame functions."""

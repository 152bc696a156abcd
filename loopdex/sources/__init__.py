"""Readers for the corpus inputs and the fixture views over the driver tables."""

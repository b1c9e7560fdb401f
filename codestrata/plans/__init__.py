"""Compositions of operators into the published results."""

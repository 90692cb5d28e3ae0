"""Numerical kernels: pure functions of arrays and an explicit seed, run on one group each."""

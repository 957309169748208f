"""Scalar functions and text kernels."""
